"""Sources, sinks, projections, joins, scalar functions and group comparisons over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions import scalars
from hindcast.operators import contract, groups, joins, pit, quality, splits
from hindcast.plans.bindings import DAY, EVENTS, HOUR, ORDERS, events, orders, rounded, table, tail_sql
from hindcast.plans.feature_queries import SPLIT_SQL, _frame
from hindcast.plans.registry import query
from hindcast.roles import EntityFeatures
from hindcast.session import shared_path
from hindcast.sources import files, keyed_load, sinks


@query("s1_csv_scan", "SELECT doc_id, quality, toxic FROM labels")
def _(spark, folder):
    source = table(spark, folder, "labels")
    path = shared_path(spark, "labels-csv")
    source.write.csv(path, header=True)
    return files.read_csv(spark, path, "doc_id BIGINT, quality INT, toxic INT")


@query("s2_required_columns", "SELECT count(*) AS row_count, 3 AS required_columns FROM orders")
def _(spark, folder):
    rows = orders(spark, folder)
    required = {"txn_id", "t", "amount"}
    contract.require_columns(rows, required, "orders")
    return rows.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(required)).alias("required_columns"))


@query("s3_column_scan", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, folder):
    return files.read_columns(spark, f"{folder}/orders.parquet", ["o_orderkey", "o_totalprice"])


@query("s4_write_new", f"WITH {ORDERS}, {SPLIT_SQL} SELECT split, count(*) AS row_count FROM split GROUP BY split")
def _(spark, folder):
    path = shared_path(spark, "split")
    sinks.write_new(splits.ratio_split(orders(spark, folder)), path, ("split",))
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("row_count"))


@query("s5_write_replacing", f"WITH {ORDERS} SELECT count(*) AS row_count, count(DISTINCT card) AS cards FROM txn")
def _(spark, folder):
    path = shared_path(spark, "replaced")
    rows = orders(spark, folder)
    sinks.write_replacing(rows.where(F.col("label") == 1), path)
    sinks.write_replacing(rows, path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("card").alias("cards"))


MANIFEST_SQL = """SELECT (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM labels) AS right_rows,
  count(*) AS joined_rows, count(l.doc_id) AS matches,
  round(count(l.doc_id) / CAST(count(*) AS DOUBLE), 6) AS coverage, count(*) - count(l.doc_id) AS unmatched
  FROM documents d LEFT JOIN labels l USING (doc_id)"""


def _labelled(spark, folder):
    documents = table(spark, folder, "documents").drop("text")
    return joins.one_to_one_left(documents, table(spark, folder, "labels"), "doc_id")


@query("s6_manifest", MANIFEST_SQL)
def _(spark, folder):
    path = shared_path(spark, "manifest")
    manifest = joins.join_manifest(_labelled(spark, folder), table(spark, folder, "labels"))
    sinks.write_json_report(rounded(manifest), path)
    schema = "left_rows BIGINT, right_rows BIGINT, joined_rows BIGINT, matches BIGINT, coverage DOUBLE, unmatched BIGINT"
    return spark.read.json(path, schema=schema)


@query("s7_csv_report", f"WITH {ORDERS} SELECT product, count(*) AS row_count, CAST(sum(label) AS BIGINT) AS positives FROM txn GROUP BY product")
def _(spark, folder):
    path = shared_path(spark, "report")
    report = orders(spark, folder).groupBy("product").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(F.col("label").cast("long")).alias("positives")
    )
    sinks.write_csv_report(report, path)
    return files.read_csv(spark, path, "product STRING, row_count BIGINT, positives BIGINT")


@query(
    "s8_keyed_load",
    """SELECT count(*) AS table_rows, count(DISTINCT o_orderkey) AS keys,
         count(*) - count(*) FILTER (WHERE o_orderstatus = 'F') AS second_inserted,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS second_skipped, 0 AS third_inserted FROM orders""",
)
def _(spark, folder):
    path = shared_path(spark, "loaded")
    rows = orders(spark, folder)
    keyed_load.append_missing(rows.where(F.col("label") == 1), path, "txn_id")
    second = keyed_load.append_missing(rows, path, "txn_id")
    third = keyed_load.append_missing(rows, path, "txn_id")
    return spark.read.parquet(path).agg(
        F.count(F.lit(1)).alias("table_rows"),
        F.countDistinct("txn_id").alias("keys"),
        F.lit(second.inserted).cast("long").alias("second_inserted"),
        F.lit(second.skipped).cast("long").alias("second_skipped"),
        F.lit(third.inserted).cast("int").alias("third_inserted"),
    )


@query(
    "s9_run_record",
    """SELECT 'load-1' AS run, count(*) AS row_count, count(DISTINCT o_orderkey) AS inserted, count(*) - count(DISTINCT o_orderkey) AS skipped,
         1.0::DOUBLE AS coverage, 'txn_id,t,card,amount,product,device,email,label,score' AS columns FROM orders""",
)
def _(spark, folder):
    rows = orders(spark, folder)
    result = keyed_load.append_missing(rows, shared_path(spark, "loaded"), "txn_id")
    return keyed_load.record_run(rows, shared_path(spark, "runs"), "load-1", result, 1.0)


#: Label lines of so many ids stand in one file.
IDS_PER_FILE = 100


@query(
    "s11_fingerprints",
    f"""SELECT CAST(file AS BIGINT) AS file, CAST(octet_length(encode(body)) AS BIGINT) AS size_bytes, sha256(body) AS sha256
       FROM (SELECT doc_id // {IDS_PER_FILE} AS file, string_agg(doc_id || ',' || quality || ',' || toxic || chr(10), '' ORDER BY doc_id) AS body
         FROM labels GROUP BY ALL)""",
)
def _(spark, folder):
    """The fingerprints of files whose bytes are known: the label table as ordered lines, a file for each range of ids."""
    path = shared_path(spark, "fingerprint")
    line = F.concat_ws(",", "doc_id", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("line")
    lines = table(spark, folder, "labels").select(F.expr(f"doc_id div {IDS_PER_FILE}").alias("file"), "doc_id", line)
    lines.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "line").write.partitionBy("file").text(path)
    found = files.fingerprints(spark, f"{path}/file=*")
    return found.select(F.regexp_extract("path", "file=([0-9]+)/", 1).cast("long").alias("file"), "size_bytes", "sha256")


@query("s11_expected_files", "SELECT unnest(['absent.csv', 'lost.parquet']) AS file_name")
def _(spark, folder):
    """Which of the expected files the folder of the tables lacks."""
    return files.missing_files(spark, f"{folder}/*.parquet", ("orders.parquet", "lost.parquet", "events.parquet", "absent.csv"))


@query(
    "p1_load_schema",
    "SELECT o_orderkey AS transaction_id, o_custkey AS account_id, o_totalprice AS transaction_amount FROM orders",
)
def _(spark, folder):
    source = table(spark, folder, "orders")
    quality.require_unique(source, "o_orderkey", "orders")
    mapping = {
        "o_orderkey": ("transaction_id", "bigint"),
        "o_custkey": ("account_id", "bigint"),
        "o_totalprice": ("transaction_amount", "double"),
    }
    return files.load_schema(source, mapping)


@query(
    "p2_json_payload",
    f"""WITH {EVENTS} SELECT txn_id, '{{' || concat_ws(',', '"card":' || card, '"product":"' || product || '"',
          '"device":' || device, '"email":"' || email || '"') || '}}' AS payload FROM txn""",
)
def _(spark, folder):
    return files.payload(events(spark, folder).select("txn_id", "card", "product", "device", "email"), "txn_id")


CONTRACT_RULES = contract.ContractRules(("txn_id", "t", "label"), ("score",), (), 0.10)


@query(
    "p3_exclusions",
    f"""WITH {EVENTS}, {SPLIT_SQL}, train AS (SELECT * FROM split WHERE split = 'train'), rates AS (
          {' UNION ALL '.join(f"SELECT '{c}' AS column, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS null_rate FROM train"
                              for c in ("txn_id", "t", "card", "amount", "product", "device", "email", "label", "score"))})
        SELECT "column", round(null_rate, 6) AS null_rate, CASE WHEN "column" IN ('txn_id','t','label') THEN 'mandatory'
          WHEN "column" = 'score' THEN 'listed' WHEN null_rate > 0.10 THEN 'null_rate' END AS reason FROM rates""",
)
def _(spark, folder):
    tagged = splits.ratio_split(events(spark, folder))
    return rounded(contract.exclusions(tagged.where("split = 'train'").drop("split"), CONTRACT_RULES))


TEXT_COLUMNS = ("product", "email")


@query(
    "p4_column_kinds",
    f"""WITH {EVENTS} {' UNION ALL '.join(
        f"SELECT '{c}' AS column, count(DISTINCT {c}) AS distinct_values, '{'categorical' if c in TEXT_COLUMNS else 'numeric'}' AS kind FROM txn"
        for c in ("txn_id", "t", "card", "amount", "product", "device", "email", "label", "score"))}""",
)
def _(spark, folder):
    """Kinds of every column with its distinct count, over the whole table."""
    rows = events(spark, folder)
    numeric, _ = contract.column_kinds(rows, rows.columns)
    wide = rows.agg(*(F.countDistinct(c).alias(c) for c in rows.columns))
    long = wide.unpivot([], rows.columns, "column", "distinct_values")
    return long.withColumn("kind", F.when(F.col("column").isin(numeric), "numeric").otherwise("categorical"))


def _contract_pair(spark, folder):
    tagged = splits.ratio_split(events(spark, folder))
    train = tagged.where("split = 'train'").drop("split")
    later = tagged.where("split = 'validation'").drop("split")
    return train, later, contract.feature_contract(train, later, CONTRACT_RULES)


@query(
    "p5_feature_contract",
    f"""WITH {EVENTS}, {SPLIT_SQL} SELECT txn_id, label, amount, card, product FROM split WHERE split = 'validation'""",
)
def _(spark, folder):
    _, later, agreed = _contract_pair(spark, folder)
    return agreed.apply(later, ("txn_id", "label"))


@query(
    "p6_contract_enforced",
    f"""WITH {EVENTS}, {SPLIT_SQL} SELECT count(*) AS row_count, round(sum(amount), 4) AS amount_total, 3 AS features
        FROM split WHERE split = 'test'""",
)
def _(spark, folder):
    train, later, agreed = _contract_pair(spark, folder)
    tagged = splits.ratio_split(events(spark, folder)).where("split = 'test'")
    scored = agreed.apply(tagged)
    return scored.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.round(F.sum("amount"), 4).alias("amount_total"),
        F.lit(len(scored.columns)).alias("features"),
    )


@query(
    "p7_split_tag_union",
    f"""WITH {ORDERS}, {SPLIT_SQL}, w AS (SELECT *, count(*) {_frame('card', None)} AS history_card_count FROM split)
        SELECT txn_id, history_card_count FROM w WHERE split = 'test'""",
)
def _(spark, folder):
    tagged = splits.ratio_split(orders(spark, folder))
    parts = [tagged.where(F.col("split") == s).drop("split") for s in ("train", "validation", "test")]
    spec = EntityFeatures("card", ("card",), history=True)
    made = pit.with_history_of(parts[:2], parts[2], lambda df: pit.entity_features(df, spec))
    return made.select("txn_id", "history_card_count")


@query(
    "p8_group_masks",
    f"""WITH {EVENTS} SELECT count(*) FILTER (WHERE device > 50) AS in_a, count(*) FILTER (WHERE device <= 50) AS in_b,
          count(*) FILTER (WHERE device IS NULL) AS in_neither FROM txn""",
)
def _(spark, folder):
    device = F.col("device")
    return events(spark, folder).agg(
        F.count_if(device > 50).alias("in_a"),
        F.count_if(device <= 50).alias("in_b"),
        F.count_if(device.isNull()).alias("in_neither"),
    )


@query(
    "p11_probability_guard",
    f"""WITH {EVENTS} SELECT count(*) AS row_count, count(*) FILTER (WHERE score IS NULL OR score < 0 OR score > 1)
          AS invalid FROM txn""",
)
def _(spark, folder):
    from hindcast.operators.policy import probability_facts

    return probability_facts(events(spark, folder), "score")


@query(
    "p12_label_guard",
    f"""WITH {EVENTS} SELECT count(*) AS row_count, count(*) FILTER (WHERE label IS NULL OR label NOT IN (0, 1)) AS invalid,
          count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives FROM txn""",
)
def _(spark, folder):
    from hindcast.operators.policy import label_facts

    return label_facts(events(spark, folder), "label")


@query("j1_one_to_one_left", "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, l.doc_id IS NOT NULL AS matched FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, folder):
    return _labelled(spark, folder)


@query("j1_join_manifest", MANIFEST_SQL)
def _(spark, folder):
    return rounded(joins.join_manifest(_labelled(spark, folder), table(spark, folder, "labels")))


@query(
    "j2_mapping_lookup",
    """WITH m AS (SELECT c_nationkey AS nation, avg(c_acctbal) AS encoded FROM customer GROUP BY 1 HAVING count(*) >= 60),
       g AS (SELECT avg(c_acctbal) AS fallback FROM customer)
       SELECT s_suppkey, s_nationkey AS nation, round(coalesce(encoded, fallback), 6) AS encoded
       FROM supplier LEFT JOIN m ON s_nationkey = nation, g""",
)
def _(spark, folder):
    customer = table(spark, folder, "customer")
    mapping = (
        customer.groupBy(F.col("c_nationkey").alias("nation"))
        .agg(F.avg("c_acctbal").alias("encoded"), F.count(F.lit(1)).alias("n"))
        .where("n >= 60")
    )
    fallback = customer.agg(F.avg("c_acctbal")).scalar()
    rows = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return rounded(joins.lookup(rows, mapping, "nation", "encoded", fallback, "s_suppkey")).select("s_suppkey", "nation", "encoded")


@query(
    "j3_append_features",
    f"""WITH {ORDERS} SELECT txn_id, t, amount, count(*) {_frame('card', 7)} AS velocity_card_7d FROM txn""",
)
def _(spark, folder):
    rows = orders(spark, folder)
    made = pit.behavioural_features(rows, [EntityFeatures("card", ("card",), velocity={"7d": 7 * DAY})])
    return joins.append_features(rows.select("txn_id", "t", "amount"), made, "txn_id")


@query("j6_keyed_anti_join", "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, folder):
    offered = table(spark, folder, "documents").select("doc_id", "lang", "source")
    return keyed_load.missing_rows(offered, table(spark, folder, "labels"), "doc_id")


@query(
    "j7_as_of_lookup",
    f"""WITH {EVENTS} SELECT p.txn_id, s.t AS purchase_t, s.amount AS purchase_amount FROM txn p
        ASOF LEFT JOIN (SELECT card, t, amount FROM txn WHERE product = 'purchase') s ON p.card = s.card AND p.t > s.t""",
)
def _(spark, folder):
    from hindcast.operators.ordered import as_of

    rows = events(spark, folder).select("txn_id", "card", "t", "product", "amount")
    states = rows.where(F.col("product") == "purchase").select(
        "card", "t", F.col("t").alias("purchase_t"), F.col("amount").alias("purchase_amount")
    )
    found = as_of(rows.select("txn_id", "card", "t"), states, ("card",), "t", ("purchase_t", "purchase_amount"))
    return found.select("txn_id", "purchase_t", "purchase_amount")


@query(
    "j8_interval_join",
    f"""WITH {EVENTS} SELECT a.txn_id, count(b.txn_id) AS earlier_rows, round(coalesce(sum(b.amount), 0), 4) AS earlier_amount
        FROM txn a LEFT JOIN txn b ON a.card = b.card AND b.t >= a.t - {24 * HOUR} AND b.t < a.t GROUP BY a.txn_id""",
)
def _(spark, folder):
    spec = EntityFeatures("card", ("card",), velocity={"w": 24 * HOUR}, amounts={"w": 24 * HOUR}, sums=True)
    made = pit.behavioural_features(events(spark, folder), [spec])
    return made.select("txn_id", F.col("velocity_card_w").alias("earlier_rows"), F.round("amount_card_w_sum", 4).alias("earlier_amount"))


@query(
    "b1_wilson_interval",
    f"""WITH {ORDERS}, g AS (SELECT product, CAST(sum(label) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM txn GROUP BY product),
        c AS (SELECT *, s / n AS p, 1.959963984540054 AS z FROM g)
        SELECT product, round(greatest(0.0, (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS lower,
          round(least(1.0, (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS upper FROM c""",
)
def _(spark, folder):
    counted = orders(spark, folder).groupBy("product").agg(F.sum("label").alias("s"), F.count(F.lit(1)).alias("n"))
    lower, upper = scalars.wilson_bounds(F.col("s"), F.col("n"))
    return rounded(counted.select("product", lower.alias("lower"), upper.alias("upper")))


@query(
    "b2_two_proportion_z",
    f"""WITH {EVENTS}, g AS (SELECT CAST(sum(label) FILTER (WHERE device > 50) AS DOUBLE) AS ha,
          CAST(count(*) FILTER (WHERE device > 50) AS DOUBLE) AS na,
          CAST(sum(label) FILTER (WHERE device <= 50) AS DOUBLE) AS hb,
          CAST(count(*) FILTER (WHERE device <= 50) AS DOUBLE) AS nb FROM txn)
        SELECT round((ha/na - hb/nb) / sqrt(((ha+hb)/(na+nb)) * (1 - (ha+hb)/(na+nb)) * (1/na + 1/nb)), 6) AS z FROM g""",
)
def _(spark, folder):
    device, label = F.col("device"), F.col("label")
    c = events(spark, folder).agg(
        F.count_if((device > 50) & (label == 1)).alias("ha"),
        F.count_if(device > 50).alias("na"),
        F.count_if((device <= 50) & (label == 1)).alias("hb"),
        F.count_if(device <= 50).alias("nb"),
    )
    z = scalars.two_proportion_z(*(F.col(x) for x in ("ha", "na", "hb", "nb")))
    return rounded(c.select(z.alias("z")))


def _comparisons():
    return {
        "high_device": (F.col("device") > 50, F.col("device") <= 50),
        "high_amount": (F.col("amount") >= 40.0, F.col("amount") < 40.0),
        "known_email": (F.col("email") == "click", F.col("email") == "view"),
    }


def _comparison_sql(name: str, a: str, b: str) -> str:
    return f"""SELECT '{name}' AS comparison, CAST(count(*) FILTER (WHERE {a}) AS DOUBLE) AS na,
      CAST(count(*) FILTER (WHERE {a} AND label = 1) AS DOUBLE) AS ha, CAST(count(*) FILTER (WHERE {b}) AS DOUBLE) AS nb,
      CAST(count(*) FILTER (WHERE {b} AND label = 1) AS DOUBLE) AS hb FROM txn"""


def _wilson_sql(p: str, n: str, sign: str) -> str:
    z = "1.959963984540054"
    edge = f"({p} + {z}*{z}/(2*{n}) {sign} {z} * sqrt({p}*(1-{p})/{n} + {z}*{z}/(4*{n}*{n}))) / (1 + {z}*{z}/{n})"
    return f"round({'greatest(0.0' if sign == '-' else 'least(1.0'}, {edge}), 6)"


COMPARISON_COLUMNS = f"""comparison, CAST(na AS BIGINT) AS group_a_rows, CAST(ha AS BIGINT) AS group_a_positives,
  round(ha/na, 6) AS group_a_rate, {_wilson_sql('(ha/na)', 'na', '-')} AS group_a_ci_lower,
  {_wilson_sql('(ha/na)', 'na', '+')} AS group_a_ci_upper, CAST(nb AS BIGINT) AS group_b_rows,
  CAST(hb AS BIGINT) AS group_b_positives, round(hb/nb, 6) AS group_b_rate,
  {_wilson_sql('(hb/nb)', 'nb', '-')} AS group_b_ci_lower, {_wilson_sql('(hb/nb)', 'nb', '+')} AS group_b_ci_upper,
  round(ha/na - hb/nb, 6) AS rate_difference, round((ha/na) / nullif(hb/nb, 0), 6) AS relative_risk,
  round((ha/na - hb/nb) / nullif(sqrt(((ha+hb)/(na+nb)) * (1 - (ha+hb)/(na+nb)) * (1/na + 1/nb)), 0), 6) AS z_statistic"""


@query(
    "b3_group_comparison",
    f"""WITH {EVENTS}, c AS ({_comparison_sql('high_device', 'device > 50', 'device <= 50')}
          UNION ALL {_comparison_sql('high_amount', 'amount >= 40.0', 'amount < 40.0')}
          UNION ALL {_comparison_sql('known_email', "email = 'click'", "email = 'view'")})
        SELECT {COMPARISON_COLUMNS} FROM c""",
)
def _(spark, folder):
    made = groups.compare_groups(events(spark, folder), "label", _comparisons())
    return rounded(made.drop("p_value", "significant"))


@query(
    "b3_group_comparison_p_values",
    f"""WITH {EVENTS}, c AS ({_comparison_sql('high_device', 'device > 50', 'device <= 50')}
          UNION ALL {_comparison_sql('high_amount', 'amount >= 40.0', 'amount < 40.0')}
          UNION ALL {_comparison_sql('known_email', "email = 'click'", "email = 'view'")}),
        z AS (SELECT comparison, (ha/na - hb/nb) / nullif(sqrt(((ha+hb)/(na+nb)) * (1 - (ha+hb)/(na+nb)) * (1/na + 1/nb)), 0) AS z FROM c),
        p AS (SELECT *, {tail_sql('abs(z) / sqrt(2)')} AS p FROM z)
        SELECT comparison, round(z, 10) AS z_statistic, round(p, 10) AS p_value, coalesce(p < 0.05, false) AS significant FROM p""",
)
def _(spark, folder):
    made = groups.compare_groups(events(spark, folder), "label", _comparisons())
    return rounded(made.select("comparison", "z_statistic", "p_value", "significant"), 10)


@query(
    "b4_high_velocity_groups",
    f"""WITH {ORDERS}, v AS (SELECT *, count(*) {_frame('card', 30)} AS velocity FROM txn),
        cut AS (SELECT quantile_cont(CAST(velocity AS DOUBLE), 0.95) AS threshold FROM v)
        SELECT threshold, count(*) FILTER (WHERE velocity >= threshold) AS high_rows,
          count(*) FILTER (WHERE velocity < threshold) AS lower_rows,
          CAST(sum(label) FILTER (WHERE velocity >= threshold) AS BIGINT) AS high_positives FROM v, cut GROUP BY threshold""",
)
def _(spark, folder):
    rows = orders(spark, folder)
    made = pit.entity_features(rows, EntityFeatures("card", ("card",), velocity={"30d": 30}))
    threshold = groups.high_group_threshold(made, "velocity_card_30d")
    high = F.col("velocity_card_30d") >= threshold
    return made.agg(
        F.lit(threshold).alias("threshold"),
        F.count_if(high).alias("high_rows"),
        F.count_if(~high).alias("lower_rows"),
        F.sum(F.when(high, F.col("label").cast("long"))).alias("high_positives"),
    )


@query("f1_stable_sort", f"WITH {ORDERS} SELECT txn_id, product, t FROM txn ORDER BY product, t, txn_id")
def _(spark, folder):
    return orders(spark, folder).orderBy("product", "t", "txn_id").select("txn_id", "product", "t")


@query("f2_sort_limit", f"WITH {ORDERS} SELECT txn_id, amount FROM txn ORDER BY amount DESC, txn_id LIMIT 20")
def _(spark, folder):
    return orders(spark, folder).orderBy(F.desc("amount"), "txn_id").limit(20).select("txn_id", "amount")


@query(
    "f3_group_limit",
    f"""WITH {ORDERS} SELECT product, txn_id, amount FROM txn
        QUALIFY row_number() OVER (PARTITION BY product ORDER BY amount DESC, txn_id) <= 20""",
)
def _(spark, folder):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("product").orderBy(F.desc("amount"), "txn_id"))
    return orders(spark, folder).withColumn("rank", rank).where("rank <= 20").select("product", "txn_id", "amount")


@query(
    "f4_union_by_name",
    """SELECT o_orderkey AS txn_id, o_totalprice AS amount FROM orders
       UNION ALL BY NAME SELECT value AS amount, event_id AS txn_id FROM events""",
)
def _(spark, folder):
    first = orders(spark, folder).select("txn_id", "amount")
    return first.unionByName(events(spark, folder).select("amount", "txn_id"))


@query("f5_distinct_times", f"WITH {ORDERS} SELECT DISTINCT t FROM txn")
def _(spark, folder):
    return orders(spark, folder).select("t").distinct()


@query(
    "f6_math",
    f"""WITH {ORDERS} SELECT txn_id, round(ln(1 + amount), 6) AS log_amount, round(sqrt(amount), 6) AS root,
          abs(t - 1000) AS distance, least(greatest(score, 0.2), 0.6) AS clipped,
          CAST(floor(amount / 1000) AS BIGINT) AS thousands, round(amount, 1) AS one_decimal FROM txn""",
)
def _(spark, folder):
    amount = F.col("amount")
    return orders(spark, folder).select(
        "txn_id",
        F.round(F.log1p(amount), 6).alias("log_amount"),
        F.round(F.sqrt(amount), 6).alias("root"),
        F.abs(F.col("t") - 1000).alias("distance"),
        scalars.clipped(F.col("score"), 0.2, 0.6).alias("clipped"),
        F.floor(amount / 1000).alias("thousands"),
        F.round(amount, 1).alias("one_decimal"),
    )


@query(
    "f7_time_arithmetic",
    f"""WITH {EVENTS} SELECT txn_id, CAST((t // 1000000 // 3600) % 24 AS BIGINT) AS hour,
          CAST((t // 1000000 // 86400) % 7 AS BIGINT) AS day_of_week, t - {HOUR} AS window_start FROM txn""",
)
def _(spark, folder):
    seconds = F.floor(F.col("t") / 1000000)
    return events(spark, folder).select(
        "txn_id",
        scalars.hour_of_day(seconds).alias("hour"),
        scalars.day_of_week(seconds).alias("day_of_week"),
        (F.col("t") - HOUR).alias("window_start"),
    )


@query(
    "f8_strings",
    f"""WITH {EVENTS} SELECT txn_id, coalesce(nullif(CAST(email AS VARCHAR), ''), '__MISSING__') AS email,
          'card:' || card AS node, concat_ws('_', CAST(card AS VARCHAR), email) AS entity,
          printf('%.2f%%', score * 100) AS share FROM txn""",
)
def _(spark, folder):
    return events(spark, folder).select(
        "txn_id",
        scalars.category(F.col("email")).alias("email"),
        F.concat(F.lit("card:"), F.col("card")).alias("node"),
        F.concat_ws("_", F.col("card").cast("string"), "email").alias("entity"),
        scalars.percentage(F.col("score")).alias("share"),
    )


@query(
    "f9_arrays",
    f"""WITH {EVENTS} SELECT card, array_to_string(list_sort(list_distinct(list(product) FILTER (WHERE label = 0))), ',') AS others,
          len(list_distinct(list(product))) AS products FROM txn GROUP BY card""",
)
def _(spark, folder):
    kinds = events(spark, folder).select("card", "product", "label").distinct()
    sets = kinds.groupBy("card").agg(
        F.collect_set(F.when(F.col("label") == 0, F.col("product"))).alias("others"),
        F.collect_set("product").alias("everything"),
    )
    shared = F.array_intersect("others", "everything")
    return sets.select(
        "card",
        F.array_join(F.array_sort(shared), ",").alias("others"),
        F.size(F.array_union("others", "everything")).cast("long").alias("products"),
    )


@query("f10_json_without_nulls", f"""WITH {EVENTS} SELECT txn_id, '{{' || concat_ws(',', '"device":' || device, '"email":"' || email || '"') || '}}' AS j FROM txn""")
def _(spark, folder):
    return events(spark, folder).select("txn_id", F.to_json(F.struct("device", "email")).alias("j"))
