"""Graph, sequence and target-encoding features over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.operators import encoding, graph, sequence, splits
from hindcast.plans.bindings import EVENTS, HOURLY, ORDERS, events, hourly_events, orders, rounded
from hindcast.plans.feature_queries import SPLIT_SQL
from hindcast.plans.registry import query
from hindcast.session import shared_path
from hindcast.sources import sinks

LINKS = """links AS (
  SELECT txn_id, 'device' AS family, card, CAST(device AS VARCHAR) AS entity, t FROM txn WHERE card IS NOT NULL AND device IS NOT NULL
  UNION ALL SELECT txn_id, 'email', card, email, t FROM txn WHERE card IS NOT NULL AND email IS NOT NULL),
firsts AS (SELECT family, card, entity, min(t) AS t0 FROM links GROUP BY ALL)"""


@query("g1_edges", f"WITH {HOURLY}, {LINKS} SELECT family, card, entity, t FROM links")
def _(spark, folder):
    return graph.edges(hourly_events(spark, folder))


@query(
    "g2_card_degree",
    f"""WITH {HOURLY}, {LINKS} SELECT x.txn_id, CASE WHEN x.card IS NOT NULL THEN count(f.t0) END AS card_prior_degree
        FROM txn x LEFT JOIN firsts f ON f.card = x.card AND f.t0 < x.t GROUP BY x.txn_id, x.card""",
)
def _(spark, folder):
    return graph.prior_card_degree(hourly_events(spark, folder)).select("txn_id", "card_prior_degree")


def _entity_degree_sql(family: str) -> str:
    return f"""SELECT x.txn_id, CASE WHEN x.{family} IS NOT NULL AND x.card IS NOT NULL THEN count(f.t0) END AS {family}_prior_card_degree
        FROM txn x LEFT JOIN firsts f ON f.family = '{family}' AND f.entity = CAST(x.{family} AS VARCHAR) AND f.t0 < x.t
        GROUP BY x.txn_id, x.card, x.{family}"""


@query(
    "g3_entity_degrees",
    f"""WITH {HOURLY}, {LINKS}, d AS ({_entity_degree_sql('device')}), e AS ({_entity_degree_sql('email')})
        SELECT txn_id, device_prior_card_degree, email_prior_card_degree FROM d JOIN e USING (txn_id)""",
)
def _(spark, folder):
    rows = graph.prior_entity_degree(hourly_events(spark, folder), "device")
    rows = graph.prior_entity_degree(rows, "email")
    return rows.select("txn_id", "device_prior_card_degree", "email_prior_card_degree")


def _pair_sql(family: str) -> str:
    frame = f"OVER (PARTITION BY card, {family} ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN card IS NOT NULL AND {family} IS NOT NULL THEN count(*) {frame} END AS card_{family}_prior_edge_count"


def _new_sql(family: str) -> str:
    c = f"card_{family}_prior_edge_count"
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_new_card_{family}"


@query(
    "g4_edge_counts",
    f"WITH {HOURLY} SELECT txn_id, {_pair_sql('device')}, {_pair_sql('email')} FROM txn",
)
def _(spark, folder):
    rows = graph.prior_edge_count(hourly_events(spark, folder), "device")
    rows = graph.prior_edge_count(rows, "email")
    return rows.select("txn_id", "card_device_prior_edge_count", "card_email_prior_edge_count")


@query(
    "g5_new_relationships",
    f"""WITH {HOURLY}, w AS (SELECT txn_id, {_pair_sql('device')}, {_pair_sql('email')} FROM txn)
        SELECT txn_id, {_new_sql('device')}, {_new_sql('email')} FROM w""",
)
def _(spark, folder):
    rows = graph.prior_edge_count(hourly_events(spark, folder), "device")
    rows = graph.prior_edge_count(rows, "email")
    return rows.select("txn_id", "is_new_card_device", "is_new_card_email")


def _squarings(times: int) -> str:
    """Repeated (min, max) products: the earliest time by which two nodes are connected."""
    steps = [
        f"""d{k + 1} AS MATERIALIZED (SELECT a.i, b.j, min(greatest(a.t, b.t)) AS t FROM d{k} a JOIN d{k} b ON a.j = b.i GROUP BY a.i, b.j)"""
        for k in range(times)
    ]
    return ", ".join(steps)


# 2 ** 9 steps exceed any simple path of the smaller test tables (239 nodes at scale 0.01).
COMPONENTS = f"""ends AS (SELECT 'card:' || card AS u, family || ':' || entity AS v, t0 FROM firsts),
ids AS (SELECT node, row_number() OVER (ORDER BY node) AS id FROM (SELECT u AS node FROM ends UNION SELECT v FROM ends)),
d0 AS MATERIALIZED (SELECT a.id AS i, b.id AS j, t0 AS t FROM ends JOIN ids a ON a.node = u JOIN ids b ON b.node = v
  UNION ALL SELECT b.id, a.id, t0 FROM ends JOIN ids a ON a.node = u JOIN ids b ON b.node = v
  UNION ALL SELECT id, id, -1 FROM ids),
{_squarings(9)},
probes AS (SELECT txn_id, t, 'card' AS part, 'card:' || card AS node FROM txn WHERE card IS NOT NULL
  UNION ALL SELECT txn_id, t, 'device', 'device:' || device FROM txn WHERE card IS NOT NULL AND device IS NOT NULL
  UNION ALL SELECT txn_id, t, 'email', 'email:' || email FROM txn WHERE card IS NOT NULL AND email IS NOT NULL),
others AS (SELECT p.node, p.t, count(d.j) AS others FROM (SELECT DISTINCT node, t FROM probes) p JOIN ids USING (node)
  LEFT JOIN d9 d ON d.i = ids.id AND d.j <> d.i AND d.t < p.t GROUP BY p.node, p.t),
sized AS (SELECT txn_id, part, CASE WHEN coalesce(others, 0) = 0 THEN 0 ELSE others + 1 END AS size
  FROM probes LEFT JOIN others USING (node, t)),
component_columns AS (SELECT txn.txn_id, CAST(max(size) FILTER (WHERE part = 'card') AS BIGINT) AS card_prior_component_size,
  CAST(max(size) FILTER (WHERE part = 'device') AS BIGINT) AS device_prior_component_size,
  CAST(max(size) FILTER (WHERE part = 'email') AS BIGINT) AS email_prior_component_size
  FROM txn LEFT JOIN sized USING (txn_id) GROUP BY txn.txn_id)"""


@query("g6_component_sizes", f"WITH {HOURLY}, {LINKS}, {COMPONENTS} SELECT * FROM component_columns")
def _(spark, folder):
    rows = graph.prior_component_sizes(hourly_events(spark, folder))
    return rows.select("txn_id", *(f"{p}_prior_component_size" for p in ("card", "device", "email")))


@query(
    "g7_carry_over",
    f"""WITH {HOURLY}, {SPLIT_SQL}, {LINKS.replace('FROM txn', "FROM split")}
        SELECT x.txn_id, count(f.t0) AS card_prior_degree FROM split x
        LEFT JOIN firsts f ON f.card = x.card AND f.t0 < x.t WHERE x.split = 'test' GROUP BY x.txn_id""",
)
def _(spark, folder):
    from hindcast.operators.pit import with_history_of

    tagged = splits.ratio_split(hourly_events(spark, folder))
    parts = [tagged.where(F.col("split") == s).drop("split") for s in ("train", "validation", "test")]
    made = with_history_of(parts[:2], parts[2], graph.prior_card_degree)
    return made.select("txn_id", "card_prior_degree")


BUNDLE = f"""c AS (SELECT x.txn_id, count(f.t0) AS card_prior_degree FROM txn x
    LEFT JOIN firsts f ON f.card = x.card AND f.t0 < x.t GROUP BY x.txn_id),
  d AS ({_entity_degree_sql('device')}), e AS ({_entity_degree_sql('email')}),
  p AS (SELECT txn_id, {_pair_sql('device')}, {_pair_sql('email')} FROM txn)"""
BUNDLE_COLUMNS = f"""card_prior_degree, device_prior_card_degree, email_prior_card_degree, card_device_prior_edge_count,
  card_email_prior_edge_count, {_new_sql('device')}, {_new_sql('email')}"""
BUNDLE_JOIN = "c JOIN d USING (txn_id) JOIN e USING (txn_id) JOIN p USING (txn_id)"


@query("g8_graph_bundle", f"WITH {HOURLY}, {LINKS}, {BUNDLE} SELECT txn_id, {BUNDLE_COLUMNS} FROM {BUNDLE_JOIN}")
def _(spark, folder):
    return graph.graph_features(hourly_events(spark, folder), components=False)


@query(
    "g8_graph_bundle_with_components",
    f"""WITH {HOURLY}, {LINKS}, {BUNDLE}, {COMPONENTS} SELECT txn_id, {BUNDLE_COLUMNS}, card_prior_component_size,
          device_prior_component_size, email_prior_component_size FROM {BUNDLE_JOIN} JOIN component_columns USING (txn_id)""",
)
def _(spark, folder):
    return graph.graph_features(hourly_events(spark, folder))


@query(
    "g7_bundle_carry_over",
    f"""WITH {HOURLY}, {SPLIT_SQL}, {LINKS}, {BUNDLE}, {COMPONENTS} SELECT txn_id, {BUNDLE_COLUMNS}, card_prior_component_size,
          device_prior_component_size, email_prior_component_size FROM {BUNDLE_JOIN} JOIN component_columns USING (txn_id)
          WHERE txn_id IN (SELECT txn_id FROM split WHERE split = 'test')""",
)
def _(spark, folder):
    """All ten columns of the last split, with the earlier splits as history."""
    from hindcast.operators.pit import with_history_of

    tagged = splits.ratio_split(hourly_events(spark, folder))
    parts = [tagged.where(F.col("split") == s).drop("split") for s in ("train", "validation", "test")]
    return with_history_of(parts[:2], parts[2], graph.graph_features)


LENGTH = 10
GAPS = """ev AS (SELECT *, ln(1 + amount) AS log_amount, ln(1 + greatest(coalesce(
    t - max(t) OVER (PARTITION BY card ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS log_gap FROM txn)"""
HISTORY = f"""{GAPS}, past AS (SELECT a.txn_id,
    list(b.log_amount ORDER BY b.t, b.txn_id) FILTER (WHERE b.txn_id IS NOT NULL) AS amounts,
    list(b.log_gap ORDER BY b.t, b.txn_id) FILTER (WHERE b.txn_id IS NOT NULL) AS gaps
    FROM txn a LEFT JOIN ev b ON a.card = b.card AND b.t < a.t GROUP BY a.txn_id),
  hist AS (SELECT txn_id, coalesce(amounts[-{LENGTH - 1}:], []) AS amounts, coalesce(gaps[-{LENGTH - 1}:], []) AS gaps FROM past)"""


def _text_sql(values: str) -> str:
    return f"array_to_string(list_transform({values}, lambda v: CAST(CAST(round(v, 6) AS DECIMAL(18,6)) AS VARCHAR)), ',')"


def _text(values, field: str):
    digits = F.transform(values, lambda e: F.round(e[field], 6).cast("decimal(18,6)").cast("string"))
    return F.array_join(digits, ",")


@query("q1_event_features", f"WITH {HOURLY}, {GAPS} SELECT txn_id, round(log_amount, 6) AS log_amount, round(log_gap, 6) AS log_gap FROM ev")
def _(spark, folder):
    return rounded(sequence.event_features(hourly_events(spark, folder)).select("txn_id", "log_amount", "log_gap"))


def _history(spark, folder):
    return sequence.prior_events(sequence.event_features(hourly_events(spark, folder)), LENGTH)


@query(
    "q2_prior_events",
    f"WITH {HOURLY}, {HISTORY} SELECT txn_id, {_text_sql('amounts')} AS amounts, {_text_sql('gaps')} AS gaps FROM hist",
)
def _(spark, folder):
    return _history(spark, folder).select(
        "txn_id", _text("history", "log_amount").alias("amounts"), _text("history", "log_gap").alias("gaps")
    )


PADDED_SQL = f"""WITH {HOURLY}, {HISTORY}, padded AS (SELECT txn_id, list_concat(list_resize([]::DOUBLE[], {LENGTH - 1} - len(amounts), 0.0::DOUBLE),
            list_append(amounts, log_amount)) AS amounts,
          list_concat(list_resize([]::DOUBLE[], {LENGTH - 1} - len(gaps), 0.0::DOUBLE), list_append(gaps, log_gap)) AS gaps
          FROM hist JOIN ev USING (txn_id))
        SELECT txn_id, {_text_sql('amounts')} AS amounts, {_text_sql('gaps')} AS gaps FROM padded"""


@query("q3_padded_sequences", PADDED_SQL)
def _(spark, folder):
    return sequence.sequences(hourly_events(spark, folder), LENGTH).select(
        "txn_id", _text("sequence", "log_amount").alias("amounts"), _text("sequence", "log_gap").alias("gaps")
    )


#: Violations of each input rule, at ids that both engines choose alike.
BROKEN_INPUT = {
    "txn_id": "CASE WHEN txn_id % 97 = 3 THEN NULL WHEN txn_id % 61 = 7 THEN txn_id - 1 ELSE txn_id END",
    "t": "CASE WHEN txn_id % 89 = 1 THEN NULL ELSE t END",
    "amount": "CASE WHEN txn_id % 83 = 2 THEN NULL WHEN txn_id % 79 = 3 THEN CAST('NaN' AS DOUBLE) WHEN txn_id % 73 = 4 THEN -1.5 - amount ELSE amount END",
    "label": "CASE WHEN txn_id % 71 = 5 THEN NULL WHEN txn_id % 67 = 6 THEN 7 ELSE label END",
}


@query(
    "q5_input_guards_broken",
    f"""WITH {EVENTS}, b AS (SELECT {', '.join(f'{e} AS {c}' for c, e in BROKEN_INPUT.items())} FROM txn)
        SELECT count(*) AS row_count, count(*) FILTER (WHERE txn_id IS NULL) AS null_keys, count(*) FILTER (WHERE t IS NULL) AS null_times,
          count(*) FILTER (WHERE amount IS NULL OR isnan(amount)) AS null_amounts, count(*) FILTER (WHERE amount < 0) AS negative_amounts,
          count(*) FILTER (WHERE label IS NULL OR label NOT IN (0, 1)) AS bad_labels,
          (SELECT count(*) FROM (SELECT txn_id FROM b GROUP BY txn_id HAVING count(*) > 1)) AS repeated_keys FROM b""",
)
def _(spark, folder):
    """The input rules over rows that break each of them."""
    rows = events(spark, folder)
    return sequence.input_guards(rows.select(*(F.expr(e).alias(c) for c, e in BROKEN_INPUT.items())))


@query("q4_history_length", f"WITH {HOURLY}, {HISTORY} SELECT txn_id, CAST(len(amounts) AS INTEGER) AS history_length FROM hist")
def _(spark, folder):
    return sequence.sequences(hourly_events(spark, folder), LENGTH).select("txn_id", "history_length")


@query(
    "q5_input_guards",
    """SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS null_keys, CAST(0 AS BIGINT) AS null_times, CAST(0 AS BIGINT) AS null_amounts,
         count(*) FILTER (WHERE value < 0) AS negative_amounts, CAST(0 AS BIGINT) AS bad_labels,
         count(*) - count(DISTINCT event_id) AS repeated_keys FROM events""",
)
def _(spark, folder):
    return sequence.input_guards(events(spark, folder))


@query(
    "q6_carry_over",
    f"""WITH {ORDERS}, {SPLIT_SQL}, {HISTORY} SELECT txn_id, CAST(len(h.amounts) AS INTEGER) AS history_length,
          {_text_sql('h.amounts')} AS amounts FROM hist h JOIN split USING (txn_id) WHERE split = 'test'""",
)
def _(spark, folder):
    from hindcast.operators.pit import with_history_of

    tagged = splits.ratio_split(orders(spark, folder))
    parts = [tagged.where(F.col("split") == s).drop("split") for s in ("train", "validation", "test")]
    made = with_history_of(
        parts[:2], parts[2], lambda df: sequence.prior_events(sequence.event_features(df), LENGTH)
    )
    return made.select("txn_id", F.size("history").alias("history_length"), _text("history", "log_amount").alias("amounts"))


@query(
    "q7_sequence_summary",
    f"""WITH {HOURLY}, {HISTORY}, s AS (SELECT txn.*, len(amounts) AS h FROM hist JOIN txn USING (txn_id))
        SELECT 'all' AS split, count(*) AS row_count, CAST(sum(label) AS BIGINT) AS positives, round(avg(CAST(label AS DOUBLE)), 6) AS positive_rate,
          {LENGTH} AS sequence_length, round(avg(CAST(h AS DOUBLE)), 6) AS mean_history, quantile_cont(CAST(h AS DOUBLE), 0.5) AS median_history,
          count(*) FILTER (WHERE h > 0) AS rows_with_history, round(avg(CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share_with_history,
          count(*) FILTER (WHERE h >= {LENGTH - 1}) AS rows_at_maximum,
          round(avg(CASE WHEN h >= {LENGTH - 1} THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share_at_maximum, min(t) AS first_time, max(t) AS last_time FROM s""",
)
def _(spark, folder):
    made = sequence.sequences(hourly_events(spark, folder), LENGTH)
    return rounded(sequence.sequence_summary(made, LENGTH, "all"))


@query("q8_dataset_guards", f"SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS wrong_length, CAST(0 AS BIGINT) AS non_finite, CAST(0 AS BIGINT) AS bad_labels, CAST(0 AS BIGINT) AS bad_history FROM events")
def _(spark, folder):
    return sequence.dataset_guards(sequence.sequences(hourly_events(spark, folder), LENGTH), length=LENGTH)


@query(
    "q8_dataset_guards_broken",
    f"""WITH {HOURLY} SELECT count(*) AS row_count, count(*) FILTER (WHERE txn_id % 19 = 0) AS wrong_length,
          count(*) FILTER (WHERE txn_id % 23 IN (1, 2)) AS non_finite, count(*) FILTER (WHERE txn_id % 29 IN (2, 3)) AS bad_labels,
          count(*) FILTER (WHERE txn_id % 31 IN (3, 4)) AS bad_history FROM txn""",
)
def _(spark, folder):
    """The dataset rules over sequences that break each of them."""
    made = sequence.sequences(hourly_events(spark, folder), LENGTH)
    at = lambda divisor, rest: F.col("txn_id") % divisor == rest
    spoiled = lambda value: F.transform("sequence", lambda e: e.withField("log_gap", F.lit(value).cast("double")))
    values = F.when(at(23, 1), spoiled(float("nan"))).when(at(23, 2), spoiled(None)).otherwise(F.col("sequence"))
    broken = made.withColumn("sequence", values).withColumn("sequence", F.when(at(19, 0), F.slice("sequence", 1, LENGTH - 1)).otherwise(F.col("sequence")))
    broken = broken.withColumn("label", F.when(at(29, 2), F.lit(None)).when(at(29, 3), F.lit(2)).otherwise(F.col("label")))
    history = F.when(at(31, 3), F.lit(-1)).when(at(31, 4), F.lit(LENGTH)).otherwise(F.col("history_length"))
    return sequence.dataset_guards(broken.withColumn("history_length", history), length=LENGTH)


def _float_text_sql(values: str) -> str:
    return _text_sql(f"list_transform({values}, lambda f: CAST(CAST(f AS FLOAT) AS DOUBLE))")


@query(
    "s10_sequence_sink",
    f"""{PADDED_SQL[: PADDED_SQL.rindex("SELECT txn_id")]} SELECT txn_id, t, label, CAST(least(len(hist.amounts), {LENGTH - 1}) AS INTEGER) AS history_length,
          {_float_text_sql('padded.amounts')} AS amounts, {_float_text_sql('padded.gaps')} AS gaps
        FROM padded JOIN hist USING (txn_id) JOIN txn USING (txn_id)""",
)
def _(spark, folder):
    """The written dataset read back: tensors of single precision, labels, ids, times and lengths."""
    path = shared_path(spark, "sequences")
    made = sequence.sequences(hourly_events(spark, folder).select("txn_id", "t", "card", "amount", "label"), LENGTH)
    sinks.write_sequences(made, path)
    amounts = F.transform("sequence", lambda e: F.struct(e[0].cast("double").alias("v")))
    gaps = F.transform("sequence", lambda e: F.struct(e[1].cast("double").alias("v")))
    back = spark.read.parquet(path)
    return back.select("txn_id", "t", "label", "history_length", _text(amounts, "v").alias("amounts"), _text(gaps, "v").alias("gaps"))


SETTINGS = encoding.EncoderSettings(("product", "email"), 10.0, 20)
CATEGORY = "coalesce(nullif(CAST({c} AS VARCHAR), ''), '__MISSING__')"


@query(
    "t1_categories",
    f"WITH {EVENTS} SELECT txn_id, {CATEGORY.format(c='email')} AS email, {CATEGORY.format(c='device')} AS device FROM txn",
)
def _(spark, folder):
    from hindcast.operators.quality import normalised_categories

    return normalised_categories(events(spark, folder).select("txn_id", "email", "device"), ["email", "device"])


def _fit_sql(source: str, columns: tuple[str, ...]) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS column, {CATEGORY.format(c=c)} AS category, label FROM {source}" for c in columns)
    return f"""overall AS (SELECT avg(CAST(label AS DOUBLE)) AS g FROM {source}), long AS ({long}),
      mapping AS (SELECT "column", category, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives,
        CASE WHEN count(*) >= 20 THEN (sum(label) + 10.0::DOUBLE * max(g)) / (count(*) + 10.0::DOUBLE) ELSE max(g) END AS encoded
        FROM long, overall GROUP BY ALL)"""


@query(
    "t2_fit_mapping",
    f"""WITH {EVENTS}, {_fit_sql('txn', ('product', 'email', 'device'))}
        SELECT "column", category, n, positives, round(encoded, 6) AS encoded FROM mapping""",
)
def _(spark, folder):
    settings = encoding.EncoderSettings(("product", "email", "device"), 10.0, 20)
    return rounded(encoding.fit(events(spark, folder), "label", settings).mapping)


@query(
    "t3_transform",
    f"""WITH {ORDERS}, {SPLIT_SQL}, train AS (SELECT * FROM split WHERE split = 'train'), {_fit_sql('train', ('product', 'email'))}
        SELECT txn_id, round(coalesce(p.encoded, g), 6) AS product_encoded, round(coalesce(e.encoded, g), 6) AS email_encoded
        FROM split CROSS JOIN overall
        LEFT JOIN mapping p ON p."column" = 'product' AND p.category = {CATEGORY.format(c='product')}
        LEFT JOIN mapping e ON e."column" = 'email' AND e.category = {CATEGORY.format(c='email')} WHERE split = 'validation'""",
)
def _(spark, folder):
    tagged = splits.ratio_split(orders(spark, folder))
    fitted = encoding.fit(tagged.where("split = 'train'"), "label", SETTINGS)
    made = fitted.transform(tagged.where("split = 'validation'"), "txn_id")
    return rounded(made.select("txn_id", "product_encoded", "email_encoded"))


def _fold_sql(c: str) -> str:
    return f"""h_{c} AS (SELECT a.fold, {CATEGORY.format(c='a.' + c)} AS category,
        count(b.txn_id) AS n, coalesce(sum(b.label), 0) AS s FROM (SELECT DISTINCT fold, {c} FROM folded) a
        LEFT JOIN folded b ON b.fold < a.fold AND {CATEGORY.format(c='b.' + c)} = {CATEGORY.format(c='a.' + c)} GROUP BY ALL)"""


def _encoded_sql(c: str) -> str:
    return f"""round(CASE WHEN f.fold = 0 THEN NULL WHEN h_{c}.n >= 20 THEN (h_{c}.s + 10.0::DOUBLE * g) / (h_{c}.n + 10.0::DOUBLE)
      ELSE g END, 6) AS {c}_encoded"""


@query(
    "t4_out_of_fold",
    f"""WITH {ORDERS}, times AS (SELECT t, ntile(5) OVER (ORDER BY t) - 1 AS fold FROM (SELECT DISTINCT t FROM txn)),
        folded AS (SELECT txn.*, fold FROM txn JOIN times USING (t)), {_fold_sql('product')}, {_fold_sql('email')},
        rates AS (SELECT a.fold, avg(CAST(b.label AS DOUBLE)) AS g FROM (SELECT DISTINCT fold FROM folded) a
          LEFT JOIN folded b ON b.fold < a.fold GROUP BY a.fold)
        SELECT f.txn_id, {_encoded_sql('product')}, {_encoded_sql('email')} FROM folded f JOIN rates USING (fold)
        JOIN h_product ON h_product.fold = f.fold AND h_product.category = {CATEGORY.format(c='f.product')}
        JOIN h_email ON h_email.fold = f.fold AND h_email.category = {CATEGORY.format(c='f.email')}""",
)
def _(spark, folder):
    made = encoding.out_of_fold(orders(spark, folder), SETTINGS, 5)
    return rounded(made.select("txn_id", "product_encoded", "email_encoded"))


@query(
    "t5_encoding_guards",
    f"""WITH {ORDERS}, {SPLIT_SQL} SELECT unnest(['product', 'email']) AS column, count(*) AS row_count, CAST(0 AS BIGINT) AS null_encodings, CAST(0 AS BIGINT) AS out_of_range
        FROM split WHERE split = 'validation'""",
)
def _(spark, folder):
    tagged = splits.ratio_split(orders(spark, folder))
    fitted = encoding.fit(tagged.where("split = 'train'"), "label", SETTINGS)
    return encoding.encoding_guards(fitted.transform(tagged.where("split = 'validation'"), "txn_id"), SETTINGS)


@query(
    "t5_encoding_guards_broken",
    f"""WITH {ORDERS}, {SPLIT_SQL}, v AS (SELECT txn_id FROM split WHERE split = 'validation')
        SELECT 'product' AS column, count(*) AS row_count, count(*) FILTER (WHERE txn_id % 13 = 0) AS null_encodings,
          count(*) FILTER (WHERE txn_id % 17 = 1 AND txn_id % 13 <> 0) AS out_of_range FROM v
        UNION ALL SELECT 'email', count(*), 0::BIGINT, count(*) FILTER (WHERE txn_id % 11 = 2) FROM v""",
)
def _(spark, folder):
    """The encoding rules over encodings that break each of them."""
    tagged = splits.ratio_split(orders(spark, folder))
    fitted = encoding.fit(tagged.where("split = 'train'"), "label", SETTINGS)
    made = fitted.transform(tagged.where("split = 'validation'"), "txn_id")
    at = lambda divisor, rest: F.col("txn_id") % divisor == rest
    made = made.withColumn("product_encoded", F.when(at(13, 0), F.lit(None)).when(at(17, 1), F.lit(1.5)).otherwise(F.col("product_encoded")))
    made = made.withColumn("email_encoded", F.when(at(11, 2), F.lit(-0.1)).otherwise(F.col("email_encoded")))
    return encoding.encoding_guards(made, SETTINGS)
