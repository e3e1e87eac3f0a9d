"""Data-quality and exploratory aggregates over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.operators import contract, pit, quality, splits
from hindcast.plans.bindings import EVENTS, HOUR, ORDERS, events, orders, rounded, table, tail_sql
from hindcast.plans.feature_queries import SPLIT_SQL, _frame
from hindcast.plans.registry import query
from hindcast.roles import EntityFeatures
from hindcast.session import shared_path
from hindcast.sources import files

COLUMNS = ["txn_id", "t", "card", "amount", "product", "device", "email", "label", "score"]


#: Another order than that of the keys, in both engines.
SHUFFLED = "(txn_id * 7919) % 10007"


def _null(c: str) -> str:
    return f"avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


@query(
    "d1_duplicates",
    """SELECT 'l_orderkey' AS column, CAST(sum(n) AS BIGINT) AS duplicate_count,
         (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT CAST(l_orderkey AS VARCHAR) AS k FROM lineitem GROUP BY l_orderkey
            HAVING count(*) > 1 ORDER BY l_orderkey LIMIT 10)) AS sample_duplicates
       FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)""",
)
def _(spark, folder):
    found = quality.duplicates(table(spark, folder, "lineitem"), "l_orderkey")
    return found.withColumn("sample_duplicates", F.array_join("sample_duplicates", ","))


@query(
    "d2_time_order",
    f"""WITH {ORDERS}, d AS (SELECT txn_id, t, lag(t) OVER (ORDER BY txn_id) AS p FROM txn), v AS (SELECT * FROM d WHERE t < p)
        SELECT 't' AS column, count(*) = 0 AS is_monotonic, count(*) AS violation_count,
          (SELECT string_agg(CAST(t AS VARCHAR), ',' ORDER BY txn_id) FROM (SELECT * FROM v ORDER BY txn_id LIMIT 10)) AS sample_violations
        FROM v""",
)
def _(spark, folder):
    found = quality.monotonic_check(orders(spark, folder), "txn_id", "t")
    return found.withColumn("sample_violations", F.array_join("sample_violations", ","))


@query(
    "d2_stored_order",
    f"""WITH {ORDERS}, d AS (SELECT txn_id, t, {SHUFFLED} AS place FROM txn),
        l AS (SELECT t, row_number() OVER w AS position, lag(t) OVER w AS p FROM d WINDOW w AS (ORDER BY place, txn_id)), v AS (SELECT * FROM l WHERE t < p)
        SELECT 't' AS column, count(*) = 0 AS is_monotonic, count(*) AS violation_count,
          (SELECT string_agg(CAST(t AS VARCHAR), ',' ORDER BY position) FROM (SELECT * FROM v ORDER BY position LIMIT 10)) AS sample_violations
        FROM v""",
)
def _(spark, folder):
    """No column says how the rows are stored: files and rows within them do."""
    path = shared_path(spark, "stored")
    rows = orders(spark, folder).select("txn_id", "t").withColumn("place", F.expr(SHUFFLED))
    rows.repartitionByRange(8, "place", "txn_id").sortWithinPartitions("place", "txn_id").drop("place").write.parquet(path)
    found = quality.monotonic_check(files.stored_rows(spark, path), "stored_order", "t")
    return found.withColumn("sample_violations", F.array_join("sample_violations", ","))


@query(
    "d3_null_rates",
    f"""WITH {EVENTS} {' UNION ALL '.join(f"SELECT '{c}' AS column, round({_null(c)}, 6) AS null_rate, {_null(c)} > 0.1 AS above_threshold FROM txn" for c in COLUMNS)}""",
)
def _(spark, folder):
    return rounded(quality.null_rates(events(spark, folder), COLUMNS, 0.1))


@query(
    "d4_value_ranges",
    f"""WITH {ORDERS} SELECT 'time_negative' AS check, count(*) FILTER (WHERE t < 0) AS violations FROM txn
        UNION ALL SELECT 'amount_non_positive', count(*) FILTER (WHERE amount <= 0) FROM txn
        UNION ALL SELECT 'label_invalid', count(*) FILTER (WHERE label NOT IN (0, 1)) FROM txn""",
)
def _(spark, folder):
    return quality.range_violations(orders(spark, folder))


RULES = [
    quality.ColumnRule("txn_id", "bigint", nullable=False, unique=True),
    quality.ColumnRule("t", "bigint", nullable=False, at_least=0),
    quality.ColumnRule("amount", "double", nullable=False, above=0.05),
    quality.ColumnRule("label", "int", nullable=False, allowed=(0, 1)),
    quality.ColumnRule("product", "double"),
    quality.ColumnRule("device", "double", nullable=False),
]

SCHEMA_SQL = """SELECT 'txn_id' AS column, 'type' AS rule, 0 AS violations UNION ALL SELECT 'txn_id', 'not_null', 0
  UNION ALL SELECT 'txn_id', 'unique', count(*) - count(DISTINCT txn_id) FROM txn
  UNION ALL SELECT 't', 'type', 0 UNION ALL SELECT 't', 'not_null', count(*) - count(t) FROM txn
  UNION ALL SELECT 't', 'at_least', count(*) FILTER (WHERE t < 0) FROM txn
  UNION ALL SELECT 'amount', 'type', 0 UNION ALL SELECT 'amount', 'not_null', count(*) - count(amount) FROM txn
  UNION ALL SELECT 'amount', 'above', count(*) FILTER (WHERE amount <= 0.05) FROM txn
  UNION ALL SELECT 'label', 'type', 0 UNION ALL SELECT 'label', 'not_null', 0
  UNION ALL SELECT 'label', 'allowed', count(*) FILTER (WHERE label NOT IN (0, 1)) FROM txn
  UNION ALL SELECT 'product', 'type', count(*) FILTER (WHERE try_cast(product AS DOUBLE) IS NULL) FROM txn
  UNION ALL SELECT 'device', 'type', 0 UNION ALL SELECT 'device', 'not_null', count(*) - count(device) FROM txn"""


@query("d5_declared_schema", f"WITH {EVENTS} {SCHEMA_SQL}")
def _(spark, folder):
    return quality.schema_violations(events(spark, folder), RULES)


@query(
    "d6_quality_report",
    f"""WITH {EVENTS}, schema_rows AS ({SCHEMA_SQL}), out AS (
        SELECT 'schema' AS check, "column" || ':' || rule AS subject, CAST(violations AS DOUBLE) AS value, violations = 0 AS passed FROM schema_rows
        UNION ALL SELECT 'duplicates', 'txn_id', CAST(count(*) - count(DISTINCT txn_id) AS DOUBLE), count(*) = count(DISTINCT txn_id) FROM txn
        UNION ALL SELECT 'time_order', 't', CAST(count(*) FILTER (WHERE t < p) AS DOUBLE), true
          FROM (SELECT t, lag(t) OVER (ORDER BY txn_id) AS p FROM txn)
        UNION ALL {' UNION ALL '.join(f"SELECT 'null_rate', '{c}', round({_null(c)}, 6), true FROM txn" for c in COLUMNS)}
        UNION ALL SELECT 'range', 'time_negative', CAST(count(*) FILTER (WHERE t < 0) AS DOUBLE), count(*) FILTER (WHERE t < 0) = 0 FROM txn
        UNION ALL SELECT 'range', 'amount_non_positive', CAST(count(*) FILTER (WHERE amount <= 0) AS DOUBLE), count(*) FILTER (WHERE amount <= 0) = 0 FROM txn
        UNION ALL SELECT 'range', 'label_invalid', CAST(count(*) FILTER (WHERE label NOT IN (0,1)) AS DOUBLE), count(*) FILTER (WHERE label NOT IN (0,1)) = 0 FROM txn)
        SELECT * FROM out""",
)
def _(spark, folder):
    return rounded(quality.quality_report(events(spark, folder), RULES))


@query(
    "d7_stratified_null_rates",
    f"""WITH {EVENTS}, s AS (SELECT *, 'overall' AS stratum FROM txn UNION ALL SELECT *, 'group_' || label FROM txn)
        {' UNION ALL '.join(f"SELECT stratum, '{c}' AS column, round({_null(c)}, 6) AS null_rate FROM s GROUP BY stratum" for c in ("device", "email", "amount"))}""",
)
def _(spark, folder):
    return rounded(quality.stratified_null_rates(events(spark, folder), "label", ["device", "email", "amount"]))


def _sparse_events(spark, folder):
    """Events with missing values that depend on the label."""
    rows = events(spark, folder)
    return rows.withColumn(
        "channel", F.when(F.col("device") + 7 * F.col("label") < 60, F.col("product"))
    ).withColumn("depth", F.when(F.col("card") % 3 != 0, F.col("card")))


SPARSE = f"""{EVENTS}, sparse AS (SELECT *, CASE WHEN device + 7 * label < 60 THEN product END AS channel,
  CASE WHEN card % 3 <> 0 THEN card END AS depth FROM txn)"""


def _cells(c: str) -> str:
    return f"""SELECT '{c}' AS column, CAST(count(*) FILTER (WHERE label = 0 AND {c} IS NOT NULL) AS DOUBLE) AS a,
      CAST(count(*) FILTER (WHERE label = 1 AND {c} IS NOT NULL) AS DOUBLE) AS b,
      CAST(count(*) FILTER (WHERE label = 0 AND {c} IS NULL) AS DOUBLE) AS c,
      CAST(count(*) FILTER (WHERE label = 1 AND {c} IS NULL) AS DOUBLE) AS d FROM sparse"""


@query(
    "d8_differential_missingness",
    f"""WITH {SPARSE}, cells AS ({' UNION ALL '.join(_cells(c) for c in ('channel', 'depth', 'device', 'email', 'amount'))})
        SELECT "column", round((a+b+c+d) * power(greatest(abs(a*d - b*c) - (a+b+c+d)/2, 0), 2) / ((a+b)*(c+d)*(a+c)*(b+d)), 6) AS chi2_statistic,
          1 AS dof, round(c/(a+c), 6) AS missing_rate_group_0, round(d/(b+d), 6) AS missing_rate_group_1,
          round(abs(c/(a+c) - d/(b+d)), 6) AS difference FROM cells WHERE least(a, b, c, d) >= 5""",
)
def _(spark, folder):
    made = quality.differential_missingness(
        _sparse_events(spark, folder), "label", ["channel", "depth", "device", "email", "amount"]
    )
    return rounded(made.drop("p_value", "significant"))


@query(
    "d8_differential_missingness_p_values",
    f"""WITH {SPARSE}, cells AS ({' UNION ALL '.join(_cells(c) for c in ('channel', 'depth', 'device', 'email'))}),
        x AS (SELECT "column", (a+b+c+d) * power(greatest(abs(a*d - b*c) - (a+b+c+d)/2, 0), 2) / ((a+b)*(c+d)*(a+c)*(b+d)) AS chi2
          FROM cells WHERE least(a, b, c, d) >= 5), p AS (SELECT *, {tail_sql('sqrt(chi2 / 2)')} AS p FROM x)
        SELECT "column", round(chi2, 10) AS chi2_statistic, round(p, 10) AS p_value, p < 0.05 AS significant FROM p""",
)
def _(spark, folder):
    made = quality.differential_missingness(_sparse_events(spark, folder), "label", ["channel", "depth", "device", "email"])
    return rounded(made.select("column", "chi2_statistic", "p_value", "significant"), 10)


def _trend_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column, time_bin, {_null(c)} AS null_rate, (SELECT {_null(c)} FROM sparse) AS overall FROM binned GROUP BY time_bin"""


@query(
    "d9_temporal_missingness",
    f"""WITH {SPARSE}, edges AS (SELECT quantile_cont(CAST(t AS DOUBLE), [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM txn),
        binned AS (SELECT s.*, CAST(len(list_filter(e, lambda x: x < t)) AS INTEGER) AS time_bin FROM sparse s, edges),
        r AS ({' UNION ALL '.join(_trend_sql(c) for c in ('channel', 'depth', 'device', 'email'))})
        SELECT "column", time_bin, round(null_rate, 6) AS null_rate, round(overall, 6) AS overall_null_rate,
          CASE WHEN last_value(null_rate) OVER w > first_value(null_rate) OVER w THEN 'increasing'
               WHEN last_value(null_rate) OVER w < first_value(null_rate) OVER w THEN 'decreasing' ELSE 'stable' END AS trend
        FROM r WINDOW w AS (PARTITION BY "column" ORDER BY time_bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def _(spark, folder):
    return rounded(
        quality.temporal_missingness(_sparse_events(spark, folder), "t", [*COLUMNS, "channel", "depth"])
    )


@query(
    "d10_amount_distribution",
    f"""WITH {ORDERS}, s AS (SELECT amount, 'overall' AS scope FROM txn UNION ALL SELECT amount, CAST(label AS VARCHAR) FROM txn)
        SELECT scope, round(avg(amount), 6) AS mean, round(stddev_samp(amount), 6) AS std, min(amount) AS min, max(amount) AS max,
          count(*) AS count, round(quantile_cont(amount, 0.25), 6) AS q25, round(quantile_cont(amount, 0.5), 6) AS median,
          round(quantile_cont(amount, 0.75), 6) AS q75 FROM s GROUP BY scope""",
)
def _(spark, folder):
    return rounded(quality.amount_distribution(orders(spark, folder)))


@query(
    "d11_rates_by_clock",
    f"""WITH {EVENTS}, c AS (SELECT 'hour' AS unit, CAST((t // 1000000 // 3600) % 24 AS BIGINT) AS value, label FROM txn
          UNION ALL SELECT 'day_of_week', CAST((t // 1000000 // 86400) % 7 AS BIGINT), label FROM txn)
        SELECT unit, value, round(avg(CAST(label AS DOUBLE)), 6) AS positive_rate, count(*) AS row_count FROM c GROUP BY unit, value""",
)
def _(spark, folder):
    return rounded(quality.rates_by_clock(events(spark, folder), F.floor(F.col("t") / 1000000), "label"))


CATEGORY_STATS = """SELECT 'product' AS column, CAST(product AS VARCHAR) AS category, label FROM txn
  UNION ALL SELECT 'device', CAST(device AS VARCHAR), label FROM txn"""


@query(
    "d12_category_rates",
    f"""WITH {EVENTS}, l AS ({CATEGORY_STATS}), g AS (SELECT "column", category, count(*) AS row_count,
          CAST(sum(label) AS BIGINT) AS positives, sum(label) / CAST(count(*) AS DOUBLE) AS rate FROM l GROUP BY ALL),
        u AS (SELECT "column", count(category) AS unique_categories,
          CAST(coalesce(sum(row_count) FILTER (WHERE category IS NULL), 0) AS BIGINT) AS null_count FROM g GROUP BY "column"),
        r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY rate DESC, category) AS rank FROM g WHERE category IS NOT NULL)
        SELECT "column", category, row_count, positives, round(rate, 6) AS positive_rate, CAST(rank AS INTEGER) AS rank,
          unique_categories, null_count FROM r JOIN u USING ("column") WHERE rank <= 20""",
)
def _(spark, folder):
    return rounded(quality.category_rates(events(spark, folder), ["product", "device"], "label"))


@query(
    "d13_high_cardinality",
    f"""WITH {EVENTS}, l AS ({CATEGORY_STATS}), g AS (SELECT "column", category, count(*) AS row_count,
          sum(label) / CAST(count(*) AS DOUBLE) AS rate FROM l WHERE category IS NOT NULL GROUP BY ALL),
        a AS (SELECT 'frequency' AS ranking, *, row_number() OVER (PARTITION BY "column" ORDER BY row_count DESC, category) AS rank FROM g),
        b AS (SELECT 'positive_rate' AS ranking, *, row_number() OVER (PARTITION BY "column" ORDER BY rate DESC, category) AS rank FROM g WHERE row_count >= 100)
        SELECT ranking, "column", category, CAST(rank AS INTEGER) AS rank, row_count, round(rate, 6) AS positive_rate
        FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE rank <= 10""",
)
def _(spark, folder):
    return rounded(quality.high_cardinality_profile(events(spark, folder), ["product", "device"], "label"))


@query(
    "d15_modelling_summary",
    f"""WITH {ORDERS}, {SPLIT_SQL} SELECT split, count(*) AS row_count, CAST(sum(label) AS BIGINT) AS positives,
          round(avg(CAST(label AS DOUBLE)), 6) AS positive_rate, 5 AS feature_count, 2 AS categorical_count,
          3 AS numeric_count, 4 AS excluded_count FROM split WHERE split <> 'test' GROUP BY split""",
)
def _(spark, folder):
    tagged = splits.ratio_split(orders(spark, folder), snap=False)
    train = tagged.where("split = 'train'").drop("split")
    later = tagged.where("split = 'validation'").drop("split")
    rules = contract.ContractRules(("txn_id", "t", "label"), ("score",))
    chosen = contract.exclusions(train, rules).where("reason IS NULL")
    features = sorted(r["column"] for r in chosen.select("column").collect())
    return rounded(quality.modelling_summary(train, later, features, "label"))


@query(
    "d16_feature_summary",
    f"""WITH {EVENTS}, w AS (SELECT CASE WHEN device IS NOT NULL THEN count(*) {_frame('device', None)} END AS history_device_count,
          CASE WHEN email IS NOT NULL THEN count(*) {_frame('email', None)} END AS history_email_count,
          count(*) {_frame('card', 24 * HOUR)} AS velocity_card_24h FROM txn),
        m AS (SELECT count(*) FILTER (WHERE history_device_count IS NULL OR history_email_count IS NULL) AS missing FROM w)
        {' UNION ALL '.join(f"SELECT '{f}' AS feature, round({_null(f)}, 6) AS null_rate, round(avg(CAST({f} AS DOUBLE)), 6) AS mean, (SELECT missing FROM m) AS rows_with_missing FROM w"
                            for f in ('history_device_count', 'history_email_count', 'velocity_card_24h'))}""",
)
def _(spark, folder):
    made = pit.behavioural_features(
        events(spark, folder),
        [
            EntityFeatures("device", ("device",), history=True),
            EntityFeatures("email", ("email",), history=True),
            EntityFeatures("card", ("card",), velocity={"24h": 24 * HOUR}),
        ],
    )
    return rounded(quality.feature_summary(made, ["history_device_count", "history_email_count", "velocity_card_24h"]))


@query(
    "d17_score_histogram",
    f"""WITH {EVENTS}, r AS (SELECT label, min(score) AS low, max(score) AS high, count(score) AS n FROM txn GROUP BY label),
        b AS (SELECT label, CAST(least(floor((score - low) / (high - low) * 50), 49) AS INTEGER) AS bin, count(*) AS c
              FROM txn JOIN r USING (label) GROUP BY ALL),
        f AS (SELECT r.*, CAST(unnest(range(50)) AS INTEGER) AS bin FROM r)
        SELECT f.label, f.bin, round(low + f.bin * ((high - low) / 50), 6) AS bin_start, coalesce(c, 0) AS bin_count,
          round(coalesce(c, 0) / (n * ((high - low) / 50)), 6) AS density
        FROM f LEFT JOIN b ON f.label = b.label AND f.bin = b.bin""",
)
def _(spark, folder):
    return rounded(quality.score_histogram(events(spark, folder), "score", "label"))
