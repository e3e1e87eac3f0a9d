"""Chronological splits, folds and bins over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.operators import splits
from hindcast.plans.bindings import EVENTS, ORDERS, events, orders, rounded
from hindcast.plans.feature_queries import SPLIT_SQL
from hindcast.plans.registry import query


@query("x1_ratio_split", f"WITH {ORDERS}, {SPLIT_SQL} SELECT txn_id, split FROM split")
def _(spark, folder):
    return splits.ratio_split(orders(spark, folder)).select("txn_id", "split")


@query(
    "x1_ratio_split_snapped",
    f"""WITH {ORDERS}, {SPLIT_SQL}, cuts AS (
          SELECT max(t) FILTER (WHERE pos = CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT)) AS a,
                 max(t) FILTER (WHERE pos = CAST(floor(n * CAST(0.85 AS DOUBLE)) AS BIGINT)) AS b FROM split)
        SELECT txn_id, CASE WHEN t < a THEN 'train' WHEN t < b THEN 'validation' ELSE 'test' END AS split
        FROM split, cuts""",
)
def _(spark, folder):
    return splits.ratio_split(orders(spark, folder), snap=True).select("txn_id", "split")


@query(
    "x2_temporal_order",
    f"""WITH {ORDERS}, {SPLIT_SQL} SELECT max(t) FILTER (WHERE split = 'train') AS last_earlier,
          min(t) FILTER (WHERE split = 'validation') AS first_later,
          min(t) FILTER (WHERE split = 'validation') > max(t) FILTER (WHERE split = 'train') AS in_order FROM split""",
)
def _(spark, folder):
    tagged = splits.ratio_split(orders(spark, folder))
    return splits.temporal_order(
        tagged.where(F.col("split") == "train"), tagged.where(F.col("split") == "validation"), "t"
    )


@query(
    "x3_tie_safe_split",
    f"""WITH {ORDERS}, ranked AS (SELECT *, row_number() OVER (ORDER BY t, txn_id) - 1 AS pos,
          count(*) OVER () AS n FROM txn),
        cut AS (SELECT t AS boundary FROM ranked WHERE pos = least(greatest(CAST(floor(n * 0.5) AS BIGINT), 1), n - 1))
        SELECT txn_id, CASE WHEN t < boundary THEN 'fit' ELSE 'select' END AS period FROM txn, cut""",
)
def _(spark, folder):
    return splits.fraction_split(orders(spark, folder), "t", 0.5).select("txn_id", "period")


@query(
    "x4_array_split_folds",
    f"""WITH {ORDERS}, times AS (SELECT t, CAST(ntile(5) OVER (ORDER BY t) - 1 AS INTEGER) AS fold
          FROM (SELECT DISTINCT t FROM txn))
        SELECT txn_id, fold FROM txn JOIN times USING (t)""",
)
def _(spark, folder):
    return splits.array_split_folds(orders(spark, folder), "t", 5).select("txn_id", "fold")


@query(
    "x5_proportional_folds",
    f"""WITH {ORDERS}, times AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS p, count(*) OVER () AS m
          FROM (SELECT DISTINCT t FROM txn))
        SELECT txn_id, CAST((p * 5) // m AS INTEGER) AS fold FROM txn JOIN times USING (t)""",
)
def _(spark, folder):
    return splits.proportional_folds(orders(spark, folder), "t", 5).select("txn_id", "fold")


@query(
    "x6_quantile_bins",
    f"""WITH {ORDERS}, edges AS (SELECT list_sort(list_distinct(
          quantile_cont(CAST(t AS DOUBLE), [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]))) AS inner_edges,
          CAST(min(t) AS DOUBLE) AS lo, CAST(max(t) AS DOUBLE) AS hi FROM txn)
        SELECT txn_id, CAST(len(list_filter(inner_edges, lambda e: e < t AND e > lo AND e < hi)) AS INTEGER) AS bin
        FROM txn, edges""",
)
def _(spark, folder):
    return splits.quantile_bins(orders(spark, folder), "t", 10).select("txn_id", "bin")


@query(
    "x7_rank_deciles",
    f"""WITH {EVENTS}, ranked AS (SELECT txn_id, row_number() OVER (ORDER BY score, txn_id) - 1 AS r,
          count(*) OVER () AS n FROM txn)
        SELECT txn_id, 1 + CAST(len(list_filter([1,2,3,4,5,6,7,8,9], lambda k: 10 * r > (n - 1) * k)) AS INTEGER)
          AS decile FROM ranked""",
)
def _(spark, folder):
    return splits.rank_deciles(events(spark, folder), F.col("score"), "txn_id").select("txn_id", "decile")


@query(
    "x9_early_stop_tail",
    f"""WITH {ORDERS}, ranked AS (SELECT *, row_number() OVER (ORDER BY t, txn_id) - 1 AS pos,
          count(*) OVER () AS n FROM txn)
        SELECT txn_id, CASE WHEN pos < CAST(floor(n * CAST(1.0 - 0.1 AS DOUBLE)) AS BIGINT) THEN 'fit'
          ELSE 'early_stop' END AS part FROM ranked""",
)
def _(spark, folder):
    return splits.tail_split(orders(spark, folder), 0.1).select("txn_id", "part")


@query(
    "d14_split_summary",
    f"""WITH {ORDERS}, {SPLIT_SQL} SELECT split, count(*) AS row_count, min(t) AS first_time, max(t) AS last_time,
          CAST(sum(label) AS BIGINT) AS positives, round(count(*) / max(n), 6) AS share,
          round(avg(CAST(label AS DOUBLE)), 6) AS positive_rate FROM split GROUP BY split""",
)
def _(spark, folder):
    return rounded(splits.split_summary(splits.ratio_split(orders(spark, folder))))
