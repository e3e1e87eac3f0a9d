"""Isotonic regression whose pools, fit and lookup are tables: no task or driver meets all scores.

Adjacent pools whose means fall are merged, in any order: the end result is the same. So score ranges are pooled each by
itself, and again with ranges shifted by half their width, until no two neighbours fall across a border either.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators.ordered import order_edges, with_chunk
from hindcast.session import written

#: Pools or scores that one task sorts at once, about.
ROWS_PER_TASK = 200_000

_POOL = "chunk int, lo double, hi double, total double, weight double"


def _merge_falling(part: pd.DataFrame) -> pd.DataFrame:
    """The pools of one range in order, merged until their means rise."""
    part = part.sort_values("lo")
    done: list[list[float]] = []
    for lo, hi, total, weight in zip(part["lo"], part["hi"], part["total"], part["weight"], strict=True):
        while done and done[-1][2] * weight >= total * done[-1][3]:
            lo, _, before, heft = done.pop()
            total, weight = total + before, weight + heft
        done.append([lo, hi, total, weight])
    made = pd.DataFrame(done, columns=["lo", "hi", "total", "weight"])
    made.insert(0, "chunk", part["chunk"].iloc[0])
    return made


def _borders(pools: DataFrame) -> DataFrame:
    """chunk, next_lo, next_value, falls: the first pool after each range. A row for each range only."""
    ends = pools.groupBy("chunk").agg(F.min(F.struct("lo", "total", "weight")).alias("a"), F.max(F.struct("lo", "total", "weight")).alias("z"))
    after = F.lead("a").over(Window.orderBy("chunk"))
    falls = F.coalesce(F.col("z.total") * F.col("after.weight") > F.col("after.total") * F.col("z.weight"), F.lit(False))
    return ends.withColumn("after", after).select(
        "chunk", F.col("after.lo").alias("next_lo"), (F.col("after.total") / F.col("after.weight")).alias("next_value"), falls.alias("falls")
    )


def fit_isotonic(points: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """lo, hi, value, next_lo, next_value: the pools of distinct scores ``p`` with label ``total`` and ``weight``.

    The last pool has no next one. Two turns without a merger never follow each other while a border falls, so the rounds
    end; few are needed unless a pool grows over many ranges.
    """
    pools = written(points.select(F.col("p").cast("double").alias("lo"), F.col("p").cast("double").alias("hi"), F.col("total").cast("double"), F.col("weight").cast("double")))
    turn = 0
    while True:
        chunks = math.ceil(pools.count() / rows_per_task)
        edges = order_edges(pools, "lo", 2 * chunks)[turn % 2 :: 2] if chunks > 1 else ()
        ranged = with_chunk(pools.select("lo", "hi", "total", "weight"), "lo", edges, "chunk")
        pools = written(ranged.groupBy("chunk").applyInPandas(_merge_falling, _POOL))
        borders = written(_borders(pools))
        if borders.where("falls").isEmpty():
            break
        turn += 1
    within = Window.partitionBy("chunk").orderBy("lo")
    value = F.col("total") / F.col("weight")
    own = pools.select("chunk", "lo", "hi", value.alias("value"), F.lead("lo").over(within).alias("own_lo"), F.lead(value).over(within).alias("own_value"))
    return written(
        own.join(borders, "chunk").select(
            "lo", "hi", "value", F.coalesce("own_lo", "next_lo").alias("next_lo"), F.coalesce("own_value", "next_value").alias("next_value")
        )
    )


def _between(x: Column) -> Column:
    """The fit at x of the pool in ``state``: level within the pool, a straight line to the next one."""
    share = (x - F.col("state.hi")) / (F.col("state.next_lo") - F.col("state.hi"))
    line = F.col("state.value") + (F.col("state.next_value") - F.col("state.value")) * share
    return F.when((x <= F.col("state.hi")) | F.col("state.next_lo").isNull(), F.col("state.value")).otherwise(line)


def predict_isotonic(rows: DataFrame, score: Column, model: DataFrame, column: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The rows with the fit at their score, clipped outside of the fitted range; null for a null score.

    Distinct scores are looked up, so a frequent one is a single row there, and joined back.
    """
    scores = rows.select(score.cast("double").alias("x")).where("x IS NOT NULL").distinct()
    pools = model.select(F.col("lo").alias("x"), F.struct(*model.columns).alias("state"))
    marked = written(scores.withColumn("asked", F.lit(True)).unionByName(pools.withColumn("asked", F.lit(False)), allowMissingColumns=True))
    edges = order_edges(marked, "x", math.ceil(marked.count() / rows_per_task))
    ranged = with_chunk(marked, "x", edges, "chunk")
    # One row for each range reaches the window without a partition.
    last = ranged.groupBy("chunk").agg(F.max_by("state", F.when(~F.col("asked"), F.col("x"))).alias("last"))
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("chunk", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    so_far = Window.partitionBy("chunk").orderBy("x", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ranged.withColumn("own", F.last("state", ignorenulls=True).over(so_far)).where("asked").select("chunk", "x", "own")
    found = found.join(carried, "chunk").select("x", F.coalesce("own", "carried").alias("state"))
    lowest = model.agg(F.min_by("value", "lo")).scalar()
    fits = written(found.select(F.col("x").alias("_x"), F.coalesce(_between(F.col("x")), lowest).alias("_fit")))
    return rows.join(fits, score.cast("double") == F.col("_x"), "left").withColumn(column, F.col("_fit")).drop("_x", "_fit")
