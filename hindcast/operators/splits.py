"""Chronological splits, folds and bins.

Boundaries are found exactly with ``order_statistics`` and then compared row by row, so tagging a
table is a map-only step with no sort and no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.operators.ordered import order_statistics, quantiles, rows_at, sorts_before
from hindcast.roles import Roles


def ratio_split(
    rows: DataFrame,
    roles: Roles = Roles(),
    ratios: tuple[float, ...] = (0.70, 0.15, 0.15),
    names: tuple[str, ...] = ("train", "validation", "test"),
    snap: bool = False,
    column: str = "split",
) -> DataFrame:
    """Tag rows by position in (time, key) order; ``snap`` moves each cut to the start of its timestamp."""
    if abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError(f"ratios must sum to 1, got {ratios}")
    n = rows.count()
    shares = [round(sum(ratios[: i + 1]), 10) for i in range(len(ratios) - 1)]
    cuts = [int(n * share) for share in shares]
    inside = [c for c in cuts if c < n]
    found = dict(zip(inside, rows_at(rows, F.col(roles.time), roles.key, inside))) if inside else {}
    tag = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names))):
        if cut >= n:
            tag = F.lit(name)
            continue
        time, key = F.col(roles.time), F.col(roles.key)
        earlier = time < F.lit(found[cut][0]) if snap else sorts_before(time, key, found[cut])
        tag = F.when(earlier, F.lit(name)).otherwise(tag)
    return rows.withColumn(column, tag)


def temporal_order(earlier: DataFrame, later: DataFrame, time: str) -> DataFrame:
    """One row: the last earlier time, the first later time, and whether they are in strict order."""
    last = earlier.agg(F.max(time).alias("last_earlier"))
    return last.select(
        "last_earlier", later.agg(F.min(time)).scalar().alias("first_later")
    ).withColumn("in_order", F.col("first_later") > F.col("last_earlier"))


def require_temporal_order(earlier: DataFrame, later: DataFrame, time: str) -> None:
    facts = temporal_order(earlier, later, time).first()
    if not facts["in_order"]:
        raise ValueError(
            f"the later split starts at {facts['first_later']}, not strictly after {facts['last_earlier']}"
        )


def tie_safe_boundary(
    rows: DataFrame, time: str, fraction: float, fall_back: bool = False
):
    """The timestamp at row floor(n * fraction); rows before it fit, the others select.

    With ``fall_back`` a boundary that would leave the first part empty moves to the second distinct
    timestamp; otherwise that is an error.
    """
    if not 0.0 < fraction < 1.0:
        raise ValueError("fraction must lie strictly between 0 and 1")
    n = rows.count()
    if n < 2:
        raise ValueError("at least two rows are needed for a chronological split")
    position = min(max(math.floor(n * fraction), 1), n - 1)
    value, below = order_statistics(rows, {"t": (F.col(time), [position])})["t"][position]
    if below > 0:
        return value
    second = rows.where(F.col(time) > F.lit(value)).agg(F.min(time)).first()[0]
    if not fall_back or second is None:
        raise ValueError("no boundary leaves both periods non-empty")
    return second


def fraction_split(
    rows: DataFrame, time: str, fraction: float, fall_back: bool = False, column: str = "period"
) -> DataFrame:
    boundary = tie_safe_boundary(rows, time, fraction, fall_back)
    early = F.col(time) < F.lit(boundary)
    return rows.withColumn(column, F.when(early, F.lit("fit")).otherwise(F.lit("select")))


def _fold_tag(rows: DataFrame, time: str, starts: list[int], column: str) -> DataFrame:
    distinct = rows.select(time).distinct()
    wanted = sorted(set(starts))
    found = order_statistics(distinct, {"t": (F.col(time), wanted)})["t"] if wanted else {}
    fold: Column = F.lit(0)
    for start in starts:
        fold = fold + (F.col(time) >= F.lit(found[start][0])).cast("int")
    return rows.withColumn(column, fold)


def array_split_folds(rows: DataFrame, time: str, k: int, column: str = "fold") -> DataFrame:
    """k contiguous folds over distinct timestamps, the larger folds first."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    m = rows.select(time).distinct().count()
    k = min(k, m)
    size, extra = divmod(m, k)
    starts = [f * size + min(f, extra) for f in range(1, k)]
    return _fold_tag(rows, time, starts, column)


def proportional_folds(rows: DataFrame, time: str, k: int, column: str = "fold") -> DataFrame:
    """Fold floor(position * k / m) over the m distinct timestamps."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    m = rows.select(time).distinct().count()
    if m < k:
        raise ValueError(f"{m} distinct timestamps cannot fill {k} folds")
    starts = [-(-f * m // k) for f in range(1, k)]
    return _fold_tag(rows, time, starts, column)


def quantile_edges(rows: DataFrame, value: str, bins: int) -> list[float]:
    """Linear-interpolated quantile edges with duplicates merged."""
    shares = [i / bins for i in range(bins + 1)]
    return sorted(set(quantiles(rows, {value: F.col(value)}, shares)[value]))


def right_closed_bin(value: Column, edges: list[float]) -> Column:
    """Index of the bin (edge[i], edge[i+1]] that holds the value; the first bin is closed."""
    inner = edges[1:-1]
    index: Column = F.lit(0)
    for edge in inner:
        index = index + (value > F.lit(edge)).cast("int")
    return F.when(value.isNotNull(), index)


def quantile_bins(rows: DataFrame, value: str, bins: int, column: str = "bin") -> DataFrame:
    return rows.withColumn(column, right_closed_bin(F.col(value), quantile_edges(rows, value, bins)))


def rank_deciles(
    rows: DataFrame, order: Column, key: str, column: str = "decile", groups: int = 10
) -> DataFrame:
    """Deciles of the position in (order, key) order, by exact integer comparison.

    A row at 0-based position r lies in decile 1 + #{k in 1..9 : 10 r > (n - 1) k}.
    """
    n = rows.count()
    starts = [(n - 1) * k // groups + 1 for k in range(1, groups)]
    inside = [s for s in starts if s < n]
    boundaries = rows_at(rows, order, key, inside) if inside else []
    decile: Column = F.lit(1)
    for boundary in boundaries:
        decile = decile + (~sorts_before(order, F.col(key), boundary)).cast("int")
    return rows.withColumn(column, decile)


def tail_split(
    rows: DataFrame, fraction: float, roles: Roles = Roles(), column: str = "part"
) -> DataFrame:
    """The last ``fraction`` of the rows by (time, key) position stops training early, the rest fits."""
    n = rows.count()
    cut = int(n * (1.0 - fraction))
    if not 0 < cut < n:
        raise ValueError("the early-stopping tail must leave both parts non-empty")
    (boundary,) = rows_at(rows, F.col(roles.time), roles.key, [cut])
    fits = sorts_before(F.col(roles.time), F.col(roles.key), boundary)
    return rows.withColumn(column, F.when(fits, F.lit("fit")).otherwise(F.lit("early_stop")))


def split_summary(rows: DataFrame, roles: Roles = Roles(), split: str = "split") -> DataFrame:
    """Rows, share, time range and positive rate per split."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    return (
        rows.groupBy(split)
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min(roles.time).alias("first_time"),
            F.max(roles.time).alias("last_time"),
            F.sum(F.col(roles.label).cast("long")).alias("positives"),
        )
        .withColumn("share", F.col("row_count") / total)
        .withColumn("positive_rate", F.col("positives") / F.col("row_count"))
    )
