"""Positive rates of two groups compared, many comparisons in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.pvalues import two_sided_normal
from hindcast.functions.scalars import ratio, two_proportion_z, wilson_bounds
from hindcast.operators.ordered import quantiles


def compare_groups(
    rows: DataFrame, label: str, comparisons: dict[str, tuple[Column, Column]], significance: float = 0.05
) -> DataFrame:
    """For every named pair of row conditions: counts, rates, intervals, difference, risk, z and p.

    A condition that is NULL for a row keeps that row out of the group.
    """
    y = F.col(label)
    packed = []
    for name, (in_a, in_b) in comparisons.items():
        packed.append(
            F.struct(
                F.count_if(in_a).alias("n_a"),
                F.count_if(in_a & (y == 1)).alias("hits_a"),
                F.count_if(in_b).alias("n_b"),
                F.count_if(in_b & (y == 1)).alias("hits_b"),
            ).alias(name)
        )
    long = rows.agg(*packed).unpivot([], list(comparisons), "comparison", "c")
    n_a, hits_a, n_b, hits_b = (F.col(f"c.{x}") for x in ("n_a", "hits_a", "n_b", "hits_b"))
    low_a, high_a = wilson_bounds(hits_a, n_a)
    low_b, high_b = wilson_bounds(hits_b, n_b)
    rate_a, rate_b = ratio(hits_a, n_a), ratio(hits_b, n_b)
    tested = long.select(
        "comparison",
        n_a.alias("group_a_rows"),
        hits_a.alias("group_a_positives"),
        rate_a.alias("group_a_rate"),
        low_a.alias("group_a_ci_lower"),
        high_a.alias("group_a_ci_upper"),
        n_b.alias("group_b_rows"),
        hits_b.alias("group_b_positives"),
        rate_b.alias("group_b_rate"),
        low_b.alias("group_b_ci_lower"),
        high_b.alias("group_b_ci_upper"),
        (rate_a - rate_b).alias("rate_difference"),
        ratio(rate_a, rate_b).alias("relative_risk"),
        two_proportion_z(hits_a, n_a, hits_b, n_b).alias("z_statistic"),
    )
    tested = tested.withColumn("p_value", two_sided_normal("z_statistic"))
    return tested.withColumn("significant", F.coalesce(F.col("p_value") < significance, F.lit(False)))


def high_group_threshold(train: DataFrame, feature: str, probability: float = 0.95) -> float:
    """The exact training quantile from which a value counts as high."""
    return quantiles(train, {feature: F.col(feature)}, [probability])[feature][0]
