"""Tables that explain where a review policy errs and what that is worth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.scalars import ratio
from hindcast.operators.ordered import quantiles
from hindcast.operators.policy import CostMatrix, ReviewPolicy, apply_policy, select_for_review
from hindcast.operators.splits import rank_deciles
from hindcast.roles import Roles

# Fixed values.
CATEGORIES = ("captured", "missed", "unnecessary", "low_risk")


def classify(rows: DataFrame, policy: ReviewPolicy, roles: Roles = Roles()) -> DataFrame:
    """Add the review decision and one of four outcome categories."""
    decided = apply_policy(rows, policy, roles)
    y, reviewed = F.col(roles.label) == 1, F.col("reviewed")
    captured, missed, unnecessary, low_risk = CATEGORIES
    return decided.withColumn(
        "category",
        F.when(y & reviewed, captured)
        .when(y & ~reviewed, missed)
        .when(~y & reviewed, unnecessary)
        .otherwise(low_risk),
    )


def _by_value(column: str, values: dict, default=None) -> Column:
    picks = [F.when(F.col(column) == k, F.lit(v)) for k, v in values.items()]
    return F.coalesce(*picks, F.lit(default).cast("double"))


def category_summary(cases: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Counts, score and amount statistics per category; empty categories are kept."""
    exact = quantiles(
        cases,
        {f"{kind}|{c}": F.when(F.col("category") == c, F.col(column))
         for c in CATEGORIES for kind, column in (("score", roles.score), ("amount", roles.amount))},
        [0.5],
    )
    total = cases.agg(F.count(F.lit(1))).scalar()
    made = cases.groupBy("category").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.col(roles.label).cast("long")).alias("positives"),
        F.avg(roles.score).alias("mean_score"),
        F.min(roles.score).alias("min_score"),
        F.max(roles.score).alias("max_score"),
        F.avg(roles.amount).alias("mean_amount"),
    )
    frame = cases.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return (
        frame.join(made, "category", "left")
        .withColumn("row_count", F.coalesce("row_count", F.lit(0)))
        .withColumn("positives", F.coalesce("positives", F.lit(0)))
        .withColumn("median_score", _by_value("category", {c: exact[f"score|{c}"][0] for c in CATEGORIES}))
        .withColumn("median_amount", _by_value("category", {c: exact[f"amount|{c}"][0] for c in CATEGORIES}))
        .withColumn("share", ratio(F.col("row_count"), total))
    )


def policy_error_summary(cases: DataFrame, capacity: int, roles: Roles = Roles()) -> DataFrame:
    """One row: reviewed, captured, missed and unnecessary cases with rate and precision."""
    count = {c: F.count_if(F.col("category") == c) for c in CATEGORIES}
    facts = cases.agg(
        F.lit(capacity).alias("review_capacity"),
        F.count(F.lit(1)).alias("row_count"),
        F.count_if("reviewed").alias("reviewed_count"),
        F.sum(F.col(roles.label).cast("long")).alias("total_positives"),
        count["captured"].alias("captured_count"),
        count["missed"].alias("missed_count"),
        count["unnecessary"].alias("unnecessary_count"),
    )
    return facts.withColumn("capture_rate", ratio(F.col("captured_count"), F.col("total_positives"))).withColumn(
        "review_precision", ratio(F.col("captured_count"), F.col("reviewed_count"))
    )


def score_distribution(rows: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Mean and exact quantiles of the score per label."""
    shares = {"p05_score": 0.05, "p25_score": 0.25, "median_score": 0.5, "p75_score": 0.75, "p95_score": 0.95}
    exact = quantiles(
        rows, {str(y): F.when(F.col(roles.label) == y, F.col(roles.score)) for y in (0, 1)}, list(shares.values())
    )
    made = rows.groupBy(roles.label).agg(
        F.count(F.lit(1)).alias("row_count"), F.avg(roles.score).alias("mean_score")
    )
    for i, name in enumerate(shares):
        made = made.withColumn(name, _by_value(roles.label, {y: exact[str(y)][i] for y in (0, 1)}))
    return made


def score_deciles(cases: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Rates, reviews and captures per decile of the score rank."""
    tagged = rank_deciles(cases, F.col(roles.score), roles.key, "score_decile")
    y = F.col(roles.label)
    return tagged.groupBy("score_decile").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(y.cast("long")).alias("positives"),
        F.avg(y.cast("double")).alias("positive_rate"),
        F.count_if("reviewed").alias("reviewed_count"),
        F.count_if(F.col("category") == "captured").alias("captured_count"),
        F.avg(roles.score).alias("mean_score"),
        F.min(roles.score).alias("min_score"),
        F.max(roles.score).alias("max_score"),
    )


def time_deciles(cases: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Rates, reviews, captures and misses per decile of the time rank."""
    tagged = rank_deciles(cases, F.col(roles.time), roles.key, "time_decile")
    y = F.col(roles.label)
    made = tagged.groupBy("time_decile").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(y.cast("long")).alias("positives"),
        F.avg(y.cast("double")).alias("positive_rate"),
        F.count_if("reviewed").alias("reviewed_count"),
        F.count_if(F.col("category") == "captured").alias("captured_count"),
        F.count_if(F.col("category") == "missed").alias("missed_count"),
        F.count_if(F.col("category") == "unnecessary").alias("unnecessary_count"),
        F.avg(roles.score).alias("mean_score"),
        F.min(roles.time).alias("first_time"),
        F.max(roles.time).alias("last_time"),
    )
    return made.withColumn("capture_rate", ratio(F.col("captured_count"), F.col("positives")))


def leading_errors(cases: DataFrame, per_category: int = 20, roles: Roles = Roles()) -> DataFrame:
    """The highest-scoring missed and unnecessary cases."""
    wrong = cases.where(F.col("category").isin("missed", "unnecessary"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc(roles.score), F.asc(roles.key)))
    return wrong.withColumn("error_rank", rank).where(F.col("error_rank") <= per_category)


def boundary_score(rows: DataFrame, policy: ReviewPolicy, roles: Roles = Roles()) -> DataFrame:
    """The lowest score that is still reviewed."""
    chosen = select_for_review(rows.select(roles.key, roles.score), policy, roles)
    return chosen.agg(F.min(roles.score).alias("boundary_score"))


def value_summary(summary: DataFrame, costs: CostMatrix) -> DataFrame:
    """Review cost, prevention value, net value and residual exposure of a policy error summary."""
    review = F.col("reviewed_count") * costs.manual_review_cost
    value = F.col("captured_count") * costs.fraud_prevention_value
    return summary.select(
        "*",
        review.alias("total_review_cost"),
        value.alias("total_prevention_value"),
        (value - review).alias("net_value"),
        (F.col("missed_count") * costs.false_negative_cost).alias("residual_exposure"),
    )


def value_components(values: DataFrame) -> DataFrame:
    """The signed parts of the value as rows."""
    signed = values.select(
        F.col("total_prevention_value").alias("prevention_value"),
        (-F.col("total_review_cost")).alias("review_cost"),
        F.col("net_value"),
        (-F.col("residual_exposure")).alias("residual_exposure"),
    )
    return signed.unpivot([], signed.columns, "component", "amount")


def capacity_values(results: DataFrame, costs: CostMatrix) -> DataFrame:
    """Capacity results with the missed cases and the exposure they leave."""
    missed = F.col("total_positives") - F.col("captured_count")
    return results.select(
        "*", missed.alias("missed_count"), (missed * costs.false_negative_cost).alias("residual_exposure")
    )


def period_comparison(results: dict[str, DataFrame]) -> DataFrame:
    """The same policy in several periods, with review precision."""
    parts = [df.withColumn("evaluation_period", F.lit(name)) for name, df in results.items()]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.withColumn("review_precision", ratio(F.col("captured_count"), F.col("selected_review_count")))
