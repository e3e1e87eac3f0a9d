"""Capacity-constrained review policies and what they cost."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.scalars import ratio_or_zero
from hindcast.operators.ordered import rows_at, sorts_before
from hindcast.roles import Roles

# Fixed values. So are the field names of the cost table and the columns of the policy results below, which are the
# published vocabulary of these reports.
BLOCK_THRESHOLD = 0.95
ACTIONS = ("approve", "review", "block")

#: Rows of a period that are ranked together, and how many such selections meet in the next round.
SLICE_ROWS, FAN_IN = 1_000_000, 64


def probability_facts(rows: DataFrame, score: str) -> DataFrame:
    """How many rows there are and how many scores are not finite numbers in [0, 1]."""
    p = F.col(score)
    bad = p.isNull() | F.isnan(p) | (p < 0) | (p > 1)
    return rows.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(bad).alias("invalid"))


def require_probabilities(rows: DataFrame, score: str) -> None:
    facts = probability_facts(rows, score).first()
    if not facts["row_count"]:
        raise ValueError("there are no probabilities")
    if facts["invalid"]:
        raise ValueError(f"{facts['invalid']} values of {score} are not probabilities")


def label_facts(rows: DataFrame, label: str) -> DataFrame:
    """Row count, labels other than 0 and 1, and how often each class occurs."""
    y = F.col(label)
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(y.isNull() | ~y.isin(0, 1)).alias("invalid"),
        F.count_if(y == 1).alias("positives"),
        F.count_if(y == 0).alias("negatives"),
    )


def require_labels(rows: DataFrame, label: str, both: bool = True) -> None:
    facts = label_facts(rows, label).first()
    if not facts["row_count"] or facts["invalid"]:
        raise ValueError(f"{label} must hold 0 and 1 only, and at least one row")
    if both and not (facts["positives"] and facts["negatives"]):
        raise ValueError(f"{label} must contain both classes")


@dataclass(frozen=True)
class CostMatrix:
    false_negative_cost: float
    manual_review_cost: float
    false_positive_escalation_cost: float
    fraud_prevention_value: float

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if not math.isfinite(value) or value < 0:
                raise ValueError(f"{f.name} must be finite and not negative, got {value}")


@dataclass(frozen=True)
class ReviewPolicy:
    capacity: int
    min_probability: float = 0.0
    max_probability: float = 1.0
    block_threshold: float = BLOCK_THRESHOLD
    actions: tuple[str, ...] = ACTIONS

    def __post_init__(self):
        if self.capacity < 1:
            raise ValueError("capacity must be at least 1")
        if not 0.0 <= self.min_probability < self.max_probability <= 1.0:
            raise ValueError("probability bounds must satisfy 0 <= min < max <= 1")
        if len(self.actions) != 3:
            raise ValueError("exactly three action labels are needed")

    def eligible(self, score: str) -> Column:
        return F.col(score).between(self.min_probability, self.max_probability)


def action_costs(rows: DataFrame, costs: CostMatrix, score: str = "score") -> DataFrame:
    """Expected cost of each action and the value of preventing the loss, per row."""
    p = F.col(score)
    return rows.select(
        "*",
        (p * costs.false_negative_cost).alias("approve_cost"),
        F.lit(float(costs.manual_review_cost)).alias("review_cost"),
        ((1.0 - p) * costs.false_positive_escalation_cost).alias("block_cost"),
        (p * costs.fraud_prevention_value).alias("prevention_value"),
    )


def review_priority(score: str, costs: CostMatrix) -> Column:
    """Expected prevention value minus the review cost."""
    return F.col(score) * costs.fraud_prevention_value - costs.manual_review_cost


def cost_violations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose cost columns are missing, not finite, or negative."""
    wide = rows.agg(
        *(
            F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == F.lit(math.inf)) | (F.col(c) < 0)).alias(c)
            for c in columns
        )
    )
    return wide.unpivot([], columns, "cost", "violations")


def select_for_review(rows: DataFrame, policy: ReviewPolicy, roles: Roles = Roles()) -> DataFrame:
    """The highest eligible scores up to the capacity, ties by key.

    Each row is compared with the exact first (score, key) beyond the capacity, whatever its size: nothing is sorted and
    no task meets the best rows of all the others.
    """
    eligible = rows.where(policy.eligible(roles.score))
    (within,) = _within(eligible, [policy.capacity], roles)
    return eligible.where(within)


def _within(eligible: DataFrame, capacities: list[int], roles: Roles) -> list[Column]:
    """For each capacity, whether a row is among that many best ones."""
    n = eligible.count()
    down, key = -F.col(roles.score), F.col(roles.key)
    binding = sorted({c for c in capacities if c < n})
    first_outside = dict(zip(binding, rows_at(eligible, down, roles.key, binding))) if binding else {}
    return [sorts_before(down, key, first_outside[c]) if c in first_outside else F.lit(True) for c in capacities]


def select_per_period(rows: DataFrame, policy: ReviewPolicy, period: str, roles: Roles = Roles()) -> DataFrame:
    """The same selection within each period.

    Spark limits a rank before its shuffle: each task passes on at most ``capacity`` rows of a period. Where a period holds
    so many rows that even these are many, slices of it are ranked first, and the selections of FAN_IN slices at a time.
    """
    best_first = (F.desc(roles.score), F.asc(roles.key))
    left = rows.where(policy.eligible(roles.score))
    counted = left.groupBy(period).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    # Slices of some SLICE_ROWS rows, then FAN_IN of their selections at a time.
    slices = max(1, -(-counted // SLICE_ROWS))
    while slices > 1:
        piece = F.pmod(F.xxhash64(roles.key), F.lit(slices))
        place = F.row_number().over(Window.partitionBy(period, "_slice").orderBy(*best_first))
        left = left.withColumn("_slice", piece).withColumn("_place", place).where(F.col("_place") <= policy.capacity).drop("_slice", "_place")
        slices = slices // FAN_IN if slices >= FAN_IN * FAN_IN else 1
    rank = F.row_number().over(Window.partitionBy(period).orderBy(*best_first))
    return left.withColumn("review_rank", rank).where(F.col("review_rank") <= policy.capacity)


def review_boundary(rows: DataFrame, policy: ReviewPolicy, roles: Roles = Roles()) -> Column:
    """The last selected (score, key) as one scalar, so that marking rows needs no join."""
    narrow = select_for_review(rows.select(roles.key, roles.score), policy, roles)
    last = F.max(F.struct((-F.col(roles.score)).alias("down"), F.col(roles.key).alias("key")))
    return narrow.agg(last.alias("boundary")).scalar()


def apply_policy(rows: DataFrame, policy: ReviewPolicy, roles: Roles = Roles()) -> DataFrame:
    """Add ``reviewed`` and ``action``: review when selected, block above the threshold, else approve."""
    place = F.struct((-F.col(roles.score)).alias("down"), F.col(roles.key).alias("key"))
    chosen = policy.eligible(roles.score) & (place <= F.col("_boundary"))
    approve, review, block = policy.actions
    return (
        rows.withColumn("_boundary", review_boundary(rows, policy, roles))
        .withColumn("reviewed", F.coalesce(chosen, F.lit(False)))
        .drop("_boundary")
        .withColumn(
            "action",
            F.when(F.col("reviewed"), F.lit(review))
            .when(F.col(roles.score) > policy.block_threshold, F.lit(block))
            .otherwise(F.lit(approve)),
        )
    )


def outcome_counts(decided: DataFrame, policy: ReviewPolicy, roles: Roles = Roles()) -> DataFrame:
    """Outcome counts of a decided table; blocked rows are in none of them."""
    y, reviewed = F.col(roles.label) == 1, F.col("reviewed")
    passed = F.col("action") == policy.actions[0]
    return decided.agg(
        F.count_if(y & reviewed).alias("true_positives"),
        F.count_if(~y & reviewed).alias("false_positives"),
        F.count_if(y & passed).alias("false_negatives"),
        F.count_if(~y & passed).alias("true_negatives"),
    )


def capacity_results(
    rows: DataFrame, capacities: list[int], costs: CostMatrix, roles: Roles = Roles(),
    min_probability: float = 0.0, max_probability: float = 1.0,
) -> DataFrame:
    """Policy results at every capacity from one aggregate."""
    widest = ReviewPolicy(max(capacities), min_probability, max_probability)
    for capacity in capacities:
        ReviewPolicy(capacity, min_probability, max_probability)
    y = F.col(roles.label).cast("long")
    total = rows.agg(F.coalesce(F.sum(y), F.lit(0))).scalar()
    narrow = rows.select(roles.key, roles.score, roles.label)
    source = narrow.where(widest.eligible(roles.score))
    tests = _within(source, capacities, roles)
    wide = source.agg(
        *(
            F.struct(
                F.count_if(test).alias("selected_review_count"),
                F.coalesce(F.sum(F.when(test, y)), F.lit(0)).alias("captured_count"),
            ).alias(str(c))
            for c, test in zip(capacities, tests)
        )
    )
    long = wide.unpivot([], [str(c) for c in capacities], "capacity", "r")
    selected, captured = F.col("selected_review_count"), F.col("captured_count")
    shaped = long.select(
        F.col("capacity").cast("int").alias("review_capacity"), "r.*", total.alias("total_positives")
    )
    cost = selected * costs.manual_review_cost
    value = captured * costs.fraud_prevention_value
    return shaped.select(
        "review_capacity",
        "selected_review_count",
        ratio_or_zero(selected, F.col("review_capacity")).alias("capacity_utilisation"),
        "captured_count",
        "total_positives",
        ratio_or_zero(captured, F.col("total_positives")).alias("capture_rate"),
        (selected - captured).alias("false_positive_reviews"),
        cost.alias("total_review_cost"),
        value.alias("total_prevention_value"),
        (value - cost).alias("net_value"),
    )


def evaluate_policy(rows: DataFrame, policy: ReviewPolicy, costs: CostMatrix, roles: Roles = Roles()) -> DataFrame:
    """The result of one policy as one row."""
    return capacity_results(
        rows, [policy.capacity], costs, roles, policy.min_probability, policy.max_probability
    )


def keep_or_reject(comparison: DataFrame, captured: str = "captured_count", value: str = "net_value") -> DataFrame:
    """Keep a candidate that gains captures without losing value, or value without losing captures."""
    more, worth = F.col(f"{captured}_difference"), F.col(f"{value}_difference")
    keep = ((more > 0) & (worth >= 0)) | ((worth > 0) & (more >= 0))
    return comparison.withColumn("decision", F.when(keep, F.lit("keep")).otherwise(F.lit("reject")))


def champion(models: DataFrame) -> DataFrame:
    """Highest PR-AUC, then recall at capacity, then name."""
    return models.orderBy(F.desc("pr_auc"), F.desc("recall_at_k"), "model").limit(1)


def ablation_summary(comparisons: dict[str, DataFrame], capacity: int) -> DataFrame:
    """One row per experiment at a capacity, with the verdict on its net value."""
    parts = [
        df.where(F.col("review_capacity") == capacity).withColumn("experiment", F.lit(name))
        for name, df in comparisons.items()
    ]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    verdict = F.when(F.col("candidate_net_value") <= F.col("baseline_net_value"), "rejected").otherwise("review")
    return rows.withColumn("selection_decision", verdict)
