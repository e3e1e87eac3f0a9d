"""Exact ranking metrics of a scored table; equal scores are ranked by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.scalars import ratio, ratio_or_zero
from hindcast.operators.ordered import before, profile
from hindcast.operators.policy import ReviewPolicy, label_facts, probability_facts, select_for_review
from hindcast.roles import Roles


def top_k(rows: DataFrame, k: int, roles: Roles = Roles()) -> DataFrame:
    """The k rows with the highest probabilities, ties by key."""
    return select_for_review(rows, ReviewPolicy(k), roles)


def metrics_at_k(rows: DataFrame, k: int, roles: Roles = Roles()) -> DataFrame:
    """One row: positives captured in the top k, precision and recall."""
    y = F.col(roles.label).cast("long")
    total = rows.agg(F.sum(y)).scalar()
    found = top_k(rows.select(roles.key, roles.score, roles.label), k, roles).agg(
        F.sum(y).alias("captured_at_k"), F.count(F.lit(1)).alias("selected")
    )
    return found.select(
        F.lit(k).alias("review_capacity"),
        "captured_at_k",
        total.alias("total_positives"),
        ratio(F.col("captured_at_k"), F.col("selected")).alias("precision_at_k"),
        ratio(F.col("captured_at_k"), total).alias("recall_at_k"),
    )


def cumulative_scores(rows: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Per distinct score: its rows and positives, and those with a strictly higher score."""
    y = F.col(roles.label).cast("long")
    per_score = rows.groupBy((-F.col(roles.score)).alias("_down")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos")
    )
    layout = profile(per_score, "_down")
    return before(per_score, (), "_down", {"n_above": "n", "pos_above": "pos"}, layout, unique=True)


def ranking_areas(rows: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """One row: step-wise average precision and the ROC area with half credit for ties."""
    table = cumulative_scores(rows, roles)
    hits, seen = F.col("pos_above") + F.col("pos"), F.col("n_above") + F.col("n")
    negatives = F.col("n") - F.col("pos")
    sums = table.agg(
        F.sum("pos").alias("p"),
        F.sum(negatives).alias("q"),
        F.sum(F.col("pos") * hits / seen).alias("precision_sum"),
        F.sum((negatives * (2 * F.col("pos_above") + F.col("pos"))).cast("decimal(38,0)")).alias("double_wins"),
    )
    pairs = F.col("p").cast("double") * F.col("q")
    return sums.select(
        ratio(F.col("precision_sum"), F.col("p")).alias("pr_auc"),
        ratio(F.col("double_wins").cast("double") / 2, pairs).alias("roc_auc"),
    )


def confusion(rows: DataFrame, threshold: float, roles: Roles = Roles()) -> DataFrame:
    """Confusion counts at score >= threshold, with precision, recall and F1 (0 when undefined)."""
    y, flagged = F.col(roles.label) == 1, F.col(roles.score) >= threshold
    counts = rows.agg(
        F.count_if(y & flagged).alias("true_positives"),
        F.count_if(~y & flagged).alias("false_positives"),
        F.count_if(y & ~flagged).alias("false_negatives"),
        F.count_if(~y & ~flagged).alias("true_negatives"),
    )
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    return counts.select(
        F.lit(float(threshold)).alias("reference_threshold"),
        *counts.columns,
        ratio_or_zero(tp, tp + fp).alias("precision"),
        ratio_or_zero(tp, tp + fn).alias("recall"),
        ratio_or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def require_evaluable(rows: DataFrame, k: int, threshold: float, roles: Roles = Roles()) -> None:
    """Finite probabilities, binary labels of both classes, and a capacity the rows can fill."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("the reference threshold must lie in [0, 1]")
    scores, labels = probability_facts(rows, roles.score).first(), label_facts(rows, roles.label).first()
    if scores["invalid"]:
        raise ValueError(f"{scores['invalid']} scores are not probabilities")
    if labels["invalid"] or not labels["positives"] or not labels["negatives"]:
        raise ValueError("labels must be 0 or 1 and both must occur")
    if not 1 <= k <= labels["row_count"]:
        raise ValueError(f"capacity {k} does not fit {labels['row_count']} rows")


def evaluate(rows: DataFrame, k: int, threshold: float = 0.5, roles: Roles = Roles()) -> DataFrame:
    """The full evaluation record as one row."""
    require_evaluable(rows, k, threshold, roles)
    record = confusion(rows, threshold, roles)
    for part in (ranking_areas(rows, roles), metrics_at_k(rows, k, roles)):
        record = record.withColumn("_part", part.select(F.struct("*")).scalar()).select(
            *record.columns, *(F.col(f"_part.{c}").alias(c) for c in part.columns)
        )
    return record
