"""Probability calibration and how well calibrated a score is."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.scalars import clipped, log_odds
from hindcast.operators.isotonic import fit_isotonic, predict_isotonic
from hindcast.operators.ordered import quantiles
from hindcast.operators.policy import label_facts, probability_facts
from hindcast.operators.splits import right_closed_bin
from hindcast.roles import Roles

METHODS = ("uncalibrated", "sigmoid", "isotonic")
INVERSE_REGULARISATION = 1e6


def _require(rows: DataFrame, roles: Roles) -> int:
    scores, labels = probability_facts(rows, roles.score).first(), label_facts(rows, roles.label).first()
    if not scores["row_count"] or scores["invalid"]:
        raise ValueError("calibration needs scores that are probabilities")
    if labels["invalid"] or not labels["positives"] or not labels["negatives"]:
        raise ValueError("calibration needs 0/1 labels of both classes")
    return scores["row_count"]


def fit_sigmoid(points: DataFrame, penalty: float, rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept of a one-feature logistic regression on weighted points (x, y, w).

    Newton's method: one small aggregate per round, a handful of rounds, halving any step that
    raises the loss. Only the slope is penalised.
    """
    points = points.persist()
    at, step, best = (0.0, 0.0), (0.0, 0.0), math.inf
    for _ in range(rounds):
        trial = (at[0] + step[0], at[1] + step[1])
        loss, update = _newton_round(points, trial, penalty)
        if loss > best + 1e-15 * abs(best):
            step = (step[0] / 2, step[1] / 2)
        else:
            at, best, step = trial, loss, update
        if max(abs(step[0]), abs(step[1])) < 1e-12:
            break
    points.unpersist()
    return at


def _newton_round(points: DataFrame, at: tuple[float, float], penalty: float):
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    margin = x * at[0] + at[1]
    p = 1.0 / (1.0 + F.exp(-margin))
    loss = F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin))) - y * margin
    curve = w * p * (1.0 - p)
    n, total, ga, gb, haa, hab, hbb = points.agg(
        F.sum(w), F.sum(w * loss), F.sum(w * (p - y) * x), F.sum(w * (p - y)),
        F.sum(curve * x * x), F.sum(curve * x), F.sum(curve),
    ).first()
    ga, gb = ga / n + penalty * at[0], gb / n
    haa, hab, hbb = haa / n + penalty, hab / n, hbb / n
    determinant = haa * hbb - hab * hab
    if determinant <= 0:
        return total / n + penalty / 2 * at[0] ** 2, (0.0, 0.0)
    update = ((hab * gb - hbb * ga) / determinant, (hab * ga - haa * gb) / determinant)
    return total / n + penalty / 2 * at[0] ** 2, update


@dataclass
class Calibrator:
    """Maps raw probabilities to calibrated ones; must be fitted first."""

    method: str = "sigmoid"
    roles: Roles = Roles()
    epsilon: float = 1e-6
    model: object = None
    fitted: bool = False

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown calibration method {self.method}")

    def fit(self, rows: DataFrame) -> Calibrator:
        n = _require(rows, self.roles)
        # Equal scores are merged into one weighted row before any iterative fit.
        y = F.col(self.roles.label).cast("double")
        merged = rows.groupBy(F.col(self.roles.score).alias("p"), y.alias("y")).agg(
            F.count(F.lit(1)).cast("double").alias("w")
        )
        if self.method == "sigmoid":
            points = merged.select(log_odds(F.col("p"), self.epsilon).alias("x"), "y", "w")
            self.model = fit_sigmoid(points, 1.0 / (INVERSE_REGULARISATION * n))
        elif self.method == "isotonic":
            self.model = fit_isotonic(merged.groupBy("p").agg(F.sum(F.col("y") * F.col("w")).alias("total"), F.sum("w").alias("weight")))
        self.fitted = True
        return self

    def predict(self, rows: DataFrame, column: str = "calibrated") -> DataFrame:
        if not self.fitted:
            raise RuntimeError("the calibrator must be fitted before it predicts")
        score = F.col(self.roles.score)
        if self.method == "uncalibrated":
            return rows.withColumn(column, score)
        if self.method == "sigmoid":
            # The fitted mapping is one slope and one intercept, so it needs no model at scoring time.
            slope, intercept = self.model
            margin = intercept + slope * log_odds(score, self.epsilon)
            return rows.withColumn(column, 1.0 / (1.0 + F.exp(-margin)))
        made = predict_isotonic(rows, score, self.model, column)
        return made.withColumn(column, clipped(F.col(column), 0.0, 1.0))


def brier(score: str, label: str) -> Column:
    gap = F.col(score) - F.col(label)
    return F.avg(gap * gap)


def _quantile_edges(rows: DataFrame, score: str, bins: int) -> list[float]:
    return quantiles(rows, {score: F.col(score)}, [i / bins for i in range(bins + 1)])[score]


def bin_edges(rows: DataFrame, score: str, bins: int, strategy: str = "quantile") -> list[float]:
    """Edges of the reliability bins, duplicates merged."""
    if bins < 2:
        raise ValueError("at least two bins are needed")
    if strategy == "uniform":
        return [i / bins for i in range(bins + 1)]
    if strategy != "quantile":
        raise ValueError(f"unknown binning strategy {strategy}")
    return sorted(set(_quantile_edges(rows, score, bins)))


def calibration_error(rows: DataFrame, bins: int = 10, roles: Roles = Roles()) -> DataFrame:
    """One row: expected calibration error over quantile bins whose outer edges are 0 and 1."""
    if bins < 2:
        raise ValueError("at least two bins are needed")
    edges = sorted({0.0, 1.0, *_quantile_edges(rows, roles.score, bins)[1:-1]})
    per_bin = _per_bin(rows, edges, roles)
    total = rows.agg(F.count(F.lit(1))).scalar()
    gap = F.abs(F.col("observed_rate") - F.col("mean_prediction"))
    return per_bin.agg(F.sum(F.col("bin_count") / total * gap).alias("expected_calibration_error"))


def _per_bin(rows: DataFrame, edges: list[float], roles: Roles) -> DataFrame:
    tagged = rows.withColumn("bin", right_closed_bin(F.col(roles.score), edges))
    return tagged.groupBy("bin").agg(
        F.avg(roles.score).alias("mean_prediction"),
        F.avg(F.col(roles.label).cast("double")).alias("observed_rate"),
        F.count(F.lit(1)).alias("bin_count"),
    )


def reliability_curve(
    rows: DataFrame, bins: int = 10, strategy: str = "quantile", roles: Roles = Roles()
) -> DataFrame:
    """Mean prediction, observed rate, count and gap of every populated bin."""
    made = _per_bin(rows, bin_edges(rows, roles.score, bins, strategy), roles)
    return made.withColumn("absolute_gap", F.abs(F.col("mean_prediction") - F.col("observed_rate")))


def calibration_metrics(rows: DataFrame, method: str, bins: int = 10, roles: Roles = Roles()) -> DataFrame:
    return compare_scores(rows, {method: roles.score}, bins, roles)


def compare_scores(rows: DataFrame, scores: dict[str, str], bins: int = 10, roles: Roles = Roles()) -> DataFrame:
    """Brier score and calibration error of several score columns on the same rows, in one pass."""
    if bins < 2:
        raise ValueError("at least two bins are needed")
    shares = [i / bins for i in range(1, bins)]
    found = quantiles(rows, {m: F.col(c) for m, c in scores.items()}, shares)
    entries = [
        F.struct(
            F.lit(m).alias("method"),
            F.col(c).cast("double").alias("p"),
            right_closed_bin(F.col(c), sorted({0.0, 1.0, *found[m]})).alias("bin"),
        )
        for m, c in scores.items()
    ]
    long = rows.select(F.col(roles.label).cast("double").alias("y"), F.explode(F.array(*entries)).alias("e"))
    gap = F.col("e.p") - F.col("y")
    per_bin = long.groupBy("e.method", "e.bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(gap).alias("gap"), F.sum(gap * gap).alias("squares")
    )
    return per_bin.groupBy("method").agg(
        (F.sum("squares") / F.sum("n")).alias("brier_score"),
        (F.sum(F.abs("gap")) / F.sum("n")).alias("expected_calibration_error"),
    )


def choose_method(results: DataFrame) -> DataFrame:
    """Lowest Brier score, then lowest calibration error, then name."""
    return results.orderBy("brier_score", "expected_calibration_error", "method").limit(1)


def compare_methods(fit_rows: DataFrame, select_rows: DataFrame, bins: int = 10, roles: Roles = Roles()) -> DataFrame:
    """Fit every method on the earlier rows and measure it on the later ones."""
    scored, columns = select_rows, {}
    for method in METHODS:
        columns[method] = f"_{method}"
        scored = Calibrator(method, roles).fit(fit_rows).predict(scored, columns[method])
    return compare_scores(scored, columns, bins, roles)
