"""Preprocessing fitted on training rows only, and the classifiers of Spark ML on top of it."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions.scalars import finite
from hindcast.operators.contract import require_columns
from hindcast.operators.ordered import before, quantiles
from hindcast.session import cut_lineage, shared_path, written
from hindcast.sources.files import stored_rows

#: Rounds whose margins are ranked at a time: the stopping rows are repeated once for each.
RANKED_ROUNDS = 64
#: Training rows of a task of boosted trees.
TASK_ROWS = 250_000


def fitted_medians(rows: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians of the finite values of each column."""
    found = quantiles(rows, {c: finite(F.col(c).cast("double")) for c in columns}, [0.5])
    return {c: found[c][0] for c in columns}


def filled(column: str, median: float | None) -> Column:
    """Non-finite and missing values become the fitted median, or 0 where there was none."""
    return F.coalesce(finite(F.col(column).cast("double")), F.lit(median).cast("double"), F.lit(0.0))


def modes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value per column; ties go to the smallest value."""
    texts = rows.select(*(F.col(c).cast("string").alias(c) for c in columns))
    long = texts.unpivot([], columns, "column", "category").where(F.col("category").isNotNull())
    counted = long.groupBy("column", "category").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("rank"), "category")).alias("best"))
    return best.select("column", F.col("best.category").alias("mode"), (-F.col("best.rank")).alias("row_count"))


@dataclass(frozen=True)
class Scaling:
    median: float | None
    mean: float
    std: float
    indicator: bool
    indicator_mean: float = 0.0
    indicator_std: float = 1.0


@dataclass
class Preprocessor:
    """Median imputation with indicators and scaling; most-frequent imputation with one-hot columns.

    A numeric column without a single value in training gives no feature.
    """

    numeric: list[str]
    categorical: list[str]
    scaling: dict[str, Scaling] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    #: (column, category, slot), slots counted from 0 within a column in alphabetical order, and how many a column has.
    dictionary: DataFrame | None = None
    widths: dict[str, int] = field(default_factory=dict)

    def fit(self, train: DataFrame) -> Preprocessor:
        if not self.numeric and not self.categorical:
            raise ValueError("preprocessing needs at least one column")
        require_columns(train, {*self.numeric, *self.categorical}, "the training rows")
        if self.numeric:
            self._fit_numeric(train)
        if self.categorical:
            self.modes = {r["column"]: r["mode"] for r in modes(train, self.categorical).collect()}
            self._fit_dictionary(train)
        return self

    def _fit_dictionary(self, train: DataFrame) -> None:
        """Number the categories by the place where a sorted table holds them, so that no task or driver meets them all."""
        texts = self._texts(train).select(*(F.col(f"{c}_text").alias(c) for c in self.categorical))
        long = texts.unpivot([], self.categorical, "column", "category").where(F.col("category").isNotNull()).distinct()
        path = shared_path(train.sparkSession, "categories")
        long.orderBy("column", "category").write.parquet(path)
        placed = stored_rows(train.sparkSession, path, "place")
        facts = placed.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).collect()  # a row for each column
        self.widths = {r["column"]: r["n"] for r in facts}
        first = F.coalesce(*(F.when(F.col("column") == r["column"], F.lit(r["first"])) for r in facts), F.lit(0))
        self.dictionary = written(placed.select("column", "category", (F.col("place") - first).alias("slot")))

    def _fit_numeric(self, train: DataFrame) -> None:
        medians = fitted_medians(train, self.numeric)
        wide = []
        for c in self.numeric:
            value, missing = filled(c, medians[c]), finite(F.col(c).cast("double")).isNull().cast("double")
            wide.append(
                F.struct(
                    F.avg(value).alias("m"), F.stddev_pop(value).alias("s"),
                    F.avg(missing).alias("im"), F.stddev_pop(missing).alias("is"),
                ).alias(c)
            )
        facts = train.agg(*wide).first()
        for c in self.numeric:
            f = facts[c]
            if medians[c] is None:
                continue  # nothing was seen of it: the column is dropped, as it is from every later table
            self.scaling[c] = Scaling(medians[c], f["m"], f["s"] or 1.0, f["im"] > 0, f["im"], f["is"] or 1.0)

    def _texts(self, rows: DataFrame) -> DataFrame:
        return rows.select(
            "*", *(F.coalesce(F.col(c).cast("string"), F.lit(self.modes.get(c))).alias(f"{c}_text") for c in self.categorical)
        )

    def scaled_columns(self) -> dict[str, Column]:
        out = {}
        for c, s in self.scaling.items():
            out[f"{c}_scaled"] = (filled(c, s.median) - s.mean) / s.std
            if s.indicator:
                missing = finite(F.col(c).cast("double")).isNull().cast("double")
                out[f"{c}_missing_scaled"] = (missing - s.indicator_mean) / s.indicator_std
        return out

    def transform(self, rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """The kept columns and one feature vector; every other column is dropped."""
        require_columns(rows, {*self.numeric, *self.categorical}, "the rows to transform")
        scaled = self.scaled_columns()
        made = rows.select("*", *(c.alias(n) for n, c in scaled.items()))
        parts = list(scaled)
        seen = [c for c in self.categorical if self.widths.get(c)]
        if seen:
            made = self._texts(made)
            for c in seen:
                slots = self.dictionary.where(F.col("column") == c).select(F.col("category").alias(f"{c}_text"), F.col("slot").alias(f"{c}_slot"))
                made = made.join(slots, f"{c}_text", "left")
            # The slot behind the last one stands for unseen categories; the encoder drops it, which leaves them all zero.
            made = made.withColumns({f"{c}_slot": F.coalesce(f"{c}_slot", F.lit(self.widths[c])).cast("double") for c in seen})
            encoder = OneHotEncoder(inputCols=[f"{c}_slot" for c in seen], outputCols=[f"{c}_onehot" for c in seen])
            sizes = rows.sparkSession.createDataFrame([tuple(float(self.widths[c]) for c in seen)], [f"{c}_slot" for c in seen])
            made = encoder.fit(sizes).transform(made)
            parts += [f"{c}_onehot" for c in seen]
        return VectorAssembler(inputCols=parts, outputCol="features").transform(made).select(*keep, "features")

    def width(self) -> int:
        return len(self.scaled_columns()) + sum(self.widths.values())


def class_weight(train: DataFrame, label: str) -> float:
    """Negatives per positive; a training set of one class is an error."""
    y = F.col(label)
    positives, negatives = train.agg(F.count_if(y == 1), F.count_if(y == 0)).first()
    if not positives or not negatives:
        raise ValueError("both classes must occur in the training labels")
    return negatives / positives


def balanced_weights(rows: DataFrame, label: str, column: str = "weight") -> DataFrame:
    """Row weights n / (2 n_class), so that both classes weigh the same."""
    y = F.col(label)
    positives, negatives = rows.agg(F.count_if(y == 1), F.count_if(y == 0)).first()
    if not positives or not negatives:
        raise ValueError("both classes must occur in the training labels")
    total = positives + negatives
    return rows.withColumn(
        column, F.when(y == 1, F.lit(total / (2 * positives))).otherwise(F.lit(total / (2 * negatives)))
    )


def fit_logistic(prepared: DataFrame, label: str, inverse_regularisation: float = 0.1, iterations: int = 200):
    """L2-regularised logistic regression with balanced classes."""
    weighted = balanced_weights(prepared, label)
    total = weighted.agg(F.sum("weight")).first()[0]
    learner = LogisticRegression(
        labelCol=label, weightCol="weight", regParam=1.0 / (inverse_regularisation * total),
        elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-8,
    )
    return learner.fit(weighted)


@dataclass(frozen=True)
class Boosted:
    """Boosted trees of which the first ``kept`` score; ``curve`` is the average precision after each round."""

    model: GBTClassificationModel
    leaves: list[list[float]]
    kept: int
    curve: list[float]

    def margins(self, prepared: DataFrame) -> DataFrame:
        """Rows with ``margins``, the margin after each round, from one pass through the trees."""
        # The leaves are constants of the model, so their number is bounded by rounds and depth.
        rounds = len(self.leaves)
        values = np.zeros((rounds, max(map(len, self.leaves))))
        for r, own in enumerate(self.leaves):
            values[r, : len(own)] = own

        def added(reached: pa.Array) -> pa.Array:
            at = reached.flatten().to_numpy(zero_copy_only=False).astype(np.intp).reshape(-1, rounds)
            done = np.cumsum(values[np.arange(rounds), at], axis=1)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * rounds, pa.int32()), pa.array(done.ravel()))

        sums = F.arrow_udf(added, "array<double>")(vector_to_array("leaf"))
        return self.model.transform(prepared).withColumn("margins", sums).drop("leaf", "rawPrediction", "probability", "prediction")

    def transform(self, prepared: DataFrame) -> DataFrame:
        """Rows with ``probability`` by the rounds that are kept."""
        p = 1.0 / (1.0 + F.exp(-2.0 * F.get("margins", F.lit(self.kept - 1))))
        return self.margins(prepared).withColumn("probability", array_to_vector(F.array(1.0 - p, p))).drop("margins")


def fit_boosted(
    prepared: DataFrame, label: str, validation: str, rounds: int = 500, depth: int = 6,
    rate: float = 0.05, subsample: float = 0.8, seed: int = 42, patience: int = 50,
) -> Boosted:
    """Boosted trees; rows where ``validation`` is true only decide how many rounds are kept.

    Kept are the rounds up to the highest average precision on those rows (the earliest of equal ones), looking no further
    than ``patience`` rounds without a new highest. Without such rows, or with one class among them, all rounds are kept.
    Spark cannot go on with a fit, and the first trees of a longer one are those of a shorter one; so the least number of
    rounds that can end the search is fitted first, then four times as many, until it ends or all rounds are fitted.
    """
    train, stopping = prepared.where(~F.col(validation)), prepared.where(F.col(validation))
    weight = class_weight(train, label)
    weighted = train.select(label, "features", F.when(F.col(label) == 1, F.lit(weight)).otherwise(F.lit(1.0)).alias("weight"))
    # Every level of every tree passes over these rows: tasks get equal shares, whatever the splits of the files.
    dealt = cut_lineage(weighted.repartition(train.count() // TASK_ROWS + 1))
    fitted = min(patience + 1, rounds)
    while True:
        learner = GBTClassifier(
            labelCol=label, weightCol="weight", maxIter=fitted, maxDepth=depth, stepSize=rate, subsamplingRate=subsample,
            minInstancesPerNode=5, seed=seed, leafCol="leaf",
        )
        model = learner.fit(dealt)
        whole = Boosted(model, _leaf_values(model, prepared.sparkSession), fitted, [])
        curve, best, ended = _searched_curve(whole.margins(stopping), label, fitted, patience)
        if ended or fitted == rounds:
            return replace(whole, kept=best + 1 if curve else fitted, curve=curve)
        fitted = min(4 * fitted, rounds) if curve else rounds


def _searched_curve(margins: DataFrame, label: str, rounds: int, patience: int) -> tuple[list[float], int, bool]:
    """Average precision of the rounds that are looked at, the place of the highest, and whether the rounds ran out of patience."""
    curve: list[float] = []
    best = 0
    for first in range(0, rounds, RANKED_ROUNDS):
        found = precision_curve(margins.withColumn("margins", F.slice("margins", first + 1, RANKED_ROUNDS)), label)
        for value in found:
            curve.append(value)
            best = len(curve) - 1 if value > curve[best] else best
            if len(curve) - best > patience:
                return curve, best, True
        if not found:
            break
    return curve, best, False


def _leaf_values(model: GBTClassificationModel, spark: SparkSession) -> list[list[float]]:
    """What each leaf of each tree adds to the margin; leaves are numbered as the trees name them, from left to right."""
    path = shared_path(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").where("nodeData.leftChild < 0").select("treeID", "nodeData.id", "nodeData.prediction")
    weights = model.treeWeights  # each look at them asks the JVM for all
    found: list[list[float]] = [[] for _ in weights]
    for row in sorted(nodes.collect(), key=lambda r: (r["treeID"], r["id"])):
        found[row["treeID"]].append(row["prediction"] * weights[row["treeID"]])
    return found


def precision_curve(scored: DataFrame, label: str) -> list[float]:
    """Step-wise average precision of each position of ``margins``; empty unless both classes occur."""
    rows = scored.select(F.col(label).cast("long").alias("y"), F.posexplode("margins").alias("round", "margin"))
    per_score = rows.groupBy("round", (-F.col("margin")).alias("_down")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    per_score = written(per_score)
    table = before(per_score, ("round",), "_down", {"n_above": "n", "pos_above": "pos"}, unique=True)
    hits, seen = F.col("pos_above") + F.col("pos"), F.col("n_above") + F.col("n")
    sums = table.groupBy("round").agg(F.sum("pos").alias("p"), F.sum("n").alias("n"), F.sum(F.col("pos") * hits / seen).alias("s"))
    found = sums.where((F.col("p") > 0) & (F.col("p") < F.col("n"))).orderBy("round").collect()
    return [row["s"] / row["p"] for row in found]


def score(model, prepared: DataFrame, column: str = "score") -> DataFrame:
    """Probability of the positive class beside the kept columns."""
    made = model.transform(prepared)
    return made.withColumn(column, vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def scoring_latency(model, prepared: DataFrame) -> DataFrame:
    """One row: rows scored, mean score and milliseconds per row of one full scoring pass."""
    started = time.perf_counter()
    n, mean = score(model, prepared).agg(F.count(F.lit(1)), F.avg("score")).first()
    elapsed = time.perf_counter() - started
    return prepared.sparkSession.createDataFrame(
        [(n, mean, 1000.0 * elapsed / max(n, 1))], "row_count long, mean_score double, ms_per_row double"
    )
