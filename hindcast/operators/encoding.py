"""Target encoding that only ever learns from earlier labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.scalars import category
from hindcast.operators.contract import require_columns
from hindcast.operators.ordered import attach, hot_keys
from hindcast.operators.splits import array_split_folds
from hindcast.roles import Roles


@dataclass(frozen=True)
class EncoderSettings:
    columns: tuple[str, ...]
    smoothing: float = 10.0
    min_samples: int = 20


@dataclass(frozen=True)
class FittedEncoder:
    """(column, category, n, positives, encoded) plus the rate for categories never seen."""

    settings: EncoderSettings
    mapping: DataFrame
    global_rate: float

    def transform(self, rows: DataFrame, key: str) -> DataFrame:
        require_columns(rows, set(self.settings.columns), "the rows to encode")
        names = [f"_category_{c}" for c in self.settings.columns]
        out = rows.withColumns({n: category(F.col(c)) for n, c in zip(names, self.settings.columns)})
        hot = hot_keys(out, [(n,) for n in names])
        for c, name, crowded in zip(self.settings.columns, names, hot):
            of_column = self.mapping.where(F.col("column") == c).select(
                F.col("category").alias(name), F.col("encoded").alias(f"{c}_encoded")
            )
            out = attach(out, of_column, (name,), key, crowded)
            out = out.withColumn(f"{c}_encoded", F.coalesce(f"{c}_encoded", F.lit(self.global_rate)))
        return out.drop(*names)


def _long(rows: DataFrame, settings: EncoderSettings, label: str, *keep: str) -> DataFrame:
    texts = rows.select(*keep, F.col(label).cast("long").alias("_y"), *(category(F.col(c)).alias(c) for c in settings.columns))
    return texts.unpivot([*keep, "_y"], list(settings.columns), "column", "category")


def _smoothed(n: Column, positives: Column, rate: Column, settings: EncoderSettings) -> Column:
    blended = (positives + settings.smoothing * rate) / (n + settings.smoothing)
    return F.when(n >= max(settings.min_samples, 1), blended).otherwise(rate)


def require_binary(rows: DataFrame, label: str) -> None:
    y = F.col(label)
    if not rows.where(y.isNotNull() & ~y.isin(0, 1)).isEmpty():
        raise ValueError(f"{label} must hold 0 and 1 only")


def fit(rows: DataFrame, label: str, settings: EncoderSettings) -> FittedEncoder:
    """Smoothed rate per category; a category with too few rows gets the overall rate."""
    require_columns(rows, {*settings.columns, label}, "the training rows")
    require_binary(rows, label)
    rate = rows.agg(F.avg(F.col(label).cast("double"))).first()[0]
    counted = _long(rows, settings, label).groupBy("column", "category").agg(
        F.count("_y").alias("n"), F.sum("_y").alias("positives")
    )
    encoded = _smoothed(F.col("n"), F.col("positives"), F.lit(rate), settings)
    return FittedEncoder(settings, counted.withColumn("encoded", encoded), rate)


def out_of_fold(
    rows: DataFrame, settings: EncoderSettings, folds: int = 5, roles: Roles = Roles()
) -> DataFrame:
    """Encode each fold of timestamps from the folds before it; the first fold stays NULL.

    One pass: sums per (column, category, fold) are accumulated over folds, never refitted.
    """
    require_columns(rows, {*settings.columns, roles.label, roles.time, roles.key}, "the rows to encode")
    require_binary(rows, roles.label)
    tagged = array_split_folds(rows, roles.time, folds, "_fold")
    y = F.col(roles.label).cast("long")
    per_fold = tagged.groupBy("_fold").agg(F.count(y).alias("n"), F.sum(y).alias("s")).orderBy("_fold").collect()
    rates, n, s = {}, 0, 0
    for row in per_fold:
        if n:
            rates[row["_fold"]] = s / n
        n, s = n + row["n"], s + row["s"]
    rate = F.coalesce(*(F.when(F.col("_fold") == f, F.lit(r)) for f, r in rates.items()), F.lit(None).cast("double"))
    sums = _long(tagged, settings, roles.label, "_fold").groupBy("column", "category", "_fold").agg(
        F.count("_y").alias("n"), F.sum("_y").alias("s")
    )
    # At most one row per fold in each partition of this window.
    past = Window.partitionBy("column", "category").orderBy("_fold").rowsBetween(Window.unboundedPreceding, -1)
    history = sums.select(
        "column",
        "category",
        "_fold",
        F.coalesce(F.sum("n").over(past), F.lit(0)).alias("n"),
        F.coalesce(F.sum("s").over(past), F.lit(0)).alias("s"),
    )
    encoded = history.withColumn("encoded", _smoothed(F.col("n"), F.col("s"), rate, settings))
    names = [f"_category_{c}" for c in settings.columns]
    out = tagged.withColumns({n: category(F.col(c)) for n, c in zip(names, settings.columns)})
    hot = hot_keys(out, [(n, "_fold") for n in names])
    for c, name, crowded in zip(settings.columns, names, hot):
        of_column = encoded.where(F.col("column") == c).select(
            F.col("category").alias(name), "_fold", F.col("encoded").alias(f"{c}_encoded")
        )
        out = attach(out, of_column, (name, "_fold"), roles.key, crowded)
    return out.drop("_fold", *names)


def encoding_guards(encoded: DataFrame, settings: EncoderSettings) -> DataFrame:
    """Rows, and how many encodings are NULL or outside [0, 1], per column."""
    wide = encoded.agg(
        *(
            F.struct(
                F.count(F.lit(1)).alias("row_count"),
                F.count_if(F.col(f"{c}_encoded").isNull()).alias("null_encodings"),
                F.count_if((F.col(f"{c}_encoded") < 0) | (F.col(f"{c}_encoded") > 1)).alias("out_of_range"),
            ).alias(c)
            for c in settings.columns
        )
    )
    return wide.unpivot([], list(settings.columns), "column", "facts").select("column", "facts.*")
