"""Keyed joins with the checks that make them safe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.scalars import ratio_or_zero
from hindcast.operators.ordered import attach
from hindcast.operators.quality import require_unique
from hindcast.session import shared_path


def one_to_one_left(left: DataFrame, right: DataFrame, key: str, suffix: str = "_identity") -> DataFrame:
    """Left join on a key that both sides hold once; clashing right columns get a suffix.

    The added ``matched`` column tells whether the right side had the key.
    """
    require_unique(left, key, "the left table")
    require_unique(right, key, "the right table")
    renamed = right.select(
        key, *(F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns if c != key)
    ).withColumn("matched", F.lit(True))
    joined = left.join(renamed, key, "left")
    return joined.withColumn("matched", F.coalesce("matched", F.lit(False)))


def join_manifest(joined: DataFrame, right: DataFrame) -> DataFrame:
    """Row counts, matches and coverage of a ``one_to_one_left`` join."""
    facts = joined.agg(F.count(F.lit(1)).alias("joined_rows"), F.count_if("matched").alias("matches"))
    return facts.select(
        F.col("joined_rows").alias("left_rows"),
        right.agg(F.count(F.lit(1))).scalar().alias("right_rows"),
        "joined_rows",
        "matches",
        ratio_or_zero(F.col("matches"), F.col("joined_rows")).alias("coverage"),
        (F.col("joined_rows") - F.col("matches")).alias("unmatched"),
    )


def lookup(rows: DataFrame, mapping: DataFrame, on: str, value: str, default, key: str) -> DataFrame:
    """Left join to a mapping, unseen entries get the default; crowded entries are spread by key."""
    joined = attach(rows, mapping.select(on, value), (on,), key)
    return joined.withColumn(value, F.coalesce(value, default))


def append_features(rows: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Join precomputed feature columns on the key; names must not clash and rows must pair up.

    The features are written once to the shared folder, and all checks read that table.
    """
    clash = sorted((set(rows.columns) & set(features.columns)) - {key})
    if clash:
        raise ValueError(f"feature columns already exist: {clash}")
    path = shared_path(features.sparkSession, "features")
    features.write.parquet(path)
    features = features.sparkSession.read.parquet(path)
    require_unique(features, key, "the feature table")
    counts = [df.count() for df in (rows, features, rows.select(key).join(features.select(key), key, "semi"))]
    if len(set(counts)) != 1:
        raise ValueError(f"rows and features do not pair up: {counts}")
    kinds = dict(features.dtypes)
    numbers = [c for c in features.columns if kinds[c] in ("double", "float")]
    if numbers:
        bad = non_finite_counts(features, numbers).where("infinite_values > 0").collect()
        if bad:
            raise ValueError(f"infinite feature values: {[r['column'] for r in bad]}")
    return rows.join(features, key)


def non_finite_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How many values per column are infinite."""
    wide = rows.agg(*(F.count_if(F.abs(F.col(c)) == F.lit(float("inf"))).alias(c) for c in columns))
    return wide.unpivot([], columns, "column", "infinite_values")


def compare_by_key(
    baseline: DataFrame, candidate: DataFrame, key: str, metrics: list[str]
) -> DataFrame:
    """Baseline, candidate and difference per metric; a key the candidate lacks is an error."""
    missing = baseline.join(candidate, key, "left_anti").select(key).limit(5).collect()
    if missing:
        raise ValueError(f"the candidate has no result for {key} {[r[0] for r in missing]}")
    pair = baseline.alias("b").join(candidate.alias("c"), key)
    out = [F.col(key)]
    for m in metrics:
        out += [
            F.col(f"b.{m}").alias(f"baseline_{m}"),
            F.col(f"c.{m}").alias(f"candidate_{m}"),
            (F.col(f"c.{m}") - F.col(f"b.{m}")).alias(f"{m}_difference"),
        ]
    return pair.select(*out)


def compare_metrics(baseline: DataFrame, candidate: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per metric from two one-row metric tables."""

    def long(df: DataFrame, name: str) -> DataFrame:
        doubles = df.select(*(F.col(m).cast("double").alias(m) for m in metrics))
        return doubles.unpivot([], metrics, "metric", name)

    return long(baseline, "baseline").join(long(candidate, "candidate"), "metric").withColumn(
        "candidate_minus_baseline", F.col("candidate") - F.col("baseline")
    )


def exactly_one(rows: DataFrame, column: str, value) -> DataFrame:
    """The single row with a value; none or several is an error."""
    found = rows.where(F.col(column) == F.lit(value))
    n = found.limit(2).count()
    if n != 1:
        raise ValueError(f"expected exactly one row with {column} = {value}, found {'several' if n else 'none'}")
    return found


def comparability(runs: DataFrame, candidate: str, baseline: str, facts: list[str], name: str = "run") -> DataFrame:
    """Whether two run rows agree on every fact that must be equal, one row per fact."""
    texts = runs.select(name, *(F.col(f).cast("string").alias(f) for f in facts))
    long = texts.unpivot([name], facts, "fact", "value")
    a = long.where(F.col(name) == baseline).select("fact", F.col("value").alias("baseline"))
    b = long.where(F.col(name) == candidate).select("fact", F.col("value").alias("candidate"))
    return a.join(b, "fact").withColumn("equal", F.col("baseline").eqNullSafe(F.col("candidate")))


def require_comparable(runs: DataFrame, candidate: str, baseline: str, facts: list[str], name: str = "run") -> None:
    unequal = comparability(runs, candidate, baseline, facts, name).where("NOT equal").collect()
    if unequal:
        raise ValueError(
            "runs are not comparable: "
            + ", ".join(f"{r['fact']} {r['baseline']} against {r['candidate']}" for r in unequal)
        )
