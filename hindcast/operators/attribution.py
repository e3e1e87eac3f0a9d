"""Attribution tables (case, feature, value[, seed]): production for linear models and analysis of any."""

from __future__ import annotations

import math

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.roles import Roles


def linear_attributions(
    rows: DataFrame, coefficients: dict[str, float], background: DataFrame, key: str
) -> DataFrame:
    """coef * (x - background mean) per feature: the exact attribution of a linear margin."""
    names = list(coefficients)
    means = background.agg(*(F.avg(n).alias(n) for n in names)).first()
    parts = rows.select(
        F.col(key).alias("case"),
        *((F.lit(coefficients[n]) * (F.col(n) - F.lit(means[n]))).alias(n) for n in names),
    )
    return parts.unpivot(["case"], names, "feature", "value")


def global_importance(attributions: DataFrame) -> DataFrame:
    """Mean absolute value per feature with its rank."""
    made = attributions.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_absolute_value"))
    # One row per feature, so the ranking window is as small as the feature list.
    return made.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_absolute_value"), "feature")))


def local_explanation(attributions: DataFrame, top: int, by: tuple[str, ...] = ("case",)) -> DataFrame:
    """The strongest positive and negative contributors of every case (and background sample, if ``by`` names it)."""
    if top < 1:
        raise ValueError("top must be at least 1")
    sign = F.when(F.col("value") > 0, "positive").when(F.col("value") < 0, "negative")
    signed = attributions.withColumn("direction", sign).where(F.col("direction").isNotNull())
    rank = F.row_number().over(Window.partitionBy(*by, "direction").orderBy(F.desc(F.abs("value")), "feature"))
    return signed.withColumn("rank", rank).where(F.col("rank") <= top)


def top_features(attributions: DataFrame, top: int, by: tuple[str, ...] = ("case", "seed")) -> DataFrame:
    """The largest absolute values per case, ties by feature."""
    if top < 1:
        raise ValueError("top must be at least 1")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.abs("value")), "feature"))
    return attributions.withColumn("rank", rank).where(F.col("rank") <= top)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def pairwise_stability(attributions: DataFrame, seeds: list[int], top: int) -> DataFrame:
    """For every case and pair of the given seeds: how far their top features agree.

    The seeds are a short list of background samples, laid out side by side per case, so no join
    over cases is needed.
    """
    if len(set(seeds)) < 2:
        raise ValueError("at least two seeds are needed")
    best = top_features(attributions.where(F.col("seed").isin(list(seeds))), top)
    sets = best.groupBy("case").agg(
        *(F.collect_set(F.when(F.col("seed") == s, F.col("feature"))).alias(f"s{s}") for s in seeds)
    )
    pairs = F.array(
        *(
            F.struct(
                F.lit(a).alias("seed_a"), F.lit(b).alias("seed_b"), F.col(f"s{a}").alias("a"), F.col(f"s{b}").alias("b")
            )
            for a, b in combinations(sorted(set(seeds)), 2)
        )
    )
    spread = sets.select("case", F.explode(pairs).alias("p")).select("case", "p.*")
    spread = spread.where((F.size("a") > 0) & (F.size("b") > 0))
    shared = F.array_intersect("a", "b")
    return spread.select(
        "case",
        "seed_a",
        "seed_b",
        F.lit(top).alias("top_feature_count"),
        F.size(shared).alias("shared_count"),
        F.size(F.array_union("a", "b")).alias("union_count"),
        jaccard(F.col("a"), F.col("b")).alias("jaccard_similarity"),
        F.array_join(F.array_sort(shared), " | ").alias("shared_features"),
    )


def stability_summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("case").agg(
        F.count("jaccard_similarity").alias("seed_pairs"),
        F.avg("jaccard_similarity").alias("mean_jaccard"),
        F.min("jaccard_similarity").alias("min_jaccard"),
        F.max("jaccard_similarity").alias("max_jaccard"),
        F.avg(F.col("shared_count").cast("double")).alias("mean_shared"),
    )


def representative_cases(rows: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Highest and lowest scoring positive and negative; ties go to the smallest key."""
    y, score, key = F.col(roles.label), F.col(roles.score), F.col(roles.key)
    highest = F.struct((-score).alias("order"), key.alias("key"))
    lowest = F.struct(score.alias("order"), key.alias("key"))
    facts = {
        "ranked_positive": F.min(F.when(y == 1, highest)),
        "missed_positive": F.min(F.when(y == 1, lowest)),
        "ranked_negative": F.min(F.when(y == 0, lowest)),
        "unnecessary_negative": F.min(F.when(y == 0, highest)),
    }
    wide = rows.agg(*(f.alias(n) for n, f in facts.items()))
    long = wide.unpivot([], list(facts), "case_group", "found")
    return long.select(
        "case_group",
        F.col("found.key").alias(roles.key),
        F.col("case_group").endswith("positive").cast("int").alias(roles.label),
        F.abs(F.col("found.order")).alias(roles.score),
    )


def hash_sample(rows: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n rows in hash order: the same rows whatever the partitioning.

    The hashes are evenly spread, so the n smallest lie below a bound a little above n / rows; only rows below it are
    sorted. Should they be too few after all, the bound is doubled.
    """
    hashed = rows.withColumn("_hash", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))))
    total = rows.count()
    wanted = n + 6 * math.sqrt(n) + 10
    while True:
        share = min(1.0, wanted / max(total, 1))
        bound = F.lit(f"{int(share * (16**8 - 1)):08x}g")  # above every hash that begins with these digits
        near = hashed.where(F.col("_hash") < bound)
        if share == 1.0 or near.count() >= n:
            return near.orderBy("_hash", key).limit(n).drop("_hash")
        wanted *= 2
