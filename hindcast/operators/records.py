"""Tables handed to people and later systems: predictions, cases, entities, snapshots, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.scalars import ratio
from hindcast.operators.ordered import order_edges, with_chunk
from hindcast.operators.policy import CostMatrix, ReviewPolicy, action_costs, apply_policy, select_for_review
from hindcast.operators.splits import quantile_edges, right_closed_bin
from hindcast.roles import Roles
from hindcast.session import cut_lineage

# Lower bounds of the reporting bands.
RISK_BANDS = (("low", 0.0), ("medium", 0.05), ("high", 0.20), ("critical", 0.50))


def risk_band(score: Column) -> Column:
    band = F.lit(RISK_BANDS[0][0])
    for name, low in RISK_BANDS[1:]:
        band = F.when(score >= low, F.lit(name)).otherwise(band)
    return F.when(score.isNotNull(), band)


def predictions(
    rows: DataFrame, policy: ReviewPolicy, costs: CostMatrix, version: str, roles: Roles = Roles()
) -> DataFrame:
    """Probability, band, recommended action and its expected cost per row."""
    decided = action_costs(apply_policy(rows.select(roles.key, roles.score), policy, roles), costs, roles.score)
    approve, review, _ = policy.actions
    cost = (
        F.when(F.col("action") == approve, F.col("approve_cost"))
        .when(F.col("action") == review, F.col("review_cost"))
        .otherwise(F.col("block_cost"))
    )
    return decided.select(
        roles.key,
        F.col(roles.score).alias("probability"),
        risk_band(F.col(roles.score)).alias("risk_band"),
        F.col("action").alias("recommended_action"),
        cost.alias("expected_cost"),
        F.lit(version).alias("model_version"),
    )


#: Reviewed rows that are ranked in one task.
RANKED_ROWS = 500_000


def investigation_queue(rows: DataFrame, policy: ReviewPolicy, roles: Roles = Roles()) -> DataFrame:
    """One open case per reviewed row, with its priority rank.

    Scores are cut into chunks; a row's rank is its place in its chunk after all better chunks.
    """
    chosen = cut_lineage(select_for_review(rows.select(roles.key, roles.score), policy, roles).withColumn("_down", -F.col(roles.score)))
    cut = with_chunk(chosen, "_down", order_edges(chosen, "_down", -(-chosen.count() // RANKED_ROWS)))
    counts = cut.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    # One row per chunk.
    start = F.sum("_n").over(Window.orderBy("_chunk")) - F.col("_n")
    place = F.row_number().over(Window.partitionBy("_chunk").orderBy("_down", F.asc(roles.key)))
    placed = cut.withColumn("_place", place).join(counts.select("_chunk", start.alias("_start")), "_chunk")
    return placed.select(roles.key, F.lit("open").alias("case_status"), (F.col("_start") + F.col("_place")).cast("int").alias("priority"))


def entities(rows: DataFrame, kinds: list[str], roles: Roles = Roles()) -> DataFrame:
    """Each entity value once, hashed, with the keys of its first and last transaction."""
    texts = rows.select(roles.key, roles.time, *(F.col(k).cast("string").alias(k) for k in kinds))
    long = texts.unpivot([roles.key, roles.time], kinds, "entity_type", "value").where(F.col("value").isNotNull())
    place = F.struct(roles.time, roles.key)
    return long.groupBy("entity_type", F.sha2("value", 256).alias("value_hash")).agg(
        F.min(place)[roles.key].alias("first_key"), F.max(place)[roles.key].alias("last_key")
    )


def feature_snapshots(features: DataFrame, key: str, available_at: str, version: str) -> DataFrame:
    """Key, version, the features as JSON, and when they became available."""
    names = [c for c in features.columns if c not in (key, available_at)]
    return features.select(
        key,
        F.lit(version).alias("feature_version"),
        F.to_json(F.struct(*names)).alias("payload"),
        F.col(available_at).alias("available_at"),
    )


def drift(rows: DataFrame, period: Column, columns: list[str], score: str, bins: int = 10) -> DataFrame:
    """Volume, missing rate and population stability of the score per period against the first period."""
    tagged = rows.withColumn("period", period)
    first = tagged.agg(F.min("period")).first()[0]
    edges = quantile_edges(tagged.where(F.col("period") == first), score, bins)
    binned = tagged.withColumn("_bin", right_closed_bin(F.col(score), edges))
    counts = binned.groupBy("period", "_bin").agg(F.count(F.lit(1)).alias("n"))
    volume = binned.groupBy("period").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg(score).alias("mean_score"),
        *(F.avg(F.col(c).isNull().cast("int")).alias(f"{c}_null_rate") for c in columns),
    )
    share = counts.join(volume.select("period", "row_count"), "period").withColumn("share", F.col("n") / F.col("row_count"))
    base = share.where(F.col("period") == first).select("_bin", F.col("share").alias("base"))
    bin_list = F.sequence(F.lit(0), F.lit(max(len(edges) - 2, 0)))
    grid = volume.select("period", F.explode(bin_list).alias("_bin"))
    compared = grid.join(base, "_bin", "left").join(share.select("period", "_bin", "share"), ["period", "_bin"], "left")
    # A bin with no row in a period counts with a small share, so that the index stays finite.
    a, b = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-4)) for c in ("share", "base"))
    index = compared.groupBy("period").agg(F.sum((a - b) * F.ln(a / b)).alias("stability_index"))
    start = volume.where(F.col("period") == first).select("row_count").scalar()
    return volume.join(index, "period").withColumn("volume_change", ratio(F.col("row_count"), start) - 1)
