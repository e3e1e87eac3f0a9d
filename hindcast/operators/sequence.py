"""Fixed-length event sequences per transaction, from strictly earlier events of its entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators.contract import require_columns
from hindcast.operators.ordered import Layout, attach, before, profile, quantiles
from hindcast.operators.pit import entity_features, spread_name, spread_unknown
from hindcast.roles import EntityFeatures, Roles

EVENT = "struct<log_amount:double,log_gap:double>"


def event_features(rows: DataFrame, roles: Roles = Roles(), entity: str = "card") -> DataFrame:
    """log1p of the amount and of the gap to the entity's previous distinct timestamp (0 at first)."""
    spread = spread_unknown(rows, (entity,), roles.key)
    group = (entity, spread_name((entity,)))
    made = entity_features(spread, EntityFeatures("_entity", group, recency=True), roles)
    gap = F.when(F.col(entity).isNotNull(), F.col("recency__entity"))
    return made.select(
        *rows.columns,
        F.log1p(F.col(roles.amount).cast("double")).alias("log_amount"),
        F.log1p(F.greatest(F.coalesce(gap, F.lit(0)), F.lit(0)).cast("double")).alias("log_gap"),
    )


def prior_events(
    events: DataFrame, length: int, roles: Roles = Roles(), entity: str = "card",
    layout: Layout | None = None, block: int | None = None,
) -> DataFrame:
    """The last ``length - 1`` events of the entity before the row's timestamp, oldest first.

    Only the last ``length - 1`` events of a timestamp can ever be seen, so a crowded timestamp is
    trimmed before it is collected. A large entity is cut into blocks of batches, each block
    preceded by the few batches its first rows look back to.
    """
    depth = length - 1
    known = events.where(F.col(entity).isNotNull())
    layout = layout or profile(known, roles.time, ((entity,),))
    newest = Window.partitionBy(entity, roles.time).orderBy(F.desc(roles.key))
    tail = known.select(entity, roles.time, roles.key, "log_amount", "log_gap").withColumn(
        "_newest", F.row_number().over(newest)
    )
    batches = (
        tail.where(F.col("_newest") <= depth)
        .groupBy(entity, roles.time)
        .agg(F.sort_array(F.collect_list(F.struct(roles.key, "log_amount", "log_gap"))).alias("_tail"))
        .withColumn("_tail", F.transform("_tail", lambda e: F.struct(e["log_amount"].alias("log_amount"), e["log_gap"].alias("log_gap"))))
    )
    partition = [entity]
    if layout.splits((entity,)):
        size = block or max(layout.rows_per_chunk, 16 * length)
        numbered = batches.select(entity, roles.time).withColumn("_one", F.lit(1).cast("long"))
        numbered = before(numbered, (entity,), roles.time, {"_index": "_one"}, layout, unique=True)
        batches = batches.join(numbered.select(entity, roles.time, "_index"), [entity, roles.time])
        home = F.floor(F.col("_index") / size)
        spills = F.col("_index") % size >= size - depth
        homes = F.when(spills, F.array(home, home + 1)).otherwise(F.array(home))
        batches = batches.withColumn("_home", home).withColumn("_block", F.explode(homes))
        partition.append("_block")
    earlier = Window.partitionBy(*partition).orderBy(roles.time).rowsBetween(-depth, -1)
    history = F.flatten(F.collect_list("_tail").over(earlier))
    states = batches.withColumn("_history", history)
    if len(partition) == 2:
        states = states.where(F.col("_block") == F.col("_home"))
    kept = F.slice("_history", F.greatest(F.size("_history") - depth + 1, F.lit(1)), depth)
    states = states.select(entity, roles.time, kept.alias("history"))
    unknown = spread_name((entity,))
    spread = spread_unknown(events, (entity,), roles.key)
    found = attach(spread, states.withColumn(unknown, F.lit(0)), (entity, roles.time, unknown), roles.key)
    none = F.array().cast(f"array<{EVENT}>")
    return found.select(*events.columns, F.coalesce("history", none).alias("history"))


def padded(length: int, padding: float = 0.0) -> Column:
    """History and the current event, left-padded to ``length``."""
    pad = F.struct(F.lit(padding).alias("log_amount"), F.lit(padding).alias("log_gap"))
    current = F.struct(F.col("log_amount").alias("log_amount"), F.col("log_gap").alias("log_gap"))
    gap = F.lit(length - 1) - F.size("history")
    return F.concat(F.array_repeat(pad, gap), F.col("history"), F.array(current))


def sequences(
    rows: DataFrame, length: int, roles: Roles = Roles(), entity: str = "card", padding: float = 0.0,
    layout: Layout | None = None, block: int | None = None, validate: bool = True,
) -> DataFrame:
    """Key, time, label, history length and the padded sequence; other columns pass through."""
    if length < 2:
        raise ValueError("a sequence needs length 2 or more")
    if validate:
        require_columns(rows, {roles.key, roles.time, roles.amount, roles.label, entity}, "the sequence input")
        require_valid_input(rows, roles)
    events = event_features(rows, roles, entity)
    found = prior_events(events, length, roles, entity, layout, block)
    return found.select(
        *rows.columns, F.size("history").alias("history_length"), padded(length, padding).alias("sequence")
    )


def input_guards(rows: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """One row with the number of violations of each input rule."""
    repeated = rows.groupBy(roles.key).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1))
    label, amount = F.col(roles.label), F.col(roles.amount)
    facts = rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col(roles.key).isNull()).alias("null_keys"),
        F.count_if(F.col(roles.time).isNull()).alias("null_times"),
        F.count_if(amount.isNull() | F.isnan(amount)).alias("null_amounts"),
        F.count_if(amount < 0).alias("negative_amounts"),
        F.count_if(label.isNull() | ~label.isin(0, 1)).alias("bad_labels"),
    )
    return facts.withColumn("repeated_keys", repeated.scalar())


def require_valid_input(rows: DataFrame, roles: Roles = Roles()) -> None:
    facts = input_guards(rows, roles).first().asDict()
    if facts.pop("row_count") == 0:
        raise ValueError("the sequence input is empty")
    broken = {k: v for k, v in facts.items() if v}
    if broken:
        raise ValueError(f"the sequence input is invalid: {broken}")


def dataset_guards(dataset: DataFrame, roles: Roles = Roles(), length: int = 10) -> DataFrame:
    """Facts a stored sequence dataset must satisfy before training."""
    broken = F.exists(
        "sequence", lambda e: F.isnan(e["log_amount"]) | F.isnan(e["log_gap"]) | e["log_amount"].isNull() | e["log_gap"].isNull()
    )
    label = F.col(roles.label)
    return dataset.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.size("sequence") != length).alias("wrong_length"),
        F.count_if(broken).alias("non_finite"),
        F.count_if(label.isNull() | ~label.isin(0, 1)).alias("bad_labels"),
        F.count_if((F.col("history_length") < 0) | (F.col("history_length") >= length)).alias("bad_history"),
    )


def sequence_summary(dataset: DataFrame, length: int, split: str, roles: Roles = Roles()) -> DataFrame:
    """Counts, rates, history statistics and the time range of one split."""
    size = F.col("history_length")
    (median,) = quantiles(dataset, {"m": size}, [0.5])["m"]
    return dataset.agg(
        F.lit(split).alias("split"),
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.col(roles.label).cast("long")).alias("positives"),
        F.avg(F.col(roles.label).cast("double")).alias("positive_rate"),
        F.lit(length).alias("sequence_length"),
        F.avg(size.cast("double")).alias("mean_history"),
        F.lit(median).alias("median_history"),
        F.count_if(size > 0).alias("rows_with_history"),
        F.avg((size > 0).cast("int")).alias("share_with_history"),
        F.count_if(size >= length - 1).alias("rows_at_maximum"),
        F.avg((size >= length - 1).cast("int")).alias("share_at_maximum"),
        F.min(roles.time).alias("first_time"),
        F.max(roles.time).alias("last_time"),
    )
