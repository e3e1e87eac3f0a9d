"""Mixing sources to target weights by systematic sampling.

Each document of a source has the same expected number of copies: the source's target over its size. Laid end to end within
the source, after one random offset, a document is emitted once for every integer boundary its stretch crosses. Documents
are laid in the order of their sizes, so every stretch of the source's sizes is taken alike and the words come near the
target.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hindcast.llm.common import chosen_once, kept, shape, texts_of


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, h, source, size: the words (runs of other characters than the six ASCII blanks) of the whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([len((text or b"").split()) for text in texts_of(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], words], names=["doc_id", "h", "source", "size"])

    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), "source", text.alias("text"))
    return rows.mapInArrow(count, shape(rows, "doc_id", "h", "source", size="long"))


def targets(sized: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """source, source_size, target: one row per source, sources in code point order with null last.

    The sources share the whole size by their weights (repeated in order); none gets more than ``most`` times its size, and
    what that cuts off goes to the others by weight. The shares are min(cap, level * weight) for one level, found by going
    through the sources in the order in which a rising level fills them. The windows below run over one row per source.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((order - 1) % len(weights) + 1).cast("int")).cast("long")
    placed = total.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    open_size = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = placed.withColumn("level", open_size / open_weight)
    level = F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(everything)
    return levels.withColumn("level", level).select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def copies(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 7) -> DataFrame:
    """doc_id, h, source, size, source_size, target, copies: one row per document row; other columns are ignored.

    Null and empty texts have size 0; a source of size 0 has target 0 and takes nothing. Null is a source like any other,
    after all others. Rows that repeat a document are documents of their own. Reruns give the same copies.

    Ranks within a source come in three steps, so that neither a hot source nor a hot size is one window: distinct sizes
    within the source, chunks (three digits of a hash) within the size, rows within the chunk.
    """
    sized = kept(sizes(docs))
    goals = kept(targets(sized, weights, most))
    tie = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = sized.withColumn("tie", tie).withColumn("chunk", F.substring("tie", 1, 3)).withColumn("key", F.struct("source"))
    chunks = kept(rows.groupBy("key", "size", "chunk").agg(F.count(F.lit(1)).alias("n")))
    by_size = chunks.groupBy("key", "size").agg(F.sum("n").alias("n"))
    size_start = by_size.withColumn("size_start", F.sum("n").over(Window.partitionBy("key").orderBy("size")) - F.col("n")).drop("n")
    starts = chunks.withColumn("chunk_start", F.sum("n").over(Window.partitionBy("key", "size").orderBy("chunk")) - F.col("n")).drop("n")
    starts = starts.join(size_start, ["key", "size"]).withColumn("start", F.col("size_start") + F.col("chunk_start")).drop("size_start", "chunk_start")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key", "size", "chunk").orderBy("tie", "doc_id", "h")))
    ranked = ranked.join(starts, ["key", "size", "chunk"]).withColumn("rank", F.col("start") + F.col("rank"))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source").cast("string"), F.lit("")), F.when(F.col("source").isNull(), "null").otherwise(""))
    offset = F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.withColumn("rate", rate).withColumn("offset", offset).withColumn("key", F.struct("source")).drop("source")
    # One row per source: small against any documents, so the planner may broadcast it, and splits hot sources if not.
    crossed = F.floor(F.col("offset") + F.col("rate") * F.col("rank")) - F.floor(F.col("offset") + F.col("rate") * (F.col("rank") - 1))
    return ranked.join(goals, "key").select("doc_id", "h", "source", "size", "source_size", "target", F.least(crossed, F.lit(most)).cast("long").alias("copies"))


def mixed(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 7) -> DataFrame:
    """The columns of ``docs`` and ``copy``: each document once per copy (counted from 1) that the mix takes of it.

    Rows that repeat doc_id and text are one document here; its copies are the sum of theirs. A column called copy is
    replaced.
    """
    drawn = copies(docs, weights, most, seed).groupBy("doc_id", "h").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("times"))
    taken = chosen_once(docs, kept(drawn.where("copies > 0")))
    return taken.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "copy"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
