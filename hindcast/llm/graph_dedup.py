"""Substring dedup on a compacted De Bruijn graph of token windows.

Every window of ``window`` words is an edge from its first to its last window - 1 words. Consecutive edges that share a
minimiser form a path; identical paths collapse into one compacted path with a multiplicity, through Spark aggregations and
joins. Where only one path leaves a minimiser the graph does not branch, and the path is repeated as a whole or not at all.
Where paths branch, the words at their source coordinates are read again and compared edge by edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import kept, shape, unpacked
from hindcast.llm.spans import branch_masks, covered, covered_spans, full_mask, paths, with_paths


def repeated_paths(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, h, start, n, mask: paths with windows whose words start anywhere else too, same document included."""
    every = kept(paths(docs, window))
    # Counted before anything is joined, so that a passage in a third of the documents is one row a task.
    met = every.groupBy("seed").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1").select("seed")
    again = kept(every.join(met, "seed"))

    at = [F.first(c).alias(c) for c in ("doc_id", "h", "start", "n")]  # of one row: all see the same rows in the same order
    compact = kept(again.groupBy("seed", "body").agg(F.count(F.lit(1)).alias("copies"), *at))
    forks = compact.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("seed")
    parts = branch_masks(docs, compact.join(forks, "seed", "left_semi"), window)
    whole = compact.where("copies > 1").select("seed", "body", full_mask("n").alias("mask"))
    masks = kept(whole.union(parts).groupBy("seed", "body").agg(F.bit_or("mask").alias("mask")))

    across = again.join(masks, ["seed", "body"]).select("doc_id", "h", "start", "n", "mask")
    return across.union(every.where("own != 0").select("doc_id", "h", "start", "n", F.col("own").alias("mask")))


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, h, n_words, n_removed, text, spans: one row per document row without its repeated words.

    Words are runs of characters other than the six ASCII blanks, taken unchanged from the whole text. A word is removed
    when a window of ``window`` words that covers it starts anywhere else too, overlapping places included; windows are
    judged on the input. ``text`` holds the kept words joined by one space, ``spans`` the removed word ranges. Null and
    empty texts have no words; texts shorter than a window keep all; rows that repeat a document repeat its windows. Extra
    columns are ignored.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = unpacked(batch.column(2)), batch.column(3)
            n_words, n_removed, left, spans = [], [], [], []
            for i, text in enumerate(texts):
                words = (text or b"").split()
                own = found[i].as_py()
                if own:
                    hidden = covered(len(words), own, window)
                    spans.append([{"from": a, "to": b} for a, b in covered_spans(hidden)])
                    n_removed.append(int(hidden.sum()))
                    left.append(b" ".join([w for w, gone in zip(words, hidden.tolist(), strict=True) if not gone]))
                else:
                    spans.append([])
                    n_removed.append(0)
                    left.append(b" ".join(words))
                n_words.append(len(words))
            arrays = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())]
            arrays += [pa.array([hashlib.sha256(x).hexdigest() for x in left]), pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["doc_id", "h", "n_words", "n_removed", "text", "text_sha256", "spans"])

    marked = with_paths(docs, repeated_paths(docs, window))
    return marked.mapInArrow(apply, shape(marked, "doc_id", "h", n_words="long", n_removed="long", text="string", text_sha256="string", spans="array<struct<`from`:int,`to`:int>>"))
