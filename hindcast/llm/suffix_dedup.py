"""Repeated passages by a sparse suffix array.

Only suffixes that begin at content-selected minimiser positions are retained: equal passages select equal positions, a few
per cent of all. They are sorted over the whole corpus by the gram they begin with and then by the context around it, and
each is compared with its neighbours only. Suffixes next to one with the same beginning are shared; where the
contexts differ, every window of ``window`` words in them is hashed and grouped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import kept, shape, unpacked
from hindcast.llm.spans import branch_masks, covered, covered_spans, full_mask, paths, with_paths


def compared(suffixes: DataFrame) -> DataFrame:
    """The suffixes with a neighbour of the same beginning, and what the neighbours say.

    ``whole``: a neighbour agrees in the whole context, so all its windows are repeated. ``source``: the context differs
    from that of a neighbour with the same beginning, so its windows have to be compared one by one. The first and last row
    of a partition have a neighbour unseen and count as sources.
    """
    order = ["seed", "body", "doc_id", "h", "start"]
    # The document and place in the key split a beginning that stands in a third of the corpus over many partitions.
    ordered = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, waiting = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if waiting is not None:
                yield judge(waiting, before, (batch.column(4)[0].as_py(), batch.column(5)[0].as_py()))
                before = (waiting.column(4)[-1].as_py(), waiting.column(5)[-1].as_py())
            waiting = batch
        if waiting is not None:
            yield judge(waiting, before, None)

    def judge(batch: pa.RecordBatch, before: tuple | None, after: tuple | None) -> pa.RecordBatch:
        seed, body = batch.column(4).to_numpy(), batch.column(5).to_numpy()
        same_seed, same_body = seed[1:] == seed[:-1], (seed[1:] == seed[:-1]) & (body[1:] == body[:-1])
        # An unseen neighbour: perhaps the same beginning, not known to be the same context.
        first = (True, False) if before is None else (before[0] == seed[0], before == (seed[0], body[0]))
        last = (True, False) if after is None else (after[0] == seed[-1], after == (seed[-1], body[-1]))
        seed_before, body_before = np.concatenate([[first[0]], same_seed]), np.concatenate([[first[1]], same_body])
        seed_after, body_after = np.concatenate([same_seed, [last[0]]]), np.concatenate([same_body, [last[1]]])
        whole = body_before | body_after
        source = (~body_before & seed_before) | (~body_after & seed_after)
        keep = pa.array(whole | source)
        columns = [*batch.columns, pa.array(whole), pa.array(source)]
        return pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["doc_id", "h", "start", "n", "seed", "body", "whole", "source"])

    plain = ordered.select("doc_id", "h", "start", "n", "seed", "body")
    return plain.mapInArrow(neighbours, shape(plain, "doc_id", "h", "start", "n", "seed", "body", whole="boolean", source="boolean"))


def repeated_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, from_word, to_word: every maximal run of words covered by windows that occur elsewhere too.

    Words are runs of characters other than the six ASCII blanks, unchanged, counted from 0; to_word is exclusive. A window
    is ``window`` consecutive words; it may occur in the same document or another one, overlapping included. Documents
    without such a run, null and empty texts and texts shorter than a window have no row; a repeated document row repeats
    its runs. Extra columns are ignored.
    """
    suffixes = kept(paths(docs, window))
    shared = kept(compared(suffixes))
    sources = shared.where("source")
    masks = kept(branch_masks(docs, sources.select("seed", "body", "doc_id", "h", "start", "n", F.lit(1).cast("long").alias("copies")), window))
    part = sources.join(masks, ["seed", "body"]).select("doc_id", "h", "start", "n", "mask")
    whole = shared.where("whole").select("doc_id", "h", "start", "n", full_mask("n").alias("mask"))
    own = suffixes.where("own != 0").select("doc_id", "h", "start", "n", F.col("own").alias("mask"))
    marked = with_paths(docs, whole.union(part).union(own)).where("paths is not null")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, low, high = [], [], []
            for i, (text, own) in enumerate(zip(unpacked(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                for a, b in covered_spans(covered(len((text or b"").split()), own, window)):
                    index.append(i)
                    low.append(a)
                    high.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["doc_id", "from_word", "to_word"])

    return marked.mapInArrow(spans, shape(marked, "doc_id", from_word="long", to_word="long"))
