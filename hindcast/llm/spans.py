"""Repeated word windows: cutting documents into paths of windows, comparing branching paths, and applying the result.

A path is a run of consecutive windows (of ``window`` words) that share a minimiser: the smallest hash among the
``SEED``-word grams inside a window. Equal windows have equal minimisers wherever they stand, so they always lie on paths
of the same minimiser, and a path is only as long as the window holds grams. All of this is exact; hashes of 64 bits are
only ever compared within one minimiser, itself 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import WordHashes, kept, keyed, mix, ngrams, packed, pieces, same_doc, shape, signed, sliding_min, split_all, texts_of, unpacked

#: Words in the grams among which a minimiser is chosen.
SEED = 8
#: Windows a path holds at most: its mask of repeated windows is one long.
PATH = 62


def paths(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, h, start, n, seed, body, own: every path of every document.

    ``start`` is the first window's first word, ``n`` the number of windows, ``seed`` the minimiser, ``body`` the hash of
    all words covered, ``own`` the windows (bits from the first) that occur twice in this document.
    """
    most = min(PATH, window - SEED + 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = texts_of(batch)
            for low, high in pieces(texts):
                words, starts = split_all(texts[low:high])
                made = _paths(hashes.of(words), starts, window, most)
                if made is not None:
                    doc, *columns = made
                    index = pa.array(doc + low)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), *columns], names=["doc_id", "h", "start", "n", "seed", "body", "own"])

    rows = keyed(docs).select("doc_id", "h", "text")
    return rows.mapInArrow(scan, shape(rows, "doc_id", "h", start="int", n="int", seed="long", body="long", own="long"))


def _paths(tokens: np.ndarray, starts: np.ndarray, window: int, most: int):
    if len(tokens) < window:
        return None
    grams, windows = ngrams(tokens, SEED, window)
    seeds = sliding_min(grams, window - SEED + 1)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(windows)]
    valid = np.flatnonzero(np.arange(len(windows)) + window <= starts[1:][doc])
    if not len(valid):
        return None
    doc, seeds, windows = doc[valid], seeds[valid], windows[valid]
    # Windows of different documents are window - 1 places apart, so a gap also ends a path.
    begin = np.concatenate([[True], (np.diff(valid) != 1) | (seeds[1:] != seeds[:-1])])
    first = np.flatnonzero(begin)
    within = np.arange(len(valid)) - np.repeat(first, np.diff(np.append(first, len(valid))))
    begin |= within % most == 0
    first = np.flatnonzero(begin)
    n = np.diff(np.append(first, len(valid)))
    last = first + n - 1
    body = mix(mix(windows[first], windows[last]), n.astype(np.uint64))
    mine = mix(windows, doc.astype(np.uint64))
    order = np.argsort(mine, kind="stable")
    equal = mine[order][1:] == mine[order][:-1]
    own = np.zeros(len(first), np.uint64)
    if equal.any():
        twice = np.zeros(len(mine), bool)
        twice[order[1:][equal]] = twice[order[:-1][equal]] = True
        place = (np.arange(len(mine)) - np.repeat(first, n)).astype(np.uint64)
        own = np.bitwise_or.reduceat(twice.astype(np.uint64) << place, first)
    return doc[first], pa.array((valid[first] - starts[doc[first]]).astype(np.int32)), pa.array(n.astype(np.int32)), signed(seeds[first]), signed(body), signed(own)


def branch_masks(docs: DataFrame, branching: DataFrame, window: int) -> DataFrame:
    """seed, body, mask: which windows of the given paths also lie on another of them, or on the same one twice.

    ``branching`` names a source coordinate (doc_id, h, start, n) and the number of copies of each path; the words there
    are read again and every window becomes an edge of its own, hashed with another seed than in the first pass.
    """
    asked = branching.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "n", "copies", "seed", "body")).alias("asked"))
    rows = packed(docs)
    joined = rows.join(asked, same_doc(rows, asked)).select(rows["packed"], asked["asked"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(1)
        for batch in batches:
            texts = unpacked(batch.column(0))
            column = batch.column(1)
            for low, high in pieces(texts):
                words, starts = split_all(texts[low:high])
                windows = ngrams(hashes.of(words), window)[0]
                lists = column.slice(low, high - low)
                asked = lists.flatten()
                doc = np.repeat(np.arange(high - low), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                start, n, copies, seed, body = (asked.field(i).to_numpy(zero_copy_only=False) for i in range(5))
                path = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(path)) - np.repeat(np.cumsum(n) - n, n)
                edges = windows[(starts[:-1][doc] + start)[path] + place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed[path]), pa.array(body[path]), signed(edges), pa.array(place.astype(np.int32)), pa.array(copies[path])],
                    names=["seed", "body", "edge", "place", "copies"],
                )

    # A repeated document row is read twice here; its windows are repeated in truth, and their copies say so already.
    edges = kept(joined.mapInArrow(expand, "seed long, body long, edge long, place int, copies long"))
    shared = edges.groupBy("seed", "edge").agg(F.sum("copies").alias("uses")).where("uses > 1").select("seed", "edge")
    hit = edges.join(shared, ["seed", "edge"])
    return hit.groupBy("seed", "body").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))


def full_mask(n: str) -> Column:
    """All of the first n bits."""
    return F.expr(f"shiftleft(1L, {n}) - 1")


def with_paths(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, h, packed, paths: every document row with the (start, n, mask) found for it; null where none."""
    lists = found.where("mask != 0").groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "n", "mask")).alias("paths"))
    rows = packed(docs)
    return rows.join(lists, same_doc(rows, lists), "left").select(rows["doc_id"], rows["h"], rows["packed"], lists["paths"])


def covered(n_words: int, found: list[dict] | None, window: int) -> np.ndarray:
    """Which words lie in a repeated window."""
    change = np.zeros(n_words + 1, np.int64)
    for path in found or ():
        bits, start = path["mask"], path["start"]
        if bits & (bits + 1) == 0:  # an unbroken row of windows from the first
            change[start] += 1
            change[start + bits.bit_length() + window - 1] -= 1
        else:
            for place in range(path["n"]):
                if bits >> place & 1:
                    change[start + place] += 1
                    change[start + place + window] -= 1
    return np.cumsum(change[:-1]) > 0


def covered_spans(hidden: np.ndarray) -> list[tuple[int, int]]:
    """Runs of covered words, from (inclusive) to (exclusive)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hidden, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
