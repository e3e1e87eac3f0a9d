"""Hard negatives by angular triangle filtering.

Each row stores its norm and its angles to a few reference directions. On the sphere the angle between two vectors lies
between the difference and the sum of their angles to any reference; with the norms that bounds the inner product. Rows
are put in cells of equal label and similar angles, and an anchor is scored, in integers, against the cells whose bounds
overlap the window of scores that it looks for. The bounds are widened by more than any rounding, so nothing is lost.

The stated anchors meet all rows in blocks: both sides of a task are bounded. A part of the blocks is searched first; what
it finds raises the lower ends of the windows, so that the search of all blocks returns few rows beyond the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hindcast.llm.common import kept, shape
from hindcast.llm.vector_codes import integers, matrix

#: Rows and anchors that meet in one task, and the rows of a cell.
BLOCK_ROWS, BLOCK_ANCHORS, CELL_ROWS = 8192, 2048, 64
#: Reference directions, and the bounded sample of rows from which they are chosen.
REFERENCES, SAMPLE = 16, 2048
#: One block in so many is searched first.
FIRST_SHARE = 32
#: Anchors whose scores are held at once.
_HELD = 256
#: Wider than the error of an angle computed in doubles (1e-8 near zero).
_ANGLE_SLACK = 1e-6
_OPEN = 1 << 60


def reference_directions(sample: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors far from each other: each next one is the sample row whose nearest reference is farthest."""
    norms = np.sqrt((sample * sample).sum(axis=1))
    units = sample[norms > 0] / norms[norms > 0, None]
    if not len(units):
        return np.zeros((0, sample.shape[1]))
    chosen = [0]
    nearest = units @ units[0]
    while len(chosen) < min(count, len(units)) and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def angles_to(values: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles (n, references); a zero vector counts as orthogonal, its score is zero whatever the angle."""
    cosines = np.divide(values @ references.T, norms[:, None], out=np.zeros((len(values), len(references))), where=norms[:, None] > 0)
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def score_bounds(angles: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (anchors, cells) of inner products.

    ``angles`` and ``norms`` are the anchors', [low, high] the cells' windows of angles (cells, references), [least, most] those
    of their norms.
    """
    near = np.zeros((len(angles), len(low)))
    far = np.full(near.shape, np.pi)
    for r in range(angles.shape[1]):
        own = angles[:, r, None]
        near = np.maximum(near, np.maximum(low[None, :, r] - own, own - high[None, :, r]))
        far = np.minimum(far, np.minimum(own + high[None, :, r], 2 * np.pi - own - low[None, :, r]))
    top, bottom = np.cos(np.clip(near - _ANGLE_SLACK, 0, np.pi)), np.cos(np.clip(far + _ANGLE_SLACK, 0, np.pi))
    slack = 1.0 + 1e-9 * norms[:, None] * most
    upper = norms[:, None] * np.where(top >= 0, most, least) * top + slack
    lower = norms[:, None] * np.where(bottom >= 0, least, most) * bottom - slack
    return lower, upper


def _cells(labels: np.ndarray, angles: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows by label, nearest reference and angle, and where its cells begin."""
    nearest = angles.argmin(axis=1) if angles.shape[1] else np.zeros(len(labels), np.int64)
    least = angles.min(axis=1) if angles.shape[1] else norms
    order = np.lexsort((least, nearest, labels))
    sizes = np.flatnonzero(np.diff(labels[order], prepend=labels[order][:1] - 1))
    starts = [np.arange(a, b, CELL_ROWS) for a, b in zip(sizes, [*sizes[1:], len(labels)], strict=True)]
    return order, np.concatenate([*starts, [len(labels)]]).astype(np.int64)


def best_in_windows(rows: DataFrame, asked: DataFrame, width: int, largest: int, k: int, same_label: bool) -> DataFrame:
    """(anchor, window, score, row, vec_id): the k best rows of each window of each anchor, as they come from the blocks.

    ``rows`` has row, vec_id, group (a number for the label), ints, norm, angles; ``asked`` the same and ``windows``, an array
    of (window, low, high), ends included. A row never answers itself. ``largest`` bounds the components.
    """
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    chunks = max(1, -(-asked.count() // BLOCK_ANCHORS))
    kind = np.float64 if width * largest * largest < 1 << 53 else np.int64
    result = "anchor long, window int, score long, row long, vec_id long"

    def search(wanted: pa.Table, data: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if wanted.num_rows and data.num_rows:
            _search(wanted, data, width, kind, k, same_label, found)
        columns = zip(*found, strict=True) if found else [()] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("anchor", "window", "score", "row", "vec_id"), columns, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)})

    def over(asked: DataFrame, low: int, high: int) -> DataFrame:
        """Blocks from ``low`` up to ``high``."""
        every = F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("block")
        left = asked.select(every, F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk"), "row", "group", "ints", "norm", "angles", "windows")
        block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")
        right = rows.select(block, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "row", "vec_id", "group", "ints", "norm", "angles")
        right = right.where((F.col("block") >= low) & (F.col("block") < high))
        met = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(search, result)
        place = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"))
        return met.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)

    first = max(1, blocks // FIRST_SHARE)
    if first == blocks:
        return over(asked, 0, blocks)
    reached = over(asked, 0, first).groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") == k)
    floors = kept(reached.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "floor"))).alias("floors")))
    tight = F.transform("windows", lambda w: w.withField("low", F.greatest(w["low"], F.try_element_at("floors", w["window"]))))
    raised = asked.join(floors, asked["row"] == floors["anchor"], "left").withColumn("windows", F.when(F.col("floors").isNull(), F.col("windows")).otherwise(tight))
    return over(kept(raised.select(*asked.columns)), 0, blocks)


def _search(wanted: pa.Table, data: pa.Table, width: int, kind: type, k: int, same_label: bool, found: list[tuple]) -> None:
    """One block of rows against one chunk of anchors."""
    columns = {n: data[n].combine_chunks() for n in ("ints", "angles")} | {n: data[n].to_numpy() for n in ("row", "group", "norm")}
    angles = columns["angles"].flatten().to_numpy().reshape(data.num_rows, -1)
    order, starts = _cells(columns["group"], angles, columns["norm"])
    values = matrix(columns["ints"], width)[order].astype(kind)
    groups, ids, norms, angles = columns["group"][order], columns["row"][order], columns["norm"][order], angles[order]
    names = data["vec_id"].combine_chunks().take(pa.array(order))
    nameless, names = names.is_null().to_numpy(zero_copy_only=False), names.fill_null(0).to_numpy()
    cuts = starts[:-1]
    low, high = np.minimum.reduceat(angles, cuts), np.maximum.reduceat(angles, cuts)
    least, most = np.minimum.reduceat(norms, cuts), np.maximum.reduceat(norms, cuts)
    for at in range(0, wanted.num_rows, _HELD):
        part = wanted.slice(at, _HELD)
        points = matrix(part["ints"].combine_chunks(), width).astype(kind)
        own_angles = part["angles"].combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)
        own_groups, own_ids, windows = part["group"].to_numpy(), part["row"].to_pylist(), part["windows"].to_pylist()
        lower, upper = score_bounds(own_angles, part["norm"].to_numpy(), low, high, least, most)
        ends = np.array([(min(w["low"] for w in ws), max(w["high"] for w in ws)) for ws in windows], np.float64)
        overlap = (upper >= ends[:, :1]) & (lower <= ends[:, 1:])
        overlap &= (own_groups[:, None] == groups[cuts]) == same_label
        scores = np.full((part.num_rows, len(values)), -2 * _OPEN, np.int64)
        for cell in np.flatnonzero(overlap.any(axis=0)):
            met = np.flatnonzero(overlap[:, cell])
            inside = slice(starts[cell], starts[cell + 1])
            scores[met, inside] = points[met] @ values[inside].T
        for i, anchor in enumerate(own_ids):
            scores[i, ids == anchor] = -2 * _OPEN
            for window in windows[i]:
                hits = np.flatnonzero((scores[i] >= window["low"]) & (scores[i] <= window["high"]))
                if len(hits) > k:
                    worst = np.partition(scores[i, hits], len(hits) - k)[len(hits) - k]
                    hits = hits[scores[i, hits] >= worst]
                hits = hits[np.lexsort((ids[hits], names[hits], nameless[hits], -scores[i, hits]))[:k]]
                found.extend((anchor, window["window"], int(scores[i, j]), int(ids[j]), None if nameless[j] else int(names[j])) for j in hits)


def mine(
    vectors: DataFrame, is_anchor: Column, column: str = "embedding", positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and ``column``; a component x counts as floor(scale * x), a score is the integer inner product
    with the anchor, higher scores come first and ties go to the smaller vec_id (nulls last). The anchors are the rows that
    ``is_anchor`` holds for. An anchor's positives are its first ``positives`` other rows of the same label. For each of them
    come the first ``negatives`` rows of other labels whose score lies between ``least`` and ``most`` percent of the
    positive's, ends included; none where the positive's score is negative. Rows with a null label, a null vector or null or
    non-finite components take no part. Rows that repeat a vec_id are rows of their own. Shorter vectors are filled with zeros.
    Without anchors, positives or negatives the result is empty; other columns are ignored. Raises ValueError where components
    are so large that a score might not fit (2**55).
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", column, F.coalesce(is_anchor, F.lit(False)).alias("asks")).where("label is not null")
    width = max(1, rows.agg(F.max(F.size(column))).first()[0] or 0)
    limit = isqrt((1 << 55) // width)
    taken = integers(rows, column, scale, limit).select(F.monotonically_increasing_id().alias("row"), "vec_id", F.xxhash64("label").alias("group"), "ints", "asks")
    taken = kept(taken)
    sample = taken.orderBy(F.xxhash64("ints"), "ints").limit(SAMPLE).select("ints").collect()
    references = reference_directions(matrix(pa.array([r["ints"] for r in sample], pa.list_(pa.int64())), width).astype(np.float64))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix(batch.column(3), width).astype(np.float64)
            norms = np.sqrt((values * values).sum(axis=1))
            angles = angles_to(values, norms, references)
            offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(references))
            lists = pa.ListArray.from_arrays(offsets, pa.array(angles.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norms), lists], names=[*batch.schema.names, "norm", "angles"])

    stored = kept(taken.mapInArrow(measured, shape(taken, *taken.columns, norm="double", angles="array<double>")))
    largest = stored.agg(F.max(F.array_max(F.transform("ints", F.abs)))).first()[0] or 0
    anchors = stored.where("asks")
    whole = F.array(F.struct(F.lit(0).alias("window"), F.lit(-_OPEN).cast("long").alias("low"), F.lit(_OPEN).cast("long").alias("high")))
    best = kept(best_in_windows(stored, anchors.withColumn("windows", whole), width, largest, positives, True))
    # 100 * score has room in a long: scores stay below 2**55.
    bounds = F.struct(F.col("rank").alias("window"), F.expr(f"({least} * score + 99) div 100").alias("low"), F.expr(f"{most} * score div 100").alias("high"))
    windows = best.where("score >= 0").select("anchor", bounds.alias("w")).where("w.low <= w.high").groupBy("anchor").agg(F.collect_list("w").alias("windows"))
    asked = kept(anchors.join(windows, anchors["row"] == windows["anchor"]).drop("anchor"))
    found = kept(best_in_windows(stored, asked, width, largest, negatives, False))
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    chosen = best.select("anchor", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        found.join(chosen, ["anchor", "window"])
        .join(named, "anchor")
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
