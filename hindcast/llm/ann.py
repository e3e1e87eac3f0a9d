"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

A rotation is learned on a bounded sample so that the signs of the rotated vectors lose little (iterative quantisation). The
64-bit codes are cut into eight substrings, each with an index of its own. By the pigeonhole principle a code within
Hamming radius R of the query has a substring within R // 8 bits of the query's: probing those buckets finds every such
code, and the floats of exactly these are compared. The radius is learned on the sample too, from the distances at which
true neighbours lie. Vectors longer than nearly all of the sample have no place in the ball that the codes describe: they
are few, and compared with every query. A query that finds fewer than k rows within it is searched again over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hindcast.llm.common import kept

#: Distinct vectors on which rotation and radius are fitted, and how many of them serve as queries there.
SAMPLE, SAMPLE_QUERIES = 8192, 512
#: Share of the sample's true neighbours that the radius must reach.
REACHED = 0.97
#: Share of the sample's vectors that lie within the ball which the codes describe.
INSIDE = 0.99
#: Distinct vectors and queries that meet in one task.
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 2048
BITS, PARTS = 64, 8
_DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


@dataclass(frozen=True)
class Codes:
    """The projection (one more row than the vectors have components), the search radius and the radius of the ball.

    The ball is the same wherever codes are made, so a vector's code never depends on the vectors beside it.
    """

    projection: np.ndarray
    radius: int
    ball: float

    def outside(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt((vectors * vectors).sum(axis=1)) > self.ball * (1 + 1e-9)

    def of(self, lifted: np.ndarray) -> np.ndarray:
        return np.packbits(lifted @ self.projection > 0, axis=1)


def lifted_rows(vectors: np.ndarray, ball: float) -> np.ndarray:
    """Candidates scaled by the ball and lifted onto the sphere: the angle then follows the inner product."""
    scaled = vectors / ball
    return np.column_stack([scaled, np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))])


def lifted_queries(vectors: np.ndarray) -> np.ndarray:
    return np.column_stack([vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), np.zeros(len(vectors))])


def fit_codes(vectors: np.ndarray, k: int, seed: int = 7, rounds: int = 25) -> Codes:
    """Principal directions, then rotations that bring the rows near the corners of the cube; as many as BITS need."""
    draw = np.random.default_rng(seed)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    ball = float(np.quantile(norms, INSIDE, method="higher"))
    lifted = lifted_rows(vectors[norms <= ball], ball)
    order = np.linalg.eigh(lifted.T @ lifted)[1][:, ::-1]
    parts, made = [], 0
    while made < BITS:
        width = min(BITS - made, lifted.shape[1])
        base = order[:, :width]
        turn = np.linalg.qr(draw.normal(size=(width, width)))[0]
        flat = lifted @ base
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        parts.append(base @ turn)
        made += width
    codes = Codes(np.column_stack(parts), BITS, ball)
    asked = vectors[:: max(1, len(vectors) // SAMPLE_QUERIES)][:SAMPLE_QUERIES]
    near = asked @ vectors.T
    top = np.argsort(-near, axis=1, kind="stable")[:, : k + 1]  # the query itself is among them
    rows, own = codes.of(lifted_rows(vectors, ball)), codes.of(lifted_queries(asked))
    distance = np.where(codes.outside(vectors)[top], 0, np.bitwise_count(rows[top] ^ own[:, None, :]).sum(axis=2))  # those are always met
    return Codes(codes.projection, int(np.quantile(distance, REACHED, method="higher")), ball)


def probe(codes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """Which codes (columns) share a bucket within radius // PARTS bits with a query (rows), in any substring's index."""
    found = np.zeros((len(queries), len(codes)), bool)
    within = _DISTANCE <= radius // PARTS
    for part in range(PARTS):
        order = np.argsort(codes[:, part], kind="stable")
        bounds = np.searchsorted(codes[order, part], np.arange(257))
        for value in np.unique(queries[:, part]):
            posting = np.concatenate([order[bounds[b] : bounds[b + 1]] for b in np.flatnonzero(within[value])])
            found[np.ix_(queries[:, part] == value, posting)] = True
    return found


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and vector (double) of the rows that take part: id and vector not null, finite and not all zero."""
    vector = F.col(column).cast("array<double>")
    rows = vectors.select("vec_id", vector.alias("vector")).where("vec_id is not null and vector is not null")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, column: str = "embedding", seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows found with the largest inner product, for each query.

    Both tables have vec_id and ``column``; extra columns are ignored. A query's candidates are all rows with another
    vec_id; ties go to the smaller vec_id; the score is the inner product of the original vectors in double precision. Rows
    that repeat vec_id and vector count once, equal vectors are compared once and named by their smallest ids. Null, zero
    and non-finite vectors and null ids take no part; neither do vectors with another number of components than the first
    of the sample. Without usable rows the result is empty.
    """
    rows, asked = usable(vectors, column), usable(queries, column)
    # Of equal vectors only the k + 1 smallest ids can be among k results; the rank is limited before the shuffle.
    ranked = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    classes = kept(ranked.groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("mark", F.xxhash64(F.lit(seed), "vector")))
    sample = [row["vector"] for row in classes.orderBy("mark", F.col("ids")[0]).select("vector").limit(SAMPLE).collect()]
    result = "query_id long, vec_id long, score double"
    if not sample:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = len(sample[0])
    model = fit_codes(np.array([v for v in sample if len(v) == width]), k, seed)
    classes, asked = classes.where(F.size("vector") == width), kept(asked.where(F.size("vector") == width).distinct())
    blocks = max(1, -(-classes.count() // BLOCK_VECTORS))

    def search(data: pa.Table, wanted: pa.Table, radius: int) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if data.num_rows and wanted.num_rows:
            base, points = _matrix(data["vector"]), _matrix(wanted["vector"])
            lists = data["ids"].combine_chunks()
            ids, starts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            codes, own = model.of(lifted_rows(base, model.ball)), model.of(lifted_queries(points))
            hits, long = probe(codes, own, radius), model.outside(base)
            packed, mine = codes.view(np.uint64).ravel(), own.view(np.uint64).ravel()
            for i, query in enumerate(wanted["query_id"].to_pylist()):
                near = np.flatnonzero(hits[i] | long)
                near = near[long[near] | (np.bitwise_count(packed[near] ^ mine[i]) <= radius)]
                found.append(_best(query, points[i], base, near, ids, starts, k))
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query_id": pa.array(parts[0], pa.int64()), "vec_id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})

    def best(points: DataFrame, radius: int) -> DataFrame:
        # A stated set of queries against all rows, in blocks: both sides of a task are bounded.
        chunks = max(1, -(-points.count() // BLOCK_QUERIES))
        left = classes.select(F.pmod("mark", F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "vector", "ids")
        right = points.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk"), "vector", F.col("vec_id").alias("query_id"))
        found = right.groupBy("block", "chunk").cogroup(left.groupBy("block", "chunk")).applyInArrow(lambda wanted, data: search(data, wanted, radius), result)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    first = kept(best(asked, model.radius))
    full = kept(first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id")))
    short = kept(asked.join(full, "vec_id", "left_anti"))
    if model.radius >= BITS or short.isEmpty():
        return first
    # All codes lie within BITS: what these queries get is exact, and short only where there are fewer candidates.
    return first.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").union(best(short, BITS))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def _best(query: int, point: np.ndarray, base: np.ndarray, near: np.ndarray, ids: np.ndarray, starts: np.ndarray, k: int):
    """The k best ids among the found vectors; near ties are scored again in one fixed order of additions."""
    rough = base[near] @ point
    if len(near) > k + 1:
        least = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
        near = near[rough >= least - 1e-9 * max(1.0, abs(least))]
    exact = (base[near] * point).sum(axis=1)
    named = np.concatenate([ids[starts[j] : starts[j + 1]] for j in near]) if len(near) else np.empty(0, np.int64)
    scores = np.repeat(exact, starts[near + 1] - starts[near])
    other = named != query
    named, scores = named[other], scores[other]
    order = np.lexsort((named, -scores))[:k]
    return np.full(len(order), query, np.int64), named[order], scores[order]
