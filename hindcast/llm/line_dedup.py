"""Line dedup within one word edit by a deletion-neighbourhood join.

Two lines within one inserted, deleted or replaced word have an equal deletion variant: the line without its p-th word.
Variants are joined as hashed keys, never line with line. A line without a partner that equals it in its first or its last
half cannot have such a neighbour, so variants are emitted only for lines which pass that pigeonhole test.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import WordHashes, kept, keyed, packed, pieces, same_doc, shape, signed, texts_of, unpacked

#: An odd number, so that powers of it can be undone modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_HALVES = ("p0", "s0", "p1", "s1")
#: Tables of so many rows (some 50 bytes each) are broadcast to the lines they are looked up by; larger ones are joined by
#: shuffle, with the same result.
BROADCAST_LINES = 500_000


def _few(table: DataFrame) -> DataFrame:
    """A written table for the right side of a join, broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_LINES else table.hint("merge")




def _half_keys(words: list[bytes]) -> list[int]:
    """First and last half for partners of the same length (and one word longer), then for partners one word shorter."""
    keys = []
    for kind, size in enumerate((len(words), len(words) - 1)):
        cut = size // 2
        keys.append(xxhash.xxh3_64_intdigest(b" ".join(words[:cut]), 2 * size))
        keys.append(xxhash.xxh3_64_intdigest(b" ".join(words[len(words) - (size - cut) :]), 2 * size + 1))
    return keys


def lines(docs: DataFrame, near_words: int) -> DataFrame:
    """doc_id, h, line, a, b (128-bit hash of the words), n, and the half keys of lines long enough for near matches.

    Lines end at a line feed; blank lines are left out.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for low, high in pieces(texts):  # what a worker holds beside its batch stays small
                index, place, a, b, n, halves = [], [], [], [], [], []
                for i in range(low, high):
                    for k, line in enumerate((texts[i] or b"").split(b"\n")):
                        words = line.split()
                        if words:
                            whole = xxhash.xxh3_128_intdigest(b" ".join(words))
                            index.append(i)
                            place.append(k)
                            a.append(whole >> 64)
                            b.append(whole & 0xFFFFFFFFFFFFFFFF)
                            n.append(len(words))
                            halves.append(_half_keys(words) if len(words) >= near_words else (0, 0, 0, 0))
                if index:
                    own = pa.array(index)
                    keys = np.array(halves, np.uint64).T
                    short = np.array(n) < near_words
                    columns = [pa.array(k, mask=short) for k in np.ascontiguousarray(keys).view(np.int64)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(own), batch.column(1).take(own), pa.array(place, pa.int32()), signed(np.array(a, np.uint64)), signed(np.array(b, np.uint64)), pa.array(n, pa.int32()), *columns],
                        names=["doc_id", "h", "line", "a", "b", "n", *_HALVES],
                    )

    rows = keyed(docs).select("doc_id", "h", "text")
    return rows.mapInArrow(scan, shape(rows, "doc_id", "h", line="int", a="long", b="long", n="int", **dict.fromkeys(_HALVES, "long")))


def _asked_texts(docs: DataFrame, asked: DataFrame, few: bool) -> DataFrame:
    """text or packed, asked: the documents that hold lines asked for.

    Texts are packed for a shuffle only: a broadcast moves none, and packing would hold a second Python worker in each task.
    """
    rows = keyed(docs) if few else packed(docs)
    asked = F.broadcast(asked) if few else asked.hint("merge")
    return rows.join(asked, same_doc(rows, asked)).select(rows["text" if few else "packed"], asked["asked"])


def _variants(joined: DataFrame) -> DataFrame:
    """a, b, n, at, variant, body of lines: the hash without word ``at`` for every word, and once with at = -1 the whole.

    ``body`` holds the words themselves, with the whole line only.
    """
    plain = joined.columns[0] == "text"

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        powers = np.ones(1, np.uint64)
        for batch in batches:
            parts: list[list] = [[], [], [], [], []]
            bodies: list[bytes | None] = []
            texts = texts_of(batch) if plain else unpacked(batch.column(0))
            for text, asked in zip(texts, batch.column(1).to_pylist(), strict=True):
                split = text.split(b"\n")
                for one in asked:
                    words = split[one["line"]].split()
                    while len(powers) < len(words):
                        powers = np.concatenate([powers, powers * np.uint64(pow(_BASE, len(powers), 1 << 64))])
                    terms = hashes.of(words) * powers[: len(words)]
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
                    made = np.concatenate([sums[-1:], sums[:-1] + (sums[-1] - sums[1:]) * _BACK])
                    parts[0].append(np.full(len(made), one["a"], np.int64))
                    parts[1].append(np.full(len(made), one["b"], np.int64))
                    parts[2].append(np.full(len(made), len(words), np.int32))
                    parts[3].append(np.arange(-1, len(words), dtype=np.int32))
                    parts[4].append(made.view(np.int64))
                    bodies += [b" ".join(words)] + [None] * len(words)
            if bodies:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(p)) for p in parts), pa.array(bodies, pa.binary())], names=["a", "b", "n", "at", "variant", "body"])

    return joined.mapInArrow(expand, "a long, b long, n int, at int, variant long, body binary")


def _confirmed(pairs: DataFrame) -> DataFrame:
    """a, b of the pairs whose words are within one edit."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = (batch.column(i).to_pylist() for i in (2, 3))
            near = pa.array([within_one_edit(x.split(), y.split()) for x, y in zip(own, other, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

    return pairs.select("a", "b", "body", "other").mapInArrow(confirm, "a long, b long").distinct()


def within_one_edit(one: list[bytes], other: list[bytes]) -> bool:
    """Whether one inserted, deleted or replaced word at most makes the lines equal."""
    if len(one) > len(other):
        one, other = other, one
    if len(other) - len(one) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(one, other, strict=False)) if x != y), len(one))
    return one[at + (len(one) == len(other)) :] == other[at + 1 :]


def near_lines(docs: DataFrame, distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b and first place of the distinct lines that may have a neighbour, and a, b of those with an earlier one."""
    # A key occurs once a line, so a count tells whether another line has it; the first 64 bits name a line well enough here.
    halves = distinct.where("p0 is not null").select("a", F.explode(F.array(*_HALVES)).alias("key"))
    shared = kept(halves.groupBy("key").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1").select("key"))
    wanted = kept(halves.join(_few(shared), "key").select("a").distinct())
    sources = kept(distinct.where("p0 is not null").select("a", "b", "first").join(_few(wanted), "a", "left_semi"))
    asked = kept(sources.groupBy("first.doc_id", "first.h").agg(F.collect_list(F.struct("first.line", "a", "b")).alias("asked")))
    variants = kept(_variants(_asked_texts(docs, asked, sources.count() <= BROADCAST_LINES)))  # a repeated document row has its lines in here twice, which changes no minimum
    whole = variants.where("at = -1").select("a", "b", "n", "variant", "body").dropDuplicates(["a", "b"])
    whole = kept(whole.join(sources, ["a", "b"]))

    # Replaced word: lines of one length that agree in all but the word at one place. Their earliest is the keeper.
    cut = variants.where("at >= 0").select("a", "b", "n", "at", "variant")
    met = kept(cut.groupBy("variant", "n", "at").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1").select("variant", "n", "at"))
    groups = kept(cut.join(_few(met), ["variant", "n", "at"]).join(whole.select("a", "b", "first"), ["a", "b"]))
    earliest = kept(groups.groupBy("variant", "n", "at").agg(F.min(F.struct("first", "a", "b")).alias("keeper")))
    replaced = groups.join(earliest, ["variant", "n", "at"]).select("a", "b", "first", F.col("keeper.a").alias("a2"), F.col("keeper.b").alias("b2"), F.col("keeper.first").alias("first2"))

    # Inserted or deleted word: the variant of the longer line is the shorter line.
    longer = cut.select(F.col("a").alias("a2"), F.col("b").alias("b2"), (F.col("n") - 1).alias("n"), "variant")
    pairs = longer.join(_few(whole.select("a", "b", "n", "variant", "first")), ["n", "variant"]).select("a", "b", "first", "a2", "b2").distinct()
    pairs = pairs.join(whole.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("first").alias("first2")), ["a2", "b2"])
    pairs = pairs.select("a", "b", "first", "a2", "b2", "first2")
    flipped = pairs.select(*(F.col(x).alias(y) for x, y in zip(("a2", "b2", "first2", "a", "b", "first"), pairs.columns, strict=True)))
    # Of all earlier neighbours one line may have by insertion, its earliest is enough.
    both = replaced.union(pairs).union(flipped).where("first2 < first")
    nearest = both.groupBy("a", "b").agg(F.min(F.struct("first2", "a2", "b2")).alias("to")).select("a", "b", F.col("to.a2").alias("a2"), F.col("to.b2").alias("b2"))
    bodies = whole.select("a", "b", "body")
    others = whole.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("body").alias("other"))
    return sources, _confirmed(nearest.join(bodies, ["a", "b"]).join(others, ["a2", "b2"]))


def drop_repeated_lines(docs: DataFrame, near_words: int = 8) -> DataFrame:
    """doc_id, h, n_lines, n_dropped, text, row: one row per document row; ``row`` holds all of its input columns.

    A line (ended by a line feed; blanks between words do not count) is dropped when an equal line, or for lines of at
    least ``near_words`` words one within a single word edit, comes earlier: at a smaller (doc_id, text hash, place), a
    null doc_id last. Neighbours count whether they are dropped themselves or not. Blank lines stay and are not counted;
    null text stays null. Rows that repeat doc_id and text are one document and keep the same lines.
    """
    every = kept(lines(docs, near_words))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h", "line")
    same = [F.first(c).alias(c) for c in ("n", *_HALVES)]
    distinct = kept(every.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), *same))
    sources, near = near_lines(docs, distinct)
    near = kept(sources.join(near, ["a", "b"], "left_semi").withColumn("near", F.lit(True)))
    again = distinct.where("copies > 1").select("a", "b", "first").join(near, ["a", "b"], "left_anti")
    judged = kept(near.union(again.withColumn("near", F.lit(False))))
    gone = every.select("doc_id", "h", "line", "a", "b").join(_few(judged), ["a", "b"]).where(F.col("near") | (place != F.col("first")))
    lists = gone.groupBy("doc_id", "h").agg(F.collect_set("line").alias("gone"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, left = [], [], []
            for text, drop in zip(unpacked(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                split = (text or b"").split(b"\n")
                drop = set(drop or ())
                n_lines.append(sum(1 for x in split if x.split()))
                n_dropped.append(len(drop))
                left.append(None if text is None else b"\n".join(x for k, x in enumerate(split) if k not in drop))
            made = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, batch.column(4)], names=["doc_id", "h", "n_lines", "n_dropped", "text", "row"])

    rows = packed(docs, carry=True)
    marked = rows.join(lists, same_doc(rows, lists), "left").select(rows["doc_id"], rows["h"], rows["packed"], lists["gone"], rows["row"])
    return marked.mapInArrow(apply, shape(marked, "doc_id", "h", n_lines="long", n_dropped="long", text="string", row=marked.schema["row"].dataType))
