"""Word scanning, n-gram hashing and shared tables used by the text operators.

Documents are joined on (doc_id, hash of the text): a null or repeated doc_id then never joins two different texts, and
rows that repeat both are the same document and get the same answer.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are hashed together until they hold so many bytes; one longer text is a piece of its own.
PIECE_BYTES = 1 << 20
#: Distinct words whose hash a worker keeps before it starts afresh.
KEPT_WORDS = 400_000

_MIX_A = np.uint64(0x9E3779B97F4A7C15)
_MIX_B = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, else under the warehouse; both are shared by driver and executors."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/hindcast/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors.

    A side of a join that comes from here is a plain shuffle, so adaptive execution can split the other side's hot keys;
    behind an aggregation in the same stage it could not.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text with ``h``, the hash that tells apart rows which repeat a doc_id; other columns are dropped."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"), *extra)


def same_doc(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["h"] == right["h"])


def whole_rows(docs: DataFrame) -> DataFrame:
    """doc_id, h and ``row``, all input columns in one struct, whose names then clash with nothing."""
    return docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("h"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))


def chosen_once(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``whole_rows(docs)`` named by ``chosen`` with its other columns, a repeated document only once.

    ``chosen`` has doc_id, h and ``times``, how many rows of ``docs`` are this document.
    """
    rows = whole_rows(docs)
    joined = rows.join(chosen, same_doc(rows, chosen)).select(rows["doc_id"], rows["h"], "row", *(chosen[c] for c in chosen.columns if c not in ("doc_id", "h")))
    if chosen.where("times > 1").isEmpty():
        return joined
    return joined.where("times = 1").union(joined.where("times > 1").dropDuplicates(["doc_id", "h"]))


def packed(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, h, packed: the texts compressed for a shuffle; with ``carry`` also ``row``, the other input columns.

    Texts are most of what a join by document moves; compressed one by one they are about half as large on disk.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            blobs = pa.array([None if t is None else compress(t) for t in texts_of(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], blobs, *batch.columns[3:]], names=["doc_id", "h", "packed", *batch.schema.names[3:]])

    text = F.col("text").cast("string")
    rest = [docs[c] for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"), *([F.struct(*rest).alias("row")] if carry else []))
    return rows.mapInArrow(pack, shape(rows, "doc_id", "h", packed="binary", **({"row": rows.schema["row"].dataType} if carry else {})))


def shape(df: DataFrame, *same: str, **made: str | T.DataType) -> T.StructType:
    """A schema of columns as they are in ``df`` and of made ones, whose type may be given as text."""
    new = [T.StructField(n, T.StructType.fromDDL(f"x {k}")["x"].dataType if isinstance(k, str) else k) for n, k in made.items()]
    return T.StructType([df.schema[c] for c in same] + new)


def unpacked(column: pa.Array) -> list[bytes | None]:
    expand = zstandard.ZstdDecompressor().decompress
    return [None if blob is None else expand(blob) for blob in column.to_pylist()]


class WordHashes(dict):
    """word -> 64-bit hash, remembered for the words that come again."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def pieces(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together stay within PIECE_BYTES."""
    low = size = 0
    for i, text in enumerate(texts):
        more = len(text or b"")
        if i > low and size + more > PIECE_BYTES:
            yield low, i
            low, size = i, 0
        size += more
    if texts:
        yield low, len(texts)


def split_all(texts: Iterable[bytes | None], lower: bool = False) -> tuple[list[bytes], np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all texts in a row, and where each text begins (one more entry at the end).

    ``bytes.split`` cuts at exactly these six characters, and ``bytes.lower`` changes A-Z only.
    """
    words: list[bytes] = []
    starts = [0]
    for text in texts:
        if text:
            words += (text.lower() if lower else text).split()
        starts.append(len(words))
    return words, np.asarray(starts)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash from two, order matters."""
    x = a * _MIX_A
    x += b
    x ^= x >> _SHIFT
    x *= _MIX_B
    x ^= x >> _SHIFT
    return x


def ngrams(tokens: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size the hashes of all runs of so many tokens, built from runs of 1, 2, 4, ... tokens."""
    out, double, levels = [], 1, [tokens]
    while double * 2 <= max(sizes):
        last = levels[-1]
        levels.append(mix(last[: max(0, len(last) - double)], last[double:]))
        double *= 2
    for size in sizes:
        if len(tokens) < size:
            out.append(np.empty(0, np.uint64))
            continue
        made, at = None, 0
        for k in range(len(levels) - 1, -1, -1):
            if size >> k & 1:
                part = levels[k][at : at + len(tokens) - size + 1]
                made = part if made is None else mix(made, part)
                at += 1 << k
        out.append(made)
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    if len(values) < width:
        return values[:0]
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[: len(values) - span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def signed(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's long."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))
