"""Vector code compression: one codebook for each part of a vector, in exact integer arithmetic.

Parts and entries are padded with zeros to a power of two and turned by the Walsh-Hadamard transform, which keeps squared
distances but for that power as a factor. Squared differences are then added up in sequency order, where the slow changes
come first, and an entry is given up as soon as its sum exceeds the whole distance of a likely one.

The codebooks have a fixed size and travel with the tasks; each round sums the parts of every entry within the tasks and
brings one row for each component of an entry to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import kept, shape

#: Sums are carried in two halves, so that they never leave 64 bits.
_HALF = 26
#: Integer components must stay below this bound, beyond which doubles no longer hold every integer.
LARGEST = 1 << 53


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are."""
    every = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(every, F.lit(False))


def integers(vectors: DataFrame, column: str, scale: int, largest: int) -> DataFrame:
    """The rows with finite vectors and ``ints``, the floors of ``scale`` times their components.

    Raises ValueError where such an integer reaches ``largest``.
    """
    double = F.col(column).cast("array<double>")
    rows = vectors.where(finite(double))
    far = F.exists(double, lambda x: F.abs(x) * scale >= largest)
    if not rows.where(far).isEmpty():
        raise ValueError(f"{column} has components beyond {largest / scale:g}")
    return rows.withColumn("ints", F.transform(double, lambda x: F.floor(x * scale)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, filled with zeros up to ``width``."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def sequency_order(width: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix by their number of sign changes; ``width`` is a power of two."""
    matrix = np.ones((1, 1), np.int8)
    while len(matrix) < width:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return np.argsort((np.diff(matrix, axis=1) != 0).sum(axis=1), kind="stable")


def transformed(values: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the last axis, padded with zeros to a power of two, in sequency order."""
    width = values.shape[-1]
    full = 1 << max(0, width - 1).bit_length()
    out = np.concatenate([values, np.zeros((*values.shape[:-1], full - width), values.dtype)], axis=-1)
    span = 1
    while span < full:
        pairs = out.reshape(*values.shape[:-1], full // (2 * span), 2, span)
        left, right = pairs[..., 0, :], pairs[..., 1, :]
        out = np.stack([left + right, left - right], axis=-2).reshape(*values.shape[:-1], full)
        span *= 2
    return out[..., sequency_order(full)]


def nearest_entries(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each transformed point (n, width) its nearest transformed entry (k, width) and the scaled squared distance.

    Ties go to the lower index.
    """
    n, width = points.shape
    head = min(2, width)
    sums = ((points[:, None, :head] - entries[None, :, :head]) ** 2).sum(axis=2)
    likely = sums.argmin(axis=1)
    bound = ((points - entries[likely]) ** 2).sum(axis=1)
    rows, cols = np.nonzero(sums <= bound[:, None])
    sums = sums[rows, cols]
    for at in range(head, width):
        sums = sums + (points[rows, at] - entries[cols, at]) ** 2
        stay = sums <= bound[rows]
        if not stay.all():
            rows, cols, sums = rows[stay], cols[stay], sums[stay]
    # The likely entry is always left, and bounds the rest: the first of a row's smallest sums is its answer.
    order = np.lexsort((cols, sums, rows))
    first = order[np.searchsorted(rows[order], np.arange(n))]
    return cols[first], sums[first]


@dataclass(frozen=True)
class Codebooks:
    """Entries (parts, entries, width) of integers, and how many components a vector has with its filling."""

    entries: np.ndarray

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def split(self, column: pa.Array) -> np.ndarray:
        parts, _, width = self.entries.shape
        return matrix(column, self.length).reshape(len(column), parts, width)

    def assign(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, parts) and squared distances summed over the parts, of any size."""
        most = max(int(np.abs(values).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        full = 1 << max(0, self.entries.shape[2] - 1).bit_length()
        # Python's integers where 64 bits could overflow.
        kind = np.int64 if 4 * full * full * most * most * len(self.entries) < 1 << 63 else object
        points, entries = transformed(values.astype(kind)), transformed(self.entries.astype(kind))
        codes, errors = np.zeros(values.shape[:2], np.int64), np.zeros(len(values), kind)
        for part in range(values.shape[1]):
            codes[:, part], scaled = nearest_entries(points[:, part], entries[part])
            errors += scaled // full
        return codes, errors


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The parts of the rows with the smallest vec_ids (nulls last, ties by the vector); None without rows."""
    first = rows.select("vec_id", "ints").orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()
    if not first:
        return None
    longest = rows.agg(F.max(F.size("ints"))).first()[0]
    width = max(1, -(-longest // parts))
    values = matrix(pa.array([r["ints"] for r in first], pa.list_(pa.int64())), parts * width)
    return Codebooks(values.reshape(len(first), parts, width).transpose(1, 0, 2))


def refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry becomes the floor of the mean of the parts assigned to it; unused entries stay."""
    parts, k, width = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros((parts * k, width), np.int64), np.zeros((parts * k, width), np.int64)
        counts = np.zeros(parts * k, np.int64)
        for batch in batches:
            values = books.split(batch.column(0))
            slots = (books.assign(values)[0] + np.arange(parts) * k).ravel()
            flat = values.reshape(-1, width)
            np.add.at(high, slots, flat >> _HALF)
            np.add.at(low, slots, flat & ((1 << _HALF) - 1))
            counts += np.bincount(slots, minlength=parts * k)
        used = np.flatnonzero(np.repeat(counts, width))
        columns = {"slot": used, "high": high.ravel()[used], "low": low.ravel()[used], "times": np.repeat(counts, width)[used]}
        yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in columns.items()})

    partial = rows.select("ints").mapInArrow(sums, "slot long, high long, low long, times long")
    found = partial.groupBy("slot").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("times").alias("times")).collect()
    entries = books.entries.copy().reshape(-1)
    for row in found:
        entries[row["slot"]] = ((row["high"] << _HALF) + row["low"]) // row["times"]
    return Codebooks(entries.reshape(parts, k, width))


def compress(
    vectors: DataFrame, column: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, codes, error, label_error) of every row with a finite vector, and the codebooks.

    A component x counts as floor(scale * x); vectors are cut into equal consecutive parts. The codebook of a part starts with
    that part of the rows with the smallest vec_ids (nulls last, ties by the vector) and is refined ``rounds`` times. ``codes``
    holds the nearest entry of each part (ties to the lower index), ``error`` the squared distances summed over the parts,
    ``label_error`` the errors summed over the rows with an equal label, nulls together; a sum that does not fit a long is
    null. Rows whose vector is null or holds null or non-finite components are dropped; repeated rows count each time; other
    columns are ignored. Vectors shorter than the longest, or than a multiple of the parts, are filled with zeros. With fewer
    rows than entries there are as many entries as rows. Without rows the result is empty and the codebooks are None.
    Components of LARGEST / scale and more raise ValueError.
    """
    rows = kept(integers(vectors, column, scale, LARGEST).select("vec_id", "label", "ints"))
    books = first_codebooks(rows, parts, entries)
    if books is None:
        return rows.select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), *(F.lit(None).cast("long").alias(c) for c in ("error", "label_error"))), None
    for _ in range(rounds):
        books = refined(rows, books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = books.assign(books.split(batch.column(2)))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.astype(np.int32).ravel()), codes.shape[1]).cast(pa.list_(pa.int32()))
            fitting = pa.array([int(e) if e < 1 << 63 else None for e in errors], pa.int64()) if errors.dtype == object else pa.array(errors)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, fitting], names=["vec_id", "label", "codes", "error"])

    done = kept(rows.mapInArrow(coded, shape(rows, "vec_id", "label", codes="array<int>", error="long")))
    whole = F.when(F.count("error") == F.count(F.lit(1)), F.expr("try_sum(error)"))
    totals = kept(done.groupBy("label").agg(whole.alias("label_error")))
    joined = done.join(totals, done["label"].eqNullSafe(totals["label"]), "left")
    return joined.select(done["vec_id"], done["label"], "codes", "error", "label_error"), books
