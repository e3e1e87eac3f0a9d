"""Readers with declared schemas, a holdout lock and file fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hindcast.operators.contract import require_columns


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV file with a header; the schema is declared, never inferred."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST")


def read_pair(
    spark: SparkSession, transactions: str, transactions_schema, identities: str, identities_schema,
    required: tuple[set[str], set[str]],
) -> tuple[DataFrame, DataFrame]:
    """Both raw files, each checked for its required columns."""
    pair = (
        read_csv(spark, transactions, transactions_schema),
        read_csv(spark, identities, identities_schema),
    )
    for df, columns, name in zip(pair, required, ("transactions", "identities")):
        require_columns(df, columns, name)
    return pair


def read_columns(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def open_split(
    spark: SparkSession, folder: str, split: str, stage: str,
    locked: str = "test", opening_stages: tuple[str, ...] = ("final_holdout",),
) -> DataFrame:
    """Read a split, refusing the locked holdout to any stage not entitled to it."""
    if split == locked and stage not in opening_stages:
        raise PermissionError(f"stage {stage} must not read the locked {split} split")
    return spark.read.parquet(f"{folder}/{split}")


def stored_rows(spark: SparkSession, path: str, column: str = "stored_order") -> DataFrame:
    """A Parquet table with the place of each row as it is stored: files by path, rows as they follow in the file.

    Counted from 0 without gaps, whatever the files' splits. The sum over files runs over one row for each file.
    """
    rows = spark.read.parquet(path)
    placed = rows.select(*rows.columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    return placed.join(starts, "_file").select(*rows.columns, (F.col("_start") + F.col("_row")).alias(column))


BLOCK = 8 * 1024 * 1024
#: Files up to this size are read by Spark itself, so from any store that it reaches; larger ones in blocks.
READ_WHOLE = 256 * 1024 * 1024


def missing_files(spark: SparkSession, path: str, expected: tuple[str, ...]) -> DataFrame:
    """The expected file names (file_name) that do not occur under a path or pattern."""
    wanted = spark.createDataFrame([(name,) for name in sorted(set(expected))], "file_name string")
    return wanted.join(_listed(spark, path).select("file_name"), "file_name", "left_anti")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.substring_index("path", "/", -1).alias("file_name"), F.col("length").alias("size_bytes"))


def fingerprints(spark: SparkSession, path: str, expected: tuple[str, ...] = ()) -> DataFrame:
    """Path, name, size and SHA-256 of every file under a path or pattern, many files at once; file size is no limit.

    Raises where an expected name is missing.
    """
    if expected:
        missing = [r["file_name"] for r in missing_files(spark, path, expected).orderBy("file_name").collect()]
        if missing:
            raise FileNotFoundError(f"expected files are missing: {missing}")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            digests = []
            for name in batch["path"]:
                uri = name.replace("file:/", "file:///", 1) if name.startswith("file:/") else name
                system, inner = fs.FileSystem.from_uri(uri)
                running = hashlib.sha256()
                with system.open_input_stream(inner) as stream:
                    while block := stream.read(BLOCK):
                        running.update(block)
                digests.append(running.hexdigest())
            yield batch.assign(sha256=digests)

    files = spark.read.format("binaryFile").load(path)
    usual = files.where(F.col("length") <= READ_WHOLE)
    usual = usual.select("path", F.substring_index("path", "/", -1).alias("file_name"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    large = _listed(spark, path).where(F.col("size_bytes") > READ_WHOLE)
    return usual.unionByName(large.mapInPandas(digest, "path string, file_name string, size_bytes long, sha256 string"))


def load_schema(rows: DataFrame, mapping: dict[str, tuple[str, str]]) -> DataFrame:
    """Select, rename and cast to the load schema: source column -> (name, type)."""
    require_columns(rows, set(mapping), "the load input")
    return rows.select(*(F.col(c).cast(kind).alias(name) for c, (name, kind) in mapping.items()))


def payload(rows: DataFrame, key: str, column: str = "payload") -> DataFrame:
    """The key and one JSON object of the other columns; NULL fields are left out."""
    fields = [c for c in rows.columns if c != key]
    if not fields:
        raise ValueError("there is no column to put in the payload")
    return rows.select(key, F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias(column))
