"""Idempotent keyed loads into a table folder, with run records."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.operators.quality import require_unique
from hindcast.sources.sinks import claim, holds, publish, release, table_exists


#: Seconds after which a load that neither ended nor failed counts as crashed.
LEASE = 6 * 3600.0


@dataclass(frozen=True)
class LoadResult:
    offered: int
    inserted: int
    skipped: int


def missing_rows(offered: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Offered rows whose key the table does not hold yet."""
    return offered.join(existing.select(key), key, "left_anti")


def append_missing(offered: DataFrame, path: str, key: str, expected_rows: int | None = None, lease: float = LEASE) -> LoadResult:
    """Insert rows with new keys, skip the rest. Repeating a load inserts nothing.

    The new rows are staged beside the table and compared with what was offered before anything is published; then one
    rename makes them a folder ``load_id=...`` of the table. A reader sees all of a load or nothing, a failure before the
    rename leaves the table as it was, and older rows are never written again. Only one load of a table runs at a time; one that
    crashed gives way after ``lease`` seconds, and one that merely took longer and lost its place publishes nothing.
    """
    spark = offered.sparkSession
    require_unique(offered, key, "the load")
    total = offered.count()
    if expected_rows is not None and total != expected_rows:
        raise ValueError(f"the manifest promises {expected_rows} rows, the load has {total}")
    held = claim(spark, f"{path}.lock", lease)
    if held is None:
        raise RuntimeError(f"another load of {path} is under way (or ended without releasing it less than {lease:.0f} seconds ago)")
    try:
        existing = spark.read.parquet(path) if table_exists(spark, path) else None
        load = uuid.uuid4().hex
        staged = f"{path}.load-{load}"
        (offered if existing is None else missing_rows(offered, existing, key)).write.parquet(staged)
        inserted = spark.read.parquet(staged).count()
        known = 0 if existing is None else offered.join(existing.select(key), key, "left_semi").count()
        if inserted + known != total:
            raise RuntimeError(f"{total} rows were offered, but {inserted} staged and {known} known")
        if not holds(spark, held):
            raise RuntimeError(f"this load of {path} took longer than its lease and another one followed; nothing was published")
        if inserted or existing is None:
            publish(spark, staged, f"{path}/load_id={load}")
    finally:
        release(spark, held)
    return LoadResult(total, inserted, total - inserted)


def record_run(source: DataFrame, path: str, run: str, result: LoadResult, coverage: float) -> DataFrame:
    """Append one run record: counts, coverage and the column list of the source."""
    facts = source.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(run).alias("run"),
        "row_count",
        F.lit(result.inserted).cast("long").alias("inserted"),
        F.lit(result.skipped).cast("long").alias("skipped"),
        F.lit(float(coverage)).alias("coverage"),
        F.lit(",".join(source.columns)).alias("columns"),
    )
    facts.write.mode("append").parquet(path)
    return source.sparkSession.read.parquet(path)
