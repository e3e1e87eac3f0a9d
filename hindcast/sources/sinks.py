"""Writers: refuse or replace, and small report files."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_new(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet; an existing output is an error."""
    rows.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def write_replacing(rows: DataFrame, path: str) -> None:
    """Parquet that takes the place of an older table, which stays readable until the new one is whole.

    The rows go to a folder beside ``path``; only when all of them are written are the two folders renamed. A failed write
    leaves the old table as it was, so the input may even read from ``path``.
    """
    staged, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    rows.write.mode("errorifexists").parquet(staged)
    system, of = _file_system(rows.sparkSession, path)
    replaced = system.exists(of(path))
    if replaced and not system.rename(of(path), of(old)):
        raise OSError(f"{path} cannot be moved aside; the new table is at {staged}")
    if not system.rename(of(staged), of(path)):
        if replaced:
            system.rename(of(old), of(path))
        raise OSError(f"{staged} cannot be moved to {path}")
    if replaced:
        system.delete(of(old), True)


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the maker of its paths: works for any store that Spark writes to."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def table_exists(spark: SparkSession, path: str) -> bool:
    system, of = _file_system(spark, path)
    return system.exists(of(path))


def claim(spark: SparkSession, path: str, seconds: float) -> str | None:
    """A lease: a numbered file in the folder ``path``, or None while another one holds.

    A lease holds until it is released or ``seconds`` old (by the clocks of store and driver, so choose it long). The next
    number is created exclusively, so one claimant gets it; numbers only grow, so whoever held an older lease can see that
    it is over.
    """
    system, of = _file_system(spark, path)
    system.mkdirs(of(path))
    last, made, free = _last_lease(spark, path)
    if last and not free and time.time() - made < seconds:
        return None
    mine = f"{path}/{last + 1}"
    return mine if system.createNewFile(of(mine)) and holds(spark, mine) else None


def _last_lease(spark: SparkSession, path: str) -> tuple[int, float, bool]:
    """The highest number (0: none), when it was made, and whether it has been released."""
    system, of = _file_system(spark, path)
    found = {f.getPath().getName(): f.getModificationTime() / 1000 for f in system.listStatus(of(path))}
    last = max((int(name.split(".")[0]) for name in found), default=0)
    return last, found.get(str(last), 0.0), f"{last}.free" in found


def holds(spark: SparkSession, lease: str) -> bool:
    """Whether no later lease was given and this one not released."""
    folder, number = lease.rsplit("/", 1)
    last, _, free = _last_lease(spark, folder)
    return last == int(number) and not free


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Move a finished folder to its place by one rename."""
    system, of = _file_system(spark, path)
    system.mkdirs(of(path).getParent())
    if not system.rename(of(staged), of(path)):
        raise OSError(f"{staged} cannot be moved to {path}")


def release(spark: SparkSession, lease: str) -> None:
    """End a lease; older ones are removed, the last number stays."""
    system, of = _file_system(spark, lease)
    system.createNewFile(of(f"{lease}.free"))
    folder, number = lease.rsplit("/", 1)
    for old in system.listStatus(of(folder)):
        if int(old.getPath().getName().split(".")[0]) < int(number):
            system.delete(old.getPath(), False)


#: Rows a report file may hold; a larger table belongs into a table of many files.
REPORT_ROWS = 100_000


def _report(rows: DataFrame) -> DataFrame:
    """The few rows of a report in one partition of their own: what makes them stays as parallel as it was."""
    few = rows.limit(REPORT_ROWS + 1)
    if few.count() > REPORT_ROWS:
        raise ValueError(f"a report holds {REPORT_ROWS} rows at most")
    return few.repartition(1)


def write_json_report(report: DataFrame, path: str) -> None:
    """A manifest or metric report: a handful of aggregate rows as one JSON file."""
    _report(report).write.mode("overwrite").json(path)


def write_csv_report(report: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header."""
    _report(report).write.mode("overwrite").csv(path, header=True)


def write_sequences(dataset: DataFrame, path: str, values: str = "sequence") -> None:
    """Sequence tensors as float arrays beside label, key, time and history length."""
    as_float = F.transform(values, lambda e: F.array(e["log_amount"].cast("float"), e["log_gap"].cast("float")))
    write_new(dataset.withColumn(values, as_float), path)
