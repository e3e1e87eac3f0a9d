"""Test tables read in the roles of the operators, in Spark and as the same SQL for the check.

``orders`` repeats its dates, so it exercises rows that share a timestamp (days); ``events`` has
microsecond times and nullable second and third entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions.scalars import epoch_micros
from hindcast.roles import Roles

ROLES = Roles()
DAY = 1
MINUTE = 60_000_000
HOUR = 60 * MINUTE
NUDGE = 1e-9


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    total = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("txn_id"),
        days.cast("long").alias("t"),
        F.col("o_custkey").alias("card"),
        total.alias("amount"),
        F.col("o_orderpriority").alias("product"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey") % 50).alias("device"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("email"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.round(total / (total + 250000.0), 6).alias("score"),
    )


ORDERS = """txn AS (
  SELECT o_orderkey AS txn_id,
         CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS t,
         o_custkey AS card, o_totalprice AS amount, o_orderpriority AS product,
         CASE WHEN o_custkey % 7 <> 0 THEN o_custkey % 50 END AS device,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS email,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
         round(o_totalprice / (o_totalprice + 250000.0), 6) AS score
  FROM orders)"""


def events(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("txn_id"),
        epoch_micros("ts").alias("t"),
        F.col("user_id").alias("card"),
        F.col("value").alias("amount"),
        kind.alias("product"),
        F.when(k % 7 != 0, k).alias("device"),
        F.when(kind != "signup", kind).alias("email"),
        (kind == "error").cast("int").alias("label"),
        F.round(F.col("value") / (F.col("value") + 50.0), 6).alias("score"),
    )


EVENTS = """raw AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
txn AS (
  SELECT event_id AS txn_id, epoch_us(ts) AS t, user_id AS card, value AS amount,
         event_type AS product, CASE WHEN k % 7 <> 0 THEN k END AS device,
         CASE WHEN event_type <> 'signup' THEN event_type END AS email,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
         round(value / (value + 50.0), 6) AS score
  FROM raw)"""


def tail_sql(bound: str) -> str:
    """erfc in SQL: the Gauss integral up to ``bound`` by Simpson's rule over 2000 intervals."""
    weight = "CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    terms = f"list_transform(range(0, 2001), lambda k: ({weight}) * exp(-power(({bound}) * k / 2000.0::DOUBLE, 2)))"
    return f"(1 - 2 / sqrt(pi()) * ({bound}) / 6000.0::DOUBLE * list_sum({terms}))"


def rounded(df: DataFrame, places: int = 6, nudge: float = 0.0) -> DataFrame:
    """Round every floating column, so both engines print the same digits.

    ``nudge`` is added first where means of cents can end exactly on half a digit, which the two
    engines round differently.
    """
    return df.select(
        *(
            F.round(F.col(f"`{c}`") + nudge, places).alias(c) if kind in ("double", "float") else F.col(f"`{c}`")
            for c, kind in df.dtypes
        )
    )


def hourly_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with times in whole hours, so that many share a timestamp."""
    return events(spark, folder).withColumn("t", F.floor(F.col("t") / HOUR))


HOURLY = f"""{EVENTS.replace("txn AS", "micro AS")},
txn AS (SELECT * REPLACE (t // {HOUR} AS t) FROM micro)"""
