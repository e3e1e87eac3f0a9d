"""Historical features carried from period to period by a structured stream.

Every micro-batch is a later period. It is scored from a state table (count and last time per
entity) and from the recent rows the longest window can still see, and only then enters the state.
All state lives in versioned folders named by the batch, so a repeated batch rewrites its own
output and nothing else, and no entity's state has to fit into one task.

What a period costs does not grow with the periods before it: it writes the state of its own
entities only (every COMPACT_EVERY periods these are merged into one table), opens the rows of those
periods only that its longest window reaches, and finds the closed time in the one-row span of the
period before.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hindcast.operators.ordered import attach, order_edges
from hindcast.operators.pit import entity_features
from hindcast.roles import EntityFeatures, Roles
from hindcast.session import written


#: Periods whose changes of the state are read beside the last merged state.
COMPACT_EVERY = 16


@dataclass(frozen=True)
class LiveFeatures:
    """Where one entity's live features are kept and how they are computed."""

    spec: EntityFeatures
    folder: str
    roles: Roles = Roles()

    def process(self, arrived: DataFrame, batch: int) -> None:
        """Score one period; rows at or before the last closed time go to the side table."""
        spark, time = arrived.sparkSession, self.roles.time
        arrived = arrived.persist()
        before = self._span(spark, batch - 1)
        closed = before["closed"] if before else None
        late = arrived.where(F.lit(False)) if closed is None else arrived.where(F.col(time) <= F.lit(closed))
        rows = arrived if closed is None else arrived.where(F.col(time) > F.lit(closed))
        state = self._state(spark, batch - 1)
        self._write(late, "late", batch)
        self._write(self._scored(rows, state, batch), "features", batch)
        self._write(rows.select(*self._narrow()), "rows", batch)
        seen = rows.groupBy(self._entity().alias("entity")).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("last"))
        if state is not None:
            known = seen.select("entity", F.col("n").alias("more"), F.col("last").alias("now")).join(state, "entity", "left")
            seen = known.select("entity", (F.coalesce("n", F.lit(0)) + F.col("more")).alias("n"), F.col("now").alias("last"))
        self._write(seen, "state", batch)
        if batch % COMPACT_EVERY == COMPACT_EVERY - 1:
            self._write(self._state(spark, batch, batch - COMPACT_EVERY), "merged", batch)
        span = rows.agg(F.min(time).alias("first"), F.max(time).alias("last"))
        self._write(span.withColumn("closed", F.coalesce("last", F.lit(closed).cast(span.schema["last"].dataType))), "span", batch)
        arrived.unpersist()

    def _scored(self, rows: DataFrame, state: DataFrame | None, batch: int) -> DataFrame:
        spec, roles = self.spec, self.roles
        windowed = replace(spec, recency=False, history=False)
        within = entity_features(
            rows.select(*self._narrow()), replace(spec, velocity={}, amounts={}, recency=True, history=True), roles
        )
        if state is not None:
            within = attach(within.withColumn("entity", self._entity()), state, ("entity",), roles.key)
        else:
            within = within.withColumns({"n": F.lit(0), "last": F.lit(None).cast("long")})
        count = F.col(f"history_{spec.name}_count") + F.coalesce("n", F.lit(0))
        made = {}
        if spec.recency:
            gap = F.col(roles.time) - F.col("last")
            made[f"recency_{spec.name}"] = F.coalesce(f"recency_{spec.name}", gap)
        if spec.history:
            made[f"history_{spec.name}_count"] = count
            made[f"is_new_{spec.name}"] = (count == 0).cast("double")
        out = within.select(roles.key, *(c.alias(n) for n, c in made.items()))
        if windowed.outputs():
            before = self._recent(rows, batch).withColumn("_now", F.lit(False))
            both = before.unionByName(rows.select(*self._narrow()).withColumn("_now", F.lit(True)))
            looked = entity_features(both, windowed, roles).where("_now")
            out = out.join(looked.select(roles.key, *windowed.outputs()), roles.key)
        return out.select(roles.key, *spec.outputs())

    def _recent(self, rows: DataFrame, batch: int) -> DataFrame:
        """Earlier rows that some window of this period can still reach."""
        spec, time = self.spec, self.roles.time
        first = rows.agg(F.min(time)).first()[0]
        longest = max([*spec.velocity.values(), *spec.amounts.values()])
        if batch == 0 or first is None:
            return rows.select(*self._narrow()).where(F.lit(False))
        paths = []
        for b in range(batch - 1, -1, -1):  # periods follow one another, so the first one out of reach ends the search
            span = self._span(rows.sparkSession, b)
            if span["closed"] is None or span["closed"] < first - longest:
                break
            paths.append(f"{self.folder}/rows/batch={b}")
        if not paths:
            return rows.select(*self._narrow()).where(F.lit(False))
        return rows.sparkSession.read.parquet(*paths).where(F.col(time) >= F.lit(first - longest))

    def _narrow(self) -> list[str]:
        return list(dict.fromkeys([self.roles.key, self.roles.time, self.roles.amount, *self.spec.columns]))

    def _entity(self):
        """The entity as one text that keeps NULL apart from every value."""
        return F.to_json(F.struct(F.lit(0).alias("_"), *self.spec.columns), {"ignoreNullFields": "false"})

    def _state(self, spark: SparkSession, batch: int, merged: int | None = None) -> DataFrame | None:
        """(entity, n, last) after a batch: the last merged state, and the changes since; counts only grow."""
        if batch < 0:
            return None
        if merged is None:
            merged = (batch + 1) // COMPACT_EVERY * COMPACT_EVERY - 1
        paths = [f"{self.folder}/state/batch={b}" for b in range(merged + 1, batch + 1)]
        if merged >= 0:
            paths.append(f"{self.folder}/merged/batch={merged}")
        return spark.read.parquet(*paths).groupBy("entity").agg(F.max("n").alias("n"), F.max("last").alias("last"))

    def _span(self, spark: SparkSession, batch: int):
        return spark.read.parquet(f"{self.folder}/span/batch={batch}").first() if batch >= 0 else None

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def start(self, stream: DataFrame) -> StreamingQuery:
        """Run over everything the stream's source holds now, then stop."""
        return (
            stream.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.folder}/progress")
            .trigger(availableNow=True)
            .start()
        )

    def features(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/features").drop("batch")

    def late_rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/late").drop("batch")


def replay(rows: DataFrame, live: LiveFeatures, periods: int) -> DataFrame:
    """Publish a table period by period, in time order, and stream each period as it appears."""
    spark, time = rows.sparkSession, live.roles.time
    rows = written(rows)  # the edges and every period pass over them, what they are made from is computed once
    source = f"{live.folder}/source"
    cuts = [None, *order_edges(rows, time, periods), None]
    for low, high in zip(cuts, cuts[1:]):
        part = rows if low is None else rows.where(F.col(time) >= F.lit(low))
        part = part if high is None else part.where(F.col(time) < F.lit(high))
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        query = live.start(stream)
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
    return live.features(spark)
