"""Point-in-time features over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.operators import pit, splits
from hindcast.plans.bindings import DAY, EVENTS, HOUR, MINUTE, NUDGE, ORDERS, ROLES, events, orders, rounded
from hindcast.plans.registry import query
from hindcast.roles import EntityFeatures

DAYS = {"1d": DAY, "7d": 7 * DAY, "30d": 30 * DAY}
MINUTES = {"5min": 5 * MINUTE, "60min": 60 * MINUTE, "1440min": 1440 * MINUTE}
HOURS = {"1h": HOUR, "24h": 24 * HOUR, "168h": 168 * HOUR}


def _frame(partition: str, length: int | None) -> str:
    start = "UNBOUNDED" if length is None else str(length)
    by = f"PARTITION BY {partition} " if partition else ""
    return f"OVER ({by}ORDER BY t RANGE BETWEEN {start} PRECEDING AND 1 PRECEDING)"


def _velocity_sql(name: str, partition: str, windows: dict[str, int]) -> list[str]:
    return [f"count(*) {_frame(partition, w)} AS velocity_{name}_{label}" for label, w in windows.items()]


# Millionths: finer than any amount of the test tables, and than the unit that the operator finds.
UNITS = "CAST(round(amount * 1000000) AS HUGEINT)"


def _amount_sql(name: str, partition: str, windows: dict[str, int]) -> tuple[list[str], list[str]]:
    """Inner window columns and the outer expressions over them."""
    inner, outer = [], []
    for label, w in windows.items():
        frame = _frame(partition, w)
        c = f"{name}_{label}"
        inner += [
            f"count(amount) {frame} AS n_{c}",
            f"sum({UNITS}) {frame} AS s_{c}",
            f"sum({UNITS} * {UNITS}) {frame} AS q_{c}",
        ]
        mean = f"CASE WHEN n_{c} > 0 THEN CAST(s_{c} AS DOUBLE) / n_{c} / 1000000.0 END"
        std = f"CASE WHEN n_{c} > 1 THEN sqrt(CAST(n_{c} * q_{c} - s_{c} * s_{c} AS DOUBLE)) / n_{c} / 1000000.0 END"
        outer += [
            f"round({mean} + 1e-9, 6) AS amount_{c}_mean",
            f"round({std} + 1e-9, 6) AS amount_{c}_std",
            f"round(CASE WHEN {std} > 0 THEN (amount - {mean}) / ({std}) END + 1e-9, 6) AS amount_{c}_zscore",
        ]
    return inner, outer


def _velocity_query(name, binding, cte, entity, partition, windows):
    spec = EntityFeatures(entity[0], entity[1], velocity=windows)
    sql = f"WITH {cte} SELECT txn_id, {', '.join(_velocity_sql(entity[0], partition, windows))} FROM txn"

    @query(name, sql)
    def build(spark, folder):
        return pit.behavioural_features(binding(spark, folder), [spec], ROLES)


def _amount_query(name, binding, cte, entity, partition, windows):
    spec = EntityFeatures(entity[0], entity[1], amounts=windows)
    inner, outer = _amount_sql(entity[0], partition, windows)
    sql = (
        f"WITH {cte}, w AS (SELECT *, {', '.join(inner)} FROM txn) "
        f"SELECT txn_id, {', '.join(outer)} FROM w"
    )

    @query(name, sql)
    def build(spark, folder):
        return rounded(pit.behavioural_features(binding(spark, folder), [spec], ROLES), nudge=NUDGE)


_velocity_query("w1_velocity", orders, ORDERS, ("card", ("card",)), "card", DAYS)
_velocity_query("w1_velocity_micros", events, EVENTS, ("card", ("card",)), "card", MINUTES)
_amount_query("w2_amount_stats", orders, ORDERS, ("card", ("card",)), "card", DAYS)
_amount_query("w2_amount_stats_micros", events, EVENTS, ("card", ("card",)), "card", HOURS)
_velocity_query("w7_global_velocity", events, EVENTS, ("all", ()), "", MINUTES)
_velocity_query("w7_global_velocity_ties", orders, ORDERS, ("all", ()), "", DAYS)
_amount_query("w7_global_amount_stats", events, EVENTS, ("all", ()), "", HOURS)


@query("w3_recency", f"WITH {ORDERS} SELECT txn_id, t - max(t) {_frame('card', None)} AS recency_card FROM txn")
def _(spark, folder):
    return pit.behavioural_features(orders(spark, folder), [EntityFeatures("card", ("card",), recency=True)])


@query(
    "w7_global_recency", f"WITH {ORDERS} SELECT txn_id, t - max(t) {_frame('', None)} AS recency_all FROM txn"
)
def _(spark, folder):
    return pit.behavioural_features(orders(spark, folder), [EntityFeatures("all", recency=True)])


@query(
    "w4_history_count",
    f"""WITH {EVENTS} SELECT txn_id, CASE WHEN device IS NOT NULL THEN
        count(*) {_frame('device', None)} END AS history_device_count FROM txn""",
)
def _(spark, folder):
    made = pit.behavioural_features(events(spark, folder), [EntityFeatures("device", ("device",), history=True)])
    return made.select("txn_id", "history_device_count")


@query(
    "w5_new_entity",
    f"""WITH {EVENTS} SELECT txn_id, CASE WHEN email IS NULL THEN NULL
        WHEN count(*) {_frame('email', None)} = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_new_email FROM txn""",
)
def _(spark, folder):
    made = pit.behavioural_features(events(spark, folder), [EntityFeatures("email", ("email",), history=True)])
    return made.select("txn_id", "is_new_email")


@query(
    "w6_composite_entity",
    f"""WITH {EVENTS}, w AS (SELECT *, count(*) {_frame('card, email', None)} AS seen,
          t - max(t) {_frame('card, email', None)} AS recency_card_email,
          count(*) {_frame('card, email', HOURS['24h'])} AS velocity_card_email_24h FROM txn)
        SELECT txn_id, velocity_card_email_24h, recency_card_email,
          CASE WHEN email IS NOT NULL AND card IS NOT NULL THEN seen END AS history_card_email_count,
          CASE WHEN email IS NULL OR card IS NULL THEN NULL WHEN seen = 0 THEN 1.0::DOUBLE
               ELSE 0.0::DOUBLE END AS is_new_card_email FROM w""",
)
def _(spark, folder):
    spec = EntityFeatures(
        "card_email", ("card", "email"), velocity={"24h": 24 * HOUR}, recency=True, history=True
    )
    return pit.behavioural_features(events(spark, folder), [spec])


@query(
    "w8_deterministic_order",
    f"WITH {ORDERS} SELECT txn_id, t, card, amount FROM txn ORDER BY t, txn_id",
)
def _(spark, folder):
    return orders(spark, folder).orderBy("t", "txn_id").select("txn_id", "t", "card", "amount")


SPLIT_SQL = """ranked AS (SELECT *, row_number() OVER (ORDER BY t, txn_id) - 1 AS pos, count(*) OVER () AS n FROM txn),
split AS (SELECT *, CASE WHEN pos < CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) THEN 'train'
  WHEN pos < CAST(floor(n * CAST(0.85 AS DOUBLE)) AS BIGINT) THEN 'validation' ELSE 'test' END AS split FROM ranked)"""


@query(
    "w9_carry_over",
    f"""WITH {ORDERS}, {SPLIT_SQL}, w AS (SELECT *, {_velocity_sql('card', 'card', DAYS)[2]},
          count(*) {_frame('card', None)} AS history_card_count FROM split WHERE split <> 'test')
        SELECT txn_id, velocity_card_30d, history_card_count FROM w WHERE split = 'validation'""",
)
def _(spark, folder):
    tagged = splits.ratio_split(orders(spark, folder))
    train = tagged.where(F.col("split") == "train").drop("split")
    validation = tagged.where(F.col("split") == "validation").drop("split")
    spec = EntityFeatures("card", ("card",), velocity={"30d": 30 * DAY}, history=True)
    made = pit.with_history_of([train], validation, lambda df: pit.entity_features(df, spec))
    return made.select("txn_id", "velocity_card_30d", "history_card_count")


BUNDLE = [
    EntityFeatures("all", velocity=MINUTES, amounts=HOURS, recency=True),
    EntityFeatures("card", ("card",), velocity=MINUTES, amounts=HOURS, recency=True, history=True),
    EntityFeatures("product", ("product",), history=True),
    EntityFeatures("device", ("device",), history=True),
    EntityFeatures("email", ("email",), history=True),
]


def _bundle_sql(cte: str = EVENTS, rows: str = "txn", keep: str = "true") -> str:
    inner, outer = [], []
    for name, partition in (("all", ""), ("card", "card")):
        inner += _velocity_sql(name, partition, MINUTES)
        outer += [f"velocity_{name}_{label}" for label in MINUTES]
        more, finished = _amount_sql(name, partition, HOURS)
        inner += [*more, f"t - max(t) {_frame(partition, None)} AS recency_{name}"]
        outer += [*finished, f"recency_{name}"]
    for name in ("card", "product", "device", "email"):
        inner.append(f"CASE WHEN {name} IS NOT NULL THEN count(*) {_frame(name, None)} END AS history_{name}_count")
        outer += [
            f"history_{name}_count",
            f"CASE WHEN history_{name}_count IS NULL THEN NULL WHEN history_{name}_count = 0 "
            f"THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_new_{name}",
        ]
    return f"WITH {cte}, w AS (SELECT *, {', '.join(inner)} FROM {rows}) SELECT txn_id, {', '.join(outer)} FROM w WHERE {keep}"


@query("w10_behavioural_bundle", _bundle_sql())
def behavioural_bundle(spark, folder):
    """All 34 behavioural columns in one plan."""
    return rounded(pit.behavioural_features(events(spark, folder), BUNDLE), nudge=NUDGE)


@query("w9_bundle_carry_over", _bundle_sql(f"{EVENTS}, {SPLIT_SQL}", "split", "split = 'test'"))
def _(spark, folder):
    """All 34 columns of the last split, with the earlier splits as history."""
    tagged = splits.ratio_split(events(spark, folder))
    parts = [tagged.where(F.col("split") == s).drop("split") for s in ("train", "validation", "test")]
    made = pit.with_history_of(parts[:2], parts[2], lambda df: pit.behavioural_features(df, BUNDLE))
    return rounded(made, nudge=NUDGE)


@query(
    "w11_feature_guards",
    f"""WITH {ORDERS}, per_key AS (SELECT txn_id, count(*) AS n FROM txn GROUP BY txn_id)
        SELECT CAST(sum(n) AS BIGINT) AS feature_rows, (SELECT count(*) FROM txn) AS source_rows,
          count(*) FILTER (WHERE n > 1) AS repeated_keys, 2 AS present_columns, 0 AS missing_columns FROM per_key""",
)
def _(spark, folder):
    source = orders(spark, folder)
    spec = EntityFeatures("card", ("card",), velocity={"7d": 7 * DAY}, recency=True)
    made = pit.behavioural_features(source, [spec])
    pit.require_features(made, source, "txn_id", spec.outputs(), 2)
    return pit.feature_guards(made, source, "txn_id", spec.outputs())


@query(
    "w11_feature_guards_broken",
    f"""WITH {ORDERS} SELECT count(*) FILTER (WHERE txn_id % 41 <> 0) + count(*) FILTER (WHERE txn_id % 41 <> 0 AND txn_id % 43 = 1) AS feature_rows,
          count(*) AS source_rows, count(*) FILTER (WHERE txn_id % 41 <> 0 AND txn_id % 43 = 1) AS repeated_keys, 1 AS present_columns, 1 AS missing_columns FROM txn""",
)
def _(spark, folder):
    """The feature rules over a table that lacks rows and a column, and repeats keys."""
    source = orders(spark, folder)
    spec = EntityFeatures("card", ("card",), velocity={"7d": 7 * DAY}, recency=True)
    made = pit.behavioural_features(source, [spec]).where("txn_id % 41 <> 0").drop("recency_card")
    return pit.feature_guards(made.unionByName(made.where("txn_id % 43 = 1")), source, "txn_id", spec.outputs())


def _catalogue_sql(name: str) -> str:
    return f"""SELECT 'history_{name}' AS feature, '{name}' AS entity, '' AS windows, 'strictly earlier timestamps' AS availability,
      false AS uses_target, 'v1' AS version, round(avg(CASE WHEN {name} IS NULL THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS null_rate FROM txn"""


@query(
    "w12_feature_catalogue",
    f"WITH {EVENTS} {' UNION ALL '.join(_catalogue_sql(n) for n in ('card', 'product', 'device', 'email'))}",
)
def _(spark, folder):
    """Catalogue rows with the measured null rate of each family's first column."""
    specs = [s for s in BUNDLE if s.history]
    made = pit.behavioural_features(events(spark, folder), [
        EntityFeatures(s.name, s.columns, history=True) for s in specs
    ])
    measured = made.agg(
        *(F.avg(F.col(f"history_{s.name}_count").isNull().cast("int")).alias(s.name) for s in specs)
    ).unpivot([], [s.name for s in specs], "name", "null_rate")
    records = [r for r in pit.feature_catalogue(specs, "v1") if r["feature"].startswith("history")]
    catalogue = spark.createDataFrame(records)
    return rounded(
        catalogue.join(measured, F.col("feature") == F.concat(F.lit("history_"), F.col("name"))).drop("name")
    )
