"""Historical features of a transaction that use only strictly earlier transactions.

Rows sharing a timestamp see the same history. Amounts are counted in whole units, so that every sum is
exact and a zero variance is exactly zero. The unit of an amount (its lane) follows from that amount
alone: the first of a few decimal places in which it is exact, else a power of two. What a window
yields therefore depends on its own amounts, never on the rest of the table or on how it is cut into
periods. Amounts that are not finite are skipped like NULL.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.scalars import all_of, finite
from hindcast.operators.ordered import Layout, before, profile
from hindcast.roles import EntityFeatures, Roles

DIRECT_FRAME_ROWS = 500
#: Rows, before they are repeated for their expiries, that a task of a sweep is meant to hold.
SWEPT_ROWS = 100_000
TOTAL = "decimal(38,0)"
#: Decimal places tried for an amount, and the whole numbers that doubles hold without gaps.
PLACES, EXACT = (2, 6, 10, 14, 18, 22), float(2**53)
#: Lanes of amounts without a decimal unit: one for each so many powers of two, in units 2^-54 of the lowest.
BINARY, POWERS, FINER = 1000, 16, 54
#: Units are cut here when their squares would not fit into one sum.
HALF = 35


@dataclass(frozen=True)
class Lane:
    """Amounts counted in the same unit; ``wide`` keeps the squares of their units in three sums."""

    number: int
    wide: bool = False

    def scaled(self, value: Column) -> Column:
        """A double in units of this lane; powers of two lose nothing, in two steps since one may exceed the doubles."""
        if self.number in PLACES:
            return F.rint(value * F.lit(10.0**self.number))
        power = FINER - POWERS * (self.number - BINARY)
        return value * F.lit(2.0 ** (power // 2)) * F.lit(2.0 ** (power - power // 2))

    def amount(self, units: Column) -> Column:
        """Units (double) as an amount."""
        if self.number in PLACES:
            return units / F.lit(10.0**self.number)
        power = POWERS * (self.number - BINARY) - FINER
        return units * F.lit(2.0 ** (power // 2)) * F.lit(2.0 ** (power - power // 2))

    @property
    def squares(self) -> int:
        return 3 if self.wide else 1


def entity_features(
    rows: DataFrame,
    spec: EntityFeatures,
    roles: Roles = Roles(),
    layout: Layout | None = None,
    lanes: list[Lane] | None = None,
) -> DataFrame:
    """Append velocity, amount, recency and history columns of one entity.

    Bounded lookbacks use RANGE frames while the entity stays small. A large entity gets one sweep:
    each transaction enters at its time and leaves each window when it expires, so the cost of a
    window does not depend on its length. A given layout must cover ``spec_group(spec)``.
    """
    columns = rows.columns
    rows = _grouped(rows, spec, roles)
    group = spec_group(spec)
    layout = layout or profile(rows, roles.time, (group,))
    if group != spec.columns:
        work = before(rows.withColumn("_one", F.lit(1).cast("long")), group, roles.time, {"_seen": "_one"}, layout)
        return work.select(*columns, *_finish(spec, roles))
    if spec.amounts and lanes is None:
        lanes = amount_lanes(rows, roles.amount)
    lanes = lanes if spec.amounts else []
    work = _with_units(rows, roles.amount, lanes) if lanes else rows
    small = group and layout.largest.get(group, layout.rows) <= DIRECT_FRAME_ROWS
    work = _framed(work, spec, roles, lanes) if small else _swept(work, spec, roles, layout, lanes)
    work = _with_moments(work, list(spec.amounts), lanes)
    return work.select(*columns, *_finish(spec, roles))


def spec_group(spec: EntityFeatures) -> tuple[str, ...]:
    """The grouping columns of a spec; history alone spreads the unknown entities."""
    if spec.history and not (spec.velocity or spec.amounts or spec.recency):
        return (*spec.columns, spread_name(spec.columns))
    return spec.columns


def _grouped(rows: DataFrame, spec: EntityFeatures, roles: Roles) -> DataFrame:
    spread = spread_name(spec.columns)
    if spec_group(spec) == spec.columns or spread in rows.columns:
        return rows
    return spread_unknown(rows, spec.columns, roles.key)


def spread_name(columns: tuple[str, ...]) -> str:
    return "_spread_" + "_".join(columns)


def spread_unknown(rows: DataFrame, columns: tuple[str, ...], key: str) -> DataFrame:
    """A helper grouping column: 0 for known entities, many values where an entity column is NULL.

    For features that are NULL for unknown entities anyway, those rows then never pile up.
    """
    known = all_of(F.col(c).isNotNull() for c in columns)
    return rows.withColumn(spread_name(columns), F.when(known, F.lit(0)).otherwise(F.pmod(F.xxhash64(key), F.lit(4096)).cast("int")))


def lane_number(amount: Column) -> Column:
    """The lane of an amount; NULL when it is not finite."""
    value = finite(amount.cast("double"))
    fits = []
    for places in PLACES:
        units = value * F.lit(10.0**places)
        # Both are whole and below 2^53, so the division gives the amount back exactly if it is this many units.
        fits.append(F.when((F.abs(units) < EXACT) & (F.rint(units) / F.lit(10.0**places) == value), F.lit(places)))
    return F.coalesce(*fits, (F.floor(F.log2(F.abs(value)) / POWERS) + BINARY).cast("int"))


def amount_lanes(rows: DataFrame, amount: str) -> list[Lane]:
    """The lanes that hold an amount, and whether 38 digits hold the squares of their units in one sum.

    That choice is about room alone: one sum or three, the sum of squares is the same whole number.
    """
    value = finite(F.col(amount).cast("double"))
    found = rows.where(value.isNotNull()).groupBy(lane_number(F.col(amount)).alias("lane")).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(value)).alias("most"))
    lanes = []
    for row in sorted(found.collect(), key=lambda r: r["lane"]):  # at most one row for each of 140 lanes
        decimal = row["lane"] in PLACES
        units = row["most"] * 10.0 ** row["lane"] if decimal else 2.0 ** (POWERS + FINER + 1)
        lanes.append(Lane(row["lane"], 2 * math.log10(units + 1) + math.log10(row["n"]) >= 37))
    return lanes


def _with_units(rows: DataFrame, amount: str, lanes: list[Lane]) -> DataFrame:
    """``_units{i}`` and its squares ``_square{i}_{k}``, for each lane i; NULL where the amount is of another lane."""
    work = rows.withColumn("_lane", lane_number(F.col(amount)))
    value = finite(F.col(amount).cast("double"))
    low = float(2**HALF)
    for i, lane in enumerate(lanes):
        units = F.when(F.col("_lane") == lane.number, lane.scaled(value))
        if not lane.wide:
            work = work.withColumn(f"_units{i}", units.cast("long").cast("decimal(19,0)"))
            squares = [F.col(f"_units{i}") * F.col(f"_units{i}")]
        else:
            # Doubles hold both halves exactly; the upper one keeps the sign.
            work = work.withColumn("_high", F.floor(units / low).cast("decimal(19,0)"))
            work = work.withColumn("_low", (units - F.floor(units / low).cast("double") * low).cast("long").cast("decimal(19,0)"))
            work = work.withColumn(f"_units{i}", (F.col("_high") * F.lit(Decimal(2**HALF)) + F.col("_low")).cast(TOTAL))
            squares = [F.col("_high") * F.col("_high"), F.col("_high") * F.col("_low"), F.col("_low") * F.col("_low")]
        work = work.withColumns({f"_square{i}_{k}": x.cast(TOTAL) for k, x in enumerate(squares)})
    return work.drop("_lane", "_high", "_low")


def _measures(lanes: list[Lane]) -> dict[str, str]:
    """The columns that windows add up, by the name of their sum: amounts counted, units and squares of each lane."""
    made = {}
    for i, lane in enumerate(lanes):
        made |= {f"an{i}": f"_counted{i}", f"as{i}": f"_units{i}"} | {f"aq{i}_{k}": f"_square{i}_{k}" for k in range(lane.squares)}
    return made


def _framed(work: DataFrame, spec: EntityFeatures, roles: Roles, lanes: list[Lane]) -> DataFrame:
    ordered = Window.partitionBy(*spec.columns).orderBy(roles.time)
    past = ordered.rangeBetween(Window.unboundedPreceding, -1)
    made = []
    for label, length in spec.velocity.items():
        made.append(F.count(F.lit(1)).over(ordered.rangeBetween(-length, -1)).alias(f"_n_{label}"))
    for label, length in spec.amounts.items():
        frame = ordered.rangeBetween(-length, -1)
        for name, column in _measures(lanes).items():
            if name.startswith("an"):
                made.append(F.count(f"_units{name[2:]}").over(frame).alias(f"_{name}_{label}"))
            else:
                made.append(F.coalesce(F.sum(column).over(frame), F.lit(0)).cast(TOTAL).alias(f"_{name}_{label}"))
    if spec.recency:
        made.append(F.max(roles.time).over(past).alias("_last"))
    if spec.history:
        made.append(F.count(F.lit(1)).over(past).alias("_seen"))
    return work.select("*", *made)


def _swept(work: DataFrame, spec: EntityFeatures, roles: Roles, layout: Layout, lanes: list[Lane]) -> DataFrame:
    """Arrivals add to the running totals, expiries of window w at time t + w are kept apart."""
    windows = sorted({*spec.velocity.values(), *spec.amounts.values()})
    if windows and not layout.splits(spec.columns):
        # Dealt by entity before the rows are repeated, so that their repetitions are never shuffled.
        least = work.sparkSession.sparkContext.defaultParallelism
        work = work.repartition(max(least, layout.rows // SWEPT_ROWS), *spec.columns)
    elif windows and layout.rows <= layout.rows_per_chunk:
        # A small table may be one file split; the expansion below should still use every core.
        work = work.repartition(work.sparkSession.sparkContext.defaultParallelism, roles.key)
    with_amount = set(spec.amounts.values())
    events = work
    if windows:
        moves = F.array(F.lit(0).cast("long"), *(F.lit(w).cast("long") for w in windows))
        events = work.withColumn("_shift", F.explode(moves))
    else:
        events = work.withColumn("_shift", F.lit(0).cast("long"))
    arrival = F.col("_shift") == 0
    one = F.lit(1).cast("long")
    measures = _measures(lanes)

    def moved(name: str, when: Column) -> Column:
        if name.startswith("an"):
            return F.when(when & F.col(f"_units{name[2:]}").isNotNull(), one)
        return F.when(when, F.col(measures[name]).cast(TOTAL))

    contributions = {"_c_n": F.when(arrival, one)} | {f"_c_{name}": moved(name, arrival) for name in measures if with_amount}
    for w in windows:
        leaving = F.col("_shift") == w
        contributions[f"_x_n_{w}"] = F.when(leaving, one)
        if w in with_amount:
            contributions |= {f"_x_{name}_{w}": moved(name, leaving) for name in measures}
    # An expiry needs its place and what it takes away; the other columns travel with the arrival alone.
    placed = {*spec.columns, roles.time}
    helpers = {"_shift", *measures.values()}
    events = events.select(
        *(F.col(c) if c in placed else F.when(arrival, F.col(c)).alias(c) for c in work.columns if c not in helpers),
        (F.col(roles.time) + F.col("_shift")).alias("_at"),
        arrival.alias("_arrival"),
        *(c.alias(n) for n, c in contributions.items()),
        F.when(arrival, F.col(roles.time)).alias("_c_t"),
    )
    if layout.last is not None:
        events = events.where(F.col("_arrival") | (F.col("_at") < F.lit(layout.last)))
    # A burst of arrivals is also a burst of expiries one window later: cut the axis there as well.
    edges = sorted({e + w for e in layout.edges for w in (0, *windows)})
    done = before(
        events,
        spec.columns,
        "_at",
        sums={f"_before{n}": n for n in contributions},
        maxima={"_last": "_c_t"} if spec.recency else {},
        layout=replace(layout, edges=tuple(edges)),
        probe="_arrival",
        origin=roles.time,
    )
    made = [
        (F.col("_before_c_n") - F.col(f"_before_x_n_{w}")).alias(f"_n_{label}")
        for label, w in spec.velocity.items()
    ]
    for label, w in spec.amounts.items():
        for name in measures:
            inside = F.col(f"_before_c_{name}") - F.col(f"_before_x_{name}_{w}")
            made.append((inside if name.startswith("an") else inside.cast(TOTAL)).alias(f"_{name}_{label}"))
    if spec.history:
        made.append(F.col("_before_c_n").alias("_seen"))
    return done.select("*", *made)


def _squares(sums: list[Column]) -> tuple[Column, Column]:
    """The sum of squares as a whole number, NULL beyond 38 digits, and as a double."""
    if len(sums) == 1:
        return sums[0], sums[0].cast("double")
    upper, mixed, lower = sums
    parts = [F.try_multiply(upper, F.lit(Decimal(2 ** (2 * HALF)))), F.try_multiply(mixed, F.lit(Decimal(2 ** (HALF + 1)))), lower]
    whole = reduce(F.try_add, (p.cast(TOTAL) for p in parts))
    rough = upper.cast("double") * float(2 ** (2 * HALF)) + mixed.cast("double") * float(2 ** (HALF + 1)) + lower.cast("double")
    return whole, F.coalesce(whole.cast("double"), rough)


def _deviation(n: Column, total: Column, whole: Column, squares: Column) -> Column:
    """sqrt(n * squares - total^2) / n in units: exact where 38 digits hold the products, in doubles beyond."""
    exact = F.try_subtract(F.try_multiply(n.cast("decimal(12,0)"), whole), F.try_multiply(total, total)).cast("double")
    wide = total.cast("double")
    rough = F.greatest(n.cast("double") * squares - wide * wide, F.lit(0.0))
    # A constant window has no deviation, whatever a product of doubles says.
    constant = (F.pmod(total, n.cast("decimal(12,0)")) == 0) & (squares == wide / n * wide)
    return F.sqrt(F.coalesce(exact, F.when(constant, 0.0).otherwise(rough))) / n


def _with_moments(work: DataFrame, labels: list[str], lanes: list[Lane]) -> DataFrame:
    """``_total_``, ``_mean_`` and ``_std_`` of each window: exact within a lane, lanes combined by their means and deviations.

    Step by step, since each step uses the columns of the last one more than once.
    """
    if not lanes:
        nothing = F.lit(None).cast("double")
        return work.withColumns({f"_{kind}_{label}": F.lit(0.0) if kind == "total" else nothing for kind in ("total", "mean", "std") for label in labels})
    every = range(len(lanes))
    column = lambda kind, i, label: F.col(f"_{kind}{i}_{label}")
    squares = {}
    for label in labels:
        for i, lane in enumerate(lanes):
            squares[f"_whole{i}_{label}"], squares[f"_rough{i}_{label}"] = _squares([F.col(f"_aq{i}_{k}_{label}") for k in range(lane.squares)])
    work = work.withColumns(squares)
    own = {}
    for label in labels:
        for i, lane in enumerate(lanes):
            n, s = column("an", i, label), column("as", i, label)
            own[f"_mean{i}_{label}"] = F.when(n > 0, lane.amount(s.cast("double") / n))
            own[f"_std{i}_{label}"] = F.when(n > 0, lane.amount(_deviation(n, s, column("whole", i, label), column("rough", i, label))))
        own[f"_n_amounts_{label}"] = reduce(lambda a, b: a + b, (column("an", i, label) for i in every))
        own[f"_total_{label}"] = reduce(lambda a, b: a + b, (lane.amount(column("as", i, label).cast("double")) for i, lane in enumerate(lanes)))
    work = work.withColumns(own)
    alone = lambda label, kind: [F.when(column("an", i, label) == F.col(f"_n_amounts_{label}"), column(kind, i, label)) for i in every]
    if len(lanes) == 1:
        single = {f"_mean_{label}": column("mean", 0, label) for label in labels}
        return work.withColumns(single | {f"_std_{label}": F.when(column("an", 0, label) > 1, column("std", 0, label)) for label in labels})
    number = {label: F.col(f"_n_amounts_{label}") for label in labels}
    mixed = {label: F.when(number[label] > 0, F.col(f"_total_{label}") / number[label]) for label in labels}
    work = work.withColumns({f"_mean_{label}": F.coalesce(*alone(label, "mean"), mixed[label]) for label in labels})
    apart = {f"_apart{i}_{label}": F.coalesce(column("mean", i, label) - F.col(f"_mean_{label}"), F.lit(0.0)) for label in labels for i in every}
    work = work.withColumns(apart | {f"_std{i}_{label}": F.coalesce(column("std", i, label), F.lit(0.0)) for label in labels for i in every})
    # In units of the largest, so that no square overflows.
    work = work.withColumns({f"_most_{label}": F.greatest(*(F.abs(column(kind, i, label)) for kind in ("std", "apart") for i in every)) for label in labels})
    spread = {}
    for label in labels:
        most = F.col(f"_most_{label}")
        parts = [column("an", i, label) * ((column(kind, i, label) / most) * (column(kind, i, label) / most)) for i in every for kind in ("std", "apart")]
        pooled = F.when(most > 0, most * F.sqrt(reduce(lambda a, b: a + b, parts) / number[label])).otherwise(0.0)
        spread[f"_std_{label}"] = F.when(number[label] > 1, F.coalesce(*alone(label, "std"), pooled))
    return work.withColumns(spread)


def _finish(spec: EntityFeatures, roles: Roles) -> list[Column]:
    out = [F.col(f"_n_{label}").alias(f"velocity_{spec.name}_{label}") for label in spec.velocity]
    for label in spec.amounts:
        total, mean, std = (F.col(f"_{kind}_{label}") for kind in ("total", "mean", "std"))
        zscore = F.when(std > 0, (finite(F.col(roles.amount).cast("double")) - mean) / std)
        prefix = f"amount_{spec.name}_{label}"
        out += [mean.alias(f"{prefix}_mean"), std.alias(f"{prefix}_std"), zscore.alias(f"{prefix}_zscore")]
        if spec.sums:
            out.append(total.alias(f"{prefix}_sum"))
    if spec.recency:
        out.append((F.col(roles.time) - F.col("_last")).alias(f"recency_{spec.name}"))
    if spec.history:
        known = all_of(F.col(c).isNotNull() for c in spec.columns)
        seen = F.when(known, F.col("_seen"))
        out += [
            seen.alias(f"history_{spec.name}_count"),
            (seen == 0).cast("double").alias(f"is_new_{spec.name}"),
        ]
    return out


def behavioural_features(
    rows: DataFrame,
    specs: list[EntityFeatures],
    roles: Roles = Roles(),
    layout: Layout | None = None,
) -> DataFrame:
    """Every feature of every spec, as a narrow table (key, features) to be joined on the key.

    Specs over the same entity share one exchange, since their windows partition alike.
    """
    entities = list(dict.fromkeys(c for s in specs for c in s.columns))
    work = rows.select(*dict.fromkeys([roles.key, roles.time, roles.amount, *entities]))
    for spec in specs:
        work = _grouped(work, spec, roles)
    # Profiled once on the plain rows, before any window is stacked on them.
    layout = layout or profile(work, roles.time, tuple(dict.fromkeys(spec_group(s) for s in specs)))
    lanes = amount_lanes(rows, roles.amount) if any(s.amounts for s in specs) else None
    # Entities with a count alone come first: the many columns of the others then travel through fewer exchanges.
    wide = {s.columns for s in specs if s.velocity or s.amounts or s.recency}
    for spec in sorted(specs, key=lambda s: (s.columns in wide, s.columns)):
        work = entity_features(work, spec, roles, layout, lanes)
    return work.select(roles.key, *(o for s in specs for o in s.outputs()))


def with_history_of(
    earlier: list[DataFrame], current: DataFrame, compute, tag: str = "split", key: str = Roles().key
) -> DataFrame:
    """Compute over earlier splits and the current one, then keep the current rows only.

    Operators that append columns pass the tag through. A bundle returns its key and features only; its rows are then
    those whose key is in the current split.
    """
    tagged = [df.withColumn(tag, F.lit(i)) for i, df in enumerate([*earlier, current])]
    made = compute(reduce(lambda a, b: a.unionByName(b), tagged))
    if tag in made.columns:
        return made.where(F.col(tag) == len(earlier)).drop(tag)
    return made.join(current.select(key), key, "left_semi")


def feature_guards(features: DataFrame, source: DataFrame, key: str, expected: list[str]) -> DataFrame:
    """One row of facts a feature table must satisfy: same rows, unique key, expected columns."""
    repeated = features.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    facts = repeated.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("feature_rows"),
        F.count_if(F.col("n") > 1).alias("repeated_keys"),
    )
    missing = [c for c in expected if c not in features.columns]
    return facts.select(
        "feature_rows",
        source.agg(F.count(F.lit(1))).scalar().alias("source_rows"),
        "repeated_keys",
        F.lit(len(expected) - len(missing)).alias("present_columns"),
        F.lit(len(missing)).alias("missing_columns"),
    )


def require_features(
    features: DataFrame, source: DataFrame, key: str, expected: list[str], expected_count: int | None = None
) -> None:
    """Raise unless the feature table holds every source row once and every expected column."""
    if expected_count is not None and len(expected) != expected_count:
        raise ValueError(f"expected {expected_count} feature columns, the specs define {len(expected)}")
    facts = feature_guards(features, source, key, expected).first()
    if facts["missing_columns"]:
        raise ValueError(f"{facts['missing_columns']} feature columns are missing")
    if facts["repeated_keys"] or facts["feature_rows"] != facts["source_rows"]:
        raise ValueError(
            f"{facts['feature_rows']} feature rows for {facts['source_rows']} source rows, "
            f"{facts['repeated_keys']} repeated keys"
        )


def feature_catalogue(specs: list[EntityFeatures], version: str) -> list[dict]:
    """One record per feature family, for publishing beside the feature table."""
    records = []
    for spec in specs:
        entity = "_".join(spec.columns) or "all"
        families = [
            ("velocity", list(spec.velocity), bool(spec.velocity)),
            ("amount", list(spec.amounts), bool(spec.amounts)),
            ("recency", [], spec.recency),
            ("history", [], spec.history),
        ]
        for family, windows, wanted in families:
            if wanted:
                records.append(
                    {
                        "feature": f"{family}_{spec.name}",
                        "entity": entity,
                        "windows": ",".join(windows),
                        "availability": "strictly earlier timestamps",
                        "uses_target": False,
                        "version": version,
                    }
                )
    return records
