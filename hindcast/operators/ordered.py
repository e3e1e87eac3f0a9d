"""Order-dependent aggregates that never need one task per entity.

``before`` gives every row an aggregate over the rows of its group with a strictly smaller order
value. Small groups use an ordinary window. When some group is large (a hot card, or the whole
table as one group) the order axis is cut into chunks, each chunk is its own window partition, and
a small table of chunk totals supplies the carry. Rows that share one (group, order) point in bulk
are first combined map-side into a single representative.

``order_statistics`` finds exact values at given positions by narrowing a value bracket, so an
exact median of a huge column needs neither a sort of the column nor one large aggregation buffer.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.session import written

ROWS_PER_CHUNK = 2_000_000
#: A chunk, once time is cut, holds no more than this, so that the memory of its task does not grow with the table.
CHUNK_ROWS = 100_000
MAX_CHUNKS = 4096
MAX_HOT_POINTS = 4096
# The sketch overstates a count by up to about 3.5 / SKETCH_ITEMS of the rows, well below a chunk.
SKETCH_ITEMS = 32_768

_FIRST_LONG = -(2**62)
_CHUNK, _CARRY, _REP = "_chunk", "_carry", "_rep"


@dataclass(frozen=True)
class Layout:
    """What one cheap profiling job learnt about a table: it steers plans, never results."""

    rows: int
    edges: tuple[float, ...] = ()
    largest: dict[tuple[str, ...], int] = field(default_factory=dict)
    hot_points: dict[tuple[str, ...], tuple[int, ...]] = field(default_factory=dict)
    rows_per_chunk: int = ROWS_PER_CHUNK
    last: object = None

    def splits(self, group: tuple[str, ...]) -> bool:
        """Whether some group exceeds what a chunk would hold anyway."""
        chunk = max(self.rows_per_chunk, self.rows // MAX_CHUNKS)
        return not group or self.largest.get(group, self.rows) > chunk


def profile(
    rows: DataFrame,
    order: str,
    groups: tuple[tuple[str, ...], ...] = ((),),
    rows_per_chunk: int = ROWS_PER_CHUNK,
    max_chunks: int = MAX_CHUNKS,
) -> Layout:
    """Row count and frequent-item sketches in one job; order quantiles only if a group must split.

    The sketches bound the largest group from above and list the (group, order) points that hold
    many rows. Both are bounded in size whatever the table.
    """
    sketches = {}
    for i, group in enumerate(groups):
        if group:
            sketches[f"group_{i}"] = (group, 1)
        sketches[f"points_{i}"] = ((*group, order), MAX_HOT_POINTS)
    facts = _frequent(rows, sketches, F.max(order))
    n = facts["rows"]
    largest, hot = {}, {}
    for i, group in enumerate(groups):
        if group:
            top = facts[f"group_{i}"]
            largest[group] = min(n, top[0]["count"]) if top else n
        limit = max(rows_per_chunk // 4, n // MAX_HOT_POINTS)
        hot[group] = tuple(p["item"] for p in facts[f"points_{i}"] if p["count"] > limit)
    layout = Layout(n, (), largest, hot, rows_per_chunk, facts["last"])
    if not any(layout.splits(g) for g in groups):
        return layout
    parallelism = rows.sparkSession.sparkContext.defaultParallelism
    target = min(rows_per_chunk, CHUNK_ROWS, max(n // parallelism, 2_000))
    return replace(layout, edges=order_edges(rows, order, min(max_chunks, math.ceil(n / target))))


#: Sketches of tasks meet in so many groups before the last task merges them.
MERGE_GROUPS = 1024


def _by_task(rows: DataFrame) -> DataFrame:
    """Rows with the group in which the sketches of their task are merged first."""
    return rows.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))


def order_edges(rows: DataFrame, order: str, chunks: int) -> tuple[float, ...]:
    """Approximate quantiles that cut the order axis into chunks of similar size.

    Sketches merge in two levels, so the last task meets a bounded number however many tasks there are.
    """
    if chunks < 2:
        return ()
    items = min(65_535, max(200, 8 * chunks))
    values = _by_task(rows.select(F.col(order).cast("double").alias("v")))
    sketches = values.groupBy("_group").agg(F.expr(f"kll_sketch_agg_double(v, {items})").alias("s"), F.count("v").alias("n")).where("n > 0")
    # Grouped by nothing but a constant: an empty table then has no row, and no sketch of nothing to read.
    whole = sketches.groupBy(F.lit(0).alias("all")).agg(F.expr(f"kll_merge_agg_double(s, {items})").alias("s"))
    shares = ", ".join(f"{i / chunks!r}D" for i in range(1, chunks))
    found = whole.select(F.expr(f"kll_sketch_get_quantile_double(s, array({shares}))").alias("q")).first()
    return tuple(sorted(set(found["q"]))) if found else ()


def _frequent(rows: DataFrame, sketches: dict[str, tuple[tuple[str, ...], int]], last: Column) -> dict:
    """One job: the row count, ``last``, and for each name the k most frequent values (hashed) of its columns."""
    state = {name: f"approx_top_k_accumulate(xxhash64({', '.join(f'`{c}`' for c in columns)}), {SKETCH_ITEMS})" for name, (columns, _) in sketches.items()}
    first = _by_task(rows).groupBy("_group").agg(F.count(F.lit(1)).alias("rows"), last.alias("last"), *(F.expr(e).alias(n) for n, e in state.items()))
    merged = (F.expr(f"approx_top_k_estimate(approx_top_k_combine(`{n}`, {SKETCH_ITEMS}), {k})").alias(n) for n, (_, k) in sketches.items())
    facts = first.groupBy(F.lit(0).alias("all")).agg(F.sum("rows").alias("rows"), F.max("last").alias("last"), *merged).first()
    if facts is None:
        return {"rows": 0, "last": None} | {n: [] for n in sketches}
    return facts.asDict() | {n: facts[n] or [] for n in sketches}


def with_chunk(rows: DataFrame, order: str, edges: tuple[float, ...], name: str = _CHUNK) -> DataFrame:
    """Number of edges at or below the order value; equal values always share a chunk."""
    if not edges:
        return rows.withColumn(name, F.lit(0))
    probe = f"{name}_value"
    cutter = Bucketizer(
        splits=[-math.inf, *edges, math.inf],
        inputCol=probe,
        outputCol=f"{name}_raw",
        handleInvalid="keep",
    )
    cut = cutter.transform(rows.withColumn(probe, F.col(order).cast("double")))
    return cut.withColumn(name, F.col(f"{name}_raw").cast("int")).drop(probe, f"{name}_raw")


def before(
    events: DataFrame,
    group: tuple[str, ...],
    order: str,
    sums: dict[str, str] | None = None,
    layout: Layout | None = None,
    maxima: dict[str, str] | None = None,
    probe: str | None = None,
    unique: bool = False,
    origin: str | None = None,
) -> DataFrame:
    """Append, to every event (or only those where ``probe``), aggregates over strictly earlier ones.

    ``sums`` and ``maxima`` map an output name to an input column. ``order`` must be integral, or
    ``unique`` must state that (group, order) never repeats. Events without predecessors get 0 for
    sums and NULL for maxima. NULL group values form one group, as a window partition does.
    ``origin`` names the column the layout was profiled on when that is not ``order`` itself.
    """
    sums, maxima = sums or {}, maxima or {}
    layout = layout or profile(events, order, (group,))
    columns = events.columns
    if not layout.splits(group):
        window = _earlier(Window.partitionBy(*group), order, unique)
        done = events.select("*", *_over(sums, maxima, window))
        return done.where(F.col(probe)) if probe else done

    work = with_chunk(events, order, layout.edges).withColumn(_REP, F.lit(False))
    hot = layout.hot_points.get(group, ())
    crowded = None
    if hot and not unique:
        is_hot = F.xxhash64(*group, origin or order).isin(list(hot))
        crowded = events.where(is_hot)
        merged = (
            work.where(is_hot)
            .groupBy(*group, order, _CHUNK)
            .agg(*_totals(sums, maxima))
            .withColumn(_REP, F.lit(True))
        )
        work = work.where(~is_hot).unionByName(merged, allowMissingColumns=True)

    totals = work.groupBy(*group, _CHUNK).agg(*_totals(sums, maxima))
    # At most MAX_CHUNKS (plus hot edges) rows per group reach this window.
    earlier_chunks = Window.partitionBy(*group).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    floor = F.lit(-math.inf if events.schema[order].dataType == T.DoubleType() else _FIRST_LONG)
    carry = totals.select(
        *group,
        _CHUNK,
        floor.cast(events.schema[order].dataType).alias(order),
        *(F.sum(c).over(earlier_chunks).cast(events.schema[c].dataType).alias(c) for c in dict.fromkeys(sums.values())),
        *(F.max(c).over(earlier_chunks).alias(c) for c in dict.fromkeys(maxima.values())),
        F.lit(True).alias(_CARRY),
        F.row_number().over(Window.partitionBy(*group).orderBy(_CHUNK)).alias("_place"),
    ).where(F.col("_place") > 1).drop("_place")
    framed = work.withColumn(_CARRY, F.lit(False)).unionByName(carry, allowMissingColumns=True)
    # About a chunk for each task: left alone, Spark would gather many until their compressed size fills one.
    framed = framed.repartition(len(layout.edges) + 1, *group, _CHUNK)
    window = _earlier(Window.partitionBy(*group, _CHUNK), order, unique)
    done = framed.select("*", *_over(sums, maxima, window)).where(~F.col(_CARRY))
    outputs = [*sums, *maxima]
    plain = done.where(~F.col(_REP)) if crowded is not None else done
    if probe:
        plain = plain.where(F.col(probe))
    plain = plain.select(*columns, *outputs)
    if crowded is None:
        return plain
    # One representative per hot point: at most MAX_HOT_POINTS rows, so this side is always small.
    looked_up = done.where(F.col(_REP)).select(
        *(F.col(c).alias(f"_hot_{c}") for c in (*group, order)), *outputs
    )
    same_point = reduce(
        lambda a, b: a & b,
        (F.col(c).eqNullSafe(F.col(f"_hot_{c}")) for c in (*group, order)),
    )
    if probe:
        crowded = crowded.where(F.col(probe))
    attached = crowded.join(F.broadcast(looked_up), same_point, "left").select(*columns, *outputs)
    return plain.unionByName(attached)


def _earlier(spec, order: str, unique: bool):
    spec = spec.orderBy(F.col(order).asc_nulls_first())
    if unique:
        return spec.rowsBetween(Window.unboundedPreceding, -1)
    return spec.rangeBetween(Window.unboundedPreceding, -1)


def _over(sums, maxima, window) -> list[Column]:
    zero = F.lit(0)
    return [F.coalesce(F.sum(c).over(window), zero).alias(n) for n, c in sums.items()] + [
        F.max(c).over(window).alias(n) for n, c in maxima.items()
    ]


def _totals(sums, maxima) -> list[Column]:
    return [F.sum(c).alias(c) for c in dict.fromkeys(sums.values())] + [
        F.max(c).alias(c) for c in dict.fromkeys(maxima.values())
    ]


def as_of(
    probes: DataFrame,
    states: DataFrame,
    group: tuple[str, ...],
    order: str,
    values: tuple[str, ...],
    layout: Layout | None = None,
) -> DataFrame:
    """Give each probe the values of the latest state of its group strictly before its time.

    States sharing one (group, order) point resolve to the largest value tuple.
    """
    state = F.struct(order, *values)
    marked = probes.withColumn("_probe", F.lit(True)).unionByName(
        states.select(*group, order, state.alias("_state"), F.lit(False).alias("_probe")),
        allowMissingColumns=True,
    )
    found = before(marked, group, order, layout=layout, maxima={"_found": "_state"}, probe="_probe")
    return found.select(*probes.columns, *(F.col(f"_found.{v}").alias(v) for v in values))


MAX_COPIES = 4096


@dataclass(frozen=True)
class HotKeys:
    """Hashes of the keys that hold very many rows, and how finely to spread them."""

    hashes: tuple[int, ...] = ()
    copies: int = 1


def hot_keys(rows: DataFrame, keys: list[tuple[str, ...]], limit: int = ROWS_PER_CHUNK // 4) -> list[HotKeys]:
    """The crowded values of several keys from one sketch job; at most ``MAX_HOT_POINTS`` of each."""
    facts = _frequent(rows, {str(i): (k, MAX_HOT_POINTS) for i, k in enumerate(keys)}, F.lit(0))
    bar = max(limit, facts["rows"] // MAX_HOT_POINTS)
    found = []
    for i in range(len(keys)):
        hot = [p for p in facts[str(i)] if p["count"] > bar]
        most = max((p["count"] for p in hot), default=0)
        found.append(HotKeys(tuple(p["item"] for p in hot), min(MAX_COPIES, -(-most // limit) or 1)))
    return found


def attach(
    rows: DataFrame, states: DataFrame, on: tuple[str, ...], salt_by: str, hot: HotKeys | None = None
) -> DataFrame:
    """Left join rows to one state per key, spreading keys that hold very many rows.

    Only the state rows of hot keys are copied, so the copies stay few whatever the table.
    """
    hot = hot or hot_keys(rows, [on])[0]
    if not hot.hashes:
        return rows.join(states, list(on), "left")
    is_hot = F.xxhash64(*on).isin(list(hot.hashes))
    slot = F.when(is_hot, F.pmod(F.xxhash64(salt_by), F.lit(hot.copies))).otherwise(F.lit(0)).cast("int")
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(hot.copies - 1))).otherwise(F.array(F.lit(0)))
    spread = states.withColumn("_slot", F.explode(every))
    return rows.withColumn("_slot", slot).join(spread, [*on, "_slot"], "left").drop("_slot")


SELECT_LIMIT = 1_000_000


def order_statistics(
    rows: DataFrame,
    targets: dict[str, tuple[Column, list[int]]],
    limit: int = SELECT_LIMIT,
    counts: list[int] | None = None,
) -> dict[str, dict[int, tuple[object, int]]]:
    """Exact values at 0-based ascending positions, with the number of strictly smaller values.

    ``targets`` maps a name to a column (its NULLs are ignored) and the wanted positions. Each
    round narrows every position to a bracket between two approximate quantiles; only brackets of
    at most ``limit`` rows, or of one distinct value, are finally counted value by value. What
    reaches the driver is one value per position.
    """
    answers: dict[str, dict[int, tuple[object, int]]] = {name: {} for name in targets}
    names = list(targets)
    base = rows.select(*(targets[n][0].alias(f"_v{i}") for i, n in enumerate(names)))
    if counts is None:
        counts = base.agg(*(F.count(f"_v{i}").alias(str(i)) for i in range(len(names)))).first()
    open_brackets = []
    for i, name in enumerate(names):
        for position in targets[name][1]:
            if not 0 <= position < counts[i]:
                raise ValueError(f"position {position} of {name} lies outside its {counts[i]} values")
            open_brackets.append(_Bracket(i, position, None, None, 0, counts[i]))
    if any(b.size > limit for b in open_brackets):
        base = written(base)
    while wide := [b for b in open_brackets if b.size > limit]:
        small = [b for b in open_brackets if b.size <= limit]
        narrowed = _narrow(base, wide)
        open_brackets = small + [b for b in narrowed if isinstance(b, _Bracket)]
        for slot, position, value, below in (b for b in narrowed if not isinstance(b, _Bracket)):
            answers[names[slot]][position] = (value, below)
    for slot, position, value, below in _pick(base, open_brackets):
        answers[names[slot]][position] = (value, below)
    return answers


@dataclass(frozen=True)
class _Bracket:
    """The open value interval that holds a position, the rows below it and the rows inside."""

    slot: int
    position: int
    above: object
    under: object
    below: int
    size: int

    def inside(self) -> Column:
        value = F.col(f"_v{self.slot}")
        test = value.isNotNull()
        if self.above is not None:
            test = test & (value > F.lit(self.above))
        if self.under is not None:
            test = test & (value < F.lit(self.under))
        return test


#: Entries of a sketch that guesses brackets, a bound on its error in rank that is rarely exceeded, and the ranks it is asked for.
GUESS_ITEMS, GUESS_ERROR, GUESS_STEPS = 2048, 0.003, 400


def _narrow(base: DataFrame, brackets: list[_Bracket]) -> list:
    """One round of two jobs for each type of value: guess two quantiles of every bracket, then count exactly around them.

    The values inside the brackets stand below each other, so that the plan does not grow with the brackets, and their
    sketches merge in two levels, so that no task meets all of them. Each guess is a value inside the interval: a bracket
    either settles on it or loses it.
    """
    narrowed = []
    for kind, group in _by_kind(base, brackets).items():
        sketch = "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else "double"
        values = _inside(base, group).withColumn("v", F.col("value").cast(sketch))
        states = _by_task(values).groupBy("j", "_group").agg(F.expr(f"kll_sketch_agg_{sketch}(v, {GUESS_ITEMS})").alias("s"))
        whole = states.groupBy("j").agg(F.expr(f"kll_merge_agg_{sketch}(s, {GUESS_ITEMS})").alias("s"))
        ranks = [(b.position - b.below) / max(b.size - 1, 1) for b in group]
        ends = [(max(0, math.floor((r - GUESS_ERROR) * GUESS_STEPS)), min(GUESS_STEPS, math.ceil((r + GUESS_ERROR) * GUESS_STEPS))) for r in ranks]
        steps = ", ".join(f"{i / GUESS_STEPS!r}D" for i in range(GUESS_STEPS + 1))
        grid = whole.select("j", F.expr(f"kll_sketch_get_quantile_{sketch}(s, array({steps}))").alias("grid"))
        guess = [F.get("grid", F.get(F.lit([e[i] for e in ends]), F.col("j"))).cast(kind) for i in (0, 1)]
        bounds = {row["j"]: (row["low"], row["high"]) for row in grid.select("j", guess[0].alias("low"), guess[1].alias("high")).collect()}
        lows, highs = (F.get(F.array(*(F.lit(bounds[j][i]).cast(kind) for j in range(len(group)))), F.col("j")) for i in (0, 1))
        value = F.col("value")
        counted = (value < lows, value <= lows, value < highs, value <= highs)
        seen = values.groupBy("j").agg(*(F.count_if(test).alias(str(i)) for i, test in enumerate(counted))).collect()
        for row in seen:
            b, (low_value, high_value) = group[row["j"]], bounds[row["j"]]
            # What lies outside the interval has been counted before.
            narrowed.append(_settled(b, low_value, high_value, *(b.below + row[str(i)] for i in range(4))))
    return narrowed


def _settled(b: _Bracket, low, high, under_low: int, to_low: int, under_high: int, to_high: int):
    """The bracket after counting around two of its values, or the answer if one of them is it."""
    if b.position < under_low:
        return replace(b, under=low, size=under_low - b.below)
    if b.position < to_low:
        return (b.slot, b.position, low, under_low)
    if b.position < under_high:
        return replace(b, above=low, under=high, below=to_low, size=under_high - to_low)
    if b.position < to_high:
        return (b.slot, b.position, high, under_high)
    return replace(b, above=high, below=to_high, size=b.below + b.size - to_high)


def _by_kind(base: DataFrame, brackets: list[_Bracket]) -> dict[str, list[_Bracket]]:
    """Brackets by the type of their values."""
    kinds = dict(base.dtypes)
    found: dict[str, list[_Bracket]] = {}
    for b in brackets:
        found.setdefault(kinds[f"_v{b.slot}"], []).append(b)
    return found


def _inside(base: DataFrame, brackets: list[_Bracket]) -> DataFrame:
    """(j, value): the values of one type inside bracket j."""
    entries = [F.when(b.inside(), F.struct(F.lit(j).alias("j"), F.col(f"_v{b.slot}").alias("value"))) for j, b in enumerate(brackets)]
    return base.select(F.explode(F.array_compact(F.array(*entries))).alias("b")).select("b.j", "b.value")


def _pick(base: DataFrame, brackets: list[_Bracket]) -> list[tuple]:
    """Resolve brackets of bounded size by counting their distinct values, one job per value type.

    Positions that share an interval share its counts.
    """
    kinds = dict(base.dtypes)
    by_kind: dict[str, dict[tuple, list[_Bracket]]] = {}
    for b in brackets:
        interval = (b.slot, b.above, b.under, b.below)
        by_kind.setdefault(kinds[f"_v{b.slot}"], {}).setdefault(interval, []).append(b)
    found = []
    running = Window.partitionBy("j").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    for intervals in by_kind.values():
        members = list(intervals.values())
        entries = [
            F.when(same[0].inside(), F.struct(F.lit(j).alias("j"), F.col(f"_v{same[0].slot}").alias("value")))
            for j, same in enumerate(members)
        ]
        counted = (
            base.select(F.explode(F.array_compact(F.array(*entries))).alias("b"))
            .groupBy("b.j", "b.value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        below = _choose([F.lit(same[0].below) for same in members])
        wanted = _choose([F.array(*(F.lit(b.position) for b in same)) for same in members], "array<bigint>")
        placed = counted.withColumn("start", below + F.coalesce(F.sum("n").over(running), F.lit(0)))
        hits = F.filter(wanted, lambda p: (F.col("start") <= p) & (p < F.col("start") + F.col("n")))
        for row in placed.select("j", "value", "start", F.explode(hits).alias("position")).collect():
            found.append((members[row["j"]][0].slot, row["position"], row["value"], row["start"]))
    return found


def _choose(values: list[Column], kind: str = "bigint") -> Column:
    return F.coalesce(*(F.when(F.col("j") == j, v.cast(kind)) for j, v in enumerate(values)))


def quantiles(
    rows: DataFrame,
    columns: dict[str, Column],
    probabilities: list[float],
    limit: int = SELECT_LIMIT,
) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of several columns; NULLs are ignored."""
    names = list(columns)
    counts = rows.agg(*(F.count(columns[n]).alias(str(i)) for i, n in enumerate(names))).first()
    wanted, places = {}, {}
    for i, name in enumerate(names):
        n = counts[i]
        if n == 0:
            continue
        places[name] = [(n - 1) * p for p in probabilities]
        positions = {math.floor(x) for x in places[name]} | {math.ceil(x) for x in places[name]}
        wanted[name] = (columns[name], sorted(positions))
    present = [counts[i] for i, name in enumerate(names) if name in places]
    values = order_statistics(rows, wanted, limit, present) if wanted else {}
    result: dict[str, list[float | None]] = {}
    for name in names:
        if name not in places:
            result[name] = [None] * len(probabilities)
            continue
        result[name] = []
        for x in places[name]:
            low, high = float(values[name][math.floor(x)][0]), float(values[name][math.ceil(x)][0])
            result[name].append(low + (high - low) * (x - math.floor(x)))
    return result


def rows_at(
    rows: DataFrame, order: Column, key: str, positions: list[int], limit: int = SELECT_LIMIT
) -> list[tuple[object, object]]:
    """The (order, key) pairs at global 0-based positions when sorted by order, then key."""
    # Two searches read the pairs, each more than once.
    rows = written(rows.select(order.alias("_order"), F.col(key).alias("_key")))
    order, key = F.col("_order"), "_key"
    values = order_statistics(rows, {"order": (order, sorted(set(positions)))}, limit)["order"]
    tied = {}
    for i, position in enumerate(sorted(set(positions))):
        value, below = values[position]
        tied[str(position)] = (F.when(order == F.lit(value), F.col(key)), [position - below])
    keys = order_statistics(rows, tied, limit)
    pick = {p: (values[p][0], keys[str(p)][p - values[p][1]][0]) for p in values}
    return [pick[p] for p in positions]


def sorts_before(order: Column, key: Column, boundary: tuple[object, object]) -> Column:
    """Whether (order, key) sorts strictly before a boundary pair."""
    return (order < F.lit(boundary[0])) | ((order == F.lit(boundary[0])) & (key < F.lit(boundary[1])))
