"""Historical window features against their definition, computed row by row in Python on random tables."""

import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from hindcast.operators import ordered, pit
from hindcast.roles import EntityFeatures

SCHEMA = "txn_id long, t long, amount double, card long, device string, label int"
SPECS = [
    EntityFeatures("all", velocity={"short": 9}, amounts={"long": 40}, recency=True),
    EntityFeatures("card", ("card",), {"short": 9}, {"long": 40}, recency=True, history=True, sums=True),
    EntityFeatures("device", ("device",), history=True),
]


def random_rows(seed, n=150, unit=0.01):
    """Few cards and devices, crowded times, some unknown devices, amounts in the given unit, a card with one amount."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        card = rng.randint(1, 6)
        amount = 3 * unit if card == 6 else round(rng.randint(1, 5000) * unit, 12)
        if rng.random() < 0.06:
            amount = rng.choice([None, float("nan"), float("inf")])
        rows.append((i, rng.choice([17, rng.randint(0, 99)]), amount, card, rng.choice([None, "p", "q", "r"]), rng.randint(0, 1)))
    return rows


def window_values(amounts, own):
    known = [a for a in amounts if a is not None and math.isfinite(a)]
    mean = math.fsum(known) / len(known) if known else None
    std = math.sqrt(math.fsum((a - mean) ** 2 for a in known) / len(known)) if len(known) > 1 else None
    if std is not None and len(set(known)) == 1:
        std = 0.0
    zscore = (own - mean) / std if std and own is not None and math.isfinite(own) else None
    return mean, std, zscore, math.fsum(known)


def expected(rows):
    out = {}
    for key, t, amount, card, device, _ in rows:
        values = {}
        for name, same in (("all", lambda r: True), ("card", lambda r, card=card: r[3] == card)):
            past = [r for r in rows if same(r) and r[1] < t]
            values[f"velocity_{name}_short"] = sum(r[1] >= t - 9 for r in past)
            mean, std, zscore, total = window_values([r[2] for r in past if r[1] >= t - 40], amount)
            values |= {f"amount_{name}_long_mean": mean, f"amount_{name}_long_std": std, f"amount_{name}_long_zscore": zscore}
            values[f"recency_{name}"] = t - max(r[1] for r in past) if past else None
            if name == "card":
                values["amount_card_long_sum"] = total
                values |= {"history_card_count": len(past), "is_new_card": float(not past)}
        seen = sum(r[4] == device and r[1] < t for r in rows)
        values |= {"history_device_count": None if device is None else seen, "is_new_device": None if device is None else float(not seen)}
        out[key] = values
    return out


def features(df, specs=SPECS, layout=None):
    return {r["txn_id"]: r.asDict() for r in pit.behavioural_features(df, specs, layout=layout).collect()}


def agree(got, wanted, unit):
    assert got.keys() == wanted.keys()
    for key, values in wanted.items():
        for name, value in values.items():
            assert got[key][name] == (value if value is None else pytest.approx(value, rel=1e-7, abs=1e-7 * unit)), (key, name)


@pytest.mark.parametrize("unit", [0.01, 1e-5, 1e6])
@pytest.mark.parametrize("split", [False, True])
def test_features_equal_their_definition(spark, unit, split):
    rows = random_rows(round(math.log10(unit)) % 97, unit=unit)
    df = spark.createDataFrame(rows, SCHEMA)
    layout = None
    if split:  # every group is cut in time and swept, as a large one would be
        groups = [pit.spec_group(s) for s in SPECS]
        layout = ordered.Layout(150, (16.0, 17.0, 18.0, 60.0), dict.fromkeys(groups, 5000), dict.fromkeys(groups, ()), 1, 99)
    agree(features(df, layout=layout), expected(rows), unit)


def test_labels_future_and_order_do_not_matter(spark):
    rows = random_rows(5)
    df = spark.createDataFrame(rows, SCHEMA)
    base = features(df)
    assert features(df.withColumn("label", 1 - F.col("label")).orderBy(F.desc("txn_id")).repartition(7)) == base
    cut = {r[0] for r in rows if r[1] <= 50}
    assert features(df.where("t <= 50")) == {k: v for k, v in base.items() if k in cut}


def test_large_sums_do_not_overflow(spark):
    """Units of 12 places, values of 1e9: totals leave a long at once, and products leave 38 digits."""
    rng = random.Random(2)
    rows = [(i, i, rng.randint(1, 9) * 1e9 + round(rng.random(), 12), 1, "p", 0) for i in range(60)]
    got = features(spark.createDataFrame(rows, SCHEMA), [SPECS[1]])
    wanted = {k: {n: v for n, v in values.items() if n.startswith(("amount_card", "velocity_card"))} for k, values in expected(rows).items()}
    agree(got, wanted, 1e3)


@pytest.mark.parametrize("split", [False, True])
def test_outliers_touch_only_windows_that_hold_one(spark, split):
    rows = random_rows(11)
    for key, outlier in ((3, 1e17), (40, 1e30), (77, -1e17)):
        rows[key] = (*rows[key][:2], outlier, 1, *rows[key][4:])
    rows += [(200 + i, 10 * i, 12.34 + i, 9, "p", 0) for i in range(8)]
    layout = None
    if split:
        groups = [pit.spec_group(s) for s in SPECS]
        layout = ordered.Layout(158, (16.0, 17.0, 18.0, 60.0), dict.fromkeys(groups, 5000), dict.fromkeys(groups, ()), 1, 99)
    agree(features(spark.createDataFrame(rows, SCHEMA), layout=layout), expected(rows), 0.01)


def test_lanes_follow_from_the_amount(spark):
    amounts = [0.0, 12.34, -7.0, 0.1234, 1e-13, 0.1234567890123456, 1e17, 1e300, 5e-324, math.pi, None, math.nan, -math.inf]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(amounts)], "i int, amount double")
    numbers = {r["i"]: r["n"] for r in df.select("i", pit.lane_number(F.col("amount")).alias("n")).collect()}
    group = lambda x: 1000 + math.floor(math.log2(x) / 16)
    assert [numbers[i] for i in range(13)] == [2, 2, 2, 6, 14, group(0.1234567890123456), group(1e17), group(1e300), group(5e-324), group(math.pi), None, None, None]
    lanes = pit.amount_lanes(df, "amount")
    assert [lane.number for lane in lanes] == sorted({n for n in numbers.values() if n is not None})
    # Units give every amount back, and the squares in three parts are those of the units.
    work = pit._with_units(df, "amount", [pit.Lane(lane.number, True) for lane in lanes])
    for row in work.collect():
        for i, lane in enumerate(lanes):
            if numbers[row["i"]] != lane.number:
                assert row[f"_units{i}"] is None
                continue
            units = int(row[f"_units{i}"])
            if lane.number in pit.PLACES:
                assert units / 10.0**lane.number == amounts[row["i"]]
            else:
                power = pit.POWERS * (lane.number - pit.BINARY) - pit.FINER
                assert Fraction(units) * Fraction(2) ** power == Fraction(amounts[row["i"]])
            parts = [int(row[f"_square{i}_{k}"]) for k in range(3)]
            assert (parts[0] << 70) + (parts[1] << 36) + parts[2] == units * units


def test_small_amounts_are_kept(spark):
    rows = [(i, i, a, 1, "p", 0) for i, a in enumerate([1e-13, 3e-13, 2e-13, 5.0])]
    got = features(spark.createDataFrame(rows, SCHEMA), [SPECS[1]])[3]
    assert got["amount_card_long_mean"] == 2e-13
    assert got["amount_card_long_std"] == pytest.approx(math.sqrt(2 / 3) * 1e-13, rel=1e-12)


@pytest.mark.parametrize("unit", [0.01, 1e-7, math.pi])
def test_windows_do_not_depend_on_the_rest_of_the_table(spark, unit):
    """To the last bit: other cards' amounts, more rows, and one sum of squares or three."""
    rng = random.Random(5)
    rows = [(i, i, rng.randint(1, 10**6) * unit, 1, "p", 0) for i in range(30)]
    rows += [(100 + i, i, 3 * unit, 2, "p", 0) for i in range(10)]
    more = [(200 + i, i, a, 3 + i % 4, "q", 0) for i, a in enumerate([1e30, 0.1234567, 1e9 + 0.01, 9e15] * 20)]
    alone = features(spark.createDataFrame(rows, SCHEMA), [SPECS[1]])
    among = features(spark.createDataFrame(rows + more, SCHEMA), [SPECS[1]])
    assert {k: among[k] for k in alone} == alone
    assert {alone[k]["amount_card_long_std"] for k in range(102, 110)} == {0.0}


@pytest.mark.parametrize("bundle", [False, True])
def test_carry_over_equals_the_whole_table(spark, bundle):
    rows = random_rows(8)
    df = spark.createDataFrame(rows, SCHEMA)
    parts = [df.where(c) for c in ("t < 30", "t >= 30 and t < 60", "t >= 60")]
    if bundle:
        made = pit.with_history_of(parts[:2], parts[2], lambda x: pit.behavioural_features(x, SPECS))
    else:
        made = pit.with_history_of(parts[:2], parts[2], lambda x: pit.entity_features(x, SPECS[1]))
        assert made.columns == [*df.columns, *SPECS[1].outputs()]
    late = {r[0] for r in rows if r[1] >= 60}
    names = [n for n in made.columns if n.startswith(("velocity", "amount_", "recency", "history", "is_new"))]
    whole = {k: {n: v[n] for n in names} for k, v in expected(rows).items() if k in late}
    agree({r["txn_id"]: r.asDict() for r in made.collect()}, whole, 0.01)


def test_guards_and_catalogue(spark):
    df = spark.createDataFrame(random_rows(3, 30), SCHEMA)
    made = pit.behavioural_features(df, SPECS)
    facts = pit.feature_guards(made, df, "txn_id", [*SPECS[1].outputs(), "absent"]).first()
    assert facts["feature_rows"] == facts["source_rows"] == 30
    assert facts["repeated_keys"] == 0 and facts["missing_columns"] == 1
    pit.require_features(made, df, "txn_id", SPECS[2].outputs(), 2)
    with pytest.raises(ValueError, match="missing"):
        pit.require_features(made, df, "txn_id", ["absent"])
    with pytest.raises(ValueError, match="source rows"):
        pit.require_features(made.where("txn_id > 1"), df, "txn_id", [])
    assert pit.feature_guards(made.union(made.limit(1)), df, "txn_id", []).first()["repeated_keys"] == 1
    records = pit.feature_catalogue(SPECS, "v1")
    assert len(records) == 8 and not any(r["uses_target"] for r in records)


def test_chunks_stay_small_however_many_rows(spark, monkeypatch):
    """A chunk of a cut time axis is bounded, and each has a task of its own."""
    df = spark.range(3000).select(F.col("id").alias("txn_id"), F.col("id").alias("t"), (F.col("id") % 7 + 0.25).alias("amount"))
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 100)
    layout = ordered.profile(df, "t", ((),), max_chunks=64)
    assert len(layout.edges) == 29
    made = ordered.before(df, (), "t", {"n": "txn_id"}, layout)
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()
    assert [r["n"] for r in made.orderBy("t").collect()] == [i * (i - 1) // 2 for i in range(3000)]


def test_expiries_are_not_shuffled_and_carry_nothing(spark):
    """Rows of a large entity are dealt out before they are repeated; only arrivals keep the other columns."""
    rows = [(i, i // 3, i % 2, float(i % 9), "x" * 50) for i in range(1500)]
    df = spark.createDataFrame(rows, "txn_id long, t long, card long, amount double, note string")
    spec = EntityFeatures("card", ("card",), {"w": 10}, {"w": 20}, recency=True, history=True)
    made = pit.entity_features(df, spec)
    plan = made._jdf.queryExecution().executedPlan().toString()
    generate = plan.index("Generate")
    assert "hashpartitioning(card" in plan[generate:] and "hashpartitioning(card" not in plan[:generate]
    assert "CASE WHEN" in plan and re.search(r"CASE WHEN \(_shift#\d+L = 0\) THEN note#\d+ END", plan)
    got = {r["txn_id"]: r for r in made.collect()}
    assert all(got[i]["note"] == "x" * 50 for i in range(1500))
    for i, t, card, *_ in rows[::97]:
        past = [r for r in rows if r[2] == card and r[1] < t]
        assert got[i]["history_card_count"] == len(past)
        assert got[i]["velocity_card_w"] == sum(r[1] >= t - 10 for r in past)
        near = [r[3] for r in past if r[1] >= t - 20]
        assert got[i]["amount_card_w_mean"] == (pytest.approx(sum(near) / len(near)) if near else None)
