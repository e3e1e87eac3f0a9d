import random

import pytest
from pyspark.sql import functions as F

from hindcast.operators import ordered, pit
from hindcast.roles import EntityFeatures, Roles


def random_rows(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        card = None if rng.random() < 0.05 else (1 if rng.random() < 0.4 else rng.randint(2, 9))
        t = 100 if rng.random() < 0.3 else rng.randint(0, 200)
        rows.append((i, t, card, round(rng.uniform(1, 90), 2)))
    return spark.createDataFrame(rows, "txn_id long, t long, card long, amount double"), rows


def split_layout(df, group, hot=True):
    base = ordered.profile(df, "t", (group,), rows_per_chunk=40, max_chunks=64)
    edges = (20.0, 60.0, 100.0, 101.0, 150.0)
    points = base.hot_points if hot else {group: ()}
    return ordered.Layout(base.rows, edges, {group: base.rows}, points, 1, base.last)


@pytest.mark.parametrize("group", [("card",), ()])
@pytest.mark.parametrize("hot", [True, False])
def test_split_path_equals_brute_force(spark, group, hot):
    df, rows = random_rows(spark)
    df = df.withColumn("one", F.lit(1).cast("long")).withColumn("last", F.col("t"))
    layout = split_layout(df, group, hot)
    assert not hot or layout.hot_points[group]
    got = ordered.before(df, group, "t", {"n": "one", "s": "amount"}, layout, {"prev": "last"})
    by_id = {r["txn_id"]: r for r in got.collect()}
    assert len(by_id) == len(rows)
    for i, t, card, _ in rows:
        earlier = [r for r in rows if r[1] < t and (not group or r[2] == card)]
        assert by_id[i]["n"] == len(earlier)
        assert by_id[i]["s"] == pytest.approx(sum(r[3] for r in earlier))
        assert by_id[i]["prev"] == max((r[1] for r in earlier), default=None)


@pytest.mark.parametrize("columns", [("card",), ()])
def test_sweep_equals_frames(spark, columns):
    df, rows = random_rows(spark, 300, 3)
    spec = EntityFeatures("x", columns, {"a": 5, "b": 60}, {"c": 30}, recency=True, history=bool(columns))
    swept = pit.entity_features(df, spec, Roles(), split_layout(df, columns))
    got = {r["txn_id"]: r for r in swept.collect()}
    for i, t, card, amount in rows:
        peers = [r for r in rows if r[1] < t and (not columns or r[2] == card)]
        assert got[i]["velocity_x_a"] == sum(r[1] >= t - 5 for r in peers)
        assert got[i]["velocity_x_b"] == sum(r[1] >= t - 60 for r in peers)
        inside = [r[3] for r in peers if r[1] >= t - 30]
        mean = sum(inside) / len(inside) if inside else None
        assert got[i]["amount_x_c_mean"] == (pytest.approx(mean) if inside else None)
        if len(inside) > 1:
            std = (sum((a - mean) ** 2 for a in inside) / len(inside)) ** 0.5
            assert got[i]["amount_x_c_std"] == pytest.approx(std, abs=1e-6)
        else:
            assert got[i]["amount_x_c_std"] is None
        assert got[i]["recency_x"] == (t - max(r[1] for r in peers) if peers else None)
    if columns:
        framed = pit.entity_features(df, spec, Roles(), ordered.profile(df, "t", (columns,)))
        assert sorted(framed.collect()) == sorted(swept.select(framed.columns).collect())


def test_order_statistics_with_narrowing(spark):
    rng = random.Random(5)
    values = [rng.choice([1.0, 1.0, 1.0, rng.random(), 7.5]) for _ in range(3000)] + [None] * 40
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    clean = sorted(v for v in values if v is not None)
    wanted = [0, 1, 500, 1200, 1500, 2400, len(clean) - 1]
    for limit in (10, 100, 10**6):
        got = ordered.order_statistics(df, {"v": (F.col("v"), wanted)}, limit)["v"]
        for p in wanted:
            assert got[p][0] == clean[p]
            assert got[p][1] == sum(x < clean[p] for x in clean)


def test_rows_at_breaks_ties_by_key(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([3, 3, 3, 5, rng.randint(0, 9)])) for i in rng.sample(range(10000), 700)]
    df = spark.createDataFrame(rows, "k long, v long")
    expected = sorted((v, k) for k, v in rows)
    got = ordered.rows_at(df, F.col("v"), "k", [0, 5, 350, 699], limit=20)
    assert got == [expected[p] for p in (0, 5, 350, 699)]


def test_carry_of_a_late_first_contribution(spark):
    """A column that is NULL in the early chunks must not hide the carry of the others."""
    rows = [(t, None if t < 60 else 1, 2) for t in range(100)]
    df = spark.createDataFrame(rows, "t long, late long, always long")
    layout = ordered.Layout(100, (30.0, 70.0), {}, {(): ()}, 1, 99)
    got = ordered.before(df, (), "t", {"a": "late", "b": "always"}, layout).collect()
    assert all((r["a"], r["b"]) == (max(0, r["t"] - 60), 2 * r["t"]) for r in got)


def test_as_of_takes_the_latest_strictly_earlier_state(spark):
    probes = spark.createDataFrame([(i, i % 2, i * 5) for i in range(20)], "k long, g long, t long")
    states = spark.createDataFrame([(g, t, t * 10) for g in (0, 1) for t in (0, 20, 50)], "g long, t long, v long")
    for layout in (None, ordered.Layout(20, (15.0, 45.0), {("g",): 99}, {("g",): ()}, 1, 95)):
        got = ordered.as_of(probes, states, ("g",), "t", ("v",), layout).collect()
        assert len(got) == 20
        for r in got:
            earlier = [t for t in (0, 20, 50) if t < r["t"]]
            assert r["v"] == (10 * earlier[-1] if earlier else None)
