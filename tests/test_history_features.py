"""Graph, sequence and encoding operators against plain-Python models on small random tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hindcast.operators import components, encoding, graph, ordered, sequence
from hindcast.roles import Roles

SCHEMA = "txn_id long, t long, card long, device string, email string, amount double, label int"


def random_table(spark, n=220, seed=2, crowd=0.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = 40 if rng.random() < crowd else rng.randint(0, 90)
        rows.append(
            (
                i,
                t,
                None if rng.random() < 0.08 else rng.randint(1, 25),
                None if rng.random() < 0.3 else f"d{rng.randint(1, 30)}",
                None if rng.random() < 0.3 else f"e{rng.randint(1, 12)}",
                round(rng.uniform(0, 50), 2),
                int(rng.random() < 0.3),
            )
        )
    return spark.createDataFrame(rows, SCHEMA), rows


def component_size(node, links):
    if not any(node in e for e in links):
        return 0
    seen, stack = {node}, [node]
    while stack:
        x = stack.pop()
        for a, b in links:
            for y, z in ((a, b), (b, a)):
                if y == x and z not in seen:
                    seen.add(z)
                    stack.append(z)
    return len(seen)


@pytest.mark.parametrize("crowd", [0.0, 0.4, 1.0])
def test_component_sizes_equal_brute_force(spark, crowd):
    df, rows = random_table(spark, crowd=crowd)
    got = {r["txn_id"]: r for r in graph.prior_component_sizes(df).collect()}
    assert len(got) == len(rows)
    for i, t, card, device, email, _, _ in rows:
        links = set()
        for _, t2, c, d, e, _, _ in rows:
            if t2 < t and c is not None:
                links |= {(("c", c), ("d", d))} if d is not None else set()
                links |= {(("c", c), ("e", e))} if e is not None else set()
        assert got[i]["card_prior_component_size"] == (None if card is None else component_size(("c", card), links))
        for name, kind, value in (("device", "d", device), ("email", "e", email)):
            expected = None if card is None or value is None else component_size((kind, value), links)
            assert got[i][f"{name}_prior_component_size"] == expected


def sizes_by_replay(links, probes):
    """Union-find over the edges in time order; lookups of a time come before its edges."""
    parent, size, out = {}, {}, {}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    moves = sorted([(t, 1, u, v) for u, v, t in links if u != v] + [(t, 0, n, "") for n, t in probes])
    for t, is_edge, u, v in moves:
        if not is_edge:
            out[u, t] = size[root(u)] if u in parent else 0
            continue
        for x in (u, v):
            if x not in parent:
                parent[x], size[x] = x, 1
        a, b = root(u), root(v)
        if a != b:
            parent[b] = a
            size[a] += size[b]
    return out


def components_of(spark, links, probes):
    made = components.component_sizes(
        spark.createDataFrame(links, "u string, v string, t long"), spark.createDataFrame(probes, "node string, t long")
    )
    return {(r["node"], r["t"]): r["component_size"] for r in made.collect()}


@pytest.mark.parametrize("shape", ["rising", "falling", "star", "equal", "random", "cycles"])
def test_component_sizes_of_shapes(spark, shape):
    rng = random.Random(shape)
    path = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)]
    links = {
        "rising": [(u, v, i) for i, (u, v) in enumerate(path)],
        "falling": [(u, v, 70 - i) for i, (u, v) in enumerate(path)],
        "star": [("hub", f"n{i}", i // 3) for i in range(60)],
        "equal": [(u, v, 5) for u, v in path] + [("x", "x", 1)],
        "random": [(u, v, rng.randint(0, 40)) for u, v in {tuple(sorted(rng.sample([f"k{i}" for i in range(60)], 2))) for _ in range(75)}],
        "cycles": [(f"{c}{i}", f"{c}{(i + 1) % 9}", rng.randint(0, 20)) for c in "abc" for i in range(9)] + [("a0", "b0", 12), ("b3", "c3", 2)],
    }[shape]
    nodes = sorted({x for u, v, _ in links for x in (u, v)} | {"unseen"})
    probes = sorted({(rng.choice(nodes), rng.randint(0, 72)) for _ in range(250)})
    assert components_of(spark, links, probes) == sizes_by_replay(links, probes)


def test_component_sizes_without_edges(spark):
    assert components_of(spark, [], [("a", 3)]) == {("a", 3): 0}
    assert components_of(spark, [("a", "a", 1)], [("a", 3)]) == {("a", 3): 0}
    assert components_of(spark, [("a", "b", 1)], []) == {}


def test_component_sizes_of_split_groups(spark, monkeypatch):
    """The count within one giant component, with its time axis cut into chunks."""
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 50)
    monkeypatch.setattr(ordered.profile, "__defaults__", (((),), 50, ordered.MAX_CHUNKS))
    rng = random.Random(8)
    links = [(u, v, rng.randint(0, 60)) for u, v in {tuple(sorted(rng.sample([f"k{i}" for i in range(90)], 2))) for _ in range(160)}]
    probes = sorted({(f"k{rng.randrange(95)}", rng.randint(0, 62)) for _ in range(400)})
    assert components_of(spark, links, probes) == sizes_by_replay(links, probes)


def graph_expected(rows):
    """Degrees, edge counts and relationship flags by their definition."""
    out = {}
    for i, t, card, device, email, _, _ in rows:
        past = [r for r in rows if r[1] < t]
        links = {(r[2], f, v) for r in past for f, v in (("device", r[3]), ("email", r[4])) if r[2] is not None and v is not None}
        values = {"card_prior_degree": sum(c == card for c, _, _ in links)}
        for family, value, place in (("device", device, 3), ("email", email, 4)):
            both = card is not None and value is not None
            times = sum(r[2] == card and r[place] == value for r in past)
            values[f"{family}_prior_card_degree"] = None if value is None else sum((f, v) == (family, value) for _, f, v in links)
            values[f"card_{family}_prior_edge_count"] = times if both else None
            values[f"is_new_card_{family}"] = float(times == 0) if both else None
        out[i] = values
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_graph_features_equal_their_definition(spark, seed):
    df, rows = random_table(spark, 150, seed, crowd=0.3)
    known = [r for r in rows if r[2] is not None]
    forward = {r["txn_id"]: r.asDict() for r in graph.graph_features(df).collect()}
    shuffled = {r["txn_id"]: r.asDict() for r in graph.graph_features(df.orderBy(F.desc("txn_id")).repartition(5)).collect()}
    assert forward == shuffled
    wanted = graph_expected(rows)
    for row in known:
        for name, value in wanted[row[0]].items():
            assert forward[row[0]][name] == value, (row, name)

    last = df.where("t > 60")
    from hindcast.operators.pit import with_history_of

    carried = with_history_of([df.where("t <= 30"), df.where("t > 30 and t <= 60")], last, graph.graph_features)
    assert {r["txn_id"]: r.asDict() for r in carried.collect()} == {r[0]: forward[r[0]] for r in rows if r[1] > 60}


def test_graph_input_guards(spark):
    df, _ = random_table(spark, 20, 6)
    empty = graph.graph_features(df.limit(0))
    assert empty.columns == ["txn_id", *graph.GRAPH_COLUMNS] and empty.count() == 0
    with pytest.raises(ValueError, match="email"):
        graph.graph_features(df.drop("email"))
    with pytest.raises(ValueError, match="missing values"):
        graph.graph_features(df.withColumn("t", F.when(F.col("t") > 10, F.col("t"))))


@pytest.mark.parametrize("split", [False, True])
def test_sequences_equal_brute_force(spark, split):
    df, rows = random_table(spark, 160, 4, crowd=0.2)
    df = df.withColumn("card", F.when(F.col("card") > 6, F.lit(6)).otherwise(F.col("card")))
    layout = None
    if split:
        layout = ordered.Layout(160, (20.0, 40.0, 41.0, 70.0), {("card",): 160}, {("card",): ()}, 1, 90)
    made = sequence.sequences(df, 4, layout=layout, block=5 if split else None)
    got = {r["txn_id"]: r for r in made.collect()}
    assert len(got) == 160
    cards = {r[0]: (None if r[2] is None else min(r[2], 6)) for r in rows}

    def event(row):
        previous = [r[1] for r in rows if cards[row[0]] is not None and cards[r[0]] == cards[row[0]] and r[1] < row[1]]
        gap = row[1] - max(previous) if previous else 0
        return math.log1p(row[5]), math.log1p(gap)

    for row in rows:
        peers = [r for r in rows if cards[row[0]] is not None and cards[r[0]] == cards[row[0]] and r[1] < row[1]]
        history = [event(r) for r in sorted(peers, key=lambda r: (r[1], r[0]))][-3:]
        expected = [(0.0, 0.0)] * (3 - len(history)) + history + [event(row)]
        assert got[row[0]]["history_length"] == len(history)
        for have, want in zip(got[row[0]]["sequence"], expected, strict=True):
            assert tuple(have) == pytest.approx(want)


@pytest.mark.parametrize("folds", [3, 5])
def test_encoding_uses_history_only(spark, folds):
    df, rows = random_table(spark, 120, 11, crowd=0.2)
    settings = encoding.EncoderSettings(("email",), 2.0, 3)
    got = {r["txn_id"]: r["email_encoded"] for r in encoding.out_of_fold(df, settings, folds).collect()}
    times = sorted({r[1] for r in rows})
    size, extra = divmod(len(times), folds)  # larger folds first
    fold, at = {}, 0
    for f in range(folds):
        for t in times[at : at + size + (f < extra)]:
            fold[t] = f
        at += size + (f < extra)

    def encoded(past, category):
        rate = sum(r[6] for r in past) / len(past)
        own = [r[6] for r in past if r[4] == category]
        return rate if len(own) < 3 else (sum(own) + 2.0 * rate) / (len(own) + 2.0)

    for row in rows:
        past = [r for r in rows if fold[r[1]] < fold[row[1]]]
        assert got[row[0]] == (pytest.approx(encoded(past, row[4])) if past else None)
    fitted = encoding.fit(df, "label", settings)
    unseen = df.select("txn_id", F.when(F.col("txn_id") % 2 == 0, F.col("email")).otherwise("never seen").alias("email"))
    for r in fitted.transform(unseen, "txn_id").collect():
        category = rows[r["txn_id"]][4] if r["txn_id"] % 2 == 0 else "never seen"
        assert r["email_encoded"] == pytest.approx(encoded(rows, category))
    late = max(times)
    flipped = df.withColumn("label", F.when(F.col("t") == late, 1 - F.col("label")).otherwise(F.col("label")))
    assert {r["txn_id"]: r["email_encoded"] for r in encoding.out_of_fold(flipped, settings, folds).collect()} == got
    with pytest.raises(ValueError, match="0 and 1"):
        encoding.fit(df.withColumn("label", F.lit(3)), "label", settings)


def test_attach_salts_hot_keys(spark):
    rows = spark.range(500).select(F.col("id").alias("k"), F.when(F.col("id") < 300, F.lit(1)).otherwise(F.col("id") % 7).alias("g"))
    states = spark.createDataFrame([(g, g * 10) for g in range(6)], "g long, v long")
    (hot,) = ordered.hot_keys(rows, [("g",)], limit=50)
    assert hot.hashes and hot.copies > 1
    got = ordered.attach(rows, states, ("g",), "k", hot)
    assert got.count() == 500
    assert got.where("g = 6").where("v IS NOT NULL").count() == 0
    assert got.where("g < 6 AND v = g * 10").count() == rows.where("g < 6").count()


def test_history_of_hot_and_unknown_entities(spark):
    df, rows = random_table(spark, 200, 8, crowd=0.3)
    spec_layout = ordered.Layout(200, (30.0, 40.0, 41.0), {("device", "_spread_device"): 5000}, {}, 1, 90)
    from hindcast.operators.pit import entity_features
    from hindcast.roles import EntityFeatures

    made = entity_features(df, EntityFeatures("device", ("device",), history=True), Roles(), spec_layout)
    got = {r["txn_id"]: r["history_device_count"] for r in made.collect()}
    for i, t, _, device, *_ in rows:
        expected = None if device is None else sum(r[3] == device and r[1] < t for r in rows)
        assert got[i] == expected
