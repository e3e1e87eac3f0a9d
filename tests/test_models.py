"""Preprocessing, classifiers, anomaly scores and streamed features."""

import math
import random
from collections import Counter
from dataclasses import replace
from inspect import signature
from itertools import accumulate

import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from hindcast.operators import anomaly, calibration, encoding, modelling, pit
from hindcast.plans import catalog, model_queries
from hindcast.roles import EntityFeatures
from hindcast.session import shared_path
from hindcast.sources import state
from hindcast.streaming import live
from hindcast.streaming.live import LiveFeatures, replay


def mixed_table(spark, seed, n=80):
    """Numbers with gaps and infinities, a column that is never filled, words with gaps."""
    rng = random.Random(seed)
    some = lambda value, share: value if rng.random() >= share else None
    rows = [
        (i, some(rng.choice([rng.gauss(5, 2), float("inf")] if rng.random() < 0.1 else [rng.gauss(5, 2)]), 0.2), rng.gauss(0, 3), None, some(rng.choice("abcd"), 0.3), f"k{seed}{rng.randint(0, 2)}")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "txn_id long, gappy double, full double, never double, letter string, kind string"), rows


def test_preprocessing_equals_its_definition(spark):
    train, rows = mixed_table(spark, 1)
    later, _ = mixed_table(spark, 2)  # none of its kinds was seen
    fitted = modelling.Preprocessor(["gappy", "full", "never"], ["letter", "kind"]).fit(train)
    known = sorted(r[1] for r in rows if r[1] is not None and math.isfinite(r[1]))
    half = len(known) // 2
    assert fitted.scaling["gappy"].median == pytest.approx(known[half] if len(known) % 2 else (known[half - 1] + known[half]) / 2)
    assert "never" not in fitted.scaling and fitted.scaling["gappy"].indicator and not fitted.scaling["full"].indicator
    counts = Counter(r[4] for r in rows if r[4] is not None)
    assert fitted.modes["letter"] == min(counts, key=lambda c: (-counts[c], c))
    letters, kinds = len(counts), len({r[5] for r in rows})
    sizes = {r["features"].size for df in (train, later) for r in fitted.transform(df).collect()}
    assert sizes == {fitted.width()} == {3 + letters + kinds}
    for r in fitted.transform(later).collect():
        values = r["features"].toArray()
        assert sum(values[3 : 3 + letters]) == 1.0 and not any(values[3 + letters :])
    columns = list(zip(*(r["features"].toArray()[:3] for r in fitted.transform(train).collect()), strict=True))
    assert all(sum(c) == pytest.approx(0, abs=1e-9) and sum(v * v for v in c) == pytest.approx(80) for c in columns)
    with pytest.raises(ValueError, match="missing"):
        fitted.transform(later.drop("kind"))
    with pytest.raises(ValueError, match="at least one"):
        modelling.Preprocessor([], []).fit(train)


def test_saved_state_gives_the_same_answers(spark, tmp_path):
    train, _ = mixed_table(spark, 3)
    later, _ = mixed_table(spark, 4)
    fitted = modelling.Preprocessor(["gappy", "full"], ["letter"]).fit(train)
    state.save_preprocessor(spark, fitted, f"{tmp_path}/prep")
    again = state.load_preprocessor(spark, f"{tmp_path}/prep")
    assert again.transform(later, ("txn_id",)).collect() == fitted.transform(later, ("txn_id",)).collect()
    with pytest.raises(ValueError, match="not a calibrator"):
        state.load_calibrator(spark, f"{tmp_path}/prep")

    scored = train.select("txn_id", (F.pmod(F.xxhash64("txn_id"), F.lit(1000)) / 1000.0).alias("score"))
    scored = scored.withColumn("label", (F.col("score") + F.pmod("txn_id", F.lit(7)) / 10.0 > 0.8).cast("int"))
    for method in calibration.METHODS:
        mapping = calibration.Calibrator(method).fit(scored)
        state.save_calibrator(spark, mapping, f"{tmp_path}/{method}")
        loaded = state.load_calibrator(spark, f"{tmp_path}/{method}")
        assert loaded.predict(scored).orderBy("txn_id").collect() == mapping.predict(scored).orderBy("txn_id").collect()
    with pytest.raises(RuntimeError, match="fitted"):
        state.save_calibrator(spark, calibration.Calibrator(), f"{tmp_path}/none")

    labelled = train.withColumn("label", (F.col("txn_id") % 3 == 0).cast("int"))
    encoder = encoding.fit(labelled, "label", encoding.EncoderSettings(("letter",), 1.0, 2))
    state.save_encoder(spark, encoder, f"{tmp_path}/encoder")
    loaded = state.load_encoder(spark, f"{tmp_path}/encoder")
    assert loaded.transform(later, "txn_id").orderBy("txn_id").collect() == encoder.transform(later, "txn_id").orderBy("txn_id").collect()

    forests = anomaly.fit_forests(train, "txn_id", ["gappy", "full"], {0: F.lit(True)}, anomaly.ForestSettings(trees=5, sample=16))
    state.save_forests(spark, forests, f"{tmp_path}/forests")
    loaded = state.load_forests(spark, f"{tmp_path}/forests")
    scores = [f.score(later, F.lit(0), ("txn_id",)).orderBy("txn_id").collect() for f in (forests, loaded)]
    assert scores[0] == scores[1]


def test_every_row_can_be_drawn(spark):
    """Small shares: one hash a row serves all trees, evenly and from the whole table."""
    settings = anomaly.ForestSettings(trees=20, sample=50)
    picks = anomaly._picks("txn_id", 0, F.lit(True), 0.004, settings)
    drawn = spark.range(200_000).select(F.col("id").alias("txn_id")).select("txn_id", F.explode(picks).alias("p"))
    by_tree = {r["tree"]: r["n"] for r in drawn.groupBy("p.tree").agg(F.count("*").alias("n")).collect()}
    assert set(by_tree) == set(range(20)) and all(650 < n < 950 for n in by_tree.values())
    thirds = [r["n"] for r in drawn.groupBy(F.floor(F.col("txn_id") / 66_667)).agg(F.count("*").alias("n")).collect()]
    assert max(thirds) < 1.1 * min(thirds)


def learning_table(spark, n=600):
    rng = random.Random(4)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(n)]
    rows = [(i, a, b, int(rng.random() < (0.8 if a + 0.5 * b > 0.8 else 0.1))) for i, a, b in rows]
    return spark.createDataFrame(rows, "txn_id long, a double, b double, label int")


def test_logistic_gradient_vanishes_and_weights_balance(spark):
    df = learning_table(spark)
    fitted = modelling.Preprocessor(["a", "b"], []).fit(df)
    prepared = fitted.transform(df, ("txn_id", "label"))
    model = modelling.fit_logistic(prepared, "label", 0.1)
    rows = modelling.score(modelling.fit_logistic(prepared, "label", 0.1), prepared).collect()
    x = {r["txn_id"]: r["features"].toArray() for r in prepared.collect()}
    positives = sum(r["label"] for r in rows)
    weight = {1: len(rows) / 2 / positives, 0: len(rows) / 2 / (len(rows) - positives)}
    for j in (0, 1):
        loss = sum(weight[r["label"]] * (r["score"] - r["label"]) * x[r["txn_id"]][j] for r in rows)
        assert 0.1 * loss + model.coefficients[j] == pytest.approx(0, abs=1e-2)
    assert modelling.class_weight(df, "label") == pytest.approx((len(rows) - positives) / positives)
    with pytest.raises(ValueError, match="both classes"):
        modelling.class_weight(df.where("label = 0"), "label")


def test_boosted_trees_learn(spark):
    df = learning_table(spark)
    prepared = modelling.Preprocessor(["a", "b"], []).fit(df).transform(df, ("txn_id", "label"))
    prepared = prepared.withColumn("stops", F.col("txn_id") % 5 == 0)
    scored = modelling.score(modelling.fit_boosted(prepared, "label", "stops", rounds=5, depth=3), prepared)
    means = {r["label"]: r["m"] for r in scored.groupBy("label").agg(F.avg("score").alias("m")).collect()}
    assert means[1] > means[0] + 0.1


def test_categories_get_slots_in_order(spark):
    rows = [(i, f"c{i * 7919 % 613:04d}", None if i % 5 else "x") for i in range(900)]
    train = spark.createDataFrame(rows, "txn_id long, many string, few string").repartition(5)
    fitted = modelling.Preprocessor([], ["many", "few"]).fit(train)
    names = sorted({r[1] for r in rows})
    assert fitted.widths == {"many": len(names), "few": 1} and fitted.width() == len(names) + 1
    later = spark.createDataFrame([(0, "c0000", "x"), (1, "unseen", None), (2, names[-1], "y"), (3, None, "x")], "txn_id long, many string, few string")
    got = {r["txn_id"]: r["features"].toArray().nonzero()[0].tolist() for r in fitted.transform(later, ("txn_id",)).collect()}
    last = len(names)
    mode = names.index(min(names, key=lambda n: (-sum(r[1] == n for r in rows), n)))
    assert got == {0: [0, last], 1: [last], 2: [last - 1], 3: [mode, last]}


def average_precision(pairs):
    """Step-wise over distinct scores."""
    hits = seen = 0
    total = 0.0
    for score in sorted({s for s, _ in pairs}, reverse=True):
        group = [y for s, y in pairs if s == score]
        hits, seen = hits + sum(group), seen + len(group)
        total += sum(group) * hits / seen
    return total / hits


def test_boosted_trees_keep_the_rounds_of_highest_precision(spark):
    df = learning_table(spark)
    prepared = modelling.Preprocessor(["a", "b"], []).fit(df).transform(df, ("txn_id", "label"))
    prepared = prepared.withColumn("stops", F.col("txn_id") % 5 == 0).cache()
    made = modelling.fit_boosted(prepared, "label", "stops", rounds=6, depth=3, patience=100)
    rows = made.margins(prepared.where("stops")).select("txn_id", "label", "margins").collect()
    curve = [average_precision([(r["margins"][i], r["label"]) for r in rows]) for i in range(6)]
    assert made.curve == pytest.approx(curve, rel=1e-12)
    assert made.kept == 1 + max(range(6), key=lambda i: (made.curve[i], -i))
    # All rounds give what Spark's own model gives; the kept ones, what their margin says.
    own = {r["txn_id"]: float(r["probability"][1]) for r in made.model.transform(prepared).select("txn_id", "probability").collect()}
    whole = {r["txn_id"]: r["score"] for r in modelling.score(replace(made, kept=6), prepared).collect()}
    assert whole == pytest.approx(own, rel=1e-9)
    short = {r["txn_id"]: r["score"] for r in modelling.score(replace(made, kept=2), prepared).collect()}
    assert {r["txn_id"]: 1 / (1 + math.exp(-2 * r["margins"][1])) for r in rows} == pytest.approx({r["txn_id"]: short[r["txn_id"]] for r in rows})
    # One class among the stopping rows: all rounds stay.
    alone = modelling.fit_boosted(prepared.where("not stops or label = 0"), "label", "stops", rounds=2, depth=2)
    assert (alone.kept, alone.curve) == (2, [])


def forest_table(spark, n=500):
    rng = random.Random(6)
    rows = [(i, i, rng.gauss(0, 1), rng.gauss(0, 1) if rng.random() > 0.1 else None) for i in range(n)]
    return spark.createDataFrame(rows + [(n, n, 40.0, 40.0)], "k long, t long, f1 double, f2 double")


def test_forest_finds_the_outlier(spark):
    df = forest_table(spark)
    settings = anomaly.ForestSettings(trees=40, sample=64)
    forests = anomaly.fit_forests(df, "k", ["f1", "f2"], {0: F.lit(True)}, settings)
    rows = forests.score(df, F.lit(0), ("k",)).collect()
    scores = {r["k"]: r["anomaly_score"] for r in rows}
    assert len(scores) == 501 and max(scores, key=scores.get) == 500
    above = sum(s > 0 for s in scores.values()) / 501
    assert above == pytest.approx(settings.contamination, abs=0.005)
    again = anomaly.fit_forests(df.repartition(7), "k", ["f1", "f2"], {0: F.lit(True)}, settings)
    assert {r["k"]: r["anomaly_score"] for r in again.score(df, F.lit(0), ("k",)).collect()} == pytest.approx(scores)
    with pytest.raises(ValueError, match="at least one"):
        anomaly.fit_forests(df, "k", [], {0: F.lit(True)}, settings)
    with pytest.raises(ValueError, match="no training rows"):
        anomaly.fit_forests(df, "k", ["f1"], {0: F.lit(False)}, settings)


def test_forests_score_each_row_once_whatever_the_splits(spark):
    """Overlapping forests in one pass, equal to a walk from node to node; the rows of one split are dealt out first."""
    df = forest_table(spark, 300).coalesce(1)
    settings = anomaly.ForestSettings(trees=7, sample=50)
    members = {1: F.col("k") < 200, 2: F.col("k") >= 100}
    forests = anomaly.fit_forests(df, "k", ["f1", "f2"], members, settings)
    made = {r["k"]: r for r in forests.raw_scores(df, members, ("k",)).collect()}
    assert len(made) == 301
    trees = {f: [t.set_index("node") for _, t in nodes.groupby("tree")] for f, nodes in forests.nodes.groupby("forest")}
    for row in df.collect():
        for f, member in {1: row["k"] < 200, 2: row["k"] >= 100}.items():
            path = expected = 0.0
            for tree in trees[f]:
                at = tree.loc[0]
                while at["feature"] >= 0:
                    name = ("f1", "f2")[int(at["feature"])]
                    value = forests.medians[f][name] if row[name] is None else row[name]
                    at = tree.loc[at["left"] if value <= at["threshold"] else at["right"]]
                path += at["depth"] + float(anomaly.average_path(at["size"]))
                expected += float(anomaly.average_path(tree.loc[0]["size"]))
            assert made[row["k"]][f"raw_{f}"] == (pytest.approx(2 ** (-path / expected), rel=1e-12) if member else None)
    plan = forests.score(df, F.lit(1), ("k",))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan


def test_out_of_fold_scores_use_the_past_only(spark):
    df = forest_table(spark, 200)
    train, later = df.where("t < 150"), df.where("t >= 150")
    settings = anomaly.ForestSettings(trees=10, sample=32)
    made = anomaly.out_of_fold_scores(train, later, "k", "t", ["f1", "f2"], 3, settings).collect()
    assert len(made) == 201
    assert all((r["anomaly_score"] is None) == (r["fold"] == 0) for r in made)
    changed = train.withColumn("f1", F.when(F.col("t") >= 100, F.lit(9.0)).otherwise(F.col("f1")))
    again = anomaly.out_of_fold_scores(changed, later, "k", "t", ["f1", "f2"], 3, settings).collect()
    first = {r["k"]: r["anomaly_score"] for r in made if r["fold"] == 1}
    assert {r["k"]: r["anomaly_score"] for r in again if r["fold"] == 1} == pytest.approx(first)


def test_stream_equals_batch_and_sets_late_rows_aside(spark):
    rng = random.Random(11)
    rows = [(i, rng.randint(0, 60), rng.choice([1, 2, 3, None]), round(rng.uniform(1, 9), 2)) for i in range(150)]
    df = spark.createDataFrame(rows, "txn_id long, t long, card long, amount double")
    spec = EntityFeatures("card", ("card",), {"w": 20}, {"w": 20}, recency=True, history=True)
    kept = LiveFeatures(spec, shared_path(spark, "live-test"))
    streamed = {r["txn_id"]: r for r in replay(df, kept, 3).collect()}
    batch = {r["txn_id"]: r for r in pit.behavioural_features(df, [spec]).collect()}
    assert streamed.keys() == batch.keys()
    for key, row in batch.items():
        for name in spec.outputs():
            assert streamed[key][name] == (pytest.approx(row[name]) if row[name] is not None else None), (key, name)
    late = spark.createDataFrame([(900, 5, 1, 1.0), (901, 99, 1, 1.0)], df.schema)
    late.write.mode("append").parquet(f"{kept.folder}/source")
    kept.start(spark.readStream.schema(df.schema).parquet(f"{kept.folder}/source")).awaitTermination()
    assert [r["txn_id"] for r in kept.late_rows(spark).collect()] == [900]
    done = {r["txn_id"]: r for r in kept.features(spark).collect()}
    assert 900 not in done and done[901]["history_card_count"] == sum(r[2] == 1 for r in rows)


def test_many_periods_cost_what_they_change(spark, monkeypatch):
    """Twelve periods with a merge every third: equal to the batch, and no period rewrites older state."""
    monkeypatch.setattr(live, "COMPACT_EVERY", 3)
    rng = random.Random(12)
    rows = [(i, i // 10, rng.choice([1, 2, i // 20 + 10]), 1.0) for i in range(240)]
    df = spark.createDataFrame(rows, "txn_id long, t long, card long, amount double")
    spec = EntityFeatures("card", ("card",), {"w": 4}, recency=True, history=True)
    kept = LiveFeatures(spec, shared_path(spark, "live-many"))
    for low in range(0, 24, 2):
        df.where(f"t >= {low} and t < {low + 2}").write.mode("append").parquet(f"{kept.folder}/source")
        kept.start(spark.readStream.schema(df.schema).parquet(f"{kept.folder}/source")).awaitTermination()
    streamed = {r["txn_id"]: r.asDict() for r in kept.features(spark).collect()}
    assert streamed == {r["txn_id"]: r.asDict() for r in pit.behavioural_features(df, [spec]).collect()}
    last = spark.read.parquet(f"{kept.folder}/state/batch=11").count()
    assert last == len({r[2] for r in rows if r[1] >= 22}) < spark.read.parquet(f"{kept.folder}/merged/batch=11").count()


def test_fitting_passes_over_parsed_events(spark):
    """Fitting passes over the training rows many times; none of them parses the events again, and margins have no lambdas."""
    folder = "/root/testdata/sf0.001"
    train, later = model_queries._splits(spark, folder)
    for part in (train, later):
        assert "get_json_object" not in part._jdf.queryExecution().optimizedPlan().toString()
    draw = random.Random(3)
    rows = [(i, draw.random(), i % 5 == 0) for i in range(400)]
    rows = spark.createDataFrame([(i, int(x + draw.random() > 1), [x, draw.random()], s) for i, x, s in rows], "txn_id long, label int, x array<double>, stops boolean")
    prepared = rows.select("txn_id", "label", array_to_vector("x").alias("features"), "stops")
    made = modelling.fit_boosted(prepared, "label", "stops", rounds=3, depth=2)
    margins = made.margins(prepared)
    assert "lambda" not in margins._jdf.queryExecution().optimizedPlan().toString()
    found = margins.join(made.model.transform(prepared).select("txn_id", vector_to_array("leaf").alias("leaf")), "txn_id")
    for row in found.collect():
        assert row["margins"] == list(accumulate(made.leaves[r][int(leaf)] for r, leaf in enumerate(row["leaf"])))
    assert margins.where("false").count() == 0


def test_a_replay_computes_its_rows_once(spark, monkeypatch):
    """The edges and all periods read written rows: nothing of what made them is left in their plans."""
    seen, edges = [], live.order_edges
    monkeypatch.setattr(live, "order_edges", lambda rows, *rest: seen.append(rows._jdf.queryExecution().optimizedPlan().toString()) or edges(rows, *rest))
    made = F.get_json_object(F.concat(F.lit('{"k": '), F.col("id"), F.lit("}")), "$.k").cast("long")
    rows = spark.range(40).select(F.col("id").alias("txn_id"), made.alias("t"), (F.col("id") % 3).alias("card"), F.lit(1.0).alias("amount"))
    spec = EntityFeatures("card", ("card",), recency=True, history=True)
    got = {r["txn_id"]: (r["recency_card"], r["history_card_count"]) for r in replay(rows, LiveFeatures(spec, shared_path(spark, "live-once")), 2).collect()}
    assert got == {i: (3 if i >= 3 else None, i // 3) for i in range(40)}
    assert len(seen) == 1 and "get_json_object" not in seen[0]


def test_boosted_scores_are_fitted_with_all_rounds(spark, monkeypatch, tmp_path):
    """The query asks for 500 rounds of depth 6 with 50 rounds of patience; fewer are fitted here, only for the time."""
    kinds = ("error", "signup", "view", "click", "buy")
    rows = [(i, 1_700_000_000 + 60 * i, i % 7, kinds[i * 3 % 5], float(i * 37 % 101), f'{{"k": {i * 13 % 50}}}') for i in range(400)]
    rows = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    rows.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s").write.parquet(f"{tmp_path}/events.parquet")
    seen, whole = [], modelling.fit_boosted

    def recorded(*args, **more):
        asked = signature(whole).bind(*args, **more)
        asked.apply_defaults()
        seen.append({k: asked.arguments[k] for k in ("rounds", "depth", "patience")})
        return whole(*args, **more | {"rounds": 2, "depth": 2})

    monkeypatch.setattr(modelling, "fit_boosted", recorded)
    assert catalog.QUERIES["m6_boosted_scores"](spark, str(tmp_path)).count() == 60
    assert seen == [{"rounds": 500, "depth": 6, "patience": 50}]


def test_boosted_trees_are_fitted_until_patience_ends(spark, monkeypatch):
    """What is kept follows from the curve over all rounds, whichever number of them was fitted first or is ranked at a time."""
    monkeypatch.setattr(modelling, "RANKED_ROUNDS", 4)
    monkeypatch.setattr(modelling, "TASK_ROWS", 100)
    asked, trained, weights = [], [], modelling.GBTClassificationModel.treeWeights
    monkeypatch.setattr(modelling.GBTClassificationModel, "treeWeights", property(lambda m: asked.append(1) or weights.fget(m)))
    fit = modelling.GBTClassifier.fit
    monkeypatch.setattr(modelling.GBTClassifier, "fit", lambda learner, rows: trained.append((learner.getMaxIter(), rows.rdd.getNumPartitions())) or fit(learner, rows))
    df = learning_table(spark)
    prepared = modelling.Preprocessor(["a", "b"], []).fit(df).transform(df, ("txn_id", "label"))
    prepared = prepared.withColumn("stops", F.col("txn_id") % 5 == 0).coalesce(1).cache()
    stopping = prepared.where("stops").select("txn_id", "label", "features", "stops")
    for rounds, patience in ((11, 1), (11, 2), (6, 100)):
        asked.clear(), trained.clear()
        made = modelling.fit_boosted(prepared, "label", "stops", rounds=rounds, depth=2, patience=patience)
        rows = made.margins(stopping).select("label", "margins").collect()
        curve = [average_precision([(r["margins"][i], r["label"]) for r in rows]) for i in range(len(made.leaves))]
        best = 0
        for r, value in enumerate(curve):
            if r - best > patience:
                break
            best = r if value > curve[best] else best
        looked_at = min(best + patience + 1, rounds)
        assert made.kept == best + 1 and made.curve == pytest.approx(curve[:looked_at], rel=1e-12)
        # The last fit is the first that is long enough, and the weights of the trees are asked for once a fit.
        lengths = [min((patience + 1) * 4**i, rounds) for i in range(len(trained))]
        assert [n for n, _ in trained] == lengths and lengths[-1] >= looked_at and len(asked) == len(trained)
        assert {tasks for _, tasks in trained} == {480 // 100 + 1}
    # A first round that nothing exceeds ends the search at once; one class among the stopping rows keeps all rounds.
    even = prepared.withColumn("features", array_to_vector(F.array(F.col("label").cast("double"))))
    trained.clear()
    made = modelling.fit_boosted(even, "label", "stops", rounds=40, depth=2, patience=2)
    assert (made.kept, made.curve, len(made.leaves), [n for n, _ in trained]) == (1, [1.0] * 3, 3, [3])
    trained.clear()
    alone = modelling.fit_boosted(prepared.where("not stops or label = 0"), "label", "stops", rounds=9, depth=2, patience=1)
    assert (alone.kept, alone.curve, [n for n, _ in trained]) == (9, [], [2, 9])
