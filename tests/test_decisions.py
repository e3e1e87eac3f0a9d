"""Ranking, calibration, policy, outcome and attribution cases with known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.operators import attribution, calibration, isotonic, joins, outcomes, policy, ranking, records, splits

COSTS = policy.CostMatrix(500.0, 5.0, 10.0, 500.0)


def scored(spark, pairs):
    rows = [(i, i, float(s), int(y), 10.0 * i) for i, (s, y) in enumerate(pairs)]
    return spark.createDataFrame(rows, "txn_id long, t long, score double, label int, amount double")


def random_scores(seed, n=400):
    rng = random.Random(seed)
    return [(round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(n)]


def best_first(pairs):
    return sorted(range(len(pairs)), key=lambda i: (-pairs[i][0], i))


@pytest.mark.parametrize("k", [1, 17, 90])
def test_evaluation_equals_its_definition(spark, k):
    pairs = random_scores(21, 90)
    df = scored(spark, pairs)
    record = ranking.evaluate(df, k).first()
    captured = sum(pairs[i][1] for i in best_first(pairs)[:k])
    positives = sum(y for _, y in pairs)
    assert record["precision_at_k"] == pytest.approx(captured / k) and record["recall_at_k"] == pytest.approx(captured / positives)
    with pytest.raises(ValueError, match="capacity"):
        ranking.evaluate(df, 91)
    with pytest.raises(ValueError, match="labels"):
        ranking.evaluate(df.withColumn("label", F.lit(1)), k)


def test_separated_classes_rank_perfectly(spark):
    rng = random.Random(4)
    pairs = [(round(y * 0.5 + rng.random() * 0.4, 3), y) for y in (rng.randint(0, 1) for _ in range(40))]
    record = ranking.evaluate(scored(spark, pairs), sum(y for _, y in pairs)).first()
    assert record["pr_auc"] == record["roc_auc"] == record["precision_at_k"] == record["recall_at_k"] == 1.0


def test_areas_equal_their_definitions(spark):
    pairs = random_scores(3)
    got = ranking.ranking_areas(scored(spark, pairs)).first()
    positives = [s for s, y in pairs if y]
    negatives = [s for s, y in pairs if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in positives for n in negatives)
    assert got["roc_auc"] == pytest.approx(wins / len(positives) / len(negatives))
    area, hits = 0.0, 0
    for s in sorted({s for s, _ in pairs}, reverse=True):
        new = sum(y for v, y in pairs if v == s)
        hits += new
        area += new / len(positives) * hits / sum(v >= s for v, _ in pairs)
    assert got["pr_auc"] == pytest.approx(area)


@pytest.mark.parametrize("bins", [2, 7])
def test_calibration_error_equals_its_definition(spark, bins):
    rng = random.Random(bins)
    pairs = [(s, int(rng.random() < s * 0.8)) for s in rng.sample([i / 1000 for i in range(1, 1000)], 140)]
    df = scored(spark, pairs)
    values = sorted(s for s, _ in pairs)
    edges = []
    for i in range(1, bins):
        place = (len(values) - 1) * i / bins
        low = math.floor(place)
        edges.append(values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (place - low))
    groups = {}
    for s, y in pairs:  # bins are closed on the right
        groups.setdefault(sum(e < s for e in edges), []).append((s, y))
    wanted = sum(abs(sum(s for s, _ in g) - sum(y for _, y in g)) for g in groups.values()) / len(pairs)
    assert calibration.calibration_error(df, bins).first()[0] == pytest.approx(wanted)
    assert calibration.calibration_metrics(df, "x", bins).first()["expected_calibration_error"] == pytest.approx(wanted)
    curve = calibration.reliability_curve(df, 4, "uniform").collect()
    assert sum(r["bin_count"] for r in curve) == 140
    with pytest.raises(ValueError):
        calibration.calibration_error(df, 1)


def test_sigmoid_solves_its_equations(spark):
    df = scored(spark, [(min(max(s, 0.01), 0.99), int(random.Random(i).random() < s * 0.6)) for i, (s, _) in enumerate(random_scores(8))])
    fitted = calibration.Calibrator("sigmoid").fit(df)
    rows = fitted.predict(df).collect()
    assert sum(r["calibrated"] - r["label"] for r in rows) == pytest.approx(0, abs=1e-2)
    x = [math.log(r["score"] / (1 - r["score"])) for r in rows]
    assert sum((r["calibrated"] - r["label"]) * v for r, v in zip(rows, x)) == pytest.approx(0, abs=2e-2)


@pytest.mark.parametrize("method", calibration.METHODS)
def test_calibrators_stay_in_range_and_keep_order(spark, method):
    rng = random.Random(5)
    df = scored(spark, [(s, int(rng.random() < s)) for s, _ in random_scores(5)])
    with pytest.raises(RuntimeError, match="fitted"):
        calibration.Calibrator(method).predict(df)
    with pytest.raises(ValueError, match="both classes"):
        calibration.Calibrator(method).fit(df.where("label = 0"))
    rows = sorted(calibration.Calibrator(method).fit(df).predict(df).collect(), key=lambda r: r["score"])
    values = [r["calibrated"] for r in rows]
    assert all(0.0 <= v <= 1.0 for v in values) and values == sorted(values)
    if method == "uncalibrated":
        assert values == [r["score"] for r in rows]


@pytest.mark.parametrize("shape", ["rising", "falling", "noisy", "one"])
def test_isotonic_over_many_ranges(spark, shape):
    rng = random.Random(11)
    n = 1 if shape == "one" else 600
    rate = {"rising": lambda x: x, "falling": lambda x: 1 - x, "noisy": lambda x: x * x * rng.random(), "one": lambda x: 0.5}[shape]
    points = [(i / n, float(sum(rng.random() < rate(i / n) for _ in range(8))), 8.0) for i in range(n)]
    pools = []
    for x, total, weight in points:
        pools.append([[x], total, weight])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] > pools[-1][1] / pools[-1][2]:
            xs, total, weight = pools.pop()
            pools[-1] = [pools[-1][0] + xs, pools[-1][1] + total, pools[-1][2] + weight]
    at = [x for xs, _, _ in pools for x in xs]
    fit = [total / weight for xs, total, weight in pools for _ in xs]
    model = isotonic.fit_isotonic(spark.createDataFrame(points, "p double, total double, weight double"), 100)
    asked = [-0.5, 1.5, None, 0.25, 0.25, *(rng.random() for _ in range(300)), *at]
    rows = spark.createDataFrame([(x,) for x in asked], "x double")
    got = isotonic.predict_isotonic(rows, F.col("x"), model, "fit", 100).collect()
    assert sorted(map(str, (r["x"] for r in got))) == sorted(map(str, asked))
    for row in got:
        assert (row["fit"] is None) if row["x"] is None else row["fit"] == pytest.approx(np.interp(row["x"], at, fit), abs=1e-9)


def test_costs_and_their_guards(spark):
    row = policy.action_costs(scored(spark, [(0.25, 0)]), COSTS).first()
    assert (row["approve_cost"], row["review_cost"], row["block_cost"], row["prevention_value"]) == (125.0, 5.0, 7.5, 125.0)
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="finite"):
            policy.CostMatrix(bad, 1.0, 1.0, 1.0)
    for bad in ({"capacity": 0}, {"capacity": 1, "min_probability": 0.5, "max_probability": 0.5}, {"capacity": 1, "actions": ("a",)}):
        with pytest.raises(ValueError):
            policy.ReviewPolicy(**bad)
    with pytest.raises(ValueError, match="not probabilities"):
        policy.require_probabilities(scored(spark, [(1.5, 0)]), "score")


def reviewed_by(pairs, capacity, low, high):
    return [i for i in best_first(pairs) if low <= pairs[i][0] <= high][:capacity]


@pytest.mark.parametrize("low,high", [(0.0, 1.0), (0.15, 0.85), (0.999, 1.0)])
def test_policy_equals_its_definition(spark, low, high):
    pairs = random_scores(31, 130)
    df = scored(spark, pairs)
    capacities = [1, 10, 40, 500]
    rows = policy.capacity_results(df, capacities, COSTS, min_probability=low, max_probability=high).collect()
    for row in rows:
        chosen = reviewed_by(pairs, row["review_capacity"], low, high)
        captured, positives = sum(pairs[i][1] for i in chosen), sum(y for _, y in pairs)
        assert (row["selected_review_count"], row["captured_count"], row["total_positives"]) == (len(chosen), captured, positives)
        assert row["capture_rate"] == pytest.approx(captured / positives)
        assert row["net_value"] == pytest.approx(captured * 500.0 - len(chosen) * 5.0)
    one = policy.evaluate_policy(df, policy.ReviewPolicy(10, low, high), COSTS).first()
    assert one == next(r for r in rows if r["review_capacity"] == 10)


@pytest.mark.parametrize("capacity", [1, 25, 400])
def test_actions_and_outcomes_equal_their_definition(spark, capacity):
    pairs = random_scores(32, 120)
    df = scored(spark, pairs)
    chosen = policy.ReviewPolicy(capacity, 0.2, 0.9)
    reviewed = set(reviewed_by(pairs, capacity, 0.2, 0.9))
    actions = {i: "review" if i in reviewed else "block" if s > 0.95 else "approve" for i, (s, _) in enumerate(pairs)}
    decided = policy.apply_policy(df, chosen)
    assert {r["txn_id"]: r["action"] for r in decided.collect()} == actions
    assert {r["txn_id"] for r in policy.select_for_review(df, chosen).collect()} == reviewed
    queue = records.investigation_queue(df, chosen).orderBy("priority").collect()
    assert [r["txn_id"] for r in queue] == reviewed_by(pairs, capacity, 0.2, 0.9)
    assert [r["priority"] for r in queue] == list(range(1, len(queue) + 1))
    count = lambda action, y: sum(actions[i] == action and pairs[i][1] == y for i in actions)
    assert policy.outcome_counts(decided, chosen).first().asDict() == {
        "true_positives": count("review", 1), "false_positives": count("review", 0),
        "false_negatives": count("approve", 1), "true_negatives": count("approve", 0),
    }
    none = policy.apply_policy(df, policy.ReviewPolicy(2, 0.991, 0.9999))
    assert none.where("reviewed").count() == 0


@pytest.mark.parametrize("slice_rows,fan_in", [(1_000_000, 64), (20, 2)])
def test_period_selection_equals_its_definition(spark, monkeypatch, slice_rows, fan_in):
    monkeypatch.setattr(policy, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(policy, "FAN_IN", fan_in)
    pairs = random_scores(33, 300)
    df = scored(spark, pairs).withColumn("period", F.when(F.col("txn_id") % 5 == 0, F.col("txn_id") % 3).otherwise(7))
    got = policy.select_per_period(df, policy.ReviewPolicy(6, 0.1, 0.9), "period").collect()
    wanted = {}
    for i in best_first(pairs):
        period = i % 3 if i % 5 == 0 else 7
        if 0.1 <= pairs[i][0] <= 0.9 and len(wanted.setdefault(period, [])) < 6:
            wanted[period].append(i)
    assert {(r["period"], r["review_rank"], r["txn_id"]) for r in got} == {(p, k, i) for p, ids in wanted.items() for k, i in enumerate(ids, 1)}


def test_period_selection_breaks_ties_by_key(spark):
    df = scored(spark, [(0.5, 0)] * 9 + [(0.9, 1)]).withColumn("period", F.lit(1))
    got = policy.select_per_period(df, policy.ReviewPolicy(4), "period").orderBy("review_rank").collect()
    assert [r["txn_id"] for r in got] == [9, 0, 1, 2]


def test_keep_reject_and_missing_capacity(spark):
    schema = "review_capacity int, captured_count long, net_value double"
    base = spark.createDataFrame([(1, 10, 100.0), (2, 10, 100.0), (3, 10, 100.0)], schema)
    other = spark.createDataFrame([(1, 11, 100.0), (2, 10, 100.0), (3, 11, 90.0)], schema)
    compared = joins.compare_by_key(base, other, "review_capacity", ["captured_count", "net_value"])
    verdicts = {r["review_capacity"]: r["decision"] for r in policy.keep_or_reject(compared).collect()}
    assert verdicts == {1: "keep", 2: "reject", 3: "reject"}
    with pytest.raises(ValueError, match="no result"):
        joins.compare_by_key(base, other.where("review_capacity < 3"), "review_capacity", ["net_value"])
    with pytest.raises(ValueError, match="exactly one"):
        joins.exactly_one(base, "review_capacity", 9)


def test_outcome_tables_keep_empty_categories(spark):
    df = scored(spark, [(0.9, 1), (0.8, 1), (0.1, 0), (0.2, 0)])
    cases = outcomes.classify(df, policy.ReviewPolicy(2))
    got = {r["category"]: r for r in outcomes.category_summary(cases).collect()}
    assert got["captured"]["row_count"] == 2 and got["missed"]["row_count"] == 0
    assert got["missed"]["median_score"] is None and got["low_risk"]["median_amount"] == 25.0
    summary = outcomes.policy_error_summary(cases, 2).first()
    assert (summary["capture_rate"], summary["review_precision"]) == (1.0, 1.0)


def test_deciles_cover_all_rows_evenly(spark):
    df = scored(spark, random_scores(1, 103))
    sizes = [r["n"] for r in splits.rank_deciles(df, F.col("score"), "txn_id").groupBy("decile").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 10 and sum(sizes) == 103 and max(sizes) - min(sizes) <= 1


def test_stability(spark):
    values = {"same": {"a": 4.0, "b": 3.0, "c": 0.2, "d": 0.1}, "swapped": {"a": 0.1, "b": 0.2, "c": 3.0, "d": 4.0}}
    rows = [(case, seed, f, v) for case in ("x", "y") for seed in (1, 2, 3) for f, v in values["same"].items()]
    df = spark.createDataFrame(rows, "case string, seed int, feature string, value double")
    pairs = attribution.pairwise_stability(df, [1, 2, 3], 2).collect()
    assert len(pairs) == 6 and {r["jaccard_similarity"] for r in pairs} == {1.0}
    assert pairs[0]["shared_features"] == "a | b"
    mixed = [("x", s, f, v) for s, kind in ((1, "same"), (2, "swapped")) for f, v in values[kind].items()]
    other = attribution.pairwise_stability(spark.createDataFrame(mixed, df.schema), [1, 2], 2)
    assert other.first()["jaccard_similarity"] == 0.0
    assert attribution.stability_summary(other).first()["seed_pairs"] == 1
    with pytest.raises(ValueError, match="two seeds"):
        attribution.pairwise_stability(df, [1], 2)


def test_hash_sample_ignores_partitioning(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    samples = [{r["k"] for r in attribution.hash_sample(df.repartition(p), 50, "k", 7).collect()} for p in (1, 9)]
    assert samples[0] == samples[1] and len(samples[0]) == 50
