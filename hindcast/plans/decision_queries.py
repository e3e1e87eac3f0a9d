"""Ranking, calibration, policy, outcome and attribution tables over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.operators import attribution, calibration, joins, outcomes, policy, ranking, splits
from hindcast.plans.bindings import EVENTS, ORDERS, events, orders, rounded, table
from hindcast.plans.feature_queries import SPLIT_SQL
from hindcast.plans.registry import query
from hindcast.roles import Roles
from hindcast.session import shared_path
from hindcast.sources import state

TOP = "row_number() OVER (ORDER BY score DESC, txn_id)"
COSTS = policy.CostMatrix(500.0, 5.0, 10.0, 500.0)
POLICY = policy.ReviewPolicy(1000, 0.10, 0.99)


@query(
    "e1_metrics_at_k",
    f"""WITH {EVENTS}, r AS (SELECT *, {TOP} AS r FROM txn)
        SELECT 500 AS review_capacity, CAST(sum(label) FILTER (WHERE r <= 500) AS BIGINT) AS captured_at_k,
          CAST(sum(label) AS BIGINT) AS total_positives, round(sum(label) FILTER (WHERE r <= 500) / 500.0::DOUBLE, 6) AS precision_at_k,
          round(sum(label) FILTER (WHERE r <= 500) / CAST(sum(label) AS DOUBLE), 6) AS recall_at_k FROM r""",
)
def _(spark, folder):
    return rounded(ranking.metrics_at_k(events(spark, folder), 500))


AREAS_SQL = """per AS (SELECT score, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos FROM txn GROUP BY score),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM per WINDOW w AS (ORDER BY score DESC)),
areas AS (SELECT sum(pos * (tp / CAST(seen AS DOUBLE))) / sum(pos) AS pr_auc,
  sum((n - pos) * (tp - pos + pos / 2.0::DOUBLE)) / (CAST(sum(pos) AS DOUBLE) * sum(n - pos)) AS roc_auc FROM cum)"""


@query("e2_average_precision", f"WITH {EVENTS}, {AREAS_SQL} SELECT round(pr_auc, 6) AS pr_auc FROM areas")
def _(spark, folder):
    return rounded(ranking.ranking_areas(events(spark, folder)).select("pr_auc"))


@query("e3_roc_auc", f"WITH {ORDERS}, {AREAS_SQL} SELECT round(roc_auc, 6) AS roc_auc FROM areas")
def _(spark, folder):
    return rounded(ranking.ranking_areas(orders(spark, folder)).select("roc_auc"))


CONFUSION_SQL = """c AS (SELECT count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp,
  count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn FROM txn)"""
CONFUSION_COLUMNS = """0.5::DOUBLE AS reference_threshold, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives,
  round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1"""


@query("e4_confusion", f"WITH {EVENTS}, {CONFUSION_SQL} SELECT {CONFUSION_COLUMNS} FROM c")
def _(spark, folder):
    return rounded(ranking.confusion(events(spark, folder), 0.5))


@query(
    "e5_evaluation_record",
    f"""WITH {ORDERS}, {AREAS_SQL}, {CONFUSION_SQL}, r AS (SELECT *, {TOP} AS r FROM txn),
        k AS (SELECT sum(label) FILTER (WHERE r <= 1000) AS hit, sum(label) AS total FROM r)
        SELECT {CONFUSION_COLUMNS}, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, 1000 AS review_capacity,
          CAST(hit AS BIGINT) AS captured_at_k, CAST(total AS BIGINT) AS total_positives,
          round(hit / 1000.0::DOUBLE, 6) AS precision_at_k, round(hit / total::DOUBLE, 6) AS recall_at_k FROM c, areas, k""",
)
def _(spark, folder):
    return rounded(ranking.evaluate(orders(spark, folder), 1000))


@query(
    "c1_log_odds",
    f"""WITH {EVENTS}, b AS (SELECT txn_id, least(greatest(score, 1e-6::DOUBLE), 1.0::DOUBLE - 1e-6::DOUBLE) AS p FROM txn)
        SELECT txn_id, round(ln(p / (1.0::DOUBLE - p)), 6) AS log_odds FROM b""",
)
def _(spark, folder):
    from hindcast.functions.scalars import log_odds

    return rounded(events(spark, folder).select("txn_id", log_odds(F.col("score")).alias("log_odds")))


def _halves(spark, folder):
    tagged = splits.fraction_split(events(spark, folder), "t", 0.5)
    return tagged.where("period = 'fit'"), tagged.where("period = 'select'")


HALVES_SQL = """ranked AS (SELECT *, row_number() OVER (ORDER BY t, txn_id) - 1 AS pos, count(*) OVER () AS n FROM txn),
cut AS (SELECT t AS boundary FROM ranked WHERE pos = CAST(floor(n * 0.5) AS BIGINT)),
late AS (SELECT txn.* FROM txn, cut WHERE t >= boundary)"""


def _newton_sql(name: str, source: str) -> str:
    """Slope and intercept by thirty Newton steps from zero, as a recursive query."""
    return f"""{name}_points AS (SELECT ln(p / (1.0::DOUBLE - p)) AS x, CAST(label AS DOUBLE) AS y FROM (
    SELECT least(greatest(score, 1e-6::DOUBLE), 1.0::DOUBLE - 1e-6::DOUBLE) AS p, label FROM {source})),
  {name}_steps AS (SELECT 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL
    SELECT step + 1, a + (hab * gb - hbb * ga) / (haa * hbb - hab * hab), b + (hab * ga - haa * gb) / (haa * hbb - hab * hab) FROM (
      SELECT step, a, b, avg((p - y) * x) + a / (1e6::DOUBLE * count(*)) AS ga, avg(p - y) AS gb,
        avg(p * (1 - p) * x * x) + 1 / (1e6::DOUBLE * count(*)) AS haa, avg(p * (1 - p) * x) AS hab, avg(p * (1 - p)) AS hbb FROM (
        SELECT step, a, b, x, y, 1 / (1 + exp(-(a * x + b))) AS p FROM {name}_steps, {name}_points WHERE step < 30) GROUP BY step, a, b)),
  {name} AS (SELECT a, b FROM {name}_steps WHERE step = 30)"""


SIGMOID = "1 / (1 + exp(-(a * ln(least(greatest(score, 1e-6::DOUBLE), 1.0::DOUBLE - 1e-6::DOUBLE) / (1.0::DOUBLE - least(greatest(score, 1e-6::DOUBLE), 1.0::DOUBLE - 1e-6::DOUBLE))) + b)))"


@query(
    "c2_sigmoid",
    f"""WITH RECURSIVE {EVENTS}, {HALVES_SQL}, early AS (SELECT txn.* FROM txn, cut WHERE t < boundary), {_newton_sql('newton', 'early')}
        SELECT txn_id, round({SIGMOID}, 6) AS calibrated FROM late, newton""",
)
def _(spark, folder):
    early, late = _halves(spark, folder)
    return rounded(calibration.Calibrator("sigmoid").fit(early).predict(late).select("txn_id", "calibrated"))


# The isotonic fit at point i is max over a <= i of min over b >= i of the mean of points a to b.
ISOTONIC = """points AS (SELECT score AS x, sum(label) AS s, count(*) AS w, row_number() OVER (ORDER BY score) AS i
  FROM (SELECT txn.* FROM txn, cut WHERE t < boundary) GROUP BY score),
sums AS (SELECT i, x, s, w, sum(s) OVER (ORDER BY i) AS cs, sum(w) OVER (ORDER BY i) AS cw FROM points),
means AS (SELECT a.i AS a, b.i AS b, CAST(b.cs - a.cs + a.s AS DOUBLE) / (b.cw - a.cw + a.w) AS m FROM sums a JOIN sums b ON b.i >= a.i),
least_means AS (SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM means),
fitted AS (SELECT x, f FROM (SELECT i, max(v) AS f FROM least_means GROUP BY i) JOIN sums USING (i)),
around AS (SELECT l.txn_id, l.score, p.x AS x0, p.f AS f0 FROM late l ASOF LEFT JOIN fitted p ON l.score >= p.x),
both_sides AS (SELECT a.*, n.x AS x1, n.f AS f1 FROM around a ASOF LEFT JOIN fitted n ON a.score <= n.x)"""


@query(
    "c3_isotonic",
    f"""WITH {EVENTS}, {HALVES_SQL}, {ISOTONIC} SELECT txn_id, round(CASE WHEN x0 IS NULL THEN f1 WHEN x1 IS NULL OR x1 = x0 THEN f0
          ELSE f0 + (f1 - f0) * (score - x0) / (x1 - x0) END, 6) AS calibrated FROM both_sides""",
)
def _(spark, folder):
    early, late = _halves(spark, folder)
    return rounded(calibration.Calibrator("isotonic").fit(early).predict(late).select("txn_id", "calibrated"))


@query("c4_uncalibrated", f"WITH {EVENTS}, {HALVES_SQL} SELECT txn_id, score AS calibrated FROM late")
def _(spark, folder):
    early, late = _halves(spark, folder)
    return calibration.Calibrator("uncalibrated").fit(early).predict(late).select("txn_id", "calibrated")


def _bins_sql(source: str, score: str, forced: bool) -> str:
    probs = ", ".join(f"{i / 10}" for i in range(11))
    middle = "q[2:10]" if forced else "q[2:10]"
    inner = (
        f"list_filter(list_distinct({middle}), lambda e: e > 0.0 AND e < 1.0)"
        if forced
        else f"list_filter(list_distinct({middle}), lambda e: e > q[1] AND e < q[11])"
    )
    return f"""SELECT x.*, len(list_filter(inner_edges, lambda e: e < {score})) AS bin FROM {source} x,
      (SELECT {inner} AS inner_edges FROM (SELECT quantile_cont({score}, [{probs}]) AS q FROM {source}))"""


def _error_sql(source: str, score: str) -> str:
    return f"""(SELECT sum(c * abs(o - m)) / sum(c) FROM (SELECT count(*) AS c, avg(CAST(label AS DOUBLE)) AS o,
      avg({score}) AS m FROM ({_bins_sql(source, score, True)}) GROUP BY bin))"""


@query("c5_calibration_error", f"WITH {EVENTS} SELECT round({_error_sql('txn', 'score')}, 6) AS expected_calibration_error")
def _(spark, folder):
    return rounded(calibration.calibration_error(events(spark, folder)))


@query(
    "c6_reliability_curve",
    f"""WITH {EVENTS} SELECT CAST(bin AS INTEGER) AS bin, round(avg(score), 6) AS mean_prediction, round(avg(CAST(label AS DOUBLE)), 6) AS observed_rate,
          count(*) AS bin_count, round(abs(avg(score) - avg(CAST(label AS DOUBLE))), 6) AS absolute_gap
        FROM ({_bins_sql('txn', 'score', False)}) GROUP BY bin""",
)
def _(spark, folder):
    return rounded(calibration.reliability_curve(events(spark, folder)))


@query(
    "c6_reliability_curve_uniform",
    f"""WITH {EVENTS}, b AS (SELECT *, len(list_filter([0.1::DOUBLE,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9], lambda e: e < score)) AS bin FROM txn)
        SELECT CAST(bin AS INTEGER) AS bin, round(avg(score), 6) AS mean_prediction, round(avg(CAST(label AS DOUBLE)), 6) AS observed_rate,
          count(*) AS bin_count, round(abs(avg(score) - avg(CAST(label AS DOUBLE))), 6) AS absolute_gap FROM b GROUP BY bin""",
)
def _(spark, folder):
    return rounded(calibration.reliability_curve(events(spark, folder), strategy="uniform"))


@query("c7_brier", f"WITH {EVENTS} SELECT round(avg((score - label) * (score - label)), 6) AS brier_score FROM txn")
def _(spark, folder):
    return rounded(events(spark, folder).agg(calibration.brier("score", "label").alias("brier_score")))


@query(
    "c8_method_choice",
    f"""WITH {EVENTS}, {HALVES_SQL}, s AS (SELECT *, score * score AS squared, 0.2 + 0.1 * score AS shrunk FROM late),
        m AS (SELECT 'plain' AS method, avg((score - label) * (score - label)) AS b, {_error_sql('s', 'score')} AS e FROM s
          UNION ALL SELECT 'squared', avg((squared - label) * (squared - label)), {_error_sql('s', 'squared')} FROM s
          UNION ALL SELECT 'shrunk', avg((shrunk - label) * (shrunk - label)), {_error_sql('s', 'shrunk')} FROM s)
        SELECT method, round(b, 6) AS brier_score, round(e, 6) AS expected_calibration_error FROM m ORDER BY b, e, method LIMIT 1""",
)
def _(spark, folder):
    _, late = _halves(spark, folder)
    score = F.col("score")
    late = late.withColumn("squared", score * score).withColumn("shrunk", 0.2 + 0.1 * score)
    results = calibration.compare_scores(late, {"plain": "score", "squared": "squared", "shrunk": "shrunk"})
    return rounded(calibration.choose_method(results))


@query(
    "c8_fitted_method_comparison",
    f"""WITH RECURSIVE {EVENTS}, {HALVES_SQL}, early AS (SELECT txn.* FROM txn, cut WHERE t < boundary), {_newton_sql('newton', 'early')}, {ISOTONIC},
        iso AS (SELECT txn_id, CASE WHEN x0 IS NULL THEN f1 WHEN x1 IS NULL OR x1 = x0 THEN f0
          ELSE f0 + (f1 - f0) * (score - x0) / (x1 - x0) END AS isotonic FROM both_sides),
        s AS (SELECT late.*, {SIGMOID} AS sigmoid, isotonic FROM late JOIN iso USING (txn_id), newton)
        SELECT 'uncalibrated' AS method, round(avg((score - label) * (score - label)), 6) AS brier_score, round({_error_sql('s', 'score')}, 6) AS expected_calibration_error FROM s
        UNION ALL SELECT 'sigmoid', round(avg((sigmoid - label) * (sigmoid - label)), 6), round({_error_sql('s', 'sigmoid')}, 6) FROM s
        UNION ALL SELECT 'isotonic', round(avg((isotonic - label) * (isotonic - label)), 6), round({_error_sql('s', 'isotonic')}, 6) FROM s""",
)
def _(spark, folder):
    return rounded(calibration.compare_methods(*_halves(spark, folder)))


@query(
    "k1_action_costs",
    f"""WITH {EVENTS} SELECT txn_id, round(score * 500.0, 6) AS approve_cost, 5.0::DOUBLE AS review_cost, round((1.0 - score) * 10.0, 6) AS block_cost,
          round(score * 500.0, 6) AS prevention_value FROM txn""",
)
def _(spark, folder):
    return rounded(policy.action_costs(events(spark, folder).select("txn_id", "score"), COSTS).drop("score"))


@query("k2_review_priority", f"WITH {EVENTS} SELECT txn_id, round(score * 500.0 - 5.0, 6) AS priority FROM txn")
def _(spark, folder):
    return rounded(events(spark, folder).select("txn_id", policy.review_priority("score", COSTS).alias("priority")))


@query(
    "k3_cost_guards",
    """SELECT 'c_acctbal' AS cost, count(*) FILTER (WHERE c_acctbal IS NULL OR c_acctbal < 0) AS violations FROM customer""",
)
def _(spark, folder):
    return policy.cost_violations(table(spark, folder, "customer"), ["c_acctbal"])


PICKED = f"picked AS (SELECT *, {TOP} AS r FROM txn WHERE score BETWEEN 0.10 AND 0.99)"


@query("k4_top_k_selection", f"WITH {ORDERS}, {PICKED} SELECT txn_id, score FROM picked WHERE r <= 1000")
def _(spark, folder):
    return policy.select_for_review(orders(spark, folder), POLICY).select("txn_id", "score")


@query(
    "k4_top_k_per_period",
    f"""WITH {ORDERS} SELECT txn_id, t // 365 AS period, row_number() OVER (PARTITION BY t // 365 ORDER BY score DESC, txn_id) AS review_rank
        FROM txn WHERE score BETWEEN 0.10 AND 0.99 QUALIFY review_rank <= 50""",
)
def _(spark, folder):
    rows = orders(spark, folder).withColumn("period", F.floor(F.col("t") / 365))
    made = policy.select_per_period(rows, policy.ReviewPolicy(50, 0.10, 0.99), "period")
    return made.select("txn_id", "period", F.col("review_rank").cast("long").alias("review_rank"))


DECIDED = f"""{PICKED}, decided AS (SELECT txn.*, coalesce(picked.r <= 1000, false) AS reviewed,
  CASE WHEN picked.r <= 1000 THEN 'review' WHEN txn.score > 0.60 THEN 'block' ELSE 'approve' END AS action
  FROM txn LEFT JOIN picked USING (txn_id))"""
BLOCKING = policy.ReviewPolicy(1000, 0.10, 0.99, 0.60)


@query("k5_actions", f"WITH {ORDERS}, {DECIDED} SELECT txn_id, reviewed, action FROM decided")
def _(spark, folder):
    return policy.apply_policy(orders(spark, folder), BLOCKING).select("txn_id", "reviewed", "action")


@query(
    "k5_outcome_counts",
    f"""WITH {ORDERS}, {DECIDED} SELECT count(*) FILTER (WHERE label = 1 AND reviewed) AS true_positives,
          count(*) FILTER (WHERE label = 0 AND reviewed) AS false_positives,
          count(*) FILTER (WHERE label = 1 AND action = 'approve') AS false_negatives,
          count(*) FILTER (WHERE label = 0 AND action = 'approve') AS true_negatives FROM decided""",
)
def _(spark, folder):
    return policy.outcome_counts(policy.apply_policy(orders(spark, folder), BLOCKING), BLOCKING)


def _capacity_sql(capacities: list[int], source: str = "txn") -> str:
    parts = " UNION ALL ".join(
        f"""SELECT {c} AS review_capacity, count(*) FILTER (WHERE r <= {c}) AS selected_review_count,
        CAST(coalesce(sum(label) FILTER (WHERE r <= {c}), 0) AS BIGINT) AS captured_count FROM picked"""
        for c in capacities
    )
    return f"""{PICKED.replace('FROM txn', 'FROM ' + source)}, counted AS ({parts}),
      results AS (SELECT review_capacity, selected_review_count, selected_review_count / review_capacity::DOUBLE AS capacity_utilisation,
        captured_count, total_positives, captured_count / total_positives::DOUBLE AS capture_rate,
        selected_review_count - captured_count AS false_positive_reviews, selected_review_count * 5.0::DOUBLE AS total_review_cost,
        captured_count * 500.0::DOUBLE AS total_prevention_value,
        captured_count * 500.0::DOUBLE - selected_review_count * 5.0::DOUBLE AS net_value
        FROM counted, (SELECT CAST(sum(label) AS BIGINT) AS total_positives FROM {source}))"""


RESULT_COLUMNS = """review_capacity, selected_review_count, round(capacity_utilisation, 6) AS capacity_utilisation, captured_count,
  total_positives, round(capture_rate, 6) AS capture_rate, false_positive_reviews, total_review_cost, total_prevention_value, net_value"""
CAPACITIES = [500, 1000, 1500, 2000]


@query("k6_policy_evaluation", f"WITH {ORDERS}, {_capacity_sql([1000])} SELECT {RESULT_COLUMNS} FROM results")
def _(spark, folder):
    return rounded(policy.evaluate_policy(orders(spark, folder), POLICY, COSTS))


@query("k7_capacity_sensitivity", f"WITH {ORDERS}, {_capacity_sql(CAPACITIES)} SELECT {RESULT_COLUMNS} FROM results")
def _(spark, folder):
    return rounded(policy.capacity_results(orders(spark, folder), CAPACITIES, COSTS, min_probability=0.10, max_probability=0.99))


def _two_runs(spark, folder):
    """The same rows under two scores: the plain one and one that favours late rows."""
    rows = orders(spark, folder)
    other = rows.withColumn("score", F.round(F.col("score") * (0.5 + F.col("label") * 0.1), 6))
    kept = {"min_probability": 0.10, "max_probability": 0.99}
    return (
        policy.capacity_results(rows, CAPACITIES, COSTS, **kept),
        policy.capacity_results(other, CAPACITIES, COSTS, **kept),
    )


TWO_RUNS = f"""other AS (SELECT * REPLACE (round(score * (0.5 + label * 0.1), 6) AS score) FROM txn),
{_capacity_sql(CAPACITIES)},
{_capacity_sql(CAPACITIES, 'other').replace('picked', 'picked2').replace('counted', 'counted2').replace('results AS', 'results2 AS')},
pair AS (SELECT review_capacity, b.captured_count AS baseline_captured_count, c.captured_count AS candidate_captured_count,
  c.captured_count - b.captured_count AS captured_count_difference, round(b.capture_rate, 6) AS baseline_capture_rate,
  round(c.capture_rate, 6) AS candidate_capture_rate, round(c.capture_rate - b.capture_rate, 6) AS capture_rate_difference,
  b.net_value AS baseline_net_value, c.net_value AS candidate_net_value, c.net_value - b.net_value AS net_value_difference
  FROM results b JOIN results2 c USING (review_capacity))"""
COMPARED = ["captured_count", "capture_rate", "net_value"]


def _comparison(spark, folder):
    return joins.compare_by_key(*_two_runs(spark, folder), "review_capacity", COMPARED)


@query("j4_compare_policies", f"WITH {ORDERS}, {TWO_RUNS} SELECT * FROM pair")
def _(spark, folder):
    return rounded(_comparison(spark, folder))


@query(
    "j5_compare_metrics",
    f"""WITH {ORDERS}, {TWO_RUNS} SELECT unnest(['captured_count', 'net_value']) AS metric,
          unnest([CAST(baseline_captured_count AS DOUBLE), baseline_net_value]) AS baseline,
          unnest([CAST(candidate_captured_count AS DOUBLE), candidate_net_value]) AS candidate,
          unnest([CAST(captured_count_difference AS DOUBLE), net_value_difference]) AS candidate_minus_baseline
        FROM pair WHERE review_capacity = 1000""",
)
def _(spark, folder):
    first, second = (df.where("review_capacity = 1000") for df in _two_runs(spark, folder))
    return rounded(joins.compare_metrics(first, second, ["captured_count", "net_value"]))


@query("j9_capacity_row", f"WITH {ORDERS}, {_capacity_sql(CAPACITIES)} SELECT {RESULT_COLUMNS} FROM results WHERE review_capacity = 1500")
def _(spark, folder):
    return rounded(joins.exactly_one(_two_runs(spark, folder)[0], "review_capacity", 1500))


@query(
    "k8_keep_or_reject",
    f"""WITH {ORDERS}, {TWO_RUNS} SELECT *, CASE WHEN (captured_count_difference > 0 AND net_value_difference >= 0)
          OR (net_value_difference > 0 AND captured_count_difference >= 0) THEN 'keep' ELSE 'reject' END AS decision FROM pair""",
)
def _(spark, folder):
    return rounded(policy.keep_or_reject(_comparison(spark, folder)))


@query(
    "k9_champion",
    f"""WITH {ORDERS}, {AREAS_SQL}, {AREAS_SQL.replace('per AS', 'per2 AS').replace('cum AS', 'cum2 AS').replace('areas AS', 'areas2 AS')
          .replace('FROM per ', 'FROM per2 ').replace('FROM cum)', 'FROM cum2)').replace('SELECT score, count', 'SELECT 1 - score AS score, count').replace('GROUP BY score', 'GROUP BY 1')},
        k AS (SELECT sum(label) FILTER (WHERE r <= 500)::DOUBLE / sum(label) AS a, sum(label) FILTER (WHERE r2 <= 500)::DOUBLE / sum(label) AS b
          FROM (SELECT *, {TOP} AS r, row_number() OVER (ORDER BY score, txn_id) AS r2 FROM txn)),
        m AS (SELECT 'plain' AS model, pr_auc, a AS recall_at_k FROM areas, k UNION ALL SELECT 'reversed', pr_auc, b FROM areas2, k)
        SELECT model, round(pr_auc, 6) AS pr_auc, round(recall_at_k, 6) AS recall_at_k FROM m ORDER BY m.pr_auc DESC, m.recall_at_k DESC, model LIMIT 1""",
)
def _(spark, folder):
    rows = orders(spark, folder)

    def record(df, name):
        return ranking.evaluate(df, 500).select(F.lit(name).alias("model"), "pr_auc", "recall_at_k")

    other = rows.withColumn("score", F.round(1 - F.col("score"), 6))
    return rounded(policy.champion(record(rows, "plain").unionByName(record(other, "reversed"))))


def _run_facts(df, name):
    return df.agg(
        F.lit(name).alias("run"),
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.col("label").cast("long")).alias("positives"),
        F.min("t").alias("first_time"),
    )


@query(
    "k10_comparability",
    f"""WITH {ORDERS}, {SPLIT_SQL}, a AS (SELECT count(*) AS row_count, sum(label) AS positives, min(t) AS first_time FROM split WHERE split = 'validation'),
        b AS (SELECT count(*) AS row_count, sum(label) AS positives, min(t) AS first_time FROM split WHERE split = 'test')
        SELECT unnest(['row_count', 'positives', 'first_time']) AS fact,
          unnest([a.row_count::VARCHAR, a.positives::VARCHAR, a.first_time::VARCHAR]) AS baseline,
          unnest([b.row_count::VARCHAR, b.positives::VARCHAR, b.first_time::VARCHAR]) AS candidate,
          unnest([a.row_count = b.row_count, a.positives = b.positives, a.first_time = b.first_time]) AS equal FROM a, b""",
)
def _(spark, folder):
    tagged = splits.ratio_split(orders(spark, folder))
    runs = _run_facts(tagged.where("split = 'validation'"), "base").unionByName(
        _run_facts(tagged.where("split = 'test'"), "other")
    )
    return joins.comparability(runs, "other", "base", ["row_count", "positives", "first_time"])


@query(
    "k11_ablation_summary",
    f"""WITH {ORDERS}, {TWO_RUNS} SELECT *, 'favoured' AS experiment, CASE WHEN candidate_net_value <= baseline_net_value THEN 'rejected' ELSE 'review' END
          AS selection_decision FROM pair WHERE review_capacity = 1000
        UNION ALL SELECT review_capacity, baseline_captured_count, baseline_captured_count, 0, baseline_capture_rate, baseline_capture_rate, 0.0,
          baseline_net_value, baseline_net_value, 0.0, 'unchanged', 'rejected' FROM pair WHERE review_capacity = 1000""",
)
def _(spark, folder):
    first, second = _two_runs(spark, folder)
    compared = {
        "favoured": joins.compare_by_key(first, second, "review_capacity", COMPARED),
        "unchanged": joins.compare_by_key(first, first, "review_capacity", COMPARED),
    }
    return rounded(policy.ablation_summary(compared, 1000))


ALL_SCORES = policy.ReviewPolicy(1000)
CASES = f"""ranked0 AS (SELECT *, {TOP} AS r FROM txn), cases AS (SELECT *, r <= 1000 AS reviewed,
  CASE WHEN label = 1 AND r <= 1000 THEN 'captured' WHEN label = 1 THEN 'missed' WHEN r <= 1000 THEN 'unnecessary' ELSE 'low_risk' END AS category FROM ranked0)"""


def _cases(spark, folder):
    return outcomes.classify(orders(spark, folder), ALL_SCORES)


@query("p9_case_categories", f"WITH {ORDERS}, {CASES} SELECT txn_id, category FROM cases")
def _(spark, folder):
    return _cases(spark, folder).select("txn_id", "category")


@query(
    "k12_category_summary",
    f"""WITH {ORDERS}, {CASES} SELECT category, count(*) AS row_count, CAST(sum(label) AS BIGINT) AS positives, round(avg(score), 6) AS mean_score,
          min(score) AS min_score, max(score) AS max_score, round(avg(amount), 6) AS mean_amount, round(quantile_cont(score, 0.5), 6) AS median_score,
          round(quantile_cont(amount, 0.5), 6) AS median_amount, round(count(*) / (SELECT count(*)::DOUBLE FROM txn), 6) AS share FROM cases GROUP BY category""",
)
def _(spark, folder):
    return rounded(outcomes.category_summary(_cases(spark, folder)))


SUMMARY = """summary AS (SELECT 1000 AS review_capacity, count(*) AS row_count, count(*) FILTER (WHERE reviewed) AS reviewed_count,
  CAST(sum(label) AS BIGINT) AS total_positives, count(*) FILTER (WHERE category = 'captured') AS captured_count,
  count(*) FILTER (WHERE category = 'missed') AS missed_count, count(*) FILTER (WHERE category = 'unnecessary') AS unnecessary_count FROM cases)"""
SUMMARY_RATES = "round(captured_count / total_positives::DOUBLE, 6) AS capture_rate, round(captured_count / reviewed_count::DOUBLE, 6) AS review_precision"


@query("k13_policy_errors", f"WITH {ORDERS}, {CASES}, {SUMMARY} SELECT *, {SUMMARY_RATES} FROM summary")
def _(spark, folder):
    return rounded(outcomes.policy_error_summary(_cases(spark, folder), 1000))


@query(
    "k14_score_distribution",
    f"""WITH {ORDERS} SELECT label, count(*) AS row_count, round(avg(score), 6) AS mean_score, round(quantile_cont(score, 0.05), 6) AS p05_score,
          round(quantile_cont(score, 0.25), 6) AS p25_score, round(quantile_cont(score, 0.5), 6) AS median_score,
          round(quantile_cont(score, 0.75), 6) AS p75_score, round(quantile_cont(score, 0.95), 6) AS p95_score FROM txn GROUP BY label""",
)
def _(spark, folder):
    return rounded(outcomes.score_distribution(orders(spark, folder)))


def _decile_sql(order: str) -> str:
    return f"""ranked1 AS (SELECT *, row_number() OVER (ORDER BY {order}, txn_id) - 1 AS pos1, count(*) OVER () AS n1 FROM cases),
      deciles AS (SELECT *, 1 + CAST(len(list_filter([1,2,3,4,5,6,7,8,9], lambda k: 10 * pos1 > (n1 - 1) * k)) AS INTEGER) AS decile FROM ranked1)"""


DECILE_COLUMNS = """count(*) AS row_count, CAST(sum(label) AS BIGINT) AS positives, round(avg(label::DOUBLE), 6) AS positive_rate,
  count(*) FILTER (WHERE reviewed) AS reviewed_count, count(*) FILTER (WHERE category = 'captured') AS captured_count, round(avg(score), 6) AS mean_score"""


@query(
    "k15_score_deciles",
    f"""WITH {ORDERS}, {CASES}, {_decile_sql('score')} SELECT decile AS score_decile, {DECILE_COLUMNS}, min(score) AS min_score, max(score) AS max_score
        FROM deciles GROUP BY decile""",
)
def _(spark, folder):
    return rounded(outcomes.score_deciles(_cases(spark, folder)))


@query(
    "k16_time_deciles",
    f"""WITH {ORDERS}, {CASES}, {_decile_sql('t')} SELECT decile AS time_decile, {DECILE_COLUMNS},
          count(*) FILTER (WHERE category = 'missed') AS missed_count, count(*) FILTER (WHERE category = 'unnecessary') AS unnecessary_count,
          min(t) AS first_time, max(t) AS last_time,
          round(count(*) FILTER (WHERE category = 'captured') / nullif(sum(label), 0)::DOUBLE, 6) AS capture_rate FROM deciles GROUP BY decile""",
)
def _(spark, folder):
    return rounded(outcomes.time_deciles(_cases(spark, folder)))


@query(
    "k17_leading_errors",
    f"""WITH {ORDERS}, {CASES} SELECT category, txn_id, score, CAST(row_number() OVER (PARTITION BY category ORDER BY score DESC, txn_id) AS INTEGER) AS error_rank
        FROM cases WHERE category IN ('missed', 'unnecessary') QUALIFY error_rank <= 20""",
)
def _(spark, folder):
    return outcomes.leading_errors(_cases(spark, folder)).select("category", "txn_id", "score", "error_rank")


@query("k18_boundary_score", f"WITH {ORDERS}, {CASES} SELECT min(score) AS boundary_score FROM cases WHERE reviewed")
def _(spark, folder):
    return outcomes.boundary_score(orders(spark, folder), ALL_SCORES)


VALUES = """reviewed_count * 5.0::DOUBLE AS total_review_cost, captured_count * 500.0::DOUBLE AS total_prevention_value,
  captured_count * 500.0::DOUBLE - reviewed_count * 5.0::DOUBLE AS net_value, missed_count * 500.0::DOUBLE AS residual_exposure"""


@query("k19_value_summary", f"WITH {ORDERS}, {CASES}, {SUMMARY} SELECT *, {SUMMARY_RATES}, {VALUES} FROM summary")
def _(spark, folder):
    return rounded(outcomes.value_summary(outcomes.policy_error_summary(_cases(spark, folder), 1000), COSTS))


@query(
    "k19_value_components",
    f"""WITH {ORDERS}, {CASES}, {SUMMARY}, v AS (SELECT {VALUES} FROM summary)
        SELECT unnest(['prevention_value', 'review_cost', 'net_value', 'residual_exposure']) AS component,
          unnest([total_prevention_value, -total_review_cost, net_value, -residual_exposure]) AS amount FROM v""",
)
def _(spark, folder):
    values = outcomes.value_summary(outcomes.policy_error_summary(_cases(spark, folder), 1000), COSTS)
    return outcomes.value_components(values)


@query(
    "k20_capacity_values",
    f"""WITH {ORDERS}, {_capacity_sql(CAPACITIES)} SELECT {RESULT_COLUMNS}, total_positives - captured_count AS missed_count,
          (total_positives - captured_count) * 500.0::DOUBLE AS residual_exposure FROM results""",
)
def _(spark, folder):
    return rounded(outcomes.capacity_values(_two_runs(spark, folder)[0], COSTS))


def _period_sql(split: str) -> str:
    return f"""SELECT count(*) FILTER (WHERE r <= 200) AS s, CAST(sum(label) FILTER (WHERE r <= 200) AS BIGINT) AS c, CAST(sum(label) AS BIGINT) AS p,
      '{split}' AS evaluation_period FROM (SELECT *, {TOP} AS r FROM split WHERE split = '{split}')"""


@query(
    "k21_period_comparison",
    f"""WITH {ORDERS}, {SPLIT_SQL}, u AS ({_period_sql('validation')} UNION ALL {_period_sql('test')})
        SELECT 200 AS review_capacity, s AS selected_review_count, round(s / 200.0::DOUBLE, 6) AS capacity_utilisation, c AS captured_count, p AS total_positives,
          round(c / p::DOUBLE, 6) AS capture_rate, s - c AS false_positive_reviews, s * 5.0::DOUBLE AS total_review_cost,
          c * 500.0::DOUBLE AS total_prevention_value, c * 500.0::DOUBLE - s * 5.0::DOUBLE AS net_value, evaluation_period,
          round(c / s::DOUBLE, 6) AS review_precision FROM u""",
)
def _(spark, folder):
    tagged = splits.ratio_split(orders(spark, folder))
    chosen = policy.ReviewPolicy(200)
    results = {
        s: policy.evaluate_policy(tagged.where(F.col("split") == s), chosen, COSTS) for s in ("validation", "test")
    }
    return rounded(outcomes.period_comparison(results))


@query(
    "k22_final_holdout",
    f"""WITH RECURSIVE {ORDERS}, {SPLIT_SQL}, cuts AS (SELECT max(t) FILTER (WHERE pos = CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT)) AS a,
          max(t) FILTER (WHERE pos = CAST(floor(n * CAST(0.85 AS DOUBLE)) AS BIGINT)) AS b FROM split),
        validation AS (SELECT txn.* FROM txn, cuts WHERE t >= a AND t < b),
        placed AS (SELECT *, row_number() OVER (ORDER BY t, txn_id) - 1 AS vpos, count(*) OVER () AS vn FROM validation),
        early AS (SELECT * FROM validation WHERE t < (SELECT t FROM placed WHERE vpos = CAST(floor(vn * 0.5) AS BIGINT))),
        {_newton_sql('newton', 'early')}, holdout AS (SELECT txn.* REPLACE ({SIGMOID.replace('a *', 'newton.a *').replace('+ b)', '+ newton.b)')} AS score) FROM txn, cuts, newton WHERE t >= cuts.b),
        picked AS (SELECT *, {TOP} AS r FROM holdout),
        k AS (SELECT count(*) FILTER (WHERE r <= 200) AS s, CAST(sum(label) FILTER (WHERE r <= 200) AS BIGINT) AS c, CAST(sum(label) AS BIGINT) AS p FROM picked)
        SELECT 200 AS review_capacity, s AS selected_review_count, round(s / 200.0::DOUBLE, 6) AS capacity_utilisation, c AS captured_count, p AS total_positives,
          round(c / p::DOUBLE, 6) AS capture_rate, s - c AS false_positive_reviews, s * 5.0::DOUBLE AS total_review_cost,
          c * 500.0::DOUBLE AS total_prevention_value, c * 500.0::DOUBLE - s * 5.0::DOUBLE AS net_value FROM k""",
)
def _(spark, folder):
    """Fit and lock the mapping on the earlier half of validation, then price the holdout once with the saved mapping."""
    tagged = splits.ratio_split(orders(spark, folder), snap=True)
    later = splits.fraction_split(tagged.where("split = 'validation'"), "t", 0.5)
    path = shared_path(spark, "locked-mapping")
    state.save_calibrator(spark, calibration.Calibrator("sigmoid").fit(later.where("period = 'fit'")), path)
    holdout = state.load_calibrator(spark, path).predict(tagged.where("split = 'test'"))
    return rounded(policy.evaluate_policy(holdout, policy.ReviewPolicy(200), COSTS, Roles(score="calibrated")))


COEFFICIENTS = {"amount": 0.00002, "score": -1.5, "t": 0.001}


@query(
    "h1_linear_attributions",
    f"""WITH {ORDERS}, {SPLIT_SQL}, m AS (SELECT avg(amount) AS a, avg(score) AS s, avg(CAST(t AS DOUBLE)) AS t0 FROM split WHERE split = 'train')
        SELECT txn_id AS case, unnest(['amount', 'score', 't']) AS feature,
          unnest([round(0.00002::DOUBLE * (amount - a), 6), round(-1.5::DOUBLE * (score - s), 6), round(0.001::DOUBLE * (t - t0), 6)]) AS value
        FROM split, m WHERE split = 'test'""",
)
def _(spark, folder):
    tagged = splits.ratio_split(orders(spark, folder))
    made = attribution.linear_attributions(
        tagged.where("split = 'test'"), COEFFICIENTS, tagged.where("split = 'train'"), "txn_id"
    )
    return rounded(made)


def _attributions(spark, folder):
    """Embedding components as attributions: four seeds per case, one feature per position."""
    spread = table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 4).alias("case"),
        (F.col("vec_id") % 4).cast("int").alias("seed"),
        F.posexplode("embedding").alias("pos", "component"),
    )
    name = F.concat(F.lit("f"), F.lpad(F.col("pos").cast("string"), 4, "0"))
    return spread.select("case", "seed", name.alias("feature"), F.col("component").cast("double").alias("value"))


ATTRIBUTIONS = """attr AS (SELECT vec_id // 4 AS case, CAST(vec_id % 4 AS INTEGER) AS seed,
  'f' || lpad(CAST(i - 1 AS VARCHAR), 4, '0') AS feature, CAST(embedding[i] AS DOUBLE) AS value
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


@query(
    "h2_global_importance",
    f"""WITH {ATTRIBUTIONS}, g AS (SELECT feature, avg(abs(value)) AS m FROM attr GROUP BY feature)
        SELECT feature, round(m, 6) AS mean_absolute_value, CAST(row_number() OVER (ORDER BY m DESC, feature) AS INTEGER) AS rank FROM g""",
)
def _(spark, folder):
    return rounded(attribution.global_importance(_attributions(spark, folder)))


@query(
    "h3_local_explanations",
    f"""WITH {ATTRIBUTIONS}, one AS (SELECT * FROM attr WHERE value <> 0), d AS (SELECT *, CASE WHEN value > 0 THEN 'positive' ELSE 'negative' END AS direction FROM one)
        SELECT "case", seed, direction, feature, round(value, 6) AS value, CAST(row_number() OVER (PARTITION BY "case", seed, direction ORDER BY abs(value) DESC, feature) AS INTEGER) AS rank
        FROM d QUALIFY rank <= 5""",
)
def _(spark, folder):
    made = attribution.local_explanation(_attributions(spark, folder), 5, ("case", "seed"))
    return rounded(made.select("case", "seed", "direction", "feature", "value", "rank"))


BEST = """best AS (SELECT *, row_number() OVER (PARTITION BY "case", seed ORDER BY abs(value) DESC, feature) AS r FROM attr QUALIFY r <= 10)"""


@query("h4_top_features", f"""WITH {ATTRIBUTIONS}, {BEST} SELECT "case", seed, feature, CAST(r AS INTEGER) AS rank FROM best""")
def _(spark, folder):
    return attribution.top_features(_attributions(spark, folder), 10).select("case", "seed", "feature", "rank")


PAIRS = f"""{BEST}, sets AS (SELECT "case", seed, list(feature) AS fs FROM best GROUP BY ALL),
pairs AS (SELECT a."case", a.seed AS seed_a, b.seed AS seed_b, 10 AS top_feature_count,
  CAST(len(list_intersect(a.fs, b.fs)) AS INTEGER) AS shared_count, CAST(len(list_distinct(list_concat(a.fs, b.fs))) AS INTEGER) AS union_count,
  len(list_intersect(a.fs, b.fs)) / len(list_distinct(list_concat(a.fs, b.fs)))::DOUBLE AS jaccard,
  array_to_string(list_sort(list_intersect(a.fs, b.fs)), ' | ') AS shared_features
  FROM sets a JOIN sets b ON a."case" = b."case" AND a.seed < b.seed)"""


@query(
    "h5_pairwise_stability",
    f"""WITH {ATTRIBUTIONS}, {PAIRS} SELECT * EXCLUDE (jaccard), round(jaccard, 6) AS jaccard_similarity FROM pairs""",
)
def _(spark, folder):
    return rounded(attribution.pairwise_stability(_attributions(spark, folder), [0, 1, 2, 3], 10))


@query(
    "h6_stability_summary",
    f"""WITH {ATTRIBUTIONS}, {PAIRS} SELECT "case", count(*) AS seed_pairs, round(avg(jaccard), 6) AS mean_jaccard, round(min(jaccard), 6) AS min_jaccard,
          round(max(jaccard), 6) AS max_jaccard, round(avg(shared_count::DOUBLE), 6) AS mean_shared FROM pairs GROUP BY "case" """,
)
def _(spark, folder):
    return rounded(attribution.stability_summary(attribution.pairwise_stability(_attributions(spark, folder), [0, 1, 2, 3], 10)))


@query(
    "h7_representative_cases",
    f"""WITH {ORDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, txn_id) AS hi,
          row_number() OVER (PARTITION BY label ORDER BY score, txn_id) AS lo FROM txn)
        SELECT 'ranked_positive' AS case_group, txn_id, label, score FROM r WHERE label = 1 AND hi = 1
        UNION ALL SELECT 'missed_positive', txn_id, label, score FROM r WHERE label = 1 AND lo = 1
        UNION ALL SELECT 'ranked_negative', txn_id, label, score FROM r WHERE label = 0 AND lo = 1
        UNION ALL SELECT 'unnecessary_negative', txn_id, label, score FROM r WHERE label = 0 AND hi = 1""",
)
def _(spark, folder):
    return attribution.representative_cases(orders(spark, folder))


@query(
    "h8_background_sample",
    f"WITH {ORDERS} SELECT txn_id, amount, label FROM txn ORDER BY md5(CAST(txn_id AS VARCHAR) || ':42'), txn_id LIMIT 500",
)
def _(spark, folder):
    return attribution.hash_sample(orders(spark, folder), 500, "txn_id", 42).select("txn_id", "amount", "label")
