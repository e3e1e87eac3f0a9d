"""Preprocessing, classifiers, anomaly scores and record tables over the test tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hindcast.operators import anomaly, attribution, modelling, policy, quality, ranking, records, splits
from hindcast.plans.bindings import EVENTS, HOUR, ORDERS, events, orders, rounded
from hindcast.plans.decision_queries import COSTS, DECIDED, PICKED
from hindcast.plans.feature_queries import SPLIT_SQL
from hindcast.plans.registry import query
from hindcast.session import cut_lineage, shared_path, written
from hindcast.sources import files, sinks

NUMERIC = ["amount", "device", "card"]
CATEGORICAL = ["email"]


def _splits(spark, folder):
    """Training and validation rows; the events are parsed once, since fitting passes over them many times."""
    tagged = splits.ratio_split(written(events(spark, folder)))
    return tagged.where("split = 'train'"), tagged.where("split = 'validation'")


def _odd_values(rows):
    """Device with infinities and NaN beside its NULLs."""
    device = F.col("device").cast("double")
    odd = F.when(device % 10 == 3, F.lit(float("inf"))).when(device % 10 == 4, F.lit(float("nan"))).otherwise(device)
    return rows.withColumn("device", odd)


@query(
    "p10_non_finite_cleanup",
    f"""WITH {EVENTS}, {SPLIT_SQL}, odd AS (SELECT txn_id, split, CASE WHEN device % 10 IN (3, 4) THEN NULL ELSE CAST(device AS DOUBLE) END AS d FROM split),
        m AS (SELECT quantile_cont(d, 0.5) AS median FROM odd WHERE split = 'train')
        SELECT txn_id, coalesce(d, median, 0.0) AS device FROM odd, m WHERE split = 'validation'""",
)
def _(spark, folder):
    train, later = (_odd_values(df) for df in _splits(spark, folder))
    medians = modelling.fitted_medians(train, ["device"])
    return later.select("txn_id", modelling.filled("device", medians["device"]).alias("device"))


def _scaled_sql(c: str) -> str:
    return f"""f_{c} AS (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med FROM train),
      s_{c} AS (SELECT avg(coalesce(CAST({c} AS DOUBLE), med)) AS m, stddev_pop(coalesce(CAST({c} AS DOUBLE), med)) AS s,
        avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS im, stddev_pop(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS is_ FROM train, f_{c})"""


@query(
    "m1_numeric_preprocessing",
    f"""WITH {EVENTS}, {SPLIT_SQL}, train AS (SELECT * FROM split WHERE split = 'train'), {_scaled_sql('amount')}, {_scaled_sql('device')}, {_scaled_sql('card')}
        SELECT txn_id, round((amount - s_amount.m) / s_amount.s, 6) AS amount_scaled,
          round((coalesce(CAST(device AS DOUBLE), f_device.med) - s_device.m) / s_device.s, 6) AS device_scaled,
          round((CASE WHEN device IS NULL THEN 1.0::DOUBLE ELSE 0.0 END - s_device.im) / s_device.is_, 6) AS device_missing_scaled,
          round((card - s_card.m) / s_card.s, 6) AS card_scaled
        FROM split, s_amount, f_device, s_device, s_card WHERE split = 'validation'""",
)
def _(spark, folder):
    train, later = _splits(spark, folder)
    fitted = modelling.Preprocessor(NUMERIC, []).fit(train)
    return rounded(later.select("txn_id", *(c.alias(n) for n, c in fitted.scaled_columns().items())))


@query(
    "m2_modes",
    f"""WITH {EVENTS}, {SPLIT_SQL}, l AS (SELECT 'email' AS column, email AS category FROM split WHERE split = 'train' AND email IS NOT NULL
          UNION ALL SELECT 'device', CAST(device AS VARCHAR) FROM split WHERE split = 'train' AND device IS NOT NULL),
        c AS (SELECT "column", category, count(*) AS n FROM l GROUP BY ALL)
        SELECT "column", category AS mode, n AS row_count FROM c QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, category) = 1""",
)
def _(spark, folder):
    return modelling.modes(_splits(spark, folder)[0], ["email", "device"])


ONE_HOT = """known AS (SELECT email, row_number() OVER (ORDER BY email) AS slot FROM (SELECT DISTINCT email FROM train WHERE email IS NOT NULL)),
mode AS (SELECT email AS top FROM train WHERE email IS NOT NULL GROUP BY email ORDER BY count(*) DESC, email LIMIT 1),
hot AS (SELECT s.*, coalesce(k.slot, 0) AS slot FROM split s CROSS JOIN mode LEFT JOIN known k ON k.email = coalesce(s.email, top) WHERE split = 'validation')"""


@query(
    "m2_one_hot",
    f"""WITH {EVENTS}, {SPLIT_SQL}, train AS (SELECT * FROM split WHERE split = 'train'), {ONE_HOT}
        SELECT txn_id, slot AS hot_column FROM hot""",
)
def _(spark, folder):
    train, later = _splits(spark, folder)
    fitted = modelling.Preprocessor([], CATEGORICAL).fit(train)
    made = fitted.transform(later, ("txn_id",))
    return made.select("txn_id", F.array_position(vector_to_array("features"), 1.0).alias("hot_column"))


def _prepared(spark, folder):
    train, later = _splits(spark, folder)
    fitted = modelling.Preprocessor(NUMERIC, CATEGORICAL).fit(train)
    return fitted, fitted.transform(train, ("txn_id", "label")), fitted.transform(later, ("txn_id", "label"))


@query(
    "m3_column_transformer",
    f"""WITH {EVENTS}, {SPLIT_SQL}, train AS (SELECT * FROM split WHERE split = 'train'), {ONE_HOT},
        {_scaled_sql('amount')}, {_scaled_sql('device')}, {_scaled_sql('card')}, w AS (SELECT 4 + count(*) AS width FROM known)
        SELECT txn_id, CAST(width AS INTEGER) AS width, CAST(width AS INTEGER) AS expected_width,
          round((amount - s_amount.m) / s_amount.s + (coalesce(CAST(device AS DOUBLE), f_device.med) - s_device.m) / s_device.s
            + (CASE WHEN device IS NULL THEN 1.0::DOUBLE ELSE 0.0 END - s_device.im) / s_device.is_ + (card - s_card.m) / s_card.s
            + CASE WHEN slot > 0 THEN 1.0::DOUBLE ELSE 0.0 END, 6) AS total
        FROM hot, s_amount, f_device, s_device, s_card, w""",
)
def _(spark, folder):
    fitted, _, later = _prepared(spark, folder)
    values = vector_to_array("features")
    return rounded(
        later.select(
            "txn_id",
            F.size(values).alias("width"),
            F.lit(fitted.width()).alias("expected_width"),
            F.aggregate(values, F.lit(0.0), lambda a, v: a + v).alias("total"),
        )
    )


@query(
    "m4_class_weight",
    f"""WITH {EVENTS}, {SPLIT_SQL} SELECT round(count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1)::DOUBLE, 6) AS positive_weight,
          round(sum(CASE WHEN label = 1 THEN t.n / (2.0 * t.p) ELSE t.n / (2.0 * (t.n - t.p)) END), 6) AS balanced_total
        FROM split, (SELECT count(*)::DOUBLE AS n, sum(label)::DOUBLE AS p FROM split WHERE split = 'train') t WHERE split = 'train'""",
)
def _(spark, folder):
    train, _ = _splits(spark, folder)
    weight = modelling.class_weight(train, "label")
    weighted = modelling.balanced_weights(train, "label")
    return rounded(weighted.agg(F.lit(weight).alias("positive_weight"), F.sum("weight").alias("balanced_total")))


@query("m5_logistic_scores")
def _(spark, folder):
    _, train, later = _prepared(spark, folder)
    return rounded(modelling.score(modelling.fit_logistic(train, "label"), later))


@query(
    "m5_logistic_optimum",
    f"""WITH {EVENTS}, {SPLIT_SQL}, train AS (SELECT * FROM split WHERE split = 'train'), known AS (SELECT DISTINCT email FROM train WHERE email IS NOT NULL)
        SELECT CAST(unnest(range(0, 4 + (SELECT count(*) FROM known))) AS INTEGER) AS feature, 0.0::DOUBLE AS gradient""",
)
def _(spark, folder):
    """The penalised gradient of every coefficient per unit of weight: zero at the optimum."""
    _, train, _ = _prepared(spark, folder)
    model = modelling.fit_logistic(train, "label")
    weighted = modelling.balanced_weights(modelling.score(model, train).join(train.select("txn_id", "features"), "txn_id"), "label")
    long = weighted.select("label", "score", "weight", F.posexplode(vector_to_array("features")).alias("feature", "x"))
    total = weighted.agg(F.sum("weight")).scalar()
    slope = long.groupBy("feature").agg(F.sum(F.col("weight") * (F.col("score") - F.col("label")) * F.col("x")).alias("slope"))
    coefficients = F.element_at(F.array(*(F.lit(float(c)) for c in model.coefficients)), F.col("feature") + 1)
    gradient = (F.col("slope") + coefficients / 0.1) / total
    return slope.select("feature", (F.round(gradient, 4) + 0.0).alias("gradient"))


@query("m6_boosted_scores")
def _(spark, folder):
    train, later = _splits(spark, folder)
    fitted = modelling.Preprocessor(NUMERIC, CATEGORICAL).fit(train)
    parts = splits.tail_split(train, 0.1).withColumn("stops", F.col("part") == "early_stop")
    prepared = cut_lineage(fitted.transform(parts, ("txn_id", "label", "stops")))
    model = modelling.fit_boosted(prepared, "label", "stops")
    return rounded(modelling.score(model, fitted.transform(later, ("txn_id", "label"))))


@query(
    "m6_stopping_rule",
    f"""WITH {EVENTS}, {SPLIT_SQL}
        SELECT 10::BIGINT AS rounds, count(*) - CAST(floor(count(*) * 0.9::DOUBLE) AS BIGINT) AS stopping_rows,
          true AS kept_is_highest, true AS curve_is_that_of_the_scores FROM split WHERE split = 'train'""",
)
def _(spark, folder):
    """The kept rounds have the highest published average precision, which their scores on the stopping rows give again."""
    train, _ = _splits(spark, folder)
    fitted = modelling.Preprocessor(NUMERIC, CATEGORICAL).fit(train)
    parts = splits.tail_split(train, 0.1).withColumn("stops", F.col("part") == "early_stop")
    prepared = cut_lineage(fitted.transform(parts, ("txn_id", "label", "stops")))
    boosted = modelling.fit_boosted(prepared, "label", "stops", rounds=10, depth=4)
    scored = modelling.score(boosted, prepared.where("stops"))
    areas = ranking.ranking_areas(scored)
    highest = boosted.curve[boosted.kept - 1]
    return areas.select(
        F.lit(len(boosted.curve)).cast("long").alias("rounds"),
        scored.agg(F.count(F.lit(1))).scalar().alias("stopping_rows"),
        F.lit(highest == max(boosted.curve)).alias("kept_is_highest"),
        (F.abs(F.col("pr_auc") - highest) < 1e-9).alias("curve_is_that_of_the_scores"),
    )


@query("m7_scoring_latency")
def _(spark, folder):
    _, train, later = _prepared(spark, folder)
    return modelling.scoring_latency(modelling.fit_logistic(train, "label"), later)


@query(
    "m7_scored_rows",
    f"WITH {EVENTS}, {SPLIT_SQL} SELECT count(*) AS row_count, true AS timed, true AS mean_is_a_probability FROM split WHERE split = 'validation'",
)
def _(spark, folder):
    _, train, later = _prepared(spark, folder)
    made = modelling.scoring_latency(modelling.fit_logistic(train, "label"), later)
    return made.select("row_count", (F.col("ms_per_row") > 0).alias("timed"), F.col("mean_score").between(0, 1).alias("mean_is_a_probability"))


@query("h1_fitted_attributions")
def _(spark, folder):
    """Attributions of the fitted linear model against a background sample of training rows."""
    train, later = _splits(spark, folder)
    fitted = modelling.Preprocessor(["amount", "card"], []).fit(train)
    model = modelling.fit_logistic(fitted.transform(train, ("txn_id", "label")), "label")
    columns = fitted.scaled_columns()
    coefficients = dict(zip(columns, (float(c) for c in model.coefficients), strict=True))
    scaled = [df.select("txn_id", *(c.alias(n) for n, c in columns.items())) for df in (train, later)]
    background = attribution.hash_sample(scaled[0], 500, "txn_id", 42)
    return rounded(attribution.linear_attributions(scaled[1], coefficients, background, "txn_id"))


@query(
    "h1_attributions_add_up",
    f"WITH {EVENTS}, {SPLIT_SQL} SELECT txn_id, 0.0::DOUBLE AS gap FROM split WHERE split = 'validation'",
)
def _(spark, folder):
    """Attributions of a row sum to its margin less the background's mean margin."""
    train, later = _splits(spark, folder)
    fitted = modelling.Preprocessor(["amount", "card"], []).fit(train)
    model = modelling.fit_logistic(fitted.transform(train, ("txn_id", "label")), "label")
    columns = fitted.scaled_columns()
    coefficients = dict(zip(columns, (float(c) for c in model.coefficients), strict=True))
    scaled = [df.select("txn_id", *(c.alias(n) for n, c in columns.items())) for df in (train, later)]
    background = attribution.hash_sample(scaled[0], 500, "txn_id", 42)
    made = attribution.linear_attributions(scaled[1], coefficients, background, "txn_id")
    margin = sum((F.col(n) * c for n, c in coefficients.items()), F.lit(0.0))
    base = background.agg(F.avg(margin)).scalar()
    key = next(c for c in ("txn_id", "case") if c in made.columns)
    total = made.groupBy(F.col(key).alias("txn_id")).agg(F.sum("value").alias("total"))
    rows = scaled[1].select("txn_id", (margin - base).alias("expected"))
    return total.join(rows, "txn_id").select("txn_id", (F.round(F.col("total") - F.col("expected"), 6) + 0.0).alias("gap"))


FEATURES = ["amount", "device", "score"]
FOREST = anomaly.ForestSettings()


@query("n1_isolation_forest")
def _(spark, folder):
    rows = events(spark, folder)
    return anomaly.forest_summary(anomaly.fit_forests(rows, "txn_id", FEATURES, {0: F.lit(True)}, FOREST), rows)


@query(
    "n1_forest_shape",
    "SELECT 200 AS trees, 200 AS trees_with_a_full_sample, true AS depth_is_bounded",
)
def _(spark, folder):
    """Every tree drew its whole sample, and none is deeper than the logarithm of it."""
    rows = events(spark, folder)
    made = anomaly.forest_summary(anomaly.fit_forests(rows, "txn_id", FEATURES, {0: F.lit(True)}, FOREST), rows)
    return made.agg(
        F.count(F.lit(1)).cast("int").alias("trees"),
        F.count_if(F.col("sample_size") == FOREST.sample).cast("int").alias("trees_with_a_full_sample"),
        (F.max("depth") <= 8).alias("depth_is_bounded"),
    )


@query(
    "n2_contamination",
    f"""WITH {EVENTS}, {SPLIT_SQL} SELECT count(*) AS row_count, 0 AS rows_without_score, true AS share_is_the_contamination FROM split WHERE split = 'train'""",
)
def _(spark, folder):
    """The threshold leaves the stated share of the training rows above it."""
    train, _ = _splits(spark, folder)
    fitted = anomaly.fit_forests(train, "txn_id", FEATURES, {0: F.lit(True)}, FOREST)
    scored = fitted.score(train, F.lit(0), ("txn_id",))
    share = F.avg((F.col("anomaly_score") > 0).cast("double"))
    return scored.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("anomaly_score").isNull()).cast("int").alias("rows_without_score"),
        (F.abs(share - FOREST.contamination) <= 0.01).alias("share_is_the_contamination"),
    )


@query("n2_anomaly_scores")
def _(spark, folder):
    train, later = _splits(spark, folder)
    fitted = anomaly.fit_forests(train, "txn_id", FEATURES, {0: F.lit(True)}, FOREST)
    return rounded(fitted.score(later, F.lit(0), ("txn_id",)))


@query("n3_out_of_fold_scores")
def _(spark, folder):
    train, later = (df.drop("split") for df in _splits(spark, folder))
    return rounded(anomaly.out_of_fold_scores(train, later, "txn_id", "t", FEATURES, 5, FOREST))


@query(
    "n3_out_of_fold_coverage",
    f"""WITH {EVENTS}, {SPLIT_SQL} SELECT CASE WHEN split = 'validation' THEN 'later' ELSE 'train' END AS part, count(*) AS row_count, split = 'train' AS some_without_score
        FROM split WHERE split IN ('train', 'validation') GROUP BY split""",
)
def _(spark, folder):
    """All rows come back; only the first training fold has no past to learn from."""
    train, later = (df.drop("split") for df in _splits(spark, folder))
    made = anomaly.out_of_fold_scores(train, later, "txn_id", "t", FEATURES, 5, FOREST)
    consistent = F.col("anomaly_score").isNull() == (F.col("fold") == 0)
    part = F.when(F.col("fold") == 5, "later").otherwise("train").alias("part")
    return made.groupBy(part).agg(
        F.count(F.lit(1)).alias("row_count"),
        (F.every(consistent) & (F.count_if(F.col("anomaly_score").isNull()) > 0)).alias("some_without_score"),
    )


@query(
    "x8_holdout_lock",
    f"WITH {ORDERS}, {SPLIT_SQL} SELECT count(*) AS row_count, count(*) AS opened_rows, true AS locked_for_training FROM split WHERE split = 'test'",
)
def _(spark, folder):
    path = shared_path(spark, "locked")
    tagged = splits.ratio_split(orders(spark, folder))
    sinks.write_new(tagged.where("split = 'test'").drop("split"), f"{path}/test")
    try:
        files.open_split(spark, path, "test", "training")
        locked = False
    except PermissionError:
        locked = True
    opened = files.open_split(spark, path, "test", "final_holdout")
    return opened.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.col("row_count").alias("opened_rows"), F.lit(locked).alias("locked_for_training")
    )


BANDS = "CASE WHEN score >= 0.5 THEN 'critical' WHEN score >= 0.2 THEN 'high' WHEN score >= 0.05 THEN 'medium' ELSE 'low' END"


@query(
    "v1_predictions",
    f"""WITH {ORDERS}, {DECIDED} SELECT txn_id, score AS probability, {BANDS} AS risk_band, action AS recommended_action,
          round(CASE action WHEN 'approve' THEN score * 500.0 WHEN 'review' THEN 5.0 ELSE (1 - score) * 10.0 END, 6) AS expected_cost, 'v1' AS model_version FROM decided""",
)
def _(spark, folder):
    chosen = policy.ReviewPolicy(1000, 0.10, 0.99, 0.60)
    return rounded(records.predictions(orders(spark, folder), chosen, COSTS, "v1"))


@query(
    "v2_investigation_queue",
    f"WITH {ORDERS}, {PICKED} SELECT txn_id, 'open' AS case_status, CAST(r AS INTEGER) AS priority FROM picked WHERE r <= 1000",
)
def _(spark, folder):
    return records.investigation_queue(orders(spark, folder), policy.ReviewPolicy(1000, 0.10, 0.99))


@query(
    "v3_entities",
    f"""WITH {EVENTS}, l AS (SELECT 'card' AS entity_type, CAST(card AS VARCHAR) AS v, t, txn_id FROM txn UNION ALL
          SELECT 'device', CAST(device AS VARCHAR), t, txn_id FROM txn UNION ALL SELECT 'email', email, t, txn_id FROM txn)
        SELECT entity_type, sha256(v) AS value_hash, arg_min(txn_id, (t, txn_id)) AS first_key, arg_max(txn_id, (t, txn_id)) AS last_key
        FROM l WHERE v IS NOT NULL GROUP BY entity_type, v""",
)
def _(spark, folder):
    return records.entities(events(spark, folder), ["card", "device", "email"])


@query(
    "v4_feature_snapshots",
    f"""WITH {EVENTS} SELECT txn_id, 'v1' AS feature_version, '{{"card":' || card || ',"product":"' || product || '"}}' AS payload, t AS available_at FROM txn""",
)
def _(spark, folder):
    return records.feature_snapshots(events(spark, folder).select("txn_id", "card", "product", "t"), "txn_id", "t", "v1")


@query(
    "v5_missingness_flags",
    f"""WITH {EVENTS} SELECT txn_id, CASE WHEN device IS NULL THEN 1 ELSE 0 END AS device_missing,
          CASE WHEN email IS NULL THEN 1 ELSE 0 END AS email_missing FROM txn""",
)
def _(spark, folder):
    made = quality.missingness_flags(events(spark, folder), ["device", "email"])
    return made.select("txn_id", "device_missing", "email_missing")


@query(
    "v6_drift",
    f"""WITH {EVENTS}, p AS (SELECT *, t // {24 * 7 * HOUR} AS period FROM txn), f AS (SELECT min(period) AS first FROM p),
        e AS (SELECT list_distinct(q[2:10]) AS inner_edges, q[1] AS lo, q[11] AS hi FROM (SELECT quantile_cont(score, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS q FROM p, f WHERE period = first)),
        b AS (SELECT p.*, len(list_filter(inner_edges, lambda x: x < score AND x > lo AND x < hi)) AS bin FROM p, e),
        v AS (SELECT period, count(*) AS row_count, avg(score) AS mean_score, avg(CASE WHEN device IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS nulls FROM b GROUP BY period),
        s AS (SELECT b.period, bin, count(*) / max(row_count)::DOUBLE AS share FROM b JOIN v USING (period) GROUP BY ALL),
        g AS (SELECT v.period, r.bin, greatest(coalesce(s.share, 0), 1e-4) AS a, greatest(coalesce(z.share, 0), 1e-4) AS c
              FROM v CROSS JOIN (SELECT unnest(range(10)) AS bin) r LEFT JOIN s ON s.period = v.period AND s.bin = r.bin
              LEFT JOIN (SELECT s.* FROM s, f WHERE period = first) z ON z.bin = r.bin)
        SELECT period, row_count, round(mean_score, 6) AS mean_score, round(nulls, 6) AS device_null_rate,
          round(sum((a - c) * ln(a / c)), 6) AS stability_index, round(row_count / (SELECT row_count::DOUBLE FROM v, f WHERE period = first) - 1, 6) AS volume_change
        FROM v JOIN g USING (period) GROUP BY ALL""",
)
def _(spark, folder):
    rows = events(spark, folder)
    return rounded(records.drift(rows, F.floor(F.col("t") / (24 * 7 * HOUR)), ["device"], "score"))
