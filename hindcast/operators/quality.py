"""Data-quality checks and exploratory aggregates, each one pass over the table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.pvalues import chi_squared_one_degree
from hindcast.functions.scalars import all_of, category, day_of_week, hour_of_day, ratio
from hindcast.operators.ordered import before, profile, quantiles
from hindcast.operators.splits import quantile_edges, right_closed_bin
from hindcast.roles import Roles


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Rows in groups that share a key, with up to ten of those keys."""
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    sample = repeated.orderBy(key).limit(10).agg(F.sort_array(F.collect_list(F.col(key).cast("string"))))
    return repeated.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_count")).select(
        F.lit(key).alias("column"), "duplicate_count", sample.scalar().alias("sample_duplicates")
    )


def require_unique(rows: DataFrame, key: str, name: str) -> None:
    found = duplicates(rows, key).first()
    if found["duplicate_count"]:
        raise ValueError(f"{key} is duplicated in {name}: {found['sample_duplicates']}")


def order_violations(rows: DataFrame, stored_order: str, time: str) -> DataFrame:
    """Rows whose time is smaller than that of the previous row in stored order (a unique column)."""
    narrow = rows.select(stored_order, time).withColumn("_seen", F.struct(stored_order, time))
    placed = before(
        narrow, (), stored_order, layout=profile(narrow, stored_order), maxima={"_previous": "_seen"}, unique=True
    )
    return placed.where(F.col(time) < F.col(f"_previous.{time}")).select(
        stored_order, F.col(f"_previous.{time}").alias("previous_time"), F.col(time).alias("time")
    )


def monotonic_check(rows: DataFrame, stored_order: str, time: str) -> DataFrame:
    found = order_violations(rows, stored_order, time)
    sample = found.orderBy(stored_order).limit(10).agg(F.collect_list("time"))
    return found.agg(F.count(F.lit(1)).alias("violation_count")).select(
        F.lit(time).alias("column"),
        (F.col("violation_count") == 0).alias("is_monotonic"),
        "violation_count",
        sample.scalar().alias("sample_violations"),
    )


def null_rates(rows: DataFrame, columns: list[str] | None = None, threshold: float = 0.95) -> DataFrame:
    """One row per column: its null rate and whether that exceeds the threshold."""
    columns = columns or rows.columns
    rates = rows.agg(*(_null_rate(F.col(c)).alias(c) for c in columns))
    return rates.unpivot([], columns, "column", "null_rate").withColumn(
        "above_threshold", F.col("null_rate") > threshold
    )


def _null_rate(value: Column) -> Column:
    return F.avg(value.isNull().cast("int"))


@dataclass(frozen=True)
class ColumnRule:
    """Declared type and constraints of a column; columns without a rule are allowed."""

    column: str
    type: str
    nullable: bool = True
    unique: bool = False
    above: float | None = None
    at_least: float | None = None
    allowed: tuple = ()


def schema_violations(rows: DataFrame, rules: list[ColumnRule]) -> DataFrame:
    """(column, rule, violations) for every declared constraint."""
    present = set(rows.columns)
    counts: dict[tuple[str, str], Column] = {}
    for rule in rules:
        if rule.column not in present:
            counts[rule.column, "present"] = F.lit(1)
            continue
        value, typed = F.col(rule.column), F.col(rule.column).try_cast(rule.type)
        counts[rule.column, "type"] = F.count_if(value.isNotNull() & typed.isNull())
        if not rule.nullable:
            counts[rule.column, "not_null"] = F.count_if(value.isNull())
        if rule.above is not None:
            counts[rule.column, "above"] = F.count_if(typed <= F.lit(rule.above))
        if rule.at_least is not None:
            counts[rule.column, "at_least"] = F.count_if(typed < F.lit(rule.at_least))
        if rule.allowed:
            counts[rule.column, "allowed"] = F.count_if(~typed.isin(list(rule.allowed)))
    wide = rows.agg(*(c.cast("long").alias(f"{a}|{b}") for (a, b), c in counts.items()))
    long = wide.unpivot([], wide.columns, "name", "violations").select(
        F.split_part("name", F.lit("|"), F.lit(1)).alias("column"),
        F.split_part("name", F.lit("|"), F.lit(2)).alias("rule"),
        "violations",
    )
    for rule in rules:
        if rule.unique and rule.column in present:
            found = duplicates(rows, rule.column)
            long = long.unionByName(
                found.select("column", F.lit("unique").alias("rule"), F.col("duplicate_count").alias("violations"))
            )
    return long


def range_violations(rows: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Negative times, non-positive amounts and labels other than 0 and 1."""
    label = F.col(roles.label)
    wide = rows.agg(
        F.count_if(F.col(roles.time) < 0).alias("time_negative"),
        F.count_if(F.col(roles.amount) <= 0).alias("amount_non_positive"),
        F.count_if(label.isNull() | ~label.isin(0, 1)).alias("label_invalid"),
    )
    return wide.unpivot([], wide.columns, "check", "violations")


def quality_report(
    rows: DataFrame, rules: list[ColumnRule], roles: Roles = Roles(), null_threshold: float = 0.95
) -> DataFrame:
    """Every check as rows (check, subject, value, passed). Unordered times are reported, not failed."""

    def shaped(df: DataFrame, check: str, subject: Column, value: Column, passed: Column) -> DataFrame:
        return df.select(
            F.lit(check).alias("check"),
            subject.cast("string").alias("subject"),
            value.cast("double").alias("value"),
            passed.alias("passed"),
        )

    schema = schema_violations(rows, rules)
    parts = [
        shaped(
            schema,
            "schema",
            F.concat_ws(":", "column", "rule"),
            F.col("violations"),
            F.col("violations") == 0,
        ),
        shaped(duplicates(rows, roles.key), "duplicates", F.col("column"), F.col("duplicate_count"), F.col("duplicate_count") == 0),
        shaped(monotonic_check(rows, roles.key, roles.time), "time_order", F.col("column"), F.col("violation_count"), F.lit(True)),
        shaped(null_rates(rows, threshold=null_threshold), "null_rate", F.col("column"), F.col("null_rate"), F.lit(True)),
        shaped(range_violations(rows, roles), "range", F.col("check"), F.col("violations"), F.col("violations") == 0),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def stratified_null_rates(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Null rate per column, overall and within each group value."""
    rates = [_null_rate(F.col(c)).alias(c) for c in columns]
    overall = rows.agg(*rates).select(F.lit("overall").alias("stratum"), *columns)
    strata = rows.groupBy(group).agg(*rates)
    strata = strata.select(F.concat(F.lit("group_"), F.col(group).cast("string")).alias("stratum"), *columns)
    return overall.unionByName(strata).unpivot(["stratum"], columns, "column", "null_rate")


def differential_missingness(
    rows: DataFrame, label: str, columns: list[str], significance: float = 0.05
) -> DataFrame:
    """Chi-squared test of missing x label per column, with continuity correction.

    Columns whose 2x2 table has a cell below 5 are left out.
    """
    cells = rows.agg(
        *(
            F.struct(
                *(
                    F.count_if((F.col(label) == y) & (F.col(c).isNull() if m else F.col(c).isNotNull())).alias(f"{n}")
                    for n, (m, y) in {"a": (False, 0), "b": (False, 1), "c": (True, 0), "d": (True, 1)}.items()
                )
            ).alias(c)
            for c in columns
        )
    )
    a, b, c, d = (F.col(f"cells.{x}").cast("double") for x in "abcd")
    n = a + b + c + d
    gap = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    table = cells.unpivot([], columns, "column", "cells").where(F.least(a, b, c, d) >= 5)
    tested = table.select(
        "column",
        (n * gap * gap / ((a + b) * (c + d) * (a + c) * (b + d))).alias("chi2_statistic"),
        (c / (a + c)).alias("missing_rate_group_0"),
        (d / (b + d)).alias("missing_rate_group_1"),
    )
    return (
        tested.withColumn("dof", F.lit(1))
        .withColumn("difference", F.abs(F.col("missing_rate_group_0") - F.col("missing_rate_group_1")))
        .withColumn("p_value", chi_squared_one_degree("chi2_statistic"))
        .withColumn("significant", F.col("p_value") < significance)
        .orderBy(F.desc("difference"), "column")
    )


def temporal_missingness(
    rows: DataFrame, time: str, columns: list[str], bins: int = 10, min_rate: float = 0.05, most: int | None = None
) -> DataFrame:
    """Null rate per time bin for every sparse column, with the first-to-last trend.

    ``most`` keeps only so many of them, in the order given; without sparse columns the table is empty.
    """
    rates = rows.agg(*(_null_rate(F.col(c)).alias(c) for c in columns)).first() if columns else {}
    sparse = [c for c in columns if rates[c] is not None and rates[c] > min_rate][:most]
    if not sparse:
        kinds = "column string, time_bin int, null_rate double, overall_null_rate double, trend string"
        return rows.sparkSession.createDataFrame([], kinds)
    edges = quantile_edges(rows, time, bins)
    binned = rows.withColumn("time_bin", right_closed_bin(F.col(time), edges))
    per_bin = binned.groupBy("time_bin").agg(*(_null_rate(F.col(c)).alias(c) for c in sparse))
    long = per_bin.unpivot(["time_bin"], sparse, "column", "null_rate")
    ends = long.groupBy("column").agg(
        F.min_by("null_rate", "time_bin").alias("first"), F.max_by("null_rate", "time_bin").alias("last")
    )
    trend = (
        F.when(F.col("last") > F.col("first"), "increasing")
        .when(F.col("last") < F.col("first"), "decreasing")
        .otherwise("stable")
    )
    overall = F.coalesce(*(F.when(F.col("column") == c, F.lit(rates[c])) for c in sparse))
    return (
        long.join(ends, "column")
        .select("column", "time_bin", "null_rate", overall.alias("overall_null_rate"), trend.alias("trend"))
    )


def amount_distribution(rows: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Mean, sample deviation, extremes and exact quartiles, overall and per label."""
    amount, label = F.col(roles.amount), F.col(roles.label)
    groups = {"overall": F.lit(True), "0": label == 0, "1": label == 1}
    exact = quantiles(rows, {g: F.when(test, amount) for g, test in groups.items()}, [0.25, 0.5, 0.75])
    scoped = rows.select(
        amount.alias("amount"),
        F.explode(F.array(F.lit("overall"), label.cast("string"))).alias("scope"),
    )
    made = scoped.groupBy("scope").agg(
        F.avg("amount").alias("mean"),
        F.stddev_samp("amount").alias("std"),
        F.min("amount").alias("min"),
        F.max("amount").alias("max"),
        F.count(F.lit(1)).alias("count"),
    )
    for i, name in enumerate(("q25", "median", "q75")):
        value = F.coalesce(*(F.when(F.col("scope") == g, F.lit(exact[g][i])) for g in groups))
        made = made.withColumn(name, value)
    return made


def rates_by_clock(rows: DataFrame, seconds: Column, label: str) -> DataFrame:
    """Positive rate and volume by hour of day and by day of week."""
    clock = F.explode(
        F.array(
            F.struct(F.lit("hour").alias("unit"), hour_of_day(seconds).cast("long").alias("value")),
            F.struct(F.lit("day_of_week").alias("unit"), day_of_week(seconds).cast("long").alias("value")),
        )
    )
    spread = rows.select(clock.alias("clock"), F.col(label).cast("double").alias("y"))
    return spread.groupBy(F.col("clock.unit").alias("unit"), F.col("clock.value").alias("value")).agg(
        F.avg("y").alias("positive_rate"), F.count(F.lit(1)).alias("row_count")
    )


def _per_category(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    texts = rows.select(F.col(label).cast("long").alias("_y"), *(F.col(c).cast("string").alias(c) for c in columns))
    long = texts.unpivot(["_y"], columns, "column", "category")
    return long.groupBy("column", "category").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("_y").alias("positives")
    )


def category_rates(rows: DataFrame, columns: list[str], label: str, top: int = 20) -> DataFrame:
    """Positive rate per category, the top categories by rate, with distinct and null counts."""
    stats = _per_category(rows, columns, label)
    sizes = stats.groupBy("column").agg(
        F.count("category").alias("unique_categories"),
        F.coalesce(F.sum(F.when(F.col("category").isNull(), F.col("row_count"))), F.lit(0)).alias("null_count"),
    )
    rated = stats.where(F.col("category").isNotNull()).withColumn("positive_rate", F.col("positives") / F.col("row_count"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("positive_rate"), "category"))
    return rated.withColumn("rank", rank).where(F.col("rank") <= top).join(sizes, "column")


def high_cardinality_profile(
    rows: DataFrame, columns: list[str], label: str, top: int = 10, min_rows: int = 100
) -> DataFrame:
    """Top categories by volume, and by positive rate among those with enough rows."""
    stats = _per_category(rows, columns, label).where(F.col("category").isNotNull())
    stats = stats.withColumn("positive_rate", F.col("positives") / F.col("row_count"))
    by_volume = Window.partitionBy("column").orderBy(F.desc("row_count"), "category")
    by_rate = Window.partitionBy("column").orderBy(F.desc("positive_rate"), "category")
    frequent = stats.withColumn("rank", F.row_number().over(by_volume)).where(F.col("rank") <= top)
    risky = (
        stats.where(F.col("row_count") >= min_rows)
        .withColumn("rank", F.row_number().over(by_rate))
        .where(F.col("rank") <= top)
    )
    picked = ["ranking", "column", "category", "rank", "row_count", "positive_rate"]
    return (
        frequent.withColumn("ranking", F.lit("frequency")).select(picked)
        .unionByName(risky.withColumn("ranking", F.lit("positive_rate")).select(picked))
    )


def modelling_summary(train: DataFrame, later: DataFrame, features: list[str], label: str) -> DataFrame:
    """Rows and positive rate of two splits plus the kinds of the selected columns."""
    kinds = dict(train.dtypes)
    texts = sum(kinds[f] in ("string", "boolean") for f in features)

    def facts(df: DataFrame, name: str) -> DataFrame:
        return df.agg(
            F.lit(name).alias("split"),
            F.count(F.lit(1)).alias("row_count"),
            F.sum(F.col(label).cast("long")).alias("positives"),
            F.avg(F.col(label).cast("double")).alias("positive_rate"),
        )

    return (
        facts(train, "train").unionByName(facts(later, "validation"))
        .withColumn("feature_count", F.lit(len(features)))
        .withColumn("categorical_count", F.lit(texts))
        .withColumn("numeric_count", F.lit(len(features) - texts))
        .withColumn("excluded_count", F.lit(len(train.columns) - len(features)))
    )


def feature_summary(rows: DataFrame, features: list[str]) -> DataFrame:
    """Null rate and mean per feature, and how many rows miss at least one feature."""
    wide = rows.agg(
        *(F.struct(_null_rate(F.col(f)).alias("null_rate"), F.avg(F.col(f).cast("double")).alias("mean")).alias(f) for f in features),
        F.count_if(~all_of(F.col(f).isNotNull() for f in features)).alias("_incomplete"),
    )
    return wide.unpivot(["_incomplete"], features, "feature", "facts").select(
        "feature", "facts.null_rate", "facts.mean", F.col("_incomplete").alias("rows_with_missing")
    )


def score_histogram(rows: DataFrame, score: str, label: str, bins: int = 50) -> DataFrame:
    """Density histogram per label over that label's own score range; empty bins are kept."""
    ranges = rows.groupBy(label).agg(
        F.min(score).alias("low"), F.max(score).alias("high"), F.count(score).alias("n")
    )
    share = (F.col(score) - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    bucket = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    spans = {y: (low, high) for y, low, high, _ in ranges.where(F.col(label).isin(0, 1)).collect()}
    bounds = [
        F.coalesce(*(F.when(F.col(label) == y, F.lit(span[i])) for y, span in spans.items())) for i in (0, 1)
    ]
    counted = (
        rows.where(F.col(score).isNotNull())
        .withColumn("low", bounds[0])
        .withColumn("high", bounds[1])
        .groupBy(label, bucket.alias("bin"))
        .agg(F.count(F.lit(1)).alias("bin_count"))
    )
    frame = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("high") - F.col("low")) / bins
    return frame.join(counted, [label, "bin"], "left").select(
        label,
        "bin",
        (F.col("low") + F.col("bin") * width).alias("bin_start"),
        F.coalesce("bin_count", F.lit(0)).alias("bin_count"),
        ratio(F.coalesce("bin_count", F.lit(0)), F.col("n") * width).alias("density"),
    )


def missingness_flags(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A 0/1 flag per column for a missing value."""
    return rows.select("*", *(F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in columns))


def normalised_categories(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(category(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))
