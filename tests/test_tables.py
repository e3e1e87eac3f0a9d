"""Quality checks, contracts, splits, sources and sinks on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from hindcast.operators import contract, groups, joins, policy, quality, sequence, splits
from hindcast.sources import files, keyed_load, sinks


def small(spark, times, labels=None):
    labels = labels or [i % 2 for i in range(len(times))]
    rows = [(i, t, 1.0 + i, labels[i]) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "txn_id long, t long, amount double, label int")


def test_duplicates_and_order(spark):
    df = small(spark, [5, 4, 6, 6, 1]).withColumn("k", F.floor(F.col("txn_id") / 2))
    found = quality.duplicates(df, "k").first()
    assert found["duplicate_count"] == 4 and found["sample_duplicates"] == ["0", "1"]
    order = quality.monotonic_check(df, "txn_id", "t").first()
    assert not order["is_monotonic"] and order["violation_count"] == 2 and order["sample_violations"] == [4, 1]
    with pytest.raises(ValueError, match="duplicated"):
        joins.one_to_one_left(df.withColumn("txn_id", F.lit(1)), df, "txn_id")


def test_report_fails_on_rules_but_not_on_order(spark):
    df = small(spark, [5, 4, 6]).withColumn("text", F.lit("x"))
    rules = [quality.ColumnRule("amount", "double", above=0.0), quality.ColumnRule("text", "double"), quality.ColumnRule("gone", "int")]
    failed = {(r["check"], r["subject"]) for r in quality.quality_report(df, rules).where("NOT passed").collect()}
    assert failed == {("schema", "text:type"), ("schema", "gone:present")}


def test_differential_missingness_p_value(spark):
    rows = [(0, None)] * 30 + [(0, 1)] * 70 + [(1, None)] * 55 + [(1, 1)] * 45 + [(1, 2)] * 0
    df = spark.createDataFrame(rows, "label int, x int").withColumn("y", F.when(F.col("x") == 1, 1).otherwise(1))
    (got,) = quality.differential_missingness(df, "label", ["x", "y"]).collect()
    gap = max(abs(70 * 55 - 45 * 30) - 100, 0)
    expected = 200 * gap**2 / (115 * 85 * 100 * 100)
    assert got["chi2_statistic"] == pytest.approx(expected)
    assert got["p_value"] == pytest.approx(math.erfc(math.sqrt(expected / 2))) and got["significant"]


def test_group_comparison_edges(spark):
    df = small(spark, [1, 2, 3, 4], [1, 1, 0, 0])
    got = {
        r["comparison"]: r
        for r in groups.compare_groups(
            df,
            "label",
            {
                "plain": (F.col("t") <= 2, F.col("t") > 2),
                "empty": (F.col("t") > 9, F.col("t") <= 9),
                "flat": (F.col("t") == 1, F.col("t") == 2),
                "unknown": (F.lit(None).cast("boolean"), F.col("t") > 2),
            },
        ).collect()
    }
    assert got["plain"]["z_statistic"] == pytest.approx(2.0) and got["plain"]["relative_risk"] is None
    assert got["plain"]["p_value"] == pytest.approx(math.erfc(2 / math.sqrt(2)))
    assert got["empty"]["group_a_rate"] is None and not got["empty"]["significant"]
    assert got["flat"]["z_statistic"] is None and got["flat"]["group_a_ci_upper"] == 1.0
    assert got["unknown"]["group_a_rows"] == 0


@pytest.mark.parametrize("gap", ["none", "late column", "early column"])
def test_contract_takes_shared_dense_columns(spark, gap):
    """Generated columns: every kind at every null share; those above the rule in training drop out."""
    shares = {f"{kind}{i}": i / 4 for kind in ("number", "word") for i in range(5)}

    def made(first, n):
        rows = spark.range(first, first + n).select(F.col("id").alias("txn_id"), F.col("id").alias("t"), (F.col("id") % 3 == 0).cast("int").alias("label"))
        for name, share in shares.items():
            value = F.col("txn_id").cast("double") if name.startswith("number") else F.concat(F.lit("w"), F.col("txn_id") % 7)
            rows = rows.withColumn(name, F.when((F.col("txn_id") - first) >= share * n, value))
        return rows

    train, later = made(0, 40), made(40, 12)
    rules = contract.ContractRules(("txn_id", "t", "label"))
    if gap == "late column":
        with pytest.raises(ValueError, match="lacks"):
            contract.feature_contract(train, later.drop("word1"), rules)
    elif gap == "early column":
        with pytest.raises(ValueError, match="strictly after"):
            contract.feature_contract(train, later.withColumn("t", F.col("t") - 1), rules)
    else:
        agreed = contract.feature_contract(train, later, rules)
        dense = sorted(n for n, share in shares.items() if share < 1)
        assert sorted(agreed.features) == dense
        assert sorted(agreed.numeric) == [n for n in dense if n.startswith("number")]
        assert sorted(agreed.apply(later).columns) == dense
        with pytest.raises(ValueError, match="missing"):
            agreed.apply(later.drop("number2"))


def test_temporal_missingness_keeps_every_sparse_column(spark):
    rows = spark.range(200).select(F.col("id").alias("t"), *(F.when(F.col("id") % (i + 2) != 0, 1).alias(f"c{i}") for i in range(15)), *(F.when(F.col("id") > 20 + i, 1).alias(f"late{i}") for i in range(10)))
    columns = [c for c in rows.columns if c != "t"]
    got = quality.temporal_missingness(rows, "t", columns)
    assert got.select("column").distinct().count() == 25
    assert {r["trend"] for r in got.where("column like 'late%'").collect()} == {"decreasing"}
    assert quality.temporal_missingness(rows, "t", columns, most=3).select("column").distinct().count() == 3
    none = quality.temporal_missingness(rows.select("t", F.lit(1).alias("full")), "t", ["full"])
    assert none.columns == got.columns and none.count() == 0


def test_a_failed_write_keeps_the_old_table(spark, tmp_path):
    path = f"{tmp_path}/replaced"
    sinks.write_replacing(spark.range(10), path)
    broken = spark.range(50).select(F.when(F.col("id") < 49, F.col("id")).otherwise(F.raise_error(F.lit("broken row"))).alias("id"))
    with pytest.raises(Exception, match="broken row"):
        sinks.write_replacing(broken, path)
    assert spark.read.parquet(path).count() == 10
    sinks.write_replacing(spark.read.parquet(path).where("id < 4"), path)  # its own source
    assert spark.read.parquet(path).count() == 4
    with pytest.raises(ValueError, match="at most"):
        sinks.write_json_report(spark.range(sinks.REPORT_ROWS + 1), f"{tmp_path}/report")


def test_a_load_is_published_whole_or_not_at_all(spark, tmp_path):
    path = f"{tmp_path}/loaded"
    rows = spark.range(30).select(F.col("id").alias("txn_id"), F.lit("x").alias("v"))
    first = keyed_load.append_missing(rows.where("txn_id < 20"), path, "txn_id", 20)
    assert (first.offered, first.inserted, first.skipped) == (20, 20, 0)
    broken = rows.withColumn("v", F.when(F.col("txn_id") == 29, F.raise_error(F.lit("broken row"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken row"):
        keyed_load.append_missing(broken, path, "txn_id")
    assert spark.read.parquet(path).count() == 20
    held = sinks.claim(spark, f"{path}.lock", 60)
    assert held
    with pytest.raises(RuntimeError, match="under way"):
        keyed_load.append_missing(rows, path, "txn_id")
    sinks.release(spark, held)
    second = keyed_load.append_missing(rows, path, "txn_id")
    assert (second.inserted, second.skipped) == (10, 20)
    assert keyed_load.append_missing(rows, path, "txn_id").inserted == 0
    assert spark.read.parquet(path).select("txn_id").distinct().count() == spark.read.parquet(path).count() == 30
    (tmp_path / "unreadable").mkdir()
    (tmp_path / "unreadable" / "part-0.parquet").write_bytes(b"not a table")
    with pytest.raises(Exception):
        keyed_load.append_missing(rows, f"{tmp_path}/unreadable", "txn_id")
    assert (tmp_path / "unreadable" / "part-0.parquet").read_bytes() == b"not a table"


def test_fold_rules_differ(spark):
    df = small(spark, [1, 1, 2, 3, 4, 5, 6, 7])

    def sizes(tagged):
        return [r["n"] for r in tagged.groupBy("fold").agg(F.countDistinct("t").alias("n")).orderBy("fold").collect()]

    assert sizes(splits.array_split_folds(df, "t", 5)) == [2, 2, 1, 1, 1]
    assert sizes(splits.proportional_folds(df, "t", 5)) == [2, 1, 2, 1, 1]
    with pytest.raises(ValueError, match="cannot fill"):
        splits.proportional_folds(df, "t", 8)


def test_tie_safe_split(spark):
    early = splits.fraction_split(small(spark, [1, 2, 2, 2, 3]), "t", 0.5).where("period = 'fit'")
    assert early.count() == 1
    tied = small(spark, [1, 1, 1, 2])
    with pytest.raises(ValueError, match="non-empty"):
        splits.fraction_split(tied, "t", 0.5)
    assert splits.fraction_split(tied, "t", 0.5, fall_back=True).where("period = 'fit'").count() == 3


def test_ratio_split_sizes(spark):
    tagged = splits.ratio_split(small(spark, [1, 1, 1, 1, 1, 2, 2, 2, 3, 3]))
    sizes = {r["split"]: r["n"] for r in tagged.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"train": 7, "validation": 1, "test": 2}


def test_sinks_and_loads(spark, tmp_path):
    df = small(spark, [1, 2, 3])
    sinks.write_new(df, f"{tmp_path}/a")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_new(df, f"{tmp_path}/a")
    first = keyed_load.append_missing(df.where("t < 3"), f"{tmp_path}/load", "txn_id")
    again = keyed_load.append_missing(df, f"{tmp_path}/load", "txn_id", expected_rows=3)
    assert (first.inserted, again.inserted, again.skipped) == (2, 1, 2)
    with pytest.raises(ValueError, match="promises"):
        keyed_load.append_missing(df, f"{tmp_path}/load", "txn_id", expected_rows=4)
    with pytest.raises(FileNotFoundError):
        files.fingerprints(spark, f"{tmp_path}/a", ("absent.csv",))
    with pytest.raises(PermissionError):
        files.open_split(spark, str(tmp_path), "test", "training")


def test_csv_needs_declared_columns(spark, tmp_path):
    small(spark, [1, 2]).write.csv(f"{tmp_path}/t", header=True)
    schema = "txn_id long, t long, amount double, label int"
    pair = files.read_pair(spark, f"{tmp_path}/t", schema, f"{tmp_path}/t", schema, ({"t"}, {"label"}))
    assert pair[0].count() == 2
    with pytest.raises(ValueError, match="missing required"):
        files.read_pair(spark, f"{tmp_path}/t", schema, f"{tmp_path}/t", schema, ({"absent"}, set()))


def test_payload_leaves_out_nulls(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3)], "k long, x string, y int")
    assert [r["payload"] for r in files.payload(df, "k").orderBy("k").collect()] == ['{"x":"a"}', '{"y":3}']


def test_append_features_checks_names_and_rows(spark):
    df = small(spark, [1, 2])
    extra = df.select("txn_id", F.lit(1).alias("f"))
    assert joins.append_features(df, extra, "txn_id").columns[-1] == "f"
    with pytest.raises(ValueError, match="already exist"):
        joins.append_features(df, df.select("txn_id", "t"), "txn_id")
    with pytest.raises(ValueError, match="infinite"):
        joins.append_features(df, df.select("txn_id", F.lit(float("inf")).alias("f")), "txn_id")
    with pytest.raises(ValueError, match="pair up"):
        joins.append_features(df, extra.where("txn_id = 0"), "txn_id")


def test_runs_must_agree(spark):
    runs = spark.createDataFrame([("a", 10, None), ("b", 10, None), ("c", 11, "x")], "run string, n int, v string")
    joins.require_comparable(runs, "b", "a", ["n", "v"])
    with pytest.raises(ValueError, match="n 10 against 11"):
        joins.require_comparable(runs, "c", "a", ["n", "v"])


def test_label_guards(spark):
    df = small(spark, [1, 2], [0, 0])
    policy.require_labels(df, "label", both=False)
    with pytest.raises(ValueError, match="both classes"):
        policy.require_labels(df, "label")
    with pytest.raises(ValueError, match="only"):
        policy.require_labels(df.withColumn("label", F.lit(2)), "label")


def test_sequence_input_guards(spark):
    df = small(spark, [1, 2]).withColumn("card", F.lit(1))
    assert sequence.sequences(df, 3).count() == 2
    for broken, word in (
        (df.withColumn("amount", F.lit(-1.0)), "negative_amounts"),
        (df.withColumn("t", F.lit(None).cast("long")), "null_times"),
        (df.withColumn("txn_id", F.lit(1)), "repeated_keys"),
        (df.withColumn("label", F.lit(5)), "bad_labels"),
        (df.limit(0), "empty"),
        (df.drop("card"), "card"),
    ):
        with pytest.raises(ValueError, match=word):
            sequence.sequences(broken, 3)
    with pytest.raises(ValueError, match="length 2"):
        sequence.sequences(df, 1)


def test_a_crashed_load_gives_way(spark, tmp_path, monkeypatch):
    rows, path = spark.range(20).withColumnRenamed("id", "txn_id"), f"{tmp_path}/table"
    lock = f"{path}.lock"
    crashed = sinks.claim(spark, lock, 60)
    assert sinks.claim(spark, lock, 60) is None and sinks.holds(spark, crashed)
    assert keyed_load.append_missing(rows.where("txn_id < 5"), path, "txn_id", lease=0).inserted == 5
    assert not sinks.holds(spark, crashed)
    sinks.release(spark, crashed)  # a late release of the old lease changes nothing
    follower = sinks.claim(spark, lock, 60)
    assert follower and sinks.claim(spark, lock, 60) is None
    sinks.release(spark, follower)

    def slow(*args):
        sinks.claim(spark, lock, 0)  # another load takes over before this one publishes
        return missing(*args)

    missing = keyed_load.missing_rows
    monkeypatch.setattr(keyed_load, "missing_rows", slow)
    with pytest.raises(RuntimeError, match="longer than its lease"):
        keyed_load.append_missing(rows, path, "txn_id")
    assert spark.read.parquet(path).count() == 5
