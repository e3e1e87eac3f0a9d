"""Which columns may enter a model, decided on the training rows alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.scalars import any_of
from hindcast.operators.quality import duplicates, null_rates
from hindcast.operators.splits import require_temporal_order
from hindcast.roles import Roles


@dataclass(frozen=True)
class ContractRules:
    mandatory: tuple[str, ...] = ()
    listed: tuple[str, ...] = ()
    manual: tuple[str, ...] = ()
    max_null_rate: float = 0.95


def exclusions(train: DataFrame, rules: ContractRules) -> DataFrame:
    """Every training column with its null rate and the reason it is left out, if any."""
    rates = null_rates(train, threshold=rules.max_null_rate)
    column = F.col("column")
    reason = (
        F.when(column.isin(list(rules.mandatory)), F.lit("mandatory"))
        .when(column.isin(list(rules.listed)), F.lit("listed"))
        .when(column.isin(list(rules.manual)), F.lit("manual"))
        .when(F.col("above_threshold"), F.lit("null_rate"))
    )
    return rates.select("column", "null_rate", reason.alias("reason"))


def column_kinds(rows: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    """Numeric and other columns; a boolean counts as a number."""
    kinds = dict(rows.dtypes)
    numeric = [c for c in columns if kinds[c] == "boolean" or kinds[c].startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))]
    return numeric, [c for c in columns if c not in numeric]


@dataclass(frozen=True)
class FeatureContract:
    features: tuple[str, ...]
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]

    def apply(self, rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """The expected features in contract order; a missing one is an error, others are dropped."""
        missing = [f for f in self.features if f not in rows.columns]
        if missing:
            raise ValueError(f"expected features are missing: {missing}")
        return rows.select(*keep, *self.features)


def feature_contract(
    train: DataFrame, later: DataFrame, rules: ContractRules, roles: Roles = Roles()
) -> FeatureContract:
    """Check both splits and derive the sorted feature list from the training rows."""
    for name, df in (("training", train), ("validation", later)):
        _check_table(df, name, roles)
    require_temporal_order(train, later, roles.time)
    absent = sorted(set(train.columns) - set(later.columns))
    if absent:
        raise ValueError(f"validation data lacks training columns: {absent}")
    left_out = {r["column"] for r in exclusions(train, rules).where("reason IS NOT NULL").collect()}
    features = sorted(set(train.columns) - left_out)
    if not features:
        raise ValueError("no feature remains after the exclusions")
    numeric, other = column_kinds(train, features)
    return FeatureContract(tuple(features), tuple(numeric), tuple(other))


def _check_table(rows: DataFrame, name: str, roles: Roles) -> None:
    missing = [c for c in (roles.key, roles.time, roles.label) if c not in rows.columns]
    if missing:
        raise ValueError(f"{name} data lacks required columns: {missing}")
    label = F.col(roles.label)
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(roles.key).isNull()).alias("null_keys"),
        F.count_if(F.col(roles.time).isNull()).alias("null_times"),
        F.count_if(any_of([(label != 0) & (label != 1)])).alias("bad_labels"),
    ).first()
    if facts["n"] == 0:
        raise ValueError(f"{name} data is empty")
    for fact in ("null_keys", "null_times", "bad_labels"):
        if facts[fact]:
            raise ValueError(f"{name} data has {facts[fact]} {fact.replace('_', ' ')}")
    repeated = duplicates(rows, roles.key).first()["duplicate_count"]
    if repeated:
        raise ValueError(f"{name} data has {repeated} rows with a duplicate key")


def require_columns(rows: DataFrame, required: set[str], name: str) -> None:
    missing = sorted(set(required) - set(rows.columns))
    if missing:
        raise ValueError(f"{name} is missing required columns: {', '.join(missing)}")
