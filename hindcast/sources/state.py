"""Fitted state on disk: small facts as one JSON line, tables as Parquet, Spark ML models by their own writer.

A saved state is a folder that must not exist yet, so what was fitted once stays what it is.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import SparkSession

from hindcast.operators.anomaly import Forests, ForestSettings
from hindcast.operators.calibration import Calibrator
from hindcast.operators.encoding import EncoderSettings, FittedEncoder
from hindcast.operators.modelling import Preprocessor, Scaling
from hindcast.roles import Roles


def _write_facts(spark: SparkSession, path: str, facts: dict) -> None:
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.text(f"{path}/facts")


def _read_facts(spark: SparkSession, path: str, kind: str) -> dict:
    facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
    if facts["kind"] != kind:
        raise ValueError(f"{path} holds a {facts['kind']}, not a {kind}")
    return facts


def save_calibrator(spark: SparkSession, fitted: Calibrator, path: str) -> None:
    if not fitted.fitted:
        raise RuntimeError("only a fitted calibrator can be saved")
    line = list(fitted.model) if fitted.method == "sigmoid" else None
    _write_facts(spark, path, {"kind": "calibrator", "method": fitted.method, "epsilon": fitted.epsilon, "roles": asdict(fitted.roles), "line": line})
    if fitted.method == "isotonic":
        fitted.model.write.parquet(f"{path}/model")


def load_calibrator(spark: SparkSession, path: str) -> Calibrator:
    facts = _read_facts(spark, path, "calibrator")
    model = spark.read.parquet(f"{path}/model") if facts["method"] == "isotonic" else facts["line"] and tuple(facts["line"])
    return Calibrator(facts["method"], Roles(**facts["roles"]), facts["epsilon"], model, True)


def save_encoder(spark: SparkSession, fitted: FittedEncoder, path: str) -> None:
    _write_facts(spark, path, {"kind": "encoder", "settings": asdict(fitted.settings), "global_rate": fitted.global_rate})
    fitted.mapping.write.parquet(f"{path}/mapping")


def load_encoder(spark: SparkSession, path: str) -> FittedEncoder:
    facts = _read_facts(spark, path, "encoder")
    settings = facts["settings"] | {"columns": tuple(facts["settings"]["columns"])}
    return FittedEncoder(EncoderSettings(**settings), spark.read.parquet(f"{path}/mapping"), facts["global_rate"])


def save_preprocessor(spark: SparkSession, fitted: Preprocessor, path: str) -> None:
    scaling = {c: asdict(s) for c, s in fitted.scaling.items()}
    _write_facts(spark, path, {"kind": "preprocessor", "numeric": fitted.numeric, "categorical": fitted.categorical, "scaling": scaling, "modes": fitted.modes, "widths": fitted.widths})
    if fitted.dictionary is not None:
        fitted.dictionary.write.parquet(f"{path}/dictionary")


def load_preprocessor(spark: SparkSession, path: str) -> Preprocessor:
    facts = _read_facts(spark, path, "preprocessor")
    scaling = {c: Scaling(**s) for c, s in facts["scaling"].items()}
    dictionary = spark.read.parquet(f"{path}/dictionary") if facts["categorical"] else None
    return Preprocessor(facts["numeric"], facts["categorical"], scaling, facts["modes"], dictionary, facts["widths"])


def save_forests(spark: SparkSession, fitted: Forests, path: str) -> None:
    """The node table is bounded by forests, trees and their samples."""
    facts = {"kind": "forests", "features": fitted.features, "settings": asdict(fitted.settings)}
    facts |= {"medians": {str(f): m for f, m in fitted.medians.items()}, "offsets": {str(f): o for f, o in fitted.offsets.items()}}
    _write_facts(spark, path, facts)
    spark.createDataFrame(fitted.nodes).coalesce(1).write.parquet(f"{path}/nodes")


def load_forests(spark: SparkSession, path: str) -> Forests:
    facts = _read_facts(spark, path, "forests")
    medians = {int(f): m for f, m in facts["medians"].items()}
    offsets = {int(f): o for f, o in facts["offsets"].items()}
    return Forests(facts["features"], ForestSettings(**facts["settings"]), medians, spark.read.parquet(f"{path}/nodes").toPandas(), offsets)
