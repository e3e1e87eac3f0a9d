"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import decontamination, line_dedup, mixing, near_dup, toxicity
from hindcast.llm.common import chosen_once, kept, same_doc, whole_rows


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain does not reject, unchanged."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.fit_chain(docs, labels, ["low_quality", "toxic"])
    return toxicity.score(docs, chain, carry=True).where("not rejected").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that come earlier in the corpus; one that had lines and loses all of them goes."""
    cleaned = line_dedup.drop_repeated_lines(docs).where("n_lines = 0 or n_dropped < n_lines")
    length = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    made = {"text": F.col("text"), "n_chars": length}
    return cleaned.select(*(made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    The one with the smallest (doc_id, hash of the text) stays, null doc_ids last; of rows that repeat both one stays.
    Documents without words are near copies of nothing.
    """
    found = kept(near_dup.near_duplicates(docs, size=5, percent=80, labels=True).groupBy("comp", "doc_id", "h").agg(F.count(F.lit(1)).alias("times")))
    # min() of structs takes null for the smallest, so whether the doc_id is null comes first.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h", "times")).alias("first")
    chosen = found.where("comp is not null").groupBy("comp").agg(first).select("first.doc_id", "first.h", "first.times")
    stay = kept(chosen.union(found.where("comp is null").select("doc_id", "h", "times")))
    return chosen_once(docs, stay).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark (a twentieth of their words inside 13-word matches)."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = kept(decontamination.contamination(docs, benchmark).where("contaminated").select("doc_id", "h").distinct())
    rows = whole_rows(docs)
    return rows.join(bad, same_doc(rows, bad), "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per copy taken of a document, sources weighing 1, 2, 3 in turn and at most tripled."""
    return mixing.mixed(docs, weights=(1, 2, 3), most=3)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

#: The first stage is a fitted model, which SQL cannot express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir))
    return docs
