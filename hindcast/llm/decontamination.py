"""Benchmark decontamination with a distributed positional inverted index, DataFrame operations only.

The index holds postings (term, document, position) of the rarest terms of the test items: a phrase can only occur where
its rarest terms do, at the right distances. Lists are shifted by the offset of their term in the item, so that all terms
of one occurrence meet in one (document, item, shift), and intersected there. What survives is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hindcast.llm.common import kept, keyed, same_doc

#: Fixed by the contract: A-Z fall to a-z, and a word is a run of characters outside these ASCII ranges.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables made from the test items are broadcast up to so many words in all (some ten MB), and join by shuffle beyond.
BROADCAST_WORDS = 500_000


def words_of(text: Column) -> Column:
    """Lower-cased words in order; an empty array for null."""
    parts = F.split(F.translate(text, UPPER, LOWER), BREAKS)
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def _sized(table: DataFrame, words: Column | None = None) -> DataFrame:
    """``table`` to be broadcast if its rows, or the words it holds, are few enough; the result is the same either way."""
    total = table.agg(F.coalesce(F.sum(F.lit(1) if words is None else words), F.lit(0))).first()[0]
    return F.broadcast(table) if total <= BROADCAST_WORDS else table.hint("merge")


def item_terms(benchmark: DataFrame) -> DataFrame:
    """item, item_id, n, at, term: every word of every distinct item; ``item`` tells apart texts that share an item_id."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    items = items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", words_of(F.col("text")).alias("words"))
    return items.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("at", "term"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, h, term, pos of every occurrence of the given terms (one row a term)."""
    all_words = keyed(docs).select("doc_id", "h", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return all_words.join(_sized(terms), "term")


def rarest_places(terms: DataFrame, docs: DataFrame, window: int, lists: int) -> DataFrame:
    """item, item_id, start, at, term: the places of each window whose terms are rarest in the documents.

    Frequencies are counted over all documents. Every window gets ``lists`` places, fewer if it is shorter.
    """
    vocabulary = terms.select("term").distinct()
    counted = keyed(docs).select(F.explode(words_of(F.col("text"))).alias("term"))
    counts = counted.join(_sized(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("uses"))
    width = F.least(F.col("n"), F.lit(window))
    placed = terms.join(counts, "term").withColumn("width", width)
    # A term without any occurrence has no row here: its windows stay short of places and cannot match.
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("width") + 1), F.least(F.col("at"), F.col("n") - F.col("width")))
    spread = placed.withColumn("start", F.explode(starts))
    full = spread.withColumn("present", F.count(F.lit(1)).over(Window.partitionBy("item", "start"))).where("present = width")
    order = Window.partitionBy("item", "start").orderBy("uses", "at")
    return full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= lists).select("item", "item_id", "start", "at", "term")


def candidate_shifts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, h, item, shift, starts: windows of an item all of whose rarest terms stand at one shift in a document."""
    index = kept(postings(docs, places.select("term").distinct()))
    sites = places.select("item", "at", "term").distinct()
    adjusted = index.join(_sized(sites), "term").select("doc_id", "h", "item", (F.col("pos") - F.col("at")).alias("shift"), "at")
    met = adjusted.groupBy("doc_id", "h", "item", "shift").agg(F.collect_set("at").alias("met"))
    windows = places.groupBy("item", "start").agg(F.collect_set("at").alias("needed"))
    windows = windows.groupBy("item").agg(F.collect_list(F.struct("start", "needed")).alias("windows"), F.min(F.size("needed")).alias("least"))
    near = met.join(_sized(windows), "item").where(F.size("met") >= F.col("least"))
    whole = F.filter("windows", lambda w: (w["start"] + F.col("shift") >= 0) & (F.size(F.array_except(w["needed"], F.col("met"))) == 0))
    starts = F.array_sort(F.transform(whole, lambda w: w["start"]))
    return near.select("doc_id", "h", "item", "shift", starts.alias("starts")).where(F.size("starts") > 0)


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, lists: int = 2) -> DataFrame:
    """doc_id, h, n_words, hits: one row per document row; hits is an array of (item_id, pos, width), one per exact occurrence.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Null and
    empty texts have no words and no windows. Repeated items count once, repeated documents each; extra columns are
    ignored. A null doc_id or item_id is kept as it is.
    """
    terms = kept(item_terms(benchmark))
    places = kept(rarest_places(terms, docs, window, lists))
    phrases = terms.groupBy("item", "item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("phrase"))
    found = candidate_shifts(docs, places).join(_sized(phrases), "item")
    sought = found.groupBy("doc_id", "h").agg(F.collect_list(F.struct("item_id", "shift", "starts", "phrase")).alias("sought"))
    sought = _sized(kept(sought), F.aggregate("sought", F.lit(0), lambda n, one: n + F.size(one["phrase"]) + F.size(one["starts"])))
    rows = keyed(docs)
    joined = rows.join(sought, same_doc(rows, sought), "left").select(rows["doc_id"], rows["h"], words_of(rows["text"]).alias("words"), sought["sought"])

    def exact(words: Column, one: Column) -> Column:
        width = F.least(F.size(one["phrase"]), F.lit(window))
        same = F.filter(one["starts"], lambda s: F.slice(words, one["shift"] + s + 1, width) == F.slice(one["phrase"], s + 1, width))
        return F.transform(same, lambda s: F.struct(one["item_id"].alias("item_id"), (one["shift"] + s).alias("pos"), width.alias("width")))

    hits = F.coalesce(F.flatten(F.transform(F.col("sought"), lambda one: exact(F.col("words"), one))), F.array())
    return joined.select("doc_id", "h", F.size("words").alias("n_words"), hits.alias("hits"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, slop: int = 3, lists: int = 3) -> DataFrame:
    """doc_id, item_id, start, first_pos, last_pos: the ``lists`` rarest terms of a window stand near one another.

    All of them must lie within ``slop`` words of their places in the item, in one document; words between may differ.
    Terms are compared shift by shift, so a match costs its own postings and not the text.
    """
    places = kept(rarest_places(kept(item_terms(benchmark)), docs, window, lists))
    index = kept(postings(docs, places.select("term").distinct()))
    sites = places.select("item", "item_id", "start", "at", "term")
    shifted = index.join(_sized(sites), "term").withColumn("shift", F.col("pos") - F.col("at"))
    # Every run of shifts no wider than slop begins at one posting's shift; each posting serves the runs that reach it.
    runs = shifted.withColumn("run", F.explode(F.sequence(F.col("shift") - slop, F.col("shift"))))
    met = runs.groupBy("doc_id", "h", "item", "item_id", "start", "run").agg(F.count_distinct("at").alias("met"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    needed = places.groupBy("item", "start").agg(F.count(F.lit(1)).alias("needed"))
    near = met.join(_sized(needed), ["item", "start"]).where("met = needed")
    return near.select("doc_id", "item_id", "start", "first_pos", "last_pos").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, lists: int = 2) -> DataFrame:
    """doc_id, h, n_words, n_hit, items, contaminated (n_hit > 0 and share * n_hit >= n_words); one row per document row.

    A word inside any occurrence of a window is hit, once. ``items`` are the distinct item_ids as sorted strings; a null
    item_id counts words but has no name to list.
    """
    matched = phrase_matches(docs, benchmark, window, lists)
    spans = F.array_sort(F.transform("hits", lambda x: F.struct(x["pos"].alias("from"), (x["pos"] + x["width"]).alias("to"))))
    # Spans in order of their start: each adds what reaches beyond all before it.
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
    step = lambda acc, x: F.struct((acc["hit"] + F.greatest(F.lit(0), x["to"] - F.greatest(acc["end"], x["from"]))).alias("hit"), F.greatest(acc["end"], x["to"]).alias("end"))
    n_hit = F.aggregate(spans, start, step, lambda acc: acc["hit"])
    items = F.array_compact(F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["item_id"].cast("string")))))
    out = matched.select("doc_id", "h", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), items.alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
