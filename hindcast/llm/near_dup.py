"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of a universe of 2^20 places are enough for any number of signature coordinates: the first scatters the
shingles of a document, the second, shifted circularly by k places, gives coordinate k (its minimum over the document's
places). Equal bands of coordinates propose candidates; links are decided on the full shingle sets.

Only components are wanted, so a bucket never emits all of its pairs. Buckets that share members have one hub as their
reference, and members are compared with that first. What is left are pairs in different components, and these are found by
exact bounds against the reference (the hub, and every shingle that many of its members have beside it). Two sets share at
most as much of the reference as the smaller of their own shares of it. If that does not reach the threshold, they must have a
rare shingle in common, and then one among the first fifth of their shingles, rare ones first; if it does, they meet by their
sizes within a bucket. Before any text is fetched for a comparison, four bits of every coordinate are compared: a pair whose
agreement lies five standard deviations below that of a pair at the threshold is no link.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm.common import WordHashes, kept, keyed, mix, ngrams, packed, pieces, same_doc, shape, signed, split_all, texts_of

UNIVERSE = 1 << 20
#: Bits kept of a coordinate for the comparison of pairs; unrelated coordinates agree in them with chance 1/16.
SKETCH_BITS = 4

#: A shingle that more of a reference's members have than these belongs to the reference. Any number gives the same links.
COMMON = 32
#: Rows of shingles that a worker hands over at once.
HANDED = 200_000


@lru_cache(maxsize=2)
def permutations(coordinates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and the shifted one continued circularly far enough for the largest shift."""
    draw = np.random.default_rng(seed)
    first = draw.permutation(UNIVERSE).astype(np.uint32)
    second = draw.permutation(UNIVERSE).astype(np.uint32)
    return first, np.concatenate([second, second[:coordinates]])


def shingle_sets(texts: list[bytes | None], size: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and where each text's set begins (one more at the end)."""
    words, starts = split_all(texts, lower=True)
    grams = ngrams(hashes.of(words), size)[0]
    sets = []
    for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if high - low >= size:
            own = np.sort(grams[low : high - size + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif high > low:  # fewer words: the whole sequence is the one shingle
            sets.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words[low:high]), high - low)], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), np.cumsum([0, *map(len, sets)])


def _bands(shingles: np.ndarray, starts: np.ndarray, bands: int, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each nonempty set (rows) a key for each band, and SKETCH_BITS of every coordinate, sixteen to a long."""
    first, second = permutations(bands * rows, seed)
    places = first[(shingles & np.uint64(UNIVERSE - 1)).astype(np.intp)].astype(np.intp)
    keys = np.empty((len(starts), bands), np.uint64)
    sketch = np.zeros((len(starts), sketch_longs(bands * rows)), np.uint64)
    taken = np.empty(len(places), np.uint32)
    per_long = 64 // SKETCH_BITS
    for band in range(bands):
        key = np.full(len(starts), band, np.uint64)
        for shift in range(band * rows, (band + 1) * rows):
            np.take(second[shift : shift + UNIVERSE], places, out=taken, mode="clip")
            least = np.minimum.reduceat(taken, starts).astype(np.uint64)
            key = mix(key, least)
            low = mix(least, least) & np.uint64((1 << SKETCH_BITS) - 1)
            sketch[:, shift // per_long] |= low << np.uint64(shift % per_long * SKETCH_BITS)
        keys[:, band] = key
    return keys, sketch


def sketch_longs(coordinates: int) -> int:
    return -(-coordinates * SKETCH_BITS // 64)


def _may_link(a: str, b: str, coordinates: int, percent: int) -> Column:
    """Whether so many coordinates agree in their bits that the sets may reach the threshold."""
    agree = percent / 100 + (1 - percent / 100) / (1 << SKETCH_BITS)
    least = agree - 5 * math.sqrt(agree * (1 - agree) / coordinates)

    def differing(i: int) -> Column:
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    total = reduce(lambda p, q: p + q, (differing(i) for i in range(sketch_longs(coordinates))))
    return total <= math.floor(coordinates * (1 - least))


def signatures(docs: DataFrame, size: int, bands: int, rows: int, seed: int) -> DataFrame:
    """doc_id, h, n (shingles), node (hash of the set, null if empty), bands, sketch."""

    longs = sketch_longs(bands * rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(seed)
        for batch in batches:
            texts = texts_of(batch)
            for low, high in pieces(texts):
                shingles, starts = shingle_sets(texts[low:high], size, hashes)
                n = np.diff(starts)
                full = np.flatnonzero(n)
                node = np.zeros(high - low, np.uint64)
                keys, sketch = np.empty((0, bands), np.uint64), np.empty((0, longs), np.uint64)
                if len(full):
                    begins = starts[:-1][full]
                    mixed = mix(shingles, shingles)
                    node[full] = mix(mix(np.add.reduceat(mixed, begins), np.bitwise_xor.reduceat(mixed, begins)), n[full].astype(np.uint64))
                    keys, sketch = _bands(shingles, begins, bands, rows, seed)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * x.shape[1])]).astype(np.int32)), signed(x.ravel())) for x in (keys, sketch)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        batch.column(1).slice(low, high - low),
                        pa.array(n.astype(np.int64)),
                        pa.array(node.view(np.int64), mask=n == 0),
                        *lists,
                    ],
                    names=["doc_id", "h", "n", "node", "bands", "sketch"],
                )

    rows_in = keyed(docs).select("doc_id", "h", "text")
    return rows_in.mapInArrow(scan, shape(rows_in, "doc_id", "h", n="long", node="long", bands="array<bigint>", sketch="array<bigint>"))


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable over links (a, b), for every node that has a link.

    Each round takes the smallest label among the neighbours and then the label's own label, so long chains shorten
    quickly; every round is written to the shared folder.
    """
    both = kept(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = kept(both.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        target = hooked.select(F.col("node").alias("t"), F.col("to").alias("jump"))
        moved = kept(hooked.join(target, hooked["to"] == target["t"]).select("node", F.col("jump").alias("comp"), (F.col("jump") != F.col("was")).alias("changed")))
        labels = moved.select("node", "comp")
        if moved.where("changed").isEmpty():
            return labels


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int, seed: int) -> DataFrame:
    """The pairs (a, b) with 100 * |intersection| >= percent * |union| on full shingle sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpack = WordHashes(seed), zstandard.ZstdDecompressor()
        last, last_set = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            linked = []
            for i in range(len(a)):
                if b[i] != last:  # rows come sorted by b from the join, mostly
                    last, last_set = b[i], shingle_sets([unpack.decompress(tb[i])], size, hashes)[0]
                own = shingle_sets([unpack.decompress(ta[i])], size, hashes)[0]
                common = len(np.intersect1d(own, last_set, assume_unique=True))
                linked.append(100 * common >= percent * (len(own) + len(last_set) - common))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    of_a = texts.select(F.col("node").alias("a"), F.col("packed").alias("text_a"))
    of_b = texts.select(F.col("node").alias("b"), F.col("packed").alias("text_b"))
    full = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 50, rows: int = 6, seed: int = 7, labels: bool = False) -> DataFrame:
    """doc_id, h, n_shingles, component_id, kept: one row per document row; extra columns are ignored.

    ``labels`` adds comp, the component's smallest node (null where the set is empty): unlike component_id it tells apart
    components whose doc_ids are null or shared.

    A document's set holds its distinct ``size``-word shingles; with fewer words the whole sequence is one, and without
    words (null, empty or blank text) the set is empty and linked with nothing. Documents are linked when
    100 * |intersection| >= percent * |union|; component_id is the smallest doc_id reachable, kept says it is the row's
    own. Equal sets are one class and compared once. Null doc_ids never become a component_id unless the component has no
    other; then all its rows are kept. With 50 bands of 6 rows a pair at similarity 0.8 is missed with chance 2.4e-7, and by
    the bits with 2.9e-7.
    """
    scanned = kept(signatures(docs, size, bands, rows, seed))
    full = scanned.where("n > 0")
    nodes = kept(full.groupBy("node").agg(*(F.first(c).alias(c) for c in ("doc_id", "h", "n", "bands", "sketch"))))

    buckets = nodes.select("node", F.explode("bands").alias("key"))
    crowded = kept(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    members = kept(buckets.join(crowded, "key"))
    # The hub of a bucket is its member with the most company over all bands: among edited copies that is the text they
    # were made from, which is nearer to each of them than they are to one another.
    company = kept(members.groupBy("node").agg(F.sum("members").alias("company")))
    hub = kept(members.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node")).alias("top")))
    wanted = kept(nodes.join(members.select("node").distinct(), "node").select("node", "doc_id", "h", "n", "bands", "sketch"))
    rows_in = packed(docs)
    found = rows_in.join(wanted, same_doc(rows_in, wanted)).select(wanted["node"], rows_in["packed"])
    texts = kept(found.dropDuplicates(["node"]))  # a document row may be repeated

    def likely(a: str, b: str) -> Column:
        sizes = F.least(f"n_{a}", f"n_{b}") * 100 >= F.greatest(f"n_{a}", f"n_{b}") * percent
        return sizes & _may_link(f"sketch_{a}", f"sketch_{b}", bands * rows, percent)

    def compared(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that may be links."""
        for side in ("a", "b"):
            pairs = pairs.join(wanted.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
        return kept(pairs.where(likely("a", "b")).select("a", "b"))

    # Each member with its references first: so most of a family hangs together, by one comparison or few for each member.
    refs = _references(members, hub)
    hubs = members.join(refs, "key").where("node != ref")
    tested = compared(hubs.select(F.greatest("node", "ref").alias("a"), F.least("node", "ref").alias("b")).distinct())
    links = kept(_verified(tested, texts, size, percent, seed))
    comps = components(links)
    placed = _placed(members, comps, refs)
    parts = _shares(placed, texts, size, seed)
    left = _by_rare_shingles(parts, percent).union(_by_sizes(placed, parts, wanted, percent, likely)).distinct()
    more = kept(compared(left).join(tested, ["a", "b"], "left_anti"))
    found = kept(_verified(more, texts, size, percent, seed))
    if not found.isEmpty():
        comps = components(links.union(found))

    placed = full.join(comps, "node", "left").select("doc_id", "h", "n", F.coalesce("comp", "node").alias("comp"))
    smallest = kept(placed.groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    named = placed.join(smallest, "comp").select("doc_id", "h", "n", "component_id", "comp")
    alone = scanned.where("n = 0").select("doc_id", "h", "n", F.col("doc_id").alias("component_id"), F.col("node").alias("comp"))
    out = ["doc_id", "h", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")]
    return named.union(alone).select(*out, *(["comp"] if labels else []))


def _references(members: DataFrame, hub: DataFrame) -> DataFrame:
    """key, ref: the hub with the most company among those of all buckets that share a member with this one."""
    best = kept(members.join(hub, "key").groupBy("node").agg(F.max("top").alias("top")))
    return kept(members.join(best, "node").groupBy("key").agg(F.max("top").alias("top")).select("key", F.col("top.node").alias("ref")))


def _placed(members: DataFrame, comps: DataFrame, refs: DataFrame) -> DataFrame:
    """key, node, comp, main, ref: the members of buckets that hold several components, and the largest of these."""
    placed = members.join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
    mains = sizes.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    return kept(placed.join(kept(mains.join(refs, "key").select("key", F.col("top.comp").alias("main"), "ref")), "key"))


class Shares(NamedTuple):
    """How sets lie to their references."""

    #: node, ref, n, share (how many of its shingles are the reference's), alone (how many no other component has)
    own: DataFrame
    #: node, ref, comp, shingle, times: shingles beside the reference that several components have, by how many members
    rare: DataFrame


def _shares(placed: DataFrame, texts: DataFrame, size: int, seed: int) -> Shares:
    """The sets of members against their references; shingles that more than COMMON members have join the reference."""
    sides = placed.select("node", "ref", "comp").distinct()
    beside = kept(_beside(sides, texts, size, seed))
    several = beside.where("shingle is not null").groupBy("ref", "shingle")
    several = several.agg(F.count(F.lit(1)).alias("times"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    met = kept(beside.join(kept(several.drop("low", "high")), ["ref", "shingle"]))
    parts = met.groupBy("node", "ref").agg(F.count_if(F.col("times") > COMMON).alias("common"), F.count(F.lit(1)).alias("met"))
    heads = beside.where("shingle is null").join(parts, ["node", "ref"], "left").na.fill(0, ["common", "met"])
    own = heads.select("node", "ref", (F.col("inside") + F.col("outside")).alias("n"), (F.col("inside") + F.col("common")).alias("share"), (F.col("outside") - F.col("met")).alias("alone"))
    return Shares(kept(own), met.where(F.col("times") <= COMMON).select("node", "ref", "comp", "shingle", "times"))


def _beside(sides: DataFrame, texts: DataFrame, size: int, seed: int) -> DataFrame:
    """node, ref, comp, inside, outside (shingles in the reference and beside it), shingle: a row for each one beside it, and one with null."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpack = WordHashes(seed), zstandard.ZstdDecompressor()
        last, of_ref = None, np.empty(0, np.uint64)
        for batch in batches:
            facts, found, held = [], [], 0
            for node, ref, comp, text, ref_text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if ref != last:
                    last, of_ref = ref, shingle_sets([unpack.decompress(ref_text)], size, hashes)[0]
                own = shingle_sets([unpack.decompress(text)], size, hashes)[0]
                other = np.setdiff1d(own, of_ref, assume_unique=True)
                facts.append((node, ref, comp, len(own) - len(other), len(other)))
                found.append(other)
                held += len(other) + 1
                if held >= HANDED:
                    yield table(facts, found)
                    facts, found, held = [], [], 0
            if facts:
                yield table(facts, found)

    def table(facts: list[tuple[int, ...]], found: list[np.ndarray]) -> pa.RecordBatch:
        times = [len(f) + 1 for f in found]
        heads = np.zeros(sum(times), bool)
        heads[np.cumsum([0, *times[:-1]])] = True
        shingles = np.zeros(len(heads), np.int64)
        shingles[~heads] = np.concatenate(found).view(np.int64)
        columns = [pa.array(np.repeat(np.array(c, np.int64), times)) for c in zip(*facts, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(shingles, mask=heads)], names=["node", "ref", "comp", "inside", "outside", "shingle"])

    of_ref = texts.select(F.col("node").alias("ref"), F.col("packed").alias("ref_text"))
    full = sides.join(texts, "node").join(of_ref, "ref").select("node", "ref", "comp", "packed", "ref_text")
    return full.mapInArrow(look, "node long, ref long, comp long, inside long, outside long, shingle long")


def _by_rare_shingles(parts: Shares, percent: int) -> DataFrame:
    """Pairs (a > b) of different components with a rare shingle in common, among the first of both.

    A link shares percent of either set's n shingles. In one order for all sets (those of one component, then rare before
    frequent, then the reference's) the first shared one therefore lies among the first n - percent of n + 1. A shingle has
    COMMON members at most here, so the pairs grow with the members.
    """
    order = Window.partitionBy("node", "ref").orderBy("times", "shingle")
    ranked = parts.rare.withColumn("place", F.row_number().over(order)).join(parts.own, ["node", "ref"])
    first = kept(ranked.where(F.expr(f"alone + place <= n - (n * {percent} + 99) div 100 + 1")).select("node", "ref", "comp", "shingle", "n"))
    x, y = (first.select("ref", "shingle", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "comp", "n"))) for side in "xy")
    pairs = x.join(y, ["ref", "shingle"]).where(f"node_x > node_y and comp_x != comp_y and least(n_x, n_y) * 100 >= greatest(n_x, n_y) * {percent}")
    return pairs.select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))


def _by_sizes(placed: DataFrame, parts: Shares, wanted: DataFrame, percent: int, likely: Callable[[str, str], Column]) -> DataFrame:
    """Pairs (a > b) of a bucket and different components that may be links by what they share of the reference alone.

    A share s reaches the threshold beside sets of at most s * (100 + percent) / percent - n shingles. A member outside of
    the reference's component has a limit below the reference's own size, so only families of smaller sets have such pairs.
    Both bounds hold in every bucket that a pair shares, so it is enough to look here in the first of them.
    """
    limit = F.expr(f"(share * {100 + percent}) div {percent} - n")
    rows = kept(placed.join(parts.own, ["node", "ref"]).select("key", "node", "comp", "main", "n", limit.alias("most")))
    bounds = rows.groupBy("key").agg(F.min("n").alias("least_n"), F.max(F.expr("CASE WHEN comp != main THEN most END")).alias("most_n"))
    bounded = rows.join(kept(bounds), "key").where("n <= most_n or (comp != main and most >= least_n)")
    able = kept(bounded.join(wanted.select("node", "bands", "sketch"), "node"))
    columns = ("node", "comp", "n", "most", "bands", "sketch")
    x = able.where("comp != main and most >= least_n").select("key", *(F.col(c).alias(f"{c}_x") for c in columns))
    y = able.where("n <= most_n").select("key", "main", *(F.col(c).alias(f"{c}_y") for c in columns))
    fits = F.expr("comp_x != comp_y and (comp_y = main or node_x < node_y) and n_y <= most_x and n_x <= most_y")
    first_shared = F.array_intersect("bands_x", "bands_y")[0] == F.col("key")
    pairs = x.join(y, "key").where(fits & likely("x", "y") & first_shared)
    return pairs.select(F.greatest("node_x", "node_y").alias("a"), F.least("node_x", "node_y").alias("b"))
