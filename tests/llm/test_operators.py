"""Each operator against a plain Python version of its contract, on small tables with every awkward row."""

import hashlib
import math
import random
import tracemalloc

import numpy as np
import pytest
from brute import brute_components, brute_contamination, brute_lines, edits, in_order, repeated_mask, words_of
from hindcast.llm import ann, common, decontamination, graph_dedup, html_text, line_dedup, mixing, near_dup, spans, suffix_dedup, toxicity, warc
from hindcast.llm.common import ngrams, shared_folder, sliding_min, split_all

SCHEMA = "doc_id long, text string, source string, h string, row int, packed int, n int, n_chars long"


def corpus(seed: int, n: int = 60) -> list[tuple]:
    """Random documents with copies, edited copies, shared passages, periodic texts, blanks and repeated rows."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "a b", "x\u0085y", "ſ", "K"]
    prose = lambda k: [draw.choice(vocabulary) for _ in range(k)]
    passage, base, rows = prose(60), prose(150), []
    for i in range(n):
        kind = draw.randrange(9)
        if kind == 0:
            words = base[:]
        elif kind == 1:
            words = base[:]
            for _ in range(draw.randrange(1, 14)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
        elif kind == 2:
            cut = draw.randrange(20, 61)
            words = prose(draw.randrange(30)) + passage[:cut] + prose(draw.randrange(30))
        elif kind == 3:
            words = prose(draw.choice([1, 2, 3, 5])) * draw.randrange(1, 50)
        elif kind == 4:
            words = prose(draw.randrange(0, 5))
        else:
            words = prose(draw.randrange(5, 200))
        blank = lambda: draw.choice([" ", " ", " ", "\n", "\t ", "\r\n", "\x0b", " \x0c"])
        rows.append((i, "".join(w + blank() for w in words), draw.choice(["a", "b", "é", None]), "h", i, 1, 2, 3))
    rows += [(n, None, None, None, None, None, None, None), (n + 1, "", "a", "", 0, 0, 0, 0), (n + 2, " \n\t", "b", "", 0, 0, 0, 0)]
    rows += [rows[3], (None, rows[4][1], "a", "", 0, 0, 0, 0), (None, None, "a", "", 0, 0, 0, 0), (None, "only here " * 3, "a", "", 0, 0, 0, 0)]
    return rows


@pytest.fixture(scope="module", params=[1, 2])
def docs(request, spark):
    rows = corpus(request.param)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def test_hashing_pieces():
    tokens = np.random.default_rng(0).integers(0, 2**63, 100).astype(np.uint64)
    for size, made in zip((1, 7, 35, 64), ngrams(tokens, 1, 7, 35, 64), strict=True):
        assert len(made) == 101 - size
        assert made[5] == ngrams(tokens[5 : 5 + size], size)[0][0]
    assert ngrams(tokens[:3], 5)[0].size == 0
    for width in (1, 2, 3, 28):
        assert sliding_min(tokens, width).tolist() == [tokens[i : i + width].min() for i in range(101 - width)]
    words, starts = split_all([b"a\x0bB", None, "x\u0085y z".encode()], lower=True)
    assert words == [b"a", b"b", "x\u0085y".encode(), b"z"] and starts.tolist() == [0, 2, 2, 4]


def test_substring_dedup(docs):
    rows, df = docs
    words, masks = repeated_mask([r[1] for r in rows], 35)
    expected = []
    for row, w, mask in zip(rows, words, masks, strict=True):
        left = " ".join(x for x, gone in zip(w, mask, strict=True) if not gone)
        expected.append((row[0], len(w), sum(mask), left, hashlib.sha256(left.encode()).hexdigest()))
    got = graph_dedup.remove_repeats(df, 35).select("doc_id", "n_words", "n_removed", "text", "text_sha256").collect()
    assert in_order(map(tuple, got)) == in_order(expected)
    assert any(e[2] for e in expected)


@pytest.mark.parametrize("window", [9, 20])
def test_substring_dedup_short_windows(docs, window):
    rows, df = docs
    words, masks = repeated_mask([r[1] for r in rows], window)
    got = graph_dedup.remove_repeats(df, window).select("doc_id", "n_removed").collect()
    assert in_order(map(tuple, got)) == in_order((r[0], sum(m)) for r, m in zip(rows, masks, strict=True))


def test_suffix_passages(docs):
    rows, df = docs
    _, masks = repeated_mask([r[1] for r in rows], 50)
    expected = [(r[0], a, b) for r, m in zip(rows, masks, strict=True) for a, b in spans.covered_spans(np.array(m, bool))]
    got = suffix_dedup.repeated_passages(df, 50)
    assert got.columns == ["doc_id", "from_word", "to_word"]
    assert in_order(map(tuple, got.collect())) == in_order(expected) and expected


@pytest.mark.parametrize("size,percent", [(4, 80), (2, 60)])
def test_near_duplicates(docs, size, percent):
    rows, df = docs
    bands, per_band = (50, 6) if percent == 80 else (80, 4)
    got = near_dup.near_duplicates(df, size, percent, bands=bands, rows=per_band).select("doc_id", "n_shingles", "component_id", "kept").collect()
    expected = brute_components(rows, size, percent)
    assert in_order(map(tuple, got)) == in_order(expected)
    assert len({e[2] for e in expected}) < len(rows) - 3


def families(seed: int) -> list[tuple]:
    """Families whose members lie around the threshold: of a text that is there or not, shortened, in chains, or with a passage."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(3000)}"
    texts = []
    for kind in range(6):
        base, passage = [word() for _ in range(120)], [word() for _ in range(12)]
        texts += [base] * (kind % 2)
        last = base
        for _ in range(28):
            words = (last if kind == 4 else base)[:]
            for _ in range(draw.randrange(1, 6)):
                at = draw.randrange(len(words))
                words[at : at + 1] = [] if kind in (2, 3) and draw.random() < 0.7 else [word()]
            if kind == 5 and draw.random() < 0.5:
                words += passage
            if kind == 3 and draw.random() < 0.5:
                words = words[: draw.randrange(90, len(words))]
            last = words
            texts.append(words)
    return [(i, " ".join(t), "a", "", 0, 0, 0, 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,common", [(5, 0), (6, 4), (7, 32)])
def test_families_around_the_threshold(spark, monkeypatch, seed, common):
    monkeypatch.setattr(near_dup, "COMMON", common)
    monkeypatch.setattr(near_dup, "HANDED", 500)
    rows = families(seed)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 4).select("doc_id", "n_shingles", "component_id", "kept").collect()
    expected = brute_components(rows, 4, 80)
    assert in_order(map(tuple, got)) == in_order(expected)
    assert 10 < len({e[2] for e in expected}) < len(rows) - 40


def test_pairs_of_a_large_family_grow_with_its_members(spark, monkeypatch):
    draw = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    compared = []
    verify = near_dup._verified
    monkeypatch.setattr(near_dup, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or verify(pairs, *rest))
    for members in (100, 400):
        rows = [(i, " ".join(f"x{draw.randrange(10**6)}" if draw.random() < 0.045 else w for w in base), "a", "", 0, 0, 0, 0) for i in range(members)]
        near_dup.near_duplicates(spark.createDataFrame([*rows, (members, " ".join(base), "a", "", 0, 0, 0, 0)], SCHEMA), 4).count()
    small, large = sum(compared[:2]), sum(compared[2:])
    assert large <= 8 * small, compared


def test_components_of_chains(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 102), (200, 100)]
    got = dict(near_dup.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102, 200), 100)}


def line_corpus(seed):
    draw = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(30)]
    base = [[draw.choice(vocabulary) for _ in range(draw.randrange(1, 16))] for _ in range(12)]
    rows = []
    for d in range(25):
        lines = []
        for _ in range(draw.randrange(0, 8)):
            line = draw.choice(base)[:]
            for _ in range(draw.choice([0, 0, 1, 1, 2])):
                kind, at = draw.randrange(3), draw.randrange(len(line) + 1)
                if kind == 0:
                    line.insert(at, draw.choice(vocabulary))
                elif at < len(line):
                    line[at : at + 1] = [] if kind == 1 else [draw.choice(vocabulary)]
            lines.append(draw.choice([" ", "  "]).join(line))
        rows.append((d, "\n".join(lines), "s", "x", 1, 1, 1, 1))
    rows += [(90, None, "s", "x", 1, 1, 1, 1), (91, "", "s", "x", 1, 1, 1, 1), (92, "\n \n", "s", "x", 1, 1, 1, 1), (None, rows[2][1] + "\nown line", "s", "x", 1, 1, 1, 1)]
    return rows


@pytest.mark.parametrize("seed,broadcast_lines", [(1, 0), (2, 500_000), (3, 500_000)])
def test_line_dedup(spark, seed, broadcast_lines, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", broadcast_lines)
    rows = line_corpus(seed)
    expected, near = brute_lines(rows)
    made = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = made.select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert in_order(map(tuple, got)) == in_order(expected) and near
    assert made.select("row.h").distinct().collect()[0][0] == "x"


def test_repeated_rows_keep_their_lines(spark):
    rows = [(1, "one two", "s", "x", 1, 1, 1, 1)] * 2 + [(2, "one two\nthree", "s", "x", 1, 1, 1, 1)]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_dropped", "text").collect()
    assert in_order(map(tuple, got)) == [(1, 0, "one two"), (1, 0, "one two"), (2, 1, "three")]


def test_one_edit():
    draw = random.Random(5)
    for _ in range(3000):
        a = [draw.choice("ab") for _ in range(draw.randrange(5))]
        b = [draw.choice("ab") for _ in range(draw.randrange(5))]
        assert line_dedup.within_one_edit(a, b) == (edits(a, b) <= 1)


def test_line_dedup_packs_texts_for_a_shuffle_only(spark, monkeypatch):
    """A chain of two Python nodes holds two workers for each core; a broadcast join needs no packed texts before it."""
    seen, made = [], line_dedup._variants
    monkeypatch.setattr(line_dedup, "_variants", lambda joined: seen.append(joined._jdf.queryExecution().toString()) or made(joined))
    rows = [(d, f"a b c d e f g h {last}", "s", "x", 1, 1, 1, 1) for d, last in ((1, "i"), (2, "j"))]
    for limit, nodes in ((500_000, False), (0, True)):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
        got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_dropped").collect()
        assert sorted(map(tuple, got)) == [(1, 0), (2, 1)]
        assert ("MapInArrow" in seen.pop()) == nodes


@pytest.mark.parametrize("broadcast_words", [0, 500_000])
def test_decontamination(docs, spark, monkeypatch, broadcast_words):
    monkeypatch.setattr(decontamination, "BROADCAST_WORDS", broadcast_words)
    rows, df = docs
    draw = random.Random(3)
    items = [(i, " ".join(draw.choice(rows)[1] or "" for _ in range(1))[: draw.randrange(10, 400)]) for i in range(12)]
    items += [(50, None), (51, ""), (52, "w1"), (53, "w2 w3"), (54, "no such words at all"), items[0], (60, items[1][1].upper()), (None, items[2][1])]
    made = decontamination.contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    got = made.select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    expected = brute_contamination(rows, items)
    assert in_order((r[0], r[1], r[2], tuple(r[3]), r[4]) for r in got) == in_order(expected)
    assert any(e[4] for e in expected)


def test_proximity(spark):
    text = spark.createDataFrame([(1, "zero alpha x beta gamma one"), (2, "alpha far far far far far far beta gamma"), (3, "beta only")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    got = decontamination.proximity_matches(text, items, slop=2).select("doc_id", "item_id", "first_pos", "last_pos").collect()
    assert [tuple(r) for r in got] == [(1, 7, 1, 4)]


def test_mixing(docs, spark):
    rows, df = docs
    got = mixing.copies(df).collect()
    assert len(got) == len(rows)
    size = {}
    for row in rows:
        size[row[2]] = size.get(row[2], 0) + len(words_of(row[1]))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    goal, open_names, rest = {}, set(names), float(sum(size.values()))
    while True:  # as the contract says it: cut at the cap, share the excess again
        level = rest / sum(weight[s] for s in open_names)
        over = {s for s in open_names if level * weight[s] > 3 * size[s]}
        if not over:
            break
        for s in over:
            goal[s] = 3.0 * size[s]
            rest -= goal[s]
        open_names -= over
    goal |= {s: level * weight[s] for s in open_names}
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], goal[r["source"]], rel_tol=1e-9)
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    longest = {s: max(len(words_of(r[1])) for r in rows if r[2] == s) for s in names}
    assert all(abs(taken[s] - goal[s]) <= 2 * longest[s] + 1 for s in names)
    assert in_order(map(tuple, mixing.copies(df.repartition(2)).collect())) == in_order(map(tuple, got))
    emitted = mixing.mixed(df)
    assert emitted.columns == [*df.columns, "copy"]
    assert emitted.groupBy("doc_id", "text", "copy").count().where("count > 1").count() == 0
    assert emitted.count() == sum(r["copies"] for r in got)


def test_targets_are_all_capped_or_level(spark):
    sized = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 1), (None, 100), ("z", 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sized, (1, 2, 3), 3).collect()}
    assert got["b"] == 30 and got["c"] == 3 and got["z"] == 0
    assert math.isclose(sum(got.values()), 1111) and got[None] == 300


def test_nearest(spark):
    draw = np.random.default_rng(1)
    points = draw.normal(size=(900, 24)).astype(np.float32)
    points[300:340] = points[5]
    points[400] *= 3
    rows = [(i, [float(x) for x in p], 1) for i, p in enumerate(points)]
    rows += [(2000, None, 1), (2020, [0.0] * 24, 1), (2040, [None] + [1.0] * 23, 1), (2060, [float("nan")] * 24, 1), (2080, [float("inf")] * 24, 1), (None, rows[1][1], 1), rows[7], rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, place int").repartition(3)
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 20).collect()
    assert len(got) == 45 * 20 and [r["rank"] for r in got if r["query_id"] == 40] == list(range(1, 21))
    exact, found = points.astype(np.float64), 0
    for query in range(0, 900, 20):
        near = exact @ exact[query]
        mine = [r for r in got if r["query_id"] == query]
        assert all(math.isclose(r["score"], near[r["vec_id"]], rel_tol=1e-12, abs_tol=1e-12) for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        order = sorted((i for i in range(900) if i != query), key=lambda i: (-round(near[i], 12), i))[:20]
        found += len(set(order) & {r["vec_id"] for r in mine})
    assert found / 900 >= 0.9
    assert [r["vec_id"] for r in got if r["query_id"] == 320][:6] == [5, 300, 301, 302, 303, 304]


def test_nearest_of_lone_queries(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 512)
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 700)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(10, 64))
    points = centres[draw.integers(0, 10, size=3000)] + 0.02 * draw.normal(size=(3000, 64))
    lone = list(range(0, 3000, 100))
    points[lone] = draw.normal(size=(30, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>").repartition(3)
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), 20).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert sorted(found) == list(range(0, 3000, 50)) and all(sorted(f) == list(range(1, 21)) for f in found.values())
    shared = 0
    for query, mine in found.items():
        near = points @ points[query]
        near[query] = -np.inf
        shared += len(set(np.argsort(-near)[:20].tolist()) & set(mine.values()))
    assert shared / 1200 >= 0.9


def test_nearest_beside_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 512)
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 700)
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(60, 32))
    points = centres[draw.integers(0, 60, size=3000)] + 0.5 * draw.normal(size=(3000, 32))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points *= np.exp(0.3 * draw.normal(size=(3000, 1)))
    points[[7, 1203, 2111]] *= 1000
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>").repartition(3)
    found = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 20).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    shared = 0
    for query in range(0, 3000, 20):
        near = points @ points[query]
        near[query] = -np.inf
        wanted = set(np.argsort(-near)[:20].tolist())
        assert {7, 1203, 2111} & wanted <= found[query]
        shared += len(wanted & found[query])
    assert shared / 3000 >= 0.9


def test_codes_do_not_depend_on_the_block():
    points = np.random.default_rng(5).normal(size=(400, 32))
    points[399] *= 1000
    codes = ann.fit_codes(points[:300], 20)
    alone, beside = (codes.of(ann.lifted_rows(points[rows], codes.ball)) for rows in (slice(300, 350), slice(300, 400)))
    assert (alone == beside[:50]).all() and codes.outside(points)[399]


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 20).select("query_id", "rank", "vec_id", "score").collect()
    assert in_order(map(tuple, got)) == in_order([(0, 1, 20, 4.0), (0, 2, 3, 3.0), (20, 1, 0, 4.0), (20, 2, 3, 3.0)])
    assert ann.nearest(df.limit(0), df.limit(0), 20).count() == 0


PAGES = [
    (1, "http://a/1", "x" * 1200, "e"),
    (5, "http://a/5", "x" * 1200, "e"),
    (3, "http://a/3", "x" * 1200, "e"),
    (2, "http://a/2", "small", "e"),
    (4, "http://a/4", "small", "e"),
    (6, None, None, "e"),
    (7, "http://a/7", "", "e"),
    (8, "http://a/8\r\nEvil: 1", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n" * 40, "e"),
    (9, "http://a/9", "ends in line breaks" * 80 + "\r\n", "e"),
    (10, "http://a/10", "\r\n\r\n\r\nstarts" + "é" * 600 + "\r\n\r\n\r\n", "e"),
    (11, "http://a/11", "\r\n", "e"),
    (None, "http://a/n", "nameless" * 200, "e"),
    (12, "http://a/12", "y" * 1000, "e"),
    (13, "http://a/13", "y" * 1000, "e"),
    (14, "http://a/14", "y" * 999, "e"),
    (15, "http://a/15", "y" * 999, "e"),
    (16, "http://a/16", "same row" * 300, "e"),
    (16, "http://a/16", "same row" * 300, "e"),
]


def test_warc_round_trip(spark):
    folder = shared_folder(spark)
    warc.write_captures(spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string").repartition(3), folder)
    records = warc.read_records(spark, folder)
    assert {r["type"]: r["count"] for r in records.groupBy("type").count().collect()} == {"request": 18, "metadata": 18, "response": 15, "revisit": 3}
    captures = warc.assemble(records)
    assert captures.count() == 18 and captures.where("request is null or size(metadata) != 1").count() == 0
    payloads = {r[0] for r in captures.where("response.type = 'response'").select("response.payload").collect()}
    assert payloads == {(p[2] or "").encode() for p in PAGES}
    got = in_order((int(r[0]) if r[0] else None, *r[1:]) for r in map(tuple, warc.captured_pages(captures).collect()))
    expected = []
    for page, _, html, _ in PAGES:
        body = (html or "").encode()
        top = max((p[0] or 0) for p in PAGES if (p[2] or "").encode() == body)
        back = len(body) >= 1000 and (page or 0) != top
        expected.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if back else "response", str(top) if back else None))
    assert got == in_order(expected)


def test_warc_of_nothing(spark):
    folder = shared_folder(spark)
    warc.write_captures(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.captured_pages(warc.assemble(warc.read_records(spark, folder))).count() == 0


def test_assembly_follows_identifiers(spark):
    rows = [("request", "q", None), ("response", "r", "q"), ("metadata", "m", "q"), ("metadata", "m2", "r2"), ("response", "r2", None), ("request", "q2", "r2"), ("metadata", "m3", "q2"), ("request", "alone", None), ("warcinfo", "i", None)]
    records = spark.createDataFrame([(t, i, c, None, None, None, {}, None, None, 0, "") for t, i, c in rows], warc.RECORD)
    got = {r["record_id"]: (r["request"]["record_id"], sorted(m["record_id"] for m in r["metadata"])) for r in warc.assemble(records).collect()}
    assert got == {"r": ("q", ["m"]), "r2": ("q2", ["m2", "m3"])}


HTML = [
    ("<p>One<p>Two <b>bold</b>\n  text<br>next", "One\n\nTwo bold text\nnext"),
    ("<title>t</title><style>p{}</style><script>var a='</p>';</script>Hi<!-- no -->!", "Hi!"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>after", "- a\n- b\n  3. x\n  4. y\n- c\n\nafter"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>x<td>22</table>", "Name       N\nlong name  1\nx          22"),
    ("<table><tr><td colspan=2>wide<td>c<tr><td rowspan=2>a<td>b<td>d<tr><td>e<td>f</table>", "wide     c\na     b  d\n      e  f"),
    ('<div hidden>no</div><div style="color:red; display : none">no</div><p style="visibility:hidden">no</p><div>yes</div><input type=text value=no>', "yes"),
    ("<pre>\n a\n   b\n</pre>c", " a\n   b\n\nc"),
    ("a &lt;b&gt; &amp;amp; &eacute;&nbsp;x", "a <b> &amp; é x"),
    ("<div>a<div>b</div>c</div><h1>H</h1>d", "a\nb\nc\n\nH\n\nd"),
    ("<a href=\"x>y\">link</a> < 5 <3 </bogus x>z", "link < 5 <3 z"),
    ("<details><summary>S</summary>hidden</details><details open><summary>T</summary>shown</details>", "S\nT\nshown"),
    ("<dl><dt>term<dd>what<dt>t2<dd>w2</dl>", "term\n  what\nt2\n  w2"),
    ("<p>unclosed <b>bold<p>still", "unclosed bold\n\nstill"),
    ("<table><td>no row<td>two</table>x</table></div></p>y", "no row  two\n\nx\n\ny"),
    ("", ""),
    (None, None),
    ("<textarea>&lt;kept</textarea><template>no</template><noscript>no</noscript>", "<kept"),
    ("<" * 50 + "p>x", "<" * 49 + "\n\nx"),
]


@pytest.mark.parametrize("html,text", HTML)
def test_html_text(html, text):
    assert html_text.text_of(html) == text


MISPLACED = [
    ("<table><tbody><form><tr><td>X<td>Y</td></tr></form></tbody></table>Z", "X  Y\n\nZ"),
    ("<form>F<table><tr><form><td>X</form><tr><td>Y</table>Z</form>", "F\n\nX\nY\n\nZ"),
    ("<table><tbody><p>note</p><tr><td>X</table>", "note\n\nX"),
    ("<table><tbody>bare<tr><td>X</td></tr>more</tbody>last</table>", "baremorelast\n\nX"),
    ("<table><tbody><div>note<tr><td>X<td>Y</table>", "note\n\nX  Y"),
    ("<table hidden><p>note</p><tr><td>X</table>", "note"),
    ("<table><tr><td>X</tr><caption>C</caption></table>", "C\nX"),
    ("<table><colgroup><col>note<tr><td>X</table>", "note\n\nX"),
    ("<table><colgroup><td>X</table>", "X"),
    ("<table><tr><td>X<table><tr><td>in</table>Y</table>", "X\nin\nY"),
    ("<table><tr><table><tr><td>in</table>Y", "in\n\nY"),
    ("<table><tr><template>no<tr>no<td>no</template><td>X</table>", "X"),
    ("<head><title>T</title>Hello<p>x", "Hello\n\nx"),
    ("<html><head> <title>T</title>\n</head> <body>b", "b"),
]


@pytest.mark.parametrize("html,text", MISPLACED)
def test_misplaced_text_is_kept(html, text):
    assert html_text.text_of(html) == text


def test_every_visible_word_of_mixed_tables_comes_out():
    draw = random.Random(2)
    bits = ["<table>", "</table>", "<tbody>", "</tbody>", "<thead>", "<tr>", "</tr>", "<td>", "</td>", "<form>", "</form>", "<p>", "</p>", "<div>", "</div>", "<caption>", "<colgroup>", "<col>", "<b>", "<ul>", "<li>"]
    for _ in range(500):
        made = [draw.choice(bits) if draw.random() < 0.7 else f" w{i} " for i in range(40)]
        wanted = sorted(m.strip() for m in made if m.startswith(" "))
        assert sorted(w for w in html_text.text_of("<head>" + "".join(made)).split() if w != "-") == wanted


def test_html_survives_anything(spark):
    draw = random.Random(1)
    bits = ["<p>", "</p>", "<table>", "<tr>", "<td colspan=9999>", "</table>", "<li>", "<ul>", "<!--", "-->", "<script>", "</script>", "&", "&#x1F600;", "word ", "<", ">", '"', "'", "<a b='", "<td rowspan=99999>", "\x00", "<select><option>", "<svg>", "</svg>"]
    for _ in range(300):
        html_text.text_of("".join(draw.choice(bits) for _ in range(draw.randrange(60))))
    assert html_text.text_of("<div>" * 20000 + "deep").strip() == "deep"
    assert len(html_text.text_of("<p>" + "word " * 200000).split()) == 200000
    rows = [(1, "<p>a", "x", 1), (1, "<p>a", "x", 1), (None, None, None, None)]
    made = html_text.extract(spark.createDataFrame(rows, "page_id long, html string, text string, row int"))
    assert made.columns == ["page_id", "row", "text"]
    assert in_order(map(tuple, made.collect())) == in_order([(1, 1, "a"), (1, 1, "a"), (None, None, None)])


def toxic_corpus(n):
    draw = random.Random(9)
    vocabulary, insults = [f"w{i}" for i in range(900)], ["vile", "scummy", "rotten"]
    rows, labels = [], []
    for i in range(n):
        words, toxic = [draw.choice(vocabulary) for _ in range(draw.randrange(20, 400))], draw.random() < 0.2
        if toxic:
            for _ in range(draw.randrange(2, 6)):
                words.insert(draw.randrange(len(words)), draw.choice(insults) + draw.choice(["", ",", "!"]))
        low = not toxic and draw.random() < 0.2
        if low:
            words += ["buy!!", "now!!"] * 3
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(low), int(toxic)))
    return rows, labels


def test_toxicity_chain(spark):
    rows, labels = toxic_corpus(900)
    rows += [(5000, None, "x"), (5001, "", "x"), (None, "vile rotten scummy vile", "x"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(3)
    known = spark.createDataFrame([*labels[:600], (7000, 1, 1), (1, None, 1)], "doc_id long, low_quality int, toxic int")
    chain = toxicity.fit_chain(df, known, ["low_quality", "toxic"], sample=200)
    assert chain.weights.shape[1] == len(chain.features) + 2 and chain.weights[1, len(chain.features)] < 0
    got = {r["doc_id"]: r for r in toxicity.score(df, chain).collect()}
    right = sum(got[i]["rejected"] == bool(t) for i, _, t in labels[600:])
    assert right / 300 >= 0.97
    assert not got[5000]["rejected"] and got[5001]["p_toxic"] == 0.0 and got[None]["rejected"]
    assert toxicity.score(df, chain, carry=True).select("row.h").distinct().count() == 1
    again = toxicity.fit_chain(df.repartition(2), known, ["low_quality", "toxic"], sample=200)
    assert again.threshold == chain.threshold and np.array_equal(again.weights, chain.weights)


def test_labels_without_documents_take_no_places(spark):
    rows, labels = toxic_corpus(300)
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    fitted = []
    for more in ([], [(10_000 + i, 0, i % 2) for i in range(5000)]):
        known = spark.createDataFrame([*labels, *more], "doc_id long, low_quality int, toxic int")
        fitted.append(toxicity.fit_chain(df, known, ["low_quality", "toxic"], sample=100, steps=20))
    assert fitted[0].features == fitted[1].features and np.array_equal(fitted[0].weights, fitted[1].weights)


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, low_quality int, toxic int")
    got = toxicity.score(df, toxicity.fit_chain(df, none, ["low_quality", "toxic"])).collect()
    assert len(got) == 2 and not any(r["rejected"] for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert graph_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.repeated_passages(none).count() == 0
    assert near_dup.near_duplicates(none).count() == 0
    assert line_dedup.drop_repeated_lines(none).count() == 0
    assert mixing.mixed(none).count() == 0
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(none, items).count() == 0
    assert decontamination.contamination(some, items).select("n_words", "n_hit").collect()[0] == (3, 0)
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_a_very_long_text(spark):
    draw = random.Random(4)
    long = " ".join(f"w{draw.randrange(10**6)}" for _ in range(300_000))
    rows = [(1, long), (2, long[:-40] + " other end"), (3, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    comps = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df).collect()}
    assert comps == {1: 1, 2: 1, 3: 3}
    removed = {r["doc_id"]: r["n_removed"] for r in graph_dedup.remove_repeats(df).collect()}
    assert removed[1] > 299_900 and removed[3] == 0


def test_toxicity_scores_a_batch_piece_by_piece(monkeypatch):
    """The word sets of a batch would take many times its texts; the scores are those of one piece."""
    draw = random.Random(5)
    texts = [None, b"", *(b" ".join(b"w%d" % draw.randrange(3000) for _ in range(200)) for _ in range(2000))]
    words = {b"w%d" % (7 * i): i for i in range(420)}
    chain = toxicity.Chain(("a", "b"), words, np.random.default_rng(1).normal(size=(2, len(words) + 2)), 0.5)
    whole = chain.probabilities(texts)
    monkeypatch.setattr(common, "PIECE_BYTES", 20_000)
    tracemalloc.start()
    assert np.array_equal(chain.probabilities(texts), whole)
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()
    assert not whole[:2].any() and chain.probabilities([]).shape == (0, 2)
