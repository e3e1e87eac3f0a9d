"""The llm queries against their SQL, and the pipeline stage by stage against the plain contracts."""

import math
import random
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from brute import brute_components, brute_contamination, brute_lines, in_order, words_of  # noqa: E402
from hindcast.llm import toxicity  # noqa: E402
from hindcast.llm.queries import QUERIES, SQL  # noqa: E402

FOLDER = Path("/root/testdata/sf0.001")


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) and not math.isnan(value) else value


@pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    made, found = QUERIES[name](spark, str(FOLDER)), con.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(made.columns) == sorted(columns)
    got = in_order(tuple(plain(row[c]) for c in columns) for row in made.collect())
    assert got == in_order(tuple(plain(v) for v in row) for row in found.fetchall())


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in QUERIES if q != "pipeline"} == {f"op{n}" for n in range(1, 11)}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "source_mixing"]


@pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")
def test_toxicity_on_held_out_labels(spark):
    folder = str(FOLDER).replace("0.001", "0.1")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id", "1 - quality as low_quality", "toxic")
    known, held = labels.where("doc_id % 2 = 0"), {r["doc_id"]: r["toxic"] for r in labels.where("doc_id % 2 = 1").collect()}
    got = {r["doc_id"]: r["rejected"] for r in toxicity.score(docs, toxicity.fit_chain(docs, known, ["low_quality", "toxic"])).collect()}
    right = sum(got[d] == bool(t) for d, t in held.items())
    assert right / len(held) >= 0.97


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    draw = random.Random(6)
    vocabulary = [f"w{i}" for i in range(500)]
    line = lambda: " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(3, 30)))
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(30))) for i in range(5)]
    shared = [line() for _ in range(6)]
    docs, labels = [], []
    for i in range(140):
        lines, toxic = [line() for _ in range(draw.randrange(1, 9))], i % 5 == 0
        if toxic:
            lines[0] += " vile scummy vile"
        if i % 7 == 1:
            lines.append(draw.choice(shared))
        if i % 9 == 2:
            lines.append(draw.choice(items)[1])
        text = "\n".join(lines)
        if i % 11 == 3:
            words = docs[i - 1][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        docs.append((i, text, "en", draw.choice(["a", "b", None]), len(text)))
        if i % 2 == 0:
            labels.append((i, int(draw.random() < 0.8 or toxic), int(toxic)))
    docs += [(200, None, None, None, None), (201, "", "en", "a", 0), docs[4], (None, docs[6][1] + "\nnameless line of its own", "en", "b", 3)]
    folder = tmp_path_factory.mktemp("tables")
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", items, "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder), docs, labels, items


def test_stages_equal_the_contracts(spark, tables, tmp_path):
    folder, docs, labels, items = tables
    stage, at = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{folder}/documents.parquet")

    def after(name, given):
        made = stage[name](spark, given, folder)
        if name != "source_mixing":
            assert made.columns == given.columns and [t for _, t in made.dtypes] == [t for _, t in given.dtypes]
        made.write.parquet(f"{tmp_path}/{name}")
        back = spark.read.parquet(f"{tmp_path}/{name}")
        return back, [tuple(r) for r in back.collect()]

    at, rows = after("toxicity", at)
    assert in_order(rows) == in_order(d for d in docs if "scummy" not in (d[1] or ""))

    lines, _ = brute_lines(rows)
    by_key = {(d[0], d[1]): (left, n, lost) for d, (_, n, lost, left) in zip(rows, lines, strict=True)}
    wanted = []
    for d in rows:
        left, n, lost = by_key[d[0], d[1]]
        if n == 0 or lost < n:
            wanted.append((d[0], left, d[2], d[3], len(left) if lost else d[4]))
    at, rows = after("line_dedup", at)
    assert in_order(rows) == in_order(wanted)

    groups = brute_components(rows, 5, 80)
    wanted = {(d[0], d[1]) for d, g in zip(rows, groups, strict=True) if d[0] == g[2]}
    at, rows = after("minhash_near_dedup", at)
    assert {(d[0], d[1]) for d in rows} == wanted and len(rows) == len(wanted)

    wanted = [d for d, c in zip(rows, brute_contamination(rows, items), strict=True) if not c[4]]
    before = len(rows)
    at, rows = after("benchmark_decontamination", at)
    assert in_order(rows) == in_order(wanted) and len(rows) < before

    at, mixed = after("source_mixing", at)
    assert at.columns == [*["doc_id", "text", "lang", "source", "n_chars"], "copy"]
    assert {m[:5] for m in mixed} <= set(rows) and max(m[5] for m in mixed) <= 3
    size = lambda some: sum(len(words_of(m[1])) for m in some)
    assert abs(size(mixed) - size(rows)) <= 0.2 * size(rows)


def test_one_document_of_each_group_stays(spark):
    draw = random.Random(8)
    words = lambda: [f"w{draw.randrange(10**6)}" for _ in range(80)]
    edited = lambda base, i: " ".join([*base[:i], "edited", *base[i + 1 :]])
    nameless, shared, mixed, alone = words(), words(), words(), words()
    rows = [(None, edited(nameless, 2 * i)) for i in range(5)] + [(7, edited(shared, 2 * i)) for i in range(5)]
    rows += [(None, edited(mixed, 1)), (9, edited(mixed, 3)), (8, edited(mixed, 5)), (8, edited(mixed, 5)), (7, " ".join(alone)), (None, None), (None, ""), (3, ""), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, docs, "").collect()]
    group = lambda text: next((i for i, g in enumerate((nameless, shared, mixed, alone)) if text and g[-1] in text.split()), None)
    assert in_order((d, group(t)) for d, t in got if t) == in_order([(None, 0), (7, 1), (8, 2), (7, 3)])
    assert in_order(r for r in got if not r[1]) == in_order([(None, None), (None, ""), (3, "")])


def test_run_applies_all_stages(spark, tables):
    folder, *_ = tables
    first = in_order(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    assert first and first == in_order(map(tuple, corpus_pipeline.run(spark, folder).collect()))


def test_stages_on_empty_tables(spark, tables):
    folder, *_ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
