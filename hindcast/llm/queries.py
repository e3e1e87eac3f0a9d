"""The queries of this subpackage and, where SQL can say the same, the SQL they are checked against."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from hindcast.llm import ann, bpe, decontamination, graph_dedup, hard_negatives, html_text, line_dedup, mixing, near_dup, suffix_dedup, toxicity, vector_codes, warc
from hindcast.llm.common import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Words of the contract of op9: A-Z lowered, runs of characters outside the ASCII ranges.
_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, list_slice(w, s, s + least(13, len(w)) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, s, list_slice(w, s, s + k - 1) AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
occ AS (SELECT dw.doc_id, dw.s, dw.k, win.item_id FROM dw JOIN win USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op9_decontamination", CONTAMINATION_SQL)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    named = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), named.alias("items_sha256"), "contaminated")


#: Words of the contracts of op2, op4 and op5: runs of characters other than the six ASCII blanks.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

REPEATS_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, s, list_slice(w, s, s + 34) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
twice AS (SELECT md5(array_to_string(g, ' ')) AS m FROM win GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (
  SELECT doc_id, unnest(range(s, s + 35)) AS p FROM win WHERE md5(array_to_string(g, ' ')) IN (SELECT m FROM twice)) GROUP BY doc_id),
k AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
g AS (SELECT doc_id, unnest(ps) AS p FROM gone),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM k ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""


@query("op4_substring_dedup", REPEATS_SQL)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = graph_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return cleaned.select("doc_id", "n_words", "n_removed", F.col("text_sha256").alias("kept_sha256"))


NEAR_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 3), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * p.c >= 80 * (x.c + y.c - p.c)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.c, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(comp.b, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(comp.b, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.a = d.doc_id
"""


@query("op5_minhash_near_dedup", NEAR_SQL)
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


LINES_SQL = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS raw, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM t)),
f AS (SELECT doc_id, i, raw, array_to_string(w, ' ') AS s, w FROM l WHERE len(w) > 0),
d AS (SELECT s, any_value(w) AS w, min((doc_id, i)) AS place FROM f GROUP BY s),
v AS (SELECT s, place, len(w) AS n, p, md5(array_to_string(list_concat(list_slice(w, 1, p - 1), list_slice(w, p + 1, len(w))), ' ')) AS m
  FROM (SELECT s, w, place, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) >= 8)),
sub AS (SELECT x.s FROM v x JOIN v y ON x.m = y.m AND x.n = y.n AND x.p = y.p AND y.place < x.place),
gap AS (SELECT v.s AS long_line, v.place AS long_at, d.s AS short_line, d.place AS short_at FROM v JOIN d ON v.m = md5(d.s) AND len(d.w) = v.n - 1 AND v.n > 8),
near AS (SELECT s FROM sub UNION SELECT long_line FROM gap WHERE short_at < long_at UNION SELECT short_line FROM gap WHERE long_at < short_at),
gone AS (SELECT f.doc_id, f.i FROM f JOIN d USING (s) WHERE (f.doc_id, f.i) <> d.place OR s IN (SELECT s FROM near)),
k AS (SELECT l.doc_id, string_agg(raw, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
SELECT documents.doc_id, (SELECT count(*) FROM f WHERE f.doc_id = documents.doc_id) AS n_lines,
  (SELECT count(*) FROM gone WHERE gone.doc_id = documents.doc_id) AS n_dropped, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents LEFT JOIN k ON k.doc_id = documents.doc_id
"""


@query("op6_line_dedup", LINES_SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


MIXING_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS tie FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(cap) OVER f, 0))::DOUBLE / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER f, 0))::DOUBLE AS level
  FROM w WINDOW f AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, (max(level) FILTER (cap::DOUBLE / weight::DOUBLE >= level) OVER ()) * weight) AS target,
  (('0x' || substr(md5('7:' || coalesce(source, '') || CASE WHEN source IS NULL THEN 'null' ELSE '' END), 1, 8))::BIGINT)::DOUBLE / 4294967296.0 AS u FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, tie, doc_id) AS k FROM d),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate, u, k FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * least(floor(u + rate * k) - floor(u + rate * (k - 1)), 3) AS BIGINT) AS taken FROM c
"""


@query("op2_source_mixing", MIXING_SQL)
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.copies(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS d FROM pages),
t AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top IS NULL OR page_id = top THEN NULL ELSE top END AS refers_to
FROM p LEFT JOIN t ON p.d = t.d AND n >= 1000
"""


@query("op10_warc", WARC_SQL)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = shared_folder(spark)
    warc.write_captures(pages, folder)
    found = warc.captured_pages(warc.assemble(warc.read_records(spark, folder, payloads=False)))
    kind = pages.schema["page_id"].dataType
    return found.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.fit_chain(docs, labels, ["low_quality", "toxic"])
    return toxicity.score(docs, chain).select("doc_id", "p_low_quality", "p_toxic", F.col("rejected").alias("toxic"))


@query("op1_html_text")
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "text")


PASSAGES_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS m
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
hit AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM win WHERE m IN (SELECT m FROM win GROUP BY m HAVING count(*) > 1)),
run AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hit)
SELECT doc_id, CAST(min(p) - 1 AS BIGINT) AS from_word, CAST(max(p) AS BIGINT) AS to_word FROM run GROUP BY doc_id, run
"""


@query("op7_suffix_array_dedup", PASSAGES_SQL)
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"), window=50)


@query("op8_nearest_neighbours")
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = F.col("ids")
    done = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    digests = (F.sha2(made, 256).alias(name) for name, made in (("ids_sha256", bpe.little_endian(ids, ranks)), ("decoded_sha256", bpe.decoded(ids, ranks))))
    return done.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), *digests)


#: Whether a vector is there and all its components are.
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_sql(rounds: int = 6) -> str:
    """Each round: every part meets the entries of its codebook, and entries become the floors of means."""
    assign = """a{n} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT v.vec_id, v.part, b.entry, list_sum(list_transform(range(1, 9), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))::BIGINT AS d
  FROM v JOIN b{n} b ON b.part = v.part) GROUP BY vec_id, part)"""
    refine = """m{n} AS (SELECT v.part, a.entry, i, sum(v.x[i])::HUGEINT AS s, count(*)::HUGEINT AS c FROM v JOIN a{n} a ON a.vec_id = v.vec_id AND a.part = v.part,
  (SELECT unnest(range(1, 9)) AS i) GROUP BY ALL),
b{k} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM b{n} b LEFT JOIN (
  SELECT part, entry, list(((s - ((s % c) + c) % c) // c)::BIGINT ORDER BY i) AS x FROM m{n} GROUP BY part, entry) n ON n.part = b.part AND n.entry = b.entry)"""
    steps = [line.format(n=n, k=n + 1) for n in range(rounds) for line in (assign, refine)] + [assign.format(n=rounds)]
    return f"""
WITH r AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE {_FINITE}),
v AS MATERIALIZED (SELECT vec_id, part, list_slice(x, 8 * part + 1, 8 * part + 8) AS x FROM r, (SELECT unnest(range(8)) AS part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM r ORDER BY vec_id LIMIT 16),
b0 AS MATERIALIZED (SELECT part, entry, x FROM v JOIN f USING (vec_id)),
{", ".join(steps)},
e AS (SELECT vec_id, string_agg(lpad(format('{{:x}}', entry), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
l AS (SELECT r.label, sum(error)::BIGINT AS label_error FROM e JOIN r USING (vec_id) GROUP BY r.label),
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT r.vec_id, code, error, label_error, codebooks_sha256 FROM r JOIN e USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM r.label, s
"""


@query("op12_vector_codes", _codes_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    listed = ",".join(map(str, books.entries.ravel().tolist())) if books else ""
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return done.select("vec_id", code.alias("code"), "error", "label_error", F.lit(hashlib.sha256(listed.encode()).hexdigest()).alias("codebooks_sha256"))


NEGATIVES_SQL = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
p AS MATERIALIZED (SELECT a.vec_id AS a, o.vec_id AS o, a.label = o.label AS same, list_dot_product(a.x, o.x)::BIGINT AS score
  FROM r a JOIN r o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0),
best AS (SELECT a, o, score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, o) <= 5)
SELECT a AS anchor_id, best.o AS positive_id, CAST(row_number() OVER (PARTITION BY a, best.o ORDER BY p.score DESC, p.o) AS INTEGER) AS rank,
  p.o AS negative_id, best.score AS positive_score, p.score AS negative_score
FROM best JOIN p USING (a) WHERE NOT same AND 30 * best.score <= 100 * p.score AND 100 * p.score <= 90 * best.score
QUALIFY rank <= 10
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=10, least=30, most=90, scale=256)


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
