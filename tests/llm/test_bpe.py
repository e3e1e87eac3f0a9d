"""Byte-level BPE against the tokenizer library, and the fold against the heap."""

import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from hindcast.llm import bpe

SCHEMA = "doc_id long, text string, ids string, words int, word string"
TEXTS = [
    None, "", " ", "a", "\n", "  \n\t  x", "it's 'S 'LL we'll ok", "Ünïcödé straße ſ K", "日本語のテキスト、русский", "👩‍👩‍👧 é ​",
    "ࡰࡱ \U0001e4d0\U0001e4f0 \U00031350 ꟁx", "\x00\x1c\x85 y", "x" * 3000 + " " * 700 + "ab" * 400, "12345678901234567890 ½ Ⅷ ²", " the the the", "a  b \n\n c   ",
    "<|endoftext|> �", " 　᠎",
]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("frequent", [0, 5, 10_000])
def test_encode(spark, ranks, library, frequent):
    rows = [(i, t, "clash", 0, "w") for i, t in enumerate(TEXTS)] + [(None, "no id", "", 0, ""), (3, TEXTS[3], "clash", 0, "w")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    done = bpe.encode(docs, ranks, public_tokenizers.PATTERN, frequent)
    got = done.select("doc_id", "ids", bpe.decoded(F.col("ids"), ranks).alias("bytes"), bpe.little_endian(F.col("ids"), ranks).alias("le")).collect()
    want = sorted((-1 if i is None else i, library.encode_ordinary(t or "")) for i, t, *_ in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in got) == want
    for row in got:
        assert bytes(row["bytes"]) == library.decode_bytes(row["ids"])
        assert bytes(row["le"]) == np.array(row["ids"], "<u4").tobytes()


def test_empty_table(spark, ranks):
    done = bpe.encode(spark.createDataFrame([], SCHEMA), ranks, public_tokenizers.PATTERN)
    assert done.columns == ["doc_id", "ids"] and done.count() == 0


def test_very_long_text(spark, ranks, library):
    text = "lorem ipsum, dolor 42! " * 40_000 + "z" * 50_000
    row = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), ranks, public_tokenizers.PATTERN, 100).first()
    assert row["ids"] == library.encode_ordinary(text)


def test_fold_equals_library(spark, ranks, library):
    draw = np.random.default_rng(3)
    letters = list(" abcdefgehinorst") + ["é", "日", "0", "'"]
    words = sorted({"".join(draw.choice(letters, draw.integers(1, 25))) for _ in range(400)} | {" the", "aaaaaaaaaaaaaaaa"})
    got = spark.createDataFrame([(w,) for w in words], "word string").select("word", bpe.folded(F.col("word"), ranks).alias("ids")).collect()
    for row in got:
        assert row["ids"] == [ranks[t] for t in bpe.merged(row["word"].encode(), ranks)] == list(library._core_bpe.encode_single_piece(row["word"].encode()))


def test_own_rank_comes_before_merges(spark):
    # "abc" is a token that no merges reach, as no pair has a rank.
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300}
    docs = spark.createDataFrame([(1, "abc"), (2, "abcd")], "doc_id long, text string")
    for frequent in (0, 10):
        got = dict(bpe.encode(docs, ranks, r"\p{L}+", frequent).collect())
        assert got == {1: [300], 2: [97, 98, 99, 100]}


def test_leftmost_of_equal_ranks(spark):
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaa": 257}
    library = tiktoken.Encoding("own", pat_str=r"\p{L}+", mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame([(n, "a" * n) for n in range(1, 12)], "doc_id long, text string")
    for frequent in (0, 100):
        assert dict(bpe.encode(docs, ranks, r"\p{L}+", frequent).collect()) == {n: library.encode_ordinary("a" * n) for n in range(1, 12)}


def test_words_leave_arrow_in_one_loop():
    """The lookup's words are made by Arrow itself, several times faster than one scalar after the other."""
    words = pa.array([f"wort{i}ß" for i in range(100_000)] + ["", None])
    assert bpe.byte_strings(words) == words.cast(pa.binary()).to_pylist()

    def seconds(make):
        started = time.perf_counter()
        make()
        return time.perf_counter() - started

    one_by_one = min(seconds(lambda: words.cast(pa.binary()).to_pylist()) for _ in range(3))
    assert min(seconds(lambda: bpe.byte_strings(words)) for _ in range(3)) < one_by_one / 2
