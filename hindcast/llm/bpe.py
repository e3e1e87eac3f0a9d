"""Byte-level BPE: ranked merges folded over the bytes of distinct words by higher-order functions, and decoding.

A text is cut into words by the tokenizer's pattern, and the corpus' distinct words are counted. The most frequent ones are
merged once each by a fold over their bytes, with the ranks as a literal; their ids become a table of bounded size. Words
beyond the table are merged where they stand, by the same rule on a heap: Spark evaluates a fold node by node, more than a
tenth of a millisecond a word, too slow for words that come once. Which words are in the table changes the time, never the
ids. No text is shuffled. Decoding concatenates the pieces of a literal array.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm.common import KEPT_WORDS, kept, shape

#: Words that are merged once for all documents; the most frequent ones of the whole corpus.
FREQUENT = 1 << 17
#: Bytes of a word up to which the fold is used: it copies arrays, so its time grows with the square of the length.
FOLDED_BYTES = 512
#: Words that a task folds.
FOLDED_WORDS = 1 << 13
#: Words that a worker looks up together; a longer text is looked up alone.
PIECE_WORDS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: a line holds the bytes in base64 and the rank, which is also the id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def rank_table(ranks: dict[bytes, int]) -> tuple[Column, int]:
    """The ranks as a constant array of small maps, and its length.

    Looking up a key in one of Spark's maps compares it with all keys, so an entry lies in the map that the checksum of its
    key names. Bytes are written as the characters U+0000 to U+00FF.
    """
    slots = 1 << max(1, len(ranks)).bit_length()
    table: list[dict[str, int] | None] = [None] * slots
    for token, rank in ranks.items():
        key = token.decode("latin-1")
        at = zlib.crc32(key.encode()) % slots
        table[at] = (table[at] or {}) | {key: rank}
    return F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>"), slots


def folded(word: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of a word: the word's own rank, or else the ranks of what is left when no two neighbours merge.

    Each step merges the leftmost of the neighbours whose joint rank is lowest; only the ranks of the two pairs beside the
    merged one are looked up again.
    """
    literal, slots = rank_table(ranks)

    def of(table: Column) -> Column:
        def rank(token: Column) -> Column:
            return F.try_element_at(F.get(table, (F.crc32(token) % slots).cast("int")), token)

        def step(state: Column, _: Column) -> Column:
            parts, joint = state["parts"], state["joint"]

            def merged(at: Column) -> Column:
                made = F.concat(F.get(parts, at - 1), F.get(parts, at))
                # Nulls stand at both ends of the parts, and what is joined with them has no rank.
                beside = F.array(rank(F.concat(F.get(parts, at - 2), made)), rank(F.concat(made, F.get(parts, at + 1))))
                next_parts = F.concat(F.slice(parts, 1, at - 1), F.array(made), F.slice(parts, at + 2, F.size(parts)))
                next_joint = F.concat(F.slice(joint, 1, at - 2), beside, F.slice(joint, at + 2, F.size(joint)))
                return F.when(at.isNull(), state).otherwise(F.struct(next_parts.alias("parts"), next_joint.alias("joint")))

            return _named(F.array_position(joint, F.array_min(joint)).cast("int"), merged)

        def merged(parts: Column) -> Column:
            joint = F.zip_with(F.slice(parts, 1, F.size(parts) - 1), F.slice(parts, 2, F.size(parts) - 1), lambda a, b: rank(F.concat(a, b)))
            done = F.aggregate(F.sequence(F.lit(1), F.size(parts)), F.struct(parts.alias("parts"), joint.alias("joint")), step)["parts"]
            return F.transform(F.slice(done, 2, F.size(done) - 2), rank)

        end = F.array(F.lit(None).cast("string"))
        whole = F.decode(word.cast("binary"), "ISO-8859-1")
        own = rank(whole)
        return F.when(own.isNotNull(), F.array(own)).otherwise(_named(F.concat(end, F.split(whole, ""), end), merged))

    return _named(literal, of)


def _named(value: Column, use) -> Column:
    """``use(value)``, evaluating ``value`` once however often it is used: a list of one element gives it a name."""
    return F.get(F.transform(F.array(value), use), 0)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a word, by the merges of ``folded``."""
    if word in ranks:
        return [word]
    if len(word) > FOLDED_BYTES:
        return _merged_long(word, ranks)
    none = 1 << 32
    parts = [word[i : i + 1] for i in range(len(word))]
    joint = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while joint and (low := min(joint)) < none:
        at = joint.index(low)
        made = parts[at] = parts[at] + parts.pop(at + 1)
        del joint[at]
        if at < len(joint):
            joint[at] = ranks.get(made + parts[at + 1], none)
        if at:
            joint[at - 1] = ranks.get(parts[at - 1] + made, none)
    return parts


def _merged_long(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same on a heap, in time that hardly grows faster than the word."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(ranks[word[i : i + 2]], i, 2) for i in range(len(word) - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)

    def offer(at: int) -> None:
        both = parts[at] + parts[after[at]]
        if both in ranks:
            heapq.heappush(heap, (ranks[both], at, len(both)))

    while heap:
        rank, at, length = heapq.heappop(heap)
        if parts[at] is None or after[at] >= len(parts) or len(parts[at]) + len(parts[after[at]]) != length:
            continue  # one of the two has been merged since
        gone = after[at]
        parts[at], parts[gone] = parts[at] + parts[gone], None
        after[at] = after[gone]
        if after[at] < len(parts):
            before[after[at]] = at
            offer(at)
        if before[at] >= 0:
            offer(before[at])
    return [part for part in parts if part is not None]


@cache
def _known(category: str) -> str:
    """All characters of a general category, as the tokenizer library knows them."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = tiktoken.Encoding("bytes", pat_str=rf"\p{{{category}}}+", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return bytes(single.encode_ordinary(every)).decode()


def cut(text: Column, pattern: str, spark: SparkSession) -> Column:
    """The matches of ``pattern`` in a text, as the tokenizer library finds them.

    Java's Unicode tables may be older: texts with characters that it doesn't know are cut by a pattern to whose letters and
    numbers the missing ones are added, which takes longer.
    """
    wider = pattern
    for category in sorted(set(re.findall(r"\\p\{(\w+)\}", pattern))):
        missing = spark.range(1).select(F.regexp_replace(F.lit(_known(category)), F.lit(rf"\p{{{category}}}+"), F.lit("")).alias("c")).first()["c"]
        ranges: list[list[int]] = []
        for code in map(ord, missing):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
        more = "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in ranges)
        wider = wider.replace(rf"\p{{{category}}}", rf"[\p{{{category}}}{more}]")
    usual, careful = (F.regexp_extract_all(text, F.lit(f"(?U){p}"), F.lit(0)) for p in (pattern, wider))
    return F.when(text.rlike(r"\p{Cn}"), careful).otherwise(usual)


def byte_strings(words: pa.Array) -> list[bytes | None]:
    """The bytes of strings, made by one loop inside Arrow; ``to_pylist`` makes a scalar for each of them first."""
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


class _Ids(dict):
    """word -> its ids as bytes; words beyond the frequent ones are remembered as long as they are not too many."""

    def __init__(self, frequent: dict[bytes, bytes], ranks: dict[bytes, int]):
        super().__init__(frequent)
        self.frequent, self.ranks = frequent, ranks
        self.ids = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= len(self.frequent) + KEPT_WORDS:
            self.clear()
            self.update(self.frequent)
        made = b"".join(map(self.ids.__getitem__, merged(word, self.ranks)))
        if len(word) <= FOLDED_BYTES:
            self[word] = made
        return made


def _frequent(texts: DataFrame, pattern: str) -> DataFrame:
    """The words of all texts, the most frequent first.

    What stands between two spaces is counted first, which is cheaper than the pattern, and cut once for all its places.
    """
    units = texts.select(F.explode(F.split("text", " ")).alias("unit")).where(F.octet_length("unit") < FOLDED_BYTES)
    counted = units.groupBy("unit").agg(F.count(F.lit(1)).alias("times"))
    words = counted.select("times", F.explode(cut(F.concat(F.lit(" "), "unit"), pattern, texts.sparkSession)).alias("word"))
    return words.groupBy("word").agg(F.sum("times").alias("times")).orderBy(F.col("times").desc(), "word").select("word")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id and ids (array of int) of each row's whole text.

    Each match of ``pattern`` is encoded by itself: its own id if it is a token, else its bytes, of which the neighbours with
    the lowest rank, the leftmost of these first, merge until none has a rank. Every byte must have a rank. There are no
    special tokens. A null or empty text has no ids; characters outside every match are dropped, as the pattern says; bytes
    that are no UTF-8 count as U+FFFD. Repeated rows and null doc_ids are rows like others, a text of any length is one row,
    an empty table gives an empty result, and other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", cut(text, pattern, docs.sparkSession).alias("words"))
    top = kept(_frequent(docs.select(text.alias("text")), pattern).limit(frequent))
    tasks = 1 + frequent // FOLDED_WORDS
    found = top.repartition(tasks).select("word", folded(F.col("word"), ranks).alias("ids")).collect()  # at most ``frequent`` rows
    known = {row["word"].encode(): np.array(row["ids"], "<i4").tobytes() for row in found}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(known, ranks)
        for batch in batches:
            column = batch.column(1)
            starts = column.offsets.to_numpy()
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(starts, starts[low] + PIECE_WORDS, "right")) - 1)
                flat = byte_strings(column.values.slice(starts[low], starts[high] - starts[low]))
                made = [b"".join(map(ids.__getitem__, flat[a:b])) for a, b in zip(starts[low:high] - starts[low], starts[low + 1 : high + 1] - starts[low], strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(m) // 4 for m in made])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists], names=["doc_id", "ids"])
                low = high

    return rows.mapInArrow(look_up, shape(rows, "doc_id", ids="array<int>"))


def _joined(ids: Column, texts: dict[int, str]) -> Column:
    """The texts of ids in a row."""
    table = F.from_json(F.lit(json.dumps([texts.get(i) for i in range(max(texts, default=-1) + 1)])), "array<string>")
    return F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that ids stand for: the pieces of all ids, concatenated. Null ids give null."""
    return F.unhex(_joined(ids, {rank: token.hex() for token, rank in ranks.items()}))


def little_endian(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The ids as unsigned 32-bit integers, lowest byte first."""
    return F.unhex(_joined(ids, {rank: rank.to_bytes(4, "little").hex() for rank in ranks.values()}))
