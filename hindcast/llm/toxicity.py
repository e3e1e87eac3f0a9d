"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of the categories before it.

While training, those earlier probabilities are out of fold: they come from models that have not seen the row, so that the
later models meet them as they will be on new text. Features are the presence of words and of their beginnings (insults
come with many endings), chosen by their association with any category. The models are fitted on a bounded sample of labelled rows; every document is scored in one scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import KEPT_WORDS, kept, keyed, pieces, shape, texts_of

#: Labelled rows used for fitting: at most so many for each value of the last category, in the order of a hash.
SAMPLE = 2500
#: Words that become features at most, the least number of sampled rows a word must stand in, and the least chi-square
#: (one degree of freedom, chance 1e-4) of a word and some category: words that tell nothing only add noise.
FEATURES, LEAST_ROWS, LEAST_CHI_SQUARE = 4096, 4, 15.1
FOLDS = 5
#: Bytes of the beginnings of a word that are features of their own.
BEGINNINGS = (5, 7, 9)
_PUNCTUATION = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_in(text: bytes | None) -> set[bytes]:
    """The distinct words of a text: A-Z lowered, ASCII letters, digits and all other characters beyond ASCII."""
    return set((text or b"").lower().translate(_PUNCTUATION).split())


def features_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings with a mark that no word holds."""
    return [word, *(b"^" + word[:size] for size in BEGINNINGS if len(word) >= size)]


@dataclass(frozen=True)
class Chain:
    """Fitted models: one row of ``weights`` per category over the features, the earlier categories and the intercept."""

    categories: tuple[str, ...]
    features: dict[bytes, int]
    weights: np.ndarray
    threshold: float
    known: dict[bytes, list[int]] = field(default_factory=dict, repr=False, compare=False)

    def _of(self, word: bytes) -> list[int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            found = self.known[word] = [self.features[f] for f in features_of(word) if f in self.features]
        return found

    def probabilities(self, texts: list[bytes | None]) -> np.ndarray:
        """A row per text, a column per category; texts without words are 0 throughout."""
        found = np.empty((len(texts), len(self.weights)))
        # The word sets of texts take many times their bytes, so those of a piece are let go before the next.
        for low, high in pieces(texts):
            words = [words_in(text) for text in texts[low:high]]
            known = [list({i for word in own for i in self._of(word)}) for own in words]
            found[low:high] = _scores(known, self.weights, len(self.features))
            found[low:high][[not own for own in words]] = 0.0
        return found


def _scores(known: list[list[int]], weights: np.ndarray, n_words: int) -> np.ndarray:
    rows = np.repeat(np.arange(len(known)), [len(k) for k in known])
    columns = np.fromiter((c for k in known for c in k), np.int64, len(rows))
    out = np.empty((len(known), len(weights)))
    for k, w in enumerate(weights):
        score = np.bincount(rows, weights=w[columns], minlength=len(known)) + w[-1]
        out[:, k] = _sigmoid(score + out[:, :k] @ w[n_words : n_words + k])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _fit(rows: np.ndarray, columns: np.ndarray, earlier: np.ndarray, label: np.ndarray, used: np.ndarray, n_words: int, n_earlier: int, penalty: float, steps: int) -> np.ndarray:
    """Logistic regression with an L2 penalty and balanced classes on the ``used`` rows, by accelerated gradient steps.

    The columns of a row are its words; ``earlier`` holds the dense probabilities. The step size follows from the largest
    possible curvature, so the result needs no tuning.
    """
    weights = np.zeros(n_words + n_earlier + 1)
    if len(set(label[used].tolist())) < 2:
        weights[-1] = 8.0 if used.any() and label[used][0] else -8.0
        return weights
    share = np.where(label == 1, 0.5 / max(1, (label[used] == 1).sum()), 0.5 / max(1, (label[used] == 0).sum())) * used
    pick = used[rows]
    rows, columns = rows[pick], columns[pick]
    norms = np.bincount(rows, minlength=len(label)) + n_earlier + 1
    step = 1.0 / (0.25 * float((share * norms).sum()) + penalty)
    at, before = weights.copy(), weights.copy()
    for k in range(steps):
        score = np.bincount(rows, weights=at[columns], minlength=len(label)) + earlier @ at[n_words:-1] + at[-1]
        error = (_sigmoid(score) - label) * share
        slope = np.concatenate([np.bincount(columns, weights=error[rows], minlength=n_words), earlier.T @ error, [error.sum()]])
        slope[:-1] += penalty * at[:-1]
        weights = at - step * slope
        at = weights + k / (k + 3) * (weights - before)
        before = weights
    return weights


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE, seed: int = 7, penalty: float = 2e-4, steps: int = 300) -> Chain:
    """Fit on at most ``sample`` labelled rows per value of the last category.

    ``labels`` has doc_id and a 0/1 column per category; rows with a null among them are left out, as are labels without a
    document. The threshold of the last category lies between the out-of-fold scores of its two classes: where most rows
    are told right, and of several such places in the middle. Without labels every probability is nearly 0.
    """
    wanted = labels.select("doc_id", *categories).dropna().withColumn("order", F.xxhash64(F.lit(seed), "doc_id"))
    wanted = kept(wanted.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    last = categories[-1]
    picked = wanted.where(F.col(last) == 1).orderBy("order", "doc_id").limit(sample).union(wanted.where(F.col(last) == 0).orderBy("order", "doc_id").limit(sample))
    picked = kept(picked.drop("order"))  # 2 * sample rows at most: proven small

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted({f for word in words_in(text) for f in features_of(word)}) for text in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.binary())), *batch.columns[2:]], names=["doc_id", "words", *categories])

    joined = keyed(docs).select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", *categories)
    found = joined.mapInArrow(distinct, shape(joined, "doc_id", words="array<binary>", **{c: joined.schema[c].dataType for c in categories}))
    # A repeated doc_id would multiply rows; the sample bounds what is gathered here.
    found = kept(found.dropDuplicates(["doc_id"]))
    uses = found.select(F.explode("words").alias("word"), *categories).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).cast("long")).alias(c) for c in categories)).where(F.col("n") >= LEAST_ROWS)
    totals = found.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in categories)).first()
    n = max(1, totals["n"])
    spread = lambda c: F.col("n") * (n - F.col("n") + 1) * float(max(1, totals[c]) * max(1, n - totals[c]))
    chi = F.greatest(*(n * F.pow(F.col(c) * n - F.col("n") * totals[c], 2) / spread(c) for c in categories), F.lit(0.0))
    chosen = uses.withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI_SQUARE).orderBy(F.desc("chi"), "word").limit(FEATURES).select("word").collect()
    words = {bytes(row["word"]): i for i, row in enumerate(chosen)}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [[words[w] for w in own if w in words] for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known, pa.list_(pa.int32())), *batch.columns[2:]], names=batch.schema.names)

    rows = found.mapInArrow(index, shape(found, "doc_id", words="array<int>", **{c: found.schema[c].dataType for c in categories})).collect()
    return _train(rows, words, tuple(categories), seed, penalty, steps)


def _train(rows: list, words: dict[bytes, int], categories: tuple[str, ...], seed: int, penalty: float, steps: int) -> Chain:
    rows = sorted(rows, key=lambda r: str(r["doc_id"]))
    n_words, n = len(words), len(rows)
    known = [row["words"] for row in rows]
    of = np.repeat(np.arange(n), [len(k) for k in known])
    columns = np.fromiter((c for k in known for c in k), np.int64, len(of))
    fold = np.random.default_rng(seed).integers(0, FOLDS, n)
    earlier = np.zeros((n, 0))
    weights = np.zeros((len(categories), n_words + len(categories)))  # the last column is the intercept
    held = np.zeros(n)
    for k, category in enumerate(categories):
        label = np.array([int(r[category]) for r in rows], float)
        held = np.zeros(n)
        for f in range(FOLDS):
            out = fold == f
            part = _fit(of, columns, earlier, label, ~out, n_words, k, penalty, steps)
            score = np.bincount(of, weights=part[columns], minlength=n) + earlier @ part[n_words:-1] + part[-1]
            held[out] = _sigmoid(score)[out]
        full = _fit(of, columns, earlier, label, np.ones(n, bool), n_words, k, penalty, steps)
        weights[k, : n_words + k] = full[:-1]
        weights[k, -1] = full[-1]
        earlier = np.column_stack([earlier, held])
    return Chain(categories, words, weights, _threshold(held, np.array([int(r[categories[-1]]) for r in rows])))


def _threshold(held: np.ndarray, label: np.ndarray) -> float:
    if len(set(label.tolist())) < 2:
        return 0.5
    order = np.argsort(held, kind="stable")
    scores, truth = held[order], label[order]
    # Right answers when the first i rows are called clean.
    right = np.concatenate([[0], np.cumsum(truth == 0)]) + (truth == 1).sum() - np.concatenate([[0], np.cumsum(truth == 1)])
    best = np.flatnonzero(right == right.max())
    cut = int(best[len(best) // 2])
    low = scores[cut - 1] if cut else 0.0
    high = scores[cut] if cut < len(scores) else 1.0
    return float((low + high) / 2)


def score(docs: DataFrame, chain: Chain, carry: bool = False) -> DataFrame:
    """doc_id, h, one probability column p_<category> each, and ``rejected``: the last one is above the threshold.

    One row per document row. Null and empty texts have probability 0 and are not rejected. With ``carry`` the column
    ``row`` holds the input columns.
    """
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = chain.probabilities(texts_of(batch))
            rejected = found[:, -1] > chain.threshold
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(found[:, k]) for k in range(len(names))), pa.array(rejected), *batch.columns[3:]], names=["doc_id", "h", *names, "rejected", *batch.schema.names[3:]])

    text = F.col("text").cast("string")
    own = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else []
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"), *own)
    made = shape(rows, "doc_id", "h", **dict.fromkeys(names, "double"), rejected="boolean", **({"row": rows.schema["row"].dataType} if carry else {}))
    return rows.mapInArrow(run, made)

