"""Vector codes and hard negatives against plain Python."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hindcast.llm import hard_negatives, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, ints string, error string, row int, windows int"


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    cut = lambda v: [(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)]
    split = [(i, cut(v), label) for i, v, label in kept]
    first = [c for _, c, _ in sorted(((i is None, i or 0, v), cut(v), 0) for i, v, _ in kept)[:entries]]
    books = [[c[p] for c in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, c, _ in split:
                members.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(members[e]) for x in zip(*members[e], strict=True)] if e in members else entry for e, entry in enumerate(books[p])]
    out = []
    for i, c, label in split:
        best = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, label, [e for _, e in best], sum(d for d, _ in best)))
    totals = {}
    for _, label, _, error in out:
        totals[label] = totals.get(label, 0) + error
    return [(i, label, codes, error, totals[label]) for i, label, codes, error in out], books


def vectors(seed, n, dims=24):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        label = draw.choice([0, 1, 2, 3, None]) if draw.random() < 0.9 else 0
        vector = [float(np.float32(x + draw.gauss(0, 0.4))) for x in centres[(label or 0) % 5]]
        rows.append((i, vector, label))
    rows[3] = (3, rows[2][1], 1)
    rows[4] = (4, [0.0] * dims, 2)
    rows[5] = (5, None, 1)
    rows[6] = (6, [None] + [0.5] * (dims - 1), 1)
    rows[7] = (7, [math.nan] * dims, 1)
    rows[8] = (8, [math.inf] + [0.5] * (dims - 1), None)
    rows.append((None, rows[2][1], 2))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1, 1) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("n", "dims"), [(120, 24), (12, 24), (60, 21)])
def test_codes(spark, n, dims):
    rows = vectors(1, n, dims)
    if dims == 21:  # of different lengths, with ties and repeats
        rows = [(i, v if v is None or i is None or i % 3 else v[: i % 19], label) for i, v, label in rows] + [rows[2], rows[20]]
    done, books = vector_codes.compress(frame(spark, rows))
    want, entries = plain_codes(rows)
    order = lambda r: (r[0] is None, r[0] or 0, str(r))
    assert sorted(map(tuple, done.collect()), key=order) == sorted(want, key=order)
    assert books.entries.tolist() == entries


def test_codes_of_large_components(spark):
    rows = [(i, [float(2**36 + i * 2**14), float(-(2**36)), 1.0, 0.0], 0) for i in range(40)]
    done, books = vector_codes.compress(frame(spark, rows), parts=2)
    want, entries = plain_codes(rows, parts=2)
    assert books.entries.tolist() == entries
    fits = lambda x: x if x < 2**63 else None
    assert sorted(map(tuple, done.collect())) == [(i, label, codes, fits(error), fits(total)) for i, label, codes, error, total in want]
    with pytest.raises(ValueError, match="beyond"):
        vector_codes.compress(frame(spark, [(1, [1e30, 0.0], 0)]))


def test_codes_without_rows(spark):
    done, books = vector_codes.compress(frame(spark, [(1, None, 0), (2, [math.nan], 1)]))
    assert books is None and done.columns == ["vec_id", "label", "codes", "error", "label_error"] and done.count() == 0
    done, books = vector_codes.compress(frame(spark, [(1, [], 0), (2, [], None)]))
    assert [tuple(r) for r in done.orderBy("vec_id").collect()] == [(1, 0, [0] * 8, 0, 0), (2, None, [0] * 8, 0, 0)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 6), st.integers(1, 20), st.integers(0, 2**32))
def test_early_elimination_is_exact(width, k, n, seed):
    draw = np.random.default_rng(seed)
    points, entries = draw.integers(-3, 4, (n, width)), draw.integers(-3, 4, (k, width))
    full = 1 << max(0, width - 1).bit_length()
    codes, scaled = vector_codes.nearest_entries(vector_codes.transformed(points), vector_codes.transformed(entries))
    distances = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    assert codes.tolist() == distances.argmin(axis=1).tolist()
    assert (scaled == full * distances.min(axis=1)).all()


def test_sequency():
    order = vector_codes.sequency_order(8)
    turned = vector_codes.transformed(np.eye(8, dtype=np.int64))
    assert sorted(order.tolist()) == list(range(8))
    assert ((np.diff(turned, axis=0) != 0).sum(axis=0) == np.arange(8)).all()


def plain_negatives(rows, ask, positives=5, negatives=10):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, (i, v, label) in enumerate(kept):
        if i is None or not ask(i):
            continue
        scored = [(score(v, w), j, other == label) for b, (j, w, other) in enumerate(kept) if b != a]
        for p, j, same in sorted((s for s in scored if s[2]), key=order)[:positives]:
            inside = sorted((s for s in scored if not s[2] and 30 * p <= 100 * s[0] <= 90 * p), key=order)[:negatives]
            out += [(i, j, r + 1, n, p, s) for r, (s, n, _) in enumerate(inside)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_negatives(spark, monkeypatch, small):
    rows = vectors(4, 160)
    rows = [(i, v if v is None or i != 30 else v[:7], label) for i, v, label in rows] + [(20, rows[21][1], 3), (40, rows[40][1], rows[40][2]), rows[42]]
    if small:  # many blocks and chunks, so that windows are raised first
        for name, value in (("BLOCK_ROWS", 20), ("BLOCK_ANCHORS", 3), ("CELL_ROWS", 3), ("FIRST_SHARE", 4), ("_HELD", 2)):
            monkeypatch.setattr(hard_negatives, name, value)
    done = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 4 == 0)
    assert done.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, done.collect()), key=key) == sorted(plain_negatives(rows, lambda i: i % 4 == 0), key=key)


def test_negatives_of_odd_tables(spark):
    mine = lambda rows: hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 2 == 0)
    assert mine([(2, None, 1), (4, [math.nan], 1), (6, [1.0], None)]).count() == 0
    assert mine([(2, [1.0], 1)]).count() == 0
    assert mine([(2, [], 1), (4, [], 1), (6, [], 2)]).count() == 2  # all scores are zero
    assert sorted(map(tuple, mine([(2, [0.0, 0.0], 1), (3, [0.0, 0.0], 1), (5, [1.0, 0.0], 2)]).collect())) == [(2, 3, 1, 5, 0, 0)]
    with pytest.raises(ValueError, match="beyond"):
        mine([(2, [1e20], 1)])


def test_bounds_hold():
    draw = np.random.default_rng(5)
    values = np.floor(draw.normal(size=(600, 16)) * np.repeat(draw.uniform(1, 3000, 60), 10)[:, None])
    values[7] = 0
    values[100:110] = values[100] * 3
    norms = np.sqrt((values * values).sum(axis=1))
    references = hard_negatives.reference_directions(values)
    angles = hard_negatives.angles_to(values, norms, references)
    cuts = np.arange(0, 600, 10)
    windows = [f.reduceat(x, cuts) for x in (angles, norms) for f in (np.minimum, np.maximum)]
    lower, upper = hard_negatives.score_bounds(angles, norms, windows[0], windows[1], windows[2], windows[3])
    scores = (values @ values.T).reshape(600, 60, 10)
    assert (scores >= lower[:, :, None]).all() and (scores <= upper[:, :, None]).all()
    assert (upper - lower < 2 * norms[:, None] * windows[3]).mean() > 0.5
