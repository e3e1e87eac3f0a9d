"""Isolation-forest anomaly scores that learn from earlier rows only.

Every tree sees a small hash-chosen sample, so the forests grow in parallel on tiny groups. The
node tables are bounded by forests x trees x sample size and are broadcast for scoring.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.scalars import finite
from hindcast.operators.modelling import filled
from hindcast.operators.ordered import quantiles
from hindcast.operators.splits import proportional_folds
from hindcast.session import written

NODES = "forest int, tree int, node int, feature int, threshold double, left int, right int, size int, depth int"
BUCKETS = 10**9
#: Finer, for shares of 1e12 rows; places up to here are exact in a double.
FINE_BUCKETS = 2**52


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 200
    sample: int = 256
    contamination: float = 0.035
    seed: int = 42


def average_path(n):
    """Mean path length of an unsuccessful search in a binary tree of n values."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forests:
    """Forests by id, with the medians and the score offset each learnt from its own rows."""

    features: list[str]
    settings: ForestSettings
    medians: dict[int, dict[str, float | None]]
    nodes: pd.DataFrame
    offsets: dict[int, float]

    def raw_scores(self, rows: DataFrame, members: dict[int, Column], keep: tuple[str, ...]) -> DataFrame:
        """2 ** (-mean path / expected path) as ``raw_<forest>``, for each forest whose condition the row meets (else NULL).

        A row meets all its forests in one pass; it is not repeated for each of them.
        """
        prepared = rows.select(
            *keep,
            *(finite(F.col(f).cast("double")).alias(f"_x{i}") for i, f in enumerate(self.features)),
            *(F.coalesce(c, F.lit(False)).alias(f"_in{f}") for f, c in members.items()),
        )
        trees = rows.sparkSession.sparkContext.broadcast(_packed(self.nodes))
        width = len(self.features)
        fills = {f: [self.medians[f][x] or 0.0 for x in self.features] for f in members}
        schema = prepared.select(*keep).schema
        for f in members:
            schema = schema.add(f"raw_{f}", "double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = [batch.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(width)]
                columns = [batch.column(c) for c in keep]
                for f, fill in fills.items():
                    mine = np.flatnonzero(batch.column(f"_in{f}").to_numpy(zero_copy_only=False))
                    result = np.full(batch.num_rows, np.nan)
                    if len(mine):
                        # Arrow hands NULLs over as NaN.
                        values = [np.where(np.isnan(v[mine]), m, v[mine]) for v, m in zip(x, fill, strict=True)]
                        result[mine] = _score(trees.value[f], np.concatenate(values), len(mine))
                    columns.append(pa.array(result, pa.float64(), from_pandas=True))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(f"raw_{f}" for f in fills)])

        return prepared.mapInArrow(run, schema)

    def score(self, rows: DataFrame, forest: Column, keep: tuple[str, ...]) -> DataFrame:
        """Anomaly score per row, larger is more anomalous; 0 is the contamination threshold.

        A table that compresses well is few file splits; the rows are dealt out anew before the trees are walked.
        """
        marked = rows.select(*dict.fromkeys((*keep, *self.features)), forest.cast("int").alias("_which")).repartition(keep[0])
        made = self.raw_scores(marked, {f: F.col("_which") == f for f in self.medians}, keep)
        score = F.coalesce(*(F.col(f"raw_{f}") - F.lit(o) for f, o in self.offsets.items()))
        return made.select(*keep, score.alias("anomaly_score"))


def fit_forests(
    rows: DataFrame, key: str, features: list[str], members: dict[int, Column], settings: ForestSettings = ForestSettings()
) -> Forests:
    """One forest per member condition, each fitted on the rows that satisfy it."""
    if not features:
        raise ValueError("anomaly scoring needs at least one numeric feature")
    # Read several times below, by as many tasks as there are cores, however few splits the source has.
    flags = {f: F.col(f"_member{f}") for f in members}
    plain = rows.select(key, *(F.col(x) for x in features if x != key), *(c.alias(f"_member{f}") for f, c in members.items()))
    rows, members = written(plain.repartition(key)), flags
    counts = rows.agg(*(F.count_if(c).alias(str(f)) for f, c in members.items())).first().asDict()
    empty = [f for f in members if not counts[str(f)]]
    if empty:
        raise ValueError(f"forests {empty} have no training rows")
    values = {(f, x): F.when(c, finite(F.col(x).cast("double"))) for f, c in members.items() for x in features}
    found = quantiles(rows, values, [0.5])
    medians = {f: {x: found[f, x][0] for x in features} for f in members}
    # Draw a little more than the sample per tree, from all rows; each tree keeps its smallest hashes.
    wanted = settings.sample + 6 * math.sqrt(settings.sample) + 10
    picks = [_picks(key, f, condition, min(1.0, wanted / counts[str(f)]), settings) for f, condition in members.items()]
    drawn = rows.select(
        "*", F.explode(F.concat(*picks)).alias("_pick")
    ).select(
        "_pick.forest", "_pick.tree", "_pick.draw",
        *(
            F.coalesce(*(F.when(F.col("_pick.forest") == f, filled(c, m[c])) for f, m in medians.items())).alias(f"_x{i}")
            for i, c in enumerate(features)
        ),
    )
    width, sample, seed = len(features), settings.sample, settings.seed

    def grow(key_values: tuple, group: pd.DataFrame) -> pd.DataFrame:
        forest, tree = (int(v) for v in key_values)
        x = group.sort_values("draw", kind="stable").head(sample)[[f"_x{i}" for i in range(width)]].to_numpy(dtype=float)
        nodes = _grow(x, np.random.default_rng([seed, forest, tree]), math.ceil(math.log2(max(sample, 2))))
        nodes.insert(0, "tree", tree)
        nodes.insert(0, "forest", forest)
        return nodes

    nodes = drawn.groupBy("forest", "tree").applyInPandas(grow, NODES).toPandas()
    forests = Forests(features, settings, medians, nodes, dict.fromkeys(members, 0.0))
    forests.offsets = _offsets(forests, rows, key, members)
    return forests


def _picks(key: str, forest: int, condition: Column, share: float, settings: ForestSettings) -> Column:
    """The trees of one forest that draw this row, each with the hash that decided it.

    Every tree draws its share of all rows. While the trees together draw less than every row, one hash per row is enough:
    the unit interval holds a stretch of that share for each tree, and the rest belongs to none. A row then serves one tree
    of a forest at most. With larger shares the table is small, and each tree has a hash of its own.
    """
    nothing = F.array().cast("array<struct<forest:int,tree:int,draw:bigint>>")

    def pick(tree: Column, draw: Column) -> Column:
        return F.struct(F.lit(forest).alias("forest"), tree.cast("int").alias("tree"), draw.alias("draw"))

    if share * settings.trees < 1.0:
        stretch = max(1, int(share * FINE_BUCKETS))
        place = F.pmod(F.xxhash64(F.col(key), F.lit(forest), F.lit(settings.seed)), F.lit(FINE_BUCKETS))
        one = F.array(pick(F.floor(place / stretch), F.pmod(place, F.lit(stretch))))
        return F.when(condition & (place < settings.trees * stretch), one).otherwise(nothing)

    def draw(tree: Column) -> Column:
        return F.pmod(F.xxhash64(F.col(key), F.lit(forest), tree, F.lit(settings.seed)), F.lit(BUCKETS))

    trees = F.sequence(F.lit(0), F.lit(settings.trees - 1))
    chosen = F.filter(trees, lambda t: draw(t) < int(share * BUCKETS))
    return F.when(condition, F.transform(chosen, lambda t: pick(t, draw(t)))).otherwise(nothing)


def _offsets(forests: Forests, rows: DataFrame, key: str, members: dict[int, Column]) -> dict[int, float]:
    """The score that the contamination share of each forest's own training rows exceeds."""
    scored = written(forests.raw_scores(rows, members, (key,)).drop(key))
    columns = {str(f): F.col(f"raw_{f}") for f in members}
    found = quantiles(scored, columns, [1.0 - forests.settings.contamination])
    return {f: found[str(f)][0] for f in members}


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> pd.DataFrame:
    """Random axis-parallel splits until a node is single, constant or at the depth limit."""
    nodes, queue = [], [(np.arange(len(x)), 0, -1, "")]
    while queue:
        rows, depth, parent, side = queue.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][side] = me
        node = {"node": me, "feature": -1, "threshold": 0.0, "left": -1, "right": -1, "size": len(rows), "depth": depth}
        nodes.append(node)
        if depth >= limit or len(rows) < 2:
            continue
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if not len(usable):
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = x[rows, feature] <= threshold
        node["feature"], node["threshold"] = feature, threshold
        queue.append((rows[goes_left], depth + 1, me, "left"))
        queue.append((rows[~goes_left], depth + 1, me, "right"))
    return pd.DataFrame(nodes)


@dataclass(frozen=True)
class _Tree:
    """A tree filled up to equal depth: the nodes of each level from left to right, and a path length for each place below.

    A node that ends earlier has its path length at every place beneath it, whatever the tests on the way.
    """

    levels: list[tuple[np.ndarray, np.ndarray]]
    paths: np.ndarray
    expected: float


def _packed(nodes: pd.DataFrame) -> dict[int, list[_Tree]]:
    packed: dict[int, list[_Tree]] = {}
    for (forest, _), tree in nodes.sort_values("node").groupby(["forest", "tree"]):
        deepest = int(tree["depth"].max())
        levels = [(np.zeros(1 << d, dtype=np.intp), np.zeros(1 << d)) for d in range(deepest)]
        paths, place = np.zeros(1 << deepest), np.zeros(len(tree), dtype=int)
        ends = tree["depth"].to_numpy() + average_path(tree["size"].to_numpy())
        # Parents come before their children.
        for row, end in zip(tree.itertuples(), ends, strict=True):
            at = place[row.node]
            if row.feature >= 0:
                levels[row.depth][0][at], levels[row.depth][1][at] = row.feature, row.threshold
                place[row.left], place[row.right] = 2 * at, 2 * at + 1
            else:
                below = deepest - row.depth
                paths[at << below : (at + 1) << below] = end
        packed.setdefault(int(forest), []).append(_Tree(levels, paths, float(average_path(tree["size"].iloc[0]))))
    return packed


def _score(trees: list[_Tree], x: np.ndarray, n: int) -> np.ndarray:
    """Scores of n rows, whose features stand one after the other in ``x``; one step a level for all rows."""
    paths, expected = np.zeros(n), 0.0
    rows, at, index = np.arange(n), np.empty(n, dtype=np.intp), np.empty(n, dtype=np.intp)
    value, threshold, right = np.empty(n), np.empty(n), np.empty(n, dtype=bool)
    for tree in trees:
        at[:] = 0
        # All places are within bounds; mode "clip" spares numpy a copy.
        for features, thresholds in tree.levels:
            np.take(features * n, at, out=index, mode="clip")
            np.add(index, rows, out=index)
            np.take(x, index, out=value, mode="clip")
            np.take(thresholds, at, out=threshold, mode="clip")
            np.greater(value, threshold, out=right)
            np.add(at, at, out=at)
            np.add(at, right, out=at)
        paths += np.take(tree.paths, at, mode="clip")
        expected += tree.expected
    return np.exp2(-paths / max(expected, 1e-12))


def forest_summary(forests: Forests, rows: DataFrame) -> DataFrame:
    """Nodes, depth and sample size per tree."""
    made = forests.nodes.groupby(["forest", "tree"]).agg(
        nodes=("node", "size"), depth=("depth", "max"), sample_size=("size", "max")
    )
    return rows.sparkSession.createDataFrame(made.reset_index().astype("int64"))


def out_of_fold_scores(
    train: DataFrame, later: DataFrame, key: str, time: str, features: list[str], folds: int = 5,
    settings: ForestSettings = ForestSettings(),
) -> DataFrame:
    """Training fold f scored by a forest of folds before f (fold 0 NULL); later rows by all of train."""
    tagged = proportional_folds(train, time, folds, "_fold")
    members = {f: F.col("_fold") < f for f in range(1, folds + 1)}
    forests = fit_forests(tagged, key, features, members, settings)
    both = tagged.unionByName(later.withColumn("_fold", F.lit(folds)))
    which = F.when(F.col("_fold") > 0, F.col("_fold"))
    return forests.score(both, which, (key, "_fold")).select(key, F.col("_fold").alias("fold"), "anomaly_score")
