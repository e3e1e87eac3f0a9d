"""Component sizes of a growing graph, just before any time.

Boruvka's rounds: every component picks its earliest outgoing edge, and the picks merge components. Edges are ordered by
their first time and then by their ends, so along the picks the edges only get earlier, down to the one that two components
pick from both sides. Hence, for a node that lies in component c0 (itself), then c1, c2, ... with picks p0, p1, p2, ...:

* before time t the node has left cr only if p0, ..., pr are all earlier than t, and
* when the first pick that is not earlier is that of cr, its component at t is made of the nodes of cr whose own picks up to
  that level are all earlier than t.

So a size is a count of earlier values within (level, component), which ``before`` computes for groups of any size. There are
at most log2(nodes) rounds, and no walk over the edges in time order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.operators.ordered import before
from hindcast.session import written


def forest_levels(edges: DataFrame) -> list[DataFrame]:
    """For each round (comp, picked, up): the components with an outgoing edge, its time, and what they merge into.

    Edges (u, v, t) are distinct pairs; loops are ignored. The components of the first round are the nodes.
    """
    levels = []
    current = written(edges.where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b"), "t", "u", "v"))
    while not current.isEmpty():
        turned = current.select(F.col("b").alias("a"), F.col("a").alias("b"), "t", "u", "v")
        earliest = current.unionByName(turned).groupBy("a").agg(F.min(F.struct("t", "u", "v", "b")).alias("p"))
        picks = written(earliest.select(F.col("a").alias("comp"), F.col("p.t").alias("picked"), F.col("p.b").alias("next")))
        up = _merged(picks)
        levels.append(written(picks.join(up, "comp").select("comp", "picked", "up")))
        current = written(_between(current, up))
    return levels


def _merged(picks: DataFrame) -> DataFrame:
    """(comp, up): the component that two members of a merge pick from both sides, named by the smaller of the two."""
    back = picks.select(F.col("comp").alias("next"), F.col("next").alias("after"))
    own = (F.col("after") == F.col("comp")) & (F.col("comp") < F.col("next"))
    up = picks.join(back, "next").select("comp", F.when(own, F.col("comp")).otherwise(F.col("next")).alias("up"))
    while True:
        # Each turn doubles the steps taken twice: the ends are reached after log4(longest chain of picks) turns.
        near = _jump(up)
        ahead = written(_jump(near).withColumn("moved", F.col("up") != F.col("before")))
        up = ahead.select("comp", "up")
        if ahead.where("moved").isEmpty():
            return up


def _jump(up: DataFrame) -> DataFrame:
    """(comp, up, before): where ``up`` leads, and where it led before."""
    there = up.select(F.col("comp").alias("before"), F.col("up").alias("further"))
    return up.select("comp", F.col("up").alias("before")).join(there, "before").select("comp", F.col("further").alias("up"), "before")


def _between(current: DataFrame, up: DataFrame) -> DataFrame:
    """The earliest edge between any two merged components."""
    ends = (up.select(F.col("comp").alias(side), F.col("up").alias(f"{side}_up")) for side in ("a", "b"))
    moved = current.join(next(ends), "a").join(next(ends), "b").where("a_up <> b_up")
    pair = (F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
    earliest = moved.groupBy(*pair).agg(F.min(F.struct("t", "u", "v")).alias("first"))
    return earliest.select("a", "b", "first.t", "first.u", "first.v")


def component_sizes(edges: DataFrame, probes: DataFrame) -> DataFrame:
    """(node, t, component_size) for each distinct probe (node, t): nodes in its component over edges (u, v, t) before t.

    A node without an earlier edge has size 0. Edges must be distinct pairs with their first time; loops count for nothing.
    """
    levels = forest_levels(edges)
    unseen = F.lit(0).cast("long").alias("component_size")
    if not levels:
        return probes.select("node", "t", unseen)
    paths = levels[0].select(F.col("comp").alias("node"), F.col("picked").alias("p0"), F.col("up").alias("c1"))
    for r, level in enumerate(levels[1:], 1):
        step = level.select(F.col("comp").alias(f"c{r}"), F.col("picked").alias(f"p{r}"), F.col("up").alias(f"c{r + 1}"))
        paths = paths.join(step, f"c{r}", "left")
    depth = len(levels)
    picks = F.array(*(F.col(f"p{r}") for r in range(depth)))
    paths = written(paths.select("node", picks.alias("picks"), F.array(*(F.col(f"c{r}") for r in range(1, depth + 1))).alias("comps")))

    found = probes.select("node", "t").join(paths, "node", "left")
    late = F.array_position(F.transform("picks", lambda p: F.coalesce(p < F.col("t"), F.lit(False))), False).cast("int")
    level = F.when(late == 0, F.lit(depth)).otherwise(late - 1)
    found = found.withColumn("level", F.coalesce(level, F.lit(0))).withColumn("comp", F.when(F.col("level") > 0, F.get("comps", F.col("level") - 1)))
    found = written(found.select("node", "t", "level", "comp"))

    reached = F.posexplode("comps").alias("at", "comp")
    members = paths.select("picks", reached).where("comp is not null")
    latest = F.array_max(F.slice("picks", 1, F.col("at") + 1)).alias("t")
    counted = members.select((F.col("at") + 1).alias("level"), "comp", latest).groupBy("level", "comp", "t").agg(F.count(F.lit(1)).alias("n"))
    asked = found.where("level > 0").select("node", "t", "level", "comp", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asks"))
    both = written(asked.unionByName(counted.withColumn("asks", F.lit(False)), allowMissingColumns=True))
    sizes = before(both, ("level", "comp"), "t", {"component_size": "n"}, probe="asks")
    return sizes.select("node", "t", "component_size").unionByName(found.where("level = 0").select("node", "t", unseen))
