"""Features of the card - device and card - recipient graph as it stood before each transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.scalars import all_of
from hindcast.operators.components import component_sizes
from hindcast.operators.ordered import Layout, before, profile
from hindcast.operators.pit import entity_features, spread_name, spread_unknown
from hindcast.roles import EntityFeatures, Roles
from hindcast.session import written

FAMILIES = ("device", "email")


def edges(rows: DataFrame, roles: Roles = Roles(), card: str = "card", families=FAMILIES) -> DataFrame:
    """(family, card, entity, t) for every link of a transaction; a missing end makes no edge."""
    links = F.explode(
        F.array(*(F.struct(F.lit(f).alias("family"), F.col(f).cast("string").alias("entity")) for f in families))
    )
    spread = rows.where(F.col(card).isNotNull()).select(F.col(card).alias("card"), F.col(roles.time).alias("t"), links.alias("link"))
    return spread.where(F.col("link.entity").isNotNull()).select("link.family", "card", "link.entity", "t")


def first_edges(links: DataFrame) -> DataFrame:
    """Each distinct edge with the time it was first seen."""
    return links.groupBy("family", "card", "entity").agg(F.min("t").alias("t"))


def _prior_count(
    rows: DataFrame, arrivals: DataFrame, group: str, out: str, known: Column, roles: Roles, layout: Layout | None
) -> DataFrame:
    """Number of arrivals (group, t) strictly before each row, NULL where ``known`` is false.

    Arrivals happen at transactions of their group, so a layout of the rows suits both.
    """
    spread = spread_name((group,))
    marked = spread_unknown(rows, (group,), roles.key)
    layout = layout or profile(marked, roles.time, ((group, spread),))
    marked = marked.withColumn("_probe", F.lit(True)).withColumn("_one", F.lit(0).cast("long")).unionByName(
        arrivals.select(
            group,
            F.col("t").alias(roles.time),
            F.lit(0).alias(spread),
            F.lit(False).alias("_probe"),
            F.lit(1).cast("long").alias("_one"),
        ),
        allowMissingColumns=True,
    )
    done = before(marked, (group, spread), roles.time, {out: "_one"}, layout, probe="_probe")
    return done.select(*rows.columns, F.when(known, F.col(out)).alias(out))


def prior_card_degree(
    rows: DataFrame, roles: Roles = Roles(), card: str = "card", families=FAMILIES,
    layout: Layout | None = None, first: DataFrame | None = None,
) -> DataFrame:
    """Distinct earlier neighbours of the card, all families together."""
    first = first if first is not None else first_edges(edges(rows, roles, card, families))
    arrivals = first.select(F.col("card").alias(card), "t")
    return _prior_count(rows, arrivals, card, "card_prior_degree", F.col(card).isNotNull(), roles, layout)


def prior_entity_degree(
    rows: DataFrame, family: str, roles: Roles = Roles(), card: str = "card",
    layout: Layout | None = None, first: DataFrame | None = None,
) -> DataFrame:
    """Distinct earlier cards of the device or recipient."""
    kind = dict(rows.dtypes)[family]
    first = first if first is not None else first_edges(edges(rows, roles, card, (family,)))
    arrivals = first.where(F.col("family") == family).select(F.col("entity").cast(kind).alias(family), "t")
    known = all_of([F.col(card).isNotNull(), F.col(family).isNotNull()])
    return _prior_count(rows, arrivals, family, f"{family}_prior_card_degree", known, roles, layout)


def _pair(card: str, family: str) -> EntityFeatures:
    return EntityFeatures("_pair", (card, family), history=True)


def prior_edge_count(
    rows: DataFrame, family: str, roles: Roles = Roles(), card: str = "card", layout: Layout | None = None
) -> DataFrame:
    """Earlier transactions of the same (card, entity) pair, and whether the pair is new."""
    made = entity_features(rows, _pair(card, family), roles, layout)
    return made.withColumnsRenamed(
        {"history__pair_count": f"card_{family}_prior_edge_count", "is_new__pair": f"is_new_card_{family}"}
    )


def prior_component_sizes(
    rows: DataFrame, roles: Roles = Roles(), card: str = "card", families=FAMILIES
) -> DataFrame:
    """Component size before the transaction for its card and entities; an unseen node has size 0."""
    base = written(rows.select(roles.key, roles.time, card, *families))
    links = first_edges(edges(base, roles, card, families))
    pairs = links.select(
        F.concat(F.lit("card:"), F.col("card").cast("string")).alias("u"),
        F.concat(F.col("family"), F.lit(":"), F.col("entity")).alias("v"),
        "t",
    )
    nodes = {"card": F.when(F.col(card).isNotNull(), F.concat(F.lit("card:"), F.col(card).cast("string")))}
    for f in families:
        both = F.col(card).isNotNull() & F.col(f).isNotNull()
        nodes[f] = F.when(both, F.concat(F.lit(f"{f}:"), F.col(f).cast("string")))
    probes = (
        base.select(F.explode(F.array_compact(F.array(*nodes.values()))).alias("node"), F.col(roles.time).alias("t"))
        .distinct()
    )
    sizes = component_sizes(pairs, probes)
    long = base.select(
        roles.key,
        F.col(roles.time).alias("t"),
        F.explode(
            F.array_compact(
                F.array(*(F.when(n.isNotNull(), F.struct(F.lit(k).alias("part"), n.alias("node"))) for k, n in nodes.items()))
            )
        ).alias("p"),
    ).select(roles.key, "t", "p.part", "p.node")
    found = long.join(sizes, ["node", "t"], "left")
    wide = found.groupBy(roles.key).agg(
        *(
            F.max(F.when(F.col("part") == k, F.col("component_size"))).alias(f"{k}_prior_component_size")
            for k in nodes
        )
    )
    return rows.join(wide, roles.key, "left")


GRAPH_COLUMNS = (
    "card_prior_degree",
    "device_prior_card_degree",
    "email_prior_card_degree",
    "card_device_prior_edge_count",
    "card_email_prior_edge_count",
    "card_prior_component_size",
    "device_prior_component_size",
    "email_prior_component_size",
    "is_new_card_device",
    "is_new_card_email",
)


def graph_features(
    rows: DataFrame, roles: Roles = Roles(), components: bool = True
) -> DataFrame:
    """The ten graph columns beside the key. A NULL time is an error, an empty input keeps the columns."""
    missing = [c for c in (roles.key, roles.time, "card", *FAMILIES) if c not in rows.columns]
    if missing:
        raise ValueError(f"graph features need columns {missing}")
    if not rows.where(F.col(roles.time).isNull()).isEmpty():
        raise ValueError(f"{roles.time} has missing values: a chronological graph needs every time")
    base = rows.select(roles.key, roles.time, "card", *FAMILIES)
    profiled, groups = base, []
    for columns in (("card",), *((f,) for f in FAMILIES), *(("card", f) for f in FAMILIES)):
        profiled = spread_unknown(profiled, columns, roles.key)
        groups.append((*columns, spread_name(columns)))
    layout = profile(profiled, roles.time, tuple(groups))
    first = first_edges(edges(base, roles))
    work = prior_card_degree(base, roles, layout=layout, first=first)
    for family in FAMILIES:
        work = prior_entity_degree(work, family, roles, layout=layout, first=first)
        work = prior_edge_count(work, family, roles, layout=layout)
    if components:
        sizes = prior_component_sizes(base, roles)
        work = work.join(sizes.drop(roles.time, "card", *FAMILIES), roles.key)
    return work.select(roles.key, *(c for c in GRAPH_COLUMNS if c in work.columns))
