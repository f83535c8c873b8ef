"""Consolidating pairwise matches into groups: deterministic Boruvka hooking.

Every component selects its smallest outgoing edge under the total order
(smaller label, larger label); that edge leads to the component's smallest
neighbour, so the choice is a plain minimum with partial aggregation.  Only
mutual choices form cycles; the smaller of the two becomes the root.  Trees
collapse by pointer doubling, edges are relabelled and deduplicated, and the
rounds end when no edge is left.  Each round at least halves the components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import discard, stage


def normal_string(c: Column) -> Column:
    """Trim, reduce inner white space to one blank, lower-case; blank is null."""
    one = F.regexp_replace(c, r"[\s\p{Z}]+", " ")
    return F.nullif(F.lower(F.trim(one)), F.lit(""))


def _hook(edges: DataFrame) -> DataFrame:
    """(node, parent) of every component that still has an edge."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other")))
    pick = both.groupBy("node").agg(F.min("other").alias("parent"))
    pick = stage(pick, "pick")
    back = pick.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    root = (F.col("grand") == F.col("node")) & (F.col("node") < F.col("parent"))
    hooked = stage(pick.join(back, "parent").select("node", F.when(root, F.col("node")).otherwise(F.col("parent")).alias("parent")), "hook")
    discard(pick)
    return hooked


def _collapse(parents: DataFrame) -> DataFrame:
    """Pointer doubling until every node points to its root."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        nxt = stage(parents.join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")), "double")
        done = nxt.filter("moved").isEmpty()
        discard(parents)
        if done:
            return nxt
        flat = nxt.select("node", "parent")
        flat._skein_path = nxt._skein_path
        parents = flat


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, group_id) of every record in a pair; group_id is the smallest record.

    Pairs may repeat, stand in either order or join a record to itself; a null
    end is ignored.  A record that only pairs with itself forms a group of one.
    An empty frame gives an empty result.  Extra columns are ignored.
    """
    clean = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    loops = clean.filter("x = y").select(F.col("x").alias("node"))
    edges = stage(clean.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
    nodes = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).unionByName(loops).distinct()
    labels = stage(nodes.select("node", F.col("node").alias("label")), "labels")
    while not edges.isEmpty():
        roots = _collapse(_hook(edges))
        r = roots.select(F.col("node").alias("label"), F.col("parent").alias("root"))
        new = stage(labels.join(r, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        ru = roots.select(F.col("node").alias("u"), F.col("parent").alias("ru"))
        rv = roots.select(F.col("node").alias("v"), F.col("parent").alias("rv"))
        moved = edges.join(ru, "u").join(rv, "v").filter("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        nxt = stage(moved, "edges")
        for old in (labels, edges, roots):
            discard(old)
        labels, edges = new, nxt
    smallest = labels.groupBy("label").agg(F.min("node").alias("group_id"))
    return labels.join(smallest, "label").select("node", "group_id")


def held_strings(entities: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Distinct (id, s): the normalised strings that each entity record holds.

    Input names count only for rows whose ``node_id`` is the id of a record and
    whose ``is_ambiguous`` is not true.  Blank and null strings are left out.
    """
    own = entities.filter("id is not null").select("id", normal_string(F.col("name")).alias("s"))
    other = entities.filter("id is not null").select("id", F.explode("aliases").alias("s")).select("id", normal_string(F.col("s")).alias("s"))
    typed = (
        resolutions.filter(F.col("node_id").isNotNull() & ~F.coalesce("is_ambiguous", F.lit(False)))
        .select(F.col("node_id").alias("id"), normal_string(F.col("input_name")).alias("s")).filter("s is not null").distinct()
        .join(entities.select("id").distinct(), "id", "left_semi")
    )
    return own.unionByName(other).unionByName(typed).filter("s is not null").distinct()


def shared_string_pairs(held: DataFrame) -> DataFrame:
    """(a, b): each record of a string paired with the string's smallest record.

    A star per string instead of all pairs: as many rows as holdings, however
    many records hold one string.
    """
    hub = held.groupBy("s").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").select("s", "a")
    return held.join(hub, "s").filter("id <> a").select("a", F.col("id").alias("b")).distinct()


def entity_groups(entities: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(entity_id, group_id) of every entity record in a group of two or more."""
    pairs = shared_string_pairs(stage(held_strings(entities, resolutions), "held"))
    return connected_components(pairs).select(F.col("node").alias("entity_id"), "group_id")
