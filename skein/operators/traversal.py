"""Decayed propagation and directed expansion over the graph, in batches.

All queries of a batch move level by level.  A node is reached once per start: it
is marked when first seen, whether or not it passes the threshold, so a pruned
node never comes back.  Levels are cut with a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.config import RetrievalConfig
from skein.functions.vectors import cosine, decayed
from skein.session import discard, stage


def propagate(starts: DataFrame, adj: DataFrame, node: DataFrame, vectors: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(query_id, start_id, node_id, node_type, name, content, is_stub, hop, ord, intrinsic_score, prop_score).

    ``starts``: query_id, start_id, vec (of the query).  ``vectors``: id, vec of the
    node's name.  The start is never tested; others need a score of the hop
    threshold.  At most ``propagation_max_nodes`` in breadth-first order: by hop,
    then the parent's order, kind of edge and id.  Starts that do not exist and
    null vectors give a score of 0 and are kept only as starts.  Starts may have
    columns of the knobs' names, which then hold for them in place of ``config``.
    """
    key = ["query_id", "start_id"]
    own = [k for k in ("propagation_decay", "propagation_hop_threshold", "propagation_max_depth", "propagation_max_nodes", "stub_penalty") if k in starts.columns]
    knob = lambda k: F.col(k) if k in own else F.lit(getattr(config, k))
    depth = config.propagation_max_depth
    if "propagation_max_depth" in own:
        depth = int(starts.agg(F.max("propagation_max_depth")).first()[0] or 0)
    known = node.join(vectors.select(F.col("id"), F.col("vec").alias("node_vec")), "id", "left")
    base = starts.select("query_id", "start_id", "vec", *own).dropDuplicates(key)

    def score(df: DataFrame, hop: int) -> DataFrame:
        raw = F.coalesce(cosine(F.col("vec"), F.col("node_vec")), F.lit(0.0))
        return df.withColumn("intrinsic_score", raw).withColumn("hop", F.lit(hop)).withColumn("prop_score", decayed(F.col("intrinsic_score"), F.lit(hop), F.col("is_stub"), knob("propagation_decay"), knob("stub_penalty")))

    cols = ["query_id", "start_id", "node_id", "node_type", "name", "content", "is_stub", "hop", "ord", "intrinsic_score", "prop_score"]
    first = score(base.join(known.withColumnRenamed("id", "start_id"), "start_id").withColumn("node_id", F.col("start_id")).withColumn("ord", F.lit(1)), 0)
    accepted = stage(first.select(*cols), "accepted")
    seen = accepted.select(*key, "node_id")
    frontier = accepted.select(*key, F.col("node_id").alias("src"), F.col("ord").alias("parent_ord"))
    for hop in range(1, depth + 1):
        w = Window.partitionBy(*key).orderBy("parent_ord", "kind_ord", "node_id")
        step = frontier.join(adj.withColumnRenamed("dst", "node_id"), "src")
        new = step.groupBy(*key, "node_id").agg(F.min(F.struct("parent_ord", "kind_ord")).alias("p")).select(*key, "node_id", "p.*").join(seen, [*key, "node_id"], "left_anti")
        ranked = score(new.join(known.withColumnRenamed("id", "node_id"), "node_id").join(base, key), hop)
        level = stage(ranked.filter(knob("propagation_max_depth") >= hop).select(*key, "node_id", "parent_ord", "kind_ord", "node_type", "name", "content", "is_stub", "hop", "intrinsic_score", "prop_score", *own), "level")
        kept = level.filter(F.col("prop_score") >= knob("propagation_hop_threshold")).withColumn("ord", F.row_number().over(w)).filter(F.col("ord") <= knob("propagation_max_nodes"))
        kept = stage(kept.select(*cols), "kept")
        if kept.isEmpty():
            break
        seen = seen.unionByName(level.select(*key, "node_id"))
        accepted = accepted.unionByName(kept)
        full = accepted.groupBy(*key).count().join(base, key).filter(F.col("count") >= knob("propagation_max_nodes")).select(*key)
        frontier = kept.join(full, key, "left_anti").select(*key, F.col("node_id").alias("src"), F.col("ord").alias("parent_ord"))
    w = Window.partitionBy(*key).orderBy("hop", "ord")
    placed = accepted.withColumn("place", F.row_number().over(w))
    if own:
        placed = placed.join(base.select(*key, *own), key)
    return placed.filter(F.col("place") <= knob("propagation_max_nodes")).drop(*own)


def merge_best(propagated: DataFrame) -> DataFrame:
    """Best score of each node over all starts of a query; the first start wins ties."""
    w = Window.partitionBy("query_id", "node_id").orderBy(F.desc("prop_score"), "start_id")
    return propagated.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def graph_metrics(merged: DataFrame) -> DataFrame:
    """Per query: scores, stubs, hops, kinds and the histogram of nodes per hop."""
    per = merged.groupBy("query_id", "hop").count().groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("hop", "count")))).alias("nodes_per_hop"))
    main = merged.groupBy("query_id").agg(
        F.count("*").alias("n_nodes"), F.round(F.avg("prop_score"), 4).alias("avg_prop"), F.round(F.max("prop_score"), 4).alias("max_prop"), F.round(F.min("prop_score"), 4).alias("min_prop"),
        F.round(F.avg("intrinsic_score"), 4).alias("avg_intrinsic"), F.count_if("is_stub").alias("n_stubs"), F.round(F.count_if("is_stub") / F.count("*"), 3).alias("stub_ratio"), F.max("hop").alias("max_hop"),
        F.count_if(F.col("node_type") == "entity").alias("n_entities"), F.count_if(F.col("node_type") == "event").alias("n_events"), F.countDistinct("name").alias("n_names"),
    )
    return main.join(per, "query_id")


def expand_graph(seeds: DataFrame, arcs: DataFrame, max_hops: int = 2, undirected: bool = False) -> tuple[DataFrame, DataFrame]:
    """Unscored expansion along directed arcs by lower-case name.

    ``seeds``: query_id, name.  ``arcs``: source, target, relation.  Returns the
    nodes (query_id, name, hop) up to ``max_hops`` and the distinct arcs that leave
    them; the targets of the last level's arcs are not nodes.
    """
    a = _lower(arcs)
    if undirected:
        a = a.unionByName(a.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("target").alias("source"), F.col("source").alias("target"), "relation")).distinct()
    reached = _levels(seeds, a, max_hops)
    # names of a query and arcs of a name come once, and so do their pairs
    found = reached.join(a, reached["name"] == a["src"]).select("query_id", "source", "target", "relation")
    return reached, found


def _lower(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.lower("source").alias("src"), F.lower("target").alias("dst"), "source", "target", "relation").distinct()


def reach(seeds: DataFrame, arcs: DataFrame, max_hops: int = 2) -> DataFrame:
    """(query_id, name, hop): the nodes of ``expand_graph`` alone."""
    return _levels(seeds, _lower(arcs), max_hops)


def _levels(seeds: DataFrame, a: DataFrame, max_hops: int) -> DataFrame:
    level = stage(seeds.select("query_id", F.lower("name").alias("name"), F.lit(0).alias("hop")).distinct(), "seeds")
    reached = level
    step = stage(a.select("src", "dst").distinct(), "step")
    for hop in range(1, max_hops + 1):
        nxt = level.join(step, level["name"] == step["src"]).select("query_id", F.col("dst").alias("name")).distinct()
        level = stage(nxt.join(reached.select("query_id", "name"), ["query_id", "name"], "left_anti").withColumn("hop", F.lit(hop)), "expand")
        if level.isEmpty():
            discard(level)
            break
        reached = reached.unionByName(level)
    return reached


def reach_counts(arcs: DataFrame) -> DataFrame:
    """(name, n_nodes, max_hop, n_arcs): what ``expand_graph`` reaches in two steps from each lower-case source, as counts.

    The targets of a start's neighbour of most arcs are not paired with the start:
    their number and arcs are taken as they are, and only what the start reaches
    otherwise and that one does not have is counted beside it.
    """
    own = arcs.distinct()
    low = own.select(F.lower("source").alias("src"), F.lower("target").alias("dst"))
    # pairs are many, so names stand in them as numbers
    names = stage(low.select(F.col("src").alias("name")).unionByName(low.select(F.col("dst").alias("name"))).distinct().withColumn("k", F.monotonically_increasing_id()), "names")
    number = lambda c: names.select(F.col("name").alias(c), F.col("k").alias(f"{c}_k")).hint("merge")
    out = stage(low.groupBy("src").agg(F.count("*").alias("out")).join(number("src"), "src").select(F.col("src_k").alias("name"), "out"), "out")
    step = stage(low.filter("src <> dst").distinct().join(number("src"), "src").join(number("dst"), "dst").select(F.col("src_k").alias("src"), F.col("dst_k").alias("dst")), "step")
    of = out.select(F.col("name").alias("dst"), "out")
    whole = step.join(of.hint("merge"), "dst", "left").groupBy("src").agg(F.count("*").alias("size"), F.coalesce(F.sum("out"), F.lit(0)).alias("arcs"))
    whole = stage(whole, "whole")
    top = step.join(whole.select(F.col("src").alias("dst"), "size"), "dst").groupBy("src").agg(F.max(F.struct("size", "dst")).alias("t")).select("src", F.col("t.dst").alias("hub"))
    top = stage(top, "top")
    near = out.select(F.col("name").alias("src"), F.col("name").alias("dst")).unionByName(step)
    others = step.join(top.hint("merge"), "src").filter("dst <> hub").select("src", F.col("dst").alias("mid"))
    far = others.join(step.select(F.col("src").alias("mid"), "dst").hint("merge"), "mid").select("src", "dst")
    seen = step.select(F.col("src").alias("hub"), "dst")
    more = near.unionByName(far).distinct().join(top.hint("merge"), "src", "left").join(seen.hint("merge"), ["hub", "dst"], "left_anti")
    extra = more.join(of.hint("merge"), "dst", "left").groupBy("src").agg(F.count("*").alias("more"), F.sum("out").alias("more_arcs"))
    n = out.select(F.col("name").alias("src")).join(extra, "src", "left").join(whole.select("src", F.col("size").alias("own")), "src", "left").join(top, "src", "left")
    n = n.join(whole.withColumnRenamed("src", "hub"), "hub", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = zero("more") + zero("size")
    hop = F.when(total > zero("own") + 1, 2).when(F.col("own") > 0, 1).otherwise(0)
    counts = n.select(F.col("src").alias("k"), total.alias("n_nodes"), hop.alias("max_hop"), (zero("more_arcs") + zero("arcs")).alias("n_arcs"))
    return counts.join(names.hint("merge"), "k").drop("k")
