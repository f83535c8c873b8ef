"""Building the entity graph of names and relations, and searching it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.config import RetrievalConfig
from skein.operators import traversal, vector
from skein.session import broadcast_if_small, stage


def co_occurrences(evs: DataFrame, known: DataFrame) -> DataFrame:
    """(source, target, relation): unordered pairs of known participants of one event.

    Names are known ignoring case.  A pair keeps the direction of its first
    occurrence by event id and position.
    """
    names = known.select(F.lower("name").alias("low")).distinct()
    p = evs.select("id", F.posexplode("participants").alias("pos", "name")).withColumn("low", F.lower("name")).join(names, "low", "left_semi")
    a, b = p.alias("a"), p.alias("b")
    pairs = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.pos") < F.col("b.pos")))
    keyed = pairs.select(F.least("a.low", "b.low").alias("x"), F.greatest("a.low", "b.low").alias("y"), F.struct(F.col("a.id").alias("id"), F.col("a.pos").alias("i"), F.col("b.pos").alias("j"), F.col("a.name").alias("source"), F.col("b.name").alias("target")).alias("e"))
    return keyed.groupBy("x", "y").agg(F.min("e").alias("e")).select("e.source", "e.target", F.lit("CO_OCCURS").alias("relation"))


def located_in(evs: DataFrame, known: DataFrame) -> DataFrame:
    """(source, target, relation): known participants with known places of one event.

    Both differ ignoring case; one row per lower-case pair, first by event and positions.
    """
    names = known.select(F.lower("name").alias("low")).distinct()
    one = lambda c: evs.select("id", F.posexplode(c).alias("pos", "name")).withColumn("low", F.lower("name")).join(names, "low", "left_semi")
    p, q = one("participants").alias("p"), one("locations").alias("q")
    both = p.join(q, F.col("p.id") == F.col("q.id")).filter("p.low <> q.low")
    keyed = both.select(F.col("p.low").alias("x"), F.col("q.low").alias("y"), F.struct(F.col("p.id").alias("id"), F.col("p.pos").alias("i"), F.col("q.pos").alias("j"), F.col("p.name").alias("source"), F.col("q.name").alias("target")).alias("e"))
    return keyed.groupBy("x", "y").agg(F.min("e").alias("e")).select("e.source", "e.target", F.lit("LOCATED_IN").alias("relation"))


def alias_arcs(edge: DataFrame, ents: DataFrame) -> DataFrame:
    """(source, target, relation) of ALIAS_OF edges between named, different entities."""
    n = ents.select("id", "name").filter("name <> ''")
    e = edge.filter("kind = 'ALIAS_OF'").select("src", "dst")
    out = e.join(n.select(F.col("id").alias("src"), F.col("name").alias("source")), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("target")), "dst")
    return out.filter("source <> target").select("source", "target", F.lit("ALIAS_OF").alias("relation"))


def seed_texts(desc: DataFrame, ents: DataFrame) -> DataFrame:
    """(key, name, text) to embed: ``name (type)[: description]``, one per lower-case name.

    Only entities that are no stubs, unless there are none; the last id of a name wins.
    """
    full = desc.join(ents.select("id", "is_stub"), "id")
    any_full = full.agg(F.max((~F.col("is_stub")).cast("int")).alias("any"))
    use = full.crossJoin(F.broadcast(any_full)).filter((F.coalesce("any", F.lit(0)) == 0) | ~F.col("is_stub"))  # a one-row aggregate
    d = F.substring(F.coalesce("description", F.lit("")), 1, 300)
    text = F.concat("name", F.lit(" ("), "node_type", F.lit(")"), F.when(d != "", F.concat(F.lit(": "), d)).otherwise(""))
    return use.filter("name is not null").groupBy(F.lower("name").alias("key")).agg(F.max_by(F.struct("name", text.alias("text")), "id").alias("r")).select("key", "r.*")


def search(queries: DataFrame, seeds: DataFrame, nodes: DataFrame, arcs: DataFrame, k: int = 5, max_hops: int = 2, floor: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and arcs around the best seeds of each query.

    ``seeds``: id (lower-case name), vec; ``nodes``: name, type, description.  Names
    without a node are walked through but not given.
    """
    reached, found = traversal.expand_graph(_best(queries, seeds, k, floor), arcs, max_hops)
    return _shown(reached, nodes), found


def _best(queries: DataFrame, seeds: DataFrame, k: int, floor: float | None) -> DataFrame:
    """(query_id, name): the seeds at which each query starts."""
    at = RetrievalConfig().graphrag_seed_threshold if floor is None else floor
    return vector.top_k(queries, seeds, k, floor=at).select("query_id", F.col("id").alias("name"))


def _shown(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """The reached names that have a node, by its last spelling."""
    n = nodes.withColumn("low", F.lower("name"))
    w = Window.partitionBy("low").orderBy(F.desc("name"))
    last = n.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return reached.withColumnRenamed("name", "low").join(last, "low").select("query_id", "hop", "name", "node_type", "description")


def contexts(queries: DataFrame, seeds: DataFrame, nodes: DataFrame, arcs: DataFrame, k: int = 5, max_hops: int = 2, floor: float | None = None) -> DataFrame:
    """(query_id, context): what ``format_graph`` makes of ``search``, without a row per query and arc.

    The lines of a source are sorted and joined once; a query joins such blocks in
    the order of their heads.
    """
    reached = stage(traversal.reach(_best(queries, seeds, k, floor), arcs, max_hops), "reached")
    blocks = stage(arc_blocks(arcs), "blocks")
    a = reached.select("query_id", F.col("name").alias("src")).join(blocks, "src").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("head", "lines"))).alias("a"))
    return _context(_node_lines(_shown(reached, nodes)), a.select("query_id", F.col("a.lines").alias("a")))


def arc_blocks(arcs: DataFrame) -> DataFrame:
    """(src, head, lines): the arcs of each lower-case source as sorted lines, in blocks that keep all lines in order when sorted by head.

    The head is what stands before the first mark of a relation: lines of two heads
    never interleave.  Where a source holds such a mark itself, lines of several
    sources share a head, and each line of it is a block.
    """
    a = arcs.select("source", "target", "relation").distinct().select(F.lower("source").alias("src"), "source", _arc_line().alias("line")).filter("line is not null").withColumn("head", F.substring_index("line", _MARK, 1))
    odd = broadcast_if_small(stage(a.filter(F.contains("source", F.lit(_MARK))).select("head").distinct(), "odd"))
    keyed = a.join(odd.withColumn("odd", F.lit(True)), "head", "left").select("src", F.when(F.col("odd"), F.col("line")).otherwise(F.concat("head", F.lit(_MARK))).alias("head"), "line")
    return keyed.groupBy("src", "head").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("lines"))


#: What stands between the source and the relation of a line.
_MARK = " --["


def _arc_line() -> Column:
    return F.concat("source", F.lit(_MARK), "relation", F.lit("]--> "), "target")


def _node_lines(nodes: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "node_type", F.lit("): "), F.coalesce("description", F.lit("")))
    return nodes.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("hop", line.alias("l")))).alias("n"))


def _context(n: DataFrame, a: DataFrame) -> DataFrame:
    return n.join(a, "query_id", "left").select("query_id", F.concat(F.lit("Entities:\n"), F.array_join(F.col("n.l"), "\n"), F.when(F.size("a") > 0, F.concat(F.lit("\n\nRelations:\n"), F.array_join("a", "\n"))).otherwise("")).alias("context"))


def format_graph(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(query_id, context): entities, then relations, as text."""
    return _context(_node_lines(nodes), arcs.groupBy("query_id").agg(F.sort_array(F.collect_list(_arc_line())).alias("a")))
