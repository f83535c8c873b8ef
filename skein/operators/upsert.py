"""Writes as pure functions: current table and new rows give the next table.

A table is replaced by writing the result; nothing here has side effects, so a
retried job gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ids import entity_id, fact_id, pathway_id

#: Evidence rules: first confidence, gain per mention, ceiling, mentions of a full entity.
FIRST, GAIN, CEILING, FULL = 0.4, 0.05, 0.97, 2

ENTITY_SCHEMA = "id string, name string, entity_type string, aliases array<string>, is_stub boolean, confidence double, source_count bigint, first_seen date, last_updated date, properties map<string,string>"
EVENT_SCHEMA = "id string, title string, summary string, source_text string, participants array<string>, locations array<string>, action string, outcome string, caused_by array<string>, leads_to array<string>, temporal_order bigint, document_id bigint, segment_id bigint, timestamp timestamp"
DOCUMENT_SCHEMA = "id bigint, title string, date date, source string"
EDGE_SCHEMA = "src string, dst string, kind string, role string, specificity bigint"


def insert_absent(current: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``current``, once per key, appended.

    Among new rows of one key the smallest row stays.
    """
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else new.distinct()
    return current.unionByName(once.join(current.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert_entities(current: DataFrame, mentions: DataFrame, today) -> DataFrame:
    """Evidence of a batch of mentions (name, entity_type) added to the entities.

    The key is the exact name.  Known: the count grows by the mentions, the
    entity is full, confidence gains per mention up to the ceiling.  New: one
    mention makes a stub; n mentions count n, with the gain from the second on.
    Null names are ignored; the smallest type of a new name stays.  ``today`` is a
    date column or literal.
    """
    m = mentions.filter("name is not null").groupBy("name").agg(F.count("*").alias("m"), F.min("entity_type").alias("new_type"))
    both = current.join(m, "name", "full_outer")
    old, hit = F.col("id").isNotNull(), F.col("m").isNotNull()
    gained = F.least(F.lit(CEILING), F.col("confidence") + GAIN * F.col("m"))
    fresh = F.least(F.lit(CEILING), F.lit(FIRST) + GAIN * (F.col("m") - 1))
    return both.select(
        F.coalesce("id", entity_id(F.col("name"))).alias("id"), "name", F.coalesce("entity_type", "new_type").alias("entity_type"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        F.when(old & ~hit, F.col("is_stub")).when(old, F.lit(False)).otherwise(F.col("m") < FULL).alias("is_stub"),
        F.round(F.when(old & ~hit, F.col("confidence")).when(old, gained).otherwise(fresh), 6).alias("confidence"),
        (F.coalesce("source_count", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("source_count"), F.coalesce("first_seen", today).alias("first_seen"), F.when(hit, today).otherwise(F.col("last_updated")).alias("last_updated"),
    )


def add_aliases(current: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases (id, alias) appended where absent; the old order stays, new ones sorted."""
    new = aliases.filter("alias is not null").groupBy("id").agg(F.sort_array(F.collect_set("alias")).alias("_new"))
    none = F.array().cast("array<string>")
    return current.join(new, "id", "left").withColumn("aliases", F.array_union(F.coalesce("aliases", none), F.coalesce("_new", none))).drop("_new")


def merge_properties(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, properties): property rows (name, attribute, value, seq) over old maps.

    The last value of an attribute wins; new ones override old ones.
    """
    latest = new.groupBy("name", "attribute").agg(F.max_by("value", "seq").alias("value"))
    maps = latest.groupBy("name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("attribute", "value")))).alias("_new"))
    empty = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce("properties", empty), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("_new", empty)), k))
    return old.select("name", "properties").join(maps, "name", "full_outer").select("name", F.map_concat(kept, F.coalesce("_new", empty)).alias("properties"))


def add_edges(current: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges added once per (src, dst, kind), if both ends exist; the first specificity wins."""
    known = nodes.select("id")
    ok = new.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    once = ok.groupBy("src", "dst", "kind").agg(F.min("role").alias("role"), F.min("specificity").alias("specificity"))
    return current.unionByName(once.join(current, ["src", "dst", "kind"], "left_anti"))


def _last(df: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(key, "_r.*")


def store_facts(current: DataFrame, new: DataFrame) -> DataFrame:
    """Facts (text, seq, ...) with an id of their content; the last row of an id wins."""
    return _last(current.unionByName(new.withColumn("id", fact_id(F.col("text"))), allowMissingColumns=True), "id")


def store_pathways(current: DataFrame, new: DataFrame) -> DataFrame:
    """Pathways (key_terms, pathway, seq, ...); equal first 80 letters are one pathway."""
    return _last(current.unionByName(new.withColumn("id", pathway_id(F.col("key_terms"))), allowMissingColumns=True), "id")


def delete_ids(current: DataFrame, ids: DataFrame) -> DataFrame:
    """A table without the rows of some ids."""
    return current.join(ids.select("id").distinct(), "id", "left_anti")


def record_entries(facts: DataFrame) -> DataFrame:
    """(type, name, entries): dated facts (type, name, date, fact) as record blocks."""
    block = F.concat(F.lit("### "), F.col("date").cast("string"), F.lit("\n- "), F.col("fact"), F.lit("\n\n"))
    g = facts.select("type", "name", F.struct("date", block.alias("block")).alias("b")).groupBy("type", "name").agg(F.sort_array(F.collect_list("b")).alias("b"))
    return g.select("type", "name", F.array_join(F.col("b.block"), "").alias("entries"))


def check_dimension(df: DataFrame, dim: int, column: str = "vec") -> DataFrame:
    """The frame, failing at run time on a vector of another size."""
    return df.withColumn(column, F.when(F.assert_true(F.coalesce(F.size(column), F.lit(dim)) == dim, F.lit(f"{column} is not of size {dim}")).isNull(), F.col(column)))


def first_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
