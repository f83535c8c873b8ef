"""Referential integrity: references to records that are missing, deleted or late.

Inputs are generic: a frame of references and frames of parent keys and of
tombstones.  Foreign keys are reduced to distinct (target, key, period) before
any join, so a key that a third of all rows refer to is one row in the
anti-join; the join back to the references is salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def clean_key(c: Column) -> Column:
    """Trim all white space and lower-case; blank becomes null."""
    return F.nullif(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def broken_references(refs: DataFrame, parents: DataFrame, tombstones: DataFrame, salts: int = SALTS) -> DataFrame:
    """Classify the references that were broken when they were made.

    ``refs``: ref_table, ref_id, ref_field, target, ref_key, batch_no and any
    further columns, which are kept.  ``parents``: target, key, batch_no.
    ``tombstones``: key, batch_no.  Adds ``kind``:

    * ``deleted``: a tombstone whose batch is not above the reference's batch;
    * ``late``: otherwise, the parent exists only in later batches;
    * ``missing``: otherwise, there is neither a parent nor a tombstone.

    Null and blank keys are no references.  A null batch number counts as 0 on
    either side.  Repeated rows are kept as delivered; callers that want a set
    apply ``distinct``.  Empty frames give an empty result.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    refs = refs.drop("kind", "absent", "first_batch", "gone_batch").filter(F.col("ref_key").isNotNull()).withColumn("batch_no", n("batch_no"))
    parent = (
        parents.select("target", clean_key(F.col("key")).alias("ref_key"), n("batch_no").alias("b"))
        .filter("ref_key is not null").groupBy("target", "ref_key").agg(F.min("b").alias("first_batch"))
    )
    tomb = (
        tombstones.select(clean_key(F.col("key")).alias("ref_key"), n("batch_no").alias("b"))
        .filter("ref_key is not null").groupBy("ref_key").agg(F.min("b").alias("gone_batch"))
    )
    keys = refs.select("target", "ref_key", "batch_no").distinct()
    # keys without a parent in time, by anti-join of the distinct keys
    k, p = keys.alias("k"), parent.alias("p")
    same = (F.col("k.target") == F.col("p.target")) & (F.col("k.ref_key") == F.col("p.ref_key"))
    absent = k.join(p, same & (F.col("p.first_batch") <= F.col("k.batch_no")), "left_anti").withColumn("absent", F.lit(True))
    gone = keys.join(tomb, "ref_key").filter("gone_batch <= batch_no").select("target", "ref_key", "batch_no", F.lit(False).alias("absent"))
    suspect = absent.unionByName(gone).groupBy("target", "ref_key", "batch_no").agg(F.max("absent").alias("absent"))
    verdict = (
        suspect.join(tomb, "ref_key", "left").join(parent, ["target", "ref_key"], "left")
        .select(
            "target", "ref_key", "batch_no",
            F.when(F.col("gone_batch") <= F.col("batch_no"), "deleted")
            .when(F.col("first_batch") > F.col("batch_no"), "late")
            .when(F.col("first_batch").isNull() & F.col("gone_batch").isNull(), "missing").alias("kind"),
        )
        .filter("kind is not null")
    )
    salted = verdict.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = refs.withColumn("_salt", F.pmod(F.xxhash64("ref_table", "ref_id", "ref_field"), F.lit(salts)).cast("int"))
    return spread.join(salted, ["target", "ref_key", "batch_no", "_salt"]).drop("_salt")


def graph_references(events: DataFrame, props: DataFrame) -> DataFrame:
    """The references of the event and score tables in one long frame."""
    def of_event(field: str) -> DataFrame:
        return events.select("id", F.explode(field).alias("_key"), "batch_no", "recorded_at").select(
            F.lit("graph_event").alias("ref_table"), F.col("id").alias("ref_id"), F.lit(field).alias("ref_field"),
            F.lit("event").alias("target"), clean_key(F.col("_key")).alias("ref_key"), "batch_no",
            F.date_trunc("month", F.col("recorded_at")).cast("date").alias("period"),
        )

    scored = props.select(
        F.lit("prop_node").alias("ref_table"), F.col("prop_id").cast("string").alias("ref_id"), F.lit("node_id").alias("ref_field"),
        F.lit("node").alias("target"), clean_key(F.col("node_id")).alias("ref_key"), "batch_no",
        F.date_trunc("month", F.col("scored_at")).cast("date").alias("period"),
    )
    return of_event("caused_by").unionByName(of_event("leads_to")).unionByName(scored).filter("ref_key is not null")


def graph_parents(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Target keys: events for event references, events and entities for nodes."""
    ev = events.select(F.col("id").alias("key"), "batch_no")
    en = entities.select(F.col("id").alias("key"), "batch_no")
    node = ev.unionByName(en).select(F.lit("node").alias("target"), "key", "batch_no")
    return ev.select(F.lit("event").alias("target"), "key", "batch_no").unionByName(node)


def orphan_rows(events: DataFrame, entities: DataFrame, props: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Distinct broken references with their period."""
    refs = graph_references(events, props)
    out = broken_references(refs, graph_parents(events, entities), tombstones.select(F.col("node_id").alias("key"), "batch_no"))
    return out.select("ref_table", "ref_id", "ref_field", "ref_key", "kind", "period").distinct()


def orphan_report(events: DataFrame, entities: DataFrame, props: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Counts of references and broken references per table, field and month.

    Rows: ref_table, ref_field, period (first of the month, null if the row has
    no time), n_refs (distinct references), n_missing, n_deleted, n_late.
    """
    total = (
        graph_references(events, props).select("ref_table", "ref_id", "ref_field", "ref_key", "period").distinct()
        .groupBy("ref_table", "ref_field", "period").agg(F.count("*").alias("n_refs"))
    )
    bad = orphan_rows(events, entities, props, tombstones).groupBy("ref_table", "ref_field", "period").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("missing", "deleted", "late")]
    )
    t, b = total.alias("t"), bad.alias("b")
    on = (F.col("t.ref_table") == F.col("b.ref_table")) & (F.col("t.ref_field") == F.col("b.ref_field")) & F.col("t.period").eqNullSafe(F.col("b.period"))
    zero = lambda c: F.coalesce(F.col(f"b.{c}"), F.lit(0)).alias(c)
    return t.join(b, on, "left").select("t.ref_table", "t.ref_field", "t.period", "t.n_refs", zero("n_missing"), zero("n_deleted"), zero("n_late"))
