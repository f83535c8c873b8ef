"""Best representative of each duplicate group.

Records are ranked by trust, completeness and recency with the id as the last
tie-break.  The rank is a window whose only use is ``rank = 1``, which Spark
turns into a group limit ahead of the shuffle: one row per group and task is
moved, also for a group with a third of all records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that ``golden_record`` fills field by field.
FIELDS = ("name", "entity_type", "first_seen", "last_updated", "properties")


def trust_order() -> list[Column]:
    """Sort keys: real before stub, confidence, sources, recency, id.

    Null or zero confidence counts 0.5, above 1 it is a percentage; null or zero
    source_count counts 1; a null date sorts last.
    """
    conf = F.col("confidence")
    conf = F.when(conf.isNull() | F.isnan(conf) | (conf == 0), F.lit(0.5)).when(conf > 1, F.round(conf / 100, 2)).otherwise(conf)
    n = F.col("source_count")
    n = F.when(n.isNull() | (n == 0), F.lit(1)).otherwise(n)
    stub = F.when(F.col("is_stub") == F.lit(False), 0).otherwise(1)
    return [stub.asc(), conf.desc(), n.desc(), F.col("last_updated").desc_nulls_last(), F.col("id").asc()]


def survivors(members: DataFrame, entities: DataFrame) -> DataFrame:
    """(group_id, survivor_id): the first record of each group.

    ``members``: entity_id, group_id.  Members without a record and records
    without a group are left out; a record delivered twice counts once by its
    best row.  Empty frames give an empty result; other columns are ignored.
    """
    m = members.select(F.col("entity_id").alias("id"), "group_id")
    rec = entities.select("id", "is_stub", "confidence", "source_count", "last_updated")
    w = Window.partitionBy("group_id").orderBy(*trust_order())
    ranked = rec.join(m, "id").withColumn("_rank", F.row_number().over(w))
    return ranked.filter("_rank = 1").select("group_id", F.col("id").alias("survivor_id"))


def golden_record(members: DataFrame, entities: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One built record per group: every field from the best row that has it.

    Blank strings count as absent.  ``min_by`` over the rank key combines before
    the shuffle.  Adds ``survivor_id`` and ``n_records`` (distinct ids).
    """
    m = members.select(F.col("entity_id").alias("id"), "group_id")
    need = list(dict.fromkeys(["id", "is_stub", "confidence", "source_count", "last_updated", *fields]))
    rows = entities.select(*need).join(m, "id")
    conf = F.when(F.col("confidence").isNull() | F.isnan("confidence") | (F.col("confidence") == 0), F.lit(0.5)).when(F.col("confidence") > 1, F.round(F.col("confidence") / 100, 2)).otherwise(F.col("confidence"))
    n = F.when(F.col("source_count").isNull() | (F.col("source_count") == 0), F.lit(1)).otherwise(F.col("source_count"))
    key = F.struct(
        F.when(F.col("is_stub") == F.lit(False), 0).otherwise(1).alias("a"), (-conf).alias("b"), (-n).alias("c"),
        (-F.coalesce(F.unix_date("last_updated"), F.lit(-(2**31) + 1)).cast("bigint")).alias("d"), F.col("id").alias("e"),
    )
    rows = rows.withColumn("_key", key)
    types = dict(entities.dtypes)

    def best(f: str) -> Column:
        v = F.nullif(F.trim(f), F.lit("")) if types[f] == "string" else F.col(f)
        return F.min_by(v, F.when(v.isNotNull(), F.col("_key"))).alias(f)

    return rows.groupBy("group_id").agg(F.min_by("id", "_key").alias("survivor_id"), *[best(f) for f in fields], F.countDistinct("id").alias("n_records"))
