from helpers import rows

from skein.operators.references import broken_references, orphan_report, orphan_rows

REF = "ref_table string, ref_id string, ref_field string, target string, ref_key string, batch_no int"


def frames(spark, refs, parents, tombs):
    return (
        spark.createDataFrame(refs, REF), spark.createDataFrame(parents, "target string, key string, batch_no int"), spark.createDataFrame(tombs, "key string, batch_no int"),
    )


def test_kinds(spark):
    refs = [("t", str(i), "f", "e", k, b) for i, (k, b) in enumerate([("a", 1), ("b", 1), ("c", 1), ("d", 1), ("x", 1), (None, 1), ("a", None)])]
    r, p, t = frames(spark, refs, [("e", " A ", 0), ("e", "b", 2), ("e", "d", 0), ("z", "x", 0)], [("d", 1), ("c", 3)])
    got = rows(broken_references(r, p, t), "ref_id", "kind")
    assert got == [("1", "late"), ("3", "deleted"), ("4", "missing")]


def test_one_hot_key_and_extra_columns(spark):
    refs = [("t", str(i), "f", "e", "hot", 1) for i in range(500)]
    r, p, t = frames(spark, refs, [], [])
    from pyspark.sql import functions as F

    got = broken_references(r.withColumn("kind", F.lit("clash")).withColumn("note", F.lit("kept")), p, t)
    assert got.count() == 500 and got.filter("kind = 'missing' and note = 'kept'").count() == 500


def test_empty(spark):
    r, p, t = frames(spark, [], [], [])
    assert broken_references(r, p, t).count() == 0


def tables(spark, events=(), props=(), tombs=()):
    ev = spark.createDataFrame(list(events), "id string, caused_by array<string>, leads_to array<string>, batch_no int, recorded_at timestamp")
    en = spark.createDataFrame([("n1", 0)], "id string, batch_no int")
    pr = spark.createDataFrame(list(props), "prop_id bigint, node_id string, batch_no int, scored_at timestamp")
    return ev, en, pr, spark.createDataFrame(list(tombs), "node_id string, batch_no int, reason string")


def test_rows_and_report(spark):
    import datetime as dt

    t = dt.datetime(2025, 3, 9)
    ev, en, pr, tb = tables(spark, [("e1", ["E2 ", None, "", "zz", "zz"], [], 0, t), ("e2", None, ["e1"], 1, None), ("e2", None, ["e1"], 1, None)], [(7, "N1", 0, t), (8, "gone", 0, t), (9, None, 0, t)])
    got = rows(orphan_rows(ev, en, pr, tb), "ref_id", "ref_key", "kind")
    assert got == [("8", "gone", "missing"), ("e1", "e2", "late"), ("e1", "zz", "missing")]
    rep = {(r.ref_table, r.ref_field, r.period): (r.n_refs, r.n_missing, r.n_deleted, r.n_late) for r in orphan_report(ev, en, pr, tb).collect()}
    assert rep[("graph_event", "caused_by", dt.date(2025, 3, 1))] == (2, 1, 0, 1)
    assert rep[("graph_event", "leads_to", None)] == (1, 0, 0, 0)
    assert rep[("prop_node", "node_id", dt.date(2025, 3, 1))] == (2, 1, 0, 0)


def test_report_of_empty_tables(spark):
    assert orphan_report(*tables(spark)).count() == 0
