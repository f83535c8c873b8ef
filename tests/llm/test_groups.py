import random

from pyspark.sql import functions as F

from skein.llm.groups import connected_components, entity_groups
from skein.llm.survivor import golden_record, survivors

ENT = "id string, name string, entity_type string, aliases array<string>, is_stub boolean, confidence double, source_count bigint, first_seen date, last_updated date, properties string"
RES = "resolution_id bigint, input_name string, node_id string, is_ambiguous boolean"


def brute(pairs):
    group = {}
    for a, b in pairs:
        if a is None or b is None:
            continue
        ga, gb = group.get(a, {a}), group.get(b, {b})
        both = ga | gb
        for x in both:
            group[x] = both
    return {x: min(g) for x, g in group.items()}


def check(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {r.node: r.group_id for r in connected_components(df).collect()}
    assert got == brute(pairs)


def test_random_graphs(spark):
    rnd = random.Random(4)
    for n, m in ((12, 8), (40, 30), (60, 90)):
        check(spark, [(f"n{rnd.randrange(n):02}", f"n{rnd.randrange(n):02}") for _ in range(m)])


def test_long_chain_hub_and_ring(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    hub = [("h000", f"h{i:03}") for i in range(1, 200)]
    ring = [(f"r{i:02}", f"r{(i + 1) % 20:02}") for i in range(20)]
    check(spark, chain + hub + ring + ring)


def test_loops_nulls_and_empty(spark):
    check(spark, [("a", "a"), ("b", None), (None, None), ("c", "d"), ("d", "c")])
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def ents(spark, rows):
    return spark.createDataFrame([(r + (None,) * 10)[:10] for r in rows], ENT)


def test_entity_groups(spark):
    e = ents(spark, [("e1", "Ann  Lee", None, None), ("e2", "x", None, [" ann lee", None, ""]), ("e3", "y", None, []), ("e4", "", None, [" "]), ("e5", None, None, None), ("e6", "Z", None, None), ("e6", "Z", None, None)])
    r = spark.createDataFrame([(1, "X", "e3", None), (2, "z", "e3", True), (3, "Z", "nobody", False), (4, None, "e5", False), (4, None, "e5", False)], RES)
    got = {x.entity_id: x.group_id for x in entity_groups(e.withColumn("s", F.lit(1)), r.withColumn("group_id", F.lit("clash"))).collect()}
    assert got == {"e1": "e1", "e2": "e1", "e3": "e1"}


def test_hot_string_is_a_star(spark):
    e = ents(spark, [(f"e{i:04}", "Same", None, None) for i in range(1500)])
    got = entity_groups(e, spark.createDataFrame([], RES)).groupBy("group_id").count().collect()
    assert [(g.group_id, g["count"]) for g in got] == [("e0000", 1500)]


def test_groups_of_empty_tables(spark):
    assert entity_groups(ents(spark, []), spark.createDataFrame([], RES)).count() == 0


def test_survivors(spark):
    import datetime as dt

    day = dt.date(2025, 1, 1)
    rows = [
        ("a", "A", "", None, None, 90.0, 3, None, day, None), ("b", "B", "person", None, False, None, None, None, None, None), ("c", None, None, None, False, 0.0, 1, day, None, None),
        ("d", "D", None, None, False, 0.4, 9, None, day, "{}"), ("x", "X", None, None, True, 51.234, 1, None, None, None), ("y", "Y", None, None, True, 0.51, 1, None, day, None),
    ]
    e = spark.createDataFrame(rows + rows[:2], ENT).withColumn("group_id", F.lit("clash"))
    m = spark.createDataFrame([(i, "a") for i in "abcd"] + [(i, "x") for i in "xy"] + [("gone", "gone")], "entity_id string, group_id string")
    got = {r.group_id: r.survivor_id for r in survivors(m, e).collect()}
    assert got == {"a": "b", "x": "y"}
    gold = {r.group_id: r for r in golden_record(m, e).collect()}
    assert gold["a"].survivor_id == "b" and gold["a"].name == "B" and gold["a"].entity_type == "person" and gold["a"].first_seen == day and gold["a"].properties == "{}" and gold["a"].n_records == 4
    assert survivors(m.limit(0), e).count() == 0 and golden_record(m, e.limit(0)).count() == 0
