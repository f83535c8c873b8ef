import datetime as dt
import random
from dataclasses import replace

import numpy as np
from helpers import rows
from pyspark.sql import functions as F

from skein.config import RetrievalConfig
from skein.operators import annotate, cascade, entity_graph, evaluation, graph, grep, linking, segments, sweep, traversal, upsert, vector


def test_top_k_ties_zero_vectors_and_lengths(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id int, vec array<double>")
    r = spark.createDataFrame([(5, [2.0, 0.0]), (4, [1.0, 0.0]), (6, [0.0, 1.0]), (7, [0.0, 0.0]), (8, None), (9, [1.0, 0.0, 0.0])], "id int, vec array<double>")
    got = [(x.query_id, x.id, round(x.score, 6)) for x in vector.top_k(q, r, 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 4, 1.0), (1, 5, 1.0), (1, 9, 1.0), (2, 4, 0.0), (2, 5, 0.0), (2, 6, 0.0)]
    assert vector.top_k(q, r, 6, floor=0.35).filter("query_id = 1").count() == 3
    assert vector.top_k(q.limit(0), r, 3).count() == 0 and vector.top_k(q, r.limit(0), 3).count() == 0


def test_top_k_in_parts_equals_numpy(spark):
    rnd = np.random.default_rng(2)
    m = rnd.normal(size=(300, 16))
    r = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id int, vec array<double>").repartition(5)
    old, vector.PART = vector.PART, 7
    try:
        got = {(x.query_id, x.rank): x.id for x in vector.top_k(r.filter("id < 20").select(F.col("id").alias("query_id"), "vec"), r, 5).collect()}
    finally:
        vector.PART = old
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(20):
        assert [got[i, k + 1] for k in range(5)] == list(np.argsort(-(n @ n[i]), kind="stable")[:5])


def world(spark):
    nodes = spark.createDataFrame([(n, "entity" if n[0] == "n" else "event", n, f"about {n}", n == "n3") for n in ("n1", "n2", "n3", "e1", "e2", "e3", "e4")], "id string, node_type string, name string, content string, is_stub boolean")
    adj = spark.createDataFrame([("n1", "e1", 0), ("n1", "e2", 0), ("e1", "n2", 1), ("e1", "n1", 1), ("e2", "n3", 1), ("n2", "e3", 0), ("n3", "e3", 0), ("e3", "e4", 4)], "src string, dst string, kind_ord int")
    good, bad = [1.0, 0.0], [0.0, 1.0]
    vec = spark.createDataFrame([("n1", good), ("n2", bad), ("n3", good), ("e1", good), ("e2", good), ("e3", good), ("e4", good)], "id string, vec array<double>")
    return nodes, adj, vec


def test_propagation(spark):
    nodes, adj, vec = world(spark)
    starts = spark.createDataFrame([(1, "n1", [1.0, 0.0]), (2, "n2", [1.0, 0.0]), (3, "none", [1.0, 0.0])], "query_id int, start_id string, vec array<double>")
    got = {(r.query_id, r.node_id): (r.hop, round(r.prop_score, 6)) for r in traversal.propagate(starts, adj, nodes, vec).collect()}
    assert got[1, "n1"] == (0, 1.0) and got[1, "e1"] == (1, 0.9) and got[1, "n3"] == (2, 0.405) and got[1, "e3"] == (3, 0.729) and got[1, "e4"] == (4, 0.6561)
    assert (1, "n2") not in got  # pruned: its score is 0
    assert got[2, "n2"] == (0, 0.0) and got[2, "e3"] == (1, 0.9) and (3, "none") not in got
    small = traversal.propagate(starts, adj, nodes, vec, replace(RetrievalConfig(), propagation_max_nodes=2)).filter("query_id = 1")
    assert rows(small, "node_id") == [("e1",), ("n1",)]
    m = traversal.graph_metrics(traversal.merge_best(traversal.propagate(starts, adj, nodes, vec))).filter("query_id = 1").first()
    assert m.n_nodes == 6 and m.n_stubs == 1 and m.max_hop == 4 and m.nodes_per_hop == {0: 1, 1: 2, 2: 1, 3: 1, 4: 1}


def test_directed_expansion(spark):
    arcs = spark.createDataFrame([("A", "B", "R"), ("B", "C", "R"), ("C", "D", "R"), ("A", "B", "R"), ("X", "A", "R")], "source string, target string, relation string")
    seeds = spark.createDataFrame([(1, "a")], "query_id int, name string")
    n, a = traversal.expand_graph(seeds, arcs, 2)
    assert rows(n, "name", "hop") == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(a, "source", "target") == [("A", "B"), ("B", "C"), ("C", "D")]
    n, _ = traversal.expand_graph(seeds, arcs, 1, undirected=True)
    assert rows(n, "name") == [("a",), ("b",), ("x",)]


def stores(spark):
    nodes, adj, vec = world(spark)
    ents = spark.createDataFrame([("n1", "n1 person", False)], "id string, name string, is_stub boolean")
    facts = spark.createDataFrame([("f1", [0.0, 0.0, 1.0, 0.0], "sure", "app_user", []), ("f2", [0.7, 0.0, 0.714, 0.0], "Entity: n1 | Type: x", "app_user", []), ("f3", [0.0, 0.0, 0.0, 1.0], "other user", "someone", [])], "id string, vec array<double>, text string, user_id string, pathway array<string>")
    paths = spark.createDataFrame([("p1", [0.0, 1.0, 0.0, 0.0], ["n1", "e1", "gone", "n1"]), ("p2", [0.0, 0.99, 0.0, 0.1], [])], "id string, vec array<double>, pathway array<string>")
    recs = spark.createDataFrame([("r1", "the hidden harbour\nnothing here\nharbour again")], "stem string, content string")
    return cascade.Stores(nodes, adj, ents, vec, facts, paths, recs)


def test_cascade_outcomes(spark):
    q = spark.createDataFrame(
        [("path", "x", [0.0, 1.0, 0.0, 0.0]), ("fact", "x", [0.0, 0.0, 1.0, 0.0]), ("both", "x", [1.0, 0.0, 0.2, 0.0]), ("name", "n1 person", [0.5, 0.0, 0.0, 0.9]), ("file", "hidden harbour", [0.0, 0.0, 0.0, 1.0]), ("miss", "nix", [0.0, 0.0, 0.0, 1.0])],
        "query_id string, text string, vec array<double>",
    )
    s = stores(spark)
    a = cascade.retrieve(q, s)
    got = {r.query_id: r for r in a.answers.collect()}
    assert {k: r.source for k, r in got.items()} == {"path": "tier1", "fact": "tier1", "both": "tier1+tier2", "name": "tier2", "file": "tier2", "miss": "miss"}
    assert got["path"].hits == ["about n1", "about e1"] and got["path"].confidence == 1.0
    assert got["file"].confidence == 0.0 and got["file"].reconsolidated and "harbour again" in got["file"].hits[0] and "nothing" not in got["file"].hits[0]
    assert got["both"].hits[0].startswith("[hop 0 | entity") and got["miss"].hits == []
    assert rows(a.new_pathways, "key_terms") == [("n1 person",), ("x",)] and a.new_facts.count() == 1
    deep = {r.query_id: r.source for r in cascade.retrieve(q, s, deep_search=True).answers.collect()}
    assert deep["fact"] == "tier1+tier2"
    assert cascade.format_context(a.answers.filter("query_id = 'path'")).first().context == "[1] about n1\n\n[2] about e1"
    assert cascade.web_tier(spark).count() == 0


def test_grep(spark):
    r = spark.createDataFrame([("a", "The Stone bridge\nby the river\nSTONE"), ("b", "stone only"), ("c", None), ("d", "limestonebridgework")], "stem string, content string")
    q = spark.createDataFrame([(1, "stone & bridge, who?"), (2, "who is it"), (3, None), (4, "zzzz stone")], "query_id int, text string")
    got = {(x.query_id, x.stem): x.block for x in grep.grep(q, r).collect()}
    assert got == {(1, "a"): "[a]\nThe Stone bridge\nSTONE", (1, "d"): "[d]\nlimestonebridgework"}
    many = spark.createDataFrame([("m", "\n".join(f"stone {i}" for i in range(30)))], "stem string, content string")
    assert grep.grep(spark.createDataFrame([(1, "stone")], "query_id int, text string"), many).first().block.count("\n") == 10


def test_chunks(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcde  \n") for _ in range(rnd.randrange(0, 900))) for _ in range(30)] + [None, "x" * 30, "y" * 1000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("chunk_id", F.lit("clash"))
    got = {(r.doc_id, r.chunk_id): r.text for r in segments.chunks(d, 100, 30).collect()}
    assert (30, 0) not in got and (31, 0) not in got and got[32, 0] == "y" * 100 == got[32, 1]
    for i, t in enumerate(texts[:30]):
        at = list(segments.windows(t, 100, 30))
        assert (at[0][0] == 0 and at[-1][1] == len(t)) if t else not at
        for (s, e), (s2, _) in zip(at, at[1:]):
            assert s2 == max(s + 1, e - 30) and e - s <= 100
            assert t[e] in " \n" and not set(t[e + 1 : s + 101]) & {" ", "\n"} if set(t[s + 1 : s + 101]) & {" ", "\n"} else e - s == 100
        kept = [t[s:e].strip() for s, e in at if len(t[s:e].strip()) >= segments.CHUNK]
        assert kept == [got[i, k] for k in range(len(kept))] and (i, len(kept)) not in got


def test_segments(spark):
    a, b = "a" * 79, "b" * 80
    d = spark.createDataFrame([(1, f"{a}\n \n {b} \n\n" + "c" * 90)], "doc_id long, text string")
    assert rows(segments.by_paragraph(d), "segment_id", "text") == [(0, b), (1, "c" * 90)]
    d = spark.createDataFrame([(1, "x" * 21 + "\n***\n" + "y" * 20 + "\n---\n" + "z" * 25), (2, "short")], "doc_id long, text string")
    assert rows(segments.segment(d, "scene_break"), "doc_id", "text") == [(1, "x" * 21), (1, "z" * 25)]
    assert segments.segment(d, "unknown").count() == 0
    s = spark.createDataFrame([(1, 0, "one", [1.0, 0.0]), (1, 1, "two", [1.0, 0.1]), (1, 2, "x" * 10, [0.0, 1.0]), (1, 3, "y" * 200, [1.0, 0.0])], "doc_id long, sent_id int, text string, vec array<double>")
    assert rows(segments.by_meaning(s), "segment_id", "text") == [(0, "one two " + "x" * 10), (2, "y" * 200)]
    w = segments.context_windows(segments.sentences(spark.createDataFrame([(1, "A. B. C. D. E. F.")], "doc_id long, text string")))
    assert [r.context for r in w.orderBy("sent_id").collect()] == ["A. B. C.", "A. B. C. D.", "A. B. C. D. E.", "B. C. D. E. F.", "C. D. E. F.", "D. E. F."]


TOK = annotate.TOKENS


def test_events_and_properties_from_tokens(spark):
    t = [
        (1, 0, 0, 0, "Ann", "ann", "PROPN", "nsubj", 1, "PERSON", 0), (1, 0, 0, 1, "opened", "open", "VERB", "ROOT", 1, None, None), (1, 0, 0, 2, "gates", "gate", "NOUN", "dobj", 1, None, None), (1, 0, 0, 3, "Paris", "paris", "PROPN", "dep", 1, "GPE", 1),
        (1, 0, 1, 4, "He", "he", "PRON", "nsubj", 5, None, None), (1, 0, 1, 5, "saw", "see", "VERB", "ROOT", 5, None, None), (1, 0, 1, 6, "Bob", "bob", "PROPN", "dobj", 5, "PERSON", 2), (1, 0, 1, 7, "captain", "captain", "NOUN", "appos", 6, None, None), (1, 0, 1, 8, "old", "old", "ADJ", "amod", 6, None, None),
        (1, 0, 2, 9, "Ann", "ann", "PROPN", "nsubj", 10, "PERSON", 3), (1, 0, 2, 10, "was", "be", "AUX", "ROOT", 10, None, None), (1, 0, 2, 11, "pilot", "pilot", "NOUN", "attr", 10, None, None), (1, 0, 2, 12, "from", "from", "ADP", "prep", 9, None, None), (1, 0, 2, 13, "Rome", "rome", "PROPN", "pobj", 12, None, None),
        (1, 1, 0, 0, "Nothing", "nothing", "PRON", "dep", 0, None, None),
    ]
    df = spark.createDataFrame(t, TOK)
    e = {(r.seg_id, r.sent_id): r for r in annotate.extract_events(df).collect()}
    assert set(e) == {(0, 0), (0, 1), (1, 0)}
    assert e[0, 0].title == "Ann open" and e[0, 0].outcome == "gates" and e[0, 0].participants == ["Ann"] and e[0, 0].locations == ["Paris"]
    assert e[0, 1].title == "Bob see" and e[0, 1].source_text.startswith("Ann opened") and e[1, 0].summary == "Nothing"
    assert rows(annotate.extract_properties(df), "entity", "attribute", "value") == [("Ann", "from", "from Rome"), ("Ann", "type", "pilot"), ("Bob", "condition", "old"), ("Bob", "role", "captain")]
    nameless = df.filter("seg_id = 0 and sent_id < 2").withColumn("ent_type", F.when(F.col("text") != "Bob", F.col("ent_type")))
    assert annotate.resolve_pronouns(nameless).first().text == "Ann opened gates Paris Ann saw Bob captain old"


def test_upsert_rules(spark):
    cur = spark.createDataFrame([("e1", "Ann", "person", ["A"], True, 0.9, 1, None, None), ("e2", "Bob", "person", [], True, 0.5, 1, None, None)], "id string, name string, entity_type string, aliases array<string>, is_stub boolean, confidence double, source_count bigint, first_seen date, last_updated date")
    m = spark.createDataFrame([("Ann", "x")] * 3 + [("New", "org")] * 3 + [("One", None), (None, "x")], "name string, entity_type string")
    day = dt.date(2026, 1, 1)
    got = {r.name: (r.entity_type, r.is_stub, r.confidence, r.source_count, r.last_updated) for r in upsert.upsert_entities(cur, m, F.lit(day)).collect()}
    assert got == {"Ann": ("person", False, 0.97, 4, day), "Bob": ("person", True, 0.5, 1, None), "New": ("org", False, 0.5, 3, day), "One": (None, True, 0.4, 1, day)}
    once = upsert.insert_absent(cur.select("id", "name"), spark.createDataFrame([("e1", "z"), ("e9", "b"), ("e9", "a")], "id string, name string"), "id")
    assert rows(once) == [("e1", "Ann"), ("e2", "Bob"), ("e9", "a")] and rows(upsert.insert_absent(once, once, "id")) == rows(once)
    al = upsert.add_aliases(cur, spark.createDataFrame([("e1", "B"), ("e1", "A"), ("e1", None)], "id string, alias string"))
    assert {r.id: r.aliases for r in al.collect()} == {"e1": ["A", "B"], "e2": []}
    edges = spark.createDataFrame([("e1", "e2", "K", None, 5)], upsert.EDGE_SCHEMA)
    more = spark.createDataFrame([("e1", "e2", "K", "r", 1), ("e2", "e1", "K", None, 3), ("e2", "e1", "K", None, 2), ("e1", "gone", "K", None, 1)], upsert.EDGE_SCHEMA)
    assert rows(upsert.add_edges(edges, more, cur), "src", "dst", "specificity") == [("e1", "e2", 5), ("e2", "e1", 2)]
    paths = spark.createDataFrame([("k" * 80 + "a", ["x"], 1), ("k" * 80 + "b", ["y"], 2)], "key_terms string, pathway array<string>, seq int")
    kept = upsert.store_pathways(spark.createDataFrame([], "id string, key_terms string, pathway array<string>, seq int"), paths)
    assert rows(kept, "pathway") == [(["y"],)]
    assert upsert.delete_ids(kept, kept).count() == 0
    props = upsert.merge_properties(spark.createDataFrame([("Ann", {"age": "3", "job": "x"})], "name string, properties map<string,string>"), spark.createDataFrame([("Ann", "age", "4", 1), ("Ann", "age", "5", 2), ("Zoe", "a", "b", 1)], "name string, attribute string, value string, seq int"))
    assert {r.name: r.properties for r in props.collect()} == {"Ann": {"job": "x", "age": "5"}, "Zoe": {"a": "b"}}
    rec = upsert.record_entries(spark.createDataFrame([("p", "Ann", "2025-01-02", "late"), ("p", "Ann", "2025-01-01", "early")], "type string, name string, date string, fact string"))
    assert rec.first().entries == "### 2025-01-01\n- early\n\n### 2025-01-02\n- late\n\n"


def test_resolution_ways(spark):
    ents = spark.createDataFrame([("a", "Ann Lee", False, ["Annie"]), ("b", "Bobby Rays", False, []), ("c", "Stub Name", True, []), ("d", "Carl Gustav Moe", False, []), ("e", "Ann Lee", False, [])], "id string, name string, is_stub boolean, aliases array<string>")
    n = spark.createDataFrame([("Ann Lee!",), ("Annie",), ("Rays Boby",), ("Gustav",), ("Stub Nam",), ("Zed",), (None,)], "name string")
    vec = spark.createDataFrame([("Zed", [1.0, 0.6]), ("Stub Nam", [1.0, 0.0])], "name string, vec array<double>")
    facts = spark.createDataFrame([("f", [1.0, 0.0], "a")], "id string, vec array<double>, entity_id string")
    got = {r.input_name: (r.node_id, r.matched_by, r.is_ambiguous) for r in linking.resolve_names(n, ents, vec, facts).collect() if r.input_name}
    assert got == {"Ann Lee!": ("a", "exact", False), "Annie": ("a", "alias", False), "Rays Boby": ("b", "fuzzy", False), "Gustav": ("d", "fuzzy", False), "Stub Nam": ("a", "semantic", False), "Zed": (None, "ambiguous", True)}


def test_fuzzy_equals_all_pairs(spark):
    rnd = random.Random(8)
    known = ["".join(rnd.choice("abcde") for _ in range(rnd.randrange(3, 12))) for _ in range(40)]
    known += ["".join(rnd.choice("abcde ") for _ in range(n)) for n in (20, 33, 44, 47, 48, 49, 52, 60, 61, 80)]
    typed = []
    for k in known:
        i = rnd.randrange(len(k))
        if len(k) > 18:
            cut = set(rnd.sample(range(len(k)), rnd.randrange(1, len(k) // 6)))
            typed += ["".join(c for j, c in enumerate(k) if j not in cut), "".join(c + ("z" if j in cut else "") for j, c in enumerate(k))]
        typed += [k[:i] + k[i + 1 :], k[:i] + "z" + k[i:], k]
    kn = spark.createDataFrame([(f"i{i:02}", k) for i, k in enumerate(known)], "id string, name string")
    got = {r.name: (r.id, round(r.ratio, 6)) for r in linking.fuzzy_match(spark.createDataFrame([(t,) for t in typed], "name string"), kn).collect()}
    for t in set(typed):
        best = min(((-linking.token_sort_ratio(t, k), f"i{i:02}") for i, k in enumerate(known)))
        assert got.get(t) == ((best[1], round(-best[0], 6)) if t.strip() and -best[0] >= 88 else None), t


def test_as_of_links(spark):
    schema = "id string, temporal_order bigint, participants array<string>, locations array<string>"
    old = spark.createDataFrame([("o1", 1, ["Ann"], []), ("o2", 5, ["Ann", "Bob"], []), ("o3", 5, ["Bob"], []), ("o4", None, ["Place"], [])], schema)
    new = spark.createDataFrame([("n1", 5, ["Ann"], []), ("n2", 6, ["Bob"], None), ("n3", 3, ["Zed"], ["Place"]), ("n4", 1, ["Ann"], []), ("n5", 9, None, None)], schema)
    new = new.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("participants", "locations")})
    assert rows(linking.link_across(new, old)) == [("o1", "n1"), ("o3", "n2"), ("o4", "n3")]


def test_entity_graph(spark):
    ev = spark.createDataFrame([("e1", ["Ann", "Bob", "ann"], ["Mill"]), ("e2", ["Bob", "Ann", "Who"], None)], "id string, participants array<string>, locations array<string>")
    known = spark.createDataFrame([("Ann",), ("Bob",), ("Mill",)], "name string")
    assert rows(entity_graph.co_occurrences(ev, known)) == [("Ann", "Bob", "CO_OCCURS"), ("Ann", "ann", "CO_OCCURS")]
    assert rows(entity_graph.located_in(ev, known)) == [("Ann", "Mill", "LOCATED_IN"), ("Bob", "Mill", "LOCATED_IN")]
    ents = spark.createDataFrame([("1", "Ann", False), ("2", "Bob", False)], "id string, name string, is_stub boolean")
    edge = spark.createDataFrame([("1", "2", "ALIAS_OF"), ("1", "1", "ALIAS_OF")], "src string, dst string, kind string")
    arcs = entity_graph.alias_arcs(edge, ents)
    assert rows(arcs) == [("Ann", "Bob", "ALIAS_OF")]
    seeds = spark.createDataFrame([("ann", [1.0])], "id string, vec array<double>")
    q = spark.createDataFrame([(1, [1.0])], "query_id int, vec array<double>")
    nodes = spark.createDataFrame([("Ann", "person", "d")], "name string, node_type string, description string")
    n, a = entity_graph.search(q, seeds, nodes, arcs)
    assert rows(n, "name") == [("Ann",)] and "Ann --[ALIAS_OF]--> Bob" in entity_graph.format_graph(n, a).first().context


def test_search_names(spark):
    ents = spark.createDataFrame([("b", "Ann Lee", False), ("a", "Ann Lee Moe", False), ("c", "Ann Lee", True), ("d", "Zed", True)], "id string, name string, is_stub boolean")
    q = spark.createDataFrame([(1, "ann LEE"), (2, "zed"), (3, "a"), (4, "is ann lee")], "query_id int, text string")
    assert rows(graph.search_entities(q, ents), "query_id", "entity_id", "rank") == [(1, "a", 1), (1, "b", 2), (2, "d", 1)]


def test_sweep_follows_the_cascade(spark):
    from dataclasses import replace

    c = sweep.build_configs(spark)
    base = c.filter("config = 'baseline'").first()
    assert base.propagation_decay == 0.9 and c.select("config").distinct().count() == c.count() > 60
    assert all(c.filter(f"param = '{k}'").count() >= 4 for k in sweep.KNOBS)
    names = [("a", "Ann", False), ("b", "Bob", False), ("c", "Cid", True), ("d", "Dee", False)]
    nodes = spark.createDataFrame([(i, "entity", n, f"about {n}", st) for i, n, st in names], "id string, node_type string, name string, content string, is_stub boolean")
    vec = {"a": [1.0, 0.0], "b": [0.8, 0.6], "c": [0.6, 0.8], "d": [0.9, 0.1]}
    vectors = spark.createDataFrame(list(vec.items()), "id string, vec array<double>")
    adj = graph.adjacency(spark.createDataFrame([(x, y, "CAUSES") for x, y in ("ab", "bc", "cd")], "src string, dst string, kind string"))
    fact = "id string, text string, user_id string, pathway array<string>, vec array<double>"
    facts = spark.createDataFrame([("f1", "Entity: Ann | Type: x", "app_user", [], [0.7, 0.7]), ("f2", "plain words", "app_user", [], [0.2, 1.0])], fact)
    paths = spark.createDataFrame([("p", ["a", "b"], [0.5, 0.8])], "id string, pathway array<string>, vec array<double>")
    ents = spark.createDataFrame(names, "id string, name string, is_stub boolean")
    records = spark.createDataFrame([("r", "stone bridge")], "stem string, content string")
    s = cascade.Stores(nodes, adj, ents, vectors, facts, paths, records)
    q = spark.createDataFrame([(1, "xx", [1.0, 0.0]), (2, "stone bridge", [-1.0, -0.2]), (3, "ann", [0.0, 1.0]), (4, None, [-1.0, -0.2])], "query_id int, text string, vec array<double>")
    some = c.filter("config in ('baseline', 'propagation_max_depth=1', 'entry:open+reach:open+weight:closed')")
    got = {(r.config, r.query_id): r for r in sweep.sweep(q, s, some).collect()}
    assert len(got) == 4 * some.count() == 12 and {r.source for r in got.values()} >= {"tier1", "tier2", "miss"}
    for r in some.collect():
        knobs = {k: type(getattr(RetrievalConfig(), k))(r[k]) for k in sweep.KNOBS}
        want = cascade.retrieve(q, s, replace(RetrievalConfig(), **knobs)).answers.collect()
        for w in want:
            g = got[r.config, w.query_id]
            assert (g.source, round(g.confidence, 9)) == (w.source, round(w.confidence, 9)), (r.config, w, g)
    assert "| a |" in evaluation.report(spark.createDataFrame([(1,)], "a int").collect(), "x") and evaluation.report([], "x")


def test_config_from_env(monkeypatch):
    monkeypatch.setenv("PROPAGATION_MAX_DEPTH", "7")
    assert RetrievalConfig.from_env().propagation_max_depth == 7 and RetrievalConfig().propagation_max_depth == 4


def test_search_names_by_any_part_without_broadcast(spark):
    names = ["Ann Lee", "Ox House", "House of Roxanne-Lee", "x", "Brotherhoodlum of Lee", "Brotherhood"]
    ents = spark.createDataFrame([(f"i{i}", n, i == 3) for i, n in enumerate(names)], "id string, name string, is_stub boolean")
    q = spark.createDataFrame([(1, "X."), (2, "e. nn le"), (3, "LEE lee brotherhoodl"), (4, "ox-a"), (5, "house of ox lee zed"), (6, "X.")], "query_id int, text string")
    found = graph.search_entities(q, ents, 2)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found, "query_id", "entity_id", "rank") == [(1, "i1", 1), (1, "i2", 2), (2, "i0", 1), (2, "i2", 2), (3, "i4", 1), (4, "i2", 1), (6, "i1", 1), (6, "i2", 2)]


def test_fuzzy_meets_few_candidates(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("bdfgkst") + rnd.choice("aeiou") for _ in range(rnd.randrange(2, 5)))
    known = [f"{word()} {word()} brotherhood" for _ in range(60)] + [f"{word()} {word()}" for _ in range(60)]
    typed = list(known[:5])
    for k in known:
        for _ in range(3):
            t = list(k)
            for _ in range(rnd.randrange(1, 4)):
                t.insert(rnd.randrange(len(t) + 1), rnd.choice("aeb ")) if rnd.random() < 0.5 else t.pop(rnd.randrange(len(t)))
            typed.append("".join(t))
    assert len(linking._probe_keys("disciples humichas sevutes", 88.0)) <= 150
    for t in typed[:100]:
        for k in known:
            if linking.token_sort_ratio(t, k) >= 88:
                a, b = (linking.letter_marks(" ".join(sorted(s.split()))) for s in (t, k))
                assert (a[0] ^ b[0]).bit_count() + (a[1] ^ b[1]).bit_count() <= 0.12 * (len(t) + len(k)) or a == b
    kn = spark.createDataFrame([(f"i{i:03}", k) for i, k in enumerate(known)], "id string, name string")
    found = linking.fuzzy_match(spark.createDataFrame([(t,) for t in typed], "name string"), kn)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.name: (r.id, round(r.ratio, 6)) for r in found.collect()}
    for t in set(typed):
        best = min((-linking.token_sort_ratio(t, k), f"i{i:03}") for i, k in enumerate(known))
        assert got.get(t) == ((best[1], round(-best[0], 6)) if -best[0] >= 88 else None), t


def test_reach_counts_of_a_hub(spark):
    pairs = {(f"S{i}", "Hub") for i in range(6)} | {("Hub", f"t{i}") for i in range(9)} | {("S1", "S2"), ("S1", "t3"), ("t3", "S1"), ("hub", "Hub"), ("S5", "s5"), ("S4", "z")}
    arcs = spark.createDataFrame([(a, b, "R") for a, b in sorted(pairs)] * 2, "source string, target string, relation string")
    want = []
    for s in {a.lower() for a, _ in pairs}:
        one = {b.lower() for a, b in pairs if a.lower() == s} - {s}
        two = {b.lower() for a, b in pairs if a.lower() in one} - one - {s}
        want.append((s, 1 + len(one) + len(two), 2 if two else 1 if one else 0, sum(a.lower() in {s} | one | two for a, _ in pairs)))
    assert rows(traversal.reach_counts(arcs), "name", "n_nodes", "max_hop", "n_arcs") == sorted(want, key=repr)


def test_later_ways_see_only_names_still_open(spark, monkeypatch):
    asked = {}
    for f in ("fuzzy_match", "token_subset_match"):
        own = getattr(linking, f)
        monkeypatch.setattr(linking, f, lambda n, k, f=f, own=own: asked.update({f: sorted(r.name for r in n.collect())}) or own(n, k))
    ents = spark.createDataFrame([("a", "Ann Lee", False, ["Annie"]), ("b", "Bobby Rays", False, []), ("d", "Carl Gustav Moe", False, [])], "id string, name string, is_stub boolean, aliases array<string>")
    n = spark.createDataFrame([("Ann Lee",), ("Annie",), ("Rays Boby",), ("Gustav",)], "name string")
    got = {r.input_name: (r.node_id, r.matched_by) for r in linking.resolve_names(n, ents).collect()}
    assert got == {"Ann Lee": ("a", "exact"), "Annie": ("a", "alias"), "Rays Boby": ("b", "fuzzy"), "Gustav": ("d", "fuzzy")}
    assert asked == {"fuzzy_match": ["Gustav", "Rays Boby"], "token_subset_match": ["Gustav"]}
