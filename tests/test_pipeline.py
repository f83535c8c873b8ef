import datetime as dt
from dataclasses import replace
from types import SimpleNamespace

from helpers import rows
from pyspark.sql import functions as F

from skein.functions import hooks
from skein.functions.vectors import embedder
from skein.operators import cascade, memory, methods, pipeline, segments, upsert
from skein.sources import books
from test_operators import stores

TEXT = "Ann Lee opened the great gates near Old Mill Bridge. Bob Ray watched the gates with Ann Lee for a long while.\n\nBob Ray counted the heavy carts outside Old Mill Bridge, and Ann Lee wanted to leave the city at once."


def docs(spark, ids=(1,)):
    return spark.createDataFrame([(i, f"t{i}", TEXT, "s", None) for i in ids], "doc_id bigint, title string, text string, source string, date date")


def test_ingest_twice_adds_nothing(spark):
    day = F.lit("2026-01-01").cast("date")
    g0 = pipeline.empty_graph(spark)
    g1, r1 = pipeline.ingest(docs(spark), g0, day)
    ev = {r.title: r for r in g1.events.collect()}
    assert "Ann Lee open" in ev and ev["Ann Lee open"].participants == ["Ann Lee"] and ev["Ann Lee open"].locations == ["Old Mill Bridge"]
    ents = {r.name: r for r in g1.entities.collect()}
    assert not ents["Ann Lee"].is_stub and ents["Ann Lee"].source_count >= 3 and ents["Old Mill Bridge"].entity_type == "location"
    kinds = {r.kind: r["count"] for r in g1.edges.groupBy("kind").count().collect()}
    assert kinds["PARTICIPANT_IN"] >= 4 and kinds["LOCATED_AT"] >= 2 and kinds["PRECEDES"] >= 2
    assert {r.matched_by for r in r1.collect()} == {"new"}
    g2, _ = pipeline.ingest(docs(spark), g1, day)
    assert rows(g2.events, "id") == rows(g1.events, "id") and rows(g2.edges, "src", "dst", "kind") == rows(g1.edges, "src", "dst", "kind") and g2.documents.first().date == dt.date(2026, 1, 1)
    g3, r3 = pipeline.ingest(docs(spark, (2,)), g1, day)
    assert {r.matched_by for r in r3.collect()} == {"exact"} and g3.entities.filter("name = 'Ann Lee'").count() == 1
    s = pipeline.summary(g1, g3, r3).first()
    assert s.documents == 2 and s.events == 2 * s.events_before and s.ambiguous == 0
    pipeline.create_tables(g3, "kg_")
    assert spark.sql("select count(*) from kg_events").first()[0] == s.events


def test_an_ingested_document_is_answered(spark):
    day = F.lit("2026-01-01").cast("date")
    g0 = pipeline.empty_graph(spark)
    g1, _ = pipeline.ingest(docs(spark), g0, day)
    m1 = memory.remember(memory.empty_memory(spark), g0, g1, day)
    texts = {r.text for r in m1.facts.collect()}
    assert any(t.startswith("Event: Ann Lee open | ") for t in texts) and "Entity: Old Mill Bridge | Type: location" in texts
    rec = {r.name: r.content for r in m1.records.collect()}
    assert "### 2026-01-01" in rec["Ann Lee"] and books.SENTINEL in rec["Ann Lee"]
    assert m1.pathways.filter(F.size("pathway") > 1).count() > 0 and m1.pathways.filter("seq like 'evt%'").count() > 0
    again = memory.remember(m1, g1, g1, day)
    assert rows(again.facts, "id") == rows(m1.facts, "id") and rows(again.records, "content") == rows(m1.records, "content")
    forced = memory.remember(m1, g1, g1, day, force=True, consolidate=lambda p: "NONE")
    assert rows(forced.facts, "id") == rows(m1.facts, "id") and rows(forced.pathways, "id") == rows(m1.pathways, "id")
    q = spark.createDataFrame([(1, "Ann Lee")], "query_id int, text string").withColumn("vec", embedder()(F.col("text")))
    a = cascade.retrieve(q, memory.stores(g1, m1))
    got = a.answers.first()
    assert got.source != "miss" and any("gates" in h for h in got.hits)
    m2 = memory.write_back(m1, a, "answers-1")
    assert m2.pathways.count() == m1.pathways.count() + a.new_pathways.count() and m2.facts.count() == m1.facts.count() + a.new_facts.count()
    spilled = m1.facts.unionByName(m1.pathways.filter("seq like 'evt%'").select("id", F.col("key_terms").alias("text"), "seq", F.lit("x").alias("user_id"), "pathway", "vec"))
    assert rows(memory.forget_spilled(spilled, g1.events), "id") == rows(m1.facts, "id")


def test_modes_of_segments(spark):
    d = spark.createDataFrame([(1, "The cat sat here. " * 12 + "Stone bridges fell. " * 12), (2, None)], "doc_id bigint, text string")
    assert segments.segment(d, "semantic").count() >= 1
    told = segments.segment(d, "llm", model=lambda p: "The first scene is this one." + segments.MARK + "And this is the second scene.")
    assert [r.segment_id for r in told.filter("doc_id = 1").orderBy("segment_id").collect()] == [0, 1]
    assert rows(segments.segment(d, "llm")) == rows(segments.segment(d, "semantic"))


def test_empty_ingest(spark):
    g, r = pipeline.ingest(docs(spark).limit(0), pipeline.empty_graph(spark))
    assert g.events.count() == 0 and g.edges.count() == 0 and r.count() == 0


def test_methods(spark):
    s = stores(spark)
    q = spark.createDataFrame([(1, "hidden harbour", [0.0, 0.0, 1.0, 0.0]), (2, "n1 person", [1.0, 0.0, 0.0, 0.0])], "query_id int, text string, vec array<double>")
    got = {(r.method_name, r.query_id): r.context for r in methods.run_methods(q, s, 2).collect()}
    assert len(got) == 2 * len(methods.METHODS)
    assert got["dense", 1].startswith("sure") and got["filestore", 1].startswith("[r1]") and got["filestore", 2] == "" and "[hop 0" in got["graph_prop", 2] and got["cascade", 1].startswith("[1] sure") and got["rag_chunks", 1].startswith("[1] (1.0000) sure")
    assert "Entities:" in got["graph_rag", 2]
    assert methods.spread_of_starts(q, s).count() >= 1
    said = methods.conflicts(q, s.facts, lambda p: "clash" if "hidden" in p else "NONE")
    assert rows(said) == [(1, "clash")] and methods.conflicts(q, s.facts).count() == 0


def test_model_hook(spark):
    calls = []

    def flaky(p):
        calls.append(p)
        if len(calls) < 3:
            raise OSError
        return p.upper()

    assert hooks.with_retries(flaky)("x") == "X" and len(calls) == 3

    def broken(p):
        raise OSError

    p = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string")
    assert rows(hooks.ask(p, broken)) == [(1, None), (2, None)] and rows(hooks.ask(p)) == [(1, "NONE"), (2, "NONE")]


def test_indexes(spark):
    d = spark.createDataFrame([(1, "some words that are long enough to make a chunk of text here")], "doc_id bigint, text string")
    c = methods.index_chunks(d).first()
    assert len(c.vec) == 64 and abs(sum(x * x for x in c.vec) - 1) < 1e-5
    e = spark.createDataFrame([("1", "Ann", "p", False, {"a": "b"}), ("2", "ANN", "p", False, {}), ("3", "Stub", "p", True, {})], "id string, name string, node_type string, is_stub boolean, properties map<string,string>")
    assert rows(methods.index_entities(e), "key", "name") == [("ann", "ANN")]
    upsert.check_dimension(methods.index_chunks(d), 64).collect()


def test_graph_rag_takes_two_steps_over_the_entity_graph(spark):
    s = replace(stores(spark), arcs=spark.createDataFrame([("n1", "Bob Ray", "CO_OCCURS"), ("Bob Ray", "Old Mill", "LOCATED_IN")], "source string, target string, relation string"))
    more = spark.createDataFrame([("b1", "entity", "Bob Ray", "bob", False), ("m1", "entity", "Old Mill", "mill", False)], "id string, node_type string, name string, content string, is_stub boolean")
    s = replace(s, nodes=s.nodes.unionByName(more, allowMissingColumns=True))
    q = spark.createDataFrame([(1, "n1", [1.0, 0.0])], "query_id int, text string, vec array<double>")
    text = methods.graph_rag(q, s, 1).first().context
    assert "Bob Ray" in text and "Old Mill" in text.split("Relations:")[0]


def test_rag_chunks_searches_the_texts(spark):
    chunks = spark.createDataFrame([("c1", "a piece of a text", [1.0, 0.0]), ("c2", "another piece", [0.0, 1.0])], "id string, text string, vec array<double>")
    q = spark.createDataFrame([(1, "n1", [1.0, 0.0])], "query_id int, text string, vec array<double>")
    assert methods.rag_chunks(q, replace(stores(spark), chunks=chunks), 1).first().context == "[1] (1.0000) a piece of a text"


def test_method_contexts_runs_every_method(monkeypatch, spark):
    from skein.plans import retrieval

    asked = []
    monkeypatch.setattr(retrieval, "_stores", lambda spark, d: stores(spark))
    monkeypatch.setattr(retrieval, "_chunks", lambda spark, d: stores(spark).facts)
    monkeypatch.setattr(retrieval, "entity_graph_arcs", lambda spark, d: spark.createDataFrame([], "source string, target string, relation string"))
    monkeypatch.setattr(retrieval.entity_graph, "alias_arcs", lambda edge, ents: spark.createDataFrame([], "source string, target string, relation string"))
    monkeypatch.setattr(retrieval, "Graph", lambda spark, d: SimpleNamespace(edges=None, entities=None, mixed_questions=lambda: spark.createDataFrame([(1, "n1", [1.0, 0.0])], "query_id int, text string, vec array<double>")))
    for name in methods.METHODS:
        monkeypatch.setitem(methods.METHODS, name, lambda q, s, k, name=name: asked.append(name) or q.select("query_id", F.lit("x").alias("context")))
    got = retrieval.method_contexts(spark, "")
    assert set(asked) == set(methods.METHODS) and {r.method_name for r in got.collect()} == set(methods.METHODS)


def test_expansion_from_every_source_against_brute_force(spark):
    from skein.plans import registry, retrieval

    assert "entity_graph_expand" in registry.queries()
    arcs = {(f"N{a}", f"n{b}" if b % 3 else f"N{b}", "R") for a in range(14) for b in range(14) if a != b and (a * 7 + b * 5) % 11 == 0} | {("n1", "N2", "S"), ("N1", "End", "R")}
    want = set()
    for s in {a[0] for a in arcs}:
        level, seen, hop = {s.lower()}, {s.lower(): 0}, 0
        for hop in (1, 2):
            level = {t.lower() for x, t, _ in arcs if x.lower() in level} - set(seen)
            seen |= {t: hop for t in level}
        want.add((s, len(seen), max(seen.values()), sum(x.lower() in seen for x, _, _ in arcs)))
    got = retrieval._reach(spark.createDataFrame(sorted(arcs) * 2, "source string, target string, relation string"))
    assert set(rows(got, "query_id", "n_nodes", "max_hop", "n_arcs")) == want and len(want) > 10


def test_two_hops_of_all_kinds_against_pairs(spark):
    from skein.operators import graph
    from skein.plans import registry

    assert "graph_two_hops" in registry.queries()
    edge = [("p", f"e{i}", "PARTICIPANT_IN") for i in range(9)] + [(f"e{i}", f"l{i % 2}", "LOCATED_AT") for i in range(9)] + [("e1", "e2", "CAUSES"), ("e2", "e1", "CAUSES"), ("e3", "e3", "CAUSES"), ("q", "e4", "PARTICIPANT_IN"), ("x", "y", "PRECEDES")]
    df = spark.createDataFrame(edge, "src string, dst string, kind string")
    ids = df.select(F.col("src").alias("id")).union(df.select("dst")).distinct()
    want = rows(graph.hops(ids, df).groupBy("id").agg(F.count("*").alias("n")), "id", "n")
    assert rows(graph.hop_counts(df), "id", "n") == want and dict(want)["p"] >= 2


def test_methods_look_up_equal_vectors_once(monkeypatch, spark):
    """One run per vector for what reads no text, and what stands for a context is made there."""
    asked = []
    monkeypatch.setitem(methods.METHODS, "graph_rag", lambda q, s, k: asked.append(q.count()) or q.select("query_id", F.col("vec")[0].cast("string").alias("context")))
    q = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.0]), (3, "c", [0.0, 1.0])], "query_id int, text string, vec array<double>")
    got = methods.run_methods(q, stores(spark), only=["graph_rag"], show=lambda c: [F.length(c).alias("n"), c.alias("text")])
    assert sorted(rows(got, "query_id", "n", "text")) == [(1, 3, "1.0"), (2, 3, "1.0"), (3, 3, "0.0")] and asked == [2]


def test_methods_share_lookups(monkeypatch, spark):
    """Facts, graph and records are looked up once for all methods, with the rows of each method alone."""
    from skein.operators import grep, vector

    q = spark.createDataFrame([(1, "n1", [1.0, 0.0]), (2, "stone", [0.3, 0.7]), (3, "n1", [1.0, 0.0])], "query_id int, text string, vec array<double>")
    names = ["dense", "graph_prop", "filestore", "cascade"]
    alone = {(n, *r) for n in names for r in rows(q.select("query_id").join(methods.METHODS[n](q, stores(spark), 5), "query_id", "left").fillna(""), "query_id", "context")}
    calls = []
    facts, records = vector.search_facts, grep.grep_context
    monkeypatch.setattr(vector, "search_facts", lambda *a, **k: calls.append("facts") or facts(*a, **k))
    monkeypatch.setattr(grep, "grep_context", lambda *a, **k: calls.append("records") or records(*a, **k))
    got = methods.run_methods(q, stores(spark), only=names)
    assert set(rows(got, "method_name", "query_id", "context")) == alone and sorted(calls) == ["facts", "records"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0  # each method is written before the next


def test_graph_contexts_equal_lines_of_all_arcs(spark):
    from skein.operators import entity_graph

    arcs = [("Ann", "Bob", "R"), ("ANN", "Cid", "R"), ("Ann", "Bob", "A"), ("Ann (x)", "Ann", "R"), ("Ann --[M", "Bob", "R"), ("Ann", "Ann --[M", "S"), ("Bob", "Ann (x)", "R"), ("Bob", "Dan", None), ("Far", "Ann", "R")]
    arcs = spark.createDataFrame(arcs * 2, "source string, target string, relation string")
    seeds = spark.createDataFrame([("ann", [1.0, 0.0]), ("far", [0.0, 1.0])], "id string, vec array<double>")
    nodes = spark.createDataFrame([("Ann", "p", None), ("ann", "q", "last"), ("Bob", "p", "x"), ("Far", "p", "f")], "name string, node_type string, description string")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "query_id int, vec array<double>")
    want = rows(entity_graph.format_graph(*entity_graph.search(q, seeds, nodes, arcs, 1)), "query_id", "context")
    assert rows(entity_graph.contexts(q, seeds, nodes, arcs, 1), "query_id", "context") == want and len(want) == 2


def test_grep_finds_keywords_within_runs_of_letters(spark):
    from skein.operators import grep

    r = spark.createDataFrame([(1, "A KEYstones row\nand more"), (2, "key stones"), (3, None), (4, "xkeystonex7more"), (5, "MORE")], "stem int, content string")
    q = spark.createDataFrame([(1, "keystone"), (2, "more keystone"), (3, "more absent"), (4, "abc"), (5, None), (6, "MORE more")], "query_id int, text string")
    assert sorted(rows(grep.grep(q, r), "query_id", "stem")) == [(1, 1), (1, 4), (2, 1), (2, 4), (6, 1), (6, 4), (6, 5)]
