import datetime as dt
import os
import zipfile

import pytest
from helpers import rows

from skein.sources import books
from skein.streaming import ingest


def make_epub(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfile full-path="OEBPS/book.opf"/></container>')
        z.writestr("OEBPS/book.opf", '<package><manifest><item id="a" href="Text/One.xhtml" media-type="application/xhtml+xml"/><item href="two.xhtml" id="b" media-type="text/html"/><item id="c" href="x.css" media-type="text/css"/><item id="d" href="gone.xhtml" media-type="text/html"/></manifest><spine><itemref idref="b"/><itemref idref="zz"/><itemref idref="c"/><itemref idref="a"/><itemref idref="d"/></spine></package>')
        z.writestr("OEBPS/text/one.xhtml", "<html><head><title>First &amp; last</title><style>p{}</style></head><body><p>" + "word " * 120 + "</p></body></html>")
        z.writestr("OEBPS/two.xhtml", "<html><body><h2>Second</h2><p>few words</p></body></html>")


def test_epub(spark, tmp_path):
    make_epub(tmp_path / "b.epub")
    c = books.read_epubs(spark, str(tmp_path))
    got = {r.position: r for r in c.collect()}
    assert [got[i].title for i in range(3)] == ["Second", "First & last", "gone"] and got[0].text == "Second few words" and got[2].n_words == 0
    assert {r.position: r.note for r in books.listing(c).collect()} == {0: "too short", 1: "", 2: "too short"}
    bad = tmp_path / "bad.zip"
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("META-INF/container.xml", "<container/>")
    with pytest.raises(ValueError):
        books.spine(bad.read_bytes())


def test_selection():
    assert books.parse_selection("all", 3) == [0, 1, 2] and books.parse_selection("2-9", 4) == [1, 2, 3] and books.parse_selection("3,1,3", 4) == [0, 2]
    assert books.parse_range("2-5") == (2, 5)
    with pytest.raises(ValueError):
        books.parse_range("5-2")


def test_chapters(spark, tmp_path):
    (tmp_path / "0002_B.xhtml").write_text("<html><body> a &amp; b </body></html>")
    (tmp_path / "0002_A.xhtml").write_text("no body <i>here</i>")
    (tmp_path / "0001_C.xhtml").write_text("Chapter 1: T Translator: x Editor: y rest")
    assert rows(books.read_chapters(spark, str(tmp_path)), "chapter", "doc_id", "text") == [(1, 0, "Chapter 1: T Translator: x Editor: y rest"), (2, 1, "no body here")]
    assert rows(books.read_chapters(spark, str(tmp_path), credits=True), "text")[1] == ("rest",)


def test_graph_and_questions(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"name": "A", "type": "p", "description": "d"}],\n "edges": [{"source": "A", "target": "B", "relation": "R"}]}')
    n, a = books.read_graph(spark, str(tmp_path / "g.json"))
    assert rows(n) == [("A", "p", "d")] and rows(a) == [("A", "B", "R")]
    n, a = books.read_graph(spark, str(tmp_path / "none.json"))
    assert n.count() == 0 and a.count() == 0
    (tmp_path / "q.json").write_text('[{"question": "q1", "expected_answer": "a", "source_doc_id": 3}, {"question": "q2"}]')
    assert rows(books.read_questions(spark, str(tmp_path / "q.json")), "position", "question", "source_doc_id") == [(0, "q1", 3), (1, "q2", None)]
    assert books.read_questions(spark, str(tmp_path / "q.json"), limit=1).count() == 1
    r = spark.createDataFrame([(4, 'Sure: [{"question":"q","expected_answer":"a","retrieval_anchor":"r","question_type":"odd"},{"question":""}] end]'), (5, "no array")], "chapter int, response string")
    assert rows(books.parse_generated(r)) == [("q", "a", "r", "attribute_recall", 3)]


def test_records(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "Ann_Lee.md").write_text("---\nname: Ann Lee\naliases: ['A', \"B\"]\n---\n\nbody\n<!-- USER NOTES -->\nmine\n")
    (tmp_path / "p" / "No_Name.md").write_text("just text")
    got = {r.stem: r for r in books.parse_records(books.read_records(spark, str(tmp_path))).collect()}
    assert got["Ann_Lee"].aliases == ["A", "B"] and got["Ann_Lee"].has_sentinel and "mine" in got["Ann_Lee"].notes and "mine" not in got["Ann_Lee"].body
    assert got["No_Name"].name == "No Name" and not got["No_Name"].has_sentinel and got["No_Name"].aliases == []
    cur = spark.createDataFrame([("p", "Ann", "top\n<!-- USER NOTES -->\nmine"), ("p", "Bob", "no mark")], "type string, name string, content string")
    new = spark.createDataFrame([("p", "Ann", "E"), ("p", "Bob", "E"), ("p", "New", "E")], "type string, name string, entries string")
    out = {r.name: r.content for r in books.update_records(cur, new).collect()}
    assert out["Ann"] == "top\nE<!-- USER NOTES -->\nmine" and out["Bob"] == "no mark" and out["New"].count("E<!-- USER NOTES") == 1


def test_evidence_stream_drops_late_rows(spark, tmp_path):
    t = dt.datetime(2025, 1, 10, 12)
    schema = "ts timestamp_ntz, name string, user_id bigint"
    for i, batch in enumerate([[(t, "a", 1), (t, "a", 1), (t, "b", 2)], [(t + dt.timedelta(days=3), "a", 1)], [(t + dt.timedelta(days=4), "c", 1)], [(t, "a", 1), (t + dt.timedelta(days=5), "b", 2)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}.parquet"))
        for f in (tmp_path / "in" / f"{i}.parquet").iterdir():
            os.utime(f, (1_700_000_000 + 60 * i,) * 2)
    feed = ingest.read_feed(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], schema).schema)
    ingest.append_batches(ingest.evidence(feed), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "name", "mentions")
    assert ("a", 2) in got and ("b", 1) in got and ("a", 3) not in got


def test_link_stream_and_queue(spark, tmp_path):
    schema = "id string, temporal_order bigint, participants array<string>, locations array<string>"
    old = spark.createDataFrame([("o", 1, ["Ann"], [])], schema)
    spark.createDataFrame([("n", 2, ["Ann"], [])], schema).write.parquet(str(tmp_path / "in"))
    feed = ingest.read_feed(spark, str(tmp_path / "in"), old.schema)
    for _ in range(2):  # a second run finds nothing new and changes nothing
        ingest.link_feed(feed, old, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "from_id", "to_id") == [("o", "n")]
    q = spark.createDataFrame([("x", True), ("y", None)], "input_name string, is_ambiguous boolean")
    assert rows(ingest.review_queue(q), "input_name") == [("x",)]


def test_markdown_and_question_files(spark, tmp_path):
    r = spark.createDataFrame([("person", "Ann Lee", "---\nname: Ann Lee\n---\nbody"), (None, "a/b", "x")], "type string, name string, content string")
    assert books.write_markdown(r, str(tmp_path / "md")).count() == 2 and books.write_markdown(r, str(tmp_path / "md")).count() == 2
    assert rows(books.read_records(spark, str(tmp_path / "md")), "stem") == [("Ann_Lee",), ("a_b",)]
    q = spark.createDataFrame([("q", "a", "b", "cross_entity", 1)], books.QUESTION)
    for append, n in ((False, 1), (True, 2), (False, 1)):
        books.write_questions(q, str(tmp_path / "q"), append)
        assert books.read_question_lines(spark, str(tmp_path / "q")).count() == n
