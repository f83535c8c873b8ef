import pytest
from pyspark.sql import functions as F

from skein.llm.pairs import breaks_off, defects, is_copied, is_empty, is_other_language, is_refusal, missing_anchors, open_constructs, tiles, visible

Q = "Where did Ann Lee meet Bob Ray over the 12 carts?"


@pytest.mark.parametrize("a, want", [("", True), (" ​", True), ("N/A", True), ("[blank]", True), ("<p> </p>", True), ("Answer:", True), ("...", True), ("5", False), ("No", False), ("None of them came.", False)])
def test_empty(a, want):
    assert is_empty(visible(a)) is want


@pytest.mark.parametrize(
    "a, want",
    [
        ("I'm sorry, but I can't help with that.", True), ("Unfortunately, there is not enough information to say.", True), ("As an assistant, I must decline.", True), ("Je ne peux pas répondre.", True), ("Leider kann ich das nicht sagen.", True),
        ("Lo siento, no puedo responder.", True), ("Sorry", True), ("Ann Lee refused to answer Bob Ray.", False), ("I cannotation of the map", False), ("She said she was sorry.", False), ("The text on the wall.", False),
    ],
)
def test_refusal(a, want):
    assert is_refusal(a) is want


@pytest.mark.parametrize(
    "a, want",
    [(Q, True), (Q.upper(), True), ("Q: " + Q, True), (Q + " " + Q, True), (" ".join([Q] * 30), True), ("Where did Ann Lee mete Bob Ray over the 12 catrs", True), (Q + " At Old Mill", False), (Q + " Ann Lee", False), ("Ann Lee", False), ("Ann Lee met Bob Ray at Old Mill.", False)],
)
def test_copied(a, want):
    assert is_copied(Q, a) is want


def test_tiles_are_disjoint_and_longest_first():
    t = tiles("a b c d x a b".split(), "a b c d a b".split())
    assert t[0] == (0, 0, 4) and sum(n for _, _, n in t) == 6


@pytest.mark.parametrize(
    "a, want",
    [("Sie trafen sich in Old Mill, wo beide waren, als es um die Karren ging.", True), ("Это было на мельнице.", True), ("一共有十件，他们都知道。", True), ("They met at Old Mill, and both of them were there.", False), ("In Old Mill", False), ("Old Mill", False), ("12", False)],
)
def test_language(a, want):
    assert is_other_language(Q, a) is want


@pytest.mark.parametrize("a, want", [("(one [two] three)", []), ("(one [two", ["(", "["]), ("```\ncode", ["```"]), ('he said "yes', ['"']), ("<b>x<br>y", ["<b>"]), ("<b>x</b> „y“", []), ("one\n2.", ["list"]), ("it's fine :-)", [])])
def test_parser(a, want):
    assert open_constructs(a) == want


@pytest.mark.parametrize("a, want", [("They met at", True), ("They met at Old Mill,", True), ("They counted ca", True), ("At Old Mill", False), ("12 carts", False), ("They met at Old Mill.", False), ("They went and ...", True), ("Both knew (", True)])
def test_breaks_off(a, want):
    assert breaks_off(Q, a, None) is want


ROW = "result_id bigint, question string, expected_answer string, retrieval_anchor string, source_doc_id bigint, context string"


def test_defects(spark):
    docs = spark.createDataFrame([(1, "Ann  Lee\nmet Bob Ray at Old Mill."), (2, None)], "doc_id bigint, text string").withColumn("anchor", F.lit("clash"))
    good = "ann lee met"
    rows = [
        (1, Q, "At Old Mill", good, 1, None), (2, Q, None, good, 1, None), (3, Q, "I cannot say.", good, 1, None), (4, Q, Q, good, 1, None), (5, Q, "Es waren alle in der Mühle, und das war gut.", good, 1, None), (6, Q, "They met at", good, 1, None),
        (7, Q, "At Old Mill", " ", 1, None), (8, Q, "At Old Mill", None, 1, None), (9, Q, "At Old Mill", "elsewhere", 1, None), (10, Q, "At Old Mill", good, 2, None), (11, Q, "At Old Mill", good, 99, None), (12, Q, "At Old Mill", good, None, None), (13, None, "At Old Mill", good, 1, None),
        (14, Q, None, "elsewhere", 1, None), (None, Q, None, good, 1, None), (2, Q, None, good, 1, None),
    ]
    df = spark.createDataFrame(rows, ROW).withColumn("defect", F.lit("clash"))
    got = {r.result_id: r.defect for r in defects(df, docs).collect()}
    want = {2: "empty_answer", 3: "refusal", 4: "copied_question", 5: "other_language", 6: "truncated_answer", 14: "empty_answer"} | {i: "anchor_missing" for i in (7, 8, 9, 10, 11, 12)}
    assert got == want
    assert defects(df.limit(0), docs).count() == 0 and missing_anchors(df.filter("result_id = 1"), docs.limit(0)).count() == 1


def test_a_cut_clause_is_found_by_counts(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    rows = [(i, None, f"There were {i} carts in all, and both Ann Lee and Bob Ray knew the number" + "." * (i % 2), "x", 1, None) for i in range(40)]
    rows.append((99, None, "There were 7 carts in all, and both Ann Lee and Bob Ray", "x", 1, None))
    got = [tuple(r) for r in defects(spark.createDataFrame(rows, ROW), docs).collect()]
    assert got == [(99, "truncated_answer")]


def test_many_anchors_of_one_document(spark):
    text = " ".join(f"w{i}" for i in range(3_000))
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    df = spark.createDataFrame([(i, Q, "At Old Mill", f"W{i}  w{i + 1}" if i % 3 else f"w{i} w{i}", 1, None) for i in range(2_000)], ROW)
    assert {r.result_id for r in missing_anchors(df, docs).collect()} == {i for i in range(2_000) if not i % 3}


def test_very_long_answer(spark):
    docs = spark.createDataFrame([(1, "x " * 200_000)], "doc_id bigint, text string")
    df = spark.createDataFrame([(1, Q, "word " * 60_000 + "end.", "x x", 1, "c")], ROW)
    assert defects(df, docs).count() == 0
