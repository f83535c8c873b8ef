import random

import pytest
from pyspark.sql import functions as F

from skein.llm.history import EventHistory, repeated_events, same_event, signatures

EV = "id string, title string, summary string, document_id bigint, batch_no int"


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("Ann Lee sold 12 carts to Bob Ray at Old Mill.", "(again) At Old Mill, Ann Lee sold 12 carts to Bob Ray as agreed.", True),
        ("Ann Lee sold 12 carts to Bob Ray at Old Mill.", "ann lee sodl 12 carts to bob ray at old mill", True),
        ("Ann Lee sold 12 carts to Bob Ray at Old Mill.", "Ann Lee sold 12 carts to Bob Roy Smith at Old Mill.", True),
        ("Ann Lee sold 12 carts to Bob Ray at Old Mill.", "Ann Lee sold 12 carts to Tom Fox at Old Mill.", False),
        ("Ann Lee sold 12 carts to Bob Ray at Old Mill.", "Ann Lee sold 13 carts to Bob Ray at Old Mill.", False),
        ("Ann Lee sold 12 carts to Bob Ray at Old Mill.", "Ann Lee sold 12 boats to Bob Ray at Old Mill.", False),
        ("Ann Lee sold 12 carts to Bob Ray at Old Mill.", "Ann Lee sold 12 carts to Bob Ray at High Bridge.", False),
        ("", "Ann", False),
    ],
)
def test_same_event(a, b, want):
    assert same_event(a, b) is want and same_event(b, a) is want


def test_keys_are_stable_and_depend_on_the_set():
    k, _, s = signatures(["a b c 5 d", "d c b a 5 d", "", "quite other words", "words other quite"], frozenset())
    assert set(k[0]) == set(k[1]) and s[0] == s[1] and not len(k[2]) and not set(k[0]) & set(k[3]) and set(k[3]) == set(k[4])
    long = " ".join(f"{i} carts{i}" for i in range(20_000))
    assert len(signatures([long], frozenset())[0][0]) <= 4 * 14


NAMES = [f"{a}{b} {c}{d}" for a in ("Ar", "Be", "Co") for b in ("la", "mi", "no") for c in ("Sto", "Tri") for d in ("ven", "mar")]


def telling(rnd, who=None):
    a, b = who or rnd.sample(NAMES, 2)
    return (a, b, rnd.randrange(1, 99), rnd.choice(["carts", "bells", "ropes", "maps"]), rnd.choice(["Old Mill", "High Bridge", "East Gate"]))


def say(t, way):
    a, b, n, thing, place = t
    return [f"{a} sold {n} {thing} to {b} at {place}.", f"(again) At {place}, {a} sold {n} {thing} to {b} as agreed.", f"{a}  sold {n} {thing} to {b} at {place}".lower()][way]


def test_against_brute_force(spark):
    rnd = random.Random(9)
    told, rows = [], []
    for batch in range(4):
        for i in range(60):
            t = rnd.choice(told) if told and rnd.random() < 0.4 else telling(rnd)
            told.append(t)
            rows.append((f"b{batch}_{i:03}", "t", say(t, rnd.randrange(3)), 1, batch))
    accepted, want = {}, set()
    for batch in range(4):
        here = [r for r in rows if r[4] == batch]
        fresh = []
        for r in here:
            first = min(((b, i) for (i, b, s) in accepted.values() if same_event(r[2], s)), default=None)
            if first:
                want.add(tuple(sorted((r[0], first[1]))))
            else:
                fresh.append(r)
        for r in fresh:
            accepted.setdefault(r[0], (r[0], r[4], r[2]))
    df = spark.createDataFrame(rows + rows[:20], EV).withColumn("bands", F.lit("clash"))
    got = {(r.event_id_a, r.event_id_b) for r in repeated_events(df).collect()}
    assert len(want) > 40 and len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_edge_rows(spark):
    long = "Ann Lee sold 12 carts to Bob Ray at Old Mill. " + " ".join(f"word{i}" for i in range(20_000))
    rows = [("a", None, long, 1, 0), ("b", None, long + " again", 1, 1), ("c", None, " ", 1, 1), ("d", None, None, 1, 1), (None, None, long, 1, 1), ("e", None, "!!", 1, None), ("f", None, "?", None, 2)]
    got = [(r.event_id_a, r.event_id_b) for r in repeated_events(spark.createDataFrame(rows, EV)).collect()]
    assert got == [("a", "b")]
    assert repeated_events(spark.createDataFrame([], EV)).count() == 0


def test_many_copies_of_one_text(spark):
    rows = [("a", None, "Ann Lee sold 12 carts to Bob Ray.", 1, 0)] + [(f"c{i:04}", None, "Ann Lee sold 12 carts to Bob Ray.", 2, 1 + i % 2) for i in range(400)]
    got = repeated_events(spark.createDataFrame(rows, EV))
    assert got.count() == 400 and got.filter("event_id_a = 'a'").count() == 400


def test_history_is_kept_between_batches(spark):
    h = EventHistory(spark)
    make = lambda rows: spark.createDataFrame(rows, "id string, batch_no int, text string")
    assert h.ingest(make([("a", 0, "Ann Lee sold 12 carts.")])).count() == 0
    assert [tuple(r) for r in h.ingest(make([("b", 1, "12 carts sold Ann Lee"), ("n", 1, "Bob Ray kept 3 maps.")])).collect()] == [("b", "a")]
    assert [tuple(r) for r in h.ingest(make([("c", 2, "Bob Ray kept 3 maps")])).collect()] == [("c", "n")]


def test_sessions_on_one_path_equal_one(spark, tmp_path):
    """A history opened again knows its common words, buckets and texts, also after merging."""
    rnd = random.Random(3)
    told, batches = [], []
    for no in range(4):
        rows = []
        for i in range(80):
            t = rnd.choice(told) if told and rnd.random() < 0.4 else telling(rnd)
            told.append(t)
            rows.append((f"b{no}_{i:03}", no, say(t, rnd.randrange(3))))
        batches.append(rows)
    make = lambda rows: spark.createDataFrame(rows, "id string, batch_no int, text string")
    one = EventHistory(spark, buckets=5)
    want = [sorted(map(tuple, one.ingest(make(b)).collect())) for b in batches]
    assert sum(map(len, want)) > 60
    path = str(tmp_path / "index")
    for k, b in enumerate(batches):
        h = EventHistory(spark, path, buckets=5)
        assert sorted(map(tuple, h.ingest(make(b)).collect())) == want[k]
        if k == 1:
            h.compact(7)
        # what a killed job left behind without a marker is not read
        make(batches[-1]).select(F.xxhash64("id").alias("ref"), "id", "batch_no", "text").write.mode("overwrite").parquet(f"{path}/{h.generation:06d}/accepted/part=lost")
    assert h.buckets == 7 and len(EventHistory(spark, path)._parts) == 3 and EventHistory(spark, path)._visible("accepted").count() == one._visible("accepted").count()


def test_a_small_batch_opens_few_buckets(spark, tmp_path):
    h = EventHistory(spark, str(tmp_path / "index"), buckets=64)
    make = lambda rows: spark.createDataFrame(rows, "id string, batch_no int, text string")
    h.ingest(make([(f"a{i:04}", 0, f"Ann{i} Lee{i % 50} sold {i} carts.") for i in range(600)]))
    probe = spark.createDataFrame([(1,), (2,), (3,)], "key long")
    told = lambda df: spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    plan = told(h._visible("keys", probe))
    assert h._visible("keys").count() >= 600 * 12 and "In(key, [1,2,3])" in plan
    joined = told(h._visible("keys").hint("merge").join(probe, "key"))
    assert joined.count("Arguments: hashpartitioning") == 1  # the history stays where it lies
    assert [tuple(r) for r in h.ingest(make([("b", 1, "3 carts sold Ann3 Lee3")])).collect()] == [("b", "a0003")]



@pytest.mark.parametrize(
    "a, b, usual",
    [
        ("At Old Ford Ann Lee lost 79 letters to Bob Ray.", "As said before: At Old Ford Ann Lee lost 79 letters to Bob Ray.", "at lost to letters"),
        ("Ann Lee sent 8 sentries to Bob Ray.", "Ann Lee sent 8 sentires to Bob Ray, so it was said.", "sent sentries to"),
        ("They moved 12 carts by night.", "They moved 12 carts by night, or so Zubi Wem says.", "they moved carts by night"),
        ("Ann Lee left Old Mill by night and told Bob Ray.", "Ann Lee left Old Mill by night and told Bob Ray, without one word.", "left by night and told"),
    ],
)
def test_added_words_do_not_part_two_tellings(a, b, usual):
    usual = frozenset(usual.split())
    assert same_event(a, b, usual)
    keys, asked, _ = signatures([a, b], usual)
    assert set(keys[0].tolist()) & set(asked[1].tolist()) and set(keys[1].tolist()) & set(asked[0].tolist())


def test_added_words_in_a_later_batch(spark):
    """A hot person at a hot place: few telling words are left, and the retelling adds three."""
    first = [(f"a{i:03}", 0, f"At Old Ford Ann Lee lost {i} letters to Bob Ray.") for i in range(40)]
    later = [(f"b{i:03}", 1, f"As mentioned previously: At Old Ford Ann Lee lost {i} letters to Bob Ray.") for i in range(40)]
    h = EventHistory(spark)
    make = lambda rows: spark.createDataFrame(rows, "id string, batch_no int, text string")
    h.ingest(make(first))
    got = {(r.id, r.first_id) for r in h.ingest(make(later)).collect()}
    assert got == {(f"b{i:03}", f"a{i:03}") for i in range(40)}
