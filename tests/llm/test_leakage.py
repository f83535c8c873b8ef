import random

from pyspark.sql import functions as F

from skein.llm.leakage import MIN_WORDS, WuManber, leak_report, leaks, words


def brute(docs, items, m=MIN_WORDS):
    out = set()
    for d, t in docs:
        w = words(t)
        grams = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
        for i, p in items:
            q = words(p)
            if any(tuple(q[k : k + m]) in grams for k in range(len(q) - m + 1)):
                out.add((d, i))
    return out


def test_words():
    assert words("Don&#39;t pa<b>ss</b>​_by 2nd<!-- no > -->x a < b") == ["don", "t", "pass", "by", "2ndx", "a", "b"]
    assert words(None) == [] and words("so­ft &lt;i&gt;") == ["soft"]


def corpus():
    rnd = random.Random(3)
    vocabulary = ["w%d" % i for i in range(12)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(8, 40)))) for i in range(25)]
    docs = []
    for d in range(60):
        w = rnd.choices(vocabulary, k=rnd.randrange(0, 120))
        if d % 2:
            p = words(rnd.choice(items)[1])
            k = rnd.randrange(9, 16)
            s = rnd.randrange(0, max(1, len(p) - k + 1))
            w[len(w) // 2 : len(w) // 2] = p[s : s + k]
        docs.append((d, ", ".join(w).upper()))
    return docs, items


def test_search_equals_brute_force(spark):
    docs, items = corpus()
    machine = WuManber(items)
    assert {(d, i) for d, t in docs for i in machine.search(t)} == brute(docs, items)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    want = brute(docs, items)
    assert {tuple(r) for r in leaks(d, i).collect()} == want
    assert {tuple(r) for r in leaks(d, i, part_bytes=700).collect()} == want


def test_eleven_words_are_no_case():
    p = " ".join(f"a{i}" for i in range(30))
    machine = WuManber([(1, p)])
    assert machine.search(" ".join(p.split()[5:16])) == set() and machine.search("x " + " ".join(p.split()[5:17]) + " y") == {1}


def test_edge_cases(spark):
    p = " ".join(f"a{i}" for i in range(14))
    docs = spark.createDataFrame([(1, p), (1, p), (2, None), (3, ""), (None, p), (4, ("z " * 300_000) + p)], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(7, p), (7, p), (8, None), (9, "short"), (10, p + " b")], "item_id long, passage string").withColumn("suite", F.lit("s")).withColumn("doc_id", F.lit(0))
    assert sorted(tuple(r) for r in leaks(docs, items).collect()) == [(1, 7), (1, 10), (4, 7), (4, 10)]
    rep = {r.item_id: r.n_documents for r in leak_report(docs, items).collect()}
    assert rep == {7: 2, 8: 0, 9: 0, 10: 2}
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0
