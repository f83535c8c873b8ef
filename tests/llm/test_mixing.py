import os

import pytest
from pyspark.sql import functions as F

from skein.llm.mixing import PIECES, TOKENIZER, Lengths, entropy, expand, mix, temper, temperature_weights

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")
DOC, TGT = "doc_id bigint, source string, text string", "source string, target_share double, max_repeat int"


def test_weights():
    t, size, w = temperature_weights({"a": 0.5, "b": 0.5, "c": 0.2}, {"a": 100.0, "b": 300.0, "c": 0.0})
    assert t == 1.0 and size == 200.0 and w == {"a": 0.5, "b": 0.5}
    t, size, w = temperature_weights({"a": 0.5, "b": 0.5}, {"a": 100.0, "b": 300.0}, 300)
    assert 0 < t < 1 and size == 300 and abs(w["a"] * 300 - 100) < 1e-6
    t, size, w = temperature_weights({"a": 0.5, "b": 0.5}, {"a": 100.0, "b": 300.0}, 10_000)
    assert size == 400 and abs(w["a"] - 0.25) < 1e-9
    assert temperature_weights({}, {}) == (1.0, 0.0, {})


def test_temperature_meets_the_entropy():
    tokens = {"a": 900.0, "b": 90.0, "c": 10.0, "d": 0.0}
    for aim in ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.97, "b": 0.02, "c": 0.01}):
        a, w = temper(tokens, entropy(aim))
        assert abs(entropy(w) - entropy(aim)) < 1e-9 and abs(sum(w.values()) - 1) < 1e-9 and set(w) == set("abc")
        assert abs(w["b"] / w["a"] - 0.1**a) < 1e-9
    assert temper(tokens, 9.0)[0] < 1e-9 and temper({}, 1.0) == (1.0, {})


def test_pieces_count_like_the_whole_text():
    of = Lengths(TOKENIZER)
    for t in ("It's 12 carts,  and\n\n three <|endoftext|> ünïcode 漢字 e\u0301", "x" * 5_000, "", " \t ", "a_b__c"):
        assert sum(map(of.__getitem__, PIECES.findall(t))) == len(of.tokenizer.encode(t, add_special_tokens=False).ids)


def test_tempered_mixture(spark):
    docs, targets = frames(spark)
    m = mix(docs, targets, tempered=True, block=7)
    rep = {r.source: r for r in m.shares.collect()}
    have = {s: float(rep[s].available_tokens) for s in ("hub", "small")}
    a, w = temper(have, entropy({"hub": 0.7, "small": 0.3}))
    assert rep["hub"].exponent == a and rep["small"].most_copies <= 3 and rep["hub"].most_copies == 1
    whole = sum(have.values())
    # where a limit binds, the weights move towards the capacities
    assert all(rep[s].mixed_tokens <= have[s] * {"hub": 1, "small": 3}[s] for s in have) and sum(rep[s].mixed_tokens for s in have) <= whole


def frames(spark):
    docs = [(i, [" Hub", "hub ", "HUB"][i % 3], f"text number {i} " * (1 + i % 7)) for i in range(300)] + [(1000 + i, "small", "a few words here") for i in range(40)] + [(2000 + i, "misc", "x y z") for i in range(50)]
    docs += [(3000, "hub", None), (3001, None, "no source"), (None, "hub", "no id"), (0, " Hub", "text number 0 ")]
    return spark.createDataFrame(docs, DOC).withColumn("copies", F.lit("clash")), spark.createDataFrame([("hub", 0.7, 1), ("small", 0.3, 3), ("absent", 0.1, 4)], TGT)


@pytest.mark.parametrize("total, block", [(None, 2000), (None, 5), (1500, 7)])
def test_shares_and_limits(spark, total, block):
    docs, targets = frames(spark)
    m = mix(docs, targets, total_tokens=total, block=block)
    rows = m.rows.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} <= {"hub", "small"}
    limit = {"hub": 1, "small": 3}
    assert all(1 <= r.copies <= limit[r.source] for r in rows)
    taken = {s: sum(r.n_tokens * r.copies for r in rows if r.source == s) for s in limit}
    rep = {r.source: r for r in m.shares.collect()}
    assert rep["absent"].mixed_tokens == 0 and rep["absent"].available_docs == 0
    whole = sum(taken.values())
    longest = max(r.n_tokens for r in rows)
    for s in limit:
        assert rep[s].mixed_tokens == taken[s] and abs(rep[s].reached_share - taken[s] / whole) < 1e-6
        want = rep[s].weight * (total or min(rep[x].available_tokens * limit[x] / rep[x].weight for x in limit))
        assert want - longest <= taken[s] <= want + 1
    assert expand(m.rows).count() == sum(r.copies for r in rows)
    again = {(r.doc_id, r.copies) for r in mix(docs.repartition(3), targets, total_tokens=total, block=block).rows.collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}


def test_empty(spark):
    docs, targets = frames(spark)
    assert mix(docs.limit(0), targets).rows.count() == 0 and mix(docs, targets.limit(0)).shares.count() == 0
