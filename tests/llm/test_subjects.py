import random

import numpy as np
from pyspark.sql import functions as F

from skein.llm.subjects import composition, document_subjects, latent_accuracies, sentences

DOC, LAB = "doc_id bigint, work_id bigint, source string, text string", "doc_id bigint, subject string, labelled_by string"
WORDS = {"law": "verdict judge court oath fine appeal".split(), "music": "flute harp chorus ballad lute refrain".split(), "ships": "anchor keel tide sail helm pilot".split()}
NEUTRAL = ["It rained for most of the night.", "Someone had left the door open.", "Nobody said a word about it."]


def corpus(n=240, seed=5):
    rnd = random.Random(seed)
    docs, truth, labels = [], set(), []
    for d in range(n):
        areas = rnd.sample(list(WORDS), rnd.choice([0, 1, 1, 2]))
        text = [rnd.choice(NEUTRAL) for _ in range(3)]
        for a in areas:
            text += [f"They spoke of the {rnd.choice(WORDS[a])} and the {rnd.choice(WORDS[a])}." for _ in range(4)]
            truth.add((d, a))
        for a in set(WORDS) - set(areas):
            if rnd.random() < 0.2:
                text.append(f"They spoke of the {rnd.choice(WORDS[a])} too.")
        rnd.shuffle(text)
        docs.append((d, d % 5, ["x", "y"][d % 2], " ".join(text)))
        if areas and d % 3 == 0:
            labels += [(d, a if rnd.random() < 0.9 else rnd.choice(list(WORDS)), "ann") for a in areas[: rnd.choice([1, 2])]]
    return docs, truth, labels


def test_sentences():
    assert sentences("<p>One two three. Four five six!</p>\n\n# Heading is here\nSeven eight ni​ne") == [[["one", "two", "three"], ["four", "five", "six"]], [["seven", "eight", "nine"]]]
    assert sentences(None) == [] and sentences("a b") == []


def test_held_out_accuracy(spark):
    docs, truth, labels = corpus()
    got = {tuple(r) for r in document_subjects(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LAB)).collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 0.03 * len(truth)


def test_latent_model_learns_a_bad_function():
    rnd = np.random.default_rng(0)
    y = rnd.random(4000) < 0.4
    votes = np.stack([np.where(rnd.random(4000) < a, y, ~y) for a in (0.95, 0.9, 0.5)], axis=1).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post = latent_accuracies(patterns, counts.astype(float), np.where(patterns[:, 0] == 1, 0.8, 0.2))
    by = {tuple(p): x for p, x in zip(patterns, post)}
    assert by[(1, 1, 0)] > 0.9 and by[(0, 0, 1)] < 0.1 and abs(by[(1, 1, 0)] - by[(1, 1, 1)]) < 0.1


def test_edge_cases(spark):
    docs, _, labels = corpus()
    d = spark.createDataFrame(docs + docs[:5] + [(1000, None, None, None), (1001, 1, "x", ""), (None, 1, "x", "They spoke of the judge."), (1002, 1, "x", "They spoke of the judge and the court. " * 5_000)], DOC).withColumn("subject", F.lit("clash"))
    lab = spark.createDataFrame(labels + labels[:3] + [(None, "law", None), (5, None, None), (99999, "law", "ann")], LAB).withColumn("text", F.lit("clash"))
    got = [tuple(r) for r in document_subjects(d, lab).collect()]
    assert len(got) == len(set(got)) and (1002, "law") in got and not {1000, 1001, None} & {x for x, _ in got}
    assert document_subjects(d.limit(0), lab).count() == 0 and document_subjects(d, lab.limit(0)).count() == 0
    shares = composition(d, lab).collect()
    assert {r.subject for r in shares} <= set(WORDS) and all(0 < r.share < 1 for r in shares)
