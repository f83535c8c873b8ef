"""Subject area of each document.

A lexicon of words per subject is learned from the labelled documents and then
from all documents, in rounds.  Labelling functions vote on each (document,
subject): the share of sentences with lexicon words, the sections that hold any,
the address (the work a chapter belongs to), the source, and the human labels.
A latent model learns from the counts of vote patterns how accurate each function
is (expectation maximisation over patterns, of which there are a few hundred at
most) and gives every pattern a posterior probability.

The documents are parsed once into sentences and once into numbers of words, those
words that are frequent enough to enter a lexicon.  Each round is one pass over the
numbers, counted batch by batch with numpy, and sends only sums per word and
subject through a shuffle; a lexicon is one byte per word.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import broadcast_if_small, discard, once, stage, text_batches

#: Rounds that grow the lexicon, in which documents without a subject do not count,
#: and rounds that clean it, in which they do.
GROWING, CLEANING = 3, 2
#: A document deals with a subject in this share of its sentences, and in so many.
SUBSTANTIAL, LEAST_SENTENCES = 0.2, 2
#: A lexicon word: least documents (number, share of all), purity, lead over the next subject.
#: So there are at most (distinct words per document / LEAST_SHARE) words to learn of; if
#: they take more than VOCABULARY_BYTES, the share is doubled until they do not.
VOCABULARY_BYTES = 64 << 20
LEAST_DOCS, LEAST_SHARE, PURE, LEAD = 4, 1e-4, 0.55, 2.5
#: The same of the first lexicon, which is learned from labels that may be wrong.
FIRST_LEAST, FIRST_PURE, FIRST_LEAD = 2, 0.45, 2.0
#: Pairs that the first guess is worth in the counts of the latent model.
ANCHOR = 500.0
#: Least posterior probability of an assigned subject.
POSTERIOR = 0.5

_TAG = re.compile(r"<[^<>]*>")
_SOFT = regex.compile(r"\p{Cf}+")
_WORD = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"(?<=[.!?»”…。])\s+")
STEM = 5


def sentences(text: str | None) -> list[list[list[str]]]:
    """Sections of sentences of words in small letters; null has none.

    Sections end at blank lines, headings and paragraph marks; sentences at stops
    and line ends.  Pieces of less than three words are no sentences.
    """
    if not text:
        return []
    plain = _TAG.sub("\n", html.unescape(text))
    if not plain.isascii():
        plain = _SOFT.sub("", plain)
    out = []
    for section in re.split(r"\n\s*\n|\n(?=#)", plain):
        found = []
        for line in section.split("\n"):
            if line.startswith("#"):
                continue
            for s in _STOP.split(line):
                w = _WORD.findall(s.lower())
                if len(w) >= 3:
                    found.append(w)
        if found:
            out.append(found)
    return out


def stem(word: str) -> str | None:
    """The first five letters of a longer word without accents, as a second key.

    Learned words name their subject in other languages too: remedies, remedios.
    """
    if len(word) <= STEM:
        return None
    if word.isascii():
        return f"~{word[:STEM]}"
    flat = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return f"~{flat[:STEM]}" if len(flat) > STEM else None


class Stems(dict):
    """Stems of words, remembered."""

    def __missing__(self, word: str) -> str | None:
        if len(self) > 300_000:
            self.clear()
        self[word] = found = stem(word)
        return found


class Numbers(dict):
    """Numbers of a word and of its stem in one integer; the size of the vocabulary stands for none."""

    def __init__(self, vocabulary: list[str]) -> None:
        super().__init__()
        self.index = {w: i for i, w in enumerate(vocabulary)}
        self.none = len(vocabulary)

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = code = self.index.get(word, self.none) << 32 | self.index.get(stem(word), self.none)
        return code


def _parsed(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents as plain words: a blank between words, a line per sentence, a form feed between sections."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["text"] = ["\f".join("\n".join(" ".join(x) for x in sec) for sec in sentences(t)) for t in b["text"]]
            yield b

    slim = once(documents.filter("doc_id is not null").select("doc_id", "work_id", F.lower(F.trim("source")).alias("source"), "text"), "doc_id")
    parsed = slim.mapInPandas(parse, "doc_id long, work_id long, source string, text string")
    given = labels.filter("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("labels"))
    return stage(parsed.join(given, "doc_id", "left"), "parsed")


def _vocabulary(parsed: DataFrame, n_docs: int) -> list[str]:
    """Words and stems in enough documents to enter a lexicon, in order."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stems, seen = Stems(), Counter()
        for b in batches:
            for t in b["text"]:
                own = set(t.split())
                seen.update(own)
                seen.update({k for w in own if (k := stems[w])})
            if len(seen) > 500_000:
                yield pd.DataFrame({"word": list(seen), "n": list(seen.values())}).astype({"n": "int64"})
                seen.clear()
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())}).astype({"word": str, "n": "int64"})

    counts = parsed.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stage(counts.filter(F.col("n") >= LEAST_DOCS), "words")
    share = LEAST_SHARE
    while True:
        kept = counts.filter(F.col("n") >= max(LEAST_DOCS, int(share * n_docs)))
        if (kept.agg(F.sum(F.octet_length("word") + 50)).first()[0] or 0) <= VOCABULARY_BYTES:
            return sorted(r[0] for r in kept.select("word").collect())
        share *= 2


def _encoded(parsed: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Documents as numbers: ``words`` and ``stems`` per token (the size of the vocabulary: none),
    tokens per sentence, sections of sentences, and the distinct words and stems.
    """
    shared = parsed.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Numbers(shared.value)
        none = len(shared.value)
        for b in batches:
            if not len(b):
                continue
            codes = np.fromiter(map(known.__getitem__, " ".join(b["text"]).split()), dtype=np.int64)
            words, stems = codes >> 32, codes & 0xFFFFFFFF
            # sentences: their document, section and words
            doc, sections, sizes = [], [], []
            for d, t in enumerate(b["text"]):
                for k, sec in enumerate(t.split("\f") if t else ()):
                    for x in sec.split("\n"):
                        doc.append(d)
                        sections.append(k)
                        sizes.append(x.count(" ") + 1)
            doc = np.array(doc, dtype=np.int64)
            kept = (words < none) | (stems < none)
            sentence = np.repeat(np.arange(len(doc)), sizes)[kept]
            words, stems = words[kept].astype(np.int32), stems[kept].astype(np.int32)
            lengths = np.bincount(sentence, minlength=len(doc)).astype(np.int32)
            token_ends = np.searchsorted(doc[sentence], np.arange(1, len(b)))
            ends = np.searchsorted(doc, np.arange(1, len(b)))
            own = np.unique(np.concatenate([doc[sentence] * (none + 1) + words, doc[sentence] * (none + 1) + stems]))
            own = own[own % (none + 1) < none]
            cols = {"words": np.split(words, token_ends), "stems": np.split(stems, token_ends), "lengths": np.split(lengths, ends), "sections": np.split(np.array(sections, dtype=np.int32), ends)}
            cols["own"] = np.split((own % (none + 1)).astype(np.int32), np.searchsorted(own // (none + 1), np.arange(1, len(b))))
            yield b.drop(columns="text").assign(**cols)

    ints = ", ".join(f"{k} array<int>" for k in ("words", "stems", "lengths", "sections", "own"))
    return stage(parsed.select("doc_id", "work_id", "source", "labels", "text").mapInPandas(encode, f"doc_id long, work_id long, source string, labels array<string>, {ints}"), "encoded")


def _flat(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(all values, values per row) of a column of arrays."""
    sizes = np.fromiter((len(x) for x in column), dtype=np.int64, count=len(column))
    return (np.concatenate(list(column)) if sizes.sum() else np.zeros(0, dtype=np.int32)).astype(np.int64), sizes


def tally(b: pd.DataFrame, lexicon: np.ndarray, n_subjects: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentences, sentences per subject, sections per subject) of each encoded document.

    ``lexicon``: subject of each word by number, -1 for none, and one -1 more.  A word
    counts by itself or else by its stem.  A sentence counts for the subject with
    most words in it, the first among equals.
    """
    words, _ = _flat(b["words"])
    stems, _ = _flat(b["stems"])
    lengths, per_doc = _flat(b["lengths"])
    sections, _ = _flat(b["sections"])
    n_docs, n = len(b), n_subjects
    doc = np.repeat(np.arange(n_docs), per_doc)
    subject = lexicon[words].astype(np.int64)
    subject = np.where(subject < 0, lexicon[stems], subject)
    sentence = np.repeat(np.arange(len(lengths)), lengths)
    hit = subject >= 0
    votes = np.bincount(sentence[hit] * n + subject[hit], minlength=len(lengths) * n).reshape(-1, n)
    top = votes.argmax(axis=1) if len(votes) else np.zeros(0, dtype=np.int64)
    some = votes.any(axis=1)
    per = np.bincount(doc[some] * n + top[some], minlength=n_docs * n).reshape(n_docs, n)
    wide = int(sections.max(initial=0)) + 1
    marked = np.unique((doc[some] * wide + sections[some]) * n + top[some])
    where = np.bincount(marked // (wide * n) * n + marked % n, minlength=n_docs * n).reshape(n_docs, n)
    return per_doc, per, where


def _given(column: pd.Series, subjects: dict[str, int]) -> np.ndarray:
    """Which subjects each document is labelled with."""
    out = np.zeros((len(column), len(subjects)), dtype=bool)
    for i, own in enumerate(column):
        if own is not None:
            out[i, [subjects[s] for s in own]] = True
    return out


def _learn(encoded: DataFrame, lexicon: np.ndarray | None, subjects: list[str], size: int, n_docs: int, grow: bool) -> np.ndarray:
    """A new lexicon from the documents' subjects by the last one (None: by labels).

    While it grows, labelled documents count by their labels too and documents
    without a subject not at all, as their words may only not be known yet.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(lexicon)
    n = len(subjects)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {s: i for i, s in enumerate(subjects)}
        sums = np.zeros((size, n + 1))  # the last column: documents of no subject
        for b in batches:
            if not len(b):
                continue
            of = np.zeros((len(b), n + 1), dtype=bool)
            if shared.value is None:
                of[:, :n] = _given(b["labels"], number)
            else:
                total, per, _ = tally(b, shared.value, n)
                strong = per >= LEAST_SENTENCES
                if grow:
                    of[:, :n] = (strong & (2 * per >= per.max(axis=1, keepdims=True))) | _given(b["labels"], number)
                else:
                    of[:, :n] = strong & (per >= SUBSTANTIAL * total[:, None])
                    of[:, n] = ~of.any(axis=1)
            share = of / np.maximum(of.sum(axis=1, keepdims=True), 1)
            own, sizes = _flat(b["own"])
            for s in np.flatnonzero(of.any(axis=0)):
                sums[:, s] += np.bincount(own, weights=np.repeat(share[:, s], sizes), minlength=size)
        seen = np.flatnonzero(sums.any(axis=1))
        yield pd.DataFrame(sums[seen], columns=names).assign(word=seen)

    # a column per subject instead of a row: one row per word and task goes through the shuffle
    names = [f"n{i}" for i in range(n + 1)]
    cols = ["labels", "own"] if lexicon is None else ["words", "stems", "lengths", "sections", "own", "labels"]
    counted = encoded.select(*cols).mapInPandas(count, ", ".join(f"{k} double" for k in names) + ", word int")
    sums = counted.groupBy("word").agg(*[F.sum(k).alias(k) for k in names])
    every = F.array(*names)
    ranked = F.sort_array(every, asc=False)
    per_word = sums.select("word", F.aggregate(every, F.lit(0.0), lambda x, y: x + y).alias("all"), F.array_max(every).alias("top"), F.get(ranked, F.lit(1)).alias("second"), (F.array_position(every, F.array_max(every)) - 1).cast("int").alias("subject"))
    first = lexicon is None
    least, pure, lead = (FIRST_LEAST, FIRST_PURE, FIRST_LEAD) if first else (max(LEAST_DOCS, int(LEAST_SHARE * n_docs)), PURE, LEAD)
    rows = per_word.filter((F.col("all") >= least) & (F.col("top") >= pure * F.col("all")) & (F.col("top") >= lead * F.col("second")) & (F.col("subject") < n)).select("word", "subject")
    found = np.full(size + 1, -1, dtype=np.int16)
    for word, subject in rows.collect():  # words of the vocabulary
        found[word] = subject
    return found


def _votes(encoded: DataFrame, lexicon: np.ndarray, subjects: list[str]) -> DataFrame:
    """(doc_id, work_id, source, subject, n, total, sections, given) of pairs with evidence."""
    shared = encoded.sparkSession.sparkContext.broadcast(lexicon)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array(subjects, dtype=object)
        for b in batches:
            if not len(b):
                continue
            total, per, where = tally(b, shared.value, len(subjects))
            marks = _given(b["labels"], {s: i for i, s in enumerate(subjects)})
            d, s = np.nonzero((per > 0) | marks)
            labelled = b["labels"].notna().to_numpy()[d]
            yield pd.DataFrame({
                "doc_id": b["doc_id"].to_numpy()[d], "work_id": b["work_id"].astype("Int64").array[d], "source": b["source"].to_numpy()[d], "subject": names[s], "n": per[d, s], "total": total[d],
                "sections": where[d, s], "given": np.where(labelled, np.where(marks[d, s], 1, 2), 0),
            })

    return stage(encoded.drop("own").mapInPandas(vote, "doc_id long, work_id long, source string, subject string, n long, total long, sections long, given long"), "votes")


def latent_accuracies(patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 50, never: np.ndarray | None = None) -> np.ndarray:
    """Posterior of the positive class per vote pattern.

    ``patterns``: one row per pattern, one column per labelling function with its
    vote as a small integer.  Expectation maximisation of a two-class model in
    which functions vote independently given the class, from ``start``, which also
    stays in the counts like ``ANCHOR`` pairs, so that few documents do not turn the
    classes round.  Patterns
    in ``never`` are known not to be of the class and hold it at 0.
    """
    never = np.zeros(len(patterns), dtype=bool) if never is None else never
    post = np.where(never, 0.0, start.astype(float))
    begun = [ANCHOR * counts / max(counts.sum(), 1) * p for p in (1 - post, post)]
    sizes = patterns.max(axis=0) + 1 if len(patterns) else []
    for _ in range(rounds):
        log = np.zeros((len(patterns), 2))
        for c, p in enumerate((1 - post, post)):
            weight = counts * p
            log[:, c] = np.log(weight.sum() + 1e-9)
            for j, k in enumerate(sizes):
                n = np.bincount(patterns[:, j], weights=weight + begun[c], minlength=k) + 0.1
                log[:, c] += np.log(n / n.sum())[patterns[:, j]]
        new = np.where(never, 0.0, 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60))))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post


def subject_posteriors(documents: DataFrame, labels: DataFrame, growing: int = GROWING, cleaning: int = CLEANING) -> DataFrame:
    """(doc_id, subject, share, n_sentences, posterior) of pairs with any evidence.

    Documents without text, sentences or evidence give no rows; without labels
    there is no lexicon and no row.  Rows delivered twice count once.  A passing
    sentence, or less than three quarters of a substantial share, is no subject by
    definition: the model holds these patterns at 0.
    """
    spark = documents.sparkSession
    text_batches(spark)
    parsed = _parsed(documents, labels)
    n_docs = parsed.count()
    subjects = sorted(r[0] for r in labels.filter("doc_id is not null and subject is not null").select("subject").distinct().collect())
    none = spark.createDataFrame([], "doc_id long, subject string, share double, n_sentences long, posterior double")
    if not subjects or not n_docs:
        return none
    vocabulary = _vocabulary(parsed, n_docs)
    encoded = _encoded(parsed, vocabulary)
    discard(parsed)
    lexicon = _learn(encoded, None, subjects, len(vocabulary), 0, True)
    for k in range(growing + cleaning):
        lexicon = _learn(encoded, lexicon, subjects, len(vocabulary), n_docs, k < growing)
    votes = _votes(encoded, lexicon, subjects)
    discard(encoded)
    strong = (F.col("n") >= LEAST_SENTENCES) & (F.col("n") >= SUBSTANTIAL * F.col("total"))
    share = F.col("n") / F.greatest("total", F.lit(1))
    lex = F.when(F.col("n") < LEAST_SENTENCES, F.col("n")).when(share < 0.75 * SUBSTANTIAL, 2).when(share < SUBSTANTIAL, 3).when(share < 1.75 * SUBSTANTIAL, 4).otherwise(5)
    section = F.least("sections", F.lit(2)).cast("int")

    def leaning(key: str) -> DataFrame:
        """Whether a subject is stronger in a work or source than in all documents."""
        base = votes.groupBy("subject").agg(F.sum(strong.cast("int")).alias("s"), F.count("*").alias("c"))
        own = votes.filter(F.col(key).isNotNull()).groupBy(key, "subject").agg(F.sum(strong.cast("int")).alias("os"), F.count("*").alias("oc"))
        lean = own.join(broadcast_if_small(base), "subject").select(key, "subject", (F.col("os") * F.col("c") > 1.2 * F.col("s") * F.col("oc")).cast("int").alias(f"by_{key}"))
        return broadcast_if_small(stage(lean, f"by-{key}"))

    full = votes.join(leaning("work_id"), ["work_id", "subject"], "left").join(leaning("source"), ["source", "subject"], "left")
    names = ["v_lexicon", "v_section", "v_address", "v_source", "v_label"]
    cols = [lex, section, F.coalesce("by_work_id", F.lit(2)), F.coalesce("by_source", F.lit(2)), F.col("given").cast("int")]
    full = stage(full.select("doc_id", "subject", "n", share.alias("share"), *[c.cast("int").alias(k) for c, k in zip(cols, names)]), "patterns")
    seen = full.groupBy(*names).count().collect()  # 6 * 3 * 3 * 3 * 3 patterns at most
    if not seen:
        return none
    patterns = np.array([[r[k] for k in names] for r in seen])
    post = latent_accuracies(patterns, np.array([r["count"] for r in seen], dtype=float), np.select([patterns[:, 0] >= 4, patterns[:, 0] == 3], [0.95, 0.5], 0.05), never=patterns[:, 0] <= 2)
    model = spark.createDataFrame([(*map(int, p), float(x)) for p, x in zip(patterns, post)], ", ".join(f"{k} int" for k in names) + ", posterior double")
    return full.join(F.broadcast(model), names).select("doc_id", "subject", "share", F.col("n").alias("n_sentences"), "posterior")


def document_subjects(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject): the subject areas with a posterior of ``POSTERIOR`` or more."""
    return subject_posteriors(documents, labels).filter(F.col("posterior") >= POSTERIOR).select("doc_id", "subject")


def composition(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per subject: documents that deal with it, and their share of all documents."""
    total = documents.filter("doc_id is not null").agg(F.countDistinct("doc_id").alias("all_documents"))
    n = document_subjects(documents, labels).groupBy("subject").agg(F.countDistinct("doc_id").alias("n_documents"))
    return n.crossJoin(F.broadcast(total)).select("subject", "n_documents", F.round(F.col("n_documents") / F.col("all_documents"), 6).alias("share"))  # a one-row aggregate
