"""Evaluation texts leaking into training text: Wu-Manber search over words.

The patterns are all windows of ``min_words`` words of the held-out passages.
Words are the alphabet; a block is two words.  A shift table says how far a
position can move on without missing a pattern end, a bucket per final block
holds the patterns to compare word by word.  The pattern tables are built once
per Python worker from the passages, which are shipped in parts of bounded size;
the documents stream through in Arrow batches, whole texts.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import text_batches


#: Words that a document must share with a passage, in sequence.
MIN_WORDS = 12
#: Passages are sent to every worker in parts of this many bytes; a part is a pass over the documents.
PART_BYTES = 16 << 20

_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>|<[!?][^<>]*>", re.S)
_WORD = re.compile(r"[^\W_]+")
# characters that show nothing: format characters, fillers and variation selectors
_INVISIBLE = regex.compile(r"[\p{Cf}\u034F\u115F\u1160\u17B4\u17B5\u180B-\u180F\u3164\uFE00-\uFE0F\uFFA0]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case, without markup.

    HTML entities are resolved first; then tags and invisible characters are
    dropped, neither of which ends a word.  Null gives no words.
    """
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", _INVISIBLE.sub("", text))
    return _WORD.findall(text.lower())


class WuManber:
    """Finds which items share ``m`` consecutive words with a text."""

    def __init__(self, items: Iterable[tuple[int, str | None]], m: int = MIN_WORDS) -> None:
        self.m = m
        self.ids: dict[str, int] = {}
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        seen = set()
        for item, passage in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words(passage)]
            for i in range(len(w) - m + 1):
                p = tuple(w[i : i + m])
                if (p, item) in seen:
                    continue
                seen.add((p, item))
                for j in range(1, m):
                    block = (p[j - 1] << 32) | p[j]
                    self.shift[block] = min(self.shift.get(block, m - 1), m - 1 - j)
                self.bucket.setdefault((p[-2] << 32) | p[-1], []).append((p, item))

    def search(self, text: str | None) -> set[int]:
        """Items with a common run of at least ``m`` words."""
        get, m = self.ids.get, self.m
        w = [get(x, 0) for x in words(text)]
        found: set[int] = set()
        shift, bucket = self.shift, self.bucket
        i, n = m - 1, len(w)
        while i < n:
            block = (w[i - 1] << 32) | w[i]
            s = shift.get(block, m - 1)
            if s:
                i += s
                continue
            here = tuple(w[i - m + 1 : i + 1])
            for p, item in bucket.get(block, ()):
                if p == here:
                    found.add(item)
            i += 1
        return found


def _parts(items: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    """The passages in parts of about ``size`` bytes; the driver holds one part at a time."""
    part, held = [], 0
    for item, passage in items.toLocalIterator():
        part.append((item, passage))
        held += len(passage.encode()) + 64
        if held >= size:
            yield part
            part, held = [], 0
    yield part


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, item_id): documents holding ``min_words`` consecutive words of a passage.

    Passages shorter than that match nothing; null texts and passages hold no
    words.  Rows delivered twice count once.  The held-out set passes the driver in
    parts of ``part_bytes``, each searched in one pass over the documents, so any
    number of passages is handled; documents never leave the executors.
    """
    spark = documents.sparkSession
    text_batches(spark)
    rows = items.select("item_id", "passage").filter("item_id is not null and passage is not null").distinct()
    docs = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    out = None
    for part in _parts(rows, part_bytes):
        shared = spark.sparkContext.broadcast((part, min_words))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            machine = WuManber(*shared.value)
            for b in batches:
                hits = [(d, i) for d, t in zip(b["doc_id"], b["text"]) for i in machine.search(t)]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id"]).astype("int64")

        found = docs.mapInPandas(run, "doc_id long, item_id long")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def leak_report(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per item: how many documents leak it (0 for clean items)."""
    n = leaks(documents, items, min_words).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"))
    return items.select("item_id", "suite").distinct().join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))
