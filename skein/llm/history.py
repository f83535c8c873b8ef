"""Deduplicating new batches against all history.

An index of what was accepted lies in a folder of its own and outlives the
session: ``keys`` (key, ref, sign), hash-bucketed by key, and ``accepted`` (ref,
id, batch_no, text), hash-bucketed by ref.  A batch is reduced to distinct texts,
and its keys are sent to the buckets of ``keys`` while the history stays where it
lies; a batch with fewer keys than there are buckets opens only the buckets of its
keys.  Pairs that share a key are compared by their signatures first, and only
those that may be alike by their texts.  Texts that repeat nothing are accepted:
their keys and texts are added as new files, and nothing of the history is
hashed, shuffled or rewritten again.

A batch becomes visible by one marker file, written last; what a lost or killed
job leaves behind without a marker is never read.  ``compact`` merges the files of
many batches, into more buckets if the history has grown.

Two tellings of one event have the same numbers and count the same thing, so a key
is made of a text's numbers, the first or last two letters of a counted thing (a
slip spoils only one of them in all but the shortest words) and one minwise hash of
the words that may be names.  At the least similarity that is accepted, 0.5, two
texts share one of 12 such keys with a probability of 0.9998.  A text without any
such word meets all texts of its numbers and things: it asks for a key that every
text keeps and keeps one that every text asks for.  Texts that count nothing have
bands of three minwise hashes over all their words.  The signature is
a bitmap of the words that may be names.  Which words may not be, the usual ones,
is counted over the whole first batch and kept with the index.  Reworded texts may
share no sequence of five words, so the sets are of words and not of shingles, and
the verdict is on people, places, numbers and things.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import new_path, remove, stage

#: Keys of a text that counts things, of one that does not, and minwise hashes in a key of the latter.
KEYS, WHOLE_KEYS, WHOLE_ROWS = 12, 24, 3
#: Counted things that keys are made of: those with the least hashes of their numbers.
THINGS = 4
#: Least similarity of two signatures; texts that are told alike have 0.5 or more but for slips.
LEAST_SIGN = 0.3
#: Keys of the first batch for each bucket, and the least and most buckets.
BUCKET_KEYS, LEAST_BUCKETS, MOST_BUCKETS = 200_000, 8, 4_096
#: A word is common if it is in this share of the first batch's texts, and in so many.
COMMON_SHARE, COMMON_TEXTS = 0.001, 30
#: Words two tellings must have in common, of all words of both.
LEAST_WORDS = 0.5

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_COUNTED = regex.compile(r"(\p{N}+)\s+(\p{L}+)")
_HEAD = regex.compile(r"(?:^|[.!?:(“\"„«]\s*)(\p{Lu}\p{L}*)(?=\s*[:,)–-]|\s+\p{Ll}|\s+\p{N})")
_SOFT = regex.compile(r"\p{Cf}+")
_rng = np.random.default_rng(20)
_MUL = (_rng.integers(1, 2**62, WHOLE_KEYS * WHOLE_ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, WHOLE_KEYS * WHOLE_ROWS, dtype=np.uint64)
_SHIFT, _GOLD = np.uint64(29), np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    """A text without invisible characters."""
    return text if text.isascii() else _SOFT.sub("", text)


def _digest(words) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)


def minwise(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """``hashes`` minwise hashes of each set of hashed words; sets are not empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), hashes), dtype=np.uint64)
    for j in range(hashes):
        h = flat * _MUL[j] + _ADD[j]
        h = (h ^ (h >> _SHIFT)) * _MUL[j - 1]
        out[:, j] = np.minimum.reduceat(h ^ (h >> _SHIFT), starts)
    return out


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    k = (a ^ b) * _GOLD
    return k ^ (k >> _SHIFT)


def signatures(texts: list[str], usual: frozenset[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(keys kept, keys asked for, signature) of each text.

    A text without words has no key; one without words that may be names has the
    signature 0, which is like any.
    """
    keys: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(texts)
    asked = list(keys)
    signs = np.zeros(len(texts), dtype=np.uint64)
    told, names, heads, bare, whole, numbers = [], [], [], [], [], []
    for i, t in enumerate(texts):
        low = plain(t).lower()
        found = set(_WORD.findall(low))
        if not found:
            continue
        counted = _COUNTED.findall(low)
        digits = {w for w in found if w.isdigit()}
        things = {t for _, t in counted}
        h = _digest(w for w in found if w not in usual and w not in digits and w not in things)
        if len(h):
            signs[i] = np.bitwise_or.reduce(np.uint64(1) << (h % np.uint64(64)))
        said = " ".join(sorted(digits))
        if counted:
            kept = sorted(set(counted), key=lambda c: (xxhash.xxh3_64_intdigest(c[0]), c[1]))[:THINGS]
            told.append(i)
            names.append(h if len(h) else np.zeros(1, dtype=np.uint64))
            heads.append(_digest([x for _, t in kept for x in (f"{said}|{t[:2]}", f"{said}~{t[-2:]}")]))
        else:
            bare.append(i)
            whole.append(_digest(found))
            numbers.append(xxhash.xxh3_64_intdigest(said))
    if told:
        turns = np.arange(KEYS, dtype=np.uint64)
        for i, head, row in zip(told, heads, _mix(minwise(names, KEYS), turns * _GOLD)):
            pairs = head.reshape(-1, 2)[:, np.arange(KEYS) % 2]  # first and last letters by turns
            own, every, none = _mix(pairs, row).ravel() if signs[i] else head[:0], _mix(head, _GOLD), _mix(head, ~_GOLD)
            keys[i] = np.unique(np.concatenate([own, every] if signs[i] else [every, none])).view(np.int64)
            asked[i] = np.unique(np.concatenate([own, none] if signs[i] else [every, none])).view(np.int64)
    if bare:
        m = minwise(whole, WHOLE_KEYS * WHOLE_ROWS)
        rows = np.repeat(np.array(numbers, dtype=np.uint64)[:, None], WHOLE_KEYS, axis=1) ^ np.arange(WHOLE_KEYS, dtype=np.uint64)
        for r in range(WHOLE_ROWS):
            rows = _mix(rows, m[:, r::WHOLE_ROWS])
        for i, row in zip(bare, rows):
            keys[i] = asked[i] = np.unique(row).view(np.int64)
    return keys, asked, signs.view(np.int64)


def near(a: str, b: str) -> bool:
    """Equal but for one typing slip: a change, an extra letter, a swap."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or len(b) < 3:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


def _left_over(mine: list[str], theirs: set[str], rest: list[str]) -> list[str]:
    """My words that the other text lacks, slips of the pen matched off."""
    out = []
    for w in mine:
        if w.lower() in theirs:
            continue
        match = next((x for x in rest if not w.isdigit() and near(w.lower(), x)), None)
        if match is None:
            out.append(w)
        else:
            rest.remove(match)
    return out


def _names(text: str, left: list[str], usual: frozenset[str]) -> list[str]:
    """Words of ``left`` that can be names.

    Where a text has capitals these are the capitalised words, but for a first
    word before a small one and a heading before a mark; else all words that are
    not usual in small letters.
    """
    if text == text.lower() or text == text.upper():
        return [w for w in left if w.lower() not in usual]
    heads = {m[1] for m in _HEAD.finditer(text)}
    return [w for w in left if w[0].isupper() and w not in heads]


def same_event(a: str, b: str, usual: frozenset[str] = frozenset()) -> bool:
    """Whether two summaries tell one event.

    Numbers must be equal, the counted things equal up to a typing slip, and not
    both texts may have names that the other lacks; other words may differ by
    slips, synonyms, order and added phrases as long as half of all words agree.
    """
    a, b = plain(a), plain(b)
    wa, wb = list(dict.fromkeys(_WORD.findall(a))), list(dict.fromkeys(_WORD.findall(b)))
    la, lb = {w.lower() for w in wa}, {w.lower() for w in wb}
    if not la or not lb:
        return False
    if la == lb:
        return True
    if {w for w in la if w.isdigit()} != {w for w in lb if w.isdigit()}:
        return False
    ca, cb = dict(_COUNTED.findall(a.lower())), dict(_COUNTED.findall(b.lower()))
    if any(n in cb and not near(t, cb[n]) for n, t in ca.items()):
        return False
    left_a = _left_over(wa, lb, [x for x in lb if x not in la])
    left_b = _left_over(wb, la, [x for x in la if x not in lb])
    agreed = len(la) - len(left_a)
    if agreed < LEAST_WORDS * (len(la) + len(left_b)):
        return False
    return not (_names(a, left_a, usual) and _names(b, left_b, usual))


class EventHistory:
    """The persistent index of accepted records; ``ingest`` takes one batch.

    ``path`` names its folder: an index that lies there is opened again, with its
    usual words and buckets; without a path it lives in the shared folder of the
    application.  One writer at a time.  Batches must come in ascending order of
    ``batch_no``.  Columns read: ``id``, ``batch_no``, ``text``; others are
    ignored.  Rows with null id and rows whose text has no word take no part.
    """

    TABLES = {"keys": ("key", "key BIGINT, ref BIGINT, sign BIGINT"), "accepted": ("ref", "ref BIGINT, id STRING, batch_no INT, text STRING")}

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        self.spark = spark
        self.path = (path or new_path(spark, "history")).rstrip("/")
        self.buckets, self.generation = buckets, 0
        self._shared = None
        self._parts = self._committed()
        if self._parts:
            self._share()

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _committed(self) -> list[str]:
        """The visible parts, by markers <generation>-<buckets>-<part>; the last generation counts."""
        path, fs = self._fs()
        names = sorted(f.getPath().getName().split("-") for f in fs.listStatus(path)) if fs.exists(path) else []
        if names:
            self.generation, self.buckets = int(names[-1][0]), int(names[-1][1])
        return [n[2] for n in names if int(n[0]) == self.generation]

    def _commit(self, part: str) -> None:
        path, fs = self._fs()
        fs.create(path.suffix(f"/{self.generation:06d}-{self.buckets}-{part}"), False).close()
        self._parts = self._committed()

    def _share(self) -> None:
        rows = self.spark.read.parquet(f"{self.path}/usual").collect()
        self._shared = self.spark.sparkContext.broadcast(frozenset(r[0] for r in rows))

    def _learn(self, texts: DataFrame) -> None:
        """Write the usual words of the first batch, at most words-per-text / ``COMMON_SHARE``.

        Usual are common words that texts with capitals mostly write in small letters.
        """
        total = texts.count()
        least = max(COMMON_TEXTS, int(COMMON_SHARE * total))
        words = texts.select((F.col("text") != F.lower("text")).alias("mixed"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("w"))
        counts = words.groupBy(F.lower("w").alias("word")).agg(
            F.count("*").alias("n"), F.count_if(F.col("mixed")).alias("cased"), F.count_if(F.col("mixed") & (F.col("w") == F.lower("w"))).alias("small")
        )
        kept = counts.filter((F.col("n") >= least) & (F.col("small") * 2 >= F.col("cased"))).select("word")
        kept.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/usual")
        if not self.buckets:
            self.buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, total * KEYS // BUCKET_KEYS))

    def _table(self, name: str) -> str:
        """The table of this generation, known to the session's catalog by its folder."""
        where = f"{self.path}/{self.generation:06d}/{name}"
        table = f"skein_{name}_{hashlib.md5(where.encode()).hexdigest()}"
        column, schema = self.TABLES[name]
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}, part STRING) USING parquet PARTITIONED BY (part) CLUSTERED BY ({column}) SORTED BY ({column}) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        if self.spark.conf.get("spark.sql.catalogImplementation", "in-memory") == "hive":
            self.spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
        self.spark.catalog.refreshTable(table)
        return table

    def _append(self, df: DataFrame, name: str, part: str) -> None:
        column, table = self.TABLES[name][0], self._table(name)
        rows = df.withColumn("part", F.lit(part)).repartition(self.buckets, column)
        rows.write.mode("append").format("parquet").partitionBy("part").bucketBy(self.buckets, column).sortBy(column).option("path", f"{self.path}/{self.generation:06d}/{name}").saveAsTable(table)

    def _visible(self, name: str, wanted: DataFrame | None = None) -> DataFrame:
        """The visible rows; of a few ``wanted`` values only, where their buckets are not all.

        As many values as buckets open every bucket anyway, so no more are looked at.
        """
        column = self.TABLES[name][0]
        rows = self.spark.table(self._table(name)).filter(F.col("part").isin(self._parts)).drop("part")
        if wanted is not None:
            few = [r[0] for r in wanted.select(column).take(self.buckets)]
            if len(few) < self.buckets:
                rows = rows.filter(F.col(column).isin(sorted(set(few))))
        return rows

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Add a batch; returns (id, first_id) of its rows that repeat history.

        Equal texts of one batch are one candidate, whatever their number; among
        accepted texts the earliest batch and smallest id is the first telling.
        """
        rows = batch.select("id", "batch_no", "text").filter(F.col("id").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}]"))
        rows = rows.withColumn("copy", F.md5(F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")))
        texts = rows.groupBy("copy").agg(F.min(F.struct("id", "batch_no", "text")).alias("r")).select("copy", "r.*")
        if self._shared is None:
            texts = stage(texts, "texts")
            self._learn(texts)
            self._share()
        shared = self._shared

        def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b["keys"], b["asked"], b["sign"] = signatures(b["text"].tolist(), shared.value)
                yield b

        signed = texts.mapInPandas(sign, "copy string, id string, batch_no int, text string, keys array<long>, asked array<long>, sign long")
        signed = stage(signed.withColumn("ref", F.xxhash64("id")), "signed")
        fresh, found = signed, None
        if self._parts:
            found = stage(self._matches(signed), "found")
            fresh = signed.join(found.select("ref"), "ref", "left_anti")
        part = uuid.uuid4().hex
        self._append(fresh.select(F.explode("keys").alias("key"), "ref", "sign"), "keys", part)
        self._append(fresh.select("ref", "id", "batch_no", "text"), "accepted", part)
        self._commit(part)
        if found is None:
            return self.spark.createDataFrame([], "id string, first_id string")
        return rows.select("id", "copy").join(found.select("copy", "first_id"), "copy").select("id", "first_id").distinct()

    def _matches(self, signed: DataFrame) -> DataFrame:
        """(copy, ref, first_id) of the signed texts that tell again what was accepted.

        ``ref`` is a hash of the id: texts of two ids with one hash are both compared.
        """
        shared = self._shared
        probe = signed.select(F.explode("asked").alias("key"), F.col("ref").alias("new_ref"), F.col("sign").alias("new_sign"))
        both, either = F.col("sign").bitwiseAND(F.col("new_sign")), F.col("sign").bitwiseOR(F.col("new_sign"))
        alike = (F.col("sign") == 0) | (F.col("new_sign") == 0) | (F.bit_count(both) >= LEAST_SIGN * F.bit_count(either))
        met = self._visible("keys", probe).join(probe, "key").filter(alike)
        pairs = stage(met.select("new_ref", "ref").distinct(), "pairs")
        new = signed.select(F.col("ref").alias("new_ref"), "copy", F.col("text").alias("new_text"))
        texts = self._visible("accepted", pairs).join(pairs, "ref").join(new, "new_ref")

        def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                ok = [same_event(x, y, shared.value) for x, y in zip(b["new_text"], b["text"])]
                yield b.loc[ok, ["copy", "new_ref", "batch_no", "id"]]

        same = texts.mapInPandas(verify, "copy string, new_ref long, batch_no int, id string")
        first = same.groupBy("copy", "new_ref").agg(F.min(F.struct("batch_no", "id")).alias("f"))
        return first.select("copy", F.col("new_ref").alias("ref"), F.col("f.id").alias("first_id"))

    def compact(self, buckets: int | None = None) -> None:
        """Merge all parts into a new generation, with other buckets if wanted; the old one goes last."""
        if not self._parts:
            return
        old, markers = self.generation, [f"commits/{self.generation:06d}-{self.buckets}-{p}" for p in self._parts]
        tables = [self._table(name) for name in self.TABLES]
        rows = [self._visible(name) for name in self.TABLES]
        self.generation, self.buckets = old + 1, buckets or self.buckets
        part = uuid.uuid4().hex
        for name, df in zip(self.TABLES, rows):
            self._append(df, name, part)
        self._commit(part)
        for t in tables:
            self.spark.sql(f"DROP TABLE {t}")
        for where in (*markers, f"{old:06d}"):
            remove(self.spark, f"{self.path}/{where}")


def repeated_events(events: DataFrame, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """(event_id_a, event_id_b): events that repeat one accepted in an earlier batch.

    ``events``: id, summary, batch_no.  Runs the batches through a history in
    order, a persistent one if ``path`` is given.  Rows delivered twice count once,
    in their earliest batch; a null batch counts as 0; blank and null summaries are
    no case.  Titles often name another subject and decide nothing.  Smaller id
    first.
    """
    spark = events.sparkSession
    slim = (
        events.filter("id is not null").select("id", F.coalesce("batch_no", F.lit(0)).cast("int").alias("batch_no"), F.col("summary").alias("text"))
        .groupBy("id").agg(F.min(F.struct("batch_no", "text")).alias("r")).select("id", "r.*")
    )
    at = new_path(spark, "batches")
    slim.repartition("batch_no", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("batch_no").parquet(at)
    staged = spark.read.schema("id string, text string, batch_no int").parquet(at)
    history = EventHistory(spark, path, buckets)
    out = spark.createDataFrame([], "id string, first_id string")
    for (no,) in sorted(staged.select("batch_no").distinct().collect()):
        out = out.unionByName(history.ingest(staged.filter(F.col("batch_no") == no)))
    return out.select(F.least("id", "first_id").alias("event_id_a"), F.greatest("id", "first_id").alias("event_id_b"))
