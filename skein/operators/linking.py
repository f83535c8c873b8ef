"""Temporal linking and entity resolution by rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from skein.functions.text import normalize_name
from skein.operators import graph, vector
from skein.session import stage

#: Letters of a known name up to which it is found by segments.
LONG = 48
#: What parts words, as Python's ``split`` has it.
SPACES = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Least token sort ratio of a fuzzy match, and the scores of each way to match.
FUZZY, SCORE = 88.0, {"exact": 1.0, "alias": 0.95, "fuzzy": 0.87}


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def token_sort_ratio(a: str | None, b: str | None) -> float:
    """Indel similarity of the sorted words of two strings, 0 to 100."""
    x, y = (" ".join(sorted((s or "").split())) for s in (a, b))
    return 100.0 if not x and not y else 200.0 * lcs(x, y) / (len(x) + len(y))


@F.pandas_udf(DoubleType())
def sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_sort_ratio(x, y) for x, y in zip(a, b)], dtype=float)


def _grams(c: Column) -> Column:
    """Distinct groups of three letters of a long text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substr(c, i, F.lit(3))))


def segments_of(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of ``parts`` segments of nearly equal length, the shorter ones first."""
    size, longer = divmod(length, parts)
    sizes = [size] * (parts - longer) + [size + 1] * longer
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes) if n]


def _most_edits(length: int, least: float) -> int:
    """Most insertions and deletions between a name of ``length`` and any that is ``least`` alike."""
    loss = 1 - least / 100
    return int(loss * (length + length * (1 + loss) / (1 - loss)) + 1e-9)


def _segment_keys(y: str, least: float) -> list[int]:
    """Of a known name: its segments, one more than edits are allowed, so one stays whole."""
    n = len(y)
    return [xxhash.xxh3_64_intdigest(f"{n}:{at}:{y[at : at + size]}") for at, size in segments_of(n, min(n, _most_edits(n, least) + 1))]


def _probe_keys(x: str, least: float) -> set[int]:
    """Of a name: every place where a segment of a known name can stand.

    If the edits are at most as many as the segments less one, there is a segment
    ``i`` (from 0) that stays whole with exactly ``i`` edits before it: the first up
    to whose end there are no more than ``i``.  Every edit moves what follows by one
    place, so it is moved by m of the parity of i with |m| at most i, and what is
    left of the edits must make up for the rest of the difference in length.
    """
    p, keys = len(x), set()
    for n in range(1, LONG + 1):
        d, e = int((1 - least / 100) * (p + n) + 1e-9), p - n
        if abs(e) > d:
            continue
        for i, (at, size) in enumerate(segments_of(n, min(n, _most_edits(n, least) + 1))[: d + 1]):
            for m in range(-i, i + 1, 2):
                if abs(e - m) <= d - i and 0 <= at + m <= p - size:
                    keys.add(xxhash.xxh3_64_intdigest(f"{n}:{at}:{x[at + m : at + m + size]}"))
    return keys


def letter_marks(t: str) -> tuple[int, int]:
    """128 bits: a place for each of the first four of every letter a to z, 24 places for all else.

    Two texts differ in no more places than letters must be put in and taken out.
    """
    bits, seen = 0, {}
    for c in t:
        k = seen[c] = seen.get(c, -1) + 1
        o = ord(c) - 97
        if 0 <= o < 26:
            bits |= 1 << (4 * o + k if k < 4 else 104 + (o + k) % 24)
        else:
            bits |= 1 << (104 + (ord(c) + 7 * k) % 24)
    return (bits & (1 << 64) - 1) - (1 << 63), (bits >> 64) - (1 << 63)


def _keyed(df: DataFrame, column: str, keys: Callable[[str, float], Iterable[int]], least: float) -> DataFrame:
    """(column, u, v, key): the letter marks and every key of a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            marks = [letter_marks(t) for t in b[column]]
            b["u"], b["v"] = np.array([m[0] for m in marks], dtype=np.int64), np.array([m[1] for m in marks], dtype=np.int64)
            b["keys"] = [np.array(sorted(keys(t, least)), dtype=np.uint64).view(np.int64) for t in b[column]]
            yield b

    return df.select(column).mapInPandas(run, f"{column} string, u long, v long, keys array<long>").select(column, "u", "v", F.explode("keys").alias("key"))


def fuzzy_match(names: DataFrame, known: DataFrame, least: float = FUZZY) -> DataFrame:
    """(name, id, ratio): best known name of each name at ``least`` (88 or more).

    Lower case is compared, words sorted; ties go to the smaller id.  A name whose
    words are those of a known name is 100 alike, which no other name reaches, and
    is compared with no other.  For the rest candidates meet by equi-join on
    segments: a known name is cut into one segment more than the edits that the
    ratio allows, so one of them stands whole in the other name, near its place.
    Known names of more than ``LONG`` letters, whose segments would be too many,
    meet on letter groups and must share as many as the edits can leave.  Pairs
    whose letters alone differ by more edits go right after the join, and only the
    others are compared letter by letter; no pair at ``least`` is lost, and there is
    no cross join.  Keys and letter groups are many times the names, which the
    engine's estimates do not know, so they are kept from being broadcast.
    """
    tidy = lambda c: F.array_join(F.array_sort(F.filter(F.split(F.lower(c), SPACES), lambda t: t != "")), " ")
    a = names.select("name").filter("name is not null").distinct().withColumn("x", tidy(F.col("name"))).filter("x <> ''")
    b = known.select("id", F.col("name").alias("known")).filter("known is not null").withColumn("y", tidy(F.col("known"))).filter("y <> ''")
    b = stage(b.groupBy("y").agg(F.min("id").alias("id")), "known")
    tasks = max(2, names.sparkSession.sparkContext.defaultParallelism)
    same = b.select(F.col("y").alias("x"), "id")
    asked = a.select("x").distinct().join(same.hint("merge"), "x", "left")
    asked = stage(asked, "asked")
    x, y = asked.filter("id is null").select("x").repartition(tasks, "x"), b.select("y").repartition(tasks, "y")
    p, q = F.length("x"), F.length("y")
    reach = LONG * (2 - least / 100) / (least / 100)
    # edits that the ratio allows
    edits = F.floor((1 - least / 100) * (p + q) + 1e-9)
    apart = F.bit_count(F.col("u").bitwiseXOR(F.col("s"))) + F.bit_count(F.col("v").bitwiseXOR(F.col("t")))
    left = _keyed(x.filter(p <= reach), "x", _probe_keys, least)
    right = _keyed(y.filter(q <= LONG), "y", _segment_keys, least).withColumnsRenamed({"u": "s", "v": "t"})
    short = left.join(right.hint("merge"), "key").filter(apart <= edits).select("x", "y").distinct()
    long = x.filter(p > LONG * (least / 100) / (2 - least / 100) - 1).select("x", F.size(_grams(F.col("x"))).alias("three"), F.explode(_grams(F.col("x"))).alias("g"))
    met = long.join(y.filter(q > LONG).select("y", F.explode(_grams(F.col("y"))).alias("g")).hint("merge"), "g")
    # the groups of x that must survive the edits
    shared = met.filter(F.abs(p - q) <= edits).groupBy("x", "y", "three").agg(F.count("*").alias("n"))
    may = short.unionByName(shared.filter(F.col("n") >= F.col("three") - 3 * edits).select("x", "y"))
    scored = may.withColumn("ratio", sort_ratio("x", "y")).filter(F.col("ratio") >= least)
    near = scored.join(b.hint("merge"), "y").groupBy("x").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "id")).alias("m"))
    equal = asked.filter("id is not null").select("x", F.struct(F.lit(-100.0).alias("r"), "id").alias("m"))
    return a.join(near.unionByName(equal).hint("merge"), "x").select("name", F.col("m.id").alias("id"), (-F.col("m.r")).alias("ratio"))


def token_subset_match(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, id): names whose words are all words of exactly one known name.

    A name looks only among the known names that hold its rarest word, so a word of
    a third of all known names decides nothing unless it stands alone.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != ""))
    a = names.select("name").filter("name is not null").distinct().withColumn("w", words(F.col("name"))).filter(F.size("w") > 0)
    b = known.filter("id is not null").select("id", words(F.col("name")).alias("v")).filter("v is not null").distinct()
    held = b.select(F.explode("v").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    rarest = a.select("name", "w", F.explode("w").alias("t")).join(held, "t", "left").groupBy("name", "w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t")).alias("r"))
    asked = rarest.filter("r.n > 0").select("name", "w", F.col("r.t").alias("t"))
    hits = asked.join(b.select("id", "v", F.explode("v").alias("t")), "t").filter(F.size(F.array_except("w", "v")) == 0)
    return hits.groupBy("name").agg(F.countDistinct("id").alias("c"), F.min("id").alias("id")).filter("c = 1").select("name", "id")


def resolve_names(names: DataFrame, ents: DataFrame, vectors: DataFrame | None = None, facts: DataFrame | None = None, link: float = 0.88, ambiguous: float = 0.82) -> DataFrame:
    """(input_name, node_id, matched_by, confidence, is_ambiguous) of every distinct name.

    Ways in order: exact name, alias, fuzzy (similar letters, then word subset)
    among names that are no stubs, similar facts (``vectors``: name, vec;
    ``facts``: id, vec, entity_id), else new.  A best fact between both limits is
    ambiguous and links nothing.
    """
    n = names.select(F.col("name").alias("input_name"), normalize_name(F.col("name")).alias("name")).distinct()
    plain = n.select("name").distinct()
    known = ents.filter(~F.col("is_stub")).select("id", "name")

    def way(df: DataFrame, how: str, order: int) -> DataFrame:
        return df.select("name", F.struct(F.lit(order).alias("o"), F.col("id").alias("id"), F.lit(how).alias("how"), F.lit(SCORE[how]).alias("score")).alias("m"))

    ways = [way(graph.by_name(plain, ents).withColumnRenamed("entity_id", "id"), "exact", 0), way(graph.by_alias(plain, ents).withColumnRenamed("entity_id", "id"), "alias", 1)]
    # a later way decides nothing where an earlier one finds an entity
    sure = stage(ways[0].unionByName(ways[1]), "sure")
    left = stage(plain.join(sure.hint("merge"), "name", "left_anti"), "left")
    ways = [sure, fuzzy := stage(way(fuzzy_match(left, known), "fuzzy", 2), "fuzzy")]
    ways.append(way(token_subset_match(left.join(fuzzy.hint("merge"), "name", "left_anti"), known), "fuzzy", 3))
    if vectors is not None and facts is not None:
        near = vector.top_k(vectors.select(F.col("name").alias("query_id"), "vec"), facts.select("id", "vec"), 3).join(facts.select("id", "entity_id"), "id")
        top = near.groupBy(F.col("query_id").alias("name")).agg(F.max_by(F.struct("entity_id", "score"), "score").alias("t"))
        sure = F.col("t.score") >= link
        ways.append(top.filter(F.col("t.score") >= ambiguous).select("name", F.struct(F.lit(4).alias("o"), F.when(sure, F.col("t.entity_id")).alias("id"), F.when(sure, "semantic").otherwise("ambiguous").alias("how"), F.col("t.score").alias("score")).alias("m")))
    every = ways[0]
    for x in ways[1:]:
        every = every.unionByName(x)
    best = every.groupBy("name").agg(F.min("m").alias("m")).hint("merge")
    how = F.coalesce("m.how", F.lit("new"))
    return n.join(best, "name", "left").select("input_name", F.col("m.id").alias("node_id"), how.alias("matched_by"), F.coalesce("m.score", F.lit(0.0)).alias("confidence"), (how == "ambiguous").alias("is_ambiguous"))


def temporal_order(events: DataFrame) -> DataFrame:
    """Adds ``temporal_order``: segment * 1000 + the event's index in its document.

    ``events``: doc_id, segment_id, pos (order within the segment).
    """
    w = Window.partitionBy("doc_id").orderBy("segment_id", "pos")
    return events.withColumn("temporal_order", F.col("segment_id") * 1000 + F.row_number().over(w) - 1)


def link_across(new: DataFrame, stored: DataFrame) -> DataFrame:
    """(from_id, to_id): per new event the latest stored event sharing an entity.

    A backward as-of join: among stored events with one of the new event's
    participants or places as participant, the highest temporal_order strictly
    below its own (null counts 0); ties to the larger id.  One link per event.

    Both sides shrink to distinct (name, temporal_order) before the window that
    carries the latest event forward: a name with a third of all events has no
    more rows there than there are positions in a document.
    """
    t = F.coalesce("temporal_order", F.lit(0)).alias("t")
    asked = new.select("id", t, F.explode(F.array_distinct(F.concat("participants", "locations"))).alias("name")).filter("name is not null")
    held = stored.select("id", t, F.explode(F.array_distinct("participants")).alias("name")).filter("name is not null")
    latest = held.groupBy("name", "t").agg(F.max("id").alias("id"))
    w = Window.partitionBy("name").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    steps = latest.select("name", "t", F.struct("t", "id").alias("s")).unionByName(asked.select("name", "t").distinct(), allowMissingColumns=True)
    best = steps.withColumn("best", F.max("s").over(w)).filter("s is null and best is not null").select("name", "t", "best")
    found = asked.join(best, ["name", "t"]).groupBy("id").agg(F.max("best").alias("b"))
    return found.select(F.col("b.id").alias("from_id"), F.col("id").alias("to_id")).filter("from_id <> to_id")
