"""Mixing sources to target weights: temperature mixing with budgeted blocks.

Pure temperature (``temper``): a source's weight is its share of all tokens to the
power of an exponent, normalised, and the exponent is bisected until the weights
have a wanted entropy, such as that of the target shares.

One exponent over all sources cannot meet a target per source.  So ``mix`` with
targets starts from them: a weight is ``target ** t * capacity ** (1 - t)``,
normalised, where capacity is the share of tokens times the repetition limit.  At
t = 1 the weights are the targets, at t = 0 every limit holds for any size that is
possible at all; t is bisected to the largest one at which all limits hold for the
wanted size.  Without a wanted size the mixture is as large as t = 1 allows.

The weights are realised per source as budgeted block permutations: full
repetitions for all documents, and for the rest a seeded permutation of blocks
of documents that is taken block by block until the budget is used up; only
the block on the boundary is resolved document by document.  Blocks stand in
groups, so that no task orders more than the root of a source's blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import stage, text_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the words into which this tokenizer cuts a text before it merges bytes.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Documents of a block on average; one block is what a single task sorts.
BLOCK = 2_000
SEED = 17
#: Highest exponent of a share.
HIGHEST = 16.0


def source_key(c: Column) -> Column:
    """Spelling of a source: trimmed, white space reduced, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " ")))


class Lengths(dict):
    """Tokens of a piece of text, remembered: merges never cross pieces."""

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= 40:
            if len(self) > 300_000:
                self.clear()
            self[piece] = n
        return n


def with_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) by a public byte-level tokenizer's file, whole texts.

    A null text has 0 tokens.  Special-token strings count as ordinary text.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Lengths(tokenizer).__getitem__
        for b in batches:
            n = [sum(map(of, PIECES.findall(t))) for t in b["text"].fillna("")]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": n})

    slim = documents.filter("doc_id is not null").select("doc_id", source_key(F.col("source")).alias("source"), "text")
    return slim.mapInPandas(count, "doc_id long, source string, n_tokens long")


def entropy(weights: dict[str, float]) -> float:
    """Entropy of normalised weights in nats."""
    whole = sum(weights.values())
    return -sum(w / whole * math.log(w / whole) for w in weights.values() if w > 0)


def temper(tokens: dict[str, float], wanted: float) -> tuple[float, dict[str, float]]:
    """(exponent, weights): token shares to the power that gives the wanted entropy.

    Exponent 1 keeps the shares, 0 makes them equal, more than 1 favours large
    sources.  An entropy that no exponent gives is met as nearly as one can:
    between 0 and ``HIGHEST`` entropy falls as the exponent grows.
    """
    live = {s: n for s, n in tokens.items() if n > 0}
    if not live:
        return 1.0, {}
    top = max(live.values())

    def at(a: float) -> dict[str, float]:
        z = {s: (n / top) ** a for s, n in live.items()}
        k = sum(z.values())
        return {s: x / k for s, x in z.items()}

    low, high = 0.0, HIGHEST
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(at(mid)) > wanted else (low, mid)
    return (low + high) / 2, at((low + high) / 2)


def temperature_weights(target: dict[str, float], capacity: dict[str, float], total: float | None = None) -> tuple[float, float, dict[str, float]]:
    """(exponent, size, weights) for sources that have tokens.

    Without ``total`` the size is the largest at which every target is reached
    exactly (exponent 1).  A total beyond all capacity is cut to it.
    """
    live = {s: w for s, w in target.items() if w > 0 and capacity.get(s, 0) > 0}
    if not live:
        return 1.0, 0.0, {}
    whole = sum(live.values())
    aim = {s: w / whole for s, w in live.items()}
    room = sum(capacity[s] for s in live)

    def at(t: float) -> dict[str, float]:
        logs = {s: t * math.log(aim[s]) + (1 - t) * math.log(capacity[s] / room) for s in live}
        top = max(logs.values())
        z = {s: math.exp(x - top) for s, x in logs.items()}
        k = sum(z.values())
        return {s: x / k for s, x in z.items()}

    if total is None:
        return 1.0, min(capacity[s] / aim[s] for s in live), aim
    size = min(float(total), float(room))
    fits = lambda t: all(size * w <= capacity[s] * (1 + 1e-12) for s, w in at(t).items())
    if fits(1.0):
        return 1.0, size, aim
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low, size, at(low)


class Mixture:
    """The chosen documents and the report of a mixture."""

    def __init__(self, rows: DataFrame, shares: DataFrame) -> None:
        self.rows, self.shares = rows, shares


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER, block: int = BLOCK, seed: int = SEED, tempered: bool = False) -> Mixture:
    """Combine sources to target shares of tokens.

    ``tempered`` takes pure temperature weights with the entropy of the targets in
    their place, and without ``total_tokens`` a mixture as large as all documents
    of the listed sources, so repetition limits may bind.

    ``rows``: doc_id, source, n_tokens, copies (>= 1, at most the source's
    max_repeat).  ``shares``: per listed source the target, the weight it was
    given, documents and tokens available, tokens taken, the share reached and
    the highest number of copies; a source without documents reaches 0 and its
    target is spread over the others.  Sources of documents that are not listed,
    null sources and documents without tokens take no part.  Targets listed
    twice with different spelling are added up with the larger max_repeat; a null
    share counts 0, a null max_repeat 1.  Documents delivered twice count once.
    """
    spark = documents.sparkSession
    text_batches(spark)
    tgt = (
        targets.filter("source is not null").distinct().groupBy(source_key(F.col("source")).alias("source"))
        .agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeat", F.lit(1))).alias("max_repeat"))
    )
    counted = with_tokens(documents, tokenizer).filter("n_tokens > 0").dropDuplicates(["doc_id"])
    docs = stage(counted.join(tgt.select("source"), "source", "left_semi").select("doc_id", "source", "n_tokens"), "tokens")
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    plan = {r["source"]: r for r in tgt.join(have, "source", "left").collect()}  # one row per listed source
    capacity = {s: float(r["tokens"] or 0) * r["max_repeat"] for s, r in plan.items()}
    aims = {s: r["target_share"] for s, r in plan.items()}
    if tempered:
        tokens = {s: float(r["tokens"] or 0) for s, r in plan.items() if aims[s] > 0}
        power, aims = temper(tokens, entropy({s: aims[s] for s in tokens if tokens[s] > 0}))
        total_tokens = total_tokens or int(sum(tokens.values())) or None
    exponent, size, weight = temperature_weights(aims, capacity, total_tokens)
    rows = []
    for s, r in plan.items():
        want = min(size * weight.get(s, 0.0), capacity[s])
        tokens = r["tokens"] or 0
        full = min(int(want // tokens + 1e-9), r["max_repeat"]) if tokens else 0
        blocks = max(1, -(-(r["docs"] or 0) // block))
        rows.append((s, full, int(round(want - full * tokens)) if full < r["max_repeat"] else 0, blocks, math.isqrt(blocks - 1) + 1, float(weight.get(s, 0.0)), float(power if tempered else exponent)))
    budget = F.broadcast(spark.createDataFrame(rows, "source string, full int, rest long, blocks long, groups long, weight double, exponent double"))

    h = F.xxhash64("doc_id", F.lit(seed))
    placed = docs.join(budget, "source").withColumn("block", F.pmod(h, F.col("blocks"))).withColumn("order", F.xxhash64("doc_id", F.lit(seed + 1)))
    # groups of blocks in a seeded order, blocks of a group likewise, with the tokens ahead of each
    group = F.pmod(F.xxhash64("block", F.lit(seed + 3)), F.col("groups"))
    sums = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"), F.first("rest").alias("rest"), F.first(group).alias("group"))
    of_groups = sums.groupBy("source", "group").agg(F.sum("block_tokens").alias("group_tokens"))
    w = Window.partitionBy("source").orderBy(F.xxhash64("group", F.lit(seed + 4)), "group")
    of_groups = of_groups.withColumn("earlier", F.sum("group_tokens").over(w) - F.col("group_tokens"))
    v = Window.partitionBy("source", "group").orderBy(F.xxhash64("block", F.lit(seed + 2)), "block")
    ahead = sums.join(of_groups, ["source", "group"]).withColumn("before", F.col("earlier") + F.sum("block_tokens").over(v) - F.col("block_tokens"))
    ahead = ahead.filter("before < rest").select("source", "block", "before", "block_tokens")
    there = placed.join(ahead, ["source", "block"], "left")
    whole = there.filter("before is null or before + block_tokens <= rest").withColumn("extra", F.when(F.col("before").isNull(), 0).otherwise(1))
    edge = there.filter("before + block_tokens > rest")
    inside = Window.partitionBy("source", "block").orderBy("order", "doc_id")
    edge = edge.withColumn("extra", F.when(F.col("before") + F.sum("n_tokens").over(inside) <= F.col("rest"), 1).otherwise(0))
    cols = ["doc_id", "source", "n_tokens", (F.col("full") + F.col("extra")).cast("int").alias("copies")]
    out = whole.select(*cols).unionByName(edge.select(*cols)).filter("copies > 0")

    taken = out.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    all_tokens = taken.agg(F.sum("mixed_tokens").alias("mixture_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    shares = (
        tgt.join(budget.select("source", "weight", "exponent"), "source").join(have, "source", "left").join(taken, "source", "left").crossJoin(F.broadcast(all_tokens))  # a one-row aggregate
        .select(
            "source", "target_share", "max_repeat", "weight", "exponent", zero("docs").alias("available_docs"), zero("tokens").alias("available_tokens"),
            zero("mixed_tokens").alias("mixed_tokens"), zero("most_copies").alias("most_copies"),
            F.round(zero("mixed_tokens") / F.when(F.col("mixture_tokens") > 0, F.col("mixture_tokens")), 6).alias("reached_share"),
        )
    )
    return Mixture(out, shares)


def expand(rows: DataFrame) -> DataFrame:
    """One row per use of a document, with the number of the repetition."""
    return rows.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
