"""Exact vector search for batches of queries.

Many queries meet many rows: both sides are cut into blocks that are multiplied as
numpy matrices.  A task keeps a running top k of each query over all its rows, so
what is shuffled is k rows per query and task.  Queries are a stated set; they
are shipped to the workers in parts, each a pass over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.vectors import cosine
from skein.session import broadcast_if_small, stage

#: Queries of one part, held by every worker.
PART = 4096
#: Queries that are multiplied with a batch of rows at once.
BLOCK = 256


def _query_blocks(part: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of queries of one size, ``BLOCK`` at a time."""
    by_size: dict[int, list] = {}
    for i, v in part:
        by_size.setdefault(len(v), []).append((i, v))
    cut = [x[at : at + BLOCK] for x in by_size.values() for at in range(0, len(x), BLOCK)]
    return [(np.array([i for i, _ in x], dtype=object), np.array([v for _, v in x], dtype=float)) for x in cut]


def _block_top(m: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, cosine) of the k best rows of each query and all that may tie with them.

    The product of the matrices selects; scores are then taken pair by pair, so
    equal vectors have equal scores wherever they stand.
    """
    n = min(m.shape[1], q.shape[1])
    m, q, size_m, size_q = m[:, :n], q[:, :n], np.sqrt((m * m).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    size = size_m[:, None] * size_q[None, :]
    s = np.divide(m @ q.T, size, out=np.zeros(size.shape), where=size > 0)
    least = np.partition(s, len(m) - k, axis=0)[len(m) - k] if len(m) > k else np.full(len(q), -np.inf)
    r, c = np.nonzero(s >= least - 1e-9)
    exact = np.einsum("ij,ij->i", m[r], q[c])
    return r, c, np.divide(exact, size[r, c], out=np.zeros(len(r)), where=size[r, c] > 0)


def top_k(queries: DataFrame, rows: DataFrame, k: int, floor: float | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k rows most similar to each query.

    ``queries``: query_id, vec; ``rows``: id, vec; null vectors take no part, a
    vector without length scores 0.  Ties go to the smaller id.  A floor applies
    after the k best, and scores are kept in double.  Queries stream through the
    driver in parts of ``PART``; rows never do.  Equal vectors of a part are looked
    up once.
    """
    spark = rows.sparkSession
    id_type = dict(rows.dtypes)["id"]
    q_type = dict(queries.dtypes)["query_id"]
    out = None
    it = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null").toLocalIterator()
    done = False
    while not done:
        part, taken = {}, 0
        for r in it:
            part.setdefault(tuple(r[1]), []).append(r[0])
            taken += 1
            if taken == PART:
                break
        else:
            done = True
        if not part and out is not None:
            break
        shared = spark.sparkContext.broadcast((list(part), list(part.values())))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            vecs, askers = shared.value
            blocks = _query_blocks(list(enumerate(vecs)))
            best = pd.DataFrame({"query_id": [], "id": [], "score": []})
            for b in batches:
                b = b[b["vec"].notna()]
                if b.empty or not blocks:
                    continue
                parts = [best] if len(best) else []
                for _, g in b.groupby(b["vec"].map(len)):
                    m, names = np.stack(g["vec"].to_numpy()).astype(float), g["id"].to_numpy(dtype=object)
                    for ids, q in blocks:
                        r, c, score = _block_top(m, q, k)
                        parts.append(pd.DataFrame({"query_id": ids[c], "id": names[r], "score": score}))
                best = pd.concat(parts).sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k)
            best = best.assign(query_id=[askers[i] for i in best["query_id"]]).explode("query_id")
            yield best.astype({"query_id": object, "id": object, "score": float})

        found = rows.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInPandas(search, f"query_id {q_type}, id {id_type}, score double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked if floor is None else ranked.filter(F.col("score") >= floor)


def search_facts(queries: DataFrame, facts: DataFrame, k: int = 3, user: str = "app_user", floor: float | None = None) -> DataFrame:
    """Top k facts of one user: (query_id, id, score, rank, text, pathway)."""
    own = facts.filter(F.col("user_id") == user)
    return broadcast_if_small(stage(top_k(queries, own, k, floor), "hits")).join(own.select("id", "text", "pathway"), "id")


def search_pathways(queries: DataFrame, pathways: DataFrame, k: int = 5) -> DataFrame:
    """Top k pathways, then without those that are empty."""
    return broadcast_if_small(stage(top_k(queries, pathways, k), "hits")).join(pathways.select("id", "pathway"), "id").filter(F.size("pathway") > 0)


def pair_scores(pairs: DataFrame, a: str, b: str) -> Column:
    """Cosine of two vector columns of one frame."""
    return cosine(F.col(a), F.col(b))
