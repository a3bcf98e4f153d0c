"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into segments, few at first and then more. From a segment's mean and
deviation alone follows a lower bound of two vectors' distance, and with their norms an
upper bound of their inner product: over segments of m components, the sum of m times the
product of the means plus m times the product of the deviations. Pairs that cannot reach a
query's bound at a coarse cut are dropped before the next finer one; only survivors are
computed in full. A query's bound starts as its k-th best score in a bounded seed of rows,
which never exceeds the true one, and rises as a task goes through its candidates.

Queries and candidates meet in cells, one block of queries with one block of rows each, so
a task's memory is bounded by the block sizes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import clean_vectors, stored

#: Rows of a block of candidates and of queries, and candidates taken at once in a task.
CANDIDATES, QUERIES, STEP = 8192, 1024, 2048

#: Rows of the seed that gives queries their first bounds.
SEED_ROWS = 1024

#: Segments of the cuts, coarse to fine.
CUTS = (1, 4, 16)

#: Up to here sums of integers are exact in double precision.
EXACT = float(1 << 53)


def features(v: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the segment's length."""
    parts = np.array_split(np.arange(v.shape[1]), min(segments, v.shape[1]))
    means = np.stack([v[:, p].mean(1) * len(p) ** 0.5 for p in parts], 1)
    spread = np.stack([v[:, p].std(1) * len(p) ** 0.5 for p in parts], 1)
    return np.concatenate([means, spread], 1)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All integer inner products of two blocks."""
    if max(np.abs(q).max(initial=0), 1.0) * max(np.abs(x).max(initial=0), 1.0) * q.shape[1] < EXACT:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return q @ x.T


def kth_best(q: np.ndarray, rows: np.ndarray, seed: np.ndarray, seed_rows: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among seed rows other than its own; lowest if there are fewer."""
    lowest = np.iinfo(np.int64).min
    if len(seed) <= k:
        return np.full(len(q), lowest)
    scores = _scores(q, seed)
    scores[rows[:, None] == seed_rows[None]] = lowest
    return np.partition(scores, len(seed) - k, axis=1)[:, len(seed) - k]


def search_block(q: np.ndarray, q_rows: np.ndarray, bound: np.ndarray, x: np.ndarray, x_rows: np.ndarray,
                 x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query in a block: places of queries and candidates, scores."""
    bound = bound.copy()
    best = (np.empty(0, np.int64),) * 3
    qf = [features(q.astype(float), c) for c in CUTS]
    for at in range(0, len(x), STEP):
        part = x[at:at + STEP]
        alive = q_rows[:, None] != x_rows[None, at:at + STEP]
        for cut, left in zip(CUTS, qf):
            # Survivors are few at best after the last cut; whole products are cheaper until then.
            upper = left @ features(part.astype(float), cut).T
            alive &= upper + 1e-6 * np.abs(upper) + 1e-6 >= bound[:, None]
        i, j = np.nonzero(alive)
        if not len(i):
            continue
        if len(i) * 8 > alive.size:
            score = _scores(q, part)[i, j]
        else:
            score = np.einsum("ij,ij->i", q[i], part[j])
        keep = score >= bound[i]
        found = (np.concatenate([best[0], i[keep]]), np.concatenate([best[1], j[keep] + at]), np.concatenate([best[2], score[keep]]))
        order = np.lexsort((x_rows[found[1]], x_ids[found[1]], -found[2], found[0]))
        found = tuple(c[order] for c in found)
        rank = np.arange(len(order)) - np.searchsorted(found[0], found[0])
        best = tuple(c[rank < k] for c in found)
        full = np.flatnonzero(rank == k - 1)
        bound[found[0][full]] = np.maximum(bound[found[0][full]], found[2][full])
    return best


def _numbers(n: int):
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def top_inner_products(df: DataFrame, queries: DataFrame | None = None, k: int = 20, scale: float = 64.0,
                       every: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k rows of largest integer inner product: query_id, rank, vec_id, score.

    A component x counts as floor(scale * x). Queries are the rows whose key is divisible by
    ``every``; a query's candidates are all rows but itself, repeated rows included. Ties go
    to the smaller key. Rows with a null key, and vectors that are null, empty or hold a null
    or non-finite component, take no part; zero vectors do. Vectors only meet others of the
    same length. An empty table gives an empty one; other columns are not read. Scores are
    64-bit integers.
    """
    spark = df.sparkSession
    rows = clean_vectors(df, key, vector, zeros=True).select(
        "row", "id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"), F.size("v").alias("dim")
    )
    rows = stored(rows, "topk-vectors")
    asked = rows.where(F.col("id") % every == 0)
    n, m = rows.count(), asked.count()
    blocks, asks = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    seed = rows.orderBy(F.xxhash64("row")).limit(SEED_ROWS).toPandas()  # a bounded sample

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_row": [], "query_id": [], "vec_row": [], "vec_id": [], "score": []}, dtype="int64")
        if left.empty or right.empty:
            return empty
        q, x = np.stack(left["query_v"].to_numpy()), np.stack(right["v"].to_numpy())
        fit = seed[seed["dim"] == q.shape[1]]
        q_rows, x_rows = left["query_row"].to_numpy(), right["row"].to_numpy()
        bound = kth_best(q, q_rows, np.stack(fit["v"].to_numpy()), fit["row"].to_numpy(), k) if len(fit) else np.full(len(q), np.iinfo(np.int64).min)
        i, j, score = search_block(q, q_rows, bound, x, x_rows, right["id"].to_numpy(), k)
        return pd.DataFrame({
            "query_row": q_rows[i], "query_id": left["query_id"].to_numpy()[i], "vec_row": x_rows[j],
            "vec_id": right["id"].to_numpy()[j], "score": score,
        })

    block, ask = F.pmod(F.xxhash64("row"), F.lit(blocks)), F.pmod(F.xxhash64("row"), F.lit(asks))
    left = asked.select(  # names of its own, for both sides come from one table
        F.col("dim").alias("query_dim"), ask.alias("query_ask"), F.explode(_numbers(blocks)).alias("query_block"),
        F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.col("v").alias("query_v"),
    )
    right = rows.withColumn("block", block).withColumn("ask", F.explode(_numbers(asks)))
    cells = left.groupBy("query_dim", "query_ask", "query_block").cogroup(right.groupBy("dim", "ask", "block"))
    found = cells.applyInPandas(cell, "query_row long, query_id long, vec_row long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
