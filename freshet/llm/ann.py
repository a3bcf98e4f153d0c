"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by some random Gaussian projections, each shifted and cut into
slots; the slots together name a bucket. Distances of Gaussian projections are Gaussian, so
for a neighbour at a given distance the chance of every bucket around a query is known. A
query visits a table's buckets in falling order of that chance until their sum reaches what
the wanted recall asks of each table: first for the distance fitted on a sample, then for the
k-th distance it found itself, if that is further. Candidates of all tables are merged and ranked by
their exact distance.

The index holds every row. Only slot width and the first distance are fitted, on a bounded
sample. A bucket with more rows than a region is meant for is split by row number, and a
query that visits it is sent to all its parts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import clean_vectors, stored

#: Tables, and the recall that the visited buckets are chosen for.
TABLES, RECALL = 4, 0.92

#: Slot width in standard deviations of the projections, and the bits of order such a slot
#: leaves: so many functions are taken that a bucket holds about BUCKET_ROWS rows.
WIDTH, SLOT_BITS, BUCKET_ROWS = 2.0, 1.25, 256

#: Rows the widths and the neighbour distance are fitted on.
SAMPLE_ROWS = 4096

#: Index rows and queries that meet in a task.
REGION_ROWS, QUERIES = 8192, 512

#: Share of the chance that partly built buckets may lose in the enumeration.
LOST = 1e-3

_SEED = 11


class Index:
    """The hash functions of all tables, and the distance neighbours are first expected at."""

    def __init__(self, sample: np.ndarray, rows: int, k: int, tables: int = TABLES, recall: float = RECALL) -> None:
        self.tables, self.dim = tables, sample.shape[1]
        self.functions = max(1, math.ceil(math.log2(max(2.0, rows / BUCKET_ROWS)) / SLOT_BITS))
        rng = np.random.default_rng(_SEED)
        self.directions = rng.standard_normal((tables, self.dim, self.functions))
        spread = (sample @ self.directions.reshape(tables, self.dim, -1)).std(axis=1)
        self.width = np.maximum(WIDTH * spread, 1e-9)
        self.shift = rng.random((tables, self.functions))
        self.mixers = rng.integers(1, 1 << 62, (tables, self.functions), dtype=np.int64) * 2 + 1
        self.share = 1 - (1 - recall) ** (1 / tables)
        some = sample[:64]
        gaps = ((some[:, None] - sample[None]) ** 2).sum(-1)
        place = min(k, len(sample) - 1)
        self.near = max(float(np.sqrt(np.median(np.partition(gaps, place, axis=1)[:, place]))), 1e-9)

    def places(self, v: np.ndarray, table: int) -> np.ndarray:
        return v @ self.directions[table] / self.width[table] + self.shift[table]

    def bucket(self, slots: np.ndarray, table: int) -> np.ndarray:
        key = (slots.astype(np.int64) * self.mixers[table]).sum(-1) + table
        return key ^ (key >> 31)

    def probes(self, place: np.ndarray, table: int, distance: float) -> np.ndarray:
        """Buckets of a table in falling order of success for a neighbour at a distance, up to the table's share of the recall."""
        chances, slots = np.ones(1), np.zeros((1, 0))
        for at, width in zip(place, self.width[table]):
            deviation = distance / width
            reach = math.ceil(4 * deviation)
            near = math.floor(at) + np.arange(-reach, reach + 1)
            own = _normal((near + 1 - at) / deviation) - _normal((near - at) / deviation)
            near, own = near[own > 1e-4], own[own > 1e-4]
            chances = (chances[:, None] * own).ravel()
            slots = np.concatenate([np.repeat(slots, len(near), 0), np.tile(near, len(slots))[:, None]], 1)
            order = np.argsort(-chances, kind="stable")
            total = np.cumsum(chances[order])
            order = order[:np.searchsorted(total, total[-1] * (1 - LOST)) + 1]
            chances, slots = chances[order], slots[order]
        total = np.cumsum(chances)
        return self.bucket(slots[:np.searchsorted(total, self.share) + 1], table)


def _normal(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x])


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed in the order of the components."""
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        total += (x[:, i] - q[:, i]) ** 2
    return np.sqrt(total)


def _nearest(index: Index, k: int):
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_row": [], "query_id": [], "vec_row": [], "vec_id": [], "score": []}).astype(
            {"query_row": "int64", "query_id": "int64", "vec_row": "int64", "vec_id": "int64"})
        if left.empty or right.empty:
            return empty
        right = right.sort_values("bucket", kind="stable")
        keys = right["bucket"].to_numpy()
        # A row stands in a bucket of each table: its candidates merge in one column here.
        rows, first, column = np.unique(right["row"].to_numpy(), return_index=True, return_inverse=True)
        ids, x = right["id"].to_numpy()[first], np.stack(right["v"].to_numpy()[first])
        q = np.stack(left["query_v"].to_numpy())
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        stops = np.append(starts[1:], len(keys))
        visits: dict[int, list[int]] = {}
        for i, buckets in enumerate(left["query_buckets"]):
            for b in buckets:
                visits.setdefault(b, []).append(i)
        rough = np.full((len(q), len(x)), np.inf)
        qq, xx = (q ** 2).sum(1), (x ** 2).sum(1)
        for start, stop in zip(starts, stops):
            if who := visits.get(int(keys[start])):
                here = column[start:stop]
                rough[np.ix_(who, here)] = qq[who][:, None] + xx[here] - 2 * (q[who] @ x[here].T)
        q_rows, q_ids = left["query_row"].to_numpy(), left["query_id"].to_numpy()
        rough[q_rows[:, None] == rows[None]] = np.inf
        last = min(k, len(x)) - 1
        # What rounding could tell apart only by chance is measured exactly.
        bound = np.partition(rough, last, axis=1)[:, last]
        slack = 1e-9 * (qq + xx.max())
        i, j = np.nonzero((rough <= (bound + slack)[:, None]) & np.isfinite(rough))
        score = distances(x[j], q[i])
        order = np.lexsort((rows[j], ids[j], score, i))
        i, j, score = i[order], j[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j = i[keep], j[keep]
        return pd.DataFrame({"query_row": q_rows[i], "query_id": q_ids[i], "vec_row": rows[j], "vec_id": ids[j], "score": score[keep]})
    return search


def _numbers(n: int):
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def nearest_neighbours(df: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k nearest rows found: query_id, rank, vec_id, score (Euclidean distance).

    Queries are the rows whose key is divisible by ``every``; candidates are all rows but the
    query itself, repeated ones included. Ties go to the smaller key. Rows with a null key,
    and vectors that are null, empty, zero or hold a null or non-finite component, take no
    part, nor do those of another length than the sample's first. An empty table gives an
    empty one; other columns are not read.
    """
    rows = stored(clean_vectors(df, key, vector, zeros=False), "ann-vectors")
    n = rows.count()
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("row")).limit(SAMPLE_ROWS).collect()]  # bounded
    sample = np.array([v for v in sample if len(v) == len(sample[0])]) if sample else np.ones((2, 1))
    index = Index(sample, n, k)
    dim = index.dim
    rows = rows.where(F.size("v") == dim)

    def hashed(batches):
        for pdf in batches:
            v = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.empty((0, dim))
            buckets = np.stack([index.bucket(np.floor(index.places(v, t)), t) for t in range(index.tables)], 1)
            yield pd.DataFrame({"row": pdf["row"], "buckets": list(buckets)})

    def probed(batches):
        for pdf in batches:
            found = []
            for v, distance in zip(pdf["v"], pdf["near"]):
                v = np.asarray(v)[None]
                found.append(np.concatenate([index.probes(index.places(v, t)[0], t, distance) for t in range(index.tables)]))
            yield pd.DataFrame({"row": pdf["row"], "buckets": found})

    entries = stored(
        rows.select("row", "v").mapInPandas(hashed, "row long, buckets array<long>").select("row", F.explode("buckets").alias("bucket")),
        "ann-entries",
    )
    parts = F.ceil(F.col("count") / REGION_ROWS).cast("int")
    buckets = stored(entries.groupBy("bucket").count().withColumn("parts", parts).drop("count"), "ann-buckets")
    regions = max(1, -(-n * index.tables // REGION_ROWS))

    def region(part):
        return F.pmod(F.xxhash64("bucket", part), F.lit(regions))

    placed = entries.join(buckets, "bucket").select(
        "row", "bucket", region(F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).alias("region")
    )
    asked = rows.where(F.col("id") % every == 0)
    asks = max(1, -(-asked.count() // QUERIES))
    ask = F.pmod(F.xxhash64("row"), F.lit(asks))
    right = placed.join(rows, "row")

    def visited(asked: DataFrame, label: str) -> DataFrame:
        """The k best of each query (its columns and ``near``) among the buckets it visits."""
        visits = (
            asked.select("row", "v", "near").mapInPandas(probed, "row long, buckets array<long>")
            .select("row", F.explode("buckets").alias("bucket"))
            .join(buckets, "bucket")
            .select("row", "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
            .groupBy("row", region(F.col("part")).alias("region")).agg(F.collect_set("bucket").alias("buckets"))
        )
        left = visits.join(asked, "row").select(*_query_columns(ask, F.col("region"), F.col("buckets")))
        return stored(_search(left, right, index, k, asks), label)

    found = visited(asked.withColumn("near", F.lit(index.near)), "ann-found")
    # A query's k-th distance so far is at least that of its k-th neighbour: those further than expected probe on for it.
    reached = found.groupBy("query_row").agg(F.count("*").alias("count"), F.max("score").alias("near"))
    wider = reached.where((F.col("count") >= k) & (F.col("near") > index.near)).select(F.col("query_row").alias("row"), "near")
    wider = stored(asked.join(wider, "row"), "ann-wider")
    if not wider.isEmpty():
        found = stored(_ranked(found.unionByName(visited(wider, "ann-wider-found")), k).drop("rank"), "ann-found")

    # Queries whose buckets hold too few rows go on to all the others, in blocks.
    wanted = min(k, rows.count() - 1)
    enough = found.groupBy("query_row").count().where(F.col("count") >= wanted)
    short = asked.join(enough, F.col("row") == F.col("query_row"), "left_anti")
    blocks = max(1, -(-n // REGION_ROWS))
    everything = F.array(F.lit(0).cast("long"))
    left = short.withColumn("region", F.explode(_numbers(blocks))).select(*_query_columns(ask, F.col("region"), everything))
    right = rows.withColumn("bucket", F.lit(0).cast("long")).withColumn("region", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    rest = _search(left, right, index, k, asks) if not short.isEmpty() else found.limit(0)
    return _ranked(found.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


def _query_columns(ask, region, buckets):
    """Names of its own for the query side, for both sides come from one table."""
    return [
        region.alias("query_region"), ask.alias("query_ask"), F.col("row").alias("query_row"),
        F.col("id").alias("query_id"), F.col("v").alias("query_v"), buckets.alias("query_buckets"),
    ]


def _search(left: DataFrame, right: DataFrame, index: Index, k: int, asks: int) -> DataFrame:
    """The k best of each query among what it visits."""
    right = right.withColumn("ask", F.explode(_numbers(asks)))
    found = left.groupBy("query_region", "query_ask").cogroup(right.groupBy("region", "ask")).applyInPandas(
        _nearest(index, k), "query_row long, query_id long, vec_row long, vec_id long, score double"
    )
    merged = found.groupBy("query_row", "query_id", "vec_row", "vec_id").agg(F.min("score").alias("score"))
    return _ranked(merged, k).drop("rank")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    found = found.dropDuplicates(["query_row", "vec_row"])
    rank = F.row_number().over(W.partitionBy("query_row").orderBy("score", "vec_id", "vec_row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
