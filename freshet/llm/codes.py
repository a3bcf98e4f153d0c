"""Vector codes by a trained codebook per part, whose nearest entries are found by a GNAT.

Vectors become integers and are cut into parts; each part position has a codebook, trained
by a fixed number of rounds that assign every part to its nearest entry and average what an
entry got. All vectors count in every round: tasks add up integers per entry, Spark adds up
the tasks' sums, and only the codebooks (of bounded size) pass the driver.

A geometric near-neighbour access tree holds the entries: a node has a few split points,
every other entry belongs to the split nearest to it, and for each pair of splits the node
stores the range of distances from the one to the entries of the other. A query compares
itself with the splits and leaves out every subtree whose range lies further away than the
best distance so far. Distances there are rounded outwards and compared strictly, and what
is left is decided by integer squared distances, ties to the lower index, so that the result
is that of comparing with every entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

#: Parts of a vector, entries of a codebook, rounds of training, and the factor of a component.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256

#: Split points of a node.
SPLITS = 8

#: Share by which a computed distance may be off, with much to spare.
SLACK = 1e-12

_MOST = np.iinfo(np.int64).max


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``a`` to each row of ``b``."""
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(2)


@dataclass
class _Node:
    splits: np.ndarray  # indexes of entries
    low: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))  # by split and subtree
    high: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    subtrees: list["_Node | None"] = field(default_factory=list)


class Gnat:
    """The nearest of a few integer points, without comparing with each."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.compared = 0
        self.root = self._node(np.arange(len(entries)))

    def _node(self, members: np.ndarray) -> _Node | None:
        if not len(members):
            return None
        if len(members) <= SPLITS:
            return _Node(members)
        points = self.entries[members]
        chosen = [0]
        apart = squared(points, points[:1])[:, 0]
        while len(chosen) < SPLITS:  # each further split lies furthest from those before it
            apart[chosen] = -1
            chosen.append(int(apart.argmax()))
            apart = np.minimum(apart, squared(points, points[chosen[-1:]])[:, 0])
        gaps = squared(points, points[chosen])
        owner = gaps.argmin(1)
        owner[chosen] = np.arange(SPLITS)
        exact = np.sqrt(gaps.astype(float))
        node = _Node(members[chosen], np.empty((SPLITS, SPLITS)), np.empty((SPLITS, SPLITS)))
        for j in range(SPLITS):
            # The split itself has been compared by then: ranges are of the others.
            inside = owner == j
            inside[chosen[j]] = False
            if inside.any():
                node.low[:, j] = exact[inside].min(0) * (1 - SLACK)
                node.high[:, j] = exact[inside].max(0) * (1 + SLACK)
            node.subtrees.append(self._node(members[inside]))
        return node

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per point, the index of the nearest entry (the lowest of equals) and the squared distance."""
        index, best = np.full(len(points), len(self.entries), np.int64), np.full(len(points), _MOST, np.int64)
        if self.root is not None and len(points):
            self._visit(self.root, points, np.arange(len(points)), index, best)
        return index, best

    def _visit(self, node: _Node, points: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        gaps = squared(points[rows], self.entries[node.splits])
        self.compared += gaps.size
        least = gaps.min(1)
        which = np.where(gaps == least[:, None], node.splits[None, :], len(self.entries)).min(1)
        nearer = (least < best[rows]) | ((least == best[rows]) & (which < index[rows]))
        index[rows[nearer]], best[rows[nearer]] = which[nearer], least[nearer]
        if not any(node.subtrees):
            return
        apart, first = np.sqrt(gaps.astype(float)), gaps.argmin(1)
        for own in (True, False):  # the subtree of the nearest split narrows the search for the rest
            for j, subtree in enumerate(node.subtrees):
                if subtree is None:
                    continue
                asked = np.flatnonzero((first == j) == own)
                radius = np.sqrt(best[rows[asked]].astype(float))[:, None] * (1 + SLACK)
                near, far = apart[asked] * (1 - SLACK), apart[asked] * (1 + SLACK)
                out = (near > (node.high[:, j] + radius) * (1 + SLACK)) | (node.low[:, j] * (1 - SLACK) > (far + radius) * (1 + SLACK))
                left = asked[~out.any(1)]
                if len(left):
                    self._visit(subtree, points, rows[left], index, best)


def whole_vectors(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Rows with a usable vector: id, label and the vector as integers, floor(SCALE * x)."""
    v = F.col(vector).cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # An error is a long: integers stop where the squares of a vector's differences no longer fit one.
    most = F.floor(F.sqrt(F.lit(2.0**61) / F.greatest(F.size(v), F.lit(1)))).cast("double")
    whole = F.transform(v, lambda x: F.greatest(-most, F.least(most, F.floor(F.least(F.lit(2.0**53), F.greatest(F.lit(-(2.0**53)), x)) * float(SCALE)).cast("double"))).cast("long"))
    return df.where(good).select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), whole.alias("whole"))


def _width(size: int) -> int:
    return -(-size // PARTS)


def _parts(vectors: np.ndarray) -> np.ndarray:
    """Integer vectors (rows) as rows, parts, components; a length that is no multiple of PARTS ends in zeros."""
    width = _width(vectors.shape[1])
    padded = np.zeros((len(vectors), PARTS * width), np.int64)
    padded[:, :vectors.shape[1]] = vectors
    return padded.reshape(len(vectors), PARTS, width)


#: Per vector length, the codebooks: parts, entries, components.
Books = dict[int, np.ndarray]


def first_books(vectors: DataFrame) -> Books:
    """The parts of the vectors with the smallest ids (null last, ties by the vector), ENTRIES of a length."""
    order = W.partitionBy("size").orderBy(F.col("vec_id").asc_nulls_last(), "whole")
    first = vectors.select(F.size("whole").alias("size"), "vec_id", "whole").withColumn("place", F.row_number().over(order)).where(F.col("place") <= ENTRIES)
    rows = sorted(first.collect(), key=lambda r: (r["size"], r["place"]))
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(r["size"], []).append(r["whole"])
    return {n: _parts(np.array(v, np.int64).reshape(len(v), n)).transpose(1, 0, 2) for n, v in by_size.items()}


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a batch's vectors: the length, the rows that have it, their parts."""
    column = batch.column("whole")
    ends = np.asarray(column.offsets).astype(np.int64)
    flat, sizes = np.asarray(column.values).astype(np.int64), np.diff(ends)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, _parts(flat[ends[rows][:, None] + np.arange(size)[None, :]])


def _trees(books: Books) -> dict[int, list[Gnat]]:
    return {size: [Gnat(part) for part in book] for size, book in books.items()}


_SUMS = pa.schema([(x, pa.int64()) for x in ("size", "part", "entry", "at", "total", "members")])


def refined(vectors: DataFrame, books: Books) -> Books:
    """One round: every part goes to its nearest entry, and entries become the floor of their parts' mean."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, sums, members = _trees(books), {n: np.zeros_like(b) for n, b in books.items()}, {n: np.zeros(b.shape[:2], np.int64) for n, b in books.items()}
        for batch in batches:
            for size, _, parts in _groups(batch):
                for p, tree in enumerate(trees[size]):
                    index, _ = tree.nearest(parts[:, p])
                    np.add.at(sums[size][p], index, parts[:, p])
                    members[size][p] += np.bincount(index, minlength=members[size].shape[1])
        for size, total in sums.items():
            part, entry, at = (x.ravel() for x in np.indices(total.shape))
            count = np.repeat(members[size].ravel(), total.shape[2])
            used = count > 0
            columns = [np.full(used.sum(), size), part[used], entry[used], at[used], total.ravel()[used], count[used]]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=_SUMS)

    sums = vectors.select("whole").mapInArrow(add, ", ".join(f"{f.name} long" for f in _SUMS))
    # A row a length, part, entry and component: as many as the codebooks have numbers.
    totals = sums.groupBy("size", "part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("members").alias("members")).collect()
    new = {n: b.copy() for n, b in books.items()}
    for r in totals:
        new[r["size"]][r["part"], r["entry"], r["at"]] = r["total"] // r["members"]
    return new


def train(vectors: DataFrame, rounds: int = ROUNDS) -> Books:
    books = first_books(vectors)
    for _ in range(rounds if books else 0):
        books = refined(vectors, books)
    return books


def books_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, code, error and codebooks_sha256 of each vector."""
    digests = {n: books_digest(b) for n, b in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(books)
        for batch in batches:
            codes, errors, sums = [""] * batch.num_rows, np.zeros(batch.num_rows, np.int64), [""] * batch.num_rows
            for size, rows, parts in _groups(batch):
                indexes = np.empty((len(rows), PARTS), np.uint8)
                for p, tree in enumerate(trees[size]):
                    indexes[:, p], gaps = tree.nearest(parts[:, p])
                    errors[rows] += gaps
                for row, code in zip(rows.tolist(), indexes):
                    codes[row], sums[row] = code.tobytes().hex(), digests[size]
            yield pa.record_batch(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors), pa.array(sums, pa.string())],
                names=["vec_id", "label", "code", "error", "codebooks_sha256"],
            )

    schema = vectors.select("vec_id", "label").schema.add("code", "string").add("error", "long").add("codebooks_sha256", "string")
    return vectors.mapInArrow(run, schema)


def _as_long(total: Column) -> Column:
    return F.least(total, F.lit(_MOST).cast("decimal(38,0)")).cast("long")


def compress_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per usable vector: vec_id, label, code, error, label_error, codebooks_sha256.

    Null vectors and those with a null or non-finite component are left out; an empty vector
    has code 00 throughout and error 0. Vectors of one length share codebooks; lengths are
    trained apart, and one that is no multiple of PARTS is filled up with zeros. With fewer
    vectors than ENTRIES a codebook has as many entries. Null ids come last in the choice of
    first entries, equal ids are ordered by vector, repeated rows count each. An integer
    beyond what lets squares of a vector fit a long stops there, and a label's error at the
    largest long. Null labels are summed together. An empty table gives an empty one. Other
    columns are not read. The driver holds the codebooks: ENTRIES vectors of each length.
    """
    vectors = stored(whole_vectors(df, key, vector, label), "codes-vectors")
    rows = stored(coded(vectors, train(vectors)), "codes")
    sums = rows.groupBy(F.col("label").alias("_label")).agg(_as_long(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
