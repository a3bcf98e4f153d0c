"""Packing token ids into windows by Karmarkar-Karp multiway differencing.

A document's whole windows stand alone; what remains of it is cut into pieces and waits
in a pool. When the pool fills a given number of windows, the pieces are dealt out: each
piece starts as a partial partition of its own, and the two partitions with the largest
imbalance are merged, heaviest window onto lightest, until one partition is left. Its
windows are near-equal. If one exceeds the capacity, the pieces are dealt out anew to one
window more. Copies of a piece, which mixing makes, trade places until no window holds two.
Pools are filled by a task from its own rows, so nothing is shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import crc_of, small_batches
from .tokens import encoder

#: Windows a pool fills, the longest piece of a remainder, and the room per window that a
#: pool leaves so that the windows come out below the capacity at the first attempt.
POOL_WINDOWS, PIECE, ROOM = 128, 512, 6

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item: multiway largest differencing.

    A partition is its windows' sums, descending and less the smallest of them, and a
    tree of items per window. Ties go by order of creation, so reruns agree.
    """
    n = len(sizes)
    if windows == 1 or not n:
        return np.zeros(n, int)
    trees: list[tuple[int, int]] = []  # pairs of nodes; items are nodes 0 to n - 1
    heap = []
    for i, size in enumerate(sizes.tolist()):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], nodes[0] = size, i
        heap.append((-size, i, sums, nodes))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums, y = a + b[::-1], y[::-1]
        both = (x >= 0) & (y >= 0)
        nodes = np.where(x >= 0, x, y)
        nodes[both] = n + len(trees) + np.arange(both.sum())
        trees.extend(zip(x[both].tolist(), y[both].tolist()))
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), serial, sums, nodes))
        serial += 1
    place = np.zeros(n, int)
    for window, node in enumerate(heap[0][3].tolist()):
        open_nodes = [node] if node >= 0 else []
        while open_nodes:
            at = open_nodes.pop()
            if at < n:
                place[at] = window
            else:
                open_nodes.extend(trees[at - n])
    return place


def deal(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, in as few windows as differencing keeps to the capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        place = difference(sizes, windows)
        if np.bincount(place, sizes, windows).max(initial=0) <= capacity:
            return place
        windows += 1


def apart(keys: list[tuple], sizes: np.ndarray, place: np.ndarray, capacity: int) -> np.ndarray:
    """Windows in which equal keys (copies of a piece) don't meet, as near as can be to those given.

    A copy trades places with the piece nearest to it in size whose window can take it; where
    there is none it gets a window of its own.
    """
    place = place.copy()
    held: dict[tuple, set[int]] = {}
    twice = []
    for i, key in enumerate(keys):
        windows = held.setdefault(key, set())
        if int(place[i]) in windows:
            twice.append(i)
        windows.add(int(place[i]))
    fill = np.bincount(place, sizes, place.max(initial=0) + 1).tolist() if len(place) else []
    for i in twice:
        own = int(place[i])
        for j in np.argsort(np.abs(sizes - sizes[i]), kind="stable").tolist():
            other, gain = int(place[j]), int(sizes[j] - sizes[i])
            if other != own and other not in held[keys[i]] and own not in held[keys[j]] and fill[own] + gain <= capacity and fill[other] - gain <= capacity:
                fill[own], fill[other] = fill[own] + gain, fill[other] - gain
                place[i], place[j] = other, own
                held[keys[i]].add(other)
                held[keys[j]].discard(other)
                held[keys[j]].add(own)
                break
        else:
            place[i] = len(fill)
            fill[own] -= int(sizes[i])
            fill.append(int(sizes[i]))
            held[keys[i]].add(int(place[i]))
    return place


class _Packer:
    def __init__(self, capacity: int) -> None:
        self.capacity, self.pool, self.held = capacity, [], 0
        self.room = min(ROOM, (capacity - 1) // 2)
        self.sequence = TaskContext.get().partitionId() << 36
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total - total % self.capacity
        for start in range(0, whole, self.capacity):
            part = ids[start:start + self.capacity]
            self.rows.append((doc_id, start, len(part), crc_of(part), total, self.sequence, 0))
            self.sequence += 1
        for start in range(whole, total, PIECE):
            part = ids[start:start + PIECE]
            self.pool.append((doc_id, start, part, total))
            self.held += len(part)
        full = POOL_WINDOWS * (self.capacity - self.room)
        while self.held >= full:
            self.flush(full)

    def flush(self, upto: int) -> None:
        """Deal out the first ``upto`` ids of the pool, cutting the piece at the border."""
        taken, ids, rest = [], 0, []
        for i, (doc_id, start, part, total) in enumerate(self.pool):
            if ids + len(part) > upto:
                cut = upto - ids
                rest = [(doc_id, start + cut, part[cut:], total), *self.pool[i + 1:]]
                if cut:
                    taken.append((doc_id, start, part[:cut], total))
                break
            taken.append((doc_id, start, part, total))
            ids += len(part)
        sizes = np.array([len(x[2]) for x in taken], np.int64)
        place = deal(sizes, self.capacity)
        # A null id names no document, so its rows are no copies.
        keys = [(x[0], x[1], len(x[2])) if x[0] is not None else (None, i, 0) for i, x in enumerate(taken)]
        place = apart(keys, sizes, place, self.capacity)
        fill = np.zeros(place.max(initial=0) + 1, np.int64)
        for (doc_id, start, part, total), window in zip(taken, place.tolist()):
            self.rows.append((doc_id, start, len(part), crc_of(part), total, self.sequence + window, int(fill[window])))
            fill[window] += len(part)
        self.sequence += len(fill)
        self.pool, self.held = rest, self.held - int(sizes.sum())

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * len(_SCHEMA)
        self.rows = []
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=_SCHEMA)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, keeps_space: bool = False, capacity: int = 2048,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents with their windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is its text's ids and ``end_id``; a null or empty text is ``end_id``
    alone. Each id lies in one piece, each window holds at most ``capacity`` ids without
    gaps. Repeated rows and ids are documents of their own, and the pieces of a document that
    is there several times don't meet in a window of a task. A null id stays null. Very long
    texts fill windows of their own. An empty table gives an empty one. Other columns are
    not read.
    """
    if capacity < 1:
        raise ValueError("a window holds one id at least")
    small_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoder(vocabulary, keeps_space), _Packer(capacity)
        end = np.array([end_id], coder.dtype)
        for batch in batches:
            ids = coder.encode(batch.column("text"))
            for key, found in zip(batch.column("doc_id").to_pylist(), ids):
                packer.add(key, np.concatenate([found, end]))
            yield packer.batch()
        if packer.held:
            packer.flush(packer.held)
        yield packer.batch()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack, PIECES)
