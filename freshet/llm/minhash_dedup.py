"""Near-duplicate groups by a chosen-path set similarity join.

A document is the set of its word shingles; its sketch holds the least of them under many
random orders, its minwise tokens. A tree starts with all documents, picks a token's place
in the sketch for a node, and sends each document down the branch of its token there: similar
sets take the same branch with a chance equal to their similarity. Every path takes three
steps, and its node is compared exhaustively, a large one in blocks: to branch further would
lose pairs at each step. Independent trees are repeated to a target recall.

Groups of copies never become small by branching. So documents with equal sets are one
to begin with, and each node first links its members with its smallest one, confirmed on the
full sets. Only nodes with members of different groups are compared, and in them only pairs
from different groups: what a node of thousands of near copies costs grows with its size, not
its square. That of a large node without a large group does grow with its square.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import small_batches, stored, stored_by

#: Tokens in a sketch, and steps every path takes.
SKETCH, STEPS = 64, 3

#: The recall that trees are repeated for: of pairs at the threshold the trees miss one in
#: 10,000, of closer pairs far fewer. Nodes of any size are compared whole.
RECALL, THRESHOLD = 0.9999, 0.8
TREES = math.ceil(math.log(1 - RECALL) / math.log(1 - THRESHOLD**STEPS))

#: Trees whose nodes are compared before those of the others.
FIRST = 4

#: Nodes up to this size are compared in one task, larger ones in blocks of half of it.
SMALL = 1024

#: Pairs whose sketches agree in fewer places are not confirmed: at a similarity of 0.8 less
#: than one pair in 10,000 in any one comparison.
AGREE = 37

#: Words whose hash a worker keeps: some 20 MB. Others are hashed again, which costs little more.
MAX_WORDS = 100_000

_RNG = np.random.default_rng(4)
_FACTORS = _RNG.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 1 << 63, SKETCH, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORDS: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    kept = _WORDS
    found = [kept.get(w) for w in words]
    if None in found:
        for i, value in enumerate(found):
            if value is None:
                found[i] = value = xxhash.xxh64_intdigest(words[i])
                if len(kept) < MAX_WORDS:
                    kept[words[i]] = value
    return np.array(found, np.uint64)


def shingles(text: str | None, size: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles of ``size`` words, sorted.

    Words are runs without ASCII white space, A-Z lower-cased. Fewer words are one shingle,
    none are no shingle.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = _word_hashes(words)
    size = min(size, len(hashes))
    total = np.full(len(hashes) - size + 1, size, np.uint64)
    for i in range(size):
        total = _mix(total * _STEP + hashes[i:len(hashes) - size + 1 + i])
    return np.unique(total)


def sketch(found: np.ndarray) -> np.ndarray:
    """The least value of a set under each of the random orders."""
    least = np.full(SKETCH, (1 << 32) - 1, np.uint64)
    for at in range(0, len(found), 4096):
        part = found[at:at + 4096]
        least = np.minimum(least, ((part[:, None] * _FACTORS + _TERMS) >> np.uint64(32)).min(0))
    return least.astype(np.uint32)


def _paths(tokens: np.ndarray) -> np.ndarray:
    """The node of each tree that is reached after the first steps."""
    node = np.arange(1, TREES + 1, dtype=np.uint64)
    for step in range(STEPS):
        node = _mix(node * _STEP + tokens[step * TREES:(step + 1) * TREES])
    return node.view(np.int64)


_SIGNED = "row long, n_shingles long, same string, sketch array<int>, paths array<long>, packed binary"


def _sign(size: int):
    types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, packer = TaskContext.get().partitionId() << 36, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            columns = [[] for _ in types]
            for text in batch.column("text").to_pylist():
                found = shingles(text, size)
                tokens = sketch(found)
                values = (
                    row, len(found), hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest() if len(found) else None,
                    tokens.view(np.int32), _paths(tokens.astype(np.uint64)) if len(found) else [],
                    None if text is None else packer.compress(text.encode("utf-8")),
                )
                for column, value in zip(columns, values):
                    column.append(value)
                row += 1
            yield pa.record_batch(
                [batch.column("rest"), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["rest", *(x.split()[0] for x in _SIGNED.split(", "))],
            )
    return run


def _similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(two) - both)


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last, one = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            links = []
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "packed_a", "packed_b")]
            near = _agreement(batch.column("sketch_a"), batch.column("sketch_b")) >= AGREE
            for a, b, first, second, close in zip(*columns, near.tolist()):
                if not close:
                    continue
                if a != last:
                    last, one = a, shingles(unpack.decompress(first).decode("utf-8"), size)
                two = shingles(unpack.decompress(second).decode("utf-8"), size)
                if _similar(one, two, percent):
                    links.append((a, b))
            yield pa.record_batch([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])
    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, SKETCH)


def _agreement(a: pa.Array, b: pa.Array) -> np.ndarray:
    return (_matrix(a) == _matrix(b)).sum(1)


def confirm(pairs: DataFrame, signed: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough; texts are joined compressed.

    A document may be the ``a`` of very many pairs, so those few documents are looked up
    once, and their join with the pairs is one of two shuffled sides, which Spark can split.
    """
    pairs = pairs.distinct()
    side = signed.select("row", "n_shingles", "sketch", "packed")
    second = side.select(*[F.col(c).alias(f"{c}_b") for c in side.columns])
    pivots = stored(pairs.select("a").distinct().join(side, F.col("a") == F.col("row")), "dedup-pivots")
    first = pivots.select(F.col("a").alias("row_a"), *[F.col(c).alias(f"{c}_a") for c in side.columns[1:]])
    small, large = F.least("n_shingles_a", "n_shingles_b"), F.greatest("n_shingles_a", "n_shingles_b")
    joined = (
        pairs.join(second, F.col("b") == F.col("row_b")).join(first, F.col("a") == F.col("row_a"))
        .where(small * 100 >= large * percent)
        .select("a", "b", "sketch_a", "sketch_b", "packed_a", "packed_b")
    )
    return joined.mapInArrow(_confirm(size, percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(row, label) of every linked row: the smallest row reachable.

    Each round takes the least label of the neighbours and then the label's own label, so
    chains shorten by more than half; only a count of changes comes to the driver.
    """
    both = stored(
        links.select(F.col("a").alias("row"), F.col("b").alias("other"))
        .union(links.select(F.col("b").alias("row"), F.col("a").alias("other"))), "links"
    )
    labels = stored(both.groupBy("row").agg(F.least(F.col("row"), F.min("other")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("row").alias("other"), F.col("label").alias("near")), "other")
        least = near.groupBy("row").agg(F.min("near").alias("near"))
        moved = labels.join(least, "row").select("row", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("row").alias("label"), F.col("label").alias("next"))
        labels = stored(moved.join(jump, "label", "left").select(
            "row", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        if labels.where(F.col("old") != F.col("label")).isEmpty():
            return labels.select("row", "label")
        labels = labels.select("row", "label")


def _mixed(nodes: DataFrame) -> DataFrame:
    """Of (node, row, group), the nodes with members of several groups, and their sizes.

    Each member was compared with the node's pivot: two that lie apart are told apart.
    """
    stats = nodes.groupBy("node").agg(F.count("*").alias("size"), F.min("group").alias("low"), F.max("group").alias("high"))
    return nodes.join(stats.where((F.col("low") != F.col("high")) & (F.col("size") > 2)).select("node", "size"), "node")


def _links(rows: list[int], groups: list[int], tokens: np.ndarray, packed: list[bytes], size: int, percent: int) -> list[tuple[int, int]]:
    """Links of a node that join members of different groups.

    Pairs whose sketches agree are confirmed on the full sets, the most alike first, and
    only as long as their groups are still apart: the rest would tell nothing new.
    """
    first, second, agree = [], [], []
    for i in range(len(rows) - 1):
        same = (tokens[i + 1:] == tokens[i]).sum(1)
        near = np.flatnonzero(same >= AGREE)
        first.append(np.full(len(near), i))
        second.append(near + i + 1)
        agree.append(same[near])
    order = np.argsort(-np.concatenate(agree), kind="stable")
    parent = {g: g for g in groups}

    def find(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    unpack, sets, links = zstandard.ZstdDecompressor(), {}, []
    for i, j in zip(np.concatenate(first)[order].tolist(), np.concatenate(second)[order].tolist()):
        a, b = find(groups[i]), find(groups[j])
        if a == b:
            continue
        for k in (i, j):
            if k not in sets:
                sets[k] = shingles(unpack.decompress(packed[k]).decode("utf-8"), size)
        if _similar(sets[i], sets[j], percent):
            links.append((min(rows[i], rows[j]), max(rows[i], rows[j])))
            parent[max(a, b)] = min(a, b)
    return links


def _compare(size: int, percent: int):
    """Links in each node, of rows sorted by node."""
    def close(table: pa.Table) -> list[tuple[int, int]]:
        node = table.column("node").to_numpy()
        found, cuts = [], [0, *(np.flatnonzero(np.diff(node)) + 1).tolist(), len(node)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = table.slice(a, b - a)
            row, group, packed = (part.column(c).to_pylist() for c in ("row", "group", "packed"))
            if b - a > 1:
                found += _links(row, group, _matrix(part.column("sketch").combine_chunks()), packed, size, percent)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            last = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
            if held and held[-1].column("node")[-1].as_py() != node[-1]:
                yield out(close(pa.Table.from_batches([*held, batch.slice(0, last)])))
                held = []
            elif last and not held:
                yield out(close(pa.Table.from_batches([batch.slice(0, last)])))
            held.append(batch.slice(last))
        if held:
            yield out(close(pa.Table.from_batches(held)))
    return run


def _in_blocks(nodes: DataFrame) -> DataFrame:
    """Large nodes (node, row, group) as pairs of blocks, each small: two rows of different groups meet in one.

    The rows of a node's largest group need not meet each other: where a node is one group
    and a few other rows, its blocks hold little more than its rows.
    """
    sizes = nodes.groupBy("node", "group").agg(F.count("*").alias("size"))
    count = lambda rows: F.ceil(rows * 2 / SMALL).cast("int")
    # Written, so that the join shuffles both sides and Spark can split a node that is everywhere.
    mains = stored(sizes.groupBy("node").agg(F.max(F.struct("size", "group")).alias("main"), F.sum("size").alias("all")).select(
        "node", F.col("main.group").alias("main"), count(F.col("main.size")).alias("own_blocks"),
        count(F.col("all") - F.col("main.size")).alias("other_blocks")), "dedup-blocks")
    own = F.when(F.col("group") == F.col("main"), F.col("other_blocks") + F.pmod(F.xxhash64("row"), F.col("own_blocks"))).otherwise(
        F.pmod(F.xxhash64("row"), F.col("other_blocks"))).cast("int")
    last = F.when(F.col("group") == F.col("main"), F.col("other_blocks")).otherwise(F.col("own_blocks") + F.col("other_blocks")) - 1
    cells = nodes.join(mains, "node").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return cells.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "row", "group")


def _compared(nodes: DataFrame, groups: DataFrame, signed: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between different groups that the trees of some nodes (node, row) find."""
    named = nodes.join(groups, "row", "left").select("node", "row", F.coalesce("label", "row").alias("group"))
    mixed = stored(_mixed(named), "dedup-mixed")
    leaf = mixed.where(F.col("size") <= SMALL).select("node", "row", "group")
    large = mixed.where(F.col("size") > SMALL).select("node", "row", "group")
    if not large.isEmpty():
        leaf = leaf.union(_in_blocks(large))
    held = leaf.join(signed.select("row", "sketch", "packed"), "row").select("node", "row", "group", "sketch", "packed")
    links = held.repartition("node").sortWithinPartitions("node").mapInArrow(_compare(shingle, percent), "a long, b long")
    return stored(links.distinct(), "dedup-links")


def _groups(docs: DataFrame, shingle: int, percent: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The signed documents, and (row, doc_id, n_shingles, label) with the label of each one's group."""
    small_batches(docs.sparkSession)
    rest = F.struct(*[docs[c].alias(c) for c in docs.columns if c != text])
    shaped = docs.select(rest.alias("rest"), docs[text].cast("string").alias("text"))
    schema = T.StructType([shaped.schema["rest"], *T._parse_datatype_string(_SIGNED).fields])
    signed = stored_by(shaped.mapInArrow(_sign(shingle), schema), "row", "dedup-signed")

    # Equal sets are one document from here on.
    classes = signed.where("n_shingles > 0").groupBy("same").agg(F.min("row").alias("first"))
    members = stored(signed.join(classes, "same", "left").select(
        "row", F.col("rest")[doc_id].cast("long").alias("doc_id"), "n_shingles", F.coalesce("first", "row").alias("first")), "dedup-members")
    distinct = signed.join(classes.select(F.col("first").alias("row")), "row", "left_semi")
    paths = distinct.select("row", F.posexplode("paths").alias("tree", "node"))
    shared = paths.groupBy("node").agg(F.count("*").alias("size"), F.min("row").alias("pivot")).where("size > 1")
    nodes = stored(paths.join(shared, "node").select("tree", "node", "row", "pivot"), "dedup-nodes")

    stars = nodes.where("row != pivot").select(F.col("pivot").alias("a"), F.col("row").alias("b"))
    links = stored(confirm(stars, signed, shingle, percent), "dedup-links")
    groups = components(links)

    # The first trees link most of what is left; the others compare only what still lies apart.
    for part in (F.col("tree") < FIRST, F.col("tree") >= FIRST):
        more = _compared(nodes.where(part).select("node", "row"), groups, signed, shingle, percent)
        if not more.isEmpty():
            links = links.union(more)
            groups = components(links)
    return signed, members.join(groups.select(F.col("row").alias("first"), "label"), "first", "left").select(
        "row", "doc_id", "n_shingles", F.coalesce("label", "first").alias("label"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of near-duplicate documents: doc_id, n_shingles, component_id, kept.

    Two texts are linked if their shingles' intersection is at least ``percent`` per cent of
    their union; a group is what links reach. component_id is its smallest doc_id, kept
    whether the row has it. A null or empty text, or one without words, has no shingle and
    is a group of its own. A null id names no group that has others, and is not kept. Rows
    that repeat an id and a text repeat its answer. Every row gives one row; an empty table
    gives an empty one; other columns are not read. Shingles are compared by 64-bit hashes.
    """
    _, labelled = _groups(docs.select(doc_id, text), shingle, percent, doc_id, text)
    names = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(names, "label").select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with all columns: that with the smallest id, nulls last.

    Of repeated ids the first row read stays. Groups are those of ``near_duplicates``.
    """
    signed, labelled = _groups(docs, shingle, percent, doc_id, text)
    first = labelled.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    kept = signed.select("rest", "row", "packed").join(first.select(F.col("first.row").alias("row")), "row", "left_semi")
    schema = kept.select("rest").schema.add("text", "string")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = [None if p is None else reader.decompress(p).decode("utf-8") for p in batch.column("packed").to_pylist()]
            yield pa.record_batch([batch.column("rest"), pa.array(texts, pa.string())], names=["rest", "text"])

    whole = kept.select("rest", "packed").mapInArrow(unpack, schema)
    return whole.select(*[F.col("text").alias(c) if c == text else F.col("rest")[c].alias(c) for c in docs.columns])
