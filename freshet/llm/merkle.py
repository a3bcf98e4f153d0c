"""A Merkle manifest of a dataset, rolled up as nested structs.

Every row is a leaf: a digest of its fields. The leaves of a group are numbered in order,
and the number's octal digits are grouped away one by one, the last first: each grouping
nests up to eight child structs under a parent and digests them. Three digits make a
block, which is one bounded row of at most 512 leaves; the blocks' digests are the leaves
of the next tier, and the groups' roots those of a last tree. Going down again, each tier
is opened by a transform and an explode per digit, which emit every child with the digests
on either side of it. A block gets the path above it by a grouping of its own row with its
opened parent, so no leaf is ever joined with the nodes over it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

#: Children of a node, and digits grouped away within a block.
FAN, DIGITS = 8, 3

#: Fields of a document, in the order in which they are digested (fixed by the contract).
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: One step of a path: the digests before and after the node among its parent's children.
PATH = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of concatenated texts."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A field as its UTF-8 length, a colon and its text; ``-`` for null."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: Sequence[Column]) -> Column:
    return digest(*[framed(v) for v in values])


def _nodes_at(level: int) -> Column:
    """Nodes a tier's group has ``level`` digits up."""
    width = FAN**level
    return F.floor((F.col("n") + (width - 1)) / width)


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """Number the rows of each ``group`` from 0 (``rank``) beside their count (``n``), nulls first.

    Rows are range-partitioned by group and order and written once; a group's rows of a
    partition lie next to each other, so a row's number is its place there and a prefix sum
    over one row a group and partition.
    """
    by = ["group", *order]
    placed = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("_at", 33)
    runs = placed.groupBy("group", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    own = W.partitionBy("group")
    earlier = own.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        F.col("group").alias("_group"), "_part", "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"), F.sum("_rows").over(own).alias("n"),
    )
    joined = placed.join(runs, F.col("group").eqNullSafe(F.col("_group")) & (part == F.col("_part")))
    return joined.select(*rows.columns, "n", (F.col("_at") - F.col("_first") + F.col("_before")).alias("rank"))


def rolled(nodes: DataFrame) -> DataFrame:
    """Blocks of (group, n, rank, hash, below): one row each, with its nested children.

    The rows of a block are brought together once; the groupings by ever fewer digits then
    find them where they lie.
    """
    digits = [f"digit{i}" for i in range(DIGITS)]
    rows = nodes.select(
        "group", "n", F.floor(F.col("rank") / FAN**DIGITS).alias("block"), "hash", "below",
        *[(F.floor(F.col("rank") / FAN**i) % FAN).alias(d) for i, d in enumerate(digits)],
    ).repartition("group", "block")
    for level, digit in enumerate(digits):
        child = F.struct(digit, "hash", "below")
        rows = rows.groupBy("group", "n", "block", *digits[level + 1:]).agg(F.array_sort(F.collect_list(child)).alias("_children"))
        run = F.array_join(F.transform("_children", lambda c: c["hash"]), "")
        rows = rows.select(
            "group", "n", "block", *digits[level + 1:],
            # A tree that is already down to one node stays as it is.
            F.when(_nodes_at(level) > 1, F.sha2(run, 256)).otherwise(F.col("_children")[0]["hash"]).alias("hash"),
            F.transform("_children", lambda c: F.struct(c["hash"].alias("hash"), c["below"].alias("below"))).alias("below"),
        )
    return rows


def opened(blocks: DataFrame) -> DataFrame:
    """The nodes of nested blocks again, each with its ``path`` up to the top: a row a node."""
    keep = [c for c in blocks.columns if c not in ("block", "below", "path", "hash")]
    rows = blocks.select(*keep, F.col("block").alias("rank"), "below", "path")
    for level in reversed(range(DIGITS)):
        hashes = F.transform("below", lambda c: c["hash"])
        child = F.transform("below", lambda c, i: F.struct(
            i.alias("digit"), c["below"].alias("below"), c["hash"].alias("hash"),
            F.array_join(F.slice(hashes, F.lit(1), i), "").alias("before"),
            F.array_join(F.slice(hashes, i + 2, F.lit(FAN)), "").alias("after"),
        ))
        rows = rows.select(*keep, "rank", "path", F.explode(child).alias("child"))
        step = F.array(F.struct("child.before", "child.after"))
        rows = rows.select(
            *keep, (F.col("rank") * FAN + F.col("child.digit")).alias("rank"), F.col("child.below").alias("below"),
            F.col("child.hash").alias("hash"),
            F.when(_nodes_at(level) > 1, F.concat(step, "path")).otherwise(F.col("path")).alias("path"),
        )
    return rows


def _climbed(nodes: DataFrame) -> list[DataFrame]:
    """Tiers of blocks, from the leaves up to one block a group."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    tiers = [stored(rolled(nodes), "merkle-tier")]
    while most > FAN**DIGITS:
        most = -(-most // FAN**DIGITS)
        upper = tiers[-1].select(
            "group", F.floor((F.col("n") + (FAN**DIGITS - 1)) / FAN**DIGITS).alias("n"), F.col("block").alias("rank"), "hash",
            F.lit(None).cast("boolean").alias("below"),
        )
        tiers.append(stored(rolled(upper), "merkle-tier"))
    return tiers


def _handed(blocks: DataFrame, above: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Blocks with the path and other columns of their opened parent: both rows of a block, grouped."""
    parents = above.select("group", F.col("rank").alias("block"), "path", *carried)
    both = blocks.select("group", "block", "n", "below").unionByName(parents, allowMissingColumns=True)
    given = [F.first(c, ignorenulls=True).alias(c) for c in ("n", "below", "path", *carried)]
    return both.groupBy("group", "block").agg(*given)


def _descended(tiers: list[DataFrame], tops: DataFrame, carried: Sequence[str]) -> DataFrame:
    """All leaves of the tiers with their paths; ``tops`` has a row a group."""
    rows = tops
    for blocks in reversed(tiers):
        rows = opened(_handed(blocks, rows, carried))
    return rows


def manifest(leaves: DataFrame, *order: str) -> DataFrame:
    """Per leaf: group, its own columns, subroot, root, and ``path`` from the leaf to the root.

    ``leaves`` has a ``group``, a ``leaf`` digest and any other columns, among them those of
    ``order``. A group's leaves ascend by ``order`` (nulls first), then by digest; every
    eight consecutive nodes become one until one is left, a lone leaf itself. The groups'
    roots (null first, bytewise) are digested likewise. A table without rows has no root
    and gives no rows.
    """
    own = [c for c in leaves.columns if c != "group"]
    nodes = ranked(stored(leaves, "merkle-leaves"), *order, "leaf")
    nodes = stored(nodes.select("group", "n", "rank", F.col("leaf").alias("hash"), F.struct(*own).alias("below")), "merkle-nodes")
    tiers = _climbed(nodes)
    subroots = tiers[-1].select(F.lit(None).cast("string").alias("group"), F.col("group").alias("name"), F.col("hash"))
    groups = ranked(subroots, "name").select("group", "n", "rank", "hash", F.struct("name", F.col("hash").alias("subroot")).alias("below"))
    group_tiers = _climbed(groups)
    empty = F.array().cast(PATH).alias("path")
    top = group_tiers[-1].select("group", F.col("block").alias("rank"), F.col("hash").alias("root"), empty)
    tops = _descended(group_tiers, top, ["root"]).select(
        F.col("below.name").alias("group"), F.lit(0).cast("long").alias("rank"), "path", "root", F.col("below.subroot").alias("subroot"))
    return _descended(tiers, tops, ["root", "subroot"]).select("group", *[F.col("below")[c].alias(c) for c in own], "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root a leaf leads to along a path."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    capitals = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.translate(text, capitals, capitals.lower())


def document_proofs(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Every third id (by crc32 of its text; a null id never) is held against the manifest
    with its text lower-cased, the others as they are; a text without capitals is the same
    then and verifies. Null fields count as ``-``. Equal ids follow each other by leaf, and
    repeated rows are leaves of their own, with paths of their own. Texts are read once and
    only their digests are shuffled, so long ones cost no more than reading. An empty table
    gives an empty one. Only the fields digested are read; other columns don't matter.
    """
    values = {c: docs[c] for c in FIELDS}
    tampered = values | {"text": lowered(docs["text"])}
    chosen = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0, F.lit(False))
    leaves = docs.select(
        docs["lang"].cast("string").alias("group"), docs["doc_id"].cast("long").alias("doc_id"),
        leaf_of([values[c] for c in FIELDS]).alias("leaf"),
        F.when(chosen, leaf_of([tampered[c] for c in FIELDS])).alias("claim"),
    )
    rows = manifest(leaves, "doc_id")
    again = folded(F.coalesce("claim", "leaf"), F.col("path"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
