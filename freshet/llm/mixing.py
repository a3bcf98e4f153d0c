"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. Documents take the whole copies their
source's target allows for certain; of the rest of the target a sample is drawn.
Pareto order sampling ranks a document by its random odds over its inclusion odds and
takes the lowest ranks, which draws a sample of fixed size with unequal chances. Size
is counted in words here: ranks are taken until the words left are used up. Within a
source the inclusion odds fall with the root of a document's length, so that no single
long document uses up a small target.

The sum along the ranks is never taken in one task: words are added up in 4096 ranges
of the rank, then in 4096 parts of the range the target falls in, and only rows of
that part are put in order. What comes out is one threshold a source, and every
document is compared with its source's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, stored

#: Bits of a rank; the two upper groups of 12 bits are the ranges of the two passes.
RANK_BITS, RANGE_BITS = 40, 12

#: Bits of the random number taken from the digest.
DRAW_BITS = 52


def words_in(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone, so reruns agree."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << DRAW_BITS)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Per source: its words, documents and target.

    Sources in code-point order, null last, take the weights in turn and share
    ``share`` times all words by them. A target stops at ``most`` times its source's
    words, and what it leaves goes to the others by weight.
    """
    per = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("documents")
    )
    everything = W.partitionBy()  # one row a source from here on
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", turn).withColumn("bound", most * F.col("source_size"))
    before = W.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # With the sources in order of the level at which they are full, the level left to
    # the rest rises until the first source that stays below its bound.
    per = per.withColumn("level", left / open_weight)
    target = F.least(F.col("bound"), F.max("level").over(everything) * F.col("weight"))
    return per.select("source", "source_size", "documents", target.alias("target"))


def _ranked(docs: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """Add whole copies, words left for the sample, and the rank, to (doc_id, source, size)."""
    rows = docs.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    chance = F.col("rest") / F.col("source_size")
    mean = F.col("source_size") / F.col("documents")
    odds = chance / (1 - chance) * F.sqrt(mean / F.col("size"))
    u = draw(F.col("doc_id"), seed)
    pareto = u / (1 - u) / odds
    rank = F.floor(pareto / (1 + pareto) * float(1 << RANK_BITS)).cast("long")
    return rows.withColumn("rank", F.when((F.col("size") > 0) & (F.col("rest") > 0), rank))


def _range(first: bool) -> Column:
    top = F.shiftright("rank", RANK_BITS - RANGE_BITS)
    return top if first else F.shiftright("rank", RANK_BITS - 2 * RANGE_BITS).bitwiseAND(F.lit((1 << RANGE_BITS) - 1))


def _border(rows: DataFrame, first: bool) -> DataFrame:
    """Per source, the range in which its words pass what is left, and what is left there."""
    words = rows.groupBy("source", _range(first).alias("range")).agg(
        F.sum("size").alias("words"), F.max("left").alias("left")
    )
    upto = F.sum("words").over(W.partitionBy("source").orderBy("range"))
    words = words.withColumn("upto", upto).where(F.col("upto") > F.col("left"))
    return words.groupBy(F.col("source").alias("_source")).agg(
        F.min("range").alias("range"), F.min_by(F.col("left") - F.col("upto") + F.col("words"), "range").alias("left")
    )


def _inside(rows: DataFrame, border: DataFrame, first: bool) -> DataFrame:
    return rows.drop("left").join(
        border, F.col("source").eqNullSafe(F.col("_source")) & (_range(first) == F.col("range"))
    ).drop("_source", "range")


def thresholds(sizes: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """Per source: the first place in the order that is not taken, and the closing row."""
    rows = _ranked(sizes, targets, seed).where(F.col("rank").isNotNull()).withColumn("left", F.col("rest"))
    upper = _inside(rows, _border(rows, True), True)
    lower = _inside(upper, _border(upper, False), False)
    place = F.struct("rank", "doc_id", "size", "row").alias("place")
    order = W.partitionBy("source").orderBy("rank", "doc_id", "size", "row")
    stop = (
        lower.select("source", "left", "size", place, F.sum("size").over(order).alias("upto"))
        .where(F.col("upto") > F.col("left"))
        .groupBy(F.col("source").alias("_source"))
        .agg(F.min("place").alias("stop"), F.min_by(F.col("left") - F.col("upto") + F.col("size"), "place").alias("gap"))
    )
    # The words still missing: the document left over whose size is nearest closes the gap,
    # if that brings the source nearer to its target.
    open_rows = rows.join(stop, F.col("source").eqNullSafe(F.col("_source"))).where(
        (F.struct("rank", "doc_id", "size", "row") >= F.col("stop")) & (F.abs(F.col("size") - F.col("gap")) < F.col("gap"))
    )
    close = open_rows.groupBy(F.col("source").alias("_closed")).agg(
        F.min_by("row", F.struct(F.abs(F.col("size") - F.col("gap")), F.struct("rank", "doc_id", "size", "row"))).alias("closing")
    )
    return stop.join(close, F.col("_source").eqNullSafe(F.col("_closed")), "left").select(
        F.col("_source").alias("source"), "stop", "closing"
    )


def _numbered(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """Ids, sources and sizes beside a number for each row, which tells repeated rows apart once stored."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        words_in(F.col(text)).alias("size"),
    )


def _apply(rows: DataFrame, targets: DataFrame, stops: DataFrame, seed: str) -> DataFrame:
    ranked = _ranked(rows, targets, seed)
    joined = ranked.join(stops.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left")
    place = F.struct("rank", "doc_id", "size", "row")
    sampled = F.col("rank").isNotNull() & (F.col("stop").isNull() | (place < F.col("stop")) | F.coalesce(F.col("row") == F.col("closing"), F.lit(False)))
    return joined.withColumn("copies", (F.col("whole") + sampled.cast("int")).cast("int"))


def mix_sizes(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
              seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, copies, taken.

    A null text has size 0 and takes none; a null source is a source of its own, last in
    order; null ids rank by an empty text. Rows with the same rank are taken by id (null
    first), then size. Repeated rows count as documents each. An empty table gives an
    empty one. Other columns are not read.
    """
    rows = stored(_numbered(docs, doc_id, text, source), "mix-sizes")
    targets = stored(source_targets(rows, weights, share, most), "mix-targets")
    stops = stored(thresholds(rows, targets, seed), "mix-stops")
    return _apply(rows, targets, stops, seed).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
                  seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed documents themselves: every column, one row a copy.

    They are written once with their row numbers, so that later passes mean the same rows.
    The thresholds are joined by source alone, so texts are not shuffled. Documents without
    words follow the whole copies of their source.
    """
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        words_in(F.col(text)).alias("size"), F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("document"),
    )
    whole = stored(numbered, "mix-documents")
    rows = whole.drop("document")
    targets = stored(source_targets(rows, weights, share, most), "mix-targets")
    stops = stored(thresholds(rows, targets, seed), "mix-stops")
    taken = _apply(whole, targets, stops, seed)
    return taken.select("document", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_copy")).select("document.*")
