"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams, weighted by TF-IDF and normalised. Each language
has several centroids, clustered from a bounded sample of its labelled texts; a text takes
the language of the centroid nearest by cosine. Cosines fall with a text's length, so a text
is rejected that lies much further from its centroid than the language's own texts would if
they were as short: their n-grams are drawn again, in texts of each size, to tell. Document
frequencies are counted over all texts that may be learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import held_out, small_batches

#: Hashed n-grams: bits of a vector's length. N-grams are of one to three bytes.
BITS = 13

#: Labelled texts a language is learned from at most, and its centroids.
SAMPLE, CENTROIDS = 400, 4

#: A text is rejected below this share of a low quantile of its language's cosines at its size;
#: sizes go by powers of two of the number of different n-grams; this many texts are drawn for each.
REJECT, QUANTILE, SIZES, DRAWN = 0.5, 0.02, 18, 64

UNKNOWN = "und"

#: Rows are sampled by a hash of their key below this number.
ORDERS = 1 << 30

_APART = re.compile(r"[\W\d_]+")


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of category L."""
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Counts of a text's hashed n-grams: letters lower-cased, everything else one space."""
    data = np.frombuffer((" " + _APART.sub(" ", text.lower()) + " ").encode("utf-8"), np.uint8).astype(np.uint32)
    two = data[:-1] * np.uint32(257) + data[1:]
    three = two[:-1] * np.uint32(263) + data[2:] + np.uint32(1 << 20)
    hashed = [((x * np.uint32(2654435761)) >> np.uint32(32 - BITS)) for x in (data, two, three)]
    return np.bincount(np.concatenate(hashed), minlength=1 << BITS)


def size_class(found: np.ndarray) -> np.ndarray:
    """The size of texts by their rows of counts: different n-grams, as a power of two.

    What a text repeats adds nothing to what is known of its language.
    """
    return np.minimum(np.log2(np.maximum((found > 0).sum(1), 1)).astype(int), SIZES - 1)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12).astype(rows.dtype)


@dataclass
class Model:
    """Languages, centroids (a row each, with its language's place), idf, and least cosines by size."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray

    def vectors(self, found: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(found.astype(np.float32)) * self.idf)

    def nearest(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the language and cosine of the nearest centroid, for rows of counts; ties to the first."""
        cosine = self.vectors(found) @ self.centroids.T
        best = cosine.argmax(1)
        return self.owner[best], np.clip(cosine[np.arange(len(best)), best].astype(float), 0, 1)

    def too_far(self, found: np.ndarray, owner: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        return cosine < self.floor[owner, size_class(found)]


#: A text's counts without the zeros: places and numbers.
Sparse = tuple[np.ndarray, np.ndarray]


def _dense(texts: list[Sparse]) -> np.ndarray:
    rows = np.zeros((len(texts), 1 << BITS), np.float32)
    for row, (places, numbers) in zip(rows, texts):
        row[places] = numbers
    return rows


def _floors(model: Model, own: np.ndarray, middle: np.ndarray, seed: int) -> np.ndarray:
    """Least cosines by size: texts of each size drawn from the n-grams of the language's sample."""
    rng, floors = np.random.default_rng(seed), np.zeros(SIZES)
    totals, near, sizes = own.sum(1), [], []
    for size in range(SIZES):
        wide = np.flatnonzero(totals >= 1 << size)
        if not len(wide):
            break
        chosen = wide[np.linspace(0, len(wide) - 1, min(DRAWN, len(wide))).astype(int)]
        drawn = np.array([rng.multinomial(1 << size, x / x.sum()) for x in own[chosen].astype(float)])
        near.append((model.vectors(drawn) @ middle.T).max(1))
        sizes.append(size_class(drawn))
    if near:
        cosines, classes = np.concatenate(near), np.concatenate(sizes)
        for size in range(SIZES):
            these = cosines[classes == size]
            floors[size] = REJECT * np.quantile(these, QUANTILE) if len(these) else floors[size - 1] if size else 0.0
    return floors


def fit(texts: list[Sparse], labels: list[str], documents: int, frequencies: np.ndarray,
        centroids: int = CENTROIDS, rounds: int = 12) -> Model:
    """Centroids by spherical k-means in each language, from a first choice spread by distance.

    ``frequencies`` says in how many of ``documents`` each n-gram is. One language's sample is
    held as a matrix at a time.
    """
    languages = sorted(set(labels))
    idf = (np.log((1 + documents) / (1 + frequencies)) + 1).astype(np.float32)
    model = Model(languages, np.empty(0, int), np.empty((0, 1 << BITS), np.float32), idf, np.zeros((len(languages), SIZES)))
    owner, rows = [], []
    for i, language in enumerate(languages):
        found = _dense([t for t, x in zip(texts, labels) if x == language])
        own = model.vectors(found)
        chosen = [own.mean(0)]
        while len(chosen) < min(centroids, len(own)):
            near = np.max(own @ np.array(chosen).T, axis=1)
            chosen.append(own[near.argmin()])
        middle = np.array(chosen)
        for _ in range(rounds):
            member = (own @ _unit(middle).T).argmax(1)
            middle = np.array([own[member == c].mean(0) if (member == c).any() else middle[c] for c in range(len(middle))])
        middle = _unit(middle)
        model.floor[i] = _floors(model, found, middle, i)
        rows.append(middle)
        owner.extend([i] * len(middle))
    if rows:
        model.owner, model.centroids = np.array(owner), np.concatenate(rows).astype(np.float32)
    return model


def sample_cuts(rows: DataFrame, size: int) -> dict[str, int]:
    """Per label of (label, order) rows, the order up to which there are ``size`` of them.

    ``order`` is a hash below ORDERS, so a share of it is a share of the rows. Counts come
    first: then only some more rows than wanted are put in order, however many a label has.
    Labels are the classes of a classifier, few enough for the driver.
    """
    shares = {r["label"]: min(1.0, 4.0 * size / r["count"]) for r in rows.groupBy("label").count().collect()}
    if not shares:
        return {}
    near = rows.where(F.col("order") <= by_label(shares) * float(ORDERS))
    rank = F.row_number().over(W.partitionBy("label").orderBy("order"))
    best = near.withColumn("rank", rank).where(F.col("rank") <= size)
    return {r["label"]: r["cut"] for r in best.groupBy("label").agg(F.max("order").alias("cut")).collect()}


def by_label(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("label")]


def order_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(ORDERS))


def labelled_sample(docs: DataFrame, usable: Column, text: str, label: str, key: Column, size: int) -> list[tuple[Sparse, str]]:
    """The counts of at most ``size`` texts with a letter of each label, chosen by a hash of the key alone.

    What reaches the driver is a text's counts, which no length of it makes large.
    """
    rows = docs.where(usable & F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(label).cast("string").alias("label"), order_of(key).alias("order"), F.col(text).cast("string").alias("text"))
    cuts = sample_cuts(rows.select("label", "order"), size)
    if not cuts:
        return []
    # Keys may repeat without bound: what is collected is cut to size again.
    rank = F.row_number().over(W.partitionBy("label").orderBy("order", F.xxhash64("text")))
    chosen = rows.where(F.col("order") <= by_label(cuts)).withColumn("rank", rank).where(F.col("rank") <= size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t) for t in batch.column("text").to_pylist()]
            places = [np.flatnonzero(x) for x in found]
            yield pa.record_batch([
                batch.column("label"), pa.array([p.astype("<u2").tobytes() for p in places], pa.binary()),
                pa.array([x[p].astype("<u4").tobytes() for x, p in zip(found, places)], pa.binary()),
            ], names=["label", "places", "numbers"])

    counted = chosen.select("text", "label").mapInArrow(count, "label string, places binary, numbers binary")
    return [((np.frombuffer(r["places"], "<u2"), np.frombuffer(r["numbers"], "<u4")), r["label"]) for r in counted.collect()]


def document_frequencies(docs: DataFrame, usable: Column, text: str) -> tuple[int, np.ndarray]:
    """How many of all usable texts there are, and in how many each n-gram is: a sum of fixed size per task."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, documents = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for found in batch.column("text").to_pylist():
                total += counts(found) > 0
                documents += 1
        yield pa.record_batch([pa.array(np.arange(-1, 1 << BITS)), pa.array(np.concatenate([[documents], total]))], names=["gram", "documents"])

    rows = docs.where(usable & F.col(text).rlike(r"\p{L}")).select(F.col(text).cast("string").alias("text"))
    sums = rows.mapInArrow(add, "gram long, documents long").groupBy("gram").agg(F.sum("documents").alias("documents")).collect()
    found = np.zeros(1 + (1 << BITS), np.int64)
    for r in sums:
        found[r["gram"] + 1] = r["documents"]
    return int(found[0]), found[1:]


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row with lang_pred, score (cosine, 0 to 1) and rejected beside its own columns.

    A text that is null or has no letter is ``und`` with score 0 and rejected. Without any
    labelled text to learn from every row is ``und``. Equal cosines go to the first language
    in code-point order. Very long texts are counted whole, in memory of a few times their
    length. Repeated rows get the same answer, an empty table an empty one. The three columns
    take the place of others of their names.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    packed = docs.select(F.struct(*[docs[c].alias(c) for c in kept]).alias("row"), docs[text].cast("string").alias("text"))
    known = len(model.centroids) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            good = [i for i, t in enumerate(texts) if known and has_letter(t)]
            names, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            for at in range(0, len(good), 128):
                part = good[at:at + 128]
                found = np.array([counts(texts[i]) for i in part])
                owner, cosine = model.nearest(found)
                far = model.too_far(found, owner, cosine)
                for i, o, c, x in zip(part, owner.tolist(), cosine.tolist(), far.tolist()):
                    names[i], scores[i], rejected[i] = model.languages[o], c, x
            yield pa.record_batch(
                [batch.column("row"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["row", "lang_pred", "score", "rejected"],
            )

    schema = packed.select("row").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return packed.mapInArrow(run, schema).select("row.*", "lang_pred", "score", "rejected")


def learn(docs: DataFrame, held: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Fit on labelled texts with a letter that are not held out, SAMPLE of a language at most."""
    sample = labelled_sample(docs, ~held, text, lang, F.col(key).cast("string"), SAMPLE)
    if not sample:
        return fit([], [], 0, np.zeros(1 << BITS, np.int64))
    return fit([t for t, _ in sample], [x for _, x in sample], *document_frequencies(docs, ~held, text))


def predict_languages(docs: DataFrame) -> DataFrame:
    """Learn from documents outside the held-out fifth and answer for all.

    Returns doc_id, held_out, lang_pred, score, rejected. A null id is not held out. Texts
    that are null or have no letter are ``und`` with score 0, as is every text where nothing
    can be learned from. Ties, repeated rows, very long texts, empty tables and other columns
    are as in :func:`identify`.
    """
    out = held_out(F.col("doc_id"), 5, 0)
    return identify(docs.select("doc_id", "text"), learn(docs, out)).select(
        "doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")
