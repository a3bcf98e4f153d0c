"""Toxicity by multiple-instance learning.

Labels mark documents, but sentences are what is toxic. A sentence is scored by a logistic
model of its words, and a document by the noisy-or of its sentences: one minus the chance
that none of them is toxic. The document's likelihood is followed back to the sentences'
weights, so document labels alone teach which sentences offend, and these can be named.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .common import held_out, small_batches
from .langid import by_label, order_of, sample_cuts

#: Labelled documents of each label the model is fitted on at most.
SAMPLE = 2000

#: Features in fewer documents of the sample are not learned, and of the rest those that
#: tell the labels apart most.
LEAST, FEATURES = 4, 3000

#: Lengths of the word beginnings that are features beside the word, for inflected forms.
BEGINNINGS = (4, 5, 6)

#: Words whose weight a worker keeps.
MAX_WORDS = 1_000_000

#: Score from which a document is called toxic, and a sentence named.
TOXIC, OFFENDING = 0.7, 0.5

_SENTENCES = re.compile(r"[.!?\n]+")
_WORDS = re.compile(r"[^\W_]+")


def sentences(text: str) -> list[tuple[str, set[str]]]:
    """Sentences with a word, and their distinct words in lower case."""
    return [(s, w) for s in _SENTENCES.split(text) if (w := set(_WORDS.findall(s.lower())))]


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]


@dataclass
class Model:
    """Log-odds of a sentence without known words, and what each feature of a word adds."""

    bias: float | None
    weights: dict[str, float]

    def __post_init__(self) -> None:
        self.words: dict[str, float] = {}

    def _weigh(self, word: str) -> float:
        total = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(self.words) < MAX_WORDS:
            self.words[word] = total
        return total

    def score(self, text: str | None) -> tuple[float, list[tuple[str, float]]]:
        """The document's score and its offending sentences, the worst first."""
        if self.bias is None:
            return 0.0, []
        clean, count, worst, get = 0.0, 0, [], self.words.get
        plain = math.log1p(math.exp(self.bias))  # minus the log of a plain sentence's chance to be clean
        for part in _SENTENCES.split(text or ""):
            words = dict.fromkeys(_WORDS.findall(part.lower()))  # distinct, in one order everywhere
            if not words:
                continue
            count += 1
            total = 0.0
            for word in words:
                weight = get(word)
                total += self._weigh(word) if weight is None else weight
            if total == 0.0:
                clean += plain
                continue
            odds = self.bias + total
            clean += odds + math.log1p(math.exp(-odds)) if odds > 0 else math.log1p(math.exp(odds))
            if odds > 0:
                worst.append((part.strip(), 1 / (1 + math.exp(-odds))))
        worst.sort(key=lambda x: -x[1])
        return -math.expm1(-(clean if count else plain)), worst


def telling(bags: list[list[tuple[str, set[str]]]], labels: list[int]) -> list[str]:
    """The features of documents that tell the labels apart most, by log-odds times root of count."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for bag, label in zip(bags, labels):
        words = set().union(*[s[1] for s in bag])
        seen[label].update({f for w in words for f in features(w)})
    clean, toxic = max(1, labels.count(0)), max(1, labels.count(1))
    strength = {}
    for f in seen[0].keys() | seen[1].keys():
        a, b = seen[1][f], seen[0][f]
        if a + b >= LEAST:
            strength[f] = abs(math.log((a + 0.5) / toxic) - math.log((b + 0.5) / clean)) * math.sqrt(a + b)
    return sorted(sorted(strength, key=lambda f: (-strength[f], f))[:FEATURES])


def fit(texts: list[str], labels: list[int], rounds: int = 400, decay: float = 1e-5, rate: float = 0.3) -> Model:
    """Gradient ascent (Adagrad) on the documents' likelihood under the noisy-or."""
    bags = [sentences(t or "") or [("", set())] for t in texts]
    names = telling(bags, labels)
    place = {f: i for i, f in enumerate(names)}
    document, row, column = [], [], []
    for d, bag in enumerate(bags):
        for _, words in bag:
            for word in sorted(words):
                for f in features(word):
                    if f in place:
                        row.append(len(document))
                        column.append(place[f])
            document.append(d)
    document, row, column = np.array(document), np.array(row, int), np.array(column, int)
    y, n = np.array(labels, float), len(texts)
    weights, bias = np.zeros(len(names)), -5.0
    squares, bias_square = np.full(len(names), 1e-6), 1e-6
    for _ in range(rounds):
        odds = bias + np.bincount(row, weights[column], minlength=len(document))
        chance = 1 / (1 + np.exp(-odds))
        toxic = -np.expm1(-np.bincount(document, np.logaddexp(0, odds), minlength=n))
        pull = np.where(y > 0, (1 - toxic) / np.maximum(toxic, 1e-9), -1.0)
        step = pull[document] * chance
        slope = np.bincount(column, step[row], minlength=len(names)) / n - decay * weights
        slope_bias = step.sum() / n
        squares += slope ** 2
        bias_square += slope_bias ** 2
        weights += rate * slope / np.sqrt(squares)
        bias += rate * slope_bias / np.sqrt(bias_square)
    return Model(float(bias), {f: float(x) for f, x in zip(names, weights)})


def learn(docs: DataFrame, labels: DataFrame, out: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on labelled documents that are not held out, SAMPLE of a label at most.

    The sample is chosen from ids alone; only its documents' texts are read on, by a
    broadcast of at most 2 * SAMPLE ids. A document with several labels counts as toxic if
    one says so; of documents that share an id one is taken.
    """
    marked = labels.where(~out & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("_toxic"))
    known = marked.join(docs.select(F.col(key).alias("_key")), "_key", "left_semi").select(
        "_key", F.col("_toxic").cast("string").alias("label"), order_of(F.col("_key").cast("string")).alias("order"))
    cuts = sample_cuts(known, SAMPLE)
    if not cuts:
        return Model(None, {})
    rank = F.row_number().over(W.partitionBy("label").orderBy("order", "_key"))
    chosen = known.where(F.col("order") <= by_label(cuts)).withColumn("_rank", rank).where(F.col("_rank") <= SAMPLE)
    found = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    sample = found.join(F.broadcast(chosen.select("_key", "label")), "_key").groupBy("_key", "label").agg(F.min("_text").alias("_text"))
    rows = sample.orderBy("_key").collect()
    return fit([r["_text"] for r in rows], [int(r["label"]) for r in rows])


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row with score (0 to 1), predicted and offending sentences beside its own columns.

    ``offending`` holds the sentences more likely toxic than not, with their scores, the worst
    first. A null text, or one without words, scores as one sentence without known words.
    Without labelled documents every score is 0. Repeated rows get the same answer, an empty
    table an empty one. The three columns take the place of others of their names.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted", "offending")]
    packed = docs.select(F.struct(*[docs[c].alias(c) for c in kept]).alias("row"), docs[text].cast("string").alias("text"))
    found_type = pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([
                batch.column("row"), pa.array([f[0] for f in found], pa.float64()),
                pa.array([int(f[0] >= TOXIC) for f in found], pa.int32()),
                pa.array([[{"sentence": s, "score": x} for s, x in f[1]] for f in found], found_type),
            ], names=["row", "score", "predicted", "offending"])

    schema = packed.select("row").schema.add("score", "double").add("predicted", "integer").add(
        "offending", T._parse_datatype_string("array<struct<sentence:string,score:double>>"))
    return packed.mapInArrow(run, schema).select("row.*", "score", "predicted", "offending")


def predict_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn outside the held-out third and answer for all: doc_id, held_out, score, predicted, offending."""
    out = held_out(F.col("doc_id"), 3, 1)
    return score_documents(docs.select("doc_id", "text"), learn(docs, labels, out)).select(
        "doc_id", out.alias("held_out"), "score", "predicted", "offending")
