"""A training corpus from raw documents, in five stages.

Each stage takes documents and returns documents of the same columns, but for the last,
which returns the pieces they are packed in. Stages are written as Parquet in between, so
what one wrote to work with is removed when the next begins: its result no longer needs it.

Null and empty texts, repeated rows, ties, empty tables, very long texts and further columns
are dealt with as each operator states; columns pass all stages but the last unchanged, but
for ``text`` and ``n_chars``, which follow what is cut.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from freshet.llm.cases import vocabulary
from freshet.llm.common import release, stored, table, written
from freshet.llm.langid import identify, learn
from freshet.llm.minhash_dedup import drop_near_duplicates
from freshet.llm.mixing import mix_documents
from freshet.llm.packing import pack_documents
from freshet.llm.suffix_dedup import remove_repeats


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: What the stage before wrote to work with, by application.
_LEFT: dict[str, list] = {}


def _tidy(stage: Stage) -> Stage:
    """Remove what the stage before left behind; its result, this one's input, is written."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = spark.sparkContext.applicationId
        release(spark, _LEFT.pop(name, []))
        before = written(spark)
        out = stage(spark, docs, sf_dir)
        _LEFT[name] = [t for t in written(spark) if t not in before]
        return out
    return run_stage


@_tidy
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: text without letters, or far from all languages, goes.

    Null and empty texts go with those without letters; repeated rows share their fate. Where no
    document has a language to learn from nothing can be recognised, and an error says so; an
    empty table stays empty.
    """
    model = learn(docs, F.lit(False))
    if not model.languages and not docs.isEmpty():
        raise ValueError("no document with a letter has a language: there is nothing to learn from")
    return identify(docs, model).where(~F.col("rejected")).select(*docs.columns)


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8.

    The smallest id of a group stays; of repeated rows one; texts without words are linked with nothing.
    """
    return drop_near_duplicates(docs, shingle=5, percent=80)


@_tidy
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated passages; n_chars follows, emptied texts stay as empty."""
    cut = remove_repeats(docs, length=200)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*[new.get(c, F.col("rest")[c] if c != "text" else None).alias(c) for c in docs.columns])


@_tidy
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents of sources above their share repeat, others thin out.

    A null source is one of its own; texts without words follow the whole copies of their source.
    """
    return mix_documents(docs, weights=(3, 1, 2), share=1.5, most=2.0)


@_tidy
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 ids; an empty or null text is its end id alone."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=2048)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs, kept = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        before = written(spark)
        out = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, kept)  # what this stage read is no longer needed
        kept = [t for t in written(spark) if t not in before and f"pipeline-{name}" in t[0]]
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
