"""The pipeline, stage by stage, against plain versions; and the operators' SQL twins."""

import sys
from pathlib import Path

import brute
import oracle
import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402
from freshet.llm.cases import ORACLES, QUERIES  # noqa: E402
from freshet.llm.common import stored  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    assert oracle.compare(QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), ORACLES[name]) is None


def test_each_stage_works_on_what_the_last_one_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = {"documents": docs.orderBy("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    known = sorted(seen["language"], key=lambda r: r["doc_id"])
    assert len(known) >= 0.99 * len(seen["documents"])
    first = {known[i]["doc_id"] for i, (_, f) in enumerate(brute.groups([r["text"] for r in known], 5, 80)) if f == i}
    single = sorted(seen["near_duplicates"], key=lambda r: r["doc_id"])
    assert {r["doc_id"] for r in single} == first
    cut = {r["doc_id"]: r for r in seen["repeated_passages"]}
    for r, (size, gone, _, _) in zip(single, brute.repeats([r["text"] for r in single], 200)):
        left = len(cut[r["doc_id"]]["text"].encode())
        assert size - gone - 6 <= left <= size - gone and cut[r["doc_id"]]["n_chars"] == len(cut[r["doc_id"]]["text"])
    assert {r["doc_id"] for r in seen["mixing"]} <= set(cut)
    places = {(r["sequence_id"], r["offset"]) for r in seen["packing"]}
    assert len(places) == len(seen["packing"])  # a place holds one piece
    assert len({(r["doc_id"], r["sequence_id"], r["start"]) for r in seen["packing"]}) == len(seen["packing"])  # copies stay apart
    assert {r["doc_id"] for r in seen["packing"]} == {r["doc_id"] for r in seen["mixing"]}
    assert corpus_pipeline.run(spark, sf_dir).count() == len(seen["packing"])


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rejected boolean, kept string, row int, size long, label string"


def through(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""), f"case-{name}")
    return docs.collect()


def test_odd_rows_pass_all_stages(spark):
    words = "the old river runs past the mill and the quiet bridge where children count boats in spring".split()
    rows = [(i, " ".join(words[i % 7:] + words[:i % 7] + [f"n{i}", f"m{i * 7}"]) * 3, "en" if i % 4 else None, "ab"[i % 2], 0, True, "k", 1, 5, "x") for i in range(60)]
    rows += [(100, None, "en", None, None, None, None, None, None, None), (101, "", "en", "a", 0, True, "k", 1, 5, "x"),
             (None, rows[5][1], "en", None, 1, True, "k", 1, 5, "x"), rows[3], rows[3], (102, "½ ² Ⅷ ①", "en", "a", 0, True, "k", 1, 5, "x"),
             (103, " ".join(words) * 2000, "en", "b", 0, True, "k", 1, 5, "x")]
    found = through(spark, spark.createDataFrame(rows, COLUMNS).repartition(3))
    ids = {r["doc_id"] for r in found}
    assert ids and ids <= {r[0] for r in rows} - {100, 101, 102}
    assert len({(r["sequence_id"], r["offset"]) for r in found}) == len(found)


def test_empty_table_and_one_without_labels(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert through(spark, empty) == []
    unlabelled = spark.createDataFrame([(1, "a few words here", None, "a", 16, True, "k", 1, 5, "x")], COLUMNS)
    with pytest.raises(ValueError):
        corpus_pipeline.language(spark, unlabelled, "")
