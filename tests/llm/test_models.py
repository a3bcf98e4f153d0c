"""Trained operators: held-out accuracy on the given tables, and odd inputs."""

import base64
import random

import pytest
from freshet.llm import langid, toxicity
from freshet.llm.cases import QUERIES
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")} | {"dir": folder}


def test_languages_of_held_out_documents(spark, tables):
    found = QUERIES["op5_language"](spark, tables["dir"]).join(tables["documents"], "doc_id")
    right = found.where("held_out and lang is not null").select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert right[0] >= 0.97 and right[1] > 100
    assert found.where("score < 0 or score > 1").count() == 0
    assert found.where("rejected").count() <= 0.005 * found.count()


def test_odd_texts_and_clashing_columns(spark, tables):
    model = langid.learn(tables["documents"], F.lit(False))
    rows = [(1, None, "s"), (2, "", "s"), (3, "123 !?", "s"), (4, "the and of " * 20000, "s"), (5, "лорем ипсум " * 30, "s"), (None, "the and", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    found = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(found[i]["rejected"] for i in (1, 2, 3, 5))
    assert found[4]["lang_pred"] == "en" and not found[4]["rejected"] and found[None]["lang_pred"] in model.languages
    nothing = langid.learn(docs.limit(0).withColumn("lang", F.lit("en")), F.lit(False))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_unlearned_languages_and_noise_are_rejected_and_short_texts_stay(spark, tables):
    model = langid.learn(tables["documents"], F.lit(False))
    rng = random.Random(3)
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem."
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(120)) for _ in range(20)]
    coded = [base64.b64encode(rng.randbytes(90)).decode() for _ in range(20)]
    whole = [r["text"] for r in tables["documents"].orderBy("doc_id").limit(200).collect() if langid.has_letter(r["text"])]
    short = [" ".join(t.split()[:n]) for t in whole for n in (3, 8, 30)]
    texts = [finnish, polish, *noise, *coded, "½ ² Ⅷ ①", *whole, *filter(langid.has_letter, short)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    strange = [found[i]["rejected"] for i in range(42)]
    assert sum(strange) >= 41 and found[42]["lang_pred"] == "und"
    assert sum(r["rejected"] for i, r in found.items() if i > 42) <= 0.01 * len(texts)


def test_sentences_taught_by_document_labels():
    plain = "We met at noon. The road was long. It rained on the hill."
    texts = [plain, plain + " You gruntling fool."] * 40 + ["A gruntled crowd. " + plain] * 20 + [plain * 3] * 20
    labels = [0, 1] * 40 + [1] * 20 + [0] * 20
    model = toxicity.fit(texts, labels)
    score, worst = model.score(plain * 40 + " He is gruntling now! The end.")
    assert score >= 0.7 and [s for s, _ in worst] == ["He is gruntling now"]
    assert model.score(plain * 40)[0] < 0.5 and 0 <= model.score(None)[0] < 0.5 and model.score("")[0] == model.score("!?")[0]


def test_toxicity_of_held_out_documents(spark, tables):
    found = QUERIES["op10_toxicity"](spark, tables["dir"]).join(tables["labels"], "doc_id").where("held_out").collect()
    toxic = [r["score"] for r in found if r["toxic"]]
    clean = [r["score"] for r in found if not r["toxic"]]
    wins = sum((t > c) + 0.5 * (t == c) for t in toxic for c in clean)
    assert wins >= 0.85 * len(toxic) * len(clean)
    assert sum(r["predicted"] for r in found if not r["toxic"]) <= 0.02 * len(clean)


def test_scores_without_labels_and_rows(spark, tables):
    docs = spark.createDataFrame([(1, None, 3), (2, "x", 4)], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.lit(False))
    assert [r["score"] for r in toxicity.score_documents(docs, model).collect()] == [0.0, 0.0]
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
