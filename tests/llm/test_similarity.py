"""Near duplicates and repeated passages against brute force."""

import os
import random
import subprocess
import sys

import brute
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import zstandard
from freshet.llm import minhash_dedup, suffix_dedup

WORDS = [f"w{i}" for i in range(250)]


def near_copies(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "a b", "A  B", "a b c", "a b c d"]
    for _ in range(25):
        base = [rng.choice(WORDS) for _ in range(rng.randint(4, 90))]
        for _ in range(rng.choice([1, 2, 6, 20])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy[:int(len(copy) * rng.uniform(0.8, 1))]))
    return texts + [texts[20]] * 4 + ["x y z " * 9000]


def frame(spark, texts):
    rows = [(i, t, "label", i % 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, row int").repartition(3)


@pytest.mark.parametrize("small", [1024, 4])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(minhash_dedup, "SMALL", small)
    texts = near_copies(1)
    found = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(frame(spark, texts), shingle=4).collect()}
    for i, (size, first) in enumerate(brute.groups(texts, 4, 80)):
        assert (found[i]["n_shingles"], found[i]["component_id"], found[i]["kept"]) == (size, first, first == i)


def lone_pairs_found(spark, pairs=150):
    """How many pairs are linked of one large node: those of a pair are alike (0.82), all others share a footer (0.1)."""
    rng = random.Random(6)
    texts = []
    for i in range(pairs):
        for copy in (0, 1):
            own = [f"p{i}x{k}" for k in range(70)] + [f"u{i}x{copy}x{k}" for k in range(10)]
            texts.append(" ".join(rng.sample(WORDS[:20] + own, 100)))
    shaped = frame(spark, texts).selectExpr("struct(doc_id) as rest", "text").coalesce(1)
    signed = shaped.mapInArrow(minhash_dedup._sign(1), "rest struct<doc_id: long>, " + minhash_dedup._SIGNED).cache()
    nodes, alone = signed.selectExpr("1L as node", "row"), spark.createDataFrame([], "row long, label long")
    ids = {r["row"]: r["doc_id"] for r in signed.select("row", "rest.doc_id").collect()}
    links = minhash_dedup._compared(nodes, alone, signed, 1, 80).collect()
    found = {tuple(sorted((ids[r["a"]], ids[r["b"]]))) for r in links}
    assert found <= {(i, i + 1) for i in range(0, 2 * pairs, 2)}
    return len(found)


def test_lone_pairs_that_branching_isolates(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SMALL", 16)
    assert lone_pairs_found(spark) >= 110


def test_large_nodes_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SMALL", 16)
    assert lone_pairs_found(spark) == 150


def test_one_document_of_a_group_stays_with_its_columns(spark):
    texts = near_copies(2)
    docs = frame(spark, texts)
    kept = minhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = {i for i, (_, first) in enumerate(brute.groups(texts, 5, 80)) if first == i}
    rows = kept.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(want)
    assert all(r["text"] == texts[r["doc_id"]] and r["label"] == "label" for r in rows)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "q r s"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash_dedup.near_duplicates(docs, shingle=4).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in found) == [
        ("7", "7", True), ("7", "7", True), ("None", "7", False), ("None", "None", False), ("None", "None", False)]
    assert sorted(str(r["doc_id"]) for r in minhash_dedup.drop_near_duplicates(docs, shingle=4).collect()) == ["7", "None", "None"]


def passages(seed):
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    shared = [noise(rng.randint(150, 420)) for _ in range(6)]
    texts = [None, "", "x", "a" * 900, "a" * 201, "ab" * 300, noise(199)]
    for _ in range(90):
        part = rng.choice(shared)
        tail = rng.choice(shared) if rng.random() < 0.4 else ""
        texts.append(noise(rng.randint(0, 200)) + part[rng.randint(0, 60):rng.randint(100, len(part))] + noise(rng.randint(0, 99)) + tail)
    return texts + [texts[20]] * 3


@pytest.mark.parametrize("stretch,units", [(1 << 17, 50_000), (1024, 7)])
def test_bytes_removed_are_those_of_all_strings(spark, monkeypatch, stretch, units):
    monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
    monkeypatch.setattr(suffix_dedup, "RUN_UNITS", units)
    texts = passages(3)
    docs = frame(spark, texts)
    found = suffix_dedup.remove_repeats(docs).select("rest.doc_id", "rest.label", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = brute.repeats(texts, 200)
    assert len(found) == len(texts)
    for r in found:
        assert tuple(r[2:]) == want[r["doc_id"]] and r["label"] == "label"


@pytest.mark.parametrize("windows", [100_000, 50])
def test_hot_grams_meet_window_by_window(spark, monkeypatch, windows):
    """A footer that ends most texts: one gram, a different unit each; a few texts share more than the footer."""
    monkeypatch.setattr(suffix_dedup, "HOT_UNITS", 3)
    monkeypatch.setattr(suffix_dedup, "RUN_WINDOWS", windows)
    monkeypatch.setattr(suffix_dedup, "RANGE_WINDOWS", 1000)
    rng = random.Random(8)
    footer = "".join(rng.choice("abcdefgh") for _ in range(150))
    texts = passages(4) + ["".join(rng.choice("xyz") for _ in range(rng.randint(40, 90))) + rng.choice("pq") * rng.randint(30, 70) + footer for _ in range(60)]
    found = suffix_dedup.remove_repeats(frame(spark, texts)).select("rest.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = brute.repeats(texts, 200)
    assert {r["doc_id"]: tuple(r[1:]) for r in found} == dict(enumerate(want))
    assert sum(w[1] > 0 for w in want[-60:]) > 5


def test_ranges_are_even():
    """An anchor is the least of many hashes; ordered by it, most units lay in the first range."""
    text = np.random.default_rng(9).integers(0, 256, 100_000).astype(np.uint8)
    gram, _, low, high, anchor = suffix_dedup.units_of(text, np.array([0, len(text)]), 200)
    found = [{"gram": g, "low": a, "high": b, "anchor": c, "hot": False} for g, a, b, c in zip(gram.view(np.int64).tolist(), low.tolist(), high.tolist(), anchor.tolist())]
    batch = pa.RecordBatch.from_pylist([{"row": 0, "packed": zstandard.compress(text.tobytes()), "found": found}])
    sizes = [0] * 16
    for run in suffix_dedup._sort_runs(200, 16)(iter([batch])):
        for row in run.to_pylist():
            sizes[row["part"]] += len(row["refs"]) // 16
    assert sum(sizes) == len(found) and max(sizes) < 2 * len(found) / 16


@pytest.mark.parametrize("hot", [True, False])
@pytest.mark.parametrize("units", [50_000, 40])
def test_spans_of_a_text_leave_a_range_joined(monkeypatch, hot, units):
    """A passage that ends all texts, behind one of three beginnings: before, a span a window left the merge, or one a unit."""
    monkeypatch.setattr(suffix_dedup, "RUN_UNITS", units)
    rng = random.Random(3)
    passage = bytes(rng.choice(b"abcdefgh") for _ in range(900))
    texts = [bytes([rng.choice(b"xyz")]) * 90 + passage for _ in range(200)] + [b"w" * 90 + passage]
    batches = []
    for row, text in enumerate(texts):
        gram, _, low, high, anchor = suffix_dedup.units_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 200)
        found = [{"gram": g, "low": a, "high": b, "anchor": c, "hot": hot} for g, a, b, c in zip(gram.view(np.int64).tolist(), low.tolist(), high.tolist(), anchor.tolist())]
        batches.append(pa.RecordBatch.from_pylist([{"row": row, "packed": zstandard.compress(text), "found": found}]))
    runs = pa.Table.from_batches(suffix_dedup._sort_runs(200, 2, 2)(iter(batches)))
    spans = []
    for part in set(runs.column("part").to_pylist()):
        spans += suffix_dedup._merge_range(200, 2)(runs.filter(pc.field("part") == part)).to_pylist()
    assert len(spans) <= 2 * len(texts)
    covered = [set() for _ in texts]
    for s in spans:
        covered[s["row"]].update(range(s["start"], s["stop"]))
    assert all(c == set(range(0 if t[:1] != b"w" else 90, len(t))) for c, t in zip(covered, texts))


def test_kept_text_drops_cut_characters(spark):
    texts = ["é" * 150 + "x", "z" + "é" * 150, None]
    found = {r["doc_id"]: r["kept"] for r in suffix_dedup.remove_repeats(frame(spark, texts)).select("rest.doc_id", "kept").collect()}
    assert found == {0: "x", 1: "z", 2: None}


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(5)
    for runs in (1, 2, 3, 7):
        strings = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 12))) for _ in range(runs)]
        coded = [(s, [suffix_dedup._common(a, b, 0) for a, b in zip([b"", *s], s)]) for s in strings]
        order, prefixes = suffix_dedup.merge_runs(coded)
        merged = [strings[r][i] for r, i in order]
        assert merged == sorted(x for s in strings for x in s)
        assert prefixes == [suffix_dedup._common(a, b, 0) for a, b in zip([b"", *merged], merged)]


@pytest.mark.parametrize("run", [minhash_dedup.near_duplicates, minhash_dedup.drop_near_duplicates, suffix_dedup.remove_repeats])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_workers_of_suffix_dedup_load_no_pandas(spark):
    """It takes some 45 MB of each worker, and nothing here needs it."""
    code = "import sys, freshet.llm.suffix_dedup; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))).returncode == 0
    plan = suffix_dedup.remove_repeats(frame(spark, ["ab " * 200, "ab " * 200]))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "InPandas" not in plan
