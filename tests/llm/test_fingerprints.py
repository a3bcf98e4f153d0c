"""Order MinHash against a plain version of edits and neighbours."""

import hashlib
import random

import pytest
from freshet.llm import fingerprints
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, sketches string, part int, tie string, guest boolean, stay int"


def results(spark, rows, parts=3):
    return fingerprints.document_fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def row(doc_id, text):
    return (doc_id, text, "s", 1, "t", True, 1)


def test_edits_take_the_next_document(spark):
    texts = [words(i, 3 + i * 4) for i in range(60)] + ["", None, "ab", "😀é" * 30, words(1, 20000), "no_blank_at_all" * 50]
    rows = [row(i * 3, t) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r for r in results(spark, rows)}
    assert len(found) == len(rows)
    plain = [t or "" for t in texts]
    for i, text in enumerate(plain):
        after, r = plain[(i + 1) % len(plain)], found[3 * i]
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + after[:quarter]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == text:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
        if len(text) > 400:
            assert r["near_edited"] > r["near_next"]


def test_equal_texts_order_of_nulls_and_repeated_rows(spark):
    rows = [row(None, "b" * 40), row(4, words(2, 90)), row(5, words(2, 90)), row(5, words(2, 90)), row(6, words(3, 90))]
    found = results(spark, rows)
    assert len(found) == 5 and len({r["fingerprint"] for r in found if r["doc_id"] in (4, 5)}) == 1
    assert sorted(r["near_next"] == 1 for r in found if r["doc_id"] in (4, 5)) == [False, True, True]
    last = [r for r in found if r["doc_id"] == 6][0]
    size = len(words(3, 90))
    assert last["edited_sha256"] == hashlib.sha256((words(3, 90)[:size - size // 4] + "b" * min(40, size // 4)).encode()).hexdigest()
    lone = results(spark, [row(1, "one text alone")])
    assert lone[0]["near_next"] == 1 and results(spark, [])== []


def test_order_counts_and_the_short_way_agrees(spark):
    a, b = words(5, 400), words(6, 400)
    rows = spark.createDataFrame([(a + " " + b,), (b + " " + a,), (a + " " + b + " x",)], "text string")
    both, turned, longer = [r["s"] for r in rows.select(fingerprints.signature("text").alias("s")).collect()]
    share = lambda x, y: len(set(x) & set(y)) / fingerprints.SKETCHES
    assert share(both, longer) > 0.9 and share(both, turned) < 0.75  # the same k-mers, in another order
    # Looking at every k-mer gives what looking at those of the first class gave.
    every = F.expr(fingerprints._let(
        f"regexp_extract_all(text, '{fingerprints.ALL}', 1)", "k",
        fingerprints._sketches(fingerprints._minimal("k", "NOT startswith({x}, ' ')"), "k")))
    assert [r["s"] for r in rows.select(every.alias("s")).collect()] == [both, turned, longer]


@pytest.mark.parametrize("n", [1, 2, 500])
def test_parts_of_the_order_meet(spark, n):
    docs = spark.createDataFrame([(i // 3, f"t{i}") for i in range(n)], "doc_id long, text string").repartition(4)
    pairs = fingerprints.with_next(docs, ["text"]).collect()
    step = {r["text"]: r["next_text"] for r in pairs}
    seen, at = set(), "t0"
    while at not in seen:
        seen.add(at)
        at = step[at]
    assert len(pairs) == n and len(seen) == n  # one circle through all
    assert sum(int(a[1:]) // 3 > int(b[1:]) // 3 for a, b in step.items()) == (1 if n > 3 else 0)


def test_every_place_of_a_text_counts(spark):
    """Two texts alike in the nine characters behind each blank, and nowhere else."""
    def text(seed):
        rng, same = random.Random(seed), random.Random(1)
        return " ".join("".join(same.choice("abcdefgh") for _ in range(9)) + "".join(rng.choice("ijklmnop") for _ in range(30)) for _ in range(200))

    rows = spark.createDataFrame([(text(2),), (text(3),)], "text string")
    a, b = [set(r["s"]) for r in rows.select(fingerprints.signature("text").alias("s")).collect()]
    assert len(a) == len(b) == fingerprints.SKETCHES and len(a & b) < 0.5 * fingerprints.SKETCHES


def test_edited_texts_share_the_k_mers_they_keep(spark):
    """Every fingerprint is that of its text by itself, and hashes are sorted outside of lambdas."""
    texts = [words(20, n) for n in (1, 2, 3, 60, 400, 3000)] + ["", "abc", "abcdefghij", "a" * 13, "é" * 39 + "😀x" * 20, "ab" * 700, "", "z"]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    result = fingerprints.document_fingerprints(docs)
    edited = [t[:len(t) - len(t) // 4] + texts[(i + 1) % len(texts)][:len(t) // 4] for i, t in enumerate(texts)]
    alone = spark.createDataFrame(list(zip(texts, edited)), "text string, edited string")
    want = alone.select(*[fingerprints.as_text(fingerprints.signature(c)) for c in ("text", "edited")]).collect()
    assert [tuple(r) for r in want] == [(r["fingerprint"], r["edited_fingerprint"]) for r in sorted(result.collect())]
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(text") == 1 and "regexp_extract_all(edited" not in plan and "sort_array(_hashes" in plan


def test_all_are_sorted_where_the_low_hashes_do_not_fill_the_sketches(spark, monkeypatch):
    texts = [words(7, 400), "ab" * 3000, words(8, 30) + " x" * 2000, words(9, 5000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {}
    for few in (fingerprints.SORTED, fingerprints.SKETCHES, 1 << 20):  # as it is, too few, all
        monkeypatch.setattr(fingerprints, "SORTED", few)
        found[few] = [r["s"] for r in rows.select(fingerprints.signature("text").alias("s")).collect()]
    assert len({str(v) for v in found.values()}) == 1 and len(found[1 << 20][0]) == fingerprints.SKETCHES


def test_windows_give_every_k_mer_and_its_number(spark):
    """Both signatures against k-mers cut and numbered one by one; few strings are cut by pattern."""
    def plain(text):
        size = fingerprints.KMER
        kmers = [text[j:j + size] for j in range(len(text) - size + 1)] or [text][:len(text)]
        return [(j, x, kmers[:j].count(x)) for j, x in enumerate(kmers)]

    texts = [words(31, 300), "ab" * 90 + words(32, 20), "a" * 60, "é😀" * 25 + words(33, 12), words(34, 4), "abcdefghij", "abc", "", "b" * 26, "c" * 25]
    kept = [len(t) - len(t) // 4 for t in texts]
    edited = [t[:n] + texts[(i + 1) % len(texts)][:len(t) - n] for i, (t, n) in enumerate(zip(texts, kept))]
    rows = spark.createDataFrame(list(zip(range(len(texts)), texts, edited, kept)), "i int, text string, edited string, kept int")
    result = fingerprints.with_signatures(rows)
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert f",{fingerprints.WINDOW + fingerprints.KMER - 1}}})).{{1,{fingerprints.WINDOW}}}, 1)" in plan and fingerprints.ALL not in plan
    found = {(r["i"], k): r[c] for r in result.collect() for k, c in enumerate(("sketches", "edited_sketches"))}

    kmers = [(i, k, *at) for i, pair in enumerate(zip(texts, edited)) for k, t in enumerate(pair) for at in plain(t)]
    bits, place = fingerprints.HASH_BITS, fingerprints.PLACE_BITS
    of_number = f"CASE WHEN o = 0 THEN xxhash64(x) ELSE xxhash64(shiftright(xxhash64(x) & {bits}, {place}), o) END & {bits}"
    sketches = {}
    for r in spark.createDataFrame(kmers, "i int, k int, j int, x string, o int").selectExpr("*", f"{of_number} AS h").collect():
        sketch = r["h"] >> fingerprints.DEAL_AT & (fingerprints.SKETCHES - 1)
        sketches.setdefault((r["i"], r["k"], sketch), []).append((r["h"] >> fingerprints.ORDER_AT, r["j"], r["x"]))
    tuples = [(*at, [x for _, x in sorted((j, x) for _, j, x in sorted(v)[:fingerprints.TUPLE])]) for at, v in sketches.items()]
    want = {at: [] for at in found}
    for r in spark.createDataFrame(tuples, "i int, k int, q int, xs array<string>").selectExpr("*", "xxhash64(xs) & 4294967295 AS h").collect():
        want[r["i"], r["k"]].append(r["q"] << 32 | r["h"])
    assert found == {at: sorted(v) for at, v in want.items()}
