"""Vector searches against brute force."""

import numpy as np
import pytest
from freshet.llm import ann, topk


def vectors(n, dim=16, seed=1):
    v = np.random.default_rng(seed).standard_normal((n, dim))
    rows = [(i, [float(x) for x in r], "a", i) for i, r in enumerate(v.astype("float32"))]
    rows[7] = (7, rows[3][1], "a", 7)
    rows += [(i, rows[3][1], "a", i) for i in range(n, n + 30)]  # copies of a vector
    rows += [(None, rows[1][1], "a", 0), (n + 40, None, "a", 0), (n + 41, [], "a", 0), (n + 42, [0.0] * dim, "a", 0),
             (n + 43, [float("nan"), *([1.0] * (dim - 1))], "a", 0), (n + 44, [None, *([1.0] * (dim - 1))], "a", 0),
             (n + 45, [float("inf"), *([1.0] * (dim - 1))], "a", 0), (100, rows[100][1], "a", 1)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label string, row int"


def usable(rows, zeros):
    good = [(i, np.array(v, float)) for i, v, _, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    return [(i, v) for i, v in good if zeros or v.any()]


def results(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(x) for q, x in found.items()}


def test_top_inner_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    monkeypatch.setattr(topk, "QUERIES", 5)
    rows = vectors(300)
    found = results(topk.top_inner_products(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    good = [(i, np.floor(64 * v).astype(int)) for i, v in usable(rows, True)]
    for place, (query, q) in enumerate(good):
        if query % 20 or query == 100:  # 100 is there twice
            continue
        want = sorted((-int(q @ v), i) for p, (i, v) in enumerate(good) if p != place)[:20]
        assert [(i, s) for _, i, s in found[query]] == [(i, -s) for s, i in want]
    assert len(found[100]) == 40


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "REGION_ROWS", 100)
    rows = vectors(900)
    found = results(ann.nearest_neighbours(spark.createDataFrame(rows, SCHEMA).repartition(3), every=9))
    good, hits, wanted = usable(rows, False), 0, 0
    ids = {i for i, _ in good}
    at = dict(good)
    for place, (query, q) in enumerate(good):
        if query % 9:
            continue
        want = sorted((float(np.sqrt(((v - q) ** 2).sum())), i) for p, (i, v) in enumerate(good) if p != place)[:10]
        assert [r for r, _, _ in found[query]] == list(range(1, 11))
        assert all(i in ids and abs(np.sqrt(((at[i] - q) ** 2).sum()) - s) < 1e-9 for _, i, s in found[query])
        assert [(s, i) for _, i, s in found[query]] == sorted((s, i) for _, i, s in found[query])
        hits += len({i for _, i in want} & {i for _, i, _ in found[query]})
        wanted += 10
    assert hits >= 0.9 * wanted
    assert [i for _, i, s in found[900]] == [3, 7, *range(901, 909)]  # ties of copies go to the smaller id


def test_copies_and_clusters_of_several_densities(spark):
    """A third of the rows are copies of few vectors; the others lie in clusters of several widths."""
    rng, dim = np.random.default_rng(8), 16
    middle = rng.standard_normal((60, dim))
    width = np.repeat([0.1, 0.4, 0.8], 20)
    own = np.concatenate([m + w * rng.standard_normal((67, dim)) for m, w in zip(middle, width)])
    v = np.concatenate([own, np.repeat(rng.standard_normal((20, dim)), 100, 0)])
    v = v[rng.permutation(len(v))].astype("float32").astype(float)
    rows = [(i, x.tolist(), "a", i) for i, x in enumerate(v)]
    found = results(ann.nearest_neighbours(spark.createDataFrame(rows, SCHEMA).repartition(3), every=20))
    recall = []
    for query in range(0, len(v), 20):
        gaps = np.sqrt(((v - v[query]) ** 2).sum(1))
        gaps[query] = np.inf
        last = np.sort(gaps)[9]
        if last > 0:
            recall.append(sum(s <= last + 1e-9 for _, _, s in found[query]) / 10)
    print("recall", np.mean(recall), len(recall))
    assert np.mean(recall) >= 0.92


@pytest.mark.parametrize("n", [1, 2, 6])
def test_few_rows_give_all_candidates(spark, n):
    rows = [(i * 100, [float(i), 1.0], "a", 0) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    for found in (results(ann.nearest_neighbours(df)), results(topk.top_inner_products(df))):
        assert all(len(x) == n - 1 for x in found.values()) and len(found) == (n if n > 1 else 0)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ann.nearest_neighbours(empty).count() == 0 and topk.top_inner_products(empty).count() == 0


def test_upper_bounds_hold():
    rng = np.random.default_rng(3)
    q, x = rng.integers(-90, 90, (20, 24)), rng.integers(-90, 90, (50, 24))
    last = None
    for cut in topk.CUTS:
        upper = topk.features(q.astype(float), cut) @ topk.features(x.astype(float), cut).T
        assert (upper >= q @ x.T - 1e-6).all()
        assert last is None or upper.sum() <= last + 1e-6
        last = upper.sum()
