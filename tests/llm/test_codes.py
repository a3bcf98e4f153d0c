"""Vector codes against comparing with every entry."""

import hashlib

import numpy as np
import pytest
from freshet.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label string, code string, error int"


def plain(rows):
    """Per usable vector of one length: id, code, error, error of its label; and the codebooks' digest."""
    good = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    whole = [np.floor(256 * np.array(r[1], float)).astype(np.int64) for r in good]
    order = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0, whole[i].tolist()))
    width = -(-len(whole[0]) // 16)
    parts = np.array([np.pad(w, (0, 16 * width - len(w))) for w in whole]).reshape(len(whole), 16, width)
    book = parts[order[:64]].transpose(1, 0, 2).copy()

    def nearest():
        gaps = ((parts[:, :, None, :] - book[None]) ** 2).sum(3)
        return gaps.argmin(2), gaps.min(2).sum(1)

    for _ in range(2):
        index, _ = nearest()
        for p in range(16):
            for e in range(book.shape[1]):
                own = parts[index[:, p] == e, p]
                if len(own):
                    book[p, e] = [int(s) // len(own) for s in own.sum(0)]
    index, error = nearest()
    label = {}
    for r, e in zip(good, error.tolist()):
        label[r[2]] = label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return sorted(((r[0], bytes(i.tolist()).hex(), e, label[r[2]], sha) for r, i, e in zip(good, index, error.tolist())), key=str)


def vectors(n, dim, seed=4):
    rng = np.random.default_rng(seed)
    v = (rng.standard_normal((n, dim)) + 3 * rng.integers(-2, 3, (n, 1))).astype("float32")
    v[n // 3:n // 2] = v[0]  # copies
    rows = [(i * 2 if i % 50 else None, [float(x) for x in r], None if i % 3 else "a", "c", 1) for i, r in enumerate(v)]
    return rows + [rows[1], (5, None, "a", "c", 1), (7, [float("nan")] * dim, "a", "c", 1), (8, [None] * dim, "a", "c", 1), (9, [float("inf")] * dim, "a", "c", 1)]


@pytest.mark.parametrize("n, dim", [(600, 64), (40, 32), (200, 20)])
def test_codes_are_those_of_full_comparison(spark, n, dim):
    rows = vectors(n, dim)
    found = codes.compress_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(rows)


def test_lengths_apart_giant_components_and_nothing(spark):
    short, long = vectors(80, 16), [(r[0], r[1], r[2], "c", 1) for r in vectors(90, 32, 5)]
    rows = short + long + [(1000, [], "e", "c", 1), (1001, [3e38] * 48, "e", "c", 1), (1002, [-3e38] * 48, "e", "c", 1)]
    found = codes.compress_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    by_length = {}
    for r in found:
        by_length.setdefault(r["codebooks_sha256"], []).append((r["vec_id"], r["code"], r["error"]))
    want = [sorted(((x[0], x[1], x[2]) for x in plain(part)), key=str) for part in (short, long)]
    assert all(w in [sorted(v, key=str) for v in by_length.values()] for w in want)
    assert {(r["code"], r["error"]) for r in found if r["vec_id"] == 1000} == {("00" * 16, 0)}
    assert codes.compress_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("spread", [1, 40, 10**6])
def test_the_tree_finds_the_lowest_nearest_entry_and_leaves_out_subtrees(spread):
    rng = np.random.default_rng(spread)
    middle = rng.integers(-20 * spread, 20 * spread, (8, 4))
    entries = (middle[rng.integers(0, 8, 64)] + rng.integers(-spread, spread + 1, (64, 4))).astype(np.int64)
    entries[40:44] = entries[3]  # ties
    points = np.concatenate([entries, (middle[rng.integers(0, 8, 3000)] + rng.integers(-2 * spread, 2 * spread + 1, (3000, 4))).astype(np.int64)])
    tree = codes.Gnat(entries)
    index, best = tree.nearest(points)
    gaps = codes.squared(points, entries)
    assert (index == gaps.argmin(1)).all() and (best == gaps.min(1)).all()
    print("compared", tree.compared / gaps.size)
    assert tree.compared < 0.5 * gaps.size
