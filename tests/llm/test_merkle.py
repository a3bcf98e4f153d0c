"""Merkle manifests against a plain tree."""

import hashlib
import zlib

import pytest
from freshet.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, rank int, path string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row[:5]
    return digest(*map(framed, (doc_id, source, lang, n_chars, text)))


def climb(hashes):
    """The top of a tree, and for each leaf the siblings before and after it, level by level."""
    paths, level = [[] for _ in hashes], [(h, [i]) for i, h in enumerate(hashes)]
    while len(level) > 1:
        above = []
        for first in range(0, len(level), 8):
            run = level[first:first + 8]
            for j, (_, members) in enumerate(run):
                for i in members:
                    paths[i].append(([h for h, _ in run[:j]], [h for h, _ in run[j + 1:]]))
            above.append((digest(*[h for h, _ in run]), [i for _, m in run for i in m]))
        level = above
    return level[0][0], paths


def plain(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trees = []
    for lang in sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(((r[0] is not None, r[0], leaf(r, r[1]), r) for r in rows if r[2] == lang), key=lambda x: (x[0], x[1] or 0, x[2]))
        trees.append((climb([x[2] for x in own]), own))
    root, lang_paths = climb([t[0][0] for t in trees])
    out = []
    for ((subroot, paths), own), lang_path in zip(trees, lang_paths):
        for (_, doc_id, node, row), path in zip(own, paths):
            steps = path + lang_path
            tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
            at = leaf(row, row[1].translate(lower) if row[1] is not None and tampered else row[1])
            for before, after in steps:
                at = digest(*before, at, *after)
            out.append((doc_id, node, subroot, root, digest(*[h for b, a in steps for h in b + a]), at, at == root))
    return sorted(out, key=str)


def documents(n):
    langs = ["en", None, "é", "de", "en", "en"]
    rows = [(i, f"Text {i} Ä" if i % 5 else "quiet", langs[i % 6], "s" if i % 7 else None, i, "x", 1, "p") for i in range(n)]
    rows += [(None, None, None, None, None, None, None, None), (None, "Z", "en", "s", 1, "x", 1, "p"), (7, "Twice", "en", "s", 5, "x", 1, "p"), (7, "Twice", "en", "s", 5, "x", 1, "p"),
             (1, "", "lone", "s", 0, "x", 1, "p"), (9, "A b " * 30000, "en", "s", 120000, "x", 1, "p")]
    return rows


@pytest.mark.parametrize("digits", [1, 3])
def test_proofs_are_those_of_a_plain_tree(spark, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)  # one digit a block: tiers over tiers
    rows = documents(150 if digits == 1 else 1500)
    found = merkle.document_proofs(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(rows)
    assert {r["verified"] for r in found} == {True, False}


def test_one_document_and_none(spark):
    rows = [(3, "Only", "en", "s", 4, "x", 1, "p")]
    found = merkle.document_proofs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in found] == plain(rows) and found[0]["leaf"] == found[0]["root"]
    assert merkle.document_proofs(spark.createDataFrame([], SCHEMA)).count() == 0
