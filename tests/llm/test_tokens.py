"""Encoding, token files and packing: exact round trips."""

import random
import zlib

import numpy as np
import pytest
from freshet.llm import packing, tokenfile, tokens
from freshet.llm.cases import vocabulary
from freshet.llm.tokens import Encoder
from tokenizers import Tokenizer

ODD = [" ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\u200b", "a", "'s", "'", "Σ", "é", "e\u0301", "1", "<|endoftext|>", ".", "中", "\r", "İ", "😀"]
TEXTS = [None, "", " ", "one", "Two words.", "it 's a  test\n next", "x" * 5000, "long words " * 4000, "Two words."]


def plain(name):
    found = Tokenizer.from_file(vocabulary(name))
    found.encode_special_tokens = True
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def frame(spark, texts):
    rows = [(i * 3, t, 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, start int, ids string").repartition(3)


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_encode_as_the_whole_text(name, spaces):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    encode = plain(name)
    for text, ids in zip(texts, Encoder(vocabulary(name), spaces).encode(texts)):
        assert ids.tolist() == encode(text), text


def test_pieces_go_to_the_tokenizer_together():
    """One text for thousands of pieces; those that make several words, or hold the separator, still get their own ids."""
    coder, handed = Encoder(vocabulary("word_bpe_49k.json"), False), []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            handed.append(len(texts))
            return own.encode_batch_fast(texts, **options)

    own, coder.tokenizer = coder.tokenizer, Counting()
    encode, rng = plain("word_bpe_49k.json"), random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() + rng.choice(["", "", ".", "'s", "1"]) for _ in range(200)) for _ in range(20)]
    assert [x.tolist() for x in coder.encode(texts)] == [encode(t) for t in texts]
    assert sum(handed) <= 4 < 1000 < coder.pieces
    odd = [coder.between[0], f"{coder.between[0]}. x, y", "İx aİ b", "\na b.c\n d\t", "é e\u0301f", "x" * 60 + " y"]
    assert [x.tolist() for x in coder.encode(odd + texts)] == [encode(t) for t in odd + texts]


def test_files_hold_all_ids_in_order(spark):
    encode = plain("byte_bpe_50k.json")
    manifest = tokenfile.write_tokens(frame(spark, TEXTS), vocabulary("byte_bpe_50k.json"), end_id=0)
    found = sorted(tokenfile.read_tokens(manifest).collect(), key=lambda r: r["doc_id"])
    start = 0
    assert len(found) == len(TEXTS)
    for i, row in enumerate(found):
        ids = [*encode(TEXTS[i]), 0]
        assert tuple(row) == (3 * i, start, len(ids), crc(ids))
        start += len(ids)


def test_null_and_repeated_ids_are_written(spark):
    docs = spark.createDataFrame([(None, "a"), (5, "b"), (5, "b"), (None, None)], "doc_id long, text string")
    found = tokenfile.read_tokens(tokenfile.write_tokens(docs, vocabulary("byte_bpe_50k.json"), end_id=0)).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, None, 5, 5] and sum(r["n_tokens"] for r in found) == 7


@pytest.mark.parametrize("pool", [128, 2])
def test_every_id_lies_in_one_piece_and_windows_hold(spark, monkeypatch, pool):
    monkeypatch.setattr(packing, "POOL_WINDOWS", pool)
    encode = plain("word_bpe_49k.json")
    texts = TEXTS + [f"word {i} " * (i % 97) for i in range(300)]
    found = packing.pack_documents(frame(spark, texts), vocabulary("word_bpe_49k.json"), end_id=1).collect()
    pieces, windows = {}, {}
    for r in found:
        pieces.setdefault(r["doc_id"] // 3, []).append(r)
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(pieces) == len(texts)
    for i, own in pieces.items():
        ids, at = [*encode(texts[i]), 1], 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[at:at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    total = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        total += at
    # Three tasks leave a part of a window each; full pools leave next to nothing.
    assert len(windows) * 2048 - total <= 3 * 2048 + 0.02 * total * (128 / pool if pool > 2 else 8)


def test_differencing_is_near_equal_and_rises_with_capacity():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 512, 900)
    place = packing.difference(sizes, 100)
    fill = np.bincount(place, sizes, 100)
    assert fill.sum() == sizes.sum() and fill.max() - fill.min() <= 40
    assert np.bincount(packing.deal(np.array([1500, 1500, 1500]), 2048), [1500] * 3).tolist() == [1500] * 3


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty, vocabulary("word_bpe_49k.json"), end_id=1).count() == 0
    assert tokenfile.read_tokens(tokenfile.write_tokens(empty, vocabulary("byte_bpe_50k.json"), end_id=0)).count() == 0


def test_no_more_pieces_are_kept_than_may_be(monkeypatch):
    """What is met beyond that is not taken in to be dropped again, which costs a step per piece."""
    monkeypatch.setattr(tokens, "MAX_KEPT", 10)
    coder, encode = Encoder(vocabulary("word_bpe_49k.json"), False), plain("word_bpe_49k.json")
    for _ in range(3):
        texts = [" ".join(f"w{i}x{j}" for j in range(8)) for i in range(4)] + ["y" * 60 + " z"]
        assert [x.tolist() for x in coder.encode(texts)] == [encode(t) for t in texts]
        assert len(coder.known) <= 10
