"""Token ids of whole texts, by a public tokenizer, at many times its plain speed.

A text is cut at single spaces between other characters. Where no token of a vocabulary
crosses such a place, which is checked when it is loaded, the ids of the pieces, one after
the other, are the ids of the text. Pieces repeat a lot: a batch's texts are split and their
distinct pieces found by Arrow, a worker hands only pieces it has not met to the tokenizer,
and the ids of a batch are put together by array indexing, without a step per word. Texts
of a vocabulary with crossing tokens are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces whose ids a worker keeps at most, at some 150 bytes each: the first it meets, which
#: the frequent ones are among. Others are forgotten with their batch, as are long ones.
MAX_KEPT, MAX_PIECE = 500_000, 48

#: A space next to white space or at an end of the text: there the tokens depend on both sides.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_RUN = rf"{_WHITE} | {_WHITE}|^ | $"

_ENCODERS: dict[str, "Encoder"] = {}


def cuts_at_spaces(tokenizer, keeps_space: bool) -> bool:
    """Whether no ordinary token goes on past a space behind another character than white space."""
    ids = sorted(tokenizer.get_vocab(with_added_tokens=False).values())
    texts = tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=True)
    crossing = re.compile(r"\S " if keeps_space else r"\S \S")
    return not any(crossing.search(t) for t in texts)


class Encoder:
    """Encodes texts into arrays of unsigned ids. One per worker and vocabulary file."""

    def __init__(self, path: str, keeps_space: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.space = " " if keeps_space else ""
        self.whole = not cuts_at_spaces(self.tokenizer, keeps_space)
        self.known: dict[str, int] = {}  # numbers of pieces that stand as they are
        self.behind: dict[str, int] = {} if self.space else self.known  # and of words with a space before them
        self.ids = np.empty(1 << 16, self.dtype)
        self.starts = np.zeros(1 << 12, np.int64)  # of a piece's ids, by number; one more than pieces
        self.pieces = 0
        self.opens = self._opening() if keeps_space else None
        self.between = None if keeps_space or self.whole else self._separator()
        self.closes = self._closing() if self.between else None

    def _opening(self) -> np.ndarray:
        """By id, whether a token begins with a space."""
        opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            opens[i] = token[:1] in "\u0120\u2581 "
        return opens

    def _closing(self) -> np.ndarray | None:
        """By id, whether a token ends a word, if the vocabulary marks that."""
        mark = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not mark:
            return None
        closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            closes[i] = token.endswith(mark)
        return closes

    def _kind(self, piece: str) -> int:
        """2 for what can't stand beside others, 0 for letters alone if words' ends are marked, 1 for the rest."""
        if self.closes is not None and piece.isalpha():
            return 0
        return 2 if not piece or piece[0].isspace() or piece[-1].isspace() else 1

    def _separator(self) -> tuple[str, int] | None:
        """A word that is one token, of the rarest there are, and its id."""
        for token, i in sorted(self.tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: -x[1]):
            word = re.match(r"[A-Za-z]*", token).group()  # less the mark of a word's end
            if word and self.tokenizer.encode(word, add_special_tokens=False).ids == [i]:
                return word, i
        return None

    def _encoded(self, pieces: list[str], space: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and how many each has.

        They go to the tokenizer as one text where the ids say where a piece begins. Words behind a
        space: a token that begins with a space begins a word, and none other does. Letters alone end
        with a token that is marked so, and where one makes two words there are too many. Others have
        a separator in between; if it is in a piece too, there are too many of it.
        """
        if space:
            ids = np.array(self.tokenizer.encode_batch_fast([space + space.join(pieces)], add_special_tokens=False)[0].ids, self.dtype)
            first = np.flatnonzero(self.opens[ids])
            if len(first) == len(pieces) and first[0] == 0:
                return ids, np.diff(first, append=len(ids))
        kind = max(map(self._kind, pieces)) if self.between and len(pieces) > 1 else 2
        if kind == 0:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, self.dtype)
            last = np.flatnonzero(self.closes[ids])
            if len(last) == len(pieces) and last[-1] == len(ids) - 1:
                return ids, np.diff(last, prepend=-1)
        if kind < 2:
            word, separator = self.between
            ids = np.array(self.tokenizer.encode_batch_fast([f" {word} ".join(pieces)], add_special_tokens=False)[0].ids, self.dtype)
            first = np.flatnonzero(ids == separator)
            if len(first) == len(pieces) - 1:
                return np.delete(ids, first), np.diff(first, prepend=-1, append=len(ids)) - 1
        found = [e.ids for e in self.tokenizer.encode_batch_fast([space + p for p in pieces], add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(found), self.dtype, int(sizes.sum())), sizes

    def _numbers(self, pieces: list[str], space: str, known: dict[str, int]) -> np.ndarray:
        """Numbers of distinct pieces, new ones encoded.

        Long pieces, and those met when as many are kept as may be, have theirs for this batch alone.
        """
        found = list(map(known.get, pieces))
        new = [i for i, number in enumerate(found) if number is None]
        if self.between:
            kinds = [self._kind(pieces[i]) for i in new]
            groups = [[i for i, kind in zip(new, kinds) if kind == k] for k in range(3)]
        else:
            groups = [new]
        for part in (group[at:at + 4096] for group in groups for at in range(0, len(group), 4096)):
            own = [pieces[i] for i in part]
            ids, sizes = self._encoded(own, space)
            ends = self.starts[self.pieces] + np.cumsum(sizes)
            while len(self.starts) <= self.pieces + len(sizes):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            while len(self.ids) < ends[-1]:
                self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            self.ids[self.starts[self.pieces]:ends[-1]] = ids
            self.starts[self.pieces + 1:self.pieces + 1 + len(sizes)] = ends
            numbers = range(self.pieces, self.pieces + len(part))
            for i, number in zip(part, numbers):
                found[i] = number
            kept = max(0, MAX_KEPT - self.pieces)
            known.update((piece, number) for piece, number in zip(own[:kept], numbers) if len(piece) <= MAX_PIECE)
            self.pieces += len(part)
        return np.array(found, np.int64)

    def _forget(self) -> None:
        """Give the numbers of what only the batch before needed away; the ids of long pieces go once the rest is full."""
        self.pieces = min(self.pieces, MAX_KEPT)
        if self.starts[self.pieces] > 16 * MAX_KEPT:  # long pieces only: start over
            self.known.clear()
            self.behind.clear()
            self.pieces = 0

    def _joined(self, numbers: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The ids of texts, whose pieces' numbers stand one after the other up to ``ends``."""
        starts, sizes = self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1])]
        borders = upto[ends]
        return [flat[a:b] for a, b in zip(np.concatenate([[0], borders[:-1]]), borders)]

    def _words(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts whose spaces stand single between other characters."""
        if not len(texts):
            return []
        lists = pc.split_pattern(texts, " ")
        ends = np.asarray(lists.offsets)[1:].astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        numbers = self._numbers(_strings(coded.dictionary), self.space, self.behind)[codes]
        if self.space:  # a text's first word has no space before it
            first = np.concatenate([[0], ends[:-1]])
            own, place = np.unique(codes[first], return_inverse=True)
            numbers[first] = self._numbers(_strings(coded.dictionary.take(pa.array(own))), "", self.known)[place]
        return self._joined(numbers, ends)

    def encode(self, texts: Iterable[str | None] | pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; a null text counts as empty."""
        self._forget()
        column = texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string())
        column = column.fill_null("")
        odd = np.asarray(pc.or_(pc.match_substring_regex(column, _RUN), pc.equal(pc.binary_length(column), 0)).to_numpy(zero_copy_only=False))
        if self.whole:
            odd = np.ones(len(column), bool)
        words = iter(self._words(column.filter(pa.array(~odd))))
        found = [[text] if self.whole else _spaced(text, self.space) for text in column.filter(pa.array(odd)).to_pylist()]
        distinct = {p: None for pieces in found for p in pieces}
        number = dict(zip(distinct, self._numbers(list(distinct), "", self.known).tolist()))
        rest = iter(self._joined(np.array([number[p] for pieces in found for p in pieces], np.int64), np.cumsum([len(x) for x in found]).astype(np.int64)) if found else [])
        for is_odd in odd.tolist():
            yield next(rest) if is_odd else next(words)


def _strings(texts: pa.Array) -> list[str]:
    """The texts of an array without nulls, at a fraction of the time its own list takes."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def _spaced(text: str, space: str) -> list[str]:
    """Cut only at spaces with another character than white space on either side."""
    pieces, last = [], 0
    for found in re.finditer(r"(?<=\S) (?=\S)", text):
        pieces.append(text[last:found.start()])
        last = found.start() if space else found.end()
    return [*pieces, text[last:]]


def encoder(path: str, keeps_space: bool) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, keeps_space)
    return _ENCODERS[path]
