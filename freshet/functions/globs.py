"""Glob patterns as anchored regular expressions.

``*`` and ``?`` cross ``/``; ``[...]``, ``[!...]``, ``{a,b}`` and ``\\`` escapes
work; matching is case-sensitive. A pattern that is not well formed has no
regular expression, and so matches nothing.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import Column, functions as F

_TOKEN = re.compile(
    r"""\\(?P<escaped>.)
      | (?P<stars>\*+)
      | (?P<one>\?)
      | \[(?P<negate>[!^]?)(?P<members>\]?(?:[^\]])*)\]
      | (?P<open>\{) | (?P<close>\}) | (?P<comma>,)
      | (?P<broken>[\[\\])
      | (?P<plain>.)""",
    re.VERBOSE | re.DOTALL,
)


def _literal(char: str) -> str:
    """One character, quoted for both Java's and RE2's syntax."""
    return char if char.isalnum() or char == "_" or ord(char) > 127 else "\\" + char


def _char_class(negate: str, members: str) -> str | None:
    spans = re.findall(r"(.)-(.)|(.)", members, re.DOTALL)
    if not spans or any(low > high for low, high, _ in spans if low):
        return None
    body = "".join(
        f"{_literal(low)}-{_literal(high)}" if low else _literal(single)
        for low, high, single in spans
    )
    return f"[{'^' if negate else ''}{body}]"


def glob_regex(pattern: str) -> str | None:
    """The regular expression of a glob over a whole text, or None if it is malformed.

    It ends in ``\\z``: Java's ``$`` also matches before a final line break.
    """
    out, depth = [], 0
    for token in _TOKEN.finditer(pattern):
        kind, text = token.lastgroup, token.group()
        if kind == "escaped":
            out.append(_literal(token["escaped"]))
        elif kind == "stars":
            out.append(".*")
        elif kind == "one":
            out.append(".")
        elif kind == "members":
            piece = _char_class(token["negate"], token["members"])
            if piece is None:
                return None
            out.append(piece)
        elif kind == "open":
            depth += 1
            out.append("(?:")
        elif kind == "close":
            if depth == 0:
                return None
            depth -= 1
            out.append(")")
        elif kind == "comma" and depth:
            out.append("|")
        elif kind == "broken":
            return None
        else:
            out.append(_literal(text))
    return None if depth else r"(?s)\A" + "".join(out) + r"\z"


def glob_start(pattern: str) -> str:
    """The literal text that whatever matches a glob begins with; empty if there is none."""
    out = []
    for token in _TOKEN.finditer(pattern):
        kind, text = token.lastgroup, token.group()
        if kind not in ("escaped", "plain", "comma"):
            break
        out.append(token["escaped"] if kind == "escaped" else text)
    return "".join(out)


def any_of(words: Iterable[str]) -> str | None:
    """A regular expression for any of the given words, the longest at each place; None for no word.

    Beginnings that words share are written once, so it takes one step per character and not
    one per word.
    """
    words = sorted({word for word in words if word})
    return "(?:" + "|".join(_branches(words)) + ")" if words else None


def _branches(words: list[str]) -> list[str]:
    """One alternative for each first character of sorted, distinct words."""
    out = []
    for _, found in groupby(words, key=lambda word: word[0]):
        group = list(found)
        start = os.path.commonprefix([group[0], group[-1]])
        rest = [word[len(start):] for word in group if len(word) > len(start)]
        tail = "(?:" + "|".join(_branches(rest)) + ")" if rest else ""
        optional = "?" if rest and len(group[0]) == len(start) else ""
        out.append("".join(map(_literal, start)) + tail + optional)
    return out


def glob_match(value: Column, pattern: str | None) -> Column:
    """Whether a column matches a glob; no pattern at all matches everything."""
    if pattern is None:
        return F.lit(True)
    regex = glob_regex(pattern)
    if regex is None:
        return F.lit(False)
    return F.coalesce(value.rlike(regex), F.lit(False))
