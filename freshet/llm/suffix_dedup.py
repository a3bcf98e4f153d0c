"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Bytes go that are covered by a string of ``length`` bytes starting at more than one place
of the corpus. Four passes find all of them:

1. Winnowing. Every window of ``length`` bytes picks the least of its 32-byte grams by a
   hash, its anchor. Neighbouring windows with the same anchor form a unit, some hundredth
   of the bytes. Equal windows have equal anchors, so windows of an anchor gram that is
   unique in the corpus are unique, and nothing of them goes further.
2. Where all units of a gram are the same string, each of their windows is repeated.
3. What is left are units that agree in part. Each task folds units of one string, which are
   repeated and whose spans are known with that, and sorts the suffixes that start at the others'
   and one of each string's anchors into a run, with the common prefix of each with the one
   before. The run goes out front-coded: only what follows the common prefix. A range is
   received as sorted runs and merged by a loser tree that keeps, for each run's head, its
   common prefix with the last suffix put out, and never compares those bytes again. The
   merged order's common prefixes say which units agree from the anchor on for how long; a
   window that starts before the anchor is then repeated if a unit of its class has the same
   bytes to the left.
   A gram of more units than ranges are made for is not merged: its windows meet by digests,
   equal ones of a run folded to one. Spans leave a run and a range joined, as few a text.
4. The windows found are taken off the texts as spans of bytes.

Suffixes are ordered by the hash of their first gram, mixed again, and then by their bytes, so
ranges are even without sampling and a gram stays in one range. (Anchors are the least of many
hashes: unmixed, most of them lie in the first few ranges.) Texts cross a shuffle compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import small_batches, stored

#: Bytes of a gram, of which a window picks the least.
GRAM = 32

#: Window starts handled at once; a text is taken in stretches of so many.
STRETCH = 1 << 17

#: Bits of a gram's hash that give way to its place, so that a minimum also says where.
PLACE = np.uint64((1 << 20) - 1)

#: Units a task sorts into one run, and units a range is meant to hold.
RUN_UNITS, RANGE_UNITS = 50_000, 20_000

#: Units from which on a gram's windows meet by digests, and windows of such grams that are
#: folded at once, and that meet in one range.
HOT_UNITS, RUN_WINDOWS, RANGE_WINDOWS = 50_000, 100_000, 500_000

_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    steps = np.full(STRETCH + 4096, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def units_of(data: np.ndarray, edges: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Units of texts that lie one after the other in a buffer.

    Returns the hash of the anchor's gram, the hash of the unit's string, its first and last
    window start and its anchor, as places of the buffer.
    """
    n, width = len(data), length - GRAM + 1
    empty = np.empty(0, np.int64)
    if n < length:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _UP[:n], out=sums[1:])
    grams = _mix((sums[GRAM:] - sums[:-GRAM]) * _DOWN[:n - GRAM + 1])
    least = _window_min((grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64), width)
    anchor = (least & PLACE).astype(np.int64)
    whole = np.zeros(len(anchor) + 1, np.int8)  # of windows that lie in one text
    starts, stops = edges[:-1], np.maximum(edges[1:] - length + 1, edges[:-1])
    np.add.at(whole, starts[stops > starts], 1)
    np.add.at(whole, stops[stops > starts], -1)
    whole = np.cumsum(whole[:-1], dtype=np.int8) > 0
    first = np.empty(len(anchor), bool)
    first[0] = True
    first[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
    first[starts[starts < len(first)]] = True
    low = np.flatnonzero(first)
    high = np.append(low[1:], len(anchor)) - 1
    low, high = low[whole[low]], high[whole[low]]
    end = high + length
    spans = _mix((sums[end] - sums[low]) * _DOWN[low]) ^ (end - low).astype(np.uint64)
    return grams[anchor[low]], spans, low, high, anchor[low]


def _stretches(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Buffers of whole short texts, and stretches of long ones that overlap by a window."""
    parts, owners, held = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), STRETCH - length):
            part = text[at:at + STRETCH - 1]
            if held + len(part) > STRETCH:
                yield _buffer(parts, owners)
                parts, owners, held = [], [], 0
            parts.append(part)
            owners.append((i, at))
            held += len(part)
    if parts:
        yield _buffer(parts, owners)


def _buffer(parts: list[bytes], owners: list[tuple[int, int]]):
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return np.frombuffer(b"".join(parts), np.uint8), edges, owners


_UNITS = pa.schema([
    ("row", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("packed", pa.binary()),
    ("grams", pa.list_(pa.int64())), ("spans", pa.list_(pa.int64())), ("lows", pa.list_(pa.int32())),
    ("highs", pa.list_(pa.int32())), ("anchors", pa.list_(pa.int32())),
])


def _winnow(length: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            given = batch.column("text").to_pylist()
            texts = [(t or "").encode("utf-8") for t in given]
            found: list[list] = []
            for data, edges, owners in _stretches(texts, length):
                gram, span, low, high, anchor = units_of(data, edges, length)
                part = np.searchsorted(edges, low, "right") - 1
                owner = np.array(owners, np.int64).reshape(-1, 2)[part]
                shift = owner[:, 1] - edges[part]
                found.append([owner[:, 0], gram.view(np.int64), span.view(np.int64), low + shift, high + shift, anchor + shift])
            columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 6
            offsets = pa.array(np.searchsorted(columns[0], np.arange(len(texts) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c, field.type.value_type)) for c, field in zip(columns[1:], list(_UNITS)[4:])]
            yield pa.RecordBatch.from_arrays([
                batch.column("rest"), pa.array(np.arange(row, row + len(texts))), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                pa.array([None if g is None else packer.compress(t) for g, t in zip(given, texts)], pa.binary()), *lists,
            ], names=["rest", *_UNITS.names])
            row += len(texts)
    return run


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings known to agree up to ``at``."""
    n = min(len(a), len(b))
    while at + 16 <= n and a[at:at + 16] == b[at:at + 16]:
        at += 16
    while at < n and a[at] == b[at]:
        at += 1
    return at


_RUNS = "part int, heads binary, tails binary, lefts binary, refs binary, known binary"
_HEAD = np.dtype([("prefix", "<u2"), ("tail", "<u2"), ("left", "<u2"), ("first", "<u2"), ("known", "u1")])
_DIGEST = np.dtype([("a", "<u8"), ("b", "<u8")])


def _equal(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal digests lie side by side, and by it which are the first of equals, and which have equals."""
    order = np.lexsort((digests["b"], digests["a"]))
    first = np.ones(len(order), bool)
    first[1:] = digests[order][1:] != digests[order][:-1]
    alone = first.copy()
    alone[:-1] &= first[1:]
    return order, first, ~alone


def joined_spans(spans: np.ndarray) -> np.ndarray:
    """Spans of (row, start, stop), ascending, those of a row that overlap or touch as one."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    if not len(spans):
        return spans
    row, start, stop = spans.T
    apart = np.concatenate([[0], np.cumsum(row[1:] != row[:-1])]) << 32  # a text is shorter than that
    reach = np.maximum.accumulate(stop + apart)
    first = np.flatnonzero(np.concatenate([[True], (start + apart)[1:] > reach[:-1]]))
    last = np.append(first[1:], len(row)) - 1
    return np.stack([row[first], start[first], (reach - apart)[last]], axis=1)


def _sort_runs(length: int, parts: int, hot_parts: int = 1):
    """Sort the suffixes of a task's units into runs and front-code them by range; fold the windows of hot grams.

    Units of one string are repeated, all of them: one goes on for others to meet it, marked as known, and their
    spans go along joined, to ranges by their rows. So do windows of hot grams that meet an equal one here. Ranges
    of windows lie behind the first ``parts``: ``heads`` are the distinct digests, ``refs`` a row and a start for
    each, the row -1 if the window is known.
    """
    width = -(-(1 << 64) // parts)

    def code(units: dict[tuple, list]) -> pa.RecordBatch:
        ranges: dict[int, tuple[bytes, ...]] = {}
        part, last, head, tails, lefts, refs, known = None, b"", [], [], [], [], []

        def close():
            if head:
                ranges[part] = (np.array(head, _HEAD).tobytes(), b"".join(tails), b"".join(lefts), np.array(refs, "<i8").tobytes())

        windows, places = [], []
        for (suffix, left, hot), found in sorted(units.items()):
            first = length + 8 - len(suffix)  # from the last window's start to the anchor
            if len(found) > 1:
                known.extend((row, anchor - len(left), anchor - first + length) for row, anchor in found)
            row, anchor = found[0]
            if hot:
                text, low = left + suffix[8:], anchor - len(left)
                count = len(text) - length + 1
                windows.extend(hashlib.blake2b(text[i:i + length], digest_size=_DIGEST.itemsize).digest() for i in range(count))
                places.extend((row if len(found) == 1 else -1, low + i) for i in range(count))
                continue
            place = int.from_bytes(suffix[:8], "big") // width
            if place != part:
                close()
                part, last, head, tails, lefts, refs = place, b"", [], [], [], []
            prefix = _common(last, suffix, 0)
            head.append((prefix, len(suffix) - prefix, len(left), first, len(found) > 1))
            tails.append(suffix[prefix:])
            lefts.append(left)
            refs.append((row, anchor))
            last = suffix
        close()
        met = np.array(known, "<i8").reshape(-1, 3)
        if windows:
            digests, at = np.frombuffer(b"".join(windows), _DIGEST), np.array(places, "<i8").reshape(-1, 2)
            order, first, many = _equal(digests)
            same = at[order[many]]
            same = same[same[:, 0] >= 0]
            met = np.concatenate([met, np.column_stack([same, same[:, 1] + length])])
            at[order[many], 0] = -1
            order = order[first]
            place = digests["a"][order] % np.uint64(hot_parts)
            for i in np.unique(place).tolist():
                here = order[place == i]
                ranges[parts + i] = (digests[here].tobytes(), b"", b"", at[here].tobytes())
        met = joined_spans(met)
        place = met[:, 0] % (parts + hot_parts)
        spans = {i: met[place == i].tobytes() for i in np.unique(place).tolist()}
        rows = [(i, *ranges.get(i, (b"",) * 4), spans.get(i, b"")) for i in sorted(ranges.keys() | spans.keys())]
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(
            list(zip(*rows)) or [()] * 6, (pa.int32(), *[pa.binary()] * 5))], names=["part", "heads", "tails", "lefts", "refs", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, units, held, windows = zstandard.ZstdDecompressor(), {}, 0, 0
        for batch in batches:
            found = batch.column("found")
            flat = found.flatten()
            fields = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("gram", "low", "high", "anchor", "hot")]
            fields[0] = _mix(fields[0].view(np.uint64))
            ends = np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False)).tolist()
            for row, packed, a, b in zip(batch.column("row").to_pylist(), batch.column("packed"), [0, *ends[:-1]], ends):
                text = unpack.decompress(packed.as_py())
                for gram, low, high, anchor, hot in zip(*[f[a:b].tolist() for f in fields]):
                    same = units.setdefault((gram.to_bytes(8, "big") + text[anchor:high + length], text[low:anchor], hot), [])
                    windows += hot and not same and high - low + 1
                    same.append((row, anchor))
                held += b - a
                if held >= RUN_UNITS or windows >= RUN_WINDOWS:
                    yield code(units)
                    units, held, windows = {}, 0, 0
        yield code(units)
    return run


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs by a loser tree that knows common prefixes.

    A run is its strings and the common prefix of each with the one before. Returns (run,
    place) in sorted order, and the common prefix of each with the one before.

    An inner node keeps the loser of its match. ``known`` is a head's common prefix with the
    last string put out: the head with the longer one is the smaller, and only of equal ones
    are bytes compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    known, places, losers = [0] * k, [0] * k, [0] * k

    def match(a: int, b: int) -> tuple[int, int]:
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        at = _common(x, y, known[a])
        if at == len(x) or (at < len(y) and x[at] < y[at]):
            known[b] = at
            return a, b
        known[a] = at
        return b, a

    def play(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = match(play(2 * node), play(2 * node + 1))
        return winner

    order, prefixes = [], []
    if not runs:
        return order, prefixes
    winner = play(1)
    while heads[winner] is not None:
        order.append((winner, places[winner]))
        prefixes.append(known[winner])
        strings, common = runs[winner]
        places[winner] += 1
        if places[winner] < len(strings):
            heads[winner], known[winner] = strings[places[winner]], common[places[winner]]
        else:
            heads[winner] = None
        node = (winner + k) // 2
        while node:
            winner, losers[node] = match(winner, losers[node])
            node //= 2
    return order, prefixes


def _repeated(prefix: np.ndarray, lefts: list[bytes], first: np.ndarray, length: int) -> np.ndarray:
    """Per unit and distance of a window's start before the anchor, whether it is repeated.

    ``prefix`` has the bytes from the anchor on that a unit shares with the one before in
    order; units whose shared bytes reach a window's end are of one class, and in it those
    with the same bytes to the left have the same window.
    """
    n, most = len(lefts), length - GRAM + 1
    sizes = np.array([len(x) for x in lefts])
    reach = np.arange(most)
    valid = (reach >= first[:, None]) & (reach <= sizes[:, None])
    found = np.zeros_like(valid)
    left = np.zeros(n, np.uint64)
    flat = np.frombuffer(b"".join(lefts) + b"\0", np.uint8)
    ends = np.cumsum(sizes)
    for j in range(most):
        if j:  # take in one more byte to the left
            left = (left + _TABLE[flat[np.maximum(ends - j, 0)]]) * np.uint64(_BASE)
            left ^= left >> np.uint64(29)
        here = np.flatnonzero(valid[:, j])
        if len(here) < 2:
            continue
        group = np.cumsum(prefix < length - j)[here].astype(np.uint64)
        key = _mix(left[here] + group * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        found[here[order[1:][same]], j] = True
        found[here[order[:-1][same]], j] = True
    return found


_SPANS = "row long, start long, stop long"


def _merge_range(length: int, parts: int):
    def meet(heads: bytes, refs: bytes) -> np.ndarray:
        order, _, many = _equal(np.frombuffer(heads, _DIGEST))
        found = np.frombuffer(refs, "<i8").reshape(-1, 2)[order[many]]
        found = found[found[:, 0] >= 0]
        return np.column_stack([found, found[:, 1] + length])

    def sorted_runs(columns: list[list[bytes]]) -> list[np.ndarray]:
        runs, lefts, firsts, known, refs = [], [], [], [], []
        for heads, tails, left, ref in zip(*columns):
            head, strings, last, at = np.frombuffer(heads, _HEAD), [], b"", 0
            for prefix, tail in zip(head["prefix"].tolist(), head["tail"].tolist()):
                last = last[:prefix] + tails[at:at + tail]
                strings.append(last)
                at += tail
            runs.append((strings, head["prefix"].tolist()))
            cuts = np.concatenate([[0], np.cumsum(head["left"], dtype=np.int64)]).tolist()
            lefts.append([left[a:b] for a, b in zip(cuts[:-1], cuts[1:])])
            firsts.append(head["first"])
            known.append(head["known"])
            refs.append(np.frombuffer(ref, "<i8").reshape(-1, 2))
        order, prefix = merge_runs(runs)
        if not order:
            return []
        prefix = np.array(prefix) - 8  # the hash in front is no part of the text
        spans = []
        borders = np.flatnonzero(prefix < GRAM)  # no window is shared across
        cuts = [0]
        for border in borders[1:].tolist():
            if border - cuts[-1] >= 4096:
                cuts.append(border)
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            part = order[a:b]
            found = _repeated(prefix[a:b], [lefts[r][i] for r, i in part], np.array([firsts[r][i] for r, i in part], np.int64), length)
            found[np.array([known[r][i] for r, i in part], bool)] = False  # their spans are there
            step = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            unit, begin = np.nonzero(step == 1)
            end = np.nonzero(step == -1)[1] - 1
            if len(unit):
                at = np.array([refs[r][i] for r, i in part])[unit]
                spans.append(np.column_stack([at[:, 0], at[:, 1] - end, at[:, 1] - begin + length]))
        return spans

    def merge(group: pa.Table) -> pa.Table:
        """The spans found in a range, and those that came along, joined."""
        *columns, known = [[x.as_py() for x in group.column(c)] for c in ("heads", "tails", "lefts", "refs", "known")]
        spans = [np.frombuffer(b"".join(known), "<i8").reshape(-1, 3)]
        if group.column("part")[0].as_py() >= parts:
            spans.append(meet(b"".join(columns[0]), b"".join(columns[3])))
        else:
            spans.extend(sorted_runs(columns))
        return pa.Table.from_arrays([pa.array(c) for c in joined_spans(np.concatenate(spans)).T.copy()], ["row", "start", "stop"])
    return merge


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        removed, spans, digests, kept_texts = [], [], [], []
        columns = [batch.column(c).to_pylist() for c in ("packed", "found", "sha256", "keep")]
        for packed, found, digest, keep in zip(*columns):
            if not found:
                removed.append(0), spans.append(0), digests.append(digest)
                kept_texts.append(unpack.decompress(packed).decode("utf-8") if keep and packed is not None else None)
                continue
            text, kept, at, gone, runs = unpack.decompress(packed), [], 0, 0, 0
            stop = -1
            for start, end in sorted((x["start"], x["stop"]) for x in found):
                if start > stop:
                    kept.append(text[max(at, 0):start])
                    runs += 1
                    gone += end - start
                else:
                    gone += max(0, end - stop)
                stop = max(stop, end)
                at = stop
            kept.append(text[at:])
            rest = b"".join(kept)
            removed.append(gone), spans.append(runs), digests.append(hashlib.sha256(rest).hexdigest())
            kept_texts.append(rest.decode("utf-8", "ignore") if keep else None)
        yield pa.RecordBatch.from_arrays([
            batch.column("rest"), batch.column("bytes"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
            pa.array(digests, pa.string()), pa.array(kept_texts, pa.string()),
        ], names=["rest", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = 200, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Take off each byte covered by a string of ``length`` bytes that starts at two places.

    Texts are UTF-8 bytes, null ones empty; matches never cross texts, may overlap and lie in
    one text. Strings are judged on the input. Returns ``rest``, a struct of the other
    columns, with n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the
    remaining bytes and ``kept``, their text (without bytes of characters cut in two; null for
    a null text or if ``keep_text`` is off). Every row gives one row; repeated rows remove each other's text
    where it is long enough. An empty table gives an empty one.

    Unit strings and bytes to the left of an anchor are compared by 64-bit hashes, bytes from
    the anchor on as they are. Units that share a gram and nothing else meet in one range, unless
    there are more than HOT_UNITS: then their windows meet one by one, by 128-bit digests. Equal
    units, or windows, are folded in each run before they are sent.
    """
    spark = docs.sparkSession
    small_batches(spark)
    others = [c for c in docs.columns if c != text]
    rest = F.struct(*[docs[c].alias(c) for c in others]) if others else F.struct(F.lit(None).cast("int").alias("none"))
    shaped = docs.select(rest.alias("rest"), docs[text].cast("string").alias("text"))
    schema = T.StructType([shaped.schema["rest"], *T._parse_datatype_string(
        "row long, bytes long, sha256 string, packed binary, grams array<long>, spans array<long>, "
        "lows array<int>, highs array<int>, anchors array<int>").fields])
    units = stored(shaped.mapInArrow(_winnow(length, _UNITS), schema), "suffix-units")

    grams = units.select(F.explode(F.arrays_zip("grams", "spans")).alias("u")).select("u.grams", "u.spans")
    counts = grams.groupBy(F.col("grams").alias("gram")).agg(
        F.count("*").alias("n"), F.min("spans").alias("least"), F.max("spans").alias("most"))
    # Written, so that the join shuffles both sides and Spark can split a gram that is everywhere.
    same = F.col("least") == F.col("most")
    repeated = stored(counts.where("n > 1").select("gram", same.alias("same"), (~same & (F.col("n") > HOT_UNITS)).alias("hot")), "suffix-grams")
    places = units.select("row", F.explode(F.arrays_zip("grams", "lows", "highs", "anchors")).alias("u")).select(
        "row", F.col("u.grams").alias("gram"), F.col("u.lows").alias("low"), F.col("u.highs").alias("high"), F.col("u.anchors").alias("anchor")
    )
    shared = stored(places.join(repeated, "gram"), "suffix-shared")

    partly = shared.where(~F.col("same"))
    held = partly.agg(F.count_if(~F.col("hot")).alias("units"), F.sum(F.when(F.col("hot"), F.col("high") - F.col("low") + 1)).alias("windows")).first()
    parts, hot_parts = max(1, -(-held["units"] // RANGE_UNITS)), max(1, -(-(held["windows"] or 0) // RANGE_WINDOWS))
    wanted = partly.groupBy("row").agg(F.collect_list(F.struct("gram", "low", "high", "anchor", "hot")).alias("found"))  # a text's own units
    runs = units.select("row", "packed").join(wanted, "row").select("row", "packed", "found").mapInArrow(_sort_runs(length, parts, hot_parts), _RUNS)
    spans = runs.groupBy("part").applyInArrow(_merge_range(length, parts), _SPANS)
    whole = shared.where("same").select("row", F.col("low").cast("long").alias("start"), (F.col("high") + F.lit(length)).cast("long").alias("stop"))
    spans = spans.unionByName(whole).groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    marked = units.select("row", "rest", "bytes", "sha256", "packed").join(spans, "row", "left")
    result = T.StructType([shaped.schema["rest"], *T._parse_datatype_string(
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string").fields])
    return marked.withColumn("keep", F.lit(keep_text)).drop("row").mapInArrow(_cut, result)
