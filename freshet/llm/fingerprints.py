"""Document fingerprints by Order MinHash, sensitive to edit distance, in SQL functions alone.

A text's k-mers are numbered by occurrence, so that a repeated one counts each time. The
numbered k-mers are dealt to sketches by a hash; each sketch keeps the minimal ones, puts
them back in text order and hashes the tuple. Two texts agree in a sketch if they share the
minimal k-mers *and* have them in the same order, so the share of agreeing sketches falls
with moves as well as with replacements.

Every k-mer of a text counts alike: the hash of k-mer and occurrence alone decides which are
minimal. All are hashed and numbered, but only hashes so low that the minimal ones are nearly
always among them are sorted; where a sketch is not filled by these, all are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Characters of a k-mer, sketches, and minimal k-mers of a sketch.
KMER, SKETCHES, TUPLE = 10, 32, 2

#: A k-mer's hash as one long that is never negative: what orders it, one more bit, its sketch; below these its place.
ORDER_AT, DEAL_AT, PLACE_BITS = 33, 27, 27

#: A numbered k-mer as one long: its sketch, its order, what decides between equal ones, its place among the k-mers.
SKETCH_AT, HASH_AT = 58, 28

#: The bits of a hash that count: k-mers alike in these 36 are taken as equal.
HASH_BITS = (1 << 63) - (1 << PLACE_BITS)

#: Numbered k-mers of a text that are sorted at first, on average.
SORTED = 12 * SKETCHES

#: Parts of the document order per shuffle partition: parts even out by number.
PARTS = 4

#: All k-mers of a text. None starts inside a character that takes two units of the pattern matcher's text.
ALL = rf"(?s)(?=(.{{{KMER}}}))(?![\\x{{DC00}}-\\x{{DFFF}}])"

#: K-mers that start in a window, and all windows of a text, each long enough for its k-mers.
WINDOW = 16
WINDOWS = f"(?s)(?=(.{{{KMER},{WINDOW + KMER - 1}}})).{{1,{WINDOW}}}"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` under a name. A lambda's variable is computed once, whatever the
    optimiser inlines; a column of an inner select would be computed again for each element."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _hashes(kmers: str) -> str:
    """The hashes of k-mers with their places in the low bits. Sorted, low ones come first and equal k-mers lie next to each other."""
    return f"transform({kmers}, (x, i) -> (xxhash64(x) & {HASH_BITS}) | i)"


def _window_hashes(windows: str, before: str = "0") -> str:
    """:func:`_hashes` by the text's windows, behind so many k-mers ``before``. Few strings are cut out of the text by pattern."""
    hashes = [f"(xxhash64(substring(x, {at + 1}, {KMER})) & {HASH_BITS}) | (i * {WINDOW} + {f'{before} + {at}' if before != '0' else at})" for at in range(WINDOW)]
    last = f"greatest(length(get({windows}, size({windows}) - 1)) - {KMER - 1}, 1)"  # k-mers of the last window; less than all of it are wanted
    return f"slice(flatten(transform({windows}, (x, i) -> array({', '.join(hashes)}))), 1, greatest((size({windows}) - 1) * {WINDOW} + {last}, 0))"


def _in_windows(windows: str, at: str) -> str:
    """The k-mer at a place of a text, by the text's windows."""
    return f"substring(get({windows}, cast({at} div {WINDOW} AS int)), cast({at} % {WINDOW} AS int) + 1, {KMER})"


def _minimal(kmers: str, late: str = "", hashes: str = "") -> str:
    """The minimal numbered k-mers of each sketch, in order of sketches.

    Of equal hashes those come later that ``late``, a condition on k-mer ``x``, holds for.
    ``hashes`` names a column of the k-mers' sorted hashes, if there is one.
    """
    place_mask = (1 << PLACE_BITS) - 1
    sketch_mask, hash_mask = (SKETCHES - 1) << SKETCH_AT, ((1 << (SKETCH_AT - HASH_AT)) - 1) << HASH_AT

    def same(x: str, before: str) -> str:
        return f"({x} ^ {before}) <= {place_mask}"

    def decided(x: str) -> str:
        return f" | shiftleft(cast({late.format(x=f'get({kmers}, cast({x} & {place_mask} as int))')} as bigint), {PLACE_BITS})" if late else ""

    def single(sorted_hashes: str, also: str = "") -> str:
        return f"filter({sorted_hashes}, (x, j) -> {also}coalesce(NOT {same('x', f'get({sorted_hashes}, j - 1)')}, true))"

    def numbered(x: str, number: str) -> str:
        return f"(xxhash64(shiftright({x}, {PLACE_BITS}), {number}) & {HASH_BITS}) | ({x} & {place_mask})"

    def repeated(sorted_hashes: str) -> str:
        return f"filter({sorted_hashes}, (x, j) -> {same('x', f'get({sorted_hashes}, j - 1)')})"

    # Once sorted, places in a run of equal k-mers are their numbers, which give the repeated ones other hashes.
    # One pass over all finds these. Most are second ones; what is repeated among them again is numbered run by run.
    none = "cast(array() AS array<bigint>)"
    seconds = f"transform({single('d')}, x -> {numbered('x', '1')})"
    starts = f"filter(sequence(0, size(e) - 1), j -> coalesce(NOT {same('get(e, j)', 'get(e, j - 1)')}, true))"
    run = "sequence(f, coalesce(get(r, t + 1), size(e)) - 1)"
    runs = _let(starts, "r", f"flatten(transform(r, (f, t) -> transform({run}, (j, o) -> {numbered('get(e, j)', 'o + 2')})))")
    later = _let(repeated("d"), "e", f"CASE WHEN size(e) = 0 THEN {none} ELSE {runs} END")
    repeats = _let(repeated("s"), "d", f"CASE WHEN size(d) = 0 THEN {none} ELSE concat({seconds}, {later}) END")

    def first(of_all: str) -> str:
        by_sketch = f"x -> (shiftleft(x, {SKETCH_AT - DEAL_AT}) & {sketch_mask}) | (shiftright(x, {ORDER_AT - HASH_AT}) & {hash_mask}) | (x & {place_mask}){decided('x')}"
        return _let(
            f"sort_array(transform({of_all}, {by_sketch}))", "m",
            f"filter(m, (x, j) -> j < {TUPLE} OR (x ^ get(m, j - {TUPLE})) >= {1 << SKETCH_AT})")

    # The first hashes up to the order of the next one, which is left out with all that are as high.
    limit = f"get(s, {SORTED}) & {-1 << ORDER_AT}"
    low = _let(f"slice(s, 1, {SORTED})", "l", first(f"concat({single('l', 'x < limit AND ')}, filter(a, x -> x < limit))"))
    tried = f"CASE WHEN size(s) > {SORTED} THEN {_let(limit, 'limit', low)} ELSE {none} END"
    minimal = _let(tried, "z", f"CASE WHEN size(z) = {SKETCHES * TUPLE} THEN z ELSE {first('concat(' + single('s') + ', a)')} END")
    return _let(hashes or f"sort_array({_hashes(kmers)})", "s", _let(repeats, "a", minimal))


def _sketches(minimal: str, kmers: str, kmer: str = "") -> str:
    """Per sketch that has any, its number and the hash of its tuple in text order, as one long.

    ``kmer`` tells the k-mer at place ``at``, where it isn't to be found in an array ``kmers``.
    """
    starts = f"filter(sequence(0, size(v) - 1), j -> j = 0 OR shiftright(get(v, j), {SKETCH_AT}) <> shiftright(get(v, j - 1), {SKETCH_AT}))"
    run = "sequence(f, coalesce(get(w, t + 1), size(v)) - 1)"
    places = f"array_sort(transform({run}, j -> get(v, j) & {(1 << PLACE_BITS) - 1}))"
    tuples = f"xxhash64(transform({places}, at -> {kmer or f'get({kmers}, cast(at AS int))'}))"
    return _let(minimal, "v", _let(starts, "w", f"transform(w, (f, t) -> shiftleft(shiftright(get(v, f), {SKETCH_AT}), 32) | ({tuples} & 4294967295))"))


def _every(text: str, pattern: str = ALL) -> str:
    """All k-mers or windows of a text, which is one if it is shorter than a k-mer."""
    return f"CASE WHEN length({text}) < {KMER} THEN array({text}) ELSE regexp_extract_all({text}, '{pattern}', 1) END"


def signature(text: str) -> Column:
    """The sketches of a text column: longs of a sketch's number above 32 bits of its tuple's hash.

    A text shorter than a k-mer is one k-mer; an empty text has no sketches. Sketches that no
    k-mer falls in are left out, which happens to short texts only.
    """
    none = "cast(array() AS array<bigint>)"
    value = _let(_every(text), "k", _sketches(_minimal("k"), "k"))
    return F.expr(f"CASE WHEN {text} = '' THEN {none} ELSE {value} END")


def _signature_of(text: str, hashes: str, kmer: str) -> Column:
    """:func:`signature` by a column of the sorted hashes of the text's k-mers, and the k-mer at place ``at``."""
    value = _sketches(_minimal("", hashes=hashes), "", kmer)
    return F.expr(f"CASE WHEN size({hashes}) = 0 OR {text} = '' THEN cast(array() AS array<bigint>) ELSE {value} END")


def with_signatures(rows: DataFrame) -> DataFrame:
    """Rows of (text, edited, kept, ...) with ``sketches`` and ``edited_sketches``, less the two texts.

    The first ``kept`` characters of the edited text are the text's own, and so are its k-mers there and their
    hashes. K-mers are not kept as strings but cut from windows when they are asked for. Windows and hashes are
    columns of inner selects, each used more than once, so that Spark keeps them apart and sorts longs in
    generated code; in a lambda they are sorted as objects.
    """
    others = [c for c in rows.columns if c not in ("text", "edited", "kept")]
    own = F.greatest(F.col("kept") - (KMER - 1), F.lit(0)).alias("_own")  # k-mers of the text that stay
    rows = rows.select(*others, "text", "edited", own, F.expr(_every("text", WINDOWS)).alias("_windows"))
    rows = rows.withColumn("_end", F.expr("substring(edited, _own + 1)"))
    end = f"CASE WHEN _own > 0 AND length(_end) < {KMER} THEN cast(array() AS array<string>) ELSE {_every('_end', WINDOWS)} END"
    rows = rows.select(*others, "text", "edited", "_own", "_windows", F.expr(_window_hashes("_windows")).alias("_hashes"), F.expr(end).alias("_end"))
    joined = f"sort_array(concat(slice(_hashes, 1, _own), {_window_hashes('_end', '_own')}))"
    rows = rows.select(
        *others, "text", "edited", "_own", "_windows", "_end",
        F.expr("sort_array(_hashes)").alias("_sorted"), F.expr(joined).alias("_edited_sorted"))
    kept_or_new = f"CASE WHEN at < _own THEN {_in_windows('_windows', 'at')} ELSE {_in_windows('_end', '(at - _own)')} END"
    return rows.select(
        *others, _signature_of("text", "_sorted", _in_windows("_windows", "at")).alias("sketches"),
        _signature_of("edited", "_edited_sorted", kept_or_new).alias("edited_sketches"))


def as_text(sketches: Column) -> Column:
    """A signature in hex, ten digits a sketch."""
    return F.array_join(F.transform(sketches, lambda x: F.lpad(F.hex(x), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of sketches in which two signatures agree, of those that either has; 1 for two empty ones."""
    either = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32))))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def _at_or_below(splits: list[int], value: Column, below: bool) -> Column:
    """How many of the ascending splits lie at or below (or only below) a value, by two short searches."""
    def count(values: Column) -> Column:
        return F.size(F.filter(values, lambda s: s < value if below else s <= value))

    step = max(1, math.isqrt(len(splits)))
    groups = [splits[i:i + step] for i in range(0, len(splits), step)]
    before = count(F.array(*[F.lit(g[0]).cast("long") for g in groups]))
    inner = F.array(*[F.array(*[F.lit(s).cast("long") for s in g]) for g in groups])
    return F.when(before == 0, 0).otherwise((before - 1) * step + count(F.get(inner, before - 1)))


def _part(rows: DataFrame, parts: int) -> Column:
    """The part of a row of (doc_id, tie): parts ascend with the order and hold about equally many rows."""
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = rows.agg(F.percentile_approx("doc_id", shares, F.lit(20 * parts)).alias("splits")).first()["splits"] if parts > 1 else None
    if not found:
        return F.lit(0)
    upto, before = _at_or_below(found, F.col("doc_id"), False), _at_or_below(found, F.col("doc_id"), True)
    # An id that several splits name fills that many parts, by its rows' second key.
    own = F.floor((F.col("tie") / float(1 << 64) + 0.5) * (upto - before)).cast("int")
    return F.coalesce(F.when(upto > before, before + 1 + F.least(own, upto - before - 1)).otherwise(upto), F.lit(0)).cast("int")


def with_next(docs: DataFrame, columns: list[str], shape: Callable[[DataFrame], DataFrame] | None = None, shaped: Sequence[str] = ()) -> DataFrame:
    """Rows of (doc_id, text, ...) beside ``next_`` columns of the next row, ascending by id; the last meets the first.

    ``shape`` computes more columns from these, and may drop them; those of its columns named by
    ``shaped`` also go beside the row before, without another shuffle.

    Null ids come first, equal ones follow each other by a hash of the text. Rows are dealt
    to parts of the order, and the first row of each part also goes to the part before it as
    a guest: one shuffle, and no part waits for another. The list of first rows, a few numbers
    a part, is broadcast; there are PARTS of them per shuffle partition.
    """
    spark = docs.sparkSession
    parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumn("tie", F.xxhash64("text"))
    keyed = keyed.withColumn("part", _part(keyed, parts))
    firsts = keyed.select("part", F.struct("doc_id", "tie").alias("place")).groupBy("part").agg(F.min("place").alias("place"))
    order = W.partitionBy().orderBy("part")  # a row a part from here on
    before = F.coalesce(F.lag("part").over(order), F.max("part").over(W.partitionBy()))
    firsts = firsts.select(F.col("part").alias("_part"), F.col("place.doc_id").alias("_id"), F.col("place.tie").alias("_tie"), before.alias("_host"))
    same = (F.col("part") == F.col("_part")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))
    own, guest = F.struct("part", F.lit(False).alias("guest")), F.struct(F.col("_host").alias("part"), F.lit(True).alias("guest"))
    stays = F.when(F.col("_host").isNull(), F.array(own)).otherwise(F.array(own, guest))
    sent = keyed.join(F.broadcast(firsts), same, "left").select("doc_id", "tie", *columns, F.explode(stays).alias("stay")).select("*", "stay.*")
    follow = W.partitionBy("part").orderBy("guest", F.col("doc_id").asc_nulls_first(), "tie")
    ahead = [F.lead(c).over(follow).alias(f"next_{c}") for c in columns]
    met = sent.select("doc_id", "part", "tie", "guest", *columns, *ahead)
    if shape:
        met = shape(met)
        met = met.select("*", *[F.lead(c).over(follow).alias(f"next_{c}") for c in shaped])
    return met.where(~F.col("guest")).drop("guest", "part", "tie")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text counts as empty, and the likeness of two empty texts is 1, of an empty one
    and another 0. The edited text has its last quarter replaced by as many first characters
    of the next document (or all it has). The last document's next one is the first, a lone
    document's itself. Equal ids follow each other by a hash of the text; repeated rows are
    documents each, and each other's next. Very long texts are taken whole, in some bytes a
    character. An empty table gives an empty one. Only doc_id and text are read.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))

    def shape(pairs: DataFrame) -> DataFrame:
        size = F.length("text")
        quarter = F.floor(size / 4).cast("int")
        sized = pairs.select("*", size.cast("long").alias("n_chars"), (size - quarter).alias("kept"))
        edited = F.concat(F.substring("text", F.lit(1), F.col("kept")), F.substring("next_text", F.lit(1), quarter))
        edits = sized.select("doc_id", "part", "tie", "guest", "n_chars", "kept", "text", edited.alias("edited"))
        return with_signatures(edits.withColumn("edited_sha256", F.sha2("edited", 256)))

    rows = with_next(rows, ["text"], shape, ["sketches"])
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketches")).alias("fingerprint"),
        as_text(F.col("edited_sketches")).alias("edited_fingerprint"), likeness(F.col("sketches"), F.col("edited_sketches")).alias("near_edited"),
        likeness(F.col("sketches"), F.col("next_sketches")).alias("near_next"),
    )
