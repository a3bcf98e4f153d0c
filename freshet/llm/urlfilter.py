"""URL filters: a blocked Bloom filter in front of an exact hash join.

A rule names a host and the start of a path. A url can only be judged by rules
whose host is one of its host suffixes and whose path is one of its path prefixes,
so those pairs are its canonical keys. All keys of a url probe a blocked Bloom filter
in place, one block each; the few that may be listed are exploded and go on to an exact
join with the rules, which removes the false positives. The longest rule left decides.
A url without any such key is judged where it is read: it meets no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Blocks of the filter at most, 256 bits each. All tasks hold it, so its size is
#: bounded however long the list is; a longer list only lets more false positives
#: through to the exact join.
MAX_BLOCKS = 1 << 16

#: Rules a block is meant for: 16 bits a rule.
RULES_PER_BLOCK = 16

WORDS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _block(host: Column, path: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(host, path), F.lit(blocks))


def _mask(host: Column, path: Column, word: int) -> Column:
    """Two bits in each 64-bit word of a block."""
    bits = F.xxhash64(path, host, F.lit(1))
    return F.expr("0L").bitwiseOR(_bit(bits, 6 * word)).bitwiseOR(_bit(bits, 24 + 6 * word))


def _bit(bits: Column, shift: int) -> Column:
    place = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def _masks(host: Column, path: Column) -> Column:
    return F.array(*[_mask(host, path, w) for w in range(WORDS)])


def bloom_filter(rules: DataFrame, blocks: int) -> DataFrame:
    """One row: the four 64-bit words of every block, in order, empty blocks included."""
    host, path = F.col("host"), F.col("path")
    held = rules.groupBy(_block(host, path, blocks).alias("id")).agg(
        *[F.bit_or(_mask(host, path, w)).alias(f"w{w}") for w in range(WORDS)]
    )
    words = F.array(*[F.coalesce(f"w{w}", F.lit(0).cast("bigint")) for w in range(WORDS)])
    every = rules.sparkSession.range(blocks).join(held, "id", "left").select("id", words.alias("words"))
    in_order = F.array_sort(F.collect_list(F.struct("id", "words")))
    return every.agg(F.transform(in_order, lambda b: b["words"]).alias("filter"))


def canonical_keys(host: Column, path: Column, labels: int, lengths: Column) -> Column:
    """Host suffixes of at most so many labels, each with the path's starts of the listed lengths."""
    parts = F.split(host, r"\.")
    kept = F.slice(parts, -F.least(F.size(parts), F.lit(labels)), F.size(parts))
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(kept)),
        lambda i: F.array_join(F.slice(kept, i, F.size(kept)), "."),
    )
    starts = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(
        suffixes, lambda h: F.transform(starts, lambda p: F.struct(h.alias("host"), p.alias("path")))
    ))


def probed(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with ``host, path`` and ``_possible``: their canonical keys that the filter lets through.

    ``rules`` has no nulls and no equal ones.
    """
    listed = rules.agg(F.count("*").alias("n"), F.max(F.size(F.split("host", r"\."))).alias("labels")).first()
    blocks = min(MAX_BLOCKS, max(1, -(-listed["n"] // RULES_PER_BLOCK)))
    lengths = rules.agg(F.collect_set(F.length("path")).alias("lengths"))  # distinct lengths, not rules
    keyed = rows.withColumn("_lengths", lengths.scalar()).withColumn(
        "_keys", canonical_keys(F.col("host"), F.col("path"), listed["labels"] or 1, F.col("_lengths")))
    held = keyed.withColumn("_filter", bloom_filter(rules, blocks).scalar())

    def listed_maybe(key: Column) -> Column:
        words = F.get("_filter", _block(key["host"], key["path"], blocks).cast("int"))
        covered = F.zip_with(words, _masks(key["host"], key["path"]), lambda word, mask: word.bitwiseAND(mask) == mask)
        return F.forall(covered, lambda bit: bit)

    return held.withColumn("_possible", F.filter("_keys", listed_maybe)).drop("_lengths", "_keys", "_filter")


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
               default: str = "allow") -> DataFrame:
    """The rule that judges each row's url, and its verdict.

    ``rules`` has host, path and verdict (``allow`` or ``block``); rows with a null in
    any of them are left out, and of equal rules the blocking one counts. Among fitting
    rules the one with the longest text wins, then the one with the longer host. A url
    that is null or has no ``://`` has an empty host and path. Where no rule fits, the
    rule is null and the verdict ``default``: what is not listed is not blocked. Every
    row gives one row, repeated ones too; other columns are not read. An empty table
    gives an empty one, and without rules every verdict is the default.
    """
    rules = (
        rules.select("host", "path", "verdict").dropna()
        .groupBy("host", "path").agg(F.max((F.col("verdict") == "block").cast("int")).alias("blocked"))
    )
    rows = probed(pages.select(
        F.col(key).alias(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
    ), rules)
    met = F.size("_possible") > 0
    hits = rows.where(met).select(F.monotonically_increasing_id().alias("_row"), "*").select(
        "_row", key, "host", "path", F.explode("_possible").alias("_key")
    ).select("_row", key, "host", "path", F.col("_key.host").alias("_host"), F.col("_key.path").alias("_path"))
    exact = rules.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "blocked")
    # A fitting rule is known from the lengths of its two parts: pack them in one number
    # whose maximum the hash aggregate finds, text length first.
    length = F.length("_host") + F.length("_path")
    weight = length.cast("long") * (1 << 31) + F.length("_host") * 2 + F.col("blocked")
    best = (
        hits.join(exact, ["_host", "_path"], "left")
        .groupBy("_row", key, "host", "path").agg(F.max(weight).alias("best")).drop("_row")
        .unionByName(rows.where(~met).select(key, "host", "path", F.lit(None).cast("bigint").alias("best")))
    )
    total = F.floor(F.col("best") / (1 << 31)).cast("int")
    host_chars = (F.col("best") % (1 << 31) / 2).cast("int")
    start = F.length("host") - host_chars + 1
    rule = F.concat(F.substring(F.col("host"), start, host_chars), F.substring(F.col("path"), F.lit(1), total - host_chars))
    verdict = F.when(F.col("best") % 2 == 1, "block").when(F.col("best").isNotNull(), "allow").otherwise(default)
    return best.select(
        key, "host", "path", F.when(F.col("best").isNotNull(), rule).alias("rule"), verdict.alias("verdict")
    )
