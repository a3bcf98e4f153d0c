"""The registered queries of this folder, with production parameters, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import local_frame
from .ann import nearest_neighbours
from .codes import compress_vectors
from .fingerprints import document_fingerprints
from .common import table
from .langid import predict_languages
from .merkle import document_proofs
from .minhash_dedup import near_duplicates
from .mixing import mix_sizes
from .packing import pack_documents
from .suffix_dedup import remove_repeats
from .tokenfile import read_tokens, write_tokens
from .topk import top_inner_products
from .toxicity import predict_toxicity
from .urlfilter import judge_urls

#: Rules of the url filter (fixed by the contract): host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op2_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, length=200, keep_text=False).select("rest.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = local_frame(spark, URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_proofs(table(spark, sf_dir, "documents"))


def op12_gnat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

#: Levels the SQL climbs: up to 8 ** 8 documents of a language and 8 ** 3 languages.
_LEVELS, _LANG_LEVELS = 8, 3


def _climb_sql(name: str, group: str, levels: int) -> str:
    """Tables ``name``0 to ``name``levels of the nodes of each level, and ``name``s0 on of their siblings."""
    steps = []
    for k in range(levels):
        steps.append(f"""{name}s{k} AS (
            SELECT {group}, i, m > 1 AS many, coalesce(string_agg(h, '') OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                   coalesce(string_agg(h, '') OVER (b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
            FROM {name}{k} WINDOW b AS (PARTITION BY {group}, i // 8 ORDER BY i)
        ), {name}{k + 1} AS (
            SELECT {group}, i // 8 AS i, CASE WHEN any_value(m) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h,
                   (any_value(m) + 7) // 8 AS m
            FROM {name}{k} GROUP BY {group}, i // 8
        )""")
    return ", ".join(steps)


def _fold_sql() -> str:
    """Every leaf with its proof so far and the node its claim leads to, level by level."""
    steps, last = [], "f0"
    for k, (name, place) in enumerate([("t", f"i // {8 ** k}") for k in range(_LEVELS)] + [("u", f"u // {8 ** k}") for k in range(_LANG_LEVELS)]):
        level = k if name == "t" else k - _LEVELS
        match = f"f.lang IS NOT DISTINCT FROM s.lang AND f.{place} = s.i" if name == "t" else f"f.{place} = s.i"
        steps.append(f"""f{k + 1} AS (
            SELECT f.* EXCLUDE (proof, node), CASE WHEN many THEN proof || before || after ELSE proof END AS proof,
                   CASE WHEN many THEN sha256(before || node || after) ELSE node END AS node
            FROM {last} f JOIN {name}s{level} s ON {match}
        )""")
        last = f"f{k + 1}"
    return ", ".join(steps)


def _framed_sql(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column}::VARCHAR END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_framed_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_MERKLE_SQL = f"""
        WITH crc AS (
            SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
            FROM range(256) r(i)
        ), leaves AS (
            SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
                   {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS claim,
                   xor(list_reduce([4294967295] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda j: ascii(substr(doc_id::VARCHAR, j, 1))::BIGINT),
                                   lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc
            FROM documents, crc
        ), d AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves
        ), t0 AS (SELECT lang, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS m FROM d),
        {_climb_sql("t", "lang", _LEVELS)},
        u0 AS (SELECT true AS everything, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h, count(*) OVER () AS m FROM t{_LEVELS}),
        {_climb_sql("u", "everything", _LANG_LEVELS)},
        f0 AS (
            SELECT d.*, u0.i AS u, u0.h AS subroot, '' AS proof, CASE WHEN coalesce(crc % 3 = 0, false) THEN claim ELSE leaf END AS node
            FROM d JOIN u0 ON d.lang IS NOT DISTINCT FROM u0.lang
        ), {_fold_sql()}
        SELECT doc_id, leaf, subroot, u{_LANG_LEVELS}.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = u{_LANG_LEVELS}.h AS verified
        FROM f{_LEVELS + _LANG_LEVELS}, u{_LANG_LEVELS}"""


def _codes_sql() -> str:
    """Two rounds of assigning and averaging, over a row a component."""
    steps = ["""good AS (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS id, vec_id, label, embedding, len(embedding) // 16 AS w FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), flat AS (
            SELECT id, w, unnest(range(len(embedding))) AS j, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM good
        ), v AS (SELECT id, j // w AS p, j % w AS i, x FROM flat
        ), book0 AS (SELECT p, id - 1 AS e, i, x FROM v WHERE id <= 64)"""]
    for k in range(3):
        steps.append(f"""near{k} AS (
            SELECT id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
                SELECT id, v.p, e, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS d FROM v JOIN book{k} b ON v.p = b.p AND v.i = b.i GROUP BY id, v.p, e)
            GROUP BY id, p)""")
        if k < 2:
            steps.append(f"""mean{k} AS (
            SELECT v.p, e, i, sum(x)::BIGINT AS total, count(*) AS n FROM v JOIN near{k} a ON v.id = a.id AND v.p = a.p GROUP BY v.p, e, i
        ), book{k + 1} AS (
            SELECT b.p, b.e, b.i, CASE WHEN n IS NULL THEN b.x ELSE (total - ((total % n) + n) % n) // n END AS x
            FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e AND b.i = m.i)""")
    return "WITH " + ", ".join(steps) + """, coded AS (
            SELECT id, string_agg(format('{:02x}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY id
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) FROM book2) AS codebooks_sha256
        FROM coded JOIN good USING (id)"""


ORACLES = {
    "op11_merkle": _MERKLE_SQL,
    "op12_gnat_codes": _codes_sql(),
    "op2_segment_topk": """
        WITH good AS (
            SELECT row_number() OVER () AS id, vec_id, embedding FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), c AS (
            SELECT id, vec_id, unnest(generate_series(1, len(embedding))) AS i,
                   floor(64 * unnest(embedding)::DOUBLE)::BIGINT AS x
            FROM good
        ), s AS (
            SELECT q.id AS query, any_value(q.vec_id) AS query_id, v.id, any_value(v.vec_id) AS vec_id, sum(q.x * v.x)::BIGINT AS score
            FROM c q JOIN c v ON q.i = v.i AND q.id <> v.id WHERE q.vec_id % 20 = 0 GROUP BY q.id, v.id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op3_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, count(*) FILTER (size > 0) AS n,
                   [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
            FROM d GROUP BY source
        ), levels AS (
            SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0))
                      / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
            FROM s WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), t AS (
            SELECT source, source_size, n, least(2.0::DOUBLE * source_size, max(level) OVER () * w) AS target FROM levels
        ), r AS (
            SELECT d.*, source_size, n, target,
                   CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
                   (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), q AS (
            SELECT *, target - whole * source_size AS rest,
                   (u / (1 - u)) / (((target - whole * source_size) / source_size) / (1 - (target - whole * source_size) / source_size)
                                    * sqrt((source_size::DOUBLE / n) / size)) AS pareto
            FROM r
        ), k AS (
            SELECT *, CASE WHEN size > 0 AND rest > 0 THEN floor(pareto / (1 + pareto) * 1099511627776.0::DOUBLE)::BIGINT END AS rank FROM q
        ), c AS (
            SELECT *, sum(size) OVER o AS upto, row_number() OVER o AS place FROM k WHERE rank IS NOT NULL
            WINDOW o AS (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)
        ), g AS (
            SELECT source, any_value(rest) - coalesce(max(upto) FILTER (upto <= rest), 0) AS gap FROM c GROUP BY source
        ), closing AS (
            SELECT c.source, arg_min(place, (abs(size - gap), place)) AS place
            FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source WHERE upto > rest AND abs(size - gap) < gap GROUP BY c.source
        )
        SELECT k.doc_id, k.size, k.source_size, k.target,
               (k.size * (k.whole + CASE WHEN k.rank IS NOT NULL AND (c.upto <= c.rest OR coalesce(c.place = closing.place, false)) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM k LEFT JOIN c ON k.source IS NOT DISTINCT FROM c.source AND k.doc_id IS NOT DISTINCT FROM c.doc_id AND k.rank = c.rank
        LEFT JOIN closing ON c.source IS NOT DISTINCT FROM closing.source""",
    "op8_url_filter": f"""
        WITH rules(rule_host, rule_path, verdict) AS (VALUES {_RULES_SQL}), p AS (
            SELECT page_id, row_number() OVER () AS id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), h AS (
            SELECT page_id, id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM p
        )
        SELECT page_id, any_value(host) AS host, any_value(path) AS path,
               arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
               coalesce(arg_max(verdict, length(rule_host || rule_path)), 'allow') AS verdict
        FROM h LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        GROUP BY page_id, id""",
}

QUERIES = {
    "op1_multiprobe": op1_multiprobe,
    "op2_segment_topk": op2_segment_topk,
    "op3_mixing": op3_mixing,
    "op4_chosen_path": op4_chosen_path,
    "op5_language": op5_language,
    "op6_token_files": op6_token_files,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_merkle": op11_merkle,
    "op12_gnat_codes": op12_gnat_codes,
    "op13_order_minhash": op13_order_minhash,
}
