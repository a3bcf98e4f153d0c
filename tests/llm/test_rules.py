"""URL rules and mixing on small tables; the registered queries are held against SQL."""

import pytest
from pyspark.sql import functions as F

from freshet.llm import mixing, urlfilter
from freshet.llm.cases import URL_RULES

URLS = {
    "http://www.Example.com/en/x?q": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "https://blog.example.com/en/": ("blog.example.com", "/en/", "example.com/en/", "block"),
    "x://example.com": ("example.com", "", None, "allow"),
    "a://b.net/es/#t": ("b.net", "/es/", "net/es/", "block"),
    "a://net/fr/": ("net", "/fr/", "net/fr/", "block"),
    "a://other.org/fr/": ("other.org", "/fr/", None, "allow"),
    "a://com/": ("com", "/", "com/", "allow"),
    "a://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://" + "a." * 2000 + "com/" + "p" * 3000: ("a." * 2000 + "com", "/" + "p" * 3000, "com/", "allow"),
}


def rules(spark, more=()):
    return spark.createDataFrame([*URL_RULES, *more], "host string, path string, verdict string")


def test_rules_judge_hosts_and_paths(spark):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    found = urlfilter.judge_urls(pages, rules(spark)).collect()
    assert len(found) == 2 * len(URLS)
    for r in found:
        assert tuple(r)[1:] == list(URLS.values())[r["page_id"]]


def test_many_rules_and_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MAX_BLOCKS", 1)  # every key may be listed: the exact join decides
    more = [(f"h{i}.org", "/", "block") for i in range(2000)] + [("h1.org", "/", "allow"), (None, "/", "block")]
    pages = spark.createDataFrame([(1, "a://x.h1.org/"), (2, "a://h2000.org/"), (None, "a://h7.org/q")], "page_id long, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages, rules(spark, more)).collect()}
    assert found == {1: ("h1.org/", "block"), 2: (None, "allow"), None: ("h7.org/", "block")}


def test_only_possible_hits_reach_the_exact_join(spark):
    many = spark.createDataFrame([(f"h{i}.org", f"/{'p' * (i % 5)}/", "block") for i in range(4000)], "host string, path string, verdict string")
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(
        F.lit("a://www.h"), F.col("id") * 2, F.lit(".org/"), F.repeat(F.lit("p"), (F.col("id") % 4).cast("int")), F.lit("/q")).alias("url"))
    rows = urlfilter.probed(pages.select(
        "page_id", urlfilter.host_of(F.col("url")).alias("host"), urlfilter.path_of(F.col("url")).alias("path")), many)
    held = {(r.host, r.path) for r in many.collect()}
    keys = hits = 0
    for r in rows.collect():
        mine = {(h, r.path[:n]) for h in (r.host, r.host[4:], "org") for n in (2, 3, 4, 5, 6) if n <= len(r.path)}
        possible = {tuple(k) for k in r["_possible"]}
        assert mine & held <= possible <= mine
        keys, hits = keys + len(mine - held), hits + len(possible - held)
    assert hits < 0.02 * keys
    plan = urlfilter.judge_urls(pages, many)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "a://x.com/")], "page_id long, url string")
    assert urlfilter.judge_urls(pages, rules(spark).limit(0)).collect()[0]["verdict"] == "allow"
    assert urlfilter.judge_urls(pages.limit(0), rules(spark)).count() == 0


def documents(spark):
    rows = []
    for source, n in (("a", 200), ("b", 40), ("c", 120), (None, 60), ("e", 1)):
        rows += [(len(rows) + i, "w " * ((i * 37) % 90), source, "k", 5) for i in range(n)]
    rows += [(None, "x y z", "a", "k", 5), (0, None, "b", "k", 5), (3, "", "b", "k", 5), (9, "r s", "c", "k", 5), (9, "r s", "c", "k", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copies string, target int").repartition(4)


def test_sources_come_near_their_targets(spark):
    docs = documents(spark)
    rows = mixing.mix_sizes(docs).collect()
    assert len(rows) == docs.count()
    total = sum(r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        target, words = own[0]["target"], own[0]["source_size"]
        assert words == sum(r["size"] for r in own) and target <= 2 * words + 1e-6
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
        if len(own) > 2:
            assert abs(sum(r["taken"] for r in own) - target) <= max(5, 0.01 * target)
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - 1.5 * total) < 1e-3


def test_reruns_and_copies_agree(spark):
    docs = documents(spark)
    def taken():
        return sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["taken"]) for r in mixing.mix_sizes(docs).collect())
    first = taken()
    assert first == taken()
    copies = mixing.mix_documents(docs)
    assert copies.columns == docs.columns
    assert copies.count() >= sum(1 for r in first if r[3])
    assert copies.select(mixing.words_in(copies.text).alias("n")).groupBy().sum("n").first()[0] == sum(r[3] for r in first)


def test_empty_table_and_one_without_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sizes(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix_sizes(blank).collect()] == [0, 0]
