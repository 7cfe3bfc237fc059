import re

from pyspark.sql import functions as F

from readlake.llm import queries as Q
from readlake.llm import url_filter as U

URLS = [None, "", "no scheme", "http://", "://x", "HTTP://Foo.ORG/es/1", "https://a.b.example.org/en/12?q", "https://example.org/es/", "http://example.org/es", "http://x.com/fr/1#a", "http://x.com/de/1", "http://notexample.org/en/1", "http://org/", "http://org", "http://y.net/p", "http://spam-farm.z.net/q?x=1", "http://a://b/c", "http://h\n.org/x", "http://y.net/p", "http://bigx.net/" + "p" * 40_000]


def judged(url, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fit = [r for r in Q.URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fit, key=lambda r: len(r[0]), default=None)
    return host, path, best and best[0], best[3] if best else "block" if host + path in listed else "allow"


def rows(spark, urls):
    return spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")


def test_against_brute_force(spark):
    listed = ["y.net/p", "y.net/p", None, "never.seen/x", "spam-farm.z.net/q"]
    rules = spark.createDataFrame(Q.URL_RULES, "rule string, host string, path string, verdict string")
    out = U.judge(rows(spark, URLS), rules, spark.createDataFrame([(x,) for x in listed], "url string"))
    assert sorted(out.columns) == sorted(["page_id", "url", "host", "path", "rule", "verdict"])
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {i: judged(u, set(listed)) for i, u in enumerate(URLS)}


def test_empty_lists_and_table(spark):
    none = spark.createDataFrame([], "rule string, host string, path string, verdict string")
    empty = spark.createDataFrame([], "url string")
    assert {r.verdict for r in U.judge(rows(spark, URLS), none, empty).collect()} == {"allow"}
    assert U.judge(rows(spark, []), none, empty).count() == 0


def test_bloom_misses_nothing_and_passes_little(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom = U.bloom_blocks(keys, 63)
    probes = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    got = {r.key for r in U.possible(probes, bloom, 63).collect()}
    assert {f"k{i}" for i in range(2000)} <= got
    assert len(got) < 2000 + 0.02 * 18_000


def test_no_python_in_the_plan(spark, tmp_path):
    rows(spark, URLS).select("page_id", "url").write.parquet(str(tmp_path / "pages.parquet"))
    plan = Q.op3_url_filter(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
