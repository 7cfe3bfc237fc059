"""The queries opN_<name> of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm import divergence, impact_index, inverted_index, langid, line_dedup, packing, resharding, simhash, simhash_neardup, suffix_tree, token_store, toxicity, url_filter
from readlake.llm.common import learning, table, written


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"), learning("doc_id", 5, 1))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.store_path(spark)
    token_store.write(table(spark, sf_dir, "documents"), store, tokenizer_path(), end_id=1)
    return token_store.read(spark, store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


#: The fixed rules of the URL query: (rule, host, path, verdict).
URL_RULES = [
    ("org/", "org", "/", "allow"),
    ("example.org/es/", "example.org", "/es/", "block"),
    ("example.org/en/1", "example.org", "/en/1", "block"),
    ("com/fr/", "com", "/fr/", "allow"),
    ("com/de/", "com", "/de/", "block"),
]
#: Labels of hosts whose pages' canonical URLs make up the listed URLs of the query.
LISTED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.host(F.col("url")), url_filter.path(F.col("url"))
    listed = pages.where(F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, LISTED_LABELS)))).select(F.concat(host, path).alias("url"))
    rules = spark.createDataFrame(URL_RULES, "rule string, host string, path string, verdict string")
    return url_filter.judge(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = learning("doc_id", 4, 2)
    model = langid.fit(docs, learn)
    return langid.predict(docs, model, [F.col("doc_id"), (~learn).alias("held_out")])


def op6_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inverted_index.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=13, one_in=20)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)
), hit AS (
  SELECT doc_id, i, k, item_id FROM grams JOIN win USING (k, g)
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = learning("doc_id", 5, 0)
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn)
    return toxicity.score(docs, scorer, [F.col("doc_id"), (~learn).alias("held_out")])


def op8_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = resharding.reshard(table(spark, sf_dir, "documents"), shards=24, old=F.col("doc_id") % 20)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return rows.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_near: other documents within 3 bits, searched in the permuted tables for every id divisible by 100."""
    found = written(simhash.edits(table(spark, sf_dir, "documents")), "prints")
    found = simhash.neighbours(found, F.col("id") % 100 == 0, radius=3)
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        hexed("fp").alias("fingerprint"),
        hexed("edited_fp").alias("edited_fingerprint"),
        simhash.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        simhash.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.col("near").alias("n_near"),
    )


def op10_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = impact_index.build(table(spark, sf_dir, "documents"))
    return impact_index.search(index, table(spark, sf_dir, "benchmark"), k=10).withColumnRenamed("id", "doc_id")


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), q AS (
  SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), len AS (SELECT rid, count(*) AS n FROM d GROUP BY rid),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM len),
m AS (SELECT rid, 25 + (75 * n * docs) // total AS m FROM len, s),
tf AS (SELECT rid, doc_id, term, count(*) AS tf FROM d SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
scored AS (
  SELECT item_id, rid, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY ALL
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = line_dedup.clean(docs, line_dedup.build(docs, least_chars=1), [F.col("doc_id")], least=10)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH l AS (
  SELECT rid, doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
), k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common c ON k.key = c.key GROUP BY rid
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=3, most=200)


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w,
         row_number() OVER () AS rid
  FROM documents
), t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
n AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (
  SELECT lang, source, coalesce(size, 0)::HUGEINT AS size, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS size FROM n GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) USING (lang)
), p AS (
  SELECT g.lang, g.source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (size + v) AS p
  FROM g JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (total + 1)) // (size + v) AS q
  FROM kept JOIN (SELECT lang, sum(size) AS size, max(v) AS v FROM g GROUP BY lang) USING (lang)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), term AS (
  SELECT p.lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT FROM term
) WHERE part = 'pair' OR rank <= 200
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL, "op6_inverted_index": OP6_SQL, "op11_impact_search": OP11_SQL, "op12_line_dedup": OP12_SQL, "op13_source_divergence": OP13_SQL}
