"""Registered queries over the plain tables, each with the SQL that checks it.

Reads are made of documents: the record number is the id, the sequence the text's base letters, the quality line its
printable characters, the header names source, id, language and length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.functions import columns as C
from readlake.operators import headers as H
from readlake.operators import inspect as I
from readlake.operators import models as M
from readlake.operators import reads as R
from readlake.operators import records as P
from readlake.operators import sparse as X
from readlake.operators.ordered import running_sum
from readlake.sources import archive, fastq, lookup, sink
from readlake.sources.scratch import scratch_path
from readlake.streaming.headers import KEPT, stream_encoded, stream_rebuilt
from readlake.streaming.ingest import drained

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (READS if "FROM reads" in sql or "JOIN reads" in sql else "") + sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def reads(spark: SparkSession, d: str, cut: bool = True) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    seq = F.upper(F.regexp_replace("text", "[^ACGTNacgtn]+", ""))  # only ASCII is left
    header = F.concat("source", F.lit("."), F.col("doc_id").cast("string"), F.lit(":"), "lang", F.lit(" length="), F.length(seq).cast("string"))
    qual = F.regexp_replace("text", "[^!-~]+", "")
    df = docs.select(F.col("doc_id").alias("rec"), "lang", "source", header.alias("header"), seq.alias("seq"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("+"), header)).otherwise("+").alias("plus"), qual.alias("qual"))
    return df.withColumn("qual", F.expr("substring(qual, 1, length(seq))")) if cut else df


READS = r"""WITH docs AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_replace(translate(coalesce(text, ''), 'acgtn', 'ACGTN'), '[^ACGTN]', '', 'g') AS seq,
         regexp_replace(coalesce(text, ''), '[^!-~]', '', 'g') AS fullqual FROM documents
), reads AS (
  SELECT doc_id AS rec, lang, source, source || '.' || doc_id || ':' || lang || ' length=' || length(seq) AS header, seq,
         CASE WHEN doc_id % 3 = 0 THEN '+' || source || '.' || doc_id || ':' || lang || ' length=' || length(seq) ELSE '+' END AS plus,
         fullqual[1:length(seq)] AS qual, fullqual FROM docs
)
"""
BASES = """, bases AS (
  SELECT rec, lang, pos - 1 AS pos, translate(seq[pos], 'ACGT', '0123') AS base, coalesce(CASE WHEN qual[pos] <> '' THEN ascii(qual[pos]) - 33 END, 7) AS q
  FROM (SELECT rec, lang, seq, qual, unnest(range(1, length(seq) + 1)) AS pos FROM reads)
)
"""


# ---- inspection ------------------------------------------------------------------------------------------------------
@query("SELECT b AS byte, count(*) AS n FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents) GROUP BY b")
def byte_histogram(spark, d):
    return I.byte_histogram(t(spark, d, "documents"), "text")


@query("""WITH d AS (SELECT encode(coalesce(text, '')) AS raw, coalesce(sum(octet_length(encode(coalesce(text, '')))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents),
b AS (SELECT unnest(regexp_extract_all(hex(raw)[1 : CAST(2 * least(octet_length(raw), 1000001 - before) AS BIGINT)], '..')) AS byte FROM d WHERE before < 1000001), c AS (SELECT byte, count(*) AS n FROM b GROUP BY byte)
SELECT row_number() OVER (ORDER BY n, byte) AS nth, byte, n, CAST((SELECT sum(n) FROM c) AS BIGINT) AS total, (SELECT count(*) FROM c) AS "distinct" FROM c""")
def byte_histogram_first(spark, d):
    return I.ranked_histogram(I.byte_histogram(t(spark, d, "documents"), "text", "doc_id", 1_000_001)).select("nth", "byte", "n", "total", "distinct")


@query("SELECT c AS char, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c")
def char_histogram(spark, d):
    return I.char_histogram(t(spark, d, "documents"), "text")


@query("SELECT CAST(max(length(l)) AS BIGINT) AS longest, count(*) AS lines FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)")
def longest_line(spark, d):
    lines = I.numbered_lines(t(spark, d, "documents"), "text", ["doc_id"])
    return lines.agg(F.max(F.length("line")).cast("long").alias("longest"), F.count("*").alias("lines"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents)
SELECT doc_id, count(*) AS lines, count(*) FILTER (a IS DISTINCT FROM b) AS differing, min(ln) FILTER (a IS DISTINCT FROM b) AS first
FROM (SELECT coalesce(x.doc_id, y.doc_id - 1) AS doc_id, coalesce(x.ln, y.ln) AS ln, x.line AS a, y.line AS b
      FROM l x FULL JOIN l y ON x.doc_id = y.doc_id - 1 AND x.ln = y.ln) GROUP BY doc_id""")
def line_diff(spark, d):
    lines = I.numbered_lines(t(spark, d, "documents"), "text", ["doc_id"])
    return I.line_diff(lines, lines.withColumn("doc_id", F.col("doc_id") - 1), ["doc_id"])


@query("""SELECT count(*) AS windows, count(DISTINCT w) AS distinct_windows FROM (SELECT seq[i : i + 11] AS w FROM (SELECT seq, unnest(range(1, length(seq) - 10)) AS i FROM reads))""")
def distinct_windows(spark, d):
    return I.distinct_windows(reads(spark, d), "seq", 12)


@query("""SELECT count(*) AS windows, count(DISTINCT w) AS distinct_windows FROM (SELECT seq[i : i + 75] AS w FROM (SELECT seq, unnest(range(1, length(seq) - 74)) AS i FROM reads))""")
def distinct_windows_76(spark, d):
    return I.distinct_windows(reads(spark, d), "seq", 76)


@query("""SELECT count(*) AS windows, count(DISTINCT least(w, reverse(translate(w, 'ACGT', 'TGCA')))) AS distinct_windows
FROM (SELECT seq[i : i + 30] AS w FROM (SELECT seq, unnest(range(1, length(seq) - 29)) AS i FROM reads))""")
def distinct_windows_canonical(spark, d):
    return I.distinct_windows(reads(spark, d), "seq", 31, canonical=True)


@query("""SELECT doc_id, CAST(1 AS BIGINT) AS left_rows, CASE WHEN doc_id % 101 = 7 THEN 0 ELSE 1 END AS right_rows,
CASE WHEN doc_id % 101 = 7 THEN NULL WHEN doc_id % 97 = 5 AND doc_id % 89 = 3 THEN 'text,lang' WHEN doc_id % 97 = 5 THEN 'text' ELSE 'lang' END AS changed
FROM documents WHERE doc_id % 101 = 7 OR doc_id % 97 = 5 OR doc_id % 89 = 3""")
def content_differences(spark, d):
    """All of documents against a copy that lacks some rows and has others changed."""
    one = t(spark, d, "documents").select("doc_id", "text", "lang")
    changed = lambda c, k, r: F.when(F.col("doc_id") % k == r, F.concat(F.coalesce(c, F.lit("")), F.lit("!"))).otherwise(F.col(c)).alias(c)
    two = one.where("doc_id % 101 <> 7").select("doc_id", changed("text", 97, 5), changed("lang", 89, 3))
    return I.differences(one, two, ["text", "lang"], [], "doc_id").select("doc_id", "left_rows", F.col("right_rows").cast("int").alias("right_rows"), F.array_join("changed", ",").alias("changed"))


@query("SELECT source AS key, arg_min(lang, doc_id) AS value FROM documents GROUP BY source")
def info_first_wins(spark, d):
    return I.first_wins(t(spark, d, "documents"), "source", F.col("lang"), "doc_id")


@query("SELECT row_number() OVER (ORDER BY key) AS nth, key, value FROM (SELECT source AS key, arg_min(lang, doc_id) AS value FROM documents GROUP BY source)")
def info_dump(spark, d):
    from pyspark.sql import Window

    return info_first_wins(spark, d).select(F.row_number().over(Window.orderBy("key")).cast("long").alias("nth"), "key", "value")


STREAMS = """, s AS (
  SELECT 'rec' AS stream, count(header) AS n, CAST(sum(strlen(header)) AS BIGINT) AS bytes FROM reads UNION ALL SELECT 'gen', count(seq), CAST(sum(strlen(seq)) AS BIGINT) FROM reads
  UNION ALL SELECT 'qlt', count(qual), CAST(sum(strlen(qual)) AS BIGINT) FROM reads UNION ALL SELECT 'usr.x', 0, 0 FROM reads WHERE false
), p AS (SELECT *, CAST(ceil(bytes / 8192) AS BIGINT) AS pages FROM s WHERE bytes > 0),
z AS (SELECT *, CAST(CASE WHEN pages > 1 THEN ceil((pages - 1) / 2047) ELSE 0 END AS BIGINT) AS nodes, bytes - (pages - 1) * 8192 AS last FROM p)
"""


def _streams(spark, d):
    return I.stream_sizes(reads(spark, d), {"rec": F.col("header"), "gen": F.col("seq"), "qlt": F.col("qual"), "usr.x": F.lit(None).cast("string")})


@query(STREAMS + "SELECT stream, n, bytes, pages, nodes, last FROM z")
def stream_directory(spark, d):
    return _streams(spark, d)


@query(STREAMS + "SELECT CAST(2 + sum(pages + nodes) AS BIGINT) AS pages, CAST(8192 * (2 + sum(pages + nodes)) AS BIGINT) AS bytes FROM z")
def container_pages(spark, d):
    return I.container_bytes(_streams(spark, d))


@query("SELECT lang, count(*) AS n, count(*) FILTER (n_chars = length(text)) AS right_size FROM documents GROUP BY lang")
def size_verification(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") == F.length("text")).alias("right_size"))


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN starts_with(text, 'whoami=') THEN 'archive'
WHEN starts_with(text, '@') THEN 'fastq' ELSE 'other' END AS kind FROM (SELECT text FROM documents UNION ALL SELECT '@' || header FROM reads)) GROUP BY kind""")
def sniff_type(spark, d):
    texts = t(spark, d, "documents").select("text").unionByName(reads(spark, d).select(F.concat(F.lit("@"), "header").alias("text")))
    return texts.groupBy(C.file_type(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


# ---- sources ---------------------------------------------------------------------------------------------------------
@query("SELECT header, md5('@' || header || chr(10) || seq || chr(10) || plus || chr(10) || qual) AS md5, CAST(NULL AS VARCHAR) AS problem FROM reads")
def fastq_source(spark, d):
    """Reads written as FASTQ files and read back by the data source, in ranges that cut them anywhere."""
    path = scratch_path(spark, "fastq")
    fastq.write_fastq(reads(spark, d).withColumn("file", F.lit("reads")), path)
    text = P.record_text(F.col("header"), F.col("seq"), F.col("plus"), F.col("qual"))
    return fastq.read_fastq(spark, path, split=1 << 20).select("header", F.md5(text.cast("binary")).alias("md5"), "problem")


@query("SELECT source || '.fq' AS name, header, md5('@' || header || chr(10) || seq || chr(10) || plus || chr(10) || qual) AS md5 FROM reads")
def fastq_sink(spark, d):
    """Reads written in place, one file for each source, and read back."""
    r, path = reads(spark, d).withColumn("file", F.col("source")), scratch_path(spark, "sink")
    names = r.select("file").distinct().select("file", F.concat("file", F.lit(".fq")).alias("name"), F.lit(True).alias("ended"))
    sink.write_whole(r, names, path)
    text = P.record_text(F.col("header"), F.col("seq"), F.col("plus"), F.col("qual"))
    return fastq.read_fastq(spark, path, split=1 << 20).select(fastq.file_name(F.col("file")).alias("name"), "header", F.md5(text.cast("binary")).alias("md5"))


@query("SELECT rec, header, md5(seq) AS seq FROM reads WHERE header IN (SELECT header FROM reads ORDER BY length(seq) DESC, rec LIMIT 10)")
def archive_lookup(spark, d):
    """The ten longest reads, found in the archive of all by their headers."""
    r, path = reads(spark, d).withColumn("file", F.col("source")), scratch_path(spark, "archive")
    archive.write_archive(r.select("file", "rec", "header", "seq", "plus", "qual"), path)
    lookup.index_headers(spark, path)
    longest = [x["header"] for x in r.orderBy(F.desc(F.length("seq")), "rec").limit(10).select("header").collect()]
    return lookup.find(spark, path, longest).select("rec", "header", F.md5(F.col("seq").cast("binary")).alias("seq"))


@query("SELECT source AS file, rec, md5(header || chr(10) || seq || chr(10) || plus || chr(10) || qual) AS md5 FROM reads")
def archive_roundtrip(spark, d):
    """Reads, a file for each source, through the typed archive."""
    path = scratch_path(spark, "archive")
    archive.write_archive(reads(spark, d).select(F.col("source").alias("file"), "rec", "header", "seq", "plus", "qual"), path)
    return archive.read_archive(spark, path).select("file", "rec", F.md5(F.concat_ws("\n", "header", "seq", "plus", "qual").cast("binary")).alias("md5"))


@query("""SELECT l_orderkey AS rec, l_linenumber AS nth, md5('L' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ' ' || l_suppkey || '/' || l_returnflag) AS header, md5(seq) AS seq
FROM (SELECT *, translate(md5(l_orderkey || '.' || l_partkey), '0123456789abcdef', 'ACGTACGTACGTACGT') || CASE WHEN l_linenumber = 3 THEN 'NNn' ELSE '' END || translate(md5(CAST(l_suppkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM lineitem)""")
def typed_columns(spark, d):
    """Headers and sequences of the kind that sequencers write, coded and decoded."""
    kept = archive.typed(sequencer_reads(t(spark, d, "lineitem")))
    return archive.restored(kept).select("rec", F.col("file").cast("int").alias("nth"), F.md5(F.col("header").cast("binary")).alias("header"), F.md5(F.col("seq").cast("binary")).alias("seq"))


def sequencer_reads(items: DataFrame) -> DataFrame:
    """(file, rec, header, seq, plus, qual): a read for each item, all of nearly the same length, headers that count up."""
    text = lambda c: F.col(c).cast("string")
    bases = lambda c: F.translate(F.md5(c.cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    header = F.concat(F.lit("L"), text("l_orderkey"), F.lit(":"), text("l_linenumber"), F.lit(":"), text("l_partkey"), F.lit(" "), text("l_suppkey"), F.lit("/"), "l_returnflag")
    seq = F.concat(bases(F.concat(text("l_orderkey"), F.lit("."), text("l_partkey"))), F.when(F.col("l_linenumber") == 3, "NNn").otherwise(""), bases(text("l_suppkey")))
    d = items.select(text("l_linenumber").alias("file"), F.col("l_orderkey").alias("rec"), header.alias("header"), seq.alias("seq"), F.lit("+").alias("plus"))
    return d.withColumn("qual", F.translate(F.regexp_replace("seq", "[ACG]", "I"), "TNn", "F##"))


# ---- records ---------------------------------------------------------------------------------------------------------
@query("""SELECT doc_id, rec, CASE WHEN n < 4 THEN 'truncated' WHEN h[1] <> '@' THEN 'no @' WHEN p[1] <> '+' THEN 'no +' END AS problem FROM (
  SELECT doc_id, ln // 4 AS rec, count(*) AS n, max(line) FILTER (ln % 4 = 0) AS h, max(line) FILTER (ln % 4 = 2) AS p
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents) GROUP BY doc_id, ln // 4)""")
def parse_records(spark, d):
    return P.parse(I.numbered_lines(t(spark, d, "documents"), "text", ["doc_id"]), ["doc_id"]).select("doc_id", "rec", "problem")


@query(r"""WITH r AS (
  SELECT doc_id, ln // 4 AS rec, count(*) AS k, max(line) FILTER (ln % 4 = 0) AS h, max(line) FILTER (ln % 4 = 1) AS s, max(line) FILTER (ln % 4 = 2) AS p, max(line) FILTER (ln % 4 = 3) AS q
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents) GROUP BY doc_id, ln // 4
), c AS (SELECT *, CASE WHEN h[1] = '@' THEN h[2:] ELSE h END AS name FROM r),
x AS (SELECT list_filter([
  CASE WHEN k < 4 THEN 'truncated' END, CASE WHEN k = 4 AND h[1] <> '@' THEN 'no @' END, CASE WHEN p[1] <> '+' THEN 'no +' END,
  CASE WHEN p[1] = '+' AND trim(p[2:]) <> '' AND p[2:] <> name THEN 'odd second id' END, CASE WHEN regexp_matches(s, '[^0-3ACGTacgt.Nn]') THEN 'illegal base' END,
  CASE WHEN len(list_distinct(regexp_extract_all(s, '[Nn.]'))) > 1 THEN 'mixed unknowns' END, CASE WHEN length(s) <> length(q) THEN 'length mismatch' END,
  CASE WHEN length(regexp_replace(name, '[0-9A-Za-z]', '', 'g')) > 64 THEN 'many delimiters' END], lambda v: v IS NOT NULL) AS problems FROM c)
SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(problems) = 0 THEN ['none'] ELSE problems END) AS reason FROM x) GROUP BY reason""")
def record_problems(spark, d):
    """Lines of documents taken for records: nearly all are bad, in many ways at once."""
    return P.problem_counts(P.parse(I.numbered_lines(t(spark, d, "documents"), "text", ["doc_id"]), ["doc_id"]))


@query("SELECT rec, md5('@' || header || chr(10) || seq || chr(10) || plus || chr(10) || qual) AS md5, true AS same FROM reads")
def fastq_format_roundtrip(spark, d):
    r = reads(spark, d)
    text = r.select("rec", P.record_text(F.col("header"), F.col("seq"), F.col("plus"), F.col("qual")).alias("text"))
    back = P.parse(I.numbered_lines(text, "text", ["rec"]).withColumnRenamed("rec", "file"), ["file"])
    back = back.select(F.col("file").alias("rec"), P.record_text(F.col("header"), F.col("seq"), F.col("plus"), F.col("qual")).alias("again"))
    return text.join(back, "rec").select("rec", F.md5(F.col("text").cast("binary")).alias("md5"), (F.col("text") == F.col("again")).alias("same"))


@query("""SELECT source, arg_min(CAST(length(seq) AS BIGINT), rec) AS llen, arg_min(trim(plus[2:]) <> '', rec) AS second_id,
coalesce(arg_min(flag, rec) FILTER (flag IS NOT NULL), false) AS color_space
FROM (SELECT *, CASE WHEN regexp_extract(seq[2:], '[0-3ACGTacgt]') <> '' THEN regexp_matches(regexp_extract(seq[2:], '[0-3ACGTacgt]'), '[0-3]') END AS flag FROM reads) GROUP BY source""")
def first_record_inference(spark, d):
    return P.inferred(reads(spark, d), ["source"])


@query("SELECT rec, trim(plus[2:]) <> '' AS second_id FROM reads")
def second_id_flag(spark, d):
    return reads(spark, d).select("rec", C.second_id(F.col("plus")).alias("second_id"))


@query("SELECT lang, length(header) >= 30 OR length(seq) >= 500 OR length(qual) >= 500 AS oversized, count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS bases FROM reads GROUP BY ALL")
def oversized_split(spark, d):
    large = C.oversized(F.col("header"), F.col("seq"), F.col("qual"), 30, 500)
    return reads(spark, d).groupBy("lang", large.alias("oversized")).agg(F.count("*").alias("n"), F.sum(F.length("seq")).cast("long").alias("bases"))


@query("SELECT row_number() OVER (ORDER BY rec) AS nth, rec, md5(header || seq || qual) AS md5, length(header) >= 30 OR length(seq) >= 500 OR length(qual) >= 500 AS oversized FROM reads")
def oversized_merge(spark, d):
    """Each record's digest and part are kept once: splitting, the ranges' sample, counts of blocks and rows all read them."""
    large = C.oversized(F.col("header"), F.col("seq"), F.col("qual"), 30, 500)
    slim, path = reads(spark, d).select("rec", F.md5(F.concat("header", "seq", "qual").cast("binary")).alias("md5"), large.alias("oversized")), scratch_path(spark, "merge")
    slim.write.parquet(path)
    both = P.merged(*P.split_by(spark.read.schema(slim.schema).parquet(path), F.col("oversized")))
    return running_sum(both, F.lit(1).cast("long"), "nth", ["rec"]).select("nth", "rec", "md5", "oversized")


@query("SELECT rec, md5(header || chr(10) || seq || chr(10) || qual) AS md5 FROM reads")
def column_rezip(spark, d):
    r = reads(spark, d)
    parts = [r.select("rec", c) for c in ("header", "seq", "qual")]
    j = parts[0].join(parts[2], "rec").join(parts[1], "rec")
    return j.select("rec", F.md5(F.concat_ws("\n", "header", "seq", "qual").cast("binary")).alias("md5"))


# ---- headers ---------------------------------------------------------------------------------------------------------
def _urls(spark, d):
    return t(spark, d, "pages").select(F.col("page_id").alias("rec"), F.col("url").alias("header"))


@query("SELECT page_id AS rec, generate_subscripts(s, 1) - 1 AS slot, unnest(s) AS token FROM (SELECT page_id, regexp_split_to_array(url, '[^0-9A-Za-z]') AS s FROM pages)")
def header_tokens(spark, d):
    return H.tokens(_urls(spark, d)).withColumn("slot", F.col("slot").cast("long"))


@query("SELECT page_id AS rec, regexp_replace(url, '[0-9A-Za-z]', '', 'g') AS signature FROM pages")
def header_signature(spark, d):
    return _urls(spark, d).select("rec", C.header_signature(F.col("header")).alias("signature"))


@query("""SELECT rec, signature, header FROM (SELECT *, lag(signature) OVER (ORDER BY rec) AS p, row_number() OVER (ORDER BY rec) AS k
FROM (SELECT page_id AS rec, url AS header, regexp_replace(url, '[0-9A-Za-z]', '', 'g') AS signature FROM pages)) WHERE k > 1 AND signature IS DISTINCT FROM p""")
def header_shape_change(spark, d):
    return H.shape_changes(_urls(spark, d))


@query("SELECT source, arg_min(header, rec) AS header FROM reads GROUP BY source")
def first_header(spark, d):
    return reads(spark, d).groupBy("source").agg(F.min_by("header", "rec").alias("header"))


@query("""SELECT rec, CAST((i - 1) // 32 AS BIGINT) AS word, CAST(sum(CASE WHEN tok IS DISTINCT FROM ptok THEN CAST(1 AS BIGINT) << CAST((i - 1) % 32 AS BIGINT) ELSE 0 END) AS BIGINT) AS changed FROM (
  SELECT rec, i, s[i] AS tok, p[i] AS ptok FROM (SELECT rec, s, p, unnest(range(1, len(s) + 1)) AS i FROM (
    SELECT page_id AS rec, regexp_split_to_array(url, '[^0-9A-Za-z]') AS s, lag(regexp_split_to_array(url, '[^0-9A-Za-z]')) OVER (ORDER BY page_id) AS p FROM pages))) GROUP BY ALL""")
def token_change_bitmap(spark, d):
    return H.change_bitmap(_urls(spark, d)).withColumn("word", F.col("word").cast("long"))


TYPED = """WITH h AS (
  SELECT page_id AS rec, url, regexp_replace(url, '[0-9A-Za-z]', '', 'g') AS sig FROM pages UNION ALL SELECT c_custkey + 1000000000, c_name, regexp_replace(c_name, '[0-9A-Za-z]', '', 'g') FROM customer
), f AS (SELECT *, coalesce(sig IS DISTINCT FROM lag(sig) OVER (ORDER BY rec), true) OR lag(rec) OVER (ORDER BY rec) IS NULL AS fresh FROM h),
k AS (SELECT rec, fresh, rec // 65536 AS block, generate_subscripts(s, 1) - 1 AS slot, unnest(s) AS token FROM (SELECT rec, fresh, regexp_split_to_array(url, '[^0-9A-Za-z]') AS s FROM f)),
o AS (SELECT *, CASE WHEN regexp_matches(token, '^(0|0?[1-9][0-9]{0,17})$') THEN 'dec' WHEN regexp_matches(token, '^0?([1-9a-f][0-9a-f]{0,14}|[1-9A-F][0-9A-F]{0,14})$') THEN 'hex' ELSE 'str' END AS own FROM k),
e AS (SELECT *, sum(CASE WHEN fresh OR own = 'str' THEN 1 ELSE 0 END) OVER (PARTITION BY block, slot ORDER BY rec ROWS UNBOUNDED PRECEDING) AS session FROM o),
a AS (SELECT *, coalesce(max(CAST(own = 'hex' AS INT)) OVER (PARTITION BY block, slot, session ORDER BY rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AND length(token) <= 15 AS after_hex FROM e),
y AS (SELECT *, CASE WHEN own = 'dec' AND after_hex THEN 'hex' ELSE own END AS kind FROM a),
types AS (SELECT *, kind <> 'str' AND length(token) > 1 AND token[1] = '0' AS zero,
  CASE WHEN kind = 'dec' THEN CAST(token AS BIGINT) WHEN kind = 'hex' THEN CAST('0x' || token AS BIGINT) END AS number FROM y)
"""


def _types(spark, d):
    names = t(spark, d, "customer").select((F.col("c_custkey") + 1_000_000_000).alias("rec"), F.col("c_name").alias("header"))
    return H.typed(_urls(spark, d).unionByName(names))


@query(TYPED + "SELECT rec, CAST(slot AS BIGINT) AS slot, token, kind, zero, CAST(number AS VARCHAR) AS number FROM types")
def token_type(spark, d):
    return _types(spark, d).select("rec", F.col("slot").cast("long").alias("slot"), "token", "kind", "zero", F.col("number").cast("string").alias("number"))


@query(
    TYPED
    + """SELECT rec, CAST(slot AS BIGINT) AS slot, kind, number < cached AS less, abs(number - cached) AS delta FROM (
  SELECT *, lag(token) OVER (PARTITION BY block, slot ORDER BY rec) AS before,
    coalesce(last_value(CASE WHEN kind <> 'str' THEN number END IGNORE NULLS) OVER (PARTITION BY block, slot, session ORDER BY rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cached FROM types)
WHERE kind <> 'str' AND before IS DISTINCT FROM token"""
)
def token_delta(spark, d):
    return H.deltas(_types(spark, d)).withColumn("slot", F.col("slot").cast("long"))


@query(TYPED + "SELECT CAST(slot AS BIGINT) AS slot, count(*) AS n, CAST(sum(strlen(token)) AS BIGINT) AS bytes FROM types WHERE kind = 'str' GROUP BY slot")
def token_literals(spark, d):
    return _types(spark, d).where("kind = 'str'").groupBy(F.col("slot").cast("long").alias("slot")).agg(F.count("*").alias("n"), F.sum(F.octet_length("token")).cast("long").alias("bytes"))


@query("SELECT c_custkey AS rec, c_name AS header FROM customer")
def header_reconstruction_names(spark, d):
    return H.rebuilt(H.encoded(t(spark, d, "customer").select(F.col("c_custkey").alias("rec"), F.col("c_name").alias("header"))))


@query("SELECT page_id AS rec, url AS header FROM pages")
def header_reconstruction(spark, d):
    return H.rebuilt(H.encoded(_urls(spark, d)))


@query("SELECT page_id AS rec, url AS header FROM pages")
def header_stream_reconstruction(spark, d):
    # as a pattern: the table may be one file or a folder of files of any name
    pages = spark.readStream.schema(t(spark, d, "pages").schema).parquet(f"{d}/pages.parque[t]")
    drained(stream_encoded(pages.withColumn("file", F.lit("pages")), "url", order="page_id"), path := scratch_path(spark, "headers"))
    kept = spark.readStream.schema(KEPT).parquet(f"{path}/rows")
    return drained(stream_rebuilt(kept), f"{path}/back").select("rec", "header")


# ---- bases -----------------------------------------------------------------------------------------------------------
@query("SELECT lang, code, count(*) AS n FROM (SELECT lang, unnest(string_split(translate(seq, 'ACGT', '0123'), '')) AS code FROM reads) WHERE code <> '' GROUP BY ALL")
def base_codes(spark, d):
    return reads(spark, d).select("lang", F.explode(R.letters(C.base_codes(F.col("seq")))).alias("code")).groupBy("lang", "code").agg(F.count("*").alias("n"))


@query("SELECT rec, md5(replace(seq, 'N', 'A')) AS md5 FROM reads")
def base_decoding(spark, d):
    return reads(spark, d).select("rec", F.md5(C.decoded_bases(C.imputed(C.base_codes(F.col("seq")))).cast("binary")).alias("md5"))


@query("SELECT rec, seq[1:1] AS prefix_base, qual[1:1] AS prefix_quality, md5(seq[2:] || qual[2:]) AS md5 FROM reads")
def color_prefix_strip(spark, d):
    return reads(spark, d).select("rec", F.substring("seq", 1, 1).alias("prefix_base"), F.substring("qual", 1, 1).alias("prefix_quality"), F.md5(F.expr("concat(substring(seq, 2), substring(qual, 2))").cast("binary")).alias("md5"))


KIND = "CASE WHEN base = 'N' AND q = 0 THEN 'implied' WHEN base = 'N' THEN 'Ns' WHEN q = 0 THEN 'Nn' ELSE 'plain' END"


@query(BASES + f"SELECT kind, base, count(*) AS n, CAST(sum(q) AS BIGINT) AS q FROM (SELECT *, {KIND} AS kind FROM bases) GROUP BY ALL")
def unknown_reconcile(spark, d):
    return R.reconciled(reads(spark, d)).groupBy("kind", "base").agg(F.count("*").alias("n"), F.sum("q").cast("long").alias("q"))


@query(BASES + "SELECT rec, pos, base FROM bases WHERE base = 'N' OR q = 0")
def unknown_restore(spark, d):
    e = R.exceptions(reads(spark, d).where(F.length("seq") > 0))
    return R.odd_bases(R.restored_bases(e))  # codes, qualities and lists of a record are one row: nothing is shuffled


@query(
    BASES
    + """, firsts AS (SELECT rec, 1 + coalesce(sum(length(seq)) OVER (ORDER BY rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM reads)
SELECT CAST(ordinal AS BIGINT) AS ordinal, CAST(ordinal - coalesce(lag(ordinal) OVER (ORDER BY ordinal), 0) AS BIGINT) AS gap FROM (SELECT first + pos AS ordinal FROM bases JOIN firsts USING (rec) WHERE base = 'N' AND q <> 0)"""
)
def unknown_gaps(spark, d):
    places, path = R.unknown_places(reads(spark, d)), scratch_path(spark, "sizes")
    slim = places.select("rec", "n", F.when(F.size("ns") > 0, F.element_at("ns", -1)).alias("last"))
    slim.write.parquet(path)  # a few bytes a record, which are read several times
    return R.place_gaps(places, spark.read.schema(slim.schema).parquet(path))


@query("SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '[^0-3ACGTacgt.Nn]')) AS illegal FROM documents GROUP BY lang")
def illegal_base_check(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(C.has_illegal_base(F.col("text"))).alias("illegal"))


@query("SELECT source, count(DISTINCT c) AS spellings, count(DISTINCT c) <= 1 AS uniform FROM (SELECT source, unnest(regexp_extract_all(text, '[Nn.]')) AS c FROM documents) GROUP BY source")
def uniform_unknown_check(spark, d):
    c = t(spark, d, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit("[Nn.]"), F.lit(0))).alias("c"))
    return c.groupBy("source").agg(F.countDistinct("c").alias("spellings")).withColumn("uniform", F.col("spellings") <= 1)


def _context_sql(k: int) -> str:
    return f"""SELECT g[1:{k}] AS ctx, g[{k + 1}:{k + 1}] AS sym, count(*) AS n FROM (
  SELECT s[i : i + {k}] AS g FROM (SELECT s, unnest(range(1, length(s) - {k} + 1)) AS i FROM (SELECT '{R.first_context(k)}' || translate(seq, 'ACGTN', '01230') AS s FROM reads))) GROUP BY ALL"""


@query(_context_sql(2))
def base_context_k(spark, d):
    return R.base_contexts(reads(spark, d), 2)


@query(_context_sql(9))
def base_context_level1(spark, d):
    return R.base_contexts(reads(spark, d), R.LEVEL_ORDERS[1])


@query(_context_sql(11))
def base_context_level2(spark, d):
    return R.base_contexts(reads(spark, d), R.LEVEL_ORDERS[2])


@query(_context_sql(12))
def base_context_level3(spark, d):
    return R.base_contexts(reads(spark, d), R.LEVEL_ORDERS[3])


@query(_context_sql(13))
def base_context_level4(spark, d):
    return R.base_contexts(reads(spark, d), R.LEVEL_ORDERS[4])


# ---- qualities -------------------------------------------------------------------------------------------------------
QUALS = """, quals AS (
  SELECT *, coalesce(lag(q, 1) OVER w, 0) AS q1, coalesce(lag(q, 2) OVER w, 0) AS q2, coalesce(lag(q, 3) OVER w, 0) AS q3
  FROM (SELECT rec, lang, pos, ascii(qual[pos]) - 33 AS q FROM (SELECT rec, lang, qual, unnest(range(1, length(qual) + 1)) AS pos FROM reads)) WINDOW w AS (PARTITION BY rec ORDER BY pos)
)
"""


def _contexts(spark, d, level):
    return R.quality_contexts(reads(spark, d), level).groupBy(F.col("ctx").cast("long").alias("ctx"), F.col("q").cast("long").alias("q")).agg(F.count("*").alias("n"))


@query(QUALS + "SELECT CAST((q1 | (q2 << 6)) & 4095 AS BIGINT) AS ctx, CAST(q AS BIGINT) AS q, count(*) AS n FROM quals GROUP BY ALL")
def qual_context_l1(spark, d):
    return _contexts(spark, d, 1)


@query(QUALS + "SELECT CAST((q1 | (q2 << 6) | (q3 << 12)) & 65535 AS BIGINT) AS ctx, CAST(q AS BIGINT) AS q, count(*) AS n FROM quals GROUP BY ALL")
def qual_context_l2(spark, d):
    return _contexts(spark, d, 2)


@query(
    QUALS
    + """SELECT CAST(CASE WHEN pos = 1 THEN 0 ELSE (q1 | (greatest(q2, q3) << 6) | (CAST(q2 = q3 AS INT) << 12) | (least(7, (5 + fallen) >> 3) << 13)) & 65535 END AS BIGINT) AS ctx, CAST(q AS BIGINT) AS q, count(*) AS n
FROM (SELECT *, CAST(coalesce(sum(CASE WHEN pos > 1 THEN greatest(0, q1 - q) ELSE 0 END) OVER (PARTITION BY rec ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS fallen FROM quals) GROUP BY ALL"""
)
def qual_context_l3(spark, d):
    return R.quality_context_counts(reads(spark, d))


@query(QUALS + "SELECT lang, count(*) AS n, count(*) FILTER (q >= 63) AS escaped, CAST(sum(least(q, 63)) AS BIGINT) AS symbols FROM quals GROUP BY lang")
def qual_escape(spark, d):
    q = reads(spark, d).select("lang", F.transform(R.letters(F.col("qual")), lambda c: C.quality(c)).alias("q")).where(F.size("q") > 0)
    escaped, symbols = F.filter("q", lambda x: x >= C.ESCAPE), F.aggregate(F.transform("q", lambda x: C.quality_symbol(x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return q.groupBy("lang").agg(F.sum(F.size("q")).cast("long").alias("n"), F.sum(F.size(escaped)).cast("long").alias("escaped"), F.sum(symbols).cast("long").alias("symbols"))


@query("SELECT rec, length(seq) > length(qual) AS short, CAST(greatest(0, length(seq) - length(qual)) AS BIGINT) AS missing FROM reads")
def qual_missing_default(spark, d):
    r = reads(spark, d)
    return r.select("rec", (F.length("seq") > F.length("qual")).alias("short"), F.greatest(F.lit(0), F.length("seq") - F.length("qual")).cast("long").alias("missing"))


@query("SELECT rec, md5(qual) AS md5 FROM reads")
def qual_inverse(spark, d):
    q = F.transform(R.letters(F.col("qual")), lambda c: C.quality(c))
    return reads(spark, d).select("rec", F.md5(F.array_join(F.transform(q, lambda x: F.chr(x + C.QUALITY_ZERO)), "").cast("binary")).alias("md5"))


# ---- models ----------------------------------------------------------------------------------------------------------
def _cost(df, model):
    """Cost of each context of rows (ctx, sym), from their counts."""
    return M.adaptive_cost(df.groupBy("ctx", "sym").agg(F.count("*").alias("n")), model, ["ctx"]).select("ctx", "n", F.round("bits", 3).alias("bits"))


def _adaptive_sql(source: str, ctx: str, sym: str, m: M.Adaptive, order: str) -> str:
    return f"""SELECT ctx, count(*) AS n, round(sum(-log2(({m.start} + {m.step} * hits) / ({m.start * m.symbols} + {m.step} * seen))), 3) AS bits FROM (
  SELECT ctx, count(*) OVER (PARTITION BY ctx, sym ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hits, count(*) OVER (PARTITION BY ctx ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM (SELECT {ctx} AS ctx, {sym} AS sym, {order} FROM {source})) GROUP BY ctx"""


@query(BASES + ", b AS (SELECT rec, pos, translate(base, 'N', '0') AS sym, coalesce(translate(lag(base) OVER (PARTITION BY rec ORDER BY pos), 'N', '0'), '" + R.first_context(1) + "') AS ctx FROM bases)\n" + _adaptive_sql("b", "ctx", "sym", M.BASE, "rec, pos"))
def adaptive_cost_base(spark, d):
    grams = R.base_contexts(reads(spark, d), 1)
    return M.adaptive_cost(grams, M.BASE, ["ctx"]).select("ctx", "n", F.round("bits", 3).alias("bits"))


@query(QUALS + _adaptive_sql("quals", "CAST(q1 AS BIGINT)", "least(q, 63)", M.QUALITY, "rec, pos"))
def adaptive_cost_qual(spark, d):
    return _cost(R.qualities(reads(spark, d)).select(F.col("q1").cast("long").alias("ctx"), C.quality_symbol(F.col("q")).alias("sym")), M.QUALITY)


@query(
    "WITH e AS (SELECT event_id, pos, ascii(event_type[pos]) AS b, CAST(least(pos, 4) AS BIGINT) AS ctx FROM (SELECT event_id, event_type, unnest(range(1, length(event_type) + 1)) AS pos FROM events))\n"
    + _adaptive_sql("e", "ctx", "b", M.BYTE, "event_id, pos")
)
def adaptive_cost_bytes(spark, d):
    e = t(spark, d, "events").select("event_id", F.posexplode(R.letters(F.col("event_type"))).alias("p", "c"))
    return _cost(e.select(F.least(F.col("p") + 1, F.lit(4)).cast("long").alias("ctx"), F.ascii("c").alias("sym")), M.BYTE)


@query()
def adaptive_cost_halved(spark, d):
    """Halving depends on the order, so no SQL: tests hold it against a sequential model. One context for each language."""
    r = reads(spark, d).select("rec", "lang", F.transform(R.letters(C.imputed(C.base_codes(F.col("seq")))), lambda c: c.cast("int")).alias("s"))
    return M.halved_cost(r, M.BASE, ["rec"], "lang", "s")


@query()
def adaptive_cost_halved_qual(spark, d):
    r = reads(spark, d).select("rec", "lang", F.transform(R.letters(F.col("qual")), lambda c: C.quality_symbol(C.quality(c)).cast("int")).alias("s"))
    return M.halved_cost(r, M.QUALITY, ["rec"], "lang", "s")


@query()
def adaptive_cost_halved_bytes(spark, d):
    r = reads(spark, d).select("rec", "source", F.transform(R.letters(F.col("header")), lambda c: F.ascii(c).bitwiseAND(F.lit(255))).alias("s"))
    return M.halved_cost(r, M.BYTE, ["rec"], "source", "s")


@query("""WITH c AS (SELECT lang, c, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY ALL)
SELECT lang, CAST(sum(n) AS BIGINT) AS n, round(sum(-(n / t) * log2(n / t)), 6) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS t FROM c) GROUP BY lang""")
def static_entropy(spark, d):
    c = t(spark, d, "documents").select("lang", F.explode(R.letters(F.col("text"))).alias("c")).groupBy("lang", "c").agg(F.count("*").alias("k"))
    return M.static_entropy(c, ["lang"], "c", "k").withColumn("bits", F.round("bits", 6))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey <= 127 THEN 1 WHEN o_orderkey < 32766 THEN 2 WHEN o_orderkey < 4294967296 THEN 6 ELSE 10 END AS key_len,
CASE WHEN cents <= 127 THEN 1 WHEN cents < 32766 THEN 2 WHEN cents < 4294967296 THEN 6 ELSE 10 END AS cents_len FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 100) AS BIGINT) AS cents FROM orders)""")
def varint_unsigned_len(spark, d):
    cents = F.floor(F.col("o_totalprice") * 100).cast("long")
    return t(spark, d, "orders").select("o_orderkey", C.varint_length(F.col("o_orderkey")).alias("key_len"), C.varint_length(cents).alias("cents_len"))


@query("""SELECT c_custkey, CASE WHEN v BETWEEN -125 AND 127 THEN 1 WHEN v BETWEEN -32768 AND 32767 THEN 3 WHEN v BETWEEN -2147483648 AND 2147483647 THEN 5 ELSE 9 END AS len
FROM (SELECT c_custkey, CAST(floor(c_acctbal * (c_custkey % 7)) AS BIGINT) AS v FROM customer)""")
def varint_signed_len(spark, d):
    v = F.floor(F.col("c_acctbal") * (F.col("c_custkey") % 7)).cast("long")
    return t(spark, d, "customer").select("c_custkey", C.signed_varint_length(v).alias("len"))


@query("SELECT event_id // 8 AS byte, CAST(sum(CASE WHEN value > 50 THEN 1 << CAST(event_id % 8 AS INT) ELSE 0 END) AS BIGINT) AS value FROM events GROUP BY ALL")
def bit_pack(spark, d):
    return M.packed_bits(t(spark, d, "events"), F.col("value") > 50, "event_id")


# ---- change points and exceptions ------------------------------------------------------------------------------------
def _events(spark, d):
    return t(spark, d, "events").select(F.col("event_id").alias("rec"), "event_type", "user_id")


@query("SELECT rec, gap, value FROM (SELECT *, rec - coalesce(lag(rec) OVER (ORDER BY rec), 0) AS gap FROM (SELECT rec, value, row_number() OVER (ORDER BY rec) = 1 OR value IS DISTINCT FROM lag(value) OVER (ORDER BY rec) AS c FROM (SELECT rec, CAST(length(seq) AS BIGINT) AS value FROM reads)) WHERE c)")
def length_change_points(spark, d):
    r = reads(spark, d).select("rec", F.length("seq").cast("long").alias("len"))
    return X.gaps(X.change_points(r, F.col("len")))


@query("SELECT rec, rec - coalesce(lag(rec) OVER (ORDER BY rec), 0) AS gap, value FROM (SELECT rec, CAST(length(fullqual) AS BIGINT) AS value FROM reads WHERE length(fullqual) <> length(seq))")
def qual_len_exceptions(spark, d):
    r = reads(spark, d, cut=False)
    return X.exceptions(r, F.length("qual").cast("long"), F.length("seq").cast("long")).select("rec", "gap", "value")


STICKY = "SELECT event_id AS rec, event_type AS value FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) AS c FROM events) WHERE c"


@query(STICKY)
def sticky_prefix_changes(spark, d):
    return X.change_points(_events(spark, d), F.col("event_type"))


@query("SELECT user_id, event_id AS rec, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS gap FROM events")
def gap_encode(spark, d):
    return X.gaps(_events(spark, d), "rec", ["user_id"]).select("user_id", "rec", "gap")


@query("SELECT user_id, event_id AS ordinal FROM events")
def gap_decode(spark, d):
    g = gap_encode(spark, d).withColumnRenamed("rec", "idx")
    return X.ordinals(g, "idx", ["user_id"]).select("user_id", F.col("ordinal").cast("long").alias("ordinal"))


@query("SELECT event_id AS rec, event_type AS value FROM events")
def asof_replay(spark, d):
    e = _events(spark, d)
    return X.replayed(e.select("rec"), X.change_points(e, F.col("event_type"))).select("rec", "value")


@query("SELECT rec, CAST(sum(length(seq)) OVER (ORDER BY rec) AS BIGINT) AS upto FROM reads")
def base_ordinal(spark, d):
    return running_sum(reads(spark, d).select("rec", F.length("seq").cast("long").alias("n")), F.col("n"), "upto", ["rec"]).select("rec", F.col("upto").cast("long").alias("upto"))


@query(BASES + """SELECT * FROM (SELECT 'usr.lgen' AS stream, count(*) AS n FROM reads WHERE length(seq) >= 500 UNION ALL SELECT 'usr.x.q', count(*) FROM reads WHERE length(fullqual) <> length(seq)
UNION ALL SELECT 'gen.Ns', count(*) FROM bases WHERE base = 'N' AND q <> 0 UNION ALL SELECT 'gen.Nn', count(*) FROM bases WHERE base <> 'N' AND q = 0 UNION ALL SELECT 'usr.pfg', 0 FROM reads WHERE false) WHERE n > 0""")
def lazy_exception_streams(spark, d):
    r = reads(spark, d)
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stream"), "n")
    kinds = R.reconciled(r).where("kind in ('Ns', 'Nn')").groupBy(F.concat(F.lit("gen."), "kind").alias("stream")).agg(F.count("*").alias("n"))
    long = reads(spark, d, cut=False)
    return kinds.unionByName(n(r.where(F.length("seq") >= 500), "usr.lgen")).unionByName(n(long.where(F.length("qual") != F.length("seq")), "usr.x.q")).where("n > 0")
