"""Records by number and by header: the same rows as a search of all, and few rows read."""

import pytest
from pyspark.sql import functions as F

from readlake.sources import archive, lookup

N = 30_000
CONTENT = ["file", "rec", "header", "seq", "plus", "qual"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lookup") / "archive")
    header = F.when(F.col("id") % 1000 == 7, "same").when(F.col("id") % 1000 == 8, F.lit(None)).when(F.col("id") % 1000 == 9, F.concat(F.lit("ü "), "id")).otherwise(F.concat(F.lit("run."), "id", F.lit(" x:"), F.col("id") % 50))
    rows = spark.range(N).select(F.when(F.col("id") < N // 3, "a").otherwise("b").alias("file"), F.col("id").alias("rec"), header.alias("header"), F.lit("ACGT").alias("seq"), F.lit("+").alias("plus"), F.lit("IIII").alias("qual"))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.page.row.count.limit", "500")
    try:
        archive.write_archive(rows.repartition(3), path)
        lookup.index_headers(spark, path)
    finally:
        conf.unset("parquet.page.row.count.limit")
    return path


def read(spark, df):
    """The rows, and how many rows the scan of the records handed on."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return rows, sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_between(spark, stored):
    rows, scanned = read(spark, lookup.between(spark, stored, "b", 20_000, 20_099))
    assert sorted(r.rec for r in rows) == list(range(20_000, 20_100)) and scanned <= 1500
    assert lookup.between(spark, stored, "a", 20_000, 20_099).count() == 0
    assert lookup.between(spark, stored, "b", N - 5, N + 5).count() == 5


def test_find(spark, stored):
    whole = archive.read_archive(spark, stored)
    for wanted, most in ([["run.12345 x:45"], 6_000], [["run.12345 x:45", "ü 9", None, "nobody"], 12_000], [["same"], N], [["nobody"], 0], [[], 0], [[None], 0]):
        rows, scanned = read(spark, lookup.find(spark, stored, wanted))
        expected = whole.where(F.col("header").isin([w for w in wanted if w])).collect()
        assert sorted(rows) == sorted(expected) and scanned <= most, wanted
    assert lookup.find(spark, stored, ["same"]).count() == N // 1000


def test_find_beyond_blocks(spark, stored, monkeypatch):
    monkeypatch.setattr(lookup, "MOST_BLOCKS", 2)
    assert lookup.find(spark, stored, ["same"]).count() == N // 1000


def test_index_rows_read(spark, stored):
    index = spark.read.parquet(lookup._index(spark, stored))
    rows, scanned = read(spark, index.where(F.col("hash") == F.xxhash64(F.lit("run.12345 x:45"))))
    assert len(rows) == 1 and scanned <= 1000
    assert index.count() == N - N // 1000


def test_no_index_and_no_record(spark, tmp_path):
    path = str(tmp_path / "empty")
    none = spark.createDataFrame([], "file string, rec long, header string, seq string, plus string, qual string")
    archive.write_archive(none, path)
    with pytest.raises(ValueError, match="no index"):
        lookup.find(spark, path, ["x"])
    lookup.index_headers(spark, path)
    assert lookup.find(spark, path, ["x"]).count() == 0
    archive.write_archive(none.union(spark.createDataFrame([("a", 0, "x", "A", "+", "I")], none.schema)), path, overwrite=True)
    with pytest.raises(ValueError, match="no index"):
        lookup.find(spark, path, ["x"])
    lookup.index_headers(spark, path)
    assert [r.rec for r in lookup.find(spark, path, ["x"]).collect()] == [0]
