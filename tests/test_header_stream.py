"""Headers of a stream: equal to the batch operators for any cut into micro-batches, and back to the same headers."""

import random

import pytest
from pyspark.sql import functions as F

from readlake.operators import headers as H
from readlake.streaming.headers import KEPT, stream_encoded, stream_rebuilt

ROWS = "file string, rec long, header string, header_ string"


def headers(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        k = rnd.random()
        if k < 0.04:
            out.append(None)
        elif k < 0.08:
            out.append(rnd.choice(["", "::", "odd one", "x/1", "ü:7:ß", "9" * 30 + ":1"]))
        elif k < 0.12:
            out.append(".".join(str(i + j) for j in range(70)))
        else:
            tile = rnd.choice(["1101", "0a1f", "12", "AB", "00", "07", "aB", "str"])
            out.append(f"{rnd.choice(['run', 'RUN7'])}.{i} {tile}:{rnd.randrange(20)}:{rnd.choice(['f', '1e', '10', '2', '9' * 16])}/1")
    return out


def batches(rows, cuts):
    edges = [0, *sorted(cuts), len(rows)]
    return [rows[a:b] for a, b in zip(edges, edges[1:], strict=False) if b > a]


def streamed(spark, folder, parts, schema, make):
    """The rows that a stream gives, one micro-batch a part; it is stopped and started again before every part."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        source = spark.readStream.schema(schema).parquet(str(folder / "in"))
        q = make(source).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "mark")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None, i
    return spark.read.parquet(str(folder / "out"))


def plain(rows):
    return sorted((r.file or "", r.rec, r.header, r.changed, r.entries and [tuple(e) for e in r.entries]) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_batch_and_back(spark, tmp_path, seed):
    rnd = random.Random(seed)
    files = {"a": headers(150, seed), None: headers(40, seed + 9)}
    rows = [(f, i, h, "clash") for f, hs in files.items() for i, h in enumerate(hs)]
    expected = []
    for f, hs in files.items():
        table = spark.createDataFrame(list(enumerate(hs)), "rec long, header string")
        expected += H.encoded(table, block=32).withColumn("file", F.lit(f)).collect()
    parts = batches(rows, [rnd.randrange(len(rows)) for _ in range(3)])
    for part in parts:
        rnd.shuffle(part)
    kept = streamed(spark, tmp_path, parts, ROWS, lambda s: stream_encoded(s, block=32)).collect()
    assert plain(kept) == plain(expected)
    again = sorted(kept, key=lambda r: (r.file or "", r.rec))
    parts = batches([tuple(r) for r in again], [rnd.randrange(len(again)) for _ in range(2)])
    (tmp_path / "back").mkdir()
    back = streamed(spark, tmp_path / "back", parts, KEPT, lambda s: stream_rebuilt(s, block=32)).collect()
    assert sorted((r.file or "", r.rec, r.header) for r in back) == sorted((f or "", i, h) for f, i, h, _ in rows)


def test_empty_and_late(spark, tmp_path):
    assert streamed(spark, tmp_path, [[("a", 5, "x.1", None)]], ROWS, stream_encoded).collect()[0].header == "x.1"
    with pytest.raises(Exception, match="record 5 comes after record 5"):
        streamed(spark, tmp_path, [[("a", 5, "x.1", None)]], ROWS, stream_encoded)


def test_no_number(spark, tmp_path):
    with pytest.raises(Exception, match="a record has no number"):
        streamed(spark, tmp_path, [[("a", None, "x.1", None)]], ROWS, stream_encoded)


@pytest.mark.parametrize("parts", [1, 3])
def test_query_reads_folders_too(spark, tmp_path, parts):
    """A table may be a folder of files of any name, as well as one file."""
    from readlake.plans.queries import QUERIES

    rows = [(i, f"http://a.org/x{i}/7") for i in range(40)]
    spark.createDataFrame(rows, "page_id long, url string").repartition(parts).write.parquet(str(tmp_path / "pages.parquet"))
    if parts == 1:
        (tmp_path / "one").mkdir()
        next((tmp_path / "pages.parquet").glob("part-*")).rename(tmp_path / "one/pages.parquet")
    found = QUERIES["header_stream_reconstruction"](spark, str(tmp_path / "one" if parts == 1 else tmp_path))
    assert sorted(map(tuple, found.collect())) == rows
