"""FASTQ files written in place by many tasks: the same bytes, whole files or none."""

import os

import pytest
from pyspark.sql import functions as F

from readlake.sources import fastq, sink

SCHEMA = "file string, rec long, header string, seq string, plus string, qual string, name string"


def made(n, tag):
    return [(tag, i, f"{tag}.{i}é", "ACGT" * ((i + 1) % 7), "+", "@III" * ((i + 1) % 7), "clash") for i in range(n)]


def text(rows, ended=True):
    whole = "".join("\n".join(["@" + r[2], *r[3:6]]) + "\n" for r in rows)
    return (whole if ended else whole[:-1]).encode()


@pytest.fixture
def files():
    return {"a": made(500, "a"), "b": made(37, "b"), "c": made(1, "c")}


def names(spark, odd=()):
    return spark.createDataFrame([(k, f"sub/{k} 1.fq" if k == "b" else f"{k}.fq", k not in odd) for k in "abc"], "file string, name string, ended boolean")


def test_same_bytes(spark, tmp_path, files):
    rows = spark.createDataFrame([r for rs in files.values() for r in rs], SCHEMA).repartition(5)
    out = tmp_path / "out put"
    sink.write_whole(rows, names(spark, "bc"), str(out), block=16)
    assert (out / "a.fq").read_bytes() == text(files["a"])
    assert (out / "sub/b 1.fq").read_bytes() == text(files["b"], False)
    assert (out / "c.fq").read_bytes() == text(files["c"], False)
    assert sorted(os.listdir(out)) == ["a.fq", "c.fq", "sub"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sink.placed(rows, names(spark), 16).where("name = 'a.fq'").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = fastq.read_fastq(spark, str(out), recursive=True)
    assert back.count() == 538 and back.where("problem is not null").count() == 0
    with pytest.raises(Exception, match="exists already"):
        sink.write_whole(rows, names(spark), str(out))
    assert (out / "c.fq").read_bytes() == text(files["c"], False) and not [f for f in os.listdir(out) if f.startswith(".")]
    sink.write_whole(rows, names(spark), f"file://{str(out).replace(' ', '%20')}", overwrite=True)
    assert (out / "c.fq").read_bytes() == text(files["c"])


def test_failed_job_leaves_nothing(spark, tmp_path, files):
    late = F.when(F.col("rec") == 499, F.raise_error(F.lit("lost"))).otherwise(F.col("qual"))
    rows = spark.createDataFrame(files["a"], SCHEMA).drop("name").withColumn("qual", late)
    (tmp_path / "out").mkdir()
    with pytest.raises(Exception, match="lost"):
        sink.write_whole(rows, names(spark), str(tmp_path / "out"), block=16)
    assert os.listdir(tmp_path / "out") == []


def test_task_tried_again(tmp_path):
    """Two attempts of a task, one of which died on the way, and tasks in any order."""
    import pyarrow as pa

    w = sink._Writer(str(tmp_path / "x"), False)
    batch = lambda rows: iter([pa.RecordBatch.from_pylist([{"name": "f", "at": at, "rec": 0, "value": v} for at, v in rows])])

    def dies():
        yield from batch([(3, "de")])
        raise OSError("executor lost")

    with pytest.raises(OSError):
        w.write(dies())
    second = w.write(batch([(3, "de"), (3, "f"), (6, "gh")]))
    first = w.write(batch([(0, "abc")]))
    w.commit([second, first, None])
    assert (tmp_path / "x/f").read_text() == "abcdefgh" and os.listdir(tmp_path / "x") == ["f"]


def test_missing_block_and_odd_places(spark, tmp_path, files):
    import pyarrow as pa

    w = sink._Writer(str(tmp_path / "x"), False)
    told = w.write(iter([pa.RecordBatch.from_pylist([{"name": "f", "at": 3, "rec": 0, "value": "de"}])]))
    with pytest.raises(ValueError, match="not the file's"):
        w.commit([told])
    assert os.listdir(tmp_path / "x") == []
    with pytest.raises(ValueError, match="mounted"):
        sink._Writer("s3://bucket/x", False)
    with pytest.raises(ValueError, match="not a place"):
        w._place("../y")
    none = spark.createDataFrame([], SCHEMA)
    sink.write_whole(none, names(spark), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
