import bz2
import gzip
import random

import pytest
from pyspark.sql import functions as F
from test_sources import ODD, make

from readlake.operators.records import parse
from readlake.sources import datasource as D
from readlake.sources import fastq as Q

FIELDS = ["rec", "header", "seq", "plus", "qual", "problem"]


def plain(df):
    return sorted(map(tuple, df.select(F.element_at(F.split("file", "/"), -1).alias("f"), *FIELDS).collect()), key=str)


def slow(text):
    """Records by counting lines."""
    lines = text.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    out = []
    for k in range(0, len(lines), 4):
        h, s, p, q = (lines[k : k + 4] + [None] * 4)[:4]
        problem = "truncated" if q is None else "no @" if not h.startswith("@") else "no +" if not p.startswith("+") else None
        out.append((k // 4, h.removeprefix("@"), s, p, q, problem))
    return out


def tricky(n, seed=1):
    """Well-formed records whose quality lines begin with @ or +, with lines of any length."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        k = rnd.choice([1, 2, 7, 30, 90])
        out.append(f"@r{i}\n{''.join(rnd.choice('ACGTN') for _ in range(k))}\n+{'r' * (i % 3)}\n{rnd.choice('@+I') + 'x' * (k - 1)}\n")
    return "".join(out)


MALFORMED = "@a\nAC\n+\nII\nb\nAC\n+\nII\n\n\n\n\n@c\nAC\n-\nII\n@d\nAC\n"
TEXTS = {"a.fq": make(60, 1), "b.fq": ODD, "c.fq": MALFORMED, "d.fq": tricky(80), "e.fq": "@x\nA\n+\nI", "f.fq": "", "g.fq": "\n", "h.fq": "@\n" + "A" * 3000 + "\n+\n" + "@" * 3000 + "\n@z\nA\n+\nI\n"}


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for name, text in TEXTS.items():
        (d / name).write_bytes(text.encode())
    return d


def test_any_range_size(folder):
    """Whatever the size of the ranges, records are those that counting lines gives, each once."""
    for name, text in TEXTS.items():
        for split in [1, 2, 3, 5, 17, 64, 1000, 1 << 20]:
            ranges = D.cut([(str(folder / name), len(text.encode()))], split)
            ends = D.settled(ranges, {c[0]: c[1:] for c in map(D.count, ranges)})
            rows = [r for x in ranges for b in D.records(x) for r in b.to_pylist()]
            assert [tuple(r[f] for f in FIELDS) for r in rows] == slow(text)
            raw = text.encode()
            assert all(r["problem"] in ("no @", "truncated") or raw[r["at"] :].startswith(b"@" + r["header"].encode() + b"\n") for r in rows)
            assert not text or ends[str(folder / name)] == text.endswith("\n")


def test_by_content(tmp_path):
    """Without line numbers, ranges of well-formed files find their first record, past quality lines that look like headers."""
    for text in (tricky(200), tricky(200, 3), make(50, 4), tricky(3), tricky(1)):
        (tmp_path / "x.fq").write_text(text)
        for split in (1, 7, 50, 333, 5000):
            ranges = D.cut([(str(tmp_path / "x.fq"), len(text))], split)
            for r in ranges:
                r.lines, r.begins = (0, True) if r.start == 0 else (None, False)
            rows = [r for x in ranges for b in D.records(x) for r in b.to_pylist()]
            assert [tuple(r[f] for f in FIELDS[1:]) for r in rows] == [r[1:] for r in slow(text)]


def test_small_reads(folder, monkeypatch):
    monkeypatch.setattr(D, "READ", 11)
    monkeypatch.setattr(D, "TAIL", 3)
    test_any_range_size(folder)


@pytest.mark.parametrize("split", [100, 1 << 26])
def test_source(spark, folder, split):
    """The same rows as lines that are numbered and grouped, and no exchange in the plan."""
    got = Q.read_fastq(spark, str(folder), split=split)
    assert plain(got) == plain(parse(Q.read_lines(spark, str(folder)), ["file"]))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.rdd.getNumPartitions() > 20 if split == 100 else got.rdd.getNumPartitions() == 1
    Q.register(spark)
    direct = spark.read.format("fastq").option("split", split).load(str(folder / "d.fq"))
    assert sorted(r.header for r in direct.collect()) == sorted(r[1] for r in slow(TEXTS["d.fq"]))


def test_compressed(spark, tmp_path):
    """Block-compressed files are read by several tasks, others by one; the last line's end is known of all."""
    text = tricky(3000)
    d = tmp_path / "in"
    d.mkdir()
    (d / "blocks.fq.gz").write_bytes(D.block_compressed(text.encode(), 4000))
    (d / "one.fq.gz").write_bytes(gzip.compress(text.encode()[:-1]))
    (d / "two.fq.bz2").write_bytes(bz2.compress(text.encode()))
    found = Q.layout(spark, str(d), split=3000)
    per_file = {name: sum(r.file.endswith(name) for r in found.ranges) for name in ("blocks.fq.gz", "one.fq.gz", "two.fq.bz2")}
    assert per_file["blocks.fq.gz"] > 5 and per_file["one.fq.gz"] == per_file["two.fq.bz2"] == 1
    assert {f.rsplit("/", 1)[1]: e for f, e in found.ends.items()} == {"blocks.fq.gz": True, "one.fq.gz": False, "two.fq.bz2": True}
    got = Q.read_records(spark, found)
    assert gzip.decompress((d / "blocks.fq.gz").read_bytes()).decode() == text
    for name in per_file:
        assert sorted(tuple(r) for r in got.where(F.col("file").endswith(name)).select(*FIELDS).collect()) == slow(text)
    assert got.where(F.col("file").endswith("blocks.fq.gz")).select(F.spark_partition_id()).distinct().count() > 1


def test_growing_file(spark, tmp_path):
    """Files that grow between triggers, cut anywhere; a stream that starts again goes on where it ended; no record twice."""
    Q.register(spark)
    text, other = tricky(120), make(50, 9)
    d = tmp_path / "in"
    d.mkdir()
    rnd = random.Random(2)
    cuts = sorted(rnd.randrange(len(text)) for _ in range(4)) + [len(text)]

    def run():
        stream = spark.readStream.format("fastq").option("split", 300).load(str(d))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    for i, at in enumerate(cuts):
        (d / "a.fq").write_text(text[:at])
        if i == 2:
            (d / "b.fq").write_text(other)
        run()
        rows = spark.read.parquet(str(tmp_path / "out")).where(F.col("file").endswith("a.fq")).collect()
        whole = text[:at].count("\n") // 4
        assert sorted((r.at, r.header, r.seq, r.qual) for r in rows) == [(x, *r[1:3], r[4]) for x, r in zip(starts(text), slow(text)[:whole], strict=False)]
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 170


def starts(text):
    at = [0]
    lines = text.split("\n")
    for k in range(0, len(lines) - 4, 4):
        at.append(at[-1] + sum(len(x) + 1 for x in lines[k : k + 4]))
    return at


def test_last_record_end(tmp_path, monkeypatch):
    monkeypatch.setattr(D, "TAIL", 40)
    for text in (tricky(60), make(30, 5)):
        (tmp_path / "x.fq").write_text(text)
        ends = starts(text)
        for size in range(0, len(text) + 1, 13):
            assert D.last_record_end(str(tmp_path / "x.fq"), 0, size) == max(e for e in ends if e <= size)
