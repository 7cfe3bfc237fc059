import random

import pytest
from pyspark.sql import functions as F

from readlake.operators.inspect import file_sizes
from readlake.sources import archive as A
from readlake.sources import fastq as Q
from readlake.streaming.ingest import stream_profile, stream_records

ODD = "@h 1\nACGTN\n+\n!!II~\n@h 1\n\n+other text\n\n@x:\xe9 0123\nacgt.\n+x:\xe9 0123\n@@@@@\n@last\r\nTTTT\n+last\r\nIIII\n"


def make(records, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(records):
        n = rnd.randrange(0, 90)
        h = f"run{rnd.randrange(3)}.{i}:{rnd.randrange(999):x}/{rnd.randrange(2)}"
        q = "".join(chr(rnd.randrange(33, 110)) for _ in range(n))
        out.append(f"@{h}\n{''.join(rnd.choice('ACGTN') for _ in range(n))}\n+{h if i % 2 else ''}\n{q}\n")
    return "".join(out)


@pytest.fixture
def files(tmp_path):
    d = tmp_path / "in"
    (d / "deep").mkdir(parents=True)
    texts = {"a.fq": make(700, 1), "b.fastq": ODD, "deep/c.fq": make(40, 2)}
    for name, text in texts.items():
        (d / name).write_bytes(text.encode())
    return d, texts


def back(path):
    return b"".join(p.read_bytes() for p in sorted(path.glob("part-*"), key=lambda p: p.name.split("-")[1]))


@pytest.mark.parametrize("split", ["128m", "1k"])
def test_lines_are_numbered_over_splits(spark, files, split):
    d, texts = files
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = Q.read_lines(spark, str(d / "a.fq")).orderBy("ln").collect()
        assert [r.ln for r in rows] == list(range(len(rows)))
        assert "".join(r.line + "\n" for r in rows) == texts["a.fq"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_round_trip(spark, files, tmp_path):
    d, texts = files
    for level in (1, 4):
        arc, out = str(tmp_path / f"arc{level}"), tmp_path / f"out{level}"
        A.compress(spark, str(d), arc, level, recursive=True)
        A.decompress(spark, arc, str(out))
        for name, text in texts.items():
            assert back(out / f"file={name.replace('/', '%2F')}") == text.encode()
    kept = {r.key: r.value for r in A.info(spark, arc).collect()}
    of = lambda key, name: next(v for k, v in kept.items() if k.startswith(f"{key}:") and k.endswith(f"{d}/{name}"))
    assert kept["config.level"] == "4" and of("num_records", "a.fq") == "700" and of("rec.first", "b.fastq") == "h 1"
    assert {r.stream for r in A.streams(spark, arc).collect()} == {"rec", "gen", "qlt", "usr.plus"}
    assert A.stream(spark, arc, "usr.plus").count() == 1 and A.stream(spark, arc, "none").count() == 0
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        A.compress(spark, str(d), arc, recursive=True)
    A.compress(spark, str(d / "a.fq"), arc, overwrite=True)
    assert A.read_archive(spark, arc).count() == 700


def test_every_byte_comes_back(spark, tmp_path):
    """Files of one name, without a final line feed, and with bytes that are no UTF-8."""
    cases = {"x/r.fq": b"@a\nAC\n+\nII", "y/r.fq": b"@b\nAC\n+\nI~\n@c\nGG\n+c\nIJ", "z/r.fq": b"@\xff\xfe\nAC\n+\nII\n", "r.fq": make(300, 7).encode()[:-1], "one.fq": b"@a\nA\n+\nI"}
    for name, body in cases.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(body)
    A.compress(spark, str(tmp_path / "in"), str(tmp_path / "arc"), recursive=True)
    A.decompress(spark, str(tmp_path / "arc"), str(tmp_path / "out"))
    for name, body in cases.items():
        assert back(tmp_path / "out" / f"file={name.replace('/', '%2F')}") == body
    assert len(list((tmp_path / "out").glob("file=*"))) == len(cases)


def test_verify(spark, files, tmp_path):
    d, _ = files
    arc = str(tmp_path / "arc")
    A.compress(spark, str(d), arc, glob="*.fq")
    A.verify(spark, arc)
    extra = spark.read.parquet(f"{arc}/records").limit(1)
    extra.write.mode("append").parquet(f"{arc}/records")
    with pytest.raises(ValueError, match="sizes"):
        A.read_archive(spark, arc)
    newer = spark.createDataFrame([("version", "99")], "key string, value string")
    newer.write.mode("overwrite").parquet(f"{arc}/info")
    with pytest.raises(ValueError, match="newer"):
        A.verify(spark, arc)


def test_contents_are_verified(spark, files, tmp_path):
    """One changed character of equal size is found and told; archives are compared by their digests first."""
    d, _ = files
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    A.compress(spark, str(d / "a.fq"), one)
    A.compress(spark, str(d / "a.fq"), two)
    assert A.compare(spark, one, two).count() == 0
    rows = A.read_archive(spark, one)
    changed = rows.withColumn("qual", F.when(F.col("rec") == 345, F.concat(F.lit("#"), F.expr("substring(qual, 2)"))).otherwise(F.col("qual"))).cache()
    assert changed.where("rec = 345 and length(qual) > 0 and qual like '#%'").count() == 1
    A.write_archive(changed, str(tmp_path / "three"))
    assert [(r.rec, r.left_rows, r.right_rows, r.changed) for r in A.compare(spark, one, str(tmp_path / "three")).collect()] == [(345, 1, 1, ["qual"])]
    spark.read.parquet(str(tmp_path / "three/records")).write.mode("overwrite").parquet(f"{two}/records")
    A.verify(spark, two, contents=False)
    with pytest.raises(ValueError, match="contents differ.*a.fq:0"):
        A.verify(spark, two)
    fewer = rows.where("rec <> 7").unionByName(rows.where("rec = 9"))
    A.write_archive(fewer, str(tmp_path / "four"))
    assert sorted((r.rec, r.left_rows, r.right_rows, r.changed) for r in A.compare(spark, one, str(tmp_path / "four")).collect()) == [(7, 1, 0, None), (9, 1, 2, None)]


def test_typed_columns(spark, tmp_path):
    """Sequences are packed and headers split where that is smaller and exact; nulls and odd records keep their text."""
    rnd = random.Random(8)
    seqs = ["".join(rnd.choices("ACGT", k=100)) for _ in range(50)] + [None, "", "N" * 50, "acgt" * 20, "ACGT" * 20 + "N", "\xe9" * 20]
    rows = [("f", i, f"SRR1.{i} HWI:7:{i // 9}:{rnd.randrange(2000)}/1" if i != 3 else "h\xe9", s, "+" if i % 2 else None, None if s is None else "I" * len(s)) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "file string, rec long, header string, seq string, plus string, qual string")
    A.write_archive(df, str(tmp_path / "arc"))
    stored = spark.read.parquet(str(tmp_path / "arc/records"))
    assert stored.where("bases is not null").count() == 51 and stored.where("header is not null").count() == 1
    assert stored.where("n1 = 17").count() == 1 and stored.schema["n1"].dataType.simpleString() == "bigint"
    assert sorted(map(tuple, A.read_archive(spark, str(tmp_path / "arc")).collect())) == sorted(rows)
    A.write_archive(df.limit(0), str(tmp_path / "none"))
    assert A.read_archive(spark, str(tmp_path / "none")).count() == 0


def test_bad_records_and_modes(spark, tmp_path):
    p = tmp_path / "bad.fq"
    p.write_text("@a\nAC\n+\nII\nb\nAC\n+\nII\n@c\nAC\n-\nII\n@d\nAC\n")
    got = {r.rec: r.problem for r in Q.read_fastq(spark, str(p)).collect()}
    assert got == {0: None, 1: "no @", 2: "no +", 3: "truncated"}
    assert Q.read_fastq(spark, str(p), "DROPMALFORMED").count() == 1
    with pytest.raises(Exception, match="bad record"):
        Q.read_fastq(spark, str(p), "FAILFAST").collect()


def test_small_files(spark, tmp_path):
    (tmp_path / "fa").mkdir()
    (tmp_path / "fa/x.fa").write_text(">one\nACGNT\nnn\n>two\nGG\nA*C\n")
    assert [(r.seq, r.illegal) for r in Q.read_fasta(spark, str(tmp_path / "fa/x.fa")).orderBy("ln").collect()] == [("ACGT", False), ("GG", False), ("A*C", True)]
    (tmp_path / "fa/y.fq").write_text("@a\nA\n+\nI\n")
    kinds = {r.file.rsplit("/", 1)[-1]: r.kind for r in Q.sniffed(spark, str(tmp_path / "fa")).collect()}
    assert kinds == {"x.fa": "other", "y.fq": "fastq"}
    sizes = {r.file.rsplit("/", 1)[-1]: r.mb for r in file_sizes(spark.read.format("binaryFile").load(str(tmp_path / "fa"))).collect()}
    assert set(sizes) == {"x.fa", "y.fq"}
    (tmp_path / "none.fq").write_text("")
    assert Q.read_fastq(spark, str(tmp_path / "none.fq")).count() == 0


def test_stream(spark, files, tmp_path):
    d, texts = files
    drop, out, mark = tmp_path / "drop", str(tmp_path / "table"), str(tmp_path / "mark")
    drop.mkdir()
    for name in ("a.fq", "b.fastq"):
        (drop / name).write_bytes((d / name).read_bytes())
        stream_records(spark, str(drop), out, mark).awaitTermination(120)
    (drop / "none.fq").write_text("")
    stream_records(spark, str(drop), out, mark).awaitTermination(120)
    rows = spark.read.parquet(out)
    want = Q.read_fastq(spark, [str(d / "a.fq"), str(d / "b.fastq")])
    plain = lambda df: sorted(tuple(r) for r in df.select(F.element_at(F.split("file", "/"), -1), "rec", "header", "seq", "plus", "qual", "problem").collect())
    assert plain(rows) == plain(want) and rows.count() == 704


def test_stream_profile(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=7 * i), i % 5, "ab"[i % 2], float(i), "") for i in range(100)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events"))
    q = stream_profile(spark, str(tmp_path / "events")).writeStream.format("memory").queryName("profile").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.window.start, r.event_type): (r.n, r.total) for r in spark.table("profile").collect()}
    want = {}
    for _, ts, _, kind, value, _ in rows:
        key = (ts.replace(minute=0), kind)
        n, total = want.get(key, (0, 0.0))
        want[key] = (n + 1, total + value)
    assert got == want
