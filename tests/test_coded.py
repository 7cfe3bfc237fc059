import random
import time

import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readlake.functions import coded as K


def through(spark, seqs, headers):
    df = spark.createDataFrame([(i, s, h) for i, (s, h) in enumerate(zip(seqs, headers, strict=True))], "i int, seq string, header string")
    ascii_ = df.where(F.col("seq").rlike("^[!-~]*$") & K.typable(F.col("header")))
    kept = ascii_.select("i", "seq", "header", K.packed_sequence(F.col("seq")).alias("p"), K.typed_header(F.col("header")).alias("t"))
    kept = kept.select("i", "seq", "header", "p", F.col("t.marks").alias("h_marks"), F.col("t.split.words").alias("h_words"), *[F.get("t.split.numbers", F.lit(k)).alias(f"h_n{k}") for k in range(K.SLOTS)])
    back = kept.select("i", "seq", "header", "p", K.sequence_of(F.col("p.bases"), F.col("p.n"), F.col("p.odd")).alias("s"), K.header_of({c[2:]: F.col(c) for c in kept.columns if c[:2] == "h_"}).alias("h"))
    return back.where("length(s) >= 0 and length(h) >= 0").collect()


def test_round_trip(spark):
    rnd = random.Random(4)
    seqs = ["", "A", "N", "ACGT" * 7, "ACGT" * 7 + "A", "NNACGTNN", "acgtACGTNnN.", "T" * 57, "0123", "A" * 28 + "N"]
    seqs += ["".join(rnd.choices("ACGTNa.", weights=[9, 9, 9, 9, 1, 1, 1], k=rnd.randrange(200))) for _ in range(200)]
    heads = ["", "x", "7", "007", "SRR1.25 HWI:7:0:1/1 length=100", "..", " a ", "1" * 18, "1" * 19, "a1 2b", ":" * 40, ".".join(map(str, range(30)))]
    heads += ["".join(rnd.choices("01234567890ab:. /=_-~", k=rnd.randrange(60))) for _ in range(len(seqs) - len(heads))]
    rows = through(spark, seqs, heads)
    assert len(rows) == len(seqs) and all(r.s == r.seq and r.h == r.header for r in rows)
    assert all(len(r.p.bases) == -(-len(r.seq) // 28) * 7 for r in rows)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ACGTNn.~!", max_size=90), st.text(st.characters(min_codepoint=32, max_codepoint=126), max_size=50)), min_size=1, max_size=20))
def test_any_text(spark, rows):
    assert all(r.s == r.seq and r.h == r.header for r in through(spark, *zip(*rows, strict=True)))


def test_long_and_odd(spark):
    """A million bases with many odd stretches take seconds, also with filters pushed below; nulls stay null."""
    seq = ("ACGT" * 20 + "NNn") * 12_000
    began = time.time()
    assert through(spark, [seq], ["h"])[0].s == seq
    assert time.time() - began < 60
    df = spark.createDataFrame([(None, None), ("\xffé", "hé"), ("ACGTACGTACGTACGTN", "a b"), ("NA" * 20, "x"), ("ACGT", "")], "seq string, header string")
    assert [(r[0], r[1]) for r in df.select(K.packable(F.col("seq")), K.typable(F.col("header"))).collect()] == [(False, False), (False, False), (False, True), (False, True), (False, True)]
    assert df.select(K.packed_sequence(F.col("seq"))["bases"], K.typed_header(F.col("header"))["marks"]).first()[:] == (None, None)


def test_layout_in_slices(monkeypatch):
    """What is stored, spelled out; the same from slices of a few records, with nulls and empty ones at their edges."""
    text = lambda x: pa.array(x, pa.string())
    seqs = text([None, "", "ACGT", "NNACGTN", None, "T" * 29, "", "N"])
    zeros = b"\0" * 6
    want = [(None, None, None), (b"", 0, None), (b"\x1b" + zeros, 4, None), (b"\x01\xb0" + zeros[1:], 7, [{"at": 0, "run": "NN"}, {"at": 6, "run": "N"}]), (None, None, None)]
    want += [(b"\xff" * 7 + b"\xc0" + zeros, 29, None), (b"", 0, None), (b"\0" + zeros, 1, [{"at": 0, "run": "N"}])]
    heads = text(["", None, "a1.7:007", "1" * 18 + "/" + "1" * 19, ":", ".".join(map(str, range(14)))])
    split = [("", [""], [None]), None, (".:", ["a1", None, "007"], [None, 7, None]), ("/", [None, "1" * 19], [int("1" * 18), None]), (":", ["", ""], [None, None])]
    split += [("." * 13, [None] * 12 + ["12", "13"], [*range(12), None, None])]
    for size in (K.SLICE, 40, 1):
        monkeypatch.setattr(K, "SLICE", size)
        packed, typed = K._over(K._pack, seqs), K._over(K._split, heads)
        assert [(p["bases"], p["n"], p["odd"]) for p in packed.to_pylist()] == want
        assert [None if t["marks"] is None else (t["marks"], t["split"]["words"], t["split"]["numbers"]) for t in typed.to_pylist()] == split
        assert K._over(K._unpack, packed).to_pylist() == seqs.to_pylist()
