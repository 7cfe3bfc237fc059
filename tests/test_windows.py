import random

import pytest

from readlake.operators import inspect as I


def slow(seqs, size, canonical):
    found = [s[i : i + size] for s in seqs if s for i in range(len(s) - size + 1)]
    if canonical:
        found = [min(w, w.translate(str.maketrans("ACGTacgt", "TGCAtgca"))[::-1]) for w in found]
    return len(found), len(set(found))


@pytest.mark.parametrize("size,canonical", [(1, False), (2, True), (12, False), (31, True), (76, False), (9, True)])
def test_against_plain_loops(spark, monkeypatch, size, canonical):
    monkeypatch.setattr(I, "SLICE", 500)
    rnd = random.Random(size)
    seqs = ["".join(rnd.choices("ACGTN", weights=[5, 5, 5, 5, 1], k=rnd.randrange(300))) for _ in range(60)]
    flipped = [s.translate(str.maketrans("ACGT", "TGCA"))[::-1] for s in seqs[:20]]
    seqs += [*seqs[:15], *flipped, None, "", "A" * 500, "AC" * 200, "x", "ACGT" * 19]
    df = spark.createDataFrame([(s, i) for i, s in enumerate(seqs)], "seq string, window int").repartition(3)
    assert tuple(I.distinct_windows(df, "seq", size, canonical).first()) == slow(seqs, size, canonical)
    assert tuple(I.distinct_windows(df.limit(0), "seq", size, canonical).first()) == (0, 0)


def test_little_is_shuffled():
    """Of 76 bases a window, under four bytes a base leave a task, where whole windows would be 76; text that repeats leaves once."""
    import pyarrow as pa

    rnd = random.Random(1)
    seqs = ["".join(rnd.choices("ACGT", k=1000)).encode() for _ in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(seqs * 4, pa.binary())], ["seq"])
    sent = [r for b in I._stretches(iter([batch]), 76, 8, False) for r in b.to_pylist()]
    assert sum(len(r["stretch"]) for r in sent) < 4 * sum(map(len, seqs))
    assert sum(r["n"] * (len(r["stretch"]) - 75) for r in sent) == 4 * sum(len(s) - 75 for s in seqs)


@pytest.mark.parametrize("size,canonical", [(12, False), (31, True), (76, False)])
def test_windows_are_never_rows(spark, monkeypatch, size, canonical):
    """Tasks sort stretches and count their windows a little at a time, also where one minimizer has more than fits at once."""
    import pyarrow as pa

    df = spark.createDataFrame([("ACGT" * 50,)], "seq string")
    assert "Generate" not in I.distinct_windows(df, "seq", size, canonical)._jdf.queryExecution().toString()
    rnd = random.Random(size)
    seqs = ["".join(rnd.choices("ACGTN", k=rnd.randrange(300))) for _ in range(40)] + ["A" * 500, "AC" * 200] * 2
    batches = [pa.RecordBatch.from_arrays([pa.array([s.encode()], pa.binary())], ["seq"]) for s in seqs]
    sent = [r for b in I._stretches(iter(batches), size, 3, canonical) for r in b.to_pylist()]
    sent.sort(key=lambda r: r["minimizer"])
    monkeypatch.setattr(I, "GROUP", 200)
    pieces = [pa.RecordBatch.from_pylist(sent[i : i + 7], pa.schema([("minimizer", pa.int64()), ("stretch", pa.binary()), ("n", pa.int64())])) for i in range(0, len(sent), 7)]
    got = [r for b in I._counted(iter(pieces), size, canonical) for r in b.to_pylist()]
    assert len(got) > 3 and (sum(r["windows"] for r in got), sum(r["distinct"] for r in got)) == slow(seqs, size, canonical)
    monkeypatch.setattr(I, "_hashes", lambda raw, k, f=I._hashes: f(raw, k) & I.np.uint64(7))
    got = [r for b in I._counted(iter(pieces), size, canonical) for r in b.to_pylist()]
    assert sum(r["distinct"] for r in got) == slow(seqs, size, canonical)[1]  # equal hashes of different windows
