import random
from collections import Counter

import numpy as np
import pytest
from docs import ODD, frame
from pyspark.sql import functions as F

from readlake.llm import line_dedup as L


def slow(texts, least, least_chars=1):
    split = [(t or "").split("\n") for t in texts]
    key = lambda x: x.strip(" \t\n\v\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    n = Counter(k for lines in split for k in {key(x) for x in lines} if len(k) >= least_chars)
    out = []
    for lines in split:
        kept = [x for x in lines if n[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def corpus():
    rng = random.Random(3)
    common = ["© Foo", " Share THIS\r", "", " ", "x", "é", "日本語", "\x1fodd", "a b\tc "]
    texts = ["\n".join(rng.choice(common) if rng.random() < 0.4 else f"line {rng.randrange(400)}" for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    return [*texts, *texts[:30], None, "", "\n", "\n\n", "x" * 100_000 + "\nX\nx\nX", "x\n" * 50_000]


@pytest.mark.parametrize("broadcast", [1 << 26, -1])
@pytest.mark.parametrize("least,least_chars", [(10, 1), (1, 1), (3, 2), (2, 7)])
def test_against_plain_loops(spark, monkeypatch, broadcast, least, least_chars):
    """Both ways to the arrays, several small shards and several copies of one shard."""
    for name, value in (("BROADCAST_BYTES", broadcast), ("SHARD_KEYS", 100), ("PROBES", 50), ("LINES", 64)):
        monkeypatch.setattr(L, name, value)
    texts = corpus()
    docs = frame(spark, list(enumerate(texts)), extra="n_lines shard kept hi").repartition(5)
    index = L.build(docs, least_chars)
    assert index.shards > 1
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in L.clean(docs, index, [F.col("doc_id"), F.col("lang")], least).collect()}
    assert got == dict(enumerate(slow(texts, least, least_chars)))


@pytest.mark.parametrize("broadcast", [1 << 26, -1])
def test_odd(spark, monkeypatch, broadcast):
    monkeypatch.setattr(L, "BROADCAST_BYTES", broadcast)
    for rows in ([], [(1, None)], ODD):
        docs = frame(spark, rows)
        got = L.clean(docs, L.build(docs), [F.col("doc_id")], 2).collect()
        assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in got) == sorted((str(i), *x) for (i, _), x in zip(rows, slow([t for _, t in rows], 2), strict=True))


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 64, 5000):
        hi, lo = rng.integers(0, 1 << 64, (2, n), np.uint64)
        lo[: n // 2] = lo[0] if n else 0  # either half may repeat
        hi[n // 2 :] = hi[0] if n else 0
        count = rng.integers(1, 70_000, n)
        back = L.Shard.read(*L.Shard.of(hi, lo, count).row())
        assert len(back.fingerprints) == len(back.counts) == n and np.bitwise_count(back.words).sum() == n  # minimal
        assert (back.probe(hi, lo) == count).all()
        assert not back.probe(rng.integers(0, 1 << 64, 1000, np.uint64), rng.integers(0, 1 << 64, 1000, np.uint64)).any()
