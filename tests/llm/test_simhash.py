import hashlib
import random
import re

import xxhash
from docs import ODD, frame
from pyspark.sql import functions as F

from readlake.llm import queries as Q
from readlake.llm import simhash as S


def slow(text):
    words = [w for w in re.split("[ \t-\r]+", (text or "").lower()) if w]
    pairs = list(zip(words, words[1:], strict=False)) or [(w, "") for w in words]
    votes, total = [0] * 64, 0
    for a, b in pairs:
        h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
        w = len(a) + len(b)
        total += w
        for i in range(64):
            votes[i] += w * (h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * votes[i] > total)


def slow_edits(texts):
    rows = sorted(((i is not None, i or 0, xxhash.xxh64_intdigest((t or "").encode(), 42), t or "") for i, t in texts), key=lambda r: (r[0], r[1], r[2] - (1 << 64) if r[2] >> 63 else r[2]))
    out = []
    for k, (real, i, _, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][3]
        n = len(t) // 2
        edited = t[: len(t) - n] + after[:n]
        out.append((i if real else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), slow(t), slow(edited), slow(after)))
    return out


def check(spark, texts):
    mask = (1 << 64) - 1
    got = [(r.id, r.n_chars, r.edited_sha256, r.fp & mask, r.edited_fp & mask, r.next_fp & mask) for r in S.edits(frame(spark, texts, "fp bucket rn t")).collect()]
    assert sorted(got, key=str) == sorted(slow_edits(texts), key=str)


def test_edits(spark, monkeypatch):
    check(spark, ODD)
    monkeypatch.setattr(S, "BUCKET_ROWS", 3)
    rnd = random.Random(2)
    check(spark, [(rnd.choice([i, i * i, -i]), " ".join(rnd.choices("alpha beta gamma Delta é ß".split(), k=rnd.randrange(30)))) for i in range(60)])


def test_single_and_empty(spark):
    check(spark, [(5, "only one document here")])
    assert S.edits(frame(spark, [])).collect() == []


def test_permuted_tables_find_all(spark):
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(20)]
    prints = {0, (1 << 64) - 1}
    for _ in range(300):
        x = rnd.choice(base)
        for _ in range(rnd.randrange(6)):
            x ^= 1 << rnd.randrange(64)
        prints.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints] + [(None,)], "fp long")
    for radius, blocks in ((3, 6), (3, 4), (2, 5)):
        got = [(r.q, r.fp) for r in S.within(df.limit(80), df, radius, blocks).collect()]
        asked = {r.fp for r in df.limit(80).collect()} - {None}
        want = {(q, signed(f)) for q in asked for f in prints if ((q & (1 << 64) - 1) ^ f).bit_count() <= radius}
        assert len(got) == len(set(got)) and set(got) == want


def test_neighbours(spark):
    rnd = random.Random(8)
    base = [rnd.getrandbits(64) for _ in range(5)]
    rows = []
    for i in range(250):
        x = rnd.choice(base)
        for _ in range(rnd.randrange(5)):
            x ^= 1 << rnd.randrange(64)
        rows.append((i if i % 50 else None, x - (1 << 64) if x >> 63 else x))
    rows += [(1000 + i, rows[7][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, fp long")
    got = sorted(((r.id or -1), r.near) for r in S.neighbours(df, F.col("id") % 3 == 0).collect())
    count = lambda f: sum(((f ^ g) & (1 << 64) - 1).bit_count() <= 3 for _, g in rows) - 1
    assert got == sorted(((i or -1), count(f) if i is not None and i % 3 == 0 else None) for i, f in rows)
    assert S.blocks_for(2_500, 3) == 4 and S.blocks_for(1 << 20, 3) == 5


def test_query_against_brute_force(spark, tmp_path):
    texts = [(100 * i, t) for i, (_, t) in enumerate(ODD)] + [(7, ODD[4][1]), (8, ODD[4][1] + " more")]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    prints = {i: slow(t) for i, t in texts}
    got = {r.doc_id: r for r in Q.op9_simhash(spark, str(tmp_path)).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    near = {i: sum((f ^ g).bit_count() <= 3 for g in prints.values()) - 1 if i % 100 == 0 else None for i, f in prints.items()}
    assert {i: r.n_near for i, r in got.items()} == near
