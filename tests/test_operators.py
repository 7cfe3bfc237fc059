import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from readlake.functions import columns as C
from readlake.operators import headers as H
from readlake.operators import models as M
from readlake.operators import ordered as O
from readlake.operators import reads as R
from readlake.operators import sparse as X
from readlake.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(df):
    df = df[sorted(df.columns)].astype(object)
    plain = lambda v: "NULL" if v is None or v is pd.NA or v != v else repr(round(float(v), 6)) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)
    return list(df.columns), sorted(tuple(plain(v) for v in row) for row in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    if name in SQL:
        assert canon(got.toPandas()) == canon(duck.sql(SQL[name]).df())
    else:
        assert got.count() > 0


def test_entry():
    import __spark_entry__ as E

    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


def ordered_rows(spark, n=500, seed=2):
    rnd = random.Random(seed)
    rows = [(i * 3 + rnd.randrange(3), f"k{rnd.randrange(3)}", rnd.choice([None, 1, 2, 3])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "rec long, k string, v int").repartition(7)


@pytest.mark.parametrize("block", [10, 64, 10_000])
def test_ordered_does_not_depend_on_blocks(spark, block):
    rows, df = ordered_rows(spark)
    last, total, fill, want = {}, {}, {}, []
    for rec, k, v in sorted(rows):
        want.append((rec, last.get(k, "first"), total.get(k, 0) + (v or 0), v if v is not None else fill.get(k)))
        last[k], total[k] = v, total.get(k, 0) + (v or 0)
        fill[k] = v if v is not None else fill.get(k)
    d = O.previous(df, F.col("v"), "p", "rec", ["k"], block)
    d = O.running_sum(d, F.coalesce("v", F.lit(0)), "s", ["rec"], ["k"], block)
    d = O.filled(d, F.col("v"), "f", "rec", ["k"], block)
    got = sorted((r.rec, "first" if r.p is None else r.p.v, r.s, r.f) for r in d.collect())
    assert got == want


def test_change_points_replay(spark):
    rows, df = ordered_rows(spark)
    changes = X.change_points(df, F.col("v"), "rec", ["k"])
    again = X.replayed(df.select("rec", "k"), changes.where("value is not null"), "rec", ["k"])
    got = {(r.rec, r.k): r.value for r in again.collect()}
    fill = {}
    for rec, k, v in sorted(rows):
        fill[k] = v if v is not None else fill.get(k)
        assert got[rec, k] == fill[k]


def test_header_types(spark):
    rows = [(0, "a:10:ff:0"), (1, "a:11:12:00"), (2, "a:9:zz:01"), (3, "a:x9:14:0"), (4, "a-10:15:7"), (5, "a-:FF:aB"), (6, "a-1234567890123456789:1:018446744073709551615")]
    t = H.typed(spark.createDataFrame(rows, "rec long, header string"))
    got = {(r.rec, r.slot): (r.kind, r.zero, r.number) for r in t.collect()}
    assert got[0, 2] == ("hex", False, 255) and got[1, 2] == ("hex", False, 18)  # digits after letters are hexadecimal
    assert got[3, 2] == ("dec", False, 14)  # until a string token
    assert got[1, 3] == ("str", False, None) and got[2, 3] == ("dec", True, 1) and got[0, 3] == ("dec", False, 0)
    assert got[5, 1][0] == "str" and got[5, 2] == ("hex", False, 255) and got[5, 3][0] == "str"
    assert got[6, 1][0] == "str" and got[6, 3][0] == "str"
    d = {(r.rec, r.slot): (r.less, r.delta) for r in H.deltas(t).collect()}
    assert d[0, 1] == (False, 10) and d[1, 1] == (False, 1) and d[2, 1] == (True, 2) and d[1, 2] == (True, 237)


def sequential_bits(symbols, ctxs, model):
    counts, out = {}, []
    for s, c in zip(symbols, ctxs, strict=True):
        t = counts.setdefault(c, [model.start] * model.symbols)
        out.append(np.log2(sum(t) / t[s]))
        t[s] += model.step
    return out


@pytest.mark.parametrize("model", [M.BASE, M.QUALITY, M.BYTE])
def test_adaptive_cost_from_counts(spark, model):
    rnd = random.Random(1)
    rows = [(rnd.randrange(3), min(rnd.randrange(model.symbols), rnd.randrange(model.symbols))) for _ in range(3000)] + [(9, 0)] * 1500
    counts = spark.createDataFrame(rows, "ctx int, sym int").repartition(5).groupBy("ctx", "sym").count()
    got = {r.ctx: (r.n, r.bits) for r in M.adaptive_cost(counts, model, ["ctx"], "count").collect()}
    bits = sequential_bits([r[1] for r in rows], [r[0] for r in rows], model)
    for c in {r[0] for r in rows}:
        want = sum(b for b, r in zip(bits, rows, strict=True) if r[0] == c)
        assert got[c][0] == sum(r[0] == c for r in rows) and got[c][1] == pytest.approx(want, abs=1e-6)


def plain_halving(symbols, model):
    """The rules symbol by symbol: [what a symbol has beyond 1], halved, left alone when saturated; bases keep their low bit."""
    if model is M.BASE:
        f, bits = [3] * 4, 0.0
        for s in symbols:
            bits += np.log2(sum(f) / f[s])
            if f[s] == 255:
                f = [(x & ~1) // 2 | (x & 1) for x in f]
            f[s] += 1
        return bits
    most, saturated = (65466, 20) if model is M.QUALITY else (32722, 256)
    f, bits = [0] * model.symbols, 0.0
    for s in symbols:
        bits += np.log2((sum(f) + model.symbols) / (f[s] + 1))
        if f[s] > most:
            if f[s] + saturated > sum(f):
                continue
            f = [x // 2 for x in f]
        f[s] += model.step
    return bits


@pytest.mark.parametrize("model,n", [(M.BASE, 6000), (M.QUALITY, 60_000), (M.BYTE, 20_000)])
@pytest.mark.parametrize("kind", ["skewed", "one", "mixed"])
def test_halving_against_plain_loop(spark, model, n, kind):
    rnd = np.random.default_rng(0)
    p = np.r_[0.9, np.full(model.symbols - 1, 0.1 / (model.symbols - 1))]
    s = {"skewed": rnd.choice(model.symbols, n, p=p), "one": np.full(n, 2), "mixed": np.r_[np.full(n // 2, 1), rnd.integers(0, 4, n // 2), np.full(n // 4, 1)]}[kind].astype(np.int64)
    want = plain_halving(s.tolist(), model)
    assert M.Halving(model).bits(s) == pytest.approx(want)
    cut = np.sort(rnd.integers(0, len(s), 20))  # as rows of one context in several batches
    rows = [(i, "a", part.tolist()) for i, part in enumerate(np.split(s, cut))] + [(i, None, [1, 0]) for i in range(3)]
    got = {r.ctx: (r.n, r.bits) for r in M.halved_cost(spark.createDataFrame(rows, "rec long, ctx string, s array<int>").repartition(3), model, ["rec"], "ctx", "s").collect()}
    assert got["a"] == (len(s), pytest.approx(want)) and got[None] == (6, pytest.approx(plain_halving([1, 0] * 3, model)))


def test_headers_are_rebuilt_from_what_is_kept(spark):
    rnd = random.Random(5)
    rows, n = [], 0
    for i in range(400):
        n += rnd.choice([0, 1, 1, 7, -3])
        token = rnd.choice([f"{abs(n)}", f"0{abs(n) + 1}", f"{abs(n):x}", f"{abs(n):X}", "00", "x9", "", f"{abs(n)}a", "FF", "aB", "1234567890123456789", "0"])
        rows.append((i, rnd.choice([None, ""]) if i % 97 == 5 else f"run.{i // 3}:{token}{rnd.choice('::::-')}{abs(n)}/{i % 2}" + ":q" * (70 if i % 150 < 20 else 0)))
    df = spark.createDataFrame(rows, "rec long, header string").repartition(4)
    for block in (1 << 16, 60):
        kept = H.encoded(df, block=block)
        assert kept.where("header is null and changed is not null").count() > 100
        assert {r.rec: r.header for r in H.rebuilt(kept, block=block).collect()} == dict(rows)
    words = {(r.rec, r.word): r.changed for r in H.change_bitmap(spark.createDataFrame([(0, ":" * 40), (1, ":" * 39 + "b:")], "rec long, header string")).collect()}
    assert words == {(0, 0): (1 << 32) - 1, (0, 1): (1 << 9) - 1, (1, 0): 0, (1, 1): 1 << 7}


def test_bases_are_restored(spark):
    rows = [(1, "NACGNN", "!I!I!~"), (2, "", ""), (3, "ACNT", "!"), (4, "N" * 50, "!" * 30), (5, "acgt", "IIII")]
    df = spark.createDataFrame(rows, "rec long, seq string, qual string")
    got = {r.rec: r.codes for r in R.restored_bases(R.exceptions(df)).collect()}
    assert got == {i: "".join({"A": "0", "C": "1", "G": "2", "T": "3"}.get(c.upper(), "N") for c in s) for i, s, _ in rows}


def test_merged_in_order(spark):
    from readlake.operators import records as P

    df = spark.createDataFrame([(i * 7 % 200, i) for i in range(200)], "rec long, v int")
    regular, large = P.split_by(df, F.col("v") % 3 == 0)
    assert [r.rec for r in P.merged(regular, large).collect()] == list(range(200))


def test_quality_contexts_of_level_three(spark):
    rnd = random.Random(7)
    rows = [(i, "".join(chr(33 + rnd.randrange(64)) for _ in range(rnd.randrange(60)))) for i in range(40)]
    got = {(r.rec, r.pos): r.ctx for r in R.quality_contexts(spark.createDataFrame(rows, "rec long, qual string"), 3).collect()}
    counted = {(r.ctx, r.q): r.n for r in R.quality_context_counts(spark.createDataFrame([*rows, (99, None)], "rec long, qual string")).collect()}
    want = {}
    for (rec, pos), ctx in got.items():
        key = ctx, ord(dict(rows)[rec][pos]) - 33
        want[key] = want.get(key, 0) + 1
    assert counted == want
    for rec, q in rows:
        p1 = p2 = ctx = 0
        fall = 5
        for pos, c in enumerate(q):
            assert got[rec, pos] == ctx
            b = ord(c) - 33
            fall += max(0, p1 - b)
            ctx = (b | max(p1, p2) << 6 | (p1 == p2) << 12 | min(7, fall >> 3) << 13) & 0xFFFF
            p1, p2 = b, p1


def test_varints(spark):
    edge = [0, 0x7F, 0x80, 0x7FFD, 0x7FFE, (1 << 32) - 1, 1 << 32]
    df = spark.createDataFrame([(x,) for x in edge], "n long")
    assert [r[0] for r in df.select(C.varint_length(F.col("n"))).collect()] == [1, 1, 2, 2, 6, 6, 10]
    edge = [-126, -125, 127, 128, -32768, 32768, -(1 << 31), 1 << 31]
    df = spark.createDataFrame([(x,) for x in edge], "n long")
    assert [r[0] for r in df.select(C.signed_varint_length(F.col("n"))).collect()] == [3, 1, 1, 3, 3, 5, 5, 9]


def test_unknown_bases_of_long_reads(spark):
    """A text of 20,000 bases, half of them unknown, takes seconds; nulls stay null; filters on the results are safe."""
    import time

    seq = "".join("ACGNT"[i * i % 5] for i in range(20_000))
    rows = [(1, seq, "".join(chr(33 + i % 7) for i in range(15_000))), (2, None, "II"), (3, "", None), (4, "NNA", None), (5, "AN", "!!!!")]
    df = spark.createDataFrame(rows, "rec long, seq string, qual string")
    began = time.time()
    e = R.exceptions(df).where("size(q) >= 0 and codes is not null and size(ns) >= 0")
    back = {r.rec: r for r in R.restored_bases(e).where("size(q) >= 0 and length(codes) >= 0").collect()}
    assert time.time() - began < 60
    assert back[1].codes == seq.translate(str.maketrans("ACGT", "0123"))
    assert list(back[1].q) == [i % 7 for i in range(15_000)] + [7] * 5_000
    assert (back[4].codes, list(back[4].q), back[5].codes, list(back[5].q)) == ("NN0", [7, 7, 7], "0N", [0, 0])
    assert 2 not in back and (back[3].codes, list(back[3].q)) == ("", [])
    assert {r.rec for r in R.exceptions(df.limit(0)).collect()} == set()
