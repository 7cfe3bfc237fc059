import random
from collections import Counter, defaultdict

import pytest
from docs import ODD, SCHEMA, frame
from pyspark.sql import functions as F

from readlake.llm import divergence as D


def slow(rows, least=3, most=200):
    """rows: (lang, source, text); plain loops over all terms and pairs."""
    groups, df, n = set(), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        w = [x.decode() for x in D.terms((text or "").encode())]
        df[lang].update(set(w))
        n[lang, source].update(w)
    out = []
    f = lambda p, q: (p - q) ** 2 // q
    for lang, source in groups:
        kept = [t for t, k in df[lang].items() if k >= least]
        v = len(kept)

        def p(counts, v=v, kept=kept):
            size = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (size + v) for t in kept}

        own, whole = p(n[lang, source]), p(sum((n[g] for g in groups if g[0] == lang), Counter()))
        others = {s: sum(f(own[t], q) for t, q in p(n[lang, s]).items()) for x, s in groups if x == lang and s != source}
        terms = {t: f(own[t], whole[t]) for t in kept if n[lang, source][t] and own[t] > whole[t]}
        for part, found, limit in (("pair", others, None), ("term", terms, most)):
            ranked = sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked[:limit])]
    return sorted(out)


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, x[2], x[0], x[1], 0) for i, x in enumerate(rows)], SCHEMA)
    assert sorted(map(tuple, D.audit(df, **kw).collect())) == slow(rows, **kw)


def test_random(spark):
    rng = random.Random(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)] + ["É", "ß", "日本", "x"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice([None, "a", "b", "c", "é", "𝄞"]), " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randrange(0, 90)))) for _ in range(250)]
    check(spark, rows)
    check(spark, rows, least=1, most=3)


def test_odd(spark):
    check(spark, [])
    check(spark, [("en", "a", None), ("en", "b", ""), ("en", None, "1 2 3"), (None, None, None)])
    check(spark, [("en", "a", "only twice"), ("en", "b", "only twice")])
    check(spark, [("en", "a", "Same Same")] * 3 + [("en", "b", None), ("de", "a", "same")])
    df = frame(spark, ODD, extra="p n value rank item size")
    assert sorted(map(tuple, D.audit(df, least=1).collect())) == slow([("en", f"s{(i or 0) % 3}", t) for i, t in ODD], least=1)


def test_long_division(spark):
    cases = [(0, 1), (8, 9), (10**12, 10**15), (9 * 10**15 - 1, 9 * 10**15), (123456789012, 987654321098765)]
    got = spark.createDataFrame(cases, "n long, size long").select(D.scaled(F.col("n"), F.col("size"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 1) // s for n, s in cases]


@pytest.mark.parametrize("pairs", [1, 7, 1000])
def test_pairs_in_pieces(spark, monkeypatch, pairs):
    """A term in more sources than a piece has pairs is treated in several pieces."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(D, "PAIRS", pairs)
    rng = np.random.default_rng(1)
    rows = [("en", f"t{t:03}", f"s{s}", int(rng.integers(1, 10**8)), 1 + s) for t in range(40) for s in sorted(rng.choice(12, rng.integers(1, 12), replace=False).tolist())]
    want = Counter()
    f = lambda p, q: (p - q) ** 2 // q
    for a in rows:
        for b in rows:
            if a[1] == b[1] and a[2] != b[2]:
                want["en", a[2], b[2]] += f(a[3], b[3]) - f(a[3], b[4]) - f(a[4], b[3]) + f(a[4], b[4])
    table = pa.table(dict(zip(("lang", "term", "source", "p", "p0"), map(pa.array, zip(*rows, strict=True)), strict=True)))
    got = {tuple(r.values())[:3]: r["value"] for b in D._both(iter(table.to_batches(max_chunksize=9))) for r in b.to_pylist()}
    assert got == {k: x for k, x in want.items() if x}
