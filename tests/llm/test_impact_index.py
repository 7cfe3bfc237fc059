import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from docs import ODD, frame

from readlake.llm import impact_index as X


def slow(docs, queries, k):
    """docs, queries: (id, text); plain loops, score by score."""
    tf = [(i, Counter(X.terms((t or "").encode()))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n, total = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(w for _, c in tf for w in c)
    out = []
    for q, text in queries:
        scored = []
        asked = Counter(X.terms((text or "").encode()))
        for i, c in tf:
            m = 100 - 75 + 75 * sum(c.values()) * n // total
            score = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, x in asked.items() if c[w])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def check(spark, docs, queries, k, extra=""):
    df = frame(spark, docs, extra).repartition(3)
    asked = spark.createDataFrame(queries, "item_id long, text string, rank string, id string")
    got = list(map(tuple, X.search(X.build(df), asked, k).collect()))
    want = slow(docs, [(q[0], q[1]) for q in queries], k)
    assert sorted(got, key=str) == sorted(want, key=str)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    text = lambda size: " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(400)], k=size))
    docs = [(i, text(rng.choice([1, 5, 20, 200]))) for i in range(n)]
    docs += [(n + i, docs[i][1]) for i in range(0, n, 3)] + [(5 * n + i, "w3 w3 w9") for i in range(30)]
    rng.shuffle(docs)
    return docs, [(i, text(rng.choice([0, 1, 4, 40])), "x", "y") for i in range(25)]


@pytest.mark.parametrize("postings,first,k", [(2_000_000, 2048, 10), (300, 1, 3), (50, 16, 1), (5000, 64, 1000)])
def test_against_plain_loops(spark, monkeypatch, postings, first, k):
    """Shards of any size, any step, few and more results than documents; ties by id."""
    monkeypatch.setattr(X, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(X, "FIRST", first)
    monkeypatch.setattr(X, "ROWS", 7)
    check(spark, *corpus(150), k, extra="term score shard impacts")


def test_passes(spark, monkeypatch):
    monkeypatch.setattr(X, "PASS_TERMS", 20)
    check(spark, *corpus(60), 4)


def test_odd(spark):
    queries = [(1, None, "", ""), (2, "", "", ""), (3, "Ünï text HERE here", "", ""), (None, "one two", "", ""), (5, "a b xyz", "", ""), (6, "x" * 50_000, "", "")]
    check(spark, [], queries, 3)
    check(spark, [(1, None), (2, "  ")], queries, 3)
    check(spark, ODD, queries, 3)
    check(spark, ODD, [], 3)


def test_stops_early(spark, monkeypatch):
    """A rare term decides: most postings of the common one are never added, and the result is the same."""
    docs = [(i, "the " * (1 + i % 40) + ("rare" if i % 997 == 0 else "x")) for i in range(20_000)]
    names, asked = [b"the", b"rare", b"x"], ["rare", "the", "x"]
    counts = [[(names.index(w.encode()), n) for w, n in Counter(t.split()).items()] for _, t in docs]
    found = [(np.array([a for a, _ in r], np.int32), np.array([b for _, b in r], np.int64)) for r in counts]
    sizes = [len(t.split()) for _, t in docs]
    whole, *parts = X._shard(0, [i for i, _ in docs], found, sizes, names, len(docs), sum(sizes))
    table = pa.Table.from_batches(parts)
    table = table.append_column("number", pa.array([asked.index(t) for t in table.column("term").to_pylist()]))
    shard, read, plain = X.Shard(whole.column("ids").flatten(), table, 3), [], X.Shard._postings

    def counted(self, groups):
        read.append(int((self.end[groups] - self.begin[groups]).sum()))
        return plain(self, groups)

    monkeypatch.setattr(X.Shard, "_postings", counted)
    candidates, scores = shard.best(np.array([0, 1]), np.array([9000, 30]), 10, 0)
    assert sum(read[:-1]) < 15_000 and len(candidates) <= 40  # the last read completes the scores
    _, exact = shard.best(np.array([0, 1]), np.array([9000, 30]), 20_000, 0)
    assert sorted(scores.tolist())[-10:] == sorted(exact.tolist())[-10:]
