import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from docs import ODD, frame
from pyspark.sql import functions as F

from readlake.llm import queries as Q
from readlake.llm import suffix_tree as S
from readlake.llm.common import learning, slices, split, words_of


def corpus(n=300, seed=9):
    rnd = random.Random(seed)
    follow = {w: rnd.sample([f"w{i}" for i in range(30)], 3) for w in [f"w{i}" for i in range(30)]}
    out = []
    for i in range(n):
        w, t = f"w{rnd.randrange(30)}", []
        for _ in range(rnd.randrange(40)):
            t.append(w if rnd.random() < 0.95 else f"Rare{rnd.randrange(200)}")
            w = rnd.choice(follow[w]) if rnd.random() < 0.9 else f"w{rnd.randrange(30)}"
        out.append((i, " ".join(t)))
    return out


def lists(texts):
    return [[*(w.decode() for w in words_of((t or "").encode())), ""] for t in texts]


class Slow:
    """The tree by plain loops over word tuples, from the definition alone."""

    def __init__(self, texts):
        self.counts = Counter(w for t in texts for w in t)
        self.total, self.distinct = sum(self.counts.values()), len(self.counts)
        after = defaultdict(Counter)
        for t in texts:
            for i, w in enumerate(t):
                for d in range(1, S.DEPTH + 1):
                    if i >= d:
                        after[tuple(t[i - d : i])][w] += 1
        self.mass, self.rest, self.kept = {}, {}, set()
        for c, found in after.items():
            whole = sum(found.values())
            self.mass[c] = {w: (n - S.DISCOUNT) / whole for w, n in found.items() if n >= S.LEAST}
            self.rest[c] = max(1e-9, 1 - sum(self.mass[c].values()))
        for c, found in after.items():
            listed = {w: found[w] for w in self.mass[c]}
            saved = sum(n * math.log2(self.whole_tree(c, w) / self.whole_tree(c[1:], w)) for w, n in listed.items())
            saved += (sum(found.values()) - sum(listed.values())) * math.log2(self.rest[c])
            if listed and saved >= S.GAIN * len(listed):
                self.kept.add(c)

    def own(self, count):
        return (count + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def whole_tree(self, c, w):
        """Before any context is dropped."""
        if not c:
            return self.own(self.counts[w])
        return self.mass.get(c, {}).get(w, 0) + self.rest.get(c, 1) * self.whole_tree(c[1:], w)

    def p(self, history, w):
        out = self.own(self.counts[w])
        for d in range(1, min(S.DEPTH, len(history)) + 1):
            c = tuple(history[-d:])
            if c in self.kept:
                out = self.mass[c].get(w, 0) + self.rest[c] * out
        return out


@pytest.mark.parametrize("head,part,chunk", [(S.HEAD, S.PART_TOKENS, S.CHUNK), (S.HEAD, 40, 50), (20, 100, 300), (64, S.PART_TOKENS, S.CHUNK), (1, 1000, 70)])
def test_against_brute_force(spark, monkeypatch, head, part, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    texts = [*corpus(), *((i, t) if i is None else (i + 1000, t) for i, t in ODD), (2000, "w1 w2 " * 300), (2001, None)]
    df = frame(spark, texts, "word n rid known times key chunk")
    learned = learning("doc_id", 5, 1)
    slow = Slow(lists([r.text for r in df.where(learned).select("text").collect()]))
    assert {len(c) for c in slow.kept} == {1, 2, 3} and len(slow.kept) < len(slow.rest)
    got = S.score(df, learned, head=head, part_tokens=part).collect()
    held = {r.doc_id for r in df.where(~learned).select("doc_id").collect()}
    want = []
    for (i, _), t in zip(texts, lists([t for _, t in texts]), strict=True):
        p = sum(math.log10(slow.p(t[:k], w)) for k, w in enumerate(t))
        base = sum(math.log10(slow.own(slow.counts[w])) for w in t)
        want.append((i is not None, i or 0, i in held, len(t), sum(slow.counts[w] > 0 for w in t), slow.total, base, p))
    have = [(r.doc_id is not None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]
    assert len(have) == len(want)
    for a, b in zip(sorted(have), sorted(want), strict=True):
        assert a[:6] == b[:6] and a[6:] == pytest.approx(b[6:], abs=1e-6)


def test_frequent_words_are_spread(spark):
    counted = S.unigrams(frame(spark, corpus()).select("text"))
    assert S.head_of(counted, 6000, part_tokens=100).spread and S.head_of(counted, 6000, part_tokens=100).parts >= 60
    assert not S.head_of(counted, 6000).spread


def test_hash_is_sparks(spark):
    words = [b"", b"a", "\u00e9t\u00e9".encode(), b"x" * 100]
    got = [r[0] for r in spark.createDataFrame([(bytearray(w),) for w in words], "word binary").select(S.signed(F.xxhash64("word"))).collect()]
    assert got == [-(S.hash_of(w) >> 1) - 1 for w in words]


def test_distributions_sum_to_one():
    texts = lists([t for _, t in corpus()])
    slow = Slow(texts)
    for context in [(), *random.Random(1).sample(sorted(slow.kept), 25)]:
        assert sum(slow.p(list(context), w) for w in [*slow.counts, "\0never seen"]) == pytest.approx(1, abs=1e-6)


def test_better_than_independent_words_on_held_out(spark):
    got = [r for r in S.score(frame(spark, corpus(1200)), learning("doc_id", 5, 1)).collect() if r.held_out and r.n_tokens > 3]
    assert len(got) > 100 and np.mean([r.score > r.base_score for r in got]) > 0.95


def test_twice_told_texts_stand_out(spark):
    rnd = random.Random(3)
    text = lambda: " ".join(f"v{int(rnd.paretovariate(0.6))}" for _ in range(60))
    once = [text() for _ in range(150)]
    docs = list(enumerate(once + once[:30]))
    got = {r.doc_id: r.score / r.base_score for r in S.score(frame(spark, docs), F.lit(True)).collect()}
    twice = [got[i] for i in range(30)]
    assert max(twice) < min(got[i] for i in range(30, 150))


def test_nothing_to_learn(spark):
    assert S.score(frame(spark, []), F.lit(True)).collect() == []
    got = S.score(frame(spark, [(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.score, 6)) for r in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]


def test_split_is_words_of():
    texts = [*(t for _, t in ODD), None, "", " ", "a  b\x0b\x0cc\rd\te\x1cf\x85g ", " AÉ aÉ\n", "x" * 50, "b a b"]
    low = pc.ascii_lower(pa.array(["cut off", *texts], pa.string()).slice(1))
    words, place, cuts = split(low)
    assert [[words[i] for i in place[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == [words_of(t and t.encode()) for t in texts]
    for most in (1, 30, 1 << 20):
        cut = list(slices(low, most))
        assert [a for a, _ in cut] == [0, *(b for _, b in cut[:-1])] and cut[-1][1] == len(low)
        assert all(b - a == 1 or sum(len((t or "").encode()) for t in texts[a:b]) <= most for a, b in cut)
    assert list(slices(low.slice(0, 0))) == []


def test_a_word_is_looked_up_once_for_many_texts():
    class Counting(dict):
        asked = 0

        def get(self, key):
            self.asked += 1
            return super().get(key)

    numbers = S.Numbers(S.Head([b"", b"a", b"b"], np.array([9, 5, 4]), 18, 3, {}, 1, "x", 0))
    numbers.number = Counting(numbers.number)
    got = list(numbers.each(pa.array(["a b " * 200, None, "B c A", ""] * 50)))
    assert numbers.number.asked <= 4
    c = -(S.hash_of(b"c") >> 1) - 1
    assert [t.tolist() for t in got] == [[1, 2] * 200 + [S.END], [S.END], [2, c, 1, S.END], [S.END]] * 50


def test_whole_query(spark):
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    texts = lists([d["text"] for d in docs])
    out_of = [zlib.crc32(str(d["doc_id"]).encode()) % 5 == 1 for d in docs]
    slow = Slow([t for t, x in zip(texts, out_of, strict=True) if not x])
    got = {r.doc_id: r for r in Q.op1_suffix_tree(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d, t, x in zip(docs, texts, out_of, strict=True):
        r = got[d["doc_id"]]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (x, len(t), sum(slow.counts[w] > 0 for w in t), slow.total)
        assert r.base_score == pytest.approx(sum(math.log10(slow.own(slow.counts[w])) for w in t), abs=1e-6)
        if len(t) < 2000:
            assert r.score == pytest.approx(sum(math.log10(slow.p(t[max(0, k - 3) : k], w)) for k, w in enumerate(t)), abs=1e-6)
