"""The registered queries on whole tables, held against their SQL or against plain loops."""

import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from test_simhash_neardup import slow_components, slow_fingerprint
from test_suffix_tree import Slow, lists
from test_tokens import ids_of

from readlake.llm import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{DATA}/documents.parquet").to_pylist()


def mod(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(Q.oracle_sql()[name]).df()
    got = Q.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[sorted(want.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_op1(spark, docs):
    texts = lists([d["text"] for d in docs])
    slow = Slow([t for d, t in zip(docs, texts, strict=True) if mod(d["doc_id"], 5) != 1], 1 << 19)
    got = {r.doc_id: r for r in Q.op1_suffix_tree(spark, DATA).collect()}
    assert len(got) == len(docs)
    for d, t in zip(docs, texts, strict=True):
        r = got[d["doc_id"]]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (mod(d["doc_id"], 5) == 1, len(t), sum(slow.counts[w] > 0 for w in t), slow.total)
        assert r.base_score == pytest.approx(sum(math.log10(slow.own(slow.counts[w])) for w in t), abs=1e-6)
        if len(t) < 2000:
            assert r.score == pytest.approx(sum(math.log10(slow.p(t[max(0, k - 3) : k], w)) for k, w in enumerate(t)), abs=1e-6)


def test_op2(spark, docs):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q.op2_token_store(spark, DATA).collect()}
    at, want = 0, {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ids = ids_of(d["text"], 1)
        want[d["doc_id"]] = at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert got == want


def test_op4(spark, docs):
    ids = {d["doc_id"]: ids_of(d["text"], 2) for d in docs}
    cover, sequences = defaultdict(list), defaultdict(list)
    for r in Q.op4_packing(spark, DATA).collect():
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        cover[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, pieces in cover.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == len(ids[i])
    assert set(cover) == set(ids)
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096 and at & at - 1 == 0


def test_op5(spark, docs):
    got = {r.doc_id: r for r in Q.op5_langid(spark, DATA).collect()}
    known = {d["lang"] for d in docs} - {None}
    right = []
    for d in docs:
        r = got[d["doc_id"]]
        assert r.held_out == (mod(d["doc_id"], 4) == 2) and 0 <= r.score <= 1
        lettered = any(map(str.isalpha, d["text"] or ""))
        assert (r.lang_pred in known) == lettered and (lettered or r.lang_pred == "und")
        if r.held_out and lettered and d["lang"]:
            right.append(r.lang_pred == d["lang"])
    assert len(got) == len(docs) and np.mean(right) > 0.9


def test_op7(spark, docs):
    got = {r.doc_id: r for r in Q.op7_toxicity(spark, DATA).collect()}
    assert set(got) == {d["doc_id"] for d in docs}
    for d in docs:
        r = got[d["doc_id"]]
        assert r.held_out == (mod(d["doc_id"], 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op8(spark, docs):
    got = Q.op8_resharding(spark, DATA).collect()
    text = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    assert sorted(r.doc_id for r in got) == sorted(text)
    homes, held = defaultdict(set), defaultdict(list)
    for r in got:
        t = text[r.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 8, zlib.crc32(t), "bytes", None) and 0 <= r.shard < 24
        homes[t].add(r.shard)
        held[r.shard].append(r)
    assert all(len(x) == 1 for x in homes.values())
    for rows in held.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))


def test_op10(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op10_simhash_neardup(spark, DATA).collect()}
    prints = [slow_fingerprint(d["text"]) for d in docs]
    label, least = slow_components(prints, 4), {}
    for d, x in zip(docs, label, strict=True):
        least[x] = min(least.get(x, d["doc_id"]), d["doc_id"])
    assert got == {d["doc_id"]: (f"{p:016x}", least[x]) for d, p, x in zip(docs, prints, label, strict=True)}
