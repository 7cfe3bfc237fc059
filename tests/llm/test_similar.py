import random

import corpus_pipeline as C
import numpy as np
import pyarrow as pa
from docs import ODD, frame
from test_simhash_neardup import slow_fingerprint

from readlake.llm import simhash_neardup as J


def slow_set(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similarity(a, b):
    a, b = slow_set(a), slow_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def slow_kept(rows):
    """Least id of every component over all pairs."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if similarity(a, b) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(i for i in root if find(i) == i)


def edited(words, n, rnd):
    out = list(words)
    for at in rnd.sample(range(0, len(out), 6), n):
        out[at] = f"e{rnd.randrange(10**9)}"
    return out


def test_edited_copies_are_one_document(spark, tmp_path):
    rnd = random.Random(4)
    rows, beyond_radius = [], 0
    for k in range(40):
        words = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        rows.append((10 * k, " ".join(words)))
        for n in range(1, 7):
            rows.append((10 * k + n, " ".join(edited(words, n, rnd))))
            beyond_radius += similarity(rows[-1][1], rows[-1 - n][1]) >= 0.8 and (slow_fingerprint(rows[-1][1], 5) ^ slow_fingerprint(rows[-1 - n][1], 5)).bit_count() > 4
    kept = slow_kept(rows)
    assert beyond_radius > 40 and 40 < len(kept) < len(rows)
    out = C.drop_near_duplicates(spark, frame(spark, rows), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == kept


def test_chains_tiles_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(J, "TILE", 24)
    rnd = random.Random(9)
    rows, words = [], [f"c{k}" for k in range(120)]
    for i in range(40):  # a chain: neighbours are alike, ends are not
        rows.append((i, " ".join(words)))
        words = edited(words, 1, rnd)
    rows += [(100 + i, " ".join(f"u{i}x{k}" for k in range(30))) for i in range(5)]
    docs = frame(spark, rows)
    assert sorted(r.doc_id for r in J.deduplicate_similar(docs).collect()) == slow_kept(rows)
    odd = J.deduplicate_similar(frame(spark, ODD, "least root")).collect()
    assert len(odd) == len({frozenset(slow_set(r[1])) for r in ODD})
    assert J.deduplicate_similar(frame(spark, [])).collect() == []


def test_bands_do_not_depend_on_slices(monkeypatch):
    s = J.shingle_set(" ".join(f"w{k}" for k in range(99)).encode())
    whole = J.band_keys(s)
    monkeypatch.setattr(J, "PERMUTED", 7)
    assert J.band_keys(s) == whole and len(whole) == J.BANDS and len(s) == 95
    assert J.band_keys(np.zeros(0, np.uint64)) == []


def test_fingerprint_of_a_set():
    s = J.shingle_set(" ".join(f"w{k}" for k in range(99)).encode())
    assert J.set_fingerprint(s) == slow_fingerprint(" ".join(f"w{k}" for k in range(99)), 5)


def test_bit_sliced_stars():
    rnd = np.random.default_rng(3)
    u = np.repeat(rnd.integers(0, 2**63, 9, dtype=np.int64), rnd.integers(1, 150, 9))
    v = u.copy()
    for _ in range(25):
        v ^= np.int64(1) << rnd.integers(0, 63, len(v))
    order = rnd.permutation(len(u))
    u, v = u[order], v[order]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(u))), pa.array(np.arange(len(u)) + 7), pa.array(u), pa.array(v)], ["u", "v", "u_fp", "v_fp"])
    got = sorted(x for b in J._near_first(iter([batch]), 16) for x in b.column(0).to_pylist())
    assert got == [i for i in range(len(u)) if (int(u[i]) ^ int(v[i])).bit_count() <= 16] and 0 < len(got) < len(u)
