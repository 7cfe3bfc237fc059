import random

import numpy as np
import pytest
import xxhash
from docs import ODD, frame

from readlake.llm import simhash_neardup as S


def slow_fingerprint(text, k=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [t for _, t in ODD[:9]] + ["Some Words " * 7 + "end"])
def test_fingerprint(text):
    assert S.fingerprint(text and text.encode()) == slow_fingerprint(text)


def test_fingerprint_slices(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(500))
    whole = S.fingerprint(text.encode())
    monkeypatch.setattr(S, "SLICE", 7)
    assert S.fingerprint(text.encode()) == whole == slow_fingerprint(text)


def near_prints(n, seed):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(6)]
    out = {0, 1, 15, 31}
    while len(out) < n:
        x = rnd.choice(base) if rnd.random() < 0.6 else rnd.getrandbits(64)
        for _ in range(rnd.randrange(9)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("blocks,tile", [(5, 4096), (6, 4096), (5, 40)])
def test_links_connect_all(spark, monkeypatch, blocks, tile):
    monkeypatch.setattr(S, "TILE", tile)
    prints = near_prints(400, 3)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    got = S.links(df, 4, blocks).collect()
    where = {x: i for i, x in enumerate(prints)}
    mask = (1 << 64) - 1
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in got:
        a, b = r.u & mask, r.v & mask
        assert (a ^ b).bit_count() <= 64
        parent[find(where[a])] = find(where[b])
    want = slow_components(prints, 4)
    pairs = lambda label: {frozenset(j for j in range(len(prints)) if label[j] == x) for x in set(label)}
    assert pairs([find(i) for i in range(len(prints))]) == pairs(want)


def test_carry_save_distances():
    rnd = np.random.default_rng(1)
    values = rnd.integers(0, 2**63, 128, dtype=np.uint64)
    values[1::2] = values[::2] ^ np.uint64(0b10110)
    planes = np.stack([np.packbits((values >> np.uint64(b) & np.uint64(1)).astype(bool), bitorder="little").view(np.uint64) for b in range(64)])
    for radius in (1, 2, 3, 4, 7):
        q, w = np.repeat(np.arange(128), 2), np.tile([0, 1], 128)
        full = np.full(256, 2**64 - 1, np.uint64)
        a, b, lanes = S.close_lanes(planes, values, q, w, full, list(range(64)), radius)
        got = {(int(i), int(j) * 64 + k) for i, j, x in zip(a, b, lanes, strict=True) for k in range(64) if int(x) >> k & 1}
        assert got == {(i, j) for i in range(128) for j in range(128) if (int(values[i]) ^ int(values[j])).bit_count() <= radius}


def test_whole_against_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = list(ODD)
    for i in range(10, 70):
        t = [rnd.choice(words) for _ in range(200)]
        texts.append((i * 3, " ".join(t)))
        t[rnd.randrange(200)] = "changed"
        texts.append((i * 3 + 1, " ".join(t)))
    df = frame(spark, texts, "fp component rid root")
    got = sorted((r.fp & (1 << 64) - 1, -1 if r.id is None else r.id, r.component) for r in S.near_duplicates(df).collect())
    prints = [slow_fingerprint(t) for _, t in texts]
    label = slow_components(prints, 4)
    least = {}
    for (i, _), x in zip(texts, label, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    assert got == sorted((p, -1 if i is None else i, least.get(x)) for p, (i, _), x in zip(prints, texts, label, strict=True))
    kept = S.deduplicate(df)
    assert kept.columns == df.columns
    assert kept.count() == len(set(label))


def test_empty_table(spark):
    assert S.near_duplicates(frame(spark, [])).collect() == []
