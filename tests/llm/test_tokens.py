import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from docs import ODD, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from readlake.llm import packing as P
from readlake.llm import token_store as T
from readlake.llm import tokens
from readlake.llm.queries import tokenizer_path

PATH = tokenizer_path()
WHOLE = Tokenizer.from_file(PATH)
TEXTS = [*ODD, (20, "It's THE end<|endoftext|>now 'S 'Re x'LL İstanbul ΣΑΣ ß Ǆ 12½ á é b c\x1cd \u0085"), (21, "don't   STOP!!! -- 3.14 a_b ñandú")]


def ids_of(text, end):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, end]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aA'sT1 .!\n\téÉßñµ×Σİ<|>")), st.characters(exclude_categories=["Cs"]))))
def test_encoder_equals_tokenizer(text):
    assert list(np.frombuffer(tokens.encoder(PATH).encode(text.encode()), "<u4")) == WHOLE.encode(text, add_special_tokens=False).ids


def test_encoder_with_little_room(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PIECES", 5)
    monkeypatch.setattr(tokens, "MOST_WORDS", 5)
    monkeypatch.setattr(tokens, "SLICE", 16)
    enc = tokens.WordEncoder(PATH)
    for _, text in TEXTS[:9] + TEXTS[-2:]:
        assert list(np.frombuffer(enc.encode((text or "").encode()), "<u4")) == ids_of(text, 0)[:-1]


def many(n=300, seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}x" for i in range(80)]
    return [(i * 7 % 1000, " ".join(rnd.choices(words, k=rnd.randrange(60)))) for i in range(n)]


def test_store_round_trip(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BYTES", 2000)
    texts = TEXTS + [(1000 + i, t) for i, t in many()]
    out = T.store_path(spark)
    T.write(frame(spark, texts, "part nth ids"), out, PATH, 1)
    got = T.read(spark, out).collect()
    want = sorted((i is not None, i or 0, ids_of(t, 1)) for i, t in texts)
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(np.frombuffer(r.ids, "<u4"))) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [i if real else None for real, i, _ in want]
    index = spark.read.parquet(f"{out}/index")
    content = T.dictionary(spark, out)
    assert content and {r.dict_hash for r in index.collect()} == {T.dict_hash(content)}
    one = T.read(spark, out, "doc_id = 1007").collect()
    assert [list(np.frombuffer(r.ids, "<u4")) for r in one] == [ids_of(t, 1) for i, t in texts if i == 1007]
    # a frame can't be read without the shared dictionary
    row = index.where("doc_id = 1007").first()
    block = spark.read.parquet(f"{out}/blocks").where(f"part = {row.part} and nth = {row.nth}").first()
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(bytes(block.payload[row["at"] : row["at"] + row["size"]]))


def test_store_of_few_and_none(spark):
    for texts in ([], [(3, None)]):
        out = T.store_path(spark)
        T.write(frame(spark, texts), out, PATH, 1)
        assert [(r.doc_id, r.start, r.n_tokens) for r in T.read(spark, out).collect()] == [(i, 0, 1) for i, _ in texts]


TOTALS = [(1,), (5000, 3), (100_000, 50_000, 7), (123_457, 0, 88_888, 1, 4096 * 20), (256,), (4096 * 64,), tuple(range(0, 90_000, 1000))]


@pytest.mark.parametrize("totals", TOTALS)
@pytest.mark.parametrize("shares", [None, "even", "odd"])
def test_schedule_fills_every_place_once(totals, shares):
    targets = {None: None, "even": [1] * len(totals), "odd": [k % 3 for k in range(len(totals))]}[shares]
    plan = P.Schedule(totals, targets)
    seen = np.zeros(plan.total, np.int8)
    for q, n in enumerate(totals):
        assert sum(t for _, t in plan.stretches(q, 0, n)) == n
        for p, t in plan.stretches(q, 0, n):
            seen[p : p + t] += 1
        middle = n // 3  # from anywhere it's the same
        whole = [p + k for p, t in plan.stretches(q, 0, n) for k in range(t)]
        assert [p + k for p, t in plan.stretches(q, middle, n - middle) for k in range(t)] == whole[middle:]
    assert (seen == 1).all()


@pytest.mark.parametrize("totals", [(700_000, 200_000, 100_000), tuple(30_000 + 997 * k for k in range(20)), (900_000, 40, 7_000, 3)])
@pytest.mark.parametrize("shares", [None, "even", "first", "rising"])
def test_every_window_holds_the_mixture(totals, shares):
    """Against a simulation in exact fractions: no source is off by three tokens in any window in which none runs dry."""
    n = len(totals)
    given = {None: None, "even": [1] * n, "first": [5, 1] + [0] * (n - 2), "rising": list(range(1, n + 1))}[shares]
    plan, full = P.Schedule(totals, given), sum(totals) // 4096
    window = np.zeros((full, n))
    for q, size in enumerate(totals):
        for p, t in plan.stretches(q, 0, size):
            if p < full * 4096:
                assert p // 4096 == (p + t - 1) // 4096
                window[p // 4096, q] += t
    assert (window.sum(axis=1) == 4096).all()
    left, want = [Fraction(x) for x in totals], given or totals
    for w in range(full):
        room, ideal, dry = Fraction(4096), [Fraction(0)] * n, False
        while room:
            live = [q for q in range(n) if left[q] and want[q]] or [q for q in range(n) if left[q]]
            weight = [want[q] or totals[q] for q in live]
            step = min(room, *(left[q] * sum(weight) / w for q, w in zip(live, weight, strict=True)))
            for q, x in zip(live, weight, strict=True):
                ideal[q] += step * x / sum(weight)
                left[q] -= step * x / sum(weight)
            room -= step
            dry = dry or room > 0
        if not dry and all(x > 4096 or not x for x in left):
            assert max(abs(a - b) for a, b in zip(window[w], ideal, strict=True)) < 3


def test_pack(spark):
    texts = TEXTS + [(2000 + i, t) for i, t in enumerate(t for _, t in many(400, 2))]
    for targets in (None, {"s0": 1, "s2": 5.5, "none": 3}):
        got = P.pack(frame(spark, texts, "queue part n start"), PATH, 2, targets=targets).collect()
        ids = {i: ids_of(t, 2) for i, t in texts}
        cover: dict = {}
        for r in got:
            part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
            assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(part) == r.ids_crc32
            cover.setdefault(r.doc_id, []).append((r.start, r.length))
        for i, _ in texts:
            copies = sum(j == i for j, _ in texts)
            assert sum(n for _, n in cover[i]) == copies * len(ids[i])
        sequences: dict = {}
        for r in got:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        partial = 0
        for seq in sequences.values():
            at = 0
            for offset, n in sorted(seq):
                assert offset == at
                at += n
            assert at & at - 1 == 0 and at <= 4096  # nothing is padded
            partial += at < 4096
        assert partial <= 12 and sorted(sequences) == list(range(len(sequences)))


def test_pack_none(spark):
    assert P.pack(frame(spark, []), PATH, 2).collect() == []


def test_many_texts_as_one_by_one(monkeypatch):
    words = ["ré", "İ", "x×", "5", "a.", "Ωa", "'S", "it's", "<|endoftext|>", "ǀ", "é", "Ñ÷", "ab_c", "\U0001f600", "\x1c", "ß", "ß1"]
    texts = [" ".join(w + m for m in ["", *".,;:!?", "?!"] for w in words), *(t for _, t in TEXTS), "  x ", "b, b b,", " "]
    end = (7).to_bytes(4, "little")
    for size in (30, 1 << 20):
        monkeypatch.setattr(tokens, "SLICE", size)
        enc = tokens.WordEncoder(PATH)
        for cut in (pa.array(["left out", *texts], pa.string()).slice(1), pa.array(texts[::-1], pa.large_string())):
            got, at = [], 0
            for start, stop, ids in enc.encoded(cut, end):
                assert start == at and stop - start == len(ids)
                got, at = got + ids.to_pylist(), stop
            assert [list(np.frombuffer(x, "<u4")) for x in got] == [ids_of(t, 7) for t in cut.to_pylist()]
    assert list(enc.encoded(pa.array([], pa.string()), end)) == []
    assert [ids.to_pylist() for _, _, ids in enc.encoded(pa.array([None, ""], pa.string()), end)] == [[end, end]]


def test_a_piece_is_looked_up_once_for_many_texts():
    class Counting(dict):
        asked = 0

        def get(self, key):
            self.asked += 1
            return super().get(key)

    enc = tokens.WordEncoder(PATH)
    enc.known = Counting()
    texts = ["one two, two three. " * 200, "two; one!"] * 50
    for k in range(2):
        got = [x for _, _, ids in enc.encoded(pa.array(texts)) for x in ids.to_pylist()]
        assert got[:2] == [np.array(ids_of(t, 0)[:-1], "<u4").tobytes() for t in texts[:2]] and got == got[:2] * 50
        assert enc.known.asked <= 7 * (k + 1)  # six pieces, and none at the end of a text
