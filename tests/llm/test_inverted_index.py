import hashlib
import random
import re

from docs import ODD, frame

from readlake.llm import inverted_index as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(text, items, size):
    w, hit, found = slow_words(text), set(), set()
    for name, t in items:
        v = slow_words(t)
        for i in range(max(1, len(v) - size + 1) if v else 0):
            win = v[i : i + size]
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def cases(seed=4):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["é", "Ⅻ", "a1"]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([3, 13, 20, 40])))) for i in range(12)] + [(50, None), (51, " .. "), (52, "The QUICK-brown fox")]
    texts = list(ODD)
    for i in range(60):
        t = rnd.choices(vocabulary, k=rnd.randrange(200))
        for _ in range(rnd.randrange(3)):
            v = slow_words(rnd.choice(items[:12])[1])
            a = rnd.randrange(len(v))
            t[len(t) // 2 : len(t) // 2] = v[a:] if rnd.random() < 0.5 else v
        texts.append((100 + i, ", ".join(t)))
    return texts + [(300, "the quick brown! fox"), (301, "the quick brown")], items


def test_contaminated(spark, monkeypatch):
    texts, items = cases()
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    want = sorted((i is not None, i or 0, *slow(t, items, 13)) for i, t in texts)
    for block, a_pass in ((2_000_000, 2_000_000), (300, 2_000_000), (500, 60)):
        monkeypatch.setattr(I, "BLOCK_WORDS", block)
        monkeypatch.setattr(I, "PASS_WORDS", a_pass)
        df = frame(spark, texts, "rid spans items words")
        got = [(r.id is not None, r.id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in I.contaminated(df, bench).collect()]
        assert len(got) == len(texts)
        assert sorted(got) == want
        kept = I.decontaminate(df, bench)
        assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted(g[1] for g in got if not g[-1])


def test_search_exact_and_near(spark, monkeypatch):
    rnd = random.Random(6)
    texts = [(i, " ".join(rnd.choices("a b c d".split(), k=40))) for i in range(30)] + [(30, None), (31, ""), (32, "a"), (33, "b")]
    df = frame(spark, texts).withColumnRenamed("doc_id", "rid")
    monkeypatch.setattr(I, "GAP", 4)  # so that proximity could reach the next document
    index = I.build(df)
    assert I.frequencies(index, [b"a", b"b", b"c", b"d", b"none"]).sum() == 30 * 40 + 2
    phrases = ["A, b c", "d d", "c", "", None, "none", "a " * 7]
    got = sorted((r.rid, r.phrase, r.at) for r in I.search(index, phrases).collect())
    want = [(i, p, k) for i, t in texts for p, phrase in enumerate(phrases) for k in range(40) if (w := slow_words(phrase)) and slow_words(t)[k : k + len(w)] == w]
    assert got == sorted(want)
    for slop in (1, 60):
        close = {(r.rid, r.phrase, r.at) for r in I.search(index, ["a b", "none a"], slop=slop).collect()}
        reach = slop + 1
        rare = min("ab", key=lambda c: (sum((t or "").split().count(c) for _, t in texts), c))
        other = "b" if rare == "a" else "a"
        assert close == {(i, 0, k) for i, t in texts for k, w in enumerate((t or "").split()) if w == rare and other in t.split()[max(0, k - reach) : k + reach + 1]}
    empty = I.build(frame(spark, []).withColumnRenamed("doc_id", "rid"))
    assert I.search(empty, phrases).collect() == []


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert I.contaminated(frame(spark, []), none).collect() == []
    assert {(r.n_hit, r.n_items, r.contaminated) for r in I.contaminated(frame(spark, ODD), none).collect()} == {(0, 0, False)}
