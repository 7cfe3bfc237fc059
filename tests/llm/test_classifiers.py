import random

import numpy as np
import pytest
from docs import ODD, frame
from pyspark.sql import functions as F

from readlake.llm import langid as L
from readlake.llm import toxicity as T
from readlake.llm.common import learning

WORDS = {"en": "the of and thing with from this that", "de": "der und nicht schön für über große", "es": "ñandú que los por está canción", "fr": "être où ça garçon pour déjà très"}


def speech(n=400, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        out.append((i, " ".join(rnd.choices(WORDS[lang].split(), k=rnd.randrange(5, 60))), lang))
    return out


def test_languages_held_out(spark, monkeypatch):
    rows = speech()
    docs = spark.createDataFrame([(i, t, None if i % 17 == 0 else lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    docs = docs.withColumn("score", F.lit("x")).withColumn("__text2", F.lit(1))
    learn = learning("doc_id", 4, 2)
    model = L.fit(docs, learn)
    assert model.labels == sorted(WORDS) and 2 * L.COLDEST < model.temperature < L.HOTTEST / 2
    assert (model.weights == 0).mean() > 0.9
    got = {r.doc_id: r for r in L.predict(docs, model, [F.col("doc_id"), (~learn).alias("held_out")]).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out]
    assert len(held) > 50 and np.mean(held) > 0.97
    odd = L.predict(frame(spark, ODD, "lang2"), model, [F.col("doc_id"), F.col("text").alias("t")]).collect()
    assert len(odd) == len(ODD)
    assert all((r.lang_pred == "und") == (r.t is None or not any(map(str.isalpha, r.t))) for r in odd)
    kept = L.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.5 for r in got.values())


def test_no_language_to_learn(spark):
    docs = frame(spark, ODD).withColumn("lang", F.lit(None).cast("string"))
    model = L.fit(docs, F.lit(True))
    assert model is None
    assert {r.lang_pred for r in L.predict(docs, model, [F.col("doc_id")]).collect()} == {"und"}
    empty = frame(spark, [])
    assert L.predict(empty, L.fit(empty, F.lit(True)), [F.col("doc_id")]).collect() == []


def test_grams_do_not_depend_on_slices(monkeypatch):
    text = "Où est -- le garçon? 12 Ünï  x" * 9
    whole = np.sort(np.concatenate(list(L.grams(text))))
    monkeypatch.setattr(L, "SLICE", 7)
    assert np.array_equal(np.sort(np.concatenate(list(L.grams(text)))), whole)


def slow_grams(text):
    """All character n-grams of a text whose runs of non-letters are one space, as lists of code points with one space before."""
    points = [32]
    for c in text.lower():
        if c.isalpha():
            points.append(ord(c))
        elif points[-1] != 32 or len(points) == 1:
            points.append(32)
    return points


def test_training_against_plain_loops(monkeypatch):
    """FTRL-proximal with an elastic net, coordinate by coordinate."""
    monkeypatch.setattr(L, "FEATURES", 40)
    rnd = np.random.default_rng(2)
    rows = [(np.sort(rnd.choice(40, 9, replace=False)), rnd.random(9), int(rnd.integers(3))) for _ in range(60)]
    weights, bias = L.train_ftrl(rows, 3)
    z, n = [[0.0] * 3 for _ in range(41)], [[0.0] * 3 for _ in range(41)]

    def weight(i, k):
        if abs(z[i][k]) <= L.L1:
            return 0.0
        return -(z[i][k] - np.sign(z[i][k]) * L.L1) / ((L.BETA + n[i][k] ** 0.5) / L.ALPHA + L.L2)

    order = np.random.default_rng(0)
    for _ in range(L.EPOCHS):
        for r in order.permutation(len(rows)):
            at, x, y = [*rows[r][0].tolist(), 40], [*rows[r][1].tolist(), 1.0], rows[r][2]
            w = [[weight(i, k) for k in range(3)] for i in at]
            e = np.exp([sum(v * wi[k] for v, wi in zip(x, w, strict=True)) for k in range(3)])
            p = e / e.sum()
            for i, v, wi in zip(at, x, w, strict=True):
                for k in range(3):
                    g = v * (p[k] - (k == y))
                    sigma = ((n[i][k] + g * g) ** 0.5 - n[i][k] ** 0.5) / L.ALPHA
                    z[i][k] += g - sigma * wi[k]
                    n[i][k] += g * g
    want = np.array([[weight(i, k) for k in range(3)] for i in range(41)])
    assert np.allclose(weights, want[:40]) and np.allclose(bias, want[40]) and (weights == 0).any()


def test_frequencies_and_predictions_against_plain_loops(spark):
    rows = speech(60) + [(100, None, "en"), (101, "12", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    idf = L.idf_of(docs)
    vectors = {i: {} for i, _, _ in rows}
    for i, t, _ in rows:
        for g in np.concatenate(list(L.grams(t))).tolist() if t and any(map(str.isalpha, t)) else []:
            vectors[i][g] = vectors[i].get(g, 0) + 1
    for f in {g for v in vectors.values() for g in v} | {5}:
        assert idf[f] == pytest.approx(np.log((1 + len(rows)) / (1 + sum(f in v for v in vectors.values()))) + 1)
    # grams: every gram of the text is one feature, equal grams are the same feature
    seen = {}
    for _, t, _ in rows[:20]:
        points = slow_grams(t)
        made = np.concatenate(list(L.grams(t)))
        assert len(made) == sum(max(0, len(points) - max(1, n - 1)) if n > 1 else len(points) - 1 for n in L.ORDERS)
        at = 0
        for n in L.ORDERS:
            for k in range(max(1, n - 1), len(points)):
                assert seen.setdefault(tuple(points[k - n + 1 : k + 1]), made[at]) == made[at]
                at += 1
    model = L.fit(docs, F.lit(True))
    for r in L.predict(docs, model, [F.col("doc_id")]).collect():
        v = vectors[r.doc_id]
        if not v:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = sum(v.values())
        logits = np.array([sum(n / total * model.idf[g] * L.SCALE * model.weights[g, k] for g, n in v.items()) + model.bias[k] for k in range(len(model.labels))])
        e = np.exp(logits / model.temperature - (logits / model.temperature).max())
        assert r.lang_pred == model.labels[int(e.argmax())] and r.score == pytest.approx(float((e / e.sum()).max()), abs=1e-6)


def test_sparse_and_calibrated_inside_the_range(spark):
    rows = speech(400)
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    touched = np.flatnonzero(model.idf < model.idf.max())
    assert 0.2 < (model.weights[touched] == 0).mean() < 1  # few words, all of them telling; 0.90 on real documents
    assert 2 * L.COLDEST < model.temperature < L.HOTTEST / 2


def test_temperature_is_the_best():
    rnd = np.random.default_rng(0)
    y = rnd.integers(0, 3, 2000)
    z = rnd.normal(0, 1, (2000, 3)) + 1.5 * np.eye(3)[y]
    for scale in (3, 0.01):
        t = L.temperature_of(z * scale, y)
        loss = lambda t: L.smoothed_loss(z * scale, y, t)  # noqa: B023, E731
        assert loss(t) <= min(loss(x) for x in np.geomspace(0.002, 500, 300)) + 1e-4
        plain = lambda t: -np.log(L.softmax(z * scale / t)[np.arange(2000), y]).mean()  # noqa: B023, E731
        assert plain(t) <= min(plain(x) for x in np.geomspace(0.002, 500, 300)) + 1e-3
    right = 5 * np.eye(3)[y]  # all told right: still not the coldest
    assert 2 * L.COLDEST < L.temperature_of(right, y) < 5


BAD = ["idiot", "moron", "scum"]
OBFUSCATED = ["1d10t", "m0r0n", "$cum", "idiooot", "i d i o t", "m-o-r-o-n", "IDIOT!!", "moron$$$", "id!ot"]


def insults(n=600, seed=8):
    rnd = random.Random(seed)
    plain = "the thing and then other words were said with room for all".split()
    docs, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.3
        t = rnd.choices(plain, k=rnd.randrange(8, 40))
        for _ in range(2 * toxic):
            t.insert(rnd.randrange(len(t)), rnd.choice(BAD))
        docs.append((i, " ".join(t)))
        labels.append((i, int(toxic) if i % 13 else None))
    return docs, labels


@pytest.fixture(scope="module")
def taught(spark):
    docs, labels = insults()
    df = frame(spark, docs, "score words r y")
    marks = spark.createDataFrame([*labels, labels[1], (None, 1), (99_999, 1)], "doc_id long, toxic int")
    learn = learning("doc_id", 5, 0)
    return df, docs, labels, learn, T.fit(df, marks, learn)


def test_toxicity_held_out(taught):
    df, docs, labels, learn, scorer = taught
    got = {r.doc_id: r for r in T.score(df, scorer, [F.col("doc_id"), (~learn).alias("held_out")]).collect()}
    right = [got[i].predicted == y for i, y in labels if y is not None and got[i].held_out]
    assert len(got) == len(docs) and len(right) > 60 and np.mean(right) > 0.98
    kept = T.reject(df, scorer)
    assert kept.columns == df.columns and kept.count() == sum(not r.predicted for r in got.values())


@pytest.mark.parametrize("written", OBFUSCATED)
def test_deobfuscation(taught, written):
    scorer = taught[4]
    words = scorer.restorer.restore(f"you are the {written} and then other words").split()
    assert set(words) & set(BAD), words
    assert scorer.score(f"said the {written} with room") > 0.5 > scorer.score("said the thing with room")


def test_clean_signs_stay_clean(taught):
    scorer = taught[4]
    for text in ("the thing 2024-11-02 at 10:30", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "all words!! were$$$ said###", "a b and c", "", "x" * 10_000):
        assert scorer.score(text) < 0.5


def test_viterbi_finds_the_best_reading():
    rnd = np.random.default_rng(5)
    model = np.log(rnd.dirichlet(np.ones(T.SYMBOLS), (T.SYMBOLS, T.SYMBOLS))).astype(np.float32)
    r = T.Restorer(model)

    def readings(segment):
        out = [("", 0.0)]
        for k, c in enumerate(segment):
            if c in T.STANDS_FOR:
                options = [(x, T.SIGN) for x in T.STANDS_FOR[c]] + ([] if c.isdigit() else [("", T.DROP)])
            else:
                options = [(c, 0.0)] if c.isalpha() else [("", T.APART), (" ", 0.0)]
            if k and segment[k - 1] == c and c.isalnum():
                options.append(("", T.REPEAT))
            out = [(o + x, s - cost) for o, s in out for x, cost in options]
        return out

    def value(text, channel):
        a = b = 0
        for c in text + " ":
            s = 0 if c == " " else T._NUMBER.get(c, T.SYMBOLS - 1)
            channel, a, b = channel + float(model[a, b, s]), b, s
        return channel

    for segment in ("1d10t", "aab!!c", "a b c", "x1-y", "oo00", "ß$é"):
        got = r.decode(segment)
        best = max(value(t, s) for t, s in readings(segment))
        assert max(value(t, s) for t, s in readings(segment) if t == got) == pytest.approx(best)


def test_toxicity_odd_and_unlabelled(spark, taught):
    scorer = taught[4]
    got = T.score(frame(spark, ODD, "score"), scorer, [F.col("doc_id")]).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    none = T.fit(frame(spark, ODD), spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert {r.predicted for r in T.score(frame(spark, ODD), none, [F.col("doc_id")]).collect()} <= {0, 1}
    assert T.score(frame(spark, []), none, [F.col("doc_id")]).collect() == []
    text = [r.restored for r in T.restored(frame(spark, [(1, "You 1d10t"), (2, None)]), scorer.restorer.model, ["doc_id"]).orderBy("doc_id").collect()]
    assert text == ["you idiot", None]


def test_language_model_against_plain_loops(spark):
    texts = ["Abba 1 ñu", None, "", "the  cat."]
    model = T.language_model(frame(spark, list(enumerate(texts))))
    counts = np.zeros((T.SYMBOLS,) * 3)
    for t in texts:
        a = b = 0
        for c in (t or "").lower():
            s = T._NUMBER.get(c, T.SYMBOLS - 1 if c.isalpha() else 0)
            counts[a, b, s] += 1
            a, b = b, s
    one = (counts.sum((0, 1)) + 1) / (counts.sum() + T.SYMBOLS)
    for a, b, s in [(0, 0, 1), (1, 2, 2), (2, 2, 1), (5, 6, 7), (0, 20, 8)]:
        two = (counts[:, b, s].sum() + 5 * one[s]) / (counts[:, b].sum() + 5)
        assert model[a, b, s] == pytest.approx(np.log((counts[a, b, s] + 5 * two) / (counts[a, b].sum() + 5)), abs=1e-5)


def test_weights_are_the_best():
    """No small step of any weight, kept from below 0, lowers the penalised loss."""
    rnd = np.random.default_rng(4)
    x = rnd.random((300, 12)) < 0.2
    y = (rnd.random(300) < 1 / (1 + np.exp(-(x @ np.array([3, 2, 1] + [0] * 6 + [-2] * 3) - 1.5)))).astype(float)
    row, at = np.nonzero(x)
    w = T.logistic(row, at, 12, y, rounds=3000)

    def loss(w):
        z = x @ w[:-1] + w[-1]
        return (np.logaddexp(0, z) - y * z).mean() + 1e-4 * w[:-1].sum() + 0.5e-4 * (w[:-1] ** 2).sum()

    assert (w[:-1] >= 0).all() and w[0] > w[2] > 0 and (w[9:12] == 0).all()
    for k in range(13):
        for step in (-1e-2, 1e-2):
            v = w.copy()
            v[k] += step
            if k == 12 or v[k] >= 0:
                assert loss(v) >= loss(w) - 1e-9


def test_traits_are_chosen_by_chi_square(taught):
    _, docs, labels, learn, scorer = taught
    allowed = {i for i, _ in docs if __import__("zlib").crc32(str(i).encode()) % 5 != 0}
    y = {i: v for i, v in labels if v is not None and i in allowed}
    has = {i: {x for w in scorer.restorer.restore(t).split() for x in T.traits(w)} for i, t in docs if i in y}
    ones, zeros = sum(y.values()), len(y) - sum(y.values())
    want = set()
    for trait in set().union(*has.values()):
        a, n = sum(y[i] for i in y if trait in has[i]), sum(trait in has[i] for i in y)
        b = n - a
        if n >= 3 and a / ones > b / zeros and (a / ones - b / zeros) ** 2 * ones * zeros / (n * (1 - n / (len(y) + 1))) >= T.CHI_SQUARE:
            want.add(trait)
    assert set(scorer.words) <= want and set(BAD) <= set(scorer.words)
    restored = {i: has[i] & set(scorer.words) for i in y}
    for i in list(y)[:50]:
        z = scorer.bias + sum(scorer.words[x] for x in restored[i])
        assert scorer.score(dict(docs)[i]) == pytest.approx(1 / (1 + np.exp(-z)))
