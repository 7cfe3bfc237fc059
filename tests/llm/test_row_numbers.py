"""Rows that come in another order each time they are read are told apart all the same."""

import random

import pytest
from docs import SCHEMA
from test_classifiers import insults, speech
from test_inverted_index import slow as slow_hits

from readlake.llm import inverted_index, langid, simhash_neardup, toxicity
from readlake.llm.common import learning


def unstable(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).coalesce(1).mapInPandas(lambda it: (b.sample(frac=1) for b in it), SCHEMA.replace("n_chars long", "n_chars double"))


def rows_of(texts):
    return [(i, t, "en", "s", None) for i, t in texts]


@pytest.fixture(scope="module")
def hit(spark):
    rnd = random.Random(2)
    bench = [(0, " ".join(f"q{k}" for k in range(30)))]
    texts = [(i, " ".join(f"w{rnd.randrange(99)}" for _ in range(20)) + (" " + bench[0][1] if i % 3 == 0 else "")) for i in range(300)]
    return texts, bench, spark.createDataFrame(bench, "item_id long, text string")


def test_contaminated(spark, hit):
    texts, bench, table = hit
    got = {r.id: r.contaminated for r in inverted_index.contaminated(unstable(spark, rows_of(texts)), table).collect()}
    assert got == {i: slow_hits(t, bench, 13)[-1] for i, t in texts}


def test_decontaminate(spark, hit):
    texts, bench, table = hit
    got = inverted_index.decontaminate(unstable(spark, rows_of(texts)), table).collect()
    assert sorted(r.doc_id for r in got) == [i for i, t in texts if not slow_hits(t, bench, 13)[-1]]


def test_toxicity(spark):
    docs, labels = insults()
    df = spark.createDataFrame(rows_of(docs), SCHEMA)
    scorer = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"), learning("doc_id", 5, 0))
    got = toxicity.reject(unstable(spark, rows_of(docs)), scorer).collect()
    assert sorted(r.doc_id for r in got) == [i for i, t in docs if scorer.score(t) < 0.5]


def test_language(spark):
    rows = speech()
    model = langid.fit(spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], SCHEMA), learning("doc_id", 4, 2))
    texts = [(i, t if i % 2 else "12 34") for i, t, _ in rows]
    got = langid.keep_identified(unstable(spark, rows_of(texts)), model).collect()
    assert sorted(r.doc_id for r in got) == [i for i, t in texts if i % 2 and model.predict(t)[1] >= 0.5]


def test_deduplicate(spark):
    texts = [(i, " ".join(f"w{i // 3}x{k}" for k in range(20))) for i in range(300)]
    got = simhash_neardup.deduplicate(unstable(spark, rows_of(texts))).collect()
    assert sorted(r.doc_id for r in got) == list(range(0, 300, 3))
