import random

import corpus_pipeline as C
import pytest
from docs import frame
from pyspark.sql import functions as F
from test_classifiers import BAD, WORDS
from test_inverted_index import slow as slow_hits
from test_similar import slow_kept
from test_tokens import ids_of


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(11)
    bench = [(i, " ".join(f"q{rnd.randrange(50)}" for _ in range(30))) for i in range(5)]
    docs, labels = [], []
    for i in range(500):
        lang = rnd.choice(list(WORDS))
        t = [f"{w}" for w in rnd.choices(WORDS[lang].split(), k=rnd.randrange(20, 60))] + [f"n{i}x{k}" for k in range(8)]
        toxic = rnd.random() < 0.25
        if toxic:
            for _ in range(3):
                t.insert(rnd.randrange(len(t)), rnd.choice(BAD))
        if i % 29 == 0:
            t += rnd.choice(bench)[1].split()
        docs.append((i, " ".join(t), lang, f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    docs += [(600 + k, docs[k][1], docs[k][2], "s9", 0) for k in range(0, 60, 2)] + [(700, None, None, None, None), (701, "", "en", "s1", 0), (702, "12 34 --", "en", "s1", 0), (703, docs[3][1] + " tail", docs[3][2], "s1", 0)]
    docs += [(710 + k, docs[k][1].rsplit(" ", 1)[0] + f" e{k}", docs[k][2], "s2", 0) for k in range(1, 40, 4)]  # near copies
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), docs, bench


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, corpus):
    d, docs, bench = corpus
    text = {r[0]: r[1] for r in docs}
    now = spark.read.parquet(f"{d}/documents.parquet")
    columns = now.columns
    toxic = {i for i, t in text.items() if set((t or "").split()) & set(BAD)}
    now = C.drop_toxic(spark, now, d)
    assert now.columns == columns and ids(now) == sorted(set(text) - toxic)
    now = C.keep_identified_languages(spark, now, d).cache()
    left = sorted(set(text) - toxic - {700, 701, 702})
    assert now.columns == columns and ids(now) == left
    kept = C.drop_near_duplicates(spark, now, d).cache()
    alone = slow_kept([(i, text[i]) for i in left])  # sets of five-word shingles, 0.8 and more, over all pairs
    assert kept.columns == columns and ids(kept) == alone and not set(alone) & set(range(710, 760))
    clean = C.drop_contaminated(spark, kept, d).cache()
    assert clean.columns == columns and ids(clean) == [i for i in ids(kept) if not slow_hits(text[i], bench, 13)[-1]]
    assert set(ids(clean)) != set(ids(kept))
    packed = C.pack_mixture(spark, clean, d).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == {i: len(ids_of(text[i], 2)) for i in ids(clean)}


def test_run(spark, corpus):
    d, docs, _ = corpus
    out = C.run(spark, d)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = out.collect()
    assert rows and sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
    assert [name for name, _ in C.STAGES] == ["toxicity", "language_id", "simhash_neardup", "benchmark_decontamination", "packing"]


def test_empty(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert C.run(spark, str(tmp_path)).collect() == []
