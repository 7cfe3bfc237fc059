"""Queries that must not read texts again and again, or hold what grows with the whole table in one task."""

import random

import pytest
from pyspark.sql import functions as F

from readlake.plans.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(3)
    texts = ["", None, "nnnn", "ACGT", "a!n~N" * 300, "ü n € N"] + ["".join(rnd.choices("acgtnACGTN xyz!~é", k=rnd.randrange(300))) for _ in range(60)]
    path = tmp_path_factory.mktemp("scale")
    rows = [(3 * i, x, "de" if i % 3 else "en", f"src{i % 4}") for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_merge_reads_texts_once(spark, folder):
    found = QUERIES["oversized_merge"](spark, folder)
    assert "text" not in plan(found)
    rows = found.orderBy("nth").collect()
    assert [r.nth for r in rows] == list(range(1, 67)) and [r.rec for r in rows] == [3 * i for i in range(66)]
    assert {r.oversized for r in rows} == {True, False}


def test_gaps_order_records_only(spark, folder):
    """Bases are exploded after everything is in place: no row of a base is sorted or joined."""
    from readlake.plans.queries import reads

    found = QUERIES["unknown_gaps"](spark, folder)
    above = plan(found).split("Generate")[0]
    assert "Sort" not in above and "Join" not in above and "Window" not in above
    want, first, before = [], 1, 0
    for r in reads(spark, folder).orderBy("rec").collect():
        for i, (c, q) in enumerate(zip(r.seq, r.qual.ljust(len(r.seq), "("))):
            if c == "N" and q != "!":
                want.append((first + i, first + i - before))
                before = first + i
        first += len(r.seq)
    assert len(want) > 300 and sorted(map(tuple, found.collect())) == want


def test_restored_outside_of_expressions(spark, folder):
    """Bases are put back by arrays over many records, not by an expression for each base."""
    from readlake.plans.queries import reads

    found = QUERIES["unknown_restore"](spark, folder)
    assert "lambdafunction(" not in plan(found)
    want = [(r.rec, i, c if c == "N" else str("ACGT".index(c))) for r in reads(spark, folder).collect() for i, (c, q) in enumerate(zip(r.seq, r.qual.ljust(len(r.seq), "("))) if c == "N" or q == "!"]
    assert len(want) > 300 and sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["adaptive_cost_halved", "adaptive_cost_halved_qual", "adaptive_cost_halved_bytes"])
def test_contexts_sort_bytes(spark, folder, name):
    """What a context's one task sorts was packed before: arrays of numbers would be four bytes a symbol and more."""
    found = QUERIES[name](spark, folder)
    assert "MapInArrow packed(" in plan(found).split("Sort")[1]
    assert len(found.where("n > 0 and bits > 0").collect()) == (4 if name.endswith("bytes") else 2)


def test_reads_are_coded_outside_of_expressions(spark, tmp_path):
    """Headers and sequences are coded by arrays over many records, not by an expression for each character or token."""
    import hashlib

    rows = [(k, k * 37 % 101, k % 13, n, "ANR"[k % 3]) for k in range(0, 90, 3) for n in range(1, 5)] + [(1, 1, 1, 3, None), (2, None, 1, 1, "A")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string").repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = QUERIES["typed_columns"](spark, str(tmp_path))
    assert "lambdafunction(" not in plan(found)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    bases = lambda x: md5(x).translate(str.maketrans("0123456789abcdef", "ACGT" * 4))
    want = []
    for k, part, supplier, n, flag in rows:
        seq = None if part is None else md5(bases(f"{k}.{part}") + ("NNn" if n == 3 else "") + bases(str(supplier)))
        want.append((k, n, None if None in (part, flag) else md5(f"L{k}:{n}:{part} {supplier}/{flag}"), seq))
    key = lambda r: (r[0], r[1], str(r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
