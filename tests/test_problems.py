import pytest
from pyspark.sql import Observation

from readlake.operators import records as P

ROWS = [
    (0, "a b", "ACGTN", "+", "IIIII", None, []),
    (1, "a", "ACGT", "+a", "IIII", None, []),
    (2, "a", "ACGT", "+b", "III", None, ["odd second id", "length mismatch"]),
    (3, "a", "AXN.n", "-", "IIIII", "no +", ["no +", "illegal base", "mixed unknowns"]),
    (4, "." * 65, "", "+ ", "", "no @", ["no @", "many delimiters"]),
    (5, "a", None, None, None, "truncated", ["truncated"]),
    (6, None, None, None, None, None, []),
    (7, "." * 64, "0123", "+", "IIII", None, []),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([r[:6] for r in rows], "rec long, header string, seq string, plus string, qual string, problem string")


def test_all_reasons_in_one_pass(spark):
    seen = Observation("seen")
    got = {r.rec: r.problems for r in P.with_problems(frame(spark), seen).collect()}
    assert got == {r[0]: r[6] for r in ROWS}
    assert seen.get["records"] == 8 and seen.get["bad"] == 4 and seen.get["length mismatch"] == 1 and seen.get["truncated"] == 1
    counts = {r.reason: r.n for r in P.problem_counts(frame(spark)).collect()}
    assert counts["none"] == 4 and sum(counts.values()) == 4 + sum(len(r[6]) for r in ROWS)
    assert P.problem_counts(frame(spark, ROWS[:1]).limit(0)).collect() == []


def test_limit(spark):
    assert P.limited(frame(spark), 4).count() == 8
    with pytest.raises(ValueError, match="4 bad records, more than 3: .*no \\+ 1"):
        P.limited(frame(spark), 3)
