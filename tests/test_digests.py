import random

from readlake.operators import inspect as I

ROWS = "k string, rec long, a string, b long"


def check(spark, left, right, keys, block=16):
    a, b = (spark.createDataFrame(x, ROWS).repartition(3) for x in (left, right))
    got = {(*[r[k] for k in keys], r.rec): (r.left_rows, r.right_rows, r.changed) for r in I.differences(a, b, ["a", "b"], keys, block=block).collect()}
    want, at = {}, [{}, {}]
    for side, rows in enumerate((left, right)):
        for k, rec, x, y in rows:
            at[side].setdefault((k, rec) if keys else (rec,), []).append((x, y))
    key = lambda rows: sorted(rows, key=str)
    for i in {*at[0], *at[1]}:
        x, y = at[0].get(i, []), at[1].get(i, [])
        if key(x) != key(y):
            want[i] = len(x), len(y), [c for c, p, q in zip("ab", x[0], y[0], strict=True) if p != q] if len(x) == len(y) == 1 else None
    assert got == want


def test_differences(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["x", "y", None]), i, rnd.choice(["", None, "p", "é"]), rnd.choice([None, 0, 7])) for i in range(300)]
    check(spark, rows, rows, ["k"])
    check(spark, rows, [], ["k"])
    check(spark, [], [], ["k"])
    other = list(rows)
    other[17] = (*rows[17][:2], "changed", rows[17][3])
    other[99] = (*rows[99][:2], "" if rows[99][2] is None else None, rows[99][3])
    other[200] = (*rows[200][:3], 8)
    del other[250]
    other += [rows[5], ("new", 3, "a", 1), ("x", None, "a", 1)]
    check(spark, rows, other, ["k"])
    check(spark, rows, other, [])
    check(spark, rows, rows[::-1], [])


def test_only_differing_blocks_are_read(spark):
    """Of 100 blocks one differs: the comparison reads that block's rows of both sides, and none where tables agree."""
    df = spark.range(1600).selectExpr("'f' AS k", "id AS rec", "cast(id AS string) AS a", "id AS b")
    other = df.selectExpr("k", "rec", "CASE WHEN rec = 700 THEN 'x' ELSE a END AS a", "b")
    d = I.digests(df, ["a", "b"], ["k"], block=16), I.digests(other, ["a", "b"], ["k"], block=16)
    assert [tuple(r) for r in I.differing_blocks(*d, ["k"]).collect()] == [("f", 43)]
    assert d[0].count() == 100 and I.differing_blocks(d[0], d[0], ["k"]).count() == 0
    odd = I.differing_blocks(*d, ["k"]).collect()[0].block
    assert df.where(f"floor(rec / 16) = {odd}").count() == 16  # of 1600
    total = d[0].selectExpr("sum(n)", "sum(hi)", "sum(lo)").first()
    assert tuple(total) == tuple(I.digests(df, ["a", "b"], [], block=10**9).select("n", "hi", "lo").first())
