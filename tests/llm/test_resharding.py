import random
from collections import defaultdict

import pytest
from docs import ODD, frame
from pyspark.sql import functions as F

from readlake.llm import resharding as R


@pytest.mark.parametrize("seed", range(6))
def test_flow_moves_the_fewest(seed):
    rnd = random.Random(seed)
    old = [rnd.randrange(1000) for _ in range(rnd.randrange(1, 9))]
    m = rnd.randrange(1, 9)
    capacity = [sum(old) // m + 1 + rnd.randrange(50) for _ in range(m)]
    got = R.flow(old, capacity)
    assert all(sum(b for (i, _), b in got.items() if i == k) == size for k, size in enumerate(old))
    assert all(sum(b for (_, j), b in got.items() if j == k) <= room for k, room in enumerate(capacity))
    must = sum(max(0, size - (capacity[i] if i < m else 0)) for i, size in enumerate(old))
    assert sum(b for (i, j), b in got.items() if i != j) == must


def test_no_room():
    with pytest.raises(ValueError):
        R.flow([5, 5], [4, 5])


def test_reshard(spark):
    rnd = random.Random(1)
    texts = [*ODD[:6], *ODD[7:10]] + [(100 + i, "copy of this" if i % 3 == 0 else f"text {i} " + "y" * rnd.randrange(200)) for i in range(900)]
    rows, plan = R.reshard(frame(spark, texts, "size shard slot piece block"), 7, old_shards=5)
    got = rows.collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "", r.size) for r in got) == sorted((i is not None, i or 0, t or "", size(t)) for i, t in texts)
    held = defaultdict(list)
    for r in got:
        held[r.shard].append(r)
    assert sorted(held) == list(range(7))
    for x in held.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    sums = [sum(r.size for r in x) for x in held.values()]
    assert max(sums) - min(sums) < 0.05 * sum(sums) / 7
    homes = defaultdict(set)
    for r in got:
        homes[r.text].add(r.shard)
    assert all(len(x) == 1 for x in homes.values())  # 300 copies of one text among them
    moved = sum(r.size for r in got if r.shard != r.old_shard)
    assert moved == R.moved_bytes(plan)
    old = defaultdict(int)
    for r in got:
        old[r.old_shard] += r.size
    must = sum(max(0, b - max(sums)) for b in old.values())
    assert must <= moved <= must + 0.1 * sum(sums)


def test_rewrites_only_what_changes(spark, tmp_path):
    docs = frame(spark, [(i, f"text {i} " + "z" * 40) for i in range(400)]).withColumn("shard", F.when(F.col("doc_id") < 200, 0).when(F.col("doc_id") < 300, 1).otherwise(2))
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    docs.write.partitionBy("shard").parquet(old)
    found = R.rewrite(spark, old, new, 4, [8_000, 10_000, 10_000, 8_000])
    assert found[1].startswith(old) and found[2].startswith(old) and found[0].startswith(new) and found[3].startswith(new)
    ids = [r.doc_id for p in found.values() for r in spark.read.parquet(p).select("doc_id").collect()]
    assert sorted(ids) == list(range(400))


@pytest.mark.parametrize("old", ["doc_id % 7", "doc_id % 3", "7 - doc_id % 7", "CASE WHEN doc_id % 5 > 0 THEN doc_id % 7 END"])
def test_equal_texts_meet_from_any_layout(spark, old):
    """No text is in two new shards; copies at the home that most bytes are in needn't move; slots are gapless."""
    rnd = random.Random(3)
    texts = [(i, f"text {rnd.randrange(150)} " * 9 if i % 2 else f"own {i} " * rnd.randrange(1, 30)) for i in range(900)] + [(900 + i, None) for i in range(20)] + [(950 + i, "hot " * 50) for i in range(200)]
    got, plan = R.reshard(frame(spark, texts, "home of best"), 5, F.expr(old), 8)
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in texts)
    homes, held = {}, {}
    for r in rows:
        homes.setdefault(r.text, set()).add(r.shard)
        held.setdefault(r.shard, []).append(r)
    assert all(len(x) == 1 for x in homes.values())
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in held.values())
    assert R.moved_bytes(plan) == sum(r.size for r in rows if r.old_shard != r.shard)
    # copies away from home must move, and what is over a shard's capacity; a block more at most for each shard
    by: dict = {}
    for r in rows:
        by.setdefault(r.text, {}).setdefault(r.old_shard, []).append(r.size)
    home_bytes, away = [0] * 8, 0
    for spread in by.values():
        best = max(sum(x) for x in spread.values())
        away += sum(map(sum, spread.values())) - best
        home_bytes[max(spread, key=lambda s: (sum(spread[s]), -s))] += sum(map(sum, spread.values()))
    total = sum(r.size for r in rows)
    over = sum(max(0, h - (total // 5 if s < 5 else 0)) for s, h in enumerate(home_bytes))
    largest = max(sum(map(sum, x.values())) for x in by.values())  # blocks are moved whole
    assert R.moved_bytes(plan) <= away + over + largest + total // 20


def test_many_old_shards(spark):
    texts = [(i, f"text {i % 3000}") for i in range(6000)]
    got, plan = R.reshard(frame(spark, texts), 4, F.expr("(doc_id * 7919) % 20000"), 20_000)
    homes: dict = {}
    for r in got.collect():
        homes.setdefault(r.text, set()).add(r.shard)
    assert len(homes) == 3000 and all(len(x) == 1 for x in homes.values())


def least_moved(blocks, capacity):
    """Fewest bytes that leave their shard in any assignment of whole blocks that fits."""
    best = [None]

    def place(k, room, moved):
        if best[0] is not None and moved >= best[0]:
            return
        if k == len(blocks):
            best[0] = moved
            return
        shard, _, size = blocks[k]
        for j in range(len(room)):
            if room[j] >= size:
                place(k + 1, [*room[:j], room[j] - size, *room[j + 1 :]], moved + (size if j != shard else 0))

    place(0, capacity, 0)
    return best[0]


@pytest.mark.parametrize("seed", range(8))
def test_planner_against_brute_force(seed):
    rnd = random.Random(seed)
    blocks = [(rnd.randrange(3), k, rnd.randrange(1, 9)) for k in range(8)]
    total = sum(b[2] for b in blocks)
    capacity = [total // 3 + 9] * 3  # a block more than an equal share
    home = R.transfers(blocks, capacity)
    held = [sum(b[2] for b in blocks if home[b[0], b[1]] == j) for j in range(3)]
    assert len(home) == len(blocks) and all(h <= c for h, c in zip(held, capacity, strict=True))
    moved = sum(b[2] for b in blocks if home[b[0], b[1]] != b[0])
    assert moved <= least_moved(blocks, capacity) + 9


def test_many_shards():
    n = 3000
    got = R.flow([10 + i % 3 for i in range(n)], [11] * (n + 100))
    assert sum(b for (i, j), b in got.items() if i != j) == sum(i % 3 == 2 for i in range(n))


def test_empty(spark):
    rows, plan = R.reshard(frame(spark, []), 3)
    assert rows.collect() == [] and plan.collect() == []
