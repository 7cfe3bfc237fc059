"""Minimum-cost-flow resharding: from old shard sizes to new capacities, moving the fewest bytes, then rewriting what changed.

Equal texts stay together: a text's home is the old shard that holds most bytes of it, and copies elsewhere go where the
home's go. Rows are cut into blocks within their home, by a hash of the text. A flow from old shards to new ones, where staying costs nothing and moving costs one a byte, tells how many
bytes go where; whole blocks are then assigned to these transfers. The planner sees block sizes only.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readlake.llm.common import hinted, scratch_path, written

#: Blocks of all shards together, pieces that an overlarge block is cut into at most, and bytes of a file about.
BLOCKS, PIECES, FILE_BYTES = 32_768, 512, 8 << 20


class Network:
    """Minimum-cost flow by successive shortest distances: each distance's paths are filled together."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def edge(self, u: int, v: int, room: int, cost: int) -> int:
        """Its number; the next number is its reverse, whose room is the edge's flow."""
        for a, b, r, c in ((u, v, room, cost), (v, u, 0, -cost)):
            self.out[a].append(len(self.to))
            self.to.append(b)
            self.left.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        potential = [0] * len(self.out)
        while (far := self._distances(source, potential))[sink] is not None:
            most = max(d for d in far if d is not None)
            potential = [p + (most if d is None else d) for p, d in zip(potential, far, strict=True)]
            while self._fill(source, sink, potential):
                pass

    def _distances(self, source: int, potential: list[int]) -> list[int | None]:
        far: list[int | None] = [None] * len(self.out)
        far[source] = 0
        heap = [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in self.out[u]:
                v = self.to[e]
                new = d + self.cost[e] + potential[u] - potential[v]
                if self.left[e] and (far[v] is None or new < far[v]):
                    far[v] = new
                    heapq.heappush(heap, (new, v))
        return far

    def _fill(self, source: int, sink: int, potential: list[int]) -> bool:
        """Fill all paths of fewest edges among those of the least cost; whether there was one."""
        level = {source: 0}
        queue = deque([source])
        open_ = lambda u, e: self.left[e] and self.cost[e] + potential[u] == potential[self.to[e]]
        while queue:
            u = queue.popleft()
            for e in self.out[u]:
                if self.to[e] not in level and open_(u, e):
                    level[self.to[e]] = level[u] + 1
                    queue.append(self.to[e])
        if sink not in level:
            return False
        tried = [0] * len(self.out)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                amount = min(self.left[e] for e in path)
                for e in path:
                    self.left[e] -= amount
                    self.left[e ^ 1] += amount
                path, u = [], source
            elif tried[u] < len(self.out[u]):
                e = self.out[u][tried[u]]
                if level.get(self.to[e]) == level[u] + 1 and open_(u, e):
                    path.append(e)
                    u = self.to[e]
                else:
                    tried[u] += 1
            elif path:
                u = self.to[path.pop() ^ 1]
                tried[u] += 1
            else:
                return True


def flow(old: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j of least total cost; a byte that stays in shard i = j costs 0, a moved one 1.

    Capacities must hold all bytes. Moves pass one hub, so there are as many edges as shards, not as pairs of them.
    """
    n, m = len(old), len(capacity)
    if sum(capacity) < sum(old):
        raise ValueError("the new shards can't hold the old ones")
    hub, source, sink = n + m, n + m + 1, n + m + 2
    net = Network(n + m + 3)
    stay, leave, come = {}, {}, {}
    for i, size in enumerate(old):
        net.edge(source, i, size, 0)
        if i < m:
            stay[i] = net.edge(i, n + i, size, 0)
        leave[i] = net.edge(i, hub, size, 1)
    # of moves that cost the same, those to empty and roomy shards come first: fewer files change
    for j, room in sorted(enumerate(capacity), key=lambda x: (x[0] < n and old[x[0]] > 0, -x[1] + (old[x[0]] if x[0] < n else 0))):
        come[j] = net.edge(hub, n + j, room, 0)
        net.edge(n + j, sink, room, 0)
    net.run(source, sink)
    used = lambda e: net.left[e ^ 1]
    out = {(i, i): used(e) for i, e in stay.items() if used(e)}
    needs = [[j, used(e)] for j, e in come.items() if used(e)]
    for i, e in leave.items():
        left = used(e)
        while left:
            j, need = needs[-1]
            take = min(left, need)
            out[i, j] = out.get((i, j), 0) + take
            left, needs[-1][1] = left - take, need - take
            if not needs[-1][1]:
                needs.pop()
    return out


def transfers(blocks: list[tuple[int, int, int]], capacity: list[int]) -> dict[tuple[int, int], int]:
    """New shard of each block (old shard, block number, bytes): the flow's transfers filled with whole blocks, largest first."""
    old: dict[int, int] = defaultdict(int)
    for shard, _, size in blocks:
        old[shard] += size
    sizes = [old.get(i, 0) for i in range(max(old, default=-1) + 1)]
    wanted = flow(sizes, capacity)
    home: dict[tuple[int, int], int] = {}
    room = list(capacity)
    given: dict[int, dict[int, int]] = defaultdict(dict)
    for (i, j), b in wanted.items():
        given[i][j] = b
    left: dict[int, int] = {}
    for n, (shard, number, size) in enumerate(ordered := sorted(blocks, key=lambda b: (b[0], -b[2], b[1]))):
        if not n or ordered[n - 1][0] != shard:
            left = given[shard]
        if size:
            # stay if there is room, else the transfer with the most bytes left to give
            j = shard if left.get(shard, 0) >= size else max(left, key=lambda j: (left[j], j == shard, -j))
            home[shard, number] = j
            left[j] -= size
            room[j] -= size
        else:
            home[shard, number] = shard if shard < len(capacity) else 0
    return _levelled(blocks, home, room)


def _levelled(blocks: list[tuple[int, int, int]], home: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Small blocks pass from an overfull shard to the emptiest while that brings the two closer together."""
    held: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for shard, number, size in blocks:
        held[home[shard, number]].append((size, shard, number))
    for x in held.values():
        x.sort()
    for _ in range(len(room) * 64):
        low, high = min(range(len(room)), key=lambda j: room[j]), max(range(len(room)), key=lambda j: room[j])
        if room[low] >= 0:
            break
        gap = room[high] - room[low]
        fit = [b for b in held[low] if 0 < b[0] < gap]
        if not fit:
            break
        size, shard, number = min(fit, key=lambda b: (b[1] == low, abs(2 * b[0] - gap)))  # what has moved already goes first
        held[low].remove((size, shard, number))
        held[high].append((size, shard, number))
        home[shard, number] = high
        room[low] += size
        room[high] -= size
    return home


def reshard(docs: DataFrame, shards: int, old: Column | None = None, old_shards: int = 20, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, out: str | None = None, capacity: list[int] | None = None, changed_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Deal docs to `shards` shards of near-equal bytes, moving as few bytes as can be from the shards of `old`.

    Gives (rows, plan). rows is read from the new shards' files in folder out: doc_id, text, size, old_shard, shard, slot
    (gapless from 0 in each shard). plan: home, block, piece, salt of each block with size, n, shard, one row for every
    old_shard that holds some of it. A null text has size `overhead`; null ids and repeated rows are dealt like any other, a
    null old shard is shard 0; other columns are not kept; an empty table gives empty shards. Equal texts are in one shard
    afterwards, wherever they were; of a text only the copies that aren't at home count as moved for that, and the fewest
    bytes move under this rule. With equal capacities (the default) shards differ by about a block, 1/256 of a shard, unless
    the copies of one text need more. With changed_only, shards that neither give nor get a row are not written. Without
    `old`, rows start in `old_shards` shards by a hash of the text. The driver holds a number for each block, of which there
    are about BLOCKS, or one for each old shard and 256 for each new one where that is more.
    """
    spark = docs.sparkSession
    old = F.pmod(F.xxhash64(F.col(text_col)), F.lit(old_shards)) if old is None else F.coalesce(old, F.lit(0))
    blocks = max(1, BLOCKS // 2 // max(1, old_shards))
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + overhead
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), size.alias("size"), old.cast("int").alias("old_shard"), F.xxhash64(F.col(text_col)).alias("of"))
    # only texts that lie in several old shards need a home other than their own shard
    held = rows.groupBy("of", "old_shard").agg(F.sum("size").alias("bytes")).groupBy("of").agg(F.count("*").alias("k"), F.max_by("old_shard", F.struct("bytes", -F.col("old_shard"))).alias("best"))
    spread = written(held.where("k > 1").select(F.col("of").alias("__of"), "best"), "spread")
    rows = rows.join(hinted(spread, spread.count()), F.col("of") == F.col("__of"), "left").withColumn("home", F.coalesce("best", "old_shard")).drop("of", "__of", "best")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("text", F.lit("block")), F.lit(blocks)).cast("int"))
    coarse = written(rows.groupBy("home", "block").agg(F.sum("size").alias("bytes")), "coarse-blocks")
    total = coarse.agg(F.sum("bytes")).first()[0] or 0
    # overlarge blocks are cut by another hash of the text; what is still overlarge holds many copies, whose rows are only
    # numbered apart. There are few of either: each has many shares of the bytes
    most = max(1, total // (shards * 256))
    times = F.least(F.lit(PIECES), F.ceil(F.col("bytes") / most)).cast("int")
    part = lambda c, of, word: F.when(F.col(of).isNull(), 0).otherwise(F.pmod(F.xxhash64(c, F.lit(word)), F.col(of))).cast("int")
    large = coarse.where(F.col("bytes") > most).select("home", "block", times.alias("pieces"))
    cut = rows.join(hinted(large, large.count()), ["home", "block"], "left").withColumn("piece", part("text", "pieces", "piece"))
    fine = written(cut.where("pieces is not null").groupBy("home", "block", "piece").agg(F.sum("size").alias("bytes")), "pieces")
    crowded = fine.where(F.col("bytes") > 2 * most).select("home", "block", "piece", times.alias("salts"))
    cut = cut.join(hinted(crowded, crowded.count()), ["home", "block", "piece"], "left").withColumn("salt", part("doc_id", "salts", "salt"))
    place = ["home", "block", "piece", "salt"]
    cut = cut.select("doc_id", "text", "size", "old_shard", *place)
    sizes = written(cut.groupBy(*place, "old_shard").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "block-sizes")
    listed = [(r["home"], (r["block"], r["piece"]), r["size"]) for r in sizes.groupBy(*place[:3]).agg(F.sum("size").alias("size")).collect()]
    capacity = capacity or [total // shards + (j < total % shards) for j in range(shards)]
    names = {b: k for k, b in enumerate(sorted({b for _, b, _ in listed}))}
    to = transfers([(i, names[b], size) for i, b, size in listed], capacity) if listed else {}
    moves = spark.createDataFrame([(i, *b, to[i, names[b]]) for i, b, _ in listed], "home int, block int, piece int, shard int")
    plan = written(sizes.join(hinted(moves, len(listed)), place[:3]), "transfers")
    whole = plan.groupBy(*place, "shard").agg(F.sum("n").alias("n"))
    if changed_only:
        ends = plan.where("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("changed")).distinct()
        whole = whole.join(hinted(ends, shards + old_shards), F.col("shard") == F.col("changed"), "left_semi")
    first = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(whole.withColumn("first", first).select(*place, "shard", "first"), "starts")
    # rows meet once: in the part of a shard that makes up a file, ordered block by block
    files = max(1, -(-total // (shards * FILE_BYTES)))
    placed = cut.join(hinted(starts, starts.count()), place)
    placed = placed.withColumn("file", F.pmod(F.hash("block", "piece", "salt"), F.lit(files))).repartition("shard", "file")
    rank = F.row_number().over(Window.partitionBy("shard", "file", *place).orderBy("doc_id", F.xxhash64("text")))
    final = placed.withColumn("slot", F.col("first") + rank - 1).select("doc_id", "text", "size", "old_shard", "slot", "shard")
    out = out or scratch_path(spark, "shards")
    final.write.option("compression", "zstd").partitionBy("shard").parquet(out)
    schema = "doc_id long, text string, size long, old_shard int, slot long, shard int"
    return spark.read.schema(schema).parquet(out), plan


def rewrite(spark: SparkSession, folder: str, out: str, shards: int, capacity: list[int] | None = None, **columns: str) -> dict[int, str]:
    """Reshard a folder of files under shard=<number>: the folder that holds each new shard afterwards.

    Only shards that give or get a block are rewritten (below out); the others keep their files where they are. Nulls,
    repeats and empty folders of files are treated as by `reshard`; of other columns of the files none is kept in what is
    rewritten.
    """
    docs = spark.read.parquet(folder)
    _, plan = reshard(docs, shards, F.col("shard"), max(shards, (docs.agg(F.max("shard")).first()[0] or 0) + 1), out=out, capacity=capacity, changed_only=True, **columns)
    moved = plan.where("shard <> old_shard").select("shard", "old_shard").distinct().collect()
    changed = {r["shard"] for r in moved} | {r["old_shard"] for r in moved}
    return {j: f"{out if j in changed else folder}/shard={j}" for j in range(shards)}


def moved_bytes(plan: DataFrame) -> int:
    """Bytes of a plan that leave their shard."""
    return plan.where("shard <> old_shard").agg(F.sum("size")).first()[0] or 0
