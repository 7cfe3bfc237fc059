"""SimHash near-duplicates found by bit-sliced comparison.

Fingerprints are cut into blocks; two fingerprints within the radius agree in some set of whole blocks, so rows are dealt
by (block set, value) and compared only inside such buckets. There the fingerprints lie as bit planes: one 64-bit word
holds one bit of 64 fingerprints, carry-save counters add up 64 distances at once, and a word whose 64 distances all
exceed the radius is abandoned. Buckets larger than a tile are compared as pairs of tiles in separate tasks. A task gives
out a spanning forest of its links, never all pairs; distributed components join the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm.common import discard, free_name, hinted, release, words_of, written
from readlake.llm.components import components

BITS, SEED = 64, 42
#: Words hashed at once, and fingerprints of a tile.
SLICE, TILE = 200_000, 4096


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of a whole text: a bit is 1 if over half of the shingles' XXH64 have it. No words: 0."""
    words = words_of(text)
    if not words:
        return 0
    total, votes, n = max(1, len(words) - shingle + 1), np.zeros(BITS, np.int64), 0
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, SLICE):
        part = words[start : start + SLICE + shingle - 1]
        joined = b" ".join(part)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        end = begin + sizes
        k = min(SLICE, total - start)
        first, last = begin[:k].tolist(), end[min(shingle, len(part)) - 1 :][:k].tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(k, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += k
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        out = np.fromiter((fingerprint(x.as_py(), shingle) for x in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["rid", "id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, rid_col: str | None = None) -> DataFrame:
    """(rid, id, fp), one row per row of docs, as a written table; rid (rid_col, else a new number) tells repeated rows apart."""
    rid = F.col(rid_col) if rid_col else F.monotonically_increasing_id()
    rows = docs.select(rid.alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(lambda it: _fingerprints(it, shingle), "rid long, id long, fp long"), "simhash")


def _block_masks(blocks: int) -> list[int]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def table_masks(radius: int, blocks: int) -> list[int]:
    """Bit masks, one per table: fingerprints within the radius agree on all bits of at least one of them."""
    masks = _block_masks(blocks)
    return [sum(masks[i] for i in keep) for keep in combinations(range(blocks), blocks - radius)]


def blocks_for(rows: int, radius: int) -> int:
    """The fewest blocks at which random fingerprints give buckets of about a tile at most."""
    blocks = radius + 1
    while rows >> (BITS * (blocks - radius) // blocks) > TILE and blocks < radius + 4:
        blocks += 1
    return blocks


class Forest:
    """Union of links by vectorised minimum labels."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            odd = x != y
            if not odd.any():
                return
            a, b, x, y = a[odd], b[odd], x[odd], y[odd]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(label, up := label[label]):
                label = up
            self.label = label


def _exceeds(c: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter, bits c from low to high, is over the radius."""
    above, equal = np.zeros_like(over), ~np.zeros_like(over)
    for i in reversed(range(len(c))):
        if radius >> i & 1:
            equal = equal & c[i]
        else:
            above |= equal & c[i]
            equal = equal & ~c[i]
    return above | over


def close_lanes(planes: np.ndarray, values: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, bits: list[int], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (query, word) those with lanes within the radius: their query, word and lane bits."""
    width = max(1, radius.bit_length())
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    zero = np.zeros(len(query), np.uint64)
    c, over = [zero.copy() for _ in range(width)], zero.copy()
    for i in range(0, len(bits), 2):
        pair = []
        for b in bits[i : i + 2]:
            flip = np.where(values[query] >> np.uint64(b) & np.uint64(1), full, np.uint64(0))
            pair.append(planes[b][word] ^ flip)
        if len(pair) == 2:  # carry-save: two bits and the low counter in, one sum and one carry out
            half = pair[0] ^ pair[1]
            carry = pair[0] & pair[1] | half & c[0]
            c[0] = half ^ c[0]
        else:
            carry, c[0] = c[0] & pair[0], c[0] ^ pair[0]
        for k in range(1, width):
            carry, c[k] = c[k] & carry, c[k] ^ carry
        over |= carry
        if i % 8 == 6 or i + 2 >= len(bits):
            lanes = lanes & ~_exceeds(c, over, radius)
            keep = np.flatnonzero(lanes)
            if len(keep) < 0.7 * len(lanes):  # abandoned words leave
                query, word, lanes, over, c = query[keep], word[keep], lanes[keep], over[keep], [x[keep] for x in c]
            if not len(keep):
                break
    keep = np.flatnonzero(lanes)
    return query[keep], word[keep], lanes[keep]


def close_pairs(groups: list[tuple[np.ndarray, int]], bits: list[int], radius: int, chunk: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b), in `laid(groups)`, of the fingerprints within the radius, over groups of (fingerprints, rows of the first tile).

    A group's first tile is compared with what follows it; first tile 0 means that all are compared with all.
    """
    values, valid, at = laid(groups)
    planes = np.stack([np.packbits((values >> np.uint64(b) & np.uint64(1)).astype(bool), bitorder="little").view(np.uint64) for b in range(BITS)])
    real = np.packbits(valid, bitorder="little").view(np.uint64)
    todo_q, todo_w = [], []

    def run() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        query, word = np.concatenate(todo_q), np.concatenate(todo_w)
        todo_q.clear()
        todo_w.clear()
        for s in range(0, len(query), chunk):
            q, w = query[s : s + chunk], word[s : s + chunk]
            lanes = real[w].copy()
            own = q >> 6 == w  # in its own word a query meets the later lanes only
            shift = (q[own] & 63).astype(np.uint64)
            lanes[own] &= ~((np.uint64(2) << shift) - np.uint64(1))
            q, w, lanes = close_lanes(planes, values, q, w, lanes, bits, radius)
            if len(q):
                row, lane = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                yield q[row], w[row] * 64 + lane

    size = 0
    for (f, first), a in zip(groups, at, strict=False):
        n, w0 = len(f), a >> 6
        words = -(-n // 64)
        if first:
            q = np.arange(first)
            start = np.full(first, first >> 6)
        else:
            q = np.arange(n)
            start = q >> 6
        counts = words - start
        todo_q.append(np.repeat(q + a, counts))
        todo_w.append(np.repeat(w0 + start - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum()))
        size += counts.sum()
        if size > 1 << 20:
            yield from run()
            size = 0
    if todo_q:
        yield from run()


def laid(groups: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups end to end, each from a word of its own: values, which places are taken, and where each group begins."""
    padded = [-(-len(f) // 64) * 64 for f, _ in groups]
    at = np.concatenate(([0], np.cumsum(padded))).astype(np.int64)
    values, valid = np.zeros(at[-1], np.uint64), np.zeros(at[-1], bool)
    for (f, _), a in zip(groups, at, strict=False):
        values[a : a + len(f)], valid[a : a + len(f)] = f, True
    return values, valid, at


def forest_links(groups: list[tuple[np.ndarray, int]], bits: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (a, b) of the fingerprints within the radius, over the groups of `close_pairs`."""
    values, _, at = laid(groups)
    forest = Forest(int(at[-1]))
    for a, b in close_pairs(groups, bits, radius):
        forest.add(a, b)
    tied = np.flatnonzero(forest.label != np.arange(len(forest.label)))
    return values[tied], values[forest.label[tied]]


def _compare(batches: Iterator[pa.RecordBatch], masks: list[int], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (t, key, i, j, side, fp), sorted by all of them: links of every (t, key, i, j)."""
    held: list[np.ndarray] = []
    waiting: dict[int, list[tuple[np.ndarray, int]]] = {}
    weight = 0

    def emit() -> Iterator[pa.RecordBatch]:
        nonlocal weight
        for t, groups in waiting.items():
            bits = [b for b in range(BITS) if not masks[t] >> b & 1]
            a, b = forest_links(groups, bits, radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])
        waiting.clear()
        weight = 0

    def close(rows: np.ndarray) -> None:
        nonlocal weight
        if len(rows) < 2:
            return
        i, j, side = rows[0, 2], rows[0, 3], rows[:, 4]
        f = rows[:, 5].view(np.uint64)
        if i == j:
            waiting.setdefault(int(rows[0, 0]), []).append((f, 0))
        else:
            a, b = f[side == 0], f[side == 1]
            if not len(a) or not len(b):
                return
            pad = -len(a) % 64  # the second tile begins at a word of its own: repeat the last row, which links to itself only
            waiting.setdefault(int(rows[0, 0]), []).append((np.concatenate([a, np.repeat(a[-1:], pad), b]), len(a) + pad))
        weight += len(f)

    for batch in batches:
        rows = np.column_stack([np.asarray(batch.column(k).cast(pa.int64())) for k in range(6)])
        if held:
            rows = np.concatenate([*held, rows])
            held.clear()
        cut = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
        parts = np.split(rows, cut)
        for part in parts[:-1]:
            close(part)
            if weight > 1 << 16:
                yield from emit()
        held.append(parts[-1].copy())
    if held:
        close(np.concatenate(held))
    yield from emit()


def links(distinct: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """(u, v): enough of the pairs of distinct fp within the radius to connect all that are so linked."""
    blocks = blocks or blocks_for(distinct.count(), radius)
    masks = table_masks(radius, blocks)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("t", "key"))
    # buckets over a tile are cut into tiles; every pair of tiles is a unit of its own
    crowded = written(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("t", "key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "crowded")
    tiled = keyed.join(hinted(crowded, crowded.count()), ["t", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = tiled.withColumn("tile", F.expr("cast(pmod(xxhash64(fp), tiles) as int)"))
    unit = own.select("t", "key", "tile", F.explode(F.expr("sequence(0, tiles - 1)")).alias("other"), "fp")
    unit = unit.select("t", "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), F.when(F.col("tile") <= F.col("other"), 0).otherwise(1).alias("side"), "fp")
    dealt = unit.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "side", "fp")
    return dealt.mapInArrow(lambda it: _compare(it, masks, radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, rid_col: str | None = None) -> DataFrame:
    """(rid, id, fp, component): component is the smallest id reachable over links of at most `radius` differing bits.

    Null texts and texts without words have fingerprint 0 and are linked like any other; null ids take part and get the
    component of their fingerprint (null if it has no other id); repeated rows stay, one result each; other columns are
    not read, so their names don't matter; an empty table gives an empty result.
    """
    prints = fingerprints(docs, id_col, text_col, shingle, rid_col)
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    found = components(links(distinct, radius))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_print = rooted.join(least, "root").select(F.col("fp").alias("of"), "component")
    return prints.join(by_print, prints.fp == by_print.of).select("rid", "id", "fp", "component")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """docs with one row of each component: that of the smallest id (null last), one of repeated rows; all columns stay.

    Rows are numbered once, in a written table.
    """
    rid = free_name(docs, "rid")
    numbered = written(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered, id_col, text_col, shingle, radius, rid)
    # rows without any id share a component by fingerprint only
    group = [F.col("component"), F.when(F.col("component").isNull(), F.col("fp"))]
    kept = found.groupBy(*[g.alias(f"g{i}") for i, g in enumerate(group)]).agg(F.min_by("rid", F.struct(F.col("id").isNull(), "id", "rid")).alias(rid))
    return numbered.join(kept.select(rid), rid, "left_semi").drop(rid)


# ---- a similarity instead of a radius ---------------------------------------------------------------------------------
#: Bands of ROWS least hashes: the buckets in which fingerprints are compared. Sets of similarity s share one with
#: 1 - (1 - s^5)^28, which is 0.99998 at 0.8 and more above.
BANDS, ROWS = 28, 5
#: Differing bits up to which a pair's sets are compared: at similarity 0.8 the bits differ by 9.7 with a deviation of 2.9.
WIDE = 22
#: Rounds in which members are compared with one of their bucket, before those left apart are compared with each other.
ROUNDS = 3
#: Shingles that are permuted at once.
PERMUTED = 2048

_random = np.random.default_rng(SEED)
_FLIP = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """The sorted distinct XXH64 of a text's shingles; fewer words than a shingle are one shingle, no words none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    total = max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + shingle]), SEED) for i in range(total)), np.uint64, total))


def set_fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of a set of hashes."""
    votes = np.zeros(BITS, np.int64)
    for start in range(0, len(shingles), SLICE):
        part = shingles[start : start + SLICE]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(shingles), bitorder="little").view(np.uint64)[0])


def band_keys(shingles: np.ndarray) -> list[int]:
    """One signed 64-bit key a band; none for an empty set."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for start in range(0, len(shingles), PERMUTED):
        part = shingles[start : start + PERMUTED]
        least = np.minimum(least, ((part[None, :] ^ _FLIP[:, None]) * _TIMES[:, None]).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


SETS = "id long, th long, node long, n long, fp long, keys array<long>"


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            sets = [shingle_set(x.as_py(), shingle) for x in part.column(2).cast(pa.binary())]
            whole = lambda values: pa.array(np.fromiter(values, np.uint64, len(sets)).view(np.int64))  # noqa: B023, E731
            nodes, prints = whole(xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), whole(map(set_fingerprint, sets))
            columns = [part.column(0), part.column(1), nodes, pa.array(map(len, sets), pa.int64()), prints, pa.array(map(band_keys, sets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "th", "node", "n", "fp", "keys"])


def _shingles(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            sets = [shingle_set(x.as_py(), shingle).tobytes() for x in part.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])


def _near_first(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, u_fp, v_fp): those whose fingerprints are within the radius, compared bit-sliced for each u."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for batch in batches:
        u_fp, v_fp = (np.asarray(batch.column(c)).view(np.uint64) for c in (2, 3))
        order = np.argsort(u_fp, kind="stable")
        query, lanes = np.unique(u_fp[order]), v_fp[order]
        begin = np.searchsorted(u_fp[order], query)
        end = np.append(begin[1:], len(order))
        padded = np.zeros(-(-len(lanes) // 64) * 64, np.uint64)
        padded[: len(lanes)] = lanes
        planes = np.stack([np.packbits((padded >> np.uint64(b) & np.uint64(1)).astype(bool), bitorder="little").view(np.uint64) for b in range(BITS)])
        first, many = begin >> 6, ((end - 1) >> 6) - (begin >> 6) + 1
        q = np.repeat(np.arange(len(query)), many)
        w = np.repeat(first - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        low, high = np.maximum(begin[q] - w * 64, 0), np.minimum(end[q] - w * 64, 64)
        mask = (full >> (64 - (high - low)).astype(np.uint64)) << low.astype(np.uint64)
        _, w, found = close_lanes(planes, query, q, w, mask, list(range(BITS)), radius)
        row, lane = np.nonzero(np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        yield batch.select(["u", "v"]).take(pa.array(order[w[row] * 64 + lane]))


def _units(batches: Iterator[pa.RecordBatch], with_sets: bool) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Rows (key, i, j, side, fp, node, n, root, keys[, shingles]), sorted by the first four, unit by unit: numbers, keys, sets."""
    held: list[tuple] = []
    for batch in batches:
        rows = np.column_stack([np.asarray(batch.column(k).cast(pa.int64())) for k in range(8)])
        keys = np.asarray(batch.column(8).flatten()).reshape(len(rows), -1)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(9)] if with_sets else []
        if held:
            rows, keys, sets = np.concatenate([held[0], rows]), np.concatenate([held[1], keys]), held[2] + sets
        cut = [0, *(np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1).tolist(), len(rows)]
        for a, b in zip(cut[:-2], cut[1:-1], strict=True):
            yield rows[a:b], keys[a:b], sets[a:b]
        held = [rows[cut[-2] :].copy(), keys[cut[-2] :].copy(), sets[cut[-2] :]]
    if held:
        yield tuple(held)


def _open_pairs(rows: np.ndarray, keys: np.ndarray, radius: int, least: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a unit's rows within the radius, of different roots and like sizes; a pair of nodes only in the first band that they share."""
    if len(rows) < 2 or (rows[:, 7] == rows[0, 7]).all():
        return
    place, first = np.arange(len(rows)), 0
    if rows[0, 1] != rows[0, 2]:
        a, b = np.flatnonzero(rows[:, 3] == 0), np.flatnonzero(rows[:, 3] == 1)
        if not len(a) or not len(b):
            return
        first = len(a) + (-len(a) % 64)
        place = np.concatenate([a, np.repeat(a[-1:], first - len(a)), b])
    for x, y in close_pairs([(rows[place, 4].view(np.uint64), first)], list(range(BITS)), radius):
        x, y = place[x], place[y]
        small, large = np.minimum(rows[x, 6], rows[y, 6]), np.maximum(rows[x, 6], rows[y, 6])
        keep = (rows[x, 7] != rows[y, 7]) & (small * least[1] >= large * least[0])
        x, y = x[keep], y[keep]
        band = np.argmax(keys[x] == keys[y], axis=1)
        keep = keys[x, band] == rows[x, 0]
        yield x[keep], y[keep]


def _marked(batches: Iterator[pa.RecordBatch], radius: int, least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(key, node): members of units that have a pair there."""
    for rows, keys, _ in _units(batches, False):
        mark = np.zeros(len(rows), bool)
        for x, y in _open_pairs(rows, keys, radius, least):
            mark[x] = mark[y] = True
        if mark.any():
            yield pa.RecordBatch.from_arrays([pa.array(rows[mark, 0]), pa.array(rows[mark, 5])], ["key", "node"])


def _linked(batches: Iterator[pa.RecordBatch], radius: int, least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(u, v): links of each unit's pairs that connect all that are so linked; whole sets decide."""
    for rows, keys, sets in _units(batches, True):
        label: dict[int, int] = {}

        def top(r: int) -> int:
            while (up := label.get(r, r)) != r:  # noqa: B023
                label[r] = label.get(up, up)  # noqa: B023
                r = up
            return r

        found = []
        for xs, ys in _open_pairs(rows, keys, radius, least):
            for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                a, b = top(int(rows[x, 7])), top(int(rows[y, 7]))
                if a != b and similar(sets[x], sets[y], least):
                    label[max(a, b)] = min(a, b)
                    found.append((rows[x, 5], rows[y, 5]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["u", "v"])


def similar(x: np.ndarray, y: np.ndarray, least: tuple[int, int]) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least the fraction."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * least[1] >= (len(x) + len(y) - both) * least[0]


def _alike(batches: Iterator[pa.RecordBatch], least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    of = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
    for batch in batches:
        keep = [similar(of(a), of(b), least) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def similar_links(texts: DataFrame, sets: DataFrame, least: tuple[int, int] = (4, 5), shingle: int = 5, radius: int = WIDE) -> DataFrame:
    """(u, v): enough pairs of nodes whose sets' Jaccard similarity is at least the fraction to connect all candidates so linked.

    texts: (id, th, text), th a hash of the text; sets: what `_sets` makes of them. Nodes that share a band are a bucket. In
    a few rounds every member is compared with one member of its bucket, another one each round; what that links is one
    component, so a large cluster of near copies costs a few comparisons a member. After that only members of a bucket
    that are still in different components are compared with each other, in the task that has their sets. Fingerprints
    within the radius make a pair, whose whole sets decide.
    """
    nodes = sets.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min("th").alias("th"))
    keyed = written(nodes.select("node", "th", "n", "fp", F.explode("keys").alias("key")), "bands")
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(keyed.join(shared, "key"), "buckets")
    discard(keyed)
    like = lambda a, b: F.least(a, b) * least[1] >= F.greatest(a, b) * least[0]
    both = lambda df: df.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))

    def sets_of(asked: DataFrame) -> DataFrame:
        """(node, shingles) of a written table of distinct nodes."""
        asked_th = written(asked.join(members.select("node", F.col("th").alias("of")).distinct(), "node"), "asked")
        rows = texts.join(hinted(asked_th, asked_th.count()), F.col("th") == F.col("of")).select("node", "text").dropDuplicates(["node"])
        return written(rows.mapInArrow(lambda it: _shingles(it, shingle), "node long, shingles binary"), "asked-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        whole = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        a, b = (whole.select(F.col("node").alias(c), F.col("shingles").alias(c + "_set")) for c in "uv")
        out = written(pairs.join(a, "u").join(b, "v").select("u", "v", "u_set", "v_set").mapInArrow(lambda it: _alike(it, least), "u long, v long"), "links")
        discard(whole)
        return out

    def dealt(rows: DataFrame, tile: int, *more: str) -> DataFrame:
        """Members of buckets (with size), in units of two tiles at most."""
        tiled = rows.withColumn("tiles", F.ceil(F.col("size") / tile).cast("int")).withColumn("tile", F.expr("cast(pmod(xxhash64(node), tiles) as int)"))
        unit = tiled.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
        unit = unit.select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), F.when(F.col("tile") <= F.col("other"), 0).otherwise(1).alias("side"), "fp", "node", "n", "root", *more)
        return unit.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")

    # buckets whose members are not all in one component
    open_, tested, found = members.withColumn("root", F.col("node")), [], []
    for turn in range(ROUNDS):
        chosen = F.min_by(F.struct("node", "n", "fp", "root"), F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn)))
        met = open_.join(open_.groupBy("key").agg(chosen.alias("first")), "key").where("root <> first.root").where(like("n", "first.n"))
        met = met.select(F.col("first.node").alias("u"), F.col("node").alias("v"), F.col("first.fp").alias("u_fp"), F.col("fp").alias("v_fp")).distinct()
        near = both(met.mapInArrow(lambda it: _near_first(it, radius), "u long, v long")).distinct()
        for before in tested:
            near = near.join(before, ["u", "v"], "left_anti")
        tested.append(written(near, "near"))
        found.append(verified(tested[-1]))
        if turn and not found[-1].limit(1).count():
            break
        roots = components(reduce(DataFrame.unionByName, found)).select(F.col("node").alias("of"), "root")
        rooted = members.join(roots, F.col("node") == F.col("of"), "left").select("key", "node", "n", "fp", "size", F.coalesce("root", "node").alias("root"))
        mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        last, open_ = open_, written(rooted.join(mixed, "key"), "open")
        if turn:
            discard(last)
    # members that have a pair left to test, then these pairs where their sets are: no pair is ever a row
    told = open_.join(nodes.select("node", "keys"), "node")
    marked = written(dealt(told, TILE, "keys").mapInArrow(lambda it: _marked(it, radius, least), "key long, node long").distinct(), "marked")
    whole = sets_of(marked.select("node").distinct())
    crowd = marked.groupBy("key").agg(F.count("*").alias("size"))
    rest = told.drop("size").join(marked, ["key", "node"]).join(crowd, "key").join(whole, "node")
    found.append(written(dealt(rest, TILE // 8, "keys", "shingles").mapInArrow(lambda it: _linked(it, radius, least), "u long, v long"), "rest-links"))
    discard(members, open_, marked, whole, *tested)
    return reduce(DataFrame.unionByName, found)


def deduplicate_similar(docs: DataFrame, least: tuple[int, int] = (4, 5), shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of links: that of the smallest id (null last), one of repeated rows; all columns stay.

    Texts are linked if the Jaccard similarity of their sets of `shingle` words is at least the fraction `least`; texts
    without words (and nulls) are all alike. A row is told by its id and a hash of its text, so docs may come in any order
    each time they are read; any column name is safe.
    """
    id_, th = free_name(docs, "id"), free_name(docs, "th")
    told = docs.withColumns({id_: F.col(id_col).cast("long"), th: F.xxhash64(F.col(text_col))})
    texts = told.select(F.col(id_).alias("id"), F.col(th).alias("th"), F.col(text_col).alias("text"))
    sets = written(texts.mapInArrow(lambda it: _sets(it, shingle), SETS), "sets")
    found = components(similar_links(texts, sets, least, shingle)).select(F.col("node").alias("of"), "root")
    rooted = sets.select("id", "th", "node").join(found, F.col("node") == F.col("of"), "left").select("id", "th", F.coalesce("root", "node").alias("root"))
    # one (id, th) of each component stays; of those on several rows, one
    rows = written(rooted.groupBy("root", "id", "th").agg(F.count("*").alias("rows")), "roots")
    discard(sets)
    kept = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("kept"))
    judged = rows.join(kept, "root").withColumn("stays", F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("th") == F.col("kept.th")))
    odd = written(judged.where(~F.col("stays") | (F.col("rows") > 1)).select(F.col("id").alias("__i"), F.col("th").alias("__t"), "stays"), "others")
    discard(rows)
    odd = hinted(odd, odd.count())
    same = told[id_].eqNullSafe(odd["__i"]) & (told[th] == odd["__t"])
    once = told.join(odd.where("stays"), same, "left_semi").dropDuplicates([id_, th])
    return told.join(odd, same, "left_anti").unionByName(once).drop(id_, th)
