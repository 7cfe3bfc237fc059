"""Lines that many documents repeat, found by a sharded minimal perfect hash and dropped everywhere.

A line's key (stripped, lower-cased) is known by a 128-bit hash. The distinct hashes are dealt to shards; each shard is one
row: a minimal perfect hash that numbers its keys, and at these numbers a fingerprint (64 of the 128 bits) and the count of
documents. Documents probe these arrays: no line meets another line.

The perfect hash has levels of bits. A key that is alone at its place of a level is settled there and its number is the
rank of that bit; keys that meet go on to the next level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.llm.common import LOWER, held, hinted, release, written

#: Keys of a shard, bytes of all arrays that are broadcast, occurrences that one task probes in a shard, lines hashed at once.
SHARD_KEYS, BROADCAST_BYTES, PROBES, LINES = 1 << 20, 64 << 20, 1 << 21, 100_000
_SPACE = b" \t\n\v\f\r"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def keys_of(lines: list[bytes]) -> list[bytes]:
    """Each line without [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased."""
    return [line.strip(_SPACE).translate(LOWER) for line in lines]


def hashes(keys: list[bytes], least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, hi, lo): the places of keys of at least so many code points, and their 128-bit hashes."""
    points = len if least_chars <= 1 else lambda k: len(k.decode("utf-8", "replace"))
    which = [i for i, k in enumerate(keys) if points(k) >= least_chars]
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(keys[i]) for i in which), ">u8").astype(np.uint64).reshape(-1, 2)
    return np.array(which, np.int64), both[:, 0], both[:, 1]


def _mixed(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    """64 bits that differ from level to level, of both halves of a hash."""
    x = hi + (lo ^ np.uint64(level + 1)) * _MIX[0]
    x = (x ^ x >> np.uint64(30)) * _MIX[1]
    x = (x ^ x >> np.uint64(27)) * _MIX[2]
    return x ^ x >> np.uint64(31)


def _shard(hi: np.ndarray, shards: int) -> np.ndarray:
    return ((hi >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


@dataclass(frozen=True)
class Shard:
    """widths: bits of each level; words: all levels' bits; fingerprints and counts in the order of the keys' numbers."""

    widths: np.ndarray
    words: np.ndarray
    fingerprints: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Shard:
        """hi, lo: distinct; n: documents."""
        widths, levels, rest, settled = [], [], np.arange(len(hi)), []
        while len(rest):
            width = -(-max(64, len(rest) * 5 // 4) // 64) * 64
            at = (_mixed(hi[rest], lo[rest], len(widths)) % np.uint64(width)).astype(np.int64)
            alone = np.bincount(at, minlength=width) == 1
            mine = alone[at]
            settled.append(rest[mine][np.argsort(at[mine])])
            widths.append(width)
            levels.append(np.packbits(alone, bitorder="little"))
            rest = rest[~mine]
        order = np.concatenate(settled) if settled else rest
        return Shard(np.array(widths, np.int32), np.concatenate(levels).view("<u8") if levels else np.zeros(0, "<u8"), lo[order], n[order])

    def row(self) -> list:
        small = self.counts.astype(f"<u{next(w for w in (1, 2, 4, 8) if not len(self.counts) or int(self.counts.max()) < 1 << 8 * w)}")
        return [self.widths.tolist(), self.words.tobytes(), self.fingerprints.astype("<u8").tobytes(), small.tobytes()]

    @staticmethod
    def read(widths: list[int], words: bytes, fingerprints: bytes, counts: bytes) -> Shard:
        prints = np.frombuffer(fingerprints, "<u8")
        return Shard(np.array(widths, np.int64), np.frombuffer(words, "<u8"), prints, np.frombuffer(counts, f"<u{len(counts) // max(1, len(prints)) or 1}"))

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Documents that hold each key; 0 for a key that isn't here (told by its fingerprint, wrongly once in 2^64)."""
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        out, rest, base = np.zeros(len(hi), np.int64), np.arange(len(hi)), 0
        for level, width in enumerate(self.widths.tolist()):
            if not len(rest):
                break
            at = base + (_mixed(hi[rest], lo[rest], level) % np.uint64(width)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit & np.uint64(1)).astype(bool)
            number = before[at[here] >> 6] + np.bitwise_count(word[here] & (np.uint64(1) << bit[here]) - np.uint64(1))
            found = rest[here]
            right = self.fingerprints[number] == lo[found]
            out[found[right]] = self.counts[number[right]]
            rest, base = rest[~here], base + width
        return out


COUNTED = "shard long, hi long, lo long, n long"
ARRAYS = "shard long, keys long, total long, widths array<int>, words binary, fingerprints binary, counts binary"


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Stretches of rows with the lines of their texts, about LINES lines at a time; a null text is one empty line."""
    for batch in batches:
        start, lines, n = 0, [], 0
        for k, text in enumerate(batch.column(column).cast(pa.binary())):
            lines.append((text.as_py() or b"").split(b"\n"))
            n += len(lines[-1])
            if n >= LINES:
                yield batch.slice(start, k + 1 - start), lines
                start, lines, n = k + 1, [], 0
        if lines:
            yield batch.slice(start), lines


def _flat(lines: list[list[bytes]], least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hi, lo) of the lines that have a key; place counts over all these lines."""
    which, hi, lo = hashes(keys_of([x for row in lines for x in row]), least_chars)
    return np.repeat(np.arange(len(lines)), [len(x) for x in lines])[which], which, hi, lo


@dataclass(frozen=True)
class Index:
    """arrays: the written table ARRAYS, one row a shard; least_chars: code points of the shortest key."""

    arrays: DataFrame
    shards: int
    size: int
    least_chars: int


def build(docs: DataFrame, least_chars: int = 1, text_col: str = "text") -> Index:
    """Index all distinct keys of the lines of docs with the number of documents (rows) that hold each.

    A null text is one empty line; keys of fewer than least_chars code points are left out; an empty table has no shard.
    Repeats within a document count once. Counts are summed in the tasks that read, before anything is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for _, lines in _texts(batches, 0):
            row, _, hi, lo = _flat(lines, least_chars)
            order = np.lexsort((row, lo, hi))
            row, hi, lo = row[order], hi[order], lo[order]
            same = (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1])
            new = np.concatenate(([True], ~same)) if len(row) else np.zeros(0, bool)
            counted = np.concatenate(([True], ~same | (row[1:] != row[:-1]))) if len(row) else new
            first = np.flatnonzero(new)
            n = np.add.reduceat(counted.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hi[first].view(np.int64)), pa.array(lo[first].view(np.int64)), pa.array(n)], ["hi", "lo", "n"])

    def shard(key: tuple, table: pa.Table) -> pa.Table:
        hi, lo, n = (table.column(c).to_numpy() for c in ("hi", "lo", "n"))
        made = Shard.of(hi.view(np.uint64), lo.view(np.uint64), n)
        values = [key[0].as_py(), len(n), int(n.sum()), *made.row()]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["shard", "keys", "total", "widths", "words", "fingerprints", "counts"])

    counted = written(docs.select(text_col).mapInArrow(count, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n")), "lines")
    shards = max(1, -(-counted.count() // SHARD_KEYS))
    of = F.shiftrightunsigned("hi", 33) % shards
    arrays = written(counted.withColumn("shard", of).groupBy("shard").applyInArrow(shard, ARRAYS), "arrays")
    size = arrays.agg(F.sum(F.length("words") + F.length("fingerprints") + F.length("counts"))).first()[0] or 0
    return Index(arrays, shards, size, least_chars)


def _kept(lines: list[bytes], drop: set[int]) -> str:
    return b"\n".join(x for i, x in enumerate(lines) if i not in drop).decode("utf-8", "replace")


def _answers(batch: pa.RecordBatch, lines: list[list[bytes]], drops: Callable[[int], set[int]]) -> pa.RecordBatch:
    """A stretch of rows, its last column, the text, replaced by n_lines, n_dropped and the lines that are kept."""
    found = [drops(i) for i in range(len(lines))]
    new = [pa.array([len(x) for x in lines], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([_kept(x, d) for x, d in zip(lines, found, strict=True)], pa.string())]
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], "n_lines", "n_dropped", "kept"])


def clean(docs: DataFrame, index: Index, columns: list[Column], least: int = 10, text_col: str = "text") -> DataFrame:
    """columns of docs with n_lines, n_dropped and kept: the text without the lines whose keys `least` documents hold.

    Other lines stay as they are, joined by line feeds. A null text is one empty line, kept as ''. Repeated rows stay; extra
    columns and their names don't matter; an empty table gives an empty result. Arrays of at most BROADCAST_BYTES go to
    every worker and the texts stay where they are read; beyond, hashes go to the shards and come back as line numbers.
    """
    slim = docs.select(*columns, F.col(text_col).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]]
    out = ", ".join([*fields, "n_lines long", "n_dropped long", "kept string"])
    return _by_broadcast(slim, index, least, out) if index.size <= BROADCAST_BYTES else _by_shard(slim, index, least, out)


def _by_broadcast(slim: DataFrame, index: Index, least: int, out: str) -> DataFrame:
    rows = {r.shard: (r.widths, r.words, r.fingerprints, r.counts) for r in index.arrays.collect()}
    shared, shards, least_chars, name = slim.sparkSession.sparkContext.broadcast(rows), index.shards, index.least_chars, getattr(index.arrays, "scratch", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = held(("line arrays", name), lambda: {k: Shard.read(*map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r)) for k, r in shared.value.items()})
        for batch, lines in _texts(batches, -1):
            row, place, hi, lo = _flat(lines, least_chars)
            n, home = np.zeros(len(hi), np.int64), _shard(hi, shards)
            for k in np.unique(home).tolist():
                if k in arrays:
                    n[home == k] = arrays[k].probe(hi[home == k], lo[home == k])
            begin = np.cumsum([0, *map(len, lines)])
            drop: dict[int, set[int]] = {}
            for r, p in zip(row[n >= least].tolist(), place[n >= least].tolist(), strict=True):
                drop.setdefault(r, set()).add(p - int(begin[r]))
            yield _answers(batch, lines, lambda i, drop=drop: drop.get(i, set()))

    return slim.mapInArrow(run, out)


def _by_shard(slim: DataFrame, index: Index, least: int, out: str) -> DataFrame:
    """Rows are numbered in a written table; each line's hash goes to a copy of its shard, as many copies as its occurrences need."""
    shards, least_chars = index.shards, index.least_chars
    numbered = written(slim.select(F.monotonically_increasing_id().alias("__row"), "*"), "numbered")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch, lines in _texts(batches, -1):
            row, place, hi, lo = _flat(lines, least_chars)
            ids, begin = batch.column(0).to_numpy(), np.cumsum([0, *map(len, lines)])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (_shard(hi, shards), ids[row], place - begin[row], hi.view(np.int64), lo.view(np.int64))], ["shard", "row", "line", "hi", "lo"])

    def probe(lines: pa.Table, arrays: pa.Table) -> pa.Table:
        a = arrays.to_pylist()
        hi, lo = (lines.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
        n = Shard.read(a[0]["widths"], a[0]["words"], a[0]["fingerprints"], a[0]["counts"]).probe(hi, lo) if a else np.zeros(len(hi), np.int64)
        return lines.select(["row", "line"]).filter(pa.array(n >= least))

    copies = index.arrays.select("shard", F.ceil(F.col("total") / PROBES).cast("long").alias("copies"))
    lines = numbered.select("__row", "__text").mapInArrow(hashed, "shard long, row long, line long, hi long, lo long")
    lines = lines.join(hinted(copies, shards), "shard").withColumn("copy", F.pmod(F.xxhash64("row"), F.col("copies"))).drop("copies")
    arrays = index.arrays.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("total") / PROBES).cast("long") - 1)))
    hits = lines.groupBy("shard", "copy").cogroup(arrays.groupBy("shard", "copy")).applyInArrow(probe, "row long, line long")
    drops = hits.groupBy("row").agg(F.collect_list("line").alias("__drop"))
    names = [c for c in numbered.columns if c not in ("__row", "__text")]
    joined = numbered.join(drops, F.col("__row") == F.col("row"), "left").select("__drop", *[F.col(f"`{c}`") for c in names], "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch, lines in _texts(batches, -1):
            drop = batch.column(0).to_pylist()
            yield _answers(pa.RecordBatch.from_arrays(batch.columns[1:], batch.schema.names[1:]), lines, lambda i, drop=drop: set(drop[i] or ()))

    return joined.mapInArrow(run, out)
