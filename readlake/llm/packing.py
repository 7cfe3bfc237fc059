"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of token ids with a target share. A round is a window: it serves every queue its quota, what the
queue's share of all windows so far comes to, in whole tokens, less what it was served. So every window holds the target
proportions to within three tokens a source, and the fraction that a window can't give is the deficit carried into the next.
Quotas follow in closed form from the shares, so any window can be laid out alone, in any task: no deficit is waited for.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readlake.llm import tokens
from readlake.llm.common import hinted, written

LENGTH = 4096
#: Share of the tokenizer's entries that a worker keeps, sources that targets may name, and the units of a given share.
ROOM, MOST_TARGETS, UNITS = 0.4, 1_000, 1 << 40


class Phase:
    """Windows in which the same queues are served in the same proportions.

    The queues are the leaves of a tree. Of so many tokens of a node, its left side gets its share, rounded, and its right
    side the rest. So the tokens of all queues add up, no queue ever has less after more windows, and the roundings that
    part a queue from its exact share are halves of tokens that shrink by its side's share from level to level.
    """

    def __init__(self, first: int, windows: int, queues: list[int], parts: list[int]):
        self.first, self.windows, self.queues, self.parts, self.all = first, windows, queues, parts, sum(parts)
        #: of each queue: (share of the left side, of the node, whether the queue is on the right) from the root on
        self.paths: list[list[tuple[int, int, bool]]] = [[] for _ in queues]
        order = sorted((k for k, n in enumerate(parts) if n), key=lambda k: -parts[k])
        nodes = [(order, self.all)]
        while nodes:
            side, total = nodes.pop()
            if len(side) < 2:
                continue
            left, at = 0, 0
            while at < len(side) - 1 and (at == 0 or 2 * left + parts[side[at]] <= total):
                left, at = left + parts[side[at]], at + 1
            for i, k in enumerate(side):
                self.paths[k].append((left, total, i >= at))
            nodes += [(side[:at], left), (side[at:], total - left)]

    def served(self, k: int, windows: int, length: int) -> int:
        """Tokens of a queue in so many windows."""
        n = windows * length if self.parts[k] else 0
        for left, total, right in self.paths[k]:
            share = (2 * n * left + total) // (2 * total)
            n = n - share if right else share
        return n

    def quota(self, k: int, window: int, length: int) -> tuple[int, int, int]:
        """(tokens before a window, tokens before the next, where its tokens begin in the window) of a queue."""
        n, after, ahead = window * length, (window + 1) * length, 0
        for left, total, right in self.paths[k]:
            share, share_after = (2 * n * left + total) // (2 * total), (2 * after * left + total) // (2 * total)
            if right:
                n, after, ahead = n - share, after - share_after, ahead + share_after - share
            else:
                n, after = share, share_after
        return n, after, ahead

    def window_of(self, k: int, token: int, length: int) -> tuple[int, int, int, int]:
        """The window that serves a queue its token of this number, and the queue's quota in it."""
        share, off = self.parts[k] * length, len(self.paths[k]) + 1  # a rounding a level
        j = min(self.windows - 1, token * self.all // share)
        before, after, ahead = self.quota(k, j, length)
        if not before <= token < after:
            low, high = max(0, (token - off) * self.all // share - 1), min(self.windows - 1, (token + off) * self.all // share + 1)
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if self.served(k, mid + 1, length) > token else (mid + 1, high)
            j, (before, after, ahead) = low, self.quota(k, low, length)
        return j, before, after, ahead


def _quotas(room: int, queues: list[int], shares: list[int], left: list[int]) -> list[int]:
    """Whole tokens of one window of queues that may run dry in it: what one can't give, the others do in proportion."""
    given = dict.fromkeys(queues, 0)
    live = [(q, s) for q, s in zip(queues, shares, strict=True) if left[q] and s]
    while room and live:
        upto, want = 0, {}
        for q, s in live:
            want[q] = room * (upto + s) // sum(x for _, x in live) - room * upto // sum(x for _, x in live)
            upto += s
        for q, n in want.items():
            n = min(n, left[q] - given[q])
            given[q] += n
            room -= n
        live = [(q, s) for q, s in live if given[q] < left[q]]
    return [given[q] for q in queues]


class Schedule:
    """Where the tokens of each queue go. totals: tokens of each queue; shares: their targets, by default their totals.

    A queue that has run dry leaves its share to the others. Queues of share 0 are served after all others, in natural
    proportions. By default there is one phase, two numbers a queue; targets make at most two phases for each queue they name.
    """

    def __init__(self, totals: np.ndarray, shares: np.ndarray | None = None, length: int = LENGTH):
        left = [int(n) for n in totals]
        self.length, self.total, self.phases = length, sum(left), []
        #: of each queue: (tokens served before, phase, place in the phase)
        self.of: list[list[tuple[int, int, int]]] = [[] for _ in left]
        done, full, window = [0] * len(left), self.total // length, 0
        if shares is None:
            units = left[:]
        else:
            most = max(1e-300, max(map(float, shares), default=0))
            units = [max(1, round(float(s) / most * UNITS)) if s > 0 else 0 for s in shares]

        def add(windows: int, queues: list[int], parts: list[int]) -> None:
            nonlocal window
            phase = Phase(window, windows, queues, parts)
            for k, q in enumerate(queues):
                n = phase.served(k, windows, length)
                if n:
                    self.of[q].append((done[q], len(self.phases), k))
                    done[q], left[q] = done[q] + n, left[q] - n
            self.phases.append(phase)
            window += windows

        while window < full:
            queues = [q for q, n in enumerate(left) if n and units[q]]
            if not queues:  # the rest, in natural proportions
                units = left[:]
                continue
            phase = Phase(0, full, queues, [units[q] for q in queues])
            lasts = lambda n, phase=phase, queues=queues: all(phase.served(k, n, length) <= left[q] for k, q in enumerate(queues))
            low, high = 0, full - window
            if lasts(high - 1):  # most often none runs dry before the last window
                low, high = (high, high) if lasts(high) else (high - 1, high - 1)
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if lasts(mid) else (low, mid - 1)
            if low:
                add(low, queues, [units[q] for q in queues])
            if window < full:  # a window in which one does
                everyone = [q for q, n in enumerate(left) if n]
                named = _quotas(length, everyone, [units[q] for q in everyone], left)
                spare = [left[q] - n if not units[q] else 0 for q, n in zip(everyone, named, strict=True)]
                rest = _quotas(length - sum(named), everyone, spare, left)
                add(1, everyone, [a + b for a, b in zip(named, rest, strict=True)])
        self.done, at = done, full * length
        self.tails = []
        for n in left:  # what is less than a window follows at the very end
            self.tails.append(at)
            at += n

    def stretches(self, queue: int, start: int, count: int) -> Iterator[tuple[int, int]]:
        """(place, tokens) of `count` tokens of a queue from its token `start`, window by window."""
        of, length = self.of[queue], self.length
        while count:
            if start >= self.done[queue]:
                yield self.tails[queue] + start - self.done[queue], count
                return
            base, number, k = of[bisect_right(of, start, key=lambda x: x[0]) - 1]
            j, before, after, ahead = self.phases[number].window_of(k, start - base, length)
            take = min(count, base + after - start)
            yield (self.phases[number].first + j) * length + ahead + start - base - before, take
            start, count = start + take, count - take

    def sequence(self, place: int) -> tuple[int, int, int]:
        """(id, first place, size) of the sequence at a place; the rest after the last full one is cut at powers of two."""
        full = self.total // self.length
        if place < full * self.length:
            return place // self.length, place // self.length * self.length, self.length
        at, left, k = full * self.length, self.total % self.length, full
        while True:
            size = 1 << (left.bit_length() - 1)
            if place < at + size:
                return k, at, size
            at, left, k = at + size, left - size, k + 1

    def pieces(self, queue: int, start: int, count: int) -> Iterator[tuple[int, int, int, int]]:
        """(tokens before the piece, length, sequence, offset) of `count` tokens from `start` of the queue, in order."""
        done, held = 0, None
        for place, left in self.stretches(queue, start, count):
            while left:
                seq, first, size = self.sequence(place)
                take = min(left, first + size - place)
                if held and held[2] == seq and held[3] + held[1] == place - first:
                    held = (held[0], held[1] + take, seq, held[3])
                else:
                    if held:
                        yield held
                    held = (done, take, seq, place - first)
                done, place, left = done + take, place + take, left - take
        if held:
            yield held


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Ids of every document, its task, and the tokens of its source that the task has seen before it."""
    from pyspark import TaskContext

    enc, end, part = tokens.encoder(tokenizer, ROOM), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
    seen: dict[str | None, int] = {}
    for batch in batches:
        for start, stop, ids in enc.encoded(batch.column(1), end):
            sizes = pc.divide(pc.cast(pc.binary_length(ids), pa.int64()), 4)
            docs, sources = batch.column(0).slice(start, stop - start), batch.column(2).slice(start, stop - start)
            before = []
            for source, n in zip(sources.to_pylist(), sizes.to_pylist(), strict=True):
                before.append(seen.get(source, 0))
                seen[source] = before[-1] + n
            yield pa.RecordBatch.from_arrays([docs, sources, pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()), sizes, ids], ["doc_id", "source", "part", "before", "n", "ids"])


def _cut(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    plan = Schedule(*shared.value)
    for batch in batches:
        out: list[tuple] = []
        for k, (doc, queue, start) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            ids = memoryview(batch.column(3)[k].as_buffer())
            n = len(ids) // 4
            for at, size, seq, offset in plan.pieces(queue, start, n):
                out.append((doc, at, size, tokens.crc32(ids[4 * at : 4 * (at + size)]), n, seq, offset))
            if len(out) > 50_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: dict[str | None, float] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    targets: shares of the sources in every window, whatever they add up to; by default the sources' shares of all tokens,
    so that every queue lasts to the last window. A source that has run dry leaves its share to the others in proportion;
    sources that targets leave out follow at the end. targets may name MOST_TARGETS sources. Every source has a queue. Null and empty texts hold the end id
    alone; null sources are a queue of their own; null ids and repeated rows are packed like any other; other columns are
    not read. An empty table has no sequences. Sequences of a table depend on the order in which its files are read; every
    id lies in one piece whatever that is. Nothing is left over or padded.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
    schema = "doc_id long, source string, part int, before long, n long, ids binary"
    encoded = written(slim.mapInArrow(lambda it: _encode(it, tokenizer, end_id), schema), "ids")
    by_task = written(encoded.groupBy("source", "part").agg(F.sum("n").alias("n")), "totals")
    # two numbers for each source
    sums = by_task.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("source").asc_nulls_first()).toArrow()
    sources, totals = sums.column("source").to_pylist(), sums.column("n").to_numpy().astype(np.int64)
    shares = None if targets is None else np.array([float(targets.get(s, 0)) for s in sources])
    if shares is not None and (shares < 0).any():
        raise ValueError("a target share is negative")
    if targets is not None and len(targets) > MOST_TARGETS:
        raise ValueError(f"targets name more than {MOST_TARGETS} sources")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((totals, shares))
    queues = spark.createDataFrame(list(zip(sources, range(len(sources)), strict=True)), "of string, queue int")
    named = by_task.join(hinted(queues, len(sources)), F.col("source").eqNullSafe(F.col("of"))).select("source", "part", "n", "queue")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = named.select(F.col("source").alias("of"), F.col("part").alias("of_part"), "queue", before.alias("base"))
    dealt = encoded.join(hinted(placed, by_task.count()), F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    return dealt.select("doc_id", "queue", (F.col("base") + F.col("before")).alias("start"), "ids").mapInArrow(lambda it: _cut(it, shared), PIECES)
