"""Symbol models: static entropy, adaptive code length from counts, and the adaptive models with halving."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Adaptive:
    """Symbols start with `start` each and get `step` a hit; all of a context are halved when a hit symbol is over `limit`.

    Counts below `start` are no symbol's: of them only what is above `hidden` is halved. A symbol over the limit that leaves
    all others less than `saturated` together stays as it is.
    """

    symbols: int
    start: int
    step: int
    limit: int
    hidden: int = 0
    saturated: int = 0


# The models of bases, of qualities, and of bytes; limits are of the count that the symbol has before a hit.
BASE = Adaptive(4, 3, 1, 254)
QUALITY = Adaptive(64, 1, 6, 65467, 1, 20)
BYTE = Adaptive(256, 1, 14, 32723, 1, 256)


def static_entropy(df: DataFrame, keys: list[str], symbol: str, n: str) -> DataFrame:
    """keys, n, bits: total and entropy per symbol of counted symbols."""
    totals = df.groupBy(*keys).agg(F.sum(n).alias("__t"))
    p = F.col(n) / F.col("__t")
    return df.join(totals, keys).groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(-p * F.log2(p)).alias("bits"))


def _log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0, by its asymptotic series from x + 8 on."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    low, high = x * (x + 1) * (x + 2) * (x + 3), (x + 4) * (x + 5) * (x + 6) * (x + 7)
    return series - F.log(low) - F.log(high)


def _rising(n: Column, start: int, step: int) -> Column:
    """log2 of start, start + step, ... multiplied, n factors."""
    ratio = start / step
    return n * float(np.log2(step)) + (_log_gamma(n + ratio) - _log_gamma(F.lit(ratio))) / float(np.log(2))


def adaptive_cost(counts: DataFrame, model: Adaptive, ctx: list[str], n: str = "n") -> DataFrame:
    """(ctx, n, bits) of counted symbols: the code length of a context's symbols under the adaptive model that never halves.

    In whatever order they come the length is the same, so the counts tell it: no row of a symbol meets another.
    """
    d = counts.groupBy(*ctx).agg(F.sum(n).alias("n"), F.sum(_rising(F.col(n).cast("double"), model.start, model.step)).alias("__hits"))
    return d.select(*ctx, "n", (_rising(F.col("n").cast("double"), model.start * model.symbols, model.step) - F.col("__hits")).alias("bits"))


class Halving:
    """One context of an adaptive model with halving, fed with symbols in order."""

    def __init__(self, model: Adaptive):
        self.model = model
        self.counts = np.full(model.symbols, model.start, np.int64)

    def halve(self) -> None:
        c, hidden = self.counts, self.model.hidden
        # without hidden counts the low bit stays, so that no count falls to 0
        self.counts = (c - hidden) // 2 + hidden if hidden else ((c & ~1) >> 1) | (c & 1)

    def bits(self, symbols: np.ndarray) -> float:
        """Code length of the next symbols. Between two halvings counts grow evenly, so such stretches are summed at once."""
        m, out, at = self.model, 0.0, 0
        while at < len(symbols):
            # no more hits than bring all symbols to the limit fit in a stretch
            s = symbols[at : at + min(m.symbols * ((m.limit - m.start) // m.step + 2), 1 << 16)]
            order = np.argsort(s, kind="stable")
            sorted_ = s[order]
            first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
            rank = np.empty(len(s), np.int64)
            rank[order] = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
            before = self.counts[s] + m.step * rank
            over = np.flatnonzero(before > m.limit)
            end = int(over[0]) if len(over) else len(s)
            total = int(self.counts.sum())
            out += float(np.log2((total + m.step * np.arange(end)) / before[:end]).sum())
            self.counts += m.step * np.bincount(s[:end], minlength=m.symbols)
            at += end
            if end < len(s):
                hit, total = int(s[end]), int(self.counts.sum())
                if m.saturated and self.counts[hit] - m.hidden + m.saturated > total - m.hidden * m.symbols:
                    rest = symbols[at:]
                    run = int(np.argmax(rest != hit)) if (rest != hit).any() else len(rest)
                    out += run * float(np.log2(total / self.counts[hit]))
                    at += run
                else:
                    out += float(np.log2(total / self.counts[hit]))
                    self.halve()
                    self.counts[hit] += m.step
                    at += 1
        return out


def halved_cost(df: DataFrame, model: Adaptive, order: list[str], ctx: str, symbols: str) -> DataFrame:
    """(ctx, n, bits): cost of each context's symbols, in order, under the model that halves.

    symbols: an array of symbol numbers for each row, rows ordered by `order`. Contexts are independent; each is a running
    state that meets its rows one batch after another. What is sorted for that are compressed bytes, one a symbol before
    compression, so a context's task sorts a small part of what its arrays would take. A null array is an empty one.
    """
    if model.symbols > 256:
        raise ValueError(f"{model.symbols} symbols, more than a byte has")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, counts = lists.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            if len(flat) and not (flat.min() >= 0 and flat.max() < model.symbols):
                raise ValueError(f"a symbol is not one of 0 to {model.symbols - 1}")
            raw, ends = flat.astype(np.uint8).tobytes(), np.cumsum(counts, dtype=np.int64).tolist()
            blobs = [zlib.compress(raw[a:z], 1) for a, z in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), *batch.columns[2:]], batch.schema.names)

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n, bits, any_row = None, None, 0, 0.0, False

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([n], pa.int64()), pa.array([bits])], ["ctx", "n", "bits"])

        for batch in batches:
            names, blobs = batch.column(0).to_pylist(), batch.column(1)
            for k, name in enumerate(names):
                if not any_row or name != now:
                    if any_row:
                        yield out()
                    now, state, n, bits, any_row = name, Halving(model), 0, 0.0, True
                s = np.frombuffer(zlib.decompress(blobs[k].as_py()), np.uint8).astype(np.int64)
                n += len(s)
                bits += state.bits(s)
        if any_row:
            yield out()

    d = df.select(F.col(ctx).cast("string").alias("ctx"), F.col(symbols).cast("array<int>").alias("symbols"), *order)
    kinds = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in order)
    d = d.mapInArrow(packed, f"ctx string, symbols binary, {kinds}")
    return d.repartition("ctx").sortWithinPartitions("ctx", *order).select("ctx", "symbols").mapInArrow(cost, "ctx string, n long, bits double")


def packed_bits(df: DataFrame, flag: Column, order: str) -> DataFrame:
    """(byte, value): eight flags to a byte, the first in bit 0; order counts from 0."""
    bit = F.when(flag, F.expr(f"shiftleft(1, cast({order} % 8 as int))")).otherwise(0)
    return df.groupBy(F.floor(F.col(order) / 8).cast("long").alias("byte")).agg(F.sum(bit).cast("long").alias("value"))
