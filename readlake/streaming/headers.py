"""The header column of a stream: what `operators.headers.encoded` keeps, record by record, and headers from that again.

A file's records come in any number of micro-batches. What the next record is compared with is state: the record before,
and of every slot the last number and whether digits are hexadecimal. Blocks of records are independent, so the state's key
is (file, block): a large file is the work of many tasks, a task sorts one block's records at most, and a block's state is
given up with its last record. What remains is one header's tokens for each file whose last block isn't full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from readlake.functions.columns import header_signature, header_tokens
from readlake.operators.headers import WORD, own_kind
from readlake.operators.ordered import BLOCK

#: The record before (its number, its marks or null if it had no header), and its tokens, last numbers and modes by slot.
STATE = "last long, marks string, tokens array<string>, numbers array<long>, hexed array<boolean>"
ENTRY = ["kind", "zero", "caps", "less", "delta", "text"]
#: What a stream of headers keeps.
KEPT = "file string, rec long, header string, changed array<long>, entries array<struct<kind: string, zero: boolean, caps: boolean, less: boolean, delta: bigint, text: string>>"
ENTRIES = "kind array<string>, zero array<boolean>, caps array<boolean>, less array<boolean>, delta array<long>, text array<string>"


def _value(token: str, kind: str) -> int:
    return 0 if kind == "str" else int(token, 16 if kind == "hex" else 10)


class Slots:
    """What is known of each slot of the records so far."""

    def __init__(self, kept: tuple | None):
        self.last, self.marks, tokens, numbers, hexed = kept or (-1, None, None, None, None)
        self.tokens, self.numbers, self.hexed = list(tokens or []), list(numbers or []), list(hexed or [])

    @property
    def kept(self) -> tuple:
        return (self.last, self.marks, self.tokens, self.numbers, self.hexed)

    def follow(self, rec: int) -> None:
        if rec <= self.last:
            raise ValueError(f"record {rec} comes after record {self.last} of its file")
        self.last = rec

    def whole(self, marks: str, tokens: list[str], own: list[str]) -> None:
        """A header that is kept: every slot starts anew."""
        self.marks, self.tokens = marks, list(tokens)
        self.numbers, self.hexed = [_value(t, k) for t, k in zip(tokens, own, strict=True)], [k == "hex" for k in own]

    def changes(self, tokens: list[str], own: list[str]) -> tuple[list[int], list[tuple]]:
        """The slots that differ from the record before, and what is told of them."""
        slots, entries = [], []
        for i, (token, kind) in enumerate(zip(tokens, own, strict=True)):
            if kind == "dec" and self.hexed[i] and len(token) <= 15:
                kind = "hex"
            number, cached = _value(token, kind), self.numbers[i]
            if token != self.tokens[i]:
                caps = any("A" <= c <= "F" for c in token)
                text = kind == "str"
                slots.append(i)
                entries.append((kind, not text and len(token) > 1 and token[0] == "0", caps, None if text else number < cached, None if text else abs(number - cached), token if text else None))
            self.numbers[i], self.hexed[i], self.tokens[i] = number, kind == "hex" or (kind == "dec" and self.hexed[i]), token
        return slots, entries

    def given(self, slots: list[int], entries: Iterator[tuple]) -> None:
        """The inverse of `changes`."""
        for i, (kind, zero, caps, less, delta, text) in zip(slots, entries, strict=True):
            if kind == "str":
                self.tokens[i], self.numbers[i] = text, 0
                continue
            self.numbers[i] += -int(delta) if less else int(delta)
            digits = str(self.numbers[i]) if kind == "dec" else f"{self.numbers[i]:{'X' if caps else 'x'}}"
            self.tokens[i] = "0" * bool(zero) + digits

    def text(self) -> str:
        return "".join(t + m for t, m in zip(self.tokens, [*self.marks, ""], strict=True))


def _words(slots: list[int], size: int) -> list[int]:
    words = [0] * -(-size // WORD)
    for i in slots:
        words[i // WORD] |= 1 << i % WORD
    return words


def _encode(slots: Slots, marks: str | None, tokens: list[str] | None, own: list[str] | None, header: str | None) -> list:
    if marks is None:
        slots.marks = None
        return [None] * 8
    if slots.marks != marks:
        slots.whole(marks, tokens, own)
        return [header, *[None] * 7]
    changed, entries = slots.changes(tokens, own)
    return [None, _words(changed, len(tokens)), *([list(x) for x in zip(*entries, strict=True)] or [[] for _ in ENTRY])]


def _rebuild(slots: Slots, marks: str | None, tokens: list[str] | None, own: list[str] | None, header: str | None, changed: list[int] | None, entries: list | None) -> list:
    if marks is not None:
        slots.whole(marks, tokens, own)
        return [header]
    if changed is None:
        return [None]
    at = [WORD * w + i for w, bits in enumerate(changed) for i in range(WORD) if bits >> i & 1]
    slots.given(at, (tuple(e[name] for name in ENTRY) for e in entries))
    return [slots.text()]


def _carried(df: DataFrame, columns: list[str], step: Callable[..., list], out: str, file: str, order: str, block: int) -> DataFrame:
    """(file, order, out): step on every record of a block in order, whatever micro-batches its records come in."""
    names = [c.split()[0] for c in out.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("rec")
        slots = Slots(state.get if state.exists else None)
        got: list[list[Any]] = []
        for rec, *values in zip(rows["rec"].tolist(), *(rows[c].tolist() for c in columns), strict=True):
            slots.follow(rec)
            got.append(step(slots, *(None if v is None or isinstance(v, float) else v for v in values)))
        if slots.last % block == block - 1:
            state.remove()
        else:
            state.update(slots.kept)
        columns_out = {n: pd.Series([g[i] for g in got], dtype=object) for i, n in enumerate(names)}
        yield pd.DataFrame({"file": pd.Series([key[0]] * len(got), dtype=object), "rec": rows["rec"].to_numpy(), **columns_out})

    header = F.col("header")
    tokens = header_tokens(header)
    d = df.select(F.col(file).cast("string").alias("file"), F.coalesce(F.col(order).cast("long"), F.raise_error(F.lit("a record has no number")).cast("long")).alias("rec"), *[c for c in df.columns if c in ("header", "changed", "entries")])
    d = d.select("*", header_signature(header).alias("marks"), tokens.alias("tokens"), F.transform(tokens, own_kind).alias("own"))
    keyed = d.withColumn("block", F.floor(F.col("rec") / block).cast("long")).groupBy("file", "block")
    return keyed.applyInPandasWithState(run, f"file string, rec long, {out}", STATE, "append", GroupStateTimeout.NoTimeout)


def stream_encoded(records: DataFrame, header: str = "header", file: str = "file", order: str = "rec", block: int = BLOCK) -> DataFrame:
    """(file, rec, header, changed, entries) of a streaming DataFrame, per file as `headers.encoded` has them for a table.

    The records of a file must come in rising order from batch to batch, each number once, as the stream source `fastq`
    gives them; inside a batch any order will do. A number that comes again or too late, or is null, stops the query. A
    null header has nothing; a null file is a file. Other columns are not read. The result doesn't depend on how the
    stream is cut into batches.
    """
    slim = records.select(F.col(file).alias("file"), F.col(order).alias("rec"), F.col(header).alias("header"))
    out = _carried(slim, ["marks", "tokens", "own", "header"], _encode, f"header string, changed array<long>, {ENTRIES}", "file", "rec", block)
    return out.select("file", "rec", "header", "changed", F.arrays_zip(*ENTRY).alias("entries"))


def stream_rebuilt(kept: DataFrame, file: str = "file", order: str = "rec", block: int = BLOCK) -> DataFrame:
    """(file, rec, header) from a stream of what `stream_encoded` (or `headers.encoded`, with a file) keeps."""
    # pandas would make numbers beside nulls floats, so distances travel as text
    entries = F.transform("entries", lambda e: e.withField("delta", e["delta"].cast("string")))
    slim = kept.select(F.col(file).alias("file"), F.col(order).alias("rec"), "header", "changed", entries.alias("entries"))
    return _carried(slim, ["marks", "tokens", "own", "header", "changed", "entries"], _rebuild, "header string", "file", "rec", block)
