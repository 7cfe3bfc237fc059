"""Typed forms of headers and sequences, record by record: what a columnar file can store well, and the way back.

All are columns, so a query that doesn't read one doesn't decode it. The work is done by arrays over the characters of many
records at once (Arrow functions): an expression for each character or token would cost tens of microseconds a record.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of a header that may be stored as numbers; bases in a chunk that is filled up with 0, and a chunk's bytes.
SLOTS, CHUNK, CHUNK_BYTES = 12, 28, 7
#: A sequence is packed if it is at least so long and has under one stretch of other characters in so many.
LEAST, STRETCH = 16, 32
#: Bytes of records that are worked on at once; a longer record is alone.
SLICE = 1 << 20

_CODE, _ODD, _TOKEN, _DIGIT = np.zeros(256, np.uint8), np.ones(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_CODE[list(b"ACGT")], _ODD[list(b"ACGT")] = range(4), False
_TOKEN[[i for i in range(128) if chr(i).isalnum()]], _DIGIT[list(b"0123456789")] = True, True
#: The four bases of a byte.
_BASES = np.frombuffer(b"ACGT", np.uint8)[np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3]


# ---- arrays of texts -------------------------------------------------------------------------------------------------
def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of texts, and where each begins and the last one ends; nulls are empty."""
    a = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, ends, data = a.buffers()
    at = np.frombuffer(ends, np.int64, len(a) + 1, 8 * a.offset)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _texts(raw: np.ndarray, sizes: np.ndarray, null: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Texts of some sizes from all their bytes; a null's size is 0."""
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    valid = pa.py_buffer(np.packbits(~null, bitorder="little")) if null.any() else None
    return pa.Array.from_buffers(kind, len(sizes), [valid, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))])


def _lists(values: pa.Array, counts: np.ndarray, null: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(null) if null.any() else None)


def _numbers(a: pa.Array) -> np.ndarray:
    return pc.fill_null(a, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _null(a: pa.Array) -> np.ndarray:
    return a.is_null().to_numpy(zero_copy_only=False)


def _first_of(sizes: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Of room[i] places for each i, one after the other: whether a place is one of the first sizes[i]."""
    begins, some = np.cumsum(room) - room, sizes > 0
    edges = np.zeros(int(room.sum()) + 1, np.int8)
    edges[begins[some]] += 1
    edges[(begins + sizes)[some]] -= 1
    return np.cumsum(edges[:-1], dtype=np.int8).view(bool)


def _over(f: Callable[[pa.Array], pa.Array], a: pa.Array) -> pa.Array:
    """f of an array, in slices of about SLICE bytes."""
    if len(a) < 2 or a.nbytes <= SLICE:
        return f(a)
    half = len(a) // 2
    return pa.concat_arrays([_over(f, a.slice(0, half)), _over(f, a.slice(half))])


def _of_column(f: Callable[[pa.Array], pa.Array], kind: str) -> Callable[[Column], Column]:
    """f, of arrays, as a function of a column."""

    def run(a: pa.Array) -> pa.Array:
        return _over(f, a)

    return lambda c: F.arrow_udf(run, kind)(c)


# ---- sequences -------------------------------------------------------------------------------------------------------
def packable(seq: Column) -> Column:
    """Whether a sequence is smaller packed: printable ASCII, of some length, with few stretches and few of other characters."""
    n, stretches, bases = F.length(seq), F.size(F.regexp_extract_all(seq, F.lit("([^ACGT]+)"), F.lit(1))), F.length(F.regexp_replace(seq, "[^ACGT]", ""))
    few = seq.rlike("^[!-~]+$") & (stretches * STRETCH <= n) & (bases * 4 >= n * 3)
    return F.coalesce((n >= LEAST) & (seq.rlike("^[ACGT]+$") | few), F.lit(False))


def _pack(seqs: pa.Array) -> pa.Array:
    raw, at = _flat(seqs)
    n, null, odd = np.diff(at), _null(seqs), _ODD[raw]
    room = -(-n // CHUNK) * CHUNK
    digits = np.zeros(int(room.sum()), np.uint8)
    digits[_first_of(n, room)] = _CODE[raw]
    d = digits.reshape(-1, 4)
    packed = d[:, 0] << 6 | d[:, 1] << 4 | d[:, 2] << 2 | d[:, 3]
    edge = np.zeros(len(raw) + 1, bool)  # where a record begins, or the last one ends
    edge[at] = True
    begins = np.flatnonzero(odd & (edge[:-1] | ~np.concatenate(([False], odd))[:-1]))
    ends = np.flatnonzero(odd & (edge[1:] | ~np.concatenate((odd, [False]))[1:])) + 1
    of = np.searchsorted(at, begins, "right") - 1
    runs = pa.StructArray.from_arrays([pa.array((begins - at[of]).astype(np.int32)), _texts(raw[odd], ends - begins, np.zeros(len(begins), bool), pa.string())], ["at", "run"])
    counts = np.bincount(of, minlength=len(n))
    return pa.StructArray.from_arrays([_texts(packed, room // 4, null, pa.binary()), pa.array(n.astype(np.int32), mask=null), _lists(runs, counts, counts == 0)], ["bases", "n", "odd"])


def _unpack(kept: pa.Array) -> pa.Array:
    bases, n, odd = kept.flatten()
    raw, at = _flat(bases)
    room = 4 * np.diff(at)
    size = np.minimum(_numbers(n), room)
    text = _BASES[raw].reshape(-1)[_first_of(size, room)]
    places, runs = odd.flatten().flatten()
    if len(places):
        put, begins = _flat(runs)
        of = np.repeat(np.arange(len(size)), _numbers(pc.list_value_length(odd)))
        spots = (np.cumsum(size) - size)[of] + _numbers(places) - begins[:-1]
        text[np.repeat(spots, np.diff(begins)) + np.arange(len(put))] = put
    return _texts(text, size, _null(bases), pa.string())


_packed = _of_column(_pack, "bases binary, n int, odd array<struct<at int, run string>>")
_unpacked = _of_column(_unpack, "string")


def packed_sequence(seq: Column) -> Column:
    """Of any printable ASCII sequence: (bases, n, odd): four bases a byte in chunks of seven bytes, the last one filled up
    with 0; other characters stand as A in bases; odd: [(at, run)], their stretches and where they begin, from 0, or null."""
    return _packed(seq)


def sequence_of(bases: Column, n: Column, odd: Column) -> Column:
    """The inverse; null where bases are."""
    return _unpacked(F.struct(bases.alias("bases"), n.alias("n"), odd.alias("odd")))


# ---- headers ---------------------------------------------------------------------------------------------------------
def typable(header: Column) -> Column:
    """Whether a header's tokens can be stored apart: printable ASCII."""
    return F.coalesce(header.rlike("^[ -~]*$"), F.lit(False))


def _split(headers: pa.Array) -> pa.Array:
    raw, at = _flat(headers)
    null, inside = _null(headers), _TOKEN[raw]
    before = np.concatenate(([0], np.cumsum(~inside)))  # delimiters before a place
    marks = np.diff(before[at])
    counts = marks + 1
    first = np.cumsum(counts) - counts
    ends = np.empty(int(counts.sum()), np.int64)
    last = np.zeros(len(ends), bool)
    last[first + marks] = True
    ends[last], ends[~last] = at[1:], np.flatnonzero(~inside)
    begins = np.concatenate(([0], ends[:-1] + 1))
    begins[first] = at[:-1]
    size, nth = ends - begins, np.arange(len(ends)) - np.repeat(first, counts)
    strange = np.concatenate(([0], np.cumsum(~_DIGIT[raw])))
    number = (nth < SLOTS) & (size > 0) & (size < 19) & (strange[ends] == strange[begins])
    number[number] = (raw[begins[number]] != ord("0")) | (size[number] == 1)
    letters, numeric = raw[inside], np.repeat(number, size)
    values = np.zeros(len(ends), np.int64)
    values[number] = _texts(letters[numeric], size[number], np.zeros(int(number.sum()), bool), pa.string()).cast(pa.int64()).to_numpy()
    words = _texts(letters[~numeric], np.where(number, 0, size), number, pa.string())
    split = pa.StructArray.from_arrays([_lists(words, counts, null), _lists(pa.array(values, mask=~number), counts, null)], ["words", "numbers"])
    return pa.StructArray.from_arrays([_texts(raw[~inside], marks, null, pa.string()), split], ["marks", "split"])


def _join(kept: pa.Array) -> pa.Array:
    marks, words, *slots = kept.flatten()
    delimiters, at = _flat(marks)
    counts = _numbers(pc.list_value_length(words))
    words = words.flatten()
    row = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    number = _null(words) & (nth < SLOTS)
    spots = nth[number] * len(counts) + row[number]
    values = pa.concat_arrays(slots).take(pa.array(spots)).cast(pa.string())
    letters, begins = _flat(words)
    digits, starts = _flat(values)
    size = np.diff(begins)
    size[number] = np.diff(starts)
    marked = nth < np.diff(at)[row]
    ends = np.cumsum(size + marked)
    out, mark = np.empty(len(letters) + len(digits) + int(marked.sum()), np.uint8), np.zeros(len(letters) + len(digits) + int(marked.sum()), bool)
    mark[ends[marked] - 1] = True
    tokens, numeric = np.empty(len(letters) + len(digits), np.uint8), np.repeat(number, size)
    tokens[numeric], tokens[~numeric] = digits, letters
    out[mark], out[~mark] = delimiters, tokens
    null = _null(marks)
    return _texts(out, np.bincount(row, size + marked, len(counts)).astype(np.int64), null, pa.string())


_typed = _of_column(_split, "marks string, split struct<words array<string>, numbers array<bigint>>")
_header = _of_column(_join, "string")


def typed_header(header: Column) -> Column:
    """(marks, (words, numbers)) of a printable ASCII header: its delimiters, the tokens that aren't plain numbers in place,
    and the numbers by slot. In a file each slot is a column, so the file stores differences and knows ranges."""
    return _typed(header)


def header_of(columns: dict[str, Column]) -> Column:
    """The inverse, from columns marks, words and n0, n1, ...; null where marks are."""
    return _header(F.struct(*[columns[c].alias(c) for c in ("marks", "words", *[f"n{i}" for i in range(SLOTS)])]))
