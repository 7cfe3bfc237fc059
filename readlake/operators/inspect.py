"""Statistics and comparison: histograms, line differences, distinct windows, key/value info, stream sizes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readlake.operators.ordered import running_sum

#: Bytes of a page, and page numbers that an index page holds.
PAGE, NODE_ENTRIES = 8192, 2047


def byte_histogram(df: DataFrame, text: str, order: str | None = None, first: int | None = None) -> DataFrame:
    """(byte, n): occurrences of each byte, as two hexadecimal digits; with `first` of that many bytes in the order of a column."""
    raw = df.select(F.encode(F.col(text), "UTF-8").alias("__raw")) if first is None else _first_bytes(df, text, order, first)
    b = F.explode(F.regexp_extract_all(F.hex("__raw"), F.lit(".."), F.lit(0))).alias("byte")
    return raw.select(b).groupBy("byte").agg(F.count("*").alias("n"))


def _first_bytes(df: DataFrame, text: str, order: str, first: int) -> DataFrame:
    d = df.select(order, F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("__raw"))
    d = running_sum(d, F.length("__raw").cast("long"), "__ahead", [order], inclusive=False).where(F.col("__ahead") < first)
    return d.select(F.substring("__raw", F.lit(1), F.least(F.length("__raw"), F.lit(first) - F.col("__ahead")).cast("int")).alias("__raw"))


def ranked_histogram(hist: DataFrame, value: str = "byte") -> DataFrame:
    """hist with nth (rarest first), total and distinct; as many rows as values."""
    whole = hist.agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))
    nth = F.row_number().over(Window.partitionBy("total").orderBy("n", value)).cast("long")
    return hist.join(F.broadcast(whole), F.lit(True)).withColumn("nth", nth)


def char_histogram(df: DataFrame, text: str) -> DataFrame:
    c = F.explode(F.split(F.col(text), "")).alias("char")
    return df.select(c).where("char <> ''").groupBy("char").agg(F.count("*").alias("n"))


def numbered_lines(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, ln, line) of texts, from 0."""
    return df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("ln", "line"))


def line_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lines, differing, first): numbered lines of both compared by place; first: the first place that differs."""
    a, b = left.withColumnRenamed("line", "__a"), right.withColumnRenamed("line", "__b")
    j = a.join(b, [*keys, "ln"], "full")
    odd = ~F.col("__a").eqNullSafe(F.col("__b"))
    return j.groupBy(*keys).agg(F.count("*").alias("lines"), F.count_if(odd).alias("differing"), F.min(F.when(odd, F.col("ln"))).cast("long").alias("first"))


def windows(df: DataFrame, seq: str, size: int) -> DataFrame:
    """(window): every stretch of `size` bytes of a sequence, so of characters where it is ASCII.

    Bytes are cut in constant time, characters would be counted from the start each time.
    """
    raw = F.col("__raw")
    places = F.when(F.length(raw) >= size, F.sequence(F.lit(1), F.length(raw) - size + 1)).otherwise(F.array().cast("array<int>"))
    return df.select(F.col(seq).cast("binary").alias("__raw")).select(F.explode(F.transform(places, lambda i: F.substring(raw, i, F.lit(size)))).alias("window"))


#: Bytes of the longest minimizer, bytes of sequences that are looked through at once, and of stretches compared at once.
MINIMIZER, SLICE, GROUP = 16, 1 << 20, 1 << 21
_COMPLEMENT = bytes.maketrans(b"ACGTacgt", b"TGCAtgca")


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits spread well; equal only where x is."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _hashes(raw: bytes, size: int) -> np.ndarray:
    """64 bits for the `size` bytes that begin at each place, equal where these are; by doubling, exact up to 8 bytes."""
    h, have = np.frombuffer(raw, np.uint8).astype(np.uint64), 1
    while 2 * have <= size:
        if have < 8:
            h = h[:-have] | h[have:] << np.uint64(8 * have)
        else:
            h = _mixed(h)
            h = h[:-have] * np.uint64(0x9E3779B97F4A7C15) + h[have:]
        have *= 2
    h = _mixed(h)
    if have < size:  # two that overlap
        h = _mixed(h[: len(raw) - size + 1] * np.uint64(0x9E3779B97F4A7C15) + h[size - have :])
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    n, out, have = len(h) - width + 1, h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out[:n]


def _turned(raw: bytes) -> bytes:
    """The reverse complement."""
    return raw.translate(_COMPLEMENT)[::-1]


def _inside(lengths: np.ndarray, size: int) -> np.ndarray:
    """Where windows begin that don't reach from one of the joined texts into the next."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    return np.flatnonzero(np.arange(len(ends)) + size <= ends)


def _stretches(batches: Iterator[pa.RecordBatch], size: int, m: int, canonical: bool) -> Iterator[pa.RecordBatch]:
    """(minimizer, stretch, n): neighbouring windows that share their least m-byte word, as one stretch; equal ones counted."""

    def of(seqs: list[bytes]) -> pa.RecordBatch:
        raw = b"".join(seqs)
        h = _hashes(raw, m)
        if canonical:
            h = np.minimum(h, _hashes(_turned(raw), m)[::-1])
        least, at = _least(h, size - m + 1), _inside(np.array([len(x) for x in seqs]), size)
        new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (least[at][1:] != least[at][:-1]))))
        begins, stops = at[new], at[np.append(new[1:], len(at)) - 1] + size
        found = Counter(zip(least[begins].view(np.int64).tolist(), (raw[a:z] for a, z in zip(begins.tolist(), stops.tolist(), strict=True)), strict=True))
        keys = list(found)
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int64()), pa.array([x for _, x in keys], pa.binary()), pa.array(list(found.values()), pa.int64())], ["minimizer", "stretch", "n"])

    for batch in batches:
        held, waiting = 0, []
        for x in batch.column(0):
            seq = x.as_py()
            if seq is None or len(seq) < size:
                continue
            waiting.append(seq)
            held += len(seq)
            if held >= SLICE:
                yield of(waiting)
                held, waiting = 0, []
        if waiting:
            yield of(waiting)


def _distinct(parts: list[bytes], lengths: list[np.ndarray], size: int, canonical: bool, of: int = 1, nth: int = 0) -> int:
    """How many different windows joined stretches have, of those whose hash leaves nth when divided by `of`.

    Windows are sorted by hash, and those of equal hash are compared byte by byte; should two differ, texts are counted.
    """
    wanted, hashes, places, base = [], [], [], 0
    for raw, long in zip(parts, lengths, strict=True):
        at = _inside(long, size)
        h, start = _hashes(raw, size)[at], at
        wanted.append(raw)
        if canonical:
            back, there = _turned(raw), len(raw) - size - at
            other = _hashes(back, size)[there]
            start, h = np.where(other < h, len(raw) + there, at), np.minimum(h, other)
            wanted.append(back)
        if of > 1:
            mine = h % np.uint64(of) == nth
            h, start = h[mine], start[mine]
        hashes.append(h)
        places.append(start + base)
        base += len(raw) * (2 if canonical else 1)
    whole = np.frombuffer(b"".join(wanted), np.uint8)
    h, at = np.concatenate(hashes), np.concatenate(places)
    order = np.argsort(h)
    h, at = h[order], at[order]
    again = np.flatnonzero(h[1:] == h[:-1])
    view = np.lib.stride_tricks.sliding_window_view(whole, size)
    if all((view[at[x]] == view[at[x + 1]]).all() for x in np.array_split(again, len(again) // (1 << 14) + 1)):
        return len(h) - len(again)
    texts = {view[i].tobytes() for i in at.tolist()}
    return len({min(x, _turned(x)) for x in texts} if canonical else texts)


def _counted(batches: Iterator[pa.RecordBatch], size: int, canonical: bool) -> Iterator[pa.RecordBatch]:
    """(windows, distinct) of stretches sorted by minimizer: whole minimizers are counted together, GROUP bytes or so at once.

    A minimizer of more than that is gone through several times, each time for a share of its windows.
    """
    done: list[tuple[bytes, np.ndarray, np.ndarray]] = []  # (joined stretches, lengths, n) of minimizers that are complete
    now: list[tuple[bytes, np.ndarray, np.ndarray]] = []  # of the one that may go on
    key = None

    def out(rows: list) -> pa.RecordBatch:
        parts, lengths, n = zip(*rows, strict=True)
        shares = max(1, sum(map(len, parts)) // (4 * GROUP))
        windows = sum(int(((long - size + 1) * k).sum()) for long, k in zip(lengths, n, strict=True))
        distinct = sum(_distinct(parts, lengths, size, canonical, shares, k) for k in range(shares))
        return pa.RecordBatch.from_arrays([pa.array([windows], pa.int64()), pa.array([distinct], pa.int64())], ["windows", "distinct"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, n, column = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(1).cast(pa.large_binary())
        offsets, raw = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1], memoryview(column.buffers()[2])
        piece = lambda a, z: (bytes(raw[offsets[a] : offsets[z]]), np.diff(offsets[a : z + 1]), n[a:z].copy())  # noqa: B023, E731
        last = int(np.count_nonzero(keys != keys[-1]))  # where the batch's last minimizer begins
        if keys[0] != key or last:
            done, now = done + now, []
        if last:
            done.append(piece(0, last))
        now.append(piece(last, len(keys)))
        key = keys[-1]
        if sum(len(x) for x, _, _ in done) >= GROUP:
            yield out(done)
            done = []
    if done or now:
        yield out(done + now)


def distinct_windows(df: DataFrame, seq: str, size: int, canonical: bool = False) -> DataFrame:
    """(windows, distinct_windows), exact; canonical: a window and its reverse complement are the same.

    Windows go to the task of their minimizer, the word with the least hash in them. Neighbours mostly share it, so they
    travel as one stretch and a base is shuffled a few times, not `size` times; equal windows have the same minimizer, so
    they meet. Equal stretches of a task travel once. A task sorts stretches, never windows: it counts those of a few
    minimizers at a time. Windows are of bytes, so of characters where a sequence is ASCII.
    Null sequences and those shorter than a window have none; an empty table has 0 of both.
    """
    m = max(1, min(MINIMIZER, size // 2))
    rows = df.select(F.col(seq).cast("binary").alias("seq")).mapInArrow(lambda it: _stretches(it, size, m, canonical), "minimizer long, stretch binary, n long").repartition("minimizer")
    one = rows.sortWithinPartitions("minimizer").mapInArrow(lambda it: _counted(it, size, canonical), "windows long, distinct long")
    return one.agg(F.coalesce(F.sum("windows"), F.lit(0)).alias("windows"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct_windows"))


#: Rows of a block of digests.
DIGEST_BLOCK = 1 << 12


def row_digest(order: str, columns: list[str]) -> Column:
    """A 64-bit hash of a row; nulls count, and differ from empty values."""
    return F.xxhash64(order, *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def digests(df: DataFrame, columns: list[str], keys: list[str], order: str = "rec", block: int = DIGEST_BLOCK) -> DataFrame:
    """(keys, block, n, hi, lo): a digest of the rows whose ordinals, from 0, are in a block.

    Digests are sums of the halves of the rows' 64-bit hashes: the same rows give the same digest in any order and layout,
    and the digests of blocks add up to those of keys and of the table. Nulls count, and differ from empty values. Rows of a
    null ordinal are in block null.
    """
    d = df.select(*keys, F.floor(F.col(order) / block).cast("long").alias("block"), row_digest(order, columns).alias("h"))
    return d.groupBy(*keys, "block").agg(F.count("*").alias("n"), F.sum(F.shiftrightunsigned("h", 32)).alias("hi"), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"))


def differing_blocks(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block) of digests that differ, or that only one side has; keys whose own digests agree are not gone into."""
    def both(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
        a, b = (x.select(*[F.col(k).alias(f"{s}_{k}") for k in by], F.struct("n", "hi", "lo").alias(f"{s}_sum")) for s, x in (("a", a), ("b", b)))
        on = F.lit(True)
        for k in by:
            on = on & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
        j = a.join(b, on, "full").where(~F.col("a_sum").eqNullSafe(F.col("b_sum")))
        return j.select(*[F.when(F.col("a_sum").isNotNull(), F.col(f"a_{k}")).otherwise(F.col(f"b_{k}")).alias(k) for k in by])

    if not keys:
        return both(left, right, ["block"])
    whole = lambda d: d.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "hi", "lo")])
    odd = both(whole(left), whole(right), keys)
    inside = lambda d: d.join(odd.select(*[F.col(k).alias(f"odd_{k}") for k in keys]), [F.col(k).eqNullSafe(F.col(f"odd_{k}")) for k in keys], "left_semi")
    return both(inside(left), inside(right), [*keys, "block"])


def differences(left: DataFrame, right: DataFrame, columns: list[str], keys: list[str], order: str = "rec", block: int = DIGEST_BLOCK, kept: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(keys, order, left_rows, right_rows, changed): ordinals whose rows differ, with how many rows each side has of it.

    changed: the columns whose values differ, where both sides have one row; null otherwise. Only blocks whose digests
    differ are read for this (kept: the digests of both, if they are stored); where all digests agree no row is compared.
    """
    a, b = kept or tuple(digests(d, columns, keys, order, block) for d in (left, right))
    odd = differing_blocks(a, b, keys).select(*[F.col(k).alias(f"odd_{k}") for k in keys], F.col("block").alias("odd_block"))
    at = F.floor(F.col(order) / block).cast("long")
    on = [F.col(k).eqNullSafe(F.col(f"odd_{k}")) for k in keys] + [at.eqNullSafe(F.col("odd_block"))]
    rows = [d.select(*keys, order, *columns).join(odd, on, "left_semi").withColumn("of", F.lit(s)) for s, d in (("a", left), ("b", right))]
    of = lambda s, x: F.max(F.when(F.col("of") == s, x))
    h = row_digest(order, columns)
    g = rows[0].unionByName(rows[1]).groupBy(*keys, order).agg(
        F.count_if(F.col("of") == "a").alias("left_rows"), F.count_if(F.col("of") == "b").alias("right_rows"),
        F.sum(F.when(F.col("of") == "a", h.cast("decimal(20,0)")).otherwise(-h.cast("decimal(20,0)"))).alias("__d"),
        *[of(s, F.struct(c)).alias(f"__{s}{i}") for i, c in enumerate(columns) for s in "ab"],
    )
    names = F.array(*[F.when(~F.col(f"__a{i}").eqNullSafe(F.col(f"__b{i}")), F.lit(c)) for i, c in enumerate(columns)])
    single = (F.col("left_rows") == 1) & (F.col("right_rows") == 1)
    return g.where((F.col("left_rows") != F.col("right_rows")) | (F.col("__d") != 0)).select(*keys, order, "left_rows", "right_rows", F.when(single, F.array_compact(names)).alias("changed"))


def first_wins(df: DataFrame, key: str, value: Column, order: str) -> DataFrame:
    """(key, value): a key keeps the value that was put first."""
    return df.groupBy(F.col(key).alias("key")).agg(F.min_by(value, order).alias("value"))


def stream_sizes(df: DataFrame, streams: dict, summed: bool = False) -> DataFrame:
    """(stream, n, bytes, pages, nodes, last): size of each column as a paged stream; streams without a byte are absent.

    pages hold data, nodes list them (none for a single page), last is what the last page holds. summed: df is one row, and
    a stream is its (bytes, n) instead of a column.
    """
    if summed:
        sums = df.select(*[x.cast("long").alias(f"{c}{i}") for i, pair in enumerate(streams.values()) for c, x in zip("bn", pair, strict=True)])
    else:
        sums = df.agg(*[x for i, c in enumerate(streams.values()) for x in (F.sum(F.octet_length(c)).cast("long").alias(f"b{i}"), F.count(c).alias(f"n{i}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("stream"), F.col(f"n{i}").alias("n"), F.coalesce(f"b{i}", F.lit(0)).cast("long").alias("bytes")) for i, name in enumerate(streams)])).alias("s")
    d = sums.select(rows).select("s.*").where("bytes > 0").withColumn("pages", F.ceil(F.col("bytes") / PAGE))
    nodes = F.when(F.col("pages") > 1, F.ceil((F.col("pages") - 1) / NODE_ENTRIES)).otherwise(0).cast("long")
    return d.withColumn("nodes", nodes).withColumn("last", F.col("bytes") - (F.col("pages") - 1) * PAGE)


def container_bytes(sizes: DataFrame) -> DataFrame:
    """(pages, bytes) of the container of these streams, with its two leading pages."""
    return sizes.agg((F.lit(2) + F.coalesce(F.sum(F.col("pages") + F.col("nodes")), F.lit(0))).cast("long").alias("pages")).withColumn("bytes", F.col("pages") * PAGE)


def file_sizes(paths_df: DataFrame) -> DataFrame:
    """(file, mb) of a binaryFile DataFrame, without reading contents."""
    return paths_df.select(F.col("path").alias("file"), F.round(F.col("length") / 1e6, 3).alias("mb"))
