"""FASTQ as Spark data sources: files are cut at any byte, and each task assembles whole records of its own range.

A record belongs to the range that holds the first byte of its header line; its task reads on past the end of the range.
Two passes make that exact for any content. `fastq_ranges` counts the line feeds of every range, so the number of the first
line of each range is known, and with it where the next record begins and what its number is; `fastq` then reads records.
Nothing is shuffled. As a stream, `fastq` follows files that grow: a batch ends with the last record that is complete.

Plain files are cut at bytes, block-compressed gzip files at their blocks; other compressed files are one range each.
"""

from __future__ import annotations

import fnmatch
import io
import json
import posixpath
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RECORDS = "file string, rec long, at long, header string, seq string, plus string, qual string, problem string"
COUNTS = "nth long, bytes long, lines long, ended boolean"
#: Bytes of a range, of a read, and of the first read past a range's end or back from a file's end.
SPLIT, READ, TAIL = 64 << 20, 4 << 20, 1 << 16
CODECS = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd", ".lz4": "lz4"}
# Fixed values of the block-compressed gzip format: how a block's header begins, and where its subfield and size are.
BLOCK_MAGIC, BLOCK_FIELD, BLOCK_HEADER = b"\x1f\x8b\x08\x04", b"BC\x02\x00", 18


@dataclass
class Range(InputPartition):
    """Bytes start to end of a file. lines: line feeds before it; begins: whether a line begins at its first byte.

    lines is None where it isn't known; then content tells where a record begins.
    """

    nth: int
    file: str
    start: int
    end: int
    lines: int | None = 0
    begins: bool = True


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads."""

    of: list[Range]


def opened(file: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(file if "://" in file or file.startswith("/") else posixpath.abspath(file))


def codec(file: str) -> str | None:
    return CODECS.get(posixpath.splitext(file)[1])


def blocked(file: str) -> bool:
    """Whether a .gz file is made of independent blocks that tell their sizes."""
    fs, path = opened(file)
    with fs.open_input_file(path) as f:
        return _block_size(f.read(BLOCK_HEADER), 0) is not None


def _block_size(raw: bytes, at: int) -> int | None:
    """Bytes of the block that begins at this place, if one does."""
    head = raw[at : at + BLOCK_HEADER]
    return int.from_bytes(head[16:18], "little") + 1 if len(head) == BLOCK_HEADER and head[:4] == BLOCK_MAGIC and head[12:16] == BLOCK_FIELD else None


def _first_block(f: Any, start: int, size: int) -> int:
    """Where the first block at or after start begins: headers may occur in data, so the one it leads to must be one too."""
    if not start:
        return 0
    f.seek(start)
    raw = f.read(1 << 17)  # two blocks at most
    at = raw.find(BLOCK_MAGIC)
    while at >= 0:
        n = _block_size(raw, at)
        if n and (start + at + n == size or _block_size(raw, at + n)):
            return start + at
        at = raw.find(BLOCK_MAGIC, at + 1)
    return size


def chunks(r: Range) -> Iterator[tuple[bytes, bool]]:
    """A range's bytes, uncompressed, and the bytes after it for as long as they are asked for; whether they are the range's own."""
    fs, path = opened(r.file)
    kind = codec(r.file)
    if kind and not (kind == "gzip" and blocked(r.file)):
        with fs.open_input_stream(path, compression=kind) as f:
            while raw := f.read(READ):
                yield raw, True
        return
    with fs.open_input_file(path) as f:
        size = f.size()
        if kind:
            at = _first_block(f, r.start, size)
            f.seek(at)
            while at < size:
                head = f.read(BLOCK_HEADER)
                n = _block_size(head, 0)
                if n is None:
                    raise ValueError(f"{r.file}: no block begins at byte {at}")
                raw = zlib.decompress(head + f.read(n - BLOCK_HEADER), wbits=31)
                if raw:
                    yield raw, at < r.end
                at += n
            return
        f.seek(r.start)
        left, more = r.end - r.start, TAIL
        while left > 0 and (raw := f.read(min(READ, left))):
            yield raw, True
            left -= len(raw)
        while raw := f.read(more):
            yield raw, False
            more = min(READ, 2 * more)


def count(r: Range) -> tuple[int, int, int, bool]:
    """(nth, bytes, line feeds, whether the last byte is one) of a range."""
    n, lines, last = 0, 0, b""
    for raw, own in chunks(r):
        if not own:
            break
        n, lines, last = n + len(raw), lines + raw.count(b"\n"), raw[-1:]
    return r.nth, n, lines, last == b"\n"


def phase(lines: list[bytes]) -> list[int]:
    """Which of these lines, 0 to 3, can be the first of a record that is whole: every fourth begins with @, the second after
    it with +, and sequence and quality lines are equally long. All lines must be complete."""
    ok = []
    for k in range(min(4, len(lines) - 3)):
        heads, seqs, pluses, quals = (lines[k + i :: 4] for i in range(4))
        if all(x.startswith(b"@") for x in heads) and all(x.startswith(b"+") for x in pluses) and all(len(a) == len(b) for a, b in zip(seqs, quals, strict=False)):
            ok.append(k)
    return ok


def _batch(r: Range, rec: int | None, at: int | None, lines: list[bytes], starts: list[int] | None) -> pa.RecordBatch:
    """Records of four lines each; the last may have fewer."""
    n = -(-len(lines) // 4)
    heads, *rest = (lines[i::4] + [None] * (n - len(lines[i::4])) for i in range(4))
    named = [h.startswith(b"@") for h in heads]
    problem = [None if g and p is not None and q is not None and p.startswith(b"+") else "truncated" if q is None else "no @" if not g else "no +" for g, p, q in zip(named, rest[1], rest[2], strict=True)]
    text = lambda x: pa.array(x, pa.binary()).view(pa.string())  # noqa: E731  bytes stay as they are
    columns = [
        pa.array([r.file] * n, pa.string()),
        pa.array(np.arange(rec, rec + n)) if rec is not None else pa.nulls(n, pa.int64()),
        pa.array(starts, pa.int64()) if starts is not None else pa.nulls(n, pa.int64()),
        text([h[1:] if g else h for h, g in zip(heads, named, strict=True)]),
        *map(text, rest),
        pa.array(problem, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["file", "rec", "at", "header", "seq", "plus", "qual", "problem"])


def records(r: Range) -> Iterator[pa.RecordBatch]:
    """The records whose header line begins in a range, read on past its end as far as the last of them goes."""
    if r.lines is None:  # the byte before tells whether a line begins with the range
        r = Range(r.nth, r.file, r.start - 1, r.end, None, False)
    first = None if r.lines is None else r.lines + (not r.begins)  # number of the first line that begins here
    skip = None if first is None else (not r.begins) + -first % 4  # line feeds before the next record
    rec = None if first is None else -(-first // 4)
    plain, buf, base, limit, ended = codec(r.file) is None, b"", 0, None, False
    source = chunks(r)
    while not ended:
        raw, own = next(source, (b"", False))
        ended = not raw
        if limit is None and not own:
            limit = base + len(buf)
        buf += raw
        if skip is None:
            lines = buf.split(b"\n")[1:]
            if not ended or lines and not lines[-1]:
                lines = lines[:-1]
            found = phase(lines)
            if not ended and (len(lines) < 12 or len(found) > 1 and len(lines) < 1 << 16):
                continue
            if not found and len(lines) < 8:  # the rest of the file's last record
                return
            if not found:
                raise ValueError(f"{r.file}: no record can be told after byte {r.start}")
            skip = 1 + found[0]
        while skip and (cut := buf.find(b"\n")) >= 0:
            skip, base, buf = skip - 1, base + cut + 1, buf[cut + 1 :]
        if skip:
            if limit is not None:  # no record begins in this range: what is here is of one before it
                return
            continue
        at = np.flatnonzero(np.frombuffer(buf, np.uint8) == 10)
        feeds = at[3::4] + 1  # where each complete record ends
        starts = np.concatenate(([0], feeds))[:-1] if len(feeds) else feeds
        n = len(feeds) if limit is None else int((starts + base < limit).sum())
        if n:
            end = int(feeds[n - 1])
            yield _batch(r, rec, None, buf[: end - 1].split(b"\n"), (starts[:n] + base + r.start).tolist() if plain else None)
            rec, base, buf = None if rec is None else rec + n, base + end, buf[end:]
        if limit is not None and base >= limit:
            return
    if buf and base < limit:
        yield _batch(r, rec, None, buf.removesuffix(b"\n").split(b"\n"), [base + r.start] if plain else None)


def cut(files: list[tuple[str, int]], split: int = SPLIT) -> list[Range]:
    """All ranges of files (name, size), in order. There are about 200,000 ranges at most: larger inputs get larger ones."""
    split = max(split, sum(n for _, n in files) // 200_000)
    out: list[Range] = []
    for file, size in files:
        whole = codec(file) and not (codec(file) == "gzip" and size and blocked(file))
        for start in range(0, size, max(1, size) if whole else split):
            out.append(Range(len(out), file, start, size if whole else min(size, start + split)))
    return out


def settled(ranges: list[Range], counts: dict[int, tuple[int, int, bool]]) -> dict[str, bool]:
    """Give ranges their line numbers from the counts (bytes, lines, ended) of each; whether each file's last line is ended."""
    lines, begins, file, ends = 0, True, None, {}
    for r in ranges:
        if r.file != file:
            lines, begins, file = 0, True, r.file
        n, feeds, ended = counts[r.nth]
        r.lines, r.begins = lines, begins
        lines, begins = lines + feeds, ended if n else begins
        ends[file] = begins
    return ends


def packed(ranges: list[Range], split: int = SPLIT) -> list[Ranges]:
    """Neighbouring ranges that are small together go to one task."""
    out: list[Ranges] = []
    held = split
    for r in ranges:
        if held + r.end - r.start > split:
            out.append(Ranges([]))
            held = 0
        out[-1].of.append(r)
        held += r.end - r.start
    return out


def listed(path: str, glob: str | None = None) -> list[tuple[str, int]]:
    """(file, size) of a file, a folder's files, or a pattern's, by name; hidden files are left out."""
    fs, top = opened(path.partition("*")[0].rpartition("/")[0] if "*" in path else path)
    info = fs.get_file_info(top)
    pattern = opened(path)[1] if "*" in path else None
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(top, recursive=pattern is not None, allow_not_found=True))
    prefix = path[: path.index("://") + 3] if "://" in path else "file://"
    return sorted((prefix + x.path, x.size) for x in found if x.type == pafs.FileType.File and x.base_name[0] not in "._" and (pattern is None or fnmatch.fnmatch(x.path, pattern)) and (not glob or fnmatch.fnmatch(x.base_name, glob)))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], counting: bool):
        self.options, self.counting = dict(options), counting

    def partitions(self) -> list[Ranges]:
        split = int(self.options.get("split", SPLIT))
        if plan := self.options.pop("plan", None):  # it isn't sent to the tasks: each gets its own ranges
            found = [Range(*x) for x in json.loads(plan)]
        else:
            found = cut(listed(self.options["path"], self.options.get("glob")), split)
            for r in found:
                r.lines, r.begins = (0, True) if r.start == 0 else (None, False)
        return packed(found, split) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for r in partition.of:
            if self.counting:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in count(r)], ["nth", "bytes", "lines", "ended"])
            else:
                yield from records(r)


def last_record_end(file: str, start: int, size: int) -> int:
    """Where the last complete record before size ends; a record begins at start. Only the file's end is read."""
    fs, path = opened(file)
    back = TAIL
    with fs.open_input_file(path) as f:
        while start < size:
            low = max(start, size - back)
            f.seek(low)
            raw = f.read(size - low)
            lines = raw.split(b"\n")[:-1]
            if low > start:
                skipped, lines = len(lines[0]) + 1 if lines else 0, lines[1:]
                found = phase(lines) if len(lines) >= 8 else []
                if len(found) != 1:
                    back *= 4
                    continue
                begin, k = low + skipped, found[0]
            else:
                begin, k = low, 0
            whole = k + (len(lines) - k) // 4 * 4
            if whole > k or low == start:
                return begin + sum(len(x) + 1 for x in lines[:whole]) if whole > k else start
            back *= 4
    return start


class _Stream(DataSourceStreamReader):
    """Offsets are {file: byte where the next record begins}."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for file, size in listed(self.options["path"], self.options.get("glob")):
            if codec(file) is None:
                self.known[file] = last_record_end(file, self.known.get(file, 0), size)
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        split, out = int(self.options.get("split", SPLIT)), []
        for file, to in sorted(end.items()):
            begin = start.get(file, 0)
            for at in range(begin, to, split):
                out.append(Range(len(out), file, at, min(to, at + split), 0 if at == begin else None, at == begin))
        return packed(out, split) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for r in partition.of:
            for batch in records(r):
                yield batch.set_column(1, "rec", pa.nulls(batch.num_rows, pa.int64()))  # numbers would take a count of what came before

    def commit(self, end: dict) -> None:
        pass


class FastqSource(DataSource):
    """spark.read.format("fastq") and spark.readStream.format("fastq"): RECORDS of the option path (a file, folder or pattern).

    rec is the number within the file where the option plan gives line numbers (`fastq.read_fastq` does), else null; at is
    the byte where the record begins, null in compressed files. Without a plan, ranges inside a file find their first record
    by content, which takes well-formed records. A stream follows plain files that only grow; a record is delivered when its
    last line has its line feed. Options: split (bytes of a range), glob (of file names).
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(self.options, False)

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return _Stream(self.options)


class FastqRanges(DataSource):
    """spark.read.format("fastq_ranges"): COUNTS of the ranges in the option plan."""

    @classmethod
    def name(cls) -> str:
        return "fastq_ranges"

    def schema(self) -> str:
        return COUNTS

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(self.options, True)


def block_compressed(raw: bytes, size: int = 65280) -> bytes:
    """raw as a gzip file of independent blocks, each telling its size; an empty block ends it."""
    out = io.BytesIO()
    for at in [*range(0, len(raw), size), len(raw)]:
        part = raw[at : at + size]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        head = BLOCK_MAGIC + bytes(4) + b"\x00\xff\x06\x00" + BLOCK_FIELD + (len(body) + BLOCK_HEADER + 8 - 1).to_bytes(2, "little")
        out.write(head + body + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little"))
    return out.getvalue()
