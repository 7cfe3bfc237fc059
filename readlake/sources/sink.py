"""FASTQ files written whole: one file for each original one, by many tasks, all of its bytes in order or no file at all.

A block of records knows where its bytes begin in its file, from sums of lengths, so tasks write their blocks in place, in any
order. A task that is tried again, or twice at once, writes the same bytes to the same places. Files are made in a staging
folder beside their place, and the commit moves them there when every block has been told of; a job that fails removes it.
Writing in place needs a file system that every executor mounts; `fastq.write_files` writes part files to any store.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from readlake.operators.inspect import DIGEST_BLOCK as BLOCK
from readlake.operators.records import record_text

#: Bytes that a task gathers before it writes; rows of a table of files or of blocks that may be broadcast.
GATHERED, BROADCAST_ROWS = 4 << 20, 200_000


def _local(path: str) -> str:
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{path}: files are written in place on mounted file systems only")
    return os.path.abspath(unquote(url.path) if url.scheme else path)


@dataclass
class Written(WriterCommitMessage):
    """Bytes that a task wrote of each file."""

    bytes: dict[str, int]


class _Writer(DataSourceArrowWriter):
    """Rows (name, at, rec, value): value follows the row before in its block, which begins at byte `at` of the file."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = _local(path), overwrite
        self.staging = f"{self.path}/.staging-{uuid.uuid4().hex}"

    def _place(self, name: str) -> str:
        place = os.path.normpath(f"{self.path}/{name}")
        if not place.startswith(f"{self.path}/"):
            raise ValueError(f"{name} is not a place below {self.path}")
        return place

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done: dict[str, int] = defaultdict(int)
        now, file, gathered, at = None, None, bytearray(), 0

        def flush() -> None:
            nonlocal at
            view = memoryview(gathered)
            while len(view):
                n = os.pwrite(file, view, at)
                at, view = at + n, view[n:]
            view.release()
            gathered.clear()

        try:
            for batch in iterator:
                for name, start, value in zip(batch.column("name").to_pylist(), batch.column("at").to_pylist(), batch.column("value").cast(pa.binary()), strict=True):
                    if (name, start) != now:
                        if file is not None:
                            flush()
                        if file is None or name != now[0]:
                            if file is not None:
                                os.close(file)
                                file = None
                            self._place(name)
                            os.makedirs(os.path.dirname(f"{self.staging}/{name}"), exist_ok=True)
                            file = os.open(f"{self.staging}/{name}", os.O_WRONLY | os.O_CREAT, 0o644)
                        now, at = (name, start), start
                    gathered += value.as_buffer()
                    done[name] += len(value.as_buffer())
                    if len(gathered) >= GATHERED:
                        flush()
            if file is not None:
                flush()
                os.fsync(file)
        finally:
            if file is not None:
                os.close(file)
        return Written(dict(done))

    def commit(self, messages: list[Written | None]) -> None:
        told: dict[str, int] = defaultdict(int)
        for m in messages:
            for name, n in (m.bytes if m else {}).items():
                told[name] += n
        try:
            for name, n in told.items():
                if os.path.getsize(f"{self.staging}/{name}") != n:
                    raise ValueError(f"{name}: tasks wrote {n} bytes, which are not the file's")
                if not self.overwrite and os.path.exists(self._place(name)):
                    raise ValueError(f"{self._place(name)} exists already")
            for name in told:
                os.makedirs(os.path.dirname(self._place(name)), exist_ok=True)
                os.replace(f"{self.staging}/{name}", self._place(name))
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class FastqFiles(DataSource):
    """Format `fastq_files`: see write_whole, which prepares its rows."""

    @classmethod
    def name(cls) -> str:
        return "fastq_files"

    def schema(self) -> str:
        return "name string, at long, rec long, value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("replace", "false") == "true")


def _small(table: DataFrame) -> DataFrame:
    """The table of files or of blocks, to be broadcast if its counted rows are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def placed(records: DataFrame, names: DataFrame, block: int = BLOCK) -> DataFrame:
    """(name, at, rec, value): each record's text with its line feed, and where its block of records begins in its file."""
    slim, of = records.select("file", "rec", "header", "seq", "plus", "qual"), names.select(F.col("file").alias("__file"), "name", "ended")
    named = slim.join(_small(of), F.col("file") == F.col("__file"))
    text = record_text(F.col("header"), F.col("seq"), F.col("plus"), F.col("qual"))
    d = named.select("name", "ended", F.floor(F.col("rec") / block).cast("long").alias("block"), "rec", text.alias("text"))
    sizes = d.groupBy("name", "block").agg(F.sum(F.octet_length("text") + 1).alias("n"), F.max("rec").alias("top"))
    file = Window.partitionBy("name")
    before = F.sum("n").over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("name").alias("__name"), F.col("block").alias("__block"), F.coalesce(before, F.lit(0)).cast("long").alias("at"), F.max("top").over(file).alias("last"))
    rows = d.join(_small(starts), (F.col("name") == F.col("__name")) & (F.col("block") == F.col("__block")))
    rows = rows.withColumn("value", F.concat("text", F.when(~F.col("ended") & (F.col("rec") == F.col("last")), "").otherwise("\n")))
    return rows.select("name", "at", "rec", "value").repartition("name", "at").sortWithinPartitions("name", "at", "rec")


def write_whole(records: DataFrame, names: DataFrame, path: str, overwrite: bool = False, block: int = BLOCK) -> None:
    """Each file's records as one file path/<name>. names: (file, name, ended), each file and each name once.

    records: good ones (file, rec, header, seq, plus, qual), numbered in their order; other columns are not read, and files
    that names doesn't tell of are left out. A file whose last line had no line feed gets none (ended is false). A file that
    exists is an error, before anything is moved, unless overwrite; names that lead out of path are errors. Without a record
    no file is written. A single file is the work of as many tasks as it has blocks of records.
    """
    spark: SparkSession = records.sparkSession
    spark.dataSource.register(FastqFiles)
    placed(records, names, block).write.format("fastq_files").option("replace", str(overwrite).lower()).mode("append").save(path)
