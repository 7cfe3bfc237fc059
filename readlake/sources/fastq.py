"""FASTQ files as DataFrames and back: four-line records with an explicit record number per file.

Nothing is shuffled to read them. Lines: every split of a file counts its lines, the counts are summed in file order, and
each line adds its place in its split. Records: see `datasource`; each task assembles the records of its ranges.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readlake.functions.columns import file_type
from readlake.operators.records import checked, record_text
from readlake.sources.datasource import SPLIT, FastqRanges, FastqSource, Range, cut, settled

#: Rows of the per-split table that may be broadcast.
BROADCAST_SPLITS = 200_000


def read_lines(spark: SparkSession, paths: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(file, ln, line): every line of every file, numbered from 0; only a line feed ends a line, bytes stay as they are."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    splits = raw.groupBy("file", "split").agg(F.min("id").alias("lo"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    base = splits.select("file", "split", (F.coalesce(before, F.lit(0)) - F.col("lo")).alias("shift"))
    if splits.count() <= BROADCAST_SPLITS:
        base = F.broadcast(base)
    return raw.join(base, ["file", "split"]).select("file", (F.col("id") + F.col("shift")).alias("ln"), "line")


@dataclass(frozen=True)
class Layout:
    """All ranges of some files with their line numbers, and whether each file's last line ends with a line feed."""

    ranges: list[Range]
    ends: dict[str, bool]
    split: int


def register(spark: SparkSession) -> None:
    """Make the formats `fastq` and `fastq_ranges` known to a session."""
    spark.dataSource.register(FastqSource)
    spark.dataSource.register(FastqRanges)


def _planned(spark: SparkSession, name: str, ranges: list[Range], split: int) -> DataFrame:
    plan = json.dumps([[r.nth, r.file, r.start, r.end, r.lines, r.begins] for r in ranges])
    return spark.read.format(name).option("plan", plan).option("split", split).load()


def layout(spark: SparkSession, paths: str | list[str], glob: str | None = None, recursive: bool = False, split: int = SPLIT) -> Layout:
    """Count the lines of every range of the files. The driver holds one small entry a range, of which there are about
    200,000 at most; files of any size and of any compression that is read count. An empty file has no range."""
    register(spark)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    names = reader.load(paths).select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:///"), "_metadata.file_size")  # contents aren't read
    ranges = cut(sorted(map(tuple, names.collect())), split)
    counts = {r.nth: (r.bytes, r.lines, r.ended) for r in _planned(spark, "fastq_ranges", ranges, split).collect()}
    return Layout(ranges, settled(ranges, counts), split)


def ended(spark: SparkSession, found: Layout) -> DataFrame:
    """(file, ended): whether each file's last line ends with a line feed."""
    return spark.createDataFrame(sorted(found.ends.items()), "file string, ended boolean")


def read_records(spark: SparkSession, found: Layout, mode: str = "PERMISSIVE") -> DataFrame:
    """The records of files laid out before, as of `read_fastq`."""
    rows = _planned(spark, "fastq", found.ranges, found.split)
    return checked(rows.select("file", "rec", "header", "seq", "plus", "qual", "problem"), mode)


def read_fastq(spark: SparkSession, paths: str | list[str], mode: str = "PERMISSIVE", glob: str | None = None, recursive: bool = False, split: int = SPLIT) -> DataFrame:
    """(file, rec, header, seq, plus, qual, problem). mode as of Spark's own readers; see records.checked.

    Four lines are a record, whatever they hold; problem tells what is wrong with it, as `records.parse` does. Files are
    cut into ranges of `split` bytes, block-compressed ones too; no exchange is in the plan.
    """
    return read_records(spark, layout(spark, paths, glob, recursive, split), mode)


def fastq_lines(records: DataFrame) -> DataFrame:
    """(value): the four lines of each record in order, ready for a text writer."""
    text = records.select("file", "rec", record_text(F.col("header"), F.col("seq"), F.col("plus"), F.col("qual")).alias("value"))
    return text.repartitionByRange("file", "rec").sortWithinPartitions("file", "rec").select("value")


def write_files(records: DataFrame, names: DataFrame, path: str, overwrite: bool = False) -> None:
    """Each file's records as text below path/file=<name>, all files in one job: part files by number give the file's bytes.

    names: (file, name, ended). The last record of a file that is not ended by a line feed is a part file of its own, the
    last one, and ends with its own last byte.
    """
    spark = records.sparkSession
    named = records.join(names.withColumnRenamed("file", "__file"), F.col("file") == F.col("__file")).drop("__file")
    text = record_text(F.col("header"), F.col("seq"), F.col("plus"), F.col("qual"))
    last = named.where(~F.col("ended")).groupBy("name").agg(F.max("rec").alias("__last")).withColumnRenamed("name", "__name")
    odd = (F.col("name") == F.col("__name")) & (F.col("rec") == F.col("__last"))
    whole = named.join(last, odd, "left_anti").select(F.col("name").alias("file"), "rec", text.alias("value"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = whole.repartitionByRange(parts, "file", "rec").sortWithinPartitions("file", "rec").select("file", "value")
    ordered.write.mode("overwrite" if overwrite else "error").partitionBy("file").option("lineSep", "\n").text(path)
    tails = named.join(last, odd, "left_semi").select("name", text.alias("value"))
    # a writer ends a row with a separator of its choice, so these end with their own last character
    for (end,) in tails.select(F.expr("right(value, 1)")).distinct().collect():  # characters of quality lines: few
        rest = tails.where(F.expr("right(value, 1)") == end).select(F.col("name").alias("file"), F.expr("substring(value, 1, length(value) - 1)").alias("value"))
        placed = rest.repartitionById(parts + 1, F.lit(parts))
        placed.write.mode("append").partitionBy("file").option("lineSep", end).text(path)


def write_fastq(records: DataFrame, path: str, overwrite: bool = False, compression: str = "none") -> None:
    """Part files in record order; an existing path is an error unless overwrite."""
    fastq_lines(records).write.mode("overwrite" if overwrite else "error").option("lineSep", "\n").option("compression", compression).text(path)


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, ln, seq, illegal): sequence lines of FASTA files, upper case, without unknown bases; header lines are left out.

    illegal: the line holds something else than the four bases.
    """
    lines = read_lines(spark, paths).where(~F.col("line").startswith(">"))
    seq = lines.select("file", "ln", F.regexp_replace(F.upper("line"), "[N\\s]", "").alias("seq")).where("seq <> ''")
    return seq.withColumn("illegal", F.col("seq").rlike("[^ACGT]"))


def sniffed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, kind): archive, fastq, empty or other, from each file's first line."""
    first = read_lines(spark, paths).where("ln = 0").select(F.col("file"), F.col("line"))
    return first.select("file", file_type(F.col("line")).alias("kind"))


def file_name(file: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(file, "/"), -1)
