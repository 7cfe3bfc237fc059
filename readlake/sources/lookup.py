"""Single records of an archive: by number, or by header.

The archive's records lie in the order of their files and numbers, so the ranges that its files know of their row groups and
pages tell where a number is. For headers, an index of their hashes in rising order is written beside the records: a hash is
found in it by the same ranges, and tells the blocks of records that may hold the header. Nothing else is read of either.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.sources.archive import read_archive

#: Records of a block that is read, and blocks that a lookup asks for by their ranges; for more it reads all records.
BLOCK, MOST_BLOCKS = 4096, 256


def between(spark: SparkSession, path: str, file: str, first: int, last: int) -> DataFrame:
    """Records first to last (both included) of a file, as of read_archive; numbers that it hasn't got are left out."""
    return read_archive(spark, path, check=False).where((F.col("file") == file) & F.col("rec").between(first, last))


def _index(spark: SparkSession, path: str) -> str:
    """The index's folder: its name is made of the records' part files, so other records never meet this index."""
    parts = sorted(f.rsplit("/", 1)[-1] for f in spark.read.parquet(f"{path}/records").inputFiles())
    return f"{path}/headers-{hashlib.sha256(','.join(parts).encode()).hexdigest()[:16]}"


def index_headers(spark: SparkSession, path: str, overwrite: bool = False) -> None:
    """Write (hash, file, rec) of all records with a header, by hash; equal headers may lie in several tasks' files.

    Null headers are left out: nothing finds them. An archive without records gets an empty index.
    """
    rows = read_archive(spark, path, check=False).where("header is not null").select(F.xxhash64("header").alias("hash"), "file", "rec")
    ordered = rows.repartitionByRange("hash", "file", "rec").sortWithinPartitions("hash", "file", "rec")
    ordered.write.mode("overwrite" if overwrite else "error").option("compression", "zstd").option("parquet.writer.version", "v2").parquet(_index(spark, path))


def _any(terms: list[Column]) -> Column:
    return reduce(or_, terms, F.lit(False))


def find(spark: SparkSession, path: str, headers: list[str]) -> DataFrame:
    """All records, as of read_archive, whose header is one of a short list; nulls in it and headers nobody has find nothing.

    Each header is a term of the filter that the index is read with. Records are read from the blocks that the index names,
    or all where it names over MOST_BLOCKS (a header that is everywhere); the rows are the same. An archive whose records
    have no index, or one of records that are no longer there, is an error.
    """
    wanted = sorted({h for h in headers if h is not None})
    records = read_archive(spark, path, check=False).where(F.col("header").isin(wanted))
    try:
        index = spark.read.schema("hash long, file string, rec long").parquet(_index(spark, path))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise ValueError(f"{path}: no index of these records; index_headers writes it") from e
    named = index.where(_any([F.col("hash") == F.xxhash64(F.lit(h)) for h in wanted])).select("file", F.floor(F.col("rec") / BLOCK).cast("long").alias("block")).distinct()
    blocks = named.limit(MOST_BLOCKS + 1).collect()
    if len(blocks) > MOST_BLOCKS:
        return records
    return records.where(_any([F.col("file").eqNullSafe(b["file"]) & F.col("rec").between(b["block"] * BLOCK, b["block"] * BLOCK + BLOCK - 1) for b in blocks]))
