"""What the training-data operators share: scratch tables in the cluster's shared folder, tokens, sizes."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import suppress
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A-Z to a-z on UTF-8 bytes; every other byte stays.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: Rows that a broadcast table may have at most, when its row width is fixed.
BROADCAST_ROWS = 200_000


#: Rows that go to a Python worker at once where the session keeps Spark's own figure: texts may be long.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or SparkContext.setCheckpointDir's."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/readlake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder, so that no later job depends on what an executor keeps."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    writer = df.write.mode("error").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of `written` that nothing will read again: what was made of them has been written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    name = f"__{name}"
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def hinted(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast if its counted rows are few enough, else left to a shuffle join."""
    return F.broadcast(df) if rows <= most else df


def least_hashed(rows: DataFrame, by: str, most: int) -> DataFrame:
    """Of each value of `by` the `most` rows of least 64-bit hash `h`; rows must be distinct, the values of `by` few and not null.

    Each value's count gives a hash under which a little over `most` of its rows lie, so only those are ranked together,
    however many rows the value has.
    """
    over = most + 6 * most**0.5 + 50
    cut = F.when(F.col("n") <= over, F.lit((1 << 63) - 1)).otherwise((F.lit(2.0**64) * over / F.col("n") - 2.0**63).cast("long"))
    cuts = written(rows.groupBy(F.col(by).alias("of")).agg(F.count("*").alias("n")).select("of", cut.alias("cut")), "cuts")
    near = rows.join(hinted(cuts, cuts.count()), (F.col(by) == F.col("of")) & (F.col("h") <= F.col("cut"))).drop("of", "cut")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*(["h"] + [c for c in rows.columns if c not in (by, "h")])))
    return near.withColumn("r", rank).where(F.col("r") <= most).drop("r")


def learning(column: str, modulus: int, held: int) -> F.Column:
    """True where the row may be learned from: crc32(id as text) mod modulus is not held. A null id is learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus != held, F.lit(True))


_slot: list = ["nothing yet", None]


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one thing at a time, so that stages do not add up in its memory."""
    if _slot[0] != key:
        _slot[:] = [None, None]
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # where the C library has it: freed memory goes back to the system
            ctypes.CDLL(None).malloc_trim(0)
        _slot[:] = [key, make()]
    return _slot[1]


def release() -> None:
    """Give up what the worker keeps."""
    held(None, lambda: None)


def words_of(text: bytes | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text, A-Z lower-cased."""
    return text.translate(LOWER).split() if text else []


#: Bytes of texts that are split at once; a longer text is alone.
SPLIT_BYTES = 1 << 22


def slices(texts: pa.Array, most: int = SPLIT_BYTES) -> Iterator[tuple[int, int]]:
    """Stretches of neighbouring texts, of so many bytes at most or of one text."""
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, stop
        start = stop


def raw_values(values: pa.Array, without: np.ndarray | int = 0) -> list[bytes]:
    """The values of a string array without nulls; `without`: bytes to leave out at the end of each."""
    _, offsets, data = values.buffers()
    kind = np.int64 if pa.types.is_large_string(values.type) else np.int32
    at = np.frombuffer(offsets, kind)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, kind)
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(at[:-1].tolist(), (at[1:] - without).tolist(), strict=True)]


def split_coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words [^\\x20\\x09-\\x0D]+ of texts, the place of each word among them, and where the words of each text begin.

    The last beginning is the end of all. An empty word may be among the distinct ones, but no text has it.
    """
    laid = pc.ascii_split_whitespace(texts)
    cuts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(laid), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    coded = laid.flatten().dictionary_encode()
    words, place = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    none = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) == 0)
    if len(none):  # white space at an end of a text, or no word at all
        real = place != none[0]
        place, cuts = place[real], np.concatenate([[0], np.cumsum(real)])[cuts]
    return words, place, cuts


def split(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """split_coded with the words as bytes."""
    words, place, cuts = split_coded(texts)
    return raw_values(words), place, cuts
