"""A token-id store: one zstandard frame per document, one shared dictionary, an offset index.

Layout below a folder, all written by Spark so that any file system it can write will do:

    dictionary/  one row: hash, content
    blocks/      part, nth, payload: frames of consecutive documents, one after the other; their ids, sizes and lengths
    heads/       part, nth (the block), before (ids of all blocks before it), dict_hash
    index/       per document: its block, at, size (the frame within the payload), start (ids before it), n_tokens, dict_hash

Rows are in ascending id order over the blocks. A frame holds a document's ids as little-endian uint32. A reader needs the
index row, its block and the dictionary, so a short document costs one block read and one small decompression.
"""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readlake.llm import tokens
from readlake.llm.common import hinted, scratch_path, written

#: The dictionary: documents sampled for it at most, ids of one that take part at most, its size in bytes.
SAMPLE_DOCS, FRAGMENT, DICT_BYTES = 2_000, 4_096, 64 << 10
#: Payload bytes after which a block is closed.
BLOCK_BYTES = 4 << 20
#: Tokens of a range of ids that one task puts in order, about.
PART_TOKENS = 64 << 20
LEVEL = 3
#: Blocks up to which a selective read names its blocks to the scan.
SEEKS = 256


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """Trained on the ids of a bounded sample: the SAMPLE_DOCS documents with the least id and text hash, of any length.

    Of a longer document FRAGMENT ids from a place that its hash tells take part. Too few documents to train on give an
    empty dictionary, which means none, and a warning.
    """
    fit = docs.where(F.length("text") > 0).withColumn("h", F.xxhash64("doc_id", "text"))
    most = fit.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    sample = fit.where(F.col("h") <= F.lit(most)).dropDuplicates(["h"]).select("h", "text")
    ids = [bytes(x.ids) for x in sample.mapInArrow(lambda it: _fragments(it, tokenizer, end_id), "ids binary").toLocalIterator()]
    try:
        if len(ids) >= 8:
            return zstandard.train_dictionary(DICT_BYTES, ids, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        pass
    warnings.warn(f"{len(ids)} documents are too few to train a dictionary on: frames are compressed without one", stacklevel=2)
    return b""


def _fragments(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc, end = tokens.encoder(tokenizer), end_id.to_bytes(4, "little")
    for batch in batches:
        out = []
        whole = (x.as_py() for _, _, ids in enc.encoded(batch.column(1), end) for x in ids)
        for h, ids in zip(batch.column(0).to_pylist(), whole, strict=True):
            start = 4 * (h % max(1, len(ids) // 4 - FRAGMENT + 1))
            out.append(ids[start : start + 4 * FRAGMENT])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def dict_hash(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()[:16]


def _frames(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, content: bytes) -> Iterator[pa.RecordBatch]:
    enc, end = tokens.encoder(tokenizer), end_id.to_bytes(4, "little")
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(content), write_content_size=True)
    for batch in batches:
        for start, stop, ids in enc.encoded(batch.column(1), end):
            frames, counts = [], []
            for x in ids:
                frames.append(press.compress(x.as_buffer()))
                counts.append(x.as_buffer().size // 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "n_tokens", "frame"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of consecutive frames; `part` is the range of ids that the task holds, `nth` counts its blocks."""
    from pyspark import TaskContext

    part, nth, held, size = TaskContext.get().partitionId(), 0, [], 0
    names = ["part", "nth", "payload", "ids", "sizes", "counts"]

    def block() -> pa.RecordBatch:
        docs, counts, frames = zip(*held, strict=True)
        columns = [pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([b"".join(frames)], pa.binary())]
        lists = [pa.array([list(docs)], pa.list_(pa.int64())), pa.array([list(map(len, frames))], pa.list_(pa.int64())), pa.array([list(counts)], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, *lists], names)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            size += len(row[2])
            if size >= BLOCK_BYTES:
                yield block()
                held, size, nth = [], 0, nth + 1
    if held:
        yield block()


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, append end_id to each, and write the store to the folder out, which must not exist.

    Null and empty texts hold the end id alone; null ids come first; repeated rows stay; equal ids are in no set order
    among themselves; other columns are not read. An empty table gives an empty store.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    content = train_dictionary(slim, tokenizer, end_id)
    spark, digest = docs.sparkSession, dict_hash(content)
    spark.createDataFrame([(digest, bytearray(content))], "hash string, content binary").coalesce(1).write.parquet(f"{out}/dictionary")
    framed = written(slim.mapInArrow(lambda it: _frames(it, tokenizer, end_id, content), "doc_id long, n_tokens long, frame binary"), "frames")
    total = framed.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_TOKENS))
    ordered = framed.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    schema = "part int, nth int, payload binary, ids array<long>, sizes array<long>, counts array<long>"
    ordered.mapInArrow(_pack, schema).write.option("compression", "uncompressed").parquet(f"{out}/blocks")
    blocks = spark.read.schema(schema).parquet(f"{out}/blocks")
    # one row a block: ids of all blocks before it, summed first within a part, then over the parts
    totals = blocks.select("part", "nth", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts_before = totals.groupBy("part").agg(F.sum("n").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("parts_before"))
    starts = totals.select("part", "nth", F.sum("n").over(Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)).alias("nth_before")).join(parts_before, "part")
    starts.select("part", "nth", (F.coalesce("nth_before", F.lit(0)) + F.coalesce("parts_before", F.lit(0))).alias("before"), F.lit(digest).alias("dict_hash")).write.parquet(f"{out}/heads")
    _listed(spark, out, ["ids", "sizes", "counts"]).mapInArrow(_index, INDEX).write.option("compression", "zstd").parquet(f"{out}/index")


INDEX = "part int, nth int, before long, dict_hash string, doc_id long, at long, size long, start long, n_tokens long"


def _listed(spark: SparkSession, store: str, columns: list[str]) -> DataFrame:
    """The blocks with their heads: part, nth, before, dict_hash, columns."""
    heads = spark.read.parquet(f"{store}/heads")
    return spark.read.parquet(f"{store}/blocks").join(hinted(heads, heads.count()), ["part", "nth"]).select("part", "nth", "before", "dict_hash", *columns)


def _places(batch: pa.RecordBatch, k: int, ids: int) -> list:
    """Of one block: doc ids, offsets, sizes, first ids and counts of its documents; ids: the column of the first list."""
    import numpy as np

    before = batch.column("before")[k].as_py()
    docs, sizes, counts = (batch.column(c)[k].values for c in range(ids, ids + 3))
    s, c = np.asarray(sizes), np.asarray(counts)
    return [docs, np.cumsum(s) - s, s, np.cumsum(c) - c + before, c]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document: running sums within its block."""
    names = ["part", "nth", "before", "dict_hash", "doc_id", "at", "size", "start", "n_tokens"]
    for batch in batches:
        for k in range(batch.num_rows):
            docs, *places = _places(batch, k, 4)
            yield pa.RecordBatch.from_arrays([*[pa.repeat(batch.column(c)[k], len(docs)) for c in range(4)], docs, *map(pa.array, places)], names)


def dictionary(spark: SparkSession, store: str) -> bytes:
    """The store's dictionary, after a check of its hash."""
    row = spark.read.parquet(f"{store}/dictionary").first()
    content = bytes(row["content"])
    if dict_hash(content) != row["hash"]:
        raise ValueError(f"the dictionary of {store} does not match its hash")
    return content


def _read(batches: Iterator[pa.RecordBatch], content: bytes) -> Iterator[pa.RecordBatch]:
    """Documents of whole blocks, or of those that the columns `rows` name."""
    press = zstandard.ZstdDecompressor(dict_data=_dictionary(content))
    digest = dict_hash(content)
    for batch in batches:
        for k in range(batch.num_rows):
            payload = memoryview(batch.column("payload")[k].as_buffer())
            if "rows" in batch.schema.names:
                rows = [(r["doc_id"], r["at"], r["size"], r["start"], r["n_tokens"]) for r in batch.column("rows")[k].as_py()]
            else:
                docs, *places = _places(batch, k, 4)
                rows = zip(docs.to_pylist(), *(x.tolist() for x in places), strict=True)
            if batch.column("dict_hash")[k].as_py() != digest:
                raise ValueError("a block names another dictionary")
            done: list[tuple] = []
            held = 0
            for doc, at, size, start, n in rows:
                ids = press.decompress(payload[at : at + size])
                if len(ids) != 4 * n:
                    raise ValueError("a document's length differs from the index")
                done.append((doc, start, n, ids))
                held += len(ids)
                if held > BLOCK_BYTES:
                    yield _documents(done)
                    done, held = [], 0
            if done:
                yield _documents(done)


def _documents(done: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], ["doc_id", "start", "n_tokens", "ids"])


def read(spark: SparkSession, store: str, where: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents that the index condition `where` selects, or of all.

    ids are the little-endian uint32 of a document with its end id. With a condition only blocks that hold a selected
    document are read, and only its frames are decompressed.
    """
    content, schema = dictionary(spark, store), "doc_id long, start long, n_tokens long, ids binary"
    if not where:
        return _listed(spark, store, ["ids", "sizes", "counts", "payload"]).mapInArrow(lambda it: _read(it, content), schema)
    rows = F.sort_array(F.collect_list(F.struct("at", "size", "doc_id", "start", "n_tokens")))
    asked = spark.read.parquet(f"{store}/index").where(where).groupBy("part", "nth", "dict_hash").agg(rows.alias("rows"))
    blocks = spark.read.parquet(f"{store}/blocks").select("part", "nth", "payload")
    if len(few := asked.select("part", "nth").limit(SEEKS + 1).collect()) <= SEEKS:  # the scan skips all other blocks
        blocks = blocks.where(F.col("part").isin([r["part"] for r in few]) & F.col("nth").isin([r["nth"] for r in few]))
    return blocks.join(asked, ["part", "nth"]).select("payload", "rows", "dict_hash").mapInArrow(lambda it: _read(it, content), schema)


def store_path(spark: SparkSession) -> str:
    return scratch_path(spark, "token-store")
