"""A columnar archive of records that gives back the original bytes.

records/  one row per record, files and record numbers in order, in typed columns (see functions.coded): two bits a base
          with the stretches that are something else, header tokens as numbers and words; a record whose typed form would
          not be smaller or not be exact keeps its text; `plus` is null where it follows from the header
digests/  a digest of every block of records, which tells whether and where contents differ, with the block's sizes
info/     key, value
streams/  sizes of the columns, kept for inspection and checked on reading
"""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.functions import coded as K
from readlake.functions.columns import second_id
from readlake.operators.inspect import DIGEST_BLOCK, differences, differing_blocks, row_digest, stream_sizes
from readlake.operators.records import decisive
from readlake.sources.fastq import ended, layout, read_records, write_files

# The version of this layout, and names of streams and of info keys that users look for.
VERSION = 3
#: Compression levels of levels 1 to 4.
ZSTD = {1: 1, 2: 3, 3: 6, 4: 12}
COLUMNS = {"rec": "header", "gen": "seq", "qlt": "qual", "usr.plus": "plus"}
CONTENT = ["header", "seq", "plus", "qual"]
HEADER = ["marks", "words", *[f"n{i}" for i in range(K.SLOTS)]]


def _blocks(records: DataFrame) -> DataFrame:
    """(file, block, n, hi, lo, sizes, first, color): all that is told of records, in one pass over them.

    sizes: bytes and count of each column; first: the first record's header, length and second id; color: the first record
    that decides whether the file is in color space.
    """
    d = records.select("file", "rec", F.floor(F.col("rec") / DIGEST_BLOCK).cast("long").alias("block"), row_digest("rec", CONTENT).alias("h"), decisive(F.col("seq")).alias("color"), *CONTENT)
    sums = F.struct(*[x for c in CONTENT for x in (F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).cast("long").alias(f"{c}_bytes"), F.count(c).alias(f"{c}_n"))])
    first = F.min_by(F.struct("rec", "header", F.length("seq").cast("long").alias("llen"), second_id(F.col("plus")).alias("second_id")), "rec")
    return d.groupBy("file", "block").agg(
        F.count("*").alias("n"), F.sum(F.shiftrightunsigned("h", 32)).alias("hi"), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"),
        sums.alias("sizes"), first.alias("first"), F.min_by(F.struct("rec", "color"), F.when(F.col("color").isNotNull(), F.col("rec"))).alias("color"),
    )


def _streams(blocks: DataFrame) -> DataFrame:
    """The directory of streams from the blocks' sizes."""
    sums = blocks.agg(*[F.sum(f"sizes.{c}_{x}").alias(f"{c}_{x}") for c in CONTENT for x in ("bytes", "n")])
    return stream_sizes(sums, {name: (F.col(f"{c}_bytes"), F.col(f"{c}_n")) for name, c in COLUMNS.items()}, summed=True)


def typed(records: DataFrame) -> DataFrame:
    """Records (file, rec, header, seq, plus, qual) in the archive's columns."""
    plain = F.when(F.col("plus") == "+", "+").when(F.col("plus") == F.concat(F.lit("+"), "header"), "=")
    named, small = K.typable(F.col("header")), K.packable(F.col("seq"))
    d = records.select("*", named.alias("__named"), small.alias("__small"), plain.alias("form"))
    d = d.withColumn("__s", K.packed_sequence(F.when(F.col("__small"), F.col("seq")))).withColumn("__h", K.typed_header(F.when(F.col("__named"), F.col("header"))))
    tokens = [F.col("__h.marks"), F.col("__h.split.words"), *[F.get("__h.split.numbers", F.lit(i)).alias(f"n{i}") for i in range(K.SLOTS)]]
    return d.select("file", "rec", F.when(~F.col("__named"), F.col("header")).alias("header"), *tokens, F.when(~F.col("__small"), F.col("seq")).alias("seq"), F.col("__s.bases"), F.col("__s.n").alias("length"), F.col("__s.odd"), "qual", "form", F.when(F.col("form").isNull(), F.col("plus")).alias("plus"))


def restored(stored: DataFrame) -> DataFrame:
    """The inverse: (file, rec, header, seq, form, plus, qual); a column that isn't asked for isn't decoded."""
    header = F.coalesce("header", K.header_of({c: F.col(c) for c in HEADER}))
    seq = F.coalesce("seq", K.sequence_of(F.col("bases"), F.col("length"), F.col("odd")))
    return stored.select("file", "rec", header.alias("header"), seq.alias("seq"), "form", "plus", "qual")


def _whole(d: DataFrame) -> DataFrame:
    plus = F.coalesce("plus", F.when(F.col("form") == "+", F.lit("+")).when(F.col("form") == "=", F.concat(F.lit("+"), "header")))
    return d.select("file", "rec", "header", "seq", plus.alias("plus"), "qual")


def write_archive(records: DataFrame, path: str, level: int = 3, overwrite: bool = False, ended: DataFrame | None = None) -> None:
    """Store good records (file, rec, header, seq, plus, qual); an existing archive is an error unless overwrite.

    ended: (file, ended), files whose last line has no line feed; all others have one. Info keys name whole paths. Nulls
    come back as nulls, whatever column they are in; no record gives an empty archive.
    """
    level, mode = min(4, max(1, level)), "overwrite" if overwrite else "error"
    ordered = typed(records.select("file", "rec", *CONTENT).repartitionByRange("file", "rec").sortWithinPartitions("file", "rec"))
    # the second version of the format stores differences of numbers
    ordered.write.mode(mode).option("compression", "zstd").option("parquet.compression.codec.zstd.level", ZSTD[level]).option("parquet.writer.version", "v2").parquet(f"{path}/records")
    spark = records.sparkSession
    whole = _whole(restored(spark.read.parquet(f"{path}/records")))
    _blocks(whole).coalesce(1).sortWithinPartitions("file", "block").write.mode(mode).parquet(f"{path}/digests")
    blocks = spark.read.parquet(f"{path}/digests")
    _streams(blocks).coalesce(1).write.mode(mode).parquet(f"{path}/streams")
    shape = blocks.groupBy("file").agg(F.sum("n").alias("n"), F.min_by("first", "first.rec").alias("f"), F.min_by("color", "color.rec").alias("c"))
    table = shape.select("file", "n", F.col("f.header").alias("first"), "f.llen", "f.second_id", F.coalesce("c.color", F.lit(False)).alias("color_space"))
    ended = (ended if ended is not None else table.select("file", F.lit(True).alias("ended")).limit(0)).withColumnRenamed("file", "__of")
    table = table.join(ended, F.col("file") == F.col("__of"), "left").withColumn("ended", F.coalesce("ended", F.lit(True)))
    told = {"rec.first": F.col("first"), "llen": F.col("llen"), "usr.2id": F.col("second_id"), "usr.color": F.col("color_space"), "num_records": F.col("n"), "orig.filename": F.col("file"), "final.newline": F.col("ended")}
    per_file = table.select(F.explode(F.array(*[F.struct(F.concat(F.lit(k + ":"), F.col("file")).alias("key"), v.cast("string").alias("value")) for k, v in told.items()])).alias("s")).select("s.*")
    general = spark.createDataFrame([("config.level", str(level)), ("version", str(VERSION))], "key string, value string")
    general.unionByName(per_file).coalesce(1).write.mode(mode).parquet(f"{path}/info")


def info(spark: SparkSession, path: str) -> DataFrame:
    """(key, value), by key."""
    return spark.read.parquet(f"{path}/info").orderBy("key")


def streams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/streams").orderBy("stream")


def stream(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(file, rec, value) of one stream; a stream that the archive doesn't have is empty, not an error."""
    records = restored(spark.read.parquet(f"{path}/records"))
    return records.select("file", "rec", F.col(COLUMNS[name]).alias("value")).where("value is not null") if name in COLUMNS else records.select("file", "rec", F.col("header").alias("value")).limit(0)


def stored_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/digests")


def verify(spark: SparkSession, path: str, contents: bool = True) -> None:
    """Raise if the archive is of another version, or if its files have other numbers of records or (contents) blocks of
    records other digests than were written. Contents take a pass over all records; the error names some of the blocks."""
    version = spark.read.parquet(f"{path}/info").where("key = 'version'").first()
    if version is None or int(version["value"]) > VERSION:
        raise ValueError(f"{path}: version {version and version['value']} is newer than {VERSION}")
    if int(version["value"]) < VERSION:
        raise ValueError(f"{path}: version {version['value']} is older than {VERSION}")
    records, kept = spark.read.parquet(f"{path}/records"), stored_digests(spark, path)
    counts = lambda d, n: {tuple(r) for r in d.groupBy("file").agg(n.alias("n")).collect()}
    if counts(records, F.count("*")) != counts(kept, F.sum("n")):
        raise ValueError(f"{path}: stored sizes differ from the records")
    if contents:
        odd = differing_blocks(kept, _blocks(_whole(restored(records))), ["file"]).take(5)
        if odd:
            raise ValueError(f"{path}: contents differ from what was written, in blocks {', '.join(f'{r.file}:{r.block}' for r in odd)}")


def compare(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(file, rec, left_rows, right_rows, changed) of the records in which two archives differ.

    Stored digests are compared first; records are read only in blocks whose digests differ.
    """
    rows = [_whole(restored(spark.read.parquet(f"{p}/records"))) for p in (left, right)]
    return differences(*rows, CONTENT, ["file"], kept=(stored_digests(spark, left), stored_digests(spark, right)))


def read_archive(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """(file, rec, header, seq, plus, qual), as they were written; check: version and counts first; contents by `verify`."""
    if check:
        verify(spark, path, contents=False)
    return _whole(restored(spark.read.parquet(f"{path}/records")))


def compress(spark: SparkSession, paths: str | list[str], out: str, level: int = 3, overwrite: bool = False, glob: str | None = None, recursive: bool = False) -> None:
    """FASTQ files to an archive; a bad record is an error, a missing line feed at a file's end is kept as it is."""
    found = layout(spark, paths, glob, recursive)
    write_archive(read_records(spark, found, "FAILFAST"), out, level, overwrite, ended(spark, found))


def file_names(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, ended) of an archive's files: names are paths below the folder that holds them all, so no two are the same."""
    rows = spark.read.parquet(f"{path}/info")
    of = lambda key: rows.where(F.col("key").startswith(f"{key}:")).select(F.expr(f"substring(key, {len(key) + 2})").alias("file"), "value")
    files = of("orig.filename").select("file").join(of("final.newline").select("file", (F.col("value") == "true").alias("ended")), "file")
    low, high = files.agg(F.min("file"), F.max("file")).first()  # what these two begin with, all begin with
    below = commonprefix([low or "", high or ""]).rpartition("/")[0]
    return files.select("file", F.expr(f"substring(file, {len(below) + 2})").alias("name"), "ended")


def decompress(spark: SparkSession, path: str, out: str, overwrite: bool = False) -> None:
    """An archive to FASTQ in one job: the part files below out/file=<name> hold an original file's bytes, in their order."""
    write_files(read_archive(spark, path), file_names(spark, path), out, overwrite)
