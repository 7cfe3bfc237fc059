"""FASTQ files as a stream: every micro-batch of new files is parsed and appended to a growing archive table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from readlake.operators.records import parse

def stream_records(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the records of FASTQ files that arrive in folder to out, as (file, rec, header, seq, plus, qual, problem).

    A file is taken whole, so it must be under 2 GB and be moved into the folder when it is complete; compressed files do.
    Every file's records are numbered from 0. A batch that is tried again writes its own folder anew, so each record is
    kept once. An empty file has no record.
    """
    files = spark.readStream.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def append(batch: DataFrame, number: int) -> None:
        body = F.when(F.col("value").endswith("\n"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
        lines = batch.where("value <> ''").select("file", F.posexplode(F.split(body, "\n", -1)).alias("ln", "line"))
        parse(lines, ["file"]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_profile(spark: SparkSession, folder: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Streaming counts of events (ts, event_type) per window and type; events later than the watermark are left out."""
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(folder)
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def drained(stream: DataFrame, path: str) -> DataFrame:
    """The table path/rows: what the stream gives for all that its sources hold now; path/marks keeps how far it came."""
    sink = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/marks")
    sink.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
