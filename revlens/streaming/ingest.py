"""Streaming operators (§2.10).

Each operator reads a folder of parquet files as a stream, keeps its state in
a checkpoint under the shared checkpoint folder (so a restarted job resumes
where it stopped and a lost executor only replays its micro-batch), and writes
its result as a parquet table. ``trigger(availableNow=True)`` processes what
is there in bounded micro-batches and stops; the same code runs continuously
with a processing-time trigger.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import is_folder, scratch_path
from ..sources import ledger


# Input of one micro-batch, whatever the size of the table behind the stream.
BYTES_PER_TRIGGER = 1 << 30


def stage_files(df: DataFrame, path: str, rows_per_file: int) -> str:
    """Write a derived table as parquet parts of at most ``rows_per_file`` rows,
    so a file source can replay it as successive micro-batches. No shuffle:
    every task splits its own output, so the write is as parallel as the input.
    Stored tables need no staging: the operators stream them where they lie."""
    df.write.mode("overwrite").option("maxRecordsPerFile", max(1, int(rows_per_file))).parquet(path)
    return path


def _source(spark: SparkSession, path: str, schema: T.StructType, max_bytes: int) -> DataFrame:
    """Stream of the parquet files of a folder (or of one file), in micro-batches of about ``max_bytes``."""
    r = spark.readStream.schema(schema).option("maxBytesPerTrigger", int(max_bytes))
    path = path.rstrip("/")
    if not is_folder(spark, path):
        path, name = path.rsplit("/", 1)
        r = r.option("pathGlobFilter", name)
    return r.parquet(path)


def ingest_incremental(spark: SparkSession, source: str, schema: T.StructType, sink: str | None = None,
                       checkpoint: str | None = None, max_bytes: int = BYTES_PER_TRIGGER) -> DataFrame:
    """Append every new file of ``source`` to the ``sink`` table exactly once."""
    sink = sink or scratch_path(spark, "ingest-sink")
    checkpoint = checkpoint or scratch_path(spark, "ingest-ckpt")
    q = (_source(spark, source, schema, max_bytes).writeStream.format("parquet")
         .option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(schema).parquet(sink)


def ingest_exactly_once(spark: SparkSession, source: str, schema: T.StructType, table: str, checkpoint: str | None = None,
                        writer: str = "ingest", max_bytes: int = BYTES_PER_TRIGGER) -> DataFrame:
    """Append every new file of ``source`` to ``table`` under a ledger (``sources.ledger``): a micro-batch counts once,
    also when it is run again after a crash, or all of them are after a lost checkpoint, and a batch that was written
    but not committed is never read. The numbers of the batches belong to ``writer``."""
    checkpoint = checkpoint or scratch_path(spark, "once-ckpt")

    def write(batch: DataFrame, number: int) -> None:
        ledger.append_once(batch, table, writer, number)

    q = (_source(spark, source, schema, max_bytes).writeStream.foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return ledger.read_committed(spark, table, schema)


def stream_dedup(spark: SparkSession, source: str, schema: T.StructType, keys: Sequence[str], event_time: str,
                 delay: str | None = None, sink: str | None = None, checkpoint: str | None = None,
                 max_bytes: int = BYTES_PER_TRIGGER) -> DataFrame:
    """One row per key across micro-batches.

    ``delay=None`` is exact: every key ever seen stays in state. With a delay,
    state is bounded by the watermark: a key counts as new again when its last
    event is more than ``delay`` of event time behind, and events that arrive
    later than ``delay`` behind the newest one are dropped by Spark. Choose a
    delay no shorter than the lateness of the source."""
    sink = sink or scratch_path(spark, "dedup-sink")
    checkpoint = checkpoint or scratch_path(spark, "dedup-ckpt")
    s = _source(spark, source, schema, max_bytes)
    if delay is None:
        d = s.dropDuplicates(list(keys))
    else:
        s = s.withColumn("_et", F.col(event_time).cast("timestamp")).withWatermark("_et", delay)
        d = s.dropDuplicatesWithinWatermark(list(keys)).drop("_et")
    q = (d.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)


def stream_counts(spark: SparkSession, source: str, schema: T.StructType, event_time: str,
                  window: str = "1 day", sink: str | None = None, checkpoint: str | None = None,
                  max_bytes: int = BYTES_PER_TRIGGER) -> DataFrame:
    """Tumbling-window row counts, maintained incrementally in state.

    Complete mode keeps every window current (the last one included); each
    micro-batch publishes the small result as the table's next version
    (``sources.ledger``): readers have the one before until it stands.
    """
    sink = sink or scratch_path(spark, "counts-sink")
    checkpoint = checkpoint or scratch_path(spark, "counts-ckpt")
    s = _source(spark, source, schema, max_bytes)
    # windows over the wall-clock (timestamp_ntz) column: boundaries do not
    # depend on the session time zone
    agg = (s.groupBy(F.window(F.col(event_time), window).alias("w"))
           .agg(F.count(F.lit(1)).alias("count"))
           .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "count"))

    def write(batch: DataFrame, epoch: int) -> None:
        ledger.publish(batch, sink, epoch)

    q = (agg.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return ledger.read_version(spark, sink, agg.schema)
