"""The earliest row of every key of a stream, with state that forgets by event time (§2.10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..session import scratch_path
from .ingest import BYTES_PER_TRIGGER, _source

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# A row behind all others: what ends a replay carries the watermark past every timer.
FAR_MICROS = 253_370_764_800_000_000
# Times keep their microseconds on the way through the state.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class KeepFirst(StatefulProcessor):
    """Holds the first row (by time, then by the whole row as JSON) of a key until the watermark is ``delay`` past it,
    gives it out, and forgets the key. While a key is held no other row of it comes out."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle):
        self.handle = handle
        self.first = handle.getValueState("first", "micros long, row string")

    def handleInputRows(self, key, rows, timerValues):
        now = self.first.get() if self.first.exists() else None
        best = min((r._micros, r._row) for r in rows)
        if now is None:
            # one timer per key: what comes earlier later on does not shorten the time that late rows are waited for
            self.handle.registerTimer(best[0] // 1000 + self.delay_ms)
            self.first.update(best)
        elif best < (now[0], now[1]):
            self.first.update(best)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.first.exists():
            micros, row = self.first.get()
            self.first.clear()
            from pyspark.sql import Row
            yield Row(_micros=micros, _row=row)

    def close(self):
        pass


def stream_keep_first(spark: SparkSession, source: str, schema: T.StructType, keys: Sequence[str], event_time: str,
                      delay: str = "1 day", finish: bool = True, sink: str | None = None, checkpoint: str | None = None,
                      max_bytes: int = BYTES_PER_TRIGGER) -> DataFrame:
    """One row per key, the one with the smallest ``event_time`` (of equal times the least row as JSON).

    Rows may come out of order by up to ``delay`` of event time: a key is held that long behind its first row, in a
    RocksDB state store on the executors' disks, and forgotten with its row given out; rows later than the watermark
    are dropped by Spark. A row that comes more than ``delay`` of event time behind the first one of its key begins a
    key of its own. NULL keys are keys; rows without a time are left out.

    ``finish`` ends a bounded replay: a last row that belongs to no key carries the watermark past all timers. Leave it
    out for a stream that goes on; the same ``checkpoint`` and ``sink`` continue it.
    """
    sink, checkpoint = sink or scratch_path(spark, "first-sink"), checkpoint or scratch_path(spark, "first-ckpt")
    ms = spark.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + interval {delay})").first()[0]
    names = [f.name for f in schema.fields]
    end = f"{checkpoint.rstrip('/')}-end"            # beside the checkpoint, so that a restart reads the same folder
    empty = spark.createDataFrame([], schema).withColumns({"_end": F.lit(True)})
    empty.write.mode("append").parquet(end)
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, ROCKSDB)
    try:
        def run():
            rows = _source(spark, source, schema, max_bytes).withColumn("_end", F.lit(False))
            ends = spark.readStream.schema(empty.schema).parquet(end)
            time = F.when(F.col("_end"), F.timestamp_micros(F.lit(FAR_MICROS))).otherwise(F.col(event_time).cast("timestamp"))
            s = (rows.unionByName(ends).withColumn("_t", time).where("_t is not null").withWatermark("_t", delay)
                 .select("_t", F.unix_micros("_t").alias("_micros"), F.to_json(F.struct(*names), _JSON).alias("_row"),
                         F.to_json(F.struct("_end", *keys), _JSON).alias("_key")))
            out = s.groupBy("_key").transformWithState(
                statefulProcessor=KeepFirst(ms), outputStructType="_micros long, _row string", outputMode="Append",
                timeMode="EventTime")
            fields = out.where(F.col("_micros") < FAR_MICROS).select(F.from_json("_row", schema, _JSON).alias("r")).select("r.*")
            q = (fields.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
                 .outputMode("append").trigger(availableNow=True).start())
            q.awaitTermination()
            return q

        q = run()
        if finish:
            spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields],
                                  F.lit(True).alias("_end")).write.mode("append").parquet(end)
            q = run()
    finally:
        if before is None:
            spark.conf.unset(conf)
        else:
            spark.conf.set(conf, before)
    got = spark.read.schema(schema).parquet(sink)
    got.last_progress = q.lastProgress            # what the state held in the last batch
    return got
