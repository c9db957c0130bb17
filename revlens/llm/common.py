"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def stored(spark: SparkSession, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: the cut in the lineage survives lost executors, and every later use
    reads files instead of computing again."""
    path = scratch_path(spark, name)
    w = df.write.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(id_col: str, text_col: str):
    """Two 64-bit hashes of (id, text), never null: rows that share an id but not a text stay apart, and joins on
    the key need no null-safe comparison."""
    i, t = F.col(id_col), F.col(text_col)
    return F.xxhash64(i, t).alias("k1"), F.xxhash64(F.lit(7), t, i).alias("k2")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def worker_state(key, make):
    """One value per key and Python worker process, kept between tasks.

    The package is shipped to workers by value, so its module globals are new
    in every task; the values live in a module entry of the process instead.
    """
    holder = sys.modules.setdefault("_revlens_worker_state", types.ModuleType("_revlens_worker_state"))
    values = holder.__dict__.setdefault("values", {})
    if key not in values:
        values[key] = make()
    return values[key]


def forget_state(name: str):
    """Drops the values of this worker process whose keys begin with ``name``."""
    values = getattr(sys.modules.get("_revlens_worker_state"), "values", {})
    for key in [k for k in values if k[0] == name]:
        del values[key]


def text_slices(sizes, limit: int):
    """Ranges of consecutive texts whose sizes add up to ``limit`` at most; a
    longer text is a range of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def zip_texts(*passed: str, text: str = "text", keep_null: bool = False):
    """mapInArrow function: column ``text`` becomes ``z``, its UTF-8 bytes compressed (null: of the empty text, or null
    with ``keep_null``); the ``passed`` columns stay. Texts cross exchanges in this form."""
    def run(batches):
        import pyarrow as pa
        import zstandard
        c = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for b in batches:
            z = pa.array([None if t is None and keep_null else c.compress((t or "").encode())
                          for t in b.column(text).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(p) for p in passed), z], names=[*passed, "z"])
    return run


def unzip_texts(column) -> list[bytes]:
    import zstandard
    d = zstandard.ZstdDecompressor()
    return [None if z is None else d.decompress(z) for z in column.to_pylist()]


BATCH_BYTES = 4 << 20     # text or compressed data that a worker takes up at once


def batch_slices(batches, column: str, limit: int = BATCH_BYTES):
    """Arrow batches cut so that ``column`` holds about ``limit`` bytes in each; empty batches are left out."""
    import numpy as np
    import pyarrow.compute as pc
    for b in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0))
        for start, stop in text_slices(sizes.tolist(), limit):
            yield b.slice(start, stop - start)


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], total: int, share: int = 1000) -> DataFrame:
    """``rows`` (``total`` of them) with the columns of ``keys``, which holds one row per key and in ``n`` how many rows
    have it. Keys with more than a ``share``-th of all rows, ``share`` of them at most, come by broadcast; of the others
    none makes a task much larger than the rest. No column of ``on`` is null."""
    limit = max(total // share, 1)
    hot, rest = F.broadcast(keys.where(F.col("n") > limit)), keys.where(F.col("n") <= limit)
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(rest, on))
