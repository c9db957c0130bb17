"""CSV files with quoted line breaks, read by many tasks, and types inferred from all rows (§2.1).

Whether a line end ends a record depends on whether a quote is open there, and that on everything before it. Each line
is a map from one bit to one bit (quote open before it, quote open behind it), maps can be put together, and so can
those of the splits of a file:

1. every split puts its lines' maps together: one row per split, and no text leaves the JVM;
2. an exclusive prefix over the rows of a file gives the bit at the beginning of each split;
3. every split cuts its lines into records; what is left open at its border is put together with the pieces in the
   splits behind it, two pieces per split at most.

A quote opens a field only at its beginning, and a doubled quote stands for one, as in Spark's own reader with
``multiLine``, which reads a file as one split.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shape import join_small
from ..session import scratch_path
from .files import _CSV_OPTS, NA_TOKENS, _bind, _reader

# After doubled quotes are taken out: fields and their commas, then a quote that nothing closes. Possessive throughout:
# no field is tried twice, and the matcher loops instead of recursing.
_OPEN = r'(?:(?:"[^"]*+"[^,]*+|[^",][^,]*+|),)*+"[^"]*+$'
_FROM_CLOSED = "^" + _OPEN
_FROM_OPEN = r'^(?:[^"]*+$|[^"]*+"[^,]*+,' + _OPEN + ")"

MAX_BROADCAST_SPLITS = 500_000


def open_behind(to0: np.ndarray, to1: np.ndarray, state: bool) -> np.ndarray:
    """Per line whether a quote is open behind it, from the lines' maps and the bit before the first."""
    at = np.arange(len(to0))
    last = np.maximum.accumulate(np.where(to0 == to1, at, -1))       # the last line that leaves no doubt
    swaps = np.cumsum(to0 & ~to1)
    known = np.where(last >= 0, to0[last], state)
    return known ^ ((swaps - np.where(last >= 0, swaps[last], 0)) & 1).astype(bool)


def _bits(batch, name) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(bool)


def _runs(files, starts):
    """(begin, end) of consecutive rows with the same file and split."""
    f = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    s = starts.to_numpy(zero_copy_only=False)
    edges = np.flatnonzero((np.diff(f) != 0) | (np.diff(s) != 0)) + 1
    return zip([0, *edges.tolist()], [*edges.tolist(), len(f)])


def _split_maps(batches):
    """Per split: the bit behind it and whether a record ends in it, for either bit before it."""
    held: dict[tuple, list] = {}
    for b in batches:
        to0, to1 = _bits(b, "to0"), _bits(b, "to1")
        for i, j in _runs(b.column("f"), b.column("s")) if b.num_rows else ():
            key = b.column("f")[i].as_py(), b.column("s")[i].as_py()
            if key not in held and len(held) > 1000:
                yield _map_batch(held)
                held = {}
            now = held.setdefault(key, [False, True, False])
            for k in (0, 1):
                behind = open_behind(to0[i:j], to1[i:j], now[k])
                if k:
                    now[2] |= not behind.all()
                now[k] = bool(behind[-1])
    yield _map_batch(held)


def _map_batch(held):
    rows = [(*k, *v) for k, v in held.items()]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                      names=["f", "s", "to0", "to1", "ends"])


def split_states(maps: DataFrame) -> DataFrame:
    """f, s, entry (whether a quote is open before the split), origin (split in which the record open there began).

    ``maps`` holds a row per split; a file's rows are put in order and run through once, bounded by its splits."""
    one = F.sort_array(F.collect_list(F.struct("s", "to0", "to1", "ends")))
    start = F.struct(F.lit(False).alias("open"), F.lit(-1).cast("long").alias("origin"),
                     F.array().cast("array<struct<s:bigint,entry:boolean,origin:bigint>>").alias("out"))

    def step(a, m):
        # what is open behind a split began in it, unless it was open before and nothing ended
        began = F.when(a["open"] & ~m["ends"], a["origin"]).otherwise(m["s"])
        return F.struct(F.when(a["open"], m["to1"]).otherwise(m["to0"]).alias("open"), began.alias("origin"),
                        F.concat(a["out"], F.array(F.struct(m["s"].alias("s"), a["open"].alias("entry"),
                                                            a["origin"].alias("origin")))).alias("out"))

    return (maps.groupBy("f").agg(F.aggregate(one, start, step)["out"].alias("o"))
            .select("f", F.inline("o")))


def _records(batches):
    """Lines of splits in order -> records (piece 0) and pieces of records that cross a border: ``origin`` is the split
    in which such a record began."""
    now, state, first, origin, seq, pending = None, False, False, -1, 0, []

    def emit(texts, kinds, origins, seqs):
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]] * n, pa.string()), pa.array([now[1]] * n, pa.int64()), pa.array(seqs, pa.int64()),
             pa.array(kinds, pa.bool_()), pa.array(origins, pa.int64()),
             texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())],
            names=["f", "s", "seq", "whole", "origin", "text"])

    def close():
        """The piece that stays open at the end of a split."""
        if pending:
            text = pc.binary_join(pa.ListArray.from_arrays([0, len(joined := pa.concat_arrays(pending))], joined), "\n")
            yield emit(text, [False], [origin if first else now[1]], [seq])

    for b in batches:
        to0, to1, lines = _bits(b, "to0"), _bits(b, "to1"), b.column("value")
        entry, origins = _bits(b, "entry"), b.column("origin")
        for i, j in _runs(b.column("f"), b.column("s")) if b.num_rows else ():
            key = b.column("f")[i].as_py(), b.column("s")[i].as_py()
            if key != now:
                yield from close()
                now, state, origin, seq, pending = key, bool(entry[i]), origins[i].as_py(), 0, []
                first = state                      # the first record of the split began before it
            behind = open_behind(to0[i:j], to1[i:j], state)
            ends = np.flatnonzero(~behind) + 1     # a record ends behind each of these lines
            own = pa.concat_arrays([*pending, lines.slice(i, j - i)])
            before = len(own) - (j - i)
            state = bool(behind[-1])
            if len(ends):
                edges = np.concatenate([[0], ends + before])
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), own.slice(0, int(edges[-1]))), "\n")
                n = len(texts)
                whole = np.ones(n, bool)
                whole[0] = not first
                yield emit(texts, whole, np.where(whole, now[1], origin), np.arange(seq, seq + n))
                seq, first = seq + n, False
                own = own.slice(int(edges[-1]))
            pending = [own] if len(own) else []
    if now:
        yield from close()


@contextmanager
def _fixed_splits(spark: SparkSession):
    """Both passes must cut the files alike, also where executors come and go between them."""
    key = "spark.sql.files.minPartitionNum"
    given = spark.conf.get(key, None)
    if given is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if given is None:
            spark.conf.unset(key)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """f, s, seq (file, split and place where a record begins) and text: the records of CSV files, quoted line breaks
    inside them, each file read in as many splits as Spark makes of it."""
    bare = F.replace("value", F.lit('""'), F.lit(""))
    with _fixed_splits(spark):
        return _csv_records(spark, path, bare)


def _csv_records(spark: SparkSession, path: str, bare: Column) -> DataFrame:
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"),
                     bare.rlike(_FROM_CLOSED).alias("to0"), bare.rlike(_FROM_OPEN).alias("to1")))
    maps = lines.select("f", "s", "to0", "to1").mapInArrow(
        _split_maps, "f string, s long, to0 boolean, to1 boolean, ends boolean")
    path_maps = scratch_path(spark, "csv-splits")
    maps.write.parquet(path_maps)
    maps = spark.read.schema(maps.schema).parquet(path_maps)
    states = split_states(maps)
    if maps.count() <= MAX_BROADCAST_SPLITS:
        joined = lines.join(F.broadcast(states), ["f", "s"], "left")
    else:
        joined = (lines.withColumn("at", F.monotonically_increasing_id()).join(states, ["f", "s"], "left")
                  .sortWithinPartitions("f", "s", "at"))
    unknown = F.raise_error(F.lit("a file was cut otherwise by the second pass")).cast("boolean")
    pieces = joined.select("value", "f", "s", "to0", "to1", F.coalesce("entry", unknown).alias("entry"), "origin").mapInArrow(
        _records, "f string, s long, seq long, whole boolean, origin long, text string")
    path_pieces = scratch_path(spark, "csv-records")
    pieces.write.option("compression", "zstd").parquet(path_pieces)
    pieces = spark.read.schema(pieces.schema).parquet(path_pieces)
    parts = F.sort_array(F.collect_list(F.struct("s", "text", "seq")))
    # the piece in the split where a record begins has the record's place
    across = (pieces.where("not whole").groupBy("f", "origin").agg(parts.alias("p"))
              .select("f", F.col("origin").alias("s"), F.col("p")[0]["seq"].alias("seq"),
                      F.array_join(F.col("p.text"), "\n").alias("text")))
    return pieces.where("whole").select("f", "s", "seq", "text").unionByName(across)


def _text_columns(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files as columns of text, named by the header."""
    names = _reader(spark).option("inferSchema", "false").csv(path).columns
    records = csv_records(spark, path).where(F.trim("text", F.lit("\r")) != "")
    header = (records.groupBy("f").agg(F.min(F.struct("s", "seq", "text")).alias("h"))
              .select("f", F.col("h.s").alias("hs"), F.col("h.seq").alias("hseq"),
                      F.element_at(F.split("h.text", "\n"), 1).endswith("\r").alias("crlf")))
    # where a file's first line ends with carriage return and line feed, those two are a line end, in quotes too
    unix = F.when(F.col("crlf"), F.replace("text", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text"))
    body = (join_small(records, header, on="f").where("not (s = hs and seq = hseq)")
            .select(F.regexp_replace(unix, r"\r\z", "").alias("text")))
    plain = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    options = {k: v for k, v in _CSV_OPTS.items() if k != "header"}
    row = F.from_csv("text", plain.simpleString()[len("struct<"):-1].replace(":", " "), options).alias("r")
    return body.select(row).select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


def scan_csv_split(spark: SparkSession, path: str, schema: T.StructType | None = None,
                   na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """``scan_csv`` with large files read by many tasks, quoted line breaks and all. Lines end with a line feed or with
    carriage return and line feed; a compressed file is one split."""
    return _bind(_text_columns(spark, path), schema, na_tokens)


# ------------------------------------------------------------------ types

BOOL, LONG, DOUBLE, TIME = 1, 2, 4, 8
_NUMBER = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
_TIME = r"^\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?$"


def _unfit(value: Column) -> Column:
    """The types that a text is not a value of, as bits; 0 for NULL, which is a value of all."""
    def bit(fits, b):
        return F.when(fits, 0).otherwise(b)
    return F.when(value.isNull(), 0).otherwise(
        bit(value.isin("True", "TRUE", "true", "False", "FALSE", "false"), BOOL)
        + bit(value.rlike(r"^\s*[+-]?\d+\s*$") & value.try_cast("long").isNotNull(), LONG)
        + bit(value.rlike(_NUMBER), DOUBLE)
        + bit(value.rlike(_TIME) & value.try_cast("timestamp_ntz").isNotNull(), TIME))


def infer_types(text: DataFrame, na_tokens: Sequence[str] = NA_TOKENS) -> T.StructType:
    """The narrowest type of every text column that all of its values have, missing ones aside.

    Types form a lattice: none (no value at all) below boolean, long and timestamp, long below double, all below text.
    A value rules types out, and what a column's values rule out is their union: one aggregate (``bit_or``) over all
    rows and columns, merged in any order. A column without a value is text."""
    cells = [F.col(f"`{c}`") for c in text.columns]
    if na_tokens:
        cells = [F.when(~c.isin(list(na_tokens)), c) for c in cells]
    out = text.agg(*[F.bit_or(_unfit(c)).alias(f"u{i}") for i, c in enumerate(cells)],
                   *[F.bool_or(c.isNotNull()).alias(f"v{i}") for i, c in enumerate(cells)]).first()
    fields = []
    for i, name in enumerate(text.columns):
        unfit = out[f"u{i}"] if out[f"v{i}"] else BOOL | LONG | DOUBLE | TIME
        kinds = ((BOOL, T.BooleanType()), (LONG, T.LongType()), (DOUBLE, T.DoubleType()), (TIME, T.TimestampNTZType()))
        fields.append(T.StructField(name, next((t for b, t in kinds if not unfit & b), T.StringType())))
    return T.StructType(fields)


def scan_csv_inferred(spark: SparkSession, path: str, na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Headered CSV read in splits, its columns typed by all of their values."""
    text = _text_columns(spark, path)
    return _bind(text, infer_types(text, na_tokens), na_tokens)
