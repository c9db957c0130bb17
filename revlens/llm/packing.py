"""Best-fit packing by minimum bin slack (operator 4).

Documents become pieces of at most ``capacity`` tokens; only their lengths decide the packing, and there are at most
``capacity`` different lengths, so the plan is made on the length histogram, whose size does not grow with the data.
For each bin the longest length left is set first and a subset-sum program over the lengths left (a bitset of
reachable sums per length) finds the fullest feasible combination to go with it. That combination is removed as often
as the counts allow: the next bins would find the same one. Every round uses up a length, so there are at most a few
thousand rounds however many bins they stand for. Pieces then look up their places by their rank among the pieces of
their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_slices, fresh, stored
from .tokens import default_tokenizer, encoder

CAPACITY = 2048
END_ID = 0
BATCH_TEXT = 16 << 20     # text taken up at once, per task
SLICE_BYTES = 4 << 20     # text whose pieces are looked up at once
RANK_ROWS = 50_000        # pieces ranked in one sort


def _fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The combination of available lengths (each at most as often as it is left) with the largest sum up to ``room``.
    Bit s of a bitset is set when sum s is reachable; one bitset per item is kept to trace the combination back."""
    mask = (1 << room + 1) - 1
    reach, steps = 1, []
    for n in lengths:                             # longest first
        if n > room:
            continue
        left, lot = min(counts[n], room // n), 1
        while left > 0:                           # copies in binary lots
            k = min(lot, left)
            steps.append((n, k, reach))
            reach |= reach << n * k & mask
            left, lot = left - k, lot * 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    best, out = reach.bit_length() - 1, []
    for n, k, before in reversed(steps):
        if not before >> best & 1:                # needed to reach this sum
            out += [n] * k
            best -= n * k
    return out


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """[(how many bins, {length: copies in each})] that together use up the histogram."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    plan = []
    for first in sorted(counts, reverse=True):
        while counts.get(first, 0):
            counts[first] -= 1
            lengths = [n for n in sorted(counts, reverse=True) if counts[n]]
            bin_ = [first, *_fullest(lengths, counts, capacity - first)]
            counts[first] += 1
            need: dict[int, int] = {}
            for n in bin_:
                need[n] = need.get(n, 0) + 1
            times = min(counts[n] // k for n, k in need.items())
            for n, k in need.items():
                counts[n] -= k * times
            plan.append((times, need))
    return plan


def plan_rows(plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, copies per bin, offset of the first copy, number of the first bin)."""
    rows, used, first_bin = [], {}, 0
    for times, need in plan:
        offset = 0
        for n, k in sorted(need.items(), reverse=True):
            at = used.get(n, 0)
            rows.append((n, at, at + k * times, k, offset, first_bin))
            used[n] = at + k * times
            offset += n * k
        first_bin += times
    return rows


def _pieces(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batch_slices(batches, "text", BATCH_TEXT):
            ids, ends = enc.encode(b.column("text"), SLICE_BYTES)
            doc, piece, start, size, crc = [], [], [], [], []
            for i, d in enumerate(b.column("doc_id").to_pylist()):
                own = np.append(ids[ends[i]:ends[i + 1]], enc.dtype(end_id)).astype("<u4")
                data, at = memoryview(own.tobytes()), 0
                stop = len(own) % capacity or min(capacity, len(own))
                k = 0
                while at < len(own):
                    doc.append(d)
                    piece.append(k)
                    start.append(at)
                    size.append(stop - at)
                    crc.append(zlib.crc32(data[4 * at:4 * stop]))
                    at, stop, k = stop, stop + capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise every text (null: empty), end it with ``end_id`` and cut what is longer than ``capacity``: the first
    piece takes the remainder, all others are full. One row per piece; rows that share an id give pieces each."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _pieces(tokenizer or default_tokenizer(), capacity, end_id),
        "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length", order_cols=("doc_id", "piece")):
    """Place every row of ``pieces`` (lengths 1 to ``capacity``): adds ``sequence_id`` and ``offset`` (with an
    underscore where such a name is taken).

    ``pieces`` is read several times, so pass a stored table. Ranks among equal lengths are taken in hash buckets of
    about RANK_ROWS rows, whose sizes are added up, so a length that many pieces share is not one task's work. Equal
    rows take places of their own. An empty table stays empty. The plan that is broadcast has at most a few rows per
    pair of length and round, both bounded by ``capacity``.
    """
    spark = pieces.sparkSession
    hist = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}      # at most `capacity` rows
    if any(n is None or not 0 < n <= capacity for n in hist):
        raise ValueError("lengths must lie between 1 and the capacity")
    rows = plan_rows(plan_bins(hist, capacity))
    salts = max(1, -(-max(hist.values(), default=0) // RANK_ROWS))
    # plan rows are found by rank: a length's ranges lie end to end, numbered by where they begin
    plan = spark.createDataFrame(rows, "p_length long, r_from long, r_to long, copies long, first_offset long, "
                                       "first_bin long")
    # working names by position, so that no column of the caller's clashes with those made here
    names = [f"c{i}" for i in range(len(pieces.columns))]
    at = {c.lower(): n for n, c in zip(names, pieces.columns)}
    length, order = at[length_col.lower()], [at[c.lower()] for c in order_cols]
    salted = pieces.toDF(*names).withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(length, "salt").count()
    upto = Window.partitionBy(length).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(length).alias("s_length"), F.col("salt").alias("s_salt"),
                         F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("before"))
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy(length, "salt").orderBy(*order)) - 1)
    ranked = ranked.join(sizes, (F.col(length) == F.col("s_length")) & (F.col("salt") == F.col("s_salt"))) \
        .withColumn("rank", F.col("nth") + F.col("before"))
    placed = ranked.join(F.broadcast(plan), (F.col(length) == F.col("p_length")) & (F.col("rank") >= F.col("r_from"))
                         & (F.col("rank") < F.col("r_to")))
    nth = F.col("rank") - F.col("r_from")
    return placed.select(
        *names, (F.col("first_bin") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (nth % F.col("copies")) * F.col(length)).cast("long").alias("offset")) \
        .toDF(*pieces.columns, fresh(pieces, "sequence_id"), fresh(pieces, "offset"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 4 over all of ``documents``."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(stored(docs.sparkSession, cut_pieces(docs), "pieces"))
