"""Token ids on disk: canonical length-limited Huffman codes in independent blocks (operator 10).

File format, a folder of Parquet data that Spark writes and reads:

* ``codes``  : ``token int, bits int`` — code length of every id that occurs. The codes are canonical: counted up in
  order of (bits, token), so the lengths are the whole code book.
* ``blocks`` : one row per block of whole documents, about ``BLOCK_IDS`` ids each: ``start`` (ids of the file before
  it), ``n_ids``, ``doc_ids`` and ``doc_lens`` in order, ``payload`` (big-endian bit stream) and ``marks`` (bit offset
  of every ``MARK_IDS``-th id). Blocks decode on their own; inside a block, decoding can begin at any mark.

Documents stand in ascending id order (null ids first, equal ids by text hash).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..session import scratch_path
from .common import batch_slices, worker_state
from .tokens import default_tokenizer, encoder

BLOCK_IDS = 1 << 16
MARK_IDS = 1 << 9
BATCH_TEXT = 16 << 20    # text taken up at once, per task
RUN_BYTES = 1 << 14      # new pieces of texts go to the library joined to texts of about this size
MAX_BITS = 18            # longest code; raised when a vocabulary needs more

ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()),
                        T.StructField("seq", T.LongType()), T.StructField("before", T.LongType()),
                        T.StructField("n_ids", T.LongType()), T.StructField("ids", T.BinaryType()),
                        T.StructField("counts", T.BinaryType())])
BLOCKS = T.StructType([T.StructField("start", T.LongType()), T.StructField("n_ids", T.LongType()),
                       T.StructField("doc_ids", T.ArrayType(T.LongType())),
                       T.StructField("doc_lens", T.ArrayType(T.LongType())),
                       T.StructField("payload", T.BinaryType()), T.StructField("marks", T.ArrayType(T.LongType()))])


# ---------------------------------------------------------------- code book

def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for positive counts (package-merge). One symbol gets one bit."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    max_bits = max(max_bits, int(n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    # every level: the leaves merged with the pairs of the level below, as (weight, leaves among the first k items)
    levels, weights = [], leaves
    is_leaf = np.ones(n, bool)
    levels.append(is_leaf)
    for _ in range(max_bits - 1):
        pairs = weights[:len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        w = np.concatenate([leaves, pairs])
        o = np.argsort(w, kind="stable")
        weights = w[o]
        levels.append(o < n)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2                             # items taken from the topmost level
    for is_leaf in reversed(levels):
        k = int(is_leaf[:take].sum())
        lengths[:k] += 1                         # the k lightest leaves
        take = 2 * (take - k)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class CodeBook:
    """Canonical codes and the decoding table for (token, bits) in order of (bits, token)."""

    def __init__(self, tokens: np.ndarray, bits: np.ndarray):
        order = np.lexsort((tokens, bits))
        self.tokens, self.bits = tokens[order].astype(np.int64), bits[order].astype(np.int64)
        self.max_bits = int(self.bits[-1]) if len(self.bits) else 1
        step = np.left_shift(1, self.max_bits - self.bits)
        left = np.cumsum(step) - step            # codes as prefixes of max_bits bits
        size = int(self.tokens.max()) + 1 if len(self.tokens) else 1
        self.code_of, self.len_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code_of[self.tokens] = (left >> (self.max_bits - self.bits)).astype(np.uint64)
        self.len_of[self.tokens] = self.bits
        entries = (self.tokens << 6) | self.bits
        self.table = np.repeat(entries, step)
        if len(self.table) < 1 << self.max_bits:  # a one-symbol book leaves half the table unused
            self.table = np.resize(self.table, 1 << self.max_bits) if len(self.table) else np.ones(2, np.int64)

    def pack(self, ids: np.ndarray):
        """(payload bytes, bit offset of every MARK_IDS-th id)."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        lens = self.len_of[ids]
        ends = np.cumsum(lens)
        pos = ends - lens
        word, off = pos >> 5, pos & 31
        wide = self.code_of[ids] << (64 - off - lens).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))     # a code is shorter than a word: each word begins a code
        out = np.zeros((int(ends[-1]) + 31 >> 5) + 1, np.uint64)
        out[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes()[:int(ends[-1]) + 7 >> 3], pos[::MARK_IDS]

    def unpack(self, payloads: list[bytes], marks: list[np.ndarray], counts: list[int]) -> list[np.ndarray]:
        """Ids of several blocks; all stretches between marks are decoded side by side, one table look-up a step."""
        words, at, length, base = [], [], [], 0
        for p, m, n in zip(payloads, marks, counts):
            w = np.frombuffer(p + b"\0" * (8 + -len(p) % 4), ">u4").astype(np.uint64)
            words.append(w)
            at.append(np.asarray(m, np.int64) + base * 32)
            length.append(np.minimum(MARK_IDS, n - MARK_IDS * np.arange(len(m))))
            base += len(w)
        if not base:
            return [np.zeros(0, np.int64) for _ in payloads]
        words = np.concatenate(words)
        windows = (words << np.uint64(32)) | np.append(words[1:], np.uint64(0))
        pos, length = np.concatenate(at), np.concatenate(length)
        order = np.argsort(-length, kind="stable")
        pos, left = pos[order], length[order]
        out = np.zeros((len(pos), MARK_IDS), np.int64)
        room, mask = 64 - self.max_bits, np.uint64((1 << self.max_bits) - 1)
        for k in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -k, "left"))     # stretches longer than k
            pos = pos[:live]
            got = self.table[((windows[pos >> 5] >> (room - (pos & 31)).astype(np.uint64)) & mask).astype(np.int64)]
            out[:live, k] = got >> 6
            pos = pos + (got & 63)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        out, lanes, result = out[back], 0, []
        for m, n in zip(marks, counts):
            result.append(out[lanes:lanes + len(m)].reshape(-1)[:n])
            lanes += len(m)
        return result


# ---------------------------------------------------------------- writing

def _encode(tokenizer: str, eos: int | None):
    """A row per document, and a last row per task (seq -1) with how often the task met each id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        enc = encoder(tokenizer, RUN_BYTES)
        counts = np.zeros(max(enc.tok.get_vocab_size(), (eos or 0) + 1), np.int64)
        for b in batch_slices(batches, "text", BATCH_TEXT):
            ids, ends = enc.encode(b.column("text"))
            counts += np.bincount(ids, minlength=len(counts))
            if eos is not None:
                counts[eos] += b.num_rows
            rows = []
            for i in range(b.num_rows):
                own = ids[ends[i]:ends[i + 1]]
                rows.append(own.tobytes() if eos is None else np.append(own, enc.dtype(eos)).tobytes())
            n = np.diff(ends) + (eos is not None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(seq + np.arange(len(n))),
                 pa.array(before + np.cumsum(n) - n), pa.array(n), pa.array(rows, pa.binary()),
                 pa.nulls(len(n), pa.binary())], names=ENCODED.names)
            seq, before = seq + len(n), before + int(n.sum())
        if seq:
            yield pa.RecordBatch.from_arrays(
                [pa.array([None], pa.int64()), pa.array([part], pa.int32()), pa.array([-1], pa.int64()),
                 pa.array([before], pa.int64()), pa.array([0], pa.int64()), pa.array([None], pa.binary()),
                 pa.array([counts.tobytes()], pa.binary())], names=ENCODED.names)
    return run


def _dtype(tokenizer: str):
    return encoder(tokenizer, RUN_BYTES).dtype


def _add_counts(batches):
    total = np.zeros(0, np.int64)
    for b in batches:
        for raw in b.column("counts").to_pylist():
            got = np.frombuffer(raw, np.int64)
            total = got + total if len(total) else got
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["token", "n"])


def _blocks(tokenizer: str, tokens: np.ndarray, bits: np.ndarray):
    def run(batches):
        dtype, book = _dtype(tokenizer), CodeBook(tokens, bits)

        def block(docs, lens, ids, start):
            payload, marks = book.pack(np.concatenate(ids) if ids else np.zeros(0, dtype))
            return {"start": start, "n_ids": sum(lens), "doc_ids": docs, "doc_lens": lens, "payload": payload,
                    "marks": marks.tolist()}

        docs, lens, ids, start, size = [], [], [], None, 0
        schema = pa.schema([("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                            ("doc_lens", pa.list_(pa.int64())), ("payload", pa.binary()),
                            ("marks", pa.list_(pa.int64()))])
        last = None
        for b in batches:
            out = []
            cols = [b.column(c).to_pylist() for c in ("doc_id", "part", "start", "n_ids", "ids")]
            for doc, part, at, n, raw in zip(*cols):
                # a reader may join the pieces of several files in one task: a block ends where the run of ids does
                if docs and (size >= BLOCK_IDS or last != (part, at)):
                    out.append(block(docs, lens, ids, start))
                    docs, lens, ids, size = [], [], [], 0
                if not docs:
                    start = at
                docs.append(doc)
                lens.append(n)
                ids.append(np.frombuffer(raw, dtype))
                size, last = size + n, (part, at + n)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if docs:
            yield pa.RecordBatch.from_pylist([block(docs, lens, ids, start)], schema)
    return run


def write_token_file(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id",
                     text_col: str = "text", eos: int | None = 2) -> None:
    """Encode every text and write the token file to ``path``.

    Null texts are empty; every document ends with ``eos`` unless that is None. Texts cross the one exchange, a range
    exchange by id; the ids that the sorted partitions give are counted on the way, stored once, and coded from
    there. To the driver come one count per vocabulary entry and one total per partition. An empty table gives a file
    of no blocks; rows that share an id are documents of their own.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"),
                      F.col(text_col).alias("text"))
    # no Python before the exchange: Spark runs what stands there twice, once to find the bounds of the ranges
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = src.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    stage_path = scratch_path(spark, "token-ids")
    staged.mapInArrow(_encode(tokenizer, eos), ENCODED).write.option("compression", "zstd").parquet(stage_path)
    staged = spark.read.schema(ENCODED).parquet(stage_path)
    enc = staged.where("seq >= 0")

    counts = (staged.select("counts").where("counts is not null").mapInArrow(_add_counts, "token int, n long")
              .groupBy("token").agg(F.sum("n").alias("n")).toPandas().sort_values("token"))   # vocabulary-sized
    tokens = counts["token"].to_numpy(np.int64)
    bits = code_lengths(counts["n"].to_numpy(np.int64))
    spark.createDataFrame([(int(t), int(b)) for t, b in zip(tokens, bits)], "token int, bits int") \
        .coalesce(1).write.parquet(f"{path}/codes")

    totals = enc.groupBy("part").agg(F.sum("n_ids").alias("total"))      # a row per range partition
    base = totals.select("part", (F.sum("total").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    placed = (enc.join(F.broadcast(base), "part")
              .select("doc_id", "part", (F.col("base") + F.col("before")).alias("start"), "n_ids", "ids"))
    placed.mapInArrow(_blocks(tokenizer, tokens, bits), BLOCKS).write.option("compression", "none") \
        .parquet(f"{path}/blocks")


# ---------------------------------------------------------------- reading

DECODE_IDS = 1 << 22      # ids decoded side by side


def _read(tokens: np.ndarray, bits: np.ndarray, with_ids: bool):
    def run(batches):
        book = worker_state(("codes", hash(tokens.tobytes()), hash(bits.tobytes())), lambda: CodeBook(tokens, bits))

        def rows(group):
            got = book.unpack([g["payload"] for g in group], [np.asarray(g["marks"], np.int64) for g in group],
                              [g["n_ids"] for g in group])
            doc, start, size, crc, raw = [], [], [], [], []
            for g, ids in zip(group, got):
                data = memoryview(ids.astype("<u4").tobytes())
                at = 0
                for d, n in zip(g["doc_ids"], g["doc_lens"]):
                    doc.append(d)
                    start.append(g["start"] + at)
                    size.append(n)
                    crc.append(zlib.crc32(data[4 * at:4 * (at + n)]))
                    if with_ids:
                        raw.append(ids[at:at + n].astype(np.int32))
                    at += n
            arrays = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                      pa.array(crc, pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(raw, pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        group, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                g = {c: b.column(c)[i].as_py() for c in BLOCKS.names}
                if group and size + g["n_ids"] > DECODE_IDS:
                    yield rows(group)
                    group, size = [], 0
                group.append(g)
                size += g["n_ids"]
        if group:
            yield rows(group)
    return run


def read_token_file(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of a token file: doc_id, start, n_tokens, ids_crc32 (over little-endian 32-bit ids) and,
    with ``with_ids``, the ids."""
    codes = spark.read.schema("token int, bits int").parquet(f"{path}/codes").toPandas()   # vocabulary-sized
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return blocks.mapInArrow(_read(codes["token"].to_numpy(np.int64), codes["bits"].to_numpy(np.int64), with_ids), out)


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 10 over all of ``documents``: written in id order with id 2 after each, read back."""
    path = scratch_path(spark, "token-file")
    write_token_file(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_file(spark, path, with_ids=False)
