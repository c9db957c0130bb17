"""Substring deduplication by sliding sentence spans (operator 5).

A text is cut into sentences; every run of several consecutive sentences is hashed, the hashes are joined over all
documents, and sentences covered by any span that is not its hash's first occurrence are removed.

* A sentence ends behind ``.``, ``!`` or ``?`` before white space, or at a line end. Every sentence is cut before the
  word with the smallest checksum (of equal ones the last) of each ``WINDOW`` consecutive words of it. Whether a word
  begins a piece depends on the ``WINDOW - 1`` words on either side alone, and no piece is longer than ``WINDOW``: two
  texts that share a passage, wherever in their sentences it begins and ends, cut it alike but for its first and last
  ``WINDOW - 1`` words. So any 50 words in common hold a whole span, and at least 25 of them are removed; up to
  ``2 * WINDOW - 2`` words may stay at either end. Words are compared in lower case with white space collapsed.
* A span is the shortest run that begins at a sentence and has ``RUN`` sentences and ``MIN_WORDS`` words, or
  ``LONG_WORDS`` words: a few one-word sentences that meet by chance are no repeat. Spans that end at a sentence are
  formed likewise, so a repeated passage is covered to both its ends.
* The first occurrence of a hash is the one in the document with the smallest id, and there the one nearest the
  beginning. Rows without an id come last. Rows that share an id, or have none, are documents of their own, in the order
  of their text's hash; of rows that are equal in both, all but one are copies and lose every sentence in a span.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_slices, fresh, row_key, stored, unzip_texts, zip_texts

RUN = 3
MIN_WORDS = 10
LONG_WORDS = 30
WINDOW = 7
LAST_ID = (1 << 63) - 1

_END = re.compile(r"[.!?]+(?=\s)|\n")
_WORD = re.compile(r"\S+")


def _cuts(words: list[str], edges: list[int]) -> np.ndarray:
    """Indices of the words that begin a piece inside a sentence; ``edges`` are the sentences' bounds in words."""
    if len(words) < WINDOW:
        return np.empty(0, np.int64)
    sums = np.fromiter((crc32(w.encode()) for w in words), np.int64, len(words))
    windows = np.lib.stride_tricks.sliding_window_view(sums, WINDOW)
    at = np.arange(len(windows))
    whole = np.searchsorted(edges, at, "right") == np.searchsorted(edges, at + WINDOW - 1, "right")
    return np.unique((at + WINDOW - 1 - windows[:, ::-1].argmin(1))[whole])


def sentences(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of every piece of a sentence; white space behind a piece belongs to it, and white
    space before the first one to that one."""
    words, at = text.lower().split(), [m.start() for m in _WORD.finditer(text)]
    if not words:
        return []
    # lower-casing never changes where the words are
    ends = np.unique(np.searchsorted(at, [*(m.end() for m in _END.finditer(text)), len(text)]))
    edges = [0, *ends[ends > 0].tolist()]
    first = np.union1d(edges, _cuts(words, edges)).astype(np.int64).tolist()
    digest = xxhash.xxh3_64_digest
    starts = [0, *(at[i] for i in first[1:-1]), len(text)]
    return [(a, b, j - i, digest(" ".join(words[i:j]).encode()))
            for i, j, a, b in zip(first, first[1:], starts, starts[1:])]


def spans(units) -> list[tuple[int, int]]:
    """(first, last) sentence of every span."""
    n, total = len(units), np.concatenate([[0], np.cumsum([u[2] for u in units], dtype=np.int64)])
    i = np.arange(n)

    def ending(words):                             # last sentence of the shortest run from each i with so many words
        return np.searchsorted(total, total[i] + words, "left") - 1

    def beginning(words):
        return np.searchsorted(total, total[i + 1] - words, "right") - 1

    last = np.minimum(np.maximum(ending(MIN_WORDS), i + RUN - 1), ending(LONG_WORDS))
    first = np.maximum(np.minimum(beginning(MIN_WORDS), i - RUN + 1), beginning(LONG_WORDS))
    forward = [(a, b) for a, b in zip(i.tolist(), last.tolist()) if b < n]
    known = set(forward)
    return forward + [(a, b) for a, b in zip(first.tolist(), i.tolist()) if a >= 0 and (a, b) not in known]


SPAN_ROWS = ("doc_id long, k1 long, k2 long, h1 array<long>, h2 array<int>, step array<int>, length array<int>, "
             "again array<boolean>")


def _span_rows(batches):
    """Per text the spans in order of their beginning: two hashes (96 bits), where each begins behind the one before
    it, its length, and whether the text held it before."""
    for batch in batch_slices(batches, "t"):
        offsets, hashes, a, b, again = [0], [], [], [], []
        for t in batch.column("t").to_pylist():
            units, seen, at = sentences(t or ""), set(), 0
            digests = b"".join(u[3] for u in units)
            for first, last in sorted(spans(units)) if units else ():
                d = xxhash.xxh3_128_digest(digests[8 * first:8 * last + 8])[:12]
                hashes.append(d)
                again.append(d in seen)
                seen.add(d)
                start = units[first][0]
                a.append(start - at)
                b.append(units[last][1] - start)
                at = start
            offsets.append(len(hashes))
        h = np.frombuffer(b"".join(hashes), np.dtype([("h1", ">i8"), ("h2", ">i4")]))
        values = (pa.array(h["h1"].astype(np.int64)), pa.array(h["h2"].astype(np.int32)), pa.array(a, pa.int32()),
                  pa.array(b, pa.int32()), pa.array(again, pa.bool_()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("doc_id", "k1", "k2")]
            + [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), v) for v in values],
            names=["doc_id", "k1", "k2", "h1", "h2", "step", "length", "again"])


BUCKET_SPANS = 1 << 21                # spans per bucket of hash prefixes, about
MIN_BUCKET_BITS, MAX_BUCKET_BITS = 5, 20
FLUSH = 1 << 21                       # spans that a task gathers before it sends them
MIN_BITS, MAX_BITS = 23, 28           # of the bit table, powers of two; 32 MB at most
BITS_PER_HASH = 8


def _planes(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as differences, their bytes by place: the high ones are nearly all zero."""
    import zstandard
    steps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _values(packed: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _by_bucket(bits: int):
    """Spans of texts -> one row per bucket and task: the 32 bits behind the prefix, once each, and which of them
    several texts of the task hold."""
    def flush(held):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
        rest = (h >> np.uint64(32 - bits)).astype(np.uint32)
        order, edges = np.unique(bucket, return_index=True)
        cuts = list(zip(edges.tolist(), [*edges[1:].tolist(), len(h)]))
        return pa.RecordBatch.from_arrays(
            [pa.array(order, pa.int32()), pa.array([_planes(rest[a:b]) for a, b in cuts], pa.binary()),
             pa.array([np.packbits(n[a:b] > 1).tobytes() for a, b in cuts], pa.binary())], names=["bucket", "h", "again"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            flat = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False)  # noqa: E731, B023
            held.append(flat("h1").view(np.uint64)[~flat("again").astype(bool)])
            size += len(held[-1])
            if size >= FLUSH:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)
    return run


def _repeats(batches):
    """All rows of a bucket -> its hashes that several texts hold."""
    parts: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for bucket, h, again in zip(*(b.column(c).to_pylist() for c in ("bucket", "h", "again"))):
            values = _values(h)
            twice = np.unpackbits(np.frombuffer(again, np.uint8), count=len(values)).astype(bool)
            parts.setdefault(bucket, []).extend((values, values[twice]))
    for bucket, held in parts.items():
        values, n = np.unique(np.concatenate(held), return_counts=True)
        values = values[n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(values)], pa.int64()),
                                          pa.array([_planes(values)], pa.binary())], names=["bucket", "n", "h"])


def _bit_part(bucket_bits: int, bits: int):
    """Repeated hashes of a bucket -> the bucket's part of the bit table."""
    def run(batches):
        for b in batches:
            for bucket, h in zip(b.column("bucket").to_pylist(), b.column("h").to_pylist()):
                part = np.zeros(1 << bits - bucket_bits, bool)
                part[_values(h) >> np.uint32(32 - bits + bucket_bits)] = True
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(
                    part, bitorder="little").tobytes()], pa.binary())], names=["bucket", "part"])
    return run


def _bit_table(spark: SparkSession, kept: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, table): a set bit for the first ``bits`` bits of every hash that several texts hold. Hashes cross one
    exchange, by prefix, as 32 bits each that are sorted and compressed."""
    spans = kept.select(F.sum(F.size("step"))).first()[0] or 0
    bucket_bits = min(MAX_BUCKET_BITS, max(MIN_BUCKET_BITS, (spans // BUCKET_SPANS).bit_length()))
    packed = kept.select("h1", "again").mapInArrow(_by_bucket(bucket_bits), "bucket int, h binary, again binary")
    n_parts = min(1 << bucket_bits, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << bucket_bits - 3))
    repeated = stored(spark, packed.repartitionById(n_parts, F.col("bucket") % n_parts)
                      .mapInArrow(_repeats, "bucket int, n long, h binary"), "repeated-halves")
    n = repeated.agg(F.sum("n")).first()[0] or 0
    bits = min(MAX_BITS, max(MIN_BITS, bucket_bits + 3, (BITS_PER_HASH * n).bit_length()))
    table = np.zeros((1 << bits) // 8, np.uint8)
    size = len(table) >> bucket_bits
    for r in repeated.mapInArrow(_bit_part(bucket_bits, bits), "bucket int, part binary").collect():
        table[r["bucket"] * size:(r["bucket"] + 1) * size] = np.frombuffer(r["part"], np.uint8)
    return bits, table


def _candidates(bits: int, table: np.ndarray):
    """Rows of the spans whose bit is set, and of those that their text held before."""
    def run(batches):
        for batch in batches:
            column = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
            counts = np.diff(np.asarray(batch.column("h1").offsets))
            row = np.repeat(np.arange(batch.num_rows), counts)
            h1, again = column("h1"), column("again")
            place = (h1.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            use = np.flatnonzero(again | ((table[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool))
            total = np.concatenate([[0], np.cumsum(column("step"), dtype=np.int64)])
            before = np.cumsum(counts) - counts
            a = (total[1:] - total[before][row])[use]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(row[use])) for c in ("doc_id", "k1", "k2")]
                + [pa.array(h1[use]), pa.array(column("h2")[use]), pa.array(a.astype(np.int32)),
                   pa.array((a + column("length")[use]).astype(np.int32)), pa.array(again[use])],
                names=["doc_id", "k1", "k2", "h1", "h2", "a", "b", "again"])
    return run


def merge_ranges(ranges) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def cut_ranges(text: str, ranges) -> str:
    out, at = [], 0
    for a, b in merge_ranges(ranges):
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


ROW_KEY = ["k1", "k2"]


def _order(id_col: str):
    """Ids in their order; rows without one come last."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """(a row per row with anything to remove: what tells it from the others, and the code-point ranges; the names of the
    columns that tell rows apart). Where each row has an id of its own that is ``doc_id``, and neither spans nor texts
    carry more through the exchanges; else the hashes of id and text (``row_key``).

    The first half of a hash that only one text holds rules a span out: one exchange brings together 32 bits of each
    and nothing else, and a bit table of the repeated ones (32 MB at most) lets few other spans pass. A bit that is set
    by chance costs a row and changes nothing, since the spans left are compared by whole hashes: one exchange finds the
    first document of each, one brings the spans to it; a span that a third of all documents hold is split by the skew
    handling of the join. Spans that occurred earlier in the same text need no join.
    """
    spark = docs.sparkSession
    src = docs.select(_order(id_col).alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).alias("t"))
    kept = stored(spark, src.mapInArrow(_span_rows, SPAN_ROWS), "sentence-spans")
    own_ids = kept.groupBy("doc_id").count().where("count > 1").isEmpty()
    table = _bit_table(spark, kept)
    rows = stored(spark, kept.mapInArrow(_candidates(*table), "doc_id long, k1 long, k2 long, h1 long, h2 int, a int, "
                                                              "b int, again boolean"), "span-candidates")
    # ids alone put the documents in order, where each has one
    key = ["doc_id"] if own_ids else ROW_KEY
    place = F.col("doc_id") if own_ids else F.struct("doc_id", *ROW_KEY)
    first = rows.where("not again").select("h1", "h2", "doc_id", *([] if own_ids else ROW_KEY), "a", "b")
    repeated = (first.groupBy("h1", "h2").agg(F.min(place).alias("owner"), F.max(place).alias("latest"))
                .where("owner < latest").select("h1", "h2", "owner"))
    later = first.join(repeated, ["h1", "h2"]).where(place > F.col("owner")).select(*key, "a", "b")
    ranges = (later.union(rows.where("again").select(*key, "a", "b"))
              .groupBy(*key).agg(F.collect_set(F.struct("a", "b")).alias("ranges")))
    return ranges, key


def _remove(batches):
    for b in batch_slices(batches, "z"):
        texts, counts = [], []
        for t, ranges, copy in zip(unzip_texts(b.column("z")), b.column("ranges").to_pylist(), b.column("copy").to_pylist()):
            t = None if t is None else t.decode()
            ranges = [(r["a"], r["b"]) for r in ranges or ()]
            if copy > 1 and t:
                units = sentences(t)
                ranges = [(units[i][0], units[j][1]) for i, j in (spans(units) if units else ())]
            if ranges:
                counts.append(sum(y - x for x, y in merge_ranges(ranges)))
                texts.append(cut_ranges(t, ranges))
            else:
                counts.append(0)
                texts.append(t)
        names = [n for n in b.schema.names if n not in ("z", "ranges", "copy")]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string()),
                                          pa.array(counts, pa.int64())], names=[*names, "t", "removed"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   removed_col: str | None = None) -> DataFrame:
    """``docs`` with repeated sentences taken out of ``text_col``, all rows and other columns kept; ``removed_col``
    names an added column with the number of characters removed. Null texts stay null; a text all of whose sentences
    are repeats becomes empty; an empty table stays empty."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    ranges, key = repeated_ranges(docs, id_col, text_col)
    keys = [_order(id_col)] if key == ["doc_id"] else row_key(id_col, text_col)
    src = docs.select("*", *(c.alias(fresh(docs, f"key_{i}")) for i, c in enumerate(keys))).toDF(*names, *key)
    src = src.withColumnRenamed(names[at], "t")
    kept = [n for n in names if n != names[at]]
    schema = ", ".join(f"{n} {src.schema[n].dataType.simpleString()}" for n in kept)
    packed = src.mapInArrow(zip_texts(*kept, *key, text="t", keep_null=True),
                            (schema + ", " if schema else "") + "".join(f"{k} long, " for k in key) + "z binary")
    copy = F.lit(1) if key != ROW_KEY else F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
    joined = packed.join(ranges, key, "left").withColumn("copy", copy).select(*kept, "z", "ranges", "copy")
    out = joined.mapInArrow(_remove, (schema + ", " if schema else "") + "t string, removed long")
    cols = [F.col("t" if i == at else n).alias(c) for i, (n, c) in enumerate(zip(names, docs.columns))]
    return out.select(*cols, *([F.col("removed").alias(removed_col)] if removed_col else []))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` without repeated sentence spans: doc_id, whether it held any, n_removed (characters) and
    the text left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, removed_col="n_removed").select(
        "doc_id", (F.col("n_removed") > 0).alias("has_repeats"), "n_removed", "text")
