"""Line deduplication with two Bloom filters (operator 12).

A text is split at line ends. A line's key is the line without white space at both ends, A-Z in lower case. Keys of at
least ``MIN_CHARS`` code points that ``MIN_DOCS`` documents or more hold lose all their lines but those of one document:
the one with the largest id.

* Every row is a document. Of rows that share the largest id the one with the largest text hash counts as the largest,
  of equal rows the one read last; rows without an id come before all others.
* The first filter holds the keys seen once, the second those seen again. Both are made in parts by a prefix of the
  hash: a task sends each key of its rows once, and says whether several of them hold it. Only the second filter is
  handed to all tasks, ``2 ** MAX_BITS`` bits at most (its size follows from the number of keys). What it does not hold
  is no repeat and goes nowhere; what it holds is compared by 128-bit hashes. When the bits no longer suffice for the
  keys of a corpus, more of them pass and are compared: the same rows result, and at worst every key crosses one
  exchange as 40 bytes.
* Keys that a thousandth of all suspected lines share (a thousand of them at most) are brought to the lines by
  broadcast, the rest by a join in which no key is larger than that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_slices, fresh, stored, unzip_texts

BLANK = b" \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3

BITS_PER_KEY = 16
PART_BITS = 23                        # a part of a filter: 1 MB
MAX_BITS = 28                         # the filter that all tasks hold: 32 MB
FLUSH = 1 << 20                       # keys that a task gathers before it sends them
HOT = 1000                            # a key with this share of the suspects is hot


def line_hash(line: bytes) -> bytes | None:
    """The 128-bit hash of a line's key, None for keys that are too short."""
    key = line.strip(BLANK).lower()
    if len(key) < MIN_CHARS or not key.isascii() and len(key.decode(errors="replace")) < MIN_CHARS:
        return None
    return xxhash.xxh3_128_digest(key)


def _hashed(passed):
    """Per row the hashes of its distinct keys as two columns, and its compressed text."""
    def run(batches):
        import zstandard
        zip_ = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for b in batch_slices(batches, "t"):
            offsets, hashes, z = [0], [], []
            for t in b.column("t").cast(pa.binary()).to_pylist():
                own = {line_hash(x) for x in (t or b"").split(b"\n") if len(x) >= MIN_CHARS}
                own.discard(None)
                hashes.extend(own)
                offsets.append(len(hashes))
                z.append(None if t is None else zip_.compress(t))
            h = np.frombuffer(b"".join(hashes), np.dtype([("h1", ">i8"), ("h2", ">i8")]))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h[c].astype(np.int64)))
                     for c in ("h1", "h2")]
            yield pa.RecordBatch.from_arrays([*(b.column(p) for p in passed), *lists, pa.array(z, pa.binary())],
                                             names=[*passed, "h1", "h2", "z"])
    return run


def _places(h: np.ndarray):
    """The two places of a hash inside its part of a filter."""
    mask = np.uint64((1 << PART_BITS) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(PART_BITS)) & mask).astype(np.int64)


def _parts_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits + PART_BITS)).astype(np.int64) if bits > PART_BITS else np.zeros(len(h), np.int64)


def _send(bits: int):
    """The distinct hashes of a task's rows by part, and which of them occur in several rows."""
    def flush(held):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        part = _parts_of(h, bits)
        order, edges = np.unique(part, return_index=True)
        edges = [*edges.tolist(), len(h)]           # hashes are sorted, so are their parts
        yield pa.RecordBatch.from_arrays(
            [pa.array(order, pa.int32()),
             pa.array([h[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
             pa.array([np.packbits(n[a:b] > 1).tobytes() for a, b in zip(edges, edges[1:])], pa.binary())],
            names=["part", "h", "again"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            h = b.column("h1").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            held.append(h)
            size += len(h)
            if size >= FLUSH:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)
    return run


def _filters(batches):
    """Both filters of a part; the second is what the result holds."""
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for part, h, again in zip(*(b.column(c).to_pylist() for c in ("part", "h", "again"))):
            if part not in parts:
                parts[part] = np.zeros(1 << PART_BITS, bool), np.zeros(1 << PART_BITS, bool)
            once, twice = parts[part]
            h = np.frombuffer(h, np.uint64)
            p, q = _places(h)
            seen = once[p] & once[q] | np.unpackbits(np.frombuffer(again, np.uint8), count=len(h)).astype(bool)
            twice[p[seen]] = twice[q[seen]] = True
            once[p] = once[q] = True
    yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()),
                                      pa.array([np.packbits(t).tobytes() for _, t in parts.values()], pa.binary())],
                                     names=["part", "bits"])


def seen_again(rows: DataFrame, max_bits: int = MAX_BITS) -> tuple[int, list[bytes | None]]:
    """(bits, parts) of the filter of all values of ``h1`` that several rows hold, with others by chance."""
    n = rows.select(F.sum(F.size("h1"))).first()[0] or 0
    bits = min(max_bits, max(PART_BITS, (BITS_PER_KEY * n).bit_length()))
    n_parts = 1 << bits - PART_BITS
    sent = rows.select("h1").mapInArrow(_send(bits), "part int, h binary, again binary")
    made = sent.repartitionById(n_parts, F.col("part")).mapInArrow(_filters, "part int, bits binary").collect()
    parts: list[bytes | None] = [None] * n_parts
    for r in made:
        parts[r["part"]] = bytes(r["bits"])
    return bits, parts


def _suspects(bits: int, parts):
    """Rows of the hashes that the filter of repeats holds."""
    def run(batches):
        table = np.stack([np.frombuffer(p, np.uint8) if p else np.zeros(1 << PART_BITS - 3, np.uint8)
                          for p in parts.value])
        for b in batches:
            h = b.column("h1").flatten().to_numpy(zero_copy_only=False)
            u = h.view(np.uint64)
            part, (p, q) = _parts_of(u, bits), _places(u)
            hit = [table[part, x >> 3] >> (7 - (x & 7)).astype(np.uint8) & 1 for x in (p, q)]
            use = np.flatnonzero(hit[0] & hit[1])
            row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(b.column("h1").offsets)))[use]
            yield pa.RecordBatch.from_arrays(
                [b.column(c).take(pa.array(row)) for c in ("id", "k", "row")]
                + [b.column(c).flatten().take(pa.array(use)) for c in ("h1", "h2")],
                names=["id", "k", "row", "h1", "h2"])
    return run


def _remove(passed):
    def run(batches):
        for b in batch_slices(batches, "z"):
            texts, n_lines, n_dropped = [], [], []
            for t, drop in zip(unzip_texts(b.column("z")), b.column("drop").to_pylist()):
                lines = (t or b"").split(b"\n")
                n_lines.append(len(lines))
                if drop:
                    gone = set(drop)
                    kept = [x for x in lines if len(x) < MIN_CHARS or (h := line_hash(x)) is None
                            or int.from_bytes(h[:8], "big", signed=True) not in gone]
                    n_dropped.append(len(lines) - len(kept))
                    t = b"\n".join(kept)
                else:
                    n_dropped.append(0)
                texts.append(t)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(p) for p in passed), pa.array(texts, pa.binary()).cast(pa.string()),
                 pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=[*passed, "t", "n_lines", "n_dropped"])
    return run


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        lines_col: str | None = "n_lines", dropped_col: str | None = "n_dropped",
                        max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with the lines of widespread keys taken out of ``text_col`` (see the module), all rows and other columns
    kept; ``lines_col`` and ``dropped_col`` name added columns with a text's lines before and the lines it lost (None:
    not added). A null text stays null and an empty one empty, one line each; a text all of whose lines go becomes
    empty; a line's every occurrence in a text goes or stays; an empty table stays empty.
    """
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    src = docs.select(*(F.col(f"`{c}`").alias("t" if i == at else n) for i, (c, n) in enumerate(zip(docs.columns, names))),
                      F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("k"),
                      F.monotonically_increasing_id().alias("row"))
    kept = [n for n in names if n != names[at]]
    schema = "".join(f"{n} {src.schema[n].dataType.simpleString()}, " for n in kept)
    rows = stored(spark, src.mapInArrow(
        _hashed([*kept, "id", "k", "row"]),
        schema + "id long, k long, row long, h1 array<long>, h2 array<long>, z binary"), "line-hashes")

    bits, parts = seen_again(rows, max_bits)
    held = spark.sparkContext.broadcast(parts)
    suspects = stored(spark, rows.select("id", "k", "row", "h1", "h2").mapInArrow(
        _suspects(bits, held), "id long, k long, row long, h1 long, h2 long"), "suspected-lines")
    held.unpersist()
    keys = stored(spark, suspects.groupBy("h1", "h2")
                  .agg(F.count("*").alias("n"), F.max(F.struct("id", "k", "row")).alias("last"))
                  .where(F.col("n") >= MIN_DOCS).select("h1", "h2", "n", F.col("last.row").alias("last")), "repeated-lines")
    limit = max(suspects.count() // HOT, 1)
    hot, rest = F.broadcast(keys.where(F.col("n") > limit)), keys.where(F.col("n") <= limit)
    lost = (suspects.join(hot, ["h1", "h2"])
            .unionByName(suspects.join(hot, ["h1", "h2"], "left_anti").join(rest, ["h1", "h2"]))
            .where("row <> last").groupBy("row").agg(F.collect_list("h1").alias("drop")))
    out = (rows.select(*kept, "row", "z").join(lost, "row", "left").select(*kept, "z", "drop")
           .mapInArrow(_remove(kept), schema + "t string, n_lines long, n_dropped long"))
    cols = [F.col("t" if i == at else n).alias(c) for i, (n, c) in enumerate(zip(names, docs.columns))]
    return out.select(*cols, *(F.col(n).alias(c) for n, c in (("n_lines", lines_col), ("n_dropped", dropped_col)) if c))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: doc_id, its lines before, the lines it lost, and the SHA-256 of the text left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
        .alias("kept_sha256"))


def oracle_sql() -> str:
    blank = " || ".join(f"chr({b})" for b in BLANK)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
    WITH docs AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
    lines AS (SELECT doc_id, r, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM docs),
    keyed AS (SELECT *, translate(trim(line, {blank}), '{upper}', '{upper.lower()}') AS k FROM lines),
    spread AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= {MIN_CHARS}
               GROUP BY k HAVING count(DISTINCT r) >= {MIN_DOCS}),
    marked AS (SELECT x.*, s.k IS NULL OR x.doc_id = s.last AS stays FROM keyed x LEFT JOIN spread s ON x.k = s.k)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '')) AS kept_sha256
    FROM marked GROUP BY r, doc_id
    """
