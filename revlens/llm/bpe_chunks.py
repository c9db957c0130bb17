"""BPE encoding and decoding with content-defined chunk reuse (operator 8).

1. Texts are cut where a rolling hash of the last 32 bytes has its low bits zero, so that equal passages give equal
   chunks wherever they stand. Chunk hashes (not texts) are grouped over all documents.
2. A chunk hash that occurs more than once has one owner, its first occurrence. Owners encode it; the other
   occurrences receive the ids by a join on the hash. Everything between shared chunks is encoded where it stands.
3. The pieces of a document are put together and their joins repaired: at each join the stretch between the nearest
   places where a token surely ends is re-encoded, and widened until both its ends are token ends of the pieces.

Decoding goes through a table of each id's bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_slices, row_key, stored, text_slices, unzip_texts, zip_texts
from .tokens import default_tokenizer, encoder, id_decimals, sure_cuts, token_bytes

WINDOW = 32
MASK = (1 << 11) - 1      # a chunk of 2 KB on average
MIN_CHUNK, MAX_CHUNK = 256, 1 << 15
SLICE_BYTES = 2 << 20     # text that is hashed at once, per task
ENCODE_BYTES = 4 << 20    # text that is encoded at once, beside the chunks that a task holds
SLICE_IDS = 1 << 19

# A document without shared chunks is whole and carries its digests; any other carries its segments: what it encoded
# (h null), a shared chunk that it owns (h and ids) or one that it waits for (h, no ids).
PARTS = ("whole boolean, k1 long, k2 long, doc_id long, copies long, n_tokens long, ids_sha256 string, "
         "decoded_sha256 string, segs array<struct<h1:long,h2:long,ids:binary>>")
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _gear() -> np.ndarray:
    return np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


_GEAR = _gear()


def chunk_ends(texts: list[bytes]) -> list[list[int]]:
    """End positions of the chunks of each text (none for an empty one), at character starts. A cut depends on the
    32 bytes before it and on the last cut, never on other texts."""
    out: list[list[int]] = []
    for a, b in text_slices([len(t) for t in texts], SLICE_BYTES):
        part = texts[a:b]
        data = np.frombuffer(b"".join(part), np.uint8)
        h = _GEAR[data]
        step = 1
        while step < WINDOW:                      # h[i] = sum of gear[data[i - k]] << k over the window
            late = h[step:] + (h[:-step] << np.uint32(step)) if len(h) > step else h[:0]
            h = np.concatenate([h[:step], late])
            step *= 2
        at = np.flatnonzero((h >> np.uint32(20)) & np.uint32(MASK) == 0) + 1
        start_of_char = np.append((data & 0xC0) != 0x80, True)
        at = at[start_of_char[at]]
        edge = 0
        for t in part:
            stop, last, ends = edge + len(t), edge, []
            for p in at[np.searchsorted(at, edge + WINDOW):np.searchsorted(at, stop)].tolist():   # windows inside t
                while p - last > MAX_CHUNK:
                    last = _char_start(start_of_char, last + MAX_CHUNK)
                    ends.append(last - edge)
                if p - last >= MIN_CHUNK:
                    ends.append(p - edge)
                    last = p
            while stop - last > MAX_CHUNK:
                last = _char_start(start_of_char, last + MAX_CHUNK)
                ends.append(last - edge)
            if stop > last:
                ends.append(stop - edge)
            out.append(ends)
            edge = stop
    return out


def _char_start(start_of_char: np.ndarray, p: int) -> int:
    while not start_of_char[p]:
        p += 1
    return p


def _hash(chunk: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(chunk)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _chunk_rows(batches):
    for b in batch_slices(batches, "text", SLICE_BYTES):
        texts = [(t or "").encode() for t in b.column("text").to_pylist()]
        cols = [[], [], [], [], []]
        for k1, k2, t, ends in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), texts, chunk_ends(texts)):
            at = 0
            for i, e in enumerate(ends):
                for c, v in zip(cols, (k1, k2, i, *_hash(t[at:e]))):
                    c.append(v)
                at = e
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(),
                                                                              pa.int64(), pa.int64()))],
                                         names=["k1", "k2", "i", "h1", "h2"])


def _digests(tokenizer: str, ids: np.ndarray, ends: np.ndarray):
    """(number of ids, digest of the ids, digest of the decoded text) per document."""
    tb, dec = token_bytes(tokenizer), id_decimals(tokenizer)
    n, shas, texts = np.diff(ends), [], []
    for a, b in text_slices(n.tolist(), SLICE_IDS):
        own = ids[ends[a]:ends[b]]
        (raw, raw_stops), (num, num_stops) = tb.join(own), dec.join(own)
        raw, num = memoryview(raw.tobytes()), memoryview(num.tobytes())
        raw_stops, num_stops = np.append(0, raw_stops), np.append(0, num_stops)
        for i in range(a, b):
            x, y = ends[i] - ends[a], ends[i + 1] - ends[a]
            shas.append(hashlib.sha256(num[num_stops[x]:max(num_stops[y] - 1, num_stops[x])]).hexdigest())
            text = bytes(raw[raw_stops[x]:raw_stops[y]])
            texts.append(hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest())
    return n, shas, texts


def _batch(schema: pa.Schema, columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns
                                       else pa.nulls(n, f.type) for f in schema], schema=schema)


def _parts_schema() -> pa.Schema:
    i, s, b = pa.int64(), pa.string(), pa.binary()
    return pa.schema([("whole", pa.bool_()), ("k1", i), ("k2", i), ("doc_id", i), ("copies", i), ("n_tokens", i),
                      ("ids_sha256", s), ("decoded_sha256", s),
                      ("segs", pa.list_(pa.struct([("h1", i), ("h2", i), ("ids", b)])))])


def _encode_parts(tokenizer: str):
    def run(batches):
        enc, schema = encoder(tokenizer), _parts_schema()
        for b in batch_slices(batches, "z"):
            texts = unzip_texts(b.column("z"))
            keys = [b.column(c).to_pylist() for c in ("k1", "k2", "doc_id", "copies")]
            shared = b.column("shared").to_pylist()
            plain = [i for i, s in enumerate(shared) if not s]
            if plain:
                ids, ends = enc.encode(pa.array([texts[i] for i in plain], pa.binary()).cast(pa.string()), ENCODE_BYTES)
                n, sha, dec = _digests(tokenizer, ids, ends)
                yield _batch(schema, {"whole": np.ones(len(plain), bool), "n_tokens": n, "ids_sha256": sha,
                                      "decoded_sha256": dec,
                                      **{c: [k[i] for i in plain] for c, k in zip(("k1", "k2", "doc_id", "copies"),
                                                                                  keys)}}, len(plain))
            mixed = [i for i, s in enumerate(shared) if s]
            if not mixed:
                continue
            todo, segs = [], []          # texts to encode; per document (h1, h2, number in todo or None)
            for i, ends in zip(mixed, chunk_ends([texts[i] for i in mixed])):
                marked = {s["i"]: s for s in shared[i]}
                own, run_from, at = [], None, 0

                def close(stop, t=texts[i]):
                    if run_from is not None:
                        own.append((None, None, len(todo)))
                        todo.append(t[run_from:stop])

                for k, e in enumerate(ends):
                    s = marked.get(k)
                    if s is None:
                        run_from = at if run_from is None else run_from
                    else:
                        close(at)
                        run_from = None
                        if s["own"]:
                            own.append((s["h1"], s["h2"], len(todo)))
                            todo.append(texts[i][at:e])
                        else:
                            own.append((s["h1"], s["h2"], None))
                    at = e
                close(at)
                segs.append(own)
            ids, ends = enc.encode(pa.array(todo, pa.binary()).cast(pa.string()), ENCODE_BYTES)
            raw = [ids[ends[j]:ends[j + 1]].tobytes() for j in range(len(todo))]
            yield _batch(schema, {"whole": np.zeros(len(mixed), bool),
                                  **{c: [k[i] for i in mixed] for c, k in zip(("k1", "k2", "doc_id", "copies"), keys)},
                                  "segs": [[{"h1": x, "h2": y, "ids": None if j is None else raw[j]}
                                            for x, y, j in own] for own in segs]}, len(mixed))
    return run


def join_pieces(tokenizer: str, docs: list[list[np.ndarray]]):
    """Ids of whole documents from the ids of their consecutive pieces, each encoded alone. (ids, ends)."""
    enc, tb = encoder(tokenizer), token_bytes(tokenizer)
    todo, plans = [], []
    for pieces in docs:
        pieces = [p for p in pieces if len(p)]
        if len(pieces) < 2:
            plans.append((pieces[0] if pieces else np.zeros(0, enc.dtype), []))
            continue
        ids = np.concatenate(pieces)
        raw, stops = tb.join(ids)
        token_ends = np.append(0, stops)
        seams = token_ends[np.cumsum([len(p) for p in pieces])[:-1]]
        sure = sure_cuts(raw) if enc.cuts else np.zeros(len(raw) + 1, bool)
        sure[[0, -1]] = True
        sure = np.flatnonzero(sure)
        windows: list[list[int]] = []
        for s in seams.tolist():
            if windows and s < windows[-1][1]:
                continue
            a, b = int(np.searchsorted(sure, s, "right")) - 1, int(np.searchsorted(sure, s, "left"))
            if sure[a] == s:
                continue
            while not _is_end(token_ends, sure[a]):     # widen until the pieces' own tokens end there
                a -= 1
            while not _is_end(token_ends, sure[b]):
                b += 1
            if windows and sure[a] < windows[-1][1]:
                windows[-1][1] = int(sure[b])
            else:
                windows.append([int(sure[a]), int(sure[b])])
        cuts = []
        for a, b in windows:
            cuts.append((int(np.searchsorted(token_ends, a)), int(np.searchsorted(token_ends, b)), len(todo)))
            todo.append(raw[a:b].tobytes())
        plans.append((ids, cuts))
    again, ends = enc.encode(pa.array(todo, pa.binary()).cast(pa.string()))
    out, lens = [], []
    for ids, cuts in plans:
        parts, at = [], 0
        for a, b, j in cuts:
            parts += [ids[at:a], again[ends[j]:ends[j + 1]]]
            at = b
        parts.append(ids[at:])
        out += parts
        lens.append(sum(map(len, parts)))
    return (np.concatenate(out) if out else np.zeros(0, enc.dtype)), np.append(0, np.cumsum(lens, dtype=np.int64))


def _is_end(token_ends: np.ndarray, p: int) -> bool:
    return token_ends[np.searchsorted(token_ends, p)] == p


def _assemble(tokenizer: str, with_ids: bool):
    def run(batches):
        dtype = encoder(tokenizer).dtype
        for b in (part.slice(i, 256) for part in batches for i in range(0, part.num_rows, 256)):
            docs = []
            for segs, fills in zip(b.column("segs").to_pylist(), b.column("fills").to_pylist()):
                got = {f["pos"]: f["ids"] for f in fills or ()}
                docs.append([np.frombuffer(s["ids"] if s["ids"] is not None else got[p], dtype)
                             for p, s in enumerate(segs)])
            ids, ends = join_pieces(tokenizer, docs)
            n, sha, dec = _digests(tokenizer, ids, ends)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copies"), pa.array(n), pa.array(sha),
                                              pa.array(dec)],
                                             names=["doc_id", "copies", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def encode_decode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, equal to the library's own.

    Null and empty texts have no ids. Rows with equal id and text are encoded once and returned as often as they
    occur; a null id stays null. Chunk hashes that very many rows share are counted by partial aggregation and joined
    with skew handling; no document set is gathered by chunk.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                      *row_key(id_col, text_col))
    chunks = stored(spark, src.select("k1", "k2", "text").mapInArrow(_chunk_rows,
                                                                   "k1 long, k2 long, i int, h1 long, h2 long"),
                    "chunks")
    shared = (chunks.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "i")).alias("o"))
              .where("n > 1").select("h1", "h2", "o"))
    per_doc = (chunks.join(shared, ["h1", "h2"])
               .groupBy("k1", "k2", "i").agg(F.min("h1").alias("h1"), F.min("h2").alias("h2"),
                                             F.max((F.col("o.k1") == F.col("k1")) & (F.col("o.k2") == F.col("k2"))
                                                   & (F.col("o.i") == F.col("i"))).alias("own"))
               .groupBy("k1", "k2").agg(F.collect_list(F.struct("i", "h1", "h2", "own")).alias("shared")))
    texts = (src.mapInArrow(zip_texts("k1", "k2", "doc_id"), "k1 long, k2 long, doc_id long, z binary")
             .groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("z").alias("z"),
                                      F.count("*").alias("copies")))
    parts = stored(spark, texts.join(per_doc, ["k1", "k2"], "left")
                   .select("k1", "k2", "doc_id", "copies", "z", "shared")
                   .mapInArrow(_encode_parts(tokenizer), PARTS), "encoded-parts")
    done = parts.where("whole").select("doc_id", "copies", "n_tokens", "ids_sha256", "decoded_sha256")
    mixed = parts.where("not whole").select("k1", "k2", "doc_id", "copies", "segs")
    owners = (mixed.select(F.explode("segs").alias("s")).where("s.h1 is not null and s.ids is not null")
              .select("s.h1", "s.h2", "s.ids"))
    holes = (mixed.select("k1", "k2", F.posexplode("segs").alias("pos", "s")).where("s.ids is null")
             .select("k1", "k2", "pos", "s.h1", "s.h2"))
    fills = (holes.join(owners, ["h1", "h2"]).groupBy("k1", "k2")
             .agg(F.collect_list(F.struct("pos", "ids")).alias("fills")))
    joined = (mixed.join(fills, ["k1", "k2"], "left").select("doc_id", "copies", "segs", "fills")
              .mapInArrow(_assemble(tokenizer, False), "doc_id long, copies long, n_tokens long, ids_sha256 string, "
                                                       "decoded_sha256 string"))
    return (done.unionByName(joined)
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy"))


def op8_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 8 over all of ``documents``."""
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
