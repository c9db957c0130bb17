"""Alignment of two tokenizers' tokens over the same texts (operator 11).

A is a ``tokenizers`` file with byte-level tokens, B a sentencepiece model that puts a space before the text; both read
space + text. A document is cut into groups at the byte offsets where tokens of both end; the A and the B token that
end at such an offset are linked, and a pair of ids counts how often it is linked in the whole corpus.

* Where a token ends comes from the libraries' spans: A's character offsets and the byte spans of B's proto result
  (``return_type="proto"``, what later versions of the library return for ``immutable_proto``). These are coarse: tokens
  that share one character, and byte-fallback tokens, get the end of the whole character. Such tokens are refined by
  the bytes that they decode to, and a text whose decoded bytes differ from it has no tokens.
* A space behind a character that is not white space begins a token of both: A's word pattern ends there
  (``tokens.sure_cuts``), and B's vocabulary has no piece with a space mark behind another character (looked up; a model
  that has one is not cut). So documents are cut there, but for a space that ends its text, each distinct unit is encoded and aligned once per batch and
  kept, up to a bound, for later ones, and a document's groups are those of its units in order.
* Of a linked pair one token's bytes end with the other's. So there are at most as many pairs as suffixes of tokens
  (``pair_bound``, about a million for the two vocabularies), whatever the corpus; that table is summed by Spark and
  handed to all tasks.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_slices, forget_state, stored, text_slices, worker_state
from .tokens import MAX_PIECE_CHARS, Pool, _sure_cuts_hold, sure_cuts

MARK = "▁"
MAX_UNITS = 300_000                   # units kept between batches, per Python worker
SLICE_BYTES = 1 << 20
ENCODE = 8192                         # units that are encoded and aligned at a time


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def a_token_bytes(tokenizer) -> list[bytes]:
    """Bytes of every id of a byte-level tokenizer; special tokens are their own text."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return out


def b_token_bytes(model) -> list[bytes]:
    """Bytes of every id of a sentencepiece model; the space mark is a space, a byte token its byte."""
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
            else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(model.get_piece_size())]


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of ids can be linked at most: of two tokens that end together one ends the other."""
    return sum(map(len, a)) + 2 * sum(map(len, b))


def token_ends(span: np.ndarray, lengths: np.ndarray, first: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Byte offset behind every token of consecutive texts.

    ``span`` holds the bytes of the characters a token lies in (empty: none), ``lengths`` its decoded bytes, ``first``
    the index of the first token of its text and ``start`` the offset where that text begins. A token whose span ends
    inside the span of the next, or has none, is placed by the decoded bytes since the last one that is certain."""
    n = len(span)
    whole = span[:, 1] > span[:, 0]
    inner = np.arange(1, n) > first[1:]            # the token before belongs to the same text
    whole[:-1] &= ~inner | (span[1:, 0] >= span[:-1, 1]) & whole[1:]
    at = np.arange(n)
    last = np.maximum.accumulate(np.where(whole, at, -1))
    known = last >= first
    total = np.concatenate([[0], np.cumsum(lengths)])
    base = np.where(known, span[np.maximum(last, 0), 1], start)
    return base + total[1:] - total[np.where(known, last + 1, first)]


def pair_codes(a_ids: np.ndarray, b_ids: np.ndarray, long: bool) -> np.ndarray:
    """A linked pair as one number: A's id in the upper half, in 32 bits where both vocabularies allow it."""
    if long:
        return a_ids.astype(np.int64) << 32 | b_ids
    return (a_ids.astype(np.int64) << 16 | b_ids).astype(np.uint32).view(np.int32)


@lru_cache(maxsize=8)
def _long_pairs(a_path: str, b_path: str) -> bool:
    import sentencepiece
    from tokenizers import Tokenizer
    sizes = (Tokenizer.from_file(a_path).get_vocab_size(),
             sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size())
    return max(sizes) > 1 << 16


class Ragged:
    """Rows of different lengths by number, added and taken in bulk."""

    def __init__(self, dtype):
        self.data, self.starts, self.lens = np.zeros(1 << 16, dtype), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.rows = self.size = 0

    def add(self, data: np.ndarray, lens: np.ndarray):
        while self.size + len(data) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        while self.rows + len(lens) > len(self.lens):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        own = slice(self.rows, self.rows + len(lens))
        self.data[self.size:self.size + len(data)] = data
        self.lens[own], self.starts[own] = lens, self.size + np.cumsum(lens) - lens
        self.rows, self.size = self.rows + len(lens), self.size + len(data)

    def take(self, rows: np.ndarray):
        """(their values in order, where each ends)"""
        lens = self.lens[rows]
        stops = np.cumsum(lens)
        total = int(stops[-1]) if len(stops) else 0
        return self.data[np.repeat(self.starts[rows] - (stops - lens), lens) + np.arange(total)], stops


class Aligner:
    """Encodes and aligns units of text; one per worker and pair of files."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        a_bytes, b_bytes = a_token_bytes(self.a), b_token_bytes(self.b)
        self.a_pool, self.b_pool = Pool(a_bytes), Pool(b_bytes)
        # an id in decimal and what follows it: the next id, B's side of the group, the next group
        self.shown = Pool([b"%d%c" % (i, c) for i in range(max(len(a_bytes), len(b_bytes))) for c in b",|;"])
        with open(a_path, encoding="utf-8") as f:
            self.cuts = _sure_cuts_hold(json.load(f)) and not any(
                MARK in p.lstrip(MARK) for p in map(self.b.id_to_piece, range(self.b.get_piece_size())))
        self.slots: dict[str, int] = {}
        # per unit: its groups as text, its links, [A tokens, B tokens, whether it has tokens at all]
        self.long = max(len(a_bytes), len(b_bytes)) > 1 << 16
        self.groups, self.links, self.counts = Ragged(np.uint8), Ragged(np.int64 if self.long else np.int32), Ragged(np.int32)

    def _a_tokens(self, units: list[str], data: np.ndarray, at: np.ndarray):
        got = self.a.encode_batch(units, add_special_tokens=False)
        ids = [e.ids for e in got]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = chain.from_iterable
        n = int(counts.sum())
        chars = np.fromiter(flat(flat(e.offsets for e in got)), np.int64, 2 * n).reshape(n, 2)
        # characters of a unit -> bytes of all units
        begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        return np.fromiter(flat(ids), np.int64, n), counts, begins[chars + np.repeat(np.searchsorted(begins, at[:-1]), counts)[:, None]]

    def _b_tokens(self, units: list[str], at: np.ndarray):
        got = [[(p.id, p.begin, p.end) for p in t.pieces]
               for t in self.b.encode([u[1:] for u in units], return_type="proto", num_threads=1)]
        counts = np.fromiter(map(len, got), np.int64, len(got))
        n = int(counts.sum())
        rows = np.fromiter(chain.from_iterable(chain.from_iterable(got)), np.int64, 3 * n).reshape(n, 3)
        # B counts without the space that it adds: the first token of a unit reaches back over it
        span = rows[:, 1:] + 1
        first = (np.cumsum(counts) - counts)[counts > 0]
        span[first, 0] = 0
        return rows[:, 0], counts, span + np.repeat(at[:-1], counts)[:, None]

    def _align(self, units: list[str]):
        """Appends the units, in order, to what is known."""
        raw = [u.encode() for u in units]
        data = np.frombuffer(b"".join(raw), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        sides, good = [], np.ones(len(units), bool)
        for (ids, counts, span), pool in zip((self._a_tokens(units, data, at), self._b_tokens(units, at)),
                                             (self.a_pool, self.b_pool)):
            unit = np.repeat(np.arange(len(units)), counts)
            sides.append((ids, span, unit, pool))
            good &= np.bincount(unit, pool.lens[ids], len(units)) == np.diff(at)
        ends = []
        for k, (ids, span, unit, pool) in enumerate(sides):
            use = good[unit]                       # units whose length came back: their bytes are compared
            ids, span, unit = ids[use], span[use], unit[use]
            back = np.frombuffer(data, np.uint8)[np.repeat(good, np.diff(at))] != pool.join(ids)[0]
            good[np.repeat(np.flatnonzero(good), np.diff(at)[good])[back]] = False
            sides[k] = ids, span, unit, pool
        for ids, span, unit, pool in sides:
            use = good[unit]
            ids, span, unit = ids[use], span[use], unit[use]
            counts = np.bincount(unit, minlength=len(units))
            first = np.repeat(np.cumsum(counts) - counts, counts)
            lens, start = pool.lens[ids], at[unit]
            end = token_ends(span, lens, first, start) if len(ids) else np.zeros(0, np.int64)
            total = np.concatenate([[0], np.cumsum(lens)])
            decoded = start + total[1:] - total[first]
            off = np.bincount(unit, end != decoded, len(units)) > 0
            end = np.where(off[unit], decoded, end)     # spans that disagree with the decoded bytes give way to them
            ends.append((ids, end, counts))
        (a_ids, a_end, a_n), (b_ids, b_end, b_n) = ends
        mark = np.zeros((2, len(data) + 1), bool)
        mark[0, a_end] = mark[1, b_end] = True
        i, j = np.flatnonzero(mark[1, a_end]), np.flatnonzero(mark[0, b_end])       # the last tokens of the groups
        per_unit = np.bincount(np.searchsorted(at, a_end[i], "left") - 1, minlength=len(units))
        # A's and B's ids of a group stand one behind the other
        a_after, b_before = np.searchsorted(i, np.arange(len(a_ids))), np.searchsorted(j, np.arange(len(b_ids)))
        place_a = np.arange(len(a_ids)) + np.concatenate([[0], j + 1])[a_after]
        place_b = np.arange(len(b_ids)) + np.append(i + 1, len(a_ids))[b_before]
        shown = np.zeros(len(a_ids) + len(b_ids), np.int64)
        shown[place_a], shown[place_b] = 3 * a_ids, 3 * b_ids
        shown[place_a[i]] += 1
        shown[place_b[j]] += 2
        text, stops = self.shown.join(shown)
        lengths = np.diff(np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(a_n + b_n)])])
        self.groups.add(text, lengths)
        self.links.add(pair_codes(a_ids[i], b_ids[j], self.long), per_unit)
        self.counts.add(np.stack([a_n, b_n, good], 1).ravel(), np.full(len(units), 3))

    def documents(self, texts: list[bytes]):
        """For texts with the space before them: [A tokens, B tokens] of each, the groups of all as bytes and where each
        text's end, the links likewise; a text without tokens has none of any."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        edges = np.cumsum([0, *map(len, texts)])
        cuts = np.zeros(len(data) + 1, bool)
        if self.cuts:
            cuts[:-1] = sure_cuts(data)[:-1] & (data == 32)
            cuts[edges[1:] - 1] = False         # B has no tokens for a space alone: it would be told to encode nothing
        cuts[edges] = True
        marks = np.flatnonzero(cuts)
        units = pa.LargeStringArray.from_buffers(len(marks) - 1, pa.py_buffer(marks), pa.py_buffer(data)).dictionary_encode()
        names, slots = units.dictionary.to_pylist(), self.slots
        found = np.fromiter((slots.get(u, -1) for u in names), np.int64, len(names))
        new = np.flatnonzero(found < 0)
        room = max(MAX_UNITS - len(slots), 0)
        short = np.fromiter((len(names[i]) <= MAX_PIECE_CHARS for i in new), bool, len(new))
        keep = new[short][:room]
        rest = np.setdiff1d(new, keep)
        pools = self.groups, self.links, self.counts
        for some in (keep, rest):
            found[some] = pools[0].rows + np.arange(len(some))
            for k in range(0, len(some), ENCODE):
                self._align([names[i] for i in some[k:k + ENCODE]])
            if some is keep:
                slots.update((names[i], int(found[i])) for i in keep)
                bound = [(p.rows, p.size) for p in pools]
        unit = found[np.asarray(units.indices)]
        at = np.searchsorted(marks, edges)
        counts = self.counts.take(unit)[0].reshape(-1, 3)
        text_of = np.repeat(np.arange(len(texts)), np.diff(at))
        bad = np.bincount(text_of, counts[:, 2] == 0, len(texts)) > 0
        unit, text_of, counts = (x[~bad[text_of]] for x in (unit, text_of, counts))
        tokens = np.stack([np.bincount(text_of, counts[:, k], len(texts)).astype(np.int64) for k in (0, 1)], 1)
        upto = np.searchsorted(text_of, np.arange(1, len(texts) + 1))
        out = [tokens]
        for pool in pools[:2]:
            values, stops = pool.take(unit)
            out += [values, np.concatenate([[0], stops])[np.concatenate([[0], upto])]]
        for p, (rows, size) in zip(pools, bound):       # what was not kept goes
            p.rows, p.size = rows, size
        return out


def _aligner(a_path: str, b_path: str) -> Aligner:
    return worker_state(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))


ROWS = "n_a long, n_b long, n_groups long, groups string, links array<{kind}>"


def _rows(a_path: str, b_path: str, passed, digest: bool):
    def run(batches):
        aligner = _aligner(a_path, b_path)
        for batch in batch_slices(batches, "t", SLICE_BYTES):
            texts = [t or b"" for t in batch.column("t").cast(pa.binary()).to_pylist()]
            some = np.flatnonzero([len(t) > 0 for t in texts])
            tokens, group_ends, link_ends = np.zeros((len(texts), 2), np.int64), *np.zeros((2, len(texts) + 1), np.int64)
            data, links = np.zeros(0, np.uint8), np.zeros(0, np.int64 if aligner.long else np.int32)
            if len(some):
                tokens[some], data, g, links, k = aligner.documents([b" " + texts[i] for i in some])
                for ends, got in ((group_ends, g), (link_ends, k)):
                    ends[some + 1] = got[1:]
                    np.maximum.accumulate(ends, out=ends)
            data = data.tobytes()
            # every group ends with a mark; the last one of a text has none
            groups = [data[x:max(y - 1, x)] for x, y in zip(group_ends.tolist(), group_ends[1:].tolist())]
            groups = [(hashlib.sha256(g).hexdigest() if g else "") if digest else g.decode() for g in groups]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(p) for p in passed), pa.array(tokens[:, 0]), pa.array(tokens[:, 1]),
                 pa.array(np.diff(link_ends)), pa.array(groups, pa.string()),
                 pa.ListArray.from_arrays(pa.array(link_ends.astype(np.int32)), pa.array(links))],
                names=[*passed, "n_a", "n_b", "n_groups", "groups", "links"])
    return run


def align_documents(docs: DataFrame, text_col: str = "text", a_path: str | None = None, b_path: str | None = None,
                    digest: bool = False) -> DataFrame:
    """``docs`` without ``text_col`` and with n_a, n_b (tokens), n_groups, groups (``a1,a2|b1;a3|b2``, ids in order; with
    ``digest`` their SHA-256) and links (``pair_codes`` of the linked ids). The added columns replace any of the
    same names. Null and empty texts and texts that a tokenizer does not give back have no tokens: zeros, an empty
    ``groups`` and no links. Every row is read by itself, repeated ones and those without an id too."""
    a, b = default_tokenizers()
    added = {"n_a", "n_b", "n_groups", "groups", "links"}
    keep = [c for c in docs.columns if c.lower() not in added | {text_col.lower()}]
    names = [f"c{i}" for i in range(len(keep))]
    src = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)), F.col(text_col).alias("t"))
    schema = "".join(f"{n} {src.schema[n].dataType.simpleString()}, " for n in names)
    a, b = a_path or a, b_path or b
    out = src.mapInArrow(_rows(a, b, names, digest), schema + ROWS.format(kind="long" if _long_pairs(a, b) else "int"))
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), "n_a", "n_b", "n_groups", "groups", "links")


LINKS_AT_ONCE = 1 << 20


def _pair_sums(batches):
    """Counts of the pairs of a task's rows, in runs of bounded size."""
    forget_state("aligner")           # what was kept for encoding; its memory is needed here
    held, size = [], 0

    def flush():
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], names=["pair", "n"])

    for b in batches:
        flat = b.column("links").flatten().to_numpy(zero_copy_only=False)
        for i in range(0, len(flat), LINKS_AT_ONCE):
            held.append(flat[i:i + LINKS_AT_ONCE].copy())
            size += len(held[-1])
            if size >= LINKS_AT_ONCE:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a_id, b_id, n (links of the pair in all documents), best (whether no A id is linked to this B id more often)."""
    kind = aligned.schema["links"].dataType.elementType.simpleString()
    half = 16 if kind == "int" else 32
    n = aligned.select("links").mapInArrow(_pair_sums, f"pair {kind}, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    n = stored(aligned.sparkSession, n.select(F.shiftrightunsigned("pair", half).cast("int").alias("a_id"),
                                              F.col("pair").bitwiseAND((1 << half) - 1).cast("int").alias("b_id"), "n"),
               "pair-counts")
    most = n.groupBy("b_id").agg(F.max("n").alias("most"))
    return n.join(most, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def _scored(counts, passed):
    def run(batches):
        forget_state("aligner")           # what was kept for encoding; its memory is needed here
        pairs, n, best = counts.value
        for whole in batches:
            edges = np.asarray(whole.column("links").offsets)
            cuts = text_slices(np.diff(edges).tolist(), LINKS_AT_ONCE)
            for b in (whole.slice(i, j - i) for i, j in cuts):
                links = b.column("links")
                at = np.searchsorted(pairs, links.flatten().to_numpy(zero_copy_only=False))
                edges = np.asarray(links.offsets)
                edges = edges - edges[0]

                def per_row(values):
                    total = np.concatenate([[0], np.cumsum(values[at])])
                    return pa.array(total[edges[1:]] - total[edges[:-1]], pa.int64())

                yield pa.RecordBatch.from_arrays([*(b.column(p) for p in passed), per_row(best), per_row(n)],
                                                 names=[*passed, "n_best", "count_sum"])
    return run


def score_links(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` with n_best (links whose pair is best) and count_sum (their pairs' counts added up) for ``links``.
    ``counts`` is what ``pair_counts`` says of the same rows: its size is bounded by the vocabularies, not by them."""
    got = counts.select("a_id", "b_id", "n", F.col("best").cast("long").alias("best")).toArrow()
    a, b, n, best = (got.column(c).to_numpy() for c in ("a_id", "b_id", "n", "best"))
    pairs = pair_codes(a, b, aligned.schema["links"].dataType.elementType.simpleString() == "bigint")
    order = np.argsort(pairs)
    held = aligned.sparkSession.sparkContext.broadcast((pairs[order], n[order], best[order]))
    keep = [c for c in aligned.columns if c not in ("links", "n_best", "count_sum")]
    names = [f"c{i}" for i in range(len(keep))]
    src = aligned.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)), "links")
    schema = "".join(f"{n} {src.schema[n].dataType.simpleString()}, " for n in names)
    out = src.mapInArrow(_scored(held, names), schema + "n_best long, count_sum long")
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), "n_best", "count_sum")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: its tokens by both tokenizers, its groups and links, how many links are the best of
    their B id, the corpus-wide counts of its links, and the SHA-256 of its groups."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    aligned = stored(spark, align_documents(docs, digest=True), "aligned")
    return score_links(aligned, pair_counts(aligned)).select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum",
        F.col("groups").alias("groups_sha256"))
