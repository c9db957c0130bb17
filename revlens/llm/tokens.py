"""Exact ids of a ``tokenizers`` file for whole batches of texts.

The word pattern of a byte-level tokenizer ends a token at certain places
whatever stands further left or right: before a space that follows a character
other than white space, between a letter and a digit or punctuation mark, and
so on (``_cut_table``). Texts are cut at such places, with NumPy on their
UTF-8 bytes; the distinct pieces of a batch are found by Arrow's dictionary
encoding, each new piece is encoded once by the library and kept (up to a
bound) for later batches, and the texts' ids are gathered from the pieces'
ids. Places in doubt are not cut. Files of any other kind go through
``encode_batch`` text by text.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import text_slices, worker_state

SLICE_BYTES = 8 << 20
MAX_PIECES = 300_000      # pieces kept between batches, per Python worker
MAX_PIECE_CHARS = 48      # longer pieces are encoded, not kept
ENCODE = 1 << 14          # pieces that the library encodes at a time: its results take far more room than the ids

LETTER, DIGIT, MARK, QUOTE, SPACE, LINE, BLANK, HIGH, OTHER = range(1, 10)


def _byte_classes() -> np.ndarray:
    c = np.full(256, OTHER, np.uint8)
    c[:33] = BLANK                              # white space and control characters
    c[32], c[10], c[39] = SPACE, LINE, QUOTE
    for b in range(33, 127):
        ch = chr(b)
        if ch.isalpha():
            c[b] = LETTER
        elif ch.isdigit():
            c[b] = DIGIT
        elif ch not in "'|<>":                  # these occur inside special tokens
            c[b] = MARK
    c[128:] = HIGH
    return c


def _cut_table() -> np.ndarray:
    """[previous class, class]: a token always ends between the two bytes."""
    t = np.zeros((16, 16), bool)
    for prev in (LETTER, DIGIT, MARK, QUOTE, OTHER):
        t[prev, [SPACE, LINE, BLANK]] = True
    for prev in (LETTER, DIGIT):
        t[prev, [MARK, QUOTE]] = True
    t[LETTER, DIGIT] = t[DIGIT, LETTER] = t[MARK, LETTER] = t[MARK, DIGIT] = True
    return t.ravel()


_CLASS, _CUT = _byte_classes(), _cut_table()
_SOLID = np.isin(np.arange(256), (LETTER, DIGIT, MARK, QUOTE, OTHER))


def sure_cuts(data: np.ndarray) -> np.ndarray:
    """Per byte of UTF-8 text: a token always begins here. The first byte does, and one place past the end."""
    cuts = np.ones(len(data) + 1, bool)
    if len(data) < 2:
        return cuts
    c = _CLASS[data]
    cut = cuts[1:-1]
    np.take(_CUT, (c[:-1] << 4) | c[1:], out=cut)
    # a space after a character beyond ASCII, unless that may itself be white space
    at = np.flatnonzero((c[:-1] == HIGH) & (c[1:] == SPACE)) + 1
    at = at[at >= 3]
    lead, last = data[at - 2], data[at - 1]
    far = (data[at - 3] >= 0xE1) & (data[at - 3] <= 0xE3)
    cut[at[~(far | ((lead == 0xC2) & ((last == 0x85) | (last == 0xA0))))] - 1] = True
    # a single line end before an ASCII character that is not white space
    at = np.flatnonzero(c[1:-1] == LINE) + 1
    cut[at[_SOLID[c[at - 1]] & _SOLID[c[at + 1]]]] = True
    return cuts


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _sure_cuts_hold(spec: dict) -> bool:
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    return (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
            and not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")
            and all(sure_cuts(np.frombuffer(t["content"].encode(), np.uint8)).sum() == 2
                    and not (t["single_word"] or t["lstrip"] or t["rstrip"])
                    for t in spec.get("added_tokens", [])))


def _byte_symbols() -> dict[str, int]:
    """The character by which a byte-level vocabulary spells each byte."""
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _bytes_by_id(spec: dict, tok: Tokenizer) -> np.ndarray | None:
    """How many bytes of text each id stands for, or None where the vocabulary does not tell: every byte needs an
    entry, so that none goes unknown, and every entry must spell its bytes and nothing else."""
    model, vocab = spec["model"], tok.get_vocab(with_added_tokens=True)
    if (not all(c in model["vocab"] for c in _byte_symbols())
            or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
            or not all(t["content"].isascii() for t in spec.get("added_tokens", []))):
        return None
    sizes = np.zeros(max(vocab.values()) + 1, np.int64)
    sizes[list(vocab.values())] = [len(s) for s in vocab]
    return sizes


def _raw(texts: pa.Array):
    """(edges, bytes) of a string array: text i has bytes edges[i] to edges[i + 1]."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if edges[0] == edges[-1]:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    return edges - edges[0], np.frombuffer(texts.buffers()[2], np.uint8)[edges[0]:edges[-1]]


def _strings(edges: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(data))


class TextEncoder:
    """Encodes Arrow string arrays; one per worker and tokenizer file.

    With ``run_bytes`` the library gets new pieces joined to texts of about that size, which takes it less time than a
    text for each: where one piece may follow another with a sure cut between them, the ids of the whole are those of
    the pieces in order, and the bytes they stand for tell them apart."""

    def __init__(self, path: str, run_bytes: int = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.cuts = _sure_cuts_hold(spec)
        self.run_bytes = run_bytes
        self.id_bytes = _bytes_by_id(spec, self.tok) if run_bytes and self.cuts else None
        self.dtype = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        self.slots: dict[str, int] = {}
        self.pool = np.zeros(1 << 20, self.dtype)
        self.starts = np.zeros(1 << 18, np.int64)
        self.lens = np.zeros(1 << 18, np.int64)
        self.n_slots = self.n_pool = 0

    def _add(self, pieces: pa.Array) -> int:
        """Encode ``pieces`` into consecutive slots; the first slot's number."""
        first = self.n_slots
        for k in range(0, len(pieces), ENCODE):
            self._append(pieces.slice(k, ENCODE))
        return first

    def _append(self, pieces: pa.Array):
        edges, data = _raw(pieces)
        begins = np.ones(len(pieces), bool)
        if self.id_bytes is not None:
            begins = ~sure_cuts(data)[edges[:-1]]
            begins[1:] |= np.diff(edges[:-1] // self.run_bytes) > 0
            begins[0] = True
        runs = _strings(np.append(edges[:-1][begins], edges[-1]), data).to_pylist()
        got = [e.ids for e in self.tok.encode_batch_fast(runs, add_special_tokens=False)]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        first, n, total = self.n_slots, len(pieces), int(lens.sum())
        ids = np.fromiter(chain.from_iterable(got), self.dtype, total)
        if len(runs) < n:
            upto = np.cumsum(self.id_bytes[ids])
            last = np.searchsorted(upto, edges[1:])
            if upto[-1] != edges[-1] or not np.array_equal(upto[last], edges[1:]):
                raise ValueError("ids do not stand for the bytes they were made from")
            lens = np.diff(last, prepend=-1)
        while self.n_pool + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + n > len(self.lens):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lens = np.concatenate([self.lens, np.zeros_like(self.lens)])
        self.pool[self.n_pool:self.n_pool + total] = ids
        self.lens[first:first + n] = lens
        self.starts[first:first + n] = self.n_pool + np.cumsum(lens) - lens
        self.n_slots, self.n_pool = first + n, self.n_pool + total

    def _slice(self, texts: pa.Array):
        if not self.cuts:
            got = [e.ids for e in self.tok.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            ends = np.cumsum([0, *map(len, got)])
            return np.fromiter(chain.from_iterable(got), self.dtype, int(ends[-1])), ends
        edges, data = _raw(texts)
        if not len(data):
            return np.zeros(0, self.dtype), edges
        cuts = sure_cuts(data)
        cuts[edges] = True
        marks = np.flatnonzero(cuts)
        words = _strings(marks, data).dictionary_encode()
        names, slots = words.dictionary, self.slots
        at = np.fromiter((slots.get(w, -1) for w in names.to_pylist()), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        keep = new[:max(MAX_PIECES - len(slots), 0)]
        keep = keep[pc.utf8_length(names.take(keep)).to_numpy() <= MAX_PIECE_CHARS]
        if len(keep):
            kept = names.take(keep)
            at[keep] = self._add(kept) + np.arange(len(keep))
            slots.update(zip(kept.to_pylist(), at[keep].tolist()))
        bound = self.n_slots, self.n_pool      # what follows is dropped after this slice
        rest = np.flatnonzero(at < 0)
        if len(rest):
            at[rest] = self._add(names.take(rest)) + np.arange(len(rest))
        slot = at[np.asarray(words.indices)]
        lens = self.lens[slot]
        stops = np.cumsum(lens)
        ids = self.pool[np.repeat(self.starts[slot] - (stops - lens), lens) + np.arange(int(stops[-1]))]
        self.n_slots, self.n_pool = bound
        return ids, np.concatenate([[0], stops])[np.searchsorted(marks, edges)]

    def encode(self, texts: pa.Array, slice_bytes: int | None = None):
        """(ids of all texts in order, ends: text i has ids[ends[i]:ends[i + 1]]); null is the empty text. Pieces are
        looked up over ``slice_bytes`` of text at a time: less takes less memory and meets more pieces again."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        sizes = np.asarray(pc.binary_length(texts))
        out, ends, total = [], [np.zeros(1, np.int64)], 0
        for a, b in text_slices(sizes, slice_bytes or SLICE_BYTES):
            ids, e = self._slice(texts.slice(a, b - a))
            out.append(ids)
            ends.append(e[1:] + total)
            total += len(ids)
        return (np.concatenate(out) if out else np.zeros(0, self.dtype)), np.concatenate(ends)


def encoder(path: str, run_bytes: int = 0) -> TextEncoder:
    return worker_state(("encoder", path, run_bytes), lambda: TextEncoder(path, run_bytes))


class Pool:
    """Byte strings by number, joined in bulk."""

    def __init__(self, parts: list[bytes]):
        self.lens = np.fromiter(map(len, parts), np.int64, len(parts))
        self.starts = np.cumsum(self.lens) - self.lens
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def join(self, ids: np.ndarray):
        """(bytes of all ids in order, end of each id's bytes)."""
        lens = self.lens[ids]
        stops = np.cumsum(lens)
        total = int(stops[-1]) if len(stops) else 0
        return self.data[np.repeat(self.starts[ids] - (stops - lens), lens) + np.arange(total)], stops


def _token_bytes(path: str) -> Pool:
    tok = Tokenizer.from_file(path)
    byte_of = _byte_symbols()
    vocab = tok.get_vocab(with_added_tokens=True)
    parts = [b""] * (max(vocab.values()) + 1)
    for s, i in vocab.items():
        # a character that stands for no byte makes the library use the token's own text
        parts[i] = bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
    return Pool(parts)


def token_bytes(path: str) -> Pool:
    """The bytes of every id of a byte-level tokenizer, for decoding in bulk."""
    return worker_state(("token_bytes", path), lambda: _token_bytes(path))


def id_decimals(path: str) -> Pool:
    """Every id in decimal with a comma."""
    n = encoder(path).tok.get_vocab_size()
    return worker_state(("decimals", path), lambda: Pool([b"%d," % i for i in range(n)]))
