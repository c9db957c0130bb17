import itertools
import json
import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_texts import ODD_TEXTS, SF001, no_docs, odd_docs  # noqa: F401
from tokenizers import Tokenizer

from revlens.llm import bpe_chunks, packing, token_file, tokens
from revlens.llm.tokens import TextEncoder, default_tokenizer, id_decimals, sure_cuts, token_bytes

PATH = default_tokenizer()
MINE, LIBRARY = TextEncoder(PATH), Tokenizer.from_file(PATH)
JOINING = TextEncoder(PATH, 1 << 14)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


@pytest.fixture(scope="module")
def mine():
    return MINE


def ids_of(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_encode(mine, library, texts):
    ids, ends = mine.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == ids_of(library, texts)


SPACES = " \n\t\r\x0b\x0c\x1c\u0085  　"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aZé日9'st.,|<>!#" + SPACES, max_size=40), max_size=8))
def test_encoder_equals_library(texts):
    check_encode(MINE, LIBRARY, texts)


def test_encoder_on_odd_texts(mine, library):
    check_encode(mine, library, ODD_TEXTS)
    check_encode(mine, library, [])


def test_encoder_keeps_within_its_bounds(library, monkeypatch):
    from revlens.llm import tokens
    monkeypatch.setattr(tokens, "MAX_PIECES", 5)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 50)
    enc = TextEncoder(PATH)
    rng = random.Random(2)
    texts = [" ".join(str(rng.random()) for _ in range(30)) for _ in range(20)]
    check_encode(enc, library, texts)
    assert len(enc.slots) <= 5


def test_token_file_hands_new_pieces_over_in_runs(library, monkeypatch):
    """Words met for the first time go to the library as a few long texts, not as a text each."""
    class Counted:
        texts = 0

        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, texts, **kw):
            Counted.texts += len(texts)
            return library.encode_batch_fast(texts, **kw)

    def counted(*args):
        enc = TextEncoder(*args)
        enc.tok = Counted()
        return enc

    monkeypatch.setattr(token_file, "encoder", counted)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdeé", k=9)) + rng.choice(["", ",", "!", "7"]) for _ in range(100))
             for _ in range(50)]
    docs = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(texts)], names=["doc_id", "text"])
    rows = [r for b in token_file._encode(PATH, 2)(iter([docs])) for r in b.to_pylist() if r["seq"] >= 0]
    assert [np.frombuffer(r["ids"], np.uint16).tolist() for r in rows] == [ids + [2] for ids in ids_of(library, texts)]
    assert 0 < Counted.texts < 1000


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aZé日9'st.,|<>!#" + SPACES, min_size=1, max_size=8), min_size=1, max_size=12))
def test_pieces_in_runs_equal_pieces_alone(pieces):
    """Whatever pieces of texts are put together, in whatever order, each has the ids it has alone."""
    enc = JOINING
    bound = enc.n_slots, enc.n_pool
    first = enc._add(pa.array(pieces, pa.large_string()))
    got = [enc.pool[enc.starts[k]:enc.starts[k] + enc.lens[k]].tolist() for k in range(first, first + len(pieces))]
    enc.n_slots, enc.n_pool = bound
    assert got == ids_of(LIBRARY, pieces)


def small_tokenizer(path, symbols, **changes):
    """A byte-level tokenizer with no merges but one over ``symbols``."""
    spec = json.load(open(PATH))
    spec["model"] |= {"vocab": {s: i for i, s in enumerate(symbols)}, "merges": [["a", "b"]]} | changes
    spec["added_tokens"] = []
    path.write_text(json.dumps(spec))
    return str(path)


@pytest.mark.parametrize("case", ["whole alphabet", "a byte missing", "a byte unknown"])
def test_runs_are_left_where_bytes_do_not_tell(tmp_path, case):
    """Ids that drop or replace bytes cannot be told apart by them: the pieces then go to the library one by one."""
    symbols, changes = [*tokens._byte_symbols(), "ab", "[?]"], {}
    if case != "whole alphabet":
        symbols.remove("c")
    if case == "a byte unknown":
        changes = {"unk_token": "[?]"}
    path = small_tokenizer(tmp_path / "small.json", symbols, **changes)
    enc = TextEncoder(path, token_file.RUN_BYTES)
    assert enc.cuts and (enc.id_bytes is not None) == (case == "whole alphabet")
    check_encode(enc, Tokenizer.from_file(path), ["ab cab c cc é日 abc ab", "c", "", None, "ab\ncc, c7c 7c."] * 3)


def test_other_kinds_go_text_by_text(tmp_path, library):
    spec = json.load(open(PATH))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    other = tmp_path / "prefix.json"
    other.write_text(json.dumps(spec))
    enc = TextEncoder(str(other))
    assert not enc.cuts
    check_encode(enc, Tokenizer.from_file(str(other)), ["a b", "", None, " c"])


def test_sure_cuts_begin_and_end():
    assert sure_cuts(np.zeros(0, np.uint8)).tolist() == [True]
    assert sure_cuts(np.frombuffer(b"a b", np.uint8)).tolist() == [True, True, False, True]


def test_token_bytes_decode(mine, library):
    text = "naïve 日本 <|endoftext|>\x00 end"
    ids = np.array(library.encode(text, add_special_tokens=False).ids)
    assert token_bytes(PATH).join(ids)[0].tobytes().decode() == library.decode(ids.tolist(), skip_special_tokens=False)
    assert id_decimals(PATH).join(ids)[0].tobytes().decode() == "".join(f"{i}," for i in ids)


# ------------------------------------------------------------------ packing

def test_plan_uses_every_piece_once_and_fills_bins():
    rng = np.random.default_rng(4)
    for _ in range(20):
        hist = {int(n): int(c) for n, c in zip(rng.integers(1, 65, 30), rng.integers(1, 9, 30))}
        used = {}
        for times, need in packing.plan_bins(hist, 64):
            assert sum(n * k for n, k in need.items()) <= 64
            for n, k in need.items():
                used[n] = used.get(n, 0) + k * times
        assert used == hist


def brute_fullest(items, room):
    sums = {0}
    for n in items:
        sums |= {s + n for s in sums if s + n <= room}
    return max(sums)


def test_fullest_combination_equals_enumeration():
    rng = random.Random(7)
    for _ in range(200):
        counts = {n: rng.randint(1, 3) for n in rng.sample(range(1, 40), rng.randint(1, 8))}
        room = rng.randint(0, 60)
        got = packing._fullest(sorted(counts, reverse=True), counts, room)
        assert sum(got) == brute_fullest([n for n, c in counts.items() for _ in range(c)], room)
        assert all(got.count(n) <= counts[n] for n in got)


def check_packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_packing_of_documents(spark, library):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = packing.op4_packing(spark, SF001).collect()
    bins = check_packed(rows, 2048)
    assert len(bins) <= 1.02 * sum(r.length for r in rows) / 2048 + 1
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, ids_of(library, texts.values())))
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == want.keys()
    for doc, own in pieces.items():
        ids, at = np.array(want[doc] + [0], "<u4"), 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_of_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 3)
    rows = packing.pack_documents(odd_docs).collect()
    check_packed(rows, 2048)
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd_docs.collect()}
    assert sum(r.piece == 0 for r in rows) == odd_docs.count()
    assert packing.pack_documents(no_docs).count() == 0
    same = spark.createDataFrame([(1, 0, 7, "x")] * 50, "doc_id long, piece int, length long, p_length string")
    packed = packing.pack(same, capacity=21)
    check_packed(packed.collect(), 21)
    assert packed.select("sequence_id").distinct().count() == 17 and "p_length" in packed.columns
    with pytest.raises(ValueError):
        packing.pack(same, capacity=5)


# ------------------------------------------------------------------ token file

def test_code_lengths_are_prefix_free_and_near_entropy():
    rng = np.random.default_rng(1)
    for n, size in ((1, 1), (2, 5), (5, 100), (300, 5000), (40_000, 400_000)):
        weights = 1 / np.arange(1, n + 1)
        ids = rng.choice(n, size, p=weights / weights.sum())
        counts = np.bincount(ids)
        used = np.flatnonzero(counts)
        bits = token_file.code_lengths(counts[used])
        assert (2.0 ** -bits).sum() <= 1 + 1e-12 and bits.max() <= max(token_file.MAX_BITS, 16)
        share = counts[used] / size
        assert (share * bits).sum() <= max(-(share * np.log2(share)).sum() + 1, 1)
        book = token_file.CodeBook(used, bits)
        blocks = [ids[i:i + 70_000] for i in range(0, size, 70_000)] + [ids[:0]]
        packed = [book.pack(b) for b in blocks]
        got = book.unpack([p for p, _ in packed], [m for _, m in packed], [len(b) for b in blocks])
        assert all((a == b).all() for a, b in zip(got, blocks))


def test_code_lengths_obey_the_limit():
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    bits = token_file.code_lengths(np.array(fibonacci), 8)
    assert bits.max() == 8 and (2.0 ** -bits).sum() <= 1


def check_file(rows, docs, library):
    """docs in file order; rows of the same id may stand in either order of their texts."""
    at = 0
    rows = sorted(rows, key=lambda r: r.start)
    assert len(rows) == len(docs)
    left = {}
    for doc, text in docs:
        left.setdefault(doc, []).append(ids_of(library, [text])[0] + [2])
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        left[r.doc_id].remove(list(r.ids))
        at += r.n_tokens


def test_token_file_round_trip(spark, library, odd_docs, no_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK_IDS", 500)
    monkeypatch.setattr(token_file, "MARK_IDS", 64)
    for name, docs in (("sf", spark.read.parquet(f"{SF001}/documents.parquet")), ("odd", odd_docs)):
        path = f"{tmp_path}/{name}"
        token_file.write_token_file(docs, path)
        check_file(token_file.read_token_file(spark, path).collect(),
                   [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], library)
    token_file.write_token_file(no_docs, f"{tmp_path}/none")
    assert token_file.read_token_file(spark, f"{tmp_path}/none").count() == 0


# ------------------------------------------------------------------ chunk reuse

def brute_digests(library, text):
    import hashlib
    ids = ids_of(library, [text])[0]
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_chunk_reuse_equals_library(spark, library, odd_docs, no_docs, monkeypatch):
    # small chunks, so that these small texts share many
    monkeypatch.setattr(bpe_chunks, "MASK", (1 << 4) - 1)
    monkeypatch.setattr(bpe_chunks, "MIN_CHUNK", 16)
    monkeypatch.setattr(bpe_chunks, "MAX_CHUNK", 120)
    for docs in (spark.read.parquet(f"{SF001}/documents.parquet"), odd_docs):
        got = sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256)
                     for r in bpe_chunks.encode_decode(docs).collect())
        want = sorted((repr(r.doc_id), *brute_digests(library, r.text)) for r in docs.select("doc_id", "text").collect())
        assert got == want
    assert bpe_chunks.encode_decode(no_docs).count() == 0


def test_chunks_are_shared_across_texts():
    rng = random.Random(3)
    body = " ".join("".join(rng.choice("abcdefgh é") for _ in range(6)) for _ in range(4000)).encode()
    one, two = bpe_chunks.chunk_ends([b"first " + body, b"another beginning " + body])
    cut = lambda t, ends: {t[a:b] for a, b in zip([0, *ends], ends)}
    a, b = cut(b"first " + body, one), cut(b"another beginning " + body, two)
    assert len(a & b) >= 0.8 * min(len(a), len(b)) and all(c.decode() for c in a | b)


def test_joins_are_repaired_at_any_cut(mine, library):
    rng = random.Random(9)
    alphabet = "ab é日'st.,  \n\n\t9<|endoftext|>"
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))
        if rng.random() < 0.3:
            text += "<|endoftext|>" + text
        cuts = sorted({0, len(text), *(rng.randint(0, len(text)) for _ in range(6))})
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        ids, ends = mine.encode(pa.array(parts, pa.string()))
        pieces = [ids[a:b] for a, b in zip(ends, ends[1:])]
        got, _ = bpe_chunks.join_pieces(PATH, [pieces])
        assert got.tolist() == ids_of(library, [text])[0], text


def test_pieces_are_encoded_in_bounded_runs(library):
    class Counted:
        runs = []

        def encode_batch_fast(self, texts, **k):
            self.runs.append(len(texts))
            return LIBRARY.encode_batch_fast(texts, **k)

    many = TextEncoder(PATH)
    many.tok = Counted()
    words = ["".join(w) for w in itertools.product("abcdefghij", repeat=5)][:40_000]
    texts = [" ".join(words[k::100]) for k in range(100)]
    ids, ends = many.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == ids_of(library, texts)
    assert sum(Counted.runs) > 1 << 14 >= max(Counted.runs)
