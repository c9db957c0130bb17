import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_texts import SF001, no_docs, odd_docs  # noqa: F401

from revlens.llm import product_quantiser, simhash
from revlens.llm.components import components


class Sets:
    def __init__(self, n):
        self.p = list(range(n))

    def find(self, x):
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self.p[max(x, y)] = min(x, y)


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 180)] + [(5, i) for i in range(6, 60)] + [(7, 7), (None, 3), (3, None)]
    links += [(1000, 900), (900, 950), (950, 1000)] + [(5, 6)] * 3
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 181)} | {i: 5 for i in range(5, 60)} | {i: 900 for i in (900, 950, 1000)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ SimHash

def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [words[i:i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    h = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, bits):
    s, a = Sets(len(fps)), np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= bits):
            s.join(i, i + 1 + int(j))
    groups = defaultdict(set)
    for i, f in enumerate(fps):
        groups[s.find(i)].add(f)
    return sorted(map(sorted, groups.values()))


def near_fingerprints(seed):
    rng = np.random.default_rng(seed)
    out = {0, (1 << 64) - 1, 1 << 63} | {int(x) for x in rng.integers(0, 1 << 63, 25, dtype=np.uint64)}
    for f in list(out):
        for _ in range(30):
            x = f
            for k in rng.integers(0, 64, int(rng.integers(1, 6))):
                x ^= 1 << int(k)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("bits,slice_rows", [(3, 4096), (3, 7), (0, 4096), (2, 50), (5, 4096)])
def test_grid_join_connects_what_is_near(spark, monkeypatch, bits, slice_rows):
    monkeypatch.setattr(simhash, "SLICE_ROWS", slice_rows)
    fps = near_fingerprints(bits)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits).collect()
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= bits for r in got)
    s, at = Sets(len(fps)), {f: i for i, f in enumerate(signed)}
    for r in got:
        s.join(at[r.a], at[r.b])
    groups = defaultdict(set)
    for i, f in enumerate(fps):
        groups[s.find(i)].add(f)
    assert sorted(map(sorted, groups.values())) == brute_groups(fps, bits)


def test_the_embedding_bounds_the_hamming_distance(spark):
    rows = simhash._grid_rows(spark.createDataFrame([(f,) for f in (0, 1, 3, -1, -2)], "fp long"), 3)
    own = {r.fp: 0 for r in rows.collect()}
    for r in rows.where("not query").collect():
        own[r.fp] += bin(0)[2:].count("1") + sum((r.cell >> 2 * s) & 3 for s in range(32))
    assert own == {0: 0, 1: 1, 3: 2, -1: 64, -2: 63}


def test_simhash_of_documents_equals_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect())
    fps = [brute_fingerprint(t) for _, t in docs]
    s, a = Sets(len(fps)), np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= 3):
            s.join(i, i + 1 + int(j))
    want = {d: (format(f, "016x"), docs[s.find(i)][0]) for i, ((d, _), f) in enumerate(zip(docs, fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash(spark, SF001).collect()}
    assert got == want


def test_simhash_of_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    texts = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id not in (None, 101)}
    for d, t in texts.items():
        assert by_id[d][0].fp == int(np.uint64(brute_fingerprint(t)).view(np.int64))
    blank = {by_id[i][0].component_id for i in (0, 1, 2, 3, 102)}
    assert blank == {0} and {r.component_id for r in by_id[100]} == {100}
    assert simhash.near_duplicates(no_docs).count() == 0


# ------------------------------------------------------------------ product quantisation

def brute_cosine(rows, least=0.9):
    fine = [(i, v) for i, v in rows
            if v is not None and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8]
    x = np.array([v for _, v in fine], float)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near, s = x @ x.T >= least, Sets(len(fine))
    for i, j in zip(*np.nonzero(near)):
        s.join(int(i), int(j))
    low = {}
    for k, (i, _) in enumerate(fine):
        low[s.find(k)] = min(low.get(s.find(k), i), i)
    out = {i: (0, i) for i, _ in rows}
    return out | {i: (int(near[k].sum()) - 1, low[s.find(k)]) for k, (i, _) in enumerate(fine)}


@pytest.mark.parametrize("list_rows,slice_rows", [(2048, 4096), (20, 9)])
def test_vector_links_equal_brute_force(spark, monkeypatch, list_rows, slice_rows):
    monkeypatch.setattr(product_quantiser, "LIST_ROWS", list_rows)
    monkeypatch.setattr(product_quantiser, "SLICE_ROWS", slice_rows)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    vectors = [(c + rng.normal(scale=s, size=8)).tolist() for c in centres for s in (0.05, 0.2, 0.4) for _ in range(8)]
    vectors += [vectors[0]] * 30 + [[1e-300] * 8, [1e300] * 8, [-1.0] * 8]
    rows = [(1000 - i, v) for i, v in enumerate(vectors)]
    rows += [(5000, None), (5001, [0.0] * 8), (5002, [1.0] * 7 + [float("nan")]), (5003, [None] + [1.0] * 7),
             (5004, [float("inf")] + [1.0] * 7), (5005, [1.0] * 3), (5006, [])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                                  "vec_id long, embedding array<double>, v string, rep int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in product_quantiser.near_duplicates(table).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute_cosine(rows).items()}


def test_vectors_of_no_rows_and_of_none_valid(spark):
    schema = "vec_id long, embedding array<float>"
    assert product_quantiser.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = product_quantiser.near_duplicates(spark.createDataFrame([(1, None), (None, [0.0, 0.0])], schema)).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in rows} == {(1, 0, 1), (None, 0, None)}


def test_probes_reach_every_near_pair():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16))
    x = np.concatenate([x, x[:300] + rng.normal(scale=0.1, size=(300, 16))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, reach = product_quantiser.Quantiser(x, 24, 4), np.sqrt(0.2) / 2
    home, probed = q.probes(x, reach)
    i, j = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    assert len(i) and (probed[i, home[j]] | probed[j, home[i]]).all()


def test_vectors_without_ids_and_with_shared_ids(spark):
    schema = "vec_id long, embedding array<double>"
    near = product_quantiser.near_duplicates
    rows = near(spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.01]), (7, [1.0, 0.02]), (9, [0.0, 1.0]),
                                       (None, [-1.0, 0.0])], schema)).collect()
    assert sorted(map(repr, [(r.vec_id, r.n_links, r.component_id) for r in rows])) == sorted(map(repr, [
        (None, 2, 7), (None, 2, 7), (7, 2, 7), (9, 0, 9), (None, 0, None)]))
    rows = near(spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [0.01, 1.0])], schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows) == [
        (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (5, 1, 5, True)]


def test_vectors_of_every_dimension_are_compared(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.01, 0.0]),
            (6, [1.0, 0.0, 0.0]), (7, [0.5]), (8, [2.0]), (9, [-1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in product_quantiser.near_duplicates(table).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (2, 4, True), 5: (2, 4, False),
                   6: (2, 4, False), 7: (1, 7, True), 8: (1, 7, False), 9: (0, 9, True)}


def vectors_in_groups(seed, n, dim):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 10, dim))
    x = np.repeat(centres, 7, axis=0) + rng.normal(scale=0.3, size=(n // 10 * 7, dim))
    return np.concatenate([x, rng.normal(size=(n - len(x), dim))])


@pytest.mark.parametrize("kind,list_rows,slice_rows,partitions", [("float", 8, 60, 8), ("double", 80, 50, 2)])
def test_vectors_in_blocks_of_lists_equal_brute_force(spark, monkeypatch, kind, list_rows, slice_rows, partitions):
    """Blocks of several lists, and lists of several blocks."""
    monkeypatch.setattr(product_quantiser, "LIST_ROWS", list_rows)
    monkeypatch.setattr(product_quantiser, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(product_quantiser, "PROBE_ROWS", 5)
    monkeypatch.setattr(product_quantiser, "EXACT_BYTES", 200)
    x = vectors_in_groups(8, 400, 8).astype(np.float32 if kind == "float" else np.float64).astype(float)
    rows = [(int(i), v.tolist()) for i, v in zip(np.random.default_rng(9).permutation(len(x)), x)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(2)
        got = {r.vec_id: (r.n_links, r.component_id) for r in product_quantiser.near_duplicates(table).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute_cosine(rows)
    assert got == want and sum(n for n, _ in want.values()) > 500


def test_a_class_is_placed_once_however_many_lists_it_probes(spark, monkeypatch):
    """It was stored with its vector, and handed to Arrow, once per list."""
    counts = {}

    def counted(session, df, name, *more, store=product_quantiser.stored):
        out = store(session, df, name, *more)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(product_quantiser, "stored", counted)
    monkeypatch.setattr(product_quantiser, "LIST_ROWS", 10)
    x = np.random.default_rng(10).normal(size=(500, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert product_quantiser.near_duplicates(table).count() == 500
    assert counts["placed-vectors"] == counts["vector-classes"] == 500


def placed(n, dim, list_rows):
    x = vectors_in_groups(11, n, dim)
    q = product_quantiser.Quantiser(x / np.linalg.norm(x, axis=1)[:, None], n // list_rows)
    raw = pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(np.arange(n)), pa.array([1] * n)],
                                     names=["v", "rep", "n"])
    return q, pa.Table.from_batches(product_quantiser._place(q, np.sqrt(0.2) / 2, dim, np.float64)([raw])).combine_chunks() \
        .to_batches()[0]


def test_blocks_are_bounded_and_every_two_that_touch_meet_once():
    q, rows = placed(3000, 16, 40)
    sizes = Counter(rows.column("home").to_pylist())
    for most in (20, 100, 700, 5000):
        blocks = product_quantiser.Blocks(q, sizes, most)
        own = blocks.of(rows.column("home").to_numpy(), rows.column("rep").to_numpy())
        held = np.bincount(own, minlength=blocks.count)
        assert len(held) == blocks.count <= 2 * 3000 / most + len(sizes) * (most < 100) + 1
        assert held.max() <= most if most > max(sizes.values()) else held.max() < 2 * most
        pairs = pa.Table.from_batches(product_quantiser._touching(blocks)([rows]))
        touching = sorted({*zip(pairs["a"].to_pylist(), pairs["b"].to_pylist())})
        assert {(k, k) for k in own.tolist()} <= set(touching) and all(a <= b for a, b in touching)
        task = np.full((blocks.count, blocks.count), -1)
        for k, (a, b) in enumerate(touching):
            task[a, b] = k
        dealt = list(product_quantiser._deal(blocks, task)([rows]))
        assert max(b.num_rows for b in dealt) <= 2 * 3000                  # no batch grows with the lists or blocks
        met = Counter(r for b in dealt for r in zip(b.column("task").to_pylist(), b.column("coded").to_pylist(),
                                                    b.column("rep").to_pylist()))
        assert set(met.values()) == {1}
        where = dict(zip(rows.column("rep").to_pylist(), own.tolist()))
        assert len(met) == sum(held[a] + held[b] for a, b in touching)
        assert all(touching[t][0 if coded else 1] == where[rep] for t, coded, rep in met)
