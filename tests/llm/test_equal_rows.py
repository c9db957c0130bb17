"""Rows without an id, rows that share one and equal rows in the operators that compare documents; many spans in a text;
the package as a zip."""

import random
import shutil
import subprocess
import sys
import time
import zipfile
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
import revlens
from revlens.llm import pii, sentence_spans
from revlens.llm.quality_classifier import classify

WORDS = [f"word{i}" for i in range(400)]


def passage(seed, sentences=60):
    rng = random.Random(seed)
    return " ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(6, 12))) + "." for _ in range(sentences))


def left(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(((r.doc_id, r.text) for r in sentence_spans.remove_repeats(df).collect()), key=repr)


def test_spans_of_rows_without_ids_of_their_own(spark):
    common = passage(1)
    rows = [(None, passage(2) + "\n" + common), (None, passage(3) + "\n" + common), (5, passage(4) + "\n" + common),
            (5, passage(5) + "\n" + common), (9, passage(6))]
    got = left(spark, rows)
    whole = [t for _, t in got if common[200:-200] in t]
    assert len(whole) == 1 and next(d for d, t in got if common[200:-200] in t) == 5
    assert sum(len(t) for _, t in got) < sum(len(t) for _, t in rows) - 2.8 * len(common)
    # with ids of their own the smallest keeps it
    apart = left(spark, [(i, t) for i, (_, t) in enumerate(rows)])
    assert [d for d, t in apart if common[200:-200] in t] == [0]


def test_equal_rows_lose_their_spans(spark):
    text = passage(7)
    for doc_id in (None, 3):
        got = [t for _, t in left(spark, [(doc_id, text)] * 3 + [(8, passage(8))])]
        assert got.count(text) == 1 and sum(len(t) < 100 for t in got) == 2


def test_packed_hashes_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 4000):
        v = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint64)).astype(np.uint32)
        assert sentence_spans._values(sentence_spans._planes(v)).tolist() == v.tolist()


@pytest.mark.parametrize("flush", [50, 1 << 21])
def test_bit_table_holds_what_several_texts_hold(spark, monkeypatch, flush):
    monkeypatch.setattr(sentence_spans, "FLUSH", flush)
    rows = spark.range(3000).selectExpr("array(xxhash64(id), xxhash64(id % 40, 'x'), xxhash64(id, 'y')) as h1",
                                        "array(false, false, true) as again", "array(0, 0, 0) as step").repartition(4)
    bits, table = sentence_spans._bit_table(spark, rows)
    def held(q):
        h = np.array([r[0] for r in q.collect()], np.int64).view(np.uint64) >> np.uint64(64 - bits)
        return (table[(h >> np.uint64(3)).astype(int)] >> (h & np.uint64(7)).astype(np.uint8)) & 1
    assert held(spark.range(40).selectExpr("xxhash64(id, 'x')")).all()
    assert held(spark.range(3000).selectExpr("xxhash64(id)")).sum() < 10


def test_classifier_on_equal_rows(spark):
    text = passage(9, 12)
    got = classify(spark.createDataFrame([(1, text)] * 20_000, "doc_id long, text string"))
    assert got.count() == 20_000 and got.select("p_good").distinct().count() == 1


def test_one_row_per_group_of_near_copies(spark):
    def kept(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string, k1 string").repartition(3)
        return Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    a, b, c = passage(10, 20), passage(11, 20), passage(12, 20)
    assert kept([(None, a, "x")] * 3) == Counter([(None, a)])
    assert kept([(4, b, "x")] * 3) == Counter([(4, b)])
    assert kept([(None, a, "x"), (7, a, "x"), (7, c, "x"), (7, a, "y"), (9, b, "x")]) == Counter([(7, a), (7, c), (9, b)])
    assert kept([(None, None, "x"), (2, "", "x"), (1, " ", "x")]) == Counter([(1, " ")])


def test_many_spans_in_one_text():
    text = "\n".join(f"call (555) 010-{i % 10000:04d} or 555-0{i % 1000:03d}-{i % 10000:04d} today" for i in range(100_000))
    start = time.perf_counter()
    got = pii.find_spans(text)
    assert len(got) >= 100_000 and time.perf_counter() - start < 30
    small = pii.find_spans(text[:20_000])
    assert small[:-2] == [s for s in got if s[2] <= 20_000][:len(small) - 2]


def test_known_licenses_of_a_zip(tmp_path):
    folder = Path(revlens.__file__).parent
    with zipfile.ZipFile(tmp_path / "package.zip", "w") as z:
        for f in folder.rglob("*"):
            if f.suffix in (".py", ".txt"):
                z.write(f, f"revlens/{f.relative_to(folder)}")
    code = "from revlens.llm.licenses import known_texts; print(len(known_texts()))"
    count = [int(subprocess.run([sys.executable, "-c", code], env={"PYTHONPATH": str(p), "PATH": "/usr/bin:/bin"}, cwd=tmp_path,
                                capture_output=True, text=True, check=True).stdout) for p in (tmp_path / "package.zip", folder.parent)]
    assert count[0] == count[1] > 250
    bare = tmp_path / "bare"
    shutil.copytree(folder, bare / "revlens", ignore=shutil.ignore_patterns("MPL-2.0.txt", "__pycache__"))
    lost = subprocess.run([sys.executable, "-c", code], env={"PYTHONPATH": str(bare), "PATH": "/usr/bin:/bin"}, cwd=tmp_path,
                          capture_output=True, text=True)
    assert lost.returncode and "MPL-2.0" in lost.stderr
