import hashlib
import random

import pytest
from llm_texts import no_docs, odd_docs  # noqa: F401

from revlens.llm import line_dedup
from revlens.llm.line_dedup import drop_repeated_lines

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def brute(rows):
    """(id, text) -> sorted (id, lines, dropped, text) by Python strings; the last of equal rows holds the line."""
    def order(i):
        d, t = rows[i]
        return (d is not None, d or 0), t
    holders = {}
    for i, (_, t) in enumerate(rows):
        for k in {key_of(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders.setdefault(k, set()).add(i)
    last = {k: max(v, key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i)) for k, v in holders.items()
            if len(v) >= 3}
    out = []
    for i, (d, t) in enumerate(rows):
        lines = (t or "").split("\n")
        kept = [x for x in lines if last.get(key_of(x), i) == i]
        out.append((d, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    return sorted(out, key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in drop_repeated_lines(df, **more).collect()), key=repr)


def lines_table(seed=3):
    rng = random.Random(seed)
    shared = [f"Shared line number {i} of the notice ÄÖ" for i in range(30)]
    rows = []
    for d in range(300):
        own = [rng.choice([f"only document {d} holds line {j} here", "short", "", "   "]) for j in range(rng.randint(0, 8))]
        common = [rng.choice([s, s.upper().replace("ÄÖ", "ÄÖ"), f"\t {s} \r"]) for s in rng.sample(shared, rng.randint(0, 4))]
        if d % 3 == 0:
            common.append("THE LINE THAT A THIRD OF ALL DOCUMENTS HOLD")
        own += common
        rng.shuffle(own)
        rows.append((d, "\n".join(own)))
    rows += [(400, "nineteen chars line"), (401, "nineteen chars line"), (402, "nineteen chars line"),
             (403, "twenty characters li"), (404, "twenty characters LI  "), (405, "twenty characters li\nx"),
             (410, "ü" * 20), (411, "ü" * 20), (412, "ü" * 20), (413, "ü" * 19), (414, "ü" * 19), (415, "ü" * 19),
             (420, "two documents only hold it"), (421, "two documents only hold it\ntwo documents only hold it"),
             (430, None), (431, ""), (432, "\n\n")]
    return rows


def test_equals_brute_force(spark):
    rows = lines_table()
    assert run(spark, rows) == brute(rows)


def test_saturated_filter_changes_nothing(spark, monkeypatch):
    rows = lines_table(4)
    monkeypatch.setattr(line_dedup, "PART_BITS", 5)          # a few bits for hundreds of keys
    assert run(spark, rows, max_bits=8) == brute(rows)


def test_filter_in_several_parts(spark, monkeypatch):
    rows = lines_table(5)
    monkeypatch.setattr(line_dedup, "PART_BITS", 9)
    monkeypatch.setattr(line_dedup, "FLUSH", 50)
    assert run(spark, rows) == brute(rows)


def test_filter_holds_every_repeat_and_few_others(spark):
    rows = spark.range(20_000).selectExpr("array(xxhash64(id), xxhash64(id % 500, 'x')) as h1")
    bits, parts = line_dedup.seen_again(rows)
    assert bits == line_dedup.PART_BITS and len(parts) == 1
    got = spark.range(500).selectExpr("array(xxhash64(id, 'x')) as h1").union(
        spark.range(20_000).selectExpr("array(xxhash64(id)) as h1"))
    got = got.selectExpr("0L as id", "0L as k", "0L as row", "h1", "h1 as h2")
    hits = got.mapInArrow(line_dedup._suspects(bits, spark.sparkContext.broadcast(parts)),
                          "id long, k long, row long, h1 long, h2 long").count()
    assert 500 <= hits < 520


def test_repeated_rows_and_ids(spark):
    line = "a line that is long enough"
    got = run(spark, [(7, line)] * 3)                        # equal rows: one of them keeps it
    assert sorted(t for *_, t in got) == ["", "", line]
    got = run(spark, [(None, line + "\nx"), (None, line + "\ny"), (1, line)])
    assert (1, 1, 0, line) in got and (None, 2, 1, "x") in got and (None, 2, 1, "y") in got
    got = run(spark, [(None, line)] * 4)
    assert sorted(t for *_, t in got) == ["", "", "", line]
    got = run(spark, [(5, line + "\nx"), (5, line + "\ny"), (3, line)])
    assert sum(t.startswith(line) for *_, t in got) == 1 and (3, 1, 1, "") in got


def test_odd_rows_and_columns(spark, odd_docs, no_docs):
    got = drop_repeated_lines(odd_docs)
    assert got.columns == [*odd_docs.columns, "n_lines", "n_dropped"]
    assert got.count() == odd_docs.count()
    texts = {r.doc_id: r.text for r in got.where("doc_id < 100").collect()}
    assert texts == {r.doc_id: r.text for r in odd_docs.where("doc_id < 100").collect()}
    assert drop_repeated_lines(no_docs).count() == 0
    assert drop_repeated_lines(odd_docs, lines_col=None, dropped_col=None).columns == odd_docs.columns


@pytest.mark.parametrize("text, lines", [(None, 1), ("", 1), ("\n", 2)])
def test_query_digest_of_empty_texts(spark, tmp_path, text, lines):
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = line_dedup.op12_line_dedup(spark, str(tmp_path)).first()
    assert (r.n_lines, r.n_dropped, r.kept_sha256) == (lines, 0, hashlib.sha256((text or "").encode()).hexdigest())
