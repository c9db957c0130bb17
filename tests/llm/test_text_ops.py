import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pytest
from llm_texts import SF001, no_docs, odd_docs  # noqa: F401

import __spark_entry__ as E
from revlens.llm import licenses, pii, quality_classifier, quality_rules, sentence_spans, weak

SF01 = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ weak labels

def test_em_recovers_accuracies_of_independent_rules():
    rng = random.Random(1)
    truth = {"alarm": (0.7, 0.5, 0.6, 0.9), "false": (0.002, 0.001, 0.004, 0.003)}
    counts = Counter()
    for _ in range(20_000):
        good = rng.random() < 0.85
        counts[tuple(-1 if rng.random() < (f if good else a) else 0
                     for a, f in zip(truth["alarm"], truth["false"]))] += 1
    model = weak.fit(sorted(counts.items()), 4)
    assert abs(model.prior - 0.85) < 0.02
    for table, alarm in zip(model.tables, truth["alarm"]):
        assert abs(table[0][0] - alarm) < 0.05 and table[1][0] <= 0.005
    assert model.log_odds((0, 0, 0, 0)) > 0 > model.log_odds((-1, -1, 0, 0))


def plain_em(rows, n_rules, steps=200):
    """EM row by row, beliefs as rows of their own; the posterior of every row."""
    post = [0.1 if min(r) < 0 else 0.95 for r in rows]
    for _ in range(steps):
        share = (sum(post) + weak.STRENGTH * weak.PRIOR) / (len(rows) + weak.STRENGTH)
        odds = [math.log(share / (1 - share))] * len(rows)
        for j in range(n_rules):
            table = {}
            for y, alarm in ((0, weak.ALARM), (1, weak.FALSE_ALARM)):
                believed = {-1: alarm, 1: (1 - alarm) * weak.PRAISE[y]}
                believed[0] = 1 - believed[-1] - believed[1]
                mass = [(p if y else 1 - p) for p in post]
                for v in (-1, 0, 1):
                    n = sum(m for m, r in zip(mass, rows) if r[j] == v)
                    table[y, v] = (n + weak.STRENGTH * believed[v]) / (sum(mass) + weak.STRENGTH)
            odds = [o + math.log(table[1, r[j]] / table[0, r[j]]) for o, r in zip(odds, rows)]
        now = [1 / (1 + math.exp(-o)) for o in odds]
        moved, post = max(abs(a - b) for a, b in zip(now, post)), now
        if moved < 1e-9:
            break
    return post


def planted_votes(seed, n=1500):
    """Rows of rules that err on good rows at very different rates; two of them err together."""
    rng, rows, truth = random.Random(seed), [], []
    for _ in range(n):
        good = rng.random() < 0.8
        careless = -1 if rng.random() < (0.15 if good else 0.6) else 0
        strict = -1 if rng.random() < (0.002 if good else 0.7) else 0
        twin = strict if rng.random() < 0.8 else 0
        praise = (1 if rng.random() < 0.9 else 0) if good else (1 if rng.random() < 0.1 else -1 if rng.random() < 0.5 else 0)
        rows.append((careless, strict, twin, praise))
        truth.append(good)
    return rows, truth


@pytest.mark.parametrize("seed", range(3))
def test_posterior_is_not_all_must_pass(seed):
    rows, truth = planted_votes(seed)
    model = weak.fit(sorted(Counter(rows).items()), 4)
    plain = plain_em(rows, 4)
    got = [1 / (1 + math.exp(-model.log_odds(r))) for r in rows]
    assert max(abs(a - b) for a, b in zip(got, plain)) < 1e-6
    kept = [p >= 0.5 for p in got]
    one_bad = [(k, y) for r, k, y in zip(rows, kept, truth) if r.count(-1) == 1]
    # texts with one bad vote stay when that vote comes from the careless rule: over half of them, most of them good
    assert sum(k for k, _ in one_bad) > len(one_bad) / 2
    assert sum(y for k, y in one_bad if k) > 0.7 * sum(k for k, _ in one_bad)
    wrong = sum(k != y for k, y in zip(kept, truth))
    assert wrong < 0.5 * sum((min(r) >= 0) != y for r, y in zip(rows, truth))


def test_verdict_equals_plain_em(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    votes = quality_rules.rule_votes()
    rows = quality_rules.text_figures(docs).select("doc_id", *[c.alias(k) for k, c in votes.items()]).collect()
    post = plain_em([tuple(r)[1:] for r in rows], len(votes))
    want = {r.doc_id: p >= quality_rules.MIN_POSTERIOR for r, p in zip(rows, post)}
    for r in quality_rules.judge(docs).collect():
        assert r.kept == (not r.base_failed and want[r.doc_id])


def test_em_without_rows_is_even():
    model = weak.fit([], 2)
    assert model.prior == 0.5


def test_too_many_rules_are_refused(spark):
    with pytest.raises(ValueError):
        weak.fit_votes(spark.range(1), [f"r{i}" for i in range(weak.MAX_RULES + 1)])


# ------------------------------------------------------------------ quality rules

def brute_figures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered))


def test_rule_figures_equal_brute_force(spark, odd_docs, no_docs):
    more = spark.createDataFrame([(1, "a b c d e f g h " * 5), (2, "x\nx\n\n x\nx"), (3, "a b c d e f g h i a b c d e f g h"),
                                  (4, "w " * 40)], "doc_id long, text string")
    for docs in (odd_docs, more, spark.read.parquet(f"{SF001}/documents.parquet")):
        cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        got = sorted((repr(r.doc_id), *(r[c] for c in cols), r.base_failed)
                     for r in quality_rules.judge(docs).collect())
        want = sorted((repr(r.doc_id), *f, f[0] < 20 or 100 * f[4] > 30 * f[0])
                      for r in docs.select("doc_id", "text").collect() for f in [brute_figures(r.text)])
        assert got == want
    assert quality_rules.judge(no_docs).count() == 0


def test_rules_reject_junk_and_keep_clean_text(spark):
    rows = {r.doc_id: r for r in quality_rules.op3_quality_rules(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    clean = [rows[x.doc_id] for x in labels if x.quality == 1 and rows[x.doc_id].n_words >= 20]
    junk = [rows[x.doc_id] for x in labels if x.quality == 0]
    assert sum(r.kept for r in clean) >= 0.995 * len(clean)
    assert sum(not r.kept for r in junk) >= 0.95 * len(junk)


def test_native_operators_plan_no_python(spark):
    for docs in (quality_rules.text_figures(spark.read.parquet(f"{SF001}/documents.parquet")),
                 licenses.op9_license_scan(spark, SF001)):
        plan = docs._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


# ------------------------------------------------------------------ licenses

def test_license_scan_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF01}/documents.parquet')")
    cur = con.execute(E.oracle_sql()["op9_license_scan"])
    cols = [d[0] for d in cur.description]
    got = licenses.op9_license_scan(spark, SF01)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(cur.fetchall())


def test_entire_license_texts_are_found_in_any_dress(spark, odd_docs, no_docs):
    mit = licenses.TEXTS["MIT"]
    texts = [mit, "Copyright (c) 2020 Some Body\n\n" + mit.upper(), "© 1999 x\n" + mit.replace("\n", "  \n * "),
             mit.replace("MIT License", "MIT Licence"), mit + " and more", "LICENSED UNDER cc by-nc 4.0", None]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)],
                                 "doc_id long, text string, digest string, license string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [got[i].text_license for i in range(7)] == ["MIT"] * 4 + [None, "CC-BY-NC-4.0", None]
    assert got[5].n_license_lines == 1 and got[5].line_licenses == "CC-BY-NC-4.0" and got[0].n_license_lines == 0
    assert licenses.scan(odd_docs).count() == odd_docs.count() and licenses.scan(no_docs).count() == 0
    notice = [(1, "a\nReleased under the MIT License.\nlicensed under mit")] * 3 + [(1, "other")]
    rows = licenses.scan(spark.createDataFrame(notice, "doc_id long, text string")).collect()
    assert sorted(r.n_license_lines for r in rows) == [0, 2, 2, 2]


def test_whole_licenses_under_any_title(spark):
    mit = licenses.TEXTS["MIT"].split("\n", 1)[1]
    site = "/opt/py313/lib/python3.13/site-packages"
    read = lambda path: open(path).read()
    rows = [("MIT", "Copyright (c) 2020 A B\n\n" + mit), ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2021 X\n" + mit),
            ("MIT", "MIT License\nCopyright 2020 Y\nAll rights reserved.\n" + mit),
            ("BSD-2-Clause", read(f"{site}/packaging-26.3.dist-info/licenses/LICENSE.BSD")),
            ("BSD-3-Clause", read(f"{site}/idna-3.20.dist-info/licenses/LICENSE.md")),
            *((n, read(f"/usr/share/common-licenses/{f}")) for n, f in [
                ("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-3.0", "LGPL-3"),
                ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")]), (None, "MIT License"), (None, mit[:-9])]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.text_license for r in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [n for n, _ in rows]


# ------------------------------------------------------------------ personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                    "card": lambda: 16 <= len(digits) <= 19 and pii.luhn(digits),
                    "phone": lambda: 8 <= len(digits) <= 15}[kind]()
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    pools = ["0123456789", "a.@-_%+", " .-()", "@a.b", "1.2.3.", "+4 ", "é4٣\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute_spans(text), text
    card = "4111 1111 1111 1111"
    assert pii.base_spans(f"x {card}.") == [("card", 2, 21)] and not pii.base_spans("4111 1111 1111 1112")


def test_checksums_and_context():
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")
    spans = pii.find_spans("IBAN GB82 WEST 1234 5698 7654 32, call 555-123-4567. A long stretch of words that speak for "
                           "nothing at all, then 555-123-4568 stands alone.")
    kinds = [s[0] for s in spans]
    assert kinds == ["iban", "local_phone"]
    assert [s[0] for s in pii.find_spans("order 123-45-6789 shipped")] == []
    assert [s[0] for s in pii.find_spans("social security 123-45-6789")] == ["ssn"]


@pytest.mark.parametrize("iban", ["ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "BE68 5390 0754 7034",
                                  "SE45 5000 0000 0583 9825 7466", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"])
@pytest.mark.parametrize("behind", ["", " by", ".", " BIC GEBABEBB", " EUR 500", " 2024 AB 12", " A B CD", " DE89 3704 0044 0532 0130 00"])
def test_ibans_end_where_their_checksum_says(iban, behind):
    for shown in (iban, iban.replace(" ", "")):
        text = f"IBAN {shown}{behind}"
        spans = [(a, b) for k, a, b, _ in pii.find_spans(text) if k == "iban"]
        assert spans[0] == (5, 5 + len(shown)), text
        assert len(spans) == 1 + ("DE89" in behind), text
    assert not [s for s in pii.find_spans("IBAN ES91 2100 0418 4502 0005 1333 BIC") if s[0] == "iban"]
    assert [s[1:3] for s in pii.find_spans("Code AB12 CDEF GB82 WEST 1234 5698 7654 32") if s[0] == "iban"] == [(15, 42)]


def test_pii_digests_of_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = pii.op6_pii(spark, SF01).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in PATTERNS]
        assert set(f"{k}:{a}:{b}" for k, a, b in base) <= set(r.spans.split(","))


def test_redaction_keeps_columns_and_rows(spark, odd_docs, no_docs):
    out = pii.redact(odd_docs)
    assert out.schema.names == odd_docs.schema.names and out.count() == odd_docs.count()
    assert pii.redact(no_docs).count() == 0 and pii.find_pii(odd_docs).count() == odd_docs.count()
    row = spark.createDataFrame([("mail a.b@c.org or 10.0.0.1", 1)], "text string, spans int")
    assert [tuple(r) for r in pii.redact(row).collect()] == [("mail [EMAIL] or [IP]", 1)]


def test_long_runs_stay_linear():
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+" * 100_000, "1 " * 100_000, "a@" * 100_000):
        pii.find_spans(text)


# ------------------------------------------------------------------ sentence spans

def brute_spans_removed(rows):
    seen, out = set(), {}
    for doc, text in rows:
        units = sentence_spans.sentences(text or "")
        plain = [" ".join((text or "")[a:b].lower().split()) for a, b, _, _ in units]
        n = [len(p.split()) for p in plain]
        runs = set()
        for i in range(len(units)):
            fits = lambda a, b: sum(n[a:b + 1]) >= (10 if b - a >= 2 else 30)
            runs.update([next(((i, j) for j in range(i, len(units)) if fits(i, j)), None),
                         next(((k, i) for k in range(i, -1, -1) if fits(k, i)), None)])
        gone = set()
        for i, j in sorted(r for r in runs if r):
            key = tuple(plain[i:j + 1])
            if key in seen:
                gone.update(range(i, j + 1))
            seen.add(key)
        out[doc] = "".join(text[a:b] for k, (a, b, _, _) in enumerate(units) if k not in gone) if units else text
    return out


def test_repeats_removed_as_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r.text for r in sentence_spans.op5_sentence_spans(spark, SF01).collect()}
    assert got == brute_spans_removed(rows)


def test_planted_passages_go_from_all_but_the_first(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    own = lambda n: " ".join(word() + ("." if rng.random() < 0.1 else "") for _ in range(n)) + ".\n"
    passages = [" ".join(word() for _ in range(51)) + ".",                       # one long sentence
                " ".join(" ".join(word() for _ in range(26)) + "." for _ in range(2)),
                " ".join(word() + "." for _ in range(60)),                       # one-word sentences
                " ".join(" ".join(word() for _ in range(rng.randint(3, 9))) + "!" for _ in range(9))]
    rows = [(20 * k + i, own(40) + p + "\n" + own(40)) for k, p in enumerate(passages) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    left = {r.doc_id: r.text for r in sentence_spans.remove_repeats(docs).collect()}
    for k, p in enumerate(passages):
        for i in range(12):
            before, after = dict(rows)[20 * k + i], left[20 * k + i]
            assert (after == before) if i == 0 else (after == before.replace(p + "\n", ""))


def test_passages_inside_a_sentence_are_found(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    run = lambda n: " ".join(word() for _ in range(n))
    found = 0
    for k in range(20):
        passage = run(60)
        docs = spark.createDataFrame([(i, f"{run(17 + 3 * i)} {passage} {run(23)}.") for i in range(2)], "doc_id long, text string")
        left = {r.doc_id: r.text for r in sentence_spans.remove_repeats(docs).collect()}
        found += len(left[1].split()) < 17 + 3 + 60 + 23 - 20
    assert found >= 18


def common_words(a, b):
    """Per word of ``b``, the length of the longest run of words in common with ``a`` that holds it: brute force."""
    a, b, out = a.lower().split(), b.lower().split(), [0] * len(b.split())
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and (not i or not j or a[i - 1] != b[j - 1]):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                for k in range(j, j + n):
                    out[k] = max(out[k], n)
    return out


def test_every_common_passage_of_fifty_words_is_found(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    run = lambda n, marks: " ".join(word() + ("." if rng.random() < marks else "") for _ in range(n))
    rows = []
    for k in range(400):
        passage = run(rng.choice([50, 51, 55, 60, 80]), marks := rng.choice([0, 0.02, 0.1, 0.3]))
        rows += [(2 * k + i, f"{run(rng.randint(0, 30), marks)} {passage} {run(rng.randint(0, 30), marks)}.") for i in range(2)]
    left = {r.doc_id: r.text for r in sentence_spans.remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for (_, first), (doc, later) in zip(rows[::2], rows[1::2]):
        assert left[doc - 1] == first
        shared, kept, at = common_words(first, later), left[doc].split(), 0
        whole = later.split()
        # removal is one range inside the passage: what stays are the words before and behind it
        n = len(whole) - len(kept)
        while at < len(kept) and at + n < len(whole) and kept[at] == whole[at]:
            at += 1
        assert whole[:at] + whole[at + n:] == kept
        assert n >= 25 and n >= max(shared) - 24 and min(shared[at:at + n]) >= 50, (n, max(shared))


def test_spans_on_odd_rows(spark, odd_docs, no_docs):
    out = sentence_spans.remove_repeats(odd_docs, removed_col="n")
    assert out.columns == [*odd_docs.columns, "n"] and out.count() == odd_docs.count()
    by_id = {}
    for r in out.collect():
        by_id.setdefault(r.doc_id, []).append(r.text)
    assert by_id[0] == [None] and by_id[1] == [""] and by_id[2] == [" "]
    assert by_id[100][0] == by_id[100][1] and len(by_id[100][0]) > 100_000          # repeated rows are one document
    assert sorted(map(len, by_id[101]))[0] < 200                                    # its passage is the first one's
    assert sentence_spans.remove_repeats(no_docs).count() == 0
    loop = spark.createDataFrame([(1, "One two three four. Five six seven. Eight nine ten. " * 4)],
                                 "doc_id long, text string")
    assert sentence_spans.remove_repeats(loop).first().text.strip() == "One two three four. Five six seven. Eight nine ten."


# ------------------------------------------------------------------ quality classifier

def test_classifier_on_held_out_labels(spark):
    """The labels are used here only: nothing is fitted on them."""
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r.kept for r in quality_classifier.op1_quality_classifier(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [rows[x.doc_id] for x in labels if x.quality == 1]
    junk = [rows[x.doc_id] for x in labels if x.quality == 0]
    assert sum(good) >= 0.995 * len(good) and sum(not k for k in junk) >= 0.95 * len(junk)


def test_classifier_features_do_not_depend_on_neighbours():
    texts = [b"Some plain text, here.", b"", b"### a### b###", b" \n", "é ü Été".encode(), b"word word word WORD", b"x"]
    whole = quality_classifier.text_features(texts)
    for i, t in enumerate(texts):
        alone = quality_classifier.text_features([t])
        assert (alone[0][0] == whole[0][i]).all() and abs(alone[1][0] - whole[1][i]).max() < 1e-6
    assert quality_classifier.text_features([])[0].shape[0] == 0
    f = dict(zip(quality_classifier.FIGURES, whole[0][5]))
    assert (f["n_words"], f["n_repeats"], f["n_capital_words"]) == (4, 3, 1)


def test_classifier_on_odd_rows(spark, odd_docs, no_docs):
    out = quality_classifier.classify(odd_docs)
    assert out.count() == odd_docs.count() and out.columns == [*odd_docs.columns, "p_good_"]
    assert all(r["p_good_"] == 0 for r in out.collect() if not (r.text or "").strip(" \n\t"))
    assert quality_classifier.classify(no_docs).count() == 0
