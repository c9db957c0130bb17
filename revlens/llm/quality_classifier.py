"""Quality classifier from weak labels (operator 1).

1. Heuristic labellers look at figures of every text and vote good, bad or abstain; expectation-maximisation over the
   vote patterns of all rows estimates how far each can be trusted (``weak``).
2. The posterior labels of a bounded sample (``SAMPLE_ROWS`` rows, chosen by hash) train a logistic scorer on hashed
   features. No hand label is used.
3. The scorer decides on every row.

Features of a text, each hashed to one of ``BUCKETS`` weights: pairs of neighbouring character classes (letters by
case, digits, white space, every ASCII mark by itself), words (letters in lower case, marks left out) and words
repeated one to four places on. All are counted per text with NumPy over whole batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_slices, fresh, row_key, stored, text_slices
from .weak import fit_votes, posterior

SAMPLE_ROWS = 6000
BUCKETS = 2048
MIN_SCORE = 0.5
SLICE_BYTES = 1 << 20
LABELLERS = ["v_symbols", "v_symbol_words", "v_marks", "v_capitals", "v_capital_words", "v_repeats", "v_near_repeats",
             "v_word_length", "v_stops"]

UPPER, LOWER, DIGIT, HIGH, SPACE, LINE, CONTROL = range(7)
_N_CLASSES = 40


def _classes() -> np.ndarray:
    c, mark = np.full(256, CONTROL, np.uint8), CONTROL + 1
    for b in range(33, 127):
        ch = chr(b)
        if ch.isalpha():
            c[b] = UPPER if ch.isupper() else LOWER
        elif ch.isdigit():
            c[b] = DIGIT
        else:
            c[b], mark = mark, mark + 1
    c[128:] = HIGH
    c[32], c[10] = SPACE, LINE
    c[[9, 11, 12, 13]] = SPACE
    return c


_CLASS = _classes()
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_IS_MARK = (_CLASS > CONTROL) & ~np.isin(np.arange(256), np.frombuffer(b".,'-;", np.uint8))
_IS_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_IS_WHITE = (_CLASS == SPACE) | (_CLASS == LINE)
_FOLD = np.where(_CLASS == UPPER, np.arange(256) + 32, np.arange(256)).astype(np.uint64)
_FOLD[_CLASS > HIGH] = 0
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
FIGURES = ["n_words", "word_chars", "n_symbols", "n_symbol_words", "n_marks", "n_capitals", "n_capital_words", "n_repeats",
           "n_near_repeats", "n_stops"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def text_features(texts: list[bytes], with_buckets: bool = True):
    """(figures [text, figure], counts [text, bucket] or None). Characters beyond ASCII count by their bytes."""
    n = len(texts)
    figures = np.zeros((n, len(FIGURES)), np.int64)
    counts = np.zeros((n, BUCKETS), np.float32) if with_buckets else None
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if not n:
        return figures, counts
    ends = np.cumsum([len(t) + 1 for t in texts])
    cls = _CLASS[data]
    white = _IS_WHITE[data]
    starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    stops = np.flatnonzero(~white & np.concatenate([white[1:], [True]])) + 1
    word_text = np.searchsorted(ends, starts, "right")

    def per_text(values, where):
        return np.bincount(where, weights=values, minlength=n).astype(np.int64)

    def per_byte(flag):                            # texts are runs of bytes: differences of a running sum
        total = np.cumsum(flag, dtype=np.int64)[ends - 1]
        return np.diff(total, prepend=0)

    size = stops - starts
    def sums(flag):                                # white space between words never carries a flag
        return np.add.reduceat(flag.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)

    inside = np.repeat(np.arange(len(starts)), size)
    folded = _FOLD[data[~white]]
    order = np.cumsum(folded != 0) - 1             # letters are numbered without the marks between them
    first = order[np.cumsum(size) - size] if len(size) else order[:0]
    place = np.maximum(order - first[inside], 0) & 63
    words = _mix(np.add.reduceat(folded * _POWERS[place], np.cumsum(size) - size) if len(size)
                 else np.zeros(0, np.uint64))
    upper = sums(cls == UPPER)
    letters = upper + sums((cls == LOWER) | (cls == HIGH))
    symbol_words = sums(_IS_SYMBOL[data]) > 0
    same = np.zeros((4, len(words)), bool)
    for k in range(1, 5):
        same[k - 1, k:] = (words[k:] == words[:-k]) & (word_text[k:] == word_text[:-k])
    figures[:, 0] = np.bincount(word_text, minlength=n)
    figures[:, 1] = per_text(size, word_text)
    figures[:, 2] = per_byte(_IS_SYMBOL[data])
    figures[:, 3] = per_text(symbol_words, word_text)
    figures[:, 4] = per_byte(_IS_MARK[data])
    figures[:, 5] = per_byte(cls == UPPER)
    figures[:, 6] = per_text((upper == letters) & (letters > 1), word_text)
    figures[:, 7] = per_text(same[0], word_text)
    figures[:, 8] = per_text(same.any(0), word_text)
    figures[:, 9] = per_byte(_IS_STOP[data])
    if with_buckets:
        pair = cls[:-1].astype(np.int64) * _N_CLASSES + cls[1:]
        pair_bucket = (_mix(np.arange(_N_CLASSES * _N_CLASSES, dtype=np.uint64) + np.uint64(1))
                       % np.uint64(BUCKETS)).astype(np.int64)
        word_bucket = (words % np.uint64(BUCKETS)).astype(np.int64)
        gap_bucket = (_mix(np.arange(4, dtype=np.uint64) + np.uint64(77777)) % np.uint64(BUCKETS)).astype(np.int64)
        word_ends = np.searchsorted(starts, ends)
        a = w = 0
        for i, (e, we) in enumerate(zip(ends.tolist(), word_ends.tolist())):
            got = np.bincount(pair[a:e - 1], minlength=_N_CLASSES * _N_CLASSES)
            row = np.bincount(pair_bucket, weights=got, minlength=BUCKETS)
            if we > w:
                row += np.bincount(word_bucket[w:we], minlength=BUCKETS)
                np.add.at(row, gap_bucket, 4.0 * same[:, w:we].sum(1))
                row /= we - w
            counts[i] = row
            a, w = e, we
        np.sqrt(counts, out=counts)
    return figures, counts


def _slices(texts):
    for a, b in text_slices([len(t) for t in texts], SLICE_BYTES):
        yield a, texts[a:b]


def _figure_rows(batches):
    for b in batch_slices(batches, "t"):
        texts = [(t or "").encode() for t in b.column("t").to_pylist()]
        got = [text_features(part, False)[0] for _, part in _slices(texts)]
        got = np.concatenate(got) if got else np.zeros((0, len(FIGURES)), np.int64)
        yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), *(pa.array(c) for c in got.T)],
                                         names=["k1", "k2", *FIGURES])


def labeller_votes():
    """Votes on the figures; integer comparisons only."""
    n, chars = F.col("n_words"), F.col("word_chars")

    def vote(bad, good=None):
        v = F.when(bad, F.lit(-1))
        return (v if good is None else v.when(good, F.lit(1))).otherwise(F.lit(0))

    return {
        "v_symbols": vote(F.col("n_symbols") * 10 > n),
        "v_symbol_words": vote(F.col("n_symbol_words") * 8 > n),
        "v_marks": vote(F.col("n_marks") * 100 > chars * 8),
        "v_capitals": vote(F.col("n_capitals") * 10 > chars * 3),
        "v_capital_words": vote(F.col("n_capital_words") * 2 > n),
        "v_repeats": vote(F.col("n_repeats") * 5 > n),
        "v_near_repeats": vote(F.col("n_near_repeats") * 10 > n * 3),
        "v_word_length": vote((chars * 2 < n * 5) | (chars > n * 16), (chars >= n * 3) & (chars <= n * 12)),
        "v_stops": vote(F.col("n_stops") * 100 < n, (F.col("n_stops") * 40 >= n) & (F.col("n_stops") * 2 <= n)),
    }


def _sample_rows(batches):
    for b in batch_slices(batches, "t"):
        texts = [(t or "").encode() for t in b.column("t").to_pylist()]
        for a, part in _slices(texts):
            x = text_features(part)[1]
            yield pa.RecordBatch.from_arrays(
                [b.column("k1").slice(a, len(part)), b.column("k2").slice(a, len(part)),
                 pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["k1", "k2", "x"])


def train_scorer(x: np.ndarray, p: np.ndarray, steps: int = 200, penalty: float = 1e-4):
    """Logistic regression on soft labels by Nesterov's method; (weights, bias). Features are scaled to unit spread."""
    scale = (1.0 / np.maximum(x.std(0), 1e-3)).astype(np.float32)
    x, p = (x * scale).astype(np.float32), p.astype(np.float32)    # single precision throughout: the sample is small
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    vw, vb = w.copy(), b
    rate = np.float32(4.0 / (1.0 + float(np.einsum("ij,ij->", x, x)) / len(x)))
    for k in range(steps):
        z = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -30, 30)))
        g = (z - p) / np.float32(len(p))
        nw, nb = vw - rate * (g @ x + np.float32(penalty) * vw), vb - rate * g.sum()
        m = np.float32(k / (k + 3))
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w * scale, b


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of good quality; 0 for a text without words."""
        out = []
        for _, part in _slices(texts):
            figures, x = text_features(part)
            s = 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))
            out.append(np.where(figures[:, 0] > 0, s, 0.0))
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Labellers and EM on all rows; the scorer on the ``sample_rows`` distinct rows whose hash is smallest, at most."""
    spark = docs.sparkSession
    src = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("t"))
    schema = "k1 long, k2 long, " + ", ".join(f"{c} long" for c in FIGURES)
    figures = stored(spark, src.mapInArrow(_figure_rows, schema), "quality-figures")
    votes = labeller_votes()
    voted = figures.where("n_words > 0").select("k1", "k2", *[c.alias(k) for k, c in votes.items()])
    total = voted.count()
    if not total:                                   # no text has a word
        return Scorer(np.zeros(BUCKETS), 0.0)
    model = fit_votes(voted, list(votes))
    # distinct rows in the order of their hash: as long as there is any row there is a sample
    labels = (voted.select("k1", "k2", posterior(model, list(votes)).alias("p")).dropDuplicates(["k1", "k2"])
              .orderBy(F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 30)), "k1", "k2").limit(sample_rows))
    labels = stored(spark, labels, "quality-sample")         # sample_rows at most
    x = src.join(F.broadcast(labels.select("k1", "k2")), ["k1", "k2"], "left_semi")
    x = x.mapInArrow(_sample_rows, "k1 long, k2 long, x binary").dropDuplicates(["k1", "k2"])
    rows = x.join(F.broadcast(labels), ["k1", "k2"]).select("x", "p").orderBy("k1", "k2").collect()
    feats = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    return Scorer(*train_scorer(feats, np.array([r["p"] for r in rows])))


def _score_rows(scorer: Scorer):
    def run(batches):
        for b in batch_slices(batches, "t"):
            p = scorer.score([(t or "").encode() for t in b.column("t").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, "p_good"])
    return run


def classify(docs: DataFrame, scorer: Scorer | None = None, id_col: str = "doc_id", text_col: str = "text",
             score_col: str = "p_good") -> DataFrame:
    """``docs`` with ``score_col``, the scorer's probability that the text is good; a scorer is fitted when none is
    given. All rows and columns stay. Null, empty and blank texts score 0; equal texts score alike; an empty table
    stays empty."""
    scorer = scorer or fit(docs, id_col, text_col)
    if score_col.lower() in {c.lower() for c in docs.columns}:
        score_col = fresh(docs, score_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    src = docs.toDF(*names).withColumnRenamed(names[at], "t")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema) + ", p_good double"
    out = src.mapInArrow(_score_rows(scorer), schema)
    return out.toDF(*docs.columns, score_col)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its score and whether it is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs).select("doc_id", "p_good", (F.col("p_good") >= MIN_SCORE).alias("kept"))
