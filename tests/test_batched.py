"""Texts scored in padded batches equal texts scored alone; training by epochs equals a NumPy run in the same order."""

import hashlib
import random
import re
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from revlens.operators import batched as B

CLASSES = ("NEGATIVE", "NEUTRAL", "POSITIVE")


def ids_of(text, limit):
    return [int(hashlib.md5(w.lower().encode()).hexdigest()[:4], 16) for w in re.findall("[A-Za-z0-9]+", text or "")[:limit]]


def texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"Word{i}" for i in range(200)] + ["good", "BAD", "fine"]
    out = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 90, 700]))) for _ in range(n)]
    return [*out, None, "", "--- ünïcode only: é", "one"]


def toy_weights(n_classes=3):
    i = np.arange(B.VOCABULARY)[:, None]
    return ((i * (2 * np.arange(n_classes) + 3)) % 997) / 997 * 4 - 2


@pytest.mark.parametrize("window, batch, step", [(4096, 64, 16), (7, 3, 1), (50, 1, 8)])
def test_batches_score_like_one_text_at_a_time(spark, window, batch, step):
    weights, bias = toy_weights(), np.array([0.1, -0.2, 0.3])
    data = list(enumerate(texts(120)))
    df = spark.createDataFrame(data, "id long, text string").withColumn("NEUTRAL", F.lit("old")).repartition(3)
    got = B.score_texts(df, B.mean_model(weights, bias), "text", batch_rows=batch, window_rows=window, step=step, report=True)
    assert got.columns == ["id", "text", *CLASSES, "n_tokens", "n_padded"]
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == len(data)
    alone = B.mean_model(weights, bias)()
    for i, t in data:
        ids = np.array([ids_of(t, 512)], np.int64)
        want = B.softmax(alone(ids, np.ones(ids.shape, bool)) if ids.size else bias[None])[0]
        assert np.allclose([rows[i][c] for c in CLASSES], want, atol=1e-12)
        assert rows[i].n_tokens == min(ids.size, 512) <= rows[i].n_padded


def test_padding_is_a_small_share(spark):
    df = spark.createDataFrame(list(enumerate(texts(4000, 2))), "id long, text string").repartition(1)
    got = B.score_texts(df, B.mean_model(toy_weights(), np.zeros(3)), "text", report=True)
    share = got.agg(1 - F.sum("n_tokens") / F.sum("n_padded")).first()[0]
    rng = np.random.default_rng(0)
    lens = rng.permutation([r.n_tokens for r in got.collect()])
    plain = 1 - lens.sum() / sum(len(b) * max(b.max(), 1) for b in np.array_split(lens, len(lens) // 64))
    assert share < 0.1 < plain


def test_every_row_is_in_one_batch():
    rng = np.random.default_rng(2)
    for _ in range(50):
        lens = rng.integers(0, 40, rng.integers(1, 60))
        seen = np.concatenate([rows for rows, _ in B.padded_batches(lens, int(rng.integers(1, 9)), 4)])
        assert sorted(seen.tolist()) == list(range(len(lens)))
        assert all(width >= lens[rows].max() and width % 4 == 0 for rows, width in B.padded_batches(lens, 5, 4))


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "text string, c0 int")
    assert B.score_texts(df, B.mean_model(toy_weights(), np.zeros(3)), "text").collect() == []


# ------------------------------------------------------------------ training

def labelled(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.randint(0, 1)
        words = [rng.choice(["good", "fine", "great"] if y else ["bad", "poor", "awful"]) for _ in range(rng.randint(0, 3))]
        words += [f"word{rng.randint(0, 50)}" for _ in range(rng.randint(0, 400))]
        rng.shuffle(words)
        rows.append((i % 300, " ".join(words), y, rng.random() < 0.2))
    rows += [(900, None, 1, False), (None, "good", 1, False), (901, "bad", None, False)]
    return rows, spark.createDataFrame(rows, "id long, text string, label int, v boolean")


def numpy_run(spark, df, epochs, batch_rows, rate, l2, seed):
    held = df.where("label is not null").select(
        "text", "label", "v", *[F.xxhash64(F.lit(seed), F.lit(e), "id", "text").alias(f"h{e}") for e in range(epochs)]).collect()
    y, v = np.array([r.label for r in held]), np.array([r.v for r in held])
    x = np.zeros((len(held), B.VOCABULARY), np.float64)
    for k, r in enumerate(held):
        ids = ids_of(r.text, 256)
        for i in ids:
            x[k, i] += 1 / len(ids)
    used = np.flatnonzero(x.any(0))
    x = x[:, used]
    n_batches = max(-(-int((~v).sum()) // batch_rows), 1)
    w, b, out, best = np.zeros((len(used), 2)), np.zeros(2), [], None
    for e in range(epochs):
        batch = np.array([r[f"h{e}"] % n_batches for r in held])
        for k in range(n_batches):
            at = np.flatnonzero(~v & (batch == k))
            if len(at):
                d = B.softmax(x[at] @ w + b)
                d[np.arange(len(at)), y[at]] -= 1
                w = w * (1 - rate * l2) - rate / len(at) * (x[at].T @ d)
                b = b - rate / len(at) * d.sum(0)
        p = B.softmax(x @ w + b)
        hit, loss = p.argmax(1) == y, -np.log(p[np.arange(len(y)), y])
        out.append((loss[~v].mean(), hit[~v].mean(), loss[v].mean(), hit[v].mean()))
        if best is None or hit[v].mean() > best[0]:
            best = hit[v].mean(), e, w.copy(), b.copy()
    return out, best, used


@pytest.mark.parametrize("tasks, batch_rows, l2", [(1, 64, 0.0), (3, 40, 0.01)])
def test_training_equals_numpy_in_the_same_order(spark, tasks, batch_rows, l2):
    _, df = labelled(spark)
    got = B.train_epochs(df.repartition(5), "id", "text", "label", "v", 2, epochs=3, batch_rows=batch_rows, rate=3.0, l2=l2,
                         tasks=tasks)
    rows = sorted(got.collect(), key=lambda r: r.epoch)
    out, best, used = numpy_run(spark, df, 3, batch_rows, 3.0, l2, 42)
    assert [r.epoch for r in rows] == [0, 1, 2] and [r.best for r in rows] == [e == best[1] for e in range(3)]
    for r, want in zip(rows, out):
        assert np.allclose((r.train_loss, r.train_accuracy, r.valid_loss, r.valid_accuracy), want, atol=1e-9)
        assert r.n_train + r.n_valid == df.where("label is not null").count()
    weights, bias = B.load_model(got, 2)
    assert np.allclose(weights[used], best[2], atol=1e-9) and np.allclose(bias, best[3], atol=1e-9)


def test_tasks_gather_a_few_times_an_epoch(spark, tmp_path, monkeypatch):
    """A gathering takes Spark a second: their number does not grow with the batches."""
    def counted(context, *arrays, gather=B._gather, folder=str(tmp_path)):
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return gather(context, *arrays)

    _, df = labelled(spark)
    monkeypatch.setattr(B, "_gather", counted)
    got = B.train_epochs(df, "id", "text", "label", "v", 2, epochs=2, batch_rows=8, tasks=2)
    assert got.first().n_train > 8 * 30
    assert len(list(tmp_path.iterdir())) == 2 * 2 * (2 + 1)           # tasks, epochs, tasks + 1


def test_trained_model_scores_texts(spark):
    _, df = labelled(spark)
    model = B.load_model(B.train_epochs(df, "id", "text", "label", "v", 2, epochs=2, batch_rows=32, rate=4.0, tasks=2), 2)
    tests = spark.createDataFrame([(1, "good fine great"), (0, "bad awful poor poor")], "y int, text string")
    got = B.score_texts(tests, B.mean_model(*model), "text", classes=("no", "yes"))
    assert all((r.yes > r.no) == bool(r.y) for r in got.collect())


def test_training_on_little(spark):
    _, df = labelled(spark)
    none = B.train_epochs(df.limit(0), "id", "text", "label", "v", 2, epochs=2, tasks=2)
    assert [(r.n_train, r.n_valid) for r in none.collect()] == [(0, 0)] * 2 and none.where("best").count() == 1
    few = B.train_epochs(df, "id", "text", "label", "v", 2, epochs=1, tasks=2, max_rows=20)
    assert few.first().n_train + few.first().n_valid == 20


def test_every_row_trains(spark):
    """More rows than the two million that were once all that took part."""
    n = 2_000_100
    df = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "good").otherwise("bad").alias("text"),
                               (F.col("id") % 2 == 0).cast("int").alias("label"), (F.col("id") % 4 < 2).alias("v"))
    got = B.train_epochs(df, "id", "text", "label", "v", 2, epochs=1, batch_rows=1 << 16, tasks=2).first()
    assert (got.n_train, got.n_valid, got.valid_accuracy) == (n // 2, n // 2, 1.0)


def arrow_rows(rng, phases, n, texts=3):
    """Arrow batches of ``n`` rows per phase as a task gets them, ten rows each."""
    for phase in range(phases):
        for _ in range(n // 10):
            b = np.sort(rng.integers(0, 2, 10))
            yield pa.RecordBatch.from_pydict({
                "_ids": pa.array([rng.integers(-1 << 15, 1 << 15, texts).tolist() for _ in range(10)], pa.list_(pa.int16())),
                "_y": pa.array(rng.integers(0, 2, 10), pa.int32()), "_s": pa.array([phase] * 10, pa.int32()),
                "_b": pa.array(b, pa.int64())})


def test_a_task_reads_its_rows_as_they_come(monkeypatch):
    """Rows of an epoch's losses and of later epochs are not read before the steps are taken."""
    class Context:
        get, partitionId = classmethod(lambda c: c), classmethod(lambda c: 0)

    taken, at_gathering = [0], []

    def counted():
        for b in arrow_rows(np.random.default_rng(5), 4, 200):
            taken[0] += b.num_rows
            yield b

    def gather(context, *arrays):
        at_gathering.append(taken[0])
        return [list(arrays)]

    monkeypatch.setattr(B, "BarrierTaskContext", Context)
    monkeypatch.setattr(B, "_gather", gather)
    out = list(B._epochs(2, 2, 2, 1, 1.0, 0.0, B.VOCABULARY)(counted()))
    assert out[0].column("epoch").to_pylist() == [0, 1]
    assert at_gathering == [210, 410, 610, 800]                       # one Arrow batch ahead, at the end none


def test_a_batch_in_pieces_is_one_step(monkeypatch):
    rows = list(arrow_rows(np.random.default_rng(6), 1, 40))
    one = pa.Table.from_batches(rows).sort_by("_b").combine_chunks().to_batches()
    results = []
    for batches, most in ((one, 4096), (one, 3), ([x.slice(k, 7) for x in one for k in range(0, 40, 7)], 4096)):
        monkeypatch.setattr(B, "EVAL_ROWS", most)
        weights, bias = np.zeros((B.VOCABULARY, 2)), np.zeros(2)
        B._trained(B._pieces(batches), weights, bias, 1.0, 0.01)
        results.append((weights, bias, B._measured(B._pieces(batches), weights, bias)))
    for got in results[1:]:
        assert all(np.allclose(x, y, atol=1e-12) for x, y in zip(got, results[0]))
    assert results[0][2][:, 0].sum() == 40
