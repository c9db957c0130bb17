"""Scores from texts in padded batches of like length, and a classifier trained by epochs (§2.11).

Texts become token ids in the JVM, cut at a number of tokens. A model takes a matrix of ids and a mask and gives logits;
it is loaded once per task and never sees one text alone.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import CLASS_NAMES
from ..session import scratch_path

VOCABULARY = 1 << 16                  # ids: the first 16 bits of a token's MD5
TOKEN = "[A-Za-z0-9]+"
SCORE_TOKENS, TRAIN_TOKENS = 512, 256
WINDOW_ROWS = 4096                    # rows that are sorted by length at a time
BATCH_ROWS = 64
STEP = 16                             # lengths are padded to a multiple of this


def token_ids(text: Column, max_tokens: int, pattern: str = TOKEN) -> Column:
    """Ids of the first ``max_tokens`` tokens of a text, case aside; a null or empty text has none."""
    tokens = F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), 1, max_tokens)
    return F.transform(tokens, lambda w: F.conv(F.substring(F.md5(F.lower(w)), 1, 4), 16, 10).cast("int"))


def padded_batches(lengths: np.ndarray, batch_rows: int, step: int):
    """(rows, padded length) of batches of rows of like length; every row is in one."""
    order = np.argsort(lengths, kind="stable")
    for i in range(0, len(order), batch_rows):
        rows = order[i:i + batch_rows]
        yield rows, max(-(-int(lengths[rows[-1]]) // step) * step, step)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _scored(make_model, names, n_classes, batch_rows, window_rows, step):
    def window(model, held):
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column("_ids").chunk(0) if table.num_rows else table.column("_ids")
        edges, flat = np.asarray(ids.offsets), ids.values.to_numpy(zero_copy_only=False)
        lengths = np.diff(edges)
        p, padded = np.zeros((len(lengths), n_classes)), np.zeros(len(lengths), np.int64)
        for rows, width in padded_batches(lengths, batch_rows, step):
            at = edges[rows][:, None] + np.arange(width)
            mask = np.arange(width) < lengths[rows][:, None]
            x = np.where(mask, flat[np.minimum(at, max(len(flat) - 1, 0))] if len(flat) else 0, 0)
            p[rows] = softmax(np.asarray(model(x, mask), np.float64))       # back in the rows' own order
            padded[rows] = width
        return pa.RecordBatch.from_arrays(
            [*(table.column(n).chunk(0) for n in names), *(pa.array(p[:, k]) for k in range(n_classes)),
             pa.array(lengths.astype(np.int64)), pa.array(padded)],
            names=[*names, *(f"p{k}" for k in range(n_classes)), "n_tokens", "n_padded"])

    def run(batches):
        model, held, size = None, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            model = model or make_model()
            for i in range(0, b.num_rows, window_rows):
                held.append(b.slice(i, window_rows))
                size += held[-1].num_rows
                if size >= window_rows:
                    yield window(model, held)
                    held, size = [], 0
        if held:
            yield window(model, held)
    return run


def score_texts(df: DataFrame, make_model: Callable, text: str, classes: Sequence[str] = CLASS_NAMES,
                max_tokens: int = SCORE_TOKENS, batch_rows: int = BATCH_ROWS, window_rows: int = WINDOW_ROWS,
                step: int = STEP, report: bool = False) -> DataFrame:
    """``df`` with one probability per class, computed from ``text`` by the model that ``make_model()`` loads once per
    task: it takes ids (rows x length) and a mask of the same shape and gives logits (rows x classes).

    Inside a window of rows texts are sorted by length and cut into batches, each padded to its longest text; the rows
    come out in the order they came in. A text scores as it would alone, if the model heeds the mask. ``report`` adds
    n_tokens and n_padded (the length it was scored at): the share of padding is one minus the ratio of their sums.
    Null and empty texts are scored as no tokens; all rows and other columns stay."""
    names = [f"c{i}" for i in range(len(df.columns))]
    src = df.toDF(*names)
    at = names[df.columns.index(text)]
    src = src.withColumn("_ids", token_ids(F.col(at), max_tokens))
    schema = "".join(f"{n} {src.schema[n].dataType.simpleString()}, " for n in names)
    schema += "".join(f"p{k} double, " for k in range(len(classes))) + "n_tokens long, n_padded long"
    out = src.mapInArrow(_scored(make_model, names, len(classes), batch_rows, window_rows, step), schema)
    extra = [F.col("n_tokens"), F.col("n_padded")] if report else []
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns) if c not in classes],
                      *[F.col(f"p{k}").alias(c) for k, c in enumerate(classes)], *extra)


def mean_model(weights: np.ndarray, bias: np.ndarray):
    """Model factory: the mean of the tokens' weights plus a bias."""
    def make():
        def model(ids, mask):
            n = np.maximum(mask.sum(1, keepdims=True), 1)
            return np.einsum("blc,bl->bc", weights[ids], mask.astype(np.float64)) / n + bias
        return model
    return make


# ------------------------------------------------------------------ training

def _log_loss(p: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())


def sparse_rows(edges: np.ndarray, flat: np.ndarray, rows: np.ndarray):
    """(row number, id, 1 / tokens) of every token of ``rows``."""
    lens = np.diff(edges)[rows]
    total = int(lens.sum())
    at = np.repeat(edges[rows] - (np.cumsum(lens) - lens), lens) + np.arange(total)
    return np.repeat(np.arange(len(rows)), lens), flat[at], np.repeat(1 / np.maximum(lens, 1), lens)


def mean_logits(edges, flat, rows, weights, bias) -> np.ndarray:
    r, i, share = sparse_rows(edges, flat, rows)
    z = np.tile(bias, (len(rows), 1))
    np.add.at(z, r, weights[i] * share[:, None])
    return z


def gradient(edges, flat, labels, rows, weights, bias):
    """(ids, their gradients, the bias's) summed over ``rows``."""
    d = softmax(mean_logits(edges, flat, rows, weights, bias)) if len(rows) else np.zeros((0, len(bias)))
    d[np.arange(len(rows)), labels[rows]] -= 1
    r, i, share = sparse_rows(edges, flat, rows)
    ids, at = np.unique(i, return_inverse=True)
    g = np.zeros((len(ids), len(bias)))
    np.add.at(g, at, d[r] * share[:, None])
    return ids, g, d.sum(0)


def _gather(context, *arrays):
    """What every task sends, in the order of the tasks."""
    text = "|".join(base64.b64encode(np.ascontiguousarray(a).tobytes()).decode() for a in arrays)
    return [[np.frombuffer(base64.b64decode(x), a.dtype).reshape(-1, *a.shape[1:]) for x, a in zip(m.split("|"), arrays)]
            for m in context.allGather(text)]


EVAL_ROWS = 4096                      # rows that are scored at a time


def _pieces(batches):
    """(phase, mini-batch, offsets, token ids, labels, rows) of rows that stand together in both, at most ``EVAL_ROWS`` at a
    time; what comes in is never held longer than one Arrow batch."""
    for b in batches:
        if not b.num_rows:
            continue
        ids, (phase, batch, labels) = b.column("_ids"), (b.column(c).to_numpy(zero_copy_only=False) for c in ("_s", "_b", "_y"))
        edges = np.asarray(ids.offsets)
        edges, flat = edges - edges[0], ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + VOCABULARY // 2
        cuts = np.flatnonzero((np.diff(phase) != 0) | (np.diff(batch) != 0)) + 1
        for rows in np.split(np.arange(b.num_rows), cuts):
            for k in range(0, len(rows), EVAL_ROWS):
                yield int(phase[rows[0]]), int(batch[rows[0]]), edges, flat, labels, rows[k:k + EVAL_ROWS]


def _added(x, y):
    """The sum of two gradients."""
    ids, at = np.unique(np.concatenate([x[0], y[0]]), return_inverse=True)
    g = np.zeros((len(ids), x[1].shape[1]))
    np.add.at(g, at, np.concatenate([x[1], y[1]]))
    return ids, g, x[2] + y[2]


def _trained(pieces, weights, bias, rate, l2):
    """``weights`` and ``bias`` behind one step for each mini-batch of ``pieces``, in place."""
    for _, batch in groupby(pieces, key=lambda piece: piece[1]):
        n, total = 0, None
        for _, _, edges, flat, labels, rows in batch:
            some = gradient(edges, flat, labels, rows, weights, bias)
            n, total = n + len(rows), _added(total, some) if total else some
        i, g, gb = total
        if l2:
            weights *= 1 - rate * l2
        weights[i] -= rate / n * g
        bias -= rate / n * gb


def _measured(pieces, weights, bias) -> np.ndarray:
    """Number of rows, sum of their losses and how many are right, of the training rows and of the others."""
    out = np.zeros((2, 3))
    for _, is_validation, edges, flat, labels, rows in pieces:
        p = softmax(mean_logits(edges, flat, rows, weights, bias))
        out[is_validation] += len(rows), _log_loss(p, labels[rows]), (p.argmax(1) == labels[rows]).sum()
    return out


def _epochs(n_classes, epochs, n_batches, tasks, rate, l2, vocabulary):
    def run(batches):
        context = BarrierTaskContext.get()
        me = context.partitionId()
        pieces = _pieces(batches)
        ahead = next(pieces, None)

        def of(phase):
            nonlocal ahead
            while ahead and ahead[0] == phase:
                yield ahead
                ahead = next(pieces, None)

        weights, bias = np.zeros((vocabulary, n_classes)), np.zeros(n_classes)
        best, kept, out = -1.0, (weights.copy(), bias.copy()), []
        list(of(-1))
        owners = sorted({k * tasks // n_batches for k in range(n_batches)})
        for e in range(epochs):
            for owner in owners:                      # the steps are taken one behind the other, the weights handed on
                if owner == me:
                    _trained(of(2 * e), weights, bias, rate, l2)
                sent = (weights, bias[None]) if owner == me else (weights[:0], bias[None][:0])
                weights, bias = (x.copy() for x in _gather(context, *sent)[owner])
                bias = bias[0]
            sums = _measured(of(2 * e + 1), weights, bias)
            total = sum(x[0] for x in _gather(context, sums))
            share = total[:, 1:] / np.maximum(total[:, :1], 1)
            out.append((e, int(total[0, 0]), int(total[1, 0]), *share[0], *share[1]))
            if share[1, 1] > best:                    # strictly better: the first of equally good epochs stays
                best, kept, best_epoch = share[1, 1], (weights.copy(), bias.copy()), e
        if me == 0:
            used = np.flatnonzero(kept[0].any(1))
            model = np.concatenate([np.concatenate([used.astype(np.float64)[:, None], kept[0][used]], 1),
                                    np.concatenate([[-1.0], kept[1]])[None]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[k] for r in out], pa.int64()) for k in (1, 2)),
                 *(pa.array([float(r[k]) for r in out]) for k in (3, 4, 5, 6)), pa.array([r[0] == best_epoch for r in out]),
                 pa.array([model.tobytes() if r[0] == best_epoch else None for r in out], pa.binary())],
                names=["epoch", "n_train", "n_valid", "train_loss", "train_accuracy", "valid_loss", "valid_accuracy", "best",
                       "model"])
    return run


def train_epochs(rows: DataFrame, key: str, text: str, label: str, is_validation: str, n_classes: int, epochs: int = 3,
                 batch_rows: int = 256, rate: float = 2.0, l2: float = 0.0, seed: int = 42, max_tokens: int = TRAIN_TOKENS,
                 tasks: int = 4, max_rows: int | None = None) -> DataFrame:
    """One row per epoch: epoch, n_train, n_valid, mean loss and accuracy on both parts behind it, whether it is the best
    (highest validation accuracy, the first of equals) and, for that one, the model (see ``load_model``).

    A softmax regression on the mean of token weights learns from mini-batches: in each epoch a seeded hash of (epoch,
    key, text) deals the training rows to ``ceil(n / batch_rows)`` batches, and every batch is one step along the
    mean gradient of its rows. ``tasks`` tasks of one barrier stage share an epoch's batches, a run of them each: a task
    takes its steps with the weights that the one before it hands on, so the weights are those of a run in one place and
    do not depend on how rows are spread but for rounding; losses are measured by all tasks side by side. Spark takes a
    second to gather, so tasks gather ``tasks + 1`` times an epoch, however many rows there are. A lost executor makes
    Spark run the stage again.

    All rows take part unless ``max_rows`` is given; then those with the smallest hash do. A task reads its rows as a
    stream that Spark has sorted, once per epoch for the steps and once for the losses, and holds one Arrow batch of them
    besides the weights. Rows with a null label are left out; texts without tokens count with the bias alone."""
    spark = rows.sparkSession
    h = lambda *x: F.xxhash64(*[F.lit(v) for v in (seed, *x)], key, text)
    base = rows.where(F.col(label).isNotNull())
    if max_rows is not None and base.count() > max_rows:
        base = base.orderBy(h(-1), key).limit(max_rows)
    path = scratch_path(spark, "train-rows")
    ids = F.transform(token_ids(F.col(text), max_tokens), lambda i: (i - VOCABULARY // 2).cast("short"))
    (base.select(ids.alias("_ids"), F.col(label).cast("int").alias("_y"),
                 F.coalesce(F.col(is_validation), F.lit(False)).alias("_v"), F.array(*[h(e) for e in range(epochs)]).alias("_h"))
     .write.option("compression", "zstd").parquet(path))
    held = spark.read.parquet(path)
    n = held.where(~F.col("_v")).count()
    n_batches = max(-(-n // batch_rows), 1)
    # phase 2 e has the training rows by the batches of epoch e, phase 2 e + 1 all rows, the validation rows behind
    batch = lambda x: F.pmod(x, F.lit(n_batches))
    steps = F.transform("_h", lambda x, e: F.struct((2 * e).alias("s"), batch(x).alias("b"), batch(x).alias("at")))
    looks = F.transform("_h", lambda x, e: F.struct((2 * e + 1).alias("s"), F.col("_v").cast("long").alias("b"),
                                                    batch(x).alias("at")))
    dealt = held.select("_ids", "_y", F.explode(F.when(F.col("_v"), looks).otherwise(F.concat(steps, looks))).alias("_p")) \
        .select("_ids", "_y", F.col("_p.s").alias("_s"), F.col("_p.b").alias("_b"),
                F.floor(F.col("_p.at") * tasks / n_batches).cast("int").alias("_t"))
    # a row before the first phase in every task, because without any rows Spark would start none
    first = spark.range(tasks).select(F.array().cast("array<short>"), F.lit(0), F.lit(-1), F.lit(0).cast("long"),
                                      F.col("id").cast("int"))
    spread = dealt.union(first).repartitionById(tasks, "_t").drop("_t").sortWithinPartitions("_s", "_b")
    out = spread.mapInArrow(
        _epochs(n_classes, epochs, n_batches, tasks, rate, l2, VOCABULARY),
        "epoch int, n_train long, n_valid long, train_loss double, train_accuracy double, valid_loss double, "
        "valid_accuracy double, best boolean, model binary", barrier=True)
    path = scratch_path(spark, "train-epochs")
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def load_model(epochs: DataFrame, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of the best epoch, for ``mean_model``."""
    raw = epochs.where("best").select("model").first()[0]
    rows = np.frombuffer(raw, np.float64).reshape(-1, n_classes + 1)
    weights = np.zeros((VOCABULARY, n_classes))
    weights[rows[:-1, 0].astype(np.int64)] = rows[:-1, 1:]
    return weights, rows[-1, 1:].copy()
