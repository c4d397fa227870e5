"""Quality: random-indexing word vectors pooled per document, then a two-layer numpy network.

Tokens are words and runs of punctuation. Each token's hash names one of ``BUCKETS`` buckets with a fixed sparse index
vector; a bucket's context vector is the sum of the index vectors of its neighbours (two on either side) over all documents.
Every task adds up whole numbers for its own part and Spark sums the parts by bucket, so the vectors are exact, take a table of
a fixed size, and don't depend on how the input is dealt. A document is the weighted mean of its tokens' vectors
beside shares of word shapes and of repeats; a tanh layer and a logistic output, fitted on a bounded sample, give a logit, and a temperature
fitted on a part kept back from that sample calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernel
from quarry.llm.learning import held_out, labelled_sample, labelled_texts, sigmoid

BUCKETS, DIM, NONZERO, REACH = 1 << 13, 32, 2, 2
SAMPLE, HIDDEN, EPOCHS = 10_000, 24, 60
SHAPES = 20
PIECE = 1 << 20

_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector."""
    x = kernel.mix(np.arange(1, BUCKETS * NONZERO + 1, dtype=np.uint64)).reshape(BUCKETS, NONZERO)
    return (x >> np.uint64(8)).astype(np.int64) % DIM, np.where(x & np.uint64(1), 1, -1).astype(np.int64)


def tokens(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, shape, hash, text) of each token in order."""
    data, offs = kernel.raw(arr)
    kind = _KIND[data]
    ws, we = kernel.runs((kind == 1).astype(np.uint8), offs)
    ps, pe = kernel.runs((kind == 2).astype(np.uint8), offs)
    starts, ends = np.concatenate([ws, ps]), np.concatenate([we, pe])
    order = np.argsort(starts, kind="stable")
    word = order < len(ws)
    starts, ends = starts[order], ends[order]
    h = kernel.hash_runs(kernel._LOWER[data], starts, ends)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    size = ends - starts
    ups, digits = upper[ends] - upper[starts], digit[ends] - digit[starts]
    look = np.where(digits > 0, 3, np.where((ups > 1) & (2 * ups >= size), 2, np.where(ups > 0, 1, 0)))
    shape = np.where(word, look * 4 + np.minimum(size // 4, 3), 16 + np.minimum(size - 1, 3))
    return (h >> np.uint64(51)).astype(np.int64), shape, h, np.searchsorted(offs, starts, "right") - 1


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = index_vectors()
    total, count = np.zeros(BUCKETS * DIM, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, texts in kernel.pieces(batch.column(0), PIECE):
            b, _, _, text = tokens(texts)
            count += np.bincount(b, minlength=BUCKETS)
            for gap in range(1, REACH + 1):
                ok = text[gap:] == text[:-gap]
                left, right = b[:-gap][ok], b[gap:][ok]
                for k in range(NONZERO):
                    for a, c in ((left, right), (right, left)):
                        s = sign[c, k]
                        at = a * DIM + place[c, k]
                        total += np.bincount(at[s > 0], minlength=BUCKETS * DIM) - np.bincount(at[s < 0], minlength=BUCKETS * DIM)
    if count.any():
        live = np.flatnonzero(count)
        cols = total.reshape(BUCKETS, DIM)[live]
        yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(count[live]), *(pa.array(cols[:, k]) for k in range(DIM))], names=["bucket", "n", *(f"c{k}" for k in range(DIM))])


@dataclass(frozen=True)
class Vectors:
    table: np.ndarray  # bucket x dim, float32, weighted for pooling
    weight: np.ndarray


def fit_vectors(docs: DataFrame, *, text: str = "text") -> Vectors:
    """Context vectors from all documents; what reaches the driver is BUCKETS rows at most."""
    names = [f"c{k}" for k in range(DIM)]
    rows = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(_contexts, "bucket long, n long, " + ", ".join(f"{c} long" for c in names))
    got = rows.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).collect()
    table, n = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
    for r in got:
        table[r["bucket"]], n[r["bucket"]] = [r[c] for c in names], r["n"]
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    weight = np.where(n > 0, 1e-3 / (1e-3 + n / max(n.sum(), 1)), 0)
    return Vectors((table * weight[:, None]).astype(np.float32), weight.astype(np.float32))


def inputs(v: Vectors, arr: pa.Array) -> np.ndarray:
    """What the network sees of each text: its pooled vector, shares of shapes, share of distinct tokens, length, and line repeats."""
    n = len(arr)
    b, shape, h, text = tokens(arr)
    count = np.bincount(text, minlength=n).astype(np.float64)
    safe = np.maximum(count, 1)
    out = np.zeros((n, DIM + SHAPES + 4))
    if len(b):
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        out[text[first], :DIM] = np.add.reduceat(v.table[b], first, axis=0)
        mass = np.bincount(text, v.weight[b], minlength=n)
        out[:, :DIM] /= np.maximum(mass, 1e-9)[:, None]
        out[:, DIM : DIM + SHAPES] = np.bincount(text * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES) / safe[:, None]
        keys = (h & ~np.uint64(0xFFFFFF)) ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        new = np.unique(keys, return_index=True)[1]
        out[:, -4] = np.bincount(text[new], minlength=n) / safe
        if len(h) > 3:
            run = kernel.mix(h[:-3] * np.uint64(3) + kernel.mix(h[1:-2] * np.uint64(5) + h[2:-1]) * np.uint64(7) + h[3:])
            ok = text[:-3] == text[3:]
            owner = text[:-3][ok]
            runs = kernel.mix(run[ok]) ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            new = np.unique(runs, return_index=True)[1]
            out[:, -3] = 1 - np.bincount(owner[new], minlength=n) / np.maximum(np.bincount(owner, minlength=n), 1)
    out[:, -2] = np.log1p(count)
    size = np.diff(kernel.raw(arr)[1])
    out[:, -1] = size / safe / 10
    return out


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1)
        return sigmoid((hidden @ self.w2 + self.b2) / self.temperature)


def fit_network(x: np.ndarray, y: np.ndarray, *, hidden: int = HIDDEN, epochs: int = EPOCHS, decay: float = 1e-3) -> Network:
    """Adam over batches in a fixed order; every fifth row is kept back for the temperature."""
    d = x.shape[1] if len(x) else DIM + SHAPES + 4
    rng = np.random.default_rng(7)
    if len(y) == 0 or y.min() == y.max():
        level = 2.0 if len(y) == 0 or y[0] else -2.0  # nothing to tell apart: all texts score alike
        return Network(np.zeros(d), np.ones(d), np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), level, 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    back = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    fx, fy = z[~back], y[~back].astype(float)
    p = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for e in range(epochs):
        order = rng.permutation(len(fy))
        for k in range(0, len(order), 128):
            at = order[k : k + 128]
            a, t = fx[at], t + 1
            hid = np.tanh(a @ p[0] + p[1])
            g = (sigmoid(hid @ p[2] + p[3][0]) - fy[at]) / len(at)
            gh = np.outer(g, p[2]) * (1 - hid**2)
            grads = [a.T @ gh + decay * p[0], gh.sum(0), hid.T @ g + decay * p[2], np.array([g.sum()])]
            rate = 0.01 * (1 - e / epochs) + 0.0005
            for i, q in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * q, 0.999 * v[i] + 0.001 * q * q
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    temperature = 1.0
    if back.any():
        logit = np.tanh(z[back] @ p[0] + p[1]) @ p[2] + p[3][0]
        grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
        yb = y[back]
        loss = [-np.mean(np.log(np.where(yb == 1, q := sigmoid(logit / c), 1 - q) + 1e-12)) for c in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), temperature)


def _seen(v: Vectors, extra: int):
    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in kernel.pieces(batch.column(extra), PIECE):
                x = inputs(v, texts)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(texts)) for k in range(extra)), flat], names=[*batch.schema.names[:extra], "x"])

    return seen


def train_quality(docs: DataFrame, labels: DataFrame, vectors: Vectors, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Network:
    """Fit on at most ``sample`` labelled ids outside the held-out fold, one text each; what reaches the driver is that many short vectors."""
    few = labelled_sample(labels, label, doc_id=doc_id, most=sample)
    rows = labelled_texts(docs, few, doc_id=doc_id, text=text)
    kind = docs.schema[doc_id].dataType.simpleString()
    got = sorted(rows.mapInArrow(_seen(vectors, 2), f"id {kind}, y int, x array<double>").collect(), key=lambda r: (str(r["id"]), r["x"]))
    return fit_network(np.array([r["x"] for r in got]), np.array([r["y"] for r in got]))


def quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """One row per document: held_out, score (0 to 1), predicted (1 if score >= threshold).

    A null or empty text is scored as a text without tokens. Repeated rows score alike. Without labels of two kinds every text has
    one and the same score. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    vectors = fit_vectors(docs, text=text)
    net = train_quality(docs, labels, vectors, doc_id=doc_id, text=text, sample=sample)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in kernel.pieces(batch.column(1), PIECE):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(net.probability(inputs(vectors, texts)))], names=["id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    found = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(scored, f"id {kind}, score double")
    return found.select(F.col("id").alias(doc_id), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
