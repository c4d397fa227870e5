"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The presence of each unigram, bigram and one-word skip-gram of a whole text, hashed to ``2 ** BITS`` coordinates, is a
feature. Training passes over a bounded sample of labelled rows in a fixed order in one task; per-coordinate rates and L1 leave a few
hundred weights, which are broadcast as a short list. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import kernel
from quarry.llm.learning import held_out, labelled_sample, labelled_texts, sigmoid

BITS = 20
SAMPLE = 10_000


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 16.0
    l2: float = 0.0
    epochs: int = 8
    positive: float = 3.0  # weight of a toxic row


@dataclass(frozen=True)
class Model:
    """Sorted coordinates with weights other than 0; without labels of both kinds, bias alone."""

    at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -35.0


def features(arr: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, texts they belong to), with repeats."""
    h, offs = kernel.words(arr)
    row = kernel.rows_of(offs)
    shift = np.uint64(64 - bits)
    found, rows = [h >> shift], [row]
    for gap, salt in ((1, 0x9FB21C651E98DF25), (2, 0xD1B54A32D192ED03)):
        if len(h) > gap:
            ok = row[gap:] == row[:-gap]
            found.append(kernel.mix(h[:-gap][ok] * np.uint64(salt) + h[gap:][ok]) >> shift)
            rows.append(row[:-gap][ok])
    return np.concatenate(found).astype(np.int64), np.concatenate(rows)


def train(rows: list[tuple[np.ndarray, int]], ftrl: Ftrl = Ftrl(), bits: int = BITS) -> Model:
    """rows: (distinct coordinates, label), in the order of training."""
    y = np.array([y for _, y in rows])
    if not len(y):
        return Model()
    bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_n = 1.0
    for _ in range(ftrl.epochs):
        for at, label in rows:
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= ftrl.l1, 0.0, (np.sign(zi) * ftrl.l1 - zi) / ((ftrl.beta + root) / ftrl.alpha + ftrl.l2))
            g = (float(sigmoid(np.array(w.sum() + bias))) - label) * (ftrl.positive if label else 1.0)
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - root) / ftrl.alpha * w
            n[at] = more
            bias_n += g * g
            bias -= ftrl.alpha * g / np.sqrt(bias_n)
    at = np.flatnonzero(np.abs(z) > ftrl.l1)
    w = (np.sign(z[at]) * ftrl.l1 - z[at]) / ((ftrl.beta + np.sqrt(n[at])) / ftrl.alpha + ftrl.l2)
    return Model(at, w, bias)


def _extract(bits: int):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in kernel.pieces(batch.column(2)):
                at, row = features(texts, bits)
                key = np.unique(row << bits | at)
                ends = np.searchsorted(key >> bits, np.arange(len(texts) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key & ((1 << bits) - 1), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)), lists], names=["id", "y", "at"])

    return extract


def _learn(ftrl: Ftrl, bits: int):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            flat, ends = batch.column(2).flatten().to_numpy(), batch.column(2).offsets.to_numpy()
            ends = ends - ends[0]
            for k, (i, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                rows.append((str(i), flat[ends[k] : ends[k + 1]].copy(), y))
        rows.sort(key=lambda r: (hash_order(r[0]), r[0], len(r[1])))
        m = train([(a, y) for _, a, y in rows], ftrl, bits)
        yield pa.RecordBatch.from_arrays([pa.array([m.at.tolist()], pa.list_(pa.int64())), pa.array([m.weight.tolist()], pa.list_(pa.float64())), pa.array([m.bias])], names=["at", "weight", "bias"])

    return learn


def hash_order(name: str) -> int:
    import zlib

    return zlib.crc32(f"order {name}".encode())


def train_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, ftrl: Ftrl = Ftrl(), bits: int = BITS) -> Model:
    """Fit on at most ``sample`` labelled ids outside the held-out fold, one text each; rows of an id that repeats count once, rows without an
    id or label not at all, null texts as empty. Without such rows, or without documents, the model scores every text close to 0."""
    few = labelled_sample(labels, label, doc_id=doc_id, most=sample)
    rows = labelled_texts(docs, few, doc_id=doc_id, text=text)
    kind = docs.schema[doc_id].dataType.simpleString()
    got = rows.mapInArrow(_extract(bits), f"id {kind}, y int, at array<int>").repartition(1).mapInArrow(_learn(ftrl, bits), "at array<long>, weight array<double>, bias double").first()
    return Model(np.array(got["at"], np.int64), np.array(got["weight"]), got["bias"]) if got else Model()


def score(model: Model, arr: pa.Array, bits: int = BITS) -> np.ndarray:
    total = np.full(len(arr), model.bias)
    if len(model.at):
        dense = np.zeros(1 << bits, np.float32)
        dense[model.at] = model.weight
        at, row = features(arr, bits)
        live = np.flatnonzero(dense[at])
        key = np.unique(row[live] << bits | at[live])
        np.add.at(total, key >> bits, dense[key & ((1 << bits) - 1)].astype(np.float64))
    return sigmoid(total)


def score_toxicity(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """(id, score) per document. A null or empty text has the score of the bias; repeated rows score alike; other columns are ignored."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in kernel.pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(score(model, texts, bits))], names=["id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(scored, f"id {kind}, score double").withColumnRenamed("id", doc_id)


def toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", threshold: float = 0.5, **options) -> DataFrame:
    """One row per document: held_out, score (0 to 1), predicted (1 if score >= threshold).

    A null or empty text has the score of the bias. Repeated rows score alike; a null id stays null and is never held out. Other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    found = score_toxicity(docs, train_toxicity(docs, labels, doc_id=doc_id, **options), doc_id=doc_id)
    return found.select(doc_id, held_out(doc_id).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, text: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """The documents below the threshold, whole rows, decided where they stand: nothing is joined or shuffled.

    Each row is judged by its own text: ids may be null or repeat, and null and empty texts stay (without labels every row does). An empty
    table stays empty. Columns stay as they are.
    """
    model = train_toxicity(docs, labels, text=text, **options)
    where = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in kernel.pieces(batch.column(where)):
                yield batch.slice(at, len(texts)).filter(pa.array(score(model, texts) < threshold))

    return docs.mapInArrow(keep, docs.schema)
