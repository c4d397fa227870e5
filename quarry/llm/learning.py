"""What the two classifiers share: folds, the bounded sample of labelled rows, and measures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True for a fifth of the ids; a null id is never held out (and never labelled)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, *, doc_id: str = "doc_id", most: int) -> DataFrame:
    """(id, y) of at most ``most`` labelled rows outside the held-out fold, those with the smallest hashes of their ids.

    Rows with a null id or label don't count; labels that disagree on an id count as the larger. The bound makes
    the result safe to broadcast.
    """
    rows = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).dropna()
    rows = rows.filter(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(most)


def labelled_texts(docs: DataFrame, few: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, y, t): one text for each sampled id. Of rows that share an id the text with the smallest hash stands for it, found by partial
    aggregation, so there are no more rows than the sample has ids, however often one repeats. A null text is empty."""
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(F.broadcast(few), "id")
    return rows.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("m")).select("id", "y", "m.t")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def auc(score: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    s = score[order]
    first = np.searchsorted(s, s, "left")
    last = np.searchsorted(s, s, "right")
    rank[order] = (first + last + 1) / 2
    pos = int(y.sum())
    neg = len(y) - pos
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)) if pos and neg else float("nan")
