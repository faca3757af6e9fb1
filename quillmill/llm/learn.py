"""Labelled samples, and what the two classifiers share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Documents that a classifier is fitted on at most, and characters of one of them at most. Both bounds concern
#: fitting alone; every document is scored, and scored whole.
TRAIN_DOCS, TRAIN_CHARS = 6000, 100_000
#: Bytes of texts that it is fitted on at most, which bounds the one task that does it.
TRAIN_BYTES = 1 << 24


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> DataFrame:
    """(h, doc_id, text, y): texts and 0/1 labels of at most `limit` distinct labelled documents outside the held-out fifth.

    The sample is the ids with the smallest hashes h, so it is the same at each run. Labels that are null, or that
    contradict each other for one id, teach nothing, and neither do null ids.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min(label).alias("__y"), F.max(label).alias("__z")).where("__y = __z")
    chosen = known.select("doc_id", "__y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= chars))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("__y").cast("long").alias("y"))
    return rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "y")


def texts_and_labels(sample: pa.Table, most: int = TRAIN_BYTES) -> tuple[list[bytes], np.ndarray]:
    """The rows of a sample in the order of their hashes, as far as `most` bytes go."""
    sample = sample.sort_by([("h", "ascending"), ("doc_id", "ascending")])
    texts = [t.encode() for t in sample.column("text").to_pylist()]
    n = int(np.searchsorted(np.cumsum(list(map(len, texts))), most, side="right"))
    return texts[:n], sample.column("y").to_numpy().astype(np.int64)[:n]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> tuple[list[bytes], np.ndarray]:
    """The texts and labels of sample_rows()."""
    return texts_and_labels(sample_rows(docs, labels, label, limit, chars).toArrow())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, name: str, x: np.ndarray, g: np.ndarray) -> None:
        self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * g
        self.v[name] = 0.99 * self.v.get(name, 0) + 0.01 * g * g
        c = max(self.t, 1)
        x -= self.rate * (self.m[name] / (1 - 0.9**c)) / (np.sqrt(self.v[name] / (1 - 0.99**c)) + 1e-8)
