"""Ordinal quality grades: cumulative-link regression on hashed text.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector for all grades, ordered thresholds. x are square roots of
the shares of a text's hashed character trigrams and of hashed shape marks (how many words differ, how many characters
are capitals or signs). A text is kept when P(grade >= keep_from) reaches ``least``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill.llm.labelled import labelled
from proofmill.llm.store import documents
from proofmill.llm.words import blocks, raw_texts, word_hashes

BUCKETS = 2048
#: Labelled documents of each grade that the model is fitted on, at most.
FIT_ROWS = 1500
_SHAPES = 4 * 16
_KIND = np.zeros(256, np.uint8)  # 1 capital, 2 sign, 3 space
_KIND[65:91] = 1
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3


def features(raws: list[bytes]) -> np.ndarray:
    """A row for each text; an empty text has zeros but for its shape."""
    out = np.zeros((len(raws), BUCKETS + _SHAPES), np.float32)
    for a, b in blocks(raws):
        joined = np.frombuffer(b"".join(r + b"\n\n\n" for r in raws[a:b]), np.uint8)
        doc = np.repeat(np.arange(b - a), [len(r) + 3 for r in raws[a:b]])
        x = joined.astype(np.uint32)
        gram = ((x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F)
        counts = np.bincount(doc[:-2] * BUCKETS + (gram >> np.uint32(21)), minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS)
        out[a:b, :BUCKETS] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
        kinds = np.bincount(doc * 4 + _KIND[joined], minlength=4 * (b - a)).reshape(b - a, 4)
        solid = np.maximum(kinds[:, :3].sum(axis=1), 1)
        hashes, of = word_hashes(raws[a:b])
        words = np.bincount(of, minlength=b - a)
        distinct = np.bincount(of[np.unique(hashes ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]], minlength=b - a) if len(of) else words
        shapes = [np.minimum(15, 15 * distinct // np.maximum(words, 1)), np.minimum(15, 30 * kinds[:, 1] // solid), np.minimum(15, 30 * kinds[:, 2] // solid), np.minimum(15, np.log2(words + 1).astype(int))]
        for i, shape in enumerate(shapes):
            out[np.arange(a, b), BUCKETS + 16 * i + shape] = 0.3
    return out


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(self.thresholds[None, :] - (x @ self.weights)[:, None]))


def fit(x: np.ndarray, y: np.ndarray, grades: int, steps: int = 250, rate: float = 0.15, ridge: float = 1e-4) -> Model:
    """Maximum likelihood by Adam over all rows, grades weighed alike. Without rows all tails are one half."""
    w, gaps = np.zeros(x.shape[1]), np.zeros(grades - 1)  # the first threshold, then logarithms of the steps
    if not len(x):
        return Model(w, np.zeros(grades - 1))
    weight = (1 / np.maximum(np.bincount(y, minlength=grades), 1))[y]
    weight /= weight.sum()
    moments = [np.zeros(len(w) + grades - 1) for _ in range(2)]
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -500, 500)))
    for step in range(1, steps + 1):
        limits = np.concatenate([[-np.inf], np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])])), [np.inf]])
        z = x @ w
        upper, lower = sigmoid(limits[y + 1] - z), sigmoid(limits[y] - z)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        dz = weight * (du - dl)  # of the loss by z
        dt = np.array([-(weight * du)[y == k].sum() + (weight * dl)[y == k + 1].sum() for k in range(grades - 1)])
        dgap = np.array([dt.sum(), *(np.exp(gaps[i]) * dt[i:].sum() for i in range(1, grades - 1))])
        g = np.concatenate([dz @ x + ridge * w, dgap])
        for m, v, decay in ((moments[0], g, 0.9), (moments[1], g * g, 0.99)):
            m *= decay
            m += (1 - decay) * v
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w -= move[: len(w)]
        gaps -= move[len(w) :]
    return Model(w, np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])])))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fits grades 0 (quality 0), 1 (quality 1, toxic), 2 (quality 1, not toxic) on a bounded sample of labelled texts."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)
    sample = labelled(docs, labels, grade, {0: rows, 1: rows, 2: rows}).orderBy("doc_id").toPandas()
    return fit(features([t.encode("utf-8") for t in sample["text"]]), sample["y"].to_numpy(np.int64), 3)


def grade(docs: DataFrame, model: Model, keep_from: int = 1, least: float = 0.5) -> DataFrame:
    """``docs`` with expected_grade, tail_probability (of ``keep_from`` or more) and kept, columns of these names replaced.

    A null text is graded as an empty one. Repeated rows get the same grades; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    own = ["expected_grade", "tail_probability", "kept"]
    docs = docs.drop(*own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                tails = held.value.tails(features(raw_texts(part.column(part.schema.get_field_index("text")))))
                tail = tails[:, keep_from - 1]
                added = [pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= least)]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, *own])

    kinds = [T.DoubleType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(own, kinds, strict=True))])
    return docs.mapInArrow(run, schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return grade(docs.select("doc_id", "text"), model).drop("text")
