"""Toxicity scores by the recurrent network: the worst of all overlapping windows of a text counts.

Labels are of texts, not of windows. Fitting starts from the window of each toxic text that holds the most telling
words (by log-odds of word and n-gram buckets among the fitted texts), later from the window that the network itself
finds worst; of other texts it takes the worst window and a random one. A shift and the threshold 0.7 are then set on
the fitted texts' scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm.labelled import labelled
from proofmill.llm.recurrent import GRAMS, WORDS, E, Network, Words
from proofmill.llm.store import documents
from proofmill.llm.words import blocks, raw_texts

#: Labelled documents, toxic and other, that the network is fitted on, at most.
FIT_ROWS = {1: 800, 0: 1600}
ROUNDS, EPOCHS = 3, 8
#: Share of words that a fitting step reads whole; the others only by their characters. Decay of all weights by step.
KNOWN, DECAY = 0.3, 1e-3


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _odds(bucket: np.ndarray, doc: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Smoothed log-odds of being in a toxic text, by bucket."""
    pair = np.unique(bucket.astype(np.int64) * len(y) + doc)
    toxic = y[pair % len(y)] == 1
    t, o = (np.bincount(pair[part] // len(y), minlength=n) for part in (toxic, ~toxic))
    rate = lambda c, m: (c + 0.5) / (m + 1)
    return np.log(rate(t, y.sum()) / rate(o, (1 - y).sum())).astype(np.float32)


def fit(raws: list[bytes], y: np.ndarray, seed: int = 1) -> Network:
    net, r = Network(seed), np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        net.p["bo"][:] = 0
        net.shift = 1e6  # nothing learned: nobody is toxic
        return net
    w = Words(raws)
    start, length, doc = w.windows(len(raws))
    pairs = np.unique(w.index * len(y) + w.doc)
    word_of, doc_of = pairs // len(y), pairs % len(y)
    words = _odds(w.bucket[word_of], doc_of, y, WORDS)
    seen = np.zeros(len(w.size), np.float32) + words[w.bucket]
    reps = w.size[word_of]
    at = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(w.offsets[word_of], reps)
    grams = np.zeros(GRAMS, np.float32)
    for i in (0, 1):
        grams += _odds(w.grams[at, i], np.repeat(doc_of, reps), y, GRAMS) * (np.bincount(w.grams[:, i], minlength=GRAMS) > 0)
    net.p["words"][:, 0] += np.clip(words, -2, 4) / 4
    net.p["grams"][:, 0] += np.clip(grams, -2, 4) / 4
    seen = seen + np.maximum.reduceat(grams[w.grams].max(axis=1), w.offsets)
    flat = seen[w.index]
    worst = np.array([flat[s : s + n].max() for s, n in zip(start.tolist(), length.tolist(), strict=True)])

    toxic, other = np.flatnonzero(y[doc] == 1), np.flatnonzero(y[doc] == 0)

    def top(windows: np.ndarray) -> np.ndarray:
        order = windows[np.lexsort((worst[windows], doc[windows]))]
        return order[np.append(np.diff(doc[order]) > 0, True)] if len(order) else order

    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for _ in range(ROUNDS):
        chosen = np.concatenate([top(toxic), top(other), r.choice(other, min(len(other), len(y)))])
        labels = y[doc[chosen]].astype(np.float32)
        weights = np.where(labels == 1, 1.0, labels.sum() / max(1, (1 - labels).sum())).astype(np.float32)
        # only the words of the chosen windows
        for _ in range(EPOCHS):
            order = r.permutation(len(chosen))
            for a in range(0, len(order), 256):
                part = chosen[order[a : a + 256]]
                these = _only(w, start[part], length[part])
                known = r.random(len(these.size)) < KNOWN
                g = net.gradients(these, *_places(length[part]), labels[order[a : a + 256]], weights[order[a : a + 256]] / 64, known)
                step += 1
                for k, (m, v) in moments.items():
                    m += 0.1 * (g[k] - m)
                    v += 0.01 * (g[k] * g[k] - v)
                    net.p[k] *= 1 - DECAY
                    net.p[k] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        gates = net.gates(net.inputs(w))
        worst = np.concatenate([net.forward(gates, w.index, start[a : a + 4000], length[a : a + 4000]) for a in range(0, len(start), 4000)])
    best = np.full(len(y), -20.0)
    np.maximum.at(best, doc, worst)
    # The shift: the logit that parts the fitted texts with the fewest errors, at a quarter of its gap, since unseen toxic
    # texts fall short of the fitted ones by more than unseen others exceed them.
    order = np.argsort(best)
    wrong = np.cumsum(np.where(y[order] == 1, 1.0, -1.0)) + (y == 0).sum()
    wrong = np.concatenate([[(y == 0).sum()], wrong])
    ends = np.concatenate([[best[order[0]] - 1], 0.25 * best[order][1:] + 0.75 * best[order][:-1], [best[order[-1]] + 1]])
    least = np.flatnonzero(wrong == wrong.min())
    net.shift = float(ends[least[len(least) // 2]])
    return net


def _only(w: Words, start: np.ndarray, length: np.ndarray) -> Words:
    """The words of some windows, laid end to end."""
    out = object.__new__(Words)
    places = np.concatenate([np.arange(s, s + n) for s, n in zip(start.tolist(), length.tolist(), strict=True)])
    used, out.index = np.unique(w.index[places], return_inverse=True)
    out.bucket, out.size = w.bucket[used], w.size[used]
    out.offsets = np.cumsum(out.size) - out.size
    out.grams = w.grams[np.arange(out.size.sum()) - np.repeat(out.offsets, out.size) + np.repeat(w.offsets[used], out.size)]
    return out


def _places(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(length) - length, length


def train(docs: DataFrame, labels: DataFrame, rows: dict[int, int] | None = None) -> Network:
    """Fits on a bounded sample of labelled texts that aren't held out."""
    value = F.when(held_out(F.col("doc_id")), None).otherwise(F.col("toxic"))
    sample = labelled(docs, labels, value, rows or FIT_ROWS).orderBy("doc_id").toPandas()
    return fit([t.encode("utf-8").lower() for t in sample["text"]], sample["y"].to_numpy(np.int64))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.7) of each row of ``docs`` (doc_id, text).

    A null text and one without words score 0. Repeated rows score alike; an empty table gives no rows; a null id isn't
    held out.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [x.lower() for x in raw_texts(batch.column(1))]
            for a, b in blocks(raws):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(held.value.scores(raws[a:b]))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
