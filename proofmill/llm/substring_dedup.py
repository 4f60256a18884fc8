"""Removal of repeated word windows, by level-wise doubling.

The windows that matter have ``length`` words. Levels look at shorter windows, of length / 4 words, then twice as many,
and so on up to ``length``. At each level the window with the least hash inside a full window stands for it, so equal
full windows have equal representatives; the representatives' hashes are counted over the corpus, and only full windows
whose representative repeats are candidates at twice the length. The loop ends with the last level, or as soon as no
candidate survives. At the last level neighbouring candidates form runs. Equal runs are settled as a whole (all but the
first go); the windows of the first runs are hashed, grouped, and all but the first of each group go. Longer windows
need no level: their words are covered already.

Windows and runs are taken for equal by 96 bits of hashes (among 10^13 windows about one pair in a thousand such corpora
is taken for equal by chance), and levels before the last by 64 bits, which may keep a candidate too many and lose none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm.store import discard, documents, written
from proofmill.llm.words import blocks, mixed, raw_texts, sliding, window_hashes, word_hashes

LENGTH = 20
#: Shorter levels before the last.
LEVELS = 2
_KEPT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
#: A row of the input: its id (null least), and a 63-bit hash of its text, which tells rows of one id apart.
_ROW = ["id", "txt"]


def _representatives(hashes: np.ndarray, doc: np.ndarray, length: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows of ``part`` words, the least one inside each full window, and whether the full window lies
    in one text."""
    inside = length - part + 1
    parts, _ = window_hashes(hashes, doc, part)
    n = len(hashes) - length + 1
    if n <= 0:
        return parts, np.empty(0, np.uint64), np.empty(0, bool)
    return parts, sliding(parts, inside, np.minimum), doc[:n] == doc[length - 1 :]


def _chosen(parts: np.ndarray, least: np.ndarray, candidate: np.ndarray, inside: int) -> np.ndarray:
    """Which of the part windows stand for some candidate."""
    if not len(least):
        return np.zeros(len(parts), bool)
    pad = np.zeros(inside - 1, np.uint64)
    return (sliding(np.concatenate([pad, np.where(candidate, least, np.uint64(0)), pad]), inside, np.maximum) == parts) & (parts > 0)


def _candidates(hashes: np.ndarray, doc: np.ndarray, length: int, done: list[int], known: list[np.ndarray]) -> np.ndarray:
    """Full windows whose representatives repeat at all levels that are done."""
    n = max(len(hashes) - length + 1, 0)
    ok = doc[:n] == doc[length - 1 :] if n else np.zeros(0, bool)
    for part, repeated in zip(done, known, strict=True):
        if n:
            _, least, _ = _representatives(hashes, doc, length, part)
            ok &= np.isin(least, repeated)
    return ok


def _known(batch: pa.RecordBatch, levels: int, a: int, b: int) -> list[np.ndarray]:
    """Repeated hashes that some texts of the batch hold, for each level: a superset for each text, which is enough."""
    columns = [batch.column(f"known{i}").slice(a, b - a) for i in range(levels)]
    return [np.asarray(c.flatten().to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64) for c in columns]


def _anchors(docs: DataFrame, length: int, done: list[int], part: int) -> DataFrame:
    """h, id, txt of the windows of ``part`` words that stand for a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = raw_texts(batch.column("text"))
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in _ROW]
            for a, b in blocks(raws):
                hashes, doc = word_hashes(raws[a:b])
                parts, least, _ = _representatives(hashes, doc, length, part)
                candidate = _candidates(hashes, doc, length, done, _known(batch, len(done), a, b))
                at = np.flatnonzero(_chosen(parts, least, candidate, length - part + 1))
                of = doc[at]
                yield pa.RecordBatch.from_arrays([pa.array(parts[at].view(np.int64)), *(pa.array(k[a:b][of]) for k in keys)], ["h", *_ROW])

    return docs.mapInArrow(run, "h long, id long, txt long")


_RUN = "id long, txt long, start int, n int, w1 long, w2 int, hashes array<long>, seconds array<int>"


def _runs(docs: DataFrame, length: int, done: list[int]) -> DataFrame:
    """Runs of candidates: the row, start, n, w1 and w2 (hashes of the run), and two hashes for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = [c.split()[0] for c in _RUN.split(", ")]
        for batch in batches:
            raws = raw_texts(batch.column("text"))
            ids, txts = (batch.column(c).to_pylist() for c in _ROW)
            for a, b in blocks(raws):
                hashes, doc = word_hashes(raws[a:b])
                hit = _candidates(hashes, doc, length, done, _known(batch, len(done), a, b))
                if not hit.any():
                    continue
                full, second = window_hashes(hashes, doc, length)[0], window_hashes(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), doc, length)[0]
                first = np.searchsorted(doc, np.arange(b - a))
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                cut = np.flatnonzero(np.diff(doc[: len(hit)])) + 1  # runs end with their text
                bounds = np.union1d(edge, cut)
                rows = []
                for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if not hit[s]:
                        continue
                    whole = hashlib.blake2b(full[s:e].tobytes() + second[s:e].tobytes(), digest_size=12).digest()
                    w1, w2 = (int.from_bytes(w, "little", signed=True) for w in (whole[:8], whole[8:]))
                    d = int(doc[s])
                    rows.append((ids[a + d], txts[a + d], s - int(first[d]), e - s, w1, w2, full[s:e].view(np.int64), (second[s:e] >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.mapInArrow(run, _RUN)


def levels_of(length: int) -> list[int]:
    """Lengths before the last, each half of the next (at least one word)."""
    return sorted({max(1, length >> i) for i in range(1, LEVELS + 1)} - {length})


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Windows of ``docs`` (id, txt, text) that start earlier elsewhere, as ranges: id, txt, start, n (windows, one after
    another). Stored."""
    left, done, tables = docs, [], []
    for part in levels_of(length):
        anchors = _anchors(left, length, done, part)
        again = written(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), f"level-{part}")
        done.append(part)
        if not again.limit(1).count():  # no candidate survives
            break
        known = anchors.join(again.hint("shuffle_hash"), "h").groupBy(*_ROW).agg(F.collect_set("h").alias(f"known{len(done) - 1}"))
        tables.append(written(known, f"known-{part}"))
        discard(again)
        left = docs
        for table in tables:
            left = left.join(table, _ROW)
    runs = written(_runs(left if len(tables) == len(done) else docs.where("false").withColumns({f"known{i}": F.array().cast("array<bigint>") for i in range(len(done))}), length, done), "runs")
    discard(*tables)

    place, run = F.struct(*_ROW, "start"), ["w1", "w2", "n"]
    firsts = written(runs.groupBy(*run).agg(F.min(place).alias("first"), F.count("*").alias("count")).where("count > 1").select(*run, "first"), "first-runs")
    late = written(runs.drop("hashes", "seconds").join(firsts, run).where(place > F.col("first")).select(*_ROW, "start", "n"), "late-runs")
    heads = runs.join(late.select(*_ROW, "start"), [*_ROW, "start"], "left_anti")
    both = F.posexplode(F.arrays_zip("hashes", "seconds")).alias("i", "h")
    windows = heads.select(*_ROW, "start", both).select(*_ROW, (F.col("start") + F.col("i")).alias("start"), F.col("h.hashes").alias("h"), F.col("h.seconds").alias("h2"))
    windows = written(windows, "windows")
    discard(runs, firsts)
    first = written(windows.groupBy("h", "h2").agg(F.min(place).alias("first"), F.count("*").alias("count")).where("count > 1").select("h", "h2", "first"), "first-windows")
    single = windows.join(first, ["h", "h2"]).where(place > F.col("first")).select(*_ROW, "start", F.lit(1).alias("n"))
    found = written(late.unionByName(single), "repeats")
    discard(late, windows, first)
    return found


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` (doc_id, text) without the words that a repeated window covers: doc_id, n_words, n_removed, kept_text, kept_sha256.

    A window is ``length`` consecutive words of one text; it is repeated if its words also start earlier (smaller
    doc_id, null least, or the same doc_id further ahead). A null or empty text has no words and keeps the empty text.
    Rows that share an id are documents of their own if their texts differ: the one with the least hash of its text
    comes first. Repeated rows (equal ids and texts) aren't earlier than each other and lose the same words. An empty
    table gives no rows; other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    half = F.shiftrightunsigned(F.xxhash64("text"), 1)  # rows without an id stand before those of the least one
    plain = plain.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.when(F.col("doc_id").isNull(), -1 - half).otherwise(half).alias("txt"), "text")
    ranges = repeats(plain.drop("doc_id").where("text is not null"), length).groupBy(*_ROW).agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for key, raw, starts, ns in zip(part.column(0).to_pylist(), raw_texts(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    words = raw.split()
                    kept = words
                    if starts:
                        steps = np.zeros(len(words) + 1, np.int64)
                        np.add.at(steps, starts, 1)
                        np.add.at(steps, np.add(starts, ns) + length - 1, -1)
                        kept = [*compress(words, np.cumsum(steps[:-1]) == 0)]
                    text = b" ".join(kept)
                    rows.append((key, len(words), len(words) - len(kept), text.decode("utf-8"), hashlib.sha256(text).hexdigest()))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = [c.split()[0] for c in _KEPT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return plain.join(ranges, _ROW, "left").select("doc_id", "text", "starts", "ns").mapInArrow(run, _KEPT)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).drop("kept_text")
