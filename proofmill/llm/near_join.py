"""Similarity join of texts on the Jaccard index of their word shingles, with parity sketches.

A shingle's hash picks one bit of a document's sketch and flips it, so the sketches of two sets differ in at most as
many bits as their symmetric difference has members. Two sets of n and m shingles with index t or more differ in at
most D = (n + m) (1 - t) / (1 + t) of them: of B blocks of the sketch at least B - D are the same in both (pigeonhole),
so of the D + 1 blocks that come first in any order that depends on a block's place and bits alone, the two sets share
one. D is reckoned for each document from the largest partner that its band allows; B is SPARE times the band's largest
D + 1 (and one more). Blocks are counted over all documents, and the order puts the frequent ones last:
a block that holds shingles of a common passage alone is joined on by no document that has enough others. Blocks without
a bit come after all others, so that a document names one only if it must.
Documents are put in bands of sizes; a document near a band's end takes part in the next one, so that any two that may
link share a band. A block is WIDTH bits; its bits are joined on by a 64-bit key.

Sets that are equal link without sketches; one document stands for them. In each bucket of equal blocks the documents
are linked with the least one, and, as far as that leaves them in different components, with each other. Documents of a
bucket with more than CROWD that are still apart (their blocks lie in a passage that many share) don't meet there: they
get sketches of WIDE times as many blocks, counted among themselves, whose rare blocks lie outside the passage. Pairs
are dropped in the join itself if sizes, or the sketches folded to COARSE bits, rule a link out. What is left must
differ, in sketches of about two bits a shingle, in no more bits than its sizes allow, then its texts are compared
exactly. Blocks are made in SLICES of the texts, counted and joined in SLICES of their keys, one after another, and each
table is deleted once its successor is stored, so that disk holds a part of the texts and blocks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.llm.components import components
from proofmill.llm.store import discard, documents, written
from proofmill.llm.words import blocks, mixed, raw_texts, window_hashes, word_hashes

WIDTH = 256
#: Sizes of a band reach from its start to this times as much.
BAND = 1.5
#: Blocks of a sketch for each block that is joined on.
SPARE = 1.25
#: Still separate documents of a bucket that meet in pairs, at most; blocks of a sketch for those of a larger bucket.
CROWD, WIDE = 64, 8.0
#: Parts of the texts, and of the keys, that are dealt with one after another.
SLICES = 4
#: Bits of the sketches that are compared in the join of pairs, by words of 64.
COARSE = 512
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))


def shingles(raw: bytes, k: int) -> set[tuple[bytes, ...]]:
    words = raw.translate(_LOWER).split()
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def linked(a: set, b: set, percent: int) -> bool:
    if not a or not b:
        return False
    same = len(a & b)
    return 100 * same >= percent * (len(a) + len(b) - same)


def band_of(n: int) -> int:
    return floor(log(n) / log(BAND) + 1e-9)


def bands(n: int, percent: int) -> list[int]:
    """The bands in which a set of n shingles takes part."""
    return [*range(band_of(n), band_of(n * 100 // percent) + 1)]


def most_of(band: int) -> int:
    """The most shingles of a set in a band."""
    return ceil(BAND ** (band + 1) + 1e-6)


def prefix_of(n: int, band: int, percent: int) -> int:
    """Of that many blocks of a set of n shingles one is shared with each set of the band that it may link: one more than
    they may differ by."""
    return (n + min(most_of(band), n * 100 // percent)) * (100 - percent) // (100 + percent) + 1


def sketch(found: np.ndarray, band: int, percent: int, spare: float = SPARE) -> tuple[np.ndarray, int]:
    """Keys of the blocks of a set's sketch, each the exclusive or of a number for every bit that is set, and how many of
    the most frequent ones needn't be joined on. Blocks without a bit are left out as far as the others are enough."""
    first = prefix_of(len(found), band, percent)
    m = ceil(spare * prefix_of(most_of(band), band, percent)) + 1
    block = ((found >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    places, flips = np.unique(block * np.uint64(WIDTH) + (found & np.uint64(WIDTH - 1)), return_counts=True)
    places = places[flips % 2 == 1]
    block = (places // np.uint64(WIDTH)).astype(np.int64)
    keys = mixed(np.arange(m, dtype=np.uint64) + np.uint64(1) + (np.uint64(band) << np.uint64(40)))
    filled = np.zeros(m, bool)
    if len(places):
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        keys[block[starts]] ^= np.bitwise_xor.reduceat(mixed(places + np.uint64(1) + (np.uint64(band) << np.uint64(48))), starts)
        filled[block[starts]] = True
    named = np.concatenate([keys[filled], np.sort(keys[~filled])[: max(first - int(filled.sum()), 0)]])
    return named, max(len(named) - first, 0)


def parity(found: np.ndarray, width: int) -> np.ndarray:
    return np.packbits(np.bincount((found & np.uint64(width - 1)).astype(np.int64), minlength=width) % 2 == 1, bitorder="little")


def folded(found: np.ndarray) -> bytes:
    """The parity sketch of a set in 2 to 4 bits a shingle, within limits; a wider one folds to a narrower one."""
    return parity(found, min(max(256, 1 << (2 * len(found)).bit_length()), 8192)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Bits in which two folded sketches differ."""
    short, long = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(short ^ np.bitwise_xor.reduce(long.reshape(-1, len(short)), axis=0)).sum())


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's id and the sorted hashes of its distinct shingles."""
    ids, raws = batch.column(0).to_pylist(), [r.translate(_LOWER) for r in raw_texts(batch.column(1))]
    for a, b in blocks(raws):
        hashes, doc = word_hashes(raws[a:b])
        windows, _ = window_hashes(hashes, doc, k)
        at = np.searchsorted(doc, np.arange(b - a + 1))
        for i in range(b - a):
            lo, hi = at[i], at[i + 1]
            if hi - lo >= k:
                found = np.unique(windows[lo : hi - k + 1])
            elif hi > lo:
                found = window_hashes(hashes[lo:hi], doc[lo:hi], int(hi - lo))[0] + np.uint64(hi - lo)
            else:
                found = np.empty(0, np.uint64)
            yield ids[a + i], found


_COARSE = [f"w{i}" for i in range(COARSE // 64)]
_SKETCHES = "id long, n long, s1 long, s2 long, bits binary" + "".join(f", {w} long" for w in _COARSE)


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    """id, number of shingles, two sums that tell sets apart, folded sketch, and a narrower one in words of 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, found in _sets(batch, k):
                sums = [found.sum(dtype=np.uint64), mixed(found).sum(dtype=np.uint64)]
                rows.append((key, len(found), *(int(s.view(np.int64)) for s in sums), folded(found), *parity(found, COARSE).view(np.int64).tolist()))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * len(_COARSE)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _SKETCHES.split(", ")])

    return docs.mapInArrow(run, _SKETCHES)


_ENTRIES = "key long, id long, band short, spare int"


def _entries(docs: DataFrame, k: int, percent: int, wide: float) -> DataFrame:
    """The blocks that each text may be joined on, in all of its bands; spare of them needn't be, the most frequent ones."""

    def made(parts: list[tuple[np.ndarray, int, int, int]]) -> pa.RecordBatch:
        sizes = [len(p[0]) for p in parts]
        rest = [np.repeat(np.array([p[i] for p in parts], t), sizes) for i, t in ((1, np.int64), (2, np.int16), (3, np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[0] for p in parts]).view(np.int64)), *map(pa.array, rest)], ["key", "id", "band", "spare"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            for key, found in _sets(batch, k):
                for band in bands(len(found), percent) if len(found) else []:
                    if prefix_of(len(found), band, percent) > 1:  # else only equal sets link
                        keys, spare = sketch(found, band, percent, wide)
                        parts.append((keys, key, band, spare))
                        size += len(keys)
                if size > 200_000:
                    yield made(parts)
                    parts, size = [], 0
            if parts:
                yield made(parts)

    return docs.mapInArrow(run, _ENTRIES)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _buckets(docs: DataFrame, k: int, percent: int, wide: float) -> DataFrame:
    """key, id: of each text's blocks those that it is joined on and that some other text has, too."""
    # Texts are shuffled to leave out copies: a part of them at a time, so that disk never holds all beside the entries.
    made = [written(_entries(docs.where(F.pmod(F.xxhash64("id"), F.lit(SLICES)) == i), k, percent, wide), "entries") for i in range(SLICES)]
    entries, parts = union(made), []
    for i in range(SLICES):
        part = entries.where(F.pmod(F.col("key"), F.lit(SLICES)) == i)
        often = written(part.groupBy("key").agg(F.count("*").alias("met")).where("met > 1"), "often")
        parts.append(written(part.join(often, "key"), "met"))
        discard(often)
    discard(*made)
    order = Window.partitionBy("id", "band").orderBy(F.desc("met"), "key")
    joined = written(union(parts).withColumn("place", F.row_number().over(order)).where("place > spare").select("key", "id"), "joined")
    discard(*parts)
    return joined


def _verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link and whose texts have it."""
    side = lambda c: sketches.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")]
            good = [apart(x, y) * (100 + percent) <= (n + m) * (100 - percent) for n, m, x, y in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    near = written(both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(close, "a long, b long"), "near")
    text = lambda c: docs.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                last, one, good = None, set(), []
                for a, b in zip(raw_texts(part.column(2)), raw_texts(part.column(3)), strict=True):
                    if a != last:
                        last, one = a, shingles(a, k)
                    good.append(linked(one, shingles(b, k), percent))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    # Shuffles at any size, as below.
    with_a = near.join(text("a").hint("merge"), "a")
    return with_a.join(text("b").hint("merge"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Components of near-duplicate texts: doc_id, n_shingles, component_id (the least doc_id reached by links).

    ``docs`` has doc_id and text. A text's set holds its distinct shingles of ``k`` words, letters A-Z lowered; with
    fewer words the whole sequence is its one shingle; without words or text it is empty and linked with nothing. Two
    documents link when 100 * intersection >= ``percent`` * union. Null ids take no part in links and stand for
    themselves. Rows that share an id count as linked when their sets are equal, and otherwise share what links either.
    """
    plain = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    sketches = written(_sketches(plain, k), "sketches")
    sets = sketches.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"))
    sets = written(sets, "sets")
    classes = sketches.where("n > 0").join(sets, ["n", "s1", "s2"]).select("id", "rep")

    own = written(sketches.join(sets.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").drop("s1", "s2"), "own")
    # A shuffle at any size, so that what it needs of disk is in proportion to the texts.
    joined = _buckets(plain.join(own.select("id").hint("merge"), "id", "left_semi"), k, percent, SPARE)
    hubs = written(joined.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").select("key", "hub"), "hubs")
    shared = written(joined.join(hubs, "key").select("key", "hub", "id"), "shared")
    discard(joined, hubs)
    stars = shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = written(_verified(stars, own, plain, k, percent), "links")

    # Members of a bucket that are still apart from each other, and weren't compared with the hub, meet in pairs.
    part = components(links)
    apart_ = lambda t: t.join(part.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parted = written(apart_(shared).select("key", "hub", "id", "component"), "parted")
    discard(shared)
    torn = parted.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")).where("x <> y")
    torn = written(torn.select("key", (F.col("size") > CROWD).alias("crowd")), "torn")
    open_ = written(parted.join(torn, "key").where("id <> hub").select("key", "id", "component", "crowd"), "open")
    discard(parted, torn)
    crowd = written(open_.where("crowd").select("id").distinct(), "crowd")
    meet = open_.where("not crowd").select("key", "id", "component")
    if crowd.limit(1).count():
        again = _buckets(plain.join(crowd, "id", "left_semi"), k, percent, WIDE)
        meet = meet.unionByName(apart_(again).select("key", "id", "component"))
    met = written(meet.join(own.drop("bits"), "id"), "meet")
    discard(open_)
    differ = " + ".join(f"bit_count(p.{w} ^ q.{w})" for w in _COARSE)
    fits = f"100 * least(p.n, q.n) >= {percent} * greatest(p.n, q.n) and ({differ}) * {100 + percent} <= (p.n + q.n) * {100 - percent}"
    pairs = met.alias("p").join(met.alias("q"), F.expr(f"p.key = q.key and p.component < q.component and {fits}"))
    pairs = pairs.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct()
    more = written(_verified(pairs, own, plain, k, percent), "more-links")
    discard(met, own)

    found = components(links.unionByName(more))
    discard(links, more, part)
    placed = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component_id"))
    sized = sketches.select("id", F.col("n").alias("n_shingles"), "s1", "s2")
    reached = placed.groupBy("id").agg(F.min("component_id").alias("component_id"))
    known = sized.join(reached, "id", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    nulls = _sketches(docs.where("doc_id is null").select(F.lit(None).cast("long").alias("id"), F.col("text").cast("string")), k)
    out = known.unionByName(nulls.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
    out = written(out, "near-components")
    discard(sketches, sets, found)
    return out


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir), k=3, percent=90)
