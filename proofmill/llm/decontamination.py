"""Passages of benchmark items in documents, by a prefix-filtered join.

A window is a run of item words, as long as asked or the whole of a shorter item. Its tokens are shingles, shorter runs of
words, ordered by rarity in the documents. A document that holds a window holds all its shingles, so one, the rarest, is
the prefix that must be joined. Documents are read once: shingles that may be an item's (a bitmap of bounded size tells)
are kept with the words around them, in segments of bounded length, and counted, which gives the rarities. The prefixes
join these places; the shingle's offset in the window says where the window would start, which must lie in the document
with room for its length, and the words that stand there are compared with the window's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.llm.store import discard, documents, small, written
from proofmill.llm.words import blocks, folding, raw_texts, window_hashes, word_hashes
from proofmill.operators.marks import bitmap, marked

LENGTH, SHINGLE = 10, 5
#: Shingles of a document that start in the same so many words are one segment.
SEGMENT = 64
#: Windows are broadcast if their words and numbers take no more bytes together.
BROADCAST_BYTES = 8_000_000
_FOLD = folding(digits=True)
_WINDOWS = "item string, words string, n int, hashes array<long>"
_READ = "doc_id long, row long, n_words long, segments array<struct<start:int,words:string,at:array<int>,h:array<long>>>"


def _windows(items: DataFrame, length: int, shingle: int) -> DataFrame:
    """item, words, n and hashes (of the shingles, in order) of the distinct windows of each text of ``items`` (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column("item").to_pylist(), raw_texts(batch.column("text")), strict=True):
                raw = raw.translate(_FOLD)
                words = raw.split()
                if not words:
                    continue
                n, part = min(length, len(words)), min(shingle, length, len(words))
                hashes, _ = window_hashes(*word_hashes([raw]), part)
                starts = {b" ".join(words[i : i + n]): i for i in range(len(words) - n + 1)}
                held = [hashes[i : i + n - part + 1].view(np.int64) for i in starts.values()]
                for s in range(0, len(starts), 10_000):
                    texts = [*starts][s : s + 10_000]
                    columns = [pa.array([item] * len(texts), pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array([n] * len(texts), pa.int32()), pa.array(held[s : s + 10_000], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["item", "words", "n", "hashes"])

    return items.mapInArrow(run, _WINDOWS)


def _read(docs: DataFrame, length: int, parts: list[int], bits: np.ndarray) -> DataFrame:
    """Rows of ``docs`` (doc_id, row, text) with n_words and segments: start, words, and at and h of the marked shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.string()), ("at", pa.list_(pa.int32())), ("h", pa.list_(pa.int64()))]))
        for batch in batches:
            texts = [raw.translate(_FOLD) for raw in raw_texts(batch.column("text"))]
            for a, b in blocks(texts):
                hashes, doc = word_hashes(texts[a:b])
                n = np.bincount(doc, minlength=b - a)
                first = np.cumsum(n) - n
                found = []
                for part in parts:
                    h, inside = window_hashes(hashes, doc, part)
                    at = np.flatnonzero(inside)
                    at = at[marked(bits, h[at])]
                    found.append((at, h[at].view(np.int64)))
                at = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
                h = np.concatenate([f[1] for f in found]) if found else at
                of = doc[at]
                place = at - first[of]
                order = np.lexsort((place, of))
                of, place, h = of[order], place[order], h[order]
                segments: list[list] = [[] for _ in range(b - a)]
                cuts = np.flatnonzero(np.diff(of * (1 << 40) + place // SEGMENT, prepend=-1)).tolist()
                split: tuple[int, list] = (-1, [])
                for s, e in zip(cuts, [*cuts, len(of)][1:], strict=True):
                    d, start = int(of[s]), max(0, int(place[s]) // SEGMENT * SEGMENT - length + 1)
                    if split[0] != d:
                        split = (d, texts[a + d].split())
                    words = b" ".join(split[1][start : int(place[e - 1]) + length])
                    segments[d].append({"start": start, "words": words.decode("utf-8"), "at": place[s:e].astype(np.int32), "h": h[s:e]})
                ids = [batch.column(c).slice(a, b - a) for c in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(n, pa.int64()), pa.array(segments, kind)], ["doc_id", "row", "n_words", "segments"])

    return docs.mapInArrow(run, _READ)


def contaminated(docs: DataFrame, items: DataFrame, length: int = LENGTH, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items, of each row of ``docs`` (doc_id, text), by the texts of ``items`` (item_id, text).

    Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. A window is ``length`` consecutive
    words of an item, or all of them if it has fewer; a document word inside any occurrence of a window is hit. ``spans``:
    the hit words as ranges (start, end: from 0, end excluded), in order and apart; ``items``: the ids, as strings in
    their order, of the items with a window in the document. Null and empty texts have no words; an item without words
    has no window; a null item_id is the empty string. Items that share an id are one item with the windows of all.
    Documents that share an id, or are repeated, are documents of their own. Without items nothing is hit; an empty table
    gives no rows. Other columns are ignored.
    """
    text = F.col("text").cast("string").alias("text")
    of_items = written(_windows(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text), length, shingle), "item-windows")
    windows = of_items.groupBy("words", "n").agg(F.first("hashes").alias("hashes")).withColumn("window", F.monotonically_increasing_id())
    windows = written(windows, "windows")
    shingles = windows.select(F.explode("hashes").alias("h"), (F.col("n") - F.size("hashes") + 1).alias("part"))
    parts = sorted(r.part for r in shingles.select("part").distinct().collect())  # no more than a shingle has words
    bits = bitmap(shingles.select("h").distinct(), "h")
    row = F.monotonically_increasing_id().alias("row")
    read = written(_read(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row, text), length, parts, bits), "segments", "zstd")

    segments = read.select("row", "n_words", F.explode("segments").alias("s"))
    places = segments.select("row", "n_words", F.col("s.start").alias("from"), F.explode(F.arrays_zip("s.at", "s.h")).alias("x")).select("row", "n_words", "from", "x.at", "x.h")
    rarity = written(places.groupBy("h").agg(F.count("*").alias("times")), "rarity")
    tokens = windows.select("window", "n", F.posexplode("hashes").alias("offset", "h")).join(rarity, "h", "left")
    rarest = tokens.groupBy("window", "n").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "h", "offset")).alias("p"))
    prefix = written(rarest.where("p.times > 0").select("window", "n", "p.h", "p.offset"), "prefixes")

    met = places.join(small(prefix), "h").withColumn("start", F.col("at") - F.col("offset"))
    bounded = met.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
    candidates = written(bounded.select("row", "from", "start", "n", "window"), "candidates")
    found = candidates.join(segments.select("row", F.col("s.start").alias("from"), F.split("s.words", " ").alias("around")), ["row", "from"])
    there = F.array_join(F.slice("around", F.col("start") - F.col("from") + 1, F.col("n")), " ").alias("there")
    spelled = windows.select("window", "words")
    size = spelled.agg(F.coalesce(F.sum(F.octet_length("words") + F.lit(50)), F.lit(0))).first()[0]
    spelled = F.broadcast(spelled) if size <= BROADCAST_BYTES else spelled
    hits = found.select("row", "start", "n", "window", there).join(spelled, "window").where(F.col("there") == F.col("words"))
    hits = written(hits.select("row", "start", "n", "window"), "hits")
    named = written(of_items.join(windows.select("words", "window"), "words").select("window", "item").distinct(), "named")
    discard(of_items, windows, rarity, prefix, candidates)

    # A window that starts behind the end of all before it begins a span.
    ordered = Window.partitionBy("row").orderBy("start", "end")
    ranges = hits.select("row", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    begun = ranges.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    merged = begun.groupBy("row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    names = hits.select("row", "window").distinct().join(small(named), "window").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = read.select("doc_id", "row", "n_words").join(spans, "row", "left").join(names, "row", "left")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    out = both.select("doc_id", "n_words", none("spans", "array<struct<start:int,end:int>>"), none("items", "array<string>"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"])).alias("n_hit")
    out = written(out.select("doc_id", "n_words", n_hit, "spans", "items"), "contaminated")
    discard(read, hits, named)
    return out


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


OP13_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, ws, least(10, len(ws)) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
  ) WHERE len(ws) > 0
), win AS (SELECT DISTINCT item, n, array_to_string(ws[i : i + n - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM item)),
place AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win))
), hit AS (SELECT doc_id, p.n, i, item FROM place p JOIN win USING (n, w)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
