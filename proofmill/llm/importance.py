"""Importance resampling towards a target: documents are drawn by how much their n-grams speak for the target corpus.

Distinct words of both corpora are numbered in an integer dictionary. Documents are encoded in blocks of bounded size, so
that a block's words join the dictionary once a block and not once an occurrence. n-grams are tuples of word numbers; each
distinct tuple's words are put together and hashed once into a bucket, the corpora's counts of the buckets give each
bucket's gain, and the gains join the blocks' tuples back and are summed for each document. Scores add noise that depends
on the document's id alone (the greatest scores are a weighted draw without replacement), and places in their order are
told by ranges, so that no task sees them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm.store import discard, documents, written
from proofmill.llm.words import folding, raw_texts, runs_of
from proofmill.operators.ranks import ranked

MAX_N, BUCKETS, PERCENT, MIN_WORDS, SEED = 1, 10_000, 10, 20, 2024
#: Bytes of text that are encoded together; a longer text is a block of its own.
BLOCK = 4_000_000
_FOLD = folding(digits=True)
_BLOCK = "docs array<struct<doc_id:long,row:long,n:int>>, codes binary, words array<struct<word:binary,n:long>>"
_SUMS = "doc_id long, row long, n_words long, n_features long, gains long"


def _encoded(docs: DataFrame) -> DataFrame:
    """Blocks of ``docs`` (doc_id, row, text): their rows, distinct words with their numbers, and all words as places among these."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        texts = [raw.translate(_FOLD).split() for _, _, raw in rows]
        coded = pa.array([w for words in texts for w in words], pa.binary()).dictionary_encode()
        docs = [{"doc_id": i, "row": r, "n": len(words)} for (i, r, _), words in zip(rows, texts, strict=True)]
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int32())]))
        codes, size = coded.indices.to_numpy(), len(coded.dictionary)
        counted = pa.StructArray.from_arrays([coded.dictionary, pa.array(np.bincount(codes, minlength=size), pa.int64())], ["word", "n"])
        words = pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), counted)
        packed = codes.astype("<u2" if size <= 1 << 16 else "<u4").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([docs], kind), pa.array([packed], pa.binary()), words], ["docs", "codes", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), raw_texts(batch.column("text")), strict=True):
                if rows and size + len(row[2]) > BLOCK:
                    yield block(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
        if rows:
            yield block(rows)

    return docs.mapInArrow(run, _BLOCK)


def _grams(batch: pa.RecordBatch, i: int, max_n: int) -> tuple[list[dict], list[np.ndarray], np.ndarray, np.ndarray]:
    """Of a block: its rows, the distinct tuples of each length as places among the block's words, and for each
    occurrence the number of its tuple (shorter lengths first) and of its document. The same whenever it is called."""
    docs, raw, words = (batch.column(c)[i].as_py() for c in ("docs", "codes", "size"))
    codes = np.frombuffer(raw, "<u2" if words <= 1 << 16 else "<u4").astype(np.int64)
    doc = np.repeat(np.arange(len(docs)), [d["n"] for d in docs])
    tuples, at, of = [np.arange(words)[:, None]], [codes], [doc]
    known, first = codes, words
    for n in range(2, max_n + 1):
        start = runs_of(doc, n)
        distinct, number = np.unique(known[start] * max(words, 1) + codes[start + n - 1], return_inverse=True)
        known = np.full(len(codes), -1, np.int64)
        known[start] = number
        tuples.append(np.column_stack([tuples[-1][distinct // max(words, 1)], distinct % max(words, 1)]))
        at.append(first + number)
        of.append(doc[start])
        first += len(distinct)
    return docs, tuples, np.concatenate(at), np.concatenate(of)


def _longer(blocks: DataFrame, max_n: int) -> DataFrame:
    """block, target, place, n and the word numbers of each distinct tuple of two words or more of a block, whose words'
    numbers are ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, tuples, at, _ = _grams(batch, i, max_n)
                single, total = len(tuples[0]), sum(map(len, tuples))
                if total == single:
                    continue
                ids = batch.column("ids")[i].values.to_numpy()
                ends = np.cumsum(np.concatenate([[0], *(np.full(len(t), t.shape[1]) for t in tuples[1:])]))
                words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([ids[t].ravel() for t in tuples[1:]])))
                block, target = (pa.repeat(batch.column(c)[i], total - single) for c in ("block", "target"))
                n = np.bincount(at, minlength=total)[single:]
                yield pa.RecordBatch.from_arrays([block, target, pa.array(np.arange(single, total), pa.int32()), pa.array(n, pa.int64()), words], ["block", "target", "place", "n", "tuple"])

    return blocks.mapInArrow(run, "block long, target boolean, place int, n long, tuple array<long>")


def _summed(blocks: DataFrame, max_n: int) -> DataFrame:
    """Sums of gains of each document of ``blocks``, whose ``gains`` are those of their tuples by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, _, at, of = _grams(batch, i, max_n)
                sums = np.zeros(len(docs), np.int64)
                if len(at):
                    np.add.at(sums, of, batch.column("gains")[i].values.to_numpy()[at])
                features = np.bincount(of, minlength=len(docs))
                columns = [pa.array([d[c] for d in docs], pa.int64()) for c in ("doc_id", "row", "n")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(features, pa.int64()), pa.array(sums)], [c.split()[0] for c in _SUMS.split(", ")])

    return blocks.mapInArrow(run, _SUMS)


def _by_place(rows: DataFrame, place: str, value: str, name: str) -> DataFrame:
    """The values of each block in the order of their places; as many as a block of bounded size has words."""
    return rows.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda x: x[value]).alias(name))


def _gains_by_place(rows: DataFrame) -> DataFrame:
    """The same of gains, which share a number with their places: a third of the bytes that are shuffled."""
    one = F.shiftleft(F.col("place").cast("long"), 32) + F.col("gain") + (1 << 31)
    return rows.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x.bitwiseAND((1 << 32) - 1) - (1 << 31)).alias("gains"))


def _gains(docs: DataFrame, target: DataFrame, max_n: int, buckets: int) -> DataFrame:
    """Sums of gains of ``docs`` (doc_id, row, text); stored."""
    side = lambda d, t: _encoded(d).withColumn("target", F.lit(t))
    raw = side(docs, False).unionByName(side(target, True)).withColumn("block", F.monotonically_increasing_id())
    raw = written(raw.withColumn("size", F.size("words")), "blocks", "zstd")
    words = raw.select("block", "target", F.posexplode("words").alias("place", "w")).select("block", "target", "place", "w.word", "w.n")
    dictionary = written(raw.select(F.explode("words.word").alias("word")).distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary", "zstd")
    numbered = written(words.join(dictionary, "word").select("block", "target", "place", "n", "id"), "numbered-words", "zstd")
    tuples = numbered.select("block", "target", "place", "n", F.array("id").alias("tuple"))
    blocks = raw.select("block", "target", "docs", "codes", "size")
    stored = [numbered]
    if max_n > 1:
        stored.append(written(_longer(blocks.join(_by_place(numbered, "place", "id", "ids"), "block"), max_n), "longer", "zstd"))
        tuples = tuples.unionByName(stored[-1])

    of = lambda t: F.sum(F.when(F.col("target") == t, F.col("n")).otherwise(0))
    distinct = tuples.groupBy("tuple").agg(of(False).alias("s"), of(True).alias("t"))
    distinct = written(distinct.withColumn("gram", F.monotonically_increasing_id()), "tuples", "zstd")
    parts = distinct.select("gram", F.posexplode("tuple").alias("i", "id")).join(dictionary, "id")
    spelled = parts.groupBy("gram").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"].cast("string")), " ").alias("bytes"))
    hashed = distinct.join(spelled.select("gram", F.pmod(F.crc32(F.col("bytes").cast("binary")), F.lit(buckets)).cast("int").alias("bucket")), "gram").drop("gram")
    hashed = written(hashed, "hashed", "zstd")
    discard(dictionary, distinct)

    sums = written(hashed.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    total = sums.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    smooth = lambda c, n: F.lit(float(n + buckets)) * (F.col(c).cast("double") + 1)
    gain = sums.select("bucket", F.floor(1000 * F.ln(smooth("t", total.s) / smooth("s", total.t))).cast("long").alias("gain"))
    gain = hashed.join(F.broadcast(gain), "bucket").select("tuple", "gain")  # as many rows as there are buckets
    back = tuples.where("not target").select("block", "place", "tuple").join(gain, "tuple")
    back = written(_gains_by_place(back), "gains-of-blocks", "zstd")
    discard(*stored, hashed)
    found = written(_summed(blocks.where("not target").join(back, "block", "left"), max_n), "gains")
    discard(raw, sums, back)
    return found


def weigh(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each row of ``docs`` (doc_id, text), by the texts of ``target``; stored.

    Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case; features all runs of 1 to ``max_n``
    words of a text. The weight is the floored mean of the gains of a document's features, 0 without any; the score adds
    Gumbel noise made of ``seed`` and the id. Of the documents with ``min_words`` words or more ``percent`` in a hundred
    are drawn, the greatest scores first and of equal ones the least id, null first; the others have no rank. A null or
    empty text has no words, a null id is the empty text to the noise; rows that share an id, or are repeated, are
    documents of their own that share the noise. Without a target all counts of it are 0. Empty tables give no rows; other
    columns are ignored.
    """
    return _weighed(docs, target, F.monotonically_increasing_id(), max_n, buckets, percent, min_words, seed).drop("row")


def _weighed(docs: DataFrame, target: DataFrame, row: Column, max_n: int = MAX_N, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Of ``weigh``, with ``row``, a number that each document keeps."""
    text = F.col("text").cast("string").alias("text")
    empty = F.lit(None).cast("long")
    sums = _gains(docs.select(F.col("doc_id").cast("long"), row.alias("row"), text), target.select(empty.alias("doc_id"), empty.alias("row"), text), max_n, buckets)
    mean = F.when(F.col("n_features") > 0, F.expr("(gains - pmod(gains, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.ln(-F.ln((noise + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = sums.select("doc_id", "row", "n_words", "n_features", mean.alias("weight"), (mean + gumbel).alias("score"))
    long_ = scored.where(F.col("n_words") >= min_words)
    drawn = long_.count() * percent // 100
    placed = ranked(scored, F.col("n_words") < min_words, -F.col("score"), F.col("doc_id"), name="rank")
    discard(sums)
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    return placed.select("doc_id", "row", "n_words", "n_features", "weight", "score", rank)


def resample(docs: DataFrame, target: DataFrame, **settings: int) -> DataFrame:
    """The rows of ``docs`` that ``weigh`` draws, with all their columns and their ``rank`` (a column of that name gives way)."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    rows = written(docs.select(own, F.col("doc_id"), F.col("text")).withColumn("row", F.monotonically_increasing_id()), "documents")
    drawn = _weighed(rows.select("doc_id", "text", "row"), target, F.col("row"), **settings).where("rank is not null").select("row", "rank")
    return rows.join(drawn, "row").select(*[F.col(f"own.`{c}`") for c in docs.columns if c != "rank"], "rank")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weigh(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("n_words")


OP11_SQL = r"""
WITH crc AS (
  SELECT list(t ORDER BY b) AS tab FROM (
    SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t
    FROM (SELECT unnest(range(0, 256)) AS b))
), doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), item AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM doc) GROUP BY 1, 2),
tw AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM item) GROUP BY 1),
spelled AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM tw)),
bytes AS (SELECT w, list_transform(range(0, CAST(length(x) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS bs FROM spelled),
bucket AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, bs), lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS b FROM bytes, crc
), s AS (SELECT b, sum(n) AS s FROM dw JOIN bucket USING (w) GROUP BY 1),
t AS (SELECT b, sum(n) AS t FROM tw JOIN bucket USING (w) GROUP BY 1),
total AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS S, coalesce((SELECT sum(t) FROM t), 0) AS T),
gain AS (
  SELECT b, CAST(floor(1000 * ln((CAST(coalesce(t.t, 0) AS DOUBLE) + 1) * CAST(total.S + 10000 AS DOUBLE) / ((CAST(coalesce(s.s, 0) AS DOUBLE) + 1) * CAST(total.T + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (b), total
), sums AS (SELECT doc_id, sum(n) AS n, sum(n * gain) AS g FROM dw JOIN bucket USING (w) JOIN gain USING (b) GROUP BY 1),
scored AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features,
    CAST(CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM doc LEFT JOIN sums USING (doc_id)
), noisy AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM noisy WHERE n_features >= 20
  QUALIFY rank <= (SELECT count(*) * 10 // 100 FROM noisy WHERE n_features >= 20)
)
SELECT doc_id, n_features, weight, score, rank FROM noisy LEFT JOIN drawn USING (doc_id)
"""
