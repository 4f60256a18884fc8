"""Token ids in a content-addressed store.

``write`` cuts each document's ids where a rolling hash over the last WINDOW ids says so, stores each distinct chunk
once under its digest, and writes a recipe for each document (its chunks' digests in order, their Merkle root) in
ascending doc_id order: file after file, each a range of documents and one shard. The manifest has a row for each shard
(level 0) and, above, for each FANOUT rows of the level below, up to one row for the whole store. ``read`` checks all
recipes against the manifest, and every chunk, document root and length, before it gives a document out.

Files (Parquet, below one folder): ``chunks`` (digest, ids), ``recipes`` (shard, doc_id, at, n_tokens, root, digests; at:
ids before it in its shard), ``manifest`` (level, no, n_docs, n_tokens, start, root). Ids are little-endian, two bytes
wide if the vocabulary allows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.llm.store import discard, documents, shared_dir, small, written

WINDOW, LEAST_CHUNK, MEAN_CHUNK, MOST_CHUNK = 16, 64, 256, 2048
#: Documents of a shard, about; shards under one row of the next level.
SHARD_DOCS, FANOUT = 50_000, 1024
#: Digests that an encoding task remembers, so that it hands on a chunk once. It forgets all when it has so many.
REMEMBERED = 200_000
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], done = 1, 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_tables = [_powers(_MULTIPLIER, 1 << 14), _powers(_INVERSE, 1 << 14)]


def cuts(ids: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of texts laid end to end (``limits``: where each ends): places where the hash of the last WINDOW
    ids has its top bits zero, within the limits of a chunk's length. A chunk is longer than WINDOW unless its text ends,
    so no cut depends on the text before."""
    n = len(ids)
    while n > len(_tables[0]):
        _tables[:] = [_powers(_MULTIPLIER, 2 * len(_tables[0])), _powers(_INVERSE, 2 * len(_tables[0]))]
    up, down = (t[:n] for t in _tables)
    total = np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9) * up, dtype=np.uint64)
    rolled = total.copy()
    rolled[WINDOW:] -= total[:-WINDOW]
    rolled *= down
    rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0x94D049BB133111EB)
    marks = np.flatnonzero(rolled < np.uint64((1 << 64) // MEAN_CHUNK)) + 1
    bounds = np.searchsorted(marks, limits).tolist()
    found, out, a, begin = marks.tolist(), [], 0, 0
    for b, end in zip(bounds, limits.tolist(), strict=True):
        ends, last = [], begin
        for mark in [*found[a:b], end]:
            while mark - last > MOST_CHUNK:
                last += MOST_CHUNK
                ends.append(last)
            if mark - last >= LEAST_CHUNK or mark == end and mark > last:
                ends.append(mark)
                last = mark
        out.append(ends)
        a, begin = b, end
    return out


def digest_of(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node moves up as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [digest_of(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Each document's digests and root, and the chunks that its task hasn't handed on yet, with their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from proofmill.llm.tokens import encoder

        encode = encoder(tokenizer)
        end = np.array([end_id], encode.dtype).tobytes()
        width = encode.dtype.itemsize
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                raws = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                texts = [ids + end for ids in encode.encode(raws)]
                joined = b"".join(texts)
                limits = np.cumsum([len(t) // width for t in texts])
                rows, begin = [], 0
                for doc_id, ends, limit in zip(part.column(0).to_pylist(), cuts(np.frombuffer(joined, encode.dtype), limits), limits.tolist(), strict=True):
                    chunks = [joined[width * a : width * b] for a, b in zip([begin, *ends], ends)]
                    digests = [digest_of(c) for c in chunks]
                    fresh = {d: c for d, c in zip(digests, chunks, strict=True) if d not in seen}
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    seen.update(fresh)
                    rows.append((doc_id, limit - begin, merkle(digests), digests, [*fresh], [*fresh.values()]))
                    begin = limit
                kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.binary())] * 3]
                names = ["doc_id", "n_tokens", "root", "digests", "fresh", "chunks"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, root binary, digests array<binary>, fresh array<binary>, chunks array<binary>"
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's recipes in order, with their number and the ids before each."""
    total, n = 0, 0
    for batch in batches:
        tokens = np.cumsum(batch.column("n_tokens").to_numpy())
        at = total + tokens - batch.column("n_tokens").to_numpy()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n + np.arange(len(at)), pa.int64()), pa.array(at, pa.int64())], [*batch.schema.names, "i", "at"])
        total, n = total + int(tokens[-1]) if len(tokens) else total, n + len(at)


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = pa.array([merkle([x["root"] for x in r]) for r in batch.column("roots").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], roots], [*batch.schema.names[:-1], "root"])


def _shards(recipes: DataFrame) -> DataFrame:
    """Level 0 of the manifest, from the recipes alone. A shard's roots are one row: SHARD_DOCS of 16 bytes, about."""
    roots = F.array_sort(F.collect_list(F.struct("i", "root"))).alias("roots")
    sums = recipes.groupBy(F.col("shard").cast("long").alias("no")).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), roots)
    rooted = sums.mapInArrow(_rooted, "no long, n_docs long, n_tokens long, root binary")
    before = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return rooted.select(F.lit(0).alias("level"), "no", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("start"), "root")


def _above(level: DataFrame) -> DataFrame:
    """The next level of the manifest: a row for each FANOUT rows."""
    roots = F.array_sort(F.collect_list(F.struct(F.col("no").alias("i"), "root"))).alias("roots")
    sums = level.groupBy((F.col("level") + 1).alias("level"), F.floor(F.col("no") / FANOUT).cast("long").alias("no"))
    sums = sums.agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"), F.min("start").cast("long").alias("start"), roots)
    return sums.mapInArrow(_rooted, "level int, no long, n_docs long, n_tokens long, start long, root binary")


def _levels(shards: DataFrame) -> list[DataFrame]:
    """All levels above ``shards`` (a stored table), up to one row."""
    levels = [written(_above(shards), "manifest")]
    while levels[-1].limit(2).count() > 1:
        levels.append(written(_above(levels[-1]), "manifest"))
    return levels


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1) -> None:
    """Writes ``docs`` (doc_id, text) to the store at ``path``.

    A null or empty text is the end id alone. Documents stand in ascending doc_id order, null first; repeated rows each
    have their recipe. An empty table writes empty files. Other columns are ignored.
    """
    encoded = written(_encoded(docs, tokenizer, end_id).withColumn("row", F.monotonically_increasing_id()), "encoded", "zstd")
    fresh = encoded.select(F.explode(F.arrays_zip("fresh", "chunks")).alias("c")).select(F.col("c.fresh").alias("digest"), F.col("c.chunks").alias("ids"))
    # Tasks hand on a chunk once, so even a frequent digest has few rows here, and nothing is won by aggregating before the shuffle.
    fresh.repartition("digest").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/chunks")

    # Shards are ranges of (doc_id, root, row) of like counts; only row tells repeated rows apart.
    shards = encoded.count() // SHARD_DOCS + 1
    order = [F.col("doc_id").asc_nulls_first(), "root", "row"]
    ranged = encoded.drop("fresh", "chunks").repartitionByRange(shards, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("shard"), "doc_id", "n_tokens", "root", "digests")
    kinds = "shard int, doc_id long, n_tokens long, root binary, digests array<binary>, i long, at long"
    ranged.mapInArrow(_counted, kinds).write.parquet(f"{path}/recipes")
    discard(encoded)
    level = written(_shards(docs.sparkSession.read.parquet(f"{path}/recipes")), "shards")
    levels = [level, *_levels(level)]
    rows = levels[0]
    for more in levels[1:]:
        rows = rows.unionByName(more)
    rows.write.parquet(f"{path}/manifest")
    discard(*levels)


def verify(spark: SparkSession, path: str) -> None:
    """Raises an error unless the recipes give the manifest's rows, level by level up to its top."""
    have = spark.read.parquet(f"{path}/manifest")
    level = written(_shards(spark.read.parquet(f"{path}/recipes")), "verify")
    levels = [level, *_levels(level)]
    want = levels[0]
    for more in levels[1:]:
        want = want.unionByName(more)
    columns = ["level", "no", "n_docs", "n_tokens", "start", "root"]
    wrong = have.select(*columns).exceptAll(want.select(*columns)).unionByName(want.select(*columns).exceptAll(have.select(*columns)))
    found = wrong.select("level", "no").limit(5).collect()
    discard(*levels)
    if found:
        raise ValueError(f"the recipes differ from the manifest at (level, number) {[tuple(r) for r in found]}")


def read(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """The documents of a store: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit). Recipes that are missing
    or differ from the manifest raise an error here; a chunk that is missing or differs from its digest, or a document
    that differs from its root or length, raises one when its row is read."""
    verify(spark, path)
    base = spark.read.parquet(f"{path}/manifest").where("level = 0").select(F.col("no").cast("int").alias("shard"), "start")
    recipes = spark.read.parquet(f"{path}/recipes").join(small(base), "shard").withColumn("start", F.col("start") + F.col("at"))
    wanted = recipes.select("start", F.struct("doc_id", "n_tokens", "root").alias("head"), F.posexplode("digests").alias("pos", "digest"))
    wanted = wanted.withColumn("head", F.when(F.col("pos") == 0, F.col("head")))  # once a document
    parts = wanted.join(spark.read.parquet(f"{path}/chunks"), "digest", "left").select("start", "pos", "ids", "head.*")
    dealt = parts.repartition("start").sortWithinPartitions("start", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from proofmill.llm.tokens import encoder

        dtype = encoder(tokenizer).dtype

        def whole(start: int, doc_id: int | None, n: int, root: bytes, chunks: list) -> tuple:
            if any(c is None for c in chunks) or merkle([digest_of(c) for c in chunks]) != root:
                raise ValueError(f"the document at {start} differs from its root")
            ids = np.frombuffer(b"".join(chunks), dtype).astype("<u4")
            if len(ids) != n:
                raise ValueError(f"the document at {start} has {len(ids)} ids, not {n}")
            return doc_id, start, n, ids.tobytes()

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 3 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids"])

        head, chunks, rows, size = None, [], [], 0
        for batch in batches:
            for start, _, ids, doc_id, n, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if head is None or head[0] != start:
                    if head:
                        rows.append(whole(*head, chunks))
                        size += head[2]
                    head, chunks = (start, doc_id, n, root), []
                    if size > 500_000:
                        yield table(rows)
                        rows, size = [], 0
                chunks.append(ids)
        if head:
            rows.append(whole(*head, chunks))
            yield table(rows)

    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op6_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), tokenizer, path)
    return read(spark, path, tokenizer).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
