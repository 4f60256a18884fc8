"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Index: each distinct vector is divided by its norm, filled up with zeros to the code's length and turned by one random
rotation; the signs of the coordinates, packed, are its code, with two scalars: the norm, and the inner product f of the
turned unit vector with its code's vector. The rotation doesn't depend on the data, so nothing is fitted and every row
is indexed. Search: a query's turned coordinates are rounded to PLANES bits; the bits that a code has in common with
each plane, counted, give its inner product with the query, and this the estimate norm * <code, turned query> / f, with
a standard error of norm * |query| * sqrt((1 - f^2) / f^2 / (bits - 1)). BOUND standard errors around it bound it from
below and above. A vector is chosen for reranking if its upper bound reaches the k-th greatest lower bound; only for the
chosen ones vectors are fetched and scored exactly.

Codes and queries meet in blocks: a task holds one block of codes and one of queries, never a vector that isn't a
query's. Rows of equal vectors are searched once (one stands for them) and come back with the result, so a group of
copies makes no pairs among itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.llm.store import discard, written

#: Rows, and queries, in a block.
BLOCK = 8192
#: Standard errors by which a bound lies above or below an estimate.
BOUND = 1.25
#: Bits of a query's rounded coordinates.
PLANES = 4
#: Bits of a code at least; one for each dimension beyond that.
LEAST_BITS = 512
#: Bytes of query vectors that are broadcast at most; beyond that the join is shuffled.
BROADCAST_BYTES = 16_000_000


def bits_of(d: int) -> int:
    return max(LEAST_BITS, -(-d // 64) * 64)


_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(d: int, seed: int = 5) -> np.ndarray:
    """The first d rows of a random rotation in ``bits_of(d)`` dimensions."""
    if (d, seed) not in _rotations:
        bits = bits_of(d)
        _rotations[d, seed] = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0][:d]
    return _rotations[d, seed]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (as it came) of the rows that take part: no null, zero or non-finite vector; of several dimensions
    the one that most rows have."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(fine).select(F.col("vec_id").cast("long"), v.alias("vector"))
    sizes = kept.groupBy(F.size("vector").alias("d")).count().agg(F.max_by("d", F.struct("count", -F.col("d"))).alias("d")).first()
    return kept.where(F.size("vector") == (sizes.d or 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def index(rows: DataFrame) -> DataFrame:
    """rep, code, norm, f of vectors (rep, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vector"))
                norm = np.sqrt((x * x).sum(axis=1))
                turned = (x / norm[:, None]) @ rotation(x.shape[1])
                codes = np.packbits(turned > 0, axis=1, bitorder="little")
                f = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(f)], ["rep", "code", "norm", "f"])

    return rows.select("rep", "vector").mapInArrow(run, "rep long, code binary, norm double, f double")


def search(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """A row for each query: asked; reps and highs (upper bounds) of what may be among its k best, as far as one block of
    codes tells; lows: the k greatest lower bounds."""
    codes = np.frombuffer(b"".join(rows["code"]), np.uint64).reshape(len(rows), -1).T.copy()  # a row for each word of the codes
    reps, norm, f = (rows[c].to_numpy() for c in ("rep", "norm", "f"))
    bits = 64 * len(codes)
    ones = np.bitwise_count(codes).sum(axis=0, dtype=np.int32)
    scale = norm / f / np.sqrt(bits)
    error = norm * BOUND * np.sqrt((1 - f * f).clip(0) / (f * f) / (bits - 1))
    q = np.stack(queries["vector"].to_numpy()).astype(np.float64)
    turned = q @ rotation(q.shape[1])
    weights = (1 << np.arange(PLANES)).astype(np.float64)
    least, step = turned.min(axis=1), np.maximum(np.ptp(turned, axis=1), 1e-300) / ((1 << PLANES) - 1)
    levels = np.rint((turned - least[:, None]) / step[:, None]).astype(np.uint8)
    planes = np.packbits((levels[:, None, :] >> np.arange(PLANES, dtype=np.uint8)[None, :, None]) & 1, axis=2, bitorder="little").view(np.uint64)
    out: list[tuple] = []
    for i, asked in enumerate(queries["rep"].tolist()):
        both = np.zeros(len(reps))
        for weight, plane in zip(weights, planes[i], strict=True):
            both += weight * np.bitwise_count(codes & plane[:, None]).sum(axis=0, dtype=np.uint16)
        of_code = 2 * (least[i] * ones + step[i] * both) - (least[i] * bits + step[i] * float(levels[i].sum()))
        estimate = of_code * scale
        slack = error * np.sqrt((q[i] * q[i]).sum())
        low, high = estimate - slack, estimate + slack
        best = np.partition(low, len(low) - k)[len(low) - k :] if len(low) > k else low
        near = np.flatnonzero(high >= best.min())
        out.append((asked, reps[near], high[near], best))
    return pd.DataFrame(out, columns=["asked", "reps", "highs", "lows"])


def _candidates(codes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """asked, rep of the pairs that are reranked."""
    c, q = (max(1, -(-t.count() // BLOCK)) for t in (codes, asked))
    block = lambda m, seed: F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = codes.withColumn("c", block(c, 1)).withColumn("q", all_of(q))
    right = asked.withColumn("q", block(q, 2)).withColumn("c", all_of(c))

    def run(part: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(queries):
            return pd.DataFrame({"asked": [], "reps": [], "highs": [], "lows": []})
        return search(part, queries, k)

    kinds = "asked long, reps array<long>, highs array<double>, lows array<double>"
    found = written(left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(run, kinds), "bounds")
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.col("low").desc()))
    marks = found.select("asked", F.explode("lows").alias("low")).withColumn("place", place).where(F.col("place") <= k)
    marks = marks.groupBy("asked").agg(F.min("low").alias("low"), F.count("*").alias("n"))
    mark = marks.select("asked", F.when(F.col("n") < k, F.lit(float("-inf"))).otherwise(F.col("low")).alias("mark"))
    near = F.filter(F.arrays_zip("reps", "highs"), lambda x: x["highs"] >= F.col("mark"))
    return found.join(mark, "asked").select("asked", F.explode(F.transform(near, lambda x: x["reps"])).alias("rep"))


def _scored(pairs: DataFrame, distinct: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, rep, score: exact inner products in doubles."""
    width = asked.select(F.size("vector")).first()
    queries = asked.select(F.col("rep").alias("asked"), F.col("vector").alias("query"))
    if width and asked.count() * width[0] * 8 <= BROADCAST_BYTES:
        queries = F.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = (_matrix(batch.column("query")) * _matrix(batch.column("vector"))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("asked"), batch.column("rep"), pa.array(score)], ["asked", "rep", "score"])

    both = pairs.join(distinct, "rep").join(queries, "asked").select("asked", "rep", "query", "vector")
    return both.mapInArrow(run, "asked long, rep long, score double")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest rows of each query: query_id, rank, vec_id, score (inner product in doubles, ties to smaller vec_id).

    ``vectors`` has vec_id and embedding; queries are the rows whose vec_id is divisible by ``every``, candidates all
    rows but those with the query's id. Null ids and vectors that are null, zero, or hold null or non-finite components
    take no part. Repeated rows of a query are one query; repeated candidates are one each for every different vector;
    of an id with several vectors the one that sorts first asks. An empty table gives no rows. Other columns are ignored.
    """
    rows = usable(vectors)
    distinct = written(rows.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id()), "distinct")
    # rep, vec_id of all rows; those of a vector that stands once need no join on it.
    many = distinct.where("n > 1").select("vector", "rep")
    members = distinct.where("n = 1").select("rep", F.col("first").alias("vec_id"))
    members = written(members.unionByName(rows.join(many, "vector").groupBy("rep", "vec_id").count().drop("count")), "members")
    query_of = written(members.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("rep").alias("asked")), "queries")
    asked = written(distinct.join(query_of.select(F.col("asked").alias("rep")).distinct(), "rep").select("rep", "vector"), "asked")
    codes = written(index(distinct), "codes")

    # The k + 1 best vectors of a query hold its k best rows, whichever row is its own.
    pairs = written(_candidates(codes, asked, k + 1), "pairs")
    scores = written(_scored(pairs, distinct.select("rep", "vector"), asked), "scores")
    # Of a vector's rows those with the least ids are enough.
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))
    few = members.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")
    first = F.row_number().over(Window.partitionBy("asked").orderBy(F.col("score").desc(), "first"))
    top = scores.join(distinct.select("rep", "first"), "rep").withColumn("place", first).where(F.col("place") <= k + 1).select("asked", "rep", "score")
    best = F.row_number().over(Window.partitionBy("asked").orderBy(F.col("score").desc(), "vec_id"))
    near = written(top.join(few, "rep").withColumn("place", best).where(F.col("place") <= 2 * (k + 1)).drop("place"), "near")
    discard(pairs, codes, asked)
    found = query_of.join(near, "asked").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
