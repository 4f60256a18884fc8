"""Bounded samples of labelled texts, to fit models on."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters of all texts of a sample together, at most.
SAMPLE_CHARS = 40_000_000
#: Texts of each y that fit at least.
LONGEST = 8


def labelled(docs: DataFrame, labels: DataFrame, value: Column, rows: dict[int, int], chars: int = SAMPLE_CHARS, seed: int = 3) -> DataFrame:
    """doc_id, text, y of at most ``rows[y]`` labelled documents for each y, chosen by a hash of the id; of each y as many of
    them, in that order, as have ``chars`` characters over the number of y's together. A text of more than a LONGEST-th of
    those is left out, so that it doesn't take the place of the others. A y that has labelled texts and none in the sample
    gives a warning.

    ``value`` gives y from a label's columns (null: left out). Of an id with several labels the largest y counts; of an
    id with several rows in ``docs`` all rows are candidates. Null texts are left out. Scoring takes whole texts of all rows.
    """
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(value).alias("y")).where("y is not null")
    chosen = None
    for y, n in rows.items():
        part = known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    found = texts.join(F.broadcast(chosen), "doc_id")  # bounded by the sum of ``rows``
    hash_, most = F.xxhash64(F.lit(seed), "doc_id"), chars // max(len(rows), 1)
    sized = found.select("doc_id", "y", F.xxhash64("text").alias("txt"), F.length("text").cast("long").alias("n"))
    lengths = {r.y: (r.n, r.fit) for r in sized.groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("n") * LONGEST <= most).alias("fit")).collect()}  # a row a y
    for y in (y for y, (_, fit) in lengths.items() if not fit):
        warnings.warn(f"all {lengths[y][0]} labelled texts of {y} are too long for the sample", stacklevel=2)
    upto = Window.partitionBy("y").orderBy(hash_, "doc_id", "txt").rowsBetween(Window.unboundedPreceding, 0)
    fit = sized.where(F.col("n") * LONGEST <= most).withColumn("sum", F.sum("n").over(upto)).where(F.col("sum") <= most).select("doc_id", "txt").distinct()
    return found.withColumn("txt", F.xxhash64("text")).join(F.broadcast(fit), ["doc_id", "txt"], "left_semi").drop("txt")
