"""Places in an order over all rows, and exact percentiles, by ranges: no task sees the whole table or a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.sources.stored import discard, written


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with 1, 2, 3, ... by ascending ``order`` (values, null first); a stored table.

    Rows are numbered and dealt to ranges of the order; the number comes last in it, so that a range never has to hold
    all rows that tie (they follow one another in the order in which they were read). The ranges are counted, and a row's
    place is its place in its range after the rows of earlier ranges. Only the counts, a row a range, pass one task.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own")
    keys = [c.alias(f"key{i}") for i, c in enumerate(order)]
    rows = written(df.select(own, *keys).withColumn("row", F.monotonically_increasing_id()), "numbered")
    by = [*(f"key{i}" for i in range(len(order))), "row"]
    dealt = written(rows.repartitionByRange(*by).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*by))
    out = dealt.withColumn("place", place).join(F.broadcast(counts), "range")  # as many rows as there are shuffle partitions
    out = written(out.select("own.*", (F.col("earlier") + F.col("place")).cast("long").alias(name)), "ranked")
    discard(rows, dealt)
    return out


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles of ``value`` (null: left out) for each ``by``, between the two nearest values in proportion; by
    and a column for each of ``shares``. Ranks are taken over all rows in the order of by and value, so a group may be as
    large as the table."""
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    rows = ranked(known, *map(F.col, by), F.col("v"), name="at")
    group = written(rows.groupBy(*by).agg(F.min("at").alias("first"), F.count("*").alias("n")), "groups")
    wanted = group.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("share"), (F.lit(float(q)) * (F.col("n") - 1)).alias("x")) for c, q in shares.items()])).alias("w"), "first")
    wanted = wanted.select(*by, "w.share", (F.col("w.x") - F.floor("w.x")).alias("part"), F.explode(F.array_distinct(F.array(F.floor("w.x"), F.ceil("w.x")))).alias("i"), "first")
    wanted = wanted.select(*by, "share", "part", (F.col("first") + F.col("i")).alias("at"))
    found = wanted.join(rows.select("at", "v"), "at").groupBy(*by, "share").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.first("part").alias("part"))
    told = F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
    out = found.groupBy(*by).agg(*[F.max(F.when(F.col("share") == c, told)).alias(c) for c in shares])
    out = written(out, "percentiles")
    discard(rows, group)
    return out
