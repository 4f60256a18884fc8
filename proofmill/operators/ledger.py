"""The search ledger (JN-1, JN-2, AGG-1 to AGG-5, AGG-14, AGG-19, AGG-21, AGG-22, SNK-5, SRC-6, SRC-7, SRC-9, SRT-9, STR-24, WIN-6 to WIN-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.operators.ranks import percentiles, ranked


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def latest_within(requests: DataFrame, searches: DataFrame, key: list[str], now: str, at: str, ttl: Column) -> DataFrame:
    """Each request with its newest search, if that is no older than its time to live (JN-1). The newest row is chosen
    first, so an expired one hides an older one that would still be good; rows dated after ``now`` count."""
    rest = [c for c in searches.columns if c not in key]
    newest = searches.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("s"))
    found = requests.join(newest, key, "left")
    age = _micros(F.col(now)) - _micros(F.col(f"s.{at}"))
    hit = F.col("s").isNotNull() & (age <= ttl * 1_000_000)
    return found.select(*requests.columns, *[F.when(hit, F.col(f"s.{c}")).alias(c) for c in rest], F.coalesce(hit, F.lit(False)).alias("hit"))


def spend(uses: DataFrame, *by: str) -> DataFrame:
    return uses.groupBy(*by).agg(F.sum("credits").cast("long").alias("credits"), F.count("*").alias("n"))


def hit_rate(uses: DataFrame) -> DataFrame:
    return uses.agg(F.coalesce(F.avg(F.col("cached").cast("double")), F.lit(0.0)).alias("hit_rate"))


def latency(uses: DataFrame, *by: str, digits: int = 3) -> DataFrame:
    """Exact p50 and p95 of the uncached, inclusive, by ranks over all rows: a group may be as large as the table. 0 for a
    group without latencies."""
    fresh = uses.where("not cached").select(*by, "latency")
    found = percentiles(fresh, [*by], "latency", {"p50": 0.5, "p95": 0.95})
    if by:
        found = fresh.select(*by).distinct().alias("g").join(found.alias("f"), F.expr(" and ".join(f"g.{c} <=> f.{c}" for c in by)), "left").select(*[F.col(f"g.{c}") for c in by], "p50", "p95")
    return found.select(*by, *[F.round(F.coalesce(p, F.lit(0.0)), digits).alias(p) for p in ("p50", "p95")])


def insert_ignore(held: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """What an insert adds: keys that aren't held yet, the first row of each."""
    first = new.groupBy(*key).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("r")).select("r.*")
    return first.join(held.select(*key), key, "left_anti")


def within_budget(calls: DataFrame, by: str, order: list[str], credits: str, cap: float) -> DataFrame:
    total = F.sum(credits).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return calls.withColumn("spent", total).where(F.col("spent") <= cap)


def sequence_ids(events: DataFrame, by: str, order: list[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return events.withColumn("id", F.format_string("%s-%06d", F.col(by).cast("string"), n))


def recent(calls: DataFrame, by: str, at: str, seconds: int) -> DataFrame:
    """Requests of a client in the last seconds, the present one included."""
    window = Window.partitionBy(by).orderBy(_micros(F.col(at))).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return calls.withColumn("recent", F.count("*").over(window))


def recalled(requests: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Each request with the answer that is held for it, and whether there is one (JN-2, SRC-7)."""
    return requests.join(held, key, "left").withColumn("miss", F.col("body_sha256").isNull())


def with_bodies(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Rows with the body that their digest names, and whether it is missing or differs from it (SRC-6, AGG-21)."""
    both = rows.join(blobs.select(F.col("sha256").alias("body_sha256"), "body"), "body_sha256", "left")
    return both.withColumn("state", F.when(F.col("body").isNull(), "missing").when(F.sha2("body", 256) != F.col("body_sha256"), "differs").otherwise("fine"))


def scan_id(pdf: Column, ruleset: Column) -> Column:
    """The same for the same file and rules (STR-24)."""
    return F.concat(F.lit("q"), F.left(F.sha2(F.to_json(F.struct(pdf.alias("pdf"), ruleset.alias("ruleset"))), 256), F.lit(11)))


def best_key(keys: DataFrame, pool: str, reserve: int) -> DataFrame:
    """Of each pool the key with the most searches left above the reserve (AGG-22), the first of equals."""
    return keys.where(~F.col("exhausted") & (F.col("left") > reserve)).groupBy(pool).agg(F.max_by("key", F.struct("left", F.col("ord") * -1)).alias("key"))


def timings(runs: DataFrame, *by: str) -> DataFrame:
    """Least, median and greatest of each benchmark in readable units (AGG-19). ``runs``: seconds."""
    told = lambda c: F.when(c < 1e-3, F.format_string("%.1f µs", c * 1e6)).when(c < 1, F.format_string("%.1f ms", c * 1e3)).otherwise(F.format_string("%.2f s", c))
    stats = percentiles(runs, [*by], "seconds", {"least": 0.0, "median": 0.5, "most": 1.0})
    return stats.select(*by, *[told(F.col(c)).alias(c) for c in ("least", "median", "most")])


def sample_runs(files: DataFrame, name: str, shards: int, shard: int) -> DataFrame:
    """Every shards-th file in the order of their digests (SRT-9); the order is told by ranges, so no task sees all files."""
    return ranked(files, F.sha2(name, 256), name="place").where((F.col("place") - 1) % shards == shard)
