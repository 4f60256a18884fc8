"""Removal of lines that many sites share.

A line's spread is the number of distinct sites it stands on. HyperLogLog sketches of the sites are built for each line
hash and merge by aggregation; a line whose estimate lies near the threshold gets an exact distinct count. Lines that
are spread are boilerplate: their first occurrence stays, all others go. Lines are told apart by a 64-bit hash and their
length; estimates outside the margin of six standard errors are taken as they are (wrong once in 10^9 such lines).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm.store import discard, documents, word_count, written

MIN_SITES = 10
MIN_WORDS = 3
LG_K = 12


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """Lines of ``docs`` (doc_id, txt, text, source) that have enough words."""
    lines = docs.select("doc_id", "txt", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(word_count(F.col("line")) >= min_words).select("doc_id", "txt", "source", "line_no", F.xxhash64("line").alias("h"), F.length("line").alias("chars"))


def _place() -> Column:
    return F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "txt", "line_no")


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """Spread lines: h, chars, first (the least doc_id, hash of the text and line number, null id first)."""
    key, place = ["h", "chars"], _place()
    # Fewer occurrences than sites asked for can't be spread; this count keeps the sketches few.
    often = written(lines.groupBy(*key).agg(F.count("*").alias("n"), F.min(place).alias("first")).where(F.col("n") >= min_sites).drop("n"), "often")
    met = lines.join(often, key)
    spread = written(met.groupBy(*key).agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", LG_K)).alias("sites"), F.first("first").alias("first")), "spread")
    margin = 1 + 6 * 1.04 / (1 << LG_K // 2) * min_sites
    sure = spread.where(F.col("sites") > min_sites + margin).drop("sites")
    close = spread.where(F.abs(F.col("sites") - min_sites) <= margin)
    exact = lines.join(close.select(*key), key).where("source is not null").groupBy(*key, "source").count().groupBy(*key).agg(F.count("*").alias("n"))
    found = written(sure.unionByName(close.join(exact.where(F.col("n") >= min_sites), key).select(*key, "first")), "boilerplate")
    discard(often, spread)
    return found


def dedup(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, source and any more) without repeated boilerplate lines, with n_lines and n_removed.

    Lines are parted by \\n; a line of at least ``min_words`` words that stands on ``min_sites`` distinct sources or more
    goes, but for its first occurrence. A null text stays null with 0 lines; an empty one has one empty line. A null
    source is no site; a null id counts as least. Rows that share an id are documents of their own if their texts differ
    (the one with the least hash is first); repeated rows share the lines that go. Empty tables give no rows.
    """
    text = F.col("text").cast("string")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("txt"), text.alias("text"), F.col("source").cast("string").alias("source"))
    lines = written(_lines(named, min_words), "lines")
    spread = boilerplate(lines, min_sites)
    gone = lines.join(spread, ["h", "chars"]).where(_place() != F.col("first")).groupBy("doc_id", "txt").agg(F.collect_set("line_no").alias("gone"))
    gone = written(gone, "gone")
    discard(lines, spread)
    # A shuffle at any size, so that what it needs of disk is in proportion to the texts.
    both = docs.alias("d").join(gone.alias("g").hint("merge"), F.expr("d.doc_id <=> g.doc_id and xxhash64(cast(d.text as string)) = g.txt"), "left")
    own = F.struct(*[F.col(f"d.`{c}`") for c in docs.columns if c != "text"]).alias("own")
    split = both.select(own, F.col("d.text").alias("text"), F.split(F.col("d.text"), "\n").alias("split"), F.coalesce(F.col("g.gone"), F.array().cast("array<int>")).alias("out"))
    # Places that stay are found by a set and looked up one by one, so the work grows with the lines alone.
    stay = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), F.col("out"))
    kept = F.when(F.size("out") == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("split", i)), "\n"))
    cols = [kept.alias(c) if c == "text" else F.col(f"own.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return split.select(*cols, F.when(F.col("text").isNull(), 0).otherwise(F.size("split")).cast("long").alias("n_lines"), F.size("out").cast("long").alias("n_removed"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents
), spread AS (
  SELECT line, min(struct_pack(d := doc_id, i := i)) AS first FROM lines
  WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 3 GROUP BY line HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT l.doc_id, l.i, l.line, s.line IS NOT NULL AND struct_pack(d := l.doc_id, i := l.i) <> s.first AS gone
  FROM lines l LEFT JOIN spread s ON l.line = s.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
