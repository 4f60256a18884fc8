"""Questions about a card and answers that cite it (SRT-3, SET-8, MTH-10, MTH-11, STR-20, STR-21, STR-25, STR-26, JN-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.functions import guards

# Long names of months, patterns of citations, shares and limits.
MONTH_NAMES = ["january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december"]
PROSE_CITE = r"\b([LS]\d{1,3})\b"
CITE_MARKS = r"(?i)\s*(?:cites?:\s*)?[\[(]\s*[\"']?[LS]\d{1,3}[\"']?(?:\s*,\s*[\"']?[LS]\d{1,3}[\"']?)*\s*[\])]"
LINE_PHRASE = r"(?i)\blines?\s+\d+(?:\s*(?:,|and|&)\s*\d+)*"
LINE_REF = r"(?i)\bline\s*(\d+)"
SUPPORTED, MOST_LINES, MOST_CITES = 0.6, 3, 6


def terms(text: Column) -> Column:
    """Words of a text, months by their first three letters."""
    return F.array_distinct(F.transform(guards.words(text), lambda w: F.when(w.isin(*MONTH_NAMES), F.left(w, F.lit(3))).otherwise(w)))


def topics(asked: Column, cues: dict[str, list[str]]) -> Column:
    """Topics one of whose cues is asked for."""
    each = [F.when(F.arrays_overlap(asked, F.array(*map(F.lit, words))), F.lit(t)) for t, words in cues.items()]
    return F.array_compact(F.array(*each))


def absent(asked: Column, present: Column) -> Column:
    """The topics asked for, sorted, if a card has no line on any of them; else null."""
    return F.when((F.size(asked) > 0) & ~F.arrays_overlap(asked, present), F.array_sort(F.array_except(asked, present)))


def picked(questions: DataFrame, lines: DataFrame, card: str, ask: str, cues: dict[str, list[str]], flag: list[str]) -> DataFrame:
    """The lines that answer a question: a line asked for by number, else the best by score, first of equals.
    ``questions``: card, ask, question; ``lines``: card, n, topic, status, text."""
    asked = questions.withColumn("ref", F.regexp_extract("question", LINE_REF, 1).try_cast("int")).withColumn("asked", guards.words(F.col("question")))
    asked = asked.withColumn("topics", topics(F.col("asked"), cues)).withColumn("flagged", F.arrays_overlap("asked", F.array(*map(F.lit, flag))))
    both = asked.join(lines, card).withColumn("last", F.max("n").over(Window.partitionBy(card, ask)))
    by_number = F.col("ref").isNotNull() & F.col("ref").between(1, F.col("last"))
    points = 3 * F.array_contains("topics", F.col("topic")).cast("int") + F.size(F.array_intersect("asked", guards.words(F.col("text")))) + 3 * (F.col("flagged") & (F.col("status") == "inconsistent")).cast("int")
    scored = both.withColumn("score", F.when(by_number, F.when(F.col("n") == F.col("ref"), 1).otherwise(0)).otherwise(points)).where("score > 0")
    rank = F.row_number().over(Window.partitionBy(card, ask).orderBy(F.col("score").desc(), "n"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= MOST_LINES).select(card, ask, "n", "score", "rank")


def supported(said: Column, lines: Column) -> Column:
    """References to the lines that hold most of each sentence's terms, or none at all if some sentence has less than
    SUPPORTED of them in any line. ``said``: array of sentences' terms; ``lines``: array of (n, terms)."""
    share = lambda s, x: F.size(F.array_intersect(s, x["terms"])) / F.size(s)
    best = lambda s: F.array_max(F.transform(lines, lambda x: F.struct(share(s, x).alias("share"), (-x["n"]).alias("n"))))
    found = F.transform(F.filter(said, lambda s: F.size(s) > 0), best)
    refs = F.transform(found, lambda b: F.concat(F.lit("L"), (-b["n"]).cast("string")))
    return F.when(F.forall(found, lambda b: b["share"] >= SUPPORTED), refs).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def citations(text: Column) -> Column:
    """References in a text: ids, then lines mentioned in prose ("lines 1 and 3"), each once."""
    named = F.regexp_extract_all(text, F.lit(PROSE_CITE), F.lit(1))
    phrases = F.regexp_extract_all(text, F.lit(LINE_PHRASE), F.lit(0))
    prose = F.flatten(F.transform(phrases, lambda p: F.transform(F.regexp_extract_all(p, F.lit(r"\d+"), F.lit(0)), lambda n: F.concat(F.lit("L"), n))))
    return F.array_distinct(F.concat(named, prose))


def unmarked(text: Column) -> Column:
    return F.regexp_replace(text, CITE_MARKS, "")


def cited(refs: DataFrame, lines: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """References with what they point at (JN-15): a card's line or a search hit by its number; the first MOST_CITES that
    exist. ``refs``: key, refs; ``lines`` and ``hits``: key, n, url."""
    one = refs.select(key, F.posexplode("refs").alias("at", "ref")).select(key, "at", "ref", F.left("ref", F.lit(1)).alias("kind"), F.substring("ref", 2, 9).try_cast("int").alias("n"))
    targets = lines.select(key, F.col("n").cast("int").alias("n"), "url", F.lit("L").alias("kind")).unionByName(hits.select(key, F.col("n").cast("int").alias("n"), "url", F.lit("S").alias("kind")))
    place = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    return one.join(targets, [key, "kind", "n"]).withColumn("place", place).where(F.col("place") <= MOST_CITES).select(key, "place", "ref", "url")


def routed(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first pattern that a text matches (STR-25, STR-26)."""
    out = F.lit(otherwise)
    for pattern, name in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out
