"""Found items of all searches in one pool, places as facts, stored bodies, and what a reader asks for (SET-7, SET-10, STR-18,
STR-26, SNK-7, FLT-8, DAT-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.functions import dates, guards, registry
from proofmill.operators.containment import containing
from proofmill.operators.litigation import LEGAL_DOMAINS
from proofmill.operators.vendors import REGISTRY_DOMAINS

# What asks for a line's source, for a document, and for an example.
PROOF = r"(?i)\b(?:proof|evidence|source)\b.*?(\d+)|\bline\s*(\d+)"
PDF_IN_TEXT = r"(?i)(\S+\.pdf|https://\S+)"
EXAMPLE = r"(?i)\b(?:example|demo|sample)\b"


def route(tool: Column, link: Column) -> Column:
    """Where an item belongs: by its host first, places by their tool; null for others."""
    return F.when(guards.on_host(link, REGISTRY_DOMAINS), "registry").when(guards.on_host(link, LEGAL_DOMAINS), "legal").when(tool == "search_maps", "maps")


def pooled(fixed: DataFrame, later: DataFrame, key: str, order: str) -> DataFrame:
    """Items of the fixed searches, then those that a second search found (SET-7, SET-10): ``key``, place, route and the
    items' columns. ``fixed`` have a route; of ``later`` (tool, link) those count that have one by ``route``."""
    found = later.withColumn("route", route(F.col("tool"), F.col("link"))).where("route is not null")
    both = fixed.withColumn("stage", F.lit(0)).unionByName(found.select(*fixed.columns).withColumn("stage", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(key, "route").orderBy("stage", order))
    return both.withColumn("place", place).drop("stage")


def place_facts(item: dict[str, Column]) -> Column:
    """A place's listing with defaults for what it lacks (STR-18). ``item``: title, address, open_state, unclaimed, reviews, type."""
    return F.struct(
        F.lit(True).alias("found"), F.coalesce(item["title"], F.lit("")).alias("title"), registry.city_area(item["address"]).alias("city_area"), F.coalesce(item["open_state"], F.lit("")).alias("open_state"),
        F.coalesce(item["unclaimed"], F.lit(False)).alias("unclaimed"), F.coalesce(item["reviews"].try_cast("int"), F.lit(0)).alias("reviews"), registry.place_type(item["type"]).alias("place_type"),
    )


def usable(city: Column) -> Column:
    """A place of business whose city isn't left blank (FLT-8)."""
    return ~F.coalesce(guards.is_blank(city), F.lit(True))


def published(iso: Column, text: Column, today: Column) -> Column:
    """When an item was published (DAT-5)."""
    return dates.item_date(iso, text, today)


def put_blobs(bodies: DataFrame, held: DataFrame) -> DataFrame:
    """What storing ``bodies`` (body: binary) adds to ``held`` (sha256): sha256, body of those that aren't held yet, each once
    (SNK-7)."""
    keyed = bodies.select(F.sha2("body", 256).alias("sha256"), "body")
    return keyed.join(held.select("sha256"), "sha256", "left_anti").dropDuplicates(["sha256"])


def intents(turns: DataFrame, cases: DataFrame, key: str, example: str) -> DataFrame:
    """``key``, intent, object of what a turn asks for (STR-26): the proof of a line, a document, a recorded case that is
    named in plain words (the first by name; an example's is ``example``, if there is such a case), else to ask. ``turns``: key, text; ``cases``:
    name. Names meet texts by grams, however many there are of either."""
    lowered = turns.select(key, F.lower("text").alias("lowered"))
    words = cases.select("name", F.explode(F.array_distinct(F.array(F.lower("name"), F.replace(F.lower("name"), F.lit("-"), F.lit(" "))))).alias("said"))
    named = containing(lowered, words, key, "lowered", "said").join(words, "said").groupBy(key).agg(F.min("name").alias("case"))
    both = turns.join(named, key, "left")
    line = F.coalesce(F.nullif(F.regexp_extract("text", PROOF, 1), F.lit("")), F.nullif(F.regexp_extract("text", PROOF, 2), F.lit("")))
    document = F.nullif(F.regexp_extract("text", PDF_IN_TEXT, 1), F.lit(""))
    shown = example if cases.where(F.col("name") == example).limit(1).count() else None
    case = F.coalesce("case", F.when(F.col("text").rlike(EXAMPLE), F.lit(shown).cast("string")))
    intent = F.when(line.isNotNull(), "proof").when(document.isNotNull(), "scan").when(case.isNotNull(), "replay").otherwise("ask")
    return both.select(key, intent.alias("intent"), F.coalesce(line, document, case).alias("object"))
