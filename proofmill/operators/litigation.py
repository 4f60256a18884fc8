"""Matters on legal sites that name a company or its promoters, and whether a filing discloses them (JN-8, JN-9, FLT-2, FLT-9, SET-5, SRT-4, DAT-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.functions import dates, guards, names
from proofmill.operators.claims import first_by
from proofmill.operators.containment import containing
from proofmill.sources.stored import written

# Legal sites, and promoters that are searched for.
SEBI_HOST = "sebi.gov.in"
LEGAL_DOMAINS = ["sebi.gov.in", "indiankanoon.org", "ibbi.gov.in"]
MAX_PROMOTERS = 3


def subjects(cases: DataFrame, promoters: DataFrame, key: str, order: str) -> DataFrame:
    """``key``, ord, subject, issuer: the issuer of each case, then its first distinct promoters by ``order`` (a promoter of
    the issuer's name is no subject of its own, but takes a place). ``cases``: key, issuer; ``promoters``: key, name, order."""
    once = first_by(promoters.where("name is not null"), [key, "name"], F.col(order))
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    some = once.withColumn("ord", place).where(F.col("ord") <= MAX_PROMOTERS).select(key, "ord", F.col("name").alias("subject"))
    own = cases.select(key, F.lit(0).alias("ord"), F.col("issuer").alias("subject"))
    return own.unionByName(some).join(cases.select(key, "issuer"), key).where("ord = 0 or subject <> issuer")


def _core(name: Column, ascii_only: bool) -> Column:
    return names.normalize_company(name, ascii_only)


def matters(hits: DataFrame, about: DataFrame, refs: DataFrame, key: str, hit: str, ascii_only: bool = False) -> DataFrame:
    """``key``, ``hit``, subject, about_issuer, day, disclosed of the ``hits`` (key, hit, subject, url, title, snippet) that
    tell of a subject of their case. ``about``: of ``subjects``; ``refs``: key, case_ref as the filing prints them.

    The URL must lie on a legal site and the title name the subject; as two people can share a name, a promoter's hit must
    also name the issuer somewhere. A matter is disclosed if a reference of its case, without case and marks, stands in the
    hit's title, snippet and URL so squashed: all references meet all hits by grams, and the case is compared after that. A
    reference of marks alone is in any text. Null titles, snippets and URLs are empty.
    """
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")), F.coalesce("url", F.lit("")))
    read = hits.where(guards.on_host(F.col("url"), LEGAL_DOMAINS)).select(key, hit, "subject", "url", F.coalesce("title", F.lit("")).alias("title"), text.alias("text"))
    cores = about.select(key, "subject", _core(F.col("subject"), ascii_only).alias("core"), _core(F.col("issuer"), ascii_only).alias("issuer_core"), (F.col("ord") == 0).alias("about_issuer"))
    named = read.join(cores, [key, "subject"]).where(F.contains(_core(F.col("title"), ascii_only), "core"))
    # Stored, as it is read four times: long texts are normalized once.
    named = written(named.where(F.col("about_issuer") | F.contains(_core(F.col("text"), ascii_only), "issuer_core")), "named-hits")

    printed = refs.where(F.trim("case_ref") != "").select(key, names.squash(F.col("case_ref")).alias("ref")).distinct()
    told = containing(named.select(hit, names.squash(F.col("text")).alias("squashed")), printed, hit, "squashed", "ref")
    own = named.select(key, hit).join(told, hit).join(printed, [key, "ref"]).select(key, hit)
    marks = named.select(key, hit).join(printed.where("ref = ''").select(key), key)
    disclosed = own.unionByName(marks).distinct().withColumn("told", F.lit(True))
    out = named.join(disclosed, [key, hit], "left")
    return out.select(key, hit, "subject", "about_issuer", dates.matter_date(F.col("title"), F.col("url")).alias("day"), F.coalesce("told", F.lit(False)).alias("disclosed"))


def undisclosed(found: DataFrame, cutoff: Column) -> DataFrame:
    """Matters that nothing discloses, dated up to the cutoff; without a cutoff the undated too (FLT-9)."""
    return found.where(is_undisclosed(cutoff))


def is_undisclosed(cutoff: Column) -> Column:
    """The condition of ``undisclosed``."""
    return ~F.col("disclosed") & dates.in_time(F.col("day"), cutoff)


def is_order(url: Column) -> Column:
    """A page of the regulator's orders: its host, and a path that tells an order's month (FLT-4)."""
    return guards.on_host(url, [SEBI_HOST]) & dates.order_month(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))).isNotNull()
