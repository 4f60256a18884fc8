"""Rules and cards (VX-02 to HY-01, AGG-6, AGG-15): what is found becomes signals, signals become counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.functions.dates import calendar_months
from proofmill.functions.money import ratio

# Statuses of companies that no longer act; thresholds.
STRUCK_OFF = ["strike off", "struck off", "under process of striking off", "dormant", "dissolved", "liquidated", "under liquidation", "amalgamated"]
STALE_MONTHS, CAPITAL_TIMES = 18, 100
C, I, U, N = "consistent", "inconsistent", "unverified", "not_applicable"  # noqa: E741


def capital_status(quote: Column, paid: Column) -> Column:
    """VX-03: a quotation of 100 times the paid-up capital or more doesn't fit."""
    r = ratio(quote, paid)
    return F.when(r.isNull(), U).when(r >= CAPITAL_TIMES, I).otherwise(C)


def registry_status(matched: Column) -> Column:
    """VX-02: absence is never inconsistent."""
    return F.when(F.size(matched) > 0, C).otherwise(U)


def company_status(status: Column, sheet: Column, cutoff: Column) -> Column:
    """VX-04."""
    stale = F.coalesce(calendar_months(sheet, cutoff) > STALE_MONTHS, F.lit(False))
    return F.when(status.isin(*STRUCK_OFF), I).when(stale, I).when(status == "active", C).otherwise(U)


def presence_status(found: Column, open_state: Column, has_form: Column) -> Column:
    """VX-05: a bare name's listing is shown but not counted."""
    closed = F.contains(F.lower(F.coalesce(open_state, F.lit(""))), F.lit("permanently closed"))
    return F.when(~found, U).when(closed, I).when(has_form, C).otherwise(U)


def hits_status(n: Column) -> Column:
    """VX-06, BK-04, BK-05, LT-03, NW-01: any hit that counts is inconsistent."""
    return F.when(n > 0, I).otherwise(C)


def card(signals: DataFrame, doc: str, top: int = 3) -> DataFrame:
    """Counts by status, the first inconsistent rules, and the number of lines. ``signals``: doc, ord, rule, status. No
    card's lines are collected: of the inconsistent ones the first ``top`` alone."""
    counts = signals.groupBy(doc).agg(F.count_if(F.col("status") != N).alias("n_lines"), *[F.count_if(F.col("status") == s).alias(s) for s in (C, I, U)])
    place = F.row_number().over(Window.partitionBy(doc).orderBy("ord", "rule"))
    first = signals.where(F.col("status") == I).select(doc, "rule", place.alias("place")).where(F.col("place") <= top)
    flagged = first.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "rule"))), lambda x: x["rule"]), ",").alias("top"))
    headline = F.format_string("%d of %d check out · %d don't match · %d couldn't find", C, "n_lines", I, U)
    return counts.join(flagged, doc, "left").select(doc, C, I, U, F.col("n_lines").cast("int").alias("n_lines"), F.coalesce("top", F.lit("")).alias("top"), headline.alias("headline"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The 95% interval of a rate; (0, 1) without cases, exact at its ends."""
    p, z2 = k / n, z * z
    centre, spread = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low = F.when(n == 0, 0.0).when(k == 0, 0.0).otherwise((centre - spread) / (1 + z2 / n))
    high = F.when(n == 0, 1.0).when(k == n, 1.0).otherwise((centre + spread) / (1 + z2 / n))
    return low, high


def rates(cases: DataFrame, role: str, flagged: str) -> DataFrame:
    counted = cases.groupBy(role).agg(F.count("*").alias("n"), F.count_if(F.col(flagged)).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return counted.select(role, "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))
