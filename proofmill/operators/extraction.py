"""Claims that pages state, by rules (the claim source; FLT-13, FLT-14, JN-10, JN-11, SET-5, STR-14, AGG-17).

A table function reads a page's text once for each task of its section and gives as many typed claims as the rules find.
What is kept is what can be proven: each value of a claim must stand on its page, roles and rows of expenses tables go,
and of equal claims of a document the first stays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window

from proofmill.functions import guards, names
from proofmill.operators import claims

# The tasks with the sections that they read, and role words that are no names.
TASKS = {
    "quotes": ["objects"],
    "lead_managers": ["general_information"],
    "past_issues": ["regulatory"],
    "cases": ["litigation"],
    "places": ["general_information"],
    "promoters": ["promoters"],
    "group_companies": ["group_companies"],
}
GENERIC_NAMES = [
    "book running lead manager", "book running lead managers", "lead manager", "lead managers", "brlm", "registrar", "registrar to the issue",
    "promoter", "promoters", "group company",
]
ROLES = {"registered office": "registered_office", "corporate office": "corporate_office", "factory": "factory", "warehouse": "warehouse"}

#: What a claim may state, of all kinds together; a value that its kind lacks, or the page leaves open, is null.
VALUES = ["vendor", "item", "amount_text", "unit_text", "quote_date_text", "name", "issuer", "listing_date_text", "issue_price_text", "party", "forum", "case_ref", "locality", "city"]
FIELDS = [*VALUES, "role"]
_NAME = VALUES.index("name")

_COMPANY = r"[A-Z][\w&.,'()/ -]{1,90}?\b(?:LIMITED|Limited|LTD\.?|Ltd\.?|LLP)"
_AMOUNT = r"(?:₹|Rs\.?|INR)\s?\d[\d,]*(?:\.\d+)?"
_DAY = r"\d{1,2}(?:st|nd|rd|th)?[ ./-][A-Za-z0-9]{1,9},?[ ./-]\d{4}|[A-Z][a-z]{2,8} \d{1,2}, \d{4}"
_UNIT = re.compile(r"amount\s*\(?\s*(?:in|₹ in|rs\.? in)\s+(lakhs?|crores?|million|rs\.?)", re.I)
_BLOCK = re.compile(rf"(?:quotation date\s*:\s*-?\s*(?P<quote_date_text>{_DAY})\.?\s+)?quotation from\s*:\s*-?\s*(?P<vendor>\S.{{1,90}}?)\s+\d{{1,3}}\s+(?P<amount_text>\d[\d,]*(?:\.\d+)?)(?=\s|$)", re.I)
_ROW = re.compile(rf"^\s*(?:\d{{1,3}}[.)]?\s+)?(?P<vendor>{_COMPANY})\s+(?:for\s+(?P<item>[^₹\n]{{3,60}}?)\s+)?(?P<amount_text>{_AMOUNT})(?:\s+(?:dated\s+)?(?P<quote_date_text>{_DAY}))?\s*$", re.M)
_ISSUE = re.compile(rf"^\s*(?:\d{{1,3}}[.)]?\s+)?(?P<issuer>{_COMPANY})\s+(?P<issue_price_text>(?:₹|Rs\.?)?\s?\d[\d,]*\.\d\d)\s+(?P<listing_date_text>{_DAY})\s*$", re.M)
_CASE = re.compile(r"(?P<party>[A-Z][\w&.,' -]{1,80}?)\s+(?:v\.|vs\.?|versus)\s+[A-Z][^.;\n]{1,80}?,?\s+(?P<case_ref>(?:[A-Z][\w.]+ ){0,3}?No\.?\s?[\w/-]+(?: of \d{4})?)(?:,?\s+before\s+(?:the\s+)?(?P<forum>[A-Z][^.;\n]{2,60}))?")
_PLACE = re.compile(r"^\s*(?:our\s+)?(?P<role>registered office|corporate office|factory|warehouse)\s*:\s*-?\s*(?P<address>\S[^\n]{3,200})$", re.I | re.M)
_PEOPLE = {
    "lead_managers": re.compile(r"^\s*(?:book running )?lead managers?(?: to the (?:issue|offer))?\s*:\s*-?\s*(?P<names>\S[^\n]{2,300})$", re.I | re.M),
    "promoters": re.compile(r"\bour promoters? (?:are|is)\s*:?\s*(?P<names>\S[^\n]{2,300}?)\.?$", re.I | re.M),
    "group_companies": re.compile(r"\bour group (?:company|companies) (?:are|is)\s*:?\s*(?P<names>\S[^\n]{2,300}?)\.?$", re.I | re.M),
}
_BETWEEN = re.compile(r"\s*(?:,|;|\band\b|&(?=\s))\s*")


def _quotes(text: str) -> Iterator[tuple[int, dict]]:
    unit = _UNIT.search(text)
    flat = " ".join(text.split())
    for m in _BLOCK.finditer(flat):
        yield text.find(flat[m.start() : m.start() + 9]), {**m.groupdict(), "unit_text": unit and unit[1]}
    for m in _ROW.finditer(text):
        yield m.start(), m.groupdict()


def _places(text: str) -> Iterator[tuple[int, dict]]:
    """Of an address the last two parts alone, without its postal code: never a door number."""
    for m in _PLACE.finditer(text):
        parts = [p for p in (re.sub(r"[\s-]*\d{3}\s?\d{3}$", "", p).strip(" .") for p in m["address"].split(",")) if p and p.lower() != "india"]
        if parts:
            yield m.start(), {"role": ROLES[m["role"].lower()], "city": parts[-1], "locality": parts[-2] if len(parts) > 1 else None}


def _named(task: str, text: str) -> Iterator[tuple[int, dict]]:
    for m in _PEOPLE[task].finditer(text):
        for i, name in enumerate(_BETWEEN.split(m["names"])):
            yield m.start() + i, {"name": name.strip(" .")}


def found(task: str, text: str) -> Iterator[dict]:
    """Claims of a task that a page's text states, in the order in which they stand there."""
    plain = {"quotes": _quotes, "places": _places, "past_issues": lambda t: ((m.start(), m.groupdict()) for m in _ISSUE.finditer(t)), "cases": lambda t: ((m.start(), m.groupdict()) for m in _CASE.finditer(t))}
    pairs = plain[task](text) if task in plain else _named(task, text) if task in _PEOPLE else iter(())
    for _, claim in sorted(pairs, key=lambda x: x[0]):
        tidy = {k: " ".join(v.split()) for k, v in claim.items() if v and v.strip()}
        if tidy.keys() - {"role"}:
            yield tidy


@udtf(returnType="at int, " + ", ".join(f"{f} string" for f in FIELDS))
class RuleClaims:
    """A row for each claim of ``task`` in ``text``; none for a null text or an unknown task."""

    def eval(self, task: str, text: str) -> Iterator[tuple]:
        for i, claim in enumerate(found(task, text or "") if task else ()):
            yield (i, *(claim.get(f) for f in FIELDS))


def _judged(texts: pd.Series, values: pd.Series) -> pd.DataFrame:
    """Of each claim its name as it is compared, whether all its values, so compared, stand in its page, and their digest.
    Claims of a page follow one another, so a page is normalized once."""
    out, text, flat = [], None, ""
    for own, joined in zip(texts, values, strict=True):
        if own != text:
            text, flat = own, names.normed(own)
        norms = [names.normed(v) for v in joined.split("\x1f")]
        out.append((norms[_NAME], all(v in flat for v in norms), hashlib.sha256("\x1f".join(norms).encode()).hexdigest()))
    return pd.DataFrame(out, columns=["named", "proven", "key"])


def may_state(task: Column, text: Column) -> Column:
    """Whether a text, once it is cleaned and masked, may hold a claim of the task: a word stands there that all its rules
    ask for, or it has characters that cleaning may change, or Python's rules take for others. No mask makes such a word."""
    low = F.lower(text)
    has = lambda t, *words: reduce(or_, [F.contains(t, F.lit(w)) for w in words])
    company = has(text, "LIMITED", "Limited", "LTD", "Ltd", "LLP")
    out = F.lit(True)
    for name, test in {
        "quotes": company | has(low, "quotation"), "past_issues": company, "cases": has(text, "No"), "places": has(low, "office", "factory", "warehouse"),
        "lead_managers": has(low, "lead manager"), "promoters": has(low, "our promoter"), "group_companies": has(low, "our group compan"),
    }.items():
        out = F.when(task == name, test).otherwise(out)
    return F.coalesce(out | text.rlike(guards.UNSAFE_ASCII) | names.strange(text), F.lit(False))


def tasks() -> Column:
    """Section names with their tasks, as an array of structs."""
    return F.array(*[F.struct(F.lit(s).alias("section"), F.lit(t).alias("task")) for t, sections in TASKS.items() for s in sections])


def extracted(pages: DataFrame, doc: str, page: str, section: str, text: str) -> DataFrame:
    """doc, task, page, at, the values, span and verdict (kept, generic, ungrounded, repeated) of each claim that the rules
    find in ``pages`` (doc, page, section, text), whose texts are cleaned and masked first.

    A page whose section has no task gives nothing; one of two sections is read for each. Values are compared as
    ``names.norm`` has them. Repeated claims are those of a document and task whose values (not the role) are all equal to
    an earlier kept one's.
    """
    # Pages are cleaned before they are read for each of their tasks, and those that no task finds anything on not at all.
    own = F.filter(tasks(), lambda t: (t["section"] == F.col(section)) & may_state(t["task"], F.col(text)))
    tasked = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.col(text).alias("text"), own.alias("tasks")).where(F.size("tasks") > 0)
    # Pages are few bytes and much work, so they are dealt to a number of tasks that isn't told from bytes; by their tasks
    # too, as a join by document and page before would take the place of this.
    tasked = tasked.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc", "page", "tasks")
    plain = tasked.withColumn("text", guards.bare(F.col("text"))).withColumn("text", names.nfkc(F.col("text")))
    clean = plain.withColumn("text", guards.mask_pii(F.col("text")))
    read = clean.withColumn("t", F.explode("tasks")).select("doc", "page", "text", "t.task")
    stated = read.lateralJoin(RuleClaims(F.col("task").outer(), F.col("text").outer()))
    first = F.element_at(F.filter(F.array(*VALUES), lambda v: v.isNotNull()), 1)
    # Values go to Python together, with their page; a clean page has no separator of its own.
    joined = F.array_join(F.transform(F.array(*VALUES), lambda v: F.coalesce(v, F.lit(""))), "\x1f")
    stated = stated.withColumn("judged", F.pandas_udf(_judged, "named string, proven boolean, key string")("text", joined))
    generic = F.col("judged.named").isin(*GENERIC_NAMES) | claims.is_expense(F.col("vendor"))
    verdict = F.when(generic, "generic").when(~F.col("judged.proven"), "ungrounded").otherwise("kept")
    judged = stated.select("doc", "task", "page", "at", *FIELDS, claims.page_span(F.col("text"), first).alias("span"), verdict.alias("verdict"), "judged.key")
    earlier = F.row_number().over(Window.partitionBy("doc", "task", "verdict", "key").orderBy("page", "at"))
    out = judged.withColumn("n", earlier)
    told = F.when((F.col("verdict") == "kept") & (F.col("n") > 1), "repeated").otherwise(F.col("verdict"))
    return out.select(F.col("doc").alias(doc), "task", "page", "at", *FIELDS, "span", told.alias("verdict"))
