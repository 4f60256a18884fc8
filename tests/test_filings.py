"""Section maps and claims by rules against brute force and on the values that they must give."""

import random
import re

import pytest
from pyspark.sql import functions as F

from proofmill import catalogue_filings as filings
from proofmill.operators import extraction, sections

SF = "/root/testdata/sf0.001"
TITLES = ["GENERAL INFORMATION", "RISK FACTORS", "OBJECTS OF THE ISSUE", "SECTION V - GENERAL INFORMATION", "OUR PROMOTERS", "OUR BUSINESS", "LEGAL"]


def located(spark, docs):
    pages = spark.createDataFrame([(d, n, t) for d, texts in docs.items() for n, t in enumerate(texts, 1)], "doc string, page int, text string")
    got = sections.section_map(pages, "doc")
    gaps = {r.doc: (r.toc_page, r.missing) for r in sections.section_gaps(pages, got, "doc").collect()}
    return {(r.doc, r.section): (r.title, r.start, r.end) for r in got.collect()}, gaps


def brute(texts):
    """Contents without wrapped titles; a page holds a heading in its first line."""
    toc = next((n for n, t in enumerate(texts[:15], 1) if "CONTENTS" in t.split("\n")), None)
    if toc is None:
        return {}
    listed = [m[1] for t in texts[toc - 1 : toc + 1] for line in t.split("\n") if (m := re.match(r"(.+?) \.{3,} \d+$", line))]
    starts, at = {}, toc + 1
    for title in listed:
        n = next((n for n, t in enumerate(texts, 1) if n >= at and title in t.upper().split("\n")[:4]), None)
        if n:
            starts[title] = at = n
    order = sorted(starts.items(), key=lambda x: x[1])
    out = {}
    for (title, start), after in zip(order, [*(s for _, s in order), len(texts) + 1][1:], strict=True):
        name = next((k for k, p in sections.TARGETS.items() if re.match(p, title.removeprefix("SECTION V - "))), None)
        if name and name not in out:
            out[name] = (title, start, max(start, after - 1))
    return out


def test_ends_come_from_all_titles(spark):
    """A title that names no section ends the one before it; the list spills onto the next page."""
    texts = ["cover", "TABLE OF CONTENTS\nGENERAL INFORMATION ...... 4\nRISK FACTORS ....... 5", "OBJECTS OF THE ISSUE ...... 9", "General Information", "Risk Factors", "x", "y", "z", "Objects of the Issue", "end"]
    got, gaps = located(spark, {"a": texts, "b": ["no list here", "General Information"], "c": ["INDEX", "nothing listed"]})
    assert got == {("a", "general_information"): ("GENERAL INFORMATION", 4, 4), ("a", "objects"): ("OBJECTS OF THE ISSUE", 9, 10)}
    assert gaps["a"] == (2, ["business", "group_companies", "litigation", "promoters", "regulatory"]) and gaps["b"][0] is None and gaps["c"][0] == 1
    assert gaps["b"][1] == gaps["c"][1] == sorted(sections.TARGETS)


def test_section_map_random(spark):
    """Titles that repeat, are missing, share a page or name one section; lists beyond the first 15 pages."""
    rng = random.Random(5)
    docs = {}
    for d in range(60):
        listed = [rng.choice(TITLES) for _ in range(rng.randint(0, 9))]
        toc = rng.choice([0, 1, 2, 14, 15])
        half = rng.randint(0, len(listed))
        entry = lambda ts: "\n".join(f"{t} ........ 3" for t in ts)
        headings = [t.title() if rng.random() < 0.5 else t for t in listed if rng.random() < 0.8]
        body = []
        while headings:
            body.append("\n".join([headings.pop(0) for _ in range(min(len(headings), rng.choice([1, 1, 2])))]))
            body += ["plain text\nRisk factors are named below\na\nb\nRISK FACTORS"] * rng.choice([0, 1, 2])
        docs[f"d{d}"] = ["cover"] * toc + ["CONTENTS\n" + entry(listed[:half]), entry(listed[half:])] + body
    got, _ = located(spark, docs)
    assert got == {(d, name): x for d, texts in docs.items() for name, x in brute(texts).items()}


PAGE = """Sr. No. Particulars Quotation Amount (In Lakhs)*
Quotation Date: - May
16, 2024.
Quotation from: -
OASIS CORPCARE
PRIVATE LIMITED
1 1,770.00 Total *1,770.00
2 Steel & Co. Private Limited for rolling mill ₹ 12,50,000.00 dated 3 May 2024
3 Total Estimated Issue Expenses Limited ₹ 9.00
Promoter PAN ABCDE1234F"""


def test_rules():
    quotes = list(extraction.found("quotes", PAGE))
    assert quotes[0] == {"quote_date_text": "May 16, 2024", "vendor": "OASIS CORPCARE PRIVATE LIMITED", "amount_text": "1,770.00", "unit_text": "Lakhs"}
    assert quotes[1] == {"vendor": "Steel & Co. Private Limited", "item": "rolling mill", "amount_text": "₹ 12,50,000.00", "quote_date_text": "3 May 2024"}
    assert [*extraction.found("places", "Registered Office: 12, Main Road, MIDC Area, Pune - 411 001, India\nFactory:- Baddi")] == [{"role": "registered_office", "city": "Pune", "locality": "MIDC Area"}, {"role": "factory", "city": "Baddi"}]
    assert [c["name"] for c in extraction.found("promoters", "x\nOur Promoters are A. Shah, B. Rao and C.K. Das.\ny")] == ["A. Shah", "B. Rao", "C.K. Das"]
    assert [*extraction.found("cases", "Acme Limited vs. State Bank, Company Petition No. 12/2020 before the National Tribunal.")] == [{"party": "Acme Limited", "case_ref": "Company Petition No. 12/2020", "forum": "National Tribunal"}]
    assert [*extraction.found("past_issues", "1 Shera Energy Limited ₹ 57.00 17 February 2023")] == [{"issuer": "Shera Energy Limited", "issue_price_text": "₹ 57.00", "listing_date_text": "17 February 2023"}]
    assert [*extraction.found("unknown", PAGE)] == [*extraction.found("cases", "")] == []


def test_extracted(spark):
    rows = [("a", 1, "objects", PAGE), ("a", 2, "objects", PAGE), ("a", 3, "other", PAGE), ("b", 1, "objects", None), ("b", 2, None, PAGE), ("c", 1, "promoters", "Our Promoters are Promoter and Ａnn Lee")]
    got = extraction.extracted(spark.createDataFrame(rows, "doc string, page int, section string, text string"), "doc", "page", "section", "text").orderBy("doc", "page", "at").collect()
    assert [(r.doc, r.page, r.at, r.verdict) for r in got] == [
        ("a", 1, 0, "kept"), ("a", 1, 1, "kept"), ("a", 1, 2, "generic"), ("a", 2, 0, "repeated"), ("a", 2, 1, "repeated"), ("a", 2, 2, "generic"), ("c", 1, 0, "generic"), ("c", 1, 1, "kept"),
    ]
    assert "OASIS CORPCARE PRIVATE LIMITED" in got[0].span and len(got[0].span) <= 300 and "ABCDE1234F" not in got[0].span
    assert got[7].name == "Ann Lee"  # cleaned text has one form of a letter


def test_invented_values_are_dropped(spark, monkeypatch):
    """A claim whose value doesn't stand on its page is told as ungrounded."""
    pages = spark.createDataFrame([("a", 1, "promoters", "Our Promoters are Ann Lee")], "doc string, page int, section string, text string")

    class Liar(extraction.RuleClaims.func):
        def eval(self, task, text):
            for row in super().eval(task, text):
                yield row
                yield (1, *("Bob Ray" if f == "name" else None for f in extraction.FIELDS))

    monkeypatch.setattr(extraction, "RuleClaims", F.udtf(Liar, returnType=extraction.RuleClaims.returnType))
    got = extraction.extracted(pages, "doc", "page", "section", "text").collect()
    assert sorted((r.name, r.verdict) for r in got) == [("Ann Lee", "kept"), ("Bob Ray", "ungrounded")]


@pytest.mark.parametrize("task", ["quotes", "places", "promoters"])
def test_query_finds_what_the_rules_find(spark, task):
    table = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    pages = filings._filings(table)
    got = filings._claims(table).where(F.col("task") == task).groupBy("o_custkey", "page").count().collect()
    texts = {(r.o_custkey, r.page): r.text for r in pages.collect()}
    assert got and all(r["count"] == len([*extraction.found(task, texts[r.o_custkey, r.page])]) for r in got)
