"""Vendors, litigation, findings and answers on the values that they must give, and against brute force on awkward rows."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from proofmill.functions import names
from proofmill.operators import analyst, claims, litigation, sections, vendors
from proofmill.plans import findings
from proofmill.sources import journals

DAY = datetime.date


def test_named_pages(spark):
    who = [("v1", "g", "Oasis Corpcare Private Limited"), ("v2", "g", "Acme Steel Pvt. Ltd."), ("v3", "h", "Acme Steel Pvt. Ltd."), ("v4", "g", "Limited"), ("v5", "g", None)]
    pages = [
        ("p1", "g", "OASIS CORPCARE PRIVATE LIMITED - ZaubaCorp", None), ("p2", "g", "Company profile | Tofler", "the oasiscorp and OASIS CORPCARE PVT LTD, Mumbai"), ("p3", "g", "Oasis Corpcar Ltd | x", ""),
        ("p4", "h", "Acme - Steel", "makers of acme steels"), ("p5", "g", None, None), ("p6", "g", "Steel Acme Limited", "x"), ("p7", "h", "Oasis Corpcare", "Oasis Corpcare"),
    ]
    got = vendors.named_pages(spark.createDataFrame(who, "v string, g string, name string"), spark.createDataFrame(pages, "p string, g string, title string, snippet string"), "v", "p", "g")
    assert sorted(map(tuple, got.collect())) == [("v1", "p1"), ("v1", "p2"), ("v1", "p3"), ("v2", "p6"), ("v3", "p4")]


def test_second_look_follows_the_first(spark):
    """Only vendors with gaps look again, where the first look points; facts that were stated first stay."""
    who = spark.createDataFrame([(1, "Oasis Pvt Ltd"), (2, "Acme Pvt Ltd"), (3, "Bare Traders"), (4, "Empty Limited"), (5, None)], "v int, name string")
    rows = [
        (10, 1, 1, None, 1, "Oasis", "Registered office in Pune, India."), (11, 1, 2, "Pune", 2, "Oasis", "Status: Active. Paid-up capital is Rs. 5. Registered office in Delhi, India."), (12, 1, 2, "Delhi", 3, "Oasis", "CIN U74120MH2013PTC240744."),
        (20, 2, 1, None, 1, "Acme", "Status: Active. Paid-up capital is Rs. 7."), (21, 2, 2, None, 2, "Acme", "CIN U74120MH2013PTC240744."), (30, 3, 1, None, 1, "Bare", "Status: Active."), (40, 4, 2, None, 1, "Other", "Status: Active."),
    ]
    pages = spark.createDataFrame([(p, v, k, c, o, f"https://www.tofler.in/{p}", t, s) for p, v, k, c, o, t, s in rows], "page int, v int, look int, place string, ord int, url string, title string, snippet string")
    got = {r.v: r for r in vendors.vendor_facts(who, pages, "v", "page", "ord").collect()}
    assert (got[1].city, got[1].status, int(got[1].paid_up_paise), got[1].cin, got[1].n_second, got[1].gap_first, got[1].gap) == ("Pune", "active", 500, None, 1, True, False)
    assert got[1].sources["status"] == "https://www.tofler.in/11" and got[1].place_query == "Oasis Pvt Ltd Pune"
    assert (got[2].cin, got[2].n_second, got[2].gap_first) == (None, 0, False)
    assert got[3].matched is None and not got[3].gap and got[4].gap and got[4].gap_first and got[5].matched is None and len(got) == 5


def test_matters(spark):
    cases = spark.createDataFrame([("c", "Oasis Steel Pvt Ltd"), ("d", "Other Ltd")], "case string, issuer string")
    people = spark.createDataFrame([("c", i, n) for i, n in enumerate(["A. Shah", "A. Shah", "B Rao", "C Das", "D Fourth"])], "case string, at int, name string")
    about = litigation.subjects(cases, people, "case", "at")
    assert [(r.ord, r.subject) for r in about.where("case = 'c'").orderBy("ord").collect()] == [(0, "Oasis Steel Pvt Ltd"), (1, "A. Shah"), (2, "B Rao"), (3, "C Das")]
    k = "https://indiankanoon.org/doc/"
    hits = [
        (1, "c", "Oasis Steel Pvt Ltd", k, "Oasis Steel Limited vs State on 24 January, 2025", "W.P. No. 12/2019 pending"), (2, "c", "Oasis Steel Pvt Ltd", "https://news.example/", "Oasis Steel", ""),
        (3, "c", "A. Shah", k, "A Shah vs State", "a dispute of another"), (4, "c", "A. Shah", k, "A Shah vs State", "of OASIS STEEL LTD"), (5, "c", "Oasis Steel Pvt Ltd", "https://www.sebi.gov.in/enforcement/orders/mar-2024/x.html", "Order in Oasis Steel", None),
        (6, "c", "D Fourth", k, "D Fourth", "Oasis Steel"), (7, "d", "Other Ltd", k, "Other", "wp no 12 2019"), (8, "c", "Oasis Steel Pvt Ltd", k, None, "Oasis Steel"),
    ]
    refs = spark.createDataFrame([("c", "W.P. No.12 / 2019"), ("c", " "), ("d", "Suit 77"), (None, "x")], "case string, case_ref string")
    found = litigation.matters(spark.createDataFrame(hits, "hit int, case string, subject string, url string, title string, snippet string"), about, refs, "case", "hit")
    got = {r.hit: (r.about_issuer, r.day, r.disclosed) for r in found.collect()}
    assert got == {1: (True, DAY(2025, 1, 24), True), 4: (False, None, False), 5: (True, DAY(2024, 3, 1), False), 7: (True, None, False)}
    assert sorted(r.hit for r in litigation.undisclosed(found, F.lit(None).cast("date")).collect()) == [4, 5, 7]
    assert [r.hit for r in litigation.undisclosed(found, F.lit("2024-06-01").cast("date")).collect()] == [5]
    marks = litigation.matters(spark.createDataFrame(hits, "hit int, case string, subject string, url string, title string, snippet string"), about, spark.createDataFrame([("d", "—")], "case string, case_ref string"), "case", "hit")
    assert {r.hit: r.disclosed for r in marks.collect()} == {1: False, 4: False, 5: False, 7: True}


def test_initials_and_long_names(spark):
    """Runs of single letters become one token, in time that grows with the text."""
    cases = {"I.T.S. Private Limited": "its", "M/s. A B & Sons LLP": "ab and sons", "The X Y Z": "xyz", "a bc d e f": "a bc def", "Ltd": "", "A The B Ltd": "ab"}
    got = spark.createDataFrame([(k,) for k in cases], "n string").select("n", names.normalize_company(F.col("n")).alias("x")).collect()
    assert {r.n: r.x for r in got} == cases
    long_ = spark.range(3).select(F.repeat(F.lit("a word b c "), 40_000).alias("n")).select(names.normalize_company(F.col("n")).alias("x")).collect()
    assert long_[0].x.startswith("a word bca word") and len(long_[0].x) == 40_000 * 8 + 0 or long_[0].x.count("word") == 40_000


def evidence(url, title="t", published=None):
    return ("google", "0123456789abcdef", None, url, title, "", published)


VENDOR = f"k int, vendor string, page int, quote_paise long, registered boolean, cin string, incorporated date, status string, paid_up_paise long, last_balance_sheet date, sources map<string,string>, registry_evidence array<{findings.EVIDENCE}>, maps_found boolean, open_state string, city_area string, maps_evidence array<{findings.EVIDENCE}>, legal array<struct<day:date,evidence:{findings.EVIDENCE}>>"


def test_vendor_signals(spark):
    pages = [evidence("u1"), evidence("u2")]
    rows = [
        (1, "OASIS CORPCARE PRIVATE LIMITED", 89, 17_700_000_000, True, "U74120MH2013PTC240744", DAY(2013, 2, 26), "active", 10_000_000, DAY(2023, 3, 31), {"paid_up_paise": "u2"}, pages, True, "Open", "Andheri, Mumbai", [evidence("m")], [(DAY(2024, 1, 5), evidence("l1")), (None, evidence("l2"))]),
        (2, "Bare Traders", None, None, False, None, None, None, None, None, None, [], True, "Permanently closed", None, [evidence("m")], []),
        (3, "None Ltd", 2, 0, True, None, None, None, None, None, {}, [], False, None, None, [], []),
        (4, "Gone Ltd", 2, 5, True, None, None, "struck off", 10, DAY(2001, 1, 1), {"status": "u2"}, pages, False, None, None, [], []),
    ]
    df = spark.createDataFrame(rows, VENDOR)
    lines = findings.vendor_signals(df, ["k"], F.lit("2024-06-30").cast("date"))
    got = {(r.k, r.rule): r for r in lines.collect()}
    assert got[1, "VX-02"].text == "OASIS CORPCARE PRIVATE LIMITED is on public company-registry pages (CIN U74120MH2013PTC240744, incorporated 26 Feb 2013)."
    capital = got[1, "VX-03"]
    assert capital.text == "OASIS CORPCARE PRIVATE LIMITED quoted ₹17.70 Cr, but its paid-up capital on registry pages is ₹1.00 L: the quote is 1,770 times its capital."
    assert (capital.status, capital.observed, capital.threshold, capital.page, [e.url for e in capital.evidence]) == ("inconsistent", "quote ₹17.70 Cr vs paid-up ₹1.00 L (1,770x)", "100x", 89, ["u2"])
    legal = got[1, "VX-06"]
    assert (legal.text, legal.observed, legal.pit_ok, [e.url for e in legal.evidence]) == ("1 court or SEBI page(s) naming OASIS CORPCARE PRIVATE LIMITED turned up in search before Jun 2024: worth a closer look.", "1 matter(s)", True, ["l1"])
    assert {r for k, r in got if k == 2} == {"VX-02", "VX-05"} and got[2, "VX-05"].status == "inconsistent" and got[2, "VX-02"].evidence == []
    assert [got[3, f"VX-0{i}"].status for i in range(2, 7)] == ["unverified"] * 4 + ["consistent"] and got[3, "VX-04"].text == "Couldn't read None Ltd's registry status."
    assert got[4, "VX-04"].text == "Registry pages list Gone Ltd as 'struck off'." and [e.url for e in got[4, "VX-04"].evidence] == ["u2"] and [e.url for e in got[4, "VX-02"].evidence] == ["u1"]
    undated = {(r.k, r.rule): r for r in findings.vendor_signals(df, ["k"], F.lit(None).cast("date")).collect()}
    assert undated[1, "VX-06"].observed == "2 matter(s)" and not undated[1, "VX-06"].pit_ok
    letter = {r.k: r.letter for r in findings.letters(lines.withColumn("company", F.lit("Acme")), "k", "company", "a tool", "D.").collect()}
    assert set(letter) == {1, 2, 4} and "1. OASIS" in letter[1] and "   Offer document reference: page 89.\n   Source: u2 (t; search id n/a).\n\n2. 1 court" in letter[1]
    assert findings.vendor_signals(df.where("false"), ["k"], F.lit(None).cast("date")).count() == 0


def test_banker_and_litigation_signals(spark):
    order = lambda m, u: (m, evidence(u))
    rows = [("Bank A", 5, [order(DAY(2024, 3, 1), "a"), order(None, "b"), order(DAY(2023, 1, 1), "c")], [("Zed", [order(DAY(2024, 1, 1), "z")]), ("Ann", [order(DAY(2023, 1, 1), "n")]), ("Old", [])]), ("Bank B", None, [], []), ("Bank C", 1, [], [("One", [])])]
    kind = f"banker string, page int, own array<struct<month:date,evidence:{findings.EVIDENCE}>>, past array<struct<issuer:string,orders:array<struct<month:date,evidence:{findings.EVIDENCE}>>>>"
    got = {(r.banker, r.rule): r for r in findings.banker_signals(spark.createDataFrame(rows, kind), ["banker"], F.lit("2024-02-10").cast("date")).collect()}
    assert got["Bank A", "BK-04"].text == "A SEBI order naming Bank A turned up in search, dated Jan 2023." and [e.url for e in got["Bank A", "BK-04"].evidence] == ["c"]
    assert got["Bank A", "BK-05"].text == "SEBI orders naming past issuers of Bank A turned up in search: Ann, Zed (2 of 3 past issues)." and [e.url for e in got["Bank A", "BK-05"].evidence] == ["z", "n"]
    assert got["Bank B", "BK-05"].status == "unverified" and got["Bank B", "BK-04"].text == "No SEBI order naming Bank B turned up in search before Feb 2024." and got["Bank C", "BK-05"].text == "No SEBI order naming past issuer of Bank C turned up in search."
    cases = [("I", 3, 4, 2, [(False, DAY(2020, 1, 1), False, evidence("x")), (True, None, False, evidence("y")), (True, DAY(2020, 1, 1), True, evidence("w"))]), ("J", None, 1, 0, [])]
    kind = f"issuer string, page int, n_subjects int, n_disclosed int, matters array<struct<about_issuer:boolean,day:date,disclosed:boolean,evidence:{findings.EVIDENCE}>>"
    df = spark.createDataFrame(cases, kind)
    got = {r.issuer: r for r in findings.litigation_signals(df, ["n_subjects"], F.lit("2024-02-10").cast("date")).withColumnRenamed("subject", "issuer").collect()}
    assert got["I"].text.startswith("1 court or SEBI matter(s) naming the issuer and a promoter turned up") and got["I"].observed == "1 undisclosed of 3 found"
    assert got["J"].text == "No court or SEBI matter naming the issuer or 0 promoters turned up in search before Feb 2024 beyond the 0 the prospectus discloses."


def test_largest_quotes(spark):
    rows = [("d", 1, "Acme Ltd", 5), ("d", 2, "M/s. ACME", 9), ("d", 3, "Zed", None), ("d", 4, "zed limited", 0), ("d", 5, "Acme Pvt Ltd", 9), ("e", 1, "Acme", -3)]
    got = claims.largest_quotes(spark.createDataFrame(rows, "doc string, at int, vendor string, paise long"), "doc", ["at"], "vendor", "paise").orderBy("doc", "place").collect()
    assert [(r.doc, r.place, r.at) for r in got] == [("d", 1, 2), ("d", 2, 3), ("e", 1, 1)]


def test_screens_and_names(spark, tmp_path):
    pages = spark.createDataFrame([("a", 1, "x" * 30), ("a", 2, ""), ("a", 3, None), ("b", 13, "SME PLATFORM of an exchange, far behind"), ("c", 1, "listed on the bse\nsme board")], "doc string, page int, text string")
    assert {r.doc: r.text_share for r in sections.text_share(pages, "doc", "text").collect()} == {"a": 0.33, "b": 1.0, "c": 0.0}
    assert {r.doc: r.sme for r in sections.screened(pages, "doc", "page", "text").collect()} == {"a": False, "c": True}
    cards = spark.createDataFrame([("b",), ("a",), ("../x",), ("a",)], "name string")
    assert [r.name for r in journals.case_names(cards, "name").collect()] == ["a", "b"]
    for _ in range(2):
        journals.append_uses(spark.createDataFrame([(1, 2)], "id int, credits int"), f"{tmp_path}/uses")
    assert spark.read.parquet(f"{tmp_path}/uses").count() == 2
    urls = {"https://www.sebi.gov.in/enforcement/orders/mar-2024/x.html": True, "https://sebi.gov.in.evil.example/enforcement/orders/mar-2024/x.html": False, "https://sebi.gov.in/media/?u=/enforcement/orders/mar-2024/": False, "https://sebi.gov.in/enforcement/orders/xyz-2024/": False}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", litigation.is_order(F.col("u")).alias("x")).collect()
    assert {r.u: r.x for r in got} == urls


@pytest.mark.parametrize(
    ("text", "cites", "refusal", "refs"),
    [
        ("It stands at 10 lakh [L1].", [], "uncited", []), ("It stands at ten lakh, see line 1.", [], None, ["L1"]), ("Capital of Acme is ₹1,770.50 lakh.", [], None, ["L1"]), ("Capital of Acme is ₹1,771 lakh.", ["L1"], "numbers", ["L1"]),
        ("This is a scam.", ["L1"], "wording", ["L1"]), ("You should wait.", ["L1"], "wording", ["L1"]), ("  ", ["L1"], "wording", ["L1"]), (None, ["L1"], "no_answer", ["L1"]), ("The card doesn't say.", [], None, []), ("Seen.", [" s1", "S2", "L9", "l2", "L2"], None, ["S1", "L2"]),
        ("Call 9876543210 now, line 2.", [], None, ["L2"]), ("Of 77 it tells.", ["S1"], None, ["S1"]), ("In 2024 it was so, line 1.", [], None, ["L1"]),
    ],
)
def test_settled(spark, text, cites, refusal, refs):
    lines = [(1, "vendor", "VX", "inconsistent", "Capital of Acme is ₹1,770.50 lakh", "", "u1", ""), (2, "site", "SV", "consistent", "The place is open", "", None, "")]
    df = spark.createDataFrame([(text, cites, lines, [("h1", "it is 77")], ["a note of 2024"])], f"text string, cites array<string>, lines array<{analyst.LINE}>, hits array<struct<url:string,text:string>>, context array<string>")
    got = analyst.settled(df).first()
    assert (got.refusal, [c.ref for c in got.cited]) == (refusal, refs)
    assert got.shown is None or not re.search(r"\[L1\]|98765", got.shown)
