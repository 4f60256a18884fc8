"""Rows and sizes on which queries failed in round 4."""

import datetime
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F
from test_findings_r03 import same_as_sql
from test_whole import tables

from proofmill.functions import guards, names
from proofmill.operators import containment, extraction, matching, sections


@pytest.mark.parametrize("name", ["replay_stream", "replay_bundles"])
def test_bundles_of_long_event_numbers(spark, tmp_path, name):
    """An event's number may have more than six digits, and be one that a mask would take for a telephone or an identity number."""
    checked = [int(f"{n}{guards.check_digit(str(n))}") for n in (23456789012, 98765432109)]
    of_user = [int(f"{n}{guards.check_digit(f'2346{n}')}") for n in range(2000000, 2000040)]
    ids = [*range(999_990, 1_000_030), *range(9_876_543_200, 9_876_543_230), *checked, *of_user, -5, 2**62]
    rows = [(i, datetime.datetime(2024, 1, 1), u, "view", 1.0, '{"k": 1}') for u in (2346, 61234, 9_876_543_211) for i in ids]
    sf = tables(spark, tmp_path, events=(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"))
    assert len(same_as_sql(spark, sf, name, "events")) == (3 if name == "replay_stream" else 3 * len(ids))


@pytest.fixture
def words(spark):
    """Texts of pieces on which masks, cleaning and forms of letters meet."""
    r = random.Random(11)
    pieces = [" ", "\n", "\t", "\r\n", "\x0b", "\xa0", "\x1b[0m", "\x00", "​", "₹ 7", "–", "’", "é", "Ａ", "ſ", "İ", "K", "Plot 12", "a@gmail.com", "@", "98765 43210", "+91 ", "0", "2345 6789 0123", "ABCDE1234F", "x", "Limited", "Page 3", "3 | P a g e"]
    pieces += [f"{n}{guards.check_digit(n)}" for n in ("23456789012", "98765432109")]
    return [None, "", " \n "] + ["".join(r.choices(pieces, k=r.randrange(1, 9))) for _ in range(1500)]


def test_guarded_steps_change_nothing(spark, words):
    """Cleaning, masks, folding and lines give what the plain patterns give, on texts that need them and others."""
    t = F.col("t")
    old = F.regexp_replace(t, guards.UNSAFE, "")
    masked = guards.mask_aadhaar(t)
    for rule, pattern in guards.MASKS.items():
        masked = F.regexp_replace(masked, pattern, f"[{rule}]")
    line = lambda x: F.upper(F.trim(F.regexp_replace(x, r"\s+", " ")))
    lines = F.filter(F.transform(F.split(t, r"\r\n|\r|\n"), line), lambda x: x != "")
    pairs = [(guards.bare(t), old), (guards.mask_pii(t), masked), (sections.clean_lines(t), lines)]
    frame = spark.createDataFrame([(x,) for x in words], "t string")
    got = frame.select("t", names.norm(t).alias("norm"), names.nfkc(t).alias("nfkc"), *[F.struct(a.alias("a"), b.alias("b")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).collect()
    for row in got:
        assert all(row[f"p{i}"].a == row[f"p{i}"].b for i in range(len(pairs)))
        if row.t is not None:
            plain = unicodedata.normalize("NFKC", row.t)
            assert row.nfkc == plain
            assert row.norm == names.normed(row.t) == re.sub(r"[ \t\n\x0b\f\r]+", " ", plain.casefold().translate(str.maketrans("–—‘’“”", "--''\"\""))).strip(" ")


def test_pages_without_claims_are_left_alone(spark, monkeypatch):
    """extracted_claims, claim_tallies: pages on which a task finds nothing are neither masked nor sent to Python; those
    whose letters may be other forms of a rule's are."""
    pages = [(1, 1, "promoters", "The chapter goes on."), (1, 2, "promoters", "Our Promoters are Asha Rao"), (1, 3, "promoters", "ＯＵＲ Promoters are Ravi Shah"), (1, 4, "litigation", "A page"), (1, 5, "litigation", "Acme v. State of Goa, Writ Petition No. 1/2019"), (1, 6, "promoters", "our prom​oters are Ann Lee"), (1, 7, "objects", "Quotation from x"), (1, 8, "promoters", None)]
    frame = spark.createDataFrame(pages, "d int, p int, s string, t string")
    found = extraction.extracted(frame, "d", "p", "s", "t")
    assert sorted((r.page, r.name or r.party) for r in found.collect()) == [(2, "Asha Rao"), (3, "Ravi Shah"), (5, "Acme"), (6, "Ann Lee")]
    sent = F.udtf(type("All", (), {"eval": lambda self, task, text: iter([(0, *([task] * len(extraction.FIELDS)))])}), returnType=extraction.RuleClaims.returnType)
    monkeypatch.setattr(extraction, "RuleClaims", sent)
    assert sorted(r.page for r in extraction.extracted(frame, "d", "p", "s", "t").collect()) == [2, 3, 5, 6, 7]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_judged(") >= 1 and "_folded(" not in plan and plan.count("(?i)\\b(?:flat|house") == 1


@pytest.mark.parametrize("task", sorted(extraction.TASKS))
def test_no_claim_without_its_word(spark, task):
    """What rules find stands on pages that may state it, whatever the letters."""
    r = random.Random(task)
    pieces = ["Quotation from: Acme Ltd 3 5,000 ", "quotatıon from: B 1 2", "1 Acme Limited ₹ 5.00\n", "1 Acme LLP ₹ 57.00 17 February 2023\n", "Rao vs. State, Case No. 3/2020", "Rao v. X, Case No 3", "Factory: Pune", "Warehouse: A, B\n", "Lead Managers: X and Y\n", "our promoters are X, Y\n", "Our group company is Zed\n", "x", "\n", " ", "Ｌ", "K", "​", "[phone]"]
    texts = ["".join(r.choices(pieces, k=r.randrange(1, 6))) for _ in range(2000)]
    t = F.col("t")
    read = spark.createDataFrame([(x,) for x in texts], "t string").select(names.nfkc(guards.bare(t)).alias("text"), extraction.may_state(F.lit(task), t).alias("may"))
    told = [(bool([*extraction.found(task, x.text)]), x.may) for x in read.collect()]
    assert any(f for f, _ in told) and any(not m for _, m in told) and all(m for f, m in told if f)


def test_blocks_meet_where_they_lie(spark):
    """named_vendors: blocks of names aren't written again for each block that they meet."""
    keys = spark.createDataFrame([(1, f"name {i}") for i in range(40)], "g int, key string")
    found = matching.alike(keys, keys, "g", 0.99)
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.a, r.b) for r in found.collect()) == sorted((f"name {i}", f"name {i}") for i in range(40))


def test_grams_are_kept_where_they_may_tell(spark, monkeypatch):
    """named_vendors: what is stored on the way grows with texts, strings and finds, not with their grams."""
    name = F.translate(F.md5(F.col("id").cast("string")), "0123456789", "ghijklmnop")
    rows = spark.range(3000).select("id", name.alias("name"), F.concat(F.lit("The firm x"), name, F.lit("y is listed.")).alias("text"))
    stored, of = [], containment.written
    monkeypatch.setattr(containment, "written", lambda df, n, *a: (lambda d: stored.append((n, d.count())) or d)(of(df, n, *a)))
    found = containment.containing(rows, rows, "id", "text", "name")
    assert found.join(rows, ["id", "name"]).count() == found.count() == 3000
    assert all(n <= 6000 for _, n in stored) and {n for n, _ in stored} >= {"held", "near"}
