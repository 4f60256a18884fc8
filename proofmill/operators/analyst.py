"""Answers about a card: what the card alone says, which proposed answers may be shown, and how well they do (2.13, SET-8,
SET-9, MTH-11, AGG-18, STR-21, JN-15).

A card's lines are one array of its row (a card has some dozens at most), so an answer is judged where it stands, in
expressions, after one join by card.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions import guards
from proofmill.operators import answers
from proofmill.plans.findings import MARKS

# What topics are called, words of answers.
TOPIC_NAMES = {"vendor": "the vendor", "site": "the company's premises", "banker": "the lead manager", "litigation": "court or SEBI matters", "footprint": "news coverage"}
NONE_FLAGGED = "No line on this card fails to match. Lines marked couldn't find are gaps, not findings."
NOT_COVERED = "This card doesn't cover that. It checks the vendor, the premises, the lead manager, court and SEBI matters, and news; ask about one of those, or /proof <n> for a line's source."
CITE = r"^[LS]\d{1,3}$"
UNKNOWN = r"(?i)\b(?:doesn't|does not|don't|do not|can't|cannot|couldn't|not)\b.{0,40}\b(?:show|say|cover|find|answer|know)"
VERDICT_WORDS = r"(?i)\byou should\b|\bworth (?:applying|it)\b|\bsafe to\b"
NONE_SAID = r"(?i)\bno line\b|\bnone of the lines\b|\bnothing on (?:the|this) card\b|\bno lines?\b.{0,30}doesn't match"
NUMBER = r"\d[\d,]*(?:\.\d+)?"
MAX_TEXT = 900

LINE = "struct<n:int,check:string,rule:string,status:string,text:string,observed:string,url:string,proof:string>"
_CITED = "array<struct<ref:string,about:string,url:string>>"


def cards(lines: DataFrame, card: str) -> DataFrame:
    """``card``, lines (in order) of ``lines`` (card, n, check, rule, status, text, observed, url and proof: of the first evidence)."""
    fields = [f.split(":")[0] for f in LINE.removeprefix("struct<").removesuffix(">").split(",")]
    return lines.groupBy(card).agg(F.array_sort(F.collect_list(F.struct(*fields).cast(LINE))).alias("lines"))


def from_card(asked: DataFrame, lines: DataFrame, card: str, ask: str, cues: dict[str, list[str]], flags: list[str]) -> DataFrame:
    """card, ask, text, refs: what the card alone answers. ``asked``: card, ask, question, lines (of ``cards``).

    A topic that no line is about is said to be absent; else the lines that answer are told with their marks; else that
    none is flagged, if that was asked and is so, or that the card doesn't cover it.
    """
    words, have = guards.words(F.col("question")), F.transform("lines", lambda x: x["check"])
    absent = answers.absent(answers.topics(words, cues), have)
    called = F.create_map(*[F.lit(x) for kv in TOPIC_NAMES.items() for x in kv])
    gap = F.concat(F.lit("This card has no line about "), F.array_join(F.transform(absent, lambda t: F.coalesce(called[t], t)), " or "), F.lit(": the scan found nothing it could check there."))
    flat = lines.select(card, "n", F.col("check").alias("topic"), "status", "text")
    picks = answers.picked(asked.select(card, ask, "question"), flat, card, ask, cues, flags).groupBy(card, ask).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "n"))), lambda x: x["n"]).alias("picks"))
    marks = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])

    def told(n: Column) -> Column:
        line = F.get(F.filter("lines", lambda x: x["n"] == n), F.lit(0))
        return F.concat(F.lit("line "), n.cast("string"), F.lit(", "), marks[line["status"]], F.lit(": "), line["text"])

    flagged = F.arrays_overlap(words, F.array(*map(F.lit, flags))) & ~F.exists("lines", lambda x: x["status"] == "inconsistent")
    none = F.when(flagged, NONE_FLAGGED).otherwise(NOT_COVERED)
    listed = F.concat(F.lit("From this card:\n"), F.array_join(F.transform("picks", told), "\n"))
    refs = F.transform("picks", lambda n: F.concat(F.lit("L"), n.cast("string")))
    both = asked.join(picks, [card, ask], "left")
    text = F.when(absent.isNotNull(), gap).when(F.col("picks").isNotNull(), listed).otherwise(none)
    return both.select(card, ask, text.alias("text"), F.when(absent.isNull() & F.col("picks").isNotNull(), refs).otherwise(F.array().cast("array<string>")).alias("refs"))


def resolved(refs: Column, lines: Column, hits: Column) -> Column:
    """References that exist, each once, the first MOST_CITES, with what they point at: lines of the card or search hits
    (array of struct: url, text) by number."""
    clean = F.array_distinct(F.filter(F.transform(refs, lambda r: F.upper(F.trim(r))), lambda r: r.rlike(CITE)))

    def one(r: Column) -> Column:
        n = F.substring(r, 2, 3).cast("int")
        line = F.get(F.filter(lines, lambda x: x["n"] == n), F.lit(0))
        hit = F.when(n > 0, F.get(hits, n - 1))
        told = lambda about, url: F.struct(r.alias("ref"), F.concat(F.lit(about), n.cast("string")).alias("about"), F.coalesce(url, F.lit("")).alias("url"))
        return F.when(r.startswith("L") & line.isNotNull(), told("line ", line["url"])).when(r.startswith("S") & hit.isNotNull(), told("search result ", hit["url"]))

    return F.slice(F.array_compact(F.transform(clean, one)), 1, answers.MOST_CITES).cast(_CITED)


def numbers(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double")))


def settled(replies: DataFrame) -> DataFrame:
    """``replies`` with shown (the text as it may be shown), cited and refusal (null: it may be shown).

    ``replies``: text (null: no answer), cites (array of references), lines, hits (array of struct: url, text), context
    (array of notes that any answer may quote). Refusals in this order: no_answer, wording (empty, a banned term or a
    verdict), uncited (neither a reference that exists, nor lines that hold each of its sentences, nor words that say it
    isn't known), numbers (one that neither its sources state nor counts up to ten).
    """
    shown = F.left(F.trim(answers.unmarked(guards.mask_pii(guards.plain(F.col("text"))))), F.lit(MAX_TEXT))
    read = replies.withColumn("shown", shown)
    phrases = F.regexp_extract_all("shown", F.lit(answers.LINE_PHRASE), F.lit(0))
    prose = F.flatten(F.transform(phrases, lambda p: F.transform(F.regexp_extract_all(p, F.lit(r"\d+"), F.lit(0)), lambda n: F.concat(F.lit("L"), n))))
    named = resolved(F.concat(F.coalesce("cites", F.array().cast("array<string>")), F.coalesce(prose, F.array().cast("array<string>"))), F.col("lines"), F.col("hits"))
    said = F.transform(answers.sentences(F.col("shown")), answers.terms)
    held = answers.supported(said, F.transform("lines", lambda x: F.struct(x["n"].alias("n"), answers.terms(x["text"]).alias("terms"))))
    read = read.withColumn("named", named).withColumn("cited", F.when(F.size("named") > 0, F.col("named")).otherwise(resolved(held, F.col("lines"), F.col("hits"))))

    def source(c: Column) -> Column:
        n = F.substring(c["ref"], 2, 3).cast("int")
        line = F.get(F.filter("lines", lambda x: x["n"] == n), F.lit(0))
        return F.when(c["ref"].startswith("L"), F.concat_ws(" ", line["text"], line["observed"], line["proof"])).otherwise(F.get("hits", n - 1)["text"])

    sources = F.concat_ws(" ", F.array_join("context", " "), F.array_join(F.transform("cited", source), " "))
    allowed = F.concat(numbers(sources), F.array(*[F.lit(float(n)) for n in range(11)]))
    loose = F.size(F.array_except(numbers(F.col("shown")), allowed)) > 0
    refusal = (
        F.when(F.col("text").isNull(), "no_answer")
        .when((F.col("shown") == "") | (F.size(guards.banned_terms(F.col("shown"))) > 0) | F.col("shown").rlike(VERDICT_WORDS), "wording")
        .when((F.size("cited") == 0) & ~F.col("shown").rlike(UNKNOWN), "uncited")
        .when(loose, "numbers")
    )
    return read.withColumn("refusal", refusal).drop("named")


def hit(mode: Column, text: Column, cited: Column, lines: Column, expects: Column) -> Column:
    """Whether a reply cites what was expected of it (AGG-18): ``fixed`` an answer that is always the same, ``flagged`` all
    lines that don't match (or to say that none does), else a line of that check, or to say that there is none."""
    ns = F.transform(F.filter(cited, lambda c: c["ref"].startswith("L")), lambda c: F.substring(c["ref"], 2, 3).cast("int"))
    told = F.filter(lines, lambda x: F.array_contains(ns, x["n"]))
    rules = lambda xs: F.array_distinct(F.transform(xs, lambda x: x["rule"]))
    flagged = rules(F.filter(lines, lambda x: x["status"] == "inconsistent"))
    every = F.when(F.size(flagged) > 0, F.size(F.array_except(flagged, rules(told))) == 0).otherwise(text.rlike(NONE_SAID) | (F.size(told) > 0))
    has = F.exists(lines, lambda x: x["check"] == expects)
    return (
        F.when(expects == "fixed", mode == "fixed")
        .when(expects == "flagged", every)
        .when(~has, F.contains(text, F.lit("no line about")))
        .otherwise(F.exists(told, lambda x: x["check"] == expects))
    )


def scores(replies: DataFrame, *by: str) -> DataFrame:
    """Questions, expected lines cited, replies that cite or say what is absent, clean wording, answers of the model,
    searches and credits (AGG-18). ``replies``: by, mode, text, cited, lines, expects, searches, credits."""
    c = F.col
    grounded = (F.size("cited") > 0) | (c("mode") == "fixed") | F.contains(F.lower("text"), F.lit("no line"))
    return replies.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(hit(c("mode"), c("text"), c("cited"), c("lines"), c("expects"))).alias("hits"), F.count_if(grounded).alias("grounded"),
        F.count_if(F.size(guards.banned_terms(c("text"))) == 0).alias("clean"), F.count_if(c("mode") == "agent").alias("agent"), F.sum("searches").alias("searches"), F.sum("credits").alias("credits"),
    )
