"""Sections of long documents: contents lists, headings, page ranges, covers (STR-13, WIN-3, JN-11, JN-12, DAT-9, FLT-12, FLT-20, AGG-8, SRC-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.functions.dates import MONTHS, absolute_date
from proofmill.operators import claims
from proofmill.operators.claims import mode_latest
from proofmill.sources.stored import written

# Patterns of section titles, contents lines, page headers and covers.
TARGETS = {
    "general_information": r"^GENERAL INFORMATION$",
    "objects": r"^OBJECTS? (OF|FOR) THE (ISSUE|OFFER)$",
    "business": r"^(OUR )?BUSINESS( OVERVIEW)?$",
    "promoters": r"^OUR PROMOTERS?( AND PROMOTERS?[' ]?S? GROUPS?)?$",
    "group_companies": r"^(INFORMATION WITH RESPECT TO )?(OUR )?GROUP (COMPAN(Y|IES)|ENTIT(Y|IES))( OF OUR COMPANY)?( ?/ ?ENTITIES)?$",
    "litigation": r"^OUTSTANDING LITIGATIONS? AND MATERIAL DEV\w*$",
    "regulatory": r"^OTHER REGULATORY AND STATUTORY DISCL\w+$",
}
SECTION_PREFIX = r"^SECTION (- )?[IVXL]+ ?[-:] ?"
TOC_TITLE = r"^((TABLE( OF)? )?CONTENTS?|INDEX( OF CONTENTS?)?)$"
LEADER = r"^(.+?)\s*[._]{3,}\s*\d{0,4}$"
PLAIN = r"^([A-Z][^\d]*?[A-Z)])\s+\d{1,4}$"
PART = r"^([IVXL]+[.:]\s|SECTION\s)"
PAGE_HEADER = r"^(\d{1,4}\s*\|\s*P\s*A\s*G\s*E|PAGE\s+\d{1,4}(\s+OF\s+\d{1,4})?|\d{1,4})$"
TOP_LINES = 4
_MONTH = rf"(?:{'|'.join(MONTHS)})[a-z]*\.?"
DATED = rf"(?i)\bdated\s*:?\s*((?:{_MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}})|(?:\d{{1,2}}(?:st|nd|rd|th)?\s+{_MONTH},?\s+\d{{4}})|(?:\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}}))"
ISSUER_LINE = r"^[A-Z][A-Z0-9&.,' ()-]{2,80}\bLIMITED$"
MIXED_ISSUER_LINE = r"^[A-Z][A-Za-z0-9&.,'()-]*( [A-Za-z0-9&.,'()-]+){1,10} Limited$"
INTERMEDIARY = r"(?i)STOCK EXCHANGE|SECURITIES AND EXCHANGE|REGISTRAR|LEAD MANAGER"
BARE_SUFFIX = r"(?i)^(PRIVATE|PUBLIC)\s+LIMITED$"
SME_LISTING = r"SME PLATFORM|EMERGE PLATFORM|BSE SME|NSE EMERGE|SME EXCHANGE"
COVER_PAGES, FRONT_PAGES, SME_PAGES = 3, 8, 12
#: A contents list is looked for on so many first pages.
TOC_SEARCH_PAGES = 15


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_lines(text: Column) -> Column:
    """Lines that aren't blank, in capitals and single spaces."""
    # All lines together: spaces first, so that no pattern reads a long run of them again from each of its places.
    spaced = F.regexp_replace(F.regexp_replace(F.upper(text), r"[ \t\x0B\f]++", " "), r" ?[\r\n]\s*+", "\n")
    return F.filter(F.split(F.trim(spaced), "\n"), lambda x: x != "")


def normal(title: Column) -> Column:
    """A title as it is compared: plain dashes and apostrophes, and without the small ways in which contents and headings differ."""
    t = F.regexp_replace(F.translate(F.upper(title), "–—’", "--'"), r"\s*-\s*", " - ")
    for a, b in ((" & ", " AND "), ("LITIGATIONS", "LITIGATION"), (" OTHER MATERIAL", " MATERIAL")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.btrim(single_spaced(t), F.lit(" ."))


def target_name(title: Column) -> Column:
    """The section that a title names; null for others."""
    bare = F.regexp_replace(title, SECTION_PREFIX, "")
    out = F.lit(None).cast("string")
    for name, pattern in reversed(TARGETS.items()):
        out = F.when(bare.rlike(pattern), name).otherwise(out)
    return out


def top_lines(text: Column) -> Column:
    """The first lines of a page but for its header, normalized."""
    return _tops(clean_lines(text))


def _tops(lines: Column) -> Column:
    return F.transform(F.slice(F.filter(lines, lambda x: ~x.rlike(PAGE_HEADER)), 1, TOP_LINES), normal)


def toc_titles(lines: Column) -> Column:
    """Titles of a contents list's lines. A line in capitals without a page carries over to the next one (WIN-3)."""
    first = lambda x: F.when(x.rlike(LEADER), F.regexp_extract(x, LEADER, 1)).when(x.rlike(PLAIN), F.regexp_extract(x, PLAIN, 1))

    def step(s: Column, x: Column) -> Column:
        title = normal(F.concat_ws(" ", s["pending"], first(x)))
        carried = (F.upper(x) == x) & x.rlike("[A-Z]") & ~x.rlike(TOC_TITLE) & ~x.rlike(r"\d")
        pending = F.when(first(x).isNotNull() | x.rlike(PART), "").when(carried, F.trim(F.concat_ws(" ", s["pending"], x))).otherwise(s["pending"])
        out = F.when(first(x).isNotNull() & (title != ""), F.array_append(s["out"], title)).otherwise(s["out"])
        return F.struct(out.alias("out"), pending.alias("pending"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("pending"))
    return F.aggregate(lines, start, step, lambda s: s["out"])


def contents_pages(pages: DataFrame, doc: str, page: str, lines: str) -> DataFrame:
    """doc, toc_page of the documents that have a contents list."""
    place = F.row_number().over(Window.partitionBy(doc).orderBy(page))
    listed = F.exists(lines, lambda x: x.rlike(TOC_TITLE))
    return pages.select(doc, page, listed.alias("listed")).withColumn("place", place).where(f"listed and place <= {TOC_SEARCH_PAGES}").groupBy(doc).agg(F.min(page).alias("toc_page"))


def contents(pages: DataFrame, doc: str, page: str, lines: str) -> DataFrame:
    """doc, toc_page, ord, title of the documents' contents lists (STR-13): the first page with a contents title among the
    first of the document, and the page after it, onto which a list can spill. A document without such a page has no row;
    one whose list names nothing has one with a null title."""
    toc = contents_pages(pages, doc, page, lines)
    spread = pages.join(toc, doc).where((F.col(page) == F.col("toc_page")) | (F.col(page) == F.col("toc_page") + 1))
    titles = spread.select(doc, page, F.posexplode(toc_titles(F.col(lines))).alias("at", "title"))
    ord_ = (F.row_number().over(Window.partitionBy(doc).orderBy(page, "at")) - 1).alias("ord")
    return toc.join(titles.select(doc, ord_, "title"), doc, "left")


def section_map(pages: DataFrame, doc: str, page: str = "page", text: str = "text") -> DataFrame:
    """doc, section, title, start, end of the sections that a document's contents list and headings locate (STR-13, JN-12,
    WIN-2, WIN-3): nothing is guessed.

    Titles come from the contents list, in its order; each starts at the first page after the list, not before the one
    found last, that has it among its first lines. A title that is listed again counts where it is found last, at its
    first place in the list. A section ends a page before the next located title, whatever that names, and the last one
    with the document. Of two titles that name one section the earlier counts.
    """
    # Lines are read several times and cut out of texts once.
    read = written(pages.select(doc, page, clean_lines(F.col(text)).alias("lines")), "page-lines")
    toc = contents(read, doc, page, "lines")
    titles = toc.where("title is not null").select(doc, "ord", "title")
    after = read.join(toc.select(doc, "toc_page").distinct(), doc).where(F.col(page) > F.col("toc_page")).select(doc, page, _tops(F.col("lines")).alias("tops"))
    found = claims.section_starts(titles, after, doc, "ord", "title", page, "tops")
    once = found.groupBy(doc, "title").agg(F.min("ord").alias("ord"), F.max("start").alias("start"))
    last = read.groupBy(doc).agg(F.max(page).cast("bigint").alias("last"))
    ended = claims.section_ends(once.join(last, doc), doc, "start", "ord", "last").withColumn("section", target_name(F.col("title")))
    return claims.first_by(ended.where("section is not null"), [doc, "section"], F.col("start"), F.col("ord")).select(doc, "section", "title", "start", "end")


def section_gaps(pages: DataFrame, located: DataFrame, doc: str, page: str = "page", text: str = "text") -> DataFrame:
    """doc, toc_page (null: no list), missing (names of the sections that weren't located, in order). ``located``: of ``section_map``."""
    toc = contents_pages(pages.select(doc, page, clean_lines(F.col(text)).alias("lines")), doc, page, "lines")
    have = located.groupBy(doc).agg(F.collect_set("section").alias("have"))
    known = F.array(*[F.lit(n) for n in sorted(TARGETS)])
    every = pages.select(doc).distinct().join(toc, doc, "left").join(have, doc, "left")
    return every.select(doc, "toc_page", F.array_except(known, F.coalesce("have", F.array().cast("array<string>"))).alias("missing"))


def pages_of(sections: DataFrame, pages: DataFrame, doc: str, start: str, end: str, page: str) -> DataFrame:
    """Each section with the pages of its range (JN-11): the range is unfolded, so that the join has keys."""
    return sections.withColumn(page, F.explode(F.sequence(F.col(start), F.greatest(F.col(start), F.col(end))))).join(pages, [doc, page])


def front(pages: DataFrame, doc: str, page: str, text: str, n: int) -> DataFrame:
    """The first n pages of a document in one line of text."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, single_spaced(F.col(text)).alias("t")))), lambda x: x["t"]), " ")
    return pages.where(F.col(page) <= n).groupBy(doc).agg(joined.alias("front"))


def admission(text: Column) -> Column:
    """Why a document isn't taken; null if it is (FLT-12)."""
    t = F.lower(text)
    return F.when(F.trim(t) == "", "no_text").when(~(F.contains(t, F.lit("prospectus")) & F.contains(t, F.lit("equity shares"))), "not_a_prospectus")


def needs_ocr(text: Column) -> Column:
    """A page with hardly any text (SRC-1)."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < 30


def cover_dates(fronts: DataFrame, doc: str) -> DataFrame:
    """The date that a cover repeats most, the later one of equals (DAT-9). ``fronts``: doc, front."""
    flat = F.regexp_replace("front", r"\s+,", ",")
    found = fronts.select(doc, F.explode(F.regexp_extract_all(flat, F.lit(DATED), F.lit(1))).alias("raw")).select(doc, absolute_date(F.col("raw")).alias("day"))
    return mode_latest(found.where("day is not null"), doc, "day")


def issuer(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """The company that a cover names most often, the first of equals (AGG-8)."""
    cover = pages.where(F.col(page) <= COVER_PAGES)
    line = cover.select(doc, page, F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("line", single_spaced(F.col("line")))
    named = line.where(~F.col("line").rlike(INTERMEDIARY) & ~F.col("line").rlike(BARE_SUFFIX))
    kind = F.when(F.col("line").rlike(ISSUER_LINE), 0).when(F.col("line").rlike(MIXED_ISSUER_LINE), 1)
    candidates = named.withColumn("kind", kind).where("kind is not null").groupBy(doc, "line", "kind").agg(F.min(F.struct(page, "at")).alias("place"))
    best = candidates.join(candidates.groupBy(doc).agg(F.min("kind").alias("kind")), [doc, "kind"]).join(front(pages, doc, page, text, COVER_PAGES), doc)
    count = (F.length("front") - F.length(F.replace(F.upper("front"), F.upper("line"), F.lit("")))) / F.length("line")
    ranked = best.withColumn("n", count.cast("int"))
    return ranked.groupBy(doc).agg(F.max_by("line", F.struct("n", -F.col(f"place.{page}"), -F.col("place.at"))).alias("issuer"))


def text_share(pages: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc``, n_pages, text_share: the share of pages that have text to read, two digits, half to even (AGG-16)."""
    has = (~needs_ocr(F.col(text))).cast("int")
    return pages.groupBy(doc).agg(F.count("*").alias("n_pages"), F.bround(F.sum(has).cast("decimal(20,0)") / F.count("*"), 2).cast("double").alias("text_share"))


def screened(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """``doc``, sme: whether a document's first pages name a platform for small companies (FLT-20)."""
    return front(pages, doc, page, text, SME_PAGES).select(doc, F.upper("front").rlike(SME_LISTING).alias("sme"))
