"""Whole signals: what a check found, as lines with their text, evidence, thresholds and whether they hold at a point in
time (VX-02 to VX-06, SV-02, SV-04, BK-04, BK-05, LT-03, JN-4, SET-1, SNK-10). Statuses come from ``plans.rules`` alone.

A vendor's, site's, banker's or case's row becomes its lines in one expression, so lines are told next to where the row
is, without a shuffle. Evidence of a line that wasn't verified is left out; a registry line shows the page that states the
fact it rests on, else the first page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions import guards
from proofmill.functions.dates import in_month, in_time
from proofmill.functions.money import format_inr, ratio
from proofmill.plans.rules import CAPITAL_TIMES, STALE_MONTHS, STRUCK_OFF, C, I, N, U, capital_status, company_status, hits_status, presence_status
from proofmill.plans.signals import RESIDENTIAL, WORKPLACES

# Marks of statuses.
MARKS = {C: "checks out", I: "doesn't match", U: "couldn't find", N: "not applicable"}

EVIDENCE = "struct<engine:string,request:string,search_id:string,url:string,title:string,snippet:string,published:date>"
FIELDS = ["check", "rule", "subject", "status", "text", "observed", "threshold", "page", "evidence", "pit_ok"]
#: Pieces of evidence that a line of legal pages, and of the bankers' own orders, shows; lines of a letter.
MOST_LEGAL, MOST_OWN, MOST_SOURCES, SOURCE_TITLE = 3, 2, 2, 90


def _none() -> Column:
    return F.array().cast(f"array<{EVIDENCE}>")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _times(r: Column) -> Column:
    """A ratio as it is printed: 1,770 (half to even)."""
    whole = F.bround(r, 0).cast("bigint")
    return F.regexp_replace(whole.cast("string"), r"(?<=\d)(?=(?:\d{3})+$)", ",")


def _signal(check: str, rule: str, subject: Column, status: Column, text: Column, page: Column, evidence: Column, observed: Column | str = "", threshold: str = "", pit_ok: Column | bool = False) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = [lit(check), lit(rule), subject, status, text, lit(observed), lit(threshold), page.cast("int"), F.coalesce(evidence, _none()), lit(pit_ok)]
    return F.struct(*[v.alias(n) for v, n in zip(values, FIELDS, strict=True)])


def _told(rows: DataFrame, keep: list[str], lines: Column) -> DataFrame:
    return rows.select(*keep, F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("ord", "x")).select(*keep, "ord", "x.*")


def proof(sources: Column, fact: str, held: Column) -> Column:
    """Evidence of the page that stated the fact, else of the first page (JN-4)."""
    stated = F.filter(held, lambda e: e["url"] == sources[fact])
    return F.when(F.size(stated) > 0, stated).otherwise(F.slice(held, 1, 1))


def vendor_signals(vendors: DataFrame, keep: list[str], cutoff: Column) -> DataFrame:
    """keep, ord and FIELDS: five lines of a registered vendor, two of a bare trade name.

    ``vendors``: vendor, page, quote_paise, registered, cin, incorporated, status, paid_up_paise, last_balance_sheet,
    sources (map of fact to URL), registry_evidence, maps_found, open_state, city_area, maps_evidence, and legal (array of
    struct: day, evidence). Without a cutoff (null) undated legal pages count too, and no line holds at a point in time.
    """
    c, name = F.col, F.col("vendor")
    paid, quote = c("paid_up_paise"), c("quote_paise")
    shown = lambda status, held: F.when(status != U, held).otherwise(_none())
    of_registry = lambda rule, fact, status, text, observed="", threshold="": _signal("vendor", rule, name, status, text, c("page"), shown(status, proof(c("sources"), fact, c("registry_evidence"))), observed, threshold)

    details = F.concat_ws(", ", F.concat(F.lit("CIN "), F.nullif("cin", F.lit(""))), F.concat(F.lit("incorporated "), F.date_format("incorporated", "dd MMM yyyy")))
    listed = F.size("registry_evidence") > 0
    on_pages = _text(name, " is on public company-registry pages", F.when(details != "", _text(" (", details, ").")).otherwise("."))
    registry = of_registry("VX-02", "cin", F.when(listed, C).otherwise(U), F.when(listed, on_pages).otherwise(_text("Couldn't find ", name, " on company-registry pages.")))

    short = lambda x: format_inr(x, True)
    status, times = capital_status(quote, paid), _times(ratio(quote, paid))
    observed = F.when(status != U, _text("quote ", short(quote), " vs paid-up ", short(paid), " (", times, "x)")).otherwise("")
    too_large = _text(name, " quoted ", short(quote), ", but its paid-up capital on registry pages is ", short(paid), ": the quote is ", times, " times its capital.")
    in_line = _text(name, "'s paid-up capital (", short(paid), ") is in proportion to its quote.")
    words = F.when(status == I, too_large).when(status == C, in_line).otherwise(_text("Couldn't read ", name, "'s paid-up capital."))
    capital = of_registry("VX-03", "paid_up_paise", status, words, observed, f"{CAPITAL_TIMES}x")

    state, sheet = F.coalesce("status", F.lit("")), c("last_balance_sheet")
    status = company_status(state, sheet, cutoff)
    gone = state.isin(*STRUCK_OFF)
    words = (
        F.when(gone, _text("Registry pages list ", name, " as '", state, "'."))
        .when(status == I, _text(name, "'s last balance sheet on record is dated ", F.date_format(sheet, "dd MMM yyyy"), f", over {STALE_MONTHS} months before the prospectus."))
        .when(status == C, _text("Registry pages list ", name, " as active."))
        .otherwise(_text("Couldn't read ", name, "'s registry status."))
    )
    of_sheet = of_registry("VX-04", "last_balance_sheet", status, words)
    acting = F.when((status == I) & ~gone, of_sheet).otherwise(of_registry("VX-04", "status", status, words))

    where = F.when(F.coalesce("city_area", F.lit("")) != "", _text(" (", c("city_area"), ")")).otherwise("")
    closed = F.contains(F.lower(F.coalesce("open_state", F.lit(""))), F.lit("permanently closed"))

    def place(form: bool) -> Column:
        status = presence_status(c("maps_found"), c("open_state"), F.lit(form))
        there = _text(name, " has a Google Maps listing", where, "." if form else ", but a name alone doesn't confirm it is the same business.")
        words = F.when(~c("maps_found"), _text("Couldn't find ", name, " on Google Maps.")).when(closed, _text(name, "'s Google Maps listing is marked permanently closed.")).otherwise(there)
        held = F.when(c("maps_found"), c("maps_evidence")).otherwise(_none())  # shown for a bare name too, though it isn't counted
        return _signal("vendor", "VX-05", name, status, words, c("page"), held)

    hits = F.filter("legal", lambda m: in_time(m["day"], cutoff))
    n = F.size(hits)
    before = F.when(cutoff.isNull(), "").otherwise(_text(" before ", F.date_format(cutoff, "MMM yyyy")))
    words = F.when(n > 0, _text(n, " court or SEBI page(s) naming ", name, " turned up in search", before, ": worth a closer look.")).otherwise(_text("No court or SEBI page naming ", name, " turned up in search."))
    legal = _signal("vendor", "VX-06", name, hits_status(n), words, c("page"), F.transform(F.slice(hits, 1, MOST_LEGAL), lambda m: m["evidence"]), F.when(n > 0, _text(n, " matter(s)")).otherwise(""), pit_ok=cutoff.isNotNull())

    bare = _text(
        name, " has no company form in its name (no 'Private Limited', 'Limited' or 'LLP'), so it may be a proprietorship or partnership. The company registry doesn't list those, "
        "and a registered company with the same name would be a different business, so no registry or court check was made.",
    )
    unlisted = _signal("vendor", "VX-02", name, F.lit(U), bare, c("page"), _none())
    return _told(vendors, keep, F.when(c("registered"), F.array(registry, capital, acting, place(True), legal)).otherwise(F.array(unlisted, place(False))))


def site_signals(sites: DataFrame, keep: list[str]) -> DataFrame:
    """keep, ord and FIELDS: a place's listing, and a second line for a workplace that is listed as a home. ``sites``:
    issuer, role, locality, city, page, found, open_state, place_type, evidence."""
    c = F.col
    where = F.btrim(F.concat(F.coalesce("locality", F.lit("")), F.lit(", "), F.coalesce("city", F.lit(""))), F.lit(", "))
    label, kind = F.replace("role", F.lit("_"), F.lit(" ")), F.lower(F.coalesce("place_type", F.lit("")))
    closed = F.contains(F.lower(F.coalesce("open_state", F.lit(""))), F.lit("permanently closed"))
    status = F.when(~c("found"), U).when(closed, I).otherwise(C)
    listed = _text("The ", label, " (", where, ") has a Google Maps listing", F.when(kind != "", _text(" (listed as ", kind, ")")).otherwise(""), ".")
    words = F.when(~c("found"), _text("Couldn't find the ", label, " (", where, ") on Google Maps.")).when(closed, _text("The Google Maps listing for the ", label, " (", where, ") is marked permanently closed.")).otherwise(listed)
    home = F.exists(F.array(*map(F.lit, RESIDENTIAL)), lambda t: F.contains(kind, t))
    odd = (status == C) & c("role").isin(*WORKPLACES) & home
    told = _text("The prospectus describes a ", label, " at ", where, ", but Google Maps lists the place as ", kind, ": worth a closer look.")
    first = _signal("site", "SV-02", c("issuer"), status, words, c("page"), F.when(status != U, c("evidence")).otherwise(_none()))
    return _told(sites, keep, F.array(first, F.when(odd, _signal("site", "SV-04", c("issuer"), F.lit(I), told, c("page"), c("evidence")))))


def banker_signals(bankers: DataFrame, keep: list[str], cutoff: Column) -> DataFrame:
    """keep, ord and FIELDS of a banker's two lines. ``bankers``: banker, page, own (array of struct: month, evidence) and
    past (array of struct: issuer, orders as in own; each issuer once, in the order of the filing)."""
    c, name = F.col, F.col("banker")
    when = lambda x: F.filter(x, lambda h: in_month(h["month"], cutoff))
    own = when(c("own"))
    first = F.array_min(F.transform(own, lambda h: h["month"]))
    until = F.when(cutoff.isNull(), "").otherwise(_text(" before ", F.date_format(cutoff, "MMM yyyy")))
    words = F.when(F.size(own) > 0, _text("A SEBI order naming ", name, " turned up in search, dated ", F.coalesce(F.date_format(first, "MMM yyyy"), F.lit("an earlier date")), ".")).otherwise(_text("No SEBI order naming ", name, " turned up in search", until, "."))
    orders = _signal("banker", "BK-04", name, hits_status(F.size(own)), words, c("page"), F.transform(F.slice(own, 1, MOST_OWN), lambda h: h["evidence"]), pit_ok=cutoff.isNotNull())

    flagged = F.filter(F.transform("past", lambda p: F.struct(p["issuer"].alias("issuer"), when(p["orders"]).alias("orders"))), lambda p: F.size(p["orders"]) > 0)
    n, of = F.size(flagged), F.size("past")
    status = F.when(of == 0, U).when(n > 0, I).otherwise(C)
    observed = F.when(of > 0, _text(n, " of ", of, " past issues")).otherwise("")
    who = F.array_join(F.array_sort(F.transform(flagged, lambda p: p["issuer"])), ", ")
    noun = F.when(of == 1, "past issuer").otherwise(_text(of, " past issuers"))
    words = (
        F.when(of == 0, _text("Couldn't read ", name, "'s past-issues table."))
        .when(n > 0, _text("SEBI orders naming past issuers of ", name, " turned up in search: ", who, " (", observed, ")."))
        .otherwise(_text("No SEBI order naming ", noun, " of ", name, " turned up in search."))
    )
    held = F.transform(F.slice(flagged, 1, MOST_LEGAL), lambda p: p["orders"][0]["evidence"])
    past = _signal("banker", "BK-05", name, status, words, c("page"), held, observed, pit_ok=cutoff.isNotNull())
    return _told(bankers, keep, F.array(orders, past))


def litigation_signals(cases: DataFrame, keep: list[str], cutoff: Column) -> DataFrame:
    """keep, ord and FIELDS of a case's line of undisclosed matters; promoters are never named. ``cases``: issuer, page,
    n_subjects, n_disclosed, matters (array of struct: about_issuer, day, disclosed, evidence)."""
    c = F.col
    extra = F.filter("matters", lambda m: ~m["disclosed"] & in_time(m["day"], cutoff))
    n = F.size(extra)
    who = F.when(F.exists(extra, lambda m: m["about_issuer"]), "the issuer").otherwise("the issuer and a promoter")
    until = F.when(cutoff.isNull(), "").otherwise(_text(" before ", F.date_format(cutoff, "MMM yyyy")))
    found = _text(n, " court or SEBI matter(s) naming ", who, " turned up in search that the prospectus's litigation section (", c("n_disclosed"), " disclosed) doesn't list: worth a closer look.")
    nothing = _text("No court or SEBI matter naming the issuer or ", c("n_subjects") - 1, " promoters turned up in search", until, " beyond the ", c("n_disclosed"), " the prospectus discloses.")
    observed = _text(n, " undisclosed of ", F.size("matters"), " found")
    held = F.transform(F.slice(extra, 1, MOST_LEGAL), lambda m: m["evidence"])
    return _told(cases, keep, F.array(_signal("litigation", "LT-03", c("issuer"), hits_status(n), F.when(n > 0, found).otherwise(nothing), c("page"), held, observed, pit_ok=cutoff.isNotNull())))


def card_texts(lines: DataFrame, doc: str, company: str, head: str, disclaimer: str) -> DataFrame:
    """``doc``, card: the numbered lines of a card under its counts, then the lines that aren't counted (SNK-11). ``lines``:
    doc, company, ord, check, rule, status and text. ``head`` and the company stand first."""
    shown = F.filter("ls", lambda x: x["status"] != N)
    n = lambda s: F.size(F.filter(shown, lambda x: x["status"] == s)).cast("string")
    counts = F.concat(n(C), F.lit(" of "), F.size(shown).cast("string"), F.lit(" check out · "), n(I), F.lit(" don't match · "), n(U), F.lit(" couldn't find"))
    marks = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])
    told = F.transform(shown, lambda x, i: F.concat(F.format_string("%2d", i + 1), F.lit(". ["), marks[x["status"]], F.lit("] "), x["text"]))
    context = F.transform(F.filter("ls", lambda x: x["status"] == N), lambda x: F.concat(F.lit("    "), x["text"]))
    listed = lines.groupBy(doc, F.col(company).alias("company")).agg(F.array_sort(F.collect_list(F.struct("ord", "check", "rule", "status", "text"))).alias("ls"))  # the lines of one card
    top = F.array(F.concat(F.lit(f"{head} · "), "company"), counts, F.lit(""))
    return listed.select(doc, F.array_join(F.concat(top, told, context, F.array(F.lit(""), F.lit(disclaimer))), "\n").alias("card"))


def letters(lines: DataFrame, doc: str, company: str, tool: str, disclaimer: str) -> DataFrame:
    """``doc``, letter: a neutral comment on the lines that don't match, with their pages and first sources (SNK-10); none
    for a card without such lines. ``lines``: doc, company, ord and FIELDS."""
    safe = lambda t: guards.mask_pii(t, aadhaar=False)  # noqa: E731  titles lie inside arrays
    source = lambda e: _text("   Source: ", e["url"], " (", F.left(safe(e["title"]), F.lit(SOURCE_TITLE)), F.coalesce(_text(", published ", e["published"]), F.lit("")), "; search id ", F.coalesce(e["search_id"], F.lit("n/a")), ").")
    points = lines.where(F.col("status") == I)
    text = guards.mask_pii(guards.clean_text(F.col("text"))["text"])
    cited = F.transform(F.slice("evidence", 1, MOST_SOURCES), source)
    page = F.when(F.coalesce("page", F.lit(0)) != 0, F.array(_text("   Offer document reference: page ", F.col("page"), "."))).otherwise(F.array().cast("array<string>"))
    told = points.select(doc, F.col(company).alias("company"), F.struct("ord", "rule", F.concat(F.array(text), page, cited).alias("rows")).alias("p"))
    listed = told.groupBy(doc, "company").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # the lines of one card
    body = F.array_join(F.transform("ps", lambda p, i: F.array_join(F.concat(F.array(_text((i + 1), ". ", p["rows"][0])), F.slice(p["rows"], F.lit(2), F.size(p["rows"])), F.array(F.lit(""))), "\n")), "\n")
    head = _text(
        "Subject: Public comment on the offer document of ", F.col("company"), "\n\nTo the Listing Department of the SME exchange,\n\nI am a member of the public. While reading the offer document of ", F.col("company"),
        ", I compared some of its statements with publicly available sources. The points below did not match what I found. They are observations from public sources, not allegations, and I ask that they be examined.\n\n",
    )
    tail = f"\nThese points come from automated searches by {tool} and should be verified against the original documents.\n{disclaimer} This letter makes no claim of wrongdoing by any person.\n\nYours faithfully,\n[your name]\n"
    return listed.select(doc, F.concat(head, body, F.lit(tail)).alias("letter"))
