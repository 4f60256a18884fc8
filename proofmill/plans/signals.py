"""Findings as lines of a card (FLT-1, VX to SC rules, JN-3, JN-4, AGG-11, AGG-20, SNK-10, SNK-11, WIN-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.functions import guards
from proofmill.plans.rules import C, I, N, U, capital_status, company_status, hits_status, presence_status, registry_status

# Types of homes and shared desks, roles of workplaces, the rule that a refused search is told under.
RESIDENTIAL = ["apartment", "housing", "residential", "co-working", "coworking", "villa"]
WORKPLACES = ["factory", "warehouse"]
REFUSED_RULE = {"vendor": "VX-02", "site": "SV-02", "banker": "BK-05", "litigation": "LT-03"}
SNIPPET, TITLE = 300, 200


def evidence(engine: Column, request: Column, item: dict[str, Column], safe=lambda c: c) -> Column:
    """A search result as evidence: empty fields fall back as null ones do, long ones are cut (FLT-1)."""
    some = lambda *names: F.coalesce(*[F.nullif(item[n], F.lit("")) for n in names if n in item], F.lit(""))
    return F.struct(
        engine.alias("engine"), F.left(request, F.lit(16)).alias("request"), some("link", "website").alias("url"),
        F.left(safe(some("title")), F.lit(TITLE)).alias("title"), F.left(safe(some("snippet", "address")), F.lit(SNIPPET)).alias("snippet"),
    )


def _line(rule: str | Column, status: Column) -> Column:
    return F.struct((F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), status.alias("status"))


def _lines(rows: DataFrame, keep: list[str], lines: Column) -> DataFrame:
    return rows.select(*keep, F.posexplode(F.filter(lines, lambda x: x["rule"].isNotNull())).alias("ord", "x")).select(*keep, "ord", "x.rule", "x.status")


def vendor_lines(vendors: DataFrame, keep: list[str]) -> DataFrame:
    """keep, ord, rule, status: five lines for a registered vendor, two for a bare name. ``vendors``: registered, matched
    (array), paid, quote, state, sheet, cutoff, found, open_state, n_legal."""
    c = F.col
    place = lambda form: presence_status(c("found"), c("open_state"), F.lit(form))
    full = [
        ("VX-02", registry_status(c("matched"))), ("VX-03", capital_status(c("quote"), c("paid"))), ("VX-04", company_status(F.coalesce("state", F.lit("")), c("sheet"), c("cutoff"))),
        ("VX-05", place(True)), ("VX-06", hits_status(c("n_legal"))),
    ]
    bare = [("VX-02", F.lit(U)), ("VX-05", place(False))]
    both = [F.array(*[_line(r, s) for r, s in x]) for x in (full, bare)]
    return _lines(vendors, keep, F.when(c("registered"), both[0]).otherwise(both[1]))


def site_lines(sites: DataFrame, keep: list[str]) -> DataFrame:
    """A place's listing, and a second line for a workplace that is listed as a home (SV-02, SV-04). ``sites``: found,
    open_state, role, place_type."""
    closed = F.contains(F.lower(F.coalesce("open_state", F.lit(""))), F.lit("permanently closed"))
    kind = F.lower(F.coalesce("place_type", F.lit("")))
    home = F.exists(F.array(*map(F.lit, RESIDENTIAL)), lambda t: F.contains(kind, t))
    odd = F.col("found") & ~closed & F.col("role").isin(*WORKPLACES) & home
    return _lines(sites, keep, F.array(_line("SV-02", F.when(~F.col("found"), U).when(closed, I).otherwise(C)), _line(F.when(odd, "SV-04"), F.lit(I))))


def banker_lines(bankers: DataFrame, orders: DataFrame, issues: DataFrame, banker: str, most: int = 5) -> DataFrame:
    """Orders that name the banker (BK-04) or its first past issuers (BK-05, AGG-12). ``orders``: banker, issuer (null: the
    banker itself), month, counts (dated in time); ``issues``: banker, issuer, ord. observed: "x of n past issues"; first:
    the earliest month of an own order (SRT-5), names: of the flagged issuers, sorted (SRT-6)."""
    own = orders.where("issuer is null and counts").groupBy(banker).agg(F.count("*").alias("own"), F.min("month").alias("first"))
    place = F.row_number().over(Window.partitionBy(banker).orderBy("ord", "issuer"))
    past = issues.groupBy(banker, "issuer").agg(F.min("ord").alias("ord")).withColumn("n", place).where(F.col("n") <= most)
    flagged = past.join(orders.where("counts").select(banker, "issuer", F.lit(True).alias("hit")).distinct(), [banker, "issuer"], "left")
    seen = flagged.groupBy(banker).agg(F.count("*").alias("n_past"), F.count("hit").alias("n_hit"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("issuer")))), ", ").alias("names"))
    all_ = bankers.select(banker).join(own, banker, "left").join(seen, banker, "left").fillna({"own": 0, "n_past": 0, "n_hit": 0, "names": ""})
    past_status = F.when(F.col("n_past") == 0, U).when(F.col("n_hit") > 0, I).otherwise(C)
    observed = F.when(F.col("n_past") > 0, F.format_string("%d of %d past issues", "n_hit", "n_past")).otherwise("")
    lines = F.array(
        F.struct(F.lit("BK-04").alias("rule"), hits_status(F.col("own")).alias("status"), F.lit("").alias("observed"), F.lit("").alias("names"), F.col("first").alias("first")),
        F.struct(F.lit("BK-05").alias("rule"), past_status.alias("status"), observed.alias("observed"), F.col("names").alias("names"), F.lit(None).cast("date").alias("first")),
    )
    return all_.select(banker, F.inline(lines))


def footprint(articles: DataFrame, videos: DataFrame, issuer: str, cutoff: Column) -> DataFrame:
    """News and promotion of each issuer (AGG-11, NW-01, HY-01). ``articles``: issuer, title, day; ``videos``: issuer, title."""
    adverse = F.col("title").rlike(guards.ADVERSE)
    counts = cutoff.isNull() | F.coalesce(F.col("day") <= cutoff, F.lit(False))
    news = articles.groupBy(issuer).agg(F.count("*").alias("articles"), F.count_if(adverse).alias("adverse"), F.count_if(adverse & counts).alias("dated"))
    clips = videos.groupBy(issuer).agg(F.count("*").alias("videos"), F.count_if(F.col("title").rlike(guards.PROMO)).alias("promo"))
    both = news.join(clips, issuer, "full_outer").fillna(0)
    return both.select(issuer, "articles", "adverse", "videos", "promo", hits_status(F.col("dated")).alias("nw_01"), F.lit(N).alias("hy_01"))


def notes(cases: DataFrame, keep: list[str]) -> DataFrame:
    """Lines that say what wasn't read (SC-01, SC-02). ``cases``: n_sections, unread (parts that weren't read)."""
    nothing = F.col("n_sections") == 0
    return _lines(cases, keep, F.array(_line(F.when(nothing, "SC-01"), F.lit(U)), _line(F.when(~nothing & (F.col("unread") > 0), "SC-02"), F.lit(U))))


def isolated(lines: DataFrame, check: str, refusal: str) -> DataFrame:
    """A check whose search was refused has one unverified line in place of its own."""
    rule = F.create_map(*[F.lit(x) for kv in REFUSED_RULE.items() for x in kv])[F.col(check)]
    no = F.col(refusal).isNotNull()
    return lines.withColumn("rule", F.when(no, rule).otherwise(F.col("rule"))).withColumn("status", F.when(no, U).otherwise(F.col("status")))


def proof(sources: Column, fact: str, held: Column) -> Column:
    """Evidence from the page that stated the fact, else the first of all (JN-4). ``sources``: map of fact to URL."""
    hit = F.filter(held, lambda e: e["url"] == sources[fact])
    return F.when(F.size(hit) > 0, hit).otherwise(F.slice(held, 1, 1))


def shares(cards: DataFrame, doc: str) -> DataFrame:
    """Lines of each status in whole per cent of those shown (AGG-20). ``cards``: doc, status."""
    shown = cards.where(F.col("status") != N)
    n = F.count("*")
    return shown.groupBy(doc).agg(*[F.round(100 * F.count_if(F.col("status") == s) / n).cast("int").alias(s) for s in (C, I, U)])


def letter(lines: DataFrame, doc: str, order: str) -> DataFrame:
    """The points of a letter about what doesn't match, numbered from 1 (SNK-10, WIN-1). ``lines``: doc, order, status, text, page."""
    n = F.row_number().over(Window.partitionBy(doc).orderBy(order, "text"))
    page = F.when(F.col("page").isNotNull(), F.format_string("\n   Offer document reference: page %d.", "page")).otherwise("")
    told = lines.where(F.col("status") == I).withColumn("n", n).withColumn("point", F.concat(F.col("n").cast("string"), F.lit(". "), F.col("text"), page))
    return told.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "point"))), lambda x: x["point"]), "\n").alias("points"))
