"""Queries of evidence checks: registry facts, signals and cards, sections, claims, requests, answers.

Texts that the driver's tables lack are rendered from columns in several forms and read back; the SQL tells the same from
the columns. Every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill.catalogue import query
from proofmill.functions import dates, guards, registry, requests
from proofmill.operators import answers, claims, ledger, sections
from proofmill.plans import signals

REGISTRY = ["zaubacorp.com", "tofler.in"]
LEGAL = ["indiankanoon.org", "nclt.gov.in"]


def _txt(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pages(table):
    """Three registry pages of each supplier, of which every third supplier's second lies on another site."""
    k, ord_ = F.col("s_suppkey"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ord")
    rows = table("supplier").select("s_suppkey", "s_name", "s_nationkey", ord_)
    day = F.date_add(F.lit("2001-01-01").cast("date"), (k % 3000).cast("int"))
    first = F.when(k % 2 == 0, _txt("The company was incorporated on ", F.date_format(day, "d MMMM yyyy"), ". CIN U74120MH2013PTC", F.lpad(k.cast("string"), 6, "0"), " is listed.")).otherwise("Nothing stated here.")
    second = _txt("Its authorised share capital is Rs. ", k * 1000, " and its paid up capital is Rs. ", k * 100, ".")
    third = _txt(F.when(k % 5 == 0, "Status: Strike Off. ").otherwise("Status of the company is Active. "), "Paid-up capital of INR ", k * 7, ". Registered office in Navi Mumbai, India. Main line of business is trading in parts. Balance sheet filed as on 31 March ", (k % 10 + 2010).cast("string"), ".")
    text = F.when(F.col("ord") == 0, first).when(F.col("ord") == 1, second).otherwise(third)
    host = F.when((F.col("ord") == 1) & (k % 3 == 0), "www.elsewhere.example").when(F.col("ord") == 2, "www.tofler.in").otherwise("zaubacorp.com")
    return rows.select("s_suppkey", "ord", text.alias("snippet"), _txt("https://", host, "/c/", k, "/", F.col("ord")).alias("link"))


@query("""WITH s AS (SELECT s_suppkey k, s_suppkey % 3 = 0 AS off FROM supplier)
  SELECT k AS s_suppkey, CASE WHEN k % 2 = 0 THEN 'U74120MH2013PTC' || lpad(CAST(k AS VARCHAR), 6, '0') END AS cin, CASE WHEN k % 2 = 0 THEN CAST(DATE '2001-01-01' + CAST(k % 3000 AS INT) AS DATE) END AS incorporated,
    CASE WHEN k % 5 = 0 THEN 'strike off' ELSE 'active' END AS status, CASE WHEN off THEN NULL ELSE CAST(k * 100000 AS BIGINT) END AS authorised_paise, CAST(k * CASE WHEN off THEN 700 ELSE 10000 END AS BIGINT) AS paid_up_paise,
    'trading in parts' AS business_line, CAST(CAST(k % 10 + 2010 AS VARCHAR) || '-03-31' AS DATE) AS last_balance_sheet, 'Navi Mumbai' AS city, 'https://' || CASE WHEN off THEN 'www.tofler.in' ELSE 'zaubacorp.com' END || '/c/' || k || CASE WHEN off THEN '/2' ELSE '/1' END AS paid_up_source,
    'https://' || CASE WHEN off THEN 'www.tofler.in' ELSE 'zaubacorp.com' END || '/c/' || k || CASE WHEN off THEN '/2' ELSE '/1' END AS proof, CASE WHEN off THEN 2 ELSE 3 END AS n_pages FROM s""")
def registry_facts(table):
    """Facts of registry pages, each from the first page that states it, with that page (STR-16, AGG-10, FLT-2, JN-3, JN-4)."""
    pages = _pages(table).where(guards.on_host(F.col("link"), REGISTRY))
    found = registry.facts(F.concat_ws(" ", "snippet", "link"))
    stated = pages.select("s_suppkey", "ord", "link", *[c.alias(n) for n, c in found.items()])
    first = lambda n: F.min_by(F.struct(F.col(n).alias("value"), F.col("link").alias("source")), F.when(F.col(n).isNotNull(), F.col("ord"))).alias(f"of_{n}")
    facts = stated.groupBy("s_suppkey").agg(*[first(n) for n in found], F.array_sort(F.collect_list(F.struct("ord", F.col("link").alias("url")))).alias("held"))
    proof = signals.proof(F.create_map(F.lit("paid_up_paise"), F.col("of_paid_up_paise.source")), "paid_up_paise", F.col("held"))
    names = ["cin", "incorporated", "status", "business_line", "last_balance_sheet", "city"]
    money = [F.col(f"of_{n}.value").cast("long").alias(n) for n in ("authorised_paise", "paid_up_paise")]
    return facts.select("s_suppkey", *[F.col(f"of_{n}.value").alias(n) for n in names], *money, F.col("of_paid_up_paise.source").alias("paid_up_source"), proof[0]["url"].alias("proof"), F.size("held").alias("n_pages"))


_VENDOR = """(SELECT o_orderkey k, o_orderkey % 4 <> 0 AS registered, o_orderkey % 3 <> 0 AS matched, CAST(round(o_totalprice) AS BIGINT) % 3000 AS paid, CAST(round(o_totalprice) AS BIGINT) AS quote,
  CASE o_orderkey % 7 WHEN 0 THEN 'dormant' WHEN 1 THEN 'active' ELSE 'active' END AS state, CAST(o_orderdate AS DATE) AS sheet, DATE '1996-06-30' AS cutoff, o_orderkey % 5 <> 0 AS found, CASE WHEN o_orderkey % 11 = 0 THEN 'Permanently closed' ELSE 'Open' END AS open_state, o_orderkey % 13 = 0 AS legal FROM orders)"""


@query(f"""WITH v AS (SELECT *, (year(cutoff) - year(sheet)) * 12 + month(cutoff) - month(sheet) > 18 AS stale FROM {_VENDOR}), l AS (
  SELECT k, registered, 0 AS ord, 'VX-02' AS rule, CASE WHEN registered AND matched THEN 'consistent' ELSE 'unverified' END AS status FROM v
  UNION ALL SELECT k, registered, 1, 'VX-03', CASE WHEN paid = 0 OR quote = 0 THEN 'unverified' WHEN quote / paid >= 100 THEN 'inconsistent' ELSE 'consistent' END FROM v WHERE registered
  UNION ALL SELECT k, registered, 2, 'VX-04', CASE WHEN state = 'dormant' OR stale THEN 'inconsistent' ELSE 'consistent' END FROM v WHERE registered
  UNION ALL SELECT k, registered, CASE WHEN registered THEN 3 ELSE 1 END, 'VX-05', CASE WHEN NOT found THEN 'unverified' WHEN open_state = 'Permanently closed' THEN 'inconsistent' WHEN registered THEN 'consistent' ELSE 'unverified' END FROM v
  UNION ALL SELECT k, registered, 4, 'VX-06', CASE WHEN legal THEN 'inconsistent' ELSE 'consistent' END FROM v WHERE registered)
  SELECT k AS o_orderkey, CAST(ord AS INT) AS ord, rule, status FROM l""")
def vendor_signals(table):
    """The five lines of a registered vendor, or the two of a bare name (VX-02 to VX-06, SET-1)."""
    k, price = F.col("o_orderkey"), F.round("o_totalprice").cast("long")
    rows = table("orders").select(
        "o_orderkey", (k % 4 != 0).alias("registered"), F.when(k % 3 != 0, F.array(F.lit("u"))).otherwise(F.array().cast("array<string>")).alias("matched"), (price % 3000).alias("paid"), price.alias("quote"),
        F.when(k % 7 == 0, "dormant").otherwise("active").alias("state"), F.col("o_orderdate").cast("date").alias("sheet"), F.lit("1996-06-30").cast("date").alias("cutoff"), (k % 5 != 0).alias("found"),
        F.when(k % 11 == 0, "Permanently closed").otherwise("Open").alias("open_state"), (k % 13 == 0).cast("int").alias("n_legal"),
    )
    return signals.vendor_lines(rows, ["o_orderkey"])


@query("""WITH p AS (SELECT c_custkey k, c_custkey % 6 <> 0 AS found, c_custkey % 10 = 0 AS closed, CASE c_custkey % 3 WHEN 0 THEN 'factory' WHEN 1 THEN 'registered_office' ELSE 'warehouse' END AS role, c_mktsegment = 'BUILDING' AS home FROM customer)
  SELECT k AS c_custkey, 0 AS ord, 'SV-02' AS rule, CASE WHEN NOT found THEN 'unverified' WHEN closed THEN 'inconsistent' ELSE 'consistent' END AS status FROM p
  UNION ALL SELECT k, 1, 'SV-04', 'inconsistent' FROM p WHERE found AND NOT closed AND role <> 'registered_office' AND home""")
def site_signals(table):
    """Listings of premises, and workplaces that are listed as homes (SV-02, SV-04, JSN-5)."""
    k = F.col("c_custkey")
    kind = registry.place_type(F.when(F.col("c_mktsegment") == "BUILDING", '["Building","Apartment complex"]').otherwise("Manufacturer"))
    rows = table("customer").select("c_custkey", (k % 6 != 0).alias("found"), F.when(k % 10 == 0, "Permanently Closed").alias("open_state"), F.when(k % 3 == 0, "factory").when(k % 3 == 1, "registered_office").otherwise("warehouse").alias("role"), kind.alias("place_type"))
    return signals.site_lines(rows, ["c_custkey"])


_ORDERS = "(SELECT o_custkey AS banker, o_orderpriority AS issuer, o_orderkey AS ord, o_orderkey % 9 = 0 AS own, o_orderkey % 4 = 0 AS hit, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, date_trunc('month', o_orderdate) <= DATE '1997-01-01' AS counts FROM orders)"


@query(f"""WITH b AS (SELECT c_custkey AS banker FROM customer), own AS (SELECT banker, count(*) n, min(month) m FROM {_ORDERS} WHERE own AND counts GROUP BY 1),
  past AS (SELECT banker, issuer, min(ord) ord FROM {_ORDERS} GROUP BY 1, 2), five AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY banker ORDER BY ord, issuer) r FROM past) WHERE r <= 5),
  seen AS (SELECT f.banker, count(*) n, count(*) FILTER (h.banker IS NOT NULL) h, coalesce(string_agg(f.issuer, ', ' ORDER BY f.issuer) FILTER (h.banker IS NOT NULL), '') names FROM five f LEFT JOIN (SELECT DISTINCT banker, issuer FROM {_ORDERS} WHERE NOT own AND hit AND counts) h ON h.banker = f.banker AND h.issuer = f.issuer GROUP BY 1)
  SELECT b.banker, 'BK-04' AS rule, CASE WHEN o.n > 0 THEN 'inconsistent' ELSE 'consistent' END AS status, '' AS observed, '' AS names, o.m AS first FROM b LEFT JOIN own o USING (banker)
  UNION ALL SELECT b.banker, 'BK-05', CASE WHEN s.n IS NULL THEN 'unverified' WHEN s.h > 0 THEN 'inconsistent' ELSE 'consistent' END, CASE WHEN s.n IS NULL THEN '' ELSE s.h || ' of ' || s.n || ' past issues' END, coalesce(s.names, ''), NULL FROM b LEFT JOIN seen s USING (banker)""")
def banker_signals(table):
    """Orders that name a banker or its first five distinct past issuers, dated in time (BK-04, BK-05, AGG-12, SRT-5, SRT-6)."""
    o = table("orders").withColumn("banker", F.col("o_custkey"))
    url = F.concat(F.lit("https://www.sebi.gov.in/enforcement/orders/"), F.lower(F.date_format("o_orderdate", "MMM-yyyy")), F.lit("/x.html"))
    month = dates.order_month(url)
    counts = dates.in_month(month, F.lit("1997-01-15").cast("date"))
    own = F.col("o_orderkey") % 9 == 0
    hits = o.where(own | (F.col("o_orderkey") % 4 == 0)).select("banker", F.when(~own, F.col("o_orderpriority")).alias("issuer"), month.alias("month"), counts.alias("counts"))
    issues = o.select("banker", F.col("o_orderpriority").alias("issuer"), F.col("o_orderkey").alias("ord"))
    return signals.banker_lines(table("customer").select(F.col("c_custkey").alias("banker")), hits, issues, "banker")


@query("""WITH a AS (SELECT o_custkey AS issuer, o_orderkey % 4 IN (0, 1) AS adverse, o_orderkey % 6 <> 0 AND o_orderdate < TIMESTAMP '1996-01-02' AS dated FROM orders), v AS (SELECT user_id AS issuer, event_id % 3 = 0 AS promo FROM events WHERE event_type = 'view'),
  n AS (SELECT issuer, count(*) articles, count(*) FILTER (adverse) adverse, count(*) FILTER (adverse AND dated) d FROM a GROUP BY 1), p AS (SELECT issuer, count(*) videos, count(*) FILTER (promo) promo FROM v GROUP BY 1)
  SELECT coalesce(n.issuer, p.issuer) AS issuer, coalesce(articles, 0) AS articles, coalesce(adverse, 0) AS adverse, coalesce(videos, 0) AS videos, coalesce(promo, 0) AS promo, CASE WHEN coalesce(d, 0) > 0 THEN 'inconsistent' ELSE 'consistent' END AS nw_01, 'not_applicable' AS hy_01 FROM n FULL JOIN p ON n.issuer = p.issuer""")
def footprint_signals(table):
    """Adverse news dated in time, and promotion as context (AGG-11, STR-17, NW-01, HY-01)."""
    k = F.col("o_orderkey")
    title = F.when(k % 4 == 0, "SEBI probe into listed firm").when(k % 4 == 1, "Firm barred after show-cause notice").when(k % 4 == 2, "Firm opens new plant").otherwise("A prober of markets speaks")
    day = F.when(k % 6 != 0, F.col("o_orderdate").cast("date"))
    articles = table("orders").select(F.col("o_custkey").alias("issuer"), title.alias("title"), day.alias("day"))
    promo = F.when(F.col("event_id") % 3 == 0, "IPO review: should you apply?").otherwise("Plant tour with the founder")
    videos = table("events").where("event_type = 'view'").select(F.col("user_id").alias("issuer"), promo.alias("title"))
    return signals.footprint(articles, videos, "issuer", F.lit("1996-01-01").cast("date"))


@query("""WITH c AS (SELECT doc_id k, doc_id % 5 AS n, doc_id % 3 AS u, doc_id % 4 AS w FROM documents), l AS (SELECT k, 'SC-01' AS rule, w FROM c WHERE n = 0 UNION ALL SELECT k, 'SC-02', w FROM c WHERE n > 0 AND u > 0)
  SELECT k AS doc_id, CASE WHEN w = 0 THEN 'LT-03' ELSE rule END AS rule, 'unverified' AS status FROM l""")
def scan_notes(table):
    """What wasn't read, and lines whose search was refused (SC-01, SC-02, isolation)."""
    k = F.col("doc_id")
    cases = table("documents").select("doc_id", (k % 5).alias("n_sections"), (k % 3).alias("unread"))
    params = F.when(k % 4 == 0, F.create_map(F.lit("q"), F.lit("x site:elsewhere.example"))).otherwise(F.create_map(F.lit("q"), F.lit("x")))
    lines = signals.notes(cases, ["doc_id"]).withColumn("check", F.lit("litigation")).withColumn("refusal", requests.refused(F.lit("google"), params))
    return signals.isolated(lines, "check", "refusal").select("doc_id", "rule", "status")


@query("""SELECT page_id, 'google' AS engine, '0123456789abcdef' AS request, CASE WHEN page_id % 4 = 0 THEN 'https://w.example/' || page_id ELSE url END AS url, CAST(least(200, length(url) * (page_id % 9)) AS INT) AS title_chars,
  CASE WHEN page_id % 3 = 0 THEN 'Plot 4, Pune' ELSE left(html, 300) END AS snippet FROM pages""")
def evidence_rows(table):
    """Search items as evidence: fallbacks for empty fields, cut titles and snippets (FLT-1)."""
    k = F.col("page_id")
    item = {
        "link": F.when(k % 4 == 0, "").otherwise(F.col("url")), "website": F.concat(F.lit("https://w.example/"), k.cast("string")), "title": F.repeat(F.col("url"), (k % 9).cast("int")),
        "snippet": F.when(k % 3 == 0, "").otherwise(F.col("html")), "address": F.lit("Plot 4, Pune"),
    }
    e = signals.evidence(F.lit("google"), F.lit("0123456789abcdef0123"), item)
    return table("pages").select("page_id", e.alias("e")).select("page_id", "e.engine", "e.request", "e.url", F.length("e.title").alias("title_chars"), "e.snippet")


@query(r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS public, page_id % 3 <> 0 AS name_ok FROM pages""")
def url_intake(table):
    """Which documents may be fetched and which names may stand in a path (SRC-4, FLT-18)."""
    k = F.col("page_id")
    rest = F.regexp_replace("url", "^[a-z]+://", "")
    url = F.when(k % 4 == 0, F.concat(F.lit("http://"), rest)).when(k % 4 == 1, F.concat(F.lit("https://me:pw@"), rest)).when(k % 4 == 2, F.lit("https://files.nseindia.com/x.pdf")).otherwise(F.concat(F.lit("https://"), rest))
    name = F.when(k % 3 == 0, F.concat(F.lit("../"), k.cast("string"))).otherwise(F.concat(F.lit("case-"), k.cast("string")))
    return table("pages").select("page_id", requests.public_url(url, ["nseindia.com", "bseindia.com"]).alias("public"), requests.public_id(name).alias("name_ok"))


@query("""SELECT event_id, ['engine', 'param', 'required', 'length', 'control', 'secret', 'url', 'site', 'site_tbs', NULL, NULL, NULL][CAST(event_id % 12 + 1 AS INT)] AS rule, CASE WHEN event_id % 12 = 1 THEN 'page,zoom' ELSE '' END AS unknown,
  CASE WHEN event_id % 12 = 9 THEN '{"gl":"us","hl":"en","q":"k' || event_id || '"}' WHEN event_id % 12 = 10 THEN '{"gl":"in","hl":"en","q":"site:sebi.gov.in k' || event_id || '"}' WHEN event_id % 12 = 11 THEN '{"hl":"en","place_id":"p' || event_id || '"}' END AS params FROM events""")
def query_guard(table):
    """Every rule of the request guard, defaults under the caller's values, canonical JSON (FLT-16, SET-4, JSN-4, STR-23)."""
    k = F.col("event_id")
    m = lambda *kv: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in kv])
    q = F.concat(F.lit("k"), k.cast("string"))
    cases = [
        ("bing", m("q", q)), ("google", m("q", q, "zoom", "1", "page", "2")), ("google_maps_reviews", m("hl", "en")), ("google", m("q", F.repeat(F.lit("x"), 513))),
        ("google", m("q", F.concat(F.lit("a\x07"), q))), ("google", m("q", "Bearer abc")), ("google_lens", m("url", "http://a.example/x")), ("google", m("q", "x SITE:elsewhere.example")),
        ("google", m("q", "x site:sebi.gov.in", "tbs", "qdr:y")), ("google", m("q", q, "gl", "us")), ("google", m("q", F.concat(F.lit("site:sebi.gov.in "), q))), ("google_maps_reviews", m("place_id", F.concat(F.lit("p"), k.cast("string")))),
    ]
    engine, params = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    for i, (e, p) in enumerate(cases):
        engine, params = F.when(k % 12 == i, e).otherwise(engine), F.when(k % 12 == i, p).otherwise(params)
    rows = table("events").select("event_id", engine.alias("engine"), params.alias("given"))
    rule = requests.refused(F.col("engine"), F.col("given"))
    unknown = F.when(rule == "param", F.array_join(requests.unknown(F.col("engine"), F.col("given")), ",")).otherwise("")
    return rows.select("event_id", rule.alias("rule"), unknown.alias("unknown"), F.when(rule.isNull(), guards.canonical_json(requests.merged(F.col("engine"), F.col("given")))).alias("params"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN '{"link":"https://a.example/?x=1&api_key=[redacted]#t","reviews":[{"rating":' || turn || ',"date":"2024"}],"place":{"user_reviews":{"most":[{"rating":5}]}}}'
  ELSE '{"link":"https://a.example/?x=1&api_key=[redacted]#t","reviews":[{"user":"A B","rating":' || turn || ',"date":"2024"}],"place":{"user_reviews":{"most":[{"rating":5,"user":"C"}]}}}' END AS body FROM conversations""")
def sanitized_answers(table):
    """Stored answers without keys, and without reviewers where they come from maps (FLT-17, STR-7)."""
    body = _txt('{"api_key":"zz","link":"https://a.example/?x=1&API_KEY=s3cret#t","reviews":[{"user":"A B","rating":', F.col("turn"), ',"date":"2024"}],"place":{"API_Key":1,"user_reviews":{"most":[{"rating":5,"user":"C"}]}}}')
    engine = F.when(F.col("conv_id") % 2 == 0, "google_maps_reviews").otherwise("google")
    clean = F.regexp_replace(requests.sanitized(engine, body), r"(?i)api_key=\[redacted\]", "api_key=[redacted]")
    return table("conversations").select("conv_id", "turn", clean.alias("body"))


@query("""SELECT event_id, '{"q":"https://x.example/?api_key=[redacted]","note":"call [phone] PAN [pan]","n":' || event_id || '}' AS line FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 5 = 0""")
def scrubbed_events(table):
    """Journal lines scrubbed before they leave; a line that is no JSON any more is null (JSN-1, JSN-2, SNK-8, STR-6)."""
    k = F.col("event_id")
    line = F.when(k % 5 == 0, '{"q":"bearer abc"}').otherwise(_txt('{"q":"https://x.example/?api_key=zz","note":"call 9876543210 PAN ABCDE1234F\x07","n":', k, "}"))
    return table("events").select("event_id", requests.scrub(line).alias("line"))


def _prospectus(table):
    """Ten pages of a rendered prospectus for each supplier; a third of them number their pages, a fifth lacks a section."""
    k = F.col("s_suppkey")
    toc = F.when(k % 2 == 0, "TABLE OF CONTENTS\nSECTION I - GENERAL\nGENERAL INFORMATION ......... 3\nOBJECTS OF THE ISSUE____ 5\nOUTSTANDING LITIGATIONS AND OTHER MATERIAL\nDEVELOPMENTS ......... 8").otherwise("INDEX\nGENERAL INFORMATION 3\nOBJECTS FOR THE OFFER 5\nOUTSTANDING LITIGATION & MATERIAL DEVELOPEMENT 8")
    at = (k % 3).cast("int")  # pages by which headings are shifted
    n = F.col("page")
    head = F.when(n % 2 == 0, _txt("Page ", n, " of 10\n")).otherwise("")
    objects = F.when(k % 2 == 0, "Objects  of the Issue").otherwise("Objects for the Offer")
    legal = F.when(k % 2 == 0, "Outstanding Litigation and Material Developments").otherwise("Outstanding Litigations & Other Material Developement")
    body = F.when(n == 1, _txt("MANY WAYS ", k, " LIMITED\nRED HERRING PROSPECTUS dated June 28, 2024\nREGISTRAR TO THE ISSUE LIMITED\nDraft dated 18 July 2024 for equity shares"))
    body = body.when(n == 2, toc).when(n == 3 + at, _txt(head, "General information\nx")).when((n == 5 + at) & (k % 5 != 0), _txt(head, objects, "\ny")).when(n == 8 + F.least(at, F.lit(2)), _txt(head, legal, "\nz"))
    body = body.when(n == 10, "This document of many ways limited is dated: July 18,\n2024 again").otherwise("Plain text of a page that names General Information in the middle of a long line")
    return table("supplier").select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("page")).select("s_suppkey", "page", body.alias("text"))


@query("""WITH s AS (SELECT s_suppkey k, CAST(s_suppkey % 3 AS INT) a FROM supplier), l AS (SELECT k, 0 AS ord, 'general_information' AS section, 3 + a AS start FROM s UNION ALL SELECT k, 1, 'objects', 5 + a FROM s WHERE k % 5 <> 0 UNION ALL SELECT k, 2, 'litigation', 8 + a FROM s)
  SELECT k AS s_suppkey, section, CAST(start AS BIGINT) AS start, CAST(greatest(start, coalesce(lead(start) OVER (PARTITION BY k ORDER BY start, ord) - 1, 10)) AS BIGINT) AS "end" FROM l""")
def section_starts(table):
    """Contents lists matched to headings near the top of pages, in order (STR-13, WIN-3, JN-12, WIN-2)."""
    return _sections(table).select("s_suppkey", "section", "start", "end")


def _sections(table):
    return sections.section_map(_prospectus(table), "s_suppkey")


@query("""WITH s AS (SELECT s_suppkey k, CAST(s_suppkey % 3 AS INT) a FROM supplier), l AS (SELECT k, 0 AS ord, 'general_information' AS section, 3 + a AS start FROM s UNION ALL SELECT k, 1, 'objects', 5 + a FROM s WHERE k % 5 <> 0 UNION ALL SELECT k, 2, 'litigation', 8 + a FROM s),
  r AS (SELECT k, section, start, greatest(start, coalesce(lead(start) OVER (PARTITION BY k ORDER BY start, ord) - 1, 10)) AS last FROM l) SELECT k AS s_suppkey, section, sum(last - start + 1)::BIGINT AS n_pages FROM r GROUP BY 1, 2""")
def section_pages(table):
    """The pages of each section, by a range join whose ranges are unfolded (JN-11)."""
    found = sections.pages_of(_sections(table), _prospectus(table), "s_suppkey", "start", "end", "page")
    return found.groupBy("s_suppkey", "section").agg(F.count("*").alias("n_pages"))


@query("""SELECT s_suppkey, DATE '2024-07-18' AS day, 'MANY WAYS ' || s_suppkey || ' LIMITED' AS issuer, CAST(NULL AS VARCHAR) AS refused, false AS has_ocr FROM supplier""")
def covers(table):
    """Dates and issuers of covers, admission and pages without text (DAT-9, AGG-7, AGG-8, FLT-12, SRC-1, AGG-16)."""
    p = _prospectus(table)
    moved = p.withColumn("page", F.when(F.col("page") == 10, 3).otherwise(F.col("page") + 3 * (F.col("page") > 2).cast("int")))
    fronts = sections.front(moved, "s_suppkey", "page", "text", sections.COVER_PAGES)
    refused = sections.front(p, "s_suppkey", "page", "text", sections.FRONT_PAGES).select("s_suppkey", sections.admission(F.col("front")).alias("refused"))
    ocr = p.groupBy("s_suppkey").agg((F.bround(F.avg((~sections.needs_ocr(F.col("text"))).cast("int")), 2) < 0.5).alias("has_ocr"))
    return sections.cover_dates(fronts, "s_suppkey").join(sections.issuer(p, "s_suppkey", "page", "text"), "s_suppkey").join(refused, "s_suppkey").join(ocr, "s_suppkey")


@query("""SELECT doc_id, CASE WHEN trim(text) = '' THEN 'no_text' WHEN NOT (contains(lower(text), 'license') AND contains(lower(text), 'copyright')) THEN 'other' END AS refused FROM documents WHERE false
  UNION ALL SELECT doc_id, CASE WHEN trim(text) = '' THEN 'no_text' WHEN doc_id % 3 = 0 THEN NULL ELSE 'not_a_prospectus' END FROM documents""")
def document_admission(table):
    """Documents by whether their texts say what a prospectus says (FLT-12)."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit("\nPROSPECTUS for Equity Shares"))).otherwise(F.regexp_replace("text", "(?i)prospectus", ""))
    return table("documents").select("doc_id", sections.admission(F.when(F.trim("text") == "", F.col("text")).otherwise(text)).alias("refused"))


_CLAIM = "(SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'Promoter' WHEN 1 THEN 'A. Person' ELSE NULL END name, CASE l_linenumber % 4 WHEN 2 THEN 'Total Estimated Issue Expenses' WHEN 3 THEN 'Vendor ' || l_suppkey ELSE NULL END vendor FROM lineitem)"


@query(f"SELECT l_orderkey, l_linenumber FROM {_CLAIM} WHERE l_linenumber % 4 IN (1, 3)")
def generic_claims(table):
    """Claims that name a role, or quote a row of the expenses table, go (FLT-13)."""
    n = F.col("l_linenumber") % 4
    rows = table("lineitem").select("l_orderkey", "l_linenumber", F.when(n == 0, "Promoter").when(n == 1, "A. Person").alias("name"), F.when(n == 2, "Total Estimated Issue Expenses").when(n == 3, _txt("Vendor ", F.col("l_suppkey"))).alias("vendor"))
    return rows.where(~claims.is_generic(F.col("name"), F.col("vendor"), ["promoter", "director", "the company"])).select("l_orderkey", "l_linenumber")


@query("""SELECT s_suppkey, p AS page FROM supplier, (SELECT unnest([0, 1, 2]) AS p) WHERE (p = 1 AND s_suppkey % 3 <> 0) OR p = 2""")
def grounded_rows(table):
    """Claims whose values stand on the cited page, spaces and case aside; claims without a value or a page go (FLT-14, JN-10)."""
    pages = _pages(table).select("s_suppkey", F.col("ord").alias("page"), F.concat(F.upper("snippet"), F.lit("\n"), F.when(guards.on_host(F.col("link"), REGISTRY), "LISTED  PAGE").otherwise("")).alias("text"))
    cites = pages.select("s_suppkey", "page").withColumn("a", F.when(F.col("page") == 0, F.lit(" ")).when(F.col("page") == 1, _txt("Rs. ", F.col("s_suppkey") * 100, ".")).otherwise("navi   Mumbai")).withColumn("b", F.when(F.col("page") == 1, "Listed page"))
    return claims.grounded_rows(cites, pages, ["s_suppkey", "page"], ["a", "b"], "text").select("s_suppkey", "page")


_FLAT = r"trim(regexp_replace(html, '\s+', ' ', 'g'))"


@query(rf"""SELECT page_id, substr({_FLAT}, CAST(greatest(strpos(lower({_FLAT}), '<body>') - 60, 1) AS BIGINT), 300) AS span FROM pages""")
def page_spans(table):
    """The part of a page around a value (STR-14)."""
    return table("pages").select("page_id", claims.page_span(F.col("html"), F.lit("<BODY>")).alias("span"))


@query()
def halved_texts(table):
    """Documents cut near their middle, the page marker carried over (STR-15). No SQL: tested against a fixture."""
    text = F.concat(F.lit("[[page 1]]\n"), F.col("text"))
    return table("documents").select("doc_id", claims.halves(text).alias("h")).select("doc_id", F.size("h").alias("n"), F.length(F.get("h", F.lit(0))).alias("first"), F.get("h", F.lit(1)).startswith("[[page 1]]").alias("marked"))


@query("""SELECT kind, min(k) AS l_orderkey, arg_min(n, k * 10 + n) AS l_linenumber FROM (SELECT l_shipmode kind, l_orderkey k, l_linenumber n, l_quantity q FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem)) GROUP BY kind, q""")
def first_claims(table):
    """Of claims that are equal once normalized the first one's row stays (SET-5)."""
    n = F.col("l_linenumber")
    value = F.when(n % 2 == 0, F.concat(F.lit("Qty  "), F.col("l_quantity").cast("string"))).otherwise(F.concat(F.lit("ＱＴＹ "), F.col("l_quantity").cast("string"), F.lit(" ")))
    rows = table("lineitem").select(F.col("l_returnflag").alias("kind"), "l_orderkey", "l_linenumber", value.alias("value"))
    return claims.first_claims(rows, "kind", ["value"], ["l_orderkey", "l_linenumber"]).select("kind", "l_orderkey", "l_linenumber")


@query("""WITH q AS (SELECT l_suppkey k, year(l_shipdate) y, l_orderkey * 10 + l_linenumber o, CAST(round(l_extendedprice) AS BIGINT) * 10000000 p FROM lineitem WHERE year(l_shipdate) IN (1995, 1996)),
  l AS (SELECT k, y, arg_max(p, o) p FROM q GROUP BY 1, 2), o AS (SELECT * FROM l WHERE y = 1995), n AS (SELECT * FROM l WHERE y = 1996)
  SELECT 'vendor ' || coalesce(o.k, n.k) AS key, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM o FULL JOIN n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR o.p <> n.p""")
def diff_claims(table):
    """Quotations of two versions against each other, by normalized vendor; the last of equal keys counts (JN-13, STR-29, SET-2)."""
    q = table("lineitem").select(
        _txt(F.when(F.col("l_linenumber") % 2 == 0, "M/s. Vendor ").otherwise("VENDOR  "), F.col("l_suppkey"), F.when(F.col("l_linenumber") % 3 == 0, " Private Limited").otherwise("")).alias("vendor"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.round("l_extendedprice").cast("long") * 10_000_000).alias("paise"), F.year("l_shipdate").alias("y"),
    )
    keyed = q.withColumn("key", claims.claim_key(F.lit("quote"), {"vendor": F.col("vendor"), **{n: F.lit("") for n in ("case_ref", "party", "forum", "role", "city", "locality", "name")}}))
    return claims.claim_diff(keyed.where("y = 1995"), keyed.where("y = 1996"), "paise").select("key", "kind")


@query("SELECT lang, source, CAST(sum(doc_id % 7) AS BIGINT) AS kept, CAST(sum(doc_id % 3) AS BIGINT) AS dropped, count(*) FILTER (doc_id % 11 = 0) AS failed, count(*) AS calls FROM documents GROUP BY 1, 2")
def extraction_tallies(table):
    """Claims kept and dropped, failed calls and calls, by language and source (AGG-17)."""
    k = F.col("doc_id")
    return claims.tallies(table("documents").select("lang", "source", (k % 7).alias("kept"), (k % 3).alias("dropped"), (k % 11 == 0).alias("failed")), "lang", "source")


@query("""SELECT event_id, event_id % 4 = 0 AS miss, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'fine' WHEN 2 THEN 'differs' ELSE 'missing' END AS state FROM events""")
def recalled_answers(table):
    """Answers held for requests, and their bodies by digest: fine, changed or gone (JN-2, SRC-6, SRC-7, AGG-21)."""
    e = table("events")
    body = lambda c: F.concat(F.lit("body "), c.cast("string"))
    held = e.where("event_id % 4 <> 0").select("event_id", F.sha2(body(F.col("event_id")), 256).alias("body_sha256"))
    blobs = e.where("event_id % 4 in (1, 2)").select(F.sha2(body(F.col("event_id")), 256).alias("sha256"), F.when(F.col("event_id") % 4 == 1, body(F.col("event_id"))).otherwise("other").cast("binary").alias("body"))
    found = ledger.with_bodies(ledger.recalled(e.select("event_id"), held, "event_id"), blobs)
    return found.select("event_id", "miss", F.when(~F.col("miss"), F.col("state")).alias("state"))


@query("SELECT event_id, ['ok', 'bad_key', 'quota', 'transient', 'empty', 'invalid', 'bad_key', 'quota'][CAST(event_id % 8 + 1 AS INT)] AS outcome FROM events")
def outcomes(table):
    """What HTTP status and error text mean (STR-28)."""
    k = F.col("event_id") % 8
    status = F.when(k == 1, 401).when(k == 2, 429).when(k == 3, 503).when(k == 5, 404).otherwise(200)
    error = F.when(k == 4, "Google hasn't returned any results for this query.").when(k == 6, "Invalid API key.").when(k == 7, "Your account has run out of searches.")
    return table("events").select("event_id", requests.outcome(status, error).alias("outcome"))


@query("SELECT c_nationkey, arg_max(c_custkey, struct_pack(b := CAST(round(c_acctbal) AS BIGINT), k := -c_custkey)) AS key FROM customer WHERE round(c_acctbal) > 500 AND c_custkey % 10 <> 0 GROUP BY 1")
def best_keys(table):
    """The key with the most searches left in each pool (AGG-22)."""
    keys = table("customer").select("c_nationkey", F.col("c_custkey").alias("key"), F.round("c_acctbal").cast("long").alias("left"), (F.col("c_custkey") % 10 == 0).alias("exhausted"), F.col("c_custkey").alias("ord"))
    return ledger.best_key(keys, "c_nationkey", 500)


@query("""SELECT event_type, lo AS least, md AS median, hi AS most FROM (SELECT event_type, printf('%.2f s', min(1 + value)) lo, printf('%.2f s', quantile_cont(1 + value, 0.5)) md, printf('%.2f s', max(1 + value)) hi FROM events GROUP BY 1)""")
def bench_timings(table):
    """Least, median and greatest time in readable units (AGG-19)."""
    return ledger.timings(table("events").select("event_type", (1 + F.col("value")).alias("seconds")), "event_type")


@query("""SELECT p_partkey, 'q' || left(sha256('{"pdf":"' || sha256(p_name) || '","ruleset":"1"}'), 11) AS scan FROM (SELECT *, row_number() OVER (ORDER BY sha256(p_name || '#' || p_partkey)) r FROM part) WHERE (r - 1) % 4 = 1""")
def sampled_scans(table):
    """A shard of the files in the order of their digests, with the ids of their scans (SRT-9, STR-24)."""
    files = table("part").select("p_partkey", "p_name", F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("file"))
    return ledger.sample_runs(files, "file", 4, 1).select("p_partkey", ledger.scan_id(F.sha2("p_name", 256), F.lit("1")).alias("scan"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS home, CASE c_custkey % 4 WHEN 0 THEN 'Andheri East, Mumbai ' || c_custkey WHEN 1 THEN 'Austin, TX 78701' WHEN 2 THEN 'Toronto, Canada' ELSE 'Pune' END AS area,
  CASE WHEN c_custkey % 2 = 0 THEN '"C' || c_custkey || '" site:indiankanoon.org' ELSE '"C' || c_custkey || '" site:tofler.in' END AS q, c_custkey % 4 IN (0, 3) AS accepted FROM customer""")
def place_facts(table):
    """Areas of addresses, addresses abroad, tools' queries and what they accept (STR-18, FLT-6, STR-19, FLT-15, SET-7, JN-18)."""
    k = F.col("c_custkey")
    address = F.when(k % 4 == 0, _txt("Flat 4, Tower B, Andheri East, Mumbai ", k)).when(k % 4 == 1, "12 Main St, Austin, TX 78701").when(k % 4 == 2, "1 King St, Toronto, Canada").otherwise("Pune")
    kind = F.when(k % 2 == 0, "legal").otherwise("registry")
    link = F.when(k % 4 == 0, "https://indiankanoon.org/doc/1").when(k % 4 == 3, "https://www.tofler.in/x").otherwise("https://elsewhere.example/")
    return table("customer").select("c_custkey", registry.at_home(address).alias("home"), registry.city_area(address).alias("area"), requests.query_text(kind, _txt("C", k), "site:tofler.in", "site:indiankanoon.org").alias("q"), requests.accepted(kind, link, REGISTRY, LEGAL).alias("accepted"))


@query("""SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS INT) AS n, CASE event_id % 4 WHEN 0 THEN 't' || event_id WHEN 1 THEN 'a' ELSE NULL END AS first FROM events""")
def result_lists(table):
    """Results given as one object, as a list with other things in it, or not at all (FLT-19)."""
    k = F.col("event_id")
    value = F.when(k % 4 == 0, _txt('{"title":"t', k, '"}')).when(k % 4 == 1, '[{"title":"a"},"text",{"title":"b"}]').when(k % 4 == 2, '"none"')
    found = requests.result_list(value, "struct<title:string>")
    return table("events").select("event_id", F.size(found).alias("n"), F.get(found, F.lit(0))["title"].alias("first"))


CUES = {"vendor": ["vendor", "quotation", "supplier"], "banker": ["banker", "manager", "lead"], "site": ["factory", "premises", "office"]}
FLAG_WORDS = ["why", "flag", "flagged", "wrong", "problem", "mismatch", "odd"]


def _card_lines(table):
    n = F.col("l_linenumber")
    topic = F.element_at(F.array(*map(F.lit, ["vendor", "banker", "site", "vendor"])), (n % 4 + 1).cast("int"))
    status = F.when(F.col("l_quantity") > 40, "inconsistent").when(F.col("l_quantity") < 5, "unverified").otherwise("consistent")
    return table("lineitem").select("l_orderkey", n.cast("int").alias("n"), topic.alias("topic"), status.alias("status"), _txt("Capital of vendor number ", F.col("l_suppkey"), " was read").alias("text"))


@query("""WITH l AS (SELECT l_orderkey, CAST(l_linenumber AS INT) n, ['vendor', 'banker', 'site', 'vendor'][l_linenumber % 4 + 1] topic, l_quantity > 40 AS bad, max(l_linenumber) OVER (PARTITION BY l_orderkey) last FROM lineitem),
  s AS (SELECT l_orderkey, n, CASE WHEN l_orderkey % 3 = 0 AND 2 <= last THEN CASE WHEN n = 2 THEN 1 ELSE 0 END WHEN l_orderkey % 3 = 0 THEN 0 WHEN l_orderkey % 3 = 1 THEN 3 * CAST(topic = 'vendor' AS INT) + 2 + 3 * CAST(bad AS INT) ELSE 3 * CAST(topic IN ('banker', 'site') AS INT) END AS score FROM l)
  SELECT l_orderkey, n, CAST(score AS INT) AS score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, n) r FROM s WHERE score > 0) WHERE r <= 3""")
def picked_lines(table):
    """The lines of a card that answer a question: by number, else by topic, words and flag (SRT-3, MTH-10, SET-8, STR-20)."""
    k = F.col("l_orderkey")
    question = F.when(k % 3 == 0, "What about line 2?").when(k % 3 == 1, "Why is the vendor capital flagged?").otherwise("Is the lead manager at the factory")
    asks = table("lineitem").select("l_orderkey").distinct().withColumn("ask", F.lit(1)).withColumn("question", question)
    return answers.picked(asks, _card_lines(table), "l_orderkey", "ask", CUES, FLAG_WORDS).select("l_orderkey", "n", "score", "rank")


@query("""SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'banker,site' WHEN 1 THEN 'vendor' ELSE NULL END AS absent FROM conversations""")
def absent_topics(table):
    """Topics that are asked for and that a card has no line on (SET-8)."""
    k = F.col("conv_id") % 4
    question = F.when(k == 0, "Is the office of the manager known?").when(k == 1, "Who is the supplier?").when(k == 2, "Tell me of the lead").otherwise("Anything else?")
    present = F.when(k == 2, F.array(F.lit("banker"))).otherwise(F.array(F.lit("news")))
    return table("conversations").select("conv_id", "turn", F.array_join(answers.absent(answers.topics(guards.words(question), CUES), present), ",").alias("absent"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'L2,L1' WHEN 1 THEN '' ELSE 'L1' END AS refs FROM events""")
def attributed_answers(table):
    """Answers whose sentences are each held by one line of the card (MTH-11, STR-20)."""
    k = F.col("event_id") % 3
    text = F.when(k == 0, "The banker was named in an order of September 2024. Capital stands at ten lakhs!").when(k == 1, "Capital stands at ten lakhs. Nothing else matters to anyone here.").otherwise("Capital stands at ten lakhs.")
    lines = F.array(*[F.struct(F.lit(n).alias("n"), answers.terms(F.lit(t)).alias("terms")) for n, t in ((1, "Capital stands at ten lakhs of rupees"), (2, "An order of sep 2024 named the banker"), (3, "Capital stands at ten lakhs of rupees"))])
    said = F.transform(answers.sentences(text), answers.terms)
    return table("events").select("event_id", F.array_join(answers.supported(said, lines), ",").alias("refs"))


@query("""WITH c AS (SELECT o_orderkey k FROM orders), n AS (SELECT l_orderkey k, CAST(l_linenumber AS INT) n FROM lineitem), r AS (SELECT k, unnest([1, 2, 3, 4]) AS pos FROM c),
  t AS (SELECT r.k, pos, ['L2', 'S1', 'L1', 'L3'][pos] AS ref FROM r), f AS (SELECT t.k, pos, ref, CASE WHEN ref = 'S1' THEN 'https://hit.example/' || t.k ELSE 'https://line.example/' || t.k || '/' || substr(ref, 2) END AS url FROM t WHERE ref = 'S1' OR EXISTS (SELECT 1 FROM n WHERE n.k = t.k AND n.n = CAST(substr(ref, 2) AS INT)))
  SELECT k AS o_orderkey, CAST(row_number() OVER (PARTITION BY k ORDER BY pos) AS INT) AS place, ref, url FROM f""")
def cited_sources(table):
    """References in answers and what they point at: lines of the card, search hits (STR-21, JN-15)."""
    text = F.lit("As [L2] and [S1] say, lines 1 and 3 agree with (L2).")
    refs = table("orders").select("o_orderkey", answers.citations(text).alias("refs"))
    lines = table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("n"), _txt("https://line.example/", F.col("l_orderkey"), "/", F.col("l_linenumber")).alias("url")).distinct()
    hits = table("orders").select("o_orderkey", F.lit(1).alias("n"), _txt("https://hit.example/", F.col("o_orderkey")).alias("url"))
    return answers.cited(refs, lines, hits, "o_orderkey")


@query("""SELECT conv_id, turn, ['proof', 'pdf', 'primer', 'ask'][CAST((conv_id + turn) % 4 + 1 AS INT)] AS route, 'As said, it holds.' AS text FROM conversations""")
def routed_turns(table):
    """Turns routed by the first pattern they match, marks of citations removed (STR-25, STR-26, STR-21)."""
    way = (F.col("conv_id") + F.col("turn")) % 4
    text = F.when(way == 0, "/proof 3").when(way == 1, "please read /tmp/a.pdf").when(way == 2, "What is a prospectus?").otherwise("Is it fine?")
    rules = [(r"^/proof\s+\d+$", "proof"), (r"(?i)\.pdf\b", "pdf"), (r"(?i)^what is (a|an|the)\b", "primer")]
    return table("conversations").select("conv_id", "turn", answers.routed(text, rules, "ask").alias("route"), answers.unmarked(F.lit("As said [L1, S2], it holds.")).alias("text"))


@query("""SELECT l_orderkey, CAST(round(100 * (count(*) FILTER (l_quantity BETWEEN 5 AND 40)) / count(*)) AS INT) AS consistent, CAST(round(100 * (count(*) FILTER (l_quantity > 40)) / count(*)) AS INT) AS inconsistent, CAST(round(100 * (count(*) FILTER (l_quantity < 5)) / count(*)) AS INT) AS unverified FROM lineitem GROUP BY 1""")
def card_shares(table):
    """Whole per cent of a card's lines by status (AGG-20)."""
    return signals.shares(_card_lines(table), "l_orderkey")


@query(r"""SELECT l_orderkey, string_agg(n || '. Capital of vendor number ' || l_suppkey || ' was read' || CASE WHEN l_linenumber % 2 = 0 THEN chr(10) || '   Offer document reference: page ' || l_linenumber || '.' ELSE '' END, chr(10) ORDER BY n) AS points
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'Capital of vendor number ' || l_suppkey || ' was read') n FROM lineitem WHERE l_quantity > 40) GROUP BY 1""")
def letters(table):
    """The numbered points of a letter about what doesn't match (SNK-10, SNK-11, WIN-1)."""
    return signals.letter(_card_lines(table).withColumn("page", F.when(F.col("n") % 2 == 0, F.col("n"))), "l_orderkey", "n")


@query("""SELECT user_id, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT) % 3) AS BIGINT) AS gaps, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS INT) % 3 = 0) AS closed, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS searches FROM events GROUP BY 1""")
def agent_tallies(table):
    """Gaps open and closed and searches of each run (AGG-14, AGG-18, JN-17)."""
    e = table("events").select("user_id", "event_type", (F.get_json_object("props", "$.k").cast("int") % 3).alias("n"))
    gaps = e.where("n > 0").select("user_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("gap")).groupBy("user_id").agg(F.count("*").alias("gaps"))
    rest = e.groupBy("user_id").agg(F.count_if(F.col("n") == 0).alias("closed"), F.count_if(F.col("event_type") == "click").alias("searches"))
    return rest.join(gaps, "user_id", "left").select("user_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "closed", "searches")
