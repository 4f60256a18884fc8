"""Queries of filings: section maps, claims by rules, registry matches, gaps and second passes.

A filing is a customer's: its orders, by date, are chapters, each headed by a title that the order's priority, status and
price choose and as long as its price says; pages print what the order's columns say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.catalogue import QUERIES, SQL, query
from proofmill.functions import names, requests
from proofmill.operators import extraction, litigation, sections, vendors
from proofmill.plans import rules
from proofmill.sources import replay
from proofmill.sources.stored import shared_dir
from proofmill.streaming import journal


def _txt(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


#: Priority, title in the contents, heading on the page; the first letters of the priority choose.
_TITLES = [
    ("1", "GENERAL INFORMATION", "General  Information"),
    ("2", "OBJECTS OF THE ISSUE", "SECTION IV - Objects of the Issue"),
    ("3", "OUTSTANDING LITIGATIONS AND OTHER MATERIAL\nDEVELOPMENTS", "Outstanding Litigation & Material Developments"),
    ("4", "RISK FACTORS", "Risk factors."),
    ("5", "OUR PROMOTERS", "Our Promoters"),
]


def _chapters(table):
    """A row for each order: its place in the filing, titles, first page, number of pages; and the contents list's page."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    long_ = (F.round(F.col("o_totalprice") * 100).cast("long") % 3).cast("int") + 1
    toc = (F.col("o_custkey") % 17 + 1).cast("int")
    rows = table("orders").withColumn("i", F.row_number().over(order)).withColumn("n", long_).withColumn("toc", toc)
    first = F.col("toc") + 2 + F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = F.left("o_orderpriority", F.lit(1))
    listed, headed = F.lit("ANNEXES"), F.lit("Annexes")
    for k, a, b in _TITLES:
        listed, headed = F.when(p == k, a).otherwise(listed), F.when(p == k, b).otherwise(headed)
    # A partial order's chapter is listed as left out and has no heading of that name.
    listed = F.when(F.col("o_orderstatus") == "P", "NOTES LEFT OUT").when(p == "2", "SECTION IV - OBJECTS OF THE ISSUE").otherwise(listed)
    headed = F.when(F.col("o_orderstatus") == "P", "Notes").otherwise(headed)
    return rows.select("o_custkey", "o_orderkey", "i", "n", "toc", first.cast("int").alias("first"), listed.alias("listed"), headed.alias("headed"), "o_totalprice", "o_orderdate", "o_orderstatus")


def _filings(table):
    """o_custkey, page, text: cover pages, a contents list over two pages, chapters."""
    chapters = _chapters(table)
    entry = F.when(F.col("o_custkey") % 2 == 0, _txt(F.col("listed"), " ........ ", F.col("first"))).otherwise(_txt(F.col("listed"), " ", F.col("first")))
    of_half = lambda half: F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.struct("i", entry.alias("e"))), lambda x: half(x["i"]))), lambda x: x["e"]), "\n")
    lists = chapters.groupBy("o_custkey", "toc").agg(of_half(lambda i: i <= 6).alias("one"), of_half(lambda i: i > 6).alias("two"))
    of = lambda page, text: F.struct(page.alias("page"), text.alias("text"))
    head = of(F.col("toc"), _txt("Page ", F.col("toc"), "\nTABLE OF CONTENTS\nSECTION I - GENERAL\n", F.col("one")))
    spill = of(F.col("toc") + 1, F.col("two"))
    covers = F.transform(F.filter(F.sequence(F.lit(0), F.col("toc") - 1), lambda p: p > 0), lambda p: of(p, F.lit("A cover page of 2024 names General Information")))
    front = lists.select("o_custkey", F.inline(F.concat(F.array(head, spill), covers)))
    k = F.col("o_orderkey")
    body = _txt(
        "Our Company has appointed advisers for the purposes of this chapter.\n", "1 Works ", k, " Private Limited for plant of order ", k, " ₹ ", F.format_number("o_totalprice", 2), " dated ", F.date_format("o_orderdate", "d MMMM yyyy"),
        "\n2 Total Estimated Issue Expenses Limited ₹ 7,000.00\nRegistered Office: Plot ", k, ", Sector ", k % 90 + 10, " Estate, Pune - 411 001, India\nBook Running Lead Manager: Capital ", k % 7, " Advisors Limited and Lead Manager\n",
        "Our Promoters are Person ", k % 11, " Shah, Person ", k % 13, " Rao and Promoter\nBuilder ", k, " v. State of Goa, Writ Petition No. ", k, "/2019, before the High Court of Bombay. It is pending.",
    )
    own = chapters.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    top = F.when(F.col("j") == 0, F.concat(F.when(k % 3 == 0, _txt(F.col("first"), " | P a g e\n")).otherwise(""), F.col("headed"), F.lit("\n"))).otherwise("")
    rest = F.when(F.col("j") == 0, F.concat(top, body)).otherwise("The chapter goes on.\nIt names Risk Factors in a line of text")
    return front.unionByName(own.select("o_custkey", (F.col("first") + F.col("j")).alias("page"), rest.alias("text")))


_CHAPTERS = """ch AS (
  SELECT *, CAST(row_number() OVER w AS INT) AS i, coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + toc + 2 AS first,
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CASE left(o_orderpriority, 1) WHEN '1' THEN 'GENERAL INFORMATION' WHEN '2' THEN 'SECTION IV - OBJECTS OF THE ISSUE' WHEN '3' THEN 'OUTSTANDING LITIGATION AND MATERIAL DEVELOPMENTS' WHEN '4' THEN 'RISK FACTORS' WHEN '5' THEN 'OUR PROMOTERS' ELSE 'ANNEXES' END END AS title
  FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) % 3 + 1 AS n, o_custkey % 17 + 1 AS toc FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
), last AS (SELECT o_custkey, toc, max(first + n - 1) AS last FROM ch GROUP BY 1, 2),
-- A title that follows itself in the list is found at the page of the first of the two: runs of one title start there.
runs AS (SELECT *, title IS DISTINCT FROM lag(title) OVER (PARTITION BY o_custkey ORDER BY i) AS new FROM ch WHERE title IS NOT NULL AND toc <= 15),
located AS (SELECT o_custkey, title, min(i) AS i, max(CASE WHEN new THEN first END) AS start FROM runs GROUP BY 1, 2),
ended AS (SELECT l.*, greatest(start, coalesce(lead(start) OVER (PARTITION BY l.o_custkey ORDER BY start, i) - 1, last)) AS "end" FROM l),
named AS (SELECT *, CASE title WHEN 'GENERAL INFORMATION' THEN 'general_information' WHEN 'SECTION IV - OBJECTS OF THE ISSUE' THEN 'objects' WHEN 'OUTSTANDING LITIGATION AND MATERIAL DEVELOPMENTS' THEN 'litigation' WHEN 'OUR PROMOTERS' THEN 'promoters' END AS section FROM ended),
map AS (SELECT o_custkey, section, title, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM named WHERE section IS NOT NULL)""".replace("FROM l)", "FROM located l JOIN last USING (o_custkey))")


@query(f"WITH {_CHAPTERS} SELECT * FROM map")
def section_map(table):
    """Sections of filings from their raw pages: the contents page is found among the first 15, spills onto the next, and
    ends come from all located titles (STR-13, JN-12, WIN-2, WIN-3)."""
    return sections.section_map(_filings(table), "o_custkey")


@query(f"""WITH {_CHAPTERS} SELECT o_custkey, CAST(CASE WHEN toc <= 15 THEN toc END AS INT) AS toc_page,
  array_to_string(list_filter(['business', 'general_information', 'group_companies', 'litigation', 'objects', 'promoters', 'regulatory'], lambda x: NOT list_contains(coalesce(have, []), x)), ',') AS missing
  FROM last LEFT JOIN (SELECT o_custkey, list(section) AS have FROM map GROUP BY 1) USING (o_custkey)""")
def section_gaps(table):
    """Sections that a filing lacks, and the page of its contents list (STR-13)."""
    pages = _filings(table)
    gaps = sections.section_gaps(pages, sections.section_map(pages, "o_custkey"), "o_custkey")
    return gaps.select("o_custkey", "toc_page", F.array_join("missing", ",").alias("missing"))


def _claims(table):
    pages = _filings(table)
    read = sections.pages_of(sections.section_map(pages, "o_custkey"), pages, "o_custkey", "start", "end", "page")
    return extraction.extracted(read, "o_custkey", "page", "section", "text")


_STATED = f"""WITH {_CHAPTERS},
read AS (SELECT m.o_custkey, m.section, c.first AS page, c.* EXCLUDE (o_custkey, first) FROM map m JOIN ch c ON c.o_custkey = m.o_custkey AND c.first BETWEEN m.start AND m."end"),
stated AS (
  SELECT o_custkey, 'quotes' AS task, page, 0 AS nth, 'Works ' || o_orderkey || ' Private Limited|plant of order ' || o_orderkey || '|₹ ' || format('{{:,.2f}}', o_totalprice) || '|' || strftime(o_orderdate, '%-d %B %Y') AS claim, 'kept' AS verdict FROM read WHERE section = 'objects'
  UNION ALL SELECT o_custkey, 'quotes', page, 1, 'Total Estimated Issue Expenses Limited|₹ 7,000.00', 'generic' FROM read WHERE section = 'objects'
  UNION ALL SELECT o_custkey, 'lead_managers', page, 0, 'Capital ' || o_orderkey % 7 || ' Advisors Limited', 'kept' FROM read WHERE section = 'general_information'
  UNION ALL SELECT o_custkey, 'lead_managers', page, 1, 'Lead Manager', 'generic' FROM read WHERE section = 'general_information'
  UNION ALL SELECT o_custkey, 'places', page, 0, 'Sector ' || o_orderkey % 90 + 10 || ' Estate|Pune|registered_office', 'kept' FROM read WHERE section = 'general_information'
  UNION ALL SELECT o_custkey, 'promoters', page, 0, 'Person ' || o_orderkey % 11 || ' Shah', 'kept' FROM read WHERE section = 'promoters'
  UNION ALL SELECT o_custkey, 'promoters', page, 1, 'Person ' || o_orderkey % 13 || ' Rao', 'kept' FROM read WHERE section = 'promoters'
  UNION ALL SELECT o_custkey, 'promoters', page, 2, 'Promoter', 'generic' FROM read WHERE section = 'promoters'
  UNION ALL SELECT o_custkey, 'cases', page, 0, 'Builder ' || o_orderkey || '|High Court of Bombay|Writ Petition No. ' || o_orderkey || '/2019', 'kept' FROM read WHERE section = 'litigation'
), judged AS (
  SELECT * EXCLUDE (verdict), CASE WHEN verdict = 'kept' AND row_number() OVER (PARTITION BY o_custkey, task, verdict, claim ORDER BY page, nth) > 1 THEN 'repeated' ELSE verdict END AS verdict FROM stated)"""


@query(f'{_STATED} SELECT o_custkey, task, CAST(page AS INT) AS page, CAST(nth AS INT) AS "at", claim, verdict FROM judged')
def extracted_claims(table):
    """Typed claims that the rules find on the pages of located sections, a table function in a lateral join, with what
    becomes of each (claim source, FLT-13, FLT-14, JN-10, JN-11, SET-5)."""
    claim = F.concat_ws("|", *extraction.FIELDS)
    return _claims(table).select("o_custkey", "task", F.col("page").cast("int").alias("page"), "at", claim.alias("claim"), "verdict")


@query(f"{_STATED} SELECT task, count(*) FILTER (verdict = 'kept') AS kept, count(*) FILTER (verdict <> 'kept') AS dropped, count(DISTINCT o_custkey) AS n_filings FROM judged GROUP BY 1")
def claim_tallies(table):
    """Claims kept and dropped by task (AGG-17)."""
    kept = F.col("verdict") == "kept"
    return _claims(table).groupBy("task").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"), F.countDistinct("o_custkey").alias("n_filings"))


def _letters(c):
    """A name of 32 letters that no other row's is like."""
    return F.translate(F.md5(c.cast("string")), "0123456789", "ghijklmnop")


_MD5 = "translate(md5(CAST({} AS VARCHAR)), '0123456789', 'ghijklmnop')"


def _vendors(table):
    """Customers as vendors; every ninth is a bare trade name. Their orders are pages of searches for them: of those every
    fourth names the next customer instead, in the title, a like title or the snippet, and states a fact or two."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    vendors = table("customer").select("c_custkey", F.concat(_letters(F.col("c_custkey")), F.when(F.col("c_custkey") % 9 == 0, " Traders").otherwise(" Pvt. Ltd.")).alias("name"))
    named = _letters(F.when(k % 4 == 0, c + 1).otherwise(c))
    title = F.when(F.col("o_orderstatus") == "F", F.concat(F.upper(named), F.lit(" PRIVATE LIMITED - Registry"))).when(F.col("o_orderstatus") == "P", F.concat(F.left(named, F.lit(30)), F.lit(" Limited | Company"))).otherwise("Profile of a company")
    p, n = F.left("o_orderpriority", F.lit(1)), F.round("o_totalprice").cast("long")
    fact = F.when(p == "1", "Status: Active. ").when(p == "2", _txt("Paid-up capital is Rs. ", n, ". ")).when(p == "3", _txt("Registered office in Town ", F.when(n % 2 == 0, "North").otherwise("South"), ", India. ")).when(p == "4", _txt("Its authorised share capital is Rs. ", n, ". ")).otherwise("Nothing stated. ")
    snippet = F.concat(fact, F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("The firm x"), named, F.lit("y is listed."))).otherwise("It is listed."))
    url = _txt(F.when(k % 10 == 0, "https://elsewhere.example/").otherwise("https://www.tofler.in/"), k)
    look = F.when(n % 3 == 0, 1).otherwise(2)
    place = F.when(n % 5 == 0, "Town North").when(n % 5 == 1, "Town South")
    pages = table("orders").select(k.alias("page"), c.alias("c_custkey"), look.alias("look"), place.alias("place"), k.alias("ord"), url.alias("url"), title.alias("title"), snippet.alias("snippet"))
    return vendors, pages


@query(f"""WITH v AS (SELECT c_custkey, c_custkey % 9 <> 0 AS form, {_MD5.format("c_custkey")} || CASE WHEN c_custkey % 9 = 0 THEN ' Traders' ELSE ' Pvt. Ltd.' END AS name FROM customer),
  p AS (SELECT o_custkey AS c_custkey, o_orderkey AS ord, n % 3 = 0 AS first, CASE n % 5 WHEN 0 THEN 'Town North' WHEN 1 THEN 'Town South' END AS place, CASE WHEN pr = '1' THEN 'active' END AS status, CASE WHEN pr = '2' THEN n * 100 END AS paid,
    CASE WHEN pr = '3' THEN CASE WHEN n % 2 = 0 THEN 'Town North' ELSE 'Town South' END END AS city, CASE WHEN pr = '4' THEN n * 100 END AS auth
    FROM (SELECT *, CAST(round(o_totalprice) AS BIGINT) AS n, left(o_orderpriority, 1) AS pr FROM orders) WHERE o_orderkey % 4 <> 0 AND o_orderkey % 10 <> 0 AND o_custkey % 9 <> 0),
  f1 AS (SELECT c_custkey, arg_min(city, ord) FILTER (city IS NOT NULL) AS city, arg_min(paid, ord) FILTER (paid IS NOT NULL) AS paid, arg_min(status, ord) FILTER (status IS NOT NULL) AS status FROM p WHERE first GROUP BY 1),
  gap1 AS (SELECT c_custkey, city FROM v LEFT JOIN f1 USING (c_custkey) WHERE form AND (paid IS NULL OR status IS NULL)),
  more AS (SELECT m.* FROM gap1 g, LATERAL (SELECT * FROM p WHERE p.c_custkey = g.c_custkey AND NOT p.first AND (p.place IS NULL OR p.place = g.city)) m),
  f2 AS (SELECT c_custkey, arg_min(city, ord) FILTER (city IS NOT NULL) AS city, arg_min(paid, ord) FILTER (paid IS NOT NULL) AS paid, arg_min(status, ord) FILTER (status IS NOT NULL) AS status, arg_min(auth, ord) FILTER (auth IS NOT NULL) AS auth,
    min(ord) FILTER (paid IS NOT NULL) AS src, count(*) AS n FROM (SELECT * FROM p WHERE first UNION ALL SELECT * FROM more) GROUP BY 1)
  SELECT v.c_custkey, f2.status, CAST(f2.paid AS BIGINT) AS paid_up_paise, CAST(f2.auth AS BIGINT) AS authorised_paise, f2.city, 'https://www.tofler.in/' || f2.src AS paid_up_source, CAST(coalesce(f2.n, 0) AS INT) AS n_pages,
    g.c_custkey IS NOT NULL AS gap_first, form AND (f2.paid IS NULL OR f2.status IS NULL) AS gap, coalesce(m.n, 0) AS n_second, name || coalesce(' ' || f2.city, '') AS place_query
  FROM v LEFT JOIN f2 USING (c_custkey) LEFT JOIN gap1 g USING (c_custkey) LEFT JOIN (SELECT c_custkey, count(*) AS n FROM more GROUP BY 1) m USING (c_custkey)""")
def vendor_second_pass(table):
    """Registry facts of the pages that name a vendor; those with gaps look again where the first result points, and all
    facts are filled once more (JN-3, JN-5, JN-17, JN-18, FLT-5, AGG-10)."""
    found = vendors.vendor_facts(*_vendors(table), "c_custkey", "page", "ord")
    money = [F.col(c).cast("long").alias(c) for c in ("paid_up_paise", "authorised_paise")]
    return found.select("c_custkey", "status", *money, "city", F.col("sources")["paid_up_paise"].alias("paid_up_source"), F.coalesce(F.size("matched"), F.lit(0)).alias("n_pages"), "gap_first", "gap", "n_second", "place_query")


@query(f"""SELECT o_orderkey AS page, o_custkey + CAST(o_orderkey % 4 = 0 AS INT) AS c_custkey FROM orders WHERE o_orderkey % 4 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer) AND (o_orderstatus <> 'O' OR o_custkey % 9 <> 0)
  UNION ALL SELECT o_orderkey, c.c_custkey FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey + 1 JOIN customer d ON d.c_custkey = o.o_custkey AND d.c_nationkey = c.c_nationkey WHERE o_orderkey % 4 = 0 AND (o_orderstatus <> 'O' OR c.c_custkey % 9 <> 0)""")
def named_vendors(table):
    """Pages with the vendors of their nation that they name, in their title or as a part of their snippet (JN-5, FLT-5)."""
    who, pages = _vendors(table)
    nation = table("customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    found = vendors.named_pages(who.join(nation, "c_custkey"), pages.join(nation, "c_custkey").drop("c_custkey"), "c_custkey", "page", "nation")
    return found.select("page", "c_custkey")


_LEGAL_WORDS = ", ".join(f"'{w}'" for w in names.LEGAL)


def _norm_sql(x: str) -> str:
    """A company name as it is compared; single letters are marked, joined where they follow one another, and unmarked."""
    plain = rf"trim(regexp_replace(replace(regexp_replace(lower({x}), '^\s*m\s*/\s*s\.?\s*', ''), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
    kept = f"array_to_string(list_filter(string_split({plain}, ' '), lambda t: t <> '' AND t NOT IN ({_LEGAL_WORDS})), ' ')"
    return rf"replace(replace(replace(regexp_replace({kept}, '\b([a-z])\b', '<\1>', 'g'), '> <', ''), '<', ''), '>', '')"


#: Of each case its issuer and promoters, of whom the last is one too many to be searched for.
_CASES = [("In Limited", ["An", "T H", "Ble", "Er"]), ("M/s. E.N Pvt. Ltd.", ["La", "En", "Ou", "Que"]), ("The De LLP", ["Ion", "Es", "Es", "Ci"]), ("E R Private Limited", ["Und", "Ch", "Sch", "Te"])]


def _hits(table):
    """Documents as hits of searches for four cases: by source, for a subject by id, on a legal site or another."""
    d = F.col("doc_id")
    host = F.when(d % 5 == 0, "https://news.example/").when(d % 5 == 1, _txt("https://www.sebi.gov.in/enforcement/orders/", F.when(d % 2 == 0, "mar").otherwise("nov"), "-", d % 9 + 2015, "/")).otherwise("https://indiankanoon.org/doc/")
    subject, k = F.lit(None).cast("string"), F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 4
    for c, (issuer, people) in enumerate(_CASES):
        for i, name in enumerate([issuer, *people]):
            subject = F.when((k == c) & (d % 5 == i), name).otherwise(subject)
    title = F.split("text", "\n")[0]
    return table("documents").select("doc_id", k.alias("case"), subject.alias("subject"), F.concat(host, d.cast("string")).alias("url"), title.alias("title"), F.col("text").alias("snippet"))


def _matters(table):
    spark = table("benchmark").sparkSession
    cases = spark.createDataFrame([(c, issuer) for c, (issuer, _) in enumerate(_CASES)], "case int, issuer string")
    people = spark.createDataFrame([(c, i, name) for c, (_, names_) in enumerate(_CASES) for i, name in enumerate(names_)], "case int, at int, name string")
    refs = table("benchmark").select((F.col("item_id") % 4).cast("int").alias("case"), F.col("text").alias("case_ref"))
    return litigation.matters(_hits(table), litigation.subjects(cases, people, "case", "at"), refs, "case", "doc_id", ascii_only=True)


def _matters_sql() -> str:
    # Of names that are repeated the first counts; three of the distinct ones are searched for.
    rows = ", ".join(f"({c}, {i}, '{s}', '{issuer}')" for c, (issuer, people) in enumerate(_CASES) for i, s in enumerate([issuer, *list(dict.fromkeys(people))[:3]]))
    all_ = ", ".join(f"({c}, {i}, '{s}')" for c, (issuer, people) in enumerate(_CASES) for i, s in enumerate([issuer, *people]))
    return rf"""WITH listed AS (SELECT * FROM (VALUES {all_}) AS t(c, i, subject)), about AS (SELECT *, {_norm_sql("subject")} AS core, {_norm_sql("issuer")} AS issuer_core FROM (VALUES {rows}) AS t(c, i, subject, issuer)),
  hits AS (SELECT doc_id, CAST(regexp_extract(source, '(\d+)$', 1) AS INT) % 4 AS c, string_split(text, chr(10))[1] AS title, text, CASE WHEN doc_id % 5 = 0 THEN 'https://news.example/' WHEN doc_id % 5 = 1 THEN 'https://www.sebi.gov.in/enforcement/orders/' || CASE WHEN doc_id % 2 = 0 THEN 'mar' ELSE 'nov' END || '-' || doc_id % 9 + 2015 || '/' ELSE 'https://indiankanoon.org/doc/' END || doc_id AS url FROM documents),
  named AS (SELECT h.*, a.i = 0 AS about_issuer, a.subject FROM hits h JOIN listed l ON l.c = h.c AND l.i = h.doc_id % 5 JOIN about a ON a.c = h.c AND a.subject = l.subject
    WHERE h.doc_id % 5 <> 0 AND contains({_norm_sql("title")}, core) AND (a.i = 0 OR contains({_norm_sql("title || ' ' || text || ' ' || url")}, issuer_core))),
  refs AS (SELECT DISTINCT item_id % 4 AS c, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS ref FROM benchmark WHERE trim(text) <> ''),
  told AS (SELECT DISTINCT doc_id FROM named n JOIN refs r ON r.c = n.c AND contains(regexp_replace(lower(title || ' ' || text || ' ' || url), '[^a-z0-9]+', '', 'g'), ref)),
  matters AS (SELECT CAST(n.c AS INT) AS "case", n.doc_id, subject, about_issuer, CASE WHEN n.doc_id % 5 = 1 THEN make_date(n.doc_id % 9 + 2015, CASE WHEN n.doc_id % 2 = 0 THEN 3 ELSE 11 END, 1) END AS day, t.doc_id IS NOT NULL AS disclosed FROM named n LEFT JOIN told t USING (doc_id))"""


@query(f"{_matters_sql()} SELECT * FROM matters")
def litigation_matters(table):
    """Hits on legal sites that name a case's issuer or promoters, with what the case's references disclose: squashed texts
    meet squashed references by grams (JN-8, JN-9, DAT-7, SRT-4)."""
    return _matters(table)


@query(f"""{_matters_sql()} SELECT "case", count(*) FILTER (NOT disclosed AND day <= DATE '2020-06-30') AS undisclosed, CASE WHEN count(*) FILTER (NOT disclosed AND day <= DATE '2020-06-30') > 0 THEN 'inconsistent' ELSE 'consistent' END AS status FROM matters GROUP BY 1""")
def litigation_status(table):
    """Undisclosed matters up to a cutoff by case (JN-9, LT-03, FLT-9)."""
    found = _matters(table)
    left = F.coalesce(litigation.is_undisclosed(F.lit("2020-06-30").cast("date")), F.lit(False))
    counted = found.groupBy("case").agg(F.count_if(left).alias("undisclosed"))
    return counted.withColumn("status", rules.hits_status(F.col("undisclosed")))


def streamed(sql: str):
    """Registers a query that reads the events table as a stream."""

    def put(f):
        def run(spark, sf_dir):
            path = f"{sf_dir}/events.parquet"
            return journal.drained(f(journal.read(spark, f"{sf_dir}/events*.parquet", spark.read.parquet(path)), lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__], SQL[f.__name__] = run, sql
        return f

    return put


@streamed("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  r AS (SELECT user_id, event_id, i, [t] AS held, true AS allowed FROM e WHERE i = 1
    UNION ALL SELECT user_id, event_id, i, CASE WHEN len(k) < 3 THEN list_append(k, t) ELSE k END, len(k) < 3
    FROM (SELECT e.user_id, e.event_id, e.i, e.t, list_filter(r.held, lambda h: e.t - h < 43200000000) AS k FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
  SELECT user_id, event_id, allowed FROM r""")
def stream_limiter(events, table):
    """Requests on a stream, three of a client in any twelve hours, with state that expires (STM-3)."""
    return journal.limited(events, "user_id", "ts", 3, 43_200, "3650 days")


@streamed("""WITH RECURSIVE e AS (SELECT event_type || user_id AS k, event_id, epoch_us(ts) AS t, user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS held FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, event_id) AS i FROM e WHERE NOT held),
  r AS (SELECT k, event_id, i, t + 86400000000 AS until, 'fetch' AS outcome FROM n WHERE i = 1
    UNION ALL SELECT n.k, n.event_id, n.i, CASE WHEN n.t <= r.until THEN r.until ELSE n.t + 86400000000 END, CASE WHEN n.t <= r.until THEN 'missing' ELSE 'fetch' END FROM r JOIN n ON n.k = r.k AND n.i = r.i + 1)
  SELECT k, event_id, outcome FROM r UNION ALL SELECT k, event_id, 'hit' FROM e WHERE held""")
def stream_lookups(events, table):
    """Requests on a stream against a table of answers, with a cache of what it lacks that lasts a day (STM-4)."""
    held = table("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    answers = table("events").join(held, "user_id", "left_semi").select(F.concat("event_type", F.col("user_id").cast("string")).alias("k")).distinct()
    return journal.looked_up(events.withColumn("k", F.concat("event_type", F.col("user_id").cast("string"))), answers, "k", "ts", 86_400, "3650 days")


@query("""SELECT conv_id, turn, text || ' call [phone]' AS told, 'PAN [pan] of ' || left(role, 3) AS deep, role AS own, CAST(turn AS BIGINT) AS n, 'https://x.example/?api_key=[redacted]' AS url FROM conversations""")
def scrubbed_values(table):
    """Turns as nested JSON whose strings are scrubbed one by one, keys untouched (JSN-1)."""
    t = F.struct(F.concat("text", F.lit(" call 9876543210")).alias("told"), F.array(F.lit("x"), F.concat(F.lit("PAN ABCDE1234F of "), F.left("role", F.lit(3)))).alias("list"), F.col("turn").alias("n"), F.lit("https://x.example/?api_key=zz9").alias("url"))
    line = F.to_json(F.struct(F.struct(t.alias("ABCDE1234F")).alias("deep"), "role"))
    at = lambda p: F.get_json_object("line", p)
    lines = table("conversations").select("conv_id", "turn", requests.scrub_values(line).alias("line"))
    return lines.select("conv_id", "turn", at("$.deep.ABCDE1234F.told").alias("told"), at("$.deep.ABCDE1234F.list[1]").alias("deep"), at("$.role").alias("own"), at("$.deep.ABCDE1234F.n").cast("long").alias("n"), at("$.deep.ABCDE1234F.url").alias("url"))


#: An event's number in letters, whatever its length: digits may be masked as those of a telephone or an identity number.
_LETTERED = ("-0123456789", "kabcdefghij")


def _bundles(table):
    """The events of each user as a case's bundle in the shared folder; some lines break a rule."""
    e = table("events")
    k = F.col("event_id")
    scan = _txt("s", F.col("user_id"))
    type_ = F.when(k % 13 != 0, F.col("event_type"))
    id_ = F.concat(F.when(k % 17 == 0, F.lit("other")).otherwise(scan), F.lit("-"), F.translate(k.cast("string"), *_LETTERED))
    data = F.when(k % 19 == 0, F.concat(F.lit('{"note":"'), F.repeat(F.lit("long "), 1000), F.lit('"}'))).otherwise(F.col("props"))
    events = e.select(_txt("case-", F.col("user_id")).alias("case"), F.lit(1).alias("v"), id_.alias("id"), F.lit(None).cast("string").alias("parent"), scan.alias("scan"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_ns"), type_.alias("type"), data.alias("data"))
    cards = e.select("user_id").distinct().where("user_id % 5 <> 0").select(_txt("case-", F.col("user_id")).alias("case"), F.lit('{"lines":[]}').alias("card"))
    home = f"{shared_dir(e.sparkSession)}/bundles-{uuid.uuid4().hex}"
    replay.write_bundles(events, cards, "case", home)
    return e.sparkSession, f"{home}/events"


_RULES = "CASE WHEN event_id % 19 = 0 THEN 'size' WHEN event_id % 13 = 0 THEN 'schema' WHEN event_id % 17 = 0 THEN 'id' END"


@query(f"SELECT 'case-' || user_id AS \"case\", event_id, {_RULES} AS rule, CASE WHEN {_RULES} IS NULL THEN event_type END AS type FROM events WHERE user_id % 5 <> 0")
def replay_bundles(table):
    """Events of written bundles, with the rule that a line breaks (SRC-8, SNK-8)."""
    read = replay.read_bundles(*_bundles(table))
    event = F.translate(F.regexp_extract("line", r'"id":"[^"]*-([a-k]+)"', 1), *reversed(_LETTERED)).cast("long")
    return read.select("case", event.alias("event_id"), "rule", F.when(F.col("rule").isNull(), F.col("type")).alias("type"))


@query(f"SELECT 'case-' || user_id AS \"case\", count(*) AS n, count(*) FILTER ({_RULES} IS NOT NULL) AS refused FROM events WHERE user_id % 5 <> 0 GROUP BY 1")
def replay_stream(table):
    """The same bundles read as a stream: lines and refused lines of each case (SRC-8)."""
    read = journal.drained(replay.stream_bundles(*_bundles(table)))
    return read.groupBy("case").agg(F.count("*").alias("n"), F.count_if(F.col("rule").isNotNull()).alias("refused"))


_NAMES = [("1", "ALPHA WORKS LIMITED"), ("2", "Beta  Industries Limited"), ("3", "REGISTRAR TO THE ISSUE LIMITED"), ("4", "PRIVATE LIMITED"), ("5", "GAMMA & SONS (INDIA) LIMITED")]


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey, o_orderkey % 3 + 1 AS page, left(o_orderpriority, 1) AS p, o_orderstatus AS s, CAST(date_trunc('year', o_orderdate) + INTERVAL 1 MONTH * (o_orderkey % 2) AS DATE) AS day FROM orders),
  named AS (SELECT k, CASE p WHEN '1' THEN 'ALPHA WORKS LIMITED' WHEN '2' THEN 'Beta Industries Limited' ELSE 'GAMMA & SONS (INDIA) LIMITED' END AS line, CASE WHEN p = '2' THEN 1 ELSE 0 END AS kind, count(*) AS n, min(struct_pack(page := page, o := o_orderkey)) AS place FROM o WHERE p IN ('1', '2', '5') GROUP BY 1, 2, 3),
  issuer AS (SELECT k, line AS issuer FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY kind, n DESC, place) AS r FROM named) WHERE r = 1),
  dated AS (SELECT k, day FROM (SELECT k, day, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, day DESC) AS r FROM o GROUP BY 1, 2) WHERE r = 1)
  SELECT k AS o_custkey, issuer, dated.day, CASE WHEN NOT (bool_or(s = 'F') AND bool_or(s = 'O')) THEN 'not_a_prospectus' END AS refused FROM o LEFT JOIN issuer USING (k) JOIN dated USING (k) GROUP BY 1, 2, 3""")
def filing_covers(table):
    """Issuers and dates that covers print, among other names and dates, and which are no prospectuses (DAT-9, AGG-7, AGG-8, FLT-12)."""
    k, p = F.col("o_orderkey"), F.left("o_orderpriority", F.lit(1))
    name = F.lit(None).cast("string")
    for n, told in _NAMES:
        name = F.when(p == n, told).otherwise(name)
    day = F.add_months(F.trunc(F.col("o_orderdate").cast("date"), "year"), (k % 2).cast("int"))
    kind = F.when(F.col("o_orderstatus") == "F", "A Prospectus").when(F.col("o_orderstatus") == "O", "of Equity Shares").otherwise("more")
    line = F.concat(name, F.lit("\n"), kind, F.lit(", dated : "), F.date_format(day, "MMMM d, yyyy"))
    orders = table("orders").select("o_custkey", (k % 3 + 1).cast("int").alias("page"), F.struct("o_orderkey", line.alias("line")).alias("x"))
    pages = orders.groupBy("o_custkey", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))
    fronts = sections.front(pages, "o_custkey", "page", "text", sections.COVER_PAGES)
    refused = sections.front(pages, "o_custkey", "page", "text", sections.FRONT_PAGES).select("o_custkey", sections.admission(F.col("front")).alias("refused"))
    return refused.join(sections.issuer(pages, "o_custkey", "page", "text"), "o_custkey", "left").join(sections.cover_dates(fronts, "o_custkey"), "o_custkey").select("o_custkey", "issuer", "day", "refused")


@query("""SELECT event_id, CASE WHEN k < 10 THEN 'bad_key' WHEN k < 20 THEN 'quota' WHEN k < 30 THEN 'transient' WHEN event_type = 'error' THEN 'empty' WHEN k >= 90 OR event_type = 'click' THEN 'invalid' ELSE 'ok' END AS outcome
  FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
def answer_outcomes(table):
    """What answers mean by the status and error text that events carry (STR-28)."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(k < 10, 401).when(k < 20, 429).when(k < 30, 500 + k).when(k >= 90, 404).otherwise(200)
    error = F.when(F.col("event_type") == "error", "No results for this query").when(F.col("event_type") == "click", F.concat(F.lit("Unsupported value: "), F.col("event_type")))
    return table("events").select("event_id", requests.outcome(status, error).alias("outcome"))
