"""Claims: grounding, dedupe, choice, diff, facts (FLT-13, FLT-14, SET-5, AGG-7 to AGG-10, AGG-17, JN-8, JN-10, JN-12 to JN-14, STR-14, STR-15, STR-29)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from proofmill.functions import money, names
from proofmill.functions.names import norm
from proofmill.sources.stored import checkpointed

# The pattern of rows of an expenses table.
EXPENSE_ROW = (
    r"(?i)\b(fees?|expenses?|commission|charges|payable|brokerage|total|stamp duty|printing|advertis\w*|"
    r"miscellaneous|contingenc\w*|registrar|underwriting)\b"
)


def first_by(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def grounded(claims: DataFrame, pages: DataFrame, on: list[str], values: Column, text: Column) -> DataFrame:
    """Claims all of whose values their page holds; at least one value is needed."""
    held = claims.join(pages, on, "left")
    return held.where((F.size(values) > 0) & F.forall(values, lambda v: F.contains(F.coalesce(text, F.lit("")), v)))


def is_generic(name: Column, vendor: Column, roles: list[str]) -> Column:
    """A role in place of a name, or a row of an expenses table (FLT-13)."""
    return F.coalesce(norm(name).isin(*roles), F.lit(False)) | is_expense(vendor)


def is_expense(vendor: Column) -> Column:
    """A row of an expenses table."""
    return F.coalesce(vendor.rlike(EXPENSE_ROW), F.lit(False))


def grounded_rows(claims: DataFrame, pages: DataFrame, on: list[str], values: list[str], text: str) -> DataFrame:
    """Claims all of whose values that aren't blank stand on the page they cite, compared as ``norm`` has them (FLT-14, JN-10)."""
    stated = F.transform(F.filter(F.array(*values), lambda v: F.trim(F.coalesce(v, F.lit(""))) != ""), lambda v: F.lower(v))
    held = claims.join(pages.select(*on, norm(F.col(text)).alias("_page")), on, "left").withColumn("_values", F.transform(stated, lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))))
    return held.where((F.size("_values") > 0) & F.forall("_values", lambda v: F.contains(F.coalesce("_page", F.lit("")), v))).drop("_page", "_values")


def page_span(text: Column, value: Column, before: int = 60, chars: int = 300) -> Column:
    """What is shown of a page: ``chars`` from ``before`` ahead of the value, or from the page's start (STR-14)."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    at = F.position(F.lower(F.trim(F.regexp_replace(value, r"\s+", " "))), F.lower(flat))
    return F.substring(flat, F.greatest(at - before, F.lit(1)), F.lit(chars))


def halves(text: Column, marker: str = r"\[\[page \d+\]\]") -> Column:
    """A text cut near its middle, at a line break, else a space; the second half repeats the last page marker. Empty if a
    half would be blank (STR-15)."""
    middle = F.floor(F.length(text) / 2).cast("int")
    low = F.floor(middle / 2).cast("int")
    part = F.substring(text, low + 1, middle + 1 - low)  # characters low to middle, from 0
    last = lambda c: F.when(F.contains(part, F.lit(c)), low + F.length(part) - F.position(F.lit(c), F.reverse(part)))
    fine = lambda at: F.when(at > 0, at)
    cut = F.coalesce(fine(last("\n")), fine(last(" ")), middle)
    head, tail = F.left(text, cut), F.regexp_replace(F.substring(text, cut + 1, F.length(text)), r"^\n+", "")
    marks = F.regexp_extract_all(head, F.lit(marker), F.lit(0))
    carried = F.when((F.size(marks) > 0) & ~tail.startswith("[[page"), F.concat(F.element_at(marks, -1), F.lit("\n"), tail)).otherwise(tail)
    blank = (F.trim(head) == "") | (F.trim(F.regexp_replace(tail, r"\s+", " ")) == "")
    return F.when(blank, F.array().cast("array<string>")).otherwise(F.array(head, carried))


def first_claims(claims: DataFrame, kind: str, values: list[str], order: list[str]) -> DataFrame:
    """The first of the claims of a kind whose values are equal once normalized (SET-5)."""
    keys = claims.withColumns({f"_k{i}": norm(F.coalesce(F.col(v), F.lit(""))) for i, v in enumerate(values)})
    return first_by(keys, [kind, *(f"_k{i}" for i in range(len(values)))], *map(F.col, order)).drop(*(f"_k{i}" for i in range(len(values))))


def claim_key(kind: Column, c: dict[str, Column]) -> Column:
    """What makes two versions' claims the same one, by their kind (STR-29)."""
    company = names.normalize_company
    case = F.coalesce(F.nullif(F.regexp_replace(F.lower(c["case_ref"]), "[^a-z0-9]+", ""), F.lit("")), F.concat(company(c["party"]), F.lit("|"), F.lower(c["forum"])))
    place = F.concat_ws("|", c["role"], F.lower(c["city"]), F.lower(c["locality"]))
    return F.when(kind == "quote", company(c["vendor"])).when(kind == "case", case).when(kind == "place", place).otherwise(company(c["name"]))


def claim_diff(old: DataFrame, new: DataFrame, amount: str) -> DataFrame:
    """key, kind (added, removed, changed) and text of what differs between two versions (JN-13). ``old`` and ``new``: key,
    ord, vendor and an amount in paise; of equal keys the last claim counts."""
    last = lambda d, c: d.groupBy("key").agg(F.max_by(F.struct("vendor", F.col(amount).alias("paise")), "ord").alias(c))
    both = last(old, "o").join(last(new, "n"), "key", "full_outer")
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o.paise") != F.col("n.paise"), "changed")
    told = F.format_string("vendor quotation from %s changed: %s earlier, %s later", F.col("n.vendor"), money.format_inr(F.col("o.paise"), True), money.format_inr(F.col("n.paise"), True))
    plain = F.concat(F.coalesce("n.vendor", "o.vendor"), F.lit(" ("), money.format_inr(F.coalesce("n.paise", "o.paise")), F.lit(")"))
    return both.withColumn("kind", kind).where("kind is not null").select("key", "kind", F.when(F.col("kind") == "changed", told).otherwise(plain).alias("text"))


def tallies(tries: DataFrame, *by: str) -> DataFrame:
    """Claims kept and dropped, failed calls and calls, by task (AGG-17). ``tries``: kept, dropped, failed (boolean)."""
    return tries.groupBy(*by).agg(F.sum("kept").alias("kept"), F.sum("dropped").alias("dropped"), F.count_if("failed").alias("failed"), F.count("*").alias("calls"))


def mode_latest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, the greatest of equals."""
    counts = rows.groupBy(key, value).count()
    return counts.groupBy(key).agg(F.max_by(value, F.struct("count", value)).alias(value))


def first_known(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Of each field the first value that isn't null, by order."""
    place = F.struct(*order)
    return rows.groupBy(key).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), place)).alias(f) for f in fields])


def largest_quotes(quotes: DataFrame, doc: str, order: list[str], vendor: str, paise: str) -> DataFrame:
    """The row of the largest quotation of each vendor of a document (AGG-9), names compared without legal forms; an
    unreadable amount counts as 0, and of equal ones the first by ``order`` is taken. ``place``: the vendors' order of first
    appearance in the document, from 1."""
    own = Window.partitionBy(doc, "_key")
    best = F.row_number().over(own.orderBy(F.coalesce(F.col(paise), F.lit(0)).desc(), *order))
    keyed = quotes.withColumn("_key", names.normalize_company(F.col(vendor))).withColumn("_first", F.min(F.struct(*order)).over(own)).withColumn("_n", best).where("_n = 1")
    return keyed.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy("_first"))).drop("_key", "_first", "_n")


def version_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, kind (added, removed, changed), old and new value of what differs."""
    o, n = (d.select(key, F.col(value).alias(c), F.lit(True).alias(f"has_{c}")) for d, c in ((old, "old"), (new, "new")))
    kind = F.when(F.col("has_old").isNull(), "added").when(F.col("has_new").isNull(), "removed").otherwise("changed")
    both = o.join(n, key, "full_outer").withColumn("kind", kind)
    return both.where((F.col("kind") != "changed") | ~F.col("old").eqNullSafe(F.col("new"))).select(key, "kind", "old", "new")


def depth(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """Levels below the root; a node whose parent is missing has depth 0. Pointers double each round."""
    known = nodes.select(F.col(node).alias("p"), F.lit(True).alias("ok"))
    up = nodes.select(F.col(node).alias("n"), F.col(parent).alias("p")).join(known, "p", "left")
    at = up.select("n", F.when(F.col("ok"), F.col("p")).alias("p"), F.when(F.col("ok"), 1).otherwise(0).alias("d"))
    while True:
        at = checkpointed(at)  # cuts the lineage of the rounds
        if not at.where("p is not null").limit(1).count():
            return at.select(F.col("n").alias(node), F.col("d").alias("depth"))
        q = at.select(F.col("n").alias("p"), F.col("p").alias("pp"), F.col("d").alias("dd"))
        at = at.join(q, "p", "left").select("n", F.col("pp").alias("p"), (F.col("d") + F.coalesce("dd", F.lit(0))).alias("d"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """part, doc, ord, n of the rows of a task."""
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _summary(sizes: list[int], cap: int) -> tuple[list[int], list[int], list[int]]:
    """What a part of a document does to any open chunk: running sums of its blocks as far as the first break can lie,
    and for a chunk that begins there its size at the part's end and how many more are begun."""
    m = len(sizes)
    sums = [0, *accumulate(sizes)]
    ends, cuts, full = [0] * m, [0] * m, m
    for i in range(m - 1, -1, -1):
        if sizes[i] > 0:
            full = i  # blocks before the first that isn't empty fit anyway, and it does
        j = max(full + 1, bisect_right(sums, sums[i] + cap) - 1)
        ends[i], cuts[i] = (sums[m] - sums[i], 0) if j >= m else (ends[j], cuts[j] + 1)
    n = min(m, bisect_left(sums, cap, 1))
    return sums[1 : n + 1], ends[:n], cuts[:n]


def chunks(pages: DataFrame, doc: str, order: str, block: str, cap: int = 20480) -> DataFrame:
    """Greedy chunks of a document's blocks: one is closed when the next would bring it over ``cap`` UTF-8 bytes.

    Rows are dealt by ranges of document and order, so a large document lies in many tasks and in no single row. A
    summary of each task's first and last document gives the chunk that is open where the next task begins.
    """
    sizes = pages.select(F.col(doc).alias("doc"), F.col(order).cast("bigint").alias("ord"), F.coalesce(F.octet_length(block), F.lit(0)).cast("bigint").alias("n"))
    dealt = checkpointed(sizes.repartitionByRange("doc", "ord", "n").sortWithinPartitions("doc", "ord", "n").select(F.spark_partition_id().alias("part"), "doc", "ord", "n"))
    kind = dealt.schema["doc"].dataType.simpleString()
    arrays = [pa.list_(pa.int64())] * 3
    doc_type = to_arrow_type(dealt.schema["doc"].dataType)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []  # the first and the latest document: part, doc, sizes
        for part, d, _, n in _runs(batches):
            if not found or found[-1][1] != d:
                found = [*found[:1], (part, d, [])]
            found[-1][2].append(n)
        if found:
            out = [(part, d, sum(x), *_summary(x, cap)) for part, d, x in found]
            columns = zip([pa.int32(), doc_type, pa.int64(), *arrays], zip(*out, strict=True), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for t, c in columns], ["part", "doc", "total", "sums", "ends", "cuts"])

    parts: dict[int, list] = {}
    for r in dealt.mapInArrow(ends, f"part int, doc {kind}, total long, sums array<long>, ends array<long>, cuts array<long>").collect():  # two rows a task at most
        parts.setdefault(r.part, []).append(r)
    opened: dict[int, tuple[int, int]] = {}
    last, size, chunk = None, 0, 0
    for k in sorted(parts):
        if last is not None and last[0] == parts[k][0].doc:
            opened[k] = (size, chunk)
        r = parts[k][-1]
        if len(parts[k]) > 1 or k not in opened:
            size, chunk = 0, 0
        j = bisect_right(r.sums, cap - size) if size else 0
        if size and j == len(r.sums):
            size += r.total
        else:
            size, chunk = r.ends[j], chunk + r.cuts[j] + bool(size)
        last = (r.doc,)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now: list | None = None  # doc, chunk, first, last, bytes here
        begun, size, chunk, at = False, 0, 0, None

        def batch() -> pa.RecordBatch:
            types = [doc_type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for t, c in zip(types, zip(*out, strict=True), strict=True)], ["doc", "chunk", "first", "last", "bytes"])

        for part, d, o, n in _runs(batches):
            if not begun or at != d:
                size, chunk = (0, 0) if begun else opened.get(part, (0, 0))
                begun, at = True, d
            if size and size + n > cap:
                size, chunk = 0, chunk + 1
            size += n
            if now is None or now[:2] != [d, chunk]:
                if now:
                    out.append(tuple(now))
                now = [d, chunk, o, o, 0]
            now[3], now[4] = o, now[4] + n
            if len(out) >= 10_000:
                yield batch()
                out.clear()
        if now:
            out.append(tuple(now))
            yield batch()

    folded = dealt.mapInArrow(packed, f"doc {kind}, chunk int, first long, last long, bytes long")
    return folded.groupBy(F.col("doc").alias(doc), "chunk").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("bytes").alias("bytes"))


def section_ends(titles: DataFrame, doc: str, start: str, position: str, last_page: str) -> DataFrame:
    """A section ends a page before the next title, at its own start at least; the last one with the document."""
    following = F.lead(start).over(Window.partitionBy(doc).orderBy(start, position))
    return titles.withColumn("end", F.greatest(F.col(start), F.coalesce(following - 1, F.col(last_page))))


def section_starts(titles: DataFrame, pages: DataFrame, doc: str, order: str, title: str, page: str, lines: str, after: int = 0) -> DataFrame:
    """doc, order, title, start of the contents titles found (JN-12): each at the first page not before the last one
    found whose ``lines`` (an array) hold it. A title that isn't found moves nothing. A fold over a document's titles."""
    lines_of = pages.where(F.col(page) > after).select(doc, F.col(page).cast("bigint").alias("_page"), F.explode(F.array_distinct(lines)).alias(title))
    at = titles.select(doc, order, title).join(lines_of, [doc, title]).groupBy(doc, order, title).agg(F.array_sort(F.collect_set("_page")).alias("at"))
    listed = at.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(order, title, "at"))).alias("t"))
    found = f"array<struct<{order}:{titles.schema[order].dataType.simpleString()},{title}:string,start:bigint>>"
    start = F.struct(F.lit(after + 1).cast("bigint").alias("cursor"), F.array().cast(found).alias("out"))

    def step(s: Column, t: Column) -> Column:
        first = F.get(F.filter(t["at"], lambda p: p >= s["cursor"]), F.lit(0))
        item = F.struct(t[order].alias(order), t[title].alias(title), first.alias("start"))
        return F.struct(F.coalesce(first, s["cursor"]).alias("cursor"), F.when(first.isNotNull(), F.array_append(s["out"], item)).otherwise(s["out"]).alias("out"))

    return listed.select(doc, F.inline(F.aggregate("t", start, step, lambda s: s["out"])))
