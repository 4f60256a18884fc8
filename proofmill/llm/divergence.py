"""Divergence between the sources of a language: which sources use its words differently, and which words set one apart.

Words are counted for each language and source in one pass. A kept term's counts over the sources of its language, without
the zeros, are its vector. Terms of equal vectors are grouped: every pair of sources is evaluated once for each distinct
vector, in numpy, and multiplied by the number of its terms. Sources are dealt to blocks of bounded size, so that a task
holds a pair of blocks and not all pairs; sources of two blocks that no term of a vector touches differ by their zeros
alone, which are added for all such terms at once. Of each distinct vector the first terms by name, as many as a report
has, are enough to rank the original terms.

All numbers are exact: shares are integers in billionths, and so are their sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proofmill.llm.store import discard, documents, small, written
from proofmill.llm.words import folding, raw_texts

MIN_DOCS, TOP = 10, 10
#: Bytes of text that are counted together, sources in a block, pairs of blocks that a task holds.
BLOCK, SOURCES, HELD = 8_000_000, 256, 16
_FOLD = folding(digits=False)
_COUNTS = "lang string, source string, term binary, n long, docs long"
_SUMS = "lang string, a int, b int, i int, j int, value long, terms long"


def _counts(docs: DataFrame) -> DataFrame:
    """Occurrences of terms and documents that hold them, by lang, source and block of text; a row without a term for each
    lang and source that occurs."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        groups = {g: i for i, g in enumerate(dict.fromkeys(r[:2] for r in rows))}
        texts = [r[2].translate(_FOLD).split() for r in rows]
        coded = pa.array([w for words in texts for w in words], pa.binary()).dictionary_encode()
        width = max(len(coded.dictionary), 1)
        of = np.repeat(np.arange(len(rows)), [len(t) for t in texts])
        pairs, n = np.unique(of * width + coded.indices.to_numpy(), return_counts=True)
        group = np.array([groups[r[:2]] for r in rows], np.int64)[pairs // width]
        held, at = np.unique(group * width + pairs % width, return_inverse=True)
        sums, holding = np.zeros(len(held), np.int64), np.bincount(at, minlength=len(held))
        np.add.at(sums, at, n)
        names = [pa.array([g[c] for g in groups], pa.string()) for c in (0, 1)]
        which = pa.array(np.concatenate([held // width, np.arange(len(groups))]))
        terms = pa.concat_arrays([coded.dictionary.take(pa.array(held % width)), pa.nulls(len(groups), pa.binary())])
        more = np.zeros(len(groups), np.int64)
        columns = [*(c.take(which) for c in names), terms, pa.array(np.concatenate([sums, more])), pa.array(np.concatenate([holding, more]))]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _COUNTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), raw_texts(batch.column("text")), strict=True):
                if rows and size + len(row[2]) > BLOCK:
                    yield block(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
        if rows:
            yield block(rows)

    found = docs.mapInArrow(run, _COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + the smoothed share of a count in billionths, rounded down. Decimals, as a billion counts overflow 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    above, below = wide(count + 2) * F.lit(1_000_000_000).cast("decimal(10,0)"), wide(total + 2 * kept)
    return F.when(kept > 0, 1 + F.call_function("div", above, below))


def _apart(p: Column, q: Column) -> Column:
    """How much two shares differ."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _layout(groups: DataFrame) -> DataFrame:
    """Sources with a block of their language and a place in it: lang, source, total, kept, block, blocks, place, zero (the
    share of a term that the source lacks)."""
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).cast("int").alias("blocks"))
    dealt = groups.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    place = (F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1).alias("place")
    zero = F.coalesce(_share(F.lit(0).cast("long"), F.col("total"), F.col("kept")), F.lit(0).cast("long")).alias("zero")
    return dealt.select("*", place, zero)


def _summed(rows: DataFrame) -> DataFrame:
    """Sums over distinct vectors of the differences of each pair of sources of two blocks, and the number of terms.

    ``rows``: lang, a, b (blocks, a <= b), m, parts (block, entries: place, share), zeros_a, zeros_b.
    """

    def sums(shares: list[np.ndarray], m: np.ndarray) -> np.ndarray:
        left, right = shares
        out = np.zeros((left.shape[1], right.shape[1]), np.int64)
        for i in range(left.shape[1]):
            p = left[:, i : i + 1]
            out[i] = (((p - right) ** 2 // (p + right)) * m[:, None]).sum(axis=0)
        return out

    def told(held: dict) -> pa.RecordBatch:
        rows = []
        for (lang, a, b), (value, terms) in held.items():
            i, j = np.triu_indices(len(value), 1) if a == b else np.indices(value.shape).reshape(2, -1)
            rows.append((pa.array([lang] * len(i), pa.string()), *(pa.array(np.full(len(i), x), pa.int32()) for x in (a, b)), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(value[i, j]), pa.array(np.full(len(i), terms), pa.int64())))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(list(c)) for c in zip(*rows, strict=True)], [c.split()[0] for c in _SUMS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            keys = [*zip(*(batch.column(c).to_pylist() for c in ("lang", "a", "b")), strict=True)]
            m = batch.column("m").to_numpy()
            parts = batch.column("parts")
            part, entries = parts.flatten(), parts.flatten().field("entries")
            per = entries.value_lengths().to_numpy()
            row = np.repeat(np.repeat(np.arange(batch.num_rows), parts.value_lengths().to_numpy()), per)
            block = np.repeat(part.field("block").to_numpy(), per)
            place, share = (entries.flatten().field(c).to_numpy() for c in ("place", "share"))
            for key in dict.fromkeys(keys):
                at = np.array([i for i, k in enumerate(keys) if k == key])
                zeros = tuple(batch.column(c)[int(at[0])].values.to_numpy() for c in ("zeros_a", "zeros_b"))
                if key not in held:
                    held[key] = [np.zeros((len(zeros[0]), len(zeros[1])), np.int64), 0]
                held[key][1] += int(m[at].sum())
                step = max(1, 2_000_000 // (len(zeros[0]) + len(zeros[1])))
                for some in (at[i : i + step] for i in range(0, len(at), step)):
                    shares = [np.tile(z, (len(some), 1)) for z in zeros]
                    here = np.isin(row, some)
                    for of, b in zip(shares, key[1:], strict=True):
                        own = here & (block == b)
                        of[np.searchsorted(some, row[own]), place[own]] = share[own]
                    held[key][0] += sums(shares, m[some])
                if len(held) > HELD:
                    yield told(held)
                    held = {}
        if held:
            yield told(held)

    return rows.mapInArrow(run, _SUMS)


def _pairs(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the lang), value."""
    layout = written(_layout(groups), "layout")
    named = small(layout.select("lang", "source", "total", "kept", "block", "blocks", "place"))
    entries = vectors.select("lang", "vector", "m", F.explode("entries").alias("e")).select("lang", "vector", "m", F.col("e.source").alias("source"), F.col("e.n").alias("n"))
    shares = entries.join(named, ["lang", "source"]).select("lang", "vector", "m", "block", "blocks", F.struct("place", _share(F.col("n"), F.col("total"), F.col("kept")).alias("share")).alias("entry"))
    parts = shares.groupBy("lang", "vector", "m", "block", "blocks").agg(F.collect_list("entry").alias("entries"))  # as many as a block has sources
    met = parts.select("lang", "vector", "m", F.struct("block", "entries").alias("part"), "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = met.groupBy("lang", "vector", "m", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")).agg(F.collect_list("part").alias("parts"))
    zeros = written(layout.groupBy("lang", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "zero"))), lambda x: x["zero"]).alias("zeros")), "zeros")
    side = lambda c: small(zeros.select("lang", F.col("block").alias(c), F.col("zeros").alias(f"zeros_{c}")), 500)  # noqa: E731  a row a block
    sums = _summed(rows.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"]).drop("vector"))
    sums = written(sums.groupBy("lang", "a", "b", "i", "j").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms")), "sums")
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("j").alias("i"), F.col("i").alias("j"), "value", "terms"))
    # The answer itself: each source of a language with each other one.
    left = layout.select("lang", "source", F.col("block").alias("a"), F.col("place").alias("i"), F.col("zero").alias("p"), "kept")
    right = layout.select("lang", F.col("source").alias("item"), F.col("block").alias("b"), F.col("place").alias("j"), F.col("zero").alias("q"))
    pairs = left.join(small(right), "lang").where("source <> item").join(both, ["lang", "a", "b", "i", "j"], "left")
    rest = F.col("kept") - F.coalesce("terms", F.lit(0))
    value = F.coalesce("value", F.lit(0)) + F.when(rest > 0, rest * _apart(F.col("p"), F.col("q"))).otherwise(F.lit(0))
    out = written(pairs.select("lang", "source", "item", value.cast("long").alias("value")), "pairs")
    discard(layout, zeros, sums)
    return out


def _terms(firsts: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """lang, source, item (a term), value, rank of the terms that a source has more of than its language."""
    totals = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    known = small(written(groups.join(totals, "lang"), "totals"))
    whole = F.aggregate("entries", F.lit(0).cast("long"), lambda a, e: a + e["n"]).alias("lang_n")
    entries = firsts.select("lang", "terms", whole, F.explode("entries").alias("e")).select("lang", "terms", "lang_n", F.col("e.source").alias("source"), F.col("e.n").alias("n"))
    p, q = _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")
    apart = entries.join(known, ["lang", "source"]).select("lang", "source", "terms", p, q).where("p > q").select("lang", "source", "terms", _apart(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return apart.select("lang", "source", F.explode("terms").alias("item"), "value").withColumn("rank", rank).where(F.col("rank") <= top)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of each language of ``docs`` (text, lang, source) the other
    sources by divergence (``pair``) and the ``top`` terms that set it apart from its language (``term``).

    Null text, lang and source are empty strings. Terms are runs of letters and characters beyond ASCII, A-Z in lower case;
    a language keeps those that at least ``min_docs`` of its documents hold. A repeated row is a document of its own. With
    count c and total N over the V kept terms a share is 1 + floor(10^9 (c + 2) / (N + 2 V)), of sources and of the language
    alike; two shares p and q differ by floor((p - q)^2 / (p + q)), a pair of sources by the sum over all kept terms, 0 if
    there is none. A source alone in its language has no pairs. Empty tables give no rows; other columns are ignored.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counts = written(_counts(docs.select(blank("lang"), blank("source"), blank("text"))), "counts", "zstd")
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("entries"))
    terms = written(terms.where(F.col("docs") >= min_docs).select("lang", F.col("term").cast("string").alias("term"), "entries"), "terms", "zstd")
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    used = terms.select("lang", F.explode("entries").alias("e")).groupBy("lang", "e.source").agg(F.sum("e.n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(used, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = written(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept"))), "groups")
    discard(counts)

    vectors = written(terms.groupBy("lang", "entries").agg(F.count("*").alias("m")).withColumn("vector", F.monotonically_increasing_id()), "vectors", "zstd")
    pairs = _pairs(vectors, groups)
    first = terms.withColumn("at", F.row_number().over(Window.partitionBy("lang", "entries").orderBy("term"))).where(F.col("at") <= top)
    firsts = first.groupBy("lang", "entries").agg(F.collect_list("term").alias("terms"))
    ranked = written(_terms(firsts, groups, top), "ranked")
    discard(terms, vectors)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    told = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return told(pairs.withColumn("rank", rank), "pair").unionByName(told(ranked, "term"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


OP12_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), grp AS (SELECT DISTINCT lang, source FROM doc),
used AS (SELECT r, lang, source, unnest(ws) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS c FROM used GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS c FROM used SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v) AS p,
    1 + (1000000000::HUGEINT * (k.c + 2)) // (v.n + 2 * v.v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS f
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), pair AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), term AS (SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM term) WHERE rank <= 10
"""
