"""Importance resampling, divergence audit and decontamination against brute force, and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from proofmill.llm import decontamination, divergence, importance
from proofmill.operators import marks

SF = "/root/testdata/sf0.001"
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WITH_DIGITS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def words_of(text, pattern=WITH_DIGITS):
    return pattern.findall((text or "").translate(FOLD))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns named like outputs."""
    rows = [
        (1, "A b, c d É3", "en", "s1", 7, 0), (2, None, None, None, None, None), (3, "", "en", None, 0, 1), (4, " \n\t ", None, "s2", 4, 1), (5, LONG, "en", "s1", 1, 2),
        (6, LONG, "en", "s2", 1, 2), (7, f"x {LONG[:300]} y", "en", "s1", 1, 3), (8, f"z {LONG[:300]}", "de", "s3", 1, 3), (9, "a b c d", "en", "s1", 7, 0),
        (9, "a b c d", "en", "s1", 7, 0), (9, "another text", "en", "s1", 7, 0), (None, f"null id {LONG[:200]}", "en", "s4", 7, 5), (None, LONG[:250], "en", "s4", 7, 5), (10, "ÀB ß-x_y\x7fq`r", "", "", 3, 3),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rank long, n_words long")


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def importance_brute(docs, target, max_n=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    grams = lambda ws: [" ".join(ws[i : i + n]) for n in range(1, max_n + 1) for i in range(len(ws) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, grams(words_of(text))))
    for text in target:
        t.update(map(bucket, grams(words_of(text))))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        ws = words_of(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, grams(ws))]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(ws), len(gains), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    drawn = [(x, r) for r, x in enumerate(able[: len(able) * percent // 100], 1)]
    rest = [(x, None) for x in [*able[len(drawn) :], *(x for x in out if x[1] < min_words)]]
    return sorted(((*x, r) for x, r in drawn + rest), key=str)


@pytest.mark.parametrize("settings", [{}, {"max_n": 2, "buckets": 97, "percent": 55, "min_words": 3, "seed": 5}, {"max_n": 3, "buckets": 1000}])
@pytest.mark.parametrize("which", ["awkward", "table"])
def test_importance(spark, awkward, which, settings, monkeypatch):
    docs = awkward if which == "awkward" else read(spark, "documents")
    target = read(spark, "benchmark")
    got = sorted((tuple(r) for r in importance.weigh(docs, target, **settings).collect()), key=str)
    assert got == importance_brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], **settings)


def test_importance_one_document_a_block(spark, monkeypatch):
    docs, target = read(spark, "documents").limit(40), read(spark, "benchmark")
    whole = sorted(map(str, importance.weigh(docs, target, max_n=2).collect()))
    monkeypatch.setattr(importance, "BLOCK", 1)
    assert sorted(map(str, importance.weigh(docs, target, max_n=2).collect())) == whole


def test_importance_rows(spark, awkward):
    drawn = importance.resample(awkward, read(spark, "benchmark"), percent=100, min_words=2)
    assert drawn.columns == ["doc_id", "text", "lang", "source", "n_words", "rank"]
    rows = drawn.collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in awkward.collect() if len(words_of(r.text)) >= 2)
    assert importance.resample(awkward.where("false"), read(spark, "benchmark")).count() == 0


def test_importance_clashing_names(spark, awkward):
    """Columns named like the operator's own are ignored, whatever they hold."""
    clash = awkward.selectExpr("*", "'x' as row", "'y' as block", "'z' as weight", "array(1) as tuple")
    key = lambda df: sorted((tuple(r) for r in importance.weigh(df, read(spark, "benchmark").selectExpr("*", "'q' as target")).collect()), key=str)
    assert key(clash) == key(awkward)
    assert importance.resample(clash, read(spark, "benchmark"), percent=100, min_words=0).columns == [c for c in clash.columns if c != "rank"] + ["rank"]


def test_importance_empty(spark, awkward):
    nothing = read(spark, "benchmark").where("false")
    assert importance.weigh(awkward.where("false"), read(spark, "benchmark")).count() == 0
    got = sorted((tuple(r) for r in importance.weigh(awkward, nothing).collect()), key=str)
    assert got == importance_brute([(r.doc_id, r.text) for r in awkward.collect()], [])


def divergence_brute(docs, min_docs=10, top=10):
    held, counts, groups = defaultdict(set), defaultdict(Counter), set()
    for r, (text, lang, source) in enumerate(docs):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for w in words_of(text, LETTERS):
            held[lang, w].add(r)
            counts[lang, source][w] += 1
    out = []
    for lang in {g[0] for g in groups}:
        sources = sorted((s for x, s in groups if x == lang), key=str.encode)
        kept = [w for x, w in held if x == lang and len(held[x, w]) >= min_docs]
        of = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for w in kept}
        p = {s: of(counts[lang, s]) for s in sources}
        q = of(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][w], p[o][w]) for w in kept), o) for o in sources if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((-f(p[s][w], q[w]), w) for w in kept if counts[lang, s][w] and p[s][w] > q[w]), key=lambda x: (x[0], x[1].encode()))[:top]
            out += [(lang, s, part, item, -v, r) for part, rows in (("pair", pairs), ("term", terms)) for r, (v, item) in enumerate(rows, 1)]
    return sorted(out)


@pytest.mark.parametrize(("which", "min_docs", "sources"), [("table", 10, 256), ("table", 3, 4), ("awkward", 1, 256), ("awkward", 2, 1), ("awkward", 50, 256)])
def test_divergence(spark, awkward, which, min_docs, sources, monkeypatch):
    """Also with sources dealt to many blocks, of which some pairs are touched by no vector."""
    monkeypatch.setattr(divergence, "SOURCES", sources)
    docs = awkward if which == "awkward" else read(spark, "documents")
    got = sorted(tuple(r) for r in divergence.audit(docs, min_docs).collect())
    assert got == divergence_brute([(r.text, r.lang, r.source) for r in docs.collect()], min_docs)


def test_divergence_vectors(spark):
    """Many terms of one vector, ties in value, one source alone in its language, an empty table."""
    rows = [(" ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)), "en", "a")] * 3 + [("other words here", "en", "b")] * 2 + [("solo solo", "fr", "x"), ("", "de", "y"), (None, "de", "z")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audit(docs, 2).collect()) == divergence_brute(rows, 2)
    assert divergence.audit(docs.where("false")).count() == 0


def contaminated_brute(docs, items, length=10):
    windows = defaultdict(set)
    for i, text in items:
        ws = words_of(text)
        n = min(length, len(ws))
        for s in range(len(ws) - n + 1 if ws else 0):
            windows[tuple(ws[s : s + n])].add("" if i is None else str(i))
    out = []
    for i, text in docs:
        ws, hit, found = words_of(text), set(), set()
        for n in {len(w) for w in windows}:
            for s in range(len(ws) - n + 1):
                if (w := tuple(ws[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[w]
        edges = [(s, s - 1 in hit, s + 1 in hit) for s in sorted(hit)]
        spans = [*zip([s for s, before, _ in edges if not before], [s + 1 for s, _, after in edges if not after], strict=True)]
        out.append((i, len(ws), len(hit), spans, sorted(found)))
    return sorted(out, key=str)


def contaminated(docs, items, **settings):
    rows = decontamination.contaminated(docs, items, **settings).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, [tuple(s) for s in r.spans], [*r["items"]]) for r in rows), key=str)


@pytest.fixture(scope="module")
def hard_items(spark):
    """Items of one word and a few, repeated and shared ids, null and empty texts, words in other case, a boundary over two segments."""
    rows = [(1, "b C"), (2, "w5 w6 w7"), (2, "d"), (3, None), (4, " .,; "), (None, "another TEXT"), (5, LONG[2000:4000]), (6, LONG[300:360]), (7, "w5, w6! w7"), (8, "ß"), (9, "not there at all but for one word w5"), (10, "w976 w0 w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("settings", [{}, {"length": 3}, {"length": 12, "shingle": 2}, {"shingle": 20}])
def test_contaminated(spark, awkward, hard_items, settings):
    docs, items = [(r.doc_id, r.text) for r in awkward.collect()], [(r.item_id, r.text) for r in hard_items.collect()]
    got = contaminated(awkward, hard_items, **settings)
    want = contaminated_brute(docs, items, settings.get("length", 10))
    # A span that touches the next one is one with it.
    assert got == want


def test_contaminated_table(spark):
    docs, items = read(spark, "documents"), read(spark, "benchmark")
    got = contaminated(docs, items)
    assert got == contaminated_brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(r[2] for r in got) and not all(r[2] for r in got)


def test_contaminated_crowded_bitmap_and_shuffled_joins(spark, awkward, hard_items, monkeypatch):
    """A bitmap that is full lets everything through and changes nothing; nor do joins without broadcasts."""
    want = contaminated(awkward, hard_items)
    monkeypatch.setattr(marks, "MOST", 1 << 10)
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(decontamination, "small", lambda df: df)
    assert contaminated(awkward, hard_items) == want


def test_contaminated_empty(spark, awkward, hard_items):
    assert contaminated(awkward.where("false"), hard_items) == []
    got = contaminated(awkward, hard_items.where("false"))
    assert len(got) == awkward.count() and not any(r[2] or r[3] or r[4] for r in got)
