"""The training-data operators against brute force, and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from proofmill.llm import binary, line_dedup, mixing, near_join, neighbours, packing, quality_classifier, quality_rules, queries, substring_dedup, tokens, toxicity
from proofmill.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(25))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, a column named like an output."""
    rows = [
        (1, "a b c d", "en", "s1", 7, 0), (2, None, None, None, None, None), (3, "", "en", None, 0, 1), (4, " \n\t ", None, "s2", 4, 1), (5, LONG, "en", "s1", len(LONG), 2),
        (6, LONG, "en", "s2", len(LONG), 2), (7, f"x {PASSAGE} y", "en", "s1", 1, 3), (8, f"z {PASSAGE}", "de", "s3", 1, 3), (9, "a b c d", "en", "s1", 7, 0),
        (9, "a b c d", "en", "s1", 7, 0), (None, "null id", "en", "s4", 7, 5), (10, "line one two three\nother", "en", "s1", 3, 3),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long")


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


def docs_of(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def dedup_brute(rows, k=20):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = (t or "").encode().split()
        for j in range(len(w) - k + 1):
            seen.setdefault(tuple(w[j : j + k]), (i is not None, i or 0, j))
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for j in range(len(w) - k + 1):
            if seen[tuple(w[j : j + k])] < (i is not None, i or 0, j):
                gone.update(range(j, j + k))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("which", ["awkward", "table", "empty"])
def test_substring_dedup(spark, awkward, empty, which):
    docs = {"awkward": awkward, "table": spark.read.parquet(f"{SF}/documents.parquet"), "empty": empty}[which]
    got = [tuple(r) for r in substring_dedup.dedup(docs).drop("kept_text").collect()]
    want = dedup_brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(got, key=str) == sorted(want, key=str)


def rules_brute(i, t):
    t = t or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    three = Counter(zip(w, w[1:], w[2:]))
    cover = {p for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    return i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_quality_rules(spark, awkward, empty):
    for docs in (awkward, spark.read.parquet(f"{SF}/documents.parquet")):
        got = quality_rules.judge(docs).collect()
        assert sorted((tuple(r)[:7] for r in got), key=str) == sorted((rules_brute(r.doc_id, r.text) for r in docs.collect()), key=str)
        assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules.judge(empty).count() == 0


def test_encoder_forgets(monkeypatch):
    """Ids stay the library's when pieces move between the halves of a small cache or are met again after it forgot them."""
    monkeypatch.setattr(tokens, "CACHE", 40)
    monkeypatch.setattr(tokens, "SPLIT_BLOCK", 300)
    monkeypatch.setattr(tokens, "BLOCK", 300)
    texts = [" ".join(f"{'ab' * (i % 37)}{chr(97 + i * j % 26)}{'.!'[: j % 3]}" for j in range(20)) for i in range(200)]
    texts += ["", " ", "\n a\x1cb \x0b", "x" * 300, "É\u0085à b", *texts[:50]]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = Encoder(public_tokenizers.path(name))
        for ids, t in zip(e.encode([t.encode() for t in texts]), texts, strict=True):
            assert np.frombuffer(ids, e.dtype).tolist() == e.library.encode(t, add_special_tokens=False).ids


def test_encoder():
    texts = ["", " ", "a", "it's  two\n\nlines \t x", "É“quoted”\xa0\n\xa0\xa0!!", "don't <|endoftext|> İ##", LONG[:3000], "x\x00y z.,"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(public_tokenizers.path(name))
        for _ in range(2):
            for t, ids in zip(texts, e.encode([t.encode() for t in texts]), strict=True):
                assert np.frombuffer(ids, e.dtype).tolist() == e.library.encode(t, add_special_tokens=False).ids


def test_packing(spark, awkward, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for docs in (awkward, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = packing.pack(docs, path).collect()
        want = Counter()
        for r in docs.collect():
            want[r.doc_id] += len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
        got, fill = Counter(), {}
        for r in rows:
            got[r.doc_id] += r.length
            fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
            assert len(r.ids) == 4 * r.length
        assert got == want
        padding = 0
        for pieces in fill.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 2048
            padding += 0 if at & (at - 1) == 0 else 2048 - at
        assert padding < 0.03 * sum(want.values())
    assert packing.pack(empty, path).count() == 0


def test_mixing(spark, awkward, empty):
    for docs in (awkward, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = mixing.mix(docs).collect()
        again = mixing.mix(docs).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == docs.count()
        sizes = Counter()
        for r in docs.collect():
            sizes[r.source] += len(WORD.findall(r.text or ""))
        names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
        weight = {s: i % 3 + 1 for i, s in enumerate(names)}
        target, left, open_ = {}, float(sum(sizes.values())), set(names)
        while True:  # share, stop at the caps, share again
            total = sum(weight[s] for s in open_)
            over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s] + 1e-9}
            if not over:
                target.update({s: left * weight[s] / total for s in open_})
                break
            target.update({s: 3.0 * sizes[s] for s in over})
            left, open_ = left - sum(3.0 * sizes[s] for s in over), open_ - over
        assert Counter(round(r.target, 3) for r in rows) == Counter(round(target[r.source], 3) for r in docs.collect())
        assert all(0 <= r.copies <= 3 for r in rows)
    assert mixing.mix(empty).count() == 0


def test_line_dedup(spark, awkward, empty):
    docs = spark.createDataFrame([(i, f"own line number {i}\nshared line of boilerplate\nfoot", f"s{i}") for i in range(12)], "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in line_dedup.dedup(docs).collect()}
    assert rows[0].n_removed == 0 and all(rows[i].text == f"own line number {i}\nfoot" for i in range(1, 12))
    assert line_dedup.dedup(docs, min_sites=13).where("n_removed > 0").count() == 0
    assert line_dedup.dedup(awkward).count() == awkward.count() and line_dedup.dedup(empty).count() == 0


def test_binary(spark, awkward, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    binary.write(awkward, path, f"{tmp_path}/s")
    rows = binary.read(spark, f"{tmp_path}/s", path).orderBy("start").collect()
    want = Counter((r.doc_id, np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in awkward.collect())
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == want
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i))
    chunks = spark.read.parquet(f"{tmp_path}/s/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    binary.write(empty, path, f"{tmp_path}/e")
    assert binary.read(spark, f"{tmp_path}/e", path).count() == 0


def test_quality_classifier(spark, awkward, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = quality_classifier.train(docs, labels.where("doc_id % 2 = 0"))
    rest = quality_classifier.grade(docs, fitted).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rest]) > 0.9
    assert quality_classifier.grade(awkward, fitted).count() == awkward.count() and quality_classifier.grade(empty, fitted).count() == 0
    assert quality_classifier.train(empty, labels).weights.sum() == 0


def test_toxicity(spark, awkward, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    net = toxicity.train(docs, labels)
    rows = toxicity.score(docs, net).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.85
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    got = toxicity.score(awkward, net).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, net).count() == 0 and toxicity.train(docs, labels.where("false")).scores([b"x"])[0] < 0.5


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_near_join(spark, awkward, empty, k, percent):
    base = [f"t{i}" for i in range(60)]
    near = [(100 + j, " ".join([*base[: 3 * j], f"edit{j}", *base[3 * j + 1 :]]), "s") for j in range(12)] + [(99, " ".join(base), "s")]
    more = spark.createDataFrame(near, "doc_id long, text string, source string")
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id >= 200 or doc_id < 99")
    for docs in (awkward.select("doc_id", "text"), table.unionByName(more.select("doc_id", "text"))):
        rows = docs.collect()
        sets = {r.doc_id: near_join.shingles((r.text or "").encode(), k) for r in rows if r.doc_id is not None}
        root = {i: i for i in sets}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a in sets:
            for b in sets:
                if a < b and near_join.linked(sets[a], sets[b], percent):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        want = Counter((r.doc_id, len(sets[r.doc_id]), find(r.doc_id)) if r.doc_id is not None else (None, 1, None) for r in rows)
        got = near_join.join(docs, k, percent).collect()
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == set(want) and len(got) == len(rows)
    assert near_join.join(empty, k, percent).count() == 0


def test_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((300, 16))
    x[200:240] = x[7]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (None, [1.0] * 16), (304, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = {}
    for row in neighbours.nearest(vectors, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.vec_id)
    for q in range(0, 300, 20):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        assert got[q] == np.lexsort((np.arange(300), -s))[:5].tolist()
    assert neighbours.nearest(vectors.where("false")).count() == 0


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mix", "pack"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.select("doc_id").distinct().count() <= docs.count() and pieces.count() > 0
    assert set(queries.SQL) <= set(queries.QUERIES)
