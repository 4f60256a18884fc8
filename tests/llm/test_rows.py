"""Rows that share an id or have none, tampering, and figures that the operators must reach."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from proofmill.llm import binary, line_dedup, mixing, near_join, neighbours, packing, quality_rules, recurrent, substring_dedup, toxicity

SF = "/root/testdata/sf0.01"
PASSAGE = " ".join(f"p{i}" for i in range(25))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], COLUMNS)


def test_substring_keeps_rows_apart(spark):
    """One id with two texts, and several null ids, lose what is repeated and nothing else."""
    tail = " ".join(f"q{i}" for i in range(25))
    rows = [(1, PASSAGE), (2, f"{tail} {PASSAGE}"), (2, f"{PASSAGE} {tail} end"), (None, "own words of a text without id"), (None, f"other {tail}"), (-(1 << 63), "x y")]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup(docs_of(spark, [(i, t, "s") for i, t in rows])).collect())
    # The null id comes first and keeps the tail; id 1 keeps the passage; both texts of id 2 lose both.
    assert got == Counter({(1, 25, 0): 1, (2, 50, 50): 1, (2, 51, 50): 1, (None, 7, 0): 1, (None, 26, 0): 1, (-(1 << 63), 2, 0): 1})


def test_substring_stops_early(spark):
    assert substring_dedup.levels_of(20) == [5, 10] and substring_dedup.levels_of(1) == []
    docs = docs_of(spark, [(i, " ".join(f"w{i}_{j}" for j in range(60)), "s") for i in range(4)])
    assert all(r.n_removed == 0 for r in substring_dedup.dedup(docs).collect())
    for length in (1, 3, 40):
        same = docs_of(spark, [(1, PASSAGE, "s"), (2, f"{PASSAGE} {PASSAGE}", "s")])
        got = {r.doc_id: r.n_removed for r in substring_dedup.dedup(same, length).collect()}
        assert got == {1: 0, 2: 50 if length < 40 else 0}


def test_lines_keep_rows_apart(spark):
    common = [(i, f"shared line of boilerplate\nown line of {i}", f"s{i}") for i in range(12)]
    rows = [*common, (20, "x\nshared line of boilerplate", "s1"), (20, "x\nprecious unique line number one", "s2"), (None, "first null text of all\nshared line of boilerplate", "s3"), (None, "second null text of all\nkept line of it", "s4")]
    got = Counter((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup(docs_of(spark, rows)).collect())
    assert got[(20, "x", 1)] == 1 and got[(20, "x\nprecious unique line number one", 0)] == 1 and got[(None, "second null text of all\nkept line of it", 0)] == 1
    assert sum(n for (_, _, gone), n in got.items() if not gone) == 3  # the first occurrence and two texts without the line


def test_line_threshold_is_exact(spark):
    """Spread of exactly the threshold goes, one less stays, in many rows."""
    rows = [(i, f"line on ten sites\n{i}", f"s{i % 10}") for i in range(40)] + [(100 + i, f"line on nine sites\n{i}", f"s{i % 9}") for i in range(40)]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup(docs_of(spark, rows)).collect()}
    assert sum(got[i] for i in range(40)) == 39 and sum(got[100 + i] for i in range(40)) == 0


def test_rules_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    base = quality_rules.base(docs)
    plain = F.lit(True)
    for rule in quality_rules.RULES.values():
        plain = plain & ~F.expr(rule)
    want = {r.doc_id: r.kept for r in base.select("doc_id", (~F.col("base_failed") & plain).alias("kept")).collect()}
    assert {r.doc_id: r.kept for r in quality_rules.judge(docs.withColumn("kept", F.lit("clash"))).collect()} == want
    sets = {frozenset({"a", "b"}): 6, frozenset({"b"}): 1, frozenset({"c"}): 4, frozenset(): 9}
    assert quality_rules.order({"a": 1.0, "b": 1.1, "c": 1.0}, sets) == ["b", "c", "a"]  # a rejects nothing that b doesn't


def test_packing_holds_each_id_once(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    parts = {}
    for r in packing.pack(docs, path).collect():
        parts.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        pieces = sorted(parts[r.doc_id])
        assert b"".join(p[1] for p in pieces) == ids and {p[2] for p in pieces} == {len(ids) // 4}
        assert [p[0] for p in pieces] == np.cumsum([0, *[len(p[1]) // 4 for p in pieces[:-1]]]).tolist()
    crc = packing.digest(packing.pack(docs, path)).collect()
    assert all(0 <= r.ids_crc32 < 1 << 32 for r in crc)


def test_mix_is_near_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("copies").alias("most"))
    for r in rows.collect():
        assert abs(r.taken - r.target) < 0.03 * r.target and r.most <= 3, r
    rows = [(None if i < 500 else i, "a b c", "xyz"[i % 3]) for i in range(600)]
    assert {r.source: r["count"] for r in mixing.mixed(docs_of(spark, rows)).groupBy("source").count().collect()} == {"x": 100, "y": 200, "z": 300}


@pytest.mark.parametrize("what", ["chunk", "recipe", "manifest", "docs"])
def test_tampering_is_noticed(spark, tmp_path, what):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    store = f"{tmp_path}/s"
    binary.write(docs, path, store)
    library = Tokenizer.from_file(path)
    want = {r.doc_id: zlib.crc32(np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in docs.collect()}
    assert {r.doc_id: r.crc for r in binary.read(spark, store, path).select("doc_id", F.crc32("ids").alias("crc")).collect()} == want

    def change(table, rows):
        kept = spark.createDataFrame(rows.collect(), rows.schema)
        kept.write.mode("overwrite").parquet(f"{store}/{table}")

    chunks, recipes, manifest = (spark.read.parquet(f"{store}/{t}") for t in ("chunks", "recipes", "manifest"))
    if what == "chunk":
        change("chunks", chunks.withColumn("ids", F.when(F.col("digest") == chunks.first().digest, F.lit(b"\0\0")).otherwise(F.col("ids"))))
    elif what == "recipe":
        change("recipes", recipes.withColumn("n_tokens", F.when(F.col("at") == 0, F.col("n_tokens") + 1).otherwise(F.col("n_tokens"))))
    elif what == "manifest":
        change("manifest", manifest.where("level = 0"))
    else:
        change("recipes", recipes.where("doc_id % 4 <> 1"))
    with pytest.raises(Exception, match="differ"):
        binary.read(spark, store, path).collect()


def test_shards_stand_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "SHARD_DOCS", 20)
    monkeypatch.setattr(binary, "FANOUT", 4)
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy(F.rand(3))
    binary.write(docs, path, f"{tmp_path}/s")
    files = sorted((tmp_path / "s" / "recipes").glob("part-*"))
    ids = [[r.doc_id for r in spark.read.parquet(str(f)).collect()] for f in files]
    flat = [i for part in ids for i in part]
    assert flat == sorted(flat) and len(flat) == docs.count() and spark.read.parquet(f"{tmp_path}/s/manifest").agg(F.max("level")).first()[0] >= 2
    rows = binary.read(spark, f"{tmp_path}/s", path).orderBy("doc_id").collect()
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()


def test_toxicity_recall_and_long_texts(spark, monkeypatch):
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    net = toxicity.train(docs, labels)
    rows = toxicity.score(docs, net).join(labels, "doc_id").where("held_out").collect()
    toxic, found = [r for r in rows if r.toxic == 1], [r for r in rows if r.predicted == 1]
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic) and sum(r.toxic == 1 for r in found) >= 0.85 * len(found)
    raws = [b" ".join(b"w%d" % (i % 91) for i in range(9000)), b"a b"]
    whole = net.logits(raws)
    monkeypatch.setattr(recurrent, "TOGETHER", 7)
    assert np.allclose(net.logits(raws), whole, atol=1e-5)


def test_crowded_buckets(spark, monkeypatch):
    """A passage in many texts: they share blocks and no link, but for the pairs that are alike as a whole."""
    monkeypatch.setattr(near_join, "CROWD", 4)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join([*common, *[f"o{i}_{j}" for j in range(40)]])) for i in range(0, 80, 2)]
    rows += [(i + 1, t.rsplit(" ", 1)[0] + " edit") for i, t in rows[:10]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_join.join(docs).collect()}
    assert got == {i: i - i % 2 if i < 20 else i for i, _ in rows}


def test_neighbours_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = r.standard_normal((700, 24)) * r.uniform(0.5, 2, (700, 1))
    x[300:420] = x[5]  # a group of copies
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(40, [float(v) for v in x[41]])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    got = {}
    for row in neighbours.nearest(vectors.where("vec_id <> 40"), k=20).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    hits = 0
    ids = np.array([i for i in range(700) if i != 40])
    for q, found in got.items():
        s = (x[ids] * x[q]).sum(axis=1)
        s[ids == q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]].tolist()
        hits += len(set(want) & {v for v, _ in found})
        assert len(found) == 20 and [v for v, _ in found] == [v for v, _ in sorted(found, key=lambda p: (-p[1], p[0]))]
    assert set(got) == {q for q in range(0, 700, 20) if q != 40} and hits >= 0.95 * 20 * len(got)
    assert neighbours.nearest(vectors, k=3).where("query_id = 40").count() == 3


AWKWARD = [
    (1, "a b c d", "en", "s1", 7), (2, None, None, None, None), (3, "", "en", None, 0), (4, " \n\t ", None, "s2", 4), (5, " ".join(f"w{i % 977}" for i in range(20_000)), "en", "s1", 1), (9, "a b c d", "en", "s1", 7),
    (9, "a b c d", "en", "s1", 7), (9, "another text of this id", "en", "s1", 7), (None, "null id", "en", "s4", 7), (None, "null id two", "en", "s4", 7), (10, "line one two three\nother", "en", "s1", 3),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, name):
    """Each stage on nulls, empty and long texts, repeated rows, a clashing column and an empty table."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(AWKWARD, COLUMNS).withColumn("copies", F.lit(1)).withColumn("kept", F.lit("x"))
    for rows in (docs, docs.where("false")):
        got = stage(spark, rows, SF).collect()
        ids, texts = Counter(r[0] for r in AWKWARD), Counter((r[0], r[1]) for r in AWKWARD)
        if rows is not docs:
            assert got == []
        elif name == "near_duplicates":
            assert Counter(r.doc_id for r in got)[1] == 1 and all(n <= ids[i] for i, n in Counter(r.doc_id for r in got).items())
        elif name == "pack":
            assert {r.doc_id for r in got} == set(ids)
        elif name == "mix":
            assert set((r.doc_id, r.text) for r in got) <= set(texts)
        elif name == "lines":
            assert Counter((r.doc_id, r.text) for r in got) == texts
        else:
            assert set((r.doc_id, r.text) for r in got) <= set(texts)
        if name != "pack" and got:
            assert got[0].__fields__ == corpus_pipeline.COLUMNS


def test_near_stage_keeps_the_least_of_each_group(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sets = {r.doc_id: near_join.shingles((r.text or "").encode(), 5) for r in docs.collect()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and near_join.linked(sets[a], sets[b], 80):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == {i for i in sets if find(i) == i}
