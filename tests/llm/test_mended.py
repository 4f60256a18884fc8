"""Cases that once went wrong: keys, costs, samples, small sources, texts of very many lines."""

import time

import pytest
from pyspark.sql import functions as F

from proofmill.llm import labelled, line_dedup, mixing, quality_rules, substring_dedup
from proofmill.llm.recurrent import WINDOW, Words


def test_toxicity_windows():
    """A phrase of up to half a window lies whole in some window, wherever it starts."""
    from proofmill.llm.recurrent import WINDOW, Words

    for n in (1, 16, 32, 33, 48, 49, 100, 257):
        start, length, _ = Words([" ".join(f"w{i}" for i in range(n)).encode()]).windows(1)
        spans = list(zip(start.tolist(), length.tolist(), strict=True))
        size = min(n, WINDOW // 2)
        assert all(any(s <= i and i + size <= s + m for s, m in spans) for i in range(n - size + 1))


def test_rows_of_one_id_whose_texts_share_hash_bits(spark):
    """Two texts that agree in 31 bits of a hash are still documents of their own."""
    words = lambda i: " ".join(f"u{i}x{j}" for j in range(25))
    texts = spark.range(200_000).select(F.col("id"), F.expr("array_join(transform(sequence(0, 24), j -> concat('u', id, 'x', j)), ' ')").alias("text"))
    pair = texts.groupBy(F.hash("text").bitwiseAND((1 << 31) - 1).alias("h")).agg(F.collect_list("id").alias("ids")).where("size(ids) > 1").first().ids[:2]
    docs = spark.createDataFrame([(5, words(pair[0])), (5, f"{words(pair[0])} {words(pair[1])}"), (5, words(pair[1])), (None, words(7)), (-(1 << 63), words(7))], "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.dedup(docs).collect())
    assert sum(g[3] for g in got if g[1] == 5) == 50 and [g[3] for g in got if g[1] != 5] == [0, 25] and got[0][0] is False


def test_slow_rules_cost_more_and_go_last(spark):
    """Costs are those of evaluating the rules, whatever ran before."""
    docs = spark.range(400).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("word"), i.cast("string"))), " ").alias("text"))
    sample = quality_rules.written(quality_rules.base(docs.select(F.col("id").alias("doc_id"), "text")), "sample")
    slow = "length(regexp_replace(regexp_replace(regexp_replace(text, '[^a-m]+', ''), '(a|b|o|r)+', ''), '[^x]', '')) >= 0 and n_words > 0"
    rules = {"slow": slow, "fast": "n_words > 0", "none": "n_words < 0"}
    cost = quality_rules.costs(sample, rules)
    assert cost["slow"] > cost["fast"] and cost["slow"] > 10 * quality_rules.LEAST_COST
    names = quality_rules.order(cost, quality_rules.rejected(sample, rules))
    assert names[0] == "fast" and names.index("slow") > 0


def test_a_long_text_takes_no_other_texts_place(spark):
    """The sample goes on after a text that is too long for it; an empty class gives a warning."""
    docs = spark.createDataFrame([(i, "x" * (14_000 if i == 7 else 90)) for i in range(40)] + [(100, "y" * 9000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic long")
    got = labelled.labelled(docs, labels, F.col("toxic"), {0: 50, 1: 50}, chars=20_000)
    assert sorted(r.doc_id for r in got.collect()) == [i for i in range(40) if i != 7]
    with pytest.warns(UserWarning, match="too long"):
        assert labelled.labelled(docs, spark.createDataFrame([(100, 1)], "doc_id long, toxic long"), F.col("toxic"), {0: 5, 1: 5}, chars=20_000).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_every_source_comes_near_its_target(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert rows and all(abs(r.taken - r.target) <= 0.05 * r.target for r in rows)


def test_last_document_is_rounded_where_others_can_settle_it(spark):
    """One large document among small ones: whatever chance says, the words come near the target."""
    for seed in range(6):
        docs = spark.createDataFrame([(0, "w " * 3000, "a")] + [(i, "w " * 40, "a") for i in range(1, 60)] + [(100 + i, "w " * 900, "b") for i in range(20)], "doc_id long, text string, source string")
        rows = mixing.mix(docs, seed=seed).groupBy("source_size").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
        assert all(abs(r.taken - r.target) <= max(100, 900 * (r.source_size == 18000)) for r in rows)


def test_texts_of_very_many_lines(spark):
    """The work of a text grows with its lines, not with lines times removed lines."""
    def seconds(n):
        line = lambda i: f"line number {i} of all"
        docs = spark.createDataFrame([(d, "\n".join(line(i) for i in range(n)), f"s{d}") for d in range(12)], "doc_id long, text string, source string")
        began = time.perf_counter()
        got = line_dedup.dedup(docs).select("doc_id", "n_removed", F.length("text").alias("left")).collect()
        took = time.perf_counter() - began
        assert sorted((r.n_removed, r.left > 0) for r in got) == [(0, True)] + [(n, False)] * 11
        return took

    seconds(1000)
    assert seconds(40_000) < 60
