"""Quality rules as a short-circuit cascade, in DataFrame operations alone.

Each rule is a boolean expression over the text and the base counts. A bounded random sample tells each rule's cost
(seconds of a job that evaluates it REPEATS times on each row, less those of a job that evaluates none) and which rows
it rejects. The order is chosen step by step: of the rules that are left the one that rejects most per second among the
rows that no earlier one rejects. Rules are chained in one CASE, which stops at the first rule that rejects. The order
changes the time alone, never the verdict. The base counts are wanted for every row and computed for every row, so the
cascade saves the rules alone.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm.store import GAP, WHITE, discard, documents, written

#: Rows that rules are timed on (as many as a random sample of that share of all rows has), and how often each is
#: evaluated on a row.
SAMPLE_ROWS, REPEATS = 1_000, 8
#: Seconds that a rule costs at least: less can't be told from the job's own time.
LEAST_COST = 0.005

#: Rules of the verdict; each is true where a document is rejected.
RULES = {
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "n_dup_lines > 2 and 10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "capitals": "2 * length(regexp_replace(text, '[^\\\\p{Lu}]+', '')) > word_chars",
    "shouting": "4 * regexp_count(text, '!!') > n_words",
    "few_letters": "2 * length(regexp_replace(text, '[^\\\\p{L}]+', '')) < word_chars",
    "few_distinct_words": "n_words >= 100 and 10 * size(array_distinct(words)) < n_words",
}


def base(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with words, n_lines, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null or empty text has no words and all counts 0. The three-word windows of a text are compared by 64-bit hashes
    chained over their words; only texts in which some window comes back are sorted by hash and place to see which
    words those windows cover.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), words.alias("words"), lines.alias("lines"))

    last = F.size("words") - 3
    hashes = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.col("words")[i], F.col("words")[i + 1], F.col("words")[i + 2])))
    counted = read.select(
        "doc_id",
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("hashes"),
    )
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("hashes")) < F.size("hashes")
    repeat = counted.withColumn("placed", F.when(some, placed))
    twin = lambda x, i: F.when((x["h"] == F.get("placed", i - 1)["h"]) | (x["h"] == F.get("placed", i + 1)["h"]), x["i"])
    starts = F.sort_array(F.filter(F.transform("placed", twin), lambda i: i.isNotNull()))
    covered = repeat.withColumn("starts", F.when(F.col("placed").isNotNull(), starts))
    new = F.transform("starts", lambda s, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), s - F.get("starts", i - 1))))
    n_repeat = F.coalesce(F.aggregate(new, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    done = covered.withColumn("n_repeat_words", n_repeat).drop("hashes", "placed", "starts")
    return done.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _seconds(sample: DataFrame, rule: str) -> float:
    """The shortest of three jobs that evaluate the rule REPEATS times on each row; each job is planned anew, as a plan that
    has run gives its exchange's result again without evaluating anything."""
    took = []
    for _ in range(3):
        job = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("again")).agg(F.count_if(F.expr(rule) & (F.col("again") > 0)))
        began = time.perf_counter()
        job.collect()  # one number
        took.append(time.perf_counter() - began)
    return min(took)


def costs(sample: DataFrame, rules: dict[str, str]) -> dict[str, float]:
    """Seconds of each rule beyond those of a rule that looks at nothing. ``sample``: stored rows of ``base``."""
    empty = min(_seconds(sample, "again < 0") for _ in range(2))  # the first also warms up
    return {name: max(_seconds(sample, rule) - empty, LEAST_COST) for name, rule in rules.items()}


def rejected(sample: DataFrame, rules: dict[str, str]) -> dict[frozenset[str], int]:
    """Sets of rules that reject a row, with the number of such rows."""
    which = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items()])) if rules else F.array().cast("array<string>")
    return {frozenset(r["which"]): r["count"] for r in sample.groupBy(which.alias("which")).count().collect()}  # no more than the sample has


def order(cost: dict[str, float], sets: dict[frozenset[str], int]) -> list[str]:
    """Names of the rules: each time the one that rejects most per second of what is left, then the cheaper one."""
    names, left = [], dict(sets)
    while len(names) < len(cost):
        rest = [n for n in cost if n not in names]
        best = max(rest, key=lambda n: (sum(c for s, c in left.items() if n in s) / cost[n], -cost[n]))
        names.append(best)
        left = {s: c for s, c in left.items() if best not in s}
    return names


def cascade(names: list[str], rules: dict[str, str]) -> Column:
    """False at the first rule that rejects; later rules aren't evaluated for that row."""
    verdict = F.when(F.col("base_failed"), False)
    for name in names:
        verdict = verdict.when(F.expr(rules[name]), False)
    return verdict.otherwise(True)


def judge(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """Base counts and verdict of each row of ``docs`` (doc_id, text): doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept. Repeated rows are judged alike; other columns are ignored; an empty
    table gives no rows. The result is a stored table: a filter on it repeats no counts."""
    rules = RULES if rules is None else rules
    n = docs.count()
    chosen = docs.select("doc_id", "text").sample(fraction=min(1.0, SAMPLE_ROWS / max(n, 1)), seed=7)
    sample = written(base(chosen), "rules-sample")
    open_ = sample.where("not base_failed")
    names = order(costs(open_, rules), rejected(open_, rules))
    discard(sample)
    judged = base(docs).withColumn("kept", cascade(names, rules))
    return written(judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), "judged")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
