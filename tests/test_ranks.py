"""Places and percentiles over all rows, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofmill.operators.ranks import percentiles, ranked


def test_ranked(spark):
    rows = [(i, "a" if i % 3 else None, (i * 7919) % 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, rank string, v long").repartition(7)
    got = ranked(df, -F.col("v"), F.col("id"), name="at").orderBy("at").collect()
    assert [r.at for r in got] == list(range(1, 3001))
    assert [(r.id, r["rank"]) for r in got] == [(i, s) for i, s, v in sorted(rows, key=lambda r: (-r[2], r[0]))]


def test_ranked_ties_alone(spark):
    got = ranked(spark.range(500).select(F.lit(1).alias("x")), F.col("x"), name="at")
    assert sorted(r.at for r in got.collect()) == list(range(1, 501))
    assert ranked(spark.range(0), F.col("id"), name="at").count() == 0


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_percentiles(spark, q):
    rng = np.random.default_rng(4)
    rows = [(["hot", "hot", "hot", "b", None][i % 5], None if i % 11 == 0 else float(rng.integers(0, 90)) / 7) for i in range(2000)] + [("one", 3.0)]
    got = {r.k: r.p for r in percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p": q}).collect()}
    for k in {k for k, _ in rows}:
        assert got[k] == pytest.approx(np.quantile([v for x, v in rows if x == k and v is not None], q), abs=1e-12)
