"""A training corpus from the documents table, in five stages; each takes what the one before it kept.

Stages return the columns of documents but for the last, which returns the packed pieces; other columns go, whatever
their names. Null and empty texts: graded as empty by quality (so they go or stay alike), without lines, never near
duplicates, no words to the mix (so it takes none of them), an end id each to the packer. Rows that share an id or have
none: documents of their own to quality, lines, mix and pack; of rows of one id near_duplicates keeps all or none, and all
without an id. Very long texts are taken whole. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import line_dedup, mixing, near_join, packing, quality_classifier
from proofmill.llm.store import discard, documents, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.grade(docs.select(*COLUMNS), model).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources share go from all documents but the first."""
    return line_dedup.dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id."""
    kept = written(near_join.join(docs).where("doc_id = component_id or doc_id is null").select("doc_id").distinct(), "kept")
    return docs.alias("d").join(kept.alias("k").hint("merge"), F.expr("d.doc_id <=> k.doc_id"), "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: A fitted classifier and seeded draws can't be told in SQL; tests hold the operators and near_duplicates against brute
#: force, the other stages against what they must keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each returns is stored in the shared folder until the next one's stands."""
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
