"""What the operators share: stored tables, words, the documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.sources.stored import BROADCAST_ROWS, discard, files_of, shared_dir, small, written

__all__ = ["BROADCAST_ROWS", "GAP", "WHITE", "WORD", "discard", "documents", "files_of", "shared_dir", "small", "word_count", "written"]

#: ASCII white space; words are runs of anything else.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
