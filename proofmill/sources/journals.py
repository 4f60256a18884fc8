"""Sources and sinks (SRC-3, SRC-8, SRC-9, SRC-12, SNK-1, SNK-3, SNK-4, SNK-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from proofmill.functions.requests import public_id, scrub, scrub_values
from proofmill.operators.containment import containing

EVENT = "v INT, id STRING, parent STRING, scan STRING, t_ns BIGINT, type STRING, data STRING"
MOST_CHARS = 4096


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines; lines that don't parse raise an error."""
    return spark.read.schema(EVENT).option("mode", "FAILFAST").json(path)


def emitted(rows: DataFrame, scan: str, order: list[str], key: str, parent: str) -> DataFrame:
    """Journal events of ``rows`` (scan, order, key, parent: the key of another row of the scan; t_ns, type, data): ids count
    a scan's events in order, a parent's key becomes its id (null if the scan lacks it), string values of data are scrubbed
    one by one, and ``fits`` tells whether the line is short enough for the journal (SNK-3, JSN-1, WIN-8)."""
    n = F.row_number().over(Window.partitionBy(scan).orderBy(*order))
    told = rows.withColumn("id", F.format_string("%s-%06d", F.col(scan).cast("string"), n))
    ids = told.select(F.col(scan).alias("_scan"), F.col(key).alias("_key"), F.col("id").alias("_id"))
    linked = told.join(ids, (F.col(scan) == F.col("_scan")) & (F.col(parent) == F.col("_key")), "left")
    event = linked.select(F.lit(1).alias("v"), "id", F.col("_id").alias("parent"), F.col(scan).cast("string").alias("scan"), "t_ns", "type", scrub_values(F.col("data")).alias("data"))
    return event.withColumn("fits", F.length(F.to_json(F.struct(*event.columns))) <= MOST_CHARS)


def append_uses(uses: DataFrame, path: str) -> None:
    """Uses are appended as they come; a use that is logged twice is two uses (SNK-6)."""
    uses.write.mode("append").parquet(path)


def case_names(cards: DataFrame, name: str) -> DataFrame:
    """Names of saved cases, each once, sorted; those that may not stand in a path are left out (SRT-8, FLT-18)."""
    return cards.where(public_id(F.col(name))).select(name).distinct().orderBy(name)


def find_scans(events: DataFrame, cards: DataFrame, wanted: DataFrame, prefix: str) -> DataFrame:
    """``prefix``, scan: for each wanted part of a file's digest the first scan, by name, whose first event names a file with
    it and that has a card (JN-16). ``events``: scan, id, data; ``cards``: scan."""
    first = events.groupBy("scan").agg(F.min_by("data", "id").alias("data")).join(cards.select("scan"), "scan", "left_semi")
    named = first.select("scan", F.get_json_object("data", "$.sha256").alias("sha256")).where("sha256 is not null")
    return containing(named, wanted, "scan", "sha256", prefix).groupBy(prefix).agg(F.min("scan").alias("scan"))


def write_events(events: DataFrame, path: str, fresh: bool = False) -> int:
    """Appends events (or starts anew); those over 4096 characters go beside it, to ``path``-rejected. Their number."""
    fits = F.length(F.to_json(F.struct(*events.columns))) <= MOST_CHARS
    mode = "overwrite" if fresh else "append"
    events.where(fits).write.mode(mode).json(path)
    rejected = events.where(~fits)
    rejected.write.mode(mode).json(f"{path.rstrip('/')}-rejected")
    return rejected.count()


def export_events(events: DataFrame, path: str) -> None:
    """Events as scrubbed lines; a line that scrubbing breaks is left out of the bundle (SNK-8)."""
    lines = events.select(scrub(F.to_json(F.struct(*events.columns))).alias("value"))
    lines.where("value is not null").write.mode("overwrite").text(path)


def write_cards(cards: DataFrame, path: str, scan: str) -> None:
    """A JSON file for each scan's cards, partitioned by the scan (SNK-4)."""
    cards.repartition(scan).write.partitionBy(scan).mode("overwrite").json(path)


def find_card(cards: DataFrame, recorded: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """Saved cards by name, recorded ones first; a name that may not stand in a path finds nothing (SRC-9, FLT-18)."""
    fine = wanted.where(public_id(F.col(name)))
    both = fine.join(recorded.select(name, F.col("card").alias("_r")), name, "left").join(cards.select(name, F.col("card").alias("_c")), name, "left")
    return both.select(name, F.coalesce("_r", "_c").alias("card")).where("card is not null")


def read_files(spark: SparkSession, path: str, most_bytes: int = 40 << 20) -> DataFrame:
    """Files with their hash and, where they aren't taken, the rule that rejects them."""
    files = spark.read.format("binaryFile").load(path)
    rule = F.when(~F.lower("path").endswith(".pdf"), "suffix").when(F.col("length") > most_bytes, "size").when(F.substring("content", 1, 4) != F.lit(b"%PDF"), "magic")
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), rule.alias("rule"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def verify_blobs(blobs: DataFrame) -> DataFrame:
    """Bodies that differ from their digest."""
    return blobs.where(F.sha2("body", 256) != F.col("sha256"))
