"""Tables between jobs, written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast (a few MB at most), counted before it is.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application below ``spark.checkpoint.dir``; it goes when the driver ends. Only a local master may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jvm.get() if jvm.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="proofmill-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/proofmill-{spark.sparkContext.applicationId}"


def files_of(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df``, written as Parquet to the shared folder and read again: what follows no longer depends on executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    files, at = files_of(spark, path)
    files.deleteOnExit(at)
    spark.sparkContext._jvm.System.gc()  # Spark removes shuffle files when the driver collects what refers to them
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that all successors of are stored, so that disk holds what is still needed alone."""
    for table in tables:
        files, at = files_of(table.sparkSession, table.stored_at)
        files.delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored ``df`` with a broadcast hint if it has at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint, its partitions and their order kept, in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark).rpartition("/")[0])
    return df.checkpoint()
