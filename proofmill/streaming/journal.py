"""The event journal as a stream (STM-1 to STM-5, STM-7, SNK-2; windows are an extension)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from proofmill.sources.stored import files_of, shared_dir


def read(spark: SparkSession, path: str, like: DataFrame, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def once(events: DataFrame, key: list[str], at: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each key once: whatever is sent again within the delay, or without ``at`` again at any time. The latter drops no
    late row and keeps all keys in the stream's state, on the executors."""
    if at is None:
        return events.dropDuplicates(key)
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def _drain(stream: DataFrame, at: str) -> None:
    job = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start(f"{at}/rows")
    job.awaitTermination()


def drained(stream: DataFrame) -> DataFrame:
    """All that the stream has to read, written as Parquet to the shared folder and read again; it goes when the driver ends."""
    spark, at = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/journal-{uuid.uuid4().hex}"
    _drain(stream, at)
    files, path = files_of(spark, at)
    files.deleteOnExit(path)
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def _micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


class Limiter(StatefulProcessor):
    """A client's allowed requests that still count; a timer ends them when the watermark has passed the last one's end."""

    def __init__(self, by: str, most: int, micros: int):
        self.by, self.most, self.micros = by, most, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.allowed = handle.getListState("allowed", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        batch = pd.concat(list(rows))
        batch = batch.assign(at=_micros(batch["at"])).sort_values(["at", "event_id"])
        held = [t for (t,) in self.allowed.get()]
        fine = []
        for t in batch["at"].tolist():
            held = [h for h in held if t - h < self.micros]
            fine.append(len(held) < self.most)
            if fine[-1]:
                held.append(t)
        self.allowed.put([(t,) for t in held])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.handle.registerTimer((held[-1] + self.micros) // 1000 + 1)
        yield pd.DataFrame({self.by: [key[0]] * len(fine), "event_id": batch["event_id"].to_numpy(), "allowed": fine})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.allowed.clear()
        return iter(())

    def close(self) -> None:
        pass


class NegativeCache(StatefulProcessor):
    """Until when a key is known to be missing; a timer forgets it."""

    def __init__(self, key: str, micros: int):
        self.key, self.micros = key, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = list(rows)
        batch = parts[0] if len(parts) == 1 else pd.concat(parts)
        batch = batch.assign(at=_micros(batch["at"]))
        if len(batch) > 1:
            batch = batch.sort_values(["at", "event_id"])
        known = self.until.get()
        was = until = known[0] if known else None
        told = []
        for t in batch["at"].tolist():
            if until is not None and t <= until:
                told.append("missing")
            else:
                told.append("fetch")
                until = t + self.micros
        # Each call goes to the executor and back, so what hasn't changed isn't set again.
        if until != was:
            self.until.update((until,))
            if was is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            self.handle.registerTimer(until // 1000 + 1)
        yield pd.DataFrame({self.key: [key[0]] * len(told), "event_id": batch["event_id"].to_numpy(), "outcome": told})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def _with_state(rows: DataFrame, key: str, processor: StatefulProcessor, out: str, late: str) -> DataFrame:
    """Timers and expiring state need the state store on RocksDB, which is set for the session's streams."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = rows.schema[key].dataType.simpleString()
    return rows.withWatermark("at", late).groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, event_id long, {out}", "Append", "EventTime")


def limited(events: DataFrame, by: str, at: str, most: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """by, event_id, allowed: a client's request is refused when ``most`` allowed ones lie less than ``seconds`` back (STM-3).

    Requests are taken in the order of their times (then event_id) within a batch; a client's times and ids of one batch
    are held at once, so a batch's files bound it. State: a client's allowed times that still count. It ends when the
    watermark, ``late`` behind the greatest time, has passed them; requests that come later than that are dropped.
    """
    timed = events.select(by, "event_id", F.col(at).cast("timestamp").alias("at"))
    return _with_state(timed, by, Limiter(by, most, seconds * 1_000_000), "allowed boolean", late)


def looked_up(requests: DataFrame, held: DataFrame, key: str, at: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """key, event_id, outcome of each request (STM-4): ``hit`` if ``held`` (a table: key, each once) has an answer, else
    ``fetch``, and ``missing`` for requests up to ``seconds`` after a fetch, which isn't made again so soon. State: a
    missing key's end, forgotten when the watermark has passed it; lateness as in ``limited``, but for hits, which are never
    dropped."""
    timed = requests.select(key, "event_id", F.col(at).cast("timestamp").alias("at"))
    # An answer that is held needs no state.
    hits = timed.join(held.select(key), key, "left_semi").select(key, "event_id", F.lit("hit").alias("outcome"))
    return _with_state(timed.join(held.select(key), key, "left_anti"), key, NegativeCache(key, seconds * 1_000_000), "outcome string", late).unionByName(hits)


def fanned_out(stream: DataFrame, sinks: dict[str, str], key: list[str], scan: str | None = None) -> None:
    """Each batch, without repeated keys, to several Parquet folders (SNK-2). A batch is computed once, for the first
    folder; the others copy what that holds.

    ``scan`` names the checkpoint in ``spark.checkpoint.dir``, so a run that was ended goes on where it stopped when it is
    started again under its name (STM-7): the batch that was open is written anew, in place of what it had written, as its
    number names its folder. The first batch of a scan removes what other runs have left in the folders. Without a name
    each call is a run of its own.
    """
    spark = stream.sparkSession
    folder = shared_dir(spark).rpartition("/")[0]  # not this application's own, which ends with it
    at = f"{folder}/fan-{scan or uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        paths = [*sinks.values()]
        if number == 0:
            for path in paths:
                files, gone = files_of(spark, path)
                files.delete(gone, True)
        batch.dropDuplicates(key).write.mode("overwrite").parquet(f"{paths[0]}/batch={number}")
        for path in paths[1:]:
            spark.read.schema(batch.schema).parquet(f"{paths[0]}/batch={number}").write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()


def counts(events: DataFrame, at: str, by: str, width: str, late: str = "1 hour") -> DataFrame:
    """Tumbling counts."""
    grouped = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width), by).count()
    return grouped.select(F.col("window.start").alias("start"), by, "count")
