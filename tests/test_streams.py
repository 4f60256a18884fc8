"""Streams: state that expires, a cache of what is missing, a fan-out that goes on where it was ended."""

import json
import random

import pytest
from pyspark.sql import functions as F

from proofmill.functions import guards, requests
from proofmill.sources import journals, replay
from proofmill.streaming import journal


def put_files(spark, path, files):
    for rows in files:
        df = spark.createDataFrame(rows, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").option("compression", "none").parquet(path)


def stream_of(spark, path):
    return journal.read(spark, path, spark.read.parquet(path))


def test_limiter_state_shrinks(spark, tmp_path):
    """Clients that stopped asking leave no state behind once the watermark has passed their last request."""
    early = [(i, i % 50, 1_700_000_000 + i) for i in range(200)]
    later = [(1000 + i, 99, 1_700_010_000 + i) for i in range(20)]
    last = [(2000 + i, 99, 1_700_020_000 + i) for i in range(5)]
    path = f"{tmp_path}/in"
    held = []
    for rows in (early, later, last, [(3000, 99, 1_700_030_000)]):
        put_files(spark, path, [rows])
        limited = journal.limited(stream_of(spark, path), "user_id", "ts", 2, 60, "10 seconds")
        job = limited.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
        job.awaitTermination()
        held.append(job.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert held[0] >= 50 and held[-1] < 10, held
    got = {r.event_id: r.allowed for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    times, want = {}, {}
    for i, u, t in [*early, *later, *last, (3000, 99, 1_700_030_000)]:
        times[u] = [x for x in times.get(u, []) if t - x < 60]
        want[i] = len(times[u]) < 2
        times[u] += [t] * want[i]
    assert got == want and set(want.values()) == {True, False}


def test_lookups_remember_what_is_missing(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.randrange(6), 1_700_000_000 + rng.randrange(4000)) for i in range(300)]
    put_files(spark, f"{tmp_path}/in", [rows])
    held = spark.createDataFrame([(0,), (3,)], "user_id long")
    got = {r.event_id: r.outcome for r in journal.drained(journal.looked_up(stream_of(spark, f"{tmp_path}/in"), held, "user_id", "ts", 500)).collect()}
    until, want = {}, {}
    for i, u, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if u in (0, 3):
            want[i] = "hit"
        elif t <= until.get(u, -1):
            want[i] = "missing"
        else:
            want[i], until[u] = "fetch", t + 500
    assert got == want and set(want.values()) == {"hit", "missing", "fetch"}


def test_fan_out_resumes(spark, tmp_path):
    """A run that is ended between batches and started again gives the rows of one run; a batch is computed once."""
    files = [[(10 * b + i, i % 3, 1_700_000_000 + b) for i in range(10)] for b in range(4)]
    put_files(spark, f"{tmp_path}/in", files)
    sinks = {"a": f"{tmp_path}/a", "b": f"{tmp_path}/b"}
    flag = tmp_path / "stop"
    flag.write_text("x")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def watched(i):
        seen.add(1)
        if i % 10 == 7 and 20 <= i < 40 and flag.exists():
            raise RuntimeError("ended")
        return i

    fresh = lambda: stream_of(spark, f"{tmp_path}/in").withColumn("event_id", watched("event_id"))
    spark.range(5).withColumn("batch", F.lit(9)).write.partitionBy("batch").parquet(sinks["b"])  # left by another run
    name = f"scan-{tmp_path.name}"
    with pytest.raises(Exception, match="ended"):
        journal.fanned_out(fresh(), sinks, ["event_id"], name)
    part = spark.read.parquet(sinks["a"]).count()
    flag.unlink()
    before = seen.value
    journal.fanned_out(fresh(), sinks, ["event_id"], name)
    want = sorted(r[0] for rows in files for r in rows)
    for path in sinks.values():
        assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == want
    assert part < 40 and seen.value - before == 40 - part
    journal.fanned_out(fresh(), sinks, ["event_id"], name)  # nothing is left to do
    assert spark.read.parquet(sinks["b"]).count() == 40


def events_of(n):
    return [(f"case-{i % 3}", 1, f"s{i % 3}-{i:06d}", None, f"s{i % 3}", i, "stage", '{"q":"call 9876543210","n":1}') for i in range(n)]


def test_bundles(spark, tmp_path):
    """Bundles read the same as a table and as a stream; broken lines come with their rule."""
    events = spark.createDataFrame(events_of(30), f"case STRING, {journals.EVENT}")
    cards = spark.createDataFrame([("case-0", '{"t":"PAN ABCDE1234F"}'), ("case-1", "{}"), ("../x", "{}")], "case string, card string")
    replay.write_bundles(events, cards, "case", f"{tmp_path}/home")
    home = f"{tmp_path}/home/events"
    read = replay.read_bundles(spark, home)
    assert {(r.case, r["count"]) for r in read.groupBy("case").count().collect()} == {("case-0", 10), ("case-1", 10)}
    assert read.where("rule is null").count() == 20 and read.where("data like '%9876543210%'").count() == 0
    assert "[pan]" in spark.read.text(f"{tmp_path}/home/cards/case=case-0").first().value

    bad = tmp_path / "old" / "case-9"
    bad.mkdir(parents=True)
    fine = '{"v":1,"id":"s-000001","scan":"s","t_ns":5,"type":"stage","data":{"a":[1,"x"]}}'
    lines = [fine, "{", fine.replace('"v":1', '"v":"one"'), fine.replace('"type":"stage",', ""), fine.replace('"s-', '"t-'), "", fine.replace('"x"', '"' + "x" * 5000 + '"')]
    (bad / "events.jsonl").write_text("\n".join(lines))
    got = [r.rule for r in replay.read_bundles(spark, f"{tmp_path}/old").collect()]
    assert got == [None, "json", "schema", "schema", "id", "size"]
    assert replay.playable(replay.read_bundles(spark, f"{tmp_path}/old")).count() == 0 and replay.playable(read).count() == 20
    streamed = journal.drained(replay.stream_bundles(spark, home))
    assert sorted(map(str, streamed.collect())) == sorted(map(str, read.collect()))


def scrubbed(value, one):
    if isinstance(value, dict):
        return {k: scrubbed(v, one) for k, v in value.items()}
    return [scrubbed(v, one) for v in value] if isinstance(value, list) else one(value) if isinstance(value, str) else value


def test_scrub_values(spark):
    """Each nested string by itself, keys untouched, against a walk over the parsed value."""
    good = "2345 6789 012" + str(guards.check_digit("23456789012"))
    strings = ["", "plain", "PAN ABCDE1234F", 'say "hi" \\ back\\"', "https://x/?api_key=zz", "tab\there\nline é漢", "call 9876543210", f"no {good} and 2345 6789 0123", "\\\\", 'a":', "bearer"]
    values = [{"ABCDE1234F": s, "list": [s, 1, None, [True, {"deep": s, "n": 12345678901234567890}]], "end": t} for s, t in zip(strings, strings[1:] + [""], strict=True)] + [["x", "abc@d.example"], {}, [], "only a string", 5, None]
    lines = [json.dumps(v, ensure_ascii=e) for v in values for e in (True, False)] + ["{", "not json"]
    got = [r.x for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, line string").orderBy("i").select(requests.scrub_values(F.col("line")).alias("x")).collect()]
    safe = {s: r for s, r in spark.createDataFrame([(s,) for s in {*strings, "x", "abc@d.example", "only a string"}], "s string").select("s", guards.mask_pii(guards.redact(F.col("s")))).collect()}
    assert got[-2:] == [None, None]
    for line, x in zip(lines[:-2], got[:-2], strict=True):
        assert json.loads(x) == scrubbed(json.loads(line), safe.__getitem__), line
