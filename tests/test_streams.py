import datetime as dt
import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from depotlens import schemas
from depotlens.operators import ingest
from depotlens.plans import Inventory, Store
from depotlens.streaming import progress, sinks, ticker

EVENT = "client_key string, scan_id long, ts timestamp_ntz, listed long, done int, ended boolean, number int"
ZERO = dt.datetime(2024, 1, 1)


def events(n=400, seed=6):
    """Scans of a few clients, in order of time; each ends at its last event, but one never ends."""
    rng, rows, at = random.Random(seed), [], 0
    for number in range(n):
        at += rng.choice([0, 1, 3, 40])
        scan = number // 60
        rows.append([f"c{rng.randrange(3)}", scan, ZERO + dt.timedelta(seconds=at, milliseconds=rng.randrange(1000)), rng.choice([None, 0, 5]), rng.choice([0, 1]), False, number])
    last = {}
    for r in rows:
        last[r[0], r[1]] = r
    for (client, scan), r in last.items():
        r[5] = (client, scan) != ("c0", 1)
    rows += [[None, 1, ZERO, 1, 1, False, n], ["c1", None, ZERO, 1, 1, False, n]]
    return [tuple(r) for r in sorted(rows, key=lambda r: r[2])]


def plain(rows, every, late):
    rows = [r for r in rows if r[0] is not None and r[1] is not None]
    ms = lambda t: (t - ZERO) // dt.timedelta(milliseconds=1)
    now = max(ms(r[2]) for r in rows) - late * 1000
    out = []
    for key in {(r[0], r[1]) for r in rows}:
        mine = [r for r in rows if (r[0], r[1]) == key]
        start, ends = min(ms(r[2]) for r in mine), [ms(r[2]) for r in mine if r[5]]
        end = max(ends) if ends else None
        over = end is not None and end < now
        at = start + every * 1000
        marks = []
        while at < (end if over else now):
            marks.append((at, False))
            at += every * 1000
        marks += [(end, True)] if over else []
        for at, final in marks:
            seen = [r for r in mine if ms(r[2]) <= at]
            done = sum(r[4] for r in seen)
            out.append((*key, at, done, sum(r[3] or 0 for r in seen) - done, (at - start) // 1000, final))
    return sorted(out)


def taken(df):
    at = F.unix_millis("ts") - int(ZERO.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    return sorted(tuple(r) for r in df.select("client_key", "scan_id", at, "processed_count", "active_count", "elapsed_in_sec", "final").collect())


def write_in_parts(spark, rows, schema, folder, parts):
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.parquet(f"{folder}/{k:03d}")


def add(source, to, k):
    """One more file for the stream to find."""
    to.mkdir(exist_ok=True)
    for p in (source / f"{k:03d}").glob("part-*.parquet"):
        new = shutil.copy(p, to / f"{k:03d}-{p.name}")
        os.utime(new, (1_700_000_000 + k, 1_700_000_000 + k))  # files are read in order of time


def test_ticks_at_rest(spark):
    rows = events()
    want = plain(rows, 7, 100)
    assert len(want) > 300 and sum(r[-1] for r in want) > 10
    assert taken(ticker.ticks_of(spark.createDataFrame(rows, EVENT), 7, 100_000)) == want


@pytest.mark.parametrize("parts", [1, 5])
def test_a_replay_gives_the_snapshots_of_the_batch(spark, tmp_path, parts):
    rows = events()
    write_in_parts(spark, rows, EVENT, tmp_path / "all", parts)
    for k in range(parts):
        add(tmp_path / "all", tmp_path / "in", k)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert taken(sinks.run(ticker.ticks(stream, 7, "100 seconds"), state=sinks.state_store.ROCKSDB)) == plain(rows, 7, 100)


def test_a_restart_repeats_nothing(spark, tmp_path):
    rows = events()
    write_in_parts(spark, rows, EVENT, tmp_path / "all", 4)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for k in range(4):
        add(tmp_path / "all", tmp_path / "in", k)
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        with sinks.state_store(spark, sinks.state_store.ROCKSDB):
            sinks.append_files(ticker.ticks(stream, 7, "100 seconds"), out, checkpoint).awaitTermination()
        got = taken(spark.read.parquet(out))
        assert got == plain(rows[: (k + 1) * len(rows) // 4], 7, 100) or k < 3
    assert got == plain(rows, 7, 100)


def messages(spark, tmp_path, n=90):
    rng = random.Random(2)
    rows = [("u", f"m{rng.randrange(40)}", rng.choice(["t", None]), f"s{i}", ZERO + dt.timedelta(seconds=i // 3)) for i in range(n)]
    rows.append(("u", "x" * 201, "t", "too wide", ZERO))
    schema = "username string, message_id string, thread_id string, subject string, date timestamp_ntz"
    write_in_parts(spark, rows, schema, tmp_path / "all", 3)
    return rows, schema


def test_a_mail_stream_stores_each_message_once(spark, tmp_path, monkeypatch):
    """Stopped between batches, and once between the publishing of a batch and the stream's note of it."""
    rows, schema = messages(spark, tmp_path)
    store = Store(spark, str(tmp_path / "store"))
    store.ensure()
    rejected = []
    start = lambda: sinks.mail_sink(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), store, 1, str(tmp_path / "checkpoint"), order=("date", "subject"), bad=lambda b, n: rejected.append(b.count()))
    add(tmp_path / "all", tmp_path / "in", 0)
    start().awaitTermination()
    add(tmp_path / "all", tmp_path / "in", 1)
    append = Store.append

    def dies(self, *a):
        append(self, *a)
        raise RuntimeError("the machine went away")

    monkeypatch.setattr(Store, "append", dies)
    with pytest.raises(Exception, match="went away"):
        start().awaitTermination()
    monkeypatch.setattr(Store, "append", append)
    add(tmp_path / "all", tmp_path / "in", 2)
    start().awaitTermination()
    got = store.read("messagemetadata")
    want = ingest.dedupe_messages(spark.createDataFrame([r for r in rows if len(r[1]) < 200], schema), order=("date", "subject"))
    key = lambda df: sorted((r.username, r.message_id, str(r.thread_id), r.subject) for r in df.collect())
    assert key(got) == key(want)
    assert sorted(r.id for r in got.collect()) == list(range(1, got.count() + 1)) and sum(rejected) == 1


def test_a_mail_stream_leaves_out_what_other_scans_stored(spark, tmp_path):
    rows, schema = messages(spark, tmp_path)
    store = Store(spark, str(tmp_path / "store"))
    store.ensure()
    store.append({"messagemetadata": spark.createDataFrame([(1, "m1", "t", "u", 9)], "id long, message_id string, thread_id string, username string, scan_id long")}, 9)
    for k in range(3):
        add(tmp_path / "all", tmp_path / "in", k)
    sinks.mail_sink(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, 1, str(tmp_path / "cp"), order=("date", "subject")).awaitTermination()
    assert store.read("messagemetadata").filter("message_id = 'm1' AND thread_id = 't'").count() == 1


def test_results_of_streams_are_files(spark, tmp_path):
    spark.range(100).select(F.col("id") % 7, F.lit(ZERO).alias("ts"), F.lit("e").alias("event_type")).toDF("scan_id", "ts", "event_type").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("scan_id long, ts timestamp_ntz, event_type string").parquet(str(tmp_path / "in"))
    counted = sinks.run(progress.progress(stream.withColumn("done", F.lit(True))), "complete")
    assert sorted(r.processed_count for r in counted.collect()) == [14] * 5 + [15] * 2
    empty = spark.readStream.schema(schemas.ddl("version")).parquet(str(tmp_path / "none")) if (tmp_path / "none").mkdir() is None else None
    assert sinks.run(empty.groupBy("id").count(), "complete").count() == 0 and sinks.run(empty).count() == 0


def test_facade_streams(spark, tmp_path):
    inventory = Inventory(spark, str(tmp_path / "store"))
    raw = [json.dumps({"id": f"m{i % 5}", "threadId": "t", "labelIds": ["INBOX"], "internalDate": 1704067200000 + i, "sizeEstimate": i}) for i in range(9)]
    (tmp_path / "mail").mkdir()
    (tmp_path / "mail" / "a.json").write_text("\n".join(raw))
    stream = spark.readStream.schema(schemas.MESSAGE).json(str(tmp_path / "mail"))
    scan = inventory.stream_mail(stream, "u", ZERO, str(tmp_path / "cp"))
    assert inventory.list_messages(scan)[1] == 5 and inventory.scan(scan).status == "Completed"
    (tmp_path / "mail" / "b.json").write_text(raw[0].replace("m0", "m9"))
    inventory.stream_mail(stream, "u", ZERO, str(tmp_path / "cp"), scan_id=scan)
    assert inventory.list_messages(scan)[1] == 6
    write_in_parts(spark, events(), EVENT, tmp_path / "all", 1)
    add(tmp_path / "all", tmp_path / "in", 0)
    source = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    inventory.progress_stream(source, str(tmp_path / "out"), str(tmp_path / "cp2"), 7, "100 seconds").awaitTermination()
    assert taken(spark.read.parquet(str(tmp_path / "out"))) == plain(events(), 7, 100)
