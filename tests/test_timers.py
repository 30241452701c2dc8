"""Streams with timers against the same rules over finished tables."""

from __future__ import annotations

import datetime
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from textloom.operators import sessions
from textloom.streaming import timers

BEGIN = datetime.datetime(2024, 1, 1)
SCHEMA = "user_id long, ts timestamp, event_id long"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    timers.use_rocksdb(spark)
    yield
    spark.conf.set(name, before)


def replay(spark, folder, batches, build, schema):
    """Rows that a stream gives after batches of a file each."""
    for i, rows in enumerate(batches):
        path = folder / f"in{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
        file = next(path.glob("*.parquet"))
        (folder / "in").mkdir(exist_ok=True)
        file.rename(folder / "in" / f"{i:03d}.parquet")
        stamp = time.time() - 1000 + i
        os.utime(folder / "in" / f"{i:03d}.parquet", (stamp, stamp))
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in")))
    q = stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    assert not q.isActive and q.exception() is None
    return sorted(map(tuple, spark.read.schema(stream.schema).parquet(str(folder / "out")).collect()))


def test_sessions_and_debounce_equal_the_finished_table(spark, tmp_path):
    r = random.Random(2)
    rows = [(u, BEGIN + datetime.timedelta(milliseconds=r.randrange(4 * 3600_000)), 1000 * u + k) for u in range(4) for k in range(40)]
    rows += [(9, BEGIN + datetime.timedelta(minutes=m), m) for m in (0, 5, 10, 16)] + [(9, BEGIN, 99)]  # gaps of just five minutes, a tie
    # out of order by up to ten minutes
    shuffled = sorted(rows, key=lambda x: x[1] + datetime.timedelta(seconds=r.randrange(600)))
    flush = [[(-1, BEGIN + datetime.timedelta(days=d), 0)] for d in (1, 2)]
    table = spark.createDataFrame(rows, SCHEMA)
    numbered = sessions.idle_sessions(table, "user_id", "ts", "event_id").groupBy("user_id", "session").agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b"), F.count("*").alias("n"))
    want = sorted((str(u), a, b, n) for u, a, b, n in map(tuple, numbered.select("user_id", "a", "b", "n").collect()))
    quiet = sessions.settled(table, "user_id", "ts", "event_id", 240_000).select(F.col("user_id").cast("string"), F.unix_micros("ts"), "event_id")
    still = sorted(map(tuple, quiet.collect()))
    for cut in (60, 165):
        batches = [shuffled[i : i + cut] for i in range(0, len(shuffled), cut)] + flush
        (tmp_path / f"s{cut}").mkdir()
        (tmp_path / f"d{cut}").mkdir()
        got = replay(spark, tmp_path / f"s{cut}", batches, lambda s: timers.closed_sessions(s, "user_id", "ts", "event_id", late="11 minutes"), SCHEMA)
        assert [x for x in got if x[0] != "-1"] == want
        got = replay(spark, tmp_path / f"d{cut}", batches, lambda s: timers.debounced(s, "user_id", "ts", "event_id", 240_000, late="11 minutes"), SCHEMA)
        assert [x for x in got if x[0] != "-1"] == still


@pytest.mark.parametrize(("ttl", "kept"), [(3_600_000, "x"), (1, None)])
def test_stored_values_expire(spark, tmp_path, ttl, kept):
    schema = "key string, seq long, cmd string, value string"
    batches = [[("a", 0, "load", None), ("a", 1, "save", "x"), ("a", 2, "load", None), ("b", 3, "save", "y"), ("b", 4, "clear", None)], [("a", 5, "load", None), ("b", 6, "load", None)]]
    (tmp_path / "in").mkdir()
    stream = timers.stored(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ttl)
    # by processing time a stream goes on without data, so it is stopped once it has answered
    q = stream.writeStream.format("memory").queryName(f"stored{ttl}").option("checkpointLocation", str(tmp_path / "c")).start()
    answers = 0
    for i, rows in enumerate(batches):
        part = tmp_path / f"part{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(part))
        next(part.glob("*.parquet")).rename(tmp_path / "in" / f"{i}.parquet")
        answers += 2
        deadline = time.time() + 60
        while spark.table(f"stored{ttl}").count() < answers and time.time() < deadline:
            time.sleep(0.5)
    q.stop()
    got = sorted(map(tuple, spark.table(f"stored{ttl}").collect()), key=lambda x: x[1])
    assert got == [("a", 0, None), ("a", 2, "x"), ("a", 5, kept), ("b", 6, None)]
