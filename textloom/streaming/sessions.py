"""Player sessions as a stream: commands in order, state by session, results of an outdated epoch dropped, idle sessions closed.

The processor keeps one state a session and works through a batch's rows in the order of their sequence numbers,
so its outcome does not depend on how rows are dealt over batches of the same order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "status string, para long, speed double, voice string, epoch long, seq long"
OUTPUT = "session string, seq long, cmd string, status string, para long, speed double, voice string, epoch long, dropped boolean"
IDLE_MS = 5 * 60 * 1000


def step(state: tuple, cmd: str, value: str | None, stamp: int | None) -> tuple[tuple, bool]:
    """(next state, whether the row was dropped) of (status, para, speed, voice, epoch)."""
    status, para, speed, voice, epoch = state
    if cmd == "result":  # generated audio, stamped with the epoch it was asked for in
        return (state, True) if stamp is not None and stamp != epoch else (("playing" if status in ("starting", "buffering") else status, para, speed, voice, epoch), False)
    if cmd == "toggle":
        status = "paused" if status in ("playing", "buffering", "starting") else "buffering"
    elif cmd == "stop":
        status, epoch = "idle", epoch + 1
    elif cmd == "start":
        status, para, epoch = "starting", 0, epoch + 1
    elif cmd == "next":
        para += 1
    elif cmd == "prev":
        para = max(0, para - 1)
    elif cmd == "paragraph":
        para = max(0, int(value or 0))
    elif cmd == "speed" and value and float(value) > 0 and float(value) != speed:
        speed, epoch = float(value), epoch + 1
    elif cmd == "voice" and value and value != voice:
        voice, epoch = value, epoch + 1
    return (status, para, speed, voice, epoch), False


START = ("idle", 0, 1.0, "af_heart", 0)


def fold(rows: Iterable[tuple], state: tuple = START, last: int = -1) -> tuple[list[tuple], tuple, int]:
    """Work through (seq, cmd, value, stamp) rows in order; a sequence number seen before is skipped."""
    out = []
    for seq, cmd, value, stamp in sorted(rows, key=lambda r: r[0]):
        if seq <= last:
            continue
        state, dropped = step(state, cmd, value, stamp)
        last = seq
        out.append((seq, cmd, *state, dropped))
    return out, state, last


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    return [(int(r.seq), r.cmd, None if pd.isna(r.value) else r.value, None if pd.isna(r.stamp) else int(r.stamp)) for r in pdf.itertuples()]


def _process(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    if state.hasTimedOut:
        _, para, speed, voice, epoch, seq = state.get
        state.remove()
        yield pd.DataFrame([(key[0], seq, "idle", "idle", para, speed, voice, epoch, False)], columns=names)
        return
    *now, seq = state.get if state.exists else (*START, -1)
    out, now, seq = fold([r for pdf in frames for r in _rows(pdf)], tuple(now), seq)
    state.update((*now, seq))
    state.setTimeoutDuration(IDLE_MS)
    yield pd.DataFrame([(key[0], *r) for r in out], columns=names)


def play(commands: DataFrame) -> DataFrame:
    """Player states after every row of a stream (session, seq, cmd, value, stamp)."""
    return commands.groupBy("session").applyInPandasWithState(_process, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def play_batch(commands: DataFrame) -> DataFrame:
    """The same over a finished table: rows sorted within partitions, so that a task holds one state and one batch, however long a session is."""
    schema = pa.schema([("session", pa.string()), ("seq", pa.int64()), ("cmd", pa.string()), ("status", pa.string()), ("para", pa.int64()), ("speed", pa.float64()), ("voice", pa.string()), ("epoch", pa.int64()), ("dropped", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, state, last, first = None, START, -1, True
        for b in batches:
            out = []
            for key, seq, cmd, value, stamp in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if first or key != session:
                    session, state, last, first = key, START, -1, False
                if seq > last:
                    state, dropped = step(state, cmd, value, stamp)
                    last = seq
                    out.append((session, seq, cmd, *state, dropped))
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = commands.select("session", F.col("seq").cast("long"), "cmd", "value", F.col("stamp").cast("long"))
    return rows.repartition("session").sortWithinPartitions("session", "seq").mapInArrow(run, OUTPUT)


def progress_changes(events: DataFrame, ts: str = "ts", session: str = "session", pct: str = "pct", late: str = "10 minutes") -> DataFrame:
    """A stream's progress once a whole percent and session."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([session, pct])


def latest_version(spark: SparkSession, path: str) -> str | None:
    """The newest whole version of a table that upsert_latest() keeps: the folder of the highest number that was committed."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    whole = [n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return max(whole, default=None)


def upsert_latest(batch: DataFrame, path: str, key: str, order: str) -> None:
    """For foreachBatch: keep the newest row of each key in a Parquet folder.

    Every batch writes a new version beside the last, which readers keep until the new one is committed; a batch that fails or is repeated
    leaves the last version whole.  The version before goes afterwards.
    """
    spark = batch.sparkSession
    last = latest_version(spark, path)
    rows = batch if last is None else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/{last}"))
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
    latest.write.mode("overwrite").parquet(f"{path}/v{0 if last is None else int(last[1:]) + 1:012d}")
    if last is not None:
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{last}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{latest_version(spark, path)}")
