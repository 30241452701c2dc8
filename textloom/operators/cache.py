"""An audio cache as a table (key, ts, bytes): keys, lookups in time, and eviction to a byte budget."""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_AGE_HOURS, BUDGET_BYTES, FILL = 48, 96 * 1024 * 1024, 0.9
#: Rows of a range of the order, about, and rows of it that its bounds are chosen from; parts of the time that a range is looked up by.
RANGE_ROWS, LOOKED_AT, SLOTS = 200_000, 32, 4096
#: Stands for an unknown time, after all others.
NEVER = 1 << 62


def cache_key(text: Column, voice: Column, speed: Column) -> Column:
    """Null where a part is unknown."""
    return F.substring(F.sha2(F.concat(voice, F.lit("|"), speed, F.lit("|"), text).cast("binary"), 256), 1, 32)


def lookup(keys: DataFrame, meta: DataFrame, now: Column) -> DataFrame:
    """Keys with hit: an entry younger than the age limit."""
    fresh = meta.filter(F.col("ts") > now - F.expr(f"INTERVAL {MAX_AGE_HOURS} HOURS")).select("key").distinct().withColumn("hit", F.lit(True))
    return keys.join(fresh, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def evict(meta: DataFrame, now: Column, budget: int = BUDGET_BYTES, partition: str | None = None) -> DataFrame:
    """Entries with evicted: oldest first, those too old and those that the budget has no room for.

    Times ascend, so what goes is a prefix of the order and a suffix sum of bytes decides each row by itself.
    """
    if partition:
        rows = meta.withColumn("__over", F.sum("bytes").over(_from_the_end(partition)) > budget * FILL)
    else:
        rows = _over(meta, budget * FILL)
    return rows.withColumn("evicted", (F.col("ts") < now - F.expr(f"INTERVAL {MAX_AGE_HOURS} HOURS")) | F.col("__over")).drop("__over")


def _from_the_end(partition: str) -> Window:
    """A row and all after it in order of time and key, unknown ones last: read backwards, so that sums are running ones, not summed anew a row."""
    return Window.partitionBy(partition).orderBy(F.desc_nulls_first("ts"), F.desc_nulls_first("key")).rowsBetween(Window.unboundedPreceding, 0)


def _instant() -> Column:
    """Microseconds of a time."""
    return F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(NEVER))


def _over(meta: DataFrame, limit: float) -> DataFrame:
    """Adds __over: whether the bytes of a row and all after it are more than the limit.

    The order is cut in ranges whose bounds are fixed first, so a row's range follows from the row alone.  The totals of the ranges decide
    nearly all of them as a whole; only rows of a range in which the limit may be passed are dealt out and summed one by one.
    """
    rows = meta.count()
    ranges = max(int(meta.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    # some rows tell where an even part of all ends, whichever they are; the sums are of all rows
    some = meta.filter(F.rand(7) < ranges * LOOKED_AT / max(rows, 1)).select(_instant().alias("at"), F.col("key").cast("string").alias("key"))
    places = sorted({(at, key.encode()) for at, key in some.collect() if key is not None})
    bounds = [places[i * len(places) // ranges] for i in range(1, ranges)] if len(places) >= ranges else places
    ranged = meta.withColumn("__range", _bounds_before(bounds))
    below, above = (f(F.col("bytes"), F.lit(0)) for f in (F.least, F.greatest))
    totals = {i: rest for i, *rest in ranged.groupBy("__range").agg(F.sum("bytes"), F.sum(below), F.sum(above)).collect()}
    # of each range, the bytes after it, null if none are known, and whether all of its rows are over the limit, null if that is open
    after, over, held = [], [], None
    for i in range(len(bounds), -1, -1):
        total, lost, won = totals.get(i, (None, 0, 0))
        after.append(held)
        over.append(None if held is None else True if held + lost > limit else False if held + won <= limit else None)
        held = held if total is None else total + (held or 0)
    of_range = lambda values, kind: F.get(F.from_json(F.lit(json.dumps(values[::-1])), f"array<{kind}>"), F.col("__range"))
    whole, rest, inside = of_range(over, "boolean"), of_range(after, "bigint"), F.sum("bytes").over(_from_the_end("__range"))
    open_ = ranged.filter(whole.isNull()).withColumns({"__inside": inside, "__rest": rest})
    open_ = open_.withColumn("__over", F.coalesce(F.col("__inside") + F.col("__rest"), "__inside", "__rest") > limit).drop("__inside", "__rest")
    return ranged.filter(whole.isNotNull()).withColumn("__over", whole).unionByName(open_).drop("__range")


def _bounds_before(bounds: list[tuple[int, bytes]]) -> Column:
    """How many bounds (instant, key), in order, a row comes after.

    Looked up by the slot of its time where no bound lies in that, else by a binary search of as many steps as their number has digits; keys are asked for where instants are equal.
    """
    if not bounds:
        return F.lit(0)
    listed = F.from_json(F.lit(json.dumps([{"at": at, "key": key.decode()} for at, key in bounds])), "array<struct<at bigint, key string>>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])

    def passed(b: Column) -> Column:
        return (b["at"] < _instant()) | ((b["at"] == _instant()) & F.coalesce(b["key"] < F.col("key").cast("string"), F.lit(True)))

    search = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when((at + step <= len(bounds)) & passed(F.get(listed, at + step - 1)), step).otherwise(0))
    instants = [at for at, _ in bounds]
    low, high = instants[0], max((at for at in instants if at < NEVER), default=instants[0])
    width = (high - low) // SLOTS + 1
    before = [bisect_left(instants, low + s * width) for s in range(SLOTS + 1)]
    slots = F.from_json(F.lit(json.dumps([a if a == b else None for a, b in zip(before[:-1], before[1:], strict=True)])), "array<int>")
    slot = F.when(_instant().between(low, high), F.floor((_instant() - low) / width).cast("int"))
    near = F.when(_instant() < low, 0).when((_instant() > high) & F.lit(instants[-1] < NEVER), len(bounds)).otherwise(F.get(slots, slot))
    return F.coalesce(near, search)


def to_pcm(samples: Column) -> Column:
    """Samples as 16-bit integers; half is rounded up."""
    return F.transform(samples, lambda v: F.when(v >= 1, 32767).when(v <= -1, -32768).otherwise(F.floor(v.cast("double") * 32767 + F.lit(0.5).cast("double"))).cast("int"))


def from_pcm(pcm: Column) -> Column:
    return F.transform(pcm, lambda v: v / F.lit(32768.0))
