"""Session semantics over ordered events, in batch: gaps, changes, runs, stale results, quiet periods, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(key: str, ts: str, tie: str) -> Window:
    return Window.partitionBy(key).orderBy(ts, tie)


def idle_sessions(events: DataFrame, key: str, ts: str, tie: str, minutes: int = 5) -> DataFrame:
    """Adds session: a number that grows when more than `minutes` passed since the key's last event."""
    w = _order(key, ts, tie)
    gap = F.lag(ts).over(w) + F.expr(f"INTERVAL {minutes} MINUTES") < F.col(ts)
    return events.withColumn("__new", F.coalesce(gap, F.lit(False)).cast("long")).withColumn("session", F.sum("__new").over(w)).drop("__new")


def changes(events: DataFrame, key: str, ts: str, tie: str, value: str, always: str | None = None) -> DataFrame:
    """Events whose value differs from the key's last one; the value `always` is never dropped."""
    before = F.lag(value).over(_order(key, ts, tie))
    keep = before.isNull() | (before != F.col(value))
    if always is not None:
        keep = keep | (F.col(value) == always)
    return events.withColumn("__keep", keep).filter("__keep").drop("__keep")


def runs(events: DataFrame, key: str, ts: str, tie: str, hit: Column, at_least: int = 3) -> DataFrame:
    """(key, run_start, run_length) of unbroken runs of events for which `hit` holds."""
    w = _order(key, ts, tie)
    marked = events.withColumn("__hit", hit).withColumn("__all", F.row_number().over(w))
    kept = marked.filter("__hit").withColumn("__island", F.col("__all") - F.row_number().over(w))
    return kept.groupBy(key, "__island").agg(F.min(ts).alias("run_start"), F.count("*").alias("run_length")).filter(F.col("run_length") >= at_least).drop("__island")


def fresh_results(events: DataFrame, key: str, ts: str, tie: str, renewed: Column) -> DataFrame:
    """Adds epoch, the renewals up to each event, and stale: whether the key was renewed since its last event."""
    w = _order(key, ts, tie)
    out = events.withColumn("epoch", F.sum(renewed.cast("long")).over(w))
    return out.withColumn("stale", F.coalesce(F.lag("epoch").over(w) != F.col("epoch"), F.lit(False)))


def settled(events: DataFrame, key: str, ts: str, tie: str, quiet_ms: int) -> DataFrame:
    """Events after which the key was quiet for `quiet_ms` (debounce); the last of a key always is."""
    after = F.lead(ts).over(_order(key, ts, tie))
    keep = after.isNull() | (F.col(ts) + F.expr(f"INTERVAL {quiet_ms} MILLISECONDS") <= after)
    return events.withColumn("__keep", keep).filter("__keep").drop("__keep")


def last_write(events: DataFrame, key: str, ts: str, tie: str, value: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(value, F.struct(ts, tie)).alias(value))


def _folded(events: DataFrame, key: str, ts: str, tie: str, *columns: str) -> Column:
    """The key's events in order, as structs (ts, tie, columns)."""
    return F.array_sort(F.collect_list(F.struct(ts, tie, *columns)))


def throttled(events: DataFrame, key: str, ts: str, tie: str, gap_us: int) -> DataFrame:
    """(key, first, last) of every window of a throttle, by their `tie`: one opens at an event `gap_us` or more after the last one opened.

    `first` are the events that a least interval lets pass, `last` those that a trailing throttle reports.
    """
    # only the last window changes while the events go by, so the others are kept apart from it
    window = "struct<at:bigint,first:bigint,last:bigint>"
    zero = F.struct(F.expr(f"cast(array() as array<{window}>)").alias("done"), F.expr(f"cast(null as {window})").alias("open"))

    def step(acc: Column, e: Column) -> Column:
        at, tie_ = e[ts].cast("long"), e[tie].cast("long")
        opens = acc["open"].isNull() | (at - acc["open"]["at"] >= gap_us)
        done = F.when(opens & acc["open"].isNotNull(), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        now = F.when(opens, F.struct(at.alias("at"), tie_.alias("first"), tie_.alias("last"))).otherwise(F.struct(acc["open"]["at"].alias("at"), acc["open"]["first"].alias("first"), tie_.alias("last")))
        return F.struct(done.alias("done"), now.alias("open"))

    windows = F.aggregate(_folded(events, key, ts, tie), zero, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    return events.groupBy(key).agg(windows.alias("w")).select(key, F.explode("w").alias("w")).select(key, "w.first", "w.last")


def polled(events: DataFrame, key: str, us: str, tie: str, value: str, every_us: int) -> DataFrame:
    """(key, tick, value): what a poll every `every_us` sees, the last event before each tick that follows one."""
    tick = F.floor(F.col(us) / every_us).cast("long") + 1
    return events.withColumn("tick", tick).groupBy(key, "tick").agg(F.max_by(value, F.struct(us, tie)).alias(value))


def smoothed_progress(polls: DataFrame, key: str, ms: str, tie: str, seen: str, playing: str, name: str = "shown") -> DataFrame:
    """(key, shown) after the last poll: progress that never falls, but for a jump back of more than 0.15, and runs on between polls at a smoothed rate.

    The rate, at most 0.01 a millisecond, is the mean of itself and the last one measured over more than 50 ms; it runs on for 800 ms at most.
    """
    state = "struct<shown:double,p:double,t:double,rate:double,playing:boolean>"
    make = lambda shown, p, t, rate, on: F.struct(shown.cast("double").alias("shown"), p.cast("double").alias("p"), t.cast("double").alias("t"), rate.cast("double").alias("rate"), on.alias("playing"))

    def step(acc: Column, e: Column) -> Column:
        at, p, on = e[ms].cast("double"), e[seen].cast("double"), e[playing]
        ran = F.least(F.lit(1.0), acc["p"] + acc["rate"] * F.least(at - acc["t"], F.lit(800.0)))
        shown = F.when(acc["playing"], F.greatest(acc["shown"], ran)).otherwise(acc["shown"])
        passed, gained = at - acc["t"], p - acc["p"]
        inst = F.least(F.lit(0.01), gained / F.greatest(passed, F.lit(1.0)))
        rate = F.when((passed > 50) & (gained >= 0), F.when(acc["rate"] != 0, acc["rate"] * 0.5 + inst * 0.5).otherwise(inst)).otherwise(acc["rate"])
        begun = acc.isNull() | (p < shown - F.lit(0.15))
        return F.when(begun, make(p, p, at, F.lit(0.0), on)).when(on, make(shown, p, at, rate, on)).otherwise(make(F.greatest(shown, p), p, at, F.lit(0.0), on))

    fold = F.aggregate(_folded(polls, key, ms, tie, seen, playing), F.expr(f"cast(null as {state})"), step, lambda acc: acc["shown"])
    return polls.groupBy(key).agg(fold.alias(name))
