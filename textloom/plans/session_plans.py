"""Queries over ordered events: sessions, changes, runs, folds and stalls. The event table stands in for player events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import plan, sessions
from .catalog import query, table

STATUS = "CASE event_type WHEN 'signup' THEN 'starting' WHEN 'view' THEN 'playing' WHEN 'click' THEN 'buffering' WHEN 'purchase' THEN 'paused' ELSE 'error' END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value").withColumn("status", F.expr(STATUS))


@query("SELECT user_id, event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 5 MINUTES < ts THEN 1 ELSE 0 END AS new FROM events)")
def session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.idle_sessions(_events(spark, sf_dir), "user_id", "ts", "event_id").select("user_id", "event_id", "session")


@query("SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS NULL OR was <> event_type OR event_type = 'error'")
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.changes(_events(spark, sf_dir), "user_id", "ts", "event_id", "event_type", "error").select("user_id", "event_id")


@query("SELECT user_id, event_id, pct FROM (SELECT *, lag(pct) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM (SELECT *, CAST(floor(value / 10 + 0.5) AS BIGINT) AS pct FROM events)) WHERE was IS NULL OR was <> pct")
def progress_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("pct", F.floor(F.col("value") / 10 + F.lit(0.5).cast("double")).cast("long"))
    return sessions.changes(e, "user_id", "ts", "event_id", "pct").select("user_id", "event_id", "pct")


@query("""
SELECT user_id, epoch_us(min(ts)) AS run_start_us, count(*) AS run_length FROM (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE event_type IN ('error', 'click')) GROUP BY user_id, island HAVING count(*) >= 3
""")
def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sessions.runs(_events(spark, sf_dir), "user_id", "ts", "event_id", F.col("event_type").isin("error", "click"))
    return r.select("user_id", F.unix_micros("run_start").alias("run_start_us"), "run_length")


@query("SELECT user_id, event_id, epoch, coalesce(lag(epoch) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> epoch, false) AS stale FROM (SELECT *, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS epoch FROM events)")
def late_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.fresh_results(_events(spark, sf_dir), "user_id", "ts", "event_id", F.col("event_type") == "purchase").select("user_id", "event_id", "epoch", "stale")


@query("SELECT user_id, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events) WHERE after IS NULL OR ts + INTERVAL 600 SECONDS <= after")
def debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.settled(_events(spark, sf_dir), "user_id", "ts", "event_id", 600_000).select("user_id", "event_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def prefs_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.last_write(_events(spark, sf_dir), "user_id", "ts", "event_id", "event_type")


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS resume_at FROM events WHERE event_type = 'view' GROUP BY user_id")
def session_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.last_write(_events(spark, sf_dir).filter("event_type = 'view'"), "user_id", "ts", "event_id", "value").withColumnRenamed("value", "resume_at")


@query("SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: a * 0.7::DOUBLE + x * 0.3::DOUBLE), 6) AS rate FROM events GROUP BY user_id")
def ema_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("at", F.struct("ts", "event_id"))
    return plan.moving_average(e, "user_id", "at", "value", 0.7, "rate").select("user_id", F.round("rate", 6).alias("rate"))


@query("SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: a * 0.6::DOUBLE + x * 0.4::DOUBLE), 6) AS rtf FROM events WHERE event_type <> 'view' GROUP BY user_id")
def ema_rtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).filter("event_type <> 'view'").withColumn("at", F.struct("ts", "event_id"))
    return plan.moving_average(e, "user_id", "at", "value", 0.6, "rtf").select("user_id", F.round("rtf", 6).alias("rtf"))


@query("""
SELECT user_id, round(1.0::DOUBLE / 15 / arg_max(speed, (ts, event_id)), 9) AS rate FROM (SELECT *, [0.75, 1.0, 1.25, 1.5, 1.75, 2.0][CAST(event_id % 6 AS INT) + 1]::DOUBLE AS speed FROM events) GROUP BY user_id
""")
def speed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    speeds = F.array(*[F.lit(s) for s in (0.75, 1.0, 1.25, 1.5, 1.75, 2.0)])
    e = _events(spark, sf_dir).withColumn("at", F.struct("ts", "event_id")).withColumn("speed", F.element_at(speeds, (F.col("event_id") % 6 + 1).cast("int")))
    return plan.rate_after_speed(e, "user_id", "at", "speed").select("user_id", F.round("rate", 9).alias("rate"))


@query("SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0.0) AS base FROM events")
def locf_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("at", F.struct("ts", "event_id")).withColumn("known", F.when(F.col("event_type") == "view", F.col("value")))
    return e.select("event_id", plan.carry_forward(e, "user_id", "at", "known").alias("base"))


@query(f"""
SELECT user_id, CAST(sum(CASE WHEN status = 'buffering' AND was = 'playing' THEN 1 ELSE 0 END) AS BIGINT) AS underruns, CAST(sum(CASE WHEN status = 'buffering' AND until IS NOT NULL THEN epoch_us(until) - epoch_us(ts) ELSE 0 END) // 1000000 AS BIGINT) AS buffering_sec,
  CAST((min(CASE WHEN status = 'playing' THEN epoch_us(ts) END) - min(epoch_us(ts))) // 1000000 AS BIGINT) AS start_sec
FROM (SELECT *, lead(ts) OVER w AS until, lag(status) OVER w AS was FROM (SELECT *, {STATUS} AS status FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id
""")
def stall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("at", F.struct("ts", "event_id"))
    s = plan.stalls(e.withColumn("us", F.unix_micros("ts")), "user_id", "at", "status", "us")
    whole = lambda c: F.floor(F.col(c) / 1_000_000).cast("long").alias(c)
    return s.select("user_id", "underruns", whole("buffering_sec"), whole("start_sec"))


@query("""
SELECT user_id, round(coalesce(sum(CASE WHEN m = 0 THEN value END), 0.0), 6) AS lead_sec FROM (SELECT *, sum(CASE WHEN value < 90 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS m FROM events) GROUP BY user_id
""")
def ready_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("ready", F.col("value") < 90)
    return plan.ready_lead(e, "user_id", "event_id", "ready", "value").select("user_id", F.round("lead_sec", 6).alias("lead_sec"))


@query("""
SELECT user_id, coalesce(CASE WHEN ahead < 2 OR lead < 24 THEN nxt END, -1) AS next FROM (SELECT user_id, min(CASE WHEN value >= 90 AND p < 8 THEN event_id END) AS nxt, coalesce(sum(CASE WHEN m = 0 THEN value END), 0) AS lead, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) AS ahead FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, sum(CASE WHEN value < 90 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS m FROM events) GROUP BY user_id)
""")
def next_to_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("ready", F.col("value") < 90)
    found = plan.next_missing(e, "user_id", "event_id", "ready", "value", F.lit(24))
    return found.select("user_id", F.coalesce("next", F.lit(-1)).alias("next"))


@query("SELECT user_id, round(sum(CASE WHEN n > 1 THEN value END) / sum(CASE WHEN n > 1 THEN 50.0 END), 6) AS rtf FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'view') GROUP BY user_id HAVING sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) >= 3")
def measured_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation time over audio time, the first generated segment left out, from three on."""
    from pyspark.sql import Window

    e = _events(spark, sf_dir).filter("event_type <> 'view'").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("n > 1")
    return e.groupBy("user_id").agg(F.round(F.sum("value") / F.sum(F.lit(50.0)), 6).alias("rtf"), F.count("*").alias("c")).filter("c >= 3").drop("c")


@query("SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS next_para, coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS prev_para, min(turn) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS first_index FROM conversations")
def para_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    found = plan.first_at_or_after(plan.neighbours(c, "conv_id", "turn"), "conv_id", "turn", "turn")
    return found.select("conv_id", "turn", F.coalesce("next_para", F.lit(-1)).alias("next_para"), F.coalesce("prev_para", F.lit(-1)).alias("prev_para"), "first_index")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events) WHERE back <= 3")
def kept_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current row of a user and the two behind it; what lies further back is dropped."""
    from pyspark.sql import Window

    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("event_id").desc()))
    return _events(spark, sf_dir).withColumn("back", back).filter("back <= 3").select("user_id", "event_id")


@query("""
WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'next' WHEN 'click' THEN 'toggle' WHEN 'purchase' THEN 'speed' ELSE 'result' END AS cmd, round(value, 1) AS v, event_id % 3 AS stamp, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (
  SELECT DISTINCT session, 0::BIGINT AS n, 0::BIGINT AS seq, '' AS cmd, 'idle' AS status, 0::BIGINT AS para, 1.0::DOUBLE AS speed, 0::BIGINT AS epoch, false AS dropped FROM e
  UNION ALL
  SELECT session, n, seq, cmd, CASE WHEN cmd = 'start' THEN 'starting' WHEN cmd = 'toggle' AND status IN ('playing', 'buffering', 'starting') THEN 'paused' WHEN cmd = 'toggle' THEN 'buffering' WHEN cmd = 'result' AND stamp = epoch AND status IN ('starting', 'buffering') THEN 'playing' ELSE status END,
    CASE cmd WHEN 'start' THEN 0 WHEN 'next' THEN para + 1 ELSE para END, CASE WHEN renewed AND cmd = 'speed' THEN v ELSE speed END, epoch + renewed::INT, cmd = 'result' AND stamp <> epoch FROM (
    SELECT e.*, f.status, f.para, f.speed, f.epoch, e.cmd = 'start' OR (e.cmd = 'speed' AND e.v > 0 AND e.v <> f.speed) AS renewed FROM f JOIN e ON e.session = f.session AND e.n = f.n + 1)
)
SELECT session, seq, cmd, status, para, speed, epoch, dropped FROM f WHERE n > 0
""")
def player_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session processor over a finished table; the stream gives the same rows, which tests check."""
    from ..streaming.sessions import play_batch

    cmd = F.expr("CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'next' WHEN 'click' THEN 'toggle' WHEN 'purchase' THEN 'speed' ELSE 'result' END")
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), cmd.alias("cmd"), F.round("value", 1).cast("string").alias("value"), (F.col("event_id") % 3).alias("stamp"))
    return play_batch(e).drop("voice")
