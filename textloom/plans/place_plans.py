"""Queries that place things: seeks, sound edges, polls and throttles, segments in changed texts, page facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, titles
from ..operators import locate, plan, sessions
from ..sources import pages
from .catalog import query, table, texts
from .text_plans import CUM, cum_chars


@query(f"""
WITH c AS ({CUM}), t AS (SELECT doc_id, sum(chars)::DOUBLE AS total, sum(chars) * (1.0::DOUBLE / 15) AS seconds FROM c GROUP BY doc_id HAVING sum(chars) > 0),
w AS (SELECT doc_id, total, delta, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.5::DOUBLE * seconds + delta) / seconds)) AS p FROM t, (SELECT unnest([-15.0::DOUBLE, 15.0::DOUBLE]) AS delta))
SELECT doc_id, delta, max(para) AS para FROM c JOIN w USING (doc_id) WHERE cum_chars <= p * total GROUP BY doc_id, delta
""")
def seek_by_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen seconds back and forth from the middle of every document."""
    return plan.seek_by_seconds(cum_chars(spark, sf_dir), "doc_id", "para", F.lit(0.5) * F.col("seconds"), [-15.0, 15.0])


@query("""
SELECT conv_id, turn, CASE WHEN turn % 3 <> 2 AND (turn * 7 + conv_id) % 5 < 2.5 THEN coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), turn) ELSE turn END AS target FROM conversations
""")
def step_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as paragraphs; two of three stand at their first segment, some seconds in."""
    c = plan.neighbours(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")
    target = plan.back_target(F.col("turn"), F.col("prev_para"), F.col("turn") % 3 != 2, (F.col("turn") * 7 + F.col("conv_id")) % 5)
    return c.select("conv_id", "turn", target.alias("target"))


@query("""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS s, len(embedding) AS k FROM embeddings), n AS (SELECT *, least(72, k // 2) AS n FROM e),
f AS (SELECT vec_id, label, k, list_transform(s, lambda x, i: x * (CASE WHEN i - 1 < n THEN (i - 1)::DOUBLE / n ELSE 1 END) * (CASE WHEN k - i < n THEN (k - i)::DOUBLE / n ELSE 1 END)) AS f FROM n)
SELECT vec_id, k + CAST(floor((vec_id % 500) / 1000.0::DOUBLE * 24000 + 0.5) AS INT) AS n_samples, round(list_sum(list_transform(f, lambda x: abs(x))), 6) AS loudness, round(f[2], 6) AS second FROM f
""")
def sound_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as sound: faded edges and the silence of a pause."""
    e = table(spark, sf_dir, "embeddings").withColumn("s", plan.with_edges(F.col("embedding"), F.col("vec_id") % 500))
    loud = F.aggregate("s", F.lit(0.0), lambda acc, x: acc + F.abs(x))
    return e.select("vec_id", F.size("s").alias("n_samples"), F.round(loud, 6).alias("loudness"), F.round(F.try_element_at("s", F.lit(2)), 6).alias("second"))


@query("SELECT event_id, round(greatest(0.0::DOUBLE, least(value - event_id % 50, 30.0::DOUBLE)), 9) AS seconds FROM events")
def buffer_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(plan.buffer_offset(F.col("value"), (F.col("event_id") % 50).cast("double"), F.lit(30.0)), 9).alias("seconds"))


GAP_US = 36_000_000_000


@query(f"""
WITH e AS (SELECT user_id, list([epoch_us(ts)::BIGINT, event_id] ORDER BY ts, event_id) AS e FROM events GROUP BY user_id),
w AS (SELECT user_id, list_reduce(e, lambda a, x: CASE WHEN x[1] - a[-3] >= {GAP_US} THEN list_concat(a, [x[1], x[2], x[2]]) ELSE list_concat(a[:-2], [x[2]]) END, []::BIGINT[]) AS a FROM (SELECT user_id, list_prepend([e[1][1], e[1][2], e[1][2]], e[2:]) AS e FROM e))
SELECT user_id, unnest(list_transform(range(0, len(a) // 3), lambda i: a[i * 3 + 2])) AS first, unnest(list_transform(range(0, len(a) // 3), lambda i: a[i * 3 + 3])) AS last FROM w
""".replace(", []::BIGINT[])", ")"))
def throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a throttle of ten hours over every user's events."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    return sessions.throttled(e, "user_id", "us", "event_id", GAP_US)


@query("SELECT user_id, epoch_us(ts) // 3600000000 + 1 AS tick, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id, tick")
def polled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an hourly poll sees of every user."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "event_type")
    return sessions.polled(e, "user_id", "us", "event_id", "event_type", 3_600_000_000)


@query("""
WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, (event_id * 37 % 900)::DOUBLE AS step, (value / 100 % 1)::DOUBLE AS p, event_type <> 'error' AS playing FROM events),
t AS (SELECT user_id, n, p, playing, sum(step) OVER (PARTITION BY user_id ORDER BY n) AS t FROM e),
f AS (
  SELECT user_id, n, p AS shown, p, t, 0.0::DOUBLE AS rate, playing FROM t WHERE n = 1
  UNION ALL
  SELECT user_id, n, CASE WHEN back THEN q WHEN playing THEN s ELSE greatest(s, q) END, q, t, CASE WHEN back OR NOT playing THEN 0.0::DOUBLE WHEN t - t0 > 50 AND q >= p0 THEN CASE WHEN rate <> 0 THEN rate * 0.5::DOUBLE + inst * 0.5::DOUBLE ELSE inst END ELSE rate END, playing FROM (
    SELECT *, q < s - 0.15::DOUBLE AS back, least(0.01::DOUBLE, (q - p0) / greatest(t - t0, 1.0::DOUBLE)) AS inst FROM (
      SELECT t.user_id, t.n, t.p AS q, t.t, t.playing, f.p AS p0, f.t AS t0, f.rate, CASE WHEN f.playing THEN greatest(f.shown, least(1.0::DOUBLE, f.p + f.rate * least(t.t - f.t, 800.0::DOUBLE))) ELSE f.shown END AS s FROM f JOIN t ON t.user_id = f.user_id AND t.n = f.n + 1))
)
SELECT user_id, round(arg_max(shown, n), 6) AS shown FROM f GROUP BY user_id
""")
def smoothed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as polled progress, up to 0.9 seconds apart."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 100 % 1).alias("p"), (F.col("event_type") != "error").alias("playing"))
    e = e.withColumn("ms", F.sum((F.col("event_id") * 37 % 900).cast("double")).over(Window.partitionBy("user_id").orderBy("event_id")))
    return sessions.smoothed_progress(e, "user_id", "ms", "event_id", "p", "playing").select("user_id", F.round("shown", 6).alias("shown"))


SEGMENT = "substr(text, 11, 90)"


@query(f"""
WITH d AS (SELECT doc_id, text, {SEGMENT} AS seg FROM documents WHERE len(text) >= 120),
b AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'xx' || text WHEN 2 THEN substr(text, 101) ELSE substr(text, 101) END AS block, CASE WHEN doc_id % 4 = 3 THEN substr(text, 1, 95) || '#' || substr(text, 97) ELSE text END AS page FROM d),
f AS (SELECT *, lower(block) AS lb, lower(page) AS lp, lower(seg) AS ls FROM b),
h AS (SELECT *, instr(substr(lb, 11), ls) AS a, CASE WHEN instr(reverse(substr(lb, 1, 10 + len(ls))), reverse(ls)) > 0 THEN len(substr(lb, 1, 10 + len(ls))) - instr(reverse(substr(lb, 1, 10 + len(ls))), reverse(ls)) - len(ls) + 2 ELSE 0 END AS z FROM f),
r AS (SELECT doc_id, CASE WHEN substr(block, 11, len(seg)) = seg THEN 10 WHEN a = 0 THEN z - 1 WHEN z = 0 THEN a + 9 WHEN 10 - (z - 1) <= a + 9 - 10 THEN z - 1 ELSE a + 9 END AS b,
  CASE WHEN instr(lp, ls) > 0 THEN CASE WHEN instr(substr(lp, 11), ls) > 0 THEN instr(substr(lp, 11), ls) + 9 ELSE instr(lp, ls) - 1 END
    WHEN len(ls) > 80 THEN CASE WHEN instr(substr(lp, 11), substr(ls, 1, 60)) > 0 THEN instr(substr(lp, 11), substr(ls, 1, 60)) + 9 ELSE instr(lp, substr(ls, 1, 60)) - 1 END ELSE -1 END AS d FROM h)
SELECT doc_id, CAST(CASE WHEN b >= 0 THEN b ELSE d END AS INT) AS at, CASE WHEN b >= 0 THEN 'block' WHEN d >= 0 THEN 'page' END AS by FROM r
""")
def resolved_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment of every document in its block, which stands as it was, has moved or is gone, and in the page, which may have changed at the segment's end."""
    d = texts(spark, sf_dir, "documents", "doc_id", "text").filter(F.length("text") >= 120).withColumn("seg", F.expr(SEGMENT))
    case, rest = F.col("doc_id") % 4, F.expr("substr(text, 101)")
    d = d.withColumn("block", F.when(case == 0, F.col("text")).when(case == 1, F.concat(F.lit("xx"), "text")).otherwise(rest))
    d = d.withColumn("page", F.when(case == 3, F.expr("substr(text, 1, 95) || '#' || substr(text, 97)")).otherwise(F.col("text"))).withColumn("base", F.lit(10))
    return locate.resolved(d, "block", "base", "page", "base", "seg").select("doc_id", F.col("at").cast("int").alias("at"), "by")


@query("""
WITH l AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line, unnest(string_split(text, chr(10))) AS text, len(string_split(text, chr(10))) AS n FROM documents),
k AS (SELECT *, CASE WHEN len(text) % 5 = 0 THEN 'li' ELSE 'p' END AS tag FROM l)
SELECT a.doc_id, a.line, (SELECT min(b.n - 1 - b.line) FROM k b WHERE b.doc_id = a.doc_id AND b.text = a.text AND b.tag = a.tag AND b.line % 7 <> 3) AS found FROM k a
""")
def relocated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks; the new page has them the other way round, and lacks every seventh."""
    d = texts(spark, sf_dir, "documents", "doc_id", "text").withColumn("lines", F.split("text", "\n", -1))
    old = d.select("doc_id", F.size("lines").alias("n"), F.posexplode("lines").alias("line", "text")).withColumn("line", F.col("line").cast("long")).withColumn("tag", F.when(F.length("text") % 5 == 0, "li").otherwise("p"))
    new = old.filter("line % 7 <> 3").withColumn("place", F.col("n") - 1 - F.col("line"))
    return locate.relocated(old.drop("n"), new, "doc_id", "tag", "place", "text").select("doc_id", "line", "found")


NODES = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents), o AS (SELECT doc_id, parts, unnest([0, len(text) // 3, len(text) // 2, len(text)]) AS place FROM l),
c AS (SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS node, len(unnest(parts)) AS n FROM l), s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY node) - n AS before FROM c)
"""


@query(f"""
{NODES} SELECT o.doc_id, CAST(place AS INT) AS place, node, CAST(place - before AS INT) AS off FROM (SELECT DISTINCT doc_id, place FROM o) o LEFT JOIN s ON s.doc_id = o.doc_id AND before <= place AND place < before + n
""")
def text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as text nodes, and the node behind offsets of the text that they make."""
    d = texts(spark, sf_dir, "documents", "doc_id", "text").filter("text IS NOT NULL").withColumn("lens", F.transform(F.split("text", "\n", -1), F.length))
    n = F.length("text")
    o = d.withColumn("place", F.explode(F.array_distinct(F.array(F.lit(0), F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int"), n)))).withColumn("x", locate.node_at(F.col("lens"), F.col("place")))
    return o.select("doc_id", "place", "x.node", F.col("x.offset").alias("off"))


@query(f"""
{NODES}, z AS (SELECT doc_id, sum(n) AS total, count(*) AS k FROM s GROUP BY doc_id), r AS (SELECT doc_id, total, total // 4 AS a, total // 2 AS b FROM z)
SELECT r.doc_id, b > a AND coalesce(bool_and(CASE WHEN s.doc_id % 4 = 0 AND s.node = 1 THEN false WHEN s.doc_id % 4 = 1 AND s.node = 0 THEN false ELSE true END), false) AS live
FROM r LEFT JOIN s ON s.doc_id = r.doc_id AND node >= (SELECT min(x.node) FROM s x WHERE x.doc_id = r.doc_id AND x.before <= a AND a < x.before + x.n) AND node <= (SELECT min(y.node) FROM s y WHERE y.doc_id = r.doc_id AND y.before <= b - 1 AND b - 1 < y.before + y.n) GROUP BY r.doc_id, a, b
""")
def live_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the second quarter of every document stands on lines that have kept their lengths; in half of the documents one has grown."""
    d = texts(spark, sf_dir, "documents", "doc_id", "text").filter("text IS NOT NULL").withColumn("lens", F.transform(F.split("text", "\n", -1), F.length))
    grown = F.when(F.col("doc_id") % 4 == 0, 1).when(F.col("doc_id") % 4 == 1, 0)
    now = F.transform("lens", lambda n, i: F.when(i == grown, n + 1).otherwise(n))
    total = F.aggregate("lens", F.lit(0), lambda acc, n: acc + n)
    return d.withColumn("total", total).select("doc_id", locate.is_live(F.col("lens"), now, F.floor(F.col("total") / 4).cast("int"), F.floor(F.col("total") / 2).cast("int")).alias("live"))


@query("""
WITH l AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line, unnest(string_split(text, chr(10))) AS t FROM documents),
s AS (SELECT *, CAST(sum(len(t) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) - len(t) - 1 AS start FROM l), b AS (SELECT doc_id, line, start, start + len(t) AS stop FROM s WHERE len(t) > 0),
p AS (SELECT DISTINCT doc_id, unnest([0, n_chars // 3, n_chars // 2, n_chars + 5]) AS point FROM documents)
SELECT p.doc_id, p.point, coalesce(max(CASE WHEN start <= point AND point < stop THEN line END), min(CASE WHEN start > point THEN line END), 0) AS index FROM p LEFT JOIN b USING (doc_id) GROUP BY p.doc_id, p.point
""")
def paragraph_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line around some offsets of every document, or the next one."""
    d = texts(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    lines = plan.running_in_row(d.withColumn("lines", F.split("text", "\n", -1)), "doc_id", "lines", "index").withColumn("start", F.col("cum_chars") + F.col("index"))
    blocks = lines.filter("chars > 0").select("doc_id", "index", "start", (F.col("start") + F.col("chars")).alias("end"))
    n = F.col("n_chars")
    points = d.select("doc_id", F.explode(F.array(F.lit(0).cast("long"), F.floor(n / 3), F.floor(n / 2), n + 5)).alias("point")).distinct()
    return locate.paragraph_at(points, blocks, "doc_id")


META = """CASE page_id % 4 WHEN 0 THEN '<meta property="og:site_name" content=" Site ' || page_id || ' ">' WHEN 1 THEN '<meta name="author" content="Ann ' || page_id || '">' WHEN 2 THEN '<meta name="author" content="https://x.example/' || page_id || '">' ELSE '' END
|| CASE page_id % 3 WHEN 0 THEN '<meta property="og:image" content="https://e.example/' || page_id || '.png">' WHEN 1 THEN '<meta content="https://e.example/logo.svg?v=1" property="og:image"><meta name="twitter:image" content="http://t.example/' || page_id || '.jpg">' ELSE '<meta property="og:image" content="/own.png">' END"""


@query(r"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Site ' || page_id WHEN 1 THEN 'Ann ' || page_id ELSE regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\.', '') END AS site,
  CASE page_id % 3 WHEN 0 THEN 'https://e.example/' || page_id || '.png' WHEN 1 THEN 'http://t.example/' || page_id || '.jpg' END AS image FROM pages
""")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site name and lead image of every page, given meta elements of each kind."""
    p = table(spark, sf_dir, "pages").withColumn("html", F.concat(F.expr(META), "html"))
    return p.select("page_id", pages.site_name(F.col("html"), F.col("url")).alias("site"), pages.lead_image(F.col("html")).alias("image"))


@query(f"""
WITH c AS ({CUM}), s AS (SELECT doc_id, para, chars, cum_chars, sum(chars) OVER (PARTITION BY doc_id)::DOUBLE AS total, CASE para % 4 WHEN 0 THEN 'loading' WHEN 1 THEN 'starting' WHEN 2 THEN 'playing' ELSE 'paused' END AS status, (para * 5 % 12)::DOUBLE AS off, (para % 3 * 4)::DOUBLE AS speech FROM c),
d AS (SELECT *, cum_chars + CASE WHEN speech > 0 THEN least(1.0::DOUBLE, off / (speech + 0.45::DOUBLE)) ELSE 0 END * chars AS done FROM s)
SELECT doc_id, para, round(CASE WHEN total > 0 THEN least(1.0::DOUBLE, done / total) ELSE 0 END, 9) AS progress, round(done * (1.0::DOUBLE / 15), 6) AS elapsed, round(CASE WHEN status NOT IN ('loading', 'starting') THEN greatest(0.0::DOUBLE, (total - done) * (1.0::DOUBLE / 15)) END, 6) AS remaining, round(CASE WHEN speech > 0 THEN least(1.0::DOUBLE, off / speech) ELSE 0 END, 9) AS seg_progress FROM d
""")
def player_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs as the segments that play, in one of four states, some seconds in; some have no sound yet."""
    from pyspark.sql import Window

    c = cum_chars(spark, sf_dir).withColumn("total", F.sum("chars").over(Window.partitionBy("doc_id")).cast("double"))
    speech, off = (F.col("para") % 3 * 4).cast("double"), (F.col("para") * 5 % 12).cast("double")
    status = F.element_at(F.array(*[F.lit(x) for x in ("loading", "starting", "playing", "paused")]), (F.col("para") % 4 + 1).cast("int"))
    done = plan.chars_done(F.col("cum_chars"), F.col("chars"), off, F.when(speech > 0, speech + F.lit(0.45)).otherwise(0.0))
    x = c.withColumn("s", plan.snapshot(done, F.col("total"), F.lit(plan.SECONDS_PER_CHAR), status, off, speech))
    return x.select("doc_id", "para", F.round("s.progress", 9).alias("progress"), F.round("s.elapsed", 6).alias("elapsed"), F.round("s.remaining", 6).alias("remaining"), F.round("s.seg_progress", 9).alias("seg_progress"))


@query("SELECT page_id, page_id % 9 <= 6 AS junk FROM pages")
def junk_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of every shape that names no article, and two that do."""
    shapes = ["'ab'", "'https://x.example/' || page_id", "'@ann_' || page_id", "'Ann on X: \"words ' || page_id || '\" / X'", "'Ann ' || page_id || ' (@ann) on Twitter'", "'Ann (@ann' || page_id || ')'", "'Words ' || page_id || ' / X'", "'A name of page ' || page_id", "'www.x.example is down, page ' || page_id"]
    title = F.expr("element_at(array(" + ", ".join(shapes) + "), cast(page_id % 9 + 1 as int))")
    return table(spark, sf_dir, "pages").select("page_id", titles.is_junk_title(title).alias("junk"))


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'webgpu' WHEN 1 THEN 'wasm' ELSE 'cpu' END AS device, CASE WHEN event_id % 2 = 0 THEN 'fp16' ELSE 'q8' END AS dtype, CAST(CASE WHEN event_id % 5 = 0 THEN 7 ELSE event_id % 4 END AS INT) AS threads FROM events
""")
def tier_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A developer's choices, where there are any, in place of a tier's own."""
    e = F.col("event_id")
    own = F.struct(F.lit("cpu").alias("device"), F.lit("q8").alias("dtype"), (e % 4).cast("int").alias("threads"))
    t = labels.override_tier(own, F.when(e % 3 == 0, "webgpu").when(e % 3 == 1, "wasm"), F.when(e % 2 == 0, "fp16"), F.when(e % 5 == 0, 7))
    return table(spark, sf_dir, "events").select("event_id", t.alias("t")).select("event_id", "t.*")
