"""Queries over web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.titles import choose_title
from ..operators import locate, paragraphs, plan, root_text
from ..sources import pages
from .catalog import query, table, texts


@query()
def article_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: title, paragraphs, segments, characters and seconds of reading."""
    title = choose_title(pages.meta(F.col("html"), "property", "og:title"), F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1), F.lit(None).cast("string"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    window = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    raw = texts(spark, sf_dir, "pages", "page_id", "html").withColumn("title", title).withColumn("window", window)
    found = pages.articles(raw, carry=("title", "window")).withColumn("paragraphs", F.transform("paragraphs", lambda p: F.struct(p["kind"].alias("kind"), p["text"].alias("text"))))
    found = found.withColumn("paragraphs", paragraphs.title_first(F.col("paragraphs"), F.col("title"), F.lit(None).cast("string"), F.col("window")))
    segments = plan.segments(found, "page_id", start_paragraph=0, carry=("title",), outer=True)
    counted = F.count("seg_idx")
    stats = (F.when(counted > 0, F.countDistinct("para")), F.when(counted > 0, counted), F.sum("chars"), F.sum("chars") * plan.SECONDS_PER_CHAR + F.sum("pause_ms") / 1000)
    return segments.groupBy("page_id", "title").agg(*[c.alias(n) for c, n in zip(stats, ("n_paras", "n_segments", "total_chars", "est_seconds"), strict=True)])


@query(r"""
SELECT page_id, kind, count(*) AS n FROM (SELECT page_id, 'heading' AS kind FROM pages WHERE len(trim(regexp_extract(html, '<h1>(.*?)</h1>', 1))) >= 2
UNION ALL SELECT page_id, 'text' FROM (SELECT page_id, unnest(regexp_split_to_array(regexp_extract(html, '</h1>(.*)</article>', 1), '<p>|</p>')) AS t FROM pages) WHERE len(replace(replace(replace(trim(regexp_replace(t, '<[^>]*>', ' ', 'g')), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')) >= 12) GROUP BY page_id, kind
""")
def article_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.paragraphs(texts(spark, sf_dir, "pages", "page_id", "html")).groupBy("page_id", "kind").agg(F.count("*").alias("n"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n_p, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS n_li FROM pages")
def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = pages.elements(texts(spark, sf_dir, "pages", "page_id", "html"))
    return e.groupBy("page_id").agg(F.sum((F.col("tag") == "p").cast("long")).alias("n_p"), F.sum((F.col("tag") == "li").cast("long")).alias("n_li"))


@query()
def article_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deepest element that holds four fifths of a page's characters, by running sums and one aggregate."""
    sized = pages.subtree_chars(pages.elements(texts(spark, sf_dir, "pages", "page_id", "html")).filter(~F.col("tag").isin("script", "style", "title")))
    total = sized.filter("node = 0").select(F.col("page_id").alias("p"), F.col("total").alias("all"))
    held = sized.join(total, F.col("page_id") == F.col("p")).filter(F.col("total") >= F.lit(0.8) * F.col("all"))
    return held.groupBy("page_id").agg(F.max_by("tag", F.struct("depth", -F.col("node"))).alias("tag"), F.max("depth").alias("depth"))


@query(r"""
WITH t AS (SELECT page_id, CAST(generate_subscripts(x, 1) AS BIGINT) AS node, unnest(x) AS tag FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'g'), '<([a-z][a-z0-9]*)', 1) AS x FROM pages))
SELECT a.page_id, a.node AS point, 'li' AS tag, max(b.node) AS start FROM t a JOIN t b ON b.page_id = a.page_id AND b.tag = 'li' AND b.node < a.node WHERE a.tag = 'a' GROUP BY a.page_id, a.node
""")
def enclosing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost paragraph, list item or heading around every link of a page."""
    e = pages.elements(texts(spark, sf_dir, "pages", "page_id", "html"))
    points = e.filter("tag = 'a'").select("page_id", F.col("node").alias("point"))
    blocks = e.filter(F.col("tag").isin("p", "li", "h1", "h2", "nav", "article")).select("page_id", F.col("node").alias("start"), "end", "depth", "tag")
    return locate.enclosing(points, blocks, "page_id").select("page_id", "point", "tag", "start")


@query("SELECT page_id, CAST(NULL AS VARCHAR) AS image, '' AS author FROM pages")
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", pages.lead_image(F.col("html")).alias("image"), pages.meta(F.col("html"), "name", "author").alias("author"))


@query()
def root_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element that holds each page's article, by pieces of its longest paragraphs; null where they do not tell."""
    return root_text.roots(texts(spark, sf_dir, "pages", "page_id", "html"))
