"""Queries over texts: clean-up, predicates, titles, paragraphs, positions, search and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, text, titles
from ..functions.chunk import chunk_spans, middle_split
from ..functions.normalize import normalize
from ..operators import evaluate, locate, needles, paragraphs, plan
from .catalog import query, table, texts

WS = text.WS


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


LINES = "SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line, unnest(string_split(text, chr(10))) AS text FROM documents"
TRIM = lambda c: rf"regexp_replace(regexp_replace({c}, '^[{WS}]+', ''), '[{WS}]+$', '')"
#: Paragraphs of documents as SQL: (doc_id, para, text).
PARAGRAPHS = rf"""
  SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS para, regexp_replace(unnest(p), '[{WS}]+', ' ', 'g') AS text FROM (
    SELECT doc_id, CASE WHEN len(b) <= 1 AND len(text) > 500 THEN list_filter(list_transform(string_split(list_reduce(list_prepend('', CASE WHEN len(s) > 0 THEN s ELSE [text] END),
        lambda acc, x: CASE WHEN len(string_split(acc, chr(1))[-1]) > 300 THEN acc || chr(1) || x ELSE acc || x END), chr(1)), lambda t: {TRIM("t")}), lambda t: t <> '') ELSE b END AS p
    FROM (SELECT doc_id, text, regexp_extract_all(text, '[^.!?]+[.!?]+') AS s, CASE WHEN len(a) <= 2 THEN l ELSE a END AS b FROM (
      SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\n{{2,}}'), lambda t: {TRIM("t")}), lambda t: len(t) > 10) AS a,
        list_filter(list_transform(string_split(text, chr(10)), lambda t: {TRIM("t")}), lambda t: len(t) > 30) AS l FROM documents)))
"""


@query(PARAGRAPHS)
def plain_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.paragraphs(texts(spark, sf_dir, "documents", "doc_id", "text"))


@query(rf"""
WITH l AS (SELECT doc_id, list(text ORDER BY para) AS t FROM ({PARAGRAPHS}) GROUP BY doc_id), p AS (SELECT *, CASE WHEN t[3] IS NULL OR regexp_matches(t[3], '[|–—·•-]') THEN 'none at all' ELSE t[3] END AS x FROM l),
n AS (SELECT doc_id, t, x, CASE doc_id % 5 WHEN 0 THEN substr(t[1], 1, 8) WHEN 1 THEN 'Another name - Site ' || doc_id WHEN 2 THEN '' WHEN 3 THEN 'Paper | ' || x ELSE 'ab' END AS title FROM p),
s AS (SELECT *, title = '' OR len(title) <= 2 OR (doc_id % 5 = 0) OR (doc_id % 5 = 3 AND (list_contains(list_transform(t[2:3], lambda x: lower(x)), lower(x)) OR starts_with('paper', lower(t[1])) OR starts_with(lower(t[1]), 'paper') OR starts_with(lower(t[1]), lower(x)) OR starts_with(lower(x), lower(t[1]))))
  OR (doc_id % 5 = 1 AND (starts_with('another name', lower(t[1])) OR starts_with('site ' || doc_id, lower(t[1])))) AS said FROM n)
SELECT doc_id, CAST(len(t) + CASE WHEN said THEN 0 ELSE 1 END AS INT) AS n, CASE WHEN said THEN 'text' ELSE 'heading' END AS kind, CASE WHEN said THEN sha256(t[1]) WHEN doc_id % 5 = 1 THEN sha256('Another name') ELSE sha256(CASE WHEN len(x) > 5 THEN regexp_replace(regexp_replace(x, '^[{WS}]+', ''), '[{WS}]+$', '') ELSE 'Paper' END) END AS first FROM s
""")
def title_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under a title that they open with, do not have, say third, or that says nothing."""
    d = texts(spark, sf_dir, "documents", "doc_id", "text").withColumn("t", paragraphs.paragraph_array(F.col("text"))).filter(F.size("t") > 0)
    t3 = F.try_element_at("t", F.lit(3))
    third = F.when(t3.isNull() | t3.rlike("[|–—·•-]"), "none at all").otherwise(t3)
    case = F.col("doc_id") % 5
    title = F.when(case == 0, F.substring(F.element_at("t", 1), 1, 8)).when(case == 1, F.concat(F.lit("Another name - Site "), "doc_id")).when(case == 2, "").when(case == 3, F.concat(F.lit("Paper | "), third)).otherwise("ab")
    found = F.transform("t", lambda x: F.struct(F.lit("text").alias("kind"), x.alias("text")))
    out = d.withColumn("title", title).withColumn("p", paragraphs.title_first(found, F.col("title"), F.lit(None).cast("string"), F.lit("")))
    first = F.element_at("p", 1)
    return out.select("doc_id", F.size("p").alias("n"), first["kind"].alias("kind"), F.sha2(first["text"].cast("binary"), 256).alias("first"))


CUM = f"SELECT doc_id, para, CAST(len(text) AS BIGINT) AS chars, CAST(coalesce(sum(len(text)) OVER (PARTITION BY doc_id ORDER BY para ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum_chars FROM ({PARAGRAPHS})"


@query(CUM)
def cum_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    return plan.running_in_row(docs.select("doc_id", paragraphs.paragraph_array(F.col("text")).alias("p")), "doc_id", "p", "para")


@query(f"""
SELECT doc_id, CAST(p AS DOUBLE) AS p, max(para) AS para FROM (SELECT *, sum(chars) OVER (PARTITION BY doc_id) AS total FROM ({CUM})), (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 0.9, 1.0]) AS p)
WHERE cum_chars <= p * total GROUP BY doc_id, p
""")
def seek_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.seek(cum_chars(spark, sf_dir), "doc_id", [0.0, 0.25, 0.5, 0.9, 1.0], "para")


@query("""
SELECT doc_id, seconds, label, left_label, CASE WHEN total >= 90 THEN 'long' ELSE 'short' END AS size FROM (
  SELECT doc_id, s AS seconds, s AS total, CAST(floor(floor(s + 0.5) / 60) AS BIGINT) || ':' || lpad(CAST(CAST(floor(s + 0.5) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS label,
    CASE WHEN s < 45 THEN greatest(1, CAST(floor(s + 0.5) AS BIGINT)) || 's left' ELSE greatest(1, CAST(floor(s / 60 + 0.5) AS BIGINT)) || ' min left' END AS left_label
  FROM (SELECT doc_id, n_chars / 16.0::DOUBLE AS s FROM documents))
""")
def time_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("n_chars") / F.lit(16.0)
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("seconds"), labels.clock_label(s).alias("label"), labels.time_left(s).alias("left_label"), F.when(s >= 90, "long").otherwise("short").alias("size"))


SAID = f"""
SELECT doc_id, CASE WHEN t <> '' AND NOT regexp_matches(t, '[.!?…:;,"'')\\]]$') THEN t || '.' ELSE t END AS said FROM (SELECT doc_id, {TRIM('t')} AS t FROM (
SELECT doc_id, {"regexp_replace(" * 12}text, '{text.INVISIBLE}', '', 'g'), '{text.CITATION}', '', 'g'), '{text.URL}', 'link', 'g'), '{text.EMAIL}', 'email address', 'g'),
  {", ".join(f"'{p.replace(chr(39), chr(39) * 2)}', '{r.replace(chr(39), chr(39) * 2)}', 'g')" for p, r in text.PUNCTUATION)} AS t FROM documents))
"""


@query(SAID)
def citation_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.after_rules(text.before_rules(F.col("text"))).alias("said"))


@query(SAID)
def speech_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same steps as segments get them, in Python around the rules."""
    return texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.punctuated("text").alias("said"))


@query(rf"""
WITH l AS ({LINES})
SELECT doc_id, line, regexp_matches(text, '[\p{{L}}\p{{N}}]') AS speakable, like_sentence, len(text) < 60 AND NOT like_sentence AND (regexp_matches(text, '(?i){text.META}') OR regexp_matches(text, '(?i){text.DATE}')) AS meta
FROM (SELECT *, regexp_matches(text, '[.!?…]["”'')\]]*$') AND len(regexp_split_to_array(text, '[{WS}]+')) >= 6 AS like_sentence FROM l)
""")
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _lines(spark, sf_dir).select("doc_id", "line", text.speakable(t).alias("speakable"), text.sentence_like(t).alias("like_sentence"), text.looks_like_meta(t).alias("meta"))


TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
H1 = "regexp_extract(html, '<h1>([^<]*)</h1>', 1)"
SEPARATOR = titles.SEPARATOR
CLEAN = lambda c: rf"CASE WHEN len(list_filter(list_transform(regexp_split_to_array({c}, '{SEPARATOR}'), lambda t: {TRIM('t')}), lambda t: t <> '')) > 1 THEN list_reduce(list_filter(list_transform(regexp_split_to_array({c}, '{SEPARATOR}'), lambda t: {TRIM('t')}), lambda t: t <> ''), lambda a, b: CASE WHEN len(b) > len(a) THEN b ELSE a END) ELSE {TRIM(c)} END"


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("doc"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h1"))


@query(f"SELECT page_id, {CLEAN('doc')} AS clean, len({TRIM('doc')}) < 3 AS junk, {CLEAN(chr(39) + 'Some Name - ' + chr(39) + ' || h1')} AS joined FROM (SELECT page_id, {TITLE} AS doc, {H1} AS h1 FROM pages)")
def clean_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titled(spark, sf_dir).select("page_id", titles.clean_title(F.col("doc")).alias("clean"), titles.is_junk_title(F.col("doc")).alias("junk"), titles.clean_title(F.concat(F.lit("Some Name - "), "h1")).alias("joined"))


@query(f"SELECT page_id, CASE WHEN len({TRIM('h1')}) >= 3 THEN {TRIM('h1')} ELSE {CLEAN('doc')} END AS title FROM (SELECT page_id, {TITLE} AS doc, {H1} AS h1 FROM pages)")
def choose_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _titled(spark, sf_dir)
    return t.select("page_id", titles.choose_title(F.lit("https://t.co/x"), F.col("h1"), F.lit(None).cast("string"), F.col("doc")).alias("title"))


@query(f"""
SELECT page_id, c >= least(len(a), len(b)) * 0.8::DOUBLE AND (c >= 2 OR len(a) = len(b)) AND len(a) > 0 AND len(b) > 0 AS same FROM (
  SELECT page_id, a, b, len(list_filter(a, lambda w: list_contains(b, w))) AS c FROM (
    SELECT page_id, regexp_extract_all(lower({TITLE}), '[\\p{{L}}\\p{{N}}]+') AS a, regexp_extract_all(lower({H1}), '[\\p{{L}}\\p{{N}}]+') AS b FROM pages))
""")
def title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titled(spark, sf_dir).select("page_id", text.matches_title(F.col("doc"), F.col("h1")).alias("same"))


@query(f"""
SELECT page_id, c >= least(len(a), len(b)) * 0.8::DOUBLE AND (c >= 2 OR len(a) = len(b)) AND len(a) > 0 AND len(b) > 0 AS same FROM (
  SELECT page_id, a, b, len(list_filter(a, lambda w: list_contains(b, w))) AS c FROM (
    SELECT page_id, regexp_extract_all(lower({TITLE}), '[\\p{{L}}\\p{{N}}]+') AS a, regexp_extract_all(lower({H1}), '[\\p{{L}}\\p{{N}}]+') AS b FROM pages))
""")
def title_match_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name under which title_match first compared whole headings."""
    return _titled(spark, sf_dir).select("page_id", text.matches_title(F.col("doc"), F.col("h1")).alias("same"))


@query(r"""
SELECT page_id, host, host || '-' || substr(sha1(url), 1, 6) AS slug, host AS site FROM (SELECT page_id, url, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\.', '') AS host FROM pages)
""")
def page_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.corpus import host_of, slug_of
    from ..sources.pages import site_name

    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", host_of(F.col("url")).alias("host"), slug_of(F.col("url")).alias("slug"), site_name(F.col("html"), F.col("url")).alias("site"))


@query(r"SELECT DISTINCT t AS tag, CASE WHEN regexp_matches(t, '^h[1-6]$') THEN 'heading' WHEN t = 'blockquote' THEN 'quote' WHEN t IN ('li', 'dd', 'dt') THEN 'list' ELSE 'text' END AS kind, CASE WHEN regexp_matches(t, '^h[1-6]$') THEN 2 WHEN t IN ('li', 'dd', 'dt') THEN 6 ELSE 12 END AS least, CASE WHEN regexp_matches(t, '^h[1-6]$') THEN CAST(t[2] AS INT) ELSE 2 END AS level FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS t FROM pages)")
def tag_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag")).distinct()
    kind = text.kind_of(F.col("tag"))
    return tags.select("tag", kind.alias("kind"), text.min_length(kind).alias("least"), text.heading_level(F.col("tag"), F.lit(None).cast("string")).alias("level"))


@query(rf"""
WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS names FROM pages UNION SELECT unnest(['social-share', 'relatedPosts', 'subscriber-content', 'newsletterSignup', 'post-comments', 'content-with-sidebar', '', 'article body', 'ad_slot x']))
SELECT names, len(list_filter(list_transform(list_filter(regexp_split_to_array(names, '[{WS}]+'), lambda t: t <> ''), lambda t: lower(regexp_replace(t, '([a-z])([A-Z])', '\1-\2', 'g'))),
  lambda t: regexp_matches(t, '{text.JUNK_INSIDE}') OR (NOT (regexp_matches(t, '{text.CONTENT_NAME}') AND len(list_filter(regexp_split_to_array(t, '[-_:.]+'), lambda w: regexp_matches(w, '^comments?$'))) = 0)
    AND len(list_filter(regexp_split_to_array(t, '[-_:.]+'), lambda w: regexp_matches(w, '{text.JUNK_WORD}'))) > 0))) > 0 AS junk FROM n
""")
def junk_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('class="([^"]*)"'), F.lit(1))).alias("names"))
    more = spark.createDataFrame([(x,) for x in ("social-share", "relatedPosts", "subscriber-content", "newsletterSignup", "post-comments", "content-with-sidebar", "", "article body", "ad_slot x")], "names string")
    return found.unionByName(more).distinct().select("names", text.junk_name(F.col("names")).alias("junk"))


@query(rf"""
SELECT conv_id, turn, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS para, unnest(p) AS text FROM (
  SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda t: {TRIM(f"regexp_replace(t, '[{WS}]+', ' ', 'g')")}), lambda t: len(t) > 1) AS p FROM conversations)
""")
def selection_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.selection(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


KINDS = f"SELECT doc_id, line, text, CASE WHEN len(text) < 20 THEN 'heading' ELSE 'text' END AS kind FROM ({LINES})"


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("kind", F.when(F.length("text") < 20, "heading").otherwise("text"))


@query(f"SELECT doc_id, line, kind FROM (SELECT *, coalesce(max(CASE WHEN kind <> 'heading' THEN line END) OVER (PARTITION BY doc_id), min(line) OVER (PARTITION BY doc_id)) AS last FROM ({KINDS})) WHERE line <= last")
def trailing_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.drop_trailing_headings(_kinds(spark, sf_dir), "doc_id", "line").select("doc_id", "line", "kind")


PROMO_ROWS = f"SELECT doc_id, line, CASE WHEN line % 7 = 3 THEN 'Read more' WHEN line % 11 = 5 THEN 'See also: ' || text ELSE text END AS text, kind FROM ({KINDS})"


@query(rf"""
SELECT doc_id, line FROM (SELECT *, max(CASE WHEN label THEN line END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, max(CASE WHEN stop THEN line END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT *, len(text) <= 40 AND regexp_matches(text, '(?i){text.PROMO_LABEL}') AS label, kind = 'heading' OR len(text) >= 100 OR regexp_matches(text, '[.!?]["”’)]?$') AS stop, len(text) < 140 AND regexp_matches(text, '(?i){text.PROMO_INLINE}') AS inl FROM ({PROMO_ROWS})))
WHERE NOT (label OR inl OR (l IS NOT NULL AND (s IS NULL OR s <= l)))
""")
def promo_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("line") % 7 == 3, "Read more").when(F.col("line") % 11 == 5, F.concat(F.lit("See also: "), "text")).otherwise(F.col("text"))
    return paragraphs.drop_promos(_kinds(spark, sf_dir).withColumn("text", t), "doc_id", "line").select("doc_id", "line")


@query(rf"""
SELECT conv_id, turn, CAST(len(e) AS INT) AS n_words, CAST(coalesce(list_position(list_transform(e, lambda x: x >= 0.5::DOUBLE * len(text)), true), len(e)) - 1 AS INT) AS half, CAST(coalesce(list_position(list_transform(e, lambda x: x > 0.5::DOUBLE * len(text)), true), len(e)) - 1 AS INT) AS half_strict FROM (
  SELECT conv_id, turn, text, list_transform(range(1, len(w) + 1), lambda i: list_sum(list_transform(w[:i], lambda x: len(x)))) AS e FROM (SELECT conv_id, turn, text, regexp_extract_all(text, '[{WS}]*[^{WS}]+') AS w FROM conversations))
""")
def word_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends, half = locate.word_ends(F.col("text")), F.lit(0.5) * F.length("text")
    c = table(spark, sf_dir, "conversations").withColumn("e", ends)
    return c.select("conv_id", "turn", F.size("e").alias("n_words"), locate.word_at(F.col("e"), half).cast("int").alias("half"), locate.word_at(F.col("e"), half, True).cast("int").alias("half_strict"))


@query("""
WITH d AS (SELECT doc_id, lower(text) AS hay, substr(lower(text), 5, 4) AS needle, 20 AS start FROM documents WHERE len(text) >= 8)
SELECT doc_id, CAST(CASE WHEN a > 0 THEN a + 19 ELSE instr(hay, needle) - 1 END AS INT) AS at,
  CAST(CASE WHEN a = 0 THEN b - 1 WHEN b = 0 THEN a + 19 WHEN 20 - (b - 1) <= a + 19 - 20 THEN b - 1 ELSE a + 19 END AS INT) AS near FROM (
  SELECT *, instr(substr(hay, 21), needle) AS a, CASE WHEN instr(reverse(substr(hay, 1, 20 + len(needle))), reverse(needle)) > 0 THEN len(substr(hay, 1, 20 + len(needle))) - instr(reverse(substr(hay, 1, 20 + len(needle))), reverse(needle)) - len(needle) + 2 ELSE 0 END AS b FROM d)
""")
def locate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.length("text") >= 8).select("doc_id", locate.folded(F.col("text")).alias("hay")).withColumn("needle", F.substring("hay", 5, 4)).withColumn("start", F.lit(20))
    return d.select("doc_id", locate.find_from("hay", "needle", "start").cast("int").alias("at"), locate.nearest("hay", "needle", "start").cast("int").alias("near"))


@query("""
WITH l AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE doc_id % 2 = 0), r AS (SELECT doc_id AS twin, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE doc_id % 2 = 1)
SELECT doc_id, coalesce(twin, -1) AS twin FROM l LEFT JOIN r USING (text, n)
""")
def dup_text_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    right = d.filter("doc_id % 2 = 1").withColumnRenamed("doc_id", "twin")
    return locate.pair_equal(d.filter("doc_id % 2 = 0"), right, "text", "doc_id", "twin").select("doc_id", F.coalesce("twin", F.lit(-1)).alias("twin"))


GRAM = lambda c: f"list_transform(range(1, len({c})), lambda i: {c}[i] || ' ' || {c}[i + 1])"
TOK = r"regexp_extract_all(regexp_replace(strip_accents(lower(text)), '[’‘`]', '''', 'g'), '[\p{L}\p{N}]+(?:''\p{L}+)?')"
FOUND = rf"""
WITH b AS (SELECT source AS page, item_id AS block, {TOK} AS t, text FROM benchmark, (SELECT DISTINCT source FROM documents)),
x AS (SELECT DISTINCT source AS page, unnest({GRAM("t")}) AS g FROM (SELECT source, {TOK} AS t FROM documents)),
u AS (SELECT page, block, unnest({GRAM("t")}) AS g FROM b WHERE len(t) >= 3)
SELECT u.page, u.block, avg(CASE WHEN x.g IS NULL THEN 0 ELSE 1 END) AS f FROM u LEFT JOIN x ON u.page = x.page AND u.g = x.g GROUP BY u.page, u.block
"""


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tokenised items, as reference blocks of every source, and documents, as what was extracted; the sources are few, and their number bounds the product."""
    docs = texts(spark, sf_dir, "documents", "source", "doc_id", "text").withColumnsRenamed({"source": "page", "doc_id": "block"})
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "block").withColumn("kind", F.when(F.length("text") < 150, "heading").otherwise("text"))
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("page")).distinct()
    return evaluate.tokenised(items, "block", "kind").join(sources, F.lit(True)), docs


@query(FOUND)
def bigram_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, docs = _blocks(spark, sf_dir)
    return evaluate.found(reference, evaluate.tokenised(docs, "page", "block"), "page", "block")


SCORE = rf"""
WITH f AS ({FOUND}), o AS (SELECT f.*, len(text) AS n, len(text) < 150 AS heading FROM f JOIN benchmark ON item_id = block),
g AS (SELECT DISTINCT unnest({GRAM("t")}) AS g FROM (SELECT {TOK} AS t FROM benchmark)),
s AS (SELECT DISTINCT unnest(list_distinct(t || {GRAM("t")})) AS g FROM (SELECT {TOK} AS t FROM benchmark)),
d AS (SELECT source AS page, doc_id, len(text) AS n, {TOK} AS t FROM documents),
back AS (SELECT page, d.doc_id, d.n, CASE WHEN len(t) = 0 THEN 1.0 WHEN len(t) < 3 THEN (SELECT count(*) FROM s WHERE s.g = array_to_string(t, ' ')) ELSE q.f END AS f FROM d LEFT JOIN (
  SELECT doc_id, avg(CASE WHEN g.g IS NULL THEN 0 ELSE 1 END) AS f FROM (SELECT doc_id, unnest({GRAM("t")}) AS x FROM d WHERE len(t) >= 3) LEFT JOIN g ON g.g = x GROUP BY doc_id) q USING (doc_id))
SELECT page, round(recall, 9) AS recall, round(h_recall, 9) AS h_recall, htot, junk, out_chars, gt_chars, gt_blocks FROM (
  SELECT page, sum(n * f) / sum(n) AS recall, sum(CASE WHEN heading AND f >= 0.9 THEN 1 ELSE 0 END) / sum(CASE WHEN heading THEN 1 END) AS h_recall, CAST(sum(heading::INT) AS BIGINT) AS htot, CAST(sum(n) AS BIGINT) AS gt_chars, count(*) AS gt_blocks FROM o GROUP BY page)
JOIN (SELECT page, CAST(sum(CASE WHEN f < 0.5 THEN n ELSE 0 END) AS BIGINT) AS junk, CAST(sum(n) AS BIGINT) AS out_chars FROM back GROUP BY page) USING (page)
"""


@query(SCORE)
def extraction_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.score_texts(*_blocks(spark, sf_dir), "page", "block")
    return s.select("page", F.round("recall", 9).alias("recall"), F.round("h_recall", 9).alias("h_recall"), "htot", "junk", "out_chars", "gt_chars", "gt_blocks")


@query(rf"""
SELECT extractor, count(*) AS pages, round(avg(recall), 6) AS mean_recall, round(sum(recall * gt_chars) / sum(gt_chars), 6) AS pooled_recall, round(avg(CASE WHEN htot > 0 THEN h_recall END), 6) AS mean_h_recall, CAST(sum(junk) AS BIGINT) AS junk, CAST(sum((recall < 0.9)::INT) AS BIGINT) AS below_90, CAST(floor(avg(recall) * 100 + 0.5) AS BIGINT) || '%' AS shown
FROM (SELECT *, CASE WHEN len(page) = 4 THEN 'short' ELSE 'long' END AS extractor FROM ({SCORE})) WHERE gt_chars >= 2500 GROUP BY extractor
""")
def extractor_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = evaluate.aggregate(extraction_score(spark, sf_dir).withColumn("extractor", F.when(F.length("page") == 4, "short").otherwise("long")), "extractor")
    return a.select("extractor", "pages", F.round("mean_recall", 6).alias("mean_recall"), F.round("pooled_recall", 6).alias("pooled_recall"), F.round("mean_h_recall", 6).alias("mean_h_recall"), "junk", "below_90", evaluate.percent(F.col("mean_recall")).alias("shown"))


@query(r"""
WITH w AS (SELECT item_id, len(text) AS n, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE len(text) >= 80), m AS (SELECT item_id, n, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
d AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), t AS (SELECT DISTINCT unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d)
SELECT item_id, CAST(n AS BIGINT) AS chars FROM m LEFT JOIN t ON m.g = t.g GROUP BY item_id, n HAVING sum(CASE WHEN t.g IS NULL THEN 0 ELSE 1 END) < count(*) * 0.9::DOUBLE
""")
def shingle_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.uncovered(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id")


@query("SELECT page_id, contains(html, '<article>') AS has_article, NOT contains(html, '<blink>') AS lacks_blink, CAST(len(regexp_extract_all(html, '<p>')) AS INT) AS n_p FROM pages")
def fixture_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.corpus import expectation

    pages = table(spark, sf_dir, "pages").withColumn("want", expectation(F.lit('<!-- expect: {"has": ["<article>"], "lacks": ["<blink>"], "count": {"<p>": 1}} -->')))
    has = F.forall("want.has", lambda x: F.contains("html", x))
    lacks = F.forall("want.lacks", lambda x: ~F.contains("html", x))
    return pages.select("page_id", has.alias("has_article"), lacks.alias("lacks_blink"), F.size(F.regexp_extract_all("html", F.map_keys("want.count")[0], F.lit(0))).alias("n_p"))


@query()
def normalized_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the rules and through the whole preparation; checked by expectation tables in tests."""
    return texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2(normalize("text").cast("binary"), 256).alias("normalized"), F.sha2(text.speech("text").cast("binary"), 256).alias("said"))


@query()
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plain_paragraphs(spark, sf_dir)
    s = p.select("doc_id", F.explode(chunk_spans("text", F.lit("text"), F.col("para") == 0)).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.max(F.col("s.end") - F.col("s.start")).alias("longest"), F.sum("s.pause_ms").alias("pause_ms"))


@query(rf"""
WITH d AS (SELECT doc_id, text, len(text) AS n FROM documents), p AS (
  SELECT doc_id, n, m, CAST(generate_subscripts(string_split(text, mark), 1) AS BIGINT) AS i, len(unnest(string_split(text, mark))) + 1 AS size FROM d, (VALUES (1, ';'), (2, ':'), (3, ',')) v(m, mark)
  UNION ALL SELECT doc_id, n, 4, CAST(generate_subscripts(regexp_split_to_array(text, '[{WS}]'), 1) AS BIGINT), len(unnest(regexp_split_to_array(text, '[{WS}]'))) + 1 FROM d),
e AS (SELECT doc_id, n, m, sum(size) OVER (PARTITION BY doc_id, m ORDER BY i) AS place, i < count(*) OVER (PARTITION BY doc_id, m) AS inner_ FROM p),
f AS (SELECT doc_id, n, m, arg_min(place, (abs(place - n / 2), place)) AS place FROM e WHERE inner_ AND place BETWEEN 8 AND n - 8 GROUP BY doc_id, n, m),
g AS (SELECT doc_id, arg_min(place, m) AS place FROM f WHERE m = 4 OR abs(place - n / 2) <= 0.3::DOUBLE * n GROUP BY doc_id)
SELECT doc_id, CAST(CASE WHEN place IS NOT NULL THEN len({TRIM("substr(text, 1, CAST(place AS BIGINT))")}) WHEN n > 1 THEN n // 2 END AS INT) AS head_chars, CAST(CASE WHEN place IS NOT NULL THEN len({TRIM("substr(text, CAST(place AS BIGINT) + 1)")}) WHEN n > 1 THEN n - n // 2 END AS INT) AS tail_chars FROM d LEFT JOIN g USING (doc_id)
""")
def middle_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", middle_split("text").alias("x")).select("doc_id", F.length("x.head").alias("head_chars"), F.length("x.tail").alias("tail_chars"))


SOLID = lambda c: rf"len(regexp_replace({c}, '[\s{WS}]+', '', 'g'))"


@query(rf"""
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_paras, CAST(sum({SOLID("text")}) AS BIGINT) AS solid, true AS ordered, true AS short_enough, true AS at_spaces, CAST(sum(CASE WHEN len(text) <= 140 THEN 1 ELSE 0 END) AS BIGINT) AS whole, CAST(count(*) * 450 AS BIGINT) AS last_pauses
FROM ({PARAGRAPHS}) GROUP BY doc_id
""")
def chunk_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What spans must keep of every paragraph: all that is no white space, in order, cut at white space, no span too long that has a gap between plain words, short paragraphs whole, a long pause at the end."""
    p = plain_paragraphs(spark, sf_dir).withColumn("spans", chunk_spans("text", F.lit("text"), F.lit(False)))
    cut = lambda s: F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"])
    pieces = F.transform("spans", cut)
    solid = F.length(F.regexp_replace(F.array_join(pieces, ""), rf"[\s{WS}]+", ""))
    pairs = F.zip_with(F.slice("spans", F.lit(1), F.size("spans") - 1), F.slice("spans", F.lit(2), F.size("spans") - 1), lambda a, b: F.struct(a["end"].alias("end"), b["start"].alias("start")))
    between = F.transform(pairs, lambda g: F.substr(F.col("text"), g["end"] + 1, g["start"] - g["end"]))
    facts = p.select(
        "doc_id", solid.alias("solid"), F.forall(pairs, lambda g: g["end"] <= g["start"]).alias("ordered"), F.forall(pieces, lambda t: (F.length(t) <= 420) | ~t.rlike(rf"\p{{L}}{{2,}}[{WS}]+\p{{L}}{{2,}}")).alias("short_enough"),
        F.forall(between, lambda t: t.rlike(rf"^[{WS}]+$")).alias("at_spaces"), ((F.length("text") <= 140) & (F.size("spans") == 1)).cast("long").alias("whole"), F.element_at("spans", -1)["pause_ms"].alias("pause"),
    )
    return facts.groupBy("doc_id").agg(F.count("*").alias("n_paras"), F.sum("solid").alias("solid"), *[F.bool_and(c).alias(c) for c in ("ordered", "short_enough", "at_spaces")], F.sum("whole").alias("whole"), F.sum("pause").alias("last_pauses"))


@query(rf"""
WITH s AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_paras, CAST(sum(len(regexp_replace(text, '[^\p{{L}}\p{{N}}]+', '', 'g'))) AS BIGINT) AS solid FROM ({PARAGRAPHS}) WHERE regexp_matches(text, '[\p{{L}}\p{{N}}]') GROUP BY doc_id)
SELECT doc_id, n_paras, solid, true AS numbered, true AS summed, true AS said FROM s
""")
def plan_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reading plan must keep of every document that says something: its paragraphs, letters and digits, segments numbered without gaps, sums that add up, and speech that ends in a mark without links or markup."""
    from pyspark.sql import Window

    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    said = F.col("speech").rlike(r"[.!?…:;,\"')\]]$") & ~F.col("speech").rlike(r"https?://|[*_#`~^|<>{}\\&/]") & ~F.col("speech").rlike(rf"[{WS}]{{2,}}")
    solid = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]+", ""))
    # texts are judged where they are made; only numbers are dealt out by document
    seg = plan.segments(docs, "doc_id", "text", start_paragraph=0).select("doc_id", "seg_idx", "para", "chars", "cum_chars", solid.alias("solid"), said.alias("said"))
    w = Window.partitionBy("doc_id").orderBy("seg_idx")
    before = F.coalesce(F.lag(F.col("cum_chars") + F.col("chars")).over(w), F.lit(0))
    seg = seg.withColumn("summed", before == F.col("cum_chars")).withColumn("numbered", F.row_number().over(w) - 1 == F.col("seg_idx"))
    return seg.groupBy("doc_id").agg(F.countDistinct("para").alias("n_paras"), F.sum("solid").alias("solid"), F.bool_and("numbered").alias("numbered"), F.bool_and("summed").alias("summed"), F.bool_and("said").alias("said"))


@query()
def reading_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    return plan.segments(docs, "doc_id", "text", start_paragraph=0).select("doc_id", "seg_idx", "para", "start", "end", "pause_ms", "chars", "cum_chars", F.sha2(F.col("speech").cast("binary"), 256).alias("speech_sha256"))


@query("""
WITH p AS (SELECT conv_id, turn, 0 AS piece, CASE WHEN turn = 0 AND len(text) > 20 THEN substr(text, 1, 20) ELSE text END AS text FROM conversations UNION ALL SELECT conv_id, turn, 1, substr(text, 21) FROM conversations WHERE turn = 0 AND len(text) > 20)
SELECT conv_id, CAST(row_number() OVER w - 1 AS BIGINT) AS seg_idx, CAST(len(text) AS BIGINT) AS chars, CAST(coalesce(sum(len(text)) OVER (PARTITION BY conv_id ORDER BY turn, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum_chars FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn, piece)
""")
def ramp_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    pieces = F.when((F.col("turn") == 0) & (F.length("text") > 20), F.array(F.substring("text", 1, 20), F.expr("substring(text, 21)")))
    return plan.ramp_split(c, "conv_id", "turn", pieces).drop("text")


@query(rf"""
SELECT page, '| ' || page || CASE WHEN gt_chars < 2500 THEN ' (GT weak, excluded from aggregate)' ELSE '' END || ' | ' || gt_blocks || ' / ' || gt_chars || ' | ' || CAST(floor(recall * 100 + 0.5) AS BIGINT) || '% / ' || CASE WHEN h_recall IS NULL THEN ' n/a' ELSE CAST(floor(h_recall * 100 + 0.5) AS BIGINT) || '%' END || ' / ' || junk || ' |' AS line FROM ({SCORE})
""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return extraction_score(spark, sf_dir).select("page", evaluate.report_line(c("page"), c("gt_blocks"), c("gt_chars"), c("recall"), c("h_recall"), c("junk")).alias("line"))


@query("SELECT source, sum(CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE 0 END) >= sum(CASE WHEN doc_id % 2 = 1 THEN n_chars ELSE 0 END) * 0.7::DOUBLE AND sum(CASE WHEN doc_id % 16 = 1 THEN n_chars ELSE 0 END) <= sum(CASE WHEN doc_id % 2 = 1 THEN n_chars ELSE 0 END) * 0.1::DOUBLE AS ok FROM documents GROUP BY source")
def root_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda hit: F.sum(F.when(hit, F.col("n_chars")).otherwise(0))
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").groupBy("source").agg(evaluate.accepted(part(d % 2 == 0), part(d % 2 == 1), part(d % 16 == 1)).alias("ok"))


def _near_middle(text_: str, mark: str) -> str:
    """SQL for the end of the mark nearest the middle of a text of n characters, h of them in its first half; null for none."""
    left = f"CASE WHEN instr(reverse(substr({text_}, 1, h)), '{mark}') > 0 AND h - instr(reverse(substr({text_}, 1, h)), '{mark}') + 1 BETWEEN 8 AND n - 8 THEN h - instr(reverse(substr({text_}, 1, h)), '{mark}') + 1 END"
    right = f"CASE WHEN instr(substr({text_}, h + 1), '{mark}') > 0 AND h + instr(substr({text_}, h + 1), '{mark}') BETWEEN 8 AND n - 8 THEN h + instr(substr({text_}, h + 1), '{mark}') END"
    return f"CASE WHEN ({left}) IS NULL THEN ({right}) WHEN ({right}) IS NULL OR n / 2 - ({left}) <= ({right}) - n / 2 THEN ({left}) ELSE ({right}) END"


@query(rf"""
WITH RECURSIVE p AS (
  SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, unnest(CASE WHEN e IS NULL THEN [substr(t, 1, h), substr(t, h + 1)] ELSE [{TRIM("substr(t, 1, e)")}, {TRIM("substr(t, e + 1)")}] END) FROM (
    SELECT doc_id, t, h, CASE WHEN abs(a - n / 2) <= 0.3::DOUBLE * n THEN a WHEN abs(b - n / 2) <= 0.3::DOUBLE * n THEN b WHEN abs(c - n / 2) <= 0.3::DOUBLE * n THEN c ELSE d END AS e FROM (
      SELECT doc_id, t, n, h, {_near_middle("t", ";")} AS a, {_near_middle("t", ":")} AS b, {_near_middle("t", ",")} AS c, {_near_middle("w", " ")} AS d FROM (
        SELECT doc_id, t, regexp_replace(t, '[{WS}]', ' ', 'g') AS w, len(t) AS n, len(t) // 2 AS h FROM p WHERE len(t) > 500)))
)
SELECT doc_id, CAST(sum(CASE WHEN len(t) <= 500 THEN 1 ELSE 0 END) AS INT) AS n_parts FROM p GROUP BY doc_id
""")
def budget_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.chunk import budget_parts as parts

    return texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.size(parts("text", F.lit(500))).alias("n_parts"))


@query("""
WITH c AS (SELECT item_id, text, r.rank AS rank, greatest(CAST(floor((len(text) - 50) * r.share) AS INT), 0) AS s FROM benchmark, (VALUES (0, 0.5::DOUBLE), (1, 0.2::DOUBLE), (2, 0.8::DOUBLE)) r(rank, share)),
n AS (SELECT item_id, rank, substr(text, CASE WHEN instr(substr(text, s + 1), ' ') > 0 THEN s + instr(substr(text, s + 1), ' ') ELSE 0 END + 1, 50) AS snippet FROM c),
h AS (SELECT item_id, rank, doc_id, snippet, text, len(text) // 2 AS half FROM n JOIN documents ON contains(text, snippet) WHERE len(snippet) >= 40)
SELECT item_id, rank, doc_id, CAST(CASE WHEN instr(substr(text, half + 1), snippet) > 0 THEN half + instr(substr(text, half + 1), snippet) ELSE instr(text, snippet) END - 1 AS INT) AS at FROM h
""")
def needle_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where three pieces of every benchmark item stand in all documents: the first place in the second half of a document, else the first of all."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(needles.snippets(F.col("text"))).alias("s")).select(F.struct("item_id", "s.rank").alias("needle_id"), F.col("s.snippet").alias("needle"))
    docs = texts(spark, sf_dir, "documents", "doc_id", "text").withColumn("half", F.floor(F.length("text") / 2))
    found = needles.occurrences(docs, items, ["doc_id", "half"])
    return needles.first_from(found, ["needle_id", "doc_id"], F.col("half")).select("needle_id.item_id", "needle_id.rank", "doc_id", "at")
