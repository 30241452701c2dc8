from __future__ import annotations

import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textloom import registry
from textloom.functions import labels, text, titles
from textloom.operators import cache, evaluate, paragraphs, plan, sessions, tree
from textloom.sources import corpus, html_tree, pages
from textloom.streaming.sessions import fold, play, play_batch

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def values(df):
    return [tuple(r) for r in df.collect()]


def test_titles(spark):
    df = spark.createDataFrame([("Why we save | Site",), ("A - B - Longest part",), (None,), ("x",), ("Name (@me) on X",)], "t string")
    assert values(df.select(titles.clean_title(F.col("t")))) == [("Why we save",), ("Longest part",), ("",), ("x",), ("Name (@me) on X",)]
    assert values(df.select(titles.is_junk_title(F.col("t")))) == [(False,), (False,), (True,), (True,), (True,)]
    assert values(df.limit(1).select(titles.choose_title(F.lit("@me"), F.lit(None).cast("string"), F.lit(""), F.col("t")))) == [("Why we save",)]


def test_title_match_reads_whole_headings(spark, tmp_path):
    start = "Why the patient readers of long"
    rows = [(1, f"<title>{start} books win</title><h1>{start} books win</h1>"), (2, f"<title>{start[:30]}</title><h1>Quite another heading of more than thirty characters: {start[:30]}</h1>"), (3, "<title>One</title><h1>Two</h1>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert dict(values(registry.queries()["title_match_whole"](spark, str(tmp_path)))) == {1: True, 2: True, 3: False}


def test_labels(spark):
    df = spark.createDataFrame([(102.0,), (0.4,), (None,)], "s double")
    assert values(df.select(labels.clock_label(F.col("s")), labels.time_left(F.col("s")), labels.spoken_time(F.col("s"))))[:2] == [("1:42", "2 min left", "1 minute 42 seconds"), ("0:00", "1s left", "0 seconds")]
    assert values(df.limit(1).select(labels.step_speed(F.lit(1.1), F.lit(1)), labels.step_speed(F.lit(9.0), F.lit(1)))) == [(1.25, 2.0)]


def test_junk_names_and_dates(spark):
    df = spark.createDataFrame([("social-share",), ("relatedPosts",), ("promoBox",), ("",)], "n string")
    assert values(df.select(text.junk_name(F.col("n")))) == [(True,), (False,), (True,), (False,)]
    dates = spark.createDataFrame([("May 2008 The start",), ("Maybe not",)], "t string")
    assert values(dates.select(text.strip_leading_date(F.col("t")))) == [("The start",), ("Maybe not",)]


def test_paragraph_branches(spark):
    rows = [(0, "one long paragraph\n\nanother long one here\n\nand a third of them"), (1, "x" * 40 + "\n" + "y" * 40), (2, "Short sentence. " * 60), (3, None), (4, "")]
    out = paragraphs.paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id").count()
    counts = dict(values(out))
    assert counts[0] == 3 and counts[1] == 2 and counts[2] > 1 and 3 not in counts and 4 not in counts


def test_seek_and_segments(spark):
    long = [("text", "word " * 30)] * 4
    rows = spark.createDataFrame([(1, long), (2, []), (3, None), (4, [("text", None), ("text", "***")])], "doc long, paragraphs array<struct<kind:string,text:string>>")
    assert plan.segments(rows, "doc").filter("doc > 1").count() == 0
    assert sorted((r.doc, r.seg_idx) for r in plan.segments(rows, "doc", outer=True).filter("doc > 1").collect()) == [(2, None), (3, None), (4, None)]
    assert plan.segments(rows.limit(0), "doc").count() == 0
    seg = plan.segments(rows.filter("doc = 1"), "doc", start_paragraph=0)
    assert [r.cum_chars for r in seg.orderBy("seg_idx").collect()] == [0, *[sum(r.chars for r in seg.orderBy("seg_idx").collect()[:i]) for i in range(1, seg.count())]]
    assert dict((r.p, r.seg_idx) for r in plan.seek(seg, "doc", [0.0, 1.0], "seg_idx").collect()) == {0.0: 0, 1.0: seg.count() - 1}


def test_running_sums_need_no_shuffle(spark):
    rows = spark.createDataFrame([(1, ["abc", "é", None]), (2, None), (3, []), (4, ["日本"])], "doc long, texts array<string>")
    got = plan.running_in_row(rows, "doc", "texts", "para")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 3, 0), (1, 1, 1, 3), (1, 2, 0, 4), (4, 0, 2, 0)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_scores_ignore_how_accents_are_written(spark):
    blocks = spark.createDataFrame([("p", 1, "Une cafe\u0301 noir e\u0301te\u0301"), ("p", 2, "nothing like that here"), ("p", 3, "caf\u00e9"), ("p", 4, "?!")], "page string, block long, text string")
    others = spark.createDataFrame([("p", 9, "une caf\u00e9 noir \u00e9t\u00e9")], "page string, block long, text string")
    got = evaluate.found(evaluate.tokenised(blocks, "page", "block"), evaluate.tokenised(others, "page", "block"), "page", "block")
    assert {r.block: r.f for r in got.collect()} == {1: 1.0, 2: 0.0, 3: 1.0, 4: 1.0}


def test_eviction_is_a_prefix(spark):
    rows = spark.createDataFrame([(f"k{i}", f"2024-01-01 0{i}:00:00", 40) for i in range(6)], "key string, ts string, bytes long").withColumn("ts", F.to_timestamp("ts"))
    out = cache.evict(rows, F.expr("TIMESTAMP '2024-01-01 12:00:00'"), 100).orderBy("ts")
    assert [r.evicted for r in out.collect()] == [True] * 4 + [False] * 2
    pcm = spark.range(1).select(cache.to_pcm(F.array(F.lit(2.0), F.lit(-2.0), F.lit(0.5), F.lit(-0.5))).alias("p")).first().p
    assert pcm == [32767, -32768, 16384, -16383]


def test_eviction_by_one_budget_in_ranges(spark):
    rows = [(f"k{i % 97:02d}{i}", f"2024-01-01 {i % 20:02d}:00:00", i % 13) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, ts string, bytes long").withColumn("ts", F.to_timestamp("ts"))
    out = cache.evict(df, F.expr("TIMESTAMP '2024-01-01 23:00:00'"), 1000)
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    held, want = 0, {}
    for key, _, size in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True):
        held += size
        want[key] = held > 900
    assert {r.key: r.evicted for r in out.collect()} == want and "cache_evict_all" in registry.queries()


def test_runs_and_sessions(spark):
    e = spark.createDataFrame([(1, i, f"2024-01-01 00:{m:02d}:00", "error" if i in (1, 2, 3) else "ok") for i, m in enumerate([0, 1, 2, 3, 20])], "u long, id long, ts string, s string").withColumn("ts", F.to_timestamp("ts"))
    assert [r.run_length for r in sessions.runs(e, "u", "ts", "id", F.col("s") == "error").collect()] == [3]
    assert [r.session for r in sessions.idle_sessions(e, "u", "ts", "id").orderBy("id").collect()] == [0, 0, 0, 0, 1]



def test_process_tree_has_no_row_or_level_limit(spark, tmp_path):
    rows = [(i, i % 7 + 1) for i in range(300)] + [(5, 9)]
    spark.createDataFrame(rows, "doc_id long, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    kept = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        got = {r.root: (r.processes, r.rss) for r in registry.queries()["process_tree"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", kept)

    want = {}
    for root in (0, 1, 5):
        reached, level = [], [r for r, _ in rows if r == root]
        while level:
            reached += level
            level = [c for pid in level for c, _ in rows if c > 0 and c // 3 == pid]
        joined = [n for pid in reached for c, n in rows if c == pid]
        want[root] = (len(joined), sum(joined))
    assert got == want
    chain = spark.createDataFrame([(i, i - 1, 1) for i in range(8)], "pid long, parent long, rss long")
    assert values(tree.subtree_totals(chain, [3])) == [(3, 5, 5)]


PAGE = """<html><head><title>T</title><script>var x='<p>no</p>'</script></head><body><nav><ul><li><a href=/a>One link</a></ul></nav><article><h1>The name</h1>
<p>First paragraph that is long enough to count as real text of the article, with more words to pass eighty.<p>Second one, also of a fair length so that the root is this article and nothing else around it here.
<div class="social-share">Share this with everyone you know</div><h2>Recommended reading</h2><p>A short headline</p><h2>Next part</h2><p>Closing words of the article that end it in a proper sentence of enough length to count.</p><h3>Trailing</h3></article><footer>Footer words here</footer></body></html>"""


def test_article(spark):
    got = [(k, t.split()[0]) for _, k, t in html_tree.paragraphs(PAGE)]
    assert got == [("heading", "The"), ("text", "First"), ("text", "Second"), ("heading", "Next"), ("text", "Closing")]
    assert html_tree.paragraphs(None) == [] and html_tree.paragraphs("plain") == []
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")
    assert pages.paragraphs(df).count() == 5
    sized = pages.subtree_chars(pages.elements(df.limit(1)))
    assert sized.filter("node = 0").first().total == sized.agg(F.sum("chars")).first()[0]


LONG = "A paragraph of the article that is long enough to be read as its text, and to mark where the article's root is."


def said(html):
    return [t for _, _, t in html_tree.paragraphs(html)]


def test_article_of_divs_runs_and_cells():
    assert said(f"<body><div><div>{LONG}</div><div>Published March 12, 2026</div><div>Second part of the page in a plain div.</div></div></body>") == [LONG, "Second part of the page in a plain div."]
    assert said("<body>First line of a page of breaks.<br><br>Second <b>line</b> of a page of breaks.<br>It goes on.</body>") == ["First line of a page of breaks.", "Second line of a page of breaks. It goes on."]
    mixed = f"<article><h1>Name</h1><div>Lead text beside block children.<p>{LONG}</p>Trailing text after the paragraph.</div><blockquote>Words that open the quotation.<p>{LONG}</p></blockquote><ul><li>An item with a list below it<ul><li>Inner item</ul></ul><div>More {LONG}</div></article>"
    assert said(mixed) == ["Name", "Lead text beside block children.", LONG, "Trailing text after the paragraph.", "Words that open the quotation.", LONG, "An item with a list below it", "Inner item", f"More {LONG}"]
    assert [k for _, k, _ in html_tree.paragraphs(mixed)] == ["heading", "text", "text", "text", "quote", "text", "list", "list", "text"]
    cells = "<table><tr><td>A cell with a sentence long enough to read.<td>No sentence, only a few words here</table><table><thead><tr><th>X</thead><tr><td>A value cell under a head row</table><table class=infobox><tr><td>This is a sentence in a box of facts.</table>"
    assert said(f"<article><p>{LONG}</p>{cells}</article>") == [LONG, "A cell with a sentence long enough to read.", "A value cell under a head row"]
    assert html_tree.paragraphs(f"<article><div role=heading aria-level=3>Part</div><p>{LONG}</p></article>")[0][1:] == ("heading", "Part")


def test_promo_boxes_and_banners():
    box = "<div><h2>Recommended Reading</h2><p><a href=/a>The best novelist whose name you may not know.</a></p><div><a href=/b>A long headline of another piece that ends as a sentence, which no rule on short lines would drop.</a></div></div>"
    assert said(f"<article><p>{LONG}</p>{box}<p>{LONG}</p></article>") == [LONG, LONG]
    banner = '<div><header><h1 class="logo"><a href="/">The Daily Site</a></h1></header></div>'
    assert said(f"<body>{banner}<div><h1>Why patience wins</h1></div><div>{LONG}</div></body>") == ["Why patience wins", LONG]


def test_corpus(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# x\n\nnews https://www.a.org/b?c\nblog http://b.net/\n")
    assert [(r.category, r.slug[:6]) for r in corpus.read_corpus(spark, str(tmp_path / "urls.txt")).collect()] == [("news", "a.org-"), ("blog", "b.net-")]
    (tmp_path / "f.html").write_text('<!-- expect: {"has": ["x"], "first": "y"} --><p>x</p>')
    assert corpus.read_fixtures(spark, str(tmp_path / "f.html")).first().want.has == ["x"]


COMMANDS = [("s", 0, "start", None, None), ("s", 1, "result", None, 1), ("s", 2, "speed", "1.5", None), ("s", 3, "result", None, 1), ("s", 4, "next", None, None), ("s", 5, "toggle", None, None), ("t", 0, "stop", None, None)]


def test_session_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(COMMANDS, "session string, seq long, cmd string, value string, stamp long")
    batch = sorted(values(play_batch(df)))
    assert [r[-1] for r in batch if r[0] == "s"] == [False, False, False, True, False, False]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = play(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("played").option("checkpointLocation", str(tmp_path / "c")).start()
    deadline = time.time() + 60
    while spark.table("played").count() < len(batch) and time.time() < deadline:
        time.sleep(0.5)
    q.stop()
    assert sorted(values(spark.table("played"))) == batch
    assert fold([(0, "start", None, None), (0, "start", None, None)])[0] == [(0, "start", "starting", 0, 1.0, "af_heart", 1, False)]


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", ["article_stats", "cum_chars", "seek_asof", "session_gap", "tier_table", "page_host", "bigram_found"])
def test_registered(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def said_kinds(page):
    return [(k, t) for _, k, t in html_tree.paragraphs(page)]


def test_captions_and_bold_leads():
    body = f"<p>{LONG}</p>"
    got = said_kinds(f"<article>{body}<figure><img></figure><h6>A caption of the picture above</h6><h6>No caption</h6>{body}</article>")
    assert got[1:3] == [("text", "A caption of the picture above"), ("heading", "No caption")]
    long_figure = f"<figure><img><figcaption>{LONG}</figcaption></figure>"
    assert said_kinds(f"<article>{body}{long_figure}<h5>Next part</h5>{body}</article>")[2] == ("heading", "Next part")
    got = said_kinds(f"<article><p><span><strong>Lead <b>line</b></strong></span><br>Then the text goes on.</p><p>Text with <b>bold</b><br>inside it.</p><p><b>Only</b><br>short</p>{body}</article>")
    assert got == [("heading", "Lead line"), ("text", "Then the text goes on."), ("text", "Text with bold inside it."), ("text", "Only short"), ("text", LONG)] or got[:3] == [("heading", "Lead line"), ("text", "Then the text goes on."), ("text", "Text with bold inside it.")]


def test_roots():
    # a lone paragraph is read from its container, a wrapper three times as long gives way to the landmark
    assert said_kinds(f"<body><div><p>{LONG}</p><ul><li>An item beside it</ul></div></body>") == [("text", LONG), ("list", "An item beside it")]
    page = f"<body><div><div>{'filler words here ' * 200}</div><main><p>{LONG}</p><p>{LONG}</p></main><div><p>{LONG}</p></div></div></body>"
    assert said_kinds(page) == [("text", LONG)] * 2


def test_headings_before_the_root():
    inner = f"<div><p>{LONG}</p><p>{LONG}</p></div>"
    long = f"<div>{f'<p>{LONG}</p>' * 40}</div>"
    got = said_kinds(f"<head><title>The real name</title></head><body><div><div><h1>Some site</h1></div><div><h1>The real name</h1></div><h2>Its deck</h2>{long}</div></body>")
    assert got[:2] == [("heading", "The real name"), ("heading", "Its deck")]
    # the page is short: the root widens to what holds the title and its lede
    got = said_kinds(f"<body><div><section><h1>The name</h1><p>Lede in a section of its own.</p></section>{inner}</div></body>")
    assert got[:2] == [("heading", "The name"), ("text", "Lede in a section of its own.")]
    assert said_kinds(f"<article><p>{LONG}</p><div>March 12, 2026 — Words of the loose run.<p>{LONG}</p></div></article>")[1] == ("text", "Words of the loose run.")


def test_chunking_stays_under_its_ceiling():
    from textloom.functions.chunk import chunk

    prose = " ".join(f"Sentence {i} of the article says, as Mr. Smith did, that 3.5 km is far; it goes on because it must." for i in range(250))
    chunk(prose), chunk(prose)
    best = min(_timed(lambda: chunk(prose)) for _ in range(5))
    assert len(prose.split()) >= 5000 and best < 0.02


def _timed(f):
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def test_upsert_keeps_the_last_whole_version(spark, tmp_path):
    from textloom.streaming.sessions import latest_version, read_latest, upsert_latest

    path = str(tmp_path / "prefs")
    frame = lambda rows: spark.createDataFrame(rows, "user long, at long, speed double")
    assert latest_version(spark, path) is None
    upsert_latest(frame([(1, 1, 1.0), (2, 5, 1.5)]), path, "user", "at")
    upsert_latest(frame([(1, 3, 2.0), (2, 4, 0.75), (3, 1, 1.25)]), path, "user", "at")
    want = [(1, 3, 2.0), (2, 5, 1.5), (3, 1, 1.25)]
    assert sorted(map(tuple, read_latest(spark, path).collect())) == want
    # a write that never came to its end leaves a folder without its mark
    frame([(9, 9, 9.0)]).write.parquet(f"{path}/v000000000099")
    os.remove(f"{path}/v000000000099/_SUCCESS")
    assert sorted(map(tuple, read_latest(spark, path).collect())) == want
    upsert_latest(frame([(1, 3, 2.0), (2, 4, 0.75)]), path, "user", "at")
    assert sorted(map(tuple, read_latest(spark, path).collect())) == want
