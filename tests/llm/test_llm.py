"""The ten operators against brute force, libraries and defined edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import decontaminate, html_text, langid, line_dedup, maxscore, mixing, ngram_join, quality_gam, queries, suffix_dedup, token_count
from textloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string"
CLASH = ["size", "key", "name", "pivot", "rank", "copies", "score", "removed"]


def docs_of(spark, rows, schema=DOCS):
    """The rows with further columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, schema)
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3)


ODD = [(1, None, "en", "a"), (2, "", "en", None), (3, "   \n\n ", None, "a"), (4, "word", "en", "b"), (4, "word", "en", "b"), (5, "Ünïcode ßtraße 日本 " * 400, "de", "b"), (None, "no id here at all", None, None), (6, "123 456 !!", "en", "a")]


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    pool, out = [], []
    for d in range(n):
        if pool and rng.random() < 0.5:
            lines = [list(x) for x in rng.choice(pool)]
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                line = rng.choice(lines)
                i = rng.randrange(len(line))
                line[i : i + rng.choice([0, 1])] = [rng.choice(vocabulary)] * rng.choice([0, 1])
                if not line:
                    line.append("w")
        else:
            lines = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 7, 8, 9, 23, 24, 60, 120]))] for _ in range(rng.randint(1, 4))]
        pool.append(lines)
        out.append((d, "\n".join(" ".join(x) for x in lines) if d % 23 else None))
    return out


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 37), None, ["a", "b", "c", None][i % 4] if i % 3 else "a") for i in range(400)]
    got = mixing.mix(docs_of(spark, rows)).toPandas()
    assert len(got) == 400 and (got.taken <= 3 * got["size"]).all()
    by = got.groupby(got.source.fillna("~")).agg(target=("target", "max"), taken=("taken", "sum"))
    assert abs(by.target.sum() - got["size"].sum()) < 1e-6 and (abs(by.taken - by.target) <= 20).all()
    again = mixing.mix(docs_of(spark, rows).repartition(7)).toPandas()
    assert got.set_index("doc_id").taken.sort_index().equals(again.set_index("doc_id").taken.sort_index())


def test_mixing_weights_and_odd_rows(spark):
    heavy = spark.createDataFrame([(i, "w " * 10, "a" if i < 200 else "b", 4.0 if i % 2 else 1.0) for i in range(400)], "doc_id long, text string, source string, quality double")
    got = mixing.mix(heavy, weights=(1, 3), weight_col="quality").filter("source = 'a'").join(heavy.select("doc_id", "quality"), "doc_id").groupBy("quality").agg(F.sum("copies").alias("n")).toPandas().set_index("quality").n
    assert got[4.0] > 2 * got[1.0]
    assert mixing.mix(docs_of(spark, ODD)).count() == len(ODD)
    assert mixing.mix(docs_of(spark, [], DOCS)).count() == 0


def test_mixing_ties_and_repeated_rows(spark):
    rows = [(i // 3, "w " * 5, "", "a") for i in range(300)] + [(7, "w " * 5, "", "a")] * 50 + [(i, "w " * 9, "", None) for i in range(900, 960)]
    df = docs_of(spark, rows)
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows) and (got.groupby("doc_id").taken.nunique() == 1).all()
    by = got.groupby(got.source.fillna("~")).agg(target=("target", "max"), taken=("taken", "sum"), size=("size", "sum"))
    assert (by.taken <= 3 * by["size"]).all() and abs(by.target.sum() - got["size"].sum()) < 1e-6
    one = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", "a")], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in one] == [(0, 0.0, 0)] * 2


def test_decontamination(spark):
    item = " ".join(f"b{i}" for i in range(20))
    rows = [(1, f"x y {item.upper()}, z", "", ""), (2, " ".join(item.split()[:12]), "", ""), (3, f"{' '.join(f'f{i}' for i in range(500))} {' '.join(item.split()[3:16])}", "", ""), (7, "say short one now", "", ""), *ODD]
    items = spark.createDataFrame([(1, item), (10, item), (2, "short one"), (3, None), (4, "!!")], "item_id long, text string")
    found = decontaminate.decontaminate(docs_of(spark, rows), items)
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in found.filter("doc_id in (2, 3, 7)").collect() if r.n_words > 0}
    assert got[2] == (12, 0, []) and got[3] == (513, 13, ["1", "10"]) and got[7] == (4, 2, ["2"])
    assert found.count() == len(rows)
    assert decontaminate.decontaminate(docs_of(spark, rows), items.limit(0)).filter(F.size("items") > 0).count() == 0
    assert decontaminate.decontaminate(docs_of(spark, [], DOCS), items).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 7, 50, 301):
        for k in (1, 2, 90):
            t = rng.integers(1, k + 1, n)
            assert suffix_dedup.suffix_array(t).tolist() == sorted(range(n), key=lambda i: tuple(t[i:].tolist()))


@pytest.mark.parametrize("large", [2048, 2])
def test_suffix_dedup(spark, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    rng, pool, rows = random.Random(large), [], []
    for d in range(90):
        text = "".join(rng.choice(["ab", "é", "xyz ", "q" * rng.randint(1, 4), "Ω"]) for _ in range(rng.randint(1, 120)))
        if pool and rng.random() < 0.6:
            x = rng.choice(pool)
            text += x[rng.randrange(len(x)) :][:200]
        if pool and rng.random() < 0.1:
            text = rng.choice(pool)
        pool.append(text)
        rows.append((d, text if d % 19 else None))
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in suffix_dedup.find_repeats(docs_of(spark, [(*r, "", "") for r in rows]), 60, 30).collect()}
    assert got == suffix_dedup.brute(dict(rows), 60)


def test_suffix_dedup_odd(spark):
    assert suffix_dedup.find_repeats(docs_of(spark, ODD)).count() == len(ODD)
    assert suffix_dedup.find_repeats(docs_of(spark, [], DOCS)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=16) / 4]) for i in range(400)] + [(20, [0.1] * 16), (401, None), (402, [float("nan")] * 16), (403, [None] * 16), (None, [0.1] * 16), (404, [0.2] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    got = maxscore.top_k(df, F.col("vec_id") % 20 == 0, k=5).toPandas()
    sound = [(i, np.floor(64 * np.pad(np.array(v, np.float32).astype(float), (0, 16 - len(v))))) for i, v in vectors if i is not None and v is not None and None not in v and not np.isnan(v).any()]
    want = []
    for a, (q, x) in enumerate(sound):
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for b, (i, y) in enumerate(sound) if b != a)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(want)
    assert maxscore.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rows = corpus(seed)
    decisions = line_dedup.decide(docs_of(spark, [(*r, "", "") for r in rows]))
    assert {r.doc_id: r.removed for r in decisions.collect()} == line_dedup.brute(rows)


@pytest.mark.parametrize(("bits", "whole"), [((3, 64), True), ((3, 2), False)])
def test_line_dedup_verifies_pairs(spark, bits, whole):
    """Variants whose hashes are forced to collide never remove a line that has no near line before it."""
    rows = corpus(5, 60)
    want = line_dedup.brute(rows)
    got = {r.doc_id: r.removed for r in line_dedup.decide(docs_of(spark, [(*r, "", "") for r in rows]), bits=bits).collect()}
    assert got == want if whole else all(set(got[d]) <= set(want[d]) for d in want)


def test_line_dedup_is_one_rule_for_every_length(spark):
    rows = [(1, "a b c d\na b c d e\nx y z\nx y w\none\ntwo"), (2, "a b c q e\nx y z\np q r s\np q r t\nONE"), (3, "a b c d e f\na b c d e f\np q r s u")]
    got = {r.doc_id: r.removed for r in line_dedup.decide(docs_of(spark, [(*r, "", "") for r in rows])).collect()}
    assert got == line_dedup.brute(rows) == {1: [1], 2: [0, 1, 4], 3: [0, 1, 2]}


def test_line_dedup_apply(spark):
    df = docs_of(spark, [(1, "a b\nsame line here\n", "", ""), (2, "same line here\nown", "", ""), *ODD])
    out = line_dedup.apply(df, line_dedup.decide(df))
    texts = {r.doc_id: r.text for r in out.filter("doc_id <= 2 and length(text) >= 3").collect()}
    assert texts == {1: "a b\nsame line here\n", 2: "own"} and out.columns == df.columns and out.count() == df.count()
    assert line_dedup.apply(df.limit(0), line_dedup.decide(df.limit(0))).count() == 0


def test_html():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Name &amp; more</h1><p>First   block of&nbsp;the text<br>goes on.<p>Next <b>one<div id="comments"><p>Nice post!</p></div><p title="a>b">Last &lt;p&gt;</article><aside>Side</aside><form>Sign up</form><footer>&copy;</footer></body></html>"""
    assert html_text.main_text(page) == "Name & more\nFirst block of the text goes on.\nNext one\nLast <p>"
    assert html_text.main_text(None) == "" and html_text.main_text("") == "" and html_text.main_text("just text") == "just text"
    plain = "<div><a href=x>Menu one</a> <a href=y>Menu two</a></div>" + "<p>" + "This is the text of a page that has no article, and it is long enough to be one. " * 4 + "</p><p>Short end.</p>"
    assert html_text.main_text(plain).endswith("\nShort end.") and "Menu" not in html_text.main_text(plain)
    assert html_text.main_text("<p title='it's>x</p>" * 50).count("x") == 50


PROSE = "This is the text of the page and it has all that a reader would want to know about it. "


def test_html_marks_are_a_prior():
    card = "<article><h3>Other news</h3><p>A teaser of few words.</p></article>"
    body = "".join(f"<p>{x} {PROSE * 4}</p><p>Short {x}.</p>" for x in ("one", "two", "three"))
    got = html_text.main_text(f"<body><div>{body}</div>{card}{card}</body>")
    assert all(f"{x} This" in got and f"Short {x}." in got for x in ("one", "two", "three"))
    spread = "".join(f"<article><h2>Part {x}</h2><p>{PROSE * k}</p><p>End {x}.</p></article>" for x, k in (("a", 5), ("b", 6), ("c", 4)))
    got = html_text.main_text(spread)
    assert all(f"Part {x}" in got and f"End {x}." in got for x in "abc")
    # the prior holds, but a long run of prose before the article is decided by its words
    got = html_text.main_text(f"<div><p>Lede {PROSE * 4}</p><p>Aside.</p></div><article>{body}</article>")
    assert "Lede" in got and "Aside" not in got
    # inside the article a short block between link lists goes, and a heading of nothing but links
    links = "<p><a href=x>One more page</a> <a href=y>And another page</a></p>"
    got = html_text.main_text(f"<article><h1>Name</h1>{links}{body}{links}<p>More of these</p>{links}<h2>Links</h2>{links}</article>")
    assert got.startswith("Name\none This") and "More of these" not in got and "Links" not in got and got.endswith("Short three.")
    # words of no known language: the mark decides
    assert html_text.main_text("<p>We use it for the good of all who come to this page, as you can see.</p><article><p>" + "kissa koira talo vene " * 20 + "</p></article>").startswith("kissa")


@pytest.mark.parametrize("names", ['class="content-with-sidebar"', 'class="no-sidebar"', 'class="content-sidebar-wrap"', 'class="social-science post"', 'id="has-comments"', 'class="page-sidebar-left"'])
def test_html_names_of_content(names):
    body = f"<h1>Name</h1><p>{PROSE * 4}</p><p>Short end.</p>"
    inner = '<div class="sidebar"><p>Side words.</p></div><div class="post-comments"><p>Nice post!</p></div>'
    for page in (f"<div {names}><article>{body}</article>{inner}</div>", f"<div {names}>{body}{inner}</div>"):
        got = html_text.main_text(page)
        assert got.startswith("Name\nThis is") and got.endswith("Short end.")


def test_html_names_of_furniture():
    body = f"<p>{PROSE * 4}</p>"
    for names in ("main-nav", "entry-footer", "post-share", "sidebar-2", "relatedPosts", "post-comments", "comment-content", "ad-container"):
        assert html_text.main_text(f'<article>{body}<div class="{names}"><p>Other words.</p></div></article>') == " ".join([PROSE.strip()] * 4)
    # comments longer than the article stay out; a page of nothing but comments is read
    assert html_text.main_text(f'<p>{PROSE * 3}</p><div id="comments"><p>{"I think that it is so. " * 40}</p></div>').count("think") == 0
    assert html_text.main_text(f'<div id="comments"><p>{"I think that it is so. " * 40}</p></div>').count("think") == 40
    assert html_text.main_text(f'<div class="sidebar" hidden>{body}</div>') == ""


def test_html_wrappers_headers_and_scripts():
    body = f"<p>{PROSE * 4}</p>"
    assert html_text.main_text(f'<div class="layout has-sidebar"><article><h1>Name</h1>{body}</article></div>').startswith("Name\nThis")
    assert html_text.main_text(f'<article><div class="article-header"><h1>Name</h1></div>{body}<div class="post-footer"><p>Filed under this.</p></div></article>') == "Name\n" + " ".join([PROSE.strip()] * 4)
    words = "これは日本語の段落であり、この記事の本文を構成する文章です。読者が知りたいことをすべて含んでいますので、最後まで読んでください。"
    got = html_text.main_text(f"<body><nav><a href=/>家</a></nav>{f'<p>{words}</p>' * 4}</body>")
    assert got == "\n".join([words] * 4)


def test_html_time_is_linear():
    import time

    for page in ("<article><p>" + "<b>word here " * 100_000 + "</article>", "<div>" * 100_000 + PROSE * 5 + "</div>" * 100_000, ("<p>" + PROSE + "<br>") * 20_000, '<p title="' * 20_000, "<p title='it's>x</p>" * 20_000, "<" * 50_000, "<b>x</i>" * 30_000, "<i><div>" + "<b>" * 20_000 + "<h2>x" * 5_000, "<a>x" * 20_000, "1 < 2 " * 50_000 + "<p>x"):
        began = time.perf_counter()
        html_text.main_text(page)
        assert time.perf_counter() - began < 10


def test_html_passes_decide_without_a_mark():
    """Blocks of a page without marks are labelled by the two passes: links, length, stop words, then neighbours."""
    prose, links = f"<p>{PROSE * 4}</p>", "<div><a href=x>One menu entry</a> <a href=y>Another entry</a></div>"
    found = html_text.blocks(f"{links}<p>By someone</p>{links}{prose}<p>Short in the text.</p>{prose}<p>Read on</p>{links}{links}")
    first = [html_text._decide(b, False) for b in found]
    assert first == [False, None, False, True, None, True, None, False, False]
    assert html_text.classify(found) == [False, False, False, True, True, True, True, False, False]


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()) == [(1, "a", 1), (1, "a", 1), (2, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [256, 8])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus(block, 150)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs_of(spark, [(*r, "", "") for r in rows])).collect()}
    assert got == ngram_join.brute(rows)


def test_ngram_join_by_hot_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_LEVEL", 1)
    words = [f"w{i}" for i in range(40)]
    rows = corpus(3, 60) + [(1000 + i, " ".join(words[: 30 + i % 10])) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs_of(spark, [(*r, "", "") for r in rows])).collect()}
    assert got == ngram_join.brute(rows)


def test_ngram_links_grow_with_the_group(spark, monkeypatch):
    """However many pairs of a group are similar, a task gives at most one link a set."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    made: list[int] = []
    write = ngram_join.materialize

    def counted(df, name):
        out = write(df, name)
        if name in ("walked", "crossed"):
            made.append(out.filter("b IS NOT NULL").count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    links = {}
    for n in (500, 1000, 2000):
        rng, base = random.Random(n), [f"b{i}" for i in range(60)]
        rows = []
        for d in range(n):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            rows.append((d, " ".join(w), "", ""))
        made.clear()
        ngram_join.near_duplicates(docs_of(spark, rows)).count()
        links[n] = sum(made)
    assert all(links[n] <= 2 * n for n in links) and links[2000] <= 5 * links[500]


def test_marks(spark):
    from textloom.llm.marks import LARGEST, LEAST, Marks, bits_for

    assert bits_for(0) == LEAST and bits_for(10**12) == LARGEST and bits_for(10**6) > LEAST
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 500)
    marks = Marks.of(spark.createDataFrame([(int(x),) for x in h[:250]], "h long"), "h")
    assert marks.marked(h[:250].view(np.uint64)).all() and marks.marked(h[250:].view(np.uint64)).sum() < 10


def test_ngram_join_odd(spark):
    got = ngram_join.near_duplicates(docs_of(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.component_id == r.doc_id for r in got) and sum(r.n_shingles == 0 for r in got) == 3
    assert ngram_join.near_duplicates(docs_of(spark, [], DOCS)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[200] == got[150] == 100


def test_language_id(spark):
    say = {"en": "the of and to in is that it was for ", "fr": "le la les des et est que dans pour une ", "de": "der die das und ist nicht mit für auf ein "}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(say[k].split()) for _ in range(40)).upper() if i % 2 else " ".join(rng.choice(say[k].split()) for _ in range(40)), k, "s") for i, k in enumerate(["en", "fr", "de"] * 60)]
    df = docs_of(spark, rows + ODD)
    model = langid.fit(df, F.coalesce(F.col("doc_id"), F.lit(0)) % 3 < 3)
    out = langid.predict(df.drop("score"), model, carry=("doc_id", "lang", "text")).toPandas()
    known = out[out.text.fillna("").str.len().between(60, 400)]
    assert (known.lang == known.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()
    assert set(out[out.text.isna() | out.text.isin(["", "123 456 !!"])].lang_pred) == {"und"}
    empty = langid.fit(df.limit(0), F.lit(True))
    assert set(r.lang_pred for r in langid.predict(df, empty).collect()) == {"und"}
    assert langid.codewords(7).shape[0] == 7 and len({tuple(r) for r in langid.codewords(7)}) == 7


def test_token_counts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", "a", "aaaaaaa aaa  aa\n\n x", "hi<|endoftext|>you", "don't 1234  \t", "日本 😀é" * 50, "ab" * 3000, None, "\x85 　y", "<|endoftext|>"]
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_count.token_counts(docs_of(spark, [(i, t, "", "") for i, t in enumerate(texts)]), path).collect()}
    lib = tokenizers.Tokenizer.from_file(path)
    assert got == {i: (len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    assert token_count.token_counts(docs_of(spark, [], DOCS), path).count() == 0


def test_quality(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["reading", "words", "make", "sense", "and", "flow."]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "***"]) for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), "", "") for i in range(300)]
    df, labels = docs_of(spark, rows + ODD), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(4, None)], "doc_id long, quality int")
    model = quality_gam.fit(df, labels, F.col("doc_id") % 5 != 0)
    out = quality_gam.score(df.drop("score"), model).filter("doc_id >= 10").toPandas()
    held = out[out.doc_id % 5 == 0]
    assert ((held.score >= 0.3) == (held.doc_id % 3 > 0)).mean() > 0.95 and out.score.between(0, 1).all()
    none = quality_gam.fit(df, labels.limit(0), F.lit(True))
    assert {r.score for r in quality_gam.score(df.drop("score"), none).collect()} == {0.5}


def test_language_decoding_against_a_plain_loop(spark):
    """Margins and decoding of single texts, trigram by trigram, from the model's tables."""
    say = {"en": "the of and to in is that it was for", "fr": "le la les des et est que dans pour une", "de": "der die das und ist nicht mit auf ein sich", "it": "il lo gli che di non per una con sono"}
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(say[k].split()) for _ in range(rng.choice([1, 5, 40]))).title(), k, "s") for i, k in enumerate(list(say) * 30)] + [(500, "ÀÉ x" * 300, None, None), (501, "a", None, None)]
    df = docs_of(spark, rows)
    model = langid.fit(df, F.lit(True), per_language=20)
    again = langid.fit(df.repartition(5), F.lit(True), per_language=20)
    assert (model.weights == again.weights).all() and (model.bias == again.bias).all()
    mask = (1 << 32) - 1
    for r in langid.predict(df.drop("score"), model, carry=("doc_id", "text")).collect():
        data = [b + 32 if 65 <= b <= 90 else b for b in r.text.encode()]
        for i in range(1, len(data)):
            if data[i - 1] == 0xC3 and 0x80 <= data[i] <= 0x9E and data[i] != 0x97:
                data[i] += 0x20
        data = [b if b >= 0x80 or 97 <= b <= 122 else 32 for b in data]
        margins, n = [0.0] * len(model.bias), 0
        for a, b, c in zip(data, data[1:], data[2:]):
            if (a, b, c) != (32, 32, 32):
                h = (a * 0x9E3779B1 & mask) ^ (b * 0x85EBCA77 & mask) ^ (c * 0xC2B2AE3D & mask)
                h = (h ^ h >> 15) * 0x2C1B3C6D & mask
                n += 1
                for bit in range(len(margins)):
                    margins[bit] += model.weights[bit][h >> 20]
        margins = [m / max(n, 1) + float(b) for m, b in zip(margins, model.bias)]
        loss = [sum(float(np.logaddexp(0, -m * code)) for m, code in zip(margins, word)) for word in model.code]
        ordered = sorted(loss)
        assert r.lang_pred == model.languages[loss.index(ordered[0])] and r.n_grams == n and r.ambiguous == (ordered[1] - ordered[0] < langid.AMBIGUOUS_GAP)
        assert abs(r.score - 1 / sum(np.exp(ordered[0] - x) for x in loss)) < 1e-9


def test_quality_score_against_a_plain_loop():
    """Every score as the sum of one table entry a feature and one a pair, looked up by hand."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    model = quality_gam.train(x, (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float), rounds=10, pair_rounds=5)
    for row, got in zip(x[:60], model.score(x[:60])):
        bins = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges)]
        logit = model.bias + sum(t[b] for t, b in zip(model.tables, bins))
        for (f, g), table in zip(model.pairs, model.grids):
            logit += table[bins[f] * quality_gam.GRID // len(model.tables[f])][bins[g] * quality_gam.GRID // len(model.tables[g])]
        assert abs(got - 1 / (1 + np.exp(-logit))) < 1e-12


def test_quality_features_against_a_plain_loop():
    from textloom.llm import ragged
    import pyarrow as pa

    for text in ["", "One two two.\nOne two two.\n\nTHREE, 4! a|b http://x", "ééé äö 12 3", "x" * 50]:
        data, w = text.encode(), [x for x in text.replace("\n", " ").split(" ") if x]
        lines = [x for x in text.split("\n") if x]
        got = dict(zip(quality_gam.FEATURES, quality_gam.features(*ragged.flat(pa.array([text])))[0]))
        n, size = max(len(w), 1), max(len(data), 1)
        want = {"log_bytes": np.log1p(len(data)), "log_words": np.log1p(len(w)), "word_bytes": sum(len(x.encode()) for x in w) / n, "digit": sum(48 <= b <= 57 for b in data) / size, "comma": data.count(b",") / size, "line_words": len(w) / max(len(lines), 1), "distinct_words": len(set(w)) / n, "top_word": max([w.count(x) for x in w], default=0) / n, "distinct_lines": len(set(lines)) / max(len(lines), 1), "short_words": sum(len(x.encode()) <= 3 for x in w) / n, "upper_words": sum(2 * sum(65 <= b <= 90 for b in x.encode()) > len(x.encode()) for x in w) / n}
        assert all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_every_query_is_registered():
    import re

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    say = ["the of and to in is that it was for", "le la les des et est que dans pour une"]
    rows = [(i, " ".join(say[i % 2].split()[j % 10] + f"{(i * 7 + j) % 50}" * (j % 3 > 0) for j in range(40)), ["en", "fr"][i % 2], f"s{i % 3}", 5) for i in range(60)] + [(70, None, None, None, 0), (71, "", "en", "s0", 0), (72, "77 88", "en", "s0", 5)]
    docs = spark.createDataFrame(rows, DOCS + ", n_chars long").withColumn("extra", F.lit(1))
    spark.createDataFrame([(1, " ".join(rows[3][1].split()[:20]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = docs
    for name, stage in pipeline.STAGES:
        after = stage(spark, table, str(tmp_path))
        after.write.parquet(str(tmp_path / name))
        if name != pipeline.STAGES[-1][0]:
            assert after.columns == table.columns
        table = spark.read.parquet(str(tmp_path / name))
    ids = [r.doc_id for r in table.collect()]
    assert len(ids) == len(set(ids)) and not {70, 71, 72} & set(ids) and 3 not in ids and {"copies", "taken"} <= set(table.columns)


def test_pipeline_against_sql_and_plain_versions(spark, tmp_path):
    """All rows of run() against the stages' SQL and brute-force twins, one after the other."""
    pipeline = pytest.importorskip("corpus_pipeline")
    duckdb = pytest.importorskip("duckdb")
    say = {"en": "the of and to in is that it was for on with as by at from this have", "fr": "le la les des et est que dans pour une sur avec par au du ce qui pas"}
    rng = random.Random(9)
    prose = lambda k, n: " ".join(rng.choice(say[k].split()) + str(rng.randrange(40)) * (rng.random() < 0.7) for _ in range(n))
    rows, item = [], " ".join(f"bench{i}" for i in range(30))
    for d in range(90):
        k = "en" if d % 2 else "fr"
        lines = [prose(k, rng.choice([3, 6, 30])) for _ in range(4)]
        if rows and rng.random() < 0.3:
            lines = rows[rng.randrange(len(rows))][1].split("\n")
            lines[rng.randrange(len(lines))] += " more"
        elif rows and rng.random() < 0.4:
            lines[1] = rows[rng.randrange(len(rows))][1].split("\n")[0]
        if d % 17 == 5:
            lines.append(item[: rng.choice([70, 400])])
        rows.append((d, "\n".join(lines), k, f"s{d % 4}" if d % 9 else None, 1))
    rows += [(200, None, None, None, 0), (201, "12 34", "en", "s0", 5), (202, rows[0][1], "fr", "s1", 1)]
    spark.createDataFrame(rows, DOCS + ", n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: (r.text, r.n_chars, r.size, r.taken) for r in pipeline.run(spark, str(tmp_path)).collect()}

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    judged = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs, pipeline.remainder(F.col("doc_id"), 3) != 1), carry=("doc_id",)).collect()}
    left = {r[0]: (r[1], r[3]) for r in rows if not (judged[r[0]].lang_pred == "und" or judged[r[0]].ambiguous)}
    assert set(left) == set(range(90)) | {202}
    gone = line_dedup.brute([(d, t) for d, (t, _) in left.items()])
    left = {d: ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]), s) for d, (t, s) in left.items()}
    groups = ngram_join.brute([(d, t) for d, (t, _) in left.items()])
    left = {d: v for d, v in left.items() if groups[d] == (0, d) or groups[d][1] == d}
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.execute("CREATE TABLE benchmark AS SELECT 1 AS item_id, ? AS text", [item])
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", [[d, *v] for d, v in left.items()])
    bad = {r[0] for r in db.execute(f"SELECT doc_id FROM ({decontaminate.SQL}) WHERE contaminated").fetchall()}
    assert bad
    db.execute(f"DELETE FROM documents WHERE doc_id IN ({', '.join(map(str, bad))})")
    mixed = {r[0]: r[1:] for r in db.execute(f"SELECT doc_id, size, taken FROM ({mixing.SQL})").fetchall()}
    assert got == {d: (t, len(t), *mixed[d]) for d, (t, _) in left.items() if d not in bad}


def test_pipeline_on_empty_and_repeated_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    words = " ".join(["the of and to in is that it was for"] * 3)
    twice = [(1, words + f" x{i}", "en", "a", 1) for i in (1, 1, 2)] + [(2, words + " x1", "en", "a", 1)] * 3 + [(3, "und dies ist nicht gleich", "de", None, 1)]
    for name, rows in (("none", []), ("twice", twice)):
        folder = tmp_path / name
        spark.createDataFrame(rows, DOCS + ", n_chars long").write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        got = pipeline.run(spark, str(folder)).collect()
        assert sorted(r.doc_id for r in got) == ([] if name == "none" else [1, 3]) or name == "twice" and {r.doc_id for r in got} >= {1, 3}
