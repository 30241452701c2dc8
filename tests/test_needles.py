"""Search of many needles and of roots by text, against plain walks."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textloom import registry
from textloom.operators import needles, root_text
from textloom.sources import html_tree, pages

SF = "/root/testdata/sf0.001"


def places(hay, needle):
    at = hay.find(needle)
    while at >= 0:
        yield at
        at = hay.find(needle, at + 1)


def test_occurrences_against_find(spark):
    r = random.Random(1)
    texts = [(i, "".join(r.choice("ab é😀c") for _ in range(r.choice([0, 3, 40, 300, 700])))) for i in range(40)]
    texts += [(50, None), (51, "ab" * 600), (51, "ab" * 600), (52, "x" * 255 + "needle over the border of blocks" + "y" * 300)]
    sought = [(j, "".join(r.choice("ab é😀c") for _ in range(r.choice([1, 2, 3, 4, 5])))) for j in range(30)]
    for j in range(30, 60):
        text = r.choice([t for _, t in texts if t and len(t) > 50])
        at = r.randrange(len(text) - 30)
        sought.append((j, text[at : at + r.choice([5, 18, 19, 20, 27, 300])]))
    sought += [(60, None), (61, ""), (62, "ab" * 200), (63, "needle over the border of blocks"), (63, "needle over"), (None, "ab")]
    t = spark.createDataFrame(texts, "doc_id long, text string").withColumn("at", F.lit("a clashing name"))
    n = spark.createDataFrame(sought, "needle_id long, needle string")
    found = needles.occurrences(t, n, ["doc_id"])
    want = {(i, j, at) for i, text in texts for j, needle in sought if text and needle and j is not None for at in places(text, needle)}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    first = {(i, j): at for i, j, at in map(tuple, needles.first_from(found, ["doc_id", "needle_id"], F.lit(100)).collect())}
    text = dict(texts)
    assert all(at == (text[i].find(dict(sought)[j], 100) if text[i].find(dict(sought)[j], 100) >= 0 else text[i].find(dict(sought)[j])) for (i, j), at in first.items() if j != 63)
    assert needles.occurrences(t, n.limit(0), ["doc_id"]).count() == 0 and needles.occurrences(t.limit(0), n, ["doc_id"]).count() == 0


def plain_root(html, paras):
    """The rule, by a walk over the page's elements."""
    page = pages._Texts()
    page.feed(html)
    page.close()
    page._close_to(0)
    els = page.elements
    flat = lambda t: re.sub(r"\s+", " ", t).strip()
    texts = [(n, t) for n, t in page.texts if els[n].tag not in html_tree.UNREAD]
    longest = sorted([flat(p) for p in paras if len(flat(p)) >= 80], key=len, reverse=True)[:6]
    met = []
    for p in longest:
        for share in (0.5, 0.2, 0.8):
            at = p.find(" ", int((len(p) - 50) * share)) + 1
            piece = p[at : at + 50]
            node = next((n for n, t in texts if len(flat(t)) >= 20 and len(piece) >= 40 and piece in flat(t)), None)
            if node is not None:
                met.append(node)
                break
    if not longest or len(met) < min(2, len(longest)):
        return None
    up = lambda i: els[els[i].parent]
    e = els[met[0]]
    while not all(e.node <= m <= e.end for m in met):
        e = up(e.node)
    while e.tag not in html_tree.CONTAINERS and e.tag not in ("body", "html", "#root"):
        e = up(e.node)
    if e.tag not in ("body", "html", "#root") and not any(x.tag in html_tree.WRAPPERS for x in els[e.node + 1 : e.end + 1]):
        e = up(e.node)
    size = html_tree.text_sizes(els)[e.node]
    return e.node if e.tag not in ("body", "html", "#root") and size <= 3 * sum(map(len, paras)) else None


WORDS = "the page of some name with words that are read by many people in more than one place and at any time".split()


def make_page(r):
    def prose(n):
        return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))

    paras = [prose(r.choice([5, 30, 60])) for _ in range(r.randint(1, 8))]
    shown = [p if r.random() < 0.8 else prose(30) for p in paras]  # some are missing
    if r.random() < 0.4:
        shown.append(r.choice(paras))  # some come twice
    inner = "".join(r.choice(["<span>{}</span>", "{}<br><br>", "<p>{}</p>", "<div><font>{}</font></div>"]).format(p) for p in shown)
    frame = r.choice(["<div>{}</div>", "<div><div>{}</div></div>", "<table><tr><td>{}<td>side</table>", "<span>{}</span>", "<section><svg><title>x</title></svg>{}</section>"])
    around = prose(r.choice([3, 400]))
    return f"<html><body><div>{around}<script>{inner}</script><main>{frame.format(inner)}</main></div></body></html>", paras


def test_root_by_text_against_a_walk(spark):
    r = random.Random(5)
    made = [make_page(r) for _ in range(120)]
    p = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(made)], "page_id long, html string")
    paras = spark.createDataFrame([(i, k, t) for i, (_, ps) in enumerate(made) for k, t in enumerate(ps)], "page_id long, para long, text string")
    got = dict(map(tuple, root_text.root_by_text(pages.elements(p), pages.text_rows(p), paras).collect()))
    want = {i: plain_root(*x) for i, x in enumerate(made)}
    assert got == want
    assert sum(x is None for x in want.values()) > 5 and len({x for x in want.values()}) > 3


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
def test_registered_roots(spark):
    got = dict(map(tuple, registry.queries()["root_by_text"](spark, SF).select("page_id", "root").collect()))
    want = {i: plain_root(html, [t for _, _, t in html_tree.paragraphs(html)]) for i, html in map(tuple, spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect())}
    assert got == want and any(x is not None for x in got.values())
