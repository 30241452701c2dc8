"""The root of an article found inside its page's row: equal to the search over separate tables, and nothing written on the way."""

from __future__ import annotations

import random

from textloom import registry
from textloom.operators import needles, root_text
from textloom.sources import pages

from test_needles import make_page


def odd_pages():
    r = random.Random(11)
    made = [make_page(r)[0] for _ in range(60)]
    made += [h.replace(" of ", " of ").replace("<div>", "<div>\n\n　  ") for h in made[:20]]
    made += [h.replace("<span>", "<svg><g>").replace("</span>", "</g></svg>") for h in made[:10]]
    return [*made, None, "", "<p>Too short.</p>", "no element at all " * 20, "<body>" + "\n " * 3000 + made[0]]


def test_roots_in_rows_equal_roots_over_tables(spark):
    p = spark.createDataFrame(list(enumerate(odd_pages())), "page_id long, html string")
    got = {i: (root, tag) for i, root, tag in map(tuple, root_text.roots(p).collect())}
    elements = pages.elements(p)
    tags = {(i, n): t for i, n, t in map(tuple, elements.select("page_id", "node", "tag").collect())}
    want = {i: (root, tags.get((i, root))) for i, root in map(tuple, root_text.root_by_text(elements, pages.text_rows(p), pages.paragraphs(p)).collect())}
    assert got == want
    assert sum(root is None for root, _ in got.values()) > 3 and len({tag for _, tag in got.values()}) > 3


def test_registered_roots_write_and_shuffle_nothing(spark, tmp_path, monkeypatch):
    def refuse(*_):
        raise AssertionError("an intermediate table")

    monkeypatch.setattr(needles, "materialize", refuse)
    spark.createDataFrame(list(enumerate(odd_pages())), "page_id long, html string").repartition(8).write.parquet(str(tmp_path / "pages.parquet"))
    found = registry.queries()["root_by_text"](spark, str(tmp_path))
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 60
