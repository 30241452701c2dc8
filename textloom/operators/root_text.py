"""The element of a page that holds an article, found by the article's text alone.

For pages whose paragraphs have no element of their own (texts between line breaks, rewritten blocks).  Pieces of an article's longest paragraphs
are sought in all texts of its page; the root is the innermost element whose interval covers the texts that were met.  Where a row holds the whole
page, as in the table of pages, the page is parsed once and searched as it is, without a shuffle or a table between (`roots`).  Where elements, texts
and paragraphs are tables of their own, one index of n-grams finds the pieces (`root_by_text`).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, compiled, trim
from ..sources.html_tree import BLOAT, CONTAINERS, LEAST_PARAGRAPH, UNREAD, WRAPPERS, Element, paragraphs_of
from ..sources.pages import parse_with_texts
from . import needles

LONGEST, LEAST_TEXT = 6, 20
WHOLE = frozenset(["body", "html", "#root"])
_SPACES, _EDGES = compiled(f"[{WS}]+"), compiled(f"^[{WS}]+|[{WS}]+$")


def _plain(c: str) -> Column:
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def _flat(text: str) -> str:
    return _SPACES.sub(" ", text).strip(" ")


def page_root(elements: list[Element], texts: list[tuple[int, str]], paragraphs: list[str]) -> Element | None:
    """The root of one page's article, as root_by_text finds it; texts: (node, text) in order."""
    long = sorted((p for p in map(_flat, paragraphs) if len(p) >= LEAST_PARAGRAPH), key=len, reverse=True)[:LONGEST]
    hay = [(node, t) for node, t in ((node, _flat(text)) for node, text in texts) if len(t) >= LEAST_TEXT]
    # one text: no piece holds a line break
    whole, starts = "\n".join(t for _, t in hay), [0, *accumulate(len(t) + 1 for _, t in hay)]
    places = (next((at for piece in needles.pieces(p) if (at := whole.find(piece)) >= 0), -1) for p in long)
    met = [hay[bisect_right(starts, at) - 1][0] for at in places if at >= 0]
    if not long or len(met) < min(2, len(long)):
        return None
    e, hi = elements[min(met)], max(met)
    while e.end < hi or e.tag not in CONTAINERS and e.tag not in WHOLE:
        e = elements[e.parent]
    if e.tag not in WHOLE and not any(x.tag in WRAPPERS for x in elements[e.node + 1 : e.end + 1]):
        e = elements[e.parent]
    if e.tag in WHOLE:
        return None
    size, unread = 0, -1
    own = {}
    for node, text in texts:
        own[node] = own.get(node, 0) + len(_EDGES.sub("", text))
    # an element in something unread counts for nothing, wherever that begins
    for x in elements[: e.end + 1]:
        unread = max(unread, x.end) if x.tag in UNREAD else unread
        size += own.get(x.node, 0) if x.node >= e.node and x.node > unread else 0
    return e if size <= BLOAT * sum(map(len, paragraphs)) else None


def roots(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, root, tag) of every page with paragraphs: the node of its article's root, null where the text does not tell.  A row holds its page, so nothing meets and nothing is written."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html"))
    schema = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("tag", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, out = b.slice(at, 64), []
                for i, html in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    elements, texts = parse_with_texts(html.as_py() or "")
                    said = [text for _, _, text in paragraphs_of(elements)]
                    if said:
                        e = page_root(elements, texts, said)
                        out.append((i, e and e.node, e and e.tag))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 3, schema.types, strict=True)], schema=schema)

    return rows.mapInArrow(run, "id long, root long, tag string").withColumnRenamed("id", id_col)


def wanted(paragraphs: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, para, rank, snippet): the pieces by which each of a page's six longest paragraphs is sought, the first choice first."""
    long = paragraphs.select(page, "para", _plain("text").alias("text")).filter(F.length("text") >= LEAST_PARAGRAPH)
    order = Window.partitionBy(page).orderBy(F.length("text").desc(), "para")
    top = long.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= LONGEST)
    return top.select(page, "para", F.explode_outer(needles.snippets(F.col("text"))).alias("s")).select(page, "para", "s.rank", "s.snippet")


def hits(pieces: DataFrame, texts: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, para, node): the element around the first text of the page that holds a paragraph's piece; its first piece that is met decides."""
    named = pieces.filter("snippet IS NOT NULL").withColumn("needle_id", F.struct("para", "rank"))
    hay = texts.select(page, "seq", _plain("text").alias("text")).filter(F.length("text") >= LEAST_TEXT)
    found = needles.occurrences(hay, named, [page, "seq"], needle="snippet", scope=(page,)).select(page, "seq", "needle_id.*")
    first = found.groupBy(page, "para").agg(F.min(F.struct("rank", "seq")).alias("f")).select(page, "para", F.col("f.seq").alias("seq"))
    return first.join(texts.select(page, "seq", "node").distinct(), [page, "seq"]).select(page, "para", "node")


def root_by_text(elements: DataFrame, texts: DataFrame, paragraphs: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, root): of every page with paragraphs the node of the article's root, null where the text does not tell.

    elements: (page, node, end, parent, depth, tag); texts: (page, seq, node, text); paragraphs: (page, para, text).  At least two long
    paragraphs, or the only one, must be met.  A root is a container, wraps blocks, is not the body and holds at most three times the text.
    Every page's rows meet by page only; null texts and pages without elements give null.
    """
    pieces = wanted(paragraphs, page)
    size = paragraphs.groupBy(page).agg(F.sum(F.length("text")).alias("want"))
    sought = pieces.groupBy(page).agg(F.countDistinct("para").alias("sought"))
    met = hits(pieces, texts, page).groupBy(page).agg(F.count("*").alias("met"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    known = met.join(sought, page).filter(F.col("met") >= F.least(F.lit(2), F.col("sought")))
    # figures of whole subtrees are differences of running sums in preorder
    own = texts.groupBy(page, "node").agg(F.sum(F.length(trim(F.col("text")))).alias("own"))
    body = F.col("tag").isin("body", "html", "#root")
    rows = elements.join(own, [page, "node"], "left").withColumns({"own": F.coalesce("own", F.lit(0)), "wrap": F.col("tag").isin(*sorted(WRAPPERS)).cast("long"), "at": F.when(F.col("tag").isin(*sorted(UNREAD)), F.col("end"))})
    preorder = Window.partitionBy(page).orderBy("node")
    before = preorder.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.when(F.coalesce(F.max("at").over(preorder), F.lit(-1)) >= F.col("node"), 0).otherwise(F.col("own")))
    rows = rows.withColumns({"s": F.coalesce(F.sum("own").over(before), F.lit(0)), "w": F.sum("wrap").over(preorder)})
    chain = rows.join(known, page).filter((F.col("node") <= F.col("lo")) & (F.col("end") >= F.col("hi")))
    ends = rows.select(page, F.col("node").alias("end"), (F.col("s") + F.col("own")).alias("s_end"), F.col("w").alias("w_end"))
    chain = chain.join(ends, [page, "end"]).withColumns({"size": F.col("s_end") - F.col("s"), "wraps": F.col("w_end") > F.col("w")})
    # the innermost container of the chain, or the element around it where it wraps nothing
    holds = F.col("tag").isin(*sorted(CONTAINERS)) | body
    inner = chain.groupBy(page).agg(F.max(F.when(holds, F.struct("depth", "wraps", body.alias("whole")))).alias("c"))
    target = F.when(F.col("c.wraps") | F.col("c.whole"), F.col("c.depth")).otherwise(F.col("c.depth") - 1)
    picked = chain.join(inner.select(page, target.alias("depth")), [page, "depth"]).join(size, page)
    sane = picked.filter(~body & (F.col("size") <= BLOAT * F.col("want"))).select(page, F.col("node").alias("root"))
    return size.select(page).join(sane, page, "left")
