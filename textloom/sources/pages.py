"""Web pages as DataFrames: page facts by expressions, paragraphs and elements by Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import html_tree
from .corpus import host_of


def meta(html: Column, name: str, value: str) -> Column:
    """Trimmed content of the first meta element with an attribute of that value, empty if none."""
    tag = F.regexp_extract(html, rf'(?i)<meta\s[^>]*{name}\s*=\s*["\']{value}["\'][^>]*>', 0)
    return F.trim(F.regexp_extract(tag, r'(?i)content\s*=\s*["\']([^"\']*)["\']', 1))


def site_name(html: Column, url: Column) -> Column:
    """The page's own site name, else its author unless that is a link, else its host."""
    named = lambda c: F.when(c != "", c)
    author = F.coalesce(named(meta(html, "name", "author")), named(meta(html, "property", "article:author")))
    return F.coalesce(named(meta(html, "property", "og:site_name")), F.when(~author.rlike("(?i)^https?:"), author), host_of(url))


def lead_image(html: Column) -> Column:
    """First share image that is a link of at most 2000 characters to no vector drawing."""
    candidates = F.array(meta(html, "property", "og:image:secure_url"), meta(html, "property", "og:image"), meta(html, "name", "twitter:image"), meta(html, "name", "twitter:image:src"), F.regexp_extract(html, r'(?i)<link\s[^>]*rel\s*=\s*["\']image_src["\'][^>]*href\s*=\s*["\']([^"\']*)', 1))
    good = F.filter(candidates, lambda u: u.rlike("(?i)^https?://") & (F.length(u) <= 2000) & ~u.rlike(r"(?i)^[^?#]*\.svg([?#]|$)"))
    return F.try_element_at(good, F.lit(1))


def articles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carry, paragraphs) of every page: an array of structs (node, kind, text) in order."""
    rows = pages.select(F.col(id_col).cast("long").alias(id_col), *carry, html_col)
    kept = rows.schema[:-1]
    inner = pa.list_(pa.struct([("node", pa.int64()), ("kind", pa.string()), ("text", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [[dict(zip(("node", "kind", "text"), p, strict=True)) for p in html_tree.paragraphs(html)] for html in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(found, inner)], names=[*part.schema.names[: len(kept)], "paragraphs"])

    return rows.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["paragraphs array<struct<node:bigint,kind:string,text:string>>"]))


def paragraphs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, para, node, kind, text) of every page's article; a page without any gives no row."""
    found = articles(pages, id_col, html_col).select(id_col, F.posexplode("paragraphs").alias("para", "p"))
    return found.select(id_col, F.col("para").cast("long").alias("para"), "p.*")


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, node, end, parent, depth, tag, chars) of every element; chars: text of its own, white space collapsed."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                out = [(i, e.node, e.end, e.parent, e.depth, e.tag, len(" ".join("".join(p for p in e.parts if isinstance(p, str)).split()))) for i, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for e in html_tree.parse(html or "")]
                columns = list(zip(*out, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "tag" else pa.int64()) for c, n in zip(columns, names, strict=True)], names=names)

    names = ["id", "node", "end", "parent", "depth", "tag", "chars"]
    return rows.mapInArrow(run, "id long, node long, end long, parent long, depth long, tag string, chars long").withColumnRenamed("id", id_col)


class _Texts(html_tree._Builder):
    """Elements, and texts in document order with the number of the element around each."""

    def __init__(self) -> None:
        super().__init__()
        self.texts: list[tuple[int, str]] = []

    def handle_data(self, data: str) -> None:
        super().handle_data(data)
        self.texts.append((self.open[-1], data))


def parse_with_texts(html: str) -> tuple[list[html_tree.Element], list[tuple[int, str]]]:
    """Elements of a page, and its texts in order, each with the number of the element right around it; texts of scripts and the like are left out."""
    page = _Texts()
    page.feed(html)
    page.close()
    page._close_to(0)
    return page.elements, [(node, text) for node, text in page.texts if page.elements[node].tag not in html_tree.UNREAD]


def text_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, seq, node, text) of every text of a page in order, by the element right around it; texts of scripts and the like are left out."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, out = b.slice(at, 64), []
                for i, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    page = _Texts()
                    page.feed(html or "")
                    page.close()
                    out += [(i, seq, node, text) for seq, (node, text) in enumerate(page.texts) if page.elements[node].tag not in html_tree.UNREAD]
                columns = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "text" else pa.int64()) for c, n in zip(columns, names, strict=True)], names=names)

    names = ["id", "seq", "node", "text"]
    return rows.mapInArrow(run, "id long, seq long, node long, text string").withColumnRenamed("id", id_col)


def subtree_chars(rows: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Adds total: characters of each element and all inside it, a difference of running sums in preorder, so no range join is needed."""
    from pyspark.sql import Window

    upto = F.sum("chars").over(Window.partitionBy(id_col).orderBy("node"))
    running = rows.withColumn("__c", upto)
    ends = running.select(F.col(id_col).alias("__p"), F.col("node").alias("__n"), F.col("__c").alias("__e"))
    joined = running.join(ends, (F.col(id_col) == F.col("__p")) & (F.col("end") == F.col("__n")))
    return joined.withColumn("total", F.col("__e") - F.col("__c") + F.col("chars")).drop("__p", "__n", "__e", "__c")
