"""Plain text to ordered paragraphs, and filters over paragraph sequences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PROMO_INLINE, PROMO_LABEL, WS, collapse, compiled, let, trim
from ..functions.titles import SEPARATOR, clean_title


def _parts(text: Column, separator: str, longer_than: int) -> Column:
    return F.filter(F.transform(F.split(text, separator, -1), trim), lambda p: F.length(p) > longer_than)


def _packed_sentences(text: Column, enough: int = 300) -> Column:
    """Sentences put together, in order, until a part is longer than `enough`."""
    # a part is (done, its text so far): the done parts grow only when one is full
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("now"))

    def add(acc: Column, s: Column) -> Column:
        full = F.length(acc["now"]) > enough
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), F.when(full, s).otherwise(F.concat(acc["now"], s)).alias("now"))

    # cut where a stop is followed by something else; matching whole sentences would try every start of a text without stops
    pieces = F.filter(F.split(text, "(?<=[.!?])(?=[^.!?])", -1), lambda p: p.rlike("^[^.!?]") & p.rlike("[.!?]$"))
    found = let(pieces, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(text)))
    packed = F.aggregate(found, start, add, lambda acc: F.concat(acc["done"], F.array(acc["now"])))
    return F.filter(F.transform(packed, trim), lambda p: p != "")


def paragraph_array(text: Column) -> Column:
    """Paragraphs at blank lines; with two or fewer, at line ends; with one or none and a long text, packed sentences."""
    by_line = let(_parts(text, "\n{2,}", 10), lambda blank: F.when(F.size(blank) <= 2, _parts(text, "\n", 30)).otherwise(blank))
    chosen = let(by_line, lambda parts: F.when((F.size(parts) <= 1) & (F.length(text) > 500), _packed_sentences(text)).otherwise(parts))
    return F.transform(chosen, collapse)


_SPACES, _SPACE = compiled(f"[{WS}]+"), "".join(chr(i) for i in range(0x10000) if compiled(f"[{WS}]").match(chr(i)))
_ODD = re.compile(f"[{re.escape(_SPACE.replace(' ', ''))}]|  ")
_BLANK, _SENTENCE_GAP = re.compile("\n{2,}"), re.compile("(?<=[.!?])(?=[^.!?])")


def paragraph_list(text: str | None, enough: int = 300) -> list[str]:
    """The same as paragraph_array, of one text in Python."""
    if text is None:
        return []
    parts = [p for p in (x.strip(_SPACE) for x in _BLANK.split(text)) if len(p) > 10]
    if len(parts) <= 2:
        parts = [p for p in (x.strip(_SPACE) for x in text.split("\n")) if len(p) > 30]
    if len(parts) <= 1 and len(text) > 500:
        done, now, size = [], [], 0
        for s in [s for s in _SENTENCE_GAP.split(text) if s and s[0] not in ".!?" and s[-1] in ".!?"] or [text]:
            if size > enough:
                done.append("".join(now))
                now, size = [], 0
            now.append(s)
            size += len(s)
        parts = [p for p in (x.strip(_SPACE) for x in [*done, "".join(now)]) if p]
    return [_SPACES.sub(" ", p) if _ODD.search(p) else p for p in parts]


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, para, text), para from 0; a document without paragraphs gives no row."""
    found = docs.select(F.col(id_col), F.posexplode(paragraph_array(F.col(text_col))).alias("para", "text"))
    return found.withColumn("para", F.col("para").cast("long"))


def selection(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, para, text) of a selected text: its lines of more than one character, white space collapsed."""
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n+", -1), lambda t: trim(collapse(t))), lambda t: F.length(t) > 1)
    return docs.select(*keys, F.posexplode(lines).alias("para", "text")).withColumn("para", F.col("para").cast("long"))


def drop_trailing_headings(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Without headings after the last other paragraph; the first row of a key stays."""
    w = Window.partitionBy(key)
    last = F.coalesce(F.max(F.when(F.col("kind") != "heading", F.col(order))).over(w), F.min(order).over(w))
    return rows.withColumn("__last", last).filter(F.col(order) <= F.col("__last")).drop("__last")


def drop_promos(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Without promotion labels, the short headline lines after each up to a heading, a long line or a sentence end, and inline promotions."""
    label = (F.length("text") <= 40) & F.col("text").rlike(f"(?i){PROMO_LABEL}")
    stop = (F.col("kind") == "heading") | (F.length("text") >= 100) | F.col("text").rlike('[.!?]["”’)]?$')
    inline = (F.length("text") < 140) & F.col("text").rlike(f"(?i){PROMO_INLINE}")
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last_label = F.max(F.when(label, F.col(order))).over(before)
    last_stop = F.max(F.when(stop, F.col(order))).over(upto)
    # a line follows a label if nothing that stops the run stands after the label, up to the line itself
    marked = rows.withColumn("__label", last_label).withColumn("__stop", last_stop)
    run = F.col("__label").isNotNull() & (F.col("__stop").isNull() | (F.col("__stop") <= F.col("__label")))
    return marked.filter(~(label | inline | run)).drop("__label", "__stop")


def title_first(found: Column, title: Column, heading: Column, window_title: Column) -> Column:
    """An array of structs (kind, text, ...) with the spoken title as a heading before it, unless one of its first three texts says it.

    The first may be, begin with or begin a part of the title or of the window's title; the others must be one; the article's own h1 counts anywhere.
    """
    parts = F.transform(F.filter(F.transform(F.concat(F.split(F.coalesce(title, F.lit("")), SEPARATOR, -1), F.split(F.coalesce(window_title, F.lit("")), SEPARATOR, -1)), trim), lambda p: p != ""), F.lower)
    begins = lambda t: F.exists(parts, lambda p: F.startswith(p, t) | F.startswith(t, p))
    says = lambda t, i: F.coalesce(t == F.lower(heading), F.lit(False)) | F.when(i == 0, begins(t)).otherwise(F.array_contains(parts, t))
    opening = F.transform(F.slice(found, 1, 3), lambda p, i: says(F.lower(p["text"]), i))
    spoken = clean_title(title)
    said = (F.coalesce(title, F.lit("")) == "") | F.exists(opening, lambda x: x) | (F.length(spoken) <= 2)
    return F.when(said, found).otherwise(F.concat(F.array(F.struct(F.lit("heading").alias("kind"), spoken.alias("text"))), F.transform(found, lambda p: F.struct(p["kind"].alias("kind"), p["text"].alias("text")))))
