"""Names of articles as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, trim

SEPARATOR = rf"[{WS}]+[|–—·•][{WS}]+|[{WS}]+-[{WS}]+"
#: Shapes of titles that name no article: a link, a handle, and what one social site puts in its titles.
JUNK = [rf"(?i)^(https?://|www\.)[^{WS}]*$", r"^@\w+$", r'(?s)^.+ on (X|Twitter): ".*"( / (X|Twitter))?$', rf"(?i)[{WS}]\(@\w+\)([{WS}]+(on|/)[{WS}]+(X|Twitter))?$", rf"[{WS}]/[{WS}](X|Twitter)$"]


def clean_title(title: Column) -> Column:
    """The longest part between separators, the first of equals; a null title is empty."""
    parts = F.filter(F.transform(F.split(F.coalesce(title, F.lit("")), SEPARATOR, -1), trim), lambda p: p != "")
    longest = F.aggregate(parts, F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))
    return F.when(F.size(parts) > 1, longest).otherwise(trim(F.coalesce(title, F.lit(""))))


def is_junk_title(title: Column) -> Column:
    t = trim(F.coalesce(title, F.lit("")))
    out = F.length(t) < 3
    for shape in JUNK:
        out = out | t.rlike(shape)
    return out


def choose_title(og: Column, heading: Column, parsed: Column, doc: Column) -> Column:
    """First usable candidate, else the last that is not empty, else the empty string."""
    ordered = F.filter(F.array(clean_title(og), trim(F.coalesce(heading, F.lit(""))), clean_title(parsed), clean_title(doc)), lambda t: t != "")
    usable = F.filter(ordered, lambda t: ~is_junk_title(t))
    return F.coalesce(F.try_element_at(usable, F.lit(1)), F.try_element_at(ordered, F.lit(-1)), F.lit(""))
