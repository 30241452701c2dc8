"""Text predicates and clean-up as Column expressions; they stay inside whole-stage code."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normalize import SIGNS, normalize_text, unruled

# Character classes and patterns that the results depend on.
#: Every kind of white space, for use inside a character class of Java and RE2 patterns.
WS = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?"
DATE = rf"\b{MONTH}[{WS}]+\d{{1,2}}(?:st|nd|rd|th)?(?:,?[{WS}]+\d{{4}})?\b|\b\d{{1,2}}[{WS}]+{MONTH}(?:,?[{WS}]+\d{{4}})?\b|\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b\d{{1,2}}[/.]\d{{1,2}}[/.]\d{{2,4}}\b"
META = r"\bmin(?:ute)?s?\.? read\b|scroll to continue|^(?:advertisement|advert|ad\b|sponsored|promoted|sign up|subscribe|follow\b|share\b|©|\(c\)|copyright|published|updated|last updated|posted|continue reading|read more|related)"
PROMO_LABEL = (
    r"^(recommended( reading| for you)?|related( (articles|stories|posts|reading|content))?|read (more|next|also)|more (from|on|stories|to read)\b.*|you (may|might) (also )?like|popular( now)?|trending( now)?|most (read|popular)|keep reading|up next)"
    rf"[{WS}]*:?$"
)
PROMO_INLINE = rf"^(read( more| next| also)?|related|see also|also read|watch)[{WS}]*:[{WS}]+[^{WS}]"
JUNK_WORD = (
    r"^(share|shares|sharing|social|subscribe|newsletter|related|recommend|recommended|recommendations?|promo|promoted|promotion|ad|ads|advert|advertisement|advertising|sponsor|sponsors|sponsored|cookie|cookies|comments?"
    r"|breadcrumbs?|toolbar|reflist|references|navbox|catlinks|editsection|printfooter|sidebar|hatnote|byline)$"
)
JUNK_INSIDE = "newsletter|breadcrumb|navbox|catlinks|editsection|printfooter|reflist|hatnote"
CONTENT_NAME = "content|article|body|main|post|entry|story"
INVISIBLE = r"[\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}]"
CITATION = r"(?i)\[(?:\d{1,3}|[a-z]|citation needed|edit|note \d+)\]"
URL = rf"(?i)\b(?:https?://|www\.)[^{WS})]+"
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
#: (pattern, replacement) before normalization.
BEFORE = [(INVISIBLE, ""), (CITATION, ""), (URL, "link"), (EMAIL, "email address")]
ENDED = "[.!?…:;,\"')\\]]$"
#: (pattern, replacement) after normalization.
PUNCTUATION = [
    ("[“”«»]", '"'), ("[‘’]", "'"), (f"[{WS}]*[—–][{WS}]*", ", "), (rf"[{WS}]*\.{{3,}}[{WS}]*", "… "), ("&", " and "), (f"[{WS}]*/[{WS}]*", " "), (r"[*_#`~^|<>{}\\]", " "), (f"[{WS}]+", " "),
]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, f"[{WS}]+", " ")


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def speakable(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{N}]")


def sentence_like(c: Column) -> Column:
    return c.rlike("[.!?…][\"”')\\]]*$") & (F.size(F.split(c, f"[{WS}]+", -1)) >= 6)


def looks_like_meta(c: Column) -> Column:
    return (F.length(c) < 60) & ~sentence_like(c) & (c.rlike(f"(?i){META}") | c.rlike(f"(?i){DATE}"))


def strip_leading_date(c: Column) -> Column:
    lead = F.regexp_extract(c, rf"(?i)^(?:{DATE}|{MONTH}[{WS}]+\d{{4}})[{WS}·—–|-]*", 0)
    rest = F.substr(c, F.length(lead) + 1)
    return F.when((F.length(lead).between(1, 30)) & rest.rlike('^[A-Z“"]'), rest).otherwise(c)


def kind_of(tag: Column, role: Column | None = None) -> Column:
    t = F.upper(tag)
    heading = t.rlike("^H[1-6]$") if role is None else t.rlike("^H[1-6]$") | F.coalesce(role == "heading", F.lit(False))
    return F.when(heading, "heading").when(t == "BLOCKQUOTE", "quote").when(t.isin("LI", "DD", "DT"), "list").otherwise("text")


def min_length(kind: Column) -> Column:
    return F.when(kind == "heading", 2).when(kind == "list", 6).otherwise(12)


def heading_level(tag: Column, aria_level: Column) -> Column:
    return F.coalesce(F.expr("try_cast(null as int)"), F.when(F.upper(tag).rlike("^H[1-6]$"), F.substr(tag, F.lit(2), F.lit(1)).cast("int")), F.try_to_number(aria_level, F.lit("99")).cast("int"), F.lit(2))


def junk_name(names: Column) -> Column:
    """Whether a class or id attribute names page furniture."""
    tokens = F.filter(F.split(names, f"[{WS}]+", -1), lambda t: t != "")
    plain = F.transform(tokens, lambda t: F.lower(F.regexp_replace(t, "([a-z])([A-Z])", "$1-$2")))

    def junk(t: Column) -> Column:
        parts = F.split(t, "[-_:.]+", -1)
        comments = F.exists(parts, lambda w: w.rlike("^comments?$"))
        return t.rlike(JUNK_INSIDE) | (~(t.rlike(CONTENT_NAME) & ~comments) & F.exists(parts, lambda w: w.rlike(JUNK_WORD)))

    return F.exists(plain, junk)


def matches_title(a: Column, b: Column) -> Column:
    """Whether two names share nearly all words of the shorter; repeated words of the first count each."""
    def same(p: Column) -> Column:
        x, y = p["x"], p["y"]
        common = F.size(F.filter(x, lambda w: F.array_contains(y, w)))
        return (F.size(x) > 0) & (F.size(y) > 0) & (common >= F.least(F.size(x), F.size(y)) * F.lit(0.8).cast("double")) & ((common >= 2) | (F.size(x) == F.size(y)))

    return let(F.struct(words(a).alias("x"), words(b).alias("y")), same)


def before_rules(c: Column) -> Column:
    """Invisible characters, citation marks, links and addresses."""
    return reduce(lambda t, s: F.regexp_replace(t, *s), BEFORE, c)


def after_rules(c: Column) -> Column:
    """Quotes, dashes, dots, slashes, markup and white space; a full stop where no mark ends the text."""
    t = trim(reduce(lambda t, s: F.regexp_replace(t, *s), PUNCTUATION, c))
    return F.when((t != "") & ~t.rlike(ENDED), F.concat(t, F.lit("."))).otherwise(t)


def compiled(source: str) -> regex.Pattern:
    """A pattern of this module, written for Spark, for use in Python: the same classes, ASCII words and digits."""
    return regex.compile(regex.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), source), regex.ASCII | regex.V0)


_PICTURES = regex.compile(r"[\p{Extended_Pictographic}\u200d\ufe0f]")
_BEFORE, _AFTER = [(compiled(p), r) for p, r in BEFORE], [(compiled(p), r) for p, r in PUNCTUATION]
# What a text holds if a step finds anything; the marks of ENDED.
_UNSEEN = re.compile("[\xa9\xad\xae\u2000-\U0010ffff]")  # all pictures and invisible characters
_WANTS: list[Callable[[str], object]] = [_UNSEEN.search, lambda t: "[" in t, lambda t: "http" in (low := t.lower()) or "www." in low, lambda t: "@" in t]
_MARKS = "“”«»‘’—–&/*_#`~^|<>{}\\\\\t-\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_MARKED = re.compile(f"[{_MARKS}]")
#: Without any of these, double spaces, dots and a link to "www.", only rules of words are left.
_SPECIAL = re.compile(f"[{SIGNS}{_MARKS}\\[\xa9\xad\xae\u2000-\U0010ffff]")
_ENDS = frozenset(".!?…:;,\"')]")


def cleaned(text: str, rules: Callable[[str], str] = lambda t: t) -> str:
    """What stands before and after the rules, with the rules between."""
    for wants, (find, say) in zip(_WANTS, _BEFORE, strict=True):
        if wants(text):
            text = find.sub(say, text)
    text = rules(text)
    if "  " in text or "..." in text or _MARKED.search(text):
        for find, say in _AFTER:
            text = find.sub(say, text)
    return _ended(text)


def _ended(text: str) -> str:
    text = text.strip(" ")
    return text if not text or text[-1] in _ENDS else text + "."


def speech_text(text: str) -> str:
    """One segment of display text as a voice should read it; runs after chunking, so offsets stay those of the original."""
    if not _SPECIAL.search(text) and "  " not in text and "..." not in text and "www." not in text.lower() and unruled(text):
        return _ended(text)
    return cleaned(text, lambda t: normalize_text(_PICTURES.sub("", t) if _UNSEEN.search(t) else t))


@F.pandas_udf(T.StringType())
def punctuated(text: pd.Series) -> pd.Series:
    """The steps around the rules alone, as before_rules and after_rules have them."""
    return text.map(cleaned, na_action="ignore")


@F.pandas_udf(T.StringType())
def speech(text: pd.Series) -> pd.Series:
    return text.map(speech_text, na_action="ignore")
