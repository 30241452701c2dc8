"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags.  Zones that markup names as furniture
(navigation, page header and footer, sidebars, forms, scripts, and elements whose class, id or
role says advert, notice, comment and the like) give none.  A name is judged by whole tokens: one that names content
and only mentions furniture (content-sidebar-wrap, no-sidebar) opens no zone.  A zone by name alone that holds most of the page's
text (beside text of a marked article also over LONG characters, outside it four fifths) is left to the two passes, one of
comments only if it holds all of it.  Pass one decides every
block that its link density, length and stop-word density can decide (where most of the page's prose holds hardly a
word of the list, which is of four languages, length, link density and how the block ends decide); pass
two lets the blocks left, short or middling, inherit the label of the nearest
decided neighbour, of both if they agree, else of the nearer one.

Both passes see every block.  What the page marks as its article (the largest `article` and those at least a
quarter its size, else `main`) counts only if it holds most of the text that the passes accept when
low stop-word density throws nothing out.  Then blocks inside start from the presumption of being text, and
one outside needs length and high stop-word density.  A mark that holds less changes nothing.

Defined cases: null, empty or tagless input gives the text that is there, or the empty text; character
references are decoded; any white space inside a block is one space; blocks join by one
newline; unclosed and stray tags are repaired by nesting; repeated rows each get
their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CONTENT_NAME

SHORT, LONG = 70, 200
STOP_NONE, STOP_LOW, STOP_HIGH = 0.05, 0.15, 0.25
SENTENCE_ENDS = ".!?…。！？।؟۔።"
LINKED, LINKED_SHORT = 0.5, 0.25
#: Sibling articles count beside the largest from this fraction of its text: 1 / SIBLING.
SIBLING = 4

STOP_WORDS = frozenset(
    "the of and to in is it that for was on are with as by be at this from or an not but have has had they their which you his her its he she we were been will would can if no so more when there all who what about into"
    " le la les de des du un une et en est que qui dans pour par sur pas au aux avec ce se ne plus son sa ses il elle ou mais sont nous vous"
    " der die das und ist den dem des ein eine einer einen zu von mit für auf im nicht als auch es sich er sie war bei aus nach wie oder aber an"
    " el los las y es por con para una se su al lo como más o pero sus este esta ya son no fue".split()
)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template noscript iframe svg canvas object math xmp noembed noframes".split())
OUT = frozenset("nav footer aside form button select dialog menu label fieldset head".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article aside body div dl fieldset figure footer form header html li main nav ol section table tbody td th tr ul blockquote dialog details".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Words of a class, id or role that name furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar rail header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup paywall share sharing social related recommended recommendations comment comments commentlist disqus replies respond widget toolbar pagination pager skip search complementary contentinfo dialog".split()
)
HEADS = frozenset(["header", "masthead", "banner"])
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Words after which a token says what an element is combined with, not what it is.
MODIFIERS = frozenset(["no", "has", "with", "without"])

_CONTENT = re.compile(CONTENT_NAME)
_CONTENT_TOKEN = re.compile(f"(?:{CONTENT_NAME})$")
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    heading: bool
    article: int  # number of the innermost article, 0: none
    main: bool


def _named(names: str) -> str:
    """What a class, id or role names: "comments", other furniture "named", or neither."""
    found, tokens = "", names.split()
    content = any(_CONTENT_TOKEN.match(t.lower()) for t in tokens)
    for token in tokens:
        words = [w.lower() for w in _NAMES.findall(token) if not w.isdigit()]
        words = words[: next((i for i, w in enumerate(words) if w in MODIFIERS), len(words))]
        first = next((i for i, w in enumerate(words) if w in FURNITURE), None)
        if first is None:
            continue
        if any(w in COMMENTS for w in words):
            return "comments"
        if words[-1] in HEADS and _CONTENT.search("-".join(words[:first])):
            continue  # an article's or a post's own header holds its title
        # the last word says what it is, the first of what: a content-sidebar-wrap is content, an entry-footer or related-posts not
        if words[-1] in FURNITURE or not (content or _CONTENT.search("-".join(words[:first]))):
            found = "named"
    return found


def _furniture(name: str, attributes: str, inside_article: bool) -> str:
    """The zone without main text that an element opens: "out" by its tag or as hidden, "comments" or "named" by its names, or none."""
    if name in OUT or (name == "header" and not inside_article):
        return "out"
    if "=" not in attributes and "hidden" not in attributes:
        return ""
    zone = ""
    for key, a, b, c, bare in _ATTRIBUTE.findall(attributes):
        key, value = (key or bare).lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value.lower()):
            return "out"
        if zone == "comments":
            continue
        if key in ("class", "id", "role") and name not in ("html", "body", "main", "article"):
            zone = _named(value) or zone
        if key in ("class", "id") and name == "article" and any(w.lower() in ("comment", "comments", "reply") for w in _NAMES.findall(value)):
            zone = "comments"
    return zone


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, without those of furniture."""
    found, zones, size = _scan(page, frozenset())
    marked = any(b.article or b.main for b in found)

    def spare(kind: str, n: int, inside: bool) -> bool:
        if kind == "comments":
            return 0 < n == size
        # beside the text of a marked article, the name of a small zone holds
        return n * 2 > size and (not marked or n > LONG and (inside or n * 5 > size * 4))

    spared = frozenset(i for i, zone in enumerate(zones) if spare(*zone))
    return _scan(page, spared)[0] if spared else found


def _scan(page: str, spared: frozenset[int]) -> tuple[list[Block], list[tuple[str, int, bool]], int]:
    """Blocks outside zones, but for the spared ones; kind, unlinked characters and place in an article of every zone by name; characters of all zones and blocks."""
    out: list[Block] = []
    stack: list[tuple[str, str, int, bool, int]] = []  # tag, zone around, article, main, number of the named zone it opens or -1
    pieces: list[str] = []
    linked: list[str] = []
    zones: list[tuple[str, int, bool]] = []  # until a zone is closed, the characters before it
    size = 0
    articles, at, n, heading = 0, 0, len(page), False
    last = n if "<!--" in page else page.rfind(">")  # no tag begins behind the last end of one
    places: dict[str, list[int]] = {}  # of the open elements of each tag, so that no text or tag makes a search of the stack

    def top() -> tuple[str, str, int, bool, int]:
        return stack[-1] if stack else ("", "", 0, False, -1)

    def add(raw: str) -> None:
        nonlocal size
        zone = top()[1]
        if raw and zone != "out":
            inside_link = bool(places.get("a"))
            size += 0 if inside_link else len(raw.strip())
            if zone:
                return
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if inside_link:
                linked.append(text)

    def drop(i: int) -> None:
        for name, *_, zone in stack[i:]:
            places[name].pop()
            if zone >= 0:
                kind, before, inside = zones[zone]
                zones[zone] = (kind, size - before, inside)
        del stack[i:]

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                _, _, article, main, _ = top()
                out.append(Block(text, len(" ".join("".join(linked).split())), heading, article, main))
            pieces, linked = [], []

    def close(name: str, stop: frozenset[str] = frozenset()) -> None:
        """Close the innermost element of a tag, unless one of the `stop` tags is open inside it."""
        if places.get(name):
            i = places[name][-1]
            if all(not places.get(x) or places[x][-1] <= i for x in stop):
                drop(i)

    while at < n:
        start = page.find("<", at, last + 1)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        m = _TOKEN.match(page, start)
        if m is None:
            add("<")
            at = start + 1
            continue
        at = m.end()
        # the second form takes tags whose quotes do not pair
        closing, name, attributes = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        name = (name or "").lower()
        if not name:
            continue
        if closing:
            if name in BLOCK:
                flush()
                heading = False if name in HEADINGS else heading
            close(name, frozenset(["td", "th", "table"]) if name not in CONTAINERS else frozenset())
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in ("br", "wbr"):
            pieces.append(" " if name == "br" and not top()[1] else "")
            continue
        if name in BLOCK:
            flush()
            close("p", CONTAINERS)
            if name == "li":
                close("li", frozenset(["ul", "ol", "menu"]))
            elif name in ("dt", "dd"):
                close("dt", frozenset(["dl"]))
                close("dd", frozenset(["dl"]))
            elif name in ("td", "th", "tr"):
                for x in ("td", "th", "tr") if name == "tr" else ("td", "th"):
                    close(x, frozenset(["table", "tr"] if x != "tr" else ["table"]))
            heading = name in HEADINGS
        if name in VOID or attributes.endswith("/"):
            continue
        if name == "a":
            close("a", CONTAINERS)
        if name == "body":
            close("head")
        _, zone, article, main, _ = top()
        if name == "article" and not zone:
            articles += 1
            article = article or articles
        own, number = "" if zone == "out" else _furniture(name, attributes, article > 0 or main), -1
        if own and own != "out":
            number = len(zones)
            zones.append((own, size, article > 0 or main))
            own = "" if number in spared else own
        places.setdefault(name, []).append(len(stack))
        stack.append((name, "out" if own == "out" else zone or own, article, main or name == "main" or 'role="main"' in attributes, number))
    flush()
    drop(0)
    return out, zones, size


def _stop_share(b: Block) -> float:
    words = b.text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)


def _fits(found: list[Block]) -> bool:
    """Whether the stop words are of the page's language: unless most of its prose, by length and links, holds hardly any of them."""
    fitting = strange = 0
    for b in found:
        if len(b.text) >= SHORT and b.linked <= LINKED_SHORT * len(b.text):
            stop = _stop_share(b)
            fitting += len(b.text) * (stop >= STOP_LOW)
            strange += len(b.text) * (stop < STOP_NONE)
    return strange <= 2 * fitting


def _decide(b: Block, inside: bool, fits: bool = True) -> bool | None:
    """Pass one: True main text, False furniture, None undecided; by length and links alone where the stop words do not fit."""
    size = len(b.text)
    share = b.linked / size
    if share > LINKED or (size < SHORT and share > LINKED_SHORT and not inside):
        return False
    if size < SHORT or b.heading:
        return None
    if not fits:
        return True if share <= LINKED_SHORT and (size > LONG or b.text[-1] in SENTENCE_ENDS) else None
    stop = _stop_share(b)
    if stop >= STOP_HIGH or (inside and size > LONG):
        return True
    if stop >= STOP_LOW:
        return True if size > LONG else None
    return None if inside else False


def _inherit(found: list[Block], first: list[bool | None]) -> list[bool]:
    """Pass two: undecided blocks take the label of their neighbours."""
    decided = [i for i, x in enumerate(first) if x is not None]
    out, k = [], 0
    for i, x in enumerate(first):
        if x is None:
            while k < len(decided) and decided[k] < i:
                k += 1
            before, after = decided[k - 1] if k else None, decided[k] if k < len(decided) else None
            if before is None and after is None:
                x = True
            elif found[i].heading:
                x = bool(first[after]) if after is not None else False
            elif before is None or after is None:
                x = bool(first[before if after is None else after])
            else:
                near, far = (before, after) if i - before <= after - i else (after, before)
                x = bool(first[near]) if first[near] != first[far] else bool(first[far])
        out.append(bool(x))
    return out


def _inherit_inside(found: list[Block], first: list[bool | None]) -> list[bool]:
    """Pass two inside the marked article: undecided blocks are text unless furniture is on both sides of a short run of them."""
    out, n, start = [x is not False for x in first], len(found), 0
    while start < n:
        end = start + 1
        if first[start] is None:
            while end < n and first[end] is None:
                end += 1
            if start and end < n and not first[start - 1] and not first[end] and sum(len(b.text) for b in found[start:end]) <= LONG:
                out[start:end] = [b.heading for b in found[start:end]]
        start = end
    # a heading after the first text goes with a section that lost all its blocks
    kept = lost = False
    leads = next((i for i in range(n) if out[i] and not found[i].heading), n)
    for i in range(n - 1, -1, -1):
        if not found[i].heading:
            kept, lost = kept or out[i], lost or not out[i]
            continue
        if first[i] is None and i > leads and lost and not kept:
            out[i] = False
        kept = lost = False
    return out


def _marked(found: list[Block], fits: bool) -> list[bool] | None:
    """Which blocks the page's marked article holds; None if no mark holds most of the text that the passes accept."""
    if not any(b.article or b.main for b in found):
        return None
    weights = [(len(b.text) - b.linked) * ok for b, ok in zip(found, _inherit(found, [_decide(b, True, fits) for b in found]), strict=True)]
    sizes: dict[int, int] = {}
    for b, w in zip(found, weights, strict=True):
        if b.article:
            sizes[b.article] = sizes.get(b.article, 0) + w
    largest = max(sizes.values(), default=0)
    for inside in ([b.article > 0 and sizes[b.article] * SIBLING >= largest for b in found], [b.main for b in found]):
        if sum(w for w, i in zip(weights, inside, strict=True) if i) * 2 > sum(weights):
            return inside
    return None


def classify(found: list[Block]) -> list[bool]:
    fits = _fits(found)
    inside = _marked(found, fits)
    if inside is None:
        return _inherit(found, [_decide(b, False, fits) for b in found])
    at = [i for i, x in enumerate(inside) if x]
    within = [found[i] for i in at]
    labels = dict(zip(at, _inherit_inside(within, [_decide(b, True, fits) for b in within]), strict=True))
    return [labels[i] if i in labels else fits and len(b.text) > LONG and _stop_share(b) >= STOP_HIGH and _decide(b, False) is True for i, b in enumerate(found)]


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    return "\n".join(b.text for b, keep in zip(found, classify(found), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    id_type = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
