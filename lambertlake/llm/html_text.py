"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags; scripts, styles, comments and other raw
elements give no text. The first pass decides a block by its length, its share of stop words
and its share of linked text, inside articles as elsewhere: long blocks dense in stop words are
good, blocks that are mostly links are bad, and short or middling ones stay open. Names are one
more vote: what stands in menus, headers, footers, asides, forms, or in elements whose class,
id or role names an advert, notice, comment section or the like, is bad at once. The second
pass lets open blocks inherit from their nearest decided neighbours. Inside an article or main
element neighbours are blocks of the same element that the densities decided; where one side
has none, the element itself counts as a good neighbour, so that short texts, tables and
listings of an article stay. Outside, on a page whose article or main element has text, open
blocks are bad; on a page without, where nothing is decided, they stay. A page without an
article none of whose blocks has stop words is in another language: there length decides alone
(wide characters count threefold).

A class or id counts as furniture only if all its parts are names of furniture or of mere
containers (``ad-slot``, ``share-buttons``), so ``share-price`` and ``no-sidebar`` don't; those
of ``html`` and ``body`` never do. Names of layout, and ``form``, don't count on an element
around an article with most of the text of all articles, or, on a page whose articles hold no
text, around most of the page's text. An element is hidden by the attribute ``hidden`` or by
its style. An article's own heading part is its own; ``noscript`` is read inside articles and
left out elsewhere; ``math`` is text, ``svg`` isn't.

Character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by one line end. ``br`` is white space. Null and empty pages and pages
without good blocks give the empty text. Malformed pages are read as far as they go: an
unended tag at the end is dropped, a quote opens a value of whatever length only after ``=``
and only if it closes, a closing tag without an opening one (in the same article) is ignored
however many elements are open, and an article or main element ends an unclosed menu, header
or form before it. Time and memory are linear in the page. Repeated rows are extracted each;
other columns pass through.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lambertlake.llm import runtime

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Elements whose content isn't read, and where it ends.
_RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in "script style template svg iframe object textarea select title canvas video audio".split()}
#: What stands between the quoted values of a tag, a quoted value, and a tag that is none.
_BARE = re.compile(r"""[^<>=]*+(?:=(?!\s*+["'])[^<>=]*+)*+""")
_VALUE = re.compile(r"""=\s*+(?:"[^"]*+"|'[^']*+')""")
_BOGUS = re.compile(r"</[^>]*(?:>|\Z)")
#: The last case steps over the quoted values of other attributes, which may hold pages of their own.
_ATTR = re.compile(r"""(?<![\w:.-])(?:(class|id|role|style|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(hidden)(?![\w:.-]))|=\s*(?:"[^"]*"|'[^']*')""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PART = re.compile(r"[_-]+")

# Names of elements, parts of names of page furniture, stop words of four languages.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option button label noscript".split()
)
FURNITURE = set("nav header footer aside form menu dialog button fieldset head legend label option select input noscript".split())
CONTENT = {"article", "main"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NAMED = set(
    "nav navbar navigation menu sidebar side footer header banner masthead ad ads advert adverts advertisement sponsor sponsored promo "
    "cookie cookies cookiebar consent gdpr notice alert popup modal overlay newsletter subscribe signup login comment comments commentlist reply replies "
    "disqus respond adsbygoogle related recommended share sharing social breadcrumb breadcrumbs pagination pager toolbar widget copyright search form "
    "skip complementary contentinfo".split()
)
#: Names that tell what a place holds, not where it is: they count whatever stands in it.
FOREIGN = set(
    "ad ads advert adverts advertisement sponsor sponsored promo cookie cookies cookiebar consent gdpr notice alert popup modal overlay newsletter "
    "subscribe signup login comment comments commentlist reply replies disqus respond adsbygoogle related recommended".split()
)
HOLDERS = set(
    "site page post article entry user main top bottom left right inner outer inline bar box block wrap wrapper container content list item section "
    "area slot unit row group zone panel thread button buttons links icons posts articles media policy message text".split()
)
STOP = set(
    "the of and to in is that for it on with as was are this be by at from or an have not which you a "
    "de la le les et des en un une du est que pour dans qui par sur au avec ne pas ce il elle "
    "der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es "
    "el los las y del se por con para una su al lo como más o pero sus".split()
)

SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.12, 0.25
LINKED = 0.35
GOOD, BAD, NEAR, OPEN = "good", "bad", "near", "open"


class Block(NamedTuple):
    text: str
    linked: int
    furniture: bool | int  # from labels() on whether it is; before, the number of the innermost such element it stands in, 0 for none
    region: int  # the article or main element it stands in, 0 for none
    item: bool


#: How an element is furniture: not, by a name of layout that what it holds may overrule, for good.
NOT, LAYOUT, SURE = 0, 1, 2


def _names_furniture(value: str, inside: bool) -> int:
    """How a class, id or role names furniture; an article's own heading part isn't."""
    most = NOT
    for name in _CAMEL.sub("-", value).lower().split():
        parts = [p for x in _PART.split(name) if (p := x.strip("0123456789"))]
        named = NAMED.intersection(parts)
        if inside:
            named.discard("header")
        if named and all(p in NAMED or p in HOLDERS for p in parts):
            most = max(most, SURE if named & FOREIGN else LAYOUT)
    return most


def _named_furniture(attrs: str, inside: bool) -> int:
    """How class, id, role or style say so."""
    most = NOT
    for key, value, hidden in _ATTR.findall(attrs):
        value = value.strip("\"'")
        if hidden:
            return SURE
        if key.lower() == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return SURE
        elif key:
            most = max(most, _names_furniture(value, inside))
    return most


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the tag whose name ends at ``at`` ends, or -1 if a "<" makes it no tag.

    ``dead`` keeps the values from which that was found, so that none is read twice and the
    time is linear in the page.
    """
    seen = []
    while True:
        at = _BARE.match(page, at).end()
        if at == len(page) or page[at] == ">":
            return at
        if page[at] == "<" or at in dead:
            dead.update(seen)
            return -1
        seen.append(at)
        value = _VALUE.match(page, at)
        at = value.end() if value else at + 1


def _tags(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Start, end, name, whether closing, and attributes of tags; other markup has no name."""
    at, dead = 0, set()
    while m := _TAG.search(page, at):
        start, at = m.span()
        name, attrs = m["name"], ""
        if name is not None:
            end = _tag_end(page, at, dead)
            if end >= 0:
                attrs, at = page[at:end], min(end + 1, len(page))
                raw = None if m["close"] else _RAW.get(name.lower())
                if raw:
                    closed = raw.search(page, at)
                    name, at = None, closed.end() if closed else len(page)
            elif m["close"]:
                name, at = None, _BOGUS.match(page, start).end()
            else:
                continue
        yield start, at, name, m["close"] == "/", attrs


class _Open:
    """The open elements: a stack that knows how often a name is open in the current article."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool]] = []  # name, how it is furniture, is content
        self.names: list[Counter] = [Counter()]  # outside, then for each open article or main
        self.furniture: list[tuple[int, int]] = []  # place in the stack and number of open furniture
        self.regions = [0]
        #: For each piece of furniture and each region by number: what it stands in, and more.
        self.pieces: list[tuple[int, int]] = [(0, NOT)]  # piece around it, how it is furniture
        self.places: list[tuple[int, int]] = [(0, 0)]  # region around it, piece around it

    @property
    def piece(self) -> int:
        return self.furniture[-1][1] if self.furniture else 0

    def push(self, name: str, furniture: int, content: bool = False) -> None:
        if content:
            self.places.append((self.regions[-1], self.piece))
            self.regions.append(len(self.places) - 1)
            self.names.append(Counter())
        if furniture:
            self.pieces.append((self.piece, furniture))
            self.furniture.append((len(self.stack), len(self.pieces) - 1))
        self.stack.append((name, furniture, content))
        self.names[-1][name] += 1

    def cut(self, n: int) -> None:
        """Close all but the first n."""
        while len(self.stack) > n:
            name, furniture, content = self.stack.pop()
            self.names[-1][name] -= 1
            if furniture:
                self.furniture.pop()
            if content:
                self.names.pop()
                self.regions.pop()

    def close(self, name: str) -> None:
        """Close the innermost element of that name and those left open in it, not across an article's border."""
        if self.names[-1][name] > 0:
            n = len(self.stack) - 1
            while self.stack[n][0] != name:
                n -= 1
            self.cut(n)


def _overruled(found: list[Block], opened: _Open) -> list[Block]:
    """The blocks with their furniture decided: layout around the page's main text is none."""
    plain = [len(b.text) - b.linked for b in found]
    held, read = [0] * len(opened.pieces), [0] * len(opened.places)
    for b, n in zip(found, plain):
        held[b.furniture] += n
        read[b.region] += n
    for sums, around in ((held, opened.pieces), (read, opened.places)):
        for k in range(len(sums) - 1, 0, -1):  # what stands in an element has a higher number
            sums[around[k][0]] += sums[k]
    within = sum(n for b, n in zip(found, plain) if b.region)
    free = set()
    for k in range(1, len(read)):
        at = opened.places[k][1]
        while 2 * read[k] > within and at and at not in free:
            free.add(at)
            at = opened.pieces[at][0]
    is_furniture = [False]
    for k in range(1, len(held)):
        around, how = opened.pieces[k]
        most = not within and 2 * held[k] > held[0]
        is_furniture.append(is_furniture[around] or how == SURE or not (k in free or most))
    return [b._replace(furniture=is_furniture[b.furniture]) for b in found]


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    opened, in_link = _Open(), 0

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                link = len(" ".join(entities.unescape("".join(linked)).split())) if linked else 0
                out.append(Block(text, link, opened.piece, opened.regions[-1], opened.names[-1]["li"] > 0))
            parts.clear()
            linked.clear()

    at = 0
    for start, end, name, closing, attrs in _tags(page):
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            if in_link:
                linked.append(piece)
        at = end
        if name is None:
            continue
        name = name.lower()
        inside = opened.regions[-1] > 0
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        elif name not in BLOCKS:
            # An inline element counts only if it is furniture itself, as a span of an advert; those inside count to its end.
            if closing:
                if opened.names[-1][name] > 0:
                    flush()
                    opened.close(name)
            elif name not in VOID and attrs and (named := _named_furniture(attrs, inside)):
                flush()
                opened.push(name, named)
            elif opened.names[-1][name] > 0:
                opened.push(name, NOT)
        else:
            flush()
            in_link = 0
            if closing:
                opened.close(name)
            elif name not in VOID:
                content = name in CONTENT
                stack = opened.stack
                if content and opened.furniture:
                    first = opened.furniture[0][0]
                    if stack[first][0] in ("nav", "header", "form", "head", "menu"):
                        opened.cut(first)
                elif name in ("p", "li", "tr", "td", "dt", "dd", "option") and stack and stack[-1][0] == name:
                    opened.cut(len(stack) - 1)
                own = inside and name in ("header", "noscript")
                named = _named_furniture(attrs, inside) if attrs and not content and name != "body" else NOT
                tag = SURE if name in FURNITURE and name != "form" else LAYOUT if name == "form" else NOT
                opened.push(name, NOT if own else max(tag, named), content)
    if at < len(page):
        parts.append(page[at:])
        if in_link:
            linked.append(page[at:])
    flush()
    return _overruled(out, opened)


def first_pass(b: Block) -> str:
    """What names, length and densities say of a block by itself."""
    n = len(b.text)
    if b.furniture:
        return BAD
    if b.linked > LINKED * n:
        return BAD if b.item or not b.region else OPEN
    if not b.region and "©" in b.text and n < LONG:
        return BAD
    if n < SHORT:
        return BAD if b.linked and not b.region else OPEN
    words = _WORD.findall(b.text.lower())
    stop = sum(map(STOP.__contains__, words)) / max(1, len(words))
    if stop >= STOP_HIGH and n > LONG:
        return GOOD
    if stop >= STOP_LOW:
        return NEAR
    return BAD if b.linked and not b.region else OPEN


def _by_length(b: Block) -> str:
    n = len(b.text) + 2 * sum(c >= "\u2e80" for c in b.text)
    return GOOD if n > LONG else NEAR if n >= SHORT else OPEN


def _neighbours(found: list[Block], first: list[str]) -> list[tuple[str | None, int]]:
    """For each block the last decided one before it that may lend its label, and how far back that is."""
    seen: dict[int, tuple[str, int]] = {}
    place: Counter = Counter()
    out: list[tuple[str | None, int]] = []
    for b, x in zip(found, first):
        label, at = seen.get(b.region, (None, 0))
        out.append((label, place[b.region] - at))
        if not (b.region and b.furniture):
            if x in (GOOD, BAD):
                seen[b.region] = (x, place[b.region])
            place[b.region] += 1
    return out


def labels(found: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    first = [first_pass(b) for b in found]
    article = any(b.region and not b.furniture for b in found)
    if not article and GOOD not in first and NEAR not in first:  # another language
        first = [_by_length(b) if x == OPEN else x for b, x in zip(found, first)]
    before = _neighbours(found, first)
    after = _neighbours(found[::-1], first[::-1])[::-1]
    out = []
    for block, x, (a, far_a), (b, far_b) in zip(found, first, before, after):
        if x in (GOOD, BAD):
            out.append(x == GOOD)
        elif block.region:
            if a is None or b is None or a == b:
                out.append(GOOD in (a or GOOD, b or GOOD))
            else:
                out.append(x == NEAR or (a if far_a < far_b else b) == GOOD or far_a == far_b)
        elif article:
            out.append(False)
        elif a is None and b is None:
            out.append(True)  # nothing is decided
        elif a is None or b is None or a == b:
            out.append((a or b) == GOOD or (x == NEAR and GOOD not in first))
        else:
            out.append(x == NEAR or (a if far_a < far_b else b) == GOOD or far_a == far_b)
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, labels(found)) if keep)


def extract(df: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """``df`` with each page's main text in the string column ``out``."""
    runtime.small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != out]
    columns = [f.name for f in kept]

    def run(batches):
        for batch in runtime.slices(batches):
            got = [main_text(h) for h in batch.column(page).to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(batch.column, columns), pa.array(got, pa.string())], names=[*columns, out])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType(), False)]))


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    pages = runtime.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
