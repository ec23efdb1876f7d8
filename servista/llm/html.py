"""Main text of web pages by two passes over text blocks (operator 10).

A page is cut into blocks at block-level tags. Where a block stands gives it a prior: tags and roles of menus, footers, forms and
the like, and what is hidden, are boilerplate; class names that sound like it are a suspicion; an article is where main text is looked for.
What inline elements of such names hold is no text of their block.

Pass one decides a block by its length, the density of stop words and the density of links:

* boilerplate goes, whatever its words are;
* in an article it is main text from NEAR characters on with so many stop words, links or not; a list item or table
  cell that is mostly links goes; the rest is left open, unless the article has no main text so far: then all of it is;
* elsewhere it goes where it is mostly links; from LONG characters on the stop words decide; shorter ones are left open;
* what follows the page's articles of main text goes (comments, notices, teasers), as does what comes before them unless it has more prose.

Suspects go at first. Where one group of them (those of one article, or, if no other article has text, those of containers of equal names)
has more prose than AGAIN times the text that stays, its names mislead: the page is decided again without them. So a wrapper's name
never loses an article.

Where stop words are under KNOWN of the words of a page's long blocks, the page is in a language not listed, and length
and links decide alone. Pass two lets each open block inherit the label of its nearest decided neighbours: an article's
from those of its own article (its boilerplate apart), others from all of the page; a tie is main text.

Edge cases: null html is empty and gives an empty text; broken markup never fails (unclosed scripts and comments run
to the end, stray end tags are ignored); a page without any tag is one block, which is left open and goes if it is
short; nested articles count as one; rows that repeat stay; an empty table gives no rows. Only the columns page_id, url
and html are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

# Function words of the languages expected, as stop words.
STOP_WORDS = frozenset(
    """the of and to in a is that it for on was as with be by are this an at from or not have has had were which you they he she we his her their its but all can will there been if more when who would
    der die das und ist von den zu mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man
    de la le et les des en un du une que est pour qui dans par sur pas plus au ce il ne se son avec sont mais comme ou nous vous ils elle cette ses leur aux été être à
    el los las del que y en un una por con no para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde""".split()
)
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section
    summary table tbody td tfoot th thead title tr ul""".split()
)
RAW_TAGS = "script|style|template|noscript|textarea|select|svg|math|iframe|object|canvas|audio|video|button|title"
BAD_TAGS = frozenset("nav footer aside form head menu dialog fieldset".split())
BAD_NAMES = frozenset(
    """nav navbar navigation menu topnav subnav masthead header footer sidebar aside ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices
    popup modal overlay newsletter subscribe subscription signup login register social share sharing breadcrumb breadcrumbs comment comments commentlist disqus reply replies respond related recommended widget search
    pagination pager copyright legal disclaimer toolbar skip hidden alert""".split()
)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
GOOD_NAMES = frozenset("article content main post entry story body".split())
INLINE_TAGS = frozenset("a abbr b bdi cite code em font i ins label mark q s small span strong sub sup time u".split())
ITEM_TAGS = frozenset("li td th dd dt option".split())
# Names such as has-sidebar tell how a page is laid out.
LAYOUT = frozenset("has with no without".split())

#: Pass one: characters that make a block long (elsewhere, in an article); stop words to the word of main text; share of
#: link characters beyond which a block is mostly links; least share of stop words on pages in a listed language.
LONG, NEAR, STOPS, LINKS, KNOWN = 70, 25, 0.15, 0.33, 0.05
#: So many times the prose of what stays must suspects have to be taken for main text after all.
AGAIN = 2

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW_TAGS})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*+)>|<[!?/][^<>]*+>|[^<]+|<",
    re.S | re.I,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
_NAME = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
_LETTERS = re.compile(r"[^\W\d_]+")
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())


def _names(value: str) -> list[list[str]]:
    """The parts of each name in a class or id: post-footer and postFooter are post, footer."""
    return [[x.lower() for x in _NAME.findall(name)] for name in value.split()]


NO, SUSPECT, BAD = 0, 1, 2


def _boilerplate(tag: str, attrs: str, in_article: bool) -> int:
    """Whether an element is boilerplate: by tag, role or being hidden, or only by its names (SUSPECT)."""
    if tag in BAD_TAGS or (tag == "header" and not in_article):
        return BAD
    found = NO
    if not attrs.strip():
        return found
    for key, a, b, c, hidden in _ATTR.findall(attrs):
        value = a or b or c
        key, low = key.lower(), value.lower()
        if hidden or (key == "aria-hidden" and low == "true") or (key == "style" and "display:none" in low.replace(" ", "")):
            return BAD
        if key == "role" and low in BAD_ROLES:
            return BAD
        if key in ("class", "id") and tag not in ("body", "html"):
            for parts in _names(value):
                bad = BAD_NAMES.intersection(parts)
                if not bad or parts[0] in LAYOUT:
                    continue
                if tag in ("article", "main") and len(parts) > 1:  # of an article that has comments or a footer
                    continue
                if not (bad <= {"header", "masthead"} and GOOD_NAMES.intersection(parts)):  # an article's header has its title
                    found = SUSPECT
    return found


def _is_article(tag: str, attrs: str) -> bool:
    if tag in ("article", "main"):
        return True
    names = [x for key, a, b, c, _ in _ATTR.findall(attrs) if key.lower() in ("class", "id", "itemprop") for x in _names(a or b or c)] if tag in ("div", "section") else []
    return any({"article", "post", "entry", "story"}.intersection(x) or x == ["main", "content"] or x == ["maincontent"] for x in names)


class Block:
    """bad: boilerplate; suspect: the group of suspects it is in, None if none; article: the number of the article around it, 0 if none."""

    __slots__ = ("article", "bad", "item", "label", "linked", "stops", "suspect", "text", "words")

    def __init__(self, text: str, linked: int, bad: bool, suspect: str | None, article: int, item: bool):
        self.text, self.linked, self.bad, self.article, self.item, self.label = text, linked, bad, article, item, None
        self.suspect = suspect and (f"article {article}" if article else suspect)
        self.stops, self.words = sum(map(STOP_WORDS.__contains__, _LETTERS.findall(text.lower()))), text.count(" ") + 1

    def mostly_links(self) -> bool:
        return self.linked > LINKS * (len(self.text) - self.text.count(" "))


def blocks(page: str) -> list[Block]:
    """The page's blocks in order."""
    out: list[Block] = []
    text: list[str] = []
    linked = n_articles = 0
    top: tuple = ("", False, None, 0, False, False, False)  # tag, boilerplate, suspect, article, link, item, mute
    stack = [top]
    open_tags: Counter[str] = Counter()
    own, breaks = NO, 0

    def flush():
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append(Block(joined, linked, top[1] or own == BAD, top[2] or (f"p {own}" if own == SUSPECT else None), top[3], top[5]))
            text.clear()
        linked = 0

    def close(tag):
        nonlocal top
        while len(stack) > 1:
            name = stack.pop()[0]
            open_tags[name] -= 1
            if name == tag:
                break
        top = stack[-1]

    def enter(*entry):
        nonlocal top
        top = entry
        stack.append(entry)
        open_tags[entry[0]] += 1

    for m in _TOKEN.finditer(page):
        tag = m[3] or m[6]
        if tag is None:
            part = m[0]
            if (part[0] != "<" or part == "<") and not top[6]:
                text.append(part)
                if top[4]:
                    linked += len("".join(html.unescape(part).split()))
                if breaks and not part.isspace():
                    breaks = 0
            continue
        tag = tag.lower()
        if tag == "br":
            breaks += 1
            text.append(" ")
            if breaks > 1:
                flush()
            continue
        if tag in BLOCK_TAGS:
            flush()
            own = NO
            breaks = 0
        attrs = m[4] or m[7] or ""
        _, bad, suspect, article, link, item, mute = top
        if m[2] or m[5]:
            if open_tags[tag]:
                close(tag)
        elif tag in INLINE_TAGS:
            if tag == "a" and open_tags["a"]:
                close("a")
                _, bad, suspect, article, link, item, mute = top
            mute = mute or _boilerplate(tag, attrs, article > 0) > NO
            if tag == "a" or mute:  # others change nothing, and are often left open
                enter(tag, bad, suspect, article, link or tag == "a", item, mute)
        elif tag == "p":
            own = _boilerplate(tag, attrs, article > 0)
        elif tag in BLOCK_TAGS and tag not in VOID and not attrs.endswith("/"):
            kind = _boilerplate(tag, attrs, article > 0)
            bad = bad or kind == BAD
            if kind == SUSPECT and not suspect:
                suspect = " ".join(attrs.split())
            if not bad and not article and _is_article(tag, attrs):
                n_articles += 1
                article = n_articles
            enter(tag, bad, suspect, article, link, tag in ITEM_TAGS or (item and tag not in ("article", "main")), mute)
    flush()
    return out


def is_known(found: list[Block]) -> bool:
    """Whether the page's long blocks have stop words."""
    long_ = [b for b in found if len(b.text) >= LONG and not b.bad]
    return sum(b.stops for b in long_) >= KNOWN * sum(b.words for b in long_)


def prose(b: Block, known: bool) -> int:
    """Characters of a long block of few links and many stop words, else 0."""
    return len(b.text) if len(b.text) >= LONG and not b.mostly_links() and (b.stops >= STOPS * b.words or not known) else 0


def first_pass(found: list[Block], known: bool) -> None:
    """Set the label (True: main text) of each block that its own words and place decide."""
    good = set()
    for b in found:
        wordy = b.stops >= STOPS * b.words or not known
        if b.bad or b.suspect:
            b.label = False
        elif b.article:
            if b.mostly_links() and b.item:
                b.label = False
            elif len(b.text) >= NEAR and wordy:
                b.label = True
                good.add(b.article)
        elif b.mostly_links():
            b.label = False
        elif len(b.text) >= LONG:
            b.label = wordy
    for b in found:
        if b.label is None and b.article and b.article not in good:
            b.label = True
    inside = [i for i, b in enumerate(found) if b.label and b.article in good]
    if inside:
        before = sum(prose(b, known) for b in found[: inside[0]] if b.label and not b.article)
        first = inside[0] if before <= sum(prose(found[i], known) for i in inside) else 0
        for b in [*found[:first], *found[inside[-1] + 1 :]]:
            if not b.article:
                b.label = False


def second_pass(found: list[Block]) -> None:
    """Set the labels of the other blocks from their nearest decided neighbours."""
    n = len(found)
    best: list[tuple[int, bool]] = [(n + 1, False)] * n
    first = [b.label for b in found]
    for order in (range(n), range(n - 1, -1, -1)):
        last: dict[int, int] = {}
        for i in order:
            key = found[i].article
            if first[i] is not None:
                last[0] = i
                if key and not (found[i].bad or found[i].suspect):  # boilerplate inside an article decides nothing about the text around it
                    last[key] = i
            elif key in last:
                d, label = abs(i - last[key]), first[last[key]]
                if d < best[i][0] or (d == best[i][0] and label):
                    best[i] = (d, label)
    for b, now, (_, label) in zip(found, first, best, strict=True):
        if now is None:
            b.label = label


def misled(found: list[Block], known: bool) -> str | None:
    """The group of suspects that has far more prose than there is text without them; where an article has some, only another article's."""
    have: Counter[str] = Counter()
    articles = any(b.label and b.article for b in found)
    for b in found:
        if b.suspect and not b.bad and (b.article or not articles):
            have[b.suspect] += prose(b, known)
    group, most = max(have.items(), key=lambda x: x[1], default=(None, 0))
    return group if most > AGAIN * sum(len(b.text) for b in found if b.label) else None


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    known = is_known(found)
    first_pass(found, known)
    group = misled(found, known)
    if group:
        for b in found:
            b.label, b.suspect = None, b.suspect if b.suspect != group else None
        first_pass(found, known)
    second_pass(found)
    return "\n".join(b.text for b in found if b.label)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row; text is empty where a page has none."""
    common.small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "html"):
            got = [main_text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
