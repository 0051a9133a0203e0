"""Operator 7, HTML extraction: two-pass block rules.

A page is read once, tag by tag, into blocks (the text between block-level
tags). Regions that never hold the article (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) are left out by their
tag, role or class. Pass 1 decides the other blocks by link density, length and
stop-word density: good, bad, or ambiguous (short or in between). Pass 2 gives
each ambiguous block the label of the nearest decided neighbour; the edges of
an article element count as good neighbours, page edges and left-out regions as
bad ones. Good blocks are joined by one newline.

An element whose class or id starts or ends with a marker word (``comments``,
``ad-slot``) is such a region, too, unless it holds most of the page's text.
Inside an article element a longer name counts only if all its words are markers
or words for page parts: ``related-links`` does, ``social-history`` does not. A
name that is nothing but a marker (``id="discussion"``) always counts.

Inside an article element few stop words leave a block ambiguous instead of bad
(lists, code, names), so only dense links can drop it.

Scale: one map, no shuffle, bounded by an Arrow batch and one page.

Defined cases: null or empty html gives the empty text; unclosed tags, comments
and quotes end with the page; null keys are carried; repeated rows get equal
results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>[^"'>]*(?:"[^"]*"[^"'>]*|'[^']*'[^"'>]*)*+))>"""
    r"""|<(?P<close2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)(?:>|\Z)""", re.S)
#: One attribute after the other: a name is never looked for inside another name or inside a value.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TELLING = frozenset("class id role hidden aria-hidden style".split())

RAW = frozenset("script style textarea title xmp noembed noframes".split())  # their content is no markup
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small
span strike strong sub sup time tt u var wbr img""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that nest and end what was left open inside them; p, li and the like only part blocks.
NESTING = frozenset("""html body div section article main aside nav header footer form fieldset ul ol dl table tbody thead tfoot
figure details dialog center head noscript template svg math iframe object select button menu blockquote video audio canvas""".split())
LEFT_OUT = frozenset("""head nav footer aside form noscript template svg math iframe object select button menu dialog fieldset
video audio canvas""".split())
SOFT = frozenset(["form", "fieldset"])
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words that mark a class or id as something other than the article.
MARKERS = frozenset("""ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner
cookie cookies consent gdpr notice notices notification alert popup modal overlay sidebar sidebars aside widget widgets menu menus nav
navbar navigation breadcrumb breadcrumbs footer masthead toolbar comment comments disqus reply replies respond discussion share
sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager tagcloud
skip""".split())
#: Words for parts of a page: beside a marker they say nothing about the text.
PART_WORDS = frozenset("""area article articles author bar block blocks body bottom box button buttons card cards cell col column container content
count desktop entry fixed float footer form frame full google group head header heading holder icon icons image img inline inner item items label
large layer left link links list main media mobile module native new news outer page panel pane part post posts primary right row section
secondary site slot small sticky stories story strip tab tabs teaser text thread title tools top unit user users video view website wide wrap
wrapper zone""".split())
STATE_WORDS = frozenset("has with no is without js".split())  # "with-sidebar" says what the page has, not what this is
STOP_WORDS = frozenset("""the a an and or but if of to in on at by for from with as is are was were be been being this that these those it its
he she they we you i not no do does did have has had will would can could may there here their his her our your which who what when
der die das den dem des ein eine einen und oder aber ist sind war im in zu mit von auf für als auch nicht sich es er sie wir ihr an bei nach
le la les un une des du de et ou mais est sont dans en que qui pour par sur avec au aux ce cette il elle nous vous ne pas se son sa
el los las una unos y o pero es son del al que por para con su sus lo como más no""".split())

LENGTH_LOW, LENGTH_HIGH = 70, 200  # characters
STOP_LOW, STOP_HIGH = 0.15, 0.25  # share of words
MAX_LINKS = 0.5  # share of characters inside links

GOOD, BAD, OPEN = 1, 0, None


def _names(value: str) -> Iterator[list[str]]:
    for name in value.split():
        parts = [p for p in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if p]
        if parts and parts[0] not in STATE_WORDS:
            yield parts


def left_out(tag: str, attrs: str, in_article: bool) -> int:
    """0: an ordinary element; 1: left out unless it wraps most of the page's text (forms, marker names); 2: left out."""
    soft = int(tag in SOFT)
    if (tag in LEFT_OUT and not soft) or (tag == "header" and not in_article):
        return 2
    if not attrs or tag in ("html", "body", "main", "article"):
        return soft
    for m in ATTRIBUTE.finditer(attrs):
        key = m[1].lower()
        if key not in TELLING:
            continue
        value = next((g for g in m.groups()[1:] if g is not None), "")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return 2
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
        if key == "role" and value.lower() in LEFT_OUT_ROLES:
            return 2
        if key in ("class", "id"):
            for parts in _names(value):
                marked = parts[0] in MARKERS or parts[-1] in MARKERS
                if marked and in_article:
                    marked = all(p in MARKERS or p in PART_WORDS or p.isdigit() or len(p) < 3 for p in parts)
                if marked or (not in_article and "header" in (parts[0], parts[-1])):
                    soft = 1
    return soft


class Block:
    __slots__ = ("text", "links", "article", "heading", "gap", "within")

    def __init__(self, text: str, links: int, article: int, heading: bool, gap: bool, within: int = -1):
        self.text, self.links, self.article, self.heading, self.gap, self.within = text, links, article, heading, gap, within


def blocks_of(page: str, wrappers: frozenset[int] | None = frozenset(), parents: dict[int, int] | None = None) -> list[Block]:
    """Blocks outside left-out regions; elements that start at ``wrappers`` are ordinary ones (None: all that may be;
    ``within`` is the innermost around a block, -1 for none, and ``parents`` gets the next one around each). ``article``: number of the article element around it, or 0; ``gap``: a left-out region stands before it."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, int]] = []  # nesting element, left out, article and wrapper around it
    opened: Counter[str] = Counter()  # elements of the stack by name
    buffer: list[tuple[str, bool]] = []
    skip = article = articles = in_link = 0
    around = -1  # start of the innermost open wrapper
    heading = gap = False

    def flush() -> None:
        nonlocal gap
        if buffer:
            text = " ".join(entities.unescape("".join(t for t, _ in buffer)).split())
            if text:
                links = len(" ".join(entities.unescape("".join(t for t, linked in buffer if linked)).split()))
                out.append(Block(text, links, article, heading, gap, around))
                gap = False
            buffer.clear()

    at, n = 0, len(page)
    while at < n:
        m = MARKUP.search(page, at)
        text = page[at: m.start() if m else n]
        if text and not skip:
            buffer.append((text, in_link > 0))
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue  # a comment or a declaration
        closing = bool(m["close"] or m["close2"])
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in RAW:
            if not closing:
                end = re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I).search(page, at)
                close = page.find(">", end.start())
                at = n if close < 0 else close + 1
            continue
        if tag in INLINE and not (tag not in VOID and not closing and left_out(tag, attrs, article > 0) and not (wrappers and m.start() in wrappers)):
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        if tag == "br":
            if not skip:
                buffer.append((" ", in_link > 0))
            continue
        flush()
        in_link = 0 if tag != "a" else in_link
        if re.fullmatch("h[1-6]", tag):
            heading = not closing
        if tag in VOID:
            continue
        kind = 0 if closing or attrs.endswith("/") else left_out(tag, attrs, article > 0)
        wrapper = kind == 1 and (wrappers is None or m.start() in wrappers)
        hidden = kind > 0 and not wrapper
        if not closing and (tag in NESTING or kind):
            number = article
            if tag in ("article", "main") and not article and not skip:
                articles += 1
                number = articles
            if hidden:
                skip += 1
                gap = True
            stack.append((tag, hidden, article, around))
            opened[tag] += 1
            if wrapper:
                if parents is not None:
                    parents[m.start()] = around
                around = m.start()
            article, heading = number, False
        elif closing and opened[tag]:
            while True:
                t, was_hidden, before, around = stack.pop()
                opened[t] -= 1
                skip -= was_hidden
                article, heading = before, False
                if t == tag:
                    break
    flush()
    return out


def is_long(b: Block) -> bool:
    return len(b.text) >= LENGTH_LOW and b.links <= MAX_LINKS * len(b.text)


def main_wrappers(page: str) -> frozenset[int]:
    """Forms and marker-named elements that hold most of the long, link-poor text of the page: the article is in them."""
    parents: dict[int, int] = {}
    blocks = [b for b in blocks_of(page, None, parents) if is_long(b)]
    held: Counter[int] = Counter()
    for b in blocks:
        held[b.within] += len(b.text)
    for w in sorted(parents, reverse=True):  # what an element holds, the one around it holds, too
        held[parents[w]] += held[w]
    held.pop(-1, None)
    total = sum(len(b.text) for b in blocks)
    return frozenset(w for w, n in held.items() if 2 * n > total)


def known_language(blocks: list[Block]) -> bool:
    """The long, link-poor text has the stop words of a known language, or there is none to tell by."""
    words = [w for b in blocks if is_long(b) for w in re.findall(r"\w+", b.text.lower())]
    return not words or sum(w in STOP_WORDS for w in words) >= STOP_LOW * len(words)


def first_pass(b: Block, known: bool = True) -> int | None:
    """Good, bad or ambiguous, from the block alone; by length and links only where the language is not known."""
    n = len(b.text)
    if b.links > MAX_LINKS * n:
        return BAD
    if b.heading:
        return OPEN
    if n < LENGTH_LOW:
        return OPEN
    if not known:
        return GOOD
    words = re.findall(r"\w+", b.text.lower())
    stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stop >= STOP_HIGH or (stop >= STOP_LOW and n >= LENGTH_HIGH):
        return GOOD
    return OPEN if b.article or stop >= STOP_LOW else BAD


def second_pass(blocks: list[Block], labels: list[int | None]) -> list[int]:
    """Ambiguous blocks take the label of the nearest decided neighbour; at equal distance good wins inside articles."""
    n = len(blocks)
    far = n + 1

    def neighbours(order: range, step: int) -> list[tuple[int, int]]:
        """(distance, label) of the decided neighbour on one side."""
        found: list[tuple[int, int]] = [(far, BAD)] * n
        at, label, around = None, BAD, None
        for i in order:
            edge = (blocks[i].gap if step > 0 else i + 1 < n and blocks[i + 1].gap)
            if around != blocks[i].article or at is None or (edge and not blocks[i].article):
                # the edge of an article, of the page or of a left-out region
                at, label, around = i - step, GOOD if blocks[i].article else BAD, blocks[i].article
            found[i] = (abs(i - at), label)
            if labels[i] is not None and not (blocks[i].article and labels[i] == BAD):  # a list of links in an article decides itself only
                at, label = i, labels[i]
        return found

    before, after = neighbours(range(n), 1), neighbours(range(n - 1, -1, -1), -1)
    out = []
    for i, label in enumerate(labels):
        if label is None:
            (d1, l1), (d2, l2) = before[i], after[i]
            label = l1 if d1 < d2 else l2 if d2 < d1 else l1 if l1 == l2 else GOOD if blocks[i].article else BAD
            if blocks[i].heading and not blocks[i].article:
                label = l2  # a heading goes with what follows it
        out.append(label)
    return out


def main_text(page: str) -> str:
    blocks = blocks_of(page, main_wrappers(page))
    known = known_language(blocks)
    labels = second_pass(blocks, [first_pass(b, known) for b in blocks])
    return "\n".join(b.text for b, label in zip(blocks, labels) if label == GOOD)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p or "") for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kept = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return kept.mapInArrow(run, "page_id long, url string, text string, n_chars long")
