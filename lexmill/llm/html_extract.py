"""Main text of web pages by two passes of block rules.

A scanner cuts a page into blocks at block-level tags and notes for each its text, its
links' share of it, whether it is a heading, the section that it stands in (an article or
main element, or the rest of the page), and whether it lies in menus, page headers and
footers, sidebars, notices, adverts, forms or reader comments (by tag, role, class or id).

Pass 1 classifies each block on its own. Link density over `max_link_density` is bad, and
so is what lies in such a part of the page. Stop-word density and length class the others:
long ones of many stop words are good; of some, near-good; under `short` characters,
short; of few stop words, poor.

Pass 2 decides these last three by the nearest good or link-dense blocks on either side in
their section: near-good ones are good if one side is; short and headings if none is bad
(a heading follows what comes after it); poor ones if no side is bad and one is good.
Without a decided block on either side near-good ones are good, and all are in an article,
or where the page has none.
Text is never shortened: a block is kept whole or dropped whole.

A scan takes time in proportion to the page, whatever is left open in it. A tag's quoted
values may hold any text; a quote that is never closed counts as a plain character.

Null and empty pages, and those without a good block, give the empty text. Other columns
are kept, but for those named like a result. Unclosed tags end with their parent.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import map_texts

STOP_WORDS = frozenset(
    """a about after all also an and any are as at be been but by can could did do for from had has have he her his i if in
    into is it its just more my new no not of on one or other our out over she so some such than that the their them then
    there these they this to up us was we were what when which who will with would you your
    au aux avec ce ces cette comme dans de des du elle en est et ete être il ils je la le les leur lui mais me même ne nous on
    ont ou par pas plus pour qu que qui sa se ses si son sont sur un une vous
    aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich
    ihr im ist kann man mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir wird zu
    zum zur al como con cuando del desde donde el ella entre era es esta este fue ha hay la las lo los más mi muy nos o para
    pero por porque que se ser si sin sobre son su sus también te tiene todo un una y ya""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is not text of the page.
SKIP = frozenset("script style noscript template svg math iframe object canvas audio video title textarea select button head-meta".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
BAD_TAGS = frozenset("nav aside footer form dialog menu".split())
BAD_ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar".split())
#: Parts of class names and ids.
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav\w*|menus?|breadcrumbs?|sidebars?|side-?bar|widgets?|footer|site-?header|page-?header|masthead|topbar|toolbar|"
    r"comments?|commentlist|disqus\w*|reply|replies|respond|cookies?|consent|gdpr|notices?|notification\w*|alerts?|disclaimer|popup|pop-up|modal|overlay|newsletter|subscribe|subscription|signup|sign-up|login|"
    r"related|recommend\w*|share|sharing|social\w*|search\w*|pagination|pager|tags|tagcloud|skip\w*|copyright)(?=$|[\s_-])",
    re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: The rest of a tag: a > counts as its end unless it stands in a quoted value.
TAG_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
CLOSE = {t: re.compile(rf"</{t}\b", re.I | re.A) for t in RAW | SKIP}
NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
WORD = re.compile(r"[^\W\d_]+")
FIELDS = [T.StructField("text", T.StringType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_kept", T.LongType())]


class Block:
    __slots__ = ("text", "linked", "heading", "context", "section", "label")

    def __init__(self, text: str, linked: int, heading: bool, context: str, section: int = 0):
        self.text, self.linked, self.heading, self.context, self.section, self.label = text, linked, heading, context, section, ""


def context_of(tag: str, attributes: str, above: str) -> str:
    """'bad', 'article' or '' for what an element holds; a bad context stays bad."""
    if above == "bad":
        return above
    if tag in BAD_TAGS or tag == "header" and above != "article":
        return "bad"
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role" and value.lower() in BAD_ROLES or key in ("class", "id") and tag not in ("body", "html") and BAD_NAMES.search(value):
                return "bad"
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return "bad"
    return "article" if tag in ("article", "main") else above


def blocks(page: str) -> list[Block]:
    """The page's blocks with a text, in order."""
    out: list[Block] = []
    parts: list[str] = []
    linked = anchors = 0
    heading = False
    stack: list[tuple[str, str, str, int]] = []  # open elements: tag, the context in them, the tag that made it bad, section
    opened: Counter[str] = Counter()
    never: set[str] = set()  # tags that are not closed any more
    context, cause, section, sections, at, n = "", "", 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, heading, context, section))
            parts, linked = [], 0

    def pop() -> str:
        nonlocal context, cause, section
        tag = stack.pop()[0]
        opened[tag] -= 1
        _, context, cause, section = stack[-1] if stack else ("", "", "", 0)
        return tag

    def after(tag: str) -> int:
        """The place after the element's closing tag, -1 where there is none."""
        if tag in never:
            return -1
        m = CLOSE[tag].search(page, at)
        end = page.find(">", m.end()) if m else -1
        if end < 0:
            never.add(tag)
            return -1
        return end + 1

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            parts.append(page[at:lt])
            if anchors:
                linked += len(" ".join(html.unescape(page[at:lt]).split()))
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = NAME.match(page, lt + 1)
        if m is None:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:  # a plain <
                parts.append("<")
                at = lt + 1
            continue
        rest = TAG_REST.match(page, m.end())
        if rest is None:
            break
        end = rest.end() - 1
        tag, closing = m[1].lower(), page[lt + 1] == "/"
        attributes = page[m.end() : end]
        at = end + 1
        if tag in RAW or tag in SKIP:
            if not closing and not attributes.endswith("/"):
                if tag in BLOCK:
                    flush()
                close = after(tag)
                at = close if close >= 0 else (at if tag not in ("script", "style") else n)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if tag == "a":
            anchors = 0 if closing else 1
        if closing:
            if opened[tag]:
                while pop() != tag:
                    pass
            if tag in BLOCK:
                anchors, heading = 0, False
        elif tag in BLOCK and not attributes.endswith("/") and tag not in VOID:
            if tag in ("article", "main") and context == "bad" and cause in ("nav", "header", "form"):
                context = ""  # a page-wide form, or a menu or page header left open
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                pop()
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            anchors = 0
            above, context = context, context_of(tag, attributes, context)
            if context == "bad" != above:
                cause = tag
            if context == "article" != above:
                sections += 1
                section = sections
            stack.append((tag, context, cause, section))
            opened[tag] += 1
    flush()
    return out


def first_pass(b: Block, stop_words: frozenset[str] = STOP_WORDS, short: int = 70, long: int = 200, low: float = 0.15, high: float = 0.30, max_link_density: float = 0.5) -> str:
    """bad, good, or what pass 2 decides: near, short or poor."""
    if b.linked > max_link_density * len(b.text):
        return "bad"
    if b.context == "bad":
        return "off"
    if len(b.text) < short:
        return "short"
    words = WORD.findall(b.text.lower())
    stops = sum(w in stop_words for w in words) / max(1, len(words))
    return "poor" if stops < low else "good" if stops >= high and len(b.text) > long else "near"


def second_pass(b: Block, before: str, after: str, articles: bool) -> str:
    """good or bad, by the nearest decided labels before and after the block ("" for none); articles: the page has some."""
    if not (before or after):
        return "good" if b.label == "near" or b.context == "article" or not articles else "bad"
    sides = (before, after)
    if b.label == "near":
        return "good" if "good" in sides else "bad"
    if b.heading and after:
        return after
    return "good" if "bad" not in sides else "bad"


def classify(found: list[Block], **rules) -> list[Block]:
    """Sets each block's label: good or bad."""
    for b in found:
        b.label = first_pass(b, **rules)

    def nearest(order) -> list[str]:
        """For each block of the order the last decided label in its section."""
        last: dict[int, str] = {}
        out = []
        for b in order:
            out.append(last.get(b.section, ""))
            if b.label in ("good", "bad") and b.context != "bad":  # what other parts of the page hold says nothing of this one
                last[b.section] = b.label
        return out

    articles = any(b.context == "article" for b in found)
    for b, before, after in zip(found, nearest(found), reversed(nearest(reversed(found))), strict=True):
        # labels are read above, before any is set
        b.label = "bad" if b.label == "off" else b.label if b.label in ("good", "bad") else second_pass(b, before, after, articles)
    return found


def main_text(page: str) -> tuple[str, int, int]:
    found = classify(blocks(page))
    kept = [b.text for b in found if b.label == "good"]
    return "\n\n".join(kept), len(found), len(kept)


def extract(pages: DataFrame, html_column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The pages with text, n_blocks and n_kept."""

    def make():
        def f(texts: list) -> list:
            rows = [main_text((t or b"").decode("utf-8", "replace")) for t in texts]
            return [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]

        return f

    return map_texts(pages, html_column, FIELDS, make, keep)


def op2(spark, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
