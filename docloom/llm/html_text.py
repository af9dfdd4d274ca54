"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Each block knows its text, how much of it is link text, its
share of stop words, and whether its markup excludes it (navigation, header, footer, aside, form, a hidden
element, or a class, id or role that names such a part). A token names one if all its words are such names or
neutral ("header", "ad-box"), or if one word of it speaks of comments, adverts or notices ("reader-comments",
"legal-notice") and none of it negates or merely tells of them ("no-comments", "has-sidebar", "ad-free"). Names
never exclude html, body, main, article or h1. Named and hidden parts, and forms not in an article element,
that hold most of the page's good blocks are no such parts, unless the text of article elements stands
outside only. Hidden inline elements are left out of their block's text.

Link text is the text of links with href. A link ends at its end tag, at the next link, at the end of the
element it stands in, or, where no end tag follows before the next link, at the edge of its block.

Pass 1 decides each block on its own: excluded or link-dense blocks are boilerplate (inside an article
element only where hardly a word stands outside the links); long blocks rich in stop words are content, poor
ones boilerplate; short blocks, and poor ones that are not long or stand in an article element, stay open.
Stop words say nothing about scripts other than Latin: there, long blocks with a sentence's end are content, the
others stay open. They say as little about a page where no block is rich in them, so there the poor blocks are
judged like that too. Pass 2: an open block takes the label of the nearest decided block before or after it (content
where both are as near and differ). Neighbours are looked for within a stretch of the page: parts that markup
excludes end it, and so do the edges of an article element. A stretch without decided blocks is content
inside an article element, or where the page has no content otherwise.

Character references are decoded, white space inside a block becomes one space, blocks are joined in page
order by one space. Null html counts as empty; a page without content gives an empty string. Broken or
cut-off markup is read as far as it goes. Pages are independent: one map, no shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of the four languages of the corpus.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be been but by can could do for from had has have he her his
    i if in into is it its more no not of on one or our out she so some than that the their them then there
    these they this to up was we were what when which who will with would you your
    à au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous
    on ou où par pas plus pour qu que qui sa se ses si son sont sur un une vous
    aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es
    für hat ich ihr im ist mit nach nicht noch nur oder sich sie sind so über um und von vor war wie wir zu
    zum zur
    al como con cual cuando del desde donde el ella en entre era es esta este fue ha hasta la las lo los más me
    mi muy no nos o para pero por porque que se sin sobre su sus también te un una uno y ya
    """.split()
)
# Limits of the block rules.
SHORT_CHARS, LONG_CHARS = 70, 200
LOW_DENSITY, HIGH_DENSITY = 0.2, 0.3
LINK_DENSITY = 0.33
LINK_REST, LINK_REST_CHARS = 0.1, 8  # least share and size of the text outside links, in an article element

BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup
    option p pre section select summary table tbody td tfoot th thead title tr ul br
    """.split()
)
RAW_TAGS = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "object", "title")
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
EXCLUDING_TAGS = frozenset("nav header footer aside form menu button select dialog head".split())
# Words in class, id or role that mark a part as not the article.
EXCLUDING_WORDS = frozenset(
    """
    ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie
    cookies copyright disqus footer form header menu modal nav navbar navigation newsletter notice pager
    pagination popup promo promoted promotion related reply replies search share sharing sidebar social sponsor
    sponsored subscribe toolbar widget complementary contentinfo discussion paywall
    """.split()
)
# Those of them that mark a part whatever words stand beside them, and the words that take it back.
TELLING_WORDS = frozenset(
    """
    ad ads adv advert advertisement adverts breadcrumb breadcrumbs comment comments consent cookie cookies
    discussion disqus newsletter notice paywall popup promo replies sidebar sponsor sponsored
    """.split()
)
NEGATING_WORDS = frozenset(
    """
    closed disable disabled enabled free has have hide hides hiding less no non not off open show shows supports
    with without
    """.split()
)
# Words that may stand beside those in a token.
NEUTRAL_WORDS = frozenset(
    """
    area articles banners bar block body bottom box btn button buttons col column container content desktop frame
    global group holder icons inner item items left links list main mobile outer panel posts primary right
    secondary section signup site slot stories sub top unit wrap wrapper
    """.split()
)
UNNAMED_TAGS = frozenset("html body main article h1".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\"'>])*)(?:>|\Z)",
    re.S,
)
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW_TAGS}
LINK_TAG = re.compile(r"<(/?)a(?=[\s/>])", re.I)
HREF = re.compile(r"""(?:^|[\s"'/])href\s*=""", re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_WORDS = re.compile(r"[a-z]+")
QUOTED = re.compile(r"""\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)""")
HIDDEN = re.compile(r"(?:^|[\s/])hidden(?=[\s=/]|$)(?!\s*=\s*until-found)", re.I)
STYLE = re.compile(r"""(?:^|[\s"'/])style\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
UNSHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORDS = re.compile(r"[^\W\d_]+")
LATIN = re.compile(r"[a-z\u00aa\u00ba\u00c0-\u024f\u1e00-\u1eff]+", re.I)
SENTENCE_END = re.compile(r"[.!?\u2026](?=[\s\"'\u2019\u201d\u00bb)]|$)|[\u3002\uff01\uff1f\uff0e\u0964\u06d4\u061f\u0589\u1362\u17d4]")
# Block tags whose start ends an open paragraph, and those of which the next of the kind ends the one before.
ENDS_PARAGRAPH = BLOCK_TAGS - set("body br button caption head html legend optgroup option select summary title".split())
ENDS_ITS_KIND = frozenset("dd dt li option td th tr".split())


@dataclass(slots=True)
class Block:
    text: str
    linked: int  # characters of link text
    excluded: bool
    part: int  # innermost named part or form it is in, 0 for none
    article: int  # number of the article element it is in, 0 for none


def _names_exclude(attrs: str) -> bool:
    if not attrs or "=" not in attrs:
        return False
    return any(
        _excluding(CAMEL.sub(" ", token).lower())
        for m in NAMES.finditer(attrs)
        for token in (m[1] or m[2] or m[3] or "").split()
    )


def _excluding(token: str) -> bool:
    words = NAME_WORDS.findall(token)
    if any(w in TELLING_WORDS for w in words):
        return not any(w in NEGATING_WORDS for w in words)
    return any(w in EXCLUDING_WORDS for w in words) and all(
        w in EXCLUDING_WORDS or w in NEUTRAL_WORDS or len(w) == 1 for w in words
    )


def _hidden(attrs: str) -> bool:
    """Whether the element has ``hidden``, or a style that shows nothing of it."""
    if len(attrs) < 6:
        return False
    if HIDDEN.search(QUOTED.sub('""', attrs)):
        return True
    style = STYLE.search(attrs)
    return style is not None and UNSHOWN.search(style[1] or style[2] or style[3] or "") is not None


def blocks(page: str, parents: list[int]) -> Iterator[Block]:
    """The blocks of a page in order, empty ones left out; ``parents`` gets the part around each part."""
    parts: list[str] = []
    link_parts: list[str] = []
    stack: list[tuple[str, bool, bool, int, bool]] = []  # tag, excludes, opens an article, part around it, mutes
    excluded = articles = part = muted = 0
    inside: list[int] = []
    linked, link_end, link_depth = False, -1, 0  # where the link's end tag is, how deep the link stands
    unended: set[str] = set()  # tags of raw content that no end tag follows

    def close() -> Block | None:
        text = " ".join(html.unescape("".join(parts)).split())
        size = len(" ".join(html.unescape("".join(link_parts)).split())) if link_parts else 0
        parts.clear()
        link_parts.clear()
        return Block(text, size, excluded > 0, part, inside[-1] if inside else 0) if text else None

    def add(text: str) -> None:
        if muted:
            return
        parts.append(text)
        if linked:
            link_parts.append(text)

    def leave(opened: int) -> None:
        nonlocal excluded, part, muted, linked
        linked = linked and opened >= link_depth
        for _, excludes, article, _, mutes in stack[opened:]:
            excluded -= excludes
            muted -= mutes
            if article:
                inside.pop()
        part = stack[opened][3]
        del stack[opened:]

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag in BLOCK_TAGS or tag in RAW_END:
            if block := close():
                yield block
            linked = linked and link_end >= m.start()
        if m["end"]:
            opened = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag == "a":
                linked = False
            elif opened is not None:
                leave(opened)
        elif tag in RAW_END:
            if tag in ("script", "style") or not (m["attrs"].endswith("/") or tag in unended):
                if end := RAW_END[tag].search(page, at):
                    at = end.end()
                elif tag in ("script", "style"):
                    at = len(page)
                else:
                    unended.add(tag)
        elif tag == "a":
            linked, link_depth = bool(HREF.search(m["attrs"])) and not m["attrs"].endswith(" /"), len(stack)
            other = LINK_TAG.search(page, at) if linked else None
            link_end = other.start() if other and other[1] else -1
        elif tag not in VOID_TAGS and not m["attrs"].endswith("/"):
            if stack and (stack[-1][0] == "p" and tag in ENDS_PARAGRAPH or stack[-1][0] == tag in ENDS_ITS_KIND):
                leave(len(stack) - 1)
            article = tag in ("article", "main") and not excluded
            form = tag == "form" and not any(t == "article" for t, *_ in stack)
            excludes = tag in EXCLUDING_TAGS and not form and not (tag == "header" and inside)
            hidden = _hidden(m["attrs"])
            mutes = hidden and tag not in BLOCK_TAGS
            named = not (excludes or mutes) and (form or hidden or tag not in UNNAMED_TAGS and _names_exclude(m["attrs"]))
            if article:
                articles += 1
                inside.append(articles)
            if excludes or named or mutes or tag in BLOCK_TAGS:
                stack.append((tag, excludes, article, part, mutes))
                excluded += excludes
                muted += mutes
            if named:
                parents.append(part)
                part = len(parents) - 1
    if block := close():
        yield block


GOOD, BAD, OPEN, POOR = 1, 0, -1, -2


def first_pass(b: Block) -> int:
    """GOOD, BAD or OPEN from the block alone."""
    size, rest = len(b.text), len(b.text) - b.linked
    dense = b.linked > LINK_DENSITY * size
    if b.excluded or dense and not (b.article and rest > LINK_REST * size and rest >= LINK_REST_CHARS):
        return BAD
    if size < SHORT_CHARS:
        return OPEN
    words = WORDS.findall(b.text.lower())
    if 2 * sum(len(w) for w in words if LATIN.fullmatch(w)) < sum(map(len, words)):
        return _by_sentence(b.text)
    density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if density >= (HIGH_DENSITY if size < LONG_CHARS else LOW_DENSITY):
        return GOOD
    return OPEN if b.article or size < LONG_CHARS else POOR


def _by_sentence(text: str) -> int:
    return GOOD if SENTENCE_END.search(text) else OPEN


def judge_poor(found: list[Block], labels: list[int]) -> None:
    """Long blocks without stop words: boilerplate where the page has content in a known language."""
    known = GOOD in labels
    for i, label in enumerate(labels):
        if label == POOR:
            labels[i] = BAD if known else _by_sentence(found[i].text)


def exclude_parts(found: list[Block], labels: list[int], parents: list[int]) -> None:
    """Mark the blocks of named parts and forms as excluded, but for those that hold the page's text."""
    body = next((label for label in (GOOD, POOR) if label in labels), OPEN)
    held, in_article = [0] * len(parents), [0] * len(parents)
    for b, label in zip(found, labels):
        held[b.part] += label == body
        in_article[b.part] += label != BAD and b.article > 0
    for n in range(len(parents) - 1, 0, -1):
        held[parents[n]] += held[n]
        in_article[parents[n]] += in_article[n]
    drops = [False] * len(parents)
    for n in range(1, len(parents)):
        whole = 2 * held[n] > held[0] and (in_article[n] or not in_article[0])
        drops[n] = drops[parents[n]] or not whole
    for i, b in enumerate(found):
        if drops[b.part]:
            b.excluded, labels[i] = True, BAD


def second_pass(found: list[Block], labels: list[int]) -> list[int]:
    """Open blocks take the label of the nearest decided blocks in their stretch of the page."""
    bare = GOOD not in labels
    sides = []
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        side: list[tuple[int, int] | None] = [None] * len(found)  # label and distance of the decided neighbour
        seen, last = None, None
        for i in order:
            b = found[i]
            if b.excluded or last is None or b.article != last.article:
                seen = None
            side[i] = seen
            if labels[i] != OPEN and not b.excluded:
                seen = (labels[i], 1)
            elif seen:
                seen = (seen[0], seen[1] + 1)
            last = b
        sides.append(side)
    return [
        label if label != OPEN else _inherited(bare or bool(b.article), before, after)
        for b, label, before, after in zip(found, labels, *sides)
    ]


def _inherited(lone: bool, before: tuple[int, int] | None, after: tuple[int, int] | None) -> int:
    votes = [v for v in (before, after) if v]
    if not votes:
        return GOOD if lone else BAD
    nearest = min(distance for _, distance in votes)
    return GOOD if any(label == GOOD for label, distance in votes if distance == nearest) else BAD


def main_text(page: str | None) -> str:
    parents = [0]
    found = list(blocks(page or "", parents))
    labels = [first_pass(b) for b in found]
    exclude_parts(found, labels, parents)
    judge_poor(found, labels)
    labels = second_pass(found, labels)
    return " ".join(b.text for b, label in zip(found, labels) if label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p) for p in b.column("html").to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), sizes],
                ["page_id", "url", "text", "n_chars"],
            )

    narrow = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    return narrow.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
