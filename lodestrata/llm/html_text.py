"""Main text of web pages by line-block distribution.

Markup is stripped: each block of a page becomes a line, with the place that it had (inside an article or main element,
inside a menu, an advert and so on) and the share of its text that is link text. Lines that markup shows to be no content
go. The text lengths of the others (none for a line of links) are summed over sliding windows of WINDOW lines; text
surges where a window's sum reaches a threshold and dives where a window holds nothing, and the lines between are kept, from
the first surge to the last dive but for windows that hold nothing.

What the page calls an article, or its main element if that has much of the text, is a weight in this: its lines weigh
SURGE times their length, so any text surges there. A line elsewhere takes part if it is as long as such lines are in the
middle, and SURGE characters at least; shorter ones are no text of this page. Pages that call nothing so weigh all lines
alike. So a line of links goes where it is one of WINDOW or more in a row that no heading and no colon leads in, or before
the first or after the last text of a page without an article.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import ship, table
from lodestrata.llm.words import lean, slices

#: Lines of a window, and characters in a window at which text surges.
WINDOW, SURGE = 3, 80
#: Share of a line's text in links from which the line counts as a menu.
LINKED = 0.6
# Fixed lists of elements.
BLOCKS = frozenset(
    "address article aside blockquote body center caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea select object canvas audio video title".split())
DROPPED = frozenset("head nav aside form button dialog menu label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"caption", "tbody", "tfoot", "thead", "tr", "title"}
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""")
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
NO_CONTENT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notices?|notification|alert|modal|"
    r"popup|overlay|newsletter|subscribe|subscription|signup|sidebar|widget|related|recommend(?:ed|ations)?|share|sharing|social|breadcrumbs?|menu|nav|navbar|"
    r"navigation|toolbar|pagination|pager|footer|comments?|commentlist|comment-?list|disqus|discussion|replies|respond|responses|login|search|skip|complementary|"
    r"contentinfo|dialog|disclaimer|paywall|masthead)(?:$|[\s_\d-])",
    re.I,
)
#: Inside an article such words count only as whole names, or beside a word for a box of them; others are what its text is about.
BOXES = r"(?:bars?|box|boxes|lists?|links?|buttons?|icons?|widgets?|area|forms?|section|block|container|wrapper|wrap|panel|posts?|articles?|stories|items?|menu|nav|tools|threads?|counts?|feed|slot|unit|text|content|message|placeholder|news|grid|row|inner|outer|meta|entry|page|site|article|main|js|google|top|bottom|side|inline|sticky|floating|mobile|desktop|left|right|header|head|\d+)"
WEAK = re.compile(r"^(?:related|search|discussion|skip|header|alert|notification|banner|widget|replies|responses)$", re.I)
HERE = re.compile(r"^(?:related|widget|alert|banner|notification)$", re.I)
#: Elements whose ids are places to link to, not names of what they hold.
PLACES = frozenset("h1 h2 h3 h4 h5 h6 p section li dt dd blockquote pre figure table article details".split())
ID = re.compile(r"""\bid\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
LED = re.compile(r"[:\uff1a]\s*$")
HEADER = re.compile(r"(?:^|[\s_-])(?:header|banner|topbar)(?:$|[\s_-])", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post|entry|story|content|main)(?:[_-]?(?:body|content|text))?(?:$|[\s_-])", re.I)


def names_of(name: str, rest: str) -> str:
    """Classes, roles and, where it isn't a mere place, the id of an element."""
    rest = ID.sub(" ", rest) if name in PLACES else rest
    return " ".join(x for t in NAMES.findall(rest) for x in t if x)


def no_part(names: str) -> bool:
    """Whether names inside an article say that an element is no part of its text: a name that is such a word, or joins it
    with words for boxes only."""
    for token in names.split():
        words = [x for x in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", token) if x]
        noise = [x for x in words if NO_CONTENT.search(x)] or ([token] if NO_CONTENT.fullmatch(token) else [])
        if not noise:
            continue
        if len(words) == 1:
            if not WEAK.match(token) or HERE.match(token):
                return True
        elif all(x in noise or re.fullmatch(BOXES, x, re.I) for x in words):
            return True
    return False


class _Line:
    __slots__ = ("text", "linked", "drop", "article", "main", "heading")

    def __init__(self, text: str, linked: int, drop: bool, article: int, main: int, heading: bool):
        self.text, self.linked, self.drop, self.article, self.main, self.heading = text, linked, drop, article, main, heading


def lines_of(html: str) -> list[_Line]:
    """The page's blocks in order; article and main number the outermost such element around a block (0: none)."""
    lines: list[_Line] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, int, int]] = []  # name, dropped, article, main
    drop, article, main, counted = False, 0, 0, 0
    open_: Counter[str] = Counter()  # elements on the stack, by name
    anchors = headings = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                heading = bool(headings)
                lines.append(_Line(text, 0 if heading and article else linked, drop, article, main, heading))  # a title that is a link is no menu
            parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal drop, article, main, anchors, headings
        gone = [x[0] for x in stack[to:]]
        if any(x in BLOCKS for x in gone):
            flush()
        del stack[to:]
        drop, article, main = stack[-1][1:] if stack else (False, 0, 0)
        for x in gone:
            open_[x] -= 1
            anchors -= x == "a"
            headings -= x in HEADINGS

    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            text = html[at:lt]
            parts.append(text)
            if anchors:
                linked += len(text.strip())
        if lt == end:
            break
        if html.startswith("<!--", lt):
            to = html.find("-->", lt + 4)
            at = end if to < 0 else to + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            to = html.find(">", lt)
            at = end if to < 0 else to + 1
            continue
        m = TAG.match(html, lt) or LOOSE.match(html, lt)
        if not m:
            if re.match(r"</?(?:[A-Za-z]|$)", html[lt : lt + 3]):  # a tag that the page's end cuts
                break
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        closing, name, rest = m[1], m[2].lower(), m[3]
        if closing:
            if name == "br":
                parts.append(" ")
            if open_[name]:  # else the whole stack would be looked through in vain
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                pop(i)
            elif name in BLOCKS:
                flush()
            continue
        if name in RAW:
            if name == "title":
                flush()
            if name not in ("svg", "math") or not rest.rstrip().endswith("/"):  # no other element closes itself
                to = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                at = to.end() if to else end
            continue
        if name in VOID:
            parts.append(" ") if name in ("br", "img", "wbr") else flush() if name == "hr" else None
            continue
        if name in ("td", "th"):
            parts.append(" ")
        if name in BLOCKS:
            # End tags that a start tag implies.
            own = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",)}.get(name, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in own or stack[i][0] == "p" and name in CLOSES_P:
                    pop(i)
                    break
                if stack[i][0] in BLOCKS and stack[i][0] != "p":
                    break
            flush()
        names = names_of(name, rest) if rest else ""
        root = name in ("html", "body", "article", "main")
        drop = drop or name in DROPPED or bool(rest and HIDDEN.search(rest)) or name == "footer" or name == "header" and not article
        if names and not drop and name not in ("html", "body", "main"):
            if article:
                drop = no_part(names)
            else:
                drop = bool(NO_CONTENT.search(names)) or not root and bool(HEADER.search(names))
        if not drop:
            counted += 1
            if name == "article" and not article:
                article = counted
            if not main and (name == "main" or "main" in names.split() or "articleBody" in rest or name in ("div", "section") and names and CONTENT.search(names)):
                main = counted
        open_[name] += 1
        anchors += name == "a"
        headings += name in HEADINGS
        stack.append((name, drop, article, main))
    flush()
    return lines


def text_ranges(lengths: list[int], least: int) -> list[tuple[int, int]]:
    """First line and line after the last of each stretch between a surge and a dive (WINDOW lines without text)."""
    n = len(lengths)
    sums = [sum(lengths[i : i + WINDOW]) for i in range(n)]
    found, i = [], 0
    while i < n:
        if not sums[i]:
            while i < n and not lengths[i]:
                i += 1
        elif sums[i] < least:
            i += 1
        else:
            a = i
            while i < n and (sums[i] or i + WINDOW > n):
                i += 1
            found.append((a, i))
    return found


def main_text(html: str | None) -> str:
    """The page's main text: blocks joined by line feeds, empty if there is none."""
    lines = [x for x in lines_of(html or "") if not x.drop]
    article = any(x.article for x in lines)
    size: dict[int, int] = {}
    for x in lines:
        if x.main:
            size[x.main] = size.get(x.main, 0) + len(x.text)
    best = max(size, key=lambda k: (size[k], -k), default=0)
    main = best if size and size[best] >= 0.4 * sum(len(x.text) for x in lines) else 0
    inside = [bool(x.article) if article else x.main == main if main else False for x in lines]
    return "\n".join(lines[i].text for i in kept(own_text(lines), inside, article))


def own_text(lines: list[_Line]) -> list[int]:
    """Each line's text that isn't links: none of a line of links, unless a heading or a colon leads its list in."""
    out: list[int] = []
    led = False
    for i, x in enumerate(lines):
        links = x.linked >= LINKED * len(x.text)
        if not links:
            led = bool(x.article and (x.heading and i and lines[i - 1].article == x.article or LED.search(x.text)))
        out.append(len(x.text) if not links or led else 0)
    return out


def kept(own: list[int], inside: list[bool], article: bool) -> list[int]:
    """The places of the lines that are main text, by their lengths (own) and whether markup calls them so (inside)."""
    marked = sorted(n for n, i in zip(own, inside) if i and n)
    typical = max(SURGE, marked[len(marked) // 2]) if marked else 0
    alike = not any(inside)
    place = [k for k, n in enumerate(own) if inside[k] or alike or n >= typical and marked]
    weight = [own[k] * (SURGE if inside[k] else 1) for k in place]
    surged, found = text_ranges(weight, SURGE), text_ranges(weight, 1)
    if surged:  # from the first surge to the last dive
        found = [(max(a, surged[0][0]), b) for a, b in found if b > surged[0][0] and a < surged[-1][1]]
    if article:  # lines of links at both ends too, and all lines where no text surges
        return [place[i] for a, b in found or [(0, len(place))] for i in range(a, b)]
    text = [i for a, b in found for i in range(a, b) if weight[i]]
    return [place[i] for a, b in found for i in range(a, b) if text[0] <= i <= text[-1]] if text else []


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id long, url string, html string).

    Character references are decoded, white space inside a block is one space, blocks are joined by one line feed. A
    null or empty page has an empty text. Rows that repeat are returned each; page_id and url may be null and are passed
    on. Other columns are ignored.
    """
    ship(pages.sparkSession)

    def run(batches):
        for b in slices(batches):
            found = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.record_batch({
                "page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(found, pa.string()), "n_chars": pa.array([len(t) for t in found], pa.int64()),
            })

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
