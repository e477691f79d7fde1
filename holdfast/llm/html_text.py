"""Main text of web pages by two-pass block rules.

The markup is cut into blocks. Pass 1 decides blocks by their stop-word density, length and link density; pass 2 gives
each ambiguous block the label of its nearest decided neighbours. Parts that are beside the article are left out. A part
that is named as the article is a hint only: blocks in it are not bad for few stop words, and where an article element
stands, blocks outside it must be long to stand for themselves.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Function words of the languages served, elements, and names that sites give to parts of a page.
STOP_WORDS = {
    "en": "the of and to a in is it that for was on are as with be this by from or an at not have which you but we they his her their has",
    "de": "der die das und in zu den ist von mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei",
    "fr": "le la les de des du et en un une est que qui dans pour par sur pas au avec ce il ne se plus son aux ou sont cette",
    "es": "el la los las de del y en un una es que por con para no se su al lo como más o pero sus le ya este entre fue ha",
}
SKIPPED = "script style noscript template svg math iframe object canvas select button textarea head title audio video map datalist".split()
BLOCKS = (
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li "
    "main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption"
).split()
CONTAINERS = "article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol section table ul li td tr p h1 h2 h3 h4 h5 h6 span".split()
RAW = "script style textarea title".split()
SIDE_ELEMENTS = "nav footer aside form menu dialog fieldset".split()
SIDE_ROLES = "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split()
SIDE_NAMES = re.compile(
    r"(?:^|[^a-z])(?:(?:comment|disqus|repl(?:y|ies)|respond|cookie|consent|gdpr|notice|notification|banner|popup|modal|overlay|advert|sponsor|promo|sidebar|widget"
    r"|menu|navbar|navigation|breadcrumb|pagination|pager|masthead|footer|social|sharing|share|related|recommend|teaser|newsletter|subscri|signup|login|copyright"
    r"|disclaimer|hidden|toolbar|guestbook|discussion)\w*|(?:ads?|nav|skip|search|tags|meta|byline|legal|aside|sponsored|outbrain|taboola|alert|topbar|toc)(?![a-z]))")
HEADER_NAMES = re.compile(r"(?:^|[^a-z])(?:header|head|top)(?![a-z])")
#: Names of wrappers that tell where a sidebar stands, and of parts in which an article element is no article of the page.
LAYOUT_NAMES = re.compile(r"(?:^|[^a-z])(?:layout\w*|(?:with|has|left|right|two)[-_ ]?(?:sidebar|menu|nav)|(?:sidebar|menu|nav)[-_](?:left|right))(?![a-z])")
OTHER_TEXTS = re.compile(r"(?:^|[^a-z])(?:comment|disqus|repl(?:y|ies)|respond|related|recommend|teaser|guestbook|discussion|outbrain|taboola)")
#: Class names that tell what an article is about: what follows them names no part of the page.
SLUGS = re.compile(r"(?<!\S)(?:category|categories|tags?|topic|author|format|status|type|term|lang)[-_]\S+")
MAIN_NAMES = re.compile(r"(?:^|[^a-z])(?:article|articlebody|content|post|entry|story|main|maincontent|bodytext)(?![a-z])")

#: How far a part is beside the article: a form or a layout wrapper may hold the whole page, a part named so may hold an article.
WRAPPER, NAMED, CLEAR = 1, 2, 3

#: A page whose text has fewer stop words than this is in a language without a list; length and link density decide there.
UNKNOWN = 0.03

#: Limits of pass 1 (characters and shares). A block below SHORT is ambiguous, from LONG on it stands for itself.
SHORT, LONG, STOPS, MOST_LINKS = 70, 200, 0.15, 0.5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>\"[^\"]*\"|'[^']*'|[^'\">])*+>|[^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NEXT_BLOCK = re.compile(rf"(?=</?(?:{'|'.join(b for b in BLOCKS if b not in ('option', 'optgroup'))})\b)", re.I)
WORD = re.compile(r"[^\W\d_]+")
STOPS_OF_ALL = frozenset(w for line in STOP_WORDS.values() for w in line.split())


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    side: int  # inside a part that its markup names as no article: 0, WRAPPER, NAMED or CLEAR
    main: int  # number of the article container, 0 for none
    heading: bool
    element: bool = False  # the article container is one by element, role or property, not by its name alone
    label: str = ""


@dataclass
class Reader:
    """Cuts one page into blocks."""

    stack: list[tuple[str, int, int]] = field(default_factory=list)  # open containers: tag, side, main
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    links: int = 0
    in_link: bool = False
    mains: int = 0
    elements: set[int] = field(default_factory=set)
    heading: bool = False
    breaks: int = 0

    def read(self, page: str) -> list[Block]:
        at = 0
        while m := TOKEN.search(page, at):
            self.add(page[at : m.start()])
            at = m.end()
            if m["cdata"] is not None:
                self.add(m["cdata"])
            elif m["tag"]:
                tag = m["tag"].lower()
                if tag in SKIPPED:
                    if not m["close"] and not m["attrs"].endswith("/>"):
                        end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                        # a head that is never closed ends where the body begins
                        end = end or (tag == "head" and re.compile(r"(?=<body\b)", re.I).search(page, at)) or None
                        # another one without its end tag, unless it holds raw text, ends where the next block begins or ends
                        end = end or (tag not in RAW and NEXT_BLOCK.search(page, at)) or None
                        at = end.end() if end else len(page)
                    if tag not in ("button", "select", "svg", "math", "map"):
                        self.flush()
                elif m["close"]:
                    self.closed(tag)
                else:
                    self.opened(tag, m["attrs"])
        self.add(page[at:])
        self.flush()
        for b in self.blocks:
            b.element = b.main in self.elements
        return self.blocks

    def add(self, text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            self.parts.append(text)
            if text.strip():
                self.breaks = 0
            if self.in_link:
                self.links += len(" ".join(text.split()))

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, side, main = self.stack[-1] if self.stack else ("", 0, 0)
            self.blocks.append(Block(text, self.links, side, main, self.heading))
        self.parts, self.links, self.breaks = [], 0, 0

    def opened(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            self.breaks += 1
            if self.breaks > 1:
                self.flush()
        elif tag == "a":
            self.in_link = True
        if tag in BLOCKS:
            self.flush()
            self.in_link = False
            if tag in ("p", "li", "td", "tr", "h1", "h2", "h3", "h4", "h5", "h6"):
                self.ended(tag)
            if tag != "p" and self.stack and self.stack[-1][0] == "p":
                self.stack.pop()
            self.heading = tag[0] == "h" and tag[1:].isdigit()
        if tag in CONTAINERS and not attrs.endswith("/>"):
            self.stack.append((tag, *self.part(tag, attrs)))

    def closed(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if tag in BLOCKS:
            self.flush()
            self.heading = False
        if tag in CONTAINERS and any(t == tag for t, *_ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def ended(self, tag: str) -> None:
        """An element whose end tag may be missing ends where its next begins, inside the same list, table or section."""
        for i in range(len(self.stack) - 1, -1, -1):
            t = self.stack[i][0]
            if t == tag:
                del self.stack[i:]
                return
            if t not in ("p", "span") and not (tag in ("li", "td", "tr") and t in ("li", "td")):
                return

    def part(self, tag: str, attrs: str) -> tuple[int, int]:
        """How far the container is beside the article, and which article it belongs to."""
        _, side, main = self.stack[-1] if self.stack else ("", 0, 0)
        if side == CLEAR:
            return side, main
        values = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attrs)} if len(attrs) > 2 else {}
        name = SLUGS.sub("", f"{values.get('class', '')} {values.get('id', '')}")
        role = values.get("role", "")
        hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "")
        element = tag in ("article", "main") or role in ("main", "article") or "articlebody" in values.get("itemprop", "")
        named = SIDE_NAMES.search(name) or not main and (tag == "header" or tag != "article" and HEADER_NAMES.search(name))
        if hidden or tag in SIDE_ELEMENTS and tag not in ("form", "fieldset") or role in SIDE_ROLES or OTHER_TEXTS.search(name) and not element:
            return CLEAR, main
        if named and not LAYOUT_NAMES.search(name):
            return NAMED, main
        if named or tag in ("form", "fieldset"):
            return max(side, WRAPPER), main
        if side and (main or not element):
            return side, main
        if not main and (element or bool(MAIN_NAMES.search(name)) and tag in ("div", "section", "td")):
            self.mains += 1
            main = self.mains
        if main and element:
            self.elements.add(main)
        return 0, main


def stop_density(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOPS_OF_ALL for w in words) / len(words) if words else 0.0


def label(blocks: list[Block]) -> list[Block]:
    """Both passes: every block gets the label good or bad."""
    listed = stop_density(" ".join(b.text for b in blocks if b.links <= MOST_LINKS * len(b.text))) >= UNKNOWN

    def rich(b: Block) -> bool:
        return not listed or stop_density(b.text) >= STOPS

    element = any(b.element and not b.side for b in blocks)
    for b in blocks:
        density = b.links / len(b.text)
        if b.side:
            b.label = "outside"  # decided by markup; says nothing about its neighbours
        elif density > MOST_LINKS:
            b.label = "bad"
        elif len(b.text) < SHORT or b.heading:
            b.label = "short"
        elif rich(b):
            b.label = "good" if b.main or len(b.text) >= LONG or density < 0.2 and not element else "short"
        else:
            b.label = "short" if b.main else "bad"
    inner = [b for b in blocks if b.label != "outside"]
    decided = [i for i, b in enumerate(inner) if b.label in ("good", "bad")]
    # neighbours count inside the same article, and outside of article elements
    near_by: dict[int, list[int]] = {b.main: [] for b in inner}
    for k in decided:
        near_by[inner[k].main].append(k)
    if not element:
        near_by[0] = decided
    good_in = {m: any(inner[k].label == "good" for k in ks) for m, ks in near_by.items()}
    given = []
    for i, b in enumerate(inner):
        if b.label != "short":
            continue
        same = near_by[b.main]
        at = bisect_left(same, i)
        before, after = same[at - 1] if at else None, same[at] if at < len(same) else None
        if b.main and not good_in[b.main]:
            given.append((b, "good"))  # nothing but the container speaks
        elif before is None and after is None:
            given.append((b, "good" if not element and not decided and stop_density(b.text) > 0 and b.links == 0 else "bad"))
        elif before is None or after is None:
            given.append((b, inner[after if before is None else before].label))
        else:
            # the nearer one; a heading belongs to what follows, and of two as near the good one counts
            near = after if b.heading or after - i < i - before or (after - i == i - before and inner[after].label == "good") else before
            given.append((b, inner[near].label))
    for b, kind in given:
        b.label = kind
    # where nothing is left, a form or layout wrapper around the whole page is no side part, nor is a part for its name alone
    for far in (WRAPPER, NAMED):
        inside = [b for b in blocks if b.side == far]
        if not any(b.label == "good" for b in blocks) and any(len(b.text) >= LONG and rich(b) and b.links < 0.2 * len(b.text) for b in inside):
            for b in inside:
                b.side = 0
            return label(blocks)
    return blocks


def main_text(page: str) -> str:
    """The good blocks in page order, joined by empty lines."""
    return "\n\n".join(b.text for b in label(Reader().read(page)) if b.label == "good")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    A null or empty page has the empty text. Rows are independent: repeated rows, null ids or urls and other columns
    do no harm, an empty table gives an empty result, and a long page takes time and memory in proportion to its length.
    """

    @F.pandas_udf("string")
    def texts(html_: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) if h else "" for h in html_], dtype=object)

    rows = small_batches(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), texts(F.col(html_col).cast("string")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
