"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text of their blocks; from the best one the page climbs to the container that
also holds the title and lead beside it, and votes for the generalised path of that (tags with their classes, digits and positions left out). Votes are counted per host in Spark, and every
page is extracted again from the containers on its host's winning path. A page that has no text there uses its own best container.

What belongs to menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments is
left out by tag, role and class or id; a name counts if every word of it speaks for that, and ids of headings, paragraphs
and inline elements never count. Of an article's own header the headings stay. Character references are decoded, white space inside a block becomes one space, and
blocks are joined by line ends in page order.

A null or empty html gives an empty text; a null url has the empty host. Repeated rows are extracted each, null ids
stay null, an empty table gives no rows. Unclosed and stray tags are read as browsers do for blocks: a new paragraph,
list item or cell ends an open one, and an end tag without its start is ignored.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|title|annotation|object|video|audio|canvas)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<[!?/][^>]*>|<[a-zA-Z][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var "
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mspace mstyle semantics".split()
)
LEFT_OUT = frozenset("nav header footer aside form button menu dialog head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLASSES = frozenset(
    "ad ads advert advertisement advertising adverts sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer header masthead comment comments disqus replies cookie cookies consent gdpr notice notices alert popup modal overlay share sharing "
    "social related recommended newsletter subscribe signup login form search toolbar pager pagination widget".split()
)
GOOD = frozenset("article content post entry story main body text".split())
# words that only say where a part stands or how it looks
NEUTRAL = frozenset(
    "site page main global primary secondary top bottom left right inner outer list item items box area section wrapper wrap container block bar panel group "
    "row column link links button buttons icon icons default fixed sticky mobile desktop small large".split()
)
# parts of these names are left out even where they are called a story's or a post's
APART = frozenset("ad ads advert adverts sidebar aside nav navigation menu footer comment comments replies share sharing related pagination newsletter".split())
ENDS = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
SCOPE = {"li": frozenset(("ul", "ol", "menu")), "td": frozenset(("table",)), "th": frozenset(("table",)), "tr": frozenset(("table",)), "dt": frozenset(("dl",)), "dd": frozenset(("dl",))}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
TITLED = HEADINGS | INLINE | {"p", "li", "dt", "dd"}  # their ids are mostly made from titles
DECAY = 0.9
BONUS = 1.3


@dataclass
class Element:
    tag: str
    parent: int
    step: str
    out: bool  # left out by its tag or role
    out_by_class: bool
    good: bool
    holds_main: bool = False


@dataclass
class Page:
    """Elements and the text blocks with the element that holds each."""

    elements: list[Element] = field(default_factory=lambda: [Element("", -1, "", False, False, False)])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, characters in links

    def left_out(self) -> list[bool]:
        out = []
        for e in self.elements:
            own = e.out or (e.out_by_class and not e.holds_main)
            if e.tag in HEADINGS and e.parent > 0 and self.elements[e.parent].step.split(".")[0] == "header" and self._in_article(e.parent):
                out.append(out[self.elements[e.parent].parent])  # an article's heading may stand in its header
            else:
                out.append(own or (e.parent >= 0 and out[e.parent]))
        return out

    def _in_article(self, k: int) -> bool:
        while k > 0:
            if self.elements[k].tag in ("article", "main"):
                return True
            k = self.elements[k].parent
        return False

    def paths(self) -> list[str]:
        paths: list[str] = []
        for e in self.elements:
            paths.append(f"{paths[e.parent]}>{e.step}" if e.parent >= 0 else "")
        return paths


def is_apart(name: str) -> bool:
    """Does a class or id name a part beside the text? Every word of it must speak for that, so that titles used as ids do not."""
    words = re.findall(r"[a-z]+", name)
    if CLASSES.isdisjoint(words) or not all(w in CLASSES or w in NEUTRAL or w in GOOD for w in words):
        return False
    return words[0] not in GOOD - NEUTRAL or words[-1] in APART


def _element(tag: str, attributes: str, parent: int) -> Element:
    words: list[str] = []
    names: list[str] = []
    role = ""
    classes: list[str] = []
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            if name.lower() == "role":
                role = value.strip()
            else:
                words += re.findall(r"[a-z]+", value)
                if name.lower() == "class":
                    classes = value.split()
                    names += classes
                elif tag not in TITLED:
                    names += value.split()
    step = ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in classes})])
    plain = tag in ("html", "body", "main")
    return Element(
        tag, parent, step, not plain and (tag in LEFT_OUT or role in ROLES), not plain and any(map(is_apart, names)),
        tag in ("article", "main") or role in ("main", "article") or (not plain and not GOOD.isdisjoint(words)),
    )


def parse(source: str) -> Page:
    """Elements and blocks of a whole page."""
    page = Page()
    elements, stack = page.elements, [0]
    words: list[str] = []
    linked = 0
    block = 0  # innermost block-level element
    in_link = 0

    def flush():
        nonlocal words, linked
        if words:
            text = " ".join("".join(words).split())
            if text:
                page.blocks.append((block, text, linked))
            words, linked = [], 0

    def close(depth: int):
        nonlocal block, in_link
        if any(elements[k].tag not in INLINE for k in stack[depth:]):
            flush()
        in_link -= sum(elements[k].tag == "a" for k in stack[depth:])
        del stack[depth:]
        block = next(k for k in reversed(stack) if elements[k].tag not in INLINE)

    at = 0
    for token in TOKEN.finditer(source):
        if token.start() > at:
            text = html.unescape(source[at : token.start()])
            words.append(text)
            if in_link:
                linked += len(text)
        at = token.end()
        end, tag, attributes = token.group(2), token.group(3), token.group(4)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                words.append(" ")
            continue
        if end:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if elements[stack[d]].tag == tag), 0)
            if depth:
                close(depth)
            elif tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
            ended, scope = ENDS.get(tag, ()), SCOPE.get(tag, frozenset())
            for d in range(len(stack) - 1, 0, -1):
                own = elements[stack[d]].tag
                if own in ended or own == "p":  # any block ends an open paragraph
                    close(d)
                    break
                if own in scope or (not ended and own not in INLINE):
                    break
        elements.append(_element(tag, attributes, block))
        stack.append(len(elements) - 1)
        if tag in INLINE:
            in_link += tag == "a"
        else:
            block = stack[-1]
            if tag in ("article", "main") and not elements[block].out_by_class:
                k = elements[block].parent
                while k >= 0 and not elements[k].holds_main:
                    elements[k].holds_main = True
                    k = elements[k].parent
    if at < len(source):
        words.append(html.unescape(source[at:]))
    flush()
    return page


def best_container(page: Page, out: list[bool]) -> tuple[int, float]:
    """The element whose blocks score best, and its score: text outside links, less with every level between."""
    score = [0.0] * len(page.elements)
    for k, text, linked in page.blocks:
        if out[k]:
            continue
        value = max(0.0, len(text) - 2.0 * linked)
        # a paragraph is no container: its text counts in full for the element that holds it
        k = page.elements[k].parent if page.elements[k].tag in ("p", "li", "td", "th", "tr", "dt", "dd", *HEADINGS) and page.elements[k].parent >= 0 else k
        while k >= 0:
            score[k] += value
            value *= DECAY
            k = page.elements[k].parent
    best = max(range(len(score)), key=lambda k: (score[k] * (BONUS if page.elements[k].good else 1.0), k))
    return best, score[best]


def whole_container(page: Page, out: list[bool], best: int) -> int:
    """The element around ``best`` that also holds the title and lead beside it.

    That is the nearest article or main around it. From there (up to a main around it), or from ``best`` where there is
    none, it goes on to each ancestor that has text of its own, and whose further text is not mostly links.
    """
    elements = page.elements
    chain = [best]
    while elements[chain[-1]].parent >= 0:
        chain.append(elements[chain[-1]].parent)
    at = next((d for d, k in enumerate(chain) if elements[k].tag in ("article", "main") and not out[k]), -1)
    top = len(chain) - 1
    if at >= 0:
        top = next((d for d in range(at, len(chain)) if elements[chain[d]].tag == "main"), at)
    at = max(at, 0)
    levels = {k: d for d, k in enumerate(chain)}
    chars, links, direct = [0] * len(chain), [0] * len(chain), [False] * len(chain)
    for k, text, linked in page.blocks:
        if out[k]:
            continue
        owner = elements[k].parent if elements[k].tag in ("p", *HEADINGS) and k not in levels else k
        while k not in levels:
            k = elements[k].parent
        d = levels[k]
        chars[d], links[d], direct[d] = chars[d] + len(text), links[d] + linked, direct[d] or owner == chain[d]
    for d in range(at + 1, top + 1):
        if chars[d] and (not direct[d] or 2 * links[d] > chars[d]):
            break
        if chars[d]:
            at = d
    return chain[at]


def _within(page: Page, chosen: set[int]) -> list[bool]:
    inside: list[bool] = []
    for k, e in enumerate(page.elements):
        inside.append(k in chosen or (e.parent >= 0 and inside[e.parent]))
    return inside


def extract(source: str | None, path: str | None) -> str:
    """Text of the containers on a path, or of the page's best container where they have none."""
    if not source:
        return ""
    page = parse(source)
    out = page.left_out()
    chosen = {k for k, p in enumerate(page.paths()) if p == path}
    for _ in range(2):
        inside = _within(page, chosen)
        text = "\n".join(t for k, t, _ in page.blocks if inside[k] and not out[k])
        if text:
            return text
        chosen = {whole_container(page, out, best_container(page, out)[0])}
    return ""


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes, score): how many pages of a host have their best container on a path."""

    def run(batches):
        for batch in batches:
            paths, scores = [], []
            for source in batch.column(1).to_pylist():
                page = parse(source or "")
                out = page.left_out()
                best, score = best_container(page, out)
                paths.append(page.paths()[whole_container(page, out, best)] if score > 0 else None)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], names=["host", "path", "score"])

    found = pages.select(host_of(pages[url_col]).alias("host"), pages[html_col].alias("html")).mapInArrow(run, "host string, path string, score double")
    return found.filter("path IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum(F.round("score").cast("long")).alias("score"))


def winners(counted: DataFrame) -> DataFrame:
    """(host, path): the path with most votes of each host; of equal ones that with the higher score, then the longer path."""
    return counted.groupBy("host").agg(F.max_by("path", F.struct("votes", "score", F.length("path"), "path")).alias("path"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text and n_chars."""
    paths = winners(votes(pages, url_col, html_col))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(source, path) for source, path in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"), host_of(pages[url_col]).alias("host"))
    joined = rows.join(paths, "host", "left").select("page_id", "url", "html", "path")
    id_type = pages.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
