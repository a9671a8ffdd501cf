"""Main text of web pages by tree scoring.

Paragraphs give points to the elements that hold them: for their length and
their commas, all of them to the parent and a share that falls with the distance
to further ancestors. An element's points are discounted by the share of its
text that is in links. The best element and those of its siblings that score
well, or are plainly prose, are the main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points: one for a paragraph, one for each comma, one for each ``CHARS`` characters, ``MOST`` for length at most.
CHARS, MOST = 100, 3
#: Paragraphs of fewer characters give no points; share of the best score from which a sibling is kept; link share up to which prose is.
LEAST, SIBLING, LINKED = 25, 0.2, 0.25
#: Link share from which a list or container inside of the main text is left out.
PRUNED = 0.7
#: Elements whose class or id has a listed word among others are hidden only while what is shown has this share of the page's points or characters.
SHOWN = 0.1

# Element names by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
DROPPED = RAW | frozenset("head nav footer aside form button select option svg canvas object audio video dialog menu fieldset".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
LISTS = frozenset("ul ol dl div section table".split())
PARAGRAPH = frozenset("p pre td blockquote div section article li dd".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag in the first column ends open elements of the second.
CLOSES = {name: frozenset(["p"]) for name in BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}} | {
    "li": frozenset(["li", "p"]), "dd": frozenset(["dd", "dt", "p"]), "dt": frozenset(["dd", "dt", "p"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]),
    "tbody": frozenset(["tr", "td", "th", "p", "thead", "tbody"]), "body": frozenset(["head"]),
}
#: Elements whose inside doesn't reach out for what it ends.
SCOPE = frozenset("table ul ol dl div section article aside nav header footer form main body html blockquote figure td th button".split())
#: Class and id words of what is not the article.
_WORDS = r"(ads?|adverts?|advertisement|banner|breadcrumbs?|byline-share|comments?|comment-list|consent|cookies?|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promo|related|recommended|replies|reply|respond|share|sharing|sidebar|signup|social|sponsor(ed)?|subscribe|toolbar|widget)s?"
_UNLIKELY = re.compile(rf"(?i)(^|[\s_-]){_WORDS}($|[\s_-])")
_ALONE = re.compile(rf"(?i)(^|\s){_WORDS}($|\s)")
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|/([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")


class Node:
    """An element: its name, parent, and children (elements and pieces of text)."""

    __slots__ = ("name", "parent", "parts", "points", "hidden", "doubt", "own", "size", "chars", "linked", "commas", "inside")

    def __init__(self, name: str, parent: Node | None, hidden: bool = False, doubt: int = 0):
        self.name, self.parent, self.hidden, self.doubt = name, parent, hidden, doubt
        self.parts: list[Node | str] = []
        self.points = self.own = 0.0
        #: Whether it is an article (or main element) or in one.
        self.inside: bool = name in ("article", "main") or parent is not None and parent.inside
        self.size = self.chars = self.linked = self.commas = 0


def _hidden(name: str, attributes: str, inside_article: bool) -> bool:
    if name in DROPPED or name == "header" and not inside_article:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value.lower() in _ROLES:
            return True
        if key == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _doubt(name: str, attributes: str) -> int:
    """2 if a class or id is a word of what is not the article, 1 if it has one among others, 0 otherwise."""
    if not attributes or name in ("html", "body", "article", "main"):
        return 0
    values = [a or b or c for key, a, b, c in _ATTRIBUTE.findall(attributes) if key.lower() in ("class", "id")]
    return 2 if any(map(_ALONE.search, values)) else 1 if any(map(_UNLIKELY.search, values)) else 0


def parse(page: str) -> Node:
    """The page's tree. Unclosed and crossed elements end as browsers end them; an end of the page ends all."""
    root = node = Node("#root", None)
    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            node.parts.append(page[at:])
            break
        if m.start() > at:
            node.parts.append(page[at : m.start()])
        at = m.end()
        if m[1]:
            name, up = m[1].lower(), node
            while up is not root and up.name != name:
                # An end tag of text markup doesn't end the block that it is in.
                up = root if name not in BLOCK and up.name in BLOCK else up.parent
            if up is not root:
                node = up.parent
        elif m[2]:
            name = m[2].lower()
            ended = CLOSES.get(name)
            if ended:
                # Text markup that was left open ends with its paragraph.
                up = node
                while up is not root and up.name not in SCOPE:
                    if up.name in ended:
                        node = up.parent
                        break
                    up = up.parent
                else:
                    if up.name in ended:
                        node = up.parent
            child = Node(name, node, _hidden(name, m[3], node.inside), _doubt(name, m[3]))
            node.parts.append(child)
            if name in RAW:
                end = re.compile(f"(?i)</{re.escape(name)}(?=[\\s/>])").search(page, at)
                at = end.start() if end else len(page)
                close = page.find(">", at)
                at = close + 1 if end and close >= 0 else len(page)
            elif name not in VOID:  # a slash at the end of a tag says nothing in HTML
                node = child
    return root


def _text(piece: str) -> str:
    return html.unescape(piece) if "&" in piece else piece


def _measure(root: Node) -> list[Node]:
    """Give all elements their sizes, and paragraphs' ancestors their points; elements in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.points = node.own = 0.0
        node.chars = node.linked = node.commas = 0
        order.append(node)
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node) and not p.hidden)
    for node in reversed(order):
        own = "".join(_text(p) for p in node.parts if isinstance(p, str))
        node.size = len(_SPACE.sub(" ", own).strip())
        node.chars += node.size
        node.commas += own.count(",") + own.count("，") + own.count("、")
        if node.name == "a":
            node.linked = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            # A paragraph's commas include those of its markup, but not those of blocks inside.
            if node.name not in BLOCK:
                node.parent.commas += node.commas
    for node in order:
        plain = node.name in PARAGRAPH and not any(isinstance(p, Node) and p.name in PARAGRAPH and not p.hidden for p in node.parts)
        if plain and node.chars >= LEAST:
            node.own = 1.0 + node.commas + min(node.chars // CHARS, MOST)
    # All of a paragraph's points go to its parent and half of what an element has to the next one up, in one pass.
    for node in reversed(order):
        if node.parent is not None:
            node.parent.points += node.own + node.points / 2
    return order


def _hide_doubted(root: Node) -> list[Node]:
    """Hide elements by their class words, but not those that hold nearly all of the page's points; what :func:`_measure` gives then.

    The one that shows the most is opened first, one whose class is such a word alone only if nothing else is shown.
    """
    order = _measure(root)
    if not any(node.doubt for node in order):
        return order
    closed = {id(node) for node in order if node.doubt}
    total = sum(node.own for node in order)
    while total:
        # Points by the outermost closed element that they are in, without those of further ones inside.
        shown, chars, outer, inside = 0.0, 0, {}, {}
        for node in order:
            above = outer[id(node.parent)] if node.parent is not None else ()
            outer[id(node)] = above = (*above, node) if id(node) in closed and len(above) < 2 else above
            if not above:
                shown += node.own
                chars += node.size
            elif len(above) == 1:
                inside[id(above[0])] = inside.get(id(above[0]), 0.0) + node.own
        if shown >= SHOWN * total or chars >= SHOWN * root.chars:
            break
        first = {id(above[0]): above[0] for above in outer.values() if above}
        some = [node for node in first.values() if node.doubt == 1] or ([] if chars else list(first.values()))
        if not some:
            break
        closed.remove(id(max(some, key=lambda node: inside.get(id(node), 0.0))))
    for node in order:
        node.hidden = node.hidden or id(node) in closed
    return _measure(root)


def _score(node: Node) -> float:
    return node.points * (1 - node.linked / node.chars) if node.chars else 0.0


def _mostly_links(node: Node) -> bool:
    """Whether an element inside the main text is a list of links to elsewhere."""
    return node.name in LISTS and node.linked > PRUNED * node.chars


def _blocks(node: Node) -> Iterator[str]:
    """The texts of the blocks below an element, in page order."""
    pieces: list[str] = []
    stack: list[Node | str | None] = [node]
    while stack:
        part = stack.pop()
        if part is None:
            text = _SPACE.sub(" ", "".join(pieces)).strip()
            pieces.clear()
            if text:
                yield text
        elif isinstance(part, str):
            pieces.append(_text(part))
        elif not part.hidden and not (part is not node and _mostly_links(part)):
            if part.name == "br":
                pieces.append(" ")
            elif part.name in BLOCK or part is node:
                stack += [None, *reversed(part.parts), None]
            else:
                stack.extend(reversed(part.parts))
    text = _SPACE.sub(" ", "".join(pieces)).strip()
    if text:
        yield text


def extract(page: str | None) -> str:
    """The main text of a page's html: blocks joined by line feeds; empty if there is none (or the html is null)."""
    if not page:
        return ""
    root = parse(page)
    order = _hide_doubted(root)
    holders = [n for n in order if n.points > 0 and n.name != "#root"] or [n for n in order if n.points > 0]
    best = max(holders, key=_score, default=None)
    if best is None or _score(best) <= 0:
        # No paragraphs: all that is shown, unless it is mostly links.
        return "\n".join(_blocks(root)) if root.chars > 2 * root.linked else ""
    if best.parent is None:
        kept = [best]
    else:
        kept = []
        for part in best.parent.parts:
            if not isinstance(part, Node) or part.hidden:
                continue
            share = part.linked / part.chars if part.chars else 1.0
            prose = part.name in ("p", "pre", "blockquote") and (part.chars > 80 and share < LINKED or 0 < part.chars <= 80 and share == 0)
            if part is best or _score(part) >= SIBLING * _score(best) or prose or part.name in HEADING and share < LINKED:
                kept.append(part)
    return "\n".join(block for part in kept for block in _blocks(part))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html, ...).

    A null html gives an empty text. Repeated rows are extracted each, ids and
    urls are passed on as they are, other columns are ignored, and an empty table
    gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(h if isinstance(h, str) else None) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
