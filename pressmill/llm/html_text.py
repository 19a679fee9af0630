"""Main text of web pages by tree scoring.

The page becomes a tree. Every block with text of its own passes points for
its length and commas to its ancestors, the parent most; an ancestor's points
are discounted by its link density. The best container is kept, and on the way
up from it, to the outermost article or main or else to the body, those
siblings that are text by their own length and link density; inside of an
article or main only link lists go. Further articles beside the best one stay by
their own score.

Navigation, scripts and controls are left out by element. Forms, and elements
whose whole names say notice, advert, sidebar or comments, are suspects: a
suspect goes unless it holds the page's text itself. Lists of siblings of one
kind that each name a reader are comments whatever they are called.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
DROPPED = frozenset(
    "script style noscript template head nav footer aside button select textarea input iframe object embed svg canvas "
    "dialog menu audio video map".split()
)
#: Start tags that end an open element of the same kind, and what bounds the search for it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Names of what is no article text. A name of several parts counts only if each part is one of these or a plain word of layout.
COMMENTS = frozenset("comment comments commentlist disqus respond responses reply replies discussion discussions".split())
NOTICES = frozenset(
    "ad ads advert adverts advertisement advertising banner cookie cookies consent notice popup modal newsletter related recommended "
    "sidebar breadcrumb breadcrumbs menu nav navbar navigation footer masthead login signup pagination pager".split()
)
#: Names that also stand for layout, so that such an element may hold the article.
ROOMY = frozenset("widget promo sponsor sponsored share sharing social subscribe toolbar".split())
LAYOUT = frozenset(
    "area bar block body bottom box button buttons col column container content form group header icon icons inner item items layer left "
    "link links list main media message outer overlay page panel policy post posts right row section site slot stories text thread top unit "
    "us user reader wrap wrapper".split()
)
#: What marks the writer of one comment among several.
READERS = frozenset("author avatar user username commenter nick nickname reply reader".split())
FAVOURED = {"article": 25.0, "main": 15.0}
SIBLING_SHARE = 0.2
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that count as text without a sentence's end.
PARTS = frozenset("ul ol dl section blockquote pre table figure".split())
TEXT_CHARS = 80
SENTENCE_END = re.compile(r"[.!?\u2026\u3002\uff01\uff1f\u061f\u0964][\"'\u201d\u2019\u00bb)\]]*$")


class Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "suspect", "names", "reader", "points", "text_chars", "link_chars")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, suspect: str = "", names: str = ""):
        self.tag, self.parent, self.parts = tag, parent, []
        self.suspect, self.names = suspect, names
        self.reader = bool(READERS & set(names.lower().split()))
        self.dropped = dropped or (parent is not None and parent.dropped)
        self.points, self.text_chars, self.link_chars = FAVOURED.get(tag, 0.0), 0, 0


@lru_cache(4096)
def suspicion(names: str) -> str:
    """comments, notice or roomy where an element's names say so, else nothing."""
    found = set()
    for name in names.lower().split():
        parts = [p for p in re.split(r"[-_]+", name) if p and not p.isdigit()]
        kinds = [("comments", COMMENTS), ("notice", NOTICES), ("roomy", ROOMY)]
        known = [next((k for k, words in kinds if p in words), "layout" if p in LAYOUT else None) for p in parts]
        if None not in known:
            found |= {k for k in known if k != "layout"}
    return next((k for k in ("comments", "notice", "roomy") if k in found), "")


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#root", None, False)
        self.nodes = [self.root]
        self.open: Counter = Counter()  # tags of the elements from the root to now, so that a stray end tag costs one look

    def _to(self, node: Node) -> None:
        """Closes all elements inside ``node``."""
        while self.now is not node:
            self.open[self.now.tag] -= 1
            self.now = self.now.parent

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self._close(("p",), ("#root", "table", "ul", "ol", "dl", "blockquote", "div", "article", "section", "td", "th", "li"))
        if tag in CLOSES:
            self._close(CLOSES[tag], BOUNDS[tag])
        given = {k: v or "" for k, v in attrs}
        names = f"{given.get('class', '')} {given.get('id', '')} {given.get('role', '')}".strip()
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
        suspect = "" if tag in ("html", "body", "article", "main") or not names else suspicion(names)
        header = tag == "header" and not self.open["article"] and not self.open["main"]
        node = Node(tag, self.now, tag in DROPPED or hidden or header, suspect or ("roomy" if tag == "form" else ""), names)
        self.now.parts.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.now = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.now.tag == tag and tag not in ("div", "p", "span", "a", "article", "section"):
            self._to(self.now.parent)

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        node = self.now
        while node.tag != tag:
            node = node.parent
        self._to(node.parent)

    def handle_data(self, data):
        self.now.parts.append(data)

    def _close(self, tags, bounds):
        if not any(self.open[t] for t in tags):
            return
        node = self.now
        while node.parent is not None and node.tag not in bounds:
            if node.tag in tags:
                self._to(node.parent)
                return
            node = node.parent


def _judge(tree: _Tree) -> None:
    """Drops suspects and lists of comments, but for those that hold the page's own text."""
    plain, holds, inside = {}, set(), set()  # characters outside links; nodes that hold, and that are inside of, an article or main with text
    for node in reversed(tree.nodes):
        chars = 0
        for part in node.parts:
            if isinstance(part, str):
                chars += len(part.strip())
            elif not part.dropped:
                chars += plain[part]
                node.reader = node.reader or part.reader
                if part in holds:
                    holds.add(node)
        plain[node] = 0 if node.tag == "a" else chars
        if node.tag in FAVOURED and plain[node] and not node.dropped:
            holds.add(node)
    whole = plain[tree.root]
    for node in tree.nodes:
        alike: dict = {}
        for part in node.parts:
            if isinstance(part, Node) and not part.dropped and part.reader and plain[part] and part.tag not in INLINE and part.tag not in HEADINGS:
                alike.setdefault((part.tag, part.names), []).append(part)
        for same in alike.values():
            size = sum(plain[x] for x in same)
            if len(same) > 1 and whole - size >= TEXT_CHARS:
                for x in same:
                    x.suspect = "comments"
    for node in tree.nodes:
        if node.parent is not None and (node.parent.tag in FAVOURED or node.parent in inside):
            inside.add(node)
        if node.parent is not None and node.parent.dropped:
            node.dropped = True
        elif node.suspect and not node.dropped:
            rest = whole - plain[node]
            beside = tree.root in holds and node not in holds and node not in inside
            if node.suspect == "roomy":
                node.dropped = beside or plain[node] <= rest
            else:
                node.dropped = beside or rest >= min(TEXT_CHARS, plain[node] / 4)


def _score(tree: _Tree) -> None:
    for node in reversed(tree.nodes):  # children stand after their parents
        own = 0
        for part in node.parts:
            if isinstance(part, str):
                own += len(part.strip())
            elif not part.dropped:
                node.text_chars += part.text_chars
                node.link_chars += part.link_chars
        node.text_chars += own
        if node.tag == "a":
            node.link_chars = node.text_chars
    for node in tree.nodes:
        if node.dropped or node.tag in INLINE or node.tag == "#root":
            continue
        words = [p if isinstance(p, str) else "" for p in node.parts]
        inline = sum(p.text_chars for p in node.parts if not isinstance(p, str) and p.tag in INLINE and not p.dropped)
        length = sum(len(w.strip()) for w in words) + inline
        if not length:
            continue
        points = 1.0 + min(length / 100.0, 3.0) + sum(w.count(",") for w in words)
        points *= 1.0 - node.link_chars / max(node.text_chars, 1)
        up, level = node.parent, 0
        while up is not None and level < 4:
            up.points += points / (1, 2, 6, 9)[level]
            up, level = up.parent, level + 1


def _value(node: Node) -> float:
    return node.points * (1.0 - node.link_chars / max(node.text_chars, 1))


def _blocks(nodes: list) -> list[str]:
    """Text of each block of nodes and loose text in page order, white space made single; None ends a block."""
    blocks, now = [], []

    def end():
        text = " ".join("".join(now).split())
        if text:
            blocks.append(text)
        now.clear()

    stack: list = list(reversed(nodes))
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            now.append(item)
        elif not item.dropped:
            if item.tag in ("br", "wbr", "img"):
                now.append(" " if item.tag == "br" else "")
                continue
            if item.tag not in INLINE:
                end()
                stack.append(None)
            stack.extend(reversed(item.parts))
    end()
    return blocks


def _is_text(run: list, inside: bool, least: float) -> bool:
    """Whether a sibling (one block, or a run of loose text and inline elements) belongs to the main text."""
    nodes = [n for n in run if isinstance(n, Node) and not n.dropped]
    chars = sum(n.text_chars for n in nodes) + sum(len(t.strip()) for t in run if isinstance(t, str))
    links = sum(n.link_chars for n in nodes)
    if not chars:
        return False
    if inside:
        return 2 * links <= chars or any(n.tag == "p" for n in nodes)
    if chars >= TEXT_CHARS:
        return 4 * links < chars
    block = nodes[0] if len(run) == 1 and nodes and nodes[0].tag not in INLINE else None
    if block is not None and _value(block) >= least:
        return True
    if links:
        return False
    if block is None or block.tag == "p" or any(isinstance(n, Node) and n.tag == "p" for n in block.parts):
        return bool(SENTENCE_END.search("\n".join(_blocks(run))))
    return block.tag in PARTS


def _beside(parts: list, inside: bool, least: float, last: bool) -> list:
    """Those of a container's ``parts`` that are text; a heading goes with what follows it, ``last`` if that is the best container."""
    runs: list[list] = []
    loose = False
    for part in parts:
        inline = isinstance(part, str) or part.tag in INLINE or part.tag == "br"
        if inline and loose:
            runs[-1].append(part)
        else:
            runs.append([part])
        loose = inline
    kept, headings = [], []
    for run in runs:
        if isinstance(run[0], Node) and (run[0].dropped or not run[0].text_chars) and len(run) == 1:
            continue
        if isinstance(run[0], Node) and run[0].tag in HEADINGS:
            if 4 * run[0].link_chars < run[0].text_chars or inside:
                headings.append(run[0])
        elif _is_text(run, inside, least):
            kept += [*headings, None, *run, None]
            headings = []
        elif "".join(x if isinstance(x, str) else "x" for x in run).strip():
            headings = []
    return kept + (headings if last or inside else [])


def main_text(html: str | None) -> str:
    """The main text of one page; empty for null, empty and text-free pages."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    _judge(tree)
    _score(tree)
    able = [n for n in tree.nodes if not n.dropped and n.tag not in INLINE and n.text_chars]
    if not able:
        return ""
    best = max(able, key=_value)
    least = max(10.0, SIBLING_SHARE * _value(best))
    path = [best]
    while path[-1].parent is not None and path[-1].tag not in ("body", "html"):
        path.append(path[-1].parent)
    whole = max((k for k, n in enumerate(path) if n.tag in FAVOURED), default=None)
    before, after = [], []
    for child, parent in zip(path, path[1:] if whole is None else path[1 : whole + 1]):
        at = next(k for k, n in enumerate(parent.parts) if n is child)
        before.append(_beside(parent.parts[:at], whole is not None, least, True))
        after.append(_beside(parent.parts[at + 1 :], whole is not None, least, False))
    top = path[whole] if whole is not None else None
    if top is not None and top.tag == "article" and top.parent is not None:
        at = next(k for k, n in enumerate(top.parent.parts) if n is top)
        more = lambda parts: [x for n in parts if isinstance(n, Node) and n.tag == "article" and not n.dropped and _value(n) >= least and 4 * n.link_chars < n.text_chars for x in (n, None)]
        before.append(more(top.parent.parts[:at]))
        after.append(more(top.parent.parts[at + 1 :]))
    kept: list = [x for part in reversed(before) for x in (*part, None)]
    kept += [best, None]
    kept += [x for part in after for x in (*part, None)]
    return "\n".join(_blocks(kept))


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(all columns but the html), text, n_chars for each row of ``pages``.

    Null, empty and malformed pages give what text they have, or an empty
    string with 0 code points; pages are read whole. Equal rows give equal rows,
    and an empty table gives an empty one. Of containers with equal scores the
    first in page order counts. Columns that are named text or n_chars already
    are replaced.
    """
    rest = [f.name for f in pages.schema.fields if f.name != html_col and f.name.lower() not in ("text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.slices(batch, html_col):
                texts = [main_text(h) for h in part.column(part.schema.get_field_index(html_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(part.schema.get_field_index(c)) for c in rest),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    names=[*rest, "text", "n_chars"],
                )

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest) + ", text string, n_chars long"
    return pages.mapInArrow(run, schema)
