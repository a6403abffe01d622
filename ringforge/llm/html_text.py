"""Main text of web pages by tree scoring.

A page is parsed into a tree (with the usual implied end tags).  Elements that are page furniture by their tag, role or
class words carry no text; those whose names only may mean that ("related", "ad-hoc") go if what they hold is links for the most part
or a short label.  Every other paragraph-like block gives points for its length and commas to its parent in full, to the
grandparent by half and to further ancestors by a falling part; a container's points are discounted by the part of
its text that stands in links.  The container with the most points is the article, widened to the article or main
element around it, with those of its siblings that look like content.  Where no block is long enough to give points,
article, main or body is taken as a whole.

The text: character references decoded, white space inside a block made one space, blocks in page order joined by
\\n\\n.  Null or empty html, or html without text, gives an empty text.  Each page is a row of its own; repeated rows, and
rows without id or url, stay as they are.  Extra columns are ignored."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?--!?>|.*\Z)"  # comments; one without an end goes to the end of the page
    r"|<[!?][^>]*+>?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?:(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<broken>[^>]*+)(?:>|\Z))",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen frame".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("body html caption dd dt li legend optgroup option tbody td tfoot th thead tr".split()) | {"li", "dd", "dt"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the first kind ends where one of the second begins, unless one of the third stands between.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
DROP = frozenset(
    "script style noscript template nav footer aside form fieldset button select input textarea label iframe object embed svg canvas audio video map dialog menu "
    "head title meta link noembed noframes xmp".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist form".split())
#: Words of class and id that mark page furniture wherever they stand.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors banner cookie cookies consent gdpr notice notices popup modal overlay "
    "comment comments commentlist respond disqus nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead toolbar pagination pager "
    "newsletter subscribe subscription paywall skyscraper outbrain taboola".split()
)
#: Words that articles have too: an element with one goes only if what it holds looks like furniture (links, or a short label).
MAYBE = frozenset("promo promotion alert reply replies discussion share sharing social related recommended recommendations signup login search widget widgets skip".split())
#: Words that stand beside those in one name and say nothing of the content.
LAYOUT = frozenset(
    "container wrapper wrap box block list item items left right top bottom main inner outer bar button buttons btn link links header head title section area unit slot panel row rows col column form input field "
    "icon icons text content post posts site page global mobile desktop sticky fixed primary secondary group thread area region div the my".split()
)
GOOD = frozenset("article content body post entry main story text".split())
WEIGHT = {"div": 5, "article": 10, "main": 8, "section": 3, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "address": -3, "th": -5, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5}
#: The part of its text in links beyond which an element inside the article is a menu.
MENU = {"div": 0.7, "section": 0.7, "ul": 0.95, "ol": 0.95, "dl": 0.95, "table": 0.95}
#: Shorter blocks give no points.
MIN_BLOCK = 25
_CAMEL = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_COMMA = re.compile("[,،、，]")


class Node:
    __slots__ = ("tag", "parent", "block", "children", "drop", "maybe", "text_len", "link_len", "own", "commas", "score", "links", "hint")

    def __init__(self, tag: str, parent: Node | None, drop: bool, maybe: bool, hint: int):
        self.tag, self.parent, self.drop, self.maybe, self.hint = tag, parent, drop, maybe, hint
        self.block = None if parent is None else parent if parent.tag in BLOCK else parent.block
        self.children: list = []
        self.text_len = self.link_len = self.own = self.commas = self.links = 0
        self.score = 0.0


def _judged(name: str) -> int:
    """2 if a class or id name marks furniture, 1 if it may, 0 if not.  "ad" and "ad-box" do, "ad-hoc" only may."""
    words_ = [x.lower() for x in _CAMEL.findall(name)]
    found = [x for x in words_ if x in FURNITURE]
    if found:
        return 2 if all(x in FURNITURE or x in MAYBE or x in LAYOUT for x in words_) else 1
    return int(any(x in MAYBE for x in words_))


def _marks(tag: str, attrs: str) -> tuple[bool, bool, int]:
    """(is it furniture, may it be, points of its class words)."""
    if not attrs or not attrs.strip("/ \t\r\n"):
        return False, False, 0
    names: list[str] = []
    for k, v in _ATTR.findall(attrs):
        k, v = k.lower(), v.strip("\"'")
        if k == "hidden" or k == "aria-hidden" and v.lower() == "true":
            return True, False, 0
        if k == "role" and v.lower() in ROLES:
            return True, False, 0
        if k == "style" and "display:none" in v.replace(" ", "").lower():
            return True, False, 0
        if k == "class" or k == "id" and tag not in HEADINGS:  # a heading's id is an anchor, not a role
            names += v.split()
    good = any(x.lower() in GOOD for v in names for x in _CAMEL.findall(v))
    hint = 25 if good else 0
    if tag in ("html", "body", "article", "main"):
        return False, False, hint
    sure = max((_judged(v) for v in names), default=0)
    if sure == 2 and good:  # "content comments" against "comments content"
        first = next(x.lower() for v in names for x in _CAMEL.findall(v) if x.lower() in FURNITURE or x.lower() in GOOD)
        sure = 2 if first in FURNITURE else 1
    return sure == 2, sure == 1 and tag not in HEADINGS, hint


class _Stack:
    """The open elements, and for each tag the places of those that are open, so that none is looked for."""

    def __init__(self, root: Node):
        self.items = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, x: Node) -> None:
        self.places.setdefault(x.tag, []).append(len(self.items))
        self.items.append(x)

    def cut(self, k: int) -> None:
        while len(self.items) > k:
            self.places[self.items.pop().tag].pop()

    def last(self, tags) -> int:
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=-1)

    def close(self, names, barrier=()) -> None:
        """End the innermost open element of these names, and all in it, unless one of the barrier stands further in."""
        k = self.last(names)
        if k > 0 and k > self.last(barrier):
            self.cut(k)


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree's root and all nodes in the order of their start tags; the time is in proportion to the page."""
    root = Node("#root", None, False, False, 0)
    nodes, stack = [root], _Stack(root)
    at, n = 0, len(page)
    no_end: set[str] = set()

    def text(s: str) -> None:
        if s and not stack.items[-1].drop:
            stack.items[-1].children.append(s)

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "br":
                text(" ")
            else:
                stack.close(HEADINGS if name in HEADINGS else (name,), () if name in ("table", "article", "main", "body", "html", "div", "section") else ("table",))
            continue
        attrs = m["attrs"] if m["attrs"] is not None else m["broken"]
        if name in VOID:
            if name == "hr":
                stack.close(("p",), ("td", "th", "table", "button", "caption", "article", "body"))
            if name == "br":
                text(" ")
            continue
        if name in ENDS_P:
            stack.close(("p",), ("td", "th", "table", "button", "caption", "object"))
            if name in HEADINGS and stack.items[-1].tag in HEADINGS:
                stack.cut(len(stack.items) - 1)
        if name in SIBLINGS:
            stack.close(*SIBLINGS[name])
        if name == "body":
            stack.close(("head",))
        if name == "a":
            stack.close(("a",), BLOCK)
        if name in RAW:
            end = None if name in no_end else re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            if end is None:
                no_end.add(name)
            at = end.start() if end else n
            if end:
                at = page.find(">", end.start()) + 1 or n
            continue
        marked, maybe, hint = _marks(name, attrs)
        top = stack.items[-1]
        drop = top.drop or marked or name in DROP or (name == "header" and stack.last(("article", "main")) < 0)
        node = Node(name, top, drop, maybe, hint)
        if not drop:
            top.children.append(node)
            nodes.append(node)
        if not attrs.rstrip().endswith("/") or name not in ("svg", "path", "use"):
            stack.push(node)
    return root, nodes


def _measure(nodes: list[Node]) -> None:
    for x in reversed(nodes):  # children come before their parents
        for c in x.children:
            if isinstance(c, str):
                s = len(" ".join(c.split()))
                x.text_len += s
                x.own += s
                x.commas += len(_COMMA.findall(c))
            else:
                x.text_len += c.text_len
                x.link_len += c.link_len
                x.links += c.links
                if c.tag not in BLOCK:
                    x.own += c.own
                    x.commas += c.commas
        if x.tag == "a":
            x.link_len, x.links = x.text_len, x.links + 1


def _density(x: Node) -> float:
    return x.link_len / x.text_len if x.text_len else 0.0


_SENTENCE = re.compile(r"[.!?…。！？]")


def _label(x: Node) -> bool:
    """Is an element that may be furniture so by what it holds: links for the most part, or a short label without a sentence?"""
    if _density(x) > 0.3:
        return True
    if x.tag in ("p", "pre", "blockquote") or x.text_len >= 80:
        return False
    todo, parts = [x], []
    while todo:
        y = todo.pop()
        if isinstance(y, str):
            parts.append(y)
        else:
            todo.extend(y.children)
    return not any(_SENTENCE.search(y) for y in parts)


def best(nodes: list[Node]) -> Node | None:
    """The container with the most points after the discount for links."""
    scored: dict[int, Node] = {}
    for x in nodes:
        if x.tag in BLOCK or x.tag == "#root":
            if x.own >= MIN_BLOCK and x.tag not in HEADINGS and x.tag not in ("html", "#root"):
                points = (1 + x.commas + min(x.own / 100, 3)) * (1 - _density(x))
                up, level = (x.block if x.tag not in ("div", "section", "article", "main", "body") else x), 0
                while up is not None and level < 4:
                    if id(up) not in scored:
                        scored[id(up)] = up
                        up.score = WEIGHT.get(up.tag, 0) + up.hint
                    up.score += points / (1, 2, 6, 9)[level]
                    level += 1
                    up = up.block
    top = None
    for x in scored.values():
        x.score *= 1 - _density(x)
        if top is None or x.score > top.score:
            top = x
    return top


def _kept(nodes: list[Node], root: Node) -> list[Node]:
    top = best(nodes)
    if top is None:
        return [max((x for x in nodes if x.tag in ("article", "main", "body") and x.text_len), key=lambda x: (x.tag == "article", x.tag == "main", x.text_len), default=root)]
    up = top
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:
        top = up
    if top.parent is None or top.tag in ("article", "main", "body"):
        return [top]
    least = max(10, 0.2 * top.score)
    out = []
    for x in top.parent.children:
        if isinstance(x, str):
            continue
        dense = _density(x)
        if x is top or x.score >= least or x.tag in HEADINGS or (x.tag == "p" and (x.text_len > 80 and dense < 0.25 or 0 < x.text_len <= 80 and dense == 0)):
            out.append(x)
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root, nodes = parse(page)
    _measure(nodes)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        s = " ".join(html.unescape("".join(line)).split())
        if s:
            blocks.append(s)
        line.clear()

    for start in _kept(nodes, root):
        stack: list = [start]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            elif x.tag in BLOCK:
                flush()
                if x is not start and x.maybe and _label(x):
                    continue
                # links and nothing else are a menu; a list with other text too, as one of sources, belongs to the article
                if x is not start and x.links >= 2 and _density(x) > MENU.get(x.tag, 1):
                    continue
                stack.append(None)
                stack.extend(reversed(x.children))
            else:
                stack.extend(reversed(x.children))
        flush()
    return "\n\n".join(blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches):
        for b in words.chunks(batches):
            got = [main_text(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    common.bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
