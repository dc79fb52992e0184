"""Main text of web pages by composite text density.

A page is cut into tags and text by one forward scan, and a tree of its block elements is built; inline elements belong to
the block around them and count as its tags. Elements that are no article by their meaning (scripts, forms, menus, page
headers and footers, asides, adverts, notices, reader comments, boxes that are mostly links) leave the tree first. Every node that stays has the
composite text density

    C/T * log(C/LC * T/LT) / log(ln(C/NC * LC + LB/CB * C + e))

of its characters C, link characters LC, other characters NC, tags T and link tags LT, all but C at least 1 where they
divide, and of the body's LB and CB. Without any link text the second logarithm is 0 for every node of the page; there the
density is C/T. A node's density sum is that of its children. The node with the largest sum is the core of the content; the
smallest density on the path from it up to body is the threshold, and nodes that reach it are content as well, in each the
one with the largest sum. The result is the smallest subtree with all content. An article or main element is no choice of
its own: where the densities choose a part of one, it is taken whole, as nothing of an article may be lost, and where the
core stands in one of several, all of them that hold content are taken.

Character references are decoded, white space inside a block becomes one space, blocks are joined by line feeds; nothing
else is dropped or capped. A line break element is white space. A quote that is never closed is a plain character, an
unfinished tag at the end of a page is no text, and text behind the end of body belongs to it. Scanning and walking take
time in proportion to the page, for any depth of nesting and any markup, and use no recursion.

Null or empty pages, and pages without text, give an empty text. Rows are independent: nulls in other columns pass through
(a null url stays null), repeated rows give repeated results, other columns are not read, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"""[>"']""")
ATTR = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
ZEROS, LONG_REFERENCE = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])"), re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")

# Fixed values of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th button input select option optgroup label datalist output meter progress svg math canvas object embed audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "tbody": {"tr", "thead", "tbody"}, "tfoot": {"tr", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}}

# What no article holds: by element, by role, and by the words of its class or id.
DROPPED = frozenset("head script style noscript template nav aside footer menu dialog form fieldset button input select textarea label option datalist svg math canvas object embed iframe audio video map title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletters?|subscribe|subscription|sidebars?|aside|widgets?|related|recommend\w*|share|sharing|social|breadcrumbs?|menus?|nav|navbar|navigation|masthead|footer|topbar|comments?|commentlist|disqus|replies|reply|respond|pagination|pager|login|signup|sign-up|search|toolbar|skip-link|paywall|teasers?|outbrain|taboola)(?=$|[\s_-])", re.I)
HEADER = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])", re.I)  # of a page; an article's own holds its title
LAYOUT = re.compile(r"(?<!\S)(?:has|no|with|without)[-_]\S*", re.I)  # says what stands beside or inside an element
INNER = ("article", "main")
IN_HEAD = frozenset("title meta link base style script noscript template".split())


class Node:
    __slots__ = ("at", "attrs", "best", "chars", "density", "depth", "inlines", "inner", "items", "kept", "link_chars", "link_tags", "parent", "sums", "tag", "tags")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.depth = parent.depth + 1 if parent else 0
        self.items: list[Node | str] = []
        self.inlines: list[str] = []  # tags of the inline elements opened in it
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sums = 0.0
        self.kept, self.inner, self.at = True, False, 0
        self.best: Node | None = None


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """Kind (text, open, close), name or text, attributes. Each character is looked at a bounded number of times."""
    last = {q: page.rfind(q) for q in "\"'>"}
    begin = at = 0  # where the text and the search begin
    while (lt := page.find("<", at)) >= 0:
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            cdata = page.startswith("<![CDATA[", lt)
            mark, skip = ("-->", 4) if page.startswith("<!--", lt) else ("]]>", 9) if cdata else (">", 2)
            yield "text", page[begin:lt], ""
            end = page.find(mark, lt + skip)
            if cdata:
                yield "text", page[lt + 9 : end if end >= 0 else len(page)], ""
            begin = at = end + len(mark) if end >= 0 else len(page)
            continue
        m = NAME.match(page, lt + 1)
        if not m:
            at = lt + 1
            continue
        yield "text", page[begin:lt], ""
        end = m.end()
        while end <= last[">"] and (stop := STOP.search(page, end)) and stop[0] != ">":
            at, end = stop.start(), stop.end()
            before = at - 1
            while page[before].isspace():
                before -= 1
            if page[before] == "=" and at < last[stop[0]]:  # the quote opens a value, and is closed
                end = page.index(stop[0], end) + 1
        if end > last[">"] or not stop:
            return  # an unfinished tag
        name = m[1].lower()
        yield "close" if after == "/" else "open", name, page[m.end() : stop.start()]
        begin = at = stop.end()
        if name in RAW and after != "/":
            shut = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            end = page.find(">", shut.end()) if shut else -1
            if end < 0:
                return
            begin = at = end + 1
    yield "text", page[begin:], ""


def inked(s: str) -> int:
    """Characters that are no white space."""
    return sum(map(len, s.split()))


def decoded(s: str) -> str:
    return html.unescape(LONG_REFERENCE.sub("\ufffd", ZEROS.sub(r"&#\1", s))) if "&" in s else s


class Tree:
    """Builds the tree of block elements: each node before those in it, in the order of the page.

    Text stands in the nodes as strings, link text in the counts of its block.
    """

    def __init__(self, page: str):
        self.node = Node("#root", "", None)
        self.order = [self.node]
        self.opened: dict[str, list[Node]] = defaultdict(list)  # open blocks of each tag, outermost first
        self.inline: dict[str, list[tuple[Node, bool]]] = defaultdict(list)  # open inline elements of each tag: block, hidden
        self.hidden = self.links = 0
        for kind, value, attrs in tokens(page):
            if kind == "text":
                self.text(decoded(value))
            elif value in INLINE:
                self.inline_tag(kind, value, attrs)
            elif kind == "close":
                if value not in ("body", "html"):
                    self.close(value)
            elif value not in RAW:
                self.block(value, attrs)

    def text(self, s: str) -> None:
        if self.node.tag == "head" and s.strip():
            self.close("head")
        if s and not self.hidden:
            self.node.items.append(s)
            if self.links:
                self.node.link_chars += inked(s)

    def inline_tag(self, kind: str, tag: str, attrs: str) -> None:
        if tag in ("br", "td", "th"):
            self.node.items.append(" ")
        if kind == "close":
            if self.inline[tag]:
                self.end_inline(tag)
            return
        self.node.tags += 1
        self.node.link_tags += tag == "a"
        if tag in VOID or tag in ("td", "th"):
            return
        away = dropped(tag, attrs)
        self.hidden += away
        self.links += tag == "a"
        self.inline[tag].append((self.node, away))
        self.node.inlines.append(tag)

    def end_inline(self, tag: str) -> None:
        self.hidden -= self.inline[tag].pop()[1]
        self.links -= tag == "a"

    def close(self, tag: str, scopes: frozenset | set = frozenset()) -> None:
        """Closes the innermost open block of a tag, and all in it, unless one of the scopes is open inside that block."""
        if not self.opened[tag]:
            return
        last = self.opened[tag][-1]
        if any(self.opened[x] and self.opened[x][-1].depth > last.depth for x in scopes):
            return
        while self.node.depth >= last.depth:
            shut = self.node
            for x in shut.inlines:  # a block ends the inline elements in it
                if self.inline[x] and self.inline[x][-1][0] is shut:
                    self.end_inline(x)
            self.opened[shut.tag].pop()
            self.node = shut.parent

    def block(self, tag: str, attrs: str) -> None:
        if tag not in IN_HEAD:
            self.close("head")
        if tag not in IN_HEAD and tag not in ("tr", "tbody", "thead", "tfoot", "caption", "colgroup"):
            self.close("p", {"table", "body"})
        for other in CLOSES.get(tag, ()):
            self.close(other, SCOPES.get(tag, frozenset()))
        child = Node(tag, attrs, self.node)
        self.node.items.append(child)
        self.order.append(child)
        if tag not in VOID and not attrs.endswith("/"):
            self.node = child
            self.opened[tag].append(child)


def dropped(tag: str, attrs: str, of_page: bool = False) -> bool:
    """Whether an element is no part of an article, by its name and attributes."""
    if tag in DROPPED:
        return True
    for name, a, b, c in ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            value = LAYOUT.sub("", value)
            if NOISE.search(value) or of_page and HEADER.search(value):
                return True
        elif (
            name == "hidden"
            or name == "aria-hidden" and value.lower() == "true"
            or name == "role" and value.lower() in ROLES
            or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)
        ):
            return True
    return False


def reached(order: list[Node]) -> list[Node]:
    """The nodes that are kept, and those around them too."""
    there: set[Node] = set()
    for n in order:
        if n.kept and (n.parent is None or n.parent in there):
            there.add(n)
    return [n for n in order if n in there]


def measure(order: list[Node]) -> list[Node]:
    """Drops what is no article, counts characters and tags from the leaves up, and returns the nodes that stay."""
    for n in reversed(order):
        n.inner |= n.tag in INNER
        if n.inner and n.parent is not None:
            n.parent.inner = True
    in_article: set[Node] = set()
    for x in order:
        inside = x.parent in in_article
        if inside or x.tag == "article":
            in_article.add(x)
        named = x.tag in DROPPED and not (x.tag == "form" and x.inner) or x.tag == "header" and not inside
        if x.parent is not None and (named or x.tag not in ("html", "body", "article", "main") and not x.inner and dropped(x.tag, x.attrs, not inside)):
            x.kept = False
    for x in reversed(reached(order)):
        x.chars += sum(inked(s) for s in x.items if isinstance(s, str))
        if x.parent is None:
            continue
        if x.tag in ("ul", "ol", "dl", "div", "section", "table") and x.link_tags > 2 and x.link_chars > 0.7 * x.chars:
            x.kept = False  # a menu, whatever its name
            continue
        up = x.parent
        up.chars += x.chars
        up.tags += 1 + x.tags
        up.link_chars += x.link_chars
        up.link_tags += x.link_tags
    return reached(order)


def density(n: Node, body: Node) -> float:
    if not n.chars:
        return 0.0
    plain, t, lc, lt = n.chars / max(1, n.tags), max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
    if not body.link_chars:
        return plain
    base = math.log(n.chars / max(1, n.chars - n.link_chars) * n.link_chars + body.link_chars / body.chars * n.chars + math.e)
    return plain * math.log(n.chars / lc * t / lt) / math.log(base)


def densities(nodes: list[Node]) -> None:
    """Sets each node's density, the sum of its children's, and the node of the largest sum in it, the first of equal ones."""
    for n in nodes:
        n.density = density(n, nodes[0])
    for n in nodes[1:]:
        n.parent.sums += n.density
    for n in reversed(nodes):
        if n.best is None or n.sums >= n.best.sums:
            n.best = n
        if n is not nodes[0] and (n.parent.best is None or n.best.sums >= n.parent.best.sums):
            n.parent.best = n.best


def around(node: Node | None, body: Node) -> Iterator[Node]:
    """A node and those around it, up to body."""
    while node is not None:
        yield node
        node = None if node is body else node.parent


def content(nodes: list[Node]) -> list[Node]:
    """The subtrees that hold the main text, in the order of the page."""
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    inside: set[Node] = {body}
    for n in nodes:
        if n.parent in inside:
            inside.add(n)
    nodes = [n for n in nodes if n in inside]
    for k, n in enumerate(nodes):
        n.at = k
    densities(nodes)
    core = body.best
    if not core.sums:
        core = max(nodes, key=lambda n: n.density)
    threshold = min(n.density for n in around(core, body))
    marks = [core] + [n.best if n.best.sums else n for n in nodes if n.density >= threshold and n is not body]
    # A subtree is a run of nodes, so the smallest around all marks is the first above the core that reaches both ends.
    last = [n.at for n in nodes]
    for n in reversed(nodes[1:]):
        last[n.parent.at] = max(last[n.parent.at], last[n.at])
    low, high = min(n.at for n in marks), max(n.at for n in marks)
    top = next(n for n in around(core, body) if n.at <= low and last[n.at] >= high)
    # An article around the choice stands on the path, so it reaches the threshold too: it is content as a whole.
    if whole := next((n for n in around(top, body) if n.tag in INNER), None):
        return [whole]
    holder: list[Node | None] = [None] * len(nodes)  # the outermost article or main around each node
    for n in nodes[1:]:
        holder[n.at] = holder[n.parent.at] or (n if n.tag in INNER else None)
    if holder[core.at] is None:
        return [top]
    return [nodes[k] for k in sorted({holder[n.at].at for n in marks if holder[n.at] is not None})]


def lines(node: Node, out: list[str]) -> None:
    run: list[str] = []

    def flush() -> None:
        if s := " ".join("".join(run).split()):
            out.append(s)
        run.clear()

    left = [iter(node.items)]
    while left:
        for x in left[-1]:
            if isinstance(x, str):
                run.append(x)
                continue
            flush()
            if x.kept:
                left.append(iter(x.items))
                break
        else:
            left.pop()
            flush()


def main_text(page: str | None) -> str:
    if not page:
        return ""
    out: list[str] = []
    for part in content(measure(Tree(page).order)):
        lines(part, out)
    return "\n".join(out)


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "html"):
            texts = [main_text(t) for t in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html")).mapInArrow(run, schema)
