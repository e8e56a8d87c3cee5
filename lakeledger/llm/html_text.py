"""Main text of web pages by composite text density.

The page becomes a DOM.  Menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and comments are taken out by element, role and name;
by name only where the element holds neither the page's article nor most of
its text outside links.
Every remaining node has a link-adjusted density: characters per tag, scaled
down by the share of characters and tags that belong to links.  The node
whose children's densities have the largest sum is the article's body.  The
smallest density on the path from the page's body to it is the threshold;
sibling subtrees along the path that reach it belong to the text too, and so
does text that stands bare in the path's elements.  Where the node lies in an
element that the page marks as article or main, that element is the text:
its short paragraphs are below any threshold.  Of several articles on a page
the one with that node is the text.  Lists that hold nothing but links are
menus wherever they stand.  Reader comments are known by element, role and
name only; in a section without any of these they can't be told from text.

Every step is linear in the page: nodes are numbered in page order, so one
comparison tells whether a node lies in another, however deep it is.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeledger.llm.registry import register, table

# ---- fixed values -----------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe plaintext".split())
#: Elements whose content is never main text.
DROPPED = frozenset("head script style noscript template svg math canvas iframe object embed audio video picture map nav aside footer "
                    "form button input select option datalist textarea label fieldset menu dialog title link meta base xmp noembed noframes".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre section summary table "
                  "caption tbody td tfoot th thead tr ul".split())
#: A start tag of these closes an open paragraph.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
                     "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul dd dt li".split())
#: Open elements that keep a paragraph around them open.
P_BORDER = frozenset("button table td th caption object".split()) | (BLOCK - {"p"})
#: Start tag: open elements that it closes, up to the scope's border.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
          "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, set())}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Words of class or id that mark boilerplate.
NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|adslot|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|"
                   r"popup|modal|overlay|newsletter|subscribe|subscription|signup|login|sidebar|side|aside|nav|navbar|navigation|menu|breadcrumbs?|"
                   r"footer|foot|header|masthead|comments?|commentlist|disqus|replies|respond|reactions|related|recommended|share|sharing|"
                   r"social|widget|toolbar|pagination|pager|search|skip|toc|tags|byline|outbrain|taboola)(?=$|[\s_-])", re.I)
#: The rest of a name that says what a layout has or lacks: has-sidebar, no-comments.
LAYOUT = re.compile(r"(?<![^\s_-])(?:has|with|no|without)[_-]\S*", re.I)
#: Words of these beginnings mark lists that often hold article elements of their own.
#: Elements that hold other blocks; only these are taken out by name inside an article.
HOLDERS = frozenset("div section ul ol dl table details center dir figure".split())
LISTS = ("ad", "sponsor", "promo", "comment", "disqus", "repl", "respond", "reactions", "related", "recommended", "outbrain", "taboola")
# -----------------------------------------------------------------------------

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
                    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "words", "own", "plain", "chars", "tags", "link_chars", "link_tags", "density", "total", "gone", "first",
                 "last", "links", "flag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.items: list[Node | str] = []
        self.gone = False


def parse(page: str) -> Node:
    """The page's DOM, with the end tags that HTML lets authors leave out."""
    root = at = Node("#root", {}, None)
    # Open elements, outermost first; the depths of those of a tag, of blocks, and of borders of paragraphs.
    stack, open_, blocks, borders = [root], defaultdict(list), [], []
    pos = 0

    def enter(node: Node) -> Node:
        open_[node.tag].append(len(stack))
        if node.tag in BLOCK:
            blocks.append(len(stack))
        if node.tag in P_BORDER:
            borders.append(len(stack))
        stack.append(node)
        return node

    def leave(depth: int) -> Node:
        """Close the open elements from ``depth`` on."""
        while len(stack) > depth:
            tag = stack.pop().tag
            open_[tag].pop()
            if tag in BLOCK:
                blocks.pop()
            if tag in P_BORDER:
                borders.pop()
        return stack[-1]

    def close(names: set[str], border: int) -> Node:
        """Close the outermost open element of ``names`` inside the border's depth."""
        found = len(stack)
        for name in names:
            at_ = open_[name]
            if at_ and at_[-1] > border:
                found = min(found, at_[bisect_right(at_, border)])
        return leave(found)

    while pos < len(page):
        m = _TOKEN.search(page, pos)
        text = page[pos:m.start() if m else len(page)]
        if text:
            at.items.append(html.unescape(text))
        if not m:
            break
        pos = m.end()
        if m[1]:
            name = m[1].lower()
            # An end tag of an inline element does not leave its block.
            if open_[name] and (name in BLOCK or not blocks or open_[name][-1] > blocks[-1]):
                at = leave(open_[name][-1])
        elif m[2]:
            name = m[2].lower()
            if name in CLOSES_P and open_["p"]:
                at = close({"p"}, borders[-1] if borders else 0)
            if name in CLOSES and any(open_[x] for x in CLOSES[name][0]):
                names, border = CLOSES[name]
                at = close(names, max((open_[x][-1] for x in border if open_[x]), default=0))
            attrs = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(m[3] or "")}
            node = Node(name, attrs, at)
            at.items.append(node)
            if name in RAW:
                end = re.compile(rf"</{name}\s*/?>", re.I).search(page, pos)
                raw = page[pos:end.start() if end else len(page)]
                node.items.append(html.unescape(raw) if name in ("title", "textarea") else raw)
                pos = end.end() if end else len(page)
            elif name not in VOID:
                at = enter(node)
    return root


def within(node: Node, outer: Node) -> bool:
    """Whether a node is ``outer`` or lies in it."""
    return outer.first <= node.first <= outer.last


def boilerplate(node: Node, inside: bool) -> bool:
    """Whether an element is no main text, by element, role or style; ``inside``: it lies in an article."""
    tag, attrs = node.tag, node.attrs
    if tag in DROPPED:
        return True
    if tag in ("html", "body", "main"):
        return False
    if tag == "header":
        return not inside
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    return attrs.get("role", "").lower() in ROLES


def boilerplate_words(node: Node, inside: bool) -> set[str]:
    """The words of an element's class and id that mark boilerplate."""
    if node.tag in ("html", "body", "main", "header") or not ("class" in node.attrs or "id" in node.attrs):
        return set()
    names = LAYOUT.sub("", f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}")
    found = {x.group().strip(" _-\t\n").lower() for x in NAMES.finditer(names)}
    return found - {"header"} if inside else found


def walk(root: Node) -> list[Node]:
    """All kept nodes in page order, numbered (``first``; ``last``: the number of the last node inside)."""
    nodes, todo, inner = [], [(root, False)], []
    while todo:
        node, inside = todo.pop()
        if boilerplate(node, inside):
            node.gone = True
            continue
        node.first = node.last = len(nodes)
        nodes.append(node)
        node.words = boilerplate_words(node, inside)
        if node.words and inside:
            inner.append(node)
        node.own = sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
        inside = inside or node.tag in ("article", "main")
        todo += [(x, inside) for x in reversed(node.items) if isinstance(x, Node)]
    for n in nodes:
        n.plain, n.chars, n.links = n.own, n.own, 0
    for n in reversed(nodes):
        if n.tag == "a":
            n.plain, n.links = 0, 1
        if n is not root:
            up = n.parent
            up.last, up.plain, up.chars, up.links = max(up.last, n.last), up.plain + n.plain, up.chars + n.chars, up.links + n.links
    for n in inner:
        # Inside an article a name takes out lists of other things, and other holders of mostly links; no paragraph.
        if n.tag not in HOLDERS:
            n.words = {w for w in n.words if w.startswith(LISTS[:3]) and n.tag not in ("p", "blockquote", "pre")}
        elif 2 * n.plain > n.chars:
            n.words = {w for w in n.words if w.startswith(LISTS)}
    menus = {id(n) for n in nodes if n.tag in ("ul", "ol") and n.links >= 3 and not n.plain}
    spared = holders(nodes) if any(n.words for n in nodes) else set()
    out, end = [], -1
    for n in nodes:
        if n.first <= end:
            n.gone = True
        elif id(n) in menus or n.words and id(n) not in spared:
            n.gone, end = True, n.last
        else:
            out.append(n)
    if not any(n.own for n in out):
        # Names and lists alone would leave nothing of the page.
        for n in nodes:
            n.gone = False
        return nodes
    return out


def holders(nodes: list[Node]) -> set[int]:
    """Elements that no name takes out: they hold the page's main element or article, or most of its text outside links."""
    def lists(n: Node) -> bool:
        return any(w.startswith(LISTS) for w in n.words)

    marked = [n for n in nodes if n.tag in ("article", "main") and n.plain and not lists(n)]
    articles = [n for n in marked if n.tag == "article"]
    for n in nodes:
        n.flag = n.tag == "main" and n.plain > 0 and not lists(n)
    for n in reversed(nodes):
        if n.flag and n.parent is not None:
            n.parent.flag = True
    out = {id(n) for n in nodes if n.flag}
    if articles:
        first = max(articles, key=lambda n: n.plain)
        out |= {id(a) for a in (first, *_above(first)) if len(articles) == 1 or not lists(a)}
    total = nodes[0].plain
    large = [n for n in nodes if n.words and 2 * n.plain > total and id(n) not in out]
    if not large:
        return out
    # Each of these holds more than half of the text, so they lie in one another.  The longest marked text
    # beside one of them: in marked elements before and after it, or around it.
    ends = sorted((m.last, m.plain) for m in marked)
    before = list(accumulate((p for _, p in ends), max))
    after = list(accumulate((m.plain for m in reversed(marked)), max))[::-1]
    starts = [m.first for m in marked]
    around = [m for m in marked if within(large[0], m) and m is not large[0]]
    for n in large:
        beside = [m.plain - n.plain for m in around[:1]]
        i, j = bisect_left(ends, (n.first, -1)), bisect_right(starts, n.last)
        beside += before[i - 1:i] + after[j:j + 1]
        # A long list of comments beside a marked article is still one.
        if not lists(n) or 4 * max(beside, default=0) <= total:
            out.add(id(n))
        if not around and n.plain and n.tag in ("article", "main") and not lists(n):
            around = [n]
    return out


def measure(nodes: list[Node]) -> list[Node]:
    """Composite text density of every node of a subtree (its root first), and the sum over its children."""
    top = nodes[0]
    for n in nodes:
        n.chars = n.link_chars = n.link_tags = 0
        n.tags, n.total = 0, 0.0
    for n in reversed(nodes):
        n.chars += n.own
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
        if n is not top:
            p = n.parent
            p.chars += n.chars
            p.tags += n.tags + 1
            p.link_chars += n.link_chars
            p.link_tags += n.link_tags
    ratio = top.link_chars / max(1, top.chars)
    for n in nodes:
        c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        base = math.log(c / max(1, c - n.link_chars) * lc + ratio * c + math.e)
        n.density = c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(base) if c else 0.0
    for n in reversed(nodes):
        if n is not top:
            n.parent.total += n.density
    return nodes


def main_nodes(root: Node) -> list[Node]:
    """Subtrees of the main text, in page order; what doesn't belong to it inside them is marked as gone.

    The subtree with the largest density sum, widened to the article that it
    lies in if the page marks one, else by the siblings along its path that
    reach the threshold and the headings beside them, and by bare text there.
    """
    nodes = walk(root)
    body = next((n for n in nodes if n.tag == "body"), None)
    scope = [n for n in nodes if within(n, body)] if body else nodes
    if not any(n.chars for n in measure(scope)):
        scope = nodes
        measure(scope)
    best = max(scope, key=lambda n: n.total)
    # Elements with a name of boilerplate stay only where the best node is in them or holds them.
    for n in scope:
        if n.words and not within(best, n) and not within(n, best):
            n.gone = True
    path = [best, *_above(best)]
    path = path[:path.index(scope[0]) + 1]
    marked = [a for a in path if a.tag in ("article", "main")]
    if marked:
        return [marked[-1]]
    # One marked article that holds most of the text below the best node.
    inner = next((n for n in scope if n.tag in ("article", "main") and 2 * n.chars > best.chars and within(n, best)), None)
    if inner:
        return [inner]
    threshold = min(n.density for n in path)
    on_path = {id(n) for n in path}
    for n in path[1:]:
        for x in n.items:
            if isinstance(x, Node) and not x.gone and id(x) not in on_path and not (
                    x.chars and (x.density >= threshold or x.tag in ("h1", "h2", "h3"))):
                # An inline element beside bare text is a part of its sentence.
                x.gone = x.tag in BLOCK or not n.own or x.tag == "a"
    return [path[-1]]


def _above(node: Node) -> Iterator[Node]:
    while node.parent is not None:
        node = node.parent
        yield node


def block_texts(node: Node) -> list[str]:
    """Texts of the blocks of a subtree: white space as one space, trimmed, none empty."""
    parts: list[str] = []
    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            parts.append("\0")
        elif isinstance(x, str):
            parts.append(x.replace("\0", "�"))
        elif not x.gone:
            if x.tag == "br":
                parts.append(" ")
            elif x.tag in BLOCK:
                todo += [None, *reversed(x.items), None]
            else:
                todo += reversed(x.items)
    return [t for t in (" ".join(p.split()) for p in "".join(parts).split("\0")) if t]


def extract(page: str | None) -> str:
    """The page's main text; empty for a NULL or empty page."""
    if not page:
        return ""
    out: list[str] = []
    for n in main_nodes(parse(page)):
        out += block_texts(n)
    return "\n".join(out)


def with_main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """Add ``text`` (main text) and ``n_chars`` (its code points) to every row.

    NULL and empty pages have an empty text.  Rows are independent, so ties
    and repeated rows need no care.  All other columns but ``column`` stay;
    columns named ``text`` or ``n_chars`` are replaced.
    """
    keep = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    base = pages.select(*keep, F.col(column).alias("__html"))
    schema = T.StructType([*base.schema.fields[:-1], T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = [extract(x) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=[*keep, "text", "n_chars"])

    return base.mapInArrow(run, schema)


@register("op1_main_text")
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return with_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
