"""Main text of web pages by composite text density over the page's tree."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed values of the page language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose text is never part of an article.
DROPPED = frozenset("""script style noscript template head title nav header footer aside form button select option input textarea
    iframe object embed applet svg canvas audio video map dialog menu noembed noframes xmp""".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot
    th thead tr ul""".split())
#: What an open paragraph, item or cell is closed by.
ENDS_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4
    h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul""".split())
#: Elements whose blocks close no paragraph outside them.
HOLDS_P = frozenset("table td th button object".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
            "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
            "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
#: Words of class, id and role that name what is not the article.
BOILER = re.compile(r"""(?:ads?|adverts?|advertisements?|advertising|adbox|adsense|banner|sponsor(?:ed|s)?|promo(?:tion|s)?|
    nav|navbar|navigation|menu|menubar|breadcrumbs?|pagination|pager|toc|header|masthead|footer|copyright|colophon|contentinfo|
    sidebar|side|aside|complementary|widget|related|recommended|cookies?|consent|gdpr|notice|notification|alert|alertdialog|popup|modal|overlay|
    newsletter|subscribe|subscription|signup|login|paywall|share|sharing|social|comments?|commentlist|disqus|replies|reply|respond|
    feedback|search|searchbox|toolbar|skip|skiplink|hidden|tags?)""", re.I | re.X)
COMMENTS = re.compile(r"comments?|commentlist|disqus|replies|reply|respond")
#: A name counts as a whole, at the end of a compound, or before these words; not after words of the second kind.
LAYOUT = frozenset("""area bar block bottom box button buttons card center column container form group inner item items left link links list
    outer panel post posts primary right row secondary section slot thread top unit wrap wrapper body""".split())
ABSENT = frozenset("has have no not with without show hide is".split())
TAG = re.compile(r"<!--.*?(?:--!?>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|[^>])*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")


class Node:
    """An element: its parts in page order (strings and nodes) and its counts."""

    __slots__ = ("tag", "parts", "skip", "link", "chars", "tags", "link_chars", "link_tags", "density", "total", "parent", "kind")

    def __init__(self, tag: str, parent: Node | None, kind: int = 0):
        self.tag, self.parent, self.kind = tag, parent, kind
        self.skip = kind > 0
        self.parts: list = []
        self.link = tag == "a"
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _named(token: str) -> str:
    """The part of a class, id or role that names what is not the article; empty if none does."""
    parts = [x for x in re.split(r"[_-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if x]
    if not parts or ABSENT.intersection(parts[:-1]):
        return ""
    if BOILER.fullmatch(parts[-1]) and (len(parts) == 1 or parts[-1] != "side"):
        return parts[-1]
    if BOILER.fullmatch(parts[0]) and all(x in LAYOUT or x.isdigit() or BOILER.fullmatch(x) for x in parts[1:]):
        return parts[0]
    return ""


def _boilerplate(tag: str, attributes: str) -> int:
    """0: may hold the article; 1: no article by its name or as a form, unless its content says so; 2: the same by a name of comments; 3: never."""
    if tag in DROPPED and tag != "form":
        return 3
    kind = int(tag == "form")
    if not attributes or tag in ("html", "body", "main"):
        return kind
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(a or b or c)
        if tag != "article" and (name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN_STYLE.search(value)):
            return 3
        if name in ("class", "id", "role"):
            for word in filter(None, map(_named, value.split())):
                kind = max(kind, 2 if COMMENTS.fullmatch(word) else 1)
    return kind


def _settle(root: Node) -> None:
    """Take back the set-aside nodes of kind 1 and 2 that hold an ``article`` or ``main``, and where the page
    has neither, those of kind 1 with most of the body's characters outside links."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo.extend(x for x in node.parts if isinstance(x, Node) and x.kind < 3)
    if not any(x.kind for x in nodes):
        return
    plain: dict[int, int] = {}
    holds: set[int] = set()
    for node in reversed(nodes):
        own = 0 if node.tag == "a" else sum(len(SPACE.sub("", html.unescape(x))) for x in node.parts if isinstance(x, str))
        inner = [x for x in node.parts if isinstance(x, Node) and x.kind < 3]
        plain[id(node)] = 0 if node.tag == "a" else own + sum(plain[id(x)] for x in inner)
        if node.tag == "main" or node.tag == "article" and not node.kind or any(id(x) in holds for x in inner):
            holds.add(id(node))
    whole = next((plain[id(x)] for x in nodes if x.tag == "body"), plain[id(root)])
    for node in nodes:
        if id(node) in holds or node.tag == "article" or id(root) not in holds and node.kind == 1 and 2 * plain[id(node)] > whole:
            node.skip = False


def parse(page: str) -> Node:
    """The tree of a page, in one pass. Open elements are closed as the page language says; end tags without a start are left out."""
    root = Node("", None)
    stack, at = [root], 0
    open_p = [0]  # per open element: the place of the paragraph that a block would close, 0 if none
    any_p = [False]  # and whether any paragraph is open

    def cut(i: int) -> None:
        del stack[i:], open_p[i:], any_p[i:]

    def push(node: Node) -> None:
        stack.append(node)
        open_p.append(len(stack) - 1 if node.tag == "p" else 0 if node.tag in HOLDS_P else open_p[-1])
        any_p.append(any_p[-1] or node.tag == "p")

    def pop_to(names, stop) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                cut(i)
                return
            if stack[i].tag in stop:
                return

    n = len(page)
    while at < n:
        low = page.find("<", at)
        if low < 0:
            low = n
        if low > at:
            stack[-1].parts.append(page[at:low])
        if low == n:
            break
        m = TAG.match(page, low)
        if m is None:
            stack[-1].parts.append("<")
            at = low + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not any_p[-1]:
                continue
            stop = () if tag in BLOCKS else BLOCKS - {"p"}
            pop_to({tag}, stop)
            continue
        if tag in ENDS_P and open_p[-1]:
            cut(open_p[-1])
        if tag in SIBLINGS:
            inside, stop = SIBLINGS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stop:
                    break
                if stack[i].tag in inside:
                    cut(i)
                    if tag not in ("tr", "thead", "tbody", "tfoot"):
                        break
                    pop_to(inside, stop)
                    break
        node = Node(tag, stack[-1], _boilerplate(tag, m[3]))
        stack[-1].parts.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|</{re.escape(tag)}$", re.I).search(page, at)
            node.parts.append(page[at:end.start() if end else n])
            at = end.end() if end else n
            continue
        push(node)
    _settle(root)
    return root


def _order(root: Node) -> list[Node]:
    """Nodes that may hold article text, parents before children."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo.extend(x for x in reversed(node.parts) if isinstance(x, Node) and not x.skip)
    return nodes


def measure(root: Node) -> list[Node]:
    """Composite text density of every node and the sum of its children's densities.

    With C characters, T tags, LC and LT those of links, and Cb and LCb those of the body, a node's
    density is C/T * log_base(C/LC * T/LT), base = ln(C/(C-LC) * LC + LCb/Cb * C + e): characters per
    tag, less the more of them stand in links. Zero counts of T, LC, LT and C-LC count as one.
    """
    nodes = _order(root)
    for node in nodes:
        node.link = node.tag == "a" or node.parent is not None and node.parent.link
    for node in reversed(nodes):
        node.chars += sum(len(SPACE.sub("", html.unescape(x))) for x in node.parts if isinstance(x, str))
        if node.link:
            node.link_chars = node.chars
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (node.tag == "a")
    body = next((x for x in nodes if x.tag == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        if node.chars:
            c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            # base is 1 without links; a base just above 1 would blow the density up, so 2 is the least
            node.density = max(0.0, c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(max(2.0, base)))
        if node.parent is not None:
            node.parent.total += node.density
    return nodes


def _blocks(root: Node, chosen: set[int]) -> list[str]:
    """Texts of the blocks under ``chosen`` nodes in page order: references decoded, white space made one space."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", html.unescape("".join(line))).strip()
        line.clear()
        if text:
            out.append(text)

    todo: list[tuple] = [(root, id(root) in chosen)]
    while todo:
        item, inside = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if inside:
                line.append(item)
        elif item.tag == "br":
            line.append(" ")
        elif not item.skip:
            inside = inside or id(item) in chosen
            if item.tag in BLOCKS:
                flush()
                todo.append((None, False))
            todo.extend((x, inside) for x in reversed(item.parts))
    flush()
    return out


def main_text(page: str) -> str:
    """The article of one page.

    Elements that are no article by kind, class, id, role or hiding are set aside, but none for a name
    alone that holds an ``article``, ``main`` or most of the text. Of the rest the
    node with the largest sum of child densities is found; the least density on its path up to the
    body is the threshold. Every topmost node at or above the threshold holds content, and gives its
    subtree of the largest sum. An ``article`` or ``main`` element around that subtree is taken whole.
    """
    root = parse(page)
    nodes = measure(root)
    if not root.chars:
        return ""
    body = next((x for x in nodes if x.tag == "body" and x.chars), root)
    best = max((x for x in nodes if x.chars), key=lambda x: (x.total, x.density))
    path, up = [], best
    while up is not None:
        path.append(up)
        if up is body:
            break
        up = up.parent
    least = min((x.density for x in path if x.chars), default=0.0)
    chosen: set[int] = set()
    todo = [body if up is body else root]
    while todo:
        node = todo.pop()
        if not node.chars:
            continue
        if node.density < least:
            todo.extend(x for x in node.parts if isinstance(x, Node) and not x.skip)
            continue
        inner, under = node, [node]
        while under:
            x = under.pop()
            if x.total > inner.total:
                inner = x
            under.extend(y for y in x.parts if isinstance(y, Node) and not y.skip)
        around = inner
        while around is not None and around.tag not in ("article", "main"):
            around = around.parent
        chosen.add(id(around or (inner if inner.tag in BLOCKS or inner is root else node)))
    return "\n".join(_blocks(root, chosen))


def extract_main_text(df: DataFrame, html_column: str = "html", text: str = "text") -> DataFrame:
    """``df`` with ``text``, the main text of each whole page.

    Null, empty and text-free pages give an empty text. Pages are independent of each other, so ties,
    repeated rows and empty tables need no rule; a column already named ``text`` is replaced, all
    others are kept. The work on a page grows in proportion to its length.
    """
    rest = df.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([main_text(p.as_py() or "") for p in batch.column(html_column)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, text])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(text, T.StringType())]))
