"""Main text of web pages by composite text density.

A tolerant parser builds the DOM. Each node gets the characters C and tags T below it and, of
those, the characters LC and tags LT inside links. Its composite density is

    C / T * log(C * T / (LC * LT)) / log(ln(C * LC / notLC + LC_body * C / C_body + e))

(a zero count is taken as 1), so a link-heavy node scores low. The density sum of a node adds up
its children's densities. The subtree with the largest sum, of elements that hold blocks, is the core of the main text, and the
lowest density on the path from it up to the body is the threshold: the core and every other subtree of
the body whose density reaches it are main text.

Tags are a prior beside that. What HTML defines as something else (menus, footers, asides, forms, dialogs, scripts,
styles, hidden parts, a header outside the core) is never text. A node named like boilerplate (adverts, notices,
comments and so on) is dropped unless it holds the core; where the name is one that articles use too, only
if links or shortness speak for it as well: density below the threshold. The core grows to an ``article`` or ``main`` element around it if it has most of that element's text, and a
heading needs a third of the threshold. Pages without any such tags or names are decided by
density alone. Block elements delimit blocks; inside one, white space is one space.

Edge cases: a null page is an empty one; an empty page, one without text and one that is all boilerplate
give an empty text; unclosed, stray and badly nested tags never fail; nothing is capped, and depth
is handled without recursion; repeated rows are rows of their own; an empty table gives an empty result; columns
other than those named are not read, whatever their names. Pages are independent rows: there is no shuffle.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.common import lean, ship_package

TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed xmp template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Never text, as HTML defines them.
JUNK = frozenset("script style noscript template iframe object embed svg canvas audio video map nav footer aside form button select textarea input dialog menu head title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Names of boilerplate, and names that boilerplate shares with parts of articles.
NAMES, SHARED = (
    re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-]|\d)", re.I)
    for words in (
        "ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|cookie|cookies|consent|gdpr|notice|notices|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|"
        "newsletter|subscribe|paywall|footer|masthead|topbar|comment|comments|disqus|respond|replies|pagination|pager|copyright",
        "promotion|banner|alert|toc|aside|widget|related|recommended|share|sharing|social|subscription|signup|login|header|reply|legal|skip|hidden",
    )
)
#: Elements that hold blocks: one paragraph, item or heading is never the whole text of a page that has more.
HOLDS = frozenset("article body center dd details div fieldset figure html li main section table tbody td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Opening one of these closes an open one of the others, up to the element that bounds it.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "thead": ("tr td th thead tbody tfoot", "table"), "tbody": ("tr td th thead tbody tfoot", "table"), "tfoot": ("tr td th thead tbody tfoot", "table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
BOUNDS = frozenset("table td th caption button object applet marquee".split())


class Node:
    __slots__ = ("tag", "up", "below", "attrs", "c", "t", "lc", "lt", "density", "total")

    def __init__(self, tag: str, up: Node | None, attrs: str = ""):
        self.tag, self.up, self.attrs = tag, up, attrs
        self.below: list[Node | str] = []


def parse(page: str) -> Node:
    root = node = Node("#root", None)
    at = 0
    while True:
        m = TOKEN.search(page, at)
        if m is None or m.start() > at:
            text = page[at : m.start() if m else len(page)]
            if text:
                node.below.append(entities.unescape(text) if "&" in text else text)
        if m is None:
            return root
        at, tag = m.end(), m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            bound, x = tag in BOUNDS or tag in ("ul", "ol", "article", "div", "section", "main", "body", "html", "aside", "nav", "footer", "header", "form"), node
            while x is not root and x.tag != tag and (bound or x.tag not in BOUNDS):
                x = x.up
            if x is not root and x.tag == tag:
                node = x.up
            elif tag == "br":
                node.below.append(Node("br", node))
            continue
        if tag in BLOCK:  # a block closes an open paragraph, and what is open inside it
            x = node
            while x is not root and x.tag not in BOUNDS and (x.tag == "p" or x.tag not in BLOCK):
                if x.tag == "p":
                    node = x.up
                    break
                x = x.up
        if tag in CLOSES:
            shut, bound = CLOSES[tag]
            x = node
            while x is not root and x.tag not in bound:
                if x.tag in shut:
                    node = x.up
                x = x.up
        new = Node(tag, node, m[3])
        node.below.append(new)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if end is None:
                if tag in ("script", "style"):
                    return root
                continue
            new.below.append(page[at : end.start()])
            close = page.find(">", end.start())
            at = close + 1 if close >= 0 else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            node = new


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(node.attrs)} if node.attrs.strip(" /") else {}


def is_other(node: Node) -> bool:
    """Whether a node is no text by what HTML says of it."""
    if node.tag in JUNK:
        return True
    attrs = attributes(node)
    return bool(
        "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in ROLES
        or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I)
    )


def named(node: Node, names: re.Pattern) -> bool:
    attrs = attributes(node)
    return bool(names.search(re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{attrs.get('class', '')} {attrs.get('id', '')}")))


def walk(root: Node) -> list[Node]:
    """The nodes, each before those below it, without recursion."""
    out, open_ = [], [root]
    while open_:
        node = open_.pop()
        out.append(node)
        open_ += [x for x in reversed(node.below) if not isinstance(x, str)]
    return out


def measure(root: Node) -> list[Node]:
    nodes = walk(root)
    for x in reversed(nodes):
        x.c = x.t = x.lc = x.lt = 0
        for y in x.below:
            if isinstance(y, str):
                x.c += len(SPACE.sub("", y))
            else:
                x.c, x.t, x.lc, x.lt = x.c + y.c, x.t + y.t + 1, x.lc + y.lc, x.lt + y.lt
        if x.tag == "a":
            x.lc, x.lt = x.c, x.t + 1
    ratio = root.lc / max(root.c, 1)
    for x in reversed(nodes):
        if x.c:
            c, t, lc, lt = x.c, max(x.t, 1), max(x.lc, 1), max(x.lt, 1)
            base = math.log(c / max(c - x.lc, 1) * x.lc + ratio * c + math.e)
            x.density = max(0.0, c / t * math.log(max(c * t / (lc * lt), 1.0)) / math.log(max(base, 1.0) + 1.0))
        else:
            x.density = 0.0
        x.total = sum(y.density for y in x.below if not isinstance(y, str))
    return nodes


def blocks(nodes: list[Node]) -> list[str]:
    """Text blocks below the nodes, in page order."""
    out: list[str] = []
    run: list[str] = []

    def shut() -> None:
        text = SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    for top in nodes:
        todo: list[Node | str | None] = [top]
        while todo:
            x = todo.pop()
            if x is None:
                shut()
            elif isinstance(x, str):
                run.append(x)
            elif x.tag == "br":
                run.append(" ")
            else:
                if x.tag in BLOCK:
                    shut()
                    todo.append(None)
                todo += reversed(x.below)
        shut()
    return out


def path(node: Node, body: Node) -> list[Node]:
    """The node and those above it, up to the body."""
    out = [node]
    while out[-1] is not body:
        out.append(out[-1].up)
    return out


def prune(body: Node, drop) -> None:
    todo = [body]
    while todo:
        x = todo.pop()
        x.below = [y for y in x.below if isinstance(y, str) or not drop(y)]
        todo += [y for y in x.below if not isinstance(y, str)]


def find_core(body: Node) -> tuple[Node | None, float]:
    """(the subtree of the largest density sum, the threshold); None where there is no text."""
    nodes = measure(body)
    if not body.c:
        return None, 0.0
    core = max([x for x in nodes if x.tag in HOLDS or x is body], key=lambda x: x.total)  # the first in page order of equal ones
    return core, min(x.density for x in path(core, body))


def main_text(page: str | None) -> str:
    root = parse(page or "")
    body = next((x for x in walk(root) if x.tag == "body"), root)
    prune(body, is_other)
    core, least = find_core(body)
    if core is None:
        return ""
    holds = set(map(id, path(core, body)))
    inside = set(map(id, walk(core)))
    around = {id(y) for x in path(core, body) if x.tag in ("article", "main") for y in walk(x)}
    prune(body, lambda x: id(x) not in holds and (named(x, NAMES) or (named(x, SHARED) and (x.density < least or 2 * x.lc > x.c)) or (x.tag == "header" and id(x) not in inside and id(x) not in around)))
    core, least = find_core(body)
    if core is None:
        return ""
    for x in path(core, body):
        if x.tag in ("article", "main") and 2 * core.c >= x.c:
            core = x
    above = set(map(id, path(core, body)))
    kept, todo = [], [body]
    while todo:
        x = todo.pop()
        if x is core or (id(x) not in above and x.c and x.density >= (least / 3 if x.tag in HEADINGS else least)):
            kept.append(x)
        elif x is not core:
            todo += [z for z in reversed(x.below) if not isinstance(z, str)]
    return "\n".join(blocks(kept))


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [main_text(x) for x in batch.column(len(keep)).to_pylist()]
                cols = [*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "text", "n_chars"])

    ship_package(pages.sparkSession)
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars long"
    return pages.select(*keep, html_col).mapInArrow(lean(run), schema)
