"""Main text of web pages by tree scoring.

A page is read into a tree of its blocks (inline markup only marks links). Every paragraph has points for its length and
its commas and passes them to its ancestors: all to the parent, half to the grandparent, a shrinking part up to
``REACH`` levels. Element and class names add a weight, and a container's sum is discounted by the share of its text in
links. The best container is kept, with those of its siblings that score like it, hold prose, or head it; from the kept
blocks go navigation, headers, footers, sidebars, notices, adverts, forms, comments and lists of nothing but links.

What is told by element (``nav``, ``form``, ...), role or class name is set aside before scoring, unless it is a wrapper:
a form that holds an ``article`` or a ``main``, or a block with such a name that also holds most of the page's text. Comments and
notices of consent are never wrappers.

The work is linear in the page: no cap on length, depth or number of blocks.
"""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare

REACH = 5
LINKED_LIST = 0.8

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: From the end of a tag's name to its end; a quote counts only after an equals sign.
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s/>="']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_COMMAS = str.maketrans(dict.fromkeys("，、،﹐﹑", ","))

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup; that of the last two has character references.
_RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture map area source track param math".split()
)
#: Elements that are never text of an article.
_SILENT = frozenset("head script style noscript template title iframe object embed applet svg canvas audio video select datalist textarea button label fieldset dialog menu xmp noembed noframes".split())
_FURNITURE = frozenset("nav aside footer header form".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
_LEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: An element that opens closes one of these that is open, up to the nearest of the bounds.
_P_CLOSERS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd".split()
)
_CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset("tbody thead tfoot caption".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot caption".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot caption".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
_P_BOUNDS = frozenset("table td th caption button article section body html".split())
_BOUNDS = frozenset("table td th caption html".split())

#: Words of class names and ids.
_JUNK = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner banners billboard "
    "cookie cookies consent gdpr ccpa notice notices notification notifications alert disclaimer paywall "
    "sidebar sidebars sidenav aside rail nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs topbar toolbar masthead header footer foot footnav colophon skip "
    "comment comments commentlist disqus respond reply replies discussion "
    "share sharing social socials related recommended recommendations trending newsletter subscribe subscription signup signin login popup modal overlay lightbox widget widgets "
    "pager pagination paging search searchbox form copyright legal outbrain taboola tags hidden".split()
)
#: Of these, what never wraps an article.
_OTHERS = frozenset("comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr ccpa".split())
_CONTENT = frozenset("article post entry story content main maincontent body text hentry prose".split())
#: Where a header is that of an article.
_TITLED = frozenset("article post entry story hentry".split())
#: Ancestors of all text: their names mean nothing.
_ROOTS = frozenset(["html", "body"])


@dataclass(slots=True)
class Node:
    """A block: its place in the tree, what is known from its tag, and its sums."""

    tag: str
    parent: int
    junk: bool = False
    silent: bool = False
    wraps: bool = False  # may be a wrapper though it is named as junk
    header: bool = False  # junk only as a header
    titled: bool = False  # an article, whose headers are its own
    good: bool = False
    nested: int = 0  # open inline elements of the same name inside an inline one
    weight: float = 0.0
    parts: list = field(default_factory=list)  # children by number, and runs of own text
    points: float = 0.0
    chars: int = 0
    linked: int = 0
    whole: int = 0  # characters of all text below
    anchored: bool = False  # holds an article or a main


def _kind(node: Node, attributes: str) -> None:
    tag = node.tag
    node.silent = tag in _SILENT
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or ""
        found.setdefault(m[1].lower(), value[1:-1] if value[:1] in "\"'" else value)
    if tag in _ROOTS:
        return
    style = found.get("style", "").lower().replace(" ", "")
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        node.silent = True
    names = {x.lower() for x in _TOKENS.findall(f"{found.get('class', '')} {found.get('id', '')}")}
    role, bad = found.get("role", "").lower(), names & _JUNK
    node.junk = tag in _FURNITURE or role in _ROLES or bool(bad)
    node.header = (tag == "header" or tag not in _FURNITURE and bad == {"header"}) and bad <= {"header"} and role not in _ROLES
    node.wraps = tag not in ("nav", "aside", "footer", "header") and role not in _ROLES - {"form"} and bad.isdisjoint(_OTHERS)
    node.good = not node.junk and (tag in ("article", "main") or role in ("main", "article") or not names.isdisjoint(_CONTENT))
    node.titled = node.good and (tag in ("article", "main") or not names.isdisjoint(_TITLED))
    if node.good:
        node.weight += 25
    if tag == "div":
        node.weight += 5
    elif tag in ("pre", "td", "blockquote"):
        node.weight += 3
    elif tag in ("address", "ol", "ul", "dl", "dd", "dt", "li"):
        node.weight -= 3
    elif tag in _LEADING or tag == "th":
        node.weight -= 5


def parse(page: str) -> list[Node]:
    """The blocks of a page in page order; parents come before children, the first is the root."""
    nodes = [Node("html", -1)]
    stack, link, at, size = [0], False, 0, len(page)
    text: list[str] = []  # the run of the open block: inline text with character references resolved

    def close_run():
        nonlocal text
        if text:
            nodes[stack[-1]].parts.append(text)
            text = []

    def say(raw: str):
        if raw:
            text.append((references.unescape(raw) if "&" in raw else raw, link))

    def pop_to(depth: int):
        close_run()
        del stack[depth:]

    def find_open(tags, bounds) -> int:
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in tags:
                return k
            if tag in bounds:
                return 0
        return 0

    paragraphs = 0  # open p elements: most blocks needn't look for one
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            say(page[at:])
            break
        if begin > at:
            say(page[at:begin])
        after = page[begin + 1 : begin + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", begin):
                # "<!-->" and "<!--->" are whole comments.
                short = next((s for s in ("<!-->", "<!--->") if page.startswith(s, begin)), None)
                end = begin + len(short) - 3 if short else page.find("-->", begin + 4)
                at = size if end < 0 else end + 3
            elif page.startswith("<![CDATA[", begin):
                end = page.find("]]>", begin)
                say(page[begin + 9 : size if end < 0 else end].replace("&", "&amp;"))
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", begin)
                at = size if end < 0 else end + 1
            continue
        closing = after == "/"
        name = _NAME.match(page, begin + 1 + closing)
        if not name:
            if closing:  # a comment by the rules of markup
                end = page.find(">", begin)
                at = size if end < 0 else end + 1
            else:
                say("<")
                at = begin + 1
            continue
        rest = _REST.match(page, name.end())
        if not rest:  # a tag that never ends takes the rest of the page
            break
        tag, at = name[0].lower(), rest.end()
        if closing:
            if tag == "a":
                link = False
            if tag in _INLINE:
                top = nodes[stack[-1]]
                if top.tag == tag and top.nested:
                    top.nested -= 1
                elif top.tag == tag:
                    pop_to(len(stack) - 1)
            elif tag in ("br", "p") and not (tag == "p" and find_open(("p",), _P_BOUNDS)):
                close_run()
            elif tag not in _VOID:
                depth = find_open((tag,) if tag not in _LEADING else _LEADING, () if tag not in ("p", "li") else _BOUNDS)
                if depth:
                    pop_to(depth)
                else:
                    close_run()
            continue
        if tag == "a":
            link = bool(re.search(r"\bhref\b", rest[1], re.I))
        if tag in _INLINE:
            # Inline elements that nobody sees, or that are named as adverts and the like, are left out as blocks are.
            probe = Node(tag, -1)
            if rest[1].strip():
                _kind(probe, rest[1])
            if not (probe.junk or probe.silent) or tag in _VOID:
                top = nodes[stack[-1]]
                top.nested += top.tag == tag and tag not in _VOID
                continue
        elif tag in _VOID:
            if tag in ("br", "hr"):
                text.append((" ", link)) if tag == "br" else close_run()
            continue
        if tag in ("html", "body"):
            continue
        if tag in _P_CLOSERS and paragraphs:
            depth = find_open(("p",), _P_BOUNDS)
            if depth:
                pop_to(depth)
        if tag in _CLOSES:
            depth = find_open(*_CLOSES[tag])
            if depth:
                pop_to(depth)
        close_run()
        node = Node(tag, stack[-1])
        _kind(node, rest[1])
        nodes[stack[-1]].parts.append(len(nodes))
        if tag in _RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            nodes.append(node)
            if not end:
                break
            close = page.find(">", end.end())
            at = size if close < 0 else close + 1
            continue
        if tag == "p":
            paragraphs += 1
        stack.append(len(nodes))
        nodes.append(node)
        if rest[1].endswith("/") and tag in ("svg", "math"):
            stack.pop()
    close_run()
    return nodes


def squeeze(run: list[tuple[str, bool]]) -> str:
    """The text of a run: each stretch of white space is one space, none at the ends."""
    return " ".join("".join(t for t, _ in run).split())


def _prune(nodes: list[Node]) -> list[bool]:
    """Which nodes go: silent ones, and junk that isn't a wrapper, each with all below it."""
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if n.silent:
            n.whole = 0
            continue
        n.whole += sum(len(t) for part in n.parts if isinstance(part, list) for t, _ in part)
        if i:
            up = nodes[n.parent]
            up.whole += n.whole
            up.anchored |= n.anchored or n.good and n.tag in ("article", "main")
    titled, gone = [False] * len(nodes), [False] * len(nodes)
    for i, n in enumerate(nodes):
        if i == 0:
            continue
        titled[i] = titled[n.parent] or nodes[n.parent].titled
        junk = n.junk and not (n.wraps and n.anchored and (n.tag == "form" or 2 * n.whole > nodes[0].whole))
        # The header of an article holds its title.
        if junk and n.header and titled[i] and any(isinstance(c, int) and nodes[c].tag in _LEADING for c in n.parts):
            junk = False
        gone[i] = gone[n.parent] or n.silent or junk
    return gone


def _measure(nodes: list[Node], gone: list[bool]) -> None:
    """Sums of characters, linked characters and points of every node that stays."""
    for i, n in enumerate(nodes):
        if gone[i]:
            continue
        own = linked = commas = 0
        for part in n.parts:
            if isinstance(part, list):
                own += len(squeeze(part))
                linked += sum(len("".join(t.split())) for t, link in part if link)
                commas += sum(t.translate(_COMMAS).count(",") for t, _ in part)
        n.chars, n.linked = n.chars + own, n.linked + min(linked, own)
        if not own:
            continue
        points = (own >= 25) + commas + min(own / 100, 3)
        points *= 1 - min(linked, own) / own
        # A block's own text is a paragraph of the block itself where it holds other blocks too.
        up, level = (i, 0) if any(isinstance(p, int) for p in n.parts) else (n.parent, 0)
        while up >= 0 and level < REACH:
            nodes[up].points += points / (1, 2, 6, 9, 12)[level]
            up, level = nodes[up].parent, level + 1
    for i in range(len(nodes) - 1, 0, -1):
        if not gone[i]:
            up = nodes[nodes[i].parent]
            up.chars, up.linked = up.chars + nodes[i].chars, up.linked + nodes[i].linked


def _density(n: Node) -> float:
    return n.linked / n.chars if n.chars else 0.0


def _choose(nodes: list[Node], gone: list[bool]) -> tuple[list[int], float]:
    """The kept blocks in page order, and the score of the best container."""
    score = [0.0] * len(nodes)
    best = 0
    for i, n in enumerate(nodes):
        if gone[i] or not n.points:
            continue
        score[i] = (n.points + max(n.weight, -n.points / 2)) * (1 - _density(n))
        if score[i] > score[best] or best == 0 and i:
            best = i
    if not score[best]:
        # No block passes a point: what is named as the article, else all that is left.
        best = next((i for i, n in enumerate(nodes) if n.good and not gone[i]), 0)
    top = best
    while top > 0 and not (nodes[top].tag in ("article", "main") and not nodes[top].junk):
        top = nodes[top].parent
    if top > 0:
        return [top], score[best]
    # A container that is its parent's only one with text stands for it.
    while best > 0 and nodes[best].parent > 0 and nodes[nodes[best].parent].chars == nodes[best].chars:
        best = nodes[best].parent
    if best == 0:
        return [0], score[0]
    kept, found = [], False
    for part in nodes[nodes[best].parent].parts:
        if isinstance(part, list) or gone[part]:
            continue
        n = nodes[part]
        if part == best:
            found = True
            kept.append(part)
        elif n.tag in _LEADING and not found and n.chars:
            kept.append(part)
        elif score[part] >= max(10, score[best] / 5) or n.tag == "p" and n.chars and _density(n) < 0.25 and (n.chars >= 80 or not n.linked):
            kept.append(part)
    return kept, score[best]


def main_text(page: str | None) -> tuple[str, int, float]:
    """The text of a page's article, its number of blocks, and the score of its container."""
    if not page:
        return "", 0, 0.0
    nodes = parse(page)
    gone = _prune(nodes)
    _measure(nodes, gone)
    kept, score = _choose(nodes, gone)
    out = []
    todo = [(part, 0) for part in reversed(kept)]
    while todo:
        i, k = todo.pop()
        n = nodes[i]
        if k == 0 and (gone[i] or n.tag in ("ul", "ol", "dl") and _density(n) >= LINKED_LIST and i not in kept):
            continue
        for k in range(k, len(n.parts)):  # noqa: PLW2901
            part = n.parts[k]
            if isinstance(part, int):
                todo += [(i, k + 1), (part, 0)]
                break
            block = squeeze(part)
            if block:
                out.append(block)
    return " ".join(out), len(out), round(score, 6)


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``pages`` (all but the html by default) in the struct ``page``, and ``text``, ``n_blocks`` and
    ``score`` of each page's main text; one row per row, no shuffle.

    Null and empty html, and pages without an article, have an empty text. Equal rows give equal rows; columns of any name
    may be kept, for they lie in the struct. White space is what Python's ``str.split`` takes for it, no-break spaces too.
    """
    prepare(pages.sparkSession)
    keep = [c for c in pages.columns if c != html] if keep is None else keep
    if not keep:
        raise ValueError("keep at least one column")
    row = T.StructType([pages.schema[c] for c in keep])
    schema = T.StructType([T.StructField("page", row, False), T.StructField("text", T.StringType()), T.StructField("n_blocks", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            found = [main_text(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], ["page", "text", "n_blocks", "score"])

    return pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("page"), F.col(f"`{html}`").cast("string").alias("html")).mapInArrow(run, schema)
