"""Main text of web pages by composite text density.

Every element gets its link-adjusted characters per tag; an element's density sum adds up the densities of its
children, and the element with the largest sum is the core of the article. The least density on the path from the
core to the body is the threshold: of all that stands beside this path, block elements that reach it belong to the
article, whatever their tag or size, and so do the headings next to the core that come before it. A core inside an
`article` or `main` element stands for that element, and other articles beside it that reach the threshold stay, too.

What is a menu, footer, form, advert, notice, reader comment or hidden by its tag, role or style is taken out before
densities are computed. A class or id only speaks of blocks, never of headings, paragraphs or words inside them, and
not of a block that the article is in. A name made of such words alone (`ad`, `cookie-notice`, `related-posts`) takes
its block out; one that holds other words, too (`related-work`, `search-algorithms`), and an id of a section only where
the block looks the part: a third of its characters are links, or it has fewer characters per tag than the page.

Blocks are the runs of text between block-level tags. Defined cases: null or empty html, and pages without text,
give an empty text; markup that never closes ends with the page; rows that repeat give repeated results; an empty
table gives an empty one; other columns are kept only where asked for.
"""

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_words = str.split
VOID = set(_words("area base br col embed hr img input link meta param source track wbr"))
#: elements whose whole content is no article text
DROPPED = set(_words("script style noscript template head title nav footer aside form button select textarea input "
                     "iframe object embed svg math canvas audio video dialog menu fieldset datalist"))
BLOCKS = set(_words("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup "
                    "option p pre search section summary table tbody td tfoot th thead tr ul caption"))
#: a start tag of these ends an open paragraph
ENDS_P = set(_words("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
                    "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul"))
#: open elements that a start tag ends, and the elements that such an end doesn't cross
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"} - {
    "template", "noscript"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = set(_words("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar"))
#: parts of class names and ids that mark what isn't the article
MARKS = set(_words("ad ads adv advert adverts advertisement advertising adsense adslot adbox banner banners breadcrumb "
                   "breadcrumbs comment comments commentary commentlist disqus cookie cookies consent gdpr "
                   "copyright footer footnav login masthead menu menus modal nav navbar navigation newsletter "
                   "notice notices alert notification overlay pager pagination popup promo promos promotion "
                   "recommended related replies reply respond search share sharing sidebar sidebars signup skip social "
                   "sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets"))
#: words that add nothing to a mark in a name
PLAIN = set(_words("area bar block body bottom box button buttons card column container content element feed foot form global group "
                   "header holder icons in inner item items left link links list main module my outer page panel post posts primary "
                   "right row secondary section side site stories text the title top unit up wrap wrapper zone"))
#: blocks whose name says nothing against their text
TEXTUAL = HEADINGS | set(_words("p pre blockquote figure figcaption caption dt dd td th"))
#: these name outer elements too often to go by the name alone
KEPT = {"html", "body", "article", "main"}
#: elements nested deeper become children of the last one, as browsers have it
DEPTH = 512

_TAG = re.compile(r"<!--(?:.*?--!?>|>|->|.*)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "children", "why", "dropped", "holds", "in_article", "chars", "tags", "link_chars", "link_tags",
                 "density", "total")

    def __init__(self, tag: str, parent: "Node | None", why: str = ""):
        self.tag, self.parent, self.children, self.why = tag, parent, [], why
        self.dropped = self.holds = False
        self.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)
        self.chars = self.link_chars = self.link_tags = 0
        self.tags = 1
        self.density = self.total = 0.0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _excluded(tag: str, attributes: str, parent: Node) -> str:
    """Why an element isn't part of the article: by what it is, or only by its name; empty if neither."""
    if tag in DROPPED or (tag == "header" and not parent.in_article):
        return "kind"
    if not attributes.strip(" /\t\n\r"):
        return ""
    found = _attributes(attributes)
    style = found.get("style", "").replace(" ", "").lower()
    if "hidden" in found or "display:none" in style or "visibility:hidden" in style or found.get("aria-hidden") == "true":
        return "kind"
    if tag in KEPT:
        return "kind" if tag == "article" and _marks(found) & {"comment", "comments", "reply", "replies", "disqus"} else ""
    if found.get("role", "").lower() in ROLES:
        return "kind"
    if tag not in BLOCKS or tag in TEXTUAL:
        return ""
    by_class, by_id = (_strength(found.get(name, "")) for name in ("class", "id"))
    if by_class == 2 or (by_id == 2 and tag != "section"):
        return "name"
    return "hint" if by_class or by_id else ""


def _strength(names: str) -> int:
    """2 if one of the names is made of marks alone, 1 if one holds a mark, else 0."""
    best = 0
    for name in _CAMEL.sub("-", names).lower().split():
        parts = set(_NAME_PART.findall(name))
        if parts & MARKS:
            best = max(best, 2 if all(p in MARKS or p in PLAIN or p.isdigit() for p in parts) else 1)
    return best


def _marks(attributes: dict[str, str]) -> set[str]:
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return set(_NAME_PART.findall(_CAMEL.sub(" ", names).lower()))


def parse(html: str) -> list[Node]:
    """All elements in page order, the page itself first; texts stand among the children."""
    root = Node("html", None)
    nodes, stack, at = [root], [root], 0

    def close(names: set[str], border: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in border:
                return
            if stack[k].tag in names:
                del stack[k:]
                close(names, border)
                return

    while at < len(html):
        found = _TAG.search(html, at)
        end = found.start() if found else len(html)
        if end > at:
            stack[-1].children.append(html[at:end])
        if not found:
            break
        at = found.end()
        tag = found[2]
        if tag is None:
            if found[0].startswith("<![CDATA["):
                stack[-1].children.append(found[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if found[1]:
            if tag == "p" and all(n.tag != "p" for n in stack):
                stack[-1].children.append(Node("p", stack[-1]))
                nodes.append(stack[-1].children[-1])
            elif any(n.tag == tag for n in stack[1:]):
                close_to = max(k for k in range(1, len(stack)) if stack[k].tag == tag)
                if tag in BLOCKS or not any(n.tag in BLOCKS for n in stack[close_to + 1:]):
                    del stack[close_to:]
            continue
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        if tag in ENDS_P:
            close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        parent = stack[-1]
        node = Node(tag, parent, _excluded(tag, found[3], parent))
        parent.children.append(node)
        nodes.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            last = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            stop = last.start() if last else len(html)
            node.children.append(html[at:stop])
            at = stop
            stack.append(node)
            continue
        if len(stack) < DEPTH and (not found[3].endswith("/") or tag in BLOCKS or tag in ("a", "b", "i", "em", "span", "strong")):
            stack.append(node)
    return nodes


def _count(nodes: list[Node]) -> None:
    """Characters and tags of every element that isn't dropped, and those of its links."""
    for node in nodes:
        node.chars = node.link_chars = node.link_tags = 0
        node.tags = 0 if node.dropped else 1
    for node in reversed(nodes):  # children come after their parents
        if node.dropped:
            continue
        for child in node.children:
            if isinstance(child, str):
                node.chars += len("".join(child.split()))
            else:
                node.chars += child.chars
                node.tags += child.tags
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1


def _drop(nodes: list[Node]) -> None:
    """Take out elements with all they hold; for a name, like `sidebar`, not those that the article is in."""
    for node in nodes:
        node.dropped = (node.parent is not None and node.parent.dropped) or node.why == "kind" or (
            node.why == "name" and not node.holds)


def measure(nodes: list[Node]) -> Node:
    """Fill in densities and sums; the body, or the page where there is none."""
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    for node in reversed(nodes):
        node.holds |= node.tag in ("article", "main") and not node.why
        if node.holds and node.why != "kind" and node.parent is not None:
            node.parent.holds = True
    _drop(nodes)
    _count(nodes)
    hints = [n for n in nodes if n.why == "hint" and not n.dropped]
    if hints:
        for node in hints:  # a hint counts where the block looks the part
            if node.link_chars * 3 >= node.chars or node.chars * body.tags < body.chars * node.tags:
                node.why = "name"
        _drop(nodes)
        _count(nodes)
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        if node.dropped or not node.chars:
            continue
        plain = max(node.chars - node.link_chars, 1)
        base = log(node.chars / plain * node.link_chars + share * node.chars + e)
        value = node.chars / max(node.link_chars, 1) * node.tags / max(node.link_tags, 1)
        node.density = node.chars / node.tags * max(0.0, log(value) / max(log(base), 1e-9)) if base > 1 else 0.0
        if base <= e + 1e-9:  # the logarithm's base has its least value
            node.density = node.chars / node.tags * max(0.0, log(value))
        if node.parent is not None:
            node.parent.total += node.density
    return body


def _within(node: Node, top: Node) -> bool:
    while node is not None and node is not top:
        node = node.parent
    return node is top


def article(nodes: list[Node]) -> list[Node]:
    """The elements that make up the article, in page order."""
    body = measure(nodes)
    inside = [n for n in nodes if not n.dropped and n.chars and _within(n, body)]
    if not inside:
        return []
    core = max(inside, key=lambda n: n.total)  # the first of equal sums
    if core.total <= 0:
        core = body
    above = core
    while above is not None and above.tag not in ("article", "main"):
        above = above.parent
    if above is not None:
        return _articles(above, body)
    if core is body or core.parent is None:
        return [core]
    path = [core]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold, spine = min(n.density for n in path), set(map(id, path))
    found, todo = [], [body]
    where = next(k for k, n in enumerate(core.parent.children) if n is core)
    titles = {id(n) for n in core.parent.children[:where] if isinstance(n, Node) and n.tag in HEADINGS}
    while todo:  # in page order
        node = todo.pop()
        if node is core or id(node) in titles or (id(node) not in spine and node.tag in BLOCKS and node.density >= threshold):
            found.append(node)
        else:
            todo.extend(n for n in reversed(node.children) if isinstance(n, Node) and not n.dropped and n.chars)
    return found


def _articles(found: Node, body: Node) -> list[Node]:
    """An `article` or `main` element, and the articles beside it that are as dense as its path up to the body."""
    around = found.parent
    while around is not None and around.tag != "main" and around is not body:
        around = around.parent
    if found.tag == "main" or around is None:
        return [found]
    least, node, kept, todo = found.density, found, [], [around]
    while node is not body and node.parent is not None:
        node = node.parent
        least = min(least, node.density)
    while todo:  # in page order; an article inside another belongs to it
        node = todo.pop()
        if node is found or (node.tag == "article" and node.density >= least):
            kept.append(node)
        else:
            todo.extend(n for n in reversed(node.children) if isinstance(n, Node) and not n.dropped and n.chars)
    return kept if any(n is found for n in kept) else [found]


def main_text(html: str) -> str:
    """The article's blocks, joined by line breaks."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append(text)

    for top in article(parse(html)):
        todo: list = [top]
        while todo:
            item = todo.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                run.append(item)
            elif not item.dropped:
                if item.tag == "br":
                    run.append(" ")
                if item.tag in BLOCKS:
                    flush()
                    todo.append(None)
                todo.extend(reversed(item.children))
            elif item.tag in BLOCKS:
                flush()
        flush()
    return "\n".join(blocks)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("i"), F.col(f"`{url}`").cast("string").alias("u"),
                        F.col(f"`{html}`").cast("string").alias("h"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
