"""HTML extraction by tree scoring.

Blocks of text pass points for their length and commas to the elements above them, halved from level to level; an element's points are
then discounted by the share of its text that stands in links. Around the best container an article or main element bounds what is kept;
where there is none, the siblings of the container and of what it stands in are kept too, but for those whose text is mostly links. Menus,
notices, forms, reader comments and the like are left out wherever they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from tallymill.llm.common import table, with_fields

# Element names of the HTML standard by their role, and words in class and id attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Elements that never hold main text.
DROPPED = frozenset("script style template noscript nav header footer aside form button select option textarea input iframe object embed svg math canvas audio video dialog menu head title fieldset".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul caption".split())
#: Elements whose end tags may be left out, and what ends them.
CLOSED_BY = {"p": BLOCKS - {"br", "body", "html", "head"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
SCOPES = frozenset("html body table td th ul ol dl article section div main aside nav header footer form blockquote".split())
UNWANTED = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|header|login|menu|modal|nav\w*|newsletter|notice|pagination|pager|popup|promo\w*|recommend\w*|related|replies|respond|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscri\w+|tags|toolbar|widget)(?:$|[\s_-])", re.I)
#: In classes and ids of paragraphs and headings only these words tell that they are no text; of articles only the second.
ADVERTS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|cookies?|consent|promo\w*|sponsor\w*)(?:$|[\s_-])", re.I)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|repl(?:y|ies)|respond)(?:$|[\s_-])", re.I)
TEXT = frozenset("p h1 h2 h3 h4 h5 h6".split())
WANTED = frozenset("article articlebody body content entry main post story text".split())
#: A class that only says what a page has, such as with-sidebar.
ABOUT = re.compile(r"(?:has|with|without|no|is)[_-]", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
BONUS = {"article": 25.0, "main": 25.0, "section": 5.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "form": -50.0}
#: Levels that points climb, and the share of links in a text from which a block beside the container is a menu.
LEVELS, MENU = 5, 0.5
#: Elements nested deeper than this, as in browsers, stand beside one another, so that no walk up the tree is long.
MOST_DEPTH = 512

_tag = re.compile(r"<(?:!--.*?(?:-->|$)|[!?][^>]*>?|/([a-zA-Z][^\s>/]*)[^>]*>?|([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?)", re.S)
_attribute = re.compile(r"(?:^|\s|/)(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: White space. Signs without width are part of their words.
_blank = re.compile(r"\s+")


class Node:
    """An element; children are nodes and strings."""

    __slots__ = ("attributes", "children", "depth", "links", "name", "parent", "points", "size", "unwanted")

    def __init__(self, name: str, parent: Node | None = None, attributes: str = ""):
        self.name, self.parent, self.attributes, self.children = name, parent, attributes, []
        self.points, self.size, self.links, self.unwanted = 0.0, 0, 0, False
        self.depth = parent.depth + 1 if parent else 0


def parse(html: str) -> Node:
    """A forgiving tree: end tags without a start are passed over, open elements end with what holds them, and a paragraph, item or cell ends where the next begins."""
    from html import unescape

    top = here = Node("#top")
    at, end = 0, len(html)

    def add(text: str) -> None:
        if text:
            here.children.append(unescape(text) if "&" in text else text)

    while at < end:
        match = _tag.search(html, at)
        if match is None:
            add(html[at:])
            break
        add(html[at : match.start()])
        at = match.end()
        if match[2]:
            name = match[2].lower()
            while here.name in CLOSED_BY and name in CLOSED_BY[here.name]:
                here = here.parent
            if name in BLOCKS and name not in ("br",):
                # inline elements left open do not reach into the next block, nor does the paragraph they stand in
                up = here
                while up.parent is not None and up.name not in SCOPES and up.name != "#top":
                    if up.name in CLOSED_BY and name in CLOSED_BY[up.name]:
                        here = up.parent
                    up = up.parent
            if here.depth == MOST_DEPTH:
                here = here.parent
            node = Node(name, here, match[3] or "")
            here.children.append(node)
            if name in VOID or (match[3] or "").endswith("/") and name not in BLOCKS and name not in RAW:
                continue
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s>/])[^>]*>?", re.I).search(html, at)
                if name in ("title", "textarea"):
                    node.children.append(unescape(html[at : close.start() if close else end]))
                at = close.end() if close else end
                continue
            here = node
        elif match[1]:
            name, up = match[1].lower(), here
            while up is not None and up.name != name:
                up = None if up.name in SCOPES and name not in SCOPES and name not in BLOCKS else up.parent
            if up is not None and up.parent is not None:
                here = up.parent
        elif match[0] == "<":
            add("<")
    return top


def _look(node: Node) -> bool:
    """Whether an element is left out by its name or attributes."""
    if node.name in DROPPED:
        return True
    if not node.attributes:
        return False
    found = {k.lower(): next((v for v in values if v), "") for k, *values in _attribute.findall(node.attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")):
        return True
    if found.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"):
        return True
    if node.name in ("html", "body", "main"):
        return False
    words = COMMENTS if node.name == "article" else ADVERTS if node.name in TEXT else UNWANTED
    classes = [c for c in found.get("class", "").lower().split() if not ABOUT.match(c)]
    return bool(words.search(found.get("id", ""))) or not WANTED & set(classes) and any(words.search(c) for c in classes)


def _walk(node: Node) -> Iterator[Node]:
    """All elements that may hold main text, parents first."""
    stack = [node]
    while stack:
        here = stack.pop()
        yield here
        stack += [c for c in reversed(here.children) if isinstance(c, Node) and not c.unwanted]


def _is_block(node: Node) -> bool:
    return node.name in BLOCKS


def score(top: Node) -> list[Node]:
    """Marks unwanted elements, counts text and links, and deals out points; gives the elements, parents first."""
    stack = [top]
    while stack:
        for child in (c for c in stack.pop().children if isinstance(c, Node)):
            child.unwanted = _look(child)
            if not child.unwanted:
                stack.append(child)
    order = list(_walk(top))
    commas: dict[int, int] = {}
    for node in reversed(order):
        own = [c for c in node.children if isinstance(c, str)]
        inner = [c for c in node.children if isinstance(c, Node) and not c.unwanted]
        node.size = sum(len(_blank.sub(" ", c).strip()) for c in own) + sum(c.size for c in inner)
        node.links = node.size if node.name == "a" else sum(c.links for c in inner)
        commas[id(node)] = sum(c.count(",") for c in own) + sum(commas[id(c)] for c in inner if not _is_block(c))
    for node in order:
        # the text of a block that stands outside its inner blocks
        own = node.size - sum(c.size for c in node.children if isinstance(c, Node) and not c.unwanted and _is_block(c))
        if not _is_block(node) or own < 1:
            continue
        points = own / 100 + 1 + commas[id(node)]
        up, level = node.parent, 1
        while up is not None and level <= LEVELS:
            up.points += points / 2 ** (level - 1)
            up, level = up.parent, level + 1
    for node in order:
        node.points = (node.points + BONUS.get(node.name, 0.0)) * (1 - node.links / max(1, node.size)) if node.size else 0.0
    return order


def _best(order: list[Node]) -> Node | None:
    """The element with the most points; among equals the outermost."""
    best = max((n for n in order if n.size), key=lambda n: n.points, default=None)
    # what is left of a page without points is taken whole
    return order[0] if best is not None and best.points <= 0 else best


def _kept(best: Node) -> list[Node | str]:
    """What stays, in page order: the article or main element around the best one, or else the best one and all beside the way up to it that isn't a menu."""
    around = best
    while around is not None and around.name not in ("article", "main"):
        around = around.parent
    if around is not None:
        if around.name == "article":  # an article in an article is a comment on it
            for node in _walk(around):
                node.unwanted = node is not around and node.name == "article"
        return [around]
    before, after, here = [], [], best
    while here.parent is not None:
        at = next(i for i, c in enumerate(here.parent.children) if c is here)
        plain = lambda c: isinstance(c, str) or not c.unwanted and not (_is_block(c) and c.links >= MENU * max(1, c.size))
        before = [c for c in here.parent.children[:at] if plain(c)] + [_EDGE] * _is_block(here) + before
        after += [_EDGE] * _is_block(here) + [c for c in here.parent.children[at + 1 :] if plain(c)]
        here = here.parent
    return [*before, best, *after]


#: Parts what stands before and after it, and has no text.
_EDGE = Node("br")


def blocks(nodes: list[Node | str]) -> list[str]:
    """The texts of the blocks in page order, with white space inside a block as one space."""
    out, run = [], []

    def flush() -> None:
        text = _blank.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        node = stack.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            run.append(node)
        elif not node.unwanted:
            edge = _is_block(node)
            if edge:
                flush()
                stack.append(None)
            stack += reversed(node.children)
    flush()
    return out


def main_text(html: str) -> str:
    """The main text of a page; empty if it has none."""
    best = _best(score(parse(html)))
    return "" if best is None else "\n\n".join(blocks(_kept(best)))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns of pages without the html, and text. Null pages count as empty and give an empty text; a column named text gives way; repeated rows are extracted each; an empty table gives no rows."""
    keep = [c for c in pages.columns if c not in (html_col, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                texts = [main_text(h or "") for h in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "text"])

    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html_col))
    return rows.mapInArrow(run, with_fields(rows.schema[: len(keep)], {"text": StringType()}))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
