"""Main-text extraction from HTML by tree scoring.

The page is parsed into a tree (tags and attributes read as the HTML standard reads
them, implied end tags included), in time linear in its length.  What is never text
(scripts, styles, form controls and the like) is cut at once.  Elements that look as if
they were around an article (navigation, footers, class or id names that say advert,
comment, sidebar and the like) are only marked.

Each paragraph passes points for its length and its commas to its ancestors, the whole
to the nearest, ever less further up, and only ``SUSPECT`` of it for each mark above it;
a container's points are discounted by its link density.  Then the marks decide: what is
marked is cut, but for the best container's own ancestors, whose marks (a page wrapper
called has-sidebar, a form around the whole page) say nothing.

An article or main element around the best container is kept, with those siblings that
score like it or read like prose.  Where there is none, the best container is kept and,
from its level up to the body, all beside it that scores like it or is low in links:
headings, quotations, code, short sections and bare text, too.

Defined results: a null page is empty; a page without any candidate gives the
text of its body, if any, as far as it isn't cut; unclosed and misnested tags are
closed by their ancestors; repeated rows are extracted row by row; other columns
are ignored.  No text is dropped for its length, so text low in links that nothing
marks as around an article is kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import ship

#: Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br option caption".split())
CUT = frozenset("head script style noscript template iframe object embed applet svg math canvas audio video map button select textarea input label title noembed noframes datalist".split())
OUTSIDE = frozenset("nav footer aside form fieldset dialog menu".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements whose start closes an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Which open elements the start of another closes, and where the search for them ends.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
#: Words in a class, id or role that mark what is around an article.
AROUND = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus respond reply replies cookie cookies consent notice notices gdpr popup modal overlay share sharing social related recommended newsletter subscribe signup login footer header masthead toolbar pagination pager widget skip search complementary contentinfo alert dialog toc".split())
#: Words that, before one of these in a name, say that the element only has or lacks such a part.
ABOUT = frozenset("no not without has have had with hide show is in by".split())
#: What a mark leaves of a paragraph's points.
SUSPECT = 0.25
TAG = re.compile(r"[a-zA-Z][^\s/>]*")
#: One attribute as the standard reads it: its name, then, after an equals sign, a quoted or a bare value.
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
UNCLOSED = re.compile(r"\s*=\s*[\"']")
TAG_END = re.compile(r"[\s/]*>")
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("tag", "parent", "content", "cut", "marked", "inside", "score", "chars", "link_chars", "commas", "inline")

    def __init__(self, tag: str, parent: "Node | None"):
        self.tag, self.parent, self.content, self.cut, self.marked, self.score = tag, parent, [], False, False, 0.0
        #: Whether an article, main or section is around it, or a header of one.
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main", "section"))


def names_surroundings(name: str, words: frozenset = AROUND) -> bool:
    """Whether one class or id name says that an element is around the article, and not that it has or lacks such a part."""
    parts = [w.lower() for w in PARTS.findall(name)]
    return not ABOUT & set(parts) and any(w in words for w in parts)


def marked(attributes: dict[str, str], words: frozenset = AROUND) -> bool:
    """Whether class, id or role say that an element is around the article, or that it is hidden."""
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True
    return any(names_surroundings(name, words) for key in ("class", "id", "role") if key in attributes for name in html.unescape(attributes[key]).split())


def read_attributes(page: str, pos: int) -> tuple[dict[str, str], int, bool] | None:
    """The attributes of a start tag (the first of each name), where it ends, and whether it closes itself; None if it never ends."""
    found: dict[str, str] = {}
    while True:
        m = TAG_END.match(page, pos)
        if m is not None:
            return found, m.end(), "/" in m[0]
        m = ATTRIBUTE.match(page, pos)
        if m is None:
            return None
        name, a, b, c = m.groups()
        pos = m.end()
        if a is None and b is None and c is None and UNCLOSED.match(page, pos):
            return None  # a quoted value that nothing closes takes the rest of the page
        found.setdefault(name.lower(), a or b or c or "")


def parse(page: str) -> Node:
    """The element tree of a page; text is kept with its character references."""
    root = Node("#root", None)
    at, pos, end = root, 0, len(page)
    held: Counter = Counter()  # open elements by tag, so that no search climbs in vain

    def close_to(node: Node) -> Node:
        up = at
        while up is not node:
            held[up.tag] -= 1
            up = up.parent
        return node

    while pos < end:
        lt = page.find("<", pos)
        if lt < 0 or lt == end - 1:
            at.content.append(page[pos:])
            break
        after = page[lt + 1]
        closing = after == "/"
        tag = TAG.match(page, lt + 1 + closing)
        if tag is None and after not in "!?/" or closing and lt + 2 >= end:
            at.content.append(page[pos : lt + 1])  # a bare less-than sign
            pos = lt + 1
            continue
        if lt > pos:
            at.content.append(page[pos:lt])
        if tag is None:
            if page.startswith("<!--", lt):
                stop = lt + 4 if page.startswith(("<!-->", "<!--->"), lt) else page.find("-->", lt + 4)
                pos = end if stop < 0 else page.find(">", stop) + 1
            else:
                stop = page.find(">", lt + 2)
                pos = end if stop < 0 else stop + 1
            continue
        read = read_attributes(page, tag.end())
        if read is None:
            break
        attributes, pos, alone = read
        tag = tag[0].lower()
        if closing:
            if held[tag]:
                node = at
                while node.tag != tag:
                    node = node.parent
                at = close_to(node.parent)
            continue
        if tag in ENDS_P and held["p"]:
            node = at
            while node is not None and node.tag not in ("p", "td", "th", "li", "div", "article", "section", "table"):
                node = node.parent
            if node is not None and node.tag == "p":
                at = close_to(node.parent)
        elif tag in SIBLINGS and any(held[x] for x in SIBLINGS[tag][0]):
            closes, limit = SIBLINGS[tag]
            node, found = at, None
            while node is not None and node.tag not in limit:
                found = node if node.tag in closes else found
                node = node.parent
            if found is not None:
                at = close_to(found.parent)
        node = Node(tag, at)
        at.content.append(node)
        node.cut = tag in CUT
        if not node.cut and tag not in ("html", "body", "article", "main"):
            node.marked = tag in OUTSIDE or tag == "header" and not node.inside
            if not node.marked and attributes:
                node.marked = marked(attributes, AROUND - {"header"} if node.inside or tag == "header" else AROUND)
        if tag in RAW and not alone:
            stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, pos)
            stop = page.find(">", stop.start()) if stop else -1
            pos = end if stop < 0 else stop + 1
        elif tag not in VOID and not alone:
            at = node
            held[tag] += 1
    return root


def measure(root: Node) -> list[Node]:
    """Sets the sizes of all nodes that aren't cut, children first; returns them so."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.content if type(c) is Node and not c.cut)
    order.reverse()
    for node in order:
        chars = link = commas = 0
        inline = True
        for c in node.content:
            if type(c) is str:
                chars += len(c.strip())
                commas += c.count(",")
            elif not c.cut:
                chars += c.chars
                link += c.link_chars
                commas += c.commas
                inline = inline and c.inline and c.tag not in BLOCKS
        node.chars, node.commas, node.inline = chars, commas, inline
        node.link_chars = chars if node.tag == "a" else link
    return order


def weigh(order: list[Node]) -> dict[int, float]:
    """What the marks on and above each node leave of its points."""
    weight: dict[int, float] = {}
    for node in reversed(order):  # parents first
        weight[id(node)] = (weight[id(node.parent)] if node.parent is not None else 1.0) * (SUSPECT if node.marked else 1.0)
    return weight


def score(order: list[Node]) -> list[Node]:
    """Lets paragraphs pass points up; returns the containers that got any."""
    candidates, weight = {}, weigh(order)
    for node in order:
        if node.tag in PARAGRAPHS or node.tag in ("div", "section", "article") and node.inline:
            if not node.chars:
                continue
            points = (1 + node.commas + min(3.0, node.chars / 100)) * (1 - node.link_chars / node.chars)
            up = node.parent if node.tag in PARAGRAPHS else node
        elif node.tag in ("div", "section", "article", "main", "center") and (own := "".join(c for c in node.content if type(c) is str).strip()):
            points, up = 1 + own.count(",") + min(3.0, len(own) / 100), node  # text beside blocks is a paragraph of its own
        else:
            continue
        share = weight[id(node)]
        for depth in range(5):
            if up is None or up.tag in ("#root", "html"):
                break
            up.score += points * share
            candidates[id(up)] = up
            up, share = up.parent, share * 0.5
    for node in candidates.values():
        node.score *= 1 - node.link_chars / max(1, node.chars)
    return list(candidates.values())


def kept_nodes(root: Node) -> list:
    """The best container with what is worth keeping beside it, or the body."""
    order = measure(root)
    found = score(order)
    best = max(found, key=lambda n: n.score) if found else None
    above = best
    while above is not None:  # marks on what holds the best container say nothing
        above.marked = False
        above = above.parent
    for node in order:
        node.cut = node.cut or node.marked
        node.chars = node.link_chars = node.commas = 0
    order = measure(root)
    if best is None:
        return [next((n for n in reversed(order) if n.tag == "body"), root)]
    article = best
    while article is not None and article.tag not in ("article", "main"):
        article = article.parent
    if article is not None:
        best = article
    if best.parent is None or best.tag == "body":
        return [best]
    least, kept = max(2.0, 0.2 * best.score), []
    if article is None:
        return surrounded(best, least)
    for node in best.parent.content:
        if node is best:
            kept.append(node)
        elif type(node) is Node and not node.cut and node.chars:
            density = node.link_chars / node.chars
            if node.score >= least or node.tag == best.tag == "article" or node.tag == "p" and density < 0.25 and (node.chars > 80 or density == 0):
                kept.append(node)
    return kept


def surrounded(best: Node, least: float) -> list:
    """The best container with all beside it and beside its ancestors that scores like it or is low in links."""
    before, kept = [], [best]
    while best.parent is not None and best.tag not in ("body", "html"):
        sides: list[list] = [[]]
        for unit in units(best.parent.content, best):
            if unit == [best]:
                sides.append([])
                continue
            chars, link = (sum(x) for x in zip(*((len(c.strip()), 0) if type(c) is str else (c.chars, c.link_chars) for c in unit)))
            heading = type(unit[0]) is Node and unit[0].tag in HEADINGS
            sides[-1] += unit if heading or link < 0.25 * chars or any(type(c) is Node and c.score >= least for c in unit) else [" "]
        before += [" ", *reversed(sides[0])]
        kept += [" ", *sides[1]]
        best = best.parent
    return [*reversed(before), *kept]


def units(content: list, best: Node) -> Iterator[list]:
    """What isn't cut of an element: blocks, and runs of text and inline elements between them."""
    run: list = []
    for c in content:
        if type(c) is Node and c.cut:
            continue
        if type(c) is Node and (c is best or c.tag in BLOCKS and c.tag != "br" or not c.inline):
            if run:
                yield run
            yield [c]
            run = []
        else:
            run.append(c)
    if run:
        yield run


def text_of(nodes: list) -> str:
    """The nodes' text in page order; each white space, and each edge of a block, becomes one space."""
    parts: list[str] = []
    stack: list = list(reversed(nodes))
    while stack:
        c = stack.pop()
        if type(c) is str:
            parts.append(html.unescape(c) if "&" in c else c)
        elif not c.cut:
            if c.tag in BLOCKS:
                parts.append(" ")
                stack.append(" ")
            stack.extend(reversed(c.content))
    return " ".join("".join(parts).split())


def extract(page: str | None) -> str:
    return text_of(kept_nodes(parse(page))) if page else ""


def extract_pages(pages: DataFrame, *, slice_rows: int = 128) -> DataFrame:
    """Main text of every ``html``; returns page_id, url, text and n_chars (its code points)."""
    ship(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(start, slice_rows)
                texts = [extract(p) for p in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(pages["page_id"].cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op9_html": op9_html}
ORACLE_SQL: dict[str, str] = {}
