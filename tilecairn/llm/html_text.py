"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tilecairn.llm.common import SPACES, modest_batches, small_batches

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
RUN = re.compile(f"[{SPACES}]+")
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never main text.
DROPPED = frozenset("script style noscript template title textarea iframe object embed svg canvas audio video head nav footer aside button select input dialog menu xmp noembed noframes".split())
#: Elements that an opening tag of the same row ends, up to a border.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of a class, id or role that make an element suspect.
WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising banner banners sponsor sponsors sponsored promo promos promotion promotions sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert alerts newsletter subscribe subscription signup popup modal overlay social share sharing related recommended recommendations widget widgets toolbar pagination pager copyright disclaimer login search complementary contentinfo dialog".split())
#: The same for what readers wrote.
COMMENT_WORDS = frozenset("comment comments commentlist commenters disqus reply replies respond response responses remark remarks discussion discussions feedback reaction reactions talkback guestbook".split())
#: Words beside these that say what a page has or lacks, not what an element is.
STATES = frozenset("no not non without has have with is enabled disabled ready".split())
#: Words of a class or id that name the writer or the time of an entry.
BYLINE = frozenset("author user username nickname nick avatar byline date time timestamp datetime posted permalink poster commenter".split())
HEADING = re.compile("h[1-6]")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


#: What becomes of an element: it may stay, goes unless the densities say that the main text is in it, is what readers
#: wrote unless an article is in it, goes if it has its own end (else its extent is not known and it counts as
#: the second), goes in any case.
STAYS, MAY_GO, COMMENTS, GOES_CLOSED, GOES = range(5)


class Node:
    __slots__ = ("byline", "chars", "children", "density", "fate", "kind", "link_chars", "link_tags", "own", "parent", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, fate: int = STAYS, kind: str = "", byline: bool = False):
        self.tag, self.parent, self.children, self.fate, self.kind, self.byline = tag, parent, [], fate, kind, byline
        self.own = -1  # characters of its own texts, once they have been counted


class Open:
    """The elements that are open, root first, with their places by tag, so that none of the questions below walks up
    to the root: a page of any depth is parsed in linear time."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def last(self, *tags: str) -> int:
        """The place of the innermost open element with one of these tags; 0 without any."""
        best = 0
        for t in tags:
            p = self.places.get(t)
            if p and p[-1] > best:
                best = p[-1]
        return best

    def first_beyond(self, tags: set[str], place: int) -> int:
        """The place of the outermost one beyond a place; 0 without any."""
        found = [p[i] for t in tags if (p := self.places.get(t)) and (i := bisect_right(p, place)) < len(p)]
        return min(found, default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def end(self, place: int) -> None:
        """End the element at a place and all within."""
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()


def _words(text: str) -> list[list[str]]:
    """The words of each of the names in a class, id or role."""
    return [[w.lower() for w in PARTS.findall(name)] for name in text.split()]


def _fate(tag: str, attributes: str, inside: bool) -> tuple[int, str, bool]:
    """What becomes of an element, its class, and whether it names a writer or a time; inside: it is within an article or
    main. Only whole words of names count, and none of a name that tells a state, such as no-sidebar."""
    fate = MAY_GO if tag == "form" else GOES_CLOSED if tag in DROPPED or tag == "header" and not inside else STAYS
    if not attributes or tag in ("html", "body", "main"):
        return fate, "", tag == "time"
    found = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), "".join(values))
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")):
        return GOES, "", False
    names = [n for x in ("class", "id", "role", "aria-label") if found.get(x) for n in _words(found[x])]
    byline = tag == "time" or any(w in BYLINE for n in names for w in n) or found.get("rel", "") == "author"
    if fate == STAYS and not HEADING.fullmatch(tag) and tag not in ("p", "a", "b", "i", "em", "strong", "span"):
        plain = [n for n in names if STATES.isdisjoint(n)]
        if any(w in COMMENT_WORDS for n in plain for w in n):
            fate = COMMENTS
        elif tag != "article" and any(w in WORDS for n in plain for w in n):
            fate = MAY_GO
    return fate, found.get("class", "").split(" ")[0], byline


def parse(page: str) -> Node:
    """The elements of a page that may hold main text, with their texts still encoded.

    Tags that end nothing are passed over, elements left open end with what holds them, and an opening
    tag of a block ends an open paragraph, as browsers have it. Elements that are not main text are
    parsed like the others and go afterwards (settle()).
    """
    root = Node("#root", None)
    opened, start = Open(root), 0
    stack = opened.stack
    find = MARKUP.search
    while m := find(page, start):
        if m.start() > start:
            stack[-1].children.append(page[start : m.start()])
        start = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if not closing and tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, start)
            start = end.end() if end else len(page)
            continue
        if closing:
            if place := opened.last(tag):
                if stack[place].fate == GOES_CLOSED:
                    stack[place].fate = GOES
                opened.end(place)
            continue
        if tag in BLOCKS and (place := opened.last("p")) > opened.last("table", "td", "th", "button", "html"):
            opened.end(place)
        if tag in ENDS:
            ends, border = ENDS[tag]
            if place := opened.first_beyond(ends, opened.last(*border)):
                opened.end(place)
        fate, kind, byline = (STAYS, "", False) if tag in VOID else _fate(tag, attributes, tag == "header" and opened.last("article", "main") > 0)
        if fate != STAYS and attributes.endswith("/"):
            continue
        if tag in ("html", "body") and opened.last(tag):
            continue
        node = Node(tag, stack[-1], fate, kind, byline)
        stack[-1].children.append(node)
        if tag not in VOID and not (attributes.endswith("/") and tag not in BLOCKS):
            opened.push(node)
    if start < len(page):
        stack[-1].children.append(page[start:])
    return settle(root)


def _without(node: Node, goes) -> None:
    """Take the elements that go out of the tree, with all they hold."""
    todo = [node]
    while todo:
        x = todo.pop()
        x.children = [c for c in x.children if isinstance(c, str) or not goes(c)]
        todo += [c for c in x.children if isinstance(c, Node)]


def _plain(node: Node) -> int:
    """Characters outside links."""
    return node.chars - node.link_chars


def settle(root: Node) -> Node:
    """Take out the elements that are not main text.

    What readers wrote goes first (see _mark_comments()). Of the other suspects (by class, id or role, forms,
    and unwanted elements without an end of their own) the densities decide: one stays that holds the seed() of
    the whole tree or most of its text outside links, if it holds an article or main or there is none elsewhere;
    and where articles or main are only within suspects, those round the least nested ones stay.
    """
    _without(root, lambda c: c.fate == GOES)
    nodes = measure(root)
    _mark_comments(root, nodes)
    if not any(x.fate for x in nodes):
        return root
    articles = [x for x in nodes if x.tag in ("article", "main") and x.chars and x.fate != COMMENTS]
    holding = _above(articles)
    if any(x.fate == COMMENTS for x in nodes):
        written = sum(_plain(x) for x in nodes if x.fate == COMMENTS and id(x) not in holding)
        if _plain(root) > written or articles:
            _without(root, lambda c: c.fate == COMMENTS and id(c) not in holding)
        nodes = measure(root)
    depth: dict[int, int] = {}
    for x in nodes:
        depth[id(x)] = (depth[id(x.parent)] if x.parent else 0) + (x.fate != STAYS)
    kept = {id(x) for x in nodes}
    articles = [x for x in articles if id(x) in kept]
    least = min((depth[id(x)] for x in articles), default=0)
    stay = _above([x for x in articles if depth[id(x)] == least > 0])
    of_seed, half = _above([seed(nodes)]), _plain(root) / 2
    for x in nodes:
        if x.fate != STAYS and (id(x) in of_seed or _plain(x) > half) and (id(x) in holding or not articles or least > 0):
            stay.add(id(x))
    _without(root, lambda c: c.fate != STAYS and id(c) not in stay)
    return root


def _above(found: list[Node]) -> set[int]:
    """These elements and all that hold them."""
    out: set[int] = set()
    for x in found:
        while x is not None and id(x) not in out:
            out.add(id(x))
            x = x.parent
    return out


def _mark_comments(root: Node, nodes: list[Node]) -> None:
    """Mark as COMMENTS what readers wrote without a class that says so: articles within an article, and two or more
    siblings of one kind with a writer or a time each. They are that only beside some text that is not
    theirs, half of what one of them has on average at least; a list of entries alone is the main text."""
    signed: set[int] = set()
    for x in reversed(nodes):
        if x.byline and x.parent is not None or id(x) in signed:
            signed.add(id(x))
            signed.add(id(x.parent))
    groups: dict[tuple, list[Node]] = {}
    within: dict[int, Node | None] = {}
    for x in nodes:
        above = within[id(x.parent)] if x.parent else None
        within[id(x)] = x if x.tag == "article" and above is None else above
        if x.fate != STAYS or not _plain(x):
            continue
        if x.tag == "article" and above is not None:
            groups.setdefault(("article", id(above)), []).append(x)
        elif id(x) in signed and x.tag in ("div", "li", "section", "article", "dd", "blockquote", "tr"):
            groups.setdefault((x.tag, x.kind, id(x.parent)), []).append(x)
    outer = {id(x): x for x in within.values() if x is not None}
    for key, group in groups.items():
        nested = key[0] == "article" and len(key) == 2
        if not nested and len(group) < 2:
            continue
        theirs = sum(_plain(x) for x in group)
        held = outer[key[1]] if nested else root
        titles = sum(_plain(x) for x in _ordered(held) if HEADING.fullmatch(x.tag)) if nested else 0
        if 2 * (_plain(held) - titles - theirs) >= theirs / len(group):
            for x in group:
                x.fate = COMMENTS


def _path(node: Node) -> list[Node]:
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out


def _ordered(root: Node) -> list[Node]:
    """The elements under root, root first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    return out


def measure(root: Node) -> list[Node]:
    """Give every element its density: characters a tag, adjusted by the share of characters and tags that
    are links. Returns the elements, those outside first."""
    nodes = _ordered(root)
    for node in reversed(nodes):
        if node.own < 0:
            node.own = sum(len(RUN.sub(" ", c).strip(SPACES)) for c in node.children if isinstance(c, str))
        node.chars, node.tags, node.link_chars, node.link_tags = node.own, 0, 0, 0
        for c in node.children:
            if isinstance(c, Node):
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.chars if c.tag == "a" else c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
    share = root.link_chars / max(root.chars, 1)
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if not c:
            node.density = 0.0
            continue
        base = math.log(math.log(c / max(c - node.link_chars, 1) * node.link_chars + share * c + math.e))
        node.density = c / t * math.log(max(c / lc * t / lt, 1.0)) / max(base, 0.1)
    return nodes


def density_sum(node: Node) -> float:
    """The sum of the densities of an element's children."""
    return sum(c.density for c in node.children if isinstance(c, Node))


def seed(nodes: list[Node]) -> Node:
    """Of measured elements, those outside first, the one with the largest sum; of several the innermost."""
    best, most = nodes[0], -1.0
    for x in nodes:
        if (total := density_sum(x)) >= most:
            best, most = x, total
    return best


def _linked(units: list) -> bool:
    """Whether most of the text of these texts and elements is links; headings and rules are not asked."""
    if any(isinstance(c, Node) and HEADING.fullmatch(c.tag) for c in units):
        return False
    chars = links = 0
    for c in units:
        if isinstance(c, str):
            chars += len(RUN.sub(" ", c).strip(SPACES))
        else:
            chars += c.chars
            links += c.chars if c.tag == "a" else c.link_chars
    return 2 * links > chars


def _beside(parent: Node, kept: Node, stays) -> list:
    """The children of an element that stay beside the one kept; text and elements in the flow count together."""
    out, run = [], []
    for c in [*parent.children, None]:
        if isinstance(c, str) or isinstance(c, Node) and c is not kept and c.tag not in BLOCKS:
            run.append(c)
            continue
        if run and stays(run):
            out += run
        run = []
        if c is not None and (c is kept or stays([c])):
            out.append(c)
    return out


def main_element(root: Node) -> Node:
    """The subtree with the main text; of the tree, what goes is taken out.

    The element with the largest sum of its children's densities is the seed, and the least density on the way
    from the body to it the threshold. Up to the outermost main round the seed, or article, or, without both, the
    body, what lies beside the way stays unless it is mostly links, so that headings, lists and short
    sections do not get lost. Beyond that border an element stays only if its density reaches the
    threshold and its text half of what the seed has, or if it is an article beside the article.
    """
    nodes = measure(root)
    best = seed(nodes)
    if not density_sum(best):
        return root
    way = _path(best)
    threshold = min((x.density for x in way if x.tag not in ("html", "#root")), default=0.0)
    least = _plain(best) / 2
    borders = [x for tag in ("main", "article") for x in reversed(way) if x.tag == tag]
    border = borders[0] if borders else root
    inside = lambda units: not _linked(units)
    beyond = lambda units: len(units) == 1 and isinstance(units[0], Node) and inside(units) and (border.tag == units[0].tag == "article" or units[0].density >= threshold and _plain(units[0]) >= least)
    stays = inside
    while best.parent is not None:
        if best is border:
            stays = beyond
        best.parent.children = _beside(best.parent, best, stays)
        best = best.parent
    return best


def blocks(node: Node) -> list[str]:
    """The texts of the blocks under an element, in page order."""
    out, now = [], []

    def end() -> None:
        text = RUN.sub(" ", html.unescape("".join(now))).strip(SPACES)
        if text:
            out.append(text)
        now.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag == "br":
            now.append(" ")
        elif x.tag in BLOCKS:
            end()
            todo += [None, *reversed(x.children)]
        else:
            todo += reversed(x.children)
    end()
    return out


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks joined by line feeds."""
    return "\n".join(blocks(main_element(parse(page)))) if page else ""


def _extract(batches):
    for big in batches:
        for batch in small_batches(big, 1024, 8 << 20, 2):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["key", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row of pages: the key, url, text and n_chars (code points).

    Every element has a composite text density. Menus, headers, footers, sidebars, notices, adverts, forms, scripts
    and styles go, but what is one of them by its class, id or role only, or is a form, stays where the densities
    say that the main text is in it; what readers wrote goes, also where only its form tells (settle()). Of
    the rest main_element() takes the text round the subtree with the largest sum of densities. Parsing takes
    time in proportion to the page, however deep it is. Character references are decoded, white space within a block becomes one
    space, and blocks are joined by a line feed.

    A narrow job without a shuffle. A null or empty page has the empty text; null keys and urls stay null;
    repeated rows come back as often; an empty table gives an empty table; further columns are not read.
    """
    modest_batches(pages.sparkSession)
    schema = T.StructType([T.StructField("key", pages.schema[key].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    out = pages.select(pages[key].alias("key"), pages[url].cast("string").alias("url"), pages[page].alias("html")).mapInArrow(_extract, schema)
    return out.withColumnRenamed("key", key)
