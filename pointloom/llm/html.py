"""Main text of web pages by wrapper induction.

Pages of a host that use the same structural elements form a group, with a reference page (its least page_id). Every
page's DOM is aligned with that of its reference by simple tree matching: two nodes match if their tags are equal, and the
children of matching nodes are matched in order so that most nodes pair up. Over all pages of a group it is counted how
often a reference node was paired, how often with the same text, and how much varying text it had, in links and outside.
From these votes follows the group's wrapper:

* constant nodes are template, wherever they stand (a page that is on the whole a copy of the reference has no vote, so
  an article that is published again and again isn't taken for template);
* slots whose varying text stands mostly in links are menus;
* the content's container is the node that holds most of the varying text outside links: an ``article`` or ``main`` if
  those hold at least half of it, else what one gets to from the root by going on to the child with most of it.

Each page is then aligned once more and its text is read from the container's slots. What authors mark as menus, footers,
side columns, adverts, notices, forms and reader comments has no part in the votes and none in the text, as it varies
from page to page just like content. Groups of under ``LEAST_PAGES`` pages have no wrapper: marks alone decide there.

The references and the wrappers are joined by group: broadcast if they are under ``BROADCAST_BYTES`` together, else by
a shuffled join, which splits hot groups. Votes are summed within a task before they are shuffled. A null or empty html
gives empty text; a page without a host has no wrapper; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, column, map_arrow

BROADCAST_BYTES = 64 << 20
#: A node is template if at least so many different pages pair with it, and this share of them with the same text.
LEAST_PAGES, LEAST_SHARE = 3, 0.9
#: A page is a copy of its reference if more than this share of their common text is the same.
COPY = 0.5
#: Pages with less text than this always vote.
SHORT = 200
#: A slot is a menu if more than this share of its varying text is in links; the container holds at least this share of the rest.
MOST = 0.6
#: Structural elements that tell a host's layouts apart.
LAYOUT = "article|main|section|aside|header|footer|table|center"

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|iframe)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>|<[!?][^>]*+>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open paragraph, and the tags that end others of their kind within the given containers.
ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"} | {"hr"}
ENDS_KIND = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
CONTAINERS = frozenset("html body div section article main center table tbody tr td font span".split())
HEADINGS = frozenset("h1 h2 h3".split())
DROPPED = frozenset("head nav aside footer form button dialog menu".split())
#: Words of class, id and role that mark what isn't content.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notices|alert|sidebar|side|aside|menu|nav|navbar|navigation|breadcrumbs?|topbar"
    r"|masthead|header|footer|foot|comments?|disqus|replies|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|popup|modal|overlay|search|widget|toolbar|pagination|skip|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)


class Node:
    __slots__ = ("tag", "marks", "children", "parts", "number", "parent", "size", "outline")

    def __init__(self, tag: str, marks: str, number: int, parent: "Node | None" = None):
        self.tag, self.marks, self.number, self.parent = tag, marks, number, parent
        self.size, self.outline = 1, 0  # nodes of the subtree, and a hash of its tags
        self.children: list[Node] = []
        self.parts: list = []  # texts and child nodes in order

    def own_text(self) -> str:
        return " ".join(" ".join(p for p in self.parts if isinstance(p, str)).split())


def parse(html: str) -> list[Node]:
    """All elements in page order, the root first; open elements are closed as browsers roughly do."""
    root = Node("#", "", 0)
    nodes, stack, at = [root], [root], 0
    for m in _TAG.finditer(html):
        if m.start() > at:
            stack[-1].parts.append(unescape(html[at : m.start()]))
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
            continue
        if name in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCKS:
                    break
        if name in ENDS_KIND:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name or (name in ("td", "th", "dt", "dd") and stack[k].tag in (("td", "th") if name[0] == "t" else ("dt", "dd"))):
                    del stack[k:]
                    break
                if stack[k].tag in ENDS_KIND[name]:
                    break
        marks = " ".join(a or b or c for a, b, c in _NAMED.findall(m[4])) if m[4] else ""
        node = Node(name, marks, len(nodes), stack[-1])
        nodes.append(node)
        stack[-1].children.append(node)
        stack[-1].parts.append(node)
        if name not in VOID and not m[4].endswith("/"):
            stack.append(node)
    if at < len(html):
        stack[-1].parts.append(unescape(html[at:]))
    for node in reversed(nodes):  # children come after their parents
        node.size += sum(c.size for c in node.children)
        node.outline = hash((node.tag, *(c.outline for c in node.children)))
    return nodes


def _pairs(a: list[Node], b: list[Node], memo: dict) -> tuple[int, list[tuple[Node, Node]]]:
    """Best order-keeping pairing of two child lists: number of nodes paired below, and the pairs of this level.

    Equal subtrees at either end pair with each other, which no other pairing betters.
    """
    ends, total = [], 0
    while a and b and a[0].outline == b[0].outline:
        ends.append((a[0], b[0]))
        total += a[0].size
        a, b = a[1:], b[1:]
    while a and b and a[-1].outline == b[-1].outline:
        ends.append((a[-1], b[-1]))
        total += a[-1].size
        a, b = a[:-1], b[:-1]
    n, m = len(a), len(b)
    row = [0] * (m + 1)
    rows, weights = [row], []
    for x in a:
        new, w = [0], []
        for j, y in enumerate(b):
            k = _weight(x, y, memo) if x.tag == y.tag else 0
            w.append(k)
            best = row[j] + k if k else 0
            new.append(max(best, row[j + 1], new[j]))
        weights.append(w)
        rows.append(row := new)
    i, j = n, m
    while i and j:
        k = weights[i - 1][j - 1]
        if k and rows[i][j] == rows[i - 1][j - 1] + k:
            ends.append((a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return total + rows[n][m], ends


def _weight(x: Node, y: Node, memo: dict) -> int:
    """Size of the simple tree matching of two nodes of the same tag, whose children's matching is known."""
    if x.outline == y.outline:
        return x.size
    return 1 + memo[x.number, y.number][0] if x.children and y.children else 1


def _match(x: Node, y: Node, memo: dict) -> None:
    """Matchings of the children of x and y and of all below that they need; without recursion, so any depth will do."""
    stack = [(x, y)]
    while stack:
        x, y = stack[-1]
        if (x.number, y.number) in memo:
            stack.pop()
            continue
        a, b = x.children, y.children
        k = 0
        while k < min(len(a), len(b)) and a[k].outline == b[k].outline:
            k += 1
        e = 0
        while e < min(len(a), len(b)) - k and a[-1 - e].outline == b[-1 - e].outline:
            e += 1
        todo = [(c, d) for c in a[k : len(a) - e] for d in b[k : len(b) - e] if c.tag == d.tag and c.children and d.children and c.outline != d.outline and (c.number, d.number) not in memo]
        if todo:
            stack += todo
        else:
            memo[x.number, y.number] = _pairs(a, b, memo)
            stack.pop()


def align(page: list[Node], reference: list[Node]) -> dict[int, int]:
    """Number of each paired page element, and the number of the reference's element it pairs with."""
    memo: dict = {}
    out, work = {}, [(page[0], reference[0])]
    while work:
        x, y = work.pop()
        out[x.number] = y.number
        if x.outline == y.outline:
            work += zip(x.children, y.children, strict=True)
        elif x.children and y.children:
            _match(x, y, memo)
            work += memo[x.number, y.number][1]
    return out


def boilerplate(n: Node) -> bool:
    """Whether its author marks this node as none of the content."""
    return n.tag not in ("html", "body", "#") and (n.tag in DROPPED or bool(n.marks and MARKS.search(n.marks)))


def marked_roots(page: list[Node]) -> list[Node]:
    """Outermost articles or mains that aren't boilerplate."""
    roots, work = [], [page[0]]
    while work:
        n = work.pop()
        if n.tag in ("article", "main") or "main" in n.marks.split():
            if not (n.marks and MARKS.search(n.marks)):
                roots.append(n)
                continue
        if n.tag in ("nav", "aside", "footer", "form", "head") or n.marks and MARKS.search(n.marks) and n.tag not in ("html", "body"):
            continue
        work += reversed(n.children)
    return roots


def ballot(page: list[Node], reference: list[Node]) -> tuple[dict[int, tuple[int, int, int, int]], int]:
    """A page's votes on reference nodes: paired, with the same text, characters of other text outside links and in links.

    With them one of 62 bits that the page's text picks, by which different pages are told from repeated ones.
    """
    open_ = [False] * len(page)  # inside the body and outside boilerplate
    linked = [False] * len(page)
    for n in page[1:]:
        open_[n.number] = not boilerplate(n) and n.tag != "title" and (n.parent.number == 0 or open_[n.parent.number])
        linked[n.number] = n.tag == "a" or linked[n.parent.number]
    votes, same, total, digest = {}, 0, 0, 0
    for a, b in align(page, reference).items():
        if a and open_[a] and (text := page[a].own_text()):
            equal = text == reference[b].own_text()
            digest = crc32(text.encode("utf-8", "surrogatepass"), digest)
            total += len(text)
            same += len(text) * equal
            votes[b] = 1, int(equal), len(text) * (not equal and not linked[a]), len(text) * (not equal and linked[a])
    return (votes if same <= COPY * total or total < SHORT else {}), 1 << digest % 62


class Wrapper:
    """What the votes of a group say of its reference: constant nodes, menus and the content's container."""

    def __init__(self, reference: list[Node], votes: list[tuple[int, int, int, int, int, int]]):
        """votes: (node, paired, same, other characters outside links, in links, bits of pages), over the group's pages."""
        self.fixed = {n for n, paired, same, _, _, bits in votes if bits.bit_count() + 1 >= LEAST_PAGES and same >= LEAST_SHARE * paired}
        plain, links = [0] * len(reference), [0] * len(reference)
        for n, _, _, p, q, _ in votes:
            plain[n], links[n] = p, q
        for n in reversed(reference[1:]):
            plain[n.parent.number] += plain[n.number]
            links[n.parent.number] += links[n.number]
        self.menus = {n.number for n in reference if links[n.number] > MOST * (plain[n.number] + links[n.number])}
        self.root: int | None = None
        total = plain[0]
        if total and sum(plain[n.number] for n in marked_roots(reference)) < total / 2:
            at = reference[0]
            while True:
                best = max(at.children, key=lambda c: plain[c.number], default=None)
                if best is None or best.tag not in CONTAINERS or plain[best.number] < MOST * plain[at.number] or any(c.tag in HEADINGS and plain[c.number] for c in at.children):
                    break
                at = best
            self.root = at.number


def main_text(page: list[Node], wrapper: Wrapper | None = None, reference: list[Node] | None = None) -> str:
    """Blocks of the content, joined by an empty line; without a wrapper by marks alone."""
    constant: set[int] = set()
    roots = marked_roots(page)
    marked = bool(roots)
    if wrapper is not None:
        pairs = align(page, reference)
        constant = {a for a, b in pairs.items() if b in wrapper.menus or b in wrapper.fixed and page[a].own_text() == reference[b].own_text()}
        if wrapper.root is not None and (held := [page[a] for a, b in pairs.items() if b == wrapper.root]):
            roots, marked = held, False
    blocks: list[str] = []
    line: list[str] = []

    def flush():
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    for root in roots or [page[0]]:
        todo: list = [root]
        while todo:
            n = todo.pop()
            if n is None:
                flush()
            elif isinstance(n, str):
                line.append(n)
            elif n.tag == "br":
                line.append(" ")
            elif n is not root and (boilerplate(n) or not marked and n.tag == "header"):
                if n.tag in BLOCKS:
                    flush()
            else:
                parts = n.parts
                if n.number in constant:
                    parts = [p for p in parts if not isinstance(p, str)]
                if n.tag in BLOCKS or n is root:
                    flush()
                    todo.append(None)
                todo += reversed(parts)
        flush()
    return "\n\n".join(blocks)


@lru_cache(maxsize=64)
def _reference(html: str) -> list[Node]:
    return parse(html)


@lru_cache(maxsize=64)
def _wrapper(html: str, votes: tuple) -> Wrapper:
    return Wrapper(_reference(html), list(votes))


def with_group(pages: DataFrame, groups: DataFrame, size: int) -> DataFrame:
    """Left join by host and layout; broadcast only below the bound."""
    return pages.join(F.broadcast(groups) if size <= BROADCAST_BYTES else groups, "host", "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each row of ``pages``: id, url, main text (empty if none) and its length in code points."""
    url, html = column(url_col), column(html_col)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    layout = F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(rf"(?i)<({LAYOUT})\b"), F.lit(1)), F.lower))), " ")
    p = pages.select(column(id_col).alias("id"), url.alias("url"), F.when(F.length(host) > 0, F.concat_ws(" ", host, layout)).alias("host"), html.alias("html"))
    seen = p.where("host is not null and html is not null").groupBy("host").agg(F.min_by("html", F.struct("id", F.xxhash64("html"))).alias("ref"), F.count("*").alias("n"))
    tables = Tables()
    refs = tables.keep(seen.where(f"n >= {LEAST_PAGES}").select("host", "ref"), "references")
    size = refs.agg(F.sum(F.length("ref"))).first()[0] or 0

    def make_votes():
        def run(columns):
            sums: dict[tuple, list[int]] = {}
            for host, html, ref in zip(*columns, strict=True):
                if html != ref:
                    found, bit = ballot(parse(html), _reference(ref))
                    for b, vote in found.items():
                        *had, bits = sums.get((host, b), (0, 0, 0, 0, 0))
                        sums[host, b] = [*(x + y for x, y in zip(had, vote, strict=True)), bits | bit]
            return [[k[0] for k in sums], [k[1] for k in sums], *([v[i] for v in sums.values()] for i in range(5))]

        return run

    names = ("paired", "same", "plain", "links", "bits")
    counted = [("host", pa.string(), "string"), ("node", pa.int32(), "int"), *((n, pa.int64(), "long") for n in names)]
    pairs = with_group(p.where("host is not null and html is not null"), refs, size).where("ref is not null")
    votes = map_arrow(pairs, [], ["host", "html", "ref"], make_votes, counted).groupBy("host", "node").agg(*(F.sum(n).alias(n) for n in names[:-1]), F.bit_or("bits").alias("bits"))
    # a list for each group, no longer than its reference
    groups = tables.keep(refs.join(votes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", *names))).alias("votes")), "host"), "wrappers")

    def make_texts():
        def run(columns):
            texts = []
            for html, ref, votes in zip(*columns, strict=True):
                page = parse(html or "")
                if ref is None or not votes:
                    texts.append(main_text(page))
                else:
                    texts.append(main_text(page, _wrapper(ref, tuple(tuple(v.values()) for v in votes)), _reference(ref)))
            return [texts, [len(t) for t in texts]]

        return run

    return map_arrow(with_group(p, groups, size), ["id", "url"], ["html", "ref", "votes"], make_texts, [("text", pa.string(), "string"), ("n_chars", pa.int64(), "long")]).toDF(id_col, url_col, "text", "n_chars")
