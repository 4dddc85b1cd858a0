"""Main text of web pages by consensus host paths.

A page is read into a tree of elements.  Every container gets a score from the text of its blocks: much text and
sentences count for it, text inside links and marks of page furniture count against it.  A page votes for its best
container's path, generalised to tags and classes (no ids, numbers in classes dropped).  Votes are summed per host in
Spark with map-side combining; a path that wins enough of a host's votes is the host's.  Each page is then extracted
again from the containers on the winning paths, or from its own best one where none matches.

The winners are few per host.  If there are at most `MOST_WINNERS` they are sent to every task; more are joined by host,
with hot hosts dealt over `SALTS` parts.

Defined results: null and empty html give an empty text; a page without any container with text gives an empty text; a
null url is a host of its own; rows that repeat keep their own results, and an empty table gives none; of containers
with equal scores the innermost, then the first, is taken; other columns of pages aren't carried.  Nesting of any depth takes linear time.

Page furniture: the elements in SKIPPED, the roles in ROLES, and elements whose class or id ends in a word of furniture.
A header inside an article that holds a heading is the article's own.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import map_batches, stored
from factweave.llm.urls import host_of

MOST_WINNERS, SALTS = 200_000, 32
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
#: Elements whose content isn't text, those whose content is no part of an article, and those without content.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset("script style head title template noscript nav header footer aside form button select textarea menu dialog iframe object svg canvas audio video input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block of text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
#: Elements that an opening tag of the key closes if they are open in the same block.
CLOSES = {
    **{t: frozenset(["p"]) for t in BLOCKS},
    "li": frozenset(["li", "p"]),
    "dd": frozenset(["dd", "dt", "p"]),
    "dt": frozenset(["dd", "dt", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]),
    "td": frozenset(["td", "th", "p"]),
    "th": frozenset(["td", "th", "p"]),
    "option": frozenset(["option"]),
}
#: Elements that keep such a closing from going further out.
SCOPES = {"li": frozenset(["ul", "ol", "menu"]), "dd": frozenset(["dl"]), "dt": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"])}
#: Words of a class or id that mark page furniture wherever they stand, and those that do as the last word.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead toolbar pagination disqus comments commentlist".split()
)
FURNITURE = STRONG | frozenset("banner promo promos promotion notice notices menu menus side widget widgets related recommended recommendations share sharing social follow comment respond replies reply discussion foot header pager search searchbox skip disclaimer alert".split())
#: Words that say nothing when they stand last; words that name an article, or that tell of furniture that is elsewhere.
GENERIC = frozenset("list box bar area block section container wrapper wrap inner outer content body text item items row col column panel holder group links link thread form left right top bottom main unit slot label title heading button buttons icon icons toggle message media logo tools count trail".split())
ARTICLE = frozenset("article story work works entry essay paper chapter feature".split())
NEGATING = frozenset("has with no without non hide".split())
#: What follows "related" and the like where other pages are listed, not the article's own section.
ELSEWHERE = frozenset("posts post articles article stories story news reading pages topics videos".split())
PARTS = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
WHITE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")


def is_furniture(marks: str) -> bool:
    """Whether a class or id names page furniture.

    The last word decides, so print-article and related-work don't; has-sidebar speaks of another element.
    """
    for mark in marks.split():
        parts = [x.lower() for x in PARTS.findall(mark)]
        if not NEGATING.isdisjoint(parts):
            continue
        while len(parts) > 1 and parts[-1] in GENERIC:
            parts.pop()
        if not parts or parts[-1] in ARTICLE:
            continue
        if parts[-1] in FURNITURE or not STRONG.isdisjoint(parts) or len(parts) > 1 and parts[-1] in ELSEWHERE and parts[-2] in ("related", "recommended", "more", "similar"):
            return True
    return False


@dataclass(eq=False)
class Node:
    """An element; skipped and furniture hold for all below it.  Trees can be deep, so nothing here recurses."""

    tag: str
    name: str
    parent: Node | None
    depth: int = 0
    skipped: bool = False
    furniture: bool = False
    children: list[Node | str] = field(default_factory=list)
    #: Innermost element that ends a block, this one included; how many inline elements are open in it, by tag.
    block: Node | None = None
    open: Counter = field(default_factory=Counter)
    #: Innermost header inside an article: with a heading it belongs to the article.
    header: Node | None = None
    in_article: bool = False

    def path(self) -> str:
        names, node = [], self
        while node is not None and node.parent is not None:
            names.append(node.name)
            node = node.parent
        return "/".join(reversed(names))


def parse(source: str) -> Node:
    """Tree of a page; lenient like browsers: stray end tags are ignored, open elements end with their parents.

    Counts of open elements tell at once whether an end tag has anything to end, so nested or stray tags cost linear time.
    """
    root = Node("#", "", None)
    root.block = root
    node, last = root, 0
    position = 0
    open_blocks: Counter = Counter()

    def close(to: Node) -> Node:
        x = node
        while x is not to:
            if x.block is x:
                open_blocks[x.tag] -= 1
            else:
                x.block.open[x.tag] -= 1
            x = x.parent
        return to

    while m := TOKEN.search(source, position):
        if m.start() > last:
            node.children.append(source[last : m.start()])
        position = last = m.end()
        tag = m[2]
        if not tag:
            if m[0].startswith("<![CDATA["):
                node.children.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m[1]:
            # an inline end tag can't close a block
            if (open_blocks if tag in BLOCKS else node.block.open)[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = close(up.parent)
            continue
        if tag in CLOSES:
            up, scope, shut = node.block, SCOPES.get(tag, frozenset()), node if tag == node.tag == "option" else None
            while up is not root and up.tag not in scope and up.tag in CLOSES[tag]:
                shut, up = up, up.parent.block
            if shut is not None:
                node = close(shut.parent)
        attributes = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(m[3])} if m[3].strip(" /") else {}
        classes = sorted({DIGITS.sub("", c) for c in attributes.get("class", "").split()} - {""})
        marks = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        furniture = tag not in ("body", "html", "main", "article") and (bool(marks.strip()) and is_furniture(marks) or attributes.get("role", "").lower() in ROLES)
        gone = "hidden" in re.split(r"[\s=]+", m[3].lower()) or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        child = Node(tag, ".".join([tag, *classes]), node, node.depth + 1, tag in SKIPPED or gone, furniture)
        child.block = child if tag in BLOCKS else node.block
        child.in_article = node.in_article or tag == "article"
        child.header = child if node.in_article and not gone and (tag == "header" or furniture and "header" in marks.lower()) else node.header
        if tag in ("h1", "h2") and child.header is not None:
            child.header.skipped = child.header.furniture = False
        node.children.append(child)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(source, position)
            stop = end.start() if end else len(source)
            if tag in ("textarea", "title"):
                child.children.append(source[position:stop])
            position = last = source.find(">", stop) + 1 if end and source.find(">", stop) >= 0 else len(source)
        elif tag not in VOID and (not m[3].endswith("/") or tag in BLOCKS):
            node = child
            if tag in BLOCKS:
                open_blocks[tag] += 1
            else:
                child.block.open[tag] += 1
    if last < len(source):
        node.children.append(source[last:])
    return root


def blocks(node: Node) -> list[tuple[str, int, Node]]:
    """Texts of the blocks under a node, in page order, how many of their characters stand in links, and the innermost container of each."""
    out: list[tuple[str, int, Node]] = []
    parts: list[str] = []
    linked, owner = 0, node

    def end() -> None:
        nonlocal linked
        text = WHITE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append((text, linked, owner))
        parts.clear()
        linked = 0

    todo: list[tuple[Node | str | None, bool, Node]] = [(node, False, node)]
    while todo:
        item, link, inside = todo.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            parts.append(item)
            owner = inside
            linked += len(item.strip()) if link else 0
        else:
            if item.skipped or item.furniture and item is not node:
                if item.tag in BLOCKS:
                    end()
                continue
            if item.tag == "br":
                parts.append(" ")
                continue
            if item.tag in BLOCKS:
                end()
                todo.append((None, False, inside))
            within = item if item.tag in CONTAINERS else inside
            todo.extend((c, link or item.tag == "a", within) for c in reversed(item.children))
    end()
    return out


def containers(root: Node) -> list[Node]:
    """Containers in page order, an outer one before those in it."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.skipped or node.furniture:
            continue
        if node.tag in CONTAINERS or node is root:
            out.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def scores(root: Node) -> list[tuple[float, Node]]:
    """How much each container looks like the page's article: unlinked text and sentences, more for semantic tags.

    Every block is measured once, for its innermost container; sums go from the inside out.
    """
    total: dict[Node, float] = {}
    for text, linked, owner in blocks(root):
        plain = len(text) - min(len(text), 2 * linked)
        total[owner] = total.get(owner, 0.0) + plain * (1.0 if len(text) >= 40 else 0.6) + 15 * sum(text.count(c) for c in ".!?")
    out, outer, todo = [], {}, [(root, root)]
    while todo:
        node, around = todo.pop()
        if node.skipped or node.furniture:
            continue
        if node.tag in CONTAINERS:
            outer[node] = around
            around = node
        todo.extend((c, around) for c in node.children if isinstance(c, Node))
    for node in reversed(containers(root)):
        own = total.get(node, 0.0)
        if node is not root:
            total[outer[node]] = total.get(outer[node], 0.0) + own
        weight = {"article": 1.3, "main": 1.15, "body": 0.85, "#": 0.8}.get(node.tag, 1.0)
        if re.search(r"article|content|entry|post|story|text|main", node.name, re.I):
            weight *= 1.15
        out.append((own * weight, node))
    return out


def best(root: Node) -> Node | None:
    """The container with the highest score; of equal ones the innermost, then the first."""
    ranked = scores(root)
    top = max(x for x, _ in ranked) if ranked else 0.0
    return max((n for x, n in reversed(ranked) if x >= top), key=lambda n: n.depth) if top > 0 else None


def vote(source: str) -> str | None:
    node = best(parse(source))
    return node.path() if node is not None else None


def extract(source: str, paths: list[str]) -> str:
    """Text of the containers on the winning paths, outermost only; of the page's own best container if none matches."""
    root = parse(source)
    chosen: list[Node] = []
    # Each element with the paths that lead on from it, and how much of them it has used.
    todo: list[tuple[Node, list[tuple[str, int]]]] = [(c, [(p, 0) for p in paths]) for c in reversed(root.children) if isinstance(c, Node)]
    while todo and paths:
        node, ways = todo.pop()
        if node.skipped or node.furniture:
            continue
        on = [(p, at + len(node.name)) for p, at in ways if p.startswith(node.name, at)]
        if any(at == len(p) for p, at in on):
            chosen.append(node)
        elif on := [(p, at + 1) for p, at in on if p.startswith("/", at)]:
            todo.extend((c, on) for c in reversed(node.children) if isinstance(c, Node))
    texts = [text for n in chosen for text, _, _ in blocks(n)]
    if not texts and (own := best(root)) is not None:
        texts = [text for text, _, _ in blocks(own)]
    return "\n\n".join(texts)


def host_paths(pages: DataFrame, least_share: float = 0.3, id_col: str = "page_id") -> DataFrame:
    """host and its winning paths: those with at least least_share of the host's votes, at most three by definition."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        paths = [vote(h) if h else None for h in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["host", "path"])

    votes = map_batches(pages.select(host_of(F.col("url")).alias("host"), "html"), run, "host string, path string").where("path is not null")
    counts = stored(votes.groupBy("host", "path").agg(F.count("*").alias("n")), "votes")
    total = counts.groupBy("host").agg(F.sum("n").alias("all"))
    winners = counts.join(total, "host").where(F.col("n") >= least_share * F.col("all"))
    return stored(winners.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("paths")), "winners")


def main_text(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id, url and text of each row's main content."""
    winners = host_paths(pages, id_col=id_col)
    kind = pages.select(id_col).schema[0].dataType.simpleString()
    each = pages.select(F.col(id_col), "url", "html", host_of(F.col("url")).alias("host"))
    out = f"`{id_col}` {kind}, url string, text string"
    rows = winners.limit(MOST_WINNERS + 1).collect() if winners.count() <= MOST_WINNERS else None
    if rows is not None:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: r.paths for r in rows})

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [extract(h, shared.value.get(host, [])) if h else "" for h, host in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, "url", "text"])

        return map_batches(each, run, out)

    salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = each.withColumn("salt", F.pmod(F.xxhash64(F.col(id_col).cast("string"), "url"), F.lit(SALTS)).cast("int"))  # copies of a page are dealt out too
    both = dealt.join(salted, ["host", "salt"], "left").select(id_col, "url", "html", "paths")

    def run_joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h, p or []) if h else "" for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, "url", "text"])

    return map_batches(both, run_joined, out)
