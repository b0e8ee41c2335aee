"""Main text of web pages by wrapper induction over pages of one host.

Pages become trees in which equal neighbours (list items, paragraphs) are one repeated node. Trees of one host are
aligned by simple tree matching and merged into a wrapper: every node counts the pages that have it and knows
whether its text was the same on all of them. Constant nodes are template, varying nodes are slots; the wrapper's
content is the slot subtree that holds the article. A page is then matched with its host's wrapper and the blocks
under content nodes are its text.
"""

from __future__ import annotations

import html as references
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from qaspark.llm.common import ship
from qaspark.session import cut

# Element names of HTML and common names of page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template svg iframe object canvas audio video math head title".split())
CHROME = set("nav header footer aside form button select menu dialog textarea option fieldset".split())
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTENT_NAMES = set("article content post entry main story body-text articlebody post-content entry-content article-body".split())
CHROME_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar side-bar rail widget menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer notice notices cookie cookies consent gdpr alert popup modal overlay subscribe subscription newsletter signup "
    "login share sharing social related recommended recommendations pagination pager comment comments commentlist comment-list disqus replies reply respond "
    "discussion reader-comments tags toolbar skip".split()
)
CHROME_FIRST = set("ad ads advert advertisement sidebar cookie comment comments share social promo sponsor sponsored newsletter notice banner menu nav navbar footer popup related breadcrumb subscribe".split())
CHROME_LAST = set("ad ads advert advertisement sidebar comments notice menu nav navbar banner breadcrumbs newsletter".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("ul ol table dl select body html td th tr article section div".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
NAMES = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


DEPTH = 200


class Node:
    __slots__ = ("tag", "names", "key", "parts", "parent", "depth")

    def __init__(self, tag: str, names: tuple[str, ...], parent: "Node | None", key: str = "") -> None:
        self.tag, self.names, self.parent, self.key = tag, names, parent, key
        self.depth = 0 if parent is None else parent.depth + 1
        self.parts: list[Node | str] = []


def parse(page: str) -> Node:
    """A forgiving tree: end tags close what is open, a block closes an open paragraph, the rest is text.

    Elements nested deeper than ``DEPTH`` stay empty and their content goes to the element around them.
    """
    root = here = Node("html", (), None)
    at, end = 0, len(page)
    flat: dict[str, int] = {}
    while at < end:
        found = TOKEN.search(page, at)
        if not found:
            here.parts.append(page[at:])
            break
        if found.start() > at:
            here.parts.append(page[at : found.start()])
        at, tag = found.end(), found.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if found.group(1):
            if flat.get(tag):
                flat[tag] -= 1
                here.parts.append(Node(tag, (), here))
                continue
            up = here
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                here = up.parent
            continue
        if tag == "html":
            continue
        if tag in BLOCKS:
            here = _close(here, {"p"}, BLOCKS - {"p"})
        if tag in CLOSES:
            here = _close(here, CLOSES[tag], SCOPE - CLOSES[tag])
        attributes = found.group(3)
        found_names = [(m[1].lower(), w) for m in NAMES.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").lower().split()] if "=" in attributes else []
        node = Node(tag, tuple(w for _, w in found_names), here, " ".join(filter(None, (_stable(*x) for x in found_names))))
        here.parts.append(node)
        if tag in VOID or attributes.rstrip().endswith("/"):
            continue
        if tag in ("script", "style", "textarea", "title", "noscript", "template", "iframe"):
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if node.depth > DEPTH:
            flat[tag] = flat.get(tag, 0) + 1
            continue
        here = node
    return root


def _close(here: Node, tags: set[str], walls: set[str]) -> Node:
    """Leave the nearest open element of ``tags`` unless a wall stands between."""
    up = here
    while up is not None and up.tag not in tags and up.tag not in walls:
        up = up.parent
    return up.parent if up is not None and up.tag in tags and up.parent is not None else here


DIGITS = re.compile(r"\d+")


def _stable(kind: str, name: str) -> str:
    """What of a name is the layout's: ids and digits are a page's own, but what they say of furniture or content stays."""
    if kind != "id":
        bare = DIGITS.sub("", name)
        if _furniture_name(name) == _furniture_name(bare):
            return bare
        return "widget" if _furniture_name(name) else ""
    return "widget" if _furniture_name(name) else name if name in CONTENT_NAMES else ""


def furniture(node: Node) -> bool:
    """By element, or by a name such as ``sidebar``, ``cookie-bar`` or ``reader-comments``; ``has-sidebar`` says nothing of the kind."""
    if node.tag in SILENT or node.tag in CHROME:
        return True
    if node.tag in ("html", "body", "article", "main"):
        return False
    return any(map(_furniture_name, node.names))


def _furniture_name(name: str) -> bool:
    parts = re.split(r"[-_]+", name)
    return name in CHROME_NAMES or parts[0] not in ("has", "no", "with") and (parts[0] in CHROME_FIRST or parts[-1] in CHROME_LAST)


# --- wrappers -------------------------------------------------------------------------------------------
# A wrapper node is [tag, names, pages, text hash or None where it varies, characters, link characters, children].


def outline(node: Node, seen: dict) -> list:
    """The page's own wrapper. ``seen`` maps id(wrapper node) to its page nodes."""
    text, chars, links, children = [], 0, 0, []
    for part in node.parts:
        if isinstance(part, str):
            piece = part.strip()
            if piece:
                text.append(piece)
                chars += len(piece)
            continue
        if part.tag in SILENT:
            continue
        child = outline(part, seen)
        chars, links = chars + child[4], links + child[5]
        if children and children[-1][:2] == child[:2]:
            _join(children[-1], child, seen, 0)
        else:
            children.append(child)
    if node.tag == "a":
        links = chars
    digest = xxhash.xxh64_intdigest(" ".join(text)) if text else 0
    out = [node.tag, node.key, 1, digest, chars, links, children]
    seen[id(out)] = [node]
    return out


def _join(one: list, two: list, seen: dict | None, pages: int) -> None:
    """Merge ``two`` into ``one``: aligned children are merged, others are put in their order."""
    if one[3] != two[3]:
        one[3] = None
    one[2] += pages
    one[4] += two[4]
    one[5] += two[5]
    if seen is not None and id(two) in seen:
        seen[id(one)] += seen.pop(id(two))
    out, at = [], 0
    for i, j in _aligned(one[6], two[6]):
        if i is None:
            out.append(two[6][j])
        else:
            out.append(one[6][i])
            if j is not None:
                _join(one[6][i], two[6][j], seen, two[6][j][2] if pages else 0)
    one[6] = out


def tree_match(one: list, two: list) -> int:
    """Simple tree matching: nodes in the largest order-preserving match of two trees with equal roots."""
    if one[:2] != two[:2]:
        return 0
    return 1 + _table(one[6], two[6])[-1][-1]


def _table(a: list, b: list) -> list[list[int]]:
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row, above = [0], rows[-1]
        for j, y in enumerate(b):
            best = above[j + 1] if above[j + 1] >= row[j] else row[j]
            if x[0] == y[0] and x[1] == y[1]:
                both = above[j] + (tree_match(x, y) if x[6] and y[6] else 1)
                best = both if both > best else best
            row.append(best)
        rows.append(row)
    return rows


def _aligned(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """Pairs of matched children and, between them, the unmatched ones of both sides."""
    if len(a) == len(b) and all(x[0] == y[0] and x[1] == y[1] for x, y in zip(a, b)):
        return [(i, i) for i in range(len(a))]
    rows, i, j, out = _table(a, b), len(a), len(b), []
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
            out.append((i, None))
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
            out.append((None, j))
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    out += [(k, None) for k in range(i - 1, -1, -1)] + [(None, k) for k in range(j - 1, -1, -1)]
    return out[::-1]


def merged(wrappers: list[list]) -> list | None:
    total = None
    for w in wrappers:
        if total is None:
            total = w
        else:
            _join(total, w, None, w[2])
    return total


def is_chrome(node: list) -> bool:
    probe = Node(node[0], tuple(node[1].split()), None)
    return furniture(probe)


def content_path(wrapper: list) -> list[tuple[str, str, int]]:
    """Keys from the root to the wrapper's content node, each with its place among siblings of equal key.

    A node that says it is the article wins, the largest of several. Else the walk goes down from the root to the child
    that holds most of the text outside furniture and links, as long as one child holds three fifths of it.
    """
    best: tuple[int, list] = (0, [])

    def named(node: list, path: list, step: tuple) -> None:
        nonlocal best
        if is_chrome(node):
            return
        path = [*path, step]
        if (node[0] in ("article", "main") or CONTENT_NAMES & set(node[1].split())) and node[4] > best[0]:
            best = (node[4], path)
        for step, child in zip(_steps(node), node[6]):
            named(child, path, step)

    for step, child in zip(_steps(wrapper), wrapper[6]):
        named(child, [], step)
    if best[1]:
        article = [k for k, (tag, *_) in enumerate(best[1]) if tag == "article"]
        return best[1][: article[0] + 1] if article else best[1]
    node, path = wrapper, []
    while True:
        inner = [(c[4] - c[5], c, step) for step, c in zip(_steps(node), node[6]) if not is_chrome(c) and c[0] in BLOCKS]
        total = sum(n for n, *_ in inner)
        if not inner or not total:
            return path
        most, child, step = max(inner, key=lambda x: x[0])
        if most < 0.6 * total or not any(c[0] in BLOCKS for c in child[6]):
            return path
        node, path = child, [*path, step]


def _steps(node: list) -> list[tuple[str, str, int]]:
    """Tag, names and place among siblings of equal tag and names, for every child."""
    seen: dict[tuple[str, str], int] = {}
    out = []
    for child in node[6]:
        key = (child[0], child[1])
        seen[key] = seen.get(key, -1) + 1
        out.append((*key, seen[key]))
    return out


def content_paths(wrapper: list) -> list[list[tuple[str, str, int]]]:
    """The content node's path, then those of the content's other parts.

    A part has the tag and names of a node on the path and stands beside it, apart from it. It holds paragraphs, most
    of its text is outside links, and it varies where the wrapper is of several pages.
    """
    main = content_path(wrapper)
    node, paths = wrapper, [main]
    for depth, step in enumerate(main):
        for other, child in zip(_steps(node), node[6]):
            if other[:2] == step[:2] and other != step and not is_chrome(child) and _prose(child) and (wrapper[2] < 2 or _varying(child)):
                paths.append([*main[:depth], other])
        node = _descend(wrapper, main[: depth + 1])
    return paths


def _prose(node: list) -> bool:
    return 2 * node[5] < node[4] and (node[0] == "p" or any(_prose(c) for c in node[6]))


def template_keys(wrapper: list, path: list[tuple[str, str, int]]) -> list[tuple[str, str]]:
    """Children of the content node that are constant on at least five pages while others vary: template inside it.

    Paragraphs, headings and lists are never template: an article may repeat another's sentence.
    """
    node = _descend(wrapper, path)
    if node is None or node[2] < 5:
        return []
    varies = any(_varying(c) for c in node[6])
    plain = {"p", "ul", "ol", "blockquote", "pre", "table", *HEADINGS}
    return [(c[0], c[1]) for c in node[6] if varies and c[0] not in plain and c[1] and c[2] >= 0.9 * node[2] and c[4] and not _varying(c)]


def _varying(node: list) -> bool:
    return node[3] is None or any(_varying(c) for c in node[6])


def _descend(wrapper: list, path: list) -> list | None:
    node = wrapper
    for key in path:
        node = next((c for step, c in zip(_steps(node), node[6]) if step == tuple(key)), None)
        if node is None:
            return None
    return node


# --- extraction -------------------------------------------------------------------------------------------


def blocks_of(node: Node, skip: set[tuple[str, str]]) -> list[str]:
    """Texts of the blocks under a content node in page order."""
    out: list[str] = []
    text: list[str] = []

    def flush() -> None:
        line = " ".join(references.unescape("".join(text)).split())
        text.clear()
        if line:
            out.append(line)

    stack: list = [(node, iter(node.parts))]
    while stack:
        here, parts = stack[-1]
        part = next(parts, None)
        if part is None:
            stack.pop()
            if here.tag in BLOCKS:
                flush()
        elif isinstance(part, str):
            text.append(part)
        elif part.tag == "br":
            text.append(" ")
        elif part.tag in HEADINGS and here.tag == "header" or not _left_out(part, skip):
            if part.tag in BLOCKS:
                flush()
            stack.append((part, iter(part.parts)))
    flush()
    return out


def _left_out(node: Node, skip: set[tuple[str, str]]) -> bool:
    if node.tag == "header":  # an article's own header holds its headline
        return not any(isinstance(p, Node) and p.tag in HEADINGS for p in node.parts)
    return furniture(node) or bool(node.key) and (node.tag, node.key) in skip


def extract(page: str, wrapper: list | None, paths: list, skip: list) -> str:
    """The page's main text by its host's wrapper; a page that the wrapper does not fit is its own wrapper."""
    root = parse(page)
    seen: dict = {}
    own = outline(root, seen)
    found = [_matching(own, wrapper, path) for path in paths] if wrapper is not None else [None]
    if found[0] is None:
        found = [_descend(own, path) for path in content_paths(own)]
        skip = []
    nodes = [node for part in found if part is not None for node in seen.get(id(part), [root])]
    if len(nodes) > 1:
        nodes = _in_page_order(root, nodes)
    skips = {tuple(k) for k in skip}
    return "\n".join(line for node in nodes for line in blocks_of(node, skips))


def _in_page_order(root: Node, nodes: list[Node]) -> list[Node]:
    """The nodes as they stand on the page, each once."""
    wanted, out, stack = {id(n) for n in nodes}, [], [root]
    while stack:
        node = stack.pop()
        if id(node) in wanted:
            out.append(node)
        stack += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return out


def _matching(own: list, wrapper: list, path: list) -> list | None:
    """The page's node that simple tree matching aligns with the wrapper's content node."""
    here, there = own, wrapper
    for key in path:
        at = next((i for i, step in enumerate(_steps(there)) if step == tuple(key)), None)
        step = next(((here[6][j], there[6][i]) for i, j in _aligned(there[6], here[6]) if i is not None and i == at and j is not None), None)
        if step is None:
            return None
        here, there = step
    return here


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


@dataclass(frozen=True)
class WrapperExtraction:
    """Main text of every page.

    Input ``page_id``, ``url``, ``html``; other columns are ignored. A null or empty html gives an empty text. Pages
    without a host (null or odd url) share one wrapper. Hosts with one page, and pages that do not fit their host's
    wrapper, are judged by their own tree. Repeated rows are extracted each. Wrappers are merged first within a task,
    then within salts whose number is the root of the number of tasks, then by host, so that no task sees more
    than about that many partial wrappers of a hot host. A null ``page_id`` is kept; equal pages get equal texts, so ties do
    not matter. Pages of any length are parsed whole. An empty table gives no rows. Returns ``page_id``, ``url``, ``text``.
    """

    def wrappers(self, pages: DataFrame) -> DataFrame:
        """(``host``, ``wrapper``): JSON of the wrapper with its content path and inner template."""

        def induce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: dict[str, list] = {}
            for batch in batches:
                for host, page in zip(batch["host"], batch["html"]):
                    own = outline(parse(page), {})
                    if host in found:
                        _join(found[host], own, None, 1)
                    else:
                        found[host] = own
            if found:
                yield pd.DataFrame({"host": list(found), "wrapper": [json.dumps(w) for w in found.values()]})

        def merge(rows: pd.DataFrame) -> pd.DataFrame:
            total = merged([json.loads(w) for w in sorted(rows["wrapper"])])
            return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(total)]})

        def finish(rows: pd.DataFrame) -> pd.DataFrame:
            total = merged([json.loads(w) for w in sorted(rows["wrapper"])])
            paths = content_paths(total)
            plan = [_bare(total, paths), paths, [key for path in paths for key in template_keys(total, path)]]
            return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(plan)]})

        schema = "host string, wrapper string"
        parts = cut(self.hosted(pages).filter("html <> ''").select("host", "html").mapInPandas(induce, schema).withColumn("part", F.spark_partition_id()), "wrapper-parts")
        salts = int((parts.agg(F.max("part")).first()[0] or 0) ** 0.5) + 1
        once = parts.groupBy("host", F.pmod("part", F.lit(salts))).applyInPandas(lambda rows: merge(rows), schema)
        return cut(once.groupBy("host").applyInPandas(finish, schema), "wrappers")

    def hosted(self, pages: DataFrame) -> DataFrame:
        url = F.coalesce(F.col("url").cast(StringType()), F.lit(""))
        return pages.select("page_id", "url", F.lower(F.regexp_extract(url, HOST, 1)).alias("host"), F.coalesce(F.col("html").cast(StringType()), F.lit("")).alias("html"))

    def __call__(self, pages: DataFrame) -> DataFrame:
        from qaspark.operators.base import fits_broadcast

        ship(pages)
        plans = self.wrappers(pages)
        known: dict[str, tuple] = {}

        @F.pandas_udf(StringType())
        def text_of(htmls: pd.Series, wrappers: pd.Series) -> pd.Series:
            out = []
            for page, plan in zip(htmls, wrappers):
                if plan is not None and plan not in known:
                    if len(known) > 256:
                        known.clear()
                    known[plan] = tuple(json.loads(plan))
                out.append(extract(page, *(known[plan] if plan is not None else (None, [], []))) if page else "")
            return pd.Series(out, dtype=object)

        side = F.broadcast(plans) if fits_broadcast(plans) else plans
        return self.hosted(pages).join(side, "host", "left").select("page_id", "url", text_of("html", "wrapper").alias("text"))


def _bare(wrapper: list, paths: list) -> list:
    """The wrapper down to its content nodes; what lies beside the paths keeps only its keys."""
    below = lambda step: [path[1:] for path in paths if path and tuple(path[0]) == step]
    children = [_bare(c, below(step)) if below(step) else [*c[:6], []] for step, c in zip(_steps(wrapper), wrapper[6])] if any(paths) else []
    return [*wrapper[:6], children]
