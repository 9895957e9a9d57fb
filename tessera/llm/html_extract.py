"""Main text of web pages, with each site's recurring template removed.

A page is parsed once, on the executors: its main text as blocks, and with each block the hashes of
the elements around it (tag, class, id, role, text and child hashes of their subtrees). Spark counts, per host, the
different main texts that hold each hash. A subtree recurs if ``MIN_PAGES`` different
main texts of one host hold it, and its blocks go. Everything else about what is no main text is said by
element: navigation, headers, footers, asides, forms, scripts and the like, and containers
marked as comments, notices or adverts.

Inside a main element only recurring containers (divisions, lists, tables, ...) are
dropped, not recurring paragraphs or headings: articles may share a sentence. Recurring hashes stay rows of (host,
hash): a page's own are joined with them on both, so neither a host nor a subtree with very many
pages is one group. What a page loses is bounded by the page.

Defined cases: a null page is an empty one and has no text; a null url, or one without a host,
counts for the host ``""``; markup may be cut off or wrongly nested, and a quote that never closes runs to the page's end; of
main elements with text all outermost ones are taken in page order,
without one the whole body; repeated pages count as one; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.url_filters import host_of
from tessera.plans.staging import broadcast_if, measured, stage

#: Pages of a host, with different main texts, from which on a subtree is template.
MIN_PAGES = 5
BROADCAST_BYTES = 8 * 1024 * 1024

# Every match keeps all it has looked at, so a page is read in one go however it is damaged.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/]++)(?:\s*+=\s*+(\"[^\"]*+|'[^']*+|[^\s\"'>][^\s>]*+)?+)?+")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: Elements that take no place on the page and so break no line.
UNSEEN = frozenset(("script", "style", "template"))
#: Elements that are never main text, by tag, by role, and by a word of class or id.
DROPPED_TAGS = frozenset(
    "nav header footer aside form script style noscript iframe template head title button select "
    "textarea input object embed canvas dialog menu".split()
)
#: Whatever these hold stands in the line, as formulas do.
FOREIGN = frozenset(("math", "svg"))
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "footer form header menu modal nav navbar navigation newsletter notice notices popup promo related share "
    "sharing sidebar signup social sponsor sponsored subscribe widget".split()
)
#: Inside a main element only containers with one of these as a whole class or id go.
_CONTAINERS = frozenset("div section ul ol dl figure table fieldset details".split())
_INNER_NAMES = frozenset(
    "ad ads advert adverts advertisement comment comments consent cookie cookies cookie-notice newsletter notice notices popup "
    "promo reader-comments sponsor sponsored user-comments".split()
)
MAIN_TAGS = frozenset(("article", "main"))
_CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol "
    "p pre section table ul".split()
)
#: An open element of the set is closed by a new one of the key.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Recurring elements with these tags are kept inside the main element.
_PROSE = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr caption figcaption br".split())


class Node:
    """An element: what it holds are strings and further nodes, in page order."""

    __slots__ = ("children", "dropped", "foreign", "hash", "main", "marked", "marks", "tag")

    def __init__(self, tag: str, attributes: str, foreign: bool = False):
        self.tag, self.children, self.hash, self.marks = tag, [], 0, ""
        self.main, self.dropped, self.marked = tag in MAIN_TAGS, tag in DROPPED_TAGS, False
        self.foreign = foreign or tag in FOREIGN
        if attributes.strip(" /"):
            found: dict[str, str] = {}
            for name, value in _ATTRIBUTE.findall(attributes):
                found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
            role = found.get("role", "").lower()
            self.marks = "|".join(found.get(k, "") for k in ("class", "id", "role"))
            names = f"{found.get('class', '')} {found.get('id', '')}".lower()
            self.main |= role == "main"
            self.dropped |= role in DROPPED_ROLES or "hidden" in found
            self.dropped |= tag in _CONTAINERS and not _INNER_NAMES.isdisjoint(names.split())
            self.marked = not DROPPED_WORDS.isdisjoint(re.split(r"[^a-z]+", names)) and tag not in ("html", "body", *MAIN_TAGS)

    @property
    def inline(self) -> bool:
        return self.foreign or self.tag in INLINE


def parse(page: str | None) -> Node:
    """The tree of a page; unclosed and misplaced tags are mended as far as blocks need it."""
    root = Node("", "")
    path, at, text = [root], 0, page or ""
    open_: Counter[str] = Counter()  # what is not open is not looked for

    def close(tags: set[str] | frozenset[str], walls: set[str]) -> None:
        """Close the innermost open element of the tags, unless a wall stands before it."""
        if not any(open_[t] for t in tags):
            return
        for depth in range(len(path) - 1, 0, -1):
            if path[depth].tag in tags:
                open_.subtract(n.tag for n in path[depth:])
                del path[depth:]
                return
            if path[depth].tag in walls:
                return

    while at < len(text):
        match = _TOKEN.search(text, at)
        end = match.start() if match else len(text)
        if end > at:
            path[-1].children.append(text[at:end])
        if not match:
            break
        at = match.end()
        tag = match[2].lower() if match[2] else ""
        if not tag:
            continue
        if match[1]:
            close({tag}, set())
            continue
        if tag in _CLOSES_PARAGRAPH:
            close({"p"}, {"button", "td", "th", "li"})
        elif tag in _SIBLINGS:
            close(_SIBLINGS[tag], {"ul", "ol", "dl", "table", "select"})
        node = Node(tag, match[3], path[-1].foreign)
        path[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*+>|\Z", re.IGNORECASE).search(text, at)
            node.children.append(text[at : stop.start()])
            at = stop.end()
        elif tag not in VOID and not match[3].endswith("/"):
            path.append(node)
            open_[tag] += 1
    return root


def _nodes(root: Node) -> list[Node]:
    """All elements, children before parents."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    return order[::-1]


def hash_subtrees(root: Node) -> list[Node]:
    """Sets the hash of every element; those with any text are returned."""
    texts: dict[int, bool] = {}
    for node in _nodes(root):
        parts, full = [node.tag, node.marks], False
        for child in node.children:
            if isinstance(child, Node):
                parts.append(f"\x01{child.hash}")
                full |= texts[id(child)]
            else:
                words = _SPACE.sub(" ", child).strip()
                full |= bool(words)
                parts.append(words)
        texts[id(node)] = full
        node.hash = xxhash.xxh64_intdigest("\x00".join(parts)) - (1 << 63)
    return [n for n in _nodes(root) if texts[id(n)]]


def main_parts(root: Node) -> list[Node]:
    """The outermost main elements that have text left, in page order; else the whole page."""
    todo, out = [root], []
    while todo:
        node = todo.pop()
        if node.main and not node.dropped and _blocks(node, True):
            out.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped]
    return out or [root]


def _blocks(top: Node, inside: bool) -> list[tuple[str, tuple[int, ...]]]:
    """Texts of the blocks below an element, without dropped ones, with the hashes of the elements
    around each that go if they recur."""
    out: list[tuple[str, tuple[int, ...]]] = []
    line: list[str] = []
    around: list[int] = []

    def end() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(line))).strip()
        line.clear()
        if text:
            out.append((text, tuple(around)))

    todo: list[Node | str | bool] = [top]  # True and False end an element that is in `around` or not
    while todo:
        item = todo.pop()
        if isinstance(item, bool):
            end()
            if item:
                around.pop()
        elif isinstance(item, str):
            line.append(item)
        elif item is not top and (item.dropped or item.marked and not inside):
            if not item.inline and item.tag not in UNSEEN:
                end()
        elif item.tag == "br":
            line.append(" ")
        else:
            if not item.inline:
                end()
                held = item is not top and item.tag not in ("html", "body") and not (inside and item.tag in _PROSE)
                if held:
                    around.append(item.hash)
                todo.append(held)
            todo += reversed(item.children)
    end()
    return out


def page_blocks(page: str | None) -> list[tuple[str, tuple[int, ...]]]:
    """The main text's blocks, each with the hashes of the containers around it."""
    root = parse(page)
    hash_subtrees(root)
    return [block for top in main_parts(root) for block in _blocks(top, top is not root)]


def main_text(page: str | None, recurring: frozenset[int] | set[int] = frozenset()) -> str:
    return "\n".join(text for text, around in page_blocks(page) if recurring.isdisjoint(around))


def parsed_pages(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Columns ``row`` (a number of the page), ``id``, ``url``, ``host``, ``texts`` and ``around`` (of each block), ``hashes``
    (all of ``around``, each once) and ``of`` (a hash of the whole main text)."""
    given = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(page).alias("page")
    )
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_blocks(value.as_py()) for value in batch.column("page")]
            texts = [[text for text, _ in own] for own in found]
            around = [[list(hashes) for _, hashes in own] for own in found]
            whole = [xxhash.xxh64_intdigest("\n".join(t)) - (1 << 63) for t in texts]
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("row", "id", "url", "host")), pa.array(texts, pa.list_(pa.string())), pa.array(around, pa.list_(many)),
                 pa.array([list({h for _, hashes in own for h in hashes}) for own in found], many), pa.array(whole, pa.int64())],
                names=["row", "id", "url", "host", "texts", "around", "hashes", "of"],
            )

    return given.mapInArrow(
        work,
        f"row bigint, id {kinds['id']}, url {kinds['url']}, host string, texts array<string>, around array<array<bigint>>, hashes array<bigint>, of bigint",
    )


def recurring_subtrees(parsed: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Columns ``host``, ``hash``: the subtrees that recur on a host."""
    seen = parsed.select("host", F.explode("hashes").alias("hash"), "of")
    # different main texts per subtree: equal rows are combined within tasks, then counted
    return seen.distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("host", "hash")


def extract(
    pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html", min_pages: int = MIN_PAGES,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per page: id, url and ``text``."""
    parsed = stage(parsed_pages(pages, id, url, page), "pages-parsed")
    sites = stage(recurring_subtrees(parsed, min_pages), "site-templates")
    size = measured(sites, bytes=F.coalesce(F.sum(F.octet_length("host") + 64), F.lit(0)))["bytes"]
    own = parsed.select("row", "host", F.explode("hashes").alias("hash"))
    met = own.join(broadcast_if(sites, size, broadcast_bytes), ["host", "hash"]).groupBy("row").agg(F.collect_list("hash").alias("gone"))
    met = stage(met, "pages-recurring")
    size = measured(met, bytes=F.coalesce(F.sum(8 * F.size("gone") + 64), F.lit(0)))["bytes"]
    rows = parsed.join(broadcast_if(met, size, broadcast_bytes), "row", "left")
    stays = lambda b: ~F.arrays_overlap(b["around"], F.coalesce("gone", F.array().cast("array<bigint>")))
    left = F.transform(F.filter(F.arrays_zip("texts", "around"), stays), lambda b: b["texts"])
    return rows.select(F.col("id").alias(id), F.col("url").alias(url), F.array_join(left, "\n").alias("text"))
