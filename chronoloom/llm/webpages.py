"""Main text of web pages by removing what a site repeats on its pages.

A page is read into a tree of elements. Every block is hashed with all that is in it, and Spark counts, for each host, on
how many of its distinct pages a hash occurs. Subtrees that recur on many pages of their host are its template and are
deleted, as are the elements whose very name or class says that they are not text of the article. What is left of the
articles (of the main element or the whole body, on pages without one) is joined block by block.

Blocks inside an article are counted apart and must be on a larger share of the pages; its paragraphs are never template.
Nothing recurses and no open element is searched for twice, so deep nesting costs what its length costs.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import slices, written

# Fixed values of HTML: elements without content, with raw text, whose end tag may be left out, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes svg math".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
_ENDS_P = BLOCKS - {"br", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dt", "dd", "body", "html", "legend", "summary", "select"}
_SCOPE = frozenset("article aside body div dl footer form header html main nav ol section table td th ul".split())
#: Elements that are never text of the article, by name and by words of class, id or role.
DROP = frozenset("script style noscript template iframe svg math head title nav footer aside form button select textarea input dialog menu object canvas audio video".split())
DROP_CLASS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup comment comments commentlist disqus replies respond share sharing social related recommended widget widgets toolbar pagination pager complementary contentinfo".split()
)
DROP_LABEL = frozenset("header site-header page-header search discussion skip-link reactions".split())
_WRAPS = re.compile(r"^(?:has|with|no|without|is|js)[-_]|[-_](?:with|without|no|has)[-_]")
_TAG = re.compile(r"<(?:!--.*?(?:-->|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|[!?/][^>]*(?:>|$))", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-label)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WHITE = re.compile(r"\s+")
_LAYOUT = frozenset(("html", "body", "article", "main", "br", "hr"))
#: An article's own paragraphs may recur, as articles quote each other and sites repeat themselves: never template.
_PARAGRAPHS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 table tr td th tbody thead li figure figcaption dt dd".split())
#: Fixed value of HTML: of inline elements of one name, at most so many go on in the next block.
_REOPENED = 3
#: Hashes of a site's template are broadcast up to so many and joined with the pages' blocks beyond.
BROADCAST_HASHES = 2_000_000
#: A host with more hashes than that has them matched page by page, so that no row carries a long list.
HOST_HASHES = 1000
BROADCAST_HOSTS = 500_000


class Node:
    __slots__ = ("name", "labels", "children")

    def __init__(self, name: str, labels: tuple[str, ...] = ()) -> None:
        self.name, self.labels, self.children = name, labels, []


def parse(page: str) -> Node:
    """The page's tree; texts are strings among the children. Unclosed and misplaced tags are taken as browsers would in the usual cases."""
    root = Node("#root")
    stack = [root]
    open_ = Counter()  # names on the stack

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        stack.append(node)
        open_[node.name] += 1

    def pop() -> Node:
        node = stack.pop()
        open_[node.name] -= 1
        return node

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if open_[name]:
                while pop().name != name:
                    pass
            elif name in ("p", "br"):
                stack[-1].children.append(Node("br"))
            continue
        ends = CLOSES.get(name, frozenset()) | (frozenset(("p",)) if name in _ENDS_P else frozenset())
        if any(open_[x] for x in ends):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in ends:
                    again: list[Node] = []
                    while len(stack) > i:
                        x = pop()
                        if x.name not in BLOCKS and sum(y.name == x.name for y in again) < _REOPENED:
                            again.append(x)
                    for x in reversed(again):
                        push(Node(x.name, x.labels))
                    break
                if stack[i].name in _SCOPE:
                    break
        labels = tuple(w for k, v in _ATTR.findall(m[3]) if k.lower() in ("class", "id", "role") for w in v.strip("\"'").lower().split()) if m[3] else ()
        node = Node(name, labels)
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            stack[-1].children.append(node)
            continue
        if name in RAW:
            stack[-1].children.append(node)
            end = _raw_end(name).search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else n
            continue
        push(node)
    return root


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(f"</{re.escape(name)}", re.I)


def _says(label: str) -> bool:
    return label in DROP_LABEL or (not _WRAPS.search(label) and not DROP_CLASS.isdisjoint(re.split("[-_]+", label)))


def _dropped(node: Node, inside: bool) -> bool:
    return node.name in DROP or (node.name not in _LAYOUT - {"article"} and any(_says(w) for w in node.labels)) or (node.name == "header" and not inside)


def _articles(root: Node) -> list[Node]:
    """The outermost articles outside what is dropped by name or class; on pages without one the first main element, if any."""
    articles, mains, todo = [], [], [root]
    while todo:
        node = todo.pop()
        if node.name == "article":
            articles.append(node)
            continue
        if node.name == "main" or (node.name == "div" and "main" in node.labels):
            mains.append(node)
        todo += [x for x in reversed(node.children) if isinstance(x, Node) and not _dropped(x, False)]
    return articles or mains[:1]


def hashes(root: Node, articles: list[Node]) -> tuple[int, dict[int, int]]:
    """(hash of the articles' text, or of the page's where there are none; hashes of the blocks by identity of the element).

    The last bit of a block's hash tells whether it lies inside an article.
    """
    inner = {id(x) for x in articles}
    out: dict[int, int] = {}
    digest: dict[int, bytes] = {}
    todo: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while todo:
        node, inside, ready = todo.pop()
        inside = inside or id(node) in inner
        if not ready:
            todo.append((node, inside, True))
            todo += [(x, inside, False) for x in node.children if isinstance(x, Node)]
            continue
        h = hashlib.blake2b(node.name.encode(), digest_size=8)
        for x in node.children:
            if isinstance(x, Node):
                h.update(digest[id(x)] if id(x) in inner else digest.pop(id(x)))
            elif s := _WHITE.sub(" ", x).strip():
                h.update(s.encode("utf-8", "surrogatepass") + b"\x00")
        digest[id(node)] = h.digest()
        if node.name in BLOCKS and node.name not in _LAYOUT and id(node) not in inner and not (inside and node.name in _PARAGRAPHS):
            out[id(node)] = int.from_bytes(h.digest(), "little", signed=True) & ~1 | inside
    page = hashlib.blake2b(b"".join(digest[id(x)] for x in articles or [root]), digest_size=8).digest()
    return int.from_bytes(page, "little", signed=True), out


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def main_text(page: str, template: frozenset[int] = frozenset()) -> str:
    """The main text of a page, given the hashes of its site's template."""
    root = parse(page)
    articles = _articles(root)
    found = hashes(root, articles)[1] if template else {}
    inside = bool(articles)
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = _WHITE.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if text:
            blocks.append(text)

    # what is still to come: texts, elements, and None where a block ends
    todo: list[str | Node | None] = []
    for node in reversed(articles or [root]):
        todo += [None, *reversed(node.children), None]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(x)
        elif x.name in BLOCKS:
            close()
            if not _dropped(x, inside) and found.get(id(x)) not in template:
                todo += [None, *reversed(x.children)]
        elif not _dropped(x, inside):
            todo += reversed(x.children)
    close()
    return " ".join(blocks)


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host, hash of the page's text, and the distinct hashes of the page's blocks; keeps the columns before ``html``."""
    for batch in slices(batches):
        hosts, whole, parts = [], [], []
        for url, page in zip(_column(batch, "url"), _column(batch, "html"), strict=True):
            root = parse(page or "")
            w, p = hashes(root, _articles(root))
            hosts.append(host_of(url))
            whole.append(w)
            parts.append(sorted(set(p.values())))
        kept = batch.drop_columns(["html"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(hosts, pa.string()), pa.array(whole, pa.int64()), pa.array(parts, pa.list_(pa.int64()))], names=[*kept.schema.names, "host", "page", "parts"])


def template(pages: DataFrame, *, least_pages: int = 5, least_share: float = 0.05, inside_share: float = 0.2) -> DataFrame:
    """(host, part): for each host the blocks that recur on many of its distinct pages.

    Many are ``least_pages`` at least, and ``least_share`` of the host's pages; inside articles ``inside_share`` of them.
    Pages with the same main text count once, so that a page copied often is no template.
    """
    seen = pages.select("url", "html").mapInArrow(_parts, "url string, host string, page long, parts array<long>")
    # copies of a page meet by its hash; any one of them stands for all
    distinct = written(seen.groupBy("host", "page").agg(F.first("parts").alias("parts")), "subtrees")
    count = written(distinct.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages), "hosts")
    often = distinct.select("host", F.explode("parts").alias("part")).groupBy("host", "part").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    often = often.join(F.broadcast(count) if count.count() <= BROADCAST_HOSTS else count, "host")
    inside = F.col("part").bitwiseAND(F.lit(1)) == 1
    enough = F.when(inside, F.col("pages") * F.lit(inside_share)).otherwise(F.col("pages") * F.lit(least_share))
    return often.where(F.col("n") >= enough).select("host", "part")


def _host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _by_page(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(page_id, url, html, host, hashes): the template's blocks that each page has, whatever their number on its host."""
    key = F.xxhash64("url", "html")
    own = rows.select(key.alias("key"), "page_id", "url", "html").mapInArrow(_parts, "key long, page_id long, url string, host string, page long, parts array<long>")
    own = written(own.select("key", "page_id", "host", F.explode("parts").alias("part")).distinct(), "page-parts").join(known, ["host", "part"])
    lists = own.groupBy(F.col("key").alias("k"), F.col("page_id").alias("p")).agg(F.collect_list("part").alias("hashes"))
    keyed = rows.withColumn("host", F.lit(None).cast("string")).withColumn("key", key)
    return keyed.join(lists, (keyed["key"] == lists["k"]) & keyed["page_id"].eqNullSafe(lists["p"]), "left").select("page_id", "url", "html", "host", "hashes")


def extract(pages: DataFrame, **options) -> DataFrame:
    """page_id, url, text and n_chars of every page. Input: page_id, url, html and any other columns, which are not carried.

    A null or empty page has the empty text; pages with a null url share one nameless host; repeated rows each give a
    row; an empty table gives none. Tags that a truncated page leaves open end with it; nesting may be of any depth. A
    header element is the site's and goes, but inside an article it is the article's own head and stays.
    """
    known = written(template(pages, **options), "template")
    rows = pages.select("page_id", "url", "html").withColumn("host", _host("url"))
    if known.count() > BROADCAST_HASHES:
        joined = _by_page(rows, known)
    else:
        sizes = known.groupBy("host").agg(F.count("*").alias("n"))
        wide = written(sizes.where(F.col("n") > HOST_HASHES).select("host"), "wide")  # at most one in HOST_HASHES of the rows of known
        narrow = known.join(F.broadcast(wide), "host", "left_anti")
        lists = narrow.groupBy("host").agg(F.sort_array(F.collect_list("part")).alias("hashes"))
        joined = rows.join(F.broadcast(lists), "host", "left").select("page_id", "url", "html", "host", "hashes")
        if not wide.isEmpty():
            joined = joined.join(F.broadcast(wide), "host", "left_anti").select("page_id", "url", "html", "host", "hashes")
            joined = joined.unionByName(_by_page(rows.join(F.broadcast(wide), "host", "left_semi"), known.join(F.broadcast(wide), "host", "left_semi")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, frozenset[int]] = {}  # of the hosts met last
        for batch in slices(batches):
            texts = []
            names = _column(batch, "host")
            lists = batch.column(batch.schema.get_field_index("hashes"))
            for i, page in enumerate(_column(batch, "html")):
                own = sets.get(names[i]) if names[i] is not None else None
                if own is None:
                    own = frozenset(lists[i].as_py() or ())
                    if names[i] is not None:
                        if len(sets) > 1000:
                            sets.clear()
                        sets[names[i]] = own
                texts.append(main_text(page or "", own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("page_id")), batch.column(batch.schema.get_field_index("url")), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_extract(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
