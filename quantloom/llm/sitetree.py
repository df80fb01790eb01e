"""Main text of HTML pages by a style tree per site.

The DOMs of a host's pages are merged: element nodes meet at the path of their
presentation (tags with class and id from the root; below DEPTH levels, from
the ancestor of that depth). A node's presentation
importance is the entropy of the child sequences it shows over the pages, the
content importance of a text falls with the number of pages that repeat it. A
branch's composite importance mixes its root's presentation with the content
below it, the more styles the root shows the less of the latter. Spark counts
and passes both up the merged tree; from each page go the branches that are of
low importance with all that is below them. Elements and names by which HTML
itself marks what is no article are left out besides, and where a page has one
<article> or <main>, only this is read."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .storage import staged

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea title xmp noembed noframes".split())
NEVER = RAW | frozenset("head nav footer aside form button select dialog menu audio video canvas".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "legend"}
# Words in class, id or role that name what is not the article.
BOILER = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription sidebar side aside widget related recommended recommendations share sharing social menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer foot header masthead topbar toolbar comment comments respond replies reply disqus login signup search form skip copyright".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_NAMING = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
#: marks the text that a node shows itself
OWN = ">#text"
#: share that the content below keeps in a branch's importance for each style its root shows
GAMMA = 0.9
#: nodes further down meet under their ancestor of this depth
DEPTH = 40


class Node:
    """An element of the page: its path, whether it is excluded by kind, and its content in page order: text or nodes."""

    __slots__ = ("tag", "path", "out", "items")

    def __init__(self, tag: str, path: str, out: bool):
        self.tag, self.path, self.out = tag, path, out
        self.items: list[str | Node] = []


def _styled(tag: str, attributes: str) -> tuple[str, bool]:
    """Presentation of a start tag, and whether its naming says that it is no content."""
    if not attributes or attributes.isspace():
        return tag, False
    names, role, hidden = [], "", False
    for key, *values in _NAMING.findall(attributes):
        value = "".join(values).lower()
        key = key.lower()
        if key in ("hidden", "aria-hidden"):
            hidden |= key == "hidden" and value != "until-found" or value == "true"
        elif key == "role":
            role = value
        else:
            names += value.split()
    named = {p for n in names for p in _PART.findall(n)}
    out = hidden or role in _ROLES or bool(named & BOILER)
    return tag + "".join(f".{_DIGITS.sub('#', n.replace('>', '-'))}" for n in names), out


def parse(page: str) -> Node:
    """A forgiving parser: unclosed and stray tags never lose text."""
    root = Node("", "", False)
    stack = [root]
    at, n = 0, len(page)

    def text(a: int, b: int) -> None:
        if a < b:
            stack[-1].items.append(entities.unescape(page[a:b]) if "&" in page[a:b] else page[a:b])

    def close(tag: str, within: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                del stack[i:]
                return
            if stack[i].tag in within:
                return

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            if tag == "p" and not any(x.tag == "p" for x in stack):
                continue
            close(tag, frozenset() if tag in BLOCK else BLOCK)
            continue
        if tag in ENDS_P:
            close("p", frozenset(("table", "td", "th", "button", "object")))
        if tag == "li":
            close("li", frozenset(("ul", "ol", "menu")))
        elif tag in ("dt", "dd"):
            close("dt", frozenset(("dl",)))
            close("dd", frozenset(("dl",)))
        elif tag in ("tr", "td", "th"):
            for x in ("td", "th") if tag != "tr" else ("tr",):
                close(x, frozenset(("table",)))
        elif tag == "body":
            close("head", frozenset())
        elif tag == "option":
            close("option", frozenset(("select",)))
        style, out = _styled(tag, m[3])
        header = tag == "header" and not any(x.tag in ("article", "main") for x in stack)
        protected = tag in ("html", "body", "article", "main")
        node = Node(tag, f"{stack[min(len(stack) - 1, DEPTH)].path}>{style}", tag in NEVER or header or out and not protected)
        stack[-1].items.append(node)
        if tag in RAW and not m[0].endswith("/>"):
            end = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.I).search(page, at)
            at = end.end()
        elif tag not in VOID and not m[0].endswith("/>"):
            stack.append(node)
    return root


def _walk(node: Node) -> Iterator[Node]:
    stack = [x for x in reversed(node.items) if isinstance(x, Node)]
    while stack:
        x = stack.pop()
        yield x
        stack += (y for y in reversed(x.items) if isinstance(y, Node))


def blocks(node: Node, removed: frozenset[str]) -> list[str]:
    """Texts of the blocks in page order; white space is one space, empty blocks are left out.

    `removed` names branches by their path, and by their path and OWN the nodes that lose the text they show themselves."""
    out: list[list[str]] = [[]]
    stack: list[str | Node | None] = [node]
    silent: list[bool] = []
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):  # the end of a node
            silent.pop()
            if x[0]:
                out.append([])
        elif isinstance(x, str):
            out[-1].append(" " if silent[-1] else x)
        elif x.tag == "br":
            out[-1].append(" ")
        else:
            block = x.tag in BLOCK
            if block:
                out.append([])
            if x is not node and (x.out or x.path in removed):
                if block:
                    out.append([])
                continue
            silent.append(x.path + OWN in removed)
            stack.append((block,))
            stack += reversed(x.items)
    return [t for t in (" ".join("".join(x).split()) for x in out) if t]


def article_of(root: Node, removed: frozenset[str]) -> Node:
    """The one <article> or <main> of the page if there is exactly one outermost, else the page."""
    for tag in ("article", "main"):
        found, queue = [], [root]
        while queue:
            x = queue.pop()
            for y in x.items:
                if isinstance(y, Node) and not y.out and y.path not in removed:
                    (found if y.tag == tag else queue).append(y)
        if len(found) == 1:
            return found[0]
    return root


def host_of(url: str) -> Column:
    """Host of an absolute URL, lower-case, without user, port and a leading www.; else the empty text."""
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page and node path: the hashes of the child sequences (kind 0) and of the texts (kind 1) it shows, each once, with the hash of the page."""
    import xxhash

    for batch in textkit.parts(batches, 1):
        hosts, pages, paths, kinds, features = [], [], [], [], []
        for host, page in zip(batch.column(0).to_pylist(), textkit.texts(batch.column(1)), strict=True):
            seen, digest = set(), xxhash.xxh3_64_intdigest(page) >> 1
            for node in _walk(parse(page.decode("utf-8", "replace"))):
                style = ",".join(dict.fromkeys(x.tag for x in node.items if isinstance(x, Node)))
                seen.add((node.path, 0, xxhash.xxh3_64_intdigest(style) >> 1))
                own = "".join(x if isinstance(x, str) else " " for x in node.items).strip()
                if own:
                    seen.add((node.path, 1, xxhash.xxh3_64_intdigest(own) >> 1))
            for path, kind, feature in seen:
                hosts.append(host), pages.append(digest), paths.append(path), kinds.append(kind), features.append(feature)
        yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(paths, pa.string()), pa.array(kinds, pa.int8()), pa.array(features, pa.int64())], names=["host", "page", "path", "kind", "feature"])


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, `shown`, `presentation`, `content`, `composite` of every node of every site's merged tree.

    `shown` counts a node's features over the site's distinct pages. With m of
    them, a child sequence of k pages adds -(k/m) log_m(k/m) to the presentation
    importance; a text repeated on k pages has entropy log_m k, and content
    importance is 1 minus the mean over the texts that the node shows itself;
    with m = 1 both are 1. Composite importance is (1 - GAMMA^l) x presentation +
    GAMMA^l x the mean content importance of all texts in the branch, where l is
    the number of child sequences; without any text it is the presentation
    importance. A path is passed up to its ancestors as rows of the merged tree,
    whose number does not grow with copies of a template."""
    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col)).mapInArrow(_features, "host string, page long, path string, kind byte, feature long").distinct()  # copies of a page are one page
    counts = rows.groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("k"))
    k = F.col("k").cast("double")
    text, style = F.col("kind") == 1, F.col("kind") == 0
    sums = counts.groupBy("host", "path").agg(
        F.sum(F.when(text, k)).alias("texts"), F.sum(F.when(text, k * F.log(k))).alias("text_logs"), F.count_if(style).alias("styles"),
        F.sum(F.when(style, k)).alias("shown"), F.sum(F.when(style, k * F.log(k))).alias("style_logs"),
    )
    m, t = F.col("shown"), F.col("texts")
    # mean over shown texts of log_m(k); sum over child sequences of -(k/m) log_m(k/m)
    content = F.when(t.isNotNull(), F.when(m > 1, 1 - F.least(F.lit(1.0), F.try_divide(F.col("text_logs"), t * F.log(m)))).otherwise(F.lit(1.0)))
    presentation = F.when(m > 1, 1 - F.col("style_logs") / (m * F.log(m))).otherwise(F.lit(1.0))
    nodes = staged(sums.select("host", "path", m, "styles", t, presentation.alias("presentation"), content.alias("content")), "nodes")
    below = nodes.where("texts is not null").select("host", F.explode(_upward("path")).alias("path"), "texts", "content")
    below = below.groupBy("host", "path").agg((F.sum(F.col("texts") * F.col("content")) / F.sum("texts")).alias("inside"))
    fade = F.pow(F.lit(GAMMA), F.col("styles"))
    composite = F.when(F.col("inside").isNull(), F.col("presentation")).otherwise((1 - fade) * F.col("presentation") + fade * F.col("inside"))
    return nodes.join(below, ["host", "path"], "left").select("host", "path", "shown", "presentation", "content", "inside", composite.alias("composite"))


def _upward(path: str) -> Column:
    """The path and those of all its ancestors."""
    parts = F.split(path, ">")
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ">"))


def low_branches(tree: DataFrame, threshold: float) -> DataFrame:
    """host, low: the branches whose nodes are all of low importance, and the texts of low importance that stand elsewhere.

    Low is less than `threshold` x (1 - 1/m), where m is the number of times the
    node is shown: the fewer pages, the surer a repetition must be."""
    least = threshold * (1 - 1 / F.col("shown"))
    flagged = staged(tree.select("host", "path", F.col("inside").isNotNull().alias("speaks"), (F.col("composite") < least).alias("low"), (F.col("content") < least).alias("mute")), "flagged")
    needed = flagged.where("speaks").select("host", F.explode(_upward("path")).alias("path"), F.expr("not low or coalesce(not mute, false)").alias("needed"))
    needed = needed.groupBy("host", "path").agg(F.bool_or("needed").alias("needed"))
    rows = flagged.where("speaks").join(needed, ["host", "path"])
    gone = F.when(~F.col("needed"), F.col("path")).when(F.col("mute"), F.concat("path", F.lit(OWN)))
    return rows.select("host", gone.alias("gone")).where("gone is not null").groupBy("host").agg(F.sort_array(F.collect_set("gone")).alias("low"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none: frozenset[str] = frozenset()
    for batch in textkit.parts(batches, 2):
        out = []
        for low, page in zip(batch.column("low").to_pylist(), textkit.texts(batch.column("html")), strict=True):
            root, gone = parse(page.decode("utf-8", "replace")), frozenset(low or ())
            text = blocks(article_of(root, gone), gone)
            out.append("\n".join(text or blocks(article_of(root, none), none) if gone else text))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, threshold: float = 0.1) -> DataFrame:
    """page_id, url, main text and its length of every row of `pages` (page_id, url, html).

    The branches of low importance in the site's style tree are removed
    (`low_branches`); one page alone tells nothing. If nothing would be left of
    a page, all its branches stay. Null or empty html: empty text. Null urls are
    one site of their own. Repeated page ids are extracted row by row; other
    columns are not read; an empty table gives an empty result. Whole pages are
    read, of any size and depth, and nothing is cut. A site's low branches are
    one row; Spark broadcasts these rows only below its own size threshold and
    else joins by host, where AQE splits a hot host."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    low = staged(low_branches(style_tree(src), threshold), "low-branches")
    keyed = src.withColumn("host", host_of("url"))
    return keyed.join(low, "host", "left").select("page_id", "url", "html", "low").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
