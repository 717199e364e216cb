"""Main text of web pages, with site templates removed.

Two passes. The first hashes a page's element subtrees (tags, classes and text), in its main content and outside,
counts in Spark on how many pages of its host each subtree occurs, and keeps those that recur. The second drops these
subtrees, the chrome elements and everything marked as such, and joins the blocks that remain. In the main content only
elements that group others can be templates: a heading or paragraph that several articles of a host share is their text.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, salted_join, slices, staged

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
GROUPS = frozenset("div section ul ol dl table figure fieldset details center".split())
CHROME = frozenset("nav header footer aside form script style noscript iframe head title template svg button select textarea menu dialog object embed canvas input label audio video".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
CHROME_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|"
    r"sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|topbar|masthead|header|footer|"
    r"comments?|commentlist|respond|disqus|replies|related|recommended|share|sharing|social|widget|login|signup|skip-link)(?:$|[\s_-])",
    re.I,
)
COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|comment-?body|replies|reply|respond|disqus|trackback|pingback)(?:$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"\s+")
HOST = re.compile(r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


@dataclass(slots=True)
class Node:
    tag: str
    attrs: str
    kids: list
    skip: bool = False


def parse(html: str) -> Node:
    """A tolerant tree: elements left open end with their parent; stray end tags are ignored."""
    root = Node("", "", [])
    stack, pos, size = [root], 0, len(html)
    while pos < size:
        m = TOKEN.search(html, pos)
        if not m:
            stack[-1].kids.append(html[pos:])
            break
        if m.start() > pos:
            stack[-1].kids.append(html[pos : m.start()])
        pos = max(m.end(), m.start() + 1)
        tag = m[2]
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            like = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in like:
                    del stack[k:]
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "tbody", "thead", "select"):
                    break
        node = Node(tag, m[3], [])
        stack[-1].kids.append(node)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, pos)
            node.kids.append(html[pos : end.start() if end else size])
            pos = end.end() if end else size
            continue
        stack.append(node)
    return root


def is_chrome(node: Node) -> bool:
    if node.tag in CHROME:
        return True
    if not node.attrs or "=" not in node.attrs and "hidden" not in node.attrs:
        return False
    got = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(node.attrs)}
    if "hidden" in got or got.get("aria-hidden") == "true" or got.get("role", "").lower() in CHROME_ROLES:
        return True
    if "display:none" in got.get("style", "").replace(" ", "").lower():
        return True
    if node.tag in ("html", "body", "main"):
        return False
    names = COMMENT_NAMES if node.tag == "article" else CHROME_NAMES
    return any(names.search(got.get(k, "")) for k in ("class", "id"))


def find(node: Node, tag: str) -> list[Node]:
    """The outermost elements of the name, outside chrome."""
    out: list[Node] = []
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str) or is_chrome(x):
            continue
        if x.tag == tag:
            out.append(x)
        else:
            stack.extend(reversed(x.kids))
    return out


def main_parts(root: Node) -> list[Node]:
    return find(root, "article") or find(root, "main") or [root]


def subtree_hashes(root: Node) -> tuple[list[tuple[int, Node]], int]:
    """(hash, element) of the element subtrees with text that can be a template; and the hash of the main content.

    The roots of the main content and what holds them are none, nor are inline elements with other text beside them, nor,
    in the main content, elements that group no others.
    """
    parts = main_parts(root)
    heads = {id(x) for x in parts if x is not root}
    out: list[tuple[int, Node]] = []
    order, stack, inside = [], [root], set(heads)
    while stack:
        x = stack.pop()
        order.append(x)
        kids = [k for k in x.kids if not isinstance(k, str)]
        stack.extend(kids)
        if id(x) in inside:
            inside.update(map(id, kids))
    seen: dict[int, tuple[bytes, bool, bool]] = {}  # digest, has text, is or holds a root of the main content
    for x in reversed(order):
        h = hashlib.blake2b(f"{x.tag} {SPACE.sub(' ', x.attrs)}".encode("utf-8", "replace"), digest_size=8)
        text, holds, runs, own = False, id(x) in heads, 0, []
        for k in x.kids:
            if isinstance(k, str):
                k = SPACE.sub(" ", k).strip()
                text |= bool(k)
                runs += bool(k)
                h.update(k.encode("utf-8", "replace"))
                continue
            digest, says, above = seen[id(k)]
            h.update(digest)
            text |= says
            holds |= above
            runs += says and k.tag in INLINE
            if says and not above and k.tag not in CHROME and k.tag not in ("html", "body") and (k.tag in GROUPS or id(k) not in inside):
                own.append((digest, k))
        seen[id(x)] = h.digest(), text, holds
        out += [(int.from_bytes(d, "little", signed=True), k) for d, k in own if runs < 2 or k.tag not in INLINE]
    main = hashlib.blake2b(b"".join(seen[id(x)][0] for x in parts), digest_size=8).digest()
    return out, int.from_bytes(main, "little", signed=True)


def main_text(html: str | None, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's blocks, one a line. Entities are decoded, white space in a block is one space, empty blocks go."""
    root = parse(html or "")
    if templates:
        for h, x in subtree_hashes(root)[0]:
            x.skip = h in templates
    blocks: list[str] = []
    held: list[str] = []

    def end() -> None:
        if held:
            text = SPACE.sub(" ", unescape("".join(held))).strip()
            held.clear()
            if text:
                blocks.append(text)

    for part in main_parts(root):
        stack: list = [part]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                held.append(x)
            elif x.skip or is_chrome(x):
                if x.tag not in INLINE:
                    end()
            elif x.tag in INLINE:
                stack.extend(reversed(x.kids))
            else:
                end()
                stack.append(None)
                stack.extend(reversed(x.kids))
        end()
    return "\n".join(blocks)


def with_host(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, html, host and page, a hash of host and html."""
    rows = pages.selectExpr(f"`{id_col}` AS id", f"`{url_col}` AS url", f"`{html_col}` AS html")
    rows = rows.withColumn("host", F.xxhash64(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST.pattern, 1))))
    return rows.withColumn("page", F.xxhash64("host", "html"))


def templates_by_page(rows: DataFrame, least_pages: int = 4, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """page, templates: hashes of the page's subtrees that recur on its host. rows: as of with_host.

    A subtree recurs if it is on least_pages pages, whatever the size of the host; on a host of fewer pages, but two at
    least, if it is on all of them. Pages count once for a url and once for the same main content, so that copies of a page
    are no evidence. An array holds a page's own templates only: its size does not grow with the host.
    """

    def run(batches):
        for b in slices(batches, "html"):
            hosts, pages, urls, mains, found = [], [], [], [], []
            for host, page, url, html in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                own, main = subtree_hashes(parse(html or ""))
                own = [None, *{h for h, _ in own}]
                hosts += [host] * len(own)
                pages += [page] * len(own)
                urls += [main if url is None else url] * len(own)
                mains += [main] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hosts, pages, urls, mains, found)], ["host", "page", "url", "main", "subtree"])

    told = rows.select("host", "page", F.expr("if(url IS NULL, NULL, xxhash64(url))").alias("url"), "html")
    found = staged(told.mapInArrow(run, "host long, page long, url long, main long, subtree long"), "subtrees")
    counts = found.groupBy("host", "subtree", "url").agg(F.min("main").alias("main")).groupBy("host", "subtree").agg(F.countDistinct("main").alias("n"))
    counts = staged(counts.filter((F.col("n") > 1) | F.col("subtree").isNull()), "subtree-counts")
    n_pages = counts.filter(F.col("subtree").isNull()).select("host", F.col("n").alias("n_pages"))
    often = counts.filter(F.col("subtree").isNotNull()).join(n_pages, "host").filter(F.col("n") >= F.least(F.lit(least_pages), "n_pages"))
    often = staged(often.select("host", "subtree", "n"), "templates")
    if 16 * often.count() < broadcast_bytes:
        hits = found.join(F.broadcast(often), ["host", "subtree"])
    else:  # a block of a large host is on all its pages
        hits = salted_join(found, often, ["host", "subtree"], "n", F.col("page"))
    return hits.groupBy("page").agg(F.collect_set("subtree").alias("templates"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 16 << 20) -> DataFrame:
    """Per page: id, url, text, n_chars (code points).

    Null or empty html, and pages that hold nothing but chrome, give ''. Null urls share the host ''. Repeated rows give
    repeated results. Pages join their templates by broadcast only if those measure under broadcast_bytes.
    """
    kind = dict(pages.dtypes)[id_col]
    rows = with_host(pages, id_col, url_col, html_col)
    templates = staged(templates_by_page(rows, broadcast_bytes=broadcast_bytes), "page-templates")
    size = templates.agg(F.sum(24 + 8 * F.size("templates"))).first()[0] or 0
    if size == 0:
        joined = rows.withColumn("templates", F.lit(None).cast("array<bigint>"))
    else:
        joined = rows.join(F.broadcast(templates) if size < broadcast_bytes else templates, "page", "left")

    def run(batches):
        for b in slices(batches, "html"):
            texts = [main_text(h, frozenset(t or ())) for h, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    return joined.select("id", "url", "html", "templates").mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
