"""Main text of web pages with a site style tree.

Pages are parsed into blocks, each with the path of its element styles (tag and class). Pages of a
host are merged into one style tree, held as rows (host, path): how many distinct pages have the
node, the entropy of its child layouts over those pages (presentation importance), and the mean
entropy of the texts below it (content importance: a text on every page tells nothing). A branch
whose composite importance is low on enough pages is removed from every page of the host.

Every page of a host is in its tree. What a page says about itself is a prior: blocks inside
``article`` or ``main`` need a lower importance to go (``prior``), and where they hold most of a page's
text the rest of the page goes; menus, headers, footers, sidebars, notices, adverts, forms and reader
comments by tag, role or class go on hosts of any size, as their texts may differ from page to page and
no count over pages tells them then. A form that holds an ``article``, ``main`` or ``h1`` is the page, not a
form. Pages of a host with the same article count once, so copies do not turn it into something repeated.
If pruning would leave nothing of a page, the page keeps its blocks.

Skew: a host may hold a third of all pages. The tree is built by counts with partial aggregation and
never gathered by host; decisions return to the blocks by a join of which Spark splits the skewed side.

Edge cases: null or empty html gives an empty text; a null or odd url counts as its own host name.
Unclosed, stray and cut-off tags are borne as browsers bear them. Rows that repeat are extracted
alike. A style stands at most twice on a path, so pages that never close an element have short paths. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import Rows, Scratch, rows_of

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>|<[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
RAW = frozenset("script style textarea title noscript iframe template noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "html head body article aside main nav header footer section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption form fieldset legend address details summary dialog menu center hgroup search select option optgroup button svg object video audio canvas".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "option", "optgroup", "select", "button", "svg", "object", "video", "audio", "canvas"}
#: An opening tag closes an open one of these, up to the nearest container.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NOISE_TAGS = frozenset("nav footer aside form head button select svg dialog menu search object video audio canvas fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer sidebar aside rail ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus "
    "reply replies respond widget pagination pager skip toolbar copyright".split()
)
MAIN_WORDS = frozenset("article content main post entry story".split())
CLASS_WORD = re.compile(r"[a-z]+")
#: Class names that say how a page is laid out, not what an element is.
LAYOUT_NAMES = ("no-", "has-", "with-", "without-")


@dataclass(frozen=True)
class StyleTreeParams:
    least_importance: float = 0.25  # branches below this go
    least_pages: int = 4  # distinct pages of a host that must have the branch
    damping: float = 0.9  # weight of what stands below a node with few layouts
    prior: float = 0.2  # weight of the marks in a node's importance
    most: float = 0.5  # share of a page's text from which on its article or main is the page


@dataclass
class Element:
    tag: str
    path: str
    noise: bool
    form: bool  # noise only as it stands in a form
    main: bool
    children: list[str]


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(text)}


def is_noise(tag: str, given: dict[str, str], inside_main: bool) -> bool:
    if tag in NOISE_TAGS or tag == "header" and not inside_main:
        return True
    if "hidden" in given or given.get("aria-hidden") == "true" or given.get("role", "").lower() in NOISE_ROLES:
        return True
    if re.search(r"display\s*:\s*none", given.get("style", ""), re.I):
        return True
    names = f"{given.get('class', '')} {given.get('id', '')}".lower().split()
    words = {w for name in names if not name.startswith(LAYOUT_NAMES) for w in CLASS_WORD.findall(name)} - ({"header"} if inside_main else set())
    return tag not in ("html", "body") and bool(words & NOISE_WORDS) and not (tag in ("article", "main") and words & MAIN_WORDS)


def parse_page(text: str, params: StyleTreeParams) -> tuple[list[tuple[str, str, bool]], list[tuple[str, int]]]:
    """(blocks as (style path, text, inside article or main), layouts as (style path, signature)).

    Blocks that are noise by their own marks are left out of both.
    """
    blocks: list[tuple[str, str, bool]] = []
    layouts: list[tuple[str, int]] = []
    stack = [Element("", "", False, False, False, [])]
    parts: list[str] = []

    def end_block() -> None:
        if parts:
            top = stack[-1]
            if not top.noise and (words := " ".join("".join(parts).split())):
                blocks.append((top.path, words, top.main))
            parts.clear()

    def pop() -> None:
        gone = stack.pop()
        if not gone.noise:
            layout = ">".join(c for i, c in enumerate(gone.children) if i == 0 or gone.children[i - 1] != c)
            layouts.append((gone.path, zlib.crc32(layout.encode())))

    at, n = 0, len(text)
    while at < n:
        token = TOKEN.match(text, at)
        at = token.end()
        tag = token[2]
        if tag is None:
            piece = token[0]
            if piece[0] != "<" or piece == "<":
                if not stack[-1].noise:
                    parts.append(html.unescape(piece) if "&" in piece else piece)
            continue
        tag = tag.lower()
        if token[1]:
            if tag in BLOCK and any(e.tag == tag for e in stack):
                end_block()
                while stack[-1].tag != tag:
                    pop()
                pop()
            elif tag == "p":
                end_block()
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(text, at)
            at = close.end() if close else n
            continue
        if tag == "br":
            parts.append(" ")
        if tag == "hr":
            end_block()
        if tag not in BLOCK or tag in VOID:
            continue
        end_block()
        if tag in CLOSES_P and stack[-1].tag == "p":
            pop()
        if tag in SIBLINGS:
            closes, until = SIBLINGS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in until:
                    break
                if stack[k].tag in closes:
                    while len(stack) > k:
                        pop()
        given = attributes(token[3]) if token[3].strip() else {}
        top = stack[-1]
        style = tag + "".join(f".{c}" for c in sorted(set(CLASS_WORD.findall(given.get("class", "").lower()))))
        top.children.append(style)
        path = f"{top.path}/{style}" if top.path.split("/").count(style) < 2 else top.path
        if top.form and tag in ("article", "main", "h1"):
            for e in stack:
                e.noise = e.noise and not e.form
                e.form = False
        own = is_noise(tag, given, top.main)
        form = top.form or tag == "form"
        if own and (tag != "form" or is_noise("div", given, top.main)):
            form = False
        noise = top.noise or own
        form = form and not (top.noise and not top.form)
        main = top.main or tag in ("article", "main") or given.get("role", "").lower() == "main"
        if not token[3].rstrip().endswith("/"):
            stack.append(Element(tag, path, noise, form, main, []))
    end_block()
    while len(stack) > 1:
        pop()
    return blocks, layouts


PARSED = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("host", pa.string()),
        ("content_hash", pa.int64()),
        ("blocks", pa.list_(pa.struct([("path", pa.string()), ("text_hash", pa.int64()), ("main", pa.bool_())]))),
        ("texts", pa.list_(pa.string())),
        ("nodes", pa.list_(pa.string())),
        ("shown", pa.list_(pa.struct([("node", pa.string()), ("signature", pa.int64())]))),
    ]
)
PARSED_DDL = (
    "page_id long, url string, host string, content_hash long, blocks array<struct<path:string,text_hash:long,main:boolean>>, "
    "texts array<string>, nodes array<string>, shown array<struct<node:string,signature:long>>"
)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def host_of(url: str | None) -> str:
    found = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", url or "")
    return (found[1] if found else url or "").lower()


def text_hash(text: str) -> int:
    return signed(xxhash.xxh3_64_intdigest(text))


def above(path: str) -> Iterator[str]:
    """A style path and those of all elements above it."""
    at = len(path)
    while at > 0:
        yield path[:at]
        at = path.rfind("/", 0, at)


def own_blocks(blocks: list[tuple[str, str, bool]], params: StyleTreeParams) -> list[tuple[str, str, bool]]:
    """The blocks of ``article`` and ``main`` where they hold most of the page's text, else all."""
    inside = [b for b in blocks if b[2]]
    return inside if sum(len(b[1]) for b in inside) >= params.most * sum(len(b[1]) for b in blocks) else blocks


def parsed(pages: DataFrame, params: StyleTreeParams) -> DataFrame:
    """Pages with their blocks, and what each tells the tree of its host: texts and child layouts of its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Rows(PARSED)
        for page_id, url, text in rows_of(batches, "page_id", "url", "html", at_once=100):
            blocks, layouts = parse_page(text or "", params)
            blocks = own_blocks(blocks, params)
            nodes = {node for path in {b[0] for b in blocks} for node in above(path)}
            shown = [{"node": node, "signature": s} for node, s in sorted(set(layouts)) if node in nodes]
            texts = [t for _, t, _ in blocks]
            rows = [{"path": p, "text_hash": text_hash(t), "main": main} for p, t, main in blocks]
            row = page_id, url, host_of(url), text_hash("\n\n".join(texts)), rows, texts, sorted(nodes), shown
            if full := gathered.add(row, 2 * len(text or "") + sum(map(len, nodes)) + 200):
                yield full
        if last := gathered.flush():
            yield last

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, PARSED_DDL)


def entropy(count: str, n: str):
    """Terms of -sum p log_n p for a value found on ``count`` of ``n`` pages; 0 where n is 1."""
    share = F.col(count) / F.col(n)
    return F.when(F.col(n) > 1, -share * F.log(share) / F.log(F.col(n).cast("double"))).otherwise(0.0)


def contents(pages: DataFrame) -> DataFrame:
    """Blocks, nodes and layouts of one page of each content of a host."""
    told = F.min_by(F.struct("blocks", "nodes", "shown"), "row_id").alias("told")
    return pages.groupBy("host", "content_hash").agg(told).select("host", "told.*")


def prefixes(path):
    """A style path and those of all elements above it."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))


def style_tree(pages: DataFrame, params: StyleTreeParams) -> DataFrame:
    """(host, node, n_pages, importance) of every style path of every host, from ``contents``.

    Presentation: entropy of the node's child layouts over its pages, 1 where only one page has it.
    Content: 1 - mean over the texts below it of log(pages with the text there) / log(pages of the node).
    Inside ``article`` or ``main`` the mixture is raised by the prior.
    """
    nodes = pages.select("host", F.explode("nodes").alias("node")).groupBy("host", "node").agg(F.count("*").alias("n_pages"))
    texts = pages.select("host", F.explode(F.array_distinct("blocks")).alias("b")).select("host", "b.*").groupBy("host", "path", "text_hash").agg(F.count("*").alias("n_found"), F.bool_and("main").alias("main"))
    # sums of each path first: they are few, whatever the pages, and go up the tree
    paths = texts.groupBy("host", "path").agg(F.sum(F.log("n_found")).alias("known"), F.count("*").alias("n_texts"), F.bool_and("main").alias("main"))
    below = paths.withColumn("node", F.explode(prefixes(F.col("path")))).groupBy("host", "node").agg(F.sum("known").alias("known"), F.sum("n_texts").alias("n_texts"), F.bool_and("main").alias("main"))
    told = F.when(F.col("n_pages") > 1, F.col("known") / F.col("n_texts") / F.log(F.col("n_pages").cast("double"))).otherwise(0.0)
    content = below.join(nodes, ["host", "node"]).select("host", "node", "n_pages", "main", (1 - told).alias("content"))
    styles = pages.select("host", F.explode("shown").alias("l")).select("host", "l.*").groupBy("host", "node", "signature").agg(F.count("*").alias("n_style"))
    totals = styles.groupBy("host", "node").agg(F.sum("n_style").alias("n_all"))
    presentation = styles.join(totals, ["host", "node"]).groupBy("host", "node", "n_all").agg(F.sum(entropy("n_style", "n_all")).alias("entropy"), F.count("*").alias("n_styles"))
    presentation = presentation.select("host", "node", F.when(F.col("n_all") > 1, F.col("entropy")).otherwise(1.0).alias("presentation"), "n_styles")
    weight = F.pow(F.lit(params.damping), F.coalesce("n_styles", F.lit(1)).cast("double"))
    mixed = (1 - weight) * F.coalesce("presentation", F.lit(0.0)) + weight * F.col("content")
    raised = F.when(F.col("main"), (1 - params.prior) * mixed + params.prior).otherwise(mixed)
    return content.join(presentation, ["host", "node"], "left").select("host", "node", "n_pages", raised.alias("importance"))


def numbered(pages: DataFrame, params: StyleTreeParams) -> DataFrame:
    return parsed(pages, params).withColumn("row_id", F.monotonically_increasing_id())


def main_text(spark: SparkSession, pages: DataFrame, params: StyleTreeParams = StyleTreeParams()) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    scratch = Scratch(spark, "pages")
    read = scratch.keep(numbered(pages, params), "parsed")
    distinct = scratch.keep(contents(read), "contents")
    low = style_tree(distinct, params).where((F.col("importance") < params.least_importance) & (F.col("n_pages") >= params.least_pages)).select("host", "node")
    low = scratch.keep(low, "low")
    scratch.drop(distinct)
    scratch.free_shuffles()
    placed = scratch.again(read).select("row_id", "host", F.explode("nodes").alias("node"))
    pruned = scratch.keep(placed.join(low, ["host", "node"]).groupBy("row_id").agg(F.collect_set("node").alias("pruned")), "pruned")
    scratch.free_shuffles()
    goes = lambda path: F.exists("pruned", lambda node: F.startswith(F.concat(path, F.lit("/")), F.concat(node, F.lit("/"))))
    kept = F.filter("texts", lambda _, i: ~goes(F.col("blocks")[i]["path"]))
    kept = F.when(F.col("pruned").isNull() | (F.size(kept) == 0), F.col("texts")).otherwise(kept)
    read = read.select("row_id", "page_id", "url", "blocks", "texts")
    return read.join(pruned, "row_id", "left").select("page_id", "url", F.array_join(kept, "\n\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
