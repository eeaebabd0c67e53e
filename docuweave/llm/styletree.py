"""HTML extraction by site style trees.

Pages of a host are merged into one tree whose nodes are the paths of element labels from the
root.  Each node knows in how many of the host's pages it occurs, with which presentations (the
sequence of its children's labels) and with which contents (hashes of the blocks of text in
it).  A node whose presentations are many, and whose contents seldom repeat, matters; a node
that looks and reads alike on all pages, by the entropy of both, does not.  A block's importance
is that of its least important branch, the block's own text among them, drawn to ``NEUTRAL`` where
few pages tell of it.  What the markup says shifts it: articles up by ``UP``, what lies outside the
page's article down by ``OUTSIDE``; entropy can overrule both.  Menus, footers, forms, adverts, notices and reader
comments go whatever their entropy, since comments and teasers vary as articles do.  Class words
of html, body and of wrappers say nothing.  Blocks below ``KEEP`` go.

Two passes read the pages.  The first sends only counted hashes through the shuffle, so a host
with a third of all pages is pre-aggregated like any other.  The second reads each page with its
host's list of telling nodes, which was joined to it; that list is broadcast only if it has
at most ``MAX_BROADCAST`` nodes in all, and joined by host otherwise.

Defined results: null and empty html give the empty text; markup that is cut off or badly nested
is read as far as it goes (a script or style without end is code up to the end of the page, other raw elements without end stop at
the next tag, and a drawing or formula stops where a block begins); a host's only page, and a page without host, has the markup's word
alone; repeated pages count like other pages; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written

ship(__name__)

KEEP = 0.4
#: Importance without evidence, and how far the markup shifts it: neutral blocks go by the markup.
NEUTRAL, UP, OUTSIDE = 0.5, 0.3, -0.3
#: Text that at least so many pages share may count against a block by itself.
SHARED = 3
DECAY = 0.9
MAX_BROADCAST = 200_000

#: Fixed values of HTML: elements without content, with raw text, and those that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template".split())
#: Of these the rest of the page is content if no end tag comes; others then end at the next tag.
CODE = frozenset(("script", "style"))
#: Drawings and formulas nest by rules of their own: a block's start tag ends them.
FOREIGN = frozenset(("svg", "math"))
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element of these is closed by the next one of its group, or, for p, by any block.
_GROUPS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: What element names and words of class and id say.
DOWN_TAGS = frozenset("nav footer aside form menu dialog button select label input head svg".split())
#: Elements that hold running text: a class word makes these doubtful, but does not drop them by itself.
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figure figcaption span a b i em strong code q cite small sub sup time u s mark abbr".split())
DOWN_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside widget widgets cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup login share sharing social related recommended comment comments disqus respond reply replies pagination pager toolbar skip".split()
)
HEAD_WORDS = frozenset("header masthead topbar".split())
UP_TAGS = frozenset(("article", "main"))
UP_WORDS = frozenset("article post entry story".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S,
)
_CLASS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_WORDS = re.compile(r"[a-z]+")


class Block:
    """A run of text between block boundaries: its words and its chain of elements."""

    __slots__ = ("chain", "text")

    def __init__(self, chain: tuple, text: str) -> None:
        self.chain, self.text = chain, text


class Element:
    __slots__ = ("children", "label", "parent", "path", "tag", "words")

    def __init__(self, tag: str, words: tuple[str, ...], parent: Element | None) -> None:
        self.tag, self.words, self.parent = tag, words, parent
        self.label = tag + ("." + ".".join(words) if words else "")
        self.path = (parent.path if parent else "") + "/" + self.label
        self.children: list[str] = []


def parse(source: str | None) -> tuple[list[Block], list[Element]]:
    """The blocks of text in page order, and the elements."""
    root = Element("", (), None)
    root.path = ""
    stack, elements, out, buffer = [root], [], [], []
    data, at, end = source or "", 0, len(source or "")
    drawn = "<svg" in data or "<SVG" in data or "<Svg" in data

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                out.append(Block(tuple(stack), text))

    while at < end:
        lt = data.find("<", at)
        if lt < 0:
            lt = end
        if lt > at and not (drawn and any(e.tag == "svg" for e in stack)):
            piece = data[at:lt]
            buffer.append(html_lib.unescape(piece) if "&" in piece else piece)
        if lt >= end:
            break
        m = _TOKEN.match(data, lt)
        if not m:
            buffer.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if data.startswith("<![CDATA[", lt):
                buffer.append(data[lt + 9 : at].removesuffix("]]>"))
            continue
        if m[1] or m[4]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if tag in BLOCK:
                flush()
            if depth:
                if any(e.tag in BLOCK for e in stack[depth:]):
                    flush()
                del stack[depth:]
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in RAW:
            at = _after_raw(data, tag, at, bool(m[3]) and m[3].endswith("/"))
            continue
        if tag in BLOCK:
            flush()
            outer = next((i for i, e in enumerate(stack) if e.tag in FOREIGN), 0)
            if outer:
                del stack[outer:]
            for closes in ({"p"}, _GROUPS.get(tag, ())):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in closes:
                        del stack[i:]
                        break
                    if stack[i].tag in _SCOPES.get(tag, ()) or (closes == {"p"} and stack[i].tag in BLOCK):
                        break
        if tag in VOID:
            continue
        words = ()
        if m[3]:
            words = tuple(sorted({w for c in _CLASS.findall(m[3]) for w in _WORDS.findall(c.lower())}))
        e = Element(tag, words, stack[-1])
        stack[-1].children.append(e.label)
        if tag in BLOCK:
            elements.append(e)
        if not m[3] or not m[3].endswith("/"):
            stack.append(e)
    flush()
    return out, elements


def _after_raw(data: str, tag: str, at: int, closed: bool) -> int:
    """Where the content of a raw element that begins at ``at`` is over, its end tag included.

    One that closes itself is empty, unless an end tag comes before the next such element.
    """
    name = re.escape(tag) + r"(?=[\s/>]|\Z)"
    stop = re.compile("</" + name, re.I).search(data, at)
    if closed:
        again = re.compile("<" + name, re.I).search(data, at)
        if not stop or again and again.start() < stop.start():
            return at
    if stop:
        close = data.find(">", stop.end())
        return len(data) if close < 0 else close + 1
    following = -1 if tag in CODE else data.find("<", at)
    return len(data) if following < 0 else following


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _block_path(chain: tuple) -> str:
    return next((e.path for e in reversed(chain) if e.tag in BLOCK), "")


def observe(source: str | None) -> set[tuple[str, int, int]]:
    """What a page tells its host's tree: (path, kind, hash); kinds: 0 occurs, 1 presentation, 2 content."""
    blocks, elements = parse(source)
    seen: set[tuple[str, int, int]] = set()
    for e in elements:
        short = [c for i, c in enumerate(e.children) if not i or c != e.children[i - 1]]
        seen.add((e.path, 0, 0))
        seen.add((e.path, 1, _hash(" ".join(short))))
    for b in blocks:
        seen.add((_block_path(b.chain), 2, _hash(b.text)))
    return seen


def _down(e: Element) -> bool:
    return e.tag in DOWN_TAGS or bool(set(e.words) & DOWN_WORDS)


def wrappers(blocks: list[Block]) -> set[int]:
    """The elements (by id) whose class words say nothing: html, body, and those that hold nearly all
    of the page's text, or half of it with an article that is not itself marked down."""
    size: Counter = Counter()
    found: dict[int, Element] = {}
    around: set[int] = set()
    for b in blocks:
        for i, e in enumerate(b.chain):
            size[id(e)] += len(b.text)
            found[id(e)] = e
            if e.tag in UP_TAGS and not _down(e):
                around.update(id(x) for x in b.chain[:i])
    total = sum(len(b.text) for b in blocks)
    return {k for k, e in found.items() if e.tag in ("", "html", "body") or e.tag not in UP_TAGS and (10 * size[k] >= 9 * total or (k in around and 2 * size[k] >= total))}


def prior(chain: tuple, has_article: bool, plain: set[int] | frozenset[int] = frozenset()) -> float | None:
    """How the markup shifts a block, by being in an article or not; None where a branch of it is marked down.

    Class words of elements that hold running text are evidence alone, which entropy can overrule.
    """
    inside = doubtful = False
    for e in chain:
        words = frozenset() if id(e) in plain else set(e.words)
        if e.tag in UP_TAGS or "main" in words and e.tag == "div" or words & UP_WORDS:
            inside = True
        if e.tag in TEXT_LEVEL:
            doubtful = doubtful or bool(words & (DOWN_WORDS | HEAD_WORDS))
        elif e.tag in DOWN_TAGS or words & DOWN_WORDS or (not inside and (e.tag == "header" or words & HEAD_WORDS)):
            return None
    return (UP if inside else (OUTSIDE if has_article else 0.0)) + (OUTSIDE if doubtful else 0.0)


def extract(source: str | None, known: dict[int, float] | None = None) -> str:
    """The main text of a page, given its host's telling nodes (hash of path, or of path and text, to importance)."""
    blocks, elements = parse(source)
    has_article = any(e.tag in UP_TAGS for e in elements)
    plain = wrappers(blocks)
    kept = []
    for b in blocks:
        shift = prior(b.chain, has_article, plain)
        if shift is None:
            continue
        importance = NEUTRAL
        if known:
            told = [known[h] for h in {_hash(e.path) for e in b.chain if e.tag in BLOCK} if h in known]
            text = known.get(_text_node(_block_path(b.chain), _hash(b.text)))
            importance = min([*told, *([] if text is None else [text])], default=NEUTRAL)
        if importance + shift >= KEEP:
            kept.append(b.text)
    return "\n\n".join(kept)


def _text_node(path: str, code: int) -> int:
    return _hash(f"{path}\0{code}")


_SEEN = pa.schema([("host", pa.string()), ("path", pa.string()), ("kind", pa.int32()), ("hash", pa.int64()), ("n", pa.int64())])


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        rows = list(counts.items())
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([k[0][i] for k in rows], f.type) for i, f in enumerate(list(_SEEN)[:4])] + [pa.array([n for _, n in rows], pa.int64())], schema=_SEEN)

    for batch in batches:
        for host, page in zip(batch.column(0), batch.column(1), strict=True):
            h = host.as_py()
            for path, kind, code in observe(page.as_py()):
                counts[h, path, kind, code] += 1
        if len(counts) > 100_000:
            yield out()
    if counts:
        yield out()


def telling(pages: DataFrame) -> DataFrame:
    """(host, path, code, importance) of the nodes that occur in two pages of a host; with a code, of shared texts.

    ``pages`` has host and html.  A node's importance is between 0 and 1:
    (1 - DECAY^l) * entropy of the presentations + DECAY^l * mean over the contents below of
    (1 - log(pages with the content) / log(pages with the node)), l the number of presentations.
    That of a text in ``SHARED`` pages or more is its own term of that mean, and is listed if it is below
    ``KEEP`` and its node's is not.  Both are drawn to ``NEUTRAL`` by one part in the node's pages.
    """
    seen = pages.where("host <> ''").select("host", "html").mapInArrow(_observe, "host string, path string, kind int, hash long, n long")
    counts = written(seen.groupBy("host", "path", "kind", "hash").agg(F.sum("n").alias("n")))
    per = counts.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("m"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("styles"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log("n"))).alias("style_nlogn"),
        F.count(F.when(F.col("kind") == 2, 1)).alias("contents"),
        F.sum(F.when(F.col("kind") == 2, F.log("n"))).alias("content_log"),
    )
    per = written(per.where("m > 1"))
    # What lies below a node counts for it: each node's contents go to all its ancestors.
    levels = F.transform(F.sequence(F.lit(2), F.greatest(F.size(F.split("path", "/")), F.lit(2))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))
    below = per.where("contents > 0").select("host", F.explode(levels).alias("path"), "contents", (F.col("content_log") / F.log("m")).alias("alike"))
    below = below.groupBy("host", "path").agg(F.sum("contents").alias("contents_below"), F.sum("alike").alias("alike_below"))
    style = 1 - F.coalesce(F.col("style_nlogn"), F.lit(0.0)) / (F.col("m") * F.log("m"))
    content = 1 - F.coalesce(F.col("alike_below") / F.col("contents_below"), F.lit(1.0))
    weight = F.pow(F.lit(DECAY), F.col("styles").cast("double"))
    raw = (1 - weight) * F.least(F.greatest(style, F.lit(0.0)), F.lit(1.0)) + weight * F.least(F.greatest(content, F.lit(0.0)), F.lit(1.0))
    drawn = lambda x: F.lit(NEUTRAL) + (x - NEUTRAL) * (1 - 1 / F.col("m"))
    nodes = written(per.join(below, ["host", "path"], "left").select("host", "path", "m", drawn(raw).alias("importance")))
    texts = counts.where((F.col("kind") == 2) & (F.col("n") >= SHARED)).join(nodes.where(F.col("importance") >= KEEP).select("host", "path", "m"), ["host", "path"])
    texts = texts.select("host", "path", F.col("hash").alias("code"), drawn(F.greatest(1 - F.log("n") / F.log("m"), F.lit(0.0))).alias("importance")).where(F.col("importance") < KEEP)
    return nodes.select("host", "path", F.lit(None).cast("long").alias("code"), "importance").unionByName(texts)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of (page_id, url, html)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    hosted = pages.select("page_id", "url", "html", host.alias("host"))
    low = written(telling(hosted))
    lists = low.groupBy("host").agg(F.collect_list(F.struct("path", "code", "importance")).alias("low"))
    if low.count() <= MAX_BROADCAST:
        lists = F.broadcast(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[int, float]] = {}
        for batch in batches:
            texts = []
            for name, page, nodes in zip(batch.column("host"), batch.column("html"), batch.column("low"), strict=True):
                key = name.as_py()
                if key not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[key] = {_hash(x["path"]) if x["code"] is None else _text_node(x["path"], x["code"]): x["importance"] for x in nodes.as_py() or ()}
                texts.append(extract(page.as_py(), known[key]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return hosted.join(lists, "host", "left").select("page_id", "url", "html", "host", "low").mapInArrow(run, "page_id long, url string, text string, n_chars long")
