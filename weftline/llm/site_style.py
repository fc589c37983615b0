"""HTML main-text extraction with site style trees.

Each page is parsed once into blocks: runs of text between block-level tags,
furniture included.  A block hangs as a leaf under its innermost block-level
element; an element is named by the tags and classes from the root down to it,
so the trees of one host's pages merge by name.

* Content importance of a leaf: mean over its distinct contents of 1 - log(k) /
  log(n), with k the pages that show the content and n those that have the leaf
  (1 if every page has its own content, 0 if all show the same).
* Presentation importance of an element: entropy of the sequences of block-level
  children that the host's pages have there, in units of the host's largest (1
  everywhere on a host where nothing varies: the tree is silent then).
* Composite importance, bottom-up: a leaf has ``gamma`` of its content importance
  and the rest of the presentation importance of the most varied element that
  holds it; parts of an ``article`` element count as held by the most varied one.
  A branch has the mean of its leaves, weighted by their words.
* A branch whose importance is below ``threshold`` of the whole tree's is removed
  from each page, with all leaves below it.

Few pages say little about a host: every host's content and presentation
importance counts as ``prior`` pages of the tree pooled over all hosts, and the
pooled one as ``prior`` pages of importance 1.  That holds at every size; nothing
is switched.  Pages with equal blocks count once, so that mirrored copies of an
article do not make it look like furniture.

On a page of which it would leave nothing, the tree has not found the main branch
and is silent.  What the tree leaves is decided by tie-breaks: elements and class words whose
meaning is fixed (see the tables below) mark furniture that varies as the article
does, such as reader comments; and where a page has an article, only that is
returned, else its main element, else its body.  ``n_tree``, ``n_listed`` and
``n_outside`` count the blocks that each step removes, ``n_cut`` those of the
first that the other two would have left.

Statistics are Spark aggregates over (host, leaf, content) and (host, element,
sequence) rows of hashes, so a host with a third of all pages is no group of one
task.  The leaves to be removed travel to the pages by broadcast if there are at
most ``max_low`` (rows of fixed width), else by a join salted over the pages.

Nulls: null html is the empty page (text empty, all counts 0); a null or unusual
url has the empty host; a null id is carried through.  Empty table: empty result.
Repeated rows are extracted each and count once in the statistics.  Elements
below the 512th level are taken for siblings on it, as browsers do.  Further
columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import materialise

#: Elements without text of the page, and elements of furniture.
NO_TEXT = frozenset("head script style noscript template select textarea input button label iframe object svg canvas title audio video map".split())
FURNITURE = frozenset("nav footer aside form dialog menu option".split())
#: Elements whose content is not markup.
RAW_TAGS = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: What a start tag closes: an open element of the named kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role attributes that name furniture.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup paywall comment comments commentlist disqus respond reply replies sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs topbar masthead "
    "footer foot copyright legal disclaimer social share sharing related recommended recommendations widget widgets form search login pagination pager toolbar complementary contentinfo skip hidden".split()
)
#: Of these, the ones that an article inside does not undo.
DEEP = frozenset("comment comments commentlist disqus respond reply replies sidebar sidebars aside related recommended recommendations widget widgets".split())
HEADERS = frozenset(["header", "banner"])

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))|\b(hidden)\b(?!\s*=)|\b(aria-hidden)\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+")
_HIDE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW_TAGS}


MAX_DEPTH = 512


class _Node:
    __slots__ = ("tag", "key", "holder", "noise", "deep", "silent", "level", "children")

    def __init__(self, tag, key, holder, noise, deep, silent, level):
        self.tag, self.key, self.holder, self.noise, self.deep, self.silent, self.level = tag, key, holder, noise, deep, silent, level
        self.children = []


def _style(attrs: str) -> tuple[str, set[str], bool]:
    """(class part of the path, words of class, id and role, hidden)."""
    name, words, hidden = "", set(), False
    for m in _ATTR.finditer(attrs):
        key = (m[1] or "").lower()
        value = m[2] or m[3] or m[4] or ""
        if m[5] or m[6]:
            hidden = True
        elif key == "style":
            hidden |= bool(_HIDE.search(value))
        elif key:
            words.update(_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()))
            if key == "class":
                name = ".".join(sorted(value.split()))
    return name, words, hidden


@dataclass
class Page:
    """``blocks``: (leaf, text, words, listed, level); ``leaves``: leaf -> (its
    elements, level); ``shapes``: (element, names of its block-level children)."""

    blocks: list[tuple[int, str, int, bool, int]]
    leaves: dict[int, tuple[tuple[int, ...], int]]
    shapes: list[tuple[int, str]]


def _h(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def parse_page(page: str, noise_words: frozenset = NOISE, furniture: frozenset = FURNITURE) -> Page:
    """All blocks of a page.  ``listed``: a fixed element or class word marks it."""
    root = _Node("", 0, (0,), False, False, False, 0)
    stack, out = [root], Page([], {}, [])
    text: list[str] = []

    def flush():
        s = " ".join(_html.unescape("".join(text)).split()) if text else ""
        text.clear()
        if s:
            at = next((n for n in reversed(stack) if n.tag in BLOCKS), root)
            leaf = _h(f"{at.key}/#")
            out.blocks.append((leaf, s, s.count(" ") + 1, at.noise, at.level))
            out.leaves[leaf] = (at.holder, at.level)

    def add(piece):
        if not stack[-1].silent:
            text.append(piece)

    def close(depth):
        for n in stack[depth:]:
            if n.children:
                out.shapes.append((n.key, ",".join(n.children)))
        del stack[depth:]

    pos, size = 0, len(page)
    while pos < size:
        m = _TOKEN.search(page, pos)
        if m is None:
            add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos : m.start()])
        pos = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                add(_html.escape(m[0][9:-3]))
            continue
        tag = tag.lower()
        if tag in ("br", "wbr"):
            if tag == "br":
                add(" ")
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
                if not block and stack[depth].tag in BLOCKS:
                    break
            continue
        if block:
            ends = {"p"} | CLOSES.get(tag, set())
            for depth in range(len(stack) - 1, 0, -1):
                kind = stack[depth].tag
                if kind in ends:
                    close(depth)
                    if kind == "p" and tag not in CLOSES:
                        break
                elif kind in BLOCKS:
                    break
        if tag in VOID:
            continue
        if len(stack) > MAX_DEPTH:
            close(len(stack) - 1)
        name, words, hidden = _style(m[3]) if m[3] else ("", set(), False)
        top = stack[-1]
        level = max(top.level, 2 if tag == "article" else 1 if tag == "main" or "main" in words and "role" in m[3] else 0)
        marked = words & noise_words
        own = hidden or tag in furniture or bool(marked - HEADERS) or ((tag == "header" or bool(marked & HEADERS)) and level == 0)
        deep = top.deep or tag == "aside" or bool(marked & DEEP)
        noise = own or (top.noise and (deep or tag not in ("article", "main")))
        # no text: neither of elements that never have any nor of marked pieces within a block
        silent = top.silent or tag in NO_TEXT or (not block and own)
        if block:
            style = f"{tag}.{name}" if name else tag
            holder = next(n for n in reversed(stack) if n is root or n.tag in BLOCKS)
            holder.children.append(style)
            key = _h(f"{holder.key}/{style}")
            stack.append(_Node(tag, key, (*holder.holder, key), noise, deep, silent, level))
        else:
            stack.append(_Node(tag, top.key, top.holder, noise, deep, silent, level))
        if tag in RAW_TAGS:
            end = _RAW_END[tag].search(page, pos)
            pos = end.end() if end else size
            close(len(stack) - 1)
    flush()
    close(0)
    return out


_TYPES = {
    "blocks": pa.list_(pa.struct([("leaf", pa.int64()), ("text", pa.string()), ("listed", pa.bool_()), ("level", pa.int32())])),
    "leaves": pa.list_(pa.struct([("leaf", pa.int64()), ("held", pa.list_(pa.int64())), ("level", pa.int32())])),
    "seen": pa.list_(pa.struct([("leaf", pa.int64()), ("content", pa.int64()), ("words", pa.int64()), ("first", pa.int32())])),
    "shapes": pa.list_(pa.struct([("node", pa.int64()), ("shape", pa.int64())])),
}
PARSED = (
    "page long, blocks array<struct<leaf:bigint,text:string,listed:boolean,level:int>>, leaves array<struct<leaf:bigint,held:array<bigint>,level:int>>, "
    "seen array<struct<leaf:bigint,content:bigint,words:bigint,first:int>>, shapes array<struct<node:bigint,shape:bigint>>"
)


def _row(page: Page) -> dict:
    words: dict[tuple[int, int], int] = {}
    for leaf, text, n, _, _ in page.blocks:
        key = (leaf, _h(text))
        words[key] = words.get(key, 0) + n
    seen, known = [], set()
    for (leaf, content), n in words.items():
        seen.append({"leaf": leaf, "content": content, "words": n, "first": int(leaf not in known)})
        known.add(leaf)
    return {
        "page": _h("\n".join(b[1] for b in page.blocks)),
        "blocks": [{"leaf": b[0], "text": b[1], "listed": b[3], "level": b[4]} for b in page.blocks],
        "leaves": [{"leaf": k, "held": list(v[0]), "level": v[1]} for k, v in page.leaves.items()],
        "seen": seen,
        "shapes": [{"node": n, "shape": _h(c)} for n, c in dict(page.shapes).items()],
    }


def parse(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", noise_words: frozenset = NOISE, furniture: frozenset = FURNITURE) -> DataFrame:
    """(page_id, url, host, page, blocks, leaves, seen, shapes) of every page;
    ``page`` is a hash of its blocks' texts."""
    kinds = ", ".join(f"{k} {pages.schema[c].dataType.simpleString()}" for k, c in (("page_id", page_id), ("url", url)))
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))

    def run(batches):
        for batch in batches:
            rows = [_row(parse_page(x or "", noise_words, furniture)) for x in batch.column(3).to_pylist()]
            cols = [pa.array([r["page"] for r in rows], pa.int64()), *[pa.array([r[k] for r in rows], t) for k, t in _TYPES.items()]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *cols], ["page_id", "url", "host", "page", *_TYPES])

    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), html).mapInArrow(run, f"{kinds}, host string, {PARSED}")


def _content(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, w, c): pages, words and content importance of leaves."""
    g = counts.groupBy(*by).agg(F.sum("first").alias("n"), F.sum("words").alias("w"), F.avg(F.log("k")).alias("a"))
    return g.select(*by, "n", "w", F.when(F.col("n") > 1, 1 - F.col("a") / F.log("n")).otherwise(1.0).alias("c"))


def _entropy(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, h): pages and entropy of an element's child sequences."""
    g = counts.groupBy(*by).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log("k")).alias("a"))
    return g.select(*by, "n", F.greatest(F.lit(0.0), F.log("n") - F.col("a") / F.col("n")).alias("h"))


def _varied(h: str, most: str) -> Column:
    return F.when(F.col(most) > 1e-9, F.col(h) / F.col(most)).otherwise(1.0)


def style_tree(parsed: DataFrame, gamma: float = 0.5, threshold: float = 0.75, prior: float = 4.0) -> DataFrame:
    """(host, leaf, n, w, content, presentation, importance, low) of every leaf of
    every host's tree; low: a branch that it is in, or itself, is removed."""
    seen = parsed.select("host", "page", F.explode("seen").alias("s")).select("host", "page", "s.*").distinct()
    seen = materialise(seen.groupBy("host", "leaf", "content").agg(F.count(F.lit(1)).alias("k"), F.sum("words").alias("words"), F.sum("first").alias("first")), "site-contents")
    drawn = parsed.select("host", "page", F.explode("shapes").alias("s")).select("host", "page", "s.*").distinct()
    drawn = materialise(drawn.groupBy("host", "node", "shape").agg(F.count(F.lit(1)).alias("k")), "site-shapes")

    def settle(own: Column, n: Column, pooled: Column) -> Column:
        return (own * n + pooled * prior) / (n + prior)

    every = seen.groupBy("leaf", "content").agg(F.sum("k").alias("k"), F.sum("words").alias("words"), F.sum("first").alias("first"))
    pool = _content(every, ["leaf"]).select("leaf", settle(F.col("c"), F.col("n"), F.lit(1.0)).alias("pc"))
    leaf = _content(seen, ["host", "leaf"]).join(pool, "leaf").withColumn("content", settle(F.col("c"), F.col("n"), F.col("pc"))).drop("c", "pc")

    every = _entropy(drawn.groupBy("node", "shape").agg(F.sum("k").alias("k")), ["node"])
    pool = every.crossJoin(F.broadcast(every.agg(F.max("h").alias("most"))))  # one row
    pool = pool.select("node", settle(_varied("h", "most"), F.col("n"), F.lit(1.0)).alias("pp"))
    node = _entropy(drawn, ["host", "node"])
    node = node.join(node.groupBy("host").agg(F.max("h").alias("most")), "host").join(pool, "node")
    node = node.select("host", "node", settle(_varied("h", "most"), F.col("n"), F.col("pp")).alias("p"))

    place = parsed.select(F.explode("leaves").alias("l")).select("l.leaf", "l.held", "l.level").dropDuplicates(["leaf"])
    leaf = materialise(leaf.join(place, "leaf"), "site-leaves")
    up = leaf.select("host", "leaf", F.explode("held").alias("node")).join(node, ["host", "node"], "left")
    up = up.groupBy("host", "leaf").agg(F.max("p").alias("p"))
    leaf = leaf.join(up, ["host", "leaf"], "left").withColumn("presentation", F.when(F.col("level") == 2, 1.0).otherwise(F.coalesce("p", F.lit(0.0))))
    leaf = leaf.withColumn("importance", gamma * F.col("content") + (1 - gamma) * F.col("presentation"))
    leaf = materialise(leaf.select("host", "leaf", "n", "w", "content", "presentation", "importance", F.concat("held", F.array("leaf")).alias("held")), "site-importance")

    mean = F.sum(F.col("w") * F.col("importance")) / F.sum("w")
    whole = leaf.groupBy("host").agg(mean.alias("whole"))
    branch = leaf.select("host", "w", "importance", F.explode("held").alias("node")).groupBy("host", "node").agg(mean.alias("b"))
    branch = branch.join(whole, "host").where(F.col("b") < threshold * F.col("whole")).select("host", "node")
    low = leaf.select("host", "leaf", F.explode("held").alias("node")).join(branch, ["host", "node"], "left_semi").select("host", "leaf").distinct()
    return leaf.drop("held").join(low.withColumn("low", F.lit(True)), ["host", "leaf"], "left").withColumn("low", F.coalesce("low", F.lit(False)))


def extract(pages: DataFrame, gamma: float = 0.5, threshold: float = 0.75, prior: float = 4.0, max_low: int = 200_000, salts: int = 32, **names) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_tree, n_listed, n_outside, n_cut)
    of every page."""
    parsed = materialise(parse(pages, **names), "site-style")
    low = materialise(style_tree(parsed, gamma, threshold, prior).where("low").select("host", "leaf"), "site-low")
    body = parsed.select("page_id", "url", "host", "blocks")
    few = low.count() <= max_low
    gone = low.groupBy("host").agg(F.collect_list("leaf").alias("low"))
    if few:
        joined = body.join(F.broadcast(gone), "host", "left")
    else:  # pages of one host are dealt to many tasks
        body = body.withColumn("__salt", (F.rand(5) * salts).cast("int"))
        gone = gone.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = body.join(gone.hint("shuffle_hash"), ["host", "__salt"], "left").drop("__salt")
    marked = F.transform("blocks", lambda b: b.withField("low", F.array_contains(F.coalesce("low", F.array().cast("array<bigint>")), b.leaf)))
    # generators, so that the marks are worked out once
    out = joined.select("page_id", "url", F.explode(F.array(marked)).alias("b"))
    out = out.withColumn("best", F.array_max(F.transform("b", lambda x: F.when(~x.listed, x.level))))
    some = F.exists("b", lambda x: ~x.low & ~x.listed & (x.level == F.col("best")))
    spoken = F.transform("b", lambda x: x.withField("low", x.low & F.coalesce(some, F.lit(False))))
    out = out.select("page_id", "url", "best", F.explode(F.array(spoken)).alias("b"))
    out = out.withColumn("kept", F.filter("b", lambda x: ~x.low & ~x.listed & (x.level == F.col("best")))).withColumn("text", F.array_join(F.transform("kept", lambda x: x.text), "\n"))
    n = lambda test: F.size(F.filter("b", test))
    return out.select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), F.size("b").alias("n_blocks"),
        n(lambda x: x.low).alias("n_tree"), n(lambda x: ~x.low & x.listed).alias("n_listed"), n(lambda x: ~x.low & ~x.listed & (x.level < F.col("best"))).alias("n_outside"),
        n(lambda x: x.low & ~x.listed & (x.level == F.col("best"))).alias("n_cut"),
    )
