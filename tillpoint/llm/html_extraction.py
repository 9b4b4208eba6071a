"""Main text of web pages by equivalence-class template deduction.

The tokens of a page are its element starts, told apart by their path of
element names and classes, and, on pages without an article or main element,
its texts, told apart by path and words.  Over the pages of a host, Spark
sums a hash of (page, count) for each token, which stands for its vector of
occurrences: tokens of equal sums occur together, equally often, on the same
pages and form an equivalence class.  A class is valid when it has two tokens
or more, occurs on at least ``MIN_SHARE`` of the host's pages and once on
each; valid classes nest by path and make the template.  Only sums by host
and token are shuffled, already added up in each task, and the template of a
host is no longer than two of its pages.

The main slot of a host is its article or main element, if that is in the
template and holds at least half of the text that no menu, header, footer,
sidebar, form or comment section takes.  Else it is the deepest template
element that holds all of that text.  There every slot is read: what is left
out are the texts of the template itself and containers that hold links only.
A page of which the template's texts are the larger half (one of many
copies) keeps them.

What is not the article is left out in both cases: by element and role, and
by names.  A class or id counts only as a whole, if each of its words is one
of ``_WORDS`` or says nothing of its own, and for an element with less than
half of the slot's text.  A page without the host's main slot falls back to
its own article, main or body element.

Defined results: null and empty pages give an empty text; pages without a
host form one group; what a broken or cut-off page leaves open ends with the
page; a tag that never ends is dropped; a line break is white space inside
its block; repeated rows are extracted each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import cut, read_table
from tillpoint.llm.packing import slices

MIN_SHARE = 0.5
MIN_PAGES = 3  # of a host whose texts can be template
MAX_OPEN_SUMS = 200_000
MAX_BROADCAST_BYTES = 32 << 20
SALTS = 64
SLICE_BYTES = 8 << 20

# What HTML says of its elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg select".split())
_BLOCK = frozenset(
    "address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
# What is never part of an article.
_APART = frozenset("nav footer aside form head button dialog menu".split()) | _RAW
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu".split())
_COMMENTS = frozenset("comment comments disqus reply replies".split())
_WORDS = _COMMENTS | frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo promotion sidebar menu nav navigation navbar "
    "breadcrumb breadcrumbs cookie cookies consent notice banner popup modal overlay newsletter subscribe signup login "
    "share sharing social related recommended footer header widget".split())
# Words that say nothing of their own beside those.
_NEUTRAL = frozenset(
    "area article bar block body bottom box button buttons container content entry fixed form global inner item items "
    "left link links list main outer page panel post posts right section site sticky text top wrap wrapper".split())
_SLOTS = frozenset("article main section div td body".split())
_HOLDERS = frozenset("div section ul ol dl table".split())
_SEPARATORS = " \t\r\n|/·•»>,-"
_TEXT = "\x01"  # between the path and the hash of a text token

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s=/]|\Z)|display\s*:\s*none", re.I)
_DIGITS = re.compile(r"\d+")
_BETWEEN = re.compile(r"[\s_\d-]+")


@dataclass
class Node:
    name: str
    path: str
    parent: int
    apart: bool  # by element or role, or a comment section
    worded: bool  # by its names only
    chars: int = 0  # text in the subtree that is not apart
    linked: int = 0  # the part of it in links


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    texts: list[tuple[int, str]] = field(default_factory=list)  # (node, text); node -1: a block ends


def parse(source: str) -> Page:
    """Elements with their parents, and texts in page order."""
    page = Page([Node("", "", -1, False, False)])
    stack, at, size = [0], 0, len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        end = m.start() if m else size
        if end > at:
            page.texts.append((stack[-1], source[at:end]))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name in _BLOCK:
            page.texts.append((-1, ""))
        elif name == "br":
            page.texts.append((stack[-1], " "))
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if page.nodes[stack[k]].name == name:
                    del stack[k:]
                    break
            continue
        attributes = m[3] if m[3] is not None else m[6] or ""
        known = {}
        if attributes:
            for a in _ATTRIBUTE.finditer(attributes):
                known.setdefault(a[1].lower(), (a[2] or a[3] or a[4] or "").lower())
        marks = " ".join(sorted(known.get("class", "").split()))
        parent = page.nodes[stack[-1]]
        path = f"{parent.path}/{name}" + (f".{_DIGITS.sub('0', marks)}" if marks else "")
        within = "/article" in parent.path or "/main" in parent.path  # where a header belongs to the article
        words = _telling(f"{marks} {known.get('id', '')}") if marks or "id" in known else frozenset()
        if within or name in ("html", "body", "article", "main"):
            words -= {"header"}
        apart = (name in _APART or known.get("role") in _ROLES or name == "header" and not within
                 or bool(words & _COMMENTS) or bool(_HIDDEN.search(attributes)))
        page.nodes.append(Node(name, path, stack[-1], apart, bool(words)))
        if name in _RAW:
            close = re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else size
        elif name not in _VOID and not attributes.endswith("/"):
            stack.append(len(page.nodes) - 1)
    _count(page)
    return page


def _telling(names: str) -> frozenset[str]:
    """Those of ``_WORDS`` in names that have no word of another meaning."""
    out: set[str] = set()
    for one in names.split():
        own = {w for w in _BETWEEN.split(one) if w}
        if own <= _WORDS | _NEUTRAL:
            out |= own & _WORDS
    return frozenset(out)


def _count(page: Page) -> None:
    inside, linked = [False] * len(page.nodes), [False] * len(page.nodes)
    for k, node in enumerate(page.nodes):  # parents come first
        inside[k] = node.apart or node.parent >= 0 and inside[node.parent]
        linked[k] = node.name == "a" or node.parent >= 0 and linked[node.parent]
    for k, text in page.texts:
        if k >= 0 and not inside[k]:
            size = len(text.strip(_SEPARATORS))
            page.nodes[k].chars += size
            page.nodes[k].linked += size * linked[k]
    for node in reversed(page.nodes):
        if node.parent >= 0 and not node.apart:
            page.nodes[node.parent].chars += node.chars
            page.nodes[node.parent].linked += node.linked


def _text_hash(path: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\n{' '.join(text.split())}") >> 1


def named(page: Page) -> bool:
    return any(n.name in ("article", "main") for n in page.nodes)


def main_text(page: Page, slot: str | None, constant: frozenset[int] = frozenset()) -> str:
    """The blocks of the main slot, one to a line, without the texts of the
    template (``constant``) where the slot is no article or main element."""
    roots = [k for k, n in enumerate(page.nodes) if n.path == slot]
    for name in ("article", "main", "body", ""):
        roots = roots or [k for k, n in enumerate(page.nodes) if n.name == name]
    whole = sum(page.nodes[k].chars for k in roots)
    plain = not roots or page.nodes[roots[0]].name not in ("article", "main")
    keep = [False] * len(page.nodes)
    chosen = set(roots)
    for k, node in enumerate(page.nodes):
        inside = k in chosen or node.parent >= 0 and keep[node.parent]
        out = node.apart or node.worded and 2 * node.chars < whole or (
            plain and node.name in _HOLDERS and 0 < node.chars == node.linked and 2 * node.chars < whole)
        keep[k] = inside and (k in chosen or not out)
    kept = [(k, t) for k, t in page.texts if k < 0 or keep[k]]
    if plain and constant:
        own = [(k, t) for k, t in kept if k < 0 or not t.strip() or _text_hash(page.nodes[k].path, t) not in constant]
        sizes = [sum(len(t.strip()) for k, t in x if k >= 0) for x in (own, kept)]
        kept = own if 2 * sizes[0] >= sizes[1] else kept
    blocks, now = [], []
    for k, text in [*kept, (-1, "")]:
        if k >= 0:
            now.append(text)
        elif now:
            if block := " ".join(html.unescape("".join(now)).split()):
                blocks.append(block)
            now = []
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


def token_sums(pages: DataFrame) -> DataFrame:
    """For each host and token: ``pages`` with it, ``times``, the two sums
    ``one`` and ``two`` of its occurrence vector, and ``chars`` of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], list[int]] = {}

        def out() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in sums.items()]
            sums.clear()
            cols = list(zip(*rows)) if rows else [()] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(cols)],
                names=["host", "token", "pages", "times", "one", "two", "chars"])

        for batch in batches:
            for host, name, source in zip(*(c.to_pylist() for c in batch.columns)):
                own: dict[str, list[int]] = {}
                page = parse(source or "")
                for node in page.nodes:
                    x = own.setdefault(node.path, [0, 0])
                    x[0] += 1
                    x[1] += node.chars
                if not named(page):
                    for k, text in page.texts:
                        if k >= 0 and text.strip():
                            path = page.nodes[k].path
                            own.setdefault(f"{path}{_TEXT}{_text_hash(path, text)}", [0, 0])[0] += 1
                for token, (times, chars) in own.items():
                    mark = xxhash.xxh3_64_intdigest(f"{name}:{times}")
                    x = sums.setdefault((host, token), [0, 0, 0, 0, 0])
                    for k, add in enumerate((1, times, mark & 0xFFFFFFFF, mark >> 32, chars)):
                        x[k] += add
                if len(sums) > MAX_OPEN_SUMS:
                    yield out()
        yield out()

    sums = pages.select("host", F.xxhash64("page_id", "html").cast("string").alias("name"), "html").mapInArrow(
        run, "host string, token string, pages long, times long, one long, two long, chars long")
    return sums.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "times", "one", "two", "chars")])


def main_slots(sums: DataFrame, min_share: float = MIN_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, slot, constant): the path of each host's main slot, and the hashes
    of the texts in its template."""
    sums = cut(sums)
    totals = cut(sums.groupBy("host").agg(F.max("pages").alias("total")))
    text = F.instr("token", _TEXT) > 0
    common = (with_hosts(sums.filter(~text | (F.col("pages") > 1)), totals)
              .filter((F.col("pages") >= F.col("total") * min_share) & (~text | (F.col("total") >= min_pages))))
    # What is left of a host is bounded by the length of its pages.
    classes = common.groupBy("host", "one", "two", "pages", "times").agg(
        F.count(F.lit(1)).alias("tokens"), F.collect_list(F.struct("token", "chars")).alias("own"))
    valid = (classes.filter((F.col("tokens") > 1) & (F.col("times") == F.col("pages")))
             .select("host", F.explode("own").alias("o")).select("host", "o.token", "o.chars"))
    name = F.regexp_extract("token", r"([a-z0-9]+)(?:\.[^/]*)?$", 1)
    half = 2 * F.col("chars") >= F.col("held")
    rank = (F.when((F.col("name") == "article") & half, 2).when((F.col("name") == "main") & half, 1)
            .when((F.col("chars") >= F.col("held")) & F.col("name").isin(*sorted(_SLOTS)), 0))
    best = F.struct("rank", F.when(F.col("rank") > 0, F.col("chars")).otherwise(F.size(F.split("token", "/"))), "token")
    known = F.substring_index("token", _TEXT, -1).cast("long")
    return (valid.withColumn("held", F.max("chars").over(Window.partitionBy("host")))
            .withColumn("name", name).withColumn("rank", F.when(~text, rank))
            .groupBy("host").agg(F.max_by(F.when(F.col("rank").isNotNull(), F.col("token")),
                                          F.when(F.col("rank").isNotNull(), best)).alias("slot"),
                                 F.collect_set(F.when(text, known)).alias("constant")))


def with_hosts(rows: DataFrame, hosts: DataFrame, most: int = MAX_BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """``rows`` (host, ...) with the columns of their host in ``hosts``, null
    without one.  Up to ``most`` bytes of hosts are broadcast; with more, the
    rows of a host are dealt over ``salts`` keys, so that a host with very many
    does not meet in one task."""
    size = F.length("host") + 64
    if "constant" in hosts.columns:
        size += F.coalesce(F.length("slot"), F.lit(0)) + 8 * F.size("constant")
    if (hosts.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0) <= most:
        return rows.join(F.broadcast(hosts), "host", "left")
    spread = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "host"]), F.lit(salts)).cast("int"))
    return salted.join(spread, ["host", "salt"], "left").drop("salt")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and the main ``text`` of ``pages`` (page_id, url, html)."""
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    slots = cut(main_slots(token_sums(own)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, SLICE_BYTES, 2):
                texts = [main_text(parse(h or ""), s, frozenset(c or ()))
                         for h, s, c in zip(*(some.column(k).to_pylist() for k in (2, 3, 4)))]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string())],
                                                 names=["page_id", "url", "text"])

    placed = with_hosts(own, slots).select("page_id", "url", "html", "slot", "constant")
    kind = dict(placed.dtypes)["page_id"]
    return placed.mapInArrow(run, f"page_id {kind}, url string, text string")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (extract(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
            .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")))


QUERIES = {"op4_html": op4_html}
