"""Main text of HTML pages by site style trees.

The DOMs of one host are merged into a style tree: a node is the path of
block elements (tag and class words) that leads to it.  Two entropies say
how much a node varies over the host's m pages:

* presentation: the entropy, to base m, of the child sequences seen there;
* content: 1 minus the mean entropy of its texts over the pages.  A text
  found on c of m pages has the entropy log c / log m: 0 where it is unique,
  1 where it stands on every page.

A branch is as important as the larger of its presentation and of the most
important content below it, so only a branch without any important part is
low.  Menus, adverts and notices that a site repeats come out low, and the
branch is cut from every page of the host.

Copies of a page say nothing new: pages of a host count once for each
distinct main content (the texts outside clutter), and the nodes inside
``article`` or ``main`` once for each distinct text there.

A host with few pages says little, so its figures are shrunk towards those
of the same path over all hosts, and those towards a value for the role of
the element.  Entropy cannot tell reader comments or forms from an article,
as both differ on every page; outside ``article`` and ``main`` the role (tag,
class and id words) therefore scales the importance so that clutter always
goes.  Inside them the role is only the value that figures are shrunk to:
what differs from article to article outweighs it, and what most distinct
articles of a host repeat is cut under any name.  An article printed twice
counts once, so it stays.

Null and empty pages give an empty text; a page without a url belongs to
the host ''.  Rows are handled one by one, so repeated rows give equal
texts; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regioscope.llm.scratch import materialize

#: Pages that the next wider tree counts for, and the least importance kept.
SHRINK, LEAST = 20, 0.6
#: Elements deeper than this share the style node of their ancestor there.
DEPTH = 48
#: A noise list of at most this many bytes goes to every task, else by join.
SMALL_BYTES = 8 << 20

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr img br map picture source".split())
CLOSES_ALSO = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
               "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
               "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
               "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
TABLE_SCOPE = {"table"}

# Roles: elements and class or id words that mark clutter.
CLUTTER_TAGS = frozenset("nav footer header aside form script style textarea title noscript template "
                         "iframe button select option dialog menu object svg canvas head".split())
CLUTTER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer header login menu modal nav navbar navigation newsletter "
    "notice notices overlay popup promo promoted related replies share sharing sidebar signup social "
    "sponsor sponsored subscribe toolbar widget".split())
CONTENT_TAGS = frozenset(("article", "main"))
INSIDE = r"(^|/)(article|main)(\.|/|$)"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
HOST_PATTERN = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_HOST = re.compile(HOST_PATTERN)
_INSIDE = re.compile(INSIDE)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def signature(tag: str, attributes: str) -> str:
    """The style of an element: its tag and the words of class, id and role."""
    if not attributes or "=" not in attributes:
        return tag
    words = sorted({w for m in _NAMES.finditer(attributes)
                    for w in _WORD.findall((m[2] or m[3] or m[4] or "").lower())})
    return ".".join([tag, *words])


def is_clutter(sig: str) -> bool:
    tag, *words = sig.split(".")
    return tag in CLUTTER_TAGS or tag not in ("html", "body", *CONTENT_TAGS) and not CLUTTER_WORDS.isdisjoint(words)


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str]]:
    """(path of signatures, text) of every stretch of text between block
    boundaries, and (path, '') for each block element that begins.

    Open elements are closed as the HTML standard has it: a block closes an
    open paragraph, an item the item before it, an end tag what lies inside.
    """
    tags: list[str] = []
    path: list[str] = []
    text: list[str] = []
    at, size = 0, len(page)

    def flush():
        found = " ".join(entities.unescape("".join(text)).split()) if text else ""
        text.clear()
        return found

    last = page.rfind(">")  # no tag ends behind it: looking for one there would take quadratic time
    while at < size:
        m = _TOKEN.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "br":
            text.append(" ")
            continue
        if tag in INLINE:
            continue
        if found := flush():
            yield tuple(path), found
        if m[1]:
            if tag in tags:
                while tags and tags.pop() != tag:
                    pass
                del path[min(len(path), len(tags)):]
            continue
        # what this element closes before it opens
        others, scope = CLOSES_ALSO.get(tag, ()), SCOPES.get(tag, TABLE_SCOPE)
        for k in range(len(tags) - 1, -1, -1):
            if tags[k] == "p" or tags[k] in others:
                del tags[k:], path[min(len(path), k):]
            elif tags[k] in scope or tags[k] in CONTENT_TAGS or not others:
                break
        sig = signature(tag, m[3])
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            inner = page[at:end.start()] if end else page[at:]
            at = end.start() if end else size
            yield (*path, sig)[:DEPTH], ""
            if tag in ("textarea", "title") and inner.strip():
                yield (*path, sig)[:DEPTH], " ".join(entities.unescape(inner).split())
            if end:
                at = page.find(">", at) + 1 or size
            continue
        tags.append(tag)
        if len(path) < DEPTH:
            path.append(sig)
        yield tuple(path), ""
    if found := flush():
        yield tuple(path), found


def _hash(text: str) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def style_rows(page: str) -> tuple[dict[str, int], set[tuple[str, int]]]:
    """Of one page: the presentation of each node (a hash of the children of
    all its instances), and its distinct (node, text)."""
    children: dict[str, list[str]] = {}
    texts: set[tuple[str, int]] = set()
    for path, text in blocks(page):
        node = "/".join(path)
        if text:
            texts.add((node, _hash(text)))
            children.setdefault(node, []).append("#")
        else:
            children.setdefault(node, [])
            children.setdefault("/".join(path[:-1]), []).append(path[-1])
    return {n: _hash("|".join(c)) for n, c in children.items()}, texts


def content_keys(texts: set[tuple[str, int]]) -> tuple[int, int]:
    """What tells a page from its copies: a hash of its texts outside clutter
    (of all, where these are none), and one of those inside the article."""
    clear = sorted(x for x in texts if not any(map(is_clutter, x[0].split("/")))) or sorted(texts)
    return _hash(repr(clear)), _hash(repr([x for x in clear if _INSIDE.search(x[0])]))


def _observations(pages: DataFrame) -> DataFrame:
    """(host, node, kind, feature, page): a row per page and node with its
    presentation (kind 0) and per page, node and text (kind 1); copies of a
    page have the same ``page``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "node", "kind", "feature", "page"]
        for batch in batches:
            rows: list[tuple] = []
            for i, (url, page) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), 1):
                host = host_of(url)
                seen, texts = style_rows(page or "")
                keys = content_keys(texts)
                of = {n: keys[_INSIDE.search(n) is not None] for n in seen}
                rows += [(host, n, 0, f, of[n]) for n, f in seen.items()]
                rows += [(host, n, 1, f, of[n]) for n, f in texts]
                if len(rows) > 20_000 or i == batch.num_rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows],
                                                     schema=pa.schema([("host", pa.string()), ("node", pa.string()),
                                                                       ("kind", pa.int32()), ("feature", pa.int64()),
                                                                       ("page", pa.int64())]))
                    rows = []

    return (pages.select(F.col("url").cast("string"), F.col("html").cast("string"))
            .mapInArrow(run, "host string, node string, kind int, feature long, page long"))


def _importance(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, m, importance) from (by, node, kind, feature, n)."""
    # HTML seen on one page only says nothing about repetition: importance 1
    own = (counts.where("kind = 0").groupBy(*by, "node")
           .agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
           .select(*by, "node", "m", F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m"))
                   .otherwise(1.0).alias("style")))
    texts = (counts.where("kind = 1").groupBy(*by, "node")
             .agg(F.sum(F.log("n")).alias("logs"), F.count("*").alias("kinds")))
    leaf = (own.join(texts, [*by, "node"]).select(
        *by, "node",
        F.when(F.col("m") > 1, 1 - F.col("logs") / F.col("kinds") / F.log("m"))
        .otherwise(1.0).alias("content")))
    parts = F.split("node", "/")
    branch = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)),
                                   lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    below = (leaf.withColumn("node", branch).groupBy(*by, "node")
             .agg(F.max("content").alias("content")))
    return own.join(below, [*by, "node"], "left").select(
        *by, "node", "m", F.greatest("style", F.coalesce("content", F.lit(0.0))).alias("importance"))


def _role(last: Column, holds_main: Column | None = None) -> Column:
    """Is a node clutter by its tag, or by its class and id words?  The words
    do not count for a wrapper that holds the main content."""
    tag, words = F.split_part(last, F.lit("."), F.lit(1)), F.split(last, r"\.")
    marked = F.arrays_overlap(F.slice(words, 2, 1000), F.array(*map(F.lit, sorted(CLUTTER_WORDS))))
    named = ~tag.isin("html", "body", *CONTENT_TAGS) & F.coalesce(marked, F.lit(False))
    return tag.isin(*CLUTTER_TAGS) | (named if holds_main is None else named & ~holds_main)


def main_holders(nodes: DataFrame) -> DataFrame:
    """(host, node): the wrappers that every article and main element of a
    host lies in."""
    last = F.split_part(F.element_at(F.split("node", "/"), -1), F.lit("."), F.lit(1))
    main = nodes.where(last.isin(*CONTENT_TAGS)).select("host", F.split("node", "/").alias("p"))
    above = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.array_join(F.slice("p", 1, i), "/"))
    held = (main.where(F.size("p") > 1).select("host", F.explode(above).alias("node"))
            .groupBy("host", "node").agg(F.count("*").alias("held")))
    return (held.join(main.groupBy("host").agg(F.count("*").alias("all")), "host")
            .where(F.col("held") == F.col("all")).select("host", "node", F.lit(True).alias("holds_main")))


def low_branches(pages: DataFrame) -> DataFrame:
    """(host, node) of the branches to cut."""
    counts = materialize(_observations(pages).groupBy("host", "node", "kind", "feature")
                         .agg(F.count_distinct("page").alias("n")), "style-counts")
    site = _importance(counts, ["host"])
    wide = _importance(counts.groupBy("node", "kind", "feature")
                       .agg(F.sum("n").alias("n")), [])
    wide = wide.select("node", F.col("m").alias("mw"), F.col("importance").alias("iw"))
    site = site.join(main_holders(site.select("host", "node")), ["host", "node"], "left")
    clutter = _role(F.element_at(F.split("node", "/"), -1), F.coalesce("holds_main", F.lit(False)))
    prior = F.when(clutter, 0.0).otherwise(1.0)
    general = (F.col("mw") * F.col("iw") + SHRINK * prior) / (F.col("mw") + SHRINK)
    score = (F.col("m") * F.col("importance") + SHRINK * general) / (F.col("m") + SHRINK)
    inside = F.col("node").rlike(INSIDE)
    return (site.join(wide, "node")
            .withColumn("score", F.when(clutter & ~inside, score * 0.25).otherwise(score))
            .where(F.col("score") < LEAST).select("host", "node"))


def main_text(page: str | None, cut: frozenset[str]) -> str:
    """Blocks outside the cut branches, joined by an empty line."""
    out, known = [], {}
    for path, text in blocks(page or ""):
        if text:
            if path not in known:
                known[path] = any("/".join(path[:i]) in cut for i in range(1, len(path) + 1))
            if not known[path]:
                out.append(text)
    return "\n\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    spark = pages.sparkSession
    low = materialize(low_branches(pages), "low-branches")
    size = low.agg(F.sum(F.length("host") + F.length("node"))).first()[0] or 0
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string"
    if size <= SMALL_BYTES:
        by_host: dict[str, set[str]] = {}
        for r in low.collect():
            by_host.setdefault(r["host"], set()).add(r["node"])
        held = spark.sparkContext.broadcast({h: frozenset(n) for h, n in by_host.items()})

        def lists(batch):
            return [held.value.get(host_of(u), frozenset()) for u in batch.column(1).to_pylist()]
    else:
        host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST_PATTERN, 1))
        by = low.groupBy("host").agg(F.collect_list("node").alias("cut"))
        rows = rows.withColumn("host", host).join(by, "host", "left").select("page_id", "url", "html", "cut")

        def lists(batch):
            return [frozenset(x or ()) for x in batch.column(3).to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(p, c) for p, c in zip(part.column(2).to_pylist(), lists(part))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())],
                                                 ["page_id", "url", "text"])

    return rows.mapInArrow(run, schema)
