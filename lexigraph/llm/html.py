"""Main text of web pages, with boilerplate found by a suffix array per host.

A page is cut into blocks. Blocks in menus, headers, footers and the like go
for their markup. Where a page marks its article, that is the text unless its host
repeats it. All other blocks are judged by their host: the token streams of the
host's pages are concatenated, a suffix array brings equal substrings together, and
tokens that lie in a long substring standing on enough pages are covered. A block
that is mostly covered is boilerplate; unique runs stay. Two pages are enough
outside articles. Articles may quote each other, so a block of one goes only where
half of the host's different articles, and five of them, hold it.

The array is built by prefix doubling up to the depth of a long substring, so it
costs a few sorts of the stream. A host with too many tokens for one task is
not taken into one: its substrings of that length are grouped by hash over all
tasks, which marks the same tokens.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigraph.llm.common import each, materialize

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*display\s*:\s*none|'[^']*display\s*:\s*none))", re.I)
BLANK = re.compile(r"\s+")

# Fixed values of HTML: what ends a block, has no end tag, holds raw text, is never main text.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea xmp noembed noframes iframe".split())
NOT_TEXT = frozenset("head title script style template noscript svg math canvas audio video object iframe noembed noframes".split())
BOILERPLATE = frozenset("nav aside footer form menu dialog button select textarea input".split())
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices popup modal newsletter subscribe comment comments respond "
    "disqus social share sharing related recommended widget pagination pager skip-link copyright complementary contentinfo".split()
)
# Names that say what the page around an element is like, not what the element is.
STATES = frozenset("has no with without is show hide".split())
ARTICLE = frozenset(["article", "main"])
# An end tag of these closes what is open inside them; an open p ends at the next block.
ENDS_P = BLOCKS - frozenset(["br", "html", "body", "head", "title", "option", "optgroup"])


def _names(attributes: str) -> bool:
    """Whether class, id or role names boilerplate, as a whole or by its last part that is not a number."""
    for match in NAMES.finditer(attributes):
        value = (match[1] or match[2] or match[3] or "").lower()
        for name in value.split():
            parts = [part for part in re.split(r"[-_]+", name) if part and not part.isdigit()] or [""]
            if name in NAMED or (parts[-1] in NAMED and parts[0] not in STATES):
                return True
    return False


def blocks(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, boilerplate by markup, inside an article) of every block with text, in page order.

    A name on an element around an article says little about the article: it
    counts only where the page has article blocks outside such elements.
    """
    out: list[tuple[str, bool, bool, bool]] = []
    if not page:
        return out
    open_tags: list[tuple[str, int, bool, bool, bool]] = []  # name, not text, boilerplate, article, name around it: as they hold inside
    silent, bad, inside, doubt = 0, False, False, False
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = BLANK.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((text, bad, inside, doubt))

    at, end = 0, len(page)
    while at < end:
        match = TAG.search(page, at)
        if match is None:
            if not silent:
                parts.append(page[at:])
            break
        if match.start() > at and not silent:
            parts.append(page[at : match.start()])
        at = match.end()
        name = match[2] or match[5]
        if name is None:
            if not silent and match[0].startswith("<![CDATA["):
                parts.append(html.escape(match[0][9:].removesuffix("]]>"), quote=False))
            continue
        name, closing = name.lower(), bool(match[1] or match[4])
        attributes = match[3] if match[2] else match[6]
        if name in BLOCKS or name in BOILERPLATE or name in NOT_TEXT:
            flush()
        if closing:
            if any(t[0] == name for t in open_tags):
                while open_tags.pop()[0] != name:
                    pass
        elif name not in VOID and not (attributes or "").endswith("/"):
            if name in ENDS_P and open_tags and any(t[0] == "p" for t in open_tags):
                # an unclosed p, and the inline tags left open in it, end here
                while open_tags.pop()[0] != "p":
                    pass
                silent, bad, inside, doubt = open_tags[-1][1:] if open_tags else (0, False, False, False)
            named = bool(attributes) and name not in ("html", "body", "article", "main") and _names(attributes)
            hidden = bool(attributes) and name not in ("html", "body", "article", "main") and bool(HIDDEN.search(attributes))
            article = inside or name in ARTICLE
            odd = bad or name in BOILERPLATE or (name == "header" and not inside) or hidden or (named and inside)
            open_tags.append((name, silent or int(name in NOT_TEXT), odd, article, doubt or (named and not inside)))
            if name in RAW:
                stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = stop.start() if stop else end
        silent, bad, inside, doubt = open_tags[-1][1:] if open_tags else (0, False, False, False)
    flush()
    sure = any(inside and not bad and not doubt for _, bad, inside, doubt in out)
    return [(text, bad or (doubt and (sure or not inside)), inside) for text, bad, inside, doubt in out]


def choose(found: list[tuple[str, bool, bool]], covered: frozenset[int] = frozenset()) -> str:
    """Main text: the article's blocks where there are any, else all blocks; without those that markup or host call boilerplate."""
    plain = [(i, text, inside) for i, (text, bad, inside) in enumerate(found) if not bad]
    if any(inside for _, _, inside in plain):
        article = [(i, text) for i, text, inside in plain if inside]
        own = [text for i, text in article if i not in covered]
        return "\n".join(own or [text for _, text in article])  # an article that is all repeats stays
    return "\n".join(text for i, text, _ in plain if i not in covered)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


# -- suffix array ----------------------------------------------------------------------


def covered_tokens(tokens: np.ndarray, pages: np.ndarray, depth: int, least: int = 2) -> np.ndarray:
    """Which tokens lie in a substring of ``depth`` tokens that stands on ``least`` pages or more; ``pages`` must not fall.

    Prefix doubling: ranks of substrings of length 1, 2, 4, ... are sorted
    pairwise until they tell substrings of ``depth`` tokens apart. Every page
    ends with a token of its own, so no substring crosses pages.
    """
    n = len(tokens)
    out = np.zeros(n, dtype=bool)
    if n < depth:
        return out
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    length = 1
    while length < depth:
        step = min(length, depth - length)
        shifted = np.full(n, -1, dtype=np.int64)
        shifted[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + shifted + 1, return_inverse=True)[1].astype(np.int64)
        length += step
    suffixes = np.argsort(rank, kind="stable")  # equal substrings side by side, in page order
    same = rank[suffixes][1:] == rank[suffixes][:-1]
    groups = np.concatenate([[0], np.cumsum(~same)])
    fresh = np.concatenate([[True], ~same | (pages[suffixes][1:] != pages[suffixes][:-1])])  # a page not met before in its group
    repeated = (np.bincount(groups, weights=fresh) >= least)[groups]
    starts = np.zeros(n + 1, dtype=np.int64)
    hits = suffixes[repeated]
    hits = hits[hits + depth <= n]
    np.add.at(starts, hits, 1)
    np.add.at(starts, np.minimum(hits + depth, n), -1)
    return np.cumsum(starts[:n]) > 0


def _words(text: str) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(w) >> 33 for w in text.encode("utf-8", "surrogatepass").split()]


# Different articles of a host that must hold a block of an article, at least and as a share, before it is boilerplate.
LEAST_ARTICLES = 5
ARTICLE_SHARE = 0.5


def _needed(marked, bodies):
    """Pages that make a substring a repeat, from whether they are articles and how many different ones the host has (columns)."""
    return F.when(marked, F.greatest(F.lit(LEAST_ARTICLES), F.ceil(bodies * ARTICLE_SHARE))).otherwise(2).cast("long")


def _streams(pages: DataFrame) -> DataFrame:
    """(host, page, marked, numbers, sizes, tokens, body) of the blocks that markup leaves: a marked article's, else all not boilerplate.

    Pages of equal ``body`` count as one: those of equal tokens, and articles whose
    longest block is equal, so that near copies do not make each other boilerplate.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keep, marks, sizes, numbers, tokens, bodies = [], [], [], [], [], []
            for i, page in enumerate(each(batch.column("html"))):
                found = blocks(page)
                marked = any(inside and not bad for _, bad, inside in found)
                open_blocks = [(n, _words(text)) for n, (text, bad, inside) in enumerate(found) if not bad and (inside or not marked)]
                if open_blocks:
                    keep.append(i)
                    marks.append(marked)
                    numbers.append([n for n, _ in open_blocks])
                    sizes.append([len(w) for _, w in open_blocks])
                    tokens.append([t for _, w in open_blocks for t in w])
                    told = max((w for _, w in open_blocks), key=len) if marked else tokens[-1]
                    bodies.append(xxhash.xxh3_64_intdigest(np.asarray(told, dtype=np.int32).tobytes()) >> 1)
            at = pa.array(keep, pa.int32())
            many = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("host").take(at), batch.column("page").take(at), pa.array(marks, pa.bool_()), pa.array(numbers, many),
                 pa.array(sizes, many), pa.array(tokens, many), pa.array(bodies, pa.int64())],
                ["host", "page", "marked", "numbers", "sizes", "tokens", "body"],
            )

    shape = "host string, page long, marked boolean, numbers array<int>, sizes array<int>, tokens array<int>, body long"
    return pages.mapInArrow(read, shape)


def _mostly(marks: np.ndarray, sizes: list[int], numbers: list[int], share: float) -> list[int]:
    ends = np.cumsum([0] + sizes)
    return [n for n, a, b in zip(numbers, ends, ends[1:]) if b > a and marks[a:b].mean() >= share]


def _by_suffix_array(streams: DataFrame, depth: int, share: float) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("body", "ascending"), ("page", "ascending")])
        names, bodies = table.column("page").to_pylist(), table.column("body").to_pylist()
        lists = [np.asarray(x, dtype=np.int64) for x in table.column("tokens").to_pylist()]
        order = {b: i for i, b in enumerate(dict.fromkeys(bodies))}
        flat, pages = [], []
        for i, (body, mine) in enumerate(zip(bodies, lists)):
            flat += [mine, np.array([-1 - i])]
            pages.append(np.full(len(mine) + 1, order[body]))
        marks = covered_tokens(np.concatenate(flat), np.concatenate(pages), depth, table.column("needed")[0].as_py())
        out, at = [], 0
        for mine, sizes, numbers in zip(lists, table.column("sizes").to_pylist(), table.column("numbers").to_pylist()):
            out.append(_mostly(marks[at : at + len(mine)], sizes, numbers, share))
            at += len(mine) + 1
        return pa.table({"page": pa.array(names, pa.int64()), "covered": pa.array(out, pa.list_(pa.int64()))})

    return streams.groupBy("host", "marked").applyInArrow(run, "page long, covered array<long>")


SLOTS = 4096


def _by_hash(streams: DataFrame, depth: int, share: float) -> DataFrame:
    """The same marks for hosts too large for a task: substrings of ``depth`` tokens grouped by hash over all tasks.

    First the pages are counted by slot of the hash, combined per task. A slot that
    fewer pages have than a repeat needs holds no repeat, so its substrings do not
    move; what is left is counted by the whole hash and by different pages.
    """
    long = streams.filter(F.size("tokens") >= depth)
    grams = f"transform(sequence(0, size(tokens) - {depth}), i -> xxhash64(slice(tokens, i + 1, {depth})))"
    met = long.select("host", "marked", "needed", F.explode(F.expr(f"array_distinct(transform({grams}, h -> pmod(h, {SLOTS})))")).alias("slot"))
    full = met.groupBy("host", "marked", "needed", "slot").agg(F.count(F.lit(1)).alias("n")).filter("n >= needed")
    full = materialize(full.select("host", "marked", "slot"), "full-slots")
    grams = long.select("host", "marked", "needed", "page", "body", F.posexplode(F.expr(grams)).alias("at", "gram"))
    grams = grams.withColumn("slot", F.expr(f"pmod(gram, {SLOTS})")).join(full, ["host", "marked", "slot"]).drop("slot")
    held = grams.select("host", "marked", "needed", "gram", "body").distinct().groupBy("host", "marked", "needed", "gram").agg(F.count(F.lit(1)).alias("n"))
    repeated = held.filter("n >= needed").select("host", "marked", "gram")
    marked = grams.join(repeated, ["host", "marked", "gram"]).groupBy("host", "page").agg(F.collect_set("at").alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for starts, sizes, numbers in zip(*[batch.column(c).to_pylist() for c in ("starts", "sizes", "numbers")]):
                marks = np.zeros(sum(sizes), dtype=bool)
                for a in starts:
                    marks[a : a + depth] = True
                out.append(_mostly(marks, sizes, numbers, share))
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(out, pa.list_(pa.int64()))], ["page", "covered"])

    joined = streams.select("host", "page", "numbers", "sizes").join(marked, ["host", "page"])
    return joined.select("page", "starts", "sizes", "numbers").mapInArrow(run, "page long, covered array<long>")


def boilerplate(pages: DataFrame, depth: int = 8, share: float = 0.8, most_tokens: int = 4_000_000) -> DataFrame:
    """(page, covered): numbers of the blocks that the host repeats; only pages with such blocks have rows.

    ``pages`` has host, page (a hash of url and html) and html. Hosts of at most
    ``most_tokens`` tokens get a suffix array each, larger ones the hash route.
    Pages of equal tokens count as one, whatever their addresses.
    """
    streams = materialize(_streams(pages), "page-streams")
    totals = streams.groupBy("host", "marked").agg(
        F.sum(F.size("tokens")).alias("total"), F.count(F.lit(1)).alias("pages"), F.count_distinct("body").alias("bodies")
    )
    totals = totals.withColumn("needed", _needed(F.col("marked"), F.col("bodies"))).withColumn("large", F.col("total") + F.col("pages") > most_tokens)
    # hosts with too few different pages for any repeat have nothing to judge
    hosts = materialize(totals.filter("bodies >= needed").select("host", "marked", "needed", "large"), "hosts")
    judged = streams.join(hosts, ["host", "marked"])
    parts = [_by_suffix_array(judged.filter("not large"), depth, share)]
    if not hosts.filter("large").isEmpty():
        parts.append(_by_hash(judged.filter("large"), depth, share))
    found = reduce(DataFrame.unionAll, parts).filter(F.size("covered") > 0)
    return found.groupBy("page").agg(F.array_distinct(F.flatten(F.collect_set("covered"))).alias("covered"))


def extract(pages: DataFrame, depth: int = 8, share: float = 0.8, most_tokens: int = 4_000_000) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    ``pages`` needs page_id, url and html; other columns are ignored. A null or
    empty html gives an empty text, a null url is a host of its own. Pages of a
    host with equal tokens are one page, so they do not make each other
    boilerplate; near copies still do outside marked articles. An empty table gives no rows.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    keyed = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("page"), host_of(F.col("url")).alias("host"))
    found = materialize(boilerplate(keyed.select("host", "page", "html"), depth, share, most_tokens), "page-boilerplate")
    judged = keyed.drop("host").join(found, "page", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                choose(blocks(page), frozenset(covered or ()))
                for page, covered in zip(each(batch.column("html")), batch.column("covered").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    columns = judged.select("page_id", "url", "html", "covered")
    return columns.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
