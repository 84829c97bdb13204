"""Main text of web pages by nearest-URL page differencing.

A page is read into lines (the texts of its blocks).  Pages are ordered by host
and URL path, and each is paired with that neighbour of the same host whose
path shares the longer beginning.  Their lines are aligned by a longest common
subsequence, and a page's shared lines are deleted wherever they stand, for
pages of one site share their frames.  Unshared lines stay, also beside an
article or main element.  Where shared lines are most of the text in such
elements, or most of all text on a page without one, the pair are near copies,
and those lines stay; beside an element shared lines are deleted even then.
Blocks that say what they are (nav, footer, class="ad" and
the like) take part in the alignment and never in the text.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import discard, durable
from millrace.llm.ordering import range_of, ranges

# Names of HTML elements.
_BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = set("area base basefont br col embed frame hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes".split())
_DROP = set("nav footer aside form script style noscript template iframe button select textarea dialog menu svg canvas object audio video title head noembed noframes".split())
# Names in class, id and role that name a page's frame.
_FRAME_WORDS = set(
    "ad ads adv advert advertisement advertising banner banners breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer "
    "disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related respond search share sharing "
    "sidebar social sponsor sponsored subscribe toolbar widget".split()
)
# Those of them that name it also at the front of a longer name, as in ad-slot.
_FRAME_FRONTS = set("ad ads advert comments cookie disqus footer navbar sidebar".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

FRAME, OUTSIDE, INSIDE = 0, 1, 2


def _names_frame(name: str, inside: bool) -> bool:
    """Whether one name of a class, id or role is a frame's: the name itself, the last word of it (site-footer), or a plain front (ad-slot)."""
    words = _NAME.findall(name)
    if not words or (inside and words[-1] == "header"):
        return False
    return words[-1] in _FRAME_WORDS or words[0] in _FRAME_FRONTS


def _is_frame(tag: str, attrs: str, inside: bool) -> bool:
    if tag in _DROP or (tag == "header" and not inside):
        return True
    for name, *values in _ATTR.findall(attrs):
        value = "".join(values).lower()
        if name.lower() in ("class", "id", "role") and any(_names_frame(x, inside) for x in value.split()):
            return True
        if name.lower() == "hidden" or (name.lower() == "aria-hidden" and value == "true"):
            return True
    return False


def page_lines(page: str) -> list[tuple[int, str]]:
    """(kind, text) of a page's lines: FRAME, OUTSIDE or INSIDE an article or main element; the whole page is read."""
    lines: list[tuple[int, str]] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, in the frame, inside

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
        buffer.clear()
        if text:
            _, frame, inside = stack[-1] if stack else ("", False, False)
            lines.append((FRAME if frame else INSIDE if inside else OUTSIDE, text))

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            buffer.append(page[at:])
            break
        buffer.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[4]:
            continue
        if m[1]:
            if any(e[0] == tag for e in stack):
                if tag in _BLOCK or stack[-1][1]:
                    flush()
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in _BLOCK:
            flush()
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and any(e[0] == tag for e in stack[-4:]):
            while stack.pop()[0] != tag:
                pass
        if tag in _VOID or m[3].rstrip().endswith("/"):
            continue
        _, frame, inside = stack[-1] if stack else ("", False, False)
        becomes = frame or _is_frame(tag, m[3], inside)
        if becomes and not frame:
            flush()
        stack.append((tag, becomes, inside or tag in ("article", "main") or "articlebody" in m[3].lower()))
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            if tag in ("script", "style"):
                at = end.start() if end else len(page)
            else:
                buffer.append(page[at : end.start() if end else len(page)])
                at = end.start() if end else len(page)
    flush()
    return lines


def shared_lines(own: list[int], other: list[int]) -> set[int]:
    """Positions in own of a longest common subsequence with other, through the longest rising run of matches."""
    places: dict[int, list[int]] = {}
    for j, h in enumerate(other):
        places.setdefault(h, []).append(j)
    ends: list[int] = []
    links: list[tuple | None] = []
    for i, h in enumerate(own):
        for j in reversed(places.get(h, ())):
            k = bisect.bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k] = j
                links[k] = link
    found, link = set(), links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def main_text(kinds: list[int], texts: list[str], hashes: list[int], near: list[int]) -> str:
    """The page's text after its lines were compared with those of its nearest page (none: an empty list)."""
    shared = shared_lines(hashes, near)
    inside = [i for i, k in enumerate(kinds) if k == INSIDE]
    # the lines that tell a near copy: those of the element, or all on a page without one
    body = inside or [i for i, k in enumerate(kinds) if k == OUTSIDE]
    if 2 * sum(len(texts[i]) for i in body if i not in shared) < sum(len(texts[i]) for i in body):
        shared -= set(body)
    return " ".join(t for i, (k, t) in enumerate(zip(kinds, texts, strict=True)) if k != FRAME and i not in shared)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "key", "kinds", "texts", "hashes"]
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            kinds, texts, hashes = [], [], []
            for page in part.column("html").to_pylist():
                lines = page_lines(page or "")
                kinds.append(bytes(k for k, _ in lines))
                texts.append([t if k else "" for k, t in lines])
                hashes.append([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - 2**63 for _, t in lines])
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), part.column("key"), pa.array(kinds, pa.binary()), pa.array(texts, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64()))], names
            )


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and key; each row of its own bucket meets the rows before and after it."""
    prev = row = None
    out: list[tuple] = []

    def rows() -> Iterator[dict | None]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                yield from batch.slice(start, 64).to_pylist()
        yield None

    def done(before: dict | None, this: dict, after: dict | None) -> None:
        host = this["key"].partition("\x01")[0]
        near = [n for n in (before, after) if n and n["bucket"] == this["bucket"] and n["key"].partition("\x01")[0] == host]
        place = this["key"].partition("\x02")[0]
        best = max(near, key=lambda n: _common(n["key"].partition("\x02")[0], place), default=None)
        text = main_text(list(this["kinds"]), this["texts"], this["hashes"], best["hashes"] if best else [])
        out.append((this["page_id"], this["url"], text))

    def batch() -> pa.RecordBatch:
        a, b, c = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.string())], ["page_id", "url", "text"])

    for nxt in rows():
        if row and not row["guest"]:
            done(prev, row, nxt)
        prev, row = row, nxt
        if len(out) >= 500:
            yield batch()
    if out:
        yield batch()


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of pages (page_id long, url, html).

    A null or empty html gives an empty text; a null url counts as empty.  Rows
    that repeat are each other's neighbours and each keep their text.  Extra
    columns are ignored.  An empty table gives an empty result.
    """
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[^/?#]*://)?([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:[^/?#]*://)?[^/?#]*/?([^?#]*)", 1), r"(\.html)?/*$", "")
    # what orders pages: scheme, query, fragment and the path's last slash or .html don't count
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.concat(host, F.lit("\x01"), path, F.lit("\x02"), F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0")).alias("key"), "html")
    # bounds of ranges of the order, from the keys alone; pages of one url are parted by their ids
    n = ranges(pages)
    keys = durable(keyed.select("key").repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()), "urls")
    bounds = sorted({r["k"] for r in keys.groupBy("part").agg(F.min("key").alias("k")).collect()})
    bucket = range_of(F.col("key"), bounds, "string")
    edges = keys.withColumn("bucket", bucket).groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()
    discard(keys)
    ends = {r["bucket"]: (r["low"], r["high"]) for r in edges}
    order = sorted(ends)
    lows = {ends[b][0]: a for a, b in zip(order, order[1:], strict=False)}
    highs = {ends[a][1]: b for a, b in zip(order, order[1:], strict=False)}

    def target(of: dict[str, int]):
        if not of:
            return F.lit(None).cast("int")
        return F.try_element_at(F.map_from_arrays(F.lit(list(of)), F.lit(list(of.values()))), F.col("key")).cast("int")

    place = lambda b, g: F.struct(b.alias("b"), F.lit(g).alias("g"))
    places = F.filter(F.array(place(F.col("bucket"), False), place(target(lows), True), place(target(highs), True)), lambda p: p["b"].isNotNull())
    read = keyed.mapInArrow(_read, "page_id long, url string, key string, kinds binary, texts array<string>, hashes array<long>")
    dealt = read.withColumn("bucket", bucket).withColumn("place", F.explode(places)).withColumn("bucket", F.col("place.b")).withColumn("guest", F.col("place.g")).drop("place")
    dealt = dealt.withColumn("texts", F.when(F.col("guest"), F.array().cast("array<string>")).otherwise(F.col("texts")))
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "key", "page_id", F.hash("hashes"))
    return dealt.mapInArrow(_compare, "page_id long, url string, text string")
