"""Main text of web pages: markup tells sure boilerplate, and a suffix array over a host's page token streams tells the
runs that distinct pages repeat; what is covered goes, what is unique stays."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.graph import if_small
from rollbook.llm.hashing import Words, mix, slices
from rollbook.session import cut_lineage

# Elements that hold no text of a page; those that stand around its main text; those that begin a block.
SILENT = frozenset("script style noscript template svg math head title iframe object embed canvas audio video select datalist textarea button map".split())
CHROME = frozenset("nav header footer aside form menu dialog fieldset search".split())
MAIN = frozenset("article main".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|header|footer|sidebar|side|aside|widget|related|recommended|share|sharing|social|comment|comments|commentlist|disqus|reply|replies|respond|notice|notices|cookie|cookies|consent|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|search|pagination|pager|copyright|legal|disclaimer|skip|toolbar)(?:$|[\s_-])",
    re.I,
)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Elements whose content is not markup, so that only their own end tag ends them.
RAW = frozenset("script style iframe title textarea".split())
_BLOCK_START = re.compile(rf"<(?:{'|'.join(sorted(BLOCKS - {'option', 'optgroup', 'legend'}))})(?=[\s/>])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

#: A run of so many words that pages of different text on one host share is repeated; a block with PERCENT of its words in
#: such runs is boilerplate.
LEAST_RUN, PERCENT = 4, 80
#: Suffixes are dealt over so many slices at least, and over several slices for a host of more than so many pages.
SLICES, HOST_PAGES = 16, 2000


def _past(page: str, at: int, name: str) -> int:
    """The place behind a silent element that begins before `at`. One that may hold other elements and has no end tag of its own ends
    where the next block begins."""
    end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
    if end is not None and name in ("button", "select") and re.compile(rf"<{name}\b", re.I).search(page, at, end.start()):
        end = None  # these cannot hold one another: the end tag belongs to the next one
    if end is not None:
        return end.end()
    if name in RAW:
        return len(page)
    block = _BLOCK_START.search(page, at)
    return block.start() if block else len(page)


def _blocks(page: str) -> list[tuple[str, int]]:
    """(text, kind) of the blocks of a page in order; kind 2: inside article or main, 0: inside sure boilerplate, 1: neither."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # element, kind inside it
    kind, at = 1, 0

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, kind))
            parts.clear()

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCKS or name in MAIN:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    inner = stack[i:]
                    if any(x in BLOCKS for x, _ in inner):
                        close()
                    del stack[i:]
                    kind = stack[-1][1] if stack else 1
                    break
            continue
        if name == "head":  # what it may hold is silent by itself; its end tag may be left out
            continue
        if name in SILENT:
            if m[3].endswith("/") and name in ("svg", "math"):
                continue
            if name != "embed":
                at = _past(page, at, name)
            continue
        if name in BLOCKS:
            close()
            if stack and stack[-1][0] == "p" and name not in ("br", "hr"):
                stack.pop()
                kind = stack[-1][1] if stack else 1
        if name in VOID:
            continue
        inside = kind
        if name in CHROME:
            inside = 0
        elif name in MAIN and kind:
            inside = 2
        if m[3] and inside:
            for a in _ATTR.finditer(m[3]):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in CHROME_ROLES or key in ("class", "id") and CHROME_NAMES.search(value) and name not in ("html", "body", "article", "main"):
                    if name in ("html", "body"):
                        continue
                    inside = 0
                elif key == "role" and value.lower() in ("main", "article"):
                    inside = 2
        if not m[3].endswith("/"):
            if inside != kind and name not in BLOCKS:
                close()
            stack.append((name, inside))
            kind = inside
    close()
    return out


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _parsed(b: pa.RecordBatch) -> Iterator[tuple[list[tuple[str, int]], str, int]]:
    """(blocks outside sure boilerplate with their kind, host, digest of the blocks) of each page."""
    for page, host in zip(b.column("html").to_pylist(), b.column("host").to_pylist()):
        blocks = [x for x in (_blocks(page) if page else []) if x[1]]
        yield blocks, host, _number("\n".join(t for t, _ in blocks))


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page the blocks its text is chosen from, with their places among its blocks: those inside article or main, or all
    where it has none (not `marked`)."""
    for batch in batches:
        for b in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            marked, open_, place = [], [], []
            for blocks, _, _ in _parsed(b):
                inside = [n for n, (_, kind) in enumerate(blocks) if kind == 2]
                marked.append(bool(inside))
                place.append(inside or list(range(len(blocks))))
                open_.append([blocks[n][0] for n in place[-1]])
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("rid"), pa.array(marked, pa.bool_()), pa.array(open_, pa.list_(pa.string())), pa.array(place, pa.list_(pa.int32()))], ["page_id", "url", "rid", "marked", "open", "place"])


def _suffixes(slices_: int, parts_of: dict[str, int]):
    """The suffixes of the blocks of each page: 40 bits of the hash of host and first LEAST_RUN words, in the order of the words. Those of a host
    meet in one slice, those of a host in `parts_of` are dealt by their hash over so many, with the words at which they start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", rows=1024):
            pages_ = list(_parsed(b))
            count = np.array([len(blocks) for blocks, _, _ in pages_])
            words = Words(pa.array([t for blocks, _, _ in pages_ for t, _ in blocks], pa.string()), b" ")
            grams, whole = words.grams(LEAST_RUN)
            out = []
            for (blocks, host, digest), rid, end, n in zip(pages_, b.column("rid").to_pylist(), np.cumsum(count), count):
                at = words.first[end - n] + np.flatnonzero(whole[words.first[end - n] : words.first[end]])
                if not len(at):
                    continue
                home = _number(host) & ((1 << 63) - 1)
                key = mix(grams[at] ^ np.uint64(home))
                sizes = words.counts[end - n : end].astype(np.uint32)
                parts = parts_of.get(host, 1)
                for k in range(parts):
                    mine = key % np.uint64(parts) == k if parts > 1 else slice(None)
                    place = (at[mine] - words.first[end - n]).astype(np.uint16 if sizes.sum() < 1 << 16 else np.uint32).tobytes() if parts > 1 else None
                    out.append(((home + k) % slices_, rid, digest, key[mine].view(np.uint8).reshape(-1, 8)[:, 3:].tobytes(), place, None if k else sizes.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["slice", "rid", "digest", "heads", "places", "sizes"])

    return run


def _repeated(key, table):
    """The slice's part of the hosts' suffix arrays, down to LEAST_RUN words: neighbours with a common prefix so long are one run;
    it is repeated if pages of different text hold it. For each page the suffixes that begin such runs, and the sizes of its blocks."""
    packed = table.column("heads").to_pylist()
    count = np.array([len(x) // 5 for x in packed])
    heads = np.zeros((count.sum(), 8), np.uint8)
    heads[:, 3:] = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 5)
    heads = heads.view(np.uint64).ravel()
    suffix_array = np.argsort(heads, kind="stable")
    sorted_ = heads[suffix_array]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(heads) else np.zeros(0, np.int64)
    held = np.repeat(table.column("digest").to_numpy(), count)[suffix_array]
    common = np.zeros(len(heads), bool)
    if len(heads):
        common[suffix_array] = np.repeat(np.minimum.reduceat(held, first) != np.maximum.reduceat(held, first), np.diff(np.append(first, len(held))))
    rows = []
    for k, (end, n) in enumerate(zip(np.cumsum(count), count)):
        places, sizes = table.column("places")[k].as_py(), table.column("sizes")[k].as_py()
        at = _places(sizes) if places is None else np.frombuffer(places, np.uint16 if len(places) == 2 * n else np.uint32)
        at = at[common[end - n : end]]
        if len(at) or places is not None and sizes is not None:
            rows.append((table.column("rid")[k].as_py(), at.astype(np.uint32).tobytes(), sizes))
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["rid", "starts", "sizes"])


def _places(sizes: bytes) -> np.ndarray:
    """Where the suffixes of a page start, by the sizes of its blocks."""
    size = np.frombuffer(sizes, np.uint32).astype(np.int64)
    many = np.maximum(size - LEAST_RUN + 1, 0)
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.cumsum(size) - size, many)


def _going(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of the blocks of each page that repeated runs cover."""
    for b in batches:
        rows = []
        for rid, starts, sizes in zip(*(b.column(c).to_pylist() for c in ("rid", "starts", "sizes"))):
            size, at = np.frombuffer(sizes, np.uint32).astype(np.int64), np.frombuffer(b"".join(starts), np.uint32).astype(np.int64)
            covered = np.zeros(size.sum(), np.int64)
            for j in range(LEAST_RUN):
                covered[at + j] = 1
            goes = np.flatnonzero(100 * np.add.reduceat(covered, np.cumsum(size) - size) >= PERCENT * size)
            if len(goes):
                rows.append((rid, goes.tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["rid", "gone"])


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    Blocks inside article or main elements are the text, less what stands in navigation, headers, footers, asides, forms, or in
    elements named or marked as such; on a page without such elements, all blocks outside sure boilerplate. Of these a block goes
    if 80% of its words lie in runs of four words or more that pages of different text on its host share (in any block outside sure
    boilerplate). If all would go, all stay; inside article or main elements all stay if more than half of the words would go, as
    such a page is another version of a page. Character references are decoded, white space in a block is one space, blocks are joined by one line break.

    Null or empty html, or no text: empty text. Null url: such pages are one host. Pages of equal text count once, so that mirrors
    do not erase each other. Repeated rows each get their text. No rows: no rows. Other columns are ignored.

    Hosts are dealt over slices that grow with the parts the pages are read in, the suffixes of a host of many pages by their first words,
    so that no large host meets in one task; no text is shuffled for it. The driver holds one number for each such host."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    source = source.withColumn("rid", F.xxhash64("page_id", "url", "html")).withColumn("host", host)
    slices_ = max(SLICES, 8 * source.rdd.getNumPartitions())
    many = source.groupBy("host").count().where(F.col("count") > HOST_PAGES).collect()
    # parsed anew for each of two uses: that costs less than to keep the text of all pages
    parts_of = {r["host"]: min(slices_, -(-r["count"] // HOST_PAGES)) for r in many}
    found = source.mapInArrow(_suffixes(slices_, parts_of), "slice long, rid long, digest long, heads binary, places binary, sizes binary")
    runs = found.groupBy("slice").applyInArrow(_repeated, "rid long, starts binary, sizes binary")
    runs = runs.groupBy("rid").agg(F.collect_list("starts").alias("starts"), F.first("sizes", ignorenulls=True).alias("sizes"))
    gone = if_small(cut_lineage(runs.mapInArrow(_going, "rid long, gone array<int>")), "1 + size(gone)")
    told = source.mapInArrow(_told, "page_id long, url string, rid long, marked boolean, open array<string>, place array<int>").join(gone, "rid", "left")
    told = told.withColumn("stays", F.filter("open", lambda _, i: ~F.coalesce(F.array_contains("gone", F.col("place")[i]), F.lit(False))))
    words = lambda blocks: F.aggregate(blocks, F.lit(0), lambda n, b: n + F.size(F.split(b, " ")))
    enough = F.when(F.col("marked"), 2 * words(F.col("stays")) >= words(F.col("open"))).otherwise(F.size("stays") > 0)
    text = F.array_join(F.when(F.col("gone").isNull() | ~enough, F.col("open")).otherwise(F.col("stays")), "\n")
    return told.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
