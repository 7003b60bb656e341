"""Benchmark passages in documents, up to a budget of character edits: an item cut into budget + 1 pieces keeps one piece
whole under so few edits; exact piece hits propose places and Myers' bit-parallel distance decides them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.graph import if_small
from rollbook.llm.hashing import flat, slices, window_hashes
from rollbook.session import cut_lineage

#: One edit is allowed for so many bytes of an item.
BYTES_PER_EDIT = 16
#: Shorter items (normalised bytes) are matched whole, without edits.
GRAM = 12
#: Items are matched in blocks of so many at a time: the tables one task holds at once.
BLOCK = 4096


def normal_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased and each run of white space as one space, none at the ends of a row, and the rows' borders."""
    data, borders = flat(texts)
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[9:14] = 32
    data = table[data]
    space = data == 32
    kept = ~space
    kept[1:] |= ~space[:-1]  # a space right after a word stays
    at = borders[:-1][np.diff(borders) > 0]
    kept[at] = ~space[at]
    total = np.concatenate([[0], np.cumsum(kept)])
    data, borders = data[kept], total[borders]
    last = np.unique(borders[1:][np.diff(borders) > 0]) - 1  # a space left at a row's end
    drop = last[data[last] == 32]
    gone = np.zeros(len(data) + 1, np.int64)
    gone[drop + 1] = 1
    return np.delete(data, drop), borders - np.cumsum(gone)[borders]


def budget(length: int) -> int:
    """Edits allowed: one for 16 bytes, fewer where a piece would get shorter than GRAM."""
    return max(0, min(length // BYTES_PER_EDIT, length // GRAM - 1))


def myers(pattern: bytes, text: bytes) -> tuple[int, int]:
    """(fewest edits between the pattern and any substring of text, the first end of such a substring)."""
    m = len(pattern)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & mask, ph & xv & mask
        if score < best:
            best, end = score, j + 1
    return best, end


class _Index:
    """Pieces of items by the hash of their first GRAM bytes, behind a bitmap of 2^20 bits."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = items
        grams, owner, offset, size = [], [], [], []
        for k, (_, text) in enumerate(items):
            parts = budget(len(text)) + 1
            cuts = [len(text) * i // parts for i in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:]):
                grams.append(text[a : a + GRAM])
                owner.append(k)
                offset.append(a)
                size.append(b - a)
        self.short = [(k, t) for k, (_, t) in enumerate(items) if len(t) < GRAM]
        long = [i for i, g in enumerate(grams) if len(g) == GRAM and size[i] >= GRAM]
        owner, offset, size = (np.array(x, np.int64)[long] for x in (owner, offset, size)) if long else (np.zeros(0, np.int64),) * 3
        data = np.frombuffer(b"".join(grams[i] for i in long), np.uint8)
        h = window_hashes(data, GRAM)[::GRAM] if long else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.owner, self.offset, self.size = h[order], owner[order], offset[order], size[order]
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[h >> np.uint64(44)] = True


def _search(blocks: list[list[tuple[int, bytes]]]):
    made: list[_Index] = []

    def places(index: _Index, data: np.ndarray, borders: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, supposed start) of every exact piece hit, one for each run of neighbouring starts."""
        at = np.flatnonzero(index.bitmap[h >> np.uint64(44)])
        lo, hi = np.searchsorted(index.hash, h[at], "left"), np.searchsorted(index.hash, h[at], "right")
        at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        piece = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = np.repeat(at, n)
        row = np.searchsorted(borders, at, "right") - 1
        inside = at + index.size[piece] <= borders[row + 1]
        at, row, piece = at[inside], row[inside], piece[inside]
        item = index.owner[piece]
        start = at - index.offset[piece]
        exact = np.fromiter((index.items[k][1][o : o + s] == data[a : a + s].tobytes() for a, k, o, s in zip(at, item, index.offset[piece], index.size[piece])), bool, len(at))
        order = np.lexsort((start[exact], item[exact], row[exact]))
        row, item, start = row[exact][order], item[exact][order], start[exact][order]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > 0)
        return zip(row[fresh].tolist(), item[fresh].tolist(), start[fresh].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.extend(_Index(b) for b in blocks)
        for b in slices(batches, "text"):
            data, borders = normal_bytes(b.column("text"))
            h = window_hashes(data, GRAM)
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for index in made:
                for row, k, start in places(index, data, borders, h):
                    item, text = index.items[k]
                    most = budget(len(text))
                    known = best.get((row, item))
                    if known and (known[0] == 0 or abs(known[1] - (start - borders[row])) <= most):
                        continue
                    a, z = max(start - most, borders[row]), min(start + len(text) + most, borders[row + 1])
                    edits, end = myers(text, data[a:z].tobytes())
                    if edits <= most and (not known or edits < known[0]):
                        best[row, item] = (edits, int(start - borders[row]), int(a + end - borders[row]))
                for k, text in index.short:
                    for row in range(b.num_rows) if text else ():
                        spot = data[borders[row] : borders[row + 1]].tobytes().find(text)
                        if spot >= 0:
                            best[row, index.items[k][0]] = (0, spot, spot + len(text))
            rows = sorted(best)
            ids = b.column("doc_id").take(pa.array([r for r, _ in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([k for _, k in rows], pa.int64()), pa.array([best[r][0] for r in rows], pa.int64()), pa.array([max(0, best[r][1]) for r in rows], pa.int64()), pa.array([best[r][2] for r in rows], pa.int64())],
                ["doc_id", "item_id", "edits", "start", "end"],
            )

    return run


def leaks(docs: DataFrame, items: DataFrame, max_item_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, item_id, edits, start, end) for every row of docs (doc_id, text) and item of items (item_id, text) such that a
    passage of the document is within `budget(len)` edits of the item. Text is compared as UTF-8 bytes, A-Z lower-cased, runs of
    white space as one space. edits are those of the best passage looked at, start its supposed start and end its
    end, in those bytes.

    The items are the side that is held in memory: their total size is measured first, and beyond `max_item_bytes` the call
    fails rather than broadcasts. Null or blank items match nothing, nor do null or empty documents; rows that share a doc_id
    (or have none) are judged one by one; equal items each report. Other columns are ignored."""
    wanted = items.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).where("text RLIKE '\\\\S' AND item_id IS NOT NULL")
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > max_item_bytes:
        raise ValueError(f"items hold {size} bytes; split them into calls of at most {max_item_bytes}")
    listed = wanted.distinct().orderBy("item_id", "text").collect()
    data, borders = normal_bytes(pa.array([r["text"] for r in listed], pa.string()))
    plain = [(r["item_id"], data[borders[i] : borders[i + 1]].tobytes()) for i, r in enumerate(listed)]
    plain = [x for x in plain if x[1]]
    blocks = [plain[i : i + BLOCK] for i in range(0, len(plain), BLOCK)]
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_search(blocks), "doc_id long, item_id long, edits long, start long, end long")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id has a leak (rows of null doc_id are judged by text, since no id names them)."""
    found = leaks(docs, items).select("doc_id").distinct()
    named = docs.join(if_small(cut_lineage(found.where("doc_id IS NOT NULL"))), "doc_id", "left_anti").where("doc_id IS NOT NULL")
    nameless = docs.where("doc_id IS NULL").withColumn("doc_id", F.xxhash64("text"))
    bad = leaks(nameless, items).select("doc_id").distinct()
    return named.unionByName(nameless.join(bad, "doc_id", "left_anti").withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)).select(*named.columns))
