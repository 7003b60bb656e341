"""Packing tokenised documents into sequences: sure placements by Martello-Toth dominance, best fit for the rest.

Lengths are whole numbers up to the capacity, so the packing is solved on a histogram of at most `capacity` lengths, however
many documents there are, and comes out as patterns with repeat counts. Pieces then find their place by their rank
among the pieces of equal length."""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.hashing import Words, slices
from rollbook.session import cut_lineage

#: Distinct words whose ids a worker remembers; when full, the memory starts afresh.
REMEMBERED = 1_200_000


class _Ids:
    """Ids of whole texts. White space always separates tokens of this kind of tokenizer, so that every distinct
    white-space word is encoded once and texts are put together from words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.separator,) = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.slot = np.zeros(0, np.int64)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def learn(self, words: Words, hashes: np.ndarray) -> None:
        new, at = np.unique(hashes, return_index=True)
        if len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, new), len(self.hashes) - 1)
            unknown = self.hashes[place] != new
            new, at = new[unknown], at[unknown]
        if not len(new):
            return
        if len(self.hashes) + len(new) > REMEMBERED and len(self.hashes):
            self.clear()
            return self.learn(words, hashes)
        raw = words.data.tobytes()
        found = [raw[a:b].decode() for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist())]
        # many words to a call, told apart by a separator of one id; words that hold its sign go alone
        own = np.array(["|" in w for w in found])
        together = [w for w in found if "|" not in w]
        told = [np.array([self.separator], np.uint32)]  # every word's ids end with the sign's
        for i in range(0, len(together), 256):
            ids = self.tokenizer.encode(" | ".join(together[i : i + 256]), add_special_tokens=False).ids
            told += [np.array(ids, np.uint32), told[0]]
        ids = np.concatenate(told[1:]) if together else np.zeros(0, np.uint32)
        sizes = np.diff(np.flatnonzero(ids == self.separator), prepend=-1) - 1
        lone = [np.array(self.tokenizer.encode(found[i], add_special_tokens=False).ids, np.uint32) for i in np.flatnonzero(own)]
        sizes = np.concatenate([sizes, [len(x) for x in lone]]).astype(np.int64)
        new = np.concatenate([new[~own], new[own]])
        slots = np.arange(len(sizes)) + len(self.first) - 1
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids[ids != self.separator], *lone])
        order = np.argsort(merged := np.concatenate([self.hashes, new]), kind="stable")
        self.hashes, self.slot = merged[order], np.concatenate([self.slot, slots])[order]

    @staticmethod
    def _split_stops(words: Words) -> None:
        """A comma or stop between an ASCII letter and white space is a token of its own: as a word of its own it leaves fewer
        distinct words."""
        data, starts, ends = words.data, words.starts, words.ends
        last, before = data[ends - 1], data[np.maximum(ends - 2, 0)] | 32
        stop = (ends - starts > 1) & ((last == 44) | (last == 46)) & (before >= 97) & (before <= 122)
        n = 1 + stop
        second = np.cumsum(n)[stop] - 1
        words.starts, words.ends, words.doc = np.repeat(starts, n), np.repeat(ends, n), np.repeat(words.doc, n)
        words.starts[second] = words.ends[second] - 1
        words.ends[second - 1] -= 1
        words.first = np.searchsorted(words.doc, np.arange(len(words.counts) + 1))
        words.counts = np.diff(words.first)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows end to end, each row closed by id 0; n + 1 borders)"""
        words = Words(texts)
        self._split_stops(words)
        h = words.hashes()
        self.learn(words, h)
        slot = self.slot[np.searchsorted(self.hashes, h)] if len(h) else np.zeros(0, np.int64)
        size = self.first[slot + 1] - self.first[slot]
        total = np.concatenate([[0], np.cumsum(size)])
        first = total[words.first] + np.arange(len(words.first))
        out = np.zeros(first[-1], np.uint32)
        source = np.repeat(self.first[slot] - total[:-1], size) + np.arange(total[-1])
        out[np.arange(total[-1]) + np.repeat(words.doc, size)] = self.ids[source]
        return out, first


@functools.lru_cache(2)
def _learned(path: str) -> _Ids:
    """The words of a tokenizer file that this worker has met; Spark's workers take one task after another and keep them."""
    return _Ids(path)


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _learned(path)
        for b in slices(batches, "text", 1 << 20):
            ids, first = known.encode(b.column("text"))
            size = np.diff(first)
            n = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, size[row] - start)
            little = ids.astype("<u4", copy=False)
            crc = [zlib.crc32(little[a : a + m]) for a, m in zip(first[row] + start, length)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def dominance(count: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(patterns with repeat counts that some best packing holds, lengths left over).

    From the longest length down, with room r beside it: alone if nothing fits; with a length of exactly r; with the longest
    length that fits, if no two others fit, or if no three do and no two that fit together exceed it. Each dominates every other
    set that could share the sequence: its parts can be swapped, group by group, for what the set holds."""
    left = {k: v for k, v in count.items() if v > 0}
    keys = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(items: tuple[int, ...]) -> None:
        need = {x: items.count(x) for x in items}
        n = min(left[x] // k for x, k in need.items())
        fixed.append((items, n))
        for x, k in need.items():
            left[x] -= n * k
            if not left[x]:
                del left[x], keys[bisect_left(keys, x)]

    for size in sorted(left, reverse=True):
        while left.get(size):
            room = capacity - size
            small = []  # the three smallest others
            for k in keys[:4]:
                small += [k] * min(3, left[k] - (k == size))
            small = small[:3]
            if not small or small[0] > room:
                take((size,))
                continue
            others = [k for k in keys[max(0, bisect_right(keys, room) - 2) : bisect_right(keys, room)] if left[k] > (k == size)]
            best = others[-1]
            if best == room or len(small) < 2 or small[0] + small[1] > room:
                take((size, best))
                continue
            if len(small) < 3 or sum(small) > room:
                fits = [k for k in keys[: bisect_right(keys, room)]]
                pair = max((a + b for a in fits for b in [fits[max(0, bisect_right(fits, room - a) - 1)]] if a + b <= room), default=0)
                if pair <= best:
                    take((size, best))
                    continue
            break
    return fixed, left


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in falling order of length, on repeat counts: patterns with the number of sequences of each."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # room left: sequences
    rooms: list[int] = []

    def put(room: int, items: tuple[int, ...], n: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((items, n))

    for size in sorted(count, reverse=True):
        n = count[size]
        while n:
            i = bisect_left(rooms, size)
            if i == len(rooms):  # new sequences, each filled with this length before the next
                each = capacity // size
                if n >= each:
                    put(capacity - each * size, (size,) * each, n // each)
                if n % each:
                    put(capacity - (n % each) * size, (size,) * (n % each), 1)
                break
            room = rooms[i]
            items, m = groups[room].pop()
            each = room // size  # what is left of the fullest sequence takes the next ones too
            full = min(m, n // each) if n >= each else 0
            used = full
            if full:
                put(room - each * size, items + (size,) * each, full)
                n -= full * each
            elif n:
                put(room - n * size, items + (size,) * n, 1)
                used, n = 1, 0
            if m > used:
                groups[room].append((items, m - used))
            if not groups[room]:
                del groups[room], rooms[bisect_left(rooms, room)]
    return [(items, n) for made in groups.values() for items, n in made]


def pack(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids by the tokenizer file at `path` and one id 0 (null or empty text: id 0 alone). Only a document longer
    than `capacity` is cut. Every piece lies in one sequence; a sequence's pieces follow each other from offset 0 without gaps.
    Every row, repeated rows and null doc_ids too, is a document of its own. No rows: no rows. Other columns are ignored.

    `path` must be readable on every executor and name a tokenizer that never joins text across white space."""
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    pieces = cut_lineage(source.mapInArrow(_pieces(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    spark = docs.sparkSession
    total = pieces.count()
    salts = max(64, total // 1_000_000)  # pieces of one length are ranked in so many parts
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    per_part = cut_lineage(pieces.groupBy("length", "part").count())
    histogram = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    fixed, left = dominance(histogram, capacity)
    base: dict[int, int] = {}
    rows, sequence = [], 0
    for items, n in fixed + best_fit(left, capacity):
        offset = 0
        for size in items:
            first = base.get(size, 0)
            rows.append((size, first, first + n, sequence, offset))
            base[size] = first + n
            offset += size
        sequence += n
    places = spark.createDataFrame(rows, "length long, rank_from long, rank_to long, sequence_from long, offset long")
    places = places.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank_from", "rank_to", "sequence_from", "offset"))).alias("places"))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    # a place list holds one entry per pattern that uses the length; a part meets it once, its pieces only the entries of the part's ranks
    ends = starts.join(per_part, ["length", "part"]).withColumn("after", F.col("before") + F.col("count"))
    own = ends.join(places, "length").select("length", "part", "before", F.filter("places", lambda p: (p["rank_from"] < F.col("after")) & (p["rank_to"] > F.col("before"))).alias("places"))
    spans = own.select("length", "part", "before", F.explode("places").alias("p")).select("length", "part", "before", "p.*")
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1
    ranked = pieces.withColumn("inside", inside)
    placed = ranked.join(spans, ["length", "part"]).withColumn("rank", F.col("before") + F.col("inside")).where("rank >= rank_from AND rank < rank_to")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), F.col("offset").cast("long"))
