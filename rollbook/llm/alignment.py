"""Alignment of two tokenizers over the same texts: groups of tokens between byte places where both end, and how often ids are
linked.

The merge runs in lockstep: one vector of states holds a place among the A tokens and one among the B tokens for every stretch
of every text in a batch. Each step moves the side that ends first (both, where they end together: a cut) and gives up the
stretches that are through. Long texts are several stretches, so that one of them does not hold up a batch."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.hashing import flat, slices
from rollbook.session import cut_lineage

#: Bytes of a stretch: the ends of tokens in it are merged on their own.
STRETCH = 2048
#: Links of one expansion; more are expanded in several.
EXPANDED = 1 << 20
#: Bytes of text of a batch.
BATCH = 1 << 20


class Side:
    """A tokenizer: ids of texts, and the bytes of every id."""

    table: np.ndarray  # bytes of all ids end to end
    first: np.ndarray  # their n + 1 borders

    def _bytes_of(self, entries: list[bytes]) -> None:
        self.table = np.frombuffer(b"".join(entries), np.uint8)
        self.first = np.concatenate([[0], np.cumsum([len(e) for e in entries])]).astype(np.int64)

    def ids(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError


class ByteLevel(Side):
    """A byte-level BPE file (.json); the text follows a space, and the strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel ones
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        entries = [b""] * self.slow.get_vocab_size(with_added_tokens=True)
        letters = byte_letters()
        for token, i in vocab.items():
            entries[i] = bytes(letters[c] for c in token)
        self._bytes_of(entries)
        # where ids follow the order of the merges, a faster library gives the same ids; it fails on very long white space
        merged = ["".join(m if not isinstance(m, str) else m.split(" ")) for m in model["merges"]]
        self.fast = None
        if all(vocab.get(m) == 256 + k for k, m in enumerate(merged)) and len(vocab) == 256 + len(merged):
            import tiktoken

            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the published pattern of byte-level BPE
            self.fast = tiktoken.Encoding("rows", pat_str=pattern, mergeable_ranks={entries[i]: i for i in vocab.values()}, special_tokens={})
        self.blanks = re.compile(r"\s{1000}")

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [self._one(" " + t) for t in texts]

    def _one(self, text: str) -> list[int]:
        if self.fast is None or self.blanks.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class Pieces(Side):
    """A sentence-piece model file with byte fallback, which puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        entries = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            entries.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self._bytes_of(entries)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level entries: itself if printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if chr(b) not in out):
        out[chr(256 + k)] = b
    return out


@functools.lru_cache(4)
def side(path: str) -> Side:
    """The tokenizer of a file, kept as long as the worker lives."""
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


def _flat_ids(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts end to end, their n + 1 borders)"""
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, first[-1]), first


def _joined(tokenizer: Side, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all tokens end to end, the end of each)"""
    size = tokenizer.first[ids + 1] - tokenizer.first[ids]
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(tokenizer.first[ids] - (ends - size), size)
    return tokenizer.table[at], ends


def cuts(ends_a: np.ndarray, ends_b: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flags of the A tokens, flags of the B tokens) that end where a token of the other side ends.

    `ends_*` are rising byte places of all texts end to end, `total` the ends of the texts. Places up to STRETCH apart
    in a text are merged by one state."""
    closed_a, closed_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    if not len(total) or not total[-1]:
        return closed_a, closed_b
    # lanes: the borders of the texts and places in between; a lane has the ends after one border up to the next
    starts = np.concatenate([[0], total[:-1]])
    n = -(-(total - starts) // STRETCH)
    borders = np.repeat(starts, n) + STRETCH * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    borders = np.append(borders, total[-1])
    from_a, from_b = np.searchsorted(ends_a, borders, "right"), np.searchsorted(ends_b, borders, "right")
    a, b, stop_a, stop_b = from_a[:-1].copy(), from_b[:-1].copy(), from_a[1:], from_b[1:]
    while True:
        left = (a < stop_a) & (b < stop_b)
        if not left.all():  # lanes that are through go
            a, b, stop_a, stop_b = a[left], b[left], stop_a[left], stop_b[left]
        if not len(a):
            return closed_a, closed_b
        end_a, end_b = ends_a[a], ends_b[b]
        both = end_a == end_b
        closed_a[a[both]] = True
        closed_b[b[both]] = True
        a += end_a <= end_b
        b += end_b <= end_a


class Aligned:
    """The groups of one batch of texts.

    n_a, n_b, n_groups, n_links: per text; group_a, group_b: group of each token, over all texts; doc: text of each group."""

    def __init__(self, a: Side, b: Side, texts: pa.Array):
        data, borders = flat(texts)
        told = texts.to_pylist()
        self.a, first_a = _flat_ids(a.ids([t or "" for t in told]))
        self.b, first_b = _flat_ids(b.ids([t or "" for t in told]))
        rows = len(told)
        # space + text of every row, end to end
        size = np.diff(borders) + 1
        total = np.cumsum(size)
        want = np.full(total[-1] if rows else 0, 32, np.uint8)
        inside = np.ones(len(want), bool)
        inside[total - size] = False
        want[inside] = data
        whole = np.diff(borders) > 0
        for tokenizer, ids, first in ((a, self.a, first_a), (b, self.b, first_b)):
            got, ends = _joined(tokenizer, ids)
            edge = np.concatenate([[0], ends])[first]
            whole &= np.diff(edge) == size
            for i in np.flatnonzero(whole):
                whole[i] = np.array_equal(got[edge[i] : edge[i + 1]], want[total[i] - size[i] : total[i]])
        # rows without tokens leave; the others keep their order
        self.doc_a, self.doc_b = (np.repeat(np.arange(rows), np.diff(f)) for f in (first_a, first_b))
        self.a, self.doc_a = self.a[whole[self.doc_a]], self.doc_a[whole[self.doc_a]]
        self.b, self.doc_b = self.b[whole[self.doc_b]], self.doc_b[whole[self.doc_b]]
        self.n_a, self.n_b = np.bincount(self.doc_a, minlength=rows), np.bincount(self.doc_b, minlength=rows)
        ends_a, ends_b = (np.cumsum(t.first[i + 1] - t.first[i]) for t, i in ((a, self.a), (b, self.b)))
        closed_a, closed_b = cuts(ends_a, ends_b, np.cumsum(size[whole]))
        self.group_a, self.group_b = (np.cumsum(c) - c for c in (closed_a, closed_b))
        self.doc = self.doc_a[closed_a]
        self.n_groups = np.bincount(self.doc, minlength=rows)
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=len(self.doc)), np.bincount(self.group_b, minlength=len(self.doc))
        self.n_links = np.bincount(self.doc, self.in_a * self.in_b, rows).astype(np.int64) if len(self.doc) else np.zeros(rows, np.int64)

    def _distinct(self, group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, id, times) of the distinct ids of each group, by group."""
        key, times = np.unique(group << 32 | ids, return_counts=True)
        return key >> 32, key & 0xFFFFFFFF, times

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct pairs of the batch as A id << 32 | B id, rising; then per text and pair: text, place of the pair, links)"""
        one = (self.in_a == 1) & (self.in_b == 1)
        docs, found, links = [], [], []
        single = one[self.group_a]
        docs.append(self.doc_a[single])
        found.append(self.a[single] << 32 | self.b[one[self.group_b]])
        links.append(np.ones(len(docs[0]), np.int64))
        ga, ia, ta = self._distinct(self.group_a[~single], self.a[~single])
        other = ~one[self.group_b]
        gb, ib, tb = self._distinct(self.group_b[other], self.b[other])
        start_b, stop_b = np.searchsorted(gb, ga), np.searchsorted(gb, ga, "right")
        wide = stop_b - start_b  # an A id meets every B id of its group
        done = np.concatenate([[0], np.cumsum(wide)])
        at = 0
        while at < len(ga):
            end = max(at + 1, int(np.searchsorted(done, done[at] + EXPANDED, "right")) - 1)
            n = wide[at:end]
            left = np.repeat(np.arange(at, end), n)
            right = np.arange(len(left)) - np.repeat(done[at:end] - done[at], n) + np.repeat(start_b[at:end], n)
            docs.append(self.doc[ga[left]])
            found.append(ia[left] << 32 | ib[right])
            links.append(ta[left] * tb[right])
            at = end
            if len(docs) > 8:  # equal pairs of a text are added up before more are expanded
                docs, found, links = ([x] for x in _added(np.concatenate(docs), np.concatenate(found), np.concatenate(links)))
        doc, pair, link = _added(np.concatenate(docs), np.concatenate(found), np.concatenate(links))
        known, place = np.unique(pair, return_inverse=True)
        return known, doc, place, link

    def shown(self) -> list[str]:
        """sha256 per text of its groups `a,a|b;a|b,b`; empty without tokens."""
        rows = len(self.n_a)
        top = int(max(self.a.max(initial=0), self.b.max(initial=0)))
        digits, width = _digits(top)
        # all tokens in the order of groups, A before B, each with the sign that follows it
        group = np.concatenate([self.group_a, self.group_b])
        order = np.argsort(group * 2 + np.repeat([0, 1], [len(self.a), len(self.b)]), kind="stable")
        ids, group = np.concatenate([self.a, self.b])[order], group[order]
        sign = np.full(len(ids), ord(","), np.uint8)
        after_a = np.cumsum(self.in_a + self.in_b) - self.in_b - 1
        after_b = np.cumsum(self.in_a + self.in_b) - 1
        sign[after_a] = ord("|")
        sign[after_b] = ord(";")
        size = width[ids] + 1
        ends = np.cumsum(size)
        out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
        out[ends - 1] = sign
        for k in range(digits.shape[1]):
            some = width[ids] > k
            out[ends[some] - size[some] + k] = digits[ids[some], k]
        last = np.concatenate([[0], ends])[np.cumsum(np.bincount(self.doc[group], minlength=rows))] if len(ids) else np.zeros(rows, np.int64)
        begin = np.concatenate([[0], last[:-1]])
        raw = out.tobytes()
        return [hashlib.sha256(raw[b : e - 1]).hexdigest() if e > b else "" for b, e in zip(begin.tolist(), last.tolist())]


@functools.lru_cache(2)
def _digits_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    text = np.arange(n).astype("S")
    return text.view(np.uint8).reshape(n, -1), np.char.str_len(text)


def _digits(top: int) -> tuple[np.ndarray, np.ndarray]:
    """(decimal digits of every id up to top, left-aligned; their number)"""
    return _digits_to(1 << max(16, top.bit_length()))


def _added(doc: np.ndarray, pair: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with one entry per text and pair."""
    if not len(doc):
        return doc, pair, links
    known, place = np.unique(pair, return_inverse=True)
    key, at = np.unique(doc * len(known) + place, return_inverse=True)
    return key // len(known), known[key % len(known)], np.bincount(at, links).astype(np.int64)


def _packed(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them all."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


_BATCHES = (
    "batch long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>,"
    " pairs binary, held binary, first binary, place binary, links binary"
)


def _align(path_a: str, path_b: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = side(path_a), side(path_b)
        number = TaskContext.get().partitionId() << 33
        for rows in slices(batches, "text", limit):
            got = Aligned(a, b, rows.column("text"))
            known, doc, place, links = got.pairs()
            order = np.argsort(doc, kind="stable")
            first = np.searchsorted(doc[order], np.arange(rows.num_rows + 1))
            held = np.bincount(place, minlength=len(known))
            one = lambda x: pa.array([x.tobytes()], pa.binary())
            many = lambda x, t=pa.int64(): pa.array([x], pa.list_(t))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), many(rows.column("doc_id").to_pylist()), *[many(x) for x in (got.n_a, got.n_b, got.n_groups, got.n_links)], many(got.shown(), pa.string())]
                + [one(known), one(_packed(held)), one(first.astype(np.int64)), one(_packed(place[order])), one(_packed(links[order]))],
                ["batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "held", "first", "place", "links"],
            )
            number += 1

    return run


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch its distinct pairs, and how many of its texts hold each."""
    for rows in batches:
        for batch, pairs, held in zip(rows.column("batch"), rows.column("pairs"), rows.column("held")):
            pairs = np.frombuffer(pairs.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), batch.as_py())), pa.array(pairs), pa.array(_unpacked(held.as_py(), len(pairs)))], ["batch", "pair", "held"])


def _opened(aligned: DataFrame) -> DataFrame:
    return aligned.select("batch", "pairs", "held").mapInArrow(_open, "batch long, pair long, held long")


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its counts, from the batch and (pair, count, best) of its pairs in order."""
    for rows in batches:
        for r in rows.to_pylist():
            first = np.frombuffer(r["first"], np.int64)
            place, links = _unpacked(r["place"], int(first[-1])), _unpacked(r["links"], int(first[-1]))
            count = np.array(r["counts"] or [], np.int64)  # negative where the pair is not its A id's best
            own = count[place] if len(place) else np.zeros(0, np.int64)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (links * (own > 0), links * np.abs(own))]
            best, total = (s[first[1:]] - s[first[:-1]] for s in sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r[c], pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(best), pa.array(total), pa.array(r["groups_sha256"], pa.string())],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): in how many texts the ids pair >> 32 and pair & (2^32 - 1) are linked, and whether no pair of the same A id
    has more. A window holds the B ids that one A id meets: at most the B vocabulary."""
    counts = _opened(aligned).groupBy("pair").agg(F.sum("held").alias("count"))
    top = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.withColumn("best", F.col("count") == top)


def align(docs: DataFrame, path_a: str, path_b: str, limit: int = BATCH) -> DataFrame:
    """The lockstep merge: one checkpointed row per batch of about `limit` bytes of docs (doc_id, text), for `pair_counts` and
    `doc_counts`."""
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return cut_lineage(source.mapInArrow(_align(path_a, path_b, limit), _BATCHES))


def doc_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Batches meet the counts of their pairs: a pair of common tokens is joined once per batch, not once per text."""
    opened = _opened(aligned).select("batch", "pair")
    signed = F.when(F.col("best"), F.col("count")).otherwise(-F.col("count"))
    known = opened.join(counts.select("pair", signed.alias("count")), "pair")
    lists = known.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("pair", "count"))).alias("__counts")).select("batch", F.col("__counts.count").alias("counts"))
    joined = aligned.drop("pairs", "held").join(lists, "batch", "left")
    return joined.mapInArrow(_close, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def link_tokens(docs: DataFrame, path_a: str, path_b: str, limit: int = BATCH) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    path_a is a byte-level BPE file, which reads a space and the text; path_b a piece model, which adds the space itself. Both
    must be readable on every executor. Special tokens in a text are plain text. Byte places where a token of both ends cut
    the tokens into groups; links are all pairs of an A and a B token of a group. The count of an id pair is the number of
    texts that hold it linked. n_best are the links whose pair has the highest count of its A id, ties included; count_sum adds
    up the counts of all links.

    A text that is null or empty, or whose tokens' bytes are not a space and the text, has no tokens: zeros and an empty
    groups_sha256. Rows that share a doc_id, or have none, are texts of their own. No rows: no rows. Other columns are
    ignored."""
    aligned = align(docs, path_a, path_b, limit)
    return doc_counts(aligned, cut_lineage(pair_counts(aligned)))
