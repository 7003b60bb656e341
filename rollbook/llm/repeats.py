"""Repeated word windows: non-overlapping blocks are indexed, every rolling window of a block's length probes the index, and
hits grow to the maximal runs of repeated windows.

Texts are dealt once into small batches. What batches need to know of each other travels as packed arrays of hashes, dealt by
hash, so that a common passage costs one entry a batch and no text ever meets another."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.hashing import Words

#: Bytes of text to a batch, and windows to a bucket of hashes.
BATCH_BYTES, BUCKET_ROWS = 2 << 20, 4 << 20
#: Bits of a block's hash inside its bucket. A chance hit costs a needless candidate, no wrong result.
HASH_BITS = 26


def dealt(docs: DataFrame, rows_per_byte: float) -> tuple[DataFrame, int]:
    """docs (doc_id, text) with a column `batch`, and the number of hash buckets; both grow with the bytes of text."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    batches = max(least, size // BATCH_BYTES)
    buckets = max(least, int(size * rows_per_byte) // BUCKET_ROWS)
    return docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches))), buckets


def packed(values: np.ndarray) -> bytes:
    """Sorted values below 2^31: as 16-bit steps (65535: so far on, and no value) if they are dense, else as they are."""
    step = np.diff(values, prepend=0)
    n = step // 65535 + 1
    if n.sum() > 2 * len(values):
        return b"\1" + values.astype(np.uint32).tobytes()
    out = np.full(n.sum(), 65535, np.uint16)
    out[np.cumsum(n) - 1] = step % 65535
    return b"\0" + out.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if raw[:1] == b"\1":
        return np.frombuffer(raw, np.uint32, offset=1).astype(np.int64)
    step = np.frombuffer(raw, np.uint16, offset=1)
    return np.cumsum(step, dtype=np.int64)[step != 65535]


def by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, value below 2^HASH_BITS) of hashes."""
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), (hashes & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)


def runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)


class _Windows:
    """The windows of one batch."""

    def __init__(self, table: pa.Table, block: int, size: int):
        self.words = Words(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()))
        ids = table.column("doc_id")
        self.known = ~ids.is_null().to_numpy() if table.num_rows else np.zeros(0, bool)
        self.ids = ids.fill_null(0).to_numpy() if table.num_rows else np.zeros(0, np.int64)
        h = self.words.hashes()
        self.block_hash, whole = self.words.grams(block, h)
        named = self.known[self.words.doc] if len(h) else np.zeros(0, bool)
        self.block_there = whole & named
        self.hash, whole = self.words.grams(size, h)
        self.there = whole & named
        self.place = np.arange(len(h)) - self.words.first[self.words.doc]


def _probes(block: int, size: int, buckets: int):
    def run(key, table):
        w = _Windows(table, block, size)
        at = np.flatnonzero(w.block_there)
        bucket, value = by_bucket(w.block_hash[at], buckets)
        # twice at most: once, or once more if another document of the batch has it
        order = np.lexsort((w.words.doc[at], value, bucket))
        bucket, value, doc, aligned = bucket[order], value[order], w.words.doc[at][order], (w.place[at] % block == 0)[order]
        first = runs(bucket * (1 << HASH_BITS) + value)
        start, last = first[:-1], first[1:] - 1
        n = 1 + (doc[start] != doc[last])
        indexed = np.logical_or.reduceat(aligned, start) if len(start) else np.zeros(0, bool)
        b, v = bucket[start], value[start]
        cut = runs(b)
        rows = [(int(b[i]), packed(np.repeat(v[i:j], n[i:j])), packed(v[i:j][indexed[i:j]])) for i, j in zip(cut[:-1], cut[1:])]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "batch": pa.array([key[0].as_py()] * len(rows), pa.int64()), "probes": pa.array([r[1] for r in rows], pa.binary()), "blocks": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _shared(key, table):
    """For each batch, those of its probes that hit a block which another document has."""
    probes = [unpacked(x) for x in table.column("probes").to_pylist()]
    blocks = np.unique(np.concatenate([unpacked(x) for x in table.column("blocks").to_pylist()]))
    all_probes = np.concatenate(probes)
    values, where, n = np.unique(all_probes, return_inverse=True, return_counts=True)
    hit = ((n > 1) & np.isin(values, blocks, assume_unique=True))[where]
    borders = np.cumsum([0, *(len(p) for p in probes)])
    mine = [np.unique(p[hit[a:z]]) for p, a, z in zip(probes, borders[:-1], borders[1:])]
    rows = [(b, packed(m)) for b, m in zip(table.column("batch").to_pylist(), mine) if len(m)]
    return pa.table({"bucket": pa.array([key[0].as_py()] * len(rows), pa.int64()), "batch": pa.array([r[0] for r in rows], pa.int64()), "hits": pa.array([r[1] for r in rows], pa.binary())})


def _candidates(block: int, size: int, buckets: int):
    """Hashes of the whole windows around hits, each once with the batch's smallest doc_id."""

    def run(key, table, hits):
        w = _Windows(table, block, size)
        shared = np.sort(np.concatenate([np.zeros(0, np.int64), *(b * (1 << HASH_BITS) + unpacked(x) for b, x in zip(hits.column("bucket").to_pylist(), hits.column("hits").to_pylist()))]))
        bucket, value = by_bucket(w.block_hash, buckets)
        hit = w.block_there & np.isin(bucket * (1 << HASH_BITS) + value, shared)
        near = np.concatenate([[0], np.cumsum(hit)])
        n = len(hit)
        at = np.flatnonzero(w.there & (near[np.minimum(np.arange(n) + size - block + 1, n)] > near[:-1]))
        order = np.lexsort((w.ids[w.words.doc[at]], w.hash[at]))
        h, ids = w.hash[at][order], w.ids[w.words.doc[at]][order]
        first = runs(h)
        h, low, high = h[first[:-1]], ids[first[:-1]], ids[first[1:] - 1]
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, h, low, high = bucket[order], h[order], low[order], high[order]
        cut = runs(bucket)
        spans = list(zip(cut[:-1], cut[1:]))
        return pa.table(
            {"bucket": pa.array([int(bucket[i]) for i, _ in spans], pa.int64()), "batch": pa.array([key[-1].as_py()] * len(spans), pa.int64())}
            | {name: pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for name, x in (("hashes", h), ("low", low), ("high", high))}
        )

    return run


def _smallest(key, table):
    """For each batch, its windows that a document smaller than some document of the batch has, with the smallest such."""
    parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    low = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("low").to_pylist()])
    high = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("high").to_pylist()])
    values, where = np.unique(np.concatenate(parts), return_inverse=True)
    least = np.full(len(values), np.iinfo(np.int64).max)
    np.minimum.at(least, where, low)
    least = least[where]
    borders = np.cumsum([0, *(len(p) for p in parts)])
    rows = []
    for k, batch in enumerate(table.column("batch").to_pylist()):
        a, z = borders[k], borders[k + 1]
        use = least[a:z] < high[a:z]
        if use.any():
            rows.append((batch, parts[k][use].tobytes(), least[a:z][use].tobytes()))
    return pa.table({"batch": pa.array([r[0] for r in rows], pa.int64()), "hashes": pa.array([r[1] for r in rows], pa.binary()), "least": pa.array([r[2] for r in rows], pa.binary())})


def joined(words: Words, kept: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(kept words end to end, each with a space behind, rows' borders therein)"""
    size = (words.ends - words.starts + 1)[kept]
    total = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(words.starts[kept] - total[:-1], size) + np.arange(total[-1])
    data = words.data[np.minimum(source, max(0, len(words.data) - 1))] if len(source) else np.zeros(0, np.uint8)
    data[total[1:] - 1] = 32
    n = np.concatenate([[0], np.cumsum(kept)])[words.first]
    return data.tobytes(), total[n]


def _removed(block: int, size: int):
    def run(key, table, told):
        w = _Windows(table, block, size)
        h = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in told.column("hashes").to_pylist())])
        least = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in told.column("least").to_pylist())])
        order = np.argsort(h)
        h, least = h[order], least[order]
        n = len(w.hash)
        repeated = np.zeros(n, bool)
        if len(h) and n:
            place = np.minimum(np.searchsorted(h, w.hash), len(h) - 1)
            repeated = w.there & (h[place] == w.hash) & (least[place] < w.ids[w.words.doc])
        edge = np.zeros(n + size + 1, np.int64)  # hits grow to runs: a word goes if a repeated window covers it
        edge[:n] += repeated
        edge[size : size + n] -= repeated
        gone = np.cumsum(edge)[:n] > 0
        data, borders = joined(w.words, ~gone)
        first = w.words.first
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
        kept = [data[a : max(a, z - 1)] for a, z in zip(borders[:-1], borders[1:])]
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(w.words.counts.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), "text": pa.array([x.decode() for x in kept], pa.string())})

    return run


def remove_repeats(docs: DataFrame, size: int = 13) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256, text (the kept words, one space between).

    A word goes if it lies in a window of `size` words that also starts in a document of smaller doc_id, judged on the input.
    Every such window holds a whole aligned block of (size + 1) // 2 words of the other document, so that the rolling windows
    of that length find it; the windows around hits are then compared whole, by 64-bit hashes.

    Null or empty text: no words. A null doc_id has no place in the order: its row keeps everything and takes nothing from others.
    Rows that share a doc_id take nothing from each other. No rows: no rows. Other columns are ignored."""
    block = (size + 1) // 2
    texts, buckets = dealt(docs, 0.2)
    probes = texts.groupBy("batch").applyInArrow(_probes(block, size, buckets), "bucket long, batch long, probes binary, blocks binary")
    hits = probes.groupBy("bucket").applyInArrow(_shared, "bucket long, batch long, hits binary")
    found = texts.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(_candidates(block, size, buckets), "bucket long, batch long, hashes binary, low binary, high binary")
    least = found.groupBy("bucket").applyInArrow(_smallest, "batch long, hashes binary, least binary")
    return texts.groupBy("batch").cogroup(least.groupBy("batch")).applyInArrow(_removed(block, size), "doc_id long, n_words long, n_removed long, kept_sha256 string, text string")
