"""Exact removal of repeated byte strings: equal strings share an anchor, and of each anchor's surroundings the suffixes are
sorted by Lyndon groups, whose common prefixes tell which strings stand more than once.

Texts are dealt once into small batches; anchors and surroundings travel as packed arrays, dealt by the anchor's hash, equal
surroundings once."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.hashing import codes, flat, inverse_powers, mix, powers
from rollbook.llm.repeats import dealt, runs
from rollbook.llm.suffixes import suffix_array

#: Length of an anchor in a window.
GRAM = 100
#: An anchor with more different surroundings than this has its windows dealt one by one, by their hashes.
CROWD = 512
#: Words to one suffix array.
SORTED_WORDS = 40_000
FULL, ASKED, CROWDED = 1, 2, 4


class Hashed:
    """Hashes of any part of an array of bytes."""

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes()[data] * powers(len(data)), out=self.total[1:]) if len(data) else None
        self.back = inverse_powers(len(data) + 1)

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.back[start]


def least_at(h: np.ndarray, width: int) -> np.ndarray:
    """For each place, the index of the first smallest value (in its 33 leading bits) among the `width` values from there on."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 31) - 1)
    keyed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        keyed = np.minimum(keyed[: len(keyed) - span], keyed[span:])
        span *= 2
    return (np.minimum(keyed[:n], keyed[width - span : width - span + n]) & low).astype(np.int64)


class _Batch:
    """Windows of a batch by anchor. first, last: windows from first up to last (excluded) have the anchor; around: hash of what
    they cover, with the anchor's place in it."""

    def __init__(self, table: pa.Table, size: int):
        self.data, self.borders = flat(table.column("text") if table.num_rows else pa.array([], pa.string()))
        self.hashed = Hashed(self.data)
        n = len(self.data)
        at = np.zeros(0, np.int64)
        grams = np.zeros(0, np.uint64)
        if n >= size:
            start = np.arange(n - GRAM + 1)
            grams = mix(self.hashed.part(start, start + GRAM))
            at = least_at(grams, size - GRAM + 1)
        whole = np.zeros(n + 1, np.int64)  # windows that end in their document
        a, z = self.borders[:-1], self.borders[1:] - size + 1
        np.add.at(whole, a[z > a], 1)
        np.add.at(whole, z[z > a], -1)
        window = np.flatnonzero(np.cumsum(whole)[: len(at)])
        cut = runs(at[window])
        place = at[window[cut[:-1]]]
        self.first = window[cut[:-1]]
        self.last = window[cut[1:] - 1] + 1
        self.anchor = grams[place]
        shape = (place - self.first).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (self.last - self.first).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        self.around = mix(self.hashed.part(self.first, self.last + size - 1) + mix(shape))


def _spread(bucket: np.ndarray, columns: dict[str, np.ndarray], **fixed) -> pa.Table:
    """A row per bucket with its values of each column as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = runs(bucket)
    spans = list(zip(cut[:-1], cut[1:]))
    made = {"bucket": pa.array(bucket[cut[:-1]].astype(np.int64))} | {k: pa.array([v] * len(spans), pa.int64()) for k, v in fixed.items()}
    for k, v in columns.items():
        v = v[order]
        made[k] = pa.array([v[i:j].tobytes() for i, j in spans], pa.binary())
    return pa.table(made)


def _anchors(size: int, buckets: int):
    def run(key, table):
        b = _Batch(table, size)
        around, at, n = np.unique(b.around, return_index=True, return_counts=True)
        anchor = b.anchor[at]
        return _spread((anchor % np.uint64(buckets)).astype(np.int64), {"anchor": anchor, "around": around, "n": np.minimum(n, 2).astype(np.uint8)}, batch=key[0].as_py())

    return run


def _arrays(table: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]


def _status(crowd: int, key, table):
    """For each batch, what it must know of its surroundings: whether they stand elsewhere as a whole (FULL), or share their anchor
    with others and are sent on (ASKED; FULL ones by one batch only), window by window if too many do (CROWDED)."""
    parts = _arrays(table, "anchor", np.uint64)
    size = [len(p) for p in parts]
    anchor, around, n = np.concatenate(parts), np.concatenate(_arrays(table, "around", np.uint64)), np.concatenate(_arrays(table, "n", np.uint8))
    order = np.lexsort((around, anchor))
    a, c = anchor[order], around[order]
    fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
    first = np.flatnonzero(fresh)
    total = np.add.reduceat(n[order].astype(np.int64), first)
    group = np.cumsum(fresh) - 1
    kinds_of = np.flatnonzero(np.concatenate([[True], a[first][1:] != a[first][:-1]]))
    kinds = np.repeat(np.diff(np.append(kinds_of, len(first))), np.diff(np.append(kinds_of, len(first))))
    flag = np.where(total[group] > 1, FULL, 0)
    asked = (kinds[group] > 1) & (fresh | (kinds[group] > crowd))
    flag |= np.where(asked, ASKED, 0) | np.where(asked & (kinds[group] > crowd), CROWDED, 0)
    out = np.zeros(len(a), np.uint8)
    out[order] = flag
    borders = np.cumsum([0, *size])
    rows = []
    for k, batch in enumerate(table.column("batch").to_pylist()):
        mine = slice(borders[k], borders[k + 1])
        use = out[mine] > 0
        if use.any():
            rows.append((batch, around[mine][use].tobytes(), out[mine][use].tobytes()))
    return _answers(rows, 0)


def _answers(rows: list[tuple[int, bytes, bytes]], kind: int) -> pa.Table:
    return pa.table({"batch": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([kind] * len(rows), pa.int64()), "a": pa.array([r[1] for r in rows], pa.binary()), "b": pa.array([r[2] for r in rows], pa.binary())})


def _flags(b: _Batch, told: pa.Table) -> np.ndarray:
    """The flags of each of the batch's anchors."""
    rows = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint8)) for k, x, y in zip(*(told.column(c).to_pylist() for c in ("kind", "a", "b"))) if k == 0]
    flag = np.zeros(len(b.around), np.uint8)
    if rows and len(flag):
        h, f = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        order = np.argsort(h)
        h, f = h[order], f[order]
        place = np.minimum(np.searchsorted(h, b.around), len(h) - 1)
        flag = np.where(h[place] == b.around, f[place], 0).astype(np.uint8)
    return flag


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first, first + 1, ... last - 1 of each pair, end to end."""
    n = last - first
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _surroundings(size: int, buckets: int):
    def run(key, table, told):
        b = _Batch(table, size)
        flag = _flags(b, told)
        batch = key[-1].as_py()
        crowded = np.flatnonzero(flag & CROWDED)
        window = _ranges(b.first[crowded], b.last[crowded])
        h, n = np.unique(b.hashed.part(window, window + size), return_counts=True)
        alone = _spread((mix(h) % np.uint64(buckets)).astype(np.int64), {"x": h, "y": np.minimum(n, 2).astype(np.uint8)}, batch=batch, kind=2)
        _, sent = np.unique(np.where((flag & ASKED > 0) & (flag & CROWDED == 0), b.around, np.uint64(0)), return_index=True)
        sent = sent[(flag[sent] & ASKED > 0) & (flag[sent] & CROWDED == 0)]
        bucket = (b.anchor[sent] % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((b.anchor[sent], bucket))
        sent, bucket = sent[order], bucket[order]
        head = np.stack([b.anchor[sent], b.around[sent], (b.last - b.first)[sent].astype(np.uint64)], axis=1)
        cut = runs(bucket)
        rows = [(int(bucket[i]), head[i:j].tobytes(), b.data[_ranges(b.first[sent[i:j]], b.last[sent[i:j]] + size - 1)].tobytes()) for i, j in zip(cut[:-1], cut[1:])]
        together = pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "batch": pa.array([batch] * len(rows), pa.int64()), "kind": pa.array([1] * len(rows), pa.int64()), "x": pa.array([r[1] for r in rows], pa.binary()), "y": pa.array([r[2] for r in rows], pa.binary())})
        return pa.concat_tables([together, alone.select(together.column_names)])

    return run


def repeated_windows(texts: list[bytes], counts: list[int], size: int) -> list[np.ndarray]:
    """For each text, which of its first `counts` windows of `size` bytes stand in more than one place of the texts.

    The suffixes that begin behind white space are sorted word by word. Two windows are equal if the parts up to their first white
    space are, and what follows has a common prefix long enough; a window without white space is compared by its hash."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    length = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(length) - length
    end = begin + length
    hashed = Hashed(data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    words: list[bytes] = []
    offset: list[int] = []
    close: list[int] = []
    at_byte = np.full(len(data) + 1, -1, np.int64)  # the suffix that begins at a byte
    ends_at = []
    raw = data.tobytes()
    for a, z in zip(begin.tolist(), end.tolist()):
        cuts = (np.flatnonzero(space[a:z]) + a + 1).tolist()
        for x, y in zip(cuts, [*cuts[1:], z]):
            if x < z:
                at_byte[x] = len(words)
                words.append(raw[x:y])
                offset.append(x)
                close.append(z)
        ends_at.append(len(words))  # the text's own end, as an empty suffix
        words.append(b"")
        offset.append(z)
        close.append(z)
    number = {w: i for i, w in enumerate(sorted(set(words)))}
    order = np.array(suffix_array([number[w] for w in words]), np.int64)
    off, stop = np.array(offset, np.int64)[order], np.array(close, np.int64)[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    x, y = off[1:], off[:-1]
    low, high = np.zeros(len(x), np.int64), np.minimum(np.minimum(stop[1:] - x, stop[:-1] - y), size)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = hashed.part(x, x + mid) == hashed.part(y, y + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    common = np.concatenate([[-1], low])
    counts_ = np.array(counts, np.int64)
    window = _ranges(begin, begin + counts_)
    owner = np.repeat(np.arange(len(texts)), counts_)
    next_space = np.full(len(data) + 1, len(data) + size, np.int64)
    where = np.flatnonzero(space)
    next_space[: len(data)] = np.append(where, len(data) + size)[np.searchsorted(where, np.arange(len(data)))]
    lead = next_space[window] - window + 1
    spaced = lead <= size
    key = np.empty(len(window), np.uint64)
    key[~spaced] = mix(hashed.part(window[~spaced], window[~spaced] + size)) | np.uint64(1)
    suffix = at_byte[np.minimum(window + lead, len(data))]
    at_end = (window + lead) >= end[owner]
    suffix = np.where(at_end, np.array(ends_at, np.int64)[owner], suffix)
    by_lead = np.argsort(np.where(spaced, lead, 0), kind="stable")
    cut = runs(np.where(spaced, lead, 0)[by_lead])
    for i, j in zip(cut[:-1], cut[1:]):
        w = by_lead[i:j]
        s = int(lead[w[0]])
        if s > size or not spaced[w[0]]:
            continue
        if s == size:
            tail = np.zeros(len(w), np.uint64)  # the white space is the window's last byte
        else:
            tail = np.cumsum(common < size - s)[rank[suffix[w]]].astype(np.uint64)
        key[w] = mix(hashed.part(window[w], window[w] + s) + mix(tail * np.uint64(0x9E3779B97F4A7C15) + np.uint64(s))) & ~np.uint64(1)
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    hit = n[back] > 1
    cuts = np.cumsum(counts_)
    return np.split(hit, cuts[:-1])


def _judged(size: int, key, table):
    kind = key[0].as_py()
    batches = table.column("batch").to_pylist()
    if kind == 2:
        parts = _arrays(table, "x", np.uint64)
        n = np.concatenate(_arrays(table, "y", np.uint8)).astype(np.int64)
        values, where = np.unique(np.concatenate(parts), return_inverse=True)
        hit = np.bincount(where, weights=n)[where] > 1
        borders = np.cumsum([0, *(len(p) for p in parts)])
        return _answers([(b, parts[k][hit[borders[k] : borders[k + 1]]].tobytes(), b"") for k, b in enumerate(batches) if hit[borders[k] : borders[k + 1]].any()], 2)
    texts: list[tuple[int, int, int, int, bytes]] = []
    for b, head, data in zip(batches, table.column("x").to_pylist(), table.column("y").to_pylist()):
        at = 0
        for anchor, around, n in np.frombuffer(head, np.uint64).reshape(-1, 3).tolist():
            texts.append((anchor, b, around, n, data[at : at + n + size - 1]))
            at += n + size - 1
    texts.sort(key=lambda t: t[0])
    found: dict[int, list[tuple[int, np.ndarray]]] = {}
    start = 0
    while start < len(texts):  # whole anchors to a suffix array, up to its number of words
        end, words = start, 0
        while end < len(texts) and (words < SORTED_WORDS or texts[end][0] == texts[end - 1][0]):
            words += texts[end][4].count(b" ") + 1
            end += 1
        for t, hit in zip(texts[start:end], repeated_windows([t[4] for t in texts[start:end]], [t[3] for t in texts[start:end]], size)):
            if hit.any():
                found.setdefault(t[1], []).append((t[2], hit))
        start = end
    return _answers([(b, np.array([[c, len(h)] for c, h in rows], np.uint64).tobytes(), b"".join(np.packbits(h).tobytes() for _, h in rows)) for b, rows in sorted(found.items())], 1)


def _removed(size: int):
    def run(key, table, told):
        b = _Batch(table, size)
        flag = _flags(b, told)
        n = len(b.data)
        edge = np.zeros(n + size + 1, np.int64)

        def cover(windows: np.ndarray) -> None:
            np.add.at(edge, windows, 1)
            np.add.at(edge, windows + size, -1)

        full = flag & FULL > 0
        cover(_ranges(b.first[full], b.last[full]))
        partial_: dict[int, np.ndarray] = {}
        single = [np.zeros(0, np.uint64)]
        for kind, x, y in zip(*(told.column(c).to_pylist() for c in ("kind", "a", "b"))):
            if kind == 2:
                single.append(np.frombuffer(x, np.uint64))
            elif kind == 1:
                at, bits = 0, np.frombuffer(y, np.uint8)
                for around, m in np.frombuffer(x, np.uint64).reshape(-1, 2).tolist():
                    partial_[around] = np.unpackbits(bits[at : at + -(-m // 8)])[:m].astype(bool)
                    at += -(-m // 8)
        for k in np.flatnonzero((flag & ASKED > 0) & ~full):
            hit = partial_.get(int(b.around[k]))
            if hit is not None:
                cover(b.first[k] + np.flatnonzero(hit))
        crowded = np.flatnonzero((flag & CROWDED > 0) & ~full)
        window = _ranges(b.first[crowded], b.last[crowded])
        cover(window[np.isin(b.hashed.part(window, window + size), np.concatenate(single))])
        gone = np.cumsum(edge)[:n] > 0
        begins = gone & ~np.concatenate([[False], gone[:-1]]) if n else gone
        starts = b.borders[:-1]
        begins = begins.copy()
        inside = starts[np.diff(b.borders) > 0]
        begins[inside] = gone[inside]
        total, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins))
        left = b.data[~gone].tobytes()
        kept_at = b.borders - total[b.borders]
        texts = [left[a:z] for a, z in zip(kept_at[:-1].tolist(), kept_at[1:].tolist())]
        count = lambda x: pa.array((x[b.borders[1:]] - x[starts]).astype(np.int64))
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(b.borders).astype(np.int64)), "n_removed": count(total), "n_spans": count(spans), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), "kept": pa.array(texts, pa.binary())})

    return run


def remove_substrings(docs: DataFrame, size: int = 400, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    A byte goes if a string of `size` bytes over it starts in one more place of any row, the same row included; strings are judged
    on the input and never cross rows. All copies go.

    Null text is empty; so is what is shorter than `size`, as far as repeats go. Null or repeated doc_ids make no difference: every
    row is a text of its own. No rows: no rows. Other columns are ignored. Strings are compared by 64-bit hashes. An anchor with
    more than `crowd` different surroundings is not sorted: its windows are dealt by their hashes, so that no task gets a crowd."""
    texts, buckets = dealt(docs, 0.2)
    anchors = texts.groupBy("batch").applyInArrow(_anchors(size, buckets), "bucket long, batch long, anchor binary, around binary, n binary")
    state, judge = partial(_status, crowd), partial(_judged, size)
    status = anchors.groupBy("bucket").applyInArrow(lambda key, table: state(key, table), "batch long, kind long, a binary, b binary")
    sent = texts.groupBy("batch").cogroup(status.groupBy("batch")).applyInArrow(_surroundings(size, buckets), "bucket long, batch long, kind long, x binary, y binary")
    judged = sent.groupBy("kind", "bucket").applyInArrow(lambda key, table: judge(key, table), "batch long, kind long, a binary, b binary")
    told = status.unionByName(judged)
    return texts.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_removed(size), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
