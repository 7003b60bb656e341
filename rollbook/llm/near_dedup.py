"""Near duplicates on word shingles: MinHash bands propose pairs, a sequential Bayesian test on batches of the
signature drops hopeless ones, and the full shingle sets decide the rest."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.graph import components, if_small, link_buckets
from rollbook.llm.hashing import Words, mix, ragged, slices
from rollbook.session import cut_lineage

BANDS, ROWS = 32, 4
BATCH = 32
#: A component of so many nodes is compared in blocks of BLOCK_NODES.
LARGE, BLOCK_NODES = 16, 256
#: So is a bucket of so many nodes that their leader leaves in several components.
CROWD = 64
_LOW = np.uint64((1 << 52) - 1)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (52 bits) of up to 4096 rows, sorted row by row, and the rows' n + 1 borders.

    A row of fewer than `size` words has its whole word sequence as one shingle; no words, no shingle."""
    words = Words(texts, lower=True)
    h = words.hashes()
    grams, whole = words.grams(size, h)
    n = len(words.counts)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    doc = words.doc[whole]
    value = grams[whole]
    if len(short):
        weight = np.array([pow(0xA0761D6478BD642F, j + 1, 1 << 64) for j in range(size)], np.uint64)
        whole_text = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            there = words.counts[short] > j
            whole_text[there] += h[words.first[short[there]] + j] * weight[j]
        doc, value = np.concatenate([doc, short]), np.concatenate([value, mix(whole_text)])
    keys = np.unique((doc.astype(np.uint64) << np.uint64(52)) | (value & _LOW))
    return keys & _LOW, np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(52))


def signatures(values: np.ndarray, first: np.ndarray, length: int = BANDS * ROWS) -> np.ndarray:
    """n x length MinHash values (32 bits); rows without shingles are 0."""
    n = len(first) - 1
    out = np.zeros((n, length), np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        x = mix(values.copy())
        odd = np.random.default_rng(7).integers(0, 1 << 63, length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for j in range(length):
            out[full, j] = np.minimum.reduceat(x * odd[j], first[full]) >> np.uint64(32)
    return out


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two sums over each row's set that tell sets apart."""
    sums = np.zeros((2, len(values) + 1), np.uint64)
    np.cumsum(mix(values.copy()), out=sums[0, 1:])
    np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1, 1:])
    return (sums[:, first[1:]] - sums[:, first[:-1]]).view(np.int64)


def _texts_of(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            values, first = shingle_sets(b.column("text"), size)
            sums = _sums(values, first)
            yield pa.RecordBatch.from_arrays([pa.array(sums[0]), pa.array(sums[1]), pa.array(np.diff(first).astype(np.int64)), b.column("text")], ["node_a", "node_b", "n_shingles", "text"])

    return run


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            values, first = shingle_sets(b.column("text"), size)
            sig = signatures(values, first)
            sums = _sums(values, first)
            band = np.zeros((len(sig), BANDS), np.uint64)
            for j in range(ROWS):
                band = mix(band * np.uint64(31) + sig[:, j::ROWS].astype(np.uint64) + np.uint64(1))
            band += np.arange(BANDS, dtype=np.uint64)  # equal rows in different bands must not meet
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * BANDS), pa.array(mix(band.ravel()).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), ragged(sig.ravel(), np.arange(len(sig) + 1) * sig.shape[1]), keys],
                ["doc_id", "n_shingles", "set_a", "set_b", "sig", "keys"],
            )

    return run


def least_matches(threshold: float, miss: float, length: int = BANDS * ROWS) -> list[tuple[int, int]]:
    """(values compared, fewest matches with which a pair stays): under a uniform prior, the posterior probability of a
    similarity of `threshold` or more, which is P(Binomial(n + 1, threshold) <= matches), is at least `miss`."""
    out = []
    for n in range(BATCH, length + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _prune(threshold: float, miss: float):
    bounds = least_matches(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
            alive, matches = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for n, least in bounds:
                matches[alive] += (x[alive, n - BATCH : n] == y[alive, n - BATCH : n]).sum(1)
                alive = alive[matches[alive] >= least]
            kept = b.take(pa.array(alive))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    return run


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(slices(batches, "text_a"), "text_b"):
            n = b.num_rows
            xa, fa = shingle_sets(b.column("text_a"), size)
            xb, fb = shingle_sets(b.column("text_b"), size)
            row = np.arange(n, dtype=np.uint64) << np.uint64(52)
            both = np.concatenate([xa | np.repeat(row, np.diff(fa)), xb | np.repeat(row, np.diff(fb))])
            both.sort()
            twice = both[1:][both[1:] == both[:-1]] >> np.uint64(52)
            shared = np.bincount(twice.astype(np.int64), minlength=n)
            union = np.diff(fa) + np.diff(fb) - shared
            kept = b.filter(pa.array((100 * shared >= percent * union) & (union > 0)))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("node"), ragged(*shingle_sets(b.column("text"), size))], ["node", "shingles"])

    return run


def _packed(key, table):
    """The nodes of a block with their sets end to end."""
    sets = table.column("shingles").to_pylist()
    size = np.array([len(x) // 8 for x in sets], np.int64)
    return pa.table({"large": pa.array([key[0].as_py()]), "nodes": pa.array([table.column("node").to_numpy().tobytes()], pa.binary()), "sizes": pa.array([size.tobytes()], pa.binary()), "sets": pa.array([b"".join(sets)], pa.binary())})


def _compare_blocks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, na, b, nb = (np.frombuffer(r[x], np.int64) for x in ("nodes", "sizes", "nodes_b", "sizes_b"))
                values = np.frombuffer(r["sets"], np.uint64)
                order = np.argsort(values, kind="stable")
                values, owner = values[order], np.repeat(np.arange(len(a)), na)[order]
                other = np.split(np.frombuffer(r["sets_b"], np.uint64), np.cumsum(nb)[:-1])
                found: list[tuple[int, int]] = []
                for k, x in enumerate(other):
                    low, high = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
                    n = high - low
                    at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    shared = np.bincount(owner[at], minlength=len(a))
                    found += [(int(a[i]), int(b[k])) for i in np.flatnonzero((100 * shared >= percent * (na + nb[k] - shared)) & (a != b[k]))]
                yield pa.RecordBatch.from_arrays([pa.array([max(f) for f in found], pa.int64()), pa.array([min(f) for f in found], pa.int64())], ["a", "b"])

    return run


def _large_components(open_: DataFrame, comps: DataFrame, sets_of: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(open_ without the nodes of large components, comps with the links of those).

    A node that meets a large component in a bucket without being in it is compared with all of it, full set against full set, in
    blocks of nodes: a component costs its blocks times theirs, not a row per pair."""
    large = comps.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= LARGE)
    placed = open_.join(comps, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
    placed = cut_lineage(placed.join(mixed, "key", "left_semi").join(large.select(F.col("component").alias("c"), "n"), "c", "left"))
    met = placed.where("n IS NOT NULL").select("key", F.col("c").alias("large"), "n").distinct()
    loose = cut_lineage(placed.select("key", "node", "c").join(met, "key").where("c <> large").select("large", "n", "node").distinct())
    if not loose.isEmpty():
        shape = "large long, nodes binary, sizes binary, sets binary"
        block = lambda n: F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / BLOCK_NODES).cast("long")).alias("block")
        whole = loose.groupBy("large").agg(F.first("n").alias("n"), F.count("*").alias("m"))
        inside = comps.join(whole, comps["component"] == whole["large"]).select("large", "node", block("n")).join(sets_of, "node").groupBy("large", "block").applyInArrow(lambda key, table: _packed(key, table), shape)
        outside = loose.join(whole.select("large", "m"), "large").select("large", "node", block("m")).join(sets_of, "node").groupBy("large", "block").applyInArrow(lambda key, table: _packed(key, table), shape)
        outside = outside.select("large", *[F.col(c).alias(f"{c}_b") for c in ("nodes", "sizes", "sets")])
        found = inside.join(outside, "large").mapInArrow(_compare_blocks(percent), "a long, b long")
        comps = cut_lineage(components(found.unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b")))))
    return cut_lineage(placed.where("n IS NULL").select("key", "node", "score")), comps


def _large_buckets(open_: DataFrame, comps: DataFrame, sets_of: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(open_ without buckets of CROWD nodes or more, comps with the links of those).

    All nodes of such a bucket are compared, full set against full set, in blocks of nodes, so that nodes which no leader ties
    together cost a row per pair of blocks and not per pair. Buckets that hold the same nodes are compared once."""
    members = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")
    crowds = cut_lineage(open_.groupBy("key").agg(F.count("*").alias("n"), members).where(F.col("n") >= CROWD))
    if crowds.isEmpty():
        return open_, comps
    once = crowds.groupBy("n", "members").agg(F.min("key").alias("key"))
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK_NODES).cast("long")).alias("block")
    dealt = open_.join(once, "key").select(F.col("key").alias("large"), "node", block).join(sets_of, "node")
    packed = cut_lineage(dealt.groupBy("large", "block").applyInArrow(lambda key, table: _packed(key, table), "large long, nodes binary, sizes binary, sets binary"))
    other = packed.select("large", *[F.col(c).alias(f"{c}_b") for c in ("nodes", "sizes", "sets")])
    found = packed.join(other, "large").where("nodes >= nodes_b").mapInArrow(_compare_blocks(percent), "a long, b long").distinct()
    comps = cut_lineage(components(found.unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b")))))
    return cut_lineage(open_.join(crowds.select("key"), "key", "left_anti")), comps


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = 1e-9) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id it reaches), kept.

    Links join documents whose sets of `size`-word shingles (A-Z lower-cased) have a Jaccard similarity of percent/100 or
    more. 32 bands of 4 values miss a pair of similarity 0.8 with probability 5e-8; `miss` is the posterior probability
    of a link below which the Bayesian test drops a candidate.

    Equal sets become one node first, so copies cost nothing further. In a bucket, members are compared with a leader
    (the node in the most and largest buckets), not with each other. What meets a component of 16 nodes or more without being
    in it is then compared with all of it in blocks, and small components go on to rounds with eight times as many leaders, so
    that in the end every two members of a bucket were compared or are connected.

    Null text or a text without words: empty set, own component. Null doc_id: component_id null, kept, not compared.
    Rows that share a doc_id are one document with the links of all their texts. No rows: no rows. Other columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, set_a long, set_b long, sig binary, keys array<long>"
    told = cut_lineage(docs.mapInArrow(_describe(size), schema))
    node = F.xxhash64("set_a", "set_b", "n_shingles").alias("node")
    usable = told.where("n_shingles > 0 AND doc_id IS NOT NULL").select("*", node)
    sets = cut_lineage(usable.groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    reps = usable.join(if_small(sets), ["node", "doc_id"], "left_semi")
    bands = reps.select("node", F.explode("keys").alias("key"))
    crowded = cut_lineage(bands.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", "n"))
    open_ = cut_lineage(bands.join(if_small(crowded), "key").distinct())
    score = open_.groupBy("node").agg(F.sum("n").alias("score"))
    near = cut_lineage(score.join(sets, "node"))
    open_ = cut_lineage(open_.select("key", "node").join(near.select("node", "score"), "node"))
    sigs = cut_lineage(reps.join(if_small(near.select("node")), "node", "left_semi").select("node", "sig").dropDuplicates(["node"]))
    # rows that share a doc_id may differ in text: each node takes the text whose set it is
    texts = docs.join(if_small(near.select("doc_id").distinct()), "doc_id", "left_semi").mapInArrow(_texts_of(size), "node_a long, node_b long, n_shingles long, text string")
    texts = texts.select(F.xxhash64("node_a", "node_b", "n_shingles").alias("node"), "text").dropDuplicates(["node"])
    texts = cut_lineage(texts.join(if_small(near.select("node")), "node", "left_semi"))

    def linked(pairs: DataFrame) -> DataFrame:
        sa, sb = (sigs.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}")) for x in ("a", "b"))
        likely = pairs.join(sa, "a").join(sb, "b").mapInArrow(_prune(percent / 100, miss), "a long, b long").distinct()
        ta, tb = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in ("a", "b"))
        return likely.join(ta, "a").join(tb, "b").mapInArrow(_verify(size, percent), "a long, b long")

    comps = link_buckets(open_, linked, rounds=1)
    if comps is not None:
        sets_of = texts.mapInArrow(_sets(size), "node long, shingles binary")
        open_, comps = _large_components(open_, comps, sets_of, percent)
        open_, comps = _large_buckets(open_, comps, sets_of, percent)
        comps = link_buckets(open_, linked, comps)

    named = usable.select("doc_id", "node")
    if comps is not None:
        named = named.join(comps, "node", "left").select("doc_id", F.coalesce("component", "node").alias("node"))
    # all texts of one doc_id are one document: components that share a doc_id become one
    shared = cut_lineage(named.distinct().groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("n > 1"))
    if not shared.isEmpty():
        ties = named.distinct().join(shared, "doc_id").select(F.col("node").alias("a"), F.col("low").alias("b"))
        named = named.join(components(ties), "node", "left").select("doc_id", F.coalesce("component", "node").alias("node"))
    least = named.groupBy("node").agg(F.min("doc_id").alias("component_id"))
    of = named.distinct().join(least, "node").select("doc_id", "component_id")
    out = told.select("doc_id", "n_shingles").join(of, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
