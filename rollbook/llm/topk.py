"""Exact top-k by inner product: distances to pivots bound every score, candidates are evaluated in the order of their bounds,
and a query stops when no bound can reach its k-th score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.session import cut_lineage

#: Rows of a block of queries and of a block of candidates; a task holds one of each.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096
PIVOTS = 48
#: Candidates evaluated at once, in the order of their bounds.
STEP = 256


def scaled(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """(vec_id, v array<long>): each component times `factor`, floored. Rows go whose id or vector is null or whose
    vector is empty or holds null, NaN or infinity."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * factor))
    fine = F.forall(F.col("embedding").cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _block_top(k: int):
    def pivots(x: np.ndarray, n: int) -> np.ndarray:
        """Rows far from each other: each next pivot is the row farthest from those before."""
        chosen, far = [int(np.argmax((x * x).sum(1)))], np.full(len(x), np.inf)
        while len(chosen) < min(n, len(x)):
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
            chosen.append(int(np.argmax(far)))
        return x[chosen]

    def one(q_ids, q_whole, c_ids, c_whole):
        q, c = q_whole.astype(np.float64), c_whole.astype(np.float64)
        # a further component makes all candidates equally long (and is 0 in queries), so that the nearest has the greatest inner product
        square = (c * c).sum(1)
        top = square.max()
        lift = np.sqrt(top - square)
        table = np.concatenate([c, lift[:, None]], axis=1)
        pivot = pivots(table, PIVOTS)
        to_c = np.sqrt(np.maximum(0, (table * table).sum(1)[:, None] + (pivot * pivot).sum(1) - 2 * table @ pivot.T))
        q_square = (q * q).sum(1)
        to_q = np.sqrt(np.maximum(0, q_square[:, None] + (pivot * pivot).sum(1) - 2 * q @ pivot[:, :-1].T))
        slack = 1e-3 + 1e-6 * np.sqrt(top + q_square.max())
        out = []
        for i in range(len(q)):
            low = np.abs(to_c - to_q[i]).max(1) if len(pivot) else np.zeros(len(c))
            # score = (|q|^2 + top - distance^2) / 2, and the slack covers rounding of the distances
            bound = (q_square[i] + top - np.maximum(0, low - slack) ** 2) / 2 + 1 + 1e-9 * (q_square[i] + top)
            order = np.argsort(-bound, kind="stable")
            order = order[c_ids[order] != q_ids[i]]
            ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for a in range(0, len(order), STEP):
                if len(scores) == k and bound[order[a]] < scores[-1]:
                    break
                now = order[a : a + STEP]
                ids = np.concatenate([ids, c_ids[now]])
                scores = np.concatenate([scores, c_whole[now] @ q_whole[i]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            out.append((np.full(len(ids), q_ids[i]), ids, scores))
        return (np.concatenate(x) for x in zip(*out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                q_ids, c_ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q, c = (np.frombuffer(r[x], np.int64).reshape(len(n), -1) for x, n in (("q_data", q_ids), ("data", c_ids)))
                query, found, score = one(q_ids, q, c_ids, c)
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def _packed_group(block: str):
    def run(key, table):
        ids = table.column("vec_id").to_numpy()
        data = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.table({block: [key[0].as_py()], "dim": pa.array([key[1].as_py()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})

    return run


def _packed(df: DataFrame, block: str) -> DataFrame:
    """One row per block and length of vector: its ids and components end to end."""
    return df.groupBy(block, "dim").applyInArrow(_packed_group(block), f"{block} long, dim int, ids binary, data binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best inner products of each row of queries with the rows of vectors of
    other ids, ties to the smaller vec_id; both (vec_id, v array<long>), as `scaled` makes them.

    Queries and candidates meet in blocks: every candidate block goes once to every query block. Vectors of different length
    never meet. Rows that share an id: each is a candidate of its own, and as queries they are one (the first vector in
    order). Fewer candidates than k: all of them. No rows: no rows. Scores are exact below 2^63."""
    n_queries, n_rows = queries.count(), vectors.count()
    q_blocks, c_blocks = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n_rows // CANDIDATE_BLOCK))
    one_each = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    dim = F.size("v").alias("dim")
    q = one_each.select("vec_id", "v", dim, F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).alias("q_block"))
    q = _packed(q, "q_block").select("q_block", "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    c = vectors.select("vec_id", "v", dim, F.pmod(F.xxhash64("vec_id", "v"), F.lit(c_blocks)).alias("c_block"))
    c = cut_lineage(_packed(c, "c_block"))
    spread = c.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))
    met = spread.join(q, ["q_block", "dim"]).select("q_block", "c_block", "q_ids", "q_data", "ids", "data")
    # the join brings a query block's rows together; every pair of blocks is a piece of work of its own
    met = met.repartition(max(q_blocks * c_blocks, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "q_block", "c_block")
    best = met.select("q_ids", "q_data", "ids", "data").mapInArrow(_block_top(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
