"""Connected components of a graph of links, by rounds of joins over checkpointed edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.session import brief_shuffles, cut_lineage


#: Rows of two numbers up to which a side of a join may be broadcast (about 24 MB); beyond, both sides are dealt by key.
SMALL_ROWS = 1_000_000
#: Links that one task of a round takes; fewer are not dealt over all partitions, each with files of its own.
TASK_ROWS = 100_000


def if_small(side: DataFrame, entries: str = "1") -> DataFrame:
    """`side`, a checkpointed frame of numbers, marked for broadcast if its counted entries (an SQL expression per row) allow it."""
    with brief_shuffles(side.sparkSession):
        total = side.agg(F.coalesce(F.sum(F.expr(entries)), F.lit(0))).first()[0]
    return F.broadcast(side) if total <= SMALL_ROWS else side


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b): the smallest node that it reaches.

    Alternating star contraction: every round replaces links by links to the smallest neighbour, until all
    links lead from a member to its component's smallest node. Self-links and repeated links change nothing.
    The driver sees one count and one checksum a round; edges stay in checkpoint files that survive lost executors."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = cut_lineage(e)
    last = None
    while True:
        with brief_shuffles(e.sparkSession):
            state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or state[0] == 0:
            break
        last = state
        e = e.coalesce(max(1, -(-state[0] // TASK_ROWS)))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        e = cut_lineage(small.select(F.col("u"), F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
    nodes = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def link_buckets(open_: DataFrame, linked: Callable[[DataFrame], DataFrame], comps: DataFrame | None = None, rounds: int | None = None) -> DataFrame | None:
    """(node, component) of the nodes that links tie, or None without buckets, where open_ is (key, node, score) and `linked`
    keeps of candidate pairs (a > b) those that are links.

    In a bucket, members are compared with a leader (the best score), not with each other; members that do not end in one
    component go on to rounds with eight times as many leaders, so that in the end every two members of a bucket were
    compared or are connected. `comps` are components known before; `rounds` ends after so many rounds, compared or not."""
    done, leaders_each = None, 1
    while rounds != 0 and not open_.isEmpty():
        rounds = None if rounds is None else rounds - 1
        rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "node"))
        leaders = cut_lineage(open_.withColumn("rank", rank).where(F.col("rank") <= leaders_each).select("key", F.col("node").alias("lead"), F.col("score").alias("lead_score")))
        # of two leaders, the one that stands later is the member
        pairs = open_.join(leaders, "key").where("score < lead_score OR (score = lead_score AND node > lead)").select(F.greatest("node", "lead").alias("a"), F.least("node", "lead").alias("b")).distinct()
        if comps is not None:
            ca, cb = (comps.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b"))
            pairs = pairs.join(ca, "a", "left").join(cb, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
            pairs = pairs if done is None else pairs.join(done, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs)
        done = pairs if done is None else done.unionByName(pairs)
        found = linked(pairs)
        comps = cut_lineage(components(found if comps is None else found.unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b")))))
        rest = open_.join(leaders.select("key", F.col("lead").alias("node")), ["key", "node"], "left_anti").join(comps, "node", "left").withColumn("c", F.coalesce("component", "node"))
        split = rest.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
        open_ = cut_lineage(rest.join(split, "key", "left_semi").select("key", "node", "score"))
        leaders_each *= 8
    return comps
