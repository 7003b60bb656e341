"""A Merkle manifest of a table: leaves per row, trees per group, one root over the groups, and a proof for every row.

All tree work is equijoins of nodes with their siblings at computed places: at each level a node meets the nodes of its run by
(group, place), and the node in slot zero emits the parent. Proofs go back down by joins of a node with its parent, so that no
group, however large, is ever gathered in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.keyed import numbered
from rollbook.session import written

#: Nodes of a level up to which it is written as one file. Spark sees a level's size and may broadcast it by its own threshold.
SMALL_LEVEL = 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """The sha256 of the parts end to end, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_text(bytes_: Column) -> Column:
    return F.lower(F.hex(bytes_))


def _left(siblings: Sequence[tuple[Column, Column]], slot: Column) -> tuple[Column, Column]:
    """(digests left of a node, digests right of it) from (offset slot, digest) of the run's others, in order of their slots."""
    known = F.array_sort(F.filter(F.array(*[F.struct(s.alias("slot"), d.alias("digest")) for s, d in siblings]), lambda x: x["digest"].isNotNull()))
    joined = lambda kept: F.aggregate(kept, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["digest"]))
    return joined(F.filter(known, lambda x: x["slot"] < slot)), joined(F.filter(known, lambda x: x["slot"] > slot))


def _above(fanout: int) -> Column:
    """The number of nodes that `n` nodes become."""
    return F.expr(f"(n + {fanout - 1}) div {fanout}")


def climb(nodes: DataFrame, widest: int, total: int, groups: int, fanout: int = 2, kept: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """(levels from the leaves up, tops) of nodes (group, n, place, digest), where n is the group's number of nodes and places
    count from 0.

    Every level is a written table (group, n, place, digest, left, right): `left` and `right` are the digests of the other
    nodes of its run, end to end; the lowest one has the columns `kept` too. A group's top is its last remaining node, with n = 1;
    a group of one node is its own top. `widest` is the most nodes of a group, `total` the nodes of all."""
    levels, tops = [], nodes.where("n = 1").select("group", "digest")
    nodes = nodes.where("n > 1")
    while widest > 1:
        slot = F.col("place") % fanout
        other = nodes.select("group", F.col("place").alias("__at"), F.col("digest").alias("__digest"))
        met, siblings = nodes, []
        for step in range(1, fanout):
            # two to a run: the place with its last bit flipped; else the slot `step` further on, around the run
            at = F.col("place").bitwiseXOR(F.lit(1)) if fanout == 2 else F.col("place") - slot + (slot + step) % fanout
            side = other.select("group", F.col("__at").alias(f"__at{step}"), F.col("__digest").alias(f"__digest{step}"))
            met = met.withColumn(f"__at{step}", at).join(side, ["group", f"__at{step}"], "left")
            siblings.append((F.col(f"__at{step}") % fanout, F.col(f"__digest{step}")))
        left, right = _left(siblings, slot)
        level = met.select("group", "n", "place", "digest", left.alias("left"), right.alias("right"), *(kept if not levels else ()))
        level = written(level.coalesce(1) if total <= SMALL_LEVEL else level)
        levels.append(level)
        parent = digest(as_text(F.col("digest")), as_text(F.col("right")))
        parents = level.where(F.col("place") % fanout == 0).select("group", _above(fanout).alias("n"), F.expr(f"place div {fanout}").alias("place"), parent.alias("digest"))
        tops = tops.unionByName(parents.where("n = 1").select("group", "digest"))
        nodes = parents.where("n > 1")
        widest, total = -(-widest // fanout), total // fanout + groups
    return levels, written(tops)


def descend(levels: list[DataFrame], tops: DataFrame, fanout: int = 2, kept: Sequence[str] = ()) -> DataFrame:
    """(group, place, top, proof, kept columns) of the lowest level's nodes, from tops (group, top, above), where `above` is the
    proof of the top and `proof` leads from the node up: an array of (left, right), one entry a level."""
    tops = written(tops)
    below = None
    for i in range(len(levels) - 1, -1, -1):
        more = kept if i == 0 else ()
        rows = levels[i].select("group", _above(fanout).alias("__above"), "place", F.array(F.struct("left", "right")).alias("__step"), *more)
        # a group whose tree ends here starts from its top, every other node from its parent
        told = rows.where("__above = 1").join(tops, "group").select("group", "place", "top", F.concat("__step", "above").alias("proof"), *more)
        if below is not None:
            parent = below.select("group", F.col("place").alias("__up"), "top", F.col("proof").alias("__proof"))
            inner = rows.where("__above > 1").withColumn("__up", F.expr(f"place div {fanout}"))
            told = told.unionByName(inner.join(parent, ["group", "__up"]).select("group", "place", "top", F.concat("__step", "__proof").alias("proof"), *more))
        below = written(told) if i else told  # a plan over several levels takes the driver longer than their jobs
    return below


def fold(start: Column, proof: Column) -> Column:
    """The top that a proof leads to from a leaf (32 bytes each)."""
    return F.aggregate(proof, start, lambda acc, x: digest(as_text(x["left"]), as_text(acc), as_text(x["right"])))


def _numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with `place` from 0 inside their key, in order, by equal ranges of (key, order)."""
    return numbered(rows, [key], order, "place").withColumn("place", F.col("place") - 1)


def manifest(docs: DataFrame, fanout: int = 2) -> DataFrame:
    """One row per row of docs (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the sha256 of the five fields, each `-` if null, else its UTF-8 byte count, `:` and the value. Per lang, leaves
    stand by doc_id (null first); every `fanout` consecutive nodes become the sha256 of their lowercase hex texts, a last run of
    fewer too, until one is left, the subroot. Subroots by lang (null first, else by bytes) make the root in the same way.
    proof_sha256 is the sha256 of the digests of the run's others, level by level from the leaf to the root, left to right (no
    others at all: of nothing).

    folded_root is what the proof gives from the row as tampering left it: where 7 divides crc32 of the decimal doc_id, n_chars
    is one more (nulls stay, and rows without doc_id are not tampered). verified tells whether it is the root.

    Rows that share a doc_id stand in the order of their leaves; rows that are equal throughout may swap places, which changes no
    digest but their proofs'. Empty text counts as a value of 0 bytes. No rows: no rows. Other columns are ignored."""
    lang = F.col("lang").cast("string")
    group = F.when(lang.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), lang))  # sorts null first, then by bytes
    values = {c: F.col(c) for c in FIELDS}
    more = values | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaf = lambda v: digest(*[field(v[c]) for c in FIELDS])
    leaves = docs.select(group.alias("group"), F.col("doc_id").cast("long").alias("doc_id"), leaf(values).alias("digest"), F.when(hit, leaf(more)).alias("tampered"))
    leaves = _numbered(leaves.select("*", F.monotonically_increasing_id().alias("row")), "group", ["doc_id", "digest", "row"])
    sizes = leaves.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    ranked = written(_numbered(sizes.withColumn("__all", F.lit("")), "__all", ["group"]))
    groups, total, widest = ranked.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    leaves = written(leaves.join(ranked.select("group", "n"), "group"))
    kept = ["doc_id", "tampered", "digest"]
    levels, tops = climb(leaves.select("group", "n", "place", *kept), widest, total, groups, fanout, kept[:2])

    # the same over the subroots, all in one group
    seats = tops.join(ranked.select("group", F.col("place").alias("seat")), "group")
    roof = seats.select(F.lit("").alias("group"), F.lit(groups).cast("long").alias("n"), F.col("seat").alias("place"), "digest")
    upper, top = climb(roof, groups, groups, 1, fanout)
    root = top.select("digest").first()
    root = root[0].hex() if root else ""
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    ends = seats.select("group", "seat", F.col("digest").alias("top"))
    if upper:
        over = descend(upper, top.select("group", F.col("digest").alias("top"), none.alias("above")), fanout)
        ends = ends.join(over.select(F.col("place").alias("seat"), F.col("proof").alias("above")), "seat")
    else:
        ends = ends.withColumn("above", none)
    ends = ends.select("group", "top", "above")

    told = leaves.where("n = 1").join(ends, "group").select(*kept, "top", F.col("above").alias("proof"))
    if levels:
        told = told.unionByName(descend(levels, ends, fanout, kept).select(*kept, "top", "proof"))
    shown = F.aggregate("proof", F.lit(""), lambda acc, x: F.concat(acc, as_text(x["left"]), as_text(x["right"])))
    folded = as_text(fold(F.coalesce("tampered", "digest"), F.col("proof")))
    return told.select(
        "doc_id",
        as_text(F.col("digest")).alias("leaf"),
        as_text(F.col("top")).alias("subroot"),
        F.lit(root).alias("root"),
        F.sha2(shown.cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
