"""Per-key building blocks that stay balanced when one key holds a large share of the rows.

`DataFrame.window` over a key puts the whole key into one task. The helpers here avoid that:

* first/last/top-k per key use `row_number() <= k`, which Spark limits per map task before the shuffle;
* "all but the first" joins rows back to a one-row-per-key aggregate (the skew join splits the large side);
* running computations (number, previous row, last value) cut the rows into ranges of (key, order) of about equal size, run inside each
  range, and carry one row over each border: a key that spans many ranges is spread over as many tasks.

Key columns must not be null; (key, order) should tell all rows apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.session import cut_lineage


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], bits: int | None) -> DataFrame:
    """Rows with `_range`, the number of their range: 2**bits ranges at most, or as many as the session shuffles to.

    The rows are checkpointed first, so that sampling the borders does not derive them a second time."""
    by = [F.col(c) for c in (*keys, *order)]
    kept = cut_lineage(df)
    dealt = kept.repartitionByRange(*by) if bits is None else kept.repartitionByRange(2**bits, *by)
    return dealt.withColumn("_range", F.spark_partition_id())


def _carried(rows: DataFrame, keys: Sequence[str], order: Sequence[str], tail: Column, over: Column, name: str) -> DataFrame:
    """Rows with `name`: what the earlier ranges of their key hand over, or null.

    Of a range only its last key can go on in the next one, so that one row a range is enough: `tail`, the value at its last row,
    folded over the ranges of that key by `over`, a running expression on column `_tail`."""
    last = F.struct(*keys, *order)
    ends = rows.groupBy("_range").agg(F.max_by(F.struct(F.struct(*keys).alias("_key"), tail.alias("_tail")), last).alias("_end")).select("_range", "_end.*")
    ends = ends.withColumn("_next", F.lead("_range").over(Window.orderBy("_range")))  # one row a range
    handed = ends.withColumn(name, over).select(F.col("_next").alias("_range"), *[F.col("_key")[k].alias(k) for k in keys], name)
    return rows.join(F.broadcast(handed.filter("_range IS NOT NULL")), ["_range", *keys], "left")


def _so_far():
    """The ranges up to here that end in the same key: at most one row a range."""
    return Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)


def first_rows(df: DataFrame, keys: Sequence[str], *order: Column, k: int = 1) -> DataFrame:
    """The first k rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def last_wins(df: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """The row with the highest `seq` of each key."""
    return first_rows(df, keys, F.col(seq).desc())


def later_rows(df: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Every row of a key but its first one by `seq`."""
    firsts = df.groupBy(*keys).agg(F.min(seq).alias("_first"))
    return df.join(firsts, list(keys)).filter(F.col(seq) > F.col("_first")).drop("_first")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "n", bits: int | None = None) -> DataFrame:
    """row_number() per key by `order` (ascending)."""
    inside = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)).cast("long")
    rows = cut_lineage(_ranged(df, keys, order, bits).withColumn("_in", inside))
    out = _carried(rows, keys, order, F.col("_in"), F.sum("_tail").over(_so_far()), "_before")
    return out.withColumn(name, F.col("_in") + F.coalesce("_before", F.lit(0))).drop("_in", "_before", "_range")


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str], bits: int | None = None) -> DataFrame:
    """lag(): add, under each new name, the value the row just before (per key, by `order`) holds."""
    packed = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    inside = F.lag(packed).over(Window.partitionBy("_range", *keys).orderBy(*order))
    rows = cut_lineage(_ranged(df, keys, order, bits).withColumn("_lag", inside))
    out = _carried(rows, keys, order, packed, F.col("_tail"), "_carry").withColumn("_prev", F.coalesce("_lag", "_carry"))
    return out.withColumns({n: F.col("_prev")[n] for n in values}).drop("_lag", "_carry", "_prev", "_range")


def running_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], bits: int | None = None) -> DataFrame:
    """Replace nulls of each value column by the last non-null one above (per key, by `order`)."""
    up = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut_lineage(_ranged(df, keys, order, bits).withColumns({v: F.last(v, ignorenulls=True).over(up) for v in values}))
    folded = F.struct(*[F.last(F.col("_tail")[v], ignorenulls=True).over(_so_far()).alias(v) for v in values])
    out = _carried(rows, keys, order, F.struct(*values), folded, "_above")
    return out.withColumns({v: F.coalesce(F.col(v), F.col("_above")[v]) for v in values}).drop("_above", "_range")


def with_value(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column as a generated one: later filters and projections refer to it and never copy its
    expression into themselves."""
    return df.select("*", F.explode(F.array(value)).alias(name))
