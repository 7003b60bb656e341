"""The chunked helpers against plain windows, with chunks small enough to matter and one hot key."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollbook import keyed


def rows(spark):
    rnd = random.Random(3)
    data = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(5)}", rnd.randrange(6), i, rnd.choice([None, i])) for i in range(600)]
    return spark.createDataFrame(data, "k string, g int, seq long, v long")


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_numbered(spark):
    df = rows(spark)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("g", "seq")).cast("long"))
    same(keyed.numbered(df, ["k"], ["g", "seq"], bits=4).select("k", "seq", F.col("n").cast("long")), want.select("k", "seq", "n"))


def test_with_previous(spark):
    df = rows(spark)
    want = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("g", "seq")))
    same(keyed.with_previous(df, ["k"], ["g", "seq"], {"p": "v"}, bits=4).select("k", "seq", "p"), want.select("k", "seq", "p"))


def test_running_last(spark):
    df = rows(spark)
    w = Window.partitionBy("k").orderBy("g", "seq").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("v", F.last("v", True).over(w))
    same(keyed.running_last(df, ["k"], ["g", "seq"], ["v"], bits=4).select("k", "seq", "v"), want.select("k", "seq", "v"))


def test_later_and_first(spark):
    df = rows(spark)
    rn = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("seq")))
    same(keyed.later_rows(df, ["k"]).select("k", "seq"), rn.filter("rn > 1").select("k", "seq"))
    same(keyed.first_rows(df, ["k"], F.col("seq"), k=3).select("k", "seq"), rn.filter("rn <= 3").select("k", "seq"))


def test_top_rows_are_limited_before_the_shuffle(spark):
    plan = keyed.last_wins(rows(spark), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def sparse_rows(spark, n=20_000):
    """A hot key whose order values lie far apart, so that no two rows share a stretch of the order column."""
    return spark.range(n).selectExpr(
        "CASE WHEN id % 3 < 2 THEN 'hot' ELSE concat('k', id % 7) END AS k", "id * 1000003 * 1048576 AS seq", "CASE WHEN id % 5 = 0 THEN id END AS v"
    )


def test_sparse_hot_key_is_spread_and_little_is_carried(spark):
    df = sparse_rows(spark)
    rows = keyed._ranged(df, ["k"], ["seq"], 6).cache()
    sizes = [r["count"] for r in rows.groupBy("_range").count().collect()]
    assert len(sizes) > 32 and max(sizes) < 20_000 / 16
    hot = rows.filter("k = 'hot'").select("_range").distinct().count()
    assert hot > 20
    # one row a range goes over a border, whatever the keys
    ends = rows.groupBy("_range").agg(F.max(F.struct("k", "seq")))
    assert ends.count() == len(sizes) < 0.01 * 20_000


def test_sparse_hot_key_equals_plain_windows(spark):
    df = sparse_rows(spark)
    w = Window.partitionBy("k").orderBy("seq")
    want = df.select("k", "seq", F.row_number().over(w).cast("long").alias("n"), F.lag("v").over(w).alias("p"), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("l"))
    n = keyed.numbered(df, ["k"], ["seq"], bits=6).select("k", "seq", "n")
    p = keyed.with_previous(df, ["k"], ["seq"], {"p": "v"}, bits=6).select("k", "seq", "p")
    last = keyed.running_last(df, ["k"], ["seq"], ["v"], bits=6).select("k", "seq", F.col("v").alias("l"))
    same(n.join(p, ["k", "seq"]).join(last, ["k", "seq"]).select("k", "seq", "n", "p", "l"), want)


def test_source_is_read_once(spark, tmp_path):
    df = sparse_rows(spark, 2000)
    df.write.parquet(str(tmp_path / "rows"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    counted = spark.read.parquet(str(tmp_path / "rows")).mapInPandas(count, "k string, seq long, v long")
    assert keyed.with_previous(counted, ["k"], ["seq"], {"p": "v"}, bits=3).count() == 2000
    assert seen.value == 2000


def test_empty_and_one_row(spark):
    df = rows(spark)
    assert keyed.numbered(df.limit(0), ["k"], ["seq"]).count() == 0
    assert keyed.with_previous(df.limit(0), ["k"], ["seq"], {"p": "v"}).count() == 0
    assert [r.n for r in keyed.numbered(df.limit(1), ["k"], ["seq"]).collect()] == [1]


def test_words_are_dealt_by_sheet(spark, views):
    """The tasks that build lines follow the parts the documents are read in, not the session's few partitions."""
    from rollbook.plans import layout

    parts = views.documents.rdd.getNumPartitions()
    assert layout.build_lines(views).rdd.getNumPartitions() >= layout.SHARE * parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
