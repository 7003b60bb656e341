"""Connected components against a plain union of sets, near names against edit distances."""

import random

from pyspark.sql import functions as F

from rollbook.links import components
from rollbook.operators import identity


def plain(pairs):
    leader = {}

    def find(x):
        while leader.setdefault(x, x) != x:
            x = leader[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        leader[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(leader)}


def test_components(spark):
    r = random.Random(7)
    chain = [(i, i + 1) for i in range(1000, 1200)]
    star = [(2000, 2001 + i) for i in range(100)]
    noise = [(r.randrange(300), r.randrange(300)) for _ in range(180)]
    pairs = [*chain, *star, *noise, (5000, 5000)]
    links = spark.createDataFrame([*pairs, *pairs[:50], (None, 3), (9, None)], "a long, b long")
    got = {x["node"]: x["component"] for x in components(links).collect()}
    assert got == plain(pairs)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_text_nodes(spark):
    links = spark.createDataFrame([("u/1", "i/2"), ("i/2", "u/3"), ("u/9", "u/9")], "a string, b string")
    assert {x["node"]: x["component"] for x in components(links).collect()} == {"u/1": "i/2", "i/2": "i/2", "u/3": "i/2", "u/9": "u/9"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def near_words(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("ab") for _ in range(r.choice([6, 7, 11, 12, 13]))) for _ in range(40)]
    for w in words[:25]:
        for _ in range(r.choice([1, 2, 3])):
            i = r.randrange(len(w))
            w = r.choice([w[:i] + r.choice("abc") + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + r.choice("abc") + w[i:]])
        words.append(w)
    return words


def test_edit_keys_meet_exactly_within_the_radius(spark):
    words = near_words(5)
    df = spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "w string")
    for radius in (1, 2):
        a = df.select(F.col("w").alias("a"), F.explode(identity.edit_keys(F.col("w"), radius, True)).alias("k"))
        b = df.select(F.col("w").alias("b"), F.explode(identity.edit_keys(F.col("w"), radius, False)).alias("k"))
        got = {(r["a"], r["b"]) for r in a.join(b, "k").select("a", "b").distinct().collect()}
        assert got == {(x, y) for x in set(words) for y in set(words) if distance(x, y) <= radius}


def test_near_names_equal_a_comparison_of_all(spark):
    words = near_words(6)
    people = spark.createDataFrame([(1, i, w, [], True) for i, w in enumerate(words[::2])], "school_id int, teacher_id long, name string, aliases array<string>, active boolean")
    names = spark.createDataFrame([(1, w) for w in words], "school_id int, raw string")
    got = {r["raw"]: r["teacher_id"] for r in identity.fuzzy_resolve(names, people).collect()}
    want = {}
    for q in words:
        near = {i for i, d in enumerate(words[::2]) if len(q) >= 6 and len(d) >= 6 and distance(q, d) <= (2 if len(q) >= 12 else 1)}
        if len(near) == 1:
            want[q] = near.pop()
    assert got == want


def test_dense_names_stop_at_two_owners(spark):
    """A thousand people whose names differ in one letter of one place meet an asked name through few rows."""
    people = spark.range(1000).selectExpr("1 AS school_id", "id AS teacher_id", "concat('samename', char(97 + id % 26), 'x') AS name", "array(concat('othername', lpad(id, 4, '0'))) AS aliases", "true AS active")
    names = spark.createDataFrame([(1, "samenamezx"), (1, "othername00")], "school_id int, raw string")
    assert identity.fuzzy_resolve(names, people).count() == 0


def test_near_words_share_a_piece(spark):
    """Who shares no piece gets no edit keys: every pair within the radius must share one, a word far from all names none."""
    r = random.Random(5)
    rows = []
    for _ in range(300):
        radius = r.choice((1, 2))
        q = "".join(r.choice("abc") for _ in range(r.randrange(12, 19) if radius == 2 else r.randrange(6, 12)))
        d = list(q)
        for _ in range(r.randrange(radius + 1)):
            at = r.randrange(len(d))
            d[at : at + r.choice((0, 1))] = r.choice(("", "a", "x", "c"))
        rows.append((radius, q, "".join(d)))
    near = spark.createDataFrame(rows, "radius int, q string, d string")
    shared = F.size(F.array_intersect(identity._pieces_asked(F.col("q"), F.col("radius")), identity._pieces_near(F.col("d"), F.col("radius")))) > 0
    assert near.filter(~shared).count() == 0
    far = near.withColumn("d", F.lit("customer#000000001"))
    assert far.filter(shared).count() == 0
