"""Who a printed name means: directory look-up in tiers, look-alike suggestions, logins.

All matching runs on distinct names and distinct keys, never on rows, so a name printed a billion times costs as
much as one printed once. Edit distance joins go through deletion neighbourhoods: two strings within k edits share
a string left after at most k deletions from each, and distinct keys sharing one such string are few by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.clock import let
from rollbook.functions.people import CODE_LIKE, classify, code_prefix, code_stem, same_post, username_base
from rollbook.functions.text import look_alike, match_key
from rollbook.keyed import first_rows, numbered, running_last, with_value

BY = ("school_id",)
MAX_HOPS = 5


def distinct_names(facts: Sequence[DataFrame], by: Sequence[str] = BY) -> DataFrame:
    """(by, raw) over the `teacher_name` of several facts, trimmed, without blanks."""
    out = None
    for f in facts:
        part = f.select(*by, F.trim("teacher_name").alias("raw")).filter(F.col("raw") != "")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def follow_aliases(names: DataFrame, mapping: DataFrame, by: Sequence[str] = BY, depth: int = MAX_HOPS) -> DataFrame:
    """Follow "SAME:<other printed name>" answers for at most `depth` hops.

    Adds `name` (the printed name at the end of the chain) and `target` (its own answer, if any)."""
    # one answer per trimmed text (the smallest, if several were given), so that no hop multiplies rows
    answers = mapping.groupBy(*by, F.trim("raw").alias("name")).agg(F.min("target").alias("target"))
    out = names.withColumn("name", F.trim("raw")).join(answers, [*by, "name"], "left")
    for _ in range(depth):
        hop = F.startswith(F.coalesce("target", F.lit("")), F.lit("SAME:"))
        nxt = out.select(*names.columns, F.when(hop, F.trim(F.substr("target", F.lit(6)))).otherwise(F.col("name")).alias("name"))
        out = nxt.join(answers, [*by, "name"], "left")
    return out.select(*names.columns, "name", "target")


def directory_keys(people: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(by, space, key, teacher_id) for names with aliases and for codes; keys two people own are left out."""
    words = F.concat(
        F.array(F.struct(F.lit("name").alias("space"), match_key(F.col("name")).alias("key"))),
        F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit("name").alias("space"), match_key(a).alias("key"))),
        F.array(F.struct(F.lit("code").alias("space"), match_key(F.coalesce("code", F.lit(""))).alias("key"))),
    )
    rows = people.filter("active").select(*by, "teacher_id", F.explode(words).alias("w")).select(*by, "w.space", "w.key", "teacher_id").filter("key <> ''")
    g = rows.groupBy(*by, "space", "key").agg(F.min("teacher_id").alias("teacher_id"), F.max("teacher_id").alias("_max"))
    return g.filter(F.col("teacher_id") == F.col("_max")).drop("_max")


def _lookups(text: Column) -> Column:
    """Ordered look-ups of a printed name: array of struct(slot, space, key); slots from 10 on are its parts."""

    def one(slot: Column | int, space: str, key: Column) -> Column:
        return F.struct((F.lit(slot) if isinstance(slot, int) else slot).alias("slot"), F.lit(space).alias("space"), key.alias("key"))

    def build(v: Column) -> Column:
        p, key = v["p"], v["key"]
        person = p["kind"] == "person"
        whole = F.array(
            one(1, "name", F.when(person, match_key(p["name"]))), one(2, "code", F.when(person, match_key(p["code"]))), one(3, "name", key), one(4, "code", key)
        )
        split = F.transform(F.split(v["text"], r"[()/,;]| - | – "), match_key)
        parts = F.filter(split, lambda x: F.length(x) >= 2)
        by_part = F.flatten(F.transform(parts, lambda x, i: F.array(one(i + 10, "name", x), one(i + 10, "code", x))))
        return F.when(F.size(parts) > 1, F.concat(whole, by_part)).otherwise(whole)

    return let(F.struct(text.alias("text"), classify(text).alias("p"), match_key(text).alias("key")), build)


def resolve_names(names: DataFrame, people: DataFrame, mapping: DataFrame | None = None, by: Sequence[str] = BY) -> DataFrame:
    """(by, raw) to a directory teacher or null, and whether the reviewer chose to create the person.

    Tiers: the reviewer's answer, the person's name, the printed code, the whole text as name, as code, and last
    the one person its parts hit. A key owned by two people resolves to nothing."""
    names = names.select(*by, "raw").distinct()
    if mapping is None:
        chained = names.withColumn("name", F.trim("raw")).withColumn("target", F.lit(None).cast("string"))
    else:
        chained = follow_aliases(names, mapping, by)
    known = people.filter("active").select(*by, F.col("teacher_id").alias("mapped_id")).distinct()
    chained = chained.withColumn("mapped_id", F.col("target").try_cast("bigint")).join(known.withColumn("_known", F.lit(True)), [*by, "mapped_id"], "left")
    chained = chained.withColumn("mapped_id", F.when(F.col("_known"), F.col("mapped_id"))).drop("_known")

    asked = chained.filter(F.col("mapped_id").isNull()).select(*by, "name").distinct()
    tries = asked.select(*by, "name", F.explode(_lookups(F.col("name"))).alias("t")).select(*by, "name", "t.*").filter("key <> ''")
    hits = tries.join(directory_keys(people, by), [*by, "space", "key"])
    per_slot = hits.groupBy(*by, "name", "slot").agg(F.max_by("teacher_id", "space").alias("teacher_id"))  # a name hit before a code hit
    part = F.when(F.col("slot") >= 10, F.col("teacher_id"))
    found = per_slot.groupBy(*by, "name").agg(
        F.min_by("teacher_id", F.when(F.col("slot") < 10, F.col("slot"))).alias("_whole"), F.min(part).alias("_pmin"), F.max(part).alias("_pmax")
    )
    found = found.select(*by, "name", F.coalesce("_whole", F.when(F.col("_pmin") == F.col("_pmax"), F.col("_pmin"))).alias("_found"))
    out = chained.join(found, [*by, "name"], "left")
    return out.select(*by, "raw", F.coalesce("mapped_id", "_found").alias("teacher_id"), F.coalesce(F.col("target") == "NEW", F.lit(False)).alias("is_new"))


# ---------------------------------------------------------------- near spellings


def _less_one(s: Column) -> Column:
    """The string and every string with one character left out."""
    return F.array_distinct(F.concat(F.array(s), _one_off(s, "")))


def deletions(s: Column, k: int) -> Column:
    """Hashes of the strings left after at most k (1 or 2) deletions; s must not be empty."""
    out = _less_one(s)
    for _ in range(k - 1):
        out = F.array_distinct(F.flatten(F.transform(out, _less_one)))
    return F.transform(out, lambda x: F.xxhash64(x))


def _one_off(s: Column, put: str) -> Column:
    """The string with each of its characters in turn replaced by `put`."""
    at = F.sequence(F.lit(1), F.length(s))
    return F.array_distinct(F.transform(at, lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.lit(put), F.substr(s, i + 1))))


def _variants(s: Column, changed: int, left_out: int) -> Column:
    """The strings that come of marking `changed` characters as changed and leaving `left_out` out."""
    out = F.array(s)
    for put in ["?"] * changed + [""] * left_out:
        out = _spread_one(out, put)
    return out


def _spread_one(strings: Column, put: str) -> Column:
    return F.array_distinct(F.flatten(F.transform(strings, lambda x: _one_off(x, put))))


def edit_keys(s: Column, radius: int, asked: bool) -> Column:
    """Keys that two strings share exactly when they are within `radius` edits (1 or 2): one of them as `asked`, the other not.

    Edits that turn the asked string into the other are c changes, o left out and m put in, c + o + m <= radius. The asked
    string with c marks and o characters left out is then the other with c marks and m left out, so that (c, o, m, that text)
    is a key of both; and any shared key is such a way. s must be longer than the radius and hold no question mark."""
    parts = []
    for c in range(radius + 1):
        for own in range(radius + 1 - c):
            texts = _variants(s, c, own)
            for other in range(radius + 1 - c - own):
                kind = f"{c}{own}{other}" if asked else f"{c}{other}{own}"
                parts.append(F.transform(texts, _keyed(kind)))
    return F.flatten(F.array(*parts))


def _keyed(kind: str):
    return lambda t: F.struct(F.xxhash64(F.lit(kind), t).alias("k"), F.hash(F.lit(kind), t).alias("h"))


def _pieces_asked(s: Column, radius: Column) -> Column:
    """radius + 1 pieces of an asked string, hashed with radius, length and number: edits within the radius leave one of them whole."""
    def piece(i: Column) -> Column:
        start, end = _cut(F.length(s), i, radius), _cut(F.length(s), i + 1, radius)
        return F.xxhash64(radius, F.length(s), i, F.substr(s, start + 1, end - start))

    return F.transform(F.sequence(F.lit(0), radius), piece)


def _pieces_near(s: Column, radius: Column) -> Column:
    """The pieces of every string within `radius` edits that s could hold whole: at the same place or up to `radius` letters off."""
    around = F.sequence(-radius, radius)

    def pieces(long: Column) -> Column:
        def piece(i: Column) -> Column:
            start, end = _cut(long, i, radius), _cut(long, i + 1, radius)
            at = F.filter(F.transform(around, lambda d: start + d), lambda a: (a >= 0) & (a + end - start <= F.length(s)))
            return F.transform(at, lambda a: F.xxhash64(radius, long, i, F.substr(s, a + 1, end - start)))

        return F.flatten(F.transform(F.sequence(F.lit(0), radius), piece))

    return F.array_distinct(F.flatten(F.transform(F.transform(around, lambda d: F.length(s) + d), pieces)))


def _cut(long: Column, i: Column, radius: Column) -> Column:
    """Where the i-th of radius + 1 pieces of a string of some length begins."""
    return F.floor(long * i / (radius + 1)).cast("int")


def fuzzy_resolve(names: DataFrame, people: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """J11 (opt-in): names with a key of 6+ letters to the only person within one edit (two from 12 letters on).

    People's words that hold no piece of an asked name in place are left out before edit keys are made, which are some 700 for a word
    of 18 letters. Every key is reduced to its first and last owner before names meet it: however many people have nearly the same name, an asked
    name meets each of its keys once and needs no further comparison."""
    asked = with_value(names.select(*by, "raw"), "q", match_key(F.col("raw"))).filter(F.length("q") >= 6)
    q = asked.select(*by, "q", F.when(F.length("q") >= 12, 2).otherwise(1).alias("radius")).distinct()
    words = F.concat(F.array(match_key(F.col("name"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), match_key))
    owners = people.filter("active").select(*by, "teacher_id", F.explode(words).alias("d")).filter(F.length("d") >= 6)
    owners = owners.groupBy(*by, "d").agg(F.min("teacher_id").alias("lo"), F.max("teacher_id").alias("hi"))

    def spread(df: DataFrame, c: str, is_asked: bool) -> DataFrame:
        near = F.when(F.col("radius") == 2, edit_keys(F.col(c), 2, is_asked)).otherwise(edit_keys(F.col(c), 1, is_asked))
        return df.withColumn("_v", F.explode(near))

    radii = F.when(F.length("d") >= 10, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    owners = owners.withColumn("radius", F.explode(radii))
    pieces = q.select(*by, F.explode(_pieces_asked(F.col("q"), F.col("radius"))).alias("_p")).distinct()
    owned = owners.select(*by, "d", "radius", F.explode(_pieces_near(F.col("d"), F.col("radius"))).alias("_p"))
    likely = owned.join(pieces, [*by, "_p"], "left_semi").select(*by, "d", "radius").distinct()
    right = spread(owners.join(likely, [*by, "d", "radius"], "left_semi"), "d", False).groupBy(*by, "radius", "_v").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    near = spread(q, "q", True).join(right, [*by, "radius", "_v"])
    only = near.groupBy(*by, "q").agg(F.min("lo").alias("teacher_id"), F.max("hi").alias("_hi")).filter(F.col("teacher_id") == F.col("_hi")).drop("_hi")
    return asked.join(only, [*by, "q"]).select(*by, "raw", "teacher_id")


def suggest_names(uses: DataFrame, resolved: DataFrame, mapping: DataFrame, people: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """For an unresolved, unanswered name - a common spelling of the same draft (used at least 4 times and three
    times as often) or a directory entry that differs by look-alike characters or, for names, by one letter.

    Codes must match exactly after folding. Nearest first, then the more used, then label order."""
    u = with_value(uses, "key", look_alike(F.col("name"))).filter(F.length("key") >= 4).withColumn("code_like", F.col("name").rlike(CODE_LIKE))
    open_names = resolved.filter(F.col("teacher_id").isNull()).select(*by, F.col("raw").alias("name"))
    asked = u.join(open_names, [*by, "name"], "left_semi").join(mapping.select(*by, F.trim("raw").alias("name")), [*by, "name"], "left_anti")
    asked = asked.select(*by, "name", F.col("uses").alias("n"), F.col("key").alias("a"), F.col("code_like").alias("asked_code"))

    # two per key suffice: only the asked name itself may have to be skipped
    common = first_rows(u, [*by, "key", "code_like"], F.col("uses").desc(), F.col("name"), k=2)
    common = common.filter("uses >= 4").select(*by, "key", "code_like", F.col("name").alias("label"), F.col("uses").alias("count"))
    words = F.array_compact(F.concat(F.array("name", "code"), F.coalesce("aliases", F.array().cast("array<string>"))))
    known = people.filter("active").select(*by, F.col("name").alias("label"), F.explode(F.transform(words, look_alike)).alias("key"))
    known = known.filter(F.length("key") >= 4).withColumn("code_like", F.col("label").rlike(CODE_LIKE))
    known = known.groupBy(*by, "key", "code_like").agg(F.min("label").alias("label")).withColumn("count", F.lit(0).cast("long"))
    side = common.unionByName(known).withColumn("_v", F.explode(deletions(F.col("key"), 1)))

    pairs = asked.withColumn("_v", F.explode(deletions(F.col("a"), 1))).join(side, [*by, "_v"])
    limit = F.when(F.col("asked_code") | F.col("code_like"), 0).otherwise(1)
    dist = F.when(F.col("a") == F.col("key"), 0).otherwise(F.levenshtein("a", "key", 1))
    enough = (F.col("count") == 0) | ((F.col("label") != F.col("name")) & (F.col("count") >= F.greatest(F.lit(4), F.col("n") * 3)))
    pairs = pairs.withColumn("distance", dist).filter((F.col("distance") >= 0) & (F.col("distance") <= limit) & enough)
    best = first_rows(pairs, [*by, "name"], F.col("distance"), F.col("count").desc(), F.col("label"))
    return best.select(*by, "name", F.col("label").alias("suggestion"), "distance")


def suggest_by_code(names: DataFrame, people: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """A printed post code that abbreviates the code of exactly one person.

    Joined on prefix and the first two stem letters: the shorter stem must have two and start the longer."""
    def post(c: Column) -> Column:
        return F.struct(code_prefix(c).alias("prefix"), code_stem(c).alias("stem"))

    parsed = with_value(names.select(*by, F.col("raw").alias("name")), "p", let(classify(F.col("name")), lambda p: F.when(p["kind"] == "code", post(p["code"]))))
    parsed = parsed.select(*by, "name", "p.prefix", "p.stem").filter(F.col("prefix").isNotNull())
    posts = parsed.select(*by, "prefix", "stem").distinct().withColumn("block", F.substring("stem", 1, 2))

    words = F.array_compact(F.concat(F.array("code"), F.coalesce("aliases", F.array().cast("array<string>"))))
    held = people.filter("active").select(*by, "teacher_id", F.explode(F.transform(words, post)).alias("c"))
    held = held.select(*by, "teacher_id", F.col("c.prefix").alias("own_prefix"), F.col("c.stem").alias("own_stem")).filter(F.col("own_prefix").isNotNull())
    held = held.groupBy(*by, "own_prefix", "own_stem").agg(F.min("teacher_id").alias("lo"), F.max("teacher_id").alias("hi"))
    held = held.withColumn("prefix", F.col("own_prefix")).withColumn("block", F.substring("own_stem", 1, 2))

    match = posts.join(held, [*by, "prefix", "block"]).filter(same_post(F.col("prefix"), F.col("stem"), F.col("own_prefix"), F.col("own_stem")))
    owner = match.groupBy(*by, "prefix", "stem").agg(F.min("lo").alias("teacher_id"), F.max("hi").alias("_hi")).filter(F.col("teacher_id") == F.col("_hi"))
    out = parsed.join(owner.drop("_hi"), [*by, "prefix", "stem"])
    label = people.select(*by, "teacher_id", F.col("name").alias("suggestion"))
    return out.join(label, [*by, "teacher_id"]).select(*by, "name", "teacher_id", "suggestion")


# ---------------------------------------------------------------- look-alike spellings (G16), rename


def spelling_map(values: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(by, spelling, canonical): spellings of one folded key (3+ characters) to the most used, then longest one."""
    pool = values.select(*by, F.trim("spelling").alias("spelling")).filter(F.col("spelling") != "").groupBy(*by, "spelling").agg(F.count(F.lit(1)).alias("n"))
    pool = with_value(pool, "key", look_alike(F.col("spelling"))).filter(F.length("key") >= 3)
    best = pool.groupBy(*by, "key").agg(F.min_by("spelling", F.struct(-F.col("n"), -F.length("spelling"), F.col("spelling"))).alias("canonical"))
    return pool.join(best, [*by, "key"]).filter(F.col("spelling") != F.col("canonical")).select(*by, "spelling", "canonical")


def _rewritten(df: DataFrame, column: str, spellings: DataFrame, by: Sequence[str], cap: float | None) -> DataFrame:
    side = spellings.select(*by, F.col("spelling").alias("_trim"), "canonical")
    out = df.withColumn("_trim", F.trim(column)).join(side, [*by, "_trim"], "left")
    if cap is not None:
        lowered = F.when(F.col("canonical").isNotNull() & F.col("confidence").isNotNull(), F.least("confidence", F.lit(cap))).otherwise(F.col("confidence"))
        out = out.withColumn("confidence", lowered)
    return out.withColumn(column, F.coalesce("canonical", column)).drop("_trim", "canonical")


def merge_look_alikes(facts: dict[str, DataFrame], by: Sequence[str] = BY, cap: float = 0.85) -> dict[str, DataFrame]:
    """Rewrite subjects and teachers that differ only by look-alikes, case or punctuation to the usual spelling.

    `facts` may hold period, remedial, duty and off; only the first two carry subjects and lose confidence."""
    def lessons(df: DataFrame) -> DataFrame:
        return df.filter(~F.col("is_break")) if "is_break" in df.columns else df

    subject_of = {"period": "subject", "remedial": "activity"}
    teachers = [lessons(df).select(*by, F.col("teacher_name").alias("spelling")) for df in facts.values()]
    subjects = [lessons(facts[k]).select(*by, F.col(c).alias("spelling")) for k, c in subject_of.items() if k in facts]

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    names = spelling_map(union(teachers), by)
    topics = spelling_map(union(subjects), by) if subjects else None
    result = {}
    for kind, df in facts.items():
        soft = cap if kind in subject_of else None
        todo, rest = (df.filter(~F.col("is_break")), df.filter("is_break")) if "is_break" in df.columns else (df, None)
        if kind in subject_of:
            todo = _rewritten(todo, subject_of[kind], topics, by, soft)
        todo = _rewritten(todo, "teacher_name", names, by, soft)
        result[kind] = todo.select(*df.columns) if rest is None else todo.select(*df.columns).unionByName(rest)
    return result


def rename_spelling(df: DataFrame, pairs: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Exact rewrite of printed names; a renamed row counts as entered by hand (no confidence)."""
    side = pairs.select(*by, F.col("old").alias("_trim"), F.col("new").alias("_new"))
    out = df.withColumn("_trim", F.trim("teacher_name")).join(side, [*by, "_trim"], "left")
    out = out.withColumn("confidence", F.when(F.col("_new").isNull(), F.col("confidence"))).withColumn("teacher_name", F.coalesce("_new", "teacher_name"))
    return out.select(*df.columns)


# ---------------------------------------------------------------- logins


def unique_usernames(people: DataFrame, users: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Base, base2, base3 ... in name order, skipping names already taken.

    A number of more than 18 digits in a taken name is never reached by counting and is not read.
    The k-th free number of a base is k plus the taken numbers at or before it: taken numbers and people are laid
    on one line per base and the last count is carried down, so one very common name is still many tasks."""
    rows = numbered(people.withColumn("base", username_base(F.col("name"))), [*by, "base"], ["name", "teacher_id"], "k")

    low = F.lower("username")
    tails = F.transform(F.sequence(F.lit(1), F.least(F.lit(18), F.greatest(F.lit(1), F.length("username")))), lambda i: F.struct(F.left(F.lower("username"), F.length("username") - i).alias("base"), F.right(F.lower("username"), i).alias("tail")))
    split = users.select(*by, F.explode(tails).alias("s")).select(*by, "s.base", "s.tail").filter(F.col("tail").rlike("^[1-9][0-9]*$") & (F.col("base") != ""))
    taken = users.select(*by, low.alias("base"), F.lit(1).cast("long").alias("idx")).unionByName(
        split.select(*by, "base", F.col("tail").cast("long").alias("idx")).filter("idx >= 2")
    )
    taken = numbered(taken.distinct(), [*by, "base"], ["idx"], "i")
    marks = taken.groupBy(*by, "base", (F.col("idx") - F.col("i") + 1).alias("k")).agg(F.max("i").cast("long").alias("skipped"))

    line = marks.select(*by, "base", "k", "skipped", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("teacher_id"), F.lit(None).cast("string").alias("name")).unionByName(
        rows.select(*by, "base", "k", F.lit(None).cast("long").alias("skipped"), F.lit(1).alias("_kind"), "teacher_id", "name")
    )
    line = line.withColumn("_at", F.col("k").cast("long") * 2 + F.col("_kind"))
    out = running_last(line, [*by, "base"], ["_at"], ["skipped"]).filter("_kind = 1")
    number = F.col("k") + F.coalesce("skipped", F.lit(0).cast("long"))
    return out.select(*by, "teacher_id", "name", F.when(number == 1, F.col("base")).otherwise(F.concat("base", number.cast("string"))).alias("username"))
