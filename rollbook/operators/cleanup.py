"""Directory clean-up: one record per person, codes folded into their holder, headings removed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.clock import let
from rollbook.functions.people import POST_START, classify, code_prefix, code_stem, person_key, same_post
from rollbook.functions.text import match_key
from rollbook.keyed import first_rows, with_value

BY = ("school_id",)
def _null() -> Column:
    return F.lit(None).cast("string")


def _blank(c: str) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def _keeper_order() -> list[Column]:
    """A record with a login, then the most used, then the shortest name, then the lowest id."""
    return [F.when(F.col("has_user"), 0).otherwise(1), -F.col("refs"), F.length("name"), F.col("teacher_id")]


def _shared_slot() -> Column:
    return F.contains("name", F.lit("/")) | F.col("name").rlike(r"\d\s*,\s*\d")


def _parsed(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add p: kind, name, code, designation of the record's text, its person key, and its code's prefix and stem."""

    def details(p: Column) -> Column:
        person = F.when(p["kind"] == "person", person_key(p["name"]))
        return F.struct(
            p["kind"].alias("kind"), p["name"].alias("name"), p["code"].alias("code"), p["designation"].alias("designation"),
            person.alias("person"), code_prefix(p["code"]).alias("prefix"), code_stem(p["code"]).alias("stem"),
        )

    out = with_value(rows, "p", let(classify(F.col("name")), details))
    return out.withColumn("kind", F.col("p.kind")).withColumn("person", F.col("p.person"))


def _persons(parsed: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per person: keeper, shortest clean name, first code and designation (keeper's own, then by id)."""
    rows = parsed.filter("kind = 'person'").withColumn("own_code", _blank("code")).withColumn("own_title", _blank("designation"))
    keep = F.struct(*_keeper_order())

    def first(c: Column) -> Column:
        return F.min_by(c, F.when(c.isNotNull(), F.col("teacher_id")))

    g = rows.groupBy(*by, "person").agg(
        F.min_by("teacher_id", keep).alias("keep_id"), F.min_by("name", keep).alias("keep_name"), F.min_by("own_code", keep).alias("_kc"), F.min_by("own_title", keep).alias("_kd"),
        F.min_by(F.col("p.name"), F.struct(F.length("p.name"), F.col("teacher_id"))).alias("final_name"),
        first(F.col("own_code")).alias("_c1"), first(F.col("p.code")).alias("_c2"), first(F.col("own_title")).alias("_d1"), first(F.col("p.designation")).alias("_d2"),
    )
    return g.select(
        *by, "person", "keep_id", "keep_name", "final_name", F.coalesce("_kc", "_c1", "_c2").alias("final_code"), F.coalesce("_kd", "_d1", "_d2").alias("final_designation"), F.col("_kc").alias("keep_code")
    )


def _posts(parsed: DataFrame, by: Sequence[str]) -> DataFrame:
    """The code records folded to distinct posts (prefix, stem): the persons holding such a code (first, last), and
    the record that stands for the post's group.

    Posts that one person holds go to that person. The others are tied where the stem of one (2+ letters) starts the stem of
    another under the same prefix; the shortest stem of such a component starts all others in it, so that it names the component
    and no walk over the ties is needed. Everything after the fold works on the vocabulary of posts, so a code entered very often
    is one row."""
    posts = _codes(parsed).groupBy(*by, "prefix", "stem").agg(F.min(F.struct(*_keeper_order())).alias("best")).withColumn("block", F.substring("stem", 1, 2))

    own = let(_blank("code"), lambda c: F.struct(code_prefix(c).alias("own_prefix"), code_stem(c).alias("own_stem")))
    printed = F.struct(F.col("p.prefix").alias("own_prefix"), F.col("p.stem").alias("own_stem"))
    held = parsed.filter("kind = 'person'").select(*by, "person", F.explode(F.array(own, printed)).alias("c"))
    held = held.select(*by, "person", F.col("c.own_prefix").alias("prefix"), "c.own_stem").filter(F.col("prefix").isNotNull())
    held = held.groupBy(*by, "prefix", "own_stem").agg(F.min("person").alias("lo"), F.max("person").alias("hi")).withColumn("block", F.substring("own_stem", 1, 2))
    fits = F.coalesce(same_post(F.col("prefix"), F.col("stem"), F.col("prefix"), F.col("own_stem")), F.lit(False))
    known = posts.join(held, [*by, "prefix", "block"], "left").groupBy(*by, "prefix", "stem", "block").agg(
        F.min("best").alias("best"), F.min(F.when(fits, F.col("lo"))).alias("lo"), F.max(F.when(fits, F.col("hi"))).alias("hi")
    )
    known = known.withColumn("one", F.coalesce(F.col("lo") == F.col("hi"), F.lit(False)))

    left = known.filter(~F.col("one"))
    short = left.filter((F.length("stem") >= 2) & (F.col("prefix") != "")).select(*by, "prefix", "block", F.col("stem").alias("rep"))
    starts = F.coalesce(F.startswith("stem", "rep"), F.lit(False))
    named = left.join(short, [*by, "prefix", "block"], "left").groupBy(*by, "prefix", "stem").agg(
        F.min("best").alias("best"), F.min("lo").alias("lo"), F.min_by("rep", F.when(starts, F.struct(F.length("rep"), F.col("rep")))).alias("rep")
    )
    group = Window.partitionBy(*by, "prefix", F.coalesce("rep", "stem"))
    named = named.withColumn("group_id", F.min("best").over(group)["teacher_id"])
    single = known.filter("one").select(*by, "prefix", "stem", "lo", "one", F.lit(None).cast("long").alias("group_id"))
    return named.select(*by, "prefix", "stem", "lo", F.lit(False).alias("one"), F.col("group_id").cast("long").alias("group_id")).unionByName(single)


def _codes(parsed: DataFrame) -> DataFrame:
    rows = parsed.filter(F.col("kind") == "code").filter(~_shared_slot())
    return rows.withColumn("prefix", F.coalesce("p.prefix", F.lit(""))).withColumn("stem", F.coalesce("p.stem", "p.code"))


def plan_cleanup(rows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """What happens to every directory record (teacher_id, name, code, designation, refs, hard_refs, has_user).

    action is delete, keep (with a reason), merge (into keep_id) or primary (the record others merge into)."""
    parsed = _parsed(rows, by)
    noise = parsed.filter("kind = 'garbage'")
    reason = (
        F.when(_blank("code").isNotNull() | F.col("has_user"), F.lit("has a code or login"))
        .when(F.col("hard_refs") > 0, F.lit("still used by timetable rows"))
        .otherwise(F.lit("not a person or a teacher code"))
    )
    noise = noise.withColumn("reason", reason).withColumn("action", F.when(F.col("reason").startswith("not a"), F.lit("delete")).otherwise(F.lit("keep")))
    noise = noise.select(*by, "teacher_id", "action", F.lit(None).cast("bigint").alias("keep_id"), "reason")

    persons = _persons(parsed, by)
    person_rows = parsed.filter("kind = 'person'").select(*by, "teacher_id", "person").join(persons.select(*by, "person", "keep_id"), [*by, "person"])
    person_rows = person_rows.select(
        *by, "teacher_id", F.when(F.col("teacher_id") == F.col("keep_id"), F.lit("primary")).otherwise(F.lit("merge")).alias("action"), "keep_id", F.lit("same person").alias("reason")
    )

    code_rows = parsed.filter("kind = 'code'")
    shared = code_rows.filter(_shared_slot()).select(*by, "teacher_id", F.lit("keep").alias("action"), F.lit(None).cast("bigint").alias("keep_id"), F.lit("two teachers share this slot").alias("reason"))

    lone = _codes(parsed).select(*by, "teacher_id", "prefix", "stem").join(_posts(parsed, by), [*by, "prefix", "stem"])
    holder = persons.select(*by, F.col("person").alias("lo"), F.col("keep_id").alias("_holder"))
    lone = lone.join(holder, [*by, "lo"], "left")
    keep = F.when(F.col("one"), F.col("_holder")).otherwise(F.col("group_id"))
    why = F.when(F.col("one"), F.lit("code of one person")).when(F.col("lo").isNotNull(), F.lit("code matches several people")).otherwise(F.lit("same code"))
    lone = lone.select(*by, "teacher_id", F.when(F.col("teacher_id") == keep, F.lit("primary")).otherwise(F.lit("merge")).alias("action"), keep.alias("keep_id"), why.alias("reason"))
    return noise.unionByName(person_rows).unionByName(shared).unionByName(lone)


def cleanup_targets(rows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Final name, code and designation of every kept person, and whether the record changes."""
    persons = _persons(_parsed(rows, by), by)
    changed = (F.col("final_name") != F.col("keep_name")) | ~F.col("final_code").eqNullSafe(F.col("keep_code"))
    return persons.select(*by, "keep_id", "final_name", "final_code", "final_designation", changed.alias("renamed"))


def code_targets(rows: DataFrame, plan: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The same for the record that a group of code records is folded into. It keeps its name and designation; without a code it
    remembers the one its name prints."""
    kept = plan.filter((F.col("action") == "primary") & (F.col("reason") != "same person")).select(*by, "teacher_id")
    parsed = _parsed(rows, by).join(kept, [*by, "teacher_id"])
    own = _blank("code")
    return parsed.select(*by, F.col("teacher_id").alias("keep_id"), F.col("name").alias("final_name"), F.coalesce(own, "p.code").alias("final_code"), _blank("designation").alias("final_designation"), own.isNull().alias("renamed"))


def _targets(rows: DataFrame, plan: DataFrame, by: Sequence[str]) -> DataFrame:
    return cleanup_targets(rows, by).unionByName(code_targets(rows, plan, by))


def cleanup_aliases(rows: DataFrame, plan: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Every spelling the kept record must remember: (by, keep_id, alias), one row each.

    Of one person: the aliases of all records, and their codes, entered or printed in the name, but the final one. Of a code
    record folded into a person: its name and the code it prints. Of a group of code records: all aliases and the names of
    the records that go."""
    moved = plan.filter("action in ('merge', 'primary')").select(*by, "teacher_id", "keep_id", "action", "reason")
    r = _parsed(rows, by).join(moved, [*by, "teacher_id"]).join(_targets(rows, plan, by).select(*by, "keep_id", "final_name", "final_code"), [*by, "keep_id"], "left")
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))

    def unless_final(code: Column) -> Column:
        return F.when(~code.eqNullSafe(F.col("final_code")), code)

    words = (
        F.when(F.col("reason") == "same person", F.concat(aliases, F.array(unless_final(_blank("code")), unless_final(F.trim("p.code")))))
        .when(F.col("reason") == "code of one person", F.array("name", "p.code"))
        .otherwise(F.concat(aliases, F.array(F.when(F.col("action") == "merge", F.col("name")))))
    )
    out = r.select(*by, "keep_id", "final_name", F.explode(F.array_compact(words)).alias("alias")).withColumn("alias", F.trim("alias")).filter("alias <> ''")
    return out.filter(~F.col("alias").eqNullSafe(F.col("final_name"))).select(*by, "keep_id", "alias").distinct()


def _changed(rows: DataFrame, plan: DataFrame, by: Sequence[str]) -> DataFrame:
    """Final values of the kept records that a merge or a new name or code touches."""
    into = plan.filter("action = 'merge'").select(*by, "keep_id").distinct().withColumn("_into", F.lit(True))
    return _targets(rows, plan, by).join(into, [*by, "keep_id"], "left").filter(F.col("renamed") | F.col("_into").isNotNull()).drop("_into", "renamed")


def apply_names(fact: DataFrame, rows: DataFrame, plan: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The names printed on facts follow their teacher: on rows of a changed record, after `apply_to_fact`, teacher_name is its final
    name."""
    final = _changed(rows, plan, by).select(*by, F.col("keep_id").alias("teacher_id"), F.col("final_name").alias("_final"))
    out = fact.join(final, [*by, "teacher_id"], "left")
    return out.withColumn("teacher_name", F.coalesce("_final", "teacher_name")).select(*fact.columns)


def apply_to_logins(users: DataFrame, plan: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Logins of records that are merged away lose their teacher; the keeper's own login stays."""
    gone = plan.filter("action = 'merge'").select(*by, "teacher_id").withColumn("_gone", F.lit(True))
    out = users.join(gone, [*by, "teacher_id"], "left")
    return out.withColumn("teacher_id", F.when(F.col("_gone").isNull(), F.col("teacher_id"))).select(*users.columns)


def apply_to_fact(fact: DataFrame, plan: DataFrame, by: Sequence[str] = BY, unique: Sequence[str] = (), order: str = "duty_id") -> DataFrame:
    """Point rows of merged records at the kept one.

    Where (teacher, *unique) must be unique, a moved row gives way to the keeper's own row, then to the earlier
    moved one. Rows that did not move are never touched."""
    moves = plan.filter("action = 'merge'").select(*by, "teacher_id", F.col("keep_id").alias("_to"))
    out = fact.join(moves, [*by, "teacher_id"], "left")
    if not unique:
        return out.withColumn("teacher_id", F.coalesce("_to", "teacher_id")).select(*fact.columns)
    moved = F.col("_to").isNotNull()
    out = out.withColumn("_moved", moved).withColumn("teacher_id", F.coalesce("_to", "teacher_id"))
    # the key is unique in the stored fact, so a group holds one row per merged record at most
    w = Window.partitionBy(*by, "teacher_id", *unique).orderBy("_moved", order)
    return out.withColumn("_rank", F.row_number().over(w)).filter(~F.col("_moved") | (F.col("_rank") == 1)).select(*fact.columns)


def apply_to_directory(rows: DataFrame, plan: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The directory afterwards - deleted and merged records gone, changed ones with their final values and aliases (sorted)."""
    gone = plan.filter("action in ('merge', 'delete')").select(*by, "teacher_id")
    final = _changed(rows, plan, by).withColumnRenamed("keep_id", "teacher_id").withColumn("_changed", F.lit(True))
    words = cleanup_aliases(rows, plan, by).groupBy(*by, F.col("keep_id").alias("teacher_id")).agg(F.array_sort(F.collect_set("alias")).alias("_words"))
    out = rows.join(gone, [*by, "teacher_id"], "left_anti").join(final, [*by, "teacher_id"], "left").join(words, [*by, "teacher_id"], "left")
    changed = F.col("_changed").isNotNull()
    none = F.array().cast("array<string>")
    return out.select(
        *by, "teacher_id", F.coalesce("final_name", "name").alias("name"), F.when(changed, F.col("final_code")).otherwise(F.col("code")).alias("code"),
        F.when(changed, F.col("final_designation")).otherwise(F.col("designation")).alias("designation"),
        F.when(changed, F.coalesce("_words", none)).otherwise(F.coalesce("aliases", none)).alias("aliases"),
    )


# ---------------------------------------------------------------- learning from a published draft


def create_people(names: DataFrame, resolved: DataFrame, printed: DataFrame | None = None, by: Sequence[str] = BY) -> DataFrame:
    """L2: people to create for names answered NEW: names of one key collapse, heading text is skipped, code and
    designation come from the text, else from the title printed beside the name (`printed`: by, raw, designation).

    `names` carries (by, raw, seq); the first spelling by seq names the person."""
    new = resolved.filter(F.col("is_new") & F.col("teacher_id").isNull()).select(*by, "raw")
    rows = with_value(names.join(new, [*by, "raw"]), "p", classify(F.col("raw"))).filter("p.kind <> 'garbage'")
    if printed is not None:
        first = printed.groupBy(*by, F.trim("raw").alias("raw")).agg(F.min("designation").alias("_printed"))
        rows = rows.join(first, [*by, "raw"], "left")
    else:
        rows = rows.withColumn("_printed", _null())
    is_code = F.coalesce(F.col("_printed").rlike(POST_START), F.lit(False))
    rows = rows.withColumn("key", match_key(F.col("p.name")))
    rows = rows.withColumn("code", F.coalesce("p.code", F.when(is_code, F.col("_printed"))))
    rows = rows.withColumn("designation", F.when(F.col("p.kind") == "person", F.coalesce("p.designation", F.when(~is_code, F.col("_printed")))))
    best = first_rows(rows, [*by, "key"], F.col("seq"), F.col("raw"))
    return best.select(*by, F.col("p.name").alias("name"), "code", "designation", "key")


def learn_aliases(mapping: DataFrame, resolved: DataFrame, people: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """L3: (by, teacher_id, alias) to add: answered spellings whose key the person does not have yet, one per key."""
    answered = mapping.filter("target <> 'NEW'").select(*by, F.trim("raw").alias("raw")).filter("raw <> ''").distinct()
    hit = answered.join(resolved.filter(F.col("teacher_id").isNotNull()).select(*by, "raw", "teacher_id"), [*by, "raw"])
    hit = hit.withColumn("key", match_key(F.col("raw")))
    words = F.concat(F.array(F.col("name"), F.coalesce("code", F.lit(""))), F.coalesce("aliases", F.array().cast("array<string>")))
    known = people.select(*by, "teacher_id", F.explode(F.transform(words, match_key)).alias("key")).distinct()
    fresh = hit.join(known, [*by, "teacher_id", "key"], "left_anti")
    return first_rows(fresh, [*by, "teacher_id", "key"], F.col("raw")).select(*by, "teacher_id", F.col("raw").alias("alias"))


def learn_titles(duties: DataFrame, people: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """L3: first printed code or designation for people who have none (duties: by, teacher_id, seq, designation)."""
    printed = duties.filter(F.col("teacher_id").isNotNull() & F.col("designation").isNotNull())
    is_code = F.col("designation").rlike(POST_START)
    first = printed.groupBy(*by, "teacher_id").agg(
        F.min_by("designation", F.when(is_code, F.col("seq"))).alias("_code"), F.min_by("designation", F.when(~is_code, F.col("seq"))).alias("_title")
    )
    out = people.join(first, [*by, "teacher_id"], "left")
    return out.withColumn("code", F.coalesce("code", "_code")).withColumn("designation", F.coalesce("designation", "_title")).drop("_code", "_title")
