"""Roster planning as set-based jobs: who may serve when, days off, rotation, compensatory offs, extra classes.

Every teacher's dates are exploded from the teacher's own row, so no teacher list is crossed with a calendar.
Sides that a step looks up (offs, duties, busy times) are joined on their keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.text import class_rank
from rollbook.keyed import first_rows, numbered
from rollbook.session import written

BY = ("school_id",)


def target_gap(pool_size: Column, per_day: int, min_gap: int) -> Column:
    """Rest days that can be kept: the wished gap, or fewer when the pool is small; at least 0."""
    return F.greatest(F.least(F.lit(min_gap), F.floor(pool_size / max(1, per_day)).cast("int") - 2), F.lit(0))


def shortage(pool: DataFrame, per_day: int, min_gap: int, by: Sequence[str] = BY) -> DataFrame:
    """Schools whose pool cannot keep the wished gap, with the gap they can."""
    g = pool.groupBy(*by).agg(F.count(F.lit(1)).alias("teachers"))
    return g.withColumn("gap", target_gap(F.col("teachers"), per_day, min_gap)).filter(F.col("gap") < min_gap)


def roster_candidates(
    pool: DataFrame, start: date, end: date, kind: str, restrictions: DataFrame, offs: DataFrame, comp_offs: DataFrame, last: DataFrame, gap: int,
    holidays: DataFrame | None = None, by: Sequence[str] = BY, work_days: Sequence[int] | None = None,
) -> DataFrame:
    """(teacher, date) pairs that may take a duty of the kind: working days (`work_days`, else Monday to Saturday) for MOD,
    Sundays and holidays for HOLIDAY; not restricted, off, on compensatory off, or within `gap` days of the last duty in the history.

    restrictions: by, teacher_id and the arrays dates, days, duties (null means any)."""
    key = [*by, "teacher_id"]
    days = F.sequence(F.lit(start), F.lit(end))
    rows = pool.select(*key, F.explode(days).alias("day")).withColumn("day_idx", F.weekday("day"))
    if holidays is not None:
        listed = holidays.select(*by, "day").distinct().withColumn("_h", F.lit(True))
        rows = rows.join(listed, [*by, "day"], "left")
    else:
        rows = rows.withColumn("_h", F.lit(None).cast("boolean"))
    free = (F.col("day_idx") == 6) | F.coalesce("_h", F.lit(False))
    if kind != "HOLIDAY" and work_days is not None:
        free = free | ~F.col("day_idx").isin([int(d) for d in work_days])
    rows = rows.filter(free if kind == "HOLIDAY" else ~free).drop("_h")

    r = restrictions.filter(F.col("duties").isNull() | F.array_contains("duties", kind))
    r = r.select(*[F.col(c).alias(f"_r_{c}") for c in key], "dates", "days")
    same = [F.col(c) == F.col(f"_r_{c}") for c in key]
    hit = (F.col("dates").isNull() & F.col("days").isNull()) | F.coalesce(F.array_contains("dates", F.col("day")), F.lit(False)) | F.coalesce(F.array_contains("days", F.col("day_idx")), F.lit(False))
    rows = rows.join(r, [*same, hit], "left_anti")
    rows = rows.join(offs.select(*key, "day_idx"), [*key, "day_idx"], "left_anti").join(comp_offs.select(*key, "day"), [*key, "day"], "left_anti")
    rows = rows.join(last.select(*key, "last_date"), key, "left")
    return rows.filter(F.col("last_date").isNull() | (F.datediff("day", "last_date") > gap)).drop("last_date")


def plan_weekly_off(pool: DataFrame, load: DataFrame, preferred: DataFrame, work_days: Sequence[int], by: Sequence[str] = BY) -> DataFrame:
    """A weekly off per teacher: the preferred day, else the day they teach least (earliest on ties), with at most
    ceil(n / days) teachers a day; who does not fit is spread over the places left.

    Places are dealt by rank: the k-th teacher beyond the cap takes the k-th free place of the week, so both sides are
    numbered in chunks and met by an equality join. Returns (by, teacher_id, day_idx, moved)."""
    key = [*by, "teacher_id"]
    days = [int(d) for d in work_days if d != 6]
    options = pool.select(*key, F.explode(F.array(*[F.lit(d) for d in days])).alias("day_idx"))
    lightest = first_rows(options.join(load, [*key, "day_idx"], "left").withColumn("_l", F.coalesce("lessons", F.lit(0))), key, F.col("_l"), F.col("day_idx"))
    wish = preferred.filter(F.col("day_idx").isin(days)).groupBy(*key).agg(F.min("day_idx").alias("_wish"))
    want = lightest.select(*key, "day_idx", "_l").join(wish, key, "left")
    want = want.withColumn("day_idx", F.coalesce("_wish", "day_idx")).withColumn("_turn", F.when(F.col("_wish").isNotNull(), F.lit(-1).cast("long")).otherwise(F.col("_l").cast("long")))
    size = pool.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / len(days)).cast("int").alias("_cap"))
    placed = numbered(want.select(*key, "day_idx", "_turn"), [*by, "day_idx"], ["_turn", "teacher_id"], "_n").join(size, list(by))
    fits = (F.col("_n") <= F.col("_cap")) | (F.col("_turn") == -1)
    kept = placed.filter(fits).select(*key, "day_idx", F.lit(False).alias("moved"))
    over = numbered(placed.filter(~fits).select(*key), by, ["teacher_id"], "_k")

    used = placed.filter(fits).groupBy(*by, "day_idx").agg(F.count(F.lit(1)).alias("_used"))
    free = size.select(*by, "_cap", F.explode(F.array(*[F.lit(d) for d in days])).alias("day_idx")).join(used, [*by, "day_idx"], "left")
    left = F.greatest(F.col("_cap") - F.coalesce("_used", F.lit(0)), F.lit(0))
    up = Window.partitionBy(*by).orderBy("day_idx").rowsBetween(Window.unboundedPreceding, -1)
    free = free.withColumn("_left", left).withColumn("_from", F.coalesce(F.sum("_left").over(up), F.lit(0)))
    spans = free.filter("_left > 0").select(*by, "day_idx", "_from", (F.col("_from") + F.col("_left")).alias("_to"))
    moved = over.join(spans, list(by)).filter((F.col("_k") > F.col("_from")) & (F.col("_k") <= F.col("_to")))  # at most six spans a school
    return kept.unionByName(moved.select(*key, "day_idx", F.lit(True).alias("moved")))


def rotation_plan(candidates: DataFrame, pool: DataFrame, history: DataFrame, start: date, need: int, by: Sequence[str] = BY) -> DataFrame:
    """For each date the `need` candidates with the least load so far, then by rotation
    (rank in the name list + 7 x day number) mod n."""
    key = [*by, "teacher_id"]
    ranked = numbered(pool.select(*key, "name"), by, ["name", "teacher_id"], "_rank")
    size = pool.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    load = history.groupBy(*key).agg(F.count(F.lit(1)).alias("load"))
    rows = candidates.select(*key, "day").join(ranked.select(*key, "_rank"), key).join(load, key, "left").join(size, list(by))
    turn = F.pmod(F.col("_rank") - 1 + F.datediff("day", F.lit(start)) * 7, F.col("_size")).cast("long")
    rows = rows.withColumn("load", F.coalesce("load", F.lit(0).cast("long"))).withColumn("turn", turn)
    return first_rows(rows, [*by, "day"], F.col("load"), F.col("turn"), F.col("teacher_id"), k=need).select(*key, "day", "load", "turn")


def comp_off_options(duties: DataFrame, offs: DataFrame, load: DataFrame, work_days: Sequence[int], holidays: DataFrame | None = None, by: Sequence[str] = BY) -> DataFrame:
    """For each holiday duty the best compensatory day of the next seven: a working day the teacher is not off or on
    duty, with the fewest lessons, then the earliest."""
    key = [*by, "teacher_id"]
    hol = duties.filter(F.col("duty_type") == "HOLIDAY").select(*key, "duty_id", "duty_date")
    days = F.sequence(F.date_add("duty_date", 1), F.date_add("duty_date", 7))
    rows = hol.select("*", F.explode(days).alias("day")).withColumn("day_idx", F.weekday("day")).filter(F.col("day_idx").isin([int(d) for d in work_days if d != 6]))
    rows = rows.join(offs.select(*key, "day_idx").distinct(), [*key, "day_idx"], "left_anti")
    rows = rows.join(duties.select(*key, F.col("duty_date").alias("day")).distinct(), [*key, "day"], "left_anti")
    if holidays is not None:
        rows = rows.join(holidays.select(*by, "day").distinct(), [*by, "day"], "left_anti")
    rows = rows.join(load, [*key, "day_idx"], "left").withColumn("lessons", F.coalesce("lessons", F.lit(0).cast("long")))
    return first_rows(rows, [*by, "duty_id"], F.col("lessons"), F.col("day")).select(*key, "duty_id", "duty_date", "day", "lessons")


def remedial_candidates(teaches: DataFrame, slots: DataFrame, lessons: DataFrame, offs: DataFrame, given: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """P5: for each class-section the best (slot, teacher): someone who teaches the section (tier 0) or the class
    (tier 1), not off that day and not teaching then; fewest extra classes already given, then slot and teacher.

    teaches: `who_teaches_what` rows; slots: by, day_idx, start_min, end_min (start before end); given: by, teacher_id,
    sessions. A teacher's subject is the one taught most."""
    key = [*by, "teacher_id"]
    subject = F.max_by("subject", F.struct("lessons", "subject")).alias("subject")
    fine = teaches.filter(F.col("section") != "*").groupBy(*by, "class_name", "section", "teacher_id").agg(subject)
    wide = teaches.filter(F.col("section") == "*").groupBy(*by, "class_name", "teacher_id").agg(subject)
    sections = teaches.filter(F.col("section") != "*").select(*by, "class_name", "section").distinct()
    both = fine.withColumn("tier", F.lit(0)).unionByName(sections.join(wide, [*by, "class_name"]).withColumn("tier", F.lit(1)))
    both = first_rows(both, [*by, "class_name", "section", "teacher_id"], F.col("tier"))

    times = slots.filter(F.col("start_min") < F.col("end_min")).select(*by, "day_idx", "start_min", "end_min")
    # free (teacher, slot) pairs first: there are far fewer of them than (section, teacher, slot)
    people = both.select(*key).distinct().join(times, list(by))
    people = people.join(offs.select(*key, "day_idx").distinct(), [*key, "day_idx"], "left_anti")
    busy = lessons.filter(~F.col("is_break") & F.col("teacher_id").isNotNull())
    busy = busy.select(*[F.col(c).alias(f"_b_{c}") for c in (*key, "day_idx")], F.col("start_min").alias("_s"), F.col("end_min").alias("_e")).distinct()
    clash = [F.col(c) == F.col(f"_b_{c}") for c in (*key, "day_idx")] + [F.col("start_min") < F.col("_e"), F.col("_s") < F.col("end_min")]
    people = people.join(busy, clash, "left_anti").join(given, key, "left").withColumn("sessions", F.coalesce("sessions", F.lit(0).cast("long")))
    # a teacher's best slot does not depend on the class, so one slot per teacher is carried on
    best = first_rows(people, key, F.col("day_idx"), F.col("start_min"), F.col("end_min"))
    rows = both.join(best, key)
    score = [F.col("tier"), F.col("sessions"), F.col("day_idx"), F.col("start_min"), F.col("teacher_id")]
    return first_rows(rows, [*by, "class_name", "section"], *score).select(*key, "class_name", "section", "subject", "tier", "day_idx", "start_min", "end_min")


def _remedial_options(
    teaches: DataFrame, sections: DataFrame, seat: DataFrame, slots: DataFrame, lessons: DataFrame, offs: DataFrame, restrictions: DataFrame, by: Sequence[str]
) -> DataFrame:
    """(cs, teacher_id, tier, _seat, _most, slots, subjects): the teachers every class-section could have, whatever else is planned, with
    the slots they are free in and the subjects they teach there (who teaches the section counts as that)."""
    key, cs = [*by, "teacher_id"], [*by, "class_name", "section"]
    times = slots.filter(F.col("start_min") < F.col("end_min")).select(*by, "day_idx", "start_min", "end_min").distinct()
    # free (teacher, slot) pairs first: there are far fewer of them than (section, teacher, slot)
    people = seat.join(teaches.select(*key).distinct(), key, "left_semi").join(times, list(by))
    people = people.join(offs.select(*key, "day_idx").distinct(), [*key, "day_idx"], "left_anti")
    r = restrictions.filter((F.col("duties").isNull() | F.array_contains("duties", "REMEDIAL")) & F.col("dates").isNull())
    r = r.select(*[F.col(c).alias(f"_r_{c}") for c in key], "days")
    away = [F.col(c) == F.col(f"_r_{c}") for c in key] + [F.col("days").isNull() | F.array_contains("days", F.col("day_idx"))]
    busy = lessons.filter(~F.col("is_break") & F.col("teacher_id").isNotNull()).join(seat.select(*key), key, "left_semi")
    busy = busy.select(*[F.col(c).alias(f"_b_{c}") for c in (*key, "day_idx")], F.col("start_min").alias("_s"), F.col("end_min").alias("_e")).distinct()
    clash = [F.col(c) == F.col(f"_b_{c}") for c in (*key, "day_idx")] + [F.col("start_min") < F.col("_e"), F.col("_s") < F.col("end_min")]
    people = people.join(r, away, "left_anti").join(busy, clash, "left_anti")
    people = people.groupBy(*key, "_seat", "_most").agg(F.collect_list(F.struct("day_idx", "start_min", "end_min")).alias("slots"))  # the free slots of a week

    fine = teaches.filter("section <> '*'").withColumn("tier", F.lit(0))
    wide = teaches.filter("section = '*'").drop("section").join(sections, [*by, "class_name"]).withColumn("tier", F.lit(1))
    both = fine.select(*cs, "teacher_id", "tier", "subject", "lessons").unionByName(wide.select(*cs, "teacher_id", "tier", "subject", "lessons"))
    told = both.groupBy(*cs, "teacher_id").agg(F.min("tier").alias("tier"), F.collect_list(F.struct("tier", "subject", "lessons")).alias("_all"))  # the subjects of one teacher
    nearest = F.transform(F.filter("_all", lambda x: x["tier"] == F.col("tier")), lambda x: F.struct(x["subject"].alias("subject"), x["lessons"].alias("lessons")))
    return told.select(*cs, "teacher_id", "tier", nearest.alias("subjects")).join(people, key)


def _contenders(
    teaches: DataFrame, pool: DataFrame, slots: DataFrame, lessons: DataFrame, offs: DataFrame, restrictions: DataFrame, per_week: int, by: Sequence[str], reach: int
) -> DataFrame:
    """The `_remedial_options` that could ever be chosen.

    A plan gives a school's teachers `per_week` classes for each of its k sections, so at any time fewer than per_week * k of them
    have one. Of the teachers free in a slot who hold a subject of a section, the first per_week * k by tier and place in the name
    list therefore always include one without any class, who is no worse than a teacher behind them all: the others never win.
    The list is read up to `reach` times that number first; the rest of it only for sections and subjects that found too few there."""
    key, cs, slot = [*by, "teacher_id"], [*by, "class_name", "section"], ["day_idx", "start_min", "end_min"]
    teaches = written(teaches)  # read several times below
    taught = teaches.filter("section <> '*'")
    sections = written(taught.select(*cs).distinct())
    most = sections.groupBy(*by).agg((F.count(F.lit(1)) * per_week).alias("_most"))
    top = most.agg(F.max("_most")).first()[0] or 0
    seat = written(numbered(pool.select(*key, "name"), by, ["name", "teacher_id"], "_seat").select(*key, "_seat").join(most, list(by)))
    tasks = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def held(people: DataFrame, only: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The options of some people, and a row for each section, subject and slot of theirs."""
        mine = teaches.join(people.select(*key), key, "left_semi")
        if only is not None:
            mine = mine.join(only.select(*by, "class_name").distinct(), [*by, "class_name"], "left_semi")
        rows = written(_remedial_options(mine, sections, people, slots, lessons, offs, restrictions, by))
        # a few rows that become many: dealt out by number before they do
        each = rows.repartition(tasks, *cs).select(*cs, "teacher_id", "tier", "_seat", "_most", "slots", F.explode("subjects.subject").alias("subject"))
        if only is not None:
            each = each.join(only, [*cs, "subject"], "left_semi")
        return rows, each.select("*", F.inline("slots")).drop("slots")

    group = [*cs, "subject", *slot]
    rows, each = held(seat.filter(F.col("_seat") <= F.col("_most") * reach), None)
    # sections and subjects for which enough teachers of the section itself were found in every slot of the school
    enough = each.groupBy(*group).agg(F.count_if(F.col("tier") == 0).alias("_n"), F.first("_most").alias("_most")).filter(F.col("_n") >= F.col("_most"))
    enough = enough.groupBy(*cs, "subject").agg(F.count(F.lit(1)).alias("_full"))
    times = slots.filter(F.col("start_min") < F.col("end_min")).select(*by, *slot).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_times"))
    behind = seat.filter(F.col("_seat") > F.col("_most") * reach)
    open_ = taught.select(*by, "class_name", "subject").distinct().join(behind.select(*by).distinct(), list(by), "left_semi").join(sections, [*by, "class_name"])
    open_ = open_.join(enough, [*cs, "subject"], "left").join(times, list(by)).filter(F.coalesce("_full", F.lit(0)) < F.col("_times"))
    open_ = written(open_.select(*cs, "subject"))
    if not open_.isEmpty():
        more, each_more = held(behind, open_)
        rows, each = rows.unionByName(more), each.unionByName(each_more)

    ranked = first_rows(each, group, F.col("tier"), F.col("_seat"), k=top)
    kept = ranked.groupBy(*cs, "teacher_id").agg(F.collect_set(F.struct(*slot)).alias("slots"))
    return rows.drop("slots").join(kept, [*cs, "teacher_id"])


def plan_remedial(
    teaches: DataFrame, pool: DataFrame, slots: DataFrame, lessons: DataFrame, offs: DataFrame, restrictions: DataFrame, per_week: int, most_per_week: int, by: Sequence[str] = BY,
    reach: int = 64,
) -> DataFrame:
    """P5: `per_week` extra classes of every class-section, each with a teacher and a slot: (by, class_name, section, session,
    teacher_id, subject, tier, day_idx, start_min, end_min).

    Hard rules: the teacher teaches the section (tier 0) or the class (tier 1), is not off, restricted or teaching then, gives at
    most one a day and `most_per_week` a week; a section takes no two at one time. Wishes, in points as fixed below: tier, classes
    already given, a subject the section had, a second one on a day; then the place in the name list and the slot.

    Sessions are dealt one after another, each in rounds: every section still without one asks for its best option; a teacher's
    day goes to the first that asks (by class and section), a teacher's week to as many as there is room for; the others ask
    again for what is left. A section without an option is left out of that session. What a section can ask for is cut to
    `_contenders` first, so that a round does not grow with the school's staff; `reach` changes the work, not the plan."""
    key, cs, slot = [*by, "teacher_id"], [*by, "class_name", "section"], ["day_idx", "start_min", "end_min"]
    options = written(_contenders(teaches, pool, slots, lessons, offs, restrictions, per_week, by, reach).select(*cs, "teacher_id", "tier", "_seat", "slots", "subjects"))
    turn = F.struct(class_rank(F.col("class_name")), F.col("section"), F.col("class_name"))
    done = written(options.filter("false").select(*cs, F.lit(0).alias("session"), "teacher_id", F.lit("").alias("subject"), "tier", F.explode("slots").alias("_s")).select(*cs, "session", "teacher_id", "subject", "tier", "_s.*"))
    for session in range(1, per_week + 1):
        while True:
            # of a section at most per_week classes, of a teacher at most most_per_week
            own = done.groupBy(*cs).agg(F.collect_list(F.struct("session", "subject", *slot)).alias("_own"))
            given = done.groupBy(*key).agg(F.collect_list("day_idx").alias("_days"))
            rows = options.join(F.broadcast(own), cs, "left").join(F.broadcast(given), key, "left")
            rows = rows.withColumn("_own", F.coalesce("_own", F.array().cast(own.schema["_own"].dataType))).withColumn("_days", F.coalesce("_days", F.array().cast("array<int>")))
            rows = rows.filter(~F.exists("_own", lambda d: d["session"] == session) & (F.size("_days") < most_per_week))
            free = F.filter("slots", lambda s: ~F.array_contains("_days", s["day_idx"]) & ~F.exists("_own", lambda d: _meets(s, d)))
            again = F.transform(free, lambda s: F.struct(F.when(F.exists("_own", lambda d: d["day_idx"] == s["day_idx"]), 40).otherwise(0).alias("same"), *[s[c].alias(c) for c in slot]))
            had = F.transform("subjects", lambda x: F.struct(F.size(F.filter("_own", lambda d: d["subject"] == x["subject"])).alias("had"), (-x["lessons"]).alias("less"), x["subject"].alias("subject")))
            rows = rows.withColumn("_at", F.array_min(again)).withColumn("_told", F.array_min(had)).filter("_at IS NOT NULL")
            rows = rows.select(*cs, "teacher_id", "tier", "_seat", F.size("_days").alias("_given"), "_told.had", "_told.subject", "_at.*")
            points = F.col("tier") * 1000 + F.col("_given") * 40 + F.col("had") * 25 + F.col("same")
            asked = first_rows(rows.withColumn("_points", points), cs, F.col("_points"), F.col("_seat"), *[F.col(c) for c in slot])
            asked = first_rows(asked.withColumn("_turn", turn), [*key, "day_idx"], F.col("_turn"))
            room = F.row_number().over(Window.partitionBy(*key).orderBy("_turn"))  # a row per weekday at most
            won = asked.withColumn("_room", room).filter(F.col("_given") + F.col("_room") <= most_per_week)
            won = written(won.select(*cs, F.lit(session).alias("session"), "teacher_id", "subject", "tier", *slot))
            if won.isEmpty():
                break
            done = written(done.unionByName(won))
    return done


def _meets(a: Column, b: Column) -> Column:
    return (a["day_idx"] == b["day_idx"]) & (a["start_min"] < b["end_min"]) & (b["start_min"] < a["end_min"])


def restrictions_from_rules(rules: DataFrame, pool: DataFrame, by: Sequence[str] = BY) -> dict[str, DataFrame]:
    """Rule rows (by, place in the name list, type, dates, days, duties) to restrictions and preferred offs; rules
    that name nobody or hold nothing usable are counted as skipped."""
    ranked = numbered(pool.select(*by, "teacher_id", "name"), by, ["name", "teacher_id"], "place").withColumn("place", F.col("place").cast("int"))
    r = rules.join(ranked.select(*by, "place", "teacher_id"), [*by, "place"], "left")

    def some(c: str) -> Column:
        return F.coalesce(F.size(c), F.lit(0)) > 0

    day = F.get(F.filter("days", lambda d: d != 6), F.lit(0))
    usable = (
        F.when(F.col("type") == "prefer_off_day", day.isNotNull())
        .when(F.col("type") == "no_duty", some("duties"))
        .when(F.col("type") == "unavailable", some("dates") | some("days"))
    )
    ok = F.col("teacher_id").isNotNull() & F.coalesce(usable, F.lit(False))
    good = r.filter(ok)
    off = good.filter("type = 'prefer_off_day'").select(*by, "teacher_id", day.alias("day_idx"))
    duty = F.col("type") == "no_duty"
    limit = good.filter("type <> 'prefer_off_day'").select(
        *by, "teacher_id", F.when(~duty & some("dates"), F.col("dates")).alias("dates"), F.when(~duty & some("days"), F.col("days")).alias("days"), F.when(some("duties"), F.col("duties")).alias("duties")
    )
    skipped = r.groupBy(*by).agg(F.count_if(~ok).alias("skipped"))
    return {"restrictions": limit, "preferred": off, "skipped": skipped}


