"""Schedule, duty, directory and document reads: filters, look-ups, listings and search.

`by` names the columns that separate schools (and, where useful, versions); it leads every key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.clock import class_label, lookup
from rollbook.functions.people import classify
from rollbook.functions.text import class_rank, normalize_class
from rollbook.keyed import first_rows, with_value
from rollbook.session import cut_lineage

BY = ("school_id",)

# Urgency order of notices, states a reader may see, states still in work.
PRIORITY = {"URGENT": 0, "HIGH": 1, "NORMAL": 2, "LOW": 3}
VISIBLE = ["PUBLISHED", "NOT_APPLICABLE"]
PENDING = ["REVIEW", "PROCESSING", "QUEUED", "FAILED"]


def holds(c: Column, term: str) -> Column:
    """Case-insensitive literal containment (no wildcards)."""
    return F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False))


# ---------------------------------------------------------------- look-ups


def with_teacher(fact: DataFrame, teachers: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Any fact with its teacher's directory name and active flag; facts without a teacher stay."""
    side = teachers.select(*by, "teacher_id", F.col("name").alias("directory_name"), F.col("active").alias("teacher_active"))
    return fact.join(side, [*by, "teacher_id"], "left")


def period_rows(periods: DataFrame, teachers: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """B1: the 13 period columns; the directory name wins over the printed one."""
    named = with_teacher(periods, teachers, by)
    return named.select(
        *by, "version", "seq", "class_name", "section", "day_idx", "slot", "period_number", "is_break", "label",
        "start_min", "end_min", "subject", "teacher_id", F.coalesce("directory_name", "printed_teacher").alias("teacher_name"),
    )


def weekly_off_active(offs: DataFrame, teachers: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Weekly offs of active teachers, with names."""
    side = teachers.filter("active").select(*by, "teacher_id", "name")
    return offs.join(side, [*by, "teacher_id"])


# ---------------------------------------------------------------- order


def domain_order(df: DataFrame, by: Sequence[str] = BY, time: str = "slot", tie: str = "seq") -> DataFrame:
    """class rank, section, weekday (none sorts as Sunday), then slot or start."""
    return df.orderBy(*by, class_rank(F.col("class_name")), "section", F.coalesce("day_idx", F.lit(6)), time, tie)


def by_time(df: DataFrame, *lead: str) -> DataFrame:
    """start minute (missing last), then slot."""
    return df.orderBy(*lead, F.col("start_min").asc_nulls_last(), "slot", "seq")


def priority_rank(c: Column) -> Column:
    """F7."""
    return lookup(c, PRIORITY)


# ---------------------------------------------------------------- timetable views


def class_periods(rows: DataFrame, version: int, class_name: str, section: str | None = None) -> DataFrame:
    cond = (F.col("version") == version) & (F.col("class_name") == class_name)
    return rows.filter(cond if section is None else cond & (F.col("section") == section))


def day_periods(rows: DataFrame, version: int, day_idx: int, class_name: str | None = None) -> DataFrame:
    cond = (F.col("version") == version) & (F.col("day_idx") == day_idx)
    return rows.filter(cond if class_name is None else cond & (F.col("class_name") == class_name))


def all_periods(rows: DataFrame, version: int) -> DataFrame:
    return rows.filter(F.col("version") == version)


def teacher_periods(rows: DataFrame, version: int, teacher_id: int | None = None, day_idx: int | None = None) -> DataFrame:
    """Lessons of one teacher (or of every teacher), no breaks, by time."""
    cond = (F.col("version") == version) & ~F.col("is_break")
    cond = cond & (F.col("teacher_id").isNotNull() if teacher_id is None else F.col("teacher_id") == teacher_id)
    if day_idx is not None:
        cond = cond & (F.col("day_idx") == day_idx)
    return by_time(rows.filter(cond))


def period_query(
    rows: DataFrame, version: int, teacher_id: int | None = None, class_name: str | None = None, section: str | None = None, day_idx: int | None = None
) -> DataFrame:
    """Teacher before class before day; no argument gives no rows."""
    if teacher_id is not None:
        return teacher_periods(rows, version, teacher_id, day_idx)
    if class_name is not None:
        out = class_periods(rows, version, class_name, section)
        return out if day_idx is None else out.filter(F.col("day_idx") == day_idx)
    if day_idx is not None:
        return day_periods(rows, version, day_idx)
    return rows.filter(F.lit(False))


# ---------------------------------------------------------------- people


def search_people(teachers: DataFrame, term: str, k: int | None = 12, by: Sequence[str] = BY, use_aliases: bool = True, any_state: bool = False) -> DataFrame:
    """Name or code contains the term (any case) or an alias equals it (exact case); k per school."""
    term = term.strip()
    hit = holds(F.col("name"), term) | holds(F.col("code"), term)
    if use_aliases:
        hit = hit | F.coalesce(F.array_contains("aliases", term), F.lit(False))
    out = teachers.filter(hit & F.lit(bool(term)))
    if not any_state:
        out = out.filter("active")
    return out if k is None else first_rows(out, by, F.col("name"), F.col("teacher_id"), k=k)


def combined_field_filter(teachers: DataFrame, term: str, show_inactive: bool = False) -> DataFrame:
    """Name, code and designation read as one text contain the term."""
    out = teachers if show_inactive else teachers.filter("active")
    if not term.strip():
        return out
    text = F.concat_ws(" ", "name", F.coalesce("code", F.lit("")), F.coalesce("designation", F.lit("")))
    return out.filter(holds(text, term.strip()))


def roster_pool(teachers: DataFrame, exclude: DataFrame | None = None, by: Sequence[str] = BY) -> DataFrame:
    """Active people (no codes or heading text), minus the excluded."""
    out = with_value(teachers.filter("active"), "_kind", classify(F.col("name"))["kind"]).filter("_kind = 'person'").drop("_kind")
    return out if exclude is None else out.join(exclude.select(*by, "teacher_id"), [*by, "teacher_id"], "left_anti")


def directory_list(teachers: DataFrame, users: DataFrame, offs: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Every teacher with login and weekly-off days (at most seven), and whether a login is missing."""
    key = [*by, "teacher_id"]
    days = offs.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_set("day_idx")), lambda d: d.cast("string")), ",").alias("off_days"))
    out = teachers.join(users.select(*key, "username"), key, "left").join(days, key, "left")
    missing = F.col("active") & F.col("username").isNull() & (classify(F.col("name"))["kind"] == "person")
    return out.select(*key, "name", "active", "username", F.coalesce("off_days", F.lit("")).alias("off_days"), missing.alias("login_missing"))


def missing_logins(teachers: DataFrame, users: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Active persons no login points to."""
    key = [*by, "teacher_id"]
    return roster_pool(teachers, None, by).join(users.filter(F.col("teacher_id").isNotNull()), key, "left_anti")


# ---------------------------------------------------------------- duties and offs


def duties_on(duties: DataFrame, day: date, duty_type: str) -> DataFrame:
    return duties.filter((F.col("duty_date") == F.lit(day)) & (F.col("duty_type") == duty_type))


def duties_between(duties: DataFrame, start: date, end: date | None = None) -> DataFrame:
    cond = F.col("duty_date") >= F.lit(start)
    return duties.filter(cond if end is None else cond & (F.col("duty_date") <= F.lit(end))).orderBy("duty_date", "duty_id")


def upcoming_duties(duties: DataFrame, teachers: DataFrame, start: date, duty_type: str = "MOD", k: int = 60, by: Sequence[str] = BY) -> DataFrame:
    """The next k duties of each school, those of one date in the order of the teachers' names."""
    out = duties.filter((F.col("duty_date") >= F.lit(start)) & (F.col("duty_type") == duty_type))
    named = out.join(teachers.select(*by, "teacher_id", F.col("name").alias("_name")), [*by, "teacher_id"], "left")
    return first_rows(named, by, F.col("duty_date"), F.col("_name"), F.col("duty_id"), k=k).select(*duties.columns)


def dated_offs(duties: DataFrame, start: date, by: Sequence[str] = BY) -> DataFrame:
    """Compensatory days off from a date on."""
    out = duties.filter((F.col("duty_type") == "HOLIDAY") & (F.col("off_date") >= F.lit(start)))
    return out.select(*by, "duty_id", "teacher_id", "off_date", "duty_date")


def off_on(offs: DataFrame, duties: DataFrame, teachers: DataFrame, day: date, by: Sequence[str] = BY) -> DataFrame:
    """Who is off on a date - weekly offs first, then dated ones, one row per teacher."""
    weekly = weekly_off_active(offs, teachers, by).filter(F.col("day_idx") == day.weekday())
    weekly = weekly.select(*by, "teacher_id", F.lit("weekly").alias("source"))
    dated = dated_offs(duties, day, by).filter(F.col("off_date") == F.lit(day))
    dated = dated.select(*by, "teacher_id", F.lit("dated").alias("source"))
    both = weekly.unionByName(dated).groupBy(*by, "teacher_id")
    return both.agg(F.max("source").alias("source"))


def next_duties(duties: DataFrame, day: date, by: Sequence[str] = BY, ahead: int = 20, each: int = 6) -> DataFrame:
    """Of each teacher's next `ahead` duties from `day` on, the first `each` of a kind after that day, with their place, and those
    of the kind HOLIDAY on the day itself at place 0."""
    key = [*by, "teacher_id"]
    rows = first_rows(duties.filter(F.col("duty_date") >= F.lit(day)), key, F.col("duty_date"), F.col("duty_id"), k=ahead)
    w = Window.partitionBy(*key, "duty_type").orderBy("duty_date", "duty_id")  # `ahead` rows at most
    later = rows.filter(F.col("duty_date") > F.lit(day)).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= each)
    now = first_rows(rows.filter((F.col("duty_date") == F.lit(day)) & (F.col("duty_type") == "HOLIDAY")), key, F.col("duty_id"))
    return later.unionByName(now.withColumn("place", F.lit(0))).select(*key, "duty_type", "place", "duty_date", "duty_id")


def teacher_day(
    periods: DataFrame, duties: DataFrame, offs: DataFrame, teachers: DataFrame, version: int, day: date, by: Sequence[str] = BY
) -> DataFrame:
    """Per active teacher - lessons today, on-duty and day-off flags, and the next six duties of each kind
    out of the next twenty rows."""
    key = [*by, "teacher_id"]
    today = periods.filter((F.col("version") == version) & ~F.col("is_break") & (F.col("day_idx") == day.weekday()) & F.col("teacher_id").isNotNull())
    lessons = today.groupBy(*key).agg(F.count(F.lit(1)).alias("lessons"), F.min("start_min").alias("first_start"))
    mod = duties_on(duties, day, "MOD").groupBy(*key).agg(F.lit(True).alias("on_mod"))
    off = off_on(offs, duties, teachers, day, by).select(*key, F.lit(True).alias("is_off"))
    ahead = first_rows(duties.filter(F.col("duty_date") >= F.lit(day)), key, F.col("duty_date"), F.col("duty_id"), k=20)
    later = F.col("duty_date") > F.lit(day)
    nxt = ahead.groupBy(*key).agg(
        F.least(F.count_if(later & (F.col("duty_type") == "MOD")), F.lit(6)).alias("next_mod"),
        F.least(F.count_if(later & (F.col("duty_type") == "HOLIDAY")), F.lit(6)).alias("next_holiday"),
        F.min(F.when(later, F.col("duty_date"))).alias("next_date"),
    )
    out = teachers.filter("active").select(*key, "name")
    for side in (lessons, mod, off, nxt):
        out = out.join(side, key, "left")
    zero, no = F.lit(0).cast("long"), F.lit(False)
    return out.select(
        *key, "name", F.coalesce("lessons", zero).alias("lessons"), "first_start", F.coalesce("on_mod", no).alias("on_mod"),
        F.coalesce("is_off", no).alias("is_off"), F.coalesce("next_mod", zero).alias("next_mod"),
        F.coalesce("next_holiday", zero).alias("next_holiday"), "next_date",
    )


def availability(fact: DataFrame, on_date: Column, by: Sequence[str] = BY) -> DataFrame:
    """Per school - data for the date, none for the date, or (school absent) no data at all."""
    g = fact.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(on_date).alias("today"))
    return g.withColumn("state", F.when(F.col("today") > 0, F.lit("rows")).when(F.col("total") > 0, F.lit("none_on_date")).otherwise(F.lit("no_data")))


# ---------------------------------------------------------------- remedial, clubs, documents, notices


def remedial_list(remedial: DataFrame, teachers: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Live extra classes with the directory name, in domain order."""
    out = with_teacher(remedial.filter("active"), teachers, by).drop("teacher_active")
    return domain_order(out, by, time="start_min")


def club_list(clubs: DataFrame) -> DataFrame:
    """B13."""
    return clubs.filter("active").orderBy("name", "club_id")


def visible_documents(docs: DataFrame, admin: bool = False, generated_mime: str = "application/x-generated") -> DataFrame:
    """What a reader may open; an administrator sees all."""
    if admin:
        return docs
    return docs.filter(~F.col("archived") & (F.col("mime") != generated_mime) & F.col("extraction_status").isin(VISIBLE))


def pending_documents(docs: DataFrame, k: int = 10, by: Sequence[str] = BY) -> DataFrame:
    """Newest k documents of each school still in work."""
    out = docs.filter(F.col("extraction_status").isin(PENDING) & ~F.col("archived"))
    return first_rows(out, by, F.col("created_on").desc(), F.col("doc_id"), k=k)


def documents_by_kind(docs: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Visible documents counted by kind, with the newest date."""
    return visible_documents(docs).groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("documents"), F.max("created_on").alias("newest"))


def routine_list(routines: DataFrame, admin: bool, by: Sequence[str] = BY) -> DataFrame:
    """Versions newest first; readers see the active one."""
    out = routines if admin else routines.filter(F.col("status") == "ACTIVE")
    return out.orderBy(*by, F.col("version").desc())


def notice_list(notices: DataFrame, admin: bool = False, k: int = 200, by: Sequence[str] = BY) -> DataFrame:
    """Newest k of each school; archived ones only for an administrator."""
    out = notices if admin else notices.filter(~F.col("archived"))
    return first_rows(out, by, F.col("notice_date").desc(), F.col("notice_id").desc(), k=k)


def latest_notices(notices: DataFrame, k: int = 5, newest: int = 50, by: Sequence[str] = BY) -> DataFrame:
    """the newest 50 first, then by urgency and date, then k of them."""
    recent = notice_list(notices, False, newest, by)
    return first_rows(recent, by, priority_rank(F.col("priority")), F.col("notice_date").desc(), F.col("notice_id").desc(), k=k)


def page_of(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """one page of a sorted listing (order must be unique)."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def deep_page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """F4 far into a listing: `page_of` holds all rows up to the page in one task; here rows are cut into ranges of the order, ranges
    are counted, and only those that hold the page are sorted."""
    rows = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = rows.groupBy("_range").count().orderBy("_range").collect()  # a row a range
    start, before, held, skip = (number - 1) * size, 0, [], 0
    for r in counts:
        if before < start + size and before + r["count"] > start:
            if not held:
                skip = start - before
            held.append(r["_range"])
        before += r["count"]
    return rows.filter(F.col("_range").isin(held)).drop("_range").orderBy(*order).offset(skip).limit(size)


def page_after(df: DataFrame, last: Sequence[tuple[str, object, bool]], size: int) -> DataFrame:
    """F4 onwards from a page: the next `size` rows behind its last row, given as (column, value, descending) in the order of the
    listing. The filter reaches the scan and no task holds more than `size` rows, however far the page."""
    behind, equal = F.lit(False), F.lit(True)
    for name, value, down in last:
        c = F.col(name)
        behind = behind | (equal & ((c < F.lit(value)) if down else (c > F.lit(value))))
        equal = equal & (c == F.lit(value))
    name, value, down = last[0]
    first = (F.col(name) <= F.lit(value)) if down else (F.col(name) >= F.lit(value))  # a plain bound for the scan
    return df.filter(first & behind).orderBy(*[F.col(n).desc() if down else F.col(n) for n, _, down in last]).limit(size)


def page_count(df: DataFrame, size: int = 40, by: Sequence[str] = ()) -> DataFrame:
    """number of pages, at least one."""
    return df.groupBy(*by).agg(F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1)).cast("long").alias("pages"))


def low_confidence(df: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Scored rows under the threshold; hand-entered rows have no score."""
    return df.filter(F.col("confidence") < threshold)


# ---------------------------------------------------------------- distinct values and grouped listings


def class_sections(periods: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Class-sections in display order."""
    out = periods.select(*by, "class_name", "section").distinct()
    return out.withColumn("label", class_label(F.col("class_name"), F.col("section"))).orderBy(*by, class_rank(F.col("class_name")), "section")


def working_days(periods: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Weekdays that have periods, in calendar order."""
    return periods.select(*by, "day_idx").distinct().orderBy(*by, "day_idx")


def entity_types(activity: DataFrame) -> DataFrame:
    """G8."""
    return activity.select("entity_type").distinct().orderBy("entity_type")


def group_list(df: DataFrame, keys: Sequence[str], members: Sequence[str]) -> DataFrame:
    """Members listed under their group with the group's size, in sorted order.

    The listing stays one row per member: a group has no size limit, so it is never packed into one value."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"))
    return df.select(*keys, *members).join(sizes, list(keys)).orderBy(*keys, *members)


# ---------------------------------------------------------------- search


def subject_teachers(periods: DataFrame, teachers: DataFrame, term: str, version: int, by: Sequence[str] = BY) -> DataFrame:
    """Distinct (subject, teacher) of lessons whose subject contains the term."""
    hits = periods.filter((F.col("version") == version) & ~F.col("is_break") & F.col("teacher_id").isNotNull() & holds(F.col("subject"), term))
    pairs = hits.select(*by, "subject", "teacher_id").distinct()
    return pairs.join(teachers.select(*by, "teacher_id", "name"), [*by, "teacher_id"])


def class_search(periods: DataFrame, term: str, version: int, by: Sequence[str] = BY) -> DataFrame:
    """Class-sections a term like "class 8-b" or "VIII" names."""
    t = F.lit(term.strip())
    wanted = F.regexp_replace(F.regexp_replace(F.upper(t), r"^CLASS\s*", ""), r"\s+", "")
    with_section = wanted.rlike("-[A-Z]$")
    name = normalize_class(F.regexp_replace(wanted, "-[A-Z]$", ""))
    classes = periods.filter(F.col("version") == version).select(*by, "class_name", "section").distinct()
    return classes.filter((F.col("class_name") == name) & (~with_section | (F.col("section") == F.right(wanted, F.lit(1)))))


#: Rows per school that the search box shows of each kind; classes are not cut.
SEARCH_CAPS = {"teacher": 15, "subject": 60, "club": 10, "notice": 10, "document": 10}


def global_search(
    term: str, version: int, teachers: DataFrame, periods: DataFrame, clubs: DataFrame, notices: DataFrame, docs: DataFrame,
    admin: bool = False, by: Sequence[str] = BY, caps: Mapping[str, int | None] = SEARCH_CAPS,
) -> DataFrame:
    """Teachers, classes, subjects, clubs, notices and documents in one result (entity, ref, label). `caps` holds the rows
    per school and entity, as the search box shows them; None keeps all."""
    term = term.strip()

    def capped(df: DataFrame, entity: str, *order: Column) -> DataFrame:
        k = caps.get(entity)
        return df if k is None else first_rows(df, by, *order, k=k)

    def row(df: DataFrame, entity: str, ref: Column, label: Column) -> DataFrame:
        return df.select(*by, F.lit(entity).alias("entity"), ref.cast("string").alias("ref"), label.alias("label"))

    people = search_people(teachers.filter("active"), term, None, by, any_state=True).unionByName(
        teachers.filter("active").filter(holds(F.col("designation"), term) & ~holds(F.col("name"), term) & ~holds(F.col("code"), term) & ~F.coalesce(F.array_contains("aliases", term), F.lit(False)))
    )
    people = capped(people, "teacher", F.col("name"), F.col("teacher_id"))
    classes = class_search(periods, term, version, by)
    subjects = capped(subject_teachers(periods, teachers, term, version, by), "subject", F.col("subject"), F.col("teacher_id"))
    club = clubs.filter("active").filter(holds(F.col("name"), term) | F.coalesce(F.array_contains("activities", term), F.lit(False)))
    club = capped(club, "club", F.col("club_id"))
    notice = notices.filter(~F.col("archived") & (holds(F.col("title"), term) | holds(F.col("description"), term)))
    notice = capped(notice, "notice", F.col("notice_date").desc(), F.col("notice_id").desc())
    doc = visible_documents(docs, admin).filter(holds(F.col("title"), term) | holds(F.col("original_name"), term))
    doc = capped(doc, "document", F.col("doc_id"))
    parts = [
        row(people, "teacher", F.col("teacher_id"), F.col("name")),
        row(classes, "class", class_label(F.col("class_name"), F.col("section")), class_label(F.col("class_name"), F.col("section"))),
        row(subjects, "subject", F.col("teacher_id"), F.col("subject")),
        row(club, "club", F.col("club_id"), F.col("name")),
        row(notice, "notice", F.col("notice_id"), F.col("title")),
        row(doc, "document", F.col("doc_id"), F.col("title")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
