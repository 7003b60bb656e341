"""Draft checks: every rule returns issue rows (severity, scope, code, seq); `all_issues` is their union.

Codes are the contract. Drafts are told apart by `by` (school and draft). An issue is reported once per row and code.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.clock import is_clock, to_minutes
from rollbook.functions.people import classify
from rollbook.functions.text import match_key, normalize_class
from rollbook.keyed import first_rows, later_rows, with_value
from rollbook.operators import conflicts as C
from rollbook.operators.identity import resolve_names
from rollbook.session import cut_lineage, written

BY = ("school_id", "draft_id")

# What is allowed when a school sets no lists, and the limits the rules use.
CLASSES = ["VI", "VII", "VIII", "IX", "X", "XI", "XII"]
SECTIONS = ["A", "B", "C", "D", "E", "F"]
MAX_PERIOD = 12
LOW_CONFIDENCE = 0.75
EARLIEST, LATEST = 5 * 60, 21 * 60


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _issues(df: DataFrame, scope: str, checks: Sequence[tuple[str, str, Column]], by: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One pass over the rows: all failing checks of a row as an array, exploded. `keep` names columns of the rows to hand on."""
    hits = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code"))) for sev, code, cond in checks]
    out = df.select(*by, "seq", *keep, F.explode(F.array_compact(F.array(*hits))).alias("i"))
    return out.select(*by, F.lit(scope).alias("scope"), F.col("seq").cast("bigint").alias("seq"), "i.severity", "i.code", *keep)


def _flag(df: DataFrame, scope: str, severity: str, code: str, by: Sequence[str], seq: Column | None = None) -> DataFrame:
    seq = F.col("seq") if seq is None else seq
    return df.select(*by, F.lit(scope).alias("scope"), seq.cast("bigint").alias("seq"), F.lit(severity).alias("severity"), F.lit(code).alias("code"))


# ---------------------------------------------------------------- names


def resolve_once(names: DataFrame, people: DataFrame, mapping: DataFrame | None = None, by: Sequence[str] = ("school_id",)) -> DataFrame:
    """Resolved distinct names, checkpointed: a dozen rules read them, and they are far fewer than the rows."""
    return cut_lineage(resolve_names(names, people, mapping, by))


def with_person(df: DataFrame, resolved: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Add teacher_id and is_new of the printed name (resolved: by, raw, teacher_id, is_new)."""
    side = resolved.select(*by, F.col("raw").alias("_name"), "teacher_id", "is_new")
    return df.withColumn("_name", F.trim("teacher_name")).join(side, [*by, "_name"], "left")


def _named() -> Column:
    return F.col("_name") != ""


def _unknown() -> Column:
    return _named() & F.col("teacher_id").isNull() & ~F.coalesce("is_new", F.lit(False))


def _who() -> Column:
    """Teacher id as text; unresolved names still group under their own key."""
    return F.coalesce(F.col("teacher_id").cast("string"), F.concat(F.lit("name:"), match_key(F.col("teacher_name"))))


# ---------------------------------------------------------------- periods: R1-R7


def prepare_periods(periods: DataFrame, resolved: DataFrame | None = None, by: Sequence[str] = BY) -> DataFrame:
    """Periods with normalized class, minutes and, where `resolved` tells it, person."""
    minutes = [to_minutes(F.col(f"{c}_time")).alias(f"{c}_min") for c in ("start", "end")]
    out = with_value(periods, "_v", F.struct(normalize_class(F.col("class_name")).alias("cn"), *minutes)).select("*", "_v.*").drop("_v")
    return out if resolved is None else with_person(out, resolved, by)


def _clock_checks() -> list[tuple[str, str, Column]]:
    both = F.col("start_min").isNotNull() & F.col("end_min").isNotNull()

    def bad(c: str) -> Column:
        return (F.coalesce(F.col(c), F.lit("")) != "") & ~is_clock(F.col(c))

    return [("error", "time", bad("start_time") | bad("end_time")), ("error", "timeOrder", both & (F.col("end_min") <= F.col("start_min")))]


def period_rules(prepared: DataFrame, by: Sequence[str] = BY, classes: Sequence[str] = CLASSES, sections: Sequence[str] = SECTIONS, keep: Sequence[str] = ()) -> DataFrame:
    """Class, section, periodNumber, subject, teacher, teacherUnknown, teacherIncomplete, time,
    timeOrder, timeRange, timeMissing. At most one teacher issue per row; timeRange only when the order is right.
    `keep` names columns of the rows to hand on."""
    lesson = ~F.col("is_break")
    number = F.col("period_number")
    both = F.col("start_min").isNotNull() & F.col("end_min").isNotNull()
    cut_off = F.col("_name").rlike(r"[-/]\s*$")
    checks = [
        ("error", "class", F.col("cn").isNull() | ~F.col("cn").isin(list(classes))),
        ("error", "section", (F.col("section") != "") & ~F.upper("section").isin(list(sections))),
        ("error", "periodNumber", lesson & (number.isNull() | (number < 1) | (number > MAX_PERIOD))),
        ("warning", "subject", lesson & (F.trim("subject") == "")),
        ("warning", "teacher", lesson & ~_named()),
        ("error", "teacherUnknown", lesson & _unknown()),
        ("warning", "teacherIncomplete", lesson & _named() & ~_unknown() & cut_off),
        *_clock_checks(),
        ("warning", "timeRange", both & (F.col("end_min") > F.col("start_min")) & ((F.col("start_min") < EARLIEST) | (F.col("end_min") > LATEST))),
        ("warning", "timeMissing", lesson & ~both),
    ]
    return _issues(prepared, "period", checks, by, keep)


def _class_key() -> Column:
    return F.coalesce("cn", "class_name")


def duplicate_periods(prepared: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Normalized class, section, day and slot entered again."""
    rows = prepared.select(*by, "seq", _class_key().alias("class_key"), "section", "day_idx", "slot")
    return _flag(later_rows(rows, [*by, "class_key", "section", "day_idx", "slot"]), "period", "error", "duplicate", by)


def gap_issues(prepared: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Overlap and timeGap against the row just before."""
    rows = prepared.select(*by, "seq", _class_key().alias("class_name"), "section", "day_idx", "start_min", "end_min")
    gaps = C.adjacent_gap(rows, by)
    return gaps.select(*by, F.lit("period").alias("scope"), F.col("seq").cast("bigint").alias("seq"), F.lit("warning").alias("severity"), "code")


def clash_issues(prepared: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Class names are compared as printed. The few columns of the lessons are written once, as four sides of joins read them."""
    rows = prepared.select(*by, "seq", "is_break", "teacher_id", "day_idx", "class_name", "section", "start_min", "end_min", "period_number")
    rows = written(rows.filter(~F.col("is_break") & F.col("teacher_id").isNotNull()))
    return _flag(C.clashing_rows(rows, by), "period", "warning", "teacherClash", by)


# ---------------------------------------------------------------- confidence, other kinds: R4, R5, R8


def low_confidence_issues(kinds: dict[str, DataFrame], by: Sequence[str] = BY) -> DataFrame:
    """R4 over any record kinds."""
    return _union([_flag(df.filter(F.col("confidence") < LOW_CONFIDENCE), k, "warning", "lowConfidence", by) for k, df in kinds.items()])


def repeated_entries(duties: DataFrame, offs: DataFrame, clubs: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """R5 on duties (kind, date, name), weekly offs (day, name) and clubs (name); case does not matter."""
    name = F.lower(F.trim("teacher_name")).alias("_n")
    d = later_rows(duties.select(*by, "seq", "duty_type", "duty_date", name), [*by, "duty_type", "duty_date", "_n"])
    o = later_rows(offs.select(*by, "seq", "day_idx", name), [*by, "day_idx", "_n"])
    c = later_rows(clubs.select(*by, "seq", F.lower(F.trim("name")).alias("_n")), [*by, "_n"])
    return _union([_flag(x, scope, "error", "duplicate", by) for x, scope in ((d, "mod"), (o, "weeklyOff"), (c, "club"))])


def other_rules(duties: DataFrame, offs: DataFrame, remedial: DataFrame, by: Sequence[str] = BY, classes: Sequence[str] = CLASSES) -> DataFrame:
    """R8 over rows that went through `with_person`."""
    missing = [("error", "teacher", ~_named()), ("error", "teacherUnknown", _unknown())]
    rem = with_value(remedial, "cn", normalize_class(F.col("class_name")))
    rem = rem.withColumn("start_min", to_minutes(F.col("start_time"))).withColumn("end_min", to_minutes(F.col("end_time")))
    checks = [
        ("error", "class", F.col("cn").isNull() | ~F.col("cn").isin(list(classes))),
        ("warning", "activity", F.trim("activity") == ""),
        *_clock_checks(),
        ("error", "teacherUnknown", _unknown()),
    ]
    return _union([_issues(duties, "mod", missing, by), _issues(offs, "weeklyOff", missing, by), _issues(rem, "remedial", checks, by)])


# ---------------------------------------------------------------- whole draft, names: R9, R10


def draft_issues(drafts: DataFrame, kinds: dict[str, DataFrame], by: Sequence[str] = BY) -> DataFrame:
    """Empty drafts; timetable drafts (kind ROUTINE) without periods. `drafts` holds (by, kind)."""
    counts = _union([df.select(*by, F.lit(1 if k == "period" else 0).alias("_p")) for k, df in kinds.items()])
    counts = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.sum("_p").alias("periods"))
    d = drafts.join(counts, list(by), "left").withColumn("seq", F.lit(None).cast("bigint"))
    total = F.coalesce("total", F.lit(0))
    checks = [("error", "empty", total == 0), ("warning", "noPeriods", (F.col("kind") == "ROUTINE") & (total > 0) & (F.coalesce("periods", F.lit(0)) == 0))]
    return _issues(d, "general", checks, by)


def name_issues(resolved: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """One hint per unresolved name, and an error when it reads like heading text. Adds the name."""
    open_names = resolved.filter(F.col("teacher_id").isNull() & ~F.col("is_new"))
    noise = F.when(classify(F.col("raw"))["kind"] == "garbage", F.struct(F.lit("error").alias("severity"), F.lit("teacherNotName").alias("code")))
    hint = F.struct(F.lit("warning").alias("severity"), F.lit("teacherHint").alias("code"))
    return open_names.select(*by, "raw", F.explode(F.array_compact(F.array(noise, hint))).alias("i")).select(*by, F.col("raw").alias("name"), "i.severity", "i.code")


# ---------------------------------------------------------------- duty and remedial collisions: R11, R12


def _off_of(offs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weekly off per person; the last row entered counts."""
    rows = offs.withColumn("who", _who()).groupBy(*by, "who").agg(F.max_by("day_idx", "seq").alias("day_idx"))
    return rows


def roster_issues(duties: DataFrame, offs: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """dutyClash (hides the row's other checks), dutyBackToBack, dutyOnOff, dutyOnCompOff, manyMod.

    Rows went through `with_person`; unresolved names are followed under their own key."""
    rows = with_value(duties, "who", _who()).select(*by, "seq", "who", "duty_date", "duty_type", "off_date")
    seqd = C.duty_sequence(rows, by, "who").withColumn("day_idx", F.weekday("duty_date"))
    off = _off_of(offs, by).withColumn("_off", F.lit(True))
    comp = rows.filter(F.col("off_date").isNotNull()).select(*by, "who", F.col("off_date").alias("duty_date")).distinct().withColumn("_comp", F.lit(True))
    seqd = seqd.join(off, [*by, "who", "day_idx"], "left").join(comp, [*by, "who", "duty_date"], "left")
    first = ~F.col("same_day")
    checks = [
        ("warning", "dutyClash", F.col("same_day")),
        ("warning", "dutyBackToBack", first & F.col("next_day")),
        ("warning", "dutyOnOff", first & F.col("_off") & (F.col("duty_type") == "MOD")),
        ("warning", "dutyOnCompOff", first & F.col("_comp")),
    ]
    many = _flag(C.many_per_date(rows, by), "mod", "warning", "manyMod", by)
    return _issues(seqd, "mod", checks, by).unionByName(many)


def remedial_issues(remedial: DataFrame, offs: DataFrame, lessons: DataFrame, by: Sequence[str] = BY, school: Sequence[str] = ("school_id",)) -> DataFrame:
    """remedialOnOff, remedialClash (against the active timetable), remedialDouble."""
    rows = with_value(remedial, "who", _who()).withColumn("start_min", to_minutes(F.col("start_time"))).withColumn("end_min", to_minutes(F.col("end_time")))
    rows = rows.filter(_named() & F.col("day_idx").isNotNull() & F.col("start_min").isNotNull() & F.col("end_min").isNotNull())
    on_off = rows.join(_off_of(offs, by), [*by, "who", "day_idx"], "left_semi")
    clash = C.remedial_clash(rows.filter(F.col("teacher_id").isNotNull()), lessons, school)
    double = C.doubled_rows(rows.drop("teacher_id").withColumn("teacher_id", F.col("who")), by)
    return _union([_flag(df, "remedial", "warning", code, by) for df, code in ((on_off, "remedialOnOff"), (clash, "remedialClash"), (double, "remedialDouble"))])


def roster_audit(duties: DataFrame, offs: DataFrame, remedial: DataFrame, lessons: DataFrame, resolved: DataFrame, by: Sequence[str] = BY, school: Sequence[str] = ("school_id",)) -> DataFrame:
    """Every collision of a hand-edited roster, by the rules the planner follows: R11 over duties and days off, R12 over extra
    classes. `resolved` (by or school, raw, teacher_id, is_new) tells who a printed name is."""
    duties, offs, remedial = (written(with_person(x, resolved, school)) for x in (duties, offs, remedial))  # each is read three times
    return roster_issues(duties, offs, by).unionByName(remedial_issues(remedial, offs, lessons, by, school))


# ---------------------------------------------------------------- all together: U5, G17, P7


def all_issues(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of rule outputs; a missing `name` column is filled with null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def issue_summary(issues: DataFrame, drafts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Errors and warnings of each draft; a draft without errors may be published."""
    g = issues.groupBy(*by).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = drafts.select(*by).distinct().join(g, list(by), "left")
    zero = F.lit(0).cast("long")
    return out.select(*by, F.coalesce("errors", zero).alias("errors"), F.coalesce("warnings", zero).alias("warnings")).withColumn("publishable", F.col("errors") == 0)


def repeated_findings(prepared: DataFrame, remedial: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(by, severity, more) for what a rule finds more than once on a row, where an issue is kept once per row and code: a second clock
    that cannot be read, and every further lesson or extra class that a row overlaps."""
    one = F.lit(1).cast("long")

    def bad(c: str) -> Column:
        return (F.coalesce(F.col(c), F.lit("")) != "") & ~is_clock(F.col(c))

    clocks = [df.filter(bad("start_time") & bad("end_time")).select(*by, F.lit("error").alias("severity"), one.alias("more")) for df in (prepared, remedial)]
    rows = prepared.select(*by, "seq", "is_break", "teacher_id", "day_idx", "class_name", "section", "start_min", "end_min", "period_number")
    booked = with_value(remedial, "who", _who()).withColumn("start_min", to_minutes(F.col("start_time"))).withColumn("end_min", to_minutes(F.col("end_time")))
    booked = booked.filter(_named() & F.col("day_idx").isNotNull() & F.col("start_min").isNotNull() & F.col("end_min").isNotNull()).drop("teacher_id").withColumn("teacher_id", F.col("who"))
    parts = [(C.teacher_clash(rows, by), C.clashing_rows(rows, by)), (C.remedial_double(booked, by), C.doubled_rows(booked, by))]
    found = []
    for pairs, once in parts:
        found.append(pairs.select(*by, F.col("pairs").cast("long").alias("more")).unionByName(once.select(*by, (-one).alias("more"))).withColumn("severity", F.lit("warning")))
    out = _union([*clocks, *[f.select(*by, "severity", "more") for f in found]])
    return out.groupBy(*by, "severity").agg(F.sum("more").alias("more")).filter("more <> 0")


def issue_totals(issues: DataFrame, repeated: DataFrame, drafts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """All findings of each draft - its issues and what `repeated_findings` adds to them."""
    rows = issues.select(*by, "severity", F.lit(1).cast("long").alias("more")).unionByName(repeated.select(*by, "severity", "more"))
    return _per_severity(rows, drafts, by)


def _per_severity(rows: DataFrame, drafts: DataFrame, by: Sequence[str]) -> DataFrame:
    sums = {f"{s}s": F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("more"))), F.lit(0)) for s in ("error", "warning")}
    g = rows.groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()])
    out = drafts.select(*by).distinct().join(g, list(by), "left")
    return out.select(*by, *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in sums]).withColumn("publishable", F.col("errors") == 0)


def issues_by_class(issues: DataFrame, periods: DataFrame | None = None, by: Sequence[str] = BY) -> DataFrame:
    """Errors and warnings of each class-section as printed. `periods` may be left out where the issues keep class_name and section."""
    rows = issues.filter((F.col("scope") == "period") & F.col("seq").isNotNull())
    if periods is not None:
        rows = rows.join(periods.select(*by, "seq", "class_name", "section"), [*by, "seq"])
    return rows.groupBy(*by, "class_name", "section").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def issues_by_item(issues: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The issues of each item (a row has a dozen rules at most, so the list is short)."""
    rows = issues.filter(F.col("seq").isNotNull()).groupBy(*by, "scope", "seq")
    return rows.agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"), F.count(F.lit(1)).alias("issues"))


# ---------------------------------------------------------------- write-side checks: R13, R14


def _too_long(c: str, limit: int) -> Column:
    return F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > limit


def _too_short(c: str, least: int) -> Column:
    return F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) < least


def _rejects(df: DataFrame, keep: Sequence[str], checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows that fail, one per failing check; rows without any are accepted."""
    hits = [F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in checks]
    return df.select(*keep, F.explode(F.array_compact(F.array(*hits))).alias("problem"))


def reject_people(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return _rejects(
        df, keep,
        [("name", _too_short("name", 2) | _too_long("name", 120)), ("code", _too_long("code", 40)), ("designation", _too_long("designation", 80)), ("aliases", (F.size("aliases") > 10) | F.exists("aliases", lambda a: F.length(F.trim(a)) > 120)),
         *([("phone", _too_long("phone", 30))] if "phone" in df.columns else [])],
    )


def reject_notices(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    bad_date = ~F.col("notice_date").rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date("notice_date", "yyyy-MM-dd").isNull()
    return _rejects(
        df, keep,
        [("title", _too_short("title", 2) | _too_long("title", 160)), ("description", _too_short("description", 1) | _too_long("description", 5000)),
         ("date", F.coalesce(bad_date, F.lit(True))), ("priority", ~F.col("priority").isin("LOW", "NORMAL", "HIGH", "URGENT"))],
    )


def reject_periods(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Period edits: clock format, text lengths, end after start."""
    s, e = to_minutes(F.col("start_time")), to_minutes(F.col("end_time"))

    def bad(c: str) -> Column:
        return F.col(c).isNotNull() & ~is_clock(F.col(c))

    room = [("room", _too_long("room", 40))] if "room" in df.columns else []
    return _rejects(df, keep, [("subject", _too_long("subject", 120)), ("start_time", bad("start_time")), ("end_time", bad("end_time")), ("order", e <= s), *room])


def reject_remedial(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return _rejects(
        df, keep,
        [("class", _too_short("class_name", 1) | _too_long("class_name", 10)), ("section", _too_long("section", 3)), ("activity", _too_short("activity", 1) | _too_long("activity", 200)),
         ("start_time", F.col("start_time").isNotNull() & ~is_clock(F.col("start_time"))), ("end_time", F.col("end_time").isNotNull() & ~is_clock(F.col("end_time")))],
    )


def _iso(c: Column) -> Column:
    """Whether text is a date written YYYY-MM-DD."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def reject_clubs(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Clubs (name, members, activities)."""

    def bad(c: str, longest: int) -> Column:
        return (F.size(c) > 60) | F.exists(c, lambda x: F.length(F.trim(x)) > longest)

    return _rejects(df, keep, [("name", _too_short("name", 2) | _too_long("name", 120)), ("members", bad("members", 160)), ("activities", bad("activities", 300))])


def reject_duty_requests(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Requests to put teachers on duty (dates, teacher_ids as text, description, duty_type)."""
    dates = ~F.coalesce(F.size("dates").between(1, 62), F.lit(False)) | F.exists("dates", lambda d: ~_iso(d))
    people = ~F.coalesce(F.size("teacher_ids").between(1, 30), F.lit(False)) | F.exists("teacher_ids", lambda i: F.coalesce(i, F.lit("")) == "")
    return _rejects(df, keep, [("dates", dates), ("teachers", people), ("description", _too_long("description", 300)), ("type", ~F.col("duty_type").isin("MOD", "HOLIDAY"))])


def reject_accounts(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """New accounts (username, password): the name counts trimmed and in lower case."""
    name = F.lower(F.trim(F.coalesce("username", F.lit(""))))
    word = F.length(F.coalesce("password", F.lit("")))
    return _rejects(df, keep, [("username", ~F.length(name).between(3, 40) | ~name.rlike("^[a-z0-9._-]+$")), ("password", ~word.between(8, 100))])


def reject_settings(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Changes of a school's settings; a null field is not changed."""

    def text(c: str, least: int, most: int) -> tuple[str, Column]:
        return (c, ~F.length(F.trim(c)).between(least, most))

    def items(c: str, least: int, longest: int) -> tuple[str, Column]:
        return (c, ~F.size(c).between(least, 20) | F.exists(c, lambda x: ~F.length(F.trim(x)).between(1, longest)))

    mail = F.trim("contact_email")
    checks = [
        text("school_name", 2, 160), text("school_address", 2, 200), text("portal_name", 2, 80), items("classes", 1, 10), items("sections", 0, 3), text("contact_phone", 0, 30),
        ("contact_email", (mail != "") & (~mail.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$") | (F.length(mail) > 120))), text("footer_text", 0, 300),
    ]
    present = [(n, F.col(n).isNotNull() & c) for n, c in checks if n in df.columns]
    return _rejects(df, keep, present)


def reject_subjects(new: DataFrame, existing: DataFrame, by: Sequence[str] = ("school_id",)) -> DataFrame:
    """New subjects (by, seq, name) that exist already, whatever their case, in the table or earlier in the batch."""
    rows = new.withColumn("_n", F.lower(F.trim("name")))
    known = existing.select(*by, F.lower("name").alias("_n")).distinct()
    again = later_rows(rows, [*by, "_n"]).select(*by, "seq", "name")
    taken = rows.join(known, [*by, "_n"], "left_semi").select(*by, "seq", "name")
    return again.unionByName(taken).distinct()


def guarded_subjects(subjects: DataFrame, periods: DataFrame, by: Sequence[str] = ("school_id",)) -> DataFrame:
    """Subjects some lesson uses; they cannot be deleted."""
    return subjects.join(periods.select(*by, "subject").distinct(), [*by, "subject"], "left_semi")


def guarded_teachers(teachers: DataFrame, periods: DataFrame, duties: DataFrame, by: Sequence[str] = ("school_id",)) -> DataFrame:
    """Teachers with lessons or duties."""
    key = [*by, "teacher_id"]
    used = periods.filter(F.col("teacher_id").isNotNull()).select(*key).unionByName(duties.select(*key)).distinct()
    return teachers.join(used, key, "left_semi")


def guarded_routines(routines: DataFrame) -> DataFrame:
    """The active version."""
    return routines.filter(F.col("status") == "ACTIVE")
