"""Registered reads: timetable views, listings, search, workload."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from rollbook.functions.text import class_rank
from rollbook.operators import reads as R
from rollbook.operators import timeline as T
from rollbook.plans.registry import query

DAY = date(1998, 6, 15)  # a Monday inside the order dates
D = "DATE '1998-06-15'"
LAST = "DATE '1999-01-01'"

_WEEK = """
 blocks AS (SELECT school_id, teacher_id, day_idx, 0 AS kind, seq, start_min, end_min, 'Class ' || CASE WHEN section <> '' THEN class_name || '-' || section ELSE class_name END AS label FROM f_period
   WHERE version = 2 AND NOT is_break AND teacher_id IS NOT NULL
  UNION ALL SELECT school_id, teacher_id, day_idx, 1, seq, start_min, end_min, CASE WHEN activity = '' THEN 'Remedial/enrichment duty' ELSE activity END
   FROM f_remedial WHERE active AND day_idx IS NOT NULL)"""
_FREE = f"""{_WEEK},
 gaps AS (SELECT school_id, teacher_id, day_idx, kind, start_min - lag(end_min) OVER (PARTITION BY school_id, teacher_id, day_idx ORDER BY start_min, kind, seq) AS gap FROM blocks),
 days AS (SELECT school_id, teacher_id, day_idx, sum(CASE WHEN gap > 0 THEN gap ELSE 0 END) AS gap, min(kind) AS kind FROM gaps GROUP BY ALL),
 free AS (SELECT school_id, teacher_id, CAST(sum(gap) AS BIGINT) AS free_minutes FROM days WHERE kind = 0 GROUP BY ALL)"""


def lessons(t):
    return t.f_period.filter((F.col("version") == 2) & ~F.col("is_break") & F.col("teacher_id").isNotNull())


def week(t):
    return T.merge_timeline(lessons(t), t.f_remedial)


@query(
    "teacher_workload",
    f"""WITH {_FREE},
 load AS (SELECT school_id, teacher_id, count(*) AS n, count(DISTINCT class_name || '|' || section) AS c FROM f_period
   WHERE version = 2 AND NOT is_break AND teacher_id IS NOT NULL GROUP BY ALL),
 mods AS (SELECT school_id, teacher_id, count(*) AS n FROM f_duty WHERE duty_type = 'MOD' GROUP BY ALL)
 SELECT t.school_id, t.teacher_id, t.name, coalesce(l.n, 0) AS periods_per_week, coalesce(l.c, 0) AS classes, coalesce(m.n, 0) AS mod_duties,
  coalesce(f.free_minutes, 0) AS free_minutes FROM f_teacher t LEFT JOIN load l USING (school_id, teacher_id)
  LEFT JOIN mods m USING (school_id, teacher_id) LEFT JOIN free f USING (school_id, teacher_id) WHERE t.active""",
)
def teacher_workload(t):
    return T.teacher_workload(t.f_teacher, t.f_period, t.f_remedial, t.f_duty, 2)


@query("merge_timeline", f"WITH {_WEEK} SELECT * FROM blocks")
def merge_timeline(t):
    return week(t)


@query("free_minutes", f"WITH {_FREE} SELECT * FROM free")
def free_minutes(t):
    return T.free_minutes(week(t))


@query(
    "day_status",
    f"""WITH {_WEEK}, today AS (SELECT * FROM blocks WHERE day_idx = 0),
 cur AS (SELECT * FROM today WHERE start_min <= 615 AND 615 < end_min QUALIFY row_number() OVER (PARTITION BY school_id, teacher_id ORDER BY start_min, kind, seq) = 1),
 nxt AS (SELECT * FROM today WHERE start_min > 615 QUALIFY row_number() OVER (PARTITION BY school_id, teacher_id ORDER BY start_min, kind, seq) = 1)
 SELECT t.school_id, t.teacher_id, CASE WHEN c.seq IS NOT NULL THEN 'in-class' WHEN n.seq IS NOT NULL THEN 'upcoming' WHEN d.teacher_id IS NOT NULL THEN 'day-done' ELSE 'no-classes' END AS status,
  coalesce(c.label, n.label) AS label, CASE WHEN c.seq IS NOT NULL THEN c.end_min - 615 ELSE n.start_min - 615 END AS minutes
 FROM f_teacher t LEFT JOIN (SELECT DISTINCT school_id, teacher_id FROM today) d USING (school_id, teacher_id)
 LEFT JOIN cur c USING (school_id, teacher_id) LEFT JOIN nxt n USING (school_id, teacher_id)""",
)
def day_status(t):
    return T.teacher_status(week(t).filter("day_idx = 0"), t.f_teacher, F.lit(615))


_ROWS = """rows_ AS (SELECT p.school_id, version, seq, class_name, section, day_idx, slot, period_number, is_break, label, start_min, end_min, subject, p.teacher_id,
 coalesce(t.name, printed_teacher) AS teacher_name FROM f_period p LEFT JOIN f_teacher t ON p.school_id = t.school_id AND p.teacher_id = t.teacher_id)"""


def rows(t):
    return R.period_rows(t.f_period, t.f_teacher)


@query("period_rows", f"WITH {_ROWS} SELECT * FROM rows_")
def period_rows(t):
    return rows(t)


@query("with_teacher", "SELECT d.*, t.name AS directory_name, t.active AS teacher_active FROM f_duty d LEFT JOIN f_teacher t USING (school_id, teacher_id)")
def with_teacher(t):
    return R.with_teacher(t.f_duty, t.f_teacher)


@query("weekly_off_active", "SELECT o.*, t.name FROM f_weekly_off o JOIN f_teacher t USING (school_id, teacher_id) WHERE t.active")
def weekly_off_active(t):
    return R.weekly_off_active(t.f_weekly_off, t.f_teacher)


@query("class_periods", f"WITH {_ROWS} SELECT * FROM rows_ WHERE version = 2 AND class_name = 'VIII' AND section = 'A'")
def class_periods(t):
    return R.class_periods(rows(t), 2, "VIII", "A")


@query("day_periods", f"WITH {_ROWS} SELECT * FROM rows_ WHERE version = 2 AND day_idx = 3 AND class_name = 'X'")
def day_periods(t):
    return R.day_periods(rows(t), 2, 3, "X")


@query("all_periods", f"WITH {_ROWS} SELECT * FROM rows_ WHERE version = 2")
def all_periods(t):
    return R.all_periods(rows(t), 2)


@query("teacher_periods", f"WITH {_ROWS} SELECT * FROM rows_ WHERE version = 2 AND NOT is_break AND teacher_id IS NOT NULL")
def teacher_periods(t):
    return R.teacher_periods(rows(t), 2)


@query("period_query", f"WITH {_ROWS} SELECT * FROM rows_ WHERE version = 2 AND class_name = 'IX' AND day_idx = 1")
def period_query(t):
    return R.period_query(rows(t), 2, class_name="IX", day_idx=1)


@query("domain_order", "SELECT school_id, seq, class_name, section, day_idx, start_min, CAST(CASE class_name WHEN 'VI' THEN 6 WHEN 'VII' THEN 7 WHEN 'VIII' THEN 8 WHEN 'IX' THEN 9 WHEN 'X' THEN 10 WHEN 'XI' THEN 11 ELSE 12 END AS INT) AS class_rank FROM f_remedial")
def domain_order(t):
    d = R.domain_order(t.f_remedial, time="start_min")
    return d.select("school_id", "seq", "class_name", "section", "day_idx", "start_min", class_rank(F.col("class_name")).alias("class_rank"))


@query("by_time", "SELECT school_id, version, seq, start_min, slot FROM f_period WHERE NOT is_break")
def by_time(t):
    return R.by_time(t.f_period.filter("not is_break"), "school_id", "version").select("school_id", "version", "seq", "start_min", "slot")


def people(t):
    return t.f_teacher.withColumn("aliases", F.split("alias_list", ";")).drop("alias_list")


_PEOPLE_COLS = "school_id, teacher_id, name, code"


@query(
    "search_people",
    f"""SELECT {_PEOPLE_COLS} FROM f_teacher WHERE active AND (contains(lower(name), 'kum') OR contains(lower(code), 'kum') OR list_contains(string_split(alias_list, ';'), 'Kum'))
 QUALIFY row_number() OVER (PARTITION BY school_id ORDER BY name, teacher_id) <= 12""",
)
def search_people(t):
    return R.search_people(people(t), " Kum ").select("school_id", "teacher_id", "name", "code")


@query("search_people_by_alias", f"SELECT {_PEOPLE_COLS} FROM f_teacher WHERE active AND list_contains(string_split(alias_list, ';'), 'A. BUILDING')")
def search_people_by_alias(t):
    return R.search_people(people(t), "A. BUILDING", None).select("school_id", "teacher_id", "name", "code")


@query(
    "search_people_admin",
    f"""SELECT {_PEOPLE_COLS} FROM f_teacher WHERE contains(lower(name), 's.sc') OR contains(lower(code), 's.sc')
 QUALIFY row_number() OVER (PARTITION BY school_id ORDER BY name, teacher_id) <= 15""",
)
def search_people_admin(t):
    return R.search_people(people(t), "s.sc", 15, use_aliases=False, any_state=True).select("school_id", "teacher_id", "name", "code")


@query("combined_field_filter", f"SELECT {_PEOPLE_COLS} FROM f_teacher WHERE active AND contains(lower(name || ' ' || code || ' ' || coalesce(designation, '')), 'hin warden')")
def combined_field_filter(t):
    return R.combined_field_filter(people(t), "HIN Warden").select("school_id", "teacher_id", "name", "code")


@query("roster_pool", f"SELECT {_PEOPLE_COLS} FROM f_teacher t WHERE active AND NOT EXISTS (SELECT 1 FROM f_user u WHERE u.school_id = t.school_id AND u.teacher_id = t.teacher_id)")
def roster_pool(t):
    return R.roster_pool(people(t), t.f_user).select("school_id", "teacher_id", "name", "code")


@query("missing_logins", f"SELECT {_PEOPLE_COLS} FROM f_teacher t WHERE active AND teacher_id NOT IN (SELECT teacher_id FROM f_user)")
def missing_logins(t):
    return R.missing_logins(people(t), t.f_user).select("school_id", "teacher_id", "name", "code")


@query(
    "directory_list",
    """SELECT t.school_id, t.teacher_id, t.name, t.active, u.username, coalesce(o.off_days, '') AS off_days, t.active AND u.username IS NULL AS login_missing
 FROM f_teacher t LEFT JOIN f_user u USING (school_id, teacher_id) LEFT JOIN
 (SELECT school_id, teacher_id, string_agg(DISTINCT CAST(day_idx AS VARCHAR), ',' ORDER BY CAST(day_idx AS VARCHAR)) AS off_days FROM f_weekly_off GROUP BY ALL) o USING (school_id, teacher_id)""",
)
def directory_list(t):
    return R.directory_list(t.f_teacher, t.f_user, t.f_weekly_off)


@query("duties_on", f"SELECT * FROM f_duty WHERE duty_date = {D} AND duty_type = 'MOD'")
def duties_on(t):
    return R.duties_on(t.f_duty, DAY, "MOD")


@query("duties_between", f"SELECT * FROM f_duty WHERE duty_date BETWEEN {D} AND {LAST}")
def duties_between(t):
    return R.duties_between(t.f_duty, DAY, date(1999, 1, 1))


@query(
    "upcoming_duties",
    f"SELECT d.* FROM f_duty d JOIN f_teacher t USING (school_id, teacher_id) WHERE duty_date >= {D} AND duty_type = 'MOD' QUALIFY row_number() OVER (PARTITION BY d.school_id ORDER BY duty_date, t.name, duty_id) <= 60",
)
def upcoming_duties(t):
    return R.upcoming_duties(t.f_duty, t.f_teacher, DAY)


@query("dated_offs", f"SELECT school_id, duty_id, teacher_id, off_date, duty_date FROM f_duty WHERE duty_type = 'HOLIDAY' AND off_date >= {D}")
def dated_offs(t):
    return R.dated_offs(t.f_duty, DAY)


_OFF = f"""off_ AS (SELECT school_id, teacher_id, max(source) AS source FROM (
 SELECT o.school_id, o.teacher_id, 'weekly' AS source FROM f_weekly_off o JOIN f_teacher t USING (school_id, teacher_id) WHERE t.active AND o.day_idx = 0
 UNION ALL SELECT school_id, teacher_id, 'dated' FROM f_duty WHERE duty_type = 'HOLIDAY' AND off_date = {D}) GROUP BY ALL)"""


@query("off_on", f"WITH {_OFF} SELECT * FROM off_")
def off_on(t):
    return R.off_on(t.f_weekly_off, t.f_duty, t.f_teacher, DAY)


@query(
    "teacher_day",
    f"""WITH {_OFF}, les AS (SELECT school_id, teacher_id, count(*) AS n, min(start_min) AS first_start FROM f_period WHERE version = 2 AND NOT is_break AND day_idx = 0 GROUP BY ALL),
 mods AS (SELECT DISTINCT school_id, teacher_id FROM f_duty WHERE duty_type = 'MOD' AND duty_date = {D}),
 ahead AS (SELECT * FROM f_duty WHERE duty_date >= {D} QUALIFY row_number() OVER (PARTITION BY school_id, teacher_id ORDER BY duty_date, duty_id) <= 20),
 nxt AS (SELECT school_id, teacher_id, least(count(*) FILTER (duty_type = 'MOD' AND duty_date > {D}), 6) AS m, least(count(*) FILTER (duty_type = 'HOLIDAY' AND duty_date > {D}), 6) AS h,
  min(duty_date) FILTER (duty_date > {D}) AS d FROM ahead GROUP BY ALL)
 SELECT t.school_id, t.teacher_id, t.name, coalesce(l.n, 0) AS lessons, l.first_start, m.teacher_id IS NOT NULL AS on_mod, o.teacher_id IS NOT NULL AS is_off,
  coalesce(x.m, 0) AS next_mod, coalesce(x.h, 0) AS next_holiday, x.d AS next_date
 FROM f_teacher t LEFT JOIN les l USING (school_id, teacher_id) LEFT JOIN mods m ON t.school_id = m.school_id AND t.teacher_id = m.teacher_id
 LEFT JOIN off_ o ON t.school_id = o.school_id AND t.teacher_id = o.teacher_id LEFT JOIN nxt x ON t.school_id = x.school_id AND t.teacher_id = x.teacher_id WHERE t.active""",
)
def teacher_day(t):
    return R.teacher_day(t.f_period, t.f_duty, t.f_weekly_off, t.f_teacher, 2, DAY)


@query(
    "next_duties",
    f"""WITH ahead AS (SELECT * FROM f_duty WHERE duty_date >= {D} QUALIFY row_number() OVER (PARTITION BY school_id, teacher_id ORDER BY duty_date, duty_id) <= 20)
 SELECT school_id, teacher_id, duty_type, CAST(row_number() OVER (PARTITION BY school_id, teacher_id, duty_type ORDER BY duty_date, duty_id) AS INTEGER) AS place, duty_date, duty_id FROM ahead WHERE duty_date > {D}
 QUALIFY row_number() OVER (PARTITION BY school_id, teacher_id, duty_type ORDER BY duty_date, duty_id) <= 6
 UNION ALL SELECT school_id, teacher_id, duty_type, 0, duty_date, duty_id FROM ahead WHERE duty_date = {D} AND duty_type = 'HOLIDAY' QUALIFY row_number() OVER (PARTITION BY school_id, teacher_id ORDER BY duty_id) = 1""",
)
def next_duties(t):
    return R.next_duties(t.f_duty, DAY)


@query(
    "availability",
    f"""SELECT school_id, count(*) AS total, count(*) FILTER (duty_date = {D}) AS today,
 CASE WHEN count(*) FILTER (duty_date = {D}) > 0 THEN 'rows' ELSE 'none_on_date' END AS state FROM f_duty GROUP BY school_id""",
)
def availability(t):
    return R.availability(t.f_duty, F.col("duty_date") == F.lit(DAY))


@query("remedial_list", "SELECT r.*, t.name AS directory_name FROM f_remedial r LEFT JOIN f_teacher t USING (school_id, teacher_id) WHERE r.active")
def remedial_list(t):
    return R.remedial_list(t.f_remedial, t.f_teacher)


@query("club_list", "SELECT club_id, name FROM f_club WHERE active")
def club_list(t):
    return R.club_list(t.f_club).select("club_id", "name")


_DOC = "doc_id, school_id, kind, extraction_status, created_on"
_VIS = "NOT archived AND mime <> 'application/x-generated' AND extraction_status IN ('PUBLISHED', 'NOT_APPLICABLE')"
DOC = [c.strip() for c in _DOC.split(",")]


@query("visible_documents", f"SELECT {_DOC} FROM f_doc WHERE {_VIS}")
def visible_documents(t):
    return R.visible_documents(t.f_doc).select(*DOC)


@query(
    "pending_documents",
    f"""SELECT {_DOC} FROM f_doc WHERE NOT archived AND extraction_status IN ('REVIEW', 'PROCESSING', 'QUEUED', 'FAILED')
 QUALIFY row_number() OVER (PARTITION BY school_id ORDER BY created_on DESC, doc_id) <= 10""",
)
def pending_documents(t):
    return R.pending_documents(t.f_doc).select(*DOC)


@query("documents_by_kind", f"SELECT school_id, kind, count(*) AS documents, max(created_on) AS newest FROM f_doc WHERE {_VIS} GROUP BY ALL")
def documents_by_kind(t):
    return R.documents_by_kind(t.f_doc)


@query("routine_list", "SELECT * FROM f_routine WHERE status = 'ACTIVE'")
def routine_list(t):
    return R.routine_list(t.f_routine, admin=False)


@query("notice_list", "SELECT * FROM f_notice WHERE NOT archived QUALIFY row_number() OVER (PARTITION BY school_id ORDER BY notice_date DESC, notice_id DESC) <= 200")
def notice_list(t):
    return R.notice_list(t.f_notice)


_RANK = "CASE priority WHEN 'URGENT' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'NORMAL' THEN 2 ELSE 3 END"


@query(
    "latest_notices",
    f"""SELECT * FROM (SELECT * FROM f_notice WHERE NOT archived QUALIFY row_number() OVER (PARTITION BY school_id ORDER BY notice_date DESC, notice_id DESC) <= 50)
 QUALIFY row_number() OVER (PARTITION BY school_id ORDER BY {_RANK}, notice_date DESC, notice_id DESC) <= 5""",
)
def latest_notices(t):
    return R.latest_notices(t.f_notice)


@query("priority_order", f"SELECT notice_id, priority, CAST({_RANK} AS INT) AS urgency FROM f_notice")
def priority_order(t):
    d = t.f_notice.select("notice_id", "priority", R.priority_rank(F.col("priority")).alias("urgency"))
    return d.orderBy("urgency", "notice_id")


@query("activity_page", "SELECT event_id, created_at, entity_type FROM f_activity ORDER BY created_at DESC, event_id DESC LIMIT 40 OFFSET 80")
def activity_page(t):
    d = t.f_activity.select("event_id", "created_at", "entity_type")
    return R.page_of(d, 3, 40, F.col("created_at").desc(), F.col("event_id").desc())


@query("activity_deep_page", "SELECT event_id, created_at, entity_type FROM f_activity ORDER BY created_at DESC, event_id DESC LIMIT 40 OFFSET 7960")
def activity_deep_page(t):
    d = t.f_activity.select("event_id", "created_at", "entity_type")
    return R.deep_page(d, 200, 40, F.col("created_at").desc(), F.col("event_id").desc())


@query("activity_next_page", "SELECT event_id, created_at, entity_type FROM f_activity WHERE created_at < TIMESTAMP '2024-01-09 12:00:00' OR (created_at = TIMESTAMP '2024-01-09 12:00:00' AND event_id < 500) ORDER BY created_at DESC, event_id DESC LIMIT 40")
def activity_next_page(t):
    d = t.f_activity.select("event_id", "created_at", "entity_type")
    return R.page_after(d, [("created_at", datetime(2024, 1, 9, 12), True), ("event_id", 500, True)], 40)


@query("activity_page_count", "SELECT entity_type, greatest(CAST(ceil(count(*) / 40.0) AS BIGINT), 1) AS pages FROM f_activity GROUP BY ALL")
def activity_page_count(t):
    return R.page_count(t.f_activity, 40, ["entity_type"])


@query("low_confidence", "SELECT school_id, seq, confidence FROM f_period WHERE confidence < 0.75")
def low_confidence(t):
    return R.low_confidence(t.f_period).select("school_id", "seq", "confidence")


@query("class_sections", "SELECT DISTINCT school_id, class_name, section, CASE WHEN section <> '' THEN class_name || '-' || section ELSE class_name END AS label FROM f_period")
def class_sections(t):
    return R.class_sections(t.f_period)


@query("working_days", "SELECT DISTINCT school_id, day_idx FROM f_period WHERE version = 2")
def working_days(t):
    return R.working_days(t.f_period.filter("version = 2"))


@query("entity_types", "SELECT DISTINCT entity_type FROM f_activity")
def entity_types(t):
    return R.entity_types(t.f_activity)


@query(
    "teachers_off_by_weekday",
    """SELECT o.school_id, o.day_idx, t.name, o.teacher_id, count(*) OVER (PARTITION BY o.school_id, o.day_idx) AS group_size
 FROM f_weekly_off o JOIN f_teacher t USING (school_id, teacher_id) WHERE t.active""",
)
def teachers_off_by_weekday(t):
    return R.group_list(R.weekly_off_active(t.f_weekly_off, t.f_teacher), ["school_id", "day_idx"], ["name", "teacher_id"])


@query("duties_by_date", "SELECT school_id, duty_date, duty_type, teacher_id, duty_id, count(*) OVER (PARTITION BY school_id, duty_date) AS group_size FROM f_duty")
def duties_by_date(t):
    return R.group_list(t.f_duty, ["school_id", "duty_date"], ["duty_type", "teacher_id", "duty_id"])


@query("dated_offs_by_date", f"SELECT school_id, off_date, teacher_id, duty_id, count(*) OVER (PARTITION BY school_id, off_date) AS group_size FROM f_duty WHERE duty_type = 'HOLIDAY' AND off_date >= {D}")
def dated_offs_by_date(t):
    return R.group_list(R.dated_offs(t.f_duty, DAY), ["school_id", "off_date"], ["teacher_id", "duty_id"])


_SUBJ = """subj AS (SELECT DISTINCT p.school_id, p.subject, p.teacher_id, t.name FROM f_period p JOIN f_teacher t ON p.school_id = t.school_id AND p.teacher_id = t.teacher_id
 WHERE version = 2 AND NOT is_break AND contains(lower(subject), '{term}'))"""


@query("subject_teachers", f"WITH {_SUBJ.format(term='ma')} SELECT school_id, subject, teacher_id, name FROM subj")
def subject_teachers(t):
    return R.subject_teachers(t.f_period, t.f_teacher, "MA", 2)


def _caps(term: str, cls: str) -> str:
    return f"""WITH {_SUBJ.format(term=term)},
 people_ AS (SELECT school_id, 'teacher' AS entity, CAST(teacher_id AS VARCHAR) AS ref, name AS label FROM f_teacher WHERE active AND (contains(lower(name), '{term}') OR contains(lower(code), '{term}')
  OR contains(lower(coalesce(designation, '')), '{term}')) QUALIFY row_number() OVER (PARTITION BY school_id ORDER BY name, teacher_id) <= 15),
 class_ AS (SELECT DISTINCT school_id, 'class' AS entity, CASE WHEN section <> '' THEN class_name || '-' || section ELSE class_name END AS ref,
  CASE WHEN section <> '' THEN class_name || '-' || section ELSE class_name END AS label FROM f_period WHERE version = 2 AND {cls}),
 subject_ AS (SELECT school_id, 'subject' AS entity, CAST(teacher_id AS VARCHAR) AS ref, subject AS label FROM subj QUALIFY row_number() OVER (PARTITION BY school_id ORDER BY subject, teacher_id) <= 60),
 club_ AS (SELECT school_id, 'club' AS entity, CAST(club_id AS VARCHAR) AS ref, name AS label FROM f_club WHERE active AND (contains(lower(name), '{term}') OR list_contains(string_split(activities_text, '; '), '{term}'))
  QUALIFY row_number() OVER (PARTITION BY school_id ORDER BY club_id) <= 10),
 notice_ AS (SELECT school_id, 'notice' AS entity, CAST(notice_id AS VARCHAR) AS ref, title AS label FROM f_notice WHERE NOT archived AND (contains(lower(title), '{term}') OR contains(lower('Seen by ' || priority), '{term}'))
  QUALIFY row_number() OVER (PARTITION BY school_id ORDER BY notice_date DESC, notice_id DESC) <= 10),
 doc_ AS (SELECT school_id, 'document' AS entity, CAST(doc_id AS VARCHAR) AS ref, kind || ' ' || source AS label FROM f_doc WHERE {_VIS} AND (contains(lower(kind || ' ' || source), '{term}') OR contains(lower(lang || '-' || doc_id || '.pdf'), '{term}'))
  QUALIFY row_number() OVER (PARTITION BY school_id ORDER BY doc_id) <= 10)
 SELECT * FROM people_ UNION ALL SELECT * FROM class_ UNION ALL SELECT * FROM subject_ UNION ALL SELECT * FROM club_ UNION ALL SELECT * FROM notice_ UNION ALL SELECT * FROM doc_"""


def _search(t, term):
    clubs = t.f_club.withColumn("activities", F.split("activities_text", "; "))
    docs = t.f_doc.withColumn("title", F.concat_ws(" ", "kind", "source")).withColumn("original_name", F.concat("lang", F.lit("-"), "doc_id", F.lit(".pdf")))
    notices = t.f_notice.withColumn("description", F.concat(F.lit("Seen by "), "priority"))
    return R.global_search(term, 2, people(t), t.f_period, clubs, notices, docs)


@query("global_search", _caps("en", "FALSE"))
def global_search(t):
    return _search(t, " en ")


@query("global_search_class", _caps("class 8-b", "class_name = 'VIII' AND section = 'B'"))
def global_search_class(t):
    return _search(t, "class 8-b")
