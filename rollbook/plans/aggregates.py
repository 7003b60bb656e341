"""Registered counts, grids and size reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import aggregates as A
from rollbook.plans.reads import lessons, rows
from rollbook.plans.registry import query

VER = ["school_id", "version"]
DRAFT = ["school_id", "draft_id"]


@query(
    "dashboard_counts",
    """WITH s AS (SELECT DISTINCT c_nationkey AS school_id FROM customer)
 SELECT school_id, (SELECT count(*) FROM f_teacher t WHERE t.school_id = s.school_id AND active) AS teachers,
 (SELECT count(*) FROM f_doc d WHERE d.school_id = s.school_id AND NOT archived) AS documents,
 (SELECT count(*) FROM f_doc d WHERE d.school_id = s.school_id AND NOT archived AND extraction_status IN ('REVIEW', 'PROCESSING', 'QUEUED', 'FAILED')) AS pending,
 (SELECT count(*) FROM f_routine r WHERE r.school_id = s.school_id) AS published FROM s""",
)
def dashboard_counts(t):
    return A.dashboard_counts(t.f_teacher, t.f_doc, t.f_routine)


@query("duty_counts", "SELECT school_id, teacher_id, count(*) AS duties FROM f_duty WHERE duty_type = 'MOD' GROUP BY ALL")
def duty_counts(t):
    return A.duty_counts(t.f_duty, "MOD")


@query("load_by_day", "SELECT school_id, teacher_id, day_idx, count(*) AS lessons FROM f_period WHERE version = 2 AND NOT is_break AND teacher_id IS NOT NULL GROUP BY ALL")
def load_by_day(t):
    return A.load_by_day(lessons(t))


@query("routine_sizes", "SELECT school_id, version, count(*) AS periods, count(DISTINCT class_name || '|' || section) AS classes FROM f_period GROUP BY ALL")
def routine_sizes(t):
    return A.routine_sizes(t.f_period)


@query("subject_counts", "SELECT school_id, subject, count(*) AS periods FROM f_period WHERE NOT is_break AND subject <> '' GROUP BY ALL")
def subject_counts(t):
    return A.subject_counts(t.f_period)


@query(
    "teacher_references",
    """WITH r AS (SELECT school_id, teacher_id, 1 AS hard FROM f_period WHERE teacher_id IS NOT NULL UNION ALL SELECT school_id, teacher_id, 1 FROM f_remedial
  UNION ALL SELECT school_id, teacher_id, 0 FROM f_duty UNION ALL SELECT school_id, teacher_id, 0 FROM f_weekly_off)
 SELECT t.school_id, t.teacher_id, count(r.hard) AS refs, CAST(coalesce(sum(r.hard), 0) AS BIGINT) AS hard_refs FROM f_teacher t LEFT JOIN r USING (school_id, teacher_id) GROUP BY ALL""",
)
def teacher_references(t):
    return A.teacher_references(t.f_teacher, t.f_period, t.f_duty, t.f_weekly_off, t.f_remedial)


_SIZES = [
    ("Uploaded original files", "documents", "octet_length({})", "text"),
    ("Routine periods", "lineitem", "octet_length({})", "l_returnflag"),
    ("Teachers", "customer", "octet_length({})", "c_name"),
    ("Extraction logs", "events", "octet_length({})", "props"),
    ("Web pages", "pages", "octet_length({})", "html"),
    ("Clubs", "part", "octet_length({})", "p_name"),
]


def _duck_bytes(c: str) -> str:
    return f"octet_length(encode({c}))"


@query(
    "storage_report",
    "SELECT *, round(bytes * 100 / 536870912, 2) AS percent FROM ("
    + " UNION ALL ".join(f"SELECT '{label}' AS label, count(*) AS rows, CAST(coalesce(sum({_duck_bytes(c)}), 0) AS BIGINT) AS bytes FROM {tab}" for label, tab, _, c in _SIZES)
    + ") WHERE bytes > 0",
)
def storage_report(t):
    return A.table_sizes({label: (t.base(tab), F.octet_length(c)) for label, tab, _, c in _SIZES})


@query("file_totals", "SELECT school_id, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM f_doc GROUP BY ALL")
def file_totals(t):
    return A.file_totals(t.f_doc)


NAMED = ["f_draft_period", "f_draft_duty", "f_draft_off", "f_draft_remedial"]
_NAMES = " UNION ALL ".join(f"SELECT school_id, draft_id, teacher_name FROM {v}" + (" WHERE NOT is_break" if v == "f_draft_period" else "") for v in NAMED)


def named_facts(t):
    return [t.f_draft_period.filter("not is_break"), t.f_draft_duty, t.f_draft_off, t.f_draft_remedial]


@query(
    "name_usage",
    f"SELECT school_id, draft_id, trim(teacher_name) AS name, count(*) AS uses, count(*) >= 3 AS frequent FROM ({_NAMES}) WHERE trim(teacher_name) <> '' GROUP BY ALL",
)
def name_usage(t):
    return A.name_usage(named_facts(t), DRAFT)


_KINDS = {"period": "f_draft_period", "mod": "f_draft_duty", "weeklyOff": "f_draft_off", "remedial": "f_draft_remedial", "club": "f_draft_club"}


@query(
    "low_confidence_count",
    "SELECT school_id, draft_id, count(*) FILTER (confidence < 0.75) AS doubtful FROM ("
    + " UNION ALL ".join(f"SELECT school_id, draft_id, CAST(confidence AS DOUBLE) AS confidence FROM {v}" for v in _KINDS.values())
    + ") GROUP BY ALL",
)
def low_confidence_count(t):
    return A.low_confidence_count({k: getattr(t, v) for k, v in _KINDS.items()}, by=DRAFT)


@query(
    "slot_header",
    """SELECT school_id, version, class_name, section, slot, arg_min_null(period_number, seq) AS period_number, arg_min(is_break, seq) AS is_break, arg_min_null(label, seq) AS label,
 arg_min(start_min, seq) AS start_min, arg_min(end_min, seq) AS end_min FROM f_period GROUP BY ALL""",
)
def slot_header(t):
    return A.slot_header(t.f_period, VER)


_CELL = "CASE WHEN is_break THEN coalesce(label, 'BREAK') WHEN subject = '' THEN teacher_name ELSE subject || ' / ' || teacher_name END"


@query(
    "timetable_grid",
    f"""SELECT p.school_id, class_name, section, day_idx, {', '.join(f"arg_max({_CELL}, seq) FILTER (slot = {s}) AS slot_{s}" for s in range(7))}, count(*) FILTER (slot NOT BETWEEN 0 AND 6) AS outside
 FROM (SELECT p.*, coalesce(t.name, printed_teacher) AS teacher_name FROM f_period p LEFT JOIN f_teacher t ON p.school_id = t.school_id AND p.teacher_id = t.teacher_id WHERE version = 2) p GROUP BY ALL""",
)
def timetable_grid(t):
    return A.timetable_grid(rows(t).filter("version = 2"), range(7))


@query(
    "who_teaches_what",
    """SELECT school_id, class_name, teacher_id, section, subject, count(*) AS lessons FROM f_period WHERE version = 2 AND NOT is_break AND teacher_id IS NOT NULL AND subject <> '' GROUP BY ALL
 UNION ALL SELECT school_id, class_name, teacher_id, '*', subject, count(*) FROM f_period WHERE version = 2 AND NOT is_break AND teacher_id IS NOT NULL AND subject <> '' GROUP BY ALL""",
)
def who_teaches_what(t):
    return A.who_teaches_what(lessons(t))


_STATS = """stats AS (SELECT t.school_id, t.teacher_id, t.name, count(*) OVER (PARTITION BY t.school_id, t.name) > 1 AS shared_name, o.off_day,
 coalesce(d.m, 0) AS mod, coalesce(d.h, 0) AS holiday, coalesce(r.n, 0) AS remedial, coalesce(d.c, 0) AS comp_offs FROM f_teacher t
 LEFT JOIN (SELECT school_id, teacher_id, count(*) FILTER (duty_type = 'MOD') AS m, count(*) FILTER (duty_type = 'HOLIDAY') AS h, count(off_date) AS c FROM f_duty GROUP BY ALL) d USING (school_id, teacher_id)
 LEFT JOIN (SELECT school_id, teacher_id, max(day_idx) AS off_day FROM f_weekly_off GROUP BY ALL) o USING (school_id, teacher_id)
 LEFT JOIN (SELECT school_id, teacher_id, count(*) AS n FROM f_remedial WHERE active GROUP BY ALL) r USING (school_id, teacher_id) WHERE t.active)"""


def _stats(t):
    return A.roster_stats(t.f_teacher.filter("active"), t.f_duty, t.f_weekly_off, t.f_remedial.filter("active"))


@query("roster_stats", f"WITH {_STATS} SELECT * FROM stats")
def roster_stats(t):
    return _stats(t)


@query("roster_spread", f"WITH {_STATS} SELECT school_id, max(mod + holiday) - min(mod + holiday) AS spread, count(*) FILTER (shared_name) AS shared_names FROM stats GROUP BY ALL")
def roster_spread(t):
    return A.roster_spread(_stats(t))


@query("draft_text_bytes", f"SELECT school_id, count(*) AS drafts, CAST(sum({_duck_bytes('text')}) AS BIGINT) AS bytes FROM f_doc WHERE extraction_status IN ('PUBLISHED', 'CANCELLED', 'FAILED') GROUP BY ALL")
def draft_text_bytes(t):
    return A.draft_text_bytes(t.f_doc)
