"""Registered draft checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import identity as I
from rollbook.operators import quality as Q
from rollbook.plans import sqltext as S
from rollbook.plans.aggregates import _KINDS, named_facts
from rollbook.plans.people import resolved_cte
from rollbook.plans.reads import people
from rollbook.plans.registry import query
from rollbook.plans.text import _class
from rollbook.session import written

DRAFT = ["school_id", "draft_id"]
SCHOOL = ["school_id"]
_NEW = "Mr. Newcomer Sen"
_CLOCK = "^([01][0-9]|2[0-3]):[0-5][0-9]$"


def _min(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{_CLOCK}') THEN CAST(substr({c}, 1, 2) AS INT) * 60 + CAST(substr({c}, 4, 2) AS INT) END"


_ALL_NAMES = " UNION ".join(
    f"SELECT school_id, teacher_name AS raw FROM {v}" + (" WHERE NOT is_break" if v == "f_draft_period" else "")
    for v in ("f_draft_period", "f_draft_duty", "f_draft_off", "f_draft_remedial")
)
_RES = f"{resolved_cte(_ALL_NAMES)}, res AS (SELECT school_id, raw, teacher_id, raw = '{_NEW}' AS is_new FROM resolved)"


def _who(alias: str) -> str:
    return f"coalesce(CAST({alias}.tid AS VARCHAR), 'name:' || {S.key(alias + '.teacher_name')})"


def _with(view: str, name: str, extra: str = "") -> str:
    return f"{name} AS (SELECT v.*, trim(v.teacher_name) AS nm, r.teacher_id AS tid, coalesce(r.is_new, false) AS is_new{extra} FROM {view} v LEFT JOIN res r ON r.school_id = v.school_id AND r.raw = trim(v.teacher_name))"


_PREP = _with("f_draft_period", "pp", f", {_class('v.class_name')} AS cn, {_min('v.start_time')} AS s, {_min('v.end_time')} AS e")


def _resolved(t, facts=None):
    """Who the printed names of `facts` are (of all facts, if not given): a name's person does not depend on other names."""
    names = I.distinct_names([f.select("school_id", "teacher_name") for f in (named_facts(t) if facts is None else facts)], SCHOOL)
    mapping = t.sql(f"SELECT DISTINCT school_id, '{_NEW}' AS raw, 'NEW' AS target FROM f_teacher")
    return Q.resolve_once(names, people(t), mapping)


def _lessons(t):
    return [t.f_draft_period.filter("not is_break")]


def _prepared(t, res=None):
    return Q.prepare_periods(t.f_draft_period, _resolved(t, _lessons(t)) if res is None else res, SCHOOL)


def _cases(checks: list[tuple[str, str, str]], src: str, scope: str) -> str:
    return " UNION ALL ".join(f"SELECT school_id, draft_id, '{scope}' AS scope, seq, '{sev}' AS severity, '{code}' AS code FROM {src} WHERE {cond}" for sev, code, cond in checks)


_UNKNOWN = "nm <> '' AND tid IS NULL AND NOT is_new"
_BAD_TIME = f"((start_time IS NOT NULL AND start_time <> '' AND NOT regexp_matches(start_time, '{_CLOCK}')) OR (end_time IS NOT NULL AND end_time <> '' AND NOT regexp_matches(end_time, '{_CLOCK}')))"
_NO_CLASS = "(cn IS NULL OR cn NOT IN ('VI','VII','VIII','IX','X','XI','XII'))"
_PERIOD = _cases(
    [
        ("error", "class", _NO_CLASS),
        ("error", "section", "section <> '' AND upper(section) NOT IN ('A','B','C','D','E','F')"),
        ("error", "periodNumber", "NOT is_break AND (period_number IS NULL OR period_number NOT BETWEEN 1 AND 12)"),
        ("warning", "subject", "NOT is_break AND trim(subject) = ''"),
        ("warning", "teacher", "NOT is_break AND nm = ''"),
        ("error", "teacherUnknown", f"NOT is_break AND {_UNKNOWN}"),
        ("warning", "teacherIncomplete", r"NOT is_break AND nm <> '' AND (tid IS NOT NULL OR is_new) AND regexp_matches(nm, '[-/]\s*$')"),
        ("error", "time", _BAD_TIME),
        ("error", "timeOrder", "e <= s"),
        ("warning", "timeRange", "e > s AND (s < 300 OR e > 1260)"),
        ("warning", "timeMissing", "NOT is_break AND (s IS NULL OR e IS NULL)"),
    ],
    "pp",
    "period",
)
_DUP = """SELECT school_id, draft_id, 'period' AS scope, seq, 'error' AS severity, 'duplicate' AS code FROM pp
 QUALIFY row_number() OVER (PARTITION BY school_id, draft_id, coalesce(cn, class_name), section, day_idx, slot ORDER BY seq) > 1"""
_GAP = """SELECT school_id, draft_id, 'period' AS scope, seq, 'warning' AS severity, CASE WHEN gap < 0 THEN 'overlap' ELSE 'timeGap' END AS code FROM
 (SELECT school_id, draft_id, seq, s - lag(e) OVER (PARTITION BY school_id, draft_id, coalesce(cn, class_name), section, day_idx ORDER BY s, seq) AS gap FROM pp WHERE s IS NOT NULL AND e IS NOT NULL)
 WHERE gap < 0 OR gap BETWEEN 1 AND 5"""
_CLASH = """SELECT DISTINCT b.school_id, b.draft_id, 'period' AS scope, b.seq, 'warning' AS severity, 'teacherClash' AS code FROM pp a JOIN pp b USING (school_id, draft_id, tid, day_idx)
 WHERE NOT a.is_break AND NOT b.is_break AND a.seq < b.seq AND (a.class_name <> b.class_name OR a.section <> b.section)
 AND CASE WHEN a.s IS NOT NULL AND a.e IS NOT NULL AND b.s IS NOT NULL AND b.e IS NOT NULL THEN a.s < b.e AND b.s < a.e ELSE coalesce(a.period_number = b.period_number, false) END"""
_LOW = " UNION ALL ".join(f"SELECT school_id, draft_id, '{k}' AS scope, CAST(seq AS BIGINT) AS seq, 'warning' AS severity, 'lowConfidence' AS code FROM {v} WHERE confidence < 0.75" for k, v in _KINDS.items())


@query("period_rules", f"WITH {_RES}, {_PREP} {_PERIOD}")
def period_rules(t):
    return Q.period_rules(_prepared(t))


@query("duplicate_periods", f"WITH {_RES}, {_PREP} {_DUP}")
def duplicate_periods(t):
    return Q.duplicate_periods(Q.prepare_periods(t.f_draft_period))


@query("gap_issues", f"WITH {_RES}, {_PREP} {_GAP}")
def gap_issues(t):
    return Q.gap_issues(Q.prepare_periods(t.f_draft_period))


@query("clash_issues", f"WITH {_RES}, {_PREP} {_CLASH}")
def clash_issues(t):
    return Q.clash_issues(_prepared(t))


def _kinds(t):
    return {k: getattr(t, v) for k, v in _KINDS.items()}


@query("low_confidence_issues", _LOW)
def low_confidence_issues(t):
    return Q.low_confidence_issues(_kinds(t))


_REP = """SELECT school_id, draft_id, 'mod' AS scope, seq, 'error' AS severity, 'duplicate' AS code FROM f_draft_duty QUALIFY row_number() OVER (PARTITION BY school_id, draft_id, duty_type, duty_date, lower(trim(teacher_name)) ORDER BY seq) > 1
 UNION ALL SELECT * FROM (SELECT school_id, draft_id, 'weeklyOff', CAST(seq AS BIGINT), 'error', 'duplicate' FROM f_draft_off QUALIFY row_number() OVER (PARTITION BY school_id, draft_id, day_idx, lower(trim(teacher_name)) ORDER BY seq) > 1)
 UNION ALL SELECT * FROM (SELECT school_id, draft_id, 'club', seq, 'error', 'duplicate' FROM f_draft_club QUALIFY row_number() OVER (PARTITION BY school_id, draft_id, lower(trim(name)) ORDER BY seq) > 1)"""


@query("repeated_entries", f"SELECT * FROM ({_REP})")
def repeated_entries(t):
    return Q.repeated_entries(t.f_draft_duty, t.f_draft_off, t.f_draft_club)


_OTHERS = f"{_with('f_draft_duty', 'dd')}, {_with('f_draft_off', 'oo')}, " + _with("f_draft_remedial", "rr", f", {_class('v.class_name')} AS cn, {_min('v.start_time')} AS s, {_min('v.end_time')} AS e")
_MISSING = [("error", "teacher", "nm = ''"), ("error", "teacherUnknown", _UNKNOWN)]
_OTHER = (
    _cases(_MISSING, "dd", "mod")
    + " UNION ALL "
    + _cases(_MISSING, "oo", "weeklyOff")
    + " UNION ALL "
    + _cases(
        [("error", "class", _NO_CLASS), ("warning", "activity", "trim(activity) = ''"), ("error", "time", _BAD_TIME), ("error", "timeOrder", "e <= s"), ("error", "teacherUnknown", _UNKNOWN)],
        "rr",
        "remedial",
    )
)


def _others(t, res=None):
    facts = [t.f_draft_duty, t.f_draft_off, t.f_draft_remedial]
    res = _resolved(t, facts) if res is None else res
    return [Q.with_person(df, res, SCHOOL) for df in facts]


@query("other_rules", f"WITH {_RES}, {_OTHERS} {_OTHER}")
def other_rules(t):
    return Q.other_rules(*_others(t))


_DRAFTS = "SELECT school_id, CAST(v AS INT) AS draft_id, 'ROUTINE' AS kind FROM (SELECT DISTINCT school_id FROM f_teacher) s CROSS JOIN (VALUES (1), (2), (3), (4)) AS x(v)"
_DRAFT_ISSUES = f"""SELECT d.school_id, d.draft_id, 'general' AS scope, CAST(NULL AS BIGINT) AS seq, CASE WHEN n IS NULL THEN 'error' ELSE 'warning' END AS severity, CASE WHEN n IS NULL THEN 'empty' ELSE 'noPeriods' END AS code
 FROM ({_DRAFTS}) d LEFT JOIN (SELECT school_id, draft_id, count(*) AS n, count(*) FILTER (k = 'period') AS p FROM ({" UNION ALL ".join(f"SELECT school_id, draft_id, '{k}' AS k FROM {v}" for k, v in _KINDS.items())}) GROUP BY ALL) c
 USING (school_id, draft_id) WHERE n IS NULL OR p = 0"""


@query("draft_issues", _DRAFT_ISSUES)
def draft_issues(t):
    return Q.draft_issues(t.sql(_DRAFTS), _kinds(t))


_NAME_ISSUES = f"""{S.classified('nk', 'res', 'raw')} SELECT r.school_id, r.raw AS name, 'warning' AS severity, 'teacherHint' AS code FROM res r WHERE teacher_id IS NULL AND NOT is_new
 UNION ALL SELECT r.school_id, r.raw, 'error', 'teacherNotName' FROM res r JOIN nk ON nk.raw = r.raw WHERE teacher_id IS NULL AND NOT is_new AND nk.kind = 'garbage'"""


@query("name_issues", f"WITH {_RES}, {_NAME_ISSUES}")
def name_issues(t):
    return Q.name_issues(_resolved(t), SCHOOL)


_ROSTER = f"""dw AS (SELECT *, {_who('dd')} AS who FROM dd), ow AS (SELECT school_id, draft_id, {_who('oo')} AS who, arg_max(day_idx, seq) AS day_idx FROM oo GROUP BY ALL),
 sq AS (SELECT *, lag(duty_date) OVER (PARTITION BY school_id, draft_id, who ORDER BY duty_date, seq) AS prev FROM dw),
 rq AS (SELECT s.*, o.day_idx AS off_idx, EXISTS (SELECT 1 FROM dw c WHERE c.school_id = s.school_id AND c.draft_id = s.draft_id AND c.who = s.who AND c.off_date = s.duty_date) AS comp FROM sq s
   LEFT JOIN ow o ON o.school_id = s.school_id AND o.draft_id = s.draft_id AND o.who = s.who),
 roster_ AS ({_cases([("warning", "dutyClash", "prev = duty_date"), ("warning", "dutyBackToBack", "duty_date - prev = 1"), ("warning", "dutyOnOff", "prev IS DISTINCT FROM duty_date AND duty_type = 'MOD' AND off_idx = isodow(duty_date) - 1"), ("warning", "dutyOnCompOff", "prev IS DISTINCT FROM duty_date AND comp")], "rq", "mod")}
  UNION ALL SELECT school_id, draft_id, 'mod', min(seq), 'warning', 'manyMod' FROM dd WHERE duty_type = 'MOD' GROUP BY school_id, draft_id, duty_date HAVING count(*) > 1)"""


@query("roster_issues", f"WITH {_RES}, {_OTHERS}, {_ROSTER} SELECT * FROM roster_")
def roster_issues(t):
    duties, offs, _ = _others(t)
    return Q.roster_issues(duties, offs)


_REMEDIAL = f"""rw AS (SELECT *, {_who('rr')} AS who FROM rr WHERE nm <> '' AND day_idx IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL),
 ow2 AS (SELECT school_id, draft_id, {_who('oo')} AS who, arg_max(day_idx, seq) AS day_idx FROM oo GROUP BY ALL),
 rem_ AS (SELECT r.school_id, r.draft_id, 'remedial' AS scope, r.seq, 'warning' AS severity, 'remedialOnOff' AS code FROM rw r JOIN ow2 o USING (school_id, draft_id, who, day_idx)
  UNION ALL SELECT school_id, draft_id, 'remedial', seq, 'warning', 'remedialClash' FROM rw r WHERE EXISTS (SELECT 1 FROM f_period p WHERE p.version = 2 AND NOT p.is_break AND p.school_id = r.school_id AND p.teacher_id = r.tid AND p.day_idx = r.day_idx AND r.s < p.end_min AND p.start_min < r.e)
  UNION ALL SELECT DISTINCT b.school_id, b.draft_id, 'remedial', b.seq, 'warning', 'remedialDouble' FROM rw a JOIN rw b USING (school_id, draft_id, who, day_idx) WHERE a.seq < b.seq AND a.s < b.e AND b.s < a.e)"""


@query("remedial_issues", f"WITH {_RES}, {_OTHERS}, {_REMEDIAL} SELECT * FROM rem_")
def remedial_issues(t):
    _, offs, remedial = _others(t)
    return Q.remedial_issues(remedial, offs, t.f_period.filter("version = 2"))


@query("roster_audit", f"WITH {_RES}, {_OTHERS}, {_ROSTER}, {_REMEDIAL} SELECT * FROM roster_ UNION ALL SELECT * FROM rem_")
def roster_audit(t):
    facts = [t.f_draft_duty, t.f_draft_off, t.f_draft_remedial]
    return Q.roster_audit(*facts, t.f_period.filter("version = 2"), _resolved(t, facts))


_EVERY = f"""every_ AS ({_PERIOD} UNION ALL {_DUP.replace('SELECT school_id', 'SELECT * FROM (SELECT school_id', 1)}) UNION ALL {_GAP} UNION ALL {_CLASH} UNION ALL {_LOW} UNION ALL SELECT * FROM ({_REP}) UNION ALL {_OTHER}
 UNION ALL {_DRAFT_ISSUES} UNION ALL SELECT * FROM roster_ UNION ALL SELECT * FROM rem_)"""
_U5 = f"WITH {_RES}, {_PREP}, {_OTHERS}, {_ROSTER}, {_REMEDIAL}, {_EVERY}"


def _every(t, rows=None):
    """All issues. The rows of each kind are derived and joined with their names once, and each rule is written by itself, so that
    its shuffle files go before those of the next rule come."""
    prepared, duties, offs, remedial = _rows(t) if rows is None else rows
    kinds = _kinds(t) | {"period": prepared, "mod": duties, "weeklyOff": offs, "remedial": remedial}
    rules = [
        lambda: Q.period_rules(prepared), lambda: Q.duplicate_periods(prepared), lambda: Q.gap_issues(prepared), lambda: Q.clash_issues(prepared), lambda: Q.low_confidence_issues(kinds),
        lambda: Q.repeated_entries(duties, offs, kinds["club"]), lambda: Q.other_rules(duties, offs, remedial), lambda: Q.draft_issues(t.sql(_DRAFTS), kinds),
        lambda: Q.roster_issues(duties, offs), lambda: Q.remedial_issues(remedial, offs, t.f_period.filter("version = 2")),
    ]
    return Q.all_issues([written(rule()) for rule in rules])


def _rows(t):
    """Periods, duties, weekly offs and remedial classes of the drafts with their persons, each written once."""
    res = _resolved(t)
    return [written(x) for x in (_prepared(t, res), *_others(t, res))]


@query("all_issues", f"{_U5} SELECT * FROM every_")
def all_issues(t):
    return _every(t)


@query(
    "issue_summary",
    f"""{_U5} SELECT d.school_id, d.draft_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS publishable
 FROM ({_DRAFTS}) d LEFT JOIN every_ USING (school_id, draft_id) GROUP BY ALL""",
)
def issue_summary(t):
    return Q.issue_summary(_every(t), t.sql(_DRAFTS))


_TWO_BAD = f"start_time <> '' AND NOT regexp_matches(start_time, '{_CLOCK}') AND end_time <> '' AND NOT regexp_matches(end_time, '{_CLOCK}')"
_MORE = f"""more_ AS (SELECT school_id, draft_id, severity, sum(n) AS n FROM (
  SELECT school_id, draft_id, 'error' AS severity, 1 AS n FROM f_draft_period WHERE {_TWO_BAD} UNION ALL SELECT school_id, draft_id, 'error', 1 FROM f_draft_remedial WHERE {_TWO_BAD}
  UNION ALL SELECT school_id, draft_id, 'warning', count(*) - 1 FROM ({_CLASH.replace('SELECT DISTINCT', 'SELECT')}) GROUP BY school_id, draft_id, seq
  UNION ALL SELECT school_id, draft_id, 'warning', count(*) - 1 FROM (SELECT b.school_id, b.draft_id, b.seq FROM rw a JOIN rw b USING (school_id, draft_id, who, day_idx) WHERE a.seq < b.seq AND a.s < b.e AND b.s < a.e) GROUP BY school_id, draft_id, seq) GROUP BY ALL)"""


@query(
    "issue_totals",
    f"""{_U5}, {_MORE}, a AS (SELECT school_id, draft_id, severity, 1 AS n FROM every_ UNION ALL SELECT school_id, draft_id, severity, n FROM more_)
 SELECT d.school_id, d.draft_id, CAST(coalesce(sum(n) FILTER (severity = 'error'), 0) AS BIGINT) AS errors, CAST(coalesce(sum(n) FILTER (severity = 'warning'), 0) AS BIGINT) AS warnings, coalesce(sum(n) FILTER (severity = 'error'), 0) = 0 AS publishable
 FROM ({_DRAFTS}) d LEFT JOIN a USING (school_id, draft_id) GROUP BY ALL""",
)
def issue_totals(t):
    rows = _rows(t)
    return Q.issue_totals(_every(t, rows), written(Q.repeated_findings(rows[0], rows[3])), t.sql(_DRAFTS))


@query(
    "issues_by_class",
    f"""WITH {_RES}, {_PREP}, e AS ({_PERIOD}) SELECT p.school_id, p.draft_id, p.class_name, p.section, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings
 FROM e JOIN pp p USING (school_id, draft_id, seq) GROUP BY ALL""",
)
def issues_by_class(t):
    return Q.issues_by_class(Q.period_rules(_prepared(t), keep=["class_name", "section"]))


@query(
    "issues_by_item",
    f"WITH {_RES}, {_PREP}, e AS ({_PERIOD}) SELECT school_id, draft_id, scope, seq, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, count(*) AS issues FROM e GROUP BY ALL",
)
def issues_by_item(t):
    return Q.issues_by_item(Q.period_rules(_prepared(t)))


_PEOPLE_IN = "SELECT teacher_id, CASE WHEN teacher_id % 17 = 0 THEN ' X ' WHEN teacher_id % 19 = 0 THEN repeat(name, 12) ELSE name END AS name, CASE WHEN teacher_id % 23 = 0 THEN repeat(code, 9) ELSE code END AS code, designation, split(alias_list, ';') AS aliases FROM f_teacher"


@query(
    "reject_people",
    f"""SELECT teacher_id, 'name' AS problem FROM ({_PEOPLE_IN}) WHERE length(trim(name)) NOT BETWEEN 2 AND 120 UNION ALL SELECT teacher_id, 'code' FROM ({_PEOPLE_IN}) WHERE length(trim(code)) > 40""",
)
def reject_people(t):
    return Q.reject_people(t.sql(_PEOPLE_IN), ["teacher_id"])


_NOTICE_IN = "SELECT notice_id, CASE WHEN notice_id % 13 = 0 THEN 'A' ELSE title END AS title, CASE WHEN notice_id % 17 = 0 THEN '' ELSE title END AS description, CASE WHEN notice_id % 19 = 0 THEN '2024-02-31' WHEN notice_id % 23 = 0 THEN 'today' ELSE CAST(notice_date AS STRING) END AS notice_date, CASE WHEN notice_id % 29 = 0 THEN 'SOON' ELSE priority END AS priority FROM f_notice"


@query(
    "reject_notices",
    f"""WITH n AS ({_NOTICE_IN}) SELECT notice_id, 'title' AS problem FROM n WHERE length(title) < 2 UNION ALL SELECT notice_id, 'description' FROM n WHERE description = ''
 UNION ALL SELECT notice_id, 'date' FROM n WHERE TRY_CAST(notice_date AS DATE) IS NULL UNION ALL SELECT notice_id, 'priority' FROM n WHERE priority = 'SOON'""",
)
def reject_notices(t):
    return Q.reject_notices(t.sql(_NOTICE_IN), ["notice_id"])


@query(
    "reject_periods",
    f"""WITH p AS (SELECT *, {_min('start_time')} AS s, {_min('end_time')} AS e FROM f_draft_period) SELECT seq, 'start_time' AS problem FROM p WHERE start_time IS NOT NULL AND s IS NULL
 UNION ALL SELECT seq, 'end_time' FROM p WHERE end_time IS NOT NULL AND e IS NULL UNION ALL SELECT seq, 'order' FROM p WHERE e <= s""",
)
def reject_periods(t):
    return Q.reject_periods(t.f_draft_period, ["seq"])


@query("reject_remedial", "SELECT seq, 'activity' AS problem FROM f_draft_remedial WHERE activity = ''")
def reject_remedial(t):
    return Q.reject_remedial(t.f_draft_remedial, ["seq"])


_CLUB_IN = """SELECT club_id, CASE WHEN club_id % 11 = 0 THEN ' A ' WHEN club_id % 13 = 0 THEN repeat(name, 20) ELSE name END AS name,
 CASE WHEN club_id % 7 = 0 THEN repeat(activities_text, 8) ELSE activities_text END AS member, CASE WHEN club_id % 17 = 0 THEN 61 ELSE 2 END AS n FROM f_club"""


@query(
    "reject_clubs",
    f"""WITH c AS ({_CLUB_IN}) SELECT club_id, 'name' AS problem FROM c WHERE length(trim(name)) NOT BETWEEN 2 AND 120 UNION ALL SELECT club_id, 'members' FROM c WHERE length(trim(member)) > 160 OR n > 60
 UNION ALL SELECT club_id, 'activities' FROM c WHERE length(trim(member)) > 300 OR n > 60""",
)
def reject_clubs(t):
    lists = F.array_repeat(F.col("member"), F.col("n"))
    return Q.reject_clubs(t.sql(_CLUB_IN).withColumn("members", lists).withColumn("activities", lists), ["club_id"])


_REQUEST_IN = """SELECT duty_id, CASE WHEN duty_id % 11 = 0 THEN '2026-02-30' WHEN duty_id % 13 = 0 THEN 'soon' ELSE CAST(duty_date AS STRING) END AS day, CASE WHEN duty_id % 17 = 0 THEN 63 WHEN duty_id % 19 = 0 THEN 0 ELSE 3 END AS n,
 CASE WHEN duty_id % 23 = 0 THEN '' ELSE CAST(teacher_id AS STRING) END AS who, CASE WHEN duty_id % 29 = 0 THEN 31 ELSE 1 END AS k, CASE WHEN duty_id % 31 = 0 THEN repeat('x', 301) END AS description, CASE WHEN duty_id % 37 = 0 THEN 'REST' ELSE duty_type END AS duty_type FROM f_duty"""


@query(
    "reject_duty_requests",
    f"""WITH r AS ({_REQUEST_IN}) SELECT duty_id, 'dates' AS problem FROM r WHERE n NOT BETWEEN 1 AND 62 OR TRY_CAST(day AS DATE) IS NULL UNION ALL SELECT duty_id, 'teachers' FROM r WHERE k > 30 OR who = ''
 UNION ALL SELECT duty_id, 'description' FROM r WHERE length(description) > 300 UNION ALL SELECT duty_id, 'type' FROM r WHERE duty_type = 'REST'""",
)
def reject_duty_requests(t):
    rows = t.sql(_REQUEST_IN).withColumn("dates", F.array_repeat(F.col("day"), F.col("n"))).withColumn("teacher_ids", F.array_repeat(F.col("who"), F.col("k")))
    return Q.reject_duty_requests(rows, ["duty_id"])


_ACCOUNT_IN = "SELECT user_id, CASE WHEN user_id % 5 = 0 THEN ' ' || upper(username) || ' ' WHEN user_id % 7 = 0 THEN 'ab' WHEN user_id % 11 = 0 THEN replace(username, '.', '!') ELSE username END AS username, repeat('p', CAST(user_id % 120 AS INT)) AS password FROM f_user"


@query(
    "reject_accounts",
    f"""WITH a AS (SELECT *, lower(trim(username)) AS u FROM ({_ACCOUNT_IN})) SELECT user_id, 'username' AS problem FROM a WHERE length(u) NOT BETWEEN 3 AND 40 OR NOT regexp_full_match(u, '[a-z0-9._-]+')
 UNION ALL SELECT user_id, 'password' FROM a WHERE length(password) NOT BETWEEN 8 AND 100""",
)
def reject_accounts(t):
    return Q.reject_accounts(t.sql(_ACCOUNT_IN), ["user_id"])


_SETTINGS_IN = """SELECT club_id, CASE WHEN club_id % 3 = 0 THEN name END AS school_name, CASE WHEN club_id % 5 = 0 THEN 'X' ELSE name END AS portal_name, CASE WHEN club_id % 7 = 0 THEN 'office' WHEN club_id % 2 = 0 THEN 'a@b.org' END AS contact_email,
 CASE WHEN club_id % 11 = 0 THEN repeat('1', 31) ELSE '123' END AS contact_phone, CASE WHEN club_id % 13 = 0 THEN 21 WHEN club_id % 17 = 0 THEN 0 ELSE 7 END AS n FROM f_club"""


@query(
    "reject_settings",
    f"""WITH x AS ({_SETTINGS_IN}) SELECT club_id, 'portal_name' AS problem FROM x WHERE portal_name = 'X' UNION ALL SELECT club_id, 'contact_email' FROM x WHERE contact_email = 'office'
 UNION ALL SELECT club_id, 'contact_phone' FROM x WHERE length(contact_phone) > 30 UNION ALL SELECT club_id, 'classes' FROM x WHERE n NOT BETWEEN 1 AND 20""",
)
def reject_settings(t):
    rows = t.sql(_SETTINGS_IN).withColumn("classes", F.array_repeat(F.lit("VI"), F.col("n"))).withColumn("sections", F.array().cast("array<string>"))
    return Q.reject_settings(rows, ["club_id"])


@query(
    "reject_subjects",
    """WITH n AS (SELECT school_id, club_id AS seq, CASE WHEN club_id % 2 = 0 THEN name ELSE upper(name) END AS name FROM f_club) SELECT school_id, seq, name FROM n
 QUALIFY row_number() OVER (PARTITION BY school_id, lower(name) ORDER BY seq) > 1 OR EXISTS (SELECT 1 FROM f_club c WHERE c.school_id = n.school_id AND NOT c.active AND lower(c.name) = lower(n.name))""",
)
def reject_subjects(t):
    new = t.sql("SELECT school_id, club_id AS seq, CASE WHEN club_id % 2 = 0 THEN name ELSE upper(name) END AS name FROM f_club")
    return Q.reject_subjects(new, t.f_club.filter("not active").select("school_id", "name"))


@query("guarded_subjects", "SELECT school_id, club_id, subject FROM (SELECT school_id, club_id, CASE WHEN club_id % 3 = 0 THEN 'Maths' ELSE name END AS subject FROM f_club) s WHERE EXISTS (SELECT 1 FROM f_period p WHERE p.school_id = s.school_id AND p.subject = s.subject)")
def guarded_subjects(t):
    return Q.guarded_subjects(t.sql("SELECT school_id, club_id, CASE WHEN club_id % 3 = 0 THEN 'Maths' ELSE name END AS subject FROM f_club"), t.f_period)


@query(
    "guarded_teachers",
    """SELECT school_id, teacher_id, name FROM f_teacher t WHERE EXISTS (SELECT 1 FROM f_period p WHERE p.school_id = t.school_id AND p.teacher_id = t.teacher_id)
 OR EXISTS (SELECT 1 FROM f_duty d WHERE d.school_id = t.school_id AND d.teacher_id = t.teacher_id)""",
)
def guarded_teachers(t):
    return Q.guarded_teachers(t.f_teacher.select("school_id", "teacher_id", "name"), t.f_period, t.f_duty)


@query("guarded_routines", "SELECT school_id, version FROM f_routine WHERE status = 'ACTIVE'")
def guarded_routines(t):
    return Q.guarded_routines(t.f_routine).select("school_id", "version")
