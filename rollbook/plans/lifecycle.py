"""Registered lifecycle jobs, restores and file checks."""

from __future__ import annotations

import uuid
from datetime import date
from functools import reduce

from pyspark.sql import functions as F

from rollbook.keyed import first_rows
from rollbook.operators import lifecycle as L
from rollbook.plans import sqltext as S
from rollbook.plans.aggregates import _duck_bytes
from rollbook.plans.quality import _RES, _resolved
from rollbook.plans.registry import query
from rollbook.plans.text import _class
from rollbook.sources import backup as B
from rollbook.sources import drafts as D
from rollbook.session import shared_folder
from rollbook.sources import files as FI
from rollbook.sources import tables as TB

AS_OF = date(2025, 1, 1)
_AS = "DATE '2025-01-01'"

# ---------------------------------------------------------------- publish

_GATE = "SELECT DISTINCT school_id, draft_id, (school_id + draft_id) % 3 <> 0 AS publishable FROM f_draft_period"
_VER = f"""g AS (SELECT school_id, draft_id, row_number() OVER (PARTITION BY school_id ORDER BY draft_id) AS n FROM ({_GATE}) WHERE publishable),
 tp AS (SELECT school_id, max(version) AS top FROM f_routine GROUP BY ALL),
 ver AS (SELECT g.school_id, g.draft_id, CAST(coalesce(top, 0) + n AS INTEGER) AS version FROM g LEFT JOIN tp USING (school_id))"""


def _published(t):
    return L.publish_routine(t.f_draft_period, _resolved(t), t.sql(_GATE), t.f_routine, AS_OF)


@query(
    "publish_routine",
    f"""WITH {_RES}, {_VER} SELECT p.school_id, v.version, p.draft_id, p.seq, coalesce({_class('p.class_name')}, p.class_name) AS class_name, p.section, p.day_idx, p.slot, CASE WHEN NOT is_break THEN period_number END AS period_number, is_break,
 start_time, end_time, subject, CASE WHEN NOT is_break AND trim(subject) <> '' THEN {S.key('subject')} END AS subject_key, CASE WHEN NOT is_break THEN r.teacher_id END AS teacher_id, teacher_name, confidence
 FROM f_draft_period p JOIN ver v ON v.school_id = p.school_id AND v.draft_id = p.draft_id LEFT JOIN res r ON r.school_id = p.school_id AND r.raw = trim(p.teacher_name)""",
)
def publish_routine(t):
    return _published(t)["period"]


@query(
    "publish_versions",
    f"""WITH {_VER}, nw AS (SELECT school_id, max(version) AS newest FROM ver GROUP BY ALL)
 SELECT r.school_id, r.version, r.effective_from, CASE WHEN newest IS NOT NULL AND (status = 'ACTIVE' OR (status = 'SCHEDULED' AND effective_from <= {_AS})) THEN 'ARCHIVED' ELSE status END AS status,
 CASE WHEN newest IS NOT NULL AND (status = 'ACTIVE' OR (status = 'SCHEDULED' AND effective_from <= {_AS})) THEN {_AS} ELSE archived_on END AS archived_on, r.published_on FROM f_routine r LEFT JOIN nw USING (school_id)
 UNION ALL SELECT v.school_id, v.version, {_AS}, CASE WHEN v.version = newest THEN 'ACTIVE' ELSE 'ARCHIVED' END, CASE WHEN v.version <> newest THEN {_AS} END, {_AS} FROM ver v JOIN nw USING (school_id)""",
)
def publish_versions(t):
    return _published(t)["routine"]


@query(
    "publish_subjects",
    f"""WITH {_VER}, p AS (SELECT p.school_id, v.version, p.seq, trim(subject) AS s, {S.key('subject')} AS k FROM f_draft_period p JOIN ver v ON v.school_id = p.school_id AND v.draft_id = p.draft_id WHERE NOT is_break AND trim(subject) <> '')
 SELECT school_id, k AS subject_key, arg_min(s, (version, seq)) AS name FROM p GROUP BY ALL""",
)
def publish_subjects(t):
    return _published(t)["subject"]


_KNOWN = "SELECT school_id, min(seq) AS subject_id, CASE WHEN length(subject) % 2 = 0 THEN upper(subject) ELSE lower(subject) END AS name FROM f_period WHERE version = 1 AND subject <> '' AND length(subject) <> 5 GROUP BY school_id, subject"


@query(
    "publish_known_subjects",
    f"""WITH {_VER}, p AS (SELECT p.school_id, v.version, p.seq, trim(subject) AS s, {S.key('subject')} AS k FROM f_draft_period p JOIN ver v ON v.school_id = p.school_id AND v.draft_id = p.draft_id WHERE NOT is_break AND trim(subject) <> ''),
 n AS (SELECT school_id, k AS subject_key, arg_min(s, (version, seq)) AS name FROM p GROUP BY ALL)
 SELECT n.school_id, n.subject_key, n.name, (SELECT min(subject_id) FROM ({_KNOWN}) x WHERE x.school_id = n.school_id AND lower(x.name) = lower(n.name)) AS subject_id FROM n""",
)
def publish_known_subjects(t):
    return L.publish_routine(t.f_draft_period, _resolved(t), t.sql(_GATE), t.f_routine, AS_OF, known=t.sql(_KNOWN))["subject"]


# ---------------------------------------------------------------- upserts

_DUTY = ["duty_id", "school_id", "teacher_id", "duty_date", "duty_type", "off_date"]
_OLD = "SELECT duty_id, school_id, teacher_id, duty_date, duty_type, off_date FROM f_duty QUALIFY row_number() OVER (PARTITION BY school_id, duty_date, teacher_id, duty_type ORDER BY duty_id) = 1"
_INC = "SELECT duty_id + 50000000 AS duty_id, duty_id AS seq, school_id, teacher_id, duty_date, CASE WHEN duty_id % 3 = 0 THEN 'HOLIDAY' ELSE duty_type END AS duty_type, off_date FROM f_duty WHERE duty_date >= DATE '1997-01-01'"


def _old_duties(t):
    return first_rows(t.f_duty, ["school_id", "duty_date", "teacher_id", "duty_type"], F.col("duty_id")).select(*_DUTY)


@query(
    "upsert_duties",
    f"""WITH old AS ({_OLD}), inc AS (SELECT * FROM ({_INC}) QUALIFY row_number() OVER (PARTITION BY school_id, duty_date, teacher_id, duty_type ORDER BY seq DESC) = 1)
 SELECT {', '.join(_DUTY)} FROM old o WHERE NOT EXISTS (SELECT 1 FROM inc i WHERE i.school_id = o.school_id AND i.duty_date = o.duty_date AND i.teacher_id = o.teacher_id AND i.duty_type = o.duty_type)
 UNION ALL SELECT coalesce(o.duty_id, i.duty_id), i.school_id, i.teacher_id, i.duty_date, i.duty_type, i.off_date FROM inc i LEFT JOIN old o ON i.school_id = o.school_id AND i.duty_date = o.duty_date AND i.teacher_id = o.teacher_id AND i.duty_type = o.duty_type""",
)
def upsert_duties(t):
    return L.upsert_duties(_old_duties(t), t.sql(_INC))


@query("assign_duties", "SELECT DISTINCT school_id, duty_id, unnest([duty_date, CAST(duty_date + 7 AS DATE)]) AS duty_date, teacher_id FROM f_duty WHERE duty_type = 'MOD'")
def assign_duties(t):
    d = F.col("duty_date")
    req = t.f_duty.filter("duty_type = 'MOD'").select("school_id", "duty_id", F.array(d, F.date_add(d, 7), d).alias("dates"), F.array("teacher_id", "teacher_id").alias("teacher_ids"))
    return L.assign_duties(req)


@query(
    "replace_range",
    f"""SELECT {', '.join(_DUTY)} FROM f_duty WHERE NOT (duty_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND duty_type IN ('MOD'))
 UNION ALL SELECT {', '.join(_DUTY)} FROM ({_INC}) WHERE duty_date <= DATE '1997-12-31'""",
)
def replace_range(t):
    return L.replace_range(t.f_duty.select(*_DUTY), t.sql(_INC).filter("duty_date <= DATE '1997-12-31'"), date(1997, 1, 1), date(1997, 12, 31), ["MOD"])


_OFFS = "SELECT school_id, teacher_id, CASE WHEN designation = 'Warden' THEN NULL ELSE CAST((teacher_id + 1) % 6 AS INT) END AS day_idx FROM f_teacher WHERE active"


@query(
    "replace_per_teacher",
    f"""WITH n AS ({_OFFS}) SELECT school_id, teacher_id, day_idx FROM f_weekly_off o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.school_id = o.school_id AND n.teacher_id = o.teacher_id)
 UNION ALL SELECT DISTINCT school_id, teacher_id, day_idx FROM n WHERE day_idx IS NOT NULL""",
)
def replace_per_teacher(t):
    return L.replace_per_teacher(t.f_weekly_off, t.sql(_OFFS))


_CLUBS = "SELECT school_id, club_id + 1000000 AS club_id, upper(name) AS name FROM f_club WHERE school_id < 20 AND confidence > 0.5"


@query(
    "replace_active",
    f"""WITH n AS ({_CLUBS}) SELECT school_id, club_id, name, active AND NOT EXISTS (SELECT 1 FROM n WHERE n.school_id = c.school_id) AS active FROM f_club c UNION ALL SELECT school_id, club_id, name, true FROM n""",
)
def replace_active(t):
    return L.replace_active(t.f_club.select("school_id", "club_id", "name", "active"), t.sql(_CLUBS))


# ---------------------------------------------------------------- documents

_USED = f"""used AS (SELECT d.*, l.routine_status IS NOT NULL AS has_routine, l.has_schedule AS has_list, coalesce(l.routine_status = 'ACTIVE', false) AS active_routine,
 CASE WHEN d.extraction_status IN ('QUEUED', 'PROCESSING', 'REVIEW') THEN 'in work' WHEN l.routine_status IN ('ACTIVE', 'SCHEDULED') THEN 'current or upcoming routine'
  WHEN l.has_schedule AND l.schedule_active THEN 'live schedule or club list'
  WHEN NOT d.archived AND EXISTS (SELECT 1 FROM f_notice n WHERE n.doc_id = d.doc_id AND NOT n.archived) THEN 'attached to a notice' END AS block_reason
 FROM f_doc d JOIN f_doc_link l USING (doc_id))"""


def _used(t):
    link = t.f_doc_link
    routines = link.filter("routine_status is not null").select("doc_id", F.col("routine_status").alias("status"))
    lists = link.filter("has_schedule").select("doc_id", F.col("schedule_active").alias("active"))
    return L.documents_in_use(t.f_doc, routines, lists, lists.filter("false"), t.f_notice)


_CLUB_LISTS = "SELECT CAST(club_id AS BIGINT) AS doc_id, active FROM f_club WHERE club_id % 4 = 1"


@query(
    "documents_in_use_by_clubs",
    f"""WITH c AS ({_CLUB_LISTS}), x AS (SELECT d.doc_id, l.has_schedule AND l.schedule_active AS live_schedule, l.has_schedule, l.routine_status, d.extraction_status, d.archived, EXISTS (SELECT 1 FROM c WHERE c.doc_id = d.doc_id) AS listed,
  EXISTS (SELECT 1 FROM c WHERE c.doc_id = d.doc_id AND c.active) AS live_club, EXISTS (SELECT 1 FROM f_notice n WHERE n.doc_id = d.doc_id AND NOT n.archived) AS noticed FROM f_doc d JOIN f_doc_link l USING (doc_id))
 SELECT doc_id, has_schedule OR listed AS has_list, CASE WHEN extraction_status IN ('QUEUED', 'PROCESSING', 'REVIEW') THEN 'in work' WHEN routine_status IN ('ACTIVE', 'SCHEDULED') THEN 'current or upcoming routine'
  WHEN live_schedule OR live_club THEN 'live schedule or club list' WHEN NOT archived AND noticed THEN 'attached to a notice' END AS block_reason FROM x""",
)
def documents_in_use_by_clubs(t):
    link = t.f_doc_link
    routines = link.filter("routine_status is not null").select("doc_id", F.col("routine_status").alias("status"))
    lists = link.filter("has_schedule").select("doc_id", F.col("schedule_active").alias("active"))
    return L.documents_in_use(t.f_doc, routines, lists, t.sql(_CLUB_LISTS), t.f_notice).select("doc_id", "has_list", "block_reason")


@query("documents_in_use", f"WITH {_USED} SELECT doc_id, has_routine, has_list, active_routine, block_reason FROM used")
def documents_in_use(t):
    return _used(t).select("doc_id", "has_routine", "has_list", "active_routine", "block_reason")


@query(
    "plan_documents",
    f"""WITH {_USED}, p AS (SELECT *, CASE WHEN archived THEN 'ARCHIVED' WHEN extraction_status = 'CANCELLED' OR (extraction_status = 'FAILED' AND updated_on < {_AS} - 1) THEN 'JUNK'
  WHEN created_on < {_AS} - INTERVAL 12 MONTH AND kind = 'ROUTINE' AND has_routine THEN 'SUPERSEDED' WHEN created_on < {_AS} - INTERVAL 12 MONTH AND kind IN ('REMEDIAL', 'CLUB') AND has_list THEN 'SUPERSEDED'
  WHEN created_on < {_AS} - INTERVAL 12 MONTH THEN 'OLD' END AS reason FROM used WHERE block_reason IS NULL)
 SELECT doc_id, kind, size_bytes, reason, reason <> 'OLD' AS preselect FROM p WHERE reason IS NOT NULL""",
)
def plan_documents(t):
    return L.plan_documents(_used(t), AS_OF, 12).select("doc_id", "kind", "size_bytes", "reason", "preselect")


_HELD = "SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'REMEDIAL' ELSE 'ROUTINE' END AS draft_kind, n_chars % 3 AS periods, n_chars % 5 AS duties, n_chars % 4 AS remedial, n_chars % 2 AS clubs FROM documents"


@query(
    "document_kind_fix",
    f"""SELECT doc_id, CASE WHEN kind IN ('ROUTINE', 'REMEDIAL', 'CLUB') AND periods = 0 AND remedial = 0 AND clubs = 0 AND duties > 0 THEN 'OTHER'
 WHEN draft_kind = 'REMEDIAL' AND kind = 'ROUTINE' AND remedial > 0 THEN 'REMEDIAL' ELSE kind END AS kind FROM f_doc JOIN ({_HELD}) USING (doc_id)""",
)
def document_kind_fix(t):
    return L.document_kind_fix(t.f_doc.select("doc_id", "kind"), t.sql(_HELD))


_ACTS = "SELECT doc_id, CASE n_chars % 4 WHEN 0 THEN 'cancel' WHEN 1 THEN 'retry' WHEN 2 THEN 'save' ELSE 'open' END AS action FROM documents"


@query(
    "transition_documents",
    f"""WITH x AS (SELECT doc_id, action, kind, extraction_status AS s, CASE WHEN action = 'retry' AND kind NOT IN ('ROUTINE', 'REMEDIAL', 'CLUB') THEN 'not extracted' WHEN action IN ('cancel', 'retry') AND extraction_status = 'PUBLISHED' THEN 'already published'
  WHEN action = 'retry' AND extraction_status = 'PROCESSING' THEN 'already running' WHEN action = 'save' AND extraction_status NOT IN ('REVIEW', 'FAILED') THEN 'no longer editable' WHEN action = 'open' THEN 'unknown action' END AS problem
  FROM ({_ACTS}) JOIN f_doc USING (doc_id))
 SELECT doc_id, action, CASE WHEN problem IS NOT NULL THEN s WHEN action = 'cancel' THEN 'CANCELLED' WHEN action = 'retry' THEN 'QUEUED' ELSE 'REVIEW' END AS extraction_status, problem FROM x""",
)
def transition_documents(t):
    return L.transition_documents(t.f_doc, t.sql(_ACTS))


_ARCH = "SELECT doc_id, CASE n_chars % 3 WHEN 0 THEN 'archive' WHEN 1 THEN 'restore' ELSE 'delete' END AS action FROM documents"


@query(
    "archive_documents",
    f"""WITH {_USED}, x AS (SELECT doc_id, action, CASE WHEN action = 'archive' AND active_routine THEN 'active routine' WHEN action = 'delete' THEN block_reason END AS refusal FROM ({_ARCH}) JOIN used USING (doc_id))
 SELECT doc_id, action, refusal IS NULL AS done, refusal FROM x""",
)
def archive_documents(t):
    return L.archive_documents(_used(t), t.sql(_ARCH))


@query(
    "delete_documents",
    f"""WITH {_USED} SELECT doc_id, pos FROM f_line WHERE doc_id NOT IN (SELECT doc_id FROM used JOIN ({_ARCH}) USING (doc_id) WHERE action = 'delete' AND block_reason IS NULL)""",
)
def delete_documents(t):
    decided = L.archive_documents(_used(t), t.sql(_ARCH))
    return L.delete_documents(t.f_doc, decided, {"line": t.f_line})["line"].select("doc_id", "pos")


@query(
    "orphan_files",
    f"SELECT count(*) AS files, CAST(coalesce(sum({_duck_bytes('text')}), 0) AS BIGINT) AS bytes FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def orphan_files(t):
    return L.orphan_totals(t.documents, t.labels, F.octet_length("text"), "doc_id")


# ---------------------------------------------------------------- retention

_OLDV = """oldv AS (SELECT school_id, version FROM (SELECT *, row_number() OVER (PARTITION BY school_id ORDER BY version DESC) AS rn FROM f_routine WHERE status = 'ARCHIVED')
 WHERE rn > 2 AND coalesce(archived_on, published_on) < DATE '1999-01-01' - INTERVAL 12 MONTH)"""


@query(
    "plan_retention",
    f"""WITH {_OLDV} SELECT school_id, 'routines' AS item, count(*) AS rows, CAST(0 AS BIGINT) AS bytes FROM oldv GROUP BY ALL
 UNION ALL SELECT school_id, 'periods', count(*), 0 FROM f_period JOIN oldv USING (school_id, version) GROUP BY ALL
 UNION ALL SELECT school_id, 'duties', count(*), 0 FROM f_duty WHERE duty_date < DATE '1998-01-01' GROUP BY ALL
 UNION ALL SELECT school_id, 'notices', count(*), 0 FROM f_notice WHERE archived AND notice_date < DATE '1998-01-01' GROUP BY ALL
 UNION ALL SELECT school_id, 'draft text', count(*), CAST(sum({_duck_bytes('text')}) AS BIGINT) FROM f_doc WHERE extraction_status IN ('PUBLISHED', 'CANCELLED', 'FAILED') GROUP BY ALL""",
)
def plan_retention(t):
    return L.plan_retention(t.f_routine, t.f_period, t.f_duty, t.f_notice, t.f_doc, date(1999, 1, 1), 12)


@query("purge_routines", f"WITH {_OLDV} SELECT school_id, version, status FROM f_routine r WHERE NOT EXISTS (SELECT 1 FROM oldv o WHERE o.school_id = r.school_id AND o.version = r.version)")
def purge_routines(t):
    return L.purge_routines(t.f_routine, t.f_period, date(1999, 1, 1), 12)["routine"].select("school_id", "version", "status")


@query("purge_duties", "SELECT duty_id, duty_date FROM f_duty WHERE duty_date >= DATE '1998-01-01'")
def purge_duties(t):
    return L.purge_dated(t.f_duty, "duty_date", date(1999, 1, 1), 12).select("duty_id", "duty_date")


@query("purge_notices", "SELECT notice_id, archived FROM f_notice WHERE NOT (archived AND notice_date < DATE '1998-01-01')")
def purge_notices(t):
    return L.purge_dated(t.f_notice, "notice_date", date(1999, 1, 1), 12, F.col("archived")).select("notice_id", "archived")


_KEPT = _duck_bytes("CASE WHEN extraction_status NOT IN ('PUBLISHED', 'CANCELLED', 'FAILED') THEN text END")


@query("trim_draft_text", f"SELECT doc_id, {_KEPT} AS bytes FROM f_doc")
def trim_draft_text(t):
    return L.trim_draft_text(t.f_doc).select("doc_id", F.octet_length("text").cast("long").alias("bytes"))


# ---------------------------------------------------------------- versions, layouts, people, patches


@query(
    "copy_layout",
    """WITH p AS (SELECT * FROM f_period WHERE version = 2), src AS (SELECT * FROM p WHERE class_name = 'X' AND section = 'A'), own AS (SELECT * FROM p WHERE class_name = 'VII' AND section = 'B'),
 cols AS (SELECT school_id, slot, arg_min_null(period_number, seq) AS number, arg_min(is_break, seq) AS brk, arg_min_null(label, seq) AS lab, arg_min(start_min, seq) AS s, arg_min(end_min, seq) AS e FROM src GROUP BY ALL),
 num AS (SELECT school_id, number, max(slot) AS slot, arg_max(s, slot) AS s, arg_max(e, slot) AS e FROM cols WHERE NOT brk AND number IS NOT NULL GROUP BY ALL),
 days AS (SELECT DISTINCT school_id, day_idx FROM own UNION SELECT DISTINCT school_id, day_idx FROM src WHERE school_id NOT IN (SELECT school_id FROM own))
 SELECT school_id, seq, class_name, section, day_idx, slot, is_break, start_min, end_min FROM p WHERE NOT (class_name = 'VII' AND section = 'B') OR school_id NOT IN (SELECT school_id FROM cols)
 UNION ALL SELECT o.school_id, o.seq, o.class_name, o.section, o.day_idx, coalesce(n.slot, o.slot), false, coalesce(n.s, o.start_min), coalesce(n.e, o.end_min) FROM own o LEFT JOIN num n ON n.school_id = o.school_id AND n.number = o.period_number
  WHERE NOT o.is_break AND o.school_id IN (SELECT school_id FROM cols)
 UNION ALL SELECT c.school_id, NULL, 'VII', 'B', d.day_idx, c.slot, true, c.s, c.e FROM cols c JOIN days d USING (school_id) WHERE c.brk""",
)
def copy_layout(t):
    out = L.copy_layout(t.f_period.filter("version = 2"), ("X", "A"), ("VII", "B"))
    return out.select("school_id", "seq", "class_name", "section", "day_idx", "slot", "is_break", "start_min", "end_min")


@query("deactivate_people", "SELECT u.user_id, u.teacher_id, t.active FROM f_user u JOIN f_teacher t USING (school_id, teacher_id)")
def deactivate_people(t):
    return L.deactivate_people(t.f_user.withColumn("active", F.lit(True)), t.f_teacher).select("user_id", "teacher_id", "active")


_SWITCH = "SELECT school_id, version, CASE WHEN version = 60 THEN 'activate' WHEN version < 40 THEN 'delete' ELSE 'archive' END AS action FROM f_routine WHERE version IN (60, 110, 115) OR version < 40"


@query(
    "switch_version",
    f"""WITH a AS ({_SWITCH}), x AS (SELECT r.*, a.action, EXISTS (SELECT 1 FROM a z WHERE z.school_id = r.school_id AND z.action = 'activate') AS sw FROM f_routine r LEFT JOIN a USING (school_id, version))
 SELECT school_id, version, published_on, CASE WHEN action = 'activate' THEN {_AS} ELSE effective_from END AS effective_from, CASE WHEN action = 'activate' THEN 'ACTIVE' WHEN (sw AND status = 'ACTIVE') OR action = 'archive' THEN 'ARCHIVED' ELSE status END AS status,
 CASE WHEN action = 'activate' THEN NULL WHEN (sw AND status = 'ACTIVE') OR action = 'archive' THEN {_AS} ELSE archived_on END AS archived_on FROM x WHERE NOT (coalesce(action, '') = 'delete' AND status <> 'ACTIVE')""",
)
def switch_version(t):
    return L.switch_version(t.f_routine, t.sql(_SWITCH), AS_OF)


_PATCH = "SELECT school_id, seq, split(CASE line_key % 3 WHEN 0 THEN 'subject' WHEN 1 THEN 'teacher_id;start_min' ELSE 'label' END, ';') AS set_fields, 'Art' AS subject, CASE WHEN line_key % 2 = 0 THEN teacher_id + 1 END AS teacher_id, 500 AS start_min, CAST(NULL AS STRING) AS label FROM f_period WHERE confidence < 0.75"


@query(
    "apply_patches",
    """SELECT school_id, seq, CASE WHEN confidence < 0.75 AND line_key % 3 = 0 THEN 'Art' ELSE subject END AS subject, CASE WHEN confidence < 0.75 AND line_key % 3 = 1 THEN CASE WHEN line_key % 2 = 0 THEN teacher_id + 1 END ELSE teacher_id END AS teacher_id,
 CASE WHEN confidence < 0.75 AND line_key % 3 = 1 THEN 500 ELSE start_min END AS start_min, CASE WHEN confidence < 0.75 AND line_key % 3 = 2 THEN NULL ELSE label END AS label,
 CASE WHEN confidence < 0.75 AND line_key % 3 = 1 THEN CASE WHEN line_key % 2 = 0 AND teacher_id IS NOT NULL THEN 'T' || CAST(teacher_id + 1 AS VARCHAR) ELSE '' END ELSE printed_teacher END AS printed_teacher FROM f_period""",
)
def apply_patches(t):
    name = F.when(L.patched("teacher_id"), F.coalesce(F.concat(F.lit("T"), F.col("teacher_id").cast("string")), F.lit(""))).otherwise(F.col("printed_teacher"))
    base = t.f_period.select("school_id", "seq", "subject", "teacher_id", "start_min", "label", "printed_teacher")
    return L.apply_patches(base, t.sql(_PATCH), ["school_id", "seq"], ["subject", "teacher_id", "start_min", "label"], {"printed_teacher": name})


# ---------------------------------------------------------------- restore, files, drafts

_BACK = "SELECT teacher_id + CASE WHEN designation = 'Warden' THEN 0 ELSE 700000 END AS user_id, school_id, username FROM (SELECT t.teacher_id, t.school_id, t.designation, lower(t.code) || CAST(t.teacher_id % 40 AS STRING) AS username FROM f_teacher t) b"
_EXIST = "SELECT teacher_id AS user_id, school_id, lower(code) || CAST(teacher_id % 40 AS STRING) AS username FROM f_teacher WHERE designation = 'Librarian'"


@query(
    "restore_insert_missing",
    f"""WITH b AS ({_BACK}), e AS ({_EXIST}), i AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY user_id) = 1), j AS (SELECT * FROM i WHERE user_id NOT IN (SELECT user_id FROM e))
 SELECT * FROM (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY username ORDER BY user_id) = 1) WHERE username NOT IN (SELECT username FROM e)""",
)
def restore_insert_missing(t):
    return B.restore_insert_missing(t.sql(_EXIST), t.sql(_BACK), [["user_id"], ["username"]], "user_id")


@query(
    "remap_references",
    f"""WITH s AS (SELECT user_id, username FROM ({_BACK}) WHERE user_id >= 700000 AND user_id % 2 = 0), e AS (SELECT username, min(user_id) AS to_id FROM ({_EXIST}) GROUP BY ALL)
 SELECT n.notice_id, CASE WHEN s.user_id IS NULL THEN n.created_by ELSE e.to_id END AS created_by FROM (SELECT notice_id, notice_id % 3000 + 700000 AS created_by FROM f_notice) n LEFT JOIN s ON s.user_id = n.created_by LEFT JOIN e ON e.username = s.username""",
)
def remap_references(t):
    skipped = t.sql(_BACK).filter("user_id >= 700000 and user_id % 2 = 0")
    rows = t.f_notice.select("notice_id", (F.col("notice_id") % 3000 + 700000).alias("created_by"))
    return B.remap_references(rows, skipped, t.sql(_EXIST), ["created_by"])


def _folder(t) -> str:
    """A new folder in the place that all executors share."""
    return f"{shared_folder(t.spark)}/{uuid.uuid4()}"


@query("backup_round_trip", "SELECT 'teacher' AS name, count(*) AS rows, count(*) AS read_back FROM f_teacher UNION ALL SELECT 'duty', count(*), count(*) FROM f_duty UNION ALL SELECT 'notice', 0, 0")
def backup_round_trip(t):
    """The manifest's counts beside the rows that come back equal."""
    tables = {"teacher": t.f_teacher.select("teacher_id", "school_id", "name", "code"), "duty": t.f_duty.select("duty_id", "school_id", "duty_type"), "notice": t.f_notice.filter("notice_id < 0").select("notice_id", "school_id")}
    path = _folder(t)
    counts = B.export_json(tables, path)
    schemas = {"teacher": "teacher_id LONG, school_id INT, name STRING, code STRING", "duty": "duty_id LONG, school_id INT, duty_type STRING", "notice": "notice_id LONG, school_id INT"}
    back = B.read_backup(t.spark, path, schemas)
    same = [tables[n].intersectAll(back[n].select(*[F.col(c).cast(tables[n].schema[c].dataType).alias(c) for c in tables[n].columns])).select(F.lit(n).alias("name")) for n in tables]
    found = reduce(lambda a, b: a.unionByName(b), same).groupBy("name").agg(F.count(F.lit(1)).alias("read_back"))
    return counts.join(found, "name", "left").withColumn("read_back", F.coalesce("read_back", F.lit(0)))


@query("entity_tables", "SELECT teacher_id, school_id, name, code, designation FROM f_teacher")
def entity_tables(t):
    """A table written by school and read again by its declared types."""
    path = _folder(t)
    kept = [c for c in ("teacher_id", "school_id", "name", "code", "designation", "active") if c in t.f_teacher.columns]
    TB.save_table(t.f_teacher.select(*kept), path, "teacher")
    return TB.load_tables(t.spark, path, ["teacher"])["teacher"].select("teacher_id", "school_id", "name", "code", "designation")


@query("activity_log", "SELECT event_id, CAST(created_at AS DATE) AS day, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM f_activity")
def activity_log(t):
    """Actions appended in two batches; the stored value is a parsed one."""
    path = _folder(t)
    rows = t.f_activity.select("event_id", "created_at", F.col("props").alias("old_value"), F.lit(None).cast("string").alias("new_value"))
    D.append_activity(rows.filter("event_id % 2 = 0"), path)
    D.append_activity(rows.filter("event_id % 2 = 1"), path)
    return t.spark.read.parquet(path).select("event_id", F.col("day").cast("date").alias("day"), F.try_variant_get("old_value", "$.k", "bigint").alias("k"))


@query("published_version", "SELECT school_id, seq, subject FROM f_period WHERE version = 2")
def published_version(t):
    """Two versions published one after the other; readers follow the newest pointer."""
    path = _folder(t)
    for version in (1, 2):
        D.publish_version({"period": t.f_period.filter(F.col("version") == version).select("school_id", "seq", "subject")}, path, str(version))
    return D.read_version(t.spark, path, "period").select("school_id", "seq", "subject")


@query("manifest", "SELECT 'teacher' AS name, count(*) AS rows FROM f_teacher UNION ALL SELECT 'duty', count(*) FROM f_duty UNION ALL SELECT 'document', count(*) FROM f_doc")
def manifest(t):
    return B.manifest({"teacher": t.f_teacher, "duty": t.f_duty, "document": t.f_doc})


@query(
    "describe_files",
    """SELECT 'up/' || lang || ' ' || source || ' ' || CAST(doc_id AS VARCHAR) || '.TXT' AS path, lang || ' ' || source || ' ' || CAST(doc_id AS VARCHAR) || '.TXT' AS name, '.txt' AS extension, octet_length(encode(text)) AS size_bytes, sha256(text) AS sha256, lang || ' ' || source || ' ' || CAST(doc_id AS VARCHAR) AS title
 FROM documents""",
)
def describe_files(t):
    name = F.concat_ws(" ", "lang", "source", F.col("doc_id").cast("string"))
    files = t.documents.select(F.concat(F.lit("up/"), name, F.lit(".TXT")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return FI.describe_files(files)


@query(
    "admit_files",
    """WITH f AS (SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' WHEN 2 THEN '.txt' WHEN 3 THEN '.PDF' ELSE '.docx' END AS ext, CASE doc_id % 5 WHEN 0 THEN '%PDF-1.7 ' ELSE '' END AS head FROM documents)
 SELECT CAST(doc_id AS VARCHAR) || ext AS path, CASE WHEN octet_length(encode(head || text)) > 20000 THEN 'too large' WHEN ext = '.txt' THEN 'unsupported type' WHEN ext = '.pdf' THEN CASE WHEN regexp_matches(text, '/(Launch|EmbeddedFile)\\b') THEN 'active content' END
 ELSE 'content does not match' END AS refusal FROM f""",
)
def admit_files(t):
    kind = F.pmod("doc_id", F.lit(5))
    ext = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".png", ".txt", ".PDF", ".docx")]), (kind + 1).cast("int"))
    body = F.encode(F.concat(F.when(kind == 0, F.lit("%PDF-1.7 ")).otherwise(F.lit("")), F.col("text")), "UTF-8")
    return FI.admit_files(t.documents.select(F.concat(F.col("doc_id").cast("string"), ext).alias("path"), body.alias("content")), 20000)


_PEOPLE_LINES = "SELECT CASE teacher_id % 5 WHEN 0 THEN name || ', ' || code || ', ' || coalesce(designation, '') WHEN 1 THEN code || ' = ' || name WHEN 2 THEN code || ' | ' || name WHEN 3 THEN name ELSE ' X , ' || code END AS value FROM f_teacher"


@query(
    "import_people",
    """SELECT name, CASE WHEN teacher_id % 5 = 3 THEN NULL ELSE code END AS code, CASE WHEN teacher_id % 5 = 0 THEN designation END AS designation FROM f_teacher WHERE teacher_id % 5 <> 4""",
)
def import_people(t):
    return FI.import_people(t.sql(_PEOPLE_LINES))


def _draft_json(t):
    """Draft JSON built from the data: one draft per class-section and school."""
    rows = t.f_draft_period.withColumn("day", F.element_at(F.array(*[F.lit(d) for d in D.DAYS]), F.col("day_idx") + 1))
    rec = F.struct(
        F.col("seq").cast("string").alias("id"), F.col("class_name").alias("className"), "section", "day", "slot", F.col("period_number").alias("periodNumber"), F.col("is_break").alias("isBreak"),
        F.col("start_time").alias("startTime"), F.col("end_time").alias("endTime"), "subject", F.col("teacher_name").alias("teacherName"), F.round("confidence", 2).alias("confidence"),
    )
    g = rows.withColumn("rec", F.to_json(rec)).select("school_id", "draft_id", "seq", "rec", "confidence")
    kind = F.when(F.col("seq") % 29 == 0, F.lit('"POEM"')).otherwise(F.lit('"ROUTINE"'))
    data = F.when(F.col("seq") % 31 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"kind":'), kind, F.lit(',"periods":['), F.col("rec"), F.lit("]}")))
    return g.select("school_id", "draft_id", "seq", data.alias("data"))


@query(
    "parse_drafts",
    """SELECT school_id, draft_id, seq AS doc_seq, class_name, section, slot, subject, teacher_name, start_time FROM f_draft_period WHERE seq % 31 <> 0 AND seq % 29 <> 0 AND round(confidence, 2) BETWEEN 0 AND 1""",
)
def parse_drafts(t):
    good, _ = D.parse_drafts(_draft_json(t))
    rows = D.explode_list(good.withColumnRenamed("seq", "doc_seq"), "periods", ["school_id", "draft_id", "doc_seq"])
    return rows.select("school_id", "draft_id", "doc_seq", F.col("className").alias("class_name"), "section", "slot", "subject", F.col("teacherName").alias("teacher_name"), F.col("startTime").alias("start_time"))


@query("parse_draft_rejects", "SELECT school_id, draft_id, seq, CASE WHEN seq % 31 = 0 THEN 'not a draft' ELSE 'kind' END AS problem FROM f_draft_period WHERE seq % 31 = 0 OR seq % 29 = 0")
def parse_draft_rejects(t):
    return D.parse_drafts(_draft_json(t))[1]


# which limit each draft breaks, by its number: (remainder of 16, field, value)
_LIMITS = {1: ("section", "ABCD"), 2: ("label", "x" * 41), 3: ("subject", "x" * 121), 4: ("teacherName", "x" * 161), 5: ("room", "x" * 41), 6: ("room", "x" * 40), 7: ("label", "  " + "x" * 40 + "  ")}


@query(
    "draft_limits",
    """SELECT seq, CASE WHEN seq // 8 % 16 BETWEEN 1 AND 5 THEN 'period' WHEN seq // 8 % 16 = 8 THEN 'club' WHEN seq // 8 % 16 = 9 THEN 'duty' WHEN seq // 8 % 16 = 10 THEN 'remedial' WHEN seq // 8 % 16 = 11 THEN 'too many in weeklyOffs' WHEN seq // 8 % 16 = 12 THEN 'head' WHEN seq // 8 % 16 = 13 THEN 'generated' END AS problem
 FROM f_draft_period WHERE seq // 8 % 16 IN (1, 2, 3, 4, 5, 8, 9, 10, 11, 12, 13)""",
)
def draft_limits(t):
    """One draft a period, whose texts, lists or head break a limit or just keep it."""
    turn = F.expr("seq div 8 % 16")
    base = '{"id":"p","className":"VI","day":"MONDAY","slot":0%s}'
    shape = F.lit('{"periods":[' + base % "" + "]}")
    for k, (f, v) in _LIMITS.items():
        shape = F.when(turn == k, F.lit('{"periods":[' + base % f',"{f}":"{v}"' + "]}")).otherwise(shape)
    off = '{"id":"w","day":"MONDAY","teacherName":"A"}'
    other = {
        8: '{"clubs":[{"id":"c","name":"Art","teachers":["' + "x" * 161 + '"]}]}',
        9: '{"modDuties":[{"id":"m","date":"2026-01-05","teacherName":"A","dutyType":"REST"}]}',
        10: '{"remedial":[{"id":"r","className":"VI","category":"GAMES"}]}',
        11: '{"weeklyOffs":[' + ",".join([off] * 501) + "]}",
        12: '{"title":"' + "x" * 161 + '"}',
        13: '{"generated":{"from":"2026-01-05","to":"soon"}}',
        14: '{"weeklyOffs":[' + ",".join([off] * 500) + "]}",
    }
    for k, v in other.items():
        shape = F.when(turn == k, F.lit(v)).otherwise(shape)
    return D.parse_drafts(t.f_draft_period.select("seq", shape.alias("data")))[1]
