"""Registered conflict checks and version jobs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from rollbook.keyed import last_wins
from rollbook.operators import conflicts as C
from rollbook.operators import versions as V
from rollbook.plans.registry import query

VER = ["school_id", "version"]

_BOOK = """book AS (SELECT school_id, version, teacher_id, day_idx, class_name, section, start_min, end_min, period_number, count(*) AS n, min(seq) AS first_seq
 FROM f_period WHERE NOT is_break AND teacher_id IS NOT NULL GROUP BY ALL)"""


@query(
    "teacher_clash",
    f"""WITH {_BOOK} SELECT a.school_id, a.version, a.teacher_id, a.day_idx, a.first_seq AS other_seq, b.first_seq AS seq, a.class_name AS class_name_a, a.section AS section_a,
 b.class_name AS class_name_b, b.section AS section_b, a.n * b.n AS pairs FROM book a JOIN book b USING (school_id, version, teacher_id, day_idx)
 WHERE a.first_seq < b.first_seq AND (a.class_name <> b.class_name OR a.section <> b.section) AND a.start_min < b.end_min AND b.start_min < a.end_min""",
)
def teacher_clash(t):
    return C.teacher_clash(t.f_period, VER)


@query(
    "teacher_clash_pairs",
    """SELECT a.school_id, a.version, count(*) AS pairs FROM f_period a JOIN f_period b USING (school_id, version, teacher_id, day_idx)
 WHERE NOT a.is_break AND NOT b.is_break AND a.seq < b.seq AND (a.class_name <> b.class_name OR a.section <> b.section)
 AND a.start_min < b.end_min AND b.start_min < a.end_min GROUP BY ALL""",
)
def teacher_clash_pairs(t):
    return C.teacher_clash(t.f_period, VER).groupBy(*VER).agg(F.sum("pairs").alias("pairs"))


@query(
    "clashing_rows",
    """SELECT DISTINCT b.school_id, b.version, b.seq FROM f_period a JOIN f_period b USING (school_id, version, teacher_id, day_idx)
 WHERE NOT a.is_break AND NOT b.is_break AND a.seq < b.seq AND (a.class_name <> b.class_name OR a.section <> b.section)
 AND a.start_min < b.end_min AND b.start_min < a.end_min""",
)
def clashing_rows(t):
    return C.clashing_rows(t.f_period, VER).select(*VER, "seq")


@query(
    "remedial_clash",
    """SELECT school_id, seq, teacher_id, day_idx FROM f_remedial r WHERE EXISTS (SELECT 1 FROM f_period p WHERE p.version = 2 AND NOT p.is_break AND p.school_id = r.school_id
 AND p.teacher_id = r.teacher_id AND p.day_idx = r.day_idx AND r.start_min < p.end_min AND p.start_min < r.end_min)""",
)
def remedial_clash(t):
    return C.remedial_clash(t.f_remedial, t.f_period.filter("version = 2")).select("school_id", "seq", "teacher_id", "day_idx")


@query(
    "remedial_double",
    """WITH book AS (SELECT school_id, teacher_id, day_idx, start_min, end_min, count(*) AS n, min(seq) AS first_seq FROM f_remedial WHERE day_idx IS NOT NULL GROUP BY ALL)
 SELECT * FROM (SELECT a.school_id, a.teacher_id, a.day_idx, a.first_seq AS other_seq, b.first_seq AS seq, a.start_min AS start_min_a, a.end_min AS end_min_a, b.start_min AS start_min_b, b.end_min AS end_min_b,
 CASE WHEN a.first_seq = b.first_seq THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS pairs FROM book a JOIN book b USING (school_id, teacher_id, day_idx)
 WHERE a.first_seq <= b.first_seq AND a.start_min < b.end_min AND b.start_min < a.end_min) WHERE pairs > 0""",
)
def remedial_double(t):
    return C.remedial_double(t.f_remedial)


@query(
    "doubled_rows",
    """SELECT DISTINCT b.school_id, b.seq FROM f_remedial a JOIN f_remedial b USING (school_id, teacher_id, day_idx)
 WHERE a.seq < b.seq AND a.start_min < b.end_min AND b.start_min < a.end_min""",
)
def doubled_rows(t):
    return C.doubled_rows(t.f_remedial).select("school_id", "seq")


@query(
    "adjacent_gap",
    """SELECT school_id, version, seq, gap, CASE WHEN gap < 0 THEN 'overlap' ELSE 'timeGap' END AS code FROM (SELECT school_id, version, seq,
 start_min - lag(end_min) OVER (PARTITION BY school_id, version, class_name, section, day_idx ORDER BY start_min, seq) AS gap FROM f_period) WHERE gap < 0 OR gap BETWEEN 1 AND 5""",
)
def adjacent_gap(t):
    rows = t.f_period.select(*VER, "class_name", "section", "day_idx", "seq", "start_min", "end_min")  # the rows are checkpointed
    return C.adjacent_gap(rows, VER).select(*VER, "seq", "gap", "code")


@query(
    "duty_sequence",
    """SELECT school_id, duty_id, prev_date, coalesce(duty_date = prev_date, false) AS same_day, coalesce(duty_date - prev_date = 1, false) AS next_day FROM
 (SELECT *, lag(duty_date) OVER (PARTITION BY school_id, teacher_id ORDER BY duty_date, duty_id) AS prev_date FROM f_duty)""",
)
def duty_sequence(t):
    d = C.duty_sequence(t.f_duty.withColumn("seq", F.col("duty_id")))
    return d.select("school_id", "duty_id", "prev_date", "same_day", "next_day")


_DUP = "PARTITION BY school_id, version, class_name, section, day_idx, slot"


@query("repeated_periods", f"SELECT school_id, version, seq FROM f_period QUALIFY row_number() OVER ({_DUP} ORDER BY seq) > 1")
def repeated_periods(t):
    return C.repeated_periods(t.f_period, VER).select(*VER, "seq")


@query("last_wins", f"SELECT school_id, version, class_name, section, day_idx, slot, seq, subject FROM f_period QUALIFY row_number() OVER ({_DUP} ORDER BY seq DESC) = 1")
def last_wins_(t):
    key = [*VER, "class_name", "section", "day_idx", "slot"]
    return last_wins(t.f_period, key).select(*key, "seq", "subject")


@query("many_per_date", "SELECT school_id, duty_date, count(*) AS mods, min(duty_id) AS seq FROM f_duty WHERE duty_type = 'MOD' GROUP BY ALL HAVING count(*) > 1")
def many_per_date(t):
    return C.many_per_date(t.f_duty.withColumn("seq", F.col("duty_id")))


@query(
    "duty_on_weekly_off",
    """SELECT d.school_id, d.teacher_id, d.duty_id, d.duty_date FROM f_duty d JOIN f_weekly_off o ON d.school_id = o.school_id AND d.teacher_id = o.teacher_id
 AND o.day_idx = isodow(d.duty_date) - 1 WHERE duty_type = 'MOD'""",
)
def duty_on_weekly_off(t):
    return C.duty_on_weekly_off(t.f_duty, t.f_weekly_off).select("school_id", "teacher_id", "duty_id", "duty_date")


@query(
    "duty_on_comp_off",
    """SELECT school_id, teacher_id, duty_id, duty_date FROM f_duty d WHERE EXISTS (SELECT 1 FROM f_duty o WHERE o.school_id = d.school_id AND o.teacher_id = d.teacher_id AND o.off_date = d.duty_date)""",
)
def duty_on_comp_off(t):
    return C.duty_on_comp_off(t.f_duty).select("school_id", "teacher_id", "duty_id", "duty_date")


_SIDE = """{n} AS (SELECT school_id, class_name, section, day_idx, slot, subject, teacher_id, start_min, end_min FROM f_period WHERE NOT is_break AND version = {v}
 QUALIFY row_number() OVER (PARTITION BY school_id, class_name, section, day_idx, slot ORDER BY seq DESC) = 1)"""
_DIFF = f"""{_SIDE.format(n='o', v=1)}, {_SIDE.format(n='w', v=2)}, diff AS (SELECT school_id, class_name, section, day_idx, slot,
 o.subject AS before_subject, o.teacher_id AS before_teacher_id, o.start_min AS before_start_min, o.end_min AS before_end_min,
 w.subject AS after_subject, w.teacher_id AS after_teacher_id, w.start_min AS after_start_min, w.end_min AS after_end_min,
 CASE WHEN o.start_min IS NULL THEN 'added' WHEN w.start_min IS NULL THEN 'removed' ELSE 'changed' END AS kind
 FROM o FULL JOIN w USING (school_id, class_name, section, day_idx, slot)
 WHERE o.subject IS DISTINCT FROM w.subject OR o.teacher_id IS DISTINCT FROM w.teacher_id OR o.start_min IS DISTINCT FROM w.start_min OR o.end_min IS DISTINCT FROM w.end_min)"""


def _diff(t):
    return V.version_diff(t.f_period.filter("version = 1"), t.f_period.filter("version = 2"))


@query("version_diff", f"WITH {_DIFF} SELECT * FROM diff")
def version_diff(t):
    return _diff(t)


@query(
    "diff_affecting",
    f"""WITH {_DIFF} SELECT school_id, class_name, section, day_idx, slot, kind, before_teacher_id AS teacher_id FROM diff WHERE before_teacher_id IS NOT NULL
 UNION SELECT school_id, class_name, section, day_idx, slot, kind, after_teacher_id FROM diff WHERE after_teacher_id IS NOT NULL""",
)
def diff_affecting(t):
    return V.diff_affecting(_diff(t)).select("school_id", "class_name", "section", "day_idx", "slot", "kind", "teacher_id")


@query(
    "routine_as_of",
    """SELECT d.school_id, d.day, r.version FROM (SELECT DISTINCT school_id, duty_date AS day FROM f_duty) d
 ASOF LEFT JOIN (SELECT school_id, effective_from, max(version) AS version FROM f_routine GROUP BY ALL) r ON d.school_id = r.school_id AND d.day >= r.effective_from""",
)
def routine_as_of(t):
    return V.routine_as_of(t.f_routine, t.f_duty.select("school_id", F.col("duty_date").alias("day")))


_AS_OF = "DATE '2001-04-15'"
AS_OF = date(2001, 4, 15)


@query(
    "activate_due",
    f"""WITH due AS (SELECT school_id, arg_max(version, (effective_from, version)) AS winner FROM f_routine WHERE status = 'SCHEDULED' AND effective_from <= {_AS_OF} GROUP BY ALL)
 SELECT r.school_id, r.version, r.effective_from, r.published_on,
 CASE WHEN r.version = winner AND status = 'SCHEDULED' THEN 'ACTIVE' WHEN winner IS NOT NULL AND (status = 'ACTIVE' OR (status = 'SCHEDULED' AND effective_from <= {_AS_OF})) THEN 'ARCHIVED' ELSE status END AS status,
 CASE WHEN r.version = winner AND status = 'SCHEDULED' THEN NULL WHEN winner IS NOT NULL AND (status = 'ACTIVE' OR (status = 'SCHEDULED' AND effective_from <= {_AS_OF})) THEN {_AS_OF} ELSE archived_on END AS archived_on
 FROM f_routine r LEFT JOIN due USING (school_id)""",
)
def activate_due(t):
    return V.activate_due(t.f_routine, AS_OF)


@query("active_routine", "SELECT school_id, version FROM f_routine WHERE status = 'ACTIVE' QUALIFY row_number() OVER (PARTITION BY school_id ORDER BY version DESC) = 1")
def active_routine(t):
    return V.active_routine(t.f_routine).select("school_id", "version")


@query("previous_routine", "SELECT school_id, version, archived_on FROM f_routine WHERE status = 'ARCHIVED' AND archived_on IS NOT NULL QUALIFY row_number() OVER (PARTITION BY school_id ORDER BY archived_on DESC, version DESC) = 1")
def previous_routine(t):
    return V.previous_routine(t.f_routine).select("school_id", "version", "archived_on")


@query("upcoming_routine", "SELECT school_id, version, effective_from FROM f_routine WHERE status = 'SCHEDULED' QUALIFY row_number() OVER (PARTITION BY school_id ORDER BY effective_from, version) = 1")
def upcoming_routine(t):
    return V.upcoming_routine(t.f_routine).select("school_id", "version", "effective_from")


@query("next_version", "SELECT s.c_nationkey AS school_id, CAST(coalesce(max(version), 0) + 1 AS INTEGER) AS next_version FROM (SELECT DISTINCT c_nationkey FROM customer) s LEFT JOIN f_routine r ON r.school_id = s.c_nationkey GROUP BY ALL")
def next_version(t):
    return V.next_version(t.f_routine, t.customer.select(F.col("c_nationkey").alias("school_id")))


@query(
    "keep_newest",
    """SELECT school_id, version, archived_on, published_on FROM (SELECT *, row_number() OVER (PARTITION BY school_id ORDER BY version DESC) AS rn FROM f_routine WHERE status = 'ARCHIVED')
 WHERE rn > 2 AND coalesce(archived_on, published_on) < DATE '1999-06-01'""",
)
def keep_newest(t):
    return V.beyond_newest(t.f_routine, date(1999, 6, 1)).select("school_id", "version", "archived_on", "published_on")


@query("last_duty", "SELECT school_id, teacher_id, max(duty_date) AS last_date FROM f_duty WHERE duty_date < DATE '1998-06-15' AND duty_date >= DATE '1998-06-01' GROUP BY ALL")
def last_duty(t):
    return V.last_duty(t.f_duty, date(1998, 6, 15))
