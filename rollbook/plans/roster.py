"""Registered roster jobs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from rollbook.operators import aggregates as A
from rollbook.operators import roster as P
from rollbook.operators import versions as V
from rollbook.plans.reads import lessons
from rollbook.plans.registry import query

START, END = date(1998, 6, 1), date(1998, 6, 21)
DAYS = [0, 1, 2, 3, 4, 5]
_POOL = "pool AS (SELECT school_id, teacher_id, name, designation FROM f_teacher WHERE active)"
_LOAD = "ld AS (SELECT school_id, teacher_id, day_idx, count(*) AS lessons FROM f_period WHERE version = 2 AND NOT is_break AND teacher_id IS NOT NULL GROUP BY ALL)"


def pool(t):
    return t.f_teacher.filter("active")


def rules(t):
    """Wardens take no duty on Mondays, librarians none of kind MOD, others of some ids are away for two days."""
    f = t.f_teacher
    days = F.when(F.col("designation") == "Warden", F.array(F.lit(0)))
    dates = F.when(F.col("designation").isNull() & (F.col("teacher_id") % 3 == 0), F.array(F.lit(date(1998, 6, 3)), F.lit(date(1998, 6, 7))))
    duties = F.when(F.col("designation") == "Librarian", F.array(F.lit("MOD")))
    out = f.select("school_id", "teacher_id", dates.alias("dates"), days.alias("days"), duties.alias("duties"))
    return out.filter("dates is not null or days is not null or duties is not null")


_CAND = f"""{_POOL}, lastd AS (SELECT school_id, teacher_id, max(duty_date) AS last_date FROM f_duty WHERE duty_date < DATE '1998-06-01' AND duty_date >= DATE '1998-05-18' GROUP BY ALL),
 d0 AS (SELECT p.*, CAST(unnest(generate_series(DATE '1998-06-01', DATE '1998-06-21', INTERVAL 1 DAY)) AS DATE) AS day FROM pool p),
 hol AS (SELECT DISTINCT school_id, duty_date AS day FROM f_duty WHERE duty_type = 'HOLIDAY'),
 cand AS (SELECT d.school_id, d.teacher_id, d.day, CAST(isodow(d.day) - 1 AS INTEGER) AS day_idx FROM d0 d WHERE isodow(d.day) <> 7
  AND NOT EXISTS (SELECT 1 FROM hol h WHERE h.school_id = d.school_id AND h.day = d.day)
  AND NOT coalesce(designation = 'Warden' AND isodow(d.day) = 1, false) AND NOT coalesce(designation = 'Librarian', false) AND NOT (designation IS NULL AND teacher_id % 3 = 0 AND d.day IN (DATE '1998-06-03', DATE '1998-06-07'))
  AND NOT EXISTS (SELECT 1 FROM f_weekly_off o WHERE o.school_id = d.school_id AND o.teacher_id = d.teacher_id AND o.day_idx = isodow(d.day) - 1)
  AND NOT EXISTS (SELECT 1 FROM f_duty c WHERE c.school_id = d.school_id AND c.teacher_id = d.teacher_id AND c.off_date = d.day)
  AND NOT EXISTS (SELECT 1 FROM lastd l WHERE l.school_id = d.school_id AND l.teacher_id = d.teacher_id AND d.day - l.last_date <= 5))"""


def _candidates(t):
    comp = t.f_duty.filter("off_date is not null").select("school_id", "teacher_id", F.col("off_date").alias("day"))
    holidays = t.f_duty.filter("duty_type = 'HOLIDAY'").select("school_id", F.col("duty_date").alias("day"))
    return P.roster_candidates(pool(t), START, END, "MOD", rules(t), t.f_weekly_off, comp, V.last_duty(t.f_duty, START), 5, holidays)


@query("roster_candidates", f"WITH {_CAND} SELECT * FROM cand")
def roster_candidates(t):
    return _candidates(t)


@query("roster_candidates_five_days", f"WITH {_CAND} SELECT * FROM cand WHERE day_idx < 5")
def roster_candidates_five_days(t):
    comp = t.f_duty.filter("off_date is not null").select("school_id", "teacher_id", F.col("off_date").alias("day"))
    holidays = t.f_duty.filter("duty_type = 'HOLIDAY'").select("school_id", F.col("duty_date").alias("day"))
    return P.roster_candidates(pool(t), START, END, "MOD", rules(t), t.f_weekly_off, comp, V.last_duty(t.f_duty, START), 5, holidays, work_days=DAYS[:5])


@query(
    "rotation_plan",
    f"""WITH {_CAND}, rk AS (SELECT *, row_number() OVER (PARTITION BY school_id ORDER BY name, teacher_id) - 1 AS r, count(*) OVER (PARTITION BY school_id) AS n FROM pool),
 h AS (SELECT school_id, teacher_id, count(*) AS load FROM f_duty WHERE duty_date < DATE '1998-06-01' GROUP BY ALL)
 SELECT c.school_id, c.teacher_id, c.day, coalesce(h.load, 0) AS load, (r + 7 * (c.day - DATE '1998-06-01')) % n AS turn FROM cand c JOIN rk USING (school_id, teacher_id) LEFT JOIN h USING (school_id, teacher_id)
 QUALIFY row_number() OVER (PARTITION BY c.school_id, c.day ORDER BY coalesce(h.load, 0), (r + 7 * (c.day - DATE '1998-06-01')) % n, c.teacher_id) <= 2""",
)
def rotation_plan(t):
    return P.rotation_plan(_candidates(t), pool(t), t.f_duty.filter("duty_date < DATE '1998-06-01'"), START, 2)


@query(
    "plan_weekly_off",
    f"""WITH {_POOL}, {_LOAD}, o AS (SELECT p.school_id, p.teacher_id, p.designation, CAST(d AS INTEGER) AS day_idx, coalesce(l.lessons, 0) AS l FROM pool p CROSS JOIN range(6) g(d) LEFT JOIN ld l ON l.school_id = p.school_id AND l.teacher_id = p.teacher_id AND l.day_idx = d),
 b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY school_id, teacher_id ORDER BY l, day_idx) = 1),
 w AS (SELECT school_id, teacher_id, CASE WHEN designation = 'Warden' THEN CAST(teacher_id % 6 AS INTEGER) ELSE day_idx END AS day_idx, CASE WHEN designation = 'Warden' THEN -1 ELSE l END AS turn FROM b),
 c AS (SELECT school_id, CAST(ceil(count(*) / 6.0) AS BIGINT) AS cap FROM pool GROUP BY ALL), n AS (SELECT w.*, row_number() OVER (PARTITION BY school_id, day_idx ORDER BY turn, teacher_id) AS n FROM w),
 fit AS (SELECT n.*, n <= cap OR turn = -1 AS ok, cap FROM n JOIN c USING (school_id)),
 ov AS (SELECT school_id, teacher_id, row_number() OVER (PARTITION BY school_id ORDER BY teacher_id) AS k FROM fit WHERE NOT ok),
 fr AS (SELECT c.school_id, CAST(d AS INTEGER) AS day_idx, greatest(cap - (SELECT count(*) FROM fit f WHERE f.ok AND f.school_id = c.school_id AND f.day_idx = d), 0) AS l FROM c CROSS JOIN range(6) g(d)),
 places AS (SELECT school_id, day_idx, row_number() OVER (PARTITION BY school_id ORDER BY day_idx, i) AS k FROM (SELECT school_id, day_idx, unnest(range(l)) AS i FROM fr))
 SELECT school_id, teacher_id, day_idx, false AS moved FROM fit WHERE ok UNION ALL SELECT o.school_id, o.teacher_id, p.day_idx, true FROM ov o JOIN places p USING (school_id, k)""",
)
def plan_weekly_off(t):
    wish = t.f_teacher.filter("designation = 'Warden'").select("school_id", "teacher_id", (F.col("teacher_id") % 6).cast("int").alias("day_idx"))
    return P.plan_weekly_off(pool(t), A.load_by_day(lessons(t)), wish.join(pool(t), ["school_id", "teacher_id"], "left_semi"), DAYS)


@query(
    "comp_off_options",
    f"""WITH {_LOAD}, h AS (SELECT school_id, teacher_id, duty_id, duty_date, CAST(unnest(generate_series(duty_date + 1, duty_date + 7, INTERVAL 1 DAY)) AS DATE) AS day FROM f_duty WHERE duty_type = 'HOLIDAY')
 SELECT h.school_id, h.teacher_id, h.duty_id, h.duty_date, h.day, coalesce(l.lessons, 0) AS lessons FROM h LEFT JOIN ld l ON l.school_id = h.school_id AND l.teacher_id = h.teacher_id AND l.day_idx = isodow(h.day) - 1
 WHERE isodow(h.day) <> 7 AND NOT EXISTS (SELECT 1 FROM f_weekly_off o WHERE o.school_id = h.school_id AND o.teacher_id = h.teacher_id AND o.day_idx = isodow(h.day) - 1)
 AND NOT EXISTS (SELECT 1 FROM f_duty d WHERE d.school_id = h.school_id AND d.teacher_id = h.teacher_id AND d.duty_date = h.day) QUALIFY row_number() OVER (PARTITION BY h.school_id, h.duty_id ORDER BY coalesce(l.lessons, 0), h.day) = 1""",
)
def comp_off_options(t):
    return P.comp_off_options(t.f_duty, t.f_weekly_off, A.load_by_day(lessons(t)), DAYS)


_SLOTS = "SELECT DISTINCT school_id, day_idx, CAST(start_min + 60 AS INT) AS start_min, CAST(end_min + 60 AS INT) AS end_min FROM f_remedial WHERE day_idx IS NOT NULL"


@query(
    "remedial_candidates",
    f"""WITH tw AS (SELECT school_id, class_name, section, teacher_id, subject, count(*) AS n FROM f_period WHERE version = 2 AND NOT is_break AND teacher_id IS NOT NULL AND subject <> '' GROUP BY ALL),
 fine AS (SELECT school_id, class_name, section, teacher_id, arg_max(subject, (n, subject)) AS subject, 0 AS tier FROM tw GROUP BY ALL),
 wd AS (SELECT school_id, class_name, teacher_id, arg_max(subject, (n, subject)) AS subject FROM (SELECT school_id, class_name, teacher_id, subject, sum(n) AS n FROM tw GROUP BY ALL) GROUP BY ALL),
 al AS (SELECT * FROM fine UNION ALL SELECT s.school_id, s.class_name, s.section, w.teacher_id, w.subject, 1 FROM (SELECT DISTINCT school_id, class_name, section FROM tw) s JOIN wd w USING (school_id, class_name)),
 bt AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY school_id, class_name, section, teacher_id ORDER BY tier) = 1),
 fs AS (SELECT p.school_id, p.teacher_id, s.day_idx, s.start_min, s.end_min FROM (SELECT DISTINCT school_id, teacher_id FROM bt) p JOIN ({_SLOTS}) s USING (school_id)
  WHERE NOT EXISTS (SELECT 1 FROM f_weekly_off o WHERE o.school_id = p.school_id AND o.teacher_id = p.teacher_id AND o.day_idx = s.day_idx)
  AND NOT EXISTS (SELECT 1 FROM f_period b WHERE b.version = 2 AND NOT b.is_break AND b.school_id = p.school_id AND b.teacher_id = p.teacher_id AND b.day_idx = s.day_idx AND s.start_min < b.end_min AND b.start_min < s.end_min)),
 gv AS (SELECT school_id, teacher_id, count(*) AS sessions FROM f_remedial WHERE active GROUP BY ALL)
 SELECT b.school_id, b.teacher_id, b.class_name, b.section, b.subject, b.tier, f.day_idx, f.start_min, f.end_min FROM bt b JOIN fs f USING (school_id, teacher_id) LEFT JOIN gv g USING (school_id, teacher_id)
 QUALIFY row_number() OVER (PARTITION BY b.school_id, b.class_name, b.section ORDER BY b.tier, coalesce(g.sessions, 0), f.day_idx, f.start_min, b.teacher_id) = 1""",
)
def remedial_candidates(t):
    given = t.f_remedial.filter("active").groupBy("school_id", "teacher_id").agg(F.count(F.lit(1)).alias("sessions"))
    return P.remedial_candidates(A.who_teaches_what(lessons(t)), t.sql(_SLOTS), lessons(t), t.f_weekly_off, given)


def _remedial_rounds(per_week: int, most: int) -> str:
    """The plan as one recursion: a step deals one round of one session to all schools and carries every row dealt so far. A step that
    deals nothing goes on to the next session."""
    rank = "CASE class_name " + " ".join(f"WHEN '{c}' THEN {i + 1}" for i, c in enumerate("I II III IV V VI VII VIII IX X XI XII".split())) + " ELSE 99 END"
    return f"""WITH RECURSIVE {_POOL}, seat AS (SELECT school_id, teacher_id, row_number() OVER (PARTITION BY school_id ORDER BY name, teacher_id) AS seat FROM pool),
 tw AS (SELECT school_id, class_name, section, teacher_id, trim(subject) AS subject, count(*) AS n FROM f_period WHERE version = 2 AND NOT is_break AND teacher_id IS NOT NULL AND trim(subject) <> '' GROUP BY ALL),
 al AS (SELECT *, 0 AS tier FROM tw UNION ALL SELECT s.school_id, s.class_name, s.section, w.teacher_id, w.subject, w.n, 1 FROM (SELECT DISTINCT school_id, class_name, section FROM tw) s
  JOIN (SELECT school_id, class_name, teacher_id, subject, sum(n) AS n FROM tw GROUP BY ALL) w USING (school_id, class_name)),
 su AS MATERIALIZED (SELECT * FROM al QUALIFY tier = min(tier) OVER (PARTITION BY school_id, class_name, section, teacher_id)),
 sl AS (SELECT DISTINCT school_id, day_idx, start_min, end_min FROM ({_SLOTS}) WHERE start_min < end_min),
 fr AS (SELECT p.school_id, p.teacher_id, p.seat, sl.day_idx, sl.start_min, sl.end_min FROM seat p JOIN sl USING (school_id) JOIN pool USING (school_id, teacher_id)
  WHERE NOT EXISTS (SELECT 1 FROM f_weekly_off o WHERE o.school_id = p.school_id AND o.teacher_id = p.teacher_id AND o.day_idx = sl.day_idx) AND NOT coalesce(designation = 'Warden' AND sl.day_idx = 0, false)
  AND NOT EXISTS (SELECT 1 FROM f_period b WHERE b.version = 2 AND NOT b.is_break AND b.school_id = p.school_id AND b.teacher_id = p.teacher_id AND b.day_idx = sl.day_idx AND sl.start_min < b.end_min AND b.start_min < sl.end_min)),
 op AS MATERIALIZED (SELECT x.*, fr.seat, fr.day_idx, fr.start_min, fr.end_min FROM (SELECT DISTINCT school_id, class_name, section, teacher_id, tier FROM su) x JOIN fr USING (school_id, teacher_id)),
 r(step, now, school_id, class_name, section, session, teacher_id, subject, tier, day_idx, start_min, end_min) AS (
  SELECT 0, 1, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0, NULL::BIGINT, NULL::VARCHAR, 0, 0, 0, 0
  UNION ALL
  (WITH d AS (SELECT * FROM r WHERE session > 0), cur AS (SELECT max(step) AS step, max(now) AS now FROM r),
   g AS (SELECT school_id, teacher_id, count(*) AS given FROM d GROUP BY ALL), h AS (SELECT school_id, class_name, section, subject, count(*) AS had FROM d GROUP BY ALL),
   ts AS (SELECT su.school_id, su.class_name, su.section, su.teacher_id, su.subject, coalesce(h.had, 0) AS had FROM su LEFT JOIN h USING (school_id, class_name, section, subject)
    QUALIFY row_number() OVER (PARTITION BY su.school_id, su.class_name, su.section, su.teacher_id ORDER BY coalesce(h.had, 0), su.n DESC, su.subject) = 1),
   o AS (SELECT op.*, coalesce(g.given, 0) AS given, ts.subject, op.tier * 1000 + coalesce(g.given, 0) * 40 + ts.had * 25
      + CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.school_id = op.school_id AND d.class_name = op.class_name AND d.section = op.section AND d.day_idx = op.day_idx) THEN 40 ELSE 0 END AS points
    FROM op JOIN ts USING (school_id, class_name, section, teacher_id) LEFT JOIN g ON g.school_id = op.school_id AND g.teacher_id = op.teacher_id
    WHERE coalesce(g.given, 0) < {most}
     AND NOT EXISTS (SELECT 1 FROM d WHERE d.school_id = op.school_id AND d.class_name = op.class_name AND d.section = op.section AND d.session = (SELECT now FROM cur))
     AND NOT EXISTS (SELECT 1 FROM d WHERE d.school_id = op.school_id AND d.teacher_id = op.teacher_id AND d.day_idx = op.day_idx)
     AND NOT EXISTS (SELECT 1 FROM d WHERE d.school_id = op.school_id AND d.class_name = op.class_name AND d.section = op.section AND d.day_idx = op.day_idx AND op.start_min < d.end_min AND d.start_min < op.end_min)),
   b AS (SELECT *, {rank} AS cr FROM o QUALIFY row_number() OVER (PARTITION BY school_id, class_name, section ORDER BY points, seat, day_idx, start_min, end_min) = 1),
   w AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY school_id, teacher_id, day_idx ORDER BY cr, section, class_name) = 1),
   n AS (SELECT * FROM w QUALIFY given + row_number() OVER (PARTITION BY school_id, teacher_id ORDER BY cr, section, class_name) <= {most}),
   nxt AS (SELECT step + 1 AS step, CASE WHEN EXISTS (SELECT 1 FROM n) THEN now ELSE now + 1 END AS now FROM cur)
   SELECT nxt.step, nxt.now, x.* FROM nxt, (SELECT school_id, class_name, section, session, teacher_id, subject, tier, day_idx, start_min, end_min FROM r
     UNION ALL SELECT school_id, class_name, section, (SELECT now FROM cur), teacher_id, subject, tier, day_idx, start_min, end_min FROM n) x WHERE nxt.now <= {per_week + 1} AND (SELECT now FROM cur) <= {per_week}))
SELECT school_id, class_name, section, session, teacher_id, subject, tier, day_idx, start_min, end_min FROM r WHERE session > 0 AND step = (SELECT max(step) FROM r)"""


@query("plan_remedial", _remedial_rounds(2, 3))
def plan_remedial(t):
    away = t.f_teacher.filter("designation = 'Warden'").select("school_id", "teacher_id", F.lit(None).cast("array<date>").alias("dates"), F.array(F.lit(0)).alias("days"), F.array(F.lit("REMEDIAL")).alias("duties"))
    return P.plan_remedial(A.who_teaches_what(lessons(t)), pool(t), t.sql(_SLOTS), lessons(t), t.f_weekly_off, away, 2, 3)


@query("target_gap", "SELECT * FROM (SELECT school_id, count(*) AS teachers, CAST(greatest(least(20, count(*) // 3 - 2), 0) AS INTEGER) AS gap FROM f_teacher WHERE active GROUP BY ALL) WHERE gap < 20")
def target_gap(t):
    return P.shortage(pool(t), 3, 20)


_RULES = """SELECT c_nationkey AS school_id, CAST(c_custkey % 70 AS INT) AS place, CASE c_custkey % 4 WHEN 0 THEN 'prefer_off_day' WHEN 1 THEN 'no_duty' WHEN 2 THEN 'unavailable' ELSE 'sing' END AS type,
 c_custkey AS rule_id, c_acctbal > 4000 AS rich FROM customer"""


def _rule_rows(t):
    d = t.sql(_RULES)
    two = F.array(F.lit(6), F.lit(2))
    return d.select(
        "school_id", "place", "type", F.lit(None).cast("array<date>").alias("dates"), F.when(F.col("rich"), two).otherwise(F.array(F.lit(6))).alias("days"),
        F.when(F.col("rich"), F.array(F.lit("MOD"))).otherwise(F.array().cast("array<string>")).alias("duties"),
    )


_RULED = f"""WITH {_POOL}, rk AS (SELECT school_id, teacher_id, CAST(row_number() OVER (PARTITION BY school_id ORDER BY name, teacher_id) AS INTEGER) AS place FROM pool),
 x AS (SELECT r.*, rk.teacher_id, rk.teacher_id IS NOT NULL AND CASE type WHEN 'prefer_off_day' THEN rich WHEN 'no_duty' THEN rich WHEN 'unavailable' THEN true ELSE false END AS ok FROM ({_RULES}) r LEFT JOIN rk USING (school_id, place))"""


@query("restrictions_from_rules", f"{_RULED} SELECT school_id, teacher_id, CASE WHEN type = 'unavailable' THEN CASE WHEN rich THEN '6,2' ELSE '6' END END AS days, CASE WHEN rich THEN 'MOD' END AS duties FROM x WHERE ok AND type <> 'prefer_off_day'")
def restrictions_from_rules(t):
    out = P.restrictions_from_rules(_rule_rows(t), pool(t))["restrictions"]
    return out.select("school_id", "teacher_id", F.array_join(F.transform("days", lambda d: d.cast("string")), ",").alias("days"), F.array_join("duties", ",").alias("duties"))


@query("preferred_offs", f"{_RULED} SELECT school_id, teacher_id, 2 AS day_idx FROM x WHERE ok AND type = 'prefer_off_day'")
def preferred_offs(t):
    return P.restrictions_from_rules(_rule_rows(t), pool(t))["preferred"]


@query("skipped_rules", f"{_RULED} SELECT school_id, count(*) FILTER (NOT ok) AS skipped FROM x GROUP BY ALL")
def skipped_rules(t):
    return P.restrictions_from_rules(_rule_rows(t), pool(t))["skipped"]
