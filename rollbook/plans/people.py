"""Registered identity jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import aggregates as A
from rollbook.operators import cleanup as C
from rollbook.operators import identity as I
from rollbook.operators.reads import missing_logins
from rollbook.plans import sqltext as S
from rollbook.plans.reads import people
from rollbook.plans.registry import query

DRAFT = ["school_id", "draft_id"]

# ---- SQL pieces: directory keys and tiered resolution of a CTE `asked(school_id, name)` into `found`
_KEYS = f"""dk AS (SELECT school_id, space, k, min(teacher_id) AS id FROM (
  SELECT school_id, teacher_id, 'name' AS space, {S.key('name')} AS k FROM f_teacher WHERE active
  UNION ALL SELECT school_id, teacher_id, 'name', {S.key('al')} FROM (SELECT school_id, teacher_id, unnest(string_split(alias_list, ';')) AS al FROM f_teacher WHERE active)
  UNION ALL SELECT school_id, teacher_id, 'code', {S.key('code')} FROM f_teacher WHERE active) WHERE k <> '' GROUP BY ALL HAVING count(DISTINCT teacher_id) = 1)"""
_FOUND = rf"""{S.classified('c', 'asked', 'name')}, {_KEYS},
 parts0 AS (SELECT DISTINCT name, list_filter(list_transform(regexp_split_to_array(name, '[()/,;]| - | – '), lambda p: {S.key('p')}), lambda p: length(p) >= 2) AS ps FROM asked),
 parts AS (SELECT DISTINCT a.school_id, a.name, p FROM asked a JOIN (SELECT name, unnest(ps) AS p FROM parts0 WHERE len(ps) > 1) x USING (name)),
 phit AS (SELECT p.school_id, p.name, coalesce(n.id, c.id) AS id FROM parts p LEFT JOIN dk n ON n.school_id = p.school_id AND n.space = 'name' AND n.k = p.p
  LEFT JOIN dk c ON c.school_id = p.school_id AND c.space = 'code' AND c.k = p.p),
 pone AS (SELECT school_id, name, min(id) AS id FROM phit WHERE id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT id) = 1),
 keyed AS (SELECT a.school_id, a.name, CASE WHEN c.kind = 'person' THEN {S.key('c.pname')} END AS k1, CASE WHEN c.kind = 'person' THEN {S.key('c.pcode')} END AS k2, {S.key('a.name')} AS k FROM asked a JOIN c ON a.name = c.raw),
 found AS (SELECT k.school_id, k.name, coalesce(a.id, b.id, n.id, d.id, p.id) AS id FROM keyed k
  LEFT JOIN dk a ON a.school_id = k.school_id AND a.space = 'name' AND a.k = k.k1 LEFT JOIN dk b ON b.school_id = k.school_id AND b.space = 'code' AND b.k = k.k2
  LEFT JOIN dk n ON n.school_id = k.school_id AND n.space = 'name' AND n.k = k.k LEFT JOIN dk d ON d.school_id = k.school_id AND d.space = 'code' AND d.k = k.k
  LEFT JOIN pone p ON p.school_id = k.school_id AND p.name = k.name)"""


def resolved_cte(names_sql: str, name: str = "resolved") -> str:
    """CTEs ending in `resolved(school_id, raw, teacher_id)` for a text selecting (school_id, raw), no mapping."""
    return f"asked AS (SELECT DISTINCT school_id, trim(raw) AS name FROM ({names_sql}) WHERE trim(raw) <> ''), {_FOUND}, {name} AS (SELECT school_id, name AS raw, id AS teacher_id FROM found)"


_MAPPED = "SELECT school_id, raw FROM f_raw_name UNION SELECT school_id, raw FROM f_mapping"
# chains are at most three hops long in this data; five are followed
_CHAIN = f"""h0 AS (SELECT school_id, raw, raw AS name, (SELECT target FROM f_mapping m WHERE m.school_id = n.school_id AND m.raw = n.raw) AS target FROM (SELECT DISTINCT school_id, raw FROM ({_MAPPED})) n),
 """ + ",\n ".join(
    f"""h{i} AS (SELECT h.school_id, h.raw, CASE WHEN starts_with(target, 'SAME:') THEN substr(target, 6) ELSE name END AS name,
 CASE WHEN starts_with(target, 'SAME:') THEN (SELECT m.target FROM f_mapping m WHERE m.school_id = h.school_id AND m.raw = substr(h.target, 6)) ELSE target END AS target FROM h{i - 1} h)"""
    for i in range(1, 6)
)
_RESOLVE = f"""{_CHAIN}, mid AS (SELECT h.school_id, h.raw, h.name, h.target, t.teacher_id FROM h5 h LEFT JOIN f_teacher t ON t.school_id = h.school_id AND t.active AND CAST(t.teacher_id AS VARCHAR) = h.target),
 asked AS (SELECT DISTINCT school_id, name FROM mid WHERE teacher_id IS NULL), {_FOUND},
 resolved AS (SELECT m.school_id, m.raw, coalesce(m.teacher_id, f.id) AS teacher_id, coalesce(m.target = 'NEW', false) AS is_new FROM mid m LEFT JOIN found f ON f.school_id = m.school_id AND f.name = m.name)"""


def _names(t):
    return t.f_raw_name.select("school_id", "raw").unionByName(t.f_mapping.select("school_id", "raw"))


def _resolved(t):
    return I.resolve_names(_names(t), people(t), t.f_mapping)


@query("follow_aliases", f"WITH {_CHAIN} SELECT school_id, raw, name, target FROM h5")
def follow_aliases(t):
    return I.follow_aliases(_names(t).distinct(), t.f_mapping)


@query("resolve_names", f"WITH {_RESOLVE} SELECT * FROM resolved")
def resolve_names(t):
    return _resolved(t)


_TYPO = "SELECT DISTINCT school_id, replace(replace(name, 'Chandan', 'Chandnan'), 'Kumar', 'Kumr') || CASE WHEN teacher_id % 8 = 0 THEN 'n' ELSE '' END AS raw FROM f_teacher"


@query(
    "fuzzy_resolve",
    f"""WITH a AS (SELECT school_id, raw, {S.key('raw')} AS q FROM ({_TYPO})), d AS (SELECT school_id, teacher_id, {S.key('name')} AS d FROM f_teacher WHERE active
  UNION SELECT school_id, teacher_id, {S.key('al')} FROM (SELECT school_id, teacher_id, unnest(string_split(alias_list, ';')) AS al FROM f_teacher WHERE active))
 SELECT a.school_id, a.raw, min(d.teacher_id) AS teacher_id FROM a JOIN d ON a.school_id = d.school_id AND length(q) >= 6 AND length(d) >= 6 AND levenshtein(q, d) <= CASE WHEN length(q) >= 12 THEN 2 ELSE 1 END
 GROUP BY ALL HAVING count(DISTINCT d.teacher_id) = 1""",
)
def fuzzy_resolve(t):
    return I.fuzzy_resolve(t.sql(_TYPO), people(t))


_USES = "uses AS (SELECT school_id, draft_id, trim(teacher_name) AS name, count(*) AS n FROM f_spelled_period WHERE NOT is_break AND trim(teacher_name) <> '' GROUP BY ALL)"


def _uses(t):
    return A.name_usage([t.f_spelled_period.filter("not is_break")], DRAFT)


def _drafted(df, t):
    """School rows repeated for each of its drafts."""
    drafts = t.f_spelled_period.select(*DRAFT).distinct()
    return df.join(drafts, "school_id")


@query(
    "suggest_names",
    f"""WITH {_USES}, {resolved_cte('SELECT school_id, name AS raw FROM uses')},
 u AS (SELECT *, {S.fold('name')} AS a FROM uses),
 q AS (SELECT u.* FROM u JOIN resolved r ON r.school_id = u.school_id AND r.raw = u.name AND r.teacher_id IS NULL WHERE length(a) >= 4
  AND NOT EXISTS (SELECT 1 FROM f_mapping m WHERE m.school_id = u.school_id AND m.raw = u.name)),
 k AS (SELECT school_id, name AS label, {S.fold('w')} AS k FROM (SELECT school_id, name, unnest([name, code] || string_split(alias_list, ';')) AS w FROM f_teacher WHERE active)),
 cand AS (SELECT q.school_id, q.draft_id, q.name, q.a, u.name AS label, u.a AS k, u.n AS cnt FROM q JOIN u ON u.school_id = q.school_id AND u.draft_id = q.draft_id AND u.name <> q.name AND length(u.a) >= 4 AND u.n >= greatest(4, 3 * q.n)
  UNION ALL SELECT DISTINCT q.school_id, q.draft_id, q.name, q.a, k.label, k.k, 0 FROM q JOIN k ON k.school_id = q.school_id AND length(k.k) >= 4),
 near AS (SELECT *, levenshtein(a, k) AS distance FROM cand),
 ok AS (SELECT * FROM near WHERE distance <= CASE WHEN regexp_matches(name, '^(tgt|pgt|prt|pet|ppl|pat|hm|vp|lib|ct)', 'i') OR regexp_matches(label, '^(tgt|pgt|prt|pet|ppl|pat|hm|vp|lib|ct)', 'i') THEN 0 ELSE 1 END)
 SELECT school_id, draft_id, name, label AS suggestion, CAST(distance AS INTEGER) AS distance FROM ok QUALIFY row_number() OVER (PARTITION BY school_id, draft_id, name ORDER BY distance, cnt DESC, label) = 1""",
)
def suggest_names(t):
    uses = _uses(t)
    names = uses.select("school_id", F.col("name").alias("raw")).distinct()
    resolved = _drafted(I.resolve_names(names, people(t)), t)
    return I.suggest_names(uses, resolved, _drafted(t.f_mapping, t), _drafted(people(t), t), DRAFT)


_CODES = "SELECT school_id, teacher_id AS seq, CASE teacher_id % 4 WHEN 0 THEN code || 'S' WHEN 1 THEN substr(code, 1, 6) WHEN 2 THEN code ELSE 'TGT-' || c END AS raw FROM (SELECT *, CASE teacher_id % 3 WHEN 0 THEN 'HINDI' WHEN 1 THEN 'BIO' ELSE 'ENGLISH' END AS c FROM f_teacher) x"
# posts held by few: only wardens keep their code
_FEW = "SELECT school_id, teacher_id, name, CASE WHEN teacher_id % 12 < 3 THEN code END AS code, active FROM f_teacher"


@query(
    "suggest_by_code",
    f"""WITH n AS (SELECT DISTINCT school_id, raw FROM ({_CODES})), {S.classified('c', 'n', 'raw')},
 q AS (SELECT n.school_id, n.raw, {S.prefix('c.pcode')} AS p, {S.stem('c.pcode')} AS s FROM n JOIN c USING (raw) WHERE c.kind = 'code'),
 h AS (SELECT school_id, teacher_id, name, {S.prefix('code')} AS p, {S.stem('code')} AS s FROM ({_FEW}) WHERE active AND code IS NOT NULL),
 m AS (SELECT q.school_id, q.raw, h.teacher_id, h.name FROM q JOIN h ON h.school_id = q.school_id AND h.p = q.p AND (h.s = q.s OR (least(length(h.s), length(q.s)) >= 2 AND (starts_with(h.s, q.s) OR starts_with(q.s, h.s)))))
 SELECT school_id, raw AS name, min(teacher_id) AS teacher_id, min(name) AS suggestion FROM m GROUP BY ALL HAVING count(DISTINCT teacher_id) = 1""",
)
def suggest_by_code(t):
    few = t.sql(_FEW).withColumn("aliases", F.array().cast("array<string>"))
    return I.suggest_by_code(t.sql(_CODES).select("school_id", "raw").distinct(), few)


def _spell(value: str, name: str) -> str:
    return f"""{name}_p AS (SELECT school_id, draft_id, trim({value}) AS s, count(*) AS n FROM f_spelled_period WHERE NOT is_break AND trim({value}) <> '' GROUP BY ALL),
 {name}_f AS (SELECT *, {S.fold('s')} AS k FROM {name}_p), {name} AS (SELECT school_id, draft_id, s, first_value(s) OVER (PARTITION BY school_id, draft_id, k ORDER BY n DESC, length(s) DESC, s) AS canon FROM {name}_f WHERE length(k) >= 3)"""


@query(
    "merge_look_alikes",
    f"""WITH {_spell('subject', 'sj')}, {_spell('teacher_name', 'tn')}
 SELECT p.school_id, p.draft_id, p.seq, CASE WHEN is_break THEN subject ELSE coalesce(sj.canon, subject) END AS subject, CASE WHEN is_break THEN teacher_name ELSE coalesce(tn.canon, teacher_name) END AS teacher_name,
 CASE WHEN NOT is_break AND (sj.canon <> trim(subject) OR tn.canon <> trim(teacher_name)) THEN least(confidence, 0.85) ELSE confidence END AS confidence
 FROM f_spelled_period p LEFT JOIN sj ON sj.school_id = p.school_id AND sj.draft_id = p.draft_id AND sj.s = trim(p.subject) LEFT JOIN tn ON tn.school_id = p.school_id AND tn.draft_id = p.draft_id AND tn.s = trim(p.teacher_name)""",
)
def merge_look_alikes(t):
    out = I.merge_look_alikes({"period": t.f_spelled_period}, DRAFT)["period"]
    return out.select(*DRAFT, "seq", "subject", "teacher_name", "confidence")


_PAIRS = "SELECT DISTINCT school_id, draft_id, teacher_name AS old, replace(teacher_name, 'TGT', 'PGT') AS new FROM f_spelled_period WHERE teacher_name = 'TGT-MATHS'"


@query(
    "rename_spelling",
    f"""SELECT p.school_id, p.draft_id, p.seq, coalesce(r.new, p.teacher_name) AS teacher_name, CASE WHEN r.new IS NULL THEN p.confidence END AS confidence
 FROM f_spelled_period p LEFT JOIN ({_PAIRS}) r ON r.school_id = p.school_id AND r.draft_id = p.draft_id AND r.old = trim(p.teacher_name)""",
)
def rename_spelling(t):
    return I.rename_spelling(t.f_spelled_period, t.sql(_PAIRS), DRAFT).select(*DRAFT, "seq", "teacher_name", "confidence")


@query(
    "review_order",
    f"""WITH {_USES}, {resolved_cte('SELECT school_id, name AS raw FROM uses')} SELECT u.school_id, u.draft_id, u.name, u.n AS uses, u.n >= 3 AS frequent, r.teacher_id, r.teacher_id IS NULL AS unresolved
 FROM uses u JOIN resolved r ON r.school_id = u.school_id AND r.raw = u.name""",
)
def review_order(t):
    uses = _uses(t)
    names = uses.select("school_id", F.col("name").alias("raw")).distinct()
    resolved = _drafted(I.resolve_names(names, people(t)).withColumnRenamed("raw", "name"), t)
    return A.review_order(uses, resolved, DRAFT)


@query(
    "unique_usernames",
    """WITH b AS (SELECT school_id, teacher_id, name, lower(replace(substr(name, instr(name, ' ') + 1), ' ', '.')) AS base FROM f_teacher t
   WHERE active AND NOT EXISTS (SELECT 1 FROM f_user u WHERE u.school_id = t.school_id AND u.teacher_id = t.teacher_id)),
 k AS (SELECT *, row_number() OVER (PARTITION BY school_id, base ORDER BY name, teacher_id) AS k FROM b),
 nums AS (SELECT base.school_id, base.base, i, row_number() OVER (PARTITION BY base.school_id, base.base ORDER BY i) AS r FROM (SELECT school_id, base, max(k) + 200 AS top FROM k GROUP BY ALL) base, generate_series(1, top) g(i)
   WHERE NOT EXISTS (SELECT 1 FROM f_user u WHERE u.school_id = base.school_id AND u.username = base.base || CASE WHEN i = 1 THEN '' ELSE CAST(i AS VARCHAR) END))
 SELECT k.school_id, k.teacher_id, k.name, k.base || CASE WHEN i = 1 THEN '' ELSE CAST(i AS VARCHAR) END AS username FROM k JOIN nums n ON n.school_id = k.school_id AND n.base = k.base AND n.r = k.k""",
)
def unique_usernames(t):
    return I.unique_usernames(missing_logins(people(t), t.f_user), t.f_user)


# ---------------------------------------------------------------- clean-up

_DIR = """SELECT n.school_id, n.seq AS teacher_id, n.raw_text AS name, CASE WHEN n.seq % 5 = 0 THEN t.code END AS code, CASE WHEN n.seq % 7 = 0 THEN t.designation END AS designation, t.alias_list,
 CAST(n.seq % 23 AS BIGINT) AS refs, CAST(n.seq % 3 AS BIGINT) AS hard_refs, n.seq % 11 = 0 AS has_user FROM f_name_text n JOIN f_teacher t ON t.school_id = n.school_id AND t.teacher_id = n.seq % 10000000"""

_PLAN = rf"""d AS ({_DIR}), {S.classified('c', 'd', 'name')},
 r AS (SELECT d.*, c.kind, c.pname, c.pcode, c.pdesignation, CASE WHEN c.kind = 'person' THEN {S.person_key('c.pname')} END AS person FROM d JOIN c ON d.name = c.raw),
 ps AS (SELECT *, first_value(teacher_id) OVER (PARTITION BY school_id, person ORDER BY has_user DESC, refs DESC, length(name), teacher_id) AS keep_id FROM r WHERE kind = 'person'),
 held AS (SELECT DISTINCT school_id, person, {S.prefix('x')} AS p, {S.stem('x')} AS s FROM (SELECT school_id, person, unnest([code, pcode]) AS x FROM ps) WHERE {S.prefix('x')} IS NOT NULL),
 cs AS (SELECT *, coalesce({S.prefix('pcode')}, '') AS p, coalesce({S.stem('pcode')}, pcode) AS s FROM r WHERE kind = 'code' AND NOT contains(name, '/') AND NOT regexp_matches(name, '\d\s*,\s*\d')),
 hold AS (SELECT cs.school_id, cs.teacher_id, min(h.person) AS lo, max(h.person) AS hi FROM cs LEFT JOIN held h ON h.school_id = cs.school_id AND h.p = cs.p
   AND (h.s = cs.s OR (least(length(h.s), length(cs.s)) >= 2 AND (starts_with(h.s, cs.s) OR starts_with(cs.s, h.s)))) GROUP BY ALL),
 free AS (SELECT cs.*, hold.lo FROM cs JOIN hold USING (school_id, teacher_id) WHERE lo IS NULL OR lo <> hi),
 stems AS (SELECT DISTINCT school_id, p, s FROM free),
 rep AS (SELECT a.school_id, a.p, a.s, coalesce(min_by(b.s, length(b.s)), a.s) AS rep FROM stems a LEFT JOIN stems b ON b.school_id = a.school_id AND b.p = a.p AND length(b.s) >= 2 AND starts_with(a.s, b.s) GROUP BY a.school_id, a.p, a.s),
 lone AS (SELECT free.*, rep.rep FROM free JOIN rep ON rep.school_id = free.school_id AND rep.p = free.p AND rep.s = free.s),
 grp AS (SELECT *, first_value(teacher_id) OVER (PARTITION BY school_id, p, rep ORDER BY has_user DESC, refs DESC, length(name), teacher_id) AS keep_id FROM lone),
 plan_ AS (SELECT school_id, teacher_id, CASE WHEN code IS NOT NULL OR has_user OR hard_refs > 0 THEN 'keep' ELSE 'delete' END AS action, CAST(NULL AS BIGINT) AS keep_id,
   CASE WHEN code IS NOT NULL OR has_user THEN 'has a code or login' WHEN hard_refs > 0 THEN 'still used by timetable rows' ELSE 'not a person or a teacher code' END AS reason FROM r WHERE kind = 'garbage'
  UNION ALL SELECT school_id, teacher_id, CASE WHEN teacher_id = keep_id THEN 'primary' ELSE 'merge' END, keep_id, 'same person' FROM ps
  UNION ALL SELECT school_id, teacher_id, 'keep', NULL, 'two teachers share this slot' FROM r WHERE kind = 'code' AND (contains(name, '/') OR regexp_matches(name, '\d\s*,\s*\d'))
  UNION ALL SELECT h.school_id, h.teacher_id, 'merge', k.keep_id, 'code of one person' FROM hold h JOIN (SELECT DISTINCT school_id, person, keep_id FROM ps) k ON k.school_id = h.school_id AND k.person = h.lo WHERE lo = hi
  UNION ALL SELECT school_id, teacher_id, CASE WHEN teacher_id = keep_id THEN 'primary' ELSE 'merge' END, keep_id, CASE WHEN lo IS NOT NULL THEN 'code matches several people' ELSE 'same code' END FROM grp)"""

_TARGETS = """tg AS (SELECT school_id, keep_id, any_value(name) FILTER (teacher_id = keep_id) AS keep_name, any_value(code) FILTER (teacher_id = keep_id) AS keep_code, min_by(pname, (length(pname), teacher_id)) AS final_name,
  coalesce(any_value(code) FILTER (teacher_id = keep_id), min_by(code, teacher_id) FILTER (code IS NOT NULL), min_by(pcode, teacher_id) FILTER (pcode IS NOT NULL)) AS final_code,
  coalesce(any_value(designation) FILTER (teacher_id = keep_id), min_by(designation, teacher_id) FILTER (designation IS NOT NULL), min_by(pdesignation, teacher_id) FILTER (pdesignation IS NOT NULL)) AS final_designation FROM ps GROUP BY ALL)"""
_CODED = "cg AS (SELECT school_id, teacher_id AS keep_id, name AS final_name, coalesce(code, pcode) AS final_code, designation AS final_designation, code IS NULL AS renamed FROM grp WHERE teacher_id = keep_id)"
_ALIASES = """al AS (SELECT DISTINCT a.school_id, a.keep_id, trim(a.alias) AS alias FROM (
  SELECT school_id, keep_id, unnest(string_split(alias_list, ';')) AS alias FROM ps
  UNION ALL SELECT ps.school_id, ps.keep_id, x FROM (SELECT school_id, keep_id, unnest([code, trim(pcode)]) AS x FROM ps) ps JOIN tg USING (school_id, keep_id) WHERE x IS DISTINCT FROM tg.final_code
  UNION ALL SELECT c.school_id, k.keep_id, unnest([c.name, c.pcode]) FROM cs c JOIN hold h USING (school_id, teacher_id) JOIN (SELECT DISTINCT school_id, person, keep_id FROM ps) k ON k.school_id = h.school_id AND k.person = h.lo WHERE h.lo = h.hi
  UNION ALL SELECT school_id, keep_id, unnest(string_split(alias_list, ';')) FROM grp
  UNION ALL SELECT school_id, keep_id, name FROM grp WHERE teacher_id <> keep_id) a
 LEFT JOIN (SELECT school_id, keep_id, final_name FROM tg UNION ALL SELECT school_id, keep_id, final_name FROM cg) n USING (school_id, keep_id) WHERE trim(a.alias) <> '' AND trim(a.alias) IS DISTINCT FROM n.final_name),
 ch AS (SELECT * FROM (SELECT school_id, keep_id, final_name, final_code, final_designation, final_name <> keep_name OR final_code IS DISTINCT FROM keep_code AS renamed FROM tg UNION ALL SELECT * FROM cg) t
  WHERE renamed OR EXISTS (SELECT 1 FROM plan_ p WHERE p.action = 'merge' AND p.school_id = t.school_id AND p.keep_id = t.keep_id))"""


def _directory(t):
    return t.sql(_DIR).withColumn("aliases", F.split("alias_list", ";")).drop("alias_list")


@query("plan_cleanup", f"WITH {_PLAN} SELECT * FROM plan_")
def plan_cleanup(t):
    return C.plan_cleanup(_directory(t))


@query("cleanup_targets", f"WITH {_PLAN}, {_TARGETS} SELECT school_id, keep_id, final_name, final_code, final_designation, final_name <> keep_name OR final_code IS DISTINCT FROM keep_code AS renamed FROM tg")
def cleanup_targets(t):
    return C.cleanup_targets(_directory(t))


@query("cleanup_aliases", f"WITH {_PLAN}, {_TARGETS}, {_CODED}, {_ALIASES} SELECT * FROM al")
def cleanup_aliases(t):
    rows = _directory(t)
    return C.cleanup_aliases(rows, C.plan_cleanup(rows))


@query("cleanup_codes", f"WITH {_PLAN}, {_CODED} SELECT * FROM cg")
def cleanup_codes(t):
    rows = _directory(t)
    return C.code_targets(rows, C.plan_cleanup(rows))


@query(
    "apply_cleanup_names",
    f"""WITH {_PLAN}, {_TARGETS}, {_CODED}, {_ALIASES}, m AS (SELECT f.school_id, f.seq, coalesce(p.keep_id, f.teacher_id) AS teacher_id, d.name AS teacher_name FROM f_period f LEFT JOIN d ON d.school_id = f.school_id AND d.teacher_id = f.teacher_id
  LEFT JOIN plan_ p ON p.school_id = f.school_id AND p.teacher_id = f.teacher_id AND p.action = 'merge')
 SELECT m.school_id, m.seq, m.teacher_id, coalesce(ch.final_name, m.teacher_name) AS teacher_name FROM m LEFT JOIN ch ON ch.school_id = m.school_id AND ch.keep_id = m.teacher_id""",
)
def apply_cleanup_names(t):
    rows = _directory(t)
    plan = C.plan_cleanup(rows)
    named = t.f_period.join(rows.select("school_id", "teacher_id", F.col("name").alias("teacher_name")), ["school_id", "teacher_id"], "left").select("school_id", "seq", "teacher_id", "teacher_name")
    return C.apply_names(C.apply_to_fact(named, plan), rows, plan)


@query(
    "apply_cleanup_logins",
    f"WITH {_PLAN} SELECT d.school_id, d.teacher_id AS user_id, CASE WHEN p.teacher_id IS NULL THEN d.teacher_id END AS teacher_id FROM d LEFT JOIN plan_ p ON p.school_id = d.school_id AND p.teacher_id = d.teacher_id AND p.action = 'merge'",
)
def apply_cleanup_logins(t):
    rows = _directory(t)
    return C.apply_to_logins(rows.select("school_id", F.col("teacher_id").alias("user_id"), "teacher_id"), C.plan_cleanup(rows))


@query(
    "apply_cleanup_duties",
    f"""WITH {_PLAN}, m AS (SELECT f.duty_id, f.school_id, coalesce(p.keep_id, f.teacher_id) AS teacher_id, f.duty_date, f.duty_type, p.keep_id IS NOT NULL AS moved FROM f_duty f LEFT JOIN plan_ p ON p.school_id = f.school_id AND p.teacher_id = f.teacher_id AND p.action = 'merge')
 SELECT duty_id, school_id, teacher_id, duty_date, duty_type FROM (SELECT *, row_number() OVER (PARTITION BY school_id, teacher_id, duty_date, duty_type ORDER BY moved, duty_id) AS rn FROM m) WHERE NOT moved OR rn = 1""",
)
def apply_cleanup_duties(t):
    plan = C.plan_cleanup(_directory(t))
    out = C.apply_to_fact(t.f_duty, plan, unique=["duty_date", "duty_type"])
    return out.select("duty_id", "school_id", "teacher_id", "duty_date", "duty_type")


@query(
    "apply_cleanup_periods",
    f"WITH {_PLAN} SELECT f.school_id, f.seq, coalesce(p.keep_id, f.teacher_id) AS teacher_id FROM f_period f LEFT JOIN plan_ p ON p.school_id = f.school_id AND p.teacher_id = f.teacher_id AND p.action = 'merge'",
)
def apply_cleanup_periods(t):
    return C.apply_to_fact(t.f_period, C.plan_cleanup(_directory(t))).select("school_id", "seq", "teacher_id")


@query(
    "apply_cleanup_directory",
    f"""WITH {_PLAN}, {_TARGETS}, {_CODED}, {_ALIASES}, w AS (SELECT school_id, keep_id, string_agg(alias, ';' ORDER BY alias) AS words FROM al GROUP BY ALL)
 SELECT d.school_id, d.teacher_id, coalesce(ch.final_name, d.name) AS name, CASE WHEN ch.keep_id IS NULL THEN d.code ELSE ch.final_code END AS code, CASE WHEN ch.keep_id IS NULL THEN d.designation ELSE ch.final_designation END AS designation,
 coalesce(CASE WHEN ch.keep_id IS NULL THEN d.alias_list ELSE w.words END, '') AS aliases
 FROM d JOIN plan_ p USING (school_id, teacher_id) LEFT JOIN ch ON ch.school_id = d.school_id AND ch.keep_id = d.teacher_id LEFT JOIN w ON w.school_id = d.school_id AND w.keep_id = d.teacher_id WHERE p.action NOT IN ('merge', 'delete')""",
)
def apply_cleanup_directory(t):
    rows = _directory(t)
    return C.apply_to_directory(rows, C.plan_cleanup(rows)).withColumn("aliases", F.array_join("aliases", ";"))


# ---------------------------------------------------------------- learning

_NEW = "SELECT school_id, seq, raw_text AS raw FROM f_name_text"
_NEWMAP = "SELECT DISTINCT school_id, raw_text AS raw, 'NEW' AS target FROM f_name_text"


@query(
    "create_people",
    f"""WITH {resolved_cte(_NEW)}, n AS (SELECT x.school_id, x.seq, trim(x.raw) AS raw FROM ({_NEW}) x JOIN resolved r ON r.school_id = x.school_id AND r.raw = trim(x.raw) AND r.teacher_id IS NULL),
 p AS (SELECT n.*, c.kind, c.pname, c.pcode, c.pdesignation, {S.key('c.pname')} AS key FROM n JOIN c ON c.raw = n.raw WHERE c.kind <> 'garbage')
 SELECT school_id, pname AS name, pcode AS code, pdesignation AS designation, key FROM p QUALIFY row_number() OVER (PARTITION BY school_id, key ORDER BY seq, raw) = 1""",
)
def create_people(t):
    names = t.sql(_NEW).withColumn("raw", F.trim("raw"))
    resolved = I.resolve_names(names, people(t), t.sql(_NEWMAP))
    return C.create_people(names, resolved)


@query(
    "learn_aliases",
    f"""WITH {_RESOLVE}, a AS (SELECT DISTINCT m.school_id, m.raw, r.teacher_id, {S.key('m.raw')} AS k FROM f_mapping m JOIN resolved r ON r.school_id = m.school_id AND r.raw = m.raw WHERE m.target <> 'NEW' AND r.teacher_id IS NOT NULL),
 kn AS (SELECT DISTINCT school_id, teacher_id, {S.key('w')} AS k FROM (SELECT school_id, teacher_id, unnest([name, code] || string_split(alias_list, ';')) AS w FROM f_teacher))
 SELECT a.school_id, a.teacher_id, a.raw AS alias FROM a WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.school_id = a.school_id AND kn.teacher_id = a.teacher_id AND kn.k = a.k)
 QUALIFY row_number() OVER (PARTITION BY a.school_id, a.teacher_id, a.k ORDER BY a.raw) = 1""",
)
def learn_aliases(t):
    return C.learn_aliases(t.f_mapping, _resolved(t), people(t))


_BARE = "SELECT school_id, teacher_id, name, CASE WHEN teacher_id % 2 = 0 THEN code END AS code, designation FROM f_teacher"
_PRINTED = "SELECT school_id, teacher_id, duty_id AS seq, CASE WHEN duty_id % 3 = 0 THEN NULL WHEN duty_id % 3 = 1 THEN 'TGT-ART' ELSE 'Nurse' END AS designation FROM f_duty"


@query(
    "learn_titles",
    f"""SELECT t.school_id, t.teacher_id, t.name, coalesce(t.code, x.c) AS code, coalesce(t.designation, x.d) AS designation FROM ({_BARE}) t LEFT JOIN (SELECT school_id, teacher_id,
 min_by(designation, seq) FILTER (designation = 'TGT-ART') AS c, min_by(designation, seq) FILTER (designation = 'Nurse') AS d FROM ({_PRINTED}) GROUP BY ALL) x USING (school_id, teacher_id)""",
)
def learn_titles(t):
    return C.learn_titles(t.sql(_PRINTED), t.sql(_BARE))
