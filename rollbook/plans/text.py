"""Registered text, HTML, JSON and calendar jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.functions import clock as K
from rollbook.operators import text_jobs as T
from rollbook.plans import sqltext as S
from rollbook.plans.conflicts import _DIFF, _diff
from rollbook.plans.reads import _FREE, week
from rollbook.plans.registry import query
from rollbook.operators.timeline import free_minutes

_ROMAN = "['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII']"
_DAYS = "['MONDAY','TUESDAY','WEDNESDAY','THURSDAY','FRIDAY','SATURDAY','SUNDAY']"
_DAYNAMES = "['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday']"


def _class(x: str) -> str:
    return f"""(SELECT CASE WHEN list_contains({_ROMAN}, s) THEN s WHEN regexp_matches(s, '^[0-9]{{1,2}}$') THEN {_ROMAN}[CAST(s AS INT)]
 WHEN regexp_matches(s, '^[VXIL1|]+$') AND list_contains({_ROMAN}, regexp_replace(s, '[L1|]', 'I', 'g')) THEN regexp_replace(s, '[L1|]', 'I', 'g') END
 FROM (SELECT regexp_replace(regexp_replace(regexp_replace(upper({x}), '\\bCLASS(ES)?\\b', '', 'g'), '[^A-Z0-9|]', '', 'g'), '(ST|ND|RD|TH)$', '') AS s))"""


def _day(x: str) -> str:
    return f"""CASE left(regexp_replace(upper({x}), '[^A-Z]', '', 'g'), 3) WHEN 'MON' THEN 'MONDAY' WHEN 'TUE' THEN 'TUESDAY' WHEN 'WED' THEN 'WEDNESDAY' WHEN 'THU' THEN 'THURSDAY'
 WHEN 'FRI' THEN 'FRIDAY' WHEN 'SAT' THEN 'SATURDAY' WHEN 'SUN' THEN 'SUNDAY' END"""


def _hhmm(m: str) -> str:
    return f"lpad(CAST(({m}) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({m}) % 60 AS VARCHAR), 2, '0')"


@query(
    "normalize_periods",
    f"""WITH p AS (SELECT *, CAST(string_split(split_part(time_text, '-', 1), ':')[1] AS INT) AS h1, CAST(string_split(split_part(time_text, '-', 1), ':')[2] AS INT) AS m1,
  CAST(string_split(split_part(time_text, '-', 2), ':')[1] AS INT) AS h2, CAST(string_split(split_part(time_text, '-', 2), ':')[2] AS INT) AS m2 FROM f_printed),
 q AS (SELECT *, 60 * (CASE WHEN h1 BETWEEN 1 AND 5 THEN h1 + 12 ELSE h1 END) + m1 AS a, 60 * (CASE WHEN h2 BETWEEN 1 AND 5 THEN h2 + 12 ELSE h2 END) + m2 AS b FROM p),
 r AS (SELECT *, {_class('class_text')} AS class_name, CASE WHEN b <= a AND b < 720 THEN b + 720 ELSE b END AS e FROM q)
 SELECT school_id, seq, class_name, CAST(list_position({_ROMAN}, class_name) AS INTEGER) AS class_rank, upper(regexp_replace(section_text, '[^A-Za-z]', '', 'g')) AS section, {_day('day_text')} AS day,
 label_text AS label, label_text = 'Short Break' AS is_break, CASE label_text WHEN '1st' THEN 1 WHEN 'II' THEN 2 WHEN 'Period-3' THEN 3 WHEN 'P.5' THEN 5 WHEN 'sixth' THEN 6 WHEN '7' THEN 7 END AS period_number,
 {_hhmm('a')} AS start_time, {_hhmm('e')} AS end_time, a AS start_min, e AS end_min FROM r""",
)
def normalize_periods(t):
    return T.normalize_periods(t.f_printed)


_NUM = r"\b(\d{1,2})\s*[/.\-]\s*(\d{1,2})\s*[/.\-]\s*(\d{2,4})\b"
_WORD = r"\b(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})\.?,?\s*(\d{4})?\b"
_TIME = r"\d{1,2}\s*[:.;]\s*\d{2}\s*(?:am|pm)?"
_RANGE = rf"({_TIME})\s*(?:-|–|—|to)\s*({_TIME})"


def _clock_sql(x: str) -> str:
    """Minutes of a printed clock, null when it is none."""
    p = r"^(\d{1,2})\s*[:.;]\s*(\d{2})\s*(am|pm)?$"
    return f"""(SELECT CASE WHEN h <= 23 AND m <= 59 THEN 60 * (CASE WHEN z = 'pm' AND h < 12 THEN h + 12 WHEN z = 'am' AND h = 12 THEN 0 WHEN z = '' AND h BETWEEN 1 AND 5 THEN h + 12 ELSE h END) + m END
 FROM (SELECT TRY_CAST(regexp_extract(trim({x}), '{p}', 1, 'i') AS INT) AS h, TRY_CAST(regexp_extract(trim({x}), '{p}', 2, 'i') AS INT) AS m, lower(regexp_extract(trim({x}), '{p}', 3, 'i')) AS z))"""


_MON = "CASE lower(left(mw, 3)) " + " ".join(f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())) + " END"


@query(
    "extract_times_dates",
    f"""WITH a AS (SELECT notice_id, notice_text AS x, regexp_extract(notice_text, '{_NUM}', 1) AS nd, regexp_extract(notice_text, '{_NUM}', 2) AS nm, regexp_extract(notice_text, '{_NUM}', 3) AS ny,
  regexp_extract(notice_text, '{_WORD}', 1) AS wd, regexp_extract(notice_text, '{_WORD}', 2) AS mw, regexp_extract(notice_text, '{_WORD}', 3) AS wy,
  regexp_extract(notice_text, '{_RANGE}', 1, 'i') AS t1, regexp_extract(notice_text, '{_RANGE}', 2, 'i') AS t2,
  regexp_extract(notice_text, '\\b(20\\d{{2}})\\s*[-–/]\\s*(\\d{{2,4}})\\b', 1) AS s1, regexp_extract(notice_text, '\\b(20\\d{{2}})\\s*[-–/]\\s*(\\d{{2,4}})\\b', 2) AS s2,
  regexp_extract(notice_text, '\\b(MON|TUE|TUES|WED|WEDS|THU|THUR|THURS|FRI|SAT|SUN)(DAY|SDAY|NESDAY|RSDAY|URDAY)?\\b', 0, 'i') AS dw FROM f_notice_text),
 b AS (SELECT *, {_clock_sql('t1')} AS a, {_clock_sql('t2')} AS b, CASE WHEN nd <> '' THEN CAST(nd AS INT) ELSE TRY_CAST(wd AS INT) END AS d, CASE WHEN nd <> '' THEN CAST(nm AS INT) ELSE {_MON} END AS mo,
  CASE WHEN nd <> '' THEN CASE WHEN CAST(ny AS INT) < 100 THEN CAST(ny AS INT) + 2000 ELSE CAST(ny AS INT) END ELSE coalesce(TRY_CAST(wy AS INT), 2020) END AS y FROM a)
 SELECT notice_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN {_hhmm('a')} END AS start_time, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN {_hhmm('CASE WHEN b <= a AND b < 720 THEN b + 720 ELSE b END')} END AS end_time,
 CASE WHEN y BETWEEN 2000 AND 2100 AND mo BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 THEN TRY_CAST(lpad(CAST(y AS VARCHAR), 4, '0') || '-' || lpad(CAST(mo AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE) END AS found_date,
 CASE WHEN s1 <> '' THEN s1 || '-' || right(s2, 2) END AS session, {_day('dw')} AS day FROM b""",
)
def extract_times_dates(t):
    return T.extract_times_dates(t.f_notice_text, "notice_text", ["notice_id"], 2020)


@query(
    "classify_people",
    f"WITH {S.classified('c', 'f_name_text', 'raw_text')} SELECT n.school_id, n.seq, c.kind, c.pname AS name, c.pcode AS code, c.pdesignation AS designation FROM f_name_text n JOIN c ON n.raw_text = c.raw",
)
def classify_people(t):
    return T.classify_people(t.f_name_text, "raw_text", ["school_id", "seq"])


@query(
    "match_keys",
    f"""SELECT school_id, seq, {S.key('raw_text')} AS match_key, {S.person_key('raw_text')} AS person_key, {S.prefix('raw_text')} AS prefix, {S.stem('raw_text')} AS stem,
 {S.fold('raw_text')} AS look_alike FROM f_name_text""",
)
def match_keys(t):
    return T.match_keys(t.f_name_text, "raw_text", ["school_id", "seq"])


@query("clean_cells", f"SELECT doc_id, pos, {S.cell('line')} AS cell, {S.serial('line')} AS unnumbered, {S.code('line')} AS as_code FROM f_line")
def clean_cells(t):
    return T.clean_cells(t.f_line, "line", ["doc_id", "pos"])


def _clock12(m: str) -> str:
    return f"CAST(CASE WHEN ({m}) // 60 % 12 = 0 THEN 12 ELSE ({m}) // 60 % 12 END AS VARCHAR) || ':' || lpad(CAST(({m}) % 60 AS VARCHAR), 2, '0') || CASE WHEN ({m}) >= 720 THEN ' PM' ELSE ' AM' END"


@query(
    "display_periods",
    f"""SELECT school_id, seq, {_clock12('start_min')} || ' - ' || {_clock12('end_min')} AS time_label,
 CAST(line_key % 130 AS VARCHAR) || CASE WHEN line_key % 130 % 100 BETWEEN 11 AND 13 THEN 'th' WHEN line_key % 10 = 1 THEN 'st' WHEN line_key % 10 = 2 THEN 'nd' WHEN line_key % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal,
 CASE WHEN section <> '' THEN class_name || '-' || section ELSE class_name END AS class_label, {_DAYNAMES}[day_idx + 1] AS day_label,
 CASE WHEN start_min < 720 THEN 'Good Morning' WHEN start_min < 1020 THEN 'Good Afternoon' ELSE 'Good Evening' END AS greeting FROM f_period""",
)
def display_periods(t):
    return t.f_period.select(
        "school_id", "seq", K.range12(F.col("start_min"), F.col("end_min")).alias("time_label"), K.ordinal(F.col("line_key") % 130).alias("ordinal"),
        K.class_label(F.col("class_name"), F.col("section")).alias("class_label"), K.day_label(F.col("day_idx")).alias("day_label"),
        K.greeting(F.col("start_min")).alias("greeting"),
    )


@query(
    "display_documents",
    """SELECT doc_id, CASE WHEN size_bytes < 1024 THEN CAST(size_bytes AS VARCHAR) || ' B' WHEN size_bytes < 1048576 THEN CAST(CAST(round(size_bytes / 1024, 0) AS BIGINT) AS VARCHAR) || ' KB' ELSE '?' END AS size_label,
 CAST(day(created_on) AS VARCHAR) || strftime(created_on, ' %B %Y') AS long_date, strftime(created_on, '%d %b %Y') AS short_date FROM f_doc""",
)
def display_documents(t):
    return t.f_doc.select(
        "doc_id", K.format_bytes(F.col("size_bytes")).alias("size_label"), K.long_date(F.col("created_on")).alias("long_date"), K.short_date(F.col("created_on")).alias("short_date")
    )


@query(
    "display_free_time",
    f"""WITH {_FREE} SELECT school_id, teacher_id, CASE WHEN free_minutes <= 0 THEN '-' WHEN free_minutes >= 60 AND free_minutes % 60 > 0 THEN (free_minutes // 60) || 'h ' || (free_minutes % 60) || 'm'
 WHEN free_minutes >= 60 THEN (free_minutes // 60) || 'h' ELSE (free_minutes % 60) || 'm' END AS free_time FROM free""",
)
def display_free_time(t):
    return free_minutes(week(t)).select("school_id", "teacher_id", K.format_minutes(F.col("free_minutes")).alias("free_time"))


def _side(p: str) -> str:
    return f"coalesce(nullif({p}_subject, ''), '(no subject)') || ' · ' || coalesce(CAST({p}_teacher_id AS VARCHAR), '(no teacher)') || ' · ' || {_clock12(p + '_start_min')} || ' - ' || {_clock12(p + '_end_min')}"


@query(
    "describe_changes",
    f"""WITH {_DIFF} SELECT school_id, class_name, section, day_idx, slot, kind, {_DAYNAMES}[day_idx + 1] || ' - Class ' || CASE WHEN section <> '' THEN class_name || '-' || section ELSE class_name END AS place,
 CASE WHEN kind <> 'added' THEN {_side('before')} END AS "before", CASE WHEN kind <> 'removed' THEN {_side('after')} END AS "after" FROM diff""",
)
def describe_changes(t):
    return T.describe_changes(_diff(t))


def _named_side(p: str) -> str:
    return f"coalesce(nullif({p}_subject, ''), '(no subject)') || ' · ' || coalesce(nullif({p[0]}.name, ''), '(no teacher)') || ' · ' || {_clock12(p + '_start_min')} || ' - ' || {_clock12(p + '_end_min')}"


@query(
    "describe_named_changes",
    f"""WITH {_DIFF} SELECT d.school_id, class_name, section, day_idx, slot, kind, {_DAYNAMES}[day_idx + 1] || ' - Class ' || CASE WHEN section <> '' THEN class_name || '-' || section ELSE class_name END AS place,
 CASE WHEN kind <> 'added' THEN {_named_side('before')} END AS "before", CASE WHEN kind <> 'removed' THEN {_named_side('after')} END AS "after" FROM diff d
 LEFT JOIN f_teacher b ON b.school_id = d.school_id AND b.teacher_id = d.before_teacher_id LEFT JOIN f_teacher a ON a.school_id = d.school_id AND a.teacher_id = d.after_teacher_id""",
)
def describe_named_changes(t):
    return T.describe_changes(_diff(t), teachers=t.f_teacher)


@query(
    "split_lists",
    """SELECT club_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(activities_text, ';'), lambda x: trim(x)), lambda x: length(x) > 1))), '|') AS items
 FROM f_club""",
)
def split_lists(t):
    return t.f_club.select("club_id", F.array_join(F.array_sort(T.split_list(F.col("activities_text"))), "|").alias("items"))


@query("settings_lists", "SELECT club_id, array_to_string(list_sort(list_distinct(list_transform(string_split(activities_text, ';'), lambda x: upper(trim(x))))), '|') AS items FROM f_club")
def settings_lists(t):
    return t.f_club.select("club_id", F.array_join(F.array_sort(T.settings_list(F.split("activities_text", ";"))), "|").alias("items"))


@query(
    "cross_check",
    f"""WITH h AS (SELECT doc_id, ' ' || {S.key('text')} || ' ' AS hay FROM documents), r AS (SELECT *, {S.key('name')} AS k FROM f_line_record)
 SELECT r.doc_id, r.pos, CASE WHEN confidence IS NULL THEN NULL WHEN length(trim(hay)) < 20 THEN CAST(confidence AS DOUBLE) WHEN name = '' OR length(k) < 2 OR contains(hay, k)
  OR (len(list_filter(string_split(k, ' '), lambda w: length(w) >= 3)) > 0 AND len(list_filter(string_split(k, ' '), lambda w: length(w) >= 3 AND NOT contains(hay, w))) = 0)
  THEN round(CAST(confidence AS DOUBLE), 2) ELSE round(CAST(confidence AS DOUBLE) * 0.75, 2) END AS confidence FROM r JOIN h USING (doc_id)""",
)
def cross_check(t):
    records = t.f_line_record.withColumn("confidence", F.col("confidence").cast("double"))
    return T.cross_check(records, t.documents, "doc_id", ["name"]).select("doc_id", "pos", "confidence")


_ENT = "c"
for _e, _c in T.ENTITIES:
    _ENT = f"replace({_ENT}, '{_e}', '{_c if _c != chr(39) else chr(39) * 2}')"


@query(
    "html_lines",
    rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<br\s*/?>', chr(10), 'gi'), '</(p|li|h\d)>', chr(10), 'gi'), '<[^>]+>', '', 'g') AS c FROM pages),
 b AS (SELECT page_id, list_filter(list_transform(string_split({_ENT}, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ls FROM a)
 SELECT page_id, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no FROM b""",
)
def html_lines(t):
    return T.html_lines(t.pages)


@query("json_columns", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS k_untyped FROM f_activity")
def json_columns(t):
    c = F.col("props")
    return t.f_activity.select("event_id", T.typed_json(c, "k INT")["k"].alias("k"), T.json_field(c, "$.k", "bigint").alias("k_untyped"))


@query(
    "calendar",
    """WITH s AS (SELECT school_id, CAST(unnest(generate_series(min(duty_date), max(duty_date), INTERVAL 1 DAY)) AS DATE) AS day FROM f_duty GROUP BY school_id),
 h AS (SELECT DISTINCT school_id, duty_date AS day, true AS listed FROM f_duty WHERE duty_type = 'HOLIDAY')
 SELECT school_id, day, CAST(isodow(day) - 1 AS INTEGER) AS day_idx, CAST(date_trunc('week', day) AS DATE) AS monday, isodow(day) = 7 OR coalesce(listed, false) AS is_holiday, CAST(day - INTERVAL 6 MONTH AS DATE) AS six_months_back
 FROM s LEFT JOIN h USING (school_id, day)""",
)
def calendar(t):
    spans = t.f_duty.groupBy("school_id").agg(F.min("duty_date").alias("start"), F.max("duty_date").alias("end"))
    holidays = t.f_duty.filter("duty_type = 'HOLIDAY'").select("school_id", F.col("duty_date").alias("day"))
    return T.calendar(spans, holidays)


_CLK = "CASE WHEN regexp_matches({0}, '^([01][0-9]|2[0-3]):[0-5][0-9]$') THEN {0} END AS {0}"


@query(
    "sanitize_periods",
    f"""WITH a AS (SELECT *, {_class('class_name')} AS cn, {_day("CASE WHEN day = 'Someday' THEN '' ELSE day END")} AS dn FROM f_raw_period)
 SELECT school_id, draft_id, seq, cn AS class_name, upper(regexp_replace(section, '[^A-Za-z]', '', 'g')) AS section, dn AS day, slot, CASE WHEN NOT is_break THEN period_number END AS period_number, is_break,
 CASE WHEN is_break THEN coalesce(nullif(label, ''), 'BREAK') END AS label, {_CLK.format('start_time')}, {_CLK.format('end_time')}, CASE WHEN is_break THEN '' ELSE subject END AS subject,
 CASE WHEN is_break THEN '' ELSE teacher_name END AS teacher_name, coalesce(CASE WHEN confidence > 1 THEN 1.0 WHEN confidence < 0 THEN 0.0 ELSE CAST(confidence AS DOUBLE) END, 0.5) AS confidence
 FROM a WHERE cn IS NOT NULL AND dn IS NOT NULL""",
)
def sanitize_periods(t):
    return T.sanitize_periods(t.f_raw_period.withColumn("confidence", F.col("confidence").cast("double")), ["school_id", "draft_id", "seq"])


@query(
    "sanitize_remedial",
    f"""SELECT school_id, draft_id, seq, CASE WHEN category IN ('REMEDIAL', 'LIFE_SKILL', 'ENRICHMENT', 'OTHER') THEN category ELSE 'REMEDIAL' END AS category, coalesce({_class('class_name')}, class_name) AS class_name, section,
 {_day('day')} AS day, {_CLK.format('start_time')}, {_CLK.format('end_time')}, activity, teacher_name, coalesce(CAST(confidence AS DOUBLE), 0.5) AS confidence FROM f_raw_remedial""",
)
def sanitize_remedial(t):
    return T.sanitize_remedial(t.f_raw_remedial, ["school_id", "draft_id", "seq"])


@query(
    "sanitize_duties",
    "SELECT school_id, draft_id, seq, duty_date, teacher_name, coalesce(description, '') AS description, coalesce(CAST(confidence AS DOUBLE), 0.5) AS confidence FROM f_raw_duty WHERE duty_date <> 'next week' AND trim(teacher_name) <> ''",
)
def sanitize_duties(t):
    return T.sanitize_duties(t.f_raw_duty.withColumn("confidence", F.col("confidence").cast("double")), ["school_id", "draft_id", "seq"])


@query(
    "merge_pages",
    """SELECT doc_id, arg_min(lang, pos) FILTER (pos % 2 = 1) AS session, arg_min(line, pos) FILTER (line <> '') AS title, count(*) AS pages
 FROM (SELECT l.*, d.lang FROM f_line l JOIN documents d USING (doc_id)) GROUP BY doc_id""",
)
def merge_pages(t):
    parts = t.f_line.join(t.documents.select("doc_id", "lang"), "doc_id")
    parts = parts.select("doc_id", "pos", F.when(F.col("pos") % 2 == 1, F.col("lang")).otherwise(F.lit("")).alias("session"), F.col("line").alias("title"))
    return T.merge_pages(parts, "doc_id", "pos")
