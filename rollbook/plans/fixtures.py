"""School views over the driver tables.

Each view is one SELECT that Spark and DuckDB both run (two texts only where list syntax differs),
so a registered query and its check start from equal rows. Schools are nations; every view keeps all
rows of the table it reads unless its meaning selects some (a weekly off, a remedial class).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from rollbook.sources.tables import BASE_SCHEMAS, load_base

# seq: unique, needs no per-school window. Rows of one order line number are told apart by content.
_SEQ = (
    "(l_orderkey * 8 + l_linenumber) * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber"
    " ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)"
)
_CLASS = (
    "CASE l_partkey % 7 WHEN 0 THEN 'VI' WHEN 1 THEN 'VII' WHEN 2 THEN 'VIII' WHEN 3 THEN 'IX'"
    " WHEN 4 THEN 'X' WHEN 5 THEN 'XI' ELSE 'XII' END"
)
_SUBJECT = (
    "CASE l_orderkey % 5 WHEN 0 THEN 'Maths' WHEN 1 THEN 'English' WHEN 2 THEN 'Science' WHEN 3 THEN 'Hindi' ELSE '' END"
)


def _hhmm(minutes: str) -> str:
    return (
        f"lpad(CAST(CAST(floor(({minutes}) / 60) AS INT) AS STRING), 2, '0') || ':' || "
        f"lpad(CAST(CAST(({minutes}) % 60 AS INT) AS STRING), 2, '0')"
    )


VIEWS: dict[str, str] = {}

VIEWS["f_teacher"] = """
SELECT c_custkey AS teacher_id, c_nationkey AS school_id,
 CASE WHEN c_custkey % 2 = 0 THEN 'Mr. ' ELSE 'Mrs. ' END ||
 CASE c_custkey % 5 WHEN 0 THEN 'Anil' WHEN 1 THEN 'Bina' WHEN 2 THEN 'Chandan' WHEN 3 THEN 'Deepa' ELSE 'Eshan' END || ' ' ||
 CASE c_custkey % 7 WHEN 0 THEN 'Kumar' WHEN 1 THEN 'Devi' WHEN 2 THEN 'Roy' WHEN 3 THEN 'Singh' WHEN 4 THEN 'Khan' WHEN 5 THEN 'Ali' ELSE 'Das' END AS name,
 CASE WHEN c_custkey % 2 = 0 THEN 'TGT-' ELSE 'PGT-' END ||
 CASE c_custkey % 6 WHEN 0 THEN 'MATH' WHEN 1 THEN 'ENG' WHEN 2 THEN 'SCI' WHEN 3 THEN 'HIN' WHEN 4 THEN 'S.SC' ELSE 'CS' END AS code,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'Warden' WHEN 'MACHINERY' THEN 'Librarian' END AS designation,
 c_name || ';' || CASE WHEN c_custkey % 3 = 0 THEN 'A. ' || c_mktsegment ELSE 'B. ' || c_mktsegment END AS alias_list,
 c_acctbal > 0 AS active FROM customer
"""

VIEWS["f_user"] = """
SELECT teacher_id + 1000000 AS user_id, school_id, teacher_id,
 lower(replace(substr(name, instr(name, ' ') + 1), ' ', '.')) ||
 CASE WHEN teacher_id % 13 = 0 THEN '' ELSE CAST(teacher_id % 13 + 1 AS STRING) END AS username
 FROM f_teacher WHERE designation = 'Librarian'
"""

VIEWS["f_period"] = f"""
SELECT c_nationkey AS school_id, CAST({_SEQ} AS BIGINT) AS seq, l_orderkey AS line_key,
 CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS version, {_CLASS} AS class_name,
 CASE l_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE '' END AS section,
 CAST(l_suppkey % 6 AS INT) AS day_idx, CAST(l_linenumber - 1 AS INT) AS slot, l_linenumber = 4 AS is_break,
 CASE WHEN l_linenumber <> 4 THEN CAST(l_linenumber AS INT) END AS period_number,
 CASE WHEN l_linenumber = 4 THEN 'Recess' END AS label, {_SUBJECT} AS subject,
 CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS teacher_id,
 CASE WHEN l_orderkey % 50 = 0 THEN 'Visiting faculty' ELSE 'T' || CAST(o_custkey AS STRING) END AS printed_teacher,
 CAST(495 + 40 * (l_linenumber - 1) + 5 * (l_partkey % 3) AS INT) AS start_min,
 CAST(535 + 40 * (l_linenumber - 1) + 5 * (l_suppkey % 3) AS INT) AS end_min,
 1 - 4 * l_discount AS confidence
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
"""

# A school publishes a new timetable version with each month of orders; the newest months are scheduled.
VIEWS["f_routine"] = """
SELECT school_id, version, CAST(min(day) AS DATE) AS effective_from, CAST(min(day) AS DATE) AS published_on,
 CASE WHEN version < 110 AND version % 4 <> 3 THEN CAST(max(day) AS DATE) END AS archived_on,
 CASE WHEN version < 110 THEN 'ARCHIVED' WHEN version = 110 THEN 'ACTIVE' ELSE 'SCHEDULED' END AS status
 FROM (SELECT c_nationkey AS school_id, CAST(o_orderdate AS DATE) AS day,
 CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS INT) AS version FROM orders JOIN customer ON o_custkey = c_custkey) d
 GROUP BY school_id, version
"""

VIEWS["f_duty"] = """
SELECT o_orderkey AS duty_id, c_nationkey AS school_id, o_custkey AS teacher_id, CAST(o_orderdate AS DATE) AS duty_date,
 CASE WHEN o_orderstatus = 'F' THEN 'HOLIDAY' ELSE 'MOD' END AS duty_type,
 CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 7 AS INT) END AS off_date
 FROM orders JOIN customer ON o_custkey = c_custkey
"""

VIEWS["f_weekly_off"] = """
SELECT c_custkey AS teacher_id, c_nationkey AS school_id, CAST(c_custkey % 6 AS INT) AS day_idx FROM customer WHERE c_mktsegment <> 'FURNITURE'
"""

VIEWS["f_remedial"] = f"""
SELECT c_nationkey AS school_id, CAST({_SEQ} AS BIGINT) AS seq, o_custkey AS teacher_id, {_CLASS} AS class_name,
 CASE l_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END AS section,
 CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE CAST(l_suppkey % 6 AS INT) END AS day_idx, {_SUBJECT} AS activity,
 CAST(720 + 45 * (l_partkey % 3) AS INT) AS start_min, CAST(765 + 45 * (l_partkey % 3) AS INT) AS end_min,
 l_returnflag <> 'R' AS active, 1 - 5 * l_discount AS confidence
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_linenumber = 7
"""

VIEWS["f_notice"] = """
SELECT o_orderkey AS notice_id, c_nationkey AS school_id, CAST(o_orderdate AS DATE) AS notice_date,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'URGENT' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'NORMAL' WHEN '4' THEN 'NORMAL' ELSE 'LOW' END AS priority,
 'Notice ' || CAST(o_orderkey AS STRING) || ' for ' || c_mktsegment AS title, o_orderstatus = 'F' AS archived,
 CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_orderkey / 15) AS BIGINT) END AS doc_id
 FROM orders JOIN customer ON o_custkey = c_custkey
"""

VIEWS["f_doc"] = """
SELECT doc_id, CAST(doc_id % 25 AS INT) AS school_id, source, n_chars AS size_bytes, text, lang,
 CASE doc_id % 5 WHEN 0 THEN 'ROUTINE' WHEN 1 THEN 'REMEDIAL' WHEN 2 THEN 'CLUB' WHEN 3 THEN 'NOTICE' ELSE 'OTHER' END AS kind,
 CASE doc_id % 7 WHEN 0 THEN 'REVIEW' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'CANCELLED' WHEN 3 THEN 'QUEUED' ELSE 'PUBLISHED' END AS extraction_status,
 CASE WHEN lang = 'en' THEN 'application/pdf' WHEN lang = 'fr' THEN 'application/x-generated' ELSE 'image/png' END AS mime,
 doc_id % 9 = 0 AS archived, DATE '2023-01-01' + CAST(doc_id % 730 AS INT) AS created_on,
 DATE '2023-01-01' + CAST(doc_id % 730 + doc_id % 11 AS INT) AS updated_on FROM documents
"""

# Which documents a timetable, schedule or club list came from.
VIEWS["f_doc_link"] = """
SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'ARCHIVED' WHEN source = 'src2' THEN 'ACTIVE' WHEN source = 'src3' THEN 'SCHEDULED' END AS routine_status,
 n_chars % 3 = 0 AS has_schedule, n_chars % 6 = 0 AS schedule_active FROM documents
"""

VIEWS["f_activity"] = """
SELECT event_id, ts AS created_at, CAST(user_id % 25 AS INT) AS school_id, user_id AS actor_id, event_type AS entity_type, value, props FROM events
"""

VIEWS["f_login"] = """
SELECT event_id, ts, user_id, user_id % 20 AS ip_id, event_type = 'error' AS failed FROM events
"""

VIEWS["f_club"] = """
SELECT p_partkey AS club_id, CAST(p_partkey % 25 AS INT) AS school_id, p_brand AS name, replace(p_name, ' ', '; ') || '; ' || p_type AS activities_text,
 p_size > 10 AS active, p_retailprice / 2000 AS confidence FROM part
"""

VIEWS["f_raw_name"] = """
SELECT teacher_id AS seq, school_id, CASE teacher_id % 6 WHEN 0 THEN name WHEN 1 THEN CAST(teacher_id % 90 + 1 AS STRING) || ' ' || name || ' ' || code
 WHEN 2 THEN name || ', ' || code WHEN 3 THEN code WHEN 4 THEN replace(code, 'S', '5') ELSE 'Ref. No ' || CAST(teacher_id AS STRING) END AS raw FROM f_teacher
"""

# Answers of the reviewer: create, same as another printed name, or a directory id.
VIEWS["f_mapping"] = """
SELECT school_id, 'Ref. No ' || CAST(teacher_id AS STRING) AS raw,
 CASE WHEN teacher_id % 4 = 0 THEN 'NEW' WHEN teacher_id % 4 = 1 THEN 'SAME:Alias ' || CAST(teacher_id AS STRING) WHEN teacher_id % 4 = 2 THEN CAST(teacher_id AS STRING)
 ELSE 'SAME:' || name END AS target FROM f_teacher
UNION ALL
SELECT school_id, 'Alias ' || CAST(teacher_id AS STRING) AS raw,
 CASE WHEN teacher_id % 3 = 0 THEN 'SAME:' || name || ', ' || code ELSE CAST(teacher_id AS STRING) END AS target FROM f_teacher
"""

VIEWS["f_printed"] = """
SELECT school_id, seq, 'Class ' || CASE class_name WHEN 'VI' THEN '6' WHEN 'VII' THEN '7th' WHEN 'VIII' THEN 'Vill' ELSE lower(class_name) END AS class_text,
 CASE section WHEN '' THEN '' ELSE '(' || lower(section) || ')' END AS section_text,
 CASE day_idx WHEN 0 THEN 'Mon' WHEN 1 THEN 'TUES.' WHEN 2 THEN 'wed' WHEN 3 THEN 'Thurs' WHEN 4 THEN 'Friday' ELSE 'SAT' END AS day_text,
 CASE slot WHEN 0 THEN '1st' WHEN 1 THEN 'II' WHEN 2 THEN 'Period-3' WHEN 3 THEN 'Short Break' WHEN 4 THEN 'P.5' WHEN 5 THEN 'sixth' ELSE '7' END AS label_text,
 CAST(CASE WHEN start_min >= 780 THEN floor(start_min / 60) - 12 ELSE floor(start_min / 60) END AS INT) || ':' || lpad(CAST(start_min % 60 AS STRING), 2, '0') || '-' ||
 CAST(CASE WHEN end_min >= 780 THEN floor(end_min / 60) - 12 ELSE floor(end_min / 60) END AS INT) || ':' || lpad(CAST(end_min % 60 AS STRING), 2, '0') AS time_text FROM f_period
"""

# Unreviewed drafts: one per school and version, with the misprints the rules look for.
VIEWS["f_draft_period"] = f"""
SELECT school_id, version AS draft_id, seq, class_text AS class_name, section, day_idx, slot, is_break, period_number, start_time, end_time, subject, teacher_name, confidence
FROM (SELECT p.school_id, p.version, p.seq, CASE WHEN line_key % 97 = 0 THEN 'KG' WHEN line_key % 3 = 0 THEN 'Class ' || class_name ELSE class_name END AS class_text,
 CASE WHEN line_key % 101 = 0 THEN 'Q' ELSE section END AS section, p.day_idx, p.slot, p.is_break,
 CASE WHEN line_key % 89 = 0 THEN 13 ELSE period_number END AS period_number,
 CASE WHEN line_key % 83 = 0 THEN NULL WHEN line_key % 79 = 0 THEN '24:75' WHEN line_key % 71 = 0 THEN '04:30' ELSE {_hhmm('start_min')} END AS start_time,
 CASE WHEN line_key % 73 = 0 THEN {_hhmm('start_min')} ELSE {_hhmm('end_min')} END AS end_time, subject,
 CASE WHEN p.teacher_id IS NULL THEN '' WHEN line_key % 47 = 0 THEN 'Time Table Board' WHEN line_key % 43 = 0 THEN t.code || '-' WHEN line_key % 41 = 0 THEN 'Mr. Newcomer Sen'
 WHEN line_key % 37 = 0 THEN 'A1ias ' || CAST(t.teacher_id AS STRING) WHEN line_key % 2 = 0 THEN 'Customer#' || lpad(CAST(t.teacher_id AS STRING), 9, '0') ELSE t.name END AS teacher_name, p.confidence
 FROM f_period p LEFT JOIN f_teacher t ON p.school_id = t.school_id AND p.teacher_id = t.teacher_id) d
"""

VIEWS["f_draft_duty"] = """
SELECT d.school_id, CAST(1 + d.duty_id % 3 AS INT) AS draft_id, d.duty_id AS seq, d.duty_date, d.duty_type, d.off_date,
 CASE WHEN d.duty_id % 53 = 0 THEN '' WHEN d.duty_id % 47 = 0 THEN 'House Duty List' ELSE 'Customer#' || lpad(CAST(d.teacher_id AS STRING), 9, '0') END AS teacher_name,
 t.code AS designation, CASE WHEN d.duty_id % 4 = 0 THEN 0.6 ELSE 0.9 END AS confidence
 FROM f_duty d JOIN f_teacher t ON d.school_id = t.school_id AND d.teacher_id = t.teacher_id
"""

VIEWS["f_draft_off"] = """
SELECT school_id, CAST(1 + teacher_id % 3 AS INT) AS draft_id, teacher_id * 2 + pass AS seq, CAST((teacher_id + pass * (teacher_id % 4)) % 6 AS INT) AS day_idx,
 CASE WHEN teacher_id % 31 = 0 THEN '' WHEN teacher_id % 29 = 0 THEN 'Ghost' ELSE 'Customer#' || lpad(CAST(teacher_id AS STRING), 9, '0') END AS teacher_name,
 CASE WHEN teacher_id % 5 = 0 THEN 0.7 WHEN teacher_id % 5 = 1 THEN NULL ELSE 0.95 END AS confidence
 FROM (SELECT teacher_id, school_id, 0 AS pass FROM f_teacher UNION ALL SELECT teacher_id, school_id, 1 AS pass FROM f_teacher) passes
"""

VIEWS["f_draft_remedial"] = f"""
SELECT r.school_id, CAST(1 + r.seq % 3 AS INT) AS draft_id, r.seq, CASE WHEN r.seq % 23 = 0 THEN 'Nursery' ELSE r.class_name END AS class_name, r.section, r.day_idx,
 CASE WHEN r.seq % 19 = 0 THEN NULL ELSE {_hhmm('r.start_min')} END AS start_time, CASE WHEN r.seq % 17 = 0 THEN {_hhmm('r.start_min')} ELSE {_hhmm('r.end_min')} END AS end_time,
 r.activity, CASE WHEN r.seq % 13 = 0 THEN 'Some Helper' ELSE 'Customer#' || lpad(CAST(r.teacher_id AS STRING), 9, '0') END AS teacher_name, r.confidence
 FROM f_remedial r
"""

VIEWS["f_draft_club"] = """
SELECT school_id, CAST(1 + club_id % 3 AS INT) AS draft_id, club_id AS seq, CASE WHEN club_id % 2 = 0 THEN name ELSE upper(name) END AS name, confidence FROM f_club
"""

# Periods as scanned: names as printed (codes, look-alikes, headings) and misread subjects.
VIEWS["f_spelled_period"] = """
SELECT p.school_id, p.version AS draft_id, p.seq, p.is_break, p.class_name, p.section, p.day_idx, p.slot,
 CASE WHEN p.line_key % 29 = 0 THEN replace(p.subject, 'S', '5') WHEN p.line_key % 31 = 0 THEN upper(p.subject) WHEN p.line_key % 17 = 0 THEN p.subject || '.' ELSE p.subject END AS subject,
 CASE WHEN p.line_key % 61 = 0 THEN 'Mr. Ani1 Kumar' WHEN p.line_key % 67 = 0 THEN 'Mrs. Eshann Das' WHEN p.line_key % 59 = 0 THEN 'TGT-MATHS' ELSE r.raw END AS teacher_name, p.confidence
 FROM f_period p JOIN f_raw_name r ON p.school_id = r.school_id AND p.teacher_id = r.seq
"""

# Notices as running text with dates, sessions, times and weekdays in several printed forms.
_YEAR = "(year(o_orderdate) + 20)"
_MONTH = (
    "CASE month(o_orderdate) WHEN 1 THEN 'January' WHEN 2 THEN 'Feb' WHEN 3 THEN 'March' WHEN 4 THEN 'Apr' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July'"
    " WHEN 8 THEN 'August' WHEN 9 THEN 'Sept' WHEN 10 THEN 'October' WHEN 11 THEN 'Nov' ELSE 'December' END"
)
VIEWS["f_notice_text"] = f"""
SELECT o_orderkey AS notice_id, CASE o_orderkey % 7
 WHEN 0 THEN 'Meeting on ' || CAST(day(o_orderdate) AS STRING) || '/' || CAST(month(o_orderdate) AS STRING) || '/' || CAST({_YEAR} AS STRING) || ' from 9.15 to 10.00'
 WHEN 1 THEN 'Duty ' || CAST(day(o_orderdate) AS STRING) || ' - ' || CAST(month(o_orderdate) AS STRING) || ' - ' || substr(CAST({_YEAR} AS STRING), 3, 2) || ', Tues. 12:55 - 1:30'
 WHEN 2 THEN 'Sports day: ' || CAST(day(o_orderdate) AS STRING) || 'th ' || {_MONTH} || ' ' || CAST({_YEAR} AS STRING) || ' (Saturday)'
 WHEN 3 THEN 'Session ' || CAST({_YEAR} AS STRING) || '-' || CAST({_YEAR} + 1 AS STRING) || ' starts ' || {_MONTH}
 WHEN 4 THEN 'Exam on 31/' || CAST(month(o_orderdate) AS STRING) || '/' || CAST({_YEAR} AS STRING) || ', 11:45-12:20 pm'
 WHEN 5 THEN 'Routine ' || CAST({_YEAR} AS STRING) || ' / ' || substr(CAST({_YEAR} + 1 AS STRING), 3, 2) || ', from ' || CAST(day(o_orderdate) AS STRING) || ' ' || {_MONTH} || ', wed 7;05 - 7;45'
 ELSE 'No date at all, priority ' || o_orderpriority END AS notice_text FROM orders
"""

VIEWS["f_name_text"] = """
SELECT teacher_id AS seq, school_id, raw_text FROM (
 SELECT seq AS teacher_id, school_id, raw AS raw_text FROM f_raw_name
 UNION ALL SELECT teacher_id + 10000000, school_id, CASE teacher_id % 9 WHEN 0 THEN '7) ' || name || ' (' || code || ')' WHEN 1 THEN name || ' Staff  Nurse' WHEN 2 THEN code || ' ( ) Jr. Boys VI'
  WHEN 3 THEN 'Ms. Boys House' WHEN 4 THEN 'PGT-P.E. (F)' WHEN 5 THEN 'Dr. ' || CAST(teacher_id AS STRING) WHEN 6 THEN name || ' - ' || code || '.' WHEN 7 THEN '||' || name || ' ,' ELSE 'Duty date of ' || code END FROM f_teacher) d
"""

# Raw extracted records, before they are cleaned.
VIEWS["f_raw_period"] = """
SELECT school_id, draft_id, seq, class_name, ' ' || lower(section) || '.' AS section, CASE WHEN seq % 53 = 0 THEN 'Someday' WHEN day_idx = 0 THEN 'Mon' WHEN day_idx = 1 THEN 'TUES.' WHEN day_idx = 2 THEN 'wed'
 WHEN day_idx = 3 THEN 'Thurs' WHEN day_idx = 4 THEN 'Friday' ELSE 'SAT' END AS day, slot, period_number, is_break, CASE WHEN slot = 3 AND seq % 2 = 0 THEN '' ELSE 'Recess' END AS label, start_time, end_time, subject, teacher_name,
 CASE WHEN seq % 11 = 0 THEN 1.4 WHEN seq % 13 = 0 THEN -0.2 WHEN seq % 17 = 0 THEN NULL ELSE confidence END AS confidence FROM f_draft_period
"""
VIEWS["f_raw_remedial"] = """
SELECT school_id, draft_id, seq, CASE seq % 4 WHEN 0 THEN 'LIFE_SKILL' WHEN 1 THEN 'remedial' WHEN 2 THEN 'ENRICHMENT' END AS category, class_name, section, CASE day_idx WHEN 0 THEN 'Monday' WHEN 1 THEN 'tue' WHEN 2 THEN 'Weds' END AS day,
 start_time, end_time, activity, teacher_name, CASE WHEN seq % 17 = 0 THEN NULL ELSE confidence END AS confidence FROM f_draft_remedial
"""
VIEWS["f_raw_duty"] = """
SELECT school_id, draft_id, seq, CASE WHEN seq % 19 = 0 THEN 'next week' ELSE CAST(duty_date AS STRING) END AS duty_date, teacher_name, CASE WHEN seq % 3 = 0 THEN NULL ELSE duty_type END AS description, confidence FROM f_draft_duty
"""

# Every word of every document: sheets of 200 words, ten words to a line.
_WORD = """
SELECT doc_id, doc_id * 1000 + CAST(floor(pos / 200) AS BIGINT) AS page_id, CAST(pos % 200 AS BIGINT) AS seq, word, CAST((pos % 10) * 70 AS DOUBLE) AS x0, CAST((pos % 10) * 70 + 6 * length(word) AS DOUBLE) AS x1,
 CAST(18 * floor((pos % 200) / 10) + pos % 3 AS DOUBLE) AS y0, CAST(18 * floor((pos % 200) / 10) + pos % 3 + 12 AS DOUBLE) AS y1, CAST(60 + (pos * 7) % 40 AS INT) AS conf FROM {words}
"""
VIEWS["f_word"] = _WORD.format(words="(SELECT doc_id, pos, word FROM documents LATERAL VIEW posexplode(split(text, ' ')) w AS pos, word)")
VIEWS["f_line"] = "SELECT doc_id, CAST(pos AS BIGINT) AS pos, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) w AS pos, line"
# Records of a draft (one per text line, every third misread) to look up in the draft's own page text.
VIEWS["f_line_record"] = "SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN 'Zzyzx ' || line ELSE line END AS name, CASE WHEN pos % 7 = 0 THEN NULL ELSE 0.5 + (pos % 5) / 10.0 END AS confidence FROM f_line"
DUCKDB_VIEWS: dict[str, str] = {
    "f_line": "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS pos FROM documents",
    "f_word": _WORD.format(
        words="(SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents)"
    )
}

_NAME = re.compile(r"\bf_[a-z_]+\b")
_BASE = re.compile(r"\b(FROM|JOIN) (" + "|".join(BASE_SCHEMAS) + r")\b")


def _needed(sql: str, source: dict[str, str]) -> list[str]:
    """View names the text uses, in an order that defines each before its use."""
    out: list[str] = []
    for name in dict.fromkeys(_NAME.findall(sql)):
        if name in source:
            for dep in [*_needed(source[name], source), name]:
                if dep not in out:
                    out.append(dep)
    return out


def with_views(sql: str) -> str:
    """DuckDB text: the query preceded by the views it uses."""
    source = {**VIEWS, **DUCKDB_VIEWS}
    ctes = [f"{n} AS ({source[n].strip()})" for n in _needed(sql, source)]
    body = sql.strip()
    if not ctes:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


class Views:
    """Fixture views of one data folder as DataFrames, e.g. `Views(spark, path).f_period`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self._base: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._base:
            self._base[name] = load_base(self.spark, self.path, name)
        return self._base[name]

    def sql(self, text: str) -> DataFrame:
        ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in _needed(text, VIEWS)]
        full = ("WITH " + ", ".join(ctes) + " " if ctes else "") + text
        used: dict[str, DataFrame] = {}

        def bind(match: re.Match) -> str:
            used[match.group(2)] = self.base(match.group(2))
            return f"{match.group(1)} {{{match.group(2)}}}"

        bound = _BASE.sub(bind, full)
        return self.spark.sql(bound, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        if name in BASE_SCHEMAS:
            return self.base(name)
        raise AttributeError(name)
