"""DuckDB text of the printed-text rules, for the checks only."""

from __future__ import annotations

SERIAL = r"^\s*\d{1,3}\s*[.):\-]?\s+([A-Za-z])"
TITLES = "(?:Mr|Mrs|Ms|Miss|Dr|Sri|Shri|Smt|Prof)"
POSTS = "(?:TGT|PGT|PRT|PET|PPL|PAT|HM|VP)"
CODE = rf"{POSTS}\b[\s.\-]*[A-Za-z0-9][A-Za-z0-9./()]*(?:\s?\((?:F|M)\))?"
WORDS = r"\b(Staff\s+Nurse|Librarian|Principal|Vice\s*Principal|Counsell?or|Warden|Matron|Nurse)\b"


def spaces(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[|¦]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def cell(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[|¦_]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def serial(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SERIAL}', '\\1'))"


def code(x: str) -> str:
    c = rf"regexp_replace({spaces(x)}, '\s*\(\s*(F|M)\s*\)', '(\1)', 'i')"
    return rf"trim(regexp_replace(regexp_replace({c}, '[.,;:\s]+$', ''), '\(\s*\)', '', 'g'))"


def key(x: str) -> str:
    s = rf"regexp_replace(lower({serial(x)}), '\b(mr|mrs|ms|miss|dr|shri|sri|smt|sir|madam|prof)\b\.?', ' ', 'g')"
    return f"trim(regexp_replace({s}, '[^a-z0-9]+', ' ', 'g'))"


def fold(x: str) -> str:
    return f"translate(regexp_replace(replace(lower({x}), '¢', 'c'), '[^a-z0-9]', '', 'g'), '5l10', 'siio')"


def person_key(x: str) -> str:
    return rf"regexp_replace(lower(regexp_replace({serial(spaces(x))}, '^{TITLES}\b\.?\s*', '', 'i')), '[^a-z0-9]', '', 'g')"


def letters(x: str) -> str:
    return rf"regexp_replace(translate(regexp_replace(upper({x}), '\(\s*[FM]\s*\)', '', 'g'), '50', 'SO'), '[^A-Z]', '', 'g')"


def prefix(x: str) -> str:
    return f"nullif(regexp_extract({letters(x)}, '^({POSTS})', 1), '')"


def stem(x: str) -> str:
    return f"CASE WHEN {prefix(x)} IS NOT NULL THEN regexp_extract({letters(x)}, '^{POSTS}(.*)$', 1) END"


def classified(name: str, source: str, raw: str) -> str:
    """CTEs ending in `name`: distinct raw texts of a source with kind, pname, pcode, pdesignation."""
    n = name
    return rf"""{n}0 AS (SELECT DISTINCT {raw} AS raw, {serial(spaces(raw))} AS t FROM {source}),
 {n}1 AS (SELECT *, regexp_matches(t, '^{TITLES}\b', 'i') AS titled, regexp_matches(t, '^{POSTS}\b', 'i') AS posted,
  regexp_extract(t, '^(.*?)[\s,(\-–]({CODE})', 2, 'i') AS c, regexp_extract(t, '^(.*?)[\s,(\-–]({CODE})', 1, 'i') AS bc,
  regexp_extract(t, '^(.*?){WORDS}', 2, 'i') AS w, regexp_extract(t, '^(.*?){WORDS}', 1, 'i') AS bw FROM {n}0),
 {n}2 AS (SELECT *, trim(regexp_replace(regexp_replace(CASE WHEN c <> '' THEN bc WHEN w <> '' AND length(bw) > 3 THEN bw ELSE t END, '[,\-–(\s]+$', ''), '\(\s*MOD\s*\)', '', 'i')) AS nm FROM {n}1),
 {n}3 AS (SELECT *, titled AND regexp_matches(regexp_replace(nm, '^{TITLES}\b\.?\s*', '', 'i'), '^\s*[A-Za-z][A-Za-z.''’\-]*(\s+[A-Za-z][A-Za-z.''’\-]*){{0,5}}\s*$')
  AND NOT regexp_matches(nm, '\b(Boys|Girls|House)\b', 'i') AS person, regexp_matches(t, '^[A-Za-z0-9.\-/(), ]{{2,40}}$') AND NOT regexp_matches(t, '\b(Boys|Girls|House)\b', 'i')
  AND NOT regexp_matches(t, '\bdate\b', 'i') AS compact, regexp_extract(t, '(?:^|[\s,(\-–])({CODE})', 1, 'i') AS found FROM {n}2),
 {n} AS (SELECT raw, CASE WHEN person THEN 'person' WHEN posted AND NOT titled THEN 'code' ELSE 'garbage' END AS kind,
  CASE WHEN person THEN nm WHEN posted AND NOT titled THEN CASE WHEN compact THEN {code('t')} WHEN found <> '' THEN {code('found')} ELSE {code("regexp_extract(t, '^([^ ]+)', 1)")} END ELSE t END AS pname,
  CASE WHEN person THEN CASE WHEN c <> '' THEN {code('c')} END WHEN posted AND NOT titled THEN CASE WHEN compact THEN {code('t')} WHEN found <> '' THEN {code('found')} ELSE {code("regexp_extract(t, '^([^ ]+)', 1)")} END END AS pcode,
  CASE WHEN person AND c = '' AND w <> '' AND length(bw) > 3 THEN {spaces('w')} END AS pdesignation FROM {n}3)"""
