"""Printed school text to values: classes, sections, days, periods, times, dates, keys.

Patterns use no look-ahead, so the same text runs in RE2 engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions.clock import WEEKDAYS, let, lookup, parse_clock

# Class names are Roman numerals.
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII"]

# Printed short forms of the weekdays.
DAY_FORMS = {
    "MON": "MONDAY", "MONDAY": "MONDAY",
    "TUE": "TUESDAY", "TUES": "TUESDAY", "TUESDAY": "TUESDAY",
    "WED": "WEDNESDAY", "WEDS": "WEDNESDAY", "WEDNESDAY": "WEDNESDAY",
    "THU": "THURSDAY", "THUR": "THURSDAY", "THURS": "THURSDAY", "THURSDAY": "THURSDAY",
    "FRI": "FRIDAY", "FRIDAY": "FRIDAY",
    "SAT": "SATURDAY", "SATURDAY": "SATURDAY",
    "SUN": "SUNDAY", "SUNDAY": "SUNDAY",
}
DAY_PATTERN = r"(?i)\b(MON|TUE|TUES|WED|WEDS|THU|THUR|THURS|FRI|SAT|SUN)(DAY|SDAY|NESDAY|RSDAY|URDAY)?\b"

# Number words and month names.
NUMBER_WORDS = ["FIRST", "SECOND", "THIRD", "FOURTH", "FIFTH", "SIXTH", "SEVENTH", "EIGHTH", "NINTH", "TENTH"]
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5,
    "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9,
    "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}

BREAK_PATTERN = r"(?i)\b(BREAK|RECESS|LUNCH|INTERVAL|TIFFIN|SHORT\s*BREAK)\b"
_ONE_TIME = r"\d{1,2}\s*[:.;]\s*\d{2}\s*(?:am|pm)?"
RANGE_PATTERN = rf"(?i)({_ONE_TIME})\s*(?:-|–|—|to|TO)\s*({_ONE_TIME})"
NUMERIC_DATE = r"\b(\d{1,2})\s*[/.\-]\s*(\d{1,2})\s*[/.\-]\s*(\d{2,4})\b"
WORD_DATE = r"\b(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})\.?,?\s*(\d{4})?\b"
SESSION_PATTERN = r"\b(20\d{2})\s*[-–/]\s*(\d{2,4})\b"
SERIAL_PATTERN = r"^\s*\d{1,3}\s*[.):\-]?\s+([A-Za-z])"
TITLE_PATTERN = r"\b(mr|mrs|ms|miss|dr|shri|sri|smt|sir|madam|prof)\b\.?"

_RANK = {r: i + 1 for i, r in enumerate(ROMAN)}


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def class_rank(c: Column) -> Column:
    """1 to 12 for I to XII, 99 for anything else."""
    return F.coalesce(lookup(c, _RANK), F.lit(99))


def normalize_class(raw: Column) -> Column:
    """ "Class 6", "6th", "Vill" as VI, VI, VIII; null when it names no class."""
    s = F.regexp_replace(F.upper(raw), r"\bCLASS(ES)?\b", "")
    s = F.regexp_replace(F.regexp_replace(s, "[^A-Z0-9|]", ""), "(ST|ND|RD|TH)$", "")

    def resolve(v: Column) -> Column:
        fixed = F.regexp_replace(v, "[L1|]", "I")
        number = F.nullif(v.try_cast("int"), F.lit(0))
        by_number = F.when(v.rlike("^[0-9]{1,2}$"), F.try_element_at(F.array(*[F.lit(r) for r in ROMAN]), number))
        return F.when(v.isin(ROMAN), v).otherwise(F.coalesce(by_number, F.when(v.rlike("^[VXIL1|]+$") & fixed.isin(ROMAN), fixed)))

    return F.when(raw.isin(ROMAN), raw).otherwise(let(s, resolve))


def normalize_section(raw: Column) -> Column:
    return F.coalesce(F.substring(F.regexp_replace(F.upper(raw), "[^A-Z]", ""), 1, 3), F.lit(""))


def normalize_day(raw: Column) -> Column:
    return lookup(F.regexp_replace(F.upper(raw), "[^A-Z]", ""), DAY_FORMS)


def day_index(name: Column) -> Column:
    return lookup(name, {d: i for i, d in enumerate(WEEKDAYS)})


def day_in_text(raw: Column) -> Column:
    return normalize_day(F.regexp_extract(raw, DAY_PATTERN, 0))


def is_break_label(raw: Column) -> Column:
    return raw.rlike(BREAK_PATTERN)


def _digits(s: Column, pattern: str) -> Column:
    """The number in the first group, null without a match: an empty text is not cast, which would raise and catch an error."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, 1).try_cast("int"))


def period_number(raw: Column) -> Column:
    words = {**{w: i + 1 for i, w in enumerate(NUMBER_WORDS)}, **{r: i + 1 for i, r in enumerate(ROMAN[:10])}}

    def read(s: Column) -> Column:
        return F.coalesce(_digits(s, r"^(\d{1,2})\s*(ST|ND|RD|TH)?$"), _digits(s, r"^(?:PERIOD|PER|P)\s*[-:]?\s*(\d{1,2})$"), lookup(s, words))

    return let(F.replace(F.upper(F.trim(raw)), F.lit("."), F.lit("")), read)


def time_range(raw: Column) -> Column:
    """struct(start, end) of the first printed range; an end not after its start rolls on by 12 hours."""

    def roll(p: Column) -> Column:
        start, end = p["start"], p["end"]
        hour = F.substring(end, 1, 2).try_cast("int")
        rolled = F.when((end <= start) & (hour < 12), F.concat((hour + 12).cast("string"), F.substring(end, 3, 3))).otherwise(end)
        return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), rolled.alias("end")))

    printed = F.struct(
        parse_clock(F.regexp_extract(raw, RANGE_PATTERN, 1)).alias("start"), parse_clock(F.regexp_extract(raw, RANGE_PATTERN, 2)).alias("end")
    )
    return let(printed, roll)


def _checked_date(y: Column, m: Column, d: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d", y, m, d)
    return F.when(y.between(2000, 2100) & m.between(1, 12) & d.between(1, 31), F.try_to_date(text, "yyyy-MM-dd"))


def date_in_text(raw: Column, default_year: int | None = None) -> Column:
    """First calendar date: d/m/y (two-digit years are 20yy) or "12 March 2026"; null when it does not exist."""

    def parts(pattern: str, year: int, month: int, day: int) -> Column:
        """The three groups, taken once; null without a match."""
        groups = F.struct(*[F.regexp_extract(raw, pattern, i).alias(n) for n, i in (("y", year), ("m", month), ("d", day))])
        return F.when(raw.rlike(pattern), groups)

    def numeric(p: Column) -> Column:
        return let(p["y"].try_cast("int"), lambda y: _checked_date(F.when(y < 100, y + 2000).otherwise(y), p["m"].try_cast("int"), p["d"].try_cast("int")))

    def worded(p: Column) -> Column:
        year = F.when(p["y"] != "", p["y"].try_cast("int")).otherwise(F.lit(default_year).cast("int"))
        return _checked_date(year, lookup(F.lower(p["m"]), MONTHS), p["d"].try_cast("int"))

    return F.when(raw.rlike(NUMERIC_DATE), let(parts(NUMERIC_DATE, 3, 2, 1), numeric)).otherwise(let(parts(WORD_DATE, 3, 2, 1), worded))


def session_in_text(raw: Column) -> Column:
    return F.when(
        raw.rlike(SESSION_PATTERN),
        F.concat(F.regexp_extract(raw, SESSION_PATTERN, 1), F.lit("-"), F.right(F.regexp_extract(raw, SESSION_PATTERN, 2), F.lit(2))),
    )


def clean_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[|¦]+", " "), r"\s+", " "))


def clean_cell(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[|¦_]+", " "), r"\s+", " "))


def strip_serial(c: Column) -> Column:
    """Drop a leading list number ("15 Mr. X", "27) Mr. X")."""
    return F.trim(F.regexp_replace(c, SERIAL_PATTERN, "$1"))


def match_key(c: Column) -> Column:
    """Key under which two spellings of one name meet: no number, title, case or punctuation."""
    s = F.regexp_replace(F.lower(strip_serial(c)), TITLE_PATTERN, " ")
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def look_alike(c: Column) -> Column:
    """Key that also forgives look-alike characters (5/s, 1/l/i, 0/o)."""
    s = F.regexp_replace(F.replace(F.lower(c), F.lit("¢"), F.lit("c")), "[^a-z0-9]", "")
    return F.translate(s, "5l10", "siio")
