"""Subject and teacher from the text of one timetable cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions.clock import let
from rollbook.functions.text import clean_cell

# Post codes and titles a cell may print.
_POSTS = "(?:TGT|PGT|PRT|PET|PPL|PAT|HM|VP|PRIN|LIB|CT)"
INLINE_CODE = rf"(?i)\b{_POSTS}\b[\s.\-]*[A-Za-z][A-Za-z./]{{0,11}}"
_ANY_POST = rf"(?i)\b{_POSTS}\b"
INLINE_NAME = r"\b(?:Mr|Mrs|Ms|Miss|Dr|Sri|Shri|Smt|Prof)\.?\s+[A-Z][A-Za-z.'-]*(?:\s+[A-Z][A-Za-z.'-]*){0,3}"
_DASH = r"\s+[-–—/]\s+"


def is_teacherish(c: Column) -> Column:
    return c.rlike(_ANY_POST) | c.rlike(INLINE_NAME)


def _count(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def strip_edges(c: Column) -> Column:
    """Drop separators at both ends, empty brackets, and one bracket left open at an end."""

    def unbracket(t: Column) -> Column:
        opens, closes = _count(t, "("), _count(t, ")")
        out = F.when(opens > closes, F.regexp_replace(t, r"^\(", "")).when(closes > opens, F.regexp_replace(t, r"\)$", "")).otherwise(t)
        return F.trim(F.regexp_replace(out, r"\s+", " "))

    t = F.regexp_replace(F.regexp_replace(c, r"^[\s\-–—/:,;|]+|[\s\-–—/:,;|]+$", ""), r"\(\s*\)", "")
    return let(t, unbracket)


def _tidy_brackets(joined: Column) -> Column:
    """Inside brackets: no spaces around - and /."""
    s = joined
    for mark in ("-", "/"):
        s = F.regexp_replace(s, rf"(\([^()]*?)\s*{mark}\s*([^()]*\))", rf"$1{mark}$2")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\(\s+", "("), r"\s+\)", ")"), r"\s+", " "))


def split_cell(raw_lines: Column) -> Column:
    """struct(subject, teacher, repaired) of an array of cell lines; null when the cell holds no text.

    `repaired` marks unbalanced brackets, which are read as they stand."""

    def result(subject: Column, teacher: Column, repaired: Column) -> Column:
        return F.struct(subject.alias("subject"), teacher.alias("teacher"), repaired.alias("repaired"))

    def by_lines(lines: Column) -> Column:
        joined = F.regexp_replace(F.regexp_replace(F.array_join(lines, " "), r"[{\[]", "("), r"[}\]]", ")")
        return F.when(F.size(lines) > 0, let(_tidy_brackets(joined), lambda j: by_text(lines, j)))

    def by_text(lines: Column, j: Column) -> Column:
        repaired = _count(j, "(") != _count(j, ")")
        inner = F.filter(F.regexp_extract_all(j, F.lit(r"\(([^()]*)\)"), F.lit(1)), is_teacherish)

        def rules(found: Column) -> Column:
            rest = F.aggregate(found, j, lambda acc, x: F.replace(acc, F.concat(F.lit("("), x, F.lit(")")), F.lit(" ")))
            last, head = F.element_at(lines, -1), F.array_join(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), " ")
            first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
            code = F.regexp_extract(j, INLINE_CODE, 0)
            name = F.regexp_extract(j, INLINE_NAME, 0)
            parts = F.split(j, _DASH)
            return (
                F.when(F.size(found) > 0, result(strip_edges(rest), F.array_join(F.transform(found, lambda x: F.trim(x)), " / "), repaired))
                .when((F.size(lines) >= 2) & is_teacherish(last), result(strip_edges(head), strip_edges(last), repaired))
                .when((F.size(lines) == 2) & is_teacherish(first) & ~is_teacherish(second), result(strip_edges(second), strip_edges(first), repaired))
                .when(code != "", result(strip_edges(F.replace(j, code, F.lit(" "))), strip_edges(code), repaired))
                .when(name != "", result(strip_edges(F.replace(j, name, F.lit(" "))), strip_edges(name), repaired))
                .when((F.size(parts) == 2) & is_teacherish(F.get(parts, F.lit(1))), result(strip_edges(F.get(parts, F.lit(0))), strip_edges(F.get(parts, F.lit(1))), repaired))
                .otherwise(result(strip_edges(j), F.lit(""), repaired))
            )

        return F.when(F.replace(F.replace(j, F.lit("("), F.lit("")), F.lit(")"), F.lit("")).rlike("[A-Za-z0-9]"), let(inner, rules))

    cleaned = F.filter(F.transform(raw_lines, clean_cell), lambda x: x.rlike("[A-Za-z0-9]"))
    return let(cleaned, by_lines)
