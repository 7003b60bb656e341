"""What a piece of printed text is: a person, a post code, or heading text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions.clock import let
from rollbook.functions.text import blank_to_null, clean_spaces, strip_serial

# Titles, post codes, designations and house words the documents print.
TITLES = "(?:Mr|Mrs|Ms|Miss|Dr|Sri|Shri|Smt|Prof)"
POSTS = "(?:TGT|PGT|PRT|PET|PPL|PAT|HM|VP)"
DESIGNATIONS = r"\b(Staff\s+Nurse|Librarian|Principal|Vice\s*Principal|Counsell?or|Warden|Matron|Nurse)\b"
HOUSES = r"(?i)\b(Boys|Girls|House)\b"
CODE_LIKE = r"(?i)^(tgt|pgt|prt|pet|ppl|pat|hm|vp|lib|ct)"

TITLE_START = rf"(?i)^{TITLES}\b\.?\s*"
POST_START = rf"(?i)^{POSTS}\b"
_CODE = rf"{POSTS}\b[\s.\-]*[A-Za-z0-9][A-Za-z0-9./()]*(?:\s?\((?:F|M)\))?"
NAME_THEN_CODE = rf"(?i)^(.*?)[\s,(\-–]({_CODE})"
CODE_ANYWHERE = rf"(?i)(?:^|[\s,(\-–])({_CODE})"
NAME_THEN_DESIGNATION = rf"(?i)^(.*?){DESIGNATIONS}"
_TOKEN = r"[A-Za-z][A-Za-z.'’\-]*"
NAME_TOKENS = rf"^\s*{_TOKEN}(\s+{_TOKEN}){{0,5}}\s*$"
COMPACT_CODE = r"^[A-Za-z0-9.\-/(), ]{2,40}$"


def clean_code(c: Column) -> Column:
    """ "TGT-S.SC." as "TGT-S.SC", "TGT-P.E. (F)" as "TGT-P.E.(F)"."""
    s = F.regexp_replace(clean_spaces(c), r"(?i)\s*\(\s*(F|M)\s*\)", "($1)")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[.,;:\s]+$", ""), r"\(\s*\)", ""))


def classify(raw: Column) -> Column:
    """struct(kind, name, code, designation); kind is person, code or garbage."""
    null = F.lit(None).cast("string")

    def result(kind: str, name: Column, code: Column, designation: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), code.alias("code"), designation.alias("designation"))

    def person_parts(t: Column) -> Column:
        return F.struct(
            F.regexp_extract(t, NAME_THEN_CODE, 2).alias("code"), F.regexp_extract(t, NAME_THEN_CODE, 1).alias("before_code"),
            F.regexp_extract(t, NAME_THEN_DESIGNATION, 2).alias("word"), F.regexp_extract(t, NAME_THEN_DESIGNATION, 1).alias("before_word"),
        )

    def person(t: Column) -> Column:
        def build(p: Column) -> Column:
            has_code = p["code"] != ""
            has_word = ~has_code & (p["word"] != "") & (F.length(p["before_word"]) > 3)
            name = F.when(has_code, p["before_code"]).when(has_word, p["before_word"]).otherwise(t)
            name = F.trim(F.regexp_replace(F.regexp_replace(name, r"[,\-–(\s]+$", ""), r"(?i)\(\s*MOD\s*\)", ""))

            def check(n: Column) -> Column:
                ok = F.regexp_replace(n, TITLE_START, "").rlike(NAME_TOKENS) & ~n.rlike(HOUSES)
                return F.when(ok, result("person", n, F.when(has_code, clean_code(p["code"])), F.when(has_word, clean_spaces(p["word"]))))

            return let(name, check)

        return F.coalesce(let(person_parts(t), build), result("garbage", t, null, null))

    def post(t: Column) -> Column:
        compact = t.rlike(COMPACT_CODE) & ~t.rlike(HOUSES) & ~t.rlike(r"(?i)\bdate\b")
        found = F.regexp_extract(t, CODE_ANYWHERE, 1)
        picked = F.when(compact, t).when(found != "", found).otherwise(F.regexp_extract(t, r"^(\S+)", 1))
        return let(clean_code(picked), lambda c: result("code", c, c, null))

    def choose(t: Column) -> Column:
        return F.when(t.rlike(TITLE_START), person(t)).when(t.rlike(POST_START), post(t)).otherwise(result("garbage", t, null, null))

    return let(strip_serial(clean_spaces(raw)), choose)


def person_key(name: Column) -> Column:
    s = F.regexp_replace(strip_serial(clean_spaces(name)), TITLE_START, "")
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def _folded_code(code: Column) -> Column:
    s = F.regexp_replace(F.upper(code), r"\(\s*[FM]\s*\)", "")
    return F.regexp_replace(F.translate(s, "50", "SO"), "[^A-Z]", "")


def code_prefix(code: Column) -> Column:
    return blank_to_null(F.regexp_extract(_folded_code(code), f"^({POSTS})", 1))


def code_stem(code: Column) -> Column:
    """Letters after the post prefix; null when there is no prefix."""
    return F.when(code_prefix(code).isNotNull(), F.regexp_extract(_folded_code(code), f"^{POSTS}(.*)$", 1))


def same_post(prefix_a: Column, stem_a: Column, prefix_b: Column, stem_b: Column) -> Column:
    """ENG/ENGLISH or MATH/MATHS under one prefix: equal stems, or the shorter (2+) starts the longer."""
    shorter = F.when(F.length(stem_a) <= F.length(stem_b), stem_a).otherwise(stem_b)
    longer = F.when(F.length(stem_a) <= F.length(stem_b), stem_b).otherwise(stem_a)
    return (prefix_a == prefix_b) & ((stem_a == stem_b) | ((F.length(shorter) >= 2) & F.startswith(longer, shorter)))


def username_base(name: Column) -> Column:
    """ "Mr. R.K. Tomar" as rk.tomar; at most 30 characters."""
    bare = F.regexp_replace(name, r"(?i)^(mr|mrs|ms|miss|dr|sri|shri|smt|prof)\.?\s+", "")
    words = F.transform(F.split(bare, r"\s+"), lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", ""))

    def build(w: Column) -> Column:
        joined = F.when(F.size(w) > 0, F.array_join(w, ".")).otherwise(F.lit("teacher"))
        short = F.concat(F.get(w, F.lit(0)), F.lit("."), F.try_element_at(w, F.lit(-1)))
        return F.substring(F.when((F.length(joined) > 30) & (F.size(w) > 2), short).otherwise(joined), 1, 30)

    return let(F.filter(words, lambda w: w != ""), build)
