"""Printed-text vectors: what each text must be read as."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollbook.functions import cells, clock, people
from rollbook.functions import text as X


def value(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("v")).first()["v"]


def values(spark, table, fn):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(table)], "i int, t string").select("i", fn(F.col("t")).alias("v"))
    return [r["v"] for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_clock(spark):
    table = {"8:15": "08:15", "12.55": "12:55", "1:30": "13:30", "1:30 pm": "13:30", "12:05 am": "00:05", "9;05": "09:05", "25:00": None, "8:75": None, "noon": None}
    assert values(spark, table, clock.parse_clock) == list(table.values())


def test_minutes_and_labels(spark):
    assert values(spark, ["08:15", "24:00", "8:15", ""], clock.to_minutes) == [495, None, None, None]
    assert values(spark, ["13:30", "00:05", "x"], clock.format_clock) == ["1:30 PM", "12:05 AM", ""]
    n = spark.createDataFrame([(1,), (2,), (3,), (4,), (11,), (12,), (13,), (21,), (111,), (122,)], "n int").select(clock.ordinal(F.col("n")).alias("v"))
    assert sorted(r["v"] for r in n.collect()) == sorted(["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "111th", "122nd"])


def test_class_names(spark):
    table = {"Class 6": "VI", "VI": "VI", "6th": "VI", "class-vii": "VII", "Vill": "VIII", "V|": "VI", "13": None, "KG": None, "": None, "0": None}
    assert values(spark, table, X.normalize_class) == list(table.values())


def test_days_and_ranges(spark):
    table = {"Mon": "MONDAY", "TUES.": "TUESDAY", "weds": "WEDNESDAY", "x": None}
    assert values(spark, table, X.normalize_day) == list(table.values())
    got = values(spark, ["8:15-8:55", "8.15 to 8.55", "12:55 – 1:30", "11:45-11:20", "no"], X.time_range)
    assert [None if g is None else (g["start"], g["end"]) for g in got] == [("08:15", "08:55"), ("08:15", "08:55"), ("12:55", "13:30"), ("11:45", "23:20"), None]


def test_dates_and_sessions(spark):
    table = {"on 12/03/2026": dt.date(2026, 3, 12), "5-4-26": dt.date(2026, 4, 5), "12th March 2026": dt.date(2026, 3, 12), "31/02/2026": None, "12 Foo 2026": None}
    assert values(spark, table, X.date_in_text) == list(table.values())
    assert values(spark, ["Session 2025-26", "2025 / 2026", "none"], X.session_in_text) == ["2025-26", "2025-26", None]


def test_period_numbers(spark):
    table = {"1st": 1, "Period-3": 3, "P.5": 5, "sixth": 6, "IX": 9, "XII": None, "break": None}
    assert values(spark, table, X.period_number) == list(table.values())


PEOPLE = [
    ("15 Mr. Ravi Sen TGT-Maths", "person", "Mr. Ravi Sen", "TGT-Maths", None),
    ("Mr. R.K. Bose, TGT-English", "person", "Mr. R.K. Bose", "TGT-English", None),
    ("Mrs. Asha Rao Staff Nurse", "person", "Mrs. Asha Rao", None, "Staff Nurse"),
    ("TGT-SCI", "code", "TGT-SCI", "TGT-SCI", None),
    ("TGT-Art ( ) Jr. Boys VI", "code", "TGT-Art", "TGT-Art", None),
    ("TGT-P.E. (F)", "code", "TGT-P.E.(F)", "TGT-P.E.(F)", None),
    ("Ref. No", "garbage", "Ref. No", None, None),
    ("Mr. Boys House", "garbage", "Mr. Boys House", None, None),
]


@pytest.mark.parametrize("raw,kind,name,code,title", PEOPLE)
def test_classify(spark, raw, kind, name, code, title):
    p = value(spark, raw, people.classify)
    assert (p["kind"], p["name"], p["code"], p["designation"]) == (kind, name, code, title)


def test_keys(spark):
    assert values(spark, ["15 Mr. R.K. Bose", "Mr. R. K. Bose"], people.person_key) == ["rkbose", "rkbose"]
    assert values(spark, ["3. Mr. A. Sen", "Smt. A Sen"], X.match_key) == ["a sen", "a sen"]
    assert len(set(values(spark, ["S.Sc", "S$.Sc", "5.5c"], X.look_alike))) == 1
    assert len(set(values(spark, ["MATH", "MATHS"], X.look_alike))) == 2


def test_same_post(spark):
    rows = [("TGT-ENG", "TGT-ENGLISH", True), ("TGT-MATH", "TGT-MATHS", True), ("PGT-ENG", "TGT-ENG", False), ("TGT-5.5C", "TGT-S.SC", True), ("TGT-E", "TGT-ENG", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    a, b = F.col("a"), F.col("b")
    df = df.withColumn("got", people.same_post(people.code_prefix(a), people.code_stem(a), people.code_prefix(b), people.code_stem(b)))
    assert df.filter("got <> want").count() == 0


CELLS = [
    (["Maths (PGT-Phy)"], "Maths", "PGT-Phy"),
    (["S.ST/ENGLISH (TGT-S.ST-2,4) (PGT-ENGLISH-1,3,5)"], "S.ST/ENGLISH", "TGT-S.ST-2,4 / PGT-ENGLISH-1,3,5"),
    (["English", "Mr. A. Sen"], "English", "Mr. A. Sen"),
    (["Mr. A. Sen", "English"], "English", "Mr. A. Sen"),
    (["Science TGT-SCI"], "Science", "TGT-SCI"),
    (["Library"], "Library", ""),
    (["Art (TGT-", "ART)"], "Art", "TGT-ART"),
]


@pytest.mark.parametrize("lines,subject,teacher", CELLS)
def test_cells(spark, lines, subject, teacher):
    got = spark.createDataFrame([(lines,)], "l array<string>").select(cells.split_cell(F.col("l")).alias("c")).first()["c"]
    assert (got["subject"], got["teacher"]) == (subject, teacher)


def test_usernames(spark):
    table = {"Mr. R.K. Bose": "rk.bose", "Mrs. Philomena Shaw": "philomena.shaw", "": "teacher"}
    assert values(spark, table, people.username_base) == list(table.values())


def test_a_date_is_matched_once(spark):
    df = spark.createDataFrame([("on 3/4/26",), ("12 March 2026",), ("12 March",), ("31/4/2026",), ("none",), (None,)], "s string").select(X.date_in_text(F.col("s")).cast("string").alias("d"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 6
    assert [r["d"] for r in df.collect()] == ["2026-04-03", "2026-03-12", None, None, None, None]
