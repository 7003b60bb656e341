"""What a state-changing job returns can be fed to the next one."""

from datetime import date

from pyspark.sql import functions as F

from rollbook.operators import identity, layout, lifecycle, versions


def test_version_table_keeps_its_columns(spark):
    rows = [(1, 1, "ARCHIVED", "First"), (1, 2, "ACTIVE", "Second"), (1, 3, "SCHEDULED", "Third")]
    routines = spark.createDataFrame(rows, "school_id int, version int, status string, title string")
    for c in ("effective_from", "archived_on", "published_on"):
        routines = routines.withColumn(c, F.lit(date(2026, 1, 1)))
    actions = spark.createDataFrame([(1, 3, "activate")], "school_id int, version int, action string")
    switched = lifecycle.switch_version(routines, actions, date(2026, 2, 1))
    assert switched.columns == routines.columns
    assert {r["version"]: r["status"] for r in switched.collect()} == {1: "ARCHIVED", 2: "ARCHIVED", 3: "ACTIVE"}
    assert {r["version"] for r in versions.beyond_newest(switched, date(2027, 1, 1), keep=1).collect()} == {1}


def test_upsert_keeps_the_stored_id(spark):
    schema = "duty_id long, school_id int, teacher_id long, duty_date string, duty_type string, seq long, note string"
    old = spark.createDataFrame([(7, 1, 5, "2026-03-01", "MOD", 1, "old")], schema)
    new = spark.createDataFrame([(90, 1, 5, "2026-03-01", "MOD", 1, "mid"), (91, 1, 5, "2026-03-01", "MOD", 2, "new"), (92, 1, 6, "2026-03-01", "MOD", 3, "more")], schema)
    assert {(r["duty_id"], r["note"]) for r in lifecycle.upsert_duties(old, new).collect()} == {(7, "new"), (92, "more")}


def test_weekly_offs_keep_other_columns(spark):
    old = spark.createDataFrame([(1, 5, 0, 40), (1, 6, 2, 41)], "school_id int, teacher_id long, day_idx int, doc_id long")
    new = spark.createDataFrame([(1, 5, 3)], "school_id int, teacher_id long, day_idx int")
    assert {tuple(r) for r in lifecycle.replace_per_teacher(old, new).collect()} == {(1, 6, 2, 41), (1, 5, 3, None)}


def test_answers_given_twice_do_not_multiply(spark):
    names = spark.createDataFrame([(1, "A")], "school_id int, raw string")
    mapping = spark.createDataFrame([(1, "A", "SAME:B"), (1, "A ", "SAME:B"), (1, "B", "T1"), (1, "B", "T1")], "school_id int, raw string, target string")
    assert [(r["name"], r["target"]) for r in identity.follow_aliases(names, mapping).collect()] == [("B", "T1")]


def lines(spark, *texts, heads=()):
    rows = [(1, i, t, len(t.split()), 90.0, i in heads, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "page_id long, line_no int, text string, words int, conf double, is_heading boolean, class_name string, section string")


def test_dates_do_not_flow_into_the_next_block(spark):
    page = lines(spark, "MASTER ON DUTY", "12/03/2026 Mr. Anil Roy", "WEEKLY OFF", "Monday: Mr. Someone Else", "MASTER ON DUTY", "Mrs. Bina Das", "13/03/2026 Mrs. Bina Das")
    got = {(r["line_no"], str(r["duty_date"]), r["teacher_name"]) for r in layout.list_duties(page).collect()}
    assert got == {(1, "2026-03-12", "Mr. Anil Roy"), (6, "2026-03-13", "Mrs. Bina Das")}


def test_section_printed_against_the_class(spark):
    page = lines(spark, "Remedial classes", "VIA Tuesday 3:00 - 3:45 Music")
    (r,) = layout.list_remedial(page).collect()
    assert (r["class_name"], r["section"], r["day"]) == ("VI", "A", "TUESDAY")


def test_members_on_the_club_line(spark):
    page = lines(spark, "1. Literary Club: Mr. Anil Roy, Mrs. Bina Das", "Activities: Debate, Quiz")
    got = {(r["role"], r["value"]) for r in layout.list_clubs(page).collect()}
    assert {("member", "Mr. Anil Roy"), ("member", "Mrs. Bina Das"), ("activity", "Debate"), ("activity", "Quiz")} <= got


def test_router_title_is_the_head_of_the_document_not_of_each_page(spark):
    docs = spark.createDataFrame([(1, "ROUTINE"), (2, "ROUTINE")], "doc_id long, kind string")
    text = {(1, 1, 3): "Remedial classes", (2, 0, 3): "Remedial classes"}
    lines = [(d, p, n, text.get((d, p, n), "x")) for d in (1, 2) for p in (0, 1) for n in range(15)]
    duty = spark.createDataFrame([], "doc_id long")
    got = layout.route_extractors(docs, spark.createDataFrame(lines, "doc_id long, page_id int, line_no int, text string"), duty, page=["page_id"])
    assert {r.doc_id: r.reader for r in got.collect()} == {1: "timetable+lists", 2: "remedial"}
