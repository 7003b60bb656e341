"""HTML tables, heads of timetables, matrices, deep pages, exports and draft limits."""

import random

import pytest
from pyspark.sql import functions as F

from rollbook.operators import layout as L
from rollbook.operators import reads as R
from rollbook.operators import text_jobs as T
from rollbook.sources import backup as B
from rollbook.sources import drafts as D


def plain_table(rows):
    """{(row, col): text} of rows of (text, down, across), laid one after the other."""
    out, open_ = {}, {}
    for i, row in enumerate(rows):
        taken = {c for c, (until, _) in open_.items() if until >= i}
        col = 0
        for text, down, across in row:
            for _ in range(across):
                while col in taken:
                    col += 1
                out[i, col] = text
                if down > 1:
                    open_[col] = (min(i + down, len(rows)) - 1, text)
                col += 1
        for c in taken:
            out[i, c] = open_[c][1] if (i, c) not in out else out[i, c]
        for c in range(max(taken, default=-1)):
            out.setdefault((i, c), "")
    return out


def html_of(rows):
    cell = lambda t, d, a: f"<td{f' rowspan={chr(34)}{d}{chr(34)}' if d > 1 else ''}{f' colspan={a}' if a > 1 else ''}>{t}</td>"
    return "<table>" + "".join("<tr>" + "".join(cell(*c) for c in r) + "</tr>" for r in rows) + "</table>"


def test_spans_equal_a_walk_over_the_rows(spark):
    r = random.Random(11)
    tables = []
    for k in range(60):
        tables.append([[(f"{k}.{i}.{j}", r.choice([1, 1, 1, 2, 3, 9]), r.choice([1, 1, 1, 2, 3])) for j in range(r.randrange(0, 5))] for i in range(r.randrange(1, 8))])
    pages = spark.createDataFrame([(k, "<p>x</p>" + html_of(t)) for k, t in enumerate(tables)], "page_id int, html string")
    got = {}
    for x in T.html_tables(pages).collect():
        assert (x["row_no"], x["col_no"]) not in got.setdefault(x["page_id"], {})
        got[x["page_id"]][x["row_no"], x["col_no"]] = x["text"]
    for k, t in enumerate(tables):
        assert got.get(k, {}) == plain_table(t), (k, t)


def test_very_wide_span_is_spread_in_pieces(spark):
    pages = spark.createDataFrame([(1, '<table><tr><td colspan="200000">a</td><td>b</td></tr><tr><td>c</td></tr></table>')], "page_id int, html string")
    out = T.html_tables(pages)
    assert out.filter("text = 'a'").count() == 200_000 and out.filter("text = 'b'").first()["col_no"] == 200_000


def test_headings_are_the_last_lines_above(spark):
    html = "<p>A</p><p>B</p><p>C</p><p>D &amp; E</p><table><tr><td>1</td></tr></table><table><tr><td>2</td></tr></table><p>F</p><table><tr><td>3</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, "<table></table>"), (3, "no table")], "page_id int, html string")
    got = {(r["page_id"], r["table_no"]): r["heading"] for r in T.html_headings(pages).collect()}
    assert got == {(1, 0): "B C D & E", (1, 1): "B C D & E", (1, 2): "F", (2, 0): ""}


@pytest.mark.parametrize("text,want", [("&#65;&#0066;", "AB"), ("&#9999999;", "&#9999999;"), ("&#2000000; x", "&#2000000; x"), ("&#55296;", "&#55296;"), ("&#128578;", "🙂"), ("&#99999999999999999999999;", "&#99999999999999999999999;"), ("&#x41;", "&#x41;"), ("&amp;#65;", "A")])
def test_character_references(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(T.decode_entities(F.col("s")).alias("x")).first()["x"] == want


@pytest.mark.parametrize("word,want", [("1st", 1), ("ist", 1), ("lst", 1), ("2nd", 2), ("Sth", 5), ("5th", 5), ("bth", 8), ("gth", 9), ("oth", None), ("2th", None), ("12th", 12), ("13th", None), ("21st", None), ("xth", None), ("last", None), ("11th", 11), ("Ist", 1)])
def test_ordinals(spark, word, want):
    assert spark.createDataFrame([(word,)], "s string").select(L.ordinal(F.col("s")).alias("x")).first()["x"] == want


def head(spark, line0, line1):
    rows = [(1, n, i, w, float(x - 10), float(x + 10), 20.0 * n, 20.0 * n + 10, 90) for n, line in enumerate((line0, line1)) for i, (w, x) in enumerate(line)]
    return spark.createDataFrame(rows, "page_id int, line_no int, word_no int, word string, x0 double, x1 double, y0 double, y1 double, conf int")


def columns(spark, line0, line1):
    return [(r["number"], r["is_break"], r["start_time"], r["end_time"], r["inferred"]) for r in L.detect_columns(head(spark, line0, line1), ["page_id"]).orderBy("col_no").collect()]


def test_break_out_of_reach_is_a_column(spark):
    got = columns(spark, [("lst", 100), ("2nd", 200), ("3rd", 300), ("Recess", 420)], [("8:00-8:40", 100), ("8:40-9:20", 200), ("9:20-10:00", 300)])
    assert got == [(1, False, "08:00", "08:40", False), (2, False, "08:40", "09:20", False), (3, False, "09:20", "10:00", False), (None, True, None, None, False)]
    near = columns(spark, [("1st", 100), ("2nd", 200), ("Recess", 300), ("3rd", 400)], [("8:00-8:40", 100), ("8:40-9:20", 200), ("9:20-9:40", 300), ("9:40-10:20", 400)])
    assert [c[:2] for c in near] == [(1, False), (2, False), (None, True), (3, False)]


def test_two_ranges_without_marks_are_plain_periods(spark):
    got = columns(spark, [("Recess", 150)], [("8:00-8:40", 100), ("9:00-9:40", 200)])
    assert got == [(1, False, "08:00", "08:40", False), (2, False, "09:00", "09:40", False)]


def matrix(spark, labels):
    def cell(row, col, x0, x1, text):
        return (1, row, col, float(x0), float(x1), text, [text], 0.9)

    cells = [cell(0, 0, 0, 100, ""), cell(0, 1, 100, 300, "Monday"), cell(0, 2, 300, 500, "Tuesday"), *[cell(1, i, 100 * i, 100 * i + 100, x) for i, x in enumerate(["", "3:00-3:30", "3:30-4:00", "3:00-3:30", "3:30-4:00"])]]
    for i, label in enumerate(labels):
        cells += [cell(i + 2, 0, 0, 100, label), cell(i + 2, 1, 100, 300, "Maths")]
    return spark.createDataFrame(cells, "page_id int, row_no int, col_no int, cx0 double, cx1 double, text string, lines array<string>, conf double")


@pytest.mark.parametrize(
    "labels,title,want",
    [
        (["VI", "~", "~", "IX"], "Remedial class VI to X", [("VI", 0.9), ("VII", 0.4), ("VIII", 0.4), ("IX", 0.9)]),
        (["VI", "VI", "VIII"], "Enrichment classes VI to VIII", [("VI", 0.9), ("VII", 0.4), ("VIII", 0.9)]),
        (["VI", "~", "~"], "Remedial class VI to VII", [("VI", 0.9), ("VII", 0.4), ("", 0.9)]),
        (["VI", "~"], "", [("VI", 0.9), ("", 0.9)]),
        (["VIA", "~", "VII"], "class VI to X", [("VI", 0.9), ("", 0.9), ("VII", 0.9)]),
        (["~", "VI", "~"], "Life skill class VI to X remedial", [("", 0.9), ("VI", 0.9), ("VII", 0.4)]),
    ],
)
def test_labels_are_filled_in_by_the_heading(spark, labels, title, want):
    titles = spark.createDataFrame([(1, title)], "page_id int, heading string")
    out = L.remedial_matrix(matrix(spark, labels), headings=titles).collect()
    assert sorted((r["class_name"], r["confidence"]) for r in out) == sorted(want)
    assert {r["category"] for r in out} == {"REMEDIAL" if title.startswith("Remedial") else "ENRICHMENT" if title.startswith("Enrich") else "OTHER"}


def test_deep_pages(spark):
    r = random.Random(5)
    rows = spark.createDataFrame([(i, r.randrange(50)) for i in range(5000)], "event_id long, at int").repartition(6)
    order = [F.col("at").desc(), F.col("event_id").desc()]
    for number in (1, 2, 60, 125, 126):
        want = [tuple(x) for x in R.page_of(rows, number, 40, *order).collect()]
        assert [tuple(x) for x in R.deep_page(rows, number, 40, *order).collect()] == want
        if want and number < 125:
            last = want[-1]
            nxt = R.page_after(rows, [("at", last[1], True), ("event_id", last[0], True)], 40).collect()
            assert [tuple(x) for x in nxt] == [tuple(x) for x in R.page_of(rows, number + 1, 40, *order).collect()]


def test_export_counts_what_is_written(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(100).mapInPandas(count, "id long")
    empty = spark.createDataFrame([], "id long")
    counts = B.export_json({"duty": rows, "club": empty, "notice": spark.range(10).filter("id < 0")}, str(tmp_path / "b"))
    assert {r["name"]: r["rows"] for r in counts.collect()} == {"duty": 100, "club": 0, "notice": 0}
    assert seen.value == 100
    stored = spark.read.json(str(tmp_path / "b" / "_manifest"))
    assert {r["name"]: r["rows"] for r in stored.collect()} == {"duty": 100, "club": 0, "notice": 0}


def test_draft_limits(spark):
    period = '{"id":"p","className":"VI","day":"MONDAY","slot":0%s}'
    rows = [(1, '{"periods":[' + period % ',"room":"%s"' % ("x" * 41) + "]}"), (2, '{"periods":[' + period % ',"room":" %s "' % ("x" * 40) + "]}"), (3, '{"clubs":[{"id":"c","name":"Art","teachers":[%s]}]}' % ",".join(['"a"'] * 61)), (4, '{"session":"%s"}' % ("x" * 41)), (5, '{"periods":[' + ",".join([period % ""] * 6001) + "]}"), (6, '{"weeklyOffs":[{"id":"","day":"MONDAY","teacherName":"A"}]}')]
    good, bad = D.parse_drafts(spark.createDataFrame(rows, "doc_id long, data string"))
    assert {r["doc_id"]: r["problem"] for r in bad.collect()} == {1: "period", 3: "club", 4: "head", 5: "too many in periods", 6: "weekly off"}
    assert [r["doc_id"] for r in good.collect()] == [2]


def test_equal_distances_go_to_the_first_column(spark):
    """0.3 on both sides of 1.1, but for the noise of the last digits."""
    points = spark.createDataFrame([(1, 1, 1.1, 1.1)], "page_id long, seq long, x0 double, x1 double")
    centres = spark.createDataFrame([(1, 0, 0.8), (1, 1, 1.4)], "page_id long, col_no int, xc double")
    assert L.nearest_centre(points, centres).first()["col_no"] == 0
