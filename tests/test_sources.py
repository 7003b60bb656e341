"""Files, drafts, backups and the versioned sink on small inputs."""

from pyspark.sql import functions as F

from rollbook.operators import layout as L
from rollbook.operators import text_jobs as T
from rollbook.sources import backup as B
from rollbook.sources import drafts as D
from rollbook.sources import files as FI
from rollbook.sources import tables


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 text")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 /Launch x")
    (tmp_path / "c.png").write_bytes(b"nope")
    (tmp_path / "d.txt").write_bytes(b"text")
    raw = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    # the binary reader leaves empty files out, so an empty upload is given as a row
    raw = raw.unionByName(spark.createDataFrame([("up/e.docx", bytearray())], "path string, content binary"))
    got = {r["path"].rsplit("/", 1)[1]: r["refusal"] for r in FI.admit_files(raw).collect()}
    assert got == {"a.pdf": None, "b.pdf": "active content", "c.png": "content does not match", "d.txt": "unsupported type", "e.docx": "empty"}
    info = {r["name"]: (r["extension"], r["size_bytes"], r["title"]) for r in FI.ingest_files(spark, str(tmp_path)).collect()}
    assert info["a.pdf"] == (".pdf", 13, "a")


def test_people_list(spark, tmp_path):
    f = tmp_path / "people.txt"
    f.write_text("Mr. A Sen, TGT-SCI, Warden\nTGT-ART = Ms. B Roy\nPGT-CS\tMr. C Das\nMr. D | TGT-HIN\nX\n\n")
    got = sorted(tuple(r) for r in FI.read_people(spark, str(f)).collect())
    assert got == [("Mr. A Sen", "TGT-SCI", "Warden"), ("Mr. C Das", "PGT-CS", None), ("Mr. D", "TGT-HIN", None), ("Ms. B Roy", "TGT-ART", None)]


def test_backup_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "user_id long, username string")
    counts = B.export_json({"app_user": df}, str(tmp_path / "b"))
    assert counts.collect()[0]["rows"] == 2
    back = B.read_backup(spark, str(tmp_path / "b"), {"app_user": "user_id LONG, username STRING"})["app_user"]
    existing = spark.createDataFrame([(1, "x"), (9, "b")], "user_id long, username string")
    assert B.restore_insert_missing(existing, back, [["user_id"], ["username"]], "user_id").count() == 0


def test_drafts(spark):
    rows = [(1, '{"periods":[{"id":"p","className":"VI","day":"MONDAY","slot":0}],"teacherMap":{"A":"NEW"}}'), (2, '{"periods":[{"id":"p","className":"VI","day":"FUNDAY","slot":0}]}'), (3, "{"), (4, None)]
    good, bad = D.parse_drafts(spark.createDataFrame(rows, "doc_id long, data string"))
    assert [r["doc_id"] for r in good.collect()] == [1]
    assert {r["doc_id"]: r["problem"] for r in bad.collect()} == {2: "period", 3: "not a draft", 4: "no data"}
    assert [tuple(r) for r in D.teacher_map(good, ["doc_id"]).collect()] == [(1, "A", "NEW")]


def test_versioned_sink(spark, tmp_path):
    root = str(tmp_path / "v")
    for stamp, n in (("1", 3), ("2", 5)):
        D.publish_version({"period": spark.range(n)}, root, stamp)
    assert D.read_version(spark, root, "period").count() == 5


def test_activity_sink(spark, tmp_path):
    row = spark.createDataFrame([(1, '{"a":1}', None)], "event_id long, old_value string, new_value string").withColumn("created_at", F.lit("2026-01-05 10:00:00").cast("timestamp"))
    D.append_activity(row, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.select(F.variant_get("old_value", "$.a", "int").alias("a")).first()["a"] == 1


def test_entity_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3, None)], tables.ENTITY_SCHEMAS["weekly_off"].replace("school_id INT, teacher_id BIGINT", "school_id INT, teacher_id BIGINT"))
    tables.save_table(df, str(tmp_path), "weekly_off")
    assert tables.load_tables(spark, str(tmp_path), ["weekly_off"])["weekly_off"].count() == 1


def test_html_spans(spark):
    html = (
        "<table><tr><td rowspan=2>D1</td><td>a</td><td colspan=2>b</td></tr><tr><td>c</td><td>d</td><td>e&amp;f</td></tr>"
        "<tr><td>x</td><td>y</td></tr></table><p>after</p>"
    )
    rows = T.html_tables(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    grid = {}
    for r in rows:
        grid.setdefault(r["row_no"], {})[r["col_no"]] = r["text"]
    assert [list(dict(sorted(grid[i].items())).values()) for i in sorted(grid)] == [["D1", "a", "b", "b"], ["D1", "c", "d", "e&f"], ["x", "y"]]


def test_remedial_matrix(spark):
    ys, xs = [0, 40, 80, 140, 200], [0, 100, 200, 300, 400, 500]
    h = spark.createDataFrame([(1, float(y), 0.0, 500.0) for y in ys], "page_id long, y double, x0 double, x1 double")
    v = [(1, float(x), 0.0, 200.0) for x in (0, 100, 300, 500)] + [(1, float(x), 40.0, 200.0) for x in (400,)] + [(1, 200.0, 40.0, 80.0), (1, 200.0, 140.0, 200.0)]
    v = spark.createDataFrame(v, "page_id long, x double, y0 double, y1 double")
    texts = [(150, 20, "Monday"), (350, 20, "Tuesday"), (150, 60, "4:00-4:30"), (250, 60, "4:30-5:00"), (350, 60, "4:00-4:30"), (450, 60, "4:30-5:00"),
             (50, 110, "VI"), (180, 110, "Maths"), (240, 110, "(TGT-MATH)"), (350, 110, "Art"), (50, 170, "VII-A"), (150, 170, "Hindi")]
    words = [(1, i, t, float(x - 3 * len(t)), float(x + 3 * len(t)), float(y - 6), float(y + 6), 90) for i, (x, y, t) in enumerate(texts)]
    words = spark.createDataFrame(words, "page_id long, seq long, word string, x0 double, x1 double, y0 double, y1 double, conf int")
    out = L.remedial_matrix(L.cell_texts(words, L.grid_cells(h, v))).collect()
    got = sorted((r["class_name"], r["section"], r["day"], r["start_time"], r["end_time"], r["activity"], r["teacher_name"]) for r in out)
    assert got == [("VI", "", "MONDAY", "16:00", "17:00", "Maths", "TGT-MATH"), ("VI", "", "TUESDAY", "16:00", "16:30", "Art", ""), ("VII", "A", "MONDAY", "16:00", "16:30", "Hindi", "")]


def test_draft_text_is_parsed_once(spark):
    rows = spark.range(3).select(F.lit('{"kind":"POEM"}').alias("head"), F.col("id").cast("string").alias("n")).select(F.concat("head", "n").alias("data"), "n")
    for df in D.parse_drafts(rows):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_pages_are_dealt_before_their_tables_are_parsed(spark):
    pages = spark.createDataFrame([(1, '<table><tr><td ROWSPAN="2" class=a>x &lt; <b>y</b></td><td>1</td></tr><tr><th colspan=2></th></tr></table>')], "page_id long, html string")
    cells = T._html_cells(pages.coalesce(1), "page_id")
    assert "RepartitionByExpression [page_id" in cells._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["text"], r["down"], r["across"], r["slot"]) for r in cells.orderBy("row_no", "cell_no").collect()] == [("x < y", 2, 1, 0), ("1", 1, 1, 1), ("", 1, 2, 0)]
