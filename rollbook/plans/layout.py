"""Registered page-layout jobs: the words of all documents, and sheets rendered from the data and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.clock import WEEKDAYS
from rollbook.keyed import last_wins
from rollbook.operators import aggregates as A
from rollbook.operators import layout as L
from rollbook.operators import text_jobs as T
from rollbook.plans.registry import query

VER = ["school_id", "version"]
#: Tasks over sheets for each part that the documents are read in.
SHARE = 8

# ---------------------------------------------------------------- words of all documents

_LINED = """w0 AS (SELECT *, (y0 + y1) / 2 AS yc, greatest(2.0, 0.55 * median(y1 - y0) OVER (PARTITION BY page_id)) AS tol FROM f_word WHERE trim(word) <> ''),
 w1 AS (SELECT *, CASE WHEN yc - lag(yc) OVER (PARTITION BY page_id ORDER BY yc, x0, seq) > tol THEN 1 ELSE 0 END AS jump FROM w0),
 w2 AS (SELECT *, CAST(sum(jump) OVER (PARTITION BY page_id ORDER BY yc, x0, seq ROWS UNBOUNDED PRECEDING) AS INTEGER) AS line_no FROM w1),
 lined AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id, line_no ORDER BY x0, seq) AS INTEGER) AS word_no FROM w2)"""


def _tasks(t) -> int:
    """Tasks over sheets. They grow with the parts the documents are read in, at most 128 MB each with Spark's defaults (some 30
    million words), so that none holds more than about four million words, however few partitions a session has."""
    return max(SHARE * t.base("documents").rdd.getNumPartitions(), int(t.spark.conf.get("spark.sql.shuffle.partitions")))


def _sheets(t) -> DataFrame:
    """All words, dealt by sheet."""
    return t.f_word.repartition(_tasks(t), "page_id")


def _lined(t):
    return L.build_lines(_sheets(t))


@query("build_lines", f"WITH {_LINED} SELECT page_id, seq, line_no, word_no FROM lined")
def build_lines(t):
    return _lined(t).select("page_id", "seq", "line_no", "word_no")


@query(
    "line_table",
    f"WITH {_LINED} SELECT page_id, line_no, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, avg(yc) AS yc, string_agg(word, ' ' ORDER BY word_no) AS text, count(*) AS words, avg(conf) AS conf FROM lined GROUP BY ALL",
)
def line_table(t):
    return L.line_table(_lined(t))


@query("page_text", f"WITH {_LINED}, l AS (SELECT page_id, line_no, string_agg(word, ' ' ORDER BY word_no) AS s FROM lined GROUP BY ALL) SELECT page_id, string_agg(s, chr(10) ORDER BY line_no) AS text FROM l GROUP BY ALL")
def page_text(t):
    return L.page_text(_lined(t))


@query(
    "layout_text",
    f"""WITH {_LINED}, h AS (SELECT page_id, median(y1 - y0) AS h FROM lined GROUP BY ALL), g AS (SELECT l.*, x0 - lag(x1) OVER (PARTITION BY page_id, line_no ORDER BY word_no) AS gap, 1.6 * h AS lim FROM lined l JOIN h USING (page_id)),
 l AS (SELECT page_id, line_no, string_agg(CASE WHEN gap IS NULL THEN '' WHEN gap > lim THEN ' | ' ELSE ' ' END || word, '' ORDER BY word_no) AS s FROM g GROUP BY ALL) SELECT page_id, string_agg(s, chr(10) ORDER BY line_no) AS text FROM l GROUP BY ALL""",
)
def layout_text(t):
    return L.page_text(_lined(t), columns=True)


@query("page_confidence", "SELECT page_id, avg(conf) AS conf FROM f_word GROUP BY ALL")
def page_confidence(t):
    return L.page_confidence(t.f_word)


@query("document_confidence", "SELECT doc_id, avg(c) AS conf FROM (SELECT doc_id, page_id, avg(conf) AS c FROM f_word GROUP BY ALL) GROUP BY ALL")
def document_confidence(t):
    return L.document_confidence(L.page_confidence(t.f_word, ["doc_id", "page_id"]))


@query("median_height", "SELECT page_id, median(y1 - y0) AS height FROM f_word GROUP BY ALL")
def median_height(t):
    return L.median_height(t.f_word)


@query("median_spacing", f"WITH {_LINED}, l AS (SELECT page_id, line_no, avg(yc) AS yc FROM lined GROUP BY ALL), s AS (SELECT page_id, yc - lag(yc) OVER (PARTITION BY page_id ORDER BY yc) AS d FROM l) SELECT page_id, median(d) AS spacing FROM s GROUP BY ALL")
def median_spacing(t):
    return L.median_spacing(L.line_table(_lined(t)), "yc")


def _centres(t):
    """Column centres of a page: the mean centre of its words per 140 units."""
    band = F.floor(F.col("x0") / 140).cast("int")
    return t.f_word.groupBy("page_id", band.alias("col_no")).agg(F.avg((F.col("x0") + F.col("x1")) / 2).alias("xc"))


@query(
    "nearest_centre",
    """WITH c AS (SELECT page_id, CAST(floor(x0 / 140) AS INTEGER) AS col_no, avg((x0 + x1) / 2) AS xc FROM f_word GROUP BY ALL)
 SELECT w.page_id, w.seq, arg_min(c.col_no, (round(abs(c.xc - (w.x0 + w.x1) / 2), 9), c.col_no)) AS col_no FROM f_word w JOIN c USING (page_id) GROUP BY ALL""",
)
def nearest_centre(t):
    return L.nearest_centre(t.f_word, _centres(t)).select("page_id", "seq", "col_no")


def _boxes(t):
    row, col = F.floor(F.col("y0") / 90).cast("int"), F.floor(F.col("x0") / 140).cast("int")
    b = t.f_word.select("page_id", row.alias("row_no"), col.alias("col_no")).distinct()
    return b.select(
        "page_id", "row_no", "col_no", (F.col("col_no") * 140.0).alias("cx0"), (F.col("col_no") * 140.0 + 100).alias("cx1"), (F.col("row_no") * 90.0).alias("cy0"), (F.col("row_no") * 90.0 + 90).alias("cy1")
    )


@query(
    "point_in_cell",
    """WITH b AS (SELECT DISTINCT page_id, CAST(floor(y0 / 90) AS INTEGER) AS row_no, CAST(floor(x0 / 140) AS INTEGER) AS col_no FROM f_word)
 SELECT w.page_id, w.seq, b.row_no, b.col_no FROM f_word w JOIN b USING (page_id) WHERE (w.x0 + w.x1) / 2 >= b.col_no * 140 AND (w.x0 + w.x1) / 2 < b.col_no * 140 + 100
 AND (w.y0 + w.y1) / 2 >= b.row_no * 90 AND (w.y0 + w.y1) / 2 < b.row_no * 90 + 90""",
)
def point_in_cell(t):
    return L.point_in_cell(t.f_word, _boxes(t)).select("page_id", "seq", "row_no", "col_no")


@query(
    "row_bands",
    """WITH lab AS (SELECT page_id, CAST(seq // 50 AS INTEGER) AS row_no, avg((y0 + y1) / 2) AS yc FROM f_word WHERE seq % 50 < 10 GROUP BY ALL), h AS (SELECT page_id, median(y1 - y0) AS h FROM f_word GROUP BY ALL),
 n AS (SELECT w.page_id, w.seq, (w.y0 + w.y1) / 2 AS y, arg_min((w.y0 + w.y1) / 2 - l.yc, (abs(l.yc - (w.y0 + w.y1) / 2), l.row_no)) AS dy FROM f_word w JOIN lab l USING (page_id) GROUP BY ALL),
 t AS (SELECT n.page_id, count(*) FILTER (dy < -0.6 * h) AS a, count(*) FILTER (dy > 0.6 * h) AS b FROM n JOIN h USING (page_id) GROUP BY ALL), k AS (SELECT page_id, count(*) AS k FROM lab GROUP BY ALL),
 e AS (SELECT l.page_id, l.row_no, CASE WHEN k >= 2 AND b > 0 AND a <= 0.05 * b THEN l.yc - 0.6 * h ELSE coalesce((lag(l.yc) OVER (PARTITION BY l.page_id ORDER BY l.yc) + l.yc) / 2, -1e9) END AS edge, k >= 2 AND b > 0 AND a <= 0.05 * b AS top_aligned
  FROM lab l JOIN h USING (page_id) JOIN t USING (page_id) JOIN k USING (page_id))
 SELECT n.page_id, n.seq, coalesce(max(e.row_no) FILTER (e.edge <= n.y), 0) AS row_no, bool_or(e.top_aligned) AS top_aligned FROM n JOIN e USING (page_id) GROUP BY n.page_id, n.seq""",
)
def row_bands(t):
    lab = t.f_word.filter("seq % 50 < 10").groupBy("page_id", F.floor(F.col("seq") / 50).cast("int").alias("row_no")).agg(F.avg((F.col("y0") + F.col("y1")) / 2).alias("yc"))
    return L.row_bands(t.f_word, lab).select("page_id", "seq", "row_no", "top_aligned")


@query(
    "carry_down",
    "SELECT doc_id, pos, last_value(CASE WHEN length(line) < 60 AND line <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS heading FROM f_line",
)
def carry_down(t):
    d = t.f_line.withColumn("heading", F.when((F.length("line") < 60) & (F.col("line") != ""), F.col("line")))
    return L.carry_down(d, ["doc_id"], ["pos"], ["heading"]).select("doc_id", "pos", "heading")


@query(
    "fill_period_numbers",
    """WITH RECURSIVE s AS (SELECT page_id, seq // 10 AS line, CAST(seq % 10 + 1 AS INTEGER) AS i, CASE WHEN length(word) % 3 = 0 THEN NULL ELSE CAST(length(word) AS INTEGER) END AS number FROM f_word),
 r AS (SELECT page_id, line, i, greatest(coalesce(number, 1), 1) AS filled FROM s WHERE i = 1 UNION ALL SELECT s.page_id, s.line, s.i, greatest(r.filled + 1, coalesce(s.number, 0)) FROM r JOIN s ON s.page_id = r.page_id AND s.line = r.line AND s.i = r.i + 1)
 SELECT page_id, line, i, filled FROM r""",
)
def fill_period_numbers(t):
    d = t.f_word.select(
        "page_id", F.floor(F.col("seq") / 10).alias("line"), (F.col("seq") % 10 + 1).cast("int").alias("i"), F.when(F.length("word") % 3 != 0, F.length("word")).alias("number")
    )
    return L.fill_period_numbers(d, ["page_id", "line"], "i").select("page_id", "line", "i", "filled")


@query(
    "infer_breaks",
    """WITH c AS (SELECT school_id, version, class_name, section, slot, arg_min(is_break, seq) AS is_break, arg_min(start_min, seq) AS s, arg_min(end_min, seq) AS e FROM f_period GROUP BY ALL),
 n AS (SELECT *, lead(s) OVER w AS ns, lead(is_break) OVER w AS nb, lead(slot) OVER w AS nslot FROM c WINDOW w AS (PARTITION BY school_id, version, class_name, section ORDER BY slot))
 SELECT school_id, version, class_name, section, (slot + nslot) / 2 AS slot, e AS start_min, ns AS end_min FROM n WHERE NOT is_break AND NOT nb AND ns > e""",
)
def infer_breaks(t):
    return L.infer_breaks(A.slot_header(t.f_period, VER), [*VER, "class_name", "section"], "slot")


# ---------------------------------------------------------------- timetable sheets rendered from the periods, read back


def _word(x: Column, y: Column, text: Column) -> Column:
    return F.struct(text.alias("word"), x.cast("double").alias("x0"), (x + F.length(text) * 6).cast("double").alias("x1"), (y - 6).cast("double").alias("y0"), (y + 6).cast("double").alias("y1"))


def _clock(m: str) -> Column:
    h = F.floor(F.col(m) / 60)
    return F.concat(F.when(h > 12, h - 12).otherwise(h).cast("string"), F.lit(":"), F.lpad((F.col(m) % 60).cast("string"), 2, "0"))


def sheet_words(t) -> DataFrame:
    """One sheet per version and class-section, as a school prints it: heading, times, ordinals, a row per weekday."""
    key = [*VER, "class_name", "section"]
    page = F.concat_ws("|", F.col("school_id").cast("string"), F.col("version").cast("string"), "class_name", "section").alias("page_id")
    heads = A.slot_header(t.f_period, VER)
    x = F.col("slot") * 140 + 100
    mark = F.when(F.col("is_break"), F.lit("BREAK")).otherwise(
        F.concat(F.col("period_number").cast("string"), F.element_at(F.array(*[F.lit(s) for s in ("st", "nd", "rd")]), F.least(F.col("period_number"), F.lit(3))))
    )
    mark = F.when(F.col("period_number") > 3, F.concat(F.col("period_number").cast("string"), F.lit("th"))).otherwise(mark)
    top = heads.select(page, F.explode(F.array(_word(x, F.lit(58), F.concat(_clock("start_min"), F.lit("-"), _clock("end_min"))), _word(x + 10, F.lit(76), mark))).alias("w"))
    title = F.when(F.col("section") == "", F.col("class_name")).otherwise(F.concat_ws("-", "class_name", "section"))
    name = heads.select(*key).distinct().select(page, F.explode(F.array(_word(F.lit(10), F.lit(40), F.lit("CLASS")), _word(F.lit(50), F.lit(40), title))).alias("w"))
    y = F.col("day_idx") * 36 + 94
    day = F.initcap(F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("day_idx") + 1))
    days = t.f_period.select(*key, "day_idx").distinct().select(page, F.explode(F.array(_word(F.lit(10), y, day))).alias("w"))
    cells = last_wins(t.f_period.filter("not is_break"), [*key, "day_idx", "slot"])
    cells = cells.join(t.f_teacher.select("school_id", "teacher_id", "code"), ["school_id", "teacher_id"], "left")
    words = F.array_compact(
        F.array(F.when(F.col("subject") != "", _word(x + 15, y - 7, F.col("subject"))), F.when(F.col("code").isNotNull(), _word(x, y + 7, F.concat(F.lit("("), "code", F.lit(")")))))
    )
    body = cells.select(page, F.explode(words).alias("w"))
    out = top.unionByName(name).unionByName(days).unionByName(body)
    out = out.select("page_id", "w.*", F.lit(96).alias("conf"))
    return out.withColumn("seq", F.xxhash64("word", "x0", "y0"))


_SHEET = """cells AS (SELECT * FROM f_period WHERE NOT is_break QUALIFY row_number() OVER (PARTITION BY school_id, version, class_name, section, day_idx, slot ORDER BY seq DESC) = 1),
 pg AS (SELECT school_id, version, class_name, section FROM f_period GROUP BY ALL HAVING count(DISTINCT day_idx) >= 2 AND count(DISTINCT slot) >= 2),
 hd AS (SELECT school_id, version, class_name, section, slot, arg_min(start_min, seq) AS s FROM f_period GROUP BY ALL)"""


@query(
    "read_timetables",
    f"""WITH {_SHEET} SELECT CAST(c.school_id AS VARCHAR) || '|' || c.version || '|' || class_name || '|' || section AS page_id, class_name, section,
 ['MONDAY','TUESDAY','WEDNESDAY','THURSDAY','FRIDAY','SATURDAY'][c.day_idx + 1] AS day, lpad(CAST(hd.s // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(hd.s % 60 AS VARCHAR), 2, '0') AS start_time, c.subject, coalesce(t.code, '') AS teacher_name
 FROM cells c JOIN pg USING (school_id, version, class_name, section) JOIN hd USING (school_id, version, class_name, section, slot) LEFT JOIN f_teacher t ON t.school_id = c.school_id AND t.teacher_id = c.teacher_id
 WHERE c.subject <> '' OR t.code IS NOT NULL""",
)
def read_timetables(t):
    out = L.read_timetables(sheet_words(t)).filter("not is_break")
    return out.select("page_id", "class_name", "section", "day", "start_time", "subject", "teacher_name")


@query("find_headings", "SELECT DISTINCT CAST(school_id AS VARCHAR) || '|' || version || '|' || class_name || '|' || section AS page_id, class_name, section FROM f_period")
def find_headings(t):
    lines = L.line_table(L.build_lines(sheet_words(t)))
    return L.find_headings(lines).filter("is_heading").select("page_id", "class_name", "section")


@query(
    "detect_columns",
    """WITH h AS (SELECT school_id, version, class_name, section, slot, arg_min(is_break, seq) AS brk, arg_min(start_min, seq) AS s, arg_min(end_min, seq) AS e FROM f_period GROUP BY ALL),
 n AS (SELECT *, count(*) OVER (PARTITION BY school_id, version, class_name, section) AS k FROM h)
 SELECT CAST(school_id AS VARCHAR) || '|' || version || '|' || class_name || '|' || section AS page_id, brk AS is_break, lpad(CAST(s // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS start_time,
 lpad(CAST(e // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(e % 60 AS VARCHAR), 2, '0') AS end_time FROM n WHERE k >= 3""",
)
def detect_columns(t):
    head = L.build_lines(sheet_words(t)).filter("line_no in (1, 2)")
    cols = L.detect_columns(head, ["page_id"]).filter("not inferred")
    enough = cols.groupBy("page_id").agg(F.count(F.lit(1)).alias("k")).filter("k >= 3")
    return cols.join(enough, "page_id", "left_semi").select("page_id", "is_break", "start_time", "end_time")


# ---------------------------------------------------------------- ruled pages


def _rules(t):
    """A ruled frame around the words of each page: a line every 90 units down and every 140 across."""
    size = t.f_word.groupBy("page_id").agg(F.ceil(F.max("y1") / 90).cast("int").alias("k"))
    down = F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: i * 90.0)
    h = size.select("page_id", F.explode(down).alias("y"), F.lit(0.0).alias("x0"), F.lit(700.0).alias("x1"))
    v = size.select("page_id", F.explode(F.array(*[F.lit(i * 140.0) for i in range(6)])).alias("x"), F.lit(0.0).alias("y0"), (F.col("k") * 90.0).alias("y1"))
    return h, v


_GRID = """k AS (SELECT page_id, CAST(ceil(max(y1) / 90) AS INTEGER) AS k FROM f_word GROUP BY ALL),
 g AS (SELECT page_id, CAST(r AS INTEGER) AS row_no, CAST(c AS INTEGER) AS col_no FROM (SELECT page_id, unnest(range(k)) AS r FROM k WHERE k >= 2) CROSS JOIN (SELECT unnest(range(5)) AS c))"""


@query("grid_cells", f"WITH {_GRID} SELECT page_id, row_no, col_no, CAST(col_no * 140 AS DOUBLE) AS cx0, CAST(col_no * 140 + 140 AS DOUBLE) AS cx1, CAST(row_no * 90 AS DOUBLE) AS cy0, CAST(row_no * 90 + 90 AS DOUBLE) AS cy1 FROM g")
def grid_cells(t):
    return L.grid_cells(*_rules(t))


@query(
    "cell_texts",
    f"""WITH {_GRID}, w AS (SELECT page_id, CAST(floor((y0 + y1) / 180) AS INTEGER) AS row_no, CAST(floor((x0 + x1) / 280) AS INTEGER) AS col_no, word, conf FROM f_word WHERE trim(word) <> '')
 SELECT g.page_id, g.row_no, g.col_no, count(w.word) AS words, coalesce(round(avg(w.conf) / 100, 6), 0) AS conf FROM g LEFT JOIN w USING (page_id, row_no, col_no) GROUP BY ALL""",
)
def cell_texts(t):
    out = L.cell_texts(t.f_word, L.grid_cells(*_rules(t)))
    words = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", " ")))
    return out.select("page_id", "row_no", "col_no", words.cast("long").alias("words"), F.round("conf", 6).alias("conf"))


# ---------------------------------------------------------------- heads with misread ordinals and breaks far from every time range

_HEADS = """SELECT school_id * 100 + day_idx AS page_id, slot, min(start_min) AS s, max(end_min) AS e FROM f_period WHERE version = 2 AND slot < 7 AND class_name = 'VI' GROUP BY ALL"""
_MISREAD = ["lst", "2nd", "3rd", "4th", "Sth", "6th", "7th"]


def _head_words(t):
    """Two lines: ordinals (some as a scan shows them) and, under each, its time range; a break word three columns on."""
    d = t.sql(_HEADS.replace("GROUP BY ALL", "GROUP BY school_id * 100 + day_idx, slot"))
    clock = lambda c: F.format_string("%02d:%02d", F.floor(F.col(c) / 60).cast("int"), (F.col(c) % 60).cast("int"))
    x = F.col("slot") * 100.0 + 50
    top = d.select("page_id", F.lit(0).alias("line_no"), F.element_at(F.array(*[F.lit(w) for w in _MISREAD]), F.col("slot") + 1).alias("word"), x.alias("x"))
    low = d.select("page_id", F.lit(1).alias("line_no"), F.concat(clock("s"), F.lit("-"), clock("e")).alias("word"), x.alias("x"))
    far = d.groupBy("page_id").agg((F.max("slot") * 100.0 + 350).alias("x")).select("page_id", F.lit(0).alias("line_no"), F.lit("RECESS").alias("word"), "x")
    words = top.unionByName(low).unionByName(far)
    y = F.col("line_no") * 20.0
    order = Window.partitionBy("page_id", "line_no").orderBy("x")
    return words.select("page_id", "line_no", (F.row_number().over(order) - 1).alias("word_no"), "word", (F.col("x") - 12).alias("x0"), (F.col("x") + 12).alias("x1"), y.alias("y0"), (y + 10).alias("y1"), F.lit(90).alias("conf"))


@query(
    "misread_heads",
    f"""WITH h AS (SELECT * FROM ({_HEADS}) QUALIFY count(*) OVER (PARTITION BY page_id) >= 3),
 c AS (SELECT page_id, slot, CAST(slot + 1 AS INTEGER) AS number, false AS is_break, lpad(CAST(s // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS start_time, lpad(CAST(e // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(e % 60 AS VARCHAR), 2, '0') AS end_time FROM h
  UNION ALL SELECT page_id, max(slot) + 3, NULL, true, NULL, NULL FROM h GROUP BY ALL)
 SELECT page_id, number, is_break, start_time, end_time FROM c""",
)
def misread_heads(t):
    cols = L.detect_columns(_head_words(t), ["page_id"]).filter("not inferred")
    enough = cols.filter("not is_break").groupBy("page_id").agg(F.count(F.lit(1)).alias("k")).filter("k >= 3")
    return cols.join(enough, "page_id", "left_semi").select("page_id", "number", "is_break", "start_time", "end_time")


# ---------------------------------------------------------------- matrices of extra classes with labels that cannot be read

_CLASSES = ["VI", "VII", "VIII", "IX", "X", "XI", "XII"]
_MATRIX = f"""SELECT s.school_id AS page_id, CAST(k AS INTEGER) AS k, {_CLASSES}[k + 1] AS class_name, coalesce(nullif(trim(m.activity), ''), 'Sport') AS activity, 1 - (s.school_id % 5) / 10.0 AS conf, k > 0 AND (s.school_id + k) % 3 < 2 AS unread
 FROM (SELECT DISTINCT school_id FROM f_teacher) s CROSS JOIN range(7) g(k) LEFT JOIN (SELECT school_id, seq % 7 AS k, arg_max(activity, seq) AS activity FROM f_remedial GROUP BY ALL) m USING (school_id, k)"""


def _matrix_cells(t):
    """A matrix a school: two days over two sessions each; one class spans both sessions of Monday. A third of the labels is
    unreadable, a third repeats the class above."""
    latest = t.f_remedial.groupBy("school_id", (F.col("seq") % 7).cast("int").alias("k")).agg(F.max_by("activity", "seq").alias("activity"))
    names = F.array(*[F.lit(c) for c in _CLASSES])
    rows = t.f_teacher.select("school_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6)))).join(latest, ["school_id", "k"], "left")
    turn = (F.col("school_id") + F.col("k")) % 3
    label = F.when(F.col("k") == 0, F.lit("VI")).when(turn == 0, F.lit("~")).when(turn == 1, F.element_at(names, F.col("k"))).otherwise(F.element_at(names, F.col("k") + 1))

    def cell(row, col, x0, x1, text):
        return F.struct(row.cast("int").alias("row_no"), F.lit(col).alias("col_no"), F.lit(float(x0)).alias("cx0"), F.lit(float(x1)).alias("cx1"), text.alias("text"))

    head = [cell(F.lit(0), 0, 0, 100, F.lit("")), cell(F.lit(0), 1, 100, 300, F.lit("Monday")), cell(F.lit(0), 2, 300, 500, F.lit("Tuesday"))]
    head += [cell(F.lit(1), i, 100 * i, 100 * i + 100, F.lit(x)) for i, x in enumerate(["", "3:00-3:30", "3:30-4:00", "3:00-3:30", "3:30-4:00"])]
    said = F.coalesce(F.nullif(F.trim("activity"), F.lit("")), F.lit("Sport"))
    body = [cell(F.col("k") + 2, 0, 0, 100, label), cell(F.col("k") + 2, 1, 100, 300, said), cell(F.col("k") + 2, 2, 300, 400, said), cell(F.col("k") + 2, 3, 400, 500, F.lit(""))]
    heads = rows.filter("k = 0").select("school_id", F.explode(F.array(*head)).alias("c"))
    out = heads.unionByName(rows.select("school_id", F.explode(F.array(*body)).alias("c"))).select(F.col("school_id").alias("page_id"), "c.*")
    return out.withColumn("lines", F.array("text")).withColumn("conf", 1 - (F.col("page_id") % 5) / 10.0)


@query(
    "remedial_matrix",
    f"""SELECT page_id, 'REMEDIAL' AS category, class_name, '' AS section, d.day, d.s AS start_time, d.e AS end_time, activity, '' AS teacher_name,
 round(least(0.99, greatest(0.05, CASE WHEN unread THEN least(0.4, conf) ELSE conf END)), 2)::DOUBLE AS confidence FROM ({_MATRIX}) CROSS JOIN (VALUES ('MONDAY', '15:00', '16:00'), ('TUESDAY', '15:00', '15:30')) d(day, s, e)""",
)
def remedial_matrix(t):
    cells = _matrix_cells(t)
    title = cells.select("page_id").distinct().withColumn("heading", F.lit("Remedial classes for Class VI to XII"))
    return L.remedial_matrix(cells, headings=title)


# ---------------------------------------------------------------- duty tables and lists rendered from the duties


def _printed_day() -> Column:
    return F.concat_ws("/", F.dayofmonth("duty_date").cast("string"), F.month("duty_date").cast("string"), (F.year("duty_date") + 20).cast("string"))


def _duty_pages(t):
    """One HTML roster per duty; the second row shares the date by a row span and names nobody."""
    d = t.f_duty.join(t.f_teacher.select("school_id", "teacher_id", "name", "code"), ["school_id", "teacher_id"])
    mod = F.concat(
        F.lit("<p>Roster &amp; list</p><table><tr><th>S.No</th><th>Date</th><th>Day</th><th>M.O.D.</th><th>Designation</th></tr><tr><td>1</td><td rowspan=\"2\">"), _printed_day(),
        F.lit("</td><td>x</td><td><p>"), "name", F.lit("</p></td><td>"), "code", F.lit("</td></tr><tr><td>2</td><td>y</td><td></td><td>Warden</td></tr></table>"),
    )
    holiday = F.concat(
        F.lit("<table><tr><td>Sl</td><td>Date</td><td>Name</td><td>Allotted House</td><td>Class Assigned</td><td>Weekly Off</td></tr><tr><td>1</td><td>"), _printed_day(), F.lit("</td><td>3. "), "name",
        F.lit(" "), "code", F.lit("</td><td colspan=\"2\">Red</td><td>"), _printed_day(), F.lit("</td></tr><tr><td>2</td><td></td><td>"), "name", F.lit("</td><td>Blue</td></tr></table>"),
    )
    return d.select(F.col("duty_id").alias("page_id"), F.when(F.col("duty_type") == "MOD", mod).otherwise(holiday).alias("html"))


_PD = "CAST(day(duty_date) AS VARCHAR) || '/' || CAST(month(duty_date) AS VARCHAR) || '/' || CAST(year(duty_date) + 20 AS VARCHAR)"
_SHIFT = "make_date(year(duty_date) + 20, month(duty_date), day(duty_date))"
_DT = "f_duty d JOIN f_teacher t USING (school_id, teacher_id)"


@query(
    "html_tables",
    f"""WITH x AS (SELECT duty_id, duty_type, {_PD} AS d, t.name, t.code FROM {_DT}),
 m AS (SELECT duty_id AS page_id, [['S.No', 'Date', 'Day', 'M.O.D.', 'Designation'], ['1', d, 'x', name, code], ['2', d, 'y', '', 'Warden']] AS g FROM x WHERE duty_type = 'MOD'
  UNION ALL SELECT duty_id, [['Sl', 'Date', 'Name', 'Allotted House', 'Class Assigned', 'Weekly Off'], ['1', d, '3. ' || name || ' ' || code, 'Red', 'Red', d], ['2', '', name, 'Blue']] FROM x WHERE duty_type = 'HOLIDAY'),
 r AS (SELECT page_id, unnest(g) AS row, CAST(generate_subscripts(g, 1) - 1 AS INTEGER) AS row_no FROM m)
 SELECT page_id, 0 AS table_no, row_no, unnest(row) AS text, CAST(generate_subscripts(row, 1) - 1 AS INTEGER) AS col_no FROM r""",
)
def html_tables(t):
    return T.html_tables(_duty_pages(t))


@query("html_headings", "SELECT duty_id AS page_id, 0 AS table_no, CASE WHEN duty_type = 'MOD' THEN 'Roster & list' ELSE '' END AS heading FROM f_duty")
def html_headings(t):
    return T.html_headings(_duty_pages(t))


@query(
    "duty_table_rows",
    f"""SELECT duty_id AS page_id, 1 AS row_no, {_SHIFT} AS duty_date, t.name AS teacher_name, duty_type, t.code AS designation, CASE WHEN duty_type = 'HOLIDAY' THEN 'Red' END AS house, CASE WHEN duty_type = 'HOLIDAY' THEN 'Red' END AS classes,
 CASE WHEN duty_type = 'HOLIDAY' THEN {_SHIFT} END AS off_date FROM {_DT}
 UNION ALL SELECT duty_id, 2, {_SHIFT}, t.name, duty_type, NULL, 'Blue', NULL, NULL FROM {_DT} WHERE duty_type = 'HOLIDAY'""",
)
def duty_table_rows(t):
    return L.duty_table_rows(T.html_tables(_duty_pages(t)).drop("table_no"), ["page_id"])[0]


def _headed_pages(t):
    """Lists whose columns do not tell their kind; the text above does."""
    d = t.f_duty.join(t.f_teacher.select("school_id", "teacher_id", "name"), ["school_id", "teacher_id"])
    title = F.when(F.col("duty_type") == "HOLIDAY", F.lit("Sunday duty list")).when(F.col("duty_id") % 3 == 0, F.lit("Staff list")).otherwise(F.lit("MOD roster"))
    html = F.concat(
        F.lit("<p>School</p><p>"), title, F.lit("</p><table><tr><td>Date</td><td>Name</td><td>Class</td><td>Weekly Off</td></tr><tr><td>"), _printed_day(), F.lit("</td><td>"), "name",
        F.lit(" (MOD)</td><td>VI</td><td>"), _printed_day(), F.lit("</td></tr></table>"),
    )
    return d.select(F.col("duty_id").alias("page_id"), html.alias("html"))


@query(
    "described_duties",
    f"""SELECT duty_id AS page_id, {_SHIFT} AS duty_date, t.name AS teacher_name, duty_type, CASE WHEN duty_type = 'HOLIDAY' THEN 'VI' END AS classes,
 CASE WHEN duty_type = 'HOLIDAY' THEN 'Class VI · weekly off ' || strftime({_SHIFT}, '%d-%m-%Y') || ' · MOD' ELSE '' END AS description,
 CASE WHEN duty_id % 4 = 0 THEN round(greatest(0.05, least(0.99, (duty_id % 120) / 100.0)), 2)::DOUBLE ELSE 0.97::DOUBLE END AS confidence FROM {_DT} WHERE duty_type = 'HOLIDAY' OR duty_id % 3 <> 0""",
)
def described_duties(t):
    pages = _headed_pages(t)
    sources = pages.select("page_id", (F.col("page_id") % 4 == 0).alias("from_scan"), (F.col("page_id") % 120).cast("double").alias("mean_conf"))
    heads = T.html_headings(pages).drop("table_no")
    out = L.described_duties(T.html_tables(pages).drop("table_no"), ["page_id"], heads, sources)
    return out.select("page_id", "duty_date", "teacher_name", "duty_type", "classes", "description", "confidence")


@query("grid_cells_on_wide_sheets", f"WITH {_GRID} SELECT page_id, row_no, col_no FROM g WHERE page_id % 2 = 0")
def grid_cells_on_wide_sheets(t):
    """On every second sheet the widest line is under 40 % of the sheet: no table."""
    h, v = _rules(t)
    sizes = h.select("page_id").distinct().withColumn("width", F.when(F.col("page_id") % 2 == 0, F.lit(1700.0)).otherwise(F.lit(1800.0)))
    return L.grid_cells(h, v, sizes=sizes).select("page_id", "row_no", "col_no")


@query("duty_table_problems", f"SELECT duty_id AS page_id, 2 AS row_no, {_SHIFT} AS duty_date, '' AS name, 'no person named' AS problem FROM f_duty WHERE duty_type = 'MOD'")
def duty_table_problems(t):
    return L.duty_table_rows(T.html_tables(_duty_pages(t)).drop("table_no"), ["page_id"])[1]


def _list_lines(df: DataFrame, page: str, *texts: Column) -> DataFrame:
    out = df.select(F.col(page).alias("page_id"), F.posexplode(F.array(*texts)).alias("line_no", "text"))
    none = F.lit(None).cast("string")
    return out.select("page_id", "line_no", "text", F.size(F.split("text", " ")).alias("words"), F.lit(90.0).alias("conf"), F.lit(False).alias("is_heading"), none.alias("class_name"), none.alias("section"))


_D = "['MONDAY','TUESDAY','WEDNESDAY','THURSDAY','FRIDAY','SATURDAY','SUNDAY']"


@query("list_weekly_offs", f"SELECT o.teacher_id AS page_id, 1 AS line_no, {_D}[o.day_idx + 1] AS day, t.name AS teacher_name, CAST(0.9 AS DOUBLE) AS confidence FROM f_weekly_off o JOIN f_teacher t USING (school_id, teacher_id) UNION ALL SELECT o.teacher_id, 2, {_D}[o.day_idx + 1], t.code, 0.9 FROM f_weekly_off o JOIN f_teacher t USING (school_id, teacher_id)")
def list_weekly_offs(t):
    d = t.f_weekly_off.join(t.f_teacher.select("school_id", "teacher_id", "name", "code"), ["school_id", "teacher_id"])
    day = F.initcap(F.element_at(F.array(*[F.lit(x) for x in WEEKDAYS]), F.col("day_idx") + 1))
    return L.list_weekly_offs(_list_lines(d, "teacher_id", F.lit("WEEKLY OFF LIST"), F.concat(day, F.lit(": "), "name"), F.col("code"), F.lit("DUTY ROSTER"), F.lit("Mr. Not Listed")))


@query("list_duties", f"SELECT duty_id AS page_id, 1 AS line_no, {_SHIFT} AS duty_date, t.name AS teacher_name, CAST(0.9 AS DOUBLE) AS confidence FROM {_DT} WHERE duty_type = 'MOD' UNION ALL SELECT duty_id, 2, {_SHIFT}, 'Mr. Second Man', 0.9 FROM {_DT} WHERE duty_type = 'MOD'")
def list_duties(t):
    d = t.f_duty.filter("duty_type = 'MOD'").join(t.f_teacher.select("school_id", "teacher_id", "name"), ["school_id", "teacher_id"])
    return L.list_duties(_list_lines(d, "duty_id", F.lit("MASTER ON DUTY"), F.concat(_printed_day(), F.lit(" | "), "name"), F.lit("and Mr. Second Man"), F.concat(F.lit("Monday: "), "name")))


@query(
    "list_remedial",
    f"""SELECT r.seq AS page_id, 1 AS line_no, 'REMEDIAL' AS category, class_name, section, {_D}[day_idx + 1] AS day, lpad(CAST(start_min // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start_min % 60 AS VARCHAR), 2, '0') AS start_time,
 lpad(CAST(end_min // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(end_min % 60 AS VARCHAR), 2, '0') AS end_time, activity, t.code AS teacher_name, CAST(0.9 AS DOUBLE) AS confidence FROM f_remedial r JOIN f_teacher t USING (school_id, teacher_id) WHERE day_idx IS NOT NULL""",
)
def list_remedial(t):
    d = t.f_remedial.filter("day_idx is not null").join(t.f_teacher.select("school_id", "teacher_id", "code"), ["school_id", "teacher_id"])
    day = F.initcap(F.element_at(F.array(*[F.lit(x) for x in WEEKDAYS]), F.col("day_idx") + 1))
    label = F.when(F.col("section") == "", F.col("class_name")).otherwise(F.concat_ws("-", "class_name", "section"))
    line = F.concat_ws(" ", label, day, F.concat(_clock("start_min"), F.lit(" - "), _clock("end_min")), "activity", F.concat(F.lit("("), "code", F.lit(")")))
    return L.list_remedial(_list_lines(d, "seq", F.lit("Remedial classes"), line))


@query(
    "list_clubs",
    """WITH p AS (SELECT club_id, activities_text FROM f_club), a AS (SELECT DISTINCT club_id, trim(unnest(string_split(activities_text, ';'))) AS v FROM p)
 SELECT club_id AS page_id, 1 AS club_no, 'Science & Nature Club' AS name, 'club' AS role, '' AS value FROM p UNION ALL SELECT club_id, 1, 'Science & Nature Club', 'activity', v FROM a
 UNION ALL SELECT club_id, 1, 'Science & Nature Club', 'member', 'Mr. Anil Roy' FROM p UNION ALL SELECT club_id, 1, 'Science & Nature Club', 'member', 'Mrs. Bina Das' FROM p""",
)
def list_clubs(t):
    return L.list_clubs(_list_lines(t.f_club, "club_id", F.lit("1. Science & Nature Club :"), F.lit("Members: Mr. Anil Roy, Mrs. Bina Das"), F.concat(F.lit("Activities - "), "activities_text")))


@query(
    "route_extractors",
    r"""WITH r AS (SELECT doc_id, max(CAST(regexp_matches(line, 'remedial|enrichment|life\s*skill|er', 'i') AS INT)) = 1 AS rem FROM (SELECT doc_id, pos, line FROM f_line) WHERE pos < 12 AND regexp_matches(line, 'remedial|enrichment|life\s*skill', 'i') GROUP BY ALL)
 SELECT d.doc_id, d.kind, CASE WHEN d.kind IN ('REMEDIAL', 'CLUB') AND l.has_schedule THEN 'duty' WHEN d.kind = 'REMEDIAL' OR (d.kind IN ('ROUTINE', 'OTHER') AND coalesce(r.rem, false)) THEN 'remedial' WHEN d.kind = 'CLUB' THEN 'club'
 WHEN l.has_schedule THEN 'timetable+duty' ELSE 'timetable+lists' END AS reader FROM f_doc d JOIN f_doc_link l USING (doc_id) LEFT JOIN r USING (doc_id)""",
)
def route_extractors(t):
    lines = t.f_line.select("doc_id", F.col("pos").alias("line_no"), F.col("line").alias("text"))
    return L.route_extractors(t.f_doc.select("doc_id", "kind"), lines, t.f_doc_link.filter("has_schedule"))


@query("split_cells", "SELECT school_id, seq, subject, coalesce(code, '') AS teacher, false AS repaired FROM f_period p LEFT JOIN f_teacher t USING (school_id, teacher_id) WHERE NOT is_break AND (subject <> '' OR code IS NOT NULL)")
def split_cells(t):
    d = t.f_period.filter("not is_break").join(t.f_teacher.select("school_id", "teacher_id", "code"), ["school_id", "teacher_id"], "left")
    form = F.col("line_key") % 4
    code = F.coalesce("code", F.lit(""))
    bracket = F.array(F.concat_ws(" ", "subject", F.concat(F.lit("("), "code", F.lit(")"))))
    cell = F.when(form == 0, F.array("subject", code)).when(form == 1, F.array(F.concat_ws(" - ", "subject", "code"))).when(form == 2, F.array(F.concat_ws(" ", "subject", "code"))).otherwise(bracket)
    return T.split_cells(d.withColumn("lines", cell), "lines", ["school_id", "seq"])
