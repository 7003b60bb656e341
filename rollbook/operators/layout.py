"""Positioned words to lines, columns, cells and records.

Input: words (page, seq, word, x0, x1, y0, y1, conf) and rules (page, y, x0, x1 / x, y0, y1). A page is one sheet of
paper, so per-page windows are small whatever the number of pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions import text as X
from rollbook.functions.cells import split_cell
from rollbook.functions.people import classify
from rollbook.keyed import first_rows, running_last, with_value
from rollbook.session import cut_lineage

PAGE = ("page_id",)

HEADING = r"(?i)\bCLASS(?:ES)?\s*[-:.]?\s*([VXIl1|]{1,5}|\d{1,2}(?:st|nd|rd|th)?)(?![A-Za-z])\s*(?:[-–—/(,.\s'\"‘’“”`]*\b([A-F])\b)?"
LONE_HEADING = r"(?i)^\s*([VXIl1|]{1,5})\s*[-–—(,]\s*['\"‘’]?([A-F])['\"’)]?\s*$"
ORDINAL = r"(?i)^([A-Za-z0-9]{1,2})(st|nd|rd|th)$"
# Letters that a scan may show for a digit.
LOOK_ALIKES = {"i": 1, "l": 1, "s": 5, "b": 8, "o": 0, "g": 9}
NUMBERED = r"(?i)^(?:PERIOD|P)[-.]?(\d{1,2})$"


def _xc(p: str = "") -> Column:
    return (F.col(f"{p}x0") + F.col(f"{p}x1")) / 2


def _yc() -> Column:
    return (F.col("y0") + F.col("y1")) / 2


# ---------------------------------------------------------------- lines: E11, G12, G13, W1


def build_lines(words: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Words with line_no and word_no. A line goes on while the next word (top-down) is within
    max(2, 0.55 x median height) of the word before it."""
    w = Window.partitionBy(*page)
    down = w.orderBy("yc", "x0", "seq")
    height = F.col("y1") - F.col("y0")
    out = words.filter(F.trim("word") != "").withColumn("yc", _yc())
    out = out.withColumn("_tol", F.greatest(F.lit(2.0), F.coalesce(F.median(F.when(height > 0, height)).over(w), F.lit(0.0)) * 0.55))
    jump = F.when(F.col("yc") - F.lag("yc").over(down) > F.col("_tol"), 1).otherwise(0)
    out = out.withColumn("_jump", jump).withColumn("line_no", F.sum("_jump").over(down.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    across = Window.partitionBy(*page, "line_no").orderBy("x0", "seq")
    return out.withColumn("word_no", F.row_number().over(across)).drop("_tol", "_jump")


def _joined(sep: str = " ", item: Column | None = None) -> Column:
    item = F.col("word") if item is None else item
    ordered = F.array_sort(F.collect_list(F.struct(F.col("word_no").alias("n"), item.alias("t"))))
    return F.array_join(F.transform(ordered, lambda x: x["t"]), sep)


def line_table(lined: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """One row per line: box, text, words, mean confidence."""
    return lined.groupBy(*page, "line_no").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.avg("yc").alias("yc"),
        _joined().alias("text"), F.count(F.lit(1)).alias("words"), F.avg("conf").alias("conf"),
    )


def page_text(lined: DataFrame, page: Sequence[str] = PAGE, columns: bool = False) -> DataFrame:
    """The text of each page; with `columns`, " | " stands where a gap is wider than 1.6 line heights."""
    across = Window.partitionBy(*page, "line_no").orderBy("word_no")
    height = F.coalesce(F.nullif(F.median(F.col("y1") - F.col("y0")).over(Window.partitionBy(*page)), F.lit(0.0)), F.lit(10.0))
    gap = F.col("x0") - F.lag("x1").over(across)
    lead = F.when(gap.isNull(), F.lit("")).when(gap > height * 1.6 if columns else F.lit(False), F.lit(" | ")).otherwise(F.lit(" "))
    out = lined.withColumn("_t", F.concat(lead, "word"))
    lines = out.groupBy(*page, "line_no").agg(_joined("", F.col("_t")).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy(*page).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def page_confidence(words: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Mean word confidence of each page."""
    return words.groupBy(*page).agg(F.coalesce(F.avg("conf"), F.lit(0.0)).alias("conf"))


def document_confidence(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Mean of a document's page means."""
    return pages.groupBy(doc).agg(F.avg("conf").alias("conf"))


def median_height(words: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """G13."""
    h = F.col("y1") - F.col("y0")
    return words.groupBy(*page).agg(F.coalesce(F.median(F.when(h > 0, h)), F.lit(0.0)).alias("height"))


def median_spacing(points: DataFrame, at: str, page: Sequence[str] = PAGE) -> DataFrame:
    """Median distance between neighbours on one axis."""
    step = F.col(at) - F.lag(at).over(Window.partitionBy(*page).orderBy(at))
    return points.withColumn("_step", step).groupBy(*page).agg(F.median("_step").alias("spacing"))


# ---------------------------------------------------------------- nearest column, cell, band: J18, J19, E17


def nearest_centre(points: DataFrame, centres: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Each point's nearest column (first on ties) and how clear the choice is (nearest / second distance).

    The columns of a page travel as one small array, so points are joined once and not multiplied. Distances count to nine digits, as
    the last ones are rounding noise that would decide ties."""
    cols = centres.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("col_no", "xc"))).alias("_cols"))
    away = F.transform("_cols", lambda c: F.struct(F.round(F.abs(c["xc"] - F.col("_x")), 9).alias("d"), c["col_no"].alias("col_no")))
    out = points.join(cols, list(page)).withColumn("_x", _xc()).withColumn("_d", F.array_sort(away))
    first, second = F.col("_d")[0], F.get("_d", F.lit(1))
    ratio = F.when(second["d"] > 0, first["d"] / second["d"])
    return out.withColumn("col_no", first["col_no"]).withColumn("ratio", ratio).drop("_cols", "_x", "_d")


def point_in_cell(words: DataFrame, cells: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Words whose centre lies in a cell (left and top edges belong to it); cells: row_no, col_no, cx0..cy1."""
    inside = (F.col("_x") >= F.col("cx0")) & (F.col("_x") < F.col("cx1")) & (F.col("_y") >= F.col("cy0")) & (F.col("_y") < F.col("cy1"))
    return words.withColumn("_x", _xc()).withColumn("_y", _yc()).join(cells, list(page)).filter(inside).drop("_x", "_y")


def row_bands(words: DataFrame, labels: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """The row band of each word. Bands part half-way between row labels - or start at the label when text is
    top-aligned, i.e. almost no word (5%) sits more than 0.6 line heights above its nearest label."""
    w = Window.partitionBy(*page)
    rows = labels.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("yc", "row_no"))).alias("_rows"))
    out = words.withColumn("_y", _yc()).join(rows, list(page))
    height = F.coalesce(F.nullif(F.median(F.col("y1") - F.col("y0")).over(w), F.lit(0.0)), F.lit(10.0))
    out = out.withColumn("_h", height)
    near = F.array_min(F.transform("_rows", lambda r: F.struct(F.abs(r["yc"] - F.col("_y")).alias("d"), r["row_no"].alias("n"), (F.col("_y") - r["yc"]).alias("dy"))))
    out = out.withColumn("_dy", near["dy"])
    above, below = F.count_if(F.col("_dy") < -F.col("_h") * 0.6).over(w), F.count_if(F.col("_dy") > F.col("_h") * 0.6).over(w)
    out = out.withColumn("top_aligned", (F.size("_rows") >= 2) & (below > 0) & (above <= below * 0.05))

    def edge(r: Column, i: Column) -> Column:
        mid = F.when(i > 0, (F.get("_rows", i - 1)["yc"] + r["yc"]) / 2).otherwise(F.lit(float("-inf")))
        return F.when(F.col("top_aligned"), r["yc"] - F.col("_h") * 0.6).otherwise(mid)

    passed = F.size(F.filter(F.transform("_rows", edge), lambda e: e <= F.col("_y")))
    band = F.element_at("_rows", F.greatest(passed, F.lit(1)))["row_no"]
    return out.withColumn("row_no", band).drop("_rows", "_y", "_h", "_dy")


# ---------------------------------------------------------------- carried and filled values: E12-E14


def carry_down(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Heading values flow to the rows below them."""
    return running_last(df, keys, order, values)


def fill_period_numbers(columns: DataFrame, keys: Sequence[str], order: str, number: str = "number") -> DataFrame:
    """A missing or non-increasing number becomes the previous one plus one.

    In closed form: place + the largest lead (number - place) so far, at least 0. Keys are the columns of one table."""
    w = Window.partitionBy(*keys).orderBy(order)
    place = F.row_number().over(w)
    lead = F.max(F.col(number) - F.col("_i")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = columns.withColumn("_i", place)
    return out.withColumn("filled", F.col("_i") + F.greatest(F.coalesce(lead, F.lit(0)), F.lit(0))).drop("_i")


def infer_breaks(columns: DataFrame, keys: Sequence[str], order: str = "xc") -> DataFrame:
    """Breaks the scan does not show - where a period ends before the next one starts. Rows: keys, order (half-way
    between the two), start_min, end_min."""
    w = Window.partitionBy(*keys).orderBy(order)
    nxt = columns.withColumn("_s", F.lead("start_min").over(w)).withColumn("_b", F.lead("is_break").over(w)).withColumn("_o", F.lead(order).over(w))
    gap = ~F.col("is_break") & ~F.col("_b") & (F.col("_s") > F.col("end_min"))
    return nxt.filter(gap).select(*keys, ((F.col(order) + F.col("_o")) / 2).alias(order), F.col("end_min").alias("start_min"), F.col("_s").alias("end_min"))


# ---------------------------------------------------------------- headings, columns, cells: W2-W5


def find_headings(lines: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Lines with the class heading they belong to: section_no (0 before the first), class_name, section."""
    long = F.col("text").rlike(HEADING) & (F.col("words") <= 14)
    named = F.when(long, X.normalize_class(F.regexp_extract("text", HEADING, 1)))
    lone = F.when(F.col("text").rlike(LONE_HEADING), X.normalize_class(F.regexp_extract("text", LONE_HEADING, 1)))
    part = F.when(named.isNotNull(), F.regexp_extract("text", HEADING, 2)).otherwise(F.regexp_extract("text", LONE_HEADING, 2))
    out = with_value(lines, "_h", F.struct(F.coalesce(named, lone).alias("c"), X.normalize_section(part).alias("s")))
    w = Window.partitionBy(*page).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("_h.c").isNotNull()
    out = out.withColumn("is_heading", is_head).withColumn("section_no", F.sum(F.when(is_head, 1).otherwise(0)).over(w).cast("int"))
    out = out.withColumn("class_name", F.last(F.col("_h.c"), ignorenulls=True).over(w))
    return out.withColumn("section", F.last(F.when(is_head, F.col("_h.s")), ignorenulls=True).over(w)).drop("_h")


def _bare(c: str = "word") -> Column:
    return F.regexp_replace(F.col(c), "[.,:;()|]", "")


def ordinal(word: Column) -> Column:
    """1 to 12 for "1st" or "12th", also as misread ("ist", "Sth"); null where the ending does not belong to the number."""
    w = F.lower(word)
    head, tail = F.regexp_extract(w, ORDINAL, 1), F.regexp_extract(w, ORDINAL, 2)
    alike = F.create_map(*[x for k, v in LOOK_ALIKES.items() for x in (F.lit(k), F.lit(v))])
    n = F.when(head.rlike(r"^\d{1,2}$"), head.try_cast("int")).otherwise(F.try_element_at(alike, head))
    ending = F.when(n == 1, "st").when(n == 2, "nd").when(n == 3, "rd").otherwise("th")
    return F.when(n.between(1, 12) & (tail == ending), n)


def period_tokens(lined: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Header words that mark a column: an ordinal, P-number or break word; bare or Roman numbers when a line has
    three or more and no times. Adds number (null for a break), is_break and the time range a word (or word - word)
    prints."""
    w = Window.partitionBy(*keys, "line_no").orderBy("word_no")
    joined = F.concat(F.col("word"), F.coalesce(F.lead("word", 1).over(w), F.lit("")), F.coalesce(F.lead("word", 2).over(w), F.lit("")))
    sole = F.col("word").rlike(X.RANGE_PATTERN)
    spread = ~sole & F.col("word").rlike(r"^\d{1,2}[:.;]\d{2}$") & F.lead("word", 1).over(w).rlike("(?i)^(-|–|—|to)$")
    out = lined.withColumn("_span", F.when(sole, F.col("word")).when(spread, joined))
    out = out.withColumn("_x1", F.when(spread, F.lead("x1", 2).over(w)).otherwise(F.col("x1")))
    line = Window.partitionBy(*keys, "line_no")
    digits, roman = _bare().rlike(r"^\d{1,2}$"), F.upper(_bare()).isin(X.ROMAN[:10])
    out = out.withColumn("_timed", F.max(F.col("_span").isNotNull()).over(line))
    out = out.withColumn("_digits", F.count_if(digits).over(line)).withColumn("_roman", F.count_if(roman).over(line)).withColumn("_nth", ordinal(_bare()))
    out = out.withColumn("_ordinals", F.count("_nth").over(line))
    number = (
        F.when(F.col("_nth").isNotNull(), F.col("_nth"))
        .when(_bare().rlike(NUMBERED), F.regexp_extract(_bare(), NUMBERED, 1).try_cast("int"))
        .when(digits & (F.col("_digits") >= 3) & ~F.col("_timed"), _bare().try_cast("int"))
        .when(roman & (F.col("_roman") >= 3) & (F.col("_ordinals") == 0) & ~F.col("_timed"), X.class_rank(F.upper(_bare())))
    )
    out = out.withColumn("is_break", X.is_break_label(F.col("word"))).withColumn("number", F.when(~F.col("is_break") & number.between(1, 12), number))
    out = with_value(out, "range", X.time_range(F.col("_span")))
    return out.withColumn("xc", F.when(F.col("range").isNotNull(), (F.col("x0") + F.col("_x1")) / 2).otherwise(_xc())).drop("_span", "_x1", "_timed", "_digits", "_roman", "_ordinals", "_nth")


def _to_min(c: str) -> Column:
    return F.substring(F.col(c), 1, 2).cast("int") * 60 + F.substring(F.col(c), 4, 2).cast("int")


def detect_columns(header: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The columns of each table head (words of its head lines): col_no, xc, number, is_break, times.

    Time ranges are the columns where there are at least three and as many as period marks; marks are then attached to
    the nearest range; a break mark out of reach of every range is a column of its own, without times. Two ranges and less than
    two marks make two plain periods. Otherwise the marks are the columns and take the nearest range. Missing numbers are
    filled, and a gap between two periods becomes a break. A head with a single column is no table."""
    tokens = period_tokens(header, keys)
    marks = tokens.filter(F.col("number").isNotNull() | F.col("is_break"))
    w = Window.partitionBy(*keys).orderBy("xc", "line_no")
    again = (F.abs(F.col("xc") - F.lag("xc").over(w)) < 12) & F.col("number").eqNullSafe(F.lag("number").over(w)) & (F.col("is_break") == F.lag("is_break").over(w))
    marks = marks.withColumn("_again", F.coalesce(again, F.lit(False))).filter(~F.col("_again")).select(*keys, "xc", "number", "is_break")
    ranges = tokens.filter(F.col("range").isNotNull()).select(*keys, "xc", "range")
    pack_m = F.array_sort(F.collect_list(F.struct("xc", "number", "is_break")))
    pack_r = F.array_sort(F.collect_list(F.struct("xc", F.col("range.start").alias("s"), F.col("range.end").alias("e"))))
    both = marks.groupBy(*keys).agg(pack_m.alias("m")).join(ranges.groupBy(*keys).agg(pack_r.alias("r")), list(keys), "full")
    both = both.withColumn("m", F.coalesce("m", F.array().cast("array<struct<xc:double,number:int,is_break:boolean>>"))).withColumn("r", F.coalesce("r", F.array().cast("array<struct<xc:double,s:string,e:string>>")))
    both = cut_lineage(both)  # one small row per table, used several times below
    n_marks = F.size(F.filter("m", lambda x: ~x["is_break"]))
    many = (F.size("r") >= 3) & (F.size("r") >= n_marks)
    plain = ~many & (n_marks < 2) & (F.size("r") >= 2)

    def spacing(a: str) -> Column:
        steps = F.array_sort(F.transform(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, i: x["xc"] - F.get(F.col(a), i)["xc"]))
        n = F.size(steps)
        lo, hi = F.get(steps, F.floor((n - 1) / 2).cast("int")), F.get(steps, F.floor(n / 2).cast("int"))
        return F.coalesce((lo + hi) / 2, F.lit(100.0))

    def nearest(a: str, x: Column) -> Column:
        return F.array_min(F.transform(a, lambda c, i: F.struct(F.abs(c["xc"] - x).alias("d"), i.alias("i"))))

    no_marks = F.filter("m", lambda x: F.lit(False))
    both = both.withColumn("by_range", many | plain).withColumn("plain", plain).withColumn("m", F.when(F.col("plain"), no_marks).otherwise(F.col("m"))).withColumn("gap", F.when(F.col("by_range"), spacing("r")).otherwise(spacing("m")))
    base = both.select(*keys, "by_range", "plain", "gap", "m", "r", F.posexplode(F.when(F.col("by_range"), F.transform("r", lambda x: x["xc"])).otherwise(F.transform("m", lambda x: x["xc"]))).alias("i", "xc"))
    reach = F.when(F.col("by_range"), F.greatest(F.col("gap") * 0.6, F.lit(25.0))).otherwise(F.greatest(F.col("gap") * 0.8, F.lit(20.0)))

    def taken(other: str, own: str) -> Column:
        """First item of the other array whose nearest own column is this one, within reach."""
        near = F.transform(other, lambda o: F.struct(o.alias("o"), nearest(own, o["xc"]).alias("n")))
        return F.filter(near, lambda z: (z["n"]["i"] == F.col("i")) & (z["n"]["d"] <= reach))

    base = base.withColumn("_m", taken("m", "r")).withColumn("_r", taken("r", "m"))
    own_m, own_r = F.get("m", F.col("i")), F.get("r", F.col("i"))
    lent = F.get(F.filter("_m", lambda z: ~z["o"]["is_break"]), F.lit(0))["o"]
    is_break = F.when(F.col("by_range"), F.exists("_m", lambda z: z["o"]["is_break"])).otherwise(own_m["is_break"])
    number = F.when(F.col("by_range"), lent["number"]).otherwise(own_m["number"])
    times = F.when(F.col("by_range"), F.struct(own_r["s"].alias("s"), own_r["e"].alias("e"))).otherwise(F.struct(F.get("_r", F.lit(0))["o"]["s"].alias("s"), F.get("_r", F.lit(0))["o"]["e"].alias("e")))
    cols = base.select(*keys, "xc", "by_range", "plain", is_break.alias("is_break"), F.when(~is_break, number).alias("number"), times["s"].alias("start_time"), times["e"].alias("end_time"))
    far = F.filter("m", lambda z: z["is_break"] & (nearest("r", z["xc"])["d"] > reach))
    lone = both.filter("by_range").select(*keys, F.explode(far).alias("z")).select(*keys, F.col("z.xc").alias("xc"), F.lit(True).alias("by_range"), F.lit(False).alias("plain"), F.lit(True).alias("is_break"))
    cols = cut_lineage(cols.unionByName(lone, allowMissingColumns=True))
    periods = fill_period_numbers(cols.filter(~F.col("is_break")), keys, "xc")
    periods = periods.withColumn("number", F.when(F.col("by_range"), F.col("filled")).otherwise(F.col("number"))).drop("filled")
    cols = periods.unionByName(cols.filter("is_break")).drop("by_range").withColumn("inferred", F.lit(False))
    timed = cols.filter(~F.col("plain")).withColumn("start_min", _to_min("start_time")).withColumn("end_min", _to_min("end_time"))

    def clock(c: str) -> Column:
        return F.format_string("%02d:%02d", F.floor(F.col(c) / 60).cast("int"), (F.col(c) % 60).cast("int"))

    gaps = infer_breaks(timed, keys).select(
        *keys, "xc", F.lit(True).alias("is_break"), F.lit(None).cast("int").alias("number"), clock("start_min").alias("start_time"), clock("end_min").alias("end_time"), F.lit(True).alias("inferred")
    )
    out = cols.drop("plain").unionByName(gaps).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("_n >= 2").drop("_n")
    return out.withColumn("col_no", (F.row_number().over(Window.partitionBy(*keys).orderBy("xc")) - 1).cast("int"))


def assign_cells(words: DataFrame, columns: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cell lines of a table body: words go to their row band and nearest column. Column centres are first pulled
    to the median of their words (three or more). A word of 4+ letters about as near to a second column marks the cell
    as straddling. Brackets wrapped over two rows are not moved."""
    first = nearest_centre(words, columns.select(*keys, "col_no", "xc"), keys)
    moved = first.groupBy(*keys, "col_no").agg(F.when(F.count(F.lit(1)) >= 3, F.median((F.col("x0") + F.col("x1")) / 2)).alias("_m"))
    centres = columns.select(*keys, "col_no", "xc").join(moved, [*keys, "col_no"], "left").withColumn("xc", F.coalesce("_m", "xc")).drop("_m")
    placed = row_bands(nearest_centre(words, centres, keys), labels, keys)
    lined = build_lines(placed.drop("line_no", "word_no", "yc"), [*keys, "row_no", "col_no"])
    cell = [*keys, "row_no", "col_no"]
    straddle = F.max((F.coalesce("ratio", F.lit(0.0)) > 0.8) & (F.length("word") > 3))
    lines = lined.groupBy(*cell, "line_no").agg(_joined().alias("text"), F.sum("conf").alias("_c"), F.count(F.lit(1)).alias("_n"), straddle.alias("_s"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy(*cell).agg(
        F.transform(ordered, lambda x: x["text"]).alias("lines"), (F.sum("_c") / F.sum("_n") / 100).alias("conf"), F.max("_s").alias("straddle")
    )


def cells_to_periods(cells: DataFrame, columns: DataFrame, labels: DataFrame, keys: Sequence[str], from_text: bool = True) -> DataFrame:
    """Subject, teacher and confidence of each cell (text layer 0.97; straddling at most 0.6, unbalanced brackets
    at most 0.45); breaks the scan does not show are added for every row."""
    cols = columns.select(*keys, "col_no", "number", "is_break", "start_time", "end_time", "inferred")
    rows = labels.select(*keys, "row_no", "day")
    out = with_value(cells.join(cols, [*keys, "col_no"]).join(rows, [*keys, "row_no"]).filter(~F.col("inferred")), "c", split_cell(F.col("lines")))
    brk = F.col("is_break")
    out = out.filter(F.col("c").isNotNull() & (brk | (F.col("c.subject") != "") | (F.col("c.teacher") != "")))
    base = F.lit(0.97) if from_text else F.least(F.lit(0.99), F.greatest(F.lit(0.05), F.col("conf")))
    conf = F.least(base, F.when(F.col("straddle"), F.lit(0.6)).otherwise(F.lit(1.0)), F.when(F.col("c.repaired"), F.lit(0.45)).otherwise(F.lit(1.0)))
    read = out.select(
        *keys, "day", F.col("col_no").alias("slot"), F.when(~brk, F.col("number")).alias("period_number"), "is_break",
        F.when(brk, F.coalesce(F.nullif(F.col("c.subject"), F.lit("")), F.lit("BREAK"))).alias("label"), "start_time", "end_time",
        F.when(brk, F.lit("")).otherwise(F.col("c.subject")).alias("subject"), F.when(brk, F.lit("")).otherwise(F.col("c.teacher")).alias("teacher_name"), F.round(conf, 2).alias("confidence"),
    )
    none = F.lit("")
    added = cols.filter("inferred").join(rows, list(keys)).select(
        *keys, "day", F.col("col_no").alias("slot"), F.lit(None).cast("int").alias("period_number"), F.lit(True).alias("is_break"), F.lit("BREAK").alias("label"), "start_time", "end_time",
        none.alias("subject"), none.alias("teacher_name"), F.lit(0.6).alias("confidence"),
    )
    return read.unionByName(added)


def read_timetables(words: DataFrame, page: Sequence[str] = PAGE, from_text: bool = True) -> DataFrame:
    """W2-W5 in a row: class timetables with days as rows, from words to period records.

    Lines, row labels and columns are each used several times further down, so they are checkpointed."""
    lined = cut_lineage(build_lines(words, page))
    heads = find_headings(line_table(lined, page), page)
    keys = [*page, "section_no"]
    info = heads.filter(~F.col("is_heading")).select(*page, "line_no", "section_no", "class_name", "section")
    rows = cut_lineage(lined.join(info, [*page, "line_no"]))
    info = rows.select(*keys, "class_name", "section").distinct()
    day = with_value(rows.filter("word_no <= 2"), "day", F.coalesce(X.normalize_day(_bare()), F.lit(""))).filter("day <> ''")
    labels = day.groupBy(*keys, "line_no").agg(F.min_by("day", "word_no").alias("day"), F.min_by("x1", "word_no").alias("label_x1"))
    mid = rows.groupBy(*keys, "line_no").agg(F.avg("yc").alias("yc"))
    labels = labels.join(mid, [*keys, "line_no"]).withColumn("row_no", (F.row_number().over(Window.partitionBy(*keys).orderBy("line_no")) - 1).cast("int"))
    labels = cut_lineage(labels)
    edge = labels.groupBy(*keys).agg(F.min("line_no").alias("_first"), F.max("label_x1").alias("_xmin"), F.max("yc").alias("_last"), F.count(F.lit(1)).alias("_rows"))
    edge = edge.filter("_rows >= 2").drop("_rows")
    head = rows.join(edge, keys).filter(F.col("line_no") < F.col("_first")).drop("_xmin", "_last", "_first")
    # the head ends at the last line with times or period marks; what follows belongs to the first row
    marked = period_tokens(head, keys).filter(F.col("number").isNotNull() | F.col("is_break") | F.col("range").isNotNull())
    head = cut_lineage(head.join(marked.groupBy(*keys).agg(F.max("line_no").alias("_end")), keys).filter(F.col("line_no") <= F.col("_end")).drop("_end"))
    columns = cut_lineage(detect_columns(head, keys))
    bottom = head.groupBy(*keys).agg(F.max("y1").alias("_top"))
    body = rows.join(edge, keys).join(bottom, keys).filter((_yc() >= F.col("_top")) & (_xc() > F.col("_xmin"))).drop("_first", "_xmin", "_last", "_top")
    cells = assign_cells(body, columns, labels, keys)
    periods = cells_to_periods(cells, columns, labels, keys, from_text)
    return periods.join(info, keys)


# ---------------------------------------------------------------- ruled tables: W6, W7


def grid_cells(rule_h: DataFrame, rule_v: DataFrame, page: Sequence[str] = PAGE, sizes: DataFrame | None = None) -> DataFrame:
    """Cells of a ruled table: rules within 8 units are one line; rows are at least 18 high; a divider cuts a row
    when it covers 55% of it, so a merged cell spans the columns it lacks dividers for.

    `sizes` (page, width) gives the width of the sheet: a page whose widest line is under 40% of it holds no table, and a line counts
    from 12% of it on. Without it the table's own width is taken."""
    down = Window.partitionBy(*page).orderBy("y")
    h = rule_h.withColumn("_new", F.when(F.col("y") - F.lag("y").over(down) > 8, 1).otherwise(0))
    h = h.withColumn("_g", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    lines = h.groupBy(*page, "_g").agg(F.avg("y").alias("y"), F.min("x0").alias("x0"), F.max("x1").alias("x1")).withColumn("span", F.col("x1") - F.col("x0"))
    widest = lines.groupBy(*page).agg(F.max("span").alias("_w"))
    if sizes is not None:
        wide = sizes.select(*page, F.col("width").cast("double").alias("_page"))
        widest = widest.join(wide, list(page), "left").filter(F.col("_page").isNull() | (F.col("_w") >= F.col("_page") * 0.4)).drop("_page")
    full = lines.join(widest, list(page)).filter(F.col("span") >= F.col("_w") * 0.85)
    box = full.groupBy(*page).agg(F.min("y").alias("_top"), F.max("y").alias("_bottom"), F.min("x0").alias("tx0"), F.max("x1").alias("tx1"), F.count(F.lit(1)).alias("_n")).filter("_n >= 3")
    box = box.withColumn("_unit", F.col("tx1") - F.col("tx0"))
    if sizes is not None:
        box = box.join(wide, list(page), "left").withColumn("_unit", F.coalesce("_page", "_unit")).drop("_page")
    edges = lines.join(box, list(page)).filter((F.col("y") >= F.col("_top") - 4) & (F.col("y") <= F.col("_bottom") + 4) & (F.col("span") >= F.col("_unit") * 0.12))
    rows = edges.withColumn("cy1", F.lead("y").over(down)).filter(F.col("cy1") - F.col("y") >= 18).select(*page, F.col("y").alias("cy0"), "cy1", "tx0", "tx1")
    rows = rows.withColumn("row_no", (F.row_number().over(Window.partitionBy(*page).orderBy("cy0")) - 1).cast("int"))

    across = Window.partitionBy(*page).orderBy("x")
    v = rule_v.withColumn("_new", F.when(F.col("x") - F.lag("x").over(across) > 8, 1).otherwise(0))
    v = v.withColumn("_g", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    v = v.withColumn("x", F.min("x").over(Window.partitionBy(*page, "_g")))
    cut = rows.join(v.select(*page, "x", F.col("y0").alias("_a"), F.col("y1").alias("_b")), list(page))
    cut = cut.filter((F.col("x") > F.col("tx0") + 10) & (F.col("x") < F.col("tx1") - 10))
    cover = F.greatest(F.least("_b", "cy1") - F.greatest("_a", "cy0"), F.lit(0.0))
    cut = cut.groupBy(*page, "row_no", "cy0", "cy1", "x").agg(F.sum(cover).alias("_cover")).filter(F.col("_cover") >= (F.col("cy1") - F.col("cy0")) * 0.55)
    sides = rows.select(*page, "row_no", "cy0", "cy1", F.explode(F.array("tx0", "tx1")).alias("x"))
    xs = cut.select(*page, "row_no", "cy0", "cy1", "x").unionByName(sides)
    in_row = Window.partitionBy(*page, "row_no").orderBy("x")
    xs = xs.withColumn("_gap", F.col("x") - F.lag("x").over(in_row)).filter(F.col("_gap").isNull() | (F.col("_gap") > 12))
    cells = xs.withColumn("cx1", F.lead("x").over(in_row)).filter(F.col("cx1").isNotNull()).withColumn("col_no", (F.row_number().over(in_row) - 1).cast("int"))
    return cells.select(*page, "row_no", "col_no", F.col("x").alias("cx0"), "cx1", "cy0", "cy1")


def cell_texts(words: DataFrame, cells: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Lines, text and confidence of every cell (empty ones too)."""
    key = [*page, "row_no", "col_no"]
    lined = build_lines(point_in_cell(words, cells, page).drop("cx0", "cx1", "cy0", "cy1"), key)
    lines = lined.groupBy(*key, "line_no").agg(_joined().alias("text"), F.sum("conf").alias("_c"), F.count(F.lit(1)).alias("_n"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    text = lines.groupBy(*key).agg(F.transform(ordered, lambda x: x["text"]).alias("lines"), (F.sum("_c") / F.sum("_n") / 100).alias("conf"))
    out = cells.join(text, key, "left")
    return out.withColumn("text", F.coalesce(F.array_join("lines", " "), F.lit(""))).withColumn("conf", F.coalesce("conf", F.lit(0.0)))


def _repaired_labels(label: DataFrame, heading: Column, page: Sequence[str]) -> DataFrame:
    """Row labels (page, row_no, class_name, section) of each matrix in order, with those filled in that could not be read.

    A class that stands twice in a row, without sections, was misread the second time. What is unread after a class without a
    section is the next one, as long as the heading's range ("class VI to X") goes on; `assumed` marks it. One pass over
    the rows of a sheet."""
    order = F.array(*[F.lit(r) for r in X.ROMAN[5:12]])
    last = X.normalize_class(F.regexp_extract(heading, RANGE_HEADING, 2))
    none = F.lit(None).cast("string")
    start = F.struct(none.alias("c"), none.alias("s"), F.array().cast("array<struct<row_no:int,class_name:string,section:string,assumed:boolean>>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        bare = F.coalesce(acc["s"] == "", F.lit(False))
        again = bare & (x["section"] == "") & (x["class_name"] == acc["c"])
        own = F.when(~F.coalesce(again, F.lit(False)), x["class_name"])
        on = bare & own.isNull() & F.coalesce(X.class_rank(acc["c"]) < X.class_rank(last), F.lit(False)) & last.isNotNull()
        name = F.coalesce(own, F.when(on, F.get(order, F.array_position(order, acc["c"]).cast("int"))))
        part = F.when(own.isNotNull(), x["section"]).otherwise(F.lit(""))
        told = F.struct(x["row_no"].alias("row_no"), name.alias("class_name"), part.alias("section"), (own.isNull() & name.isNotNull()).alias("assumed"))
        return F.struct(F.coalesce(name, acc["c"]).alias("c"), F.when(name.isNotNull(), part).otherwise(acc["s"]).alias("s"), F.concat(acc["done"], F.array(told)).alias("done"))

    rows = label.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("row_no", "class_name", "section"))).alias("_rows"), F.first("heading").alias("heading"))
    return rows.select(*page, F.explode(F.aggregate("_rows", start, step)["done"]).alias("x")).select(*page, "x.*")


RANGE_HEADING = r"(?i)class(?:es)?\s+([VXIl1|]+|\d+)\s+to\s+([VXIl1|]+|\d+)"
# Words of a heading and the kind of extra class they name.
CATEGORIES = {"remedial": "REMEDIAL", r"life\s*skill": "LIFE_SKILL", "enrich": "ENRICHMENT"}


def extra_category(heading: Column) -> Column:
    """The one kind of extra class that a heading names, else OTHER."""
    named = {v: F.lower(heading).rlike(k) for k, v in CATEGORIES.items()}
    count = sum((c.cast("int") for c in named.values()), F.lit(0))
    picked = F.lit("OTHER")
    for kind, c in reversed(named.items()):
        picked = F.when(c, F.lit(kind)).otherwise(picked)
    return F.when(count == 1, picked).otherwise(F.lit("OTHER"))


def remedial_matrix(cells: DataFrame, page: Sequence[str] = PAGE, headings: DataFrame | None = None) -> DataFrame:
    """Extra classes from a ruled matrix - classes as rows, day groups over time sub-columns. A cell that spans
    several sub-columns of a day runs from the first start to the last end.

    `headings` (page, heading) gives the category and the range of classes, by which labels that cannot be read are filled in
    with confidence 0.4 at most; without it they stay empty."""
    c = with_value(cells, "_v", F.struct(X.day_in_text(F.col("text")).alias("day"), X.time_range(F.col("text")).alias("t")))
    days = c.filter(F.col("_v.day").isNotNull())
    day_row = days.groupBy(*page, "row_no").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").groupBy(*page).agg(F.min("row_no").alias("_dr"))
    heads = days.join(day_row, list(page)).filter(F.col("row_no") == F.col("_dr")).select(*page, F.col("_v.day").alias("day"), F.col("cx0").alias("_x0"), F.col("cx1").alias("_x1"))
    timed = c.filter(F.col("_v.t").isNotNull()).join(day_row, list(page)).filter(F.col("row_no").between(F.col("_dr") + 1, F.col("_dr") + 2))
    time_row = timed.groupBy(*page, "row_no").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").groupBy(*page).agg(F.min("row_no").alias("_tr"))
    subs = timed.join(time_row, list(page)).filter(F.col("row_no") == F.col("_tr")).withColumn("cx", (F.col("cx0") + F.col("cx1")) / 2)
    subs = subs.select(*page, "cx", "cx0", F.col("_v.t.start").alias("s"), F.col("_v.t.end").alias("e")).join(heads, list(page)).filter((F.col("cx") >= F.col("_x0")) & (F.col("cx") < F.col("_x1")))
    first = subs.groupBy(*page).agg(F.min("cx0").alias("_fx"), F.count(F.lit(1)).alias("_n")).filter("_n >= 2").drop("_n")
    body = cells.join(time_row, list(page)).join(first, list(page)).filter(F.col("row_no") > F.col("_tr"))
    letters = F.regexp_replace(F.upper("text"), "[^A-Z0-9|]", "")
    pattern = "^(VIII|VII|VI|IX|XII|XI|X|V|IV)([A-F])?$"
    repaired = F.regexp_replace(letters, "[L1|]", "I")
    picked = F.when(letters.rlike(pattern), letters).when(repaired.rlike(pattern), repaired)
    label = body.filter(F.col("cx1") <= F.col("_fx") + 6).groupBy(*page, "row_no").agg(
        F.min_by(F.coalesce(F.regexp_extract(picked, pattern, 1), X.normalize_class(letters)), "col_no").alias("class_name"), F.min_by(F.coalesce(F.regexp_extract(picked, pattern, 2), F.lit("")), "col_no").alias("section")
    )
    entry = body.filter((F.col("cx0") >= F.col("_fx") - 6) & (F.col("text") != ""))
    filled = entry.select(*page, "row_no").distinct().join(label, [*page, "row_no"], "left").withColumn("section", F.coalesce("section", F.lit("")))
    titles = cells.select(*page).distinct().withColumn("heading", F.lit("")) if headings is None else headings.select(*page, "heading")
    titles = titles.withColumn("heading", F.coalesce("heading", F.lit("")))
    filled = filled.join(titles, list(page), "left").withColumn("heading", F.coalesce("heading", F.lit("")))
    label = _repaired_labels(filled, F.col("heading"), page).withColumn("section", X.normalize_section(F.col("section")))
    entry = entry.join(subs.select(*page, "cx", "s", "e", "day"), list(page)).filter((F.col("cx") > F.col("cx0") + 2) & (F.col("cx") < F.col("cx1") - 2))
    g = entry.groupBy(*page, "row_no", "col_no", "day").agg(F.min("s").alias("start_time"), F.max("e").alias("end_time"), F.first("lines").alias("lines"), F.first("conf").alias("conf"))
    out = with_value(g.join(label, [*page, "row_no"], "left"), "c", split_cell(F.col("lines"))).filter((F.col("c.subject") != "") | (F.col("c.teacher") != ""))
    sure = F.when(F.col("assumed"), F.least(F.lit(0.4), F.col("conf"))).otherwise(F.col("conf"))
    conf = F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.05), sure)), 2)
    out = out.join(titles, list(page), "left")
    return out.select(
        *page, extra_category(F.coalesce("heading", F.lit(""))).alias("category"), F.coalesce("class_name", F.lit("")).alias("class_name"), F.coalesce("section", F.lit("")).alias("section"), "day", "start_time", "end_time",
        F.col("c.subject").alias("activity"), F.col("c.teacher").alias("teacher_name"), conf.alias("confidence"),
    )


# ---------------------------------------------------------------- duty tables: W8


def duty_table_rows(cells: DataFrame, keys: Sequence[str], heading: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Duties from table cells (keys, row_no, col_no, text): column roles by their head text, the date carried down
    in holiday lists. `heading` (keys, heading) is the text above each table, which may name the kind of list. Returns (duties,
    dates that name nobody or no person)."""
    duties, reported = _duty_tables(cells, keys, heading)
    return duties.drop("description"), reported


def described_duties(cells: DataFrame, keys: Sequence[str], heading: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """The duties with a description (house, classes, day off, "MOD") and the confidence of their source: `sources` (keys,
    from_scan, mean_conf) tells scanned pages, whose words' mean counts; text is taken at 0.97."""
    duties, _ = _duty_tables(cells, keys, heading)
    if sources is None:
        return duties.withColumn("confidence", F.lit(0.97))
    scanned = F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.99), F.col("mean_conf") / 100)), 2)
    out = duties.join(sources.select(*keys, "from_scan", "mean_conf"), list(keys), "left")
    return out.withColumn("confidence", F.when(F.coalesce("from_scan", F.lit(False)), scanned).otherwise(F.lit(0.97))).drop("from_scan", "mean_conf")


def _duty_tables(cells: DataFrame, keys: Sequence[str], heading: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    cells = cut_lineage(cells)  # the heads and the bodies are read from it
    t = F.col("_low")
    off = t.rlike(r"weekly\s*off")
    role = {
        "off": off, "date": t.rlike(r"^date\b|\bdate$") & ~off, "name": t.rlike(r"m\.?\s?o\.?\s?d\b|master on duty|\bname\b|teacher"),
        "designation": t.rlike("designation|post|code"), "house": t.rlike("house"), "classes": t.rlike("class"),
    }
    lowered = with_value(cells.filter("row_no < 3"), "_low", F.regexp_replace(F.lower(F.trim("text")), r"\s+", " "))
    top = lowered.groupBy(*keys, "row_no").agg(
        *[F.min(F.when(c, F.col("col_no"))).alias(n) for n, c in role.items()],
        F.max(t.rlike(r"m\.?\s?o\.?\s?d\b|master on duty")).alias("mod"), F.max(t.rlike("allotted house")).alias("allotted"),
    )
    top = top.filter(F.col("date").isNotNull() & F.col("name").isNotNull())
    head = top.groupBy(*keys).agg(F.min_by(F.struct(*top.columns[len(keys):]), "row_no").alias("h"))
    if heading is not None:
        head = head.join(heading.select(*keys, F.lower("heading").alias("_t")), list(keys), "left")
    else:
        head = head.withColumn("_t", F.lit(""))
    title = F.coalesce("_t", F.lit(""))
    holiday = F.col("h.house").isNotNull() | F.col("h.allotted") | title.rlike("holiday|sunday")
    head = head.withColumn("holiday", holiday).filter(holiday | F.col("h.mod") | title.rlike(r"\bmod\b"))
    body = cells.join(head, list(keys)).filter(F.col("row_no") > F.col("h.row_no"))

    def cell(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("col_no") == F.col(f"h.{name}"), F.trim("text"))), F.lit("")).alias(name)

    rows = body.groupBy(*keys, "row_no", "holiday").agg(*[cell(n) for n in role])
    rows = with_value(rows, "_p", F.struct(X.date_in_text(F.col("date")).alias("own"), classify(F.col("name")).alias("p"), X.date_in_text(F.col("off")).alias("off")))
    rows = rows.withColumn("duty_date", F.col("_p.own"))
    down = Window.partitionBy(*keys).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("duty_date", F.when(F.col("holiday"), F.last("duty_date", ignorenulls=True).over(down)).otherwise(F.col("duty_date"))).filter(F.col("duty_date").isNotNull())
    person = (F.col("name") != "") & (F.col("_p.p.kind") != "garbage")
    printed = F.coalesce(F.col("_p.p.code"), F.col("_p.p.designation"), F.nullif("designation", F.lit("")))

    def only_holiday(c: Column) -> Column:
        return F.when(F.col("holiday"), c)

    told = F.concat_ws(
        " · ", F.nullif("house", F.lit("")), F.when(F.col("classes") != "", F.concat(F.lit("Class "), "classes")),
        F.concat(F.lit("weekly off "), F.date_format("_p.off", "dd-MM-yyyy")), F.when(F.col("name").rlike(r"(?i)\(\s*MOD\s*\)"), F.lit("MOD")),
    )
    duties = rows.filter(person).select(
        *keys, "row_no", "duty_date", F.col("_p.p.name").alias("teacher_name"), F.when(F.col("holiday"), F.lit("HOLIDAY")).otherwise(F.lit("MOD")).alias("duty_type"),
        F.substring(printed, 1, 80).alias("designation"), only_holiday(F.nullif("house", F.lit(""))).alias("house"), only_holiday(F.nullif("classes", F.lit(""))).alias("classes"),
        only_holiday(F.col("_p.off")).alias("off_date"), F.when(F.col("holiday"), told).otherwise(F.lit("")).alias("description"),
    )
    problem = F.when(F.col("name") != "", F.lit("not a person")).when(F.col("designation") != "", F.lit("no person named"))
    reported = rows.filter(~person).withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(*keys, "row_no", "duty_date", "name", "problem")
    return duties, reported


# ---------------------------------------------------------------- text lists: W9, W10

MOD_HEAD = r"(?i)\bM\.?\s?O\.?\s?D\b|MASTER\s+ON\s+DUTY|TEACHER\s+ON\s+DUTY|DUTY\s+ROSTER"
OFF_HEAD = r"(?i)WEEKLY\s*[-]?\s*OFF|WEEK\s*[-]?\s*OFF|WEEKLY\s+HOLIDAY"
CLUB_LINE = r"(?i)^\s*(?:\d+\s*[.)]\s*|[•*▪●-]\s*)?([A-Z][A-Za-z&' -]{2,50}?\s+Club)\b\s*[:\-–]?\s*(.*)$"
MEMBERS = r"(?i)^\s*(?:members?|teachers?|in-?charges?|co-?ordinators?|faculty)\s*(?:in\s+charge)?\s*[:\-–]\s*(.*)$"
ACTIVITIES = r"(?i)^\s*(?:suggested\s+)?(?:activities|activity|programmes?|events?)\s*[:\-–]\s*(.*)$"


def names_in(c: Column, head: str) -> Column:
    """Person and code names a text line lists."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, head, " "), X.DAY_PATTERN, " "), r"\b\d{1,2}\s*[/.\-]\s*\d{1,2}\s*[/.\-]\s*\d{2,4}\b", " ")
    parts = F.split(F.regexp_replace(s, "[:|]", ","), r"(?i),|&|;|\band\b|\s/\s")
    clean = F.transform(parts, lambda p: F.regexp_replace(X.clean_cell(p), r"^[\s\-–—.]+|[\s\-–—.]+$", ""))
    read = F.transform(clean, lambda p: classify(p))
    kept = F.filter(read, lambda p: (p["kind"] != "garbage") & (F.length(p["name"]) >= 3))
    return F.transform(kept, lambda p: p["name"])


def _in_block(lines: DataFrame, head: str, other: str, page: Sequence[str]) -> DataFrame:
    """Lines that belong to the block the last heading above opened, numbered (`_block`); another heading closes it, and what
    flows down begins afresh in the next block."""
    text = F.col("text")
    kind = F.when(text.rlike(head), 1).when(text.rlike(other) | F.col("is_heading"), 0)
    w = Window.partitionBy(*page).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_in", F.last(kind, ignorenulls=True).over(w)).withColumn("_block", F.count_if(kind == 1).over(w))
    return marked.filter("_in = 1").drop("_in")


def list_duties(headed: DataFrame, page: Sequence[str] = PAGE, default_year: int | None = None) -> DataFrame:
    """Master-on-duty lines; the date flows down, a line with a weekday but no date is not imported."""
    block = _in_block(headed, MOD_HEAD, OFF_HEAD, page)
    v = with_value(block, "_v", F.struct(X.date_in_text(F.col("text"), default_year).alias("d"), X.day_in_text(F.col("text")).alias("day"), names_in(F.col("text"), MOD_HEAD).alias("names")))
    w = Window.partitionBy(*page, "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumn("duty_date", F.last(F.col("_v.d"), ignorenulls=True).over(w))
    dayless = F.col("_v.d").isNotNull() | F.col("_v.day").isNull()
    rows = v.filter(F.col("duty_date").isNotNull() & dayless)
    return rows.select(*page, "line_no", "duty_date", F.explode("_v.names").alias("teacher_name"), F.round(F.col("conf") / 100, 2).alias("confidence"))


def list_weekly_offs(headed: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Weekly-off lines; the weekday flows down."""
    block = _in_block(headed, OFF_HEAD, MOD_HEAD, page)
    v = with_value(block, "_v", F.struct(X.day_in_text(F.col("text")).alias("day"), names_in(F.col("text"), OFF_HEAD).alias("names")))
    w = Window.partitionBy(*page, "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumn("day", F.last(F.col("_v.day"), ignorenulls=True).over(w)).filter(F.col("day").isNotNull())
    return v.select(*page, "line_no", "day", F.explode("_v.names").alias("teacher_name"), F.round(F.col("conf") / 100, 2).alias("confidence"))


def list_remedial(headed: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Remedial lines with a time range; category, class and weekday flow down."""
    text = F.col("text")
    short = F.length("text") < 60
    category = F.when(short & text.rlike(r"(?i)life\s*skill"), F.lit("LIFE_SKILL")).when(short & text.rlike("(?i)enrich"), F.lit("ENRICHMENT")).when(short & text.rlike("(?i)remedial"), F.lit("REMEDIAL"))
    token = r"(?i)^\s*(?:CLASS\s*[-:]?\s*)?(VIII|VII|VI|XII|XI|IX|X)\s*(?:[-–—]?\s*([A-F])\b)?"
    starts = text.rlike(token) & ~F.col("is_heading")
    rest = F.when(starts, F.regexp_replace(text, token, "")).otherwise(text)
    body = F.regexp_replace(F.regexp_replace(rest, X.RANGE_PATTERN, " "), X.DAY_PATTERN, " ")
    v = with_value(
        headed, "_v",
        F.struct(
            category.alias("cat"), F.when(starts, F.upper(F.regexp_extract(text, token, 1))).alias("cn"), F.when(starts, X.normalize_section(F.regexp_extract(text, token, 2))).alias("s"),
            X.day_in_text(rest).alias("day"), X.time_range(text).alias("t"), split_cell(F.array(body)).alias("c"),
        ),
    )
    w = Window.partitionBy(*page).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    named = F.coalesce(F.when(F.col("is_heading"), F.struct(F.col("class_name").alias("cn"), F.col("section").alias("s"))), F.when(F.col("_v.cn").isNotNull(), F.struct(F.col("_v.cn").alias("cn"), F.col("_v.s").alias("s"))))
    v = v.withColumn("_class", F.last(named, ignorenulls=True).over(w)).withColumn("category", F.coalesce(F.last(F.col("_v.cat"), ignorenulls=True).over(w), F.lit("REMEDIAL")))
    v = v.withColumn("day", F.last(F.col("_v.day"), ignorenulls=True).over(w))
    rows = v.filter(F.col("_v.t").isNotNull() & F.col("_class").isNotNull() & F.col("_v.c").isNotNull() & ~(F.col("is_heading") & (F.col("words") <= 5)))
    return rows.select(
        *page, "line_no", "category", F.col("_class.cn").alias("class_name"), F.col("_class.s").alias("section"), "day", F.col("_v.t.start").alias("start_time"), F.col("_v.t.end").alias("end_time"),
        F.col("_v.c.subject").alias("activity"), F.col("_v.c.teacher").alias("teacher_name"), F.round(F.col("conf") / 100, 2).alias("confidence"),
    )


def list_clubs(lines: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Clubs with members and activities as long rows (club_no, name, role, value); unlabelled lines follow the last
    label, or are activities unless they name a person."""
    from rollbook.operators.text_jobs import split_list

    text = F.col("text")
    is_club = (F.length("text") < 80) & text.rlike(CLUB_LINE) & ~text.rlike(MEMBERS) & ~text.rlike(ACTIVITIES)
    w = Window.partitionBy(*page).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    v = lines.withColumn("_club", is_club).withColumn("club_no", F.sum(F.when(is_club, 1).otherwise(0)).over(w).cast("int")).filter("club_no > 0")
    v = v.withColumn("name", F.last(F.when(F.col("_club"), X.clean_cell(F.regexp_extract(text, CLUB_LINE, 1))), ignorenulls=True).over(w))
    in_club = Window.partitionBy(*page, "club_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    body = F.regexp_replace(X.clean_cell(text), r"^[•*▪●-]\s*|^\d+\s*[.)]\s*", "")
    label = F.when(text.rlike(MEMBERS), F.lit("member")).when(text.rlike(ACTIVITIES), F.lit("activity"))
    v = with_value(v, "_v", F.struct(label.alias("l"), (classify(body)["kind"] == "person").alias("p"), body.alias("b")))
    v = v.withColumn("role", F.last(F.coalesce(F.col("_v.l"), F.when(~F.col("_club") & ~F.col("_v.p"), F.lit("activity"))), ignorenulls=True).over(in_club))
    v = v.withColumn("role", F.coalesce("role", F.when(F.col("_v.p"), F.lit("member"))))
    listed = F.when(text.rlike(MEMBERS), split_list(F.regexp_extract(text, MEMBERS, 1))).when(text.rlike(ACTIVITIES), split_list(F.regexp_extract(text, ACTIVITIES, 1)))
    values = F.coalesce(listed, F.when(F.col("role") == "member", split_list(F.col("_v.b"))), F.array(F.col("_v.b")))
    rows = v.filter(~F.col("_club") & F.col("role").isNotNull()).select(*page, "club_no", "name", "role", F.explode(values).alias("value"))
    # members printed on the club's own line
    same = v.filter("_club").select(*page, "club_no", "name", F.lit("member").alias("role"), F.explode(F.filter(F.transform(F.split(F.regexp_extract(text, CLUB_LINE, 2), "[,;&]"), X.clean_cell), lambda p: classify(p)["kind"] == "person")).alias("value"))
    rows = rows.unionByName(same).filter("value <> ''").distinct()
    return rows.unionByName(v.filter("_club").select(*page, "club_no", "name", F.lit("club").alias("role"), F.lit("").alias("value")))


def route_extractors(docs: DataFrame, lines: DataFrame, duty_tables: DataFrame, doc: str = "doc_id", page: Sequence[str] = ()) -> DataFrame:
    """Which reader a document goes to (docs: doc, kind). A duty table decides for remedial and club uploads; a
    remedial title (first 12 lines) turns a routine or other document into one; the rest read timetable and duties.

    line_no counts from 0 in the document; where it starts again on every page, as in `line_table`, `page` names the
    columns that put the pages of a document in order."""
    order = [F.col(c) for c in (*page, "line_no")]
    top = first_rows(lines, [doc], *order, k=12) if page else lines.filter("line_no < 12")
    title = top.groupBy(doc).agg(F.max(F.col("text").rlike(r"(?i)remedial|enrichment|life\s*skill")).alias("_rem"))
    tables = duty_tables.select(doc).distinct().withColumn("_duty", F.lit(True))
    out = docs.join(title, doc, "left").join(tables, doc, "left")
    kind, duty, rem = F.col("kind"), F.coalesce("_duty", F.lit(False)), F.coalesce("_rem", F.lit(False))
    reader = (
        F.when(kind.isin("REMEDIAL", "CLUB") & duty, F.lit("duty"))
        .when((kind == "REMEDIAL") | (kind.isin("ROUTINE", "OTHER") & rem), F.lit("remedial"))
        .when(kind == "CLUB", F.lit("club"))
        .when(duty, F.lit("timetable+duty"))
        .otherwise(F.lit("timetable+lists"))
    )
    return out.select(doc, "kind", reader.alias("reader"))
