"""Whole-table text jobs: printed text to values, HTML to lines and tables, raw records to clean ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions import text as X
from rollbook.functions.cells import split_cell
from rollbook.functions.clock import class_label, day_label, is_clock, range12, to_minutes
from rollbook.functions.people import clean_code, code_prefix, code_stem, classify, person_key
from rollbook.keyed import with_value
from rollbook.session import written

BY = ("school_id",)


def normalize_periods(printed: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Class, section, weekday, label, break flag, number and times out of printed period text."""
    span = X.time_range(F.col("time_text"))
    out = printed.select(
        *by, "seq", X.normalize_class(F.col("class_text")).alias("class_name"), X.normalize_section(F.col("section_text")).alias("section"),
        X.normalize_day(F.col("day_text")).alias("day"), X.clean_cell(F.col("label_text")).alias("label"),
        X.is_break_label(F.col("label_text")).alias("is_break"), X.period_number(F.col("label_text")).alias("period_number"), span.alias("_span"),
    )
    return out.select(
        *[c for c in out.columns if c != "_span"], X.class_rank(F.col("class_name")).alias("class_rank"), F.col("_span.start").alias("start_time"),
        F.col("_span.end").alias("end_time"), to_minutes(F.col("_span.start")).alias("start_min"), to_minutes(F.col("_span.end")).alias("end_min"),
    )


def extract_times_dates(df: DataFrame, text: str, keep: Sequence[str], default_year: int | None = None) -> DataFrame:
    """First time range, calendar date, session and weekday each text mentions."""
    c = F.col(text)
    out = df.select(*keep, X.time_range(c).alias("_t"), X.date_in_text(c, default_year).alias("found_date"), X.session_in_text(c).alias("session"), X.day_in_text(c).alias("day"))
    return out.select(*keep, F.col("_t.start").alias("start_time"), F.col("_t.end").alias("end_time"), "found_date", "session", "day")


def classify_people(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Kind (person, code, garbage), name, code and designation of each text."""
    return df.select(*keep, classify(F.col(text)).alias("_p")).select(*keep, "_p.*")


def match_keys(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """The keys under which two spellings may meet."""
    c = F.col(text)
    return df.select(
        *keep, X.match_key(c).alias("match_key"), person_key(c).alias("person_key"), code_prefix(c).alias("prefix"), code_stem(c).alias("stem"), X.look_alike(c).alias("look_alike")
    )


def clean_cells(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """N5."""
    c = F.col(text)
    return df.select(*keep, X.clean_cell(c).alias("cell"), X.strip_serial(c).alias("unnumbered"), clean_code(c).alias("as_code"))


def split_cells(df: DataFrame, lines: str, keep: Sequence[str]) -> DataFrame:
    """Subject and teacher of each cell; empty cells drop out."""
    out = df.select(*keep, split_cell(F.col(lines)).alias("_c")).filter(F.col("_c").isNotNull())
    return out.select(*keep, "_c.*")


def split_list(c: Column) -> Column:
    """A printed list as an array - cleaned, without repeats and one-letter rests."""
    parts = F.transform(F.split(c, r"[;,•▪●]|\s/\s|\s{3,}"), lambda x: F.regexp_replace(X.clean_cell(x), r"^[\s\-–—.]+|[\s\-–—.]+$", ""))
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) > 1))


def settings_list(c: Column) -> Column:
    """Trimmed, upper-cased, non-empty, without repeats."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.upper(F.trim(x))), lambda x: x != ""))


def found_in(hay: Column, text: Column) -> Column:
    """Whether a text's key, or each of its words of 3+ letters, occurs in the page key."""

    def check(k: Column) -> Column:
        words = F.filter(F.split(k, " "), lambda w: F.length(w) >= 3)
        return (F.length(k) < 2) | F.contains(hay, k) | ((F.size(words) > 0) & F.forall(words, lambda w: F.contains(hay, w)))

    return X.let(X.match_key(text), check)


def cross_check(records: DataFrame, pages: DataFrame, key: str, texts: Sequence[str]) -> DataFrame:
    """A record loses a quarter of its confidence for every text its page does not hold.

    Hand-entered records, empty texts and pages under 20 characters are left alone. The page key is worked out
    once per page; it is dropped in the same stage as the join, so it is never shuffled with the records."""
    hay = pages.select(key, F.concat(F.lit(" "), X.match_key(F.col("text")), F.lit(" ")).alias("_hay"))
    out = records.join(hay, key, "left")
    factor = F.lit(1.0)
    for t in texts:
        missing = (F.col(t) != "") & ~found_in(F.col("_hay"), F.col(t))
        factor = factor * F.when(F.coalesce(missing, F.lit(False)), F.lit(0.75)).otherwise(F.lit(1.0))
    usable = F.length(F.trim("_hay")) >= 20
    checked = F.when(usable & F.col("confidence").isNotNull(), F.round(F.col("confidence") * factor, 2)).otherwise(F.col("confidence"))
    return out.withColumn("confidence", checked).drop("_hay")


# ---------------------------------------------------------------- HTML

# Entities in the order they are decoded.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]


def decode_entities(c: Column) -> Column:
    for entity, ch in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(ch))

    def numeric(s: Column) -> Column:
        codes = F.array_distinct(F.regexp_extract_all(s, F.lit(r"&#(\d+);"), F.lit(1)))

        def put(acc: Column, n: Column) -> Column:
            code = n.try_cast("bigint")
            known = code.between(0, 0xD7FF) | code.between(0xE000, 0x10FFFF)  # other numbers name no character and stay as they are
            ch = F.decode(F.unhex(F.lpad(F.hex(F.when(known, code).otherwise(0)), 8, "0")), "UTF-32")
            return F.when(F.coalesce(known, F.lit(False)), F.replace(acc, F.concat(F.lit("&#"), n, F.lit(";")), ch)).otherwise(acc)

        return F.aggregate(codes, s, put)

    return F.when(F.contains(c, F.lit("&#")), X.let(c, numeric)).otherwise(c)


def html_text_lines(c: Column) -> Column:
    """Array of the non-empty text lines of an HTML fragment."""

    def plain(s: Column) -> Column:
        """Text without markup and references, which most cells are."""
        marked = F.regexp_replace(F.regexp_replace(s, r"(?i)<br\s*/?>", "\n"), r"(?i)</(p|li|h\d)>", "\n")
        untagged = X.let(F.regexp_replace(marked, r"<[^>]+>", ""), lambda u: F.when(F.contains(u, F.lit("&")), decode_entities(u)).otherwise(u))
        return F.when(F.contains(s, F.lit("<")), untagged).when(F.contains(s, F.lit("&")), decode_entities(s)).otherwise(s)

    lines = F.transform(F.split(X.let(c, plain), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(lines, lambda x: x != "")


def html_lines(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page, line number, text) outside tables."""
    outside = F.regexp_replace("html", r"(?is)<table.*?</table>", "\n")
    return pages.select(key, F.posexplode(html_text_lines(outside)).alias("line_no", "line"))


TABLES = r"(?is)(<table.*?</table>)"


def html_headings(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page, table, heading): the last three lines of the nearest text above each table, joined; empty without any."""
    chunks = F.split("html", TABLES)
    lines = pages.select(key, F.posexplode(F.transform(F.slice(chunks, 1, F.size(chunks) - 1), html_text_lines)).alias("table_no", "lines"))
    some = F.when(F.size("lines") > 0, F.array_join(F.slice("lines", F.greatest(F.size("lines") - 2, F.lit(1)), 3), " "))
    above = Window.partitionBy(key).orderBy("table_no").rowsBetween(Window.unboundedPreceding, 0)  # the tables of one page
    return lines.select(key, "table_no", F.coalesce(F.last(some, ignorenulls=True).over(above), F.lit("")).alias("heading"))


#: Columns of a span that are written out at once.
SPREAD = 4096


def _html_cells(pages: DataFrame, key: str) -> DataFrame:
    """(page, table, row, cell, text, down, across, first slot, rows of the table): a slot is a column that the row's own cells take,
    counted without what covers the row from above."""
    # a table file of short pages is one task to read but much work to parse; the windows below find the rows of a page together
    dealt = pages.select(key, "html").repartition(key)
    tables = dealt.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(TABLES), F.lit(1))).alias("table_no", "table"))
    trs = with_value(tables.select(key, "table_no", "table"), "trs", F.regexp_extract_all("table", F.lit(r"(?is)(<tr.*?</tr>)"), F.lit(1)))
    rows = trs.select(key, "table_no", F.size("trs").alias("rows"), F.posexplode("trs").alias("row_no", "tr"))
    cells = rows.select(key, "table_no", "rows", "row_no", F.posexplode(F.regexp_extract_all("tr", F.lit(r"(?is)(<t[dh][^>]*>.*?</t[dh]>)"), F.lit(1))).alias("cell_no", "cell"))
    # a cell is <td, attributes, >, body, </td>: its first > ends the opening tag, and the closing one has five characters
    opened = F.instr("cell", ">")
    cells = with_value(cells, "attrs", F.substring("cell", F.lit(4), opened - 4))

    def span(name: str) -> Column:
        # with a 0 before it, a missing number is 0: casting an empty text raises and catches an error for every cell
        said = F.concat(F.lit("0"), F.regexp_extract("attrs", rf'(?i){name}="?(\d+)', 1)).try_cast("bigint")
        said = F.greatest(F.coalesce(said, F.lit(1)), F.lit(1))
        return F.when(F.col("attrs") == "", F.lit(1).cast("bigint")).otherwise(said)

    body = F.substring("cell", opened + 1, F.length("cell") - opened - 5)
    told = cells.select(
        key, "table_no", "row_no", "cell_no", F.array_join(html_text_lines(body), " ").alias("text"), F.least(span("rowspan"), F.col("rows") - F.col("row_no")).alias("down"), span("colspan").alias("across")
    )
    before = Window.partitionBy(key, "table_no", "row_no").orderBy("cell_no").rowsBetween(Window.unboundedPreceding, -1)
    return told.withColumn("slot", F.coalesce(F.sum("across").over(before), F.lit(0)))


def _spread(cells: DataFrame) -> DataFrame:
    """One row per slot of each cell; a very wide cell is spread in pieces, so that no array of its width is built."""
    pieces = cells.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1, F.lit(SPREAD).cast("long"))))
    inside = F.sequence(F.col("_at"), F.least(F.col("_at") + SPREAD, F.col("across")) - 1)
    return pieces.withColumn("_k", F.explode(inside)).withColumn("slot", F.col("slot") + F.col("_k")).drop("_at", "_k", "across")


def _columns(slots: DataFrame, covers: DataFrame, row: Sequence[str]) -> DataFrame:
    """`col_no` of each slot: the slot-th column of its row that no cell from above covers.

    The j-th covered column c of a row has c - j free columns before it; slots with at least so many free columns before them
    lie behind it. Running counts over covers and slots in that order give all columns of a row in one pass."""
    places = Window.partitionBy(*row).orderBy("col_no")
    marks = covers.select(*row, "col_no").distinct().withColumn("_v", F.col("col_no") - F.row_number().over(places) + 1).select(*row, "_v")
    line = slots.withColumn("_own", F.lit(1)).withColumn("_v", F.col("slot")).unionByName(marks.withColumn("_own", F.lit(0)), allowMissingColumns=True)
    behind = F.count_if(F.col("_own") == 0).over(Window.partitionBy(*row).orderBy("_v", "_own").rowsBetween(Window.unboundedPreceding, 0))
    return line.withColumn("col_no", F.col("slot") + behind).filter("_own = 1").drop("_own", "_v")


def html_tables(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page, table, row, col, text) with column and row spans filled in.

    Cells that reach down cover columns of the rows below. Their own columns follow from what covers them in turn: they are placed
    as if nothing did, then again with those covers, until none moves, which takes as many rounds as spans stand on
    spans. All other cells are placed once. Columns between a row's last cell and the last one covered from above are empty."""
    row = [key, "table_no", "row_no"]
    cells = written(_html_cells(pages, key))
    flat = cells.join(cells.filter("down > 1").select(key, "table_no").distinct(), [key, "table_no"], "left_anti")
    flat = _spread(flat).select(*row, F.col("slot").alias("col_no"), "text")
    tall = cells.filter("down > 1")
    if tall.isEmpty():
        return flat.select(*row, F.col("col_no").cast("int").alias("col_no"), "text")
    spread = written(_spread(tall))
    placed = written(spread.withColumn("col_no", F.col("slot")))
    while True:
        covers = placed.select(key, "table_no", F.explode(F.sequence(F.col("row_no") + 1, (F.col("row_no") + F.col("down") - 1).cast("int"))).alias("row_no"), "col_no", "text")
        moved = _columns(placed.withColumn("_old", F.col("col_no")).drop("col_no"), covers, row).withColumn("_moved", F.col("col_no") != F.col("_old")).drop("_old")
        placed = written(moved)
        if placed.filter("_moved").isEmpty():
            break
        placed = placed.drop("_moved")
    covers = written(covers)
    spanned = cells.join(covers.select(key, "table_no").distinct(), [key, "table_no"], "left_semi")
    own = _columns(_spread(spanned).select(*row, "slot", "text"), covers, row)
    # columns without a cell before the last covered one
    used = spanned.groupBy(*row).agg(F.sum("across").alias("_used"))
    ends = covers.groupBy(*row).agg((F.max("col_no") + 1).alias("_end"), F.count(F.lit(1)).alias("_covered")).join(used, row, "left")
    ends = ends.withColumn("slot", F.coalesce("_used", F.lit(0))).withColumn("across", F.col("_end") - F.col("_covered") - F.col("slot")).filter("across > 0")
    gaps = _columns(_spread(ends.select(*row, "slot", "across", F.lit("").alias("text"))), covers, row)
    out = flat.unionByName(own.select(*row, "col_no", "text")).unionByName(gaps.select(*row, "col_no", "text")).unionByName(covers.select(*row, "col_no", "text"))
    return out.select(*row, F.col("col_no").cast("int").alias("col_no"), "text")


# ---------------------------------------------------------------- JSON, calendar


def json_field(c: Column, path: str, as_type: str) -> Column:
    """One field of untyped JSON text; null when the text is not JSON or the field is missing."""
    return F.try_variant_get(F.try_parse_json(c), path, as_type)


def typed_json(c: Column, schema: str) -> Column:
    """JSON text with a known shape."""
    return F.from_json(c, schema)


def calendar(spans: DataFrame, holidays: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Every date of each span (by, start, end) with weekday, Monday of the week, holiday flag (Sundays and
    listed dates) and the date six months back."""
    days = spans.select(*by, F.explode(F.sequence("start", "end")).alias("day"))
    listed = holidays.select(*by, "day").distinct().withColumn("_listed", F.lit(True))
    out = days.join(listed, [*by, "day"], "left")
    idx = F.weekday("day")
    return out.select(
        *by, "day", idx.alias("day_idx"), F.date_trunc("week", "day").cast("date").alias("monday"),
        ((idx == 6) | F.coalesce("_listed", F.lit(False))).alias("is_holiday"), F.add_months("day", -6).alias("six_months_back"),
    )


def months_before(day: Column, months: int) -> Column:
    """Same day some months earlier, held at the month's end."""
    return F.add_months(day, -months)


def describe_changes(diff: DataFrame, by: Sequence[str] = BY, teachers: DataFrame | None = None) -> DataFrame:
    """A diff row as text - where, what it was, what it is. `teachers` (by, teacher_id, name) gives the names to print; without it
    a teacher is shown by id."""
    if teachers is not None:
        names = teachers.select(*by, F.col("teacher_id").alias("_id"), F.col("name").alias("_name"))
        for p in ("before", "after"):
            named = names.withColumnsRenamed({"_id": f"{p}_teacher_id", "_name": f"_{p}_name"})
            diff = diff.join(named, [*by, f"{p}_teacher_id"], "left")

    def side(p: str) -> Column:
        subject = F.coalesce(F.nullif(F.col(f"{p}_subject"), F.lit("")), F.lit("(no subject)"))
        shown = F.col(f"{p}_teacher_id").cast("string") if teachers is None else F.nullif(F.col(f"_{p}_name"), F.lit(""))
        teacher = F.coalesce(shown, F.lit("(no teacher)"))
        span = F.nullif(range12(F.col(f"{p}_start_min"), F.col(f"{p}_end_min")), F.lit(""))
        return F.concat_ws(" · ", subject, teacher, span)

    where = F.concat(day_label(F.col("day_idx")), F.lit(" - Class "), class_label(F.col("class_name"), F.col("section")))
    return diff.select(
        *by, "class_name", "section", "day_idx", "slot", "kind", where.alias("place"),
        F.when(F.col("kind") != "added", side("before")).alias("before"), F.when(F.col("kind") != "removed", side("after")).alias("after"),
    )


# ---------------------------------------------------------------- N13: raw extracted records to clean ones


def _valid_clock(name: str) -> Column:
    return F.when(is_clock(F.col(name)), F.col(name)).alias(name)


def _confidence(clamp: bool) -> Column:
    c = F.col("confidence")
    if clamp:
        c = F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    return F.coalesce(c, F.lit(0.5)).alias("confidence")


def sanitize_periods(raw: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows without a class or weekday drop out; bad times become null; breaks lose subject, teacher and number."""
    brk = F.col("is_break")
    out = raw.withColumn("class_name", X.normalize_class(F.col("class_name"))).withColumn("day", X.normalize_day(F.col("day")))
    out = out.filter(F.col("class_name").isNotNull() & F.col("day").isNotNull())
    return out.select(
        *keep, "class_name", X.normalize_section(F.col("section")).alias("section"), "day", F.coalesce("slot", F.lit(0)).alias("slot"),
        F.when(~brk, F.col("period_number")).alias("period_number"), "is_break", F.when(brk, F.coalesce(F.nullif("label", F.lit("")), F.lit("BREAK"))).alias("label"),
        _valid_clock("start_time"), _valid_clock("end_time"), F.when(brk, F.lit("")).otherwise(F.coalesce("subject", F.lit(""))).alias("subject"),
        F.when(brk, F.lit("")).otherwise(F.coalesce("teacher_name", F.lit(""))).alias("teacher_name"), _confidence(True),
    )


def sanitize_duties(raw: DataFrame, keep: Sequence[str]) -> DataFrame:
    ok = F.col("duty_date").rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.trim("teacher_name") != "")
    return raw.filter(ok).select(*keep, "duty_date", "teacher_name", F.coalesce("description", F.lit("")).alias("description"), _confidence(False))


def sanitize_offs(raw: DataFrame, keep: Sequence[str]) -> DataFrame:
    out = raw.withColumn("day", X.normalize_day(F.col("day"))).filter(F.col("day").isNotNull() & (F.trim("teacher_name") != ""))
    return out.select(*keep, "day", "teacher_name", _confidence(False))


def sanitize_remedial(raw: DataFrame, keep: Sequence[str]) -> DataFrame:
    """An unknown category is read as REMEDIAL; an unreadable class stays as printed."""
    known = F.col("category").isin("REMEDIAL", "LIFE_SKILL", "ENRICHMENT", "OTHER")
    return raw.select(
        *keep, F.when(known, F.col("category")).otherwise(F.lit("REMEDIAL")).alias("category"),
        F.coalesce(X.normalize_class(F.col("class_name")), F.col("class_name"), F.lit("")).alias("class_name"), X.normalize_section(F.col("section")).alias("section"),
        X.normalize_day(F.col("day")).alias("day"), _valid_clock("start_time"), _valid_clock("end_time"), F.coalesce("activity", F.lit("")).alias("activity"),
        F.coalesce("teacher_name", F.lit("")).alias("teacher_name"), _confidence(False),
    )


def sanitize_clubs(raw: DataFrame, keep: Sequence[str]) -> DataFrame:
    none = F.array().cast("array<string>")
    return raw.filter(F.trim("name") != "").select(
        *keep, "name", F.coalesce("teachers", none).alias("teachers"), F.coalesce("activities", none).alias("activities"), _confidence(False)
    )


def merge_pages(parts: DataFrame, key: str, order: str) -> DataFrame:
    """U4: session and title of a document are the first non-empty ones over its pages."""

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(order))).alias(c)

    return parts.groupBy(key).agg(first("session"), first("title"), F.count(F.lit(1)).alias("pages"))
