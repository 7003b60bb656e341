"""Counts, loads, grids and size reports. Children are aggregated before they meet their parents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.operators.reads import PENDING

BY = ("school_id",)
def _zero() -> Column:
    return F.lit(0).cast("long")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dashboard_counts(teachers: DataFrame, docs: DataFrame, routines: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """G1: active teachers, live and pending documents, timetable versions per school.

    One aggregation over the tagged union, instead of joining one-row frames."""
    live = ~F.col("archived")

    def tagged(df: DataFrame, **flags: Column) -> DataFrame:
        names = ["teachers", "documents", "pending", "published"]
        return df.select(*by, *[flags.get(n, F.lit(False)).cast("long").alias(n) for n in names])

    parts = [
        tagged(teachers, teachers=F.col("active")),
        tagged(docs, documents=live, pending=live & F.col("extraction_status").isin(PENDING)),
        tagged(routines, published=F.lit(True)),
    ]
    return _union(parts).groupBy(*by).agg(*[F.sum(n).alias(n) for n in ("teachers", "documents", "pending", "published")])


def duty_counts(duties: DataFrame, duty_type: str, by: Sequence[str] = BY) -> DataFrame:
    """G2."""
    return duties.filter(F.col("duty_type") == duty_type).groupBy(*by, "teacher_id").agg(F.count(F.lit(1)).alias("duties"))


def load_by_day(periods: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Lessons by teacher and weekday."""
    lessons = periods.filter(~F.col("is_break") & F.col("teacher_id").isNotNull())
    return lessons.groupBy(*by, "teacher_id", "day_idx").agg(F.count(F.lit(1)).alias("lessons"))


def routine_sizes(periods: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Periods and classes of each version."""
    per_class = periods.groupBy(*by, "version", "class_name", "section").agg(F.count(F.lit(1)).alias("n"))
    return per_class.groupBy(*by, "version").agg(F.sum("n").alias("periods"), F.count(F.lit(1)).alias("classes"))


def subject_counts(periods: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Lessons per subject."""
    rows = periods.filter(~F.col("is_break") & (F.trim("subject") != ""))
    return rows.groupBy(*by, "subject").agg(F.count(F.lit(1)).alias("periods"))


def teacher_references(teachers: DataFrame, periods: DataFrame, duties: DataFrame, offs: DataFrame, remedial: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Rows that point at each teacher; hard references are timetable rows (periods, extra classes)."""
    key = [*by, "teacher_id"]

    def counted(df: DataFrame, hard: bool) -> DataFrame:
        rows = df.filter(F.col("teacher_id").isNotNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        return rows.select(*key, F.col("n").alias("refs"), (F.col("n") if hard else _zero()).alias("hard_refs"))

    parts = [counted(periods, True), counted(remedial, True), counted(duties, False), counted(offs, False)]
    refs = _union(parts).groupBy(*key).agg(F.sum("refs").alias("refs"), F.sum("hard_refs").alias("hard_refs"))
    out = teachers.select(*key).join(refs, key, "left")
    return out.select(*key, F.coalesce("refs", _zero()).alias("refs"), F.coalesce("hard_refs", _zero()).alias("hard_refs"))


def table_sizes(tables: dict[str, tuple[DataFrame, Column]], budget_bytes: int = 512 * 1024 * 1024, k: int = 8) -> DataFrame:
    """Rows, bytes and share of the storage budget of the k largest tables; sizes come from the data itself."""
    parts = [
        df.select(F.lit(label).alias("label"), size.cast("long").alias("bytes")).groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), _zero()).alias("bytes"))
        for label, (df, size) in tables.items()
    ]
    share = F.round(F.col("bytes") * 100 / F.lit(budget_bytes), 2).alias("percent")
    return _union(parts).filter("bytes > 0").select("label", "rows", "bytes", share).orderBy(F.col("bytes").desc(), "label").limit(k)


def file_totals(docs: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Files and bytes kept per school."""
    return docs.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


def name_usage(facts: Sequence[DataFrame], by: Sequence[str] = BY, often: int = 3) -> DataFrame:
    """Uses of each printed name over several facts; `frequent` from three uses on."""
    names = _union([f.select(*by, F.trim("teacher_name").alias("name")) for f in facts]).filter(F.col("name") != "")
    return names.groupBy(*by, "name").agg(F.count(F.lit(1)).alias("uses")).withColumn("frequent", F.col("uses") >= often)


def review_order(usage: DataFrame, resolved: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """unresolved names first, then by uses and name. `resolved` holds (by, name, teacher_id)."""
    out = usage.join(resolved.select(*by, "name", "teacher_id"), [*by, "name"], "left")
    return out.withColumn("unresolved", F.col("teacher_id").isNull()).orderBy(*by, F.col("unresolved").desc(), F.col("uses").desc(), "name")


def low_confidence_count(kinds: dict[str, DataFrame], threshold: float = 0.75, by: Sequence[str] = BY) -> DataFrame:
    """Doubtful rows per school over all record kinds."""
    rows = _union([df.select(*by, F.lit(k).alias("kind"), F.col("confidence").cast("double").alias("confidence")) for k, df in kinds.items()])
    return rows.groupBy(*by).agg(F.count_if(F.col("confidence") < threshold).alias("doubtful"))


def slot_header(periods: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Column heads of a class timetable - the first row's number, break flag and label, and the first set
    start with its end."""
    timed = F.when(F.col("start_min").isNotNull(), F.col("seq"))
    g = periods.groupBy(*by, "class_name", "section", "slot").agg(
        F.min_by(F.struct("period_number", "is_break", "label"), "seq").alias("head"),
        F.min_by("start_min", timed).alias("start_min"),
        F.min_by("end_min", timed).alias("end_min"),
    )
    return g.select(*by, "class_name", "section", "slot", "head.period_number", "head.is_break", "head.label", "start_min", "end_min")


def timetable_grid(rows: DataFrame, slots: Sequence[int], by: Sequence[str] = BY) -> DataFrame:
    """One row per class-section and day, one column per slot with "subject / teacher"; the last row of a slot
    counts. Slots are given, so no job looks for them; `outside` counts the rows of other slots."""
    cell = F.when(F.col("is_break"), F.coalesce("label", F.lit("BREAK"))).otherwise(F.concat_ws(" / ", F.nullif("subject", F.lit("")), "teacher_name"))
    columns = [F.max_by(F.when(F.col("slot") == s, F.col("cell")), F.when(F.col("slot") == s, F.col("seq"))).alias(f"slot_{s}") for s in slots]
    outside = F.count_if(~F.coalesce(F.col("slot").isin(*slots), F.lit(False))).alias("outside")
    return rows.withColumn("cell", cell).groupBy(*by, "class_name", "section", "day_idx").agg(*columns, outside)


def who_teaches_what(periods: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Lessons per teacher and subject, per class-section and (section "*") per class."""
    rows = periods.filter(~F.col("is_break") & F.col("teacher_id").isNotNull() & (F.trim("subject") != ""))
    key = [*by, "class_name", "teacher_id"]
    fine = rows.groupBy(*key, "section", F.trim("subject").alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    both = fine.withColumn("section", F.explode(F.array("section", F.lit("*"))))
    return both.groupBy(*key, "section", "subject").agg(F.sum("n").alias("lessons"))


def roster_stats(pool: DataFrame, duties: DataFrame, offs: DataFrame, remedial: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Whole-day duties, extra classes, weekly off and compensatory offs per teacher; names two people share."""
    key = [*by, "teacher_id"]
    duty = duties.groupBy(*key).agg(
        F.count_if(F.col("duty_type") == "MOD").alias("mod"), F.count_if(F.col("duty_type") == "HOLIDAY").alias("holiday"), F.count("off_date").alias("comp_offs")
    )
    off = offs.groupBy(*key).agg(F.max("day_idx").alias("off_day"))
    extra = remedial.groupBy(*key).agg(F.count(F.lit(1)).alias("remedial"))
    shared = pool.groupBy(*by, "name").agg((F.count(F.lit(1)) > 1).alias("shared_name"))
    out = pool.select(*key, "name").join(shared, [*by, "name"])
    for side in (duty, off, extra):
        out = out.join(side, key, "left")
    return out.select(*key, "name", "shared_name", "off_day", *[F.coalesce(F.col(c), _zero()).alias(c) for c in ("mod", "holiday", "remedial", "comp_offs")])


def roster_spread(stats: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """How far apart the busiest and the least busy teacher of a school are."""
    total = F.col("mod") + F.col("holiday")
    return stats.groupBy(*by).agg((F.max(total) - F.min(total)).alias("spread"), F.count_if("shared_name").alias("shared_names"))


def draft_text_bytes(drafts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Raw text that may be dropped once a draft is finished."""
    done = drafts.filter(F.col("text").isNotNull() & F.col("extraction_status").isin("PUBLISHED", "CANCELLED", "FAILED"))
    return done.groupBy(*by).agg(F.count(F.lit(1)).alias("drafts"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
