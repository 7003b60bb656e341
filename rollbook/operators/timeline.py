"""A teacher's day as one timeline of lessons and extra classes: free time, live status, weekly workload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.clock import class_label

BY = ("school_id",)


def merge_timeline(periods: DataFrame, remedial: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Lessons (no breaks) and extra classes as timed blocks; rows without a teacher, day or time drop out.

    `kind` 0 is a lesson, 1 an extra class: lessons come first among equal starts."""

    def blocks(df: DataFrame, kind: int, label: Column) -> DataFrame:
        timed = df.filter(F.col("teacher_id").isNotNull() & F.col("day_idx").isNotNull() & F.col("start_min").isNotNull() & F.col("end_min").isNotNull())
        return timed.select(*by, "teacher_id", "day_idx", F.lit(kind).alias("kind"), "seq", "start_min", "end_min", label.alias("label"))

    lessons = blocks(periods.filter(~F.col("is_break")), 0, F.concat(F.lit("Class "), class_label(F.col("class_name"), F.col("section"))))
    extra = blocks(remedial.filter("active"), 1, F.coalesce(F.nullif(F.col("activity"), F.lit("")), F.lit("Remedial/enrichment duty")))
    return lessons.unionByName(extra)


def free_minutes(blocks: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Minutes between consecutive blocks, per teacher, over the days that hold at least one lesson.

    A block is compared with the one just before it (by start, kind, seq). Blocks are first folded per start
    minute with map-side aggregation, so the window sees at most 1,440 rows per teacher and day."""
    day = [*by, "teacher_id", "day_idx"]
    own_gap = F.greatest(F.col("start_min") - F.col("end_min"), F.lit(0))
    starts = blocks.groupBy(*day, "start_min").agg(
        F.max_by("end_min", F.struct("kind", "seq")).alias("last_end"),
        F.sum(own_gap).alias("inside"),
        F.min("kind").alias("kind"),
    )
    prev_end = F.lag("last_end").over(Window.partitionBy(*day).orderBy("start_min"))
    gap = F.coalesce(F.greatest(F.col("start_min") - prev_end, F.lit(0)), F.lit(0))
    inside = F.col("inside") - F.greatest(F.col("start_min") - F.col("last_end"), F.lit(0))
    days = starts.withColumn("gap", gap + inside).groupBy(*day).agg(F.sum("gap").alias("gap"), F.min("kind").alias("kind"))
    return days.filter(F.col("kind") == 0).groupBy(*by, "teacher_id").agg(F.sum("gap").alias("free_minutes"))


def day_status(blocks: DataFrame, now: Column, by: Sequence[str] = BY) -> DataFrame:
    """Per teacher of one day's blocks - in-class (minutes left), upcoming (minutes to start) or day-done.

    Teachers without blocks are absent; `teacher_status` adds them as no-classes."""
    order = F.struct("start_min", "kind", "seq")
    inside = (F.col("start_min") <= now) & (now < F.col("end_min"))
    ahead = F.col("start_min") > now
    packed = F.struct("label", "start_min", "end_min")
    g = blocks.groupBy(*by, "teacher_id").agg(
        F.min_by(packed, F.when(inside, order)).alias("cur"), F.min_by(packed, F.when(ahead, order)).alias("nxt"), F.max(now).alias("now")
    )
    now = F.col("now")
    has_cur, has_nxt = F.col("cur").isNotNull(), F.col("nxt").isNotNull()
    return g.select(
        *by, "teacher_id",
        F.when(has_cur, F.lit("in-class")).when(has_nxt, F.lit("upcoming")).otherwise(F.lit("day-done")).alias("status"),
        F.when(has_cur, F.col("cur.label")).when(has_nxt, F.col("nxt.label")).alias("label"),
        F.when(has_cur, F.col("cur.end_min") - now).when(has_nxt, F.col("nxt.start_min") - now).alias("minutes"),
    )


def teacher_status(blocks: DataFrame, teachers: DataFrame, now: Column, by: Sequence[str] = BY) -> DataFrame:
    out = teachers.select(*by, "teacher_id").join(day_status(blocks, now, by), [*by, "teacher_id"], "left")
    return out.withColumn("status", F.coalesce("status", F.lit("no-classes")))


def teacher_workload(teachers: DataFrame, periods: DataFrame, remedial: DataFrame, duties: DataFrame, version: int, by: Sequence[str] = BY) -> DataFrame:
    """Per active teacher - periods and distinct class-sections a week, duties as master on duty, free minutes.

    The distinct count is two plain aggregations, so a teacher with very many rows is combined map-side."""
    key = [*by, "teacher_id"]
    lessons = periods.filter((F.col("version") == version) & ~F.col("is_break") & F.col("teacher_id").isNotNull())
    per_class = lessons.groupBy(*key, "class_name", "section").agg(F.count(F.lit(1)).alias("n"))
    load = per_class.groupBy(*key).agg(F.sum("n").alias("periods_per_week"), F.count(F.lit(1)).alias("classes"))
    mod = duties.filter(F.col("duty_type") == "MOD").groupBy(*key).agg(F.count(F.lit(1)).alias("mod_duties"))
    free = free_minutes(merge_timeline(lessons, remedial, by), by)
    out = teachers.filter("active").select(*key, "name")
    for side in (load, mod, free):
        out = out.join(side, key, "left")
    zero = F.lit(0).cast("long")
    counts = ["periods_per_week", "classes", "mod_duties", "free_minutes"]
    return out.select(*key, "name", *[F.coalesce(F.col(c), zero).alias(c) for c in counts])
