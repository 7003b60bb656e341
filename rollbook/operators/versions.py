"""Timetable versions: difference, the one in force on a date, activation, roll-back depth."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.keyed import first_rows, last_wins, running_last

BY = ("school_id",)
_SLOT = ["class_name", "section", "day_idx", "slot"]
_VALUES = ["subject", "teacher_id", "start_min", "end_min"]


def version_diff(old: DataFrame, new: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Slots added, removed or changed between two versions; breaks are left out, the last row of a slot counts."""
    key = [*by, *_SLOT]

    def side(df: DataFrame, prefix: str) -> DataFrame:
        rows = last_wins(df.filter(~F.col("is_break")), key)
        return rows.select(*key, F.lit(True).alias(f"_{prefix}"), *[F.col(c).alias(f"{prefix}_{c}") for c in _VALUES])

    both = side(old, "before").join(side(new, "after"), key, "full")
    differs = F.lit(False)
    for c in _VALUES:
        differs = differs | ~F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}"))
    kind = F.when(F.col("_before").isNull(), F.lit("added")).when(F.col("_after").isNull(), F.lit("removed")).when(differs, F.lit("changed"))
    return both.withColumn("kind", kind).filter(F.col("kind").isNotNull()).drop("_before", "_after")


def diff_affecting(diff: DataFrame, teacher_id: int | None = None) -> DataFrame:
    """Diff rows per teacher on either side; all teachers when none is named."""
    if teacher_id is not None:
        return diff.filter((F.col("before_teacher_id") == teacher_id) | (F.col("after_teacher_id") == teacher_id))
    sides = F.array_distinct(F.array_compact(F.array("before_teacher_id", "after_teacher_id")))
    return diff.withColumn("teacher_id", F.explode(sides))


def routine_as_of(routines: DataFrame, dates: DataFrame, by: Sequence[str] = BY, day: str = "day") -> DataFrame:
    """The version in force on each (school, date): latest effective date, then highest version.

    An as-of merge: starts and dates are laid on one line and the last start is carried down."""
    starts = routines.groupBy(*by, F.col("effective_from").alias(day)).agg(F.max("version").alias("version"))
    starts = starts.withColumn("_kind", F.lit(0))
    asked = dates.select(*by, day).distinct().withColumn("version", F.lit(None).cast("int")).withColumn("_kind", F.lit(1))
    line = starts.unionByName(asked).withColumn("_at", F.unix_date(day).cast("long") * 2 + F.col("_kind"))
    return running_last(line, by, ["_at"], ["version"]).filter("_kind = 1").drop("_kind", "_at")


def activate_due(routines: DataFrame, as_of: date, by: Sequence[str] = BY) -> DataFrame:
    """Due scheduled versions take over - the latest effective (then highest) becomes active; the old active one
    and the other due ones are archived on that day."""
    due = (F.col("status") == "SCHEDULED") & (F.col("effective_from") <= F.lit(as_of))
    winner = routines.filter(due).groupBy(*by).agg(F.max(F.struct("effective_from", "version"))["version"].alias("_winner"))
    out = routines.join(winner, list(by), "left")
    wins = due & (F.col("version") == F.col("_winner"))
    retired = F.col("_winner").isNotNull() & ((F.col("status") == "ACTIVE") | due)
    return out.select(
        *[c for c in routines.columns if c not in ("status", "archived_on")],
        F.when(wins, F.lit("ACTIVE")).when(retired, F.lit("ARCHIVED")).otherwise(F.col("status")).alias("status"),
        F.when(wins, F.lit(None).cast("date")).when(retired, F.lit(as_of)).otherwise(F.col("archived_on")).alias("archived_on"),
    )


def active_routine(routines: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return first_rows(routines.filter(F.col("status") == "ACTIVE"), by, F.col("version").desc())


def previous_routine(routines: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Last archived version that records when it was archived."""
    old = routines.filter((F.col("status") == "ARCHIVED") & F.col("archived_on").isNotNull())
    return first_rows(old, by, F.col("archived_on").desc(), F.col("version").desc())


def upcoming_routine(routines: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return first_rows(routines.filter(F.col("status") == "SCHEDULED"), by, F.col("effective_from"), F.col("version"))


def next_version(routines: DataFrame, schools: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Highest version plus one; 1 for a school without any."""
    top = routines.groupBy(*by).agg(F.max("version").alias("_top"))
    return schools.select(*by).distinct().join(top, list(by), "left").select(*by, (F.coalesce("_top", F.lit(0)) + 1).alias("next_version"))


def beyond_newest(routines: DataFrame, cutoff: date | Column, keep: int = 2, by: Sequence[str] = BY) -> DataFrame:
    """Archived versions older than the newest `keep` and archived (or else published) before the cutoff."""
    cutoff = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    archived = routines.filter(F.col("status") == "ARCHIVED")
    kept = first_rows(archived.select(*by, "version"), by, F.col("version").desc(), k=keep)
    floor = kept.groupBy(*by).agg(F.min("version").alias("_floor"))
    old = archived.join(floor, list(by)).filter(F.col("version") < F.col("_floor")).drop("_floor")
    return old.filter(F.coalesce("archived_on", "published_on") < cutoff)


def last_duty(duties: DataFrame, start: date, days: int = 14, by: Sequence[str] = BY) -> DataFrame:
    """Each teacher's latest duty in the days before a date."""
    recent = duties.filter((F.col("duty_date") < F.lit(start)) & (F.col("duty_date") >= F.date_sub(F.lit(start), days)))
    return recent.groupBy(*by, "teacher_id").agg(F.max("duty_date").alias("last_date"))
