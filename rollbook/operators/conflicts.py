"""Double bookings, time gaps, duty sequences and repeated rows.

Overlap joins always carry equality keys (teacher, weekday). Rows are first folded into bookings - distinct
class-section and time of a teacher's day - so a join side is bounded by the school day, not by its row count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.keyed import later_rows, with_previous

BY = ("school_id",)


def _bookings(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first_seq"))


def _sides(cells: DataFrame, on: Sequence[str], cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    def side(s: str) -> DataFrame:
        return cells.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in cols])

    return side("a"), side("b")


def _overlap() -> Column:
    return (F.col("start_min_a") < F.col("end_min_b")) & (F.col("start_min_b") < F.col("end_min_a"))


# Unset times and numbers are kept as -1 inside bookings, so that they stay plain join keys.
_UNSET = -1
_CELL = ["class_name", "section", "start_min", "end_min", "period_number"]


def _period_cells(periods: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    rows = periods.filter(~F.col("is_break") & F.col("teacher_id").isNotNull())
    for c in ("start_min", "end_min", "period_number"):
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(_UNSET)))
    return rows, _bookings(rows, [*by, "teacher_id", "day_idx", *_CELL])


def _clashing(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pairs of bookings of one teacher and day in different class-sections that cannot both be kept, earlier first."""
    on = [*by, "teacher_id", "day_idx"]
    a, b = _sides(cells, on, [*_CELL, "rows", "first_seq"])
    timed = (F.least("start_min_a", "end_min_a", "start_min_b", "end_min_b")) != _UNSET
    same_number = (F.col("period_number_a") != _UNSET) & (F.col("period_number_a") == F.col("period_number_b"))
    other_class = (F.col("class_name_a") != F.col("class_name_b")) | (F.col("section_a") != F.col("section_b"))
    hit = F.when(timed, _overlap()).otherwise(same_number)
    return a.join(b, on).filter((F.col("first_seq_a") < F.col("first_seq_b")) & other_class & hit)


def teacher_clash(periods: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Clashing bookings of a teacher, one row per pair of bookings, reported on the later one.

    `pairs` counts the row pairs behind it (1 unless a booking is entered twice)."""
    _, cells = _period_cells(periods, by)
    return _clashing(cells, by).select(
        *by, "teacher_id", "day_idx", F.col("first_seq_a").alias("other_seq"), F.col("first_seq_b").alias("seq"),
        "class_name_a", "section_a", "class_name_b", "section_b", (F.col("rows_a") * F.col("rows_b")).alias("pairs"),
    )


def clashing_rows(periods: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Every lesson row that clashes with an earlier row of its teacher, once."""
    rows, cells = _period_cells(periods, by)
    on = [*by, "teacher_id", "day_idx"]
    pairs = _clashing(cells, by)
    towards = [
        pairs.select(*on, *[F.col(f"{c}_{s}").alias(c) for c in _CELL], F.col(f"first_seq_{o}").alias("first_seq")) for s, o in (("a", "b"), ("b", "a"))
    ]
    earliest = towards[0].unionByName(towards[1]).groupBy(*on, *_CELL).agg(F.min("first_seq").alias("_earliest"))
    return rows.join(earliest, [*on, *_CELL]).filter(F.col("_earliest") < F.col("seq")).drop("_earliest")


def remedial_clash(remedial: DataFrame, lessons: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Extra classes that overlap a lesson of the same teacher, each once."""
    on = [*by, "teacher_id", "day_idx"]
    busy = lessons.filter(~F.col("is_break") & F.col("teacher_id").isNotNull() & F.col("start_min").isNotNull() & F.col("end_min").isNotNull())
    busy = busy.select(*[F.col(c).alias(f"_b_{c}") for c in on], F.col("start_min").alias("_s"), F.col("end_min").alias("_e")).distinct()
    cond = [F.col(c) == F.col(f"_b_{c}") for c in on] + [F.col("start_min") < F.col("_e"), F.col("_s") < F.col("end_min")]
    return remedial.join(busy, cond, "left_semi")


def _remedial_cells(remedial: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    rows = remedial.filter(F.col("teacher_id").isNotNull() & F.col("day_idx").isNotNull() & F.col("start_min").isNotNull() & F.col("end_min").isNotNull())
    return rows, _bookings(rows, [*by, "teacher_id", "day_idx", "start_min", "end_min"])


def remedial_double(remedial: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Overlapping extra classes of a teacher and day as pairs of bookings with their row-pair count;
    a booking entered n times pairs with itself n(n-1)/2 times."""
    _, cells = _remedial_cells(remedial, by)
    on = [*by, "teacher_id", "day_idx"]
    a, b = _sides(cells, on, ["start_min", "end_min", "rows", "first_seq"])
    pairs = F.when(F.col("first_seq_a") == F.col("first_seq_b"), F.col("rows_a") * (F.col("rows_a") - 1) / 2).otherwise(F.col("rows_a") * F.col("rows_b"))
    out = a.join(b, on).filter((F.col("first_seq_a") <= F.col("first_seq_b")) & _overlap())
    return out.select(
        *on, F.col("first_seq_a").alias("other_seq"), F.col("first_seq_b").alias("seq"), "start_min_a", "end_min_a", "start_min_b", "end_min_b",
        pairs.cast("long").alias("pairs"),
    ).filter(F.col("pairs") > 0)


def doubled_rows(remedial: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Every extra class that overlaps an earlier one of its teacher, once."""
    rows, cells = _remedial_cells(remedial, by)
    on = [*by, "teacher_id", "day_idx"]
    a, b = _sides(cells, on, ["start_min", "end_min", "first_seq"])
    earliest = a.join(b, on).filter(_overlap()).groupBy(*on, F.col("start_min_b").alias("start_min"), F.col("end_min_b").alias("end_min"))
    earliest = earliest.agg(F.min("first_seq_a").alias("_earliest"))
    return rows.join(earliest, [*on, "start_min", "end_min"]).filter(F.col("_earliest") < F.col("seq")).drop("_earliest")


def adjacent_gap(periods: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Timed rows of a class-section and day (breaks too) against the one just before: a negative gap is an
    overlap, one of 1 to 5 minutes a likely misread digit."""
    timed = periods.filter(F.col("start_min").isNotNull() & F.col("end_min").isNotNull())
    prev = with_previous(timed, [*by, "class_name", "section", "day_idx"], ["start_min", "seq"], {"prev_end": "end_min"})
    gap = F.col("start_min") - F.col("prev_end")
    code = F.when(gap < 0, F.lit("overlap")).when(gap.between(1, 5), F.lit("timeGap"))
    return prev.withColumn("gap", gap).withColumn("code", code).filter(F.col("code").isNotNull()).drop("prev_end")


def duty_sequence(duties: DataFrame, by: Sequence[str] = BY, who: str = "teacher_id") -> DataFrame:
    """Every duty with the date of the teacher's duty just before (by date, seq): `same_day` or `next_day`."""
    prev = with_previous(duties, [*by, who], ["duty_date", "seq"], {"prev_date": "duty_date"})
    days = F.datediff("duty_date", "prev_date")
    return prev.withColumn("same_day", F.coalesce(days == 0, F.lit(False))).withColumn("next_day", F.coalesce(days == 1, F.lit(False)))


def repeated_periods(periods: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """E4 on periods: rows that repeat a class-section, day and slot."""
    return later_rows(periods, [*by, "class_name", "section", "day_idx", "slot"])


def many_per_date(duties: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """E5: dates with several masters on duty, with the first such row."""
    g = duties.filter(F.col("duty_type") == "MOD").groupBy(*by, "duty_date")
    return g.agg(F.count(F.lit(1)).alias("mods"), F.min("seq").alias("seq")).filter(F.col("mods") > 1)


def duty_on_weekly_off(duties: DataFrame, offs: DataFrame, by: Sequence[str] = BY, who: str = "teacher_id") -> DataFrame:
    """Master-on-duty days that fall on the teacher's weekly off."""
    mod = duties.filter(F.col("duty_type") == "MOD").withColumn("day_idx", F.weekday("duty_date"))
    return mod.join(offs.select(*by, who, "day_idx").distinct(), [*by, who, "day_idx"])


def duty_on_comp_off(duties: DataFrame, by: Sequence[str] = BY, who: str = "teacher_id") -> DataFrame:
    """Duties of any kind on a date the teacher has as compensatory off."""
    offs = duties.filter(F.col("off_date").isNotNull()).select(*by, who, F.col("off_date").alias("duty_date")).distinct()
    return duties.join(offs, [*by, who, "duty_date"], "left_semi")
