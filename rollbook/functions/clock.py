"""Clock times, weekdays and display text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The week starts on Monday (index 0).
WEEKDAYS = ["MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY"]

CLOCK = "^([01][0-9]|2[0-3]):[0-5][0-9]$"
PRINTED_CLOCK = r"(?i)^(\d{1,2})\s*[:.;]\s*(\d{2})\s*(am|pm|a\.m\.|p\.m\.)?$"


def lookup(c: Column, table: dict) -> Column:
    """Value of a literal table, null when the key is not in it."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body uses it (keeps generated code small)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_clock(c: Column) -> Column:
    return F.coalesce(c.rlike(CLOCK), F.lit(False))


def to_minutes(c: Column) -> Column:
    """Minutes since midnight of a 24-hour "HH:MM", else null."""
    return F.when(is_clock(c), F.substring(c, 1, 2).cast("int") * 60 + F.substring(c, 4, 2).cast("int"))


def from_minutes(m: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))


def parse_clock(raw: Column) -> Column:
    """A printed time ("8:15", "12.55", "1:30 pm") as "HH:MM"; bare hours 1 to 5 are afternoon."""

    def from_parts(p: Column) -> Column:
        h, m, half = p["h"], p["m"], p["half"]
        hour = (
            F.when((half == "pm") & (h < 12), h + 12)
            .when((half == "am") & (h == 12), F.lit(0))
            .when((half == "") & h.between(1, 5), h + 12)
            .otherwise(h)
        )
        return F.when((m <= 59) & (h <= 23), F.format_string("%02d:%02d", hour, m))

    def parts(t: Column) -> Column:
        return F.struct(
            F.regexp_extract(t, PRINTED_CLOCK, 1).try_cast("int").alias("h"),
            F.regexp_extract(t, PRINTED_CLOCK, 2).try_cast("int").alias("m"),
            F.lower(F.replace(F.regexp_extract(t, PRINTED_CLOCK, 3), F.lit("."), F.lit(""))).alias("half"),
        )

    # a text that is no time never reaches the casts, which raise and catch an error for an empty text
    return let(F.trim(raw), lambda t: let(F.when(t.rlike(PRINTED_CLOCK), parts(t)), from_parts))


def clock12(m: Column) -> Column:
    """Minutes since midnight as "1:30 PM"; null stays null."""
    hour = (m / 60).cast("int")
    half = F.when(m >= 720, F.lit(" PM")).otherwise(F.lit(" AM"))
    return F.concat(((hour + 11) % 12 + 1).cast("string"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"), half)


def range12(start: Column, end: Column) -> Column:
    """ "8:15 AM - 8:55 AM"; only the known side when one is missing."""
    return F.concat_ws(" - ", clock12(start), clock12(end))


def format_clock(c: Column) -> Column:
    """ "13:30" as "1:30 PM"; empty when not a time."""
    return F.coalesce(clock12(to_minutes(c)), F.lit(""))


def format_range(start: Column, end: Column) -> Column:
    return range12(to_minutes(start), to_minutes(end))


def ordinal(n: Column) -> Column:
    v = n % 100
    suffix = (
        F.when(v.between(11, 13), F.lit("th"))
        .when(v % 10 == 1, F.lit("st"))
        .when(v % 10 == 2, F.lit("nd"))
        .when(v % 10 == 3, F.lit("rd"))
        .otherwise(F.lit("th"))
    )
    return F.concat(n.cast("string"), suffix)


def format_bytes(n: Column) -> Column:
    kb = F.round(n / 1024, 0).cast("bigint").cast("string")
    mb = F.format_string("%.1f", F.round(n / 1048576, 1))
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1048576, F.concat(kb, F.lit(" KB")))
        .otherwise(F.concat(mb, F.lit(" MB")))
    )


def format_minutes(m: Column) -> Column:
    h, rest = F.floor(m / 60).cast("int"), (m % 60).cast("int")
    hours = F.concat(h.cast("string"), F.lit("h"))
    mins = F.concat(rest.cast("string"), F.lit("m"))
    return (
        F.when(m <= 0, F.lit("-"))
        .when((h > 0) & (rest > 0), F.concat(hours, F.lit(" "), mins))
        .when(h > 0, hours)
        .otherwise(mins)
    )


def class_label(class_name: Column, section: Column) -> Column:
    return F.when(section != "", F.concat(class_name, F.lit("-"), section)).otherwise(class_name)


def day_name(day_idx: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), (day_idx + 1).cast("int"))


def day_label(day_idx: Column) -> Column:
    return F.initcap(day_name(day_idx))


def greeting(now_min: Column) -> Column:
    h = F.floor(now_min / 60)
    return F.when(h < 12, F.lit("Good Morning")).when(h < 17, F.lit("Good Afternoon")).otherwise(F.lit("Good Evening"))


def school_today(zone: str = "Asia/Kolkata") -> Column:
    """Today's date in the school's time zone."""
    return F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), zone))


def long_date(d: Column) -> Column:
    return F.date_format(d, "d MMMM yyyy")


def short_date(d: Column) -> Column:
    return F.date_format(d, "dd MMM yyyy")
