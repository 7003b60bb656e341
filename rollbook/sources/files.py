"""People lists and uploaded files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.clock import let
from rollbook.functions.text import blank_to_null

# Post codes at the start of a list column, accepted types and their first bytes.
LIST_CODE = r"(?i)^(TGT|PGT|PRT|PET|PPL|PAT|HM|VP|LIB|CT)\b"
MAGIC = {
    ".pdf": "255044462D",
    ".jpg": "FFD8FF",
    ".jpeg": "FFD8FF",
    ".png": "89504E470D0A1A0A",
    ".doc": "D0CF11E0A1B11AE1",
    ".docx": "504B0304",
}


def import_people(lines: DataFrame, column: str = "value") -> DataFrame:
    """A5: "Name, Code, Designation" lines (comma, tab or bar) or "Code = Name"; the code may come first."""
    c = F.col(column)
    by_equals = F.size(F.split(c, "=")) == 2
    raw = F.when(by_equals, F.split(c, "=")).otherwise(F.split(c, r"\t|\||,"))
    parts = F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != "")

    def read(p: Column) -> Column:
        a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        swap = a.rlike(LIST_CODE) & b.isNotNull() & ~b.rlike(LIST_CODE)
        name, code = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
        return F.struct(name.alias("name"), blank_to_null(code).alias("code"), F.get(p, F.lit(2)).alias("designation"))

    out = lines.select(F.explode(F.array(let(parts, read))).alias("p")).select("p.*")
    return out.filter(F.length("name") >= 2)


def read_people(spark: SparkSession, path: str) -> DataFrame:
    return import_people(spark.read.text(path))


def clean_file_name(name: Column) -> Column:
    base = F.element_at(F.split(F.regexp_replace(name, r"\\", "/"), "/"), -1)
    s = F.trim(F.regexp_replace(F.regexp_replace(base, r'[\x00-\x1f\x7f<>:"|?*]', ""), r"\s+", " "))
    return F.coalesce(blank_to_null(F.substring(s, 1, 150)), F.lit("document"))


def describe_files(files: DataFrame) -> DataFrame:
    """Name, extension, size, sha256 and title (from the name, at most 160 characters) of (path, content)."""
    name = clean_file_name(F.col("path"))
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    title = F.substring(F.regexp_replace(name, r"\.[^.]+$", ""), 1, 160)
    return files.select(
        "path", name.alias("name"), ext.alias("extension"), F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), title.alias("title")
    )


def ingest_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A6 from a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return describe_files(files.select("path", "content"))


def admit_files(files: DataFrame, max_bytes: int = 25 * 1024 * 1024) -> DataFrame:
    """The first reason to refuse each (path, content): empty, too large, unknown type, wrong content, active
    content; null when it may be stored. Only the bytes needed are compared."""
    name = clean_file_name(F.col("path"))
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    size = F.octet_length("content")
    right = F.lit(False)
    for e, sig in MAGIC.items():
        right = right | ((ext == e) & (F.hex(F.substring("content", 1, len(sig) // 2)) == sig))
    text = F.decode("content", "ISO-8859-1")
    active = (ext == ".pdf") & text.rlike(r"/(Launch|EmbeddedFile)\b")
    reason = (
        F.when(size == 0, F.lit("empty"))
        .when(size > max_bytes, F.lit("too large"))
        .when(~ext.isin(list(MAGIC)), F.lit("unsupported type"))
        .when(~right, F.lit("content does not match"))
        .when(active, F.lit("active content"))
    )
    return files.select("path", reason.alias("refusal"))
