"""A2-A4: table dumps, restore of missing rows, re-attribution of references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rollbook.keyed import first_rows

# Parents come before the tables that point at them.
RESTORE_ORDER = [
    "teacher", "app_user", "subject", "school_day", "document", "draft", "extraction_log", "routine", "routine_class",
    "routine_period", "duty", "weekly_off", "notice", "remedial", "club",
]


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table."""
    out = None
    for name, df in tables.items():
        part = df.groupBy().agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def export_json(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """A2: write every table as JSON lines under `path` and return the manifest (name, rows), which is written last.

    Rows are counted by the writing job itself, so that the manifest tells what was written and no table is read twice."""
    counts = []
    for name, df in tables.items():
        seen = Observation(f"written {name}")
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").json(f"{path}/{name}")
        counts.append((name, int(seen.get["rows"] or 0)))
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame(counts, "name string, rows long")  # a row a table
    out.coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")
    return out


def read_backup(spark, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {n: spark.read.schema(s).json(f"{path}/{n}") for n, s in schemas.items()}


def restore_insert_missing(existing: DataFrame, backup: DataFrame, keys: Sequence[Sequence[str]], order: str) -> DataFrame:
    """A3: rows of the backup to insert - none of its unique keys is taken, in the table or earlier in the backup."""
    out = backup
    for key in keys:
        out = first_rows(out, key, F.col(order)).join(existing.select(*key).distinct(), list(key), "left_anti")
    return out.select(*backup.columns)


def restore_all(existing: dict[str, DataFrame], backup: dict[str, DataFrame], keys: dict[str, list[list[str]]], order: dict[str, str]) -> dict[str, DataFrame]:
    """A3 over all tables, parents first: each table with its missing rows added."""
    names = [n for n in RESTORE_ORDER if n in backup]
    return {n: existing[n].unionByName(restore_insert_missing(existing[n], backup[n], keys[n], order[n])) for n in names}


def remap_references(df: DataFrame, skipped: DataFrame, target_users: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A4: references to skipped accounts move to the target account of the same user name, else become null."""
    target = target_users.select(F.lower("username").alias("_u"), F.col("user_id").alias("_to")).groupBy("_u").agg(F.min("_to").alias("_to"))
    moves = skipped.select(F.col("user_id").alias("_from"), F.lower("username").alias("_u")).join(target, "_u", "left").select("_from", "_to")
    for f in fields:
        out = df.join(moves, df[f] == moves["_from"], "left")
        df = out.withColumn(f, F.when(F.col("_from").isNull(), F.col(f)).otherwise(F.col("_to"))).drop("_from", "_to")
    return df
