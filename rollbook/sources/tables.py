"""A1: typed readers. Schemas are declared, so no job runs to infer them and scans prune columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The tables the registered queries read.
BASE_SCHEMAS: dict[str, str] = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE,"
    " l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

# The school tables themselves: what a deployment stores, one Parquet folder per name.
# Facts carry school_id and, where input order matters, seq.
ENTITY_SCHEMAS: dict[str, str] = {
    "teacher": "teacher_id BIGINT, school_id INT, name STRING, code STRING, designation STRING, aliases ARRAY<STRING>, active BOOLEAN",
    "app_user": "user_id BIGINT, school_id INT, username STRING, teacher_id BIGINT, active BOOLEAN",
    "routine": "school_id INT, version INT, title STRING, session STRING, status STRING, effective_from DATE, published_on DATE, archived_on DATE, doc_id BIGINT",
    "routine_class": "school_id INT, version INT, class_name STRING, section STRING",
    "routine_period": "school_id INT, version INT, seq BIGINT, class_name STRING, section STRING, day_idx INT, slot INT, period_number INT,"
    " is_break BOOLEAN, label STRING, start_time STRING, end_time STRING, subject STRING, teacher_id BIGINT, teacher_name STRING, room STRING, confidence DOUBLE",
    "subject": "subject_id BIGINT, school_id INT, name STRING",
    "school_day": "school_id INT, day_idx INT",
    "duty": "duty_id BIGINT, school_id INT, teacher_id BIGINT, teacher_name STRING, duty_date DATE, duty_type STRING, description STRING,"
    " house STRING, classes STRING, off_date DATE, doc_id BIGINT",
    "weekly_off": "school_id INT, teacher_id BIGINT, day_idx INT, doc_id BIGINT",
    "remedial": "school_id INT, seq BIGINT, category STRING, class_name STRING, section STRING, day_idx INT, start_time STRING, end_time STRING,"
    " activity STRING, teacher_id BIGINT, teacher_name STRING, active BOOLEAN, doc_id BIGINT",
    "club": "club_id BIGINT, school_id INT, name STRING, members ARRAY<STRING>, activities ARRAY<STRING>, active BOOLEAN, doc_id BIGINT",
    "notice": "notice_id BIGINT, school_id INT, title STRING, description STRING, notice_date DATE, priority STRING, archived BOOLEAN, doc_id BIGINT",
    "document": "doc_id BIGINT, school_id INT, title STRING, original_name STRING, mime STRING, kind STRING, size_bytes BIGINT, sha256 STRING,"
    " storage_key STRING, extraction_status STRING, archived BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP",
    "draft": "doc_id BIGINT, school_id INT, status STRING, stage STRING, raw_text STRING, data STRING, updated_at TIMESTAMP",
    "extraction_log": "log_id BIGINT, doc_id BIGINT, level STRING, stage STRING, message STRING, meta STRING, created_at TIMESTAMP",
    "activity": "event_id BIGINT, school_id INT, actor_id BIGINT, action STRING, entity_type STRING, entity_id STRING, summary STRING,"
    " old_value STRING, new_value STRING, created_at TIMESTAMP",
    "stored_file": "storage_key STRING, data BINARY",
}


def load_base(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(BASE_SCHEMAS[name]).parquet(f"{path}/{name}.parquet")


def load_tables(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """A1: the entity tables under a folder, with declared types. Missing optional tables are skipped by `names`."""
    return {n: spark.read.schema(ENTITY_SCHEMAS[n]).parquet(f"{path}/{n}") for n in (names or ENTITY_SCHEMAS)}


def save_table(df: DataFrame, path: str, name: str, partition_by: list[str] | None = None) -> None:
    """Write one entity table; hot schools are split over files by a row limit, not by one task per school."""
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", 5_000_000)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/{name}")
