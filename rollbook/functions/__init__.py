"""Thin Column builders over pyspark.sql.functions (no Python UDFs)."""
