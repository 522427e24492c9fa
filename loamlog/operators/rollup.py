"""Counts per minute, service and level, kept as additive rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlog.functions.timestamps import bucket_start
from loamlog.schema import ROLLUP_KEYS


def _keys(df: DataFrame) -> list[Column | str]:
    """Minute keys, and the date partition where the rows carry one."""
    extra = ["log_date"] if "log_date" in df.columns else []
    return [bucket_start(F.col("timestamp"), "1m").alias("bucket_start"), "service", "level", *extra]


def minute_rollup(logs: DataFrame, *more: str) -> DataFrame:
    """Rows per minute, service and level. Map-side partial counts bound the shuffle."""
    return logs.groupBy(*_keys(logs), *more).agg(F.count(F.lit(1)).alias("log_count"))


def merge_rollups(*parts: DataFrame) -> DataFrame:
    """Sum additive rows per key; keys that come down to nothing disappear."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    keys = [*ROLLUP_KEYS, *(["log_date"] if "log_date" in merged.columns else [])]
    return (
        merged.groupBy(*keys)
        .agg(F.sum("log_count").cast("long").alias("log_count"))
        .where(F.col("log_count") > 0)
    )


def negated(rollup: DataFrame) -> DataFrame:
    """The additive rows that take these counts away again."""
    return rollup.withColumn("log_count", -F.col("log_count"))
