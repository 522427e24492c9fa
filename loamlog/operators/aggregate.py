"""Counts in tumbling buckets, from raw rows or from minute counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlog.functions.timestamps import bucket_start, iso_millis, split_range
from loamlog.operators import filters
from loamlog.plans.params import AggregateQuery


def _group(group_by: str | None) -> Column:
    value = F.lit(None).cast("string") if group_by is None else F.col(group_by)
    return value.alias("group")


def _weighted(df: DataFrame, ts: str, query: AggregateQuery, weight: Column) -> DataFrame:
    """Bucket, group and weight of each row, not yet aggregated."""
    return df.select(
        bucket_start(F.col(ts), query.bucket).alias("start"),
        _group(query.group_by),
        weight.cast("long").alias("count"),
    )


def _summed(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("start", "group").agg(F.sum("count").cast("long").alias("count"))


def _by_bucket(counts: DataFrame) -> DataFrame:
    return counts.orderBy("start", "group")


def aggregate_raw(logs: DataFrame, query: AggregateQuery) -> DataFrame:
    """Count matching rows per bucket and group; empty buckets do not appear."""
    return _by_bucket(
        filters.matching(logs, query)
        .groupBy(
            bucket_start(F.col("timestamp"), query.bucket).alias("start"), _group(query.group_by)
        )
        .agg(F.count(F.lit(1)).alias("count"))
    )


def _edge_rows(
    logs: DataFrame, query: AggregateQuery, ranges: Iterable[tuple[int, int]]
) -> DataFrame | None:
    inside = filters.in_any_range(logs, ranges)
    if inside is None:
        return None
    rows = filters.apply(logs, [inside, *filters.same_keys(query.service, query.level)])
    return _weighted(rows, "timestamp", query, F.lit(1))


def _middle_rows(
    rollup: DataFrame, query: AggregateQuery, middle: tuple[int, int] | None
) -> DataFrame | None:
    if middle is None:
        return None
    rows = filters.apply(
        rollup,
        [
            *filters.in_time(rollup, *middle, column="bucket_start"),
            *filters.same_keys(query.service, query.level),
        ],
    )
    return _weighted(rows, "bucket_start", query, F.col("log_count"))


def aggregate_edges(logs: DataFrame, query: AggregateQuery) -> DataFrame:
    """Counts over the partial minutes of the range only."""
    rows = _edge_rows(logs, query, split_range(query.since, query.until).edges)
    return _by_bucket(_nothing(logs, query) if rows is None else _summed(rows))


def aggregate_middle(rollup: DataFrame, query: AggregateQuery) -> DataFrame:
    """Counts over the whole minutes of the range, from the minute counts."""
    rows = _middle_rows(rollup, query, split_range(query.since, query.until).middle)
    return _by_bucket(_nothing(rollup, query, "bucket_start") if rows is None else _summed(rows))


def _nothing(df: DataFrame, query: AggregateQuery, ts: str = "timestamp") -> DataFrame:
    return _weighted(df.where(F.lit(False)), ts, query, F.lit(0))


def aggregate_rollup(logs: DataFrame, rollup: DataFrame, query: AggregateQuery) -> DataFrame:
    """Whole minutes from the counts, partial ones from raw rows.

    Both feed one sum, so a bucket fed from both sides costs a single shuffle and
    its partial sums are formed before it.
    """
    split = split_range(query.since, query.until)
    parts = [
        part
        for part in (
            _edge_rows(logs, query, split.edges),
            _middle_rows(rollup, query, split.middle),
        )
        if part is not None
    ]
    if not parts:
        return _nothing(logs, query)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    counts = _summed(rows).where(F.col("count") > 0)
    return _by_bucket(counts)


def aggregate(
    logs: DataFrame, query: AggregateQuery, rollup: DataFrame | None = None
) -> DataFrame:
    """Use the minute counts wherever the filters allow, raw rows otherwise."""
    if rollup is not None and query.countable:
        return aggregate_rollup(logs, rollup, query)
    return aggregate_raw(logs, query)


def export_buckets(counts: DataFrame) -> DataFrame:
    """Outgoing form: the bucket start as ISO text."""
    return counts.select(iso_millis(F.col("start")).alias("start"), "group", "count")
