"""Expiring old rows while the minute counts stay exact."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamlog.functions.timestamps import DAY, MINUTE, bucket_start, literal
from loamlog.operators import filters
from loamlog.operators.ordering import assign_ids, nth_bucket
from loamlog.operators.rollup import minute_rollup
from loamlog.schema import ROLLUP_KEYS, RetentionConfig
from loamlog.session import temporary_scratch


def cutoff(now: int, config: RetentionConfig) -> int:
    return now - config.days * DAY


@dataclass(frozen=True)
class Boundary:
    """Everything before ``micros`` goes; at ``micros`` itself, ids up to ``last_id``."""

    micros: int
    last_id: int | None = None

    def covers(self, dtype: T.DataType) -> Column:
        """Predicate for the rows to delete."""
        at = literal(self.micros, dtype)
        ts = F.col("timestamp")
        if self.last_id is None:
            return ts < at
        return (ts <= at) & ((ts < at) | (F.col("id") <= F.lit(self.last_id)))


def expired(logs: DataFrame, before: int) -> DataFrame:
    return filters.apply(logs, filters.in_time(logs, None, before))


def find_boundary(
    logs: DataFrame, before: int, max_rows: int | None, minutes: DataFrame | None = None
) -> Boundary:
    """Where deletion stops: the cutoff, or the ``max_rows``-th oldest row if that comes first.

    Deleted rows are a prefix of the (timestamp, id) order, so one position says it
    all and no list of rows is needed. It is narrowed by counting days, then the
    minutes of one day, in the minute counts (``minutes``) or else in the rows; only the rows of
    the minute it falls into are read for certain, and ordered.
    """
    if max_rows is None:
        return Boundary(before)
    old = expired(logs, before)
    # The cutoff's own minute counts in full; if the end falls into it, its rows decide.
    counted = None
    if minutes is not None:
        bounds = filters.in_time(minutes, None, before, column="bucket_start")
        counted = filters.apply(minutes, bounds)
    micros = F.unix_micros(F.col("timestamp").cast(T.TimestampType()))
    within, start, end = max_rows, None, before
    for width, bucket in ((DAY, "1d"), (MINUTE, "1m")):
        if counted is None:
            scope = filters.apply(old, filters.in_time(old, start, end))
            at, size = F.col("timestamp"), F.count(F.lit(1))
        else:
            scope = filters.apply(counted, filters.in_time(counted, start, end, column="bucket_start"))
            at, size = F.col("bucket_start"), F.sum("log_count")
        counts = scope.groupBy(bucket_start(at, bucket).alias("b")).agg(size.alias("n"))
        start, skipped = nth_bucket(
            counts.select(F.unix_micros(F.col("b").cast(T.TimestampType())).alias("bucket"), "n"),
            within,
        )
        if start is None:
            return Boundary(before)
        within -= skipped
        end = min(start + width, before)
    minute = filters.apply(old, filters.in_time(old, start, end)).select("timestamp", "id")
    with temporary_scratch(logs.sparkSession):
        ranked = assign_ids(minute, [F.col("timestamp").asc(), F.col("id").asc()], name="rank")
        last = ranked.where(F.col("rank") == within).select(micros.alias("at"), "id").first()
    return Boundary(before) if last is None else Boundary(last["at"], last["id"])


def deleted_rows(logs: DataFrame, boundary: Boundary) -> DataFrame:
    dates = filters.in_dates(logs, None, boundary.micros + 1)
    return filters.apply(logs, [*dates, boundary.covers(logs.schema["timestamp"].dataType)])


def surviving_rows(logs: DataFrame, boundary: Boundary) -> DataFrame:
    return logs.where(~boundary.covers(logs.schema["timestamp"].dataType))


def _before_and_removed(rollup: DataFrame, removed: DataFrame) -> DataFrame:
    """Per key the stored count (NULL where none is stored) and the rows removed from it.

    Both sides are additive, so they meet in one aggregation instead of a join.
    """
    nothing = F.lit(None).cast("long")
    both = rollup.select(
        *ROLLUP_KEYS, F.col("log_count").alias("stored"), nothing.alias("removed")
    ).unionByName(
        removed.select(*ROLLUP_KEYS, nothing.alias("stored"), F.col("log_count").alias("removed"))
    )
    return both.groupBy(*ROLLUP_KEYS).agg(
        F.sum("stored").cast("long").alias("stored"),
        F.coalesce(F.sum("removed"), F.lit(0)).cast("long").alias("removed"),
    )


def decremented_rollup(rollup: DataFrame, deleted: DataFrame) -> DataFrame:
    """Counts less the deleted rows; keys nothing is left of disappear.

    Counts without a match stay, and deletions without a stored count are ignored.
    """
    left = F.col("stored") - F.col("removed")
    return (
        _before_and_removed(rollup, minute_rollup(deleted.drop("log_date")))
        .where(left > 0)
        .select(*ROLLUP_KEYS, left.alias("log_count"))
    )


def totals_of(rollup: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows deleted, and count rows that came down to nothing with them."""
    emptied = (F.col("removed") > 0) & (F.col("stored") - F.col("removed") <= 0)
    return _before_and_removed(rollup, removed).agg(
        F.coalesce(F.sum("removed"), F.lit(0)).cast("long").alias("deleted_count"),
        F.count_if(emptied).alias("rollup_rows_removed"),
    )


def retention_totals(rollup: DataFrame, deleted: DataFrame) -> DataFrame:
    return totals_of(rollup, minute_rollup(deleted.drop("log_date")))


@dataclass(frozen=True)
class Retained:
    survivors: DataFrame
    rollup: DataFrame
    totals: DataFrame


def retain(
    logs: DataFrame, rollup: DataFrame, now: int, config: RetentionConfig | None = None
) -> Retained:
    """One retention run over plain DataFrames; ``LogStore.retain`` does it on stored tables."""
    config = config or RetentionConfig()
    if not config.enabled:
        none = logs.where(F.lit(False))
        return Retained(logs, rollup, retention_totals(rollup, none))
    boundary = find_boundary(logs, cutoff(now, config), config.max_rows)
    deleted = deleted_rows(logs, boundary)
    return Retained(
        surviving_rows(logs, boundary),
        decremented_rollup(rollup, deleted),
        retention_totals(rollup, deleted),
    )
