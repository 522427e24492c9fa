"""Row predicates. All comparisons use literals of the column's own type, so that
the ones on stored columns reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlog.functions.cursors import Cursor
from loamlog.functions.timestamps import DAY, literal, sql_date, sql_literal

HOT_PREFIX = "attr__"


def all_of(conditions: Iterable[Column]) -> Column | None:
    conditions = list(conditions)
    return reduce(Column.__and__, conditions) if conditions else None


def any_of(conditions: Iterable[Column]) -> Column | None:
    conditions = list(conditions)
    return reduce(Column.__or__, conditions) if conditions else None


def apply(df: DataFrame, conditions: Iterable[Column]) -> DataFrame:
    condition = all_of(conditions)
    return df if condition is None else df.where(condition)


def in_dates(df: DataFrame, since: int | None, until: int | None) -> list[Column]:
    """Partition predicate for a time range; Spark does not derive it from the time one."""
    return [F.expr(text) for text in _date_bounds(df, since, until)]


def _date_bounds(df: DataFrame, since: int | None, until: int | None) -> list[str]:
    if "log_date" not in df.columns:
        return []
    lower = [] if since is None else [f"log_date >= {sql_date(since)}"]
    upper = [] if until is None else [f"log_date <= {sql_date(until - 1)}"]
    return lower + upper


def in_time(
    df: DataFrame, since: int | None, until: int | None, column: str = "timestamp"
) -> list[Column]:
    """``since <= column < until``, together with the dates that can hold such rows."""
    dtype = df.schema[column].dataType
    bounds = _date_bounds(df, since, until)
    if since is not None:
        bounds.append(f"{column} >= {sql_literal(since, dtype)}")
    if until is not None:
        bounds.append(f"{column} < {sql_literal(until, dtype)}")
    # One text for all bounds: it is parsed in a single call.
    return [F.expr(" AND ".join(bounds))] if bounds else []


def in_any_range(df: DataFrame, ranges: Iterable[tuple[int, int]]) -> Column | None:
    """Any of several half-open ranges; None when there are none."""
    return any_of(all_of(in_time(df, since, until)) for since, until in ranges)


def same_keys(service: str | None, level: str | None) -> list[Column]:
    """Filters that hold on raw rows and on minute counts alike."""
    keys = {"service": service, "level": level}
    return [F.col(name) == F.lit(value) for name, value in keys.items() if value is not None]


def message_contains(text: str, column: str = "message") -> Column:
    """Substring without regard to case; no character of ``text`` is special."""
    return F.contains(F.lower(F.col(column)), F.lower(F.lit(text)))


def escape_like(text: str) -> str:
    """``text`` for use inside an ``ilike`` pattern with a backslash escape."""
    for special in ("\\", "%", "_"):
        text = text.replace(special, "\\" + special)
    return text


def attribute_is(df: DataFrame, key: str, value: str) -> Column:
    """Equality on the text form of an attribute; a missing key never matches.

    Keys stored as their own column (see ``LogStore``) compare there, where row
    groups can be skipped; any other key looks into the map.
    """
    if HOT_PREFIX + key in df.columns:
        return df[f"`{HOT_PREFIX}{key}`"] == F.lit(value)
    return F.col("attributes_text")[F.lit(key)] == F.lit(value)


def after_cursor(df: DataFrame, cursor: Cursor) -> list[Column]:
    """Rows that follow the cursor, newest first.

    Spelled out rather than as a struct comparison, which would not be pushed down.
    """
    at = literal(cursor.micros, df.schema["timestamp"].dataType)
    ts, row_id = F.col("timestamp"), F.col("id")
    return [
        *in_dates(df, None, cursor.micros // DAY * DAY + DAY),
        ts <= at,
        (ts < at) | ((ts == at) & (row_id < F.lit(cursor.id))),
    ]


def conditions(df: DataFrame, query) -> list[Column]:
    """Every filter a query sets, joined by AND; none at all keeps every row."""
    found = in_time(df, query.since, query.until)
    found += same_keys(query.service, query.level)
    if query.q is not None:
        found.append(message_contains(query.q))
    found += [attribute_is(df, k, v) for k, v in query.attributes.items()]
    cursor = getattr(query, "cursor", None)
    if cursor is not None:
        found += after_cursor(df, cursor)
    return found


def matching(df: DataFrame, query) -> DataFrame:
    return apply(df, conditions(df, query))
