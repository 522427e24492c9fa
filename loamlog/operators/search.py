"""Newest-first search with keyset pages."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamlog.functions import cursors
from loamlog.functions.cursors import Cursor
from loamlog.functions.timestamps import iso_millis
from loamlog.operators import filters
from loamlog.operators.ordering import assign_ids
from loamlog.plans.params import LogQuery

NEWEST_FIRST = ("timestamp", "id")


@dataclass(frozen=True)
class Page:
    """At most ``limit`` rows in their outgoing form, and where the next page begins."""

    logs: list[dict[str, Any]]
    next_cursor: str | None

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)


def _order() -> list[Column]:
    return [F.col(name).desc() for name in NEWEST_FIRST]


def filter_logs(logs: DataFrame, query: LogQuery) -> DataFrame:
    """All matching rows, unordered and distributed."""
    return filters.matching(logs, query)


def result_columns(logs: DataFrame) -> DataFrame:
    """Outgoing columns: the id as text, derived columns left out."""
    shown = [c for c in ("timestamp", "level", "service", "message", "attributes") if c in logs.columns]
    return logs.select(F.col("id").cast("string").alias("id"), *shown)


def newest(logs: DataFrame, query: LogQuery) -> DataFrame:
    """The page and one look-ahead row, as a top-k rather than a sort."""
    return filter_logs(logs, query).orderBy(*_order()).limit(query.limit + 1)


def export_rows(logs: DataFrame) -> DataFrame:
    """One JSON text per row, as pages are handed out."""
    attributes = [
        F.col(c).alias("attributes") for c in ("attributes", "attributes_text") if c in logs.columns
    ][:1]
    fields = F.struct(
        F.col("id").cast("string").alias("id"),
        iso_millis(F.col("timestamp")).alias("timestamp"),
        "level",
        "service",
        "message",
        *attributes,
    )
    return logs.select(F.col("id"), F.to_json(fields).alias("log"))


def _collected(page: DataFrame) -> list[Row]:
    fields = page.schema
    attributes = [F.to_json("attributes").alias("attributes")] if "attributes" in page.columns else []
    local = page.select(
        "id",
        F.unix_micros(F.col("timestamp").cast(T.TimestampType())).alias("micros"),
        iso_millis(F.col("timestamp")).alias("timestamp"),
        *[c for c in ("level", "service", "message") if c in fields.names],
        *attributes,
    )
    return local.collect()


def _as_double(digits: str) -> int:
    """JSON numbers are doubles to clients; integers that fit exactly stay as they are."""
    exact = int(digits)
    return exact if abs(exact) <= 2**53 else int(float(digits))


def page_of(rows: list[Row], limit: int) -> Page:
    """Cut the look-ahead row off; its presence is what makes a next page."""
    shown = rows[:limit]
    last = shown[-1] if len(rows) > limit else None
    logs = []
    for row in shown:
        log = {k: v for k, v in row.asDict().items() if k != "micros"}
        log["id"] = str(log["id"])
        if "attributes" in log:
            log["attributes"] = json.loads(log["attributes"], parse_int=_as_double)
        logs.append(log)
    return Page(logs, None if last is None else cursors.encode(Cursor(last["micros"], last["id"])))


def collect_newest(logs: DataFrame, query: LogQuery) -> list[Row]:
    """The page's rows on the driver: never more than the limit plus one."""
    return _collected(newest(logs, query))


def search(logs: DataFrame, query: LogQuery) -> Page:
    return page_of(collect_newest(logs, query), query.limit)


def paginate(logs: DataFrame, query: LogQuery) -> DataFrame:
    """Every page of a search at once.

    Adds ``page`` (from 1), ``position`` (from 1 within the page) and, on the last
    row of each page that has a successor, the ``next_cursor`` that page returns.
    """
    keys = filter_logs(logs, query).select("id", "timestamp")
    ranked = assign_ids(keys, _order(), name="rank", start=0)
    size = query.limit
    ends_page = (F.col("position") == size) & (F.col("rank") + 1 < F.lit(ranked.count()))
    return (
        ranked.withColumn("page", F.expr(f"rank div {size}") + 1)
        .withColumn("position", (F.col("rank") % size) + 1)
        .withColumn("next_cursor", F.when(ends_page, cursors.token(F.col("timestamp"), F.col("id"))))
        .drop("rank")
    )
