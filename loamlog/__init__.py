"""Structured log analytics on Spark: ingest, search, count and expire log records."""

from loamlog.operators.aggregate import aggregate
from loamlog.operators.retention import retain
from loamlog.operators.search import filter_logs, paginate, search
from loamlog.operators.validate import check_requests, ingest_report
from loamlog.plans.params import AggregateQuery, LogQuery
from loamlog.schema import IngestConfig, RetentionConfig
from loamlog.session import configure
from loamlog.sources.store import LogStore
from loamlog.streaming.ingest import ingest_stream, maintenance_stream

__all__ = [
    "AggregateQuery",
    "IngestConfig",
    "LogQuery",
    "LogStore",
    "RetentionConfig",
    "aggregate",
    "check_requests",
    "configure",
    "filter_logs",
    "ingest_report",
    "ingest_stream",
    "maintenance_stream",
    "paginate",
    "retain",
    "search",
]
