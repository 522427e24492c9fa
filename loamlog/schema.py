"""Table shapes, value domains and job settings."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T

# The log levels, and the bucket names with their durations.
LEVELS = ("debug", "info", "warn", "error")
BUCKETS = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}
GROUPS = ("service", "level")

LOGS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("attributes", T.VariantType()),
        T.StructField("attributes_text", T.MapType(T.StringType(), T.StringType())),
    ]
)

ROLLUP_KEYS = ("bucket_start", "service", "level")
ROLLUP = T.StructType(
    [
        T.StructField("bucket_start", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("log_count", T.LongType()),
    ]
)

# Where a request came from: its file, the place in it where the reading task began, and the
# line counted from there (from 1; the file's own line number unless the file was split).
ARRIVAL = T.StructType(
    [
        T.StructField("modified", T.TimestampType()),
        T.StructField("file", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("line", T.LongType()),
    ]
)

REJECTED = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("index", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("entry", T.StringType()),
        T.StructField("arrival", ARRIVAL),
    ]
)

REPORTS = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("arrival", ARRIVAL),
        T.StructField("accepted", T.LongType()),
        T.StructField(
            "rejected",
            T.ArrayType(
                T.StructType(
                    [T.StructField("index", T.IntegerType()), T.StructField("reason", T.StringType())]
                )
            ),
        ),
        T.StructField("error", T.StringType()),
    ]
)

# Where rows live on disk: one folder per UTC day, and inside it one per write.
PLACEMENT = T.StructType(
    [
        T.StructField("log_date", T.DateType()),
        T.StructField("batch_id", T.LongType()),
    ]
)


def _require_positive(settings) -> None:
    for f in fields(settings):
        value = getattr(settings, f.name)
        if isinstance(value, bool) or f.type == "bool" or not isinstance(value, (int, float)):
            continue
        if not isinstance(value, int) or value < 1:
            raise ValueError(f"{f.name} must be a positive integer")


@dataclass(frozen=True)
class IngestConfig:
    """Size limits of one request and its entries, and the micro-batch rhythm.

    A batch takes the files that have arrived, up to a number of files if one is given and
    up to a number of bytes otherwise. With ``max_entries_per_flush`` a batch is stored in
    flushes of at most so many entries, whole requests in the order of their arrival.
    """

    max_logs_per_batch: int = 10_000
    max_service_length: int = 256
    max_message_length: int = 8_192
    max_attributes: int = 50
    max_attribute_key_length: int = 128
    max_attribute_value_length: int = 4_096
    flush_interval_ms: int = 50
    max_files_per_trigger: int | None = None
    max_bytes_per_trigger: int = 64 << 30
    max_entries_per_flush: int | None = None

    def __post_init__(self) -> None:
        _require_positive(self)


@dataclass(frozen=True)
class RetentionConfig:
    """How long rows live, how often a run is due and how many rows it may delete.

    Without a ``batch_size`` a run deletes everything that has expired; with one, at most
    ``batch_size * max_batches`` rows, the oldest.
    """

    enabled: bool = True
    days: int = 30
    interval_minutes: int = 15
    batch_size: int | None = None
    max_batches: int = 20

    def __post_init__(self) -> None:
        _require_positive(self)

    @property
    def max_rows(self) -> int | None:
        return None if self.batch_size is None else self.batch_size * self.max_batches
