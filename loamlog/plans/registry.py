"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamlog.functions.cursors import Cursor
from loamlog.functions.timestamps import to_micros
from loamlog.operators import filters, retention, search, validate
from loamlog.operators.aggregate import (
    aggregate,
    aggregate_edges,
    aggregate_middle,
    aggregate_raw,
    export_buckets,
)
from loamlog.operators.maintenance import backfill_attributes_text
from loamlog.operators.ordering import assign_ids
from loamlog.operators.rollup import merge_rollups, minute_rollup
from loamlog.operators.stats import latency_summary
from loamlog.plans.params import AggregateQuery, LogQuery
from loamlog.schema import BUCKETS, IngestConfig, RetentionConfig
from loamlog.session import configure, scratch_path
from loamlog.sources.batches import read_requests, rows_from_arrays
from loamlog.sources.events import (
    EVENTS,
    clean_requests,
    dealt,
    logs_from_events,
    logs_of,
    mixed_requests,
    read_table,
)
from loamlog.sources.store import LogStore
from loamlog.streaming.ingest import ingest_stream, rollup_stream

Query = Callable[[SparkSession, str], DataFrame]

# The instants and settings the queries run with; oracles.py states the same ones.
SINCE, UNTIL = "2024-01-05T03:17:42.250Z", "2024-01-20T21:44:13.875Z"
CURSOR = Cursor(to_micros("2024-01-15T12:00:00Z"), 5_000)
NOW = "2024-02-10T06:30:15Z"
INGEST_NOW = "2024-03-01T00:00:00Z"
ALL_EXPIRED = RetentionConfig(batch_size=None)
CAPPED = RetentionConfig(batch_size=70, max_batches=3)

_QUERIES: dict[str, Query] = {}


def _query(name: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(configure(spark), sf_dir)

        _QUERIES[name or run.__name__] = configured
        return run

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# ---- search ----------------------------------------------------------------


@_query()
def search_newest(spark, sf_dir):
    return search.result_columns(search.newest(logs_from_events(spark, sf_dir), LogQuery()))


@_query()
def search_export(spark, sf_dir):
    return search.export_rows(logs_from_events(spark, sf_dir))


def _filtered(spark: SparkSession, sf_dir: str, **arguments) -> DataFrame:
    found = search.filter_logs(logs_from_events(spark, sf_dir), LogQuery(**arguments))
    return search.result_columns(found)


@_query()
def filter_none(spark, sf_dir):
    return _filtered(spark, sf_dir)


@_query()
def filter_service_level(spark, sf_dir):
    return _filtered(spark, sf_dir, service="checkout", level="error")


@_query()
def filter_time_range(spark, sf_dir):
    return _filtered(spark, sf_dir, since=SINCE, until=UNTIL)


@_query()
def filter_message_substring(spark, sf_dir):
    documents = read_table(spark, sf_dir, "documents")
    return documents.where(filters.message_contains("LICENSE", "text")).select(
        "doc_id", "lang", "n_chars"
    )


@_query()
def filter_literal_wildcards(spark, sf_dir):
    return _filtered(spark, sf_dir, q="100% Quota")


@_query()
def filter_escaped_pattern(spark, sf_dir):
    pattern = f"%{filters.escape_like('_5')}%"
    logs = logs_from_events(spark, sf_dir)
    return search.result_columns(logs.where(F.ilike("message", F.lit(pattern), F.lit("\\"))))


@_query()
def filter_attributes(spark, sf_dir):
    return _filtered(spark, sf_dir, attributes={"k": "69", "active": "true"})


@_query()
def search_after_cursor(spark, sf_dir):
    logs = logs_from_events(spark, sf_dir)
    return search.result_columns(search.newest(logs, LogQuery(cursor=CURSOR, limit=250)))


@_query()
def search_all_filters(spark, sf_dir):
    return _filtered(
        spark,
        sf_dir,
        service="auth",
        level="info",
        since=SINCE,
        until=UNTIL,
        q="USER_1",
        attributes={"active": "false"},
        cursor=CURSOR,
    )


@_query()
def page_walk(spark, sf_dir):
    pages = search.paginate(
        logs_from_events(spark, sf_dir), LogQuery(service="checkout", limit=100)
    )
    return pages.select("id", "page", "position", "next_cursor")


# ---- counts ----------------------------------------------------------------


@_query("minute_rollup")
def _minute_rollup(spark, sf_dir):
    return minute_rollup(logs_from_events(spark, sf_dir))


@_query()
def rollup_merge_batches(spark, sf_dir):
    logs = logs_from_events(spark, sf_dir)
    active = filters.attribute_is(logs, "active", "true")
    return merge_rollups(minute_rollup(logs.where(active)), minute_rollup(logs.where(~active)))


def _range(**arguments) -> AggregateQuery:
    return AggregateQuery(**{"since": SINCE, "until": UNTIL, "bucket": "1h", **arguments})


def _raw(bucket: str, group_by: str | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return aggregate_raw(
            logs_from_events(spark, sf_dir), _range(bucket=bucket, group_by=group_by)
        )

    return run


for _group_by in (None, "service", "level"):
    for _bucket in BUCKETS:
        _query(f"agg_raw_{_group_by or 'none'}_{_bucket}")(_raw(_bucket, _group_by))


def _whole_range(logs: DataFrame, **arguments) -> AggregateQuery:
    """From the first to just past the last row, so both ends lie within a minute."""
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    ends = logs.agg(F.min(micros).alias("first"), F.max(micros).alias("last")).first()
    return _range(since=ends["first"], until=ends["last"] + 1, **arguments)


@_query()
def agg_raw_edges(spark, sf_dir):
    logs = logs_from_events(spark, sf_dir)
    return aggregate_edges(logs, _whole_range(logs, group_by="service"))


@_query()
def agg_rollup_whole_range(spark, sf_dir):
    logs = logs_from_events(spark, sf_dir)
    return aggregate(logs, _whole_range(logs, bucket="1d", group_by="level"), minute_rollup(logs))


@_query()
def agg_rollup_middle(spark, sf_dir):
    rollup = minute_rollup(logs_from_events(spark, sf_dir))
    return aggregate_middle(rollup, _range(bucket="5m", group_by="level"))


@_query()
def agg_rollup_routed(spark, sf_dir):
    logs = logs_from_events(spark, sf_dir)
    return aggregate(logs, _range(group_by="service"), minute_rollup(logs))


@_query()
def agg_rollup_service_level(spark, sf_dir):
    logs = logs_from_events(spark, sf_dir)
    query = _range(bucket="1d", group_by="level", service="payments", level="info")
    return aggregate(logs, query, minute_rollup(logs))


@_query()
def agg_filtered(spark, sf_dir):
    logs = logs_from_events(spark, sf_dir)
    query = _range(bucket="1d", group_by="level", q="by user_", attributes={"active": "true"})
    return aggregate(logs, query, minute_rollup(logs))


@_query()
def agg_empty_range(spark, sf_dir):
    logs = logs_from_events(spark, sf_dir)
    return aggregate(logs, _range(until=SINCE), minute_rollup(logs))


@_query()
def agg_export(spark, sf_dir):
    logs = logs_from_events(spark, sf_dir)
    return export_buckets(aggregate(logs, _range(), minute_rollup(logs)))


# ---- ingest ----------------------------------------------------------------


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = mixed_requests(dealt(read_table(spark, sf_dir, "events")))
    return validate.check_requests(requests, to_micros(INGEST_NOW))


@_query()
def ingest_validate(spark, sf_dir):
    valid = F.col("reason").isNull()
    return _checked(spark, sf_dir).select(
        "request_id",
        "index",
        "reason",
        F.when(valid, F.col("timestamp").cast("timestamp_ntz")).alias("log_ts"),
        *[F.when(valid, F.col(c)).alias(c) for c in ("level", "service", "message")],
    )


@_query()
def ingest_report(spark, sf_dir):
    report = validate.ingest_report(_checked(spark, sf_dir))
    rejected = F.transform("rejected", lambda r: F.concat_ws(":", r["index"], r["reason"]))
    return report.select(
        "request_id", "accepted", F.array_join(rejected, "|").alias("rejected"), "error"
    )


@_query()
def dead_letters(spark, sf_dir):
    """Every refused entry with what it said, read back from its JSON."""
    fields = ("message", "level", "service")
    said = F.json_tuple("entry", *fields).alias("_message", "its_level", "its_service")  # one look at the entry
    has_body = F.col("body").isNotNull().alias("has_body")
    letters = validate.rejected(_checked(spark, sf_dir)).select("request_id", "index", "reason", has_body, said)
    return letters.select(
        "request_id",
        "index",
        "reason",
        F.length("_message").cast("int").alias("message_length"),
        "its_level",
        "its_service",
        "has_body",
    )


def _text_rows(logs: DataFrame) -> DataFrame:
    return logs.select("request_id", F.explode("attributes_text").alias("key", "value"))


@_query()
def attributes_text(spark, sf_dir):
    return _text_rows(validate.accepted(_checked(spark, sf_dir)))


@_query()
def backfill_attributes(spark, sf_dir):
    stored = validate.accepted(_checked(spark, sf_dir)).drop("attributes_text")
    return _text_rows(backfill_attributes_text(stored))


@_query("rows_from_arrays")
def _rows_from_arrays(spark, sf_dir):
    logs = logs_from_events(spark, sf_dir)
    arrays = logs.select(
        "id",
        F.array("level", F.upper("level")).alias("word"),
        F.array(F.length("service"), F.length("message")).alias("size"),
    )
    return rows_from_arrays(arrays, "word", "size")


@_query("assign_ids")
def _assign_ids(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("ts", "event_id")
    return assign_ids(events, [F.col("ts").asc(), F.col("event_id").asc()])


# ---- retention -------------------------------------------------------------


def _retained(spark: SparkSession, sf_dir: str, config: RetentionConfig) -> retention.Retained:
    logs = logs_from_events(spark, sf_dir)
    return retention.retain(logs, minute_rollup(logs), to_micros(NOW), config)


for _suffix, _config in (("", ALL_EXPIRED), ("_capped", CAPPED)):

    @_query(f"retention_delete{_suffix}")
    def _retention_delete(spark, sf_dir, config=_config):
        return search.result_columns(_retained(spark, sf_dir, config).survivors)

    @_query(f"retention_rollup{_suffix}")
    def _retention_rollup(spark, sf_dir, config=_config):
        return _retained(spark, sf_dir, config).rollup

    @_query(f"retention_totals{_suffix}")
    def _retention_totals(spark, sf_dir, config=_config):
        return _retained(spark, sf_dir, config).totals


# ---- statistics ------------------------------------------------------------


@_query("latency_summary")
def _latency_summary(spark, sf_dir):
    return latency_summary(read_table(spark, sf_dir, "events"), "value", "event_type")


# ---- streams and the stored tables -----------------------------------------


@_query()
def stream_rollup(spark, sf_dir):
    events = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events*.parquet")
    target = scratch_path(spark, "stream-rollup")
    rollup_stream(logs_of(events), target, f"{target}-progress").awaitTermination()
    return merge_rollups(spark.read.parquet(target).drop("epoch"))


def event_store(spark: SparkSession, sf_dir: str) -> LogStore:
    """All events ingested as requests into a new store, in two writes."""
    store = LogStore(spark, scratch_path(spark, "store"), hot_attributes=("user_id",))
    events = read_table(spark, sf_dir, "events")
    for part in (F.col("value") > 20, ~(F.col("value") > 20)):
        store.ingest(clean_requests(dealt(events.where(part), "event_id")), INGEST_NOW)
    return store


def _plain(logs: DataFrame, *more: str) -> DataFrame:
    """Comparable columns of stored rows; ids follow arrival."""
    return logs.select(
        *more,
        F.col("timestamp").cast("timestamp_ntz").alias("log_ts"), "level", "service", "message"
    )


@_query()
def store_logs(spark, sf_dir):
    return _plain(event_store(spark, sf_dir).logs())


@_query()
def store_search(spark, sf_dir):
    """The newest errors, as the page a client gets."""
    page = event_store(spark, sf_dir).search(LogQuery(level="error", limit=200))
    rows = [(log["timestamp"], log["service"], log["message"]) for log in page.logs]
    return spark.createDataFrame(rows, "timestamp string, service string, message string")


@_query()
def store_filter(spark, sf_dir):
    store = event_store(spark, sf_dir)
    query = LogQuery(since=SINCE, until=UNTIL, attributes={"user_id": "42", "active": "false"})
    return _plain(store.filter(query))


@_query()
def store_aggregate(spark, sf_dir):
    counts = event_store(spark, sf_dir).aggregate(_range(group_by="service"))
    return counts.withColumn("start", F.col("start").cast("timestamp_ntz"))


def _stored_rollup(store: LogStore) -> DataFrame:
    return store.rollup().withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


@_query()
def store_retention_logs(spark, sf_dir):
    store = event_store(spark, sf_dir)
    store.retain(NOW, ALL_EXPIRED)
    return _plain(store.logs())


@_query()
def store_retention_rollup(spark, sf_dir):
    store = event_store(spark, sf_dir)
    store.retain(NOW, ALL_EXPIRED)
    return _stored_rollup(store)


@_query()
def store_compaction(spark, sf_dir):
    store = event_store(spark, sf_dir)
    store.retain(NOW, ALL_EXPIRED)
    store.compact()
    store.vacuum()
    return _plain(store.logs())


@_query()
def store_filter_late_hot(spark, sf_dir):
    """The same attribute over files from before and after it got a column."""
    store = LogStore(spark, scratch_path(spark, "store"))
    events = read_table(spark, sf_dir, "events")
    early = F.col("event_id") % 2 == 0
    store.ingest(clean_requests(dealt(events.where(early), "event_id")), INGEST_NOW)
    store = LogStore(spark, store.root, hot_attributes=("user_id",))
    store.ingest(clean_requests(dealt(events.where(~early), "event_id")), INGEST_NOW)
    late = LogStore(spark, store.root)
    return _plain(late.filter(LogQuery(attributes={"user_id": "42"})))


#: Entries that a flush of the row-limited stream holds at most.
FLUSH = 5_000


def _dropped(requests: DataFrame, folder: str, *parts: Column) -> None:
    """Request lines as files per part, by ranges of the id; the parts one after the other.

    Arrival goes by modification time, then name: the files of a part, which tasks end in any
    order, get one time, a second after the part before, and their names ascend with the ids.
    """
    spark = requests.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    known, time = set(), 0
    for part in parts:
        lines = requests.where(part).repartitionByRange("request_id").sortWithinPartitions("request_id")
        lines.select("body").write.mode("append").text(folder)
        found = [f for f in files.listStatus(path) if f.getPath().getName().startswith("part-")]
        found = {f.getPath().getName(): f for f in found if f.getPath().getName() not in known}
        time = time + 1000 if time else max((f.getModificationTime() for f in found.values()), default=0)
        for f in found.values():
            files.setTimes(f.getPath(), time, -1)
        known |= found.keys()


@_query()
def store_ids(spark, sf_dir):
    """Ids of stored rows: a small file that came first, then a large one and a middling one."""
    folder = scratch_path(spark, "requests")
    requests = clean_requests(read_table(spark, sf_dir, "events"))
    turn = F.col("request_id") % 10
    _dropped(requests, folder, turn == 3, turn > 3, turn < 3)
    store = LogStore(spark, f"{folder}-store")
    store.ingest(read_requests(spark, folder), INGEST_NOW)
    return _plain(store.logs(), "id")


def _streamed(spark: SparkSession, folder: str, store: LogStore, progress: str, **options) -> None:
    now = to_micros(INGEST_NOW)
    ingest_stream(store, folder, progress, drain=True, clock=lambda: now, **options).awaitTermination()


@_query()
def stream_two_inboxes(spark, sf_dir):
    """Two streams with their own inboxes and checkpoints; one inbox has files of all ages."""
    folder = scratch_path(spark, "requests")
    requests = clean_requests(read_table(spark, sf_dir, "events"))
    old = F.col("request_id") % 3
    _dropped(requests, f"{folder}-a", old == 0, old == 1)
    _dropped(requests, f"{folder}-b", old == 2)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}-a")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    texts = [f for f in files.listStatus(path) if f.getPath().getName().startswith("part-")]
    files.setTimes(texts[0].getPath(), texts[0].getModificationTime() - 90 * 86_400_000, -1)
    store = LogStore(spark, f"{folder}-store")
    for inbox in ("a", "b"):
        _streamed(spark, f"{folder}-{inbox}", store, f"{folder}-progress-{inbox}")
    return _plain(store.logs())


@_query()
def stream_row_limit(spark, sf_dir):
    """A stream stored in flushes of at most FLUSH entries, in the order of arrival."""
    folder = scratch_path(spark, "requests")
    requests = clean_requests(read_table(spark, sf_dir, "events"))
    turn = F.col("request_id") % 10
    _dropped(requests, folder, turn == 3, turn > 3, turn < 3)
    store = LogStore(spark, f"{folder}-store", IngestConfig(max_entries_per_flush=FLUSH))
    # Merged days would no longer tell their flushes.
    _streamed(spark, folder, store, f"{folder}-progress", compact_above=None)
    fits = F.count("*").over(Window.partitionBy("batch_id")) <= FLUSH
    return _plain(store.written().withColumn("fits", fits), "id", "fits")


@_query()
def stream_report(spark, sf_dir):
    """What the stream told about each request."""
    folder = scratch_path(spark, "requests")
    mixed_requests(dealt(read_table(spark, sf_dir, "events"))).select("body").write.text(folder, compression="gzip")
    store = LogStore(spark, f"{folder}-store")
    _streamed(spark, folder, store, f"{folder}-progress")
    rejected = F.transform("rejected", lambda r: F.concat_ws(":", r["index"], r["reason"]))
    return store.reports().select("accepted", F.array_join(rejected, "|").alias("rejected"), "error")


@_query()
def stream_ingest(spark, sf_dir):
    folder = scratch_path(spark, "requests")
    mixed_requests(dealt(read_table(spark, sf_dir, "events"))).select("body").write.text(folder, compression="gzip")
    store = LogStore(spark, f"{folder}-store")
    _streamed(spark, folder, store, f"{folder}-progress")
    return _stored_rollup(store)
