"""The logs and their minute counts as Parquet folders.

    logs/log_date=D/batch_id=N/       rows, one folder per UTC day and write
    rollup_1m/log_date=D/batch_id=N/  additive minute counts of the same write
    rejected/batch_id=N/              refused entries of the same write, as they were sent
    reports/batch_id=N/               what became of each request of the same write
    _state/                           one small JSON file per published change

Every change is a new numbered write that becomes visible when its state file
appears. Numbers are claimed and never used twice: one that was skipped, because its
job died or lost against another writer, is void for good. Readers take the numbers
up to the published one, so nothing half-written is ever visible.
A published version is a new file that no other writer can have created: linked into place on a
local file system, renamed on HDFS, where a rename never replaces a file, and read back. On
stores whose rename copies (object stores) run a single writer.
Deleting is metadata: a day's ``floor`` hides all of its earlier writes, and a
``cut`` hides the oldest rows of one day. Counts are corrected by adding negative
rows, never by rewriting.
"""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import asdict, dataclass, field, replace
from datetime import date, timedelta
from functools import cached_property

from pyspark import StorageLevel
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamlog.functions.variants import attributes_text
from loamlog.functions.timestamps import DAY, floor_minute, literal, split_range, to_micros
from loamlog.operators import filters, retention, search, validate
from loamlog.operators.aggregate import aggregate
from loamlog.operators.filters import HOT_PREFIX
from loamlog.operators.maintenance import backfill_attributes_text
from loamlog.operators.ordering import nth_bucket, number_by_source
from loamlog.operators.rollup import merge_rollups, minute_rollup, negated
from loamlog.plans.params import AggregateQuery, LogQuery
from loamlog.sources.batches import with_split_line
from loamlog.schema import (
    LOGS,
    PLACEMENT,
    REJECTED,
    REPORTS,
    ROLLUP,
    IngestConfig,
    RetentionConfig,
)
from loamlog.session import configure, open_writers

_EPOCH = date(1970, 1, 1)
_CLAIMS_KEPT = 1_000
_ROW_BITS = 33  # of monotonically_increasing_id
_LINEAGE_KEPT = 256
_SOURCE = ("_modified", "_file", "_start")
#: One writing job at a time per store and driver: ingestion and maintenance take turns.
_WRITING: dict[str, threading.RLock] = defaultdict(threading.RLock)


def _day(micros: int) -> date:
    return _EPOCH + timedelta(days=micros // DAY)


def _midnight(day: date) -> int:
    return (day - _EPOCH).days * DAY


def _widening(days: Sequence[date]) -> Iterator[Sequence[date]]:
    """The days in runs of 1, 2, 4 …, so at most twice as many are read as needed."""
    start, width = 0, 1
    while start < len(days):
        yield days[start : start + width]
        start, width = start + width, width * 2


def _together(jobs: Sequence[Callable[[], None]]) -> None:
    """Run independent Spark jobs side by side; the first error is raised once all ended."""
    with ThreadPoolExecutor(max_workers=max(1, len(jobs))) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()


@dataclass(frozen=True)
class Cut:
    """Rows of ``day`` written up to ``batch_id`` and not past the position are deleted."""

    day: str
    batch_id: int
    micros: int
    last_id: int | None = None

    @property
    def boundary(self) -> retention.Boundary:
        return retention.Boundary(self.micros, self.last_id)

    def includes(self, other: Cut) -> bool:
        mine = (self.micros, self.last_id or 0)
        theirs = (other.micros, other.last_id or 0)
        return self.day == other.day and self.batch_id >= other.batch_id and mine >= theirs


@dataclass(frozen=True)
class State:
    """What is visible, and where the next write continues."""

    version: int = 0
    last_batch: int = 0
    next_id: int = 1
    days: tuple[str, ...] = ()
    void: tuple[int, ...] = ()
    streams: dict[str, int] = field(default_factory=dict)
    #: First write whose files have a column for the attribute.
    hot: dict[str, int] = field(default_factory=dict)
    floors: dict[str, int] = field(default_factory=dict)
    cuts: tuple[Cut, ...] = ()
    #: Who published the latest versions, this one last.
    lineage: tuple[str, ...] = ()

    @classmethod
    def parse(cls, text: str) -> State:
        data = json.loads(text)
        data.pop("writer", None)
        data["lineage"] = tuple(data.get("lineage", ()))
        data["cuts"] = tuple(Cut(**c) for c in data["cuts"])
        data["days"], data["void"] = tuple(data["days"]), tuple(data["void"])
        return cls(**data)

    def after(self, batch_id: int, writes: int = 1, **changes) -> State:
        """The state once the write of this number, and of those next to it, is published;
        numbers passed over are void."""
        skipped = range(self.last_batch + 1, batch_id)
        last = batch_id + writes - 1
        return replace(self, last_batch=last, void=(*self.void, *skipped), **changes)


@dataclass(frozen=True)
class IngestResult:
    batch_id: int | None
    accepted: int
    rejected: int


class LogStore:
    """Tables under one root folder. ``hot_attributes`` get a column of their own with a
    bloom filter, so equality on them skips row groups instead of opening every map."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        config: IngestConfig | None = None,
        hot_attributes: Sequence[str] = (),
    ) -> None:
        self.spark = configure(spark)
        self.root = root.rstrip("/")
        self.config = config or IngestConfig()
        self.hot_attributes = tuple(hot_attributes)

    # ---- files -------------------------------------------------------------

    @cached_property
    def _fs(self):
        path = self._path("")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, relative: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{relative}")

    def _glob(self, pattern: str) -> list:
        return list(self._fs.globStatus(self._path(pattern)) or [])

    def _names(self, pattern: str) -> list[str]:
        return [found.getPath().getName() for found in self._glob(pattern)]

    def state(self) -> State:
        while True:
            versions = sorted(self._names("_state/*.json"))
            if not versions:
                return State()
            newest = self._path(f"_state/{versions[-1]}")
            try:
                return State.parse(self._read_text(newest))
            except Py4JJavaError:
                if self._fs.exists(newest):  # else newer versions replaced it meanwhile
                    raise

    def _read_text(self, path) -> str:
        read_all = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString
        source = self._fs.open(path)
        try:
            return read_all(source, "UTF-8")
        finally:
            source.close()

    def _create(self, relative: str, text: str) -> bool:
        """Make a file appear whole; False if it exists. Of several creators one wins."""
        final = self._path(relative)
        draft = self._path(f"_state/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self._fs.getUri().getScheme() == "file":
            place = final.toUri().getPath()
            os.makedirs(os.path.dirname(place), exist_ok=True)
            try:
                os.link(draft.toUri().getPath(), place)
            except FileExistsError:
                return False
            finally:
                self._fs.delete(draft, False)
        else:
            self._fs.mkdirs(final.getParent())
            if self._fs.exists(final) or not self._fs.rename(draft, final):
                self._fs.delete(draft, False)
                return False
        return self._read_text(final) == text

    def _publish(self, state: State) -> State:
        """Make a change visible, or fail because another writer published the version first.

        Old versions are deleted, so a slow writer may find its number free again. Then newer
        versions exist that do not descend from its own.
        """
        writer = uuid.uuid4().hex  # no two attempts look alike
        lineage = (*state.lineage[1 - _LINEAGE_KEPT :], writer)
        published = replace(state, version=state.version + 1, lineage=lineage)
        place = f"_state/{published.version:012d}.json"
        taken = RuntimeError(f"another writer published version {published.version}")
        if not self._create(place, json.dumps(asdict(published))):
            raise taken
        if writer not in self.state().lineage:
            self._fs.delete(self._path(place), False)
            raise taken
        for stale in self._glob("_state/*.json")[:-5]:
            self._fs.delete(stale.getPath(), False)
        return published

    def finish_epoch(self, stream: str, epoch: int) -> None:
        """All writes of a stream up to the number are done, whether or not there were so many."""
        with _WRITING[self.root]:
            state = self.state()
            if state.streams.get(stream, -1) < epoch:
                self._publish(replace(state, streams={**state.streams, stream: epoch}))

    def _claim(self, state: State, writes: int = 1) -> int:
        """Write numbers of our own, by the first of so many neighbours; the file system lets
        one creator win. Numbers in front of one that is taken are passed over."""
        batch_id = number = state.last_batch + 1
        while number < batch_id + writes:
            if not self._create(f"_state/claims/{number:012d}", uuid.uuid4().hex):
                batch_id = number + 1
            number += 1
        return batch_id

    def vacuum(self) -> int:
        """Delete folders the current state hides; returns how many.

        Run it once no reader of an older state is left.
        """
        removed, state = 0, self.state()
        for day, floor in state.floors.items():
            for table in ("logs", "rollup_1m"):
                for found in self._glob(f"{table}/log_date={day}/batch_id=*"):
                    if int(found.getPath().getName().split("=")[1]) < floor:
                        self._fs.delete(found.getPath(), True)
                        removed += 1
                if not self._glob(f"{table}/log_date={day}/batch_id=*"):
                    self._fs.delete(self._path(f"{table}/log_date={day}"), True)
        for batch_id in state.void:
            for table in ("logs/log_date=*", "rollup_1m/log_date=*", "rejected", "reports"):
                for found in self._glob(f"{table}/batch_id={batch_id}"):
                    self._fs.delete(found.getPath(), True)
                    removed += 1
        for claim in self._names("_state/claims/*"):
            if int(claim) < state.last_batch - _CLAIMS_KEPT:
                self._fs.delete(self._path(f"_state/claims/{claim}"), False)
        # Nothing is left below the floors, so they have no more to hide; nor have the void
        # numbers whose folders are gone and that no writer can still be filling.
        old = state.last_batch - _CLAIMS_KEPT
        after = replace(state, floors={}, void=tuple(n for n in state.void if n >= old))
        if after != state:
            self._publish(after)
        return removed

    # ---- reading -----------------------------------------------------------

    def _hot_keys(self, state: State) -> list[str]:
        """Attributes with a column of their own: once one has it, every later write does."""
        return [*state.hot, *(k for k in self.hot_attributes if k not in state.hot)]

    def _logs_schema(self, hot: Sequence[str]) -> T.StructType:
        columns = [T.StructField(HOT_PREFIX + k, T.StringType()) for k in hot]
        return T.StructType([*LOGS.fields, *columns, *PLACEMENT.fields])

    def dates(
        self, since: int | None = None, until: int | None = None, state: State | None = None
    ) -> list[date]:
        """Days that may hold rows of the range, newest first; known without listing files."""
        days = sorted(map(date.fromisoformat, (state or self.state()).days), reverse=True)
        return [
            d
            for d in days
            if (since is None or _midnight(d) + DAY > since)
            and (until is None or _midnight(d) < until)
        ]

    @staticmethod
    def _published(state: State) -> Column:
        shown = F.col("batch_id") <= state.last_batch
        return shown & ~F.col("batch_id").isin(*state.void) if state.void else shown

    def _visible(self, state: State) -> Column:
        """Partition predicate: published, and not below its day's floor."""
        shown = self._published(state)
        if state.floors:
            pairs = [
                F.lit(x) for day, n in state.floors.items() for x in (date.fromisoformat(day), n)
            ]
            floor = F.create_map(*pairs)[F.col("log_date")]
            shown &= F.col("batch_id") >= F.coalesce(floor, F.lit(0))
        return shown

    def _scan(
        self, table: str, schema: T.StructType, state: State, days: Sequence[date]
    ) -> DataFrame:
        """Only the folders of the given days are listed and read."""
        folders = [f"{self.root}/{table}/log_date={d.isoformat()}" for d in days]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return (
            self.spark.read.schema(schema)
            .option("basePath", f"{self.root}/{table}")
            .parquet(*folders)
            .where(self._visible(state))
        )

    def logs(
        self,
        since: int | None = None,
        until: int | None = None,
        state: State | None = None,
        days: Sequence[date] | None = None,
    ) -> DataFrame:
        """Visible rows. A range narrows the folders that are read; it does not filter rows."""
        state = state or self.state()
        days = self.dates(since, until, state) if days is None else days
        return self._rows(state, days).drop("batch_id")

    def written(self) -> DataFrame:
        """Visible rows with ``batch_id``, the write that each came with or was merged by."""
        state = self.state()
        return self._rows(state, self.dates(None, None, state))

    def _rows(self, state: State, days: Sequence[date]) -> DataFrame:
        hot = list(state.hot)
        rows = self._scan("logs", self._logs_schema(hot), state, days)
        # Files older than a column answer from the map; the filters reach both branches.
        since = max(state.hot.values(), default=0)
        lowest = min((state.floors.get(d.isoformat(), 1) for d in days), default=1)
        if hot and days and lowest < since:
            older = self._scan("logs", self._logs_schema([]), state, days)
            older = older.where(F.col("batch_id") < since).withColumns(
                {HOT_PREFIX + k: F.col("attributes_text")[F.lit(k)] for k in hot}
            )
            rows = rows.where(F.col("batch_id") >= since).unionByName(older)
        shown = {d.isoformat() for d in days}
        for cut in state.cuts:
            if cut.day in shown:
                gone = (
                    (F.col("log_date") == F.lit(date.fromisoformat(cut.day)))
                    & (F.col("batch_id") <= cut.batch_id)
                    & cut.boundary.covers(T.TimestampType())
                )
                rows = rows.where(~gone)
        return rows

    def rollup_deltas(
        self,
        since: int | None = None,
        until: int | None = None,
        state: State | None = None,
        days: Sequence[date] | None = None,
    ) -> DataFrame:
        """Additive minute counts as written; whoever reads them sums them."""
        state = state or self.state()
        days = self.dates(since, until, state) if days is None else days
        schema = T.StructType([*ROLLUP.fields, *PLACEMENT.fields])
        return self._scan("rollup_1m", schema, state, days).drop("batch_id")

    def rollup(self, since: int | None = None, until: int | None = None) -> DataFrame:
        """One row per minute, service and level."""
        return merge_rollups(self.rollup_deltas(since, until).drop("log_date"))

    def rejected(self) -> DataFrame:
        """The dead letters of all published writes."""
        return self._per_write("rejected", REJECTED)

    def reports(self) -> DataFrame:
        """Per request of all published writes: accepted count, rejects, error."""
        return self._per_write("reports", REPORTS)

    def _per_write(self, table: str, columns: T.StructType) -> DataFrame:
        schema = T.StructType([*columns.fields, T.StructField("batch_id", T.LongType())])
        if not self._names(f"{table}/batch_id=*"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        return rows.where(self._published(self.state()))

    # ---- queries -----------------------------------------------------------

    def aggregate(self, query: AggregateQuery) -> DataFrame:
        """Counts per bucket; raw rows are read only where minute counts cannot answer."""
        state = self.state()
        days = self.dates(query.since, query.until, state)
        rollup = self.rollup_deltas(state=state, days=days)
        if query.countable:
            edges = split_range(query.since, query.until).edges
            days = sorted({d for edge in edges for d in self.dates(*edge, state)}, reverse=True)
        return aggregate(self.logs(state=state, days=days), query, rollup)

    def filter(self, query: LogQuery) -> DataFrame:
        """All matching rows, distributed."""
        return search.filter_logs(self.logs(query.since, query.until), query)

    def search(self, query: LogQuery) -> search.Page:
        """One page, reading back in time only as far as the page needs.

        Days are disjoint and ordered, so the newest rows come from the newest days.
        Where minute counts cover the filters they tell exactly where the page ends;
        otherwise the look back doubles until the page is full.
        """
        state = self.state()
        until = query.until
        if query.cursor is not None:
            until = min(until or query.cursor.micros + 1, query.cursor.micros + 1)
        days = self.dates(query.since, until, state)
        if query.countable:
            start = self._page_start(query, until, days, state)
            if start is not None:
                days = [d for d in days if _midnight(d) + DAY > start]
                query = replace(query, since=max(start, query.since or start))
            rows = search.collect_newest(self.logs(state=state, days=days), query)
            return search.page_of(rows, query.limit)
        rows: list[Row] = []
        need = query.limit + 1
        for window in _widening(days):
            part = replace(query, limit=min(query.limit, need - len(rows)))
            rows += search.collect_newest(self.logs(state=state, days=window), part)
            if len(rows) >= need:
                break
        return search.page_of(rows[:need], query.limit)

    def _page_start(
        self, query: LogQuery, until: int | None, days: Sequence[date], state: State
    ) -> int | None:
        """A minute so early that it and later ones hold the whole page; None if all do."""
        need = query.limit + 1
        # Only minutes that end by the upper bound are sure to count in full.
        last = None if until is None else floor_minute(until)
        for window in _widening(days):
            deltas = self.rollup_deltas(state=state, days=window)
            counted = filters.apply(
                deltas,
                [
                    *filters.same_keys(query.service, query.level),
                    *filters.in_time(deltas, None, last, column="bucket_start"),
                ],
            )
            if len(window) > 1:
                # One row per day first; the minutes of a single day after that.
                per_day = counted.groupBy(F.col("log_date").alias("bucket"))
                day, before = nth_bucket(
                    per_day.agg(F.sum("log_count").alias("n")), need, descending=True
                )
                need -= before
                if day is None:
                    continue
                counted = counted.where(F.col("log_date") == F.lit(day))
            minutes = counted.groupBy(F.unix_micros("bucket_start").alias("bucket"))
            minute, before = nth_bucket(
                minutes.agg(F.sum("log_count").alias("n")), need, descending=True
            )
            if minute is not None:
                return minute
            need -= before
        return None

    # ---- writing -----------------------------------------------------------

    def ingest(
        self,
        requests: DataFrame,
        now: int | str,
        stream: str | None = None,
        epoch: int | None = None,
        traced: bool = False,
        writes: int = 1,
    ) -> IngestResult:
        """Validate requests (``request_id``, ``body``) and store them as one atomic write.

        Ids follow the order of arrival: by file (modification time, then name), place in the
        file and place in the request. Requests that do not come straight from files are
        written down first, in the order of their partitions, so that a lost task cannot come
        back with other rows. A streamed batch that was published before is recognised by
        ``stream``, the identity of its checkpoint, and its epoch; a replay changes nothing.
        ``traced``: the lines in ``arrival`` count from the start of the split already.
        With several ``writes`` requests have a column ``_write``, from 0: all become visible
        together, each under a number of its own; the one returned is the first.
        """
        with _WRITING[self.root]:
            return self._ingest(requests, now, stream, epoch, traced, writes)

    def _staged(self, requests: DataFrame, folder: str) -> DataFrame:
        place = F.monotonically_increasing_id()
        requests.withColumn("_place", place).write.parquet(f"{self.root}/{folder}")
        rows = self.spark.read.parquet(f"{self.root}/{folder}")
        arrival = F.struct(
            F.lit(None).cast("timestamp").alias("modified"),
            F.lit(None).cast("string").alias("file"),
            F.shiftrightunsigned("_place", _ROW_BITS).alias("start"),
            F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1).alias("line"),
        )
        return rows.withColumn("arrival", arrival).drop("_place")

    def _ingest(
        self,
        requests: DataFrame,
        now: int | str,
        stream: str | None,
        epoch: int | None,
        traced: bool,
        writes: int,
    ) -> IngestResult:
        state = self.state()
        if stream is not None and epoch is not None and state.streams.get(stream, -1) >= epoch:
            return IngestResult(None, 0, 0)
        first = self._claim(state, writes)
        staging = f"_staging/batch_id={first}"
        if "arrival" not in requests.columns:
            requests, traced = self._staged(requests, f"{staging}/requests"), False
        if not traced:
            requests = with_split_line(requests)
        number = F.lit(first) + F.col("_write") if "_write" in requests.columns else F.lit(first)
        requests = requests.withColumn("batch_id", number.cast("long")).drop("_write")
        checked = validate.check_requests(requests, to_micros(now), self.config)
        rows, sizes = self._sorted_out(checked, f"{staging}/checked", writes)
        good = rows.where(F.col("reason").isNull())
        hot = {**{k: first for k in self.hot_attributes}, **state.hot}
        source = {
            "_modified": F.coalesce(F.unix_micros("arrival.modified"), F.lit(0)),
            "_file": F.coalesce("arrival.file", F.lit("")),
            "_start": F.col("arrival.start"),
        }
        place = [F.col("arrival.line"), F.col("index")]
        logs = number_by_source(good.withColumns(source), _SOURCE, place, "id", state.next_id)
        logs = logs.select(
            *("id", "timestamp", "level", "service", "message", "attributes"),
            attributes_text("attributes").alias("attributes_text"),
            *("log_date", "batch_id"),
        )
        reports = validate.ingest_report(rows, "request_id", "arrival", "batch_id")
        jobs: list[Callable[[], None]] = [
            lambda: reports.write.mode("append").partitionBy("batch_id").parquet(f"{self.root}/reports")
        ]
        if sizes["accepted"]:
            jobs.append(lambda: self._write_logs(logs, list(hot)))
            jobs.append(lambda: self._write_rollup(minute_rollup(good, "batch_id")))
        _together(jobs)
        for found in self._glob(f"{staging}/checked/accepted=false/batch_id=*"):
            self._fs.mkdirs(self._path("rejected"))
            self._fs.rename(found.getPath(), self._path(f"rejected/{found.getPath().getName()}"))
        self._fs.delete(self._path(staging), True)
        streams = dict(state.streams)
        if stream is not None and epoch is not None:
            streams[stream] = epoch
        self._publish(
            state.after(
                first,
                writes,
                next_id=state.next_id + sizes["accepted"],
                days=tuple(sorted({*state.days, *(d.isoformat() for d in sizes["days"])})),
                streams=streams,
                hot=hot,
            )
        )
        return IngestResult(first, sizes["accepted"], sizes["rejected"])

    def _sorted_out(self, checked: DataFrame, folder: str, writes: int = 1) -> tuple[DataFrame, Row]:
        """Checked entries as files, and their numbers: parsed and checked once, read several times.

        Refused ones are written as the dead letters they become, accepted ones with their fields.
        The two files of a task are open side by side; with several writes, whose files might be
        too many for that, Spark sorts the entries by their file.
        """
        valid = F.col("reason").isNull()
        fields = ("timestamp", "level", "service", "message", "attributes")
        placed = checked.select(
            *("request_id", "index", "reason", "body", "arrival", "batch_reason", "batch_id"),
            F.when(~valid, F.to_json("entry")).alias("entry"),
            *[F.when(valid, F.col(c)).alias(c) for c in fields],
            F.when(valid, F.to_date("timestamp")).alias("log_date"),
            valid.alias("accepted"),
        )
        writer = placed.write.option("compression", "zstd").partitionBy("accepted", "batch_id")
        with open_writers(placed.sparkSession, 2) if writes == 1 else nullcontext():
            writer.parquet(f"{self.root}/{folder}")
        schema = T.StructType(
            [
                *(f for f in checked.schema if f.name not in ("entry", "body", "batch_id")),
                T.StructField("log_date", T.DateType()),
                T.StructField("accepted", T.BooleanType()),
                T.StructField("batch_id", T.LongType()),
            ]
        )
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
        sizes = rows.agg(
            F.count_if("accepted").alias("accepted"),
            F.count_if(~F.col("accepted")).alias("rejected"),
            F.collect_set("log_date").alias("days"),
        )
        return rows, sizes.first()

    def _write_logs(self, rows: DataFrame, hot_keys: Sequence[str]) -> None:
        """Files of one time span each, so that a page opens few of them, sorted so that
        service and time skip row groups inside. Ranges also split hot days."""
        placed = rows.repartitionByRange("batch_id", "log_date", "timestamp", "id")
        hot = {HOT_PREFIX + k: F.col("attributes_text")[F.lit(k)] for k in hot_keys}
        if hot:
            placed = placed.withColumns(hot)
        writer = (
            placed.sortWithinPartitions("log_date", "batch_id", "service", "timestamp", "id")
            .write.mode("append")
            .partitionBy("log_date", "batch_id")
        )
        for column in hot:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        # Filters as small as the distinct values need, instead of a fixed megabyte each.
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(f"{self.root}/logs")

    def _write_rollup(self, counts: DataFrame) -> None:
        (
            counts.hint("rebalance", F.col("batch_id"), F.col("log_date"))
            .sortWithinPartitions("log_date", "batch_id", "bucket_start", "service", "level")
            .write.mode("append")
            .partitionBy("log_date", "batch_id")
            .parquet(f"{self.root}/rollup_1m")
        )

    # ---- maintenance -------------------------------------------------------

    def retain(self, now: int | str, config: RetentionConfig | None = None) -> dict[str, int]:
        """Delete expired rows, oldest first, and take them out of the counts.

        Whole days disappear by their floor. Of the last day touched only the rows to
        delete are read, to count them per minute; no survivor is rewritten.
        """
        config = config or RetentionConfig()
        if not config.enabled:
            return {"deleted_count": 0, "rollup_rows_removed": 0}
        with _WRITING[self.root]:
            return self._retain(now, config)

    def _retain(self, now: int | str, config: RetentionConfig) -> dict[str, int]:
        nothing = {"deleted_count": 0, "rollup_rows_removed": 0}
        state = self.state()
        before = retention.cutoff(to_micros(now), config)
        boundary = self._boundary(before, config.max_rows, state)
        edge = _day(boundary.micros)
        days = self.dates(state=state)
        whole = [d for d in days if d < edge]
        partly = [d for d in days if d == edge]
        gone = retention.deleted_rows(self._not_yet_cut(state, partly), boundary)
        removed = minute_rollup(gone).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            stored = merge_rollups(self.rollup_deltas(state=state, days=partly)).drop("log_date")
            totals = retention.totals_of(stored, removed.drop("log_date")).first().asDict()
            if whole:
                dropped = merge_rollups(self.rollup_deltas(state=state, days=whole))
                days_gone = dropped.agg(
                    F.sum("log_count").alias("rows"), F.count(F.lit(1)).alias("keys")
                ).first()
                totals["deleted_count"] += days_gone["rows"] or 0
                totals["rollup_rows_removed"] += days_gone["keys"]
            if not totals["deleted_count"]:
                return nothing
            batch_id = self._claim(state)
            self._write_rollup(negated(removed).withColumn("batch_id", F.lit(batch_id)))
        finally:
            removed.unpersist()

        cut = Cut(edge.isoformat(), batch_id, boundary.micros, boundary.last_id)
        hidden = {d.isoformat() for d in whole}
        self._publish(
            state.after(
                batch_id,
                days=tuple(d for d in state.days if d not in hidden),
                floors={**state.floors, **{d: batch_id for d in hidden}},
                cuts=(
                    *(c for c in state.cuts if c.day not in hidden and not cut.includes(c)),
                    cut,
                ),
            )
        )
        return totals

    def _not_yet_cut(self, state: State, days: Sequence[date]) -> DataFrame:
        """Visible rows of the day retention stopped in, without reading past deletions again.

        In front of the last cut only writes made after it can have rows, and behind it
        the time filter skips row groups.
        """
        rows = self._rows(state, days)
        shown = {d.isoformat() for d in days}
        cuts = [c for c in state.cuts if c.day in shown]
        if len(cuts) != 1:
            return rows.drop("batch_id")
        at = literal(cuts[0].micros, T.TimestampType())
        late = (F.col("batch_id") > cuts[0].batch_id) & (F.col("timestamp") < at)
        behind = rows.where(F.col("timestamp") >= at)
        return behind.unionByName(rows.where(late)).drop("batch_id")

    def _boundary(self, before: int, max_rows: int | None, state: State) -> retention.Boundary:
        """As ``retention.find_boundary``, with days and minutes counted from the rollup."""
        if max_rows is None:
            return retention.Boundary(before)
        counts = self.rollup_deltas(until=before, state=state)
        by_day = counts.groupBy(F.col("log_date").alias("bucket")).agg(F.sum("log_count").alias("n"))
        day, skipped = nth_bucket(by_day, max_rows)
        if day is None:
            return retention.Boundary(before)
        minutes = merge_rollups(self.rollup_deltas(state=state, days=[day]).drop("log_date"))
        return retention.find_boundary(
            self.logs(state=state, days=[day]), before, max_rows - skipped, minutes
        )

    def rewrite(
        self,
        days: Sequence[date],
        transform: Callable[[DataFrame], DataFrame] | None = None,
    ) -> int:
        """Write the visible rows of some days anew: fewer, time-ordered files, merged counts.

        Day by day, each published on its own: a run that stops keeps the days it has done, and
        the table is never stored twice. ``transform`` may change columns but must keep the rows.
        """
        last = self.state().last_batch
        for day in sorted(days):
            with _WRITING[self.root]:
                last = self._rewrite_day(day, transform)
        return last

    def _rewrite_day(
        self, day: date, transform: Callable[[DataFrame], DataFrame] | None
    ) -> int:
        state = self.state()
        days = [d for d in self.dates(state=state) if d == day]
        if not days:
            return state.last_batch
        batch_id = self._claim(state)
        rows = self.logs(state=state, days=days)
        hot = {**{k: batch_id for k in self.hot_attributes}, **state.hot}
        stale = [c for c in rows.columns if c.startswith(HOT_PREFIX)]
        rows = rows.drop(*stale)
        rows = transform(rows) if transform else rows
        counts = merge_rollups(self.rollup_deltas(state=state, days=days))
        _together(
            [
                lambda: self._write_logs(rows.withColumn("batch_id", F.lit(batch_id)), list(hot)),
                lambda: self._write_rollup(counts.withColumn("batch_id", F.lit(batch_id))),
            ]
        )
        rewritten = {d.isoformat() for d in days}
        self._publish(
            state.after(
                batch_id,
                floors={**state.floors, **{d: batch_id for d in rewritten}},
                cuts=tuple(c for c in state.cuts if c.day not in rewritten),
                hot=hot,
            )
        )
        return batch_id

    def crowded_days(self, folders: int) -> list[date]:
        """Days that consist of more than so many writes, the running day included."""
        state = self.state()
        crowded = []
        for day in self.dates(state=state):
            floor = state.floors.get(day.isoformat(), 0)
            writes = self._names(f"logs/log_date={day.isoformat()}/batch_id=*")
            if sum(int(w.removeprefix("batch_id=")) >= floor for w in writes) > folders:
                crowded.append(day)
        return crowded

    def compact(self, days: Sequence[date] | None = None) -> int:
        """Merge the small files of days; by default of all that have more than one write."""
        return self.rewrite(self._unmerged_days() if days is None else days)

    def _unmerged_days(self) -> list[date]:
        cut = {c.day for c in self.state().cuts}
        return sorted({*self.crowded_days(1), *(d for d in self.dates() if d.isoformat() in cut)})

    def backfill_attributes(self, days: Sequence[date] | None = None) -> int:
        """Derive ``attributes_text`` again, for rows stored before it existed."""
        return self.rewrite(
            self.dates() if days is None else days, backfill_attributes_text
        )
