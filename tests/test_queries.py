"""Search and counts on small stores, as a client sees them."""

import random

import pytest
from pyspark.sql import functions as F

from loamlog.functions.timestamps import MINUTE, to_micros
from loamlog.operators import filters, search
from loamlog.operators.aggregate import aggregate, aggregate_raw, export_buckets
from loamlog.operators.rollup import merge_rollups, minute_rollup
from loamlog.operators.search import paginate
from loamlog.plans import registry
from loamlog.plans.params import AggregateQuery, LogQuery
from tests.conftest import BASE, at, explained, log, stored


def _log(seconds, message="m", level="info", service="svc", **attributes):
    return log(
        timestamp=at(seconds), level=level, service=service, message=message, attributes=attributes
    )


def _messages(store, **arguments):
    return [entry["message"] for entry in store.search(LogQuery.from_params(arguments)).logs]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return stored(
        spark,
        tmp_path_factory.mktemp("queries"),
        _log(0, "Payment DECLINED for user", "error", "checkout", user_id="42", region="eu-west"),
        _log(1, "payment approved", "info", "checkout", user_id="43"),
        _log(2, "login", "error", "auth", retries=3, active=True),
        _log(60, "disk at 100% capacity", "warn", "disk"),
        _log(61, "disk at 50 capacity", "warn", "disk", **{"a.b": "x", 'quo"te': 1.5}),
        _log(62, "snake_case and back\\slash", "debug", "disk"),
        _log(120, "at-end", "info", "svc"),
        _log(300, "first-inserted", "info", "ties"),
        _log(300, "second-inserted", "info", "ties"),
        _log(-86400, "yesterday", "info", "old"),
        hot_attributes=("user_id",),
    )


def test_empty_store(spark, tmp_path):
    empty = stored(spark, tmp_path)
    assert empty.search(LogQuery()) == search.Page([], None)
    query = AggregateQuery(since=at(0), until=at(60), bucket="1m")
    assert empty.aggregate(query).collect() == []
    assert empty.retain(at(0)) == {"deleted_count": 0, "rollup_rows_removed": 0}
    assert empty.rejected().count() == 0


def test_service_and_level(store):
    assert _messages(store, service="checkout", level="error") == ["Payment DECLINED for user"]
    assert _messages(store, service="Checkout") == []
    assert _messages(store, service="") == []


def test_since_is_inclusive_and_until_exclusive(store):
    found = _messages(store, since=at(60), until=at(120))
    assert found == ["snake_case and back\\slash", "disk at 50 capacity", "disk at 100% capacity"]
    assert _messages(store, since=at(60), until=at(60)) == []


@pytest.mark.parametrize(
    "q, count",
    [("declined", 1), ("100%", 1), ("%", 1), ("_", 1), ("\\", 1), ("DISK", 2),
     ("'; DROP TABLE logs; --", 0), ("", 10)],
)
def test_substring(store, q, count):
    assert len(_messages(store, q=q)) == count


def test_attributes(store):
    assert _messages(store, **{"attr.user_id": "42"}) == ["Payment DECLINED for user"]
    assert _messages(store, **{"attr.user_id": "42", "attr.region": "us"}) == []
    assert _messages(store, **{"attr.retries": "3", "attr.active": "true"}) == ["login"]
    assert _messages(store, **{"attr.a.b": "x", 'attr.quo"te': "1.5"}) == ["disk at 50 capacity"]
    assert _messages(store, **{"attr.missing": ""}) == []


def test_ties_go_to_the_later_row(store):
    assert _messages(store, service="ties") == ["second-inserted", "first-inserted"]


def test_result_form(store):
    page = store.search(LogQuery(service="auth"))
    assert page.next_cursor is None
    assert page.logs == [
        {
            "id": "3",
            "timestamp": "2026-07-20T14:00:02.000Z",
            "level": "error",
            "service": "auth",
            "message": "login",
            "attributes": {"retries": 3, "active": True},
        }
    ]


@pytest.mark.parametrize("arguments", [{}, {"q": ""}, {"level": "info"}, {"until": at(90)}])
def test_paging_neither_repeats_nor_skips(store, arguments):
    whole = [e["id"] for e in store.search(LogQuery(**arguments)).logs]
    walked, cursor = [], None
    while True:
        page = store.search(LogQuery(**arguments, limit=2, cursor=cursor))
        walked += [e["id"] for e in page.logs]
        cursor = page.next_cursor
        if cursor is None:
            break
    assert walked == whole and len(set(walked)) == len(walked)

    rows = paginate(store.logs(), LogQuery(**arguments, limit=2)).orderBy("page", "position")
    pages = rows.collect()
    assert [str(r["id"]) for r in pages] == whole
    tokens = [r["next_cursor"] for r in pages if r["next_cursor"]]
    first = store.search(LogQuery(**arguments, limit=2))
    assert tokens[:1] == ([first.next_cursor] if first.next_cursor else [])


def test_paging_inside_one_millisecond(spark):
    rows = [(i, 1_784_556_000_123_000 + i % 3) for i in range(1, 10)]
    logs = spark.createDataFrame(rows, "id long, us long").select(
        "id",
        F.timestamp_micros("us").alias("timestamp"),
        F.lit("info").alias("level"),
        F.lit("s").alias("service"),
        F.lit("m").alias("message"),
    )
    expected = [str(i) for i, _ in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)]
    walked, cursor = [], None
    while True:
        page = search.search(logs, LogQuery(limit=2, cursor=cursor))
        walked += [e["id"] for e in page.logs]
        cursor = page.next_cursor
        if cursor is None:
            break
    assert walked == expected


def _buckets(store, **arguments):
    counts = store.aggregate(AggregateQuery(**arguments))
    return [tuple(r) for r in export_buckets(counts).collect()]


def test_buckets(store):
    assert _buckets(store, since=at(0), until=at(180), bucket="1m") == [
        ("2026-07-20T14:00:00.000Z", None, 3),
        ("2026-07-20T14:01:00.000Z", None, 3),
        ("2026-07-20T14:02:00.000Z", None, 1),
    ]
    assert _buckets(store, since=at(0), until=at(60), bucket="1m", group_by="service") == [
        ("2026-07-20T14:00:00.000Z", "auth", 1),
        ("2026-07-20T14:00:00.000Z", "checkout", 2),
    ]
    assert _buckets(
        store, since=at(-90_000), until=at(600), bucket="1d", group_by="level", service="disk"
    ) == [
        ("2026-07-20T00:00:00.000Z", "debug", 1),
        ("2026-07-20T00:00:00.000Z", "warn", 2),
    ]


def test_filtered_buckets(store):
    found = _buckets(
        store, since=at(0), until=at(60), bucket="1m", service="checkout", level="error",
        q="declined", attributes={"region": "eu-west"},
    )
    assert found == [("2026-07-20T14:00:00.000Z", None, 1)]
    assert _buckets(store, since=at(0), until=at(60), bucket="1m", q="")[0][2] == 3


def test_rollup_path_equals_raw_path(spark):
    """Random unaligned ranges, down to less than a minute."""
    rng = random.Random(11)
    rows = [
        (i, BASE + rng.randrange(0, 3 * 60 * MINUTE), rng.choice("abc"), rng.choice(["info", "warn"]))
        for i in range(4_000)
    ]
    logs = (
        spark.createDataFrame(rows, "id long, us long, service string, level string")
        .withColumn("timestamp", F.timestamp_micros("us"))
        .cache()
    )
    halves = [minute_rollup(logs.where(F.col("id") % 2 == k)) for k in (0, 1)]
    rollup = halves[0].unionByName(halves[1]).cache()
    assert merge_rollups(rollup).agg(F.sum("log_count")).first()[0] == 4_000
    for _ in range(12):
        since = BASE + rng.randrange(0, 2 * 60 * MINUTE)
        width = rng.choice([0, 1, MINUTE // 2, MINUTE, 5 * MINUTE + 1, 90 * MINUTE])
        query = AggregateQuery(
            since=since,
            until=since + width,
            bucket=rng.choice(["1m", "5m", "1h", "1d"]),
            group_by=rng.choice([None, "service", "level"]),
            service=rng.choice([None, "a"]),
            level=rng.choice([None, "warn"]),
        )
        assert aggregate(logs, query, rollup).collect() == aggregate_raw(logs, query).collect()


def test_filters_reach_the_scan(store):
    query = LogQuery(
        service="checkout", level="error", since=at(0), until=at(600), attributes={"user_id": "42"}
    )
    plan = explained(search.filter_logs(store.logs(), query))
    for pushed in (
        "EqualTo(service,checkout)",
        "EqualTo(level,error)",
        "EqualTo(attr__user_id,42)",
        "GreaterThanOrEqual(timestamp,",
        "LessThan(timestamp,",
    ):
        assert pushed in plan
    partitions = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "log_date" in partitions and "batch_id" in partitions
    assert "TakeOrderedAndProject" in explained(search.newest(store.logs(), LogQuery()))


def test_cursor_reaches_the_scan(store):
    token = store.search(LogQuery(limit=1)).next_cursor
    found = store.logs().where(
        filters.all_of(filters.after_cursor(store.logs(), LogQuery(cursor=token).cursor))
    )
    plan = explained(found)
    assert "LessThanOrEqual(timestamp," in plan


def test_counts_of_empty_range(store):
    empty = store.aggregate(AggregateQuery(since=at(0), until=at(0), bucket="1m"))
    assert empty.columns == ["start", "group", "count"] and empty.collect() == []
    assert to_micros(at(0)) == BASE


def test_dropped_parts_are_shared_out_and_arrive_in_order(spark, tmp_path):
    requests = spark.range(3000).selectExpr("id AS request_id", "CAST(id AS string) AS body")
    turn = requests["request_id"] % 10
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        registry._dropped(requests, str(tmp_path / "in"), turn == 3, turn > 3, turn < 3)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "in").glob("part-*"), key=lambda f: (f.stat().st_mtime_ns, f.name))
    assert len(files) > 3
    found = [int(line) for f in files for line in f.read_text().split()]
    assert found == sorted(range(3000), key=lambda i: (0 if i % 10 == 3 else 1 if i % 10 > 3 else 2, i))
