import pytest

from loamlog.functions import cursors
from loamlog.functions.cursors import Cursor
from loamlog.functions.timestamps import to_micros
from loamlog.plans.params import AggregateQuery, LogQuery
from loamlog.schema import RetentionConfig

RANGE = {"since": "2026-07-20T14:00:00Z", "until": "2026-07-20T15:00:00Z"}


def test_search_defaults():
    query = LogQuery.from_params({})
    assert (query.limit, query.attributes, query.service, query.cursor) == (100, {}, None, None)


def test_search_arguments():
    query = LogQuery.from_params(
        {**RANGE, "service": "checkout", "level": "error", "q": "declined", "limit": "50",
         "attr.user_id": "42", "attr.region": "eu-west"}
    )
    assert query.service == "checkout" and query.level == "error" and query.q == "declined"
    assert query.since == to_micros(RANGE["since"]) and query.until == to_micros(RANGE["until"])
    assert query.limit == 50 and query.attributes == {"user_id": "42", "region": "eu-west"}
    assert not query.countable and LogQuery(service="x").countable
    assert not LogQuery(q="").countable


def test_cursor_argument():
    cursor = Cursor(to_micros("2026-07-20T14:32:01.123Z"), 42)
    assert LogQuery.from_params({"cursor": cursors.encode(cursor)}).cursor == cursor


@pytest.mark.parametrize(
    "params",
    [
        {"attr.": "42"},
        {"attr.a": 42},
        {"foo": "bar"},
        {"bucket": "1m"},
        {"level": "critical"},
        {"service": 3},
        {"q": ["x"]},
        {"since": "last week"},
        {"since": 5},
        {"since": RANGE["until"], "until": RANGE["since"]},
        *[{"limit": v} for v in ("00", "1002", "-1", "2.25", "many", " ", 7, "2e3", "9e400", "0xg", "2_0", "1 2")],
        {"cursor": "~~"},
        {"cursor": 1},
    ],
)
def test_bad_search_arguments(params):
    with pytest.raises(ValueError):
        LogQuery.from_params(params)


@pytest.mark.parametrize("limit", [1, 1000])
def test_limit_bounds(limit):
    assert LogQuery.from_params({"limit": str(limit)}).limit == limit


@pytest.mark.parametrize("text, limit", [(" 7 ", 7), ("1e2", 100), ("5.0", 5), ("0x10", 16), ("+3", 3)])
def test_limit_spellings(text, limit):
    assert LogQuery.from_params({"limit": text}).limit == limit


def test_aggregate_arguments():
    query = AggregateQuery.from_params({**RANGE, "bucket": "5m", "group_by": "level"})
    assert query.bucket == "5m" and query.group_by == "level" and query.countable
    empty = AggregateQuery.from_params({**RANGE, "until": RANGE["since"], "bucket": "1d"})
    assert empty.since == empty.until


@pytest.mark.parametrize(
    "params",
    [
        {"since": RANGE["since"], "bucket": "1m"},
        {"until": RANGE["until"], "bucket": "1m"},
        {**RANGE},
        {**RANGE, "bucket": "2m"},
        {**RANGE, "bucket": "1m", "group_by": "message"},
        {**RANGE, "bucket": "1m", "limit": "5"},
        {**RANGE, "bucket": "1m", "level": "fatal"},
        {**RANGE, "bucket": "1m", "attr.": "x"},
        {"since": RANGE["until"], "until": RANGE["since"], "bucket": "1m"},
    ],
)
def test_bad_aggregate_arguments(params):
    with pytest.raises(ValueError):
        AggregateQuery.from_params(params)


def test_retention_settings():
    assert RetentionConfig(batch_size=30, max_batches=4).max_rows == 120
    assert RetentionConfig().max_rows is None
    with pytest.raises(ValueError):
        RetentionConfig(days=0)
