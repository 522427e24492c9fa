import base64
import json
import random
import struct
from datetime import datetime, timezone
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamlog.functions import cursors
from loamlog.functions.cursors import Cursor
from loamlog.functions.timestamps import (
    MINUTE,
    bucket_start,
    ceil_minute,
    floor_minute,
    format_iso,
    iso_timestamp,
    parse_iso,
    split_range,
    to_micros,
)
from loamlog.functions.variants import display_text, longer_than, scalar_text
from loamlog.operators.filters import escape_like

# One case per clause of the rule: date, clock, fraction, zone; what each may and may not hold.
_DAY, _CLOCK = "2031-08-09", "05:06:07"
TIMES = [
    *[f"{_DAY}T{_CLOCK}{fraction}Z" for fraction in ("", ".4", ".45", ".456")],
    *[f"{_DAY}T{_CLOCK}{zone}" for zone in ("+00:00", "-00:30", "+11:45", "-23:59", "+23:59")],
    *[f"{day}T{_CLOCK}Z" for day in ("2028-02-29", "2027-02-29", "2027-06-31", "0000-12-31", "1901-01-01")],
    f"{_DAY}T24:00:00Z",
    f"{_DAY}T24:00:00.000-01:00",
    "1968-03-04T23:59:59.001Z",
    "9999-12-31T00:00:00.000Z",
]
NOT_TIMES = [
    *[f"{day}T{_CLOCK}Z" for day in ("2031-8-09", "31-08-09", "2031-13-09", "2031-00-09", "2031-08-00", "2031-08-32")],
    *[f"{_DAY}T{clock}Z" for clock in ("5:06:07", "05:06", "05:60:07", "05:06:60", "25:00:00", "24:00:01", "24:00:00.002")],
    *[f"{_DAY}T{_CLOCK}{fraction}Z" for fraction in (".", ".4567", ",4")],
    *[f"{_DAY}T{_CLOCK}{zone}" for zone in ("", "z", "+1:00", "+01", "+24:00", "-01:60", "Z ", "Z\n")],
    f"{_DAY}t{_CLOCK}Z",
    f"{_DAY}{_CLOCK}Z",
    _DAY,
    "yesterday",
    "\uff12031-08-09T05:06:07Z",
]


def test_times_agree_on_both_sides(spark):
    frame = spark.createDataFrame([(t,) for t in TIMES + NOT_TIMES], "t string")
    rows = frame.select("t", F.unix_micros(iso_timestamp(F.col("t"))).alias("us")).collect()
    for row in rows:
        assert row["us"] == parse_iso(row["t"]), row["t"]
    assert all(parse_iso(t) is not None for t in TIMES)
    assert all(parse_iso(t) is None for t in NOT_TIMES)


def test_lenient_times():
    assert parse_iso("2027-02-29T01:02:03Z") == parse_iso("2027-03-01T01:02:03Z")
    assert parse_iso("2031-12-31T24:00:00Z") == parse_iso("2032-01-01T00:00:00Z")
    assert parse_iso("2031-08-09T05:06:07-03:30") == parse_iso("2031-08-09T08:36:07Z")


@given(st.integers(-62_135_596_800_000_000, 253_402_300_799_999_999))
def test_iso_text_round_trip(us):
    assert parse_iso(format_iso(us), micros=True) == us


@given(st.datetimes(timezones=st.just(timezone.utc)))
def test_datetimes(when):
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    assert to_micros(when) == to_micros(when.replace(tzinfo=None))
    assert floor_minute(to_micros(when)) == to_micros(when.replace(second=0, microsecond=0))
    assert (when - epoch).total_seconds() == pytest.approx(to_micros(when) / 1e6)


@given(st.integers(-10**10, 10**10), st.integers(0, 10**10))
def test_split_covers_the_range_once(since, length):
    split = split_range(since, since + length)
    parts = sorted([*split.edges, *([split.middle] if split.middle else [])])
    assert sum(b - a for a, b in parts) == length
    assert all(a < b for a, b in parts)
    assert all(left[1] == right[0] for left, right in zip(parts, parts[1:]))
    if parts:
        assert parts[0][0] == since and parts[-1][1] == since + length
    if split.middle:
        assert split.middle[0] % MINUTE == split.middle[1] % MINUTE == 0
    assert all(b - a < 2 * MINUTE for a, b in split.edges)


def test_minute_rounding():
    assert ceil_minute(MINUTE) == MINUTE and ceil_minute(MINUTE + 1) == 2 * MINUTE
    assert floor_minute(-1) == -MINUTE and ceil_minute(-1) == 0


def test_buckets_ignore_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        frame = spark.sql(
            "SELECT timestamp_micros(u) AS t FROM VALUES (-1L), (0L), (59999999L), (86399999999L) v(u)"
        )
        for bucket, width in (("1m", 60), ("5m", 300), ("1h", 3600), ("1d", 86400)):
            rows = frame.select(
                F.unix_micros("t").alias("u"),
                F.unix_micros(bucket_start(F.col("t"), bucket)).alias("b"),
            ).collect()
            for row in rows:
                assert row["b"] == row["u"] // (width * 10**6) * (width * 10**6)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_cursor_round_trip():
    for micros in (to_micros("2031-08-09T05:06:07.456Z"), 1_900_000_000_000_001, -5):
        for row_id in (1, 42, 9_007_199_254_740_993):
            token = cursors.encode(Cursor(micros, row_id))
            assert cursors.decode(token) == Cursor(micros, row_id)
            assert set(token) <= set(
                "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
            )


def _token(payload) -> str:
    text = payload if isinstance(payload, str) else json.dumps(payload)
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


_GOOD = {"timestamp": "2031-08-09T05:06:07.456Z", "id": "314"}


@pytest.mark.parametrize(
    "token",
    [
        None,
        "",
        "=%=",
        _token("{"),
        *[_token(value) for value in ([_GOOD], 314, "\"text\"", {})],
        *[_token({k: v for k, v in _GOOD.items() if k != gone}) for gone in _GOOD],
        *[_token({**_GOOD, "id": row}) for row in (314, "-314", "00", "3.14", "", str(2**64))],
        *[_token({**_GOOD, "timestamp": time}) for time in (314, "", "09.08.2031")],
    ],
)
def test_bad_cursors(token):
    assert cursors.decode(token) is None


def test_cursor_column_form(spark):
    points = [(1, 0), (7, 1_784_557_921_123_000), (9, 1_784_557_921_123_456), (2**62, -1)]
    frame = spark.createDataFrame(points, "id long, us long")
    rows = frame.select(
        "id", "us", cursors.token(F.timestamp_micros("us"), F.col("id")).alias("token")
    ).collect()
    for row in rows:
        assert row["token"] == cursors.encode(Cursor(row["us"], row["id"]))


def _texts(spark, numbers):
    frame = spark.createDataFrame([(n,) for n in numbers], "json string")
    value = F.parse_json("json")
    rows = frame.select("json", scalar_text(value).alias("text")).collect()
    return {r["json"]: r["text"] for r in rows}


def test_number_texts(spark):
    expected = {
        "3": "3",
        "3.0": "3",
        "1.10": "1.1",
        "-0.0": "0",
        "0": "0",
        "-7.25": "-7.25",
        "1e21": "1000000000000000000000",
        "1e-7": "0.0000001",
        "2e23": "200000000000000000000000",
        "1.5e3": "1500",
        "-1.5e-10": "-0.00000000015",
        "9007199254740992": "9007199254740992",
        "9007199254740993": "9007199254740992",
        "12345678901234567890": "12345678901234567000",
        "0.1234567890123456789": "0.12345678901234568",
        "true": "true",
        '"3.0"': "3.0",
        '""': "",
    }
    assert _texts(spark, expected) == expected


def test_random_number_texts(spark):
    rng = random.Random(7)
    numbers = []
    while len(numbers) < 2000:
        value = struct.unpack("d", rng.randbytes(8))[0]
        if value == value and abs(value) != float("inf"):
            numbers.append(repr(value))
    numbers += [repr(rng.uniform(-1e6, 1e6)) for _ in range(1000)]
    for json_text, text in _texts(spark, numbers).items():
        assert text == format(Decimal(json_text), "f").removesuffix(".0"), json_text


def test_lengths_count_utf16_units(spark):
    texts = ["", "abc", "é" * 3, "😀", "a😀", "😀😀", "日本語", "日本語x"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in frame.select("t", longer_than(F.col("t"), 3).alias("long")).collect():
        assert row["long"] == (len(row["t"].encode("utf-16-be")) // 2 > 3), row["t"]


def test_like_escape():
    assert escape_like("100%") == r"100\%"
    assert escape_like("a_b") == r"a\_b"
    assert escape_like("a\\b") == r"a\\b"
    assert escape_like("plain") == "plain"


def test_integers_of_a_list_show_as_their_doubles(spark):
    texts = ["0", "-0", "7", "-12", "9007199254740992", "-9007199254740993", "1e21", "0.5"]
    shown = ["0", "0", "7", "-12", "9007199254740992", "-9007199254740992", "1e+21", "0.5"]
    row = spark.sql("SELECT parse_json('[" + ", ".join(texts) + "]') AS v").select(display_text(F.col("v")))
    assert row.first()[0] == ",".join(shown)
