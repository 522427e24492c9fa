import json

import pytest
from pyspark.sql import functions as F

from loamlog.functions.timestamps import format_iso
from loamlog.operators import validate
from loamlog.schema import IngestConfig
from tests.conftest import NOW, check, log, requests

TOO_FAR = format_iso(NOW + 5 * 60_000_000 + 1_000)
JUST_IN = format_iso(NOW + 5 * 60_000_000)


def test_rules_in_order(spark):
    cases = [
        (log(), None),
        (log(attributes=...), None),
        ("not an object", validate.ENTRY_NOT_AN_OBJECT),
        (None, validate.ENTRY_NOT_AN_OBJECT),
        ([1], validate.ENTRY_NOT_AN_OBJECT),
        ({}, validate.TIMESTAMP_MISSING),
        (log(timestamp=...), validate.TIMESTAMP_MISSING),
        (log(timestamp=12345), validate.TIMESTAMP_MISSING),
        (log(timestamp=None), validate.TIMESTAMP_MISSING),
        (log(timestamp="not-a-date"), validate.TIMESTAMP_INVALID),
        (log(timestamp=""), validate.TIMESTAMP_INVALID),
        (log(timestamp="2026-07-20 14:32:01"), validate.TIMESTAMP_INVALID),
        (log(timestamp="2026-13-40T99:99:99Z"), validate.TIMESTAMP_INVALID),
        (log(timestamp="2026-07-20T14:32:01Z\n"), validate.TIMESTAMP_INVALID),
        (log(timestamp="2026-07-20T14:32:01.1234Z"), validate.TIMESTAMP_INVALID),
        (log(timestamp=TOO_FAR), validate.TIMESTAMP_FUTURE),
        (log(timestamp=JUST_IN), None),
        (log(timestamp="1969-12-31T23:59:59.999Z"), None),
        (log(level=...), "invalid level: 'undefined'"),
        (log(level=None), "invalid level: 'null'"),
        (log(level="critical"), "invalid level: 'critical'"),
        (log(level="ERROR"), "invalid level: 'ERROR'"),
        (log(level=3), "invalid level: '3'"),
        (log(level=1.50), "invalid level: '1.5'"),
        (log(level=1e21), "invalid level: '1e+21'"),
        (log(level=1.5e-7), "invalid level: '1.5e-7'"),
        (log(level=True), "invalid level: 'true'"),
        (log(level={"a": 1}), "invalid level: '[object Object]'"),
        (log(level=["a", None, 2]), "invalid level: 'a,,2'"),
        (log(service=...), validate.SERVICE_EMPTY),
        (log(service=""), validate.SERVICE_EMPTY),
        (log(service=42), validate.SERVICE_EMPTY),
        (log(service="a" * 256), None),
        (log(service="a" * 257), "service must be at most 256 characters"),
        (log(service="😀" * 128), None),
        (log(service="😀" * 128 + "a"), "service must be at most 256 characters"),
        (log(service="é" * 256), None),
        (log(message=...), validate.MESSAGE_EMPTY),
        (log(message=""), validate.MESSAGE_EMPTY),
        (log(message=["x"]), validate.MESSAGE_EMPTY),
        (log(message="m" * 8192), None),
        (log(message="m" * 8193), "message must be at most 8192 characters"),
        (log(attributes=None), validate.ATTRIBUTES_NOT_FLAT),
        (log(attributes=[]), validate.ATTRIBUTES_NOT_FLAT),
        (log(attributes="x"), validate.ATTRIBUTES_NOT_FLAT),
        (log(attributes={}), None),
        (log(attributes={f"k{i}": i for i in range(50)}), None),
        (log(attributes={f"k{i}": i for i in range(51)}), "attributes must contain at most 50 keys"),
        (log(attributes={"": 1}), validate.ATTRIBUTE_KEY_EMPTY),
        (log(attributes={"k" * 128: 1}), None),
        (log(attributes={"k" * 129: 1}), "attribute keys must be at most 128 characters"),
        (log(attributes={"nested": {"a": 1}}), validate.ATTRIBUTES_NOT_FLAT),
        (log(attributes={"tags": [1, 2, 3]}), validate.ATTRIBUTES_NOT_FLAT),
        (log(attributes={"n": None}), validate.ATTRIBUTES_NOT_FLAT),
        (log(attributes={"v": "x" * 4096}), None),
        (
            log(attributes={"v": "x" * 4097}),
            "attribute string values must be at most 4096 characters",
        ),
        (log(attributes={"retries": 3, "active": True, "ratio": 0.5}), None),
        # The first failing rule wins.
        (log(level="x", service="", message=""), "invalid level: 'x'"),
        (log(service="", attributes=None), validate.SERVICE_EMPTY),
    ]
    assert check(spark, *[entry for entry, _ in cases]) == [reason for _, reason in cases]


def test_infinite_numbers_are_refused(spark):
    body = json.dumps({"logs": [log(attributes={"bad": 0})]}).replace('"bad": 0', '"bad": 1e400')
    checked = validate.check_requests(requests(spark, body), NOW)
    assert checked.first()["reason"] == validate.ATTRIBUTE_NOT_FINITE


def test_limits_are_settings(spark):
    config = IngestConfig(max_service_length=3, max_attributes=1)
    entries = [log(service="abcd"), log(service="abc"), log(service="abc", attributes={"a": 1})]
    assert check(spark, *entries, config=config) == [
        "service must be at most 3 characters",
        "attributes must contain at most 1 keys",
        None,
    ]


def test_envelopes(spark):
    bodies = [
        ("{not valid json", validate.MALFORMED),
        ('{"logs":[]} trailing', validate.MALFORMED),
        ('{"logs":[]},{"logs":[]}', validate.MALFORMED),
        ("{'logs':[]}", validate.MALFORMED),
        ('{"logs":[NaN]}', validate.MALFORMED),
        ("", validate.MALFORMED),
        ("[]", validate.NOT_AN_OBJECT),
        ("3", validate.NOT_AN_OBJECT),
        ("null", validate.NOT_AN_OBJECT),
        ("{}", validate.NO_LOGS),
        ('{"logs":"not-an-array"}', validate.NO_LOGS),
        ('{"logs":{"a":1}}', validate.NO_LOGS),
        ('{"logs":null}', validate.NO_LOGS),
        ('{"logs":[]}', validate.ALL_REJECTED),
        ({"logs": [1, 2, 3]}, "logs array must contain at most 2 entries"),
        ('{"logs":3,"logs":[1]}', validate.ENTRY_NOT_AN_OBJECT),
    ]
    frame = requests(spark, *[b for b, _ in bodies])
    checked = validate.check_requests(frame, NOW, IngestConfig(max_logs_per_batch=2))
    found = {r["request_id"]: r["reason"] for r in checked.collect()}
    assert [found[i] for i in range(len(bodies))] == [reason for _, reason in bodies]


def test_report_counts_and_orders_rejects(spark):
    frame = requests(
        spark,
        {"logs": [log(), log(level="critical"), log(service="")]},
        {"logs": [log(timestamp="not-a-date")]},
        {"logs": []},
        "[]",
        {"logs": [log()]},
    )
    report = validate.ingest_report(validate.check_requests(frame, NOW)).orderBy("request_id")
    rows = [
        (r["accepted"], [(x["index"], x["reason"]) for x in r["rejected"]], r["error"])
        for r in report.collect()
    ]
    assert rows == [
        (1, [(1, "invalid level: 'critical'"), (2, validate.SERVICE_EMPTY)], None),
        (0, [(0, validate.TIMESTAMP_INVALID)], validate.ALL_REJECTED),
        (0, [], validate.ALL_REJECTED),
        (0, [], validate.NOT_AN_OBJECT),
        (1, [], None),
    ]


def test_accepted_rows_keep_five_fields(spark):
    frame = requests(spark, {"logs": [log(id=7, extra="x"), log(attributes=...)]})
    good = validate.accepted(validate.check_requests(frame, NOW))
    assert good.columns == [
        "request_id", "index", "timestamp", "level", "service", "message", "attributes",
        "attributes_text",
    ]
    rows = good.orderBy("index").select(F.to_json("attributes").alias("a"), "attributes_text")
    first, second = rows.collect()
    assert json.loads(first["a"]) == log()["attributes"]
    assert first["attributes_text"] == {"user_id": "314", "berth": "north", "lifts": "12"}
    assert json.loads(second["a"]) == {} and second["attributes_text"] == {}


def test_duplicate_keys_take_the_last_value(spark):
    body = '{"logs":[{"timestamp":"2026-07-20T14:00:00Z","level":"x","level":"info",' \
        '"service":"s","message":"m","attributes":{"a":1,"a":"two"}}]}'
    row = validate.accepted(validate.check_requests(requests(spark, body), NOW)).first()
    assert row["level"] == "info" and row["attributes_text"] == {"a": "two"}


def test_rules_run_once(spark):
    """Filtering on the outcome must not evaluate the rule chain a second time."""
    checked = validate.check_requests(requests(spark, {"logs": [log()]}), NOW)
    plan = validate.accepted(checked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(validate.MESSAGE_EMPTY) == 1


@pytest.mark.parametrize("field", ["max_logs_per_batch", "flush_interval_ms"])
def test_settings_must_be_positive(field):
    with pytest.raises(ValueError):
        IngestConfig(**{field: 0})


@pytest.mark.parametrize("tail", ["] garbage", "],[1", ",{}", ' ,{"logs":[]}', "]", "{}"])
def test_anything_after_the_document_is_malformed(spark, tail):
    sound = json.dumps({"logs": [log()]})
    frame = requests(spark, sound + tail, sound + "  ")
    found = {r["request_id"]: r["reason"] for r in validate.check_requests(frame, NOW).collect()}
    assert found == {0: validate.MALFORMED, 1: None}


def test_days_before_the_calendar_are_refused(spark):
    first = "0001-01-01T00:00:00"
    times = ["0000-06-01T00:00:00Z", f"{first}+05:00", f"{first}Z", f"{first}-05:00"]
    refused = validate.TIMESTAMP_TOO_OLD
    assert check(spark, *[log(timestamp=t) for t in times]) == [refused, refused, None, None]


def test_lists_in_reasons(spark):
    levels = [[["a"], 1], [None, [None, [2.5, True]]], [], [[[[1, 2]]]]]
    shown = ["a,1", ",,2.5,true", "", "[1,2]"]
    assert check(spark, *[log(level=v) for v in levels]) == [f"invalid level: '{t}'" for t in shown]
