"""Random entries against the rules written down a second time, in plain Python."""

import math
import random

from loamlog.functions.timestamps import format_iso, parse_iso
from loamlog.operators import validate
from loamlog.schema import LEVELS, IngestConfig
from tests.conftest import NOW, check

CONFIG = IngestConfig(
    max_service_length=6,
    max_message_length=8,
    max_attributes=3,
    max_attribute_key_length=4,
    max_attribute_value_length=5,
)
TEXTS = ["", "a", "abcdef", "abcdefg", "é😀x", "😀😀😀😀", "日本語日本語日", '"quo\\te\n', "x" * 9]
ODD = [None, 0, -1.5, True, [], ["a", 1], {}, {"a": 1}, "", "text", 1e300]
TIMES = [
    format_iso(NOW),
    format_iso(NOW + 300_000_000),
    format_iso(NOW + 300_001_000),
    "2026-02-30T10:00:00Z",
    "2026-07-20T14:32:01+02:00",
    "2026-07-20T14:32:01",
    "2026-07-20T14:32:01.12345Z",
    "yesterday",
]


def _units(text):
    return len(text.encode("utf-16-be")) // 2


def _display(value):
    if value is ...:
        return "undefined"
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return "1e+300" if value == 1e300 else f"{value:g}"
    if isinstance(value, list):
        return ",".join("" if v is None else _display(v) for v in value)
    return value if isinstance(value, str) else "[object Object]"


def _attributes_fault(attributes):
    if not isinstance(attributes, dict):
        return validate.ATTRIBUTES_NOT_FLAT
    if len(attributes) > CONFIG.max_attributes:
        return f"attributes must contain at most {CONFIG.max_attributes} keys"
    # Stored objects keep their keys sorted.
    for key, value in sorted(attributes.items(), key=lambda item: item[0].encode()):
        if key == "":
            return validate.ATTRIBUTE_KEY_EMPTY
        if _units(key) > CONFIG.max_attribute_key_length:
            return f"attribute keys must be at most {CONFIG.max_attribute_key_length} characters"
        if not isinstance(value, (str, int, float, bool)):
            return validate.ATTRIBUTES_NOT_FLAT
        if isinstance(value, float) and not math.isfinite(value):
            return validate.ATTRIBUTE_NOT_FINITE
        if isinstance(value, str) and _units(value) > CONFIG.max_attribute_value_length:
            limit = CONFIG.max_attribute_value_length
            return f"attribute string values must be at most {limit} characters"
    return None


def _expected(entry):
    if not isinstance(entry, dict):
        return validate.ENTRY_NOT_AN_OBJECT
    when = entry.get("timestamp")
    if not isinstance(when, str):
        return validate.TIMESTAMP_MISSING
    if parse_iso(when) is None:
        return validate.TIMESTAMP_INVALID
    if parse_iso(when) > NOW + 300_000_000:
        return validate.TIMESTAMP_FUTURE
    level = entry.get("level", ...)
    if not isinstance(level, str) or level not in LEVELS:
        return f"invalid level: '{_display(level)}'"
    for field, limit, empty in (
        ("service", CONFIG.max_service_length, validate.SERVICE_EMPTY),
        ("message", CONFIG.max_message_length, validate.MESSAGE_EMPTY),
    ):
        value = entry.get(field)
        if not isinstance(value, str) or value == "":
            return empty
        if _units(value) > limit:
            return f"{field} must be at most {limit} characters"
    return _attributes_fault(entry.get("attributes", {}))


def _entry(rng):
    if rng.random() < 0.05:
        return rng.choice([v for v in ODD if not isinstance(v, dict)])
    entry = {
        "timestamp": rng.choice(TIMES[:2] * 6 + TIMES),
        "level": rng.choice(LEVELS * 5 + ("ERROR", "fatal", "")),
        "service": rng.choice(["a", "svc"] * 8 + TEXTS),
        "message": rng.choice(["m", "hello"] * 8 + TEXTS),
        "attributes": {
            rng.choice(["a", "b", "cd", "é", "", "abcde", "日本"]): rng.choice(
                ["x", 1, 2.5, True, "abcde"] * 4 + ODD + TEXTS
            )
            for _ in range(rng.randrange(5))
        },
    }
    for field in list(entry):
        chance = rng.random()
        if chance < 0.04:
            del entry[field]
        elif chance < 0.1:
            entry[field] = rng.choice(ODD)
    return entry


def test_random_entries(spark):
    rng = random.Random(20)
    entries = [_entry(rng) for _ in range(3_000)]
    found = check(spark, *entries, config=CONFIG)
    wrong = [(e, f, _expected(e)) for e, f in zip(entries, found) if f != _expected(e)]
    assert not wrong, wrong[:3]
    assert len(set(found)) > 20 and found.count(None) > 300
