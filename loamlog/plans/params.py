"""Query arguments: what may be asked, checked once on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from loamlog.functions import cursors
from loamlog.functions.cursors import Cursor
from loamlog.functions.timestamps import to_micros
from loamlog.schema import BUCKETS, GROUPS, LEVELS

DEFAULT_LIMIT = 100
MAX_LIMIT = 1_000
_SEARCH_NAMES = {"service", "level", "since", "until", "q", "limit", "cursor"}
_AGGREGATE_NAMES = {"service", "level", "since", "until", "q", "bucket", "group_by"}


def _attributes(params: dict[str, Any], allowed: set[str]) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in params.items():
        if name.startswith("attr."):
            key = name.removeprefix("attr.")
            if not key:
                raise ValueError("attribute key cannot be empty")
            if not isinstance(value, str):
                raise ValueError(f"invalid attribute filter: {name}")
            found[key] = value
        elif name not in allowed:
            raise ValueError(f"unknown query parameter: {name}")
    return found


def _check_text(name: str, value: Any) -> None:
    if value is not None and not isinstance(value, str):
        raise ValueError(f"{name} must be a string")


def _time(name: str, value: Any) -> int:
    try:
        return to_micros(value)
    except ValueError:
        raise ValueError(f"{name} must be a valid ISO 8601 timestamp") from None


def _given_time(params: dict[str, Any], name: str) -> int:
    if not isinstance(params.get(name), str):
        raise ValueError(f"{name} must be a valid ISO 8601 timestamp")
    return _time(name, params[name])


@dataclass(frozen=True)
class _Filters:
    service: str | None = None
    level: str | None = None
    since: Any = None
    until: Any = None
    q: str | None = None
    attributes: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in ("service", "q"):
            _check_text(name, getattr(self, name))
        if self.level is not None and self.level not in LEVELS:
            raise ValueError("invalid level")
        for name in ("since", "until"):
            if getattr(self, name) is not None:
                object.__setattr__(self, name, _time(name, getattr(self, name)))
        if self.since is not None and self.until is not None and self.until < self.since:
            raise ValueError("until must not be earlier than since")
        for key, value in self.attributes.items():
            if not key:
                raise ValueError("attribute key cannot be empty")
            if not isinstance(value, str):
                raise ValueError(f"invalid attribute filter: {key}")

    @property
    def countable(self) -> bool:
        """Whether the per-minute counts carry everything these filters look at."""
        return self.q is None and not self.attributes


@dataclass(frozen=True)
class LogQuery(_Filters):
    """Search arguments. Times may be ISO text, datetimes or epoch microseconds."""

    limit: int = DEFAULT_LIMIT
    cursor: Cursor | str | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        if isinstance(self.limit, bool) or not isinstance(self.limit, int):
            raise ValueError(f"limit must be an integer between 1 and {MAX_LIMIT}")
        if not 1 <= self.limit <= MAX_LIMIT:
            raise ValueError(f"limit must be an integer between 1 and {MAX_LIMIT}")
        if self.cursor is not None and not isinstance(self.cursor, Cursor):
            decoded = cursors.decode(self.cursor)
            if decoded is None:
                raise ValueError("invalid cursor")
            object.__setattr__(self, "cursor", decoded)

    @classmethod
    def from_params(cls, params: dict[str, Any]) -> LogQuery:
        """From flat named texts: ``service``, ``since``, ``attr.<key>`` and so on."""
        if not isinstance(params, dict):
            raise ValueError("invalid query parameters")
        attributes = _attributes(params, _SEARCH_NAMES)
        given = {k: v for k, v in params.items() if k in _SEARCH_NAMES and v is not None}
        for name in ("since", "until"):
            if name in given:
                given[name] = _given_time(given, name)
        if "limit" in given:
            given["limit"] = _whole_number(given["limit"])
        if "cursor" in given and not isinstance(given["cursor"], str):
            raise ValueError("invalid cursor")
        return cls(attributes=attributes, **given)


def _whole_number(text: Any) -> int:
    """Any spelling of a whole number that clients' own number parsing takes."""
    if isinstance(text, str):
        digits = text.strip()
        if re.fullmatch(r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+", digits):
            return int(digits, 0)
        if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", digits):
            number = float(digits)
            if number.is_integer():
                return int(number)
    raise ValueError(f"limit must be an integer between 1 and {MAX_LIMIT}")


@dataclass(frozen=True)
class AggregateQuery(_Filters):
    """Bucketed count arguments; the time range and bucket are mandatory."""

    bucket: str | None = None
    group_by: str | None = None

    def __post_init__(self) -> None:
        for name in ("since", "until"):
            if getattr(self, name) is None:
                raise ValueError(f"{name} must be a valid ISO 8601 timestamp")
        if not isinstance(self.bucket, str) or self.bucket not in BUCKETS:
            raise ValueError(f"bucket must be one of: {', '.join(BUCKETS)}")
        super().__post_init__()
        if self.group_by is not None and self.group_by not in GROUPS:
            raise ValueError(f"group_by must be one of: {', '.join(GROUPS)}")

    @classmethod
    def from_params(cls, params: dict[str, Any]) -> AggregateQuery:
        if not isinstance(params, dict):
            raise ValueError("invalid query parameters")
        attributes = _attributes(params, _AGGREGATE_NAMES)
        given = {k: v for k, v in params.items() if k in _AGGREGATE_NAMES and v is not None}
        for name in ("since", "until"):
            given[name] = _given_time(given, name)
        return cls(attributes=attributes, **given)
