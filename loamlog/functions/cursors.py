"""Paging position as an opaque URL-safe token."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamlog.functions.timestamps import format_iso, parse_iso


@dataclass(frozen=True)
class Cursor:
    """The last row a page returned. Microseconds are kept, or rows sharing a
    millisecond with it would be skipped."""

    micros: int
    id: int


def encode(cursor: Cursor) -> str:
    payload = json.dumps(
        {"timestamp": format_iso(cursor.micros), "id": str(cursor.id)}, separators=(",", ":")
    )
    return base64.urlsafe_b64encode(payload.encode()).decode().rstrip("=")


def decode(token: str) -> Cursor | None:
    """The position, or None for anything that is not a token of ours."""
    if not isinstance(token, str) or not re.fullmatch(r"[A-Za-z0-9_-]+", token):
        return None
    try:
        padded = token + "=" * (-len(token) % 4)
        data = json.loads(base64.urlsafe_b64decode(padded).decode("utf-8", "replace"))
    except ValueError:
        return None
    if not isinstance(data, dict):
        return None
    when, row_id = data.get("timestamp"), data.get("id")
    if not isinstance(when, str) or not isinstance(row_id, str):
        return None
    micros = parse_iso(when, micros=True)
    if micros is None or not re.fullmatch(r"[0-9]+", row_id) or not 0 < int(row_id) < 2**63:
        return None
    return Cursor(micros, int(row_id))


def token(ts: Column, row_id: Column) -> Column:
    """Column form of ``encode`` for pages laid out by Spark."""
    short = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    long = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    whole_millis = F.substring(long, -4, 3) == "000"
    payload = F.concat(
        F.lit('{"timestamp":"'),
        F.when(whole_millis, short).otherwise(long),
        F.lit('","id":"'),
        row_id.cast("string"),
        F.lit('"}'),
    )
    # Characters without a counterpart are dropped: the padding, and the line breaks
    # Spark may put into long texts.
    return F.translate(F.base64(F.encode(payload, "UTF-8")), "+/=\r\n", "-_")
