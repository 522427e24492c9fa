"""Time on both sides: column expressions, and epoch-microsecond arithmetic on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamlog.schema import BUCKETS

SECOND = 1_000_000
MINUTE = 60 * SECOND
DAY = 24 * 60 * MINUTE

# Fixed value: the accepted timestamp form. Spark needs \z because Java's $ also
# matches in front of a final line break.
_ISO = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?(?:Z|[+-]\d{2}:\d{2})"
_ISO_MICROS = re.compile(
    r"(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,6}))?(?:Z|([+-])(\d{2}):(\d{2}))",
    re.ASCII,
)
_ISO_MILLIS = re.compile(_ISO, re.ASCII)


# ---- columns ---------------------------------------------------------------


def bucket_start(ts: Column, bucket: str) -> Column:
    """Start of the tumbling bucket, aligned to the UTC epoch whatever the session zone."""
    return F.window(ts, BUCKETS[bucket]).getField("start")


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text to timestamp, NULL when it is not of the accepted form.

    Spark's own cast covers ordinary values. What it refuses but a lenient clock
    accepts is computed from the fields: days past the month's end roll over,
    24:00:00 is the next midnight, and offsets may reach 23:59.
    """
    return F.when(
        text.rlike(rf"^{_ISO}\z"),
        F.coalesce(text.try_cast("timestamp"), _rolled_over(text)),
    )


def _rolled_over(text: Column) -> Column:
    def number(position: int, size: int) -> Column:
        return F.substring(text, position, size).try_cast("long")

    month, day = number(6, 2), number(9, 2)
    hour, minute, second = number(12, 2), number(15, 2), number(18, 2)
    millis = F.rpad(F.regexp_extract(text, r"\.(\d+)", 1), 3, "0").try_cast("long")
    zulu = text.endswith("Z")
    zone_hour = F.when(zulu, F.lit(0)).otherwise(number(-5, 2))
    zone_minute = F.when(zulu, F.lit(0)).otherwise(number(-2, 2))
    zone_sign = F.when(F.substring(text, -6, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    midnight = (hour == 24) & (minute == 0) & (second == 0) & (millis == 0)
    in_range = (
        month.between(1, 12)
        & day.between(1, 31)
        & ((hour <= 23) | midnight)
        & (minute <= 59)
        & (second <= 59)
        & (zone_hour <= 23)
        & (zone_minute <= 59)
    )
    first_of_month = F.make_date(
        number(1, 4).cast("int"), month.cast("int"), F.lit(1)
    )
    seconds = (
        (F.unix_date(first_of_month).cast("long") + day - 1) * 86_400
        + hour * 3_600
        + minute * 60
        + second
        - zone_sign * (zone_hour * 3_600 + zone_minute * 60)
    )
    return F.when(in_range, F.timestamp_micros(seconds * SECOND + millis * 1_000))


def iso_millis(ts: Column) -> Column:
    """UTC text with three fraction digits and a Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def sql_literal(micros: int, dtype: T.DataType) -> str:
    """A time literal of the column's own type, so comparisons stay cast-free and push down."""
    value = f"timestamp_micros({micros})"
    return f"CAST({value} AS TIMESTAMP_NTZ)" if isinstance(dtype, T.TimestampNTZType) else value


def literal(micros: int, dtype: T.DataType) -> Column:
    return F.expr(sql_literal(micros, dtype))


def sql_date(micros: int) -> str:
    """The UTC day of a time, as a date literal."""
    return f"date_from_unix_date({micros // DAY})"


# ---- driver ----------------------------------------------------------------

# Fixed value: days in 400 years, after which the calendar repeats. Python dates
# start at year 1, so year 0 is computed one such era later.
_ERA_DAYS = 146_097
_EPOCH_ORDINAL = date(1970, 1, 1).toordinal()


def to_micros(value: int | str | datetime) -> int:
    """Epoch microseconds from an ISO string, a datetime (naive means UTC) or microseconds."""
    if isinstance(value, bool):
        raise ValueError("not a time")
    if isinstance(value, int):
        return value
    if isinstance(value, datetime):
        aware = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        delta = aware - datetime(1970, 1, 1, tzinfo=timezone.utc)
        return (delta.days * 86_400 + delta.seconds) * SECOND + delta.microseconds
    if isinstance(value, str):
        micros = parse_iso(value)
        if micros is not None:
            return micros
    raise ValueError("must be a valid ISO 8601 timestamp")


def parse_iso(text: str, micros: bool = False) -> int | None:
    """Driver twin of ``iso_timestamp``; ``micros`` also allows up to six fraction digits."""
    if not micros and not _ISO_MILLIS.fullmatch(text):
        return None
    found = _ISO_MICROS.fullmatch(text)
    if not found:
        return None
    year, month, day, hour, minute, second = (int(found[i]) for i in range(1, 7))
    fraction = int((found[7] or "").ljust(6, "0"))
    zone = (int(found[9]), int(found[10])) if found[8] else (0, 0)
    at_midnight = hour == 24 and minute == second == fraction == 0
    if not (1 <= month <= 12 and 1 <= day <= 31 and (hour <= 23 or at_midnight)):
        return None
    if minute > 59 or second > 59 or zone[0] > 23 or zone[1] > 59:
        return None
    eras = 1 if year == 0 else 0
    days = date(year + 400 * eras, month, 1).toordinal() - eras * _ERA_DAYS - _EPOCH_ORDINAL
    offset = (zone[0] * 3_600 + zone[1] * 60) * (-1 if found[8] == "-" else 1)
    seconds = (days + day - 1) * 86_400 + hour * 3_600 + minute * 60 + second - offset
    return seconds * SECOND + fraction


def format_iso(micros: int) -> str:
    """Three fraction digits, or six where the value is finer than a millisecond."""
    days, rest = divmod(micros, DAY)
    eras = 0 if days + _EPOCH_ORDINAL > 0 else 1
    shifted = date.fromordinal(days + _EPOCH_ORDINAL + eras * _ERA_DAYS)
    seconds, fraction = divmod(rest, SECOND)
    digits = f"{fraction // 1_000:03d}" if fraction % 1_000 == 0 else f"{fraction:06d}"
    clock = f"{seconds // 3_600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
    return f"{shifted.year - 400 * eras:04d}-{shifted:%m-%d}T{clock}.{digits}Z"


def floor_minute(micros: int) -> int:
    return micros // MINUTE * MINUTE


def ceil_minute(micros: int) -> int:
    return -(-micros // MINUTE) * MINUTE


@dataclass(frozen=True)
class RangeSplit:
    """``[since, until)`` as whole minutes plus the partial minutes around them."""

    edges: tuple[tuple[int, int], ...]
    middle: tuple[int, int] | None


def split_range(since: int, until: int) -> RangeSplit:
    """The middle is the range's whole minutes, the edges are the range without the middle."""
    whole = range(ceil_minute(since), floor_minute(until), MINUTE)
    middle = (whole.start, whole.stop) if whole else None
    cuts = [since, *(middle or ()), until]
    edges = zip(cuts[::2], cuts[1::2])  # what lies before the middle, and behind it
    return RangeSplit(tuple((a, b) for a, b in edges if a < b), middle)
