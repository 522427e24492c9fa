"""Checking ingest requests: which entries are stored, and why the others are not."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlog.functions import variants
from loamlog.functions.timestamps import MINUTE, iso_timestamp
from loamlog.functions.variants import attributes_text, display_text, kind, longer_than
from loamlog.schema import LEVELS, IngestConfig

# Reasons reported to clients, here and, with a limit in them, at their rules.
MALFORMED = "malformed JSON"
NOT_AN_OBJECT = "request body must be an object"
NO_LOGS = "request body must contain a logs array"
ALL_REJECTED = "all log entries were rejected"
ENTRY_NOT_AN_OBJECT = "log entry must be an object"
TIMESTAMP_MISSING = "timestamp is required and must be a string"
TIMESTAMP_INVALID = "timestamp must be a valid ISO 8601 timestamp"
TIMESTAMP_TOO_OLD = "timestamp must not be before the year 1"
TIMESTAMP_FUTURE = "timestamp must not be more than five minutes in the future"
SERVICE_EMPTY = "service must be a non-empty string"
MESSAGE_EMPTY = "message must be a non-empty string"
ATTRIBUTES_NOT_FLAT = (
    "attributes must be a flat object containing only string, number, or boolean values"
)
ATTRIBUTE_KEY_EMPTY = "attribute keys must be non-empty strings"
ATTRIBUTE_NOT_FINITE = "attribute number values must be finite"

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_FUTURE_ALLOWED = 5 * MINUTE
# Drawn per process: a body cannot know it, so a body that closes the list itself is found out.
_END_MARK = uuid.uuid4().hex


def too_many_logs(config: IngestConfig) -> str:
    return f"logs array must contain at most {config.max_logs_per_batch} entries"


def parse_requests(requests: DataFrame, config: IngestConfig) -> DataFrame:
    """Adds ``entries`` (the logs array) and ``batch_reason`` where the envelope is at fault.

    The entries are parsed one by one. Cut out of one big document, each would carry
    the key list of all the others. The body stands in a list in front of an end mark; a
    body with anything after its document makes the list longer or loses the mark.
    """
    bracketed = F.concat(F.lit("["), F.col("body"), F.lit(f',{{"end":"{_END_MARK}"}}]'))
    documents = F.from_json(bracketed, "array<struct<logs:array<variant>,end:string>>", _STRICT)
    alone = (F.size("_documents") == 2) & (F.col("_documents")[1]["end"] == _END_MARK)
    parsed = requests.withColumn("_documents", documents).withColumn(
        "entries", F.when(alone, F.col("_documents")[0]["logs"])
    )
    reason = (
        F.when(F.col("entries").isNull(), _envelope_fault(F.try_parse_json(bracketed)))
        .when(F.size("entries") > config.max_logs_per_batch, too_many_logs(config))
        .when(F.size("entries") == 0, ALL_REJECTED)
    )
    # Kept for refused requests only, or every entry would carry a copy of the request.
    refused_body = F.when(F.col("batch_reason").isNotNull(), F.col("body"))
    return (
        parsed.withColumn("batch_reason", reason)
        .withColumn("body", refused_body)
        .drop("_documents")
    )


def _envelope_fault(documents: Column) -> Column:
    """Why there are no entries; looked into for such requests only."""
    marked = F.try_variant_get(documents, "$[1].end", "string") == _END_MARK
    alone = (F.size(documents.try_cast("array<variant>")) == 2) & F.coalesce(marked, F.lit(False))
    return (
        F.when(documents.isNull() | ~alone, MALFORMED)
        .when(~_is_object(F.try_variant_get(documents, "$[0]", "variant")), NOT_AN_OBJECT)
        .otherwise(NO_LOGS)
    )


def _is_object(value: Column) -> Column:
    return kind(value).startswith("OBJECT")


def explode_entries(parsed: DataFrame) -> DataFrame:
    """One row per entry with its 0-based ``index``.

    A request without entries keeps one row with a NULL index, so its reason
    travels along with the entries of the others.
    """
    entries = F.when(F.col("batch_reason").isNull(), F.col("entries"))
    kept = [c for c in parsed.columns if c != "entries"]
    return parsed.select(*kept, F.posexplode_outer(entries).alias("index", "entry"))


def _attribute_fault(config: IngestConfig) -> Column:
    """First fault among the attributes, in one pass over them."""
    attributes = F.col("_attributes_map")

    def fault(pair: Column) -> Column:
        return variants.let(
            kind(pair["value"]), lambda name: fault_of(pair["key"], pair["value"], name)
        )

    def fault_of(key: Column, value: Column, value_kind: Column) -> Column:
        is_text = value_kind == "STRING"
        is_number = variants.is_number(value_kind)
        # Only doubles can be infinite.
        infinite = (value_kind == "DOUBLE") & (F.abs(value.try_cast("double")) == float("inf"))
        return (
            F.when(key == "", ATTRIBUTE_KEY_EMPTY)
            .when(
                longer_than(key, config.max_attribute_key_length),
                f"attribute keys must be at most {config.max_attribute_key_length} characters",
            )
            .when(~(is_text | is_number | (value_kind == "BOOLEAN")), ATTRIBUTES_NOT_FLAT)
            .when(infinite, ATTRIBUTE_NOT_FINITE)
            .when(
                is_text & longer_than(value.try_cast("string"), config.max_attribute_value_length),
                "attribute string values must be at most "
                f"{config.max_attribute_value_length} characters",
            )
        )

    faults = F.filter(F.transform(F.map_entries(attributes), fault), lambda f: f.isNotNull())
    return (
        F.when(attributes.isNull(), ATTRIBUTES_NOT_FLAT)
        .when(
            F.size(attributes) > config.max_attributes,
            f"attributes must contain at most {config.max_attributes} keys",
        )
        .otherwise(F.get(faults, F.lit(0)))
    )


def _required_text(field: str, limit: int, empty_reason: str) -> list[tuple[Column, Column | str]]:
    text = F.col(f"_{field}_text")
    return [
        (text.isNull() | (text == ""), empty_reason),
        (longer_than(text, limit), f"{field} must be at most {limit} characters"),
    ]


@lru_cache(maxsize=8)
def _fault(config: IngestConfig) -> Column:
    """First fault of an opened entry in front of its attributes. It depends on column names
    alone, and a stream would otherwise build the same long rule chain for every micro-batch."""
    level = F.col("_level_text")
    rules: list[tuple[Column, Column | str]] = [
        (F.col("batch_reason").isNotNull(), F.col("batch_reason")),
        # Only an object has a string timestamp, so the costlier look at the whole
        # entry is left to entries without one.
        (F.col("_timestamp_text").isNull() & ~_is_object(F.col("entry")), ENTRY_NOT_AN_OBJECT),
        (F.col("_timestamp_text").isNull(), TIMESTAMP_MISSING),
        (F.col("_time").isNull(), TIMESTAMP_INVALID),
        # Days are SQL dates and those begin with the year 1.
        (F.col("_time") < F.lit("0001-01-01T00:00:00Z").cast("timestamp"), TIMESTAMP_TOO_OLD),
        (F.col("_time") > F.col("_latest"), TIMESTAMP_FUTURE),
        (
            level.isNull() | ~level.isin(*LEVELS),
            F.concat(F.lit("invalid level: '"), display_text(F.col("_level")), F.lit("'")),
        ),
        *_required_text("service", config.max_service_length, SERVICE_EMPTY),
        *_required_text("message", config.max_message_length, MESSAGE_EMPTY),
    ]
    fault = F
    for failed, text in rules:
        fault = fault.when(failed, text)
    return fault


def _attributes_map() -> Column:
    """The attributes of entries that have no fault so far; the others' are not looked into."""
    attributes = F.col("_attributes")
    opened = F.when(attributes.isNotNull(), attributes.try_cast("map<string,variant>")).otherwise(
        F.create_map().cast("map<string,variant>")
    )
    return F.when(F.col("_fault").isNull(), opened)


@lru_cache(maxsize=8)
def _outcome(config: IngestConfig) -> Column:
    """Reason and fields of an opened entry."""
    fault = F.col("_fault")
    return F.struct(
        F.when(fault.isNotNull(), fault).otherwise(_attribute_fault(config)).alias("reason"),
        F.col("entry"),
        F.col("_time").alias("timestamp"),
        F.col("_level_text").alias("level"),
        F.col("_service_text").alias("service"),
        F.col("_message_text").alias("message"),
        F.coalesce("_attributes", F.parse_json(F.lit("{}"))).alias("attributes"),
    )


@lru_cache(maxsize=1)
def _opening() -> tuple[list[Column], list[Column], list[Column]]:
    """Columns in three steps: each field as JSON, its text if it is one, the parsed time."""

    def text_of(name: str) -> Column:
        value = F.col(f"_{name}")
        return F.when(kind(value) == "STRING", value.try_cast("string"))

    fields = ("timestamp", "level", "service", "message")
    return (
        [
            F.try_variant_get("entry", f"$.{name}", "variant").alias(f"_{name}")
            for name in (*fields, "attributes")
        ],
        [text_of(name).alias(f"_{name}_text") for name in fields],
        [iso_timestamp(F.col("_timestamp_text")).alias("_time")],
    )


def validate_entries(entries: DataFrame, now: int, config: IngestConfig) -> DataFrame:
    """Adds ``reason`` (NULL for a valid entry), the ``entry`` and its five fields.

    ``now`` is fixed for the whole run, in epoch microseconds. The first failing
    rule wins.
    """
    kept = [c for c in entries.columns if c != "entry"]
    opened = entries
    for step in _opening():
        opened = opened.select("*", *step)
    opened = opened.withColumn("_latest", F.timestamp_micros(F.lit(now + _FUTURE_ALLOWED)))
    opened = opened.withColumn("_fault", _fault(config)).withColumn("_attributes_map", _attributes_map())
    # A generator behind the rules: a later filter on the reason would be pushed down to them
    # otherwise, and the whole chain be evaluated once more for it. Inside the generator the
    # rules would be interpreted row by row; as a column they are compiled.
    outcome = opened.select(*kept, _outcome(config).alias("_outcome"))
    checked = outcome.select(*kept, F.inline(F.array("_outcome")))
    return checked.withColumn("entry", F.when(F.col("reason").isNotNull(), F.col("entry")))


def check_requests(
    requests: DataFrame, now: int, config: IngestConfig | None = None
) -> DataFrame:
    """Parse, explode and validate; narrow from end to end, no shuffle.

    ``requests`` needs a ``body`` column and may carry others along.
    """
    config = config or IngestConfig()
    return validate_entries(explode_entries(parse_requests(requests, config)), now, config)


def accepted(checked: DataFrame) -> DataFrame:
    """Valid entries as stored: the five fields, and every attribute as text."""
    extra = [c for c in checked.columns if c in ("request_id", "index", "arrival")]
    return checked.where(F.col("reason").isNull()).select(
        *extra,
        "timestamp",
        "level",
        "service",
        "message",
        "attributes",
        attributes_text("attributes").alias("attributes_text"),
    )


def rejected(checked: DataFrame) -> DataFrame:
    """Dead letters: what was refused and why, so that it can be read and sent again.

    A refused entry is kept as JSON. A NULL index means the whole request, whose body is kept
    with it. ``arrival`` says where it came from, if that is known.
    """
    extra = [c for c in checked.columns if c == "arrival"]
    return checked.where(F.col("reason").isNotNull()).select(
        "request_id", "index", "reason", "body", F.to_json("entry").alias("entry"), *extra
    )


def ingest_report(checked: DataFrame, *keys: str) -> DataFrame:
    """Per request: accepted count, rejects in index order, and the error if nothing was stored.

    The list is bounded by the number of entries a request may hold.
    """
    keys = keys or ("request_id",)
    fault = F.struct("index", "reason")
    refused = F.col("reason").isNotNull() & F.col("index").isNotNull()
    return (
        checked.groupBy(*keys)
        .agg(
            F.count_if(F.col("reason").isNull()).alias("accepted"),
            F.sort_array(F.collect_list(F.when(refused, fault))).alias("rejected"),
            F.max("batch_reason").alias("_batch_reason"),
        )
        .select(
            *keys,
            "accepted",
            "rejected",
            F.coalesce(
                "_batch_reason", F.when(F.col("accepted") == 0, F.lit(ALL_REJECTED))
            ).alias("error"),
        )
    )
