"""The ``events`` table seen as logs, and as ingest requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamlog.functions.timestamps import iso_millis

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

# Service names, by user_id modulo their number.
SERVICES = ("checkout", "auth", "payments", "inventory", "notifications")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the schema of ``events`` is stated, which saves a look at its footer."""
    reader = spark.read.schema(EVENTS) if name == "events" else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that makes requests of them, and tasks per core where there are few rows.
_DEALT, _WAVES = 50_000, 4


def dealt(events: DataFrame, order: str | None = None) -> DataFrame:
    """The rows spread over all cores, in tasks of about as many rows each; along a column if named.

    A table of narrow rows is a file of few row groups, so few tasks read it, while the requests
    made of it are hundreds of times larger.
    """
    cores = events.sparkSession.sparkContext.defaultParallelism
    tasks = max(_WAVES * cores, -(-events.count() // _DEALT))
    if order is None:
        return events.repartition(tasks)
    return events.repartitionByRange(tasks, order).sortWithinPartitions(order)


def _level() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "error", "error")
        .when(kind == "purchase", "warn")
        .when(kind == "view", "debug")
        .otherwise("info")
    )


def _service() -> Column:
    names = F.array(*[F.lit(s) for s in SERVICES])
    return F.get(names, (F.col("user_id") % len(SERVICES)).cast("int"))


def _message() -> Column:
    quota = F.when(F.col("value") >= 100, " at 100% quota").otherwise(" at 50 quota")
    return F.concat(
        F.upper("event_type"), F.lit(" by user_"), F.col("user_id").cast("string"), quota
    )


def logs_of(events: DataFrame, *extra: str) -> DataFrame:
    """Events as rows of the logs table; time stays zone-less, ids start at 1."""
    attributes = F.create_map(
        F.lit("k"),
        F.get_json_object("props", "$.k"),
        F.lit("user_id"),
        F.col("user_id").cast("string"),
        F.lit("active"),
        F.when(F.col("value") > 20, "true").otherwise("false"),
    )
    return events.select(
        (F.col("event_id") + 1).alias("id"),
        F.col("ts").alias("timestamp"),
        _level().alias("level"),
        _service().alias("service"),
        _message().alias("message"),
        attributes.alias("attributes_text"),
        *extra,
    )


def logs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_of(read_table(spark, sf_dir, "events"))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def _attribute(key: str) -> Column:
    return F.col("attributes_text")[F.lit(key)]


def _shown(text: Column) -> Column:
    return F.coalesce(text, F.lit("null"))


def _fields(logs: DataFrame) -> DataFrame:
    """Adds every field of a log as the JSON of an object's member, made once for all entries."""
    attributes = F.concat(
        F.lit('{"k":'),
        _shown(_attribute("k")),
        F.lit(',"user_id":"'),
        _shown(_attribute("user_id")),
        F.lit('","active":'),
        _shown(_attribute("active")),
        F.lit(',"value":'),
        _shown(F.col("value").cast("string")),
        F.lit("}"),
    )
    fields = {
        "timestamp": _quoted(iso_millis(F.col("timestamp"))),
        "level": _quoted(F.col("level")),
        "service": _quoted(F.col("service")),
        "message": _quoted(F.col("message")),
        "attributes": attributes,
    }
    return logs.select("*", *[F.concat(F.lit(f'"{k}":'), v).alias(f"_{k}") for k, v in fields.items()])


def _entry(**changes: Column | None) -> Column:
    """A log as a JSON object; a change replaces a field's JSON, None leaves it out.

    Of rows with the columns of ``_fields``.
    """
    parts = {k: F.col(f"_{k}") for k in ("timestamp", "level", "service", "message", "attributes")}
    changed = {k: None if v is None else F.concat(F.lit(f'"{k}":'), v) for k, v in changes.items()}
    found = [v for v in {**parts, **changed}.values() if v is not None]
    return F.concat(F.lit("{"), F.concat_ws(",", *found), F.lit("}"))


def _numbered_keys(n: int) -> Column:
    return F.lit(",".join(f'"k{i}":{i}' for i in range(1, n + 1)))


def _request(*entries: Column) -> Column:
    return F.concat(F.lit('{"logs":['), F.concat_ws(",", *entries), F.lit("]}"))


def clean_requests(events: DataFrame) -> DataFrame:
    """One valid request per event: ``request_id``, ``body``."""
    return _fields(logs_of(events, "value")).select(
        F.col("id").alias("request_id"), _request(_entry()).alias("body")
    )


def batched_requests(events: DataFrame, size: int) -> DataFrame:
    """Valid requests of up to ``size`` consecutive events each: ``body``."""
    return (
        _fields(logs_of(events, "value"))
        .groupBy(F.floor(F.col("id") / size).alias("request"))
        .agg(F.collect_list(_entry()).alias("entries"))
        .select(
            F.concat(F.lit('{"logs":['), F.array_join("entries", ","), F.lit("]}")).alias("body")
        )
    )


def mixed_requests(events: DataFrame) -> DataFrame:
    """One request per event with damaged copies of it beside it.

    Built inside the row, so every validation rule meets data from the whole table
    without a shuffle. Small ``error`` events come without their valid entry, small ``info``
    ones without attributes, small ``warn`` and ``debug`` ones in broken envelopes, and a
    few requests are too long.
    """
    stamp, user = F.col("stamp"), F.col("user")
    small = F.col("value") < 5
    damaged = [
        _entry(timestamp=None),
        _entry(timestamp=user),
        _entry(timestamp=_quoted(F.replace(stamp, F.lit("T"), F.lit(" ")))),
        _entry(timestamp=_quoted(F.replace(stamp, F.lit("2024-"), F.lit("2124-")))),
        _entry(level=_quoted(F.upper("level"))),
        _entry(service=F.lit('""')),
        _entry(service=_quoted(F.repeat("service", 65))),
        _entry(message=user),
        _entry(attributes=F.lit("null")),
        _entry(attributes=F.concat(F.lit('{"nested":{"user":'), _shown(user), F.lit("}}"))),
        _entry(attributes=F.concat(F.lit('{"":'), _shown(user), F.lit("}"))),
        F.concat(F.lit("["), _shown(user), F.lit("]")),
        F.when(F.col("level") == "debug", _entry(message=_quoted(F.repeat("message", 320)))),
        _entry(timestamp=F.lit('"0000-06-01T00:00:00Z"')),
        _entry(timestamp=F.lit('"0001-01-01T00:00:00+05:00"')),
        _entry(attributes=F.concat(F.lit("{"), _numbered_keys(51), F.lit("}"))),
        _entry(attributes=F.concat(F.lit('{"'), F.repeat(F.lit("k"), 129), F.lit('":1}'))),
        _entry(attributes=F.lit('{"n":-1e400}')),
        _entry(attributes=F.concat(F.lit('{"s":"'), F.repeat(F.lit("v"), 4097), F.lit('"}'))),
        _entry(level=F.concat(F.lit('[["'), _shown(F.col("level")), F.lit('"],[1,[null,2]]]'))),
    ]
    # Fields that no rule knows are dropped, a client's id too.
    more = {"id": F.lit("7"), "extra": F.lit('"x"')}
    bare = (F.col("level") == "info") & small
    whole = F.when(bare, _entry(attributes=None, **more)).otherwise(_entry(**more))
    whole = F.when(~((F.col("level") == "error") & small), whole)
    sound = F.col("sound")
    debug, value = F.col("level") == "debug", F.col("value")
    body = (
        F.when(F.col("id") % 2500 == 7, F.concat(F.lit('{"logs":['), F.repeat(F.lit("1,"), 10_000), F.lit("1]}")))
        .when((F.col("level") == "warn") & small, F.concat(F.lit('{"logs":'), _entry(), F.lit("}")))
        .when(debug & (value < 1), F.regexp_replace(sound, r"\}$", ""))
        .when(debug & (value < 2), F.concat(sound, F.lit("] garbage")))
        .when(debug & (value < 3), F.concat(sound, F.lit("],[1")))
        .when(debug & (value < 4), F.concat(F.lit("["), _shown(user), F.lit("]")))
        .when(debug & (value < 5), F.concat(sound, F.lit(","), sound))
        .otherwise(sound)
    )
    logs = logs_of(events, "value").select(
        "*", iso_millis(F.col("timestamp")).alias("stamp"), _attribute("user_id").alias("user")
    )
    requests = _fields(logs).select("*", _request(whole, *damaged).alias("sound"))
    return requests.select(F.col("id").alias("request_id"), body.alias("body"))
