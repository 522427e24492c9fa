import json

import pytest
from pyspark.sql import SparkSession

from loamlog.functions.timestamps import format_iso, to_micros
from loamlog.operators import validate
from loamlog.schema import IngestConfig
from loamlog.session import configure
from loamlog.sources.store import LogStore

BASE = to_micros("2026-07-20T14:00:00.000Z")
NOW = to_micros("2026-07-21T00:00:00Z")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("loamlog-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


def at(seconds: float) -> str:
    """A time of the test window, as ISO text with milliseconds."""
    return format_iso(BASE + round(seconds * 1_000_000))


def log(**changes):
    entry = {
        "timestamp": at(1921.25),
        "level": "warn",
        "service": "harbour",
        "message": "crane 7 is slow",
        "attributes": {"user_id": "314", "berth": "north", "lifts": 12},
    }
    entry.update(changes)
    return {k: v for k, v in entry.items() if v is not ...}


def requests(spark, *bodies):
    """One request per body; dicts and lists become JSON, texts are taken as they are."""
    texts = [b if isinstance(b, str) else json.dumps(b) for b in bodies]
    rows = spark.createDataFrame(list(enumerate(texts)), "request_id long, body string")
    return rows.coalesce(1)


def check(spark, *entries, config=None, now=NOW):
    """Reasons of the entries of one request, in order."""
    frame = requests(spark, {"logs": list(entries)})
    checked = validate.check_requests(frame, now, config or IngestConfig())
    return [r["reason"] for r in checked.orderBy("index").select("reason").collect()]


def stored(spark, path, *entries, **options):
    """A new store holding the entries."""
    store = LogStore(spark, str(path), **options)
    if entries:
        store.ingest(requests(spark, {"logs": list(entries)}), NOW)
    return store


def explained(frame):
    """The formatted physical plan, where long filter lists are not cut off."""
    explain = frame.sparkSession._jvm.PythonSQLUtils.explainString
    return explain(frame._jdf.queryExecution(), "formatted")
