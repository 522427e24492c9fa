"""Work that must spread over cores and writes: requests of a table, flushes in groups, staged files."""

from pyspark.sql import functions as F

from loamlog.operators import validate
from loamlog.sources.events import EVENTS, dealt, mixed_requests
from loamlog.sources.store import LogStore
from loamlog.streaming import flushes

from .conftest import explained
from .test_store import NOW


def _events(spark, n):
    rows = spark.range(0, n, 1, 1)
    return rows.select(
        F.col("id").alias("event_id"),
        (F.lit("2024-01-05T00:00:00").cast("timestamp_ntz")).alias("ts"),
        (F.col("id") % 7).alias("user_id"),
        F.lit("view").alias("event_type"),
        F.col("id").cast("double").alias("value"),
        F.lit('{"k": 3}').alias("props"),
    ).select(*EVENTS.names)


def test_requests_of_one_row_group_are_made_by_all_cores(spark):
    spread = dealt(_events(spark, 400))
    assert spread.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert spread.count() == 400
    assert mixed_requests(spread).agg(F.count_distinct("request_id")).first()[0] == 400


def test_dealt_along_a_column_keeps_the_order(spark):
    spread = dealt(_events(spark, 400), "event_id")
    assert spread.rdd.getNumPartitions() > 1
    assert [r["event_id"] for r in spread.collect()] == list(range(400))


def test_rules_are_compiled_not_interpreted_in_the_generator(spark):
    checked = validate.check_requests(mixed_requests(_events(spark, 4)), NOW)
    inlined = [line for line in explained(checked).splitlines() if "inline(" in line]
    assert inlined and all("CASE" not in line for line in inlined)


def test_a_write_does_not_cache_entries_and_leaves_no_staging(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(type(spark.range(1)), "persist", lambda *_: (_ for _ in ()).throw(AssertionError("cached")))
    assert isinstance(spark.range(1), DataFrame)
    store = LogStore(spark, f"{tmp_path}/store")
    found = store.ingest(mixed_requests(_events(spark, 6)), NOW)
    assert found.accepted == store.logs().count() and found.rejected == store.rejected().count()
    assert store.reports().count() == 6
    assert not list((tmp_path / "store" / "_staging").iterdir())


def test_groups_of_flushes_grow_and_keep_the_order():
    names = [str(i) for i in range(1200)]
    groups = list(flushes.in_groups(names))
    assert [n for _, group in groups for n in group] == names and len(groups) < 20
    assert [start for start, _ in groups][:4] == [0, 1, 3, 7]
    assert max(len(group) for _, group in groups) == flushes.GROUP


def test_dead_letters_are_read_back_in_one_look(spark):
    from loamlog.plans import registry

    plan = explained(registry.queries()["dead_letters"](spark, "/root/testdata/sf0.001"))
    assert "json_tuple(entry" in plan and "get_json_object(entry" not in plan


def test_checked_entries_are_not_sorted_by_their_file(spark, tmp_path, monkeypatch):
    """Two files a task are open side by side; the setting is as before when they are written."""
    from pyspark.sql import DataFrameWriter

    key, seen, plain = "spark.sql.maxConcurrentOutputFileWriters", {}, DataFrameWriter.parquet

    def parquet(writer, path, *more, **options):
        seen["checked" if "/checked" in path else "others"] = int(spark.conf.get(key))
        return plain(writer, path, *more, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    before = spark.conf.get(key)
    LogStore(spark, f"{tmp_path}/store").ingest(mixed_requests(_events(spark, 6)), NOW)
    assert seen == {"checked": 3, "others": int(before)} and spark.conf.get(key) == before
