"""Numbering, running totals and percentiles against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loamlog.operators.ordering import assign_ids, nth_bucket, running_total
from loamlog.operators.stats import latency_summary
from loamlog.sources.batches import rows_from_arrays


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key."""
    rng = random.Random(4)
    rows = [(i, 5 if rng.random() < 0.34 else rng.randrange(1000)) for i in range(5_000)]
    return rows, spark.createDataFrame(rows, "id long, key long").repartition(6)


def test_dense_ids(skewed):
    rows, frame = skewed
    found = assign_ids(frame, [F.col("key").asc(), F.col("id").desc()], name="n", start=10)
    ordered = sorted(rows, key=lambda r: (r[1], -r[0]))
    assert {r["id"]: r["n"] for r in found.collect()} == {
        row[0]: 10 + place for place, row in enumerate(ordered)
    }


def test_running_total(skewed):
    rows, frame = skewed
    found = running_total(frame, [F.col("key").asc(), F.col("id").asc()], "key")
    expected, total = {}, 0
    for row_id, key in sorted(rows, key=lambda r: (r[1], r[0])):
        total += key
        expected[row_id] = total
    assert {r["id"]: r["running"] for r in found.collect()} == expected


def test_nth_bucket(spark):
    counts = spark.createDataFrame([(1, 5), (2, 0), (3, 7)], "bucket long, n long")
    assert nth_bucket(counts, 1) == (1, 0)
    assert nth_bucket(counts, 5) == (1, 0)
    assert nth_bucket(counts, 6) == (3, 5)
    assert nth_bucket(counts, 12) == (3, 5)
    assert nth_bucket(counts, 13) == (None, 12)
    assert nth_bucket(counts, 7, descending=True) == (3, 0)
    assert nth_bucket(counts, 8, descending=True) == (1, 7)
    assert nth_bucket(counts.where("n > 9"), 1) == (None, 0)


def test_percentiles_are_nearest_rank(spark):
    rng = random.Random(9)
    groups = {
        "one": [3.5],
        "flat": [1.0] * 700,
        "twenty": [float(i) for i in range(1, 21)],
        "many": [round(rng.expovariate(0.1), 2) for _ in range(3000)],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = {r["g"]: r for r in latency_summary(frame, "v", "g").collect()}
    for group, values in groups.items():
        values = sorted(values)
        for p in (50, 95, 99):
            expected = values[max(0, math.ceil(p / 100 * len(values)) - 1)]
            assert found[group][f"p{p}"] == expected, (group, p)
        assert found[group]["max"] == values[-1]


def test_parallel_arrays(spark):
    frame = spark.sql("SELECT 1 AS id, array('a', 'b') AS x, array(10, 20) AS y")
    assert [tuple(r) for r in rows_from_arrays(frame, "x", "y").collect()] == [
        (1, "a", 10), (1, "b", 20),
    ]
