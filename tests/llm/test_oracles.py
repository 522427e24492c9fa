"""The operators' queries that SQL can state, against their twins on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from loamlog.llm import decontaminate, oracles
from tools.check_oracles import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query(spark, db, name):
    ours, theirs, _ = compare(spark, db, FOLDER, name)
    assert ours == theirs


def test_every_operator_has_one_query():
    numbers = [int(n[2:].split("_")[0]) for n in contract.queries() if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in contract.queries()


def checked(spark, documents, items, **options):
    documents = spark.createDataFrame(documents, "doc_id long, text string, items string")
    items = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.decontaminate(documents, items, **options)
    assert sorted(found.columns) == ["doc_id", "items", "n_hit", "n_words", "text"]
    return sorted(
        ((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()), key=str
    )


def spelled(first, last):
    return " ".join(f"W{i}" for i in range(first, last))


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_decontamination_cases(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", broadcast)
    items = [(7, spelled(0, 30)), (8, "Short  ITEM"), (9, None), (10, "..."), (7, spelled(0, 30)), (11, "a " * 40)]
    documents = [
        (1, "x " + spelled(5, 15).lower() + " y", None),
        (2, spelled(5, 14), None),  # nine words
        (3, "a short,item! here; SHORT item", None),
        (4, None, "x"),
        (4, None, "x"),
        (None, "", None),
        (5, "w " * 30_000 + spelled(0, 30), None),
        (6, spelled(0, 12) + " gap " + spelled(18, 30), None),
        (9, "A. " * 25, None),
        (12, "é É Short ïtem", None),
    ]
    assert checked(spark, documents, items) == sorted(
        [
            (1, 12, 10, ["7"]),
            (2, 9, 0, []),
            (3, 6, 4, ["8"]),
            (4, 0, 0, []),
            (4, 0, 0, []),
            (None, 0, 0, []),
            (5, 30_030, 30, ["7"]),
            (6, 25, 24, ["7"]),
            (9, 25, 25, ["11"]),
            (12, 4, 0, []),
        ],
        key=str,
    )


def test_empty_sides(spark):
    assert checked(spark, [], [(1, "a b")]) == []
    assert checked(spark, [(1, "a b", None)], []) == [(1, 2, 0, [])]
