"""Every query against its SQL twin on the smallest given tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from loamlog.plans import oracles, registry
from tools.check_oracles import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


OWN = sorted(registry.queries())


def test_every_query_has_a_twin():
    assert set(OWN) == set(oracles.oracle_sql())
    assert set(OWN) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_optional_modules_may_be_absent_but_not_broken(monkeypatch):
    def absent(name):
        raise ModuleNotFoundError(f"No module named {gone!r}", name=gone)

    monkeypatch.setattr(contract.importlib, "import_module", absent)
    for gone in ("loamlog.llm", "loamlog.llm.registry", "corpus_pipeline"):
        assert sorted(contract.queries()) == OWN
    gone = "numpy"
    with pytest.raises(ModuleNotFoundError):
        contract.queries()


def test_entry(spark):
    assert contract.entry(spark).columns == ["start", "group", "count"]


@pytest.mark.parametrize("name", OWN)
def test_query(spark, db, name):
    ours, theirs, _ = compare(spark, db, FOLDER, name)
    assert ours == theirs
