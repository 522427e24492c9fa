"""Fingerprints and groups against a plain restatement."""

import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loamlog.llm import simhash
from loamlog.llm.common import read_table

DOCS = "doc_id long, text string, fingerprint string, lang string"


def plain_fingerprint(text, words):
    found = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\v", " ")
             .replace("\f", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not found:
        return 0
    runs = [found[i : i + words] for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(" ".join(r), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius):
    group = list(range(len(prints)))
    values = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius):
            old, new = group[j], group[i]
            if old != new:
                group = [min(old, new) if g in (old, new) else g for g in group]
    return group


def test_every_pair_within_the_radius_shares_a_table():
    masks = [m & (1 << 64) - 1 for m in simhash.masks(4)]
    assert len(masks) == 31
    for bits in itertools.combinations(range(0, 64, 3), 4):
        differing = sum(1 << b for b in bits)
        assert any(differing & m == 0 for m in masks)


def test_matches_a_plain_restatement(spark):
    documents = read_table(spark, "/root/testdata/sf0.001", "documents")
    rows = simhash.near_duplicates(documents, 4, 4).orderBy("doc_id").collect()
    prints = [plain_fingerprint(r["text"], 4) for r in rows]
    assert [r["fingerprint"] for r in rows] == [f"{p:016x}" for p in prints]
    groups = plain_groups(prints, 4)
    smallest = {}
    for r, g in zip(rows, groups):
        smallest.setdefault(g, r["doc_id"])
    assert [r["component_id"] for r in rows] == [smallest[g] for g in groups]


@pytest.mark.parametrize("block", [4, 1024])
def test_large_buckets_are_linked_whole(spark, block):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    prints = sorted({base ^ sum(1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 5))) for _ in range(400)})
    frame = spark.createDataFrame([(p,) for p in prints], "__fp long").repartition(5)
    from loamlog.llm.common import connected_components

    found = dict(connected_components(simhash.fingerprint_links(frame, 4, block)).collect())
    groups = plain_groups(prints, 4)
    assert [found.get(p, p) for p in prints] == [prints[g] for g in groups]


def test_nulls_ties_repeats_and_clashing_names(spark):
    long = "word " * 50_000
    rows = [(3, None, "x", "a"), (2, "", "y", None), (2, "", "y", None), (None, long, None, "b"),
            (7, long.upper(), None, "b"), (8, "one two", "z", "c")]
    frame = spark.createDataFrame(rows, DOCS)
    found = simhash.near_duplicates(frame, 4, 4)
    assert sorted(found.columns) == sorted(["doc_id", "text", "lang", "fingerprint", "component_id"])
    groups = {(r["doc_id"], r["component_id"]) for r in found.collect()}
    assert groups == {(3, 2), (2, 2), (None, 7), (7, 7), (8, 8)}
    kept = simhash.first_of_each_group(frame, 4, 4)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 7, 8]


def test_empty_table(spark):
    frame = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(frame, 4, 4).count() == 0
    assert simhash.first_of_each_group(frame, 4, 4).count() == 0


def test_keys_of_all_tables_are_never_broadcast(spark):
    """31 keys a fingerprint, which Spark sizes as the fingerprints alone."""
    prints = spark.range(4000).select(F.xxhash64("id").alias("__fp")).distinct()
    found = simhash.fingerprint_links(prints, 4)
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
