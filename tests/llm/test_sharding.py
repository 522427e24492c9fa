"""Balance, gapless slots and kept-together copies."""

import zlib
from collections import Counter, defaultdict

import pytest

from loamlog.llm import sharding
from loamlog.llm.common import read_table

DOCS = "doc_id long, text string, shard string, held int"


def placed(frame, rows, shards):
    found = sharding.shard_documents(frame, shards).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in rows)
    texts = defaultdict(Counter)
    for i, t in rows:
        texts[i][zlib.crc32((t or "").encode()), len((t or "").encode()) + 1] += 1
    for r in found:
        texts[r["doc_id"]][r["text_crc32"], r["size"]] -= 1
    assert not any(n for c in texts.values() for n in c.values())
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    spread = defaultdict(set)
    for r in found:
        spread[r["group"]].add(r["shard"])
    return found, spread


def test_given_documents(spark):
    frame = read_table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    _, spread = placed(frame, rows, 16)
    assert max(len(s) for s in spread.values()) == 1  # every group of copies lies in one shard


@pytest.mark.parametrize("hot", [0, 300])
def test_groups_stay_together_within_the_quotas(spark, hot):
    rows = [(i, f"pair {i // 2}") for i in range(300)] + [(1000 + i, f"own {i}") for i in range(hot)]
    rows += [(2000 + i, "everywhere") for i in range(hot)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(7)
    found, spread = placed(frame, rows, 4)
    cut = sum(len(s) > 1 for s in spread.values())
    assert cut <= (20 if not hot else 8)
    if hot:
        own = Counter(r["shard"] for r in found if r["text_crc32"] == zlib.crc32(b"everywhere"))
        assert max(own.values()) >= 150  # far above the even 75


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, None), (None, ""), (1, "a"), (1, "a"), (1, "b"), (2, "ä" * 100_000), (None, "a")]
    found, _ = placed(spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS), rows, 3)
    assert {r["law"] for r in found} == {"rows"}


def test_empty_table(spark):
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).collect() == []
