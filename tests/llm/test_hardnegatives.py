"""Hard negatives against plain integer arithmetic."""

import math

import numpy as np
import pytest

from loamlog.llm import hardnegatives, registry
from loamlog.llm.common import read_table

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, positives=5, negatives=5):
    """Expected rows for (id, vector, label); every id that 100 divides is an anchor."""
    def sound(v):
        return v is not None and all(c is not None and math.isfinite(c) for c in v)

    def whole(c):
        return math.floor(c * 256) if abs(c) < 2.0**40 else int(c) * 256

    def last(i):
        return (i is None, i or 0)

    rows = [(i, [whole(c) for c in v], k) for i, v, k in rows if k is not None and sound(v)]
    out = []
    for n, (i, v, k) in enumerate(rows):
        if i is None or i % 100:
            continue
        scored = [
            (min(max(sum(x * y for x, y in zip(v, w)), -(2**63)), 2**63 - 1), j, m)
            for at, (j, w, m) in enumerate(rows)
            if at != n and len(w) == len(v)
        ]
        scored.sort(key=lambda t: (-t[0], last(t[1])))
        own = [t for t in scored if t[2] == k][:positives]
        for p, pid, _ in own:
            fit = [t for t in scored if t[2] != k and 80 * p <= 100 * t[0] <= 100 * p][:negatives]
            out += [(i, pid, r, t[1], p, t[0]) for r, t in enumerate(fit, 1)]
    return sorted(out, key=str)


def ours(frame, **options):
    import pyspark.sql.functions as F

    found = hardnegatives.mine_negatives(frame, F.col("vec_id") % 100 == 0, **options)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found.columns == columns
    return sorted(map(tuple, found.collect()), key=str)


def test_packed_products_are_exact():
    random = np.random.default_rng(5)
    for size, dims, sign in ((200, 64, 1), (3, 7, 1), (2**20, 5, 1), (2**30, 3, 1), (2**50, 2, 1), (1, 1, 1), (90, 9, -1)):
        a = random.integers(-size, size + 1, (6, dims)).astype(float)
        r = np.minimum(random.integers(-size, size + 1, (17, dims)).astype(float), size if sign > 0 else 0)
        exact = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in r] for p in a]
        exact = np.clip(np.array(exact, object), -(2**63), 2**63 - 1)
        assert (hardnegatives.packed_products(a, r) == exact).all()


@pytest.mark.parametrize("block", [8, 8192])
def test_against_plain_arithmetic(spark, block):
    random = np.random.default_rng(9)
    centres = random.normal(size=(3, 6))
    rows = [
        (i * 10, (centres[i % 3] + random.normal(size=6) * 0.3).round(1).tolist(), int(random.integers(0, 4)))
        for i in range(150)
    ]
    rows += [(300, rows[30][1], rows[30][2])] * 2  # repeated rows
    rows += [(7, rows[0][1], None), (8, None, 1), (11, [1.0, None] * 3, 1), (12, [math.inf] * 6, 1), (13, [math.nan] * 6, 0)]
    rows += [(None, rows[10][1], 2), (None, rows[10][1], rows[10][2]), (900, [0.0] * 6, 1), (14, [0.0] * 6, 2), (15, [0.0] * 6, 1)]
    rows += [(100, [1.0, 2.0], 1), (16, [1.0, 2.0], 1), (17, [1.0, 1.9], 2), (200, [], 0), (18, [], 0), (19, [], 3)]
    rows += [(500, [1e300, 1.0, 5.0], 1), (20, [-1e300, 1.0, 5.0], 1), (21, [1e300, 1.0, 5.0], 1), (22, [1e300, 0.0, 5.0], 2)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert ours(frame, block=block, most=max(4, block // 2)) == brute(rows)


def test_same_vector_many_times_and_clashing_columns(spark):
    rows = [(i, [0.5, 0.25], i % 2) for i in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA)
    expected = brute(rows)
    assert ours(frame, block=32, most=2) == expected
    for name in ("row", "pair", "positive_score", "rank", "x", "side"):
        frame = frame.selectExpr("*", f"'z' AS {name}")
    assert ours(frame) == expected


def test_no_rows_no_anchors(spark):
    assert ours(spark.createDataFrame([], SCHEMA)) == []
    assert ours(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], SCHEMA)) == []


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="given tables are absent")
def test_query_on_given_vectors(spark):
    rows = read_table(spark, "/root/testdata/sf0.001", "embeddings").select("vec_id", "embedding", "label").collect()
    moved = [(i, v, (k + 1) % 10 if k is not None and i is not None and i % 7 == 0 else k) for i, v, k in rows]
    found = registry.queries()["op11_hard_negatives"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, found.collect()), key=str) == brute(moved)
