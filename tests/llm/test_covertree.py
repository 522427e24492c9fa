"""Links of vectors against brute force."""

import numpy as np
import pytest

from loamlog.llm import covertree
from loamlog.llm.common import read_table


def brute(rows, cosine):
    """id -> (links, component) for (id, vector, label)."""
    def sound(v):
        return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)

    n = len(rows)
    near = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            (_, a, k), (_, b, m) = rows[i], rows[j]
            if k is None or k != m or not sound(a) or not sound(b) or len(a) != len(b):
                continue
            a, b = np.array(a, float), np.array(b, float)
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                near[i].add(j)
                near[j].add(i)
    group = list(range(n))
    for i in range(n):
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        group[i] = min(ids, default=None)
    return sorted((str(r[0]), len(near[i]), str(group[i])) for i, r in enumerate(rows))


def ours(frame, **options):
    found = covertree.near_vectors(frame, **options).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in found)


@pytest.mark.parametrize("block", [16, 2048])
def test_given_vectors(spark, block):
    frame = read_table(spark, "/root/testdata/sf0.001", "embeddings")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    assert ours(frame, cosine=0.93, block=block) == brute(rows, 0.93)


@pytest.mark.parametrize("seed", range(3))
def test_trees_find_every_pair(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5))
    x = covertree._unit(centres[rng.integers(6, size=300)] + rng.normal(size=(300, 5)) * rng.choice([0.01, 0.2, 1], (300, 1)))
    for y in (None, covertree._unit(x[:40] + 0.1 * rng.normal(size=(40, 5)))):
        found = set(zip(*map(list, covertree.block_links(x, y, 0.93))))
        cos = x @ (x if y is None else y).T
        i, j = np.nonzero(cos >= 0.93)
        assert found == {(a, b) for a, b in zip(i, j) if y is not None or a < b}


def test_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0], 1, "x"), (2, [2.0, 0.0], 1, "x"), (2, [2.0, 0.0], 1, "x"), (None, [1.0, 0.1], 1, "x"),
        (5, [1.0, 0.0], 2, "x"), (6, [1.0, 0.0], None, "x"), (7, None, 1, "x"), (8, [0.0, 0.0], 1, "x"),
        (9, [float("nan"), 1.0], 1, "x"), (10, [None, 1.0], 1, "x"), (11, [float("inf"), 1.0], 1, "x"),
        (12, [], 1, "x"), (13, [1.0, 0.0, 0.0], 1, "x"), (None, [0.0, 1.0], 1, "x"), (15, [1e30, 0.0], 1, "x"),
        (16, [1e-30, 0.0], 1, "x"), (None, None, 1, "x"),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string")
    assert ours(frame, cosine=0.93) == brute([r[:3] for r in rows], 0.93)
    assert covertree.near_vectors(frame.limit(0), 0.93).collect() == []
