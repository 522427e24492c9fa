"""Periodic runs against all periods tried one by one."""

import os
import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from loamlog.llm import periodic, registry
from loamlog.llm.common import read_table


def brute(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def words_of(text):
    return (text or "").encode().split()


def report(words):
    runs = [(s, e - s, q) for s, e, q in brute(words)]
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
    return (len(runs), *best, milli, "".join(f"{a},{b},{c}\n" for a, b, c in runs), kept)


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, periodic.PRIME, (3, 64)).astype(np.uint64)
    assert (periodic.invert(periodic.transform(rows)) == rows).all()


def test_runs_of_random_words():
    rng = random.Random(11)
    for _ in range(400):
        n, signs = rng.randint(0, 130), rng.choice([1, 2, 2, 3, 5, 30])
        words = [rng.randrange(signs) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 2:
                a = rng.randrange(n)
                p, e = rng.randint(1, max(1, (n - a) // 2)), rng.randint(a, n)
                for i in range(a, e):
                    words[i] = words[a + (i - a) % p]
        assert periodic.find_runs(np.array(words, np.uint64)) == brute(words)


def test_long_texts():
    rng = random.Random(12)
    period = [rng.randrange(1000) for _ in range(2500)]
    words = np.array([5, 6] + period * 3 + period[:100] + [7] * 9000 + [1, 2] * 7, np.uint64)
    assert periodic.find_runs(words) == [(2, 7602, 2500), (7602, 16602, 1), (16602, 16616, 2)]


TEXTS = [
    None, "", " \t\n", "a", "a " * 11, "a " * 12, "a\x0bb\x0c" * 6, "a b c d e f g " * 2, "x " + "a b c d e f " * 2 + "y",
    "é ü " * 12, "a a a a a a b " * 5, "w " * 3000, " ".join(f"w{i % 700}" for i in range(1500)), "a\x00b a\x00b " * 9,
    "a b " * 8 + "c d " * 8, "a b " * 8 + "c d " * 8,
]


@pytest.mark.parametrize("together", [1, 1 << 18])
def test_documents(spark, monkeypatch, together):
    monkeypatch.setattr(periodic, "_BATCH", together)
    rows = [(i if i else None, t, "n", "z") for i, t in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, start string, runs string").coalesce(1)
    found = periodic.collapse_runs(frame)
    assert found.columns == ["doc_id", *periodic.ADDED]
    expected = sorted([(i, *report(words_of(t))) for i, t, _, _ in rows], key=str)
    assert sorted(map(tuple, found.collect()), key=str) == expected
    assert periodic.collapse_runs(frame.limit(0)).collect() == []


def test_planted_periods(spark, tmp_path):
    rng = random.Random(13)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(0, 80)))) for i in range(300)]
    rows += [(None, "a b " * 9), (17, None), (17, "x y z " * 5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert_query(spark, str(tmp_path), rows)


def assert_query(spark, folder, rows):
    expected = []
    for doc_id, text in rows:
        words = words_of(text)
        h, n = (1 if doc_id is None else crc32(str(doc_id).encode())), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        *numbers, runs, kept = report(words)
        expected.append((doc_id, *numbers, sha256(runs.encode()).hexdigest(), sha256(kept.encode()).hexdigest()))
    found = registry.queries()["op12_periodic_runs"](spark, folder).collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert sum(r[1] > 0 for r in expected) > 5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="given tables are absent")
def test_given_documents(spark, tmp_path):
    documents = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    short = [tuple(r) for r in documents.collect() if len((r["text"] or "").split()) < 400]
    spark.createDataFrame(short, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert_query(spark, str(tmp_path), short)
