"""The language model: exact counts and base, seating against enumeration, held-out gain."""

import itertools
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from loamlog.llm import hpylm
from loamlog.llm.common import in_fold, read_table

DIR = "/root/testdata/sf0.001"


def plain(rows):
    """doc -> (held, tokens, known, train tokens, base) by the definition."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    split = []
    for _, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\v\f\r":
            lower = lower.replace(c, " ")
        split.append([w for w in lower.split(" ") if w] + [None])
    counts = Counter(w for s, h in zip(split, held) if not h for w in s)
    total, kinds = sum(counts.values()), len(counts)
    base = lambda w: np.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1)))
    return [
        (h, len(s), sum(counts[w] > 0 for w in s), total, pytest.approx(sum(base(w) for w in s), rel=1e-9))
        for s, h in zip(split, held)
    ]


def scored(frame, **options):
    return hpylm.score_documents(frame, in_fold(F.col("doc_id"), 10), **options).collect()


def facts(r):
    return r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]


@pytest.mark.parametrize("bucket_tokens", [3_000_000, 6_000])
def test_counts_and_base_are_exact_and_the_model_is_better(spark, bucket_tokens):
    frame = read_table(spark, DIR, "documents")
    rows = sorted((r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect())
    found = sorted(scored(frame, bucket_tokens=bucket_tokens), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in found] == [i for i, _ in rows]
    for r, expected in zip(found, plain(rows)):
        assert facts(r) == expected
    held = [r for r in found if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain > 0.3


def test_buckets_change_little(spark):
    frame = read_table(spark, DIR, "documents")
    one = {r["doc_id"]: r for r in scored(frame)}
    many = {r["doc_id"]: r for r in scored(frame.repartition(3), bucket_tokens=6_000)}
    tokens = sum(r["n_tokens"] for r in one.values())
    apart = sum(abs(one[i]["score"] - many[i]["score"]) for i in one) / tokens
    assert apart < 0.02


def test_seating_samples_the_posterior():
    """Mean tables of one word with c customers, against all partitions of the customers."""
    d, theta, p, c = 0.6, 0.8, 0.3, 5

    def partitions(n):
        if n == 0:
            yield []
            return
        for rest in partitions(n - 1):
            for k in range(len(rest)):
                yield [*rest[:k], rest[k] + 1, *rest[k + 1 :]]
            yield [*rest, 1]

    weight, mean = 0.0, 0.0
    for sizes in partitions(c):
        own = np.prod([theta + d * k for k in range(len(sizes))]) * p ** len(sizes)
        own *= np.prod([np.prod([m - d for m in range(1, n)]) for n in sizes])
        weight, mean = weight + own, mean + own * len(sizes)
    houses = 4000
    found, last = hpylm.seat(
        np.full(houses, c), np.arange(houses), np.full(houses, p), d, theta, np.random.default_rng(0), burn_in=25
    )
    assert found.mean() == pytest.approx(mean / weight, rel=0.02)
    assert last.min() >= 1 and last.max() <= c


def test_probabilities_add_up():
    """One bucket: the mass of all known words and the unknown one is 1 in each restaurant."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.zipf(1.5, 3000) if i < 200]
    texts = [" ".join(words[i : i + 20]) for i in range(0, len(words), 20)]
    import pyarrow as pa

    rows = [
        {"block": 0, "docs": len(texts), "held": np.packbits(np.zeros(len(texts), np.uint8)).tobytes(),
         "body": hpylm._squeeze(*arrays)}
        for _, *arrays in hpylm._entries(texts, np.zeros(0, np.uint64), 1, None)
    ]
    own = hpylm._Bucket.of(pa.Table.from_pylist(rows), pairs=False)
    assert own.counts.sum() == sum(len(t.split()) + 1 for t in texts)
    parent = np.full(len(own.words), 1 / (len(own.words) + 1))
    mean, _ = hpylm.seat(own.counts, own.place, parent[own.word], 0.5, 1.0, rng)
    trained = np.bincount(own.place, own.counts)
    tables = np.bincount(own.place, mean)
    kept = np.bincount(own.place, own.counts - 0.5 * mean)
    assert np.allclose((kept + 1.0 + 0.5 * tables) / (1.0 + trained), 1)


def test_odd_rows(spark):
    rows = [(1, None), (1, ""), (None, "a b"), (3, "A  b\x0bc"), (3, "A  b\x0bc"), (4, "x " * 100_000), (35, "é É"), (5, None)]
    frame = spark.createDataFrame([(i, t, "s", 1.0) for i, t in rows], "doc_id long, text string, held string, score double")
    order = lambda rows: sorted(rows, key=lambda r: (str(r[0]), r[2], r[3]))
    found = order([(r["doc_id"], *facts(r)) for r in scored(frame, bucket_tokens=1000)])
    expected = order([(i, *f) for (i, _), f in zip(rows, plain(rows))])
    assert found == expected


def test_empty_and_untrained(spark):
    schema = "doc_id long, text string"
    assert scored(spark.createDataFrame([], schema)) == []
    held = next(i for i in itertools.count() if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = scored(spark.createDataFrame([(held, "a b")], schema))
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)
    assert row["score"] == pytest.approx(row["base_score"]) == pytest.approx(0)


def all_ways(sizes, discount):
    """log weights of 1, 2, ... tables for each number of customers, by the plain recursion."""
    most, found = max(sizes), {}
    ways = np.full(most + 1, -np.inf)
    ways[1] = 0.0
    for n in range(1, most + 1):
        if n in sizes:
            found[n] = ways[1 : n + 1].copy()
        own = ways[1:].copy()
        own[:n] += np.log(n - discount * np.arange(1, n + 1))
        ways[1:] = np.logaddexp(own, ways[:-1])
    return found


@pytest.mark.parametrize("discount", [0.4, 0.7])
def test_production_defaults_reach_the_posterior(discount):
    """Pairs of thousands of customers: the exact mean of the restaurant's tables."""
    theta, counts = 1.0, np.array([4000, 2500, 1200, 300, 80, 20, 6, 2, 1, 1, 1])
    parent = np.array([0.1, 0.03, 0.3, 0.02, 0.1, 0.05, 0.05, 0.01, 0.1, 0.01, 0.01])
    ways, near, upto = all_ways(set(counts.tolist()), discount), 300.0, np.ones(1)
    for c, p in zip(counts.tolist(), parent):  # upto: weights of the tables of the words so far
        own = ways[c] + np.arange(1, c + 1) * np.log(discount * p * near)
        upto = np.convolve(upto, np.append(0, np.exp(own - own.max())))
        upto /= upto.max()
    rising = np.cumsum(np.append(0, np.log((theta / discount + np.arange(len(upto) - 1)) / near)))
    with np.errstate(divide="ignore"):
        weights = np.log(upto) + rising
    weights = np.exp(weights - weights.max())
    mean = (weights * np.arange(len(upto))).sum() / weights.sum()
    houses = 4000
    found, _ = hpylm.seat(
        np.tile(counts, houses), np.repeat(np.arange(houses), len(counts)), np.tile(parent, houses),
        discount, theta, np.random.default_rng(0),
    )
    assert found.sum() / houses == pytest.approx(mean, rel=0.02)


@pytest.mark.parametrize("discount", [0.3, 0.7])
def test_large_pairs_follow_the_exact_weights(discount):
    c = 3 * hpylm._EXACT
    (ways,) = all_ways({c}, discount).values()
    t = np.arange(1, c + 1)
    for a in (0.5, 30.0, 2000.0):
        weights = ways + t * np.log(a * discount)
        weights = np.exp(weights - weights.max())
        x = np.array([a * 1000])
        found, _ = hpylm._Pairs(np.array([c]), np.array([0.001]), x, discount).moments(x)
        assert found[0] == pytest.approx((weights * t).sum() / weights.sum(), rel=0.005)


def test_mass_of_a_context_spread_over_buckets(spark, monkeypatch):
    """P(w | u) over all words, from held-out texts around a word ("zz") that is never trained."""
    rng = np.random.default_rng(3)
    drawn = [f"w{i}" for i in rng.zipf(1.4, 20_000) if i <= 150][:12_000]
    texts = [(f"t{i}", " ".join(drawn[20 * i : 20 * i + 20]), False) for i in range(600)]
    known, u = sorted(set(drawn)), "w1"
    asked = ["zz", f"zz {u}", "zz zz zz", f"zz {u} zz zz"]
    asked += [f"zz {w} zz" for w in known] + [f"zz {u} {w} zz" for w in known]
    texts += [(t, t, True) for t in asked]
    frame = spark.createDataFrame(texts, "doc_id string, text string, held boolean")
    seen, plain_visit = [], hpylm._second_visit
    monkeypatch.setattr(hpylm, "_second_visit", lambda *a: seen.append(a) or plain_visit(*a))
    found = hpylm.score_documents(frame, F.col("held"), bucket_tokens=2000).where("held_out").collect()
    score = {r["doc_id"]: r["score"] for r in found}
    ((entries, answers, totals, buckets),) = seen
    assert buckets > 3
    assert np.uint64(hpylm._hash(u.encode())).astype(np.int64) in totals.hot
    mass = {}
    answers = [r for r in answers.collect() if r["part"] >= 0]
    rows = entries.toArrow()
    for b in range(buckets):
        own = hpylm._Bucket.of(rows.filter(pc.equal(rows.column("bucket"), b)), pairs=False)
        part = (own.words >> np.uint64(8)) % np.uint64(buckets)
        for r in answers:
            if r["bucket"] == b:
                mass |= dict(zip(own.words[part == r["part"]].tolist(), hpylm._expand(r["mass"], "<f4")[0].tolist()))
    parent = {k: float(totals.parent(np.array(m))) for k, m in mass.items()}
    own, end = {w: parent[hpylm._hash(w.encode())] for w in known}, parent[int(hpylm.END)]
    unknown = float(totals.parent(np.zeros(1))[0])
    assert sum(own.values()) + end + unknown == pytest.approx(1, abs=1e-4)
    total = 10 ** (score[f"zz {u} zz zz"] - score["zz zz zz"]) * unknown + 10 ** (score[f"zz {u}"] - score["zz"]) * end
    total += sum(10 ** (score[f"zz {u} {w} zz"] - score[f"zz {w} zz"]) * own[w] for w in known)
    assert total / own[u] == pytest.approx(1, abs=1e-3)


ODD = [None, "", " ", "\t\n", "a", "  A  b\x0bc \x1c d\x85\x0c", "É é\u2003x", " a a a ", "\x00 \x00", "ÀA\r\nb"]


def plain_entries(texts, buckets):
    """bucket -> sorted (context's hash, word's hash, document), by the definition."""
    found = [[] for _ in range(buckets)]
    for doc, text in enumerate(texts):
        words = [hpylm._hash(w) for w in (text or "").encode().lower().split()]
        for u, w in itertools.pairwise([int(hpylm.BEGIN), *words, int(hpylm.END)]):
            found[(u >> 8) % buckets].append((u, w, doc))
    return [sorted(f) for f in found]


@pytest.mark.parametrize("buckets", [1, 3])
def test_entries_of_odd_texts(buckets):
    column = pa.array(["b c", *ODD, " d"], pa.string()).slice(1, len(ODD))
    held = np.arange(len(ODD)) % 3 == 0
    for texts in (ODD, column):
        for flags in (None, held):
            expected = plain_entries(ODD, buckets)
            for b, own, counts, words, steps, last in hpylm._entries(texts, np.zeros(0, np.uint64), buckets, flags):
                found = zip(np.repeat(own, counts).tolist(), words[hpylm._numbers_of(steps, counts)].tolist(), last.tolist())
                if flags is not None:
                    pairs = Counter((u, w) for u, w, _ in expected[b])
                    pairs.subtract((u, w) for u, w, doc in expected[b] if held[doc])
                    expected[b] = sorted((*p, n) for p, n in pairs.items())
                assert list(found) == expected[b]


def test_entries_are_sorted_alike_with_and_without_room_for_one_number():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, m, 2000) for m in (3, 50, 60, 7)]
    found, wide = (hpylm._sorted(columns, most) for most in ([3, 50, 60, 7], [3, 1 << 30, 1 << 30, 7]))
    expected = sorted(zip(*(c.tolist() for c in columns)))
    assert list(zip(*(c.tolist() for c in found))) == list(zip(*(c.tolist() for c in wide))) == expected


def test_entries_take_less_time_than_numbering_the_words_in_python():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"word{i}" for i in rng.zipf(1.2, 400) % 1_000_003) for _ in range(2000)]

    def python():
        split = [t.encode().lower().split() for t in texts]
        numbers = {w: n for n, w in enumerate(set().union(*split))}
        return [numbers[w] for s in split for w in s]

    def seconds(run):
        began = time.process_time()
        run()
        return time.process_time() - began

    plain = min(seconds(python) for _ in range(3))
    held = np.zeros(len(texts), bool)
    for flags in (None, held):
        blocks = lambda: list(hpylm._entries(texts, np.zeros(0, np.uint64), 8, flags))  # noqa: B023, E731
        assert min(seconds(blocks) for _ in range(3)) < plain


def test_every_context_is_counted_wherever_it_stands(spark):
    """Frequent in one task, a little less so in another, which has more words than it holds at once."""
    rare = [" ".join(f"r{1000 * i + j}" for j in range(1000)) + " early" * 60 for i in range(700)]
    texts = [(0, t) for t in rare] + [(1, "early late " * 400)] * 40 + [(1, None)]
    size = sum(len((t or "").encode()) + 6 for _, t in texts)
    buckets = -(-size // (6 * 500_000))
    counts = Counter(u for _, t in texts for u in [None, *(t or "").split()])
    least = counts.total() / (8 * buckets)
    expected = [hpylm._hash(u.encode()) for u, n in counts.items() if n >= least]
    frame = spark.createDataFrame(texts, "part int, text string").repartitionByRange(2, "part").select("text")
    found, n = hpylm._hot_contexts(frame, 500_000)
    assert n == buckets > 1
    assert found.tolist() == expected == [hpylm._hash(b"early")]
