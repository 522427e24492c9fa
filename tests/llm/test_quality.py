"""Nearest-neighbour quality votes: held-out accuracy, brute force, odd rows."""

import numpy as np
import pytest

from loamlog.llm import quality, registry
from loamlog.llm.common import read_table

DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = registry.queries()["op2_quality"](spark, DIR).where("held_out")
    marks = read_table(spark, DIR, "labels").groupBy("doc_id").agg({"quality": "max"})
    pairs = [(r["predicted"], r[-1], r["score"]) for r in rows.join(marks, "doc_id").collect()]
    right = sum(p == y for p, y, _ in pairs) / len(pairs)
    good = [s for _, y, s in pairs if y == 1]
    bad = [s for _, y, s in pairs if y == 0]
    ranked = np.mean([[g > b for b in bad] for g in good])
    assert len(bad) > 50 and right > 0.97 and ranked > 0.98


def small_model(**options):
    texts = [f"plain words about thing {i} and more of it" for i in range(40)]
    texts += [f"JUNK!! LINK {i} | BUY | CLICK!!" for i in range(40)]
    labels = np.array([1] * 40 + [0] * 40)
    return texts, labels, quality.fit(texts, labels, {1: 40, 0: 40}, **options)


def test_votes_equal_a_plain_loop():
    texts, labels, model = small_model(neighbours=5)
    asked = ["words about junk", "BUY thing", "CLICK!! | LINK", *texts[::9]]
    vectors = model.project(asked).astype(float)
    for vector, score in zip(vectors, model.score(asked)):
        near = model.vectors.astype(float) @ vector
        top = np.argsort(near)[-5:]
        votes = np.maximum(0, near[top]) ** 2
        assert score == pytest.approx(votes @ labels[top] / votes.sum(), abs=2e-2)


def test_odd_rows(spark):
    _, _, model = small_model()
    rows = [(1, None, "x"), (1, "", "x"), (None, "plain words about it", "x"), (2, "BUY!! | CLICK!! | LINK", "x"),
            (2, "BUY!! | CLICK!! | LINK", "x"), (3, "plain words " * 100_000, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string")
    found = quality.score_documents(frame, model).collect()
    scores = [r["score"] for r in found]
    assert len(found) == 6 and scores[0] == scores[1] == model.share
    assert scores[2] > 0.9 and scores[3] == scores[4] < 0.1 and scores[5] > 0.9
    assert quality.score_documents(frame.limit(0), model).collect() == []


def test_without_labels(spark):
    frame = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (1, None), (1, 7)], "doc_id long, quality int")
    model = quality.fit_sample(frame, labels)
    assert [r["score"] for r in quality.score_documents(frame, model).collect()] == [0.5, 0.5]


def test_one_class_and_repeated_labels(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, "c d"), (2, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 1)], "doc_id long, quality int")
    model = quality.fit_sample(frame, labels)
    assert {r["score"] for r in quality.score_documents(frame, model).collect()} == {1.0}
