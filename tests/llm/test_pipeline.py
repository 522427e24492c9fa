"""Each stage of the pipeline against a plain version of its rule, on what came before."""

from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from loamlog.llm import quality
from loamlog.llm.common import in_fold, read_table, stored
from tests.llm.test_simhash import plain_fingerprint, plain_groups

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """Rows before the first stage and after each, by id."""
    docs = read_table(spark, DIR, "documents")
    found = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DIR), name)
        found.append(docs.collect())
    return found


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_stages_keep_the_columns(steps):
    for rows in steps[1:-1]:
        assert rows[0].__fields__ == steps[0][0].__fields__
        assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_quality(spark, steps):
    """The kept rows are those that a plain loop over all neighbours votes for."""
    model = quality.fit_sample(
        read_table(spark, DIR, "documents"), read_table(spark, DIR, "labels"), lambda i: ~in_fold(i, 5)
    )
    kept = set()
    for name, text in texts(steps[0]).items():
        near = model.vectors.astype(float) @ model.project([text])[0].astype(float)
        top = np.argsort(near, kind="stable")[-model.neighbours :]
        votes = np.maximum(0, near[top]) ** 2 * model.weights[top]
        if (votes @ model.labels[top] / votes.sum() if votes.sum() else model.share) >= 0.3:
            kept.add(name)
    assert kept == set(texts(steps[1]))
    marks = {r["doc_id"]: r["quality"] for r in read_table(spark, DIR, "labels").collect()}
    gone = [i for i in texts(steps[0]) if i not in kept and i in marks]
    assert gone and all(marks[i] == 0 for i in gone)


def test_line_dedup(steps):
    seen, expected = set(), {}
    for name, text in sorted(texts(steps[1]).items()):
        lines = text.split("\n")
        covered = set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if not any(line.strip(" \t\r") for line in window):
                continue
            if window in seen:
                covered |= {i, i + 1, i + 2}
            seen.add(window)
        expected[name] = "\n".join(x for i, x in enumerate(lines) if i not in covered)
    assert texts(steps[2]) == expected


def test_simhash(steps):
    before = texts(steps[2])
    names = sorted(before)
    groups = plain_groups([plain_fingerprint(before[i], 4) for i in names], 4)
    first = {}
    for name, group in zip(names, groups):
        first.setdefault(group, name)
    assert texts(steps[3]) == {i: before[i] for i in first.values()}


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return "".join(c if ord(c) > 127 or c.isdigit() or c.islower() else " " for c in lower).split(" ")


def test_decontamination(spark, steps):
    windows = set()
    for r in read_table(spark, DIR, "benchmark").collect():
        own = [w for w in words(r["text"]) if w]
        n = min(10, len(own))
        windows |= {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    clean = {}
    for name, text in texts(steps[3]).items():
        own = [w for w in words(text) if w]
        if not any(tuple(own[i : i + n]) in windows for n in sizes for i in range(len(own) - n + 1)):
            clean[name] = text
    assert texts(steps[4]) == clean


def test_packing(steps):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in steps[5]:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    before = texts(steps[4])
    assert set(pieces) == set(before)
    for name, own in pieces.items():
        ids = b"".join(r["ids"] for r in sorted(own, key=lambda r: r["start"]))
        expected = [*tokenizer.encode(before[name], add_special_tokens=False).ids, 0]
        assert np.frombuffer(ids, "<u4").tolist() == expected
    assert all(sum(r["length"] for r in own) <= 1024 for own in sequences.values())


def test_run_gives_the_same_pieces(spark, steps):
    own = contract.queries()["pipeline"](spark, DIR).select("doc_id", "start", "ids").collect()
    ids = defaultdict(bytes)
    for r in sorted(own, key=lambda r: (r["doc_id"], r["start"])):
        ids[r["doc_id"]] += r["ids"]
    expected = defaultdict(bytes)
    for r in sorted(steps[5], key=lambda r: (r["doc_id"], r["start"])):
        expected[r["doc_id"]] += r["ids"]
    assert ids == expected


def test_odd_rows_pass_every_stage(spark):
    schema = read_table(spark, DIR, "documents").schema
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "a b", "en", "s", 3),
            (3, "a b", "en", "s", 3), (None, "word " * 60_000, None, "s", 300_000)]
    for own in (rows, []):
        docs = spark.createDataFrame(own, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, DIR), name)
        if own:
            assert {r["doc_id"] for r in docs.collect()} <= {None, 1, 2, 3}
        else:
            assert docs.count() == 0
