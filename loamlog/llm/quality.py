"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are the words of a text (A-Z in lower case, their edges' punctuation apart) and the
shapes of its tokens: runs of lower-case letters, capitals, digits and other signs. Terms are
hashed into ``terms`` columns, counts are damped (1 + log) and weighted by inverse document
frequency, rows get length 1. A truncated singular value decomposition of a bounded sample of
labelled rows gives ``rank`` latent directions. The sample's vectors and labels are broadcast
(``sample * rank`` floats, a fixed bound); every document's vector is multiplied with all of
them, block by block, and the labels of its ``neighbours`` most similar ones vote, weighted
by the similarity. The sample holds at most ``sample`` rows, half of them (or all there are)
from each class, taken by a hash of the id; a vote counts by its class's share among the
labelled rows, so the scores stay calibrated.

A null or empty text has the zero vector, no similarity to anyone, and gets the share of
label 1; so does every text if there is no usable label. Labels that are neither 0 nor 1 and
rows without a text or id are not learned from. Rows are scored by their text alone, so
repeated rows and null ids each keep their row. Columns named like added ones are replaced.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlog.llm.common import in_slices, other_columns

TERMS = 1 << 13
RANK = 48
SAMPLE = 4096
NEIGHBOURS = 15
BLOCK = 512

def _byte_class(c: int) -> int:
    """Letters and digits by kind, bytes of other scripts together, signs as they are."""
    if 97 <= c < 123:
        return ord("a")
    if 65 <= c < 91:
        return ord("A")
    if 48 <= c < 58:
        return ord("0")
    return ord("w") if c >= 128 else c


_SHAPE = bytes(_byte_class(c) for c in range(256))
_WORD = bytes(c + 32 if 65 <= c < 91 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SAME_STEPS = (0.02, 0.1, 0.3)
_SAME_COLUMNS = 16
_RUNS = re.compile(rb"([aA0w])\1+")


def term_counts(text: str | None, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and counts of a text: words in the first half, token shapes in the second.

    How often a token equals the one before is a term too, by steps of its share, spread over
    several columns as it describes the whole text and not one of its words.
    """
    raw, half = (text or "").encode(), terms // 2
    words = Counter(raw.translate(_WORD).split())
    shapes = Counter(_RUNS.sub(rb"\1", raw.translate(_SHAPE)).split())
    tokens = raw.split()
    same = sum(map(eq, tokens, islice(tokens, 1, None)))
    if step := bisect_right(_SAME_STEPS, same / max(1, len(tokens))):
        shapes.update({b"same %d %d" % (step, i): len(tokens) for i in range(_SAME_COLUMNS)})
    columns = [zlib.crc32(w) % half for w in words] + [half + zlib.crc32(s) % half for s in shapes]
    found, place = np.unique(np.array(columns, np.int64), return_inverse=True)
    return found, np.bincount(place, [*words.values(), *shapes.values()], len(found))


@dataclass(frozen=True)
class Model:
    """What a task needs: projection (terms x rank), the sample's vectors, labels and weights."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    share: float
    neighbours: int

    def project(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.projection.shape[1]), np.float32)
        for i, text in enumerate(texts):
            columns, counts = term_counts(text, len(self.projection))
            if len(columns):
                out[i] = (1 + np.log(counts)).astype(np.float32) @ self.projection[columns]
        return _rows_of_length_one(out)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), self.share)
        vectors = self.project(texts)
        k = min(self.neighbours, len(self.labels))
        out = np.empty(len(texts))
        for low in range(0, len(texts), BLOCK):
            near = vectors[low : low + BLOCK] @ self.vectors.T
            top = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k :]
            votes = np.maximum(0, np.take_along_axis(near, top, axis=1)).astype(np.float64) ** 2
            votes *= self.weights[top]
            total = votes.sum(axis=1)
            for_one = (votes * self.labels[top]).sum(axis=1)
            out[low : low + BLOCK] = np.where(total > 0, for_one / np.where(total > 0, total, 1), self.share)
        return np.clip(out, 0, 1)


def _rows_of_length_one(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def fit(texts: list[str], labels: np.ndarray, totals: dict[int, int], terms=TERMS, rank=RANK, neighbours=NEIGHBOURS) -> Model:
    """The latent directions of the sample, by subspace iteration from a fixed start."""
    share = totals.get(1, 0) / sum(totals.values()) if totals else 0.5
    if not texts:
        empty = np.zeros((0, 1), np.float32)
        return Model(np.zeros((terms, 1), np.float32), empty, np.zeros(0), np.zeros(0), share, neighbours)
    # One dense matrix, changed in place: sample * terms * 4 bytes are all the driver needs.
    x, holding = np.zeros((len(texts), terms), np.float32), np.zeros(terms)
    for i, text in enumerate(texts):
        columns, counts = term_counts(text, terms)
        x[i, columns] = 1 + np.log(counts)
        holding[columns] += 1
    idf = (np.log((1 + len(x)) / (1 + holding)) + 1).astype(np.float32)
    x *= idf
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    x /= np.where(length > 0, length, 1)[:, None].astype(np.float32)
    rank = min(rank, len(x), terms)
    basis = np.random.default_rng(0).normal(size=(terms, rank + 8)).astype(np.float32)
    for _ in range(5):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    directions = (basis @ turn.T)[:, :rank]
    projection = (idf[:, None] * directions).astype(np.float32)
    vectors = _rows_of_length_one(x @ directions).astype(np.float32)
    taken = Counter(labels.tolist())
    weights = np.array([totals[v] / taken[v] for v in labels.tolist()], float)
    return Model(projection, vectors, labels.astype(float), weights / weights.max(), share, neighbours)


def fit_sample(
    documents: DataFrame,
    labels: DataFrame,
    usable=None,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE,
) -> Model:
    """A model from at most ``sample`` labelled rows whose id fulfils ``usable`` (a column)."""
    marks = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    marks = marks.where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    if usable is not None:
        marks = marks.where(usable(F.col("id")))
    # A row labelled twice counts once, the smaller label holds.
    marks = marks.groupBy("id").agg(F.min("label").alias("label"))
    totals = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("id"), F.col("id")]
    least = min([sample // 2, *totals.values()]) if len(totals) > 1 else 0
    parts = [
        marks.where(F.col("label") == v).orderBy(*order).limit(min(n, sample - min(least, sample // 2)))
        for v, n in totals.items()
    ]
    texts, found = [], []
    if parts:
        chosen = parts[0]
        for part in parts[1:]:
            chosen = chosen.unionByName(part)
        rows = (
            documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
            .where("text is not null")
            .join(F.broadcast(chosen), "id")  # at most ``sample`` rows
            .orderBy("id", "text")
            .limit(sample)
        )
        for row in rows.toLocalIterator():
            texts.append(row["text"])
            found.append(row["label"])
    return fit(texts, np.array(found, int), totals)


def score_documents(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with ``score``, the weighted vote for label 1."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    frame = documents.select(*other_columns(documents, "score"), F.col(text).cast("string").alias("__text"))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            scores = shared.value.score(batch.column("__text").to_pylist())
            at = batch.schema.get_field_index("__text")
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], [*names, "score"])

    schema = frame.drop("__text").withColumn("score", F.lit(0.0)).schema
    return frame.mapInArrow(in_slices(batches), schema)
