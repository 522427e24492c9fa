"""Hard negatives by Kronecker-packed integer products.

Components become ``floor(256 * x)``. The components of several candidates, made non-negative by a
bias, are laid side by side in separate fields of one wide integer; an anchor's component, biased
too, multiplies all of them at once, and the sum over the dimensions holds one exact inner product
per field. Integers below 2**53 are exact as doubles, so the products are matrix products; the
fields are as wide as the largest sum that the two blocks at hand could give. Blocks whose values
leave no room for one field use integers of any width.

The anchors are a stated query set against all rows, in blocks: anchors and rows are dealt into
blocks of bounded size, and each pair of blocks is one group. Positives come from rows of the
anchor's label, so blocks are compared within buckets of labels there; negatives from all other
rows. A group returns at most a few rows per anchor, which windows over the anchor merge. Within
both steps every pair that counts is scored.

Rows with a null label, a null vector, or any null or non-finite component take no part. Vectors
are compared with those of the same length; empty ones score zero. Ties go to the smaller id, null
ids last, then to the row that was numbered first. Repeated rows are rows of their own: each is an
anchor and a candidate for the others. Scores that a long cannot hold stand at its ends. An empty
table, or one without anchors, gives no rows; other columns of the table are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamlog.llm.common import stored

SCALE = 256
#: Rows and anchors in one block.
BLOCK = 8192
ANCHORS = 4096
#: Scores held at once.
_CHUNK = 1 << 21
_ENDS = np.iinfo(np.int64)


def whole_components(flat: np.ndarray) -> np.ndarray:
    """``floor(256 * x)`` as doubles, or as Python's integers where doubles would not do."""
    x = np.asarray(flat, np.float64)
    if not len(x) or np.abs(x).max() < 2.0**40:
        return np.floor(x * SCALE)
    return np.array([int(np.floor(v * SCALE)) if abs(v) < 2.0**40 else int(v) * SCALE for v in x.tolist()], object)


def packed_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of all anchors with all rows, as longs; whole numbers in, dimension last."""
    (n, d), m = anchors.shape, len(rows)
    if not d or not n or not m:
        return np.zeros((n, m), np.int64)
    bias_a, bias_r = int(np.abs(anchors).max()), int(np.abs(rows).max())
    width = (d * (2 * bias_a) * (2 * bias_r)).bit_length()
    fields = 53 // width if width else 53
    if not fields or anchors.dtype == object or rows.dtype == object:
        return _any_width(anchors, rows, bias_a, bias_r, width)
    fields = min(fields, m)
    lines = -(-m // fields)
    biased = np.zeros((lines * fields, d))
    biased[:m] = rows + bias_r
    packed = np.zeros((lines, d))
    for f in range(fields):
        packed += biased[f * lines : (f + 1) * lines] * 2.0 ** (width * f)
    sums = ((anchors + bias_a) @ packed.T).astype(np.int64)
    taken = bias_r * anchors.sum(axis=1).astype(np.int64)[:, None] + d * bias_a * bias_r
    found = np.empty((n, lines * fields), np.int64)
    for f in range(fields):
        found[:, f * lines : (f + 1) * lines] = (sums >> (width * f)) & ((1 << width) - 1)
    found = found[:, :m] - taken
    return found - bias_a * rows.sum(axis=1).astype(np.int64)[None, :]


def _any_width(anchors: np.ndarray, rows: np.ndarray, bias_a: int, bias_r: int, width: int) -> np.ndarray:
    """The same with eight fields in an integer of any width."""
    (n, d), m = anchors.shape, len(rows)
    a = [[int(v) + bias_a for v in line] for line in anchors.tolist()]
    r = [[int(v) + bias_r for v in line] for line in rows.tolist()]
    sum_a, sum_r = [sum(line) for line in a], [sum(line) for line in r]
    mask = (1 << width) - 1
    found = np.empty((n, m), np.int64)
    for low in range(0, m, 8):
        group = r[low : low + 8]
        packed = [sum(line[k] << (width * f) for f, line in enumerate(group)) for k in range(d)]
        for i in range(n):
            total = sum(x * y for x, y in zip(a[i], packed))
            for f in range(len(group)):
                score = (total >> (width * f)) & mask
                score -= bias_r * sum_a[i] + bias_a * sum_r[low + f] - d * bias_a * bias_r
                found[i, low + f] = min(max(score, _ENDS.min), _ENDS.max)
    return found


def _first_of_each(i: np.ndarray, count: int) -> np.ndarray:
    """Positions of the first ``count`` entries of every run of equal values."""
    if not len(i):
        return np.zeros(0, np.int64)
    begins = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    rank = np.arange(len(i)) - np.repeat(begins, np.diff(np.r_[begins, len(i)]))
    return np.flatnonzero(rank < count)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    flat = whole_components(rows.flatten().to_numpy(zero_copy_only=False))
    return flat.reshape(len(rows), -1) if len(flat) else np.zeros((len(rows), 0))


def _dealt(anchors: DataFrame, rows: DataFrame, keys: list[str], carried: list[str], block: int, most: int) -> DataFrame:
    """Both sides, one copy per pair of blocks with equal keys: ``pair`` columns, ``side`` 0 or 1."""
    na = anchors.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("na"))
    nr = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("nr"))
    grid = stored(na.join(nr, keys), "grid")
    place = F.pmod(F.xxhash64("row"), F.col("na")).cast("int")
    left = anchors.join(grid, keys).withColumns(
        {"a": place, "r": F.explode(F.sequence(F.lit(0), F.col("nr") - 1)), "side": F.lit(0)}
    )
    place = F.pmod(F.xxhash64("row"), F.col("nr")).cast("int")
    right = rows.join(grid, keys).withColumns(
        {"r": place, "a": F.explode(F.sequence(F.lit(0), F.col("na") - 1)), "side": F.lit(1)}
    )
    for name in carried:
        right = right.withColumn(name, F.lit(None).cast(anchors.schema[name].dataType))
    columns = [*keys, "a", "r", "side", "row", "id", "label", "x", *carried]
    return left.select(*columns).unionByName(right.select(*columns))


def _sides(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Anchors, and rows by id with null ids last, then by number."""
    side = table.column("side").to_numpy()
    rows = table.take(pa.array(np.flatnonzero(side == 1))).sort_by([("id", "ascending"), ("row", "ascending")])
    return table.take(pa.array(np.flatnonzero(side == 0))), rows


def _chunks(anchors: pa.Table, rows: pa.Table):
    """Positions of some anchors at a time, with their scores and whether the labels are equal."""
    n, m = anchors.num_rows, rows.num_rows
    if not n or not m:
        return
    a, r = _matrix(anchors.column("x")), _matrix(rows.column("x"))
    numbers = pa.concat_arrays(
        [anchors.column("label").combine_chunks(), rows.column("label").combine_chunks()]
    ).dictionary_encode()
    numbers = numbers.indices.to_numpy()
    step = max(1, _CHUNK // m)
    for low in range(0, n, step):
        at = np.arange(low, min(n, low + step))
        yield at, packed_products(a[at], r), numbers[at][:, None] == numbers[n:][None, :]


def mine_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    least_percent: int = 80,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    block: int = BLOCK,
    most: int = ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` says over the table's columns which rows are anchors. A negative scores at most
    as much as the positive and at least ``least_percent`` of it.
    """
    x = F.col(vector)
    sound = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.where(sound & F.col(label).isNotNull() & x.isNotNull()).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(vec_id).alias("id"),
        F.col(label).alias("label"),
        x.alias("x"),
        F.size(x).alias("dim"),
        F.coalesce(anchor, F.lit(False)).alias("asks"),
    )
    rows = stored(rows, "vectors")
    total = rows.count()
    buckets = max(1, -(-total // block))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(buckets)).cast("int"))
    anchors = rows.where("asks")
    id_type = rows.schema["id"].dataType.simpleString()

    def best_positives(table: pa.Table) -> pa.Table:
        ours, theirs = _sides(table)
        own, others = ours.column("row").to_numpy(), theirs.column("row").to_numpy()
        ids = theirs.column("id")
        taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at, scores, same in _chunks(ours, theirs):
            i, j = np.nonzero(same & (own[at][:, None] != others[None, :]))
            s = scores[i, j]
            order = np.lexsort((j, ~s, i))
            first = order[_first_of_each(i[order], positives)]
            taken.append((at[i[first]], j[first], s[first]))
        i, j, s = (np.concatenate(c) for c in zip(*taken)) if taken else (np.zeros(0, np.int64),) * 3
        return pa.table(
            {"anchor": own[i], "positive": others[j], "positive_id": ids.take(pa.array(j)), "positive_score": s}
        )

    dealt = _dealt(anchors, rows, ["dim", "bucket"], [], block, most)
    found = dealt.groupBy("dim", "bucket", "a", "r").applyInArrow(
        best_positives, f"anchor long, positive long, positive_id {id_type}, positive_score long"
    )
    order = [F.desc("positive_score"), F.asc_nulls_last("positive_id"), F.asc("positive")]
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(*order)))
    found = found.where(F.col("place") <= positives)
    asked = found.groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("pairs")
    )
    asked = stored(asked, "positives")
    scored = anchors.join(asked, F.col("row") == F.col("anchor")).withColumn("scores", F.col("pairs.positive_score"))

    def best_negatives(table: pa.Table) -> pa.Table:
        ours, theirs = _sides(table)
        own, others = ours.column("row").to_numpy(), theirs.column("row").to_numpy()
        ids = theirs.column("id")
        limits = ours.column("scores").to_pylist()
        upper = np.full((len(limits), positives), -1, np.int64)  # nothing lies between a share of a negative score and itself
        for k, line in enumerate(limits):
            upper[k, : len(line)] = line
        # The least whole score of at least that share, by hundreds so that no long overflows.
        lower = upper // 100 * least_percent - (-(upper % 100 * least_percent) // 100)
        taken: list[tuple[np.ndarray, ...]] = []
        for at, scores, same in _chunks(ours, theirs):
            asks = upper[at] >= 0
            floor = np.where(asks, lower[at], _ENDS.max).min(axis=1)
            i, j = np.nonzero(~same & (scores >= floor[:, None]) & (scores <= upper[at].max(axis=1)[:, None]))
            s = scores[i, j]
            order = np.lexsort((j, ~s, i))
            i, j, s = at[i[order]], j[order], s[order]
            for k in range(positives):
                fits = np.flatnonzero((upper[i, k] >= 0) & (s <= upper[i, k]) & (s >= lower[i, k]))
                first = fits[_first_of_each(i[fits], negatives)]
                taken.append((i[first], np.full(len(first), k + 1), j[first], s[first]))
        i, k, j, s = (np.concatenate(c) for c in zip(*taken)) if taken else (np.zeros(0, np.int64),) * 4
        return pa.table(
            {
                "anchor": own[i],
                "place": k.astype(np.int32),
                "negative": others[j],
                "negative_id": ids.take(pa.array(j)),
                "negative_score": s,
            }
        )

    everyone = rows.withColumn("bucket", F.lit(0))
    scored = scored.withColumn("bucket", F.lit(0))
    dealt = _dealt(scored, everyone, ["dim", "bucket"], ["scores"], block, most)
    found = dealt.groupBy("dim", "bucket", "a", "r").applyInArrow(
        best_negatives, f"anchor long, place int, negative long, negative_id {id_type}, negative_score long"
    )
    order = [F.desc("negative_score"), F.asc_nulls_last("negative_id"), F.asc("negative")]
    window = Window.partitionBy("anchor", "place").orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= negatives)
    pairs = scored.select(F.col("id").alias("anchor_id"), "anchor", F.explode("pairs").alias("p"))
    pairs = pairs.select("anchor_id", "anchor", "p.*")
    return found.join(pairs, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
