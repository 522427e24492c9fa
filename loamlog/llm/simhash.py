"""SimHash near-duplicates, linked exactly through covering masks.

The fingerprint of a text has 64 bits, the majority over the hashes of its word shingles.
Fingerprints within ``radius`` bits are found without a miss: each bit position is given a
non-zero vector of radius + 1 bits, and mask v holds the positions whose vector has an odd
overlap with v. Any ``radius`` differing positions leave some v that overlaps none of them
oddly, so under mask v the two fingerprints are equal: 2^(radius+1) - 1 tables are enough.

Copies are merged first: tables hold distinct fingerprints. A table key with many of them is
dealt out as pairs of blocks, so a task holds two blocks at a time; within a block only the
edges of a spanning forest leave, never all pairs.

Null and empty texts have no words and the fingerprint zero. Rows are judged by their text;
repeated rows keep their rows, a null id is never the smallest unless there is no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlog.llm.common import connected_components, forget, in_slices, other_columns, stored

BITS = 64
SEED = 42
#: Distinct fingerprints under one key that one task compares at a time.
BLOCK = 1024
_SLAB = 1 << 15


def fingerprint(text: str | None, words: int) -> int:
    """Majority bits over the shingles of a text, as an unsigned number."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        joined, ends, at = b" ".join(found), [], -1
        for word in found:
            at += len(word) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends[: len(found) - words])]
        view = memoryview(joined)
        shingles = [view[s:e] for s, e in zip(starts, ends[words - 1 :])]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for low in range(0, len(shingles), _SLAB):
        hashes = np.array([digest(s, SEED) for s in shingles[low : low + _SLAB]], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * ones > len(shingles)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, words: int, text: str = "text") -> DataFrame:
    """The documents' columns and ``__fp``, the fingerprint as a signed long."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            prints = [fingerprint(t.as_py(), words) for t in batch.column("__text")]
            names = [n for n in batch.schema.names if n != "__text"]
            columns = [batch.column(n) for n in names]
            signed = np.array(prints, np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(signed)], [*names, "__fp"])

    schema = documents.withColumn("__fp", F.lit(0).cast("long")).schema
    return documents.withColumn("__text", F.col(text).cast("string")).mapInArrow(in_slices(batches), schema)


def masks(radius: int) -> list[int]:
    """The masks of the tables as signed longs."""
    vectors = 2 ** (radius + 1) - 1
    found = []
    for v in range(1, vectors + 1):
        mask = sum(((i % vectors + 1) & v).bit_count() % 2 << i for i in range(BITS))
        found.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return found


def _forest(prints: np.ndarray, runs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and their roots: links within ``radius`` bits between members of one run."""
    n = len(prints)
    root = np.arange(n)
    ends = np.append(np.flatnonzero(np.diff(runs)) + 1, n)
    starts = np.append(0, ends[:-1])
    left = np.repeat(ends, ends - starts) - np.arange(n)  # members from here to the run's end
    at = np.arange(n)
    for step in range(1, int(left.max(initial=1))):
        at = at[left[at] > step]
        near = np.bitwise_count((prints[at] ^ prints[at + step]).view(np.uint64)) <= radius
        a, b = at[near], at[near] + step
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := root[root], root):
                root = up
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def fingerprint_links(prints: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """``a, b``: edges that connect exactly the distinct fingerprints ``__fp`` linked in chains."""
    tables = F.array(
        *[
            F.struct(F.lit(t).alias("t"), F.col("__fp").bitwiseAND(F.lit(m)).alias("k"))
            for t, m in enumerate(masks(radius))
        ]
    )
    keyed = prints.select("__fp", F.inline(tables))
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64(F.col("__fp")), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, F.col("own")).alias("p"), F.greatest(o, F.col("own")).alias("q")),
    )
    sizes = sizes.withColumn("blocks", F.when(F.col("n") <= 2 * block, 1).otherwise(blocks))
    dealt = (
        # Spark takes the keys for as few as the fingerprints they come from, and would broadcast them.
        keyed.join(sizes.hint("merge"), ["t", "k"])
        .withColumn("own", own)
        .select("t", "k", "__fp", F.inline_outer(pairs))
        .withColumn("run", F.xxhash64("t", "k", "p", "q"))
        .select("run", "t", "k", "p", "q", "__fp")
    )
    order = ["run", "t", "k", "p", "q"]
    dealt = dealt.repartition(*order).sortWithinPartitions(*order)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(part: pa.Table) -> pa.RecordBatch:
            fp = part.column("__fp").to_numpy()
            keys = np.stack([part.column(c).to_numpy().astype(np.int64) for c in order])
            runs = np.append(0, np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            at, up = _forest(fp, runs, radius)
            return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[up])], ["a", "b"])

        held: pa.Table | None = None
        for batch in found:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            run = held.column("run").to_numpy()
            last = int(np.searchsorted(run, run[-1]))  # the last run may go on in the next batch
            if last:
                yield edges(held.slice(0, last))
                held = held.slice(last)
        if held is not None and len(held):
            yield edges(held)

    return dealt.mapInArrow(batches, "a long, b long").distinct()


def _grouped(
    documents: DataFrame, words: int, radius: int, doc_id: str, text: str, columns: list[str] | None
) -> tuple[DataFrame, DataFrame]:
    """Stored rows with ``__row, __fp``, and per group and fingerprint its first row.

    The rows are stored because they are read three times and their numbers must not change.
    First is the smallest id, a null id last, and of equal ids the row read first.
    """
    rows = fingerprints(documents, words, text)
    rows = rows.select(*(columns or documents.columns), "__fp", F.monotonically_increasing_id().alias("__row"))
    rows = stored(rows, "prints")
    place = F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("id"), "__row")
    classes = rows.groupBy("__fp").agg(F.min(place).alias("__first"))
    components = connected_components(fingerprint_links(rows.select("__fp").distinct(), radius))
    components = components.select(F.col("node").alias("__fp"), F.col("component").alias("__other"))
    # A fingerprint without links is a group of its own.
    classes = classes.join(components, "__fp", "left")
    return rows, classes.select("__fp", "__first", F.coalesce("__other", "__fp").alias("__group"))


def near_duplicates(
    documents: DataFrame,
    words: int,
    radius: int,
    doc_id: str = "doc_id",
    text: str = "text",
    columns: list[str] | None = None,
) -> DataFrame:
    """The documents (or some ``columns``) with ``fingerprint`` and ``component_id``.

    ``component_id`` is the smallest id reachable through links, the document's own included.
    """
    rows, classes = _grouped(documents, words, radius, doc_id, text, columns)
    first = classes.groupBy("__group").agg(F.min("__first").alias("__smallest"))
    named = classes.join(first, "__group").select("__fp", F.col("__smallest.id").alias("__smallest"))
    # A table, so that the join below has plain sides and can split a fingerprint of many rows.
    return rows.join(stored(named, "named"), "__fp").select(
        *other_columns(rows, "fingerprint", "component_id", "__fp", "__row"),
        F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"),
        F.col("__smallest").alias("component_id"),
    )


def first_of_each_group(
    documents: DataFrame, words: int, radius: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One document of each group: the one with the smallest id; a null id only if all are."""
    rows, classes = _grouped(documents, words, radius, doc_id, text, None)
    kept = classes.groupBy("__group").agg(F.min("__first").alias("__first"))
    kept = kept.select(F.col("__first.__row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(*documents.columns)
