"""Shared pieces: scratch tables, text digests, running numbers, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlog.session import release, scratch_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame, written to the shared folder and read back: no lineage, no lost blocks."""
    return scratch_table(frame, label)


def forget(frame: DataFrame) -> None:
    """Delete the files behind a frame made by ``stored`` that nothing reads any more."""
    release(frame)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; null is an empty text."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest(text: Column) -> Column:
    """128 bits that stand for a text; null counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def other_columns(frame: DataFrame, *added: str) -> list[Column]:
    """The frame's columns except those an operator adds: a column of that name is replaced."""
    taken = {name.lower() for name in added}
    return [F.col(f"`{c}`") for c in frame.columns if c.lower() not in taken]


def in_fold(doc_id: Column, folds: int) -> Column:
    """True where crc32 of the id's text is divisible by ``folds``; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def offsets_before(sums: DataFrame, place: str, value: str, name: str, group: str | None = None) -> DataFrame:
    """Sum of ``value`` over smaller places, for a table of one row per place (and group).

    The places are task or bucket numbers, so this table has one row per task, not per
    record; the window over it is the only unpartitioned one.
    """
    from pyspark.sql import Window

    window = Window.partitionBy(*([group] if group else [])).orderBy(place)
    before = F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1))
    return sums.withColumn(name, F.coalesce(before, F.lit(0)).cast("long"))


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Rows and bytes of a batch that a task's Python part holds at a time.
_SLICE_ROWS, _SLICE_BYTES = 2_000, 8 << 20


def _slices(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        pieces = max(1, -(-batch.num_rows // _SLICE_ROWS), -(-batch.nbytes // _SLICE_BYTES))
        rows = max(1, -(-batch.num_rows // pieces))
        yield batch.slice(0, rows)
        for low in range(rows, batch.num_rows, rows):
            yield batch.slice(low, rows)


def give_back(result: pa.Table | None = None) -> pa.Table | None:
    """The result, once memory that a worker has freed is back with the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    return result


def in_slices(batches: Batches) -> Batches:
    """The function over small slices of its batches; freed memory goes back when a task ends.

    Worker processes outlive their tasks, and what one keeps is missing for the next stage.
    """

    def sliced(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from batches(_slices(found))
        finally:
            give_back()

    return sliced


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node on an edge; a component is its smallest node.

    Alternating large-star and small-star rounds: every node links to the smallest node it
    can see until all edges are stars. A logarithmic number of rounds; each is written to the
    shared folder, and a hot node costs one aggregated row plus a join that splits on skew.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    links = edges.select(high.alias("a"), low.alias("b")).where("a <> b").distinct()
    links = stored(links, "links")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(near, "a").where("b > a")
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        near = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(near, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.where("a <> b").unionByName(near.withColumnRenamed("m", "b")).distinct()
        after = stored(small, "links")
        forget(links)
        links = after
        now = links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))
        ).first()
        if now == state:
            break
        state = now
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(centres)
