"""Work over a total order without ever sorting into one partition."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamlog.session import scratch_table

# monotonically_increasing_id keeps the partition above bit 33 and the row below it.
_ROW_BITS = 33
_PLACE, _CHUNK = "_place", "_chunk"


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumn(_PLACE, F.monotonically_increasing_id())


def _chunk() -> Column:
    return F.shiftrightunsigned(F.col(_PLACE), _ROW_BITS)


def _position() -> Column:
    return F.col(_PLACE).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))


def _before_chunk(placed: DataFrame, amount: Column) -> DataFrame:
    """What all earlier partitions add up to: one row per partition, so small by construction."""
    earlier = Window.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.groupBy(_chunk().alias(_CHUNK))
        .agg(amount.alias("_amount"))
        .select(_CHUNK, F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).alias("_before"))
    )


def ordered(df: DataFrame, order_by: Sequence[Column]) -> DataFrame:
    """Range-partitioned, sorted and cut from its lineage.

    The sampled range bounds differ between two runs of one plan, so the layout is
    written down, places included, before anything depends on it. ``order_by`` must be a total order,
    which also lets a hot value spread over several ranges.
    """
    laid_out = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    return scratch_table(_placed(laid_out), "ordered")


def number_in_place(placed: DataFrame, name: str = "id", start: int = 1) -> DataFrame:
    """Dense numbers in the current partition and row order.

    ``placed`` must come from ``ordered``.
    """
    offsets = _before_chunk(placed, F.count(F.lit(1)))
    return (
        placed.withColumn(_CHUNK, _chunk())
        .join(F.broadcast(offsets), _CHUNK)
        .withColumn(name, (F.col("_before") + _position() + F.lit(start)).cast("long"))
        .drop(_CHUNK, _PLACE, "_before")
    )


def number_by_source(
    rows: DataFrame, source: Sequence[str], place: Sequence[Column], name: str = "id", start: int = 1
) -> DataFrame:
    """Dense numbers along (source, place).

    A row's number is its place among the rows of its source, plus all rows of earlier sources: a
    prefix sum over one row per source. A source is what one task read, so no group is larger.
    ``source`` columns must not be null.
    """
    earlier = Window.orderBy(*source).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*source)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*source, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy(*source).orderBy(*place))
    return (
        rows.withColumn("_inside", inside)
        .join(F.broadcast(offsets), list(source))
        .withColumn(name, (F.col("_before") + F.col("_inside") + F.lit(start - 1)).cast("long"))
        .drop("_before", "_inside", *source)
    )


def assign_ids(
    df: DataFrame, order_by: Sequence[Column], name: str = "id", start: int = 1
) -> DataFrame:
    """Dense increasing numbers along a total order."""
    return number_in_place(ordered(df, order_by), name, start)


def running_total(
    df: DataFrame, order_by: Sequence[Column], weight: str, name: str = "running"
) -> DataFrame:
    """Inclusive prefix sums of ``weight`` along a total order."""
    placed = ordered(df, order_by)
    offsets = _before_chunk(placed, F.sum(weight))
    so_far = (
        Window.partitionBy(_CHUNK)
        .orderBy(_PLACE)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        placed.withColumn(_CHUNK, _chunk())
        .withColumn("_inside", F.sum(weight).over(so_far))
        .join(F.broadcast(offsets), _CHUNK)
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop(_CHUNK, _PLACE, "_before", "_inside")
    )


def nth_bucket(counts: DataFrame, n: int, descending: bool = False) -> tuple[Any, int]:
    """The bucket holding the n-th row in bucket order, and the rows in front of it.

    The bucket is None when there are fewer rows, which are all in front then.
    ``counts`` has columns ``bucket`` and ``n``, one row per calendar day or minute,
    so one ordered pass over it is bounded by the calendar and not by the rows.
    """
    order = F.col("bucket").desc() if descending else F.col("bucket").asc()
    so_far = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    holds = (F.col("reached") >= n) & (F.col("reached") - F.col("n") < n)
    holding = F.when(holds, F.struct("reached", "n", "bucket"))
    row: Row = (
        counts.select("bucket", "n", F.sum("n").over(so_far).alias("reached"))
        .agg(F.min(holding).alias("hit"), F.max("reached").alias("total"))
        .first()
    )
    if row["hit"] is None:
        return None, int(row["total"] or 0)
    return row["hit"]["bucket"], int(row["hit"]["reached"] - row["hit"]["n"])
