"""Latency summary: exact nearest-rank percentiles per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlog.operators.ordering import running_total

PERCENTILES = (50, 95, 99)


def latency_summary(
    df: DataFrame, value: str, group: str, percentiles: Sequence[int] = PERCENTILES
) -> DataFrame:
    """``p50``, ``p95`` … and ``max`` per group: the value at rank ``ceil(p/100 * n)``.

    Equal values are counted first. Their running totals along (group, value) then
    place every rank without gathering a group anywhere, however large it is.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(group).alias("group"), F.col(value).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    reached = running_total(counts, [F.col("group").asc(), F.col("value").asc()], "n", "reached")
    bounds = reached.groupBy("group").agg(
        F.min(F.col("reached") - F.col("n")).alias("offset"),
        F.sum("n").alias("total"),
        F.max("value").alias("max"),
    )
    upto = F.col("reached") - F.col("offset")
    picks = []
    for p in percentiles:
        # ceil(p * total / 100) in whole numbers
        rank = F.expr(f"({int(p)} * total + 99) div 100")
        here = (upto >= rank) & (upto - F.col("n") < rank)
        picks.append(F.max(F.when(here, F.col("value"))).alias(f"p{p}"))
    return (
        reached.join(bounds, reached["group"].eqNullSafe(bounds["group"]))
        .drop(bounds["group"])
        .groupBy("group")
        .agg(*picks, F.max("max").alias("max"))
        .withColumnRenamed("group", group)
    )
