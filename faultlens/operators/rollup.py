"""Trailing-range functions over metric samples, and fallbacks between metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.operators.ordered import DAY, halo_by_time

BY = ["series_id", "metric"]


def _trailing(keys: list[str], seconds: int):
    return (Window.partitionBy(*keys, "_chunk").orderBy(F.unix_micros("ts"))
            .rangeBetween(-seconds * 1_000_000, Window.currentRow))


def counter_rate(samples: DataFrame, seconds: int = 30, keys: list[str] = BY, factor: float = 1.0,
                 chunk_seconds: int = DAY) -> DataFrame:
    """Increase per second of a counter over the trailing range; NULL with fewer than two samples in it.

    A drop means that the counter was reset: the new value is the increase. The increase into the first
    sample of the range lies outside the range and is taken off again, so the rows copied ahead of a chunk
    are all that is needed. No extrapolation to the ends of the range.
    """
    rows = halo_by_time(samples, "ts", seconds, chunk_seconds)
    before = F.lag("val").over(Window.partitionBy(*keys, "_chunk").orderBy(F.unix_micros("ts")))
    rise = F.when(F.col("val") >= before, F.col("val") - before).otherwise(F.when(before.isNotNull(), F.col("val")).otherwise(0.0))
    w = _trailing(keys, seconds)
    out = rows.withColumn("_rise", rise)
    out = (out.withColumn("_inc", F.sum("_rise").over(w) - F.first("_rise").over(w))
           .withColumn("_span", (F.unix_micros("ts") - F.first(F.unix_micros("ts")).over(w)) / F.lit(1e6)))
    return (out.where(~F.col("_halo"))
            .withColumn("rate", F.when(F.col("_span") > 0, F.col("_inc") / F.col("_span") * factor))
            .drop("_rise", "_inc", "_span", "_chunk", "_halo"))


def max_over_time(samples: DataFrame, seconds: int = 30, keys: list[str] = BY, chunk_seconds: int = DAY) -> DataFrame:
    rows = halo_by_time(samples, "ts", seconds, chunk_seconds)
    return (rows.withColumn("max_val", F.max("val").over(_trailing(keys, seconds)))
            .where(~F.col("_halo")).drop("_chunk", "_halo"))


def metric_fallback(alternatives: list[DataFrame], keys: list[str] = ["series_id"], labels: str = "label_set",
                    grid: DataFrame | None = None, const: float | None = None) -> DataFrame:
    """``a or b or …`` per label set and time; with a grid, ``const`` where no alternative has any value.

    Alternatives have columns keys, ts, the label set (text) and val. A NULL val counts as no sample.
    """
    ranked = None
    for rank, part in enumerate(alternatives):
        part = part.where("val IS NOT NULL").select(*keys, "ts", labels, "val", F.lit(rank).alias("_rank"))
        ranked = part if ranked is None else ranked.unionByName(part)
    found = ranked.groupBy(*keys, "ts", labels).agg(F.min_by("val", "_rank").alias("val"))
    if grid is None:
        return found
    return (grid.select(*keys, "ts").join(found, [*keys, "ts"], "left")
            .withColumn(labels, F.coalesce(labels, F.lit("")))
            .withColumn("val", F.coalesce("val", F.lit(const))))
