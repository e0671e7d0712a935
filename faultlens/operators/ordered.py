"""Ordered computations that stay exact when one key holds a large share of the rows.

A window partitioned by the series alone puts a whole series into one task. Here every series is cut into
chunks along its order; a first pass reduces each chunk to one summary row (with map-side combine), the
summaries are scanned per series, and each chunk starts from the value carried in. Chunks are functions of
the row's own values, so a task that is run again sees the same chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from faultlens.session import shuffle_partitions

DAY = 86_400
#: Rows per chunk where chunks are cut by row position.
CHUNK_ROWS = 8_192


def time_chunk(ts: str = "ts", seconds: int = DAY) -> Column:
    """Chunk number of a time stamp. One series has at most seconds/step rows of a grid in a chunk."""
    return F.floor(F.unix_seconds(F.col(ts)) / F.lit(seconds))


def number_chunk(col: str, width: int) -> Column:
    return F.floor(F.col(col) / F.lit(width))


def carry_in(df: DataFrame, keys: list[str], chunk: str, summary: dict[str, Column],
             carried: dict[str, Callable[[WindowSpec], Column]], backwards: bool = False) -> DataFrame:
    """Add what the earlier (or, backwards, the later) chunks of the same key hand over to each chunk.

    ``summary`` are aggregates per (keys, chunk); ``carried`` maps a new column to an expression over the
    summaries, given the window of the chunks before this one.
    """
    order = F.col(chunk).desc() if backwards else F.col(chunk)
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = df.groupBy(*keys, chunk).agg(*[c.alias(n) for n, c in summary.items()])
    handed = per_chunk.select(*keys, chunk, *[f(before).alias(n) for n, f in carried.items()])
    # The rows have to move to their chunk anyway for the window that follows: hash join on that partitioning.
    # Without the hint a well compressed file can look small enough to broadcast the rows themselves.
    return df.join(handed.hint("shuffle_hash"), [*keys, chunk])


def inside(keys: list[str], chunk: str, order: list[str]) -> WindowSpec:
    """The rows of one chunk from its first to the present one."""
    return (Window.partitionBy(*keys, chunk).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))


def with_position(df: DataFrame, keys: list[str], order: list[str | Column], chunk: Column,
                  name: str = "pos", total: str | None = None) -> DataFrame:
    """0-based row number per key in the given order; optionally also the number of rows of the key."""
    everything = Window.partitionBy(*keys)
    carried = {"_before": lambda w: F.coalesce(F.sum("_n").over(w), F.lit(0))}
    if total:
        carried[total] = lambda w: F.sum("_n").over(everything)
    out = carry_in(df.withColumn("_chunk", chunk), keys, "_chunk", {"_n": F.count(F.lit(1))}, carried)
    local = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    return out.withColumn(name, (F.col("_before") + local - 1).cast("bigint")).drop("_chunk", "_before")


def with_previous(df: DataFrame, keys: list[str], order: list[str], chunk: Column, cols: list[str],
                  name: str = "prev") -> DataFrame:
    """Add a struct with the given columns of the row before; NULL on the first row of the key."""
    packed = F.struct(*[F.col(c) for c in cols])
    out = carry_in(df.withColumn("_chunk", chunk), keys, "_chunk",
                   {"_tail": F.max_by(packed, F.struct(*order))},
                   {"_before": lambda w: F.last("_tail").over(w)})
    local = F.lag(packed).over(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    return out.withColumn(name, F.coalesce(local, F.col("_before"))).drop("_chunk", "_before")


def running_sum(df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: Column,
                name: str) -> DataFrame:
    """Sum of value over the rows of the key up to and including this one."""
    out = df.withColumn("_chunk", chunk).withColumn("_v", value)
    out = carry_in(out, keys, "_chunk", {"_part": F.sum("_v")},
                   {"_before": lambda w: F.coalesce(F.sum("_part").over(w), F.lit(0))})
    local = F.sum("_v").over(inside(keys, "_chunk", order))
    return out.withColumn(name, F.col("_before") + local).drop("_chunk", "_v", "_before")


def running_last(df: DataFrame, keys: list[str], order: list[str], chunk: Column, values: dict[str, Column]) -> DataFrame:
    """Latest non-NULL value up to and including this row, of each of the values by name; a row moves once for all of them."""
    now, tail, was = ([f"{prefix}{i}" for i in range(len(values))] for prefix in ("_v", "_tail", "_before"))
    out = df.withColumn("_chunk", chunk).withColumns(dict(zip(now, values.values())))
    out = carry_in(out, keys, "_chunk",
                   {t: F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))) for t, v in zip(tail, now)},
                   {b: lambda w, t=t: F.last(t, ignorenulls=True).over(w) for b, t in zip(was, tail)})
    here = inside(keys, "_chunk", order)
    last = {n: F.coalesce(F.last(v, ignorenulls=True).over(here), F.col(b)) for n, v, b in zip(values, now, was)}
    return out.withColumns(last).drop("_chunk", *now, *was)


def best_at_or_after(df: DataFrame, keys: list[str], ts: str, chunk: Column, value: Column,
                     name: str) -> DataFrame:
    """Smallest value among the rows of the key whose time is not before this row's time."""
    out = df.withColumn("_chunk", chunk).withColumn("_v", value)
    out = carry_in(out, keys, "_chunk", {"_min": F.min("_v")},
                   {"_later": lambda w: F.min("_min").over(w)}, backwards=True)
    here = (Window.partitionBy(*keys, "_chunk").orderBy(F.col(ts).desc())
            .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn(name, F.least(F.min("_v").over(here), F.col("_later"))).drop("_chunk", "_v", "_later")


def halo_by_position(df: DataFrame, pos: str = "pos", before: int = 0, size: int = CHUNK_ROWS) -> DataFrame:
    """Cut into chunks of ``size`` positions, each preceded by copies of the ``before`` rows ahead of it.

    Adds ``_chunk`` and ``_halo`` (true for the copies). Costs before/size extra rows.
    """
    size = max(size, before + 1)
    own = F.floor(F.col(pos) / F.lit(size))
    homes = F.when(F.col(pos) % size >= size - before, F.array(own, own + 1)).otherwise(F.array(own))
    return (df.withColumn("_chunk", F.explode(homes))
            .withColumn("_halo", F.col("_chunk") != own))


def halo_by_time(df: DataFrame, ts: str, before: int, seconds: int = DAY) -> DataFrame:
    """As :func:`halo_by_position`, with chunks of time and copies of the last ``before`` seconds."""
    seconds = max(seconds, before + 1)
    at = F.unix_seconds(F.col(ts))
    own = F.floor(at / F.lit(seconds))
    homes = F.when(at - own * seconds >= seconds - before - 1, F.array(own, own + 1)).otherwise(F.array(own))
    return (df.withColumn("_chunk", F.explode(homes))
            .withColumn("_halo", F.col("_chunk") != own))


def make_grid(bounds: DataFrame, keys: list[str], step: int, lo: str = "lo", hi: str = "hi",
              chunk_slots: int = CHUNK_ROWS) -> DataFrame:
    """Regular time grid from lo to hi (both included) per key.

    The range is first cut into chunks that are spread over the tasks, so one long range does not have to be
    written out by a single task.
    """
    n = shuffle_partitions(bounds.sparkSession)
    first, last = F.floor(F.unix_seconds(F.col(lo)) / F.lit(step)), F.floor(F.unix_seconds(F.col(hi)) / F.lit(step))
    parts = bounds.select(*keys, first.alias("_a"), last.alias("_b")).select(
        *keys, "_a", "_b",
        F.explode(F.sequence(F.floor(F.col("_a") / F.lit(chunk_slots)),
                             F.floor(F.col("_b") / F.lit(chunk_slots)))).alias("_c"))
    start = F.greatest(F.col("_a"), F.col("_c") * chunk_slots)
    end = F.least(F.col("_b"), F.col("_c") * chunk_slots + (chunk_slots - 1))
    return (parts.repartition(n, *keys, "_c")
            .select(*keys, F.explode(F.sequence(start, end)).alias("_s"))
            .select(*keys, F.timestamp_seconds(F.col("_s") * step).alias("ts")))
