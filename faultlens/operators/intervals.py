"""Fault intervals from START/STOP events, and the labels they give to grid rows.

Neither step forms pairs of rows inside a group. Pairing takes the best STOP at or after each START from a
backward scan. Labelling splits every interval into whole blocks of slots plus single slots at its two ends,
reduces both to one record per block, and gives each grid row one lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions.numeric import seconds_after, slot_of
from faultlens.operators.ordered import best_at_or_after, time_chunk
from faultlens.schemas import HEALTHY, STEP_SECONDS

SERIES = ["series_id"]
#: Slots per label block; an interval costs at most 2·BLOCK + length/BLOCK entries.
BLOCK = 256


def pair_intervals(events: DataFrame, keys: list[str] = SERIES, pad: float = 30.0, default: float = 120.0,
                   pad_duration: bool = True, order: str = "event_seq", ignore_case: bool = True,
                   chunk: Column | None = None) -> DataFrame:
    """One interval per START event.

    It ends ``pad`` seconds after the first STOP of the same node at or after the start - first in file order
    (``order='event_seq'``) or in time (``order='ts'``), whatever its fault type. Without such a STOP the
    event's own positive duration counts, else ``default``. ``pad_duration=False`` is the harvest rule: the
    duration is cut to whole seconds, gets no pad, and 0 stays 0.
    """
    state = F.upper("state") if ignore_case else F.col("state")
    first, second = ("event_seq", "ts") if order == "event_seq" else ("ts", "event_seq")
    stop = F.when(state == "STOP", F.struct(first, second))
    paired = best_at_or_after(events, [*keys, "node"], "ts", chunk if chunk is not None else time_chunk("ts"),
                              stop, "_stop")
    dur = F.col("duration_s")
    if pad_duration:
        fallback = F.when((dur > 0) & ~F.isnan(dur), dur + pad).otherwise(F.lit(default))
    else:
        fallback = F.when(dur.isNull() | F.isnan(dur), F.lit(default)).otherwise(dur.cast("bigint").cast("double"))
    et = F.coalesce(seconds_after(F.col("_stop.ts"), F.lit(pad)), seconds_after(F.col("ts"), fallback))
    return paired.where(state == "START").select(
        *keys, "node", F.upper(F.trim("fault_type")).alias("fault_type"),
        F.col("ts").alias("st"), et.alias("et"), "event_seq")


def _blocks(intervals: DataFrame, keys: list[str], step: int, block: int) -> DataFrame:
    """(keys, block) → best label of intervals that fill the block, and a map slot → (best, n) for the rest."""
    lo = F.ceil(F.unix_micros("st") / F.lit(step * 1e6))
    hi = F.floor(F.unix_micros("et") / F.lit(step * 1e6))
    spans = (intervals.select(*keys, F.struct("event_seq", "fault_type").alias("best"),
                              lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
             .withColumn("b0", F.ceil(F.col("lo") / F.lit(block)))
             .withColumn("b1", F.floor((F.col("hi") + 1) / F.lit(block)) - 1))
    whole = F.col("b0") <= F.col("b1")

    def upto(a: Column, b: Column) -> Column:
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

    head_end = F.when(whole, F.col("b0") * block - 1).otherwise(F.col("hi"))
    tail_start = F.when(whole, (F.col("b1") + 1) * block).otherwise(F.col("hi") + 1)
    no_slot = F.lit(None).cast("bigint")
    full = F.transform(upto(F.col("b0"), F.col("b1")), lambda b: F.struct(b.alias("block"), no_slot.alias("slot")))
    edge = F.transform(F.concat(upto(F.col("lo"), head_end), upto(tail_start, F.col("hi"))),
                       lambda s: F.struct(F.floor(s / F.lit(block)).alias("block"), s.alias("slot")))
    pieces = (spans.select(*keys, "best", F.explode(F.concat(full, edge)).alias("p"))
              .groupBy(*keys, "p.block", "p.slot").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("n")))
    here = F.struct(F.col("best"), F.col("n"))
    return pieces.groupBy(*keys, "block").agg(
        F.max(F.when(F.col("slot").isNull(), here)).alias("_full"),
        F.map_from_entries(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", here)))).alias("_edge"))


def label(grid: DataFrame, intervals: DataFrame, keys: list[str] = SERIES, step: int = STEP_SECONDS,
          block: int = BLOCK) -> DataFrame:
    """Add ground_truth, fault_type and n_intervals to grid rows whose ``ts`` lies on the step.

    Both ends of an interval count as inside. Where intervals overlap, the START with the highest event_seq
    names the fault.
    """
    here = grid.withColumn("_slot", slot_of(F.col("ts"), step)).withColumn("block", F.floor(F.col("_slot") / F.lit(block)))
    out = here.join(_blocks(intervals, keys, step, block).hint("merge"), [*keys, "block"], "left")
    out = out.withColumn("_here", F.try_element_at("_edge", F.col("_slot")))
    best = F.greatest(F.col("_full.best"), F.col("_here.best"))
    n = F.coalesce(F.col("_full.n"), F.lit(0)) + F.coalesce(F.col("_here.n"), F.lit(0))
    return (out.withColumn("n_intervals", n)
            .withColumn("ground_truth", (n > 0).cast("int"))
            .withColumn("fault_type", F.coalesce(best["fault_type"], F.lit(HEALTHY)))
            .drop("_slot", "block", "_full", "_edge", "_here"))


def label_rows(grid: DataFrame, intervals: DataFrame, **kw) -> DataFrame:
    return label(grid, intervals, **kw).drop("n_intervals", "fault_type")


def label_fault_type(grid: DataFrame, intervals: DataFrame, **kw) -> DataFrame:
    return label(grid, intervals, **kw).drop("n_intervals", "ground_truth")


def label_coverage(grid: DataFrame, intervals: DataFrame, keys: list[str] = SERIES, **kw) -> DataFrame:
    """Per key: START events, labelled rows with multiplicity and once each, and their share."""
    rows = label(grid, intervals, keys=keys, **kw).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("n_intervals").alias("labelled_with_multiplicity"),
        F.sum(F.col("ground_truth").cast("bigint")).alias("labelled_rows"),
        F.avg("ground_truth").alias("labelled_share"))
    starts = intervals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_starts"))
    return (rows.join(starts, keys, "left").withColumn("n_starts", F.coalesce("n_starts", F.lit(0))))
