"""Row-order operators: change, windows, runs, transitions, smoothing, the alarm state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from faultlens.functions.numeric import let
from faultlens.operators.ordered import (CHUNK_ROWS, carry_in, halo_by_position, halo_by_time, inside, running_last, time_chunk,
                                         with_position, with_previous)
from faultlens.schemas import CLIP, HEALTHY, WINDOW_ROWS

SERIES = ["series_id"]


def _chunk(chunk: Column | None) -> Column:
    return time_chunk("ts") if chunk is None else chunk


def delta(df: DataFrame, cols: list[str], keys: list[str] = SERIES, order: list[str] = ["ts"],
          chunk: Column | None = None, suffix: str = "_delta", scope: str = "series", size: int = WINDOW_ROWS,
          step: int | None = None) -> DataFrame:
    """Change against the row before; 0 on the first row.

    With ``step``, the seconds between rows of a grid without gaps, a copy of the last row of each day replaces the pass that
    carries it from chunk to chunk.

    ``scope='window'`` gives the full windows of ``size`` rows instead, as ``win``, with the changes inside each of them as
    ``delta``: there the first row of every window has change 0, whatever came before it.
    """
    if scope == "window":
        return sliding_windows(df, cols, size, keys, order, chunk, y=None, fault=None).withColumn("delta", window_delta(F.col("win")))
    if scope != "series":
        raise ValueError(f"unknown scope {scope!r}: series, window")
    if step:
        rows = halo_by_time(df, order[0], step)
        before = F.lag(F.struct(*cols)).over(Window.partitionBy(*keys, "_chunk").orderBy(*order))
        out = rows.withColumn("_prev", before).where(~F.col("_halo")).drop("_halo", "_chunk")
    else:
        out = with_previous(df, keys, order, _chunk(chunk), cols, "_prev")
    return out.withColumns({c + suffix: F.col(c) - F.coalesce(F.col(f"_prev.{c}"), F.col(c)) for c in cols}).drop("_prev")


def window_delta(win: Column) -> Column:
    """Changes inside a window ARRAY<ARRAY<DOUBLE>>; those of its first row are 0."""
    return let(win, lambda w: F.transform(w, lambda row, i: F.zip_with(row, F.get(w, F.greatest(i - 1, F.lit(0))), lambda a, b: a - b)))


def window_inputs(win: Column, level: list[tuple[float, float]], combined: list[tuple[float, float]], clip: float = CLIP) -> Column:
    """Scaled levels and changes of a raw window, with all scaling and changes inside the window; NULL and NaN count as the mean."""
    def scaled(rows: Column, fitted: list[tuple[float, float]]) -> Column:
        pairs = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in fitted])
        one = lambda v, p: F.coalesce(F.nanvl(F.greatest(F.least((v - p["m"]) / p["s"], F.lit(clip)), F.lit(-clip)), F.lit(0.0)), F.lit(0.0))
        return F.transform(rows, lambda row: F.zip_with(row, pairs, one))
    return let(scaled(win, level), lambda z: scaled(F.zip_with(z, window_delta(z), lambda a, d: F.concat(a, d)), combined))


def _placed(df: DataFrame, keys: list[str], order: list[str], chunk: Column | None, pos: str | None):
    if pos:
        return df.withColumn("_pos", F.col(pos))
    return with_position(df, keys, order, _chunk(chunk), "_pos")


def sliding_windows(df: DataFrame, cols: list[str], size: int = WINDOW_ROWS, keys: list[str] = SERIES,
                    order: list[str] = ["ts"], chunk: Column | None = None, pos: str | None = None,
                    y: str | None = "ground_truth", fault: str | None = "fault_type", name: str = "win",
                    also: dict[str, Callable[[WindowSpec], Column]] | None = None) -> DataFrame:
    """Full windows of ``size`` consecutive rows, stride 1. ``also`` names further columns, as functions of the window's frame.

    Gives (keys, win_id = position of the first row, ts of the last row, window ARRAY<ARRAY<DOUBLE>>) and,
    where the label columns are named, the window label (largest) and its earliest fault that is not HEALTHY.
    """
    rows = halo_by_position(_placed(df, keys, order, chunk, pos), "_pos", size - 1)
    w = Window.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(-(size - 1), 0)
    out = rows.withColumn("_row", F.array(*[F.col(c).cast("double") for c in cols]))
    new = {name: F.collect_list("_row").over(w)}
    if y:
        new["y"] = F.max(y).over(w)
    if fault:
        new["_ft"] = F.first(F.when(F.col(fault) != HEALTHY, F.col(fault)), ignorenulls=True).over(w)
    new |= {n: f(w) for n, f in (also or {}).items()}
    out = out.withColumns(new).where(~F.col("_halo") & (F.col("_pos") >= size - 1))
    keep = [*keys, (F.col("_pos") - (size - 1)).alias("win_id"), *[F.col(o) for o in order], name]
    if y:
        keep.append("y")
    if fault:
        keep.append(F.coalesce("_ft", F.lit(HEALTHY)).alias("fault_type"))
    return out.select(*keep, *(also or {}))


def window_label(df: DataFrame, size: int = WINDOW_ROWS, keys: list[str] = SERIES, order: list[str] = ["ts"],
                 chunk: Column | None = None, pos: str | None = None) -> DataFrame:
    """Labels of the sliding windows without building the windows."""
    return sliding_windows(df, [], size, keys, order, chunk, pos).drop("win")


def trailing_mean(df: DataFrame, col: str, n: int, name: str, keys: list[str] = SERIES, order: list[str] = ["ts"],
                  chunk: Column | None = None, pos: str | None = None, keep_pos: str | None = None) -> DataFrame:
    """Mean of the last n rows, fewer at the start."""
    rows = halo_by_position(_placed(df, keys, order, chunk, pos), "_pos", n - 1)
    w = Window.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(-(n - 1), 0)
    out = rows.withColumn(name, F.avg(col).over(w)).where(~F.col("_halo")).drop("_chunk", "_halo")
    return out.withColumnRenamed("_pos", keep_pos) if keep_pos else out.drop("_pos")


def moving_average(scores: DataFrame, n: int = 3, col: str = "score", name: str = "smoothed", **kw) -> DataFrame:
    return trailing_mean(scores, col, n, name, **kw)


def pair_counts(df: DataFrame, flag: str, counters: dict[str, Callable[[Column, Column], Column]], keys: list[str], order: list[str],
                chunk: Column) -> DataFrame:
    """Running counts over pairs of neighbouring rows, in one pass over the chunks.

    Each counter is a condition on the flag of the row before, as a struct that is NULL on the first row of a key, and of the
    row itself. Adds ``_prev`` (that struct) and the counters. A chunk's summary is its first and last flag and its counts inside;
    the summaries of a key are scanned once, which gives every chunk the row before it and the counts so far.
    """
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    here = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    now = F.struct(F.col(flag).alias("v"))
    out = df.withColumn("_chunk", chunk)
    out = out.withColumns({"_was": F.lag(now).over(within), "_end": F.lead(F.lit(1)).over(within).isNull(), "_head": F.first(now).over(here)})
    inner = {n: F.sum(F.when(F.col("_was").isNotNull() & f(F.col("_was"), now), 1).otherwise(0)).over(here) for n, f in counters.items()}
    out = out.withColumns(inner)
    scan = Window.partitionBy(*keys).orderBy("_chunk")
    ends = out.where("_end").select(*keys, "_chunk", "_head", now.alias("_tail"), *counters).withColumn("_before", F.lag("_tail").over(scan))
    ends = ends.withColumns({f"_{n}_seam": F.when(f(F.col("_before"), F.col("_head")), 1).otherwise(0) for n, f in counters.items()})
    base = {f"_{n}_base": F.sum(F.col(n) + F.col(f"_{n}_seam")).over(scan.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(n) for n in counters}
    handed = ends.withColumns(base).select(*keys, "_chunk", "_before", *base)
    out = out.join(handed.hint("shuffle_hash"), [*keys, "_chunk"])
    out = out.withColumns({**{n: (F.col(n) + F.col(f"_{n}_base")).cast("bigint") for n in counters}, "_prev": F.coalesce("_was", "_before")})
    return out.drop("_chunk", "_was", "_end", "_head", "_before", *base)


def islands(df: DataFrame, flag: str, keys: list[str] = SERIES, order: list[str] = ["ts"],
            chunk: Column | None = None, name: str = "block") -> DataFrame:
    """Number the runs of equal flag values, from 1."""
    changed = lambda was, now: was.isNull() | ~was["v"].eqNullSafe(now["v"])
    return pair_counts(df, flag, {name: changed}, keys, order, _chunk(chunk)).drop("_prev")


def transitions(df: DataFrame, flag: str = "ground_truth", keys: list[str] = SERIES, order: list[str] = ["ts"],
                chunk: Column | None = None, first: int | None = None) -> DataFrame:
    """k-th rise with the k-th fall of a 0/1 flag, and the seconds between them.

    A flag that is already 1 in the first row gives no rise, so a fall may come before its rise.
    """
    step = lambda size: lambda was, now: F.coalesce(now["v"] - was["v"] == size, F.lit(False))
    out = pair_counts(df, flag, {"_rises": step(1), "_falls": step(-1)}, keys, order, _chunk(chunk))
    edges = out.withColumn("_kind", F.col(flag) - F.col("_prev.v")).where(F.col("_kind").isin(1, -1))
    edges = edges.withColumn("k", F.when(F.col("_kind") == 1, F.col("_rises")).otherwise(F.col("_falls")))
    ts = order[0]
    pairs = edges.groupBy(*keys, "k").agg(F.max(F.when(F.col("_kind") == 1, F.col(ts))).alias("start_ts"),
                                          F.max(F.when(F.col("_kind") == -1, F.col(ts))).alias("stop_ts"))
    pairs = pairs.where("start_ts IS NOT NULL AND stop_ts IS NOT NULL")
    if first:
        pairs = pairs.where(F.col("k") <= first)
    return pairs.withColumn("seconds", F.unix_seconds("stop_ts") - F.unix_seconds("start_ts"))


def fill_section(lines: DataFrame, header: str, keys: list[str], order: str, chunk: Column, name: str = "section") -> DataFrame:
    """Carry the latest header down the file."""
    return running_last(lines, keys, [order], chunk, {name: F.col(header)})


def healthy_prefix(df: DataFrame, share: float = 0.7, keys: list[str] = SERIES, order: list[str] = ["ts"],
                   y: str = "ground_truth", chunk: Column | None = None) -> DataFrame:
    """The first ⌊share·n⌋ healthy rows in time order."""
    out = with_position(df.where(F.col(y) == 0), keys, order, _chunk(chunk), "_pos", total="_all")
    return out.where(F.col("_pos") < F.floor(F.col("_all") * F.lit(share))).drop("_pos", "_all")


def tail(df: DataFrame, n: int, keys: list[str] = SERIES, order: list[str] = ["ts"]) -> DataFrame:
    """The newest n rows of each key; nothing for keys with fewer."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    newest = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    enough = Window.partitionBy(*keys)
    return newest.withColumn("_n", F.count(F.lit(1)).over(enough)).where(F.col("_n") == n).drop("_r", "_n")


def sentinel_batch(scores: DataFrame, threshold: float, smooth: int = 3, warmup: int = 5, col: str = "score",
                   keys: list[str] = SERIES, order: list[str] = ["ts"], chunk: Column | None = None,
                   size: int = CHUNK_ROWS) -> DataFrame:
    """Replay of the live alarm: smoothing, warm-up offset, fast recovery. No rows for the warm-up ticks.

    While calm, the smoothed score decides; while alarmed, the last score alone. One tick is thus one of four
    maps of the state {calm, alarmed}: set, clear, keep, flip. The state at a tick is the latest set/clear,
    flipped once for every flip since, which needs only running sums and no row-by-row loop.
    """
    rows = trailing_mean(scores, col, smooth, "smoothed", keys, order, chunk, keep_pos="_pos")
    rows = rows.withColumn("_chunk", F.floor(F.col("_pos") / F.lit(max(size, warmup))))
    here = inside(keys, "_chunk", ["_pos"])
    early = F.when(F.col("_pos") < warmup, F.col("smoothed"))
    rows = carry_in(rows, keys, "_chunk", {"_top": F.max(early)}, {"_calm": lambda w: F.max("_top").over(w)})
    rows = rows.withColumn("offset", F.greatest(F.lit(0.0), F.col("_calm"), F.max(early).over(here)))
    live = F.col("_pos") >= warmup

    def over(score: Column) -> Column:
        return F.greatest(F.lit(0.0), score - F.col("offset")) >= threshold

    rows = rows.withColumn("_rise", F.when(live, over(F.col("smoothed"))).otherwise(F.lit(False)))
    rows = rows.withColumn("_hold", F.when(live, over(F.col(col))).otherwise(F.lit(False)))
    flip = (F.col("_rise") & ~F.col("_hold")).cast("int")
    rows = rows.withColumn("_flips", F.sum(flip).over(here))
    fixed = F.when(F.col("_rise") == F.col("_hold"), (F.col("_rise").cast("int") + F.col("_flips")) % 2)
    rows = rows.withColumn("_fixed", fixed)
    # A chunk's effect on the state: with a set/clear inside, its last one; else only the parity of its flips.
    summary = {"_end_flips": F.sum(flip), "_end_fixed": F.max_by("_fixed", F.when(F.col("_fixed").isNotNull(), F.col("_pos")))}
    per_chunk = rows.groupBy(*keys, "_chunk").agg(*[c.alias(n) for n, c in summary.items()])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = per_chunk.withColumn("_f0", F.coalesce(F.sum("_end_flips").over(before), F.lit(0)))
    per_chunk = per_chunk.withColumn("_anchor", F.last((F.col("_end_fixed") + F.col("_f0")) % 2, ignorenulls=True).over(before))
    entry = per_chunk.select(*keys, "_chunk", ((F.coalesce("_anchor", F.lit(0)) + F.col("_f0")) % 2).alias("_entry"))
    rows = rows.join(entry.hint("shuffle_hash"), [*keys, "_chunk"])
    anchor = F.coalesce(F.last("_fixed", ignorenulls=True).over(here), F.col("_entry"))
    rows = rows.withColumn("_active", (anchor + F.col("_flips")) % 2)
    first_in_chunk = F.lag("_active").over(Window.partitionBy(*keys, "_chunk").orderBy("_pos"))
    was = F.coalesce(first_in_chunk, F.col("_entry"))
    rows = rows.withColumn("corrected", F.greatest(F.lit(0.0), F.when(was == 1, F.col(col)).otherwise(F.col("smoothed")) - F.col("offset")))
    return (rows.where(live).withColumn("anomaly", F.col("_active") == 1)
            .select(*keys, *order, F.col("_pos").alias("tick"), col, "smoothed", "offset", "corrected", "anomaly"))
