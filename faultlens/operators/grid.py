"""Putting samples and log counts on the regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions.numeric import floor_ts
from faultlens.operators.ordered import make_grid, running_last, time_chunk
from faultlens.schemas import NODES, STEP_SECONDS

SERIES = ["series_id"]


def master_grid(df: DataFrame, keys: list[str] = SERIES, step: int = STEP_SECONDS, ts: str = "ts") -> DataFrame:
    """Every step between the first and the last time of each key."""
    return make_grid(df.groupBy(*keys).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")), keys, step)


def reindex_grid(samples: DataFrame, grid: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Grid rows with the samples of exactly the same time, NULL where there is none."""
    # The samples grow with the grid, however small their files look: never a broadcast.
    return grid.join(samples.hint("merge"), [*keys, "ts"], "left")


def align_label_sets(samples: DataFrame, keys: list[str] = ["series_id", "metric"]) -> DataFrame:
    """Largest value over all label sets per metric and time; NaN and NULL are skipped."""
    return samples.groupBy(*keys, "ts").agg(F.max(F.nanvl("val", F.lit(None).cast("double"))).alias("val"))


def first_label_set(samples: DataFrame) -> DataFrame:
    """Only the first series of a response."""
    return samples.where(F.col("result_idx") == 0)


def pivot_metrics(samples: DataFrame, metrics: list[str], keys: list[str] = SERIES) -> DataFrame:
    """Long to wide. The metric names are given, so no pass is needed to find them."""
    return samples.groupBy(*keys, "ts").pivot("metric", metrics).agg(F.max("val"))


def asof_fill(samples: DataFrame, grid: DataFrame, keys: list[str] = ["series_id", "metric"],
              default: float = 0.0, chunk: Column | None = None, cols: list[str] = ["val"]) -> DataFrame:
    """Latest value at or before each grid time, however old; the default before the first sample. Each of ``cols`` by itself."""
    rows = (samples.select(*keys, "ts", F.lit(0).alias("_kind"), *cols)
            .unionByName(grid.select(*keys, "ts", F.lit(1).alias("_kind"), *[F.lit(None).cast("double").alias(c) for c in cols])))
    filled = running_last(rows, keys, ["ts", "_kind"], chunk if chunk is not None else time_chunk("ts"),
                          {f"filled_{i}": F.col(c) for i, c in enumerate(cols)})
    return filled.where("_kind = 1").select(*keys, "ts", *[F.coalesce(f"filled_{i}", F.lit(default)).alias(c) for i, c in enumerate(cols)])


def log_counts(logs: DataFrame, step: int = STEP_SECONDS, keys: list[str] = SERIES) -> DataFrame:
    """Per node and step: lines, error lines, mean message length.

    Dense between a node's first and last line; an empty bin has 0 lines and no mean length.
    Expects columns node, ts, is_error, msg_len.
    """
    by = [*keys, "node"]
    lines = logs.withColumn("ts", floor_ts(F.col("ts"), step)).where("ts IS NOT NULL")
    counts = lines.groupBy(*by, "ts").agg(F.count(F.lit(1)).alias("log_total"),
                                          F.sum(F.col("is_error").cast("bigint")).alias("log_error"),
                                          F.avg("msg_len").alias("log_avg_len"))
    zero = F.lit(0).cast("bigint")
    return (master_grid(lines, by, step).join(counts.hint("merge"), [*by, "ts"], "left")
            .select(*by, "ts", F.coalesce("log_total", zero).alias("log_total"),
                    F.coalesce("log_error", zero).alias("log_error"), "log_avg_len"))


def fuse_logs(metrics: DataFrame, counts: DataFrame, keys: list[str] = SERIES, nodes: list[str] = NODES,
              avg_len_null: str = "keep") -> DataFrame:
    """Add the log columns of every node to the metric rows of the same time.

    Bins outside a node's log range count 0. An empty bin inside the range has no mean length: it stays NULL
    (``avg_len_null='keep'``) or becomes 0 (``'zero'``).
    """
    here = {n: F.col("node") == n for n in nodes}
    wide = counts.groupBy(*keys, "ts").agg(
        *[F.max(F.when(here[n], F.col(c))).alias(f"{n}_{c}") for n in nodes for c in ("log_total", "log_error", "log_avg_len")],
        *[F.count_if(here[n]).alias(f"{n}_bins") for n in nodes])
    zero = F.lit(0.0)

    def length(n: str) -> Column:
        known = F.col(f"{n}_log_avg_len")
        if avg_len_null == "keep":
            return F.when(F.coalesce(F.col(f"{n}_bins"), F.lit(0)) > 0, known).otherwise(zero)
        return F.coalesce(known, zero)

    slots = [f"{n}_{c}" for n in nodes for c in ("log_total", "log_error", "log_avg_len")]
    base = [c for c in metrics.columns if c not in slots]
    return metrics.select(*base).join(wide.hint("merge"), [*keys, "ts"], "left").select(
        *base, *[F.coalesce(F.col(f"{n}_{c}").cast("double"), zero).alias(f"{n}_{c}") for n in nodes for c in ("log_total", "log_error")],
        *[length(n).alias(f"{n}_log_avg_len") for n in nodes])


def log_counts_pivot(impulses: DataFrame, keys: list[str] = SERIES, nodes: list[str] = NODES) -> DataFrame:
    """Harvest form of the counts: one row per time with any line, ``{node}_{measure}`` columns, 0 where absent."""
    wide = impulses.groupBy(*keys, "ts").pivot("node", nodes).agg(
        F.sum("is_err").alias("log_error"), F.sum("count").alias("log_total"), F.avg("len").alias("log_avg_len"))
    return wide.na.fill(0)


def union_logs(*parts: DataFrame, distinct: bool = False) -> DataFrame:
    """All lines of all parts. The same line seen twice counts twice unless ``distinct``."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates() if distinct else out


def node_pairs(nodes: DataFrame, keys: list[str] = ["series_id", "ts"], node: str = "node",
               value: str = "val") -> DataFrame:
    """Every ordered pair of nodes (with itself) at each time: the edges of the complete node graph.

    The nodes of one time are one short list, so one grouping replaces a self join.
    """
    listed = nodes.groupBy(*keys).agg(F.collect_list(F.struct(F.col(node).alias("n"), F.col(value).alias("v"))).alias("_l"))
    return (listed.select(*keys, F.explode("_l").alias("_i"), "_l")
            .select(*keys, "_i", F.explode("_l").alias("_j"))
            .select(*keys, F.col("_i.n").alias("src"), F.col("_j.n").alias("dst"),
                    F.col("_i.v").alias("src_val"), F.col("_j.v").alias("dst_val")))
