"""Table profiles and per-feature reports. Each is one aggregation pass; only its few result numbers are reshaped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.operators.clean import node_of
from faultlens.schemas import HEALTHY, LABEL_COLUMNS, NODES


def _long(one_row: DataFrame, cols: list[str], fields: list[str], name: str = "feature") -> DataFrame:
    """Turn a row of structs into one row per column."""
    listed = F.array(*[F.struct(F.lit(c).alias(name), *[F.col(f"{c}.{f}").alias(f) for f in fields]) for c in cols])
    return one_row.select(F.explode(listed).alias("s")).select("s.*")


def class_means(df: DataFrame, cols: list[str], y: str = "ground_truth") -> DataFrame:
    """Per feature: healthy mean, anomalous mean and their difference."""
    means = df.agg(*[F.struct(F.avg(F.when(F.col(y) == 0, F.col(c))).alias("h_mean"),
                              F.avg(F.when(F.col(y) == 1, F.col(c))).alias("a_mean")).alias(c) for c in cols])
    return _long(means, cols, ["h_mean", "a_mean"]).withColumn("diff", F.col("a_mean") - F.col("h_mean"))


def discriminative_power(df: DataFrame, cols: list[str], top: int = 10, bottom: int = 5, y: str = "ground_truth") -> DataFrame:
    """Features with the largest and the smallest absolute mean difference. One row per feature in play."""
    power = class_means(df, cols, y).select("feature", F.abs("diff").alias("power"))
    best = power.orderBy(F.col("power").desc_nulls_last(), "feature").limit(top).withColumn("side", F.lit("top"))
    worst = power.orderBy(F.col("power").asc_nulls_first(), F.col("feature").desc()).limit(bottom).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst).select("side", "feature", "power")


def profile(df: DataFrame, nodes: list[str] = NODES) -> DataFrame:
    """(section, key, value): row and column counts, label and fault counts, features per node, other columns."""
    labels = [c for c in LABEL_COLUMNS if c in df.columns]
    counts = df.groupBy(*labels).agg(F.count(F.lit(1)).alias("value"))
    parts = [counts.groupBy().agg(F.sum("value").alias("value")).select(F.lit("table").alias("section"), F.lit("rows").alias("key"), "value")]
    for c in labels:
        parts.append(counts.groupBy(F.col(c).cast("string").alias("key")).agg(F.sum("value").alias("value"))
                     .select(F.lit(c).alias("section"), "key", "value"))
    shape = [("table", "columns", len(df.columns))]
    shape += [("node", n, sum(node_of(c, nodes) == n for c in df.columns)) for n in nodes]
    shape += [("metadata", c, 1) for c in df.columns if node_of(c, nodes) is None]
    out = df.sparkSession.createDataFrame(shape, "section string, key string, value bigint")
    for part in parts:
        out = out.unionByName(part)
    return out


def variance_report(df: DataFrame, cols: list[str], y: str = "ground_truth", fault: str = "fault_type") -> DataFrame:
    """Columns with variance among metric and log columns, anomaly share, fault types found."""
    logs = [c for c in cols if "_log_" in c]
    metrics = [c for c in cols if "_log_" not in c]
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(y).alias("anomaly_ratio"),
                 F.array_sort(F.collect_set(F.when(F.col(fault) != HEALTHY, F.col(fault)))).alias("_ft"),
                 *[F.stddev_samp(c).alias(f"_sd_{c}") for c in cols])

    def active(names: list[str]) -> Column:
        return sum((F.coalesce((F.col(f"_sd_{c}") > 0).cast("bigint"), F.lit(0)) for c in names), F.lit(0).cast("bigint"))

    return agg.select("n_rows", F.lit(len(metrics)).cast("bigint").alias("metric_cols"), active(metrics).alias("metric_active"),
                      F.lit(len(logs)).cast("bigint").alias("log_cols"), active(logs).alias("log_active"),
                      "anomaly_ratio", F.array_join("_ft", ",").alias("fault_types"))


def availability(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per metric: samples present and samples that are not 0."""
    counts = df.agg(*[F.struct(F.count(c).alias("present"), F.count_if(F.col(c) != 0).alias("non_zero")).alias(c) for c in cols])
    return _long(counts, cols, ["present", "non_zero"], "metric")


def session_summary(events: DataFrame, keys: list[str] = ["series_id"], ts: str = "ts") -> DataFrame:
    """START events per fault type, their total and the hours between the first and the last event."""
    starts = events.where(F.upper("state") == "START").groupBy(*keys, "fault_type").agg(F.count(F.lit(1)).alias("n"))
    total = starts.groupBy(*keys).agg(F.sum("n").alias("total_faults"))
    span = events.groupBy(*keys).agg(((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / F.lit(3.6e9)).alias("_h"))
    return (starts.join(total, keys).join(span, keys)
            .select(*keys, "fault_type", "n", "total_faults", F.round("_h", 3).alias("elapsed_hours")))


def stability(features: DataFrame, levels: list[str], changes: list[str], keys: list[str] = ["series_id"],
              ts: str = "ts", limit: float = 1.0) -> DataFrame:
    """Mean absolute level and change of the newest row per key; drift if either reaches the limit."""
    newest = features.groupBy(*keys).agg(F.max_by(F.struct(*levels, *changes), ts).alias("r"))

    def size(cols: list[str]) -> Column:
        return sum((F.abs(F.col(f"r.{c}")) for c in cols[1:]), F.abs(F.col(f"r.{cols[0]}"))) / len(cols)

    out = newest.select(*keys, size(levels).alias("mean_abs_z"), size(changes).alias("mean_abs_delta"))
    calm = (F.col("mean_abs_z") < limit) & (F.col("mean_abs_delta") < limit)
    return out.withColumn("verdict", F.when(calm, "STABLE").otherwise("DRIFT"))


def sort_by_metric(df: DataFrame, col: str, ascending: bool = False, n: int | None = None) -> DataFrame:
    out = df.orderBy(F.col(col).asc() if ascending else F.col(col).desc())
    return out.limit(n) if n else out
