"""Thresholds, confusion measures, recall per fault, time to detect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions.numeric import ratio
from faultlens.operators.clean import known_anomalies
from faultlens.operators.curves import curve_areas, exact_percentiles, sketched_percentiles
from faultlens.operators.ordered import carry_in, inside, time_chunk
from faultlens.session import attach, stage

MODEL = ["model"]
# Percentile lists of the sweep and of the calibration.
SWEEP = [99.5, 99, 98, 97, 96, 95, 93, 90, 85, 80, 75, 70]
CALIBRATION = list(range(75, 93))


def _counts(hit: Column, y: Column) -> dict[str, Column]:
    return {"tp": F.count_if(hit & (y == 1)), "fp": F.count_if(hit & (y == 0)),
            "tn": F.count_if(~hit & (y == 0)), "fn": F.count_if(~hit & (y == 1))}


def with_measures(df: DataFrame) -> DataFrame:
    """accuracy, precision, recall, F1 and FPR from tp/fp/tn/fn; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return (df.withColumn("accuracy", ratio(tp + tn, tp + fp + tn + fn))
            .withColumn("prec", ratio(tp, tp + fp))
            .withColumn("rec", ratio(tp, tp + fn))
            .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
            .withColumn("fpr", ratio(fp, fp + tn)))


def predict(scores: DataFrame, thresholds: DataFrame | float, keys: list[str] = MODEL) -> DataFrame:
    """Add ``threshold`` and the boolean ``hit`` (score >= threshold, NULL scores count as 0)."""
    if isinstance(thresholds, DataFrame):
        out = attach(scores, thresholds.select(*keys, "threshold"), keys)
    else:
        out = scores.withColumn("threshold", F.lit(float(thresholds)))
    return out.withColumn("hit", F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)) >= F.col("threshold"))


def confusion(scores: DataFrame, thresholds: DataFrame | float, keys: list[str] = MODEL) -> DataFrame:
    counts = predict(scores, thresholds, keys).groupBy(*keys, "threshold").agg(
        *[c.alias(n) for n, c in _counts(F.col("hit"), F.col("y")).items()])
    return with_measures(counts)


def sweep_at(scores: DataFrame, cut_values: DataFrame, percents: list[float], keys: list[str] = MODEL) -> DataFrame:
    """Confusion measures at each of the thresholds of a key, in one pass over the scores.

    ``cut_values`` holds one array per key, aligned with ``percents``.
    """
    rows = attach(scores, cut_values, keys, "inner")
    aggs = [F.max("values").alias("_v")]
    for i in range(len(percents)):
        hit = F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)) >= F.col("values")[i]
        aggs.append(F.struct(*[c.alias(n) for n, c in _counts(hit, F.col("y")).items()]).alias(f"_m{i}"))
    wide = rows.groupBy(*keys).agg(*aggs)
    listed = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(float(p)).alias("percentile"),
                                F.col("_v")[i].alias("threshold"), F.col(f"_m{i}.tp"), F.col(f"_m{i}.fp"),
                                F.col(f"_m{i}.tn"), F.col(f"_m{i}.fn")) for i, p in enumerate(percents)])
    return with_measures(wide.select(*keys, F.explode(listed).alias("s")).select(*keys, "s.*"))


def threshold_sweep(scores: DataFrame, percents: list[float] = SWEEP, keys: list[str] = MODEL,
                    calibration: DataFrame | None = None) -> DataFrame:
    """Measures at percentiles of the healthy scores - of the same rows, or of ``calibration`` if given."""
    base = scores if calibration is None else calibration
    return sweep_at(scores, exact_percentiles(base.where("y = 0"), keys, "score", percents), percents, keys)


def best_of_sweep(sweep: DataFrame, keys: list[str] = MODEL) -> DataFrame:
    """Row with the best F1, the first in list order on ties."""
    best = F.max_by(F.struct("percentile", "threshold", "prec", "rec", "f1", "fpr"), F.struct("f1", -F.col("rank")))
    return sweep.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def calibrate(train_healthy: DataFrame, test: DataFrame, percents: list[float] = CALIBRATION,
              keys: list[str] = MODEL) -> DataFrame:
    """Threshold per model: the healthy-training percentile with the best F1 on test, the lowest on ties.

    If no threshold finds anything, threshold and percentile are 0.
    """
    return calibrate_at(exact_percentiles(train_healthy, keys, "score", percents), test, percents, keys)


def calibrate_sketched(sketches: DataFrame, test: DataFrame, percents: list[float] = CALIBRATION,
                       keys: list[str] = MODEL) -> DataFrame:
    """``calibrate`` from stored sketches of healthy-training scores (``curves.score_sketches``), which are not read again."""
    return calibrate_at(sketched_percentiles(sketches, percents, keys), test, percents, keys)


def calibrate_at(values: DataFrame, test: DataFrame, percents: list[float], keys: list[str] = MODEL) -> DataFrame:
    """The best of given thresholds: ``values`` holds an array per key in the order of ``percents``."""
    best = best_of_sweep(sweep_at(test, values, percents, keys), keys)
    none = F.col("f1") <= 0
    return best.select(*keys, F.when(none, 0.0).otherwise(F.col("percentile")).alias("percentile"),
                       F.when(none, 0.0).otherwise(F.col("threshold")).alias("threshold"), "f1")


def score_stats(train_healthy: DataFrame, thresholds: DataFrame, keys: list[str] = MODEL) -> DataFrame:
    """threshold, mean_val, p95, p99 per model."""
    tails = exact_percentiles(train_healthy, keys, "score", [95, 99])
    means = train_healthy.groupBy(*keys).agg(F.avg("score").alias("mean_val"))
    return (thresholds.select(*keys, "threshold").join(means, keys).join(tails, keys)
            .select(*keys, "threshold", "mean_val", F.col("values")[0].alias("p95"), F.col("values")[1].alias("p99")))


def classification_report(scores: DataFrame, thresholds: DataFrame | float, keys: list[str] = MODEL) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted average."""
    c = confusion(scores, thresholds, keys)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    healthy = [ratio(tn, tn + fn), ratio(tn, tn + fp), ratio(2 * tn, 2 * tn + fp + fn), tn + fp]
    anomalous = [ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn), tp + fn]
    total = tp + fp + tn + fn

    def row(name: str, p: Column, r: Column, f: Column, n: Column) -> Column:
        return F.struct(F.lit(name).alias("label"), p.alias("prec"), r.alias("rec"), f.alias("f1"),
                        n.cast("bigint").alias("support"))

    macro = [(a + b) / 2 for a, b in zip(healthy[:3], anomalous[:3])]
    weighted = [ratio(a * healthy[3] + b * anomalous[3], total) for a, b in zip(healthy[:3], anomalous[:3])]
    acc = ratio(tp + tn, total)
    rows = F.array(row("Healthy", *healthy), row("Anomalous", *anomalous), row("accuracy", acc, acc, acc, total),
                   row("macro avg", *macro, total), row("weighted avg", *weighted, total))
    return c.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def fault_breakdown(scores: DataFrame, thresholds: DataFrame | float, keys: list[str] = MODEL) -> DataFrame:
    """Per fault type: windows, detected, recall; with the recall over all known faults of the model."""
    per_fault = predict(known_anomalies(scores), thresholds, keys).groupBy(*keys, "fault_type").agg(
        F.count(F.lit(1)).alias("total_windows"), F.count_if("hit").alias("detected"))
    overall = per_fault.groupBy(*keys).agg((F.sum("detected") / F.sum("total_windows")).alias("overall_recall"))
    return (per_fault.withColumn("recall", F.col("detected") / F.col("total_windows"))
            .join(overall, keys).select(*keys, "fault_type", "total_windows", "detected", "recall", "overall_recall"))


def detection_blocks(scores: DataFrame, thresholds: DataFrame | float, step: float = 10.0, keys: list[str] = MODEL,
                     order: list[str] = ["ts"], chunk: Column | None = None) -> DataFrame:
    """One row per run of anomalous windows: first fault, windows, seconds to the first detection (or NULL).

    A run is named by the last healthy row before it, so neither the row numbers nor the runs need a row of
    another chunk: both come in with the chunk summary.
    """
    rows = predict(scores, thresholds, keys).withColumn("_chunk", time_chunk("ts") if chunk is None else chunk)
    key = F.struct(*order)
    calm = F.when(F.col("y") == 0, key)
    rows = carry_in(rows, keys, "_chunk", {"_n": F.count(F.lit(1)), "_calm": F.max(calm)},
                    {"_before": lambda w: F.coalesce(F.sum("_n").over(w), F.lit(0)),
                     "_calm_before": lambda w: F.max("_calm").over(w)})
    here = inside(keys, "_chunk", order)
    rows = rows.withColumn("_pos", F.col("_before") + F.count(F.lit(1)).over(here))
    rows = rows.withColumn("_run", F.greatest(F.max(calm).over(here), F.col("_calm_before")))
    first = F.min("_pos")
    return (rows.where(F.col("y") == 1).groupBy(*keys, "_run").agg(
                F.min_by("fault_type", "_pos").alias("fault_type"), F.count(F.lit(1)).alias("n_windows"),
                first.alias("first_pos"),
                ((F.min(F.when(F.col("hit"), F.col("_pos"))) - first) * F.lit(float(step))).alias("latency_s"))
            .drop("_run"))


def time_to_detect(scores: DataFrame, thresholds: DataFrame | float, keys: list[str] = MODEL, **kw) -> DataFrame:
    blocks = detection_blocks(scores, thresholds, keys=keys, **kw)
    return summarize_blocks(blocks, keys)


def summarize_blocks(blocks: DataFrame, keys: list[str] = MODEL) -> DataFrame:
    """Events, detected events and their share, mean and median seconds to detect."""
    blocks = stage(blocks.select(*keys, "latency_s"), "blocks")
    sums = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.count("latency_s").alias("n_detected"),
                                     F.avg("latency_s").alias("mean_ttd_s"))
    medians = exact_percentiles(blocks, keys, "latency_s", [50])
    return (sums.join(medians, keys, "left")
            .select(*keys, "n_events", "n_detected", ratio(F.col("n_detected"), F.col("n_events")).alias("detected_share"),
                    "mean_ttd_s", F.col("values")[0].alias("median_ttd_s")))


def time_to_detect_by_fault(scores: DataFrame, thresholds: DataFrame | float, keys: list[str] = MODEL, **kw) -> DataFrame:
    blocks = detection_blocks(scores, thresholds, keys=keys, **kw)
    return blocks.where("latency_s IS NOT NULL").groupBy(*keys, "fault_type").agg(
        F.avg("latency_s").alias("mean_s"), F.min("latency_s").alias("min_s"), F.max("latency_s").alias("max_s"),
        F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, col: str, bins: int, keys: list[str] = ["model", "y"], density: bool = False) -> DataFrame:
    """Equal-width bins between each key's own minimum and maximum, the last one closed; empty bins count 0."""
    rows = df.where(F.col(col).isNotNull())
    edges = rows.groupBy(*keys).agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"),
                                    F.count(F.lit(1)).alias("_all"))
    flat = F.col("lo") == F.col("hi")
    edges = edges.withColumns({"lo": F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")),
                               "hi": F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))})
    edges = edges.withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    at = F.least(F.floor((F.col(col) - F.col("lo")) / F.col("width")), F.lit(bins - 1).cast("bigint"))
    counts = attach(rows, edges, keys).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    slots = edges.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    out = slots.join(counts, [*keys, "bin"], "left")
    value = (n / (F.col("_all") * F.col("width"))) if density else n
    return out.select(*keys, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"),
                      value.alias("density" if density else "n"))


def prevalence(scores: DataFrame, keys: list[str] = MODEL) -> DataFrame:
    return scores.groupBy(*keys).agg(F.avg(F.col("y").cast("double")).alias("prevalence"))


def model_comparison(scores: DataFrame, thresholds: DataFrame | float, keys: list[str] = MODEL) -> DataFrame:
    """One row per model: accuracy, precision, recall, F1, ROC area, average precision."""
    fixed = confusion(scores, thresholds, keys).select(*keys, "accuracy", "prec", "rec", "f1")
    return fixed.join(curve_areas(scores, keys).drop("pr_auc"), keys)
