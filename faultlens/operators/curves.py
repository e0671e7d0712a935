"""Exact percentiles and threshold curves over scores, without a global sort in one task.

Scores are first reduced to distinct values with counts, written once. The value axis is cut at approximate quantiles that
the driver fetches once (a list of at most one number per shuffle partition); counts before each cut are
handed on between the parts. The cuts only balance the work: results do not depend on where they lie.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.operators.ordered import carry_in
from faultlens.session import shuffle_partitions, stage

MODEL = ["model"]


def cut_points(df: DataFrame, col: str, parts: int | None = None) -> list[float]:
    parts = parts or max(2, shuffle_partitions(df.sparkSession))
    probs = [i / parts for i in range(1, parts)]
    value = F.col(col).cast("double")
    plain = F.abs(value) < float("inf")
    found = df.agg(F.percentile_approx(F.when(plain, value), probs, max(1_000, 10 * parts))).first()[0] or []
    return sorted(set(found))


def bucketed(df: DataFrame, col: str, cuts: list[float], name: str = "_bucket") -> DataFrame:
    if not cuts:
        return df.withColumn(name, F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol=col, outputCol=name, handleInvalid="keep").transform(df)


def value_counts(df: DataFrame, keys: list[str], col: str, **sums: Column) -> DataFrame:
    return (df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).cast("double").alias(col))
            .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()]))


#: Size of the quantile sketches; at 800 the rank of a percentile is wrong by less than half a percent.
SKETCH_K = 800


def exact_percentiles(df: DataFrame, keys: list[str], col: str, percents: list[float],
                      name: str = "values", cuts: list[float] | None = None) -> DataFrame:
    """ARRAY of linearly interpolated percentiles per key."""
    counts = stage(value_counts(df, keys, col), "counts")
    counts = bucketed(counts, col, cut_points(counts, col) if cuts is None else cuts)
    everything = Window.partitionBy(*keys)
    placed = carry_in(counts, keys, "_bucket", {"_part": F.sum("n")},
                      {"_before": lambda w: F.coalesce(F.sum("_part").over(w), F.lit(0)),
                       "_all": lambda w: F.sum("_part").over(everything)})
    here = Window.partitionBy(*keys, "_bucket").orderBy(col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.col("_before") + F.sum("n").over(here)
    placed = placed.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("n"))

    def at(index: Column) -> Column:
        return F.max(F.when((index >= F.col("_first")) & (index < F.col("_last")), F.col(col)))

    aggs = [F.max("_all").alias("_all")]
    for i, p in enumerate(percents):
        h = (F.col("_all") - 1) * F.lit(p / 100)
        aggs += [at(F.floor(h)).alias(f"_lo{i}"), at(F.ceil(h)).alias(f"_hi{i}")]
    found = placed.groupBy(*keys).agg(*aggs)
    values = []
    for i, p in enumerate(percents):
        h = (F.col("_all") - 1) * F.lit(p / 100)
        values.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (h - F.floor(h)))
    return found.select(*keys, F.array(*values).alias(name))


def healthy_percentiles(scores: DataFrame, percents: list[float], keys: list[str] = MODEL,
                        method: str = "exact", where: Column | None = None) -> DataFrame:
    """Percentiles of the healthy scores per model, one row per (model, percentile). NaN counts as 0, NULL not at all."""
    rows = scores.where((F.col("y") == 0) if where is None else where).withColumn("score", F.nanvl("score", F.lit(0.0)))
    if method == "approx":
        found = rows.groupBy(*keys).agg(F.percentile_approx("score", [p / 100 for p in percents]).alias("values"))
    else:
        found = exact_percentiles(rows, keys, "score", percents)
    return (found.select(*keys, F.posexplode("values").alias("rank", "threshold"))
            .withColumn("percentile", F.element_at(F.array(*[F.lit(float(p)) for p in percents]), F.col("rank") + 1)))


def score_sketches(scores: DataFrame, keys: list[str] = MODEL, k: int = SKETCH_K) -> DataFrame:
    """``(keys, sketch)``: one KLL sketch of the scores per key, made by partial aggregation; NaN counts as 0, NULL not at all.

    Sketches of days or runs (named among ``keys``) can be stored and merged later; their rows are not read again.
    """
    rows = scores.where("score IS NOT NULL").withColumn("score", F.nanvl("score", F.lit(0.0)))
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double("score", F.lit(k)).alias("sketch"))


def sketched_percentiles(sketches: DataFrame, percents: list[float], keys: list[str] = MODEL, k: int = SKETCH_K) -> DataFrame:
    """``(keys, values)`` like ``exact_percentiles``, of all sketches of a key merged. Values are scores that occurred."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    values = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p) / 100)) for p in percents])
    return merged.select(*keys, values.alias("values"))


def curve_points(scores: DataFrame, keys: list[str] = MODEL, cuts: list[float] | None = None,
                 y: str = "y", col: str = "score", ends: bool = False) -> DataFrame:
    """One point per distinct score: everything at or above it is called anomalous.

    ``ends`` adds the point at which nothing is: threshold NULL, the start (0, 0) of the ROC curve and the end of the PR curve with
    recall 0 and precision 1. A summary of a curve counts areas from point to point and needs it only for drawing.

    Columns: threshold, tp, fp, d_tp/d_fp (the step this point adds), n_pos, n_neg, tpr, fpr, prec, rec.
    NULL scores count as 0.
    """
    rows = scores.withColumn(col, F.coalesce(F.nanvl(F.col(col), F.lit(0.0)), F.lit(0.0)))
    counts = stage(value_counts(rows, keys, col, d_tp=F.col(y).cast("bigint")), "counts")
    counts = bucketed(counts, col, cut_points(counts, col) if cuts is None else cuts)
    counts = counts.withColumn("d_fp", F.col("n") - F.col("d_tp"))
    everything = Window.partitionBy(*keys)
    zero = F.lit(0).cast("bigint")
    out = carry_in(counts, keys, "_bucket", {"_p": F.sum("d_tp"), "_q": F.sum("d_fp")},
                   {"_tp": lambda w: F.coalesce(F.sum("_p").over(w), zero),
                    "_fp": lambda w: F.coalesce(F.sum("_q").over(w), zero),
                    "n_pos": lambda w: F.sum("_p").over(everything),
                    "n_neg": lambda w: F.sum("_q").over(everything)}, backwards=True)
    here = (Window.partitionBy(*keys, "_bucket").orderBy(F.col(col).desc())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.withColumns({"tp": F.col("_tp") + F.sum("d_tp").over(here), "fp": F.col("_fp") + F.sum("d_fp").over(here)})

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))

    if ends:
        # The totals are the same in all rows of a key; one row of each gives its end point.
        last = counts.groupBy(*keys).agg(F.sum("d_tp").alias("n_pos"), F.sum("d_fp").alias("n_neg")).select(
            *keys, F.lit(None).cast(out.schema[col].dataType).alias(col), *[zero.alias(c) for c in ("tp", "fp", "d_tp", "d_fp")], "n_pos", "n_neg")
        out = out.select(*last.columns).unionByName(last)
    return out.select(*keys, F.col(col).alias("threshold"), "tp", "fp", "d_tp", "d_fp", "n_pos", "n_neg",
                      share("tp", "n_pos").alias("tpr"), share("fp", "n_neg").alias("fpr"),
                      F.when(F.col("tp") + F.col("fp") == 0, F.lit(1.0)).otherwise(F.col("tp") / (F.col("tp") + F.col("fp"))).alias("prec"),
                      share("tp", "n_pos").alias("rec"))


def roc_area() -> Column:
    """Aggregate over curve points: trapezoids under (fpr, tpr); 0 if one class is missing."""
    step = F.col("d_fp") * (F.col("tp") + F.col("tp") - F.col("d_tp")) / 2
    scale = F.max(F.col("n_pos") * F.col("n_neg").cast("double"))
    return F.when(scale > 0, F.sum(step) / scale).otherwise(0.0)


def average_precision_area() -> Column:
    gain = F.when(F.col("n_pos") == 0, F.lit(0.0)).otherwise(F.col("d_tp") / F.col("n_pos"))
    return F.sum(gain * F.col("prec"))


def pr_trapezoid_area() -> Column:
    seen = F.col("tp") - F.col("d_tp") + F.col("fp") - F.col("d_fp")
    earlier = F.when(seen == 0, F.lit(1.0)).otherwise((F.col("tp") - F.col("d_tp")) / F.when(seen == 0, F.lit(1)).otherwise(seen))
    gain = F.when(F.col("n_pos") == 0, F.lit(0.0)).otherwise(F.col("d_tp") / F.col("n_pos"))
    return F.sum(gain * (F.col("prec") + earlier) / 2)


def roc_auc(scores: DataFrame, keys: list[str] = MODEL, **kw) -> DataFrame:
    return curve_points(scores, keys, **kw).groupBy(*keys).agg(roc_area().alias("roc_auc"))


def average_precision(scores: DataFrame, keys: list[str] = MODEL, **kw) -> DataFrame:
    return curve_points(scores, keys, **kw).groupBy(*keys).agg(average_precision_area().alias("average_precision"))


def pr_auc_trapezoid(scores: DataFrame, keys: list[str] = MODEL, **kw) -> DataFrame:
    return curve_points(scores, keys, **kw).groupBy(*keys).agg(pr_trapezoid_area().alias("pr_auc"))


def curve_areas(scores: DataFrame, keys: list[str] = MODEL, **kw) -> DataFrame:
    """All three areas from one pass over the curve."""
    return curve_points(scores, keys, **kw).groupBy(*keys).agg(
        roc_area().alias("roc_auc"), average_precision_area().alias("average_precision"),
        pr_trapezoid_area().alias("pr_auc"))


def best_f1_point(scores: DataFrame, keys: list[str] = MODEL, **kw) -> DataFrame:
    """Point with the largest 2PR/(P+R+1e-9); the lowest threshold on ties."""
    f1 = 2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec") + 1e-9)
    pts = curve_points(scores, keys, **kw).withColumn("f1", f1)
    best = F.max_by(F.struct("threshold", "prec", "rec", "f1"), F.struct("f1", -F.col("threshold")))
    return pts.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")
