"""Standard scaling fitted on healthy rows, and the two-pass level-and-change features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions.numeric import finite, scale_clip
from faultlens.operators.clean import pad_count
from faultlens.operators.sequence import delta
from faultlens.schemas import CLIP, NODES
from faultlens.session import stage

#: Spacing of doubles at 1.0; decides when a variance is rounding noise.
_EPS = 2.220446049250313e-16


def fit_scaler(df: DataFrame, cols: list[str], where: Column | None = None) -> DataFrame:
    """(feature, mean, scale) over the given rows: mean and population deviation, one pass for all columns.

    A column without variance, or with no more than rounding noise, gets scale 1. Missing values count as 0,
    infinite ones as ±6.
    """
    rows = df if where is None else df.where(where)
    vector = array_to_vector(F.array(*[finite(F.col(c).cast("double")) for c in cols]))
    stats = rows.select(vector.alias("v")).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s"))
    names = F.array(*[F.lit(c) for c in cols])
    long = stats.where("s.count > 0").select(F.col("s.count").alias("n"), F.explode(F.arrays_zip(
        names.alias("feature"), vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("var"))).alias("f"))
    long = long.select("n", "f.*").withColumn("var", F.col("var") * (F.col("n") - 1) / F.col("n"))
    noise = F.col("n") * _EPS * F.col("var") + F.pow(F.col("n") * F.col("mean") * _EPS, F.lit(2.0))
    return long.select("feature", "mean", F.when(F.col("var") <= noise, 1.0).otherwise(F.sqrt("var")).alias("scale"))


def scaler_values(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    """The fitted numbers on the driver: one row per feature."""
    return {r["feature"]: (r["mean"], r["scale"]) for r in scaler.collect()}


def apply_scaler(df: DataFrame, scaler: DataFrame | dict, cols: list[str], clip: float = CLIP) -> DataFrame:
    """Replace the columns by clipped z-scores. The fitted numbers enter the plan as constants."""
    fitted = _values(scaler)
    return df.withColumns({c: scale_clip(F.col(c), F.lit(fitted[c][0]), F.lit(fitted[c][1]), clip) for c in cols})


def double_scale(df: DataFrame, cols: list[str], keys: list[str] = ["series_id"], order: list[str] = ["ts"],
                 healthy: Column | None = None, chunk: Column | None = None, clip: float = CLIP,
                 scalers: tuple[DataFrame | dict, DataFrame | dict] | None = None, n_nodes: int = len(NODES),
                 cut: Callable[[DataFrame], DataFrame] = stage, step: int | None = None) -> tuple[DataFrame, dict, dict]:
    """Guard, scale, clip, add the change per step, scale and clip both again, pad to the node count.

    Returns (features, level scaler, combined scaler). Pass ``scalers`` to reuse fitted ones. Levels and changes
    are written once by ``cut`` before the second fit, as the fit and every later pass read them. ``step`` as in ``delta``.
    """
    healthy = (F.col("ground_truth") == 0) if healthy is None else healthy
    clean = df.withColumns({c: finite(F.col(c).cast("double")) for c in cols})
    first = _values(scalers[0]) if scalers else scaler_values(fit_scaler(clean, cols, healthy))
    stacked = cut(delta(apply_scaler(clean, first, cols, clip), cols, keys, order, chunk, step=step))
    both = [*cols, *[c + "_delta" for c in cols]]
    second = _values(scalers[1]) if scalers else scaler_values(fit_scaler(stacked, both, healthy))
    out = apply_scaler(stacked, second, both, clip)
    pads = pad_count(len(both), n_nodes)
    return out.withColumns({f"pad_live_{i}": F.lit(0.0) for i in range(pads)}) if pads else out, first, second


def _values(scaler: DataFrame | dict) -> dict[str, tuple[float, float]]:
    return scaler if isinstance(scaler, dict) else scaler_values(scaler)
