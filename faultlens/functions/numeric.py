"""Numeric Column expressions: guards, scaling, severity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlens.schemas import CLIP

_INF = float("inf")


def finite(x: Column, nan: float = 0.0, pos: float = CLIP, neg: float = -CLIP) -> Column:
    """Replace NULL/NaN and the infinities."""
    return (F.when(x.isNull() | F.isnan(x), F.lit(nan))
            .when(x == _INF, F.lit(pos))
            .when(x == -_INF, F.lit(neg))
            .otherwise(x))


def scale_clip(x: Column, mean: Column, scale: Column, clip: float = CLIP) -> Column:
    """z-score cut to ±clip. least/greatest skip NULL, so a missing z is set to 0 first."""
    z = F.coalesce(F.nanvl((x - mean) / scale, F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.least(z, F.lit(clip)), F.lit(-clip))


def fill_from_mean(x: Column, mean: Column) -> Column:
    return F.coalesce(x, mean, F.lit(0.0))


def severity(score: Column, threshold: Column) -> Column:
    return (F.when(score < threshold, "NORMAL")
            .when(score < 1.5 * threshold, "LOW")
            .when(score < 2.0 * threshold, "MEDIUM")
            .otherwise("HIGH"))


def confidence(score: Column, threshold: Column) -> Column:
    return F.when(threshold > 0, F.least(F.lit(1.0), score / (2.0 * threshold))).otherwise(F.lit(1.0))


def ratio(num: Column, den: Column) -> Column:
    """num/den as DOUBLE, 0 where den is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def seconds_after(ts: Column, seconds: Column) -> Column:
    """Time stamp moved by a possibly fractional number of seconds."""
    return F.timestamp_micros(F.unix_micros(ts) + (seconds.cast("double") * 1e6).cast("bigint"))


def floor_ts(ts: Column, step: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / F.lit(step)) * step)


def slot_of(ts: Column, step: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(step))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body or a pushed-down filter uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
