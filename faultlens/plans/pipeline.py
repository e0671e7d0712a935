"""The batch chains: fuse metrics, logs and labels; features to scores; scores to a full evaluation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.operators.clean import (align_schema, feature_names, fill_partial, normalize_nodes, normalize_ts,
                                       shift_to_metric_day)
from faultlens.operators.evaluate import calibrate, model_comparison, score_stats
from faultlens.operators.grid import fuse_logs, log_counts
from faultlens.operators.intervals import label, pair_intervals
from faultlens.operators.ordered import time_chunk, with_position
from faultlens.operators.scaling import double_scale
from faultlens.operators.sequence import sliding_windows, window_label
from faultlens.plans.models import PcaReconstructor, healthy_only, row_mean, score_windows, stratified_split, window_moments
from faultlens.schemas import FEATURES, STEP_SECONDS
from faultlens.session import stage


def fuse(metrics: DataFrame, logs: DataFrame, events: DataFrame, step: int = STEP_SECONDS, keys: list[str] = ["series_id"],
         pad: float = 30.0, default: float = 120.0, chunk: Column | None = None, shift_days: bool = False) -> DataFrame:
    """Fused feature table: the 21 slots, ground_truth, fault_type. Both labels come from one join.

    Events come raw: their nodes get the present names and their times are floored to the step, with ``shift_days``
    after a move by whole days to the first metric day.
    """
    events = normalize_nodes(events)
    events = shift_to_metric_day(events, metrics, step) if shift_days else normalize_ts(events, "ts", step)
    slots = align_schema(fill_partial(metrics), FEATURES, keep=[*keys, "ts"])
    fused = fuse_logs(slots, log_counts(logs, step, keys), keys)
    intervals = pair_intervals(events, keys, pad, default, chunk=chunk)
    labelled = label(fused, intervals, keys, step)
    return labelled.select(*keys, "ts", *FEATURES, "ground_truth", "fault_type")


def train_and_score(fused: DataFrame, k: int = 16, share: float = 0.3, keys: list[str] = ["series_id"],
                    chunk: Column | None = None, layout: str = "contiguous", path: str | None = None, train: Column | None = None,
                    kinds: tuple[str, ...] = ("pca", "mean", "persistence"), step: int | None = None) -> dict:
    """Features, windows, split, fit on healthy training windows, scores of several models, thresholds, comparison.

    By default windows are split at random by class, scalers see all healthy rows and thresholds are chosen on the test part, as
    in the procedure that this follows. ``train``, a condition on the rows, splits honestly: scalers see its rows alone, a window is
    training if all its rows are, test if none is, and takes no part otherwise; thresholds are chosen on training windows.

    The split is made on keys and labels. Its mark goes to the rows before windows are built, so that no window of all inputs
    is shuffled. Rows with their positions and scores are written once, as the fits, the calibration and the reports each read
    them again. Windows hold each row ten times and are never written: each fit builds them, and one pass scores all models.
    """
    fused = stage(fused if train is None else fused.withColumn("_train", train.cast("int")))
    healthy = F.col("ground_truth") == 0
    features, level, combined = double_scale(fused, FEATURES, keys, chunk=chunk, step=step,
                                             healthy=healthy if train is None else healthy & (F.col("_train") == 1))
    inputs = feature_names(FEATURES)
    if train is None:
        labels = stratified_split(window_label(fused, keys=keys, chunk=chunk), share, [*keys, "win_id"]).select(*keys, "ts", "part")
        marked = features.join(stage(labels), [*keys, "ts"], "left")
        part = lambda w: F.last("part").over(w)
    else:
        marked = features
        part = lambda w: F.when(F.min("_train").over(w) == 1, "train").when(F.max("_train").over(w) == 0, "test")
    rows = marked.select(*dict.fromkeys([*keys, "ts", *inputs, "ground_truth", "fault_type", "part" if train is None else "_train"]))
    placed = stage(with_position(rows, keys, ["ts"], time_chunk("ts") if chunk is None else chunk, "_pos"))
    windows = sliding_windows(placed, inputs, keys=keys, pos="_pos", also={"part": part}).where("part IS NOT NULL")
    fit_on = healthy_only(windows.where("part = 'train'"))
    known = window_moments(fit_on, rows=True) if {"pca", "mean"} <= {*kinds} and path is None else None
    models = {kind: reconstruction(fit_on, kind, k, path, known) for kind in kinds}
    scored = score_windows(windows, xhat=models, width=len(inputs), layout=layout)
    scores = stage(scored.select(*keys, "win_id", "ts", "y", "fault_type", "part", "model", "score"))
    healthy_train, test = scores.where("part = 'train' AND y = 0"), scores.where("part = 'test'")
    thresholds = stage(calibrate(healthy_train, test if train is None else scores.where("part = 'train'")))
    return {"scores": scores, "thresholds": thresholds, "stats": score_stats(healthy_train, thresholds),
            "comparison": model_comparison(test, thresholds), "level_scaler": level, "combined_scaler": combined}


def reconstruction(fit_on: DataFrame, kind: str, k: int, path: str | None = None, known: tuple | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """How a model rebuilds windows: PCA, the mean row of the windows fitted on, or each row's predecessor in its window.

    ``known`` is what ``window_moments`` says of the windows, with their mean row; without it each model takes its own pass.
    """
    if kind == "pca":
        return PcaReconstructor.fit(fit_on, k, path=path, moments=known and known[:3]).rebuild
    if kind == "mean":
        row = row_mean(fit_on).first()["m"] if known is None else known[3]
        if row is None:
            raise ValueError("no healthy training window to take a mean of")
        mean = row.toArray() if known is None else row
        return lambda x: np.broadcast_to(mean, x.shape)
    if kind == "persistence":
        return lambda x: np.concatenate([x[:, :1], x[:, :-1]], axis=1)
    raise ValueError(f"unknown kind {kind!r}: pca, mean, persistence")
