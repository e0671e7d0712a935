"""From a fit to the live job: scalers, model and threshold as one stored version, switched atomically.

A version is written completely before the manifest names it, and the manifest is replaced by a rename. A live job thus
sees the old version or the new one, never a mixture, and takes a new one over between two micro-batches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from faultlens.operators.curves import exact_percentiles
from faultlens.operators.scaling import double_scale, fit_scaler, scaler_values
from faultlens.operators.scoring import window_scores
from faultlens.operators.sequence import sliding_windows, window_inputs
from faultlens.plans.models import PcaReconstructor, healthy_only
from faultlens.schemas import CLIP, WINDOW_ROWS
from faultlens.session import stage

_MANIFEST = "manifest.json"
Pairs = list[tuple[float, float]]


@dataclass(frozen=True)
class Bundle:
    """Fitted numbers: (mean, scale) per level and per level and change, the model, the alarm threshold.

    ``kind`` is ``mean`` (every step is the healthy mean of its inputs) or ``pca`` (mean and components of flat windows).
    ``nodes`` lists the inputs of each node, by place among levels and changes.
    """

    cols: list[str]
    level: Pairs
    combined: Pairs
    nodes: list[list[int]]
    kind: str
    mean: list[float]
    components: list[list[float]]
    threshold: float
    size: int = WINDOW_ROWS

    def reconstruct(self, x: np.ndarray) -> np.ndarray:
        """Model output of scaled windows (…, size, inputs)."""
        if self.kind == "mean":
            return np.broadcast_to(np.array(self.mean), x.shape)
        flat, mean, comp = x.reshape(*x.shape[:-2], -1), np.array(self.mean), np.array(self.components)
        return ((flat - mean) @ comp @ comp.T + mean).reshape(x.shape)

    def errors(self, raw: np.ndarray) -> np.ndarray:
        """Error per input of raw windows (…, size, columns): two-pass scaling inside each window, then the model."""
        m1, s1 = (np.array(v) for v in zip(*self.level))
        m2, s2 = (np.array(v) for v in zip(*self.combined))
        z = np.nan_to_num(np.clip((raw - m1) / s1, -CLIP, CLIP), nan=0.0)
        both = np.concatenate((z, np.diff(z, axis=-2, prepend=z[..., :1, :])), axis=-1)
        x = np.nan_to_num(np.clip((both - m2) / s2, -CLIP, CLIP), nan=0.0)
        return ((x - self.reconstruct(x)) ** 2).mean(axis=-2)


#: Windows that are scored at once: their cells stay in a core's cache.
SCORE_ROWS = 1_024


def _inputs(raw: np.ndarray, bundle: Bundle) -> np.ndarray:
    """``window_inputs`` of windows (n, size, columns): a cell that is no number gets the upper bound, as ``least`` passes it over."""
    def scaled(x: np.ndarray, pairs: Pairs) -> np.ndarray:
        mean, scale = (np.array(v) for v in zip(*pairs))
        return np.clip(np.nan_to_num((x - mean) / scale, nan=CLIP, posinf=CLIP, neginf=-CLIP), -CLIP, CLIP)
    z = scaled(raw, bundle.level)
    return scaled(np.concatenate((z, np.diff(z, axis=1, prepend=z[:, :1])), axis=2), bundle.combined)


def score_raw_windows(windows: DataFrame, bundle: Bundle, col: str = "win", keep: list[str] | None = None) -> DataFrame:
    """The same errors and scores as the live job, for batch windows of raw values; adds err, node_err and score.

    ``keep`` names the columns that are wanted, all if it is absent; the others do not come back from the Python process.
    """
    added = {"err": T.ArrayType(T.DoubleType()), "node_err": T.ArrayType(T.DoubleType()), "score": T.DoubleType()}
    kinds = {f.name: f.dataType for f in windows.schema.fields if f.name not in added} | added
    shape = T.StructType([T.StructField(n, kinds[n]) for n in (kinds if keep is None else keep)])
    read = windows.select(col, *[n for n in shape.names if n not in added and n != col])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch[col].flatten().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(batch.num_rows, bundle.size, -1)
            found = {n: [] for n in added}
            for at in range(0, len(raw), SCORE_ROWS):
                x = _inputs(raw[at:at + SCORE_ROWS], bundle)
                err, nodes, score = window_scores(x, bundle.reconstruct(x), bundle.nodes, parts=True)
                for n, values in zip(added, (err, nodes, score)):
                    found[n].append(values)
            arrays = {n: np.concatenate(v) for n, v in found.items()} if len(raw) else {"err": np.empty((0, 1)), "node_err": np.empty((0, 1)), "score": np.empty(0)}
            out = {n: pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], pa.array(v.ravel())) if v.ndim > 1 else pa.array(v)
                   for n, v in arrays.items()}
            yield pa.record_batch([out[n] if n in out else batch[n] for n in shape.names], shape.names)

    return read.mapInArrow(scored, shape)


def fit_bundle(rows: DataFrame, cols: list[str], nodes: list[list[int]], kind: str = "mean", k: int = 8, percentile: float = 85.0,
               size: int = WINDOW_ROWS, keys: list[str] = ["series_id"], train: Column | None = None,
               step: int | None = None, pos: str | None = None) -> Bundle:
    """Fit scalers, model and threshold on the healthy rows of ``train`` (a condition on the rows; all by default).

    Nothing that ``train`` leaves out is seen by any fit: a window counts for the threshold only if all its rows belong to
    it. The threshold is the percentile of the healthy windows' scores. ``step`` as in ``delta``; ``pos`` names a column with each
    row's position in its series. Rows that are a staged table already are not written again, and windows only where two passes read them.
    """
    mine = rows.withColumn("_train", (F.lit(True) if train is None else train).cast("int"))
    rows = mine if train is None and getattr(rows, "staged_at", None) else stage(mine)
    healthy = (F.col("ground_truth") == 0) & (F.col("_train") == 1)
    features, level, combined = double_scale(rows, cols, keys, healthy=healthy, step=step)
    inputs = [*cols, *[c + "_delta" for c in cols]]
    pairs = lambda found, names: [found[n] for n in names]
    known = dict(cols=cols, level=pairs(level, cols), combined=pairs(combined, inputs), nodes=nodes, size=size, threshold=0.0)
    odd = rows.withColumn("_odd", F.greatest("ground_truth", 1 - F.col("_train")))
    windows = healthy_only(sliding_windows(odd, cols, size, keys, pos=pos, y="_odd", fault=None))
    if kind == "mean":
        means = scaler_values(fit_scaler(features, inputs, healthy))
        bundle = Bundle(**known, kind=kind, mean=[means[n][0] for n in inputs], components=[])
    elif kind == "pca":
        windows = stage(windows)
        scaled = windows.select(window_inputs(F.col("win"), known["level"], known["combined"]).alias("win"))
        model = PcaReconstructor.fit(scaled, k)
        bundle = Bundle(**known, kind=kind, mean=model.mean.tolist(), components=model.components.tolist())
    else:
        raise ValueError(f"unknown kind {kind!r}: mean, pca")
    scored = stage(score_raw_windows(windows, bundle, keep=["score"]).select(F.lit("live").alias("model"), "score"))
    found = exact_percentiles(scored, ["model"], "score", [percentile]).first()
    return Bundle(**{**bundle.__dict__, "threshold": float(found["values"][0]) if found else 0.0})


def publish(spark: SparkSession, bundle: Bundle, folder: str) -> str:
    """Write a version into the folder and make it the present one. Returns its name."""
    version = uuid.uuid4().hex
    schema = ("cols array<string>, level array<array<double>>, combined array<array<double>>, nodes array<array<int>>, kind string, "
              "mean array<double>, components array<array<double>>, threshold double, size int")
    row = {**bundle.__dict__, "level": [list(p) for p in bundle.level], "combined": [list(p) for p in bundle.combined]}
    spark.createDataFrame([row], schema).write.parquet(f"{folder}/{version}")
    jvm = spark._jvm.org.apache.hadoop.fs
    target, draft = jvm.Path(f"{folder}/{_MANIFEST}"), jvm.Path(f"{folder}/{_MANIFEST}.{version}")
    out = draft.getFileSystem(spark._jsc.hadoopConfiguration()).create(draft, True)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    options = spark._sc._gateway.new_array(jvm.Options.Rename, 1)
    options[0] = jvm.Options.Rename.OVERWRITE
    jvm.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, options)
    return version


def current_version(spark: SparkSession, folder: str) -> str | None:
    """The version that the manifest names; none where nothing was published."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{_MANIFEST}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return json.loads(spark.read.text(at.toString(), wholetext=True).first()["value"])["version"]


def load_bundle(spark: SparkSession, folder: str, version: str | None = None) -> Bundle:
    version = version or current_version(spark, folder)
    if version is None:
        raise FileNotFoundError(f"no bundle was published in {folder}")
    row = spark.read.parquet(f"{folder}/{version}").first().asDict()
    return Bundle(**{**row, "level": [tuple(p) for p in row["level"]], "combined": [tuple(p) for p in row["combined"]]})


def load_or_fit_bundle(rows: DataFrame, folder: str, cols: list[str], nodes: list[list[int]], **kw) -> Bundle:
    """The present version if it was fitted for the same columns, nodes and kind of model, else a new one, published."""
    spark = rows.sparkSession
    if current_version(spark, folder):
        kept = load_bundle(spark, folder)
        same_size = kept.kind != "pca" or len(kept.components[0]) == kw.get("k", 8)
        if (kept.cols, kept.nodes, kept.kind, kept.size) == (cols, nodes, kw.get("kind", "mean"), kw.get("size", WINDOW_ROWS)) and same_size:
            return kept
    publish(spark, fit_bundle(rows, cols, nodes, **kw), folder)
    return load_bundle(spark, folder)


def follow(spark: SparkSession, folder: str, start: Callable[[Bundle], StreamingQuery], poll: float = 8.0) -> None:
    """Run a live query and restart it from its checkpoint whenever another version is published; ends when the query ends.

    ``start`` gets the bundle and starts the query. State lives in the checkpoint, and a micro-batch that a restart cuts off
    is run again as a whole, so a batch is scored by one version.
    """
    version, query = None, None
    while True:
        now = current_version(spark, folder)
        if now != version:
            if query is not None:
                query.stop()
            version, query = now, start(load_bundle(spark, folder, now))
        if query.awaitTermination(poll):
            return
