"""Reconstruction models over windows: fit on healthy rows, score everything."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import PCAModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions.numeric import finite, let
from faultlens.operators.ordered import with_position
from faultlens.operators.scaling import fit_scaler, scaler_values
from faultlens.operators.scoring import (dot, feature_error, hybrid_score, leaky_relu, node_error, node_slices, softmax_mean,
                                         window_scores, windowed_error)
from faultlens.operators.sequence import delta

SERIES = ["series_id"]


def healthy_only(windows: DataFrame, y: str = "y") -> DataFrame:
    return windows.where(F.col(y) == 0)


def stratified_split(df: DataFrame, share: float = 0.3, key: list[str] = ["win_id"], label: str = "y",
                     name: str = "part") -> DataFrame:
    """Mark ``test`` the same share of every class, by the order of a hash of the key; repeatable.

    The hash prefix cuts each class into even chunks, so a class of any size is ranked in parallel. Rows travel without the hash:
    its characters do not compress, and it is made again where they are ordered.
    """
    tag = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    out = with_position(df, [label], [tag, *key], F.substring(tag, 1, 3), "_pos", total="_all")
    test = F.col("_pos") < F.round(F.col("_all") * F.lit(share))
    return out.withColumn(name, F.when(test, "test").otherwise("train")).drop("_pos", "_all")


def add_noise(windows: DataFrame, sd: float = 0.03, seed: int = 42, col: str = "win") -> DataFrame:
    """Gaussian noise on every cell of the windows; each cell draws its own number from the row's generator."""
    # Box-Muller on two hashes of (row seed, cell): pure expressions, one random number per row.
    noisy = windows.withColumn("_seed", (F.rand(seed) * 2**53).cast("bigint"))
    u1 = lambda i: (F.pmod(F.xxhash64(F.col("_seed"), i, F.lit(1)), F.lit(2**40)) + 1) / F.lit(float(2**40 + 1))
    u2 = lambda i: F.pmod(F.xxhash64(F.col("_seed"), i, F.lit(2)), F.lit(2**40)) / F.lit(float(2**40))
    normal = lambda i: F.sqrt(-2 * F.log(u1(i))) * F.cos(2 * np.pi * u2(i))
    cell = F.transform(F.col(col), lambda row, r: F.transform(row, lambda v, c: v + sd * normal(r * F.size(row) + c)))
    return noisy.withColumn(col, cell).drop("_seed")


def row_mean(windows: DataFrame, col: str = "win") -> DataFrame:
    """One row with the mean row ``m`` of all rows of the windows; NULL without a window."""
    return windows.select(F.explode(col).alias("r")).agg(Summarizer.mean(array_to_vector("r")).alias("m"))


def window_moments(windows: DataFrame, col: str = "win", rows: bool = False) -> tuple:
    """Number of windows, mean and covariance (n - 1) of the flattened windows, in one pass; with ``rows``, the mean row of ``row_mean`` too.

    Both come from one query, so that the rows of the windows are shuffled once for both.

    A task multiplies its batches as matrices, less its first window, so a large common offset costs no digits. The products of
    all tasks are added by Spark row by row: the driver gets one matrix, and one mean per task to move them to the common mean.
    """
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = shift = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = _cells(batch["v"]).reshape(batch.num_rows, -1)
            if total is None:
                shift, total = cells[0].copy(), np.zeros((cells.shape[1] + 1,) * 2)
            x = np.ones((len(cells), len(total)))
            x[:, :-1] = cells - shift
            total += x.T @ x
        if total is not None:
            n, width = total[-1, -1], len(shift)
            centre = total[-1, :-1] / n
            total[:-1, :-1] -= n * np.outer(centre, centre)
            total[:-1, -1] = 0.0
            total[-1, :-1] = centre + shift
            keys = np.append(np.arange(width), -1 - TaskContext.get().partitionId())
            rows = pa.ListArray.from_arrays(np.arange(width + 2, dtype=np.int32) * (width + 1), pa.array(total.ravel()))
            yield pa.record_batch([pa.array(keys, pa.int64()), rows], ["i", "row"])

    parts = windows.select(_flat(windows, col).alias("v")).mapInArrow(products, "i bigint, row array<double>")
    sums = parts.groupBy("i").agg(Summarizer.metrics("sum").summary(array_to_vector("row")).alias("s")).select("i", "s.sum")
    if rows:
        sums = sums.union(row_mean(windows, col).select(F.lit(None).cast("bigint"), "m"))
    found = {r["i"]: r["sum"].toArray() for r in sums.collect() if r["sum"] is not None}
    if not found:
        raise ValueError("no window to fit on")
    one = found.pop(None, None)
    tasks = np.stack([found[i] for i in sorted(found) if i < 0])
    size, means = tasks[:, -1], tasks[:, :-1]
    mean = means[0] + size @ (means - means[0]) / size.sum()
    apart = (means - mean) * np.sqrt(size)[:, None]
    inside = np.stack([found[i][:-1] for i in sorted(found) if i >= 0])
    out = int(size.sum()), mean, (inside + apart.T @ apart) / max(size.sum() - 1, 1)
    return (*out, one) if rows else out


class PcaReconstructor:
    """Linear autoencoder: x̂ = μ + V·Vᵀ(x − μ) over flattened windows, optionally in weighted coordinates."""

    def __init__(self, mean: np.ndarray, components: np.ndarray, weights: np.ndarray | None = None):
        self.mean, self.components, self.weights = mean, components, weights

    @classmethod
    def fit(cls, windows: DataFrame, k: int = 16, col: str = "win", weights: list[float] | None = None,
            path: str | None = None, moments: tuple | None = None) -> PcaReconstructor:
        """The covariance is summed on the executors; mean and covariance (d and d×d numbers) come back, unless they are given as ``moments``.

        With a path, a model stored there for the same ``k``, weights and column is used instead of fitting, and a new one is
        stored; models of other settings stay beside it.
        """
        if path:
            path = f"{path}/{hashlib.md5(json.dumps([k, weights, col]).encode()).hexdigest()}"
        root = None if weights is None else np.sqrt(np.asarray(weights, dtype=float))
        spark = windows.sparkSession
        if path and _exists(spark, path):
            kept = spark.read.parquet(f"{path}/mean").first()
            components = np.array(kept["components"]) if "components" in kept else PCAModel.load(f"{path}/pca").pc.toArray()
            return cls(np.array(kept["mean"]), components, None if kept["root"] is None else np.array(kept["root"]))
        n, mean, cov = moments or window_moments(windows, col)
        if n < 2 or not 0 < k <= len(mean):
            raise ValueError(f"{k} components of {n} windows of {len(mean)} cells")
        if root is not None:
            scales = np.tile(root, len(mean) // len(root))
            mean, cov = mean * scales, cov * np.outer(scales, scales)
        components = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
        if path:
            row = [(mean.tolist(), None if root is None else root.tolist(), components.tolist())]
            spark.createDataFrame(row, "mean array<double>, root array<double>, components array<array<double>>").write.parquet(f"{path}/mean")
        return cls(mean, components, root)

    def rebuild(self, x: np.ndarray) -> np.ndarray:
        """Windows of any shape (n, …), rebuilt."""
        flat = x.reshape(len(x), -1)
        scale = 1.0 if self.weights is None else np.tile(self.weights, flat.shape[1] // len(self.weights))
        return ((((flat * scale - self.mean) @ self.components) @ self.components.T + self.mean) / scale).reshape(x.shape)

    def reconstruct(self, windows: DataFrame, col: str = "win", name: str = "recon") -> DataFrame:
        rebuild = self.rebuild

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def project(batch: pd.Series) -> pd.Series:
            if not len(batch):
                return pd.Series([], dtype=object)
            return pd.Series(list(rebuild(np.stack(batch.to_numpy()))))

        flat = project(_flat(windows, col))
        if _nested(windows, col):
            width = F.size(F.col(col)[0])
            flat_name = f"_{name}"
            out = windows.withColumn(flat_name, flat)
            steps = F.transform(F.col(col), lambda row, i: F.slice(F.col(flat_name), i * width + 1, width))
            return out.withColumn(name, steps).drop(flat_name)
        return windows.withColumn(name, flat)


def _nested(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType.elementType, T.ArrayType)


def _flat(df: DataFrame, col: str) -> Column:
    return (F.flatten(col) if _nested(df, col) else F.col(col)).cast("array<double>")


def _cells(arr: pa.Array) -> np.ndarray:
    """All cells of an array of lists, or lists of lists, of numbers; a missing window or cell is an error."""
    while pa.types.is_list(arr.type):
        if arr.null_count:
            raise ValueError("a window is missing or lacks a row")
        arr = arr.flatten()
    if arr.null_count:
        raise ValueError("a window lacks a cell")
    return arr.to_numpy()


def _exists(spark, path: str) -> bool:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/mean/_SUCCESS")
    return fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)


def load_or_fit(windows: DataFrame, path: str, **kw) -> PcaReconstructor:
    return PcaReconstructor.fit(windows, path=path, **kw)


def score_windows(windows: DataFrame, x: str = "win", xhat: str | dict[str, Callable[[np.ndarray], np.ndarray]] = "recon",
                  width: int | None = None, layout: str = "by_node", n_nodes: int = 3) -> DataFrame:
    """Error per feature, per node, and the hybrid score of reconstructed windows.

    With models in place of ``xhat``, by name, each a function that rebuilds an array (n, steps, width), the windows are read once
    for all of them: one row per window and model, with ``model`` and ``score`` in place of the window.
    """
    if isinstance(xhat, dict):
        return _score_models(windows, x, xhat, node_slices(width, layout, n_nodes), width)
    out = windows.withColumn("err", feature_error(F.col(x), F.col(xhat)))
    return out.withColumn("node_err", node_error(F.col("err"), width, layout, n_nodes)).withColumn("score", hybrid_score(F.col("node_err")))


#: Windows that are scored at once: their cells stay in a core's cache.
SCORE_ROWS = 256


def _score_models(windows: DataFrame, col: str, models: dict[str, Callable], slices: list[list[int]], width: int) -> DataFrame:
    left = [f for f in windows.schema.fields if f.name != col]
    shape = T.StructType([*left, T.StructField("model", T.StringType()), T.StructField("score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _cells(batch[col]).reshape(n, -1, width)
            rest = batch.select([f.name for f in left])
            for name, rebuild in models.items():
                score = np.concatenate([window_scores(part, rebuild(part), slices) for part in (x[i:i + SCORE_ROWS] for i in range(0, n, SCORE_ROWS))])
                yield pa.record_batch([*rest.columns, pa.array([name] * n), pa.array(score)], [*rest.schema.names, "model", "score"])

    return windows.mapInArrow(scored, shape)


def score_external(windows: DataFrame, make_predict_fn: Callable, col: str = "win", shape: list[int] | None = None,
                   batch_size: int = 1024, name: str = "recon_flat") -> DataFrame:
    """Batch inference with any saved network: it is loaded once per Python worker and fed Arrow batches."""
    run = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
                            input_tensor_shapes=[shape] if shape else None)
    return windows.withColumn(name, run(_flat(windows, col).cast("array<float>")))


def baseline_errors(features: DataFrame, cols: list[str], kind: str, keys: list[str] = SERIES, order: list[str] = ["ts"],
                    healthy: Column | None = None, chunk: Column | None = None, step: int | None = None) -> tuple[DataFrame, list[str]]:
    """Squared error per row and feature of a model that needs no window.

    ``mean`` predicts the healthy mean, ``persistence`` the row before. Returns the rows and the error columns.
    """
    names = [f"_e_{c}" for c in cols]
    if kind == "mean":
        means = scaler_values(fit_scaler(features, cols, healthy))
        return features.withColumns({n: F.pow(F.col(c) - means[c][0], F.lit(2.0)) for n, c in zip(names, cols)}), names
    if kind == "persistence":
        rows = delta(features, cols, keys, order, chunk, suffix="_step", step=step)
        return (rows.withColumns({n: F.pow(F.col(f"{c}_step"), F.lit(2.0)) for n, c in zip(names, cols)})
                .drop(*[f"{c}_step" for c in cols]), names)
    raise ValueError(f"unknown kind {kind!r}: mean, persistence")


def score_baseline(features: DataFrame, cols: list[str], kind: str, size: int = 10, layout: str = "by_node",
                   keys: list[str] = SERIES, pos: str | None = None, keep: list[str] | None = None, **kw) -> DataFrame:
    """Windows with err, node_err and score for a baseline, straight from the rows. ``keep`` as in ``windowed_error``."""
    rows, names = baseline_errors(features, cols, kind, keys, **kw)
    out = windowed_error(rows, names, size, keys, pos=pos, chunk=kw.get("chunk"), step=kw.get("step"), keep=keep)
    return (out.withColumn("node_err", node_error(F.col("err"), len(cols), layout))
            .withColumn("score", hybrid_score(F.col("node_err"))))


def neighbour_errors(features: DataFrame, node_cols: dict[str, list[str]], weight: list[list[float]], attn: list[float],
                     keys: list[str] = ["series_id", "ts"]) -> DataFrame:
    """Reconstruct each node from the attention-weighted values of the other nodes at the same time.

    Gives one row per (keys, node) with the squared errors of its features.
    """
    nodes = F.array(*[F.struct(F.lit(n).alias("n"), F.array(*[finite(F.col(c)) for c in cols]).alias("x"))
                      for n, cols in node_cols.items()])
    units, width = len(weight[0]), len(next(iter(node_cols.values())))
    rows = features.select(*keys, F.explode(nodes).alias("n")).select(*keys, F.col("n.n").alias("_n"), F.col("n.x").alias("x"))
    hidden = F.array(*[dot(F.col("x"), [r[u] for r in weight]) for u in range(units)])
    rows = rows.select(*keys, "_n", let(hidden, lambda v: F.struct(dot(v, attn[:units]).alias("a"), dot(v, attn[units:]).alias("b"), F.col("x").alias("x"))).alias("_h"))
    listed = rows.groupBy(*keys).agg(F.collect_list(F.struct("_n", "_h")).alias("_l"))
    pairs = listed.select(*keys, F.explode("_l").alias("_i"), "_l").select(*keys, "_i", F.explode("_l").alias("_j")).where("_i._n <> _j._n")
    linked = pairs.select(*keys, F.struct(F.col("_i._n").alias("n"), F.col("_i._h.x").alias("x")).alias("_src"), F.col("_i._h.a").alias("_a"), F.col("_j._h").alias("_t"))
    out = softmax_mean(linked, keys, leaky_relu(F.col("_a") + F.col("_t.b")), [F.col("_t.x")[u] for u in range(width)])
    err = F.zip_with(F.col("_src.x"), F.col("_mean"), lambda a, b: (a - b) * (a - b))
    return out.select(*keys, F.col("_src.n").alias("node"), err.alias("err"))


# The what-if inputs, in raw units of the named feature.
PROBES = [("zeros", None, 0.0), ("ones", None, 1.0), ("cpu_95", "app_cpu", 95.0), ("mem_2gib", "app_mem", 2.0 * 1024**3)]


def probe_windows(scaler: DataFrame, cols: list[str], size: int = 10, probes=PROBES) -> DataFrame:
    """(scenario, win): constant windows; a named feature is expressed in z units of the fitted scaler.

    The guard 1e-9 is added to the scale as in the what-if check these inputs come from.
    """
    scenarios = scaler.sparkSession.createDataFrame(probes, "scenario string, target string, raw double")
    cell = (F.when(F.col("target").isNull(), F.col("raw"))
            .when(F.col("target") == F.col("feature"), (F.col("raw") - F.col("mean")) / (F.col("scale") + 1e-9))
            .otherwise(0.0))
    listed = scenarios.withColumn("f", F.explode(scaler.agg(F.collect_list(F.struct("feature", "mean", "scale"))).scalar()))
    cells = listed.select("scenario", "target", "raw", "f.*").select("scenario", "target", "raw", "feature", cell.alias("z"))
    wide = cells.groupBy("scenario").agg(F.map_from_entries(F.collect_list(F.struct("feature", "z"))).alias("m"),
                                         F.max(F.when(F.col("target").isNull(), F.col("raw"))).alias("rest"))
    row = F.array(*[F.coalesce(F.try_element_at("m", F.lit(c)), "rest", F.lit(0.0)) for c in cols])
    return wide.select("scenario", F.array_repeat(row, size).alias("win"))


def score_probes(probes: DataFrame, reconstruct: Callable[[DataFrame], DataFrame], width: int, layout: str = "by_node",
                 n_nodes: int = 3) -> DataFrame:
    """(scenario, err, node_err, score) of probe windows under a fitted model: what it says to inputs whose cause is known.

    ``reconstruct`` adds ``recon`` to rows with ``win``, as a model's own ``reconstruct`` does; ``width`` is the number of inputs.
    """
    return score_windows(reconstruct(probes), width=width, layout=layout, n_nodes=n_nodes).select("scenario", "err", "node_err", "score")
