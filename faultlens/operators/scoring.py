"""Reconstruction error per feature, node and window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions.numeric import let
from faultlens.operators.ordered import halo_by_position
from faultlens.operators.sequence import _placed
from faultlens.schemas import FEATURES, NODES, WINDOW_ROWS

# Weight of the node maximum against the node mean, and feature weights by slot.
MAX_SHARE, MEAN_SHARE = 0.7, 0.3
CPU_SLOTS, CPU_WEIGHT = [0, 7, 14], 2.0
ERROR_SLOTS, ERROR_WEIGHT = [4, 11, 18], 1.5
THIRD_SLOTS, THIRD_WEIGHT = [2, 9, 16], 1.5
LEAKY_SLOPE = 0.2


def feature_error(x: Column, xhat: Column) -> Column:
    """Mean over the window's steps of the squared difference, per feature. Both are ARRAY<ARRAY<DOUBLE>>."""
    squared = F.zip_with(x, xhat, lambda r, s: F.zip_with(r, s, lambda a, b: (a - b) * (a - b)))
    start = F.transform(squared[0], lambda v: F.lit(0.0))
    return F.aggregate(squared, start, lambda acc, r: F.zip_with(acc, r, lambda a, b: a + b),
                       lambda acc: F.transform(acc, lambda v: v / F.size(x)))


def mean_of(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v) / F.size(arr)


def total_of(arr: Column, width: int) -> Column:
    """Sum of an array of known width, with eight partial sums as numpy adds: a share that is a whole percent
    there must not fall below it here by rounding."""
    even = width - width % 8
    if not even:
        return sum((arr[i] for i in range(1, width)), arr[0])
    r = [sum((arr[i] for i in range(k + 8, even, 8)), arr[k]) for k in range(8)]
    pairs = ((r[0] + r[1]) + (r[2] + r[3])) + ((r[4] + r[5]) + (r[6] + r[7]))
    return sum((arr[i] for i in range(even, width)), pairs)


def node_slices(width: int, layout: str = "by_node", n_nodes: int = len(NODES)) -> list[list[int]]:
    """Feature positions of each node: its levels and changes, or equal contiguous parts."""
    if layout == "contiguous":
        part = width // n_nodes
        return [list(range(i * part, (i + 1) * part)) for i in range(n_nodes)]
    half = width // 2
    part = half // n_nodes
    return [[*range(i * part, (i + 1) * part), *range(half + i * part, half + (i + 1) * part)] for i in range(n_nodes)]


def node_error(err: Column, width: int = 2 * len(FEATURES), layout: str = "by_node",
               n_nodes: int = len(NODES)) -> Column:
    """ARRAY with the mean error of each node."""
    def mean_at(idx: list[int]) -> Column:
        runs, start = [], idx[0]
        for a, b in zip(idx, [*idx[1:], None]):
            if b != a + 1:
                runs.append(F.slice(err, start + 1, a - start + 1))
                start = b
        return mean_of(F.concat(*runs))
    return F.array(*[mean_at(idx) for idx in node_slices(width, layout, n_nodes)])


def hybrid_score(nodes: Column) -> Column:
    return MAX_SHARE * F.array_max(nodes) + MEAN_SHARE * mean_of(nodes)


def window_scores(x: np.ndarray, xhat: np.ndarray, slices: list[list[int]], parts: bool = False) -> np.ndarray | tuple[np.ndarray, ...]:
    """``hybrid_score`` of the node errors of windows (n, steps, width), added in the order of the column form.

    With ``parts``, the errors per feature and per node come with it.
    """
    squared = (x - xhat) ** 2
    err = np.zeros((x.shape[0], x.shape[2]))
    for t in range(x.shape[1]):
        err += squared[:, t]
    err /= x.shape[1]
    nodes = []
    for idx in slices:
        total = np.zeros(len(x))
        for i in idx:
            total += err[:, i]
        nodes.append(total / len(idx))
    mean = sum(nodes, np.zeros(len(x))) / len(nodes)
    score = MAX_SHARE * np.max(nodes, axis=0) + MEAN_SHARE * mean
    return (err, np.stack(nodes, 1), score) if parts else score


def node_contribution(err: Column, width: int = 2 * len(FEATURES), nodes: list[str] = NODES) -> Column:
    """struct with each node's share of the total error in percent; NULL if there is no error."""
    total = total_of(err, width)
    parts = [F.round(sum((err[i] for i in idx[1:]), err[idx[0]]) / total * 100, 2).alias(n)
             for n, idx in zip(nodes, node_slices(width, "by_node", len(nodes)))]
    return F.when(total > 0, F.struct(*parts))


def loss_weights(width: int = 2 * len(FEATURES)) -> list[float]:
    """Weight per input: levels of three groups of slots, changes of the first two."""
    half = width // 2
    out = [1.0] * width
    for slots, weight in ((CPU_SLOTS, CPU_WEIGHT), (ERROR_SLOTS, ERROR_WEIGHT)):
        for s in slots:
            out[s] = out[half + s] = weight
    for s in THIRD_SLOTS:
        out[s] = THIRD_WEIGHT
    return out


def weighted_error(err: Column, weights: list[float]) -> Column:
    """Weighted mean squared error of a window from its errors per feature."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    return mean_of(F.zip_with(err, w, lambda e, k: e * k))


def pad_features(arr: Column, count: int) -> Column:
    return F.concat(arr, F.array_repeat(F.lit(0.0), count)) if count else arr


def windowed_error(rows: DataFrame, err_cols: list[str], size: int = WINDOW_ROWS, keys: list[str] = ["series_id"],
                   order: list[str] = ["ts"], chunk: Column | None = None, pos: str | None = None,
                   name: str = "err", step: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Mean of per-row errors over full windows, without building the windows.

    With ``step``, the seconds between rows of a grid without gaps, a row's position is its distance from the first one.
    ``keep`` names the columns that are kept beside the keys, all if it is absent; the others are not moved.

    For reconstructions that depend on the row alone, this gives the same errors as window arrays and moves
    each row once instead of ``size`` times. A chunk of a series is one matrix, whose rows are added in their order.
    """
    if keep is not None:
        rows = rows.select(*dict.fromkeys([*keys, *order, *keep, *([pos] if pos else []), *err_cols]))
    if step:
        first = rows.groupBy(*keys).agg(F.min(F.unix_seconds(order[0])).alias("_first"))
        numbered = rows.join(first, keys).withColumn("_pos", ((F.unix_seconds(order[0]) - F.col("_first")) / step).cast("long")).drop("_first")
    else:
        numbered = _placed(rows, keys, order, chunk, pos)
    left = [c for c in rows.columns if not (c in err_cols and c.startswith("_")) and (keep is None or c in [*keys, *keep])]
    errors = F.array(*[F.col(c).cast("double") for c in err_cols]).alias("_errors")
    placed = halo_by_position(numbered.where("_pos IS NOT NULL").select(*dict.fromkeys([*keys, *left]), "_pos", errors), "_pos", size - 1)
    shape = T.StructType([*[placed.schema[c] for c in left], T.StructField(name, T.ArrayType(T.DoubleType())), T.StructField("win_id", placed.schema["_pos"].dataType)])

    def means(part: pa.Table) -> pa.Table:
        part = part.take(np.argsort(part["_pos"].to_numpy(), kind="stable"))
        cells = part["_errors"].combine_chunks().flatten()
        known = cells.is_valid().to_numpy(zero_copy_only=False).reshape(-1, len(err_cols))
        x = cells.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, len(err_cols))
        total, n = np.zeros_like(x), np.zeros(x.shape, dtype=np.int32)
        with np.errstate(invalid="ignore", divide="ignore"):
            for back in range(min(size, len(x)) - 1, -1, -1):
                total[back:] += x[:len(x) - back]
                n[back:] += known[:len(x) - back]
            mean = total / n
        at = part["_pos"].to_numpy()
        full = ~part["_halo"].to_numpy(zero_copy_only=False) & (at >= size - 1)
        flat = pa.array(mean[full].ravel(), mask=(n[full] == 0).ravel())
        listed = pa.ListArray.from_arrays(np.arange(full.sum() + 1, dtype=np.int32) * len(err_cols), flat)
        out = part.select(left).filter(pa.array(full))
        return out.append_column(name, listed).append_column("win_id", pa.array(at[full] - (size - 1)))

    return placed.groupBy(*keys, "_chunk").applyInArrow(means, shape)


def dot(x: Column, w: list[float]) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b),
                       F.lit(0.0), lambda acc, v: acc + v)


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.exp(x) - 1)


def leaky_relu(x: Column, slope: float = LEAKY_SLOPE) -> Column:
    return F.when(x > 0, x).otherwise(slope * x)


def graph_attention(nodes: DataFrame, weight: list[list[float]], attn: list[float],
                    keys: list[str] = ["series_id", "ts"], node: str = "node", value: str = "x",
                    edges: DataFrame | None = None, activate: bool = True) -> DataFrame:
    """One attention layer over the node graph of each time step.

    h = xW; the logit of an edge is leaky_relu(a·[h_i‖h_j]); weights are the softmax over the targets j;
    the output is elu(Σ α·h_j). ``edges`` (src, dst) restricts the graph; the default is every pair.
    The logit splits into a source and a target part, so each node computes both parts once.
    """
    units = len(weight[0])
    hidden = F.array(*[dot(F.col(value), [row[u] for row in weight]) for u in range(units)])
    h = nodes.select(*keys, F.col(node).alias("_n"), let(hidden, lambda v: F.struct(
        v.alias("h"), dot(v, attn[:units]).alias("a"), dot(v, attn[units:]).alias("b"))).alias("_h"))
    if edges is not None:
        linked = linked_nodes(h, edges, keys)
    else:
        listed = h.groupBy(*keys).agg(F.collect_list(F.struct("_n", "_h")).alias("_l"))
        linked = listed.select(*keys, F.explode("_l").alias("_i"), "_l").select(*keys, F.col("_i._n").alias("_src"), F.col("_i._h.a").alias("_a"), F.explode("_l._h").alias("_t"))
    out = softmax_mean(linked, keys, leaky_relu(F.col("_a") + F.col("_t.b")), [F.col("_t.h")[u] for u in range(units)])
    return out.select(*keys, F.col("_src").alias(node), (F.transform("_mean", elu) if activate else F.col("_mean")).alias("h"))


def linked_nodes(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, _src, _a, _t)`` for every edge (src, dst) of which both ends exist at a time step.

    ``nodes`` has the node's name ``_n`` and a struct ``_h`` with its parts. Nodes meet their edges by name, and edges their
    targets by step and name; a missing edge costs nothing.
    """
    src, dst = edges.select(F.col("src").alias("_n"), F.col("dst").alias("_dst")).distinct(), nodes.select(*keys, F.col("_n").alias("_dst"), F.col("_h").alias("_t"))
    out = nodes.select(*keys, "_n", F.col("_h.a").alias("_a")).join(src, "_n")
    return out.join(dst, [*keys, "_dst"]).select(*keys, F.col("_n").alias("_src"), "_a", "_t")


def softmax_mean(linked: DataFrame, keys: list[str], logit: Column, values: list[Column]) -> DataFrame:
    """``(keys, _src, _mean)``: per source the mean of the values over its edges, weighted by the softmax of the logits.

    The largest logit of a source is taken off before exponents are, so no weight overflows.
    """
    segment = Window.partitionBy(*keys, "_src")
    edge = linked.select(*keys, "_src", logit.alias("_e"), F.array(*values).alias("_v"))
    weighed = edge.withColumn("_p", F.exp(F.col("_e") - F.max("_e").over(segment)))
    sums = weighed.groupBy(*keys, "_src").agg(F.sum("_p").alias("_z"), *[F.sum(F.col("_p") * F.col("_v")[u]).alias(f"_s{u}") for u in range(len(values))])
    return sums.select(*keys, "_src", F.array(*[F.col(f"_s{u}") / F.col("_z") for u in range(len(values))]).alias("_mean"))
