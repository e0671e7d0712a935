"""Approximate nearest neighbours by inner product, from low-dimensional stable projections in kd-trees.

Vectors get one more component that gives all of them the same length, so that the largest inner product is the
smallest Euclidean distance. Gaussian (2-stable) projections to ``dims`` dimensions are indexed by one kd-tree per
block of rows. A query takes the leaves of a tree by growing projected distance and verifies their rows with the
original vectors. It stops when a chi-square test says that a row this far off in projection is hardly nearer than
the k-th found.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.common import map_pandas
from faultlens.session import stage

DIMS = 6
#: The test's level: the share of true neighbours at the k-th distance that a search may overlook is 1 - LEVEL.
LEVEL = 0.99
BLOCK = 8_192
QUERY_BLOCK = 2_048
LEAF = 128
#: Scaled products below this are not told apart by the search; their exact scores decide.
TINY = 1e-300


def chi_square_bound(level: float, dims: int) -> float:
    """The value that a chi-square variable of an even number of degrees of freedom exceeds with 1 - level."""
    def above(x: float) -> float:
        return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) > 1 - level else (low, mid)
    return high


def kd_leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree that halves the widest side at its median."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            leaves.append(rows)
            continue
        part = points[rows]
        axis = int(np.argmax(part.max(0) - part.min(0)))
        order = np.argpartition(part[:, axis], len(rows) // 2)
        todo += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return leaves


def least_ids(rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct vectors, and for each the ids that can be among k results: k + 1 smallest ids, each at most k times.

    Equal vectors have equal scores, so of a group of them only the smallest ids can enter; one more replaces a query's own.
    """
    distinct, group = np.unique(rows, axis=0, return_inverse=True)
    order = np.lexsort((ids, group.ravel()))
    out = []
    for part in np.split(ids[order], np.cumsum(np.bincount(group.ravel(), minlength=len(distinct)))[:-1]):
        names, n = np.unique(part, return_counts=True)
        out.append(np.repeat(names[:k + 1], np.minimum(n[:k + 1], k)))
    return distinct, out


def exact_score(row: np.ndarray, query: np.ndarray) -> float:
    """The inner product in doubles, added component by component: one value for equal vectors wherever they are met.

    A sum that is undefined because infinite products of both signs meet counts as minus infinity.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        total = float(np.add.accumulate(row * query)[-1])
    return -math.inf if math.isnan(total) else total


def search_block(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, longest: float, k: int, level: float = LEVEL,
                 dims: int = DIMS, leaf: int = LEAF, seed: int = 7, scale: float = 1.0, verified: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query number, id, score)`` of the k best rows found for each query, ties to the smaller id.

    ``longest`` is the largest squared length of all rows over ``scale``. The search itself multiplies matrices of
    scaled distinct vectors; it keeps what comes within the error of such a product of the k-th place, and the scores
    of these decide. ``verified`` collects how many distinct rows were compared with queries, leaf by leaf.
    """
    distinct, members = least_ids(rows, ids, k)
    near, probes = distinct / scale, queries / scale
    axes = np.random.default_rng(seed).standard_normal((rows.shape[1] + 1, dims))
    rest = np.sqrt(np.maximum(0.0, longest - (near ** 2).sum(1)))
    points, targets = near @ axes[:-1] + rest[:, None] * axes[-1], probes @ axes[:-1]
    own, bound = (probes ** 2).sum(1) + longest, chi_square_bound(level, dims)
    error = 4 * (rows.shape[1] + 2) * np.finfo(float).eps * np.sqrt((probes ** 2).sum(1) * longest) + TINY
    leaves = kd_leaves(points, leaf)
    gap = np.stack([((np.maximum(0, points[r].min(0) - targets) + np.maximum(0, targets - points[r].max(0))) ** 2).sum(1)
                    for r in leaves], 1)
    turn = np.argsort(gap, 1, kind="stable")
    # One more place than results: a group whose only id is the query's own takes none of them.
    top = np.full((len(queries), k + 1), -np.inf)
    met: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in queries]
    active = np.arange(len(queries))
    for at in range(len(leaves)):
        far = np.maximum(0.0, own[active] - 2 * top[active, -1])
        active = active[gap[active, turn[active, at]] <= far * bound]
        if not len(active):
            break
        for number in np.unique(turn[active, at]):
            some, inside = active[turn[active, at] == number], leaves[number]
            if verified is not None:
                verified.append(len(some) * len(inside))
            value = probes[some] @ near[inside].T
            top[some] = -np.sort(-np.concatenate((top[some], value), 1), 1)[:, :k + 1]
            for one, scores in zip(some, value):
                take = scores >= top[one, -1] - error[one]
                met[one].append((inside[take], scores[take]))
    out = []
    for one, parts in enumerate(met):
        found = [(-exact_score(distinct[row], queries[one]), name)
                 for rows_met, scores in parts for row in rows_met[scores >= top[one, -1] - error[one]]
                 for name in members[row].tolist() if name != query_ids[one]]
        out += [(one, name, -score) for score, name in sorted(found)[:k]]
    number, name, score = zip(*out) if out else ((), (), ())
    return np.array(number, np.int64), np.array(name, np.int64), np.array(score, np.float64)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, vec array<double>, largest)`` of the vectors without null or non-finite components that are not zero.

    ``largest`` is the largest absolute component.
    """
    cast = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    largest = F.array_max(F.transform("vec", F.abs))
    return cast.where("id is not null and vec is not null").where(finite).withColumn("largest", largest).where("largest > 0")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            level: float = LEVEL, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows of largest inner product found for each query, ties to the smaller id.

    Rows and queries are dealt into blocks by hash and every block of queries meets every block of rows. A row never
    finds its own id. Null, zero and non-finite vectors take no part; vectors of another length than the query's are
    skipped. Fewer candidates than k give fewer rows, an empty table none. Rows that repeat an id are all candidates.
    Components may have any finite size: lengths are compared over the largest component of the table, and products
    beyond the range of doubles count as infinite.
    """
    data, asked = stage(usable(vectors, id_col, vec_col), "vectors"), stage(usable(queries, id_col, vec_col), "queries")
    scale, n = data.agg(F.max("largest"), F.count("*")).first()
    asked_scale, m = asked.agg(F.max("largest"), F.count("*")).first()
    scale = max(scale or 1.0, asked_scale or 1.0)
    longest = data.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x / scale) * (x / scale)))).first()[0]
    row_blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))
    deal = F.struct("id", "vec")

    def packed(df, blocks, name):
        salted = df.withColumn(name, F.pmod(F.xxhash64("id", "vec", F.monotonically_increasing_id() % 64), F.lit(blocks)).cast("int"))
        return salted.withColumn("size", F.size("vec")).groupBy(name, "size").agg(F.collect_list(deal).alias(name + "_rows"))
    rows = packed(data, row_blocks, "r").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    grid = rows.join(packed(asked, query_blocks, "q"), ["q", "size"]).select("r_rows", "q_rows")

    def make():
        def step(batch: pd.DataFrame) -> pd.DataFrame:
            out = []
            for r, q in zip(batch["r_rows"], batch["q_rows"]):
                ids, query_ids = (np.array([x["id"] for x in side], np.int64) for side in (r, q))
                data, asked = (np.array([x["vec"] for x in side], np.float64) for side in (r, q))
                number, found, score = search_block(data, ids, asked, query_ids, longest, k, level, scale=scale)
                out.append(pd.DataFrame({"query_id": query_ids[number], "vec_id": found, "score": score}))
            return pd.concat(out)
        return step
    found = map_pandas(grid, make, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
