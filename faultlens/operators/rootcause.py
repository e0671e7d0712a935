"""From errors per feature to a root-cause report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.functions.naming import NODE_DISPLAY, display_name, guidance
from faultlens.functions.numeric import confidence, let, severity
from faultlens.operators.scoring import hybrid_score, node_contribution, node_error, total_of
from faultlens.schemas import NODES

KEYS = ["series_id", "win_id"]


def ranked_contributors(err: Column, names: list[str], k: int = 3, n_levels: int | None = None) -> Column:
    """ARRAY of the k largest errors of a window: struct(node, feature, impact), largest first.

    Ties go to the higher index; pads never appear but count in the total; impact is the whole percent.
    """
    # Natural order needs no comparison function; names are looked up for the k rows that are left.
    top = F.slice(F.sort_array(_cells(err, names), asc=False), 1, k)
    shown = _shown(names, n_levels)
    return let(total_of(err, len(names)), lambda total: F.transform(top, lambda c: shown(c, total)))


def _cells(err: Column, names: list[str]) -> Column:
    """ARRAY of struct(err, idx) of the inputs that are no pads."""
    return F.array(*[F.struct(err[i].alias("err"), F.lit(i).alias("idx")) for i, n in enumerate(names) if "pad" not in n])


def _shown(names: list[str], n_levels: int | None = None) -> Callable[[Column, Column], Column]:
    """Function of a cell and the total that gives struct(node, feature, impact)."""
    n_levels = n_levels if n_levels is not None else sum(not n.endswith("_delta") and "pad_live" not in n for n in names)
    names_shown = [display_name(n, i >= n_levels) for i, n in enumerate(names)]
    nodes, features = (F.array(*[F.lit(pair[side]) for pair in names_shown]) for side in (0, 1))
    share = lambda e, total: F.when(total > 0, F.floor(e / total * 100)).otherwise(F.lit(0)).cast("int")
    return lambda c, total: F.struct(F.get(nodes, c["idx"]).alias("node"), F.get(features, c["idx"]).alias("feature"),
                                     share(c["err"], total).alias("impact"))


def top_contributors(df: DataFrame, names: list[str], k: int = 3, err: str = "err", keys: list[str] = KEYS) -> DataFrame:
    """(keys, rank, node, feature, impact), at most k rows per window; no shuffle, a window is one row."""
    return (df.select(*keys, F.posexplode(ranked_contributors(F.col(err), names, k)).alias("rank", "c"))
            .select(*keys, (F.col("rank") + 1).alias("rank"), "c.*"))


def primary_cause(df: DataFrame, names: list[str], err: str = "err", keys: list[str] = KEYS) -> DataFrame:
    """Largest contributor; Unknown/Unknown/100 when a window has none."""
    return df.select(*keys, primary_of(F.col(err), names).alias("p")).select(*keys, "p.*")


def primary_of(err: Column, names: list[str]) -> Column:
    none = F.struct(F.lit("Unknown").alias("node"), F.lit("Unknown").alias("feature"), F.lit(100).alias("impact"))
    if all("pad" in n for n in names):
        return none
    # The largest cell needs no sort, and no lambda that would be interpreted.
    return _shown(names)(F.array_max(_cells(err, names)), total_of(err, len(names)))


def report(df: DataFrame, names: list[str], threshold: Column, err: str = "err", score: str = "score",
           ts: str = "ts", keys: list[str] = KEYS, nodes: list[str] = NODES) -> DataFrame:
    """Root-cause report of every row as columns, plus the same as JSON text in ``report``."""
    half = sum(len([n for n in names if n.startswith(p + "_")]) for p in nodes)
    out = (df.withColumn("_p", primary_of(F.col(err), names))
           .withColumn("_g", guidance(F.col("_p.node"), F.col("_p.feature")))
           .withColumn("_n", node_error(F.col(err), half, "by_node", len(nodes)))
           .withColumn("_thr", threshold))
    body = F.struct(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        severity(F.col(score), F.col("_thr")).alias("severity"),
        F.col("_g.anomaly_type").alias("anomaly_type"),
        F.round(score, 6).alias("overall_score"),
        F.round("_thr", 6).alias("threshold"),
        F.struct(*[F.round(F.col("_n")[i], 6).alias(NODE_DISPLAY.get(n, n)) for i, n in enumerate(nodes)]).alias("node_scores"),
        F.col("_p").alias("primary_cause"),
        node_contribution(F.col(err), half, nodes).alias("impact_analysis"),
        F.col("_g.insight").alias("insight"),
        F.col("_g.action").alias("recommended_action"))
    return (out.withColumn("body", body)
            .withColumn("confidence", confidence(F.col(score), F.col("_thr")))
            .withColumn("report", F.to_json("body"))
            .select(*keys, ts, "body", "confidence", "report"))


def report_json(df: DataFrame, names: list[str], threshold: Column, **kw) -> DataFrame:
    return report(df, names, threshold, **kw).drop("body", "confidence")


def score_errors(df: DataFrame, width: int, err: str = "err", layout: str = "by_node") -> DataFrame:
    """Add node errors and the hybrid score to rows with an array of errors per feature."""
    return df.withColumn("node_err", node_error(F.col(err), width, layout)).withColumn("score", hybrid_score(F.col("node_err")))
