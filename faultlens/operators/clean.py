"""Projections, filters and schema operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions.naming import node_alias
from faultlens.functions.numeric import finite, floor_ts
from faultlens.schemas import HEALTHY, LABEL_COLUMNS, NODES, STEP_SECONDS, UNKNOWN
from faultlens.session import attach


def normalize_ts(df: DataFrame, col: str = "ts", step: int = STEP_SECONDS, zone: str | None = None) -> DataFrame:
    """Parse where needed, move from ``zone`` to UTC, floor to the step; rows without a valid time go."""
    ts = F.col(col)
    if isinstance(df.schema[col].dataType, T.StringType):
        ts = F.try_to_timestamp(ts)
    ts = ts.cast("timestamp")
    if zone:
        ts = F.to_utc_timestamp(ts, zone)
    return df.withColumn(col, floor_ts(ts, step)).where(F.col(col).isNotNull())


def align_schema(df: DataFrame, cols: list[str], default: float = 0.0, keep: Iterable[str] = ()) -> DataFrame:
    """The ``keep`` columns, then exactly the named slots in order; absent slots hold the default."""
    have = set(df.columns)
    return df.select(*keep, *[F.col(c).cast("double").alias(c) if c in have else F.lit(float(default)).alias(c)
                              for c in cols])


def normalize_nodes(df: DataFrame, col: str = "node") -> DataFrame:
    return df.withColumn(col, node_alias(F.col(col)))


def shift_to_metric_day(events: DataFrame, metrics: DataFrame, step: int = STEP_SECONDS,
                        keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Move the events by whole days so that their first day is the first metric day.

    Without keys there is one shift for everything, with keys one per key.
    """
    if keys:
        firsts = (events.groupBy(*keys).agg(F.min(ts).alias("_e"))
                  .join(metrics.groupBy(*keys).agg(F.min(ts).alias("_m")), keys)
                  .select(*keys, F.datediff("_m", "_e").alias("_days")))
        out = attach(events, firsts, keys)
        days = F.coalesce(F.col("_days"), F.lit(0))
    else:
        first_metric = metrics.agg(F.min(ts)).scalar()
        first_event = events.agg(F.min(ts)).scalar()
        out, days = events, F.coalesce(F.datediff(first_metric, first_event), F.lit(0))
    moved = F.timestamp_seconds(F.unix_seconds(ts) + days.cast("bigint") * 86_400)
    return out.withColumn(ts, floor_ts(moved, step)).drop("_days")


def time_range(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows with start <= ts <= end; the bounds take the column's own type so that the scan can skip."""
    kind = df.schema[ts].dataType.simpleString()
    return df.where(F.col(ts).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def state_filter(events: DataFrame, state: str, ignore_case: bool = True) -> DataFrame:
    value = F.upper("state") if ignore_case else F.col("state")
    return events.where(value == state)


def drop_empty_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(how="all", subset=cols)


def fill_partial(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.na.fill(0, subset=cols)


def finite_guard(df: DataFrame, cols: list[str], nan: float = 0.0, pos: float = 6.0, neg: float = -6.0) -> DataFrame:
    return df.withColumns({c: finite(F.col(c), nan, pos, neg) for c in cols})


def order_features(cols: list[str], nodes: list[str] = NODES) -> list[str]:
    """Feature columns grouped by node prefix; all of them if no column carries a prefix."""
    features = [c for c in cols if c not in LABEL_COLUMNS]
    ordered = [c for node in nodes for c in features if c.startswith(node + "_")]
    return ordered or features


def node_of(col: str, nodes: list[str] = NODES) -> str | None:
    return next((n for n in nodes if col.startswith(n + "_")), None)


def pad_count(width: int, n_nodes: int = len(NODES)) -> int:
    return -width % n_nodes


def feature_names(cols: list[str], n_nodes: int = len(NODES)) -> list[str]:
    """Names of the model inputs: levels, changes, padding."""
    pads = pad_count(2 * len(cols), n_nodes)
    return [*cols, *[c + "_delta" for c in cols], *[f"pad_live_{i}" for i in range(pads)]]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def known_anomalies(scores: DataFrame, y: str = "y", fault: str = "fault_type") -> DataFrame:
    return scores.where((F.col(y) == 1) & ~F.col(fault).isin(HEALTHY, UNKNOWN))


# Helper containers that never count as a node's own source.
HELPER_SOURCES = ["promtail", "exporter", "cadvisor", "loki"]


def match_source(names: DataFrame, nodes: DataFrame, name: str = "name", order: str = "seq",
                 keys: list[str] | None = None, exclude: list[str] = HELPER_SOURCES) -> DataFrame:
    """For each node row, the first name (by order) that contains the node; the node itself if none does.

    Names are cut into parts once and meet the nodes by an equi-join on the part, so that no name is paired with a
    node it does not hold. Null names match nothing.
    """
    keys = keys or []
    parts = name_parts(names.where(~F.lower(F.col(name)).rlike("|".join(exclude))), nodes, name)
    listed = nodes.select("node").distinct()
    found = parts.join(listed, "node").groupBy(*keys, "node").agg(F.min_by(name, order).alias("source"))
    return nodes.join(found, [*keys, "node"], "left").withColumn("source", F.coalesce("source", "node"))


def name_parts(names: DataFrame, nodes: DataFrame, name: str = "name") -> DataFrame:
    """One row per name and distinct part ``node`` of its lower-case text, of the lengths that node names have.

    The lengths are one short list however many nodes there are, and a name has fewer parts than characters per length.
    """
    sizes = nodes.select(F.length("node").alias("size")).distinct().agg(F.sort_array(F.collect_set("size"))).scalar()
    text = F.lower(F.col(name))

    def of_size(size):
        return F.when(size > F.length(text), F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda at: F.substring(text, at, size)))
    out = names.withColumn("_sizes", sizes)
    return out.withColumn("node", F.explode(F.array_distinct(F.flatten(F.transform("_sizes", of_size))))).drop("_sizes")


def relabel(df: DataFrame, name: str = "name", target: str | None = None) -> DataFrame:
    """Container labels without the leading slash; for probes, the target moves to its own column."""
    bare = F.regexp_extract(F.col(name), "^/(.*)$", 1)
    out = df.withColumns({c: F.when(F.col(name).startswith("/"), bare) for c in ("container", "container_name")})
    if target:
        out = out.withColumn("param_target", F.col("address")).withColumn("address", F.lit(target))
    return out


def label_match(samples: DataFrame, label: str, pattern: str) -> DataFrame:
    """Samples whose label matches the whole pattern; an absent label counts as empty text."""
    return samples.where(F.coalesce(F.try_element_at("labels", F.lit(label)), F.lit("")).rlike(f"^(?:{pattern})$"))


def as_column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x
