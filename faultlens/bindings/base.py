"""Registry of the queries, and the inputs that they derive from the given tables.

One series is three users (one per node); the grid step is one hour; pads scale with the step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions.numeric import floor_ts
from faultlens.operators.grid import master_grid, reindex_grid
from faultlens.operators.intervals import label, pair_intervals
from faultlens.operators.ordered import number_chunk
from faultlens.plans.pipeline import fuse
from faultlens.schemas import FEATURES, NODES
from faultlens.session import prepare, spread
from faultlens.sources.files import log_measures, parse_node_lines

HOUR = 3600
PAD, DEFAULT = 3.0 * HOUR, 12.0 * HOUR
KEYS = ["series_id"]
SCORE_ORDER = ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; its result gets wall-clock times and floats of six decimals."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shaped(fn(prepare(spark, wide=True), sf_dir))
        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


def shaped(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz").alias(f.name)
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def with_(*parts: str) -> str:
    """WITH clause of the given common table expressions, each once, in order."""
    seen = list(dict.fromkeys(p for part in parts for p in (part if isinstance(part, tuple) else (part,))))
    return "WITH " + ",\n".join(seen) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- events as series -------------------------------------------------------------------------------

EV = """ev AS (SELECT event_id, ts, user_id, event_type, value, props, user_id // 3 AS series_id,
  CASE user_id % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'db' ELSE 'redis' END AS node,
  date_trunc('hour', ts) AS slot FROM events)"""
GRID = """grid AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts
  FROM (SELECT series_id, min(slot) AS lo, max(slot) AS hi FROM ev GROUP BY series_id))"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.element_at(F.array(*[F.lit(n) for n in NODES]), (F.col("user_id") % 3 + 1).cast("int"))
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id", ts.alias("ts"), "user_id", "event_type", "value", "props",
        F.floor(F.col("user_id") / F.lit(3)).alias("series_id"), node.alias("node"), floor_ts(ts, HOUR).alias("slot"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master_grid(events(spark, sf_dir), KEYS, HOUR)


# ---- fault events, intervals, labels ----------------------------------------------------------------

FE = """fe AS (SELECT series_id, event_id AS event_seq, slot AS ts, node, 'F' || (user_id % 5) AS fault_type,
  CASE WHEN event_type = 'signup' THEN 'START' ELSE 'STOP' END AS state,
  CASE WHEN event_id % 2 = 0 THEN value * 60 END AS duration_s
  FROM ev WHERE event_type IN ('signup', 'purchase') AND value > 100)"""
IV = """iv AS (SELECT s.series_id, s.node, s.fault_type, s.ts AS st, s.event_seq,
  COALESCE((SELECT arg_min(p.ts, p.event_seq) FROM fe p WHERE p.state = 'STOP' AND p.series_id = s.series_id
              AND p.node = s.node AND p.ts >= s.ts) + INTERVAL 3 HOUR,
           CASE WHEN s.duration_s > 0 THEN s.ts + to_microseconds(CAST(trunc((s.duration_s + 10800) * 1e6) AS BIGINT))
                ELSE s.ts + INTERVAL 12 HOUR END) AS et
  FROM fe s WHERE s.state = 'START')"""
LAB = """lab AS (SELECT g.series_id, g.ts, count(iv.st) AS n_intervals,
  CASE WHEN count(iv.st) > 0 THEN 1 ELSE 0 END AS ground_truth,
  COALESCE(arg_max(iv.fault_type, iv.event_seq), 'HEALTHY') AS fault_type
  FROM grid g LEFT JOIN iv ON iv.series_id = g.series_id AND g.ts BETWEEN iv.st AND iv.et
  GROUP BY g.series_id, g.ts)"""
LABELLED = (EV, GRID, FE, IV, LAB)


def fault_events(spark: SparkSession, sf_dir: str, raw: bool = False) -> DataFrame:
    """Fault events on the grid; with ``raw`` at their own times and under the old node names."""
    node = F.when(F.col("node") == "db", " MariaDB").when(F.col("node") == "app", "nextcloud").otherwise(F.col("node"))
    return (events(spark, sf_dir).where(F.col("event_type").isin("signup", "purchase") & (F.col("value") > 100))
            .select("series_id", F.col("event_id").alias("event_seq"), F.col("ts" if raw else "slot").alias("ts"),
                    (node if raw else F.col("node")).alias("node"),
                    F.concat(F.lit("F"), F.col("user_id") % 5).alias("fault_type"),
                    F.when(F.col("event_type") == "signup", "START").otherwise("STOP").alias("state"),
                    F.when(F.col("event_id") % 2 == 0, F.col("value") * 60).alias("duration_s")))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_intervals(fault_events(spark, sf_dir), pad=PAD, default=DEFAULT)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(grid(spark, sf_dir), intervals(spark, sf_dir), step=HOUR)


# ---- log lines --------------------------------------------------------------------------------------

LINES = """lines AS (SELECT event_id, series_id, node AS hint, ts AS event_ts,
  CASE event_id % 4
    WHEN 0 THEN '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] [' || upper(node) || '] ' || event_type || ' ' || props
    WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z stdout F ' || event_type || ' ' || props
    WHEN 2 THEN 'at ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' stderr P ' || event_type || ' timeout ' || props
    ELSE strftime(ts, '%Y-%m-%d %H:%M') || ' no seconds ' || event_type END AS line FROM ev)"""
_TAGGED = r"(?i)^\[(202\d-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})\]\s+\[(APP|DB|REDIS)\]\s+(.*)"
_STAMPED = r"(202\d-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}[^\s]*)\s+(.*)"
_FUSE = "error|fail|timeout|refused|exception|fatal|crit|fault_start|fault_stop|stress|oom|killed|panic"
PARSED = rf"""parsed AS (SELECT event_id, series_id, hint, line,
  regexp_matches(line, '{_TAGGED}') AS tagged, regexp_matches(line, '{_STAMPED}') AS stamped FROM lines)"""
LOGS = rf"""logs AS (SELECT *, date_trunc('hour', ts) AS slot, CASE WHEN regexp_matches(lower(message), '{_FUSE}') THEN 1 ELSE 0 END AS is_error,
    length(message) AS msg_len FROM (
  SELECT event_id, series_id,
  CASE WHEN tagged THEN lower(regexp_extract(line, '{_TAGGED}', 2)) ELSE hint END AS node,
  CASE WHEN tagged THEN regexp_extract(line, '{_TAGGED}', 3)
       ELSE regexp_replace(regexp_extract(line, '{_STAMPED}', 2), '^(stdout|stderr)\s+[FP]\s+', '') END AS message,
  CAST(replace(regexp_extract(line, '(\d{{4}}-\d{{2}}-\d{{2}}[T\s]\d{{2}}:\d{{2}}:\d{{2}})', 1), 'T', ' ') AS TIMESTAMP) AS ts
  FROM parsed WHERE tagged OR stamped))"""
LC = """lr AS (SELECT series_id, node, unnest(generate_series(min(slot), max(slot), INTERVAL 1 HOUR)) AS ts FROM logs GROUP BY series_id, node),
lc AS (SELECT r.series_id, r.node, r.ts, COALESCE(c.log_total, 0) AS log_total, COALESCE(c.log_error, 0) AS log_error, c.log_avg_len
  FROM lr r LEFT JOIN (SELECT series_id, node, slot, count(*) AS log_total, CAST(sum(is_error) AS BIGINT) AS log_error, avg(msg_len) AS log_avg_len
    FROM logs GROUP BY ALL) c ON c.series_id = r.series_id AND c.node = r.node AND c.slot = r.ts)"""
LOGGED = (EV, LINES, PARSED, LOGS)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    kind, kp = F.col("event_id") % 4, F.concat_ws(" ", "event_type", "props")
    line = (F.when(kind == 0, F.concat(F.lit("["), iso, F.lit("] ["), F.upper("node"), F.lit("] "), kp))
            .when(kind == 1, F.concat(iso, F.lit("Z stdout F "), kp))
            .when(kind == 2, F.concat(F.lit("at "), plain, F.lit(" stderr P "), F.col("event_type"), F.lit(" timeout "), F.col("props")))
            .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(" no seconds "), F.col("event_type"))))
    return spread(events(spark, sf_dir)).select("event_id", "series_id", F.col("node").alias("hint"), line.alias("line"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_measures(parse_node_lines(log_lines(spark, sf_dir), F.col("hint")))


# ---- fused table ------------------------------------------------------------------------------------

# (column, node, event type, aggregate): the metric slots filled from events.
METRIC_RULES = [
    ("app_cpu", "app", "click", "sum"), ("app_mem", "app", "view", "max"),
    ("app_latency", "app", "purchase", "avg"), ("app_probe_success", "app", "signup", "count"),
    ("db_cpu", "db", "click", "sum"), ("db_mem", "db", "view", "max"), ("db_threads", "db", "purchase", "avg"),
    ("redis_cpu", "redis", "click", "sum"), ("redis_mem", "redis", "view", "max"),
]
METRICS = [r[0] for r in METRIC_RULES]
WM = "wm AS (SELECT series_id, slot AS ts, " + ", ".join(
    f"CAST({fn}(value) FILTER (node = '{n}' AND event_type = '{e}') AS DOUBLE) AS {c}" for c, n, e, fn in METRIC_RULES
) + " FROM ev GROUP BY series_id, slot)"


def slot_sql(c: str) -> str:
    node = c.split("_")[0]
    for kind in ("log_total", "log_error"):
        if c == f"{node}_{kind}":
            return f"COALESCE(CAST({node}.{kind} AS DOUBLE), 0) AS {c}"
    if c.endswith("_log_avg_len"):
        return f"CASE WHEN {node}.ts IS NULL THEN 0.0 ELSE {node}.log_avg_len END AS {c}"
    return f"COALESCE(wm.{c}, 0.0) AS {c}" if c in METRICS else f"CAST(0 AS DOUBLE) AS {c}"


FUSED = "fused AS MATERIALIZED (SELECT lab.series_id, lab.ts, " + ", ".join(slot_sql(c) for c in FEATURES) + """,
  lab.ground_truth, lab.fault_type FROM lab LEFT JOIN wm ON wm.series_id = lab.series_id AND wm.ts = lab.ts """ + " ".join(
    f"LEFT JOIN lc {n} ON {n}.series_id = lab.series_id AND {n}.ts = lab.ts AND {n}.node = '{n}'" for n in NODES) + ")"
FUSE = (EV, GRID, FE, IV, LAB, LINES, PARSED, LOGS, LC, WM, FUSED)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide metric rows of the hours with any event."""
    fns = {"sum": F.sum, "max": F.max, "avg": F.avg, "count": lambda c: F.count(c).cast("double")}
    return events(spark, sf_dir).groupBy("series_id", F.col("slot").alias("ts")).agg(
        *[fns[fn](F.when((F.col("node") == n) & (F.col("event_type") == e), F.col("value"))).alias(c)
          for c, n, e, fn in METRIC_RULES])


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reindex_grid(metrics(spark, sf_dir), grid(spark, sf_dir))
    return fuse(rows, logs(spark, sf_dir), fault_events(spark, sf_dir, raw=True), HOUR, pad=PAD, default=DEFAULT)


# ---- scores -----------------------------------------------------------------------------------------

SC = """sc AS (SELECT l_linestatus AS model, l_extendedprice AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
  CASE WHEN l_returnflag = 'R' THEN 'F' || l_linenumber ELSE 'HEALTHY' END AS fault_type,
  l_orderkey, l_linenumber, l_shipdate, l_partkey, l_orderkey % 10 < 7 AS train FROM lineitem)"""
TH = "th AS (SELECT model, quantile_cont(score, 0.85) AS threshold FROM sc WHERE y = 0 GROUP BY model)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("model"), F.col("l_extendedprice").alias("score"), y.cast("int").alias("y"),
        F.when(y, F.concat(F.lit("F"), F.col("l_linenumber"))).otherwise("HEALTHY").alias("fault_type"),
        *SCORE_ORDER, (F.col("l_orderkey") % 10 < 7).alias("train"))


def score_chunk() -> Column:
    """Order keys are dense, so equal key ranges hold about equally many rows at any size of the table."""
    return number_chunk("l_orderkey", 1 << 14)


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from faultlens.operators.curves import healthy_percentiles
    return healthy_percentiles(scores(spark, sf_dir), [85]).select("model", "threshold")


def clip_sql(x: str) -> str:
    return f"greatest(least({x}, 6.0), -6.0)"


def r6(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) AS {name or x.split('.')[-1]}"
