"""Projections, filters, text and naming functions."""

from pyspark.sql import functions as F

from faultlens.bindings.base import (EV, FUSE, HOUR, LOGGED, METRICS, SC, WM, events, fused, log_lines, metrics,
                                     query, scores, table, with_)
from faultlens.functions import naming, numeric, text
from faultlens.operators import clean
from faultlens.schemas import FEATURES


@query("b1_normalize_ts", """SELECT event_id, date_trunc('hour', ts - INTERVAL '5 hours 30 minutes') AS ts FROM events
WHERE event_id % 97 <> 0""")
def _(spark, sf):
    """Times arrive as text in another zone; some are not times at all."""
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 97 == 0, "n/a").otherwise(
        F.col("ts").cast("string")).alias("ts"))
    return clean.normalize_ts(e, "ts", HOUR, zone="+05:30")


@query("b2_align_schema", with_(EV, WM) + "SELECT series_id, ts, " + ", ".join(
    f"round(COALESCE({c}, 0.0), 6) AS {c}" if c in METRICS else f"CAST(0 AS DOUBLE) AS {c}" for c in FEATURES) + " FROM wm")
def _(spark, sf):
    return clean.align_schema(clean.fill_partial(metrics(spark, sf)), FEATURES, keep=["series_id", "ts"])


@query("b3_node_alias", """SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'db' WHEN 1 THEN 'app' WHEN 2 THEN 'db' WHEN 3 THEN 'redis' ELSE 'app' END AS node
FROM events""")
def _(spark, sf):
    raw = F.element_at(F.array(*[F.lit(x) for x in (" MariaDB ", "nextcloud", "NextcloudDB", "redis", "nextcloud_app ")]),
                       (F.col("user_id") % 5 + 1).cast("int"))
    return clean.normalize_nodes(events(spark, sf).select("event_id", raw.alias("node")))


_SHIFT = """SELECT e.event_id, date_trunc('hour', e.ts + to_days(CAST((SELECT CAST(min(o_orderdate) AS DATE) FROM orders) -
  (SELECT CAST(min(ts) AS DATE) FROM events) AS INTEGER))) AS ts FROM events e"""


@query("b4_shift_to_metric_day", _SHIFT)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"))
    return clean.shift_to_metric_day(events(spark, sf).select("event_id", "ts"), orders, HOUR)


@query("b4_shift_per_series", with_(EV, "f AS (SELECT series_id, min(ts) FILTER (event_type = 'error') AS e, min(ts) FILTER (event_type = 'click') AS m FROM ev GROUP BY 1)") +
       """SELECT ev.event_id, ev.series_id, date_trunc('hour', ev.ts + to_days(CAST(CAST(m AS DATE) - CAST(e AS DATE) AS INTEGER))) AS ts
FROM ev JOIN f USING (series_id) WHERE event_type = 'error'""")
def _(spark, sf):
    e = events(spark, sf).select("event_id", "series_id", "ts", "event_type")
    return clean.shift_to_metric_day(e.where("event_type = 'error'"), e.where("event_type = 'click'"), HOUR,
                                     keys=["series_id"]).drop("event_type")


@query("b5_time_range", "SELECT event_id, ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'")
def _(spark, sf):
    return clean.time_range(table(spark, sf, "events").select("event_id", "ts", "value"), "2024-01-05 00:00:00", "2024-01-12 12:00:00")


@query("b6_state_filter", """SELECT event_id, 'any' AS mode FROM events WHERE event_type IN ('click', 'view')
UNION ALL SELECT event_id, 'exact' FROM events WHERE event_type = 'click'""")
def _(spark, sf):
    state = F.when(F.col("event_type") == "click", "START").when(F.col("event_type") == "view", "Start").otherwise("STOP")
    e = events(spark, sf).select("event_id", state.alias("state"))
    return (clean.state_filter(e, "START").select("event_id", F.lit("any").alias("mode"))
            .unionByName(clean.state_filter(e, "START", ignore_case=False).select("event_id", F.lit("exact").alias("mode"))))


@query("b7_drop_empty_fill_partial", with_(EV, WM) + "SELECT series_id, ts, " + ", ".join(f"round(COALESCE({c}, 0), 6) AS {c}" for c in METRICS) +
       " FROM wm WHERE " + " OR ".join(f"{c} IS NOT NULL" for c in METRICS))
def _(spark, sf):
    return clean.fill_partial(clean.drop_empty_rows(metrics(spark, sf), METRICS), METRICS)


@query("b8_finite_guard", """SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, CASE l_suppkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 6.0 WHEN 2 THEN -6.0 WHEN 3 THEN 0.0
ELSE round(l_quantity, 6) END AS x FROM lineitem""")
def _(spark, sf):
    k = F.col("l_suppkey") % 5
    x = (F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf"))
         .when(k == 3, F.lit(None)).otherwise(F.col("l_quantity")))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", x.cast("double").alias("x"))
    return clean.finite_guard(rows, ["x"])


@query("b9_order_features", with_(*FUSE) + "SELECT ts, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + ", series_id FROM fused")
def _(spark, sf):
    f = fused(spark, sf)
    return f.select("ts", *clean.order_features(list(reversed(f.columns))), "series_id")


@query("b10_feature_names", with_(EV, WM) + "SELECT f AS feature, count(*) AS n_rows FROM wm, (SELECT unnest([" + ", ".join(
    f"'{c}'" for c in [*METRICS[:4], *[c + "_delta" for c in METRICS[:4]], "pad_live_0"]) + "]) AS f) GROUP BY f")
def _(spark, sf):
    names = clean.feature_names(METRICS[:4])
    rows = metrics(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.select(F.explode(F.array(*[F.lit(n) for n in names])).alias("feature"), "n_rows")


@query("b11_numeric_columns", "SELECT event_id, user_id, round(value, 6) AS value FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.select(*clean.numeric_columns(e))


@query("b12_known_anomalies", with_(SC) + "SELECT model, fault_type, count(*) AS n FROM sc WHERE y = 1 AND fault_type NOT IN ('HEALTHY', 'UNKNOWN') GROUP BY ALL")
def _(spark, sf):
    return clean.known_anomalies(scores(spark, sf)).groupBy("model", "fault_type").agg(F.count(F.lit(1)).alias("n"))


_NAMES = """names AS (SELECT series_id, node AS own, event_id AS seq, CASE event_id % 4 WHEN 0 THEN node || '-Exporter-' || user_id
  WHEN 1 THEN 'Svc_' || upper(node) || '_' || user_id WHEN 2 THEN 'loki-' || node ELSE 'x' || event_type END AS name FROM ev)"""


@query("b13_match_source", with_(EV, _NAMES, """hit AS (SELECT names.series_id, n.node, arg_min(name, seq) AS source FROM names, (SELECT unnest(['app', 'db', 'redis']) AS node) n
  WHERE contains(lower(name), n.node) AND NOT regexp_matches(lower(name), 'promtail|exporter|cadvisor|loki') GROUP BY ALL)""") +
       "SELECT s.series_id, s.node, COALESCE(hit.source, s.node) AS source FROM (SELECT DISTINCT series_id, node FROM ev) s LEFT JOIN hit USING (series_id, node)")
def _(spark, sf):
    e = events(spark, sf)
    k = F.col("event_id") % 4
    name = (F.when(k == 0, F.concat("node", F.lit("-Exporter-"), "user_id"))
            .when(k == 1, F.concat(F.lit("Svc_"), F.upper("node"), F.lit("_"), "user_id"))
            .when(k == 2, F.concat(F.lit("loki-"), "node")).otherwise(F.concat(F.lit("x"), "event_type")))
    names = e.select("series_id", F.col("event_id").alias("seq"), name.alias("name"))
    return clean.match_source(names, e.select("series_id", "node").distinct(), keys=["series_id"])


@query("b14_relabel", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || '-' || user_id END AS container,
  CASE WHEN event_id % 2 = 0 THEN event_type || '-' || user_id END AS container_name, 'http://' || event_type AS param_target, 'probe:9115' AS address FROM events""")
def _(spark, sf):
    name = F.concat(F.when(F.col("event_id") % 2 == 0, "/").otherwise(""), "event_type", F.lit("-"), "user_id")
    e = events(spark, sf).select("event_id", name.alias("name"), F.concat(F.lit("http://"), "event_type").alias("address"))
    return clean.relabel(e, target="probe:9115").drop("name")


@query("b15_label_match", with_(EV) + "SELECT event_id FROM ev WHERE regexp_full_match(event_type || '-' || node, '.*(click|view)-[ad].*')")
def _(spark, sf):
    e = events(spark, sf).select("event_id", F.create_map(F.lit("name"), F.concat("event_type", F.lit("-"), "node")).alias("labels"))
    return clean.label_match(e, "name", ".*(click|view)-[ad].*").select("event_id")


# ---- text -------------------------------------------------------------------------------------------

_T = r"(?i)^\[(202\d-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})\]\s+\[(APP|DB|REDIS)\]\s+(.*)"
_S = r"(202\d-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}[^\s]*)\s+(.*)"


@query("g1_parse_sim_line", with_(*LOGGED) + f"""SELECT event_id, regexp_extract(line, '{_T}', 1) AS stamp, lower(regexp_extract(line, '{_T}', 2)) AS node,
  regexp_extract(line, '{_T}', 3) AS message FROM parsed WHERE tagged""")
def _(spark, sf):
    lines = log_lines(spark, sf).withColumn("p", text.parse_sim_line(F.col("line")))
    return lines.where("p IS NOT NULL").select("event_id", "p.*")


@query("g2_parse_ts_line", with_(*LOGGED) + rf"""SELECT event_id, regexp_extract(line, '{_S}', 1) AS stamp,
  regexp_replace(regexp_extract(line, '{_S}', 2), '^(stdout|stderr)\s+[FP]\s+', '') AS message FROM parsed WHERE stamped""")
def _(spark, sf):
    lines = log_lines(spark, sf).withColumn("p", text.parse_ts_line(F.col("line")))
    return lines.where("p IS NOT NULL").select("event_id", "p.*")


@query("g3_strip_stream_prefix", r"""SELECT event_id, event_type || ' ' || props AS message FROM events WHERE event_id % 3 <> 2
UNION ALL SELECT event_id, 'x stdout F ' || event_type FROM events WHERE event_id % 3 = 2""")
def _(spark, sf):
    k = F.col("event_id") % 3
    raw = (F.when(k == 0, F.concat_ws(" ", F.lit("stdout  F"), "event_type", "props"))
           .when(k == 1, F.concat_ws(" ", F.lit("stderr P"), "event_type", "props"))
           .otherwise(F.concat_ws(" ", F.lit("x stdout F"), "event_type")))
    return events(spark, sf).select("event_id", text.strip_stream_prefix(raw).alias("message"))


@query("g4_clean_ts", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('second', ts) END AS ts FROM events")
def _(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    k = F.col("event_id") % 5
    raw = (F.when(k == 0, F.lit("2024-13-45T99:00:00")).when(k == 1, F.concat(F.lit("["), iso, F.lit("]")))
           .when(k == 2, F.concat(iso, F.lit("Z"))).otherwise(F.replace(iso, F.lit("T"), F.lit(" "))))
    return events(spark, sf).select("event_id", text.clean_ts(raw).alias("ts"))


@query("g5_infer_node", """SELECT doc_id, CASE WHEN contains(lower(text), 'redis') THEN 'redis' WHEN contains(lower(text), 'maria') OR contains(lower(text), 'mysql') THEN 'db' ELSE 'app' END AS node
FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.infer_node(F.col("text")).alias("node"))


@query("g6_section_node", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN NULL
  WHEN event_id % 4 = 1 THEN 'db' ELSE CASE user_id % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'db' ELSE 'redis' END END AS node FROM events""")
def _(spark, sf):
    k = F.col("event_id") % 4
    line = (F.when(k == 0, F.concat(F.lit("==== "), F.col("node"), F.lit(" (docker) ===="))).when(k == 1, F.lit("== MariaDB =="))
            .when(k == 2, F.lit("=== other ===")).otherwise(F.concat(F.lit("app "), F.col("event_type"))))
    return events(spark, sf).select("event_id", text.section_node(line).alias("node"))


_HARVEST = "error|fail|crit|fatal|exception|refused|timeout|deadlock|reset|denied|oom|panic|segfault|abort|connection lost|too many|max retries|unavailable"
_FUSEW = "error|fail|timeout|refused|exception|fatal|crit|fault_start|fault_stop|stress|oom|killed|panic"


@query("g7_error_flag", f"""SELECT doc_id, CAST(regexp_matches(lower(text), '{_FUSEW}') AS INTEGER) AS fuse_error, CAST(regexp_matches(lower(text), '{_HARVEST}') AS INTEGER) AS harvest_error
FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.error_flag(F.col("text")).alias("fuse_error"),
                                                text.error_flag(F.col("text"), text.HARVEST_WORDS).alias("harvest_error"))


@query("g8_msg_len", "SELECT doc_id, CAST(length(text) AS INTEGER) AS msg_len FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.msg_len(F.col("text")).alias("msg_len"))


@query("g9_scale_clip", """SELECT event_id, round(greatest(least((value - 50.0) / 7.5, 6.0), -6.0), 6) AS z FROM events""")
def _(spark, sf):
    return events(spark, sf).select("event_id", numeric.scale_clip(F.col("value"), F.lit(50.0), F.lit(7.5)).alias("z"))


# ---- names and verdicts -----------------------------------------------------------------------------

_NAMED = """named AS (SELECT event_id, CASE user_id % 8 WHEN 0 THEN 'app_cpu' WHEN 1 THEN 'db_log_error_delta' WHEN 2 THEN 'redis_pad_prom_1' WHEN 3 THEN 'plain'
  WHEN 4 THEN 'app_log_avg_len_delta' WHEN 5 THEN 'db_threads' WHEN 6 THEN 'worker_queue_depth' ELSE 'redis_mem_delta' END AS name FROM events)"""
_SHOWN = """shown AS (SELECT event_id, name, CASE name WHEN 'app_cpu' THEN 'Nextcloud' WHEN 'db_log_error_delta' THEN 'MySQL' WHEN 'redis_pad_prom_1' THEN 'Padding' WHEN 'plain' THEN 'Unknown'
  WHEN 'app_log_avg_len_delta' THEN 'Nextcloud' WHEN 'db_threads' THEN 'MySQL' WHEN 'worker_queue_depth' THEN 'Worker' ELSE 'Redis' END AS node,
  CASE name WHEN 'app_cpu' THEN 'CPUUtil' WHEN 'db_log_error_delta' THEN 'ErrorRate' WHEN 'redis_pad_prom_1' THEN 'Pad' WHEN 'plain' THEN 'plain'
  WHEN 'app_log_avg_len_delta' THEN 'Log_Avg_Len_Delta' WHEN 'db_threads' THEN 'ActiveThreads' WHEN 'worker_queue_depth' THEN 'Queue_Depth' ELSE 'MemUtil' END AS feature FROM named)"""
_TAGGEDF = "tagf AS (SELECT event_id, node, CASE WHEN ends_with(name, '_delta') THEN feature || ' (Velocity)' ELSE feature END AS feature FROM shown)"


def _shown(spark, sf):
    names = ["app_cpu", "db_log_error_delta", "redis_pad_prom_1", "plain", "app_log_avg_len_delta", "db_threads",
             "worker_queue_depth", "redis_mem_delta"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("user_id") % 8 + 1).cast("int"))
    e = events(spark, sf).select("event_id", name.alias("name"))
    return e.withColumn("p", naming.parse_feature_name(F.col("name"))).select("event_id", "name", "p.*")


@query("g11_parse_feature_name", with_(_NAMED, _SHOWN) + "SELECT * FROM shown")
def _(spark, sf):
    return _shown(spark, sf)


@query("g12_velocity_tag", with_(_NAMED, _SHOWN, _TAGGEDF) + "SELECT event_id, feature FROM tagf")
def _(spark, sf):
    return _shown(spark, sf).select("event_id", naming.velocity_tag(F.col("feature"), F.col("name").endswith("_delta")).alias("feature"))


def _guide_sql() -> str:
    rows = ", ".join("(" + ", ".join(f"'{x}'" for x in (k, *v)) + ")" for k, v in naming.GUIDANCE.items())
    return f"guide(base, t, i, a) AS (VALUES {rows})"


@query("g13_guidance", with_(_NAMED, _SHOWN, _TAGGEDF, _guide_sql()) + """SELECT event_id, COALESCE(t, 'Service - Behavioral Anomaly') AS anomaly_type,
  CASE WHEN t IS NULL THEN 'Abnormal behavior is centered around ' || node WHEN contains(feature, 'Velocity') THEN 'Rapid change detected in ' || base || ' for ' || node
       ELSE replace(i, '{node}', node) END AS insight,
  CASE WHEN t IS NULL THEN 'Inspect recent metric deviations and dependency health for ' || node
       WHEN contains(feature, 'Velocity') THEN 'Inspect what changed abruptly in ' || node || ' and correlate with recent spikes or drops'
       ELSE replace(a, '{node}', node) END AS action FROM tagf LEFT JOIN guide ON base = replace(feature, ' (Velocity)', '')""")
def _(spark, sf):
    e = _shown(spark, sf)
    feature = naming.velocity_tag(F.col("feature"), F.col("name").endswith("_delta"))
    return e.select("event_id", naming.guidance(F.col("node"), feature).alias("g")).select("event_id", "g.*")


@query("c9_lookup_joins", with_(EV, _guide_sql(), """nn(node, node_name) AS (VALUES ('app', 'Nextcloud'), ('db', 'MySQL'), ('redis', 'Redis'))""",
                                "fn(metric, feature_name) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in naming.FEATURE_DISPLAY.items()) + ")") +
       """SELECT event_id, node_name, feature_name, t AS anomaly_type, replace(i, '{node}', node_name) AS insight
FROM (SELECT *, CASE event_type WHEN 'click' THEN 'cpu' WHEN 'view' THEN 'mem' WHEN 'purchase' THEN 'latency' WHEN 'error' THEN 'log_error' ELSE 'other' END AS metric FROM ev) e
LEFT JOIN nn USING (node) LEFT JOIN fn USING (metric) LEFT JOIN guide ON base = feature_name""")
def _(spark, sf):
    metric = (F.when(F.col("event_type") == "click", "cpu").when(F.col("event_type") == "view", "mem")
              .when(F.col("event_type") == "purchase", "latency").when(F.col("event_type") == "error", "log_error").otherwise("other"))
    e = events(spark, sf).select("event_id", "node", metric.alias("metric"))
    # The three tables are constants of this library, so their size is known.
    out = (e.join(F.broadcast(naming.node_table(spark)), "node", "left")
           .join(F.broadcast(naming.feature_table(spark)), "metric", "left")
           .join(F.broadcast(naming.guidance_table(spark)), "feature_name", "left"))
    return out.select("event_id", "node_name", "feature_name", "anomaly_type",
                      F.replace("insight", F.lit("{node}"), F.col("node_name")).alias("insight"))


@query("g14_severity", """SELECT event_id, CASE WHEN value < 40 THEN 'NORMAL' WHEN value < 60 THEN 'LOW' WHEN value < 80 THEN 'MEDIUM' ELSE 'HIGH' END AS severity FROM events""")
def _(spark, sf):
    return events(spark, sf).select("event_id", numeric.severity(F.col("value"), F.lit(40.0)).alias("severity"))


@query("g15_confidence", "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 1.0::DOUBLE ELSE round(least(1.0, value / (2 * (user_id % 7) * 10)), 6) END AS confidence FROM events")
def _(spark, sf):
    thr = (F.col("user_id") % 7 * 10).cast("double")
    return events(spark, sf).select("event_id", numeric.confidence(F.col("value"), thr).alias("confidence"))


@query("g17_fill_from_mean", """SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN (SELECT avg(value) FROM events) ELSE 0.0 END ELSE value END, 6) AS x FROM events""")
def _(spark, sf):
    e = events(spark, sf).select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("x"))
    mean = events(spark, sf).agg(F.avg("value")).scalar()
    known = F.when(F.col("event_id") % 2 == 0, mean)
    return e.select("event_id", numeric.fill_from_mean(F.col("x"), known).alias("x"))
