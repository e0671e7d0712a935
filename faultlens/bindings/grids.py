"""Samples and logs on the grid, trailing ranges, sections, set operations."""

from pyspark.sql import functions as F

from faultlens.bindings.base import (EV, FUSE, GRID, HOUR, LC, LINES, LOGGED, LOGS, METRICS, NODES, PARSED, WM, events,
                                     fused, grid, log_lines, logs, metrics, query, slot_sql, with_)
from faultlens.operators import grid as g
from faultlens.operators import rollup
from faultlens.operators.ordered import number_chunk, running_sum, time_chunk
from faultlens.operators.sequence import fill_section
from faultlens.schemas import FEATURES
from faultlens.sources import files
from faultlens.functions.text import section_node

SAMPLES = "sm AS (SELECT series_id, event_type AS metric, slot AS ts, max(value) AS val FROM ev GROUP BY ALL)"


def samples(spark, sf):
    return events(spark, sf).groupBy("series_id", F.col("event_type").alias("metric"), F.col("slot").alias("ts")).agg(
        F.max("value").alias("val"))


@query("c4_fuse_logs", with_(EV, GRID, LINES, PARSED, LOGS, LC) + "SELECT grid.series_id, grid.ts, " + ", ".join(
    f"round({slot_sql(c)}, 6) AS {c}".replace(f" AS {c}, 6)", ", 6)") for c in FEATURES if "_log_" in c) + " FROM grid " + " ".join(
    f"LEFT JOIN lc {n} ON {n}.series_id = grid.series_id AND {n}.ts = grid.ts AND {n}.node = '{n}'" for n in NODES))
def _(spark, sf):
    return g.fuse_logs(grid(spark, sf), g.log_counts(logs(spark, sf), HOUR)).select(
        "series_id", "ts", *[c for c in FEATURES if "_log_" in c])


@query("fused_table", with_(*FUSE) + "SELECT series_id, ts, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + ", ground_truth, fault_type FROM fused")
def _(spark, sf):
    return fused(spark, sf)


@query("c5_reindex_grid", with_(EV, GRID, WM) + "SELECT grid.series_id, grid.ts, " + ", ".join(f"round({c}, 6) AS {c}" for c in METRICS) +
       " FROM grid LEFT JOIN wm ON wm.series_id = grid.series_id AND wm.ts = grid.ts")
def _(spark, sf):
    return g.reindex_grid(metrics(spark, sf), grid(spark, sf))


@query("c6_asof_fill", with_(EV, GRID, SAMPLES, "gm AS (SELECT series_id, ts, unnest(['click', 'view', 'purchase', 'signup', 'error']) AS metric FROM grid)") +
       """SELECT gm.series_id, gm.metric, gm.ts, round(COALESCE(sm.val, 0.0), 6) AS val FROM gm ASOF LEFT JOIN sm
  ON sm.series_id = gm.series_id AND sm.metric = gm.metric AND gm.ts >= sm.ts""")
def _(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("click", "view", "purchase", "signup", "error")])
    wanted = grid(spark, sf).withColumn("metric", F.explode(kinds))
    return g.asof_fill(samples(spark, sf), wanted)


@query("c7_align_label_sets", with_(EV) + "SELECT series_id, event_type AS metric, slot AS ts, max(value) AS val FROM ev GROUP BY ALL")
def _(spark, sf):
    return g.align_label_sets(events(spark, sf).select("series_id", F.col("event_type").alias("metric"), F.col("slot").alias("ts"),
                                                       F.col("value").alias("val")))


def responses(spark, sf):
    """Range-query responses, one per series and day, and as many of further series (below zero) that answer with nothing."""
    e = events(spark, sf).withColumn("day", F.to_date("ts"))
    one = F.concat(F.lit("["), F.unix_seconds("ts"), F.lit(',"'), F.col("value").cast("string"), F.lit('"]'))
    series = e.groupBy("series_id", "day", "node").agg(F.array_sort(F.collect_list(F.struct("ts", one.alias("v")))).alias("l"))
    text = F.concat(F.lit('{"metric":{"name":"'), "node", F.lit('"},"values":['), F.array_join(F.transform("l", lambda x: x["v"]), ","), F.lit("]}"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", text.alias("s")))), lambda x: x["s"]), ",")
    full = F.concat(F.lit('{"data":{"result":['), body, F.lit("]}}"))
    given = series.groupBy("series_id", "day").agg(full.alias("json"))
    empty = e.select((-1 - F.col("series_id")).alias("series_id"), "day").distinct().withColumn("json", F.lit('{"data":{"result":[]}}'))
    return given.unionByName(empty)


@query("a5_read_range_json", with_(EV) + """SELECT series_id, CAST(ts AS DATE) AS day, CAST(dense_rank() OVER (PARTITION BY series_id, CAST(ts AS DATE) ORDER BY node) - 1 AS INTEGER) AS result_idx,
  node AS name, date_trunc('second', ts) AS ts, value AS val FROM ev""")
def _(spark, sf):
    return files.read_range_json(responses(spark, sf)).withColumn("name", F.col("labels")["name"]).drop("labels")


@query("c7b_first_label_set", with_(EV) + """SELECT series_id, CAST(ts AS DATE) AS day, node AS name, date_trunc('second', ts) AS ts, value AS val FROM
  (SELECT *, dense_rank() OVER (PARTITION BY series_id, CAST(ts AS DATE) ORDER BY node) AS r FROM ev) WHERE r = 1""")
def _(spark, sf):
    return g.first_label_set(files.read_range_json(responses(spark, sf))).withColumn("name", F.col("labels")["name"]).drop("labels", "result_idx")


_NV = "nv AS (SELECT series_id, slot AS ts, node, sum(value) AS val FROM ev GROUP BY ALL)"


@query("c8_node_pairs", with_(EV, _NV) + """SELECT a.series_id, a.ts, a.node AS src, b.node AS dst, round(a.val, 6) AS src_val, round(b.val, 6) AS dst_val
FROM nv a JOIN nv b ON a.series_id = b.series_id AND a.ts = b.ts""")
def _(spark, sf):
    nodes = events(spark, sf).groupBy("series_id", F.col("slot").alias("ts"), "node").agg(F.sum("value").alias("val"))
    return g.node_pairs(nodes)


@query("d1_log_counts", with_(*LOGGED, LC) + "SELECT series_id, node, ts, log_total, log_error, round(log_avg_len, 6) AS log_avg_len FROM lc")
def _(spark, sf):
    return g.log_counts(logs(spark, sf), HOUR)


_HARVEST = "error|fail|crit|fatal|exception|refused|timeout|deadlock|reset|denied|oom|panic|segfault|abort|connection lost|too many|max retries|unavailable"
IMPULSES = rf"""imp AS (SELECT series_id, hint AS node, date_trunc('hour', event_ts) AS ts, CASE WHEN regexp_matches(lower(line), '{_HARVEST}') THEN 1 ELSE 0 END AS is_err, length(line) AS len
  FROM lines WHERE regexp_matches(line, '\d{{4}}-\d{{2}}-\d{{2}}[T\s]\d{{2}}:\d{{2}}:\d{{2}}'))"""


def impulses(spark, sf):
    from faultlens.functions.numeric import floor_ts
    return files.harvest_impulses(log_lines(spark, sf), F.col("hint")).withColumn("ts", floor_ts(F.col("ts"), HOUR))


@query("d2_log_counts_pivot", with_(EV, LINES, IMPULSES) + "SELECT series_id, ts, " + ", ".join(
    f"CAST(COALESCE(sum(is_err) FILTER (node = '{n}'), 0) AS BIGINT) AS {n}_log_error, count(*) FILTER (node = '{n}') AS {n}_log_total, "
    f"round(COALESCE(avg(len) FILTER (node = '{n}'), 0.0), 6) AS {n}_log_avg_len" for n in NODES) + " FROM imp GROUP BY series_id, ts")
def _(spark, sf):
    return g.log_counts_pivot(impulses(spark, sf))


@query("s1_union_logs", with_(EV, LINES, IMPULSES) + """SELECT series_id, node, ts, count(*) AS n, CAST(sum(is_err) AS BIGINT) AS errors FROM
  (SELECT * FROM imp UNION ALL SELECT * FROM imp WHERE node <> 'app') GROUP BY ALL""")
def _(spark, sf):
    both = g.union_logs(impulses(spark, sf), impulses(spark, sf).where("node <> 'app'"))
    return both.groupBy("series_id", "node", "ts").agg(F.count(F.lit(1)).alias("n"), F.sum("is_err").alias("errors"))


@query("s2_merge_node_logs", with_(*LOGGED) + "SELECT series_id, event_id, node, message, ts, is_error, CAST(msg_len AS INTEGER) AS msg_len FROM logs")
def _(spark, sf):
    parts = [log_lines(spark, sf).where(F.col("hint") == n) for n in NODES]
    return files.log_measures(files.parse_node_lines(g.union_logs(*parts), F.col("hint"))).select(
        "series_id", "event_id", "node", "message", "ts", "is_error", "msg_len")


_RANGE = "RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW"


# A counter per series and event type: the running sum of the values, which begins anew at every event whose number ends in 99.
_COUNTER = """ct AS (SELECT event_id, series_id, event_type AS metric, ts, sum(value) OVER (PARTITION BY series_id, event_type, life ORDER BY ts ROWS UNBOUNDED PRECEDING) AS val FROM
    (SELECT *, count(*) FILTER (event_id % 100 = 99) OVER (PARTITION BY series_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS life FROM ev))"""


@query("d3_counter_rate", with_(EV, _COUNTER, """st AS (SELECT *, CASE WHEN lag(val) OVER w IS NULL THEN 0.0 WHEN val >= lag(val) OVER w THEN val - lag(val) OVER w ELSE val END AS rise
    FROM ct WINDOW w AS (PARTITION BY series_id, metric ORDER BY ts))""",
                                f"""rt AS (SELECT *, sum(rise) OVER w - first_value(rise) OVER w AS inc, (epoch_us(ts) - first_value(epoch_us(ts)) OVER w) / 1e6 AS span FROM st
    WINDOW w AS (PARTITION BY series_id, metric ORDER BY epoch_us(ts) {_RANGE}))""") +
       "SELECT event_id, series_id, metric, ts, round(val, 6) AS val, CASE WHEN span > 0 THEN round(inc / span * 100, 6) END AS rate FROM rt")
def _(spark, sf):
    e = events(spark, sf).select("event_id", "series_id", F.col("event_type").alias("metric"), "ts", "value")
    lives = running_sum(e, ["series_id", "metric"], ["ts"], time_chunk("ts"), (F.col("event_id") % 100 == 99).cast("int"), "life")
    counter = running_sum(lives, ["series_id", "metric", "life"], ["ts"], time_chunk("ts"), F.col("value"), "val").drop("life", "value")
    return rollup.counter_rate(counter, 48 * HOUR, factor=100.0)


@query("d4_max_over_time", with_(EV) + f"""SELECT event_id, series_id, event_type AS metric, ts, value AS val,
  max(value) OVER (PARTITION BY series_id, event_type ORDER BY epoch_us(ts) {_RANGE}) AS max_val FROM ev""")
def _(spark, sf):
    e = events(spark, sf).select("event_id", "series_id", F.col("event_type").alias("metric"), "ts", F.col("value").alias("val"))
    return rollup.max_over_time(e, 48 * HOUR)


@query("d5_metric_fallback", with_(EV, GRID, """alt AS (SELECT series_id, slot AS ts, node AS label_set, CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS rank, max(value) AS val
    FROM ev GROUP BY ALL)""",
                                   "best AS (SELECT series_id, ts, label_set, arg_min(val, rank) AS val FROM alt GROUP BY ALL)") +
       """SELECT grid.series_id, grid.ts, COALESCE(label_set, '') AS label_set, COALESCE(val, 1.0) AS val
FROM grid LEFT JOIN best ON best.series_id = grid.series_id AND best.ts = grid.ts""")
def _(spark, sf):
    e = events(spark, sf)
    parts = [e.where(F.col("event_type") == k).groupBy("series_id", F.col("slot").alias("ts"), F.col("node").alias("label_set"))
             .agg(F.max("value").alias("val")) for k in ("purchase", "view", "click", "signup", "error")]
    return rollup.metric_fallback(parts, grid=grid(spark, sf), const=1.0)


@query("d11_availability", with_(EV, GRID, WM) + " UNION ALL ".join(
    f"SELECT '{c}' AS metric, count({c}) AS present, count(*) FILTER ({c} <> 0) AS non_zero FROM grid LEFT JOIN wm USING (series_id, ts)" for c in METRICS))
def _(spark, sf):
    from faultlens.operators.profiling import availability
    return availability(g.reindex_grid(metrics(spark, sf), grid(spark, sf)), METRICS)


# ---- sections of an archive: one file per series, one line per event -------------------------------

ARCHIVE = """arc AS (SELECT series_id, event_id AS line_no, CASE WHEN event_id % 40 = 7 THEN '=== ' || upper(node) || ' (docker) ===' WHEN event_id % 40 = 27 THEN '=== other ===' ELSE line END AS line
  FROM lines JOIN (SELECT event_id, node FROM ev) USING (event_id))"""


def archive(spark, sf):
    k = F.col("event_id") % 40
    line = (F.when(k == 7, F.concat(F.lit("=== "), F.upper("hint"), F.lit(" (docker) ===")))
            .when(k == 27, "=== other ===").otherwise(F.col("line")))
    return log_lines(spark, sf).select("series_id", F.col("event_id").alias("line_no"), line.alias("line"))


_HDR = """hd AS (SELECT *, starts_with(line, '=') AS is_hdr, CASE WHEN starts_with(line, '=') THEN CASE WHEN contains(upper(line), 'APP') THEN 'app' WHEN contains(upper(line), 'DB') THEN 'db'
  WHEN contains(upper(line), 'REDIS') THEN 'redis' END END AS hdr FROM arc)"""
_SEC = "sec AS (SELECT *, last_value(hdr IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY line_no) AS section FROM hd)"


@query("e6_fill_section", with_(EV, LINES, ARCHIVE, _HDR, _SEC) + "SELECT series_id, line_no, section FROM sec")
def _(spark, sf):
    lines = archive(spark, sf).withColumn("hdr", section_node(F.col("line")))
    return fill_section(lines, "hdr", ["series_id"], "line_no", number_chunk("line_no", 4096)).select("series_id", "line_no", "section")


_TAG = r"(?i)^\[(202\d-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})\]\s+\[(APP|DB|REDIS)\]\s+(.*)"
_STA = r"(202\d-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}[^\s]*)\s+(.*)"


@query("a4_read_log_archive", with_(EV, LINES, ARCHIVE, _HDR, _SEC, rf"""pr AS (SELECT series_id, line_no, section, regexp_matches(line, '{_TAG}') AS tagged, line,
  CASE WHEN regexp_matches(line, '{_TAG}') THEN regexp_extract(line, '{_TAG}', 3) ELSE regexp_replace(regexp_extract(line, '{_STA}', 2), '^(stdout|stderr)\s+[FP]\s+', '') END AS message
  FROM sec WHERE NOT is_hdr AND (regexp_matches(line, '{_TAG}') OR regexp_matches(line, '{_STA}')))""",
                                    """gs AS (SELECT series_id, arg_min(CASE WHEN contains(lower(message), 'redis') THEN 'redis' WHEN contains(lower(message), 'maria') OR contains(lower(message), 'mysql') THEN 'db' ELSE 'app' END, line_no) AS guess
  FROM pr WHERE NOT tagged GROUP BY series_id)""") + rf"""SELECT series_id, line_no, CASE WHEN tagged THEN lower(regexp_extract(line, '{_TAG}', 2)) ELSE COALESCE(section, guess) END AS node, message,
  CAST(replace(regexp_extract(line, '(\d{{4}}-\d{{2}}-\d{{2}}[T\s]\d{{2}}:\d{{2}}:\d{{2}})', 1), 'T', ' ') AS TIMESTAMP) AS ts, CAST(length(message) AS INTEGER) AS msg_len
FROM pr LEFT JOIN gs USING (series_id)""")
def _(spark, sf):
    parsed = files.parse_archive_lines(archive(spark, sf), ["series_id"], "line_no", number_chunk("line_no", 4096))
    return files.log_measures(parsed).select("series_id", "line_no", "node", "message", "ts", "msg_len")


_CSVCASE = """CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE round(value, 2) END"""


@query("a2_read_fault_events", with_(EV) + """SELECT CAST(series_id AS VARCHAR) AS file, event_id AS event_seq, date_trunc('second', ts) AS ts, node, 'F' || (user_id % 5) AS fault_type,
  CASE WHEN event_type = 'signup' THEN 'START' ELSE 'STOP' END AS state, 'HIGH' AS intensity, CASE WHEN event_id % 4 >= 2 THEN value END AS duration_s,
  CASE WHEN event_id % 4 = 3 THEN 'm=' || user_id END AS metadata FROM ev WHERE event_type IN ('signup', 'purchase') AND event_id % 4 <> 0 AND event_id % 31 <> 5 AND event_id > 0""")
def _(spark, sf):
    """Lines of 8 (dropped), 6 (old layout: text where the duration is), 6 and 7 fields, and bad times."""
    k = F.col("event_id") % 4
    stamp = F.when(F.col("event_id") % 31 == 5, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    state = F.when(F.col("event_type") == "signup", "START").otherwise("STOP")
    head = F.concat_ws(",", stamp, "node", F.concat(F.lit("F"), F.col("user_id") % 5), state, F.lit("HIGH"))
    value = F.col("value").cast("string")
    tail = (F.when(k == 0, "60,m,too wide").when(k == 1, "old=1").when(k == 2, value)
            .otherwise(F.concat(value, F.lit(",m="), F.col("user_id"))))
    lines = (events(spark, sf).where(F.col("event_type").isin("signup", "purchase"))
             .select(F.col("series_id").cast("string").alias("file"), F.col("event_id").alias("line_no"), F.concat_ws(",", head, tail).alias("line")))
    return files.events_from_lines(lines)
