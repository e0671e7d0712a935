"""Files in and out, and the live job, over the given tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.bindings.base import (EV, FE, GRID, HOUR, IV, KEYS, LAB, LABELLED, LOGGED, METRICS, SC, TH, WM, events, grid, intervals, labelled,
                                     log_lines, metrics, query, scores, table, thresholds, with_)
from faultlens.bindings.features import HS, SENTINEL, hourly_scores
from faultlens.bindings.grids import SAMPLES, samples
from faultlens.operators import evaluate as ev
from faultlens.operators.grid import asof_fill, pivot_metrics
from faultlens.operators.intervals import label
from faultlens.operators.ordered import CHUNK_ROWS, number_chunk, time_chunk, with_position
from faultlens.operators.sequence import sliding_windows
from faultlens.plans.bundle import load_or_fit_bundle, score_raw_windows
from faultlens.sources import files
from faultlens.session import new_folder, stage
from faultlens.streaming import live

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])
KINDS = ["click", "error", "purchase", "signup", "view"]


@query("a1_read_metrics", with_(EV) + "SELECT series_id, slot AS ts, round(value, 6) AS val, event_id FROM ev")
def _(spark, sf):
    """Metric CSV written from the events, then read with schema, parsing and flooring."""
    path = new_folder(spark, "metrics")
    e = events(spark, sf)
    e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "series_id", "event_id",
             F.col("value").alias("val")).write.option("header", True).csv(path)
    return files.read_metrics(spark, path, ["val"], HOUR, extra="series_id bigint, event_id bigint")


@query("a3_read_node_logs", with_(*LOGGED) + """SELECT node, date_trunc('hour', ts) AS ts, count(*) AS n, CAST(sum(is_error) AS BIGINT) AS errors, CAST(sum(msg_len) AS BIGINT) AS chars FROM logs GROUP BY ALL""")
def _(spark, sf):
    """Log files ``…<node>_raw.log`` written from the events (several per node), then read by the operator."""
    path = new_folder(spark, "logs")
    log_lines(spark, sf).select("line", "hint").write.partitionBy("hint").text(path)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(at(path)):
        name = folder.getPath().getName()
        if name.startswith("hint="):
            for nth, part in enumerate(fs.listStatus(folder.getPath())):
                fs.rename(part.getPath(), at(f"{path}/{nth:05d}-{name[5:]}_raw.log"))
    parsed = files.read_node_logs(spark, path)
    return parsed.groupBy("node", F.date_trunc("hour", "ts").alias("ts")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_error").alias("errors"), F.sum("msg_len").alias("chars"))


@query("a6_scores_roundtrip", with_(SC) + "SELECT model, fault_type, y, count(*) AS n, round(sum(score), 2) AS total FROM sc GROUP BY ALL")
def _(spark, sf):
    path = new_folder(spark, "scores")
    rows = scores(spark, sf).select(F.lit("s").alias("series_id"), F.col("l_orderkey").alias("win_id"), F.col("l_shipdate").alias("ts"),
                                    "y", "fault_type", "model", "score")
    files.write_scores(rows, path)
    back = files.read_scores(spark, path)
    return back.groupBy("model", "fault_type", "y").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 2).alias("total"))


@query("a7_write_datasets", with_(EV, "d AS (SELECT CAST(ts AS DATE) AS date, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS ground_truth, value FROM ev)") +
       """SELECT 'mixed' AS part, date, count(*) AS n, round(sum(value), 4) AS total FROM d GROUP BY ALL
UNION ALL SELECT 'train', date, count(*), round(sum(value), 4) FROM d WHERE ground_truth = 0 GROUP BY ALL""")
def _(spark, sf):
    path = new_folder(spark, "datasets")
    rows = events(spark, sf).select("series_id", "ts", "value", (F.col("event_type") == "error").cast("int").alias("ground_truth"), F.lit("X").alias("fault_type"))
    files.write_datasets(rows, path, rows.where("ground_truth = 0"))
    parts = [spark.read.parquet(f"{path}/{p}").groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
             .select(F.lit(p).alias("part"), "date", "n", "total") for p in ("mixed", "train")]
    return parts[0].unionByName(parts[1])


@query("a7_write_harvest", with_(EV, GRID, FE, IV, LAB, WM) + "SELECT lab.series_id, lab.ts, " +
       ", ".join(f"round(COALESCE({c}, 0), 6) AS {c}" for c in METRICS) +
       ", ground_truth FROM lab JOIN wm ON wm.series_id = lab.series_id AND wm.ts = lab.ts WHERE " + " OR ".join(f"{c} IS NOT NULL" for c in METRICS))
def _(spark, sf):
    """Harvest table of metrics and labels written as CSV in order of time, then read back."""
    path = new_folder(spark, "harvest")
    rows = metrics(spark, sf).join(labelled(spark, sf).select("series_id", "ts", "ground_truth"), ["series_id", "ts"])
    files.write_harvest_table(rows, path, METRICS)
    back = files.read_metrics(spark, path, [*METRICS, "ground_truth"], HOUR, extra="series_id bigint")
    return back.withColumn("ground_truth", F.col("ground_truth").cast("int")).select("series_id", "ts", *METRICS, "ground_truth")


@query("a7_write_log_archive", with_(*LOGGED) + """SELECT node, ts, message, CAST(is_error AS INTEGER) AS is_error, CAST(msg_len AS INTEGER) AS msg_len FROM logs""")
def _(spark, sf):
    """All log lines written as an archive in sections, then read back by the archive reader."""
    path = new_folder(spark, "archive")
    files.write_log_archive(log_lines(spark, sf), path, ["event_id"], number_chunk("event_id", 4096), node="hint", section_rows=5_000)
    return files.read_log_archive(spark, path).select("node", "ts", "message", "is_error", "msg_len")


@query("a8_thresholds_roundtrip", with_(SC, TH) + """SELECT model, round(threshold, 6) AS threshold, round(avg(score), 6) AS mean_val, round(quantile_cont(score, 0.95::DOUBLE), 6) AS p95, round(quantile_cont(score, 0.99::DOUBLE), 6) AS p99
FROM sc JOIN th USING (model) WHERE y = 0 GROUP BY model, threshold""")
def _(spark, sf):
    path = new_folder(spark, "thresholds")
    files.write_thresholds(ev.score_stats(scores(spark, sf).where("y = 0"), thresholds(spark, sf)), path)
    return files.read_thresholds(spark, path)


def _as_samples(raw):
    return raw.select(F.floor(F.col("user_id") / F.lit(3)).alias("series_id"), F.col("event_type").alias("metric"),
                      F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("val"))


def sample_stream(spark, sf):
    """The events file as a stream of samples."""
    return _as_samples(live.stream_samples(spark, sf, EVENT_SCHEMA, glob="events.parquet"))


def in_parts(spark, sf, stream_of, late=False):
    """Run a stream over the events in two micro-batches of time, with ``late`` a third of two rows, and a closing mark.

    The late rows repeat the very last event 100 seconds earlier, inside the lateness, and three hours earlier, beyond it.
    """
    live.use_rocksdb(spark)
    folder, out, ckpt = (new_folder(spark, n) for n in ("arriving", "out", "ckpt"))
    rows = table(spark, sf, "events")
    last = rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(1)
    end = last.first()["ts"]
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    parts = [rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut)]
    if late:
        shift = F.explode(F.array(F.struct(F.expr("interval 100 seconds").alias("by"), F.lit(5000.0).alias("value")),
                                  F.struct(F.expr("interval 3 hours").alias("by"), F.lit(7000.0).alias("value"))))
        parts.append(last.withColumn("_s", shift).withColumn("ts", (F.col("ts") - F.col("_s.by")).cast("timestamp_ntz")).withColumn(
            "value", F.col("_s.value")).select(rows.columns))
    for part in parts:
        part.write.mode("append").parquet(folder)
        live.run_to_table(stream_of(_as_samples(live.stream_samples(spark, folder, EVENT_SCHEMA))), out, ckpt)
    live.write_closing_mark(spark, folder, EVENT_SCHEMA, end, HOUR)
    return live.run_to_table(stream_of(_as_samples(live.stream_samples(spark, folder, EVENT_SCHEMA))), out, ckpt)


@query("a9_stream_samples", with_(EV) + "SELECT series_id, event_type AS metric, ts, value AS val FROM ev")
def _(spark, sf):
    return live.run_to_table(sample_stream(spark, sf), new_folder(spark, "out"), new_folder(spark, "ckpt"))


@query("i1_stream_grid", with_(EV) + "SELECT series_id, slot AS ts, " + ", ".join(f"max(value) FILTER (event_type = '{k}') AS {k}" for k in KINDS) +
       " FROM ev GROUP BY ALL")
def _(spark, sf):
    """All steps, the last ones after a closing mark."""
    return in_parts(spark, sf, lambda s: live.stream_grid(s, KINDS, HOUR))


@query("i5_late_data", with_(EV, "al AS (SELECT series_id, slot, event_type, value FROM ev UNION ALL SELECT series_id, date_trunc('hour', ts - INTERVAL 100 SECOND), event_type, 5000.0 FROM (SELECT * FROM ev ORDER BY ts DESC, event_id DESC LIMIT 1))") +
       "SELECT series_id, slot AS ts, " + ", ".join(f"max(value) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + " FROM al GROUP BY ALL")
def _(spark, sf):
    """A late row inside the lateness counts, one beyond it is dropped."""
    return in_parts(spark, sf, lambda s: live.stream_grid(s, KINDS, HOUR), late=True)


_RUN = "WITH RECURSIVE " + ",\n".join((EV, GRID, HS, SENTINEL.format(thr="0.25"))) + """
SELECT sx.series_id, sx.ts, sx.tick, round(sx.score, 6) AS score, round(smoothed, 6) AS smoothed, round(off, 6) AS "offset", round(corrected, 6) AS corrected, active AS anomaly
FROM sx JOIN run USING (series_id, tick) JOIN so USING (series_id) WHERE tick >= 5"""


@query("i3_stream_sentinel", _RUN)
def _(spark, sf):
    """The same scores as the batch replay, as a stream."""
    live.use_rocksdb(spark)
    path = new_folder(spark, "scores")
    hourly_scores(spark, sf).write.parquet(path)
    stream = spark.readStream.schema("series_id bigint, ts timestamp, score double").parquet(path)
    return live.run_to_table(live.stream_sentinel(stream, 0.25), new_folder(spark, "out"), new_folder(spark, "ckpt"))


# ---- the live job from a stored bundle ----------------------------------------------------------------

#: Columns of the live job, and the inputs of each node: levels by place, changes five places on.
LIVE_NAMES = ["app_cpu", "db_log_error", "db_latency", "redis_mem", "redis_cpu"]
LIVE_NODES = [[0, 5], [1, 2, 6, 7], [3, 4, 8, 9]]


def live_rows(spark, sf):
    """The dense grid of the live columns with forward fill, the labels and positions: what the live job sees, in batch."""
    chunk = time_chunk("ts", CHUNK_ROWS * HOUR)
    filled = asof_fill(pivot_metrics(samples(spark, sf), KINDS), grid(spark, sf), KEYS, chunk=chunk, cols=KINDS)
    rows = label(filled, intervals(spark, sf), step=HOUR).select("series_id", "ts", "ground_truth", "fault_type", *KINDS)
    return stage(with_position(rows, KEYS, ["ts"], chunk))


def stored_bundle(spark, rows):
    """Fit, publish, load."""
    return load_or_fit_bundle(rows, new_folder(spark, "bundle"), KINDS, LIVE_NODES, step=HOUR, pos="pos")


def live_ticks(spark, bundle):
    """From samples to ticks: grid, windows, score and alarm state, with the numbers of a bundle."""
    return lambda s: live.stream_windows(live.stream_grid(s, KINDS, HOUR), bundle.cols, bundle.errors, bundle.nodes, bundle.threshold, step=HOUR)


_CLIP = lambda x: f"greatest(least({x}, 6.0), -6.0)"
BUNDLE = (*LABELLED, SAMPLES, f"lv AS MATERIALIZED (SELECT g.series_id, g.ts, g.pos, g.ground_truth, k.k, COALESCE(last_value(sm.val IGNORE NULLS) OVER (PARTITION BY g.series_id, k.k ORDER BY g.ts), 0.0) AS v"
          f" FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos FROM lab) g CROSS JOIN (SELECT unnest(range(5)) AS k, unnest({KINDS}) AS kind) k"
          " LEFT JOIN sm ON sm.series_id = g.series_id AND sm.ts = g.ts AND sm.metric = k.kind)",
          "b1 AS (SELECT k, avg(v) AS m, stddev_pop(v) AS s FROM lv WHERE ground_truth = 0 GROUP BY k)",
          f"lz AS MATERIALIZED (SELECT lv.*, {_CLIP('(v - m) / s')} AS z FROM lv JOIN b1 USING (k))",
          "ld AS MATERIALIZED (SELECT *, z - COALESCE(lag(z) OVER (PARTITION BY series_id, k ORDER BY pos), z) AS d FROM lz)",
          "b2 AS (SELECT k, avg(z) AS mz, stddev_pop(z) AS sz, avg(d) AS md, stddev_pop(d) AS sd FROM ld WHERE ground_truth = 0 GROUP BY k)",
          f"lx AS MATERIALIZED (SELECT ld.*, {_CLIP('(z - mz) / sz')} AS xz, {_CLIP('(d - md) / sd')} AS xd, {_CLIP('(0 - md) / sd')} AS x0 FROM ld JOIN b2 USING (k))",
          "b3 AS (SELECT k, avg(xz) AS uz, avg(xd) AS ud FROM lx WHERE ground_truth = 0 GROUP BY k)",
          """le AS MATERIALIZED (SELECT series_id, ts, pos, k, avg(power(xz - uz, 2)) OVER w10 AS ez, (sum(power(xd - ud, 2)) OVER w9 + power(x0 - ud, 2)) / 10 AS ed, max(ground_truth) OVER w10 AS y
   FROM lx JOIN b3 USING (k) WINDOW w10 AS (PARTITION BY series_id, k ORDER BY pos ROWS 9 PRECEDING), w9 AS (PARTITION BY series_id, k ORDER BY pos ROWS 8 PRECEDING))""",
          """ls AS MATERIALIZED (SELECT series_id, ts, pos - 9 AS win_id, y, 0.7 * greatest(a, b, c) + 0.3 * (a + b + c) / 3 AS score, errs FROM (SELECT series_id, ts, pos, max(y) AS y,
   avg((ez + ed) / 2) FILTER (k = 0) AS a, avg((ez + ed) / 2) FILTER (k IN (1, 2)) AS b, avg((ez + ed) / 2) FILTER (k IN (3, 4)) AS c, list_concat(list(ez ORDER BY k), list(ed ORDER BY k)) AS errs
   FROM le WHERE pos >= 9 GROUP BY series_id, ts, pos))""",
          "bt AS MATERIALIZED (SELECT quantile_cont(score, 0.85) AS threshold FROM ls WHERE y = 0)")
_TICKS = "WITH RECURSIVE " + ",\n".join((*BUNDLE, "hs AS MATERIALIZED (SELECT series_id, ts, score FROM ls)", SENTINEL.format(thr="(SELECT threshold FROM bt)"),
          """tk AS (SELECT sx.series_id, sx.ts, sx.tick, sx.score, smoothed, off, corrected, active FROM sx JOIN run USING (series_id, tick) JOIN so USING (series_id) WHERE tick >= 5)""")) + "\n"


@query("j9_load_or_fit", with_(*BUNDLE) + "SELECT series_id, win_id, ts, y, round(score, 6) AS score, round(threshold, 6) AS threshold FROM ls, bt")
def _(spark, sf):
    """Scores of the batch windows by a bundle that was fitted, published and loaded again; its threshold."""
    rows = live_rows(spark, sf)
    bundle = stored_bundle(spark, rows)
    windows = sliding_windows(rows, KINDS, pos="pos", fault=None)
    scored = score_raw_windows(windows, bundle, keep=["series_id", "win_id", "ts", "y", "score"])
    return scored.withColumn("threshold", F.lit(bundle.threshold))


@query("i2_stream_windows", _TICKS + """SELECT series_id, ts, tick, round(score, 6) AS score, round(smoothed, 6) AS smoothed, round(off, 6) AS "offset", round(corrected, 6) AS corrected, active AS anomaly FROM tk""")
def _(spark, sf):
    """Ticks of the live job from the stored bundle: the same scores as the batch windows, the same alarms as the replay."""
    return in_parts(spark, sf, live_ticks(spark, stored_bundle(spark, live_rows(spark, sf)))).drop("err")


def reported(spark, sf):
    """Report lines of the live job, read back from the sink: two micro-batches of samples and a closing mark."""
    live.use_rocksdb(spark)
    bundle = stored_bundle(spark, live_rows(spark, sf))
    path, ckpt = new_folder(spark, "reports"), new_folder(spark, "ckpt")
    names = [*LIVE_NAMES, *[f"{n}_delta" for n in LIVE_NAMES]]

    def run_part(samples_):
        live.write_reports(live_ticks(spark, bundle)(samples_), names, bundle.threshold, path, ckpt, available_now=True, compression="gzip").awaitTermination()
    in_sink(spark, sf, run_part)
    return spark.read.schema("series_id bigint, ts timestamp, anomaly boolean, line string").json(path)


def in_sink(spark, sf, run_part):
    folder = new_folder(spark, "arriving")
    rows = table(spark, sf, "events")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    for part in (rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut), None):
        if part is None:
            live.write_closing_mark(spark, folder, EVENT_SCHEMA, rows.agg(F.max("ts")).first()[0], HOUR)
        else:
            part.write.mode("append").parquet(folder)
        run_part(_as_samples(live.stream_samples(spark, folder, EVENT_SCHEMA)))


# Names by place among the ten inputs, as reports show them.
_CAUSE_NODE = "['Nextcloud', 'MySQL', 'MySQL', 'Redis', 'Redis', 'Nextcloud', 'MySQL', 'MySQL', 'Redis', 'Redis']"
_CAUSE_FEATURE = "['CPUUtil', 'ErrorRate', 'Latency', 'MemUtil', 'CPUUtil', 'CPUUtil (Velocity)', 'ErrorRate (Velocity)', 'Latency (Velocity)', 'MemUtil (Velocity)', 'CPUUtil (Velocity)']"


@query("i4_stream_reports", _TICKS + f"""SELECT series_id, tk.ts, active AS anomaly, CASE WHEN active THEN CASE WHEN corrected < threshold THEN 'NORMAL' WHEN corrected < 1.5 * threshold THEN 'LOW' WHEN corrected < 2 * threshold THEN 'MEDIUM' ELSE 'HIGH' END END AS severity,
  CASE WHEN active THEN round(corrected, 6) END AS overall_score, CASE WHEN active THEN {_CAUSE_NODE}[top] END AS node, CASE WHEN active THEN {_CAUSE_FEATURE}[top] END AS feature,
  CASE WHEN active THEN CAST(trunc(errs[top] / list_sum(errs) * 100) AS INTEGER) END AS impact, CASE WHEN NOT active THEN strftime(tk.ts, '[%H:%M:%S]') END AS health_at
FROM (SELECT tk.*, errs, list_max(list_transform(range(1, 11), lambda i: {{'e': errs[i], 'i': i}})).i AS top FROM tk JOIN ls USING (series_id, ts)) tk, bt""")
def _(spark, sf):
    """What the report lines say: severity, score and primary cause while anomalous, else the time of the health line."""
    body = F.from_json("line", "severity string, overall_score double, primary_cause struct<node: string, feature: string, impact: int>")
    lines = reported(spark, sf).withColumn("b", F.when(F.col("anomaly"), body))
    return lines.select("series_id", "ts", "anomaly", "b.severity", "b.overall_score", "b.primary_cause.node",
                        "b.primary_cause.feature", "b.primary_cause.impact", F.when(~F.col("anomaly"), F.substring("line", 1, 10)).alias("health_at"))


@query("a10_write_reports", _TICKS + "SELECT series_id, active AS anomaly, count(*) AS n, count(*) FILTER (active) AS json_lines FROM tk GROUP BY ALL")
def _(spark, sf):
    """Reports and health lines per series, from the sink's files."""
    return reported(spark, sf).groupBy("series_id", "anomaly").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("line").startswith("{")).alias("json_lines"))
