"""Scaling, change, windows, smoothing, alarm replay."""

from pyspark.sql import functions as F

from faultlens.bindings.base import (EV, FEATURES, FUSE, GRID, HOUR, LABELLED, METRICS, WM, clip_sql, events, fused, grid,
                                     labelled, metrics, query, with_)
from faultlens.operators import grid as g
from faultlens.operators import scaling, sequence as seq
from faultlens.operators.clean import fill_partial
from faultlens.operators.profiling import (class_means, discriminative_power, profile, sort_by_metric, stability,
                                           variance_report)
from faultlens.session import stage

DELTAS = [c + "_delta" for c in FEATURES]
INPUTS = [*FEATURES, *DELTAS]
_EPS = "2.220446049250313e-16"


def _scale_sql(c: str) -> str:
    v = f"var_pop({c})"
    return (f"CASE WHEN {v} <= count(*) * {_EPS} * {v} + power(count(*) * avg({c}) * {_EPS}, 2) "
            f"THEN 1.0 ELSE stddev_pop({c}) END")


def _fit_sql(name: str, src: str, cols) -> str:
    parts = ", ".join(f"avg({c}) AS m_{c}, CAST({_scale_sql(c)} AS DOUBLE) AS s_{c}" for c in cols)
    return f"{name} AS (SELECT {parts} FROM {src} WHERE ground_truth = 0)"


CLEAN = "cl AS MATERIALIZED (SELECT series_id, ts, " + ", ".join(f"COALESCE({c}, 0.0) AS {c}" for c in FEATURES) + ", ground_truth, fault_type FROM fused)"
FIT1 = _fit_sql("fit1", "cl", FEATURES)
Z1 = "z1 AS MATERIALIZED (SELECT series_id, ts, " + ", ".join(clip_sql(f"({c} - m_{c}) / s_{c}") + f" AS {c}" for c in FEATURES) + ", ground_truth, fault_type FROM cl, fit1)"
DZ = "dz AS MATERIALIZED (SELECT *, " + ", ".join(f"{c} - COALESCE(lag({c}) OVER w, {c}) AS {c}_delta" for c in FEATURES) + " FROM z1 WINDOW w AS (PARTITION BY series_id ORDER BY ts))"
FIT2 = _fit_sql("fit2", "dz", INPUTS)
X = "x AS MATERIALIZED (SELECT series_id, ts, " + ", ".join(clip_sql(f"({c} - m_{c}) / s_{c}") + f" AS {c}" for c in INPUTS) + ", ground_truth, fault_type FROM dz, fit2)"
SCALED = (*FUSE, CLEAN, FIT1, Z1, DZ, FIT2, X)


def features(spark, sf):
    """Scaled inputs. The fused table is written once: both fits and the change read it."""
    return scaling.double_scale(stage(fused(spark, sf)), FEATURES, step=HOUR)[0]


@query("d6_fit_scaler", with_(*FUSE, CLEAN, FIT1) + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(m_{c}, 6) AS mean, round(s_{c}, 6) AS scale FROM fit1" for c in FEATURES))
def _(spark, sf):
    from faultlens.operators.clean import finite_guard
    return scaling.fit_scaler(finite_guard(fused(spark, sf), FEATURES), FEATURES, F.col("ground_truth") == 0)


@query("e1_delta", with_(EV, GRID, WM) + "SELECT series_id, ts, " + ", ".join(
    f"round(COALESCE({c}, 0) - COALESCE(lag(COALESCE({c}, 0)) OVER w, COALESCE({c}, 0)), 6) AS {c}_delta" for c in METRICS) +
       " FROM grid LEFT JOIN wm USING (series_id, ts) WINDOW w AS (PARTITION BY series_id ORDER BY ts)")
def _(spark, sf):
    rows = fill_partial(g.reindex_grid(metrics(spark, sf), grid(spark, sf)), METRICS)
    return seq.delta(rows, METRICS, step=HOUR).drop(*METRICS)


@query("e1_delta_window", with_(EV, GRID, WM, "ps AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos FROM grid LEFT JOIN wm USING (series_id, ts))") +
       "SELECT w.series_id, w.pos - 9 AS win_id, w.ts, CAST(n.pos - w.pos + 9 AS INTEGER) AS step, " + ", ".join(
           f"CASE WHEN n.pos = w.pos - 9 THEN 0.0 ELSE round(COALESCE(n.{c}, 0) - COALESCE(p.{c}, 0), 6) END AS {c}_delta" for c in METRICS) +
       """ FROM ps w JOIN ps n ON n.series_id = w.series_id AND n.pos BETWEEN w.pos - 9 AND w.pos LEFT JOIN ps p ON p.series_id = n.series_id AND p.pos = n.pos - 1
WHERE w.pos >= 9""")
def _(spark, sf):
    """Changes inside each window, as the live job sees them: every first row of a window has none."""
    rows = fill_partial(g.reindex_grid(metrics(spark, sf), grid(spark, sf)), METRICS)
    steps = seq.delta(rows, METRICS, scope="window").select("series_id", "win_id", "ts", F.posexplode("delta").alias("step", "d"))
    return steps.select("series_id", "win_id", "ts", "step", *[F.col("d")[i].alias(f"{c}_delta") for i, c in enumerate(METRICS)])


@query("g10_double_scale", with_(*SCALED) + "SELECT series_id, ts, " + ", ".join(f"round({c}, 6) AS {c}" for c in INPUTS) + ", ground_truth, fault_type FROM x")
def _(spark, sf):
    return features(spark, sf).select("series_id", "ts", *INPUTS, "ground_truth", "fault_type")


_W = "WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
_POS = "ps AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos FROM lab LEFT JOIN wm USING (series_id, ts))"


@query("e2_sliding_windows", with_(*LABELLED, WM, _POS, f"""wl AS (SELECT series_id, ts, pos, max(ground_truth) OVER w AS y,
    COALESCE(first_value(CASE WHEN fault_type <> 'HEALTHY' THEN fault_type END IGNORE NULLS) OVER w, 'HEALTHY') AS fault_type FROM ps {_W})""") + """SELECT wl.series_id, wl.pos - 9 AS win_id, wl.ts,
  CAST(ps.pos - wl.pos + 9 AS INTEGER) AS step, """ + ", ".join(f"round(COALESCE(ps.{c}, 0), 6) AS {c}" for c in METRICS) + """, y, wl.fault_type
  FROM wl JOIN ps ON ps.series_id = wl.series_id AND ps.pos BETWEEN wl.pos - 9 AND wl.pos WHERE wl.pos >= 9""")
def _(spark, sf):
    """Every step of every window, with all metric columns."""
    rows = fill_partial(labelled(spark, sf).join(metrics(spark, sf), ["series_id", "ts"], "left"), METRICS)
    steps = seq.sliding_windows(rows, METRICS).select("series_id", "win_id", "ts", F.posexplode("win").alias("step", "v"), "y", "fault_type")
    return steps.select("series_id", "win_id", "ts", "step", *[F.col("v")[i].alias(c) for i, c in enumerate(METRICS)], "y", "fault_type")


@query("e3_window_label", with_(*LABELLED, WM, _POS) + f"""SELECT series_id, pos - 9 AS win_id, ts, y, fault_type FROM (SELECT series_id, ts, pos, max(ground_truth) OVER w AS y,
    COALESCE(first_value(CASE WHEN fault_type <> 'HEALTHY' THEN fault_type END IGNORE NULLS) OVER w, 'HEALTHY') AS fault_type FROM ps {_W}) WHERE pos >= 9""")
def _(spark, sf):
    return seq.window_label(labelled(spark, sf))


HS = """hs AS (SELECT series_id, ts, COALESCE(v, 0.0) / 100 AS score FROM grid LEFT JOIN (SELECT series_id, slot AS ts, sum(value) AS v FROM ev GROUP BY ALL) USING (series_id, ts))"""


def hourly_scores(spark, sf):
    e = events(spark, sf).groupBy("series_id", F.col("slot").alias("ts")).agg(F.sum("value").alias("v"))
    return grid(spark, sf).join(e, ["series_id", "ts"], "left").select("series_id", "ts", (F.coalesce("v", F.lit(0.0)) / 100).alias("score"))


@query("e8_moving_average", with_(EV, GRID, HS) + """SELECT series_id, ts, round(avg(score) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM hs""")
def _(spark, sf):
    return seq.moving_average(hourly_scores(spark, sf)).select("series_id", "ts", "smoothed")


SENTINEL = """sx AS (SELECT series_id, ts, score, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS tick,
    avg(score) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS smoothed FROM hs),
so AS (SELECT series_id, greatest(0.0, max(smoothed)) AS off FROM sx WHERE tick < 5 GROUP BY series_id),
run AS (SELECT series_id, CAST(4 AS BIGINT) AS tick, false AS active, 0.0::DOUBLE AS corrected FROM so
  UNION ALL SELECT n.series_id, n.tick, greatest(0.0, CASE WHEN r.active THEN n.score ELSE n.smoothed END - so.off) >= {thr},
    greatest(0.0, CASE WHEN r.active THEN n.score ELSE n.smoothed END - so.off)
  FROM run r JOIN sx n ON n.series_id = r.series_id AND n.tick = r.tick + 1 JOIN so ON so.series_id = n.series_id)"""
_RUN = "WITH RECURSIVE " + ",\n".join((EV, GRID, HS, SENTINEL.format(thr="0.25"))) + """
SELECT sx.series_id, sx.ts, sx.tick, round(sx.score, 6) AS score, round(smoothed, 6) AS smoothed, round(off, 6) AS "offset", round(corrected, 6) AS corrected, active AS anomaly
FROM sx JOIN run USING (series_id, tick) JOIN so USING (series_id) WHERE tick >= 5"""


@query("e9_sentinel_batch", _RUN)
def _(spark, sf):
    return seq.sentinel_batch(hourly_scores(spark, sf), 0.25)


@query("f3_tail", with_(EV) + """SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM ev)
WHERE r <= 10 AND n >= 10""")
def _(spark, sf):
    return seq.tail(events(spark, sf).select("user_id", "event_id", "ts"), 10, ["user_id"], ["ts", "event_id"])


# ---- reports over the fused table -------------------------------------------------------------------

_CM = "cm AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c}) FILTER (ground_truth = 0) AS h_mean, avg({c}) FILTER (ground_truth = 1) AS a_mean FROM fused" for c in FEATURES) + ")"


@query("d7_class_means", with_(*FUSE, _CM) + "SELECT feature, round(h_mean, 6) AS h_mean, round(a_mean, 6) AS a_mean, round(a_mean - h_mean, 6) AS diff FROM cm")
def _(spark, sf):
    return class_means(fused(spark, sf), FEATURES)


@query("d8_discriminative_power", with_(*FUSE, _CM, "pw AS (SELECT feature, abs(a_mean - h_mean) AS power FROM cm)") + """SELECT * FROM (SELECT 'top' AS side, feature, round(power, 6) AS power FROM pw ORDER BY pw.power DESC, feature LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'bottom' AS side, feature, round(power, 6) AS power FROM pw ORDER BY pw.power ASC, feature DESC LIMIT 5)""")
def _(spark, sf):
    return discriminative_power(fused(spark, sf), FEATURES)


@query("d9_profile", with_(*FUSE) + f"""SELECT 'table' AS section, 'rows' AS key, count(*) AS value FROM fused
UNION ALL SELECT 'table', 'columns', {len(FEATURES) + 4}
UNION ALL SELECT 'ground_truth', CAST(ground_truth AS VARCHAR), count(*) FROM fused GROUP BY ground_truth
UNION ALL SELECT 'fault_type', fault_type, count(*) FROM fused GROUP BY fault_type
UNION ALL SELECT 'node', n, 7 FROM (SELECT unnest(['app', 'db', 'redis']) AS n)
UNION ALL SELECT 'metadata', c, 1 FROM (SELECT unnest(['series_id', 'ts', 'ground_truth', 'fault_type']) AS c)""")
def _(spark, sf):
    return profile(fused(spark, sf))


_LOGF = [c for c in FEATURES if "_log_" in c]
_METF = [c for c in FEATURES if "_log_" not in c]


@query("d10_variance_report", with_(*FUSE) + f"""SELECT count(*) AS n_rows, CAST({len(_METF)} AS BIGINT) AS metric_cols,
  CAST({' + '.join(f'CASE WHEN stddev_samp({c}) > 0 THEN 1 ELSE 0 END' for c in _METF)} AS BIGINT) AS metric_active, CAST({len(_LOGF)} AS BIGINT) AS log_cols,
  CAST({' + '.join(f'CASE WHEN stddev_samp({c}) > 0 THEN 1 ELSE 0 END' for c in _LOGF)} AS BIGINT) AS log_active, round(avg(ground_truth), 6) AS anomaly_ratio,
  string_agg(DISTINCT fault_type, ',' ORDER BY fault_type) FILTER (fault_type <> 'HEALTHY') AS fault_types FROM fused""")
def _(spark, sf):
    return variance_report(fused(spark, sf), FEATURES)


_DB, _DBD = FEATURES[7:14], DELTAS[7:14]


def _abs(cols):
    return "(" + " + ".join(f"abs({c})" for c in cols) + f") / {len(cols)}"


@query("d30_stability", with_(*SCALED) + f"""SELECT series_id, round(a, 6) AS mean_abs_z, round(b, 6) AS mean_abs_delta, CASE WHEN a < 1 AND b < 1 THEN 'STABLE' ELSE 'DRIFT' END AS verdict FROM
  (SELECT series_id, {_abs(_DB)} AS a, {_abs(_DBD)} AS b, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS r FROM x) WHERE r = 1""")
def _(spark, sf):
    return stability(features(spark, sf), _DB, _DBD)


@query("f4_sort_by_metric", "SELECT l_partkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_partkey ORDER BY round(sum(l_extendedprice), 2) DESC, l_partkey LIMIT 20")
def _(spark, sf):
    from faultlens.bindings.base import table
    rows = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return sort_by_metric(rows.withColumn("k", F.struct("total", -F.col("l_partkey"))), "k", n=20).drop("k")
