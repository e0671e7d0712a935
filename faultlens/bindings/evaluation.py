"""Percentiles, curves, thresholds, measures, time to detect."""

from pyspark.sql import functions as F

from faultlens.bindings.base import SC, SCORE_ORDER, TH, query, score_chunk, scores, thresholds, with_
from faultlens.operators import curves, evaluate as ev
from faultlens.operators.ordered import with_position

SWEEP = ev.SWEEP
_PS = "(SELECT unnest([" + ", ".join(str(p) for p in SWEEP) + "]) AS percentile, unnest(range(" + str(len(SWEEP)) + ")) AS rank) p"


@query("d12_healthy_percentiles", with_(SC) + "SELECT model, CAST(percentile AS DOUBLE) AS percentile, CAST(rank AS INTEGER) AS rank, round(threshold, 6) AS threshold FROM (" + " UNION ALL ".join(
    f"SELECT model, {p} AS percentile, {i} AS rank, quantile_cont(score, CAST({p / 100} AS DOUBLE)) AS threshold FROM sc WHERE y = 0 GROUP BY model" for i, p in enumerate(SWEEP)) + ")")
def _(spark, sf):
    return curves.healthy_percentiles(scores(spark, sf), SWEEP)


def _measures_sql(tp="tp", fp="fp", tn="tn", fn="fn") -> str:
    def div(a, b):
        return f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"
    return (f"round({div(f'({tp} + {tn})', f'{tp} + {fp} + {tn} + {fn}')}, 6) AS accuracy, round({div(tp, f'{tp} + {fp}')}, 6) AS prec, "
            f"round({div(tp, f'{tp} + {fn}')}, 6) AS rec, round({div(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')}, 6) AS f1, round({div(fp, f'{fp} + {tn}')}, 6) AS fpr")


_COUNTS = ("count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp, "
           "count(*) FILTER (score < threshold AND y = 0) AS tn, count(*) FILTER (score < threshold AND y = 1) AS fn")
CF = f"cf AS (SELECT model, threshold, {_COUNTS} FROM sc JOIN th USING (model) GROUP BY ALL)"


@query("d13_confusion", with_(SC, TH, CF) + f"SELECT model, round(threshold, 6) AS threshold, tp, fp, tn, fn, {_measures_sql()} FROM cf")
def _(spark, sf):
    return ev.confusion(scores(spark, sf), thresholds(spark, sf))


def _cuts_sql(name, percents, where):
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT model, {i} AS rank, CAST({p} AS DOUBLE) AS percentile, quantile_cont(score, CAST({p / 100} AS DOUBLE)) AS threshold FROM sc WHERE {where} GROUP BY model"
        for i, p in enumerate(percents)) + ")"


_SW = _cuts_sql("ct", SWEEP, "y = 0")
_SWC = f"sw AS (SELECT model, rank, percentile, threshold, {_COUNTS} FROM sc JOIN ct USING (model) GROUP BY ALL)"


@query("d14_threshold_sweep", with_(SC, _SW, _SWC) + f"SELECT model, CAST(rank AS INTEGER) AS rank, percentile, round(threshold, 6) AS threshold, tp, fp, tn, fn, {_measures_sql()} FROM sw")
def _(spark, sf):
    return ev.threshold_sweep(scores(spark, sf))


_BEST = f"b AS (SELECT model, arg_max(s, [f1, -rank]) AS s FROM (SELECT model, rank, round(2.0 * tp / (2 * tp + fp + fn), 12) AS f1, {{'percentile': percentile, 'threshold': threshold, 'tp': tp, 'fp': fp, 'tn': tn, 'fn': fn}} AS s FROM sw) GROUP BY model)"


@query("d14_best_of_sweep", with_(SC, _SW, _SWC, _BEST) + "SELECT model, percentile, round(threshold, 6) AS threshold, prec, rec, f1, fpr FROM (SELECT model, s.percentile AS percentile, s.threshold AS threshold, "
       + _measures_sql("s.tp", "s.fp", "s.tn", "s.fn") + " FROM b)")
def _(spark, sf):
    return ev.best_of_sweep(ev.threshold_sweep(scores(spark, sf)))


_CAL = _cuts_sql("ct", ev.CALIBRATION, "y = 0 AND train")
_CALC = f"sw AS (SELECT model, rank, percentile, threshold, {_COUNTS} FROM (SELECT * FROM sc WHERE NOT train) JOIN ct USING (model) GROUP BY ALL)"
CALIBRATED = (SC, _CAL, _CALC, _BEST)


@query("d15_calibrate", with_(*CALIBRATED) + """SELECT model, CASE WHEN s.tp = 0 THEN 0.0 ELSE s.percentile END AS percentile, CASE WHEN s.tp = 0 THEN 0.0 ELSE round(s.threshold, 6) END AS threshold,
  round(2.0 * s.tp / (2 * s.tp + s.fp + s.fn), 6) AS f1 FROM b""")
def _(spark, sf):
    s = scores(spark, sf)
    return ev.calibrate(s.where("y = 0 AND train"), s.where("NOT train"))


@query("d15_calibrate_sketched")
def _(spark, sf):
    s = scores(spark, sf)
    parts = s.where("y = 0 AND train").withColumn("run", F.pmod(F.col("l_orderkey"), F.lit(30)))
    daily = curves.score_sketches(parts, ["model", "run"])
    return ev.calibrate_sketched(daily, s.where("NOT train"))


@query("d16_score_stats", with_(SC, TH) + """SELECT model, round(threshold, 6) AS threshold, round(avg(score), 6) AS mean_val, round(quantile_cont(score, 0.95::DOUBLE), 6) AS p95, round(quantile_cont(score, 0.99::DOUBLE), 6) AS p99
FROM sc JOIN th USING (model) WHERE y = 0 AND train GROUP BY model, threshold""")
def _(spark, sf):
    return ev.score_stats(scores(spark, sf).where("y = 0 AND train"), thresholds(spark, sf))


CV = """cv AS (SELECT model, threshold, CAST(sum(d_tp) OVER w AS BIGINT) AS tp, CAST(sum(d_fp) OVER w AS BIGINT) AS fp, d_tp, d_fp,
  CAST(sum(d_tp) OVER (PARTITION BY model) AS BIGINT) AS n_pos, CAST(sum(d_fp) OVER (PARTITION BY model) AS BIGINT) AS n_neg FROM
  (SELECT model, score AS threshold, CAST(sum(y) AS BIGINT) AS d_tp, CAST(sum(1 - y) AS BIGINT) AS d_fp FROM sc GROUP BY ALL) WINDOW w AS (PARTITION BY model ORDER BY threshold DESC))"""
PTS = """pts AS (SELECT *, tp / n_pos AS rec, fp / n_neg AS fpr, tp / (tp + fp) AS prec, lag(tp / n_pos, 1, 0.0) OVER w AS rec0, lag(fp / n_neg, 1, 0.0) OVER w AS fpr0,
  lag(tp / (tp + fp), 1, 1.0) OVER w AS prec0 FROM cv WINDOW w AS (PARTITION BY model ORDER BY threshold DESC))"""


@query("d17_curve_points", with_(SC, CV) + "SELECT model, threshold, tp, fp, d_tp, d_fp, n_pos, n_neg, round(tp / n_pos, 6) AS tpr, round(fp / n_neg, 6) AS fpr, round(tp / (tp + fp), 6) AS prec, round(tp / n_pos, 6) AS rec FROM cv "
       "UNION ALL SELECT model, NULL, 0, 0, 0, 0, count(*) FILTER (y = 1), count(*) FILTER (y = 0), 0.0, 0.0, 1.0, 0.0 FROM sc GROUP BY model")
def _(spark, sf):
    return curves.curve_points(scores(spark, sf), ends=True)


@query("d18_roc_auc", with_(SC, CV, PTS) + "SELECT model, round(sum((fpr - fpr0) * (rec + rec0) / 2), 6) AS roc_auc FROM pts GROUP BY model")
def _(spark, sf):
    return curves.roc_auc(scores(spark, sf))


@query("d19_average_precision", with_(SC, CV, PTS) + "SELECT model, round(sum((rec - rec0) * prec), 6) AS average_precision FROM pts GROUP BY model")
def _(spark, sf):
    return curves.average_precision(scores(spark, sf))


@query("d20_pr_auc_trapezoid", with_(SC, CV, PTS) + "SELECT model, round(sum((rec - rec0) * (prec + prec0) / 2), 6) AS pr_auc FROM pts GROUP BY model")
def _(spark, sf):
    return curves.pr_auc_trapezoid(scores(spark, sf))


@query("d21_best_f1_point", with_(SC, CV, PTS) + """SELECT model, threshold, round(prec, 6) AS prec, round(rec, 6) AS rec, round(f1, 6) AS f1 FROM
  (SELECT *, 2 * prec * rec / (prec + rec + 1e-9) AS f1, row_number() OVER (PARTITION BY model ORDER BY 2 * prec * rec / (prec + rec + 1e-9) DESC, threshold) AS r FROM pts) WHERE r = 1""")
def _(spark, sf):
    return curves.best_f1_point(scores(spark, sf))


_REP = """rp AS (SELECT model, unnest([{l: 'Healthy', p: tn / (tn + fn), r: tn / (tn + fp), f: 2 * tn / (2 * tn + fp + fn), n: tn + fp},
  {l: 'Anomalous', p: tp / (tp + fp), r: tp / (tp + fn), f: 2 * tp / (2 * tp + fp + fn), n: tp + fn}]) AS c, (tp + tn) / (tp + fp + tn + fn) AS acc, tp + fp + tn + fn AS total FROM cf)"""


@query("d22_classification_report", with_(SC, TH, CF, _REP) + """SELECT model, c.l AS label, round(c.p, 6) AS prec, round(c.r, 6) AS rec, round(c.f, 6) AS f1, c.n AS support FROM rp
UNION ALL SELECT DISTINCT model, 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), total FROM rp
UNION ALL SELECT model, 'macro avg', round(avg(c.p), 6), round(avg(c.r), 6), round(avg(c.f), 6), any_value(total) FROM rp GROUP BY model
UNION ALL SELECT model, 'weighted avg', round(sum(c.p * c.n) / any_value(total), 6), round(sum(c.r * c.n) / any_value(total), 6), round(sum(c.f * c.n) / any_value(total), 6), any_value(total) FROM rp GROUP BY model""")
def _(spark, sf):
    return ev.classification_report(scores(spark, sf), thresholds(spark, sf))


@query("d23_fault_breakdown", with_(SC, TH) + """SELECT model, fault_type, count(*) AS total_windows, count(*) FILTER (score >= threshold) AS detected, round(count(*) FILTER (score >= threshold) / count(*), 6) AS recall,
  round(sum(count(*) FILTER (score >= threshold)) OVER (PARTITION BY model) / sum(count(*)) OVER (PARTITION BY model), 6) AS overall_recall
FROM sc JOIN th USING (model) WHERE y = 1 GROUP BY model, fault_type""")
def _(spark, sf):
    return ev.fault_breakdown(scores(spark, sf), thresholds(spark, sf))


_ORD = ", ".join(SCORE_ORDER)
BLK = f"""bl AS (SELECT model, b, arg_min(fault_type, pos) AS fault_type, count(*) AS n_windows, min(pos) AS first_pos, (min(pos) FILTER (hit) - min(pos)) * 10.0::DOUBLE AS latency_s FROM
  (SELECT *, sum(c) OVER (PARTITION BY model ORDER BY pos) AS b FROM (SELECT *, CASE WHEN lag(y) OVER (PARTITION BY model ORDER BY pos) IS DISTINCT FROM y THEN 1 ELSE 0 END AS c FROM
    (SELECT sc.*, score >= threshold AS hit, row_number() OVER (PARTITION BY model ORDER BY {_ORD}) AS pos FROM sc JOIN th USING (model)))) WHERE y = 1 GROUP BY model, b)"""


def _blocks(spark, sf):
    return ev.detection_blocks(scores(spark, sf), thresholds(spark, sf), order=SCORE_ORDER, chunk=score_chunk())


@query("d24_detection_blocks", with_(SC, TH, BLK) + "SELECT model, fault_type, n_windows, first_pos, latency_s FROM bl")
def _(spark, sf):
    return _blocks(spark, sf)


@query("d24_time_to_detect", with_(SC, TH, BLK) + """SELECT model, count(*) AS n_events, count(latency_s) AS n_detected, round(count(latency_s) / count(*), 6) AS detected_share, round(avg(latency_s), 6) AS mean_ttd_s,
  round(quantile_cont(latency_s, 0.5), 6) AS median_ttd_s FROM bl GROUP BY model""")
def _(spark, sf):
    return ev.time_to_detect(scores(spark, sf), thresholds(spark, sf), order=SCORE_ORDER, chunk=score_chunk())


@query("d25_time_to_detect_by_fault", with_(SC, TH, BLK) + "SELECT model, fault_type, round(avg(latency_s), 6) AS mean_s, min(latency_s) AS min_s, max(latency_s) AS max_s, count(*) AS n FROM bl WHERE latency_s IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return ev.time_to_detect_by_fault(scores(spark, sf), thresholds(spark, sf), order=SCORE_ORDER, chunk=score_chunk())


def _hist_sql(src, keys, col, bins, density):
    k = ", ".join(keys)
    val = "round(COALESCE(n, 0) / (total * width), 9) AS density" if density else "COALESCE(n, 0) AS n"
    return f"""SELECT {", ".join(f"eb.{x}" for x in keys)}, eb.bin, round(lo + eb.bin * width, 6) AS left_edge, {val} FROM
  (SELECT *, unnest(range({bins})) AS bin FROM eg) eb LEFT JOIN (SELECT {k}, least(CAST(floor(({col} - lo) / width) AS BIGINT), {bins - 1}) AS bin, count(*) AS n
  FROM {src} JOIN eg USING ({k}) WHERE {col} IS NOT NULL GROUP BY ALL) c ON {" AND ".join(f"c.{x} = eb.{x}" for x in keys)} AND c.bin = eb.bin"""


def _edges(src, keys, col, bins):
    k = ", ".join(keys)
    return f"eg AS (SELECT {k}, min({col}) AS lo, (max({col}) - min({col})) / {bins} AS width, count({col}) AS total FROM {src} WHERE {col} IS NOT NULL GROUP BY {k})"


@query("d26_histogram", with_(SC, _edges("sc", ["model", "y"], "score", 50)) + "SELECT model, y, bin, left_edge, round(density * 1e6, 3) AS density_ppm FROM (" + _hist_sql("sc", ["model", "y"], "score", 50, True) + ")")
def _(spark, sf):
    h = ev.histogram(scores(spark, sf), "score", 50, density=True)
    return h.select("model", "y", "bin", "left_edge", F.round(F.round("density", 9) * 1e6, 3).alias("density_ppm"))


@query("d26_latency_histogram", with_(SC, TH, BLK, _edges("bl", ["model"], "latency_s", 15)) + _hist_sql("bl", ["model"], "latency_s", 15, False))
def _(spark, sf):
    return ev.histogram(_blocks(spark, sf), "latency_s", 15, keys=["model"])


@query("d27_prevalence", with_(SC) + "SELECT model, round(avg(y), 6) AS prevalence FROM sc GROUP BY model")
def _(spark, sf):
    return ev.prevalence(scores(spark, sf))


@query("d28_model_comparison", with_(SC, TH, CF, CV, PTS) + f"""SELECT cf.model, m.accuracy, m.prec, m.rec, m.f1, roc_auc, average_precision FROM cf
  JOIN (SELECT model, {_measures_sql()} FROM cf) m ON m.model = cf.model
  JOIN (SELECT model, round(sum((fpr - fpr0) * (rec + rec0) / 2), 6) AS roc_auc, round(sum((rec - rec0) * prec), 6) AS average_precision FROM pts GROUP BY model) a ON a.model = cf.model""")
def _(spark, sf):
    return ev.model_comparison(scores(spark, sf), thresholds(spark, sf))


@query("row_position", with_(SC) + f"SELECT model, {_ORD}, row_number() OVER (PARTITION BY model ORDER BY {_ORD}) - 1 AS pos FROM sc")
def _(spark, sf):
    return with_position(scores(spark, sf).select("model", *SCORE_ORDER), ["model"], SCORE_ORDER, score_chunk())
