"""Errors, scores, root causes, reconstruction models."""

import numpy as np
from pyspark.sql import functions as F

from faultlens.bindings.base import FEATURES, HOUR, NODES, SC, query, table, with_
from faultlens.bindings.features import INPUTS, SCALED, features
from faultlens.operators import rootcause as rc
from faultlens.operators import scoring as s
from faultlens.operators.clean import finite_guard
from faultlens.operators.scaling import fit_scaler
from faultlens.plans import models
from faultlens.session import new_folder

WIDTH = len(INPUTS)


def healthy():
    return F.col("ground_truth") == 0


# ---- embeddings as small windows: 4 steps of 16 features ---------------------------------------------

EMB = """em AS (SELECT vec_id, label, i, CAST(embedding[i + 1] AS DOUBLE) AS x, avg(CAST(embedding[i + 1] AS DOUBLE)) OVER (PARTITION BY label, i) AS m
  FROM embeddings, (SELECT unnest(range(64)) AS i))"""
ERR = "er AS (SELECT vec_id, i % 16 AS f, avg((x - m) * (x - m)) AS e FROM em GROUP BY ALL)"


def vectors(spark, sf):
    """Windows of 4×16 from the embeddings, and the mean window of their label as reconstruction."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    means = e.groupBy("label").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(64)]).alias("m"))
    from faultlens.session import attach
    out = attach(e, means, ["label"])
    split = lambda c: F.array(*[F.slice(c, 16 * t + 1, 16) for t in range(4)])
    return out.select("vec_id", "label", split("v").alias("win"), split("m").alias("recon"))


@query("h1_feature_error", with_(EMB, ERR) + "SELECT vec_id, CAST(f AS INTEGER) AS idx, round(e * 1000, 6) AS err_e3 FROM er")
def _(spark, sf):
    err = vectors(spark, sf).select("vec_id", s.feature_error(F.col("win"), F.col("recon")).alias("err"))
    return err.select("vec_id", F.posexplode("err").alias("idx", "e")).select("vec_id", "idx", (F.col("e") * 1000).alias("err_e3"))


# ---- errors of the healthy-mean model over the scaled inputs -----------------------------------------

_MEANS = "mu AS (SELECT " + ", ".join(f"avg({c}) AS u_{c}" for c in INPUTS) + " FROM x WHERE ground_truth = 0)"
_ROWERR = "re AS (SELECT series_id, ts, ground_truth, [" + ", ".join(f"power({c} - u_{c}, 2)" for c in INPUTS) + "] AS e FROM x, mu)"
_LONG = "ln AS (SELECT series_id, ts, unnest(range(42)) AS idx, unnest(e) AS e FROM re)"
WERR = """we AS (SELECT series_id, win_id, ts, idx, err FROM (SELECT series_id, ts, idx, avg(e) OVER w AS err, row_number() OVER (PARTITION BY series_id, idx ORDER BY ts) - 10 AS win_id FROM ln
  WINDOW w AS (PARTITION BY series_id, idx ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE win_id >= 0)"""
MEAN_MODEL = (*SCALED, _MEANS, _ROWERR, _LONG, WERR)
_PREV = "pv AS (SELECT series_id, ts, ground_truth, " + ", ".join(f"COALESCE(lag({c}) OVER w, {c}) AS p_{c}, {c}" for c in INPUTS) + " FROM x WINDOW w AS (PARTITION BY series_id ORDER BY ts))"
_PREVERR = "re AS (SELECT series_id, ts, ground_truth, [" + ", ".join(f"power({c} - p_{c}, 2)" for c in INPUTS) + "] AS e FROM pv)"
NODE_OF = "CASE WHEN idx % 21 < 7 THEN 0 WHEN idx % 21 < 14 THEN 1 ELSE 2 END"
NE = f"ne AS (SELECT series_id, win_id, ts, {NODE_OF} AS n, avg(err) AS v, sum(err) AS total FROM we GROUP BY ALL)"
HSQL = "hy AS (SELECT series_id, win_id, ts, 0.7 * max(v) + 0.3 * avg(v) AS score FROM ne GROUP BY ALL)"


def baseline(spark, sf, kind="mean", layout="by_node"):
    return models.score_baseline(features(spark, sf), INPUTS, kind, layout=layout, healthy=healthy(), step=HOUR, keep=["ts"])


@query("h2_node_error", with_(*MEAN_MODEL, NE) + """SELECT series_id, win_id, ts, round(max(v) FILTER (n = 0), 6) AS app, round(max(v) FILTER (n = 1), 6) AS db, round(max(v) FILTER (n = 2), 6) AS redis
FROM ne GROUP BY series_id, win_id, ts""")
def _(spark, sf):
    return baseline(spark, sf).select("series_id", "win_id", "ts", *[F.col("node_err")[i].alias(n) for i, n in enumerate(NODES)])


@query("h2_node_error_contiguous", with_(*MEAN_MODEL, "nc AS (SELECT series_id, win_id, ts, idx // 14 AS n, avg(err) AS v FROM we GROUP BY ALL)") +
       """SELECT series_id, win_id, ts, round(max(v) FILTER (n = 0), 6) AS part0, round(max(v) FILTER (n = 1), 6) AS part1, round(max(v) FILTER (n = 2), 6) AS part2, round(0.7 * max(v) + 0.3 * avg(v), 6) AS score
FROM nc GROUP BY series_id, win_id, ts""")
def _(spark, sf):
    return baseline(spark, sf, layout="contiguous").select("series_id", "win_id", "ts", *[F.col("node_err")[i].alias(f"part{i}") for i in range(3)], "score")


@query("h3_hybrid_score", with_(*MEAN_MODEL, NE, HSQL) + "SELECT series_id, win_id, ts, round(score, 6) AS score FROM hy")
def _(spark, sf):
    return baseline(spark, sf).select("series_id", "win_id", "ts", "score")


@query("h4_node_contribution", with_(*MEAN_MODEL, NE, "nt AS (SELECT *, sum(total) OVER (PARTITION BY series_id, win_id) AS al FROM ne)") +
       """SELECT series_id, win_id, round(max(total / al * 100) FILTER (n = 0), 2) AS app, round(max(total / al * 100) FILTER (n = 1), 2) AS db, round(max(total / al * 100) FILTER (n = 2), 2) AS redis
FROM nt WHERE al > 0 GROUP BY series_id, win_id""")
def _(spark, sf):
    out = baseline(spark, sf).select("series_id", "win_id", s.node_contribution(F.col("err")).alias("c"))
    return out.where("c IS NOT NULL").select("series_id", "win_id", "c.*")


_WEIGHTS = s.loss_weights()
# The same weights written out for the SQL: levels by node, then changes by node.
_SQL_WEIGHTS = """2.0, 1, 1.5, 1, 1.5, 1, 1, 2.0, 1, 1.5, 1, 1.5, 1, 1, 2.0, 1, 1.5, 1, 1.5, 1, 1,
    2.0, 1, 1, 1, 1.5, 1, 1, 2.0, 1, 1, 1, 1.5, 1, 1, 2.0, 1, 1, 1, 1.5, 1, 1"""


@query("h5_weighted_error", with_(*MEAN_MODEL) + f"SELECT series_id, win_id, round(avg(err * ([{_SQL_WEIGHTS}])[idx + 1]), 6) AS loss FROM we GROUP BY ALL")
def _(spark, sf):
    return baseline(spark, sf).select("series_id", "win_id", s.weighted_error(F.col("err"), _WEIGHTS).alias("loss"))


@query("h7_pad_features", "SELECT vec_id, CAST(66 AS INTEGER) AS width, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 6) AS total FROM embeddings")
def _(spark, sf):
    from faultlens.operators.clean import pad_count
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", s.pad_features(F.col("v"), pad_count(64)).alias("p")).select(
        "vec_id", F.size("p").alias("width"), (s.mean_of(F.col("p")) * F.size("p")).alias("total"))


@query("j2_persistence", with_(*SCALED, _PREV, _PREVERR, _LONG, WERR, NE, HSQL) + "SELECT series_id, win_id, ts, round(score, 6) AS score FROM hy")
def _(spark, sf):
    return baseline(spark, sf, "persistence").select("series_id", "win_id", "ts", "score")


# ---- root cause --------------------------------------------------------------------------------------

_TOPS = f"""tp AS (SELECT *, row_number() OVER (PARTITION BY series_id, win_id ORDER BY err DESC, idx DESC) AS rank FROM (SELECT *, sum(err) OVER (PARTITION BY series_id, win_id) AS total FROM we)
  WHERE idx % 21 NOT IN (10, 16, 17))"""
_SHOWN = [("Nextcloud", "MySQL", "Redis")[i % 21 // 7] for i in range(42)]
_FEAT = {"cpu": "CPUUtil", "mem": "MemUtil", "latency": "Latency", "probe_success": "HealthProbe", "log_error": "ErrorRate", "log_total": "LogVolume",
         "threads": "ActiveThreads", "log_avg_len": "Log_Avg_Len"}


def _feat(i: int) -> str:
    kind = FEATURES[i % 21].split("_", 1)[1]
    text = _FEAT.get(kind, "Pad")
    if i >= 21:
        text += ("_Delta" if kind == "log_avg_len" else "") + " (Velocity)"
    return text


_NAMES = "([" + ", ".join(f"'{n}'" for n in _SHOWN) + "])[idx + 1] AS node, ([" + ", ".join(f"'{_feat(i)}'" for i in range(42)) + "])[idx + 1] AS feature"


@query("f1_top_contributors", with_(*MEAN_MODEL, _TOPS) + f"SELECT series_id, win_id, CAST(rank AS INTEGER) AS rank, {_NAMES}, CAST(CASE WHEN total > 0 THEN trunc(err / total * 100) ELSE 0 END AS INTEGER) AS impact FROM tp WHERE rank <= 3")
def _(spark, sf):
    return rc.top_contributors(baseline(spark, sf), INPUTS)


@query("f2_primary_cause", with_(*MEAN_MODEL, _TOPS) + f"SELECT series_id, win_id, {_NAMES}, CAST(CASE WHEN total > 0 THEN trunc(err / total * 100) ELSE 0 END AS INTEGER) AS impact FROM tp WHERE rank = 1")
def _(spark, sf):
    return rc.primary_cause(baseline(spark, sf), INPUTS)


@query("g16_report_json", with_(*MEAN_MODEL, _TOPS, NE, HSQL) + f"""SELECT t.series_id, t.win_id, strftime(h.ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, CASE WHEN score < 1 THEN 'NORMAL' WHEN score < 1.5 THEN 'LOW' WHEN score < 2 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
  round(score, 6) AS overall_score, round(least(1.0, score / 2.0), 6) AS confidence, node AS cause_node, feature AS cause_feature, impact, round(a, 6) AS app_score, true AS is_json
FROM (SELECT series_id, win_id, {_NAMES}, CAST(CASE WHEN total > 0 THEN trunc(err / total * 100) ELSE 0 END AS INTEGER) AS impact FROM tp WHERE rank = 1) t
JOIN hy h ON h.series_id = t.series_id AND h.win_id = t.win_id JOIN (SELECT series_id, win_id, v AS a FROM ne WHERE n = 0) z ON z.series_id = t.series_id AND z.win_id = t.win_id""")
def _(spark, sf):
    out = rc.report(baseline(spark, sf), INPUTS, F.lit(1.0))
    return out.select("series_id", "win_id", "body.timestamp", "body.severity", "body.overall_score", "confidence",
                      F.col("body.primary_cause.node").alias("cause_node"), F.col("body.primary_cause.feature").alias("cause_feature"),
                      "body.primary_cause.impact", F.col("body.node_scores.Nextcloud").alias("app_score"),
                      F.try_parse_json("report").isNotNull().alias("is_json"))


# ---- models ------------------------------------------------------------------------------------------

@query("j5_stratified_split", """SELECT d.doc_id, l.quality AS y, CASE WHEN row_number() OVER (PARTITION BY l.quality ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id) <= round(count(*) OVER (PARTITION BY l.quality) * 0.3) THEN 'test' ELSE 'train' END AS part
FROM documents d JOIN labels l USING (doc_id)""")
def _(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"))
    rows = table(spark, sf, "documents").select("doc_id").join(labels, "doc_id")
    return models.stratified_split(rows, 0.3, ["doc_id"])


@query("j6_healthy_only", with_(SC) + "SELECT model, count(*) AS n FROM sc WHERE y = 0 GROUP BY model")
def _(spark, sf):
    from faultlens.bindings.base import scores
    return models.healthy_only(scores(spark, sf)).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def _weights(rows: int, cols: int) -> list[list[float]]:
    """A fixed, smooth weight matrix, so that the layer can be checked by hand."""
    return [[round(float(np.sin(1 + r * cols + c)), 6) for c in range(cols)] for r in range(rows)]


def attention_nodes(spark, sf):
    """Four nodes per embedding: its four steps of sixteen values."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    nodes = F.array(*[F.struct(F.lit(i).alias("node"), F.slice("v", 16 * i + 1, 16).alias("x")) for i in range(4)])
    return e.select("vec_id", F.explode(nodes).alias("n")).select("vec_id", "n.*")


#: A sparse graph: each node, the next one, and node 0 from everywhere.
_EDGES = [(0, 0), (0, 1), (1, 1), (1, 2), (1, 0), (2, 2), (2, 3), (2, 0), (3, 3), (3, 0)]
_GA_W, _GA_A = _weights(16, 3), [row[0] for row in _weights(6, 1)]
_GA = ("nd AS (SELECT vec_id, n, [" + ", ".join("(" + " + ".join(f"CAST(embedding[16 * n + {k + 1}] AS DOUBLE) * ({_GA_W[k][u]})" for k in range(16)) + ")" for u in range(3)) +
       "] AS h FROM embeddings, (SELECT unnest(range(4)) AS n))")
_GE = ("ge AS (SELECT i.vec_id, i.n AS i, j.h AS hj, " + " + ".join(f"i.h[{u + 1}] * ({_GA_A[u]}) + j.h[{u + 1}] * ({_GA_A[3 + u]})" for u in range(3)) +
       " AS l FROM nd i JOIN (VALUES " + ", ".join(map(str, _EDGES)) + ") ed(src, dst) ON ed.src = i.n JOIN nd j ON i.vec_id = j.vec_id AND j.n = ed.dst)")
_GP = "gp AS (SELECT vec_id, i, hj, exp(CASE WHEN l > 0 THEN l ELSE 0.2 * l END) AS p FROM ge)"


@query("h6_graph_attention", with_(_GA, _GE, _GP) + "SELECT vec_id, CAST(i AS INTEGER) AS node, " + ", ".join(
    f"round(CASE WHEN sum(p * hj[{u}]) / sum(p) > 0 THEN sum(p * hj[{u}]) / sum(p) ELSE exp(sum(p * hj[{u}]) / sum(p)) - 1 END, 6) AS h{u}" for u in (1, 2, 3)) + " FROM gp GROUP BY vec_id, i")
def _(spark, sf):
    edges = spark.createDataFrame(_EDGES, "src int, dst int")
    out = s.graph_attention(attention_nodes(spark, sf), _GA_W, _GA_A, keys=["vec_id"], edges=edges)
    return out.select("vec_id", "node", *[F.col("h")[u].alias(f"h{u + 1}") for u in range(3)])


def _embedding_windows(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", (F.col("label") >= 8).cast("int").alias("y"),
                                                 F.array(*[F.slice(F.col("embedding").cast("array<double>"), 16 * t + 1, 16) for t in range(4)]).alias("win"))


@query("j1_fit_reconstructor")
def _(spark, sf):
    """PCA fitted on the healthy embeddings, score of every embedding."""
    win = _embedding_windows(spark, sf)
    model = models.PcaReconstructor.fit(models.healthy_only(win), k=8)
    return models.score_windows(model.reconstruct(win), width=16, layout="contiguous", n_nodes=2).select("vec_id", "y", "score")


@query("j3_score_windows", with_(EMB, ERR) + """SELECT vec_id, round((0.7 * greatest(a, b) + 0.3 * (a + b) / 2) * 1000, 6) AS score_e3 FROM
  (SELECT vec_id, avg(e) FILTER (f < 8) AS a, avg(e) FILTER (f >= 8) AS b FROM er GROUP BY vec_id)""")
def _(spark, sf):
    scored = models.score_windows(vectors(spark, sf), width=16, layout="contiguous", n_nodes=2)
    return scored.select("vec_id", (F.col("score") * 1000).alias("score_e3"))


def _predict_fn():
    """Stands for a saved network: any callable from a batch array to a batch array."""
    def predict(batch: np.ndarray) -> np.ndarray:
        return (batch * 0.5).astype(np.float32)
    return predict


@query("j4_score_external", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: power(CAST(v AS DOUBLE) * 0.5, 2))) * 1000, 3) AS err_e3 FROM embeddings")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("win"))
    out = models.score_external(e, _predict_fn, shape=[64])
    d = F.zip_with("win", "recon_flat", lambda a, b: (a - b) * (a - b))
    return out.select("vec_id", F.round(F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v) * 1000, 3).alias("err_e3"))


@query("j7_add_noise", "SELECT count(*) AS n, true AS mean_is_zero, true AS sd_is_right FROM embeddings, (SELECT unnest(range(64)))")
def _(spark, sf):
    """Moments of the added noise over all cells."""
    win = _embedding_windows(spark, sf).withColumn("noisy", F.col("win"))
    noisy = models.add_noise(win, 0.03, col="noisy")
    cells = noisy.select(F.explode(F.zip_with(F.flatten("noisy"), F.flatten("win"), lambda a, b: a - b)).alias("d"))
    return cells.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg("d")) < 0.001).alias("mean_is_zero"),
                     (F.abs(F.stddev_pop("d") - 0.03) < 0.001).alias("sd_is_right"))


@query("j8_probe_windows", with_(*SCALED) + """SELECT scenario, i // 42 AS step, i % 42 AS idx, round(CASE scenario WHEN 'ones' THEN 1.0 WHEN 'cpu_95' THEN CASE WHEN i % 42 = 0 THEN (95.0 - m_app_cpu) / (s_app_cpu + 1e-9) ELSE 0.0 END
  WHEN 'mem_2gib' THEN CASE WHEN i % 42 = 1 THEN (2147483648.0 - m_app_mem) / (s_app_mem + 1e-9) ELSE 0.0 END ELSE 0.0 END, 1) AS z
FROM fit1, (SELECT unnest(['zeros', 'ones', 'cpu_95', 'mem_2gib']) AS scenario), (SELECT unnest(range(420)) AS i)""")
def _(spark, sf):
    from faultlens.bindings.base import fused
    clean = finite_guard(fused(spark, sf), FEATURES)
    win = models.probe_windows(fit_scaler(clean, FEATURES, healthy()), INPUTS)
    return (win.select("scenario", F.posexplode(F.flatten("win")).alias("i", "z"))
            .select("scenario", F.floor(F.col("i") / F.lit(42)).alias("step"), (F.col("i") % 42).cast("bigint").alias("idx"), F.round("z", 1).alias("z")))


_PROBE_Z = """pz AS (SELECT 'zeros' AS scenario, 0.0 AS z UNION ALL SELECT 'cpu_95', (95.0 - m_app_cpu) / (s_app_cpu + 1e-9) FROM fit1
  UNION ALL SELECT 'mem_2gib', (2147483648.0 - m_app_mem) / (s_app_mem + 1e-9) FROM fit1)"""


@query("j8_score_probes", with_(*SCALED, _PROBE_Z) + """SELECT scenario, round(ln(1 + 0.7 * z * z / 14 + 0.3 * z * z / 42), 6) AS log_score, round(ln(1 + z * z), 6) AS log_total FROM pz
UNION ALL SELECT 'ones', round(ln(2.0), 6), round(ln(43.0), 6)""")
def _(spark, sf):
    """Probe windows scored by the model that expects the healthy mean, which is zero in scaled units."""
    from faultlens.bindings.base import fused
    probes = models.probe_windows(fit_scaler(finite_guard(fused(spark, sf), FEATURES), FEATURES, healthy()), INPUTS)
    expected = F.transform("win", lambda row: F.transform(row, lambda v: F.lit(0.0)))
    scored = models.score_probes(probes, lambda p: p.withColumn("recon", expected), len(INPUTS))
    total = F.aggregate("err", F.lit(0.0), lambda a, v: a + v)
    return scored.select("scenario", F.log1p("score").alias("log_score"), F.log1p(total).alias("log_total"))


@query("j1_load_or_fit_pca")
def _(spark, sf):
    """Fit and store, then load and score: the second call reads the stored model."""
    win = _embedding_windows(spark, sf)
    path = new_folder(spark, "pca")
    models.load_or_fit(models.healthy_only(win), path, k=8)
    model = models.load_or_fit(models.healthy_only(win), path, k=8)
    return models.score_windows(model.reconstruct(win), width=16, layout="contiguous", n_nodes=2).select("vec_id", "score")


_NB_W, _NB_A = _weights(14, 4), [row[0] for row in _weights(8, 1)]
_NB = ("nx AS MATERIALIZED (SELECT series_id, ts, unnest(range(3)) AS n, unnest([" + ", ".join(
    "[" + ", ".join(INPUTS[i] for i in idx) + "]" for idx in s.node_slices(WIDTH)) + "]) AS v FROM x)",
    "nh AS MATERIALIZED (SELECT series_id, ts, n, v, [" + ", ".join("(" + " + ".join(f"v[{k + 1}] * ({_NB_W[k][u]})" for k in range(14)) + ")" for u in range(4)) + "] AS h FROM nx)",
    "np AS (SELECT i.series_id, i.ts, i.n, i.v AS vi, j.v AS vj, " + " + ".join(f"i.h[{u + 1}] * ({_NB_A[u]}) + j.h[{u + 1}] * ({_NB_A[4 + u]})" for u in range(4)) +
    " AS l FROM nh i JOIN nh j ON i.series_id = j.series_id AND i.ts = j.ts AND i.n <> j.n)",
    "nq AS (SELECT *, CASE WHEN l > 0 THEN l ELSE 0.2 * l END AS e FROM np)",
    "nr AS (SELECT *, exp(e - max(e) OVER (PARTITION BY series_id, ts, n)) AS p FROM nq)",
    "ns AS (SELECT series_id, ts, n, [" + ", ".join(f"power(any_value(vi[{k}]) - sum(p * vj[{k}]) / sum(p), 2)" for k in range(1, 15)) + "] AS errs FROM nr GROUP BY series_id, ts, n)")


@query("j2_neighbour", with_(*SCALED, *_NB) + "SELECT series_id, ts, ['app', 'db', 'redis'][n + 1] AS node, round(list_sum(errs) / 14, 6) AS node_err FROM ns")
def _(spark, sf):
    """Each node from the attention-weighted values of the others, on the scaled inputs."""
    node_cols = {n: [INPUTS[i] for i in idx] for n, idx in zip(NODES, s.node_slices(WIDTH))}
    err = models.neighbour_errors(features(spark, sf), node_cols, _NB_W, _NB_A)
    return err.select("series_id", "ts", "node", s.mean_of(F.col("err")).alias("node_err"))


@query("train_and_score")
def _(spark, sf):
    """The whole chain: fused table, features, windows, split, three models, calibration, comparison."""
    from faultlens.bindings.base import fused
    from faultlens.plans.pipeline import train_and_score
    return train_and_score(fused(spark, sf), k=8, step=HOUR)["comparison"]


@query("train_and_score_honest")
def _(spark, sf):
    """The same with the first 20 days as training rows: nothing fitted or chosen sees a test row."""
    from faultlens.bindings.base import fused
    from faultlens.plans.pipeline import train_and_score
    train = F.col("ts") < F.lit("2024-01-21").cast("timestamp")
    return train_and_score(fused(spark, sf), k=8, train=train, step=HOUR)["comparison"]
