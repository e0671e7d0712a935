import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from faultlens.functions.naming import display_name, parse_feature_name
from faultlens.operators import rootcause as rc
from faultlens.operators import scaling
from faultlens.operators import scoring as s
from faultlens.operators.clean import align_schema, feature_names, node_of, order_features
from faultlens.operators.grid import fuse_logs, log_counts, master_grid
from faultlens.plans import models, pipeline
from faultlens.schemas import FEATURES, HARVEST_FEATURES
from faultlens.session import stage
from tests.helpers import at, frame, plan, rows

INPUTS = feature_names(FEATURES)


def errors(spark, **at_index):
    err = [0.0] * 42
    for k, v in at_index.items():
        err[int(k[1:])] = v
    return frame(spark, [(1, 0, at("10:00:00"), err)], "series_id int, win_id bigint, ts timestamp, err array<double>")


def test_golden_scores_in_both_layouts(spark):
    df = errors(spark, e0=.42, e7=.14, e14=.07, e21=.07)
    for layout, nodes, score in (("by_node", [.035, .01, .005], .0295), ("contiguous", [.04, .01, 0], .033)):
        r = rc.score_errors(df, 42, layout=layout).first()
        assert np.allclose(r.node_err, nodes) and np.isclose(r.score, score)
    share = df.select(s.node_contribution(F.col("err")).alias("c")).first().c
    assert (share.app, share.db, share.redis) == (70.0, 20.0, 10.0)


def test_golden_contributors(spark):
    got = rows(rc.top_contributors(errors(spark, e0=.42, e7=.14, e14=.07, e21=.07), INPUTS), "rank")
    assert list(zip(got.node, got.feature, got.impact)) == [
        ("Nextcloud", "CPUUtil", 60), ("MySQL", "CPUUtil", 20), ("Nextcloud", "CPUUtil (Velocity)", 10)]


def test_no_error_and_no_contributor(spark):
    r = rc.primary_cause(errors(spark), INPUTS).first()
    assert r.impact == 0
    r = rc.primary_cause(errors(spark), ["pad"] * 42).first()
    assert (r.node, r.feature, r.impact) == ("Unknown", "Unknown", 100)


def test_report(spark):
    df = rc.score_errors(errors(spark, e0=.42, e7=.14, e14=.07, e21=.07), 42)
    r = rc.report(df, INPUTS, F.lit(0.02)).first()
    body = json.loads(r.report)
    assert body["severity"] == "LOW" and body["overall_score"] == 0.0295
    assert body["anomaly_type"] == "Infrastructure - CPU Stress"
    assert body["insight"] == "CPU pressure is elevated in Nextcloud"
    assert body["impact_analysis"] == {"app": 70.0, "db": 20.0, "redis": 10.0}
    assert np.isclose(r.confidence, 0.7375)


def test_weights():
    w = s.loss_weights()
    level, change = [2.0, 1.0, 1.5, 1.0, 1.5, 1.0, 1.0], [2.0, 1.0, 1.0, 1.0, 1.5, 1.0, 1.0]
    assert w == level * 3 + change * 3


def test_names(spark):
    df = frame(spark, [("app_cpu_delta",), ("x_log_avg_len_delta",), ("redis_pad_prom_1",), ("plain",)], "c string")
    got = [tuple(r.p) for r in df.select(parse_feature_name(F.col("c")).alias("p")).collect()]
    assert got == [("Nextcloud", "CPUUtil"), ("X", "Log_Avg_Len_Delta"), ("Padding", "Pad"), ("Unknown", "plain")]
    assert order_features(["ts", "db_a", "app_b", "ground_truth"]) == ["app_b", "db_a"]
    assert order_features(["a", "fault_type"]) == ["a"] and node_of("dbx_a") is None
    assert feature_names(["a"], 3) == ["a", "a_delta", "pad_live_0"]


def test_harvest_columns_align_to_the_slots(spark):
    df = frame(spark, [tuple([1] + [float(i) for i in range(12)])], "series_id int, " + ", ".join(f"{c} double" for c in HARVEST_FEATURES))
    r = align_schema(df, FEATURES, keep=["series_id"]).first()
    assert r.app_latency == 2.0 and r.db_threads == 0.0 and len(r) == 22


def test_golden_scaling(spark):
    df = frame(spark, [(1, at(f"10:00:{10 * i:02d}"), float(i + 1), 7.3, 0) for i in range(4)],
               "series_id int, ts timestamp, a double, b double, ground_truth int")
    fitted = scaling.scaler_values(scaling.fit_scaler(df, ["a", "b"]))
    assert np.allclose(fitted["a"], (2.5, 1.118034)) and fitted["b"][1] == 1.0
    from faultlens.operators.sequence import delta
    got = rows(delta(scaling.apply_scaler(df, fitted, ["a", "b"]), ["a", "b"]), "ts")
    assert np.allclose(got.a, [-1.341641, -.447214, .447214, 1.341641]) and np.allclose(got.b, 0)
    assert np.allclose(got.a_delta, [0, .894427, .894427, .894427])


def test_double_scale_against_numpy(spark):
    rng = np.random.default_rng(0)
    raw = rng.gamma(2, 30, (200, 3))
    raw[5, 0], raw[6, 1], raw[7, 2] = np.nan, np.inf, -np.inf
    y = (rng.random(200) < .2).astype(int)
    start = at("00:00:00")
    data = [(1, start + pd.Timedelta(seconds=10 * i), *map(float, raw[i]), int(y[i])) for i in range(200)]
    df = frame(spark, data, "series_id int, ts timestamp, app_a double, db_b double, redis_c double, ground_truth int")
    cols = ["app_a", "db_b", "redis_c"]
    out, _, _ = scaling.double_scale(df, cols)
    got = rows(out, "ts")[feature_names(cols)].to_numpy()
    x = np.nan_to_num(raw, nan=0.0, posinf=6.0, neginf=-6.0)
    z = np.clip((x - x[y == 0].mean(0)) / x[y == 0].std(0), -6, 6)
    both = np.hstack([z, np.diff(z, axis=0, prepend=z[:1])])
    want = np.clip((both - both[y == 0].mean(0)) / both[y == 0].std(0), -6, 6)
    assert np.allclose(got, want)


def test_golden_log_bins(spark):
    logs = frame(spark, [(1, "app", at("00:00:01"), 0, 3), (1, "app", at("00:00:35"), 1, 5)],
                 "series_id int, node string, ts timestamp, is_error int, msg_len int")
    counts = rows(log_counts(logs), "ts")
    assert list(counts.log_total) == [1, 0, 0, 1] and list(counts.log_avg_len.fillna(-1)) == [3, -1, -1, 5]
    grid = master_grid(frame(spark, [(1, at("00:00:00")), (1, at("00:00:50"))], "series_id int, ts timestamp"))
    kept = rows(fuse_logs(grid, log_counts(logs)), "ts")
    assert list(kept.app_log_avg_len.fillna(-1)) == [3, -1, -1, 5, 0, 0]
    assert list(kept.app_log_total) == [1, 0, 0, 1, 0, 0] and list(kept.db_log_total) == [0] * 6
    zero = rows(fuse_logs(grid, log_counts(logs), avg_len_null="zero"), "ts")
    assert list(zero.app_log_avg_len) == [3, 0, 0, 5, 0, 0]


def test_pca_reconstruction_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2)) @ rng.normal(size=(2, 8)) + rng.normal(size=(300, 8)) * .1 + 3
    df = frame(spark, [(i, [list(map(float, r[:4])), list(map(float, r[4:]))]) for i, r in enumerate(x)], "id int, win array<array<double>>")
    model = models.PcaReconstructor.fit(df, k=2)
    got = np.array([np.concatenate(r.recon) for r in model.reconstruct(df).orderBy("id").collect()])
    c = x - x.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(got, c @ vt[:2].T @ vt[:2] + x.mean(0))
    weighted = models.PcaReconstructor.fit(df, k=2, weights=[4.0, 1.0, 1.0, 1.0])
    root = np.tile(np.sqrt([4.0, 1, 1, 1]), 2)
    cw = x * root - (x * root).mean(0)
    _, _, vt = np.linalg.svd(cw, full_matrices=False)
    got = np.array([np.concatenate(r.recon) for r in weighted.reconstruct(df).orderBy("id").collect()])
    assert np.allclose(got, (cw @ vt[:2].T @ vt[:2] + (x * root).mean(0)) / root)


def test_stored_model_is_reused(spark, tmp_path):
    df = frame(spark, [(i, [float(i), float(i * 2 % 7), 1.0]) for i in range(20)], "id int, win array<double>")
    first = models.load_or_fit(df, str(tmp_path / "m"), k=1)
    other = df.select("id", F.transform("win", lambda v: v * 100).alias("win"))
    again = models.load_or_fit(other, str(tmp_path / "m"), k=1)
    assert np.allclose(first.mean, again.mean) and np.allclose(first.components, again.components)


def test_attention_against_numpy(spark):
    rng = np.random.default_rng(4)
    x, w, a = rng.normal(size=(3, 5)), rng.normal(size=(5, 2)), rng.normal(size=4)
    df = frame(spark, [(1, f"n{i}", list(map(float, x[i]))) for i in range(3)], "t int, node string, x array<double>")

    def layer(mask):
        h = x @ w
        e = np.array([[np.concatenate([h[i], h[j]]) @ a for j in range(3)] for i in range(3)])
        e = np.where(e > 0, e, .2 * e)
        p = np.where(mask, np.exp(e), 0)
        out = (p / p.sum(1, keepdims=True)) @ h
        return np.where(out > 0, out, np.exp(out) - 1)

    got = rows(s.graph_attention(df, w.tolist(), a.tolist(), keys=["t"]), "node")
    assert np.allclose(np.stack(got.h), layer(np.ones((3, 3), bool)))
    edges = frame(spark, [("n0", "n1"), ("n0", "n2"), ("n1", "n1"), ("n2", "n0")], "src string, dst string")
    mask = np.array([[0, 1, 1], [0, 1, 0], [1, 0, 0]], bool)
    got = rows(s.graph_attention(df, w.tolist(), a.tolist(), keys=["t"], edges=edges), "node")
    assert np.allclose(np.stack(got.h), layer(mask))
    # Logits beyond what an exponent holds.
    large = df.withColumn("x", F.transform("x", lambda v: v * 1e4))
    assert all(np.isfinite(v) for r in s.graph_attention(large, w.tolist(), a.tolist(), keys=["t"], edges=edges, activate=False).collect() for v in r.h)
    # Edges are joined by equality; no list of all nodes of a step is made.
    text = plan(s.graph_attention(df, w.tolist(), a.tolist(), keys=["t"], edges=edges))
    assert "NestedLoop" not in text and "Cartesian" not in text and "collect_list" not in text


def test_probe_windows_are_scored(spark):
    cols = ["app_cpu", "app_mem", "db_b", "redis_c", "app_cpu_delta", "x"]
    scaler = frame(spark, [("app_cpu", 5.0, 3.0), ("app_mem", 1e9, 5e8)], "feature string, mean double, scale double")
    probes = models.probe_windows(scaler, cols, size=4)
    model = models.PcaReconstructor(np.full(24, .25), np.zeros((24, 1)))
    got = {r.scenario: r for r in models.score_probes(probes, model.reconstruct, width=6).collect()}
    wins = {"zeros": np.zeros(6), "ones": np.ones(6), "cpu_95": np.array([(95 - 5) / (3 + 1e-9), 0, 0, 0, 0, 0]),
            "mem_2gib": np.array([0, (2 * 1024**3 - 1e9) / (5e8 + 1e-9), 0, 0, 0, 0])}
    assert set(got) == set(wins)
    for name, row in wins.items():
        err = (row - .25) ** 2
        nodes = [err[[i, i + 3]].mean() for i in range(3)]
        assert np.allclose(got[name].err, err) and np.allclose(got[name].score, .7 * max(nodes) + .3 * np.mean(nodes))


def test_shown_names_agree_with_the_column_form(spark):
    names = INPUTS + ["plain", "x_pad_1", "app_probe_success_ratio", "web_some_thing"]
    found = spark.createDataFrame([(n,) for n in names], "n string").select("n", parse_feature_name(F.col("n")).alias("p")).collect()
    assert [tuple(r.p) for r in found] == [display_name(n) for n in names]
    assert display_name("app_cpu_delta", True)[1] == "CPUUtil (Velocity)"


def test_feature_error_and_baselines(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 6))
    cols = ["app_a", "db_b", "redis_c", "app_a_delta", "db_b_delta", "redis_c_delta"]
    data = [(1, at("10:00:00") + pd.Timedelta(seconds=10 * i), *map(float, x[i]), 0, "HEALTHY") for i in range(30)]
    df = frame(spark, data, "series_id int, ts timestamp, " + ", ".join(f"{c} double" for c in cols) + ", ground_truth int, fault_type string")
    got = rows(models.score_baseline(df, cols, "mean", size=4), "win_id")
    sq = (x - x.mean(0)) ** 2
    want = np.stack([sq[i:i + 4].mean(0) for i in range(27)])
    assert np.allclose(np.stack(got.err), want)
    nodes = np.stack([want[:, [i, i + 3]].mean(1) for i in range(3)], 1)
    assert np.allclose(got.score, .7 * nodes.max(1) + .3 * nodes.mean(1))
    from faultlens.operators.sequence import sliding_windows
    win = sliding_windows(df, cols, 4).withColumn("recon", F.array_repeat(F.array(*[F.lit(float(m)) for m in x.mean(0)]), 4))
    same = rows(models.score_windows(win, width=6), "win_id")
    assert np.allclose(same.score, got.score)


def test_split_keeps_class_shares_and_repeats(spark):
    df = spark.range(1000).select(F.col("id").alias("win_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    a, b = models.stratified_split(df), models.stratified_split(df.repartition(7))
    assert {(r.y, r.part): r["count"] for r in a.groupBy("y", "part").count().collect()} == {
        (0, "test"): 270, (0, "train"): 630, (1, "test"): 30, (1, "train"): 70}
    assert a.exceptAll(b).count() == 0


def chain_rows(spark, spoiled=0.0):
    rng = np.random.default_rng(2)
    data = [(sid, at("10:00:00") + pd.Timedelta(seconds=10 * i), *map(float, rng.gamma(2, 1, len(FEATURES)) + (spoiled if i >= 60 else 0.0)),
             int(i % 30 > 26), "F1" if i % 30 > 26 else "HEALTHY") for sid in (1, 2) for i in range(90)]
    return frame(spark, data, "series_id int, ts timestamp, " + ", ".join(f"{c} double" for c in FEATURES) + ", ground_truth int, fault_type string")


def test_chain_shuffles_no_windows_and_compares_models(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(pipeline, "stage", lambda df, *a: plans.append(plan(df)) or stage(df, *a))
    out = pipeline.train_and_score(chain_rows(spark), k=3)
    assert {r.model for r in out["comparison"].collect()} == {"pca", "mean", "persistence"}
    counts = {(r.model, r.part): r["count"] for r in out["scores"].groupBy("model", "part").count().collect()}
    assert all(counts[m, "test"] + counts[m, "train"] == 162 for m in ("pca", "mean", "persistence"))
    built = [p for p in plans if "collect_list" in p]
    assert built and all("Exchange" not in p[:p.index("collect_list")] for p in built)


def test_honest_chain_sees_training_rows_only(spark):
    train = F.col("ts") < F.lit(at("10:10:00").to_pydatetime())
    one, two = (pipeline.train_and_score(chain_rows(spark, spoiled), k=3, train=train) for spoiled in (0.0, 50.0))
    for scaler in ("level_scaler", "combined_scaler"):
        assert all(np.allclose(one[scaler][c], two[scaler][c]) for c in one[scaler])
    assert np.allclose(rows(one["thresholds"], "model").threshold, rows(two["thresholds"], "model").threshold)
    parts = rows(one["scores"].where("model = 'mean'"), "series_id", "win_id")
    # Windows that mix training and test rows take no part.
    assert list(parts.win_id[(parts.series_id == 1)]) == [*range(51), *range(60, 81)]
