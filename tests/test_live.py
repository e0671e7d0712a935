import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultlens.operators import sequence as seq
from faultlens.operators.clean import feature_names
from faultlens.operators.ordered import time_chunk
from faultlens.plans import bundle
from faultlens.schemas import SAMPLE
from faultlens.streaming import live
from tests.helpers import at, frame, rows

GOLDEN = [.1, .2, .3, .2, .1, 1, 1, .1, .1]
SCORES = "series_id int, ts timestamp, score double"


def score_rows(values, series=1):
    return [(series, at("10:00:00") + pd.Timedelta(seconds=10 * i), float(v)) for i, v in enumerate(values)]


def replay(values, threshold):
    alarm = live.Alarm(threshold)
    return [t for t in (alarm.tick(v) for v in values) if t]


def test_golden_alarm(spark):
    got = rows(seq.sentinel_batch(frame(spark, score_rows(GOLDEN), SCORES), .3), "ts")
    assert list(got.tick) == [5, 6, 7, 8] and list(got.anomaly) == [False, True, False, False]
    assert np.allclose(got.smoothed, [.433333, .7, .7, .4]) and np.allclose(got.offset, .233333)
    assert np.allclose(got.corrected, [.2, .466667, 0, .166667])
    assert [t[2] for t in replay(GOLDEN, .3)] == [False, True, False, False]


@pytest.mark.parametrize("size,seconds", [(5, 30), (7, 200), (64, 10**6)])
def test_alarm_replay_in_chunks_equals_the_loop(spark, size, seconds):
    """Random scores around the threshold give sets, clears, keeps and flips in every order."""
    rng = np.random.default_rng(8)
    data, want = [], {}
    for s, n in ((1, 400), (2, 37), (3, 4)):
        v = np.round(rng.choice([0, .1, .5, .9, 1.4], n) + rng.random(n) * .2, 3)
        data += score_rows(v, s)
        want[s] = replay(v, .3)
    got = rows(seq.sentinel_batch(frame(spark, data, SCORES), .3, chunk=time_chunk("ts", seconds), size=size), "series_id", "ts")
    for s, ticks in want.items():
        mine = got[got.series_id == s]
        assert list(mine.anomaly) == [t[2] for t in ticks]
        assert np.allclose(mine.corrected.astype(float), [t[1] for t in ticks])


@pytest.mark.parametrize("batches", [1, 6])
def test_stream_equals_batch(spark, tmp_path, batches):
    rng = np.random.default_rng(batches)
    data = [r for s in (1, 2) for r in score_rows(np.round(rng.gamma(2, .3, 120), 3), s)]
    data.sort(key=lambda r: r[1])
    for i, part in enumerate(np.array_split(np.arange(len(data)), batches)):
        frame(spark, [data[k] for k in part], SCORES).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    source = live.stream_samples(spark, str(tmp_path / "in/*"), spark.read.parquet(str(tmp_path / "in/b0")).schema, max_files=1)
    out = live.run_to_table(live.stream_sentinel(source, .3), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    want = rows(seq.sentinel_batch(frame(spark, data, SCORES), .3), "series_id", "ts")
    got = rows(out, "series_id", "ts")
    assert list(got.anomaly) == list(want.anomaly) and np.allclose(got.corrected, want.corrected)
    assert list(got.tick) == list(want.tick) and list(got.ts) == list(want.ts)


def test_sentinel_under_another_key_name(spark, tmp_path):
    frame(spark, score_rows(GOLDEN), SCORES).withColumnRenamed("series_id", "host").write.parquet(str(tmp_path / "in"))
    source = live.stream_samples(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    out = live.run_to_table(live.stream_sentinel(source, .3, key="host"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert [(r.host, r.anomaly) for r in out.orderBy("ts").collect()] == [(1, a) for a in (False, True, False, False)]


def samples(spark, path, values, batches=1):
    """values: slot → {metric: value or None}; one file per batch."""
    slots = sorted(values)
    for i, part in enumerate(np.array_split(np.array(slots), batches)):
        data = [("a", m, {"name": m}, at("10:00:00") + pd.Timedelta(seconds=10 * int(t) + 3), float(v))
                for t in part for m, v in values[int(t)].items() if v is not None]
        spark.createDataFrame([(r[0], r[1], r[2], r[3].to_pydatetime(), r[4]) for r in data], SAMPLE).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("batches", [1, 4])
def test_live_windows_fill_gaps_and_match_numpy(spark, tmp_path, batches):
    rng = np.random.default_rng(11)
    cols = ["app_cpu", "db_cpu", "redis_cpu"]
    values = {t: {c: float(np.round(rng.gamma(2, 10), 2)) if rng.random() > .2 else None for c in cols} for t in range(60)}
    for t in (20, 21, 22, 41):
        values.pop(t)
    values[0] = {c: 1.0 for c in cols}
    values[60 + 40] = {c: 0.0 for c in cols}  # moves the watermark past the last slot under test
    samples(spark, str(tmp_path / "in"), values, batches)
    grid = live.stream_grid(live.stream_samples(spark, str(tmp_path / "in"), max_files=1), cols)
    level, combined = [(20., 10.)] * 3, [(0., 1.)] * 6
    errors = live.window_errors(level, combined, np.zeros_like)
    slices = [[0, 3], [1, 4], [2, 5]]
    ticks = live.stream_windows(grid, cols, errors, slices, threshold=.4)
    got = rows(live.run_to_table(ticks, str(tmp_path / "out"), str(tmp_path / "ckpt")), "ts")

    dense, last = [], np.zeros(3)
    for t in range(60):
        row = values.get(t, {})
        last = np.array([row.get(c) if row.get(c) is not None else last[k] for k, c in enumerate(cols)])
        dense.append(last)
    alarm, want = live.Alarm(.4), []
    for i in range(len(dense) - 9):
        z = np.clip((np.stack(dense[i:i + 10]) - 20) / 10, -6, 6)
        err = (np.hstack([z, np.diff(z, axis=0, prepend=z[:1])]) ** 2).mean(0)
        nodes = [err[s].mean() for s in slices]
        hit = alarm.tick(.7 * max(nodes) + .3 * np.mean(nodes))
        if hit:
            want.append((at("10:00:00") + pd.Timedelta(seconds=10 * (i + 9)), *hit))
    assert list(got.ts) == [w[0] for w in want]
    assert np.allclose(got.corrected, [w[2] for w in want]) and list(got.anomaly) == [w[3] for w in want]


def test_report_sink_writes_json_and_health_lines(spark, tmp_path):
    cols = ["app_cpu", "db_cpu", "redis_cpu"]
    values = {t: {c: 20.0 if t < 30 else 80.0 for c in cols} for t in range(45)}
    values[99] = {c: 0.0 for c in cols}
    samples(spark, str(tmp_path / "in"), values)
    grid = live.stream_grid(live.stream_samples(spark, str(tmp_path / "in")), cols)
    errors = live.window_errors([(20., 10.)] * 3, [(0., 1.)] * 6, np.zeros_like)
    ticks = live.stream_windows(grid, cols, errors, [[0, 3], [1, 4], [2, 5]], threshold=.4)
    live.write_reports(ticks, feature_names(cols), .4, str(tmp_path / "rep"), str(tmp_path / "ckpt"), available_now=True).awaitTermination()
    got = rows(spark.read.schema("series_id string, ts timestamp, anomaly boolean, line string").json(str(tmp_path / "rep")), "ts")
    assert got.anomaly.any() and not got.anomaly.all()
    body = json.loads(got[got.anomaly].line.iloc[0])
    assert body["primary_cause"]["feature"].startswith("CPUUtil") and body["severity"] in ("LOW", "MEDIUM", "HIGH")
    assert got[~got.anomaly].line.str.endswith("HEALTHY").all()


def test_late_samples_inside_the_lateness_count(spark, tmp_path):
    slots = {0: {"m": 1.0}, 30: {"m": 1.0}}
    samples(spark, str(tmp_path / "in"), slots)
    samples(spark, str(tmp_path / "in"), {20: {"m": 7.0}, 1: {"m": 9.0}, 99: {"m": 0.0}})
    grid = live.stream_grid(live.stream_samples(spark, str(tmp_path / "in"), max_files=1), ["m"])
    got = rows(live.run_to_table(grid, str(tmp_path / "out"), str(tmp_path / "ckpt")), "ts")
    assert at("10:03:20") in list(got.ts)


def test_late_rows_beyond_the_lateness_are_dropped_and_a_mark_closes(spark, tmp_path):
    """Three runs of one query: what arrives, then a row inside and one beyond 160 seconds, then the closing mark."""
    def run():
        grid = live.stream_grid(live.stream_samples(spark, str(tmp_path / "in")), ["m"])
        return rows(live.run_to_table(grid, str(tmp_path / "out"), str(tmp_path / "ckpt")), "ts")
    path = str(tmp_path / "in")
    samples(spark, path, {t: {"m": 1.0} for t in range(40)})
    first = run()
    assert len(first) < 40 and first.m.eq(1.0).all()
    samples(spark, path, {38: {"m": 7.0}, 5: {"m": 9.0}, 3: {"m": 9.0}})
    run()
    live.write_closing_mark(spark, path, SAMPLE, (at("10:00:00") + pd.Timedelta(seconds=399)).to_pydatetime())
    got = run()
    assert len(got) == 40 and list(got.m) == [7.0 if t == 38 else 1.0 for t in range(40)]


def labelled_rows(spark, n=120, series=2):
    rng = np.random.default_rng(4)
    data = [(s, at("10:00:00") + pd.Timedelta(seconds=10 * i), *map(float, np.round(rng.gamma(2, 10, 3), 2)), int(i % 40 > 36), "F1" if i % 40 > 36 else "HEALTHY")
            for s in range(series) for i in range(n)]
    return frame(spark, data, "series_id long, ts timestamp, app_cpu double, db_cpu double, redis_cpu double, ground_truth int, fault_type string")


COLS, NODES = ["app_cpu", "db_cpu", "redis_cpu"], [[0, 3], [1, 4], [2, 5]]


@pytest.mark.parametrize("kind", ["mean", "pca"])
def test_bundle_scores_batch_windows_as_the_live_job_does(spark, tmp_path, kind):
    data = labelled_rows(spark)
    made = bundle.fit_bundle(data, COLS, NODES, kind=kind, k=4)
    folder = str(tmp_path / "b")
    assert bundle.current_version(spark, folder) is None
    bundle.publish(spark, made, folder)
    kept = bundle.load_bundle(spark, folder)
    assert kept == made and kept.threshold > 0
    scored = rows(bundle.score_raw_windows(seq.sliding_windows(data, COLS), kept), "series_id", "win_id")
    raw = np.array([[list(r) for r in w] for w in scored.win])
    err = kept.errors(raw)
    assert np.allclose(err, np.array([list(e) for e in scored.err]))
    nodes = np.stack([err[:, i].mean(1) for i in NODES], 1)
    assert np.allclose(scored.score, .7 * nodes.max(1) + .3 * nodes.mean(1))
    assert np.isclose(kept.threshold, np.percentile(scored.score[scored.y == 0], 85))


def test_bundle_fit_sees_training_rows_only_and_is_reused_for_equal_settings(spark, tmp_path):
    data, folder = labelled_rows(spark), str(tmp_path / "b")
    train = F.col("ts") < F.lit(at("10:10:00").to_pydatetime())
    spoiled = data.withColumn("app_cpu", F.when(train, F.col("app_cpu")).otherwise(1e6))
    one, two = (bundle.fit_bundle(d, COLS, NODES, train=train) for d in (data, spoiled))
    assert one == two
    first = bundle.load_or_fit_bundle(data, folder, COLS, NODES)
    version = bundle.current_version(spark, folder)
    assert bundle.load_or_fit_bundle(spoiled, folder, COLS, NODES) == first and bundle.current_version(spark, folder) == version
    other = bundle.load_or_fit_bundle(data, folder, COLS, NODES, kind="pca", k=2)
    assert other.kind == "pca" and bundle.current_version(spark, folder) != version
    assert bundle.load_bundle(spark, folder, version) == first


def test_a_live_query_takes_a_new_version_over_and_keeps_its_state(spark, tmp_path):
    data, folder = labelled_rows(spark, 60, 1), str(tmp_path / "b")
    made = bundle.fit_bundle(data, COLS, NODES)
    bundle.publish(spark, made, folder)
    values = {t: {c: 20.0 + t for c in COLS} for t in range(90)}
    samples(spark, str(tmp_path / "in"), {t: v for t, v in values.items() if t < 60})
    seen = []

    def start(now):
        seen.append(now.threshold)
        grid = live.stream_grid(live.stream_samples(spark, str(tmp_path / "in")), COLS)
        ticks = live.stream_windows(grid, COLS, now.errors, now.nodes, now.threshold)
        return (ticks.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt"))
                .outputMode("append").trigger(availableNow=True).start())
    bundle.follow(spark, folder, start, 60)
    bundle.publish(spark, bundle.Bundle(**{**made.__dict__, "threshold": 1e9}), folder)
    samples(spark, str(tmp_path / "in"), {t: v for t, v in values.items() if t >= 60})
    live.write_closing_mark(spark, str(tmp_path / "in"), SAMPLE, (at("10:00:00") + pd.Timedelta(seconds=899)).to_pydatetime())
    bundle.follow(spark, folder, start, 60)
    got = rows(spark.read.parquet(str(tmp_path / "out")), "ts")
    assert seen == [made.threshold, 1e9]
    assert list(got.tick) == list(range(5, 81)) and not got.anomaly.iloc[-20:].any()


def test_window_scope_starts_every_window_without_change(spark):
    data = labelled_rows(spark, 30, 1)
    got = rows(seq.delta(data, COLS, scope="window"), "win_id")
    values = data.orderBy("ts").toPandas()[COLS].to_numpy()
    for i, d in enumerate(got.delta):
        win = values[i:i + 10]
        assert np.allclose(np.array([list(r) for r in d]), np.diff(win, axis=0, prepend=win[:1]))
    assert len(got) == 21


def test_change_on_a_grid_equals_change_of_any_rows(spark):
    data = labelled_rows(spark, 100, 2)
    one, two = (rows(seq.delta(data, COLS, **kw), "series_id", "ts") for kw in ({}, {"step": 10}))
    assert np.allclose(one[[c + "_delta" for c in COLS]], two[[c + "_delta" for c in COLS]]) and len(one) == 200
