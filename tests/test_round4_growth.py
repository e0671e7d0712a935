"""Findings of the fourth round on the live job, the stored bundle and the chain of all models: fewer and narrower rows move, with the same values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens.operators.grid import asof_fill
from faultlens.operators.sequence import sliding_windows, window_inputs
from faultlens.plans import bundle as b
from faultlens.plans.models import PcaReconstructor, row_mean, score_windows, stratified_split, window_moments
from faultlens.streaming.live import Alarm
from tests.helpers import at, frame, plan, rows


def test_columns_are_filled_together_as_one_by_one(spark):
    draw = np.random.default_rng(2)
    hours = [at("00:00:00") + np.timedelta64(int(h), "h") for h in range(60)]
    grid = frame(spark, [(s, t) for s in (1, 2) for t in hours], "series_id int, ts timestamp")
    wide = frame(spark, [(s, t, *[float(v) if draw.random() < 0.4 else None for v in draw.normal(size=2)]) for s in (1, 2) for t in hours[5::3]],
                 "series_id int, ts timestamp, a double, b double")
    got = rows(asof_fill(wide, grid, ["series_id"], cols=["a", "b"]), "series_id", "ts")
    for c in ("a", "b"):
        one = rows(asof_fill(wide.select("series_id", "ts", F.col(c).alias("val")), grid, ["series_id"]), "series_id", "ts")
        assert len(one) == 120 and one.val.tolist() == got[c].tolist()


@pytest.mark.parametrize("kind", ["mean", "pca"])
def test_raw_windows_score_as_columns_do(spark, kind):
    """The scores in numpy have the values of the column expressions, also for cells that are no number."""
    x = np.random.default_rng(4).normal(size=(50, 6, 3)).tolist()
    x[3][2][1], x[4][0][0], x[5][5][2] = None, float("nan"), float("inf")
    win = frame(spark, [(1, i, w) for i, w in enumerate(x)], "series_id int, win_id int, win array<array<double>>")
    v, _ = np.linalg.qr(np.random.default_rng(5).normal(size=(36, 2)))
    made = b.Bundle(["a", "b", "c"], [(0.1, 2.0), (0.2, 1.5), (0.0, 0.3)], [(0.01 * i, 1 + 0.1 * i) for i in range(6)], [[0, 3], [1, 4], [2, 5]], kind,
                    [0.05 * i for i in range(6)] if kind == "mean" else [0.01] * 36, [] if kind == "mean" else v.tolist(), 1.0, 6)
    scaled = win.withColumn("x", window_inputs(F.col("win"), made.level, made.combined))
    recon = (scaled.withColumn("recon", F.array_repeat(F.array(*[F.lit(m) for m in made.mean]), 6)) if kind == "mean"
             else PcaReconstructor(np.array(made.mean), v).reconstruct(scaled, "x"))
    want = rows(score_windows(recon, "x", width=6), "win_id")
    got = rows(b.score_raw_windows(win, made), "win_id")
    assert list(got.columns) == ["series_id", "win_id", "win", "err", "node_err", "score"]
    for c in ("err", "node_err"):
        assert np.allclose(np.stack(got[c]), np.stack(want[c]), rtol=1e-9)
    assert np.allclose(got.score, want.score, rtol=1e-9)
    few = b.score_raw_windows(win, made, keep=["win_id", "score"])
    assert few.columns == ["win_id", "score"] and "lambda" not in plan(few)


def test_alarm_over_many_scores_is_tick_by_tick():
    draw = np.random.default_rng(6)
    for smooth, warmup in ((3, 5), (1, 0), (4, 2)):
        one, many = (Alarm(0.4, smooth=smooth, warmup=warmup) for _ in range(2))
        for size in (2, 1, 0, 9, 40, 3):
            scores = draw.normal(size=size)
            want = [(one.ticks - 1, s, h[0], one.offset, h[1], h[2]) for s in scores.tolist() for h in [one.tick(s)] if h]
            got = many.run(scores)
            assert list(zip(*[got[c].tolist() for c in ("tick", "score", "smoothed", "offset", "corrected", "anomaly")])) == want
            assert (one.scores, one.ticks, one.offset, one.active) == (many.scores, many.ticks, many.offset, many.active)


def test_fits_of_two_models_share_a_shuffle(spark):
    """The mean row from the query of the moments is that of its own pass, and both read one shuffle."""
    x = np.random.default_rng(8).normal(size=(30, 4))
    df = frame(spark, [(1, i, *r) for i, r in enumerate(x.tolist())], "series_id int, ts int, a double, b double, c double, d double").withColumn("pos", F.col("ts"))
    windows = sliding_windows(df.withColumn("ground_truth", F.lit(0)), ["a", "b", "c", "d"], 5, pos="pos", fault=None)
    n, mean, cov, row = window_moments(windows, rows=True)
    assert n == 26 and np.array_equal(row, row_mean(windows).first()["m"].toArray())
    assert all(np.allclose(p, q) for p, q in zip((mean, cov), window_moments(windows)[1:]))


def test_hashes_do_not_travel(spark):
    out = stratified_split(spark.range(1000).select(F.col("id").alias("win_id"), (F.col("id") % 3 == 0).cast("int").alias("y")))
    assert rows(out.groupBy("y", "part").count(), "y", "part")["count"].tolist() == [200, 466, 100, 234]
    shipped = [line for line in plan(out).splitlines() if "Project" in line and "md5" in line]
    assert shipped and not any("_tag" in line for line in shipped)
