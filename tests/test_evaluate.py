import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultlens.operators import curves, evaluate as ev
from tests.helpers import at, frame, plan, rows

SCORE = "model string, ts timestamp, y int, fault_type string, score double"


def scored(spark, ys, ss, faults=None, model="m"):
    faults = faults or ["F" if y else "HEALTHY" for y in ys]
    return frame(spark, [(model, at("10:00:00") + pd.Timedelta(seconds=10 * i), int(y), f, float(s))
                         for i, (y, s, f) in enumerate(zip(ys, ss, faults))], SCORE)


@pytest.fixture(scope="module")
def messy(spark):
    """Many ties; one model holds most rows."""
    rng = np.random.default_rng(1)
    parts, frames = [], []
    for model, n in (("big", 900), ("small", 60)):
        s = np.round(rng.gamma(2, 1, n), 1)
        y = (rng.random(n) < 0.2 + 0.1 * s / s.max()).astype(int)
        frames.append(pd.DataFrame({"model": model, "y": y, "score": s}))
        parts.append(scored(spark, y, s, model=model))
    return parts[0].unionByName(parts[1]).repartition(6), pd.concat(frames)


@pytest.mark.parametrize("cuts", [[], [0.5], [0.3, 0.7, 1.1, 1.5, 2.0, 2.9, 4.0], None])
def test_percentiles_match_numpy_wherever_the_cuts_lie(messy, cuts):
    df, pdf = messy
    ps = [0, 50, 75, 85, 92, 99.5, 100]
    got = rows(curves.exact_percentiles(df, ["model"], "score", ps, cuts=cuts), "model")
    for r in got.itertuples():
        assert np.allclose(r.values, np.percentile(pdf[pdf.model == r.model].score, ps))


def test_golden_percentiles(spark):
    got = curves.healthy_percentiles(scored(spark, [0] * 4 + [1], [1, 2, 3, 4, 99]), [75, 85, 92])
    assert [round(r.threshold, 6) for r in got.orderBy("rank").collect()] == [3.25, 3.55, 3.76]


@pytest.mark.parametrize("y,s,roc,ap,pr", [
    ((0, 0, 1, 1), (.1, .4, .35, .8), .75, .833333, .791667),
    ((0, 1, 0, 1), (.5, .5, .2, .9), .875, .833333, .916667)])
def test_golden_areas(spark, y, s, roc, ap, pr):
    r = curves.curve_areas(scored(spark, y, s), cuts=[.3, .45]).first()
    assert (round(r.roc_auc, 6), round(r.average_precision, 6), round(r.pr_auc, 6)) == (roc, ap, pr)


def test_nan_counts_as_zero_and_infinity_as_the_end(spark):
    ys, inf, nan = (0, 0, 0, 1, 1), float("inf"), float("nan")
    odd, plain = scored(spark, ys, (nan, -inf, 2, inf, nan)), scored(spark, ys, (0, -9, 2, 9, 0))
    assert curves.curve_areas(odd).first() == curves.curve_areas(plain).first()
    got = curves.healthy_percentiles(scored(spark, (0, 0, 0), (nan, 2, 4)), [0, 50, 100])
    assert [r.threshold for r in got.orderBy("rank").collect()] == [0, 2, 4]


def test_areas_do_not_depend_on_cuts_and_mirror(messy):
    df, _ = messy
    base = rows(curves.curve_areas(df), "model")
    for cuts in ([], [1.0], [0.2, 0.4, 2.2, 5.0]):
        again = rows(curves.curve_areas(df, cuts=cuts), "model")
        assert np.allclose(base.iloc[:, 1:].astype(float), again.iloc[:, 1:].astype(float))
    mirrored = rows(curves.roc_auc(df.withColumn("score", -F.col("score"))), "model")
    assert np.allclose(mirrored.roc_auc, 1 - base.roc_auc)


def test_roc_of_one_class_is_zero(spark):
    assert curves.roc_auc(scored(spark, [0, 0], [1, 2])).first().roc_auc == 0.0


def test_no_score_row_reaches_a_window(messy):
    """Windows run over distinct values inside a bucket, or over bucket summaries, never over a whole model."""
    df, _ = messy
    text = plan(curves.curve_points(df, cuts=[1.0, 2.0]))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_sweep_and_calibration(messy):
    df, pdf = messy
    sweep = rows(ev.threshold_sweep(df), "model", "rank")
    for model, part in pdf.groupby("model"):
        f1s = []
        for r in sweep[sweep.model == model].itertuples():
            t = np.percentile(part[part.y == 0].score, r.percentile)
            hit = part.score >= t
            tp, fp, fn = (hit & (part.y == 1)).sum(), (hit & (part.y == 0)).sum(), (~hit & (part.y == 1)).sum()
            assert (r.tp, r.fp, r.fn) == (tp, fp, fn) and np.isclose(r.f1, 2 * tp / (2 * tp + fp + fn))
            f1s.append(r.f1)
        best = rows(ev.best_of_sweep(ev.threshold_sweep(df)), "model").set_index("model").loc[model]
        assert best.percentile == ev.SWEEP[int(np.argmax(f1s))]


def test_calibration_without_any_hit_is_zero(spark):
    train, test = scored(spark, [0] * 5, [5, 6, 7, 8, 9]), scored(spark, [0, 1], [1, 2])
    r = ev.calibrate(train, test).first()
    assert (r.percentile, r.threshold, r.f1) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("seconds", [20, 50, 10_000])
def test_golden_time_to_detect(spark, seconds):
    y, pred = [0, 1, 1, 1, 0, 0, 1, 1, 0, 1], [0, 0, 0, 1, 0, 1, 1, 0, 0, 0]
    df = scored(spark, y, pred)
    from faultlens.operators.ordered import time_chunk
    blocks = ev.detection_blocks(df, 1.0, chunk=time_chunk("ts", seconds))
    assert list(rows(blocks, "first_pos").latency_s.fillna(-1)) == [20, 0, -1]
    r = ev.summarize_blocks(blocks).first()
    assert (r.n_events, r.n_detected, r.mean_ttd_s, r.median_ttd_s) == (3, 2, 10, 10)


def test_attach_falls_back_to_a_shuffle_join(spark):
    from faultlens.session import attach
    left = spark.range(1000).withColumn("k", F.col("id") % 50)
    dim = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small, large = attach(left, dim, ["k"]), attach(left, dim, ["k"], limit=10)
    assert small.exceptAll(large).count() == 0 and small.count() == large.count() == 1000


def test_histogram_matches_numpy(messy):
    df, pdf = messy
    got = rows(ev.histogram(df, "score", 15, keys=["model"]), "model", "bin")
    for model, part in pdf.groupby("model"):
        mine = got[got.model == model]
        assert mine.n.sum() == len(part) and len(mine) == 15
        assert np.allclose(mine.left_edge, np.histogram_bin_edges(part.score, 15)[:-1])


def test_merged_sketches_are_near_the_exact_percentiles(spark):
    rng, ps = np.random.default_rng(8), [5, 50, 85, 95, 99]
    sizes, score = rng.integers(0, 9, 40_000), np.round(rng.gamma(2, 1, 40_000), 2)
    data = spark.createDataFrame(pd.DataFrame({"model": np.where(sizes < 8, "big", "small"), "day": sizes, "score": score})).repartition(7)
    daily = curves.score_sketches(data, ["model", "day"])
    assert daily.count() == 9
    for r in curves.sketched_percentiles(daily, ps).collect():
        mine = np.sort(score[(sizes < 8) == (r.model == "big")])
        for p, value in zip(ps, r["values"]):
            low, high = np.searchsorted(mine, value, "left") / len(mine), np.searchsorted(mine, value, "right") / len(mine)
            assert low - 0.01 <= p / 100 <= high + 0.01 and value in mine
    bad = frame(spark, [("m", 1.0), ("m", float("nan")), ("m", None), ("n", None)], "model string, score double")
    assert [(r.model, r["values"]) for r in curves.sketched_percentiles(curves.score_sketches(bad), [0, 100]).collect()] == [("m", [0.0, 1.0])]
    assert curves.sketched_percentiles(curves.score_sketches(bad.limit(0)), [50]).count() == 0


def test_calibration_from_sketches_reads_no_training_score(spark, messy):
    df, _ = messy
    healthy = df.where("y = 0")
    sketches = curves.score_sketches(healthy)
    exact, near = (rows(x, "model") for x in (ev.calibrate(healthy, df), ev.calibrate_sketched(sketches, df)))
    assert list(near.model) == list(exact.model) and np.allclose(near.f1, exact.f1, atol=0.05)
