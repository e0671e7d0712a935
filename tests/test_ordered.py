"""Chunked computations must not depend on the chunk size, and must match pandas on one hot series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultlens.operators import ordered as o
from faultlens.operators import sequence as seq
from faultlens.operators.grid import asof_fill
from faultlens.operators.rollup import counter_rate, max_over_time
from faultlens.operators.ordered import time_chunk
from tests.helpers import at, frame, plan, rows

START = pd.Timestamp("2026-01-01")


@pytest.fixture(scope="module")
def series():
    """Two thirds of the rows belong to series 1; time gaps leave chunks empty."""
    rng = np.random.default_rng(3)
    out = []
    for s, n in ((1, 400), (2, 150), (3, 1)):
        at = np.sort(rng.choice(5000, n, replace=False))
        for t in at:
            out.append((s, START + pd.Timedelta(seconds=int(t) * 10), float(rng.integers(0, 50)), int(rng.random() < 0.3)))
    return pd.DataFrame(out, columns=["series_id", "ts", "v", "ground_truth"])


@pytest.fixture(scope="module")
def df(spark, series):
    return frame(spark, series, "series_id int, ts timestamp, v double, ground_truth int").repartition(5)


@pytest.fixture(params=[50, 3_000, 10**7])
def chunk(request, spark):
    return o.time_chunk("ts", request.param)


def test_position(df, series, chunk):
    got = rows(o.with_position(df, ["series_id"], ["ts"], chunk, total="n"), "series_id", "ts")
    assert list(got.pos) == list(series.groupby("series_id").cumcount())
    assert list(got.n) == list(series.groupby("series_id").v.transform("size"))


def test_delta_islands_running_sum(df, series, chunk):
    got = rows(seq.delta(df, ["v"], chunk=chunk), "series_id", "ts")
    assert list(got.v_delta) == list(series.groupby("series_id").v.diff().fillna(0))
    got = rows(seq.islands(df, "ground_truth", chunk=chunk), "series_id", "ts")
    want = series.groupby("series_id").ground_truth.transform(lambda g: (g != g.shift()).cumsum())
    assert list(got.block) == list(want)
    got = rows(o.running_sum(df, ["series_id"], ["ts"], chunk, F.col("v"), "s"), "series_id", "ts")
    assert np.allclose(got.s, series.groupby("series_id").v.cumsum())


def test_windows_and_labels(df, series, chunk):
    typed = df.withColumn("fault_type", F.when(F.col("ground_truth") == 1, F.concat(F.lit("F"), F.col("v").cast("int"))).otherwise("HEALTHY"))
    got = rows(seq.sliding_windows(typed, ["v"], chunk=chunk), "series_id", "ts")
    for s, part in series.groupby("series_id"):
        mine = got[got.series_id == s].reset_index(drop=True)
        assert len(mine) == max(0, len(part) - 9)
        part = part.reset_index(drop=True)
        for i, r in mine.iterrows():
            w = part.iloc[i:i + 10]
            assert [x[0] for x in r.win] == list(w.v) and r.win_id == i and r.y == w.ground_truth.max()
            bad = w[w.ground_truth == 1]
            assert r.fault_type == (f"F{int(bad.v.iloc[0])}" if len(bad) else "HEALTHY")


def test_moving_average_in_tiny_position_chunks(df, series, chunk, monkeypatch):
    got = rows(seq.moving_average(df, 3, "v", chunk=chunk), "series_id", "ts")
    want = series.groupby("series_id").v.rolling(3, min_periods=1).mean().to_numpy()
    assert np.allclose(got.smoothed, want)
    placed = o.with_position(df, ["series_id"], ["ts"], chunk)
    halo = o.halo_by_position(placed, "pos", before=2, size=4)
    assert halo.where("NOT _halo").count() == len(series)
    assert halo.where("_halo").groupBy("series_id", "_chunk").count().agg(F.max("count")).first()[0] == 2


def test_transitions_pair_by_number(spark):
    flags = [1, 0, 0, 1, 1, 0, 1]
    df = frame(spark, [(1, START + pd.Timedelta(days=i), f) for i, f in enumerate(flags)], "series_id int, ts timestamp, ground_truth int")
    got = rows(seq.transitions(df), "k")
    # Row 1 is already anomalous: its end is the first stop, and comes before the first start.
    assert list(got.start_ts) == [START + pd.Timedelta(days=3), START + pd.Timedelta(days=6)]
    assert list(got.stop_ts) == [START + pd.Timedelta(days=1), START + pd.Timedelta(days=5)]
    assert list(got.seconds) == [-2 * 86_400, -86_400]


def test_healthy_prefix_and_tail(df, series, chunk):
    got = rows(seq.healthy_prefix(df, chunk=chunk), "series_id", "ts")
    want = pd.concat([g[g.ground_truth == 0].iloc[:int((g.ground_truth == 0).sum() * 0.7)] for _, g in series.groupby("series_id")])
    assert list(got.ts) == list(want.ts)
    got = rows(seq.tail(df, 10), "series_id", "ts")
    assert list(got.groupby("series_id").size().items()) == [(1, 10), (2, 10)]
    assert list(got[got.series_id == 1].ts) == list(series[series.series_id == 1].ts.tail(10))


def test_asof_fill(spark, df, series, chunk):
    grid = [(s, START + pd.Timedelta(seconds=60 * i)) for s in (1, 2, 4) for i in range(-3, 900)]
    g = frame(spark, grid, "series_id int, ts timestamp").withColumn("metric", F.lit("m"))
    got = rows(asof_fill(df.select("series_id", F.lit("m").alias("metric"), "ts", F.col("v").alias("val")), g, chunk=chunk), "series_id", "ts")
    left = pd.DataFrame(grid, columns=["series_id", "ts"]).sort_values("ts")
    right = series[["series_id", "ts", "v"]].sort_values("ts")
    left.ts, right.ts = left.ts.astype("datetime64[ns]"), right.ts.astype("datetime64[ns]")
    want = pd.merge_asof(left, right.astype({"series_id": "int64"}), on="ts", by="series_id").fillna(0).sort_values(["series_id", "ts"])
    assert list(got.val) == list(want.v)


@pytest.mark.parametrize("width", [60, 700, 10**6])
def test_trailing_range(df, series, width):
    samples = df.select("series_id", F.lit("m").alias("metric"), "ts", F.col("v").alias("val"))
    got = rows(counter_rate(samples, 600, chunk_seconds=width), "series_id", "ts")
    top = rows(max_over_time(samples, 600, chunk_seconds=width), "series_id", "ts")
    want_rate, want_max = [], []
    for _, g in series.groupby("series_id"):
        t, v = g.ts.to_numpy(), g.v.to_numpy()
        for i in range(len(g)):
            j = np.searchsorted(t, t[i] - np.timedelta64(600, "s"))
            rises = [v[k] - v[k - 1] if v[k] >= v[k - 1] else v[k] for k in range(j + 1, i + 1)]
            span = (t[i] - t[j]) / np.timedelta64(1, "s")
            want_rate.append(sum(rises) / span if span else np.nan)
            want_max.append(v[j:i + 1].max())
    assert np.allclose(got.rate.astype(float), want_rate, equal_nan=True)
    assert list(top.max_val) == want_max


def test_grid_is_spread_and_complete(spark):
    bounds = frame(spark, [(1, START, START + pd.Timedelta(seconds=99_990)), (2, START, START)], "series_id int, lo timestamp, hi timestamp")
    grid = o.make_grid(bounds, ["series_id"], 10, chunk_slots=100)
    assert grid.where("series_id = 1").count() == 10_000 and grid.where("series_id = 2").count() == 1
    assert grid.where("series_id = 1").select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("seconds", [10, 70, 10**6])
def test_runs_and_transitions_in_chunks_of_any_size(spark, seconds):
    rng = np.random.default_rng(seconds)
    data = [(s, at("10:00:00") + pd.Timedelta(seconds=10 * i), int(v)) for s in (1, 2, 3) for i, v in enumerate(rng.random(40 * s) > .6)]
    df = frame(spark, data, "series_id int, ts timestamp, ground_truth int")
    got = rows(seq.islands(df, "ground_truth", chunk=time_chunk("ts", seconds)), "series_id", "ts")
    table = pd.DataFrame(data, columns=["series_id", "ts", "v"])
    before = table.groupby("series_id").v.shift()
    want = (before.isna() | (before != table.v)).groupby(table.series_id).cumsum()
    assert list(got.block) == list(want)
    found = rows(seq.transitions(df, chunk=time_chunk("ts", seconds)), "series_id", "k")
    expected = []
    for s, part in table.groupby("series_id"):
        step = part.v.diff()
        ups, downs = list(part.ts[step == 1]), list(part.ts[step == -1])
        expected += [(s, k + 1, a, b, int((b - a).total_seconds())) for k, (a, b) in enumerate(zip(ups, downs))]
    assert [tuple(r) for r in found[["series_id", "k", "start_ts", "stop_ts", "seconds"]].itertuples(index=False)] == expected


def test_runs_take_few_shuffles(spark, tmp_path):
    spark.range(1000).selectExpr("id % 7 as series_id", "timestamp_seconds(id) as ts", "int(id % 3 = 0) as ground_truth").write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    for out in (seq.islands(df, "ground_truth"), seq.transitions(df)):
        text = plan(out)
        assert text.count("Exchange hashpartitioning") <= 6 and "SortAggregate" not in text
