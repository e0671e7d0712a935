"""Findings of the third round on growth: what must be true of the plan, and the same rows as before."""

import numpy as np
import pandas as pd
from helpers import at, frame, rows
from pyspark.sql import functions as F

from faultlens.operators import rootcause as rc
from faultlens.operators import scoring as s
from faultlens.operators.grid import fuse_logs, log_counts, master_grid, reindex_grid
from faultlens.session import prepare


def test_settings_of_wide_rows(spark):
    """A loop of generated code that is longer than the JVM compiles was interpreted: 167 core seconds against 66 for one stage."""
    keys = ["spark.sql.codegen.hugeMethodLimit", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
    given = spark.conf.getAll
    try:
        prepare(spark, wide=True)
        assert [spark.conf.get(k) for k in keys] == ["8000", "8m", "1024"]
    finally:
        for k in keys:
            spark.conf.set(k, given[k]) if k in given else spark.conf.unset(k)


def test_rows_that_grow_are_not_broadcast(spark):
    """Metrics and log counts have as many rows as the grid; a small file must not make them a broadcast."""
    logs = frame(spark, [(1, "app", at("00:00:01"), 0, 3), (1, "db", at("00:00:35"), 1, 5)], "series_id int, node string, ts timestamp, is_error int, msg_len int")
    grid = master_grid(frame(spark, [(1, at("00:00:00")), (1, at("00:00:50"))], "series_id int, ts timestamp"))
    samples = frame(spark, [(1, at("00:00:10"), 2.0)], "series_id int, ts timestamp, v double")
    plan = fuse_logs(reindex_grid(samples, grid), log_counts(logs))
    assert plan.count() == 6
    assert "BroadcastHashJoin" not in plan._jdf.queryExecution().toString()


def test_windowed_error_with_missing_values(spark):
    """Means over the frame skip missing values and keep NaN, at a chunk's edge too, as an average over a window frame does."""
    rng = np.random.default_rng(5)
    a, b = rng.gamma(2, 1, 9000), rng.gamma(2, 1, 9000)
    data = [(1, i, None if i % 7 == 0 else float(a[i]), float("nan") if i == 40 else float(b[i])) for i in range(9000)]
    df = frame(spark, data, "series_id int, ts int, _a double, b double")
    got = rows(s.windowed_error(df, ["_a", "b"], 4, pos="ts"), "win_id")
    x = pd.DataFrame({"a": [r[2] for r in data], "b": b}, dtype=float)
    want_a = x.a.rolling(4, min_periods=1).mean().to_numpy()[3:]
    assert list(got.columns) == ["series_id", "ts", "b", "err", "win_id"] and list(got.win_id) == list(range(8997))
    assert np.allclose([e[0] for e in got.err], want_a)
    assert [i for i, e in enumerate(got.err) if np.isnan(e[1])] == [37, 38, 39, 40]
    nothing = frame(spark, [(1, i, None, 1.0) for i in range(4)], "series_id int, ts int, _a double, b double")
    assert s.windowed_error(nothing, ["_a", "b"], 4, pos="ts").first().err == [None, 1.0]
    assert s.windowed_error(df, ["_a", "b"], 4, pos="ts", keep=["ts"]).columns == ["series_id", "ts", "err", "win_id"]


def test_primary_cause_is_the_first_contributor(spark):
    names = ["app_cpu", "db_cpu", "redis_pad_prom_1", "app_cpu_delta", "db_cpu_delta", "redis_pad_prom_1_delta"]
    errs = [[1.0, 3.0, 9.0, 3.0, 0.5, 0.0], [0.0] * 6, [None, 1.0, 2.0, None, 1.0, 0.0], [None] * 6, [float("nan"), 1.0, 2.0, 1.0, 1.0, 0.0]]
    df = frame(spark, [(1, i, e) for i, e in enumerate(errs)], "series_id int, win_id int, err array<double>")
    first = rc.top_contributors(df, names).where("rank = 1").drop("rank")
    cause = rc.primary_cause(df, names)
    assert rows(first, "win_id").astype(str).equals(rows(cause, "win_id").astype(str))
    assert "lambdafunction" not in cause._jdf.queryExecution().analyzed().toString()
