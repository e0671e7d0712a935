"""Findings of the third round on the chain of all models: PCA is fitted in one pass over the windows, all models score in one, with the same values as before."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens.plans import models, pipeline
from faultlens.session import stage
from tests.helpers import frame, plan, rows
from tests.test_scoring import chain_rows


def windows_of(spark, n=40, steps=5, width=6, offset=0.0):
    x = np.random.default_rng(7).normal(size=(n, steps, width)) + offset
    return x, frame(spark, [(1, i, i % 2, w.tolist()) for i, w in enumerate(x)], "series_id int, win_id int, y int, win array<array<double>>")


def test_windows_are_read_once_for_all_models(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(pipeline, "stage", lambda df, *a: plans.append(plan(df)) or stage(df, *a))
    pipeline.train_and_score(chain_rows(spark), k=3)
    scored = [p for p in plans if "persistence" in p or "MapInArrow" in p]
    assert len(scored) == 1 and scored[0].count("FileScan") == 1 and "lambda" not in scored[0]
    # Windows hold each row ten times: they go to the models and are not written.
    assert [p for p in plans if "collect_list" in p] == scored


@pytest.mark.parametrize("layout", ["by_node", "contiguous"])
def test_models_of_one_pass_score_as_columns_do(spark, layout):
    x, df = windows_of(spark)
    pca = models.PcaReconstructor.fit(df, k=2)
    kinds = {k: pipeline.reconstruction(df, k, 2) for k in ("mean", "persistence")} | {"pca": pca.rebuild}
    got = rows(models.score_windows(df, xhat=kinds, width=6, layout=layout), "model", "win_id")
    assert list(got.columns) == ["series_id", "win_id", "y", "model", "score"]
    mean = F.array_repeat(F.array(*[F.lit(float(v)) for v in x.mean((0, 1))]), 5)
    before = F.transform("win", lambda _, i: F.get(F.col("win"), F.greatest(i - 1, F.lit(0))))
    for kind, want in (("mean", df.withColumn("recon", mean)), ("persistence", df.withColumn("recon", before)), ("pca", pca.reconstruct(df))):
        want = rows(models.score_windows(want, width=6, layout=layout), "win_id")
        assert np.allclose(got[got.model == kind].score, want.score, rtol=1e-12)


def test_moments_of_windows(spark):
    """In one pass over many tasks, with a common offset that squares of raw cells would not survive."""
    x, df = windows_of(spark, offset=1e7)
    n, mean, cov = models.window_moments(df.repartition(7))
    flat = x.reshape(40, -1)
    assert n == 40 and np.allclose(mean, flat.mean(0), rtol=1e-12) and np.allclose(cov, np.cov(flat.T), atol=1e-6)
    with pytest.raises(ValueError):
        pipeline.reconstruction(df.where("false"), "pca", 2)
    missing = df.withColumn("win", F.when(F.col("win_id") != 3, F.col("win")))
    with pytest.raises(Exception, match="missing"):
        models.window_moments(missing)
