"""Findings of the fourth round on the pipeline: near copies meet by their smallest shingles, not as all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from faultlens.llm import common, simhash


def made(spark, sets):
    """Nodes of the given sets, as ``deduplicate`` makes them."""
    rows = [(i, simhash.low_count(len(s), 80), s, simhash.set_fingerprint(s).view(np.int64).tolist()) for i, s in enumerate(sets)]
    return spark.createDataFrame([(i, s[:k].view(np.int64).tolist(), *f) for i, k, s, f in rows], "node long, low array<long>, " + ", ".join(f"{c} long" for c in simhash._PRINT))


def test_smallest_shingles_meet_exactly_the_similar_sets(spark):
    """Groups of near copies, unrelated sets and one shingle that all have, at any size of a tile."""
    draw = np.random.default_rng(3)
    sets = []
    for size in (5, 9, 60, 400):
        for _ in range(4):
            base = draw.integers(1 << 20, 1 << 64, size, dtype=np.uint64)
            for share in (0.0, 0.02, 0.1, 0.5):
                changed = draw.random(size) < share
                sets.append(np.unique(np.append(np.where(changed, draw.integers(1 << 20, 1 << 64, size, dtype=np.uint64), base), np.uint64(7))))
    nodes = made(spark, sets)
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert all(set(sets[a][:simhash.low_count(len(sets[a]), 80)]) & set(sets[b][:simhash.low_count(len(sets[b]), 80)])
               for a in range(len(sets)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8)
    want = sorted(map(tuple, common.components(simhash.near_prints(nodes)).collect()))
    assert want
    for tile in (simhash.LOW_TILE, 3):
        assert sorted(map(tuple, common.components(simhash.near_low(nodes, simhash.shared_low(nodes), tile=tile)).collect())) == want


def test_unrelated_documents_are_not_compared(spark, monkeypatch):
    """All pairs grow with the square of the documents; those without a common shingle never meet."""
    draw = random.Random(1)
    texts = [" ".join(str(draw.randrange(10**6)) for _ in range(30)) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (900, texts[7] + " one"), (901, None), (902, "")], "doc_id long, text string")
    monkeypatch.setattr(simhash, "near_prints", None)
    kept = {r.doc_id for r in simhash.deduplicate(docs).collect()}
    assert kept == {*range(300), 901, 902}
    shared = simhash.shared_low(simhash.shingle_rows(docs.select(F.col("doc_id").alias("id"), F.lit(0).alias("key"), "text").where("doc_id < 300"), 5))
    assert shared.count() == 0
