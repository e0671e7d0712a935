import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultlens.operators import intervals as iv
from faultlens.operators.grid import master_grid
from tests.helpers import at, frame, plan, rows

EVENTS = "series_id int, event_seq bigint, ts timestamp, node string, fault_type string, state string, duration_s double"


@pytest.fixture(scope="module")
def golden(spark):
    events = frame(spark, [
        (1, 1, at("10:00:00"), "app", "CPU", "START", 60.0),
        (1, 2, at("10:00:50"), "db", "net ", "start", 60.0),
        (1, 3, at("10:01:00"), "app", "MEM", "STOP", None),
        (1, 4, at("10:02:00"), "redis", "MEM", "START", None)], EVENTS)
    bounds = frame(spark, [(1, at("10:00:00")), (1, at("10:04:50"))], "series_id int, ts timestamp")
    return events, master_grid(bounds)


def test_intervals_of_the_golden_events(golden):
    events, _ = golden
    got = rows(iv.pair_intervals(events), "event_seq")
    assert list(got.fault_type) == ["CPU", "NET", "MEM"]
    assert list(got.et) == [at("10:01:30"), at("10:02:20"), at("10:04:00")]


def test_harvest_rule_has_no_pad_and_keeps_zero(golden, spark):
    events, _ = golden
    upper = events.withColumn("state", F.upper("state"))
    got = rows(iv.pair_intervals(upper, pad_duration=False, ignore_case=False), "event_seq")
    assert got.et[1] == at("10:01:50")
    zero = frame(spark, [(1, 1, at("10:00:00"), "app", "X", "START", 0.0), (1, 2, at("10:00:00"), "db", "X", "START", 7.9)], EVENTS)
    got = rows(iv.pair_intervals(zero, pad_duration=False), "event_seq")
    assert list(got.et) == [at("10:00:00"), at("10:00:07")]


def test_labels_of_the_golden_events(golden):
    events, grid = golden
    got = rows(iv.label(grid, iv.pair_intervals(events)), "ts").set_index("ts")
    assert len(got) == 30 and got.ground_truth.sum() == 25 and got.n_intervals.sum() == 33
    assert got.fault_type[at("10:01:00")] == "NET"
    assert got.fault_type[at("10:04:10")] == "HEALTHY"


def test_file_order_and_time_order_differ(spark):
    events = frame(spark, [(1, 1, at("10:00:00"), "app", "A", "START", None), (1, 2, at("10:05:00"), "app", "A", "STOP", None),
                           (1, 3, at("10:01:00"), "app", "A", "STOP", None)], EVENTS)
    assert rows(iv.pair_intervals(events)).et[0] == at("10:05:30")
    assert rows(iv.pair_intervals(events, order="ts")).et[0] == at("10:01:30")


def test_labels_match_brute_force_at_any_block_size(spark):
    rng = random.Random(5)
    base = at("00:00:00")
    spans = []
    for seq in range(60):
        lo = rng.randrange(0, 4000)
        spans.append((rng.randrange(2), "app", f"F{seq % 7}", base + pd.Timedelta(seconds=lo + rng.random() * 9),
                      base + pd.Timedelta(seconds=lo + rng.choice([-5, 0, 3, 40, 700, 3000]) + rng.random() * 9), seq))
    grid = [(s, base + pd.Timedelta(seconds=10 * i)) for s in range(2) for i in range(500)]
    ivs = frame(spark, spans, "series_id int, node string, fault_type string, st timestamp, et timestamp, event_seq bigint")
    g = frame(spark, grid, "series_id int, ts timestamp")
    want = []
    for s, ts in sorted(grid):
        hit = [x for x in spans if x[0] == s and x[3] <= ts <= x[4]]
        want.append((len(hit), max(hit, key=lambda x: x[5])[2] if hit else "HEALTHY"))
    for block in (1, 4, 16, 256):
        got = rows(iv.label(g, ivs, block=block), "series_id", "ts")
        assert list(zip(got.n_intervals, got.fault_type)) == want


def test_pairing_matches_brute_force_with_one_hot_node_in_small_chunks(spark):
    rng = random.Random(9)
    base = at("00:00:00")
    events = [(1, i, base + pd.Timedelta(seconds=10 * rng.randrange(2000)), rng.choice(["app"] * 8 + ["db"]), "X",
               rng.choice(["START", "STOP"]), None) for i in range(400)]
    df = frame(spark, events, EVENTS)
    for order in ("event_seq", "ts"):
        got = rows(iv.pair_intervals(df, order=order, chunk=F.floor(F.unix_seconds("ts") / F.lit(300))), "event_seq")
        pick = (lambda s: (s[1], s[2])) if order == "event_seq" else (lambda s: (s[2], s[1]))
        for r in got.itertuples():
            stops = [e for e in events if e[5] == "STOP" and e[3] == r.node and e[2] >= r.st]
            end = min(stops, key=pick)[2] + pd.Timedelta(seconds=30) if stops else r.st + pd.Timedelta(seconds=120)
            assert r.et == end


def test_labelling_plans_no_nested_loop_and_no_window_over_grid_rows(golden):
    events, grid = golden
    text = plan(iv.label(grid, iv.pair_intervals(events)))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_more_intervals_never_remove_a_label(golden):
    events, grid = golden
    few = iv.label_rows(grid, iv.pair_intervals(events.where("event_seq < 4")))
    all_ = iv.label_rows(grid, iv.pair_intervals(events))
    both = few.join(all_.withColumnRenamed("ground_truth", "more"), ["series_id", "ts"])
    assert both.where("ground_truth > more").count() == 0


def test_coverage(golden):
    events, grid = golden
    got = iv.label_coverage(grid, iv.pair_intervals(events)).first()
    assert (got.n_rows, got.labelled_with_multiplicity, got.labelled_rows, got.n_starts) == (30, 33, 25, 3)


def test_fuse_takes_raw_events(spark):
    """Old node names and times between the steps: STOP of ``db`` ends the START of ``mariadb``."""
    from faultlens.plans.pipeline import fuse
    metrics = frame(spark, [(1, at("10:00:00") + pd.Timedelta(seconds=10 * i), 1.0) for i in range(20)], "series_id int, ts timestamp, app_cpu double")
    logs = frame(spark, [(1, "app", at("10:00:10"), 0, 5)], "series_id int, node string, ts timestamp, is_error int, msg_len int")
    events = [(1, 1, at("10:00:03"), "mariadb", "CPU", "START", None), (1, 2, at("10:00:33"), "db", "CPU", "STOP", None)]
    got = rows(fuse(metrics, logs, frame(spark, events, EVENTS)), "ts")
    assert list(got.ts[got.ground_truth == 1]) == [at("10:00:00") + pd.Timedelta(seconds=10 * i) for i in range(7)]
    late = [(s, n, ts + pd.Timedelta(days=3), *rest) for s, n, ts, *rest in events]
    moved = rows(fuse(metrics, logs, frame(spark, late, EVENTS), shift_days=True), "ts")
    assert list(moved.ground_truth) == list(got.ground_truth)
