"""Intervals, labels, runs."""


from faultlens.bindings.base import (DEFAULT, EV, FE, HOUR, IV, LABELLED, PAD, fault_events, grid, intervals,
                                     labelled, query, with_)
from faultlens.operators import intervals as iv
from faultlens.operators import sequence as seq


@query("c1_pair_intervals", with_(EV, FE, IV) + "SELECT series_id, node, fault_type, st, et, event_seq FROM iv")
def _(spark, sf):
    return intervals(spark, sf)


@query("c1_pair_intervals_by_time", with_(EV, FE) + """SELECT s.series_id, s.node, s.fault_type, s.ts AS st,
  COALESCE((SELECT min(p.ts) FROM fe p WHERE p.state = 'STOP' AND p.series_id = s.series_id AND p.node = s.node AND p.ts >= s.ts) + INTERVAL 3 HOUR,
    CASE WHEN s.duration_s > 0 THEN s.ts + to_microseconds(CAST(trunc((s.duration_s + 10800) * 1e6) AS BIGINT)) ELSE s.ts + INTERVAL 12 HOUR END) AS et, s.event_seq
FROM fe s WHERE s.state = 'START'""")
def _(spark, sf):
    return iv.pair_intervals(fault_events(spark, sf), pad=PAD, default=DEFAULT, order="ts")


@query("c1h_pair_intervals_harvest", with_(EV, FE) + """SELECT s.series_id, s.node, s.fault_type, s.ts AS st,
  COALESCE((SELECT arg_min(p.ts, p.event_seq) FROM fe p WHERE p.state = 'STOP' AND p.series_id = s.series_id AND p.node = s.node AND p.ts >= s.ts) + INTERVAL 3 HOUR,
    s.ts + to_seconds(COALESCE(CAST(trunc(s.duration_s) AS BIGINT), 43200))) AS et, s.event_seq FROM fe s WHERE s.state = 'START'""")
def _(spark, sf):
    return iv.pair_intervals(fault_events(spark, sf), pad=PAD, default=DEFAULT, pad_duration=False, ignore_case=False)


@query("c2_label_rows", with_(*LABELLED) + "SELECT series_id, ts, ground_truth FROM lab")
def _(spark, sf):
    return iv.label_rows(grid(spark, sf), intervals(spark, sf), step=HOUR)


@query("c3_label_fault_type", with_(*LABELLED) + "SELECT series_id, ts, fault_type FROM lab")
def _(spark, sf):
    return iv.label_fault_type(grid(spark, sf), intervals(spark, sf), step=HOUR)


@query("d31_label_coverage", with_(*LABELLED) + """SELECT series_id, count(*) AS n_rows, CAST(sum(n_intervals) AS BIGINT) AS labelled_with_multiplicity,
  CAST(sum(ground_truth) AS BIGINT) AS labelled_rows, round(avg(ground_truth), 6) AS labelled_share, COALESCE(any_value(n), 0) AS n_starts
FROM lab LEFT JOIN (SELECT series_id, count(*) AS n FROM iv GROUP BY 1) USING (series_id) GROUP BY series_id""")
def _(spark, sf):
    return iv.label_coverage(grid(spark, sf), intervals(spark, sf), step=HOUR)


_BLOCKS = """blk AS (SELECT series_id, ts, ground_truth, CAST(sum(c) OVER (PARTITION BY series_id ORDER BY ts) AS BIGINT) AS block FROM
  (SELECT *, CASE WHEN lag(ground_truth) OVER (PARTITION BY series_id ORDER BY ts) IS NOT DISTINCT FROM ground_truth THEN 0 ELSE 1 END AS c FROM lab))"""


@query("e4_islands", with_(*LABELLED, _BLOCKS) + "SELECT * FROM blk")
def _(spark, sf):
    return seq.islands(labelled(spark, sf).select("series_id", "ts", "ground_truth"), "ground_truth")


@query("e5_transitions", with_(*LABELLED, """ch AS (SELECT series_id, ts, ground_truth - lag(ground_truth) OVER (PARTITION BY series_id ORDER BY ts) AS d FROM lab)""",
                               """nr AS (SELECT series_id, ts, d, row_number() OVER (PARTITION BY series_id, d ORDER BY ts) AS k FROM ch WHERE d <> 0)""") +
       """SELECT a.series_id, a.k, a.ts AS start_ts, b.ts AS stop_ts, CAST(epoch(b.ts) - epoch(a.ts) AS BIGINT) AS seconds
FROM nr a JOIN nr b ON a.series_id = b.series_id AND a.k = b.k AND a.d = 1 AND b.d = -1 WHERE a.k <= 5""")
def _(spark, sf):
    return seq.transitions(labelled(spark, sf), first=5)


@query("e7_healthy_prefix", with_(*LABELLED) + """SELECT series_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS r, count(*) OVER (PARTITION BY series_id) AS n
  FROM lab WHERE ground_truth = 0) WHERE r <= floor(n * CAST(0.7 AS DOUBLE))""")
def _(spark, sf):
    return seq.healthy_prefix(labelled(spark, sf)).select("series_id", "ts")


@query("d29_session_summary", with_(EV, FE) + """SELECT series_id, fault_type, n, CAST(sum(n) OVER (PARTITION BY series_id) AS BIGINT) AS total_faults, elapsed_hours FROM
  (SELECT series_id, fault_type, count(*) AS n FROM fe WHERE state = 'START' GROUP BY ALL)
  JOIN (SELECT series_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 3) AS elapsed_hours FROM fe GROUP BY 1) USING (series_id)""")
def _(spark, sf):
    from faultlens.operators.profiling import session_summary
    return session_summary(fault_events(spark, sf))
