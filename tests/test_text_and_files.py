import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultlens.functions import text
from faultlens.operators import clean
from faultlens.sources import files
from tests.helpers import at, frame, plan, rows


def test_golden_event_rows(spark, tmp_path):
    (tmp_path / "injection_log.csv").write_text(
        "timestamp,node,fault_type,state,intensity,duration_s,metadata\n"
        "2026-04-06T10:00:00,app,CPU,START,HIGH,60,m\n"
        "2026-04-06T10:00:10,app,CPU,START,HIGH,old\n"
        "2026-04-06T10:00:20,app,CPU,START,HIGH,60,m,extra\n"
        "never,app,CPU,START,HIGH,60,m\n"
        "2026-04-06T10:00:40,db,NET,STOP,900kbps,,\n")
    got = rows(files.read_fault_events(spark, str(tmp_path / "injection_log.csv")), "event_seq")
    assert list(got.event_seq) == [1, 2, 5]
    assert got.duration_s[0] == 60.0 and got.metadata[0] == "m"
    assert pd.isna(got.duration_s[1]) and got.metadata[1] is None
    assert got.node[2] == "db" and pd.isna(got.duration_s[2]) and got.metadata[2] is None


def test_line_numbers_do_not_depend_on_the_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 17) for i in range(3000)]
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        df = files.read_lines(spark, str(tmp_path / "big.txt"))
        got = rows(df, "line_no")
        assert spark.read.text(str(tmp_path / "big.txt")).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert list(got.line) == lines and list(got.line_no) == list(range(3000))


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16", "utf-16-be"])
def test_node_logs_in_each_encoding(spark, tmp_path, encoding):
    body = ("[2026-04-06T10:00:00] [db] hi there\r\n\r\n2026-04-06T10:00:01Z stdout F Timeout ü x\r\nno stamp\r\n"
            "[2026-04-06T10:00:02] [REDIS] bad\x00 ok\r\n")
    data = body.encode(encoding)
    if encoding == "utf-16-be":
        data = b"\xfe\xff" + data
    (tmp_path / "app_raw.log").write_bytes(data)
    (tmp_path / "other.txt").write_text("2026-04-06T10:00:01Z not a node log\n")
    got = rows(files.read_node_logs(spark, str(tmp_path)), "ts")
    assert list(got.node) == ["db", "app", "redis"]
    assert list(got.message) == ["hi there", "Timeout ü x", "bad ok"]
    assert list(got.is_error) == [0, 1, 0] and list(got.msg_len) == [8, 11, 6]


def test_node_logs_do_not_depend_on_encoding_and_splits(spark, tmp_path):
    lines = [f"[2026-04-06T10:{i // 60 % 60:02d}:{i % 60:02d}] [{'DB' if i % 3 else 'APP'}] ü漢 {i} " + "x" * (i % 19) for i in range(900)]
    ends = ["\n", "\r\n", "\r"]
    body = "".join(line + ends[i % 3 if i % 50 == 0 else i % 2] for i, line in enumerate(lines)) + "last\n"
    for name, data in (("a", body.encode()), ("b", b"\xff\xfe" + body.encode("utf-16-le")), ("c", b"\xfe\xff" + body.encode("utf-16-be")),
                       ("d", body.encode().replace(b"last", b"la\xffst")), ("e", b"\xef\xbb\xbf" + body.encode())):
        (tmp_path / f"{name}_raw.log").write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4096", "4097", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = rows(files.read_log_lines(spark, str(tmp_path)), "file", "line_no")
            assert got.file.nunique() == 5
            for _, part in got.groupby("file"):
                assert list(part.line) == lines + ["last"] and list(part.line_no) == list(range(901))
            logs = rows(files.read_node_logs(spark, str(tmp_path)), "file", "line_no")
            assert len(logs) == 4500 and set(logs.node) == {"app", "db"} and logs.message[1] == "ü漢 1 x"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("encoding", ["utf-16-le", "utf-16-be"])
def test_characters_that_hold_the_bytes_of_a_line_end(spark, tmp_path, encoding):
    draw = random.Random(3)
    chars = ["\u0a15", "\u0100", "\u010a", "\u0a00", "\u000d\u000a", "a", "\u0a0a", "\u1200", "\n", "\u0d0a"]
    bodies = ["".join(draw.choices(chars, k=draw.randint(0, 700))) for _ in range(12)] + ["", "\n", "\n\n", "\u0a15\u0100\n", "x\n\u0a15", "\u010a"]
    for nth, body in enumerate(bodies):
        (tmp_path / f"n{nth:02d}_raw.log").write_bytes("\ufeff".encode(encoding) + body.encode(encoding))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("101", "4096"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = rows(files.read_log_lines(spark, str(tmp_path)), "file", "line_no")
            for nth, body in enumerate(bodies):
                expected = body.replace("\r\n", "\n").split("\n")
                expected = expected[:-1] if expected[-1] == "" and len(expected) > 1 else expected
                part = got[got.file.str.endswith(f"n{nth:02d}_raw.log")]
                assert list(part.line) == expected and list(part.line_no) == list(range(len(expected)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_half_a_pair_does_not_stop_the_reader(spark, tmp_path):
    for name, code in (("a", "utf-16-le"), ("b", "utf-16-be")):
        (tmp_path / f"{name}_raw.log").write_bytes("\ufeffa\ud800b\n\udc00\U0001F600c\ud800".encode(code, "surrogatepass"))
    got = rows(files.read_log_lines(spark, str(tmp_path)), "file", "line_no")
    assert list(got.line) == ["ab", "\U0001F600c"] * 2


def test_many_log_files_of_mixed_encodings(spark, tmp_path):
    for nth in range(300):
        (tmp_path / f"{nth}app_raw.log").write_bytes(f"2026-04-06T10:00:01Z stdout F {nth}\n".encode("utf-16" if nth % 3 == 0 else "utf-8"))
    got = files.read_node_logs(spark, str(tmp_path))
    assert "binaryFile" not in plan(got)
    assert sorted(int(r.message) for r in got.select("message").collect()) == list(range(300))


def test_a_utf16_log_is_read_in_splits(spark, tmp_path):
    (tmp_path / "db_raw.log").write_bytes(b"\xff\xfe" + ("2026-04-06T10:00:01Z stdout F ü\n" * 3000).encode("utf-16-le"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        assert spark.read.option("encoding", "UTF-16LE").option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 3
        got = rows(files.read_node_logs(spark, str(tmp_path)), "line_no")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 3000 and set(got.node) == {"db"} and set(got.message) == {"ü"} and set(got.msg_len) == {1}


def test_archive_sections(spark, tmp_path):
    (tmp_path / "raw_logs_harvested.txt").write_text(
        "# Raw Log Archive\n"
        "2026-04-06T10:00:00Z stdout F MySQL ready\n"
        "2026-04-06T10:00:01Z plain text stays with the first guess\n"
        "==== APP (docker) ====\n2026-04-06T10:00:02Z one\n"
        "==== REDIS (raw_logs/redis_raw.log) ====\n2026-04-06T10:00:03Z two\n[2026-04-06T10:00:04] [DB] tagged\n"
        "==== other ====\n2026-04-06T10:00:05Z three\n")
    got = rows(files.read_log_archive(spark, str(tmp_path / "raw_logs_harvested.txt")), "ts")
    assert list(got.node) == ["db", "db", "app", "redis", "db", "redis"]
    assert got.message[0] == "MySQL ready"


def test_log_archive_round_trip(spark, tmp_path):
    draw = random.Random(5)
    given = [(draw.choice(["app", "db", "redis"]), i, f"2026-04-06T{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}Z " +
              draw.choice(["ok", "a\nb", "== DB ==", "x \r\n y"]) + f" {i}") for i in range(2000)]
    given += [("app", 5000, "=== redis 2026-04-06T10:00:00Z none"), ("db", 5001, None), (None, 5002, "2026-04-06T10:00:00Z gone")]
    lines = frame(spark, given, "node string, n int, line string")
    files.write_log_archive(lines, str(tmp_path / "a"), ["n"], F.floor(F.col("n") / 100), section_rows=37)
    parts = sorted(p for p in (tmp_path / "a").iterdir() if p.name.startswith("part") and p.stat().st_size)
    texts = [p.read_text().splitlines() for p in parts]
    assert len(parts) > 1 and all(t[0].startswith("=" * 20) for t in texts)
    seen = [line.split()[1] for t in texts for line in t if line.startswith("=")]
    assert [n for i, n in enumerate(seen) if i == 0 or seen[i - 1] != n] == ["APP", "DB", "REDIS"]
    got = rows(files.read_log_archive(spark, str(tmp_path / "a")))
    clean_text = [(n, " ".join(t.replace("\r", "\n").split("\n")).split(" ", 1)[1]) for n, _, t in given[:2000]]
    flat = lambda pairs: sorted((n, " ".join(m.split())) for n, m in pairs)
    assert flat(zip(got.node, got.message)) == flat(clean_text + [("app", "none")])


def test_harvest_table_is_written_in_order(spark, tmp_path):
    rows_in = [(s, at(f"10:{m:02d}:00"), None if m % 3 == 0 else float(m), 1.5 if m % 2 else None, m % 2) for s in (1, 2) for m in range(40)]
    df = frame(spark, rows_in, "series_id int, ts timestamp, app_cpu double, app_mem double, ground_truth int")
    files.write_harvest_table(df, str(tmp_path / "h"), ["app_cpu", "app_mem"])
    parts = sorted(p for p in (tmp_path / "h").iterdir() if p.name.startswith("part"))
    body = [line for p in parts for line in p.read_text().splitlines()[1:]]
    assert len(parts) > 1 and body == sorted(body)
    got = rows(files.read_metrics(spark, str(tmp_path / "h"), ["app_cpu", "app_mem", "ground_truth"], extra="series_id int"), "ts", "series_id")
    kept = sorted((t, s, c or 0.0, m or 0.0, g) for s, t, c, m, g in rows_in if c is not None or m is not None)
    assert [(r.ts, r.series_id, r.app_cpu, r.app_mem, int(r.ground_truth)) for r in got.itertuples()] == kept


def test_two_vocabularies(spark):
    df = frame(spark, [("a Deadlock",), ("stress test",), ("all fine",)], "t string")
    got = [tuple(r) for r in df.select(text.error_flag(F.col("t")), text.error_flag(F.col("t"), text.HARVEST_WORDS)).collect()]
    assert got == [(0, 1), (1, 0), (0, 0)]


def test_harvest_lines_count_the_whole_line(spark):
    df = frame(spark, [("x 1999-01-02 03:04:05 deadlock",), ("nothing",)], "line string")
    r = files.harvest_impulses(df, F.lit("db")).collect()
    assert len(r) == 1 and (r[0].node, r[0].is_err, r[0].len) == ("db", 1, 30) and r[0].ts.year == 1999


def test_metric_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("ts,app_cpu,app_mem\n2026-04-06 10:00:07+00:00,1.5,\nbad,2,3\n2026-04-06 12:00:19+02:00,4,5\n")
    got = rows(files.read_metrics(spark, str(tmp_path / "m.csv"), ["app_cpu", "app_mem"]), "ts")
    assert list(got.ts) == [at("10:00:00"), at("10:00:10")] and pd.isna(got.app_mem[0])


def test_range_json(spark):
    df = frame(spark, [('{"data":{"result":[{"metric":{"name":"a"},"values":[[1775469600,"1.5"],[1775469610.5,"NaN"]]},{"metric":{},"values":[[1775469600,"x"]]}]}}',),
                       ('{"data":{"result":[]}}',)], "json string")
    got = rows(files.read_range_json(df), "result_idx", "ts")
    assert len(got) == 3 and got.val[0] == 1.5 and pd.isna(got.val[2]) and got.labels[0] == {"name": "a"}
    assert got.ts[1] == at("10:00:10.5")


def test_round_trips(spark, tmp_path):
    scores = frame(spark, [("s", 1, at("10:00:00"), 1, "CPU", "pca", .5)], "series_id string, win_id bigint, ts timestamp, y int, fault_type string, model string, score double")
    files.write_scores(scores, str(tmp_path / "s"))
    assert files.read_scores(spark, str(tmp_path / "s")).exceptAll(scores).count() == 0
    th = frame(spark, [("pca", .1, .2, .3, .4)], "model string, threshold double, mean_val double, p95 double, p99 double")
    files.write_thresholds(th, str(tmp_path / "t"))
    assert files.read_thresholds(spark, str(tmp_path / "t")).exceptAll(th).count() == 0


def test_time_filter_reaches_the_scan(spark, tmp_path):
    frame(spark, [(at("10:00:00"), 1.0), (at("11:00:00"), 2.0)], "ts timestamp, v double").write.parquet(str(tmp_path / "p"))
    df = clean.time_range(spark.read.parquet(str(tmp_path / "p")), "2026-04-06 10:30:00", "2026-04-06 12:00:00")
    assert df.count() == 1 and "GreaterThanOrEqual(ts" in plan(df)


def test_source_matching(spark):
    names = frame(spark, [("proj-app-1", 1), ("redis-exporter", 2), ("My-Redis", 3), ("redis-2", 4)], "name string, seq int")
    nodes = frame(spark, [("app",), ("db",), ("redis",)], "node string")
    got = rows(clean.match_source(names, nodes), "node")
    assert list(got.source) == ["proj-app-1", "db", "My-Redis"]


def test_source_matching_equals_every_pair_without_making_them(spark):
    draw = random.Random(6)
    names = [(draw.choice("kl"), "".join(draw.choice("aAbBc-") for _ in range(draw.randint(0, 9))), i) for i in range(120)] + [("k", None, 120), ("l", "exporter-ab", -1)]
    nodes = [(k, n) for k in "kl" for n in ("a", "ab", "abc", "B", "c-a", "aaaaaaaaaaaaaaaa")]
    got = clean.match_source(frame(spark, names, "key string, name string, seq int"), frame(spark, nodes, "key string, node string"), keys=["key"])
    assert "posexplode" not in plan(got) and "CartesianProduct" not in plan(got) and "NestedLoop" not in plan(got)
    best = {}
    for key, name, seq in names:
        for k, node in nodes:
            if k == key and name and "exporter" not in name.lower() and node in name.lower():
                best[key, node] = min(best.get((key, node), (seq, name)), (seq, name))
    assert {(r.key, r.node): r.source for r in got.collect()} == {(k, n): best.get((k, n), (0, n))[1] for k, n in nodes}
