"""Column layouts of the inputs and of the tables that the operators hand on."""

from pyspark.sql import types as T

# The three nodes, their seven feature slots in model order, and the grid step.
NODES = ["app", "db", "redis"]
STEP_SECONDS = 10
WINDOW_ROWS = 10
CLIP = 6.0
SLOTS = {
    "app": ["app_cpu", "app_mem", "app_latency", "app_probe_success",
            "app_log_error", "app_log_total", "app_log_avg_len"],
    "db": ["db_cpu", "db_mem", "db_threads", "db_pad_prom",
           "db_log_error", "db_log_total", "db_log_avg_len"],
    "redis": ["redis_cpu", "redis_mem", "redis_pad_prom_1", "redis_pad_prom_2",
              "redis_log_error", "redis_log_total", "redis_log_avg_len"],
}
FEATURES = [name for node in NODES for name in SLOTS[node]]
HARVEST_FEATURES = [f"{node}_{kind}" for node in NODES for kind in ("cpu", "mem", "latency", "network")]
LABEL_COLUMNS = ["ground_truth", "fault_type"]
HEALTHY = "HEALTHY"
UNKNOWN = "UNKNOWN"

EVENT_FIELDS = ["timestamp", "node", "fault_type", "state", "intensity", "duration_s", "metadata"]

SAMPLE = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("ts", T.TimestampType()),
    T.StructField("val", T.DoubleType()),
])

RANGE_RESPONSE = ("data STRUCT<result: ARRAY<STRUCT<metric: MAP<STRING,STRING>, "
                  "values: ARRAY<ARRAY<STRING>>>>>")

SCORES = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("win_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("y", T.IntegerType()),
    T.StructField("fault_type", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("score", T.DoubleType()),
])

THRESHOLDS = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("mean_val", T.DoubleType()),
    T.StructField("p95", T.DoubleType()),
    T.StructField("p99", T.DoubleType()),
])
