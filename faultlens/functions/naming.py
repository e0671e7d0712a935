"""Display names and guidance texts for nodes and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Node aliases, display names and guidance texts.
NODE_ALIASES = {"mariadb": "db", "nextcloud": "app", "nextcloud_app": "app", "nextclouddb": "db"}
NODE_DISPLAY = {"app": "Nextcloud", "db": "MySQL", "redis": "Redis"}
FEATURE_DISPLAY = {
    "cpu": "CPUUtil",
    "mem": "MemUtil",
    "latency": "Latency",
    "probe_success": "HealthProbe",
    "log_error": "ErrorRate",
    "log_total": "LogVolume",
    "threads": "ActiveThreads",
}
GUIDANCE = {
    "CPUUtil": (
        "Infrastructure - CPU Stress",
        "CPU pressure is elevated in {node}",
        "Inspect CPU saturation, hot requests, and container limits for {node}",
    ),
    "MemUtil": (
        "Infrastructure - Memory Stress",
        "Memory usage is elevated in {node}",
        "Inspect memory growth, cache pressure, and container memory limits for {node}",
    ),
    "Latency": (
        "Service - Latency Degradation",
        "Request latency is elevated around {node}",
        "Inspect upstream dependencies, slow queries, and network latency affecting {node}",
    ),
    "HealthProbe": (
        "Service - Health Check Instability",
        "Health probe behavior is unstable for {node}",
        "Inspect readiness/liveness failures and recent restarts for {node}",
    ),
    "ErrorRate": (
        "Application - Error Spike",
        "Error activity has increased in {node}",
        "Inspect recent exceptions, stack traces, and failing requests in {node}",
    ),
    "LogVolume": (
        "Application - Log Surge",
        "Log volume has surged in {node}",
        "Inspect recent deployments, noisy retries, and repeated warnings in {node}",
    ),
    "ActiveThreads": (
        "Database - Connection Pressure",
        "Thread or connection pressure is elevated in {node}",
        "Inspect connection pools, blocked queries, and thread growth in {node}",
    ),
}
DEFAULT_GUIDANCE = (
    "Service - Behavioral Anomaly",
    "Abnormal behavior is centered around {node}",
    "Inspect recent metric deviations and dependency health for {node}",
)
VELOCITY_INSIGHT = "Rapid change detected in {feature} for {node}"
VELOCITY_ACTION = "Inspect what changed abruptly in {node} and correlate with recent spikes or drops"
VELOCITY_SUFFIX = " (Velocity)"


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def node_alias(node: Column) -> Column:
    """Trimmed lower-case node name with the old names mapped to the present ones."""
    bare = F.lower(F.trim(node))
    return F.coalesce(lookup(bare, NODE_ALIASES), bare)


def title_case(text: Column) -> Column:
    """Upper-case the first letter after every underscore."""
    return F.replace(F.initcap(F.replace(text, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("_"))


def parse_feature_name(name: Column) -> Column:
    """struct(node, feature) with display names for a column such as ``db_log_error_delta``."""
    head = F.substring_index(name, "_", 1)
    tail = F.substr(name, F.char_length(head) + 2)
    feature = title_case(tail)
    for prefix, shown in FEATURE_DISPLAY.items():
        feature = F.when(tail.startswith(prefix), shown).otherwise(feature)
    return (F.when(name.contains("pad"), F.struct(F.lit("Padding").alias("node"), F.lit("Pad").alias("feature")))
            .when(~name.contains("_"), F.struct(F.lit("Unknown").alias("node"), name.alias("feature")))
            .otherwise(F.struct(F.coalesce(lookup(head, NODE_DISPLAY), title_case(head)).alias("node"),
                                feature.alias("feature"))))


def display_name(name: str, is_delta: bool = False) -> tuple[str, str]:
    """Node and feature to show for a column name, as ``parse_feature_name`` and ``velocity_tag`` give them for a column."""
    def title(text: str) -> str:
        return "_".join(part[:1].upper() + part[1:].lower() for part in text.split("_"))
    head, bar, tail = name.partition("_")
    if "pad" in name:
        node, feature = "Padding", "Pad"
    elif not bar:
        node, feature = "Unknown", name
    else:
        node = NODE_DISPLAY.get(head, title(head))
        feature = next((shown for prefix, shown in reversed(FEATURE_DISPLAY.items()) if tail.startswith(prefix)), title(tail))
    return node, feature + VELOCITY_SUFFIX * is_delta


def velocity_tag(feature: Column, is_delta: Column) -> Column:
    return F.when(is_delta, F.concat(feature, F.lit(VELOCITY_SUFFIX))).otherwise(feature)


def guidance(node: Column, feature: Column) -> Column:
    """struct(anomaly_type, insight, action) for a primary cause."""
    base = F.replace(feature, F.lit(VELOCITY_SUFFIX), F.lit(""))
    known = base.isin(*GUIDANCE)
    moving = known & feature.contains("Velocity")

    def text(i: int) -> Column:
        raw = F.coalesce(lookup(base, {k: v[i] for k, v in GUIDANCE.items()}), F.lit(DEFAULT_GUIDANCE[i]))
        if i == 1:
            raw = F.when(moving, F.replace(F.lit(VELOCITY_INSIGHT), F.lit("{feature}"), base)).otherwise(raw)
        if i == 2:
            raw = F.when(moving, F.lit(VELOCITY_ACTION)).otherwise(raw)
        return F.replace(raw, F.lit("{node}"), node)

    return F.struct(text(0).alias("anomaly_type"), text(1).alias("insight"), text(2).alias("action"))


def node_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NODE_DISPLAY.items()), "node string, node_name string")


def feature_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FEATURE_DISPLAY.items()), "metric string, feature_name string")


def guidance_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in GUIDANCE.items()],
                                 "feature_name string, anomaly_type string, insight string, action string")
