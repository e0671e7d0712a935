"""Log line parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line patterns and the two error vocabularies.
TAGGED_LINE = r"(?i)^\[(202\d-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})\]\s+\[(APP|DB|REDIS)\]\s+(.*)"
STAMPED_LINE = r"(202\d-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}[^\s]*)\s+(.*)"
STREAM_PREFIX = r"^(stdout|stderr)\s+[FP]\s+"
PLAIN_STAMP = r"(\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2})"
FUSE_WORDS = [
    "error", "fail", "timeout", "refused", "exception", "fatal", "crit",
    "fault_start", "fault_stop", "stress", "oom", "killed", "panic",
]
HARVEST_WORDS = [
    "error", "fail", "crit", "fatal", "exception", "refused", "timeout",
    "deadlock", "reset", "denied", "oom", "panic", "segfault", "abort",
    "connection lost", "too many", "max retries", "unavailable",
]


def parse_sim_line(line: Column) -> Column:
    """``[ts] [NODE] message`` → struct(stamp, node, message), NULL for other lines."""
    return F.when(line.rlike(TAGGED_LINE), F.struct(
        F.regexp_extract(line, TAGGED_LINE, 1).alias("stamp"),
        F.lower(F.regexp_extract(line, TAGGED_LINE, 2)).alias("node"),
        F.regexp_extract(line, TAGGED_LINE, 3).alias("message")))


def parse_ts_line(line: Column) -> Column:
    """First time stamp anywhere in the line and the text after it, NULL without one."""
    return F.when(line.rlike(STAMPED_LINE), F.struct(
        F.regexp_extract(line, STAMPED_LINE, 1).alias("stamp"),
        strip_stream_prefix(F.regexp_extract(line, STAMPED_LINE, 2)).alias("message")))


def parse_line(line: Column, node: Column) -> Column:
    """ARRAY with the one parsed form of a log line - struct(stamp, node, message) - or without any.

    Made for explode: conditions on its result are then not copied down past the parsing.
    """
    tagged, plain = parse_sim_line(line), parse_ts_line(line)
    untagged = F.struct(plain["stamp"].alias("stamp"), node.alias("node"), plain["message"].alias("message"))
    return F.when(line.rlike(TAGGED_LINE), F.array(tagged)).when(line.rlike(STAMPED_LINE), F.array(untagged))


def strip_stream_prefix(message: Column) -> Column:
    return F.regexp_replace(message, STREAM_PREFIX, "")


def clean_ts(stamp: Column) -> Column:
    """Seconds-precise time from a stamp in any of the log formats; NULL when there is no valid time."""
    bare = F.regexp_extract(F.regexp_replace(stamp, r"[\[\]]", ""), PLAIN_STAMP, 1)
    return F.try_to_timestamp(F.regexp_replace(bare, r"[T\s]", " "), F.lit("yyyy-MM-dd HH:mm:ss"))


def infer_node(message: Column) -> Column:
    text = F.lower(message)
    return (F.when(text.contains("redis"), "redis")
            .when(text.contains("maria") | text.contains("mysql"), "db")
            .otherwise("app"))


def section_node(line: Column) -> Column:
    """Node named by an ``=== … ===`` header line; NULL for ordinary lines and unknown headers."""
    text = F.upper(line)
    return F.when(line.startswith("="),
                  F.when(text.contains("APP"), "app")
                  .when(text.contains("DB"), "db")
                  .when(text.contains("REDIS"), "redis"))


def error_flag(text: Column, words: list[str] = FUSE_WORDS) -> Column:
    """1 if any of the words occurs in the text, ignoring case, else 0."""
    return F.lower(text).rlike("|".join(words)).cast("int")


def msg_len(text: Column) -> Column:
    return F.char_length(text)
