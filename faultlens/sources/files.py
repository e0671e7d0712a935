"""Readers and writers for metric tables, fault events, logs, scores, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultlens.functions.text import (HARVEST_WORDS, PLAIN_STAMP, clean_ts, error_flag, infer_node, msg_len,
                                      parse_line, parse_sim_line, parse_ts_line, section_node)
from faultlens.operators.clean import drop_empty_rows, fill_partial, normalize_ts
from faultlens.operators.ordered import carry_in, inside, with_position
from faultlens.schemas import EVENT_FIELDS, NODES, RANGE_RESPONSE, SCORES, STEP_SECONDS, THRESHOLDS
from faultlens.session import shuffle_partitions

#: Encodings of log files by the hexadecimal byte order mark; files without one are UTF-8.
MARKS = {"FFFE": "UTF-16LE", "FEFF": "UTF-16BE"}
#: Lines behind one header in a written archive.
ARCHIVE_ROWS = 100_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files; large files are read in splits.

    Inside a split, rows come in file order; the split's byte offset orders the splits of a file.
    """
    raw = (spark.read.text(path).select(F.col("_metadata.file_path").alias("file"),
                                        F.col("_metadata.file_block_start").alias("_start"),
                                        F.col("value").alias("line"))
           .withColumn("_id", F.monotonically_increasing_id()))
    return with_position(raw, ["file"], ["_start", "_id"], F.col("_start"), "line_no").drop("_start", "_id")


def read_metrics(spark: SparkSession, path: str, cols: list[str], step: int = STEP_SECONDS, ts: str = "ts",
                 extra: str = "") -> DataFrame:
    """Wide metric CSV with the time in the first column. ``extra`` declares further columns before the metrics."""
    schema = f"{ts} string, " + (extra + ", " if extra else "") + ", ".join(f"`{c}` double" for c in cols)
    return normalize_ts(spark.read.schema(schema).csv(path, header=True), ts, step)


def parse_event_line(line: Column) -> Column:
    """struct of the seven event fields; NULL for a row with more fields. Short rows fill from the left."""
    parts = F.split(line, ",")
    cell = [F.nullif(F.get(parts, F.lit(i)), F.lit("")) for i in range(len(EVENT_FIELDS))]
    return F.when(F.size(parts) <= len(EVENT_FIELDS), F.struct(*[c.alias(n) for c, n in zip(cell, EVENT_FIELDS)]))


def events_from_lines(lines: DataFrame, keys: list[str] = ["file"], order: str = "line_no") -> DataFrame:
    """Fault events of numbered CSV lines: header and too wide rows skipped, rows without a valid time dropped."""
    out = lines.where(F.col(order) > 0).withColumn("e", parse_event_line(F.col("line")))
    return (out.where("e IS NOT NULL")
            .select(*keys, F.col(order).alias("event_seq"), F.try_to_timestamp(F.col("e.timestamp")).alias("ts"),
                    "e.node", "e.fault_type", "e.state", "e.intensity",
                    F.col("e.duration_s").try_cast("double").alias("duration_s"), "e.metadata")
            .where("ts IS NOT NULL"))


def read_fault_events(spark: SparkSession, path: str) -> DataFrame:
    return events_from_lines(read_lines(spark, path))


#: Hexadecimal UTF-16 units one by one: a pair of surrogates or any other character is kept, a surrogate alone is not.
_UNITS = {"UTF-16LE": r"\G(?:(..D[89AB]..D[C-F]|..[0-9A-CEF].|..D[0-7])|..D[89A-F])",
          "UTF-16BE": r"\G(?:(D[89AB]..D[C-F]..|[0-9A-CEF]...|D[0-7]..)|D[89A-F]..)"}


def decode_line(value: Column, encoding: Column) -> Column:
    """Text of the bytes of a line; bytes that are not UTF-8, and half a character or half a pair in UTF-16, go."""
    even = F.hex(F.substring(value, F.lit(1), F.floor(F.length(value) / 2).cast("int") * 2))
    le, be = (F.decode(F.unhex(F.regexp_replace(even, units, "$1")), name) for name, units in _UNITS.items())
    return (F.when(encoding == "UTF-16LE", le).when(encoding == "UTF-16BE", be)
            .otherwise(F.regexp_replace(F.make_valid_utf8(value.cast("string")), "\uFFFD", "")))


def byte_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, _start, _id, raw, encoding, last) of text files: the bytes of every line, found at any cut into splits.

    ``last`` marks what stands behind the last line end of a little-endian file; if that is empty, it is no line.

    Files are cut at each byte LF. A split hands on how many bytes it holds, its first two and its last byte, and how many
    UTF-16 lines begin in it after an even and after an odd number of bytes. From these the encoding, which stands in the first
    two bytes of a file, and the place of each piece in its file follow in one scan. A UTF-16 line begins behind an LF at the place of
    a character; pieces between such places are put together again.
    """
    zero, two = F.lit(bytearray(b"\0")), F.lit(2)
    rows = Window.partitionBy("file", "_start").orderBy("_id")
    raw = (spark.read.option("pathGlobFilter", pattern).option("lineSep", "\n").text(path)
           .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
                   F.col("_metadata.file_size").alias("_size"), F.monotonically_increasing_id().alias("_id"),
                   F.col("value").cast("binary").alias("_raw")))
    pieces = raw.withColumns({
        "_local": F.coalesce(F.sum(F.length("_raw") + 1).over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_head": F.substring("_raw", 1, 1) == zero, "_tail": F.substring("_raw", -1, 1) == zero})
    pieces = pieces.withColumn("_joint", F.coalesce(F.lag("_tail").over(rows), F.lit(False)))
    odd = F.col("_local") % two == 1
    splits = pieces.groupBy("file", "_start").agg(
        F.sum(F.length("_raw") + 1).alias("_bytes"), F.min_by(F.hex(F.substring("_raw", 1, 2)), "_id").alias("_mark"),
        F.max_by("_tail", "_id").alias("_end"), F.max("_size").alias("_full"),
        *[F.count_if(c).alias(n) for n, c in (("_le0", F.col("_head") & odd), ("_le1", F.col("_head") & ~odd),
                                              ("_be0", F.col("_joint") & ~odd), ("_be1", F.col("_joint") & odd))])
    scan = Window.partitionBy("file").orderBy("_start")
    before, whole = scan.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    splits = splits.select("*", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_base"), F.first("_mark").over(scan).alias("_first"),
                           F.coalesce(F.lag("_end").over(scan), F.lit(False)).alias("_behind"))
    off = F.col("_base") % two == 1
    starts = (F.when(F.col("_first") == "FFFE", F.when(off, F.col("_le1")).otherwise(F.col("_le0")))
              .when(F.col("_first") == "FEFF", F.when(off, F.col("_be1")).otherwise(F.col("_be0") + F.col("_behind").cast("int")))
              .otherwise(F.lit(0)))
    encoding = F.coalesce(*[F.when(F.col("_first") == mark, name) for mark, name in MARKS.items()], F.lit("UTF-8"))
    handed = splits.withColumn("_starts", starts).select(
        "file", "_start", "_base", "_behind", encoding.alias("encoding"),
        F.coalesce(F.sum("_starts").over(before), F.lit(0)).alias("_begun"), F.sum("_starts").over(whole).alias("_all"),
        (F.sum("_bytes").over(whole) == F.col("_full")).alias("_closed"))
    out = pieces.join(handed.hint("shuffle_hash"), ["file", "_start"])
    at = F.col("_base") + F.col("_local")
    begins = (F.when(F.col("encoding") == "UTF-16LE", F.col("_head") & (at % two == 1))
              .otherwise((F.col("_joint") | (F.col("_behind") & (F.col("_local") == 0))) & (at % two == 0)))
    plain = out.where("encoding = 'UTF-8'").select("file", "_start", "_id", F.col("_raw").alias("raw"), "encoding", F.lit(False).alias("last"))
    lines = (out.where("encoding <> 'UTF-8'")
             .withColumn("_line", F.col("_begun") + F.sum(begins.cast("int")).over(rows.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy("file", "encoding", "_line", "_all", "_closed").agg(F.sort_array(F.collect_list(F.struct("_start", "_id", "_raw"))).alias("_parts")))
    # Bytes stay as they are in a string that is only put together. An LF that ends the file is no piece, but can belong to a character.
    joined = F.concat_ws("\n", F.transform("_parts", lambda p: p["_raw"].cast("string"))).cast("binary")
    joined = F.when((F.col("encoding") == "UTF-16LE") & (F.col("_line") > 0), F.substring(joined, F.lit(2), F.length(joined))).otherwise(joined)
    lines = lines.select("file", "encoding", "_closed", F.col("_parts")[0]["_start"].alias("_start"), F.col("_parts")[0]["_id"].alias("_id"),
                         joined.alias("raw"), (F.col("_line") == F.col("_all")).alias("_final"), (F.col("_line") > 0).alias("_later"))
    line_end = (F.col("encoding") == "UTF-16BE") & (F.length("raw") % 2 == 1) & (F.substring("raw", -1, 1) == zero)
    whole_raw = F.when(F.col("_final") & F.col("_closed") & ~line_end, F.concat("raw", F.lit(bytearray(b"\n")))).otherwise(F.col("raw"))
    wide = lines.select("file", "_start", "_id", whole_raw.alias("raw"), "encoding", (F.col("_final") & F.col("_later") & (F.col("encoding") == "UTF-16LE")).alias("last"))
    return plain.unionByName(wide)


def read_log_lines(spark: SparkSession, path: str, pattern: str = "*_raw.log") -> DataFrame:
    """(file, line_no, line) of log files, read in splits at every size: UTF-16 by the byte order mark, else UTF-8.

    Lines end with LF, CR LF or CR; NUL characters and the mark are removed. A line end at the end of a file starts no
    further line. The driver opens no file. A file without any LF is one record of its task.
    """
    text = decode_line(F.col("raw"), F.col("encoding"))
    out = byte_lines(spark, path, pattern).withColumn("_text", text).where("NOT (last AND _text = '')")
    out = out.select("file", "_start", "_id", F.posexplode(F.split(F.regexp_replace("_text", r"\r\z", ""), "\r")).alias("_sub", "line"))
    out = with_position(out, ["file"], ["_start", "_id", "_sub"], F.col("_start"), "line_no")
    clean = F.regexp_replace("line", r"\x00", "")
    return out.select("file", "line_no", F.when(F.col("line_no") == 0, F.regexp_replace(clean, "^\uFEFF", "")).otherwise(clean).alias("line"))


def parse_node_lines(lines: DataFrame, hint: Column) -> DataFrame:
    """Structured log lines of per-node files: a node tag in the line wins over the hint; other lines go."""
    keep = [c for c in lines.columns if c not in ("stamp", "node", "message")]
    text = lines.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    return text.select(*keep, F.explode(parse_line(F.col("line"), hint)).alias("p")).select(*keep, "p.*")


def read_node_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all ``<node>_raw.log`` files below a folder: the union of the per-node files."""
    hint = F.regexp_extract("file", r"([A-Za-z0-9]+)_raw\.log$", 1)
    return log_measures(parse_node_lines(read_log_lines(spark, path), hint))


def log_measures(lines: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Add ts, is_error and msg_len to parsed lines; lines without a valid time go."""
    flag = error_flag(F.col("message")) if words is None else error_flag(F.col("message"), words)
    return (lines.withColumn("ts", clean_ts(F.col("stamp"))).where("ts IS NOT NULL")
            .withColumn("is_error", flag).withColumn("msg_len", msg_len(F.col("message"))))


def parse_archive_lines(lines: DataFrame, keys: list[str], order: str, chunk: Column) -> DataFrame:
    """Structured lines of an archive with ``=== NODE ===`` sections.

    The node is the tag in the line, else the latest known header. Before any header, the first stamped line
    decides by its text, for itself and the lines after it.
    """
    text = lines.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).where("line <> ''")
    text = text.withColumns({"_hdr": section_node(F.col("line")), "_is_hdr": F.col("line").startswith("="),
                             "_a": parse_sim_line(F.col("line")), "_b": parse_ts_line(F.col("line")), "_chunk": chunk})
    plain = ~F.col("_is_hdr") & F.col("_a").isNull() & F.col("_b").isNotNull()
    guess = F.when(plain, F.struct(F.col(order), infer_node(F.col("_b.message")).alias("node")))
    known = F.when(F.col("_hdr").isNotNull(), F.struct(F.col(order), F.col("_hdr").alias("node")))
    out = carry_in(text, keys, "_chunk", {"_h": F.max(known), "_g": F.min(guess)},
                   {"_hb": lambda w: F.max("_h").over(w), "_gb": lambda w: F.min("_g").over(w)})
    here = inside(keys, "_chunk", [order])
    section = F.greatest(F.max(known).over(here), F.col("_hb"))
    first = F.least(F.min(guess).over(here), F.col("_gb"))
    out = out.withColumn("_node", F.coalesce(section["node"], first["node"]))
    return (out.where(~F.col("_is_hdr") & (F.col("_a").isNotNull() | F.col("_b").isNotNull()))
            .select(*keys, order, F.coalesce("_a.stamp", "_b.stamp").alias("stamp"), F.coalesce("_a.node", "_node").alias("node"),
                    F.when(F.col("_a").isNotNull(), F.col("_a.message")).otherwise(F.col("_b.message")).alias("message")))


def read_log_archive(spark: SparkSession, path: str) -> DataFrame:
    lines = read_lines(spark, path)
    return log_measures(parse_archive_lines(lines, ["file"], "line_no", F.floor(F.col("line_no") / F.lit(100_000))))


def harvest_impulses(lines: DataFrame, node: Column) -> DataFrame:
    """Harvest form of log lines: (ts, node, is_err, count, len) over the whole line; lines without a stamp go."""
    line = F.col("line")
    return (lines.where(line.rlike(PLAIN_STAMP)).withColumns(
        {"ts": clean_ts(line), "node": node, "is_err": error_flag(line, HARVEST_WORDS), "count": F.lit(1), "len": msg_len(line)})
        .where("ts IS NOT NULL"))


def read_range_json(df: DataFrame, col: str = "json") -> DataFrame:
    """Samples of range-query responses (JSON text); an empty result gives no rows."""
    keep = [c for c in df.columns if c != col]
    return (df.select(*keep, F.from_json(F.col(col), RANGE_RESPONSE).alias("r"))
            .select(*keep, F.posexplode("r.data.result").alias("result_idx", "s"))
            .select(*keep, "result_idx", F.col("s.metric").alias("labels"), F.explode("s.values").alias("v"))
            .select(*keep, "result_idx", "labels",
                    F.timestamp_micros((F.col("v")[0].cast("double") * 1e6).cast("bigint")).alias("ts"),
                    F.col("v")[1].try_cast("double").alias("val")))


def write_scores(scores: DataFrame, path: str) -> None:
    scores.select(*[F.col(f.name).cast(f.dataType) for f in SCORES.fields]).write.mode("errorifexists").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORES).parquet(path)


def write_thresholds(thresholds: DataFrame, path: str) -> None:
    thresholds.select(*[F.col(f.name).cast(f.dataType) for f in THRESHOLDS.fields]).write.mode("errorifexists").json(path)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(THRESHOLDS).json(path)


def write_harvest_table(rows: DataFrame, path: str, metrics: list[str], keys: list[str] = ["series_id"], ts: str = "ts") -> None:
    """Harvest table as CSV in order of time: rows with any metric, gaps as 0, the metrics and ``ground_truth``.

    The parts are ranges of (ts, keys), so the files follow one another in order however many tasks write them.
    """
    kept = fill_partial(drop_empty_rows(rows, metrics), metrics).select(ts, *keys, *metrics, "ground_truth")
    kept = kept.withColumn(ts, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    (kept.repartitionByRange(shuffle_partitions(rows.sparkSession), ts, *keys).sortWithinPartitions(ts, *keys)
     .write.mode("errorifexists").option("header", True).csv(path))


def write_log_archive(lines: DataFrame, path: str, order: list[str], chunk: Column, node: str = "node", line: str = "line",
                      section_rows: int = ARCHIVE_ROWS, nodes: list[str] = NODES) -> None:
    """Archive of log lines in sections, node after node, as text files that ``read_log_archive`` reads back.

    Lines of a node are numbered by ``order`` inside ``chunk`` and cut every ``section_rows`` lines; each part of a section gets the
    node's header, so that a file never begins without one. Parts are dealt in ranges over the tasks and kept whole. Line breaks
    inside a line become blanks, a line that begins with ``=`` gets a blank bar before it so that it is no header; lines of nodes
    outside ``nodes`` come last under their own name, NULL lines and nodes go.
    """
    text = F.regexp_replace(F.col(line), r"[\r\n]+", " ")
    text = F.when(text.rlike(r"^\s*="), F.concat(F.lit("| "), text)).otherwise(text)
    rank = F.coalesce(*[F.when(F.col(node) == n, F.lit(i)) for i, n in enumerate(nodes)], F.lit(len(nodes)))
    known = lines.where(F.col(node).isNotNull() & F.col(line).isNotNull())
    placed = with_position(known, [node], order, chunk, "_pos")
    placed = placed.select(rank.alias("_rank"), F.col(node).alias("_node"), F.floor(F.col("_pos") / F.lit(section_rows)).alias("_part"), "_pos", text.alias("value"))
    bar = "=" * 20
    heads = (placed.where(F.col("_pos") % section_rows == 0).withColumn("_pos", F.lit(-1).cast("bigint"))
             .withColumn("value", F.concat(F.lit(bar + " "), F.upper("_node"), F.lit(" (docker) " + bar))))
    where = ["_rank", "_node", "_part"]
    (placed.unionByName(heads).repartitionByRange(shuffle_partitions(lines.sparkSession), *where).sortWithinPartitions(*where, "_pos")
     .select("value").write.mode("errorifexists").text(path))


def write_datasets(fused: DataFrame, path: str, train: DataFrame, fmt: str = "parquet") -> None:
    """``path/mixed``: all rows; ``path/train``: the healthy training rows without the fault type. By date."""
    for name, df in (("mixed", fused), ("train", train.drop("fault_type"))):
        dated = df.withColumn("date", F.to_date("ts"))
        dated.write.mode("errorifexists").partitionBy("date").format(fmt).option("header", True).save(f"{path}/{name}")
