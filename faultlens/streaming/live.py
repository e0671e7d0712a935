"""Live detection: samples → grid → windows and alarm state → reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from faultlens.functions.numeric import floor_ts
from faultlens.operators.rootcause import report
from faultlens.schemas import CLIP, SAMPLE, STEP_SECONDS, WINDOW_ROWS

# Fixed values of the live loop: smoothing, warm-up ticks, poll cadence, how late a sample may come.
SMOOTH, WARMUP = 3, 5
POLL = "8 seconds"
LATENESS = "160 seconds"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_samples(spark: SparkSession, path: str, schema: T.StructType = SAMPLE, fmt: str = "parquet",
                   glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Unbounded source over a folder that receives sample files."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_grid(samples: DataFrame, metrics: list[str], step: int = STEP_SECONDS, lateness: str = LATENESS,
                keys: list[str] = ["series_id"]) -> DataFrame:
    """One wide row per series and step: the largest value per metric over all label sets.

    A step is final once the watermark has passed it; samples later than that are dropped. Rows without a metric, such as a
    closing mark, move the watermark and give no step.
    """
    wide = (samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
            .groupBy(*keys, F.window("ts", f"{step} seconds"))
            .agg(*[F.max(F.when(F.col("metric") == m, F.col("val"))).alias(m) for m in metrics], F.count("metric").alias("_samples")))
    return wide.where("_samples > 0").select(*keys, F.col("window.start").alias("ts"), *metrics)


def write_closing_mark(spark: SparkSession, path: str, schema: T.StructType, last: dt.datetime, step: int = STEP_SECONDS,
                       lateness: str = LATENESS, ts: str = "ts") -> None:
    """End a back-fill: add a row to the source's folder that has a time only, late enough to make every step up to ``last`` final.

    Without it the steps inside the lateness stay open, as they must while a source goes on. Samples up to ``last`` that
    arrive after the mark was read are late.
    """
    seconds = int(lateness.split()[0]) * {"second": 1, "minute": 60, "hour": 3600}[lateness.split()[1].rstrip("s")]
    row = {f.name: None for f in schema} | {ts: last + dt.timedelta(seconds=step + seconds + 1)}
    open_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    spark.createDataFrame([tuple(row[f.name] for f in schema)], open_schema).write.mode("append").parquet(path)


class Alarm:
    """State of one series: recent scores, warm-up count, idle offset, alarm flag."""

    def __init__(self, threshold: float, scores=(), ticks: int = 0, offset: float = 0.0, active: bool = False,
                 smooth: int = SMOOTH, warmup: int = WARMUP):
        self.threshold, self.smooth, self.warmup = threshold, smooth, warmup
        self.scores, self.ticks, self.offset, self.active = list(scores), ticks, offset, active

    def tick(self, score: float) -> tuple[float, float, bool] | None:
        """(smoothed, corrected, anomaly), or None while warming up."""
        self.scores = [*self.scores, score][-self.smooth:]
        smoothed = sum(self.scores) / len(self.scores)
        self.ticks += 1
        if self.ticks <= self.warmup:
            self.offset = max(self.offset, smoothed)
            return None
        corrected = max(0.0, (score if self.active else smoothed) - self.offset)
        self.active = corrected >= self.threshold
        return smoothed, corrected, self.active

    def run(self, scores: np.ndarray) -> dict[str, np.ndarray]:
        """``tick`` for many scores in their order: the columns of those after the warm-up, all of one length."""
        line, before = [*self.scores, *scores.tolist()], len(self.scores)
        lasts = (line[max(0, end - self.smooth):end] for end in range(before + 1, len(line) + 1))
        smoothed, early = np.array([sum(last) / len(last) for last in lasts], dtype=float), min(max(0, self.warmup - self.ticks), len(scores))
        for value in smoothed[:early].tolist():
            self.offset = max(self.offset, value)
        first, self.ticks = self.ticks + early, self.ticks + len(scores)
        self.scores = line[-self.smooth:]
        above = lambda x: np.where(x - self.offset > 0, x - self.offset, 0.0)
        calm, alarmed, was = above(smoothed[early:]), above(scores[early:]), []
        for rise, hold in zip((calm >= self.threshold).tolist(), (alarmed >= self.threshold).tolist()):
            was.append(self.active)
            self.active = hold if self.active else rise
        corrected = np.where(np.array(was, dtype=bool), alarmed, calm)
        return {"tick": np.arange(first, self.ticks), "score": scores[early:], "smoothed": smoothed[early:], "offset": np.full(len(corrected), self.offset),
                "corrected": corrected, "anomaly": corrected >= self.threshold}


_ALARM_FIELDS = "scores array<double>, ticks int, offset double, active boolean"
_OUT_FIELDS = "tick bigint, score double, smoothed double, offset double, corrected double, anomaly boolean"


class ScoreSentinel(StatefulProcessor):
    """Alarm state over a stream of finished scores; a batch's scores of a series are kept as numbers and put in order."""

    def __init__(self, threshold: float, name: str = "series_id"):
        self.threshold, self.name = threshold, name

    def init(self, handle) -> None:
        self.state = handle.getValueState("alarm", _ALARM_FIELDS + ", last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times, scores = zip(*((part["ts"].astype("datetime64[ns]").to_numpy(), part["score"].to_numpy(dtype=float)) for part in rows))
        times, scores = np.concatenate(times), np.concatenate(scores)
        kept = self.state.get() if self.state.exists() else ([], 0, 0.0, False, -2**62)
        alarm, last = Alarm(self.threshold, *kept[:4]), kept[4]
        order = np.argsort(times, kind="stable")
        out = []
        for ts, score in zip(times[order], scores[order].tolist()):
            if int(ts.astype(np.int64)) <= last:
                continue
            last = int(ts.astype(np.int64))
            hit = alarm.tick(score)
            if hit:
                out.append((key[0], pd.Timestamp(ts), alarm.ticks - 1, score, hit[0], alarm.offset, hit[1], hit[2]))
        self.state.update((alarm.scores, alarm.ticks, alarm.offset, alarm.active, last))
        yield pd.DataFrame(out, columns=[self.name, "ts", "tick", "score", "smoothed", "offset", "corrected", "anomaly"])

    def close(self) -> None:
        pass


def stream_sentinel(scores: DataFrame, threshold: float, key: str = "series_id") -> DataFrame:
    """Ticks after warm-up with the smoothed and corrected score and the alarm flag."""
    kind = scores.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, ts timestamp, {_OUT_FIELDS}"
    return scores.groupBy(key).transformWithStateInPandas(ScoreSentinel(threshold, key), schema, "Append", "none")


#: Steps of a series that are worked off at once.
BLOCK_STEPS = 4_096


class WindowSentinel(StatefulProcessor):
    """Newest slots of a series with forward fill, their score, and the alarm state, in one state object.

    A slot without a row repeats the values before it and is a tick of its own, as on a dense grid. Slots at or before the
    last one seen are ignored. What arrives for a series in a micro-batch is kept as numbers only and put in order; the dense
    grid is then filled, cut into windows and scored block by block, so a long gap costs time but no memory.
    """

    def __init__(self, cols: list[str], score_errors: Callable[[np.ndarray], np.ndarray],
                 node_slices: list[list[int]], threshold: float, step: int, size: int, name: str = "series_id"):
        self.cols, self.score_errors, self.slices, self.name = cols, score_errors, node_slices, name
        self.threshold, self.step, self.size = threshold, step, size

    def init(self, handle) -> None:
        self.state = handle.getValueState("window", _ALARM_FIELDS + ", last bigint, cells array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slots, values = [], []
        for part in rows:
            # Nanoseconds, whatever the unit of the column.
            slots.append(part["ts"].astype("datetime64[ns]").to_numpy().astype(np.int64) // (10**9 * self.step))
            values.append(part[self.cols].to_numpy(dtype=float))
        slots, values = np.concatenate(slots), np.concatenate(values)
        width = len(self.cols)
        # The ring holds up to size - 1 rows before the next tick; a new series starts from zeros, which are no tick.
        kept, last, ring, state = [[], 0, 0.0, False], None, np.empty((0, width)), self.state.get()
        if state is not None:
            *kept, last, cells = state
            ring = np.array(cells, dtype=float).reshape(-1, width)
            values, slots = values[slots > last], slots[slots > last]
        alarm = Alarm(self.threshold, *kept)
        if len(slots):
            order = np.argsort(slots, kind="stable")
            slots, values = slots[order], values[order]
            first, end = (slots[0] if last is None else last + 1), slots[-1] + 1
            for at in range(first, end, BLOCK_STEPS):
                to = min(at + BLOCK_STEPS, end)
                low, high = np.searchsorted(slots, (at, to))
                ring, out = self._block(key, alarm, ring, slots[low:high] - at, values[low:high], at, to - at)
                yield out
            last = int(slots[-1])
        if last is not None:
            self.state.update((alarm.scores, alarm.ticks, alarm.offset, alarm.active, last, ring.ravel().tolist()))

    def _block(self, key, alarm: Alarm, ring: np.ndarray, places: np.ndarray, values: np.ndarray, at: int, count: int):
        """Ticks of ``count`` dense slots from ``at`` on, and the rows that the next block starts from."""
        width = len(self.cols)
        dense = np.full((count, width), np.nan)
        dense[places] = values
        before = ring[-1:] if len(ring) else np.zeros((1, width))
        filled = np.concatenate((before, dense))
        source = np.maximum.accumulate(np.where(np.isnan(filled), 0, np.arange(len(filled))[:, None]), axis=0)
        rows = np.concatenate((ring, np.take_along_axis(filled, source, 0)[1:]))
        out, err = Alarm(self.threshold).run(np.empty(0)), np.empty((0, 0))
        if len(rows) >= self.size:
            windows = np.lib.stride_tricks.sliding_window_view(rows, self.size, axis=0).transpose(0, 2, 1)
            err = self.score_errors(windows)
            nodes = np.stack([err[:, idx].mean(1) for idx in self.slices], 1)
            scores = 0.7 * nodes.max(1) + 0.3 * nodes.mean(1)
            out = alarm.run(scores)
            err = err[len(err) - len(out["tick"]):]
        ts = ((at + count + np.arange(-len(err), 0)) * self.step).astype("datetime64[s]").astype("datetime64[ns]")
        # Lists as Arrow holds them: no Python object is made for each tick.
        cells = pa.ListArray.from_arrays(np.arange(len(err) + 1, dtype=np.int32) * err.shape[1], pa.array(err.ravel()))
        ticks = pd.DataFrame({self.name: pd.Series([key[0]] * len(err), dtype=object if not len(err) else None), "ts": ts, **out,
                              "err": pd.Series(pd.arrays.ArrowExtensionArray(cells))})
        return rows[-(self.size - 1):] if self.size > 1 else rows[:0], ticks

    def close(self) -> None:
        pass


def stream_windows(grid: DataFrame, cols: list[str], score_errors: Callable[[np.ndarray], np.ndarray],
                   node_slices: list[list[int]], threshold: float, step: int = STEP_SECONDS,
                   size: int = WINDOW_ROWS, key: str = "series_id") -> DataFrame:
    """Ticks with the error per feature; nothing until a series has ``size`` slots and has warmed up.

    ``score_errors`` takes many windows at once, (windows, size, columns), and gives (windows, inputs).
    """
    kind = grid.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, ts timestamp, {_OUT_FIELDS}, err array<double>"
    processor = WindowSentinel(cols, score_errors, node_slices, threshold, step, size, key)
    return grid.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "none")


def window_errors(level: list[tuple[float, float]], combined: list[tuple[float, float]],
                  reconstruct: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Error per input of raw windows (…, size, columns): two-pass scaling inside each window, then the model.

    ``level`` and ``combined`` are (mean, scale) per column of the fitted scalers.
    """
    m1, s1 = (np.array(v) for v in zip(*level))
    m2, s2 = (np.array(v) for v in zip(*combined))

    def errors(raw: np.ndarray) -> np.ndarray:
        z = np.nan_to_num(np.clip((raw - m1) / s1, -CLIP, CLIP), nan=0.0)
        both = np.concatenate((z, np.diff(z, axis=-2, prepend=z[..., :1, :])), axis=-1)
        x = np.nan_to_num(np.clip((both - m2) / s2, -CLIP, CLIP), nan=0.0)
        return ((x - reconstruct(x)) ** 2).mean(axis=-2)

    return errors


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def stream_reports(ticks: DataFrame, names: list[str], threshold: float, key: str = "series_id") -> DataFrame:
    """Report text while anomalous, a health line otherwise. Works on a batch of ticks."""
    done = report(ticks.withColumn("tick_score", F.col("corrected")), names, F.lit(float(threshold)),
                  score="corrected", keys=[key, "anomaly", "corrected", "offset"])
    line = F.format_string("[%s] Score: %.4f | IDLE_H: %.3f | HEALTHY", F.date_format("ts", "HH:mm:ss"), "corrected", "offset")
    return done.select(key, "ts", "anomaly", F.when(F.col("anomaly"), F.col("report")).otherwise(line).alias("line"))


def write_reports(ticks: DataFrame, names: list[str], threshold: float, path: str, checkpoint: str,
                  key: str = "series_id", available_now: bool = False, compression: str = "none") -> StreamingQuery:
    """Sink: one folder of report lines per micro-batch, overwritten if the batch is run again."""
    def emit(batch: DataFrame, batch_id: int) -> None:
        stream_reports(batch, names, threshold, key).write.mode("overwrite").json(f"{path}/batch={batch_id}", compression=compression)

    writer = ticks.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=POLL)
    return writer.start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything that is there now into Parquet files and read them back."""
    query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def slot_column(ts: str = "ts", step: int = STEP_SECONDS) -> Column:
    return floor_ts(F.col(ts), step)
