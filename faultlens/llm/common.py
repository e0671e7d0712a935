"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.session import stage, unstage

#: Words are runs of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows whose results a task holds at once.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_pandas(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """``mapInPandas`` with a function that is made once per task, so that it can hold tables and caches.

    A batch is bounded in bytes by the session and worked off in slices, whose results leave the task one by one.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = make()
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                yield step(batch.iloc[at:at + SLICE])
    return df.mapInPandas(run, schema)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, size: int = SLICE) -> DataFrame:
    """``mapInArrow`` like ``map_pandas``: columns that pass through keep their types and nulls exactly."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                yield step(batch.slice(at, size))
    return df.mapInArrow(run, schema)


def packed(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` in one column ``doc``, so that no name of theirs meets one of an operator; unpacked by ``doc.*``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def schema_of(df: DataFrame, *names: str) -> str:
    """The named columns of a table as a schema text."""
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected links ``(a, b)`` of bigint nodes, as ``(node, root)`` with the smallest node.

    Alternating large-star and small-star steps. Every step is one staged table; minima are aggregated before the
    shuffle and joined from a table of their own, so that adaptive execution can split a hub. Links of a node to
    itself or with a null end are ignored; without links the result is empty.
    """
    def minima(pairs: DataFrame) -> DataFrame:
        return stage(pairs.groupBy("u").agg(F.min("v").alias("m")), "star-min")

    def down(pairs: DataFrame) -> DataFrame:
        return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    spark = edges.sparkSession
    links = stage(down(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null")), "links")
    seen = mark(links)
    while seen[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = minima(both)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = stage(down(large), "large-star")
        unstage(spark, least, links)
        low = minima(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stage(down(small.unionByName(low.select("u", F.col("m").alias("v")))), "small-star")
        unstage(spark, large, low)
        last, seen = seen, mark(links)
        if last == seen:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
