"""Consistent-hash ring with virtual nodes and bounded loads.

Keys fall into cells of the ring. Cells carry the bytes of their keys; a cell goes to the first shard clockwise that has
room for it. The ring has a fixed number of cells, so the only thing on the driver is a table of that size.
"""

from __future__ import annotations

import bisect

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.session import stage

SHARDS, VIRTUAL_NODES = 24, 128
#: Cells of the ring: the bound of the table on the driver and of the broadcast.
CELLS = 1 << 16
#: A shard takes at most this share over the mean.
SLACK = 0.002


def place(cells: pd.DataFrame, shards: int, virtual_nodes: int, slack: float) -> pd.DataFrame:
    """Shard of each cell ``(cell, size, rows)`` and the first slot of its rows there.

    Larger cells choose first, so that smaller ones fill what is left. A cell that fits nowhere goes to the emptiest shard.
    """
    points = sorted((xxhash.xxh64_intdigest(f"{s}/{v}", 1) % CELLS, s) for s in range(shards) for v in range(virtual_nodes))
    at = [p for p, _ in points]
    room = [int(cells["size"].sum() / shards * (1 + slack))] * shards
    slots, out = [0] * shards, []
    for cell, size, rows in cells.sort_values(["size", "cell"], ascending=[False, True]).itertuples(index=False):
        start, shard, seen = bisect.bisect_left(at, cell), None, set()
        for step in range(len(points)):
            one = points[(start + step) % len(points)][1]
            if one not in seen:
                seen.add(one)
                if room[one] >= size:
                    shard = one
                    break
                if len(seen) == shards:
                    break
        if shard is None:
            shard = max(range(shards), key=lambda s: (room[s], -s))
        room[shard] -= size
        out.append((cell, shard, slots[shard]))
        slots[shard] += rows
    return pd.DataFrame(out, columns=["cell", "shard", "first_slot"])


def movement(cells: pd.DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, slack: float = SLACK) -> dict[str, float]:
    """Shares of all bytes that one more shard moves: into it (``joined``) and between shards that were there (``between``)."""
    before = place(cells, shards, virtual_nodes, slack).merge(cells, on="cell")
    both = before.merge(place(cells, shards + 1, virtual_nodes, slack), on="cell", suffixes=("", "_grown"))
    total, moved = both["size"].sum(), both[both["shard"] != both["shard_grown"]]
    joined = moved["shard_grown"] == shards
    return {"joined": moved["size"][joined].sum() / total, "between": moved["size"][~joined].sum() / total}


def copy_numbers(rows: DataFrame) -> DataFrame:
    """Adds ``copy``: equal rows, which share ``key``, are numbered from 0 within it; other rows get 0.

    Only rows of repeated keys are numbered. Each part of the table numbers its own, and the counts of the parts before,
    one row per key and part, are added, so that no task holds all copies of a key.
    """
    again = stage(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated")
    some = rows.join(again, "key")
    mine = Window.partitionBy("key", "part").orderBy("doc_id")
    counts = some.groupBy("key", "part").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("key", "part", F.coalesce(ahead, F.lit(0)).alias("first"))
    numbered = (some.withColumn("nth", F.row_number().over(mine) - 1).join(first, ["key", "part"])
                .withColumn("copy", F.col("first") + F.col("nth")).drop("nth", "first"))
    return rows.join(again, "key", "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(numbered)


def cell_table(docs: DataFrame) -> tuple[DataFrame, pd.DataFrame]:
    """Rows ``(doc_id, size, text_crc32, key, copy, cell)`` and the table ``(cell, size, rows)`` of the ring."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                             F.xxhash64("doc_id", text).alias("key"), F.spark_partition_id().alias("part")), "sized")
    out = stage(copy_numbers(rows).drop("part").withColumn("cell", F.pmod(F.xxhash64("key", "copy"), F.lit(CELLS)).cast("int")), "cells")
    return out, out.groupBy("cell").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).toPandas()


def assign(docs: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, slack: float = SLACK) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``: every row in one shard, sizes near equal, slots gapless from 0.

    Size is the UTF-8 bytes of the text (null: none) plus 8, the checksum of a null text that of an empty one. The key is
    id, text and number of the copy: rows that repeat an id with other texts spread over the ring, and so do equal rows.
    Loads are even as far as single cells allow, which a text longer than a shard's mean ends. Reruns agree up to the
    order of equal rows. Extra columns are ignored; an empty table gives an empty result.
    """
    rows, cells = cell_table(docs)
    placed = docs.sparkSession.createDataFrame(place(cells, shards, virtual_nodes, slack), "cell int, shard int, first_slot long")
    inside = F.row_number().over(Window.partitionBy("cell").orderBy("key", "copy")) - 1
    return rows.withColumn("inside", inside).join(F.broadcast(placed), "cell").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("inside")).alias("slot"))
