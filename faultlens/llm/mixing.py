"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every document has a rate within its source, lower for documents far over the source's mean size: certain whole copies and
a chance of one more. Documents are ranked by random odds divided by the odds of that chance; the first of a source, as
many as fill what its target leaves, get it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.common import packed, word_count
from faultlens.session import stage

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, LIMIT, SEED = 1.5, 2.0, 17
#: Classes of documents by their size over the mean of their source; the k-th has a k-th of the weight.
CLASSES = 4
#: Parts of the ranking of a source that are counted before single documents are.
BUCKETS = 4096


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Weights repeat over the sources by code point, null last. Targets are least(limit * size, level * weight); the level
    is where the targets share out ``share`` of all sizes. One row per source is ordered, never the documents.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    most = sizes.withColumn("weight", weight).withColumn("most", limit * F.col("source_size"))
    filled = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = most.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("most") / F.col("weight"))
    chosen = F.min(F.when(F.col("fits"), F.struct((F.col("most") / F.col("weight")).alias("order"), "level"))).over(everything)["level"]
    return leveled.withColumn("chosen", chosen).select(
        "source", "source_size", F.least("most", F.coalesce(F.col("chosen") * F.col("weight"), F.col("most"))).alias("target"))


def _rates(rows: DataFrame, goal: DataFrame, limit: float) -> DataFrame:
    """The rows with ``rate``, the copies that each is expected to give: a source's rates times sizes add up to its target.

    A document of up to the mean size of its source has weight one; at each doubling beyond the mean the weight falls to a
    half, a third and a CLASSES-th, so that few long documents don't make up a source. Rates are weights times a level, at
    most ``limit``; classes of larger weights reach it first, and the others share what is left.
    """
    mean = F.col("source_size") / F.greatest(F.col("worded"), F.lit(1))
    over = F.when(F.col("size") > mean, 1 + F.ceil(F.log2(F.col("size") / mean))).otherwise(1)
    joined = rows.join(goal.withColumnRenamed("source", "source__"), F.col("source").eqNullSafe(F.col("source__"))).drop("source__")
    classed = stage(joined.withColumn("class", F.least(over, F.lit(CLASSES)).cast("int")), "mix-classes")
    sums = classed.groupBy("source").agg(F.first("target").alias("goal"), *[
        F.coalesce(F.sum(F.when(F.col("class") == k, F.col("size"))), F.lit(0)).alias(f"words_{k}") for k in range(1, CLASSES + 1)])
    levels = []
    for full in range(CLASSES):
        left = F.col("goal") - sum((limit * F.col(f"words_{k}") for k in range(1, full + 1)), F.lit(0.0))
        free = sum((F.col(f"words_{k}") / k for k in range(full + 1, CLASSES + 1)), F.lit(0.0))
        levels.append(F.when((free > 0) & (left / free <= limit * (full + 1)), left / free))
    level = stage(sums.select(F.col("source").alias("source__"), F.coalesce(*levels, F.lit(limit * CLASSES)).alias("level")), "mix-levels")
    out = classed.join(level, F.col("source").eqNullSafe(F.col("source__"))).drop("source__")
    return out.withColumn("rate", F.least(F.lit(limit), F.col("level") / F.col("class")))


def mix(docs: DataFrame, seed: int = SEED, buckets: int = BUCKETS, limit: float = LIMIT) -> DataFrame:
    """``(doc_id, key, source, size, source_size, target, copies, taken, rate)`` per row of ``docs``.

    Null texts have size 0, the null source is one of its own. Draws are hashes of id and text, so reruns agree and equal
    rows draw alike. Whole copies of a document's rate are certain, its fraction is the chance of one more. A source's words
    miss its target by no more than half its largest document. A source is cut by counts per part of the ranking; only the
    part with the cut is ordered. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "source", word_count(F.col("text")).alias("size"))
    draw = (F.shiftrightunsigned(F.xxhash64("doc_id", "key", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    rows = stage(rows.withColumn("draw", draw), "mix-sizes")
    counts = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("worded")), "mix-sources")
    goal = stage(counts.join(targets(counts.select("source", "source_size"), limit=limit).select(F.col("source").alias("source__"), "target"),
                             F.col("source").eqNullSafe(F.col("source__"))).drop("source__"), "mix-targets")
    rated = _rates(rows, goal, limit).withColumn("whole", F.floor("rate")).withColumn("chance", F.col("rate") - F.col("whole"))
    odds = (F.col("draw") / (1 - F.col("draw"))) / (F.col("chance") / (1 - F.col("chance")))
    ranked = stage(rated.withColumn("odds", F.when(F.col("chance") > 0, odds).otherwise(F.lit(float("inf"))))
                   .withColumn("part", F.when(F.col("chance") > 0, F.floor(odds / (1 + odds) * buckets)).otherwise(F.lit(buckets))), "mix-ranked")
    line = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranked.groupBy("source", "part").agg(F.sum("size").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("sure"), F.first("target").alias("target"))
    need = F.col("target") - F.sum("sure").over(Window.partitionBy("source"))
    parts = stage(parts.withColumn("need", need).withColumn("before", F.coalesce(F.sum("words").over(line), F.lit(0))).select(
        F.col("source").alias("source__"), F.col("part").alias("part__"), "before", "need",
        F.when(F.col("before") + F.col("words") <= F.col("need"), "in").when(F.col("before") > F.col("need"), "out").otherwise("cut").alias("state")), "mix-parts")
    placed = ranked.join(parts, F.col("source").eqNullSafe(F.col("source__")) & (F.col("part") == F.col("part__"))).drop("source__", "part__")
    inside = Window.partitionBy("source", "part").orderBy("odds", "doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)
    cut = placed.where("state = 'cut'").withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cut = cut.withColumn("extra", F.when((F.col("chance") > 0) & (F.col("ahead") + F.col("size") / 2 <= F.col("need")), 1).otherwise(0)).drop("ahead")
    clear = placed.where("state <> 'cut'").withColumn("extra", F.when((F.col("state") == "in") & (F.col("chance") > 0), 1).otherwise(0))
    return clear.unionByName(cut).withColumn("copies", (F.col("whole") + F.col("extra")).cast("int")).select(
        "doc_id", "key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "rate")


def repeat(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents as the mix takes them: each row as often as its copies, with all its columns, whatever their names.

    Rows without a word count nothing towards a target and stay once. Equal rows (id, source and text) draw alike, but the cut of
    a source may fall between them: then as many of them get one more copy as the mix says.
    """
    mixed = mix(docs, seed).where("size > 0").groupBy("doc_id", "source", "key")
    # Equal rows have the same whole copies; some of them one more.
    shares = stage(mixed.agg(F.min("copies").alias("least"), F.sum("copies").alias("sum"), F.count("*").alias("rows")), "copies").select(
        F.col("doc_id").alias("id__"), F.col("source").alias("source__"), F.col("key").alias("key__"), "least", "rows",
        (F.col("sum") - F.col("least") * F.col("rows")).alias("more"))
    whole = packed(docs).withColumn("key", F.xxhash64("doc.text"))
    worded = word_count(F.col("doc.text")) > 0
    joined = whole.where(worded).join(shares, F.col("doc.doc_id").eqNullSafe(F.col("id__")) & F.col("doc.source").eqNullSafe(F.col("source__"))
                                      & (F.col("key") == F.col("key__")))
    same = Window.partitionBy("id__", "source__", "key__").orderBy(F.lit(0))
    plain = joined.where("more = 0").withColumn("copies", F.col("least"))
    several = joined.where("more > 0").withColumn("copies", F.col("least") + (F.row_number().over(same) <= F.col("more")).cast("int"))
    taken = plain.unionByName(several).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select("doc").unionByName(whole.where(~worded).select("doc")).select("doc.*")
