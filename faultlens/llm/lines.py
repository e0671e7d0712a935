"""Line dedup by spread over sites, in DataFrame functions only.

A line is boilerplate if it stands in enough distinct sites, or in ten times as many documents; how many are enough falls
with its length (``needed``). HyperLogLog sketches of sites and of documents are kept per line hash and merged by the
aggregation. Where an estimate is near the number needed, exact distinct counts of these lines alone decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import WORD, packed
from faultlens.session import stage, unstage

#: Sites that a line needs; a line of more than so many words needs fewer, one of less than MIN_CHARS characters SHORT_SITES.
MIN_SITES, MIN_CHARS, SHORT_SITES = 5, 20, 15
LONG_LINES = [(50, 2), (25, 3), (12, 4)]
#: Documents for each site needed that have the same effect, so that a line inside one hot site goes as well.
SITE_DOCS = 10
LG_K = 12
#: Half the width of the band around the number needed, in standard errors of the sketch.
ERRORS = 4


def needed(line: Column) -> Column:
    """Sites that a trimmed line needs to be boilerplate, by its length."""
    words, need = F.regexp_count(line, F.lit(WORD)), F.when(F.length(line) < MIN_CHARS, SHORT_SITES)
    for least, sites in LONG_LINES:
        need = need.when(words > least, sites)
    return need.otherwise(MIN_SITES)


def _lines(docs: DataFrame) -> DataFrame:
    """``(doc, copy, at, site, line, need)``: trimmed lines that are not empty, as 16-byte hashes with their places."""
    keyed = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("copy"), F.col("source").alias("site"),
                        F.posexplode(F.split("text", "\n", -1)).alias("at", "raw"))
    trimmed = keyed.withColumn("raw", F.regexp_replace("raw", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    return trimmed.where("raw <> ''").select("doc", "copy", "at", "site", F.unhex(F.md5("raw")).alias("line"), needed(F.col("raw")).alias("need"))


def boilerplate(lines: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """``(line, first_doc)`` of the lines of enough sites or documents; lines of a null site count as none."""
    lines = lines.where("site is not null")
    spread = stage(lines.groupBy("line").agg(
        F.max("need").alias("need"), F.min("doc").alias("first_doc"), F.count("*").alias("places"), F.min("site").alias("low"), F.max("site").alias("high"),
        F.hll_sketch_agg("site", lg_k).alias("sites"), F.hll_sketch_agg("doc", lg_k).alias("docs"))
        .where((F.col("low") < F.col("high")) | (F.col("places") >= SITE_DOCS * F.col("need"))).select(
            "line", "need", "first_doc", F.hll_sketch_estimate("sites").alias("sites"), F.hll_sketch_estimate("docs").alias("docs")), "spread")
    slack = lambda need: F.greatest(F.lit(1.0), ERRORS * 1.04 / 2 ** (lg_k / 2) * need)
    need, crowd = F.col("need"), SITE_DOCS * F.col("need")
    sure = (F.col("sites") > need + slack(need)) | (F.col("docs") > crowd + slack(crowd))
    never = (F.col("sites") < need - slack(need)) & (F.col("docs") < crowd - slack(crowd))
    near = spread.where(~sure & ~never).select("line")
    # Copies of a place are merged before the shuffle, then documents, then sites: no line's rows meet in one task.
    pairs = stage(lines.join(near, "line", "left_semi").groupBy("line", "site", "doc", "need").agg(F.lit(1).alias("one")), "near-lines")
    by_doc = pairs.groupBy("line", "need", "doc").agg(F.lit(1).alias("one")).groupBy("line", "need").agg(F.count("doc").alias("docs"))
    by_site = pairs.groupBy("line", "site").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count("*").alias("sites"))
    exact = by_doc.join(by_site, "line").where((F.col("sites") >= need) | (F.col("docs") >= crowd)).select("line")
    return spread.where(sure).select("line", "first_doc").unionByName(spread.where(~sure).join(exact, "line", "left_semi").select("line", "first_doc"))


def drop_boilerplate(docs: DataFrame, report: bool = False) -> DataFrame:
    """``documents`` without the boilerplate lines, except in the document of smallest id that has them.

    All documents stay: null texts stay null, a text that loses all lines becomes empty. Other lines and empty lines keep
    their order. Repeated rows are treated alike. A null id is never the first holder. ``n_chars`` is set anew where a text
    changed. Extra columns pass through, whatever their names. With ``report`` the result is ``(doc_id, n_lines, n_dropped,
    text)`` instead.
    """
    lines = stage(_lines(docs), "lines")
    bad = stage(boilerplate(lines), "boilerplate")
    gone = stage(lines.join(bad, "line").where(~F.col("doc").eqNullSafe(F.col("first_doc"))).groupBy("doc", "copy").agg(
        F.collect_set("at").alias("gone")), "gone-lines")
    unstage(docs.sparkSession, lines, bad)
    whole = packed(docs).withColumn("key", F.xxhash64("doc.text"))
    gone = gone.withColumnRenamed("doc", "id__")
    matched = whole.join(gone, F.col("doc.doc_id").eqNullSafe(F.col("id__")) & (F.col("key") == F.col("copy")), "left")
    cut = F.split("doc.text", "\n", -1)
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join(F.filter(cut, lambda _, i: ~F.array_contains("gone", i)), "\n"))
    if report:
        return matched.select("doc.doc_id", F.coalesce(F.size(cut), F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"),
                              text.alias("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("gone").isNull(), F.col("doc.n_chars")).otherwise(F.length(text).cast("long"))
    return matched.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
