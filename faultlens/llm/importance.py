"""Importance resampling towards a target distribution, from hashed word n-grams.

A table of 256 bytes lower-cases A-Z and blanks every separator in UTF-8, splitting the bytes gives words, and the checksum of
a run of words goes on from that of the run before it. Counters reduce buckets to counts, first per batch, then over
the corpus. The gain of a bucket says how much likelier the target is to hold it; a document's weight is the mean gain of
its features. Gumbel noise from a hash of the id turns weights into a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.common import map_pandas
from faultlens.session import stage

BUCKETS, NGRAM, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
#: Bytes of a text that are worked off at once.
BLOCK = 1 << 20


def separator_table() -> bytes:
    """Each byte as itself, as its lower-case letter, or as a blank if it separates words."""
    kept = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in kept else 0x20 for b in range(256))


_TABLE = separator_table()


def word_blocks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a whole text, in blocks of bounded size that end between words."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(data):
        to = data.find(b" ", at + BLOCK)
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


def feature_counts(texts: list[str | None], ngram: int, buckets: int) -> tuple[Counter, int, int]:
    """Counts per bucket over all runs of 1 to ``ngram`` words of the texts, the number of features and of words."""
    found, n_features, n_words = Counter(), 0, 0
    for text in texts:
        tail: list[bytes] = []
        for words in word_blocks(text):
            n_words += len(words)
            if ngram == 1:
                n_features += len(words)
                for word, count in Counter(words).items():
                    found[zlib.crc32(word) % buckets] += count
                continue
            joined, fresh = tail + words, len(tail)
            sums = [zlib.crc32(w) for w in joined]
            found.update(s % buckets for s in sums[fresh:])
            n_features += len(words)
            for width in range(2, ngram + 1):
                sums = [zlib.crc32(b" " + w, s) for s, w in zip(sums, joined[width - 1:])]
                new = sums[max(0, fresh - width + 1):]
                found.update(s % buckets for s in new)
                n_features += len(new)
            tail = joined[-(ngram - 1):]
    return found, n_features, n_words


def bucket_counts(texts: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` over the column ``text`` of all rows; at most ``buckets`` rows per slice leave a task."""
    def make():
        def step(batch: pd.DataFrame) -> pd.DataFrame:
            found, _, _ = feature_counts(batch["text"].tolist(), ngram, buckets)
            return pd.DataFrame({"bucket": list(found.keys()), "n": list(found.values())}, dtype="int64")
        return step
    return map_pandas(texts.select("text"), make, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Per bucket floor(1000 * ln of how much likelier the target holds it), each count raised by one."""
    s_all, t_all = sum(raw.values()), sum(target.values())
    ratio = lambda b: float(target.get(b, 0) + 1) * float(s_all + buckets) / (float(raw.get(b, 0) + 1) * float(t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def weigh(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` per row of ``docs``; counts come from all rows of both tables.

    To the driver come the two tables of counts, of ``buckets`` rows at most, and their gains are broadcast.
    """
    spark = docs.sparkSession
    raw, wanted = ({r["bucket"]: r["n"] for r in bucket_counts(t, ngram, buckets).collect()} for t in (docs, target))
    shared = spark.sparkContext.broadcast(gains(raw, wanted, buckets))

    def make():
        gain = shared.value.tolist()

        def step(batch: pd.DataFrame) -> pd.DataFrame:
            out = []
            for text in batch["text"]:
                found, n_features, n_words = feature_counts([text], ngram, buckets)
                total = sum(gain[b] * n for b, n in found.items())
                out.append((n_words, n_features, total // n_features if n_features else 0))
            return pd.DataFrame(out, columns=["n_words", "n_features", "weight"], dtype="int64").assign(doc_id=batch["doc_id"].to_numpy())
        return step
    kind = docs.schema["doc_id"].dataType.simpleString()
    # The id travels as text: a column of numbers with nulls would lose digits.
    return map_pandas(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), make,
                      "doc_id string, n_words long, n_features long, weight long").withColumn("doc_id", F.col("doc_id").cast(kind))


def resample(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
             percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` per row of ``docs``; rank 1, 2, 3 … for the rows drawn, else null.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred (floored) with the highest scores are drawn, ties to
    the smaller id. Null and empty texts have no features and weight 0. Repeated rows score alike and are drawn one by one; a
    null id is hashed as an empty text and comes first among ties. Extra columns are ignored. Empty tables give empty
    results; an empty target counts as no features.

    Ranks need no order over all rows: the driver gets one count per integer score (scores of ten thousands at most, whatever
    the size of the corpus), which tells how many rows go before each score, and only rows of one score are ordered,
    after equal rows were counted.
    """
    spark = docs.sparkSession
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    scored = stage(weigh(docs, target, ngram, buckets).withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    fit = scored.where(F.col("n_words") >= least_words)
    counted = sorted(((r["score"], r["count"]) for r in fit.groupBy("score").count().collect()), reverse=True)
    draw, before, ahead = sum(n for _, n in counted) * percent // 100, [], 0
    for score, n in counted:
        if ahead >= draw:
            break
        before.append((score, ahead))
        ahead += n
    places = spark.createDataFrame(before, "score long, ahead long")
    columns = ["doc_id", "n_features", "weight", "score"]
    equal = fit.join(F.broadcast(places), "score").groupBy(*columns, "ahead").agg(F.count("*").alias("rows"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "n_features", "weight")
    last = F.col("ahead") + F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = equal.withColumn("last", last).withColumn("first", F.col("last") - F.col("rows") + 1)
    ranks = F.when(F.col("first") <= draw, F.sequence("first", F.least("last", F.lit(draw)))).otherwise(F.array().cast("array<long>"))
    drawn = ranked.withColumn("ranks", ranks)
    cut = min((s for s, _ in before), default=None)
    inside = drawn.select(*columns, F.explode("ranks").alias("rank"))
    rest = drawn.where(F.col("last") > draw).select(*columns, F.explode(F.sequence(F.greatest(F.col("first"), F.lit(draw + 1)), "last"))).select(
        *columns, F.lit(None).cast("long").alias("rank"))
    out = (F.col("n_words") < least_words) if cut is None else (F.col("n_words") < least_words) | (F.col("score") < cut)
    out = F.lit(True) if not before else out
    return scored.where(out).select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(inside).unionByName(rest)
