"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes with the counts of the next byte. Statistics are frozen
after training. A byte costs its exact code length: from the longest known context downwards, an unseen byte pays the
escape of that context (method C: distinct bytes over total plus distinct) and goes on with the shorter context; the
last resort is one of 256. The language of the shortest code wins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import map_pandas
from faultlens.session import attach, stage

ORDER = 3
#: Bound of the training sample: documents per language and bytes of each, taken from a longer text as pieces by their hash.
SAMPLE_DOCS, SAMPLE_BYTES, PIECE = 400, 20_000, 500
_BLOCK = 1 << 20
_START = b"\n" * ORDER


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learned_parts(data: bytes, limit: int = SAMPLE_BYTES, piece: int = PIECE) -> list[bytes]:
    """Parts of a text that training reads, each behind the ``ORDER`` bytes that precede it.

    A text of up to ``limit`` bytes is one part. A longer one is cut into pieces, and those of the smallest hash of
    their bytes and place are taken, ``limit`` bytes in all: a choice by content, spread over the whole text.
    """
    padded = _START + data
    if len(data) <= limit:
        return [padded]
    starts = sorted(range(0, len(data), piece), key=lambda at: (xxhash.xxh64_intdigest(data[at:at + piece], at), at))
    return [padded[at:at + piece + ORDER] for at in sorted(starts[:limit // piece])]


def count_contexts(docs: DataFrame, docs_per_lang: int = SAMPLE_DOCS) -> DataFrame:
    """``(lang, context, n)``: counts of byte strings of one to four bytes, in a bounded sample of labelled rows.

    Distinct texts of a language are taken by a hash of the text below the share that gives ``docs_per_lang``, so the
    choice does not depend on the layout and a group of copies counts once. Texts of every length can be chosen;
    ``learned_parts`` bounds what one of them gives. Empty texts are not taken. Only the cut of each language and the
    chosen texts move: the cuts are one row per language and meet the texts in the task that reads them.
    """
    fit = docs.where("lang is not null and text is not null and text <> ''")
    ranked = fit.select("lang", "text", F.xxhash64("text", F.lit(11)).alias("draw"))
    cuts = ranked.select("lang", "draw").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    span = (F.lit(docs_per_lang).cast("double") / F.col("n")) * 2.0 ** 64
    near = attach(ranked, cuts, ["lang"], "inner").where(F.col("draw").cast("double") <= -(2.0 ** 63) + span)
    chosen = stage(near.select("lang", "draw", "text").dropDuplicates(["lang", "draw"]), "learned")

    def make():
        def step(batch: pd.DataFrame) -> pd.DataFrame:
            out = []
            for lang, group in batch.groupby("lang", sort=False):
                seen: dict[int, int] = {}
                for part in (p for text in group["text"] for p in learned_parts(text.encode("utf-8", "surrogatepass"))):
                    data = np.frombuffer(part, np.uint8).astype(np.int64)
                    code = np.zeros(len(data) - ORDER, np.int64)
                    for size in range(1, ORDER + 2):
                        code = code + (data[ORDER + 1 - size:len(data) + 1 - size] << 8 * (size - 1))
                        for key, n in zip(*np.unique(code | (size << 40), return_counts=True)):
                            seen[int(key)] = seen.get(int(key), 0) + int(n)
                out.append(pd.DataFrame({"lang": lang, "context": list(seen), "n": list(seen.values())}))
            return pd.concat(out)
        return step
    parts = map_pandas(chosen.select("lang", "text"), make, "lang string, context long, n long")
    return parts.groupBy("lang", "context").agg(F.sum("n").alias("n"))


class Model:
    """Code lengths in bits per language, context and byte, with bytes that training never saw in class 0."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        size, code = counts["context"].to_numpy() >> 40, counts["context"].to_numpy() & (1 << 40) - 1
        seen = np.unique(code[size == 1])
        self.classes = np.zeros(256, np.int32)
        self.classes[seen] = np.arange(1, len(seen) + 1)
        width = self.width = len(seen) + 1

        def split(k):
            rows = size == k
            symbols = [self.classes[code[rows] >> 8 * i & 255] for i in reversed(range(k))]
            lang = np.searchsorted(self.langs, counts["lang"].to_numpy()[rows].astype(str))
            return lang, symbols, counts["n"].to_numpy()[rows].astype(float)

        def refine(shorter, lang, row, symbol, n, rows):
            table = np.zeros((rows, width))
            out = []
            for one in range(len(self.langs)):
                mine = lang == one
                table[:] = 0
                np.add.at(table, (row[mine], symbol[mine]), n[mine])
                total, kinds = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    hit = -np.log2(table / (total + kinds))
                    miss = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0) + shorter[one]
                out.append(np.where(table > 0, hit, miss).astype(np.float32))
            return np.stack(out)

        lang, (s,), n = split(1)
        zero = refine(np.full((len(self.langs), 1, width), 8.0), lang, np.zeros(len(s), int), s, n, 1)
        lang, (c, s), n = split(2)
        one = refine(np.broadcast_to(zero, (len(self.langs), width, width)), lang, c, s, n, width)
        lang, (b, c, s), n = split(3)
        two = refine(np.tile(one, (1, width, 1)), lang, b * width + c, s, n, width * width)
        lang, (a, b, c, s), n = split(4)
        full = (a * width + b) * width + c
        known, row = np.unique(full, return_inverse=True)
        three = refine(two[:, known % (width * width)], lang, row, s, n, len(known))
        self.cost = np.concatenate((two, three), 1)
        self.rows = np.tile(np.arange(width * width, dtype=np.int32), width)
        self.rows[known] = width * width + np.arange(len(known))

    def bits(self, text: str) -> np.ndarray:
        data = self.classes[np.frombuffer(_START + text.encode("utf-8", "surrogatepass"), np.uint8)]
        total = np.zeros(len(self.langs))
        for at in range(ORDER, len(data), _BLOCK):
            end = min(at + _BLOCK, len(data))
            a, b, c, s = (data[at - i:end - i] for i in (3, 2, 1, 0))
            row = self.rows[(a * self.width + b) * self.width + c]
            for k in range(len(self.langs)):
                total[k] += self.cost[k][row, s].sum(dtype=np.float64)
        return total


def predict(docs: DataFrame, counts: pd.DataFrame) -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row; the score is the posterior under equal priors.

    ``und`` with score 0 for null texts, texts without a letter, and where nothing was learned. Ties go to the smaller name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Model(counts) if len(counts) else None)

    def make():
        model = shared.value

        def one(text):
            if model is None or text is None or not any(map(str.isalpha, text)):
                return "und", 0.0
            bits = model.bits(text)
            best = int(np.argmin(bits))
            return model.langs[best], float(1 / np.exp2(np.maximum(-1000, bits[best] - bits)).sum())

        def step(batch: pd.DataFrame) -> pd.DataFrame:
            found = [one(t) for t in batch["text"]]
            return pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": [f[0] for f in found],
                                 "score": [f[1] for f in found]})
        return step
    return map_pandas(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), make,
                      f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, docs_per_lang: int = SAMPLE_DOCS) -> DataFrame:
    """Learns from the labelled documents that are not held out and predicts every whole text.

    The counts come to the driver: their number is bounded by the sample, SAMPLE_DOCS texts of SAMPLE_BYTES per
    language; the tables of the model grow with the number of labels. Repeated rows are predicted alike; extra columns are ignored; an empty table gives an empty result.
    """
    counts = count_contexts(docs.where(~held_out(F.col("doc_id"))), docs_per_lang).toPandas()
    return predict(docs, counts)
