"""Quality rules per document and per host.

Failures of all rules are aggregated by host. The rate of each host is shrunk towards the corpus with a beta prior fitted
to all hosts by moments, and two limits that follow from it are joined back: how many symbols and how many repeated lines
a document of that host may have. Gross cases go at the prior mean already, the limits tighten as the rate rises to that
of a suspect host, and loosen only for hosts with less than half the failures of the corpus.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import map_arrow, packed, schema_of
from faultlens.session import stage

#: Shrunk failure rate from which a host is suspect.
SUSPECT_RATE = 0.5
#: Strict rules, whose failures count towards the rate: percent of characters in words that are symbols, of lines that repeat.
STRICT_SYMBOLS, STRICT_LINES = 10, 30
#: The limits, in the same percentages, at the prior mean and on suspect hosts.
PRIOR_SYMBOLS, PRIOR_LINES = 10, 50
SUSPECT_SYMBOLS, SUSPECT_LINES = 5, 30
_SPACES = " \t\n\v\f\r"


def measures(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the number of lines with a word."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered, repeated = 0, 0
    if often:
        for at, window in enumerate(windows):
            if window in often:
                repeated += at + 3 - max(at, covered)
                covered = at + 3
    return (len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, "#*$%&|<>")),
            len(lines) - len(set(lines)), repeated, len(lines))


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _measured(rows: DataFrame) -> DataFrame:
    """The rows with their ``text`` and, as new columns, its measures and whether it fails the base and the strict rules."""
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [pa.array(c, pa.int64()) for c in zip(*map(measures, batch["text"].to_pylist()))]
            return pa.RecordBatch.from_arrays(batch.columns + found, names=batch.schema.names + _NAMES)
        return step
    out = map_arrow(rows, make, ", ".join([schema_of(rows, *rows.columns), *(f"{n} long" for n in _NAMES)]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    strict = (100 * F.col("n_symbols") > STRICT_SYMBOLS * F.col("word_chars")) | (100 * F.col("n_dup_lines") > STRICT_LINES * F.col("n_lines"))
    return out.withColumn("base_failed", failed).withColumn("strict_failed", strict)


def rules(docs: DataFrame) -> DataFrame:
    """``(doc_id, host, measures …, base_failed, strict_failed)`` per row of ``docs``; null texts have no words."""
    return _measured(docs.select("doc_id", F.col("source").alias("host"), "text")).drop("text")


def _failures(ruled: DataFrame) -> DataFrame:
    failed = (F.col("base_failed") | F.col("strict_failed")).cast("long")
    return stage(ruled.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(failed).alias("n_failed")), "hosts")


def host_verdicts(ruled: DataFrame, suspect_rate: float = SUSPECT_RATE) -> DataFrame:
    """``(host, n_docs, n_failed, shrunk_rate, suspect, symbol_limit, line_limit)``; the null host is a host of its own.

    ``n_failed`` counts the documents that fail any rule. The limits go in a straight line from those of the prior mean to
    those of a suspect host, and grow as half the mean over the rate below half the mean.
    Prior mean and strength by the method of moments over host rates; without spread between hosts beyond chance the
    strength is taken as the largest host's count, so that all hosts move to the mean.
    """
    return _limits(_failures(ruled), suspect_rate)


def _limits(hosts: DataFrame, suspect_rate: float) -> DataFrame:
    """``host_verdicts`` from the counts of the hosts."""
    total = hosts.agg(F.sum("n_docs").alias("all_docs"), F.sum("n_failed").alias("all_failed"), F.max("n_docs").alias("most"),
                      F.avg(F.lit(1.0) / F.col("n_docs")).alias("inverse"),
                      F.coalesce(F.var_samp(F.col("n_failed") / F.col("n_docs")), F.lit(0.0)).alias("spread")).first()
    if not total["all_docs"]:
        return hosts.withColumns({"shrunk_rate": F.lit(0.0), "suspect": F.lit(False), "symbol_limit": F.lit(float(PRIOR_SYMBOLS)),
                                  "line_limit": F.lit(float(PRIOR_LINES))})
    mean = total["all_failed"] / total["all_docs"]
    chance = mean * (1 - mean)
    between = total["spread"] - chance * total["inverse"]
    strength = min(max(chance / between - 1, 1.0), float(total["most"])) if between > 0 else float(total["most"])
    rate = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    over = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("shrunk_rate") - mean) / max(suspect_rate - mean, 1e-9)))
    loose = F.when(2 * F.col("shrunk_rate") < mean, mean / (2 * F.col("shrunk_rate"))).otherwise(F.lit(1.0))
    limits = {"symbol_limit": loose * (PRIOR_SYMBOLS - over * (PRIOR_SYMBOLS - SUSPECT_SYMBOLS)),
              "line_limit": loose * (PRIOR_LINES - over * (PRIOR_LINES - SUSPECT_LINES))}
    return hosts.withColumn("shrunk_rate", rate).withColumn("suspect", F.col("shrunk_rate") >= suspect_rate).withColumns(limits)


def judge(docs: DataFrame, suspect_rate: float = SUSPECT_RATE) -> DataFrame:
    """All measures, ``base_failed`` and ``kept`` per row; repeated rows stay, extra columns are ignored.

    Empty and null texts fail the base rule. A document is kept if it passes the base rules and has no more symbols and
    repeated lines than the limits of its host. An empty table gives an empty result.
    """
    ruled = stage(rules(docs), "rules")
    return _verdicts(ruled, host_verdicts(ruled, suspect_rate))


def _verdicts(ruled: DataFrame, hosts: DataFrame) -> DataFrame:
    """The rows with the limits of their host and whether they are ``kept``."""
    hosts = hosts.select(F.col("host").alias("host__"), "shrunk_rate", "suspect", "symbol_limit", "line_limit")
    joined = ruled.join(hosts, F.col("host").eqNullSafe(F.col("host__")), "left").drop("host__")
    garbage = 100 * F.col("n_symbols") > F.col("symbol_limit") * F.col("word_chars")
    repeated = 100 * F.col("n_dup_lines") > F.col("line_limit") * F.col("n_lines")
    return joined.withColumn("kept", ~F.col("base_failed") & ~garbage & ~repeated)


def keep(docs: DataFrame, suspect_rate: float = SUSPECT_RATE) -> DataFrame:
    """The rows that ``judge`` keeps, with all their columns, whatever their names; each row is judged by its own text.

    The first pass over the texts counts the failures of each host, the second measures again and applies the limits of the
    host, so that no text is shuffled: hosts are one row each, and a long table of them is joined by a shuffle only then.
    """
    counted = _failures(rules(docs))
    whole = packed(docs).select("doc", F.col("doc.source").alias("host"), F.col("doc.text").alias("text"))
    return _verdicts(_measured(whole), _limits(counted, suspect_rate)).where("kept").select("doc.*")
