"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm import (bpe, byte_tokens, dialogue, importance, langid, lines, mixing, neighbours, quality, secrets, shards, simhash,
                           warc)
from faultlens.llm.common import table
from faultlens.session import prepare


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(prepare(spark), sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(prepare(spark), sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_boilerplate(table(prepare(spark), sf_dir, "documents"), report=True)
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"),
                      F.md5("text").alias("text_md5"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(prepare(spark), sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(prepare(spark), table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(prepare(spark), sf_dir, "documents")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(prepare(spark), sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.assign(table(prepare(spark), sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(prepare(spark), sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(prepare(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(prepare(spark), sf_dir, "conversations")
    return dialogue.repair_conversations(dialogue.damage(rows), rows)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_tokens.encode(table(prepare(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                              public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(prepare(spark), sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_neighbours, op3_line_dedup, op4_language, op5_warc, op6_secrets, op7_quality,
                                   op8_shards, op9_mixing, op10_bpe, op11_conversations, op12_importance, op13_byte_bpe,
                                   pipeline)}

_SPACES = r"[\x20\x09-\x0D]"

ORACLES = {
    "op3_line_dedup": rf"""
        with lines as (select doc_id, source, unnest(string_split(text, chr(10))) as raw from documents),
        trimmed as (select doc_id, source, regexp_replace(raw, '^{_SPACES}+|{_SPACES}+$', '', 'g') as line from lines),
        sized as (select line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words, min(doc_id) as first_doc,
                         count(distinct source) as sites, count(distinct doc_id) as docs
                  from trimmed where line <> '' and source is not null group by line),
        judged as (select *, case when length(line) < {lines.MIN_CHARS} then {lines.SHORT_SITES}
                   {' '.join(f'when words > {w} then {n}' for w, n in lines.LONG_LINES)} else {lines.MIN_SITES} end as need from sized),
        wide as (select line, first_doc from judged where sites >= need or docs >= {lines.SITE_DOCS} * need),
        cut as (select doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) as nth, unnest(string_split(text, chr(10))) as raw from documents),
        marked as (select c.*, w.line is not null as gone from cut c left join wide w
                   on regexp_replace(c.raw, '^{_SPACES}+|{_SPACES}+$', '', 'g') = w.line and c.doc_id <> w.first_doc)
        select doc_id, count(*) as n_lines, sum(gone::int)::bigint as n_dropped,
               md5(coalesce(string_agg(raw, chr(10) order by nth) filter (where not gone), '')) as text_md5
        from marked group by doc_id""",
    "op5_warc": f"""
        with heads as (select page_id, coalesce(html, '') as payload, max(page_id) over (partition by coalesce(html, '')) as head from pages),
        judged as (select *, coalesce(strlen(payload) >= {warc.DEDUP_BYTES} and page_id is distinct from head, false) as again from heads)
        select page_id, strlen(payload)::bigint as payload_bytes, sha1(payload) as payload_digest,
               case when again then 'revisit' else 'response' end as record_type, case when again then head end as refers_to
        from judged""",
}
