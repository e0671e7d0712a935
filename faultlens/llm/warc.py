"""WARC bundles in seekable Zstandard: records in independent frames, a footer with a seek table, an index of records.

A bundle is the content of one ``.warc.zst`` file of bounded size and is stored as one row of a Parquet table in the
shared folder, so that Spark's committer decides which attempt counts. ``write_files`` puts bundles out as files.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.session import new_folder, stage

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
DATE = "2026-01-01T00:00:00Z"
#: Uncompressed bytes after which a frame, and compressed bytes after which a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 8 << 20
#: Payloads of at least this many bytes are stored once.
DEDUP_BYTES = 1000
#: A bundle with the places of its records: frame, and start and length in the plain frame.
_BUNDLE = "bundle string, content binary, records array<struct<page_id: long, frame: int, start: int, length: int>>"
_PARSED = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, "
           "payload binary, intact boolean, bundle string, frame int, start int, length int")


def record(row: dict) -> bytes:
    """One WARC/1.1 record of a page; a revisit carries digest and length of its payload but not the payload."""
    payload = b"" if row["record_type"] == "revisit" else row["payload"]
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{row['page_id']}>", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{row['digest']}", f"X-Payload-Length: {row['size']}"]
    if row["target"] is not None:
        head.append("WARC-Target-URI: " + row["target"].replace("\r", "%0D").replace("\n", "%0A"))
    if row["record_type"] == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def seal(frames: list[tuple[bytes, int]]) -> bytes:
    """Frames and, as a skippable frame, their seek table: compressed and plain size of each, count, flags, magic."""
    table = b"".join(struct.pack("<II", len(data), size) for data, size in frames)
    body = table + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return b"".join(data for data, _ in frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """``(offset, compressed size, plain size)`` of every frame, read from the footer."""
    count, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    table, offset, start = [], 0, len(bundle) - 9 - 8 * count
    for at in range(count):
        packed, plain = struct.unpack_from("<II", bundle, start + 8 * at)
        table.append((offset, packed, plain))
        offset += packed
    return table


def read_frame(bundle: bytes, frame: int, table: list[tuple[int, int, int]]) -> bytes:
    offset, packed, plain = table[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[offset:offset + packed], max_output_size=plain)


def parse(plain: bytes, start: int = 0) -> Iterator[tuple[dict, bytes, int, int]]:
    """``(headers, payload, start, length)`` of the records in a decompressed frame."""
    while start < len(plain):
        end = plain.index(b"\r\n\r\n", start)
        lines = plain[start:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
        head = dict(line.split(": ", 1) for line in lines)
        body = end + 4
        stop = body + int(head["Content-Length"])
        yield head, plain[body:stop], start, stop + 4 - start
        start = stop + 4


def classify(pages: DataFrame) -> DataFrame:
    """``(page_id, target, payload, digest, size, record_type, refers_to)``: of equal payloads of DEDUP_BYTES or more the
    largest page_id responds. The largest id per digest is aggregated first; the join back can be split."""
    payload: Column = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").alias("target"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    heads = stage(rows.where(F.col("size") >= DEDUP_BYTES).groupBy("digest", "size").agg(
        F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n"), "payload-heads")
    joined = rows.join(heads, ["digest", "size"], "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("head")) & F.col("head").isNotNull(), F.lit(False))
    return joined.select("page_id", "target", "payload", "digest", "size",
                         F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("head")).alias("refers_to"))


def write_bundles(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``(bundle, content, records)`` rows to ``path`` and returns that table; ``records`` is the index of the bundle.

    Null html is an empty payload; a null page_id is written as ``None`` and read back as null. Repeated rows each get a
    record. A payload over the frame size makes a frame of its own. An empty table gives no bundle.
    """
    spark = pages.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part, number = TaskContext.get().partitionId(), 0
        packer, frames, places, pending, held, packed = zstandard.ZstdCompressor(level=3), [], [], [], 0, 0

        def closed() -> pd.DataFrame:
            return pd.DataFrame({"bundle": [f"{part:06d}-{number:06d}"], "content": [seal(frames)], "records": [places]})

        for batch in batches:
            for row in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                data = record(row)
                name = None if row["page_id"] is None else int(row["page_id"])
                places.append({"page_id": name, "frame": len(frames), "start": held, "length": len(data)})
                pending.append(data)
                held += len(data)
                if held >= FRAME_BYTES:
                    frames.append((packer.compress(b"".join(pending)), held))
                    packed, pending, held = packed + len(frames[-1][0]), [], 0
                if packed >= BUNDLE_BYTES:
                    yield closed()
                    frames, places, packed, number = [], [], 0, number + 1
        if pending:
            frames.append((packer.compress(b"".join(pending)), held))
        if frames:
            yield closed()

    path = path or new_folder(spark, "warc")
    rows = classify(pages).select(*[F.col(c).cast("string").alias(c) if c in ("page_id", "refers_to") else c for c in (
        "page_id", "target", "payload", "digest", "size", "record_type", "refers_to")])
    rows.mapInPandas(run, _BUNDLE).write.parquet(path)
    return spark.read.schema(_BUNDLE).parquet(path)


def _page(urn: str | None) -> int | None:
    name = urn and urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name in (None, "None") else int(name)


def _parsed(head: dict, payload: bytes, bundle: str, frame: int, start: int, length: int) -> tuple:
    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
    full = head["WARC-Type"] == "response"
    intact = not full or len(payload) == size and hashlib.sha1(payload).hexdigest() == digest
    if full:
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    return (_page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], _page(head.get("WARC-Refers-To")),
            head.get("WARC-Target-URI"), payload, intact, bundle, frame, start, length)


def _as_rows(out: list[tuple]) -> pd.DataFrame:
    names = [f.split()[0] for f in _PARSED.split(", ")]
    rows = pd.DataFrame(out, columns=names)
    return rows.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, frame by frame through the seek table, with its place (bundle, frame, start, length)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["bundle"], batch["content"]):
                table = seek_table(content)
                for frame in range(len(table)):
                    yield _as_rows([_parsed(*found[:2], name, frame, *found[2:]) for found in parse(read_frame(content, frame, table))])
    return bundles.select("bundle", "content").mapInPandas(run, _PARSED)


def stored_index(bundles: DataFrame) -> DataFrame:
    """``(page_id, bundle, frame, start, length)`` of all records as written with the bundles; no content is read."""
    return bundles.select("bundle", F.explode("records").alias("r")).select("r.page_id", "bundle", "r.frame", "r.start", "r.length")


def resolve(bundles: DataFrame, records: DataFrame) -> DataFrame:
    """``records`` of ``read_bundles`` whose revisits have size and ``intact`` from the response that they refer to.

    Each response is found by its id in the stored index and taken from its place. A revisit is intact if the payload there is
    itself intact and has the digest and size that the revisit states. Without such a response it keeps its own size and is not
    intact. The responses wanted are made distinct first, so a payload that many pages share is looked up once.
    """
    own = records.where("record_type <> 'revisit'")
    again = records.where("record_type = 'revisit'")
    wanted = again.select("refers_to", "payload_digest").distinct()
    places = stored_index(bundles).withColumnRenamed("page_id", "refers_to").join(wanted, "refers_to")
    at = own.select("bundle", "frame", "start", "payload_digest", F.col("payload_bytes").alias("_bytes"), F.col("intact").alias("_whole"))
    found = places.join(at, ["bundle", "frame", "start", "payload_digest"]).groupBy("refers_to", "payload_digest").agg(
        F.max("_bytes").alias("_bytes"), F.bool_and("_whole").alias("_whole"))
    same = F.coalesce(F.col("_whole") & (F.col("_bytes") == F.col("payload_bytes")), F.lit(False))
    again = again.join(found, ["refers_to", "payload_digest"], "left").withColumn("intact", same).withColumn(
        "payload_bytes", F.coalesce("_bytes", "payload_bytes"))
    return own.unionByName(again.select(*own.columns))


def index(records: DataFrame) -> DataFrame:
    """Record id to place: ``(page_id, bundle, frame, start, length)``; start is relative to the plain frame."""
    return records.select("page_id", "bundle", "frame", "start", "length")


def fetch(bundles: DataFrame, places: DataFrame) -> DataFrame:
    """The records at given places of the index; only their frames are decompressed."""
    wanted = places.groupBy("bundle").agg(F.collect_list(F.struct("frame", "start")).alias("places"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content, places in zip(batch["bundle"], batch["content"], batch["places"]):
                table, last, plain = seek_table(content), -1, b""
                for place in sorted((p["frame"], p["start"]) for p in places):
                    if place[0] != last:
                        last, plain = place[0], read_frame(content, place[0], table)
                    found = next(parse(plain, place[1]))
                    yield _as_rows([_parsed(*found[:2], name, last, *found[2:])])
    return bundles.join(wanted, "bundle").mapInPandas(run, _PARSED)


def write_files(bundles: DataFrame, folder: str) -> DataFrame:
    """Bundles as ``.warc.zst`` files in a mounted shared folder, by rename, so that repeated attempts do no harm."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        for batch in batches:
            for name, content in zip(batch["bundle"], batch["content"]):
                path = os.path.join(folder, f"{name}.warc.zst")
                with open(f"{path}.{TaskContext.get().taskAttemptId()}", "wb") as out:
                    out.write(content)
                os.replace(out.name, path)
            yield pd.DataFrame({"bundle": batch["bundle"]})
    return bundles.mapInPandas(run, "bundle string")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes all pages and reads the archives back, without the payloads; revisits are resolved through the index."""
    bundles = write_bundles(pages)
    records = stage(read_bundles(bundles).drop("payload", "target"), "records")
    return resolve(bundles, records).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact", "bundle", "frame", "start", "length")
