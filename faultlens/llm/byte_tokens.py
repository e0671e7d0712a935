"""Byte-level BPE with the tokenizers library, over Arrow batches.

The ranks of a vocabulary are turned into a model of the library: every byte gets a printable character, every token becomes
the characters of its bytes, and a token's merge is the pair that merging its own bytes by lower ranks leaves. The text is
split by the pattern first. Offsets count characters of the text; tokens inside one character share its place. Decoding
maps the characters of the tokens back to bytes, so characters that are split over tokens come out whole.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are encoded in parts of about so many characters, cut where the pattern always cuts: before white space behind a word.
PART = 1 << 18
#: Rows of a batch whose results are held at once.
ROWS = 256
#: Characters of encoded pieces, with 64 for each, that a Python process remembers.
HELD = 1 << 25


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if printable in Latin-1, otherwise the next one from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return [other.get(b, chr(b)) for b in range(256)]


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a line for each, the token in base 64."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merging the bytes of a token by ranks below its own leaves; none if more parts are left."""
    parts, limit = [token[i:i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        found = min(((ranks.get(a + b, limit), at) for at, (a, b) in enumerate(zip(parts, parts[1:]))), default=(limit, 0))
        if found[0] >= limit:
            return None
        at = found[1]
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return tuple(parts)


class ByteTokens:
    """Encoder and decoder for the ranks in a file's content, with every match of a pattern encoded by itself."""

    def __init__(self, content: bytes, pattern: str = PATTERN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel
        ranks = read_ranks(content)
        chars = byte_characters()
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte is missing from the vocabulary")
        name = lambda token: "".join(chars[b] for b in token)
        pairs = ((last_pair(t, ranks) for t in sorted(ranks, key=ranks.get) if len(t) > 1))
        merges = [(name(p[0]), name(p[1])) for p in pairs if p]
        self.model = Tokenizer(BPE({name(t): r for t, r in ranks.items()}, merges))
        # Matches of the pattern come one by one, so the library only has to map bytes to characters and merge.
        self.model.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces, self.safe_cut = regex.compile(pattern), regex.compile(r"(?<=\S)(?=\s)")
        self.known, self.held = {}, 0
        byte_of = {c: b for b, c in enumerate(chars)}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in self.model.get_vocab().items()}

    def parts(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern in a text, in lists of bounded length."""
        at = 0
        while at < len(text):
            cut = self.safe_cut.search(text, at + PART) if len(text) - at > PART else None
            to = cut.start() if cut else len(text)
            yield self.pieces.findall(text[at:to])
            at = to

    def _learn(self, pieces: list[str], offsets: bool) -> None:
        """Have the library encode the pieces that are not known yet, all at once."""
        if self.held > HELD:
            self.known.clear()
            self.held = 0
        new = [p for p in dict.fromkeys(pieces) if p not in self.known or offsets and self.known[p][1] is None]
        found = (self.model.encode_batch if offsets else self.model.encode_batch_fast)(new, add_special_tokens=False)
        for piece, one in zip(new, found):
            self.known[piece] = np.array(one.ids, "<u4").tobytes(), np.array(one.offsets, np.int64).reshape(-1, 2) if offsets else None
            self.held += len(piece) + 64

    def encode(self, text: str, offsets: bool = False) -> tuple[bytes, np.ndarray | None]:
        """Ids as little-endian unsigned 32-bit integers, and with ``offsets`` each token's first character and the one behind its last."""
        ids, places, start = [], [np.empty((0, 2), np.int64)], 0
        for pieces in self.parts(text):
            self._learn(pieces, offsets)
            found = [self.known[p] for p in pieces]
            ids.append(b"".join([i for i, _ in found]))
            for piece, (_, place) in zip(pieces, found) if offsets else ():
                places.append(place + start)
                start += len(piece)
        return b"".join(ids), np.concatenate(places) if offsets else None

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids, each token's characters mapped back; what is split over tokens is whole again."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def _tokens(content: bytes, pattern: str) -> ByteTokens:
    return ByteTokens(content, pattern)


def encode(docs: DataFrame, rank_path: str, pattern: str = PATTERN, with_tokens: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row; ``with_tokens`` adds ``ids``, ``starts`` and ``ends``.

    Null texts count as empty: no ids. Repeated rows are encoded alike, extra columns are ignored, an empty table gives an
    empty result. Strings of special tokens are ordinary text. The decoded bytes are those of the ids, never of the text.
    Long texts are encoded in parts; a piece that the pattern does not cut is one part at any length.
    """
    with open(rank_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [tokens.encode(t, with_tokens) for t in part["text"].to_pylist()]
                columns = {"doc_id": part["doc_id"], "n_tokens": pa.array([len(i) // 4 for i, _ in found], pa.int64()),
                           "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i, _ in found], pa.string()),
                           "decoded_sha256": pa.array([hashlib.sha256(tokens.decode(i)).hexdigest() for i, _ in found], pa.string())}
                if with_tokens:
                    columns["ids"] = pa.array([np.frombuffer(i, "<i4") for i, _ in found], pa.list_(pa.int32()))
                    for name, side in (("starts", 0), ("ends", 1)):
                        columns[name] = pa.array([p[:, side] for _, p in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, schema + (", ids array<int>, starts array<long>, ends array<long>" if with_tokens else ""))


def decode(rows: DataFrame, rank_path: str, pattern: str = PATTERN) -> DataFrame:
    """``(doc_id, decoded binary, decoded_text)`` from ``(doc_id, ids array<int>)``; null ids give nulls.

    Bytes that are no UTF-8, as where ids end inside a character, are kept in ``decoded`` and replaced in ``decoded_text``.
    """
    with open(rank_path, "rb") as file:
        shared = rows.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                data = [None if i is None else tokens.decode(np.array(i, "<u4").tobytes()) for i in part["ids"].to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part["doc_id"], "decoded": pa.array(data, pa.binary()),
                    "decoded_text": pa.array([None if d is None else d.decode("utf-8", "replace") for d in data], pa.string())})
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded binary, decoded_text string")
