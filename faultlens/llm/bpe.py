"""BPE encoding by dynamic programming over prefixes, and decoding.

The last token of the encoding of a prefix is unique. An Aho-Corasick automaton of the vocabulary gives the tokens that end
at each byte; the longest one that is compatible with the last token of the prefix before it is stored. Following the
stored tokens from the end gives the ids that repeated merging would give, in time linear in the text. Aho-Corasick stands
in for a suffix automaton, as it reports the same tokens (those that end at a byte) and a compiled package of it is at hand.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import map_pandas

# Fixed value: the pattern that splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Split pieces whose ids a task remembers, the longest such piece, and the token pairs whose borders it remembers.
CACHE, CACHE_CHARS, PAIRS = 400_000, 32, 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if printable in Latin-1, else the next from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


class Encoder:
    """Encodes and decodes with the vocabulary, merges and added tokens of a tokenizer file's JSON."""

    def __init__(self, content: str):
        data = json.loads(content)
        letters = byte_letters()
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        self.words = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.words |= {i: t.encode() for t, i in self.special.items()}
        self.rank, self.halves, made = {}, {}, {}
        for order, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            pair = vocab[left], vocab[right]
            self.rank[pair] = order
            if vocab[left + right] not in made:
                made[vocab[left + right]] = order
                self.halves[vocab[left + right]] = pair
        self.made = made
        self.matches = ahocorasick.Automaton()
        special = set(self.special.values())
        for token, i in vocab.items():
            if i not in special:
                self.matches.add_word(bytes(letters[c] for c in token).decode("latin-1"), (len(token), i))
        self.matches.make_automaton()
        if len(set(letters) & set(vocab)) < 256 or max(vocab.values()) >= 1 << 20:
            raise ValueError("not a byte-level vocabulary of up to 2^20 tokens")
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces, self.known, self.pairs = regex.compile(PATTERN), {}, {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens keeps the border between them.

        The last merges of both are undone, newest first. A merge across the border would have come first if it ranks
        before the merge undone last; on equal rank the leftmost place merges first.
        """
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        holds = self.pairs[left << 20 | right] = self._border_holds(left, right)
        return holds

    def _border_holds(self, left: int, right: int) -> bool:
        made, halves, rank = self.made, self.halves, self.rank
        limit, from_left = len(rank), True
        while True:
            across = rank.get((left, right))
            if across is not None and (across < limit or across == limit and not from_left):
                return False
            a, b = made.get(left, -1), made.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, from_left, left = a, True, halves[left][1]
            elif b > a:
                limit, from_left, right = b, False, halves[right][0]
            else:
                limit, from_left, right = b, False, halves[right][0]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece: the last token of every prefix, then back from the end."""
        last, pairs = [-1] * len(data), self.pairs
        # At each end the automaton reports the longest token first.
        for end, (size, token) in self.matches.iter(data.decode("latin-1")):
            if last[end] >= 0:
                continue
            if size > end:
                last[end] = token
                continue
            left = last[end - size]
            holds = pairs.get(left << 20 | token)
            if self.compatible(left, token) if holds is None else holds:
                last[end] = token
        out, at = [], len(data) - 1
        while at >= 0:
            out.append(last[at])
            at -= len(self.words[last[at]])
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; strings of added tokens give their ids."""
        out, known = [], self.known
        parts = self.cuts.split(text) if self.cuts else [text]
        for nth, part in enumerate(parts):
            if nth % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            for piece in self.pieces.findall(part):
                ids = known.get(piece)
                if ids is None:
                    ids = array("I", self.piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
                    if len(piece) <= CACHE_CHARS:
                        if len(known) >= CACHE:
                            known.clear()
                        known[piece] = ids
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _encoder(content: str) -> Encoder:
    """The encoder of a Python process, which the tasks that it runs one after another share."""
    return Encoder(content)


def encode(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row, with ``with_ids`` also ``ids array<int>``.

    Null texts count as empty: no ids. Repeated rows are encoded alike; extra columns are ignored; an empty table gives an
    empty result. The tokenizer file is read on the driver and broadcast; vocabularies are bounded in size.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def make():
        encoder = _encoder(shared.value)

        def step(batch: pd.DataFrame) -> pd.DataFrame:
            ids = [encoder.encode(t or "") for t in batch["text"]]
            texts = [encoder.decode(i) for i in ids]
            out = pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(i) // 4 for i in ids],
                                "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                                "decoded_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]})
            if with_ids:
                out["ids"] = [np.frombuffer(i, "<i4") for i in ids]
            return out
        return step
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_pandas(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), make,
                      schema + (", ids array<int>" if with_ids else ""))
