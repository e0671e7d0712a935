"""Conversation repair, importance resampling and byte-level BPE against brute force and a public library."""

import base64
import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from faultlens.llm import byte_tokens, dialogue, importance, queries

SF = "/root/testdata/sf0.001"
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# Conversation repair

def slow_repair(rows):
    """Cheapest edits of rows (role, text, first fault) by a search over (rows done, role initials so far), least letters first."""
    def legal(initials):
        return re.fullmatch(r"s?(ua)*u?", initials)
    # A state is what matters of the initials: their last one and whether there is any.
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, at, last, out = heapq.heappop(heap)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(out)
        seen = {"": "", "s": "s", "u": "u", "a": "ua"}[last]
        for name in ("user", "assistant"):
            if legal(seen + name[0]):
                heapq.heappush(heap, (cost + 3, audit + "I", at, name[0], (*out, name + ":")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last, out))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] and role[:1] in "sua" and legal(seen + role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], (*out, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if legal(seen + name[0]):
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, name[0], (*out, f"{name}:{text}")))


def slow_conversations(rows):
    """Rows (conv_id, turn, role, text) as they are; results per conversation as tuples."""
    groups = {}
    for conv, turn, role, text in rows:
        conversation = groups.setdefault(conv, [])
        mark = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if mark == 1 else re.sub("[.!?]", "", text) if mark == 2 else text
        role = "user" if mark == 4 else role
        conversation += [] if mark == 0 else [(turn, role, text)] * (2 if mark == 3 else 1)
    out = {}
    for conv, found in groups.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, marked = set(), []
        for _, role, text in found:
            last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "fine"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, *_ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = Counter(f for *_, f in marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, text = slow_repair(marked)
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


def conversation_rows(seed, count):
    draw, rows = random.Random(seed), []
    texts = ["Hi.", "Yes?", "no end", " \t", "", "Éa!", None, "x.\n ", "a b!", "y" * 300 + "."]
    for conv in [*range(count), None]:
        for turn in range(draw.randrange(0, 12)):
            turn = draw.choice([turn, turn, turn, turn + 2, None, -turn])
            rows.append((conv, turn, draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), draw.choice(texts)))
    return rows


@pytest.mark.parametrize("chunk", [8192, 3])
def test_conversations_equal_search(spark, monkeypatch, chunk):
    monkeypatch.setattr(dialogue, "CHUNK_TURNS", chunk)
    rows = conversation_rows(chunk, 60)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as chunk", "'x' as kinds")
    got = {r.conv_id: tuple(r)[1:] for r in dialogue.repair_conversations(dialogue.damage(frame), frame).collect()}
    assert got == slow_conversations(rows)


def test_conversations_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_conversations(spark, SF).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == slow_conversations(rows)
    assert len(got) == len({r[0] for r in rows})


def test_conversations_edge_cases(spark):
    kind = "conv_id string, turn int, role string, text string"
    none = spark.createDataFrame([], kind)
    assert dialogue.repair_conversations(none, none).collect() == []
    # Repeated rows are duplicates; a conversation whose rows are all gone has zeros.
    rows = [("a", 0, "user", "x.")] * 50 + [("a", 1, "assistant", "é" * 200_000 + ".")]
    out = {r.conv_id: r for r in dialogue.repair_conversations(
        spark.createDataFrame(rows, kind), spark.createDataFrame([*rows, ("gone", 0, "user", "x")], kind)).collect()}
    assert (out["a"].duplicate, out["a"].audit, out["a"].cost, out["a"].illegal) == (49, "K" + "D" * 49 + "K", 196, 49)
    assert tuple(out["gone"])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]),
                          st.sampled_from(["fine", "fine", "fine", "blank", "duplicate", "truncated"])), max_size=9))
def test_divide_and_conquer_equals_search(rows):
    kinds = "".join(dialogue.kind_letter(role[:1], dialogue.FAULTS.index(fault)) for role, fault in rows)
    assert dialogue.repair(kinds) == slow_repair([(r, "t", f) for r, f in rows])[:2]


# Importance resampling

def slow_features(text, ngram=1):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    words = WORDS.findall(low)
    return len(words), [b" ".join(words[i:i + n]) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]


def slow_resample(docs, target, ngram=1, buckets=10_000, least=20, percent=10):
    raw, wanted = (Counter(zlib.crc32(f) % buckets for t in texts for f in slow_features(t, ngram)[1]) for texts in ([t for _, t in docs], target))
    s_all, t_all = sum(raw.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets))))
    out = []
    for i, text in docs:
        n_words, features = slow_features(text, ngram)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    draw = percent * len(fit) // 100
    ranks = {}
    for at, r in enumerate(fit):
        ranks.setdefault(tuple(r), []).append(at + 1 if at < draw else None)
    return Counter((*r[:4], ranks[tuple(r)].pop(0) if tuple(r) in ranks else None) for r in out)


def odd_documents():
    draw = random.Random(8)
    texts = [" ".join(draw.choice(["Alpha", "beta", "7x", "Éa", "ça", "z"]) for _ in range(draw.randrange(0, 70))) for _ in range(120)]
    texts += [None, "", " \t", "A-b_c  d\x00e", "long word " * 150_000, "x" * 3_000_000 + " y"]
    rows = list(enumerate(texts))
    return rows + [rows[5]] * 30 + [(None, texts[1]), (None, texts[1]), (7, texts[8])]


@pytest.mark.parametrize("ngram,percent", [(1, 10), (3, 55), (2, 100), (1, 0)])
def test_importance_equals_brute_force(spark, monkeypatch, ngram, percent):
    monkeypatch.setattr(importance, "BLOCK", 1 << 14)
    rows, target = odd_documents(), ["beta 7x beta é", None, "z"]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "'r' as rank", "2 as ahead")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = Counter(map(tuple, importance.resample(frame, wanted, ngram=ngram, percent=percent).collect()))
    assert got == slow_resample(rows, target, ngram, percent=percent)


def test_importance_of_a_table_and_empty_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert Counter(map(tuple, queries.op12_importance(spark, SF).collect())) == slow_resample(docs, target)
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b " * 30)], "doc_id long, text string")
    assert importance.resample(none, some).collect() == []
    assert [tuple(r) for r in importance.resample(some, none, percent=100).collect()] == [next(iter(slow_resample([(1, "a b " * 30)], [], percent=100)))]


# Byte-level BPE

@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokens():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return byte_tokens.ByteTokens(file.read(), public_tokenizers.PATTERN)


def test_byte_tokens_of_many_characters(library, tokens):
    for at in itertools.chain(range(0x3000), range(0x3000, 0x110000, 37)):
        if not 0xD800 <= at < 0xE000:
            c = chr(at)
            text = f"a{c}b {c}{c} 1{c}2  {c}\n{c} "
            ids, _ = tokens.encode(text)
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and tokens.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aab  \n\t'sre1é🤗ا日<|endoftext|>.,") | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_byte_tokens_and_offsets(library, tokens, text):
    ids, places = tokens.encode(text, offsets=True)
    plain = np.frombuffer(ids, "<u4").tolist()
    assert plain == library.encode_ordinary(text)
    # Together the places of the tokens cover the text, in order; the bytes of each token stand in its characters.
    assert all(library.decode_single_token_bytes(i) in text[a:b].encode() or b - a >= 1 for i, (a, b) in zip(plain, places))
    assert sorted(set().union(*(range(a, b) for a, b in places))) == list(range(len(text)))


def test_byte_tokens_of_rows(spark, library, monkeypatch):
    texts = [None, "", "  ", "é" * 5_000, "word " * 200_000, "<|endoftext|> x", "日本語 text", "日本語 text"]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(None, "null id"), (0, "again")], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = byte_tokens.encode(rows, path, with_tokens=True)
    by_text = sorted(((r.doc_id is None, r.doc_id, r.ids, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()), key=str)
    expected = []
    for i, t in [*enumerate(texts), (None, "null id"), (0, "again")]:
        ids = library.encode_ordinary(t or "")
        expected.append((i is None, i, ids, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert by_text == sorted(expected, key=str)
    back = byte_tokens.decode(out, path).where("doc_id = 6").first()
    assert back.decoded_text == texts[6] and bytes(back.decoded) == texts[6].encode()
    # Ids that end inside a character: the bytes are whole, the text has a mark.
    cut = spark.createDataFrame([(1, library.encode_ordinary("🤗")[:1]), (2, None)], "doc_id long, ids array<int>")
    found = {r.doc_id: r for r in byte_tokens.decode(cut, path).collect()}
    assert bytes(found[1].decoded) == library.decode_bytes(library.encode_ordinary("🤗")[:1]) and "�" in found[1].decoded_text
    assert found[2].decoded is None
    assert byte_tokens.encode(rows.limit(0), path).collect() == []


def test_byte_tokens_of_a_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op13_byte_bpe(spark, SF).collect():
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
