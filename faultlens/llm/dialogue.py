"""Repair of conversation structure by Hirschberg's divide and conquer over four states.

A repaired conversation reads ``(s?(ua)+)?`` in role initials. Its state after a row is the start, system, user or
assistant. Every row takes one edit, and rows may be put in before it; letters of a row (``I`` for each row put in, then
``K``, ``R`` or ``D``) form a prefix-free code, so two ways to the same row are ordered by their letters so far. Forward
vectors hold the least cost of each state and the order of their letters, backward vectors the least cost to go. Both
meet in the middle of the conversation; of the cheapest crossings the one with the least letters is taken, and each half
is solved in the same way. Memory grows with the length, not with the length times the states.

Long conversations are cut by turns into chunks. A chunk is summed up by what each of the four states becomes behind it, the
sums of a conversation are crossed first, and then each chunk is solved by itself between two known states.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import SLICE
from faultlens.session import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS, FAULTS = "sua ", ("fine", "blank", "duplicate", "truncated")
#: Turns that a chunk of a conversation spans.
CHUNK_TURNS = 8192
_TURN_OF = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("a", USER): ASSISTANT, ("u", ASSISTANT): USER}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_STATES, _FAR = range(4), 1 << 60

Vector = tuple[tuple[int, int], ...]


def kind_letter(initial: str, fault: int) -> str:
    """One letter for a row: its role initial (anything else as the last of INITIALS) and its first fault."""
    return chr(65 + 4 * fault + (INITIALS.find(initial) if initial in "sua" and initial else 3))


@lru_cache(maxsize=None)
def edits(kind: str) -> dict[tuple[int, int], tuple[int, str]]:
    """``(state before, state after) -> (cost, letters)``: the cheapest way over a row of a kind, of equal ones the least."""
    fault, initial = divmod(ord(kind) - 65, 4)
    best = {}
    for before in _STATES:
        state = before
        # More than two rows put in between others return to a state that was there for less.
        for put in range(3):
            ways = [(state, DELETE, "D")]
            if FAULTS[fault] not in ("blank", "duplicate"):
                more = TRUNCATED if FAULTS[fault] == "truncated" else 0
                ways.append((_TURN_OF[state], REROLE + more, "R"))
                if (INITIALS[initial], state) in _KEPT:
                    ways.append((_KEPT[INITIALS[initial], state], KEEP + more, "K"))
            for after, cost, letter in ways:
                way = (put * INSERT + cost, "I" * put + letter)
                best[before, after] = min(best.get((before, after), way), way)
            state = _TURN_OF[state]
    return best


#: Rows put in behind the last one, by state: what is left to make the conversation whole.
_END = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


def _settled(found: list[tuple[int, tuple]]) -> tuple[Vector, int]:
    """Costs less their least, and ranks in place of the keys by which letters are ordered."""
    least = min(cost for cost, _ in found)
    order = {key: at for at, key in enumerate(sorted({key for cost, key in found if cost < _FAR}))}
    return tuple((cost - least, order[key]) if cost < _FAR else (_FAR, -1) for cost, key in found), least


def _onward(vector: Vector, ways: dict[tuple[int, int], tuple[int, tuple]]) -> tuple[Vector, int]:
    """A forward vector behind the ways ``(before, after) -> (cost, order of letters)``, and the cost taken out of it."""
    found = []
    for after in _STATES:
        options = [(vector[b][0] + ways[b, after][0], (vector[b][1], ways[b, after][1]))
                   for b in _STATES if (b, after) in ways and vector[b][0] < _FAR]
        found.append(min(options, default=(_FAR, ())))
    return _settled(found)


@lru_cache(maxsize=1 << 16)
def _forward(vector: Vector, kind: str) -> tuple[Vector, int]:
    return _onward(vector, edits(kind))


@lru_cache(maxsize=1 << 16)
def _backward(vector: tuple[int, ...], kind: str) -> tuple[int, ...]:
    ways = edits(kind)
    found = [min((ways[b, a][0] + vector[a] for a in _STATES if (b, a) in ways and vector[a] < _FAR), default=_FAR) for b in _STATES]
    least = min(found)
    return tuple(c - least if c < _FAR else _FAR for c in found)


def _only(state: int) -> Vector:
    return tuple((0, 0) if s == state else (_FAR, -1) for s in _STATES)


def forward(kinds: str, state: int) -> tuple[Vector, int]:
    """What a state becomes behind rows: least costs and order of letters per state, and the cost common to all."""
    vector, total = _only(state), 0
    for kind in kinds:
        vector, cost = _forward(vector, kind)
        total += cost
    return vector, total


def solve(kinds: str, before: int, after: int) -> str:
    """The letters of the cheapest edits of some rows between two states, of equal ones the least."""
    if not kinds:
        return ""
    if len(kinds) == 1:
        return edits(kinds)[before, after][1]
    half = len(kinds) // 2
    front, _ = forward(kinds[:half], before)
    back = tuple(0 if s == after else _FAR for s in _STATES)
    for kind in reversed(kinds[half:]):
        back = _backward(back, kind)
    middle = _crossing(front, back)
    return solve(kinds[:half], before, middle) + solve(kinds[half:], middle, after)


def _crossing(front: Vector, back: tuple[int, ...]) -> int:
    return min((s for s in _STATES if front[s][0] < _FAR and back[s] < _FAR), key=lambda s: (front[s][0] + back[s], front[s][1]))


def crossings(sums: list[dict[tuple[int, int], tuple[int, int]]]) -> tuple[list[int], int]:
    """States before each chunk and behind the last, and the whole cost, from the sums of all chunks of a conversation.

    A sum is what ``forward`` makes of each state: ``(before, after) -> (cost, order among the ways from that state)``.
    """
    def between(low: int, high: int, before: int, after: int) -> list[int]:
        if high - low < 2:
            return [before] if high > low else []
        half = (low + high) // 2
        front = _only(before)
        for one in sums[low:half]:
            front, _ = _onward(front, one)
        back = tuple(0 if s == after else _FAR for s in _STATES)
        for one in reversed(sums[half:high]):
            back = tuple(min((one[b, a][0] + back[a] for a in _STATES if (b, a) in one), default=_FAR) for b in _STATES)
        middle = _crossing(front, back)
        return between(low, half, before, middle) + between(half, high, middle, after)
    front, total = _only(START), 0
    for one in sums:
        front, cost = _onward(front, one)
        total += cost
    last = _crossing(front, tuple(_END[s][0] for s in _STATES))
    return between(0, len(sums), START, last) + [last], total + front[last][0] + _END[last][0]


def repair(kinds: str) -> tuple[int, str]:
    """Cost and letters of the repair of a whole conversation, given the kinds of its rows."""
    front, total = forward(kinds, START)
    last = _crossing(front, tuple(_END[s][0] for s in _STATES))
    return total + front[last][0] + _END[last][0], solve(kinds, START, last) + _END[last][1]


def damage(rows: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` with faults put in, by the checksum of ``conv_id:turn``; nulls read as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    mark = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(mark == 1, "").when(mark == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return rows.where(mark != 0).select(
        "conv_id", "turn", F.when(mark == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"),
        F.explode(F.when(mark == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")).drop("again")


def _digests(rows: DataFrame) -> DataFrame:
    """``(conv_id, chunk, turn, role, key, initial, blank, cut)``: what the faults of a row follow from, without its text."""
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    return rows.select("conv_id", _chunk().alias("chunk"), "turn", "role", F.unhex(F.md5("text")).alias("key"),
                       F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"),
                       (~last.isin(".", "!", "?")).alias("cut"))


def _chunk() -> Column:
    return F.floor(F.col("turn") / F.lit(CHUNK_TURNS)).cast("long")


def _kinds(rows: DataFrame) -> DataFrame:
    """``(conv_id, chunk, kinds, low, high, turns)``: a letter per row in order, and what the gaps follow from.

    Equal rows of a turn are counted before they are shuffled, and a text of a role is old where it stood before, so
    neither a repeated row nor a text that a conversation repeats often meets in one task.
    """
    same = ["conv_id", "chunk", "turn", "role", "key", "initial", "blank", "cut"]
    counted = stage(_digests(rows).groupBy(*same).agg(F.count("*").alias("copies")), "turns")
    firsts = counted.groupBy("conv_id", "role", "key").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    firsts = firsts.select(F.col("conv_id").alias("conv__"), F.col("role").alias("role__"), F.col("key").alias("key__"), "first")
    marked = counted.join(firsts, F.col("conv_id").eqNullSafe(F.col("conv__")) & (F.col("role") == F.col("role__")) & (F.col("key") == F.col("key__")))
    new = F.struct(F.col("turn").isNotNull(), F.col("turn")).eqNullSafe(F.col("first"))
    place = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    letter = lambda fault: F.char((65 + 4 * fault + place).cast("long"))
    own = F.when(F.col("blank"), letter(F.lit(1))).when(~new, letter(F.lit(2))).when(F.col("cut"), letter(F.lit(3))).otherwise(letter(F.lit(0)))
    more = F.when(F.col("blank"), letter(F.lit(1))).otherwise(letter(F.lit(2)))
    letters = F.concat(own, F.repeat(more, (F.col("copies") - 1).cast("int")))
    item = F.struct("turn", "role", "key", letters.alias("letters"))
    return marked.groupBy("conv_id", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["letters"]), "").alias("kinds"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.countDistinct("turn").alias("turns"))


_SUM = ("conv_id string, chunk long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, "
        "first string, last string, costs array<long>, ranks array<long>")
_LEGAL = {"su", "ua", "au"}


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["blank", "duplicate", "truncated", "illegal", "first", "last", "costs", "ranks"]
    for part in _slices(batches):
        out = []
        for kinds in part["kinds"].to_pylist():
            ways = [forward(kinds, s) for s in _STATES]
            initials = "".join(INITIALS[(ord(k) - 65) % 4] for k in kinds)
            faults = Counter((ord(k) - 65) // 4 for k in kinds)
            out.append((faults[1], faults[2], faults[3], sum(initials[i:i + 2] not in _LEGAL for i in range(len(initials) - 1)),
                        initials[0], initials[-1], [min(c + total, _FAR) for vector, total in ways for c, _ in vector],
                        [r for vector, _ in ways for _, r in vector]))
        kept = {c: part[c] for c in ("conv_id", "chunk", "low", "high", "turns")}
        yield pa.RecordBatch.from_pydict(kept | dict(zip(names, map(list, zip(*out)))))


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        out = []
        for conv, chunks in zip(part["conv_id"].to_pylist(), part["chunks"].to_pylist()):
            sums = [{divmod(i, 4): (c, r) for i, (c, r) in enumerate(zip(x["costs"], x["ranks"])) if c < _FAR} for x in chunks]
            states, cost = crossings(sums)
            out += [(conv, chunk["chunk"], states[nth], states[nth + 1], nth + 1 == len(chunks), cost) for nth, chunk in enumerate(chunks)]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                         ["conv_id", "chunk", "before", "after", "ends", "cost"])


class _Repaired:
    """Hash and letters of a conversation whose rows come one by one."""

    def __init__(self, conv: str | None):
        self.conv, self.state, self.digest, self.written, self.audit = conv, START, hashlib.sha256(), False, []

    def plan(self, kinds: str, before: int, after: int, ends: bool) -> None:
        self.letters, self.place, self.rows_left = solve(kinds, before, after) + (_END[after][1] if ends else ""), 0, len(kinds)
        self.audit.append(self.letters)

    def write(self, role: str, text: str) -> None:
        self.digest.update(("\n" * self.written + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.written = True

    def put_in(self) -> None:
        while self.place < len(self.letters) and self.letters[self.place] == "I":
            self.state, self.place = _TURN_OF[self.state], self.place + 1
            self.write(_NAMES[self.state], "")

    def row(self, role: str, text: str) -> None:
        self.put_in()
        letter = self.letters[self.place]
        self.place, self.rows_left = self.place + 1, self.rows_left - 1
        if letter == "R":
            self.state = _TURN_OF[self.state]
            self.write(_NAMES[self.state], text)
        elif letter == "K":
            self.state = _KEPT[role[:1], self.state]
            self.write(role, text)
        if not self.rows_left:
            self.put_in()


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and audit of each conversation of a task, whose plans and rows come in order; texts are held slice by slice."""
    def done(found: list[_Repaired]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (
            [f.conv for f in found], ["".join(f.audit) for f in found], [f.digest.hexdigest() for f in found])],
            ["conv_id", "audit", "repaired_sha256"])
    now = None
    for part in _slices(batches):
        ended = []
        for conv, kinds, before, after, ends, role, text in zip(*(part[c].to_pylist() for c in (
                "conv_id", "kinds", "before", "after", "ends", "role", "text"))):
            if kinds is None:
                now.row(role, text)
                continue
            if now is None or now.conv != conv:
                ended += [now] if now else []
                now = _Repaired(conv)
            now.plan(kinds, before, after, ends)
        yield done(ended)
    if now:
        yield done([now])


def repair_conversations(rows: DataFrame, all_ids: DataFrame | None = None) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` per conversation.

    Rows ``(conv_id, turn, role, text)`` go by turn, nulls first; rows of one turn by role, then by the MD5 of the text. Nulls
    of role and text read as one space, the null ``conv_id`` is a conversation of its own. Repeated rows are duplicates
    of the first. Extra columns are ignored. ``all_ids`` names conversations that may have lost all rows: zeros, an empty
    audit and the hash of the empty string. An empty table gives an empty result.

    Faults and edits are found without texts and in chunks of turns, wherever a conversation is long. A hash runs over a
    conversation from its first byte to its last, so its rows pass one task, sorted, one at a time.
    """
    kind = rows.schema["conv_id"].dataType
    rows = rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    chunks = stage(_kinds(rows), "conversation-chunks")
    sums = chunks.mapInArrow(_sum_up, _SUM)
    item = F.struct(F.col("chunk").isNotNull().alias("timed"), *[c for c in sums.columns if c != "conv_id"])
    whole = stage(sums.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("chunks")), "conversation-sums")
    crossed = stage(whole.select("conv_id", F.transform("chunks", lambda x: F.struct(x["chunk"], x["costs"], x["ranks"])).alias("chunks"))
                    .mapInArrow(_cross, "conv_id string, chunk long, before int, after int, ends boolean, cost long"), "crossings")
    known = crossed.withColumnRenamed("conv_id", "conv__").withColumnRenamed("chunk", "chunk__")
    plans = chunks.join(known, F.col("conv_id").eqNullSafe(F.col("conv__")) & F.col("chunk").eqNullSafe(F.col("chunk__"))).select(
        "conv_id", "chunk", "kinds", "before", "after", "ends", F.lit(0).alias("row"))
    texts = rows.select("conv_id", _chunk().alias("chunk"), "turn", "role", "text", F.unhex(F.md5("text")).alias("key"), F.lit(1).alias("row"))
    stream = plans.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(
        "conv_id", "chunk", "row", "turn", "role", "key")
    hashed = stream.select("conv_id", "kinds", "before", "after", "ends", "role", "text").mapInArrow(
        _rewrite, "conv_id string, audit string, repaired_sha256 string").withColumnRenamed("conv_id", "hashed__")
    total = lambda name: F.aggregate("chunks", F.lit(0).cast("long"), lambda s, x: s + x[name])
    seam = lambda a, b: (~F.concat(a["last"], b["first"]).isin(*_LEGAL)).cast("long")
    seams = F.aggregate(F.zip_with(F.slice("chunks", 1, F.size("chunks") - 1), F.slice("chunks", 2, F.size("chunks")), seam),
                        F.lit(0).cast("long"), lambda s, x: s + x)
    gaps = F.array_max("chunks.high") - F.array_min("chunks.low") + 1 - total("turns")
    counts = whole.select("conv_id", F.coalesce(gaps, F.lit(0)).alias("gaps"), *[total(n).alias(n) for n in ("blank", "duplicate", "truncated")],
                          (total("illegal") + seams).alias("illegal"))
    costs = crossed.where("ends").select(F.col("conv_id").alias("conv__"), "cost")
    out = counts.join(costs, F.col("conv_id").eqNullSafe(F.col("conv__"))).drop("conv__")
    out = out.join(hashed, F.col("conv_id").eqNullSafe(F.col("hashed__"))).drop("hashed__")
    if all_ids is not None:
        named = all_ids.select(F.col("conv_id").cast("string").alias("any_id")).distinct()
        out = named.join(out, F.col("any_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("any_id", "conv_id")
    numbers = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv_id").cast(kind).alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
