"""SimHash near-duplicates: fingerprints of word shingles, compared exactly tile by tile.

Distinct fingerprints form tiles of one population count each. Two fingerprints within the radius have population
counts within the radius, so other tile pairs are skipped. In a pair of tiles the same holds for the counts of the four
16-bit parts, summed; what remains is compared with numpy exclusive-or and bit counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import components, map_arrow, map_pandas, packed, schema_of
from faultlens.session import stage, unstage

SEED = 42
#: Fingerprints that a tile holds on average at most.
TILE = 32_768
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_HASH_BLOCK = 65_536
_CELLS = 1 << 22
#: Near copies: similarity in percent, words of a fingerprint, and the bits of all words and of the first one within which it
#: proposes a pair. At 80 percent a bit differs with 0.15 to 0.19, so either bound is four standard deviations off or more.
NEAR_PERCENT, WORDS, NEAR_RADIUS, FIRST_RADIUS = 80, 4, 72, 25
_PRINT = [f"f{i}" for i in range(WORDS)]
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Fingerprints of such a tile at most, and shingles of a block of a loose group on average.
NEAR_TILE, BLOCK_SHINGLES = 131_072, 1 << 21
#: Chance that two sets just similar enough share none of the shingles by which they meet; sets that meet in one task at most;
#: sets of a shingle that are compared together with other shingles' sets.
LOW_MISS, LOW_TILE, LOW_FEW = 1e-7, 16_384, 64


def fingerprint(text: str | None, width: int) -> int:
    """64-bit fingerprint; null and texts without words give zero, short texts are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    n = len(words) - width + 1
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    first, last = starts[:n].tolist(), ends[width - 1:].tolist()
    for at in range(0, n, _HASH_BLOCK):
        part = [digest(joined[s:e], SEED) for s, e in zip(first[at:at + _HASH_BLOCK], last[at:at + _HASH_BLOCK])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """One row ``(id_col, fp bigint)`` per document, by a map over whole texts."""
    def make():
        def step(batch: pd.DataFrame) -> pd.DataFrame:
            prints = np.array([fingerprint(t, width) for t in batch["text"]], np.uint64).view(np.int64)
            return pd.DataFrame({"id": batch["id"], "fp": prints})
        return step
    kind = docs.schema[id_col].dataType.simpleString()
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_pandas(pairs, make, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


def _parts(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints.view("<u2").reshape(-1, 4)).astype(np.int8)


def _tile_links(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest that connects what the links between two tiles (or within one) connect: nodes and their smallest root."""
    nodes = np.unique(np.concatenate((left, right)))
    label = np.arange(len(nodes))

    def arranged(prints):
        parts = _parts(prints)
        order = np.lexsort(parts.T)
        prints, parts = prints[order], parts[order]
        new = np.concatenate(([0], np.flatnonzero((parts[1:] != parts[:-1]).any(1)) + 1))
        return prints, np.searchsorted(nodes, prints), parts[new], new, np.append(new[1:], len(prints))

    a, a_at, a_parts, a_from, a_to = arranged(left)
    b, b_at, b_parts, b_from, b_to = arranged(right)
    for parts, lo, hi in zip(a_parts, a_from, a_to):
        close = np.abs(b_parts - parts).sum(1, dtype=np.int16) <= radius
        pick = np.flatnonzero(np.repeat(close, b_to - b_from))
        rows = max(1, _CELLS // max(1, len(pick)))
        for at in range(lo, hi, rows):
            near = np.bitwise_count(a[at:min(at + rows, hi), None] ^ b[pick]) <= radius
            i, j = np.nonzero(near)
            x, y = a_at[at + i], b_at[pick[j]]
            while len(x):
                x_root, y_root = label[x], label[y]
                apart = x_root != y_root
                x, y, x_root, y_root = x[apart], y[apart], x_root[apart], y_root[apart]
                np.minimum.at(label, np.maximum(x_root, y_root), np.minimum(x_root, y_root))
                while (label != label[label]).any():
                    label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def links(prints: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` that connect the distinct fingerprints ``fp`` as all pairs within the radius would.

    The driver sees one count per population count (65 at most). A tile of a count is chosen by hash; its fingerprints
    travel once per partner tile. Each tile pair reports a forest, never all pairs of a group.
    """
    spark = prints.sparkSession
    counted = prints.select("fp", F.bit_count("fp").cast("int").alias("ones"))
    sizes = {r["ones"]: -(-r["count"] // tile) for r in counted.groupBy("ones").count().collect()}
    first, total = {}, 0
    for ones in sorted(sizes):
        first[ones], total = total, total + sizes[ones]
    if not total:
        return spark.createDataFrame([], "a bigint, b bigint")
    info = F.create_map(*[F.lit(v) for ones in sizes for v in (ones, sizes[ones])])
    start = F.create_map(*[F.lit(v) for ones in sizes for v in (ones, first[ones])])
    tiles = (counted.withColumn("tile", start[F.col("ones")] + F.pmod(F.xxhash64("fp"), info[F.col("ones")]).cast("int"))
             .groupBy("ones", "tile").agg(F.collect_list("fp").alias("fps")))
    partner = F.flatten(F.transform(F.sequence(F.col("ones") - radius, F.col("ones") + radius), lambda o: F.when(
        info[o].isNotNull(), F.sequence(start[o], start[o] + info[o] - 1)).otherwise(F.array().cast("array<int>"))))
    sides = tiles.withColumn("other", F.explode(partner)).select(
        F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), F.struct("tile", "fps").alias("side"))
    pairs = sides.groupBy("lo", "hi").agg(F.collect_list("side").alias("sides"))

    def make():
        def step(batch: pd.DataFrame) -> pd.DataFrame:
            found = [(np.empty(0, np.uint64),) * 2]
            for sides in batch["sides"]:
                tiles = [np.array(s["fps"], np.int64).view(np.uint64) for s in sides]
                found.append(_tile_links(tiles[0], tiles[-1], radius))
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
            return pd.DataFrame({"a": a, "b": b})
        return step
    cut = pairs.select("sides")
    return map_pandas(cut, make, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4,
                    tile: int = TILE) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable by links.

    Null and empty texts and texts of white space have fingerprint zero and are linked like any other. Repeated rows
    stay, each with the same result. A null id is never a component id unless the component has no other. Extra columns
    are ignored. An empty table gives an empty result.
    """
    prints = stage(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min(id_col).alias("least_id")), "distinct-fingerprints")
    found = components(stage(links(distinct, radius, tile), "tile-links"))
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted, "rooted")
    heads = stage(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "heads")
    mapped = stage(rooted.join(heads, "root").select("fp", "component_id"), "mapped")
    return prints.join(mapped, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text shorter than ``width`` words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest, width = b" ".join(words), xxhash.xxh64_intdigest, min(width, len(words))
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[:-1]]]
    found = {digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1:])}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def low_count(n: int, percent: int) -> int:
    """How many of its ``n`` shingles, smallest hash first, a set meets others by.

    Sets that are ``percent`` similar share one of the first ``n * (100 - percent) / 100 + 1`` in any order. In the order of a hash, each of
    the smallest of both sets together is shared with a chance of ``percent``, so fewer do for large sets: none is shared with LOW_MISS.
    """
    exact = n * (100 - percent) // 100 + 1
    return min(exact, math.ceil(math.log(LOW_MISS) / math.log(1 - percent / 100))) if 0 < percent < 100 else exact


def set_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The WORDS words of a fingerprint that counts each distinct shingle once, so that distances follow the Jaccard similarity.

    The bits of a shingle beyond its first 64 come from its hash, added to a multiple of a constant and mixed.
    """
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), _HASH_BLOCK):
        mixed = hashes[at:at + _HASH_BLOCK, None] + _STEP * np.arange(WORDS, dtype=np.uint64)
        mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((mixed ^ mixed >> np.uint64(31)).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")


def shingle_rows(texts: DataFrame, width: int, sets: bool = False, percent: int = NEAR_PERCENT) -> DataFrame:
    """``(id, key, node, n, low, f0 …)`` per row ``(id, key, text)``: hash, size, smallest shingles and fingerprint of its set, or the set itself."""
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingle_set(t, width) for t in batch["text"].to_pylist()]
            node = pa.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63) for h in found], pa.int64())
            if sets:
                return pa.RecordBatch.from_pydict({"node": node, "shingles": pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))})
            prints = np.array([set_fingerprint(h) for h in found]).view(np.int64).reshape(-1, WORDS)
            return pa.RecordBatch.from_pydict({"id": batch["id"], "key": batch["key"], "node": node, "n": pa.array([len(h) for h in found], pa.int64()),
                                               "low": pa.array([h[:low_count(len(h), percent)].view(np.int64) for h in found], pa.list_(pa.int64()))}
                                              | {c: prints[:, i].copy() for i, c in enumerate(_PRINT)})
        return step
    schema = "node bigint, shingles array<bigint>" if sets else (
        schema_of(texts, "id", "key") + ", node bigint, n bigint, low array<bigint>, " + ", ".join(f"{c} bigint" for c in _PRINT))
    return map_arrow(texts, make, schema)


def near(a: np.ndarray, b: np.ndarray, radius: int = NEAR_RADIUS, first: int = FIRST_RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, bits)`` of the fingerprints in rows of ``a`` and ``b`` that differ in at most ``radius`` bits, block by block.

    The first word goes over all pairs; the other words only over pairs within ``first`` bits of it.
    """
    rows = max(1, _CELLS // max(1, len(b)))
    for at in range(0, len(a), rows):
        bits = np.bitwise_count(a[at:at + rows, :1] ^ b[:, 0])
        i, j = np.nonzero(bits <= first)
        bits = bits[i, j].astype(np.int16)
        for word in range(1, a.shape[1]):
            bits += np.bitwise_count(a[at + i, word] ^ b[j, word])
        close = bits <= radius
        yield at + i[close], j[close], bits[close]


class Forest:
    """Groups of nodes, and links that connect each node to the smallest of its group."""

    def __init__(self, *nodes: np.ndarray):
        self.nodes = np.unique(np.concatenate(nodes))
        self.label = np.arange(len(self.nodes))

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            x_root, y_root = self.label[x], self.label[y]
            apart = x_root != y_root
            x, y, x_root, y_root = x[apart], y[apart], x_root[apart], y_root[apart]
            np.minimum.at(self.label, np.maximum(x_root, y_root), np.minimum(x_root, y_root))
            while (self.label != self.label[self.label]).any():
                self.label = self.label[self.label]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.nodes[moved], self.nodes[self.label[moved]]


def _columns(items: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and fingerprints of the rows of one side of a pair."""
    read = lambda c: items.field(c).to_numpy(zero_copy_only=False)
    return read("node"), np.stack([read(c) for c in _PRINT], 1).view(np.uint64)


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[start:end] for start, end in zip(at, at[1:])]


def _pairs(batch: pa.RecordBatch, solve: Callable[[pa.StructArray, pa.StructArray], tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The links of all pairs of sides in a batch."""
    found = [(np.empty(0, np.int64),) * 2]
    for sides in batch["sides"]:
        items = sides.values.field("items")
        found.append(solve(items[0].values, items[len(items) - 1].values))
    a, b = (np.concatenate(x) for x in zip(*found))
    return pa.RecordBatch.from_pydict({"a": a, "b": b})


def _met(tiles: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``(sides)`` for each pair of tiles, from rows with ``tile`` and the range ``low`` to ``high`` of tiles that it meets."""
    whole = tiles.groupBy(*keys, "tile", "low", "high").agg(F.collect_list(F.struct(*columns)).alias("items"))
    sides = whole.withColumn("other", F.explode(F.sequence("low", "high"))).select(
        *keys, F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), F.struct("tile", "items").alias("side"))
    return sides.groupBy(*keys, "lo", "hi").agg(F.collect_list("side").alias("sides")).where("lo = hi or size(sides) = 2").select("sides")


def near_prints(nodes: DataFrame, radius: int = NEAR_RADIUS, tile: int = NEAR_TILE) -> DataFrame:
    """Links ``(a, b)`` that connect the nodes ``(node, f0 …)`` as all pairs of fingerprints within ``radius`` bits would.

    Tiles hold a range of population counts; the driver sees a count for each of them (257 at most). Tiles whose population
    counts are further apart than the radius never meet. There are eight tiles unless rows are few or a tile would be too large.
    """
    ones = sum((F.bit_count(c) for c in _PRINT[1:]), F.bit_count(_PRINT[0])).cast("int")
    counted = nodes.select("node", *_PRINT, ones.alias("ones"))
    sizes = {r["ones"]: r["count"] for r in counted.groupBy("ones").count().collect()}
    total = sum(sizes.values())
    if not total:
        return nodes.sparkSession.createDataFrame([], "a bigint, b bigint")
    rows = -(-total // max(-(-total // tile), min(8, -(-total // 1024))))
    start, at, low_ones, high_ones = {}, 0, {}, {}
    for one in sorted(sizes):
        start[one] = at
        for t in range(at // rows, (at + sizes[one] - 1) // rows + 1):
            low_ones.setdefault(t, one)
            high_ones[t] = one
        at += sizes[one]
    meets = {t: [u for u in low_ones if low_ones[u] - high_ones[t] <= radius and low_ones[t] - high_ones[u] <= radius] for t in low_ones}
    ranges = nodes.sparkSession.createDataFrame([(t, min(u), max(u)) for t, u in meets.items()], "tile int, low int, high int")
    first = F.create_map(*[F.lit(v) for o in sizes for v in (o, start[o])])[F.col("ones")]
    many = F.create_map(*[F.lit(v) for o in sizes for v in (o, sizes[o])])[F.col("ones")]
    tiles = counted.withColumn("tile", F.floor((first + F.pmod(F.xxhash64("node"), many)) / F.lit(rows)).cast("int")).join(F.broadcast(ranges), "tile")

    def make():
        def solve(left, right):
            (a, a_print), (b, b_print) = _columns(left), _columns(right)
            forest = Forest(a, b)
            x, y = np.searchsorted(forest.nodes, a), np.searchsorted(forest.nodes, b)
            for i, j, _ in near(a_print, b_print, radius):
                forest.join(x[i], y[j])
            return forest.links()
        return lambda batch: _pairs(batch, solve)
    return map_arrow(_met(tiles, [], ["node", *_PRINT]), make, "a bigint, b bigint")


def _close(batch: pa.RecordBatch, radius: int) -> pa.RecordBatch:
    """A forest of the fingerprints within ``radius`` bits of each other in the pairs of sides of a batch.

    All short sides are worked off at once, by their distance in the list; the others one by one.
    """
    sides = batch["sides"]
    items = sides.flatten().field("items")
    nodes, prints = _columns(items.flatten())
    forest = Forest(nodes)
    at, sizes, many = np.searchsorted(forest.nodes, nodes), items.value_lengths().to_numpy(), sides.value_lengths().to_numpy()
    ends = np.cumsum(sizes)
    starts, first = ends - sizes, np.cumsum(many) - many
    short = np.zeros(len(sizes), bool)
    short[first[many == 1]] = True
    short &= sizes <= LOW_FEW
    end = np.repeat(np.where(short, ends, 0), sizes)
    i, apart = np.arange(len(nodes)), 1
    while len(i := i[i + apart < end[i]]):
        bits = np.bitwise_count(prints[i] ^ prints[i + apart])
        near_by = (bits[:, 0] <= FIRST_RADIUS) & (bits.sum(1, dtype=np.int16) <= radius)
        forest.join(at[i[near_by]], at[i[near_by] + apart])
        apart += 1
    for one, n in zip(first.tolist(), many.tolist()):
        if not short[one]:
            a, b = (slice(starts[k], ends[k]) for k in (one, one + n - 1))
            for x, y, _ in near(prints[a], prints[b], radius):
                forest.join(at[a][x], at[b][y])
    a, b = forest.links()
    return pa.RecordBatch.from_pydict({"a": a, "b": b})


def shared_low(nodes: DataFrame) -> DataFrame:
    """``(shingle, rows)`` of the shingles that more than one of the nodes ``(node, low)`` has among those it meets others by."""
    return nodes.select(F.explode("low").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("rows")).where("rows > 1")


def near_low(nodes: DataFrame, shared: DataFrame, radius: int = NEAR_RADIUS, tile: int = LOW_TILE) -> DataFrame:
    """Links ``(a, b)`` that connect the nodes ``(node, low, f0 …)`` as all pairs within ``radius`` bits that share a shingle of ``low`` would.

    ``shared`` has the shingles of more than one node with their counts. The nodes of a common one are cut into tiles by hash, and
    each pair of its tiles is compared by itself.
    """
    rows = nodes.select(F.explode("low").alias("shingle"), "node").join(shared.withColumnRenamed("rows", "all"), "shingle")
    blocks = F.ceil(F.col("all") / tile).cast("int")
    tiles = rows.select("shingle", "node", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("tile"), F.lit(0).alias("low"), (blocks - 1).alias("high"))
    # Few shingles are shared: only their nodes get fingerprints.
    tiles = tiles.join(nodes.select("node", *_PRINT), "node")
    met = _met(tiles.repartition("shingle", "tile"), ["shingle"], ["node", *_PRINT])
    return map_arrow(met, lambda: lambda batch: _close(batch, radius), "a bigint, b bigint", 64)


def _verified(left: pa.StructArray, right: pa.StructArray, percent: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs of two blocks whose sets are ``percent`` similar: nearest first, pairs already connected untested."""
    (a, a_print), (b, b_print) = _columns(left), _columns(right)
    a_set, b_set = (_lists(side.field("shingles")) for side in (left, right))
    a_n, b_n = np.array(list(map(len, a_set))), np.array(list(map(len, b_set)))
    forest = Forest(a, b)
    x, y = np.searchsorted(forest.nodes, a), np.searchsorted(forest.nodes, b)
    for i, j, bits in near(a_print, b_print, radius):
        fits = (100 * np.minimum(a_n[i], b_n[j]) >= percent * np.maximum(a_n[i], b_n[j])) & (forest.label[x[i]] != forest.label[y[j]])
        i, j, bits = i[fits], j[fits], bits[fits]
        for at in np.argsort(bits, kind="stable").tolist():
            p, q = x[i[at]], y[j[at]]
            if forest.label[p] == forest.label[q]:
                continue
            one, two = a_set[i[at]], b_set[j[at]]
            common = len(np.intersect1d(one, two, assume_unique=True))
            if 100 * common >= percent * (len(one) + len(two) - common):
                forest.join(np.array([p]), np.array([q]))
    return forest.links()


def near_links(texts: DataFrame, nodes: DataFrame, width: int, radius: int = NEAR_RADIUS, percent: int = NEAR_PERCENT,
               tile: int = NEAR_TILE, block: int = BLOCK_SHINGLES) -> DataFrame:
    """``(node, root)`` of the sets ``nodes`` that pairs of at least ``percent`` similarity connect.

    Fingerprints connect nodes that share one of their smallest shingles to loose groups first; where so many share them that this would
    be more comparisons than all pairs of nodes, those are compared. Only nodes in one of these have their sets made, each once. A group is
    cut into blocks of ``block`` shingles; every pair of its blocks is compared by itself, so no pair travels.
    """
    spark = texts.sparkSession
    shared = stage(shared_low(nodes), "shared-shingles")
    total, pairs = nodes.count(), shared.agg(F.sum(F.col("rows").cast("double") ** 2)).first()[0] or 0.0
    close = stage(near_low(nodes, shared, radius) if pairs <= total * total else near_prints(nodes, radius, tile), "near-prints")
    loose = stage(components(close), "loose-groups")
    unstage(spark, close, shared)
    members = stage(nodes.drop("low").join(loose, "node"), "members")
    totals = members.groupBy("root").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    wanted = members.select(F.col("rep.id").alias("id__"), F.col("rep.key").alias("key__"))
    own = texts.join(wanted, F.col("id").eqNullSafe(F.col("id__")) & (F.col("key") == F.col("key__")), "left_semi")
    sets = shingle_rows(own, width, sets=True).groupBy("node").agg(F.first("shingles").alias("shingles"))
    dealt = members.join(totals, "root").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select(
        "root", "node", *_PRINT, "tile", F.lit(0).alias("low"), (F.col("blocks") - 1).alias("high")).join(sets, "node")

    def make():
        return lambda batch: _pairs(batch, lambda left, right: _verified(left, right, percent, radius))
    met = _met(dealt, ["root"], ["node", *_PRINT, "shingles"])
    similar = stage(map_arrow(met, make, "a bigint, b bigint", 1), "similar")
    unstage(spark, loose, members)
    return components(similar)


def deduplicate(docs: DataFrame, width: int = 5, radius: int = NEAR_RADIUS, percent: int = NEAR_PERCENT, tile: int = NEAR_TILE,
                block: int = BLOCK_SHINGLES) -> DataFrame:
    """One document of each group stays: the one of smallest id, of that id the one of smallest content hash; nulls last.

    A group is what pairs of documents connect whose sets of ``width``-word shingles have a Jaccard similarity of at least
    ``percent``. Fingerprints of 64 * WORDS bits within ``radius`` propose the pairs of those that share a shingle of the smallest hashes, the sets decide. Of repeated rows of id
    and text one stays; texts that differ and share an id are documents of their own. Texts without a word are not near
    copies of each other here: they all stay. Other columns pass through, whatever their names.
    """
    spark = docs.sparkSession
    whole = packed(docs).select("doc", F.col("doc.doc_id").alias("id"), F.col("doc.text").alias("text"), F.xxhash64("doc.text").alias("key"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    texts = whole.where(worded).select("id", "key", "text")
    rows = stage(shingle_rows(texts, width, percent=percent), "shingle-rows")
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")
    nodes = stage(rows.groupBy("node", "n", "low", *_PRINT).agg(F.min(order).alias("rep"), F.count("*").alias("rows")), "nodes")
    roots = near_links(texts, nodes, width, radius, percent, tile, block)
    grouped = nodes.select("node", "rep", "rows").join(roots, "node", "left")
    heads = grouped.groupBy(F.coalesce("root", "node").alias("root__")).agg(F.min("rep").alias("head"), F.sum("rows").alias("all"))
    # Of a document that is alone nothing has to be said; the others are marked.
    heads = stage(heads.where("all > 1"), "heads")
    marked = grouped.select("node", F.coalesce("root", "node").alias("root__")).join(heads, "root__").select("node", "head")
    counted = rows.groupBy("id", "key", "node").agg(F.count("*").alias("rows")).join(marked, "node")
    gone = ~(F.col("id").eqNullSafe(F.col("head.id")) & (F.col("key") == F.col("head.key")))
    marks = stage(counted.where(gone | (F.col("rows") > 1)).select(
        F.col("id").alias("id__"), F.col("key").alias("key__"), gone.alias("gone")).distinct(), "marks")
    unstage(spark, rows, nodes, heads)
    found = whole.where(worded).join(marks, F.col("id").eqNullSafe(F.col("id__")) & (F.col("key") == F.col("key__")), "left")
    alone = found.where("gone is null").select("doc")
    once = found.where("not gone").dropDuplicates(["id", "key"]).select("doc")
    return alone.unionByName(once).unionByName(whole.where(~worded).select("doc")).select("doc.*")
