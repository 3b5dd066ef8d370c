"""Near-duplicates by SimHash within a radius, verified by exact shingle similarity.

The fingerprints of all different sets of shingles meet in tiles of like size: of two sets with a Jaccard similarity of s the
smaller has at least s times as many shingles, so only such tiles meet, and there every pair is compared by exclusive-or and bit
counts.  Pairs within the radius form candidate groups, kept as spanning forests; inside a candidate group
links are verified by the sets themselves before they join anything."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small, stored, text_or_empty
from .simhash import Forest, components, majority, shingle_hashes

WIDTH, SIMILARITY = 5, 0.8
#: Fingerprints are four SimHashes of the set of shingles side by side.  Sets at similarity 0.8 are about 39 of 256 bits apart, give or
#: take 6; the chance that they are over 80 apart is under 1e-9 a pair (6e-7 where one has four shingles and the other these and one more).
WORDS, RADIUS = 4, 80
#: Fingerprints of a tile, classes of size to a step of the similarity, and comparisons of a task, about.
TILE, STEPS, WORK = 16384, 4, 1 << 26
#: Texts, and shingles, of a candidate group that one task verifies; larger groups are dealt in parts that meet two by two.
PART, PART_SHINGLES = 4096, 1 << 20
TILES = "cls int, part int, low int, high int, n bigint, nodes binary, fps binary, sizes binary"
MIX = [np.uint64(x) for x in (1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    return np.unique(shingle_hashes(text, width))


def node_of(found: np.ndarray) -> int:
    """Number of a set of shingles: equal sets are one node."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).view(np.int64))


def wide(hashes: np.ndarray) -> np.ndarray:
    """Four SimHashes of a set of shingles: of their hashes, and of these mixed in three ways."""
    out = [majority(hashes)]
    for m in MIX[1:]:
        x = (hashes ^ (hashes >> np.uint64(31))) * m
        out.append(majority(x ^ (x >> np.uint64(29))))
    return np.array(out, np.uint64)


def fewest(least: float) -> int:
    """Shingles that a set has at least if another set can be so similar to it: they share all but one of their union."""
    return ceil(least / (1 - least) - 1e-9) if least < 1 else 1


def candidates(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], radius: int, least: float) -> np.ndarray:
    """Edges, as rows of two nodes, of a spanning forest of the pairs of two tiles (nodes, fingerprints, sizes; by size) that fit in
    size and are within the radius."""
    (na, fa, sa), (nb, fb, sb) = a, b
    names, forest = np.concatenate([na, nb]), Forest(len(na) + len(nb))
    fa, fb = np.ascontiguousarray(fa.T), np.ascontiguousarray(fb.T)
    # the pairs of a block and their counts stay in the processor's cache, in memory taken once
    block = max(1, (1 << 16) // max(1, len(nb)))
    differ, first, more = np.empty(block * len(nb), np.uint64), np.empty(block * len(nb), np.uint8), np.empty(block * len(nb), np.uint8)
    for at in range(0, len(na), block):
        s = sa[at:at + block]
        low, high = np.searchsorted(sb, least * s[0] - 1e-9), np.searchsorted(sb, s[-1] / least + 1e-9, "right")
        if low == high:
            continue
        shape = len(s), high - low
        x, apart, count = (m[:shape[0] * shape[1]].reshape(shape) for m in (differ, first, more))
        # three words of four rule out nearly all
        for w in range(WORDS - 1):
            np.bitwise_xor(fa[w, at:at + block, None], fb[w, None, low:high], out=x)
            np.bitwise_count(x, out=count if w else apart)
            if w:
                apart += count
        met = np.flatnonzero(apart <= radius)
        i, j = np.divmod(met, shape[1])
        last = np.bitwise_count(fa[-1].take(i + at) ^ fb[-1].take(j + low))
        near = np.flatnonzero(last <= radius - apart.ravel().take(met).astype(np.int32))
        if not len(near):
            continue
        i, j = i[near] + at, j[near] + low
        fits = (np.minimum(sa[i], sb[j]) >= least * np.maximum(sa[i], sb[j]) - 1e-9) & (na[i] != nb[j])
        forest.join(i[fits], j[fits] + len(na))
    edges = np.stack([names[forest.roots(np.arange(len(names)))], names], axis=1)
    return edges[edges[:, 0] != edges[:, 1]]


def _tile(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["size", "node"])
    sizes = frame["size"].to_numpy("<i4")
    row = (int(frame["cls"].iloc[0]), int(frame["part"].iloc[0]), int(sizes[0]), int(sizes[-1]), len(sizes),
           frame["node"].to_numpy("<i8").tobytes(), b"".join(frame["fp"]), sizes.tobytes())
    return pd.DataFrame([row], columns=["cls", "part", "low", "high", "n", "nodes", "fps", "sizes"])


def _met(radius: int, least: float):
    """Rows of (cb, pb, role, tile), each right tile (role 0) followed by the left ones that it meets, to edges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = right = None
        for batch in batches:
            for cb, pb, role, *tile in zip(*batch.columns, strict=True):
                nodes, fps, sizes = (x.as_py() for x in tile)
                tile = np.frombuffer(nodes, "<i8"), np.frombuffer(fps, "<u8").reshape(-1, WORDS), np.frombuffer(sizes, "<i4")
                if role.as_py() == 0:
                    key, right = (cb, pb), tile
                    continue
                assert key == (cb, pb)
                edges = candidates(tile, right, radius, least)
                if len(edges):
                    yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])
        give_back()
    return run


def links(sets: DataFrame, radius: int = RADIUS, least: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect just what the pairs of sets (columns node, fp, size; stored) connect that fit in size and are within
    the radius.  Sets too small to be similar to another one are left out."""
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _met(radius, least)(batches)

    step = log(1 / least) / STEPS if least < 1 else 1.0
    keyed = sets.filter(F.col("size") >= fewest(least)).withColumn("cls", F.floor(F.log("size") / step).cast("int"))
    parts = keyed.groupBy("cls").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts"))  # as many rows as classes
    keyed = keyed.join(F.broadcast(parts), "cls").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    tiles = stored(keyed.groupBy("cls", "part").applyInPandas(_tile, TILES), "similar-tiles")
    there = tiles.select(F.col("cls").alias("cb"), F.col("part").alias("pb"), F.col("low").alias("low_b"), F.col("n").alias("n_b"))
    pairs = tiles.select("cls", "part", "high", "n", F.explode(F.array(*[F.col("cls") + i for i in range(STEPS + 2)])).alias("cb")).join(there, "cb")
    pairs = pairs.filter(((F.col("cls") != F.col("cb")) | (F.col("part") <= F.col("pb"))) & (F.col("low_b") * least <= F.col("high") + 1e-9))
    pairs = stored(pairs.select("cls", "part", "cb", "pb", (F.col("n") * F.col("n_b")).alias("work")), "similar-pairs")
    work = pairs.agg(F.sum("work")).first()[0] or 0
    blobs = ["nodes", "fps", "sizes"]
    left = tiles.join(pairs, ["cls", "part"]).select("cb", "pb", F.lit(1).alias("role"), *blobs)
    both = left.unionByName(tiles.select(F.col("cls").alias("cb"), F.col("part").alias("pb"), F.lit(0).alias("role"), *blobs))
    both = both.repartition(max(8, min(10_000, -(-work // WORK))), "cb", "pb").sortWithinPartitions("cb", "pb", "role")
    return both.mapInArrow(met, "a bigint, b bigint")


def verified(nodes: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, least: float) -> np.ndarray:
    """Edges, as rows of two nodes, of a spanning forest of the pairs of sets of Jaccard similarity ``least`` or more.  For
    each set the lists of the nodes that hold its shingles are counted, which gives its intersections with all sets before it
    at once.  With two ``sides`` only nodes of different ones meet."""
    if not len(nodes):
        return np.empty((0, 2), np.int64)
    order = np.argsort(nodes)
    nodes, sides, sets = nodes[order], sides[order], [sets[i] for i in order]
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.argsort(shingle, kind="stable")  # by shingle, then by node
    place = np.empty(len(held), np.int64)
    place[held] = np.arange(len(held))  # of each entry in the lists
    first = np.concatenate(([0], np.cumsum(np.bincount(shingle))))[:-1][shingle]  # where its shingle's list begins
    lists, ends, forest = owner[held], np.cumsum(sizes), Forest(len(nodes))
    apart = sides.min() != sides.max()
    for i in range(1, len(sets)):
        own = slice(ends[i - 1], ends[i])
        met = [lists[a:b] for a, b in zip(first[own].tolist(), place[own].tolist(), strict=True) if a < b]
        if not met:
            continue
        both = np.bincount(np.concatenate(met), minlength=i)
        near = both >= (least - 1e-12) * (sizes[:i] + sizes[i] - both)
        if apart:
            near &= sides[:i] != sides[i]
        if len(near := np.nonzero(near)[0]):
            forest.join(np.full(len(near), i), near)
    edges = np.stack([nodes[forest.roots(np.arange(len(nodes)))], nodes], axis=1)
    return edges[edges[:, 0] != edges[:, 1]]


def _verify(least: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("node")
        edges = verified(frame["node"].to_numpy(np.int64), [np.frombuffer(x, "<u8") for x in frame["shingles"]], frame["side"].to_numpy(), least)
        return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})
    return run


def groups(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, least: float = SIMILARITY, part: int = PART) -> DataFrame:
    """Per row: doc_id, th (hash of the text), group: the same for rows that links of similarity ``least`` or more connect.

    Texts without words are one group.  Texts of fewer than ``width`` words are one shingle.  Only doc_id and text are read."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column(2):
                found = shingle_set(text.as_py(), width)
                made.append((node_of(found), wide(found).tobytes(), len(found)))
            kinds = [pa.int64(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(list(zip(*made, strict=True)) or [[]] * 3, kinds, strict=True))],
                                             names=["doc_id", "th", "node", "fp", "size"])

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        return _verify(least)(frame)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # of a task: rows of one text, whatever their number, are one
        for batch in batches:
            made = []
            for root, node, parts, text in zip(*batch.columns, strict=True):
                if node.as_py() not in seen:
                    seen.add(node.as_py())
                    made.append((root.as_py(), node.as_py(), parts.as_py(), shingle_set(text.as_py(), width).tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*made, strict=True)) or [[]] * 4, kinds, strict=True)],
                                             names=["root", "node", "parts", "shingles"])

    text = text_or_empty()
    each = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    each = stored(each.mapInArrow(read, "doc_id bigint, th bigint, node bigint, fp binary, size int"), "similar-nodes")
    # equal sets are one node: a group of copies is compared once
    one = each.groupBy("node").agg(F.min("fp").alias("fp"), F.min("size").alias("size"))
    root = components(links(one, radius, least))
    root = root.unionByName(root.select(F.col("root").alias("node"), "root")).distinct()  # roots themselves are members
    root = stored(root, "similar-roots")
    one = stored(each.groupBy("node").agg(F.min("th").alias("_th"), F.min("size").alias("size")).join(small(root), "node"), "similar-candidates")
    parts = one.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / part), F.ceil(F.sum("size") / PART_SHINGLES)).cast("int").alias("parts"))
    one = small(stored(one.drop("size").join(small(stored(parts, "similar-parts")), "root"), "similar-dealt"))
    texts = docs.select(F.xxhash64(text).alias("th"), text.alias("text")).join(one, F.col("th") == F.col("_th"))
    made = texts.select("root", "node", "parts", "text").mapInArrow(sets, "root bigint, node bigint, parts int, shingles binary")
    made = made.withColumn("side", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    made = made.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    made = made.withColumns({"p": F.least("side", "other"), "q": F.greatest("side", "other")}).drop("parts", "other")
    linked = components(made.groupBy("root", "p", "q").applyInPandas(verify, "a bigint, b bigint"))
    linked = small(stored(linked.select(F.col("node").alias("_node"), F.col("root").alias("group")), "similar-links"))
    return each.join(linked, F.col("node") == F.col("_node"), "left").select("doc_id", "th", F.coalesce("group", "node").alias("group"))
