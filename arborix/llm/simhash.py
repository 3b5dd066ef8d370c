"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are laid out in tiles of equal quarter population counts (the bits set in each 16-bit
quarter).  Fingerprints within the radius have quarter counts whose differences add up to the radius at most,
so only such pairs of tiles meet; there every pair is compared by numpy exclusive-or and bit counts.  A pair of
tiles reports a spanning forest of its links, never the links themselves, so groups of copies stay linear."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

#: Fingerprints of a tile at most; fuller count classes are cut into several tiles.
TILE = 4096
SEED = 42


def shingle_hashes(text: str | None, width: int = 4) -> np.ndarray:
    """XXH64 values of a text's ``width``-word shingles, repeats included (one shingle if it has fewer words; none if
    it has none)."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not found:
        return np.empty(0, np.uint64)
    size = min(width, len(found))
    flat = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    last = (ends[size - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], SEED) for a, b in zip(starts[: len(last)].tolist(), last, strict=True)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have set; 0 of none."""
    if not len(hashes):
        return 0
    # count each bit over bytes of the hashes; blocks bound the unpacked bits of a very long text
    total = np.zeros(64, np.int64)
    values = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(values), 65536):
        total += np.unpackbits(values[at:at + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_ = total * 2 > len(hashes)
    return int(np.packbits(set_, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of a text's ``width``-word shingles."""
    return majority(shingle_hashes(text, width))


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every whole text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_fingerprints(width), "doc_id bigint, fp bigint")


class Forest:
    """Union-find over positions of an array; the smaller position becomes the root."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while not np.array_equal(r, nxt := self.up[r]):
            r = nxt
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Edges of a spanning forest of the links between two arrays of fingerprints, as rows of two values."""
    nodes = np.concatenate([a, b])
    forest, rows = Forest(len(nodes)), max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a[at:at + rows, None] ^ b[None, :]) <= radius)
        apart = a[i + at] != b[j]
        forest.join(i[apart] + at, j[apart] + len(a))
    roots = forest.roots(np.arange(len(nodes)))
    edges = np.stack([nodes[roots], nodes], axis=1)
    return edges[edges[:, 0] != edges[:, 1]]


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield values[a:b]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(_lists(batch.column(0)), _lists(batch.column(1)), strict=True):
                edges = tile_links(a, b, radius).view(np.int64)
                if len(edges):
                    yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])
    return run


def links(fps: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp, stored) that connect just what links connect."""
    names = ["q0", "q1", "q2", "q3"]
    keyed = fps.select("fp", *[F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF))).cast("int").alias(c)
                               for q, c in enumerate(names)])
    parts = keyed.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts"))
    tiles = (keyed.join(parts, names).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
             .groupBy(*names, "part").agg(F.collect_list("fp").alias("fps")))
    tiles = stored(tiles.select(F.concat_ws(",", *names).alias("cls"), *names, "part", "fps"), "simhash-tiles")
    # the differences of quarter counts within the radius, one of each pair of opposites
    steps = [s for s in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, s)) <= radius and s >= (0, 0, 0, 0)]
    left = tiles.select(F.col("cls").alias("ca"), F.col("part").alias("pa"), F.col("fps").alias("fa"))
    met = (tiles.select(F.col("cls").alias("ca"), F.col("part").alias("pa"), *names,
                        F.explode(F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps])).alias("step"))
           .select("ca", "pa", F.concat_ws(",", *[F.col(c) + F.col("step")[i] for i, c in enumerate(names)]).alias("cb")))
    right = tiles.select(F.col("cls").alias("cb"), F.col("part").alias("pb"), F.col("fps").alias("fb"))
    met = met.join(right, "cb").filter((F.col("ca") != F.col("cb")) | (F.col("pa") <= F.col("pb")))
    # a left tile meets the neighbours of one part number at a time: at most one full tile of each class
    met = met.groupBy("ca", "pa", "pb").agg(F.flatten(F.collect_list("fb")).alias("fb"))
    met = left.join(met, ["ca", "pa"]).select("fa", "fb")
    return met.mapInArrow(_compare(radius), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the connected components of edges (a, b), root being the smallest node (as a signed
    long).  Nodes hold hands with their neighbourhood's smallest, in turn by larger and smaller
    neighbours, until nothing changes; each round is a stored table."""
    def star(e: DataFrame, larger: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else e.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        out = both.join(least, "a")
        hung = out.filter(F.col("b") > F.col("a")) if larger else out
        hung = hung.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not larger:
            hung = hung.unionByName(least.select("a", F.col("m").alias("b")))
        return hung.filter(F.col("a") != F.col("b")).distinct()

    now = stored(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "components")
    mark = None
    while True:
        now = stored(star(star(now, True), False), "components")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach).

    Texts without words (null, empty, blank) share fingerprint zero, linked like any other.  Texts of fewer than
    ``width`` words are one shingle.  Repeated rows and equal texts share a component.  Long texts are taken whole.
    Null ids give null component ids unless another document of the component has an id.  An empty table gives
    an empty result.  Only doc_id and text are read."""
    each = stored(fingerprints(docs, width), "simhash-fingerprints")
    fps = stored(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    root = components(links(fps.select("fp"), radius))
    owned = fps.join(root, fps["fp"] == root["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = owned.groupBy("root").agg(F.min("first").alias("component_id"))
    named = owned.join(least, "root").select("fp", "component_id")
    return each.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
