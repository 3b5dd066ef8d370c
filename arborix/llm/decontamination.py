"""Benchmark decontamination: item-sized windows, SimHash candidates through a multi-index, exact verification.

A document leaks an item if some window of as many words as the item (the whole document, if it is shorter)
has a SimHash within the radius of the item's and a weighted Jaccard similarity of five-word shingles of
at least 0.8, a shingle weighing as often as it occurs.  All windows that hold any shingle of an item of their size are
fingerprinted and looked up; the others are similar to none."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

WIDTH, SIMILARITY = 5, 0.8
#: Windows of similarity 0.8 differ from their item in about 10 bits, give or take 3 (0.9: 7); with this radius a block needs only its own
#: value and its 8 neighbours, so that random windows meet 28 % of the items in some block and are 2 in 100,000 within the radius.
RADIUS = 15
#: Blocks of a fingerprint; of those within the radius at least one block differs in RADIUS // BLOCKS bits or fewer.
BLOCKS = 8
#: Windows that are fingerprinted at a time.
CHUNK = 4096
#: Text of the items that tasks hold at a time; a larger benchmark is gone through in several passes.
PASS_BYTES = 32 << 20


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], width: int = WIDTH) -> list[bytes]:
    k = min(width, len(words))
    return [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if k else []


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: sum of lesser weights by sum of greater ones."""
    low = sum((a & b).values())
    return low / (sum(a.values()) + sum(b.values()) - low)


def simhash(found: list[bytes]) -> int:
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in found], "<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


class MultiIndex:
    """Fingerprints by block: each is listed under every value of a block that is within the block's share of the
    radius of its own, so a look-up of the query's eight blocks meets all fingerprints within the radius."""

    def __init__(self, fingerprints: list[int], radius: int = RADIUS) -> None:
        self.radius, self.all = radius, np.array(fingerprints, np.uint64)
        near = np.array([sum(1 << b for b in c) for k in range(radius // BLOCKS + 1) for c in combinations(range(8), k)])
        self.blocks = []
        for block in range(BLOCKS):
            own = (self.all >> np.uint64(8 * block)).astype(np.int64) & 255
            value = (own[:, None] ^ near[None, :]).reshape(-1)
            order = np.argsort(value, kind="stable")
            self.blocks.append((np.searchsorted(value[order], np.arange(257)), order // len(near)))

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query's and a fingerprint's place, within the radius, ascending."""
        found = []
        for block, (starts, listed) in enumerate(self.blocks):
            value = (queries >> np.uint64(8 * block)).astype(np.int64) & 255
            n = starts[value + 1] - starts[value]
            which = np.repeat(np.arange(len(queries)), n)
            at = listed[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[value], n)]
            near = np.bitwise_count(self.all[at] ^ queries[which]) <= self.radius
            found.append(which[near] * len(self.all) + at[near])
        return np.divmod(np.unique(np.concatenate(found)), max(1, len(self.all)))


def window_fingerprints(hashes: np.ndarray, at: np.ndarray, inside: int) -> np.ndarray:
    """SimHashes of the windows of ``inside`` shingles that start at some ascending places, from running counts of bits."""
    first = int(at[0])
    bits = np.unpackbits(hashes[first:int(at[-1]) + inside].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    upto = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    ones = upto[at - first + inside] - upto[at - first]
    return np.packbits(ones * 2 > inside, axis=1, bitorder="little").view("<u8").reshape(-1)


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """One number for each run of ``width`` words; equal runs have equal numbers."""
    out = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i:i + len(out)]
    return out


class Benchmark:
    """Items ready to be met: by number of words, their shingles' numbers, counts and multi-index."""

    def __init__(self, items: list[tuple[int | None, str | None]], radius: int = RADIUS) -> None:
        groups = defaultdict(list)
        for key, text in items:
            if found := tokens(text):
                groups[len(found)].append((key, found))
        self.groups = {}
        for size, members in groups.items():
            width = min(WIDTH, size)
            runs = [_rolled(np.fromiter(map(crc32, w), np.uint64, size), width) for _, w in members]
            pieces = [shingles(w) for _, w in members]
            self.groups[size] = (width, np.unique(np.concatenate(runs)), [k for k, _ in members],
                                 [Counter(p) for p in pieces], MultiIndex([simhash(p) for p in pieces], radius))
        by_width = defaultdict(list)
        for width, runs, *_ in self.groups.values():
            by_width[width].append(runs)
        self.known = {w: np.unique(np.concatenate(r)) for w, r in by_width.items()}

    def leaks(self, text: str | None) -> list[tuple[int | None, int, int, int, float]]:
        """(item, first word, words, differing bits, similarity): the best window of each item leaked, the first of
        equally good ones."""
        words = tokens(text)
        if not words:
            return []
        h = np.fromiter(map(crc32, words), np.uint64, len(words))
        rolled = {w: _rolled(h, w) for w in self.known}
        hits = {w: r[_member(r, self.known[w])] for w, r in rolled.items()}
        hits = {w: np.unique(x) for w, x in hits.items() if len(x)}
        if not hits:
            return []
        best: dict[tuple[int, int], tuple] = {}
        hashed: dict[int, np.ndarray] = {}
        for size, (width, runs, keys, counts, index) in self.groups.items():
            if width not in hits or not _member(hits[width], runs).any():
                continue
            if width not in hashed:
                hashed[width] = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(words, width)], np.uint64)
            span = min(size, len(words))
            inside = span - width + 1
            # with c of the window's shingles in the item, similarity is c / (item's + window's - c) at most
            need = ceil(SIMILARITY / (1 + SIMILARITY) * (size - width + 1 + inside) - 1e-9)
            upto = np.concatenate(([0], np.cumsum(_member(rolled[width], runs))))
            shared = upto[inside:] - upto[:-inside]
            windows = np.nonzero(shared)[0]
            for chunk in np.split(windows, np.nonzero(np.diff(windows // CHUNK))[0] + 1):
                own = window_fingerprints(hashed[width], chunk, inside) if len(chunk) else np.empty(0, np.uint64)
                for q, i in zip(*(x.tolist() for x in index.within(own)), strict=True):
                    at = int(chunk[q])
                    value = similarity(Counter(shingles(words[at:at + span], width)), counts[i]) if shared[at] >= need else 0.0
                    if value >= SIMILARITY and value > best.get((size, i), (0,))[0]:
                        best[size, i] = (value, at, span, int(own[q] ^ index.all[i]).bit_count())
        return [(self.groups[size][2][i], at, span, bits, value) for (size, i), (value, at, span, bits) in best.items()]


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """A row for each leak: doc_id, item_id, first_word, n_words, bits, similarity.

    Items and documents that are null or have no words leak nothing.  Items of fewer than five words are one
    shingle.  Items of equal text all report.  Repeated documents report each.  Long documents are gone through
    whole.  Empty tables give an empty result.  Only doc_id, text, item_id are read."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), text_or_empty().alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    schema = "doc_id bigint, item_id bigint, first_word int, n_words int, bits int, similarity double"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    out = None
    for p in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).collect()
        held = spark.sparkContext.broadcast(Benchmark([(r["item_id"], r["text"]) for r in part], radius))  # of about pass_bytes of text

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            bench = held.value
            for batch in batches:
                found = [(doc.as_py(), *leak) for doc, text in zip(batch.column(0), batch.column(1), strict=True) for leak in bench.leaks(text.as_py())]
                columns = list(zip(*found, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                                 names=["doc_id", "item_id", "first_word", "n_words", "bits", "similarity"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out
