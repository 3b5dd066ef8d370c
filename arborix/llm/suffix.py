"""Long byte matches across documents by a logarithmic family of sparse suffix arrays.

Suffixes are sampled at anchors: positions whose 24-byte string hashes lowest in some 50-byte window.  Equal windows
have equal anchors at equal places, so every match of 50 bytes runs over an anchor of both documents.  A suffix is kept
with its anchor's key and a hash of its surroundings (all bytes that a window over the anchor can reach); arrays of suffixes
are sorted by key, then surroundings, and dealt into buckets by key.

Documents come in batches of ascending doc_id.  A batch's arrays are merge-scanned with those of the
existing levels: equal surroundings of a smaller document decide all windows over an anchor at once; where only part
is shared, the windows themselves are compared afterwards.  The batch then becomes a level, and levels of equal size
merge into one of twice the size, which keeps the smallest document of each surrounding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, light, running_sum, scratch_path, small, stored, text_or_empty

LENGTH, ANCHOR = 50, 24
SPAN = LENGTH - ANCHOR  # bytes on either side of an anchor that a window over it can reach
GAP = 64  # zero bytes between documents of a buffer
#: Bytes that are anchored at a time, each of which takes some 80 bytes of memory; longer texts go in overlapping pieces.
PIECE = 1 << 18
#: Input bytes to a bucket of the index (the memory of its task is some ten times as much), and to a home of documents or a bucket of
#: surroundings; batches to a run.
BUCKET_BYTES, HOME_BYTES, BATCHES = 4 << 20, 16 << 20, 2
C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
VARIANT = 32  # a position's bits, as a text has under 2 GB; above them stands the number of the text among those of one doc_id


def _hand_back() -> None:
    """What a task of Python has freed, Arrow's pool included, goes back to the system before the next one starts."""
    pa.default_memory_pool().release_unused()
    give_back()


def _fold(acc: np.ndarray, x: np.ndarray, c: np.uint64) -> np.ndarray:
    out = (acc ^ (acc >> np.uint64(29))) + x
    out *= c
    return out


def _slide(x: np.ndarray, width: int, pick, tail: int) -> np.ndarray:
    """pick (minimum, maximum) of x[i:i + width] for each i, x being followed by ``tail``."""
    out, have = np.concatenate([x, np.full(width, tail, np.uint64)]), 1
    while have * 2 <= width:
        out[:-have] = pick(out[:-have], out[have:])
        have *= 2
    if have < width:
        out[:-(width - have)] = pick(out[:-(width - have)], out[width - have:])
    return out[:len(x)]


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of short texts: index of the text, position, key, surroundings (64 bits of hash) and near sides (two hashes of 14
    bits) of each anchor."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = GAP + np.concatenate(([0], np.cumsum(sizes + GAP)[:-1])) if len(texts) else np.empty(0, np.int64)
    raw = b"".join([b"\0" * GAP, *(y for t in texts for y in (t, b"\0" * GAP)), b"\0" * 16])
    n = len(raw) - 8
    x = np.ndarray((n,), "<u8", raw, strides=(1,)).astype(np.uint64)
    h = x[:-16] * C[0]
    h = _fold(h, x[8:-8], C[1])
    h = _fold(h, x[16:], C[2])
    h ^= h >> np.uint64(32)
    h |= np.uint64(1)
    n = len(h)
    # windows start where 50 bytes of a text are left
    edge = np.zeros(n + 1, np.int64)
    long = sizes >= LENGTH
    np.add.at(edge, begin[long], 1)
    np.add.at(edge, begin[long] + sizes[long] - LENGTH + 1, -1)
    starts = np.cumsum(edge[:-1]) > 0
    low = np.where(starts, _slide(h, SPAN + 1, np.minimum, 2**64 - 1), np.uint64(0))
    most = _slide(np.concatenate([np.zeros(SPAN, np.uint64), low]), SPAN + 1, np.maximum, 0)[:n]  # over the windows that hold a position
    at = np.nonzero(most == h)[0]
    text = np.searchsorted(begin, at, "right") - 1
    pos = at - begin[text]
    key = h[at]
    key = (key ^ (key >> np.uint64(31))) * C[3]
    left, right = np.minimum(SPAN, pos), np.minimum(SPAN, sizes[text] - pos - ANCHOR)
    acc = (left * 64 + right).astype(np.uint64) * C[0]
    for j, off in enumerate([0, 8, 16, 50, 58, 66, 68]):  # the anchor's own bytes are in its key
        acc = _fold(acc, x[at - SPAN + off] & (np.uint64(0xFFFF) if off == 66 else np.uint64(2**64 - 1)), C[1 + j % 3])
    acc = _fold(acc, x[at - 2] & np.uint64(0xFFFF), C[1])
    acc ^= acc >> np.uint64(32)
    half = SPAN // 2
    sides = []
    for a, b in ((at - half, at - 8), (at + ANCHOR, at + ANCHOR + half - 8)):
        side = _fold(x[a] * C[1], x[b], C[2])
        sides.append((side ^ (side >> np.uint64(32))) * C[3] >> np.uint64(50))
    return text, pos, key, acc, ((sides[0] << np.uint64(14)) | sides[1]).astype(np.uint32)


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes], list[tuple[int, int]]]]:
    """Groups of pieces of about PIECE bytes: text indexes, offsets, bytes, and the positions of each that count."""
    group, held = ([], [], [], []), 0
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t)), PIECE):
            a, b = max(0, s - 2 * LENGTH), min(len(t), s + PIECE + 2 * LENGTH)
            if b - a < LENGTH:
                continue
            for x, y in zip(group, (i, a, t[a:b] if (a, b) != (0, len(t)) else t, (s, s + PIECE)), strict=True):
                x.append(y)
            held += b - a
            if held >= PIECE:
                yield group
                group, held = ([], [], [], []), 0
    if group[0]:
        yield group


def _zip(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()) if len(x) else b""


def _unzip(data: bytes, kind: str) -> np.ndarray:
    if not data:
        return np.empty(0, kind)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.int64(0))


ENTRY = "bucket int, kind string, keys binary, around binary, sides binary, docs binary, spots binary"


def _entries(bucket: int, kind: str, key, around, sides, doc, spot) -> tuple:
    """Positions and ids are kept as differences, all byte by byte, so that zstandard sees their regularity."""
    return bucket, kind, _zip(key), _zip(around), _zip(sides), _zip(_deltas(doc)), _zip(_deltas(spot))


def _suffixes(buckets: int):
    """Anchors of (doc_id, variant, text) rows as rows of entries by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.string(), *[pa.binary()] * 5]
        names = ["bucket", "kind", "keys", "around", "sides", "docs", "spots"]
        for batch in batches:
            docs = batch.column(0).to_numpy().astype(np.int64)
            variants = batch.column(1).to_numpy().astype(np.int64)
            texts = [x.as_py() for x in batch.column(2)]
            got = []
            for which, offsets, pieces, spans in _pieces(texts):
                text, pos, key, around, sides = anchors(pieces)
                pos = pos + np.array(offsets)[text]
                span = np.array(spans)[text]
                own = (span[:, 0] <= pos) & (pos < span[:, 1])
                text = np.array(which)[text]
                got.append((key[own], around[own], sides[own], docs[text[own]], (variants[text[own]] << VARIANT) + pos[own]))
            if not got:
                continue
            key, around, sides, doc, spot = (np.concatenate(c) for c in zip(*got, strict=True))
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            key &= np.uint64((1 << 40) - 1)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [_entries(b, "new", key[o], around[o], sides[o], doc[o], spot[o]) for b in range(buckets) if len(o := order[ends[b]:ends[b + 1]])]
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at:at + 64], strict=True), kinds, strict=True)], names=names)
        _hand_back()
    return run


def _column(frame: pd.DataFrame, name: str, kind: str) -> np.ndarray:
    """All values of a column of entries, held once."""
    return np.concatenate([np.empty(0, kind), *(np.cumsum(_unzip(x, kind)) if name in ("docs", "spots") else _unzip(x, kind) for x in frame[name])])


def merge_scan(key, around, sides, doc, new) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes (``new``: of the batch, the rest of levels) sorted by key, surroundings and document: which new ones have all
    their windows in a smaller document; which ones share part of their surroundings with a smaller (or for a
    smaller one: a larger) document and must be compared by window."""
    n = len(key)
    first = np.ones(n, bool)
    first[1:] = (key[1:] != key[:-1]) | (around[1:] != around[:-1])
    heads = np.nonzero(first)[0]
    cls = np.cumsum(first) - 1
    least = doc[heads]
    full = new & (doc > least[cls])
    hkey, part = key[heads], np.zeros(len(heads), bool)
    lone = np.ones(len(heads), bool)
    lone[1:] &= hkey[1:] != hkey[:-1]
    lone[:-1] &= hkey[1:] != hkey[:-1]
    several = np.nonzero(~lone)[0]
    for shift in (14, 0):
        side = (sides[heads[several]] >> np.uint32(shift)) & np.uint32(0x3FFF)
        o = np.lexsort((least[several], side, hkey[several]))
        k, s, d = hkey[several][o], side[o], least[several][o]
        start = np.ones(len(o), bool)
        start[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        g = np.cumsum(start) - 1
        if len(o):
            low, high = np.minimum.reduceat(d, np.nonzero(start)[0]), np.maximum.reduceat(d, np.nonzero(start)[0])
            part[several[o]] |= (low != high)[g]
    partial = part[cls] & (doc == least[cls]) & (new | first)
    return full, partial


def _scan(homes: int, keep: bool):
    """merge_scan over a bucket: entries (new, merge, stay) to rows of kind full and part (by home of the document), and,
    if the index goes on, of kind level (by bucket): the new suffixes with those to be merged."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        bucket, kinds = int(frame["bucket"].iloc[0]), frame["kind"].to_numpy()
        keys = [_unzip(x, "<u8") for x in frame["keys"]]
        sizes = [len(x) for x in keys]
        new, held = np.repeat(kinds == "new", sizes), np.repeat(kinds != "stay", sizes)
        cols = [np.concatenate(keys), *(_column(frame, *c) for c in (("around", "<u8"), ("docs", "<i8"), ("spots", "<i8"), ("sides", "<u4")))]
        del keys, frame
        # a column at a time, so that all are held once and one twice
        order = np.lexsort(cols[3::-1])
        for i in range(len(cols)):
            cols[i] = cols[i][order]
        new, held = new[order], held[order]
        del order
        key, around, doc, spot, sides = cols
        full, partial = merge_scan(key, around, sides, doc, new)
        rows = []
        for kind, mask in (("full", full), ("part", partial)):
            rows += _homed(kind, doc[mask], spot[mask], homes)
        if keep:
            key, around, sides, doc, spot = key[held], around[held], sides[held], doc[held], spot[held]
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (around[1:] != around[:-1])
            rows.append(_entries(bucket, "level", key[first], around[first], sides[first], doc[first], spot[first]))
        del key, around, doc, spot, sides, cols
        _hand_back()
        return pd.DataFrame(rows, columns=["bucket", "kind", "keys", "around", "sides", "docs", "spots"])
    return run


def _documents(frame: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray]]:
    """Of rows of one home: document, number of its text, and ascending rows of (position, whether of a window)."""
    doc = np.concatenate([np.cumsum(_unzip(x, "<i8")) for x in frame["docs"]])
    parts = [np.cumsum(_unzip(x, "<i8")) for x in frame["spots"]]
    spot = np.concatenate(parts)
    window = np.repeat((frame["kind"] == "window").to_numpy(), [len(x) for x in parts])
    o = np.lexsort((window, spot, doc))
    doc, spot, window = doc[o], spot[o], window[o]
    variant, pos = spot >> VARIANT, spot & ((1 << VARIANT) - 1)
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (variant[1:] != variant[:-1])
    heads = np.nonzero(first)[0]
    for a, b in zip(heads, np.append(heads[1:], len(doc)), strict=True):
        yield int(doc[a]), int(variant[a]), np.stack([pos[a:b], window[a:b]], axis=1)


def _positions(frame: pd.DataFrame) -> pd.DataFrame:
    rows = [(d, v, np.unique(x[:, 0]).astype("<i8").tobytes()) for d, v, x in _documents(frame)]
    return pd.DataFrame(rows, columns=["doc", "variant", "spots"])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Maximal runs, as rows of (from, to), of intervals that touch or overlap."""
    if not len(a):
        return np.empty((0, 2), np.int64)
    o = np.argsort(a, kind="stable")
    a, b = a[o], np.maximum.accumulate(b[o])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    heads = np.nonzero(new)[0]
    return np.stack([a[heads], b[np.append(heads[1:], len(a)) - 1]], axis=1)


def _spans(frame: pd.DataFrame) -> pd.DataFrame:
    """What is decided of each document of a home as runs; they may reach beyond the end of the text."""
    rows = []
    for d, v, x in _documents(frame):
        window = x[:, 1] == 1
        at = x[:, 0]
        runs = merged(np.where(window, at, np.maximum(0, at - SPAN)), at + LENGTH)
        rows.append((d, v, runs.astype("<i8").tobytes()))
    _hand_back()
    return pd.DataFrame(rows, columns=["doc", "variant", "spots"])


REACH = 2 * SPAN + ANCHOR  # bytes of an anchor with its surroundings
SURROUNDING = "bucket int, docs binary, spots binary, sides binary, bytes binary"


def _hash(x: np.ndarray, at: np.ndarray, offsets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the words at some offsets from places of a buffer."""
    one, two = np.full(len(at), C[0]), np.full(len(at), C[3])
    for off in offsets:
        w = x[at + off].astype(np.uint64)
        one, two = _fold(one, w, C[1]), _fold(two ^ (two >> np.uint64(32)), w * C[0], C[2])
    return one ^ (one >> np.uint64(32)), two ^ (two >> np.uint64(32))


def _surroundings(buckets: int):
    """(doc, variant, spots, text) to the bytes around those anchors, by bucket of the anchor's bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for doc, variant, spots, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, n = np.frombuffer(spots, "<i8"), len(text)
                raw = np.frombuffer(b"\0" * SPAN + text + b"\0" * SPAN, np.uint8)
                around = np.lib.stride_tricks.sliding_window_view(raw, REACH)[at]
                sides = np.stack([np.minimum(SPAN, at), np.minimum(SPAN, n - at - ANCHOR)], axis=1).astype(np.uint8)
                got.append((np.full(len(at), doc), (variant << VARIANT) + at, sides, around))
            if not got:
                continue
            doc, spot, sides, around = (np.concatenate(c) for c in zip(*got, strict=True))
            flat = np.ascontiguousarray(around).reshape(-1)
            x = np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,))
            key, _ = _hash(x, np.arange(len(around)) * REACH + SPAN, (0, 8, 16))
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            pack = zstandard.ZstdCompressor(level=1).compress
            rows = [(b, _zip(_deltas(doc[o])), _zip(_deltas(spot[o])), sides[o].tobytes(), pack(around[o].tobytes()))
                    for b in range(buckets) if len(o := order[ends[b]:ends[b + 1]])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)],
                                             names=["bucket", "docs", "spots", "sides", "bytes"])
        _hand_back()
    return run


def shared_windows(doc: np.ndarray, spot: np.ndarray, sides: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of the windows over these anchors that a smaller document has at the same place of the
    same anchor.  One distance of window and anchor at a time, so memory is that of the bytes."""
    flat = np.ascontiguousarray(around).reshape(-1)
    x = np.ndarray((max(0, len(flat) - 7),), "<u8", flat, strides=(1,))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for back in range(SPAN + 1):
        has = np.nonzero((sides[:, 0] >= back) & (sides[:, 1] >= SPAN - back))[0]
        one, two = _hash(x, has * REACH + SPAN - back, (0, 8, 16, 24, 32, 40, 42))
        o = np.lexsort((doc[has], two, one))
        if not len(o):
            continue
        one, two, d = one[o], two[o], doc[has][o]
        new = np.ones(len(o), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        later = d > d[np.nonzero(new)[0]][np.cumsum(new) - 1]
        found.append((d[later], spot[has][o][later] - back))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _resolve(homes: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        doc = np.concatenate([np.cumsum(_unzip(x, "<i8")) for x in frame["docs"]])
        spot = np.concatenate([np.cumsum(_unzip(x, "<i8")) for x in frame["spots"]])
        sides = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, 2) for x in frame["sides"]])
        around = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(-1, REACH) for x in frame["bytes"]])
        rows = _homed("window", *shared_windows(doc, spot, sides, around), homes)
        del doc, spot, sides, around
        _hand_back()
        return pd.DataFrame(rows, columns=["bucket", "kind", "keys", "around", "sides", "docs", "spots"])
    return run


def _homed(kind: str, doc: np.ndarray, spot: np.ndarray, homes: int) -> list[tuple]:
    """Rows of documents and positions by home of the text, so that the texts of one doc_id, or of none, spread over all homes."""
    home = (doc + (spot >> VARIANT)) % homes
    o = np.lexsort((spot, doc, home))
    doc, spot = doc[o], spot[o]
    at = np.searchsorted(home[o], np.arange(homes + 1))
    return [(i, kind, b"", b"", b"", _zip(_deltas(doc[at[i]:at[i + 1]])), _zip(_deltas(spot[at[i]:at[i + 1]]))) for i in range(homes) if at[i] < at[i + 1]]


def _covered(n: int, copy: bool, spans: bytes | None) -> np.ndarray:
    """Removed bytes of a text as maximal runs."""
    if n < LENGTH:
        return np.empty((0, 2), np.int64)
    if copy:
        return np.array([[0, n]])
    return np.minimum(np.frombuffer(spans or b"", "<i8").reshape(-1, 2), n)


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, copy, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs = _covered(len(text), copy, spans)
            kept, at = hashlib.sha256(), 0
            for a, b in runs.tolist():
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            rows.append((doc, len(text), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), kept.hexdigest(), runs.reshape(-1).tolist()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)], names=names)


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_OTHER = {"doc": "_doc", "variant": "_variant"}


def remove_repeats(docs: DataFrame, batches: int = BATCHES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (from, to, from, to, ... of the removed runs).

    Removed is each byte under a 50-byte string that also starts in a document of smaller doc_id.  Null texts are
    empty; texts under 50 bytes lose nothing.  Rows of one doc_id, repeated or different, don't act on one another.
    A null id is smaller than all.  Copies of a whole text are settled by its smallest doc_id alone.  An empty
    table gives an empty result.  Only doc_id and text are read."""
    spark = docs.sparkSession
    none = F.lit(-(1 << 62)).cast("bigint")  # stands for a null id
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), none).alias("doc"), text_or_empty().cast("binary").alias("text"))
    texts = texts.withColumn("md5", F.md5("text"))
    ids = stored(texts.select("doc", "md5", F.octet_length("text").cast("bigint").alias("size")), "repeat-ids")
    size = ids.agg(F.sum("size")).first()[0] or 0
    buckets, homes = max(8, -(-size // bucket_bytes)), max(8, -(-size // HOME_BYTES))
    # copies of whole texts, and the numbers of texts that share a doc_id
    least = ids.groupBy("md5").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most")
    least = small(stored(least.select(F.col("md5").alias("_md5"), "least"), "repeat-copies"))
    shared = ids.groupBy("doc").agg(F.count_distinct("md5").alias("n")).filter("n > 1")
    shared = ids.join(small(stored(shared.select("doc"), "repeat-shared")), "doc").select("doc", "md5").distinct()
    shared = shared.withColumns({"part": F.substring("md5", 1, 3), "one": F.lit(1)})
    shared = running_sum(shared, ["doc"], "part", [F.col("md5")], "one", "variant")
    shared = small(stored(shared.select(F.col("doc").alias("_doc"), F.col("md5").alias("_text"), "variant"), "repeat-variants"))
    rows = (texts.join(least, F.col("md5") == F.col("_md5"), "left").join(shared, (F.col("doc") == F.col("_doc")) & (F.col("md5") == F.col("_text")), "left")
            .select("doc", F.coalesce("variant", F.lit(0)).cast("int").alias("variant"), "text",
                    F.coalesce(F.col("doc") > F.col("least"), F.lit(False)).alias("copy")))
    cuts = ids.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 and size else []
    cuts = [-(1 << 63), *sorted(set(cuts or [])), (1 << 63) - 1]
    levels: list[tuple[int, str]] = []  # size in batches, path; the largest first
    found: list[DataFrame] = []
    for number, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        inside = rows.filter((F.col("doc") > low) & (F.col("doc") <= high) & ~F.col("copy") & (F.octet_length("text") >= LENGTH))
        entries = inside.select("doc", "variant", "text").mapInArrow(_suffixes(buckets), ENTRY)
        merged, stay = 1, len(levels)
        while stay and levels[stay - 1][0] == merged:
            stay -= 1
            merged *= 2
        for i, (_, path) in enumerate(levels):
            kept = spark.read.schema(ENTRY).parquet(path).filter(F.col("kind") == "level")
            entries = entries.unionByName(kept.withColumn("kind", F.lit("merge" if i >= stay else "stay")))
        made = scratch_path(spark, "suffixes")
        entries.groupBy("bucket").applyInPandas(_scan(homes, number < len(cuts) - 2), ENTRY).write.partitionBy("kind").parquet(made)
        found.append(spark.read.schema(ENTRY).parquet(made).filter(F.col("kind").isin("full", "part")))
        for _, path in levels[stay:]:
            _drop(spark, f"{path}/kind=level")
        levels[stay:] = [(merged, made)]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    spots = "doc bigint, variant int, spots binary"
    same = (F.col("doc") == F.col("_doc")) & (F.col("variant") == F.col("_variant"))
    part = every.filter(F.col("kind") == "part").groupBy("bucket").applyInPandas(_positions, spots)
    part = light(stored(part, "repeat-part"), "spots").withColumnsRenamed(_OTHER)
    undecided = rows.filter(~F.col("copy")).join(part, same).select("doc", "variant", "spots", "text")
    windows = undecided.mapInArrow(_surroundings(homes), SURROUNDING).groupBy("bucket").applyInPandas(_resolve(homes), ENTRY)
    lost = every.filter(F.col("kind") == "full").unionByName(windows).groupBy("bucket").applyInPandas(_spans, spots)
    lost = light(stored(lost, "repeat-lost"), "spots").withColumnsRenamed(_OTHER)
    out = rows.join(lost, same, "left").select("doc", "text", "copy", "spots")
    out = out.mapInArrow(_result, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != none, F.col("doc_id")))
