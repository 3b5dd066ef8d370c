"""Removal of long word sequences that a smaller document has, by suffix automata of reference shards.

1. Anchors: of the runs of words inside a window, the one of least hash.  Equal windows have equal anchors, so a window that another
   document has lies over an anchor that both have.  Runs of windows over shared anchors are the stretches worth a look.
2. Reference: of the windows in stretches those that several documents have, each where its least document has it.  They are joined to passages
   and dealt into shards of bounded size.
3. Each shard's passages become a suffix automaton, whose states know the least document that they occur in.  It goes to the tasks that hold the
   stretches that share an anchor with the shard, as many as these need, and each stretch is streamed through it for matching statistics.
   Where an anchor has passages in many shards, its windows are routed one by one, each to the shard that has its reference.

Hashes choose what is looked at; what is removed, the automata decide on the words themselves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small, stored, text_or_empty
from .suffix import C, _fold, _slide, merged

LENGTH = 50
#: Bytes of texts that are hashed at a time, and windows of a stretch.
SLICE, STRETCH = 1 << 20, 2048
#: Words of a shard's passages, and of the stretches that one task streams through an automaton, about.
SHARD_WORDS, TASK_WORDS = 50_000, 300_000
#: Shards that all stretches over one anchor go to at most; where its passages lie in more, windows are routed one by one.  A run over an
#: anchor has some 15 windows, so below that many shards the windows' routes are more rows than the anchor's.
SPREAD = 8
NONE = -(1 << 62)  # stands for a null id: smaller than all


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and powers of an odd number and of its inverse modulo 2^64."""
    values = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
    base = int(C[1]) | 1
    both = []
    for x in (base, pow(base, -1, 1 << 64)):
        p, done = np.ones(1, np.uint64), 1
        step = x
        while done < 4096:
            p = np.concatenate([p, p * np.uint64(step)])
            done, step = done * 2, step * step % (1 << 64)
        both.append(p)
    return values, both[0], both[1]


VALUES, UP, DOWN = _powers()


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bytes: where each word begins and ends, and a hash of each."""
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    begin, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    if not len(begin):
        return begin, end, np.zeros(0, np.uint64)
    # bytes by a polynomial within blocks of 4096, from whose sums a word's part in its block is taken
    size = len(UP)
    blocks = -(-len(raw) // size)
    x = np.zeros(blocks * size, np.uint64)
    x[:len(raw)] = VALUES[raw]
    x[:len(raw)][gap] = 0
    sums = np.zeros((blocks, size + 1), np.uint64)
    np.cumsum(x.reshape(blocks, size) * UP, axis=1, out=sums[:, 1:])
    b0, b1 = begin // size, (end - 1) // size
    r0, r1 = begin - b0 * size, end - b1 * size
    same = b0 == b1
    h = (sums[b0, np.where(same, r1, size)] - sums[b0, r0]) * DOWN[r0]
    for i in np.nonzero(~same)[0].tolist():  # one in hundreds of words
        total, at = int(h[i]), size - int(r0[i])
        for b in range(int(b0[i]) + 1, int(b1[i]) + 1):
            total += int(sums[b, int(r1[i]) if b == b1[i] else size]) * pow(int(UP[1]), at, 1 << 64)
            at += size
        h[i] = total % (1 << 64)
    h ^= h >> np.uint64(31)
    h *= C[2]
    h ^= (end - begin).astype(np.uint64) * C[0]
    return begin, end, h ^ (h >> np.uint64(29))


def run_hashes(x: np.ndarray, width: int) -> np.ndarray:
    """Hash of x[i:i + width] for each i that has so many."""
    powers, have = {1: x}, 1
    while have * 2 <= width:
        h = powers[have]
        n = max(0, len(x) - 2 * have + 1)
        powers[have * 2] = _fold(h[:n], h[have:have + n], C[have.bit_length() % 4])
        have *= 2
    out = powers[have]
    while have < width:
        more = 1 << ((width - have).bit_length() - 1)
        n = max(0, len(x) - have - more + 1)
        out = _fold(out[:n], powers[more][have:have + n], C[(more + 1) % 4])
        have += more
    return out


def runs_over_anchors(hashes: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' words, one text after another: text, first window, windows and anchor's key of each run of consecutive windows over one anchor."""
    anchor = max(1, length // 2 - 1)
    start = np.cumsum(sizes) - sizes
    edge = np.zeros(len(hashes) + 1, np.int64)
    long = sizes >= length
    np.add.at(edge, start[long], 1)
    np.add.at(edge, start[long] + sizes[long] - length + 1, -1)
    at = np.nonzero(np.cumsum(edge[:-1]) > 0)[0]  # windows that lie in one text
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    h = run_hashes(hashes, anchor)
    h ^= h >> np.uint64(32)
    key = _slide(h, length - anchor + 1, np.minimum, 2**64 - 1)[at]
    text = np.searchsorted(start[long], at, "right") - 1
    text = np.nonzero(long)[0][text]
    first = np.ones(len(at), bool)
    first[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    heads = np.nonzero(first)[0]
    n = np.diff(np.append(heads, len(at)))
    return text[heads], at[heads] - start[text[heads]], n, (key[heads] ^ (key[heads] >> np.uint64(31))) * C[3]


def _free() -> None:
    """Hands back what a task has freed, as a worker goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    give_back()


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        held += n
        if held >= SLICE or i == len(sizes) - 1:
            yield at, batch.column(column).slice(at, i + 1 - at).to_pylist()
            at, held = i + 1, 0


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, one after another, and numbers of words."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    begin, _, h = words_of(raw)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(begin, ends), prepend=0)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchors(length: int):
    """(doc, th, text) to a row a run: key, doc, th, at, n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, texts in _slices(batch, 2):
                which, at, n, key = runs_over_anchors(*_hashed(texts), length)
                rows = pa.array(which + s)
                yield pa.RecordBatch.from_arrays([_signed(key), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))],
                                                 names=["key", "doc", "th", "at", "n"])
        _free()
    return run


def _stretches(length: int):
    """(doc, th, spots, text) to a row a stretch of consecutive windows over shared anchors, of STRETCH windows at most: doc, th, at (its first word), text (its
    words, joined by a space), and the keys of its runs with their first windows and numbers of windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            flat = batch.column(2).flatten()
            flat = [flat.field(i).to_numpy() for i in range(3)]
            ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
            for row, (doc, th, end) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends.tolist(), strict=True)):
                words = batch.column(3)[row].as_py().split()
                start = int(ends[row - 1]) if row else 0
                spots = sorted(zip(*(x[start:end].tolist() for x in flat), strict=True))
                held: list[tuple[int, int, int]] = []

                def give():
                    a, b = held[0][0], held[-1][0] + held[-1][1]
                    rows.append((doc, th, a, b" ".join(words[a:b + length - 1]), [x[2] for x in held], [x[0] - a for x in held], [x[1] for x in held]))
                for spot in spots:
                    if held and (spot[0] != held[-1][0] + held[-1][1] or spot[0] + spot[1] - held[0][0] > STRETCH):
                        give()
                        held = []
                    held.append(spot)
                if held:
                    give()
                if len(rows) >= 1000:
                    yield _stretch_batch(rows)
                    rows = []
            yield _stretch_batch(rows)
        _free()
    return run


def _stretch_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 7, kinds, strict=True)], names=["doc", "th", "at", "words", "keys", "firsts", "counts"])


def _windows(length: int):
    """(doc, sid, words, keys, counts) of stretches or passages to a row a window: w (hash), key (of its run), doc, place (sid and the window's number)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, sid = (batch.column(i).to_numpy() for i in (0, 1))
            keys, counts = (batch.column(i).flatten().to_numpy() for i in (3, 4))
            keys, done = np.repeat(keys, counts), 0  # runs follow one another and cover all windows
            for s, texts in _slices(batch, 2):
                h, sizes = _hashed(texts)
                w = run_hashes(h, length)
                start = np.cumsum(sizes) - sizes
                n = np.maximum(sizes - length + 1, 0)
                which = np.repeat(np.arange(len(texts)), n)
                number = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([_signed(w[start[which] + number]), pa.array(keys[done:done + len(which)]), pa.array(doc[s + which]), pa.array(sid[s + which] + number)],
                                                 names=["w", "key", "doc", "place"])
                done += len(which)
        _free()
    return run


def _passages(length: int):
    """(doc, sid, words, keys, firsts, counts, places) to a row a passage: the words of consecutive chosen windows of a stretch, and the keys and numbers of windows of their runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, sid, text, keys, firsts, counts, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.split(b" ")
                chosen = np.unique(np.array(places, np.int64)) - sid
                cut = np.nonzero(np.diff(chosen) != 1)[0] + 1
                for part in np.split(chosen, cut):
                    a, b = int(part[0]), int(part[-1]) + 1
                    own = [(k, min(b, f + n) - max(a, f)) for k, f, n in zip(keys, firsts, counts, strict=True) if f < b and f + n > a]
                    rows.append((doc, b" ".join(words[a:b + length - 1]), b - a + length - 1, [k for k, _ in own], [n for _, n in own]))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 5, kinds, strict=True)], names=["doc", "words", "n", "keys", "counts"])
    return run


class Automaton:
    """Suffix automaton of several sequences of words; each state knows the least document that its sequences end in."""

    def __init__(self, passages: list[tuple[int, list[bytes]]]) -> None:
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.least = [-1], [0], [1 << 63]
        for doc, words in passages:
            last = 0
            for w in words:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)), doc)
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            p = self.link[v]
            if self.least[v] < self.least[p]:
                self.least[p] = self.least[v]

    def _extend(self, last: int, c: int, doc: int) -> int:
        nxt, link, size, least = self.next, self.link, self.size, self.least
        if c in nxt[last]:  # an earlier sequence has come this way
            q = nxt[last][c]
            if size[q] != size[last] + 1:
                q = self._split(last, q, c)
            least[q] = min(least[q], doc)
            return q
        cur = len(size)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        least.append(doc)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if size[q] == size[p] + 1 else self._split(p, q, c)
        return cur

    def _split(self, p: int, q: int, c: int) -> int:
        """A state for the sequences of q that are no longer than p's with c."""
        nxt, link, size, least = self.next, self.link, self.size, self.least
        new = len(size)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        least.append(1 << 63)  # what ends in q is handed up the links at the end
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def matches(self, words: list[bytes], doc: int, length: int) -> list[int]:
        """Starts of the windows that a document smaller than ``doc`` has.  The state after each word is that of the longest suffix so far that occurs,
        cut to the window's length."""
        nxt, link, size, least, ids = self.next, self.link, self.size, self.least, self.ids
        v = have = 0
        found = []
        for i, w in enumerate(words):
            c = ids.get(w, -1)
            while v and c not in nxt[v]:
                v = link[v]
                have = size[v]
            if c not in nxt[v]:
                have = 0
                continue
            v = nxt[v][c]
            have += 1
            if have >= length:
                while size[link[v]] >= length:
                    v = link[v]
                    have = size[v]
                if least[v] < doc:
                    found.append(i - length + 1)
        return found


def _streamed(length: int):
    """Passages and stretches of one part of a shard: the stretches' windows that a smaller document has, as runs of words."""
    def run(passages: pd.DataFrame, stretches: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(passages) and len(stretches):
            automaton = Automaton([(d, w.split(b" ")) for d, w in zip(passages["doc"].tolist(), passages["words"], strict=True)])
            for doc, th, at, text, firsts, counts in stretches[["doc", "th", "at", "words", "firsts", "counts"]].itertuples(index=False):
                words = text.split(b" ")
                ends = np.asarray(firsts) + np.asarray(counts)
                spans = []
                for a, b in merged(np.asarray(firsts, np.int64), ends.astype(np.int64)).tolist():
                    got = np.array(automaton.matches(words[a:b + length - 1], doc, length), np.int64)
                    spans.append(merged(got, got + length) + a + at)
                spans = np.concatenate(spans)
                if len(spans):
                    rows.append((doc, th, spans.reshape(-1).tolist()))
            del automaton
            _free()
        return pd.DataFrame(rows, columns=["doc", "th", "spans"])
    return run


def _result(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        for batch in batches:
            rows = []
            for doc, text, copy, spans in zip(*batch.columns, strict=True):  # a text at a time
                doc, copy, spans, words = doc.as_py(), copy.as_py(), spans.as_py(), text.as_py().split()
                if copy and len(words) >= length:
                    runs = np.array([[0, len(words)]])
                else:
                    s = np.array(spans or [], np.int64).reshape(-1, 2)
                    runs = merged(s[:, 0], s[:, 1])
                for a, b in runs[::-1].tolist():
                    del words[a:b]
                gone = int((runs[:, 1] - runs[:, 0]).sum())
                rows.append((doc, len(words) + gone, gone, hashlib.sha256(b" ".join(words)).hexdigest(), runs.reshape(-1).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 5, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])
        _free()
    return run


#: Keys, and rows with arrays and entries of these, that are broadcast at most (some 32 and 80 MB).
KEYS, ROWS, ENTRIES = 1_000_000, 500_000, 2_000_000


def _small(df: DataFrame, array: str, most: int = ENTRIES) -> DataFrame:
    """As ``small``, for rows whose weight is an array: its entries are bounded too."""
    return small(df, ROWS) if (df.agg(F.sum(F.size(array))).first()[0] or 0) <= most else df


def remove_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by a space), spans (from, to, from, to, ... of the removed words).

    Removed is each word under a window of ``length`` words that also starts in a document of smaller doc_id.  Null texts have no words;
    shorter ones lose nothing.  Rows of one doc_id, repeated or different, don't act on one another; a null id is smaller than all.  Copies of a
    whole text are settled by its smallest doc_id alone.  An empty table gives an empty result.  Only doc_id and text are read."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NONE).cast("bigint")).alias("doc"), text_or_empty().cast("binary").alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    # copies by their ids and hashes alone: the texts themselves are joined twice only, with the spots and with the result
    ids = stored(rows.select("doc", "th", F.unhex(F.md5("text")).alias("md5")), "span-ids")
    least = ids.groupBy("md5").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most")
    least = small(stored(least.select("md5", "least"), "span-least"))
    copies = stored(ids.join(least, "md5").filter("doc > least").select("doc", "th").distinct(), "span-copies")

    # stretches over anchors that several texts have
    runs = stored(rows.select("doc", "th", "text").mapInArrow(_anchors(length), "key bigint, doc bigint, th bigint, at int, n int"), "span-anchors")
    shared = runs.groupBy("key").agg(F.min("th").alias("low"), F.max("th").alias("high")).filter("low < high").select("key")
    spots = runs.join(small(stored(shared, "span-shared"), KEYS), "key", "left_semi").join(small(copies, ROWS), ["doc", "th"], "left_anti")
    spots = spots.groupBy("doc", "th").agg(F.collect_set(F.struct("at", "n", "key")).alias("spots"))
    spots = _small(stored(spots, "span-spots"), "spots").withColumnsRenamed({"doc": "_doc", "th": "_th"})
    same = (F.col("doc") == F.col("_doc")) & (F.col("th") == F.col("_th"))
    parts = rows.join(spots, same).select("doc", "th", "spots", "text").dropDuplicates(["doc", "th"])
    parts = parts.mapInArrow(_stretches(length), "doc bigint, th bigint, at int, words binary, keys array<bigint>, firsts array<int>, counts array<int>")
    # a stretch's own number leaves 12 bits for its windows
    parts = parts.withColumn("sid", F.shiftleft(F.shiftright(F.xxhash64("doc", "th", "at"), 12), 12))
    parts = stored(parts, "span-stretches")

    # passages: each window that several documents have, where the least has it
    windows = parts.select("doc", "sid", "words", "keys", "counts").mapInArrow(_windows(length), "w bigint, key bigint, doc bigint, place bigint")
    chosen = windows.groupBy("w").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min_by("place", "doc").alias("place")).filter("low < high")
    chosen = chosen.groupBy(F.shiftleft(F.shiftright("place", 12), 12).alias("_sid")).agg(F.collect_list("place").alias("places"))
    chosen = stored(chosen, "span-chosen")  # as many as a corpus has, so joined by a shuffle at any size
    passages = parts.join(chosen, F.col("sid") == F.col("_sid")).select("doc", "sid", "words", "keys", "firsts", "counts", "places").mapInArrow(_passages(length), "doc bigint, words binary, n bigint, keys array<bigint>, counts array<int>")
    passages = stored(passages, "span-passages")
    shards = max(1, -(-(passages.agg(F.sum("n")).first()[0] or 0) // SHARD_WORDS))
    passages = passages.withColumn("shard", F.pmod(F.xxhash64("words"), F.lit(shards)).cast("int"))

    # to each shard the stretches that share an anchor with it, in as many parts as they need
    routes = stored(passages.select(F.explode("keys").alias("key"), "shard").distinct(), "span-routes")
    wide = small(stored(routes.groupBy("key").count().filter(F.col("count") > SPREAD).select("key"), "span-wide"), KEYS)
    routes = small(stored(routes.join(wide, "key", "left_anti"), "span-narrow"))
    each = parts.select("sid", F.explode(F.arrays_zip("keys", "firsts", "counts")).alias("x")).select("sid", F.col("x.keys").alias("key"), F.col("x.firsts").alias("first"), F.col("x.counts").alias("count"))
    each = each.join(routes, "key").select("sid", "shard", "first", "count")
    # of an anchor with passages in many shards, each window to the one shard that has its reference
    held = passages.select("doc", F.shiftleft(F.col("shard").cast("bigint"), 12).alias("sid"), "words", "keys", "counts").mapInArrow(_windows(length), "w bigint, key bigint, doc bigint, place bigint")
    held = held.join(wide, "key", "left_semi").select("w", F.shiftright("place", 12).cast("int").alias("shard"))
    alone = windows.join(wide, "key", "left_semi").select("w", F.shiftleft(F.shiftright("place", 12), 12).alias("sid"), F.col("place").bitwiseAND(4095).cast("int").alias("first"))
    alone = alone.join(held, "w").select("sid", "shard", "first", F.lit(1).alias("count"))
    each = each.unionByName(alone).groupBy("sid", "shard").agg(F.collect_list(F.struct("first", "count")).alias("x"), F.sum("count").alias("n"))
    each = stored(each.select(F.col("sid").alias("_sid"), "shard", F.col("x.first").alias("firsts"), F.col("x.count").alias("counts"), (F.col("n") + length).alias("n")), "span-routed")
    load = each.groupBy("shard").agg(F.ceil(F.sum("n") / TASK_WORDS).cast("int").alias("parts"))
    load = small(stored(load, "span-load"))
    asked = each.join(load, "shard").withColumn("part", F.pmod(F.xxhash64("_sid"), F.col("parts")).cast("int"))
    asked = parts.select("doc", "th", "at", "words", "sid").join(asked, F.col("sid") == F.col("_sid")).select("shard", "part", "doc", "th", "at", "words", "firsts", "counts")
    given = passages.join(load, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("shard", "part", "doc", "words")
    lost = given.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInPandas(_streamed(length), "doc bigint, th bigint, spans array<bigint>")
    lost = lost.withColumn("copy", F.lit(False)).unionByName(copies.select("doc", "th", F.array().cast("array<bigint>").alias("spans"), F.lit(True).alias("copy")))
    lost = lost.groupBy("doc", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.max("copy").alias("copy"))
    lost = _small(stored(lost, "span-lost"), "spans").withColumnsRenamed({"doc": "_doc", "th": "_th"})
    out = rows.join(lost, same, "left").select("doc", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "spans")
    out = out.mapInArrow(_result(length), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<bigint>")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NONE, F.col("doc_id")))
