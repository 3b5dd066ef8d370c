"""Alignment of two tokenizers' tokens over the bytes of each document.

Both tokenizers' tokens cut the same bytes (a space, then the text).  Offsets where a token of either ends are shared cuts.  They are found by
divide and conquer: an interval of tokens is cut at a common end near its middle, which bisection in the other tokenizer's ends
locates, and both halves go on; an interval without a common end inside is a group.  All intervals of a depth are worked on at once.

Texts are tokenized once; what follows reads their ids.  Tokens that overlap are linked.  How often a pair of ids is linked is counted over the whole
corpus in a first pass; in a second one frequent pairs are looked up in a broadcast table, whose size is bounded by what frequent means, and the rest goes through a join."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, stored, text_or_empty
from .tokens import LETTER, NUMBER, SPACE, _byte_letters

#: Bytes of texts (or, about, of twice their ids) that are worked on at a time, and pairs that a task holds before it hands on their counts.
SLICE, HELD = 1 << 20, 1 << 20
#: A pair is frequent if it makes up over one of so many links: there are fewer such pairs than this.
FREQUENT = 1 << 22
#: Pieces whose ids a task keeps.
KEPT = 200_000
# What the byte-level tokenizers' pattern cuts text into, for characters up to U+017F.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BEYOND = re.compile("[^\x00-ſ]")


class Vocabulary(dict):
    """Ids of texts (none where the bytes of their tokens aren't the text's).  A text that falls into pieces which are encoded apart is made up of
    these: the new ones of all texts at hand are encoded at once, and those met lately are kept as bytes."""

    size: int
    bytes: list[bytes]

    def many(self, texts: list[str], spelt: list[bytes]) -> list[np.ndarray]:
        cut = [self.pieces(t) for t in texts]
        new = {p for pieces in cut if pieces is not None for p in pieces if p not in self}
        if len(self) > KEPT:
            self.clear()
            new = {p for pieces in cut if pieces is not None for p in pieces}
        new = list(new)
        for p, ids in zip(new, self.encoded(new), strict=True):
            self[p] = array(self.kind, ids).tobytes()
        out = []
        for text, pieces, whole in zip(texts, cut, spelt, strict=True):
            got = b"".join(map(self.__getitem__, pieces)) if pieces is not None else array(self.kind, self.alone(text)).tobytes()
            ids = np.frombuffer(got, self.kind)
            out.append(ids if b"".join(map(self.bytes.__getitem__, ids.tolist())) == whole else ids[:0])
        return out


class ByteTokens(Vocabulary):
    """A byte-level tokenizer.  Texts of known letters are cut into its pieces."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.letters = _byte_letters()
        back = {v: k for k, v in self.letters.items()}
        self.size = self.tokenizer.get_vocab_size()
        self.bytes = [b""] * self.size
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = bytes(back[x] for x in token) if all(x in back for x in token) else token.encode()
        self.kind = "H" if self.size <= 1 << 16 else "I"
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        step = made.get("pre_tokenizer") or {}
        self.known = made.get("normalizer") is None and step.get("type") == "ByteLevel" and step.get("use_regex") is True and step.get("add_prefix_space") is False

    def pieces(self, text: str) -> list[str] | None:
        return PIECES.findall(text) if self.known and not BEYOND.search(text) else None

    def encoded(self, pieces: list[str]) -> Iterator[list[int]]:
        model, letters = self.tokenizer.model, self.letters
        for p in pieces:
            yield [t.id for t in model.tokenize(p.encode().decode("latin-1").translate(letters))]

    def alone(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class WordPieces(Vocabulary):
    """A sentencepiece model, which puts a space ahead.  Where no piece has a space behind another character, nothing joins over a single space,
    so texts are cut into the words between single spaces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.bytes = [bytes.fromhex(m[1]) if self.model.is_byte(i) and (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        probe = "ﬁ ²  x "  # what a model that changes characters or spaces would change
        self.known = not any(re.search("[^▁]▁", p) for p in pieces) and self.model.normalize(probe).replace("▁", " ").strip(" ") == probe.strip(" ")
        self.kind = "H" if self.size <= 1 << 16 else "I"

    def pieces(self, text: str) -> list[str] | None:
        plain = self.known and text and text[0] != " " and text[-1] != " " and "  " not in text
        return text.split(" ") if plain else None

    def encoded(self, pieces: list[str]) -> list[list[int]]:
        return self.model.encode(pieces, num_threads=1)

    def alone(self, text: str) -> list[int]:
        return self.model.encode(text)


def _packed(ids: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(ids.tobytes())


def _encoded(a: str, b: str, key: str):
    """(key, text) to key and the ids of either tokenizer: none where the text is empty or one of them doesn't spell it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = ByteTokens(a), WordPieces(b)
        for batch in batches:
            for s, e in _slices(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)):
                texts = batch.column(1).slice(s, e - s).to_pylist()
                some = [t for t in texts if t]
                spelt = [(" " + t).encode() for t in some]
                got = iter(zip(one.many([" " + t for t in some], spelt), two.many(some, spelt), strict=True))
                rows = [(b"", b"")] * len(texts)
                for i, t in enumerate(texts):
                    if t:
                        x, y = next(got)
                        if len(x) and len(y):
                            rows[i] = _packed(x), _packed(y)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))], names=[key, "a", "b"])
        del one, two
        give_back()
    return run


class Loaded:
    """Sizes in bytes and names of the ids of both tokenizers, and slices of documents from their packed ids."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray]) -> None:
        self.sizes, self.kinds = sizes, [np.uint16 if len(x) <= 1 << 16 else np.uint32 for x in sizes]

    def slices(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """First and last document, their numbers of tokens, ids and ends.  Both cover the same bytes of each document, so its last end is a common one,
        and the documents of a slice are one interval."""
        packed = [batch.column(batch.schema.get_field_index(x)) for x in "ab"]
        for s, e in _slices(pc.binary_length(packed[0]).to_numpy(zero_copy_only=False) * 2):
            unpack = zstandard.ZstdDecompressor().decompress
            ids = [[np.frombuffer(unpack(x) if x else b"", k) for x in c.slice(s, e - s).to_pylist()] for c, k in zip(packed, self.kinds, strict=True)]
            whole = [np.concatenate(x).astype(np.int64) for x in ids]
            yield s, e, *(np.array([len(x) for x in side], np.int64) for side in ids), *whole, *(np.cumsum(n[x]) for n, x in zip(self.sizes, whole, strict=True))


def shared_cuts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending ends with the same last one: indexes in a and in b of all common ends, ascending."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found_a, found_b = [np.array([len(a) - 1])], [np.array([len(b) - 1])]
    # intervals of tokens [al, ah) and [bl, bh) over the same bytes
    al, ah, bl, bh = (np.array([x], np.int64) for x in (0, len(a), 0, len(b)))
    while True:
        inside = (ah - al > 1) & (bh - bl > 1)  # a single token has no end inside
        al, ah, bl, bh = al[inside], ah[inside], bl[inside], bh[inside]
        if not len(al):
            break
        middle = (al + ah - 2) // 2
        at_a, at_b = np.full(len(al), -1), np.full(len(al), -1)
        left, step = np.arange(len(al)), 0
        while len(left):  # the common end nearest to the middle: tokens to either side of it in turn
            for way in ((step, -step) if step else (0,)):
                i = middle[left] + way
                ok = (i >= al[left]) & (i <= ah[left] - 2)
                who, i = left[ok], i[ok]
                j = np.searchsorted(b, a[i])
                hit = (b[j] == a[i]) & (at_a[who] < 0)
                at_a[who[hit]], at_b[who[hit]] = i[hit], j[hit]
            step += 1
            left = left[(at_a[left] < 0) & ((middle[left] - step >= al[left]) | (middle[left] + step <= ah[left] - 2))]
        cut = at_a >= 0  # the others are groups
        al, ah, bl, bh, at_a, at_b = (x[cut] for x in (al, ah, bl, bh, at_a, at_b))
        found_a.append(at_a)
        found_b.append(at_b)
        al, ah = np.concatenate([al, at_a + 1]), np.concatenate([at_a + 1, ah])
        bl, bh = np.concatenate([bl, at_b + 1]), np.concatenate([at_b + 1, bh])
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the tokens of a and of b that overlap, by where the overlap ends: one link for each distinct end."""
    over_b = np.searchsorted(b, a)  # the token of b that holds the last byte of each of a
    alone = b[over_b] != a
    i = np.concatenate([np.nonzero(alone)[0], np.searchsorted(a, b)])
    j = np.concatenate([over_b[alone], np.arange(len(b))])
    return i, j


def group_texts(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """a1,a2|b1;a3|b2,b3; ... of all groups, and where each group ends in it."""
    n = len(ids_a) + len(ids_b)
    of_a, of_b = (np.cumsum(np.bincount(cut + 1, minlength=len(ids) + 1)[:len(ids)]) for cut, ids in ((cut_a, ids_a), (cut_b, ids_b)))
    place_a = np.arange(len(ids_a)) + np.concatenate([[0], cut_b + 1])[of_a]
    place_b = np.arange(len(ids_b)) + (cut_a + 1)[of_b]
    value, sign = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    value[place_a], value[place_b] = ids_a, ids_b
    sign[place_a[cut_a]], sign[place_b[cut_b]] = ord("|"), ord(";")
    width = len(str(int(value.max(initial=0))))
    known = np.arange(int(value.max(initial=0)) + 1)
    names = known[:, None] // 10 ** np.arange(width) % 10 + ord("0")  # digits from the last
    sizes = np.maximum((known[:, None] >= 10 ** np.arange(width)).sum(axis=1), 1)
    names = names.astype(np.uint8)
    digits = sizes[value]
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    out[ends - 1] = sign
    for p in range(width):
        has = np.nonzero(digits > p)[0] if p else slice(None)
        out[ends[has] - 2 - p] = names[value[has], p]
    return out.tobytes(), ends[place_b[cut_b]]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE bytes."""
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        held += n
        if held >= SLICE or i == len(sizes) - 1:
            yield at, i + 1
            at, held = i + 1, 0


def _merged(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    heads = np.nonzero(np.concatenate([[True], code[1:] != code[:-1]]))[0] if len(code) else np.zeros(0, np.int64)
    return code[heads], np.add.reduceat(count, heads) if len(heads) else count


def _counts(sizes: tuple[np.ndarray, np.ndarray]):
    """A task's counts of linked pairs (id of a times the vocabulary of b plus id of b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, code, count, held = Loaded(sizes), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        give = lambda: pa.RecordBatch.from_arrays([pa.array(code), pa.array(count)], names=["pair", "n"])

        def fold():
            both = [np.concatenate(x) for x in zip((code, count), *held, strict=True)] if held else (code, count)
            held.clear()
            return _merged(*both)
        for batch in batches:
            for _, _, _, _, ids_a, ids_b, ends_a, ends_b in loaded.slices(batch):
                if len(ids_a):
                    i, j = links(ends_a, ends_b)
                    held.append(np.unique(ids_a[i] * len(sizes[1]) + ids_b[j], return_counts=True))
                if sum(len(x[0]) for x in held) > HELD:
                    code, count = fold()
                if len(code) > HELD:
                    yield give()
                    code, count = code[:0], count[:0]
        code, count = fold()
        yield give()
        give_back()
    return run


ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, rare array<bigint>, times array<bigint>"


def _aligned(sizes: tuple[np.ndarray, np.ndarray], key: str, table):
    """Per document its figures, from the frequent pairs; its other pairs, and how often it has each, in rare and times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = Loaded(sizes)
        known, known_n, known_best = (np.frombuffer(x, t) for x, t in zip(table.value, ("<i8", "<i8", "u1"), strict=True))
        for batch in batches:
            for s, e, size_a, size_b, ids_a, ids_b, ends_a, ends_b in loaded.slices(batch):
                m = e - s
                to_a, to_b = np.cumsum(size_a), np.cumsum(size_b)
                cut_a, cut_b = shared_cuts(ends_a, ends_b)
                groups = np.diff(np.searchsorted(cut_a, to_a), prepend=0)
                text, ends = group_texts(ids_a, ids_b, cut_a, cut_b)
                stop = np.concatenate([[0], ends])[np.cumsum(groups)]
                sums, at, view = [], 0, memoryview(text)
                for x in stop.tolist():
                    sums.append(hashlib.sha256(view[at:x - 1]).hexdigest() if x > at else "")
                    at = x
                i, j = links(ends_a, ends_b) if len(ids_a) else (np.zeros(0, np.int64),) * 2
                doc = np.searchsorted(to_a, i, "right")
                pairs, which = np.unique(ids_a[i] * len(sizes[1]) + ids_b[j], return_inverse=True)
                place = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                hit = (known[place] == pairs) if len(known) else np.zeros(len(pairs), bool)
                n, best = np.where(hit, known_n[place], 0) if len(known) else np.zeros(len(pairs), np.int64), hit & (known_best[place] == 1) if len(known) else hit
                total = np.zeros(m, np.int64)
                np.add.at(total, doc, n[which])
                rare = ~hit[which]
                code, times = _merged(doc[rare] * len(pairs) + which[rare], np.ones(int(rare.sum()), np.int64))
                offsets = pa.array(np.searchsorted(code, np.arange(m + 1) * len(pairs)).astype(np.int32))
                columns = [batch.column(batch.schema.get_field_index(key)).slice(s, m), *[pa.array(x.astype(np.int64)) for x in (
                    size_a, size_b, groups, np.bincount(doc, minlength=m), np.bincount(doc[best[which]], minlength=m), total)], pa.array(sums, pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(pairs[code % max(len(pairs), 1)])), pa.ListArray.from_arrays(offsets, pa.array(times))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rare", "times"])
        give_back()
    return run


def align(docs: DataFrame, a: str, b: str, key: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    a: a byte-level tokenizer's file, b: a sentencepiece model.  Strings of special tokens are plain text.  Texts that are null, empty or not what
    either tokenizer's tokens spell have no tokens: zeros and ''.  Repeated rows, and rows of one or no id, are documents of their own.  An
    empty table gives an empty result.  Only doc_id and text are read.  A slice of texts, or one longer text, is held in memory, whole."""
    spark = docs.sparkSession
    texts = docs.select(key, text_or_empty().alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    sizes = tuple(np.array([len(x) for x in t(p).bytes], np.int64) for t, p in ((ByteTokens, a), (WordPieces, b)))
    ids = stored(texts.mapInArrow(_encoded(a, b, key), f"`{key}` {kind}, a binary, b binary"), "token-pairs")
    counts = ids.select("a", "b").mapInArrow(_counts(sizes), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts, "pair-counts")
    counts = counts.withColumn("b", F.col("pair") % len(sizes[1]))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row an id of b
    counts = stored(counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # at most FREQUENT pairs can have more than that share of all links
    often = counts.filter(F.col("n") > total // FREQUENT).orderBy("pair").toArrow()
    table = spark.sparkContext.broadcast(tuple(often.column(x).cast(t).to_numpy().astype(k).tobytes() for x, t, k in (("pair", pa.int64(), "<i8"), ("n", pa.int64(), "<i8"), ("best", pa.uint8(), "u1"))))
    made = ids.mapInArrow(_aligned(sizes, key, table), f"`{key}` {kind}, {ALIGNED}").withColumn("row", F.monotonically_increasing_id())
    made = stored(made, "aligned")
    rare = made.filter(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.times").alias("times"))
    more = rare.join(counts, "pair").groupBy("row").agg(F.sum("times").alias("__all"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best"), F.sum(F.col("times") * F.col("n")).alias("__sum"))
    out = made.drop("rare", "times").join(more, "row", "left")
    add = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x)
    return out.select(key, "n_a", "n_b", "n_groups", "n_links", add("n_best", "__best"), add("count_sum", "__sum"), "groups_sha256")
