"""Quality classifier on supervised subword embeddings.

Words, their character n-grams and word bigrams are hashed, each to a learned vector; a document is the average of all its
vectors, and a softmax over two classes sits on top.  A word that repeats the one before it makes one and the same bigram, whatever
the word, as no sample holds all words that a text may repeat.  Training is numpy stochastic gradient descent on a bounded
sample of labelled rows; scoring covers every whole text."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_or_empty

#: The bound on the training sample: labelled documents of each class, those of the smallest hashes of doc_id.
SAMPLE = 1500
BUCKETS, DIM, EPOCHS, RATE, SEED = 1 << 17, 12, 6, 8.0, 7
GRAMS = (3, 4, 5)
#: Words whose sums a task keeps.
KEPT_WORDS = 100_000
THRESHOLD = 0.7


def subwords(word: bytes) -> list[int]:
    """Buckets of a word: its own, and those of the character n-grams of <word>."""
    full = b"<" + word + b">"
    n = len(full)
    return [crc32(word) % BUCKETS, *(crc32(full[i:i + k]) % BUCKETS for k in GRAMS if k <= n for i in range(n - k + 1))]


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _bigrams(found: list[bytes]) -> np.ndarray:
    """Buckets of the word bigrams of a text."""
    h = np.fromiter(map(crc32, found), np.uint64, len(found))
    pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:] * np.uint64(0x85EBCA6B) + np.uint64(1)) >> np.uint64(7)
    return (np.where(h[:-1] == h[1:], np.uint64(1), pairs) % np.uint64(BUCKETS)).astype(np.int64)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that a text has, rising, and how often it has each."""
    found = split(text)
    counts: dict[bytes, int] = {}
    for w in found:
        counts[w] = counts.get(w, 0) + 1
    total = np.bincount(_bigrams(found), minlength=BUCKETS).astype(float)
    for w, n in counts.items():
        np.add.at(total, subwords(w), n)
    at = np.nonzero(total)[0]
    return at, total[at]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that a text has and their shares in its average."""
    at, n = counted(text)
    return at, n / max(1.0, n.sum())


def packed(text: str | None) -> bytes:
    """The buckets of a text and their counts in a few bytes: steps from one bucket to the next are short, and most counts one."""
    at, n = counted(text)
    return zlib.compress(np.concatenate([np.diff(at, prepend=0), n]).astype("<u4").tobytes())


class Sample(Sequence):
    """Buckets, shares and class of each text of a sample.  Texts stay packed and are opened as they are asked for, one at a time."""

    def __init__(self, rows: list[tuple[bytes, int]]) -> None:
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        held, y = self.rows[i]
        steps, n = np.frombuffer(zlib.decompress(held), "<u4").reshape(2, -1)
        return np.cumsum(steps, dtype=np.uint32), (n / max(1.0, float(n.sum()))).astype("<f4"), y


@dataclass(frozen=True)
class Model:
    """``weight[b]``: the logit that bucket b adds (class vectors applied to its vector); ``bias``: the rest."""

    weight: np.ndarray
    bias: float


def train(sample: Sequence[tuple[np.ndarray, np.ndarray, int]], n0: int, n1: int, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Fits vectors and softmax; the bias is then moved from the sample's class balance to (n0, n1)."""
    classes = [y for *_, y in sample]
    k0, k1 = classes.count(0), classes.count(1)
    prior = math.log((n1 + 1) / (n0 + 1))
    if not k0 or not k1:
        return Model(np.zeros(BUCKETS), prior)
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    top, bias = rng.uniform(-0.5, 0.5, (DIM, 2)), np.zeros(2)
    steps, done = epochs * len(sample), 0
    for _ in range(epochs):
        for i in rng.permutation(len(sample)):
            at, share, y = sample[i]
            now = rate * (1 - done / steps)
            done += 1
            hidden = share @ vectors[at] if len(at) else np.zeros(DIM)
            logit = hidden @ top + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1.0
            back = top @ p
            top -= 0.1 * now * np.outer(hidden, p)
            bias -= 0.01 * now * p
            if len(at):
                vectors[at] -= now * np.outer(share, back)
    fixed = float(bias[1] - bias[0]) + prior - math.log(k1 / k0)
    return Model(vectors @ (top[:, 1] - top[:, 0]), fixed)


class _WordSums(dict):
    """word -> complex(sum of the weights of its buckets, number of them); keeps the first words it meets."""

    def __init__(self, weight: np.ndarray) -> None:
        self.weight, self.plain = weight, weight.tolist()

    def __missing__(self, word: bytes) -> complex:
        found = subwords(word)
        value = complex(sum(map(self.plain.__getitem__, found)), len(found))
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value


def score(sums: _WordSums, bias: float, text: str | None) -> float:
    found = split(text)
    total, pairs = sum(map(sums.__getitem__, found), 0j), _bigrams(found)
    logit = bias + (total.real + float(sums.weight[pairs].sum())) / max(1.0, total.imag + len(pairs))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, logit))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from labelled documents with crc32(doc_id as text) mod 4 other than 2.

    A document with several labels counts as good if most of them are (ties: good); null labels and ids don't
    count.  Each text of an id is taken once, ``sample`` texts of a class at most.  Without labels of both classes the model is the smoothed share of good ones."""
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("q"))
             .filter(F.col("doc_id").isNotNull() & F.col("q").isin(0, 1) & ~held_out())
             .groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("int").alias("q")))
    sizes = {r["q"]: r["count"] for r in known.groupBy("q").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.filter(F.col("q") == q).orderBy(*order).limit(sample) for q in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * sample rows at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # of the sample at most
        for batch in batches:
            made = []
            for doc, q, th, text in zip(*batch.columns, strict=True):
                if (key := (doc.as_py(), th.as_py())) not in seen:
                    seen.add(key)
                    made.append((key[0], q.as_py(), key[1], packed(text.as_py())))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*made, strict=True)) or [[]] * 4, kinds, strict=True)],
                                             names=["doc_id", "q", "th", "packed"])

    rows = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).join(chosen, "doc_id")
            .select("doc_id", "q", F.xxhash64("text").alias("th"), "text"))
    # an id may have many rows: each of its texts counts once, and the sample bounds the texts too
    texts = rows.select("doc_id", "q", "th").distinct()
    texts = [texts.filter(F.col("q") == q).orderBy(*order, "th").limit(sample).drop("q") for q in (0, 1)]
    rows = rows.join(F.broadcast(texts[0].unionByName(texts[1])), ["doc_id", "th"]).select("doc_id", "q", "th", "text")
    rows = rows.mapInArrow(extract, "doc_id bigint, q int, th bigint, packed binary").dropDuplicates(["doc_id", "th"])
    # the driver gets packed texts, one partition at a time
    rows = sorted((r["doc_id"], r["packed"], r["q"]) for r in rows.select("doc_id", "packed", "q").toLocalIterator())
    return train(Sample([(held, q) for _, held, q in rows]), sizes.get(0, 0), sizes.get(1, 0))


def held_out(key: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def with_scores(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` of docs (with text among them or not) and ``score`` of each whole text.  The scores come from the
    text alone."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model.weight.astype(np.float64).tobytes())  # BUCKETS numbers
    bias = model.bias

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sums = _WordSums(np.frombuffer(held.value, np.float64))  # of this task, gone with it
        for texts in batches:
            yield pd.Series([score(sums, bias, t) for t in texts], dtype="float64")
        del sums
        give_back()

    return docs.select(*columns, scored(text_or_empty()).alias("__score"))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.7).

    Null and empty texts get the score of the bias alone.  Null ids are not held out.  Equal texts get equal scores,
    repeated rows too; a text of one endless word is scored whole.  Empty tables of documents give an
    empty result; without labels every score is 0.5."""
    out = with_scores(docs, fit(docs, labels, sample), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"),
                      (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
