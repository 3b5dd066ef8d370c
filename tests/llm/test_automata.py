"""Spans of words that a smaller document has, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from arborix.llm import automata
from arborix.llm.automata import Automaton

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, th bigint, words binary, spans string, copy int, sid bigint"


def brute(rows, length):
    low = {}
    key = lambda d: -(1 << 62) if d is None else d
    texts = [(key(d), WORD.findall(t or "")) for d, t in rows]
    for d, w in texts:
        for i in range(len(w) - length + 1):
            x = tuple(w[i:i + length])
            low[x] = min(low.get(x, d), d)
    out = []
    for (d, w), (doc, _) in zip(texts, rows, strict=True):
        gone = {j for i in range(len(w) - length + 1) if low[tuple(w[i:i + length])] < d for j in range(i, i + length)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    out = []
    for r in df.collect():
        assert r["n_removed"] == sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2], strict=True))
        out.append((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1, 2, b"x", "y", 3, 4) for d, t in rows], SCHEMA).repartition(3)


def made(seed, n, words, most, length):
    """Texts that take passages from one another."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        w = []
        while len(w) < rng.randint(0, most):
            if texts and rng.random() < 0.6:
                t = rng.choice(texts).split()
                a = rng.randint(0, len(t))
                w += t[a:a + rng.randint(1, 3 * length)]
            w += [f"w{rng.randrange(words)}" for _ in range(rng.randint(0, 12))]
        texts.append(rng.choice([" ", "\n", " \t", "  "]).join(w))
    return texts


@pytest.mark.parametrize("seed,n,words,most,length", [(1, 60, 3, 60, 6), (2, 50, 500, 300, 50), (3, 80, 40, 120, 11), (4, 40, 2, 90, 1)])
def test_spans(spark, monkeypatch, seed, n, words, most, length):
    monkeypatch.setattr(automata, "SHARD_WORDS", 200)
    monkeypatch.setattr(automata, "TASK_WORDS", 150)
    texts = made(seed, n, words, most, length)
    ids = random.Random(seed).sample(range(1000), n)
    rows = list(zip(ids, texts, strict=True)) + [(None, texts[3]), (None, texts[5] + " more"), (ids[2], texts[7]), (ids[4], texts[4]), (5000, None), (5001, ""), (5002, texts[9])]
    assert got(automata.remove_spans(frame(spark, rows), length)) == brute(rows, length)


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    mine = got(automata.remove_spans(docs))
    assert mine == brute([(r["doc_id"], r["text"]) for r in docs.collect()], 50)
    assert sum(r[2] for r in mine) > 1000


def test_one_passage_everywhere(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"a{i} b{i} {passage} c{i} é ü{i}") for i in range(300)] + [(1000, passage), (1001, passage), (1002, " ".join(f"q{i % 7}" for i in range(9000)))]
    assert got(automata.remove_spans(frame(spark, rows))) == brute(rows, 50)


def test_routes_of_a_common_anchor(spark, monkeypatch):
    """A stretch goes to the few shards that have its windows, though its anchor has passages in all of them."""
    tables = {}

    def kept(df, label):
        tables[label] = stored(df, label)
        return tables[label]
    stored = automata.stored
    monkeypatch.setattr(automata, "stored", kept)
    monkeypatch.setattr(automata, "SHARD_WORDS", 150)
    common = " ".join(["the"] * 40)
    passages = [f"{common} " + " ".join(f"x{i}y{j}" for j in range(30)) for i in range(40)]
    rows = [(2 * i + j, f"a{i} b{j} {p} c{i} d{j}") for i, p in enumerate(passages) for j in range(2)]
    assert got(automata.remove_spans(frame(spark, rows))) == brute(rows, 50)
    assert tables["span-load"].count() > 10
    assert tables["span-routed"].count() <= 3 * tables["span-stretches"].count()


def test_nothing(spark):
    out = automata.remove_spans(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"] and out.count() == 0
    assert got(automata.remove_spans(frame(spark, [(1, None), (None, None)]))) == brute([(1, None), (None, None)], 50)


def test_word_hashes():
    text = ("ab " * 3000 + "x" * 9000 + " ab\tcd \x0b ab" + " é" * 500).encode()
    begin, end, h = automata.words_of(np.frombuffer(text, np.uint8))
    words = text.split()
    assert [text[a:b] for a, b in zip(begin, end, strict=True)] == words
    by = {}
    for w, x in zip(words, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_automaton_is_plain_search(letters):
    rng = random.Random(letters)
    for _ in range(60):
        texts = [(rng.randrange(9), [b"%d" % rng.randrange(letters) for _ in range(rng.randint(1, 30))]) for _ in range(rng.randint(1, 6))]
        a = Automaton(texts)
        for _ in range(5):
            t, doc, n = [b"%d" % rng.randrange(letters + 1) for _ in range(40)], rng.randrange(10), rng.randint(1, 8)
            want = [i for i in range(len(t) - n + 1) if any(d < doc and any(w[j:j + n] == t[i:i + n] for j in range(len(w) - n + 1)) for d, w in texts)]
            assert a.matches(t, doc, n) == want
