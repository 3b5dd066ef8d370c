"""Alignment of tokens against plain loops over the tokenizers' own output."""

import bisect
import hashlib
import os
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from arborix.llm import alignment
from arborix.llm.alignment import links, shared_cuts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, b string, pair bigint, times int, best boolean"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Ids and bytes of a text by both tokenizers, whole."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}

    def run(text):
        if not text:
            return []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = sp.encode(text)
        toks_a = [(i, bytes(back[x] for x in a.id_to_token(i))) for i in ids_a]
        toks_b = [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, sp.id_to_piece(i)) for i in ids_b)]
        whole = (" " + text).encode()
        return [toks_a, toks_b] if b"".join(x for _, x in toks_a) == whole == b"".join(x for _, x in toks_b) else []
    return run


def brute(rows, plain):
    made, counts = [], Counter()
    for doc, text in rows:
        got = plain(text)
        if not got:
            made.append((doc, [], [], []))
            continue
        spans = []
        for toks in got:
            at, out = 0, []
            for i, x in toks:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        pairs, first = [], 0
        for i, s, e in spans[0]:
            while spans[1][first][2] <= s:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][1] < e:
                pairs.append((i, spans[1][k][0]))
                k += 1
        counts.update(pairs)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = [([], []) for _ in cuts]
        for side, toks in enumerate(spans):
            for i, _, e in toks:
                groups[bisect.bisect_left(cuts, e)][side].append(i)
        made.append((doc, spans, groups, pairs))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc, spans, groups, pairs in made:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc, *(len(x) for x in (spans or [[], []])), len(groups), len(pairs), sum(counts[p] == most[p[1]] for p in pairs),
                    sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(df):
    assert df.columns == NAMES
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


@pytest.mark.parametrize("frequent", [1 << 22, 100, 1])
def test_documents(spark, small, plain, monkeypatch, frequent):
    """Frequent pairs from the table, others (or all) by the join: the same."""
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert got(alignment.align(docs, A, B)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], plain)


def test_awkward_texts(spark, plain):
    texts = [None, "", " ", "  two  spaces ", "a", "a\nb\tc  d", "\n", "<|endoftext|> <s> </s> <unk> <0x0A>", "▁ joined▁up ▁", "日本語のテキスト、ですよ 😀😀 ok", "naïve Straße ÷ × ½ ² 3rd",
             "don't we'll I'M it's 'tis", "x" * 5000, "é" * 700, "a b " * 3000, "…“quoted” – dash", " \x85\xa0 z", "é ́a", "tab\t\tend\t", "\x00nul", "ﬁ ligature ①"]
    rows = [(i, t, "en", "s", 1, 1, "b", 2, 3, True) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "no id at all", *rows[0][2:]), (None, None, *rows[0][2:]), (3, "another text of id three", *rows[0][2:])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(alignment.align(df, A, B)) == brute([r[:2] for r in rows], plain)


def test_nothing(spark):
    assert got(alignment.align(spark.createDataFrame([], SCHEMA), A, B)) == []
    assert got(alignment.align(spark.createDataFrame([(1, None, *[None] * 8)], SCHEMA), A, B)) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_cuts_and_links():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 10, 500):
        for share in (0.02, 0.3, 0.9):
            a = np.append(np.nonzero(rng.random(n - 1) < share)[0] + 1, n)
            b = np.append(np.nonzero(rng.random(n - 1) < 0.5)[0] + 1, n)
            i, j = shared_cuts(a, b)
            both = np.intersect1d(a, b)
            assert (a[i] == both).all() and (b[j] == both).all() and len(i) == len(both)
            starts = [np.concatenate([[0], x[:-1]]) for x in (a, b)]
            want = {(p, q) for p in range(len(a)) for q in range(len(b)) if max(starts[0][p], starts[1][q]) < min(a[p], b[q])}
            i, j = links(a, b)
            assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want
