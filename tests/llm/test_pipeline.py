"""The corpus pipeline, stage by stage against the operators' brute force, and end to end."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from arborix.llm import classifier, decontamination, similar
from arborix.llm.queries import ORACLES, QUERIES
from tests.compare import same


def brute_near(docs):
    """The smallest id of each group that 5-word shingle sets of similarity 0.8 connect."""
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()))
    sets = []
    for _, t in rows:
        w = decontamination.tokens(t)
        sets.append(set(decontamination.shingles(w)))
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {rows[i][0] for i in range(len(rows)) if top(i) == i}


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    (_, quality), (_, dedup), (_, clean), (_, mix), (_, ids) = corpus_pipeline.STAGES
    one = quality(spark, docs, small)
    assert one.columns == docs.columns
    kept = {r.doc_id for r in one.collect()}
    scored = classifier.quality_scores(docs, spark.read.parquet(f"{small}/labels.parquet")).collect()
    assert kept == {r.doc_id for r in scored if r.score >= 0.7}
    two = dedup(spark, docs, small)
    assert two.columns == docs.columns
    assert {r.doc_id for r in two.collect()} == brute_near(docs)
    three = clean(spark, docs, small)
    leaked = {r.doc_id for r in decontamination.leaks(docs, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert three.columns == docs.columns and leaked
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in docs.collect()} - leaked
    four = mix(spark, docs, small)
    assert four.columns == docs.columns and 1.2 < four.count() / docs.count() < 1.8
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(zlib.crc32(np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for r in docs.collect())
    assert sorted(r.ids_crc32 for r in ids(spark, docs, small).collect()) == want


def test_awkward_rows_pass_through(spark, small):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, __x int, __score int, __times int, __time int, __id int, __th int, __row int, row int, __gone int"
    more = (1,) * 9
    rows = [(1, "a b c d e f g", "en", None, 1, 0.5, *more), (1, "a b c d e f g", "en", None, 1, 0.5, *more), (None,) * 15, (2, "", "", "", 0, None, *more)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
        assert stage(spark, docs.limit(0), small).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == 4
    assert corpus_pipeline.STAGES[1][1](spark, docs, small).count() == 2  # one of the copies, one of those without words


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small).orderBy("start").collect()
    assert [r.start for r in rows] == list(np.cumsum([0, *[r.n_tokens for r in rows]])[:-1])
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)


def test_registered_sql(spark, small):
    for name, sql in ORACLES.items():
        same(QUERIES[name](spark, small), small, sql)


def test_near_dedup_links_by_similarity(spark, small):
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows = []
    for i in range(40):
        base = word(150)
        edited = list(base)
        for at in (20, 70, 120)[: 1 + i % 3]:
            edited[at] = "changed"
        half = base[:75] + word(75)
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(edited)), (3 * i + 2, " ".join(half))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    cut = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    kept = []
    for i, _ in rows:  # copies link to their base alone
        if not any(len(cut[i] & cut[j]) / len(cut[i] | cut[j]) >= 0.8 for j in kept):
            kept.append(i)
    assert len(kept) == 80
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, small).collect()) == kept


def test_ids_do_not_decide(spark, small):
    """Different texts without an id, or under one, are judged each by itself."""
    item = spark.read.parquet(f"{small}/benchmark.parquet").filter("length(text) > 200").first().text
    rows = [(None, f"a text of its own number {i} that has words like {i * 7} and {i * 11}") for i in range(5)] + [(9, "one two three four five six"), (9, "seven eight nine ten eleven")]
    docs = spark.createDataFrame([*rows, (None, item), (9, item)], "doc_id bigint, text string")
    want = sorted(t for _, t in rows)
    assert sorted(r.text for r in corpus_pipeline.decontaminate(spark, docs, small).collect()) == want
    assert sorted(r.text for r in corpus_pipeline.near_dedup(spark, docs, small).collect()) == sorted([*want, item])


def test_large_groups_are_verified_in_parts(spark, monkeypatch):
    """The same groups whatever the number of texts that a task takes."""
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    rows = []
    for i in range(60):
        edited = list(base)
        for at in rng.integers(0, 120, 1 + i % 4):
            edited[at] = f"e{i}"
        rows.append((i, " ".join(edited)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(similar, "RADIUS", 256)
    got = [sorted((r.doc_id, r.group) for r in similar.groups(docs, part=p).collect()) for p in (4096, 7)]
    first = [[min(d for d, h in x if h == g) for _, g in x] for x in got]
    assert first[0] == first[1] and 1 < len(set(first[0])) < 60
    assert set(first[0]) == brute_near(docs)


def test_repeats_do_not_hide_near_copies(spark, small):
    """Similarity is one of sets, so a phrase that one of two texts repeats must not move their fingerprints apart."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(10):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base, *["over", "and", "out", "again"] * 100]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert brute_near(docs) == {2 * i for i in range(10)}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, small).collect()} == brute_near(docs)


def test_candidates_are_all_pairs_within_the_radius(spark):
    """Fingerprints alone decide on candidates, short texts included, however they are dealt to tiles."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(120):
        more = rng.integers(0, 2**64, (3, 4), np.uint64)
        fp = more[0] if i % 12 == 0 else fp ^ np.bitwise_and.reduce(more)  # about 32 bits on
        rows.append((i, fp.tobytes(), int(rng.choice([3, 4, 5, 60, 70, 75, 100, 3000]))))
    sets = spark.createDataFrame(rows, "node bigint, fp binary, size int")
    words = [np.frombuffer(f, "<u8") for _, f, _ in rows]
    up = list(range(len(rows)))
    for i, (_, _, a) in enumerate(rows):
        for j, (_, _, b) in enumerate(rows[:i]):
            if min(a, b) >= 4 and min(a, b) >= 0.8 * max(a, b) and np.bitwise_count(words[i] ^ words[j]).sum(dtype=int) <= 80 and up[i] != up[j]:
                up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
    want = {(i, r) for i, r in enumerate(up) if i != r}
    assert len(want) > 20
    for tile in (3, 4096):
        assert {(r.node, r.root) for r in similar.components(similar.links(sets, 80, 0.8, tile)).collect() if r.node != r.root} == want
