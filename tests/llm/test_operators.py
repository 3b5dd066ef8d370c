"""Each operator against brute force, on the smallest tables and on rows made to be awkward."""

import gzip
import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

from arborix.llm import classifier, decontamination, lines, mixing, quality, sharding, simhash, suffix, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, rank int, fp string, spots string, q int"
LONG = "word another thing " * 4000


def edge_rows():
    """Nulls, empty and long texts, ties, repeated rows and extra columns named like the operators' own."""
    texts = [None, "", " \t\n", "a", "a b c d e f", "a b c d e f", LONG, LONG, "Zeile\nnoch eine\nund mehr\n\nZeile\nnoch eine", "x" * 120, "é" * 60 + "\U0001F600 b",
             "Zeile\nnoch eine", "the same long enough passage of text that repeats over documents and goes on for a while", "A B C D E F", "b " * 40]
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2", ""][i % 4], None, 1, 2, "x", "y", 3) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[6], (None, "a null id", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))


# -- quality rules


def base(text):
    text = text or ""
    w = WORD.findall(text)
    ls = [x for x in text.split("\n") if WORD.search(x)]
    runs = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if runs[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(ls) - len(set(ls)), len(inside)


@pytest.mark.parametrize("which", ["edges", "docs"])
def test_quality_base(request, which):
    df = request.getfixturevalue(which)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.quality_rules(df).collect())
    assert got == Counter((i, *base(t)) for i, t in rows_of(df))


def test_quality_verdicts(spark, nothing, docs):
    assert quality.quality_rules(nothing).count() == 0
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(vocabulary, 200)) + ".", "en", "s", 0) for i in range(300)]
    rows += [(1000 + i, " ".join(w + "***$$$" for w in rng.choice(vocabulary, 200)), "en", "s", 0) for i in range(20)]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, docs.schema)).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(20))


def plain_factor(x, fix=1.0):
    """Floored Cholesky factor of a covariance, as the operator defines it."""
    c = np.cov(x, rowvar=False, bias=True) * fix
    p, low = len(c), np.zeros((len(c), len(c)))
    for i in range(p):
        for j in range(i + 1):
            rest = c[i, j] - low[i, :j] @ low[j, :j]
            low[i, j] = np.sqrt(max(rest + quality.FLOORS[i] ** 2, quality.FLOORS[i] ** 2 / 4)) if i == j else rest / low[j, j]
    return low


def test_determinants_are_least(spark):
    """In small cells with outliers no subset of the core's size has a smaller determinant."""
    rng = np.random.default_rng(6)
    data = {f"cell{k}": np.round(np.concatenate([rng.normal(k, 0.4 + 0.1 * k, (9, 5)), rng.normal(6 + k, 1, (3, 5))]) * 4096) / 4096 for k in range(3)}
    rows = spark.createDataFrame([(k, "lang", *map(float, x)) for k, m in data.items() for x in m], ["cell", "lang_cell", *quality.FEATURES])
    got = {r.cell: r.logdet for r in quality.mcd(rows).collect()}
    for k, m in data.items():
        every = [2 * np.log(np.diag(plain_factor(m[list(s)], quality.FIX_CORE))).sum() for s in combinations(range(len(m)), 9)]
        assert got[k] <= min(every) + 1e-6
    assert set(got) == {*data, "lang", "all"}


def test_small_cells_lean_on_their_language(spark, docs):
    """An outlier is seen in a cell of 4 documents, and clean documents stay there."""
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(100, 400)))) + ".", "en", "large", 0) for i in range(200)]
    rows += [(1000 + i, " ".join(rng.choice(vocabulary, 200)) + ".", "en", "small", 0) for i in range(3)]
    rows += [(2000, " ".join(w + "***$$$" for w in rng.choice(vocabulary, 200)), "en", "small", 0)]
    got = {r.doc_id: (r.kept, r.distance) for r in quality.quality_rules(spark.createDataFrame(rows, docs.schema)).collect()}
    assert all(got[i][0] for i in range(200)) and all(got[1000 + i][0] for i in range(3)) and not got[2000][0]
    assert all(d is not None for _, d in got.values())


# -- WARC


def test_archives(spark):
    rows = [(1, "http://a/ b", "x" * 1500), (2, None, "x" * 1500), (3, "", "x" * 1500), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (7, "é\r\n\r\n", "é\r\n\r\n" * 400),
            (None, "u", "x" * 1500), (7, "é\r\n\r\n", "é\r\n\r\n" * 400)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, digest string").repartition(2)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.pages_through_warc(df).collect())
    best = defaultdict(lambda: -1)
    for i, _, h in rows:
        best[h] = max(best[h], -1 if i is None else i)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and best[h] != i
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", best[h] if again else None] += 1
    assert got == want
    assert warc.pages_through_warc(df.limit(0)).count() == 0


def test_header_lines():
    one = warc.version_block(1, "a.arc", "20000101000000") + b"\n" + warc.arc_record(1, "http://a b", "1.2.3.4", "20010203040506", "text/html", b"x\ny") + b"\n"
    two = warc.version_block(2, "b.arc", "20000101000000") + b"\n" + warc.arc_record(2, "http://c", "1.2.3.4", "20010203040506", "text/html", b"") + b"\n"
    assert [(r["version"], r["url"], r["date"], r["body"]) for r in warc.parse_arc(one) if not r["first"]] == [(1, "http://a b", "20010203040506", b"x\ny")]
    assert [(r["version"], r["url"], r["kind"], r["body"]) for r in warc.parse_arc(two) if not r["first"]] == [(2, "http://c", "text/html", b"")]
    with pytest.raises(ValueError):
        list(warc.parse_arc(one[:-4]))


def test_archives_with_rejects(spark, tmp_path):
    """Broken lines, lengths and dates are listed, the rest is converted; HTTP messages are responses, other bodies resources."""
    http = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\nContent-Length: 5\r\n\r\nhello"
    parts = [warc.version_block(1, "a.arc", "20000101000000"), warc.arc_record(1, "http://a", "1.2.3.4", "20010203040506", "text/html", http), b"no header line at all\nnor here",
             warc.arc_record(1, "dns:example.org", "1.2.3.4", "200102030405", "text/dns", b"1.2.3.4"), warc.arc_record(1, "http://b", "1.2.3.4", "2001xx", "text/html", http),
             warc.arc_record(1, "http://c", "1.2.3.4", "20019903040506", "text/html", http), warc.arc_record(1, "ftp://d/e", "1.2.3.4", "20010203040506", "text/plain", b"body"),
             b"http://e 1.2.3.4 20010203040506 text/html 999\nshort"]
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "part-0.arc").write_bytes(b"\n".join(parts) + b"\n")
    arc, target = f"file://{tmp_path}/arc", f"file://{tmp_path}/warc"
    assert [r.reason for r in sorted(warc.rejected(spark, arc).collect(), key=lambda r: r.byte)] == [
        "not a header line of version 1", "no date", "no date", "declares 999 bytes where 6 are left"]
    warc.convert(spark, arc, target)
    got = sorted((r.record_type, r.page_id, r.payload_bytes) for r in warc.read_warc(spark, target).collect())
    assert got == [("resource", None, 4), ("resource", None, 7), ("response", 7, 5)]


def test_warc_records_are_members(spark, tmp_path):
    """Files are bounded in bytes and begin with their warcinfo; every record is a gzip member of its own."""
    rng = np.random.default_rng(1)
    rows = [(i, f"http://u/{i}", "".join(rng.choice(list("abcdef"), 1200))) for i in range(40)] + [(99, "http://big", "".join(rng.choice(list("abcdef"), 40000)))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    assert warc.pages_through_warc(pages, f"file://{tmp_path}", 1000, 5000).count() == 41
    files, sizes = sorted((tmp_path / "warc").glob("part-*")), []
    for f in files:
        data, kinds = f.read_bytes(), []
        sizes.append(len(data))
        while data:
            one = zlib.decompressobj(31)
            whole = one.decompress(data)
            data = one.unused_data
            kinds += [next(warc.parse_warc(whole))[0]["warc-type"]] if whole else []
            assert whole.count(b"WARC/1.0\r\n") <= 1
        assert kinds[0] == "warcinfo" and set(kinds[1:]) == {"response"}
    assert len(files) > 5 and sorted(sizes)[-2] < 6000


def test_gzip_members_are_read_one_by_one():
    parts = [b"", b"a" * 100_000, bytes(np.random.default_rng(2).integers(0, 256, 50_000, np.uint8)), b"end"]
    data = b"".join(gzip.compress(x) for x in parts) + warc.EMPTY_MEMBER
    assert warc._plain(data) == b"".join(parts) and warc._plain(b"plain") == b"plain"
    with pytest.raises(EOFError):
        warc._plain(data[:-3])


# -- mixing


def water(sizes, weights, share, most):
    left, capped, total = dict(zip(sizes, weights, strict=True)), {}, share * sum(sizes.values())
    while left:
        level = (total - sum(capped.values())) / sum(left.values())
        over = [s for s, w in left.items() if level * w > most * sizes[s]]
        if not over:
            return capped | {s: level * w for s, w in left.items()}
        for s in over:
            capped[s] = most * sizes[s]
            del left[s]
    return capped


@pytest.mark.parametrize("which", ["edges", "docs"])
def test_mixing(request, which):
    df = request.getfixturevalue(which)
    got = mixing.mix(df, [3, 1, 2], 1.5).collect()
    again = mixing.mix(df.repartition(5), [3, 1, 2], 1.5).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, base(t)[0]) for i, t in rows_of(df))
    sizes = defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
    sizes = {s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s or ""))}
    want = water(sizes, [[3, 1, 2][i % 3] for i in range(len(sizes))], 1.5, 2.0)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


@pytest.mark.parametrize("block", [256, 5])
def test_schedule(spark, docs, block):
    """Every slot against a plain walk along the golden ratio; prefixes stay near the targets; documents report their slots."""
    rows = mixing.mix(docs, [3, 1, 2], 1.5, 2.0, block).collect()
    target = {r.source: r.target for r in rows}
    names = sorted(target, key=lambda s: (s is None, s or ""))
    total, edges, at = sum(target.values()), [], 0.0
    for s in names:
        at += target[s]
        edges.append(at / total)
    count, slots = round(total / block), defaultdict(list)
    for i in range(count):
        u = (i + 1) * mixing.GOLDEN % 1.0
        slots[names[min(int(np.searchsorted(edges, u, "right")), len(names) - 1)]].append(i)
        if i % 50 == 49:
            assert all(abs(len(slots[s]) - (i + 1) * target[s] / total) < 5 for s in names)
    for s in names:
        need = -(-int(target[s]) // block)
        slots[s] = (slots[s] + [count + r for r in range(len(slots[s]), need)])[:need]
    line, size = defaultdict(int), {r.source: r.source_size for r in rows}
    place = lambda r: (int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16), r.doc_id, r.size)
    for r in sorted(rows, key=place):
        a, n, used = line[r.source], int(target[r.source]), set()
        line[r.source] += r.size
        for x in (a, a + size[r.source]):
            used |= {slots[r.source][k] for k in range(x // block, -(-min(x + r.size, n) // block))} if r.size and x < n else set()
        assert (r.first_slot, r.n_slots) == (min(used, default=None), len(used))


def test_mixing_nothing(nothing):
    assert mixing.mix(nothing, [3, 1, 2], 1.5).count() == 0


# -- SimHash


def plain_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("which,tile", [("edges", 4096), ("docs", 4096)])
def test_simhash(request, which, tile):
    df = request.getfixturevalue(which)
    data = rows_of(df)
    f = [plain_fingerprint(t) for _, t in data]
    up = list(range(len(f)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(f)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 4:
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    want = Counter((d, f"{f[i]:016x}", least.get(top(i))) for i, (d, _) in enumerate(data))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()) == want


def test_small_tiles_find_the_same(spark):
    rng = np.random.default_rng(3)
    v = list({int(x) for x in rng.integers(0, 1 << 63, 60)})
    v += [x ^ (1 << int(b)) for x in v[:20] for b in rng.integers(0, 62, 3)]
    fps = simhash.stored(spark.createDataFrame([(x,) for x in set(v)], "fp bigint"), "test")
    roots = lambda t: Counter((r.node, r.root) for r in simhash.components(simhash.links(fps, 4, t)).collect())
    assert roots(2) == roots(4096) and len(roots(2)) > 20


def test_simhash_nothing(nothing):
    assert simhash.near_duplicates(nothing).count() == 0


# -- decontamination


def test_leaks(spark, docs, small, edges, nothing):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    more = spark.createDataFrame([(9000, None), (9001, ""), (9002, "a b c d e f"), (9003, "x y"), (9003, "A B C D E F")], bench.schema)
    bench = bench.unionByName(more)
    items = [(r.item_id, decontamination.tokens(r.text)) for r in bench.collect()]
    for df in (docs, edges):
        want = Counter()
        for i, t in rows_of(df):
            w = decontamination.tokens(t)
            for k, x in items:
                if w and x:
                    span, width, c = min(len(x), len(w)), min(5, len(x)), Counter(decontamination.shingles(x))
                    want[i, k] += any(decontamination.similarity(Counter(decontamination.shingles(w[a:a + span], width)), c) >= 0.8 for a in range(len(w) - span + 1))
        got = Counter((r.doc_id, r.item_id) for r in decontamination.leaks(df, bench).collect())
        assert got == +want and sum(got.values()) > 0
    assert Counter(tuple(r) for r in decontamination.leaks(docs, bench, pass_bytes=2000).collect()) == Counter(tuple(r) for r in decontamination.leaks(docs, bench).collect())
    assert decontamination.leaks(nothing, bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0


def test_multi_index_is_complete():
    rng = np.random.default_rng(1)
    f = [int(x) for x in rng.integers(0, 1 << 63, 300)]
    index = decontamination.MultiIndex(f)
    q = [x ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 24)), replace=False)) for x in f[:100]]
    got = list(zip(*(x.tolist() for x in index.within(np.array(q, np.uint64))), strict=True))
    assert got == [(a, i) for a, y in enumerate(q) for i, x in enumerate(f) if (x ^ y).bit_count() <= decontamination.RADIUS]


def test_windows_have_their_simhash():
    rng = np.random.default_rng(9)
    pieces = [str(x).encode() for x in rng.integers(0, 50, 200)]
    h = np.array([xxhash.xxh64_intdigest(x, 42) for x in pieces], np.uint64)
    at = np.array([3, 4, 9, 150])
    assert decontamination.window_fingerprints(h, at, 40).tolist() == [decontamination.simhash(pieces[a:a + 40]) for a in at]


def test_most_similar_windows_are_within_the_radius():
    """Items of 60 to 200 words with words replaced until the similarity is just 0.8 or more."""
    rng = np.random.default_rng(10)
    near, n = 0, 300
    for _ in range(n):
        w = [f"w{x}".encode() for x in rng.integers(0, 3000, int(rng.integers(60, 200)))]
        item, now = Counter(decontamination.shingles(w)), list(w)
        while True:
            more = list(now)
            more[int(rng.integers(0, len(w)))] = b"other"
            if decontamination.similarity(Counter(decontamination.shingles(more)), item) < 0.8:
                break
            now = more
        near += (decontamination.simhash(decontamination.shingles(now)) ^ decontamination.simhash(decontamination.shingles(w))).bit_count() <= decontamination.RADIUS
    assert near / n > 0.9
    print("within the radius", near, n)


# -- sharding


@pytest.mark.parametrize("which", ["edges", "docs"])
def test_sharding(request, which):
    df = request.getfixturevalue(which)
    got = sharding.shard_records(df, [1.0] * 8).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows_of(df))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len({r.shard for r in got if r.doc_id == i}) == 1 for i in {r.doc_id for r in got})


def test_shares_follow_weights(spark, nothing):
    ids = spark.range(20000).selectExpr("id AS doc_id", "'' AS text")
    n = Counter(r.shard for r in sharding.shard_records(ids, [1.0, 3.0]).collect())
    assert abs(n[1] / 20000 - 0.75) < 0.02
    assert sharding.shard_records(nothing, [1.0] * 8).count() == 0


# -- token ids


def test_token_files(spark, docs, edges, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for df in (docs, edges):
        got = sorted(tokens.token_files(df, path).collect(), key=lambda r: r.start)
        ids = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows_of(df)]
        assert Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids) == Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got)
        assert [r.start for r in got] == list(np.cumsum([0, *[r.n_tokens for r in got]])[:-1])
        assert [r.doc_id for r in got] == [i for i, _ in ids]
    assert tokens.token_files(nothing, path).count() == 0


def test_short_document_access(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, target = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/t"
    tokens.write(docs, path, target)
    raw = bytes(spark.read.parquet(f"{target}/dictionary").first()["dictionary"])
    files = [bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{target}/ids").collect()]
    row = docs.orderBy("doc_id").first()
    found = [tokens.read_document(f, row.doc_id, raw) for f in files if row.doc_id in tokens.read_index(f)[3]["doc"]]
    assert found[0].tolist() == Tokenizer.from_file(path).encode(row.text, add_special_tokens=False).ids + [1]


def test_files_are_read_in_order_of_their_numbers(spark, edges, monkeypatch):
    """Many small files; rows of one id, nulls too, may lie in several of them."""
    import public_tokenizers

    monkeypatch.setattr(tokens, "FILE_BYTES", 64)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = sorted(tokens.token_files(edges.unionByName(edges), path).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == list(np.cumsum([0, *[r.n_tokens for r in got]])[:-1])
    assert [r.doc_id for r in got] == [i for i, _ in sorted(rows_of(edges) * 2, key=lambda x: (x[0] is not None, x[0] or 0))]


# -- classifier


def test_classifier(spark, small, docs, edges, nothing):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    sf = small.replace("sf0.001", "sf0.01")
    d, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in classifier.quality_scores(d, known).collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(got[r.doc_id].predicted, r.quality) for r in known.collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    scores = defaultdict(set)
    texts = rows_of(edges)
    out = classifier.quality_scores(edges, labels).collect()
    assert len(out) == len(texts)
    for r in out:
        scores[r.doc_id].add(r.score)
    assert scores[4] == scores[5] and scores[6] == scores[7] and len(scores[1]) == 1
    assert classifier.quality_scores(nothing, labels).count() == 0
    assert {r.score for r in classifier.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


# -- line runs


def brute_lines(data, least, long):
    """At every place the longest run that also starts at an earlier place, by comparison with all of these; of these runs those within no other."""
    seqs, starts = {}, defaultdict(list)
    for i, t in dict.fromkeys(data):
        w = seqs[i, t] = [x for x in (t or "").split("\n") if WORD.search(x)]
        for a, x in enumerate(w):
            starts[x].append(((i is not None, i or 0, a), w))
    want = Counter()
    for i, t in data:
        ls = (t or "").split("\n")
        at = [j for j, x in enumerate(ls) if WORD.search(x)]
        w, spans = seqs[i, t], []
        for a, x in enumerate(w):
            n = max((next(k for k in range(len(w) + 1) if a + k >= len(w) or p[2] + k >= len(v) or w[a + k] != v[p[2] + k])
                     for p, v in starts[x] if p < (i is not None, i or 0, a)), default=0)
            if n >= least or (n and len(WORD.findall(x)) >= long):
                spans.append((a, a + n if n >= least else a + 1))
        runs = [s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans)]
        gone = {b for s in spans for b in range(*s)}
        out = {at[b] for b in gone}
        want[i, len(ls), len(gone), len(runs), max((b - a for a, b in runs), default=0), "\n".join(x for j, x in enumerate(ls) if j not in out)] += 1
    return want


def found_lines(df, *settings):
    return Counter((r.doc_id, r.n_lines, r.n_deleted, r.n_runs, r.longest_run, r.kept_text) for r in lines.dedup_lines(df, *settings).collect())


@pytest.mark.parametrize("which,least,long", [("edges", 2, 50), ("docs", 2, 50), ("docs", 5, 20)])
def test_line_runs(request, which, least, long):
    df = request.getfixturevalue(which)
    assert found_lines(df, least, long) == brute_lines(rows_of(df), least, long)


@pytest.mark.parametrize("least,long", [(2, 50), (3, 2)])
def test_line_runs_of_all_lengths(spark, least, long):
    """Runs of 1 to 50 lines of few different ones, copied within and between documents, and copies of whole texts."""
    rng = np.random.default_rng(8)
    line = lambda: rng.choice(["a", "b", "c d", "", " ", f"u{rng.integers(0, 400)}", "many " * 60])
    runs = [[str(line()) for _ in range(k)] for k in (1, 2, 3, 5, 8, 13, 31, 32, 33, 50)]
    rows = [(int(i) - 5, "\n".join(sum(([str(line())] * int(rng.integers(0, 3)) + runs[j] for j in rng.integers(0, len(runs), 1 + i % 4)), []))) for i in range(50)]
    rows += [(200 + i, rows[i % 9][1]) for i in range(20)] + [(300 + i, x) for i, x in enumerate(["many " * 60] * 3 + ["many " * 60 + "\nz"] * 3)] + [(None, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert found_lines(df, least, long) == brute_lines(rows, least, long)


@pytest.mark.parametrize("least,long", [(1, 50), (2, 50), (3, 3), (5, 50)])
def test_line_runs_random(spark, least, long):
    """Lines of a small alphabet: runs within runs, overlaps with themselves, and groups that branch at every length."""
    rng = np.random.default_rng(17)
    line = lambda a: rng.choice(["x", "y z", "u v w", "p", "q", "r"][:a])
    rows = [(int(rng.integers(-9, 30)) * 100 + i, "\n".join(str(line(a)) for _ in range(rng.integers(0, 40)))) for i in range(40) for a in (1 + i % 6,)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert found_lines(df, least, long) == brute_lines(rows, least, long)


def test_line_runs_that_touch(spark):
    """Two runs side by side are two, as no run of four lines repeats; a longer copy is one run, and one that extends to the left is not counted apart."""
    texts = ["a x\nb x", "c x\nd x", "a x\nb x\nc x\nd x", "e\na x\nb x\nc x", "b x\nc x\nd x\ne"]
    got = {r.doc_id: (r.n_deleted, r.n_runs, r.longest_run) for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {0: (0, 0, 0), 1: (0, 0, 0), 2: (4, 2, 2), 3: (3, 1, 3), 4: (3, 1, 3)}


def test_line_runs_nothing(nothing):
    assert lines.dedup_lines(nothing).count() == 0


# -- suffix arrays


def brute_repeats(data):
    first = {}
    for i, t in data:
        b = (t or "").encode()
        for a in range(len(b) - 49):
            k = (i is not None, i or 0)
            first[b[a:a + 50]] = min(first.get(b[a:a + 50], k), k)
    out = Counter()
    for i, t in data:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for a in range(len(b) - 49):
            if first[b[a:a + 50]] < (i is not None, i or 0):
                mark[a:a + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        out[i, len(b), sum(mark), len([x for x in bytes(mark).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("which,batches", [("edges", 2), ("docs", 5), ("docs", 1)])
def test_repeats(request, which, batches):
    df = request.getfixturevalue(which)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df, batches).collect())
    assert got == brute_repeats(rows_of(df))


def test_repeats_of_long_and_same_numbered_texts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    piece = lambda n: "".join(rng.choice(list("ab \x00é"), n))
    shared = [piece(k) for k in (49, 50, 51, 75, 400)]
    rows = [(i, piece(30) + shared[i % 5] + piece(40) + shared[(i + 1) % 5][:60] + piece(20)) for i in range(24)] + [(3, shared[4]), (3, piece(80))]
    monkeypatch.setattr(suffix, "PIECE", 200)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df, 4).collect())
    assert got == brute_repeats(rows)


def test_repeats_nothing(nothing):
    assert suffix.remove_repeats(nothing).count() == 0


def test_equal_near_sides_do_not_make_surroundings_equal():
    """An anchor that 60,000 texts share with the 13 bytes on either side: each context beyond has surroundings of its own."""
    rng = np.random.default_rng(11)
    piece = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    core = next(x for x in iter(lambda: piece(50), None) if suffix.anchors([x])[1][0] == 13)
    text, pos, key, around, *more = suffix.anchors([piece(13) + core + piece(13) for _ in range(60_000)])
    shared = (pos == 26) & (key == suffix.anchors([core])[2][0])
    assert shared.sum() > 10_000
    assert len(np.unique(around[shared])) == shared.sum()


def test_scores_are_those_of_the_average():
    """The sums by word give what the shares of the buckets give; gradient descent separates two vocabularies."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma"] if i % 2 else ["delta", "epsilon", "zeta"], 30)) for i in range(60)] + ["", "alpha alpha", "é \x00 zeta"]
    model = classifier.train([(*classifier.features(t), i % 2) for i, t in enumerate(texts[:60])], 30, 30)
    sums = classifier._WordSums(model.weight)
    for i, t in enumerate(texts):
        at, share = classifier.features(t)
        assert abs(share.sum() - (1 if t else 0)) < 1e-9
        logit = model.bias + float(model.weight[at] @ share)
        assert abs(classifier.score(sums, model.bias, t) - 1 / (1 + np.exp(-logit))) < 1e-9
        assert i >= 60 or (logit > 0) == (i % 2 == 1)


def test_fit_takes_each_text_of_an_id_once(spark, monkeypatch):
    rows = [(1, f"good words {i % 3}") for i in range(300)] + [(i, f"bad text {i}") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i == 1), 0) for i in range(1, 60)], "doc_id bigint, quality int, toxic int")
    seen = []
    monkeypatch.setattr(classifier, "train", lambda found, *_: seen.append([q for *_, q in found]))
    assert (zlib.crc32(b"1") & 3) != 2
    classifier.fit(docs, labels, 20)
    assert seen[0].count(1) == 3 and 0 < seen[0].count(0) <= 20


def test_fit_holds_its_sample_packed(spark, monkeypatch):
    """The driver gets the sample in far fewer bytes than eight a bucket, and training sees the same numbers."""
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 1 << 40, 3000))) for _ in range(40)] + ["", None, "a a a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(texts))], "doc_id bigint, quality int, toxic int")
    used = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 != 2]
    want = {i: classifier.features(texts[i]) for i in used}
    seen = []

    def train(found, *_):
        seen.append(tracemalloc.get_traced_memory())
        seen.append([(*map(np.copy, x[:2]), x[2]) for x in found])

    monkeypatch.setattr(classifier, "train", train)
    tracemalloc.start()
    try:
        classifier.fit(docs, labels)
    finally:
        tracemalloc.stop()
    (held, peak), got = seen
    plain = 8 * sum(len(at) for at, _ in want.values())
    assert plain > 6_000_000 and held < plain / 2 and peak < plain
    assert len(got) == len(used)
    for i, (at, share, y) in zip(used, got, strict=True):
        assert y == i % 2 and np.array_equal(at, want[i][0]) and np.array_equal(share, want[i][1].astype("<f4"))


def test_shards_are_those_of_plain_hashes(spark):
    """Scores of every shard from the hashes themselves: the strings in turn seed one another."""
    def hashed(key, shard):
        h = 42
        for part in (b"rendezvous", *([] if key is None else [str(key).encode()]), shard.to_bytes(4, "little")):
            h = xxhash.xxh64_intdigest(part, h)
        return ((h >> 11) + 0.5) / (1 << 53)

    weights = [1.0, 2.0, 0.5, 1.0]
    keys = [None, *range(300)]
    got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_records(spark.createDataFrame([(k, "") for k in keys], "doc_id bigint, text string"), weights).collect()}
    for k in keys:
        score = [w / -np.log(hashed(k, i)) for i, w in enumerate([*weights, weights[-1]])]
        assert got[k] == (int(np.argmax(score[:4])), int(np.argmax(score)))


def test_frames_of_one_phrase_keep_their_own_bytes(spark):
    """51 shared bytes in frames that differ: only these go, with one batch and with several."""
    rows = [(1, "vrfgvccvtblyqlfodcajzxiosfpqbswozyczezynrvbkbjmwyahjxoxhdipnarmouogoerkqgxyc"), (2, "bjotamyklgqytlfodcajzxiosfpqbswozyczezynrvbkbjmwyahjxoxhdipnarmogkusiwnjejze")]
    for batches in (1, 2):
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), batches).collect())
        assert got == brute_repeats(rows) and {r[2] for r in got} == {0, 51}


def test_suffix_tasks_hold_little_at_once():
    """What a task of op10 holds at its peak, in bytes: of a text of 4 MB, and of a bucket of 400,000 suffixes of 36 bytes."""
    rng = np.random.default_rng(12)
    text = bytes(rng.integers(97, 123, 4 << 20, dtype=np.uint8))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0], pa.int32()), pa.array([text])], names=["doc", "variant", "text"])

    def peak(work):
        tracemalloc.start()
        n = work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return n, most

    n, most = peak(lambda: sum(b.num_rows for b in suffix._suffixes(4)(iter([batch]))))
    assert n == 4 and most < 80e6
    n = 100_000
    entries = [suffix._entries(0, k, rng.integers(0, 2**40, n, np.uint64), rng.integers(0, 2**64, n, np.uint64), rng.integers(0, 2**28, n, np.uint32),
                               np.arange(n), rng.integers(0, 10**6, n)) for k in ("new", "new", "merge", "stay")]
    frame = pd.DataFrame(entries, columns=["bucket", "kind", "keys", "around", "sides", "docs", "spots"])
    n, most = peak(lambda: len(suffix._scan(4, True)(frame)))
    assert n == 1 and most < 58e6
