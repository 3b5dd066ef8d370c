"""Closed forms, invariants and brute force of the library's own operators."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from arborix.functions import expr, ranks, tails
from arborix.functions.windows import numbered, rolling_mean
from arborix.operators import graph, joins, models, stats, tables, tour, tree
from arborix.sources import files
from arborix.sources.views import Views


def test_tails():
    assert math.isclose(tails.chi2(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(tails.f(4.964602743730711, 1, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(tails.t_two_sided(2.2281388519649385, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(tails.normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-9)


def test_index_values(spark):
    rows = spark.createDataFrame([(10, 0, 0, 10), (5, 5, 5, 5), (4, 0, 4, 0), (0, 0, 0, 0)], "a int, b int, c int, d int")
    si, ig = expr.segregation(*(F.col(x) for x in "abcd"))
    got = [(r["si"], r["ig"]) for r in rows.select(si.alias("si"), ig.alias("ig")).collect()]
    assert got == [(1.0, 1.0), (0.0, 0.0), (None, None), (None, None)]


def test_ids_stay_exact(spark):
    r = spark.createDataFrame([(603987390,), (0,)], "s bigint").select(expr.full_id(F.col("s")).alias("id")).collect()
    assert [x["id"] for x in r] == [720575940603987390, 7205759400]


def test_connections_add_up(spark, small):
    conn = Views(spark, small).conn
    assert conn.filter("AA + AD + DA + DD != sum_syn").count() == 0
    back = conn.filter("reciprocal = 1").select(F.col("pre").alias("post"), F.col("post").alias("pre"))
    assert conn.filter("reciprocal = 1").join(back, ["pre", "post"], "left_anti").count() == 0
    assert Views(spark, small).si.filter("si < -1e-9 or si > 1").count() == 0


def test_empty_contacts(spark):
    none = spark.createDataFrame([], "pre bigint, post bigint, pre_compartment string, post_compartment string")
    assert tables.segregation(none).count() == 0
    assert tables.type_counts(tables.with_type(none)).count() == 0


def test_numbered_and_rolling(spark):
    rows = spark.createDataFrame([(float(x),) for x in random.Random(1).sample(range(1000), 200)], "v double")
    n = numbered(rows, F.floor(F.col("v") / 100), [F.col("v")], "place")
    got = rolling_mean(n, "v", "place", 7, 32).orderBy("place").collect()
    v = sorted(r["v"] for r in got)
    assert [r["v"] for r in got] == v
    for i, r in enumerate(got):
        assert r["rolling"] is None if i < 6 else math.isclose(r["rolling"], sum(v[i - 6:i + 1]) / 7)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 130)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and all(got[i] == 100 for i in range(101, 130))


def random_tree(n, seed):
    r = random.Random(seed)
    return [(1, i, float(r.randrange(100)), float(r.randrange(100)), float(r.randrange(100)), -1 if i == 0 else r.randrange(i)) for i in range(n)]


SCHEMA = "neuron bigint, node_id bigint, x double, y double, z double, parent_id bigint"


def walked(rows):
    """All path lengths, walked edge by edge."""
    at = {r[1]: r for r in rows}
    near = {i: [] for i in at}
    for i, r in at.items():
        if r[5] != -1:
            d = math.dist(r[2:5], at[r[5]][2:5])
            near[i].append((r[5], d))
            near[r[5]].append((i, d))
    out = {}
    for s in at:
        seen, stack = {s: 0.0}, [s]
        while stack:
            a = stack.pop()
            for b, d in near[a]:
                if b not in seen:
                    seen[b] = seen[a] + d
                    stack.append(b)
        out |= {(s, t): d for t, d in seen.items()}
    return out


def test_path_lengths(spark):
    rows = random_tree(40, 3)
    t = spark.createDataFrame(rows, SCHEMA)
    nodes, jumps = tree.doubled(t)
    pairs = spark.createDataFrame([(1, a, b) for a in range(0, 40, 3) for b in range(40)], "neuron bigint, u bigint, v bigint")
    want = walked(rows)
    for r in tree.path_lengths(pairs, nodes, jumps).collect():
        assert math.isclose(r["path"], want[r["u"], r["v"]], abs_tol=1e-6)


def test_clusters_against_scan(spark):
    rows, r = random_tree(40, 5), random.Random(9)
    contacts = [(1, 1000 + i, r.randrange(40)) for i in range(50)]
    eps, d = 90.0, walked(rows)
    got = {x["contact"]: x["cluster"] for x in tree.clusters(spark.createDataFrame(contacts, "neuron bigint, contact bigint, node_id bigint").repartition(3), spark.createDataFrame(rows, SCHEMA), eps).collect()}
    near = {a: [b for _, b, n in contacts if d[m, n] <= eps] for _, a, m in contacts}
    label, k = {}, 0
    for _, a, _ in contacts:  # the usual scan in index order
        if a in label or len(near[a]) < 3:
            continue
        stack, label[a] = [a], k
        while stack:
            p = stack.pop()
            if len(near[p]) >= 3:
                for b in near[p]:
                    if b not in label:
                        label[b] = k
                        stack.append(b)
        k += 1
    assert got == label


def spanning(points, roots):
    """Edges of the least spanning tree over fragments, by Kruskal: (length, u, v) with u < v."""
    own, out = dict(roots), []
    for d, u, v in sorted((math.dist(points[u], points[v]), u, v) for u in points for v in points if u < v):
        if own[u] != own[v]:
            out.append((d, u, v))
            old, new = own[v], own[u]
            own = {k: new if g == old else g for k, g in own.items()}
    return out


@pytest.mark.parametrize("ring", [0.5, 7.0, 1000.0])
def test_heal_makes_one_tree(spark, ring):
    """Against the least spanning tree, from any first ring."""
    rng = np.random.default_rng(7)
    rows, want, roots_of = [], {}, {}
    for k, n in enumerate((1, 12, 40, 30)):
        ids = rng.permutation(100)[:n].tolist()
        t = parents("random", n, rng)
        t = {ids[a]: -1 if b < 0 or (k and rng.random() < 0.3) else ids[b] for a, b in t.items()}
        points = {a: rng.normal(0, 9, 3) * (40 if a % 11 == 0 else 1) for a in t}
        if k == 3:
            t[ids[5]] = 5555  # a lost parent makes a root
        root = {}
        for a in t:
            at = a
            while t[at] in t:
                at = t[at]
            root[a] = at
        rows += [(k, a, *map(float, points[a]), b) for a, b in t.items()]
        want[k], roots_of[k] = spanning(points, root), root
    rows += [(9, 1, 0.0, 0.0, 0.0, 2), (9, 2, 1.0, 0.0, 0.0, 1), (9, 3, 5.0, 0.0, 0.0, -1), (9, 4, 7.0, 0.0, 0.0, -1)]
    got = tree.heal(spark.createDataFrame(rows, SCHEMA).repartition(4), ring).collect()
    assert len(got) == len(rows)
    for k, edges in want.items():
        mine = [r for r in got if r["neuron"] == k]
        up = {r["node_id"]: r["parent_id"] for r in mine}
        assert {(min(a, b), max(a, b)) for a, b in up.items() if b in up} == {(min(a, b), max(a, b)) for _, a, _, _, _, b in (r[:6] for r in rows if r[0] == k) if b in up} | {(u, v) for _, u, v in edges}
        assert np.allclose(sorted(r["link"] for r in mine if r["link"] is not None), [d for d, _, _ in edges])
        (top,) = [a for a, b in up.items() if b not in up]
        sizes = {g: list(roots_of[k].values()).count(g) for g in roots_of[k].values()}
        assert top == min(sizes, key=lambda g: (-sizes[g], g))
        for a in up:  # every way ends at the root
            steps = 0
            while up[a] in up:
                a, steps = up[a], steps + 1
                assert steps < 200
            assert a == top
    # a cycle stays as it is beside what can be healed
    assert {(r["node_id"], r["parent_id"]) for r in got if r["neuron"] == 9} == {(1, 2), (2, 1), (3, -1), (4, 3)}


def test_split_of_a_plain_neuron(spark):
    # a chain 0 - 1 - 2 - 3 - 4: inputs on one side, outputs on the other
    rows = [(1, i, float(i), 0.0, 0.0, i - 1) for i in range(5)]
    con = [(1, 0, "post")] * 4 + [(1, 4, "pre")] * 4
    got = {r["node_id"]: r["part"] for r in tree.split(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(con, "neuron bigint, node_id bigint, type string")).collect()}
    assert got[0] == "dendrite" and got[2] == "linker"


def test_tied_ranks(spark):
    got = {r["v"]: r["tied_rank"] for r in stats.tied_ranks(spark.createDataFrame([(1,), (2,), (2,), (3,)], "v int"), "v").collect()}
    assert got == {1: 1.0, 2: 2.5, 3: 4.0}


def test_principal_components(spark):
    rows = spark.createDataFrame([(i, float(i), 2.0 * i + (i % 3), float(i % 5)) for i in range(60)], "k int, a double, b double, c double")
    share, load, z = models.components(rows, ["a", "b", "c"])
    assert 0.6 < share[0] < 0.8 and abs((load[:, 0] ** 2).sum() - 1) < 1e-9
    s = z.agg(F.avg("pc1").alias("m"), F.corr("pc1", "pc2").alias("r")).first()
    assert abs(s["m"]) < 1e-9 and abs(s["r"]) < 1e-9


def test_skeleton_files(spark, tmp_path):
    (tmp_path / "17.swc").write_text("# a comment\n0 1 1.0 2.0 3.0 0.5 -1\n1 0 2.0 2.0 3.0 0.5 0\n\n")
    got = [tuple(r) for r in files.read_skeletons(spark, f"file://{tmp_path}").orderBy("node_id").collect()]
    assert got == [(17, 0, 1, 1.0, 2.0, 3.0, 0.5, -1), (17, 1, 0, 2.0, 2.0, 3.0, 0.5, 0)]


def test_distance_samples_equally_many_of_each_type(spark, small):
    from arborix.plans.registry import QUERIES

    n = {}
    for r in QUERIES["t1_connectors"](spark, small).groupBy("neuron", "type").count().collect():
        n.setdefault(r.neuron, {})[r.type] = r["count"]
    want = {k: min(300, x["pre"], x["post"]) ** 2 for k, x in n.items() if len(x) == 2}
    assert max(want.values()) > 30 * 30
    assert {r.neuron: r.pairs for r in QUERIES["t11_pre_post_distance"](spark, small).collect()} == want


def test_base_nodes_against_walk(spark, small):
    """Every way is walked node by node, on the contacts that both stages keep."""
    from arborix.plans.registry import QUERIES
    from arborix.sources.views import Views

    up, degree, pre = {}, {}, set()
    for r in Views(spark, small).skeleton.select("neuron", "node_id", "parent_id").collect():
        up[r.neuron, r.node_id] = r.parent_id
        if r.parent_id != -1:
            for x in (r.node_id, r.parent_id):
                degree[r.neuron, x] = degree.get((r.neuron, x), 0) + 1
    for r in QUERIES["t1_connectors"](spark, small).collect():
        degree[r.neuron, r.node_id] = degree.get((r.neuron, r.node_id), 0) + 1
        if r.type == "pre":
            pre.add((r.neuron, r.node_id))

    def chain(neuron, x):
        out = [x]
        while up[neuron, out[-1]] != -1:
            out.append(up[neuron, out[-1]])
        return out
    left = {r.contact for r in QUERIES["t18_no_pre_below"](spark, small).collect()}
    want, stepped = {}, 0
    for r in QUERIES["t17_filopodia_first"](spark, small).collect():
        if r.contact not in left:
            continue
        a, b = chain(r.neuron, r.node_id), chain(r.neuron, r.centroid)
        top = next(x for x in a if x in b)
        way = a[: a.index(top) + 1] + b[: b.index(top)][::-1]
        at = next((max(0, i - 1) for i, x in enumerate(way) if (r.neuron, x) in pre), len(way) - 1)
        if degree[r.neuron, way[at]] > 2 and at:
            at, stepped = at - 1, stepped + 1
        want[r.contact] = way[at]
    assert want and stepped
    assert {r.contact: r.base for r in QUERIES["t19_base_nodes"](spark, small).collect()} == want


def test_tails_of_columns(spark):
    """The sums over the densities against the continued fractions."""

    rows = [(x, float(d1), float(d2)) for x in (0.0, 0.01, 0.7, 1.0, 2.5, 9.0, 60.0) for d1 in (1, 2, 4, 9) for d2 in (1, 5.5, 40, 600, 50000)]
    df = spark.createDataFrame(rows, "x double, d1 double, d2 double")
    c = F.col
    for r in df.select("*", tails.p_chi2(c("x"), c("d1")).alias("chi"), tails.p_f(c("x"), c("d1"), c("d2")).alias("f"), tails.p_t(c("x"), c("d2")).alias("t"), tails.p_z(c("x")).alias("z")).collect():
        want = (tails.chi2(r.x, r.d1), tails.f(r.x, r.d1, r.d2), tails.t_two_sided(r.x, r.d2), tails.normal_two_sided(r.x))
        assert all(abs(a - b) < 2e-7 for a, b in zip((r.chi, r.f, r.t, r.z), want, strict=True)), (r, want)


def test_tails_of_many_degrees(spark):
    """Where densities over- or underflow unless taken from their peaks."""

    rows = [(d1 * x, x, d1, d2) for d1 in (300.0, 350.0, 1000.0, 5000.0, 1e5) for d2 in (3.0, 800.0, 2000.0, 4e4, 1e5) for x in (0.9, 0.99, 1.0, 1.02, 1.05, 1.3)]
    c = F.col
    df = spark.createDataFrame(rows, "x double, f double, d1 double, d2 double")
    for r in df.select("*", tails.p_chi2(c("x"), c("d1")).alias("chi"), tails.p_f(c("f"), c("d1"), c("d2")).alias("pf")).collect():
        assert abs(r.chi - tails.chi2(r.x, r.d1)) < 5e-7 and abs(r.pf - tails.f(r.f, r.d1, r.d2)) < 5e-7, r
    known = [(400.0, 350.0, 0.034), (300.0, 300.0, 0.489)]
    got = spark.createDataFrame(known, "x double, d double, p double").select(tails.p_chi2(c("x"), c("d")).alias("got"), "p").collect()
    assert all(abs(r.got - r.p) < 1e-3 for r in got)
    none = spark.createDataFrame([(None, 3.0)], "x double, d double")
    assert none.select(tails.p_chi2(c("x"), c("d")), tails.p_f(c("x"), c("d"), c("d"))).first() == (None, None)


@pytest.mark.parametrize("rows", [[], [("a", 1.0)], [("a", 1.0), ("a", 1.0)], [("a", 1.0), ("b", 1.0)], [("a", 1.0)] * 3 + [("b", 1.0)] * 3, [("a", None), (None, 1.0)]])
def test_statistics_of_equal_or_few_values(spark, rows):
    """No error where variances, groups or tables are empty: the statistics are null."""

    df = spark.createDataFrame(rows, "g string, x double")
    m = stats.moments(df, "g", "x")
    for test in (stats.anova(m), stats.welch_anova(m), stats.kruskal(stats.rank_sums(df, "g", "x"))):
        assert [r[0] for r in test.collect()] == [None]
    low = F.lit(1.0)
    got = df.select(expr.bin_right(F.col("x"), low, F.lit(0.0), 5).alias("r"), expr.bin_left(F.col("x"), low, F.lit(0.0), 5).alias("l"), "x").collect()
    assert all((r.r, r.l) == ((0, 0) if r.x is not None else (None, None)) for r in got)


def parents(kind, n, rng):
    if kind == "chain":
        return {i: i - 1 if i else -1 for i in range(n)}
    if kind == "star":
        return {i: 0 if i else -1 for i in range(n)}
    return {i: int(rng.integers(0, i)) if i else -1 for i in range(n)}


@pytest.mark.parametrize("chunk,task", [(4096, 100_000), (8, 50), (3, 7)])
def test_tours(spark, monkeypatch, chunk, task):
    """Ranks, depths, distances and sums against plain walks, whatever the chunks; cycles and lost parents keep to their neuron."""
    monkeypatch.setattr(tour, "CHUNK", chunk)
    monkeypatch.setattr(tour, "TASK", task)
    rng = np.random.default_rng(chunk)
    forest = {k: parents(kind, n, rng) for k, (kind, n) in enumerate([("chain", 40), ("star", 30), ("random", 60), ("random", 25), ("random", 33), ("chain", 9), ("chain", 1)])}
    ids = {k: rng.permutation(500)[:len(t)].tolist() for k, t in forest.items()}  # parents may have larger ids
    forest = {k: {ids[k][a]: ids[k][b] if b >= 0 else -1 for a, b in t.items()} for k, t in forest.items()}
    forest[4][ids[4][3]] = 7000  # no such node
    forest[5][ids[5][2]] = ids[5][6]  # 2 hangs from 6, 6 is below 2
    rows = [(k, a, b, *map(float, rng.integers(0, 9, 3)), int(rng.integers(0, 5))) for k, t in forest.items() for a, b in t.items()]
    df = spark.createDataFrame(rows, "neuron bigint, node_id bigint, parent_id bigint, x double, y double, z double, w int").repartition(5)
    made = tour.ranked(df)
    spot = {(r[0], r[1]): r for r in rows}
    chains = {}
    for k, t in forest.items():
        for a in t:
            way, at = [a], a
            while t[at] in t and len(way) <= len(t):
                way.append(at := t[at])
            if len(way) <= len(t):
                chains[k, a] = way
    got = {(r.neuron, r.node_id): r for r in tour.measured(df, made, {"nodes": F.lit(1).cast("bigint"), "w": F.col("w").cast("bigint")}, lengths=True).collect()}
    assert set(got) == set(chains)
    away = lambda k, a, b: np.linalg.norm(np.subtract(spot[k, a][3:6], spot[k, b][3:6]))
    for (k, a), way in chains.items():
        r = got[k, a]
        under = [v for (q, v), w in chains.items() if q == k and a in w]
        assert (r.root, r.depth, r.nodes, r.w) == (way[-1], len(way) - 1, len(under), sum(spot[k, v][6] for v in under))
        assert abs(r.root_distance - sum(away(k, p, q) for p, q in zip(way, way[1:]))) < 1e-9
    some = [(k, a, b) for k, t in forest.items() for a in t for b in t if rng.random() < 0.2]
    for r in tour.below(spark.createDataFrame(some, "neuron bigint, u bigint, v bigint"), made, "u", "v", "has").collect():
        assert r.has == ((r.neuron, r.v) in chains and r.u in chains[r.neuron, r.v])
    starts = {k: max(a for q, a in chains if q == k) for k in forest if any(q == k for q, _ in chains)}
    ways = {(r.neuron, r.node_id): r.below for r in tour.way_up(made, spark.createDataFrame(list(starts.items()), "neuron bigint, node_id bigint")).collect()}
    assert ways == {(k, b): (chains[k, a][i - 1] if i else None) for k, a in starts.items() for i, b in enumerate(chains[k, a])}
    twice = df.unionByName(df.filter((F.col("neuron") == 3) & (F.col("node_id") == ids[3][5])))
    lost = sum(1 for a in forest[5] if (5, a) not in chains)
    assert {(r.neuron, r.issue, r.nodes) for r in tour.issues(twice, tour.ranked(twice)).collect()} == {(4, "missing parent", 1), (5, "cycle", lost), (3, "duplicate node", 1)}
    turned = {(r.neuron, r.node_id): r.parent_id for r in tree.reroot(df.select("neuron", "node_id", "parent_id"), spark.createDataFrame(list(starts.items()), "neuron bigint, node_id bigint")).collect()}
    for k, a in starts.items():
        way = chains[k, a]
        want = dict(forest[k]) | {a: -1} | {b: way[i] for i, b in enumerate(way[1:])}
        assert {q[1]: p for q, p in turned.items() if q[0] == k} == want


def test_tour_of_nothing(spark):
    df = spark.createDataFrame([], "neuron bigint, node_id bigint, parent_id bigint, x double, y double, z double")
    assert tour.ranked(df).count() == 0 and tour.issues(df, tour.ranked(df)).count() == 0


def test_running_sums_and_quantiles(spark):
    """Against plain sorting, with nulls, ties and null groups."""
    rng = np.random.default_rng(2)
    rows = [(["a", "b", None][int(rng.integers(0, 3))], None if rng.random() < 0.1 else float(rng.integers(0, 40)) / 4, i) for i in range(3000)] + [("hot", 1.0, i) for i in range(9000, 12000)] + [("none", None, 1), ("one", 2.5, 2)]
    df = spark.createDataFrame(rows, "g string, v double, i bigint").repartition(6)
    shares = [0.0, 0.025, 0.3, 0.5, 0.999, 1.0]
    got = {r["g"]: r for r in ranks.quantiles(df, ["g"], "v", shares).collect()}
    for g in {r[0] for r in rows}:
        v = [r[1] for r in rows if r[0] == g and r[1] is not None]
        want = np.quantile(v, shares) if v else [None] * len(shares)
        assert all((a is None and b is None) or abs(a - b) < 1e-12 for a, b in zip(got[g][1:], want, strict=True))
    (all_,) = ranks.quantiles(df, [], "v", shares).collect()
    assert np.allclose(all_, np.quantile([r[1] for r in rows if r[1] is not None], shares))
    assert ranks.quantiles(df.limit(0), ["g"], "v", shares).count() == 0
    for n in (1, 2, 37, 632):
        v = np.round(rng.normal(0, 100, n), 6)
        (q,) = ranks.quantiles(spark.createDataFrame([(float(x),) for x in v], "v double"), [], "v", shares).collect()
        assert np.allclose(q, np.quantile(v, shares))
    big = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    (q,) = ranks.quantiles(big, [], "v", [0.25, 0.7531]).collect()
    assert np.allclose(q, np.quantile((np.arange(200_000) * 7919 % 200_003).astype(float), [0.25, 0.7531]))
    got = {r["i"]: (r["before"], r["ahead"]) for r in ranks.running(df.filter("g = 'a'"), ["g"], ["v", "i"], {"before": F.lit(1), "ahead": F.coalesce("v", F.lit(0.0))}).collect()}
    mine = sorted((r for r in rows if r[0] == "a"), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    ahead = 0.0
    for k, r in enumerate(mine):
        assert got[r[2]][0] == k and abs(got[r[2]][1] - ahead) < 1e-6
        ahead += r[1] or 0.0
    got = {r["i"]: r["tied_rank"] for r in ranks.tied_ranks(df.filter("g IS NULL"), "v", ["g"]).collect()}
    mine = sorted(r[1] for r in rows if r[0] is None and r[1] is not None)
    for r in rows:
        if r[0] is None and r[1] is not None:
            assert got[r[2]] == mine.index(r[1]) + (mine.count(r[1]) + 1) / 2


def test_grid_pairs_and_gaps(spark):
    """Against all pairs; points on the edges of cells too."""
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 3)), i, int(rng.integers(0, 4)), *[float(x) for x in np.round(rng.normal(0, 6, 3) * 2) / 2]) for i in range(150)]
    df = spark.createDataFrame(rows, "g bigint, id bigint, c bigint, x double, y double, z double").repartition(3)
    b = df.select("g", F.col("id").alias("id2"), F.col("c").alias("c2"), *[F.col(k).alias(f"{k}2") for k in "xyz"])
    for radius, strict in ((1.0, False), (2.5, True), (40.0, False)):
        got = sorted((r["id"], r["id2"]) for r in joins.grid_pairs(df, b, "g", radius, list("xyz"), ["x2", "y2", "z2"], strict).collect())
        assert got == sorted((p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and (math.dist(p[3:], q[3:]) < radius if strict else math.dist(p[3:], q[3:]) <= radius))
    apart = joins.grid_pairs(df, b, "g", 2.0, list("xyz"), ["x2", "y2", "z2"], apart=("c", "c2")).count()
    assert apart == sum(1 for p in rows for q in rows if p[0] == q[0] and p[2] != q[2] and math.dist(p[3:], q[3:]) <= 2)
    for gap in (0.5, 3.0, 9.0):
        want = {}
        for p in rows:
            for q in rows:
                if p[0] == q[0] and p[2] < q[2]:
                    want[p[0], p[2], q[2]] = min(want.get((p[0], p[2], q[2]), 1e9), math.dist(p[3:], q[3:]))
        got = {(r["g"], r["c1"], r["c2"]): r["distance"] for r in joins.group_gaps(df, "g", "c", list("xyz"), gap).collect()}
        want = {k: d for k, d in want.items() if d < gap}
        assert set(got) == set(want) and all(abs(got[k] - d) < 1e-9 for k, d in want.items())


def test_exploded_and_packed_sides_are_not_broadcast(spark, monkeypatch):
    """Spark would broadcast either by its size before the explosion, or on disk."""
    from arborix.functions import lineage

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    points = spark.range(60).select((F.col("id") % 3).alias("g"), "id", *[(F.col("id") * 7 % 11 + 0.5).alias(f"l{i}") for i in range(3)])
    other = points.select("g", F.col("id").alias("other"), *[F.col(f"l{i}").alias(f"r{i}") for i in range(3)])
    pairs = joins.grid_pairs(points, other, "g", 2.0, ["l0", "l1", "l2"], ["r0", "r1", "r2"])
    assert "BroadcastHashJoin" not in plan(pairs)
    chains = spark.range(300).select((F.col("id") % 3).alias("neuron"), (F.floor(F.col("id") / 3) + 1).alias("node_id"), *[F.col("id").cast("double").alias(a) for a in "xyz"])
    chains = chains.withColumn("parent_id", F.when(F.col("node_id") == 1, -1).otherwise(F.col("node_id") - 1))
    monkeypatch.setattr(lineage, "FEW", 100)
    nodes, jumps = tree.doubled(chains)
    ends = chains.select("neuron", F.col("node_id").alias("u"), (F.lit(101) - F.col("node_id")).alias("v"))
    far = tree.path_lengths(ends, nodes, jumps)
    assert "BroadcastHashJoin" not in plan(far) and far.count() == 300
    step = 3 * 3 ** 0.5
    assert all(math.isclose(r["path"], abs(r["u"] - r["v"]) * step, abs_tol=1e-6) for r in far.collect())


def test_draws_with_replacement(spark):
    rows = [("a", i) for i in range(10)] + [("b", i) for i in range(500)] + [(None, 1)]
    got = models.balanced(spark.createDataFrame(rows, "g string, i bigint").repartition(3), "g", 40, ["i"]).collect()
    for g, n in (("a", 10), ("b", 500)):
        draws = {r["i"]: r["draws"] for r in got if r["g"] == g}
        assert sum(draws.values()) == 40
        assert draws == Counter(int(hashlib.md5(f"42:{g}:{k}".encode()).hexdigest()[:15], 16) % n for k in range(40))
    assert max(r["draws"] for r in got) > 1 and {r["g"] for r in got} == {"a", "b"}


def test_least_squares_by_class(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(1000, 3, (80, 2))
    y = x @ [2.0, -1.0] + np.where(np.arange(80) % 2, 5, 9) + rng.normal(0, 0.1, 80)
    df = spark.createDataFrame([("ab"[i % 2], *map(float, (*x[i], y[i]))) for i in range(80)], "g string, a double, b double, y double")
    for r in models.least_squares(df, ["a", "b"], "y", "g").collect():
        m = np.arange(80) % 2 == "ab".index(r["g"])
        want = np.linalg.lstsq(np.column_stack([x[m], np.ones(m.sum())]), y[m], rcond=None)[0]
        assert np.allclose([*r["weights"], r["constant"]], want, atol=1e-6)
    assert len(models.least_squares(df, ["a", "b"], "y").collect()) == 1 and models.least_squares(df.limit(0), ["a"], "y", "g").collect() == []
