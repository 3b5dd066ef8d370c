"""Rooted trees (neuron, node_id, x, y, z, parent_id; a root's parent is -1), for all neurons at once.

Subtrees and ways to the root come from tours (``tour``).  Ways between nodes take jump tables: after round k each node knows its ancestor 2^k
up, so a chain of thousands of nodes takes a dozen rounds.  Each round is a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborix.functions.lineage import by_count, stored
from arborix.operators import joins, tour
from arborix.operators.graph import components

c, lit = F.col, F.lit
KEY = ["neuron", "node_id"]


def edge_lengths(tree: DataFrame) -> DataFrame:
    """Adds ``length``: the distance to the parent, 0 at a root."""
    up = tree.select("neuron", c("node_id").alias("parent_id"), *[c(a).alias(f"p{a}") for a in "xyz"])
    d = F.sqrt(sum(((c(a) - c(f"p{a}")) * (c(a) - c(f"p{a}")) for a in "xyz"), lit(0.0)))
    return tree.join(up, ["neuron", "parent_id"], "left").withColumn("length", F.coalesce(d, lit(0.0))).drop("px", "py", "pz")


def doubled(tree: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(nodes with depth, root, root_distance; jump tables: the k-th has anc, the ancestor 2^k up, and up, the way to it).  Nodes on or under a
    cycle of parents are left out."""
    t = edge_lengths(tree)
    base = stored(t.select(*KEY, F.when(c("parent_id") != -1, c("parent_id")).alias("anc"), c("length").alias("up")), "tree")
    most, rows = (x or 0 for x in base.groupBy("neuron").count().agg(F.max("count"), F.sum("count")).first())
    base = by_count(base, rows)
    jumps = []
    now = base.select(*KEY, "anc", "up", F.when(c("anc").isNotNull(), 1).otherwise(0).cast("bigint").alias("depth"), F.coalesce("anc", "node_id").alias("root"))
    for _ in range(most.bit_length() + 1):  # a way that is longer goes round
        jumps.append(now.filter(c("anc").isNotNull()).select(*KEY, "anc", "up"))
        far = now.select("neuron", c("node_id").alias("anc"), c("anc").alias("__anc"), c("up").alias("__up"), c("depth").alias("__depth"), c("root").alias("__root"))
        now = stored(now.join(far, ["neuron", "anc"], "left").select(
            *KEY, c("__anc").alias("anc"), (c("up") + F.coalesce("__up", lit(0.0))).alias("up"), (c("depth") + F.coalesce("__depth", lit(0))).alias("depth"), F.coalesce("__root", "root").alias("root")), "tree-jumps")
        now = by_count(now, rows)
        if not now.filter(c("anc").isNotNull()).take(1):
            break
    return now.filter(c("anc").isNull()).select(*KEY, "depth", "root", c("up").alias("root_distance")), jumps


def path_lengths(pairs: DataFrame, nodes: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """Adds ``path``: the way along the tree between nodes u and v of a neuron, null across fragments.

    Both are lifted to one depth, then together as far as their ancestors differ."""
    distinct = pairs.select("neuron", "u", "v").distinct()
    for e in "uv":
        side = nodes.select("neuron", c("node_id").alias(e), c("depth").alias(f"d{e}"), c("root_distance").alias(f"r{e}"), c("root").alias(f"o{e}"))
        distinct = distinct.join(side, ["neuron", e])
    now = distinct.filter(c("ou") == c("ov")).withColumns({"a": c("u"), "b": c("v"), "da": c("du"), "db": c("dv")}).drop("ou", "ov")

    def lift(rows: DataFrame, e: str, jump: DataFrame) -> DataFrame:
        return rows.join(jump.select("neuron", c("node_id").alias(e), c("anc").alias(f"n{e}")), ["neuron", e], "left")
    for k in reversed(range(len(jumps))):
        for e, other in (("a", "b"), ("b", "a")):
            go = c(f"d{e}") - c(f"d{other}") >= (1 << k)
            now = lift(now, e, jumps[k]).withColumn(e, F.when(go, c(f"n{e}")).otherwise(c(e))).withColumn(f"d{e}", F.when(go, c(f"d{e}") - (1 << k)).otherwise(c(f"d{e}"))).drop(f"n{e}")
    now = by_count(stored(now, "tree-pairs"))
    for k in reversed(range(len(jumps))):
        now = lift(lift(now, "a", jumps[k]), "b", jumps[k])
        go = c("na").isNotNull() & (c("na") != c("nb"))
        now = now.withColumn("a", F.when(go, c("na")).otherwise(c("a"))).withColumn("b", F.when(go, c("nb")).otherwise(c("b"))).drop("na", "nb")
    top = lift(now, "a", jumps[0]).withColumn("lca", F.when(c("a") == c("b"), c("a")).otherwise(c("na")))
    top = top.join(nodes.select("neuron", c("node_id").alias("lca"), c("root_distance").alias("rl")), ["neuron", "lca"])
    out = top.select("neuron", "u", "v", "lca", F.greatest(c("ru") + c("rv") - 2 * c("rl"), lit(0.0)).alias("path"))
    return pairs.join(out, ["neuron", "u", "v"], "left")


def reroot(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """The tree of each neuron hung from the node given in roots (neuron, node_id): parent links on the way from there to
    the old root turn round.  Neurons without a new root stay."""
    turned = tour.way_up(tour.ranked(tree), roots).select(*KEY, F.coalesce("below", lit(-1)).alias("__new"))
    return tree.join(turned, KEY, "left").withColumn("parent_id", F.coalesce("__new", "parent_id")).drop("__new")


def heal(tree: DataFrame, ring: float, growth: float = 4.0) -> DataFrame:
    """Trees in fragments as one tree a neuron, by shortest edges: the columns of tree, with parent_id as it is then, and link, the length of an edge that was
    added (null: none).

    Boruvka's rounds: each group of fragments takes its shortest edge to another (ties: the lesser nodes), but for a neuron's largest group, which waits to
    be met.  Edges are looked for within a ring; the groups that find none look within a wider one, until all have met.  A node
    whose parent is missing is a root; nodes on or under a cycle of parents stay as they are.  The root is that of the fragment with most
    nodes (ties: the lowest)."""
    walk = tour.ranked(tree.select(*KEY, "parent_id"))
    sizes = walk.groupBy("neuron", "root").agg(F.count(lit(1)).alias("n"))
    main = sizes.groupBy("neuron").agg(F.max(F.struct("n", (-c("root")).alias("root"))).alias("m"), F.count(lit(1)).alias("k")).filter("k > 1")
    main = stored(main.select("neuron", (-c("m.root")).alias("root")), "heal-main")
    at = walk.join(main.select("neuron"), "neuron", "left_semi").select(*KEY, c("root").alias("f")).join(tree.select(*KEY, *"xyz"), KEY)
    at = by_count(stored(at, "heal-nodes"))
    label = stored(at.groupBy("neuron", "f").agg(F.count(lit(1)).alias("n")).withColumn("g", c("f")), "heal-label")
    edges = None
    while True:
        groups = label.groupBy("neuron", "g").agg(F.sum("n").alias("n"))
        largest = groups.groupBy("neuron").agg(F.max(F.struct("n", "g")).alias("m"), F.count(lit(1)).alias("k")).filter("k > 1").select("neuron", c("m.g").alias("largest"))
        left = stored(label.join(largest, "neuron").select("neuron", "f", "g", (c("g") == c("largest")).alias("waits")), "heal-left")
        if not left.take(1):
            break
        points = at.join(left, ["neuron", "f"])
        u = points.filter(~c("waits")).select("neuron", c("node_id").alias("u"), c("g").alias("gu"), c("f").alias("fu"), *[c(x).alias(f"u{x}") for x in "xyz"])
        v = points.select("neuron", c("node_id").alias("v"), c("g").alias("gv"), c("f").alias("fv"), *[c(x).alias(f"v{x}") for x in "xyz"])
        near = joins.grid_pairs(u, v, "neuron", ring, ["ux", "uy", "uz"], ["vx", "vy", "vz"], apart=("gu", "gv"))
        end = lambda x, y: F.when(c("u") < c("v"), c(x)).otherwise(c(y))
        edge = F.struct("distance", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), end("fu", "fv").alias("fu"), end("fv", "fu").alias("fv"))
        # the shortest edge from each fragment to each other group serves all rounds within the ring
        near = stored(near.groupBy("neuron", "fu", "fv").agg(F.min(edge).alias("e")).select("neuron", "e.*"), "heal-near")
        while True:
            pair = near
            for e in "uv":
                pair = pair.join(label.select("neuron", c("f").alias(f"f{e}"), c("g").alias(f"g{e}")), ["neuron", f"f{e}"])
            pair = pair.filter(c("gu") != c("gv")).withColumn("e", F.struct("distance", "u", "v", "fu", "fv", "gu", "gv"))
            best = pair.select("neuron", "e", F.explode(F.array("gu", "gv")).alias("g")).groupBy("neuron", "g").agg(F.min("e").alias("e"))
            best = stored(best.select("neuron", "e.*").distinct(), "heal-best")
            if not best.take(1):
                break
            edges = best.select("neuron", "u", "v", "fu", "fv", "distance") if edges is None else edges.unionByName(best.select("neuron", "u", "v", "fu", "fv", "distance"))
            key = lambda x: F.struct(c("neuron"), c(x).alias("f"))
            comp = components(best.select(key("gu").alias("a"), key("gv").alias("b")))
            comp = comp.select(c("node.neuron").alias("neuron"), c("node.f").alias("g"), c("root.f").alias("__g"))
            label = stored(label.join(comp, ["neuron", "g"], "left").select("neuron", "f", "n", F.coalesce("__g", "g").alias("g")), "heal-label")
        ring *= growth
    if edges is None:
        return tree.withColumn("link", lit(None).cast("double"))
    hung = tour.directed(edges.withColumnsRenamed({"fu": "a", "fv": "b"}), main)
    # each fragment but the main one turns to hang from the edge that comes to it
    is_b = c("child") == c("fragment_v")
    hung = hung.join(edges.select("neuron", "u", "v", c("fv").alias("fragment_v")), ["neuron", "u", "v"])
    hung = stored(hung.select("neuron", F.when(is_b, c("v")).otherwise(c("u")).alias("node_id"), F.when(is_b, c("u")).otherwise(c("v")).alias("__to"), c("distance").alias("link")), "heal-hung")
    turned = tour.way_up(walk, hung).join(hung, KEY, "left").select(*KEY, F.coalesce("below", "__to").alias("__new"), "link")
    return tree.join(turned, KEY, "left").withColumn("parent_id", F.coalesce("__new", "parent_id")).drop("__new")


def split(tree: DataFrame, contacts: DataFrame, share: float = 1.0) -> DataFrame:
    """Synapse flow centrality: per node flow, part (linker, axon, dendrite) and fragment.

    contacts: neuron, node_id, type (pre, post).  With p, q the pre and post contacts at and below a node and P, Q the neuron's, flow is
    p(Q-q) + q(P-p); linkers have at least ``share`` of the neuron's greatest flow.  What remains falls into
    fragments; one is axon where its share of the pre contacts exceeds that of the post contacts, else dendrite."""
    on = contacts.groupBy(*KEY).agg(F.count_if(c("type") == "pre").alias("p"), F.count_if(c("type") == "post").alias("q"))
    t = tree.join(on, KEY, "left").fillna(0, ["p", "q"])
    t = t.withColumns({"own_p": c("p"), "own_q": c("q")})
    nodes = tour.measured(t, tour.ranked(tree), {"p": c("p"), "q": c("q")})
    per = t.groupBy("neuron").agg(F.sum("own_p").alias("all_p"), F.sum("own_q").alias("all_q"))
    flow = nodes.join(per, "neuron").withColumn("flow", c("p") * (c("all_q") - c("q")) + c("q") * (c("all_p") - c("p")))
    most = flow.groupBy("neuron").agg(F.max("flow").alias("most"))
    flow = by_count(stored(flow.join(most, "neuron").withColumn("linker", (c("flow") >= share * c("most")) & (c("most") > 0)), "split-flow"))
    # fragments: cut the tree at linkers on either end of an edge
    links = flow.select(*KEY, "linker")
    cut = tree.join(links, KEY).join(links.select("neuron", c("node_id").alias("parent_id"), c("linker").alias("__up")), ["neuron", "parent_id"], "left")
    cut = cut.withColumn("parent_id", F.when(c("linker") | F.coalesce("__up", lit(False)), -1).otherwise(c("parent_id")))
    frag = tour.ranked(cut.select(*tree.columns))
    own = t.select(*KEY, "own_p", "own_q").join(frag.select(*KEY, c("root").alias("fragment")), KEY)
    side = own.groupBy("neuron", "fragment").agg(F.sum("own_p").alias("fp"), F.sum("own_q").alias("fq")).join(per, "neuron")
    side = side.withColumn("axon", c("fp") * c("all_q") > c("fq") * c("all_p")).select("neuron", "fragment", "axon")
    out = flow.join(frag.select(*KEY, c("root").alias("fragment")), KEY).join(side, ["neuron", "fragment"])
    return out.select(*KEY, "flow", F.when(c("linker"), "linker").when(c("axon"), "axon").otherwise("dendrite").alias("part"), "fragment")


def clusters(contacts: DataFrame, tree: DataFrame, eps: float, least: int = 3, fewest: int = 5) -> DataFrame:
    """Density clusters of contacts (neuron, contact, node_id) along the tree: neuron, contact, cluster (0, 1, ... per neuron).

    Two contacts are neighbours within ``eps`` along the tree, itself included; those with ``least`` neighbours are cores, cores that neighbour
    each other share a cluster, others join the lowest core they neighbour or are noise, which is left out.
    Straight distance never exceeds the way along the tree, so a grid join finds all candidates, between nodes rather than contacts."""
    several = contacts.groupBy("neuron").count().filter(c("count") >= fewest).select("neuron")
    contacts = by_count(stored(contacts.join(several, "neuron", "left_semi").select("neuron", "contact", "node_id"), "cluster-contacts"))
    nodes, jumps = doubled(tree)
    used = tree.join(contacts.select(*KEY).distinct(), KEY)
    u = used.select("neuron", c("node_id").alias("u"), *[c(a).alias(f"u{a}") for a in "xyz"])
    v = used.select("neuron", c("node_id").alias("v"), *[c(a).alias(f"v{a}") for a in "xyz"])
    near = joins.grid_pairs(u, v, "neuron", eps, ["ux", "uy", "uz"], ["vx", "vy", "vz"]).select("neuron", "u", "v")
    near = by_count(stored(path_lengths(near, nodes, jumps).filter(c("path") <= eps).select("neuron", "u", "v"), "cluster-near"))
    # contacts of one node have the same neighbours, so nodes carry the counts
    weight = contacts.groupBy(*KEY).agg(F.count(lit(1)).alias("n"), F.min("contact").alias("first"))
    size = near.join(weight.select("neuron", c("node_id").alias("v"), "n"), ["neuron", "v"]).groupBy("neuron", c("u").alias("node_id")).agg(F.sum("n").alias("near"))
    core = stored(size.filter(c("near") >= least).join(weight, KEY).select(*KEY, "first"), "cluster-cores")
    key = lambda e: F.struct(c("neuron"), c(e).alias("f"))
    ends = core.select("neuron", c("node_id").alias("u"), c("first").alias("fu")).join(near, ["neuron", "u"]).join(core.select("neuron", c("node_id").alias("v"), c("first").alias("fv")), ["neuron", "v"])
    comp = components(ends.select(key("fu").alias("a"), key("fv").alias("b")))
    comp = comp.select(c("node.neuron").alias("neuron"), c("node.f").alias("first"), c("root.f").alias("label"))
    core = stored(core.join(comp, ["neuron", "first"], "left").select(*KEY, F.coalesce("label", "first").alias("label")), "cluster-labels")
    border = near.join(core.select("neuron", c("node_id").alias("v"), "label"), ["neuron", "v"]).groupBy("neuron", c("u").alias("node_id")).agg(F.min("label").alias("border"))
    got = border.join(core, KEY, "left").select(*KEY, F.coalesce("label", "border").alias("label"))
    return dense(contacts.join(got, KEY), "label", "cluster").select("neuron", "contact", "node_id", "cluster")


def dense(rows: DataFrame, label: str, out: str) -> DataFrame:
    """Labels of a neuron renumbered 0, 1, ... in their order, over the distinct labels."""
    from pyspark.sql import Window

    ids = rows.select("neuron", label).distinct().withColumn(out, (F.row_number().over(Window.partitionBy("neuron").orderBy(label)) - 1).cast("bigint"))
    return rows.drop(out).join(ids, ["neuron", label]) if label != out else rows.withColumnRenamed(label, "__l").join(ids.select("neuron", c(label).alias("__l"), c(out)), ["neuron", "__l"]).drop("__l")


def merge_clusters(found: DataFrame, gap: float) -> DataFrame:
    """Clusters (neuron, contact, cluster, x, y, z) of which any two contacts are nearer than ``gap`` become one; renumbered."""
    near = joins.group_gaps(found, "neuron", "cluster", list("xyz"), gap)
    key = lambda e: F.struct(c("neuron"), c(e).alias("f"))
    comp = components(near.select(key("c1").alias("a"), key("c2").alias("b")).distinct())
    comp = comp.select(c("node.neuron").alias("neuron"), c("node.f").alias("cluster"), c("root.f").alias("__to"))
    out = found.join(comp, ["neuron", "cluster"], "left").withColumn("__to", F.coalesce("__to", "cluster")).drop("cluster")
    return dense(out, "__to", "cluster").drop("__to")
