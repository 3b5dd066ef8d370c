"""Queries of the tree operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborix.functions.lineage import by_count, stored
from arborix.operators import joins, tables, tour, tree
from arborix.operators.models import drawn
from arborix.plans.basic import ORDERED_IDS, identified
from arborix.plans.registry import query

c, lit = F.col, F.lit


def n_():
    return F.count(lit(1))


r6 = lambda x: F.round(x, 6)
RADII = [20000.0, 80000.0]
EPS = 60000.0


def once(f):
    """Keeps what f makes of a Views, written out, so that a query that needs it again reads it."""
    def run(v):
        made = v.__dict__.setdefault("_made", {})
        if f.__name__ not in made:
            made[f.__name__] = by_count(stored(f(v), f.__name__))
        return made[f.__name__]
    return run


@once
def attached(v):
    """Both ends of each contact with its nearest node: neuron, contact, type, partner, compartment, node_id."""
    ids = identified(v)
    end = lambda a, b, k: F.struct((c("synapse_id") * 2 + k).alias("contact"), c(a).alias("neuron"), c(b).alias("partner"), lit(a).alias("type"),
                                   c(f"{a}_compartment").alias("compartment"), *[c(f"{a}_{x}").alias(f"c{x}") for x in "xyz"])
    ends = ids.select(F.explode(F.array(end("pre", "post", 0), end("post", "pre", 1))).alias("e")).select("e.*")
    near = joins.nearest(ends.select("neuron", "contact", "cx", "cy", "cz"), v.skeleton, "neuron", "contact", "node_id", ["cx", "cy", "cz"], ["x", "y", "z"], RADII)
    return ends.join(near, ["neuron", "contact"])


CONNECT = f"""{ORDERED_IDS}, ends AS (SELECT synapse_id*2 AS contact, pre AS neuron, post AS partner, 'pre' AS type, pre_compartment AS compartment, pre_x AS cx, pre_y AS cy, pre_z AS cz FROM ids UNION ALL SELECT synapse_id*2+1, post, pre, 'post', post_compartment, post_x, post_y, post_z FROM ids),
cd AS (SELECT e.*, s.node_id, sqrt((cx-x)*(cx-x)+(cy-y)*(cy-y)+(cz-z)*(cz-z)) AS d FROM ends e JOIN skeleton s ON s.neuron=e.neuron),
con AS (SELECT neuron, contact, any_value(partner) AS partner, any_value(type) AS type, any_value(compartment) AS compartment, any_value(cx) AS cx, arg_min(node_id, (d, node_id)) AS node_id FROM cd WHERE d <= 80000 GROUP BY neuron, contact)"""


@query("t1_connectors", f"{CONNECT} SELECT neuron, contact, type, partner, compartment, node_id FROM con")
def t1(v):
    return attached(v).select("neuron", "contact", "type", "partner", "compartment", "node_id")


def fragments(v):
    """The skeletons with every fifth node cut from its parent."""
    return v.skeleton.withColumn("parent_id", F.when((c("node_id") % 5 == 0), -1).otherwise(c("parent_id")))


#: Kruskal's rule: an edge belongs to the least spanning tree if no shorter ones join its ends already.
HEALED = """up2 AS (SELECT a.neuron, a.node_id, a.node_id >> k AS anc FROM skeleton a, (SELECT unnest(range(0,40)) AS k) WHERE (a.node_id >> k) >= 1),
fr AS (SELECT neuron, node_id, max(anc) AS f FROM up2 WHERE anc % 5 = 0 OR anc = 1 GROUP BY ALL), pt AS (SELECT fr.*, x, y, z FROM fr JOIN skeleton s ON s.neuron=fr.neuron AND s.node_id=fr.node_id),
pe AS (SELECT a.neuron, least(a.f,b.f) AS fa, greatest(a.f,b.f) AS fb, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d, a.node_id AS u, b.node_id AS v FROM pt a JOIN pt b ON a.neuron=b.neuron AND a.node_id<b.node_id AND a.f<>b.f),
me AS (SELECT neuron, fa, fb, min((d,u,v)) AS e FROM pe GROUP BY ALL), ed AS (SELECT neuron, fa, fb, e[1] AS d, e[2] AS u, e[3] AS v, row_number() OVER (PARTITION BY neuron ORDER BY e) AS k FROM me),
rc AS (SELECT neuron, k, fa AS f FROM ed UNION SELECT rc.neuron, rc.k, CASE WHEN s.fa=rc.f THEN s.fb ELSE s.fa END FROM rc JOIN ed s ON s.neuron=rc.neuron AND s.k<rc.k AND (s.fa=rc.f OR s.fb=rc.f)),
mst AS (SELECT neuron, u, v, d FROM ed WHERE (neuron, k, fb) NOT IN (FROM rc)),
nx AS (SELECT neuron, node_id AS a, node_id//2 AS b, NULL::DOUBLE AS d FROM skeleton WHERE node_id > 1 AND node_id % 5 <> 0 UNION ALL SELECT * FROM mst), ends AS (SELECT neuron, a, b, d FROM nx UNION ALL SELECT neuron, b, a, d FROM nx),
rt AS (SELECT neuron, arg_min(f, (-n, f)) AS root FROM (SELECT neuron, f, count(*) AS n FROM fr GROUP BY ALL) GROUP BY neuron),
og AS (SELECT neuron, root AS node_id, -1::BIGINT AS parent_id, NULL::DOUBLE AS link FROM rt UNION SELECT og.neuron, b, a, d FROM og JOIN ends ON ends.neuron=og.neuron AND ends.a=og.node_id AND ends.b<>og.parent_id)
SELECT neuron, node_id, parent_id, round(link,6) AS link FROM og"""


@query("t2_heal", HEALED)
def t2(v):
    """The fragments as one tree a neuron."""
    return tree.heal(fragments(v), 16000.0).select("neuron", "node_id", "parent_id", r6(c("link")).alias("link"))


@query("t3_reroot", """m AS (SELECT neuron, max(node_id) AS r FROM skeleton GROUP BY neuron) SELECT s.neuron, s.node_id, CASE WHEN s.node_id = r THEN -1 WHEN w.below IS NOT NULL THEN w.below ELSE s.parent_id END AS parent_id
 FROM skeleton s JOIN m ON m.neuron=s.neuron LEFT JOIN (SELECT m.neuron, (r >> (k+1)) AS node_id, (r >> k) AS below FROM m, (SELECT unnest(range(0,40)) AS k) WHERE (r >> (k+1)) >= 1) w ON w.neuron=s.neuron AND w.node_id=s.node_id""")
def t3(v):
    roots = v.skeleton.groupBy("neuron").agg(F.max("node_id").alias("node_id"))
    return tree.reroot(v.skeleton.select("neuron", "node_id", "parent_id"), roots)


UPWARD = """up AS (SELECT a.neuron, a.node_id, a.node_id >> k AS anc FROM skeleton a, (SELECT unnest(range(0,40)) AS k) WHERE (a.node_id >> k) >= 1)"""


#: Contacts by node, pre and post; sums over the nodes below; ways to the root, and between nodes of a heap by their common shift.
TOTALS = """on_node AS (SELECT neuron, node_id, count(*) FILTER (type='pre') AS p, count(*) FILTER (type='post') AS q FROM con GROUP BY ALL),
tot AS (SELECT u.neuron, u.anc AS node_id, coalesce(sum(p),0)::BIGINT AS p, coalesce(sum(q),0)::BIGINT AS q FROM up u LEFT JOIN on_node o ON o.neuron=u.neuron AND o.node_id=u.node_id GROUP BY ALL)"""
WAYS = """len AS (SELECT a.neuron, a.node_id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS l FROM skeleton a JOIN skeleton b ON a.neuron=b.neuron AND a.parent_id=b.node_id),
far AS (SELECT u.neuron, u.node_id, coalesce(sum(l),0) AS far, floor(log2(u.node_id))::INT AS depth FROM up u LEFT JOIN len ON len.neuron=u.neuron AND len.node_id=u.anc GROUP BY ALL)"""


def ways(pairs, keys):
    """SQL of the ways of pairs (neuron, u, v, w, and keys)."""
    return f"""lifted AS (SELECT x.*, a.far AS fu, b.far AS fv, x.u >> greatest(a.depth-b.depth,0) AS lu, x.v >> greatest(b.depth-a.depth,0) AS lv FROM {pairs} x JOIN far a ON a.neuron=x.neuron AND a.node_id=x.u JOIN far b ON b.neuron=x.neuron AND b.node_id=x.v),
met AS (SELECT *, CASE WHEN lu=lv THEN lu ELSE lu >> (floor(log2(xor(lu,lv)))::INT + 1) END AS lca FROM lifted),
way AS (SELECT {keys}, w, fu + fv - 2*f.far AS path FROM met JOIN far f ON f.neuron=met.neuron AND f.node_id=met.lca)"""


SPLIT = f"""{CONNECT}, {UPWARD}, {TOTALS}, per AS (SELECT neuron, p AS all_p, q AS all_q FROM tot WHERE node_id=1),
flow AS (SELECT t.neuron, t.node_id, p*(all_q-q)+q*(all_p-p) AS flow FROM tot t JOIN per ON per.neuron=t.neuron), cut AS (SELECT *, flow >= max(flow) OVER (PARTITION BY neuron) AND max(flow) OVER (PARTITION BY neuron) > 0 AS linker FROM flow),
tops AS (SELECT c.neuron, c.node_id FROM cut c LEFT JOIN cut u ON u.neuron=c.neuron AND u.node_id=c.node_id//2 WHERE c.linker OR u.linker OR c.node_id=1),
frag AS (SELECT u.neuron, u.node_id, max(anc) AS fragment FROM up u JOIN tops t ON t.neuron=u.neuron AND t.node_id=u.anc GROUP BY ALL),
side AS (SELECT f.neuron, fragment, coalesce(sum(p),0)*any_value(all_q) > coalesce(sum(q),0)*any_value(all_p) AS axon FROM frag f JOIN per ON per.neuron=f.neuron LEFT JOIN on_node o ON o.neuron=f.neuron AND o.node_id=f.node_id GROUP BY ALL),
parts AS (SELECT c.neuron, c.node_id, flow::BIGINT AS flow, CASE WHEN linker THEN 'linker' WHEN axon THEN 'axon' ELSE 'dendrite' END AS part, f.fragment FROM cut c JOIN frag f ON f.neuron=c.neuron AND f.node_id=c.node_id JOIN side s ON s.neuron=c.neuron AND s.fragment=f.fragment)"""


@query("t4_subtree_totals", f"{CONNECT}, {UPWARD}, s AS (SELECT u.neuron, u.anc AS node_id, count(*) FILTER (type='pre') AS distal_pre, count(*) FILTER (type='post') AS distal_post FROM con c JOIN up u ON u.neuron=c.neuron AND u.node_id=c.node_id GROUP BY ALL), z AS (SELECT neuron, anc AS node_id, count(*) AS nodes FROM up GROUP BY ALL) SELECT z.neuron, z.node_id, nodes, coalesce(distal_pre,0) AS distal_pre, coalesce(distal_post,0) AS distal_post FROM z LEFT JOIN s ON s.neuron=z.neuron AND s.node_id=z.node_id")
def t4(v):
    on = attached(v).groupBy("neuron", "node_id").agg(F.count_if(c("type") == "pre").alias("p"), F.count_if(c("type") == "post").alias("q"))
    t = v.skeleton.join(on, ["neuron", "node_id"], "left").fillna(0, ["p", "q"])
    nodes = tour.measured(t, tour.ranked(v.skeleton), {"nodes": lit(1).cast("bigint"), "distal_pre": c("p"), "distal_post": c("q")})
    return nodes.select("neuron", "node_id", "nodes", "distal_pre", "distal_post")


def parts(v):
    return tree.split(v.skeleton, attached(v).select("neuron", "node_id", "type"))


@query("t5_flow_split", f"{SPLIT} SELECT * FROM parts")
def t5(v):
    return parts(v)


@query("t6_split_accepted", f"""{SPLIT}, has AS (SELECT neuron, count(*) AS nodes, bool_or(part='axon') AS a, bool_or(part='dendrite') AS d, bool_or(part='linker') AS l FROM parts GROUP BY neuron)
SELECT neuron, nodes, CASE WHEN nodes > 80000 THEN 'size' WHEN a AND d AND l THEN 'three parts' WHEN a AND d THEN 'two parts' WHEN l THEN 'issue: one side' ELSE 'issue: no split' END AS status FROM has""")
def t6(v):
    p = parts(v)
    big = F.count(lit(1)) > 80000
    g = p.groupBy("neuron").agg(F.collect_set("part").alias("parts"), n_().alias("nodes"), big.alias("big"))
    has = lambda x: F.array_contains("parts", x)
    status = (F.when(c("big"), "size").when(has("axon") & has("dendrite") & has("linker"), "three parts").when(has("axon") & has("dendrite"), "two parts")
              .when(has("linker"), "issue: one side").otherwise("issue: no split"))
    return g.select("neuron", "nodes", status.alias("status"))


@query("t7_labelled_contacts", f"{SPLIT} SELECT c.neuron, c.contact, c.type, CASE part WHEN 'axon' THEN 'A' WHEN 'dendrite' THEN 'D' ELSE 'L' END AS compartment FROM con c JOIN parts p ON p.neuron=c.neuron AND p.node_id=c.node_id")
def t7(v):
    label = F.when(c("part") == "axon", "A").when(c("part") == "dendrite", "D").otherwise("L")
    return attached(v).join(parts(v).select("neuron", "node_id", "part"), ["neuron", "node_id"]).select("neuron", "contact", "type", label.alias("compartment"))


@query("t8_root_count", "SELECT neuron, count(*) FILTER (parent_id=-1) AS roots, count(*) FILTER (parent_id=-1)=1 AS one_tree FROM skeleton GROUP BY neuron")
def t8(v):
    return v.skeleton.groupBy("neuron").agg(F.count_if(c("parent_id") == -1).alias("roots")).withColumn("one_tree", c("roots") == 1)


@query("t9_fragments", f"""{CONNECT}, {UPWARD}, top AS (SELECT neuron, node_id, max(anc) AS root FROM up WHERE anc % 5 = 0 OR anc = 1 GROUP BY ALL) SELECT t.neuron, t.root, count(DISTINCT t.node_id) AS nodes, count(c.contact) AS contacts FROM top t LEFT JOIN con c ON c.neuron=t.neuron AND c.node_id=t.node_id GROUP BY ALL""")
def t9(v):
    nodes = tour.ranked(fragments(v))
    n = attached(v).groupBy("neuron", "node_id").agg(n_().alias("n"))
    return nodes.join(n, ["neuron", "node_id"], "left").groupBy("neuron", "root").agg(n_().alias("nodes"), F.coalesce(F.sum("n"), lit(0)).alias("contacts"))


@query("t10_morphology", """k AS (SELECT s.neuron, s.node_id, (SELECT 1) AS one FROM skeleton s), ch AS (SELECT neuron, parent_id AS node_id, count(*) AS n FROM skeleton WHERE parent_id<>-1 GROUP BY ALL),
e AS (SELECT a.neuron, sum(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) AS cable FROM skeleton a JOIN skeleton b ON a.neuron=b.neuron AND a.parent_id=b.node_id GROUP BY a.neuron)
SELECT s.neuron, count(*) AS nodes, count(*) FILTER (ch.n IS NULL) AS leafs, count(*) FILTER (ch.n>1) AS branches, round(coalesce(any_value(cable),0),3) AS cable_length FROM skeleton s LEFT JOIN ch ON ch.neuron=s.neuron AND ch.node_id=s.node_id LEFT JOIN e ON e.neuron=s.neuron GROUP BY s.neuron""".replace("k AS (SELECT s.neuron, s.node_id, (SELECT 1) AS one FROM skeleton s), ", ""))
def t10(v):
    kids = v.skeleton.filter(c("parent_id") != -1).groupBy("neuron", c("parent_id").alias("node_id")).agg(n_().alias("n"))
    t = tree.edge_lengths(v.skeleton).join(kids, ["neuron", "node_id"], "left")
    return t.groupBy("neuron").agg(n_().alias("nodes"), F.count_if(c("n").isNull()).alias("leafs"), F.count_if(c("n") > 1).alias("branches"), F.round(F.sum("length"), 3).alias("cable_length"))


def sampled(v, most):
    """Of each neuron's contacts, equally many of each type by a hash of the contact: as many as there are of the rarer type,
    ``most`` at most."""
    from pyspark.sql import Window

    w = Window.partitionBy("neuron", "type").orderBy(drawn(c("contact")), "contact")
    n = attached(v).groupBy("neuron").agg(*[F.count_if(c("type") == t).alias(f"n_{t}") for t in ("pre", "post")])
    ranked = attached(v).withColumn("place", F.row_number().over(w)).join(n, "neuron")
    return ranked.filter(c("place") <= F.least(lit(most), c("n_pre"), c("n_post")))


@query("t11_pre_post_distance", f"""{CONNECT}, {UPWARD}, {WAYS}, placed AS (SELECT neuron, type, node_id, row_number() OVER (PARTITION BY neuron, type ORDER BY ('0x' || substr(md5('42:' || contact),1,7))::BIGINT, contact) AS place FROM con),
few AS (SELECT neuron, least(300, count(*) FILTER (type='pre'), count(*) FILTER (type='post')) AS k FROM con GROUP BY neuron), s AS (SELECT p.neuron, type, node_id, count(*) AS n FROM placed p JOIN few ON few.neuron=p.neuron WHERE place <= k GROUP BY ALL),
pairs AS (SELECT a.neuron, a.node_id AS u, b.node_id AS v, a.n*b.n AS w FROM s a JOIN s b ON a.neuron=b.neuron WHERE a.type='pre' AND b.type='post'), {ways("pairs", "met.neuron")}
SELECT neuron, round(sum(w*path)/sum(w),3) AS mean_path, sum(w)::BIGINT AS pairs FROM way GROUP BY neuron""")
def t11(v):
    """Mean way between sampled pre and post contacts of a neuron, min(300, pre, post) of each; the sample is part of
    the measure."""
    s = sampled(v, 300).groupBy("neuron", "type", "node_id").agg(n_().alias("n"))
    a = s.filter(c("type") == "pre").select("neuron", c("node_id").alias("u"), c("n").alias("nu"))
    b = s.filter(c("type") == "post").select("neuron", c("node_id").alias("v"), c("n").alias("nv"))
    nodes, jumps = tree.doubled(v.skeleton)
    p = tree.path_lengths(a.join(b, "neuron"), nodes, jumps)
    w = c("nu") * c("nv")
    return p.groupBy("neuron").agg(F.round(F.sum(w * c("path")) / F.sum(w), 3).alias("mean_path"), F.sum(w).alias("pairs"))


@query("t12_path_lengths", f"""{UPWARD}, len AS (SELECT a.neuron, a.node_id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS l FROM skeleton a JOIN skeleton b ON a.neuron=b.neuron AND a.parent_id=b.node_id),
pr AS (SELECT a.neuron, a.node_id AS u, b.node_id AS v FROM skeleton a JOIN skeleton b ON a.neuron=b.neuron AND b.node_id IN (a.node_id+1, a.node_id+5)),
e AS (SELECT pr.neuron, u, v, up.anc FROM pr JOIN up ON up.neuron=pr.neuron AND up.node_id=u UNION ALL SELECT pr.neuron, u, v, up.anc FROM pr JOIN up ON up.neuron=pr.neuron AND up.node_id=v),
once AS (SELECT neuron, u, v, anc FROM e GROUP BY ALL HAVING count(*)=1) SELECT pr.neuron, pr.u, pr.v, round(coalesce(sum(l),0),3) AS path FROM pr LEFT JOIN once o ON o.neuron=pr.neuron AND o.u=pr.u AND o.v=pr.v LEFT JOIN len ON len.neuron=o.neuron AND len.node_id=o.anc GROUP BY ALL""")
def t12(v):
    a = v.skeleton.select("neuron", c("node_id").alias("u"), F.explode(F.array(c("node_id") + 1, c("node_id") + 5)).alias("v"))
    pairs = a.join(v.skeleton.select("neuron", c("node_id").alias("v")), ["neuron", "v"])
    nodes, jumps = tree.doubled(v.skeleton)
    return tree.path_lengths(pairs, nodes, jumps).select("neuron", "u", "v", F.round("path", 3).alias("path"))


@query("t13_reciprocal_distance", f"""{CONNECT}, {UPWARD}, {WAYS}, recip AS (SELECT a.pre AS neuron, a.post AS partner FROM conn0 a JOIN conn0 b ON a.pre=b.post AND a.post=b.pre),
s AS (SELECT c.neuron, c.partner, type, node_id, count(*) AS n FROM con c JOIN recip r ON r.neuron=c.neuron AND r.partner=c.partner GROUP BY ALL),
pairs AS (SELECT a.neuron, a.partner, a.node_id AS u, b.node_id AS v, a.n*b.n AS w FROM s a JOIN s b ON a.neuron=b.neuron AND a.partner=b.partner WHERE a.type='pre' AND b.type='post'), {ways("pairs", "met.neuron, partner")}
SELECT neuron, partner, round(sum(w*path)/sum(w),3) AS mean_path, sum(w)::BIGINT AS pairs FROM way GROUP BY ALL""")
def t13(v):
    """Mean way between the sites that a neuron shares with a reciprocal partner, in to out."""
    both = tables.reciprocal_pairs(tables.type_counts(v.typed), ["sum_syn"]).select(F.explode(F.array(F.struct(c("a").alias("neuron"), c("b").alias("partner")), F.struct(c("b").alias("neuron"), c("a").alias("partner")))).alias("e")).select("e.*")
    s = attached(v).join(both, ["neuron", "partner"], "left_semi").groupBy("neuron", "partner", "type", "node_id").agg(n_().alias("n"))
    a = s.filter(c("type") == "pre").select("neuron", "partner", c("node_id").alias("u"), c("n").alias("nu"))
    b = s.filter(c("type") == "post").select("neuron", "partner", c("node_id").alias("v"), c("n").alias("nv"))
    nodes, jumps = tree.doubled(v.skeleton)
    p = tree.path_lengths(a.join(b, ["neuron", "partner"]), nodes, jumps)
    w = c("nu") * c("nv")
    return p.groupBy("neuron", "partner").agg(F.round(F.sum(w * c("path")) / F.sum(w), 3).alias("mean_path"), F.sum(w).alias("pairs"))


#: The clusters in SQL: contacts of a node have the same neighbours, so nodes are clustered; cores that reach one another share the least contact.
BOUTONS = f"""{CONNECT.replace("any_value(cx) AS cx,", "any_value(cx) AS cx, any_value(cy) AS cy, any_value(cz) AS cz,")}, {UPWARD}, {WAYS},
pc AS (SELECT neuron, contact, node_id, cx AS x, cy AS y, cz AS z FROM con WHERE type='pre'), many AS (SELECT neuron FROM pc GROUP BY neuron HAVING count(*) >= 5),
wt AS (SELECT neuron, node_id, count(*) AS n, min(contact) AS first FROM pc WHERE neuron IN (FROM many) GROUP BY ALL),
np AS (SELECT a.neuron, a.node_id AS u, b.node_id AS v, 1 AS w FROM wt a JOIN wt b ON a.neuron=b.neuron), {ways("np", "met.neuron, u, v")},
nb AS (SELECT neuron, u, v FROM way WHERE greatest(path, 0) <= {EPS}), core AS (SELECT nb.neuron, u AS node_id FROM nb JOIN wt ON wt.neuron=nb.neuron AND wt.node_id=nb.v GROUP BY ALL HAVING sum(n) >= 3),
cc AS (SELECT nb.* FROM nb JOIN core a ON a.neuron=nb.neuron AND a.node_id=u JOIN core b ON b.neuron=nb.neuron AND b.node_id=v),
cl AS (SELECT neuron, node_id AS u, node_id AS v FROM core UNION SELECT cl.neuron, cl.u, cc.v FROM cl JOIN cc ON cc.neuron=cl.neuron AND cc.u=cl.v),
lb AS (SELECT cl.neuron, u AS node_id, min(first) AS label FROM cl JOIN wt ON wt.neuron=cl.neuron AND wt.node_id=cl.v GROUP BY ALL),
bd AS (SELECT nb.neuron, u AS node_id, min(label) AS label FROM nb JOIN lb ON lb.neuron=nb.neuron AND lb.node_id=nb.v GROUP BY ALL),
bt AS (SELECT pc.*, dense_rank() OVER (PARTITION BY pc.neuron ORDER BY label) - 1 AS cluster FROM pc JOIN bd ON bd.neuron=pc.neuron AND bd.node_id=pc.node_id)"""
MERGED = f"""{BOUTONS}, gp AS (SELECT a.neuron, a.cluster AS u, b.cluster AS v FROM bt a JOIN bt b ON a.neuron=b.neuron AND a.cluster<>b.cluster GROUP BY ALL HAVING min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) < 5000),
gc AS (SELECT DISTINCT neuron, cluster AS u, cluster AS v FROM bt UNION SELECT gc.neuron, gc.u, gp.v FROM gc JOIN gp ON gp.neuron=gc.neuron AND gp.u=gc.v), gl AS (SELECT neuron, u AS cluster, min(v) AS label FROM gc GROUP BY ALL),
mb AS (SELECT bt.* EXCLUDE (cluster), dense_rank() OVER (PARTITION BY bt.neuron ORDER BY label) - 1 AS cluster FROM bt JOIN gl ON gl.neuron=bt.neuron AND gl.cluster=bt.cluster)"""
ADDED = f"""{MERGED}, rest AS (SELECT * FROM pc WHERE contact NOT IN (SELECT contact FROM mb)), rd AS (SELECT r.*, m.contact AS other, m.cluster, sqrt((r.x-m.x)*(r.x-m.x)+(r.y-m.y)*(r.y-m.y)+(r.z-m.z)*(r.z-m.z)) AS d FROM rest r JOIN mb m ON m.neuron=r.neuron),
ab AS (SELECT neuron, contact, node_id, x, y, z, cluster FROM mb UNION ALL SELECT neuron, contact, any_value(node_id), any_value(x), any_value(y), any_value(z), arg_min(cluster, (d, other)) FROM rd WHERE d < 4500 GROUP BY neuron, contact)"""


@once
def boutons(v):
    pre = attached(v).filter(c("type") == "pre")
    found = tree.clusters(pre.select("neuron", "contact", "node_id"), v.skeleton, EPS)
    return found.join(pre.select("contact", c("cx").alias("x"), c("cy").alias("y"), c("cz").alias("z")), "contact")


@query("t14_boutons", f"{BOUTONS} SELECT neuron, contact, node_id, cluster FROM bt")
def t14(v):
    return boutons(v).select("neuron", "contact", "node_id", "cluster")


@query("t15_merged_boutons", f"{MERGED} SELECT neuron, contact, node_id, cluster FROM mb")
def t15(v):
    return tree.merge_clusters(boutons(v), 5000.0).select("neuron", "contact", "node_id", "cluster")


@once
def boutons_with_near(v):
    """Clusters with the unclustered contacts near them: each joins its nearest clustered contact's cluster."""

    found = by_count(stored(tree.merge_clusters(boutons(v), 5000.0), "merged"))
    pre = attached(v).filter(c("type") == "pre").select("neuron", "contact", "node_id", c("cx").alias("x"), c("cy").alias("y"), c("cz").alias("z"))
    rest = pre.join(found.select("contact"), "contact", "left_anti")
    right = found.select("neuron", c("contact").alias("other"), c("x").alias("ox"), c("y").alias("oy"), c("z").alias("oz"))
    near = joins.nearest(rest, right, "neuron", "contact", "other", ["x", "y", "z"], ["ox", "oy", "oz"], [4500.0], strict=True)
    more = near.join(found.select(c("contact").alias("other"), "cluster"), "other").join(pre.select("contact", "node_id", "x", "y", "z"), "contact")
    names = ["neuron", "contact", "node_id", "cluster", "x", "y", "z"]
    return found.select(*names).unionByName(more.select(*names))


@query("t16_near_contacts_added", f"{ADDED} SELECT neuron, contact, node_id, cluster FROM ab")
def t16(v):
    return boutons_with_near(v).select("neuron", "contact", "node_id", "cluster")


@once
def centroid_nodes(v):
    g = boutons_with_near(v).groupBy("neuron", "cluster").agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    d = F.sqrt(sum(((c(f"m{a}") - c(a)) * (c(f"m{a}") - c(a)) for a in "xyz"), lit(0.0)))
    return g.join(v.skeleton, "neuron").groupBy("neuron", "cluster").agg(F.min(F.struct(d.alias("d"), "node_id")).alias("m")).select("neuron", "cluster", c("m.node_id").alias("centroid"))


@once
def stage_one(v):
    """Post contacts whose way to the nearest centroid is under the bound, unless a pre contact outside clusters is nearer to it."""

    nodes, jumps = tree.doubled(v.skeleton)
    mid = centroid_nodes(v)
    con = attached(v)
    post = con.filter(c("type") == "post").select("neuron", "contact", c("node_id").alias("u"))
    pairs = post.select("neuron", "u").distinct().join(mid.select("neuron", "cluster", c("centroid").alias("v")), "neuron")
    way = tree.path_lengths(pairs, nodes, jumps).filter(c("path") < 5 * EPS)
    best = way.groupBy("neuron", "u").agg(F.min(F.struct("path", "v", "cluster")).alias("m")).select("neuron", "u", "m.path", c("m.v").alias("centroid"), "m.cluster")
    loose = con.filter(c("type") == "pre").join(boutons_with_near(v).select("contact"), "contact", "left_anti").select("neuron", c("node_id").alias("u")).distinct()
    bar = tree.path_lengths(loose.join(mid.select("neuron", c("centroid").alias("v")), "neuron"), nodes, jumps).groupBy("neuron", c("v").alias("centroid")).agg(F.min("path").alias("bar"))
    out = post.join(best, ["neuron", "u"]).join(bar, ["neuron", "centroid"], "left").filter(c("bar").isNull() | (c("bar") >= c("path")))
    return out.select("neuron", "contact", c("u").alias("node_id"), "centroid", "cluster", F.round("path", 3).alias("path"))


@query("t17_filopodia_first", f"""{ADDED}, mid AS (SELECT neuron, cluster, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM ab GROUP BY ALL),
cn AS (SELECT m.neuron, cluster, arg_min(node_id, (sqrt((mx-x)*(mx-x)+(my-y)*(my-y)+(mz-z)*(mz-z)), node_id)) AS centroid FROM mid m JOIN skeleton s ON s.neuron=m.neuron GROUP BY ALL),
p1 AS (SELECT DISTINCT c.neuron, node_id AS u, centroid AS v, 1 AS w FROM con c JOIN cn ON cn.neuron=c.neuron), {ways("p1", "met.neuron, u, v").replace("lifted", "lifted1").replace("met AS", "met1 AS").replace("FROM met ", "FROM met1 ").replace("met.", "met1.").replace("way AS", "way1 AS")},
best AS (SELECT c.neuron, c.contact, c.node_id, arg_min((greatest(path,0), v, cluster), (greatest(path,0), v, cluster)) AS m FROM con c JOIN way1 y ON y.neuron=c.neuron AND y.u=c.node_id JOIN cn ON cn.neuron=c.neuron AND cn.centroid=y.v WHERE type='post' AND path < {5 * EPS} GROUP BY ALL),
bar AS (SELECT y.neuron, y.v AS centroid, min(greatest(path,0)) AS bar FROM way1 y JOIN (SELECT DISTINCT neuron, node_id FROM pc WHERE contact NOT IN (SELECT contact FROM ab)) l ON l.neuron=y.neuron AND l.node_id=y.u GROUP BY ALL)
SELECT b.neuron, b.contact, b.node_id, m[2] AS centroid, m[3] AS cluster, round(m[1],3) AS path FROM best b LEFT JOIN bar ON bar.neuron=b.neuron AND bar.centroid=m[2] WHERE bar IS NULL OR bar >= m[1]""")
def t17(v):
    return stage_one(v)


@query("t18_no_pre_below", f"{CONNECT}, {UPWARD}, {TOTALS} SELECT c.neuron, c.contact, c.node_id FROM con c JOIN tot ON tot.neuron=c.neuron AND tot.node_id=c.node_id WHERE type='post' AND tot.p=0")
def t18(v):
    con = attached(v)
    on = con.groupBy("neuron", "node_id").agg(F.count_if(c("type") == "pre").alias("p"))
    t = v.skeleton.join(on, ["neuron", "node_id"], "left").fillna(0, ["p"])
    nodes = tour.measured(t, tour.ranked(v.skeleton), {"below": c("p")})
    return con.filter(c("type") == "post").join(nodes.filter(c("below") == 0).select("neuron", "node_id"), ["neuron", "node_id"]).select("neuron", "contact", "node_id")


@query("t19_base_nodes")
def t19(v):
    """On the way from a contact to its centroid, the node before the first one that has a pre contact; the centroid if none has.  Where
    more than two edges meet there (to tree nodes and contacts), the node before it on the way.  Of the contacts that both stages keep."""

    first = stored(stage_one(v).join(t18(v).select("neuron", "contact"), ["neuron", "contact"], "left_semi"), "base-contacts")
    pre = attached(v).filter(c("type") == "pre").select("neuron", "node_id").distinct().withColumn("has", lit(True))
    nodes, jumps = tree.doubled(v.skeleton)
    pairs = first.select("neuron", c("node_id").alias("u"), c("centroid").alias("v")).distinct()
    top = by_count(stored(tree.path_lengths(pairs, nodes, jumps).select("neuron", "u", "v", "lca"), "base-ways"))
    up = v.skeleton.select("neuron", c("node_id").alias("at"), "parent_id")

    def climb(end: str):
        """(pair, node, steps from that end) up to the common ancestor."""
        now = top.withColumn("at", c(end)).withColumn("steps", lit(0))
        all_ = now
        while True:
            now = stored(now.filter(c("at") != c("lca")).join(up, ["neuron", "at"]).select("neuron", "u", "v", "lca", c("parent_id").alias("at"), (c("steps") + 1).alias("steps")), "base-climb")
            if not now.take(1):
                return all_
            all_ = all_.unionByName(now.select(*all_.columns))
    rise, fall = climb("u"), climb("v")
    length = rise.filter(c("at") == c("lca")).select("neuron", "u", "v", c("steps").alias("up")).join(fall.filter(c("at") == c("lca")).select("neuron", "u", "v", c("steps").alias("down")), ["neuron", "u", "v"])
    fall = fall.filter(c("at") != c("lca")).join(length, ["neuron", "u", "v"]).select("neuron", "u", "v", "at", (c("up") + c("down") - c("steps")).alias("place"))
    way = stored(rise.select("neuron", "u", "v", "at", c("steps").alias("place")).unionByName(fall), "base-way")
    way = by_count(way)
    hit = way.join(pre.withColumnRenamed("node_id", "at"), ["neuron", "at"]).groupBy("neuron", "u", "v").agg(F.min("place").alias("first"))
    last = way.groupBy("neuron", "u", "v").agg(F.max("place").alias("last"))
    base = last.join(hit, ["neuron", "u", "v"], "left").select("neuron", "u", "v", F.coalesce(F.greatest(c("first") - 1, lit(0)), "last").alias("place"))
    kids = v.skeleton.filter(c("parent_id") != -1).groupBy("neuron", c("parent_id").alias("at")).agg(n_().alias("kids"))
    on = attached(v).groupBy("neuron", c("node_id").alias("at")).agg(n_().alias("on"))
    degree = v.skeleton.select("neuron", c("node_id").alias("at"), (c("parent_id") != -1).cast("bigint").alias("up")).join(kids, ["neuron", "at"], "left").join(on, ["neuron", "at"], "left")
    degree = degree.select("neuron", "at", (c("up") + F.coalesce("kids", lit(0)) + F.coalesce("on", lit(0))).alias("degree"))
    places = ["neuron", "u", "v", "place"]
    base = base.join(way.select(*places, "at"), places).join(degree, ["neuron", "at"])
    base = base.withColumn("place", F.when((c("degree") > 2) & (c("place") > 0), c("place") - 1).otherwise(c("place"))).select(*places)
    base = base.join(way.select(*places, "at"), places).select("neuron", "u", "v", c("at").alias("base"))
    out = first.join(base.select("neuron", c("u").alias("node_id"), c("v").alias("centroid"), "base"), ["neuron", "node_id", "centroid"])
    return tree.dense(out, "base", "base_no").select("neuron", "contact", "node_id", "centroid", "base", "base_no")


def damaged(v):
    """The skeletons of which some are broken: a cycle of parents, a parent that isn't there, a node that is there twice."""
    four = v.skeleton.filter((c("neuron") % 7 == 3) & (c("node_id") == 4)).select("neuron", lit(True).alias("four"))
    t = v.skeleton.join(four, "neuron", "left")
    parent = F.when(c("four") & (c("node_id") == 2), 4).when((c("neuron") % 7 == 5) & (c("node_id") == 3), 1_000_003).otherwise(c("parent_id"))
    times = F.when((c("neuron") % 7 == 6) & (c("node_id") == 5), 2).otherwise(1)
    return t.withColumn("parent_id", parent.cast("bigint")).withColumn("__i", F.explode(F.sequence(lit(1), times))).drop("four", "__i")


@query("t20_issues", """i AS (SELECT n.neuron, CASE WHEN s.neuron IS NULL THEN 'no skeleton' WHEN i.si IS NULL THEN 'no index' END AS issue, NULL::BIGINT AS nodes, NULL::BIGINT AS sound
 FROM neurons n LEFT JOIN (SELECT DISTINCT neuron FROM skeleton) s ON s.neuron=n.neuron LEFT JOIN si i ON i.neuron=n.neuron WHERE s.neuron IS NULL OR i.si IS NULL),
four AS (SELECT neuron FROM skeleton WHERE neuron % 7 = 3 AND node_id = 4), under AS (SELECT * FROM skeleton WHERE node_id >= 2 AND neuron IN (FROM four) AND node_id >> (floor(log2(node_id))::INT - 1) = 2)
SELECT * FROM i UNION ALL SELECT neuron, 'cycle', count(*), NULL FROM under GROUP BY neuron UNION ALL SELECT neuron, 'missing parent', 1, NULL FROM skeleton WHERE neuron % 7 = 5 AND node_id = 3
UNION ALL SELECT neuron, 'duplicate node', 1, NULL FROM skeleton WHERE neuron % 7 = 6 AND node_id = 5
UNION ALL SELECT s.neuron, NULL, count(*), sum(floor(log2(s.node_id)))::BIGINT FROM skeleton s WHERE s.neuron NOT IN (FROM four) AND s.neuron NOT IN (SELECT neuron FROM skeleton WHERE (neuron % 7 = 5 AND node_id = 3) OR (neuron % 7 = 6 AND node_id = 5)) GROUP BY s.neuron""")
def t20(v):
    """A row an issue of a neuron; neurons whose trees have none: their nodes, and the sum of these nodes' depths."""
    s = v.skeleton.select("neuron").distinct().withColumn("has", lit(True))
    issue = F.when(c("has").isNull(), "no skeleton").when(c("si").isNull(), "no index")
    none = lit(None).cast("bigint")
    out = v.neurons.select("neuron").join(s, "neuron", "left").join(v.si.select("neuron", "si"), "neuron", "left").select("neuron", issue.alias("issue"), none.alias("nodes"), none.alias("sound")).filter(c("issue").isNotNull())
    t = stored(damaged(v), "damaged")
    walk = tour.ranked(t)
    broken = stored(tour.issues(t, walk), "issues")
    nodes = tour.measured(t, walk, {}).join(broken.select("neuron").distinct(), "neuron", "left_anti")
    sound = nodes.groupBy("neuron").agg(n_().alias("nodes"), F.sum("depth").alias("sound")).select("neuron", lit(None).cast("string").alias("issue"), "nodes", "sound")
    return out.unionByName(broken.select("neuron", "issue", "nodes", none.alias("sound"))).unionByName(sound)
