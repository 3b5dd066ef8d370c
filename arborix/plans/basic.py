"""Queries of projections, filters, joins, aggregations, windows, sorts, sets and bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from arborix.functions import expr
from arborix.functions.ranks import quantiles, running, tied_ranks
from arborix.functions.windows import numbered, rolling_mean
from arborix.operators import joins, tables
from arborix.plans.registry import query

c, lit = F.col, F.lit
T4 = ["AA", "AD", "DA", "DD"]
ENDS = ["pre_x", "pre_y", "pre_z", "post_x", "post_y", "post_z"]
r6 = lambda x: F.round(x, 6)

# ---- projections, filters, predicates


@query("pf1_full_id", "SELECT pre, post, ('720575940' || pre)::BIGINT AS pre_id, ('720575940' || post)::BIGINT AS post_id, count(*) AS n FROM syn GROUP BY ALL")
def pf1(v):
    return v.syn.groupBy("pre", "post").agg(F.count(lit(1)).alias("n")).withColumns({"pre_id": expr.full_id(c("pre")), "post_id": expr.full_id(c("post"))})


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


@query("pf2_synapse_id", f"SELECT row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) - 1 AS synapse_id, pre, post, size FROM contacts")
def pf2(v):
    return numbered(v.contacts, F.floor(c("l_orderkey") / 256), [c(x) for x in LINE_ORDER], "synapse_id").select("synapse_id", "pre", "post", "size")


@query("pf3_rename_reorder", "SELECT post AS target, pre AS origin, npil AS region, count(*) AS n FROM syn GROUP BY ALL")
def pf3(v):
    return v.syn.select(c("post").alias("target"), c("pre").alias("origin"), c("npil").alias("region")).groupBy("target", "origin", "region").agg(F.count(lit(1)).alias("n"))


@query("pf4_no_self_contacts", "SELECT pre, post, pre_compartment, post_compartment, npil, size FROM syn")
def pf4(v):
    return tables.without_self(v.syn_self).select("pre", "post", "pre_compartment", "post_compartment", "npil", "size")


@query("pf5_four_types", "SELECT pre, post, comp, npil FROM typed")
def pf5(v):
    return v.comp.filter(c("comp").isin(T4)).select("pre", "post", "comp", "npil")


INTRINSIC = ["central", "optic", "visual_projection", "visual_centrifugal"]


@query("pf6_intrinsic", "SELECT * FROM neurons WHERE super_class IN ('central','optic','visual_projection','visual_centrifugal')")
def pf6(v):
    return v.neurons.filter(c("super_class").isin(INTRINSIC))


@query("pf7_drop_null_subset", "SELECT neuron, si, super_class FROM nsi WHERE si IS NOT NULL AND super_class IS NOT NULL")
def pf7(v):
    return v.nsi.dropna(subset=["si", "super_class"]).select("neuron", "si", "super_class")


@query("pf8_drop_null_any", "SELECT * FROM nsi WHERE COLUMNS(*) IS NOT NULL")
def pf8(v):
    return v.nsi.dropna()


@query("pf9_two_sided_threshold", "SELECT pre, post, comp, si_pre, si_post FROM master WHERE si_pre >= 0.1 AND si_post >= 0.1")
def pf9(v):
    return v.master.filter((c("si_pre") >= 0.1) & (c("si_post") >= 0.1)).select("pre", "post", "comp", "si_pre", "si_post")


@query("pf10_infinite_to_null", "SELECT neuron, CASE WHEN ax_post>0 THEN round(ax_pre/ax_post,6) END AS q, (ax_post=0 OR ax_post IS NULL) AS removed FROM nsi")
def pf10(v):
    wild = F.try_divide(c("ax_pre").cast("double"), c("ax_post"))
    q = expr.finite(wild)
    return v.nsi.select("neuron", r6(q).alias("q"), q.isNull().alias("removed"))


@query("pf11_map_values", "SELECT neuron, CASE nt_type WHEN 'ACH' THEN 'acetylcholine' WHEN 'GABA' THEN 'gaba' WHEN 'GLUT' THEN 'glutamate' ELSE nt_type END AS nt FROM neurons")
def pf11(v):
    return v.neurons.select("neuron", c("nt_type").alias("nt")).replace({"ACH": "acetylcholine", "GABA": "gaba", "GLUT": "glutamate"}, subset=["nt"])


@query("pf12_type_family", "SELECT neuron, primary_type, CASE WHEN starts_with(primary_type,'Brand#1') THEN 'one' WHEN regexp_matches(primary_type,'^Brand#2[0-3]$') THEN 'two' END AS family FROM neurons WHERE starts_with(primary_type,'Brand#1') OR regexp_matches(primary_type,'^Brand#2[0-3]$')")
def pf12(v):
    family = F.when(c("primary_type").startswith("Brand#1"), "one").when(c("primary_type").rlike("^Brand#2[0-3]$"), "two")
    return v.neurons.select("neuron", "primary_type", family.alias("family")).dropna(subset=["family"])


@query("pf13_strip_side", "SELECT regexp_replace(npil,'_[LR]$','') AS region, count(*) AS n FROM syn GROUP BY 1")
def pf13(v):
    return v.syn.groupBy(expr.without_side(c("npil")).alias("region")).agg(F.count(lit(1)).alias("n"))


@query("pf14_split_join_letters", "SELECT comp, comp[1] AS a, comp[2] AS b, comp[2] || comp[1] AS swapped, count(*) AS n FROM comp GROUP BY ALL")
def pf14(v):
    a, b = F.substring("comp", 1, 1), F.substring("comp", 2, 1)
    return v.comp.groupBy("comp").agg(F.count(lit(1)).alias("n")).select("comp", a.alias("a"), b.alias("b"), F.concat(b, a).alias("swapped"), "n")


@query("pf15_mixed_by_index", "SELECT (CASE WHEN si_pre < 0.1 THEN 'M' ELSE comp[1] END) || (CASE WHEN si_post < 0.1 THEN 'M' ELSE comp[2] END) AS label, count(*) AS n FROM master GROUP BY 1")
def pf15(v):
    a = F.when(c("si_pre") < 0.1, "M").otherwise(F.substring("comp", 1, 1))
    b = F.when(c("si_post") < 0.1, "M").otherwise(F.substring("comp", 2, 1))
    return v.master.groupBy(F.concat(a, b).alias("label")).agg(F.count(lit(1)).alias("n"))


@query("pf16_mixed_by_correctness", """ok AS (SELECT neuron, CASE WHEN ax_pre+ax_post>0 THEN ax_pre/(ax_pre+ax_post) END AS a, CASE WHEN de_pre+de_post>0 THEN de_post/(de_pre+de_post) END AS d FROM si)
SELECT x || y AS label, count(*) AS n FROM (SELECT
 CASE comp[1] WHEN 'A' THEN CASE WHEN p.a*100>55 THEN 'A' ELSE 'M' END WHEN 'D' THEN CASE WHEN p.d*100>55 THEN 'D' ELSE 'M' END ELSE 'O' END AS x,
 CASE comp[2] WHEN 'A' THEN CASE WHEN q.a*100>55 THEN 'A' ELSE 'M' END WHEN 'D' THEN CASE WHEN q.d*100>55 THEN 'D' ELSE 'M' END ELSE 'O' END AS y
 FROM comp c JOIN ok p ON p.neuron=c.pre JOIN ok q ON q.neuron=c.post) GROUP BY 1""")
def pf16(v):
    ok = v.si.select("neuron", expr.ratio(c("ax_pre"), c("ax_pre") + c("ax_post")).alias("a"), expr.ratio(c("de_post"), c("de_pre") + c("de_post")).alias("d"))
    rows = tables.with_roles(v.comp, ok, ["a", "d"], "inner")

    def label(i, role):
        letter = F.substring("comp", i, 1)
        return (F.when(letter == "A", F.when(c(f"a_{role}") * 100 > 55, "A").otherwise("M"))
                .when(letter == "D", F.when(c(f"d_{role}") * 100 > 55, "D").otherwise("M")).otherwise("O"))
    return rows.groupBy(F.concat(label(1, "pre"), label(2, "post")).alias("label")).agg(F.count(lit(1)).alias("n"))


@query("pf17_score_filter", "SELECT pre, post, cleft_score FROM syn WHERE cleft_score >= 30")
def pf17(v):
    return v.syn.filter(c("cleft_score") >= 30).select("pre", "post", "cleft_score")


@query("pf18_size_gate", "SELECT neuron, count(*) AS nodes, CASE WHEN count(*) > 70 THEN 'large' ELSE 'regular' END AS size_class FROM skeleton GROUP BY neuron")
def pf18(v):
    return v.skeleton.groupBy("neuron").agg(F.count(lit(1)).alias("nodes")).withColumn("size_class", F.when(c("nodes") > 70, "large").otherwise("regular"))


@query("pf19_middle_share", "q AS (SELECT quantile_cont(length_nm, 0.025) AS lo, quantile_cont(length_nm, 0.975) AS hi FROM neurons) SELECT neuron, length_nm FROM neurons, q WHERE length_nm BETWEEN lo AND hi")
def pf19(v):
    q = quantiles(v.neurons, [], "length_nm", [0.025, 0.975])
    return v.neurons.crossJoin(F.broadcast(q)).filter(c("length_nm").between(c("q0"), c("q1"))).select("neuron", "length_nm")  # one row


@query("pf20_minimum_strength", "SELECT pre, post, sum_syn FROM conn0 WHERE sum_syn >= 3")
def pf20(v):
    return tables.type_counts(v.typed).filter(c("sum_syn") >= 3).select("pre", "post", "sum_syn")


@query("pf21_unit_transforms", "SELECT neuron, round(asin(sqrt(ax_pre/(ax_pre+ax_post))),6) AS t, round(100*ax_pre/(ax_pre+ax_post),6) AS pct, [round(length_nm/4,6), round(area_nm/4,6), round(size_nm/40,6)] AS voxel FROM nsi WHERE ax_pre+ax_post>0")
def pf21(v):
    s = c("ax_pre") / (c("ax_pre") + c("ax_post"))
    return v.nsi.filter(c("ax_pre") + c("ax_post") > 0).select(
        "neuron", r6(expr.zscore_scale(s)).alias("t"), r6(100 * s).alias("pct"),
        F.array(r6(c("length_nm") / 4), r6(c("area_nm") / 4), r6(c("size_nm") / 40)).alias("voxel"))


@query("pf22_sentinel_and_constant", "SELECT neuron, node_id, parent_id, 50 AS weight FROM skeleton WHERE parent_id <> -1")
def pf22(v):
    return v.skeleton.filter(c("parent_id") != -1).select("neuron", "node_id", "parent_id", lit(50).alias("weight"))


@query("pf23_casts", "SELECT pre::VARCHAR AS pre, post::INT AS post, size::DOUBLE AS size, pre_x::BIGINT AS x FROM (SELECT pre, post, size, trunc(pre_x) AS pre_x FROM syn)")
def pf23(v):
    return v.syn.select(c("pre").cast("string"), c("post").cast("int"), c("size").cast("double"), c("pre_x").cast("bigint").alias("x"))


@query("pf24_id_list", "SELECT pre, post, size FROM syn WHERE pre IN (SELECT neuron FROM neurons WHERE side='center')")
def pf24(v):
    ids = v.neurons.filter(c("side") == "center").select(c("neuron").alias("pre"))
    return v.syn.join(ids, "pre", "left_semi").select("pre", "post", "size")

# ---- joins


@query("j1_label_join", """ids AS (SELECT *, row_number() OVER (ORDER BY l_orderkey,l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax,l_shipdate) - 1 AS synapse_id FROM contacts)
SELECT synapse_id, pre, post, CASE WHEN pre % 7 <> 0 THEN pre_compartment END AS pre_label, CASE WHEN post % 5 <> 0 THEN post_compartment END AS post_label FROM ids""")
def j1(v):
    ids = numbered(v.contacts, F.floor(c("l_orderkey") / 256), [c(x) for x in LINE_ORDER], "synapse_id")
    pre = ids.filter(c("pre") % 7 != 0).select("synapse_id", c("pre_compartment").alias("pre_label"))
    post = ids.filter(c("post") % 5 != 0).select("synapse_id", c("post_compartment").alias("post_label"))
    return ids.select("synapse_id", "pre", "post").join(pre, "synapse_id", "left").join(post, "synapse_id", "left")


@query("j2_roles", """SELECT c.pre, c.post, c.sum_syn, a.super_class AS super_class_pre, a.side AS side_pre, b.super_class AS super_class_post, b.side AS side_post
FROM conn0 c LEFT JOIN neurons a ON a.neuron=c.pre LEFT JOIN neurons b ON b.neuron=c.post""")
def j2(v):
    return tables.with_roles(tables.type_counts(v.typed).select("pre", "post", "sum_syn"), v.neurons, ["super_class", "side"])


@query("j3_inner", "SELECT n.neuron, si, super_class FROM si JOIN neurons n ON n.neuron=si.neuron")
def j3(v):
    return v.si.join(v.neurons, "neuron").select("neuron", "si", "super_class")


@query("j4_right", "x AS (SELECT pre AS neuron, count(*) AS partners FROM conn0 WHERE sum_syn >= 3 GROUP BY pre) SELECT n.neuron, partners FROM x RIGHT JOIN neurons n ON n.neuron=x.neuron")
def j4(v):
    x = tables.type_counts(v.typed).filter(c("sum_syn") >= 3).groupBy(c("pre").alias("neuron")).agg(F.count(lit(1)).alias("partners"))
    return x.join(v.neurons.select("neuron"), "neuron", "right").select("neuron", "partners")


@query("j5_composite_key", "SELECT t.pre, t.post, t.comp, t.npil, c.reciprocal, c.sum_syn FROM typed t LEFT JOIN conn c ON c.pre=t.pre AND c.post=t.post")
def j5(v):
    return v.typed.join(v.conn.select("pre", "post", "reciprocal", "sum_syn"), ["pre", "post"], "left").select("pre", "post", "comp", "npil", "reciprocal", "sum_syn")


@query("j6_natural", "x AS (SELECT pre, post, count(*) AS n FROM syn GROUP BY ALL) SELECT pre, post, n, sum_syn FROM x NATURAL JOIN conn0")
def j6(v):
    a = v.syn.groupBy("pre", "post").agg(F.count(lit(1)).alias("n"))
    b = tables.type_counts(v.typed)
    return a.join(b, sorted(set(a.columns) & set(b.columns))).select("pre", "post", "n", "sum_syn")


@query("j7_reverse_edges", "SELECT a.pre, a.post, a.sum_syn, b.sum_syn AS back FROM conn0 a JOIN conn0 b ON a.pre=b.post AND a.post=b.pre")
def j7(v):
    p = tables.reciprocal_pairs(tables.type_counts(v.typed), ["sum_syn"])
    both = F.explode(F.array(F.struct(c("a").alias("pre"), c("b").alias("post"), c("sum_syn_ab").alias("sum_syn"), c("sum_syn_ba").alias("back")),
                             F.struct(c("b").alias("pre"), c("a").alias("post"), c("sum_syn_ba").alias("sum_syn"), c("sum_syn_ab").alias("back"))))
    return p.select(both.alias("e")).select("e.*")


@query("j8_either_end", "SELECT pre, post, size FROM syn WHERE pre IN (SELECT neuron FROM neurons WHERE super_class='sensory') OR post IN (SELECT neuron FROM neurons WHERE super_class='sensory')")
def j8(v):
    return joins.members(v.syn.select("pre", "post", "size"), v.neurons.filter(c("super_class") == "sensory"), ["pre", "post"], "neuron")


@query("j9_membership_flag", "SELECT c.pre, c.post, (EXISTS (SELECT 1 FROM conn0 d WHERE d.pre=c.post AND d.post=c.pre AND d.sum_syn>=2))::INT AS strong_back FROM conn0 c")
def j9(v):
    e = tables.type_counts(v.typed)
    back = e.filter(c("sum_syn") >= 2).select(c("post").alias("pre"), c("pre").alias("post"), lit(1).alias("hit"))
    return e.join(back, ["pre", "post"], "left").select("pre", "post", c("hit").isNotNull().cast("int").alias("strong_back"))


@query("j10_anti", "SELECT neuron, super_class FROM neurons WHERE neuron NOT IN (SELECT pre FROM conn0 WHERE sum_syn >= 3)")
def j10(v):
    strong = tables.type_counts(v.typed).filter(c("sum_syn") >= 3).select(c("pre").alias("neuron"))
    return v.neurons.join(strong, "neuron", "left_anti").select("neuron", "super_class")


@query("j11_coordinates", "a AS (SELECT pre, pre_x AS x, pre_y AS y, pre_z AS z FROM syn), b AS (SELECT post, post_x AS x, post_y AS y, post_z AS z, count(*) AS n FROM syn GROUP BY ALL) SELECT a.pre, b.post, a.x, a.y, a.z, b.n FROM a JOIN b ON a.x=b.x AND a.y=b.y AND a.z=b.z")
def j11(v):
    a = v.syn.select("pre", c("pre_x").alias("x"), c("pre_y").alias("y"), c("pre_z").alias("z"))
    b = v.syn.groupBy("post", c("post_x").alias("x"), c("post_y").alias("y"), c("post_z").alias("z")).agg(F.count(lit(1)).alias("n"))
    return a.join(b, ["x", "y", "z"]).select("pre", "post", "x", "y", "z", "n")


@query("j12_lookup_default", "x AS (SELECT pre, count(*) AS n FROM syn WHERE pre_compartment='L' GROUP BY pre) SELECT neuron, coalesce(n, 0) AS linkers FROM neurons LEFT JOIN x ON x.pre=neuron")
def j12(v):
    x = v.syn.filter(c("pre_compartment") == "L").groupBy(c("pre").alias("neuron")).agg(F.count(lit(1)).alias("n"))
    return v.neurons.join(x, "neuron", "left").select("neuron", F.coalesce("n", lit(0)).alias("linkers"))


ORDERED_IDS = f"ids AS (SELECT *, row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) - 1 AS synapse_id FROM contacts WHERE pre <> post)"


def identified(v):
    return numbered(tables.without_self(v.contacts), F.floor(c("l_orderkey") / 256), [c(x) for x in LINE_ORDER], "synapse_id")


@query("j13_nearest_node", f"""{ORDERED_IDS}, p AS (SELECT i.synapse_id, i.pre AS neuron, s.node_id, sqrt((pre_x-x)*(pre_x-x)+(pre_y-y)*(pre_y-y)+(pre_z-z)*(pre_z-z)) AS d FROM ids i JOIN skeleton s ON s.neuron=i.pre)
SELECT neuron, synapse_id, arg_min(node_id, (d, node_id)) AS node_id, round(min(d),6) AS distance FROM p WHERE d <= 10000 GROUP BY ALL""")
def j13(v):
    left = identified(v).select("synapse_id", c("pre").alias("neuron"), "pre_x", "pre_y", "pre_z")
    out = joins.nearest(left, v.skeleton, "neuron", "synapse_id", "node_id", ["pre_x", "pre_y", "pre_z"], ["x", "y", "z"], [2500.0, 10000.0])
    return out.withColumn("distance", r6(c("distance")))


@query("j14_radius_nearest", f"""{ORDERED_IDS}, a AS (SELECT synapse_id, pre AS neuron, pre_x, pre_y, pre_z FROM ids WHERE pre_compartment='D'), b AS (SELECT synapse_id AS other, pre AS neuron, pre_x AS x, pre_y AS y, pre_z AS z FROM ids WHERE pre_compartment='A'),
p AS (SELECT a.neuron, a.synapse_id, other, sqrt((pre_x-x)*(pre_x-x)+(pre_y-y)*(pre_y-y)+(pre_z-z)*(pre_z-z)) AS d FROM a JOIN b ON a.neuron=b.neuron)
SELECT neuron, synapse_id, arg_min(other, (d, other)) AS other, round(min(d),6) AS distance FROM p WHERE d < 4500 GROUP BY ALL""")
def j14(v):
    ids = identified(v).select("synapse_id", c("pre").alias("neuron"), "pre_compartment", "pre_x", "pre_y", "pre_z")
    left = ids.filter(c("pre_compartment") == "D").drop("pre_compartment")
    right = ids.filter(c("pre_compartment") == "A").select("neuron", c("synapse_id").alias("other"), c("pre_x").alias("x"), c("pre_y").alias("y"), c("pre_z").alias("z"))
    return joins.nearest(left, right, "neuron", "synapse_id", "other", ["pre_x", "pre_y", "pre_z"], ["x", "y", "z"], [4500.0], strict=True).withColumn("distance", r6(c("distance")))


@query("j15_centroid_node", """g AS (SELECT pre AS neuron, post_compartment AS cluster, avg(pre_x) AS cx, avg(pre_y) AS cy, avg(pre_z) AS cz FROM syn GROUP BY ALL),
p AS (SELECT g.*, s.node_id, sqrt((cx-x)*(cx-x)+(cy-y)*(cy-y)+(cz-z)*(cz-z)) AS d FROM g JOIN skeleton s ON s.neuron=g.neuron)
SELECT neuron, cluster, arg_min(node_id, (d, node_id)) AS node_id, round(min(d), 4) AS distance FROM p GROUP BY ALL""")
def j15(v):
    g = v.syn.groupBy(c("pre").alias("neuron"), c("post_compartment").alias("cluster")).agg(*[F.avg(f"pre_{a}").alias(f"c{a}") for a in "xyz"])
    # a handful of centroids a neuron against its nodes: an equality join on the neuron is the whole work
    p = g.join(v.skeleton, "neuron")
    d = F.sqrt(sum(((c(f"c{a}") - c(a)) * (c(f"c{a}") - c(a)) for a in "xyz"), lit(0.0)))
    return p.groupBy("neuron", "cluster").agg(F.min(F.struct(d.alias("d"), "node_id")).alias("m")).select("neuron", "cluster", "m.node_id", F.round("m.d", 4).alias("distance"))


@query("j16_cluster_pairs", """a AS (SELECT pre AS neuron, post % 8 AS cluster, pre_x AS x, pre_y AS y, pre_z AS z FROM syn)
SELECT a.neuron, a.cluster AS c1, b.cluster AS c2, round(min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))),6) AS distance
FROM a JOIN a b ON a.neuron=b.neuron AND a.cluster<b.cluster GROUP BY ALL HAVING min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) < 2000""")
def j16(v):
    a = v.syn.select(c("pre").alias("neuron"), (c("post") % 8).alias("cluster"), *[c(f"pre_{x}").alias(x) for x in "xyz"])
    return joins.group_gaps(a, "neuron", "cluster", list("xyz"), 2000.0).withColumn("distance", r6(c("distance")))


@query("j17_pair_lookup", "SELECT pre, post, comp, size FROM comp WHERE (pre=3 AND post<40) OR (post=3 AND pre<40)")
def j17(v):
    return v.comp.filter(((c("pre") == 3) & (c("post") < 40)) | ((c("post") == 3) & (c("pre") < 40))).select("pre", "post", "comp", "size")


@query("j18_threshold_sweep", "t AS (SELECT (unnest(range(20))*5)/100.0 AS thr) SELECT round(thr::DOUBLE,2) AS thr, count(*) FILTER (si_pre>=thr AND si_post>=thr) AS n, count(*) FILTER (si_pre>=thr AND si_post>=thr AND comp='AD') AS ad FROM master, t GROUP BY thr")
def j18(v):
    # one pass: each row counts for all thresholds up to its lesser index
    low = v.master.groupBy(F.least(F.floor(F.least("si_pre", "si_post") * 20 + 1e-9), lit(19)).alias("top")).agg(F.count(lit(1)).alias("n"), F.count_if(c("comp") == "AD").alias("ad"))
    each = low.filter(c("top") >= 0).withColumn("step", F.explode(F.sequence(lit(0).cast("bigint"), c("top"))))
    got = each.groupBy("step").agg(F.sum("n").alias("n"), F.sum("ad").alias("ad"))
    steps = v.spark.range(20).withColumnRenamed("id", "step")
    return steps.join(got, "step", "left").select(F.round(c("step") * 5 / 100.0, 2).alias("thr"), F.coalesce("n", lit(0)).alias("n"), F.coalesce("ad", lit(0)).alias("ad"))


@query("j19_nearest_value", """x AS (SELECT si, max(length_nm) AS length_nm FROM nsi WHERE si IS NOT NULL GROUP BY si), p AS (SELECT (unnest(range(21))*5)/100.0 AS point)
SELECT round(point::DOUBLE,2) AS point, arg_min(si, (abs(si-point::DOUBLE), si)) AS nearest, arg_min(length_nm, (abs(si-point::DOUBLE), si)) AS value FROM x, p GROUP BY point""")
def j19(v):
    x = v.nsi.filter(c("si").isNotNull()).groupBy("si").agg(F.max("length_nm").alias("length_nm"))
    p = v.spark.range(21).select(F.round(c("id") * 5 / 100.0, 2).alias("point"))
    return joins.value_at(p, "point", x, "si", "length_nm")


@query("j20_table_comparison", """a AS (SELECT regexp_replace(npil,'_[LR]$','') AS region, count(*) AS n FROM typed WHERE size<25 GROUP BY 1), b AS (SELECT regexp_replace(npil,'_[LR]$','') AS region, count(*) AS m FROM typed WHERE size>=25 GROUP BY 1)
SELECT a.region, n, m FROM a JOIN b ON a.region=b.region""")
def j20(v):
    t = v.typed.withColumn("region", expr.without_side(c("npil")))
    a = t.filter(c("size") < 25).groupBy("region").agg(F.count(lit(1)).alias("n"))
    b = t.filter(c("size") >= 25).groupBy("region").agg(F.count(lit(1)).alias("m"))
    return a.join(b, "region").dropna()

# ---- aggregations


@query("a1_group_count", "SELECT pre, comp, npil, count(*) AS n FROM comp GROUP BY ALL")
def a1(v):
    return v.comp.groupBy("pre", "comp", "npil").agg(F.count(lit(1)).alias("n"))


@query("a2_group_summary", """SELECT super_class, min(si) AS lo, max(si) AS hi, round(avg(si),6) AS mean, round(sum(si),6) AS total, count(si) AS n, round(stddev_samp(si),6) AS sd, round(median(si),6) AS mid, round(stddev_samp(si)/sqrt(count(si)),6) AS se FROM nsi GROUP BY 1""")
def a2(v):
    return v.nsi.groupBy("super_class").agg(F.min("si").alias("lo"), F.max("si").alias("hi"), r6(F.avg("si")).alias("mean"), r6(F.sum("si")).alias("total"), F.count("si").alias("n"),
                                            r6(F.stddev_samp("si")).alias("sd"), r6(F.median("si")).alias("mid"), r6(F.stddev_samp("si") / F.sqrt(F.count("si"))).alias("se"))


@query("a3_distinct_count", "SELECT pre, count(DISTINCT post) AS partners, count(DISTINCT npil) AS regions FROM syn GROUP BY pre")
def a3(v):
    # partners by an aggregation of distinct pairs, so that no set of a hub's partners sits in one row
    return v.syn.groupBy("pre").agg(F.count_distinct("post").alias("partners"), F.count_distinct("npil").alias("regions"))


@query("a4_pivot_types", "SELECT npil, " + ", ".join(f"count(*) FILTER (comp='{t}') AS \"{t}\"" for t in T4) + " FROM typed GROUP BY npil")
def a4(v):
    return v.typed.groupBy("npil").agg(*[F.count_if(c("comp") == t).alias(t) for t in T4])


@query("a5_presence_pivot", """SELECT n.primary_type, """ + ", ".join(f"(count(*) FILTER (side='{s}' AND comp='{t}') > 0)::INT AS {s}_{t.lower()}" for s in ("left", "right") for t in T4) + " FROM typed JOIN neurons n ON n.neuron=pre GROUP BY 1")
def a5(v):
    rows = v.typed.join(v.neurons.select(c("neuron").alias("pre"), "side", "primary_type"), "pre")
    return rows.groupBy("primary_type").agg(*[F.max(F.when((c("side") == s) & (c("comp") == t), 1).otherwise(0)).alias(f"{s}_{t.lower()}") for s in ("left", "right") for t in T4])


@query("a6_row_total", 'SELECT pre, post, "AA"+"AD"+"DA"+"DD" AS total FROM conn0')
def a6(v):
    return tables.type_counts(v.typed).select("pre", "post", reduce(lambda a, b: a + b, [F.coalesce(c(t), lit(0)) for t in T4]).alias("total"))


@query("a7_row_argmax", """SELECT pre, post, greatest("AA","AD","DA","DD") AS top, CASE greatest("AA","AD","DA","DD") WHEN "AA" THEN 'AA' WHEN "AD" THEN 'AD' WHEN "DA" THEN 'DA' ELSE 'DD' END AS top_type FROM conn0""")
def a7(v):
    return tables.type_counts(v.typed).select("pre", "post", F.greatest(*T4).alias("top"), expr.most_of(T4).alias("top_type"))


@query("a8_crosstab_percent", """SELECT region, """ + ", ".join(f"round(100.0*count(*) FILTER (comp='{t}')/count(*),6) AS \"{t}\"" for t in T4) + " FROM (SELECT *, regexp_replace(npil,'_[LR]$','') AS region FROM typed) GROUP BY region")
def a8(v):
    return v.typed.groupBy(expr.without_side(c("npil")).alias("region")).agg(*[r6(100.0 * F.count_if(c("comp") == t) / F.count(lit(1))).alias(t) for t in T4])


@query("a9_share", "SELECT comp, count(*) AS n, round(count(*)/sum(count(*)) OVER (),6) AS share FROM comp GROUP BY comp")
def a9(v):
    n = v.comp.groupBy("comp").agg(F.count(lit(1)).alias("n"))
    return n.withColumn("share", r6(c("n") / F.sum("n").over(Window.partitionBy())))


@query("a10_quadrant", "SELECT count(*) FILTER (reciprocal=1 AND same_type=1) AS rs, count(*) FILTER (reciprocal=1 AND same_type=0) AS ro, count(*) FILTER (reciprocal=0 AND same_type=1) AS us, count(*) FILTER (reciprocal=0 AND same_type=0) AS uo FROM conn")
def a10(v):
    q = lambda r, s: F.count_if((c("reciprocal") == r) & (c("same_type") == s))
    return v.conn.agg(q(1, 1).alias("rs"), q(1, 0).alias("ro"), q(0, 1).alias("us"), q(0, 0).alias("uo"))


def stacked(conn):
    """A row for each (connection, type) with its count."""
    return conn.select("*", F.explode(F.array(*[F.struct(lit(t).alias("syn_type"), c(t).alias("n")) for t in T4])).alias("s")).select(*conn.columns, "s.syn_type", "s.n")


STACK = "stack AS (" + " UNION ALL ".join(f"SELECT *, '{t}' AS syn_type, \"{t}\" AS n FROM conn" for t in T4) + ")"


@query("a11_conditional_mean", f"{STACK} SELECT syn_type, reciprocal, round(avg(n) FILTER (n>=1),6) AS mean, count(*) FILTER (n>=1) AS k FROM stack GROUP BY ALL")
def a11(v):
    return stacked(v.conn).groupBy("syn_type", "reciprocal").agg(r6(F.avg(F.when(c("n") >= 1, c("n")))).alias("mean"), F.count_if(c("n") >= 1).alias("k"))


@query("a12_quantiles", "SELECT super_class, " + ", ".join(f"round(quantile_cont(si,{q}),6) AS q{int(q*1000)}" for q in (0.025, 0.25, 0.5, 0.75, 0.975)) + " FROM nsi GROUP BY 1")
def a12(v):
    qs = (0.025, 0.25, 0.5, 0.75, 0.975)
    return quantiles(v.nsi, ["super_class"], "si", list(qs)).select("super_class", *[r6(c(f"q{i}")).alias(f"q{int(q * 1000)}") for i, q in enumerate(qs)])


@query("a13_group_transform", "SELECT neuron, primary_type, round(si - avg(si) OVER (PARTITION BY primary_type),6) AS dev, count(*) OVER (PARTITION BY primary_type) AS n FROM nsi")
def a13(v):
    w = Window.partitionBy("primary_type")
    return v.nsi.select("neuron", "primary_type", r6(c("si") - F.avg("si").over(w)).alias("dev"), F.count(lit(1)).over(w).alias("n"))


FEATURES = ["si", "length_nm", "area_nm", "size_nm", "leafs"]
PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]


@query("a14_correlations", " UNION ALL ".join(f"SELECT super_class, '{a}' AS a, '{b}' AS b, round(corr({a},{b}),6) AS r FROM nsi GROUP BY super_class" for a, b in PAIRS))
def a14(v):
    wide = v.nsi.groupBy("super_class").agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in PAIRS])
    rows = F.explode(F.array(*[F.struct(lit(a).alias("a"), lit(b).alias("b"), r6(c(f"{a}~{b}")).alias("r")) for a, b in PAIRS]))
    return wide.select("super_class", rows.alias("x")).select("super_class", "x.*")


@query("a15_count_of_counts", "x AS (SELECT sum_syn, count(*) AS n FROM conn0 GROUP BY sum_syn) SELECT sum_syn, n, round(sum(n) OVER (ORDER BY sum_syn)/sum(n) OVER (),6) AS cdf FROM x")
def a15(v):
    x = tables.type_counts(v.typed).groupBy("sum_syn").agg(F.count(lit(1)).alias("n"))
    return x.withColumn("cdf", r6(F.sum("n").over(Window.orderBy("sum_syn")) / F.sum("n").over(Window.partitionBy())))


@query("a16_mean_sd_se", "SELECT same_type, count(*) AS n, round(avg(sum_syn),6) AS mean, round(stddev_samp(sum_syn),6) AS sd, round(stddev_samp(sum_syn)/sqrt(count(*)),6) AS se FROM conn GROUP BY 1")
def a16(v):
    return v.conn.groupBy("same_type").agg(F.count(lit(1)).alias("n"), r6(F.avg("sum_syn")).alias("mean"), r6(F.stddev_samp("sum_syn")).alias("sd"), r6(F.stddev_samp("sum_syn") / F.sqrt(F.count(lit(1)))).alias("se"))


@query("a17_describe", " UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) AS n, round(avg({f}),6) AS mean, round(stddev_samp({f}),6) AS sd, round(min({f}),6) AS lo, round(quantile_cont({f},0.25),6) AS q1, round(median({f}),6) AS mid, round(quantile_cont({f},0.75),6) AS q3, round(max({f}),6) AS hi FROM nsi" for f in FEATURES))
def a17(v):
    def one(f):
        p = F.percentile(f, F.array(lit(0.25), lit(0.5), lit(0.75)))
        return F.struct(lit(f).alias("feature"), F.count(f).alias("n"), r6(F.avg(f)).alias("mean"), r6(F.stddev_samp(f)).alias("sd"), r6(F.min(f).cast("double")).alias("lo"),
                        r6(p[0]).alias("q1"), r6(p[1]).alias("mid"), r6(p[2]).alias("q3"), r6(F.max(f).cast("double")).alias("hi"))
    return v.nsi.agg(F.array(*[one(f) for f in FEATURES]).alias("all")).select(F.explode("all").alias("x")).select("x.*")


@query("a18_centroids", "SELECT pre AS neuron, post_compartment AS cluster, round(avg(pre_x),4) AS x, round(avg(pre_y),4) AS y, round(avg(pre_z),4) AS z FROM syn GROUP BY ALL")
def a18(v):
    return v.syn.groupBy(c("pre").alias("neuron"), c("post_compartment").alias("cluster")).agg(*[F.round(F.avg(f"pre_{a}"), 4).alias(a) for a in "xyz"])


@query("a19_data_quality", """SELECT (SELECT count(*) FROM nsi WHERE si IS NULL) AS null_si, (SELECT count(*) FROM nsi WHERE super_class IS NULL) AS null_class,
 (SELECT count(*) FROM syn_self) - (SELECT count(*) FROM (SELECT DISTINCT * FROM syn_self)) AS duplicate_rows, (SELECT count(*) FROM syn_self) - (SELECT count(*) FROM (SELECT DISTINCT pre, post, pre_x FROM syn_self)) AS duplicate_keys""")
def a19(v):
    nulls = v.nsi.agg(F.count_if(c("si").isNull()).alias("null_si"), F.count_if(c("super_class").isNull()).alias("null_class"))
    extra = lambda cols, name: v.syn_self.groupBy(*cols).count().agg(F.coalesce(F.sum(c("count") - 1), lit(0)).alias(name))
    return nulls.crossJoin(extra(v.syn_self.columns, "duplicate_rows")).crossJoin(extra(["pre", "post", "pre_x"], "duplicate_keys"))  # one row each


@query("a20_deduplicate", "SELECT DISTINCT pre, post, comp FROM comp")
def a20(v):
    return v.comp.select("pre", "post", "comp").dropDuplicates(["pre", "post", "comp"])

# ---- windows


@query("w1_trailing_mean", """x AS (SELECT si, avg(ax_pre/(ax_pre+ax_post)) AS y FROM si WHERE si IS NOT NULL AND ax_pre+ax_post>0 GROUP BY si)
SELECT si, round(CASE WHEN row_number() OVER (ORDER BY si) >= 50 THEN avg(y) OVER (ORDER BY si ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END,6) AS rolling FROM x""")
def w1(v):
    y = c("ax_pre") / (c("ax_pre") + c("ax_post"))
    x = v.si.filter(c("si").isNotNull() & (c("ax_pre") + c("ax_post") > 0)).groupBy("si").agg(F.avg(y).alias("y"))
    x = numbered(x, F.floor(c("si") * 100), [c("si")], "place")
    return rolling_mean(x, "y", "place", 50, 256).select("si", r6(c("rolling")).alias("rolling"))


#: Places of the widest centred window.
BAND = 400


@query("w2_centred_band", f"""x AS (SELECT super_class, neuron, si, length_nm, row_number() OVER (PARTITION BY super_class ORDER BY length_nm, neuron) AS i, count(*) OVER (PARTITION BY super_class) AS n FROM nsi WHERE si IS NOT NULL AND super_class IS NOT NULL),
w AS (SELECT *, greatest(3, least(floor(n/30), {BAND}))::BIGINT AS w FROM x), o AS (SELECT *, w - 1 - (w-1)//2 AS back, (w-1)//2 AS ahead FROM w),
r AS (SELECT a.super_class, a.neuron, a.i, avg(b.si) AS m, stddev_samp(b.si) AS s, 1.96*stddev_samp(b.si)/sqrt(any_value(a.w)) AS half
FROM o a JOIN o b ON a.super_class=b.super_class AND b.i BETWEEN a.i-a.back AND a.i+a.ahead GROUP BY a.super_class, a.neuron, a.i HAVING count(*) = any_value(a.w)),
t AS (SELECT *, CASE WHEN count(*) OVER three = 3 THEN avg(half) OVER three END AS band FROM r WINDOW three AS (PARTITION BY super_class ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT super_class, neuron, round(m,6) AS mean, round(s,6) AS sd, round(m-band,6) AS low, round(m+band,6) AS high FROM t""")
def w2(v):
    """Mean, deviation and 95 % band of a centred window per class: a thirtieth of its rows, 3 at least and BAND at most; the band's width is the mean of those of a
    row and its neighbours, null at the ends.  A window's sums are differences of two running sums."""
    x = v.nsi.filter(c("si").isNotNull() & c("super_class").isNotNull()).select("super_class", "neuron", "si", "length_nm")
    n = x.groupBy("super_class").agg(F.count(lit(1)).alias("n"), F.avg("si").alias("mid"))  # a row a class
    x = x.join(F.broadcast(n), "super_class").withColumn("d", c("si") - c("mid"))
    x = running(x, ["super_class"], ["length_nm", "neuron"], {"i": lit(1).cast("bigint"), "s": c("d"), "q": c("d") * c("d")})
    w = F.greatest(lit(3), F.least(F.floor(c("n") / 30), lit(BAND)))
    x = x.withColumn("w", w).withColumn("ahead", F.floor((c("w") - 1) / 2)).withColumn("back", c("w") - 1 - c("ahead"))
    x = x.select("super_class", "neuron", "i", "n", "mid", "w", "ahead", "back", "s", "q", "d")
    low = x.select(c("super_class").alias("k1"), c("i").alias("i1"), c("s").alias("s1"), c("q").alias("q1"))
    high = x.select(c("super_class").alias("k2"), c("i").alias("i2"), (c("s") + c("d")).alias("s2"), (c("q") + c("d") * c("d")).alias("q2"))
    full = x.filter((c("i") >= c("back")) & (c("i") + c("ahead") < c("n"))).drop("s", "q", "d")
    full = full.join(low, (c("super_class") == c("k1")) & (c("i") - c("back") == c("i1"))).join(high, (c("super_class") == c("k2")) & (c("i") + c("ahead") == c("i2")))
    s, q = c("s2") - c("s1"), c("q2") - c("q1")
    full = full.select("super_class", "neuron", "i", "w", (c("mid") + s / c("w")).alias("m"), F.sqrt(F.greatest(lit(0.0), q - s * s / c("w")) / (c("w") - 1)).alias("s"))
    # each row's width goes to its own place and to those beside it
    to = F.explode(F.array(*[lit(k) for k in (-1, 0, 1)]))
    near = full.withColumn("half", 1.96 * c("s") / F.sqrt("w")).withColumn("to", to)
    own = lambda x: F.max(F.when(c("to") == 0, c(x))).alias(x)
    out = near.groupBy("super_class", (c("i") + c("to")).alias("i")).agg(own("neuron"), own("m"), own("s"), F.when(F.count(lit(1)) == 3, F.avg("half")).alias("band")).filter(c("m").isNotNull())
    return out.select("super_class", "neuron", r6(c("m")).alias("mean"), r6(c("s")).alias("sd"), r6(c("m") - c("band")).alias("low"), r6(c("m") + c("band")).alias("high"))


@query("w3_ecdf", "SELECT super_class, neuron, si, round(row_number() OVER (PARTITION BY super_class ORDER BY si, neuron)/count(*) OVER (PARTITION BY super_class),6) AS ecdf, round(sum(si) OVER (PARTITION BY super_class ORDER BY si, neuron),6) AS running FROM nsi WHERE si IS NOT NULL")
def w3(v):
    x = v.nsi.filter(c("si").isNotNull()).select("super_class", "neuron", "si")
    n = x.groupBy("super_class").agg(F.count(lit(1)).alias("n")).withColumnRenamed("super_class", "__class")  # a row a class
    x = running(x, ["super_class"], ["si", "neuron"], {"before": lit(1), "ahead": c("si")}).join(F.broadcast(n), c("super_class").eqNullSafe(c("__class")))
    return x.select("super_class", "neuron", "si", r6((c("before") + 1) / c("n")).alias("ecdf"), r6(c("ahead") + c("si")).alias("running"))


@query("w4_dense_ids", "SELECT pre AS neuron, npil, dense_rank() OVER (PARTITION BY pre ORDER BY npil) - 1 AS cluster FROM (SELECT DISTINCT pre, npil FROM syn)")
def w4(v):
    x = v.syn.select(c("pre").alias("neuron"), "npil").distinct()
    return x.withColumn("cluster", (F.dense_rank().over(Window.partitionBy("neuron").orderBy("npil")) - 1).cast("bigint"))


@query("w5_tied_ranks", "SELECT neuron, leafs, rank() OVER (ORDER BY leafs) + (count(*) OVER (PARTITION BY leafs) - 1)/2 AS tied_rank FROM neurons WHERE leafs IS NOT NULL")
def w5(v):
    return tied_ranks(v.neurons.filter(c("leafs").isNotNull()), "leafs").select("neuron", "leafs", "tied_rank")

# ---- sorts, limits, top-k


@query("so1_sorted", "SELECT npil, comp, count(*) AS n FROM comp GROUP BY ALL ORDER BY n DESC, npil, comp")
def so1(v):
    return v.comp.groupBy("npil", "comp").agg(F.count(lit(1)).alias("n")).orderBy(c("n").desc(), "npil", "comp")


@query("so2_custom_order", "SELECT super_class, count(*) AS n, CASE super_class WHEN 'sensory' THEN 0 WHEN 'optic' THEN 1 WHEN 'visual_projection' THEN 2 WHEN 'visual_centrifugal' THEN 3 WHEN 'central' THEN 4 END AS place FROM neurons GROUP BY 1")
def so2(v):
    order = ["sensory", "optic", "visual_projection", "visual_centrifugal", "central"]
    place = reduce(lambda a, x: a.when(c("super_class") == x[1], x[0]), enumerate(order[1:], 1), F.when(c("super_class") == order[0], 0))
    return v.neurons.groupBy("super_class").agg(F.count(lit(1)).alias("n")).withColumn("place", place).orderBy("place")


@query("so3_head", "SELECT pre, post, sum_syn FROM conn0 ORDER BY sum_syn DESC, pre, post LIMIT 50")
def so3(v):
    return tables.type_counts(v.typed).select("pre", "post", "sum_syn").orderBy(c("sum_syn").desc(), "pre", "post").limit(50)


@query("so4_ranked_by_size", "x AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, corr(si,{f}) AS r FROM nsi" for f in FEATURES[1:]) + ") SELECT feature, round(r,6) AS r, row_number() OVER (ORDER BY abs(r) DESC) AS place FROM x")
def so4(v):
    x = v.nsi.agg(*[F.corr("si", f).alias(f) for f in FEATURES[1:]])
    x = x.select(F.explode(F.array(*[F.struct(lit(f).alias("feature"), c(f).alias("r")) for f in FEATURES[1:]])).alias("x")).select("x.*")
    return x.select("feature", r6(c("r")).alias("r"), F.row_number().over(Window.orderBy(F.abs("r").desc())).alias("place"))

# ---- sets and reshaping


@query("se1_union_all", "SELECT neuron, other, count(*) AS n FROM (SELECT pre AS neuron, post AS other FROM syn UNION ALL SELECT post, pre FROM syn) GROUP BY ALL")
def se1(v):
    a = v.syn.select(c("pre").alias("neuron"), c("post").alias("other"))
    return a.unionByName(v.syn.select(c("post").alias("neuron"), c("pre").alias("other"))).groupBy("neuron", "other").agg(F.count(lit(1)).alias("n"))


@query("se2_distinct_ids", "SELECT pre AS neuron FROM syn UNION SELECT post FROM syn")
def se2(v):
    return v.syn.select(F.explode(F.array("pre", "post")).alias("neuron")).distinct()


@query("se3_complement", "SELECT pre, post FROM conn0 EXCEPT SELECT post, pre FROM conn0")
def se3(v):
    e = tables.type_counts(v.typed).select("pre", "post")
    return e.join(e.select(c("post").alias("pre"), c("pre").alias("post")), ["pre", "post"], "left_anti")


@query("se4_melt", "SELECT neuron, feature, value FROM (SELECT neuron, length_nm, area_nm, size_nm FROM neurons) UNPIVOT INCLUDE NULLS (value FOR feature IN (length_nm, area_nm, size_nm))")
def se4(v):
    return v.neurons.unpivot(["neuron"], ["length_nm", "area_nm", "size_nm"], "feature", "value")


@query("se5_side_pivot", "SELECT primary_type, round(avg(si) FILTER (side='left'),6) AS \"left\", round(avg(si) FILTER (side='right'),6) AS \"right\" FROM nsi GROUP BY 1")
def se5(v):
    return v.nsi.groupBy("primary_type").pivot("side", ["left", "right"]).agg(F.avg("si")).select("primary_type", r6(c("left")).alias("left"), r6(c("right")).alias("right"))


@query("se6_lower_triangle", """p AS (SELECT a.pre, a.post, CASE greatest(a."AA",a."AD",a."DA",a."DD") WHEN a."AA" THEN 0 WHEN a."AD" THEN 1 WHEN a."DA" THEN 2 ELSE 3 END AS i, CASE greatest(b."AA",b."AD",b."DA",b."DD") WHEN b."AA" THEN 0 WHEN b."AD" THEN 1 WHEN b."DA" THEN 2 ELSE 3 END AS j
 FROM conn0 a JOIN conn0 b ON a.pre=b.post AND a.post=b.pre WHERE a.pre<a.post) SELECT count(*) FILTER (i>=j) AS lower_part, count(*) FILTER (i<j) AS upper_part, count(*) AS n FROM p""")
def se6(v):
    e = tables.type_counts(v.typed).withColumn("top", expr.most_of(T4))
    p = tables.reciprocal_pairs(e, ["top"])
    place = lambda x: reduce(lambda a, t: a.when(c(x) == t[1], t[0]), enumerate(T4[1:], 1), F.when(c(x) == T4[0], 0))
    i, j = place("top_ab"), place("top_ba")
    return p.agg(F.count_if(i >= j).alias("lower_part"), F.count_if(i < j).alias("upper_part"), F.count(lit(1)).alias("n"))

# ---- bins


@query("b1_equal_width", """x AS (SELECT si, length_nm, min(si) OVER () AS lo, (max(si) OVER () - min(si) OVER ())/100 AS h FROM nsi WHERE si IS NOT NULL)
SELECT least(greatest(ceil((si-lo)/h)-1,0),99)::INT AS bin, count(*) AS n, round(avg(length_nm),6) AS mean, round(stddev_samp(length_nm),6) AS sd, round(any_value(lo+h*(least(greatest(ceil((si-lo)/h)-1,0),99)+0.5)),6) AS mid FROM x GROUP BY 1""")
def b1(v):
    x = v.nsi.filter(c("si").isNotNull())
    x = x.crossJoin(F.broadcast(x.agg(F.min("si").alias("lo"), ((F.max("si") - F.min("si")) / 100).alias("h"))))  # one row
    x = x.withColumn("bin", expr.bin_right(c("si"), c("lo"), c("h"), 100))
    return x.groupBy("bin").agg(F.count(lit(1)).alias("n"), r6(F.avg("length_nm")).alias("mean"), r6(F.stddev_samp("length_nm")).alias("sd"), r6(F.max(c("lo") + c("h") * (c("bin") + 0.5))).alias("mid"))


@query("b2_fixed_edges", "SELECT least(greatest(ceil(si*20)-1,0),19)::INT AS bin, round(avg(si),6) AS mean, round(avg(length_nm),6) AS other, count(*) AS n FROM nsi WHERE si IS NOT NULL GROUP BY 1")
def b2(v):
    return v.nsi.filter(c("si").isNotNull()).groupBy(F.least(F.greatest(F.ceil(c("si") * 20) - 1, lit(0)), lit(19)).cast("int").alias("bin")).agg(
        r6(F.avg("si")).alias("mean"), r6(F.avg("length_nm")).alias("other"), F.count(lit(1)).alias("n"))


@query("b3_digitize", "x AS (SELECT length_nm, min(length_nm) OVER () AS lo, (max(length_nm) OVER () - min(length_nm) OVER ())/40 AS h FROM neurons WHERE length_nm IS NOT NULL) SELECT (floor((length_nm-lo)/h)+1)::INT AS bin, count(*) AS n FROM x GROUP BY 1")
def b3(v):
    x = v.neurons.filter(c("length_nm").isNotNull())
    x = x.crossJoin(F.broadcast(x.agg(F.min("length_nm").alias("lo"), ((F.max("length_nm") - F.min("length_nm")) / 40).alias("h"))))
    return x.groupBy((F.floor((c("length_nm") - c("lo")) / c("h")) + 1).cast("int").alias("bin")).agg(F.count(lit(1)).alias("n"))


#: Rules of a histogram's width, by the number of bins: Freedman-Diaconis rounded up, cut off, the square root of n, ten.
RULES = {"fd_up": ("ceil((hi-lo)/(2*iqr/cbrt(n)))", F.ceil), "fd_cut": ("floor((hi-lo)/(2*iqr/cbrt(n)))", F.floor), "sqrt": ("floor(sqrt(n))", None), "ten": ("10", None)}


@query("b4_histogram", f"""q AS (SELECT min(si) AS lo, max(si) AS hi, count(si) AS n, quantile_cont(si,0.75)-quantile_cont(si,0.25) AS iqr FROM nsi), w AS ({" UNION ALL ".join(f"SELECT '{k}' AS rule, *, greatest(1, {sql})::INT AS bins FROM q" for k, (sql, _) in RULES.items())}),
x AS (SELECT rule, least(floor((si-lo)/((hi-lo)/bins)),bins-1)::INT AS bin, bins, n, (hi-lo)/bins AS h FROM nsi, w WHERE si IS NOT NULL)
SELECT rule, bin, any_value(bins) AS bins, count(*) AS k, round(count(*)/(any_value(n)*any_value(h)),6) AS density, round(count(*)/any_value(n),6) AS share FROM x GROUP BY rule, bin""")
def b4(v):
    q = v.nsi.agg(F.min("si").alias("lo"), F.max("si").alias("hi"), F.count("si").alias("n")).crossJoin(F.broadcast(quantiles(v.nsi, [], "si", [0.25, 0.75])))  # one row each
    width = 2 * (c("q1") - c("q0")) / F.cbrt("n")
    bins = {"sqrt": F.floor(F.sqrt("n")), "ten": lit(10)} | {k: f(F.try_divide(c("hi") - c("lo"), width)) for k, (_, f) in RULES.items() if f}
    each = F.explode(F.array(*[F.struct(lit(k).alias("rule"), F.greatest(b.cast("int"), lit(1)).alias("bins")) for k, b in bins.items()]))
    q = q.select("lo", "hi", "n", each.alias("e")).select("lo", "hi", "n", "e.*").withColumn("h", (c("hi") - c("lo")) / c("bins"))
    x = v.nsi.filter(c("si").isNotNull()).select("si").crossJoin(F.broadcast(q))  # four rows
    x = x.withColumn("bin", expr.bin_left(c("si"), c("lo"), c("h"), c("bins")))
    return x.groupBy("rule", "bin").agg(F.max("bins").alias("bins"), F.count(lit(1)).alias("k"), r6(F.count(lit(1)) / F.max(c("n") * c("h"))).alias("density"), r6(F.count(lit(1)) / F.max("n")).alias("share"))


@query("b5_calibration", "SELECT trunc(si*50)::INT AS bin, count(*) AS n, round(avg(si),6) AS predicted, round(avg(ax_pre/(ax_pre+ax_post)),6) AS seen FROM si WHERE si IS NOT NULL AND ax_pre+ax_post>0 GROUP BY 1")
def b5(v):
    return v.si.filter(c("si").isNotNull() & (c("ax_pre") + c("ax_post") > 0)).groupBy((c("si") * 50).cast("int").alias("bin")).agg(
        F.count(lit(1)).alias("n"), r6(F.avg("si")).alias("predicted"), r6(F.avg(c("ax_pre") / (c("ax_pre") + c("ax_post")))).alias("seen"))
