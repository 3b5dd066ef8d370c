"""Queries of the domain measures and derived tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from arborix.functions import expr
from arborix.functions.ranks import running
from arborix.functions.windows import rolling_mean
from arborix.operators import joins, tables
from arborix.plans.basic import INTRINSIC, STACK, T4, stacked
from arborix.plans.registry import query

c, lit = F.col, F.lit


def n_():
    return F.count(lit(1))


r6 = lambda x: F.round(x, 6)
pct = lambda t: F.count_if(c("comp") == t)


@query("d1_entropy", "SELECT neuron, ax_pre, ax_post, round(e_ax,6) AS e_ax, round(e_de,6) AS e_de, round(e_all,6) AS e_all FROM ent")
def d1(v):
    e = lambda a, b: r6(expr.entropy(a, b))
    return v.si.select("neuron", "ax_pre", "ax_post", e(c("ax_pre"), c("ax_post")).alias("e_ax"), e(c("de_pre"), c("de_post")).alias("e_de"),
                       e(c("ax_pre") + c("de_pre"), c("ax_post") + c("de_post")).alias("e_all"))


@query("d2_segregation_index", "SELECT neuron, ax_pre, ax_post, de_pre, de_post, round(si,6) AS si, round(ig,6) AS ig FROM si")
def d2(v):
    return v.si.withColumn("si", r6(c("si"))).withColumn("ig", r6(c("ig")))


@query("d3_master_table", "SELECT pre, post, comp, npil, pre_x, post_x, round(si_pre,6) AS si_pre, round(si_post,6) AS si_post FROM master")
def d3(v):
    return v.master.select("pre", "post", "comp", "npil", "pre_x", "post_x", r6(c("si_pre")).alias("si_pre"), r6(c("si_post")).alias("si_post"))


TALLY = """tally AS (SELECT neuron, """ + ", ".join(f"count(*) FILTER (role='{r}' AND k='{k}') AS {r}_{k.lower()}" for r in ("pre", "post") for k in "ADL") + """
 FROM (SELECT pre AS neuron, 'pre' AS role, pre_compartment AS k FROM syn UNION ALL SELECT post, 'post', post_compartment FROM syn) GROUP BY neuron)"""


def tally(v):
    t = tables.tallies(v.syn)
    return t.select("neuron", *[c(f"{r}_{k}").alias(f"{r}_{k.lower()}") for r in ("pre", "post") for k in "ADL"])


@query("d4_tallies", f"{TALLY} SELECT * FROM tally")
def d4(v):
    return tally(v)


CORRECT = f"""{TALLY}, correct AS (SELECT neuron, CASE WHEN pre_a+post_a>0 THEN round(pre_a/(pre_a+post_a),6) END AS axon_correct, CASE WHEN pre_d+post_d>0 THEN round(post_d/(pre_d+post_d),6) END AS dend_correct,
 CASE WHEN pre_a+post_a+pre_d+post_d>0 THEN round((pre_a+post_d)/(pre_a+post_a+pre_d+post_d),6) END AS correct_pos FROM tally)"""


def correct(v):
    a, d = c("pre_a") + c("post_a"), c("pre_d") + c("post_d")
    return tally(v).select("neuron", r6(expr.ratio(c("pre_a"), a)).alias("axon_correct"), r6(expr.ratio(c("post_d"), d)).alias("dend_correct"),
                           r6(expr.ratio(c("pre_a") + c("post_d"), a + d)).alias("correct_pos"))


@query("d5_correctness", f"{CORRECT} SELECT * FROM correct")
def d5(v):
    return correct(v)


DEGREE = """deg AS (SELECT pre, post, count(*) AS degree FROM syn GROUP BY ALL),
o AS (SELECT pre AS neuron, sum(degree)::BIGINT AS out_synapses, count(*) AS out_partners, max(degree) AS max_out_degree, avg(degree) AS mean_out_degree FROM deg GROUP BY pre),
i AS (SELECT post AS neuron, sum(degree)::BIGINT AS in_synapses, count(*) AS in_partners, max(degree) AS max_in_degree, avg(degree) AS mean_in_degree FROM deg GROUP BY post),
degrees AS (SELECT coalesce(o.neuron,i.neuron) AS neuron, out_synapses, out_partners, max_out_degree, mean_out_degree, in_synapses, in_partners, max_in_degree, mean_in_degree FROM o FULL JOIN i ON o.neuron=i.neuron)"""


@query("d6_degrees", DEGREE + """ SELECT neuron, out_synapses, in_synapses, out_partners, in_partners, max_out_degree, max_in_degree, round(mean_out_degree,6) AS mean_out_degree, round(mean_in_degree,6) AS mean_in_degree,
 round(in_partners/out_partners,6) AS partners_ratio, round(max_in_degree/max_out_degree,6) AS max_degree_ratio, round(mean_in_degree/mean_out_degree,6) AS mean_degree_ratio,
 round(mean_out_degree/out_partners,6) AS mean_out_per_partner, round(mean_in_degree/in_partners,6) AS mean_in_per_partner, round((mean_in_degree/in_partners)/(mean_out_degree/out_partners),6) AS per_partner_ratio FROM degrees""")
def d6(v):
    d = tables.degrees(v.syn)
    return d.select(*[r6(c(x)).alias(x) if t == "double" else c(x) for x, t in d.dtypes])


@query("d7_neuron_table", f"""{DEGREE}, {CORRECT} SELECT n.neuron, super_class, primary_type, nt_type, side, length_nm, size_nm, round(n.si,6) AS si, axon_correct, dend_correct, out_partners, in_partners,
 (coalesce(post_l,0)+coalesce(pre_l,0)>0)::INT AS linker, round(k.layer,6) AS layer
 FROM nsi n LEFT JOIN correct c ON c.neuron=n.neuron LEFT JOIN degrees d ON d.neuron=n.neuron LEFT JOIN tally t ON t.neuron=n.neuron
 LEFT JOIN (SELECT o_custkey % (SELECT k FROM k) AS neuron, avg(o_totalprice) AS layer FROM orders GROUP BY 1) k ON k.neuron=n.neuron""")
def d7(v):
    layer = v.table("orders").groupBy((c("o_custkey") % v.k).alias("neuron")).agg(r6(F.avg("o_totalprice")).alias("layer"))
    links = tally(v).select("neuron", (c("post_l") + c("pre_l") > 0).cast("int").alias("linker"))
    out = v.nsi.join(correct(v), "neuron", "left").join(tables.degrees(v.syn).select("neuron", "out_partners", "in_partners"), "neuron", "left")
    out = out.join(links, "neuron", "left").join(layer, "neuron", "left")
    return out.select("neuron", "super_class", "primary_type", "nt_type", "side", "length_nm", "size_nm", r6(c("si")).alias("si"), "axon_correct", "dend_correct",
                      "out_partners", "in_partners", F.coalesce("linker", lit(0)).alias("linker"), "layer")


@query("d8_connections", "SELECT * FROM conn")
def d8(v):
    return v.conn


@query("d9_reciprocity_list", "SELECT a.pre AS a, a.post AS b, a.sum_syn + b.sum_syn AS total FROM conn0 a JOIN conn0 b ON a.pre=b.post AND a.post=b.pre WHERE a.pre < a.post")
def d9(v):
    return tables.reciprocal_pairs(tables.type_counts(v.typed), ["sum_syn"]).select("a", "b", (c("sum_syn_ab") + c("sum_syn_ba")).alias("total"))


@query("d10_reciprocal_pairs", "SELECT a.pre AS a, a.post AS b, " + ", ".join(f"a.\"{t}\" AS {t.lower()}_ab, b.\"{t}\" AS {t.lower()}_ba" for t in T4) + """,
 a.sum_syn AS dim_ab, b.sum_syn AS dim_ba, x.primary_type AS type_a, y.primary_type AS type_b, round(x.si,6) AS si_a, round(y.si,6) AS si_b
 FROM conn0 a JOIN conn0 b ON a.pre=b.post AND a.post=b.pre LEFT JOIN nsi x ON x.neuron=a.pre LEFT JOIN nsi y ON y.neuron=a.post WHERE a.pre < a.post""")
def d10(v):
    p = tables.reciprocal_pairs(tables.type_counts(v.typed), [*T4, "sum_syn"])
    for end in "ab":
        side = v.nsi.select(c("neuron").alias(end), c("primary_type").alias(f"type_{end}"), r6(c("si")).alias(f"si_{end}"))
        p = p.join(side, end, "left")
    return p.select("a", "b", *[c(f"{t}_{d}").alias(f"{t.lower()}_{d}") for t in T4 for d in ("ab", "ba")], c("sum_syn_ab").alias("dim_ab"), c("sum_syn_ba").alias("dim_ba"),
                    "type_a", "type_b", "si_a", "si_b")


FRACTION = """twoway AS (SELECT pre AS neuron, post AS other, sum_syn, reciprocal FROM conn UNION ALL SELECT post, pre, sum_syn, reciprocal FROM conn),
f0 AS (SELECT neuron, count(DISTINCT other) AS total_partners, sum(sum_syn)::BIGINT AS total_synapses, count(DISTINCT other) FILTER (reciprocal=1) AS reciprocal_partners,
 coalesce(sum(sum_syn) FILTER (reciprocal=1),0)::BIGINT AS reciprocal_synapses FROM twoway GROUP BY neuron),
f1 AS (SELECT *, total_partners-reciprocal_partners AS non_reciprocal_partners, total_synapses-reciprocal_synapses AS non_reciprocal_synapses FROM f0),
f2 AS (SELECT *, CASE WHEN non_reciprocal_partners>0 THEN non_reciprocal_synapses/non_reciprocal_partners END AS non_reciprocal_ratio, CASE WHEN reciprocal_partners>0 THEN reciprocal_synapses/reciprocal_partners END AS rr, reciprocal_partners/total_partners AS ratio FROM f1),
fraction AS (SELECT * EXCLUDE (rr), rr/2 AS reciprocal_ratio, CASE WHEN non_reciprocal_ratio>0 THEN rr/non_reciprocal_ratio END AS ratio_syn FROM f2)"""


@query("d11_reciprocity_fraction", FRACTION + """ SELECT neuron, total_partners, total_synapses, reciprocal_partners, reciprocal_synapses, non_reciprocal_partners, non_reciprocal_synapses,
 round(non_reciprocal_ratio,6) AS non_reciprocal_ratio, round(reciprocal_ratio,6) AS reciprocal_ratio, round(ratio,6) AS ratio, round(ratio_syn,6) AS ratio_syn FROM fraction WHERE non_reciprocal_ratio IS NOT NULL AND ratio_syn IS NOT NULL AND reciprocal_ratio IS NOT NULL""")
def d11(v):
    f = tables.reciprocity_fraction(v.conn).dropna()
    return f.select(*[r6(c(x)).alias(x) if t == "double" else c(x) for x, t in f.dtypes])


@query("d12_symmetric_ratio", FRACTION + """ SELECT n.super_class, round(avg((reciprocal_ratio-non_reciprocal_ratio)/(reciprocal_ratio+non_reciprocal_ratio)),6) AS symmetric, round(median(reciprocal_ratio/non_reciprocal_ratio),6) AS mid, count(*) AS n
 FROM fraction f JOIN neurons n ON n.neuron=f.neuron WHERE reciprocal_ratio IS NOT NULL AND non_reciprocal_ratio IS NOT NULL GROUP BY 1""")
def d12(v):
    f = tables.reciprocity_fraction(v.conn).dropna(subset=["reciprocal_ratio", "non_reciprocal_ratio"]).join(v.neurons.select("neuron", "super_class"), "neuron")
    r, q = c("reciprocal_ratio"), c("non_reciprocal_ratio")
    return f.groupBy("super_class").agg(r6(F.avg((r - q) / (r + q))).alias("symmetric"), r6(F.median(r / q)).alias("mid"), n_().alias("n"))


TYPE_SI = "tsi AS (SELECT primary_type, avg(si) AS type_si FROM nsi GROUP BY 1)"


def type_si(v):
    return v.nsi.groupBy("primary_type").agg(F.avg("si").alias("type_si"))


@query("d13_same_type_share", f"""{TYPE_SI} SELECT t.comp, round(avg((a.primary_type=b.primary_type)::INT),6) AS share, count(*) AS n FROM typed t
 JOIN neurons a ON a.neuron=t.pre JOIN neurons b ON b.neuron=t.post JOIN tsi x ON x.primary_type=a.primary_type JOIN tsi y ON y.primary_type=b.primary_type WHERE x.type_si >= 0.1 AND y.type_si >= 0.1 GROUP BY 1""")
def d13(v):
    good = type_si(v).filter(c("type_si") >= 0.1).select("primary_type")
    rows = tables.with_roles(v.typed, v.neurons.join(good, "primary_type"), ["primary_type"], "inner")
    return rows.groupBy("comp").agg(r6(F.avg((c("primary_type_pre") == c("primary_type_post")).cast("int"))).alias("share"), n_().alias("n"))


@query("d14_side_occurrence", """r AS (SELECT a.primary_type AS t, (a.side=b.side)::INT AS ipsi, (a.primary_type=b.primary_type)::INT AS same, s.comp FROM typed s JOIN neurons a ON a.neuron=s.pre JOIN neurons b ON b.neuron=s.post WHERE a.side<>'center' AND b.side<>'center'),
p AS (SELECT t, ipsi, same, max((comp='AD')::INT) AS ad, max((comp<>'AD')::INT) AS other FROM r GROUP BY ALL), n AS (SELECT count(DISTINCT t) AS n FROM r)
SELECT ipsi, same, round(sum(ad)/any_value(n),6) AS any_ad, round(sum(other)/any_value(n),6) AS any_other FROM p, n GROUP BY ALL""")
def d14(v):
    rows = tables.with_roles(v.typed, v.neurons, ["primary_type", "side"], "inner").filter((c("side_pre") != "center") & (c("side_post") != "center"))
    rows = rows.select(c("primary_type_pre").alias("t"), (c("side_pre") == c("side_post")).cast("int").alias("ipsi"), (c("primary_type_pre") == c("primary_type_post")).cast("int").alias("same"), "comp")
    p = rows.groupBy("t", "ipsi", "same").agg(F.max((c("comp") == "AD").cast("int")).alias("ad"), F.max((c("comp") != "AD").cast("int")).alias("other"))
    n = F.broadcast(rows.agg(F.count_distinct("t").alias("n")))  # one row
    return p.crossJoin(n).groupBy("ipsi", "same").agg(r6(F.sum("ad") / F.max("n")).alias("any_ad"), r6(F.sum("other") / F.max("n")).alias("any_other"))


@query("d15_cooccurrence", " UNION ALL ".join(f"SELECT '{a}' AS given, '{b}' AS other, round(count(*) FILTER (\"{a}\">=1 AND \"{b}\">=1)/count(*) FILTER (\"{a}\">=1),6) AS p, count(*) FILTER (\"{a}\">=1) AS n FROM conn0" for a in T4 for b in T4))
def d15(v):
    e = tables.type_counts(v.typed)
    both = lambda a, b: F.count_if((c(a) >= 1) & (c(b) >= 1))
    cells = [F.struct(lit(a).alias("given"), lit(b).alias("other"), r6(both(a, b) / F.count_if(c(a) >= 1)).alias("p"), F.count_if(c(a) >= 1).alias("n")) for a in T4 for b in T4]
    return e.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@query("d16_mean_composition", " UNION ALL ".join(f"SELECT '{a}' AS given, " + ", ".join(f"round(avg(\"{b}\"/sum_syn),6) AS \"{b}\"" for b in T4) + f" FROM conn0 WHERE \"{a}\">=1" for a in T4))
def d16(v):
    e = tables.type_counts(v.typed)
    rows = [F.struct(lit(a).alias("given"), *[r6(F.avg(F.when(c(a) >= 1, c(b) / c("sum_syn")))).alias(b) for b in T4]) for a in T4]
    return e.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@query("d17_purity", " UNION ALL ".join(f"SELECT '{a}' AS syn_type, count(*) FILTER (\"{a}\"=sum_syn) AS pure, count(*) FILTER (\"{a}\">0) AS n, round(count(*) FILTER (\"{a}\"=sum_syn)/count(*) FILTER (\"{a}\">0),6) AS share FROM conn0" for a in T4))
def d17(v):
    pure, some = (lambda a: F.count_if(c(a) == c("sum_syn"))), (lambda a: F.count_if(c(a) > 0))
    rows = [F.struct(lit(a).alias("syn_type"), pure(a).alias("pure"), some(a).alias("n"), r6(pure(a) / some(a)).alias("share")) for a in T4]
    return tables.type_counts(v.typed).agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@query("d18_strength_same_type", f"{STACK} SELECT syn_type, same_type, count(*) AS n, round(avg(n),6) AS mean, round(stddev_samp(n)/sqrt(count(*)),6) AS se FROM stack WHERE n>=1 GROUP BY ALL")
def d18(v):
    return stacked(v.conn).filter(c("n") >= 1).groupBy("syn_type", "same_type").agg(n_().alias("n"), r6(F.avg("n")).alias("mean"), r6(F.stddev_samp("n") / F.sqrt(n_())).alias("se"))


@query("d19_strength_reciprocal", f"{STACK} SELECT syn_type, reciprocal, same_type, count(*) AS n, round(avg(n),6) AS mean FROM stack WHERE n>=1 GROUP BY ALL")
def d19(v):
    return stacked(v.conn).filter(c("n") >= 1).groupBy("syn_type", "reciprocal", "same_type").agg(n_().alias("n"), r6(F.avg("n")).alias("mean"))


def _dom(p: str) -> str:
    return f"CASE WHEN 2*{p}.\"AA\">{p}.sum_syn THEN 'AA' WHEN 2*{p}.\"AD\">{p}.sum_syn THEN 'AD' WHEN 2*{p}.\"DA\">{p}.sum_syn THEN 'DA' WHEN 2*{p}.\"DD\">{p}.sum_syn THEN 'DD' END"


DOMINANT = f"""dom AS (SELECT a.pre AS x, a.post AS y, {_dom('a')} AS ab, {_dom('b')} AS ba, a.same_type FROM conn a JOIN conn b ON a.pre=b.post AND a.post=b.pre WHERE a.pre<a.post)"""


def dominant(v):
    """Reciprocal pairs with the type that has over half of each direction, null if none has."""
    top = reduce(lambda e, t: e.when(2 * c(t) > c("sum_syn"), t), T4[1:], F.when(2 * c(T4[0]) > c("sum_syn"), T4[0]))
    p = tables.reciprocal_pairs(v.conn.withColumn("top", top), ["top", "same_type"])
    return p.select(c("a").alias("x"), c("b").alias("y"), c("top_ab").alias("ab"), c("top_ba").alias("ba"), c("same_type_ab").alias("same_type"))


@query("d20_dominance", DOMINANT + """, s AS (SELECT ab AS r, ba AS q, same_type FROM dom WHERE ab IS NOT NULL AND ba IS NOT NULL UNION ALL SELECT ba, ab, same_type FROM dom WHERE ab<>ba)
SELECT same_type, r AS row_type, q AS col_type, count(*) AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY same_type),6) AS share FROM s GROUP BY same_type, r, q
UNION ALL SELECT same_type, 'none', 'none', count(*), NULL FROM dom WHERE ab IS NULL OR ba IS NULL GROUP BY same_type""")
def d20(v):
    d = dominant(v)
    has = c("ab").isNotNull() & c("ba").isNotNull()
    pair = lambda a, b: F.struct(c(a).alias("row_type"), c(b).alias("col_type"))
    each = d.filter(has).select("same_type", F.explode(F.when(c("ab") == c("ba"), F.array(pair("ab", "ba"))).otherwise(F.array(pair("ab", "ba"), pair("ba", "ab")))).alias("p"))
    g = each.groupBy("same_type", "p.row_type", "p.col_type").agg(n_().alias("n"))
    g = g.withColumn("share", r6(c("n") / F.sum("n").over(Window.partitionBy("same_type"))))
    none = d.filter(~has).groupBy("same_type").agg(n_().alias("n"))
    return g.unionByName(none.select("same_type", lit("none").alias("row_type"), lit("none").alias("col_type"), "n", lit(None).cast("double").alias("share")))


@query("d21_dominance_sides", DOMINANT + """ SELECT (p.side=q.side)::INT AS ipsi, ab, ba, count(*) AS n FROM dom JOIN neurons p ON p.neuron=x JOIN neurons q ON q.neuron=y WHERE same_type=1 AND ab IS NOT NULL AND ba IS NOT NULL AND p.side<>'center' AND q.side<>'center' GROUP BY ALL""")
def d21(v):
    d = dominant(v).filter((c("same_type") == 1) & c("ab").isNotNull() & c("ba").isNotNull())
    for end in "xy":
        d = d.join(v.neurons.select(c("neuron").alias(end), c("side").alias(f"side_{end}")), end)
    d = d.filter((c("side_x") != "center") & (c("side_y") != "center"))
    return d.groupBy((c("side_x") == c("side_y")).cast("int").alias("ipsi"), "ab", "ba").agg(n_().alias("n"))


@query("d22_region_reciprocity", """r AS (SELECT regexp_replace(t.npil,'_[LR]$','') AS region, t.comp, c.reciprocal FROM typed t JOIN conn c ON c.pre=t.pre AND c.post=t.post)
SELECT region, """ + ", ".join(f"round(100.0*count(*) FILTER (comp='{t}' AND reciprocal={k})/count(*),1) AS {t.lower()}_{k}" for t in T4 for k in (0, 1)) + ", round(100.0*sum(reciprocal)/count(*),1) AS reciprocal_share FROM r GROUP BY region")
def d22(v):
    r = v.typed.join(v.conn.select("pre", "post", "reciprocal"), ["pre", "post"]).withColumn("region", expr.without_side(c("npil")))
    cell = lambda t, k: F.round(100.0 * F.count_if((c("comp") == t) & (c("reciprocal") == k)) / n_(), 1).alias(f"{t.lower()}_{k}")
    return r.groupBy("region").agg(*[cell(t, k) for t in T4 for k in (0, 1)], F.round(100.0 * F.sum("reciprocal") / n_(), 1).alias("reciprocal_share"))


@query("d23_detections_compared", "r AS (SELECT npil, (size>=25)::INT AS d, comp FROM typed), g AS (SELECT npil, d, " + ", ".join(f"count(*) FILTER (comp='{t}')/count(*) AS {t.lower()}" for t in T4) + " FROM r GROUP BY ALL) SELECT " + ", ".join(f"round(corr(a.{t.lower()}, b.{t.lower()}),6) AS r_{t.lower()}" for t in T4) + ", count(*) AS regions FROM g a JOIN g b ON a.npil=b.npil AND a.d=0 AND b.d=1")
def d23(v):
    g = v.typed.groupBy("npil", (c("size") >= 25).cast("int").alias("d")).agg(*[(pct(t) / n_()).alias(t) for t in T4])
    a, b = (g.filter(c("d") == d).select("npil", *[c(t).alias(f"{t}_{d}") for t in T4]) for d in (0, 1))
    return a.join(b, "npil").agg(*[r6(F.corr(f"{t}_0", f"{t}_1")).alias(f"r_{t.lower()}") for t in T4], n_().alias("regions"))


@query("d24_mixed_sweep", """p AS (SELECT unnest(range(0,20))*5/100.0::DOUBLE AS point), m AS (SELECT point, (CASE WHEN si_pre<point THEN 'M' ELSE comp[1] END) || (CASE WHEN si_post<point THEN 'M' ELSE comp[2] END) AS label FROM master, p WHERE comp IN ('AA','AD','DA','DD'))
SELECT round(point,2) AS point, label, count(*) AS n FROM m GROUP BY ALL""")
def d24(v):
    # rows of equal labels under all points are counted first: by the first point above either index
    step = lambda x: F.ceil(F.round(c(x) * 20, 7) + F.when(F.round(c(x) * 20, 7) == F.ceil(F.round(c(x) * 20, 7)), 1).otherwise(0)).cast("int")
    m = v.master.filter(c("comp").isin(T4)).groupBy("comp", F.least(F.greatest(step("si_pre"), lit(0)), lit(20)).alias("i"), F.least(F.greatest(step("si_post"), lit(0)), lit(20)).alias("j")).agg(n_().alias("n"))
    m = m.withColumn("k", F.explode(F.sequence(lit(0), lit(19))))
    letter = lambda at, s: F.when(c("k") >= c(s), "M").otherwise(F.substring("comp", at, 1))
    return m.groupBy(F.round(c("k") * 5 / 100.0, 2).alias("point"), F.concat(letter(1, "i"), letter(2, "j")).alias("label")).agg(F.sum("n").alias("n"))


#: The rolling mean's window over distinct indexes, and the points of the sweep.
WIDTH, POINTS = 50, 21


def _rolled(y):
    return f"(SELECT si, CASE WHEN row_number() OVER (ORDER BY si) >= {WIDTH} THEN avg(y) OVER (ORDER BY si ROWS BETWEEN {WIDTH - 1} PRECEDING AND CURRENT ROW) END AS roll FROM (SELECT si, avg({y}) * 100 AS y FROM ok WHERE si IS NOT NULL AND {y} IS NOT NULL GROUP BY si))"


@query("d24b_correctness_sweep", f"""ok AS (SELECT neuron, si, CASE WHEN ax_pre+ax_post>0 THEN ax_pre/(ax_pre+ax_post) END AS a, CASE WHEN de_pre+de_post>0 THEN de_post/(de_pre+de_post) END AS d FROM si),
p AS (SELECT unnest(range({POINTS}))*5/100.0::DOUBLE AS point), ta AS (SELECT point, arg_min(coalesce(roll, 1e300), (abs(si-point), si)) AS a FROM p, {_rolled("a")} GROUP BY point), td AS (SELECT point, arg_min(coalesce(roll, 1e300), (abs(si-point), si)) AS d FROM p, {_rolled("d")} GROUP BY point),
m AS (SELECT t.point, (CASE comp[1] WHEN 'A' THEN CASE WHEN o.a*100 > t.a THEN 'A' ELSE 'M' END ELSE CASE WHEN o.d*100 > u.d THEN 'D' ELSE 'M' END END) || (CASE comp[2] WHEN 'A' THEN CASE WHEN q.a*100 > t.a THEN 'A' ELSE 'M' END ELSE CASE WHEN q.d*100 > u.d THEN 'D' ELSE 'M' END END) AS label
 FROM typed c JOIN ok o ON o.neuron=c.pre JOIN ok q ON q.neuron=c.post, ta t JOIN td u ON u.point=t.point WHERE t.point > 0),
g AS (SELECT point, label, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT 0, comp, count(*) FROM typed GROUP BY comp)
SELECT round(point,2) AS point, label, n, round(n/sum(n) OVER (PARTITION BY point),6) AS share FROM g""")
def d24b(v):
    """Types relabelled M where an end's neuron is no more correct than the rolling mean at the index nearest to a point; at point 0 the types themselves.

    Which points a neuron's axon and dendrite pass is a number of 21 bits, so contacts are counted by type and bits in one pass."""
    ok = v.si.select("neuron", "si", expr.ratio(c("ax_pre"), c("ax_pre") + c("ax_post")).alias("a"), expr.ratio(c("de_post"), c("de_pre") + c("de_post")).alias("d"))
    points = v.spark.range(POINTS).select(F.round(c("id") * 5 / 100.0, 2).alias("point"))
    bits = {}
    for y in "ad":
        x = ok.filter(c("si").isNotNull() & c(y).isNotNull()).groupBy("si").agg((F.avg(y) * 100).alias("y"))
        x = rolling_mean(running(x, [], ["si"], {"place": lit(1).cast("bigint")}), "y", "place", WIDTH, 256)
        found = joins.value_at(points, "point", x.withColumn("rolling", F.coalesce("rolling", lit(1e300))), "si", "rolling")
        found = sorted((r["point"], r["value"]) for r in found.collect())  # a row a point
        bits[y] = sum((F.when(c(y) * 100 > lit(float(t)), lit(1 << k)).otherwise(0) for k, (_, t) in enumerate(found)), lit(0))
    flags = ok.select("neuron", *[F.coalesce(b, lit(0)).alias(f"bits_{y}") for y, b in bits.items()])
    x = tables.with_roles(v.typed, flags, ["bits_a", "bits_d"], "inner")
    of = lambda at, role: F.when(F.substring("comp", at, 1) == "A", c(f"bits_a_{role}")).otherwise(c(f"bits_d_{role}"))
    g = x.groupBy("comp", of(1, "pre").alias("x"), of(2, "post").alias("y")).agg(n_().alias("n")).withColumn("k", F.explode(F.sequence(lit(0), lit(POINTS - 1))))
    letter = lambda at, b: F.when((c("k") == 0) | (F.expr(f"shiftrightunsigned(CAST({b} AS BIGINT), k)").bitwiseAND(lit(1)) == 1), F.substring("comp", at, 1)).otherwise("M")
    g = g.groupBy(F.round(c("k") * 5 / 100.0, 2).alias("point"), F.concat(letter(1, "x"), letter(2, "y")).alias("label")).agg(F.sum("n").alias("n"))
    return g.withColumn("share", r6(c("n") / F.sum("n").over(Window.partitionBy("point"))))  # 16 rows a point at most


@query("d25_ad_share_by_threshold", "t AS (SELECT (unnest(range(20))*5)/100.0::DOUBLE AS thr) SELECT round(thr,2) AS thr, round(count(*) FILTER (comp='AD')/count(*),6) AS share FROM master, t WHERE si_pre>=thr AND si_post>=thr AND comp IN ('AA','AD','DA','DD') GROUP BY thr")
def d25(v):
    low = F.least(F.floor(F.round(F.least("si_pre", "si_post") * 20, 7)), lit(19))
    g = v.master.filter(c("comp").isin(T4)).groupBy(low.alias("top")).agg(n_().alias("n"), pct("AD").alias("ad")).filter(c("top") >= 0)
    g = g.withColumn("k", F.explode(F.sequence(lit(0).cast("bigint"), c("top"))))
    return g.groupBy(F.round(c("k") * 5 / 100.0, 2).alias("thr")).agg(r6(F.sum("ad") / F.sum("n")).alias("share"))


@query("d26_transmitter_share", """r AS (SELECT t.comp, a.nt_type, (a.primary_type=b.primary_type)::INT AS same_type FROM typed t JOIN neurons a ON a.neuron=t.pre JOIN neurons b ON b.neuron=t.post WHERE comp IN ('AA','DD') AND a.nt_type IS NOT NULL)
SELECT comp, same_type, nt_type, count(*) AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY comp, same_type),6) AS share FROM r GROUP BY comp, same_type, nt_type""")
def d26(v):
    r = tables.with_roles(v.typed.filter(c("comp").isin("AA", "DD")), v.neurons, ["primary_type", "nt_type"], "inner").filter(c("nt_type_pre").isNotNull())
    g = r.groupBy("comp", (c("primary_type_pre") == c("primary_type_post")).cast("int").alias("same_type"), c("nt_type_pre").alias("nt_type")).agg(n_().alias("n"))
    return g.withColumn("share", r6(c("n") / F.sum("n").over(Window.partitionBy("comp", "same_type"))))


@query("d27_majority_ceiling", """t AS (SELECT a.primary_type AS x, b.primary_type AS y, sum("AA") AS aa, sum("AD") AS ad, sum("DA") AS da, sum("DD") AS dd FROM conn0 JOIN neurons a ON a.neuron=pre JOIN neurons b ON b.neuron=post GROUP BY ALL)
SELECT 'connection' AS level, round(sum(greatest("AA","AD","DA","DD"))/sum(sum_syn),6) AS ceiling FROM conn0 UNION ALL SELECT 'type pair', round(sum(greatest(aa,ad,da,dd))/sum(aa+ad+da+dd),6) FROM t""")
def d27(v):
    e = tables.type_counts(v.typed)
    pairs = tables.with_roles(e, v.neurons, ["primary_type"], "inner").groupBy("primary_type_pre", "primary_type_post").agg(*[F.sum(t).alias(t) for t in T4], F.sum("sum_syn").alias("sum_syn"))
    top = lambda d, name: d.agg(r6(F.sum(F.greatest(*T4)) / F.sum("sum_syn")).alias("ceiling")).select(lit(name).alias("level"), "ceiling")
    return top(e, "connection").unionByName(top(pairs, "type pair"))


SHIFT = ["length_nm", "area_nm", "size_nm", "leafs"]


@query("d28_feature_shift", " UNION ALL ".join(f"SELECT '{t}' AS comp, '{role}' AS role, '{f}' AS feature, round((avg(n.{f}) FILTER (comp='{t}') - avg(n.{f}))/(avg(n.{f}) FILTER (comp='{t}') + avg(n.{f})),6) AS shift FROM typed JOIN neurons n ON n.neuron={role}" for t in ("AA", "DD") for role in ("pre", "post") for f in SHIFT))
def d28(v):
    r = tables.with_roles(v.typed, v.neurons, SHIFT, "inner")

    def cell(t, role, f):
        x = c(f"{f}_{role}")
        part, whole = F.avg(F.when(c("comp") == t, x)), F.avg(x)
        return F.struct(lit(t).alias("comp"), lit(role).alias("role"), lit(f).alias("feature"), r6((part - whole) / (part + whole)).alias("shift"))
    return r.agg(F.array(*[cell(t, role, f) for t in ("AA", "DD") for role in ("pre", "post") for f in SHIFT]).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@query("d29_class_contacts", "SELECT a.super_class AS class_pre, b.super_class AS class_post, count(*) AS n FROM typed JOIN neurons a ON a.neuron=pre JOIN neurons b ON b.neuron=post WHERE a.super_class IN ('central','optic','visual_projection','visual_centrifugal') AND b.super_class IN ('central','optic','visual_projection','visual_centrifugal') GROUP BY ALL")
def d29(v):
    r = tables.with_roles(v.typed, v.neurons.filter(c("super_class").isin(INTRINSIC)), ["super_class"], "inner")
    return r.groupBy(c("super_class_pre").alias("class_pre"), c("super_class_post").alias("class_post")).agg(n_().alias("n"))


@query("d30_mode_agreement", """m AS (SELECT pre, post, CASE greatest("AA","AD","DA","DD") WHEN "AA" THEN 'AA' WHEN "AD" THEN 'AD' WHEN "DA" THEN 'DA' ELSE 'DD' END AS mode FROM conn0) SELECT t.comp, mode, count(*) AS n, round(avg((t.comp=mode)::INT),6) AS agree FROM typed t JOIN m ON m.pre=t.pre AND m.post=t.post GROUP BY ALL""")
def d30(v):
    m = tables.type_counts(v.typed).select("pre", "post", expr.most_of(T4).alias("mode"))
    return v.typed.join(m, ["pre", "post"]).groupBy("comp", "mode").agg(n_().alias("n"), r6(F.avg((c("comp") == c("mode")).cast("int"))).alias("agree"))


@query("d31_side_pairs", """x AS (SELECT primary_type || '/' || cell_sub_class AS t, side, si FROM nsi WHERE si IS NOT NULL AND side<>'center'), p AS (SELECT t, avg(si) FILTER (side='left') AS l, avg(si) FILTER (side='right') AS r, count(*) AS n FROM x GROUP BY t HAVING count(*) FILTER (side='left')>0 AND count(*) FILTER (side='right')>0)
SELECT round((k*5)/100.0::DOUBLE,2) AS thr, round(corr(l,r) FILTER (l>=k*0.05 AND r>=k*0.05),6) AS r_above, count(*) FILTER (l>=k*0.05 AND r>=k*0.05) AS n_above FROM p, (SELECT unnest(range(0,4)) AS k) GROUP BY k""")
def d31(v):
    x = v.nsi.filter(c("si").isNotNull() & (c("side") != "center")).groupBy(F.concat_ws("/", "primary_type", "cell_sub_class").alias("t"))
    p = x.agg(F.avg(F.when(c("side") == "left", c("si"))).alias("l"), F.avg(F.when(c("side") == "right", c("si"))).alias("r")).dropna()
    p = p.withColumn("k", F.explode(F.sequence(lit(0), lit(3))))
    above = (c("l") >= c("k") * 0.05) & (c("r") >= c("k") * 0.05)
    return p.groupBy(F.round(c("k") * 5 / 100.0, 2).alias("thr")).agg(r6(F.corr(F.when(above, c("l")), F.when(above, c("r")))).alias("r_above"), F.count_if(above).alias("n_above"))


@query("d32_within_between", "t AS (SELECT primary_type, avg(si) AS m, stddev_samp(si) AS s, count(si) AS n FROM nsi GROUP BY 1 HAVING count(si)>=2) SELECT round(avg(s),6) AS within, round(stddev_samp(m),6) AS between_types, count(*) AS types FROM t")
def d32(v):
    t = v.nsi.groupBy("primary_type").agg(F.avg("si").alias("m"), F.stddev_samp("si").alias("s"), F.count("si").alias("n")).filter(c("n") >= 2)
    return t.agg(r6(F.avg("s")).alias("within"), r6(F.stddev_samp("m")).alias("between_types"), n_().alias("types"))


@query("d33_type_summary", "SELECT super_class, primary_type, round(avg(si),6) AS si, round(avg(length_nm),6) AS metric, count(*) AS n FROM nsi GROUP BY ALL HAVING count(*) >= 2")
def d33(v):
    return v.nsi.groupBy("super_class", "primary_type").agg(r6(F.avg("si")).alias("si"), r6(F.avg("length_nm")).alias("metric"), n_().alias("n")).filter(c("n") >= 2)


def si_of(where: str, name: str) -> str:
    """CTEs of the index from a part of the contacts."""
    e = lambda a, b: f"CASE WHEN {a}=0 OR {b}=0 THEN 0.0 ELSE -({a}/({a}+{b})*log2({a}/({a}+{b})) + {b}/({a}+{b})*log2({b}/({a}+{b}))) END"
    return f"""{name}4 AS (SELECT neuron, count(*) FILTER (role='pre' AND k='A') AS ap, count(*) FILTER (role='post' AND k='A') AS aq, count(*) FILTER (role='pre' AND k='D') AS dp, count(*) FILTER (role='post' AND k='D') AS dq
 FROM (SELECT pre AS neuron, 'pre' AS role, pre_compartment AS k FROM syn WHERE {where} UNION ALL SELECT post, 'post', post_compartment FROM syn WHERE {where}) GROUP BY neuron),
{name}e AS (SELECT *, {e('ap', 'aq')} AS ea, {e('dp', 'dq')} AS ed, {e('(ap+dp)', '(aq+dq)')} AS en FROM {name}4),
{name} AS (SELECT neuron, round(CASE WHEN en>0 THEN 1-((ap+aq)*ea+(dp+dq)*ed)/(ap+aq+dp+dq)/en END,9) AS si FROM {name}e)"""


@query("d34_detection_agreement", f"{si_of('size<25', 'p')}, {si_of('size>=25', 'q')} SELECT least(greatest(ceil(p.si*20)-1,0),19)::INT AS bin, count(*) AS n, round(avg(q.si),6) AS other FROM p JOIN q ON p.neuron=q.neuron WHERE p.si IS NOT NULL AND q.si IS NOT NULL GROUP BY 1")
def d34(v):
    p, q = tables.segregation(v.syn.filter(c("size") < 25)), tables.segregation(v.syn.filter(c("size") >= 25))
    x = p.select("neuron", "si").join(q.select("neuron", c("si").alias("other")), "neuron").dropna()
    return x.groupBy(F.least(F.greatest(F.ceil(c("si") * 20) - 1, lit(0)), lit(19)).cast("int").alias("bin")).agg(n_().alias("n"), r6(F.avg("other")).alias("other"))


@query("d35_pick_lists", "SELECT neuron, CASE WHEN si<0.05 THEN 'low' ELSE 'high' END AS list FROM nsi WHERE si<0.05 OR si>0.3")
def d35(v):
    return v.nsi.filter((c("si") < 0.05) | (c("si") > 0.3)).select("neuron", F.when(c("si") < 0.05, "low").otherwise("high").alias("list"))


@query("d36_strong_subnetwork", "s AS (SELECT pre, post FROM conn0 WHERE sum_syn>=2) SELECT 'strong' AS net, count(*) AS n, round(avg((r.pre IS NOT NULL)::INT),6) AS share FROM s LEFT JOIN s r ON r.pre=s.post AND r.post=s.pre UNION ALL SELECT 'whole', count(*), round(avg(reciprocal),6) FROM conn")
def d36(v):
    e = tables.type_counts(v.typed)
    one = lambda d, name: tables.mark_reciprocal(d).agg(n_().alias("n"), r6(F.avg("reciprocal")).alias("share")).select(lit(name).alias("net"), "n", "share")
    return one(e.filter(c("sum_syn") >= 2), "strong").unionByName(one(e, "whole"))


@query("d37_reciprocity_by_type", "SELECT same_type, reciprocal, count(*) AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY same_type),6) AS of_same, round(count(*)/sum(count(*)) OVER (PARTITION BY reciprocal),6) AS of_reciprocal FROM conn GROUP BY same_type, reciprocal")
def d37(v):
    g = v.conn.groupBy("same_type", "reciprocal").agg(n_().alias("n"))
    share = lambda k: r6(c("n") / F.sum("n").over(Window.partitionBy(k)))
    return g.withColumn("of_same", share("same_type")).withColumn("of_reciprocal", share("reciprocal"))


@query("d38_linker_variant", f"""{TALLY}, m AS (SELECT c.comp, (coalesce(a.pre_l,0)+coalesce(a.post_l,0)>0) AS linker, x.si AS s, y.si AS t FROM comp c JOIN tally a ON a.neuron=c.pre JOIN si x ON x.neuron=c.pre JOIN si y ON y.neuron=c.post)
SELECT grp, comp, count(*) AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY grp),6) AS share FROM (SELECT 'all' AS grp, comp FROM m UNION ALL SELECT 'linker', comp FROM m WHERE linker UNION ALL SELECT 'segregated', comp FROM m WHERE s>=0.1 AND t>=0.1) GROUP BY grp, comp""")
def d38(v):
    links = tally(v).select(c("neuron").alias("pre"), (c("pre_l") + c("post_l") > 0).alias("linker"))
    m = tables.with_roles(v.comp, v.si, ["si"], "inner").join(links, "pre")
    groups = F.array_compact(F.array(lit("all"), F.when(c("linker"), "linker"), F.when((c("si_pre") >= 0.1) & (c("si_post") >= 0.1), "segregated")))
    # counted by comp and the groups a row is in, then dealt to the groups
    g = m.groupBy("comp", groups.alias("g")).agg(n_().alias("n")).select("comp", "n", F.explode("g").alias("grp")).groupBy("grp", "comp").agg(F.sum("n").alias("n"))
    return g.withColumn("share", r6(c("n") / F.sum("n").over(Window.partitionBy("grp"))))


@query("d39_recomputed_sample", f"{si_of('size >= 10', 'p')} SELECT count(*) AS n, round(corr(p.si, n.si),6) AS r FROM p JOIN nsi n ON n.neuron=p.neuron WHERE ('0x' || substr(md5(n.neuron::VARCHAR),1,6))::BIGINT % 3 = 0 AND p.si IS NOT NULL AND n.si IS NOT NULL")
def d39(v):
    p = tables.segregation(v.syn.filter(c("size") >= 10)).select("neuron", c("si").alias("again"))
    pick = F.conv(F.substring(F.md5(c("neuron").cast("string").cast("binary")), 1, 6), 16, 10).cast("bigint") % 3 == 0  # a third of the neurons
    return v.nsi.filter(pick).join(p, "neuron").dropna(subset=["again", "si"]).agg(n_().alias("n"), r6(F.corr("again", "si")).alias("r"))
