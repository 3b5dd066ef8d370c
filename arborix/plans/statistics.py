"""Queries of the statistical tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborix.functions.ranks import quantiles
from arborix.functions.tails import p_chi2, p_f, p_t, p_z, sql_chi2, sql_f, sql_t, sql_with, sql_z
from arborix.operators import stats
from arborix.plans.basic import STACK, stacked
from arborix.plans.registry import query

c, lit = F.col, F.lit


def n_():
    return F.count(lit(1))


r6 = lambda x: F.round(x, 6)


def with_p(df, **added):
    """Further columns, rounded; p values are those of the statistics as rounded."""
    return df.select("*", *[r6(x).alias(n) for n, x in added.items()])


def rounded(df):
    return df.select(*[r6(c(x)).alias(x) if t == "double" else c(x) for x, t in df.dtypes])


MOMENTS = "m AS (SELECT super_class AS g, count(si) AS n, avg(si) AS mean, var_samp(si) AS var FROM nsi WHERE si IS NOT NULL AND super_class IS NOT NULL GROUP BY 1)"
RANKS = """x AS (SELECT super_class AS g, si, rank() OVER (ORDER BY si) + (count(*) OVER (PARTITION BY si) - 1)/2 AS rk FROM nsi WHERE si IS NOT NULL AND super_class IS NOT NULL),
ties AS (SELECT sum(t*t*t-t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM x GROUP BY si)), rs AS (SELECT g, count(*) AS n, sum(rk) AS r FROM x GROUP BY g)"""


def groups(v):
    return stats.moments(v.nsi, "super_class", "si")


@query("st1_chi_square", sql_with("""q AS (SELECT count(*) FILTER (reciprocal=1 AND same_type=1)::DOUBLE AS a, count(*) FILTER (reciprocal=1 AND same_type=0)::DOUBLE AS b, count(*) FILTER (reciprocal=0 AND same_type=1)::DOUBLE AS c, count(*) FILTER (reciprocal=0 AND same_type=0)::DOUBLE AS d FROM conn), n AS (SELECT *, a+b+c+d AS n FROM q)
SELECT round(n*power(greatest(abs(a*d-b*c)-n/2,0),2)/((a+b)*(c+d)*(a+c)*(b+d)),6) AS chi2, round(sqrt(power(greatest(abs(a*d-b*c)-n/2,0),2)/((a+b)*(c+d)*(a+c)*(b+d))),6) AS cramers_v, round(least((a+b)*(a+c)/n,(a+b)*(b+d)/n,(c+d)*(a+c)/n,(c+d)*(b+d)/n),6) AS least_expected FROM n""", p=sql_chi2("r.chi2", "1")))
def st1(v):
    cell = lambda r, s: F.count_if((c("reciprocal") == r) & (c("same_type") == s)).cast("double")
    q = v.conn.agg(cell(1, 1).alias("a"), cell(1, 0).alias("b"), cell(0, 1).alias("c"), cell(0, 0).alias("d")).withColumn("n", c("a") + c("b") + c("c") + c("d"))
    r1, r2, k1, k2 = c("a") + c("b"), c("c") + c("d"), c("a") + c("c"), c("b") + c("d")
    y = F.greatest(F.abs(c("a") * c("d") - c("b") * c("c")) - c("n") / 2, lit(0.0))
    phi2 = F.try_divide(y * y, r1 * r2 * k1 * k2)
    out = q.select(r6(c("n") * phi2).alias("chi2"), r6(F.sqrt(phi2)).alias("cramers_v"), r6(F.try_divide(F.least(r1 * k1, r1 * k2, r2 * k1, r2 * k2), c("n"))).alias("least_expected"))
    return with_p(out, p=p_chi2(c("chi2"), lit(1)))


@query("st2_anova", sql_with(f"{MOMENTS}, t AS (SELECT sum(n) AS n, count(*) AS k, sum(n*mean)/sum(n) AS grand, sum((n-1)*var) AS w, sum(n*mean*mean) AS q FROM m), s AS (SELECT *, q-n*grand*grand AS b FROM t) SELECT round(b/(k-1)/(w/(n-k)),6) AS f, k-1 AS df1, (n-k)::BIGINT AS df2, round(b,6) AS ss_between, round(w,6) AS ss_within, round(b/(b+w),6) AS eta2, round((b-(k-1)*w/(n-k))/(b+2*w),6) AS omega2 FROM s", p=sql_f("r.f", "r.df1", "r.df2")))
def st2(v):
    return with_p(rounded(stats.anova(groups(v))), p=p_f(c("f"), c("df1"), c("df2")))


@query("st3_welch_anova", sql_with(f"{MOMENTS}, w AS (SELECT *, n/var AS w FROM m), s AS (SELECT *, sum(w) OVER () AS sw, count(*) OVER () AS k, sum(w*mean) OVER ()/sum(w) OVER () AS gm FROM w), a AS (SELECT any_value(k) AS k, sum(w*(mean-gm)*(mean-gm)) AS a, sum((1-w/sw)*(1-w/sw)/(n-1)) AS h FROM s) SELECT round(a/(k-1)/(1+2*(k-2)*h/(k*k-1)),6) AS f, k-1 AS df1, round((k*k-1)/(3*h),4) AS df2 FROM a", p=sql_f("r.f", "r.df1", "r.df2")))
def st3(v):
    out = stats.welch_anova(groups(v)).select(r6(c("f")).alias("f"), "df1", F.round("df2", 4).alias("df2"))
    return with_p(out, p=p_f(c("f"), c("df1"), c("df2")))


@query("st4_levene", sql_with("""d AS (SELECT super_class AS g, abs(si - median(si) OVER (PARTITION BY super_class)) AS z FROM nsi WHERE si IS NOT NULL AND super_class IS NOT NULL), m AS (SELECT g, count(*) AS n, avg(z) AS mean, var_samp(z) AS var FROM d GROUP BY g),
t AS (SELECT sum(n) AS n, count(*) AS k, sum(n*mean)/sum(n) AS grand, sum((n-1)*var) AS w, sum(n*mean*mean) AS q FROM m) SELECT round((q-n*grand*grand)/(k-1)/(w/(n-k)),6) AS w, k-1 AS df1, (n-k)::BIGINT AS df2 FROM t""", p=sql_f("r.w", "r.df1", "r.df2")))
def st4(v):
    rows = v.nsi.filter(c("si").isNotNull() & c("super_class").isNotNull()).select("super_class", "si")
    mid = quantiles(rows, ["super_class"], "si", [0.5]).withColumnRenamed("q0", "mid")
    z = rows.join(mid, "super_class").withColumn("z", F.abs(c("si") - c("mid")))
    out = stats.anova(stats.moments(z, "super_class", "z")).select(r6(c("f")).alias("w"), "df1", "df2")
    return with_p(out, p=p_f(c("w"), c("df1"), c("df2")))


@query("st5_kruskal", sql_with(f"{RANKS}, t AS (SELECT sum(r*r/n) AS q, sum(n)::DOUBLE AS n, count(*) AS k FROM rs), h AS (SELECT (12/(n*(n+1))*q-3*(n+1))/(1-ties/(n*n*n-n)) AS h, k, n FROM t, ties) SELECT round(h,6) AS h, k-1 AS df, round((h-k+1)/(n-k),6) AS eta2 FROM h", p=sql_chi2("r.h", "r.df")))
def st5(v):
    return with_p(rounded(stats.kruskal(stats.rank_sums(v.nsi, "super_class", "si"))), p=p_chi2(c("h"), c("df")))


@query("st6_dunn", sql_with(f"{RANKS}, t AS (SELECT sum(n)::DOUBLE AS total, count(*) AS k FROM rs) SELECT a.g AS a, b.g AS b, round((a.r/a.n-b.r/b.n)/sqrt((total*(total+1)/12-ties/(12*(total-1)))*(1.0/a.n+1.0/b.n)),6) AS z FROM rs a JOIN rs b ON a.g<b.g, t, ties", p=sql_z("r.z"), p_bonferroni=f"least(1, count(*) OVER () * {sql_z('r.z')})"))
def st6(v):
    r = stats.rank_sums(v.nsi, "super_class", "si")
    p = stats.pairs_of(r, "super_class", ["n", "r", "total", "ties"])
    n = c("total_a").cast("double")
    sigma = F.sqrt((n * (n + 1) / 12 - c("ties_a") / (12 * (n - 1))) * (1 / c("n_a") + 1 / c("n_b")))
    from pyspark.sql import Window

    out = p.select(c("super_class_a").alias("a"), c("super_class_b").alias("b"), r6(F.try_divide(c("r_a") / c("n_a") - c("r_b") / c("n_b"), sigma)).alias("z"))
    pairs = F.count(lit(1)).over(Window.partitionBy())  # one row a pair of groups
    return with_p(out, p=p_z(c("z")), p_bonferroni=F.least(lit(1.0), pairs * p_z(c("z"))))


@query("st7_mann_whitney", sql_with("""x AS (SELECT side AS g, si, rank() OVER (ORDER BY si) + (count(*) OVER (PARTITION BY si) - 1)/2 AS rk FROM nsi WHERE si IS NOT NULL AND side<>'center'),
ties AS (SELECT sum(t*t*t-t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM x GROUP BY si)), halves AS (SELECT count(*) FILTER (g='left')::DOUBLE AS n1, count(*) FILTER (g='right')::DOUBLE AS n2, sum(rk) FILTER (g='left') AS r1 FROM x),
m AS (SELECT *, r1 - n1*(n1+1)/2 AS u, n1+n2 AS n FROM halves, ties)
SELECT u, round(1-2*u/(n1*n2),6) AS rank_biserial, round(greatest(abs(u-n1*n2/2)-0.5,0)/sqrt(n1*n2/12*(n+1-ties/(n*(n-1)))),6) AS z FROM m""", p=sql_z("r.z")))
def st7(v):
    r = stats.rank_sums(v.nsi.filter(c("side") != "center"), "side", "si")
    of = lambda col, s: F.max(F.when(c("side") == s, c(col)))
    g = r.agg(of("n", "left").cast("double").alias("n1"), of("n", "right").cast("double").alias("n2"), of("r", "left").alias("r1"), F.max("ties").alias("ties"))
    n1, n2, n = c("n1"), c("n2"), c("n1") + c("n2")
    u = c("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(c("ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, lit(0.0)), spread)
    return with_p(g.select(u.alias("u"), r6(1 - F.try_divide(2 * u, n1 * n2)).alias("rank_biserial"), r6(z).alias("z")), p=p_z(c("z")))


@query("st8_t_tests", sql_with(f"{MOMENTS} SELECT a.g AS a, b.g AS b, round((a.mean-b.mean)/sqrt(a.var/a.n+b.var/b.n),6) AS t, round(power(a.var/a.n+b.var/b.n,2)/(power(a.var/a.n,2)/(a.n-1)+power(b.var/b.n,2)/(b.n-1)),4) AS df, round((a.mean-b.mean)/sqrt(((a.n-1)*a.var+(b.n-1)*b.var)/(a.n+b.n-2)),6) AS cohens_d, round((a.mean-b.mean)/sqrt(((a.n-1)*a.var+(b.n-1)*b.var)/(a.n+b.n-2))*(1-3/(4*(a.n+b.n)-9)),6) AS hedges_g FROM m a JOIN m b ON a.g<b.g", p=sql_t("r.t", "r.df"), p_bonferroni=f"least(1, count(*) OVER () * {sql_t('r.t', 'r.df')})"))
def st8(v):
    p = stats.pairs_of(groups(v), "super_class", ["n", "mean", "var"])
    sa, sb, na, nb = c("var_a") / c("n_a"), c("var_b") / c("n_b"), c("n_a"), c("n_b")
    diff = c("mean_a") - c("mean_b")
    d = diff / F.sqrt(((na - 1) * c("var_a") + (nb - 1) * c("var_b")) / (na + nb - 2))
    out = p.select(c("super_class_a").alias("a"), c("super_class_b").alias("b"), r6(diff / F.sqrt(sa + sb)).alias("t"),
                    F.round((sa + sb) * (sa + sb) / (sa * sa / (na - 1) + sb * sb / (nb - 1)), 4).alias("df"), r6(d).alias("cohens_d"), r6(d * (1 - 3 / (4 * (na + nb) - 9))).alias("hedges_g"))
    from pyspark.sql import Window

    pairs, p_ = F.count(lit(1)).over(Window.partitionBy()), p_t(c("t"), c("df"))  # one row a pair of groups
    return with_p(out, p=p_, p_bonferroni=F.least(lit(1.0), pairs * p_))


@query("st8b_paired_t", sql_with("""d AS (SELECT ax_pre - de_pre AS d FROM si WHERE ax_pre IS NOT NULL AND de_pre IS NOT NULL), m AS (SELECT count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM d)
SELECT n, round(mean,6) AS mean_diff, round(mean/(sd/sqrt(n)),6) AS t, n-1 AS df, round(mean/sd,6) AS cohens_d FROM m""", p=sql_t("r.t", "r.df")))
def st8b(v):
    d = v.si.select((c("ax_pre") - c("de_pre")).alias("d")).dropna()
    return _one_sample(d, "d", 0.0, "mean_diff")


@query("st8c_one_sample_t", sql_with("""m AS (SELECT super_class, count(*) AS n, avg(si) AS mean, stddev_samp(si) AS sd FROM nsi WHERE si IS NOT NULL AND super_class IS NOT NULL GROUP BY 1)
SELECT super_class, n, round(mean-0.1,6) AS mean_diff, round((mean-0.1)/(sd/sqrt(n)),6) AS t, n-1 AS df, round((mean-0.1)/sd,6) AS cohens_d FROM m""", p=sql_t("r.t", "r.df")))
def st8c(v):
    rows = v.nsi.filter(c("si").isNotNull() & c("super_class").isNotNull())
    return _one_sample(rows, "si", 0.1, "mean_diff", "super_class")


def _one_sample(rows, value, against, name, *keys):
    """t test of the mean (of each group of keys) against a number, with Cohen's d."""
    m = rows.groupBy(*keys).agg(n_().alias("n"), (F.avg(value) - against).alias("mean"), F.stddev_samp(value).alias("sd"))
    d = F.try_divide(c("mean"), c("sd"))
    out = m.select(*keys, "n", r6(c("mean")).alias(name), r6(d * F.sqrt(c("n"))).alias("t"), (c("n") - 1).alias("df"), r6(d).alias("cohens_d"))
    return with_p(out, p=p_t(c("t"), c("df")))


@query("st9_wilcoxon", sql_with("""d AS (SELECT ax_pre - de_pre AS d FROM si WHERE ax_pre<>de_pre), x AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1)/2 AS rk FROM d),
ties AS (SELECT coalesce(sum(t*t*t-t),0) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM d GROUP BY abs(d))), halves AS (SELECT coalesce(sum(rk) FILTER (d>0),0) AS w_plus, coalesce(sum(rk) FILTER (d<0),0) AS w_minus, count(*) AS n FROM x)
SELECT w_plus, w_minus, n, round((least(w_plus,w_minus)-n*(n+1)/4)/sqrt(n*(n+1.0::DOUBLE)*(2*n+1)/24-ties/48),6) AS z FROM halves, ties""", p=sql_z("r.z")))
def st9(v):
    d = v.si.select((c("ax_pre") - c("de_pre")).alias("d")).filter(c("d") != 0).withColumn("m", F.abs("d"))
    ties = d.groupBy("m").agg(n_().cast("double").alias("t")).agg(F.coalesce(F.sum(c("t") * c("t") * c("t") - c("t")), lit(0.0)).alias("ties"))
    half = lambda s: F.coalesce(F.sum(F.when(s, c("tied_rank"))), lit(0.0))
    r = stats.tied_ranks(d, "m").agg(half(c("d") > 0).alias("w_plus"), half(c("d") < 0).alias("w_minus"), n_().alias("n")).crossJoin(F.broadcast(ties))  # one row
    n = c("n").cast("double")
    z = F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - c("ties") / 48))
    return with_p(r.select("w_plus", "w_minus", "n", r6(z).alias("z")), p=p_z(c("z")))


@query("st10_pearson", sql_with("SELECT super_class, round(corr(si,length_nm),6) AS r, count(*) AS n, round(corr(si,length_nm)*sqrt((count(*)-2)/(1-power(corr(si,length_nm),2))),6) AS t FROM nsi WHERE si IS NOT NULL AND length_nm IS NOT NULL GROUP BY 1", p=sql_t("r.t", "r.n - 2")))
def st10(v):
    r = F.corr("si", "length_nm")
    out = v.nsi.dropna(subset=["si", "length_nm"]).groupBy("super_class").agg(r6(r).alias("r"), n_().alias("n"), r6(r * F.sqrt(F.try_divide(n_() - 2, 1 - r * r))).alias("t"))
    return with_p(out, p=p_t(c("t"), c("n") - 2))


@query("st11_pairwise_q", f"{MOMENTS}, e AS (SELECT sum((n-1)*var)/(sum(n)-count(*)) AS mse FROM m) SELECT a.g AS a, b.g AS b, round(a.mean-b.mean,6) AS diff, round(abs(a.mean-b.mean)/sqrt(mse/2*(1.0/a.n+1.0/b.n)),6) AS q_tukey, round(abs(a.mean-b.mean)/sqrt((a.var/a.n+b.var/b.n)/2),6) AS q_games_howell FROM m a JOIN m b ON a.g<b.g, e")
def st11(v):
    m = groups(v)
    mse = F.broadcast(m.agg((F.sum((c("n") - 1) * c("var")) / (F.sum("n") - n_())).alias("mse")))  # one row
    p = stats.pairs_of(m, "super_class", ["n", "mean", "var"]).crossJoin(mse)
    d = c("mean_a") - c("mean_b")
    return p.select(c("super_class_a").alias("a"), c("super_class_b").alias("b"), r6(d).alias("diff"), r6(F.abs(d) / F.sqrt(c("mse") / 2 * (1 / c("n_a") + 1 / c("n_b")))).alias("q_tukey"),
                    r6(F.abs(d) / F.sqrt((c("var_a") / c("n_a") + c("var_b") / c("n_b")) / 2)).alias("q_games_howell"))


@query("st12_mixed_anova", sql_with("""x AS (SELECT super_class AS g, ax_pre/(ax_pre+ax_post) AS a, de_post/(de_pre+de_post) AS d FROM nsi WHERE ax_pre+ax_post>0 AND de_pre+de_post>0 AND super_class IS NOT NULL),
m AS (SELECT g, count(*) AS n, avg((a+d)/2) AS m, var_samp((a+d)/2) AS vm, avg(a-d) AS w, var_samp(a-d) AS vw FROM x GROUP BY g),
t AS (SELECT sum(n) AS n, count(*) AS k, sum(n*m)/sum(n) AS gm, sum(n*w)/sum(n) AS gw, sum((n-1)*vm)*2 AS es, sum((n-1)*vw)/2 AS ew, sum(n*m*m) AS qm, sum(n*w*w) AS qw FROM m)
SELECT round(2*(qm-n*gm*gm)/(k-1)/(es/(n-k)),6) AS f_between, round(n*gw*gw/2/(ew/(n-k)),6) AS f_within, round((qw-n*gw*gw)/2/(k-1)/(ew/(n-k)),6) AS f_interaction, k-1 AS df1, (n-k)::BIGINT AS df2 FROM t""", p_between=sql_f("r.f_between", "r.df1", "r.df2"), p_within=sql_f("r.f_within", "1", "r.df2"), p_interaction=sql_f("r.f_interaction", "r.df1", "r.df2")))
def st12(v):
    x = v.nsi.filter((c("ax_pre") + c("ax_post") > 0) & (c("de_pre") + c("de_post") > 0) & c("super_class").isNotNull())
    x = x.select("super_class", (c("ax_pre") / (c("ax_pre") + c("ax_post"))).alias("a"), (c("de_post") / (c("de_pre") + c("de_post"))).alias("d"))
    m = x.groupBy("super_class").agg(n_().alias("n"), F.avg((c("a") + c("d")) / 2).alias("m"), F.var_samp((c("a") + c("d")) / 2).alias("vm"), F.avg(c("a") - c("d")).alias("w"), F.var_samp(c("a") - c("d")).alias("vw"))
    n, k = c("n"), c("k")
    t = m.agg(F.sum("n").alias("n"), n_().alias("k"), (F.sum(n * c("m")) / F.sum("n")).alias("gm"), (F.sum(n * c("w")) / F.sum("n")).alias("gw"), (F.sum((n - 1) * c("vm")) * 2).alias("es"),
              (F.sum((n - 1) * c("vw")) / 2).alias("ew"), F.sum(n * c("m") * c("m")).alias("qm"), F.sum(n * c("w") * c("w")).alias("qw"))
    out = t.select(r6(2 * (c("qm") - n * c("gm") * c("gm")) / (k - 1) / (c("es") / (n - k))).alias("f_between"), r6(n * c("gw") * c("gw") / 2 / (c("ew") / (n - k))).alias("f_within"),
                    r6((c("qw") - n * c("gw") * c("gw")) / 2 / (k - 1) / (c("ew") / (n - k))).alias("f_interaction"), (k - 1).alias("df1"), (n - k).alias("df2"))
    return with_p(out, p_between=p_f(c("f_between"), c("df1"), c("df2")), p_within=p_f(c("f_within"), lit(1), c("df2")), p_interaction=p_f(c("f_interaction"), c("df1"), c("df2")))


@query("st13_normality", """m AS (SELECT super_class AS g, count(si)::DOUBLE AS n, avg(si) AS a, avg(si*si) AS b, avg(si*si*si) AS c, avg(si*si*si*si) AS d FROM nsi WHERE super_class IS NOT NULL GROUP BY 1), z AS (SELECT g, n, (c-3*a*b+2*a*a*a)/power(b-a*a,1.5) AS skew, (d-4*a*c+6*a*a*b-3*a*a*a*a)/power(b-a*a,2)-3 AS kurt FROM m) SELECT g AS super_class, round(skew,5) AS skew, round(kurt,5) AS kurt, round(n/6*(skew*skew+kurt*kurt/4),3) AS jarque_bera FROM z""")
def st13(v):
    s, k = F.skewness("si"), F.kurtosis("si")
    return v.nsi.filter(c("super_class").isNotNull()).groupBy("super_class").agg(F.round(s, 5).alias("skew"), F.round(k, 5).alias("kurt"), F.round(F.count("si") / 6 * (s * s + k * k / 4), 3).alias("jarque_bera"))


@query("st14_nb_cells", sql_with(f"{STACK}, cells AS (SELECT syn_type, reciprocal, same_type, count(*) AS n, avg(n) AS m FROM stack WHERE n>=1 GROUP BY ALL) SELECT syn_type, reciprocal, same_type, n, round(m,6) AS mean, round(ln(m) - ln(max(m) FILTER (reciprocal=0 AND same_type=0) OVER (PARTITION BY syn_type)),6) AS log_ratio, round(sqrt((1+m)/(n*m)),6) AS se_log, CASE WHEN reciprocal=0 AND same_type=0 THEN NULL ELSE round(max(sqrt((1+m)/(n*m))) FILTER (reciprocal=0 AND same_type=0) OVER (PARTITION BY syn_type),6) END AS se_base FROM cells", wald_z="r.log_ratio / sqrt(r.se_log * r.se_log + r.se_base * r.se_base)", p=sql_z("r.log_ratio / sqrt(r.se_log * r.se_log + r.se_base * r.se_base)")))
def st14(v):
    from pyspark.sql import Window

    # with every interaction in the model the fitted mean of a cell is the cell's mean; alpha is 1
    k = stacked(v.conn).filter(c("n") >= 1).groupBy("syn_type", "reciprocal", "same_type").agg(n_().alias("k"), F.avg("n").alias("m"))
    first = (c("reciprocal") == 0) & (c("same_type") == 0)
    by = Window.partitionBy("syn_type")
    se = F.sqrt((1 + c("m")) / (c("k") * c("m")))
    base, base_se = F.max(F.when(first, c("m"))).over(by), F.max(F.when(first, se)).over(by)
    out = k.select("syn_type", "reciprocal", "same_type", c("k").alias("n"), r6(c("m")).alias("mean"), r6(F.log("m") - F.log(base)).alias("log_ratio"), r6(se).alias("se_log"),
                   F.when(~first, r6(base_se)).alias("se_base"))
    # against the cell without reciprocity and with another type, whose estimate is independent of the others
    z = F.try_divide(c("log_ratio"), F.sqrt(c("se_log") * c("se_log") + c("se_base") * c("se_base")))
    return with_p(out, wald_z=z, p=p_z(z))


#: Contrasts of the logarithms of a type's four cell means (reciprocal, same type), as signs of (0,0), (0,1), (1,0), (1,1).
CONTRASTS = {"reciprocal": (-1, 0, 1, 0), "same_type": (-1, 1, 0, 0), "interaction": (1, -1, -1, 1), "reciprocal, other types": (-1, 0, 1, 0), "reciprocal, same types": (0, -1, 0, 1)}
#: Terms of the full model beside the first type: the same contrasts of a type less those of AA.
TERMS = {"type": (1, 0, 0, 0)} | {f"{k} x type": CONTRASTS[k] for k in ("reciprocal", "same_type", "interaction")}
BASE = "AA"


def _contrast(signs, of):
    return " + ".join(f"({s}) * {of}{i}" for i, s in enumerate(signs) if s)


def _contrast_sql():
    own = [f"SELECT syn_type, '{k}' AS contrast, {_contrast(s, 'l')} AS e, {_contrast([x * x for x in s], 'v')} AS v FROM t" for k, s in CONTRASTS.items()]
    full = [f"SELECT t.syn_type, '{k}', ({_contrast(s, 't.l')}) - ({_contrast(s, 'b.l')}), {_contrast([x * x for x in s], 't.v')} + {_contrast([x * x for x in s], 'b.v')} FROM t, (FROM t WHERE syn_type = '{BASE}') b WHERE t.syn_type <> '{BASE}'" for k, s in TERMS.items()]
    return " UNION ALL ".join(own + full)


@query("st14b_nb_contrasts", sql_with(f"""{STACK}, cells AS (SELECT syn_type, reciprocal, same_type, ln(avg(n)) AS l, (1+avg(n))/(count(*)*avg(n)) AS v FROM stack WHERE n>=1 GROUP BY ALL),
t AS (SELECT syn_type, {", ".join(f"max({x}) FILTER (reciprocal={i // 2} AND same_type={i % 2}) AS {x}{i}" for x in "lv" for i in range(4))} FROM cells GROUP BY syn_type),
e AS ({_contrast_sql()}), q AS (SELECT syn_type, contrast, round(e,6) AS estimate, round(sqrt(v),6) AS se FROM e) SELECT *, round(estimate/se,6) AS z FROM q""", p=sql_z("r.z")))
def st14b(v):
    """The terms of the negative-binomial models of counts (log link, alpha 1): of a model of each type, of pairs of its cells, and of the model of all types.  All are
    saturated, so a term is a contrast of logarithms of cell means, whose variances are (1 + m) / (n m)."""
    k = stacked(v.conn).filter(c("n") >= 1).groupBy("syn_type", "reciprocal", "same_type").agg(F.log(F.avg("n")).alias("l"), ((1 + F.avg("n")) / (n_() * F.avg("n"))).alias("v"))
    cell = lambda x, i: F.max(F.when((c("reciprocal") == i // 2) & (c("same_type") == i % 2), c(x))).alias(f"{x}{i}")
    t = k.groupBy("syn_type").agg(*[cell(x, i) for x in "lv" for i in range(4)])  # a row a type
    base = F.broadcast(t.filter(c("syn_type") == BASE).select(*[c(f"{x}{i}").alias(f"b{x}{i}") for x in "lv" for i in range(4)]))
    total = lambda signs, of: sum((s * c(f"{of}{i}") for i, s in enumerate(signs) if s), lit(0.0))
    square = lambda signs: [s * s for s in signs]
    own = [F.struct(lit(k).alias("contrast"), total(s, "l").alias("e"), total(square(s), "v").alias("v")) for k, s in CONTRASTS.items()]
    full = [F.struct(lit(k).alias("contrast"), (total(s, "l") - total(s, "bl")).alias("e"), (total(square(s), "v") + total(square(s), "bv")).alias("v")) for k, s in TERMS.items()]
    each = t.select("syn_type", F.explode(F.array(*own)).alias("x")).unionByName(t.filter(c("syn_type") != BASE).crossJoin(base).select("syn_type", F.explode(F.array(*full)).alias("x")))
    out = each.select("syn_type", "x.contrast", r6(c("x.e")).alias("estimate"), r6(F.sqrt("x.v")).alias("se")).withColumn("z", r6(F.try_divide(c("estimate"), c("se"))))
    return with_p(out, p=p_z(c("z")))
