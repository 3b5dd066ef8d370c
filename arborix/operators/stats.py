"""Statistical tests.  The pass over the rows is one or two aggregations; a test is a row of numbers from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborix.functions.ranks import tied_ranks  # noqa: F401

c, div = F.col, F.try_divide  # null, not an error, where all values are equal or too few


def moments(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, var (sample) per group."""
    return rows.filter(c(value).isNotNull() & c(group).isNotNull()).groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def anova(m: DataFrame) -> DataFrame:
    """F, degrees of freedom, sums of squares, eta2 and omega2 from group moments.  omega2 has the denominator total
    plus within, as the analyses that it stands for have."""
    g = m.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), div(F.sum(c("n") * c("mean")), F.sum("n")).alias("grand"),
              F.sum((c("n") - 1) * c("var")).alias("ss_within"), F.sum(c("n") * c("mean") * c("mean")).alias("q"))
    g = g.withColumn("ss_between", c("q") - c("n") * c("grand") * c("grand"))
    ms = div(c("ss_within"), c("n") - c("k"))
    return g.select(div(div(c("ss_between"), c("k") - 1), ms).alias("f"), (c("k") - 1).alias("df1"), (c("n") - c("k")).alias("df2"), "ss_between", "ss_within",
                    div(c("ss_between"), c("ss_between") + c("ss_within")).alias("eta2"),
                    div(c("ss_between") - (c("k") - 1) * ms, c("ss_between") + 2 * c("ss_within")).alias("omega2"))


def welch_anova(m: DataFrame) -> DataFrame:
    w = m.withColumn("w", div(c("n"), c("var")))  # null where all values are equal: no test then
    tot = Window.partitionBy()
    w = w.withColumn("sw", F.sum("w").over(tot)).withColumn("k", F.count(F.lit(1)).over(tot)).withColumn("gm", F.sum(c("w") * c("mean")).over(tot) / c("sw"))
    a = w.agg(F.max("k").alias("k"), F.sum(c("w") * (c("mean") - c("gm")) * (c("mean") - c("gm"))).alias("a"),
              F.sum(div((1 - div(c("w"), c("sw"))) * (1 - div(c("w"), c("sw"))), c("n") - 1)).alias("h"))
    k = c("k")
    return a.select(div(div(c("a"), k - 1), 1 + div(2 * (k - 2) * c("h"), k * k - 1)).alias("f"), (k - 1).alias("df1"), div(k * k - 1, 3 * c("h")).alias("df2"))


def rank_sums(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n and rank sum per group, with the size of all and the tie term sum(t^3 - t)."""
    rows = rows.filter(c(value).isNotNull() & c(group).isNotNull()).select(group, value)
    ties = rows.groupBy(value).agg(F.count(F.lit(1)).alias("t")).agg(F.sum(c("t").cast("double") * c("t") * c("t") - c("t")).alias("ties"))
    g = tied_ranks(rows, value).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("tied_rank").alias("r"))
    return g.withColumn("total", F.sum("n").over(Window.partitionBy())).crossJoin(F.broadcast(ties))  # one row


def kruskal(r: DataFrame) -> DataFrame:
    g = r.agg(F.sum(c("r") * c("r") / c("n")).alias("q"), F.max("total").alias("n"), F.count(F.lit(1)).alias("k"), F.max("ties").alias("ties"))
    n = c("n")
    h = div(12 / (n * (n + 1)) * c("q") - 3 * (n + 1), 1 - div(c("ties"), n.cast("double") * n * n - n))
    return g.select(h.alias("h"), (c("k") - 1).alias("df"), div(h - c("k") + 1, n - c("k")).alias("eta2"))


def pairs_of(groups: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Unordered pairs of group rows (there is one row a group), suffixed _a and _b."""
    a = groups.select(*[c(x).alias(f"{x}_a") for x in [key, *columns]], F.lit(1).alias("__one"))
    b = groups.select(*[c(x).alias(f"{x}_b") for x in [key, *columns]], F.lit(1).alias("__one"))
    return a.join(b, "__one").filter(c(f"{key}_a") < c(f"{key}_b")).drop("__one")
