"""Running sums, tied ranks and exact quantiles without a task that holds a whole table or group.

Rows are dealt by ranges of the order, whose bounds Spark samples; sums run inside each range, and the totals of the ranges before, a row a range, are
added.  Rows of equal value are counted first, so a common value is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborix.functions.lineage import stored

c, lit = F.col, F.lit
#: percentile_approx keeps ranks to one part in so many.
ACCURACY = 10_000


def _same(a: list[str], b: list[str]) -> Column:
    cond = lit(True)
    for x, y in zip(a, b, strict=True):
        cond = cond & c(x).eqNullSafe(c(y))
    return cond


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each of ``sums``, the sum over the rows of the same ``by`` that come before in ``order`` (rows that are equal in it: any way, but
    the same in all)."""
    made = rows.withColumns({f"__v{i}": e for i, e in enumerate(sums.values())})
    made = stored(made.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()), "running")
    inside = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"__b{i}" for i in range(len(by))]
    totals = made.groupBy(*by, "__range").agg(*[F.sum(f"__v{i}").alias(f"__t{i}") for i in range(len(sums))])  # a row a range and group
    totals = totals.select(*[c(x).alias(y) for x, y in zip(by, names, strict=True)], c("__range").alias("__r"), *[F.coalesce(F.sum(f"__t{i}").over(ahead), lit(0)).alias(f"__a{i}") for i in range(len(sums))])
    out = made.withColumns({f"__s{i}": F.coalesce(F.sum(f"__v{i}").over(inside), lit(0)) for i in range(len(sums))})
    out = out.join(totals, (c("__range") == c("__r")) & _same(by, names))
    return out.withColumns({n: c(f"__s{i}") + c(f"__a{i}") for i, n in enumerate(sums)}).select(*rows.columns, *sums)


def tied_ranks(rows: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """Adds tied_rank: the mean of the places that equal values take, in each group.  Rows without a value go."""
    keys = list(group or [])
    n = rows.filter(c(value).isNotNull()).groupBy(*keys, value).agg(F.count(lit(1)).alias("__n"))
    n = running(n, keys, [value], {"__before": c("__n")})
    n = n.select(*[c(k).alias(f"__k{i}") for i, k in enumerate(keys)], c(value).alias("__value"), (c("__before") + (c("__n") + 1) / 2).alias("tied_rank"))
    return rows.join(n, (c(value) == c("__value")) & _same(keys, [f"__k{i}" for i in range(len(keys))])).drop("__value", *[f"__k{i}" for i in range(len(keys))])


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by, q0, q1, ...: the exact quantiles of ``value``, between neighbouring values in proportion; null where there are none.

    An approximate quantile a little below and one a little above, whose errors are bounded, enclose the places wanted.  What lies below is counted; the few
    values between are ordered."""
    keys = rows.select(*by).distinct() if by else None
    x = rows.select(*by, c(value).cast("double").alias("v")).filter(c("v").isNotNull())
    slack = 2 / ACCURACY
    probes = [p for q in shares for p in (max(0.0, q - slack), min(1.0, q + slack))]
    s = x.groupBy(*by).agg(F.count(lit(1)).alias("n"), F.percentile_approx("v", [float(p) for p in probes], ACCURACY).alias("p"))
    s = stored(s.filter("n > 0"), "quantile-brackets").withColumnsRenamed({b: f"__g{i}" for i, b in enumerate(by)})
    names = [f"__g{i}" for i in range(len(by))]
    # the ends of the range stand for themselves, and in few rows, where a place or two is a large share, all may be wanted
    many = c("n") > 5 * ACCURACY
    low = [F.when(many, c("p")[2 * j]).otherwise(float("-inf")) if q - slack > 0 else lit(float("-inf")) for j, q in enumerate(shares)]
    high = [F.when(many, c("p")[2 * j + 1]).otherwise(float("inf")) if q + slack < 1 else lit(float("inf")) for j, q in enumerate(shares)]
    x = x.join(s, _same(by, names)) if by else x.crossJoin(F.broadcast(s))  # one row
    below = x.groupBy(*by).agg(F.max("n").alias("n"), *[F.count_if(c("v") < lo).alias(f"b{j}") for j, lo in enumerate(low)])
    inside = F.filter(F.array(*[F.when((c("v") >= lo) & (c("v") <= hi), lit(j)) for j, (lo, hi) in enumerate(zip(low, high, strict=True))]), lambda j: j.isNotNull())
    t = x.select(*by, "v", F.explode(inside).alias("j")).groupBy(*by, "j", "v").agg(F.count(lit(1)).alias("k"))
    t = running(t, [*by, "j"], ["v"], {"__before": c("k")})
    below = below.withColumnsRenamed({b: f"__g{i}" for i, b in enumerate(by)})
    t = t.join(below, _same(by, names)) if by else t.crossJoin(F.broadcast(below))  # one row
    first = c("__before") + F.array(*[c(f"b{j}") for j in range(len(shares))])[c("j")]
    at = F.array(*[lit(float(q)) for q in shares])[c("j")] * (c("n") - 1)
    t = t.withColumns({"__from": first, "__to": first + c("k"), "__at": at})
    holds = lambda place: F.max(F.when((c("__from") <= place) & (place < c("__to")), c("v")))
    place = F.floor("__at")
    t = t.groupBy(*by, "j").agg(holds(place).alias("lo"), holds(F.least(place + 1, c("n") - 1)).alias("hi"), F.max(c("__at") - place).alias("w"))
    q = c("lo") + (c("hi") - c("lo")) * c("w")
    out = t.groupBy(*by).agg(*[F.max(F.when(c("j") == j, q)).alias(f"q{j}") for j in range(len(shares))])
    if not by:
        return out
    return keys.withColumnsRenamed({b: f"__g{i}" for i, b in enumerate(by)}).join(out, _same(by, names), "left").select(*[c(f"__g{i}").alias(b) for i, b in enumerate(by)], *[f"q{j}" for j in range(len(shares))])
