"""Joins beyond equality: nearest and radius joins by grid cells, membership, and as-of look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborix.functions.lineage import stored


def members(rows: DataFrame, ids: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Rows of which any of ``columns`` is in ids.  A left join for each column, not an OR condition, which would be a nested loop."""
    flag = [rows[c].isNotNull() for c in columns]
    out = rows
    for i, c in enumerate(columns):
        side = ids.select(F.col(key).alias(f"__m{i}")).distinct()
        out = out.join(side, F.col(c) == F.col(f"__m{i}"), "left")
        flag[i] = F.col(f"__m{i}").isNotNull()
    hit = flag[0]
    for f in flag[1:]:
        hit = hit | f
    return out.filter(hit).drop(*[f"__m{i}" for i in range(len(columns))])


def grid_pairs(left: DataFrame, right: DataFrame, group: str, radius: float, left_xyz: list[str], right_xyz: list[str],
               strict: bool = False, apart: tuple[str, str] | None = None) -> DataFrame:
    """Pairs of the same group whose points are within ``radius`` (or nearer, if strict), with their distance; of those, with
    ``apart``, the ones in which a left and a right column differ.

    Space is cut into cells twice as wide as the radius.  A right point, of which there should be the fewer, goes to the cells that its ball
    reaches, eight at most; a left point looks into its own cell, so the join is on equality of (group, cell) and finds a pair once.  Column names
    of the two sides must differ but for the group.  Spark judges a side's size before it is exploded, so the join is told not to broadcast it."""
    wide, reach = 2 * radius, radius * (1 + 1e-9)
    a = left.withColumns({f"__k{i}": F.floor(F.col(x) / wide) for i, x in enumerate(left_xyz)})
    b = right.withColumnRenamed(group, "__group")
    gap2 = F.lit(0.0)
    for i, x in enumerate(right_xyz):
        q = F.col(x)
        b = b.withColumn(f"__j{i}", F.explode(F.sequence(F.floor((q - reach) / wide), F.floor((q + reach) / wide))))
        gap = F.greatest(F.col(f"__j{i}") * wide - q, q - (F.col(f"__j{i}") + 1) * wide, F.lit(0.0))
        gap2 = gap2 + gap * gap
        b = b.filter(gap2 <= reach * reach)
    on = F.col(group) == F.col("__group")
    for i in range(3):
        on = on & (F.col(f"__k{i}") == F.col(f"__j{i}"))
    d2 = sum(((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(left_xyz, right_xyz, strict=True)), F.lit(0.0))
    out = a.join(b.hint("merge"), on).withColumn("distance", F.sqrt(d2))
    near = F.col("distance") < radius if strict else F.col("distance") <= radius
    if apart:
        near = near & (F.col(apart[0]) != F.col(apart[1]))
    return out.filter(near).drop("__group", *[f"__{x}{i}" for x in "kj" for i in range(3)])


def group_gaps(points: DataFrame, group: str, label: str, xyz: list[str], gap: float) -> DataFrame:
    """group, c1 < c2, distance: pairs of labels of a group whose nearest points are nearer to one another than ``gap``.

    A label's points are boxed by cells half as wide as the gap.  Two labels' nearest points lie in boxes that can be as near as the nearest box pair must be, so
    the points of all other box pairs are never looked at."""
    c, width = F.col, gap / 2
    cell = [F.floor(c(x) / width) for x in xyz]
    points = points.select(group, label, *xyz).dropDuplicates().withColumn("__box", F.struct(*[x.alias(f"b{i}") for i, x in enumerate(cell)]))
    boxes = points.groupBy(group, label, "__box").agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(xyz) for n, f in (("lo", F.min), ("hi", F.max))])
    boxes = stored(boxes.withColumns({f"m{i}": (c(f"lo{i}") + c(f"hi{i}")) / 2 for i in range(3)}), "gap-boxes")
    side = lambda s: boxes.select(group, c(label).alias(f"c{s}"), c("__box").alias(f"box{s}"), *[c(f"{n}{i}").alias(f"{n}{i}_{s}") for n in ("lo", "hi", "m") for i in range(3)])
    pairs = grid_pairs(side(1), side(2), group, gap + width * 3 ** 0.5, [f"m{i}_1" for i in range(3)], [f"m{i}_2" for i in range(3)]).filter(c("c1") < c("c2"))
    least = sum((F.pow(F.greatest(c(f"lo{i}_1") - c(f"hi{i}_2"), c(f"lo{i}_2") - c(f"hi{i}_1"), F.lit(0.0)), 2) for i in range(3)), F.lit(0.0))
    most = sum((F.pow(F.greatest(c(f"hi{i}_1") - c(f"lo{i}_2"), c(f"hi{i}_2") - c(f"lo{i}_1")), 2) for i in range(3)), F.lit(0.0))
    pairs = pairs.select(group, "c1", "c2", "box1", "box2", F.sqrt(least).alias("least"), F.sqrt(most).alias("most")).filter(c("least") < gap)
    best = F.min("most").over(Window.partitionBy(group, "c1", "c2"))
    pairs = pairs.withColumn("best", best).filter(c("least") <= c("best") * (1 + 1e-9)).select(group, "c1", "c2", "box1", "box2")
    for s in (1, 2):
        p = points.select(group, c(label).alias(f"c{s}"), c("__box").alias(f"box{s}"), *[c(x).alias(f"p{i}_{s}") for i, x in enumerate(xyz)])
        pairs = pairs.join(p, [group, f"c{s}", f"box{s}"])
    d = F.sqrt(sum(((c(f"p{i}_1") - c(f"p{i}_2")) * (c(f"p{i}_1") - c(f"p{i}_2")) for i in range(3)), F.lit(0.0)))
    return pairs.groupBy(group, "c1", "c2").agg(F.min(d).alias("distance")).filter(c("distance") < gap)


def nearest(left: DataFrame, right: DataFrame, group: str, key: str, node: str, left_xyz: list[str], right_xyz: list[str],
            radii: list[float], strict: bool = False) -> DataFrame:
    """``key`` of each left row with the nearest right row of its group within the last radius: node and distance;
    equally near ones: the lowest node.  What a small radius leaves unmatched goes on to the next."""
    found = None
    rest = left.select(group, key, *left_xyz)
    target = right.select(group, node, *right_xyz)
    for r in radii:
        pairs = grid_pairs(rest, target, group, r, left_xyz, right_xyz, strict)
        best = pairs.groupBy(group, key).agg(F.min(F.struct("distance", node)).alias("m")).select(group, key, F.col(f"m.{node}").alias(node), "m.distance")
        if r != radii[-1]:
            best = stored(best, "nearest")
            rest = rest.join(best.select(key), key, "left_anti")
        found = best if found is None else found.unionByName(best)
    return found


def value_at(points: DataFrame, point: str, rows: DataFrame, x: str, value: str) -> DataFrame:
    """For each point (a given list, a thousand at most) the value of the row whose x is nearest (ties: the lowest x): point, nearest, value.

    Between two neighbouring points only the rows of least and of greatest x can be nearest to any, so these, one aggregation, are all that is looked at."""
    at = sorted({r[0] for r in points.select(point).limit(1001).collect()})
    if len(at) > 1000:
        raise ValueError("too many points for a list")
    c = F.col
    cell = F.lit(0)
    for p in at:
        cell = cell + (c(x) >= F.lit(p)).cast("int")
    ends = rows.filter(c(x).isNotNull()).groupBy(cell.alias("cell")).agg(*[F.struct(f(x).alias("x"), g(value, x).alias("v")).alias(n) for n, f, g in (("lo", F.min, F.min_by), ("hi", F.max, F.max_by))])
    ends = ends.select(F.explode(F.array("lo", "hi")).alias("e")).select("e.*")  # two rows a cell
    best = F.min(F.struct(F.abs(c("x") - c(point)).alias("d"), c("x"), c("v")))
    return ends.crossJoin(F.broadcast(points)).groupBy(point).agg(best.alias("m")).select(point, c("m.x").alias("nearest"), c("m.v").alias("value"))
