"""Running numbers and rolling means that don't gather a table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, bucket: Column, order: list[Column], out: str, start: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the place of each row in (bucket, order), from ``start``, among those of the same non-null ``by``.  Buckets follow the
    order; rows are numbered inside each, and the sizes of the buckets before are added."""
    inside = Window.partitionBy(*by, "__b").orderBy(*order)
    rows = rows.withColumn("__b", bucket)
    sizes = rows.groupBy(*[F.col(x).alias(f"__by{i}") for i, x in enumerate(by)], F.col("__b").alias("__k")).count()
    keys = [f"__by{i}" for i in range(len(by))]
    ahead = Window.partitionBy(*keys).orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "__k", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("__ahead"))
    same = [F.col("__b") == F.col("__k"), *[F.col(x) == F.col(k) for x, k in zip(by, keys, strict=True)]]
    return (rows.withColumn("__n", F.row_number().over(inside)).join(sizes, same)
            .withColumn(out, (F.col("__n") + F.col("__ahead") - 1 + start).cast("bigint")).drop("__b", "__k", "__n", "__ahead", *keys))


def rolling_mean(rows: DataFrame, value: str, place: str, width: int, buckets: int) -> DataFrame:
    """Adds ``rolling``: the mean of ``value`` over the row and the width - 1 before it by ``place`` (0, 1, ...; gapless),
    null until there are so many.  Rows are dealt by runs of places; each run also gets the rows just before it."""
    run = F.lit(max(width, buckets))
    own = rows.withColumn("__run", F.floor(F.col(place) / run)).withColumn("__own", F.lit(True))
    halo = rows.filter(F.col(place) % run >= run - (width - 1)).withColumn("__run", F.floor(F.col(place) / run) + 1).withColumn("__own", F.lit(False))
    w = Window.partitionBy("__run").orderBy(place).rowsBetween(-(width - 1), 0)
    out = own.unionByName(halo).withColumn("rolling", F.when(F.count(F.lit(1)).over(w) == width, F.avg(value).over(w)))
    return out.filter("__own").drop("__run", "__own")
