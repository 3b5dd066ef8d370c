"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import running_sum, small, stored, text_or_empty, word_count

#: Words of a block: the unit that a slot of the schedule hands out.
BLOCK = 256
#: Cells of the unit interval by which points of the schedule meet their source.
CELLS = 4096
#: Slots of one source are ranked in runs of so many consecutive slots of the schedule.
RUN = 1 << 12
BUCKETS = 1024
GOLDEN = 0.6180339887498949


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Per source (null is one): source_size, weight, target.

    Sources in order of their code points, null last, take the weights in turn and share ``share`` of
    all sizes; a target stops at ``most`` times its source's size and the excess goes by weight to the
    rest.  In order of size per weight, those below the final water level are the capped ones."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pos = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (pos % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight)
    level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    rest = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    cap = F.col("source_size") * F.lit(float(most))
    per = (per.withColumn("__cap", cap)
           .withColumn("__level", (total - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)))
    # the level that holds is the one at the first source that it doesn't fill
    free = F.col("__level") * F.col("weight") <= F.col("__cap")
    return (per.withColumn("__level", F.first(F.when(free, F.col("__level")), ignorenulls=True).over(
                level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            .withColumn("target", F.when((F.col("__level") * F.col("weight")) <= F.col("__cap"),
                                         F.col("__level") * F.col("weight")).otherwise(F.col("__cap")))
            .select("source", "source_size", "weight", "target"))


def _unit(key: Column) -> Column:
    """Where a document stands in its source's shuffled line: 32 bits of MD5."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")


def schedule(spark: SparkSession, per: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots of the mix in their order: slot, source, rank (within the source), lo, hi (the words of
    the source's line that it hands out; the line runs on into a second round of the source).

    Slot i stands at the golden-ratio point frac((i + 1) * 0.618...), and the source whose part of the
    unit interval (parts in proportion to targets) holds the point has the slot.  The points leave
    each source within a few blocks of its target; surplus slots are dropped and missing ones follow at
    the end, the last cut, so that each source gets its target in whole words."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    all_ = F.sum("target").over(Window.partitionBy())
    upto = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = stored(per.withColumn("__hi", upto / all_)
                   .withColumn("__lo", F.coalesce(F.lag("__hi").over(order), F.lit(0.0)))
                   .withColumn("__last", F.lead("weight").over(order).isNull())
                   .withColumn("__hi", F.when(F.col("__last"), 2.0).otherwise(F.col("__hi")))
                   .withColumn("__id", F.row_number().over(order)), "mix-sources")
    parts = parts.withColumn("__words", F.floor("target").cast("bigint"))
    got = parts.agg(F.sum("target").alias("t")).first()["t"] or 0.0
    cells = parts.filter(F.col("__hi") > F.col("__lo")).select(
        "__id", "__lo", "__hi", F.explode(F.sequence(
            F.least(F.floor(F.col("__lo") * CELLS), F.lit(CELLS - 1)).cast("int"),
            F.least(F.floor(F.col("__hi") * CELLS), F.lit(CELLS - 1)).cast("int"))).alias("__cell"))
    count = max(0, round(got / block))
    slots = spark.range(count).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(GOLDEN) % 1.0).alias("__u"))
    slots = slots.withColumn("__cell", F.least(F.floor(F.col("__u") * CELLS), F.lit(CELLS - 1)).cast("int"))
    held = (slots.join(small(cells), "__cell").filter((F.col("__lo") <= F.col("__u")) & (F.col("__u") < F.col("__hi")))
            .select("slot", "__id", F.floor(F.col("slot") / RUN).alias("__run"), F.lit(1).cast("bigint").alias("__one")))
    ranked = running_sum(held, ["__id"], "__run", [F.col("slot")], "__one", "rank").select("slot", "__id", "rank")
    need = F.ceil(F.col("__words") / block).cast("bigint")
    given = held.groupBy("__id").agg(F.count(F.lit(1)).alias("__given"))
    missing = (parts.join(given, "__id", "left")
               .withColumn("__given", F.coalesce(F.col("__given"), F.lit(0).cast("bigint")))
               .filter(need > F.col("__given"))
               .select(F.explode(F.sequence(F.col("__given"), need - 1)).alias("rank"), "__id")
               .select((F.lit(count) + F.col("rank")).cast("bigint").alias("slot"), "__id", "rank"))
    src = small(parts.select("__id", "source", "__words"))
    return (ranked.unionByName(missing).join(src, "__id")
            .withColumn("lo", F.col("rank") * block)
            .withColumn("hi", F.least(F.col("lo") + block, F.col("__words")))
            .filter(F.col("hi") > F.col("lo"))
            .select("slot", "source", "rank", "lo", "hi", F.col("__id").alias("source_no")))


def mix(docs: DataFrame, weights: list[float], share: float, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, size (words), source, source_size, target, taken (words that the mix takes), first_slot and n_slots (the
    slots of the schedule that hand out words of it: the first one, null if there is none, and their number).

    Each source's documents, shuffled by a hash of doc_id, lie end to end on a line cut into equal
    blocks; slots of the schedule take the blocks in order, once round and then a second time, so no
    document gives more than ``most`` (2 at most) times its size.  Null text: size 0, taken 0.  A null
    source is a source.  Repeated rows each have their place on the line.  A source without words has
    target 0.  An empty table gives an empty result.  Only doc_id, text and source are read."""
    if not 0 < most <= 2:
        raise ValueError("a source is gone through twice at most")
    spark = docs.sparkSession
    sizes = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"),
                               word_count(text_or_empty()).alias("size")), "mix-sizes")
    per = stored(targets(sizes, weights, share, most), "mix-targets")
    slots = schedule(spark, per, block).select("slot", "rank", "lo", "hi", "source_no")
    placed = (sizes.withColumn("__unit", _unit(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
              .withColumn("__bucket", F.floor(F.col("__unit") / ((1 << 32) // BUCKETS)).cast("int")))
    placed = running_sum(placed, ["source"], "__bucket",
                         [F.col("__unit"), F.col("doc_id").asc_nulls_last(), F.col("size")], "size", "__at")
    numbered = small(per.select(F.col("source").alias("__source"), "source_size", "target",
                                F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("source_no")))
    placed = stored(placed.join(numbered, F.col("source").eqNullSafe(F.col("__source")), "left")
                    .select("doc_id", "size", "source", "source_size", "target", "source_no", "__at",
                            F.monotonically_increasing_id().alias("__row")), "mix-line")
    pieces = (placed.filter(F.col("size") > 0)
              .select("__row", "source_no", "size", F.explode(F.array(F.col("__at"), F.col("__at") + F.col("source_size"))).alias("__from"))
              .withColumn("__to", F.col("__from") + F.col("size"))
              .withColumn("rank", F.explode(F.sequence(F.floor(F.col("__from") / block), F.floor((F.col("__to") - 1) / block)))))
    taken = (pieces.join(slots, ["source_no", "rank"])
             .withColumn("__n", F.least("__to", "hi") - F.greatest("__from", "lo"))
             .filter(F.col("__n") > 0).groupBy("__row")
             .agg(F.sum("__n").alias("taken"), F.min("slot").alias("first_slot"), F.count_distinct("slot").alias("n_slots")))
    return (placed.join(taken, "__row", "left")
            .select("doc_id", "size", "source", "source_size", "target",
                    F.coalesce(F.col("taken"), F.lit(0)).cast("bigint").alias("taken"),
                    "first_slot", F.coalesce(F.col("n_slots"), F.lit(0)).cast("bigint").alias("n_slots")))
