"""Reading and writing of the file forms that the data come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.functions import expr

CONTACTS = "pre bigint, post bigint, pre_x double, pre_y double, pre_z double, post_x double, post_y double, post_z double, size bigint, npil string"


def read_contacts(spark: SparkSession, path: str, schema: str = CONTACTS) -> DataFrame:
    """Contacts from CSV with a header; ids are suffixes and stay 64-bit."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_columns(spark: SparkSession, path: str, schema: str, columns: dict[str, str]) -> DataFrame:
    """Chosen columns of a CSV under new names; the reader parses only these."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.select(*[F.col(a).alias(b) for a, b in columns.items()])


def read_skeletons(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    """All .swc files under a folder as one table; the neuron is the file's name.  ``separator="," `` for the comma form."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.swc").text(path)
    rows = rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).cast("bigint").alias("neuron"), F.trim("value").alias("line"))
    p = F.split("line", separator)
    at = lambda i, kind: F.get(p, i).cast(kind)
    return rows.filter((F.col("line") != "") & ~F.col("line").startswith("#")).select(
        "neuron", at(0, "bigint").alias("node_id"), at(1, "int").alias("label"), at(2, "double").alias("x"), at(3, "double").alias("y"),
        at(4, "double").alias("z"), at(5, "double").alias("radius"), at(6, "bigint").alias("parent_id"))


def read_ranks(spark: SparkSession, path: str, modalities: list[str]) -> DataFrame:
    """Parquet files of one modality each, named after it: root_id and <modality>_layer of all, by root_id."""
    rows = spark.read.parquet(f"{path}/*.parquet").withColumn("modality", F.regexp_extract(F.col("_metadata.file_name"), r"^(\w+?)_rank", 1))
    out = rows.groupBy("root_id").pivot("modality", modalities).agg(F.first("layer_mean"))
    return out.select("root_id", *[F.col(m).alias(f"{m}_layer") for m in modalities])


def new_batches(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of batches that the output doesn't hold yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def add_batches(inputs: DataFrame, path: str, key: str) -> None:
    """Writes rows to a table with a folder for each value of ``key``: the folders of values among the rows are replaced, the others stay, so a batch that is
    written again leaves the table as it was."""
    inputs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def voxel(x: Column, size: int) -> Column:
    return (x / size).cast("bigint")


#: The scales in which points are exported.
SCALES = {"full": 1.0, "half": 2.0, "quarter": 4.0, "eighth": 8.0}


def point_export(contacts: DataFrame, neuron: int, other: int | None = None) -> DataFrame:
    """Points of a neuron's contacts (or of those that it shares with another) in voxels (x/4, y/4, z/40, truncated) at four scales, with
    the fixed columns of an annotation layer."""
    mine = (F.col("pre") == neuron) | (F.col("post") == neuron)
    if other is not None:
        mine = ((F.col("pre") == neuron) & (F.col("post") == other)) | ((F.col("pre") == other) & (F.col("post") == neuron))
    rows = contacts.filter(mine).withColumn("role", F.when(F.col("pre") == neuron, "pre").otherwise("post"))
    scales = F.explode(F.array(*[F.struct(F.lit(n).alias("scale"), F.lit(s).alias("s")) for n, s in SCALES.items()]))
    rows = rows.withColumn("k", scales)
    return rows.select("role", F.col("k.scale").alias("scale"), voxel(F.col("pre_x") / F.col("k.s"), 4).alias("x"), voxel(F.col("pre_y") / F.col("k.s"), 4).alias("y"),
                       voxel(F.col("pre_z") / F.col("k.s"), 40).alias("z"), F.lit("sphere").alias("shape"), F.lit(50).alias("radius"), expr.full_id(F.col("pre")).alias("segment"))
