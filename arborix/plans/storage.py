"""Queries that write a table in some form and read it again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from arborix.functions.lineage import shared_dir, stored
from arborix.operators import tables
from arborix.plans.registry import query
from arborix.sources import files
from arborix.sources.arrow_files import register

c, lit = F.col, F.lit


def n_():
    return F.count(lit(1))


BASIC = ["pre", "post", "pre_x", "pre_y", "pre_z", "post_x", "post_y", "post_z", "size", "npil"]
BASIC_SQL = "SELECT pre, post, round(pre_x,6) AS pre_x, round(pre_z,6) AS pre_z, size, npil FROM syn_self"


def folder(v, label):
    return f"{shared_dir(v.spark)}/{label}-{uuid.uuid4().hex}"


def csv_copy(v):
    path = folder(v, "contacts-csv")
    v.syn_self.select(*BASIC).write.option("header", True).csv(path)
    return path


@query("src1_csv_facts", BASIC_SQL)
def src1(v):
    return files.read_contacts(v.spark, csv_copy(v)).select("pre", "post", F.round("pre_x", 6).alias("pre_x"), F.round("pre_z", 6).alias("pre_z"), "size", "npil")


@query("src2_csv_columns", "SELECT pre AS origin, post AS target, npil AS region FROM syn_self")
def src2(v):
    return files.read_columns(v.spark, csv_copy(v), files.CONTACTS, {"pre": "origin", "post": "target", "npil": "region"})


@query("src3_csv_dimension", "SELECT s.pre, n.super_class, count(*) AS n FROM syn s JOIN neurons n ON n.neuron=s.pre GROUP BY ALL")
def src3(v):
    path = folder(v, "neurons-csv")
    v.neurons.select("neuron", "super_class").write.option("header", True).csv(path)
    dim = v.spark.read.schema("neuron bigint, super_class string").option("header", True).csv(path)
    return v.syn.join(dim, c("pre") == c("neuron")).groupBy("pre", "super_class").agg(n_().alias("n"))


@query("src4_columnar_scan", "SELECT npil, sum(size)::BIGINT AS total FROM syn GROUP BY npil")
def src4(v):
    """From Feather files, of which two columns are read."""
    register(v.spark)
    path = folder(v, "contacts-feather")
    v.syn.select("pre", "post", "pre_x", "npil", "size").write.format("arrow_ipc").mode("append").save(path)
    return v.spark.read.format("arrow_ipc").option("columns", "npil,size").load(path).groupBy("npil").agg(F.sum("size").alias("total"))


@query("src5_ranked_files", " SELECT neuron AS root_id, avg(o_totalprice) FILTER (m=0)::DECIMAL(18,4)::DOUBLE AS visual_layer, avg(o_totalprice) FILTER (m=1)::DECIMAL(18,4)::DOUBLE AS olfactory_layer FROM (SELECT o_custkey % (SELECT k FROM k) AS neuron, o_orderkey % 2 AS m, o_totalprice FROM orders, k) GROUP BY 1")
def src5(v):
    path = folder(v, "ranks")
    rows = v.table("orders").select((c("o_custkey") % v.k).alias("root_id"), (c("o_orderkey") % 2).alias("m"), "o_totalprice")
    jvm = v.spark.sparkContext._jvm
    for m, name in enumerate(["visual", "olfactory"]):
        rows.filter(c("m") == m).groupBy("root_id").agg(F.avg("o_totalprice").alias("layer_mean")).coalesce(1).write.parquet(f"{path}/{name}")
        here = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        fs = here.getFileSystem(v.spark.sparkContext._jsc.hadoopConfiguration())
        part = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/part-*"))[0].getPath()
        fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{path}/{name}_rank.parquet"))
    out = files.read_ranks(v.spark, path, ["visual", "olfactory"])
    return out.select("root_id", *[F.round(f"{m}_layer", 4).alias(f"{m}_layer") for m in ("visual", "olfactory")])


def swc_copy(v, separator=" "):
    path = folder(v, "swc")
    cols = F.concat_ws(separator, "node_id", lit("0"), *[F.format_string("%.4f", c(a)) for a in "xyz"], lit("1.0"), "parent_id")
    rows = v.skeleton.select("neuron", "node_id", cols.alias("value")).repartition("neuron").sortWithinPartitions("neuron", "node_id")
    rows.select("neuron", "value").write.partitionBy("neuron").text(path)
    # the writer names folders neuron=<id>; the reader goes by file names, so files take the folder's number
    jvm = v.spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(v.spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/neuron=*/part-*")):
        p = s.getPath()
        fs.rename(p, jvm.org.apache.hadoop.fs.Path(p.getParent(), p.getParent().getName().split("=")[1] + ".swc"))
    return path


SWC_SQL = "SELECT neuron, node_id, round(x,3) AS x, round(y,3) AS y, parent_id FROM skeleton"


@query("src6_skeleton_files", SWC_SQL)
def src6(v):
    return files.read_skeletons(v.spark, swc_copy(v)).select("neuron", "node_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "parent_id")


@query("src7_skeleton_commas", SWC_SQL)
def src7(v):
    return files.read_skeletons(v.spark, swc_copy(v, ","), ",").select("neuron", "node_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "parent_id")


@query("src8_batch_union", "SELECT pre % 4 AS batch, count(*) AS n, sum(size)::BIGINT AS total FROM syn GROUP BY 1")
def src8(v):
    path = folder(v, "batches")
    v.syn.withColumn("batch", c("pre") % 4).write.partitionBy("batch").parquet(path)
    return v.spark.read.parquet(path).groupBy(c("batch").cast("bigint").alias("batch")).agg(n_().alias("n"), F.sum("size").alias("total"))


@query("src9_new_batches", "SELECT pre % 4 AS batch, pre % 4 IN (2, 3) AS new, count(*) AS n, sum(size)::BIGINT AS total FROM syn GROUP BY ALL")
def src9(v):
    """Batches 0 and 1 are written, 1 twice; then those that the table lacks; new: which these are."""
    path = folder(v, "done")
    rows = v.syn.withColumn("batch", c("pre") % 4)
    files.add_batches(rows.filter(c("batch") < 2), path, "batch")
    files.add_batches(rows.filter(c("batch") == 1), path, "batch")
    done = v.spark.read.parquet(path).select(c("batch").cast("bigint").alias("batch"))
    new = stored(files.new_batches(rows, done, "batch"), "new-batches")
    files.add_batches(new, path, "batch")
    had = F.broadcast(new.select("batch").distinct().withColumn("new", lit(True)))  # a row a batch
    out = v.spark.read.parquet(path).withColumn("batch", c("batch").cast("bigint")).join(had, "batch", "left")
    return out.groupBy("batch", F.coalesce("new", lit(False)).alias("new")).agg(n_().alias("n"), F.sum("size").alias("total"))


@query("snk1_bucketed_table", "SELECT pre, post, sum_syn, reciprocal FROM conn")
def snk1(v):
    name = f"connections_{uuid.uuid4().hex}"
    v.conn.select("pre", "post", "sum_syn", "reciprocal").write.bucketBy(8, "pre", "post").sortBy("pre", "post").option("path", folder(v, name)).saveAsTable(name)
    return v.spark.table(name)


@query("snk2_csv_write", "SELECT pre, post, sum_syn FROM conn0")
def snk2(v):
    path = folder(v, "connections-csv")
    tables.type_counts(v.typed).select("pre", "post", "sum_syn").write.option("header", True).csv(path)
    return v.spark.read.schema("pre bigint, post bigint, sum_syn bigint").option("header", True).csv(path)


@query("snk3_point_export", """SELECT CASE WHEN pre=3 THEN 'pre' ELSE 'post' END AS role, s.scale, trunc(pre_x/s.s/4)::BIGINT AS x, trunc(pre_y/s.s/4)::BIGINT AS y, trunc(pre_z/s.s/40)::BIGINT AS z, 'sphere' AS shape, 50 AS radius, ('720575940' || pre)::BIGINT AS segment
 FROM syn, (VALUES ('full',1.0::DOUBLE),('half',2.0::DOUBLE),('quarter',4.0::DOUBLE),('eighth',8.0::DOUBLE)) s(scale, s) WHERE pre=3 OR post=3""")
def snk3(v):
    path = folder(v, "points")
    out = files.point_export(v.syn, 3)
    out.write.partitionBy("role", "scale").option("header", True).csv(path)
    return v.spark.read.schema("x bigint, y bigint, z bigint, shape string, radius int, segment bigint, role string, scale string").option("header", True).csv(path).select(*out.columns)
