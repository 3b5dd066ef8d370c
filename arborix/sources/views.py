"""The contact, neuron and skeleton tables that the queries run on, as views of the TPC-H-like tables.

Each view exists twice: as a DataFrame (attributes of ``Views``) and as DuckDB SQL (``CTES``)."""

from __future__ import annotations

import math
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.functions.lineage import by_count
from arborix.operators import tables

#: Rows of one shared id domain of pre and post neurons, from the number of orders.
DOMAIN = 26.67
# How market segments stand for super classes, and nation keys for transmitters.
SUPER_CLASS = {"BUILDING": "central", "AUTOMOBILE": "optic", "MACHINERY": "visual_projection",
               "HOUSEHOLD": "visual_centrifugal", "FURNITURE": "sensory"}
TRANSMITTERS = ["ACH", "GABA", "GLUT", "SER", "DA", "OCT"]
TYPES = ["AA", "AD", "DA", "DD"]


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def orders(self) -> int:
        return self.table("orders").count()

    @cached_property
    def k(self) -> int:
        return math.floor(math.sqrt(self.orders * DOMAIN))

    @cached_property
    def contacts(self) -> DataFrame:
        """Contacts, self-contacts included, with the columns that order them."""
        k = F.lit(self.k).cast("bigint")
        c = F.col
        lines = self.table("lineitem").join(self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), c("l_orderkey") == c("o_orderkey"))
        rare = (c("l_returnflag") == "R") & (c("l_linestatus") == "O")
        lines = lines.withColumn("pre", c("o_custkey") % k).withColumn("post", c("l_partkey") % k)
        return lines.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
            "pre", "post",
            F.when(rare & (c("l_quantity") <= 10), "L").when(c("l_quantity") > (c("pre") * 37) % 50, "A").otherwise("D").alias("pre_compartment"),
            F.when(rare & (c("l_quantity") > 40), "L").when(c("l_quantity") > (c("post") * 23) % 50, "D").otherwise("A").alias("post_compartment"),
            F.concat("o_orderpriority", F.when(c("l_suppkey") % 2 == 0, "_L").otherwise("_R")).alias("npil"),
            c("l_extendedprice").alias("pre_x"), (c("l_quantity") * 1000).alias("pre_y"), (c("l_discount") * 100000).alias("pre_z"),
            (c("l_extendedprice") + c("l_tax") * 1000).alias("post_x"), (c("l_quantity") * 1000).alias("post_y"),
            (c("l_discount") * 100000 + c("l_tax") * 1000).alias("post_z"),
            c("l_quantity").cast("bigint").alias("size"))

    @cached_property
    def syn_self(self) -> DataFrame:
        return self.contacts.select("pre", "post", "pre_compartment", "post_compartment", "npil", "pre_x", "pre_y", "pre_z",
                                    "post_x", "post_y", "post_z", "size", F.col("size").alias("cleft_score"))

    @cached_property
    def syn(self) -> DataFrame:
        return tables.without_self(self.syn_self)

    @cached_property
    def comp(self) -> DataFrame:
        return tables.with_type(self.syn)

    @cached_property
    def typed(self) -> DataFrame:
        return self.comp.filter(F.col("comp").isin(TYPES))

    @cached_property
    def neurons(self) -> DataFrame:
        c, k = F.col, self.k
        lowest = lambda t, key: t.groupBy((c(key) % k).alias("id")).agg(F.min_by(F.struct(*t.columns), key).alias("r")).select("id", "r.*")
        cust = lowest(self.table("customer"), "c_custkey").withColumnRenamed("id", "id_c")
        part = lowest(self.table("part"), "p_partkey").withColumnRenamed("id", "id_p")
        rows = self.spark.range(k).join(cust, c("id") == c("id_c"), "left").join(part, c("id") == c("id_p"), "left")
        names = F.create_map(*[F.lit(x) for pair in SUPER_CLASS.items() for x in pair])
        return rows.select(
            c("id").alias("neuron"), names[c("c_mktsegment")].alias("super_class"), c("p_brand").alias("primary_type"),
            c("p_type").alias("cell_sub_class"),
            F.get(F.array(*[F.lit(x) for x in TRANSMITTERS]), c("c_nationkey") % 6).alias("nt_type"),
            F.when(c("id") % 11 == 0, "center").when(c("id") % 2 == 0, "left").otherwise("right").alias("side"),
            (c("c_acctbal") + 1000).alias("length_nm"), c("p_retailprice").alias("area_nm"), c("p_size").cast("double").alias("size_nm"),
            (c("p_size") + c("c_nationkey")).cast("bigint").alias("leafs"))

    @cached_property
    def skeleton(self) -> DataFrame:
        """Heap-shaped trees: node r of a neuron hangs from node r div 2."""
        from pyspark.sql import Window

        c = F.col
        rows = self.table("orders").select((c("o_custkey") % self.k).alias("neuron"), "o_orderkey", "o_totalprice")
        rows = rows.withColumn("node_id", F.row_number().over(Window.partitionBy("neuron").orderBy("o_orderkey")).cast("bigint"))
        rows = rows.select("neuron", "node_id", c("o_totalprice").alias("x"), ((c("o_orderkey") % 97) * 100).cast("double").alias("y"),
                           ((c("o_orderkey") % 31) * 100).cast("double").alias("z"), F.lit(1.0).alias("radius"),
                           F.when(c("node_id") == 1, -1).otherwise(F.floor(c("node_id") / 2)).cast("bigint").alias("parent_id"))
        return by_count(rows, self.orders)

    @cached_property
    def si(self) -> DataFrame:
        return tables.segregation(self.syn)

    @cached_property
    def master(self) -> DataFrame:
        return tables.master(self.comp, self.si)

    @cached_property
    def conn(self) -> DataFrame:
        return tables.connections(self.typed, self.neurons)

    @cached_property
    def nsi(self) -> DataFrame:
        """Neurons with their index, and the tallies behind it."""
        return self.neurons.join(self.si, "neuron", "left")


CTES: dict[str, str] = {
    "k": "SELECT floor(sqrt(count(*) * 26.67))::BIGINT AS k FROM orders",
    "contacts": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, pre, post,
  CASE WHEN l_returnflag='R' AND l_linestatus='O' AND l_quantity<=10 THEN 'L' WHEN l_quantity > (pre*37)%50 THEN 'A' ELSE 'D' END AS pre_compartment,
  CASE WHEN l_returnflag='R' AND l_linestatus='O' AND l_quantity>40 THEN 'L' WHEN l_quantity > (post*23)%50 THEN 'D' ELSE 'A' END AS post_compartment,
  concat(o_orderpriority, CASE WHEN l_suppkey%2=0 THEN '_L' ELSE '_R' END) AS npil,
  l_extendedprice AS pre_x, l_quantity*1000 AS pre_y, l_discount*100000 AS pre_z,
  l_extendedprice + l_tax*1000 AS post_x, l_quantity*1000 AS post_y, l_discount*100000 + l_tax*1000 AS post_z, l_quantity::BIGINT AS size
  FROM (SELECT *, o_custkey % (SELECT k FROM k) AS pre, l_partkey % (SELECT k FROM k) AS post FROM lineitem JOIN orders ON l_orderkey=o_orderkey)""",
    "syn_self": """SELECT pre, post, pre_compartment, post_compartment, npil, pre_x, pre_y, pre_z, post_x, post_y, post_z, size, size AS cleft_score FROM contacts""",
    "syn": "SELECT * FROM syn_self WHERE pre <> post",
    "comp": "SELECT *, pre_compartment || post_compartment AS comp FROM syn",
    "typed": "SELECT * FROM comp WHERE comp IN ('AA','AD','DA','DD')",
    "neurons": """SELECT r.id AS neuron,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'central' WHEN 'AUTOMOBILE' THEN 'optic' WHEN 'MACHINERY' THEN 'visual_projection'
    WHEN 'HOUSEHOLD' THEN 'visual_centrifugal' WHEN 'FURNITURE' THEN 'sensory' END AS super_class,
  p_brand AS primary_type, p_type AS cell_sub_class, ['ACH','GABA','GLUT','SER','DA','OCT'][c_nationkey % 6 + 1] AS nt_type,
  CASE WHEN r.id % 11 = 0 THEN 'center' WHEN r.id % 2 = 0 THEN 'left' ELSE 'right' END AS side,
  c_acctbal + 1000 AS length_nm, p_retailprice AS area_nm, p_size::DOUBLE AS size_nm, (p_size + c_nationkey)::BIGINT AS leafs
  FROM (SELECT unnest(range((SELECT k FROM k))) AS id) r
  LEFT JOIN (SELECT * FROM (SELECT *, c_custkey % (SELECT k FROM k) AS id, row_number() OVER (PARTITION BY c_custkey % (SELECT k FROM k) ORDER BY c_custkey) AS rn FROM customer) WHERE rn=1) c ON c.id=r.id
  LEFT JOIN (SELECT * FROM (SELECT *, p_partkey % (SELECT k FROM k) AS id, row_number() OVER (PARTITION BY p_partkey % (SELECT k FROM k) ORDER BY p_partkey) AS rn FROM part) WHERE rn=1) p ON p.id=r.id""",
    "skeleton": """SELECT neuron, node_id, o_totalprice AS x, ((o_orderkey % 97)*100)::DOUBLE AS y, ((o_orderkey % 31)*100)::DOUBLE AS z, 1.0::DOUBLE AS radius,
  CASE WHEN node_id = 1 THEN -1 ELSE node_id // 2 END AS parent_id
  FROM (SELECT o_custkey % (SELECT k FROM k) AS neuron, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey % (SELECT k FROM k) ORDER BY o_orderkey) AS node_id FROM orders)""",
    "si4": """SELECT neuron, count(*) FILTER (role='pre' AND c='A') AS ax_pre, count(*) FILTER (role='post' AND c='A') AS ax_post,
  count(*) FILTER (role='pre' AND c='D') AS de_pre, count(*) FILTER (role='post' AND c='D') AS de_post
  FROM (SELECT pre AS neuron, 'pre' AS role, pre_compartment AS c FROM syn UNION ALL SELECT post, 'post', post_compartment FROM syn) GROUP BY neuron""",
    "ent": """SELECT *,
  CASE WHEN ax_pre=0 OR ax_post=0 THEN 0.0 ELSE -(ax_pre/(ax_pre+ax_post)*log2(ax_pre/(ax_pre+ax_post)) + ax_post/(ax_pre+ax_post)*log2(ax_post/(ax_pre+ax_post))) END AS e_ax,
  CASE WHEN de_pre=0 OR de_post=0 THEN 0.0 ELSE -(de_pre/(de_pre+de_post)*log2(de_pre/(de_pre+de_post)) + de_post/(de_pre+de_post)*log2(de_post/(de_pre+de_post))) END AS e_de,
  CASE WHEN ax_pre+de_pre=0 OR ax_post+de_post=0 THEN 0.0 ELSE -((ax_pre+de_pre)/(ax_pre+ax_post+de_pre+de_post)*log2((ax_pre+de_pre)/(ax_pre+ax_post+de_pre+de_post))
    + (ax_post+de_post)/(ax_pre+ax_post+de_pre+de_post)*log2((ax_post+de_post)/(ax_pre+ax_post+de_pre+de_post))) END AS e_all FROM si4""",
    "si": """SELECT neuron, ax_pre, ax_post, de_pre, de_post,
  round(CASE WHEN e_all > 0 THEN 1 - ((ax_pre+ax_post)*e_ax + (de_pre+de_post)*e_de)/(ax_pre+ax_post+de_pre+de_post)/e_all END, 9) AS si,
  round(CASE WHEN e_all > 0 THEN e_all - ((ax_pre+ax_post)*e_ax + (de_pre+de_post)*e_de)/(ax_pre+ax_post+de_pre+de_post) END, 9) AS ig FROM ent""",
    "master": """SELECT c.*, a.si AS si_pre, b.si AS si_post FROM comp c JOIN si a ON a.neuron=c.pre JOIN si b ON b.neuron=c.post
  WHERE a.si IS NOT NULL AND b.si IS NOT NULL AND npil IS NOT NULL AND pre_x IS NOT NULL AND pre_y IS NOT NULL AND pre_z IS NOT NULL AND post_x IS NOT NULL AND post_y IS NOT NULL AND post_z IS NOT NULL""",
    "conn0": """SELECT pre, post, count(*) FILTER (comp='AA') AS "AA", count(*) FILTER (comp='AD') AS "AD", count(*) FILTER (comp='DA') AS "DA", count(*) FILTER (comp='DD') AS "DD", count(*) AS sum_syn
  FROM typed GROUP BY pre, post""",
    "conn": """SELECT c.pre, c.post, c."AA", c."AD", c."DA", c."DD", c.sum_syn, (r.pre IS NOT NULL)::INT AS reciprocal, a.primary_type AS type_pre, b.primary_type AS type_post,
  coalesce((a.primary_type = b.primary_type)::INT, 0) AS same_type
  FROM conn0 c LEFT JOIN conn0 r ON r.pre=c.post AND r.post=c.pre LEFT JOIN neurons a ON a.neuron=c.pre LEFT JOIN neurons b ON b.neuron=c.post""",
    "nsi": "SELECT n.*, s.ax_pre, s.ax_post, s.de_pre, s.de_post, s.si, s.ig FROM neurons n LEFT JOIN si s ON s.neuron=n.neuron",
}


def with_views(body: str) -> str:
    """``body`` (a SELECT, or CTEs and a SELECT without WITH) behind the views that it names."""
    need: list[str] = []

    def add(text: str, skip: str = "") -> None:
        for name in CTES:
            if name != skip and name not in need and re.search(rf"\b(FROM|JOIN|from|join|,)\s+{name}\b", text):
                add(CTES[name], name)
                if name not in need:
                    need.append(name)
    add(body)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in need)
    rest = body.strip()
    own = re.match(r"\w+ AS \(", rest)
    word = "WITH RECURSIVE" if re.search(r"\b(\w+) AS \([^;]*? UNION SELECT \1\.", rest) else "WITH"
    return (f"{word} {head}" if head else word if own else "") + (("," if head else "") + "\n" + rest if own else "\n" + rest)
