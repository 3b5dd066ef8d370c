"""The derived tables: typed contacts, index, master, connections, reciprocity, neurons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborix.functions import expr

TYPES = ["AA", "AD", "DA", "DD"]


def without_self(contacts: DataFrame) -> DataFrame:
    return contacts.filter(F.col("pre") != F.col("post"))


def with_type(contacts: DataFrame) -> DataFrame:
    return contacts.withColumn("comp", F.concat("pre_compartment", "post_compartment"))


def ends(contacts: DataFrame) -> DataFrame:
    """Both ends of each contact: neuron, role, compartment.  One pass, no union of two scans."""
    both = F.explode(F.array(
        F.struct(F.col("pre").alias("neuron"), F.lit("pre").alias("role"), F.col("pre_compartment").alias("compartment")),
        F.struct(F.col("post").alias("neuron"), F.lit("post").alias("role"), F.col("post_compartment").alias("compartment"))))
    return contacts.select(both.alias("e")).select("e.*")


def tallies(contacts: DataFrame) -> DataFrame:
    """pre_A .. post_L per neuron."""
    one = lambda r, c: F.count_if((F.col("role") == r) & (F.col("compartment") == c)).alias(f"{r}_{c}")
    return ends(contacts).groupBy("neuron").agg(*[one(r, c) for r in ("pre", "post") for c in "ADL"])


def segregation(contacts: DataFrame) -> DataFrame:
    """Index and information gain per neuron, with the four counts; linker contacts don't count."""
    t = tallies(contacts).select("neuron", F.col("pre_A").alias("ax_pre"), F.col("post_A").alias("ax_post"),
                                 F.col("pre_D").alias("de_pre"), F.col("post_D").alias("de_post"))
    si, ig = expr.segregation(F.col("ax_pre"), F.col("ax_post"), F.col("de_pre"), F.col("de_post"))
    return t.withColumn("si", F.round(si, 9)).withColumn("ig", F.round(ig, 9))


def with_roles(facts: DataFrame, dim: DataFrame, columns: list[str], how: str = "left", key: str = "neuron") -> DataFrame:
    """Attributes of both ends of a contact or connection, suffixed _pre and _post."""
    out = facts
    for role in ("pre", "post"):
        side = dim.select(F.col(key).alias(f"__{role}"), *[F.col(c).alias(f"{c}_{role}") for c in columns])
        out = out.join(side, F.col(role) == F.col(f"__{role}"), how).drop(f"__{role}")
    return out


def master(typed: DataFrame, si: DataFrame) -> DataFrame:
    """Contacts with the index of both ends; rows with any null go."""
    return with_roles(typed, si, ["si"], "inner").dropna()


def type_counts(typed: DataFrame) -> DataFrame:
    """pre, post, AA, AD, DA, DD, sum_syn: one aggregation, no pivot pass."""
    return typed.groupBy("pre", "post").agg(*[F.count_if(F.col("comp") == t).alias(t) for t in TYPES], F.count(F.lit(1)).alias("sum_syn"))


def mark_reciprocal(edges: DataFrame) -> DataFrame:
    """Adds reciprocal (0 / 1): an edge whose reverse exists.  Edges are unique and without self-contacts, so both
    lie in one group of the unordered pair: one shuffle, groups of two at most."""
    pair = Window.partitionBy(F.least("pre", "post"), F.greatest("pre", "post"))
    return edges.withColumn("reciprocal", (F.count(F.lit(1)).over(pair) == 2).cast("int"))


def connections(typed: DataFrame, neurons: DataFrame) -> DataFrame:
    out = with_roles(mark_reciprocal(type_counts(typed)), neurons.select("neuron", F.col("primary_type").alias("type")), ["type"])
    return out.withColumn("same_type", F.coalesce((F.col("type_pre") == F.col("type_post")).cast("int"), F.lit(0)))


def reciprocal_pairs(edges: DataFrame, columns: list[str]) -> DataFrame:
    """a < b with the columns of both directions, suffixed _ab and _ba, of pairs that have both."""
    forth = F.col("pre") < F.col("post")
    both = edges.groupBy(F.least("pre", "post").alias("a"), F.greatest("pre", "post").alias("b")).agg(
        *[F.max(F.when(forth, F.col(c))).alias(f"{c}_ab") for c in columns],
        *[F.max(F.when(~forth, F.col(c))).alias(f"{c}_ba") for c in columns], F.count(F.lit(1)).alias("__n"))
    return both.filter(F.col("__n") == 2).drop("__n")


def degrees(contacts: DataFrame) -> DataFrame:
    """Counts, partners, greatest and mean degree of both roles, and their ratios, per neuron."""
    pairs = contacts.groupBy("pre", "post").agg(F.count(F.lit(1)).alias("degree"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("pre").alias("neuron"), F.lit(True).alias("out"), "degree"),
                                          F.struct(F.col("post").alias("neuron"), F.lit(False).alias("out"), "degree"))).alias("e")).select("e.*")
    aggs = []
    for side, cond in (("out", F.col("out")), ("in", ~F.col("out"))):
        d = F.when(cond, F.col("degree"))
        aggs += [F.sum(d).alias(f"{side}_synapses"), F.count(d).alias(f"{side}_partners"), F.max(d).alias(f"max_{side}_degree"), F.avg(d).alias(f"mean_{side}_degree")]
    out = both.groupBy("neuron").agg(*aggs)
    c = F.col
    for side in ("out", "in"):
        out = out.withColumn(f"{side}_partners", F.when(c(f"{side}_partners") > 0, c(f"{side}_partners")))
        out = out.withColumn(f"mean_{side}_per_partner", expr.ratio(c(f"mean_{side}_degree"), c(f"{side}_partners")))
    return (out.withColumn("partners_ratio", expr.ratio(c("in_partners"), c("out_partners")))
            .withColumn("max_degree_ratio", expr.ratio(c("max_in_degree"), c("max_out_degree")))
            .withColumn("mean_degree_ratio", expr.ratio(c("mean_in_degree"), c("mean_out_degree")))
            .withColumn("per_partner_ratio", expr.ratio(c("mean_in_per_partner"), c("mean_out_per_partner"))))


def reciprocity_fraction(conn: DataFrame) -> DataFrame:
    """Partners and synapses, all and reciprocal, per neuron over both directions, with their ratios."""
    both = conn.select("sum_syn", "reciprocal", F.explode(F.array(
        F.struct(F.col("pre").alias("neuron"), F.col("post").alias("other")),
        F.struct(F.col("post").alias("neuron"), F.col("pre").alias("other")))).alias("e")).select("e.*", "sum_syn", "reciprocal")
    # a partner met in both directions counts once: first by partner, then by neuron
    per = both.groupBy("neuron", "other").agg(F.sum("sum_syn").alias("n"), F.max("reciprocal").alias("r"))
    c = F.col
    out = per.groupBy("neuron").agg(F.count(F.lit(1)).alias("total_partners"), F.sum("n").alias("total_synapses"),
                                    F.sum("r").cast("bigint").alias("reciprocal_partners"),
                                    F.sum(c("n") * c("r")).alias("reciprocal_synapses"))
    out = (out.withColumn("non_reciprocal_partners", c("total_partners") - c("reciprocal_partners"))
           .withColumn("non_reciprocal_synapses", c("total_synapses") - c("reciprocal_synapses"))
           .withColumn("non_reciprocal_ratio", expr.ratio(c("non_reciprocal_synapses"), c("non_reciprocal_partners")))
           .withColumn("__r", expr.ratio(c("reciprocal_synapses"), c("reciprocal_partners")))
           .withColumn("ratio", expr.ratio(c("reciprocal_partners"), c("total_partners")))
           .withColumn("ratio_syn", expr.ratio(c("__r"), c("non_reciprocal_ratio"))))
    return out.withColumn("reciprocal_ratio", c("__r") / 2).drop("__r")
