"""Training-data pipeline: documents that the classifier rejects go, one of each near-duplicate group stays, documents
that leak benchmark items go, sources are mixed to their target weights, and token-ID files are written.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.  Clashing or extra columns
pass through untouched, and null texts, null ids and empty tables are defined as in the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.llm import classifier, decontamination, mixing, similar, tokens
from arborix.llm.common import ship, small, stored, text_or_empty
from arborix.llm.queries import table as _table


def _whole(docs: DataFrame) -> DataFrame:
    """docs with each row in one column, so that no name of theirs can clash with one of a stage."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def _is(gone: DataFrame):
    """Whether a whole row's id (null for null) and text are those of gone (columns __gone, __gone_th)."""
    return F.col("row.doc_id").eqNullSafe(gone["__gone"]) & (F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))) == gone["__gone_th"])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score 0.7 or more."""
    model = classifier.fit(docs, _table(spark, sf_dir, "labels"))
    rows = classifier.with_scores(_whole(docs).withColumn("text", F.col("row.text")), model, ["row"])
    return rows.filter(F.col("__score") >= classifier.THRESHOLD).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of 0.8 or more (Jaccard, 5-word shingles) connect: the smallest doc_id, null
    after all others.  Each text stands for itself, whatever its id; rows equal in doc_id and text are copies of one document."""
    ship(spark)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    each = stored(similar.groups(docs), "dedup-groups").withColumn("key", key)
    least = each.groupBy("group").agg(F.min("key").alias("least"))
    each = each.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n")).join(least, "group")
    each = stored(each.filter((F.col("key") != F.col("least")) | (F.col("n") > 1)).select(
        F.col("key.doc_id").alias("__gone"), F.col("key.th").alias("__gone_th"), (F.col("key") == F.col("least")).alias("__stays")), "dedup-gone")
    rows = _whole(docs)
    out = rows.join(small(each), _is(each), "left_anti").select("row.*")
    again = stored(each.filter("__stays"), "dedup-again")
    if not again.take(1):
        return out
    # of rows equal in id and text the first by all columns stays, so that it is the same in every run
    hashed = rows.join(small(again), _is(again), "left_semi").withColumns({"__row": F.xxhash64("row"), "__th": F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit("")))})
    first = hashed.groupBy(F.col("row.doc_id").alias("__gone"), F.col("__th").alias("__gone_th")).agg(F.min("__row").alias("__first"))
    first = small(stored(first, "dedup-first"))
    one = hashed.join(first, _is(first) & (F.col("__row") == first["__first"]), "left_semi")
    one = one.withColumn("__id", F.col("row.doc_id")).dropDuplicates(["__id", "__th"]).select("row.*")
    return out.unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak an item of the benchmark."""
    # a leak is one of the text, so texts are looked at under their hash and each row has its own verdict
    ship(spark)
    texts = docs.select(F.xxhash64(text_or_empty()).alias("doc_id"), "text")
    found = decontamination.leaks(texts, _table(spark, sf_dir, "benchmark"))
    gone = stored(found.select(F.col("doc_id").alias("__gone_th")).distinct(), "leaks")
    return _whole(docs).join(small(gone), F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))) == F.col("__gone_th"), "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes its words, to the nearest whole number (0, 1 or 2)."""
    share = mixing.mix(docs, weights=[3, 1, 2], share=1.5).groupBy(F.col("doc_id").alias("__id")).agg(
        F.floor(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1)) + 0.5).cast("int").alias("__times"))
    share = stored(share.filter(F.col("__times") > 0), "mix-times")
    # as many rows as documents, so a shuffled join at every size
    out = _whole(docs).join(share.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("__id")))
    return out.withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token-ID files and returns what they hold."""
    import public_tokenizers

    ship(spark)
    return tokens.token_files(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID output", token_ids),
]

#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
