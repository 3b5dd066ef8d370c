"""Rendezvous hashing of stable record keys over weighted shards (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_sum, text_or_empty

#: Buckets in which the rows of a shard are numbered; their totals are a table of fixed size.
BUCKETS = 1024


def rendezvous(key: Column, weights: list[float], seed: str = "rendezvous") -> Column:
    """The shard with the highest score ``weight / -ln(u)``, u a hash of (seed, key, shard) in (0, 1).

    A shard that joins takes just the keys on which it scores highest; keys never move between old
    shards.  Ties of scores go to the higher shard.  A null key is a key like any other."""
    def score(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key.cast("string"), F.lit(shard)), 11)
        u = (bits.cast("double") + 0.5) / float(1 << 53)
        return F.struct((F.lit(float(weight)) / -F.log(u)).alias("score"), F.lit(shard).alias("shard"))

    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    if len(weights) == 1:
        return F.lit(0)
    return F.greatest(*[score(i, w) for i, w in enumerate(weights)])["shard"]


def shard_records(docs: DataFrame, weights: list[float], grown: list[float] | None = None,
                  key: str = "doc_id") -> DataFrame:
    """Per document: key, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``law``, ``shard``, ``slot`` (a
    gapless number within the shard) and ``grown_shard`` (the shard under the weights ``grown``).

    Null or empty text: size 1, CRC 0.  Null keys share a shard.  Repeated rows land on one shard and
    get slots of their own.  An empty table gives an empty result.  Other columns are not read, so
    their names cannot clash."""
    text = text_or_empty()
    grown = grown or [*weights, weights[-1]]
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).cast("int").alias("shard"),
        rendezvous(F.col(key), grown).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit("slot"), F.col(key).cast("string")), F.lit(BUCKETS)).cast("int").alias("__bucket"),
        F.lit(1).cast("bigint").alias("__one"),
    )
    out = running_sum(rows, ["shard"], "__bucket", [F.col("doc_id"), F.col("size"), F.col("text_crc32")],
                      "__one", "slot", bounded=True)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
