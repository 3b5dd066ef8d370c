"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborix.functions.lineage import scratch_path, stored  # noqa: F401

#: A word is a run of characters that are neither a space nor one of tab .. carriage return.
GAP = r"[ \t\n\x0B\f\r]+"
NOT_GAP = r"[^ \t\n\x0B\f\r]+"

#: A table is broadcast only after a count has shown it to have no more rows than this.
BROADCAST_ROWS = 100_000


_shipped: set[str] = set()


#: Bytes of the Arrow batches that Python workers get: whole texts are long, and a worker holds a batch several times over.
ARROW_BATCH = 8 << 20


def ship(spark: SparkSession) -> None:
    """Readies a session: Arrow batches of a bounded size, and this package for its Python workers, as the driver alone may
    have it on its path."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="arborix-")) / "arborix.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def give_back() -> None:
    """Hands memory that a task has freed back to the system.  Python workers outlive their tasks, and the C library keeps what
    they free, so without this an executor's memory adds up over the stages of a job."""
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it small; otherwise as it is, for a shuffled join
    whose hot keys AQE splits.  ``df`` should be stored, as it is counted here."""
    return F.broadcast(df) if df.count() <= rows else df


def light(df: DataFrame, binary: str, rows: int = 1_000_000, size: int = 64 << 20) -> DataFrame:
    """As ``small``, for rows whose weight is a binary column: the sum of its bytes is bounded too."""
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(binary))).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words: those that ``split`` finds, less an empty piece at either end."""
    parts = F.size(F.split(text, GAP))
    edge = text.rlike(r"^[ \t\n\x0B\f\r]").cast("int") + text.rlike(r"[ \t\n\x0B\f\r]\z").cast("int")
    return F.when(~text.rlike(NOT_GAP), 0).otherwise(parts - edge).cast("bigint")


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str,
                bounded: bool = False) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group that come before the row.

    The order within a group is ``bucket`` first, then ``order``.  Sums run inside each bucket, and the
    buckets' totals are summed ahead of them, so a hot group spreads over as many tasks as it has
    buckets.  ``bounded``: the caller has fixed the number of groups, hence of totals."""
    keys = [*group, bucket]
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__total"))
    totals = totals.select(*keys, F.coalesce(F.sum("__total").over(ahead), F.lit(0)).alias("__ahead"))
    if bounded:
        totals = F.broadcast(totals)
    same = None
    totals = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__ahead")
    for i, k in enumerate(keys):
        cond = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        same = cond if same is None else same & cond
    inside = df.withColumn("__inside", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return (inside.join(totals, same)
            .withColumn(out, (F.col("__inside") + F.col("__ahead")).cast("bigint"))
            .drop("__inside", "__ahead", *[f"__k{i}" for i in range(len(keys))]))
