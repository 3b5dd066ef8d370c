"""Tables written to the folder that a cluster shares, to cut lineage between rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in a local session that has none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if "cluster" in spark.sparkContext.master or not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="arborix-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: it is computed once, its lineage
    ends there, and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a side that a join may broadcast.
FEW = 100_000


def by_count(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, a stored table, or one whose number of rows is known: with more than FEW, joins sort it rather than broadcast it.  Spark goes by the size of the
    files, and tables of ids are packed to a tenth of what they take in memory."""
    return df if (df.count() if rows is None else rows) <= FEW else df.hint("merge")
