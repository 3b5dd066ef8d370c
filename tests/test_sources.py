"""Files that are written and read again."""

import datetime

import pyarrow as pa
import pytest
from pyarrow import feather, ipc
from pyspark.sql import functions as F

from arborix.sources import arrow_files, files

SCHEMA = "i bigint, d double, s string, b boolean, a array<bigint>, t timestamp, n int"


def rows_of(n):
    return [(i, i / 7, None if i % 5 == 0 else f"é{i}", i % 2 == 0, [i, i + 1] if i % 3 else None, datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=i), None) for i in range(n)]


def test_feather_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrow_files, "BYTES", 1 << 12)
    arrow_files.register(spark)
    df = spark.createDataFrame(rows_of(3000), SCHEMA).repartition(3)
    at = str(tmp_path / "made")
    df.write.format("arrow_ipc").mode("append").save(at)
    df.write.parquet(str(tmp_path / "parquet"))
    back = spark.read.format("arrow_ipc").load(at)
    assert back.schema == df.schema
    assert sorted(back.collect()) == sorted(spark.read.parquet(str(tmp_path / "parquet")).collect())
    some = spark.read.format("arrow_ipc").option("columns", "s,i").load(at)
    assert some.columns == ["s", "i"] and some.agg(F.sum("i")).first()[0] == sum(range(3000))
    assert not [p for p in (tmp_path / "made").iterdir() if p.name.endswith(".part")]


def test_files_of_other_writers(spark, tmp_path):
    arrow_files.register(spark)
    feather.write_feather(pa.table({"x": list(range(1000)), "y": [f"v{i}" for i in range(1000)]}), str(tmp_path / "a.feather"), chunksize=100)
    with ipc.new_file(str(tmp_path / "b.arrow"), pa.schema([("x", pa.int64()), ("y", pa.string())])):
        pass  # no batches
    got = spark.read.format("arrow_ipc").load(str(tmp_path))
    assert got.count() == 1000 and got.filter("x = 77").first()["y"] == "v77"
    reader = arrow_files.Reader(str(tmp_path), ["x"])
    assert sum(p.last - p.first for p in reader.partitions()) == 10
    assert spark.read.format("arrow_ipc").load(f"file://{tmp_path}/a.feather").count() == 1000
    empty = tmp_path / "none"
    empty.mkdir()
    with pytest.raises(Exception, match="no .feather"):
        spark.read.format("arrow_ipc").load(str(empty)).count()


def test_batches_are_replaced_not_repeated(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(i, i % 3) for i in range(30)], "i bigint, batch bigint")
    files.add_batches(rows.filter("batch < 2"), at, "batch")
    for _ in range(2):
        files.add_batches(rows.filter("batch = 1"), at, "batch")
    done = spark.read.parquet(at)
    assert sorted(r["i"] for r in done.collect()) == [i for i in range(30) if i % 3 < 2]
    new = files.new_batches(rows, done.select(F.col("batch").cast("bigint").alias("batch")), "batch")
    assert {r["batch"] for r in new.collect()} == {2}
