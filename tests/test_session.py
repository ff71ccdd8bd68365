"""The shared folder, its clean-up, and numbers of partitions."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from strataflow import session


def test_no_local_tables_on_a_cluster():
    conf = SimpleNamespace(get=lambda key, default=None: None)
    with pytest.raises(ValueError):
        session.shared_root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    alone = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]"))
    assert os.path.isdir(session.shared_root(alone)) and session.shared_root(alone) == session.shared_root(alone)
    told = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: "hdfs:///shared/"), sparkContext=SimpleNamespace(master="yarn"))
    assert session.shared_root(told) == "hdfs:///shared"


def test_rounds_leave_no_tables(spark):
    rows, path = session.written(spark.range(5), "round")
    assert rows.count() == 5 and os.path.isdir(path) and spark.sparkContext.applicationId in path
    session.forget(spark, path)
    assert not os.path.exists(path)
    session.forget(spark, path)  # what is gone already doesn't matter


def test_partitions_grow_with_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(200_000).select("id", F.rand(1).alias("x")).write.parquet(path)
    table, own = spark.read.parquet(path), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.partitions_for(table, 1 << 40) == own
    assert session.partitions_for(table, 50_000) > own
    assert session.partitions_for(spark.createDataFrame([(1,)], "a long").unionByName(spark.createDataFrame([(2,)], "a long")), 1) >= own


def test_only_shuffled_rows_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).write.parquet(path)
    table = spark.read.parquet(path)
    assert session.steady(table, "steady") is table
    mixed = session.steady(table.repartition(3), "steady")
    assert "Exchange" not in mixed._jdf.queryExecution().executedPlan().toString() and mixed.count() == 100
