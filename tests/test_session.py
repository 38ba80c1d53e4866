from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from emberlog import drop_scratch, scratch_dir, session


def test_scratch_is_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_scratch", {})
    paths = [scratch_dir(spark, "a"), scratch_dir(spark, "b")]
    spark.range(3).write.parquet(paths[0])
    assert drop_scratch(spark) == 1 and drop_scratch(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(paths[0])


def test_a_cluster_needs_a_shared_folder():
    nothing = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: nothing, master="spark://host:7077")
    with pytest.raises(ValueError, match="must name a folder"):
        session.checkpoint_root(SimpleNamespace(sparkContext=context, conf=nothing))


def test_rows_of_one_row_group_are_dealt_over_the_tasks(spark, tmp_path):
    """A row group lies in one piece of its file: the pieces are as many as asked for, and all but one are empty."""
    path, names = str(tmp_path / "t"), ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    spark.range(20_000).coalesce(1).write.parquet(path)
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, 4096)
        rows = spark.read.parquet(path)
        assert rows.rdd.getNumPartitions() >= 4
        held = [r["count"] for r in session.spread(rows).groupBy(F.spark_partition_id()).count().collect()]
        assert len(held) >= 4 and sum(held) == 20_000 and max(held) < 10_000
        few = [r["count"] for r in session.spread(rows, task_rows=1000).groupBy(F.spark_partition_id()).count().collect()]
        assert len(few) == 20 and max(few) < 1500
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def test_nothing_is_spread_where_there_is_nothing(spark):
    assert session.spread(spark.createDataFrame([], "a int")).count() == 0
