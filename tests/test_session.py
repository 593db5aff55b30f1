"""Task counts of costly scans and the place of intermediate tables."""

import pytest
from pyspark.sql import functions as F

from flakelens import session
from flakelens.operators.methods import method_table
from flakelens.queries import derived

SF = "/root/testdata/sf0.001"


def tasks_with_rows(df):
    return df.withColumn("_task", F.spark_partition_id()).select("_task").distinct().count()


def test_scans_keep_the_default_parallelism(spark):
    """Rows small on the wire are not joined into one task: their texts are costly."""
    parallel = spark.sparkContext.defaultParallelism
    sources = derived.sources(spark, SF)
    assert tasks_with_rows(sources) == parallel
    assert tasks_with_rows(method_table(sources, ["test_id"])) == parallel
    assert tasks_with_rows(derived.run_logs(spark, SF)) == parallel


def test_tasks_follow_input_bytes(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    size = session.input_bytes(rows)
    assert size > 10_000
    spread = session.spread(rows, "l_orderkey", growth=2.0, task_bytes=size // 10)
    assert spread.rdd.getNumPartitions() == 21
    both = rows.join(spark.read.parquet(f"{SF}/part.parquet"), F.col("l_partkey") == F.col("p_partkey"))
    assert size < session.input_bytes(both) < 2 * size


def test_sources_of_unknown_size_do_not_count(spark):
    rows = spark.createDataFrame([(i,) for i in range(10)], "a long").rdd.toDF()
    assert session.input_bytes(rows) == 0
    assert session.spread(rows, "a").count() == 10


class _Elsewhere:
    """A session whose executors run on other machines."""

    def __init__(self, conf):
        self.conf, self.sparkContext, self.master = conf, self, "spark://host:7077"


@pytest.mark.parametrize(("conf", "place"), [
    ({"spark.sql.warehouse.dir": "file:/home/me/spark-warehouse"}, None),
    ({"spark.sql.warehouse.dir": "/home/me/spark-warehouse"}, None),
    ({"spark.sql.warehouse.dir": "hdfs://host/w"}, "hdfs://host/w/_scratch/x-"),
    ({"spark.sql.warehouse.dir": "/w", "spark.checkpoint.dir": "/mnt/shared"}, "/mnt/shared/x-"),
])
def test_scratch_is_shared(conf, place):
    elsewhere = _Elsewhere(type("Conf", (), {"get": lambda self, k, d=None: conf.get(k, d)})())
    if place is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.scratch_dir(elsewhere, "x")
    else:
        assert session.scratch_dir(elsewhere, "x").startswith(place)
