"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import math
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the operators are designed for; a cluster's own values win.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
SCAN_BYTES = 16 << 20  # a code scan reads some 0.15 MB/s: about two minutes of a task
_UNKNOWN = 1 << 60


def build_session(app: str = "flakelens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that a plan reads; sources of unknown size do not count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(size for size in sizes if size < _UNKNOWN)


def spread(df: DataFrame, *keys: str, growth: float = 1.0, task_bytes: int = SCAN_BYTES) -> DataFrame:
    """Distribute rows ahead of costly per-row work.

    The work follows the text that is scanned, not the bytes that are shuffled, so the
    number of partitions is that of tasks of ``task_bytes`` each, at least the default
    parallelism; ``growth`` says how much larger the texts are than the tables they are
    made from.  Adaptive execution keeps a number that is asked for (a rebalance would
    join small rows into one task).  Rows go by a hash of the keys, not the keys, so
    that joins before and after keep their own exchange, which adaptive execution can
    split where one key is hot.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(growth * input_bytes(df) / task_bytes))
    return df.withColumn("_spread", F.xxhash64(*keys)).repartition(tasks, "_spread").drop("_spread")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables.

    It lies under ``spark.checkpoint.dir``, or where that is unset under the warehouse:
    both have to be shared by the executors of a cluster.  A folder that only one
    machine sees is refused unless the session is local; a shared file system that is
    mounted on all machines is to be named in ``spark.checkpoint.dir``.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        is_local = spark.sparkContext.master.startswith("local")
        if not is_local and urlsplit(root).scheme in ("", "file"):
            raise ValueError(f"{root} is a folder of one machine; set spark.checkpoint.dir to a shared folder")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
