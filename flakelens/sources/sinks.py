"""Output tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

_PLACE = ("repo", "sha")  # partitions of a run
_PLAIN = (T.StringType, T.NumericType, T.BooleanType, T.ArrayType, T.MapType, T.StructType)


def serializable(df: DataFrame) -> DataFrame:
    """Columns JSON cannot hold as such become their text."""
    return df.select(
        *[
            F.col(f.name) if isinstance(f.dataType, _PLAIN) else F.col(f.name).cast("string").alias(f.name)
            for f in df.schema.fields
        ]
    )


def write_results(df: DataFrame, out_dir: str, run_id: str, mode: str = "overwrite") -> str:
    """One JSON document per test under ``run_id=.../repo=.../sha=...``.

    The rebalance hint lets adaptive execution split a repository that holds
    most tests over several files and join small ones into one.
    """
    target = f"{out_dir.rstrip('/')}/run_id={run_id}"
    (
        serializable(df)
        .hint("rebalance", "repo", "sha")
        .write.partitionBy("repo", "sha").mode(mode).json(target)
    )
    return target


def replace_results(df: DataFrame, out_dir: str, run_id: str, key: str = "test_fqn",
                    order: Column | None = None) -> str:
    """Put the documents of some tests in place of those the run already has.

    ``write_results`` replaces a whole run; this replaces tests.  Only the partitions
    (repository, revision) that the new documents belong to are read and written anew:
    what they hold of other tests stays as the very text that was written, whatever
    its fields, and files of other partitions are not touched.  Of several new documents
    of a test the one with the largest ``order`` counts, by default the largest text.
    A run that does not exist yet is begun; no documents change nothing.

    The merged partitions are stored under the scratch folder first and then swapped in
    by dynamic partition overwrite, so a swap that is cut short can be repeated from there.
    Writers of one partition must not run at the same time.
    """
    spark = df.sparkSession
    target = f"{out_dir.rstrip('/')}/run_id={run_id}"
    plain = serializable(df)
    body = [c for c in plain.columns if c not in _PLACE]
    new = plain.withColumn("_value", F.to_json(F.struct(*body)))
    new = new.withColumn("_order", F.col("_value") if order is None else order).select(
        *_PLACE, F.col(key).cast("string").alias("_key"), F.col("_value").alias("value"), "_order"
    )
    new = new.groupBy(*_PLACE, "_key").agg(F.max_by("value", "_order").alias("value"))
    new = stored(new, "new_results")
    merged = new.drop("_key")
    old = _written(spark, target)
    if old is not None:
        touched = new.select(*[F.col(c).alias(f"_{c}") for c in _PLACE]).distinct()
        same_place = F.lit(True)
        for c in _PLACE:
            same_place &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        of_test = F.from_json("value", f"`{key}` string")[key]
        held = old.join(touched, same_place, "left_semi").withColumn("_key", of_test)
        kept = held.alias("held").join(
            new.alias("new"),
            F.col("held.repo").eqNullSafe(F.col("new.repo")) & F.col("held.sha").eqNullSafe(F.col("new.sha"))
            & F.col("held._key").eqNullSafe(F.col("new._key")),
            "left_anti",
        )
        merged = stored(merged.unionByName(kept.select(*merged.columns)), "merged_results")
    (
        merged.hint("rebalance", *_PLACE)
        .write.partitionBy(*_PLACE).option("partitionOverwriteMode", "dynamic").mode("overwrite").text(target)
    )
    return target


def _written(spark: SparkSession, target: str) -> DataFrame | None:
    """Documents of a run as ``(value, repo, sha)``, or nothing if there is no such run."""
    try:
        return spark.read.schema("value string, repo string, sha string").text(target)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_results(spark: SparkSession, out_dir: str, schema: T.StructType) -> DataFrame:
    """Read result documents; ``run_id``, ``repo`` and ``sha`` come from the path."""
    columns = {f.name for f in schema.fields}
    full = T.StructType(list(schema.fields))
    for name in ("run_id", "repo", "sha"):
        if name not in columns:
            full = full.add(name, "string")
    return spark.read.schema(full).json(out_dir)


def read_documents(spark: SparkSession, out_dir: str) -> DataFrame:
    """Result documents of any shape as ``(run_id, repo, sha, doc)``.

    ``doc`` is a variant: documents that different versions wrote are read together, and
    each field is asked for by its path (``field``).  A text that is no JSON gives null.
    """
    rows = spark.read.schema("value string, run_id string, repo string, sha string").text(out_dir)
    return rows.select("run_id", "repo", "sha", F.try_parse_json("value").alias("doc"))


def field(doc: Column, *paths: str, as_type: str = "string") -> Column:
    """The first of the paths at which a document has a value of the type, else null."""
    return F.coalesce(*[F.try_variant_get(doc, path, as_type) for path in paths])


def write_patched(df: DataFrame, out_dir: str, columns: tuple[str, ...] = ("path", "patched_content")) -> None:
    """Patched sources or build files as a table keyed by path."""
    df.select(*columns).write.mode("overwrite").parquet(out_dir)


def document(df: DataFrame, drop_null: bool = True) -> Column:
    """All columns of a row as one JSON text."""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": str(drop_null).lower()})
