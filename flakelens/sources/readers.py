"""Input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules, schemas
from ..functions import fqn as names
from ..functions.text import contains_any, plain_path
from ..session import stored

# Every field follows a comma (one is put before the record).  The quantifiers are
# possessive: nothing is tried twice, and long quoted fields need no deep stack.
_CSV_FIELDS = r',("(?:[^"]++|"")*+"|[^,]*)'
_CSV_RECORDS = r'(?:^|\n)((?:"(?:[^"]++|"")*+"|[^"\n]++)*+)'
_NO_CHARACTER = "\u0001"  # separates the fields of no record


def _csv_fields(record: Column) -> Column:
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CSV_FIELDS), F.lit(1))
    return F.transform(
        raw,
        lambda f: F.when(
            F.startswith(f, F.lit('"')),
            F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(f),
    )


def _csv_records(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """Records without the header of each file."""
    if not multi_line:
        return (
            spark.read.schema("record string").option("header", True).option("enforceSchema", True)
            .option("sep", _NO_CHARACTER).option("quote", "").option("escape", "")
            .csv(path)
        )
    whole = spark.read.text(path, wholetext=True).select(_as_text(F.col("value")).alias("text"))
    records = F.filter(
        F.regexp_extract_all("text", F.lit(_CSV_RECORDS), F.lit(1)), lambda r: r != ""
    )
    return whole.select(F.explode_outer(F.slice(records, F.lit(2), F.size(records))).alias("record")).filter(
        "record is not null"
    )


def read_test_manifest(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Test manifest: CSV with a header, eight columns taken by position.

    All values are strings.  Empty fields stay empty strings; fields a short
    row lacks are null; fields beyond the eighth are kept in ``surplus``.
    Adds ``repo`` and ``test_id``.  ``multi_line`` admits line breaks in quoted
    fields, at the price of one task per file.  Records are read whole and split
    here, so rows do not depend on the columns that are selected.
    """
    rows = _csv_records(spark, path, multi_line).select(_csv_fields(F.col("record")).alias("_f"))
    width = len(schemas.MANIFEST_COLUMNS)
    fields = F.col("_f")
    surplus = F.when(
        F.size(fields) > width, F.slice(fields, F.lit(width + 1), F.size(fields) - width)
    )
    return rows.select(
        *[F.try_element_at(fields, F.lit(i + 1)).alias(c) for i, c in enumerate(schemas.MANIFEST_COLUMNS)],
        surplus.alias("surplus"),
    ).withColumns(
        {
            "repo": names.repo_name(F.col("project_url")),
            "test_id": names.test_id(
                *[F.col(c) for c in ("project_url", "sha", "module", "test_fqn")]
            ),
        }
    )


def read_module_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Module manifest: no header, records separated by white space, three fields.

    A record without a comma gives its text in every field it is asked for.
    """
    records = spark.read.text(path).select(
        F.explode(F.filter(F.split("value", r"\s+"), lambda r: r != "")).alias("record")
    )
    part = F.split("record", ",", -1)

    def field(number: int) -> Column:
        return F.when(
            F.contains("record", F.lit(",")), F.coalesce(F.try_element_at(part, F.lit(number)), F.lit(""))
        ).otherwise(F.col("record"))

    return records.select(
        field(1).alias("project_url"), field(2).alias("sha"), field(3).alias("module")
    ).withColumn("repo", names.repo_name(F.col("project_url")))


def _as_text(value: Column) -> Column:
    """Drop bytes that are not UTF-8 and use ``\\n`` for every line end."""
    valid = F.when(F.is_valid_utf8(value), value).otherwise(
        F.replace(F.make_valid_utf8(value), F.lit("\ufffd"), F.lit(""))
    )
    return F.when(
        F.contains(valid, F.lit("\r")), F.regexp_replace(valid, r"\r\n?", "\n")
    ).otherwise(valid)


def read_tree(spark: SparkSession, path: str, glob: str = "*" + rules.SOURCE_SUFFIX) -> DataFrame:
    """Every matching file below a folder as ``(path, content)``.

    Undecodable bytes are ignored and line ends are unified.  Paths have no scheme
    and no percent signs, as logs name them.
    """
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(path, wholetext=True)
        .select(plain_path(F.col("_metadata.file_path")).alias("path"), _as_text(F.col("value")).alias("content"))
    )


def read_log_lines(spark: SparkSession, path: str, glob: str = "*.log") -> DataFrame:
    """Lines of logs of any size as ``(path, line_no, line)``.

    Nothing is read whole: a large file is split over tasks.  Inside a split the
    row order is the file order, so a line's number in its split is its distance from
    the split's first line; the counts per split, summed over the splits before it,
    give the line numbers.  Lines are neither shuffled nor sorted: only one small row
    for each split is, and is broadcast.
    """
    rows = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(path)
        .select(
            plain_path(F.col("_metadata.file_path")).alias("path"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
            F.col("value").alias("line"),
        )
    )
    splits = rows.groupBy("path", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("path", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    numbered = rows.join(F.broadcast(starts), ["path", "_block"])
    return numbered.select("path", (F.col("_row") + F.col("_shift")).cast("int").alias("line_no"), "line")


def read_build_files(spark: SparkSession, path: str, glob: str = rules.BUILD_FILE) -> DataFrame:
    return read_tree(spark, path, glob)


def read_reports(spark: SparkSession, path: str, glob: str = "*" + rules.REPORT_SUFFIX) -> DataFrame:
    """Test reports as ``(path, xml)``."""
    return read_tree(spark, path, glob).withColumnRenamed("content", "xml")


# How the last line of a whole report ends: its root is closed, or a comment follows.
_REPORT_END = r"(?:</testsuites?\s*>|<testsuites?[^>]*/>|-->)\s*$"


def read_report_cases(spark: SparkSession, path: str, glob: str = "*" + rules.REPORT_SUFFIX) -> DataFrame:
    """Test cases of reports of any size as ``(path, case)``.

    Each file is read case by case, at whatever depth the cases lie; no report is held
    whole.  A report that is no well-formed XML, or that ends before its root does, has
    no cases: what was read of it before the fault is dropped.
    """
    fields = T.StructType([*schemas.TESTCASE.fields, T.StructField("_corrupt_record", T.StringType())])
    def files():
        return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)

    file = plain_path(F.col("_metadata.file_path")).alias("path")
    # stored: the reports are parsed once
    rows = stored(
        files().format("xml").option("rowTag", "testcase").schema(fields).load(path)
        .select(file, F.struct(*schemas.TESTCASE.names).alias("case"), F.col("_corrupt_record").isNotNull().alias("_broken")),
        "cases",
    )
    # flags and numbers only: an aggregate of texts would sort all lines
    lines = files().text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), "value",
    ).filter(F.trim("value") != "")
    # nearly all lines are told by their words, without the expression
    is_end = contains_any(F.col("value"), ("testsuite", "-->")) & F.rlike("value", F.lit(_REPORT_END))
    blocks = lines.groupBy("_file", "_block").agg(F.max_by(is_end, "_row").alias("_whole"))
    ends = blocks.groupBy(plain_path(F.col("_file")).alias("path")).agg(F.max_by("_whole", "_block").alias("_whole"))
    faulty = rows.filter("_broken").select("path").unionByName(ends.filter("not _whole").select("path")).distinct()
    # at most one row for each file; by path a large report would be one task's work
    return rows.filter("not _broken").join(F.broadcast(faulty), "path", "left_anti").select("path", "case")


def split_clone_path(df: DataFrame, clone_dir: str, path: str = "path") -> DataFrame:
    """Add ``sha`` and ``repo`` of the layout ``clone_dir/sha/repo/...``."""
    tail = F.substring_index(F.col(path), clone_dir.rstrip("/") + "/", -1)
    parts = F.split(tail, "/", 3)
    return df.withColumn("sha", F.try_element_at(parts, F.lit(1))).withColumn(
        "repo", F.try_element_at(parts, F.lit(2))
    )
