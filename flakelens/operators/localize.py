"""Find the source file of each test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import fqn as names
from ..functions import text


def is_candidate(path, class_path, short_class, module, suffix: str = rules.SOURCE_SUFFIX,
                 test_dir: str = rules.TEST_DIR):
    """Does a path hold the test class?"""
    return (
        F.endswith(text.last_segment(path), F.concat(short_class, F.lit(suffix)))
        & F.contains(path, class_path)
        & F.contains(path, module)
        & F.contains(F.lower(path), F.lit(test_dir))
    )


def _stem_suffixes(files: DataFrame, suffix: str, only_path_parts: bool) -> DataFrame:
    """Every class name a file name can end with, one row each.

    A name with a package must follow a ``/`` somewhere in the path, which
    leaves the file's own stem and, rarely, a directory of the same name.
    """
    stem = F.regexp_replace(text.last_segment(F.col("path")), text.quote(suffix) + "$", "")
    ends = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(stem), F.lit(1))),
        lambda i: F.substring(stem, i, F.length(stem)),
    )
    if only_path_parts:
        ends = F.filter(ends, lambda s: F.contains(F.col("path"), F.concat(F.lit("/"), s)))
    return files.withColumn("_short", F.explode_outer(F.array_distinct(ends))).filter(
        F.col("_short").isNotNull()
    )


def _inner_paths(stems: DataFrame, depths: list[int]) -> DataFrame:
    """Each file under the paths that a class of its name can have in it, one row each.

    A path is the class name after its last ``depth`` directories, wherever the path has
    the name; only depths that some test asks for are made.
    """
    short = F.col("_short")
    parts = F.split(F.col("path"), F.concat(F.lit("/\\Q"), short, F.lit("\\E")), -1)
    before = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda j: F.call_function("array_join", F.slice(parts, F.lit(1), j), F.concat(F.lit("/"), short))
    )

    def under(prefix):
        folders = F.split(prefix, "/", -1)
        return F.array_compact(F.array(*[
            F.when(F.size(folders) >= depth, F.array_join(F.concat(F.slice(folders, F.size(folders) - depth + 1, F.lit(depth)), F.array(short)), "/"))
            if depth else short for depth in depths
        ]))

    return stems.withColumn(
        "_inner", F.explode_outer(F.array_distinct(F.flatten(F.transform(before, under))))
    ).filter(F.col("_inner").isNotNull())


def _met(packaged: DataFrame, paths: DataFrame, suffix: str) -> DataFrame:
    """Tests and files that share class path (but for its first directory) and class name."""
    # at most as many as the deepest package has parts
    depths = [r[0] for r in packaged.select(F.size(F.split("_inner", "/")) - 1).distinct().collect()]
    listed = _inner_paths(_stem_suffixes(paths, suffix, True), sorted(depths) or [0]).drop("_short")
    return packaged.join(listed, ["repo", "sha", "_inner"])


def candidates(manifest: DataFrame, files: DataFrame, suffix: str = rules.SOURCE_SUFFIX,
               test_dir: str = rules.TEST_DIR) -> DataFrame:
    """All (test, file) pairs, inner.

    ``manifest`` needs ``test_id, repo, sha, module, test_fqn``; ``files`` needs
    ``repo, sha, path``.  The join key is the class path without its first directory
    (which may be the end of a longer name), so neither a large repository nor a class
    name that all its modules share pairs a test with files of other packages; the path
    conditions are the residual.  A test that the manifest lists more than once (in several
    categories, say) is looked for once.
    """
    tests = manifest.select(
        "test_id", "repo", "sha", "module",
        names.short_class(F.col("test_fqn")).alias("_short"),
        names.class_path(F.col("test_fqn")).alias("_class_path"),
    ).filter(F.col("_short").isNotNull()).distinct()
    paths = files.select("repo", "sha", "path").filter(
        F.endswith(F.col("path"), F.lit(suffix)) & F.contains(F.lower("path"), F.lit(test_dir))
    )
    residual = is_candidate(
        F.col("path"), F.col("_class_path"), F.col("_short"), F.col("module"), suffix, test_dir
    )
    packaged = tests.filter(F.contains("_class_path", F.lit("/"))).withColumn(
        "_inner", F.regexp_replace("_class_path", "^[^/]*/", "")
    )
    bare = tests.filter(~F.contains("_class_path", F.lit("/")))
    found = _met(packaged, paths, suffix).filter(residual)
    # classes without a package can match in the middle of a name: all suffixes,
    # but only of the repositories that have such a test
    bare_paths = paths.join(bare.select("repo", "sha").distinct(), ["repo", "sha"], "left_semi")
    found_bare = bare.join(_stem_suffixes(bare_paths, suffix, False), ["repo", "sha", "_short"]).filter(residual)
    return found.select("test_id", "path").unionByName(found_bare.select("test_id", "path"))


def localize(manifest: DataFrame, files: DataFrame, **kw) -> DataFrame:
    """Manifest with ``n_candidates``, ``status`` and, if unique, ``path``."""
    found = candidates(manifest, files, **kw).groupBy("test_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("_path")
    )
    n = F.coalesce(F.col("n"), F.lit(0))
    return (
        manifest.join(found, "test_id", "left")
        .withColumn("n_candidates", n)
        .withColumn(
            "localization_status",
            F.when(n == 0, F.lit(rules.NOT_LOCALIZED))
            .when(n > 1, F.lit(rules.AMBIGUOUS))
            .otherwise(F.lit(rules.LOCALIZED)),
        )
        .withColumn("path", F.when(n == 1, F.col("_path")))
        .drop("n", "_path")
    )
