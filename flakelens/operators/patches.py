"""Responses to patches, patches to patched text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import builds, javacode, patches, responses
from ..functions import fqn as names
from ..functions.text import let
from .lines import generate


def prepare_tests(tests: DataFrame, method: str = "method_name",
                  content: str = "content") -> DataFrame:
    """Add ``method_code`` and ``original_imports`` of each test's source.

    Done once per test, before any join with attempts: a source is scanned once
    however many responses there are for it.  A source whose braces do not match has
    no trusted spans, so no method is cut from it and no patch is applied to it.
    """
    source = F.col(content)
    code = let(
        let(javacode.scan(source), lambda s: F.when(~s["unclosed"], javacode.last_named(s["methods"], F.col(method)))),
        lambda m: F.when(m.isNotNull(), javacode.code_of(source, m)),
    )
    return tests.withColumns(
        {"method_code": code, "original_imports": responses.import_statements(source)}
    )


def parse_responses(answers: DataFrame, tests: DataFrame, key: str = "test_id",
                    response: str = "response", method: str = "method_name") -> DataFrame:
    """Answers with a ``patch`` struct.

    ``tests`` has ``key`` and ``original_imports``.  Responses are reduced to
    their parts first, so neither response nor source text meets the join.
    """
    text = F.col(response)
    kept = [c for c in answers.columns if c != response]
    parts = answers.select(
        *kept,
        responses.test_code(text, F.col(method)).alias("_code"),
        responses.import_statements(text).alias("_wanted"),
        responses.build_block(text).alias("_pom"),
    )
    joined = parts.join(tests.select(key, "original_imports"), key)
    return joined.select(
        *kept,
        F.struct(
            F.col("_code").alias("test_code"),
            responses.new_imports(F.col("_wanted"), F.col("original_imports")).alias("imports"),
            F.col("_pom").alias("pom"),
        ).alias("patch"),
    )


def apply_patches(parsed: DataFrame, tests: DataFrame, key: str = "test_id",
                  content: str = "content", build: str | None = None) -> DataFrame:
    """Add ``patched_content`` and, with a build file column, ``patched_build``.

    ``tests`` comes from ``prepare_tests``.
    """
    columns = [key, content, "method_code"] + ([build] if build else [])
    # texts are large whatever the planner estimates: no broadcast of them
    out = parsed.join(tests.select(*columns).hint("merge"), key).withColumn(
        "patched_content",
        patches.apply_to_source(F.col(content), F.col("method_code"), F.col("patch")),
    )
    if build is None:
        return out
    return out.withColumn(
        "patched_build", builds.add_dependencies(F.col("patch.pom"), F.col(build))
    )


def build_paths(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumn("build_path", names.build_path(F.col(path)))


def import_rows(df: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """Import statements in row form with their short names."""
    found = responses.import_statements(F.col(content))
    rows = df.select(*keys, F.posexplode_outer(found).alias("pos", "statement"))
    return rows.filter("statement is not null").select(
        *keys, (F.col("pos") + 1).alias("import_no"), "statement",
        responses.short_import(F.col("statement")).alias("short_name"),
    )


def new_import_rows(wanted: DataFrame, originals: DataFrame, keys: Sequence[str],
                    statement: str = "statement", short: str = "short_name",
                    wildcard_clash: bool = False) -> DataFrame:
    """Table form: wanted imports with ``is_new`` and ``is_conflict``.

    Both lookups are equi joins against distinct keys, so they keep one row per
    wanted import.
    """
    full = originals.select(*keys, statement).distinct().withColumn("_full", F.lit(True))
    names_ = originals.select(*keys, short).distinct()
    if not wildcard_clash:
        names_ = names_.filter(F.col(short) != ".*;")
    names_ = names_.withColumn("_short", F.lit(True))
    seen = F.coalesce(F.col("_full"), F.lit(False))
    bound = F.coalesce(F.col("_short"), F.lit(False))
    return (
        wanted.join(full, [*keys, statement], "left")
        .join(names_, [*keys, short], "left")
        .withColumn("is_new", ~seen & ~bound)
        .withColumn("is_conflict", ~seen & bound)
        .drop("_full", "_short")
    )


def dependency_rows(df: DataFrame, keys: Sequence[str], pom: str = "pom") -> DataFrame:
    """Dependency fragments of a text in row form."""
    found = builds.dependencies(builds.unwrap(F.col(pom)))
    return df.select(*keys, F.inline_outer(found)).filter("artifact_id is not null")


def missing_dependency_rows(wanted: DataFrame, present: DataFrame, keys: Sequence[str],
                            by: Sequence[str] = ()) -> DataFrame:
    """Wanted artifacts the build file lacks, each once, no placeholders.

    ``keys`` name the build file; ``by`` names who asks, if that is not the same.
    """
    absent = wanted.filter(~F.col("is_placeholder")).join(
        present.select(*keys, "artifact_id"), [*keys, "artifact_id"], "left_anti"
    )
    return absent.groupBy(*(by or keys), "artifact_id").agg(
        F.min("xml").alias("xml"), F.count(F.lit(1)).alias("n_asked")
    )


def artifact_rows(df: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """Artifact ids a build file names, from its lines."""
    found = F.regexp_extract_all(
        F.col(content), F.lit("<artifactId>([^<\n]*)</artifactId>"), F.lit(1)
    )
    return generate(df, keys, F.array_distinct(found), "artifact_id")


def jdk_by_project(lines: DataFrame, keys: Sequence[str], url: str = "project_url",
                   project: str = "project", line: str = "line", **lists) -> DataFrame:
    """JDK per project from a table of build-file lines; one map-side aggregate.

    ``lists`` goes to ``builds.jdk_class``: with empty ``by_url`` and
    ``by_project`` no project is decided by name.
    """
    text = F.col(line)
    is_jdk = F.rlike(text, F.lit(rules.JDK_LINE_PATTERN))
    flags = lines.groupBy(*keys).agg(
        *[F.bool_or(is_jdk & F.contains(text, F.lit(t))).alias(f"_has_{t}")
          for t, _ in rules.JDK_TEXT_RULES]
    )
    has = {t: F.col(f"_has_{t}") for t, _ in rules.JDK_TEXT_RULES}
    return flags.select(*keys, builds.jdk_class(has, F.col(url), F.col(project), **lists).alias("jdk"))
