"""Build files: JDK choice and dependency fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import after_first, contains_any, drop_all, lines

DEPENDENCY = "array<struct<artifact_id:string,xml:string,is_placeholder:boolean>>"


def jdk_lines(content: Column, pattern: str = rules.JDK_LINE_PATTERN) -> Column:
    return F.filter(lines(content), lambda x: F.rlike(x, F.lit(pattern)))


def jdk_class(has_text: dict[str, Column], url: Column, project: Column,
              text_rules=rules.JDK_TEXT_RULES, by_url=rules.JDK_BY_URL,
              by_project=rules.JDK_BY_PROJECT, default: str = rules.JDK_DEFAULT) -> Column:
    """JDK of a project.  ``has_text`` maps each rule text to "some line has it"."""
    result = F
    for text, jdk in text_rules:
        result = result.when(has_text[text], F.lit(jdk))
    for value, jdk in by_url.items():
        result = result.when(url == value, F.lit(jdk))
    for value, jdk in by_project.items():
        result = result.when(project == value, F.lit(jdk))
    return result.otherwise(F.lit(default))


def jdk_of_file(content: Column, url: Column, project: Column, **kw) -> Column:
    """Per-row form for a build file held in one column."""
    text = F.array_join(jdk_lines(content), "\n")
    pairs = kw.get("text_rules", rules.JDK_TEXT_RULES)
    return jdk_class({t: F.contains(text, F.lit(t)) for t, _ in pairs}, url, project, **kw)


def unwrap(pom: Column) -> Column:
    """Remove the tags that wrap a dependency list."""
    return drop_all(pom, rules.DEPENDENCY_WRAPPERS)


def artifact_id(fragment: Column) -> Column:
    return F.substring_index(after_first(fragment, "<artifactId>"), "</artifactId>", 1)


def dependencies(pom: Column) -> Column:
    """Dependency fragments of a text, in order."""
    parts = F.filter(
        F.split(pom, "</dependency>", -1),
        lambda p: F.contains(p, F.lit("<dependency>")),
    )
    # the part between a first and a second opening tag, if there are two
    bodies = F.transform(
        parts, lambda p: F.try_element_at(F.split(p, "<dependency>", 3), F.lit(2))
    )
    bodies = F.filter(bodies, lambda b: F.contains(b, F.lit("<artifactId>")))
    return F.transform(
        bodies,
        lambda b: F.struct(
            artifact_id(b).alias("artifact_id"),
            F.concat(F.lit("<dependency>\n"), b, F.lit("</dependency>\n")).alias("xml"),
            contains_any(artifact_id(b), rules.PLACEHOLDER_ARTIFACTS).alias("is_placeholder"),
        ),
    )


def has_artifact(content: Column, artifact: Column) -> Column:
    return F.contains(
        content, F.concat(F.lit("<artifactId>"), artifact, F.lit("</artifactId>"))
    )


def missing_dependencies(pom: Column, build_content: Column) -> Column:
    """Fragments to add: not in the build file, no placeholder, first one wins."""
    # carry the ids already taken, so that a repeated artifact is added once
    zero = F.struct(
        F.array().cast("array<string>").alias("ids"), F.array().cast(DEPENDENCY).alias("deps")
    )
    wanted = F.filter(
        dependencies(pom),
        lambda d: ~d["is_placeholder"] & ~has_artifact(build_content, d["artifact_id"]),
    )

    def take(state: Column, dep: Column) -> Column:
        seen = F.array_contains(state["ids"], dep["artifact_id"])
        return F.when(seen, state).otherwise(
            F.struct(
                F.concat(state["ids"], F.array(dep["artifact_id"])).alias("ids"),
                F.concat(state["deps"], F.array(dep)).alias("deps"),
            )
        )

    return F.aggregate(wanted, zero, take, lambda s: s["deps"])


def insert_after(content: Column, anchor: str, added: Column) -> Column:
    """Insert lines after every line that contains ``anchor``."""
    with_added = F.flatten(
        F.transform(
            lines(content),
            lambda x: F.when(F.contains(x, F.lit(anchor)), F.concat(F.array(x), added)).otherwise(
                F.array(x)
            ),
        )
    )
    return F.when(F.size(added) > 0, F.array_join(with_added, "\n")).otherwise(content)


def add_dependencies(pom: Column, build_content: Column) -> Column:
    """Build file with the missing fragments after each ``<dependencies>``."""
    new = F.transform(
        missing_dependencies(unwrap(pom), build_content),
        lambda d: F.rtrim(d["xml"], F.lit("\n")),
    )
    return F.when(pom.isNull(), build_content).otherwise(
        insert_after(build_content, rules.DEPENDENCIES_ANCHOR, new)
    )
