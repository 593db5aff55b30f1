"""Apply patches to source text; the result is a column, no file is edited."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import javacode
from .text import let


def replace_method(content: Column, old_code: Column, new_code: Column) -> Column:
    """Every occurrence of the old method becomes the new one on lines of its own."""
    return F.when(
        new_code.isNotNull() & old_code.isNotNull() & (old_code != ""),
        F.replace(content, old_code, F.concat(F.lit("\n"), new_code, F.lit("\n"))),
    ).otherwise(content)


def _split_at(content: Column, anchor: Column, build) -> Column:
    at = F.position(anchor, content)
    head = F.substring(content, F.lit(1), at - 1)
    tail = F.substring(content, at + F.length(anchor), F.length(content))
    return build(head, tail)


def insert_imports(content: Column, imports: Column, anchor: str = "public class ") -> Column:
    """Add imports after the package statement, else before the first class."""
    block = F.array_join(imports, "\n")
    package = javacode.package_statement(content)

    def after_package(p: Column) -> Column:
        return _split_at(
            content, p,
            lambda head, tail: F.concat(
                head, F.lit("\n"), p, F.lit("\n"), block, F.lit("\n"), tail
            ),
        )

    before_class = _split_at(
        content, F.lit(anchor),
        lambda head, tail: F.concat(head, block, F.lit("\n" + anchor), tail),
    )
    placed = let(
        package,
        lambda p: F.when(p.isNotNull() & F.contains(content, p), after_package(p))
        .when(F.contains(content, F.lit(anchor)), before_class)
        .otherwise(content),
    )
    return F.when(F.size(imports) > 0, placed).otherwise(content)


def apply_to_source(content: Column, old_code: Column, patch: Column) -> Column:
    replaced = replace_method(content, old_code, patch["test_code"])
    return let(replaced, lambda text: insert_imports(text, patch["imports"]))
