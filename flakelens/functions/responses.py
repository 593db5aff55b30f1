"""Model responses: code regions, imports and the patch struct."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from . import javacode
from .text import count_of, delimited_block, let, lines, swap_all, trim_ws

# a line that starts a method header: a modifier, or a type and a name with "("
_HEADER_START = (
    r"^\s*(?:(?:public|protected|private|static|final|abstract|synchronized|void)\b"
    r"|[\w$.<>\[\],?]+\s+[\w$]+\s*\([^()]*\)\s*(?:throws\b.*|\{.*)?$)"
)
# blank and comment lines, and lines that carry on a parameter or throws list
_HEADER_REST = r"^$|^(?://|/\*|\*)|^throws\b|[,)]$"
_REGIONS = "array<struct<start_line:int,end_line:int>>"
_STATE = f"struct<line:int,opened:int,closed:int,start:int,header:int,negative:boolean,regions:{_REGIONS}>"


def plain_lines(text: Column, markers: Sequence[str] = rules.FENCES) -> Column:
    """Lines of a response after every fence marker became a line break."""
    return lines(swap_all(text, markers, "\n"))


def regions(text_lines: Column, skip: str = "public class ",
            lifecycle: Sequence[str] = rules.LIFECYCLE_ANNOTATIONS) -> Column:
    """Balanced brace regions of a line array.

    Lines with ``skip`` do not count.  A region opens on the line that leaves
    more ``{`` than ``}`` open, on a lifecycle annotation, or on a line that
    opens and closes; it closes where both counts are equal.  Annotation and
    header lines directly before a region belong to it.  One surplus ``}``
    shifts what follows; ``negative`` says so.
    """
    marks = [f"@{name}" for name in lifecycle]

    def step(s: Column, line: Column) -> Column:
        # bound once per line: most conditions below ask for the counts
        braces = F.struct(count_of(line, "{").alias("opens"), count_of(line, "}").alias("closes"), trim_ws(line).alias("text"))
        return let(braces, lambda b: after(s, line, b["text"], b["opens"], b["closes"]))

    def after(s: Column, line: Column, text: Column, opens: Column, closes: Column) -> Column:
        number = s["line"] + 1
        opened, closed = s["opened"] + opens, s["closed"] + closes
        inside = s["start"].isNotNull()
        # header: first line directly before a region, negative once it holds
        # more than annotations
        began = F.abs(s["header"])
        only_annotations = F.coalesce(s["header"] > 0, F.lit(True))
        first = F.when(only_annotations, F.coalesce(began, number)).otherwise(number)
        own_line = F.rlike(line, F.lit(_HEADER_START))
        start = F.coalesce(s["start"], F.when(own_line, first).otherwise(F.coalesce(began, number)))

        def state(start, head, regions=s["regions"], opened=opened, closed=closed):
            return F.struct(
                number.alias("line"), opened.alias("opened"), closed.alias("closed"),
                start.alias("start"), head.alias("header"),
                (s["negative"] | (opened < closed)).alias("negative"), regions.alias("regions"),
            )

        none, zero = F.lit(None).cast("int"), F.lit(0)
        region = F.struct(start.alias("start_line"), number.alias("end_line"))
        ends = (opened == closed) & (closed > 0) & (inside | (opens > 0))
        outside = ~inside & (opens + closes == 0)
        continued = s["header"].isNotNull() & F.rlike(text, F.lit(_HEADER_REST))
        return (
            F.when(
                F.contains(line, F.lit(skip)),
                state(s["start"], none, opened=s["opened"], closed=s["closed"]),
            )
            .when(ends, state(none, none, F.concat(s["regions"], F.array(region)), zero, zero))
            .when(opened > closed, state(start, none))
            .when(text.isin(*marks), state(F.coalesce(s["start"], first), none))
            .when(outside & text.startswith("@"), state(none, first))
            .when(outside & own_line, state(none, -first))
            .when(outside & continued, state(none, s["header"]))
            .otherwise(state(s["start"], none))
        )

    start = F.struct(
        F.lit(0).alias("line"), F.lit(0).alias("opened"), F.lit(0).alias("closed"),
        F.lit(None).alias("start"), F.lit(None).alias("header"), F.lit(False).alias("negative"),
        F.array().alias("regions"),
    ).cast(_STATE)
    return F.aggregate(
        text_lines, start, step,
        lambda s: F.struct(s["regions"].alias("regions"), s["negative"].alias("negative")),
    )


def region_text(text_lines: Column, region: Column, skip: str = "public class ") -> Column:
    part = F.slice(
        text_lines, region["start_line"], region["end_line"] - region["start_line"] + 1
    )
    return F.array_join(F.filter(part, lambda x: ~F.contains(x, F.lit(skip))), "\n")


def response_class(response: Column) -> Column:
    """All regions of a response inside one block, so that surplus ends close nothing else."""
    return let(
        plain_lines(response),
        lambda ls: F.concat(
            F.lit("class Answer {\n"),
            F.array_join(
                F.transform(regions(ls)["regions"], lambda r: region_text(ls, r)), "\n"
            ),
            F.lit("\n\n}\n"),
        ),
    )


def test_code(response: Column, method_name: Column) -> Column:
    """Code of the last method with the name in a response."""
    found = let(
        response_class(response),
        lambda code: let(
            javacode.last_named(javacode.methods(code), method_name),
            lambda m: F.when(m.isNotNull(), javacode.code_of(code, m)),
        ),
    )
    # no fold for answers that cannot hold the method
    return F.when(
        F.contains(response, F.lit("{")) & F.contains(response, method_name), found
    )


def build_block(response: Column) -> Column:
    return delimited_block(response, rules.BUILD_BLOCK_RULES)


def import_statements(text: Column, pattern: str = rules.IMPORT_PATTERN) -> Column:
    """All import statements in the form ``import [static ]name;``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda i: F.regexp_replace(i, r"\s+", " "))


def short_import(statement: Column) -> Column:
    """``.`` and the last dotted part with its ``;``; wildcards all give ``.*;``."""
    return F.concat(F.lit("."), F.substring_index(statement, ".", -1))


def _clashes(statement: Column, originals: Column, wildcard_clash: bool) -> Column:
    short = short_import(statement)
    hit = F.exists(originals, lambda o: short_import(o) == short)
    return hit if wildcard_clash else hit & (short != ".*;")


def new_imports(wanted: Column, originals: Column, wildcard_clash: bool = False) -> Column:
    """Imports to add, in order, each once.

    Left out are those the source already has and those whose last segment an
    original import already binds.  Wildcards bind no name; with
    ``wildcard_clash`` one wildcard blocks all others.
    """
    return F.filter(
        F.array_distinct(wanted),
        lambda i: ~F.array_contains(originals, i) & ~_clashes(i, originals, wildcard_clash),
    )


def conflicting_imports(wanted: Column, originals: Column, wildcard_clash: bool = False) -> Column:
    """Imports left out although the source has another one of that name."""
    return F.filter(
        F.array_distinct(wanted),
        lambda i: ~F.array_contains(originals, i) & _clashes(i, originals, wildcard_clash),
    )


def patch(response: Column, method_name: Column, class_content: Column) -> Column:
    """``struct<test_code, imports, pom>``; parts a response lacks are null or empty."""
    return F.struct(
        test_code(response, method_name).alias("test_code"),
        new_imports(import_statements(response), import_statements(class_content)).alias("imports"),
        build_block(response).alias("pom"),
    )
