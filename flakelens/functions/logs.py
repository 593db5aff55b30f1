"""Mining of one run log held in one column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from . import fqn as names
from .text import (
    after_last,
    contains_all,
    contains_any,
    let,
    lines,
    ordered_distinct,
    plain_path,
    region_between,
    strip_marker,
    trim_ws,
)

Rules = Sequence[tuple[str, Sequence[str]]]


def verdict(content: Column, verdict_rules: Rules = rules.VERDICT_RULES,
            default: str = rules.UNRECOGNIZED) -> Column:
    """First rule whose markers all occur; never fails on an unknown log."""
    result = F
    for name, markers in verdict_rules:
        result = result.when(contains_all(content, markers), F.lit(name))
    return result.otherwise(F.lit(default))


def is_error_line(line: Column, prefix: str = rules.ERROR_PREFIX,
                  noise: Sequence[str] = rules.ERROR_NOISE) -> Column:
    return F.startswith(line, F.lit(prefix)) & ~contains_any(line, noise)


def error_lines(content: Column, prefix: str = rules.ERROR_PREFIX,
                noise: Sequence[str] = rules.ERROR_NOISE) -> Column:
    """Ordered distinct error lines without marker and noise."""
    kept = F.filter(lines(content), lambda x: is_error_line(x, prefix, noise))
    return ordered_distinct(F.transform(kept, lambda x: strip_marker(x, prefix)))


def _as_line(text: Column) -> Column:
    return F.trim(text).try_cast("int")


def line_number(line: Column, file_name: Column) -> Column:
    """Line number a log line gives for ``file_name``, or null.

    Two forms: ``File.java:12)`` and ``File.java:[12,5]``.  If the line has
    brackets and the bracket form gives a number, that one is used.
    """
    tail = F.call_function(
        "substring_index", line, F.concat(file_name, F.lit(":")), F.lit(-1)
    )
    plain = _as_line(F.substring_index(tail, ")", 1))
    bracket = _as_line(
        F.substring_index(F.substring_index(F.substring_index(tail, "[", -1), ",", 1), "]", 1)
    )
    bracket = F.when(F.contains(line, F.lit("[")) & F.contains(line, F.lit("]")), bracket)
    return F.when(F.contains(line, file_name), F.coalesce(bracket, plain))


def line_numbers(content: Column, file_name: Column) -> Column:
    """Ordered distinct line numbers of the file over the whole log."""
    return _line_numbers(lines(content), file_name)


def _line_numbers(all_lines: Column, file_name: Column) -> Column:
    hits = F.filter(all_lines, lambda x: F.contains(x, file_name))
    return ordered_distinct(F.transform(hits, lambda x: line_number(x, file_name)))


def is_frame(line: Column, class_fqn: Column, prefix: str = rules.FRAME_PREFIX) -> Column:
    """A stack frame of the class."""
    return (
        F.contains(line, F.lit(prefix))
        & F.contains(line, class_fqn)
        & F.contains(line, F.lit(":"))
        & F.contains(line, F.lit(")"))
    )


def _frame_text(line: Column, prefix: str) -> Column:
    mark = prefix.rstrip(" ")
    return F.substring(
        line, F.locate(mark, line) + F.lit(len(mark)), F.length(line)
    )


def frame_line(line: Column, prefix: str = rules.FRAME_PREFIX) -> Column:
    """Number between the first ``:`` and the following ``)``."""
    after = F.try_element_at(F.split(_frame_text(line, prefix), ":", 3), F.lit(2))
    return _as_line(F.substring_index(after, ")", 1))


def frame_method(line: Column, class_fqn: Column, prefix: str = rules.FRAME_PREFIX) -> Column:
    """Method of the class a frame is in; null for frames of inner names."""
    text = F.replace(_frame_text(line, prefix), F.lit(" "), F.lit(""))
    owner = F.concat(class_fqn, F.lit("."))
    return F.when(
        F.contains(line, owner), F.replace(F.substring_index(text, "(", 1), owner, F.lit(""))
    )


def _frames(all_lines: Column, class_fqn: Column) -> Column:
    return F.filter(all_lines, lambda x: is_frame(x, class_fqn))


def _frame_methods(all_lines: Column, class_fqn: Column) -> Column:
    return ordered_distinct(
        F.transform(_frames(all_lines, class_fqn), lambda x: frame_method(x, class_fqn))
    )


def frame_methods(content: Column, class_fqn: Column) -> Column:
    return _frame_methods(lines(content), class_fqn)


def frame_lines(content: Column, class_fqn: Column) -> Column:
    return ordered_distinct(
        F.transform(_frames(lines(content), class_fqn), lambda x: frame_line(x))
    )


def is_compile_failure(content: Column) -> Column:
    return F.contains(content, F.lit(rules.COMPILE_MARKER))


def compile_region(content: Column) -> Column:
    return region_between(content, rules.REGION_START, rules.REGION_END, (rules.REGION_NOISE,))


def compile_messages(content: Column, file_name: Column) -> Column:
    """Ordered distinct compiler messages of the closing log region."""
    kept = F.filter(
        lines(compile_region(content)),
        lambda x: F.startswith(x, F.lit(rules.ERROR_PREFIX))
        & ~F.contains(x, F.lit(rules.GOAL_FAILED)),
    )

    def message(line: Column) -> Column:
        return let(
            strip_marker(line, rules.ERROR_PREFIX),
            lambda t: F.when(F.contains(t, file_name), after_last(t, "]")).otherwise(t),
        )

    return ordered_distinct(F.transform(kept, message))


def report_dir(line: Column) -> Column:
    """Directory of the test reports a log line refers to."""
    named = F.contains(line, F.lit(rules.REPORT_DIR_START)) & F.contains(
        line, F.lit(rules.REPORT_DIR_END)
    )
    tail = after_last(line, rules.REPORT_DIR_START)
    return F.when(named, trim_ws(plain_path(trim_ws(F.substring_index(tail, rules.REPORT_DIR_END, 1)))))


def report_dirs(content: Column) -> Column:
    return _report_dirs(lines(content))


def _report_dirs(all_lines: Column) -> Column:
    hits = F.filter(all_lines, lambda x: F.contains(x, F.lit(rules.REPORT_DIR_START)))
    return ordered_distinct(F.transform(hits, lambda x: report_dir(x)))


def log_evidence(content: Column, fqn: Column) -> Column:
    """All per-log evidence of one run in a struct; no shuffle."""
    # bound once per log: lambdas over lines would cut the names out for every line
    bound = F.struct(
        lines(content).alias("lines"), names.class_file(fqn).alias("file"), names.class_fqn(fqn).alias("class"),
        is_compile_failure(content).alias("compiles"),
    )
    none = F.array().cast("array<string>")
    return let(
        bound,
        lambda b: F.struct(
            verdict(content).alias("summary"),
            b["compiles"].alias("is_compile_failure"),
            F.when(b["compiles"], compile_messages(content, b["file"])).otherwise(none).alias("compile_messages"),
            _line_numbers(b["lines"], b["file"]).alias("line_numbers"),
            _frame_methods(b["lines"], b["class"]).alias("err_methods"),
            F.when(b["compiles"], none).otherwise(_report_dirs(b["lines"])).alias("report_dirs"),
        ),
    )


def build_lines(content: Column, marker: str = rules.BUILD_MARKER) -> Column:
    return F.filter(lines(content), lambda x: F.contains(x, F.lit(marker)))
