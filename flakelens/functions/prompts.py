"""Prompt assembly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules

# Slots: method name, class code, error message, error code, method names.
# The markers asked for are those the response functions read.
TEMPLATE = (
    "The Java test %1$s fails on some runs and passes on others. Repair it.\n"
    "Code:\n%2$s\n"
    "Observed error:\n%3$s\n"
    "Raised by '%4$s' in %5$s.\n"
    f"Return the complete changed code between {rules.FIX_START} and {rules.FIX_END}, "
    f"new imports between {rules.IMPORT_START} and {rules.IMPORT_END}, "
    "and new build dependencies in an ```xml block. "
    "Keep all methods and their signatures, add no helpers, "
    "start any other text with //.\n"
)


def context_code(before: Column, after: Column, global_vars: Column, method_code: Column) -> Column:
    """Newline-join of the non-empty parts a model sees."""
    parts = [F.array_join(F.map_values(m), "\n") for m in (before, after, global_vars)]
    return F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in (*parts, method_code)])


def prompt(method_name: Column, code: Column, err_msg: Column, err_code: Column,
           err_methods: Column, template: str = TEMPLATE) -> Column:
    blank = [F.coalesce(c, F.lit("")) for c in
             (method_name, code, err_msg, err_code, F.array_join(err_methods, ", "))]
    return F.format_string(template, *blank)


def evidence_for(iteration: Column, initial: Column, previous: Column) -> Column:
    """Attempt 0 sees the initial run, a later one the run before it."""
    return F.when(iteration == 0, initial).otherwise(F.coalesce(previous, initial))
