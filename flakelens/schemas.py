"""Schemas of the tables that go in and out."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, B, D = T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


MANIFEST_COLUMNS = (
    "project_url", "sha", "module", "test_fqn", "category", "status", "pr_link", "notes",
)
MANIFEST = _struct(*[(c, S) for c in MANIFEST_COLUMNS])
MODULES = _struct(("project_url", S), ("sha", S), ("module", S))

POSITION = _struct(("line", I), ("column", I))
METHOD = _struct(
    ("name", S), ("start", POSITION), ("end", POSITION),
    ("annotations", T.ArrayType(S)), ("is_constructor", B),
)
FIELD = _struct(("name", S), ("start_line", I), ("end_line", I))
PATCH = _struct(("test_code", S), ("imports", T.ArrayType(S)), ("pom", S))
EVIDENCE = _struct(
    ("summary", S), ("err_msg", S), ("err_code", S), ("err_methods", T.ArrayType(S)),
)
ATTEMPTS = _struct(
    ("test_id", S), ("iter", I), ("ts", T.TimestampType()), ("applied", B),
    ("prompt", S), ("response", S), ("patch", PATCH), ("summary", S),
    ("err_msg", S), ("err_code", S), ("err_methods", T.ArrayType(S)),
)

# JUnit-style report: cases below one root; deeper ones are brought there first
_PROBLEM = _struct(("_message", S), ("_type", S), ("_VALUE", S))
TESTCASE = _struct(
    ("_classname", S), ("_name", S), ("_time", S),
    ("error", T.ArrayType(_PROBLEM)), ("failure", T.ArrayType(_PROBLEM)),
)
TESTSUITE = _struct(("testcase", T.ArrayType(TESTCASE)), ("_corrupt_record", S))
