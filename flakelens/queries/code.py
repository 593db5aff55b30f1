"""Methods, helpers and fields of sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bigsources, lines, methods
from . import derived as d


def method_spans(spark, sf):
    return methods.method_table(d.sources(spark, sf), ["test_id"]).select(
        "test_id", "name", "start_line", "end_line", "code",
        F.array_join("annotations", ",").alias("annotations"), "is_constructor",
    )


def test_method(spark, sf):
    """The method of each test; of overloads the last one."""
    sources = d.sources(spark, sf)
    tests = sources.select("test_id", F.lit("check").alias("name"))
    found = methods.method_table(sources, ["test_id"])
    return methods.method_of_test(tests, found, ["test_id"]).select(
        "test_id", "name", "start_line", "end_line", "code"
    )


def helper_methods(spark, sf):
    found = methods.method_table(d.sources(spark, sf), ["test_id"])
    return methods.helper_rows(found, ["test_id"])


def field_map(spark, sf):
    """Last declaration per field name."""
    found = methods.field_table(d.sources(spark, sf), ["test_id"])
    return lines.last_wins(found, ["test_id", "name"], ["line_no"], "declaration")


def earliest_line(spark, sf):
    found = methods.method_table(d.sources(spark, sf), ["test_id"])
    return methods.earliest_lines(found, ["test_id"])


def source_structure(spark, sf):
    """Per-row form of the helper record and the field map."""
    s = d.sources(spark, sf).select(
        "test_id", methods.source_structure(F.col("content")).alias("s")
    )
    return s.select(
        "test_id",
        F.array_join(F.map_keys("s.before"), ",").alias("before_names"),
        F.array_join(F.map_values("s.after"), "\n").alias("after_code"),
        F.col("s.earliest_line").alias("earliest_line"),
        F.array_join("s.helper_method_names", ",").alias("helpers"),
        F.array_join(F.map_keys("s.global_vars"), ",").alias("fields"),
    )


_METHODS = d.methods_sql()
_CODE = d.slice_sql("content", "start_line", "end_line")
_FIELDS = ", ".join(f"('{n}', {a}, {b})" for n, a, b in d.SOURCE_FIELDS)

def _source_lines(spark, sf, file):
    """All sources of a group one after the other as the lines of one large file."""
    sources = d.sources(spark, sf).select("test_id", "content")
    # a row for each source: not to be broadcast, however small the table's file is
    files = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("test_id"), file.alias("file")).hint("merge")
    sizes = sources.select("test_id", F.size(F.split("content", "\n", -1)).alias("n")).join(files, "test_id")
    before = Window.partitionBy("file").orderBy("test_id").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.select("test_id", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = lines.line_table(sources.join(places.hint("merge"), "test_id"), ["file", "before"])
    return rows.select("file", (F.col("line_no") + F.col("before")).alias("line_no"), "line")


def large_source_spans(spark, sf):
    """Methods of one large source for each nation, lexed and matched in chunks."""
    found, _ = bigsources.spans_of_lines(_source_lines(spark, sf, F.col("c_nationkey")), ["file"])
    return found.select(
        "file", "name", "start_line", "end_line", "is_unclosed", F.array_join("annotations", ",").alias("annotations"), "is_constructor"
    )


QUERIES = {
    "method_spans": (
        method_spans,
        f"""SELECT test_id, name, start_line, end_line, {_CODE} AS code,
        CASE WHEN name = 'setUp' THEN 'Before' WHEN name = 'tearDown' THEN 'After'
          WHEN name = 'check' AND end_line - start_line = 11 THEN 'Test' ELSE '' END AS annotations,
        starts_with(name, 'User') AS is_constructor FROM ({_METHODS})""",
    ),
    "test_method": (
        test_method,
        f"""SELECT test_id, name, start_line, end_line, {_CODE} AS code FROM ({_METHODS})
        WHERE name = 'check' AND end_line - start_line = 3""",
    ),
    "helper_methods": (
        helper_methods,
        f"""SELECT test_id, CASE name WHEN 'setUp' THEN 'before' ELSE 'after' END AS phase, name,
        start_line, {_CODE} AS code FROM ({_METHODS}) WHERE name IN ('setUp', 'tearDown')""",
    ),
    "field_map": (
        field_map,
        f"""SELECT test_id, f.name, {d.slice_sql('content', 'f.a + gap', 'f.b + gap')} AS declaration
        FROM ({d.sources_sql()}) CROSS JOIN (VALUES {_FIELDS}) f(name, a, b)""",
    ),
    "earliest_line": (
        earliest_line,
        f"SELECT test_id, CAST(gap + 15 AS INTEGER) AS earliest_line FROM ({d.sources_sql()})",
    ),
    "source_structure": (
        source_structure,
        f"""SELECT test_id, 'setUp' AS before_names, '    @After public void tearDown() {{ sizes = null; }}'
        || chr(10) AS after_code, CAST(gap + 15 AS INTEGER) AS earliest_line, 'setUp,tearDown' AS helpers,
        'BRACE,sizes,balance,names' AS fields FROM ({d.sources_sql()})""",
    ),
}
_OFFSETS = f"""SELECT test_id, c_nationkey AS file, CAST(coalesce(sum(len(string_split(content, chr(10)))) OVER (
PARTITION BY c_nationkey ORDER BY test_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS before
FROM ({d.sources_sql()}) JOIN customer ON c_custkey = test_id"""
QUERIES["large_source_spans"] = (
    large_source_spans,
    f"""SELECT file, name, start_line + before AS start_line, end_line + before AS end_line, false AS is_unclosed,
    CASE name WHEN 'setUp' THEN 'Before' WHEN 'tearDown' THEN 'After' WHEN 'check' THEN
      CASE WHEN end_line - start_line > 5 THEN 'Test' ELSE '' END ELSE '' END AS annotations,
    starts_with(name, 'User') AS is_constructor
    FROM ({d.methods_sql()}) m JOIN ({_OFFSETS}) o ON o.test_id = m.test_id""",
)
