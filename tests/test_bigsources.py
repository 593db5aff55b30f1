"""Spans from lines equal the scan of whole sources, wherever they are cut."""

import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flakelens.operators import bigsources, methods
from flakelens.operators.lines import line_table
from flakelens.queries import derived

SF = "/root/testdata/sf0.001"
PIECES = [
    "class A {", "public class B<T> extends C {", "interface I {", "enum E { X, Y { void e() { } }, Z(1) { int k() { return 1; } };",
    "}", "}", "}", "}", "  }", "};", "});", "void a() {", "  public int b(int x, String... y) throws E {", "A(int x) {", "B() { super(); }",
    "@Before", "@Test(expected = Error.class)", "@SuppressWarnings({\"a\", \"b\"}) public", "static {", "abstract int size();", "int x = 1;",
    "private int[] sizes = {", "1, 2, 3", "List<String> names = new ArrayList<>();", "Runnable r = new Runnable() {", "go(new C<D>(1) {", ", new F() {",
    "for (int i = 0; i < n; i++) {", "if (x) { y(); } else {", "while (x)", "{", "String s = \"}{ \\\" // /*\";", "char c = '{';", "// } comment {", "/* one } line */",
    "/* open {", "still } inside", "*/", "*/ void late() { }", "String t = \"\"\"", "text { block \\\"\"\" }", "\"\"\";", "\"\"\" + f() + \"\"\"", "", "   ", "x -> { return 1; }",
    "return new int[] {1};", "public static", "Map<String, List<X>> make(int a,", "    int b)", "    throws E1, E2", "int p, q = f(1), r[];", "'\\''", "it's a \"quote", "record R(int a) {", "class",
    "Named {", "default int d() { return 1; }", "a = b", "Object o = new Object[] {", "case 1: {", "throw new X() {",
]


def samples():
    """Sources written out in the tests of the scan."""
    text = Path(__file__).with_name("test_javacode.py").read_text()
    found = re.findall(r'"((?:[^"\\]|\\.)*[{}](?:[^"\\]|\\.)*)"', text)
    return [f.encode().decode("unicode_escape") for f in found]


def made(seed, n):
    rnd = random.Random(seed)
    return ["\n".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 40))) + rnd.choice(["", "\n"]) for _ in range(n)]


def never_closed(code):
    """Sources that end inside a comment or text block are read differently, on purpose."""
    last = [t[0] for t in re.finditer(bigsources._TOKENS, code)][-1:]
    return any(
        t.startswith("/*") and not (len(t) > 3 and t.endswith("*/"))
        or t.startswith('"""') and not re.fullmatch("(?s)" + bigsources._TEXT_BLOCK, t) for t in last
    )


def rows(df, *columns):
    out = Counter()
    for r in df.select("id", *columns).collect():
        out[tuple(tuple(v) if isinstance(v, list) else v for v in r)] += 1
    return out


METHOD = ("start_line", "start_column", "end_line", "end_column", "name", "annotations", "is_constructor")
FIELD = ("name", "start_line", "end_line")


def check(spark, sources, chunk_lines):
    df = spark.createDataFrame(list(enumerate(sources)), "id int, content string")
    whole_methods = methods.method_table(df, ["id"])
    scanned = df.select("id", F.expr("content"), methods.javacode.scan(F.col("content")).alias("s"))
    whole_fields = scanned.select("id", F.inline_outer("s.fields")).filter("name is not null")
    got_methods, got_fields = bigsources.spans_of_lines(line_table(df, ["id"]).select("id", "line_no", "line"), ["id"], chunk_lines)
    for got, want, columns in ((got_methods, whole_methods, METHOD), (got_fields, whole_fields, FIELD)):
        got, want = rows(got, *columns), rows(want, *columns)
        wrong = sorted({r[0] for r in (got - want) + (want - got)})
        assert not wrong, (sources[wrong[0]], [r for r in got - want if r[0] == wrong[0]], [r for r in want - got if r[0] == wrong[0]])
    unclosed = {r.id for r in whole_methods.filter("is_unclosed").select("id").distinct().collect()}
    assert {r.id for r in got_methods.filter("is_unclosed").select("id").distinct().collect()} == unclosed


@pytest.mark.parametrize(("chunk_lines", "n"), [(1, 15), (3, 80), (1000, 80)])
def test_spans_equal_the_scan(spark, chunk_lines, n):
    sources = [s for s in samples()[:n] + made(chunk_lines, n) if not never_closed(s)]
    assert len(sources) > n
    check(spark, sources, chunk_lines)


def test_given_sources(spark):
    sources = [r.content for r in derived.sources(spark, SF).select("content").collect()]
    check(spark, sources, 10)


def test_a_chunk_gets_the_class_names_it_can_use(spark):
    """Constructors whose name, arguments and body lie in different chunks are found; no chunk holds all names."""
    cut = "class Odd {\n Odd\n/* x */\n(int a)\n{ }\n Odd() { }\n No() { }\n}\n"
    code = "".join(f"class C{i} {{\n  C{i}() {{ }}\n}}\n" for i in range(40)) + cut
    df = spark.createDataFrame([(0, code)], "id int, content string")
    table = line_table(df, ["id"]).select("id", "line_no", "line")
    _, names = bigsources.chunks(table, ["id"], 3)
    assert max(len(r.names) for r in names.collect()) <= 2
    for chunk_lines in (1, 2, 3):
        found, _ = bigsources.spans_of_lines(table, ["id"], chunk_lines)
        got = sorted((r.name, r.start_line) for r in found.filter("is_constructor").collect())
        want = sorted((r.name, r.start_line) for r in methods.method_table(df, ["id"]).filter("is_constructor").collect())
        assert got == want and [n for n, _ in got].count("Odd") == 2


def test_only_what_goes_on_in_a_later_chunk_is_kept_and_nothing_that_grows_is_broadcast(spark, monkeypatch):
    code = "class A {\n" + "  void m() {\n    a();\n  }\n" * 30 + "  A() {\n\n\n\n    b();\n  }\n}\n"
    df = spark.createDataFrame([(0, code), (1, code)], "id int, content string")
    table = line_table(df, ["id"]).select("id", "line_no", "line")
    kept, store = {}, bigsources.stored

    def seen(rows, name):
        kept.setdefault(name, []).append(out := store(rows, name))
        return out

    monkeypatch.setattr(bigsources, "stored", seen)
    found, _ = bigsources.spans_of_lines(table, ["id"], 10)
    assert found.count() == 62
    # all streams are written once, without statements; of those in class A each chunk but the first goes on
    assert len(kept["streams"]) == 1 and "events" not in kept["streams"][0].columns
    later = kept["later_streams"][0].filter("parent is not null")
    assert 0 < later.count() < kept["streams"][0].filter("parent is not null").count() / 2
    assert later.filter("chunk <= parent.chunk").isEmpty()
    _, names = bigsources.chunks(table, ["id"], 10)
    rows = kept["streams"][0].select("id", "parent", "around", "found_methods")
    chosen = bigsources._of_kind(rows, kept["kinds"][0], ["id"])
    for plan in (names, chosen):
        joins = plan._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in joins and "Broadcast" not in joins
