from pyspark.sql import functions as F

from flakelens.functions import javacode
from flakelens.operators import methods

FIRST_LINES = ["package a.b;", ""] + [f"import x.I{i};" for i in range(6)] + ["", "public class GTest extends Base {", ""]
GOLDEN = "\n".join(
    FIRST_LINES
    + ["    public void test_g() throws Exception {"]
    + ['        Class a = load("class A {\\n" + //', '             "  int id\\n" + //', '             "}");']
    + [f"        step({i});" for i in range(31)]
    + ["    }", "}", ""]
)


def spans(one, code):
    return [(m.name, m.start.line, m.end.line) for m in one(javacode.methods, code)]


def test_golden_shape(one):
    """48 lines; the only method covers lines 12-47, columns 12 and 5."""
    (m,) = one(javacode.methods, GOLDEN)
    assert GOLDEN.count("\n") == 48
    assert tuple(m.start) == (12, 12) and tuple(m.end) == (47, 5)
    assert m.name == "test_g" and m.annotations == [] and not m.is_constructor
    code = one(lambda c: javacode.code_of(c, javacode.last_named(javacode.methods(c), F.lit("test_g"))), GOLDEN)
    assert code == "\n".join(GOLDEN.split("\n")[11:47]) + "\n"


def test_braces_in_strings_chars_and_comments(one):
    code = 'class A {\n  void a() {\n    String s = "}\\"{"; char c = \'}\'; // }\n    /* } \n } */\n  }\n  int b() { return 1; }\n}\n'
    assert spans(one, code) == [("a", 2, 6), ("b", 7, 7)]


def test_control_blocks_are_not_methods(one):
    code = (
        "class A {\n void a() {\n  if (x) { y(); } else if (z) { w(); }\n  for (int i = 0; i < f(x); i++) { }\n"
        "  while (g(1)) { }\n  try (R r = open()) { } catch (E e) { } finally { }\n  synchronized (this) { }\n"
        "  switch (k) { case 1: { } }\n  do { } while (h());\n  new Thread(() -> { run(); });\n }\n}\n"
    )
    assert spans(one, code) == [("a", 2, 11)]


def test_header_on_several_lines_and_brace_on_next(one):
    code = "class A {\n  public static\n  Map<String, List<X>> make(int a,\n      int b)\n      throws E1, E2\n  {\n  }\n}\n"
    (m,) = one(javacode.methods, code)
    assert (m.name, m.start.line, m.start.column, m.end.line) == ("make", 3, 3, 7)


def test_constructor_abstract_generic_and_inner(one):
    code = (
        "abstract class A {\n  A(int x) { }\n  abstract <T extends C> T get(T t);\n  static class B {\n"
        "    B() { }\n    void m() { }\n  }\n  interface I { void n(); }\n  enum E { X, Y; int v() { return 1; } }\n}\n"
    )
    assert spans(one, code) == [("A", 2, 2), ("get", 3, 3), ("B", 5, 5), ("m", 6, 6), ("n", 8, 8), ("v", 9, 9)]


def test_anonymous_class_methods(one):
    code = "class A {\n  Runnable f = new Runnable() {\n    public void run() { }\n  };\n  void a() {\n    go(new C<D>(1) {\n      int k() { return 2; }\n    });\n  }\n}\n"
    assert spans(one, code) == [("run", 3, 3), ("a", 5, 9), ("k", 7, 7)]


def test_overloads_last_wins(one):
    code = "class A {\n  void t() { }\n  void t(int a) { }\n}\n"
    m = one(lambda c: javacode.last_named(javacode.methods(c), F.lit("t")), code)
    assert m.start.line == 3
    assert one(lambda c: javacode.last_named(javacode.methods(c), F.lit("zz")), code) is None


def test_annotations(one):
    code = 'class A {\n  @Before\n  @SuppressWarnings({"a",\n  "b"})\n  public void s() { }\n  @Test(expected = E.class) @org.x.Slow("}") void t() { }\n}\n'
    s, t = one(javacode.methods, code)
    assert s.annotations == ["Before", "SuppressWarnings"] and s.start.line == 5
    assert t.annotations == ["Test", "org.x.Slow"] and t.start.column == 46


def test_fields_last_wins_and_first_declarator(one):
    code = "class A {\n  int a = 1, b = 2;\n  static final int[] C = {\n    1,\n    2};\n  List<String> l;\n  void m() { int local = 3; }\n  static class B { int a = 9; }\n}\n"
    got = [(f.name, f.start_line, f.end_line) for f in one(javacode.fields, code)]
    assert got == [("a", 2, 2), ("C", 3, 5), ("l", 6, 6), ("a", 8, 8)]
    s = one(lambda c: methods.source_structure(c), code)
    assert s.global_vars == {"a": "  static class B { int a = 9; }\n", "C": "  static final int[] C = {\n    1,\n    2};\n", "l": "  List<String> l;\n"}


def test_structure_first_wins(one):
    code = "class A {\n  @Before\n  void s() { a(); }\n  @BeforeEach void s(int x) { }\n  @AfterAll\n  static void e() { }\n}\n"
    s = one(lambda c: methods.source_structure(c), code)
    assert s.before == {"s": "  void s() { a(); }\n"}
    assert s.after == {"e": "  static void e() { }\n"}
    assert (s.earliest_line, s.helper_method_names) == (3, ["s", "e"])


def test_odd_sources_do_not_fail(one):
    for code in ("", "}", "{", "}}}{ class", 'class A { String s = "open; }', "/* never closed {", "a\x01{b\x02}c\x03;"):
        assert one(javacode.methods, code) == []
    assert one(javacode.methods, None) is None


def test_header_functions(one):
    code = "// license\npackage a.b ;\nimport x.Y;\n  import static z.W.*;\nclass A { }\n"
    assert one(javacode.package_statement, code) == "package a.b;"
    assert one(javacode.package_statement, "class A { }") is None
    assert one(javacode.import_lines, code) == ["import x.Y;", "  import static z.W.*;"]
    assert one(javacode.without_header, "class A { }") == "class A { }"
    assert one(javacode.clean_code, code) == "package a.b ;\nclass A { }\n"


def test_table_forms_agree_with_row_form(spark):
    from flakelens.queries import derived as d

    sources = d.sources(spark, "/root/testdata/sf0.001").limit(20)
    table = methods.method_table(sources, ["test_id"])
    rows = {r.test_id: r.s for r in sources.select("test_id", methods.source_structure(F.col("content")).alias("s")).collect()}
    helpers = methods.helper_rows(table, ["test_id"]).collect()
    assert len(helpers) == 40
    for h in helpers:
        assert rows[h.test_id][h.phase][h.name] == h.code
    for r in methods.earliest_lines(table, ["test_id"]).collect():
        assert rows[r.test_id].earliest_line == r.earliest_line


def test_unclosed_flag(one):
    assert one(lambda c: javacode.scan(c)["unclosed"], "class A { void a() { }") is True
    assert one(lambda c: javacode.scan(c)["unclosed"], "class A { void a() { } }") is False


def test_long_texts_take_linear_time(one):
    import time

    prose = "words without any delimiter (and more) " * 20_000
    comment = "class A {\n/*" + " x {\n" * 100_000 + "*/\n void a() { }\n}\n"
    literal = 'class A { String s = "' + "\\n{" * 100_000 + '"; void a() { } }'
    one(javacode.methods, "class A { void a() { } }")
    for text, names in ((prose, []), (comment, ["a"]), (literal, ["a"])):
        start = time.time()
        assert [m.name for m in one(javacode.methods, text)] == names
        assert time.time() - start < 20


TEXT_BLOCK = (
    'class A {\n  String q = """\n    { not a \\""" brace { "x" \n    """;\n  void a() {\n    b();\n  }\n}\n'
)
RECORDS = (
    "package p;\npublic record Pair(int a, String b) implements Q {\n  static int n = 0;\n  Pair {\n    n++;\n  }\n"
    "  public int sum(int c) {\n    return a + c;\n  }\n}\n"
)


def scanned(one, code):
    from flakelens.functions import javacode

    found = one(javacode.scan, code)
    return [(m.name, m.start.line, m.end.line) for m in found.methods], [f.name for f in found.fields], found.unclosed


def test_text_blocks_do_not_open_blocks(one):
    assert scanned(one, TEXT_BLOCK) == ([("a", 5, 7)], ["q"], False)


def test_records_are_classes(one):
    methods, fields, unclosed = scanned(one, RECORDS)
    assert ("sum", 7, 9) in methods and fields == ["n"] and not unclosed


def test_sources_with_unmatched_braces_are_marked_and_not_patched(spark):
    from flakelens.operators import methods, patches

    rows = [("good", "class A {\n  void a() {\n  }\n}\n"), ("bad", "class A {\n  void a() {\n    {\n  }\n}\n")]
    df = spark.createDataFrame(rows, "k string, content string").withColumn("method_name", F.lit("a"))
    flags = {r.k: r.is_unclosed for r in methods.method_table(df, ["k"]).select("k", "is_unclosed").distinct().collect()}
    assert flags.get("good") is False and flags.get("bad", True) is True
    code = {r.k: r.method_code for r in patches.prepare_tests(df).collect()}
    assert code["good"] is not None and code["bad"] is None
