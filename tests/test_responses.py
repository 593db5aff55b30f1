import random

from pyspark.sql import functions as F

from flakelens.functions import builds, patches, responses


def test_regions_keep_headers_and_single_lines(one):
    text = "words (here)\n\n@Test\npublic void a()\n{\n  b();\n}\nmore words;\nint c() { return 1; }\n@Before\nvoid s() {\n}\n"
    r = one(lambda c: responses.regions(responses.plain_lines(c)), text)
    assert [tuple(x) for x in r.regions] == [(3, 7), (9, 9), (10, 12)]
    assert r.negative is False


def test_region_headers(one):
    text = (
        "call foo(bar)\n@Slow\n// why\n@Test\npublic void a(int x,\n    int y)\n    throws E\n{\n}\n"
        "see above (or below)\nList<String> b()\n{\n  c();\n}\nint f();\nvoid d() {\n}\nclass X\n{\n}\n"
    )
    r = one(lambda c: responses.regions(responses.plain_lines(c)), text)
    assert [tuple(x) for x in r.regions] == [(2, 9), (11, 14), (16, 17), (19, 20)]


def brute_regions(lines):
    """Depth rule only: where regions close and whether depth went negative."""
    depth, inside, ends, negative = 0, False, [], False
    for i, line in enumerate(lines, 1):
        if "public class " in line:
            continue
        o, c = line.count("{"), line.count("}")
        depth += o - c
        negative |= depth < 0
        if depth == 0 and c > 0 and (inside or o > 0):
            ends.append(i)
            inside = False
        elif depth > 0:
            inside = True
    return ends, negative


def test_region_ends_equal_brute_force(spark):
    rng = random.Random(7)
    parts = ["{", "}", "{}", "}{", "x;", "", "public class A {", "a() {", "} else {"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    r = responses.regions(F.split("t", "\n", -1))
    got = {x.i: ([y.end_line for y in x.r.regions], x.r.negative) for x in df.select("i", r.alias("r")).collect()}
    bad = 0
    for i, t in enumerate(texts):
        ends, negative = brute_regions(t.split("\n"))
        # counters are reset only at a close, so totals, not depth, decide when
        # a surplus brace came before; compare where depth stays non-negative
        if not negative:
            assert got[i][0] == ends, t
        else:
            bad += 1
            assert got[i][1]
    assert 0 < bad < 400


def test_regions_are_balanced(spark):
    rng = random.Random(3)
    parts = ["{", "}", "a() {", "}", "x;", "@Before", "f()"]
    texts = ["\n".join(rng.choice(parts) for _ in range(12)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    lines = F.split("t", "\n", -1)
    rows = df.select(responses.regions(lines)["negative"].alias("n"), F.transform(responses.regions(lines)["regions"], lambda r: responses.region_text(lines, r)).alias("r")).collect()
    for row in rows:
        for region in row.r:
            assert row.n or region.count("{") == region.count("}")


def test_imports(one):
    got = one(responses.import_statements, "import a.B;\nimport static  c.D.*;\nimport\ta.E ;x import f.G; importx.Y;")
    assert got == ["import a.B;", "import static c.D.*;", "import f.G;"]


def test_import_conflicts(spark):
    df = spark.createDataFrame(
        [(["import a.X;", "import b.L;", "import c.*;", "import a.X;", "import o.L;"],
          ["import o.L;", "import p.*;"])], "w array<string>, o array<string>",
    )
    w, o = F.col("w"), F.col("o")
    row = df.select(
        responses.new_imports(w, o).alias("n"), responses.conflicting_imports(w, o).alias("c"),
        responses.new_imports(w, o, True).alias("ns"), responses.conflicting_imports(w, o, True).alias("cs"),
    ).first()
    assert row.n == ["import a.X;", "import c.*;"] and row.c == ["import b.L;"]
    assert row.ns == ["import a.X;"] and row.cs == ["import b.L;", "import c.*;"]


def test_patch_of_fenced_class(one):
    source = "package p;\nimport java.util.List;\npublic class T {\n  void t() {\n  }\n}\n"
    answer = (
        "```java\nimport java.util.Map;\npublic class T {\n  @Test\n  public void t() {\n    a(\"}\".length());\n  }\n"
        "  void t2() { }\n}\n```\n"
    )
    p = one(lambda r, s: responses.patch(r, F.lit("t"), s), answer, source)
    assert p.imports == ["import java.util.Map;"] and p.pom is None
    assert p.test_code.startswith("  public void t() {\n")


def test_patch_without_code(one):
    p = one(lambda r, s: responses.patch(r, F.lit("t"), s), "no idea", "class T { }")
    assert p.test_code is None and p.imports == [] and p.pom is None


POM = "<project>\n <dependencies>\n  <dependency><artifactId>old</artifactId></dependency>\n </dependencies>\n</project>\n"
ASK = (
    "<dependencies><dependency>\n<artifactId>old</artifactId></dependency><dependency><artifactId>new</artifactId></dependency>"
    "<dependency><artifactId>my-artifact</artifactId></dependency><dependency><groupId>g</groupId></dependency>"
    "<dependency><artifactId>second</artifactId></dependency><artifactId>loose</artifactId></dependencies>"
)


def test_dependency_list(one):
    got = one(lambda p: builds.dependencies(builds.unwrap(p)), ASK)
    assert [(d.artifact_id, d.is_placeholder) for d in got] == [
        ("old", False), ("new", False), ("my-artifact", True), ("second", False)]
    assert got[1].xml == "<dependency>\n<artifactId>new</artifactId></dependency>\n"


def test_missing_dependencies_are_added_once(one):
    out = one(builds.add_dependencies, ASK, POM)
    lines = out.split("\n")
    assert lines[1] == " <dependencies>"
    assert lines[2:4] == ["<dependency>", "<artifactId>new</artifactId></dependency>"]
    assert out.count("second") == 1 and out.count("old") == 1 and "my-artifact" not in out
    assert one(builds.add_dependencies, None, POM) == POM
    assert one(builds.add_dependencies, "<dependency><artifactId>old</artifactId></dependency>", POM) == POM


def test_every_dependencies_anchor_gets_the_fragment(one):
    out = one(builds.add_dependencies, "<dependency><artifactId>n</artifactId></dependency>", "<dependencies>\n</dependencies>\n<dependencies>\n</dependencies>")
    assert out.count("<artifactId>n</artifactId>") == 2


def test_insert_imports(spark):
    df = spark.createDataFrame(
        [("// c\npackage a;\nclass A { String s = \"package a;\"; }", ["import x;"]),
         ("public class A { }\npublic class B { }", ["import x;", "import y;"]),
         ("class A { }", ["import x;"]), ("package a;\nclass A { }", [])],
        "c string, i array<string>",
    )
    got = [r.r for r in df.select(patches.insert_imports(F.col("c"), F.col("i")).alias("r")).collect()]
    assert got == [
        "// c\n\npackage a;\nimport x;\n\nclass A { String s = \"package a;\"; }",
        "import x;\nimport y;\npublic class A { }\npublic class B { }",
        "class A { }", "package a;\nclass A { }",
    ]


def test_replace_method_and_back(one):
    source = "class A {\n  void t() { }\n}\n"
    done = one(patches.replace_method, source, "  void t() { }\n", "NEW")
    assert done == "class A {\n\nNEW\n}\n"
    assert done.replace("\nNEW\n", "  void t() { }\n") == source
    assert one(patches.replace_method, source, "  void t() { }\n", None) == source
    assert one(patches.replace_method, source, None, "NEW") == source


def test_jdk(one):
    f = lambda c, u, p: builds.jdk_of_file(c, u, p)
    assert one(f, "<jdk.version>11</jdk.version>", "u", "p") == "11"
    assert one(f, "<jdk.version>1.8</jdk.version>", "u", "cloudstack") == "8"
    assert one(f, "<version>11</version>", "u", "cloudstack") == "11"
    assert one(f, "", "https://github.com/INRIA/spoon", "spoon") == "11"
    assert one(f, "<jdk>17</jdk>\n<jdk>8</jdk>", "u", "p") == "8"
