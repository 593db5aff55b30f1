from pyspark.sql import functions as F

from flakelens.functions import fqn, prompts, text


def test_replace_last(one):
    f = lambda c: text.replace_last(c, ".", "#")
    assert one(f, "a.b.C.test") == "a.b.C#test"
    assert one(f, "plain") == "#plain"
    assert one(f, "ends.") == "ends#"


def test_fqn_parts(one):
    assert one(fqn.method_name, "a.b.CTest.run") == "run"
    assert one(fqn.short_class, "a.b.CTest.run") == "CTest"
    assert one(fqn.class_path, "a.b.CTest.run") == "a/b/CTest"
    assert one(fqn.class_fqn, "run.b.run.run") == "run.b.run"
    assert one(fqn.short_class, "run") is None
    assert one(fqn.class_fqn, "run") == ""


def test_paths(one):
    assert one(fqn.build_path, "m/src/test/src/A.java") == "m/pom.xml"
    assert one(fqn.build_path, "m/test/A.java") is None
    assert one(fqn.repo_name, "https://host/x/repo") == "repo"


def test_elapsed(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:00' a, timestamp'2024-01-01 00:00:07.012' b")
    row = df.select(
        fqn.elapsed_seconds(F.col("a"), F.col("b")).alias("s"),
        fqn.elapsed_text(fqn.elapsed_seconds(F.col("a"), F.col("b"))).alias("t"),
    ).first()
    assert (row.s, row.t) == (7.01, "7.01s")


def test_run_id_is_sha1_of_seconds(spark):
    import hashlib

    df = spark.sql("select timestamp'2024-01-01 10:20:30.9' a")
    want = hashlib.sha1(b"2024-01-01 10:20:30").hexdigest()
    assert df.select(fqn.run_id(F.col("a")).alias("r")).first().r == want


def test_message_normalization(one):
    assert one(text.normalize_message, " a \n\t b ", "T") == "a b"
    assert one(text.normalize_message, None, "java.lang.E") == "java.lang.E"
    assert one(text.normalize_message, None, None) is None


def test_delimited_block_precedence(one):
    from flakelens.functions.responses import build_block

    full = "x<!-- <pom.xml start> -->A<!-- <pom.xml end> -->```xml\nB```"
    assert one(build_block, full) == "A"
    assert one(build_block, "<pom.xml start>C<!-- <pom.xml end> -->") == "C"
    assert one(build_block, "a```xml\nB\n```c") == "\nB\n"
    assert one(build_block, "nothing") is None


def test_span_slice(spark):
    content = "a\nb {\nc\n}\n}\n"
    rows = [(1, 2), (2, 99), (3, None), (None, 2), (99, 100), (5, 5)]
    df = spark.createDataFrame([(content, s, e) for s, e in rows], "c string, s int, e int")
    got = [r.r for r in df.select(text.span_slice(F.col("c"), F.col("s"), F.col("e")).alias("r")).collect()]
    assert got == ["a\nb {\n", "b {\nc\n}\n}\n", "c\n}\n}\n", "", "", "}\n"]


def test_span_slice_open_end_drops_last_brace(spark):
    df = spark.createDataFrame([("class {\nint f();\n}\n",)], "c string")
    cut = text.span_slice(F.col("c"), F.lit(2), F.lit(None).cast("int"))
    assert df.select(cut.alias("r")).first().r == "int f();\n"


def test_line_at_outside_is_null(spark):
    df = spark.createDataFrame([("a\n b \nc", n) for n in (-1, 0, 1, 2, 4)], "c string, n int")
    got = [r.r for r in df.select(text.line_at(text.lines(F.col("c")), F.col("n")).alias("r")).collect()]
    assert got == [None, None, "a", "b", None]


def test_ordered_distinct_is_idempotent(spark):
    df = spark.createDataFrame([(["b", "a", None, "b", "c", "a"],)], "v array<string>")
    once = text.ordered_distinct(F.col("v"))
    row = df.select(once.alias("x"), text.ordered_distinct(once).alias("y")).first()
    assert row.x == ["b", "a", "c"] == row.y


def test_prompt_skips_empty_parts(spark):
    df = spark.sql("select map() b, map('tear', 'T') a, map('f', 'int f;', 'g', 'int g;') v, 'M' m")
    code = prompts.context_code(F.col("b").cast("map<string,string>"), F.col("a"), F.col("v"), F.col("m"))
    assert df.select(code.alias("r")).first().r == "T\nint f;\nint g;\nM"
    full = prompts.prompt(F.lit("check"), F.col("m"), F.lit("msg %s"), F.lit(None).cast("string"),
                          F.array(F.lit("a"), F.lit("b")))
    out = df.select(full.alias("r")).first().r
    assert "check" in out and "msg %s" in out and "a, b" in out and "//<fix start>" in out
