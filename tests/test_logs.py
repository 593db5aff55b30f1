from pyspark.sql import functions as F

from flakelens import rules
from flakelens.functions import logs
from flakelens.operators import lines


def test_verdict_precedence(one):
    cases = {
        "x There are test failures.\nBUILD SUCCESS\nNo Test Failed with this configuration": rules.FAILURE,
        "BUILD SUCCESS\nNo Test Failed with this configuration": rules.PASS,
        "BUILD SUCCESS": rules.UNRECOGNIZED,
        "BUILD FAILURE ... COMPILATION ERROR": rules.COMPILATION_ERROR,
        "COMPILATION ERROR": rules.UNRECOGNIZED,
        "": rules.UNRECOGNIZED,
    }
    for log, want in cases.items():
        assert one(logs.verdict, log) == want, log


def test_verdict_of_lines_may_spread_markers(spark):
    df = spark.createDataFrame(
        [(1, "BUILD SUCCESS\nx\nNo Test Failed with this configuration"), (2, "BUILD SUCCESS"), (3, "")],
        "run_id int, content string",
    )
    table = lines.line_table(df, ["run_id"])
    got = {r.run_id: r.verdict for r in lines.verdict_by_lines(table, ["run_id"]).collect()}
    assert got == {1: rules.PASS, 2: rules.UNRECOGNIZED, 3: rules.UNRECOGNIZED}


def test_error_lines(one):
    log = "\n".join([
        "[ERROR] first", "[INFO] no", "[ERROR] Time elapsed: 1", "[ERROR] There are test failures",
        "[ERROR] Skipped: 0", "[ERROR] Failed to execute goal x", "[ERROR] first", " [ERROR] indented",
        "[ERROR] again [ERROR] twice ",
    ])
    assert one(logs.error_lines, log) == ["first", "again  twice"]


def test_line_number_forms(one):
    f = logs.line_number
    assert one(f, "\tat a.B.c(B.java:12)", "B.java") == 12
    assert one(f, "[ERROR] /x/B.java:[7,3] bad", "B.java") == 7
    assert one(f, "[ERROR] [x] at a.B.c(B.java:12)", "B.java") == 12
    assert one(f, "at a.B.c(B.java:x)", "B.java") is None
    assert one(f, "at a.C.c(C.java:12)", "B.java") is None
    assert one(f, "(B.java:1) and (B.java:2)", "B.java") == 2


def test_line_numbers_are_ordered_distinct(one):
    log = "at (B.java:9)\nat (B.java:3)\nat (B.java:9)\nat (B.java:)\n"
    assert one(logs.line_numbers, log, "B.java") == [9, 3]


def test_frames(one):
    log = "\n".join([
        "\tat a.B.run(B.java:4)", "  at a.B.not(B.java:5)", "\tat a.B.check (B.java:6)",
        "\tat a.B$1.inner(B.java:7)", "\tat a.BC.other(BC.java:8)", "\tat a.B.run(B.java:4)", "\tat a.B.x",
    ])
    assert one(logs.frame_methods, log, "a.B") == ["run", "check"]
    assert one(logs.frame_lines, log, "a.B") == [4, 6, 7, 8]


def test_compile_messages(one):
    log = "\n".join([
        "[INFO] Finished at: early", "[ERROR] dropped", "[INFO] Finished at: 12:00",
        "[ERROR] Failed to execute goal -> [Help 1]", "[ERROR] /x/B.java:[3,1] cannot find -> [Help 1]",
        "[ERROR]   symbol: x", "[ERROR] /x/B.java:[9,1] cannot find -> [Help 1]", "no",
        "[INFO] To see the full stack trace of the errors", "[ERROR] after",
    ])
    assert one(logs.compile_messages, log, "B.java") == [" cannot find", "symbol: x"]


def test_compile_region_without_markers_is_whole_text(one):
    assert one(logs.compile_region, "[ERROR] a -> [Help 1]") == "[ERROR] a "


def test_report_dir(one):
    line = "Please refer to /w/target/surefire-reports for the individual test results."
    assert one(logs.report_dir, line) == "/w/target/surefire-reports"
    assert one(logs.report_dir, "Please refer to the manual") is None


def test_log_evidence_routes(spark):
    df = spark.createDataFrame(
        [("COMPILATION ERROR\n[ERROR] B.java:[2,1] x\nPlease refer to d for the individual test results",),
         ("There are test failures\nat a.B.t(B.java:3)\nPlease refer to d for the individual test results",)],
        "content string",
    )
    e = logs.log_evidence(F.col("content"), F.lit("a.B.t"))
    compile_run, failed_run = [r.e for r in df.select(e.alias("e")).collect()]
    assert compile_run.compile_messages == [" x"] and compile_run.report_dirs == []
    assert failed_run.compile_messages == [] and failed_run.report_dirs == ["d"]
    assert compile_run.line_numbers == [2] and failed_run.line_numbers == [3]


def test_build_results(spark):
    df = spark.createDataFrame([("p", "s", "m", "x\n[INFO] BUILD   SUCCESS\n[INFO] BUILD FAILURE")], "project string, sha string, module string, content string")
    row = lines.build_results(df, ["project", "sha", "module"]).first()
    assert row.build_result == "build-result: p s m [INFO] BUILD SUCCESS [INFO] BUILD FAILURE"
