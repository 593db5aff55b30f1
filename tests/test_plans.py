"""Manifest to result documents on one small project."""

import datetime as dt

from flakelens import rules, schemas
from flakelens.plans import repair, triage
from flakelens.sources import sinks

CODE = (
    "package a.b;\n\npublic class CTest {\n    int n = 1;\n    @Before\n    public void setUp() { n = 2; }\n"
    "    @Test\n    public void flaky() {\n        check(n);\n    }\n}\n"
)
PATH = "clone/s/r/src/test/java/a/b/CTest.java"
FAIL_LOG = (
    "There are test failures\n\tat a.b.CTest.flaky(CTest.java:9)\n"
    "Please refer to /w/reports for the individual test results\n"
)
XML = '<testsuite><testcase classname="a.b.CTest" name="flaky"><failure message="no  luck"/></testcase></testsuite>'
T0 = dt.datetime(2024, 1, 1)


def inputs(spark):
    manifest = spark.createDataFrame(
        [("1", "r", "s", ".", "a.b.CTest.flaky"), ("2", "r", "s", ".", "a.b.CTest.gone"), ("3", "r", "s", ".", "a.b.D.x")],
        "test_id string, repo string, sha string, module string, test_fqn string")
    sources = spark.createDataFrame([("r", "s", PATH, CODE)], "repo string, sha string, path string, content string")
    return manifest, sources


def test_triage(spark):
    manifest, sources = inputs(spark)
    tests = triage.cut_tests(manifest, sources)
    got = {r.test_id: r for r in tests.collect()}
    one = got["1"]
    assert one.method_code == "    public void flaky() {\n        check(n);\n    }\n"
    assert (one.start.line, one.start.column, one.end.line) == (8, 12, 10)
    assert one.before == {"setUp": "    public void setUp() { n = 2; }\n"} and one.after == {}
    assert one.global_vars == {"n": "    int n = 1;\n"} and one.earliest_line == 6
    assert got["2"].method_code is None and got["2"].localization_status == rules.LOCALIZED
    assert got["3"].content is None and got["3"].localization_status == rules.NOT_LOCALIZED

    logs = spark.createDataFrame(
        [("x", "1", T0, "a.b.CTest.flaky", PATH, FAIL_LOG), ("y", "1", T0 + dt.timedelta(1), "a.b.CTest.flaky", PATH, "BUILD SUCCESS")],
        "run_id string, test_id string, ts timestamp, test_fqn string, path string, content string")
    reports = spark.createDataFrame([("/w/reports/TEST-a.b.CTest.xml", XML)], "path string, xml string")
    found = triage.first_run_evidence(logs, sources.select("path", "content"), reports)
    (row,) = found.drop("test_id", "ts").collect()
    assert tuple(row) == ("x", rules.FAILURE, "no luck", "check(n);", ["flaky"])
    initial = found.drop("run_id", "ts")
    asked = {r.test_id: r.prompt for r in triage.initial_prompts(tests, initial).collect()}
    assert "no luck" in asked["1"] and "setUp" in asked["1"] and asked["2"] is None and asked["3"] is None


def test_result_documents(spark, tmp_path):
    manifest, sources = inputs(spark)
    tests = triage.cut_tests(manifest, sources)
    initial = spark.createDataFrame(
        [("1", T0, T0 + dt.timedelta(seconds=3), rules.FAILURE, "m0", "c0", ["flaky"]),
         ("2", T0, T0 + dt.timedelta(seconds=7.012), rules.PASS, "", "", [])],
        "test_id string, started timestamp, ended timestamp, summary string, err_msg string, err_code string, err_methods array<string>")
    rows = [
        ("1", None, T0 + dt.timedelta(seconds=10 * i), applied, f"p{i}", f"r{i}", {"test_code": f"t{i}", "imports": [], "pom": None}, s, f"m{i}", "c", ["flaky"])
        for i, (applied, s) in enumerate([(True, rules.FAILURE), (False, rules.PASS), (True, rules.PASS), (True, rules.FAILURE)], 1)
    ]
    tries = spark.createDataFrame(rows, schemas.ATTEMPTS).drop("iter")
    docs = repair.result_documents(tests, initial, tries, "clone", "out")
    got = {r.test_id: r for r in docs.collect()}
    assert got["1"].status == rules.FIXED and got["1"].fixed_at == 2 and got["1"].attempts_used == 3
    assert got["1"].final_patch.test_code == "t3" and got["1"].prev_summary == rules.PASS
    assert list(got["1"].intermediate_log) == ["0", "2"] and got["1"].intermediate_log["0"].result.err_msg == "m1"
    assert got["1"].start == [8, 12] and got["1"].end == [10, 5] and got["1"].time == "30.00s"
    assert got["1"].repo_path == "clone/s/r" and got["1"].result_json == "out/r/s/a.b.CTest.flaky.json"
    assert got["2"].status == rules.SKIPPED and got["2"].time == "7.01s" and got["2"].final_patch is None
    assert got["3"].status == rules.NOT_LOCALIZED and got["3"].time is None
    sinks.write_results(docs, str(tmp_path), "run")
    back = sinks.read_results(spark, str(tmp_path), sinks.serializable(docs).schema)
    assert {r.test_id: r.status for r in back.collect()} == {k: v.status for k, v in got.items()}


def test_prompts_of_later_attempts_show_the_last_applied_one(spark):
    manifest, sources = inputs(spark)
    tests = triage.cut_tests(manifest, sources)
    initial = spark.createDataFrame(
        [("1", rules.FAILURE, "m-first", "c-first", ["flaky"]), ("2", rules.PASS, "", "", [])],
        "test_id string, summary string, err_msg string, err_code string, err_methods array<string>")

    def patched(word):
        return CODE.replace("check(n);", f"check({word});")

    rows = [
        ("1", T0 + dt.timedelta(seconds=i), applied, text, rules.FAILURE, f"m{i}", f"c{i}", ["flaky"])
        for i, (applied, text) in enumerate(
            [(True, patched("one")), (False, patched("two")), (True, patched("three") + "{"), (True, patched("four")),
             (True, patched("five")), (True, patched("six"))])
    ] + [("2", T0, True, patched("other"), rules.PASS, "m", "c", [])]
    tries = spark.createDataFrame(
        rows, "test_id string, ts timestamp, applied boolean, patched_content string, summary string, err_msg string, "
              "err_code string, err_methods array<string>")
    got = {r.iter: r for r in repair.attempt_prompts(tests, initial, tries, template="%1$s|%2$s|%3$s|%4$s|%5$s").collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and {r.test_id for r in got.values()} == {"1"}
    shown = [r.prompt.split("|") for _, r in sorted(got.items())]
    assert [s[2] for s in shown] == ["m-first", "m0", "m0", "m2", "m3"]
    assert ["check(n)" in shown[0][1]] + [f"check({w})" in s[1] for w, s in zip(("one", "one", "one", "four"), shown[1:], strict=True)] == [True] * 5
    related = {i: r.related_code for i, r in got.items()}
    assert related[1] is None and [f"check({w})" in related[i].method_code for i, w in ((0, "one"), (2, "one"), (4, "five"))] == [True] * 3
    assert all("setUp" in c.before and set(c.global_vars) == {"n"} and c.after == {} for i, c in related.items() if i != 1)
    # a patch that changes nothing shows the test's own code
    same = spark.createDataFrame([("1", T0, True, CODE, rules.FAILURE, "m", "c", ["flaky"])], tries.schema)
    (row,) = repair.attempt_prompts(tests, initial, same).collect()
    own = tests.filter("test_id = '1'").first()
    assert (row.related_code.method_code, row.related_code.global_vars) == (own.method_code, own.global_vars)


def test_only_first_runs_are_mined(spark, monkeypatch):
    """Of 50 runs of a test one log is mined; rows without a test or a time are a test's too."""
    from flakelens.operators import evidence
    from flakelens.plans import triage

    rows = [(r, t, "o.A.t", "p", ts, f"Killed {r}") for t in (1, 2, None) for r, ts in
            [(100 * (t or 0) + i, None if (t, i) == (2, 7) else 50 - i) for i in range(50)]]
    logs = spark.createDataFrame(rows, "run_id int, test_id int, test_fqn string, path string, ts int, content string")
    sources = spark.createDataFrame([], "path string, content string")
    mine, seen = evidence.mined_logs, []

    def counted(table, *keep):
        seen.append(table.count())
        return mine(table, *keep)

    monkeypatch.setattr(evidence, "mined_logs", counted)
    found = triage.first_run_evidence(logs, sources).collect()
    assert sorted(((r.test_id, r.run_id, r.ts) for r in found), key=lambda r: r[1]) == [(None, 49, 1), (1, 149, 1), (2, 207, None)]
    assert seen == [3]


def test_names_are_cut_only_of_reports_in_named_folders(spark):
    from flakelens.operators import evidence

    reports = spark.createDataFrame([(f"/w/r{i}/TEST-o.CTest.xml",) for i in range(3)], "path string")
    folders = spark.createDataFrame([("/w/r1",), ("/w/r9",)], "report_dir string")
    rows = evidence.listed_reports(reports, depths=[3], folders=folders).collect()
    assert {(r.path, r.report_dir) for r in rows} == {("/w/r1/TEST-o.CTest.xml", "/w/r1")}
    assert "o.CTest" in {r.class_fqn for r in rows}
