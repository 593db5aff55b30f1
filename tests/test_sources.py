import os

from pyspark.sql import functions as F

from flakelens.queries import storage
from flakelens.sources import readers, sinks

HEADER = "Project URL,SHA Detected,Module Path,Fully-Qualified Test Name(x),Category,Status,PR Link,Notes\n"


def test_manifest_surplus_short_and_quoted(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        HEADER
        + "https://h/o/nine,s1,m,a.B.t,ID,,,,\n"
        + "https://h/o/eight,s2,.,a.B.u,NOD,RepoArchived,,\n"
        + "https://h/o/short,s3,m\n"
        + 'https://h/o/quoted,s4,m,a.B.v,NOD,"a, ""b""",,x,extra,"y,z"\n'
    )
    got = {r.repo: r for r in readers.read_test_manifest(spark, str(tmp_path / "m.csv")).collect()}
    assert got["nine"].status == "" and got["nine"].notes == "" and got["nine"].surplus == [""]
    assert got["eight"].status == "RepoArchived" and got["eight"].notes == "" and got["eight"].surplus is None
    assert got["short"].module == "m" and got["short"].test_fqn is None and got["short"].notes is None
    assert got["quoted"].status == 'a, "b"' and got["quoted"].surplus == ["extra", "y,z"]
    assert len({r.test_id for r in got.values()}) == 4


def test_module_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text("https://h/a,s1,m/n\nhttps://h/b,s2,.,\n  https://h/c,s3 plain\n")
    got = [tuple(r) for r in readers.read_module_manifest(spark, str(tmp_path)).collect()]
    assert got == [
        ("https://h/a", "s1", "m/n", "a"), ("https://h/b", "s2", ".", "b"), ("https://h/c", "s3", "", "c"),
        ("plain", "plain", "plain", "plain"),
    ]


def test_tree_scan_reads_whole_files(spark, tmp_path):
    deep = tmp_path / "sha1" / "repo" / "src" / "test"
    deep.mkdir(parents=True)
    (deep / "A.java").write_text("class A {\n}\n")
    (deep / "B.txt").write_text("no")
    (tmp_path / "sha1" / "repo" / "pom.xml").write_text("<project>\n</project>")
    (deep / "Bad.java").write_bytes(b"x \xff y\r\n\xc3\xa9\rz\n")
    files = readers.split_clone_path(readers.read_tree(spark, str(tmp_path)), str(tmp_path))
    got = {os.path.basename(r.path): r for r in files.collect()}
    assert set(got) == {"A.java", "Bad.java"}
    assert got["A.java"].content == "class A {\n}\n"
    assert got["Bad.java"].content == "x  y\n\u00e9\nz\n"
    assert (got["A.java"].sha, got["A.java"].repo) == ("sha1", "repo")
    (pom,) = readers.read_build_files(spark, str(tmp_path)).collect()
    assert pom.content == "<project>\n</project>"


def test_results_roundtrip_keeps_types(spark, tmp_path):
    df = spark.sql(
        "select 'r' repo, 's' sha, 'a.B.t' test_fqn, map('0', named_struct('summary', 'PASS')) intermediate_log, "
        "array(named_struct('line', 1, 'column', 2)) spans, date'2024-01-02' day, cast(null as string) time"
    )
    target = sinks.write_results(df, str(tmp_path), "run1")
    assert os.path.isdir(f"{target}/repo=r/sha=s")
    schema = sinks.serializable(df).schema
    row = sinks.read_results(spark, str(tmp_path), schema).first()
    assert row.run_id == "run1" and row.intermediate_log["0"].summary == "PASS"
    assert row.spans[0].column == 2 and row.day == "2024-01-02" and row.time is None


def test_overwrite_replaces_a_run_only(spark, tmp_path):
    df = spark.sql("select 'r' repo, 's' sha, 1 v")
    sinks.write_results(df, str(tmp_path), "a")
    sinks.write_results(df, str(tmp_path), "b")
    sinks.write_results(df.withColumn("v", F.lit(2)), str(tmp_path), "a")
    got = {(r.run_id, r.v) for r in sinks.read_results(spark, str(tmp_path), df.schema).collect()}
    assert got == {("a", 2), ("b", 1)}


def test_document_text(spark):
    df = spark.sql("select 1 a, cast(null as string) b, array(1, 2) c")
    assert df.select(sinks.document(df).alias("d")).first().d == '{"a":1,"c":[1,2]}'
    assert df.select(sinks.document(df, False).alias("d")).first().d == '{"a":1,"b":null,"c":[1,2]}'


def test_log_lines_of_split_files(spark, tmp_path):
    for name, n in (("a.log", 3000), ("b.log", 10), ("c.txt", 5)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(1, n + 1)))
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        raw = spark.read.text(str(tmp_path / "a.log"))
        assert raw.select("_metadata.file_block_start").distinct().count() > 3
        got = readers.read_log_lines(spark, str(tmp_path))
        assert got.count() == 3010
        want = F.concat_ws(" ", F.substring_index("path", "/", -1), "line_no")
        assert got.filter(F.col("line") != want).isEmpty()
    finally:
        spark.conf.set(key, old)


def test_log_lines_are_neither_sorted_nor_shuffled(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\ny\n")
    plan = readers.read_log_lines(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    # only the counts of the splits are
    lines_side = plan.split("Aggregate")[0]
    assert "broadcast" in plan and plan.count("Window") == 1 and "Window" in plan.split("Aggregate")[0]
    assert "value#" in lines_side and "Sort" not in lines_side


def test_every_folder_is_written_by_a_task_of_its_own(spark, tmp_path):
    folders = storage.FOLDERS
    rows = spark.range(folders * 3).select((F.col("id") % folders).cast("int").alias("folder"), "id", F.col("id").cast("string").alias("value"))
    storage._written_in_order(rows, ["id"], str(tmp_path / "out"))
    read = spark.read.text(str(tmp_path / "out")).select(F.col("_metadata.file_name").alias("name"), "value")
    tasks = read.select(F.substring("name", 1, 10).alias("task")).distinct().count()
    assert tasks == folders
    for r in read.groupBy("name").agg(F.collect_list(F.col("value").cast("int")).alias("v")).collect():
        assert r.v == sorted(r.v) and len(r.v) == 3


def test_manifest_rows_do_not_depend_on_the_selection(spark, tmp_path):
    long = "x" * 100_000
    (tmp_path / "m.csv").write_text(
        HEADER
        + "https://h/o/nine,s1,m,a.B.t,ID,,,,extra\n"
        + f'https://h/o/long,s2,m,a.B.u,ID,,,"{long}","{"a" * 50_000}""{"b" * 50_000}"\n'
        + f'https://h/o/pairs,s2,m,a.B.u,ID,,,,"{chr(34) * 40_000}"\n'
        + ",s3,m,a.B.w,ID,,,,more\n"
        + "https://h/o/short,s4\n"
    )
    full = readers.read_test_manifest(spark, str(tmp_path / "m.csv"))
    rows = full.collect()
    assert len(rows) == 5
    by_sha = {(r.sha, r.repo): r for r in rows}
    assert by_sha["s1", "nine"].surplus == ["extra"]
    assert by_sha["s2", "long"].notes == long and len(by_sha["s2", "long"].surplus[0]) == 100_001
    assert len(by_sha["s2", "pairs"].surplus[0]) == 20_000
    empty = next(r for r in rows if r.sha == "s3")
    assert empty.project_url == "" and empty.surplus == ["more"]
    assert by_sha["s4", "short"].module is None and by_sha["s4", "short"].notes is None
    for name in full.columns:
        assert sorted(map(repr, (r[name] for r in rows))) == sorted(map(repr, (r[0] for r in full.select(name).collect())))
    assert full.count() == 5


def test_manifest_with_line_breaks_in_fields(spark, tmp_path):
    (tmp_path / "m.csv").write_text(HEADER + 'https://h/o/a,s1,m,a.B.t,ID,"two\nlines",,\n\n' + "https://h/o/b,s2,m,a.B.u,ID,,,z\n")
    got = {r.repo: r for r in readers.read_test_manifest(spark, str(tmp_path), multi_line=True).collect()}
    assert got["a"].status == "two\nlines" and got["b"].notes == "z" and len(got) == 2


SUITE = (
    '<testsuite name="s"><testcase classname="{c}" name="check"><failure message="{m}" type="T"/></testcase>'
    '<testcase classname="{c}" name="fine"/></testsuite>'
)


def test_reports_reach_the_runs_whose_logs_name_their_folder(spark, tmp_path):
    """One shared folder for the tests of a module, in a path with spaces and the word 'platform'."""
    from flakelens.plans import triage

    logs, tests = [], {}
    for project in ("one", "two"):
        folder = tmp_path / "my platform" / project / "target" / "surefire-reports"
        folder.mkdir(parents=True)
        for i in range(4):
            name = f"a.b.C{i}Test"
            suite = SUITE.format(c=name, m=f"{project} {i}")
            xml = suite if i % 2 else f"<testsuites>{suite}<testsuite><testsuite>{suite}</testsuite></testsuite></testsuites>"
            (folder / f"TEST-{name}.xml").write_text(xml)
            (folder / f"TEST-{name}More.xml").write_text(SUITE.format(c=name + "More", m="not asked"))
            text = f"[ERROR] There are test failures.\n[ERROR] Please refer to {folder} for the individual test results.\n"
            logs.append((f"{project}{i}", f"{name}.check", f"{project}/C{i}Test.java", text))
            tests[f"{project}{i}"] = f"{project} {i}"
        (folder / "TEST-a.b.Broken.xml").write_text("<testsuite><testcase")
    runs = spark.createDataFrame(logs, "run_id string, test_fqn string, path string, content string")
    sources = spark.createDataFrame([(r[2], "class X {}\n") for r in logs], "path string, content string")
    reports = readers.read_reports(spark, str(tmp_path))
    assert all(r.path.startswith("/") and "my platform" in r.path for r in reports.collect())
    got = {r.run_id: r.err_msg.strip() for r in triage.run_evidence(runs, sources, reports).collect()}
    assert {k: " ".join(v.split()[:2]) for k, v in got.items()} == tests

    from flakelens.operators import evidence

    assert reports.filter(evidence.is_unreadable(F.col("xml"))).count() == 2
    named = evidence.class_names_of(runs.select("run_id", F.col("run_id").alias("test_id"), "test_fqn")).drop("test_fqn")
    dirs = named.withColumn("report_dir", F.concat(F.lit(f"{tmp_path}/my platform/"), F.substring("run_id", 1, 3), F.lit("/target/surefire-reports")))
    found = evidence.reports_of_runs(dirs, reports).select("run_id", "xml")
    failures = evidence.report_failures(named, found, ["run_id"]).select("test_id", "message").distinct().collect()
    assert {(r.test_id, " ".join(r.message.split()[:2])) for r in failures} == set(tests.items())


def files_of(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("part-*")}


def documents_of(spark, target):
    rows = spark.read.schema("value string, repo string, sha string").text(target).collect()
    return sorted((r.repo, r.sha, r.value) for r in rows)


RESULT = "repo string, sha string, test_fqn string, status string, notes map<string,string>"


def results(spark, rows):
    return spark.createDataFrame([(*r, {"n": r[2]}) for r in rows], RESULT)


def test_results_of_some_tests_are_replaced(spark, tmp_path):
    first = [("r1", "0012", "a.T.x", "old"), ("r1", "0012", "a.T.y", "old"), ("r2", "ab", "a.T.x", "old"), ("r3", "cd", "z", "old")]
    target = sinks.write_results(results(spark, first), str(tmp_path), "run")
    before, was = files_of(tmp_path / "run_id=run"), documents_of(spark, target)
    new = [("r1", "0012", "a.T.x", "new"), ("r2", "ab", "a.T.q", "new"), ("r4", "ef", "a.T.x", "new")]
    assert sinks.replace_results(results(spark, new), str(tmp_path), "run") == target
    now = {(r.repo, r.sha, r.test_fqn): r.status for r in spark.read.schema(RESULT).json(target).collect()}
    assert now == {
        ("r1", "0012", "a.T.x"): "new", ("r1", "0012", "a.T.y"): "old", ("r2", "ab", "a.T.x"): "old",
        ("r2", "ab", "a.T.q"): "new", ("r3", "cd", "z"): "old", ("r4", "ef", "a.T.x"): "new",
    }
    # kept documents are the very text, and partitions without a new document the very files
    assert set(was) - set(documents_of(spark, target)) == {w for w in was if w[0] == "r1" and "a.T.x" in w[2]}
    untouched = {f: t for f, t in before.items() if f.startswith("repo=r3")}
    assert untouched and untouched.items() <= files_of(tmp_path / "run_id=run").items()


def test_replacing_begins_a_run_and_keeps_unknown_fields(spark, tmp_path):
    rows = [("r", "s", "a", "one"), ("r", "s", "a", "two"), (None, "s", None, "three")]
    order = F.when(F.col("status") == "one", 2).otherwise(1)
    target = sinks.replace_results(results(spark, rows), str(tmp_path), "run", order=order)
    got = {(r.repo, r.test_fqn, r.status) for r in spark.read.schema(RESULT).json(target).collect()}
    assert got == {("r", "a", "one"), (None, None, "three")}
    other = spark.createDataFrame([("r", "s", "b", 7)], "repo string, sha string, test_fqn string, version int")
    sinks.replace_results(other, str(tmp_path), "run")
    sinks.replace_results(results(spark, [("r", "s", "a", "last")]), str(tmp_path), "run")
    sinks.replace_results(results(spark, []), str(tmp_path), "run")
    back = spark.read.schema(RESULT + ", version int").json(target)
    assert {(r.repo, r.test_fqn, r.status, r.version) for r in back.collect()} == {
        ("r", "a", "last", None), ("r", "b", None, 7), (None, None, "three", None)}
    # a null place and a null name are one test too
    sinks.replace_results(results(spark, [(None, "s", None, "four")]), str(tmp_path), "run")
    again = spark.read.schema(RESULT).json(target)
    assert {r.status for r in again.filter("repo is null").collect()} == {"four"}


def test_report_cases_are_read_one_by_one(spark, tmp_path):
    case = '<testcase classname="a.B" name="{}"><failure message="m &amp; n" type="T">x <![CDATA[<testcase name="raw"/>]]></failure></testcase>'
    whole = ('<?xml version="1.0"?>\n<testsuites><!-- <testcase name="no"/> -->\n<s><s>' + case.format("t") + "\n<testcase classname='a.B' name='u'/></s></s>"
             + case.format("v") + "</testsuites>\n<!-- end -->\n")
    reports = {
        "whole": whole, "one": "<testsuite>" + case.format("w") + "</testsuite>", "empty": "", "none": "<testsuite/>",
        "cut": whole[: whole.index("<s>")] + case.format("c"), "inside": whole[: whole.index("</failure>")],
        "crossed": f"<testsuite><s>{case.format('x')}</testsuite></s>", "after": f"<testsuite>{case.format('y')}</testsuite><testcase",
    }
    for name, text in reports.items():
        (tmp_path / f"TEST-{name}.xml").write_text(text)
    (tmp_path / "other.txt").write_text(whole)
    from flakelens.operators import evidence

    rows = evidence.case_rows(readers.read_report_cases(spark, str(tmp_path)), ["path"]).collect()
    got = {(os.path.basename(r.path), r.name, r.failure_message) for r in rows}
    assert got == {
        ("TEST-whole.xml", "t", "m & n"), ("TEST-whole.xml", "u", None), ("TEST-whole.xml", "v", "m & n"),
        ("TEST-one.xml", "w", "m & n")}
    # a report held whole is read up to the end of its root
    held = evidence.report_cases(readers.read_reports(spark, str(tmp_path)), ["path"]).filter("name <> 'y'")
    assert {(os.path.basename(r.path), r.name, r.failure_message) for r in held.collect()} == got


def test_documents_of_any_shape_are_read_together(spark, tmp_path):
    folder = tmp_path / "run_id=x" / "repo=r" / "sha=01"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text('{"t":"one","p":{"c":"code"},"n":3}\n{"t":"two","p":"text","n":"four"}\nnot json\n{"t":null,"l":[1,{"c":2}]}\n')
    rows = sinks.read_documents(spark, str(tmp_path))
    doc = F.col("doc")
    got = rows.select("run_id", "repo", "sha", sinks.field(doc, "$.t").alias("t"), sinks.field(doc, "$.p.c", "$.p").alias("p"),
                      sinks.field(doc, "$.n", as_type="int").alias("n"), sinks.field(doc, "$.l[1].c", as_type="int").alias("l"))
    assert {tuple(r) for r in got.collect()} == {
        ("x", "r", "01", "one", "code", 3, None), ("x", "r", "01", "two", "text", None, None),
        ("x", "r", "01", None, None, None, None), ("x", "r", "01", None, None, None, 2)}


def test_the_ends_of_reports_are_found_without_sorting_lines(spark, tmp_path):
    """Flags and numbers are aggregated by hash; a text in the buffer would sort every line of a report."""
    ends = {
        "whole": "<testsuite>\n{}\n</testsuite>\n\n", "comment": "<testsuite>\n{}</testsuite>\n<!-- testcase -->\n",
        "cut": "<testsuite>\n{}\n", "named": "<testsuite>\n{}\n<!-- testsuite\n",
    }
    for name, text in ends.items():
        (tmp_path / f"{name}.xml").write_text(text.format('<testcase classname="C" name="t"/>'))
    cases = readers.read_report_cases(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in cases.collect()) == ["comment.xml", "whole.xml"]
    assert "SortAggregate" not in cases._jdf.queryExecution().executedPlan().toString()
