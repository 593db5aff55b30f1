"""Operators on tables, with brute force and skewed keys."""

import random

from pyspark.sql import functions as F

from flakelens import rules
from flakelens.functions import fqn
from flakelens.operators import attempts, evidence, lines, localize, methods, patches, scans

# ---------------------------------------------------------------- localise
MANIFEST = "test_id string, repo string, sha string, module string, test_fqn string"


def brute_candidates(tests, files):
    out = set()
    for tid, repo, sha, module, name in tests:
        parts = name.split(".")
        if len(parts) < 2:
            continue
        for r, s, path in files:
            if (r, s) == (repo, sha) and path.split("/")[-1].endswith(parts[-2] + ".java") \
                    and "/".join(parts[:-1]) in path and module in path and "/test/" in path.lower():
                out.add((tid, path))
    return out


def test_localize_statuses(spark):
    tests = [
        ("one", "r", "s", "m", "a.b.CTest.t"), ("none", "r", "s", "m", "a.b.D.t"),
        ("two", "r", "s", ".", "a.b.E.t"), ("othersha", "r", "z", "m", "a.b.CTest.t"),
        ("noclass", "r", "s", "m", "t"),
    ]
    files = [
        ("r", "s", "k/s/r/m/src/Test/java/a/b/CTest.java"), ("r", "s", "k/s/r/m/src/main/java/a/b/D.java"),
        ("r", "s", "k/s/r/m/test/a/b/E.java"), ("r", "s", "k/s/r/n/test/a/b/E.java"),
        ("r", "s", "k/s/r/m/test/a/b/MyCTest.java"),
    ]
    got = {
        r.test_id: (r.localization_status, r.path)
        for r in localize.localize(
            spark.createDataFrame(tests, MANIFEST), spark.createDataFrame(files, "repo string, sha string, path string")
        ).collect()
    }
    assert got == {
        "one": (rules.LOCALIZED, files[0][2]), "none": (rules.NOT_LOCALIZED, None),
        "two": (rules.AMBIGUOUS, None), "othersha": (rules.NOT_LOCALIZED, None),
        "noclass": (rules.NOT_LOCALIZED, None),
    }


def test_localize_equals_all_pairs(spark):
    rng = random.Random(5)
    names = ["A", "BA", "CBA", "TestA", "ATest", "AA"]
    dirs = ["p", "A", "p/q", "q/A", "BAx"]
    tests = [
        (f"t{i}", rng.choice("rs"), "x", rng.choice([".", "m", "q"]),
         rng.choice(["", "p.", "p.q.", "A.", "q.A."]) + rng.choice(names) + ".t")
        for i in range(60)
    ]
    files = list({
        (rng.choice("rs"), "x", f"c/{rng.choice(['m/', ''])}{rng.choice(['test', 'Test', 'main'])}/{rng.choice(dirs)}/{rng.choice(names)}.java")
        for _ in range(150)
    })
    got = localize.candidates(
        spark.createDataFrame(tests, MANIFEST), spark.createDataFrame(files, "repo string, sha string, path string")
    )
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute_candidates(tests, files) and pairs


def test_a_class_name_that_all_modules_share_meets_its_own_package(spark, monkeypatch):
    n = 120
    tests = [(f"t{i}", "r", "s", f"m{i % 7}", f"org.p{i}.AllTest.t") for i in range(n)]
    files = [("r", "s", f"k/m{i % 7}/src/test/java/org/p{i}/AllTest.java") for i in range(n)]
    met, seen = localize._met, []
    monkeypatch.setattr(localize, "_met", lambda *a: seen.append(met(*a)) or seen[-1])
    found = localize.candidates(spark.createDataFrame(tests, MANIFEST), spark.createDataFrame(files, "repo string, sha string, path string"))
    assert found.count() == n and seen[0].count() == n


# ------------------------------------------------------------------- scans
def skewed(rng, n=1500):
    """One key with more than a third of all rows, one null key, many small ones."""
    rows = []
    for i in range(n):
        key = None if rng.random() < 0.1 else 0 if rng.random() < 0.5 else rng.randint(1, 40)
        rows.append((key, i // 2, i, rng.choice([1, 0, -1]), rng.choice([None, i])))
    rng.shuffle(rows)
    return rows


SEQ = "k int, t int, i int, delta int, v int"


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_running_sums_and_last_known_equal_brute_force(spark):
    rows = skewed(random.Random(1))
    df = spark.createDataFrame(rows, SEQ)
    chunk = F.floor(F.col("t") / 50)
    sums = scans.running_sums(
        df, ["k"], ["t", "i"], chunk, {"s": F.col("delta"), "n": F.lit(1)})
    last = scans.last_known(df, ["k"], ["t", "i"], chunk, {"w": F.col("v")})
    prev = scans.last_known(
        df, ["k"], ["t", "i"], chunk, {"w": F.col("v")}, include_current=False)
    want = {}
    for seq in by_key(rows).values():
        total, known = 0, None
        for n, (_, _, i, delta, v) in enumerate(seq, 1):
            total += delta
            before, known = known, v if v is not None else known
            want[i] = (total, n, known, before)
    assert {r.i: (r.s, r.n) for r in sums.collect()} == {i: w[:2] for i, w in want.items()}
    assert {r.i: r.w for r in last.collect()} == {i: w[2] for i, w in want.items()}
    assert {r.i: r.w for r in prev.collect()} == {i: w[3] for i, w in want.items()}
    assert set(sums.columns) == {*df.columns, "s", "n"}


def test_chunking_does_not_change_the_result(spark):
    df = spark.createDataFrame(skewed(random.Random(2)), SEQ)
    one = scans.running_sums(df, ["k"], ["t", "i"], F.lit(0), {"s": F.col("delta")})
    for width in (1, 3, 50, 10_000):
        many = scans.running_sums(
            df, ["k"], ["t", "i"], F.floor(F.col("t") / width), {"s": F.col("delta")})
        assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_balanced_regions_equal_brute_force(spark):
    rows = skewed(random.Random(3))
    df = spark.createDataFrame(rows, SEQ)
    got = scans.region_summary(
        scans.balanced_regions(
            df, ["k"], ["t", "i"], F.floor(F.col("t") / 40),
            (F.col("delta") == 1).cast("int"), (F.col("delta") == -1).cast("int"),
        ),
        ["k"],
    )
    want = set()
    for key, seq in by_key(rows).items():
        depth, region, start, low = 0, 0, 1, None
        for pos, row in enumerate(seq, 1):
            depth += row[3]
            low = depth if low is None else min(low, depth)
            closed = depth == 0 and row[3] < 0
            if closed or pos == len(seq):
                want.add((key, region, start, pos, pos - start + 1, closed, low < 0))
                region, start, low = region + 1, pos + 1, None
    assert {tuple(r) for r in got.select("k", "region_id", "start_pos", "end_pos", "n_rows", "is_closed", "is_negative").collect()} == want


def test_scan_shuffles_rows_by_key_and_chunk(spark):
    df = spark.createDataFrame(skewed(random.Random(4)), SEQ)
    out = scans.running_sums(df, ["k"], ["t", "i"], F.floor(F.col("t") / 40), {"s": F.col("delta")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        if "Window" in line and "delta" in line and "_t_" not in line:
            assert "_chunk" in line


# ------------------------------------------------------------------- lines
def test_first_occurrences_and_wins(spark):
    df = spark.createDataFrame([(1, "a\nb\na\nc\nb"), (2, "")], "id int, content string")
    table = lines.line_table(df, ["id"])
    got = sorted(tuple(r) for r in lines.first_occurrences(table, ["id"]).select("id", "line_no", "line").collect())
    assert got == [(1, 1, "a"), (1, 2, "b"), (1, 4, "c"), (2, 1, "")]
    joined = {r.id: r.joined for r in lines.joined_lines(df, ["id"], "content", "content").collect()}
    assert joined == {1: "a\nb\nc", 2: ""}


def test_merge_update(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    new = spark.createDataFrame([(1, "A", 5), (3, "C", 6)], "id int, v string, n int")
    got = sorted(tuple(r) for r in lines.merge_update(base, new, ["id"]).collect())
    assert got == [(1, "A", "x", 5), (2, "b", "y", None)]
    m = spark.sql("select map('a', 1, 'b', 2) o, map('b', 3, 'c', 4) n")
    assert m.select(lines.merge_maps(F.col("o"), F.col("n")).alias("m")).first().m == {"a": 1, "b": 3, "c": 4}


# ---------------------------------------------------------------- evidence
def test_interval_join_equals_all_pairs(spark):
    rng = random.Random(6)
    spans = [(rng.choice("pq"), f"m{i}", a, a + rng.choice([0, 3, 70, 300])) for i, a in enumerate(rng.choices(range(1, 400), k=60))]
    points = list({(rng.choice("pqz"), rng.randint(-5, 500)) for _ in range(300)})
    got = evidence.enclosing_methods(
        spark.createDataFrame(points, "path string, line_no int"),
        spark.createDataFrame(spans, "path string, name string, start_line int, end_line int"), ["path"],
    )
    rows = [(r.path, r.line_no, r.name) for r in got.collect()]
    want = [(p, n, m) for p, n in points for q, m, a, b in spans if p == q and a <= n <= b]
    assert sorted(rows) == sorted(want)


def test_line_lookup(spark):
    req = spark.createDataFrame([("p", 2), ("p", 2), ("p", 9), ("p", 0), ("q", 1)], "path string, line_no int")
    src = spark.createDataFrame([("p", "a\n  b \nc")], "path string, content string")
    got = sorted(tuple(r) for r in evidence.line_lookup(req, src, ["path"]).collect())
    assert got == [("p", 0, None), ("p", 2, "b"), ("p", 9, None), ("q", 1, None)]


REPORT = """<testsuite name="s">
<testcase classname="a.B" name="t"><error type="E1">x</error><failure message="m  1&#10;" type="F1"/></testcase>
<testcase classname="a.B" name="other"><failure type="F2"/></testcase>
<testcase classname="a.B" name="fine"/>
<testcase classname="a.C" name="t"><failure message="no"/></testcase></testsuite>"""


def test_report_failures(spark):
    tests = spark.createDataFrame([("1", "a.B", "t", "r"), ("2", "a.B", "fine", "r"), ("3", "a.B", "t", "other")],
                                  "test_id string, class_fqn string, name string, run string")
    reports = spark.createDataFrame([("r", REPORT), ("bad", "<oops"), ("empty", "<testsuite/>")], "run string, xml string")
    own = evidence.report_failures(tests, reports, ["run"])
    assert sorted((r.test_id, r.message) for r in own.collect()) == [("1", "E1"), ("1", "m 1")]
    scope = evidence.report_failures(tests.filter("test_id = '1'"), reports, ["run"], class_scope=True)
    assert sorted(r.message for r in scope.collect()) == ["E1", "F2", "m 1"]


def test_cases_at_any_depth(spark):
    def case(name, body):
        return f'<testcase classname="a.B" name="{name}" note="1 > 0"\n>{body}</testcase >'

    raw = "<![CDATA[</testcase><testcase classname='a.B' name='raw'/>]]><!-- <testcase name='c'/> -->"
    inner = case("t", f'<failure message="deep &amp; found" type="T">{raw}{"long <b/> " * 20_000}</failure>') + "<testcase classname='a.B' name='fine'/>"
    deep = '<?xml version="1.0"?><testsuites>' + "<testsuite name='s'>" * 12 + f"<group><system-out>{raw}</system-out>{inner}</group>"
    closed = "</testsuite>" * 12 + "</testsuites>"
    reports = spark.createDataFrame(
        [("deep", deep + closed), ("mixed", f"<testsuite><testsuite>{inner}</testsuite>{case('u', '<error type=\"E\"/>')}</testsuite>"),
         ("cut", deep), ("crossed", deep + "</testsuites>"), ("none", None)], "run string, xml string")
    got = [(r.run, r.name, r.failure_message or r.error_message) for r in evidence.report_cases(reports, ["run"]).collect() if r.name]
    assert got == [("deep", "t", "deep & found"), ("deep", "fine", None), ("mixed", "t", "deep & found"), ("mixed", "fine", None), ("mixed", "u", "E")]
    mine = evidence.reported_messages(F.col("xml"), F.lit("a.B"), F.lit("t")).alias("m")
    assert {r.run: list(r.m or []) for r in reports.select("run", mine).collect()} == {
        "deep": ["deep & found"], "mixed": ["deep & found"], "cut": [], "crossed": [], "none": []}


def test_reports_of_runs_walks_below_the_directory(spark):
    runs = spark.createDataFrame([("r1", "a.B", "/w/x/"), ("r2", "a.B", "/w/xx")], "run_id string, class_fqn string, report_dir string")
    reports = spark.createDataFrame(
        [("/w/x/TEST-a.B.xml", "1"), ("/w/x/d/e/TEST-a.B-2.xml", "2"), ("/w/x/TEST-a.C.xml", "3"),
         ("/w/x/TEST-a.B.txt", "4"), ("/w/xx/TEST-a.B.xml", "5"), ("/w/TEST-a.B.xml", "6")], "path string, xml string")
    got = sorted((r.run_id, r.xml) for r in evidence.reports_of_runs(runs, reports).collect())
    assert got == [("r1", "1"), ("r1", "2"), ("r2", "5")]


def test_reports_are_listed_only_as_deep_as_logs_name_folders(spark):
    reports = spark.createDataFrame(
        [("/w/x/d/e/TEST-a.b.C.xml", "1"), ("/TEST-a.b.C.xml", "2"), ("rel/TEST-a.b.C$D--\U0001f600z.xml", "3"), ("/w/x/TEST-.xml", "4")],
        "path string, xml string")
    deep = evidence.listed_reports(reports, depths=[3])
    assert sorted(tuple(r) for r in deep.collect()) == [
        ("/w/x/TEST-.xml", "", "/w/x"), *[("/w/x/d/e/TEST-a.b.C.xml", c, "/w/x") for c in ("a", "a.b", "a.b.C")]]
    every = {tuple(r) for r in evidence.listed_reports(reports).collect()}
    assert every == {tuple(r) for r in evidence.listed_reports(reports, depths=range(1, 9)).collect()}
    odd = {c for p, c, _ in every if p.startswith("rel/")}
    assert odd == {"a", "a.b", "a.b.C", "a.b.C$D", "a.b.C$D-", "a.b.C$D--", "a.b.C$D--\U0001f600z"}
    runs = spark.createDataFrame(
        [("r1", "a.b.C", "/w/x/d/"), ("r2", "a.b.C", "/"), ("r3", "a.b.C", "/w"), ("r4", "a.b.C", None), ("r5", "a.b.C$D", "rel")],
        "run_id string, class_fqn string, report_dir string")
    got = sorted((r.run_id, r.xml) for r in evidence.reports_of_runs(runs, reports).collect())
    assert got == [("r1", "1"), ("r2", "1"), ("r2", "2"), ("r3", "1"), ("r5", "3")]


def test_evidence_bundle_joins_messages_and_code(spark):
    logs = spark.createDataFrame(
        [("1", "a.B.t", "p", "There are test failures\n\tat a.B.t(B.java:2)\n\tat a.B.u(B.java:9)"),
         ("2", "a.B.t", "missing", "BUILD SUCCESS No Test Failed with this configuration")],
        "run_id string, test_fqn string, path string, content string")
    src = spark.createDataFrame([("p", "x\n  y();\n")], "path string, content string")
    msgs = spark.createDataFrame([("1", ["boom", "boom", "bang"])], "run_id string, messages array<string>")
    got = {r.run_id: tuple(r)[1:] for r in evidence.evidence_bundle(logs, src, msgs).collect()}
    assert got == {"1": (rules.FAILURE, "boom\nbang", "y();", ["t", "u"]), "2": (rules.PASS, "", "", [])}


def test_line_form_reads_every_line_with_the_file_name(spark):
    logs = spark.createDataFrame(
        [("1", "w.CTest.t", "/w/CTest.java", "[INFO] x\n[WARNING] /w/CTest.java [12,5] unchecked\nin CTest.java line 3\n/w/CTest.java:[7,1] x\n\tat w.CTest.t(CTest.java:9)\n[WARNING] /w/Other.java [1,1]"),
         ("2", "w.CTest.t", "/w/CTest.java", "There are test failures\n[WARNING] /w/DTest.java [12,5] x")],
        "run_id string, test_fqn string, path string, content string")
    whole = evidence.mined_logs(logs)
    table = lines.line_table(logs, ["run_id"], "content").select("run_id", "line_no", "line")
    by_line = evidence.mined_lines(logs.drop("content"), table).select(whole.columns)
    want = sorted(map(tuple, whole.collect()))
    assert 12 in want[0][whole.columns.index("line_numbers")]
    assert sorted(map(tuple, by_line.collect())) == want


def noisy_logs(seed=7):
    """(run, text) rows; run 0 has more than half of all lines."""
    rnd = random.Random(seed)
    pool = [
        "[ERROR] There are test failures.", "[INFO] BUILD SUCCESS", "[INFO] No Test Failed with this configuration",
        "[ERROR] COMPILATION ERROR :", "[INFO] BUILD FAILURE", "[INFO] Finished at: now", "x [INFO] Finished at: y [ERROR] z",
        "[INFO] Finished at: a To see the full stack trace of the errors", "[ERROR] To see the full stack trace of the errors, use -e",
        "[ERROR] Failed to execute goal x", "[ERROR] /w/CTest.java:[{n},1] no symbol -> [Help 1]", "[ERROR] plain {n}",
        "\tat w.CTest.m{n}(CTest.java:{n})", "\tat w.Other.m(Other.java:{n})", "[WARNING] /w/CTest.java [{n},5] unchecked",
        "Please refer to /w/r{n}/reports for the individual test results.", "nothing {n}", "nothing else", "",
    ]
    line = lambda: rnd.choice(pool).replace("{n}", str(rnd.randint(1, 40)))
    return [(run, "\n".join(line() for _ in range(3000 if run == 0 else rnd.randint(0, 60)))) for run in range(40)]


def test_line_form_equals_text_form_for_a_run_with_most_lines(spark):
    logs = spark.createDataFrame(noisy_logs(), "run_id long, content string").select(
        "run_id", F.lit("w.CTest.t").alias("test_fqn"), F.lit("/w/CTest.java").alias("path"), "content")
    whole = evidence.mined_logs(logs)
    table = lines.line_table(logs, ["run_id"]).select("run_id", "line_no", "line")
    by_line = evidence.mined_lines(logs.drop("content"), table, block=100).select(whole.columns)
    assert sorted(map(tuple, by_line.collect())) == sorted(map(tuple, whole.collect()))
    joins = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in joins}
    try:
        for key, value in joins.items():
            spark.conf.set(key, value)
        marked = evidence.marked_lines(logs.drop("content"), table, block=100)
        hot = marked.withColumn("task", F.spark_partition_id()).filter("run_id = 0").select("task").distinct().count()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert hot == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_method_join_keeps_tests_without_method(spark):
    src = spark.createDataFrame([("p", "class A {\n void t() { }\n void t(int i) { }\n}")], "path string, content string")
    tests = spark.createDataFrame([("p", "t"), ("p", "z")], "path string, name string")
    got = {r.name: r.start_line for r in methods.method_of_test(tests, methods.method_table(src, ["path"]), ["path"]).collect()}
    assert got == {"t": 3, "z": None}


# ----------------------------------------------------------------- patches
def test_import_table_form_equals_row_form(spark):
    from flakelens.functions import responses

    answers = spark.createDataFrame([(1, "import a.X; import b.L; import c.*; import o.L;"), (2, "import q.Q;")], "id int, r string")
    sources = spark.createDataFrame([(1, "import o.L; import p.*;")], "id int, s string")
    table = patches.new_import_rows(
        patches.import_rows(answers, ["id"], "r"), patches.import_rows(sources, ["id"], "s"), ["id"])
    got = {(r.id, r.statement): (r.is_new, r.is_conflict) for r in table.collect()}
    assert got == {
        (1, "import a.X;"): (True, False), (1, "import b.L;"): (False, True), (1, "import c.*;"): (True, False),
        (1, "import o.L;"): (False, False), (2, "import q.Q;"): (True, False)}
    row = answers.join(sources, "id").select(
        responses.new_imports(responses.import_statements(F.col("r")), responses.import_statements(F.col("s"))).alias("n")).first()
    assert row.n == ["import a.X;", "import c.*;"]


def test_missing_dependency_rows(spark):
    wanted = patches.dependency_rows(spark.createDataFrame(
        [("p", "<dependency><artifactId>a</artifactId></dependency><dependency><artifactId>b</artifactId></dependency>"
               "<dependency><artifactId>b</artifactId></dependency><dependency><artifactId>mycompany</artifactId></dependency>")],
        "build_path string, pom string"), ["build_path"])
    present = patches.artifact_rows(spark.createDataFrame([("p", "x <artifactId>a</artifactId>")], "build_path string, content string"), ["build_path"])
    assert [r.artifact_id for r in patches.missing_dependency_rows(wanted, present, ["build_path"]).collect()] == ["b"]


# ---------------------------------------------------------------- attempts
ATT = "test_id int, ts timestamp_ntz, applied boolean, summary string, patch string"


def attempt_rows(test, outcomes):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    return [
        (test, t0 + dt.timedelta(seconds=10 * i), a, s, f"p{i}") for i, (a, s) in enumerate(outcomes)
    ]


def test_repair_outcomes(spark):
    p, f, c = (True, rules.PASS), (True, rules.FAILURE), (True, rules.COMPILATION_ERROR)
    tests = {1: [p], 2: [f, c, f, f, p], 3: [f] * 5 + [p], 4: [f, f], 5: [(False, rules.PASS), p], 6: [p], 7: [p], 8: []}
    initial = [(k, rules.FAILURE) for k in tests if k not in (6, 7)] + [(6, rules.PASS), (7, rules.UNRECOGNIZED)]
    rows = [r for k, v in tests.items() for r in attempt_rows(k, v)]
    out = attempts.repair_outcomes(
        spark.createDataFrame(initial, "test_id int, initial_summary string"), spark.createDataFrame(rows, ATT), ["ts"])
    got = {r.test_id: (r.status, r.fixed_at, r.attempts_used, r.final_patch, r.elapsed_s) for r in out.collect()}
    assert got == {
        1: ("fixed", 0, 1, "p0", 0.0), 2: ("fixed", 4, 5, "p4", 40.0), 3: ("unresolved", None, 5, None, 40.0),
        4: ("unresolved", None, 2, None, 10.0), 5: ("fixed", 1, 2, "p1", 10.0), 6: ("skipped", None, 0, None, None),
        7: (rules.UNRECOGNIZED, None, 0, None, None), 8: ("unresolved", None, 0, None, None)}


def test_until_pass_evidence_and_carry(spark):
    rows = attempt_rows(1, [(False, "a"), (True, "b"), (False, "c"), (True, rules.PASS), (True, "e")])
    n = attempts.number_attempts(spark.createDataFrame(rows, ATT), ["test_id"], ["ts"])
    kept = attempts.until_pass(n, ["test_id"], F.col("summary") == rules.PASS)
    assert sorted(r.iter for r in kept.collect()) == [0, 1, 2, 3]
    seen = attempts.previous_evidence(kept, ["test_id"], F.col("summary"), F.lit("init"), F.col("applied"))
    both = attempts.carry_forward(seen, ["test_id"], {"after": F.col("summary")}, F.col("applied"))
    got = [(r.seen, r.after) for r in both.orderBy("iter").collect()]
    assert got == [("init", None), ("init", "b"), ("b", "b"), ("b", rules.PASS)]


def test_attempt_log(spark):
    n = attempts.number_attempts(spark.createDataFrame(attempt_rows(1, [(True, "a")] * 7), ATT), ["test_id"], ["ts"])
    log = attempts.attempt_log(n, ["test_id"], "summary", "patch").first().intermediate_log
    assert list(log) == ["0", "1", "2", "3", "4"] and log["4"].patch == "p4"


def test_attempt_limit_reaches_the_map_side(spark):
    n = attempts.number_attempts(spark.createDataFrame(attempt_rows(1, [(True, "a")] * 7), ATT), ["test_id"], ["ts"])
    plan = n._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_test_ids_separate_keys(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c")], "x string, y string")
    assert df.select(fqn.test_id(F.col("x"), F.col("y"))).distinct().count() == 2


def test_repeated_updates_of_a_key_are_merged_in_order(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z")], "k int, v string, w string")
    update = spark.createDataFrame(
        [(1, 2, "late", None, 7), (1, 1, "early", "first", None), (1, 3, None, None, None), (3, 1, "new", None, 1), (9, 1, "none", "none", 1)],
        "k int, n int, v string, w string, extra int")
    got = {tuple(r) for r in lines.merge_update(base, update, ["k"], ["n"]).collect()}
    assert got == {(1, "late", "first", 7), (2, "b", "y", None), (3, "new", "z", 1)}
