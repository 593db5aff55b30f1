"""Localisation, line lookup, reports, interval hits and the evidence bundle."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import fqn as names
from ..functions import logs
from ..operators import attempts, evidence, localize, methods, patches
from ..operators.lines import generate, line_table
from ..plans import repair, triage
from ..session import stored
from . import derived as d


def _places(spark, sf):
    customer = d.table(spark, sf, "customer")
    nation = d.table(spark, sf, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey",
        F.lower("n_name").alias("repo"),
        F.sha1("n_name").alias("sha"),
        F.lower("c_mktsegment").alias("module"),
        F.concat(F.lit("r"), "n_regionkey").alias("package"),
        F.concat(F.lit("C"), "c_custkey", F.lit("Test")).alias("class"),
    )


def _manifest(spark, sf):
    packaged = F.concat_ws(".", F.lit("org"), "package", "class", F.lit("check"))
    bare = F.concat_ws(".", "class", F.lit("check"))
    return _places(spark, sf).select(
        F.col("c_custkey").alias("test_id"), "repo", "sha", "module",
        F.when(F.col("c_custkey") % 10 == 9, bare).otherwise(packaged).alias("test_fqn"),
    )


def _files(spark, sf):
    orders = d.table(spark, sf, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "test").when(
        F.col("o_orderpriority") == "2-HIGH", "Test"
    ).otherwise("main")
    return orders.join(_places(spark, sf), F.col("o_custkey") == F.col("c_custkey")).select(
        "repo", "sha",
        F.concat_ws(
            "/", F.lit("clone"), "sha", "repo", "module", F.concat(F.lit("rev"), "o_orderkey"),
            F.lit("src"), kind, F.lit("java"), F.lit("org"), "package",
            F.concat(F.when(F.col("o_orderkey") % 3 == 0, "My").otherwise(""), "class", F.lit(".java")),
        ).alias("path"),
    )


def localize_status(spark, sf):
    """Every fifth test is listed in two categories."""
    manifest = _manifest(spark, sf)
    listed = manifest.unionByName(manifest.filter("test_id % 5 = 0"))
    return localize.localize(listed, _files(spark, sf)).select(
        "test_id", "n_candidates", "localization_status", "path"
    )


def _line_requests(spark, sf):
    content = F.col("content")
    numbers = logs.line_numbers(content, names.class_file(F.col("test_fqn")))
    return generate(d.run_logs(spark, sf), ["path"], numbers, "line_no")


def line_lookup(spark, sf):
    return evidence.line_lookup(_line_requests(spark, sf), d.sources(spark, sf), ["path"])


def _run_reports(spark, sf):
    runs = d.run_logs(spark, sf).select(
        "run_id", "test_id",
        names.class_fqn(F.col("test_fqn")).alias("class_fqn"),
        names.method_name(F.col("test_fqn")).alias("name"),
        F.explode_outer(logs.report_dirs(F.col("content"))).alias("report_dir"),
    ).filter("report_dir is not null")
    return evidence.reports_of_runs(runs, d.reports(spark, sf))


def report_failures(spark, sf):
    """Logs name a report folder, its reports give the cases, the cases meet their tests."""
    reports = _run_reports(spark, sf).select("run_id", "xml")
    tests = evidence.class_names_of(
        d.run_logs(spark, sf).select("run_id", "test_id", "test_fqn")
    ).drop("test_fqn")
    return evidence.report_failures(tests, reports, ["run_id"]).select(
        "test_id", "run_id", "has_error", "has_failure", "message"
    )


def interval_hits(spark, sf):
    points = _line_requests(spark, sf).distinct()
    spans = methods.method_table(d.sources(spark, sf), ["path"]).filter("name = 'check'")
    return evidence.enclosing_methods(
        points, spans.select("path", "name", "start_line", "end_line"), ["path"]
    )


def evidence_bundle(spark, sf):
    found = triage.run_evidence(
        d.run_logs(spark, sf), d.sources(spark, sf), d.reports(spark, sf)
    )
    return found.withColumn("err_methods", F.array_join("err_methods", ","))


def line_evidence(spark, sf):
    """The same evidence from logs held as lines."""
    logs_ = d.run_logs(spark, sf)
    found = triage.line_evidence(
        logs_.select("run_id", "test_fqn", "path"), line_table(logs_, ["run_id"]),
        d.sources(spark, sf), d.reports(spark, sf),
    )
    return found.withColumn("err_methods", F.array_join("err_methods", ","))


def _cut_tests(spark, sf):
    sources = d.sources(spark, sf)
    key = F.col("c_custkey")
    manifest = d.table(spark, sf, "customer").select(
        key.alias("test_id"),
        F.concat(F.lit("User"), key).alias("repo"),
        F.lit("work").alias("sha"),
        F.lit(".").alias("module"),
        F.concat(
            F.lit("org.shop."), F.when(key % 10 == 3, "Lost").otherwise("User"), key,
            F.lit("Test.check"),
        ).alias("test_fqn"),
    )
    files = sources.select(
        F.concat(F.lit("User"), "test_id").alias("repo"), F.lit("work").alias("sha"), "path", "content"
    )
    return triage.cut_tests(manifest, files)


def triage_report(spark, sf):
    """Manifest, sources, first runs and reports in; statuses, evidence and prompts out."""
    sources = d.sources(spark, sf)
    tests = _cut_tests(spark, sf)
    initial = triage.first_run_evidence(
        d.run_logs(spark, sf), sources.select("path", "content"), d.reports(spark, sf)
    ).drop("run_id", "ts")
    out = triage.initial_prompts(tests, initial, "%1$s|%2$s|%3$s|%4$s|%5$s")
    return out.select(
        "test_id", "localization_status", "summary", F.col("start.line").alias("start_line"),
        F.col("end.line").alias("end_line"), "prompt",
    )


def repair_report(spark, sf):
    """Result documents: tests, first runs and answers as attempts, with the prompt of each.

    Answers are cut to those of the loop before their patches are applied; the patched
    sources give the code that later prompts show.
    """
    sources = d.sources(spark, sf)
    found = triage.first_run_evidence(d.run_logs(spark, sf), sources.select("path", "content"))
    initial = stored(found.withColumns({"started": F.col("ts"), "ended": F.col("ts")}).drop("run_id", "ts"), "initial")
    prepared = patches.prepare_tests(sources.withColumn("method_name", F.lit("check")))
    answers = d.responses(spark, sf)
    outcomes = d.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("attempt_id"),
        F.col("o_custkey").alias("test_id"),
        F.col("o_orderdate").alias("ts"),
        (F.col("o_orderstatus") != "P").alias("applied"),
        F.when(F.col("o_orderpriority") == "1-URGENT", rules.PASS).otherwise(rules.FAILURE).alias("summary"),
        F.col("o_orderpriority").alias("err_msg"),
        F.lit("").alias("err_code"),
        F.array().cast("array<string>").alias("err_methods"),
    )
    failing = initial.filter(F.col("summary") == rules.FAILURE).select("test_id")
    order = ("ts", "attempt_id")
    cut = attempts.number_attempts(outcomes.join(failing, "test_id", "left_semi"), ["test_id"], order).drop("iter")
    asked = answers.join(cut.select("attempt_id"), "attempt_id", "left_semi")
    parsed = patches.parse_responses(asked.withColumn("text", F.col("response")), prepared).withColumnRenamed("text", "response")
    tries = parsed.drop("method_name", "test_id").join(cut, "attempt_id")
    patched = patches.apply_patches(tries, prepared.drop("original_imports")).drop("content", "method_code")
    tests = _cut_tests(spark, sf)
    asked = repair.attempt_prompts(tests, initial, patched, order, template="%1$s|%2$s|%3$s|%4$s|%5$s").drop("iter")
    docs = repair.result_documents(tests, initial, asked, "clone", "out", order)
    last = F.try_element_at(F.map_values("intermediate_log"), F.lit(-1))
    return docs.select(
        "test_id", "status", "initial_summary", "fixed_at", "attempts_used",
        F.col("final_patch.test_code").alias("final_code"),
        F.array_join(F.map_keys("intermediate_log"), ",").alias("logged"),
        "prev_summary", "result_json",
        last["prompt"].alias("last_prompt"), last["response"].alias("last_response"),
        last["related_code"]["method_code"].alias("last_code"),
        F.array_join(F.map_keys(last["related_code"]["global_vars"]), ",").alias("last_fields"),
    )


_PLACES = """SELECT c_custkey, lower(n_name) AS repo, sha1(n_name) AS sha, lower(c_mktsegment) AS module,
'r' || n_regionkey AS package, 'C' || c_custkey || 'Test' AS class
FROM customer JOIN nation ON c_nationkey = n_nationkey"""
_MANIFEST = f"""SELECT *, CASE WHEN c_custkey % 10 = 9 THEN class
ELSE 'org/' || package || '/' || class END AS class_path FROM ({_PLACES})"""
_FILES = f"""SELECT repo, sha, 'clone/' || sha || '/' || repo || '/' || module || '/rev' || o_orderkey || '/src/'
|| CASE o_orderpriority WHEN '1-URGENT' THEN 'test' WHEN '2-HIGH' THEN 'Test' ELSE 'main' END
|| '/java/org/' || package || '/' || CASE WHEN o_orderkey % 3 = 0 THEN 'My' ELSE '' END || class || '.java' AS path
FROM orders JOIN ({_PLACES}) ON o_custkey = c_custkey"""
_PATH = d.sql_text(d.SOURCE_PATH, {"u": "user_id"})
_WANTED = f"""SELECT DISTINCT {_PATH} AS path, user_id, n AS line_no FROM (
SELECT user_id, {d.K_SQL} AS n FROM events WHERE event_type IN ('error', 'click')
UNION ALL SELECT user_id, 28 FROM events WHERE event_type = 'error')"""
_SOURCE_LINES = f"SELECT test_id, path, string_split(content, chr(10)) AS l FROM ({d.sources_sql()})"
_MESSAGES = """SELECT event_id, user_id, kind, message FROM (
SELECT event_id, user_id, 'error' AS kind, 'java.lang.Error ' || event_id AS message FROM events
WHERE event_type = 'error' AND event_id % 4 IN (1, 3)
UNION ALL SELECT event_id, user_id, 'failure', 'run ' || event_id || ' failed twice' FROM events
WHERE event_type = 'error' AND event_id % 4 IN (0, 3))"""

_BUNDLE = f"""SELECT e.event_id AS run_id,
        CASE event_type WHEN 'error' THEN 'FAILURE' WHEN 'signup' THEN 'FAILURE' WHEN 'purchase' THEN 'PASS'
          WHEN 'click' THEN 'COMPILATION_ERROR' ELSE 'UNRECOGNIZED' END AS summary,
        CASE event_type WHEN 'click' THEN ' cannot find symbol' || chr(10) || 'symbol: method run' || e.event_id
          || '()' || chr(10) || ' bad line' || chr(10) ELSE coalesce(m.err_msg, '') END AS err_msg,
        CASE WHEN event_type = 'error' THEN concat_ws(chr(10), trim(l[k]),
            CASE WHEN trim(l[k]) IS DISTINCT FROM trim(l[28]) THEN trim(l[28]) END)
          WHEN event_type = 'click' THEN coalesce(trim(l[k]), '') ELSE '' END AS err_code,
        CASE event_type WHEN 'error' THEN 'check,run' WHEN 'signup' THEN 'setUp' ELSE '' END AS err_methods
        FROM (SELECT *, {d.K_SQL} AS k FROM events) e
        LEFT JOIN ({_SOURCE_LINES}) s ON s.test_id = e.user_id
        LEFT JOIN (SELECT event_id, string_agg(message, chr(10) ORDER BY kind) AS err_msg
          FROM ({_MESSAGES}) GROUP BY event_id) m ON m.event_id = e.event_id"""
_BUNDLE_WITHOUT_REPORTS = _BUNDLE.replace("coalesce(m.err_msg, '')", "''")
_CONTEXT = " || chr(10) || ".join(
    d.slice_sql("content", f"gap + {a}", f"gap + {b}")
    for a, b in ((15, 18), (19, 19), (9, 9), (10, 11), (12, 12), (42, 42), (36, 39))
)

_FIRST_RUN = """SELECT user_id, CASE arg_min(event_type, (ts, event_id)) WHEN 'error' THEN 'FAILURE'
WHEN 'signup' THEN 'FAILURE' WHEN 'purchase' THEN 'PASS' WHEN 'click' THEN 'COMPILATION_ERROR'
ELSE 'UNRECOGNIZED' END AS summary FROM events GROUP BY user_id"""
_TRIES = f"""SELECT o.*, applied AND o_orderpriority = '1-URGENT' AS passed FROM (
SELECT *, o_orderstatus <> 'P' AS applied, CAST(row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS iter FROM orders QUALIFY iter < 5) o
JOIN ({_FIRST_RUN}) f ON f.user_id = o_custkey AND f.summary = 'FAILURE'"""
_DONE = f"""SELECT o_custkey, min(iter) FILTER (WHERE passed) AS fixed_at, count(*) AS n,
arg_min_null({d.response_part_sql(d.PATCH_CODE)}, iter) FILTER (WHERE passed) AS final_code FROM ({_TRIES})
GROUP BY o_custkey"""
_AROUND = " || chr(10) || ".join(
    d.slice_sql("content", f"gap + {a}", f"gap + {b}") for a, b in ((15, 18), (19, 19), (9, 9), (10, 11), (12, 12), (42, 42))
)
_OWN = d.slice_sql("content", "gap + 36", "gap + 39")
_BEFORE = "OVER (PARTITION BY o_custkey ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_ASKED = f"""SELECT *, last_value(CASE WHEN applied THEN method_after END IGNORE NULLS) {_BEFORE} AS shown,
last_value(CASE WHEN applied THEN o_orderpriority END IGNORE NULLS) {_BEFORE} AS seen
FROM (SELECT t.*, coalesce({d.response_part_sql(d.PATCH_CODE)}, {_OWN}) AS method_after, {_OWN} AS own, {_AROUND} AS around,
  {d.response_part_sql(list(d.RESPONSES))} AS response
  FROM ({_TRIES}) t JOIN ({d.sources_sql()}) s ON s.test_id = o_custkey)"""
_KEPT = f"""SELECT t.o_custkey, string_agg(CAST(iter AS VARCHAR), ',' ORDER BY iter) AS logged,
arg_max(CASE WHEN o_orderpriority = '1-URGENT' THEN 'PASS' ELSE 'FAILURE' END, iter) AS prev_summary,
arg_max('check|' || CASE WHEN shown IS NULL AND t.o_custkey % 10 = 3 THEN '' ELSE around || chr(10) || coalesce(shown, own) END
  || '|' || coalesce(seen || '||', r.err_msg || '|' || r.err_code || '|' || replace(r.err_methods, ',', ', ')), iter) AS last_prompt,
arg_max(response, iter) AS last_response, arg_max(method_after, iter) AS last_code
FROM ({_ASKED}) t JOIN ({_DONE}) d ON d.o_custkey = t.o_custkey
JOIN (SELECT e.user_id, b.* FROM (SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id
  FROM events GROUP BY user_id) e JOIN ({_BUNDLE_WITHOUT_REPORTS}) b ON b.run_id = e.event_id) r ON r.user_id = t.o_custkey
WHERE applied AND iter <= coalesce(fixed_at, 5) GROUP BY t.o_custkey"""

QUERIES = {
    "localize_status": (
        localize_status,
        f"""WITH r AS (SELECT m.c_custkey AS test_id, count(f.path) AS n_candidates,
        CASE count(f.path) WHEN 0 THEN '{rules.NOT_LOCALIZED}' WHEN 1 THEN '{rules.LOCALIZED}'
          ELSE '{rules.AMBIGUOUS}' END AS localization_status,
        CASE WHEN count(f.path) = 1 THEN min(f.path) END AS path
        FROM ({_MANIFEST}) m LEFT JOIN ({_FILES}) f ON m.repo = f.repo AND m.sha = f.sha
          AND ends_with(f.path, m.class || '.java') AND contains(f.path, m.class_path)
          AND contains(f.path, m.module) AND contains(lower(f.path), '/test/')
        GROUP BY m.c_custkey) SELECT * FROM r UNION ALL SELECT * FROM r WHERE test_id % 5 = 0""",
    ),
    "line_lookup": (
        line_lookup,
        f"""SELECT w.path, w.line_no, trim(s.l[w.line_no]) AS line FROM ({_WANTED}) w
        LEFT JOIN ({_SOURCE_LINES}) s ON s.path = w.path""",
    ),
    "report_failures": (
        report_failures,
        f"""SELECT user_id AS test_id, event_id AS run_id, event_id % 4 IN (1, 3) AS has_error,
        event_id % 4 IN (0, 3) AS has_failure, message FROM ({_MESSAGES})""",
    ),
    "interval_hits": (
        interval_hits,
        f"""SELECT w.path, w.line_no, m.name, m.start_line, m.end_line FROM ({_WANTED}) w
        JOIN ({d.methods_sql()}) m ON m.test_id = w.user_id AND m.name = 'check'
          AND w.line_no BETWEEN m.start_line AND m.end_line""",
    ),
    "evidence_bundle": (evidence_bundle, _BUNDLE),
    "line_evidence": (line_evidence, _BUNDLE),
    "repair_report": (
        repair_report,
        f"""SELECT c_custkey AS test_id, CASE summary WHEN 'PASS' THEN '{rules.SKIPPED}' WHEN 'FAILURE' THEN
          CASE WHEN fixed_at IS NULL THEN '{rules.UNRESOLVED}' ELSE '{rules.FIXED}' END
          ELSE coalesce(summary, CASE WHEN c_custkey % 10 = 3 THEN '{rules.NOT_LOCALIZED}'
            ELSE '{rules.LOCALIZED}' END) END AS status, summary AS initial_summary, fixed_at,
        CASE WHEN summary IS NOT NULL THEN CAST(coalesce(fixed_at + 1, n, 0) AS INTEGER) END AS attempts_used,
        final_code, logged, prev_summary, last_prompt, last_response, last_code,
        CASE WHEN last_code IS NOT NULL THEN 'BRACE,sizes,balance,names' END AS last_fields, 'out/User' || c_custkey || '/work/org.shop.'
          || CASE WHEN c_custkey % 10 = 3 THEN 'Lost' ELSE 'User' END || c_custkey || 'Test.check.json' AS result_json
        FROM customer c LEFT JOIN ({_FIRST_RUN}) f ON f.user_id = c_custkey
        LEFT JOIN ({_DONE}) d ON d.o_custkey = c_custkey LEFT JOIN ({_KEPT}) k ON k.o_custkey = c_custkey""",
    ),
    "triage_report": (
        triage_report,
        f"""SELECT t.test_id, CASE WHEN lost THEN '{rules.NOT_LOCALIZED}' ELSE '{rules.LOCALIZED}' END
          AS localization_status, r.summary,
        CASE WHEN NOT lost THEN gap + 36 END AS start_line, CASE WHEN NOT lost THEN gap + 39 END AS end_line,
        CASE WHEN NOT lost AND r.summary = 'FAILURE' THEN 'check|' || {_CONTEXT} || '|' || r.err_msg || '|'
          || r.err_code || '|' || replace(r.err_methods, ',', ', ') END AS prompt
        FROM (SELECT *, test_id % 10 = 3 AS lost FROM ({d.sources_sql()})) t
        LEFT JOIN (SELECT e.user_id, b.* FROM (SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id
            FROM events GROUP BY user_id) e JOIN ({_BUNDLE}) b ON b.run_id = e.event_id) r
          ON r.user_id = t.test_id""",
    ),
}
