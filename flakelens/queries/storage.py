"""Readers and writers, each checked by a round trip over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..functions import fqn as names
from ..functions import builds, logs, patches, text
from ..operators import evidence
from ..operators import patches as patches_rows
from ..operators.lines import line_table
from ..session import scratch_dir
from ..sources import readers, sinks
from . import derived as d


def _manifest(spark, sf):
    customer = d.table(spark, sf, "customer")
    nation = d.table(spark, sf, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("https://host/"), F.lower("n_name")).alias("Project URL"),
        F.sha1("n_name").alias("SHA Detected"),
        F.lower("c_mktsegment").alias("Module Path"),
        F.concat(F.lit("org.shop.User"), "c_custkey", F.lit("Test.check")).alias("Test"),
        F.lit("NOD").alias("Category"),
        F.when(F.col("c_custkey") % 3 == 0, "Repo, \"Archived\"").otherwise("").alias("Status"),
        F.lit("").alias("PR Link"),
        F.lit("").alias("Notes"),
    )


def manifest_scan(spark, sf):
    """Records of eight fields, longer and shorter ones, quoted and empty fields."""
    path = scratch_dir(spark, "manifest")
    rows = _manifest(spark, sf)

    def field(name):
        value = F.col(f"`{name}`")
        return F.when(
            value.contains('"') | value.contains(","),
            F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"')),
        ).otherwise(value)

    fields = [field(c) for c in rows.columns]
    key = F.regexp_extract("Test", r"\d+", 0).cast("long")
    record = (
        F.when(key % 7 == 1, F.concat_ws(",", *fields, F.lit('extra,"y, ""z"""')))
        .when(key % 7 == 2, F.concat_ws(",", *fields[:3]))
        .otherwise(F.concat_ws(",", *fields))
    )
    rows.select(record.alias(",".join(rows.columns))).write.option("header", True).option(
        "sep", "\u0001"
    ).option("quote", "").csv(path)
    return readers.read_test_manifest(spark, path).withColumn("surplus", F.array_join("surplus", "|"))


def module_manifest_scan(spark, sf):
    path = scratch_dir(spark, "modules")
    record = F.concat_ws(",", "Project URL", "SHA Detected", "Module Path")
    pair = F.concat_ws(" ", record, F.concat_ws(",", F.lit("https://host/x"), "Test", F.lit("")))
    _manifest(spark, sf).select(pair).write.text(path)
    return readers.read_module_manifest(spark, path)


def tree_scan(spark, sf):
    """Documents written as a tree of text files, read whole and split into lines."""
    path = scratch_dir(spark, "tree")
    lines = F.transform(text.lines(F.col("text")), lambda x: F.concat_ws("\t", "doc_id", x))
    (
        d.table(spark, sf, "documents")
        .select((F.col("doc_id") % 16).alias("folder"), F.explode(lines).alias("value"))
        .write.partitionBy("folder").option("maxRecordsPerFile", 1000).text(path)
    )
    content = F.regexp_replace("content", "\n$", "")
    rows = readers.read_tree(spark, path, "*.txt").select(F.explode(text.lines(content)).alias("row"))
    return rows.select(
        F.substring_index("row", "\t", 1).cast("long").alias("doc_id"),
        F.substring(F.col("row"), F.position(F.lit("\t"), F.col("row")) + 1, F.length("row")).alias("line"),
    )


FOLDERS = 16


def _written_in_order(rows, order, path):
    """``(folder, value)`` rows as one text file for each folder, in the given order.

    Folders go to tasks by their number: by a hash some tasks would sort several of them.
    """
    (
        rows.repartitionById(FOLDERS, F.pmod(F.coalesce("folder", F.lit(0)), F.lit(FOLDERS)).cast("int"))
        .sortWithinPartitions("folder", *order)
        .select("folder", "value").write.partitionBy("folder").text(path)
    )


def _folder(path):
    return F.regexp_extract(path, r"/folder=(\d+)/", 1).cast("int").alias("folder")


def log_file_lines(spark, sf):
    """Logs of all runs, appended to a few large files and read back by lines of files.

    Error lines with their numbers in the file and the place of the run's line.
    """
    path = scratch_dir(spark, "logs")
    rows = line_table(d.run_logs(spark, sf).select("run_id", "content"), ["run_id"]).select(
        (F.col("run_id") % FOLDERS).alias("folder"), "run_id", "line_no", F.col("line").alias("value")
    )
    _written_in_order(rows, ["run_id", "line_no"], path)
    found = readers.read_log_lines(spark, path, "*.txt")
    return found.filter(logs.is_error_line(F.col("line"))).select(_folder("path"), "line_no", "line")


def report_files(spark, sf):
    """Cases of all runs in a few large reports, nested at two depths, read case by case.

    The cases meet their tests by class and method; every eighth report is cut off and
    gives nothing.
    """
    path = scratch_dir(spark, "reports")
    cases = F.regexp_extract_all("xml", F.lit(r"(?s)(<testcase.*?</testcase>)"), F.lit(1))
    run = F.regexp_extract("path", r"/run(\d+)/", 1).cast("long")
    folder = (run % FOLDERS).cast("int")
    def framed(found):
        opening = lambda i: F.when(i == 0, "<testsuite><group>").otherwise("")
        closing = lambda i: F.when(i == F.size(found) - 1, "</group></testsuite>").otherwise("")
        return F.transform(found, lambda x, i: F.concat(opening(i), x, closing(i)))

    # an outer generator: the cases are cut out once, not again in a size filter
    body = d.reports(spark, sf).select(
        folder.alias("folder"), run.alias("run"), F.posexplode_outer(text.let(cases, framed)).alias("place", "value")
    ).filter("value is not null")
    ends = spark.range(FOLDERS).select(
        F.col("id").cast("int").alias("folder"),
        F.explode(F.array(
            F.struct(F.lit(-1).cast("long").alias("run"), F.lit("<testsuites>").alias("value")),
            F.struct(F.lit(1 << 62).alias("run"), F.when(F.col("id") % 8 == 7, "<testsuite>").otherwise("</testsuites>").alias("value")),
        )).alias("e"),
    ).select("folder", "e.run", F.lit(0).alias("place"), "e.value")
    _written_in_order(body.unionByName(ends), ["run", "place"], path)
    read = evidence.case_rows(readers.read_report_cases(spark, path, "*.txt"), ["path"])
    tests = evidence.class_names_of(
        d.run_logs(spark, sf).select("test_id", "test_fqn").distinct()
    ).select("test_id", "class_fqn", "name")
    return evidence.case_failures(tests, read).select(
        "test_id", _folder("path"), "has_error", "has_failure", "message"
    )


def build_file_scan(spark, sf):
    """Build files of all projects read whole: their JDK and the artifacts they name."""
    path = scratch_dir(spark, "builds")
    places = d.table(spark, sf, "customer").join(d.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = places.select(
        F.col("n_nationkey").alias("folder"), F.col("c_custkey").alias("at"),
        F.concat(F.lit("<dependency>\n<artifactId>lib"), F.col("c_custkey") % 50, F.lit("</artifactId>\n</dependency>")).alias("value"),
    )
    nations = d.table(spark, sf, "nation").join(places.select("n_nationkey").distinct(), "n_nationkey", "left_semi")
    jdk = F.when(F.col("n_nationkey") % 3 == 0, "11").when(F.col("n_nationkey") % 3 == 1, "17").otherwise("1.8")
    head = F.concat(F.lit("<project>\n<jdk.version>"), jdk, F.lit("</jdk.version>\n<dependencies>"))
    frame = nations.select(
        F.col("n_nationkey").alias("folder"),
        F.explode(F.array(
            F.struct(F.lit(-1).cast("long").alias("at"), head.alias("value")),
            F.struct(F.lit(1 << 62).alias("at"), F.lit("</dependencies>\n</project>").alias("value")),
        )).alias("e"),
    ).select("folder", "e.at", "e.value")
    _written_in_order(rows.unionByName(frame), ["at"], path)
    files = readers.read_build_files(spark, path, "*.txt")
    url = F.lit("https://host/x")
    known = files.select("path", builds.jdk_of_file(F.col("content"), url, F.lit("x")).alias("jdk"), "content")
    return patches_rows.artifact_rows(known, ["path", "jdk"]).select(_folder("path"), "jdk", "artifact_id")


def _results(spark, sf):
    return _manifest(spark, sf).select(
        names.repo_name(F.col("Project URL")).alias("repo"),
        F.col("SHA Detected").alias("sha"),
        F.col("Test").alias("test_fqn"),
        F.struct(
            F.col("Status").alias("test_code"), F.array("Category", "Module Path").alias("imports"),
            F.lit(None).cast("string").alias("pom"),
        ).alias("final_patch"),
        F.create_map(F.lit("before"), F.col("Module Path")).alias("helpers"),
        names.elapsed_text(F.length("Test") / 8).alias("time"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("started"),
    )


def _result_schema(results):
    return T.StructType(
        [T.StructField(f.name, T.StringType() if f.name == "started" else f.dataType)
         for f in results.schema.fields]
    )


def result_roundtrip(spark, sf):
    """Result documents partitioned by run, repository and revision."""
    results = _results(spark, sf)
    out = scratch_dir(spark, "results")
    sinks.write_results(results, out, "r1")
    schema = _result_schema(results)
    back = sinks.read_results(spark, out, schema)
    return back.select(
        "run_id", "repo", "sha", "test_fqn", F.col("final_patch.test_code").alias("test_code"),
        F.array_join("final_patch.imports", ",").alias("imports"),
        F.col("helpers")["before"].alias("helper"), "time", "started",
    )


def result_update(spark, sf):
    """A tenth of the tests is written again, one in twenty under a new name: the others stay.

    The new documents have a field more; some tests come twice and the later one counts.
    """
    results = _results(spark, sf)
    out = scratch_dir(spark, "results")
    sinks.write_results(results, out, "r1")
    number = F.regexp_extract("test_fqn", r"\d+", 0).cast("long")
    again = results.filter(number % 10 == 3).withColumn("attempt", F.lit(1)).unionByName(
        results.filter(number % 20 == 3).withColumn("attempt", F.lit(2))
    )
    renamed = results.filter(number % 20 == 7).withColumns(
        {"attempt": F.lit(1), "test_fqn": F.concat("test_fqn", F.lit("Again"))}
    )
    update = again.unionByName(renamed).withColumn("time", F.concat(F.lit("again "), "time"))
    sinks.replace_results(update, out, "r1", order=F.col("attempt"))
    schema = _result_schema(results).add("attempt", T.IntegerType())
    return sinks.read_results(spark, out, schema).select(
        "run_id", "repo", "sha", "test_fqn", F.col("final_patch.test_code").alias("test_code"),
        F.array_join("final_patch.imports", ",").alias("imports"), "time", "started", "attempt",
    )


def document_versions(spark, sf):
    """Documents of two versions, read together without a schema.

    The second version names the patch differently, counts attempts and logs them.
    """
    first = _results(spark, sf)
    number = F.regexp_extract("test_fqn", r"\d+", 0).cast("int")
    second = first.select(
        "repo", "sha", "test_fqn", F.lit(2).alias("version"), F.col("final_patch.test_code").alias("patch"),
        F.when(number % 3 == 0, F.array(
            F.struct(F.lit(1).alias("iter"), F.concat(F.lit("p"), number).alias("prompt")),
            F.struct(F.lit(2).alias("iter"), F.lit(None).cast("string").alias("prompt")),
        )).alias("attempts"),
        F.when(number % 2 == 0, number.cast("string")).alias("seconds"),
    )
    out = scratch_dir(spark, "versions")
    sinks.write_results(first, out, "r1")
    sinks.write_results(second, out, "r2")
    doc = F.col("doc")
    return sinks.read_documents(spark, out).select(
        "run_id", "repo", sinks.field(doc, "$.test_fqn").alias("test_fqn"),
        F.coalesce(sinks.field(doc, "$.version", as_type="int"), F.lit(1)).alias("version"),
        sinks.field(doc, "$.patch", "$.final_patch.test_code").alias("patch"),
        F.coalesce(F.size(sinks.field(doc, "$.attempts", as_type="array<variant>")), F.lit(0)).alias("n_attempts"),
        sinks.field(doc, "$.attempts[0].prompt").alias("first_prompt"),
        sinks.field(doc, "$.seconds", as_type="int").alias("seconds"),
    )


def patched_sink(spark, sf):
    docs = d.table(spark, sf, "documents").select(
        F.col("doc_id").alias("path"),
        patches.replace_method(F.col("text"), F.lit("License"), F.lit("Licence")).alias("patched_content"),
    )
    out = scratch_dir(spark, "patched")
    sinks.write_patched(docs, out)
    return spark.read.parquet(out)


_MANIFEST = """SELECT 'https://host/' || lower(n_name) AS project_url, sha1(n_name) AS sha,
lower(c_mktsegment) AS module, 'org.shop.User' || c_custkey || 'Test.check' AS test_fqn, 'NOD' AS category,
CASE WHEN c_custkey % 3 = 0 THEN 'Repo, "Archived"' ELSE '' END AS status, '' AS pr_link, '' AS notes,
lower(n_name) AS repo FROM customer JOIN nation ON c_nationkey = n_nationkey"""

QUERIES = {
    "manifest_scan": (
        manifest_scan,
        f"""SELECT *, sha256(concat_ws(chr(1), project_url, sha, module, test_fqn)) AS test_id FROM (
        SELECT project_url, sha, module, repo, CASE WHEN c_custkey % 7 <> 2 THEN test_fqn END AS test_fqn,
          CASE WHEN c_custkey % 7 <> 2 THEN category END AS category, CASE WHEN c_custkey % 7 <> 2 THEN status END AS status,
          CASE WHEN c_custkey % 7 <> 2 THEN pr_link END AS pr_link, CASE WHEN c_custkey % 7 <> 2 THEN notes END AS notes,
          CASE WHEN c_custkey % 7 = 1 THEN 'extra|y, "z"' END AS surplus
        FROM ({_MANIFEST.replace("lower(n_name) AS repo FROM", "lower(n_name) AS repo, c_custkey FROM")}))""",
    ),
    "module_manifest_scan": (
        module_manifest_scan,
        f"""SELECT project_url, sha, module, repo FROM ({_MANIFEST}) UNION ALL
        SELECT 'https://host/x', test_fqn, '', 'x' FROM ({_MANIFEST})""",
    ),
    "tree_scan": (
        tree_scan,
        "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents",
    ),
    "log_file_lines": (
        log_file_lines,
        f"""WITH l AS (SELECT run_id, CAST(run_id % {FOLDERS} AS INTEGER) AS folder, unnest(string_split(content, chr(10))) AS line,
          unnest(range(len(string_split(content, chr(10))))) AS pos FROM ({d.run_logs_sql()})),
        n AS (SELECT *, CAST(row_number() OVER (PARTITION BY folder ORDER BY run_id, pos) AS INTEGER) AS line_no FROM l)
        SELECT folder, line_no, line FROM n WHERE starts_with(line, '{rules.ERROR_PREFIX}')
          AND NOT ({" OR ".join(f"contains(line, '{x}')" for x in rules.ERROR_NOISE)})""",
    ),
    "report_files": (
        report_files,
        f"""SELECT user_id AS test_id, CAST(event_id % {FOLDERS} AS INTEGER) AS folder, event_id % 4 IN (1, 3) AS has_error,
        event_id % 4 IN (0, 3) AS has_failure, message FROM (
        SELECT event_id, user_id, 'java.lang.Error ' || event_id AS message FROM events WHERE event_id % 4 IN (1, 3)
        UNION ALL SELECT event_id, user_id, 'run ' || event_id || ' failed twice' FROM events WHERE event_id % 4 IN (0, 3))
        WHERE event_id % {FOLDERS} % 8 <> 7""",
    ),
    "build_file_scan": (
        build_file_scan,
        """SELECT DISTINCT n_nationkey AS folder, CASE n_nationkey % 3 WHEN 0 THEN '11' ELSE '8' END AS jdk,
        'lib' || c_custkey % 50 AS artifact_id FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "result_roundtrip": (
        result_roundtrip,
        f"""SELECT 'r1' AS run_id, repo, sha, test_fqn, status AS test_code, 'NOD,' || module AS imports,
        module AS helper, printf('%.2fs', length(test_fqn) / 8.0) AS time, '2024-01-01 00:00:00' AS started
        FROM ({_MANIFEST})""",
    ),
    "result_update": (
        result_update,
        f"""WITH m AS (SELECT *, CAST(regexp_extract(test_fqn, '[0-9]+') AS BIGINT) AS number,
          printf('%.2fs', length(test_fqn) / 8.0) AS took FROM ({_MANIFEST})),
        rows AS (
          SELECT repo, sha, test_fqn, status, module, CASE WHEN number % 10 = 3 THEN 'again ' || took ELSE took END AS took,
            CASE WHEN number % 20 = 3 THEN 2 WHEN number % 10 = 3 THEN 1 END AS attempt FROM m
          UNION ALL SELECT repo, sha, test_fqn || 'Again', status, module, 'again ' || took, 1 FROM m WHERE number % 20 = 7)
        SELECT 'r1' AS run_id, repo, sha, test_fqn, status AS test_code, 'NOD,' || module AS imports, took AS time,
          '2024-01-01 00:00:00' AS started, CAST(attempt AS INTEGER) AS attempt FROM rows""",
    ),
    "document_versions": (
        document_versions,
        f"""WITH m AS (SELECT *, CAST(regexp_extract(test_fqn, '[0-9]+') AS INTEGER) AS number FROM ({_MANIFEST}))
        SELECT 'r1' AS run_id, repo, test_fqn, 1 AS version, status AS patch, 0 AS n_attempts,
          CAST(NULL AS VARCHAR) AS first_prompt, CAST(NULL AS INTEGER) AS seconds FROM m
        UNION ALL SELECT 'r2', repo, test_fqn, 2, status, CASE WHEN number % 3 = 0 THEN 2 ELSE 0 END,
          CASE WHEN number % 3 = 0 THEN 'p' || number END, CASE WHEN number % 2 = 0 THEN number END FROM m""",
    ),
    "patched_sink": (
        patched_sink,
        """SELECT doc_id AS path, replace(text, 'License', chr(10) || 'Licence' || chr(10)) AS patched_content
        FROM documents""",
    ),
}
