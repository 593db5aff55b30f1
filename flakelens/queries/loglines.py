"""Log mining over line tables and whole logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import builds, logs, text
from ..functions import fqn as names
from ..operators import lines, patches
from . import derived as d

LICENSES = (("APACHE", ("Apache License",)), ("MIT", ("MIT License",)))


def _documents(spark, sf):
    return d.table(spark, sf, "documents")


def log_lines(spark, sf):
    return lines.line_table(_documents(spark, sf), ["doc_id"], "text")


def ordered_distinct_lines(spark, sf):
    return lines.first_occurrences(log_lines(spark, sf), ["doc_id"])


def joined_distinct_lines(spark, sf):
    docs = _documents(spark, sf).withColumn(
        "extra", F.concat_ws("\n", F.substring_index("text", "\n", 1), "source", "lang", "source")
    )
    return lines.joined_lines(docs, ["doc_id"], "text", "extra")


def text_verdict(spark, sf):
    return _documents(spark, sf).select(
        "doc_id", logs.verdict(F.col("text"), LICENSES).alias("verdict")
    )


def line_verdict(spark, sf):
    return lines.verdict_by_lines(log_lines(spark, sf), ["doc_id"], verdict_rules=LICENSES)


def run_verdict(spark, sf):
    return d.run_logs(spark, sf).select("run_id", logs.verdict(F.col("content")).alias("verdict"))


def noise_filtered_lines(spark, sf):
    found = lines.error_line_rows(log_lines(spark, sf), prefix="The", noise=("and", "that", "of "))
    return found.select("doc_id", "line_no", "line")


def error_lines(spark, sf):
    return d.run_logs(spark, sf).select(
        "run_id", F.array_join(logs.error_lines(F.col("content")), "|").alias("messages")
    )


def error_lines_region(spark, sf):
    return d.table(spark, sf, "pages").select(
        "page_id",
        text.region_between(F.col("html"), "<article>", "</article>", ("<b>", "<br>")).alias("region"),
    )


def compile_messages(spark, sf):
    """Compile failures only: their route uses the closing region of the log."""
    content = F.col("content")
    return d.run_logs(spark, sf).filter(logs.is_compile_failure(content)).select(
        "run_id",
        text.joined(
            logs.compile_messages(content, names.class_file(F.col("test_fqn")))
        ).alias("messages"),
    )


def safe_line_number(spark, sf):
    table = lines.line_table(d.run_logs(spark, sf), ["run_id", "test_fqn"])
    return table.withColumn(
        "number", logs.line_number(F.col("line"), names.class_file(F.col("test_fqn")))
    ).filter("number is not null").select("run_id", "line_no", "number")


def frame_names(spark, sf):
    """Methods and lines of the stack frames inside the test class."""
    content, owner = F.col("content"), names.class_fqn(F.col("test_fqn"))
    return d.run_logs(spark, sf).select(
        "run_id",
        F.array_join(logs.frame_methods(content, owner), ",").alias("methods"),
        F.array_join(logs.frame_lines(content, owner).cast("array<string>"), ",").alias("numbers"),
    )


def build_lines(spark, sf):
    table = lines.line_table(d.run_logs(spark, sf), ["run_id", "test_id"])
    return lines.build_outcome_lines(table).select(
        "run_id", "line_no", F.concat_ws(" ", "test_id", "line").alias("result")
    )


def build_results(spark, sf):
    return lines.build_results(d.run_logs(spark, sf), ["run_id", "test_id"])


def jdk_class(spark, sf):
    """JDK per brand from the lines of its parts; some brands are on the lists."""
    part = d.table(spark, sf, "part")
    project = (
        F.when(F.col("p_brand") == "Brand#1", "cloudstack").otherwise(F.col("p_brand"))
    )
    table = part.select(
        F.when(F.col("p_brand") == "Brand#2", "https://github.com/INRIA/spoon")
        .otherwise(F.concat(F.lit("https://host/"), "p_brand")).alias("project_url"),
        project.alias("project"),
        F.when(
            (F.col("p_size") > 10) & ~F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"),
            F.concat(F.lit("<jdk.version>1."), F.col("p_partkey") % 10, F.lit("</jdk.version>")),
        ).otherwise(F.concat(F.lit("<version>"), "p_partkey", F.lit("</version>"))).alias("line"),
    )
    return patches.jdk_by_project(table, ["project_url", "project"])


def jdk_of_build_file(spark, sf):
    path = F.concat(F.lit("https://host/p"), "test_id")
    return d.build_files(spark, sf).select(
        "test_id", builds.jdk_of_file(F.col("build_content"), path, F.lit("p")).alias("jdk")
    )


def merge_update(spark, sf):
    base = _documents(spark, sf).select(
        "doc_id", "source", F.lit(-1).alias("quality"), (F.col("n_chars") % 2).cast("int").alias("odd")
    )
    labels = d.table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("toxic") == 0, F.col("quality")).alias("quality"), "toxic"
    )
    return lines.merge_update(base, labels, ["doc_id"])


def merge_updates(spark, sf):
    """Many updates of a customer, later ones over earlier ones, null values aside."""
    base = d.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("event_type"), F.lit("none").alias("props")
    )
    kind = F.col("event_type")
    updates = d.table(spark, sf, "events").select(
        "user_id", "ts", "event_id", F.when(kind != "view", kind).alias("event_type"),
        F.when(kind == "error", F.col("props")).alias("props"), F.when(F.col("value") > 20, F.col("value")).alias("value"),
    )
    return lines.merge_update(base, updates, ["user_id"], ["ts", "event_id"])


def first_wins(spark, sf):
    return lines.first_wins(
        d.table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value", "props"
    )


def last_wins(spark, sf):
    return lines.last_wins(
        d.table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value", "props"
    )


_LINE_TABLE = """SELECT {k}, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_no, unnest(l) AS line
FROM (SELECT {k}, string_split({c}, chr(10)) AS l FROM {t})"""
DOC_LINES = _LINE_TABLE.format(k="doc_id", c="text", t="documents")
_DISTINCT = f"SELECT doc_id, line, min(line_no) AS line_no FROM ({DOC_LINES}) GROUP BY doc_id, line"
_EXTRA = """string_split(text, chr(10))[1] || chr(10) || source || chr(10) || lang"""
_VERDICT = """SELECT doc_id, CASE WHEN contains(text, 'Apache License') THEN 'APACHE'
WHEN contains(text, 'MIT License') THEN 'MIT' ELSE 'UNRECOGNIZED' END AS verdict FROM documents"""
_LOGS = f"({d.run_logs_sql()})"
_RUN_LINES = _LINE_TABLE.format(k="run_id, test_id", c="content", t=_LOGS)
_U, _E = "CAST(user_id AS VARCHAR)", "CAST(event_id AS VARCHAR)"

QUERIES = {
    "log_lines": (log_lines, DOC_LINES),
    "ordered_distinct_lines": (ordered_distinct_lines, _DISTINCT),
    "joined_distinct_lines": (
        joined_distinct_lines,
        f"""SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS joined FROM (
        SELECT doc_id, line, min(line_no) AS line_no FROM ({_LINE_TABLE.format(
            k="doc_id", c=f"text || chr(10) || {_EXTRA}", t="documents")}) GROUP BY doc_id, line)
        GROUP BY doc_id""",
    ),
    "text_verdict": (text_verdict, _VERDICT),
    "line_verdict": (line_verdict, _VERDICT),
    "run_verdict": (
        run_verdict,
        """SELECT event_id AS run_id, CASE event_type WHEN 'error' THEN 'FAILURE' WHEN 'signup' THEN 'FAILURE'
        WHEN 'purchase' THEN 'PASS' WHEN 'click' THEN 'COMPILATION_ERROR' ELSE 'UNRECOGNIZED' END AS verdict
        FROM events""",
    ),
    "noise_filtered_lines": (
        noise_filtered_lines,
        f"""SELECT doc_id, line_no, trim(replace(line, 'The', '')) AS line FROM ({DOC_LINES})
        WHERE starts_with(line, 'The') AND NOT contains(line, 'and') AND NOT contains(line, 'that')
        AND NOT contains(line, 'of ')""",
    ),
    "error_lines": (
        error_lines,
        f"""SELECT event_id AS run_id, CASE event_type
        WHEN 'error' THEN 'check(org.shop.User' || {_U} || 'Test) run ' || {_E}
        WHEN 'click' THEN 'COMPILATION ERROR :|/work/User' || {_U} || 'Test.java:[' || {d.K_SQL}
          || ',12] cannot find symbol|symbol: method run' || {_E} || '() -> [Help 1]|/work/User' || {_U}
          || 'Test.java:[x,1] bad line|symbol: method run' || {_E}
          || '()|To see the full stack trace of the errors, use -e|after the region'
        ELSE '' END AS messages FROM events""",
    ),
    "error_lines_region": (
        error_lines_region,
        """SELECT page_id, replace(replace(string_split(string_split(html, '<article>')[-1],
        '</article>')[1], '<b>', ''), '<br>', '') AS region FROM pages""",
    ),
    "compile_messages": (
        compile_messages,
        f"""SELECT event_id AS run_id, ' cannot find symbol' || chr(10) || 'symbol: method run' || {_E}
        || '()' || chr(10) || ' bad line' || chr(10) AS messages FROM events WHERE event_type = 'click'""",
    ),
    "safe_line_number": (
        safe_line_number,
        f"""SELECT event_id AS run_id, p.line_no, coalesce(p.n, {d.K_SQL}) AS number
        FROM events JOIN (VALUES ('error', 6, NULL), ('error', 7, 28), ('error', 8, NULL),
        ('click', 2, NULL), ('click', 6, NULL)) p(kind, line_no, n) ON event_type = p.kind""",
    ),
    "frame_names": (
        frame_names,
        f"""SELECT event_id AS run_id,
        CASE event_type WHEN 'error' THEN 'check,run' WHEN 'signup' THEN 'setUp' ELSE '' END AS methods,
        CASE WHEN event_type <> 'error' THEN '' WHEN {d.K_SQL} = 28 THEN '28'
        ELSE {d.K_SQL} || ',28' END AS numbers FROM events""",
    ),
    "build_lines": (
        build_lines,
        f"""SELECT run_id, line_no, CAST(test_id AS VARCHAR) || ' ' || line AS result
        FROM ({_RUN_LINES}) WHERE contains(line, 'BUILD ')""",
    ),
    "build_results": (
        build_results,
        """SELECT event_id AS run_id, user_id AS test_id, 'build-result: ' || event_id || ' ' || user_id
        || CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN ' [INFO] BUILD FAILURE'
          ELSE ' [INFO] BUILD SUCCESS' END AS build_result FROM events""",
    ),
    "jdk_class": (
        jdk_class,
        """SELECT CASE p_brand WHEN 'Brand#2' THEN 'https://github.com/INRIA/spoon'
          ELSE 'https://host/' || p_brand END AS project_url,
        CASE p_brand WHEN 'Brand#1' THEN 'cloudstack' ELSE p_brand END AS project,
        CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN '11'
          WHEN bool_or(p_brand <> 'Brand#3' AND p_size > 10 AND p_partkey % 10 = 11) THEN '11'
          ELSE '8' END AS jdk FROM part GROUP BY p_brand""",
    ),
    "jdk_of_build_file": (
        jdk_of_build_file,
        """SELECT c_custkey AS test_id, CASE c_custkey % 4 WHEN 0 THEN '11' ELSE '8' END AS jdk
        FROM customer""",
    ),
    "merge_update": (
        merge_update,
        """SELECT d.doc_id, d.source, coalesce(CASE WHEN toxic = 0 THEN quality END, -1) AS quality,
        CAST(n_chars % 2 AS INTEGER) AS odd, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "merge_updates": (
        merge_updates,
        """SELECT c_custkey AS user_id, coalesce(u.event_type, c_mktsegment) AS event_type, coalesce(u.props, 'none') AS props, u.value
        FROM customer LEFT JOIN (SELECT user_id,
          arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type <> 'view') AS event_type,
          arg_max(props, (ts, event_id)) FILTER (WHERE event_type = 'error' AND props IS NOT NULL) AS props,
          arg_max(value, (ts, event_id)) FILTER (WHERE value > 20) AS value
          FROM events GROUP BY user_id) u ON u.user_id = c_custkey""",
    ),
    "first_wins": (
        first_wins,
        """SELECT user_id, event_type, value, props FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
    ),
    "last_wins": (
        last_wins,
        """SELECT user_id, event_type, value, props FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    ),
}
