"""Names, paths and text helpers over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fqn as names
from ..functions import javacode, prompts, responses, text
from ..operators import scans
from . import derived as d


def project_name(spark, sf):
    return d.table(spark, sf, "pages").select(
        "page_id", "url", names.repo_name(F.col("url")).alias("project")
    )


def _tests(spark, sf):
    customer = d.table(spark, sf, "customer")
    nation = d.table(spark, sf, "nation")
    region = d.table(spark, sf, "region")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("fqn", F.concat_ws(".", "r_name", "n_name", "c_name"))
    )


_TESTS_SQL = """
  SELECT c.*, n.n_name, r.r_name, r.r_name || '.' || n.n_name || '.' || c.c_name AS fqn
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey"""


def fqn_parts(spark, sf):
    fqn = F.col("fqn")
    return _tests(spark, sf).select(
        "c_custkey", "fqn",
        names.method_name(fqn).alias("method_name"),
        names.short_class(fqn).alias("short_class"),
        names.class_path(fqn).alias("class_path"),
        names.class_fqn(fqn).alias("class_fqn"),
    )


def replace_last(spark, sf):
    url = F.col("url")
    return d.table(spark, sf, "pages").select(
        "page_id",
        text.replace_last(url, "/", "#").alias("last_slash"),
        text.replace_last(url, "?", "&").alias("last_query"),
    )


def result_paths(spark, sf):
    url = F.col("url")
    repo = names.repo_name(url)
    sha = F.sha1(url)
    return d.table(spark, sf, "pages").select(
        "page_id",
        names.repo_path(F.lit("clone"), sha, repo).alias("repo_path"),
        names.result_path(F.lit("out"), repo, sha, F.lit("a.B.c")).alias("result_path"),
        names.build_path(url, marker="/en/").alias("build_path"),
    )


def message_normalize(spark, sf):
    return d.table(spark, sf, "documents").select(
        "doc_id",
        text.normalize_message(
            F.when(F.col("lang") != "de", F.col("text")), F.concat(F.lit(" type\t"), "source")
        ).alias("message"),
    )


def span_slice(spark, sf):
    return d.table(spark, sf, "documents").select(
        "doc_id", text.span_slice(F.col("text"), F.lit(2), F.lit(4)).alias("span")
    )


def open_span(spark, sf):
    found = javacode.methods(F.col("content"))
    last = F.element_at(found, -3)["start"]["line"]
    return d.sources(spark, sf).select(
        "test_id", text.span_slice(F.col("content"), last, F.lit(None).cast("int")).alias("span")
    )


def header_strip(spark, sf):
    return d.table(spark, sf, "documents").select(
        "doc_id", javacode.without_header(F.col("text"), "License").alias("body")
    )


def clean_text(spark, sf):
    content = F.col("content")
    return d.sources(spark, sf).select(
        "test_id",
        javacode.package_statement(content).alias("package"),
        F.array_join(javacode.import_lines(content), "|").alias("imports"),
        javacode.clean_code(content).alias("clean"),
    )


def fence_normalize(spark, sf):
    marks = ("<p>", "</p>", "<li>", "</li>")
    return d.table(spark, sf, "pages").select(
        "page_id", F.posexplode(responses.plain_lines(F.col("html"), marks)).alias("line_no", "line")
    )


def block_precedence(spark, sf):
    marks = (("<script>", "</script>"), ("<style>", "</style>"))
    html = F.col("html")
    lines = F.when(F.col("page_id") % 2 == 0, html).otherwise(
        F.replace(html, F.lit("</script>"), F.lit(""))
    )
    return d.table(spark, sf, "pages").select(
        "page_id", text.drop_all(text.delimited_block(lines, marks), ("{", "}")).alias("block")
    )


def prompt_assembly(spark, sf):
    """Each turn is an attempt that sees the turn before it as its evidence.

    The turn before is found by a chunked scan, so a conversation of any length
    is spread over tasks.
    """
    talk = d.table(spark, sf, "conversations")
    seen = scans.last_known(
        talk, ["conv_id"], ["turn"], F.floor(F.col("turn") / 10_000),
        {"previous": F.col("text")}, include_current=False,
    )
    evidence = prompts.evidence_for(F.col("turn"), F.lit("initial failure"), F.col("previous"))
    return seen.select(
        "conv_id", "turn",
        prompts.prompt(
            F.col("role"),
            F.concat_ws("\n", F.nullif(F.col("role"), F.lit("user")), F.col("text")),
            evidence, F.lit("code"), F.array(F.lit("a"), F.lit("b")),
            template="Fix %1$s:\n%2$s\nError:\n%3$s\nat '%4$s' in %5$s.",
        ).alias("prompt"),
    )


def run_ids(spark, sf):
    return d.table(spark, sf, "orders").select(
        "o_orderkey",
        names.run_id(F.col("o_orderdate")).alias("run_id"),
        names.test_id(F.col("o_custkey").cast("string"), F.col("o_orderstatus")).alias("test_id"),
    )


_LINES = "string_split(text, chr(10))"
_AFTER = "substring({t}, strpos({t}, '{a}') + {n}, length({t}))"


def _between(t: str, a: str, b: str) -> str:
    return f"string_split({_AFTER.format(t=t, a=a, n=len(a))}, '{b}')[1]"


_ALT = "CASE WHEN page_id % 2 = 0 THEN html ELSE replace(html, '</script>', '') END"

QUERIES = {
    "project_name": (
        project_name,
        "SELECT page_id, url, regexp_extract(url, '[^/]*$') AS project FROM pages",
    ),
    "fqn_parts": (
        fqn_parts,
        f"""SELECT c_custkey, fqn, c_name AS method_name, n_name AS short_class,
        r_name || '/' || n_name AS class_path, r_name || '.' || n_name AS class_fqn
        FROM ({_TESTS_SQL})""",
    ),
    "replace_last": (
        replace_last,
        r"""SELECT page_id, regexp_replace(url, '/([^/]*)$', '#\1') AS last_slash,
        CASE WHEN contains(url, '?') THEN regexp_replace(url, '\?([^?]*)$', '&\1')
             ELSE '&' || url END AS last_query FROM pages""",
    ),
    "result_paths": (
        result_paths,
        """SELECT page_id, 'clone/' || sha1(url) || '/' || repo AS repo_path,
        'out/' || repo || '/' || sha1(url) || '/a.B.c.json' AS result_path,
        CASE WHEN contains(url, '/en/') THEN string_split(url, '/en/')[1] || '/pom.xml' END AS build_path
        FROM (SELECT page_id, url, regexp_extract(url, '[^/]*$') AS repo FROM pages)""",
    ),
    "message_normalize": (
        message_normalize,
        r"""SELECT doc_id, trim(regexp_replace(
        CASE WHEN lang <> 'de' THEN text ELSE ' type' || chr(9) || source END, '\s+', ' ', 'g'))
        AS message FROM documents""",
    ),
    "span_slice": (
        span_slice,
        f"""SELECT doc_id, CASE WHEN len(l) < 2 THEN ''
        WHEN len(l) <= 4 THEN array_to_string(l[2:4], chr(10))
        ELSE array_to_string(l[2:4], chr(10)) || chr(10) END AS span
        FROM (SELECT doc_id, {_LINES} AS l FROM documents)""",
    ),
    "open_span": (
        open_span,
        # from the third last method to the end, cut before the last brace
        f"SELECT test_id, rtrim(rtrim({d.slice_sql('content', 'gap + 27', 'gap + 44')}, chr(10)), '}}') "
        f"AS span FROM ({d.sources_sql()})",
    ),
    "header_strip": (
        header_strip,
        """SELECT doc_id, CASE WHEN strpos(text, 'License') > 1
        THEN replace(text, substring(text, 1, strpos(text, 'License') - 1), '')
        ELSE text END AS body FROM documents""",
    ),
    "clean_text": (
        clean_text,
        f"""SELECT test_id, 'package org.shop;' AS package,
        array_to_string(list_filter(l, lambda x: starts_with(x, 'import ')), '|') AS imports,
        array_to_string(list_filter(l[(gap + 2):], lambda x: NOT starts_with(x, 'import ')), chr(10)) AS clean
        FROM (SELECT test_id, gap, string_split(content, chr(10)) AS l FROM ({d.sources_sql()}))""",
    ),
    "fence_normalize": (
        fence_normalize,
        """SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, unnest(l) AS line
        FROM (SELECT page_id, string_split(replace(replace(replace(replace(html,
        '<p>', chr(10)), '</p>', chr(10)), '<li>', chr(10)), '</li>', chr(10)), chr(10)) AS l FROM pages)""",
    ),
    "block_precedence": (
        block_precedence,
        f"""SELECT page_id, replace(replace(CASE
        WHEN contains(h, '<script>') AND contains(h, '</script>') THEN {_between('h', '<script>', '</script>')}
        WHEN contains(h, '<style>') AND contains(h, '</style>') THEN {_between('h', '<style>', '</style>')}
        END, '{{', ''), '}}', '') AS block FROM (SELECT page_id, {_ALT} AS h FROM pages)""",
    ),
    "prompt_assembly": (
        prompt_assembly,
        """SELECT conv_id, turn, 'Fix ' || role || ':' || chr(10)
        || CASE WHEN role = 'user' THEN '' ELSE role || chr(10) END || text || chr(10) || 'Error:' || chr(10)
        || CASE WHEN turn = 0 THEN 'initial failure' ELSE coalesce(
             lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 'initial failure') END
        || chr(10) || 'at ''code'' in a, b.' AS prompt FROM conversations""",
    ),
    "run_ids": (
        run_ids,
        """SELECT o_orderkey, sha1(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')) AS run_id,
        sha256(CAST(o_custkey AS VARCHAR) || chr(1) || o_orderstatus) AS test_id FROM orders""",
    ),
}
