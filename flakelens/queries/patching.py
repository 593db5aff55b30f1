"""Imports, dependencies, responses and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import builds, responses
from ..functions.text import let
from ..operators import patches
from . import derived as d

HREF = r'href="([^"]*)"'


def import_list(spark, sf):
    """Import statements of the sources in row form."""
    return patches.import_rows(d.sources(spark, sf), ["test_id"], "content")


def link_list(spark, sf):
    """The same extraction with links of web pages in place of imports."""
    found = F.regexp_extract_all("html", F.lit(HREF), F.lit(1))
    rows = d.table(spark, sf, "pages").select(
        "page_id", F.posexplode_outer(found).alias("pos", "link")
    )
    return rows.filter("link is not null").select(
        "page_id", (F.col("pos") + 1).alias("link_no"), "link"
    )


def new_imports(spark, sf):
    """Imports of each answer against those of the test's source, with conflict flag."""
    wanted = patches.import_rows(
        d.responses(spark, sf), ["attempt_id", "test_id"], "response"
    ).groupBy("attempt_id", "test_id", "statement", "short_name").agg(
        F.min("import_no").alias("import_no")
    )
    originals = patches.import_rows(d.sources(spark, sf), ["test_id"], "content")
    return patches.new_import_rows(wanted, originals, ["test_id"]).select(
        "attempt_id", "statement", "short_name", "import_no", "is_new", "is_conflict"
    )


def new_links(spark, sf):
    """Links of a page that the page before it lacks; clash on the last segment."""
    links = link_list(spark, sf).groupBy("page_id", "link").agg(F.min("link_no").alias("link_no"))
    links = links.withColumn("short", F.substring_index("link", "/", -1))
    before = links.select((F.col("page_id") + 1).alias("page_id"), "link", "short")
    return patches.new_import_rows(
        links, before, ["page_id"], statement="link", short="short", wildcard_clash=True
    )


def dependency_list(spark, sf):
    """Dependency fragments each answer asks for."""
    poms = d.responses(spark, sf).select(
        "attempt_id", responses.build_block(F.col("response")).alias("pom")
    )
    return patches.dependency_rows(poms, ["attempt_id"])


def missing_dependencies(spark, sf):
    """Anti join of the wanted artifacts with those of the build file."""
    poms = d.responses(spark, sf).select(
        "attempt_id", "test_id", responses.build_block(F.col("response")).alias("pom")
    )
    wanted = patches.dependency_rows(poms, ["attempt_id", "test_id"])
    present = patches.artifact_rows(d.build_files(spark, sf), ["test_id"], "build_content")
    return patches.missing_dependency_rows(wanted, present, ["test_id"], ["attempt_id"]).select(
        "attempt_id", "artifact_id", "n_asked"
    )


def list_patch(spark, sf):
    """Insert an item after every list start of a page."""
    added = F.array(F.concat(F.lit("<li>"), "url", F.lit("</li>")))
    html = F.replace(F.col("html"), F.lit("<ul>"), F.lit("\n<ul>\n"))
    return d.table(spark, sf, "pages").select(
        "page_id", builds.insert_after(html, "<ul>", added).alias("patched")
    )


def response_regions(spark, sf):
    """Balanced code regions of each answer, by the per-row fold."""
    cut = let(
        responses.plain_lines(F.col("response")),
        lambda ls: let(
            responses.regions(ls),
            lambda r: F.struct(
                F.array_join(
                    F.transform(r["regions"], lambda x: responses.region_text(ls, x)), "\n--\n"
                ).alias("code"),
                F.size(r["regions"]).alias("n_regions"),
                r["negative"].alias("is_negative"),
            ),
        ),
    )
    return d.responses(spark, sf).select("attempt_id", cut.alias("r")).select("attempt_id", "r.*")


def _tests(spark, sf):
    tests = d.sources(spark, sf).withColumn("method_name", F.lit("check"))
    return patches.prepare_tests(tests)


def response_patch(spark, sf):
    parsed = patches.parse_responses(d.responses(spark, sf), _tests(spark, sf))
    return parsed.select(
        "attempt_id",
        F.col("patch.test_code").alias("test_code"),
        F.array_join("patch.imports", "|").alias("imports"),
        F.col("patch.pom").alias("pom"),
    )


def text_patch(spark, sf):
    """Answers parsed, applied to source and build file of their test."""
    builds_ = d.build_files(spark, sf).select("test_id", "build_content")
    tests = _tests(spark, sf).join(builds_, "test_id")
    parsed = patches.parse_responses(d.responses(spark, sf), tests)
    done = patches.apply_patches(parsed, tests.drop("original_imports"), build="build_content")
    paths = done.withColumn("path", d.spark_text(d.SOURCE_PATH, {"u": F.col("test_id")}))
    return patches.build_paths(paths).select(
        "attempt_id", "build_path", "patched_content", "patched_build"
    )


_LINKS = """SELECT page_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS link_no, unnest(l) AS link
FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)"""
_FIRST_LINKS = f"""SELECT page_id, link, min(link_no) AS link_no, regexp_extract(link, '[^/]*$') AS short
FROM ({_LINKS}) GROUP BY page_id, link"""
_SOURCE_IMPORTS = "(VALUES (1, 'import java.util.List;', '.List;'), (2, 'import static org.junit.Assert.*;', '.*;'))"
_POM = d.response_part_sql(d.PATCH_POM)
_CODE = d.response_part_sql(d.PATCH_CODE)
_IMPORTS = f"coalesce({d.response_part_sql(d.PATCH_IMPORTS)}, '')"
_FRAGMENT = d.sql_text(d.NEW_FRAGMENT, {"o": "o_orderkey"})
# style 1 has the closing brace of a class whose header line does not count
_REGIONS = [
    "@Test\n" + d._CHECK.rstrip("\n"),
    "@Before\npublic void setUp() { x(); }\n--\n"
    "public void check(int n) {\n    if (n > 0) {\n        go();\n    }\n}\n--\n" + d._CHECK.rstrip("\n"),
    None, None,
]

QUERIES = {
    "import_list": (
        import_list,
        f"""SELECT test_id, CAST(i.n AS INTEGER) AS import_no, i.s AS statement, i.short AS short_name
        FROM ({d.sources_sql()}) CROSS JOIN {_SOURCE_IMPORTS} i(n, s, short)
        UNION ALL SELECT c_custkey, 3, 'import org.shop.util.' || c_mktsegment || ';', '.' || c_mktsegment || ';'
        FROM customer""",
    ),
    "link_list": (link_list, _LINKS),
    "new_imports": (
        new_imports,
        """SELECT o_orderkey AS attempt_id, statement, short_name, CAST(n AS INTEGER) AS import_no, is_new, is_conflict
        FROM orders CROSS JOIN (VALUES (1, 'import java.util.Map;', '.Map;', true, false),
        (2, 'import static org.junit.Assume.*;', '.*;', true, false),
        (3, 'import java.util.List;', '.List;', false, false),
        (4, 'import java.awt.List;', '.List;', false, true)) i(n, statement, short_name, is_new, is_conflict)
        WHERE o_orderkey % 4 = 0""",
    ),
    "new_links": (
        new_links,
        f"""SELECT page_id, link, link_no, short, NOT seen AND NOT bound AS is_new, NOT seen AND bound AS is_conflict
        FROM (SELECT a.*, EXISTS (SELECT 1 FROM ({_FIRST_LINKS}) b WHERE b.page_id = a.page_id - 1
            AND b.link = a.link) AS seen,
          EXISTS (SELECT 1 FROM ({_FIRST_LINKS}) b WHERE b.page_id = a.page_id - 1
            AND b.short = a.short) AS bound FROM ({_FIRST_LINKS}) a)""",
    ),
    "dependency_list": (
        dependency_list,
        f"""SELECT o_orderkey AS attempt_id, replace(replace(f.a, '<<o>>', CAST(o_orderkey AS VARCHAR)),
          '<<u>>', CAST(o_custkey AS VARCHAR)) AS artifact_id,
        '<dependency>' || chr(10) || chr(10) || '<artifactId>'
          || replace(replace(f.a, '<<o>>', CAST(o_orderkey AS VARCHAR)), '<<u>>', CAST(o_custkey AS VARCHAR))
          || '</artifactId>' || chr(10) || f.v || '</dependency>' || chr(10) AS xml,
        f.p AS is_placeholder
        FROM orders CROSS JOIN (VALUES ('new<<o>>', '<version>1</version>' || chr(10), false), ('lib<<u>>', '', false),
        ('mycompany-tests', '', true), ('new<<o>>', '<version>2</version>' || chr(10), false)) f(a, v, p)
        WHERE o_orderkey % 4 < 3""",
    ),
    "missing_dependencies": (
        missing_dependencies,
        """SELECT o_orderkey AS attempt_id, 'new' || o_orderkey AS artifact_id, CAST(2 AS BIGINT) AS n_asked
        FROM orders WHERE o_orderkey % 4 < 3""",
    ),
    "list_patch": (
        list_patch,
        """SELECT page_id, replace(html, '<ul>', chr(10) || '<ul>' || chr(10) || '<li>' || url || '</li>'
        || chr(10)) AS patched FROM pages""",
    ),
    "response_regions": (
        response_regions,
        f"""SELECT o_orderkey AS attempt_id, coalesce({d.response_part_sql(_REGIONS)}, '') AS code,
        CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 0 END AS n_regions, o_orderkey % 4 = 1 AS is_negative
        FROM orders""",
    ),
    "response_patch": (
        response_patch,
        f"""SELECT o_orderkey AS attempt_id, {_CODE} AS test_code, {_IMPORTS} AS imports, {_POM} AS pom
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    ),
    "text_patch": (
        text_patch,
        f"""SELECT o_orderkey AS attempt_id, 'work/User' || o_custkey || '/pom.xml' AS build_path,
        CASE WHEN o_orderkey % 4 = 0 THEN replace(code, 'package org.shop;', chr(10) || 'package org.shop;' || chr(10)
          || replace({_IMPORTS}, '|', chr(10)) || chr(10)) ELSE code END AS patched_content,
        CASE WHEN o_orderkey % 4 < 3 THEN replace(build_content, '<dependencies>' || chr(10),
          '<dependencies>' || chr(10) || {_FRAGMENT} || chr(10)) ELSE build_content END AS patched_build
        FROM (SELECT o.*, CASE WHEN o_orderkey % 4 < 2 THEN replace(content,
            {d.slice_sql('content', 'gap + 36', 'gap + 39')}, chr(10) || {_CODE} || chr(10))
            ELSE content END AS code, build_content
          FROM orders o JOIN ({d.sources_sql()}) s ON s.test_id = o_custkey
          JOIN ({d.build_files_sql()}) b ON b.test_id = o_custkey)""",
    ),
}
