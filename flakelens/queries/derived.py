"""Run logs, sources, responses and build files derived from the given tables.

The given tables hold no Java, logs or model answers.  Each row of ``events``,
``customer`` or ``orders`` therefore becomes one text of that kind, built from
the row's own columns: the number of texts grows with the table and no rows are
grouped to make one.  Rows are spread while they are narrow, before each grows
into a text that is expensive to parse.  The same template gives the Spark column and the SQL
expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

TEXT_GROWTH = 60.0  # bytes of derived text for each byte of the table it is made from
_SLOT = re.compile(r"<<(\w+)>>")


def _pieces(template: str) -> list[tuple[bool, str]]:
    out, at = [], 0
    for m in _SLOT.finditer(template):
        if m.start() > at:
            out.append((False, template[at:m.start()]))
        out.append((True, m.group(1)))
        at = m.end()
    if at < len(template):
        out.append((False, template[at:]))
    return out


def spark_text(template: str, slots: dict[str, Column]) -> Column:
    return F.concat(
        *[slots[p].cast("string") if slot else F.lit(p) for slot, p in _pieces(template)]
    )


def sql_text(template: str, slots: dict[str, str]) -> str:
    parts = [
        f"CAST({slots[p]} AS VARCHAR)" if slot else "'" + p.replace("'", "''") + "'"
        for slot, p in _pieces(template)
    ]
    return "(" + " || ".join(parts) + ")"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------------------ run logs
LOGS = {
    "error": (
        "[INFO] Running org.shop.User<<u>>Test\n"
        "[ERROR] Tests run: 1, Failures: 1, Errors: 0, Skipped: 0, Time elapsed: 0.1 s\n"
        "[ERROR] check(org.shop.User<<u>>Test) run <<e>>\n"
        "java.lang.AssertionError: run <<e>>\n"
        "\tat org.junit.Assert.fail(Assert.java:88)\n"
        "\tat org.shop.User<<u>>Test.check(User<<u>>Test.java:<<k>>)\n"
        "\tat org.shop.User<<u>>Test.run(User<<u>>Test.java:28)\n"
        "\tat org.shop.User<<u>>Test.check(User<<u>>Test.java:<<k>>)\n"
        "[ERROR] check(org.shop.User<<u>>Test) run <<e>>\n"
        "[WARNING] There are test failures.\n"
        "Please refer to /work/User<<u>>/run<<e>>/reports for the individual test results.\n"
        "[INFO] BUILD SUCCESS\n"
    ),
    "signup": (
        "[ERROR] There are test failures.\n"
        "\tat org.shop.User<<u>>Test.setUp(User<<u>>Test.java:none)\n"
        "[INFO] BUILD SUCCESS\n"
        "[INFO] No Test Failed with this configuration\n"
    ),
    "purchase": (
        "[INFO] Running org.shop.User<<u>>Test\n"
        "[INFO] BUILD SUCCESS\n"
        "[INFO] No Test Failed with this configuration\n"
    ),
    "click": (
        "[ERROR] COMPILATION ERROR :\n"
        "[ERROR] /work/User<<u>>Test.java:[<<k>>,12] cannot find symbol\n"
        "[INFO] BUILD FAILURE\n"
        "[INFO] Finished at: 2024-01-01T00:00:00Z\n"
        "[ERROR] Failed to execute goal compile -> [Help 1]\n"
        "[ERROR] /work/User<<u>>Test.java:[<<k>>,12] cannot find symbol\n"
        "[ERROR]   symbol: method run<<e>>() -> [Help 1]\n"
        "[ERROR] /work/User<<u>>Test.java:[x,1] bad line\n"
        "[ERROR]   symbol: method run<<e>>()\n"
        "[ERROR] To see the full stack trace of the errors, use -e\n"
        "[ERROR] after the region\n"
    ),
    "view": "Killed by run <<e>>\n",
}
K_SQL = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"
_EVENT_SQL = {"u": "user_id", "e": "event_id", "k": K_SQL}


def event_line() -> Column:
    return F.regexp_extract("props", r"([0-9]+)", 1).try_cast("int")


def run_logs(spark: SparkSession, sf: str) -> DataFrame:
    """``run_id, test_id, test_fqn, path, k, event_type, ts, content``; one log per event."""
    slots = {"u": F.col("user_id"), "e": F.col("event_id"), "k": F.col("k")}
    content = F
    for kind, template in LOGS.items():
        content = content.when(F.col("event_type") == kind, spark_text(template, slots))
    events = table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "ts", event_line().alias("k")
    )
    return spread(events, "event_id", growth=TEXT_GROWTH).select(
        F.col("event_id").alias("run_id"),
        F.col("user_id").alias("test_id"),
        F.concat(F.lit("org.shop.User"), F.col("user_id").cast("string"), F.lit("Test.check"))
        .alias("test_fqn"),
        spark_text(SOURCE_PATH, {"u": F.col("user_id")}).alias("path"),
        "k", "event_type", "ts",
        content.alias("content"),
    )


def run_logs_sql() -> str:
    arms = " ".join(
        f"WHEN '{kind}' THEN {sql_text(template, _EVENT_SQL)}" for kind, template in LOGS.items()
    )
    return (
        f"SELECT event_id AS run_id, user_id AS test_id, {K_SQL} AS k, event_type, ts, "
        f"CASE event_type {arms} END AS content FROM events"
    )


# ------------------------------------------------------------------- reports
_CASE = '<testcase classname="org.shop.User<<u>>Test" name="check" time="0.1">'
_FAILED = '<failure message="run <<e>>   failed&#10; twice " type="java.lang.AssertionError">at x</failure>'
_BROKEN = '<error type="java.lang.Error <<e>>">at y</error>'
_OTHERS = (
    "</testcase>\n"
    '<testcase classname="org.shop.User<<u>>Test" name="other"><failure message="other <<e>>" type="T"/></testcase>\n'
    '<testcase classname="org.shop.Neighbour" name="check"><failure message="n" type="T"/></testcase>\n'
    "</testsuite>\n"
)
_HEAD = '<testsuite name="org.shop.User<<u>>Test">\n' + _CASE
REPORTS = (
    _HEAD + _FAILED + _OTHERS, _HEAD + _BROKEN + _OTHERS, _HEAD + _OTHERS,
    _HEAD + _BROKEN + _FAILED + _OTHERS,
)


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """``path, xml``; one report file per event."""
    slots = {"u": F.col("user_id"), "e": F.col("event_id")}
    xml = F
    for i, template in enumerate(REPORTS):
        xml = xml.when(F.col("event_id") % len(REPORTS) == i, spark_text(template, slots))
    path = "/work/User<<u>>/run<<e>>/reports/sub/TEST-org.shop.User<<u>>Test.xml"
    rows = table(spark, sf, "events").select("user_id", "event_id")
    return spread(rows, "event_id", growth=TEXT_GROWTH).select(
        spark_text(path, slots).alias("path"), xml.alias("xml")
    )


# ------------------------------------------------------------------- sources
SOURCE_PATH = "work/User<<u>>/src/test/java/org/shop/User<<u>>Test.java"
SOURCE = (
    "/* License { for <<seg>> */\n"
    "<<gap>>package org.shop;\n"
    "\n"
    "import java.util.List;\n"
    "import static org.junit.Assert.*;\n"
    "import org.shop.util.<<seg>>;\n"
    "\n"
    "public class User<<u>>Test extends TestCase {\n"
    "    private static final String BRACE = \"}{ <<u>>\";\n"
    "    private int[] sizes = {\n"
    "        1, 2};\n"
    "    private double balance = <<u>>, other;\n"
    "\n"
    "    @Before\n"
    "    public void setUp() {\n"
    "        // open { brace in a comment\n"
    "        balance = 1.0;\n"
    "    }\n"
    "    @After public void tearDown() { sizes = null; }\n"
    "    public User<<u>>Test() {\n"
    "        super(\"x\");\n"
    "    }\n"
    "    @Test(expected = Error.class)\n"
    "    public void check() throws Exception\n"
    "    {\n"
    "        Runnable r = new Runnable() {\n"
    "            public void run() {\n"
    "                log(\"{\");\n"
    "            }\n"
    "        };\n"
    "        if (balance > 0) {\n"
    "            r.run();\n"
    "        }\n"
    "        for (int i = 0; i < sizes.length; i++) { go(i); }\n"
    "    }\n"
    "    public List<String> check(int n) {\n"
    "        char c = '{';\n"
    "        return null;\n"
    "    }\n"
    "    static abstract class Inner {\n"
    "        abstract int size();\n"
    "        private final List<String> names = new ArrayList<>();\n"
    "    }\n"
    "}\n"
)
# (name, start, end) of the template without the gap, which moves lines 2 on
SOURCE_METHODS = (
    ("setUp", 15, 18), ("tearDown", 19, 19), ("<<ctor>>", 20, 22), ("check", 24, 35),
    ("run", 27, 29), ("check", 36, 39), ("size", 41, 41),
)
SOURCE_FIELDS = (("BRACE", 9, 9), ("sizes", 10, 11), ("balance", 12, 12), ("names", 42, 42))
GAP_SQL = "CAST(c_custkey % 7 AS INTEGER)"
_SOURCE_SQL = {"u": "c_custkey", "seg": "c_mktsegment", "gap": f"repeat(chr(10), {GAP_SQL})"}


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """``test_id, path, content``; one Java class per customer."""
    gap = F.repeat(F.lit("\n"), (F.col("c_custkey") % 7).cast("int"))
    slots = {"u": F.col("c_custkey"), "seg": F.col("c_mktsegment"), "gap": gap}
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return spread(rows, "c_custkey", growth=TEXT_GROWTH).select(
        F.col("c_custkey").alias("test_id"),
        spark_text(SOURCE_PATH, slots).alias("path"),
        spark_text(SOURCE, slots).alias("content"),
    )


def sources_sql() -> str:
    return (
        f"SELECT c_custkey AS test_id, {GAP_SQL} AS gap, {sql_text(SOURCE_PATH, _SOURCE_SQL)} AS path, "
        f"{sql_text(SOURCE, _SOURCE_SQL)} AS content FROM customer"
    )


def methods_sql() -> str:
    """Expected spans by construction of the template."""
    rows = ", ".join(f"('{n}', {a}, {b})" for n, a, b in SOURCE_METHODS)
    name = "CASE m.name WHEN '<<ctor>>' THEN 'User' || CAST(s.test_id AS VARCHAR) || 'Test' ELSE m.name END"
    return (
        f"SELECT s.test_id, {name} AS name, CAST(m.a + s.gap AS INTEGER) AS start_line, "
        f"CAST(m.b + s.gap AS INTEGER) AS end_line, s.content FROM ({sources_sql()}) s "
        f"CROSS JOIN (VALUES {rows}) m(name, a, b)"
    )


def slice_sql(content: str, start: str, end: str) -> str:
    """Whole lines of a text that ends with a line break."""
    return (
        f"array_to_string(list_slice(string_split({content}, chr(10)), {start}, {end}), chr(10)) || chr(10)"
    )


# ------------------------------------------------------------- build files
BUILD_FILE = (
    "<project>\n"
    "<properties>\n"
    "<jdk.version><<jdk>></jdk.version>\n"
    "</properties>\n"
    "<dependencies>\n"
    "<dependency>\n"
    "<artifactId>lib<<u>></artifactId>\n"
    "</dependency>\n"
    "</dependencies>\n"
    "</project>\n"
)


def build_files(spark: SparkSession, sf: str) -> DataFrame:
    """``test_id, build_path, build_content``; one build file per customer."""
    key = F.col("c_custkey")
    jdk = (
        F.when(key % 4 == 0, "11").when(key % 4 == 1, "1.8").when(key % 4 == 2, "17").otherwise("")
    )
    return table(spark, sf, "customer").select(
        key.alias("test_id"),
        spark_text("work/User<<u>>/pom.xml", {"u": key}).alias("build_path"),
        spark_text(BUILD_FILE, {"u": key, "jdk": jdk}).alias("build_content"),
    )


def build_files_sql() -> str:
    jdk = "CASE c_custkey % 4 WHEN 0 THEN '11' WHEN 1 THEN '1.8' WHEN 2 THEN '17' ELSE '' END"
    return (
        "SELECT c_custkey AS test_id, "
        f"{sql_text(BUILD_FILE, {'u': 'c_custkey', 'jdk': jdk})} AS build_content FROM customer"
    )


# --------------------------------------------------------------- responses
_DEPS = (
    "\n<dependencies>\n"
    "<dependency>\n<artifactId>new<<o>></artifactId>\n<version>1</version>\n</dependency>\n"
    "<dependency>\n<artifactId>lib<<u>></artifactId>\n</dependency>\n"
    "<dependency>\n<artifactId>mycompany-tests</artifactId>\n</dependency>\n"
    "<dependency>\n<artifactId>new<<o>></artifactId>\n<version>2</version>\n</dependency>\n"
    "</dependencies>\n"
)
_IMPORTS = (
    "import java.util.Map;\n"
    "import  static org.junit.Assume.*;\n"
    "import java.util.List;\n"
    "import java.awt.List;\n"
    "import java.util.Map;\n"
)
_CHECK = "public void check() throws Exception {\n    assertTrue(<<o>> > 0);\n}\n"
RESPONSES = (
    # delimited build block, imports, one method on its own
    "Here it is.\n<!-- <pom.xml start> -->" + _DEPS + "<!-- <pom.xml end> -->\n"
    "//<import start>\n" + _IMPORTS + "//<import end>\n"
    "//<fix start>\n@Test\n" + _CHECK + "//<fix end>\n",
    # second delimiter form, a class around overloads: the last one counts
    "<pom.xml start>" + _DEPS + "<!-- <pom.xml end>\n"
    "```java\npublic class Fixed extends TestCase {\n@Before\npublic void setUp() { x(); }\n"
    "public void check(int n) {\n    if (n > 0) {\n        go();\n    }\n}\n" + _CHECK + "}\n```\n",
    # fenced build block only
    "```xml" + _DEPS + "```\n// no code <<o>>\n",
    # nothing of use
    "I cannot repair test <<o>>.\n",
)


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """``attempt_id, test_id, method_name, response``; one answer per order."""
    slots = {"o": F.col("o_orderkey"), "u": F.col("o_custkey")}
    text = F
    for i, template in enumerate(RESPONSES):
        text = text.when(F.col("o_orderkey") % len(RESPONSES) == i, spark_text(template, slots))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return spread(rows, "o_orderkey", growth=TEXT_GROWTH).select(
        F.col("o_orderkey").alias("attempt_id"),
        F.col("o_custkey").alias("test_id"),
        F.lit("check").alias("method_name"),
        text.alias("response"),
    )


def response_part_sql(templates: list[str | None]) -> str:
    """CASE over the response styles with one template, or null, per style."""
    slots = {"o": "o_orderkey", "u": "o_custkey"}
    arms = " ".join(
        f"WHEN {i} THEN {sql_text(t, slots) if t is not None else 'NULL'}"
        for i, t in enumerate(templates)
    )
    return f"CASE o_orderkey % {len(templates)} {arms} END"


PATCH_CODE = [_CHECK, _CHECK, None, None]
PATCH_POM = [_DEPS, _DEPS, _DEPS, None]
PATCH_IMPORTS = ["import java.util.Map;|import static org.junit.Assume.*;", None, None, None]
NEW_FRAGMENT = "<dependency>\n\n<artifactId>new<<o>></artifactId>\n<version>1</version>\n</dependency>"
