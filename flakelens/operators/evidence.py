"""Error evidence: source lines, reports, enclosing methods, bundles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules, schemas
from ..functions import fqn as names
from ..functions import logs, text
from ..session import stored
from .lines import first_occurrences, generate


def line_lookup(requests: DataFrame, sources: DataFrame, keys: Sequence[str],
                line: str = "line_no", content: str = "content") -> DataFrame:
    """Distinct requested lines with their trimmed source text, null outside.

    The numbers of a file are listed first (at most one for each of its lines), so a
    source moves once, whole, and only the requested lines leave it.
    """
    numbers = requests.select(*keys, line).distinct().groupBy(*keys).agg(
        F.collect_list(line).alias("_numbers")
    )
    # texts are large whatever the planner estimates: no broadcast of them
    joined = numbers.join(sources.select(*keys, content).hint("merge"), list(keys), "left")
    found = text.let(
        text.lines(F.col(content)),
        lambda all_lines: F.transform(
            "_numbers", lambda n: F.struct(n.alias(line), text.line_at(all_lines, n).alias("line"))
        ),
    )
    none = F.transform("_numbers", lambda n: F.struct(n.alias(line), F.lit(None).cast("string").alias("line")))
    return joined.select(*keys, F.inline(F.coalesce(found, none)))


def enclosing_methods(points: DataFrame, methods: DataFrame, keys: Sequence[str],
                      line: str = "line_no", bucket: int = 64) -> DataFrame:
    """Interval join: points within ``start_line..end_line`` of the same keys.

    Spans are repeated per bucket of lines they touch, which turns the range
    condition into an equi key; the exact bounds are the residual.
    """
    spans = methods.withColumn(
        "_bucket",
        F.explode(
            F.sequence(
                F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket)
            )
        ),
    )
    located = points.withColumn("_bucket", F.floor(F.col(line) / bucket))
    return (
        located.join(spans, [*keys, "_bucket"])
        .filter(F.col(line).between(F.col("start_line"), F.col("end_line")))
        .drop("_bucket")
    )


# Cases of a report, whatever they are nested in; comments and raw text hold none.
# Every repetition is possessive: long cases need no deep stack.
_CASES = (
    r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>"
    r"|(<testcase(?=[\s/>])(?:\"[^\"]*+\"|'[^']*+'|[^>\"'/]|/(?!>))*+"
    r"(?:/>|>(?:[^<]++|<!--.*?-->|<!\[CDATA\[.*?\]\]>|<(?!/testcase[\s>]))*+</testcase\s*+>))"
)


def _is_broken(suite):
    return suite.isNull() | suite["_corrupt_record"].isNotNull()


def is_unreadable(xml):
    """Is a report no well-formed XML?"""
    return text.let(F.from_xml(xml, schemas.TESTSUITE), _is_broken)


def cases_of(xml):
    """All cases of a report in its order; none if it is no well-formed XML.

    The report is parsed once; only where it holds cases below nested suites are they
    cut out and parsed by themselves.
    """
    none = F.array().cast(T.ArrayType(schemas.TESTCASE))

    def below(suite):
        """Cases directly below the root, or of all depths where there are more."""
        deep = F.array_join(F.regexp_extract_all(xml, F.lit(_CASES), F.lit(1)), "")
        brought = F.from_xml(F.concat(F.lit("<testsuite>"), deep, F.lit("</testsuite>")), schemas.TESTSUITE)
        named = F.regexp_count(xml, F.lit(r"<testcase(?=[\s/>])"))
        direct = F.coalesce(suite["testcase"], none)
        return F.when(_is_broken(suite), none).when(
            F.size(direct) == named, direct
        ).otherwise(F.coalesce(brought["testcase"], none))

    return text.let(F.from_xml(xml, schemas.TESTSUITE), below)


def report_cases(reports: DataFrame, keys: Sequence[str], xml: str = "xml") -> DataFrame:
    """Test cases of JUnit-style reports, one row each, with their problem text."""
    return case_rows(generate(reports, keys, cases_of(F.col(xml)), "case"), keys)


def case_rows(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What each ``case`` says, from reports held whole or read case by case."""

    def first(kind: str):
        problem = F.try_element_at(F.col("case")[kind], F.lit(1))
        return text.normalize_message(problem["_message"], problem["_type"])

    return cases.select(
        *keys,
        F.col("case._classname").alias("class_fqn"),
        F.col("case._name").alias("name"),
        F.coalesce(F.size("case.error") > 0, F.lit(False)).alias("has_error"),
        F.coalesce(F.size("case.failure") > 0, F.lit(False)).alias("has_failure"),
        first("error").alias("error_message"),
        first("failure").alias("failure_message"),
    )


def reported_messages(xml, class_fqn, name):
    """Ordered distinct messages of one test in one report, per row."""

    def messages(case):
        def first(kind):
            problem = F.try_element_at(case[kind], F.lit(1))
            return text.normalize_message(problem["_message"], problem["_type"])

        return F.array(first("error"), first("failure"))

    def own(all_cases):
        cases = F.filter(all_cases, lambda c: (c["_classname"] == class_fqn) & (c["_name"] == name))
        return text.ordered_distinct(F.flatten(F.transform(cases, messages)))

    return text.let(cases_of(xml), own)


def messages_of_runs(run_reports: DataFrame) -> DataFrame:
    """Distinct messages per run over its own report files, in path order.

    ``run_reports`` has ``run_id, class_fqn, name, path, xml``.  Messages are
    made distinct before they are listed, so a run with many reports of one
    failure lists it once.
    """
    messages = reported_messages(F.col("xml"), F.col("class_fqn"), F.col("name"))
    found = run_reports.select(
        "run_id", "path", F.posexplode_outer(messages).alias("pos", "message")
    ).filter("message is not null")
    first = found.groupBy("run_id", "message").agg(F.min(F.struct("path", "pos")).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", "message")))
    return first.groupBy("run_id").agg(
        F.transform(listed, lambda r: r["message"]).alias("messages")
    )


def report_failures(tests: DataFrame, reports: DataFrame, keys: Sequence[str] = (),
                    class_scope: bool = False) -> DataFrame:
    """``case_failures`` of reports held whole, one ``xml`` each."""
    return case_failures(tests, report_cases(reports, keys), keys, class_scope)


def case_failures(tests: DataFrame, cases: DataFrame, keys: Sequence[str] = (),
                  class_scope: bool = False) -> DataFrame:
    """Messages of the failed cases of each test.

    ``tests`` has ``test_id, class_fqn, name`` and the ``keys`` (run, or repository
    and revision), so a report never reaches the same-named test of another project.
    ``class_scope`` takes all cases of the class, not only the test's own.
    """
    on = [*keys, "class_fqn"] if class_scope else [*keys, "class_fqn", "name"]
    failed = cases.filter(F.col("has_error") | F.col("has_failure"))
    if class_scope:
        failed = failed.drop("name")
    rows = failed.withColumn(
        "message", F.explode_outer(F.array_compact(F.array("error_message", "failure_message")))
    ).filter("message is not null").drop("error_message", "failure_message")
    return tests.join(rows, on)


_WORDS = r"(?s).\w*"  # of a class name: any character and the rest of its word


def class_words(class_fqn):
    """Number of words at which ``class_ends`` cuts the class name out of a file's."""
    return F.size(F.regexp_extract_all(class_fqn, F.lit(_WORDS), F.lit(0)))


def class_ends(path, words: Sequence[int] | None = None):
    """Class names a report file can be for: its name after the prefix, up to each end of a word.

    All of them, or only those of so many words as ``words`` names.
    """
    stem = F.regexp_replace(
        F.substring_index(text.last_segment(path), rules.REPORT_NAME_PREFIX, -1), text.quote(rules.REPORT_SUFFIX) + "$", ""
    )
    pieces = F.regexp_extract_all(stem, F.lit(_WORDS), F.lit(0))

    def first(p, n):
        return F.array_join(F.slice(p, F.lit(1), n), "")

    if words is not None:
        return text.let(pieces, lambda p: F.array_compact(F.array(*[
            F.when(F.size(p) >= n if n else F.size(p) == 0, first(p, F.lit(n))) for n in words
        ]).cast("array<string>")))
    return text.let(
        pieces,
        lambda p: F.when(F.size(p) == 0, F.array(F.lit(""))).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1))), lambda n: first(p, n))
        ),
    )


def named_reports(reports: DataFrame) -> DataFrame:
    """Files below a folder that are reports by their name."""
    return reports.filter(F.endswith(F.col("path"), F.lit(rules.REPORT_SUFFIX))).filter(
        (F.size(F.split(F.col("path"), "/")) > 1) & F.contains(text.last_segment(F.col("path")), F.lit(rules.REPORT_NAME_PREFIX))
    )


def listed_reports(reports: DataFrame, *keep: str, depths: Sequence[int] | None = None,
                   folders: DataFrame | None = None, words: Sequence[int] | None = None) -> DataFrame:
    """Report paths under the directories above them and the classes their names hold.

    All directories, or only those of so many parts as ``depths`` names, or that
    ``folders`` lists as ``report_dir``: names are cut only of reports that lie there.
    All classes, or only those of so many words as ``words`` names.
    """
    parts = F.split(F.col("path"), "/")
    if depths is None:
        above = F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
        )
    else:
        above = F.array_compact(F.array(*[
            F.when(F.size(parts) > n, F.substring_index(F.col("path"), "/", n)) for n in depths
        ]).cast("array<string>"))
    placed = (
        named_reports(reports)
        .select("path", *keep, F.explode_outer(above).alias("report_dir"))
        .filter("report_dir is not null")
    )
    if folders is not None:
        placed = placed.join(folders, "report_dir", "left_semi")
    listed = placed.select("path", *keep, F.explode_outer(class_ends(F.col("path"), words)).alias("class_fqn"), "report_dir")
    return listed if words is None else listed.filter("class_fqn is not null")


def reports_of_runs(runs: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports of a run's class in the directories its log refers to.

    ``runs`` has ``run_id, class_fqn, report_dir``; ``reports`` has ``path``.
    Each report is listed under the directories above it and the class its name
    holds, so the walk below a directory is an equi join, and a folder that all
    tests of a module share pairs each of them with its own reports only.  Only
    paths are listed, and of the directories only those that a log names; the
    report text joins the matches by path and moves once, without the reports that no
    run asks for.  The runs are stored: they are mined once.
    """
    wanted = stored(runs.withColumn("report_dir", F.rtrim(F.col("report_dir"), F.lit("/"))), "report_dirs")
    # at most as many as the deepest folder has parts
    depths = sorted(r[0] for r in wanted.filter("report_dir is not null").select(F.size(F.split("report_dir", "/"))).distinct().collect())
    listed = listed_reports(reports, depths=depths, folders=wanted.select("report_dir").distinct())
    found = stored(wanted.join(listed, ["report_dir", "class_fqn"]), "found_reports")
    # both joins are by path: a text that is asked for is not dealt anew for the second
    texts = reports.join(found.select("path"), "path", "left_semi")
    return found.join(texts.hint("merge"), "path")


def mined_logs(run_logs: DataFrame, *keep: str) -> DataFrame:
    """Runs with the evidence of their logs: narrow rows from one pass over the texts.

    ``run_logs`` has ``run_id, test_fqn, path, content`` and the columns to keep.
    """
    return run_logs.select(
        "run_id", "test_fqn", "path", *keep,
        logs.log_evidence(F.col("content"), F.col("test_fqn")).alias("_e"),
    ).select("run_id", "test_fqn", "path", *keep, "_e.*")


def report_folders(mined: DataFrame) -> DataFrame:
    """``run_id, class_fqn, name, report_dir`` of mined logs."""
    return mined.select(
        "run_id", names.class_fqn(F.col("test_fqn")).alias("class_fqn"),
        names.method_name(F.col("test_fqn")).alias("name"), F.explode_outer("report_dirs").alias("report_dir"),
    ).filter("report_dir is not null")


def evidence_of_mined(mined: DataFrame, sources: DataFrame, report_messages: DataFrame | None = None,
                      *keep: str) -> DataFrame:
    """Verdict, joined messages, joined source lines and method names per run.

    ``sources`` has ``path, content``; ``report_messages`` has ``run_id, messages
    array<string>``.  Source lines are looked up once for all runs of a source.
    """
    asked = mined.select("path", F.explode_outer("line_numbers").alias("line_no")).filter("line_no is not null")
    code = line_lookup(asked, sources, ["path"]).groupBy("path").agg(
        F.map_from_entries(F.collect_list(F.struct("line_no", "line"))).alias("_lines")
    )
    joined = mined.join(code, "path", "left")
    err_code = F.transform("line_numbers", lambda n: F.col("_lines")[n])
    none = F.array().cast("array<string>")
    messages = F.col("compile_messages")
    if report_messages is not None:
        joined = joined.join(
            report_messages.select("run_id", F.col("messages").alias("_reported")),
            "run_id", "left",
        )
        reported = F.when(F.col("is_compile_failure"), none).otherwise(
            F.coalesce(F.col("_reported"), none)
        )
        messages = text.union_messages(messages, reported)
    return joined.select(
        "run_id", *keep,
        "summary",
        text.joined(messages).alias("err_msg"),
        text.joined(text.ordered_distinct(F.coalesce(err_code, none))).alias("err_code"),
        "err_methods",
    )


def evidence_bundle(run_logs: DataFrame, sources: DataFrame,
                    report_messages: DataFrame | None = None) -> DataFrame:
    """Evidence of runs whose logs are held whole; log text is never shuffled."""
    return evidence_of_mined(mined_logs(run_logs), sources, report_messages)


BLOCK_LINES = 10_000


def _has(marker: str):
    return F.contains(F.col("line"), F.lit(marker))


def marked_lines(runs: DataFrame, lines: DataFrame, line: str = "line", block: int = BLOCK_LINES) -> DataFrame:
    """Lines that can be evidence, with what each says about its run.

    Columns: ``run_id, block, line_no, line, number, method, dir, _m0...`` (one flag for
    each of ``_markers()``).  A run is cut into blocks of lines; what is known of a run
    reaches its lines by run and block, so a run with most of the lines is spread over
    the tasks that hold its blocks.
    """
    text_of = F.col("line")
    markers = _markers()
    frame = F.contains(text_of, F.lit(rules.FRAME_PREFIX))
    named = F.contains(text_of, F.lit(rules.SOURCE_SUFFIX))
    kept = stored(
        lines.select("run_id", "line_no", F.col(line).alias("line"))
        .filter(text.contains_any(text_of, markers) | frame | named)
        .withColumn("block", F.floor(F.col("line_no") / block)),
        "kept_lines",
    )
    names_of = runs.select(
        "run_id", names.class_file(F.col("test_fqn")).alias("_file"), names.class_fqn(F.col("test_fqn")).alias("_class")
    )
    places = kept.select("run_id", "block").distinct().join(names_of, "run_id")
    joined = kept.join(places, ["run_id", "block"])
    return joined.select(
        "run_id", "block", "line_no", "_file",
        F.when(_has(rules.ERROR_PREFIX) | _has(rules.REGION_START) | _has(rules.REGION_END), text_of).alias("line"),
        F.when(F.contains(text_of, F.col("_file")), logs.line_number(text_of, F.col("_file"))).alias("number"),
        F.when(logs.is_frame(text_of, F.col("_class")), logs.frame_method(text_of, F.col("_class"))).alias("method"),
        F.when(_has(rules.REPORT_DIR_START), logs.report_dir(text_of)).alias("dir"),
        *[_has(m).alias(f"_m{i}") for i, m in enumerate(markers)],
    )


def _markers() -> list[str]:
    return list(dict.fromkeys(
        [m for _, ms in rules.VERDICT_RULES for m in ms]
        + [rules.COMPILE_MARKER, rules.REGION_START, rules.REGION_END, rules.REPORT_DIR_START, rules.ERROR_PREFIX]
    ))


def mined_lines(runs: DataFrame, lines: DataFrame, line: str = "line", block: int = BLOCK_LINES) -> DataFrame:
    """The rows of ``mined_logs`` from a line table, for logs of any size.

    ``runs`` has ``run_id, test_fqn, path``; ``lines`` has ``run_id, line_no, line``.
    Lines are read and shuffled once, into a stored narrow table.  Blocks of a run give
    partial evidence that merges: flags, the last region start, the first region end
    after it, first occurrences of values.  No run is the key of more than one row for
    each of its blocks and different values.
    """
    markers = _markers()
    marked = stored(marked_lines(runs, lines, line, block), "marked_lines")
    at, text_of = F.col("line_no"), F.col("line")
    flag = {m: F.col(f"_m{i}") for i, m in enumerate(markers)}
    partial = stored(
        marked.groupBy("run_id", "block").agg(
            *[F.bool_or(c).alias(f"_m{i}") for i, c in enumerate(flag.values())],
            F.max(F.when(flag[rules.REGION_START], at)).alias("_from"),
        ),
        "block_evidence",
    )
    marks = partial.groupBy("run_id").agg(
        *[F.bool_or(f"_m{i}").alias(f"_m{i}") for i in range(len(markers))], F.max("_from").alias("_from")
    )

    def in_blocks(of_runs: DataFrame) -> DataFrame:
        """What is known of runs, for each of their blocks."""
        return partial.select("run_id", "block").join(of_runs, "run_id")

    # the region begins and ends inside the lines of its markers
    begun = F.when(at == F.col("_from"), text.after_last(text_of, rules.REGION_START)).otherwise(text_of)
    after = at >= F.coalesce("_from", F.lit(0))
    ends = (
        marked.filter(flag[rules.REGION_END]).select("run_id", "block", "line_no", "line")
        .join(in_blocks(marks.select("run_id", "_from")), ["run_id", "block"])
        .filter(after & F.contains(begun, F.lit(rules.REGION_END)))
        .groupBy("run_id").agg(F.min("line_no").alias("_to"))
    )
    bounds = stored(marks.select("run_id", "_from").join(ends, "run_id", "left"), "regions")
    cut = F.when(at == F.col("_to"), F.substring_index(begun, rules.REGION_END, 1)).otherwise(begun)
    region = (
        marked.filter(flag[rules.ERROR_PREFIX]).select("run_id", "block", "line_no", "line", "_file")
        .join(in_blocks(bounds), ["run_id", "block"])
        .filter(after & (at <= F.coalesce("_to", at)))
        .withColumn("line", cut)
        .filter(F.startswith(text_of, F.lit(rules.ERROR_PREFIX)) & ~_has(rules.GOAL_FAILED))
    )
    bare = text.strip_marker(F.replace(text_of, F.lit(rules.REGION_NOISE), F.lit("")), rules.ERROR_PREFIX)
    message = F.when(F.contains(bare, F.col("_file")), text.after_last(bare, "]")).otherwise(bare)

    def listed(value, rows_of: DataFrame, name: str) -> DataFrame:
        found = rows_of.select("run_id", "line_no", value.alias("_v")).filter("_v is not null")
        first = first_occurrences(found, ["run_id"], "_v")
        ordered = F.array_sort(F.collect_list(F.struct("line_no", "_v")))
        return first.groupBy("run_id").agg(F.transform(ordered, lambda r: r["_v"]).alias(name))

    parts = [
        listed(message, region, "_messages"),
        listed(F.col("number"), marked, "_numbers"),
        listed(F.col("method"), marked, "_methods"),
        listed(F.col("dir"), marked, "_dirs"),
    ]
    summary = F
    for name, needed in rules.VERDICT_RULES:
        summary = summary.when(reduce(lambda a, b: a & b, [flag[m] for m in needed]), F.lit(name))
    out = runs.select("run_id", "test_fqn", "path").join(marks, "run_id", "left")
    for part in parts:
        out = out.join(part, "run_id", "left")
    compiles = F.coalesce(flag[rules.COMPILE_MARKER], F.lit(False))
    none = F.array().cast("array<string>")
    return out.select(
        "run_id", "test_fqn", "path", summary.otherwise(F.lit(rules.UNRECOGNIZED)).alias("summary"),
        compiles.alias("is_compile_failure"),
        F.when(compiles, F.coalesce("_messages", none)).otherwise(none).alias("compile_messages"),
        F.coalesce("_numbers", F.array().cast("array<int>")).alias("line_numbers"),
        F.coalesce("_methods", none).alias("err_methods"),
        F.when(compiles, none).otherwise(F.coalesce("_dirs", none)).alias("report_dirs"),
    )


def class_names_of(tests: DataFrame) -> DataFrame:
    """Add ``class_fqn`` and ``name`` to tests with ``test_fqn``."""
    return tests.withColumn("class_fqn", names.class_fqn(F.col("test_fqn"))).withColumn(
        "name", names.method_name(F.col("test_fqn"))
    )
