"""From manifest, sources and initial run logs to prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import fqn as names
from ..functions import javacode, prompts
from ..operators import evidence, localize, methods
from ..session import stored


def cut_tests(manifest: DataFrame, sources: DataFrame) -> DataFrame:
    """Every manifest row with its source, method, helpers and fields.

    ``manifest`` has ``test_id, repo, sha, module, test_fqn``; ``sources`` has
    ``repo, sha, path, content``.  Rows that are not localised are kept with
    their status.  Localising moves paths only; a source is parsed once and
    only if a test lies in it, and its text moves once, by path.  Nothing is cut
    from a source whose braces do not match.
    """
    located = localize.localize(manifest, sources.select("repo", "sha", "path"))
    wanted = located.filter("path is not null").select("path").distinct()
    # texts are large whatever the planner estimates: no broadcast of them
    tested = sources.select("path", "content").hint("merge").join(wanted, "path", "left_semi")
    structures = tested.select(
        "path", "content", methods.source_structure(F.col("content")).alias("_s")
    )
    joined = located.join(structures.hint("merge"), "path", "left")
    method = F.when(
        ~F.col("_s.unclosed"), javacode.last_named(F.col("_s.methods"), F.col("method_name"))
    )
    named = joined.withColumn("method_name", names.method_name(F.col("test_fqn")))
    cut = named.withColumn("_m", method)
    return cut.select(
        *manifest.columns, "localization_status", "path", "content", "method_name",
        F.col("_m.start").alias("start"), F.col("_m.end").alias("end"),
        F.when(F.col("_m").isNotNull(), javacode.code_of(F.col("content"), F.col("_m")))
        .alias("method_code"),
        F.col("_m.annotations").alias("annotations"),
        F.col("_s.before").alias("before"), F.col("_s.after").alias("after"),
        F.col("_s.earliest_line").alias("earliest_line"),
        F.col("_s.helper_method_names").alias("helper_method_names"),
        F.col("_s.global_vars").alias("global_vars"),
    )


def _bundle(mined: DataFrame, sources: DataFrame, reports: DataFrame | None, *keep: str) -> DataFrame:
    mined = stored(mined, "mined")
    messages = None
    if reports is not None:
        messages = evidence.messages_of_runs(evidence.reports_of_runs(evidence.report_folders(mined), reports))
    return evidence.evidence_of_mined(mined, sources, messages, *keep)


def run_evidence(run_logs: DataFrame, sources: DataFrame,
                 reports: DataFrame | None = None) -> DataFrame:
    """Evidence per run, with the messages of the reports its log refers to.

    The logs are read once, into a narrow table that everything else uses.
    """
    return _bundle(evidence.mined_logs(run_logs), sources, reports)


def line_evidence(runs: DataFrame, lines: DataFrame, sources: DataFrame,
                  reports: DataFrame | None = None) -> DataFrame:
    """``run_evidence`` for logs that are held as lines, of any size."""
    return _bundle(evidence.mined_lines(runs, lines), sources, reports)


def first_run_evidence(run_logs: DataFrame, sources: DataFrame, reports: DataFrame | None = None,
                       order: tuple[str, ...] = ("ts", "run_id")) -> DataFrame:
    """Evidence of the first run of each test, with ``test_id`` and the order's columns.

    The first runs are chosen by the order's columns alone, and only their logs are
    mined.  Rows that the order does not tell apart are reduced to their evidence first.
    """
    keep = [c for c in order if c != "run_id"]
    first = run_logs.groupBy(F.col("test_id").alias("_test")).agg(F.min(F.struct(*order)).alias("_first"))
    first = first.select("_test", *[F.col(f"_first.{c}").alias(f"_{c}") for c in order])
    same = F.col("test_id").eqNullSafe(F.col("_test"))
    for c in order:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    mined = evidence.mined_logs(run_logs.join(first, same, "left_semi"), "test_id", *keep)
    columns = [c for c in mined.columns if c != "test_id"]
    chosen = mined.groupBy("test_id").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_r"))
    return _bundle(chosen.select("test_id", "_r.*"), sources, reports, "test_id", *keep)


def initial_prompts(tests: DataFrame, initial: DataFrame,
                    template: str = prompts.TEMPLATE) -> DataFrame:
    """Tests with their initial evidence and, where that is a failure, a prompt.

    ``tests`` comes from ``cut_tests``; ``initial`` has ``test_id, summary,
    err_msg, err_code, err_methods``.
    """
    code = prompts.context_code(
        F.col("before"), F.col("after"), F.col("global_vars"), F.col("method_code")
    )
    text = prompts.prompt(
        F.col("method_name"), code, F.col("err_msg"), F.col("err_code"), F.col("err_methods"),
        template,
    )
    return tests.join(initial, "test_id", "left").withColumn(
        "prompt",
        F.when(
            (F.col("summary") == rules.FAILURE)
            & (F.col("localization_status") == rules.LOCALIZED),
            text,
        ),
    )
