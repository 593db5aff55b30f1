"""Result documents: everything known about each test after the repair loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import fqn as names
from ..functions import javacode, prompts
from ..operators import attempts as loop
from ..operators import methods

_EVIDENCE = ("summary", "err_msg", "err_code", "err_methods")
_RELATED = ("method_code", "before", "after", "global_vars")


def attempt_prompts(tests: DataFrame, initial: DataFrame, tries: DataFrame,
                    order: tuple[str, ...] = ("ts",), limit: int = rules.MAX_ATTEMPTS,
                    template: str = prompts.TEMPLATE) -> DataFrame:
    """Numbered attempts with the prompt of each and the code related to its patch.

    ``tests`` comes from ``plans.triage.cut_tests``; ``initial`` has ``test_id`` and
    the evidence columns; ``tries`` has ``test_id, ts, applied, patched_content`` and
    the evidence columns.  Attempt 0 sees the initial run and the original code, a
    later one the evidence and code of the last applied attempt before it.
    ``related_code`` is the record ``method_code, before, after, global_vars``, cut again
    from the patched source of an applied attempt; a source without the method, or with
    unmatched braces, keeps the code shown before, and a source that the patch leaves as
    it was is not parsed again.  A patched source is parsed where it lies; windows hold
    ``limit`` rows per test.
    """
    columns = [F.col(c) for c in _EVIDENCE]
    begun = tests.select(
        "test_id", "method_name", F.struct(*_RELATED).alias("_own"), F.sha2("content", 256).alias("_digest")
    ).join(
        initial.filter(F.col("summary") == rules.FAILURE).select("test_id", F.struct(*columns).alias("_first")),
        "test_id",
    )
    numbered = loop.number_attempts(tries, ["test_id"], order, limit).join(begun, "test_id")
    same = F.sha2("patched_content", 256).eqNullSafe(F.col("_digest"))
    parsed = numbered.withColumn(
        "_s", F.when(F.col("applied") & ~same, methods.source_structure(F.col("patched_content")))
    ).withColumn(
        "_m", F.when(~F.col("_s.unclosed"), javacode.last_named(F.col("_s.methods"), F.col("method_name")))
    )
    cut = F.when(
        F.col("_m").isNotNull(),
        F.struct(
            javacode.code_of(F.col("patched_content"), F.col("_m")).alias("method_code"),
            *[F.col(f"_s.{c}").alias(c) for c in _RELATED[1:]],
        ),
    ).when(F.col("applied") & same, F.col("_own"))
    known = parsed.withColumn("related_code", cut).drop("_s", "_m", "patched_content", "_digest")
    seen = loop.previous_evidence(
        known, ["test_id"], F.struct(*columns), F.col("_first"), F.col("applied"), "_seen"
    )
    seen = loop.previous_evidence(
        seen, ["test_id"], F.col("related_code"), F.col("_own"), F.col("related_code").isNotNull(), "_shown"
    )
    shown = F.col("_shown")
    code = prompts.context_code(*[shown[c] for c in ("before", "after", "global_vars", "method_code")])
    ask = prompts.prompt(
        F.col("method_name"), code, F.col("_seen.err_msg"), F.col("_seen.err_code"),
        F.col("_seen.err_methods"), template,
    )
    return seen.withColumn("prompt", ask).withColumn(
        "related_code", F.when(F.col("applied"), F.coalesce("related_code", "_shown"))
    ).drop("_own", "_first", "_seen", "_shown", "method_name")


def result_documents(tests: DataFrame, initial: DataFrame, tries: DataFrame,
                     clone_dir: str, out_dir: str, order: tuple[str, ...] = ("ts",),
                     limit: int = rules.MAX_ATTEMPTS) -> DataFrame:
    """One row per test in the shape of a result document.

    ``tests`` comes from ``plans.triage.cut_tests``; ``initial`` has ``test_id,
    started, ended`` and the evidence columns; ``tries`` has ``test_id, ts,
    applied, prompt, response, patch``, the evidence columns and, if it is to be
    logged, ``related_code``.  Only tests
    whose initial run fails have attempts; only applied attempts are logged.  One
    pass over the attempts gives outcome, log and last evidence.
    """
    first = initial.select(
        "test_id", "started", "ended", *[F.col(c).alias(f"initial_{c}") for c in _EVIDENCE]
    )
    logged = F.col("kept") & F.col("applied")
    last = F.max_by(F.struct(*_EVIDENCE), F.when(logged, F.col("iter"))).alias("_last")
    values = ["result", *(["related_code"] if "related_code" in tries.columns else []), "patch", "prompt", "response"]
    outcome = loop.repair_outcomes(
        first.select("test_id", "initial_summary", "started", "ended"),
        tries.withColumn("result", F.struct(*_EVIDENCE)), order, limit=limit,
        started="started", ended="ended",
        extra=[loop.log_column(values, logged), last],
    ).drop("initial_summary", "started", "ended")
    # no log rather than an empty one where nothing was applied
    outcome = outcome.select(
        *[c for c in outcome.columns if c not in ("_last", "intermediate_log")],
        F.when(F.size("intermediate_log") > 0, F.col("intermediate_log")).alias("intermediate_log"),
        *[F.col(f"_last.{c}").alias(f"prev_{c}") for c in _EVIDENCE],
    )
    docs = tests.join(first.drop("started", "ended"), "test_id", "left").join(
        outcome, "test_id", "left"
    )

    def position(name: str):
        return F.when(
            F.col(name).isNotNull(), F.array(F.col(name)["line"], F.col(name)["column"])
        )

    return (
        docs.withColumn("start", position("start"))
        .withColumn("end", position("end"))
        .withColumn("repo_path", names.repo_path(F.lit(clone_dir), F.col("sha"), F.col("repo")))
        .withColumn(
            "result_json",
            names.result_path(F.lit(out_dir), F.col("repo"), F.col("sha"), F.col("test_fqn")),
        )
        .withColumn("time", names.elapsed_text(F.col("elapsed_s")))
        .withColumn("status", F.coalesce("status", "localization_status"))
        .withColumnsRenamed(
            {"path": "test_file_path", "content": "original_test_class_content"}
        )
        .drop("elapsed_s")
    )
