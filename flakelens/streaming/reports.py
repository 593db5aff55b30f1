"""Runs and the reports they wait for, as two streams.

A run that names report folders is joined with the reports that appear in them around
the time it ends.  Both sides have watermarks and the join an interval, so the state of
each side is freed, and a run whose reports do not come in time is emitted without
messages once no report can come any more.  Reports are reduced to the messages of their
cases before they enter the state; their text is never kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evidence


def report_messages(reports: DataFrame) -> DataFrame:
    """``(path, written, cases)`` of ``(path, written, xml)``: messages by class and method."""

    def said(case):
        def first(kind):
            problem = F.try_element_at(case[kind], F.lit(1))
            return text.normalize_message(problem["_message"], problem["_type"])

        return F.struct(
            case["_classname"].alias("class_fqn"), case["_name"].alias("name"),
            F.array_compact(F.array(first("error"), first("failure"))).alias("messages"),
        )

    failed = F.filter(F.transform(evidence.cases_of(F.col("xml")), said), lambda c: F.size(c["messages"]) > 0)
    return reports.select("path", "written", failed.alias("cases"))


def asked_places(runs: DataFrame) -> dict[str, list[int]]:
    """How deep the folders lie that runs name, and how many words their classes have: the
    ``depths`` and ``words`` of ``reports_in_time`` for these runs."""
    asked = runs.filter("report_dir is not null and class_fqn is not null").select(
        F.size(F.split(F.rtrim(F.col("report_dir"), F.lit("/")), "/")).alias("depths"),
        evidence.class_words(F.col("class_fqn")).alias("words"),
    ).distinct()
    # at most as many as the deepest folder has parts and the longest name has words
    found = asked.collect()
    return {c: sorted({r[c] for r in found}) for c in asked.columns}


def reports_in_time(runs: DataFrame, reports: DataFrame, within: str, delay: str,
                    depths: Sequence[int] | None = None, words: Sequence[int] | None = None) -> DataFrame:
    """Runs with each report of theirs, or with none.

    ``runs`` has ``run_id, class_fqn, name, report_dir, ended``; ``reports`` comes from
    ``report_messages``.  A report counts if it is written at most ``within`` before or
    after the run ends; both streams may be ``delay`` out of order.  Rows: ``run_id,
    class_fqn, name, ended, path, messages``; path and messages are null where no report
    came.

    A report waits once for each folder above it and each class its name can hold.  Where it is
    known how deep the folders of all runs lie (``depths``) and how many words their classes
    have (``words``), it waits in those places only; a run elsewhere would find none.
    """
    def place(folder: str, class_fqn: str):
        return F.xxhash64(folder, class_fqn)

    def lengths(folder: str, class_fqn: str):
        return F.shiftleft(F.length(folder).cast("long"), 32) + F.length(class_fqn)

    # a report is held once for each folder above it and class its name holds: without their
    # texts, which the path has, and with the messages of that class alone
    own = F.filter("cases", lambda c: c["class_fqn"] == F.col("class_fqn"))
    # event time goes on with every report, listed or not
    timed = evidence.named_reports(reports).withWatermark("written", delay)
    listed = evidence.listed_reports(timed, "written", "cases", depths=depths, words=words).select(
        place("report_dir", "class_fqn").alias("_place"), lengths("report_dir", "class_fqn").alias("_lengths"),
        "path", "written", F.transform(own, lambda c: F.struct(c["name"].alias("name"), c["messages"].alias("messages"))).alias("cases"),
    )
    waiting = runs.withColumn("report_dir", F.rtrim(F.col("report_dir"), F.lit("/"))).withWatermark("ended", delay)
    span = F.expr(f"INTERVAL {within}")
    near = F.col("written").between(F.col("ended") - span, F.col("ended") + span)
    is_place = (
        (F.col("_place") == place("report_dir", "class_fqn"))
        & (F.col("_lengths") == lengths("report_dir", "class_fqn"))
        & F.startswith("path", F.concat("report_dir", F.lit("/")))
        & F.array_contains(evidence.class_ends(F.col("path")), F.col("class_fqn"))
    )
    met = waiting.join(listed, is_place & near, "leftOuter")
    named = F.filter("cases", lambda c: c["name"] == F.col("name"))
    messages = F.when(F.col("path").isNotNull(), F.flatten(F.transform(named, lambda c: c["messages"])))
    return met.select("run_id", "class_fqn", "name", "ended", "path", messages.alias("messages"))


def messages_of_runs(found: DataFrame) -> DataFrame:
    """Distinct messages of each run of a stored result, in path order, as the batch form lists them."""
    rows = found.select("run_id", "path", F.posexplode_outer("messages").alias("pos", "message")).filter("message is not null")
    first = rows.groupBy("run_id", "message").agg(F.min(F.struct("path", "pos")).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", "message")))
    return first.groupBy("run_id").agg(F.transform(listed, lambda r: r["message"]).alias("messages"))
