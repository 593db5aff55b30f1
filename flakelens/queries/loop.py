"""The repair loop over tables and streams of attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..operators import attempts, evidence, lines, scans
from ..session import scratch_dir
from ..streaming import attempts as live
from ..streaming import reports as live_runs
from . import derived as d

ORDER = ["ts", "event_id"]


def _events(spark, sf):
    return d.table(spark, sf, "events")


def _passed():
    return F.col("event_type") == "purchase"


def attempts_capped(spark, sf):
    """Attempts up to the first pass, at most five per user."""
    numbered = attempts.number_attempts(
        _events(spark, sf).select("user_id", "ts", "event_id", "event_type"), ["user_id"], ORDER
    )
    return attempts.until_pass(numbered, ["user_id"], _passed()).select(
        "user_id", "event_id", "iter", "event_type"
    )


def attempt_evidence(spark, sf):
    """What each attempt is shown and what holds after it; views are not applied."""
    applied = F.col("event_type") != "view"
    numbered = attempts.number_attempts(_events(spark, sf), ["user_id"], ORDER)
    seen = attempts.previous_evidence(
        numbered, ["user_id"], F.col("props"), F.lit("initial"), applied
    )
    return attempts.carry_forward(
        seen, ["user_id"], {"after": F.col("event_type")}, applied
    ).select("user_id", "iter", "seen", "after")


def carry_forward(spark, sf):
    """Last error value so far over all events of a user, in hourly chunks."""
    error = F.when(F.col("event_type") == "error", F.col("value"))
    rows = _events(spark, sf).select("user_id", "ts", "event_id", "event_type", "value")
    return scans.last_known(
        rows, ["user_id"], ORDER, scans.time_chunk("ts"), {"last_error": error}
    ).select("user_id", "event_id", "last_error")


def balanced_regions(spark, sf):
    """Clicks open and errors close: one row per balanced region of a user's events."""
    rows = scans.balanced_regions(
        _events(spark, sf).select("user_id", "ts", "event_id", "event_type"),
        ["user_id"], ORDER, scans.time_chunk("ts"),
        (F.col("event_type") == "click").cast("int"),
        (F.col("event_type") == "error").cast("int"),
    )
    return scans.region_summary(rows, ["user_id"])


def _initial(spark, sf):
    segment = F.col("c_mktsegment")
    return d.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("test_id"),
        F.when(segment == "MACHINERY", rules.PASS)
        .when(segment == "FURNITURE", rules.COMPILATION_ERROR)
        .otherwise(rules.FAILURE).alias("initial_summary"),
    )


def repair_outcome(spark, sf):
    """Skipped, fixed at k or unresolved, with attempts used, patch and time."""
    tried = _events(spark, sf).select(
        F.col("user_id").alias("test_id"), "ts", "event_id",
        (F.col("event_type") != "view").alias("applied"),
        F.when(_passed(), rules.PASS).otherwise(rules.FAILURE).alias("summary"),
        F.col("props").alias("patch"),
    )
    return attempts.repair_outcomes(_initial(spark, sf), tried, ORDER)


def initial_status(spark, sf):
    """Only tests whose first run fails enter the loop."""
    return _initial(spark, sf).filter(F.col("initial_summary") == rules.FAILURE)


def attempt_log_nested(spark, sf):
    numbered = attempts.number_attempts(_events(spark, sf), ["user_id"], ORDER)
    log = attempts.attempt_log(numbered, ["user_id"], "event_id", "event_type")
    return log.select("user_id", F.to_json("intermediate_log").alias("log"))


def merge_maps(spark, sf):
    """Later keys win when the label record is merged into the document record."""
    docs = d.table(spark, sf, "documents")
    labels = d.table(spark, sf, "labels")
    old = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")
    new = F.when(
        F.col("quality").isNotNull(),
        F.create_map(F.lit("source"), F.lit("labelled"), F.lit("quality"), F.col("quality").cast("string")),
    )
    merged = docs.join(labels, "doc_id", "left").select(
        "doc_id", lines.merge_maps(old, new).alias("m")
    )
    return merged.select("doc_id", *[F.col("m")[k].alias(k) for k in ("lang", "source", "quality")])


def attempt_stream(spark, sf):
    """The loop as a stream over the events file, checked against the batch form."""
    schema = _events(spark, sf).schema
    stream = live.stateful_session(spark).readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    progress = live.track_attempts(
        stream, F.col("user_id"), F.col("ts"), F.col("event_id"), _passed(), F.col("props"),
        applied=F.col("event_id") % 4 != 0, evidence=F.col("event_type"),
    )
    base = scratch_dir(spark, "attempt-stream")
    stored = live.run_to_table(progress, f"{base}/out", f"{base}/checkpoint")
    return live.latest_outcomes(stored).drop("is_final")


def _stream(spark, sf):
    return live.stateful_session(spark).readStream.schema(_events(spark, sf).schema).parquet(f"{sf}/events.parquet*")


def _attempts(events, passed):
    return live.attempt_rows(
        events, F.col("user_id"), F.col("ts"), F.col("event_id"), passed, F.col("props"),
        applied=F.col("event_id") % 4 != 0, evidence=F.col("event_type"),
    )


def attempt_hand_over(spark, sf):
    """Attempts up to the 3rd are a table of history, later ones come as a stream: one batch run's outcome."""
    first = F.lit("2024-01-03").cast("timestamp_ntz")
    stream = _stream(spark, sf)
    own = stream.sparkSession
    history = _attempts(_events(own, sf).filter(F.col("ts") < first), _passed())
    progress = live.track(_attempts(stream.filter(F.col("ts") >= first), _passed()), history=history)
    base = scratch_dir(spark, "attempt-hand-over")
    stored = live.run_to_table(progress, f"{base}/out", f"{base}/checkpoint")
    return live.latest_outcomes(live.with_history(stored, history)).drop("is_final")


IDLE_HOURS, DELAY_HOURS, MANY = 12, 1, 100_000


def attempt_expiry(spark, sf):
    """Tests without a pass are given up half a day after their last attempt, by event time."""
    passed = (F.col("event_type") == "purchase") & (F.col("value") > 150)
    progress = live.track(
        _attempts(_stream(spark, sf), passed), MANY, idle_ms=IDLE_HOURS * 3_600_000, delay=f"{DELAY_HOURS} hours"
    )
    base = scratch_dir(spark, "attempt-expiry")
    stored = live.run_to_table(progress, f"{base}/out", f"{base}/checkpoint")
    return live.latest_outcomes(stored).select("test_id", "is_fixed", "fixed_at", "attempts_used", "is_final")


WITHIN, DELAY = 30, 5  # minutes


def live_reports(spark, sf):
    """Runs and reports as two streams; every third report comes too late for its run."""
    logs_ = d.run_logs(spark, sf)
    # runs without folders go there: a filter here would mine every log before the rows are spread, and again after
    runs = evidence.report_folders(evidence.mined_logs(logs_)).join(logs_.select("run_id", F.col("ts").cast("timestamp").alias("ended")), "run_id")
    run = F.regexp_extract("path", r"/run(\d+)/", 1).cast("long")
    times = _events(spark, sf).select(F.col("event_id").alias("run"), F.col("ts").cast("timestamp").alias("ts"))
    reports = d.reports(spark, sf).withColumn("run", run).join(times, "run").select(
        "path", (F.col("ts") + F.expr("make_dt_interval(0, 0, 20 * cast(run % 3 as int))")).alias("written"), "xml"
    )
    own = live.stateful_session(spark)
    # a new session does not take it over, and each partition has four state stores
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    base = scratch_dir(spark, "live-reports")
    streams = []
    for name, table in (("runs", runs), ("reports", live_runs.report_messages(reports))):
        table.write.parquet(f"{base}/{name}")
        streams.append(own.readStream.schema(table.schema).parquet(f"{base}/{name}"))
    places = live_runs.asked_places(spark.read.schema(runs.schema).parquet(f"{base}/runs"))
    found = live_runs.reports_in_time(*streams, f"{WITHIN} MINUTES", f"{DELAY} minutes", **places)
    stored = live.run_to_table(found, f"{base}/out", f"{base}/checkpoint")
    return stored.select("run_id", "class_fqn", "name", "path", F.array_join("messages", "|").alias("messages"))


_NUMBERED = """SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS iter
FROM events QUALIFY iter < 5"""
_FIRST = "min(CASE WHEN {p} THEN iter END)"


def _outcome_sql(passed: str) -> str:
    first = _FIRST.format(p=passed)
    return f"""SELECT user_id, {first} AS fixed_at,
    CAST(coalesce({first} + 1, least(count(*), 5)) AS INTEGER) AS attempts_used,
    arg_min(props, iter) FILTER (WHERE {passed}) AS final_patch,
    round((coalesce(min(epoch_us(ts)) FILTER (WHERE {passed}), max(epoch_us(ts))) - min(epoch_us(ts))) / 1e6, 2)
      AS elapsed_s FROM ({_NUMBERED}) GROUP BY user_id"""


_APPLIED_PASS = "event_type = 'purchase' AND event_id % 4 <> 0"
_DEPTH = """SELECT *, sum(delta) OVER w AS depth, row_number() OVER w AS position FROM (
SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS delta
FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""

QUERIES = {
    "attempts_capped": (
        attempts_capped,
        f"""SELECT user_id, event_id, iter, event_type FROM ({_NUMBERED}) a
        WHERE NOT EXISTS (SELECT 1 FROM ({_NUMBERED}) b WHERE b.user_id = a.user_id
          AND b.iter < a.iter AND b.event_type = 'purchase')""",
    ),
    "attempt_evidence": (
        attempt_evidence,
        f"""SELECT user_id, iter, coalesce(last_value(CASE WHEN event_type <> 'view' THEN props END IGNORE NULLS)
          OVER (PARTITION BY user_id ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'initial') AS seen,
        last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS)
          OVER (PARTITION BY user_id ORDER BY iter) AS after FROM ({_NUMBERED})""",
    ),
    "carry_forward": (
        carry_forward,
        """SELECT user_id, event_id, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_error FROM events""",
    ),
    "balanced_regions": (
        balanced_regions,
        f"""SELECT user_id, CAST(region_id AS BIGINT) AS region_id, min(position) AS start_pos, max(position) AS end_pos, count(*) AS n_rows,
        bool_or(is_close) AS is_closed, min(depth) < 0 AS is_negative FROM (
        SELECT *, sum(CAST(is_close AS INTEGER)) OVER (PARTITION BY user_id ORDER BY position)
          - CAST(is_close AS INTEGER) AS region_id
        FROM (SELECT *, depth = 0 AND coalesce(lag(depth) OVER (PARTITION BY user_id ORDER BY position), 0) > 0
          AS is_close FROM ({_DEPTH}))) GROUP BY user_id, region_id""",
    ),
    "repair_outcome": (
        repair_outcome,
        f"""SELECT c_custkey AS test_id, initial_summary,
        CASE initial_summary WHEN 'PASS' THEN 'skipped' WHEN 'COMPILATION_ERROR' THEN 'COMPILATION_ERROR'
          ELSE CASE WHEN fixed_at IS NULL THEN 'unresolved' ELSE 'fixed' END END AS status,
        fixed_at, CAST(coalesce(attempts_used, 0) AS INTEGER) AS attempts_used, final_patch, elapsed_s
        FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'PASS' WHEN 'FURNITURE'
          THEN 'COMPILATION_ERROR' ELSE 'FAILURE' END AS initial_summary FROM customer)
        LEFT JOIN ({_outcome_sql("event_type = 'purchase'")}) ON user_id = c_custkey AND initial_summary = 'FAILURE'""",
    ),
    "initial_status": (
        initial_status,
        """SELECT c_custkey AS test_id, 'FAILURE' AS initial_summary FROM customer
        WHERE c_mktsegment NOT IN ('MACHINERY', 'FURNITURE')""",
    ),
    "attempt_log_nested": (
        attempt_log_nested,
        f"""SELECT user_id, '{{' || string_agg('"' || iter || '":{{"event_id":' || event_id || ',"event_type":"'
        || event_type || '"}}', ',' ORDER BY iter) || '}}' AS log FROM ({_NUMBERED}) GROUP BY user_id""",
    ),
    "merge_maps": (
        merge_maps,
        """SELECT d.doc_id, lang, CASE WHEN quality IS NULL THEN source ELSE 'labelled' END AS source,
        CAST(quality AS VARCHAR) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "attempt_expiry": (
        attempt_expiry,
        f"""SELECT user_id AS test_id, fixed_at IS NOT NULL AS is_fixed, CAST(fixed_at AS INTEGER) AS fixed_at,
        CAST(coalesce(fixed_at + 1, n) AS INTEGER) AS attempts_used, fixed_at IS NOT NULL OR last_ts
          + INTERVAL {IDLE_HOURS} HOUR <= (SELECT max(ts) FROM events) - INTERVAL {DELAY_HOURS} HOUR AS is_final
        FROM (SELECT user_id, count(*) AS n, max(ts) AS last_ts,
          min(iter) FILTER (WHERE event_type = 'purchase' AND value > 150 AND event_id % 4 <> 0) AS fixed_at
          FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS iter FROM events)
          GROUP BY user_id)""",
    ),
    "attempt_stream": (
        attempt_stream,
        f"""SELECT o.user_id AS test_id, fixed_at IS NOT NULL AS is_fixed, fixed_at, attempts_used, final_patch,
        elapsed_s, last_evidence FROM ({_outcome_sql(_APPLIED_PASS)}) o
        JOIN (SELECT n.user_id, arg_max(event_type, iter) FILTER (WHERE event_id % 4 <> 0 AND iter < u) AS last_evidence
          FROM ({_NUMBERED}) n JOIN (SELECT user_id, attempts_used AS u FROM ({_outcome_sql(_APPLIED_PASS)})) a
          ON a.user_id = n.user_id GROUP BY n.user_id) e ON e.user_id = o.user_id""",
    ),
}
QUERIES["attempt_hand_over"] = (attempt_hand_over, QUERIES["attempt_stream"][1])
# a run without a report is emitted once the watermark has passed the last time one could come
QUERIES["live_reports"] = (
    live_reports,
    f"""WITH e AS (SELECT *, event_id % 3 * 20 AS late FROM events),
    mark AS (SELECT least(max(ts) FILTER (WHERE event_type = 'error'), max(ts + to_minutes(CAST(late AS INTEGER))))
      - INTERVAL {DELAY} MINUTE AS w FROM e)
    SELECT event_id AS run_id, 'org.shop.User' || user_id || 'Test' AS class_fqn, 'check' AS name,
    CASE WHEN late <= {WITHIN} THEN '/work/User' || user_id || '/run' || event_id || '/reports/sub/TEST-org.shop.User'
      || user_id || 'Test.xml' END AS path,
    CASE WHEN late <= {WITHIN} THEN CASE event_id % 4 WHEN 0 THEN 'run ' || event_id || ' failed twice'
      WHEN 1 THEN 'java.lang.Error ' || event_id WHEN 2 THEN ''
      ELSE 'java.lang.Error ' || event_id || '|run ' || event_id || ' failed twice' END END AS messages
    FROM e, mark WHERE event_type = 'error' AND (late <= {WITHIN} OR ts + INTERVAL {WITHIN} MINUTE < w)""",
)
