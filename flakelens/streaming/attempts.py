"""Live tracker of repair attempts.

State per test: its earliest attempts by event time, at most the allowed number,
with their evidence.  The outcome depends on these alone, and the earliest of two
sets are among the earliest of each, so it does not matter in which order attempts
arrive or how they fall into batches.  A progress row is emitted whenever the
outcome changes; ``is_final`` says that a pass or the last allowed attempt is
reached.  An attempt that arrives late with an earlier time revises the outcome
and is emitted with a higher ``version``.

A test can be given up by event time: once the watermark is ``idle`` past its last
attempt, an open test is emitted as final and unresolved and the state of any test is
freed.  Versions go on from the watermark, so a test that begins anew after that has
higher ones.  Earlier attempts held in a table can be handed over as the first state.

Before the state operator each map task reduces a batch to the earliest few
attempts per test.  A test that sends most of a batch therefore reaches its
state task as a handful of rows per map-side Arrow batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules

INPUT = (
    "test_id long, attempt_ts long, attempt_no long, is_pass boolean, applied boolean, patch string, evidence string"
)
OUTPUT = (
    "test_id long, is_fixed boolean, fixed_at int, attempts_used int, final_patch string, "
    "last_evidence string, elapsed_s double, is_final boolean, version long"
)
_STATE = (
    "stamps array<bigint>, numbers array<bigint>, passes array<boolean>, applied array<boolean>, "
    "patches array<string>, evidence array<string>, version bigint"
)
_COLUMNS = ("attempt_ts", "attempt_no", "is_pass", "applied", "patch", "evidence")
_FEW = 100  # attempts a test that are cheaper as rows; more are handed over as a data frame
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that the tracker needs."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return own


def _reducer(limit: int):
    def earliest(batches):
        for pdf in batches:
            pdf = pdf.sort_values(["test_id", "attempt_ts", "attempt_no"], kind="stable")
            yield pdf.groupby("test_id", sort=False).head(limit)

    return earliest


def _processor(limit: int, ttl_ms: int | None, idle_ms: int | None = None):
    # defined in a function so that workers get the class by value
    import pandas as pd
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    class Tracker(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("attempts", _STATE, ttl_ms)

        def handleInitialState(self, key, initialState, timerValues):
            # one row for each test: the state is new
            first = initialState if limit <= _FEW else initialState.iloc[0]
            seen = list(zip(*[list(first[c]) for c in _COLUMNS], strict=True))
            self._keep(seen, self._begun(timerValues), None)

        def handleInputRows(self, key, rows, timerValues):
            before, version = self._held(timerValues)
            seen = sorted([*before, *self._rows(rows)], key=lambda a: a[:2])[:limit]
            if seen == before:
                return
            self._keep(seen, version + 1, before[-1][0] if before else None)
            yield self._progress(key, seen, version + 1, False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            seen, version = self._held(timerValues)
            row = self._progress(key, seen, version + 1, True)
            is_open = not self._is_settled(seen)
            self.state.clear()
            if is_open:
                yield row

        def _rows(self, rows):
            if limit <= _FEW:
                return [tuple(r[c] for c in _COLUMNS) for r in rows]
            return [a for pdf in rows for a in zip(*[pdf[c].tolist() for c in _COLUMNS], strict=True)]

        def _begun(self, timerValues):
            return max(int(timerValues.getCurrentWatermarkInMs()), 0) if idle_ms else 0

        def _held(self, timerValues):
            held = self.state.get()
            if held is None:
                return [], self._begun(timerValues)
            *columns, version = held
            return list(zip(*columns, strict=True)), version

        def _keep(self, seen, version, last):
            self.state.update((
                [int(a[0]) for a in seen], [int(a[1]) for a in seen],
                [bool(a[2]) for a in seen], [bool(a[3]) for a in seen],
                [a[4] for a in seen], [a[5] for a in seen], version,
            ))
            if idle_ms and last != seen[-1][0]:
                # the one timer of a test is that of its last attempt
                if last is not None:
                    self.handle.deleteTimer(self._until(last))
                self.handle.registerTimer(self._until(seen[-1][0]))

        def _until(self, stamp):
            return int(stamp) // 1000 + idle_ms

        def _is_settled(self, seen):
            return len(seen) >= limit or any(a[2] and a[3] for a in seen)

        def _progress(self, key, seen, version, is_given_up):
            at = next((i for i, a in enumerate(seen) if a[2] and a[3]), None)
            used = len(seen) if at is None else at + 1
            kept = seen[:used]
            stamps = [a[0] for a in kept]
            out = {
                "test_id": key[0],
                "is_fixed": at is not None,
                "fixed_at": at,
                "attempts_used": used,
                "final_patch": None if at is None else kept[at][4],
                "last_evidence": next((a[5] for a in reversed(kept) if a[3]), None),
                "elapsed_s": round((stamps[-1] - min(stamps)) / 1e6, 2),
                "is_final": is_given_up or self._is_settled(seen),
                "version": version,
            }
            if limit <= _FEW:
                return Row(**out)
            return pd.DataFrame({c: pd.array([v], dtype="Int32") if c == "fixed_at" else [v] for c, v in out.items()})

        def close(self):
            pass

    return Tracker()


def attempt_rows(df: DataFrame, test_id: Column, ts: Column, number: Column, is_pass: Column, patch: Column,
                 applied: Column | None = None, evidence: Column | None = None) -> DataFrame:
    """Attempts as the tracker takes them; only applied ones (by default all) can pass and
    leave evidence (text)."""
    return df.select(
        test_id.cast("long").alias("test_id"),
        F.unix_micros(ts.cast("timestamp")).alias("attempt_ts"),
        number.cast("long").alias("attempt_no"),
        is_pass.alias("is_pass"),
        (F.lit(True) if applied is None else applied).alias("applied"),
        patch.alias("patch"),
        (F.lit(None) if evidence is None else evidence).cast("string").alias("evidence"),
    )


def track(attempts: DataFrame, limit: int = rules.MAX_ATTEMPTS, ttl_ms: int | None = None,
          idle_ms: int | None = None, delay: str = "0 seconds", history: DataFrame | None = None) -> DataFrame:
    """Attempts (``attempt_rows`` of a stream or a table) to progress rows per test.

    A stream's session must come from ``stateful_session``.  ``ttl_ms`` drops the state
    of tests that have been idle that long by the clock; an attempt after that starts
    the test anew.  ``idle_ms`` gives tests up by event time: attempts that are later
    than the watermark (``delay`` behind the newest) are not seen any more.  ``history``
    (``attempt_rows`` of a table) is what came before the stream.
    """
    if ttl_ms and idle_ms:
        raise ValueError("a test is dropped either by the clock or by event time")
    rows = attempts.mapInPandas(_reducer(limit), INPUT)
    mode = "None"
    if ttl_ms:
        mode = "ProcessingTime"
    if idle_ms:
        mode = "EventTime"
        rows = rows.withColumn("event_time", F.timestamp_micros("attempt_ts")).withWatermark("event_time", delay)
    before = None if history is None else _first_states(history, limit).groupBy("test_id")
    tests = rows.groupBy("test_id")
    run = tests.transformWithState if limit <= _FEW else tests.transformWithStateInPandas
    return run(
        statefulProcessor=_processor(limit, ttl_ms, idle_ms), outputStructType=OUTPUT,
        outputMode="Append", timeMode=mode, initialState=before,
    )


def _first_states(history: DataFrame, limit: int) -> DataFrame:
    """The earliest attempts of each test as one row of lists."""
    entry = F.struct("attempt_ts", "attempt_no", *_COLUMNS[2:])
    listed = history.mapInPandas(_reducer(limit), INPUT).groupBy("test_id").agg(
        F.slice(
            F.array_sort(
                F.collect_list(entry),
                lambda a, b: F.when(a["attempt_ts"] != b["attempt_ts"], F.signum(a["attempt_ts"] - b["attempt_ts"]))
                .otherwise(F.signum(a["attempt_no"] - b["attempt_no"])).cast("int"),
            ), 1, limit,
        ).alias("_a")
    )
    # fields of an array of structs, as arrays
    return listed.select("test_id", *[F.col("_a")[c].alias(c) for c in _COLUMNS])


def track_attempts(stream: DataFrame, test_id: Column, ts: Column, number: Column,
                   is_pass: Column, patch: Column, limit: int = rules.MAX_ATTEMPTS,
                   ttl_ms: int | None = None, applied: Column | None = None,
                   evidence: Column | None = None) -> DataFrame:
    """``track`` of a stream given by its columns."""
    return track(attempt_rows(stream, test_id, ts, number, is_pass, patch, applied, evidence), limit, ttl_ms)


def with_history(progress: DataFrame, history: DataFrame, limit: int = rules.MAX_ATTEMPTS) -> DataFrame:
    """Progress rows of a stream and of what came before it, which have version 0.

    Tests that the stream says nothing of keep the outcome of their history.
    """
    before = track(history, limit).withColumn("version", F.lit(0).cast("long"))
    return progress.unionByName(before)


def latest_outcomes(progress: DataFrame) -> DataFrame:
    """Last progress row per test of a stored tracker output."""
    values = [c for c in progress.columns if c not in ("test_id", "version")]
    picked = progress.groupBy("test_id").agg(
        F.max_by(F.struct(*values), F.col("version")).alias("_p")
    )
    return picked.select("test_id", "_p.*")


def run_to_table(progress: DataFrame, out_dir: str, checkpoint_dir: str) -> DataFrame:
    """Process what is available, store the progress rows and read them back."""
    query = (
        progress.writeStream.format("parquet").outputMode("append")
        .option("path", out_dir).option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return progress.sparkSession.read.schema(progress.schema).parquet(out_dir)
