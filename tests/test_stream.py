"""The stream over several files equals the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from flakelens.operators import attempts
from flakelens.streaming import attempts as live
from flakelens.streaming.reports import reports_in_time


@pytest.mark.parametrize("backwards", [False, True])
def test_stream_over_batches_equals_batch(spark, tmp_path, backwards):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        user = 0 if rng.random() < 0.4 else rng.randint(1, 60)
        rows.append((user, i * 1_000_000, i, rng.random() < 0.15, f"p{i}"))
    schema = "user int, at long, i long, ok boolean, patch string"
    for part in range(3)[::-1] if backwards else range(3):
        chunk = rows[part * 200:(part + 1) * 200]
        rng.shuffle(chunk)
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.stateful_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    progress = live.track_attempts(
        stream, F.col("user"), F.timestamp_micros("at"), F.col("i"), F.col("ok"), F.col("patch"))
    stored = live.run_to_table(progress, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = live.latest_outcomes(stored)
    batch = attempts.loop_outcome(
        attempts.number_attempts(
            spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("at")), ["user"], ["at", "i"]),
        ["user"], F.col("ok"), F.col("patch"), "ts")
    key = lambda r: (r[0], r.is_fixed, r.fixed_at, r.attempts_used, r.final_patch, r.elapsed_s)
    assert sorted(map(key, got.collect())) == sorted(map(key, batch.collect()))
    # versions of a test are distinct, and only late attempts change a final outcome
    assert stored.groupBy("test_id", "version").count().filter("count > 1").isEmpty()
    if not backwards:
        revised = stored.groupBy("test_id").agg(F.sum(F.col("is_final").cast("int")).alias("n")).filter("n > 1")
        last = stored.filter("is_final").select("test_id", "is_fixed", "fixed_at", "attempts_used", "final_patch").distinct()
        assert last.join(revised, "test_id").groupBy("test_id").count().filter("count > 1").isEmpty()


def test_only_applied_attempts_pass_and_leave_evidence(spark, tmp_path):
    rows = [(1, 10, 1, False, True, "p1", "e1"), (1, 20, 2, True, False, "p2", "e2"), (1, 30, 3, True, True, "p3", "e3"),
            (2, 10, 4, True, False, "p4", "e4"), (3, 10, 5, False, True, "p5", "e5"), (3, 20, 6, False, False, "p6", "e6")]
    schema = "user int, at long, i long, ok boolean, used boolean, patch string, seen string"
    for row in reversed(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.stateful_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    progress = live.track_attempts(
        stream, F.col("user"), F.timestamp_micros("at"), F.col("i"), F.col("ok"), F.col("patch"),
        applied=F.col("used"), evidence=F.col("seen"))
    got = live.latest_outcomes(live.run_to_table(progress, str(tmp_path / "out"), str(tmp_path / "cp"))).collect()
    assert {(r.test_id, r.is_fixed, r.attempts_used, r.final_patch, r.last_evidence) for r in got} == {
        (1, True, 3, "p3", "e3"), (2, False, 1, None, None), (3, False, 2, None, "e5")}


HOUR = 3_600_000_000
SCHEMA = "user int, at long, i long, ok boolean, patch string"


def files(spark, folder, batches):
    """One file for each batch, in the order of their times."""
    import os
    import time

    for rows in batches:
        before = set(os.listdir(folder)) if folder.exists() else set()
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        stamp = time.time()
        for name in set(os.listdir(folder)) - before:
            os.utime(folder / name, (stamp, stamp))
        time.sleep(0.05)


def tracked(spark, tmp_path, name="run", **how):
    stream = live.stateful_session(spark).readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = live.attempt_rows(stream, F.col("user"), F.timestamp_micros("at"), F.col("i"), F.col("ok"), F.col("patch"))
    query = (
        live.track(rows, **how).writeStream.format("parquet").option("path", str(tmp_path / name))
        .option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    stored = spark.read.parquet(str(tmp_path / name))
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return stored, states


def test_idle_tests_are_given_up_by_event_time(spark, tmp_path):
    batches = [
        [(1, 1 * HOUR, 1, False, "a"), (2, 1 * HOUR, 2, True, "b"), (3, 2 * HOUR, 3, False, "c"), (4, 2 * HOUR, 4, False, "d")],
        [(3, 9 * HOUR, 5, False, "e"), (9, 10 * HOUR, 6, False, "f")],
        # the watermark is at 9 h
        [(4, 9 * HOUR + 1, 8, True, "h"), (9, 30 * HOUR, 9, False, "i")],
        # at 29 h tests 1 and 3 are given up; test 1's attempt comes too late to be seen; then 3 begins anew
        [(1, 2 * HOUR, 7, True, "g"), (9, 60 * HOUR, 10, False, "j")],
        [(3, 60 * HOUR, 11, True, "k"), (9, 61 * HOUR, 12, False, "l")],
    ]
    files(spark, tmp_path / "in", batches)
    stored, states = tracked(spark, tmp_path, idle_ms=20 * 3_600_000, delay="1 hour")
    got = {(r.test_id, r.is_fixed, r.attempts_used, r.final_patch, r.is_final)
           for r in live.latest_outcomes(stored.filter("test_id <> 3")).collect()}
    assert got == {(1, False, 1, None, True), (2, True, 1, "b", True), (4, True, 2, "h", True), (9, False, 4, None, False)}
    third = [(r.is_fixed, r.attempts_used, r.is_final) for r in stored.filter("test_id = 3").orderBy("version").collect()]
    assert third == [(False, 1, False), (False, 2, False), (False, 2, True), (True, 1, True)]
    # tests 3 and 9 alone have a state in the end
    assert max(states) > states[-1]


def test_nothing_is_given_up_in_time(spark, tmp_path):
    """Missing attempts leave tests open; without lateness the outcome is the batch form's."""
    rng = random.Random(4)
    rows = [(rng.randint(1, 25), HOUR + i * HOUR // 20, i, rng.random() < 0.1, f"p{i}") for i in range(300)]
    files(spark, tmp_path / "in", [rows[i : i + 100] for i in range(0, 300, 100)])
    stored, _ = tracked(spark, tmp_path, idle_ms=1000 * 3_600_000, delay="2 hours")
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("at"))
    want = attempts.loop_outcome(attempts.number_attempts(batch, ["user"], ["at", "i"]), ["user"], F.col("ok"), F.col("patch"), "ts")
    key = lambda r: (r[0], r.is_fixed, r.fixed_at, r.attempts_used, r.final_patch, r.elapsed_s)
    assert sorted(map(key, live.latest_outcomes(stored).collect())) == sorted(map(key, want.collect()))


def test_history_and_stream_equal_one_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randint(1, 40), i * HOUR, i, rng.random() < 0.1, f"p{i}") for i in range(300)]
    old, new = rows[:120], rows[120:]
    # tests 1 to 5 only have history, 36 to 40 only come later
    old, new = [r for r in old if r[0] <= 35], [r for r in new if r[0] > 5]
    files(spark, tmp_path / "in", [new[60:], new[:60]])
    own = live.stateful_session(spark)
    history = live.attempt_rows(
        own.createDataFrame(old, SCHEMA), F.col("user"), F.timestamp_micros("at"), F.col("i"), F.col("ok"), F.col("patch"))
    stream = own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fresh = live.attempt_rows(stream, F.col("user"), F.timestamp_micros("at"), F.col("i"), F.col("ok"), F.col("patch"))
    stored = live.run_to_table(live.track(fresh, history=history), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = live.latest_outcomes(live.with_history(stored, history))
    batch = spark.createDataFrame(old + new, SCHEMA).withColumn("ts", F.timestamp_micros("at"))
    want = attempts.loop_outcome(attempts.number_attempts(batch, ["user"], ["at", "i"]), ["user"], F.col("ok"), F.col("patch"), "ts")
    key = lambda r: (r[0], r.is_fixed, r.fixed_at, r.attempts_used, r.final_patch, r.elapsed_s)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_one_way_of_dropping_a_test(spark, tmp_path):
    with pytest.raises(ValueError, match="by the clock or by event time"):
        live.track(spark.createDataFrame([], live.INPUT), ttl_ms=1, idle_ms=1)


def test_live_reports_in_time_equal_the_batch_form(spark, tmp_path):
    """Runs and reports arrive in several files each, in an order of their own."""
    from flakelens.operators import evidence
    from flakelens.queries import derived
    from flakelens.streaming import reports as live_runs

    sf = "/root/testdata/sf0.001"
    logs = derived.run_logs(spark, sf)
    folders = evidence.report_folders(evidence.mined_logs(logs))
    want = evidence.messages_of_runs(evidence.reports_of_runs(folders, derived.reports(spark, sf)))
    run = F.regexp_extract("path", r"/run(\d+)/", 1).cast("long")
    times = logs.select(F.col("run_id").alias("run"), F.col("ts").cast("timestamp").alias("ts"))
    runs = folders.join(times, folders["run_id"] == times["run"]).drop("run").withColumnRenamed("ts", "ended")
    reports = live_runs.report_messages(
        derived.reports(spark, sf).withColumn("run", run).join(times, "run").withColumn("written", F.col("ts") + F.expr("INTERVAL 1 MINUTE")))
    own = live.stateful_session(spark)
    streams = []
    for name, table, order in (("runs", runs, "ended"), ("reports", reports, "written")):
        table.repartitionByRange(3, order).sortWithinPartitions(order).write.parquet(str(tmp_path / name))
        streams.append(own.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / name)))
    found = live_runs.reports_in_time(*streams, "30 MINUTES", "40 days")
    stored = live.run_to_table(found, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = live_runs.messages_of_runs(stored)
    key = lambda r: (r.run_id, tuple(r.messages))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and want.count() > 50


@pytest.mark.parametrize("limit", [3, 200])
def test_history_is_handed_over_as_one_row_of_a_test(spark, limit):
    rows = [(u, i * 1_000_000, i, i % 7 == 6, True, None if i % 5 == 0 else f"p{i}", "e") for u in (1, 2) for i in range(9)]
    history = spark.createDataFrame(rows + rows[:2], live.INPUT).repartition(4)
    states = {r.test_id: r for r in live._first_states(history, limit).collect()}
    assert sorted(states) == [1, 2]
    want = sorted(rows[:9] + rows[:2], key=lambda r: r[1:3])[:limit]
    got = list(zip(*[states[1][c] for c in live._COLUMNS], strict=True))
    assert got == [r[1:] for r in want]


def test_many_attempts_of_a_test_go_as_frames(spark):
    rows = [(1, i * 1_000_000, i, i == 150, True, f"p{i}", None) for i in range(180)]
    attempts_ = spark.createDataFrame(rows, live.INPUT)
    few, many = (live.track(attempts_, limit).collect()[0] for limit in (live._FEW, live._FEW * 2))
    assert (few.is_fixed, few.attempts_used, few.elapsed_s) == (False, live._FEW, live._FEW - 1.0)
    assert (many.is_fixed, many.fixed_at, many.attempts_used, many.final_patch) == (True, 150, 151, "p150")


def test_a_waiting_report_is_held_without_the_names_of_its_folders(spark):
    runs = spark.sql("""select * from values (1, 'a.B', 't', '/w/x/', timestamp'2024-01-01 00:00:00'),
        (2, 'a.B', 't', '/w/xx', timestamp'2024-01-01 00:00:00'), (3, 'a', 't', '/', timestamp'2024-01-01 00:00:00'),
        (4, 'a.B', 't', null, timestamp'2024-01-01 00:00:00') as r(run_id, class_fqn, name, report_dir, ended)""")
    said = "array(named_struct('class_fqn', 'a.B', 'name', 't', 'messages', array('m')), named_struct('class_fqn', 'a.B', 'name', 'u', 'messages', array('n')))"
    reports = spark.sql(f"""select path, timestamp'2024-01-01 00:00:00' as written, {said} as cases
        from values ('/w/x/d/TEST-a.B.xml'), ('/w/TEST-a.B.xml'), ('/w/x/TEST-a.Bc.xml') as p(path)""")
    found = reports_in_time(runs, reports, "30 MINUTES", "5 minutes")
    got = sorted(((r.run_id, r.path, r.messages) for r in found.collect()), key=str)
    assert got == [
        (1, "/w/x/d/TEST-a.B.xml", ["m"]), (2, None, None), (3, "/w/TEST-a.B.xml", []), (3, "/w/x/TEST-a.Bc.xml", []),
        (3, "/w/x/d/TEST-a.B.xml", []), (4, None, None)]
    keys = found._jdf.queryExecution().analyzed().toString()
    assert "_place" in keys and "_dir" not in keys.replace("report_dir", "")


def test_reports_wait_only_in_places_that_runs_can_name(spark, tmp_path):
    """Rows are those of all places, and reports that wait nowhere move event time on as before."""
    from flakelens.streaming import reports as live_runs

    runs = spark.sql("""select id, class_fqn, 't' as name, dir as report_dir, to_timestamp(at) as ended from values
        (1, 'a.B', '/w/x/', '2024-01-01 00:00:00'), (2, 'a', '/w/y', '2024-01-01 00:00:00'), (3, 'a.B', '/w/z', '2024-01-01 09:00:00'),
        (4, 'a.B', null, '2024-01-01 00:00:00'), (5, 'a.B', '/w/u', '2024-01-01 00:00:00') as r(id, class_fqn, dir, at)""").withColumnRenamed("id", "run_id")
    reports = spark.sql("""select path, to_timestamp(at) as written, array(named_struct('class_fqn', 'a.B', 'name', 't', 'messages', array('m'))) as cases
        from values ('/w/x/d/e/TEST-a.B-2.xml', '2024-01-01 00:10:00'), ('/w/y/TEST-a.B.xml', '2024-01-01 00:10:00'),
        ('/w/TEST-a.B.xml', '2024-01-01 00:10:00'), ('/TEST-z.xml', '2024-01-01 09:00:00') as p(path, at)""")
    places = live_runs.asked_places(runs)
    assert places == {"depths": [3], "words": [1, 2]}
    listed = live_runs.evidence.listed_reports(reports, **places)
    assert listed.count() == 4 and live_runs.evidence.listed_reports(reports).count() == 26
    own = live.stateful_session(spark)
    streams = []
    for name, table in (("runs", runs), ("reports", reports)):
        table.coalesce(1).write.parquet(str(tmp_path / name))
        streams.append(own.readStream.schema(table.schema).parquet(str(tmp_path / name)))
    found = reports_in_time(*streams, "30 MINUTES", "5 minutes", **places)
    got = live.run_to_table(found, str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    want = reports_in_time(runs, reports, "30 MINUTES", "5 minutes").collect()
    key = lambda r: (r.run_id, r.path, r.messages)
    # run 3 ends too late to be given up
    assert sorted(map(key, got), key=str) == sorted((key(r) for r in want if r.run_id != 3), key=str)
    assert [r.messages for r in want if r.run_id in (1, 2, 5)].count(["m"]) == 1 and len(want) == 5


def test_the_stream_of_reports_takes_over_the_number_of_partitions(spark, tmp_path, monkeypatch):
    from flakelens.queries import loop

    monkeypatch.setattr(loop, "scratch_dir", lambda _, name: str(tmp_path / name))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        loop.live_reports(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    states = tmp_path / "live-reports" / "checkpoint" / "state" / "0"
    assert sorted(d.name for d in states.iterdir() if d.name.isdigit()) == ["0", "1", "2"]
