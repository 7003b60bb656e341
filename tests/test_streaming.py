"""Streams must agree with their batch twins on the same events."""

import os

from pyspark.sql import functions as F

from rollbook.sources.tables import BASE_SCHEMAS
from rollbook.streaming import logs as S


def stream(spark, tmp_path, df, schema):
    src = str(tmp_path / "src")
    df.coalesce(1).write.mode("overwrite").parquet(src)
    return spark.readStream.schema(schema).parquet(src)


def run(df, tmp_path, mode="append"):
    name = "out_" + os.path.basename(str(tmp_path)).replace("-", "_")
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_throttle(spark, views, tmp_path):
    batch = S.throttle(views.f_login.filter("user_id < 1000"))
    want = {r["event_id"]: r["user_failures"] >= S.USER_LIMIT for r in batch.collect()}
    src = stream(spark, tmp_path, views.events, BASE_SCHEMAS["events"])
    logins = src.select("event_id", "ts", "user_id", (F.col("event_type") == "error").alias("failed"))
    got = {r["event_id"]: r["refused"] for r in run(S.throttle_stream(logins), tmp_path).collect()}
    assert got == want


def test_throttle_by_hand(spark):
    rows = [(i, f"2026-01-05 10:{i:02d}:00", True) for i in range(7)] + [(7, "2026-01-05 10:07:30", False), (8, "2026-01-05 10:08:00", True), (9, "2026-01-05 10:40:00", True)]
    df = spark.createDataFrame(rows, "event_id long, ts string, failed boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("user_id", F.lit(1)).withColumn("ip_id", F.lit(1))
    got = {r["event_id"]: (r["user_failures"], r["ip_failures"], r["refused"]) for r in S.throttle(df).collect()}
    # refused attempts are recorded nowhere, and a refused success clears nothing
    assert got[5] == (5, 5, False) and got[6] == got[7] == got[8] == (6, 6, True) and got[9] == (0, 0, False)


def test_throttle_counts_earlier_ones_of_the_same_instant(spark):
    df = spark.range(9).select(F.col("id").alias("event_id"), F.lit("2026-01-05 10:00:00").cast("timestamp_ntz").alias("ts"), F.lit(True).alias("failed"), F.lit(1).alias("user_id"), F.lit(1).alias("ip_id"))
    got = {r["event_id"]: (r["user_failures"], r["refused"]) for r in S.throttle(df).collect()}
    assert got == {i: (min(i, S.USER_LIMIT), i >= S.USER_LIMIT) for i in range(9)}


def test_activity_counts(spark, views, tmp_path):
    want = {(r[0], r[1]): r[2] for r in S.activity_counts(views.f_activity).collect()}
    src = stream(spark, tmp_path, views.events, BASE_SCHEMAS["events"]).select(F.col("ts").alias("created_at"), F.col("event_type").alias("entity_type"))
    got = {(r[0], r[1]): r[2] for r in run(S.activity_counts(src, late="10 minutes"), tmp_path, "complete").collect()}
    assert got == want


def test_job_progress(spark, views, tmp_path):
    def shape(df):
        return df.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("stage"), F.col("ts").alias("created_at"), F.col("event_id").alias("log_id"))

    want = sorted(map(tuple, S.job_progress(shape(views.events)).collect()))
    src = stream(spark, tmp_path, views.events, BASE_SCHEMAS["events"])
    assert sorted(map(tuple, run(S.job_progress(shape(src)), tmp_path, "complete").collect())) == want


def test_dedupe(spark, views, tmp_path):
    twice = views.events.unionByName(views.events)
    src = stream(spark, tmp_path, twice, BASE_SCHEMAS["events"])
    got = [r["event_id"] for r in run(S.dedupe_events(src), tmp_path).collect()]
    assert sorted(got) == sorted(r["event_id"] for r in views.events.select("event_id").collect())


def test_stale(spark, tmp_path):
    rows = [(1, "PROCESSING", "2026-01-05 10:00:00"), (2, "QUEUED", "2026-01-05 10:00:00"), (2, "PUBLISHED", "2026-01-05 10:05:00"), (3, "QUEUED", "2026-01-05 12:00:00")]
    df = spark.createDataFrame(rows, "doc_id long, status string, updated_at string").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    src = stream(spark, tmp_path, df, "doc_id long, status string, updated_at timestamp")
    assert [r["doc_id"] for r in run(S.stale_stream(src), tmp_path).collect()] == [1]


# ---------------------------------------------------------------- refused attempts


def plain_throttle(rows, minutes, user_limit, ip_limit):
    """The limiter as a loop: {event_id: (user failures, address failures, refused)}."""
    users, ips, out = {}, {}, {}
    span = minutes * 60
    for event_id, at, user, ip, failed in sorted(rows, key=lambda r: (r[1], r[0])):
        u = users[user] = [t for t in users.get(user, []) if at - t < span]
        i = ips[ip] = [t for t in ips.get(ip, []) if at - t < span]
        refused = len(u) >= user_limit or len(i) >= ip_limit
        out[event_id] = (len(u), len(i), refused)
        if refused:
            continue
        if failed:
            u.append(at)
            i.append(at)
        else:
            users[user] = []
    return out


def attempts(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, at long, user_id long, ip_id long, failed boolean")
    return df.select("event_id", F.timestamp_seconds(F.col("at") + 1_767_600_000).alias("ts"), "user_id", "ip_id", "failed")


def busy(seed, n=400):
    import random

    r = random.Random(seed)
    # few users and addresses, times that often fall together, some users on two addresses
    rows = []
    for k in range(n):
        user = r.randrange(12)
        rows.append((k, r.randrange(0, 6 * 3600, 30), user, (user % 4) if r.random() < 0.8 else r.randrange(4), r.random() < 0.8))
    return rows


def test_throttle_with_refusals_equals_a_loop(spark):
    for seed in (1, 2):
        rows = busy(seed)
        want = plain_throttle(rows, 15, 3, 7)
        assert sum(x[2] for x in want.values()) > 20
        got = {r["event_id"]: (r["user_failures"], r["ip_failures"], r["refused"]) for r in S.throttle(attempts(spark, rows), 15, 3, 7).collect()}
        assert got == want


def test_a_refused_good_password_clears_nothing(spark):
    rows = [(i, 60 * i, 1, 1, True) for i in range(6)]
    # refused though the password is good, then again, then let in when the first failures have gone
    rows += [(6, 400, 1, 1, False), (7, 410, 1, 1, True), (8, 900, 1, 1, False), (9, 910, 1, 1, True)]
    got = {r["event_id"]: (r["user_failures"], r["ip_failures"], r["refused"]) for r in S.throttle(attempts(spark, rows)).collect()}
    assert got == plain_throttle(rows, 15, S.USER_LIMIT, S.IP_LIMIT)
    assert got[6] == (6, 6, True) and got[7] == (6, 6, True) and got[8] == (5, 5, False) and got[9] == (0, 5, False)


def test_equal_times_count_by_id(spark):
    rows = [(i, 0, 1, 1, True) for i in range(9)] + [(20, 0, 2, 1, False), (21, 0, 2, 1, True)]
    got = {r["event_id"]: (r["user_failures"], r["ip_failures"], r["refused"]) for r in S.throttle(attempts(spark, rows)).collect()}
    assert got == plain_throttle(rows, 15, S.USER_LIMIT, S.IP_LIMIT)


def test_throttle_of_nothing_busy(spark):
    rows = [(i, 3600 * i, i % 3, i % 2, True) for i in range(12)]
    got = S.throttle(attempts(spark, rows)).collect()
    assert not any(r["refused"] for r in got) and len(got) == 12


def test_sequence_stream_equals_batch(spark, tmp_path):
    rows = busy(3)
    df = attempts(spark, rows).withColumn("server", F.lit(1).cast("long"))
    src = stream(spark, tmp_path, df, "event_id long, ts timestamp, user_id long, ip_id long, failed boolean, server long")
    out = run(S.throttle_stream(src, by="server", user_limit=3, ip_limit=7), tmp_path)
    want = {r["event_id"]: r["refused"] for r in S.throttle(attempts(spark, rows), 15, 3, 7).collect()}
    assert {r["event_id"]: r["refused"] for r in out.collect()} == want


def test_state_of_idle_keys_goes(spark):
    counter = S._Counter(900 * 1_000_000, 6, 40)
    for k in range(50):
        assert not counter.refuses(k, k, True, k * 1_000_000)
    assert len(counter.times) == 100
    counter.forget(949 * 1_000_000)
    assert counter.times == {}


def test_stream_forgets_when_the_watermark_passes(spark, tmp_path):
    """Files one after the other: the timer of the first burst fires before the last file, whose attempt starts afresh."""
    src = str(tmp_path / "src")
    bursts = [[(i, i, 1, 1, True) for i in range(6)], [(10, 7200, 2, 1, True)], [(11, 14_400, 1, 1, True)]]
    for k, rows in enumerate(bursts):
        attempts(spark, rows).withColumn("server", F.lit(1).cast("long")).coalesce(1).write.parquet(f"{src}/{k}")
    schema = "event_id long, ts timestamp, user_id long, ip_id long, failed boolean, server long"
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    out = {r["event_id"]: r["refused"] for r in run(S.throttle_stream(read, by="server"), tmp_path).collect()}
    assert out == {**{i: False for i in range(6)}, 10: False, 11: False}
    state = spark.read.format("statestore").option("stateVarName", "times").load(str(tmp_path / "cp")).collect()
    assert len(state) <= 2 * 2


# ---------------------------------------------------------------- live status


def test_live_status_stream_equals_batch(spark, tmp_path):
    blocks = [(1, 5, 0, 480, 520, 0, 1, "Maths"), (1, 5, 0, 500, 560, 1, 2, "Extra"), (1, 5, 0, 600, 640, 0, 3, "Art"), (1, 6, 0, 480, 480, 0, 4, "Nothing"), (1, 6, 1, 480, 500, 0, 5, "Tuesday"), (2, 5, 0, 500, 505, 0, 6, "Other")]
    blocks = spark.createDataFrame(blocks, "school_id int, teacher_id long, day_idx int, start_min int, end_min int, kind int, seq long, label string")
    ticks = spark.createDataFrame([(s, 100_000 * d + 10 * m + s, d, m) for s in (1, 2) for d in (0, 1) for m in (0, 470, 479, 480, 499, 500, 504, 505, 519, 520, 559, 560, 599, 600, 640, 1439)], "school_id int, tick int, day_idx int, now_min int")
    want = sorted(map(str, map(tuple, S.live_day_status(ticks, blocks).collect())))
    segments = S.day_segments(blocks)
    assert sorted(map(str, map(tuple, S.live_status(ticks, segments).collect()))) == want
    src = stream(spark, tmp_path, ticks, "school_id int, tick int, day_idx int, now_min int")
    out = run(S.live_status(src, segments), tmp_path, "update")
    assert sorted(map(str, map(tuple, out.collect()))) == want


def test_segments_fill_the_day(spark):
    blocks = spark.createDataFrame([(1, 5, 0, 480, 520, 0, 1, "A"), (1, 5, 0, 480, 520, 0, 2, "A again"), (1, 5, 0, 490, 500, 1, 3, "B")], "school_id int, teacher_id long, day_idx int, start_min int, end_min int, kind int, seq long, label string")
    got = sorted((r["from_min"], r["to_min"], r["status"], r["label"]) for r in S.day_segments(blocks).collect())
    assert got[0][0] == 0 and got[-1][1] == 1440 and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert (490, 500, "in-class", "A") in got and got[-1][2] == "day-done"


def test_no_frame_is_counted_anew_for_every_attempt(spark):
    rows = spark.range(3).selectExpr("id AS event_id", "id AS user_id", "id AS ip_id", "true AS _hit", "false AS _clear", "id AS _at")
    for clears in (True, False):
        plan = S._failures_before(rows, "user_id", clears, 15, "n")._jdf.queryExecution().optimizedPlan().toString()
        assert "RangeFrame" not in plan and "unboundedpreceding$()" in plan
