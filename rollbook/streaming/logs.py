"""Log jobs as Structured Streaming queries, each with a batch twin that gives the same answer on stored events."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rollbook.links import components
from rollbook.operators.timeline import day_status
from rollbook.session import cut_lineage

# Failed sign-ins allowed per user and per address within the window, minutes until a job is stale.
USER_LIMIT, IP_LIMIT, WINDOW_MINUTES, STALE_MINUTES = 6, 40, 15, 20


# ---------------------------------------------------------------- S1: sign-in throttle


def _failures_before(events: DataFrame, key: str, clears: bool, minutes: int, name: str) -> DataFrame:
    """Recorded failures of the key in the minutes before each event; a success that was let in starts the count anew when
    `clears`.

    Events are cut into windows' lengths and each also visits the next cut, so a count never needs more than two
    cuts of one key and a very busy key is still many tasks."""
    span = minutes * 60_000_000
    rows = events.select("event_id", key, "_hit", "_clear", "_at").withColumn("_cut", F.floor(F.col("_at") / span))
    rows = rows.withColumn("_visit", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_part", F.col("_cut") + F.col("_visit"))
    part = [key, "_part"]
    if clears:
        before = Window.partitionBy(*part).orderBy("_at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_run", F.coalesce(F.sum(F.col("_clear").cast("int")).over(before), F.lit(0)))
        part.append("_run")
    # a failure adds one at its time and, in the next cut, takes it back when it is too old, before the events of that instant: one
    # running sum, where a frame of the minutes before would be counted anew for every event
    step = F.struct(F.col("_at").alias("_t"), F.lit(1).alias("_turn"), F.col("_hit").cast("int").alias("_n"))
    gone = F.struct((F.col("_at") + span).alias("_t"), F.lit(0).alias("_turn"), F.lit(-1).alias("_n"))
    steps = rows.filter("_visit = 0 OR _hit").select("event_id", *part, "_visit", F.explode(F.when(F.col("_visit") == 1, F.array(step, gone)).otherwise(F.array(step))).alias("_s")).select("event_id", *part, "_visit", "_s.*")
    ahead = Window.partitionBy(*part).orderBy("_t", "_turn", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn(name, F.coalesce(F.sum("_n").over(ahead), F.lit(0).cast("long"))).filter("_visit = 0").select("event_id", name)


def _busy_cells(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """(cell, key, _cut): cuts of a key in which it may reach its limit, as two cuts next to each other hold that many failures, and
    the cuts just before them. A key that is never so busy refuses nobody, whatever happens elsewhere."""
    counts = rows.filter("failed").groupBy(key, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    both = counts.select(key, F.explode(F.array("_cut", F.col("_cut") + 1)).alias("_cut"), "_n").groupBy(key, "_cut").agg(F.sum("_n").alias("_n"))
    cuts = both.filter(F.col("_n") >= limit).select(key, F.explode(F.array("_cut", F.col("_cut") - 1)).alias("_cut")).distinct()
    return cuts.withColumn("cell", F.concat_ws("/", F.lit(key), F.col(key).cast("string"), F.col("_cut").cast("string")))


class _Counter:
    """The limiter's decisions over attempts in order: an attempt beyond a limit is refused and then recorded nowhere."""

    def __init__(self, span: int, user_limit: int, ip_limit: int):
        self.span, self.limits, self.times = span, (user_limit, ip_limit), {}

    def refuses(self, user, ip, failed: bool, at: int) -> bool:
        keys = ((0, user), (1, ip)) if ip is not None else ((0, user),)
        for k in keys:
            kept = [t for t in self.times.get(k, ()) if at - t < self.span]
            if kept:
                self.times[k] = kept
            else:
                self.times.pop(k, None)
        if any(len(self.times.get(k, ())) >= self.limits[k[0]] for k in keys):
            return True
        if failed:
            for k in keys:
                self.times.setdefault(k, []).append(at)
        else:
            self.times.pop(keys[0], None)
        return False

    def forget(self, at: int) -> None:
        """Drop keys without a failure that still counts."""
        self.times = {k: v for k, v in self.times.items() if at - v[-1] < self.span}


def _refused(rows: DataFrame, span: int, user_limit: int, ip_limit: int) -> DataFrame | None:
    """(event_id) of refused attempts; None if no key is ever busy.

    Only attempts in busy cells can be refused. Cells are tied by the attempts they share and by following each other; each
    tied group is one sequence in time order, whose state is the failures of the last minutes."""
    users, ips = (_busy_cells(rows, k, n) for k, n in (("user_id", user_limit), ("ip_id", ip_limit)))
    if users.select("cell").unionByName(ips.select("cell")).isEmpty():
        return None
    users, ips = cut_lineage(users), cut_lineage(ips)
    met = rows.join(users.withColumnRenamed("cell", "_u"), ["user_id", "_cut"], "left").join(ips.withColumnRenamed("cell", "_i"), ["ip_id", "_cut"], "left")
    met = cut_lineage(met.filter("_u IS NOT NULL OR _i IS NOT NULL").withColumn("_cell", F.coalesce("_u", "_i")))
    chains = [c.join(c.select(k, (F.col("_cut") + 1).alias("_cut"), F.col("cell").alias("_before")), [k, "_cut"], "left").select(F.col("cell").alias("a"), F.coalesce("_before", "cell").alias("b")) for c, k in ((users, "user_id"), (ips, "ip_id"))]
    ties = met.filter("_u IS NOT NULL AND _i IS NOT NULL").select(F.col("_u").alias("a"), F.col("_i").alias("b")).distinct()
    groups = components(chains[0].unionByName(chains[1]).unionByName(ties))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, counter = None, None
        for rows in batches:
            refused = []
            for event_id, g, user, ip, failed, at in zip(rows["event_id"], rows["component"], rows["user_id"], rows["ip_id"], rows["failed"], rows["_at"]):
                if g != group:
                    group, counter = g, _Counter(span, user_limit, ip_limit)
                if counter.refuses(user, ip, failed, at):
                    refused.append(event_id)
            if counter is not None:
                counter.forget(at)
            yield pd.DataFrame({"event_id": refused}, dtype="int64")

    line = met.join(groups.withColumnRenamed("node", "_cell"), "_cell").select("event_id", "component", "user_id", "ip_id", "failed", "_at")
    return line.repartition("component").sortWithinPartitions("component", "_at", "event_id").mapInPandas(run, "event_id long")


def throttle(events: DataFrame, minutes: int = WINDOW_MINUTES, user_limit: int = USER_LIMIT, ip_limit: int = IP_LIMIT) -> DataFrame:
    """S1 batch: for every attempt (event_id, ts, user_id, ip_id, failed) the recorded failures before it by user (a success
    clears them) and by address, and whether it is refused. A refused attempt is recorded by neither and clears nothing, even
    with a good password. Attempts of one instant count by event_id."""
    span = minutes * 60_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select("event_id", "user_id", "ip_id", "failed", at.alias("_at")).withColumn("_cut", F.floor(F.col("_at") / span))
    refused = _refused(rows, span, user_limit, ip_limit)
    if refused is None:
        rows = rows.withColumn("_let", F.lit(True))
    else:
        rows = cut_lineage(rows.join(refused.withColumn("_no", F.lit(True)), "event_id", "left").withColumn("_let", F.col("_no").isNull()))
    rows = rows.withColumn("_hit", F.col("failed") & F.col("_let")).withColumn("_clear", ~F.col("failed") & F.col("_let"))
    user = _failures_before(rows, "user_id", True, minutes, "user_failures")
    ip = _failures_before(rows, "ip_id", False, minutes, "ip_failures")
    return user.join(ip, "event_id").withColumn("refused", (F.col("user_failures") >= user_limit) | (F.col("ip_failures") >= ip_limit))


def _sequence(minutes: int, user_limit: int, ip_limit: int, by: str) -> StatefulProcessor:
    span = minutes * 60_000_000

    class Sequence(StatefulProcessor):
        """One sign-in server: the list of times of each user and address that still count, and a timer to forget them."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.times = handle.getListState("times", "kind int, id long, at long")

        def _load(self) -> _Counter:
            counter = _Counter(span, user_limit, ip_limit)
            for kind, id_, at in self.times.get():
                counter.times.setdefault((kind, id_), []).append(at)
            return counter

        def _store(self, counter: _Counter) -> None:
            rows = [(kind, id_, at) for (kind, id_), times in counter.times.items() for at in times]
            if rows:
                self.times.put(rows)
            else:
                self.times.clear()

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802
            counter = self._load()
            batch = pd.concat(list(rows)).sort_values(["at", "event_id"])
            ips = batch["ip_id"] if "ip_id" in batch else [None] * len(batch)
            refused = [counter.refuses(int(u), None if i is None else int(i), bool(f), int(a)) for u, i, f, a in zip(batch["user_id"], ips, batch["failed"], batch["at"])]
            last = int(batch["at"].max())
            counter.forget(last)
            self._store(counter)
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + span) // 1000 + 1)
            yield pd.DataFrame({"event_id": batch["event_id"], by: key[0], "refused": refused})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
            counter = self._load()
            counter.forget(timerValues.getCurrentWatermarkInMs() * 1000)
            self._store(counter)
            return iter(())

        def close(self) -> None:
            pass

    return Sequence()


def throttle_stream(events: DataFrame, by: str = "user_id", minutes: int = WINDOW_MINUTES, user_limit: int = USER_LIMIT, ip_limit: int = IP_LIMIT, late: str = "10 minutes") -> DataFrame:
    """S1 stream: (event_id, by, refused) per attempt, by the same rules as the batch.

    `by` names one sequence of attempts, as one sign-in server sees them: every user and address must keep to one value of it.
    Without a column ip_id only users are counted, and every user may be a sequence. A micro-batch is taken in time order;
    state holds the failures that still count and is dropped when the watermark passes the last of them."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    kept = dict.fromkeys(["event_id", "ts", by, "user_id", *(["ip_id"] if "ip_id" in events.columns else []), "failed"])
    rows = rows.select(*kept, F.unix_micros("ts").alias("at"))
    return rows.groupBy(by).transformWithStateInPandas(_sequence(minutes, user_limit, ip_limit, by), f"event_id long, {by} long, refused boolean", "Append", "EventTime")


def failure_windows(events: DataFrame, minutes: int = WINDOW_MINUTES, slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """S1 stream without Python: failures per user and sliding window, for dashboards (window edges by the minute)."""
    rows = events.filter("failed").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", f"{minutes} minutes", slide), "user_id").agg(F.count(F.lit(1)).alias("failures"))


# ---------------------------------------------------------------- S2, S3: extraction jobs


def stale_jobs(jobs: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """S2 batch: queued or running jobs without an update for too long become FAILED."""
    stale = F.col("status").isin("QUEUED", "PROCESSING") & (F.col("updated_at") < now - F.make_interval(mins=F.lit(minutes)))
    return jobs.withColumn("stage", F.when(stale, F.lit("Failed")).otherwise(F.col("stage"))).withColumn("status", F.when(stale, F.lit("FAILED")).otherwise(F.col("status")))


class _Stale(StatefulProcessor):
    """One job: its last update while it is open, and a timer for the moment it becomes stale."""

    def __init__(self, span_ms: int):
        self.span_ms = span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, open boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        newest = self.last.get() if self.last.exists() else None
        for batch in rows:  # only the latest update of a batch is looked at
            latest = batch.sort_values("ms").iloc[-1]
            if newest is None or int(latest["ms"]) >= newest[0]:
                newest = (int(latest["ms"]), latest["status"] in ("QUEUED", "PROCESSING"))
        self.last.update(newest)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(newest[0] + self.span_ms, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        ms, open_ = self.last.get()
        self.last.clear()  # a closed job is forgotten after the same time
        if open_:
            yield pd.DataFrame({"doc_id": [key[0]], "status": ["FAILED"], "last_ms": [ms]})

    def close(self) -> None:
        pass


def stale_stream(updates: DataFrame, minutes: int = STALE_MINUTES, late: str = "1 minute") -> DataFrame:
    """S2 stream: (doc_id, status FAILED, last update) once the event clock passes the last update by `minutes`."""
    rows = updates.withColumn("updated_at", F.col("updated_at").cast("timestamp")).withWatermark("updated_at", late)
    rows = rows.select("doc_id", "status", "updated_at", F.unix_millis("updated_at").alias("ms"))
    return rows.groupBy("doc_id").transformWithStateInPandas(_Stale(minutes * 60_000), "doc_id long, status string, last_ms long", "Append", "EventTime")


def job_progress(log: DataFrame) -> DataFrame:
    """S3: latest stage of each document; the same plan runs in update mode on a stream."""
    return log.groupBy("doc_id").agg(F.max_by("stage", F.struct("created_at", "log_id")).alias("stage"), F.max("created_at").alias("updated_at"))


# ---------------------------------------------------------------- S4-S6


def activity_counts(activity: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Actions per kind and tumbling window; with `late` (streams) rows behind the watermark are dropped."""
    rows = activity.withColumn("created_at", F.col("created_at").cast("timestamp"))
    if late is not None:
        rows = rows.withWatermark("created_at", late)
    g = rows.groupBy(F.window("created_at", width).alias("w"), "entity_type").agg(F.count(F.lit(1)).alias("actions"))
    return g.select(F.col("w.start").alias("window_start"), "entity_type", "actions")


def dedupe_events(events: DataFrame, key: str = "event_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Insert-once under replay, remembering ids for the watermark's length on a stream."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def live_day_status(ticks: DataFrame, blocks: DataFrame, by: Sequence[str] = ("school_id",)) -> DataFrame:
    """Day status of every teacher at each tick (by, tick, day_idx, now_min): ticks meet the stored blocks of their
    day. `live_status` gives the same for a stream of ticks."""
    joined = blocks.join(ticks, [*by, "day_idx"])
    return day_status(joined, F.col("now_min"), [*by, "tick"])


def day_segments(blocks: DataFrame, by: Sequence[str] = ("school_id",)) -> DataFrame:
    """The day of each teacher cut where a block begins or ends: (by, teacher_id, day_idx, from_min, to_min, status, label, at_min),
    where at_min is the minute the status counts down to. Segments of a day do not overlap and fill it.

    Blocks of equal times are one before anything is paired, so that a day has at most as many cuts as minutes."""
    day = [*by, "teacher_id", "day_idx"]
    order = F.struct("kind", "seq")
    once = blocks.groupBy(*day, "start_min", "end_min").agg(F.min(order).alias("_o"), F.min_by("label", order).alias("label"))
    cuts = once.select(*day, F.explode(F.array(F.lit(0), "start_min", "end_min")).alias("from_min")).distinct()
    to = F.lead("from_min", 1, 24 * 60).over(Window.partitionBy(*day).orderBy("from_min"))  # the minutes of one day
    parts = cuts.withColumn("to_min", to).filter("from_min < to_min")
    met = parts.join(once, day)
    first = F.struct("start_min", "_o")
    block = F.struct("label", "start_min", "end_min")
    inside = (F.col("start_min") <= F.col("from_min")) & (F.col("from_min") < F.col("end_min"))
    got = met.groupBy(*day, "from_min", "to_min").agg(
        F.min_by(block, F.when(inside, first)).alias("cur"), F.min_by(block, F.when(F.col("start_min") > F.col("from_min"), first)).alias("nxt")
    )
    now, then = F.col("cur").isNotNull(), F.col("nxt").isNotNull()
    return got.select(
        *day, "from_min", "to_min", F.when(now, F.lit("in-class")).when(then, F.lit("upcoming")).otherwise(F.lit("day-done")).alias("status"),
        F.when(now, F.col("cur.label")).otherwise(F.col("nxt.label")).alias("label"), F.when(now, F.col("cur.end_min")).otherwise(F.col("nxt.start_min")).alias("at_min"),
    )


def live_status(ticks: DataFrame, segments: DataFrame, by: Sequence[str] = ("school_id",)) -> DataFrame:
    """S6 on a stream (or table) of ticks (by, tick, day_idx, now_min): the stored segments that hold each tick.

    Both sides carry the hour, so that a tick is compared with the segments of its hour only. It is a join of the stream with
    stored rows: no state is kept, and append and update mode give the same rows."""
    hours = F.explode(F.sequence(F.floor(F.col("from_min") / 60), F.floor((F.col("to_min") - 1) / 60)))
    parts = segments.withColumn("_hour", hours)
    met = ticks.withColumn("_hour", F.floor(F.col("now_min") / 60)).join(parts, [*by, "day_idx", "_hour"])
    met = met.filter((F.col("from_min") <= F.col("now_min")) & (F.col("now_min") < F.col("to_min")))
    return met.select(*by, "tick", "teacher_id", "status", "label", (F.col("at_min") - F.col("now_min")).alias("minutes"))
