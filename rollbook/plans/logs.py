"""Registered batch twins of the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import timeline as T
from rollbook.plans.reads import _WEEK, week
from rollbook.plans.registry import query
from rollbook.streaming import logs as S


@query(
    "throttle",
    """WITH a AS (SELECT *, epoch_us(ts) AS us FROM f_login), r AS (SELECT *, coalesce(sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM a),
 c AS (SELECT event_id, count(*) FILTER (failed) OVER (PARTITION BY user_id, run ORDER BY us RANGE BETWEEN 899999999 PRECEDING AND CURRENT ROW) - count(*) FILTER (failed) OVER (PARTITION BY user_id, run, us ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS user_failures,
  count(*) FILTER (failed) OVER (PARTITION BY ip_id ORDER BY us RANGE BETWEEN 899999999 PRECEDING AND CURRENT ROW) - count(*) FILTER (failed) OVER (PARTITION BY ip_id, us ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ip_failures FROM r)
 SELECT *, user_failures >= 6 OR ip_failures >= 40 AS refused FROM c""",
)
def throttle(t):
    return S.throttle(t.f_login)


@query(
    "throttle_busy",
    """WITH RECURSIVE e AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY ip_id ORDER BY ts, event_id) AS rn FROM f_login),
 r(ip_id, rn, event_id, user_failures, ip_failures, refused, held) AS (
  SELECT DISTINCT ip_id, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, false, []::STRUCT(u BIGINT, us BIGINT, live BOOLEAN)[] FROM e
  UNION ALL
  SELECT ip_id, rn, event_id, uf, af, uf >= 3 OR af >= 9, CASE WHEN uf >= 3 OR af >= 9 THEN now WHEN failed THEN list_append(now, {'u': user_id, 'us': us, 'live': true})
    ELSE list_transform(now, lambda x: {'u': x.u, 'us': x.us, 'live': x.live AND x.u <> user_id}) END
  FROM (SELECT *, CAST(len(list_filter(now, lambda x: x.u = user_id AND x.live)) AS BIGINT) AS uf, CAST(len(now) AS BIGINT) AS af
   FROM (SELECT e.ip_id, e.rn, e.event_id, e.user_id, e.failed, e.us, list_filter(r.held, lambda x: e.us - x.us < 172800000000) AS now FROM r JOIN e ON e.ip_id = r.ip_id AND e.rn = r.rn + 1)))
 SELECT event_id, user_failures, ip_failures, refused FROM r WHERE event_id IS NOT NULL""",
)
def throttle_busy(t):
    """Two days and small limits, so that many attempts are refused."""
    return S.throttle(t.f_login, minutes=2 * 24 * 60, user_limit=3, ip_limit=9)


@query(
    "failure_windows",
    """SELECT CAST(time_bucket(INTERVAL 15 MINUTE, ts) AS TIMESTAMP) AS window_start, user_id, count(*) AS failures FROM f_login WHERE failed GROUP BY ALL""",
)
def failure_windows(t):
    rows = S.failure_windows(t.f_login, slide="15 minutes")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "user_id", "failures")


@query(
    "sliding_failures",
    """SELECT CAST(w AS TIMESTAMP) AS window_start, user_id, count(*) AS failures FROM (SELECT user_id, unnest([b, b - INTERVAL 5 MINUTE, b - INTERVAL 10 MINUTE]) AS w FROM (SELECT user_id, time_bucket(INTERVAL 5 MINUTE, ts) AS b FROM f_login WHERE failed)) GROUP BY ALL""",
)
def sliding_failures(t):
    rows = S.failure_windows(t.f_login, slide="5 minutes")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "user_id", "failures")


_JOBS = "SELECT doc_id, extraction_status AS status, 'step' AS stage, CAST(updated_on AS TIMESTAMP) AS updated_at FROM f_doc"


@query(
    "stale_jobs",
    f"""SELECT doc_id, CASE WHEN status IN ('QUEUED', 'PROCESSING') AND updated_at < TIMESTAMP '2024-01-01 00:10:00' - INTERVAL 20 MINUTE THEN 'FAILED' ELSE status END AS status,
 CASE WHEN status IN ('QUEUED', 'PROCESSING') AND updated_at < TIMESTAMP '2024-01-01 00:10:00' - INTERVAL 20 MINUTE THEN 'Failed' ELSE stage END AS stage FROM ({_JOBS})""",
)
def stale_jobs(t):
    jobs = t.f_doc.select("doc_id", F.col("extraction_status").alias("status"), F.lit("step").alias("stage"), F.col("updated_on").cast("timestamp_ntz").alias("updated_at"))
    return S.stale_jobs(jobs, F.lit("2024-01-01 00:10:00").cast("timestamp_ntz")).select("doc_id", "status", "stage")


@query("job_progress", "SELECT actor_id AS doc_id, arg_max(entity_type, (created_at, event_id)) AS stage, max(created_at) AS updated_at FROM f_activity GROUP BY ALL")
def job_progress(t):
    return S.job_progress(t.f_activity.select(F.col("actor_id").alias("doc_id"), F.col("entity_type").alias("stage"), "created_at", F.col("event_id").alias("log_id")))


@query("activity_counts", "SELECT date_trunc('hour', created_at) AS window_start, entity_type, count(*) AS actions FROM f_activity GROUP BY ALL")
def activity_counts(t):
    return S.activity_counts(t.f_activity).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("dedupe_events", "SELECT event_id, user_id FROM events")
def dedupe_events(t):
    twice = t.events.unionByName(t.events)
    return S.dedupe_events(twice).select("event_id", "user_id")


_TICK = "(SELECT school_id, CAST(k AS INTEGER) AS tick, 0 AS day_idx, CAST(480 + 90 * k AS INTEGER) AS now_min FROM (SELECT DISTINCT school_id FROM f_teacher) s CROSS JOIN range(4) g(k))"


_LIVE = f"""WITH {_WEEK}, b AS (SELECT b.*, t.tick, t.now_min FROM blocks b JOIN {_TICK} t USING (school_id, day_idx)),
 c AS (SELECT * FROM b WHERE start_min <= now_min AND now_min < end_min QUALIFY row_number() OVER (PARTITION BY school_id, tick, teacher_id ORDER BY start_min, kind, seq) = 1),
 n AS (SELECT * FROM b WHERE start_min > now_min QUALIFY row_number() OVER (PARTITION BY school_id, tick, teacher_id ORDER BY start_min, kind, seq) = 1)
 SELECT d.school_id, d.tick, d.teacher_id, CASE WHEN c.seq IS NOT NULL THEN 'in-class' WHEN n.seq IS NOT NULL THEN 'upcoming' ELSE 'day-done' END AS status, coalesce(c.label, n.label) AS label,
 CASE WHEN c.seq IS NOT NULL THEN c.end_min - d.now_min ELSE n.start_min - d.now_min END AS minutes FROM (SELECT DISTINCT school_id, tick, teacher_id, now_min FROM b) d
 LEFT JOIN c USING (school_id, tick, teacher_id) LEFT JOIN n USING (school_id, tick, teacher_id)"""


@query("live_day_status", _LIVE)
def live_day_status(t):
    return S.live_day_status(_ticks(t), week(t))


@query("live_status", _LIVE)
def live_status(t):
    return S.live_status(_ticks(t), S.day_segments(week(t)))


def _ticks(t):
    schools = t.f_teacher.select("school_id").distinct()
    return schools.select("school_id", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("tick")).select("school_id", "tick", F.lit(0).alias("day_idx"), (F.col("tick") * 90 + 480).alias("now_min"))
