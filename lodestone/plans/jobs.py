"""Queries of the job state machine, tool policy and trace streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables as W
from ..operators.common import rank
from ..streaming import trace
from .common import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STATES = "['pending', 'running', 'cancel_requested', 'completed']"
_JOBS = f"""jobs AS (SELECT event_id AS job_id, user_id AS target_id, {_STATES}[event_id % 4 + 1] AS status, ts AS created_at, ts AS heartbeat_at, 'w' || event_id % 3 AS worker_id FROM events WHERE event_type <> 'view')"""
_NOW = "TIMESTAMP '2024-01-15 00:00:00'"


def _jobs(spark, sf):
    return table(spark, sf, "events").where("event_type <> 'view'").selectExpr("event_id AS job_id", "user_id AS target_id", "array('pending', 'running', 'cancel_requested', 'completed')[event_id % 4] AS status", "ts AS created_at", "ts AS heartbeat_at", "concat('w', event_id % 3) AS worker_id")


def _now():
    return F.lit("2024-01-15 00:00:00").cast("timestamp")


@query(f"WITH {_JOBS} SELECT job_id, status FROM jobs WHERE status IN ('running', 'cancel_requested') AND heartbeat_at < {_NOW} - INTERVAL 30 SECONDS")
def stale_leases(spark, sf):
    j = _jobs(spark, sf)
    return j.where(W.stale(j, _now())).select("job_id", "status")


@query(f"""WITH {_JOBS}, s AS (SELECT *, status IN ('running', 'cancel_requested') AND heartbeat_at < {_NOW} - INTERVAL 30 SECONDS AS stale FROM jobs)
SELECT job_id, CASE WHEN stale AND status = 'cancel_requested' THEN 'cancelled' WHEN stale THEN 'pending' ELSE status END AS status, CASE WHEN stale AND status = 'running' THEN '' ELSE worker_id END AS worker_id FROM s""")
def lease_recovery(spark, sf):
    return W.recovered(_jobs(spark, sf), _now()).select("job_id", "status", F.coalesce("worker_id", F.lit("")).alias("worker_id"))


@query(f"WITH {_JOBS} SELECT o_orderkey AS task_id, lower(o_orderstatus) AS kind FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderkey NOT IN (SELECT target_id FROM jobs)")
def orphan_tasks(spark, sf):
    tasks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.lower("o_orderstatus").alias("kind"), F.when(F.col("o_orderstatus").isin("O", "P"), "running").otherwise("completed").alias("status"))
    return W.orphans(tasks, _jobs(spark, sf)).select("task_id", "kind")


_LOG = "log AS (SELECT user_id AS job_id, ts AS happened, event_id, ['enqueue', 'claim', 'expire', 'finish', 'cancel'][event_id % 5 + 1] AS event, event_id % 3 AS worker FROM events)"


@query(f"""WITH {_LOG} SELECT job_id, CASE arg_max(event, (happened, event_id)) WHEN 'claim' THEN 'running' WHEN 'enqueue' THEN 'pending' WHEN 'expire' THEN 'pending' WHEN 'finish' THEN 'completed' ELSE 'cancel_requested' END AS status, count(*) FILTER (event = 'claim') AS attempts, arg_max(worker, (happened, event_id)) AS worker FROM log GROUP BY job_id""")
def job_state_fold(spark, sf):
    log = table(spark, sf, "events").selectExpr("user_id AS job_id", "ts AS happened", "event_id", "array('enqueue', 'claim', 'expire', 'finish', 'cancel')[event_id % 5] AS event", "event_id % 3 AS worker")
    return W.folded(log)


@query(f"WITH {_JOBS} SELECT job_id, CASE status WHEN 'pending' THEN 'cancelled' WHEN 'running' THEN 'cancel_requested' ELSE status END AS status FROM jobs")
def cancel_transition(spark, sf):
    return _jobs(spark, sf).select("job_id", W.cancelled(F.col("status")).alias("status"))


@query(f"WITH {_JOBS} SELECT job_id, CAST(row_number() OVER (ORDER BY created_at, job_id) AS INTEGER) AS worker FROM jobs WHERE status = 'pending' ORDER BY created_at, job_id LIMIT 10")
def claim_order(spark, sf):
    """Ten workers claim the ten oldest jobs."""
    return W.claims(_jobs(spark, sf), 10).select("job_id", "worker")


_FULL = _JOBS.replace("'w' || event_id % 3 AS worker_id", "'w' || event_id % 3 AS worker_id, CAST(event_id % 5 AS INTEGER) AS attempts, ts AS claimed_at")


def _full(spark, sf):
    return _jobs(spark, sf).withColumn("attempts", (F.col("job_id") % 5).cast("int")).withColumn("claimed_at", F.col("created_at"))


@query(f"""WITH {_FULL}, c AS (SELECT job_id, row_number() OVER (ORDER BY created_at, job_id) AS n FROM jobs WHERE status = 'pending' ORDER BY created_at, job_id LIMIT 3)
SELECT jobs.job_id, CASE WHEN n IS NULL THEN status ELSE 'running' END AS status, CASE WHEN n IS NULL THEN worker_id ELSE ['a', 'b', 'c'][n] END AS worker_id, CAST(attempts + CASE WHEN n IS NULL THEN 0 ELSE 1 END AS INTEGER) AS attempts, n IS NOT NULL AS fresh FROM jobs LEFT JOIN c USING (job_id)""")
def job_claim(spark, sf):
    """The job table after three workers claimed."""
    out = W.claimed(_full(spark, sf), ["a", "b", "c"], _now())
    return out.select("job_id", "status", "worker_id", "attempts", (F.col("claimed_at").eqNullSafe(_now()) & F.col("heartbeat_at").eqNullSafe(_now())).alias("fresh"))


@query(f"""WITH {_FULL} SELECT job_id, target_id, status, attempts FROM jobs UNION ALL SELECT o_orderkey + 1000000000, o_orderkey, 'pending', 0 FROM orders WHERE o_orderstatus = 'P'""")
def job_enqueue(spark, sf):
    """Orders in process become jobs that wait."""
    new = table(spark, sf, "orders").where("o_orderstatus = 'P'").select((F.col("o_orderkey") + 1_000_000_000).alias("job_id"), F.col("o_orderkey").alias("target_id"))
    return W.enqueued(_full(spark, sf), new, _now()).select("job_id", "target_id", "status", "attempts")


@query(f"""WITH {_JOBS} SELECT l_orderkey AS target_id, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT target_id FROM jobs WHERE status = 'cancel_requested')""")
def target_reset(spark, sf):
    """Lines of orders whose job was cancelled are gone."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("target_id"), "l_linenumber")
    return W.reset(lines, _jobs(spark, sf).where("status = 'cancel_requested'"))


_TASKS = "tasks AS (SELECT o_orderkey AS task_id, lower(o_orderstatus) AS kind, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'pending' ELSE 'completed' END AS status FROM orders)"


def _tasks(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "pending").otherwise("completed")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.lower("o_orderstatus").alias("kind"), status.alias("status"))


@query(f"""WITH {_JOBS}, {_TASKS} SELECT 'job_' || job_id AS job_id, target_id, 'event' AS kind, status, 1 AS attempts FROM jobs UNION ALL SELECT 'job_' || task_id, task_id, kind, 'pending', 0 FROM tasks WHERE status IN ('pending', 'running') AND task_id NOT IN (SELECT target_id FROM jobs)""")
def orphan_adoption(spark, sf):
    """The job table after active tasks that no job points to got one."""
    jobs = _jobs(spark, sf).select(F.concat(F.lit("job_"), "job_id").alias("job_id"), "target_id", F.lit("event").alias("kind"), "status", F.lit(1).alias("attempts"), "created_at")
    return W.adopted(_tasks(spark, sf), jobs, _now()).drop("created_at")


@query(f"""WITH {_JOBS}, {_TASKS}, w AS (SELECT task_id FROM tasks WHERE task_id % 3 = 0),
j AS (SELECT target_id, CASE WHEN target_id NOT IN (SELECT task_id FROM w) THEN status WHEN status = 'pending' THEN 'cancelled' WHEN status = 'running' THEN 'cancel_requested' ELSE status END AS status FROM jobs),
s AS (SELECT target_id, bool_or(status = 'cancelled') AS a, bool_or(status = 'cancel_requested') AS r FROM j WHERE target_id IN (SELECT task_id FROM w) GROUP BY target_id)
SELECT task_id, kind, CASE WHEN status IN ('pending', 'running') AND r THEN 'cancel_requested' WHEN status IN ('pending', 'running') AND a THEN 'cancelled' ELSE status END AS status FROM tasks LEFT JOIN s ON task_id = target_id""")
def cancel_cascade(spark, sf):
    """Tasks after every third one's jobs were cancelled: what waits ends at once, what runs is asked to stop."""
    tasks = _tasks(spark, sf)
    return W.cancel_cascade(tasks, _jobs(spark, sf), tasks.where("task_id % 3 = 0").select("task_id"))[0]


@query("""WITH s(job, target) AS (SELECT a.x, b.x FROM (VALUES ('running'), ('cancel_requested')) a(x), (VALUES ('completed'), ('failed'), ('cancelled'), ('running'), ('pending')) b(x))
SELECT job, target, CASE WHEN target IN ('completed', 'failed', 'cancelled') THEN target WHEN job = 'cancel_requested' THEN 'cancelled' ELSE 'failed' END AS status FROM s""")
def status_finalization(spark, sf):
    rows = spark.createDataFrame([(a, b) for a in ("running", "cancel_requested") for b in ("completed", "failed", "cancelled", "running", "pending")], "job string, target string")
    return rows.withColumn("status", W.finished(F.col("job"), F.col("target")))


_ATTEMPTS = [(1, 1, "ok", 0.2), (2, 1, "timeout", 0.1), (2, 2, "ok", 0.3), (3, 1, "timeout", 0.1), (3, 2, "connection", 0.1), (4, 1, "value", 0.1), (5, 1, "ok", 9.0), (5, 2, "ok", 9.0), (6, 0, "invalid", 0.0)]


@query(f"""WITH a(call_id, attempt, outcome, elapsed) AS (VALUES {', '.join(map(str, _ATTEMPTS))}), e AS (SELECT *, CASE WHEN outcome = 'ok' AND elapsed > 5 THEN 'timeout' ELSE outcome END AS o FROM a),
l AS (SELECT call_id, arg_max(o, attempt) AS o, CAST(max(attempt) AS INTEGER) AS attempts FROM e GROUP BY call_id)
SELECT call_id, attempts, CASE WHEN o = 'ok' THEN 'completed' ELSE 'failed' END AS status, CASE o WHEN 'ok' THEN '' WHEN 'timeout' THEN 'timeout' WHEN 'connection' THEN 'connection' WHEN 'invalid' THEN 'validation' ELSE 'internal' END AS error_type, o IN ('timeout', 'connection') AS retryable FROM l""")
def tool_retry_policy(spark, sf):
    """Outcome of tool calls from their attempts; one that took too long counts as timed out."""
    a = spark.createDataFrame(_ATTEMPTS, "call_id int, attempt int, outcome string, elapsed double")
    o = F.when((F.col("outcome") == "ok") & (F.col("elapsed") > 5), "timeout").otherwise(F.col("outcome"))
    last = a.withColumn("o", o).groupBy("call_id").agg(F.max_by("o", "attempt").alias("o"), F.max("attempt").alias("attempts"))
    kind = F.when(F.col("o") == "ok", "").when(F.col("o").isin("timeout", "connection"), F.col("o")).when(F.col("o") == "invalid", "validation").otherwise("internal")
    return last.select("call_id", "attempts", F.when(F.col("o") == "ok", "completed").otherwise("failed").alias("status"), kind.alias("error_type"), F.col("o").isin("timeout", "connection").alias("retryable"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def trace_tail_stream(spark, sf):
    """Events read as a stream, counted by type in windows of a day."""
    return trace.tail_once(spark, f"{sf}/events.parquet").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT DISTINCT user_id, event_id FROM events")
def trace_dedup_stream(spark, sf):
    """Events read as a stream, each of a run once."""
    return trace.run_available(trace.deduplicated(trace.read(spark, f"{sf}/events.parquet")), "append").select("user_id", "event_id")


@query(f"WITH {_JOBS} SELECT job_id, target_id, 'pending' AS status, job_id + 1000000000 AS new_id FROM jobs WHERE status = 'completed' AND target_id % 2 = 0")
def reindex_jobs(spark, sf):
    """Finished jobs run again as new ones with the same target."""
    done = _jobs(spark, sf).where("status = 'completed' AND target_id % 2 = 0")
    return done.select("job_id", "target_id", F.lit("pending").alias("status"), (F.col("job_id") + 1_000_000_000).alias("new_id"))


@query("SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS sequence, event_id FROM events")
def client_dedupe(spark, sf):
    """Each run and sequence once, though the stream brought each event twice."""
    e = table(spark, sf, "events").withColumn("sequence", rank("user_id", order=[F.asc("ts"), F.asc("event_id")]))
    return e.unionAll(e).groupBy("user_id", "sequence").agg(F.min("event_id").alias("event_id"))
