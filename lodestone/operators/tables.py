"""Change capture, upserts, deletes and the job state machine, as transformations of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEASE_ERROR = "worker lease expired; job safely requeued"


def changes(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """key and change (insert, update, delete, unchanged) between two snapshots, by a full outer join."""
    a = old.select(F.col(key), F.col(content).alias("_old"), F.lit(1).alias("_in_old"))
    b = new.select(F.col(key), F.col(content).alias("_new"), F.lit(1).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "insert").when(F.col("_in_new").isNull(), "delete").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("update")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def upserted(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """The table after an upsert: unchanged rows as they were, changed and new ones from new, missing ones gone."""
    kind = changes(old, new, key, content)
    stay = old.join(kind.where("change = 'unchanged'").select(key), key, "left_semi")
    return stay.unionByName(new.join(kind.where("change IN ('insert', 'update')").select(key), key, "left_semi"))


def replaced(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Rows of old whose group new doesn't have, and new."""
    return old.join(new.select(by).distinct(), by, "left_anti").unionByName(new)


def stale(jobs: DataFrame, now: Column, seconds: int = 30) -> Column:
    return jobs["status"].isin("running", "cancel_requested") & (jobs["heartbeat_at"] < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))


def recovered(jobs: DataFrame, now: Column, seconds: int = 30) -> DataFrame:
    """Jobs after their stale leases were given back: running ones wait again, those to be cancelled are."""
    out = stale(jobs, now, seconds)
    status = F.when(out & (F.col("status") == "cancel_requested"), "cancelled").when(out, "pending").otherwise(F.col("status"))
    requeued = out & (F.col("status") == "running")
    return jobs.select(*(F.when(requeued, F.lit(LEASE_ERROR)).otherwise(F.col(c)).alias(c) if c == "error" else F.when(requeued, None).otherwise(F.col(c)).alias(c) if c in ("worker_id", "claimed_at", "heartbeat_at") else status.alias(c) if c == "status" else F.col(c) for c in jobs.columns))


def cancelled(status: Column) -> Column:
    """Status after a request to cancel."""
    return F.when(status == "pending", "cancelled").when(status == "running", "cancel_requested").otherwise(status)


def finished(job_status: Column, target_status: Column) -> Column:
    """A job's final status from that of its target."""
    return F.when(target_status.isin("completed", "failed", "cancelled"), target_status).when(job_status == "cancel_requested", "cancelled").otherwise("failed")


def enqueued(jobs: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """jobs and new ones (job_id, target_id), which wait with no attempts."""
    fresh = {"status": F.lit("pending"), "attempts": F.lit(0), "created_at": now}
    types = dict(jobs.dtypes)
    return jobs.unionByName(new.select(*((F.col(c) if c in new.columns else fresh.get(c, F.lit(None))).cast(types[c]).alias(c) for c in jobs.columns)))


def to_index(files: DataFrame, manifest: DataFrame, chunks: DataFrame, key: str, value: str) -> DataFrame:
    """Files (key, value) that must be indexed: the manifest has another hash or none, or no chunk has the key. A key with very many chunks counts once."""
    known = manifest.select(key, value).join(chunks.select(key).distinct(), key, "left_semi")
    return files.join(known, [key, value], "left_anti").select(key, value)


def duplicates(uploads: DataFrame, key: str, content: str) -> DataFrame:
    """key and duplicate_of of files with the content of an earlier one that is completed (uploads: key, content, kind, status)."""
    originals = uploads.where("kind = 'file' AND status = 'completed'").groupBy(content).agg(F.min(key).alias("duplicate_of"))
    return uploads.where("kind = 'file'").join(originals, content).where(F.col("duplicate_of") < F.col(key)).select(key, "duplicate_of")


def adopted(tasks: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """jobs (job_id, target_id, kind, status, attempts, created_at) with a pending one more for each orphan (task_id, kind, status)."""
    new = orphans(tasks, jobs).select(F.concat(F.lit("job_"), "task_id").alias("job_id"), F.col("task_id").alias("target_id"), "kind", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), now.alias("created_at"))
    return jobs.select(new.columns).unionByName(new)


def cancel_cascade(tasks: DataFrame, jobs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tasks (task_id, status) and jobs (job_id, target_id, status) after the jobs of wanted (task_id) were cancelled: pending jobs and their
    tasks are cancelled at once, running ones are asked to stop; finished ones stay."""
    ids = wanted.select("task_id").distinct()
    after = lambda status: F.when(status == "pending", "cancelled").when(status == "running", "cancel_requested").otherwise(status)
    hit = jobs.join(ids.withColumnRenamed("task_id", "target_id").withColumn("_hit", F.lit(True)), "target_id", "left")
    moved = hit.withColumn("status", F.when(F.col("_hit"), after(F.col("status"))).otherwise(F.col("status"))).drop("_hit").select(jobs.columns)
    own = moved.groupBy(F.col("target_id").alias("task_id")).agg(F.max(F.col("status") == "cancelled").alias("_all"), F.max(F.col("status") == "cancel_requested").alias("_some"))
    state = F.when(F.col("status").isin("pending", "running") & F.col("_some"), "cancel_requested").when(F.col("status").isin("pending", "running") & F.col("_all"), "cancelled").otherwise(F.col("status"))
    return tasks.join(own.join(ids, "task_id", "left_semi"), "task_id", "left").withColumn("status", state).select(tasks.columns), moved


def claims(jobs: DataFrame, workers: int) -> DataFrame:
    """The oldest pending jobs, one for each of so many workers."""
    first = jobs.where("status = 'pending'").orderBy("created_at", "job_id").limit(workers)
    return first.withColumn("worker", F.row_number().over(Window.orderBy("created_at", "job_id")))


def claimed(jobs: DataFrame, workers: list[str], now: Column) -> DataFrame:
    """jobs after these workers have claimed one each: it runs, with the worker, one more attempt, claim and heartbeat.

    One statement makes all claims, so no two workers get the same job; as many jobs as there are workers are broadcast.
    """
    names = F.get(F.array(*map(F.lit, workers)), F.col("worker") - 1)
    mine = F.broadcast(claims(jobs, len(workers)).select("job_id", names.alias("_worker")))
    got = F.col("_worker").isNotNull()
    new = {"status": F.lit("running"), "worker_id": F.col("_worker"), "attempts": F.col("attempts") + 1, "claimed_at": now, "heartbeat_at": now}
    return jobs.join(mine, "job_id", "left").select(*(F.when(got, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns))


def reset(children: DataFrame, targets: DataFrame) -> DataFrame:
    """What is left of children (target_id) when these targets start again: those of other targets."""
    return children.join(targets.select("target_id").distinct(), "target_id", "left_anti")


def cascaded(sources: DataFrame, gone: DataFrame) -> DataFrame:
    """sources (source_id, parent, status) after gone (source_id) were deleted: these and what names them as parent are, their rows stay."""
    ids = gone.select("source_id").distinct().withColumn("_gone", F.lit(True))
    below = ids.select(F.col("source_id").alias("parent"), F.col("_gone").alias("_below"))
    hit = F.coalesce("_gone", "_below", F.lit(False))
    marked = sources.join(ids, "source_id", "left").join(below, "parent", "left")
    return marked.select(*(F.when(hit, "deleted").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in sources.columns))


def orphans(tasks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Active tasks that no job points to."""
    return tasks.where(F.col("status").isin("pending", "running")).join(jobs.select(F.col("target_id").alias("task_id")), "task_id", "left_anti")


def folded(events: DataFrame) -> DataFrame:
    """Final state of each job from its log (job_id, happened, event_id, event, worker): status, attempts, last worker.

    A single pass: the last event decides, claims are counted.
    """
    last = F.max_by(F.struct("event", "worker"), F.struct("happened", "event_id"))
    status = F.when(F.col("last.event") == "claim", "running").when(F.col("last.event") == "enqueue", "pending").when(F.col("last.event") == "expire", "pending").when(F.col("last.event") == "finish", "completed").otherwise("cancel_requested")
    return events.groupBy("job_id").agg(last.alias("last"), F.count(F.when(F.col("event") == "claim", 1)).alias("attempts")).select("job_id", status.alias("status"), "attempts", F.col("last.worker").alias("worker"))
