"""Job states from event logs, in batch; the streaming form is in docweave.streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The domain of states.
TERMINAL = ("succeeded", "failed", "cancelled", "timed_out")


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, by order; no ties if order is unique."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fold(events: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """(key, status, events): the first terminal status if there is one, else the last."""
    done = F.col(status).isin(*TERMINAL)
    return events.groupBy(key).agg(
        F.coalesce(F.min_by(F.when(done, F.col(status)), F.when(done, F.col(order))), F.max_by(status, order)).alias("status"), F.count("*").alias("events")
    )


def retried(failures: Column, successes: Column, max_retries: int) -> dict[str, Column]:
    """attempts and final state of a job with so many failures before a possible success."""
    attempts = F.least(failures + F.when(successes > 0, 1).otherwise(0), F.lit(max_retries + 1))
    final = F.when(failures > max_retries, "failed").when(successes > 0, "succeeded").otherwise("queued")
    return {"attempts": attempts.cast("long"), "final": final}


def over_budget(elapsed_s: Column, route: Column, task_timeout_s: float, ocr_budget_s: float) -> Column:
    return elapsed_s > F.when(route == "ocr", ocr_budget_s).otherwise(task_timeout_s)


def expired(finished: Column, now: Column, ttl_s: int) -> Column:
    return finished < now - F.make_dt_interval(secs=F.lit(ttl_s))


def admitted(jobs: DataFrame, created: str, tie: str, capacity: int, group: str) -> DataFrame:
    """jobs with position in their queue and whether they fit in its capacity, first come first served."""
    w = Window.partitionBy(group).orderBy(created, tie)
    return jobs.withColumn("position", F.row_number().over(w).cast("long")).withColumn("admitted", F.col("position") <= capacity)


def upsert(records: DataFrame, changes: DataFrame, key: str, *order: str) -> DataFrame:
    """records with rows of changes in place of those of the same key, and new ones added; of several changes of a key the last by order.

    Without order, changes must have a row for each key. Columns of order that records lack are left out of the result.
    """
    last = (latest(changes, key, *order) if order else changes).select(*records.columns)
    return records.join(last.select(key), key, "left_anti").select(*records.columns).unionByName(last)


def delete(records: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return records.join(keys.select(key).distinct(), key, "left_anti")


def recovered(status: Column, has_input: Column, attempt: Column, max_retries: Column) -> Column:
    """The state of a job after a restart: jobs under way start anew, but not without their input or beyond their attempts."""
    under_way = status.isin("queued", "processing")
    return F.when(under_way & ~has_input, "failed").when(under_way & (attempt > max_retries), "failed").when(under_way, "queued").otherwise(status)


def after_failure(status: Column, attempt: Column, max_retries: Column, failed_as: Column) -> Column:
    """A cancelled job stays so; one with attempts left is queued again; else it ends as it failed."""
    return F.when(status == "cancelled", "cancelled").when(attempt <= max_retries, "queued").otherwise(failed_as)


def exited(status: Column, has_output: Column, reported: Column, attempt: Column, max_retries: Column) -> Column:
    """The state of a job whose worker has ended: success needs the output; a timeout that was reported goes before a failure."""
    failed_as = F.when(F.coalesce(reported == "timed_out", F.lit(False)) | (status == "timed_out"), "timed_out").otherwise("failed")
    return F.when((status == "succeeded") & has_output, "succeeded").when(status == "cancelled", "cancelled").otherwise(after_failure(status, attempt, max_retries, failed_as))


def cancelled(status: Column) -> Column:
    """The state after a cancellation: ended jobs stay as they are."""
    return F.when(status.isin("queued", "processing"), "cancelled").otherwise(status)


def shut_down(status: Column) -> Column:
    """The state after an orderly stop: what was under way waits again."""
    return F.when(status == "processing", "queued").otherwise(status)


def download_status(status: Column, has_output: Column) -> Column:
    """404 for an unknown job (null status), 409 without a result, else 200."""
    return F.when(status.isNull(), 404).when((status == "succeeded") & has_output, 200).otherwise(409)


def download_url(job_id: Column, status: Column, prefix: str = "/jobs/") -> Column:
    """Where the result of a job is; null unless it has succeeded."""
    return F.when(status == "succeeded", F.concat(F.lit(prefix), job_id.cast("string"), F.lit("/result")))


def page_count_status(pages: Column, encrypted: Column, max_pages: int) -> Column:
    """400 for encrypted, unreadable (null) or empty documents, 413 for too many pages, else 200."""
    return F.when(F.coalesce(encrypted, F.lit(False)) | pages.isNull() | (pages < 1), 400).when(pages > max_pages, 413).otherwise(200)


def started(jobs: DataFrame, status: str, created: str, tie: str, workers: int) -> DataFrame:
    """The queued jobs that free workers take next, the oldest first; a top-k, so nothing is gathered or sorted as a whole."""
    busy = jobs.where(F.col(status) == "processing").limit(workers).count()
    return jobs.where(F.col(status) == "queued").orderBy(created, tie).limit(workers - busy)


#: Fields of a progress record and their types; values of other types are passed over.
STATE = "status string, progress int, route string, route_reason string, table_count int, worker_pid int, error string"


def latest_state(payloads: DataFrame, key: str, order: str, text: str = "payload") -> DataFrame:
    """(key, fields of STATE) from JSON texts: of each field the last value that is there with its type; texts that aren't JSON are passed over."""
    names = [x.split()[0] for x in STATE.split(", ")]
    raw = payloads.select(key, order, F.from_json(F.col(text), "map<string,string>").alias("_m"), text).where("_m is not null")
    quoted = lambda n: F.col(text).rlike(rf'"{n}"\s*:\s*"')
    value = lambda n, kind: F.when(quoted(n), F.col("_m")[n]) if kind == "string" else F.when(~quoted(n), F.col("_m")[n].try_cast("int"))
    typed = raw.select(key, order, *[value(*x.split()).alias(x.split()[0]) for x in STATE.split(", ")])
    typed = typed.withColumn("table_count", F.when(F.col("table_count") >= 0, F.col("table_count")))
    return typed.groupBy(key).agg(*[F.max_by(F.col(n), F.when(F.col(n).isNotNull(), F.col(order))).alias(n) for n in names])
