"""Jobs and their ledger: due selection, single flight, recovery, retention."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import CubeError
from ..local import local_frame

JOBS = "job string, owner string, interval_ms bigint, enabled boolean"
LEDGER = "seq bigint, run string, job string, state string, fire_ms bigint, at_ms bigint, message string"
RUNNING, SUCCEEDED, FAILED, INTERRUPTED = "running", "succeeded", "failed", "interrupted"


def latest_runs(ledger: DataFrame) -> DataFrame:
    """The last record of each run: a partial aggregate, not a window."""
    last = F.max_by(F.struct(*ledger.columns), "seq").alias("r")
    return ledger.groupBy("run").agg(last).select("r.*")


def recent_runs(ledger: DataFrame, n: int) -> DataFrame:
    """The newest runs first; ties by run id."""
    return latest_runs(ledger).orderBy(F.desc("fire_ms"), "run").limit(n)


def last_success(ledger: DataFrame) -> DataFrame:
    """(job, last_ms): when each job last fired with success."""
    return ledger.where(F.col("state") == SUCCEEDED).groupBy("job").agg(F.max("fire_ms").alias("last_ms"))


def due(jobs: DataFrame, ledger: DataFrame, now_ms: int) -> DataFrame:
    """(job, owner, next_due, run): enabled jobs whose time has come and that aren't running, in order of time, then name.

    A job is due its interval after its last success, at once if it never succeeded.  The run id
    is made of the job and its due time, so the same tick names the same run.
    """
    busy = latest_runs(ledger).where(F.col("state") == RUNNING).select("job")
    next_due = F.coalesce(F.col("last_ms") + F.col("interval_ms"), F.lit(0).cast("bigint"))
    out = jobs.where("enabled").join(last_success(ledger), "job", "left").join(busy, "job", "left_anti")
    out = out.select("job", "owner", next_due.alias("next_due")).where(F.col("next_due") <= now_ms)
    return out.withColumn("run", F.concat_ws("@", "job", F.col("next_due").cast("string"))).orderBy("next_due", "job")


def recovered(ledger: DataFrame, now_ms: int) -> DataFrame:
    """Records that end runs which were going when the scheduler stopped."""
    hanging = latest_runs(ledger).where(F.col("state") == RUNNING)
    return hanging.select("run", "job", F.lit(INTERRUPTED).alias("state"), "fire_ms", F.lit(now_ms).cast("bigint").alias("at_ms"), F.lit("stopped while running").alias("message"))


def retained(ledger: DataFrame, keep: int) -> DataFrame:
    """Records of each job's newest ``keep`` runs."""
    order = Window.partitionBy("job").orderBy(F.desc("fire_ms"), F.desc("run"))
    kept = latest_runs(ledger).withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).select("run")
    return ledger.join(kept, "run", "left_semi")


@dataclass(frozen=True)
class Job:
    name: str
    owner: str | None
    interval_ms: int
    steps: tuple[Callable[[int], None], ...]
    enabled: bool = True


class Scheduler:
    """Ticks on an injected clock; steps of a run stop at the first failure.

    ``path`` holds the ledger as Parquet files, one appended before and after each run, so that a
    later process finds what ran and can ``recover``; without one, records end with the process.
    """

    def __init__(self, spark: SparkSession, jobs: Sequence[Job], path: str | None = None):
        self.spark, self.jobs, self.path, self.records = spark, {j.name: j for j in jobs}, path, []
        if path:
            local_frame(spark, [], LEDGER).write.mode("append").parquet(path)
            self.records = [tuple(r) for r in spark.read.schema(LEDGER).parquet(path).orderBy("seq").collect()]

    def ledger(self) -> DataFrame:
        return local_frame(self.spark, self.records, LEDGER)

    def _note(self, run: str, job: str, state: str, fire: int, at: int, message: str = "") -> None:
        self.records.append((len(self.records), run, job, state, fire, at, message))
        if self.path:
            local_frame(self.spark, self.records[-1:], LEDGER).coalesce(1).write.mode("append").parquet(self.path)

    def tick(self, now_ms: int) -> list[str]:
        """Fire what is due and return the run ids."""
        table = local_frame(self.spark, [(j.name, j.owner, j.interval_ms, j.enabled) for j in self.jobs.values()], JOBS)
        fired = due(table, self.ledger(), now_ms).collect()
        for f in fired:
            job = self.jobs[f["job"]]
            self._note(f["run"], job.name, RUNNING, now_ms, now_ms)
            try:
                if job.owner is None:
                    raise CubeError("the job has no owner")
                for step in job.steps:
                    step(now_ms)
            except Exception as e:  # a step may fail in any way; the ledger tells how
                self._note(f["run"], job.name, FAILED, now_ms, now_ms, str(e))
            else:
                self._note(f["run"], job.name, SUCCEEDED, now_ms, now_ms)
        return [f["run"] for f in fired]

    def recover(self, now_ms: int) -> int:
        hanging = recovered(self.ledger(), now_ms).collect()
        for r in hanging:
            self._note(r["run"], r["job"], INTERRUPTED, r["fire_ms"], now_ms, r["message"])
        return len(hanging)
