"""Indexing jobs: their state machine and their status rows."""

from __future__ import annotations

import threading
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.functions.text import percent, seconds_between

SCHEMA = (
    "job_id string, repo_name string, repo_path string, status string, created_at timestamp, started_at timestamp, completed_at timestamp, error string, "
    "progress struct<current_file int, total_files int, current_file_path string, chunks_indexed int, failed_files array<string>, cache_hit_rate double>"
)
#: States a job may go to from each state; the others are final.
NEXT = {"queued": {"running", "cancelled", "failed"}, "running": {"completed", "failed", "cancelled"}}


class Registry:
    """Jobs of one driver; each runs in a thread of its own whose Spark jobs carry its tag."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jobs, self.lock = spark, {}, threading.Lock()

    def create(self, repo_name: str, repo_path: str) -> str:
        job_id = uuid.uuid4().hex[:8]
        progress = {"current_file": 0, "total_files": 0, "current_file_path": "", "chunks_indexed": 0, "failed_files": [], "cache_hit_rate": 0.0}
        with self.lock:
            self.jobs[job_id] = {"job_id": job_id, "repo_name": repo_name, "repo_path": repo_path, "status": "queued", "created_at": datetime.now(), "started_at": None, "completed_at": None, "error": None, "progress": progress}
        return job_id

    def move(self, job_id: str, status: str, error: str | None = None) -> bool:
        """Changes a job's state where that is allowed; final states stay."""
        with self.lock:
            job = self.jobs.get(job_id)
            if job is None or status not in NEXT.get(job["status"], ()):
                return False
            job["status"], job["error"] = status, error
            job["started_at" if status == "running" else "completed_at"] = datetime.now()
            return True

    def update(self, job_id: str, **progress) -> None:
        with self.lock:
            if job_id in self.jobs:
                self.jobs[job_id]["progress"].update(progress)

    def cancel(self, job_id: str) -> bool:
        """Cancels a queued or running job and the Spark jobs it has under way."""
        moved = self.move(job_id, "cancelled")
        if moved:
            self.spark.sparkContext.cancelJobsWithTag(f"index-{job_id}")
        return moved

    def run(self, job_id: str, work) -> threading.Thread:
        def body() -> None:
            if not self.move(job_id, "running"):
                return
            self.spark.sparkContext.addJobTag(f"index-{job_id}")
            try:
                work()
                self.move(job_id, "completed")
            except Exception as e:  # the job's outcome, kept for its status
                self.move(job_id, "failed", str(e)[:1000])

        thread = threading.Thread(target=body, daemon=True)
        thread.start()
        return thread

    def table(self) -> DataFrame:
        with self.lock:
            return self.spark.createDataFrame(list(self.jobs.values()), SCHEMA)


def status(jobs: DataFrame) -> DataFrame:
    """Status rows: progress in percent, run time in seconds (null unless started and ended), distinct failed files and the first five."""
    failed = F.array_distinct(F.filter(F.coalesce("progress.failed_files", F.array().cast("array<string>")), lambda x: x.isNotNull()))
    return jobs.dropDuplicates(["job_id"]).select(
        "job_id", "repo_name", "status",
        percent(F.col("progress.current_file"), F.col("progress.total_files")).alias("percent_done"),
        F.format_string("%.2f%%", F.coalesce("progress.cache_hit_rate", F.lit(0.0))).alias("cache_hit_rate"),
        seconds_between(F.col("started_at"), F.col("completed_at")).alias("seconds"),
        F.size(failed).alias("n_failed"),
        F.array_join(F.slice(F.array_sort(failed), 1, 5), ", ").alias("first_failed"),
        F.col("status").isin("queued", "running").alias("can_cancel"),
    )
