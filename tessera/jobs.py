"""Background jobs over Spark: submit, poll, cancel; a finished job is forgotten once its end was read."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

RUNNING, DONE, FAILED, CANCELLED = "running", "done", "failed", "cancelled"


@dataclass
class Job:
    id: str
    status: str = RUNNING
    result: Any = None
    error: str | None = None
    log: list[str] = field(default_factory=list)


class Jobs:
    def __init__(self, spark: SparkSession, workers: int = 3):
        self.spark = spark
        self._pool = ThreadPoolExecutor(workers)
        self._jobs: dict[str, Job] = {}
        self._lock = threading.Lock()

    def submit(self, work: Callable[[], Any]) -> str:
        """Run work() in the background; what Spark runs for it carries the job's tag."""
        job = Job(uuid.uuid4().hex)
        with self._lock:
            self._jobs[job.id] = job
        self._pool.submit(self._run, job, work)
        return job.id

    def _run(self, job: Job, work: Callable[[], Any]) -> None:
        def tagged() -> None:
            self.spark.addTag(f"job-{job.id}")
            try:
                result, error = work(), None
            except Exception as e:  # the job's failure is its result
                result, error = None, f"{type(e).__name__}: {e}"[:2000]
            finally:
                self.spark.removeTag(f"job-{job.id}")
            with self._lock:
                if job.status == RUNNING:
                    job.result, job.error, job.status = result, error, FAILED if error else DONE

        if job.status == RUNNING:
            thread = InheritableThread(target=tagged)
            thread.start()
            thread.join()

    def poll(self, job_id: str) -> Job | None:
        """The job as it is now; its end is told once."""
        with self._lock:
            job = self._jobs.get(job_id)
            if job is not None and job.status != RUNNING:
                del self._jobs[job_id]
            return job and replace(job)

    def cancel(self, job_id: str) -> bool:
        with self._lock:
            job = self._jobs.get(job_id)
            if job is None or job.status != RUNNING:
                return False
            job.status = CANCELLED
        self.spark.interruptTag(f"job-{job_id}")
        return True
