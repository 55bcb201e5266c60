"""Jobs that are stored: their tables under a name, run one after the other, cancelled, followed, run again and recovered.

A run is a folder with the tables of its result and, once these are complete, a file of its state. What tells the state is in that
folder alone, so that a driver that starts anew finds what the one before it left.
"""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import asdict
from threading import Lock

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.job import REGISTRY, JobConfig, JobResult, run_job
from textloom.plans.registry import Registry
from textloom.session import delete

#: Tables of a result, in the order in which they are written.
TABLES = ("matches", "blocks", "totals", "file_scores", "file_overall", "files")
QUEUED, ACTIVE, COMPLETE, FAILED, CANCELLED, INTERRUPTED, MISSING_FILES = "QUEUED", "ACTIVE", "COMPLETE", "FAILED", "CANCELLED", "INTERRUPTED", "MISSING_FILES"
#: Results kept open for reports.
KEPT = 3


def key_of(name: str, config: JobConfig) -> str:
    """The same for the same name, detectors and values of parameters."""
    return hashlib.sha256(json.dumps([name, asdict(config)], sort_keys=True).encode()).hexdigest()[:32]


class Runs:
    """Runs stored below ``folder``, which all executors have to share.

    ``submit`` queues a run, or gives the one that is queued, active or stored already; one runs at a time. Each has a job group
    of Spark, by which it is followed and cancelled.
    """

    def __init__(self, spark: SparkSession, folder: str, registry: Registry = REGISTRY):
        self.spark, self.folder, self.registry = spark, folder.rstrip("/"), registry
        self.queue = ThreadPoolExecutor(1)
        self.lock = Lock()
        self.waiting: dict[str, Future] = {}
        self.open: OrderedDict[str, JobResult] = OrderedDict()

    # states

    def _note(self, key: str, state: str, note: str = ""):
        rows = [(key, state, note)]
        self.spark.createDataFrame(rows, "key string, state string, note string").coalesce(1).write.mode("overwrite").json(f"{self.folder}/{key}/state")

    def states(self) -> DataFrame:
        """(key, state, note) of all runs there are."""
        schema = "key string, state string, note string"
        try:
            return self.spark.read.schema(schema).json(f"{self.folder}/*/state")
        except PySparkException:  # no run yet
            return self.spark.createDataFrame([], schema)

    def state(self, key: str) -> str | None:
        row = self.states().where(F.col("key") == key).first()
        return row["state"] if row else None

    def recover(self, files: DataFrame | None = None, id: str = "file_id"):
        """To be called once a driver starts: runs that another one left queued or active are INTERRUPTED, and with ``files`` complete
        ones of which a file is gone MISSING_FILES."""
        for r in self.states().collect():  # a row for each run
            if r["state"] in (QUEUED, ACTIVE):
                self._note(r["key"], INTERRUPTED)
            elif files is not None and r["state"] == COMPLETE:
                stored = self.spark.read.parquet(f"{self.folder}/{r['key']}/files").select(id)
                if not stored.join(files.select(id), id, "left_anti").isEmpty():
                    self._note(r["key"], MISSING_FILES)

    # running

    def submit(self, name: str, files: DataFrame, workspaces: DataFrame, config: JobConfig | None = None, prefer_stored: bool = True) -> str:
        """The key of the run. With ``prefer_stored`` a stored result is as good as a new one; without, it is cleared first.

        Files of fewer than two submissions have no pairs: such a run is refused.
        """
        config = config or JobConfig()
        key = key_of(name, config)
        with self.lock:
            waiting = self.waiting.get(key)
            if waiting and not waiting.done():
                return key
            if prefer_stored and self.state(key) == COMPLETE:
                return key
            if files.select("submission").where("submission IS NOT NULL").distinct().limit(2).count() < 2 and files.where("submission IS NULL").limit(2).count() < 2:
                raise ValueError("a job needs two submissions")
            self.clear(key)
            self._note(key, QUEUED)
            self.waiting[key] = self.queue.submit(self._run, key, files, workspaces, config)
        return key

    def _run(self, key: str, files: DataFrame, workspaces: DataFrame, config: JobConfig):
        if self.state(key) == CANCELLED:
            return
        context = self.spark.sparkContext
        context.setJobGroup(key, f"job {key}", interruptOnCancel=True)
        try:
            self._note(key, ACTIVE)
            result = run_job(files, workspaces, config, self.registry)
            for table in TABLES:
                df = getattr(result, table)
                if df is not None:
                    df.write.mode("overwrite").parquet(f"{self.folder}/{key}/{table}")
            state, note = COMPLETE, ""
        except Exception as e:
            state, note = FAILED, str(e)[:1000]
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        if self.state(key) != CANCELLED:
            self._note(key, state, note)

    def rerun(self, name: str, files: DataFrame, workspaces: DataFrame, config: JobConfig | None = None) -> str:
        return self.submit(name, files, workspaces, config, prefer_stored=False)

    def wait(self, key: str, seconds: float | None = None) -> str | None:
        if key in self.waiting:
            self.waiting[key].result(seconds)
        return self.state(key)

    def cancel(self, key: str):
        """A queued run never starts; of an active one Spark's jobs end. A run that is over stays as it is."""
        waiting = self.waiting.get(key)
        if waiting and not waiting.done():
            self._note(key, CANCELLED)
            waiting.cancel()
            self.spark.sparkContext.cancelJobGroup(key)

    def progress(self, key: str) -> tuple[int, int]:
        """Tasks that are done and tasks there are, of the stages of the run that Spark still knows."""
        tracker = self.spark.sparkContext.statusTracker()
        done = whole = 0
        for j in tracker.getJobIdsForGroup(key):
            job = tracker.getJobInfo(j)
            for s in job.stageIds if job else ():
                stage = tracker.getStageInfo(s)
                if stage:
                    done, whole = done + stage.numCompletedTasks, whole + stage.numTasks
        return done, whole

    # results

    def clear(self, key: str):
        """Takes away what is stored of a run."""
        self.open.pop(key, None)
        delete(self.spark, f"{self.folder}/{key}")

    def result(self, key: str) -> JobResult:
        """The stored tables; the last KEPT results asked for stay open."""
        if key in self.open:
            self.open.move_to_end(key)
            return self.open[key]
        if self.state(key) != COMPLETE:
            raise KeyError(key)
        found = {}
        for table in TABLES:
            try:
                found[table] = self.spark.read.parquet(f"{self.folder}/{key}/{table}")
            except PySparkException:  # totals of detectors that have none
                found[table] = None
        self.open[key] = JobResult(**found)
        if len(self.open) > KEPT:
            self.open.popitem(last=False)
        return self.open[key]
