"""A scan from listing to pairs, with states, progress and cancellation."""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinspark.engines import Engine
from twinspark.functions import paths
from twinspark.operators import files as file_ops
from twinspark.plans.shared import kept

log = logging.getLogger(__name__)

IDLE, DISCOVERY, INDEXING, MATCHING = "idle", "discovery", "indexing", "matching"


class Cancelled(Exception):
    """The scan was asked to stop."""


class Events:
    """Handlers by name of event; one that fails doesn't stop the others."""

    def __init__(self):
        self.handlers: dict[str, list[Callable]] = {}

    def on(self, name: str, handler: Callable) -> None:
        self.handlers.setdefault(name, []).append(handler)

    def emit(self, name: str, *args) -> None:
        for handler in self.handlers.get(name, []):
            try:
                handler(*args)
            except Exception:  # noqa: BLE001 - a listener's fault is its own
                log.exception("handler of %s", name)


class Throttle:
    """Passes a value on at most once in ``seconds``; ``flush`` passes on the last one that was held back."""

    def __init__(self, emit: Callable, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.emit, self.seconds, self.clock = emit, seconds, clock
        self.at: float | None = None
        self.held: tuple | None = None

    def __call__(self, *args) -> None:
        now = self.clock()
        if self.at is not None and now - self.at < self.seconds:
            self.held = args
            return
        self.at, self.held = now, None
        self.emit(*args)

    def flush(self) -> None:
        if self.held is not None:
            args, self.held = self.held, None
            self.emit(*args)


class Scan:
    """idle, discovery, indexing, matching, idle; ``cancel`` stops the Spark jobs that run and all that would follow.

    ``listing`` has the columns that ``engine.fingerprint`` needs besides path and last_modified. An empty listing ends
    the scan. Only stale paths are fingerprinted; ``files`` is the table of files afterwards.
    """

    def __init__(self, engine: Engine, roots: list[str], threshold: float | None = None, events: Events | None = None):
        self.engine, self.roots = engine, roots
        self.threshold = engine.threshold if threshold is None else threshold
        self.events = events or Events()
        self.state = IDLE
        self.stop = False
        self.tag = f"scan-{uuid.uuid4().hex}"
        self.files: DataFrame | None = None

    def cancel(self) -> None:
        self.stop = True
        if self.files is not None:
            self.files.sparkSession.sparkContext.cancelJobsWithTag(self.tag)

    def _enter(self, state: str) -> None:
        if self.stop and state != IDLE:
            raise Cancelled(self.state)
        self.state = state
        self.events.emit("state", state)

    def run(self, listing: DataFrame, known: DataFrame) -> DataFrame | None:
        """Pairs (id1, id2, distance) of files inside the roots; nothing where there is no file or the scan was cancelled."""
        context = listing.sparkSession.sparkContext
        self.files = known
        context.addJobTag(self.tag)
        try:
            return self._run(listing, known)
        except Cancelled:
            return None
        except Exception:
            if self.stop:  # the jobs were cancelled
                return None
            raise
        finally:
            context.removeJobTag(self.tag)
            self._enter(IDLE)

    def _run(self, listing: DataFrame, known: DataFrame) -> DataFrame | None:
        self._enter(DISCOVERY)
        found = listing.where(paths.in_roots(F.col("path"), self.roots))
        n = found.count()
        self.events.emit("found", n)
        if not n:
            return None
        self._enter(INDEXING)
        prints = kept(self.engine.fingerprint(file_ops.stale(found, known)))  # an upsert reads them more than once
        self.files = kept(file_ops.upsert(known, prints.withColumn("seq", F.lit(0))))
        self._enter(MATCHING)
        scope = self.files.where(paths.in_roots(F.col("path"), self.roots))
        return kept(self.engine.pairs(scope, self.threshold))


def progress(done: Column, total: Column) -> Column:
    """Per cent, rounded down; 0 where there is nothing to do."""
    return F.when(total > 0, F.floor(100 * done / total)).otherwise(F.lit(0)).cast("int")


def chunk_size(total: Column, cpus: Column) -> Column:
    """How many items go to a worker at a time: a quarter of its share, one at least."""
    return F.greatest(F.lit(1), F.floor(total / (4 * cpus))).cast("long")


class JobProgress:
    """Per cent of the tasks of the Spark jobs that are started inside it, passed on at most once in ``seconds``.

    Used as ``with JobProgress(spark, emit):`` around actions of this thread. Later
    stages become known as they start, so shares are of the tasks known so far; a share
    that would fall is held back. 100 is passed on at the end, unless the work has failed.
    """

    def __init__(self, spark: SparkSession, emit: Callable[[int], None], seconds: float = 0.5, every: float = 0.1):
        self.context, self.every = spark.sparkContext, every
        self.throttle = Throttle(emit, seconds)
        self.group, self.most, self.over = f"progress-{uuid.uuid4().hex}", -1, threading.Event()
        self.watcher = threading.Thread(target=self._watch, daemon=True)

    def _tell(self, percent: int) -> None:
        if percent > self.most:
            self.most = percent
            self.throttle(percent)

    def _watch(self) -> None:
        tracker = self.context.statusTracker()
        while not self.over.wait(self.every):
            jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(self.group)]
            stages = [tracker.getStageInfo(s) for s in {s for j in jobs if j for s in j.stageIds}]
            known = [s for s in stages if s]
            total = sum(s.numTasks for s in known)
            if total:
                self._tell(min(99, 100 * sum(s.numCompletedTasks for s in known) // total))

    def __enter__(self) -> JobProgress:
        self.context.setJobGroup(self.group, "progress", True)
        self.watcher.start()
        return self

    def __exit__(self, kind, value, trace) -> None:
        self.over.set()
        self.watcher.join()
        self.context.setLocalProperty("spark.jobGroup.id", None)
        if kind is None:
            self._tell(100)
        self.throttle.flush()


def throttled(rows: DataFrame, key: str, at: str, seconds: int, *order: str) -> DataFrame:
    """Of a key's rows within each stretch of ``seconds`` the last one, as a trigger of that interval would emit them."""
    rows = rows.withColumn("_slot", F.window(at, f"{seconds} seconds"))
    last = F.row_number().over(W.partitionBy(key, "_slot").orderBy(*[F.desc(c) for c in (at, *order)]))
    return rows.withColumn("_k", last).where("_k = 1").drop("_k", "_slot")
