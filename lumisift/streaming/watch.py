"""Progress of a running command: stages named by the caller, advanced by the tasks of their Spark jobs, told on change."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

UPDATES = "run string, seq long, stage string, done int, total int, finished boolean"


class Broker:
    """The latest state of one run. Updates that change nothing are not told, the end is told once, and each told state has a serial."""

    def __init__(self, run: str = "", tell: Callable[[dict], None] = lambda state: None):
        self.state = {"run": run, "seq": 0, "stage": "", "done": 0, "total": 0, "finished": False}
        self.told, self.changed = tell, threading.Condition()

    def _next(self, **said) -> None:
        self.state = self.state | said | {"seq": self.state["seq"] + 1}
        self.told(self.state)
        self.changed.notify_all()

    def update(self, stage: str, done: int, total: int) -> None:
        with self.changed:
            if not self.state["finished"] and (stage, done, total) != tuple(self.state[k] for k in ("stage", "done", "total")):
                self._next(stage=stage, done=done, total=total)

    def finish(self) -> None:
        with self.changed:
            if not self.state["finished"]:
                self._next(finished=True)

    def after(self, seq: int, timeout: float = 15.0) -> dict:
        """The state once it is newer than seq, or as it is when the time is up. Slow readers skip what lies between."""
        with self.changed:
            self.changed.wait_for(lambda: self.state["seq"] > seq, timeout)
            return self.state

    def states(self, bound: float = 300.0, patience: float = 15.0) -> Iterator[dict]:
        """Each state as it comes, until the run has finished or `bound` seconds are over."""
        import time

        until, seq = time.monotonic() + bound, -1
        while (left := until - time.monotonic()) > 0:
            state = self.after(seq, min(patience, left))
            if state["seq"] > seq:
                yield state
            seq = state["seq"]
            if state["finished"]:
                return


class Watch:
    """Feeds a broker from the jobs that run inside a `stage`: tasks done of the tasks known so far."""

    def __init__(self, spark: SparkSession, broker: Broker, every: float = 0.2):
        self.context, self.broker, self.every = spark.sparkContext, broker, every

    def _tasks(self, group: str) -> tuple[int, int]:
        tracker, done, total = self.context.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                one = tracker.getStageInfo(stage)
                if one:
                    done, total = done + one.numCompletedTasks, total + one.numTasks
        return done, total

    @contextmanager
    def stage(self, name: str):
        """Tells `name` 0/0 when it begins, advances as tasks end, and total/total when it ends well. Jobs are the calling thread's."""
        group, over = f"{name}-{uuid.uuid4().hex}", threading.Event()
        self.context.setJobGroup(group, name)
        self.broker.update(name, 0, 0)

        def poll():
            while not over.wait(self.every):
                done, total = self._tasks(group)
                if total:
                    self.broker.update(name, min(done, total - 1), total)  # the end is told when it has come

        thread = threading.Thread(target=poll, daemon=True)
        thread.start()
        try:
            yield
        finally:
            over.set()
            thread.join()
            for key in ("spark.jobGroup.id", "spark.job.description"):
                self.context.setLocalProperty(key, None)
        total = max(1, self._tasks(group)[1])
        self.broker.update(name, total, total)


def log_to(folder: str) -> Callable[[dict], None]:
    """A teller that leaves each state as a file of one JSON line, moved into place, for a stream to pick up."""
    from lumisift.sinks import write_bytes

    return lambda state: write_bytes(f"{folder}/{state['seq']:08}.json", (json.dumps(state) + "\n").encode()) and None


def logged(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of states that runs leave in a folder, oldest files first; `progress.live_stream` follows it."""
    return spark.readStream.schema(UPDATES).option("recursiveFileLookup", True).json(folder)
