"""Progress of a run as a stream: changes only, numbered; and the latest state of each run."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from lumisift.shipping import ship

ship(__name__)

#: Fixed value: of so many steps one is told.
EVERY = 20
CHANGES = "run string, seq long, stage string, done int, total int, serial long"


def changes(updates: DataFrame) -> DataFrame:
    """updates(run, seq, stage, done, total), a batch -> those that differ from the one before, with a serial per run."""
    order = W.partitionBy("run").orderBy("seq")
    said = F.struct("stage", "done", "total")
    first = F.row_number().over(order) == 1
    marked = updates.withColumn("_new", first | ~said.eqNullSafe(F.lag(said).over(order))).where("_new").drop("_new")
    return marked.withColumn("serial", F.row_number().over(order).cast("long"))


def change_stream(updates: DataFrame) -> DataFrame:
    """The same over a stream, keeping the last update and the serial of each run. Within a micro-batch, seq orders updates."""

    def step(key, frames: Iterator, state):
        import pandas as pd

        last, serial = (None, 0)
        if state.exists:
            stage, done, total, serial = state.get
            last = (stage, done, total)
        out = []
        for row in sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.seq):
            said = (row.stage, int(row.done), int(row.total))
            if said != last:
                last, serial = said, serial + 1
                out.append((key[0], int(row.seq), *said, serial))
        if last is not None:
            state.update((*last, serial))
        yield pd.DataFrame(out, columns=["run", "seq", "stage", "done", "total", "serial"])

    return updates.groupBy("run").applyInPandasWithState(step, CHANGES, "stage string, done int, total int, serial long", "append", "NoTimeout")


LIVE = "run string, seq long, stage string, done int, total int, finished boolean, serial long, ended string"
#: A run is followed for so many seconds after its first update, unless it finishes before.
BOUND = 300
#: What a stream with timers needs of the session.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def live_stream(updates: DataFrame, bound: float = BOUND) -> DataFrame:
    """A stream of updates(run, seq, stage, done, total, finished) -> what a follower of each run is shown: LIVE.

    Changes only, numbered by run. The first update with `finished` is shown once, whatever it repeats, and ends the run (ended = finished); a run that is still
    open `bound` seconds of processing time after its first update ends by a timer with its last state (ended = expired). What comes after an end is not shown. Needs
    the state store that ROCKS names.
    """
    from pyspark.sql.streaming import StatefulProcessor

    names = [c.split()[0] for c in LIVE.split(", ")]

    class Follow(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("last", "seq long, stage string, done int, total int, serial long, ended boolean")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            seq, stage, done, total, serial, ended = self.state.get() if self.state.exists() else (-1, None, None, None, 0, False)
            if serial == 0 and not ended:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(bound * 1000))
            out = []
            for r in sorted((r for f in rows for r in f.itertuples(index=False)), key=lambda r: r.seq):
                said = (r.stage, int(r.done), int(r.total))
                if ended or (said == (stage, done, total) and not r.finished):
                    continue
                seq, (stage, done, total), serial, ended = int(r.seq), said, serial + 1, bool(r.finished)
                out.append((key[0], seq, *said, ended, serial, "finished" if ended else None))
            self.state.update((seq, stage, done, total, serial, ended))
            if ended:
                for at in list(self.handle.listTimers()):
                    self.handle.deleteTimer(at)
            yield pd.DataFrame(out, columns=names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            seq, stage, done, total, serial, ended = self.state.get()
            if not ended:
                self.state.update((seq, stage, done, total, serial + 1, True))
                yield pd.DataFrame([(key[0], seq, stage, done, total, False, serial + 1, "expired")], columns=names)

        def close(self):
            pass

    return updates.groupBy("run").transformWithStateInPandas(Follow(), LIVE, "Append", "ProcessingTime")


def latest(changed: DataFrame) -> DataFrame:
    """The newest state of each run, for batches and for streams in complete or update mode; slow readers skip what lies between."""
    best = F.max_by(F.struct("stage", "done", "total", "serial"), "serial")
    return changed.groupBy("run").agg(best.alias("s")).select("run", "s.*", (F.col("s.stage") == "done").alias("finished"))


def cadence(done: Column, total: Column, every: int = EVERY) -> Column:
    """Whether a step of a stage is told: its start, each `every`-th, and its end."""
    return (done % every == 0) | (done == total)


def watched(rows: DataFrame, name: str):
    """(rows, observation): the observation's `rows` is how many passed once an action has run."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen
