"""Files' states as a stream: which changes are legal, and when a changed file is saved.

One transition function serves both forms. A stream keeps a file's state in the engine's store and saves on event-time timers;
a batch folds the sorted log, so that no file's events are held together.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import vocab as V
from ..functions.labels import record_hash

#: A file's events, and what comes of them: saved (status and record as saved) or illegal (the refused status, and the state
#: that refused it as detail).
EVENT = "doc_id string, at timestamp, event_id long, status string, record string"
OUTCOME = "doc_id string, at timestamp, event_id long, kind string, status string, detail string"
STORED = "status string, saved string, key string, due long, event_id long, waiting string, record string"
REST = V.REST_MS * 1000


class State(NamedTuple):
    """A file's state, the key of its last save, and the change that waits to be saved at ``due`` (microseconds)."""

    status: str = "pending"
    saved: str | None = None
    key: str | None = None
    due: int | None = None
    event_id: int | None = None
    waiting: str | None = None
    record: str | None = None


def fired(state: State, now: int | None) -> tuple[State, list[tuple]]:
    """Save what has waited long enough; all that waits, if now is None."""
    if state.due is None or (now is not None and state.due > now):
        return state, []
    return State(state.status, state.key), [(state.due, state.event_id, "saved", state.waiting, state.record)]


def step(state: State, at: int, event_id: int, status: str, record: str | None, key: str) -> tuple[State, list[tuple]]:
    """One event of a file. A change that equals the last save starts no new wait and leaves one that runs."""
    state, out = fired(state, at)
    if status != state.status and status not in V.TRANSITIONS.get(state.status, ()):
        return state, [*out, (at, event_id, "illegal", status, state.status)]
    state = state._replace(status=status)
    if status in V.BUSY or key == state.saved:
        return state, out
    return state._replace(key=key, due=at + REST, event_id=event_id, waiting=status, record=record), out


def keyed(log: DataFrame) -> DataFrame:
    """Events with the key that tells changes: of status and record, the content of the file itself aside."""
    return log.select("doc_id", "at", "event_id", "status", "record").withColumn("key", record_hash("status", "record"))


def outcomes(log: DataFrame) -> DataFrame:
    """OUTCOME of a finished log (EVENT): what was saved when, and refused changes.

    Events of a file count in order of at and event_id. A null doc_id is a file like any other; events without a time come
    first and wait for nothing. Equal events change nothing. An empty log gives no rows.
    """

    def run(batches):
        file, state, begun = None, State(), False
        for batch in batches:
            out = []
            for doc_id, at, event_id, status, record, key in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or doc_id != file:
                    out += [(file, *r) for r in fired(state, None)[1]]
                    file, state, begun = doc_id, State(), True
                state, rows = step(state, at, event_id, status, record, key)
                out += [(doc_id, *r) for r in rows]
            yield table(out)
        yield table([(file, *r) for r in fired(state, None)[1]])

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["doc_id", "at", "event_id", "kind", "status", "detail"])

    rows = keyed(log).withColumn("at", F.coalesce(F.unix_micros("at"), F.lit(0)))
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "at", "event_id")
    return rows.mapInArrow(run, OUTCOME.replace("at timestamp", "at long")).withColumn("at", F.timestamp_micros("at"))


class Saves(StatefulProcessor):
    """The same by file in a stream: a timer at the end of each wait, on the events' own time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("file", STORED)

    def stored(self) -> State:
        if not self.state.exists():
            return State()
        found = self.state.get()
        return State(*[None if pd.isna(x) else int(x) if f in ("due", "event_id") else x for f, x in zip(State._fields, found)])

    def keep(self, state: State) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state.due is not None:
            self.handle.registerTimer(-(-state.due // 1000))
        self.state.update(tuple(state))

    @staticmethod
    def frame(doc_id: str, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(doc_id, *r) for r in rows], columns=["doc_id", "at", "event_id", "kind", "status", "detail"])
        out["at"] = pd.to_datetime(out["at"], unit="us")
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["us", "event_id"])
        state, out = self.stored(), []
        for us, event_id, status, record, change in zip(events["us"], events["event_id"], events["status"], events["record"], events["key"]):
            state, found = step(state, int(us), int(event_id), status, record, change)
            out += found
        self.keep(state)
        yield self.frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, out = fired(self.stored(), expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self.keep(state)
        yield self.frame(key[0], out)

    def close(self) -> None:
        pass


def saves(log: DataFrame, late: str = "1 second") -> DataFrame:
    """OUTCOME of a stream (EVENT). Events of one trigger count in order of time, those of later triggers after them; what comes
    later than the watermark is dropped. A wait ends when the watermark has passed it. Needs the store that state_store() sets."""
    rows = keyed(log).withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    return rows.groupBy("doc_id").transformWithStateInPandas(Saves(), OUTCOME, "append", "eventTime")


def state_store(spark: SparkSession) -> None:
    """The store of keyed state with timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
