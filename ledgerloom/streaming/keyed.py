"""Keyed state in the record stream.

``assembled`` puts the parts of a run together as they come, in any order and
over any number of batches.  ``latest`` lets a record through only if it is newer
than all records of its key before it, so a late old record never replaces a
newer one.  Both keep their state in the checkpoint; a query that is stopped
between two batches and started again goes on as if it had not been.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.incremental import RuleBook
from ..schemas import KEY, TABLE
from ..session import ship_package
from ..sources.record_store import RecordStore

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ASSEMBLED = "run_id string, status string, parts string"


class _Assembler(StatefulProcessor):
    """State of a run: its parts so far, and its end once it has come."""

    def __init__(self, needed: list[str], wait_ms: int, keep_ms: int):
        self.needed, self.wait_ms, self.keep_ms = set(needed), wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "part string", "payload string")
        # forgotten after a while, so the state does not grow with all runs ever seen
        self.ended = handle.getValueState("ended", "status string", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, str] = {}
        for frame in rows:
            for part, payload in sorted(zip(frame["part"], frame["payload"])):
                new[part] = payload  # of a repeated part the last by its text stays
        if self.ended.exists():
            if self.ended.get()[0] != "complete":  # parts that come after the wait; repeats of a finished run are dropped
                yield self._row(key, "late", new)
            return
        for part, payload in new.items():
            self.parts.updateValue((part,), (payload,))
        found = {k[0]: v[0] for k, v in self.parts.iterator()}
        if self.needed <= set(found):
            yield self._end(key, "complete", found)
        elif not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.ended.exists():
            yield self._end(key, "incomplete", {k[0]: v[0] for k, v in self.parts.iterator()})

    def _end(self, key, status: str, found: dict[str, str]) -> pd.DataFrame:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        self.parts.clear()
        self.ended.update((status,))
        return self._row(key, status, found)

    @staticmethod
    def _row(key, status: str, found: dict[str, str]) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]], "status": [status], "parts": [json.dumps(found, sort_keys=True)]})

    def close(self) -> None:
        pass


class _Latest(StatefulProcessor):
    """State of a key: when its newest record was made, and of which run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "ingested_at string, run_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for frame in rows:
            for row in frame.to_dict("records"):
                at = (row["ingested_at"] or "", row["run_id"] or "")
                if last is None or at > last[0]:
                    last = at, row["record"]
        if last is None or self.newest.exists() and tuple(self.newest.get()) >= last[0]:
            return
        self.newest.update(last[0])
        yield pd.DataFrame({"record": [last[1]]})

    def close(self) -> None:
        pass


def assembled(parts: DataFrame, needed: list[str], wait_seconds: float = 3600, keep_seconds: float = 7 * 86_400) -> DataFrame:
    """run_id, status, parts (JSON): ``complete`` once all ``needed`` parts of a run
    are there (further repeats are dropped), ``incomplete`` if they are not after
    ``wait_seconds``, ``late`` for what comes after that.  ``parts`` is a stream of
    run_id, part, payload; rows without a run or part are left out."""
    ship_package(parts.sparkSession)
    parts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    usable = parts.where("run_id IS NOT NULL AND part IS NOT NULL").select("run_id", "part", F.coalesce("payload", F.lit("")).alias("payload"))
    processor = _Assembler(needed, int(wait_seconds * 1000), int(keep_seconds * 1000))
    return usable.groupBy("run_id").transformWithStateInPandas(processor, ASSEMBLED, "Append", "ProcessingTime")


def latest(records: DataFrame) -> DataFrame:
    """Records of a stream that are newer (ingested_at, run_id) than all of their key
    before; of one batch the newest.  Rows without a whole key are left out."""
    ship_package(records.sparkSession)
    records.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    usable = records.where(" AND ".join(f"{k} IS NOT NULL" for k in KEY))
    packed = usable.select(*KEY, "ingested_at", "run_id", F.to_json(F.struct(*TABLE.fieldNames())).alias("record"))
    found = packed.groupBy(*KEY).transformWithStateInPandas(_Latest(), "record string", "Append", "None")
    return found.select(F.from_json("record", TABLE).alias("r")).select("r.*")


def store_stream(records: DataFrame, store: RecordStore, checkpoint: str, book: RuleBook | None = None, after: Callable[[RecordStore], None] | None = None, once: bool = False) -> StreamingQuery:
    """Newest records of a stream into the store, then the rules.  A batch that is
    run again after a crash replaces records by themselves."""

    def write(batch: DataFrame, batch_id: int) -> None:
        change = store.upsert(batch)
        if book is not None:
            book.apply(change)
        if after is not None:
            after(store)

    query = latest(records).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="30 seconds")).start()
