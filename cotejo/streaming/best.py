"""The surest reading of each identifier, kept in a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

KEYS = ("form_id", "id_number")
#: State stores that keep timers and state variables.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class BestReading(StatefulProcessor):
    """State of one (form, identifier): the surest reading so far, the first slot it was seen in, and when it is given out.

    A reading replaces the kept one if it is surer, or as sure and earlier on the form. The timer stands at the newest
    arrival; once the watermark has passed it no reading of the key is still to come, so the survivor is given out and the
    state is cleared. A reading in the very batch in which its key's timer is due starts anew."""

    def __init__(self, carried: T.StructType, slot: str, confidence: str):
        self.carried, self.slot, self.confidence = carried, slot, confidence
        self.names = carried.names

    def init(self, handle) -> None:
        self.handle = handle
        fields = [*self.carried.fields, T.StructField("_first", self.carried[self.slot].dataType), T.StructField("_due", T.LongType())]
        self.kept = handle.getValueState("kept", T.StructType(fields))

    def _rank(self, row: tuple) -> tuple:
        sure, slot = (row[self.names.index(c)] for c in (self.confidence, self.slot))
        return sure is not None, sure or 0.0, slot is None, -(slot or 0)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = first = due = before = None
        if self.kept.exists():
            *best, first, due = self.kept.get()
            before = due
            if due <= timerValues.getCurrentWatermarkInMs():
                yield self._row(key, best, first)
                best = first = due = None
        for row in rows:
            now = tuple(row[c] for c in self.names)
            slot = row[self.slot]
            first = slot if first is None or slot is not None and slot < first else first
            best = now if best is None or self._rank(now) > self._rank(best) else best
            due = row["_at"] if due is None else max(due, row["_at"])
        if before is not None and before != due:
            self.handle.deleteTimer(before)
        if before != due:
            self.handle.registerTimer(due)
        self.kept.update((*best, first, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        *best, first, _ = self.kept.get()
        self.kept.clear()
        yield self._row(key, best, first)

    def _row(self, key, best, first) -> Row:
        return Row(**dict(zip(KEYS, key)), **dict(zip(self.names, best)) | {self.slot: first})


def best_readings(readings: DataFrame, delay: str = "10 minutes", time: str = "arrived", slot: str = "ord",
                  confidence: str = "confidence") -> DataFrame:
    """The surest reading per (form, identifier), in the slot of its first occurrence, ties to the first: what
    ``reconcile.dedupe_best`` gives for a table. It comes out when the watermark passes the last arrival of its key; readings
    later than ``delay`` are dropped. Needs the settings ``STATE_STORE``."""
    carried = T.StructType([f for f in readings.schema.fields if f.name not in (*KEYS, time)])
    out = T.StructType([readings.schema[k] for k in KEYS] + carried.fields)
    timed = readings.withWatermark(time, delay).withColumn("_at", F.unix_millis(time))
    return timed.groupBy(*KEYS).transformWithState(
        BestReading(carried, slot, confidence), outputStructType=out, outputMode="Append", timeMode="EventTime")
