"""Sliding-window admission: at most ``limit`` admitted events of a key within ``window`` seconds.

A decision depends on the decisions before it, but only through the last ``limit`` admissions, and of
these only through the oldest: an event fits if that one is a window or more away. So the state of a
key is a ring of ``limit`` times. The table form deals events by key, sorts inside the partitions and
carries one ring along; the streaming form keeps the ring as the key's state and holds events back until
the watermark has passed them, so files may come out of order within the lateness.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EMPTY = -math.inf


class Ring:
    """The times of the last admissions; ``turn`` is the slot of the oldest."""

    def __init__(self, slots: list[float], turn: int = 0):
        self.slots, self.turn = slots, turn

    def decide(self, times: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray]:
        """(allowed, seconds until it would be) for rising times; events without a time fit and leave no trace."""
        size = len(self.slots)
        free, wait = np.zeros(len(times), bool), np.full(len(times), max(math.ceil(window), 1))
        timed = ~np.isnan(times)
        if not size:
            wait[~timed] = 1
            return free, wait
        free[~timed] = True
        place = 0
        order = np.flatnonzero(timed)
        moments = times[order]
        while place < len(order):
            due = self.slots[self.turn] + window
            # All events before the oldest admission is a window away wait for the same moment.
            stop = place + int(np.searchsorted(moments[place:], due, side="left"))
            wait[order[place:stop]] = np.maximum(np.ceil(due - moments[place:stop]), 1) if stop > place else 1
            if stop < len(order):
                free[order[stop]] = True
                self.slots[self.turn] = float(moments[stop])
                self.turn = (self.turn + 1) % size
            place = stop + 1
        wait[free] = 0
        return free, wait


def walk(batches: Iterator[pa.RecordBatch], limit: int, window: float) -> Iterator[pa.RecordBatch]:
    """Decisions on events sorted by key, time and id; a key's ring goes on from batch to batch."""
    last, ring = object(), Ring([])
    for batch in batches:
        codes = batch.column("key").dictionary_encode()
        at = batch.column("at").to_numpy(zero_copy_only=False).astype(float)
        index = codes.indices.fill_null(-1).to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(index)) + 1).tolist(), len(index)]
        free, wait = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
        for first, stop in zip(bounds, bounds[1:]):
            if first == stop:
                continue
            key = codes.dictionary[int(index[first])].as_py() if index[first] >= 0 else None
            if key != last:
                last, ring = key, Ring([EMPTY] * limit)
            free[first:stop], wait[first:stop] = ring.decide(at[first:stop], window)
        columns = [batch.column("event_id"), batch.column("key"), pa.array(free), pa.array(wait)]
        yield pa.RecordBatch.from_arrays(columns, ["event_id", "key", "allowed", "retry_after"])


def decision_schema(events: DataFrame) -> str:
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    return f"event_id {types['event_id']}, key {types['key']}, allowed boolean, retry_after bigint"


def admission(events: DataFrame, limit: int, window: float) -> DataFrame:
    """Decisions (event_id, key, allowed, retry_after) on events (event_id, key, at in seconds)."""
    dealt = events.select("event_id", "key", F.col("at").cast("double").alias("at")).repartition("key").sortWithinPartitions("key", "at", "event_id")
    return dealt.mapInArrow(lambda batches: walk(batches, limit, window), decision_schema(events))


def admission_stream(events: DataFrame, limit: int, window: float, lateness: str) -> DataFrame:
    """The same decisions on a stream of (event_id, key, ts), each made once the watermark has passed the event.

    Per key the state holds the ring and the events still held back, which the lateness bounds. Events behind the watermark
    are dropped by the source of the state; ``late_events`` tells how many.
    """
    id_type = dict(events.dtypes)["event_id"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slots, turn, ids, at = state.get if state.exists else ([EMPTY] * limit, 0, [], [])
        waiting = list(zip(at, ids))
        for batch in batches:
            waiting += zip(batch["at"].tolist(), batch["event_id"].tolist())
        waiting.sort()
        passed = state.getCurrentWatermarkMs() / 1000
        due = sum(moment <= passed for moment, _ in waiting)
        ring = Ring(list(slots), turn)
        free, wait = ring.decide(np.array([moment for moment, _ in waiting[:due]], float), window)
        rest = waiting[due:]
        if rest or ring.slots and max(ring.slots) + window > passed:
            state.update((ring.slots, ring.turn, [i for _, i in rest], [float(m) for m, _ in rest]))
            wake = rest[0][0] if rest else max(ring.slots) + window
            state.setTimeoutTimestamp(max(int(wake * 1000), int(passed * 1000)) + 1)
        elif state.exists:
            state.remove()  # the key has been silent for a window: a new ring decides the same
        if due:
            yield pd.DataFrame({"event_id": [i for _, i in waiting[:due]], "key": key[0], "allowed": free, "retry_after": wait})

    timed = events.where("ts IS NOT NULL").withWatermark("ts", lateness).withColumn("at", F.col("ts").cast("double"))
    kept: Any = f"slots array<double>, turn int, ids array<{id_type}>, at array<double>"
    return timed.groupBy("key").applyInPandasWithState(step, decision_schema(events), kept, "append", GroupStateTimeout.EventTimeTimeout)


def late_events(progress: list[dict[str, Any]]) -> int:
    """Events dropped behind the watermark, by a query's progress reports."""
    return sum(int(state.get("numRowsDroppedByWatermark", 0)) for report in progress for state in report["stateOperators"])
