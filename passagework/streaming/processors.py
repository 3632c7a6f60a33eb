"""Stateful processors: decisions that depend on the order of events of a key.

The class definitions travel with the job: the process that checks the state schema
does not see files added to the session.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.streaming.stateful_processor import ListState, StatefulProcessor, StatefulProcessorHandle

from passagework.constants import ALERT_GAP_SECONDS, RATE_LIMIT

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 16  # rows of a state that travel together


def _packed(frame: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(frame, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _stored(state: ListState) -> list[pd.DataFrame]:
    return [pa.ipc.open_stream(row[0]).read_pandas() for row in state.get()]


def _store(state: ListState, frame: pd.DataFrame) -> None:
    state.clear()
    for at in range(0, len(frame), CHUNK):
        state.appendValue((_packed(frame.iloc[at : at + CHUNK]),))


class _InOrder(StatefulProcessor):
    """Hold rows back until the watermark has passed them, then walk them in time order.

    Arrival order inside a micro-batch is arbitrary; without the buffer a stream
    could decide differently from a batch over the same rows. The states hold rows as
    packed frames, since a state of single rows is sent and encoded row by row.
    """

    columns: dict[str, str]  # kept columns and their types, in the order rows are walked in

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.past = handle.getListState("past", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues, [frame[list(self.columns)].astype(self.columns) for frame in rows])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues, [])

    def _release(self, key, timers, arrived: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark = timers.getCurrentWatermarkInMs() * 1000
        frames = _stored(self.waiting) + arrived
        if not frames:
            return
        held = pd.concat(frames, ignore_index=True).sort_values(list(self.columns))
        due = held["us"] <= mark
        if len(arrived) or due.any():
            rest = held[~due]
            _store(self.waiting, rest)
            if len(rest):
                # One timer per state, due when the oldest waiting row is passed.
                self.handle.registerTimer(int(rest["us"].min()) // 1000 + 1)
        if due.any():
            yield self.walk(key, held[due], mark)

    def close(self) -> None:
        pass

    def walk(self, key, ready: pd.DataFrame, mark: int) -> pd.DataFrame:
        """Decide ``ready`` rows; all that come later are after ``mark``."""
        raise NotImplementedError


class Debounce(_InOrder):
    """Fire only when the last fire is more than the gap ago; a quiet sample resets."""

    columns = {"us": "int64", "event_id": "int64", "value": "float64", "triggered": "bool"}

    def __init__(self, gap_seconds: int = ALERT_GAP_SECONDS):
        self.gap = gap_seconds * 1_000_000

    def walk(self, key, ready: pd.DataFrame, mark: int) -> pd.DataFrame:
        past = [us for frame in _stored(self.past) for us in frame["us"].tolist()]
        last = past[0] if past else None
        fired = []
        for us, triggered in zip(ready["us"].tolist(), ready["triggered"].tolist(), strict=True):
            fires = triggered and (last is None or us - last > self.gap)
            if fires:
                last = us
            elif not triggered:
                last = None
            fired.append(fires)
        _store(self.past, pd.DataFrame({"us": [] if last is None else [last]}, dtype="int64"))
        return pd.DataFrame({"rule_id": key[0], "event_id": ready["event_id"], "value": ready["value"], "fired": fired})


class RateLimit(_InOrder):
    """Admit while fewer than ``limit`` admitted requests of a key lie in the window.

    A state is that of a bucket of keys: what a state costs by itself, calls and frames, is far more than walking a
    key's rows. The bucket of rows without a key is negative.
    """

    columns = {"key": "int64", "us": "int64", "event_id": "int64"}

    def __init__(self, limit: int = RATE_LIMIT[0], seconds: int = RATE_LIMIT[1]):
        self.limit, self.window = limit, seconds * 1_000_000

    def walk(self, key, ready: pd.DataFrame, mark: int) -> pd.DataFrame:
        seen: dict[int, deque] = {}
        for frame in _stored(self.past):
            for name, us in zip(frame["key"].tolist(), frame["us"].tolist(), strict=True):
                seen.setdefault(name, deque()).append(us)
        admitted, left = [], []
        for name, us in zip(ready["key"].tolist(), ready["us"].tolist(), strict=True):
            live = seen.get(name)
            if live is None:
                live = seen[name] = deque()
            while live and live[0] <= us - self.window:
                live.popleft()
            admitted.append(len(live) < self.limit)
            if admitted[-1]:
                live.append(us)
            left.append(self.limit - len(live))
        # What has left the window of every later row is forgotten.
        kept = [(name, us) for name, live in seen.items() for us in live if us > mark - self.window]
        _store(self.past, pd.DataFrame(kept, columns=["key", "us"], dtype="int64"))
        names = ready["key"] if key[0] >= 0 else pd.Series(pd.NA, ready.index, "Int64")
        return pd.DataFrame({"key": names, "event_id": ready["event_id"], "admitted": admitted, "remaining": left})
