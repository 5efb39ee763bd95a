"""Directly-follows pairs of a stream of events, as they become known.

Each case keeps the last event that was final; events are held until the watermark passes them, so late
events within the watermark take their right place. A case that is silent for ``idle`` is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "case_id string, a string, b string, ts timestamp"
STATE = "held array<struct<ts: timestamp, activity: string>>, last string"


def directly_follows_stream(events: DataFrame, delay: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """case_id, a, b, ts from a stream with case_id, activity and ts (timestamp): ``b`` is the next event of
    the case after ``a``. Instantaneous events; those of equal time go in the order of their activities."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = ([(h["ts"] if isinstance(h, dict) else h[0], h["activity"] if isinstance(h, dict) else h[1]) for h in state.get[0]], state.get[1]) if state.exists else ([], None)
        for pdf in batches:
            held += list(zip(pdf["ts"], pdf["activity"], strict=True))
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        held.sort()
        ready = [h for h in held if pd.Timestamp(h[0]) <= mark] if not state.hasTimedOut else held
        held = held[len(ready) :]
        out = []
        for ts, activity in ready:
            if last is not None:
                out.append((str(key[0]), last, activity, ts))
            last = activity
        if state.hasTimedOut:
            state.remove()
        else:
            state.update(([(pd.Timestamp(h[0]).to_pydatetime(), h[1]) for h in held], last))
            until = max([pd.Timestamp(h[0]).value // 1_000_000 for h in held], default=state.getCurrentWatermarkMs() + idle_ms)
            state.setTimeoutTimestamp(max(int(until), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["case_id", "a", "b", "ts"])

    return events.withWatermark("ts", delay).groupBy("case_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
