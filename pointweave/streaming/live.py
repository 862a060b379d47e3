"""Structured Streaming forms of the batch policies (extensions: the batch operators are the contract)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def distinct_events(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Exact copies collapse while they arrive within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"))


def usable_changes(points: DataFrame, keys: list[str], values: list[str], ts: str | None = None, late: str = "1 day", keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """(keys, change): +1 when a key is first seen, -1 when a copy of it first disagrees; nothing after that.

    The sum of the changes is what the batch policy keeps: equal copies once, conflicting keys not at all. The state of a
    key is a hash of its values and whether it conflicts. With ``ts``, an event time whose watermark is ``late`` behind, a
    key's state goes once the watermark is ``keep_ms`` past its last copy, so the state does not grow for ever; a copy
    that comes after that counts as a first one.
    """
    names = [F.col(k).cast("string").alias(k) for k in keys]
    rows = points.select(*names, F.xxhash64(*values).alias("pw_hash"))
    if ts:
        rows = points.withWatermark(ts, late).select(*names, F.xxhash64(*values).alias("pw_hash"), F.col(ts).alias("pw_ts"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, broken, last = state.get if state.exists else (None, False, 0)
        change = 0
        for b in batches:
            for h in b["pw_hash"]:
                if seen is None:
                    seen, change = int(h), change + 1
                elif h != seen and not broken:
                    broken, change = True, change - 1
            if ts:
                last = max(last, int(b["pw_ts"].max().timestamp() * 1000))
        state.update((seen, broken, last))
        if ts:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + keep_ms)
        if change:
            yield pd.DataFrame([(*key, change)], columns=[*keys, "change"])

    out = ", ".join(f"`{k}` string" for k in keys) + ", change int"
    wait = GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout
    return rows.groupBy(*keys).applyInPandasWithState(run, out, "seen long, broken boolean, last long", "append", wait)
