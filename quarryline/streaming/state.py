"""Streams with state: events and entities into versioned tables, and failures since the last success of each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.package import ship
from ..sources.versioned import VersionedTable


def load_events_into(stream: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Events that the table doesn't have yet, once each, until no more are there.

    The table itself is the memory of what was seen, so an event that comes again is known after any time and restart; a
    part that is run again after a failure adds nothing twice.
    """
    return _each_part(stream, lambda part, _: table.load_events(part, F.current_timestamp()), checkpoint, "append")


def upsert_into(stream: DataFrame, table: VersionedTable, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Rows replace those of their key; of a part's rows for one key the one whose values come last."""
    return _each_part(stream, lambda part, _: table.upsert(part, F.lit(0)), checkpoint, mode)


def _each_part(stream: DataFrame, write, checkpoint: str, mode: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def failures_since_success(stream: DataFrame, key: list[str], failed: str, succeeded: str, time: str, late: str = "1 hour", idle_hours: float = 24 * 30) -> DataFrame:
    """(key.., failures) of every key that a part touches: its failed rows after its last success, as in the batch query of that name.

    Rows may come in any order, but not later than `late` behind the newest. A key's state is the last success, the
    number of failures that no success to come can precede, and the times of the newer ones; a
    key without rows for idle_hours is forgotten, by a timer. Rows without a time don't count.
    """
    ship(stream.sparkSession)
    rows = stream.select(*key, F.col(time).alias("__time"), F.coalesce(F.col(failed), F.lit(False)).alias("__failed"), F.coalesce(F.col(succeeded), F.lit(False)).alias("__ok")).filter("__time is not null").withWatermark("__time", late)
    names, idle = list(key), int(idle_hours * 3_600_000)

    def count(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, settled, recent = state.get if state.exists else (None, 0, [])
        recent, newest = list(recent), 0
        for part in parts:
            at = part["__time"].astype("datetime64[us]").astype("int64")
            newest = max(newest, int(at.max()))
            good = at[part["__ok"]]
            if len(good) and (last is None or int(good.max()) > last):
                last, settled = int(good.max()), 0
            recent += at[part["__failed"]].tolist()
        recent = [t for t in recent if last is None or t > last]
        mark = state.getCurrentWatermarkMs()
        settled += sum(t < mark * 1000 for t in recent)
        recent = [t for t in recent if t >= mark * 1000]
        state.update((last, settled, recent))
        state.setTimeoutTimestamp(max(newest // 1000 + idle, mark + 1))
        yield pd.DataFrame({**{n: [g] for n, g in zip(names, group, strict=True)}, "failures": [settled + len(recent)]})

    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in key)
    return rows.groupBy(*key).applyInPandasWithState(count, f"{kinds}, failures long", "last long, settled long, recent array<long>", "update", GroupStateTimeout.EventTimeTimeout)
