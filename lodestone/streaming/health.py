"""Heartbeats as a stream: the last one of each node to arrive, and its health when nothing more comes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cluster import DEAD_AFTER_S, SUSPECT_AFTER_S

OUT = "id string, addr string, capacity long, used long, last_seen timestamp, state string"
STATE = "addr string, capacity long, used long, last_seen timestamp, health string"


def node_states(heartbeats: DataFrame, suspect_s: int = SUSPECT_AFTER_S, dead_s: int = DEAD_AFTER_S, timers: bool = True) -> DataFrame:
    """A row whenever a node reports, and one each when it turns suspect and dead.

    heartbeats(arrival_seq, id, addr, capacity, used, time). Timers run on processing time.
    """

    def handle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            addr, capacity, used, seen, health = state.get
            health = "suspect" if health == "alive" else "dead"
            state.update((addr, capacity, used, seen, health))
            if health == "suspect":
                state.setTimeoutDuration((dead_s - suspect_s) * 1000)
        else:
            last = pd.concat(list(frames)).sort_values("arrival_seq").iloc[-1]
            addr, capacity, used, seen, health = last.addr, int(last.capacity), int(last.used), last.time, "alive"
            state.update((addr, capacity, used, seen, health))
            if timers:
                state.setTimeoutDuration(suspect_s * 1000)
        yield pd.DataFrame({"id": [key[0]], "addr": [addr], "capacity": [capacity], "used": [used], "last_seen": [seen], "state": [health]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout
    valid = heartbeats.where("id <> '' AND addr <> ''")
    return valid.groupBy("id").applyInPandasWithState(handle, OUT, STATE, "update", timeout)
