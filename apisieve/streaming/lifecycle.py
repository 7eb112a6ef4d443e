"""The linear lifecycle over a stream: state of one object, kept between micro-batches.

``applyInPandasWithState`` holds four numbers an object; facts of one object must reach
the stream in order within a micro-batch's sort by fact_id. State that sees no fact for
``timeout`` is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "object long, fact_id long, source_at long, requirement_at long"
STATE = "source_at long, match_at long, write_at long"


def stream_lifecycle(facts: DataFrame, timeout: str = "1 hour") -> DataFrame:
    """facts: object, fact_id, action (source, match, write, sink, kill). One row at every sink reached ready."""
    keep_ms = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
    number, unit = timeout.split()
    wait = int(number) * keep_ms[unit.rstrip("s")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        source, match, write = state.get if state.exists else (None, None, None)
        found = []
        rows = pd.concat(list(batches)).sort_values("fact_id", kind="stable")
        for fact, action in zip(rows["fact_id"], rows["action"], strict=True):
            fact = int(fact)
            if action == "source":
                source, match, write = fact, None, None
            elif action == "kill":
                source = match = write = None
            elif source is not None and action in ("match", "write"):
                write = fact
                match = fact if action == "match" else match
            elif source is not None and action == "sink" and match is not None and match == write:
                found.append((int(key[0]), fact, source, match))
        state.update((source, match, write))
        state.setTimeoutDuration(wait)
        yield pd.DataFrame(found, columns=["object", "fact_id", "source_at", "requirement_at"])

    return facts.groupBy("object").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
