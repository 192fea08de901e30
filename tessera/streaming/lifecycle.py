"""Life cycles as keyed state: the status of each job after every batch of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.lifecycle import refusal

STATE = "lifecycle_status string, changed_at timestamp, event_id string, n_events long"
OUT = f"job_id string, {STATE}"


def job_states(events: DataFrame, late: str = "14 days") -> DataFrame:
    """A row a job and batch: its status after all valid events so far, the newest by (created_at, id) deciding.

    State ends once the watermark has passed a job's last event, `late` after it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, at, event, n = state.get if state.exists else (None, None, None, 0)
        for pdf in batches:
            n += len(pdf)
            last = pdf.sort_values(["created_at", "id"]).iloc[-1]
            if at is None or (last["created_at"], last["id"]) > (pd.Timestamp(at), event):
                status, at, event = last["to_status"], last["created_at"].to_pydatetime(), last["id"]
        state.update((status, at, event, n))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(pd.Timestamp(at).timestamp() * 1000) + 1))
        yield pd.DataFrame([(key[0], status, pd.Timestamp(at), event, n)], columns=["job_id", "lifecycle_status", "changed_at", "event_id", "n_events"])

    valid = events.where(refusal().isNull()).select("job_id", "id", "to_status", "created_at").withWatermark("created_at", late)
    return valid.groupBy("job_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
