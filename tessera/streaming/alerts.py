"""Alerts that fire because nothing happened: a timer a job instead of scans of all jobs.

A job's state is its status, since when, and whether the alert of that status is out.  Every status has at most one
deadline; an event-time timer raises the alert when the watermark passes it without another event coming in, and the
event that ends the status resolves it.  What is raised and resolved after each batch is what the scans of
`operators.monitors` find in the jobs as of the watermark.  State and timers are in the stream's checkpoint, so a
restart raises nothing twice.  A job without a deadline (ended, or its alert is out) is forgotten `keep` after its last
event; later events then start it anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.values import parse_iso
from tessera.operators.lifecycle import refusal
from tessera.operators.monitors import Limits

STATE = "status string, since timestamp, event_id string, due timestamp, raised boolean"
OUT = "job_id string, kind string, action string, at timestamp, since timestamp, threshold_minutes int"
#: The alert of each status that is watched from its own beginning, and of those whose events name a time.
FROM_CHANGE = {"pending": "undispatched", "dispatched": "stuck_dispatched", "in_progress": "stuck_in_progress", "completed": "closing_unfiled"}
FROM_PAYLOAD = {"appt_set": ("appt_time_passed", "appt_iso"), "needs_follow_up": ("follow_up_due", "follow_up_at")}


def thresholds(limits: Limits) -> dict[str, tuple[str, int]]:
    """The kind and the minutes of the alert of each watched status."""
    minutes = {"appt_set": limits.appt_grace, "needs_follow_up": 0} | {s: getattr(limits, k) for s, k in FROM_CHANGE.items()}
    return {s: (FROM_CHANGE.get(s) or FROM_PAYLOAD[s][0], m) for s, m in minutes.items()}


def timed_alerts(events: DataFrame, limits: Limits = Limits(), late: str = "1 hour", keep_days: int = 90) -> DataFrame:
    """OUT: a row whenever an alert of a job is raised (at its deadline) or resolved (at the event that ended it).

    events: id, job_id, to_status, source, payload, created_at, as a stream; invalid ones don't count.
    """
    kinds = thresholds(limits)
    named = [F.when(F.col("to_status") == s, parse_iso(F.get_json_object("payload", f"$.{f}"))) for s, (_, f) in FROM_PAYLOAD.items()]
    valid = events.where(refusal().isNull()).select(F.col("job_id").cast("string"), F.col("id").cast("string"), "to_status", "created_at", F.coalesce(*named).alias("named"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        none, out = pd.NaT, []
        status, since, event, due, raised = state.get if state.exists else (None, none, "", none, False)
        since, due = pd.Timestamp(since), pd.Timestamp(due)

        def told(action: str, at: pd.Timestamp) -> None:
            kind, minutes = kinds[status]
            out.append((key[0], kind, action, at, since, minutes))

        def pass_time(now: pd.Timestamp) -> None:
            nonlocal raised
            if not raised and due is not pd.NaT and due < now:
                told("raised", due)
                raised = True

        for pdf in batches:
            for e in pdf.sort_values(["created_at", "id"]).itertuples():
                if status is not None and (e.created_at, e.id) <= (since, event):
                    continue  # overtaken by a later event
                pass_time(e.created_at)
                if raised:  # an event of the same status starts its clock anew
                    told("resolved", e.created_at)
                status, since, event, raised = e.to_status, e.created_at, e.id, False
                start = since if status in FROM_CHANGE else e.named if status in FROM_PAYLOAD else none
                due = start + pd.Timedelta(minutes=kinds[status][1]) if status in kinds and start is not pd.NaT else none
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        pass_time(mark)
        end = since + pd.Timedelta(days=keep_days)
        if state.hasTimedOut and (raised or due is pd.NaT) and end < mark:
            state.remove()
        else:
            state.update((status, since.to_pydatetime(), event, None if due is pd.NaT else due.to_pydatetime(), raised))
            wake = end if raised or due is pd.NaT else due
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(wake.value // 1_000_000) + 1))
        yield pd.DataFrame(out, columns=["job_id", "kind", "action", "at", "since", "threshold_minutes"])

    return valid.withWatermark("created_at", late).groupBy("job_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def open_now(told: DataFrame) -> DataFrame:
    """job_id, kind, at, since of the alerts that are out after all rows of `timed_alerts` so far."""
    last = told.groupBy("job_id", "kind").agg(F.max_by(F.struct("action", "at", "since"), F.struct("at", F.when(F.col("action") == "raised", 1).otherwise(0))).alias("_l"))
    return last.where("_l.action = 'raised'").select("job_id", "kind", "_l.at", "_l.since")
