"""Job life cycles: valid transitions, current state, replies attributed to dispatches, folds over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import blank
from tessera.functions.values import parse_iso
from tessera.operators.joins import nearest, recent
from tessera.operators.perkey import latest
from tessera.schemas import STATUSES, TERMINAL

#: Alert kinds that a job's arrival in a terminal state resolves.
RESOLVED_AT_END = ["stuck_dispatched", "stuck_in_progress", "appt_time_passed", "follow_up_due", "closing_missing", "closing_unfiled"]


def refusal() -> Column:
    """Why an event is no valid transition; null if it is one."""
    manual_cancel = (F.col("to_status") == "canceled") & (F.col("source") == "manual")
    return (
        F.when(~F.coalesce(F.col("to_status").isin(STATUSES), F.lit(False)), "unknown status")
        .when((F.col("to_status") == "closed") & ~F.col("source").eqNullSafe(F.lit("closing_chat")), "only closings close")
        .when(manual_cancel & blank(F.get_json_object("payload", "$.note")), "a manual cancel needs a note")
    )


def split_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events, and refused ones with the column refusal."""
    marked = events.withColumn("refusal", refusal())
    return marked.where("refusal is null").drop("refusal"), marked.where("refusal is not null")


def current_state(events: DataFrame) -> DataFrame:
    """A row a job: its status, when it came, and the last readable appointment, follow-up and reason."""
    valid, _ = split_events(events)
    order = F.struct("created_at", "id")
    at = lambda status, field: F.when(F.col("to_status") == status, parse_iso(F.get_json_object("payload", field)))
    rows = valid.select("job_id", "to_status", "created_at", order.alias("_o"), at("appt_set", "$.appt_iso").alias("_appt"), at("needs_follow_up", "$.follow_up_at").alias("_follow"), F.nullif(F.get_json_object("payload", "$.reason"), F.lit("")).alias("_reason"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_o")))
    return rows.groupBy("job_id").agg(
        F.max_by("to_status", "_o").alias("lifecycle_status"), F.max("created_at").alias("lifecycle_status_changed_at"),
        last("_appt").alias("appt_at"), last("_follow").alias("follow_up_at"), F.substring(last("_reason"), 1, 30).alias("last_tech_reason"),
        F.count(F.lit(1)).alias("n_events"),
    )


def resolve_alerts(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Open alerts of jobs that left the state they speak of get the time of the event that resolves them."""
    w = W.partitionBy("job_id").orderBy("created_at", "id")
    moves = events.withColumn("_from", F.coalesce("from_status", F.lag("to_status").over(w)))
    left = lambda status: (F.col("_from") == status) & (F.col("to_status") != status)
    kinds = F.array_compact(F.concat(
        F.array(F.when(left("pending"), "undispatched"), F.when(left("needs_follow_up"), "follow_up_due")),
        F.when(F.col("to_status").isin(TERMINAL), F.array(*map(F.lit, RESOLVED_AT_END))).otherwise(F.array().cast("array<string>")),
    ))
    ends = moves.select("job_id", F.explode(kinds).alias("kind"), F.col("created_at").alias("_at"))
    # each alert walks to the first change after it: no pairs of a job's alerts and changes
    micros = F.unix_micros
    first = nearest(alerts, ends, [("job_id", "job_id"), ("kind", "kind")], micros("detected_at"), micros("_at"), ["_at"], after=True, equal=True, prefix="_first")
    return first.withColumn("resolved_at", F.coalesce("resolved_at", "_first_at")).select(*alerts.columns)


def attribute_replies(replies: DataFrame, own_messages: DataFrame, dispatches: DataFrame, minutes: int = 240) -> DataFrame:
    """Which dispatch a technician's reply speaks of: target, ambiguous or none.

    A quoted message decides alone.  Else all dispatches written in the chat within `minutes` before the reply count.
    replies: id, chat_jid, timestamp, quoted_wa_message_id; own_messages: chat_jid, wa_message_id, timestamp;
    dispatches: event_id, job_id, chat_jid, wa_message_id.
    """
    sent = dispatches.join(own_messages.select("chat_jid", "wa_message_id", F.col("timestamp").alias("sent_at")), ["chat_jid", "wa_message_id"], "left")
    quoted = replies.where("quoted_wa_message_id is not null").join(
        dispatches.withColumnRenamed("wa_message_id", "quoted_wa_message_id"), ["chat_jid", "quoted_wa_message_id"]
    ).select("id", "event_id", "job_id")
    near = recent(replies.where("quoted_wa_message_id is null"), sent.where("sent_at is not null"), "chat_jid", "timestamp", "sent_at", minutes, ["event_id", "job_id"])
    per = quoted.groupBy("id").agg(F.countDistinct("event_id").alias("n"), F.min("event_id").alias("event_id"), F.min("job_id").alias("job_id"))
    per = per.unionByName(near.select("id", F.col("candidates").alias("n"), F.col("recent_event_id").alias("event_id"), F.col("recent_job_id").alias("job_id")))
    got = replies.join(per, "id", "left")
    one = F.col("n") == 1
    return got.select(
        "id", F.when(one, "target").when(F.col("n") > 1, "ambiguous").otherwise("none").alias("outcome"),
        F.when(one, F.col("event_id")).alias("event_id"), F.when(one, F.col("job_id")).alias("job_id"), F.coalesce("n", F.lit(0)).alias("candidates"),
    )


def decisions_in_time(messages: DataFrame, dispatch_at: str = "dispatched_at", most: int = 2) -> DataFrame:
    """Messages (of a technician, with the time of the dispatch they answer) that are among the next `most` after it."""
    w = W.partitionBy("chat_jid", dispatch_at).orderBy("timestamp", "id")
    later = messages.where(F.col("timestamp") > F.col(dispatch_at))
    return later.withColumn("nth_after_dispatch", F.row_number().over(w)).where(F.col("nth_after_dispatch") <= most)


def reject_targets(replies: DataFrame, jobs: DataFrame, chat_key: str) -> DataFrame:
    """(id, job_id): the newest pending job of the reply's chat that came before it (as-of, strictly)."""
    from tessera.operators.joins import as_of

    pending = jobs.where("lifecycle_status = 'pending'").select(F.col("id").alias("job_id"), chat_key, "first_message_at")
    got = as_of(replies, pending, chat_key, "timestamp", "first_message_at", ["job_id"], ["job_id"])
    return got.where("matched_job_id is not null").select("id", F.col("matched_job_id").alias("job_id"))


def relays(updates: DataFrame, origins: DataFrame) -> DataFrame:
    """Pending relays to companies for updates of the relayed kinds; origins: job_id, channel, chat_jid, phone, body."""
    from tessera.functions.signals import RELAYED, relay_text, update_line

    line = update_line(F.col("update_kind"), F.col("appt_display"), F.col("follow_up_display"), F.col("reason"), F.col("notes"))
    got = updates.where(F.col("update_kind").isin(RELAYED)).join(origins, "job_id", "left")
    return got.select(
        "job_id", "event_id", "update_kind", "channel", F.when(F.col("channel") == "whatsapp", F.col("chat_jid")).alias("company_chat_jid"),
        F.when(F.col("channel") == "openphone", F.col("phone")).alias("company_phone"), relay_text(F.col("body"), line).alias("message_text"),
    )


def latest_with_status(events: DataFrame, status: str) -> DataFrame:
    return latest(events.where(F.col("to_status") == status), ["job_id"], ["created_at", "id"])
