"""Offline backfills: manifests of messages, extraction tables, versions of jobs, summaries, corrections of times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import extraction as X
from tessera.functions.contact import normalize_phone
from tessera.functions.text import blank
from tessera.functions.values import drift_seconds, parse_iso, relabel_as_chicago
from tessera.operators.perkey import earliest, latest, ranked_versions, top_per_key


def split_conversations(conversations: DataFrame, interest: list[str], most: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations with a participant of interest, those too large to be read, and the rest.

    matched_interest holds the participants found, sorted.
    """
    wanted = F.array(*map(F.lit, interest)).cast("array<string>")
    hits = F.sort_array(F.array_intersect("participants", wanted))
    got = conversations.withColumn("matched_interest", hits)
    found, small = F.size("matched_interest") > 0, F.size("participants") <= most
    return got.where(found & small), got.where(found & ~small), got.where(~F.coalesce(found, F.lit(False)))


def manifest(messages: DataFrame, previews: DataFrame) -> DataFrame:
    """A row a message: where it comes from, its length and head, and what the preview says."""
    got = messages.join(previews.withColumnRenamed("id", "message_id"), "message_id")
    flag = lambda c: F.initcap(c.cast("string"))
    return got.select(
        "message_id", "conversation_id", "phone_number_id", "phone_number_e164", "from_number", F.array_join("to_numbers", ",").alias("to_numbers"), "sent_at",
        "direction", F.length(F.coalesce("content", F.lit(""))).alias("body_length"), F.substring(F.coalesce("content", F.lit("")), 1, 200).alias("body_preview"),
        flag(F.col("is_job_likely")).alias("is_job_likely"), F.coalesce("matched_company", F.lit("")).alias("matched_company"), "match_method",
        flag(F.col("gate_passed")).alias("gate_passed"), F.coalesce("binding_conflict", F.lit("")).alias("binding_conflict"),
    )


def conversation_rollup(rows: DataFrame, position: str = "message_id") -> DataFrame:
    """A row a conversation of a manifest: counts, first and last times, share of jobs, companies; sorted by last time."""
    job = F.lower(F.col("is_job_likely").cast("string")) == "true"
    sent = F.nullif("sent_at", F.lit(""))
    got = rows.groupBy("conversation_id").agg(
        F.min_by(F.struct("phone_number_id", "phone_number_e164"), position).alias("_f"), F.count(F.lit(1)).alias("message_count"),
        F.count_if(job).alias("job_count"), F.count_if(F.col("direction") == "incoming").alias("incoming_count"), F.count_if(F.col("direction") == "outgoing").alias("outgoing_count"),
        F.min(sent).alias("first_message_at"), F.max(sent).alias("last_message_at"), F.collect_set(F.nullif("matched_company", F.lit(""))).alias("_c"),
    )
    return got.select(
        "conversation_id", "_f.*", "message_count", "job_count", "incoming_count", "outgoing_count",
        F.round(100 * F.col("job_count") / F.col("message_count"), 1).alias("job_pct"), "first_message_at", "last_message_at",
        F.array_join(F.sort_array("_c"), ",").alias("companies"),
    ).orderBy(F.asc_nulls_first("last_message_at"), "conversation_id")


def to_extract(rows: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Likely jobs of a manifest that the ledger of finished ids doesn't name."""
    left = rows.where(F.lower(F.col("is_job_likely").cast("string")) == "true").join(done.select("message_id"), "message_id", "left_anti")
    return left if limit is None else left.orderBy("message_id").limit(limit)


def normalise_extractions(rows: DataFrame, body: str | None = None) -> DataFrame:
    """Extracted fields made valid, with consistency_score, dedup_group_id and the closing signals.

    job_type stays as it was extracted; job_type_valid is null where it isn't on the list.
    """
    kind = X.job_type(F.col("job_type"))
    cars = {c: X.car_field(kind, F.col(c)) for c in X.CAR}
    out = rows.withColumns({"job_type_valid": kind, **cars, "payment_method": X.payment_method(F.col("payment_method")), "customer_phone": normalize_phone(F.col("customer_phone"))})
    score = X.consistency_score(F.col("job_type_valid"), [F.col(c) for c in X.CAR], F.col("customer_phone"), F.col("total"))
    plain = blank(F.col("extraction_error")) if body is None else ~X.has_estimate_words(F.col(body))
    signals = X.closing_signals(F.col("total"), F.col("parts"), plain)
    out = out.withColumns({"consistency_score": score, "dedup_group_id": X.dedup_group_id(F.col("matched_company"), F.col("address"), F.col("customer_phone")), "_s": signals})
    return out.select(*[c for c in out.columns if c != "_s"], "_s.*")


def versions(rows: DataFrame) -> DataFrame:
    """The latest row of each dedup group is canonical, the others are superseded by it."""
    timed = rows.withColumn("_sent", F.coalesce("sent_at", F.lit("")))
    return ranked_versions(timed, "dedup_group_id", ["_sent", "message_id"], "message_id").drop("_sent")


def extraction_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg("consistency_score").alias("mean"), F.min("consistency_score").alias("least"), F.max("consistency_score").alias("most"),
        F.median("consistency_score").alias("median"), F.count_if(F.col("consistency_score") < 0.5).alias("low"),
        F.count_if(F.col("dedup_status") == "canonical").alias("canonical"), F.count_if(F.col("dedup_status") == "superseded").alias("superseded"),
        F.count_if((F.col("dedup_status") == "canonical") & F.col("closing_likely")).alias("closing_canonical"),
    )


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def largest_groups(rows: DataFrame, k: int = 5) -> DataFrame:
    return rows.groupBy("dedup_group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "dedup_group_id").limit(k)


def samples(rows: DataFrame, k: int = 3) -> DataFrame:
    return top_per_key(rows.where("matched_company <> ''"), ["matched_company"], [F.col("message_id")], k)


def relabelled(messages: DataFrame, before: Column) -> DataFrame:
    """Messages before a time with the instant they should have had, and by how many hours it differs."""
    new = relabel_as_chicago(F.col("timestamp"))
    got = messages.where(F.col("timestamp") < before).withColumn("new_timestamp", new)
    return got.select("id", "timestamp", "new_timestamp", F.round((F.unix_micros("new_timestamp") - F.unix_micros("timestamp")) / 3.6e9, 2).alias("drift_hours"))


def time_corrections(jobs: DataFrame, events: DataFrame, status: str, field: str, column: str, tolerance: int = 60) -> DataFrame:
    """(id, old, new): jobs whose stored time is missing or off by more than `tolerance` seconds from the newest event's."""
    value = F.get_json_object("payload", f"$.{field}")
    newest = latest(events.where((F.col("to_status") == status) & value.isNotNull()), ["job_id"], ["created_at", "id"])
    want = newest.select(F.col("job_id").alias("id"), parse_iso(value).alias("new")).where("new is not null")
    got = jobs.select("id", F.col(column).alias("old")).join(want, "id")
    return got.where(F.col("old").isNull() | (drift_seconds(F.col("old"), F.col("new")) > tolerance))


def first_message_corrections(jobs: DataFrame, dispatch: DataFrame, messages: DataFrame, chat_messages: DataFrame, tolerance: int = 60) -> DataFrame:
    """(id, old, new): jobs whose first time differs from that of the chat message behind their earliest dispatch job."""
    first = earliest(dispatch.where("job_id is not null").select("job_id", "incoming_message_id", "created_at", "id"), ["job_id"], ["created_at", "id"])
    m = messages.select(F.col("id").alias("incoming_message_id"), F.get_json_object("raw_payload", "$.chat_jid").alias("chat_jid"), F.get_json_object("raw_payload", "$.wa_message_id").alias("wa_message_id"))
    sent = first.join(m, "incoming_message_id").join(chat_messages.select("chat_jid", "wa_message_id", F.col("timestamp").alias("new")), ["chat_jid", "wa_message_id"])
    got = jobs.select("id", F.col("first_message_at").alias("old")).join(sent.select(F.col("job_id").alias("id"), "new"), "id")
    return got.where(drift_seconds(F.col("old"), F.col("new")) > tolerance)


def _sent_at(ids: DataFrame, messages: DataFrame, chat_messages: DataFrame) -> DataFrame:
    """ids with `new`, the time of the chat message that their incoming_message_id mirrors."""
    m = messages.select(F.col("id").alias("incoming_message_id"), F.get_json_object("raw_payload", "$.chat_jid").alias("chat_jid"), F.get_json_object("raw_payload", "$.wa_message_id").alias("wa_message_id"))
    sent = chat_messages.select("chat_jid", "wa_message_id", F.col("timestamp").alias("new"))
    return ids.join(m, "incoming_message_id").join(sent, ["chat_jid", "wa_message_id"])


def closed_at_corrections(jobs: DataFrame, dispatch: DataFrame, messages: DataFrame, chat_messages: DataFrame, tolerance: int = 60) -> DataFrame:
    """(id, old, new): closed jobs whose closing time differs from that of the chat message behind their closing."""
    own = jobs.where("closed_at is not null").select("id", F.col("closed_at").alias("old"), F.col("closed_from_dispatch_job_id").alias("dispatch_id"))
    via = own.join(dispatch.select(F.col("id").alias("dispatch_id"), "incoming_message_id"), "dispatch_id")
    got = _sent_at(via, messages, chat_messages).select("id", "old", "new")
    return got.where(drift_seconds(F.col("old"), F.col("new")) > tolerance)


def closing_event_corrections(events: DataFrame, dispatch: DataFrame, messages: DataFrame, chat_messages: DataFrame, tolerance: int = 60) -> DataFrame:
    """(id, job_id, old, new): closing events whose payload names a dispatch job, by the chat message behind that."""
    own = events.where("source = 'closing_chat'").select("id", "job_id", F.col("created_at").alias("old"), F.get_json_object("payload", "$.dispatch_job_id").alias("dispatch_id"))
    via = own.join(dispatch.select(F.col("id").cast("string").alias("dispatch_id"), "incoming_message_id"), "dispatch_id")
    got = _sent_at(via, messages, chat_messages).select("id", "job_id", "old", "new")
    return got.where(drift_seconds(F.col("old"), F.col("new")) > tolerance)


def signal_event_corrections(events: DataFrame, chat_messages: DataFrame, tolerance: int = 60) -> DataFrame:
    """(id, job_id, old, new): payment events of the chat channel, by the chat message that their payload names."""
    text = lambda k: F.get_json_object("payload", f"$.{k}").alias(k)
    own = events.where("source = 'closing_signal'").select("id", "job_id", F.col("created_at").alias("old"), text("chat_jid"), text("wa_message_id"), text("channel")).where("channel = 'whatsapp'")
    got = own.join(chat_messages.select("chat_jid", "wa_message_id", F.col("timestamp").alias("new")), ["chat_jid", "wa_message_id"]).select("id", "job_id", "old", "new")
    return got.where(drift_seconds(F.col("old"), F.col("new")) > tolerance)


def closing_corrections(jobs: DataFrame, events: DataFrame, dispatch: DataFrame, messages: DataFrame, chat_messages: DataFrame, tolerance: int = 60) -> DataFrame:
    """All corrections as rows (table_column, id, job_id, old, new, drift_hours).

    A job's time of its last change of state is corrected only where its latest event is.
    """
    first = first_message_corrections(jobs, dispatch, messages, chat_messages, tolerance)
    closed = closed_at_corrections(jobs, dispatch, messages, chat_messages, tolerance)
    moved = closing_event_corrections(events, dispatch, messages, chat_messages, tolerance).unionByName(signal_event_corrections(events, chat_messages, tolerance))
    newest = events.groupBy("job_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))
    last = moved.join(newest, ["job_id", "id"], "left_semi").select("job_id", "new")
    states = last.join(jobs.select(F.col("id").alias("job_id"), F.col("lifecycle_status_changed_at").alias("old")), "job_id")
    states = states.where(F.col("old").isNull() | (drift_seconds(F.col("old"), F.col("new")) > tolerance)).withColumn("id", F.col("job_id"))

    def named(df: DataFrame, name: str) -> DataFrame:
        job = F.col("job_id") if "job_id" in df.columns else F.col("id")
        drift = F.round((F.unix_micros("old") - F.unix_micros("new")) / 3.6e9, 2)
        return df.select(F.lit(name).alias("table_column"), F.col("id").cast("string").alias("id"), job.cast("string").alias("job_id"), "old", "new", drift.alias("drift_hours"))

    return (
        named(first, "jobs.first_message_at").unionByName(named(closed, "jobs.closed_at")).unionByName(named(moved, "job_lifecycle_events.created_at"))
        .unionByName(named(states, "jobs.lifecycle_status_changed_at"))
    )


def correction_counts(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy("table_column").agg(F.count(F.lit(1)).alias("n"))


def manifest_summary(rows: DataFrame) -> DataFrame:
    """One row: totals of a manifest."""
    job = F.lower(F.col("is_job_likely").cast("string")) == "true"
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(job).alias("likely"), F.count_if(~F.coalesce(job, F.lit(False))).alias("unlikely"),
        F.count_if(F.coalesce(F.col("matched_company"), F.lit("")) != "").alias("matched"), F.count_if(F.coalesce(F.col("binding_conflict"), F.lit("")) != "").alias("conflicts"),
        F.countDistinct("conversation_id").alias("conversations"),
    )


def numbers_by_phone(numbers: DataFrame) -> DataFrame:
    """(phone, id): workspace numbers by their normal form; of equal ones the last id counts."""
    got = numbers.where("coalesce(id, '') <> ''").select(normalize_phone(F.col("number")).alias("phone"), "id").where("phone is not null")
    return got.groupBy("phone").agg(F.max("id").alias("id"))
