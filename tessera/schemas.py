"""Tables of the message and job domain, as Spark DDL.  Instants are timestamps in UTC; JSON payloads are strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES = {
    "incoming_messages": "id string, source string, openphone_id string, direction string, from_number string, to_numbers array<string>, content string, status string, event_type string, phone_number_id string, raw_payload string, lifecycle_event_id string, created_at timestamp",
    "whatsapp_messages": "id string, wa_message_id string, chat_jid string, sender_jid string, sender_name string, is_from_me boolean, body string, timestamp timestamp, edited_at timestamp, is_deleted boolean, quoted_wa_message_id string, media_type string, media_mime string, media_filename string, media_size_bytes bigint, media_caption string, media_url string, reactions array<struct<emoji:string,sender:string>>, is_system_message boolean, system_event_type string, raw_payload string",
    "whatsapp_tracked_chats": "id string, chat_jid string, display_name string, is_group boolean, is_active boolean, chat_role string, last_scraped_at timestamp, last_seen_message_id string",
    "companies": "id string, name string, display_name string, pattern_type string, identification_patterns array<struct<patterns:array<string>>>, phone_numbers array<string>, is_active boolean, priority int",
    "company_phone_bindings": "id string, phone_e164 string, company_id string, note string, created_at timestamp",
    "technicians": "id string, name string, phone_e164 string, whatsapp_chat_jid string, is_active boolean, notes string",
    "dispatch_jobs": "id string, incoming_message_id string, company_id string, job_id string, classification_status string, classification_method string, classification_error string, address string, job_type string, total string, parts string, payment_method string, tech_name string, car_make string, car_model string, car_year string, customer_name string, customer_phone string, scheduled_at string, job_description string, extraction_raw string, created_at timestamp",
    "jobs": "id string, company_id string, first_message_at timestamp, address_street_number string, address_street_name string, address_city string, address_state string, address_zip string, customer_phone_e164 string, job_type string, is_duplicate boolean, duplicate_of string, closed_total string, closed_parts string, closed_tip string, closed_payment_method string, closed_notes string, closed_at timestamp, closed_from_dispatch_job_id string, lifecycle_status string, lifecycle_status_changed_at timestamp, appt_at timestamp, follow_up_at timestamp, last_tech_reason string, original_inbound_from_number string, original_inbound_channel string",
    "job_lifecycle_events": "id string, job_id string, source string, from_status string, to_status string, payload string, created_by_user_id string, created_at timestamp",
    "alerts": "id string, job_id string, chat_jid string, kind string, threshold_minutes int, detected_at timestamp, resolved_at timestamp, seen_at timestamp, resolved_by_user_id string, payload string",
    "company_updates": "id string, job_id string, lifecycle_event_id string, company_id string, update_kind string, channel string, company_chat_jid string, company_phone string, message_text string, sent_at timestamp, created_at timestamp",
    "openphone_thread_labels": "id string, counterparty string, company_id string, label string",
    "daily_stats_snapshots": "snapshot_date date, scope string, scope_id string, payload string",
}

#: What extractors give: fields of jobs, closings, companies and technicians' intents.
EXTRACTIONS = {
    "job": "address string, job_type string, total string, parts string, payment_method string, tech_name string, car_make string, car_model string, car_year string, customer_name string, customer_phone string, scheduled_at string, job_description string",
    "closing": "address string, customer_phone string, total string, parts string, tip string, payment_method string, notes string",
    "company": "company_name string, confidence double, reasoning string",
    "intent": "intent string, appt_iso string, follow_up_at string, reason string, notes string",
}
STATUSES = ["pending", "dispatched", "accepted", "in_progress", "appt_set", "needs_follow_up", "canceled", "completed", "closed", "rejected"]
TERMINAL = ["closed", "canceled", "rejected"]


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the columns of a table, in order: others are dropped, missing ones are null, types are cast."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(TABLES[table]).fields
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def record_id(*columns):
    """A key that is the same at every run: a hash of the columns that identify the row."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)
