"""What messages do to jobs: dispatches, closings, payment signals, rejections and answers, each as one set-based plan.

Every function gives a row a message (or a reply) with its outcome, and where that is an event of a job's life the
columns of the event.  Jobs are those known before the batch; `classify.resolve` covers messages that open jobs
for one another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.contact import PHONE, given, normalize_phone, normalize_street, phone_match_key
from tessera.functions.signals import address_line, is_reject_signal, is_tech_accept, is_tech_reject, payment_tokens
from tessera.functions.text import blank, once
from tessera.operators.joins import count_between, nearest, oldest_since, recent

DAY = 24 * 3600 * 1_000_000
#: States that a payment no longer completes.
NOT_COMPLETABLE = ["completed", "closed", "canceled", "rejected"]
PLACE = ("street_number", "street_name", "zip", "phone")


def contact_of(body: Column, whole: bool = True) -> Column:
    """street_number, street_name, zip and phone (null where missing) that a message names.

    Unless `whole`, the address is read from the line behind 'Addr:' where there is one.
    """
    found = lambda text, a: F.struct(*[given(a[c]).alias(c) for c in ("street_number", "street_name", "zip")], normalize_phone(F.regexp_extract(text, PHONE, 0)).alias("phone"))
    read = lambda text: normalize_street(text if whole else F.coalesce(address_line(text), text))
    return once(F.coalesce(body, F.lit("")), lambda text: once(read(text), lambda a: found(text, a)))


def _masks(columns: Sequence[Column]) -> Column:
    """Keys of all non-empty choices of the columns; null where a chosen column is null."""
    keys = []
    for mask in range(1, 1 << len(columns)):
        chosen = [c.cast("string") for i, c in enumerate(columns) if mask >> i & 1]
        none = [c.isNull() for c in chosen]
        missing = none[0]
        for n in none[1:]:
            missing = missing | n
        keys.append(F.when(~missing, F.concat_ws("\x1f", F.lit(str(mask)), *chosen)))
    return F.array_compact(F.array(*keys))


def dispatch_targets(messages: DataFrame, jobs: DataFrame, id_column: str = "id", columns: Sequence[str] = PLACE) -> DataFrame:
    """(id, job_id, outcome): the newest pending job that agrees with a message in every column that it gives.

    Pending jobs are reduced to the newest one of each choice of columns, so a message looks up one row and no pairs
    are built.  outcome is dispatched, no_match, or empty for messages that give nothing.
    """
    j = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("address_street_number", "address_street_name", "address_zip", "customer_phone_e164")]
    pending = jobs.where("lifecycle_status = 'pending'").select(F.explode(_masks(j)).alias("key"), "id", "first_message_at")
    newest = pending.groupBy("key").agg(F.max_by("id", F.struct("first_message_at", "id")).alias("job_id"))
    m = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns]
    mask = sum((F.when(c.isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(m)), F.lit(0))
    key = F.when(mask > 0, F.concat_ws("\x1f", mask.cast("string"), *m))
    asked = messages.select(id_column, key.alias("key"))
    got = asked.join(newest, "key", "left")
    return got.select(id_column, "job_id", F.when(F.col("key").isNull(), "empty").when(F.col("job_id").isNull(), "no_match").otherwise("dispatched").alias("outcome"))


def dispatch_events(messages: DataFrame, jobs: DataFrame, technicians: DataFrame) -> DataFrame:
    """Operators' messages in technicians' chats: to_status, payload and the alert kind of those without a job.

    messages: id, chat_jid, wa_message_id, body, timestamp.
    """
    read = messages.where(~blank(F.col("body"))).withColumn("_c", contact_of(F.col("body"))).select("*", "_c.*")
    found = dispatch_targets(read, jobs)
    tech = technicians.groupBy(F.col("whatsapp_chat_jid").alias("chat_jid")).agg(F.min("id").alias("technician_id"))
    got = read.join(found, "id").join(tech, "chat_jid", "left")
    hit = F.col("job_id").isNotNull()
    sent = F.struct("chat_jid", "wa_message_id", "technician_id")
    missed = F.struct("wa_message_id", F.substring("body", 1, 120).alias("body_preview"), "street_number", "street_name", F.col("zip").alias("zip_code"), F.col("phone").alias("phone_e164"))
    return got.select(
        "id", "job_id", F.when(hit, "dispatched").alias("to_status"), F.when(~hit, "dispatch_no_match").alias("alert_kind"),
        F.when(hit, F.to_json(sent)).otherwise(F.to_json(missed)).alias("payload"), F.when(hit, F.col("timestamp")).alias("created_at"),
    )


def own_number(company_phones: Column, phone: Column) -> Column:
    """Whether a customer's phone is one of its company's own numbers, by the last ten digits."""
    last = lambda p: F.right(F.regexp_replace(p, "[^0-9]", ""), F.lit(10))
    return F.coalesce(~blank(phone) & F.exists(company_phones, lambda p: last(p) == F.right(phone, F.lit(10))), F.lit(False))


def without_own_numbers(rows: DataFrame, companies: DataFrame, company: str = "company_id", phone: str = "phone") -> DataFrame:
    """Rows whose phone is null where it is a number of the row's company."""
    own = companies.select(F.col("id").alias(company), F.explode("phone_numbers").alias("_p")).select(company, phone_match_key(F.col("_p")).alias("_key")).where("_key is not null").distinct()
    got = rows.withColumn("_key", F.right(F.col(phone), F.lit(10))).join(own.withColumn("_own", F.lit(True)), [company, "_key"], "left")
    return got.withColumn(phone, F.when(F.col("_own").isNull(), F.col(phone))).select(*rows.columns)


def _places(same_company: bool) -> list[list[tuple[str, str]]]:
    keys = [[("street_number", "address_street_number"), ("street_name", "address_street_name")], [("phone", "customer_phone_e164")]]
    return [[*k, ("company_id", "company_id")] for k in keys] if same_company else keys


def closing_outcomes(closings: DataFrame, jobs: DataFrame, companies: DataFrame, days: int = 14) -> DataFrame:
    """(id, job_id, status, error): the oldest job of the closing's company within `days` with its address or its phone.

    closings: id, at, company_id, street_number, street_name, phone.  A company's own number is no customer's phone.
    """
    asked = without_own_numbers(closings, companies)
    at = F.unix_micros("at")
    found = oldest_since(asked.where("company_id is not null"), jobs, "id", _places(True), at - days * DAY, at, F.unix_micros("first_message_at"), ["id"], ["id"])
    got = closings.select("id", "company_id").join(found.select("id", F.col("match.id").alias("job_id")), "id", "left")
    error = F.when(F.col("company_id").isNull(), "No company matched for closing").when(F.col("job_id").isNull(), "No matching original job within the window")
    return got.select("id", "job_id", F.when(error.isNull(), "CLOSED").otherwise("CLOSING_UNMATCHED").alias("status"), error.alias("error"))


def mark_closed(jobs: DataFrame, closings: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Jobs with the closing columns of their last closing (closing again overwrites); closings: id, at, total, parts, tip, payment_method, notes."""
    fields = {"closed_total": "total", "closed_parts": "parts", "closed_tip": "tip", "closed_payment_method": "payment_method", "closed_notes": "notes", "closed_at": "at", "closed_from_dispatch_job_id": "id"}
    row = F.struct(*[F.col(b).alias(a) for a, b in fields.items()])
    last = closings.join(outcomes.where("status = 'CLOSED'").select("id", "job_id"), "id").groupBy("job_id").agg(F.max_by(row, F.struct("at", "id")).alias("_last"))
    got = jobs.join(last.withColumnRenamed("job_id", "id"), "id", "left")
    kinds = dict(jobs.dtypes)
    return got.withColumns({c: F.when(F.col("_last").isNotNull(), F.col(f"_last.{c}").cast(kinds[c])).otherwise(F.col(c)) for c in fields}).select(*jobs.columns)


def payment_outcomes(messages: DataFrame, jobs: DataFrame, days: int = 14, body: str = "body", at: str = "timestamp") -> DataFrame:
    """(id, outcome, job_id, tokens) of messages with settlements: completed, dropped, or unmatched.

    The oldest job of the last `days` with the address or the phone of the message is completed, unless it is in an end
    state already; then the message is dropped.  Messages without a settlement are left out.
    """
    paid = messages.withColumn("tokens", payment_tokens(F.col(body))).where("tokens is not null")
    read = paid.withColumn("_c", contact_of(F.col(body), whole=False)).select("id", "tokens", F.unix_micros(at).alias("_at"), "_c.*")
    return payment_targets(read, jobs, days)


def payment_targets(read: DataFrame, jobs: DataFrame, days: int = 14) -> DataFrame:
    """The same for messages that are read already: id, tokens, _at (micros), street_number, street_name, phone."""
    found = oldest_since(read, jobs, "id", _places(False), F.col("_at") - days * DAY, F.col("_at"), F.unix_micros("first_message_at"), ["id", "lifecycle_status"], ["id"])
    got = read.select("id", "tokens").join(found, "id", "left")
    outcome = F.when(F.col("match").isNull(), "unmatched").when(F.coalesce(F.col("match.lifecycle_status").isin(NOT_COMPLETABLE), F.lit(False)), "dropped").otherwise("completed")
    return got.select("id", outcome.alias("outcome"), F.col("match.id").alias("job_id"), "tokens")


def rejections(replies: DataFrame, jobs: DataFrame, own_messages: DataFrame, key: str, most: int = 2, body: str = "body", at: str = "timestamp") -> DataFrame:
    """(id, job_id, nth): replies that decline the newest pending job before them, as one of the next `most` own messages.

    replies and jobs have `key` (a chat or a number), jobs also source_body; own_messages: key, at.  nth is the number of
    own messages since the job came, the reply included.
    """
    pending = jobs.where("lifecycle_status = 'pending'").select(F.col("id").alias("job_id"), key, "first_message_at", "source_body")
    asked = replies.where(~blank(F.col(body)))
    got = nearest(asked, pending, [(key, key)], F.unix_micros(at), F.unix_micros("first_message_at"), ["job_id", "source_body", "first_message_at"], ["job_id"], prefix="_")
    got = got.where("_job_id is not null").where(is_reject_signal(F.col(body), F.col("_source_body")))
    counted = count_between(got, own_messages.select(key, F.col(at).alias("_sent")), key, "_first_message_at", at, "_sent", "nth")
    return counted.where(F.col("nth") <= most)


def rejections_by_recipient(messages: DataFrame, jobs: DataFrame, most: int = 2) -> DataFrame:
    """(id, job_id, counterparty, nth) for phone messages: the first recipient for whom the message is a rejection.

    messages: id, to_numbers, content, created_at, all of them outgoing; jobs: counterparty, source_body.
    """
    each = messages.select("id", F.posexplode("to_numbers").alias("pos", "counterparty"), "content", "created_at").where("counterparty is not null")
    asked = each.withColumn("_mid", F.col("id")).withColumn("id", F.concat_ws("\x1f", "_mid", "pos"))
    found = rejections(asked, jobs, each.select("counterparty", "created_at"), "counterparty", most, "content", "created_at")
    first = found.groupBy("_mid").agg(F.min_by(F.struct(F.col("_job_id").alias("job_id"), "counterparty", "nth"), "pos").alias("r"))
    return first.select(F.col("_mid").alias("id"), "r.*")


def phone_reply_targets(replies: DataFrame, dispatches: DataFrame, minutes: int = 240) -> DataFrame:
    """(id, outcome, event_id, job_id, candidates): the dispatch that a technician's phone reply speaks of.

    All jobs dispatched to the number within `minutes` before the reply count, each with its newest event: one job is
    the target, several are ambiguous.  replies: id, phone, created_at; dispatches: event_id, job_id, phone, created_at.
    """
    near = recent(replies, dispatches.select("event_id", "job_id", "phone", F.col("created_at").alias("_sent")), "phone", "created_at", "_sent", minutes, ["event_id", "job_id"], of="job_id")
    per = near.select("id", "candidates", F.col("recent_event_id").alias("event_id"), F.col("recent_job_id").alias("job_id"))
    one = F.col("candidates") == 1
    return replies.select("id").join(per, "id", "left").select(
        "id", F.when(one, "target").when(F.col("candidates") > 1, "ambiguous").otherwise("none").alias("outcome"),
        F.when(one, F.col("event_id")).alias("event_id"), F.when(one, F.col("job_id")).alias("job_id"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"),
    )


def decisions(replies: DataFrame, inbound: DataFrame, key: str, most: int = 2, body: str = "body", at: str = "timestamp") -> DataFrame:
    """(id, job_id, to_status, intent): plain acceptances and refusals among the first `most` messages after a dispatch.

    replies: id, key, body, at, job_id, dispatched_at (of their target); inbound: key, at of all messages of the other side.
    """
    no, yes = is_tech_reject(F.col(body)), is_tech_accept(F.col(body))
    plain = replies.where("job_id is not null").where(no | yes)
    counted = count_between(plain, inbound.select(key, F.col(at).alias("_sent")), key, "dispatched_at", at, "_sent", "_nth").where(F.col("_nth") <= most)
    return counted.select("id", "job_id", F.when(no, "pending").otherwise("accepted").alias("to_status"), F.when(no, "tech_rejected").otherwise("accepted").alias("intent"))


def classified(messages: DataFrame, previews: DataFrame, extracted: DataFrame, jobs: DataFrame, companies: DataFrame, days: int = 14) -> DataFrame:
    """(id, company_id, status, job_id, fields): messages with a company go through extraction and dedup against known jobs.

    previews come from `classify.preview`, extracted holds id, address and customer_phone (a null id: it failed).  The
    status is NOT_A_JOB, NO_COMPANY, FAILED, LINKED to the oldest job with the address or the phone, DUPLICATE if that
    is another company's, or NEW.
    """
    fields = extracted.withColumn("_a", normalize_street(F.coalesce("address", F.lit(""))))
    fields = fields.select("id", given(F.col("_a.street_number")).alias("street_number"), given(F.col("_a.street_name")).alias("street_name"), normalize_phone(F.col("customer_phone")).alias("phone"), F.lit(True).alias("_ok"))
    got = previews.select("id", "gate_passed", F.col("matched_company_id").alias("company_id")).join(messages.select("id", F.col("created_at").alias("at")), "id").join(fields, "id", "left")
    asked = without_own_numbers(got, companies)
    at = F.unix_micros("at")
    found = oldest_since(asked.where("company_id is not null and _ok"), jobs, "id", _places(False), at - days * DAY, at, F.unix_micros("first_message_at"), ["id", "company_id"], ["id"])
    out = asked.join(found, "id", "left")
    other = F.col("match.company_id") != F.col("company_id")
    status = (
        F.when(~F.col("gate_passed"), "NOT_A_JOB").when(F.col("company_id").isNull(), "NO_COMPANY").when(F.col("_ok").isNull(), "FAILED")
        .when(F.col("match").isNull(), "NEW").when(F.coalesce(other, F.lit(False)), "DUPLICATE").otherwise("LINKED")
    )
    return out.select("id", "company_id", status.alias("status"), F.when(status == "LINKED", F.col("match.id")).when(status == "DUPLICATE", F.col("match.id")).alias("job_id"), "street_number", "street_name", "phone")
