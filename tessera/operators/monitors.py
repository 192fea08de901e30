"""Alert monitors: each gives candidates (kind, job_id, chat_jid, threshold_minutes, detected_at, payload) as of one time."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import ago_words, duration_words, parse_iso
from tessera.operators.perkey import page
from tessera.operators.upsert import insert_missing

WATCHDOG = "__ingestion_watchdog__"


@dataclass(frozen=True)
class Limits:
    """Minutes after which each monitor speaks."""

    undispatched: int = 5
    company_update_unsent: int = 8
    stuck_dispatched: int = 240
    stuck_in_progress: int = 480
    appt_grace: int = 60
    closing_missing: int = 1440
    closing_unfiled: int = 7
    ingestion_stalled: int = 30
    event_days: int = 7


def before(as_of: Column, minutes: int) -> Column:
    return as_of - F.make_dt_interval(mins=F.lit(minutes))


def _rows(df: DataFrame, kind: str, minutes: int, as_of: Column, payload: Column, job: str | None = "job_id", chat: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(kind).alias("kind"), (F.col(job).cast("string") if job else none).alias("job_id"), (none if chat is None else chat).alias("chat_jid"),
        F.lit(minutes).alias("threshold_minutes"), as_of.alias("detected_at"), F.to_json(payload).alias("payload"),
    )


def in_status_since(jobs: DataFrame, kind: str, status: str, since: Column, minutes: int, as_of: Column) -> DataFrame:
    got = jobs.where((F.col("lifecycle_status") == status) & (since < before(as_of, minutes)))
    return _rows(got, kind, minutes, as_of, F.struct(since.alias("since")), "id")


def undispatched(jobs: DataFrame, as_of: Column, limits: Limits = Limits()) -> DataFrame:
    return in_status_since(jobs, "undispatched", "pending", F.coalesce("lifecycle_status_changed_at", "first_message_at"), limits.undispatched, as_of)


def stuck(jobs: DataFrame, status: str, minutes: int, as_of: Column) -> DataFrame:
    return in_status_since(jobs, f"stuck_{status}", status, F.col("lifecycle_status_changed_at"), minutes, as_of)


def closing_unfiled(jobs: DataFrame, as_of: Column, limits: Limits = Limits()) -> DataFrame:
    return in_status_since(jobs, "closing_unfiled", "completed", F.col("lifecycle_status_changed_at"), limits.closing_unfiled, as_of)


def time_has_come(events: DataFrame, kind: str, status: str, field: str, minutes: int, as_of: Column, days: int = 7) -> DataFrame:
    """Jobs whose newest event of a status names a time that has passed by `minutes`, without a later event.

    The newest event per job and the newest event of the status come from one aggregation, so nothing joins.
    """
    value = F.get_json_object("payload", f"$.{field}")
    wanted = (F.col("to_status") == status) & (F.col("created_at") >= as_of - F.make_dt_interval(days=F.lit(days))) & value.isNotNull()
    order = F.struct("created_at", "id")
    got = events.groupBy("job_id").agg(
        F.max("created_at").alias("last_at"), F.max_by(F.struct("id", "created_at", value.alias("value")), F.when(wanted, order)).alias("e"), F.count_if(wanted).alias("n"),
    )
    due = parse_iso(F.col("e.value")) <= before(as_of, minutes)
    got = got.where((F.col("n") > 0) & (F.col("last_at") <= F.col("e.created_at")) & due)
    return _rows(got, kind, minutes, as_of, F.struct(F.col("e.value").alias(field), F.col("e.id").alias("event_id")))


def appt_time_passed(events: DataFrame, as_of: Column, limits: Limits = Limits()) -> DataFrame:
    return time_has_come(events, "appt_time_passed", "appt_set", "appt_iso", limits.appt_grace, as_of, limits.event_days)


def follow_up_due(events: DataFrame, as_of: Column, limits: Limits = Limits()) -> DataFrame:
    return time_has_come(events, "follow_up_due", "needs_follow_up", "follow_up_at", 0, as_of, limits.event_days)


def relayed(relays: DataFrame, chat_messages: DataFrame, messages: DataFrame, as_of: Column) -> DataFrame:
    """Unsent relays that some message to the company followed, up to as_of: (id, job_id)."""
    open_ = relays.where("sent_at is null").select("id", "job_id", "channel", "company_chat_jid", "company_phone", F.col("created_at").alias("asked_at"))
    late = lambda ts: (F.col(ts) > F.col("asked_at")) & (F.col(ts) <= as_of)
    # the last message of each chat or phone up to as_of decides, so each relay meets one row
    chats = chat_messages.where("is_from_me").where(F.col("timestamp") <= as_of).groupBy(F.col("chat_jid").alias("company_chat_jid")).agg(F.max("timestamp").alias("last_at"))
    by_chat = open_.where("channel = 'whatsapp'").join(chats, "company_chat_jid").where(late("last_at"))
    sent = messages.where("direction <> 'incoming'").where(F.col("created_at") <= as_of).select(F.explode("to_numbers").alias("company_phone"), "created_at")
    phones = sent.groupBy("company_phone").agg(F.max("created_at").alias("last_at"))
    by_phone = open_.where("channel = 'openphone'").join(phones, "company_phone").where(late("last_at"))
    return by_chat.select("id", "job_id").unionByName(by_phone.select("id", "job_id"))


def company_update_unsent(relays: DataFrame, chat_messages: DataFrame, messages: DataFrame, as_of: Column, limits: Limits = Limits()) -> DataFrame:
    done = relayed(relays, chat_messages, messages, as_of).select("id")
    late = relays.where("sent_at is null").where(F.col("created_at") < before(as_of, limits.company_update_unsent)).join(done, "id", "left_anti")
    first = late.groupBy("job_id").agg(F.min_by(F.struct("update_kind", F.col("id").alias("relay_id")), F.struct("created_at", "id")).alias("p"))
    return _rows(first, "company_update_unsent", limits.company_update_unsent, as_of, F.col("p"))


def closing_missing(jobs: DataFrame, events: DataFrame, as_of: Column, limits: Limits = Limits()) -> DataFrame:
    going = ["pending", "dispatched", "accepted", "in_progress", "appt_set", "needs_follow_up"]
    late = jobs.where(F.col("lifecycle_status").isin(going) & F.col("closed_at").isNull() & (F.col("first_message_at") < before(as_of, limits.closing_missing)))
    late = late.join(events.where("source = 'closing_chat'").select(F.col("job_id").alias("id")), "id", "left_anti")
    return _rows(late, "closing_missing", limits.closing_missing, as_of, F.struct(F.col("first_message_at").alias("since"), "lifecycle_status"), "id")


def ingestion_stalled(chat_messages: DataFrame, chats: DataFrame, as_of: Column, limits: Limits = Limits()) -> DataFrame:
    """One row if some chat is active and no message has come for too long."""
    last = chat_messages.agg(F.max("timestamp").alias("last_message_at"))
    active = chats.agg(F.coalesce(F.bool_or("is_active"), F.lit(False)).alias("any_active"))
    quiet = F.coalesce(F.col("last_message_at") < before(as_of, limits.ingestion_stalled), F.lit(True))
    # both sides are one row each
    got = last.crossJoin(active).where(F.col("any_active") & quiet)
    return _rows(got, "whatsapp_ingestion_stalled", limits.ingestion_stalled, as_of, F.struct("last_message_at"), None, F.lit(WATCHDOG))


def scan(t: dict[str, DataFrame], as_of: Column, limits: Limits = Limits()) -> DataFrame:
    """New alerts of all nine monitors: candidates without an open alert of their kind and job (or chat)."""
    found = [
        undispatched(t["jobs"], as_of, limits), stuck(t["jobs"], "dispatched", limits.stuck_dispatched, as_of),
        stuck(t["jobs"], "in_progress", limits.stuck_in_progress, as_of), appt_time_passed(t["job_lifecycle_events"], as_of, limits),
        follow_up_due(t["job_lifecycle_events"], as_of, limits),
        company_update_unsent(t["company_updates"], t["whatsapp_messages"], t["incoming_messages"], as_of, limits),
        closing_unfiled(t["jobs"], as_of, limits), closing_missing(t["jobs"], t["job_lifecycle_events"], as_of, limits),
        ingestion_stalled(t["whatsapp_messages"], t["whatsapp_tracked_chats"], as_of, limits),
    ]
    new = reduce(DataFrame.unionByName, found)
    open_ = t["alerts"].where("resolved_at is null")
    return insert_missing(new, open_, ["kind", "job_id", "chat_jid"], [F.col("detected_at"), F.col("payload")])


def counts(new: DataFrame, alerts: DataFrame) -> DataFrame:
    """created and already_open (all open alerts of the kind) per kind."""
    made = new.groupBy("kind").agg(F.count(F.lit(1)).alias("created"))
    open_ = alerts.where("resolved_at is null").groupBy("kind").agg(F.count(F.lit(1)).alias("already_open"))
    return made.join(open_, "kind", "full_outer").select("kind", F.coalesce("created", F.lit(0)).alias("created"), F.coalesce("already_open", F.lit(0)).alias("already_open"))


def watchdog(alerts: DataFrame, chat_messages: DataFrame, chats: DataFrame, as_of: Column, limits: Limits = Limits()) -> DataFrame:
    """The alerts after a look at ingestion: a stall opens an alert (once), a fresh message resolves it; without an active chat nothing changes."""
    stalled = ingestion_stalled(chat_messages, chats, as_of, limits)
    state = chat_messages.agg(F.max("timestamp").alias("_last")).crossJoin(chats.agg(F.coalesce(F.bool_or("is_active"), F.lit(False)).alias("_any")))
    fresh = F.col("_any") & F.coalesce(F.col("_last") >= before(as_of, limits.ingestion_stalled), F.lit(False))
    mine = (F.col("kind") == "whatsapp_ingestion_stalled") & (F.col("chat_jid") == WATCHDOG) & F.col("resolved_at").isNull()
    kept = alerts.crossJoin(F.broadcast(state.select(fresh.alias("_fresh")))).withColumn("resolved_at", F.when(mine & F.col("_fresh"), as_of).otherwise(F.col("resolved_at"))).select(*alerts.columns)
    new = insert_missing(stalled, kept.where("resolved_at is null"), ["kind", "job_id", "chat_jid"], [F.col("detected_at")])
    named = new.withColumn("id", F.sha2(F.concat_ws("|", "kind", "chat_jid", F.col("detected_at").cast("string")), 256))
    return kept.unionByName(named.select(*[F.col(c) if c in named.columns else F.lit(None).cast(k).alias(c) for c, k in alerts.dtypes]))


def open_alerts(alerts: DataFrame, kinds: list[str] | None = None, job_ids: DataFrame | None = None, resolved: bool = False, unseen: bool = False) -> DataFrame:
    """Alerts of some kinds and jobs: the open queue (or what of it nobody has seen), or with `resolved` all of them."""
    out = alerts if resolved else alerts.where("resolved_at is null")
    out = out.where("seen_at is null") if unseen else out
    out = out.where(F.col("kind").isin(list(kinds))) if kinds is not None else out
    return out if job_ids is None else out.join(job_ids.select("job_id").distinct(), "job_id", "left_semi")


def alert_counts(alerts: DataFrame, kinds: list[str] | None = None, job_ids: DataFrame | None = None) -> DataFrame:
    """One row: total of the open queue and unseen alerts of the kinds (whatever their jobs)."""
    total = open_alerts(alerts, kinds, job_ids).agg(F.count(F.lit(1)).alias("total"))
    unseen = open_alerts(alerts, kinds, unseen=True).agg(F.count(F.lit(1)).alias("unseen"))
    return total.crossJoin(unseen)  # a row each


def alert_page(
    alerts: DataFrame, jobs: DataFrame, companies: DataFrame, kinds: list[str] | None = None, job_ids: DataFrame | None = None, resolved: bool = False, skip: int = 0, limit: int = 200,
) -> DataFrame:
    """A page of alerts, the newest first, with the company of their job; only the page meets jobs and companies."""
    top = page(open_alerts(alerts, kinds, job_ids, resolved), [F.desc("detected_at"), F.col("id")], skip, limit)
    j = jobs.select(F.col("id").alias("job_id"), "company_id", "lifecycle_status")
    c = companies.select(F.col("id").alias("company_id"), F.coalesce("display_name", "name").alias("company_name"))
    return top.join(j, "job_id", "left").join(c, "company_id", "left").orderBy(F.desc("detected_at"), "id")


def description(kind: Column, payload: Column, minutes: Column, as_of: Column) -> Column:
    """One sentence on why an alert was raised.  Times are written as they stand in the payload."""
    given = lambda k: F.nullif(F.get_json_object(payload, f"$.{k}"), F.lit(""))
    sla = F.when(minutes > 0, F.concat(F.lit(" (SLA "), duration_words(minutes), F.lit(")"))).otherwise("")
    since = F.coalesce(ago_words(parse_iso(given("since")), as_of), F.lit("never"))
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    either = lambda value, yes, no: F.when(value.isNotNull(), yes).otherwise(no)
    #: Wording of the sentences.
    texts = {
        "undispatched": say("Job has been pending since ", since, " with no dispatch or rejection", sla, "."),
        "stuck_dispatched": say("Dispatched ", since, " but the technician hasn't replied", sla, "."),
        "stuck_in_progress": say("In progress since ", since, " with no further update", sla, "."),
        "appt_time_passed": say("The scheduled appointment", either(given("appt_iso"), say(" (", given("appt_iso"), ")"), F.lit("")), " has passed and the job hasn't moved."),
        "follow_up_due": either(given("follow_up_at"), say("A customer callback was due at ", given("follow_up_at"), " and hasn't happened yet."), F.lit("A customer callback is due and hasn't happened yet.")),
        "company_update_unsent": say("A tech update", either(given("update_kind"), say(" (", given("update_kind"), ")"), F.lit("")), " still hasn't been relayed to the source company", sla, "."),
        "closing_missing": say("No closing totals have arrived since ", since, either(given("lifecycle_status"), say("; the job is still ", given("lifecycle_status")), F.lit("")), sla, "."),
        "closing_unfiled": say("The tech reported payment ", since, ", but it hasn't been filed in the Dispatch Closing group yet", sla, "."),
        "dispatch_no_match": F.lit("An operator dispatch message couldn't be matched to any pending job."),
        "unattributed_reply": F.lit("A technician reply matched more than one job, so it couldn't be attributed automatically."),
        "tech_reply_no_target": say("A technician reply ", either(given("body_preview"), say('("', given("body_preview"), '") '), F.lit("")), "couldn't be matched to any dispatched job — it may need to be relayed to the company manually."),
        "whatsapp_ingestion_stalled": either(
            given("last_message_at"), say("No WhatsApp messages have come in since ", given("last_message_at"), " — the scraper extension is likely disconnected."),
            F.lit("No WhatsApp messages have ever been recorded — the scraper extension may not be connected."),
        ),
    }
    out = F.lit("Pipeline-health issue detected.")
    for k, text in texts.items():
        out = F.when(kind == k, text).otherwise(out)
    return out


def mark_seen(alerts: DataFrame, as_of: Column) -> DataFrame:
    return alerts.withColumn("seen_at", F.when(F.col("resolved_at").isNull(), F.coalesce("seen_at", as_of)).otherwise(F.col("seen_at")))


def log_fields(created: Column, already_open: Column) -> Column:
    """Two maps of counts by kind as one map, with their names before the kinds."""
    named = lambda m, prefix: F.transform_keys(m, lambda k, _: F.concat(F.lit(prefix), k))
    return F.map_concat(named(created, "created_"), named(already_open, "open_"))


def total_created(created: Column) -> Column:
    return F.aggregate(F.map_values(created), F.lit(0).cast("long"), lambda a, x: a + x)
