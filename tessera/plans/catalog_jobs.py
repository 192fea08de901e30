"""Queries of the catalog on what messages do to jobs, on alerts and on corrections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import classify, lifecycle, messages, monitors, outcomes, upsert
from tessera.plans import adapters as A
from tessera.plans import backfill
from tessera.plans.registry import query
from tessera.plans.store import shared_folder
from tessera.sources import files

NAME = "case o_orderpriority when '1-URGENT' then 'oak street' when '2-HIGH' then 'north main street' when '3-MEDIUM' then 'pine road' else 'elm avenue' end"
PHONE = "'312555' || lpad(cast({} % 10000 as varchar), 4, '0')"
STATUS = "case o_orderkey % 5 when 0 then 'pending' when 1 then 'pending' when 2 then 'dispatched' when 3 then 'closed' else 'completed' end"
JOBS = f"""(select o_orderkey id, o_custkey % 40 company_id, o_orderdate first_message_at, {STATUS} lifecycle_status, cast(o_custkey % 60 + 1 as varchar) number, {NAME} street,
 cast(o_custkey % 7 + 60600 as varchar) zip, case when o_orderkey % 3 > 0 then {PHONE.format("o_custkey")} end phone from orders)"""
#: What the texts of `adapters.contact_messages` name.
HAS_STREET = "o_orderkey % 5 <> 0 and (o_orderkey % 7 = 0 or o_orderkey % 11 <> 0)"
MESSAGES = f"""(select o_orderkey id, o_custkey % 30 chat, o_custkey % 40 company_id, o_orderdate + to_days(cast(o_orderkey % 20 as integer)) as at_,
 case when {HAS_STREET} then cast(o_custkey % 60 + 1 as varchar) end number, case when {HAS_STREET} then {NAME} end street,
 case when {HAS_STREET} and o_orderkey % 3 = 0 then cast(o_custkey % 7 + 60600 as varchar) end zip,
 case when o_orderkey % 5 = 0 or o_orderkey % 7 = 0 then {PHONE.format("o_custkey")} end phone from orders)"""
DISPATCHED = f"""(select m.id, m.chat, arg_max(j.id, (j.first_message_at, j.id)) job_id, any_value(coalesce(m.number, m.phone) is null) empty from {MESSAGES} m left join {JOBS} j on j.lifecycle_status = 'pending'
 and coalesce(m.number = j.number, m.number is null) and coalesce(m.street = j.street, m.street is null) and coalesce(m.zip = j.zip, m.zip is null) and coalesce(m.phone = j.phone, m.phone is null)
 and (m.number is not null or m.phone is not null) group by m.id, m.chat)"""


@query(f"select id, job_id, case when empty then 'empty' when job_id is null then 'no_match' else 'dispatched' end outcome from {DISPATCHED} d")
def dispatch_targets(spark, d):
    m = A.contact_messages(spark, d).withColumn("_c", outcomes.contact_of(F.col("body"))).select("id", "_c.*")
    return outcomes.dispatch_targets(m, A.placed_jobs(spark, d))


@query(f"""select d.id, d.job_id, case when d.job_id is null then 'dispatch_no_match' end alert_kind, case when d.job_id is not null then cast(s_suppkey as varchar) end technician from {DISPATCHED} d
 left join supplier on s_suppkey = d.chat""")
def operator_dispatches(spark, d):
    got = outcomes.dispatch_events(A.contact_messages(spark, d), A.placed_jobs(spark, d), A.technicians(spark, d))
    return got.select("id", "job_id", "alert_kind", F.get_json_object("payload", "$.technician_id").alias("technician"))


OLDEST = """left join {jobs} j on {same} j.first_message_at >= m.at_ - interval 14 day and j.first_message_at <= m.at_ and ((m.number = j.number and m.street = j.street) or m.phone = j.phone)"""


@query(f"""select m.id, case when count(j.id) = 0 then 'unmatched' when arg_min(j.lifecycle_status, (j.first_message_at, j.id)) in ('closed', 'completed') then 'dropped' else 'completed' end outcome,
 arg_min(j.id, (j.first_message_at, j.id)) job_id, 'paid $600' token from {MESSAGES} m {OLDEST.format(jobs=JOBS, same='')} group by m.id""")
def payment_signals(spark, d):
    m = A.contact_messages(spark, d).withColumn("body", F.concat(F.lit("Paid $600\nAddr: "), "body"))
    got = outcomes.payment_outcomes(m, A.placed_jobs(spark, d))
    return got.select("id", "outcome", "job_id", F.get("tokens", F.lit(0)).alias("token"))


def _closings(spark, d):
    m = A.contact_messages(spark, d).withColumn("_c", outcomes.contact_of(F.col("body"))).withColumnRenamed("timestamp", "at")
    named = F.when(F.col("id") % 8 > 0, F.col("company_id"))
    return m.select(
        "id", "at", named.alias("company_id"), "_c.street_number", "_c.street_name", "_c.phone", F.concat(F.lit("$"), F.col("id").cast("string")).alias("total"),
        *[F.lit(None).cast("string").alias(c) for c in ("parts", "tip", "payment_method", "notes")],
    )


OWN = "(m.phone = " + PHONE.format("m.company_id") + " or m.phone = " + PHONE.format("(m.company_id * 7 + 40)") + ")"
CLOSED = f"""(select m.id, m.at_, any_value(m.id % 8 = 0) nameless, arg_min(j.id, (j.first_message_at, j.id)) job_id from (select * replace (case when {OWN} then null else phone end as phone) from {MESSAGES} m) m
 left join {JOBS} j on m.id % 8 > 0 and j.company_id = m.company_id and j.first_message_at >= m.at_ - interval 14 day and j.first_message_at <= m.at_ and ((m.number = j.number and m.street = j.street) or m.phone = j.phone)
 group by m.id, m.at_)"""


@query(f"""select id, job_id, case when job_id is null then 'CLOSING_UNMATCHED' else 'CLOSED' end status,
 case when nameless then 'No company matched for closing' when job_id is null then 'No matching original job within the window' end error from {CLOSED} c""")
def closing_outcomes(spark, d):
    return outcomes.closing_outcomes(_closings(spark, d), A.placed_jobs(spark, d), A.phoned_companies(spark, d))


@query(f"""select o_orderkey id, '$' || arg_max(c.id, (c.at_, c.id)) closed_total, max(c.at_) closed_at, arg_max(c.id, (c.at_, c.id)) closed_from from orders left join {CLOSED} c on c.job_id = o_orderkey group by o_orderkey""")
def jobs_marked_closed(spark, d):
    closings, jobs = _closings(spark, d), A.placed_jobs(spark, d)
    got = outcomes.mark_closed(jobs, closings, outcomes.closing_outcomes(closings, jobs, A.phoned_companies(spark, d)))
    return got.select("id", "closed_total", F.col("closed_at").cast("timestamp_ntz").alias("closed_at"), F.col("closed_from_dispatch_job_id").alias("closed_from"))


@query(f"select m.id, m.company_id, {OWN} own from {MESSAGES} m where m.phone is not null")
def own_numbers(spark, d):
    m = A.contact_messages(spark, d).select("id", "company_id", outcomes.contact_of(F.col("body"))["phone"].alias("phone")).where("phone is not null")
    c = A.phoned_companies(spark, d).select(F.col("id").alias("company_id"), "phone_numbers")
    return m.join(c, "company_id").select("id", "company_id", outcomes.own_number(F.col("phone_numbers"), F.col("phone")).alias("own"))


TEXTS = "(select *, case event_id % 6 when 0 then 'pass' when 1 then 'sorry cant help' when 2 then 'ok' when 3 then 'got it' when 4 then 'nope' else 'see you' end body from events)"
REJECTED = """select a.event_id id, arg_max(j.event_id, (j.ts, j.event_id)) job_id, max(j.ts) since, any_value(a.user_id) user_id, any_value(a.ts) ts from {} a join events j on j.user_id = a.user_id and j.event_type = 'signup' and j.ts < a.ts
 where a.event_type = 'error' and a.event_id % 6 < 2 group by a.event_id""".format(TEXTS)


@query(f"""select id, job_id, nth from (select r.id, r.job_id, count(e.event_id) nth from ({REJECTED}) r left join events e on e.event_type = 'error' and e.user_id = r.user_id and e.ts > r.since and e.ts <= r.ts group by all) where nth <= 2""")
def operator_rejections(spark, d):
    m = A.messages_of_events(spark, d)
    replies = m.where("event_type = 'error'").drop("event_type")
    jobs = m.where("event_type = 'signup'").select("id", "chat", F.col("timestamp").alias("first_message_at"), F.lit("pending").alias("lifecycle_status"), F.lit("x").alias("source_body"))
    got = outcomes.rejections(replies, jobs, replies.select("chat", "timestamp"), "chat")
    return got.select("id", F.col("_job_id").alias("job_id"), "nth")


@query(f"""with m as (select event_id id, ts, unnest([user_id, user_id + 1]) other, unnest([0, 1]) pos from {TEXTS} t where event_type = 'error'),
 r as (select m.id, m.pos, m.other, m.ts, arg_max(j.event_id, (j.ts, j.event_id)) job_id, max(j.ts) since from m join events j on j.user_id = m.other and j.event_type = 'signup' and j.ts < m.ts where m.id % 6 < 2 group by all),
 n as (select r.id, r.pos, r.other, r.job_id, count(e.id) nth from r left join m e on e.other = r.other and e.ts > r.since and e.ts <= r.ts group by all)
 select id, arg_min(job_id, pos) job_id, cast(arg_min(other, pos) as varchar) counterparty, arg_min(nth, pos) nth from n where nth <= 2 group by id""")
def phone_rejections(spark, d):
    m = A.messages_of_events(spark, d)
    sent = m.where("event_type = 'error'").select("id", F.array(F.col("chat").cast("string"), (F.col("chat") + 1).cast("string")).alias("to_numbers"), F.col("body").alias("content"), F.col("timestamp").alias("created_at"))
    jobs = m.where("event_type = 'signup'").select("id", F.col("chat").cast("string").alias("counterparty"), F.col("timestamp").alias("first_message_at"), F.lit("pending").alias("lifecycle_status"), F.lit("x").alias("source_body"))
    return outcomes.rejections_by_recipient(sent, jobs).select(F.col("id").cast("bigint").alias("id"), "job_id", "counterparty", "nth")


NEAR = """select a.event_id id, b.user_id job_id, max(b.ts) last from events a join events b on b.event_type = 'click' and b.user_id % 12 = a.user_id % 12 and b.ts <= a.ts and b.ts >= a.ts - interval 240 minute where a.event_type = 'view' group by all"""


@query(f"""select e.event_id id, case when n = 1 then 'target' when n > 1 then 'ambiguous' else 'none' end outcome, case when n = 1 then job end job_id, coalesce(n, 0) candidates from events e
 left join (select id, count(*) n, min(job_id) job from ({NEAR}) x group by id) y on y.id = e.event_id where e.event_type = 'view'""")
def phone_reply_targets(spark, d):
    e = A.table(spark, d, "events").withColumns({"phone": F.col("user_id") % 12, "created_at": F.col("ts").cast("timestamp")})
    sent = e.where("event_type = 'click'").select(F.col("event_id"), F.col("user_id").alias("job_id"), "phone", "created_at")
    return outcomes.phone_reply_targets(e.where("event_type = 'view'").select(F.col("event_id").alias("id"), "phone", "created_at"), sent).select("id", "outcome", "job_id", "candidates")


@query(f"""with r as (select a.event_id, a.user_id, a.ts, a.event_id % 6 in (0, 4) refuses, max(b.ts) sent, arg_max(b.event_id, (b.ts, b.event_id)) job_id from {TEXTS} a join events b on b.event_type = 'click' and b.user_id = a.user_id and b.ts < a.ts
 where a.event_type = 'view' and a.event_id % 6 in (0, 2, 3, 4) group by all), n as (select r.event_id, r.job_id, r.refuses, count(e.event_id) n from r join events e on e.event_type = 'view' and e.user_id = r.user_id and e.ts > r.sent and e.ts <= r.ts group by all)
 select event_id id, job_id, case when refuses then 'pending' else 'accepted' end to_status, case when refuses then 'tech_rejected' else 'accepted' end intent from n where n <= 2""")
def technician_decisions(spark, d):
    from tessera.operators.joins import as_of

    m = A.messages_of_events(spark, d)
    views = m.where("event_type = 'view'").drop("event_type")
    sent = m.where("event_type = 'click'").select("chat", F.col("timestamp").alias("dispatched_at"), F.col("id").alias("job_id"))
    targets = as_of(views, sent, "chat", "timestamp", "dispatched_at", ["job_id", "dispatched_at"], ["job_id"]).withColumnsRenamed({"matched_job_id": "job_id", "matched_dispatched_at": "dispatched_at"})
    return outcomes.decisions(targets, views.select("chat", "timestamp"), "chat")


@query("""with own as (select event_id, user_id % 30 chat, ts from events where event_type = 'click'), near as (select a.event_id id, count(*) n, min(o.event_id) e from events a join own o on o.chat = a.user_id % 30 and o.ts <= a.ts and o.ts >= a.ts - interval 240 minute
 where a.event_type = 'view' and a.event_id % 2 = 0 group by a.event_id), quoted as (select a.event_id id, count(*) n, min(o.event_id) e from events a join own o on o.chat = a.user_id % 30 and o.event_id = a.event_id - 1 where a.event_type = 'view' and a.event_id % 2 = 1 group by a.event_id)
 select a.event_id id, case when n = 1 then 'target' when n > 1 then 'ambiguous' else 'none' end outcome, case when n = 1 then e end event_id from events a left join (select * from near union all select * from quoted) x on x.id = a.event_id where a.event_type = 'view'""")
def attributed_replies(spark, d):
    e = A.table(spark, d, "events").withColumns({"chat_jid": F.col("user_id") % 30, "timestamp": F.col("ts").cast("timestamp"), "wa_message_id": F.col("event_id")})
    own = e.where("event_type = 'click'")
    replies = e.where("event_type = 'view'").select(F.col("event_id").alias("id"), "chat_jid", "timestamp", F.when(F.col("event_id") % 2 == 1, F.col("event_id") - 1).alias("quoted_wa_message_id"))
    sent = own.select("event_id", F.col("event_id").alias("job_id"), "chat_jid", "wa_message_id")
    return lifecycle.attribute_replies(replies, own.select("chat_jid", "wa_message_id", "timestamp"), sent).select("id", "outcome", "event_id")


@query("""with c as (select e.event_id, row_number() over (partition by e.user_id, s.ts order by e.ts, e.event_id) nth from events e join (select user_id, min(ts) ts from events where event_type = 'click' group by user_id) s on s.user_id = e.user_id and e.ts > s.ts)
 select event_id id, nth from c where nth <= 2""")
def first_two_after_dispatch(spark, d):
    m = A.messages_of_events(spark, d).withColumnRenamed("chat", "chat_jid")
    first = m.where("event_type = 'click'").groupBy("chat_jid").agg(F.min("timestamp").alias("dispatched_at"))
    return lifecycle.decisions_in_time(m.join(first, "chat_jid")).select("id", F.col("nth_after_dispatch").alias("nth"))


STATE = """(select job_id, arg_max(to_status, (created_at, id)) status, max(created_at) since from (select event_id id, user_id job_id, ts created_at, case event_type when 'click' then 'dispatched' when 'view' then 'appt_set' when 'purchase' then 'completed'
 when 'signup' then 'pending' when 'error' then 'canceled' else 'in_progress' end to_status from events) e group by job_id)"""


def _states(spark, d):
    return lifecycle.current_state(A.lifecycle_events(spark, d)).select(F.col("job_id").alias("id"), "lifecycle_status", "lifecycle_status_changed_at", F.lit(None).cast("timestamp").alias("first_message_at"))


AS_OF = "2024-02-01"


@query("".join(f"{' union all ' if i else ''}select cast(job_id as varchar) job_id, '{kind}' kind, {minutes} threshold_minutes from {STATE} s where status = '{status}' and since < timestamp '{AS_OF}' - interval {minutes} minute"
       for i, (kind, status, minutes) in enumerate([("stuck_dispatched", "dispatched", 240), ("stuck_appt_set", "appt_set", 480), ("closing_unfiled", "completed", 7)])))
def monitor_stuck_states(spark, d):
    jobs, at = _states(spark, d), F.lit(AS_OF).cast("timestamp")
    got = monitors.stuck(jobs, "dispatched", 240, at).unionByName(monitors.stuck(jobs, "appt_set", 480, at)).unionByName(monitors.closing_unfiled(jobs, at))
    return got.select("job_id", "kind", "threshold_minutes")


@query(f"""select cast(user_id as varchar) job_id from (select user_id, max(ts) last, max(ts) filter (where event_type = 'signup' and ts >= timestamp '{AS_OF}' - interval 60 day) set_at from events where ts < timestamp '{AS_OF}' group by user_id)
 where set_at = last and date_trunc('second', set_at) + interval 2 hour <= timestamp '{AS_OF}'""")
def monitor_follow_up_due(spark, d):
    at = F.lit(AS_OF).cast("timestamp")
    e = A.table(spark, d, "events").where(f"ts < timestamp '{AS_OF}'")
    due = F.to_json(F.struct(F.date_format(F.col("ts").cast("timestamp") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("follow_up_at")))
    events = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "signup", "needs_follow_up").otherwise("x").alias("to_status"), due.alias("payload"), F.col("ts").cast("timestamp").alias("created_at"))
    return monitors.follow_up_due(events, at, monitors.Limits(event_days=60)).select("job_id")


@query(f"""with r as (select event_id id, user_id job_id, ts, user_id % 30 chat, event_id % 2 = 0 wa from events where event_type = 'signup' and event_id % 4 > 1), done as (select r.id from r join events m on m.event_type = 'click' and m.user_id % 30 = r.chat and m.ts > r.ts
 and m.ts <= timestamp '{AS_OF}') select cast(job_id as varchar) job_id, cast(min(id) as varchar) relay_id from r where ts < timestamp '{AS_OF}' - interval 8 minute and id not in (select id from done) group by job_id""")
def monitor_updates_unsent(spark, d):
    e = A.table(spark, d, "events").withColumns({"at": F.col("ts").cast("timestamp"), "chat": (F.col("user_id") % 30).cast("string")})
    wa = F.col("event_id") % 2 == 0
    relays = e.where("event_type = 'signup' and event_id % 4 > 1").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.when(wa, "whatsapp").otherwise("openphone").alias("channel"), F.when(wa, F.col("chat")).alias("company_chat_jid"), F.when(~wa, F.col("chat")).alias("company_phone"),
        F.lit("appt_set").alias("update_kind"), F.lit(None).cast("timestamp").alias("sent_at"), F.col("at").alias("created_at"),
    )
    clicks = e.where("event_type = 'click'")
    chat = clicks.select(F.col("chat").alias("chat_jid"), F.lit(True).alias("is_from_me"), F.col("at").alias("timestamp"))
    phone = clicks.select(F.lit("outgoing").alias("direction"), F.array("chat").alias("to_numbers"), F.col("at").alias("created_at"))
    got = monitors.company_update_unsent(relays, chat, phone, F.lit(AS_OF).cast("timestamp"))
    return got.select("job_id", F.get_json_object("payload", "$.relay_id").alias("relay_id"))


KIND = "case event_type when 'click' then 'undispatched' when 'view' then 'stuck_dispatched' when 'purchase' then 'closing_missing' when 'signup' then 'follow_up_due' when 'error' then 'dispatch_no_match' else 'closing_unfiled' end"


@query(f"""select event_id id, {KIND} kind, o.o_custkey % 40 company_id, case when (o.o_custkey % 40) % 2 = 0 then upper(c_name) else c_name end company_name from (select * from events where event_id % 3 <> 0 and event_type in ('click', 'error') order by ts desc, event_id limit 50 offset 20) e
 left join orders o on o.o_orderkey = e.user_id left join customer on c_custkey = o.o_custkey % 40""")
def alert_page(spark, d):
    got = monitors.alert_page(A.alerts(spark, d), A.placed_jobs(spark, d), A.phoned_companies(spark, d), ["undispatched", "dispatch_no_match"], skip=20, limit=50)
    return got.select("id", "kind", "company_id", "company_name")


@query("""select (select count(*) from events where event_id % 3 <> 0 and event_type in ('click', 'error') and user_id % 2 = 0) total, (select count(*) from events where event_id % 3 <> 0 and event_id % 5 <> 0 and event_type in ('click', 'error')) unseen""")
def alert_counts(spark, d):
    a = A.alerts(spark, d)
    return monitors.alert_counts(a, ["undispatched", "dispatch_no_match"], a.where("job_id % 2 = 0").select("job_id"))


@query(f"select {KIND} kind, count(*) filter (where event_id % 2 = 0) created, count(*) filter (where event_id % 3 <> 0) already_open from events group by 1 having created > 0 or already_open > 0")
def alert_scan_counts(spark, d):
    a = A.alerts(spark, d)
    return monitors.counts(a.where("id % 2 = 0"), a)


@query(f"""select event_id id, case event_type when 'click' then 'Job has been pending since ' || h || ' with no dispatch or rejection (SLA 1.5h).' when 'view' then 'Dispatched ' || h || ' but the technician hasn''t replied (SLA 1.5h).'
 when 'purchase' then 'No closing totals have arrived since ' || h || '; the job is still pending (SLA 1.5h).' when 'signup' then 'A customer callback is due and hasn''t happened yet.' when 'error' then 'An operator dispatch message couldn''t be matched to any pending job.'
 else 'The tech reported payment ' || h || ', but it hasn''t been filed in the Dispatch Closing group yet (SLA 1.5h).' end why from
 (select *, case when m < 1440 then (m // 60) || 'h ago' else (m // 1440) || 'd ago' end h from (select *, date_diff('second', date_trunc('second', ts) - interval 3 hour, timestamp '{AS_OF}') // 60 m from events where ts < timestamp '{AS_OF}')) e""")
def alert_texts(spark, d):
    a = A.alerts(spark, d).where(f"detected_at < timestamp '{AS_OF}'")
    return a.select("id", monitors.description(F.col("kind"), F.col("payload"), F.col("threshold_minutes"), F.lit(AS_OF).cast("timestamp")).alias("why"))


@query(f"select event_id id, case when event_id % 5 = 0 then ts when event_id % 3 = 0 then null else timestamp '{AS_OF}' end seen_at from events")
def alerts_marked_seen(spark, d):
    return monitors.mark_seen(A.alerts(spark, d), F.lit(AS_OF).cast("timestamp")).select("id", F.col("seen_at").cast("timestamp_ntz").alias("seen_at"))


@query(f"""select count(*) n, count(*) filter (where kind = 'whatsapp_ingestion_stalled') stalled from (select '{KIND.replace("'", "''")}' kind from events union all select 'whatsapp_ingestion_stalled' where (select max(ts) from events) < timestamp '2024-03-01' - interval 30 minute)""")
def ingestion_watchdog(spark, d):
    chats = spark.range(1).select(F.lit(True).alias("is_active"))
    chat = A.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("timestamp"))
    got = monitors.watchdog(A.alerts(spark, d).withColumn("id", F.col("id").cast("string")), chat, chats, F.lit("2024-03-01").cast("timestamp"))
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "whatsapp_ingestion_stalled").alias("stalled"))


@query(f"""select a.event_id id, min(e.ts) resolved_at from events a left join events e on e.user_id = a.user_id and e.ts >= a.ts and e.event_type = 'error' where a.event_type = 'purchase' and a.event_id % 3 <> 0 group by a.event_id""")
def alerts_resolved_by_events(spark, d):
    a = A.alerts(spark, d).where("kind = 'closing_missing' and resolved_at is null")
    return lifecycle.resolve_alerts(a, A.lifecycle_events(spark, d)).select("id", F.col("resolved_at").cast("timestamp_ntz").alias("resolved_at"))


@query("select user_id job_id, arg_max(event_id, (ts, event_id)) id from events where event_type = 'purchase' group by user_id")
def latest_event_with_status(spark, d):
    return lifecycle.latest_with_status(A.lifecycle_events(spark, d), "completed").select("job_id", "id")


@query("""select event_id, 'Update: ' || case event_type when 'view' then 'appointment set for ' || event_id || '.' else 'job canceled — customer refused the price.' end || ' Note: n' message_text, case when event_id % 2 = 0 then 'chat' || user_id end company_chat_jid
 from events where event_type in ('view', 'error')""")
def company_relays(spark, d):
    e = A.table(spark, d, "events").withColumn("wa", F.col("event_id") % 2 == 0)
    updates = e.select(
        F.col("event_id").alias("job_id"), "event_id", F.when(F.col("event_type") == "view", "appt_set").when(F.col("event_type") == "error", "canceled").otherwise("pending").alias("update_kind"), F.col("event_id").cast("string").alias("appt_display"),
        F.lit(None).cast("string").alias("follow_up_display"), F.lit("refused").alias("reason"), F.lit("n").alias("notes"),
    )
    origins = e.select(F.col("event_id").alias("job_id"), F.when(F.col("wa"), "whatsapp").otherwise("openphone").alias("channel"), F.concat(F.lit("chat"), F.col("user_id").cast("string")).alias("chat_jid"), F.lit("1").alias("phone"), F.lit(" ").alias("body"))
    return lifecycle.relays(updates, origins).select("event_id", "message_text", "company_chat_jid")


def _mirrors(spark, d):
    """Orders as closed jobs, their dispatch jobs, mirror messages and chat messages; every third chat message is some hours off."""
    o = A.table(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    key = F.col("o_orderkey")
    jobs = o.select(key.alias("id"), F.col("at").alias("first_message_at"), F.when(key % 2 == 0, F.col("at")).alias("closed_at"), key.alias("closed_from_dispatch_job_id"), F.when(key % 5 > 0, F.col("at")).alias("lifecycle_status_changed_at"))
    dispatch = o.select(key.alias("id"), key.alias("job_id"), key.alias("incoming_message_id"), F.col("at").alias("created_at"))
    raw = F.to_json(F.struct((key % 30).cast("string").alias("chat_jid"), key.cast("string").alias("wa_message_id")))
    mirror = o.select(key.alias("id"), raw.alias("raw_payload"))
    chat = o.select((key % 30).cast("string").alias("chat_jid"), key.cast("string").alias("wa_message_id"), (F.col("at") + F.make_dt_interval(hours=(key % 3).cast("int"))).alias("timestamp"))
    named = F.to_json(F.struct((key % 30).cast("string").alias("chat_jid"), key.cast("string").alias("wa_message_id"), F.lit("whatsapp").alias("channel"), key.cast("string").alias("dispatch_job_id")))
    events = o.select((key * 2 + 1).alias("id"), key.alias("job_id"), F.when(key % 2 == 0, "closing_chat").otherwise("closing_signal").alias("source"), named.alias("payload"), F.col("at").alias("created_at"))
    later = o.where("o_orderkey % 7 = 0").select((key * 2 + 2).alias("id"), key.alias("job_id"), F.lit("manual").alias("source"), F.lit("{}").alias("payload"), (F.col("at") + F.expr("interval 1 day")).alias("created_at"))
    return jobs, events.unionByName(later), dispatch, mirror, chat


OFF = "select o_orderkey k, -(o_orderkey % 3) drift from orders where o_orderkey % 3 > 0"


@query(f"""select 'jobs.first_message_at' table_column, cast(k as varchar) id, cast(drift as double) drift_hours from ({OFF}) union all select 'jobs.closed_at', cast(k as varchar), drift from ({OFF}) where k % 2 = 0
 union all select 'job_lifecycle_events.created_at', cast(2 * k + 1 as varchar), drift from ({OFF}) union all select 'jobs.lifecycle_status_changed_at', cast(k as varchar), case when k % 5 > 0 then drift end from ({OFF}) where k % 7 > 0""")
def closing_time_corrections(spark, d):
    return backfill.closing_corrections(*_mirrors(spark, d)).select("table_column", "id", "drift_hours")


@query(f"select 'jobs.first_message_at' table_column, count(*) n from ({OFF}) union all select 'jobs.closed_at', count(*) from ({OFF}) where k % 2 = 0 union all select 'job_lifecycle_events.created_at', count(*) from ({OFF}) union all select 'jobs.lifecycle_status_changed_at', count(*) from ({OFF}) where k % 7 > 0")
def correction_counts(spark, d):
    return backfill.correction_counts(backfill.closing_corrections(*_mirrors(spark, d)))


@query("select id, job_id from (select user_id id, arg_max(event_id, (ts, event_id)) job_id from events where event_type = 'view' group by user_id) where job_id % 3 > 0")
def appointment_corrections(spark, d):
    e = A.lifecycle_events(spark, d)
    last = lifecycle.latest_with_status(e, "appt_set").select("job_id", "id", F.date_trunc("second", F.col("created_at")).alias("at"))
    jobs = last.select(F.col("job_id").alias("id"), F.when(F.col("id") % 3 == 0, F.col("at") + F.expr("interval 3 hours")).alias("appt_at"))
    got = backfill.time_corrections(jobs, e, "appt_set", "appt_iso", "appt_at")
    return got.join(last.select(F.col("job_id").alias("id"), F.col("id").alias("event")), "id").select("id", F.col("event").alias("job_id"))


@query(f"""select m.id, case when m.id % 9 = 0 then 'NOT_A_JOB' when m.id % 8 = 0 then 'NO_COMPANY' when m.id % 13 = 0 then 'FAILED' when count(j.id) = 0 then 'NEW' when arg_min(j.company_id, (j.first_message_at, j.id)) <> m.company_id then 'DUPLICATE' else 'LINKED' end status
 from (select * replace (case when {OWN} then null else phone end as phone) from {MESSAGES} m) m {OLDEST.format(jobs=JOBS, same='')} group by m.id, m.company_id""")
def classified_messages(spark, d):
    m = A.contact_messages(spark, d).withColumnRenamed("timestamp", "created_at")
    company = F.when((F.col("id") % 8 > 0) & (F.col("id") % 9 > 0), F.col("company_id"))
    previews = m.select("id", (F.col("id") % 9 > 0).alias("gate_passed"), company.alias("matched_company_id"))
    read = m.where("id % 13 > 0").withColumn("_c", outcomes.contact_of(F.col("body")))
    extracted = read.select("id", F.when(F.col("_c.street_number").isNotNull(), F.substring_index("body", "\n", 1)).alias("address"), F.col("_c.phone").alias("customer_phone"))
    return outcomes.classified(m, previews, extracted, A.placed_jobs(spark, d), A.phoned_companies(spark, d)).select("id", "status")


#: Messages of one of twenty groups of customers share no street or phone with others, so groups are walked side by side, a message a step.
@query(f"""with recursive m as (
 select cast(o_orderkey as varchar) id, cast(o_orderdate as timestamp) as at_, o_custkey % 3 company, cast(o_custkey % 60 + 1 as varchar) || ' ' || {NAME} street,
 case when o_orderkey % 3 > 0 then {PHONE.format("o_custkey")} end phone, o_custkey % 20 b, row_number() over (partition by o_custkey % 20 order by o_orderdate, cast(o_orderkey as varchar)) k from orders
), walk as (
 select b, 0 k, cast([] as struct(id varchar, at_ timestamp, company bigint, street varchar, phone varchar)[]) jobs, cast(null as varchar) id, cast(null as varchar) job_id, cast(null as varchar) outcome from (select distinct b from m)
 union all
 select b, k, case when outcome = 'linked' then jobs else list_append(jobs, struct_pack(id := id, at_ := at_, company := company, street := street, phone := phone)) end, id, case when outcome = 'linked' then first.id else id end, outcome
 from (select *, case when first is null then 'new' when first.company <> company then 'duplicate' else 'linked' end outcome from (
  select *, list_filter(jobs, lambda j: j.street = street or coalesce(j.phone = phone, false))[1] as first from (
   select m.*, list_filter(w.jobs, lambda j: j.at_ >= m.at_ - interval 14 day) jobs from walk w join m on m.b = w.b and m.k = w.k + 1)))
) select id, job_id, outcome from walk where k > 0""")
def resolved_messages(spark, d):
    o = A.placed_jobs(spark, d)
    street = F.concat_ws(" ", "address_street_number", "address_street_name").alias("street")
    company = (A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).alias("company_id")))
    m = o.drop("company_id").join(company, "id").select("id", F.col("first_message_at").alias("at"), "company_id", street, F.col("customer_phone_e164").alias("phone"))
    return classify.resolve(m).select("id", "job_id", "outcome")


@query("""select o_orderkey id, s_suppkey technician_id from orders join supplier on s_suppkey % 5 > 0 and s_suppkey = (case when o_orderkey % 2 = 0 then o_custkey % 10000 else (o_custkey + 1) % 10000 end)""")
def technicians_of_messages(spark, d):
    o = A.table(spark, d, "orders")
    o = o.withColumn("_next", F.col("o_custkey") + 1)
    m = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "incoming").otherwise("outgoing").alias("direction"), A.phone_of("o_custkey").alias("from_number"), F.array(F.lit("x"), F.concat(F.lit("+1"), A.phone_of("_next"))).alias("to_numbers"))
    return messages.technician_of(m, A.technicians(spark, d))


@query(f"""select o_orderkey id, arg_min(k, (k % 4, name, k)) company_id from orders join (select c_custkey k, c_name as name, unnest([{PHONE.format('c_custkey')}, {PHONE.format('(c_custkey * 7 + 40)')}]) p from customer) c on p = {PHONE.format('o_custkey')} group by o_orderkey""")
def companies_of_numbers(spark, d):
    numbers = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("1-"), A.phone_of("o_custkey")).alias("number"))
    return messages.companies_by_phone(numbers, A.phoned_companies(spark, d), "id", "number").select("id", "company_id")


@query(f"""select {PHONE.format('o_custkey')} phone, o_custkey % 40 company_id, count(*) n_messages from orders where o_orderkey % 3 > 0 and o_custkey % 10000 not in (select c_custkey % 10000 from customer where c_mktsegment = 'BUILDING') group by 1, 2 having count(*) >= 5""")
def binding_suggestions(spark, d):
    o = A.table(spark, d, "orders")
    m = o.select(F.col("o_orderkey").alias("id"), F.lit("openphone").alias("source"), F.concat(F.lit("+1"), A.phone_of("o_custkey")).alias("from_number"))
    found = o.select(F.col("o_orderkey").alias("incoming_message_id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey") % 40).alias("company_id"))
    bound = A.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(A.phone_of("c_custkey").alias("phone_e164"))
    return messages.binding_suggestions(m, found, A.phoned_companies(spark, d), bound, 5).select("phone", "company_id", "n_messages")


@query("select o_orderkey id, o_custkey company_id from orders where o_orderstatus = 'F' and o_orderpriority not in ('5-LOW') and o_orderdate >= timestamp '1996-01-01' and o_orderkey in (select conv_id from conversations where contains(lower(text), 'th'))")
def dispatch_job_search(spark, d):
    o = A.table(spark, d, "orders")
    jobs = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("incoming_message_id"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("classification_status"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    m = A.table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("text").alias("content"))
    low = [f"{s}|5-LOW" for s in "FOP"]
    got = messages.dispatch_jobs(jobs, m, since="1996-01-01", exclude_statuses=low, search="TH")
    return got.where("classification_status like 'F|%'").select("id", "company_id")


@query("select distinct o_custkey job_id from orders where o_orderkey in (select conv_id from conversations where contains(lower(text), '% a'))  union select distinct o_custkey from orders where o_orderkey in (select conv_id from conversations where contains(lower(text), 'ed'))")
def job_ids_by_message(spark, d):
    jobs = A.table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("incoming_message_id"))
    m = A.table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("text").alias("content"))
    return messages.job_ids_by_message(jobs, m, "% a").union(messages.job_ids_by_message(jobs, m, "ED")).distinct()


@query("select o_orderkey id, case when (o_custkey % 40) % 2 = 0 then upper(c_name) else c_name end company_name, '9' tip, case o_orderkey % 5 when 0 then 'pending' when 1 then 'pending' when 2 then 'dispatched' when 3 then 'closed' else 'completed' end lifecycle_status from orders left join customer on c_custkey = o_custkey % 40")
def job_views(spark, d):
    o = A.table(spark, d, "orders")
    dispatch = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("company_id"), F.col("o_orderkey").alias("incoming_message_id"), F.col("o_orderkey").alias("job_id"), F.lit('{"tip": "9"}').alias("extraction_raw"))
    m = o.select(F.col("o_orderkey").alias("id"), F.lit("x").alias("content"), F.lit("y").alias("from_number"), F.lit("z").alias("source"))
    jobs = A.placed_jobs(spark, d).withColumns({"appt_at": F.lit(None), "follow_up_at": F.lit(None), "is_duplicate": F.lit(False)})
    return messages.job_view(dispatch, A.phoned_companies(spark, d), m, jobs).select("id", "company_name", "tip", "lifecycle_status")


@query("""select a.o_orderkey id, arg_min(b.o_orderkey, (b.o_orderdate, b.o_orderkey)) job_id from orders a join orders b on b.o_orderkey % 2 = 1 and a.o_custkey % 60 = b.o_custkey % 60 and a.o_orderpriority = b.o_orderpriority and b.o_orderdate <= a.o_orderdate and b.o_orderdate >= a.o_orderdate - interval 14 day
 where a.o_orderkey % 2 = 0 and a.o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM') group by a.o_orderkey""")
def dedup_candidates(spark, d):
    j = A.placed_jobs(spark, d).drop("customer_phone_e164").withColumn("customer_phone_e164", F.lit(None).cast("string"))
    m = j.where("id % 2 = 0 and address_street_name <> 'elm avenue'").select("id", "company_id", F.col("address_street_number").alias("street_number"), F.col("address_street_name").alias("street_name"), F.col("customer_phone_e164").alias("phone"), F.col("first_message_at").alias("at"))
    return classify.dedup_candidates(m, j.where("id % 2 = 1")).select("id", "job_id")


#: Nations as companies: a text that begins with their key as house number, three times their key as their phone.
GATE = "o_orderkey % 5 <> 0 and o_orderkey % 7 = 0"
PREVIEWS = f"""(select o_orderkey id, {GATE} gate, byphone.n_nationkey k1, bytext.n_nationkey k2, bound.n_nationkey k3, bytext.n_name name2, bound.n_name name3 from orders
 left join nation byphone on o_orderkey % 2 = 0 and o_custkey % 10000 = byphone.n_nationkey * 3 left join nation bytext on bytext.n_nationkey = o_custkey % 60 + 1
 left join supplier on o_orderkey % 2 = 0 and s_suppkey = o_custkey % 10000 left join nation bound on bound.n_nationkey = s_suppkey % 25)"""


@query(f"""select id, gate gate_passed, gate and coalesce(k1, k2, k3) is not null is_job_likely, case when gate then cast(coalesce(k1, k2, k3) as varchar) end matched_company_id,
 case when not gate then 'not_a_job' when k1 is not null then 'phone' when k2 is not null then 'regex' when k3 is not null then 'phone_binding' else 'none' end match_method,
 case when gate and k1 is null and name2 <> name3 then 'regex=' || name2 || ' binding=' || name3 end binding_conflict from {PREVIEWS} p""")
def previewed_messages(spark, d):
    sent = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, A.phone_of("o_custkey")).alias("from_number"))
    m = A.contact_messages(spark, d).join(sent, "id").select("id", F.when(F.col("id") % 2 == 0, "openphone").otherwise("whatsapp").alias("source"), "from_number", F.col("body").alias("content"))
    n = A.table(spark, d, "nation").withColumn("_three", F.col("n_nationkey") * 3)
    pattern = F.concat(F.lit("^"), F.col("n_nationkey").cast("string"), F.lit(" "))
    companies = n.select(
        F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("int").alias("priority"), F.lit(True).alias("is_active"),
        F.array(A.phone_of("_three")).alias("phone_numbers"), F.array(F.struct(F.array(pattern).alias("patterns"))).alias("identification_patterns"),
    )
    bindings = A.table(spark, d, "supplier").select(A.own_phone_of("s_suppkey").alias("phone_e164"), (F.col("s_suppkey") % 25).cast("string").alias("company_id"))
    return classify.preview(m, companies, bindings).drop("matched_company")


@query(f"""select m.id, arg_min(j.id, (j.first_message_at, j.id)) job_id from {MESSAGES} m {OLDEST.format(jobs=JOBS, same="j.company_id = m.company_id and ")} where j.id is not null group by m.id""")
def closings_rematched(spark, d):
    c = A.contact_messages(spark, d).withColumn("_c", outcomes.contact_of(F.col("body"))).select("id", "company_id", F.col("timestamp").alias("at"), "_c.street_number", "_c.street_name", "_c.phone")
    return classify.rematch_closings(c, A.placed_jobs(spark, d))


@query("""with sent as (select conv_id, arg_min(turn, (turn % 3, turn)) turn from conversations where turn % 4 > 0 group by conv_id)
 select o_orderkey id, o_orderdate as old, o_orderdate + to_days(cast(turn as integer)) as new from orders join sent on conv_id = o_orderkey where turn <> 0""")
def first_message_corrections(spark, d):
    """Conversations as the chat messages behind jobs of the same key: a turn is so many days late, the earliest dispatch decides."""
    c = A.table(spark, d, "conversations").join(A.table(spark, d, "orders").select(F.col("o_orderkey").alias("conv_id"), "o_orderdate"), "conv_id")
    name = F.concat_ws("-", "conv_id", "turn")
    stamp = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(days=F.col("turn").cast("int"))
    chat = c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("chat_jid"), name.alias("wa_message_id"), stamp.alias("timestamp"))
    raw = F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("chat_jid"), name.alias("wa_message_id")))
    m = c.select(F.concat(F.lit("m"), name).alias("id"), raw.alias("raw_payload"))
    dispatch = c.where("turn % 4 > 0").select(F.col("turn").alias("id"), F.concat(F.lit("m"), name).alias("incoming_message_id"), (F.col("turn") % 3).alias("created_at"), F.col("conv_id").alias("job_id"))
    jobs = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("first_message_at"))
    got = backfill.first_message_corrections(jobs, dispatch, m, chat)
    return got.select("id", F.col("old").cast("timestamp_ntz").alias("old"), F.col("new").cast("timestamp_ntz").alias("new"))


@query("""with sent as (select conv_id, arg_min(turn, (turn % 3, turn)) turn from conversations where turn % 4 > 0 group by conv_id)
 select o_orderkey id, o_orderdate + to_days(cast(coalesce(turn, 0) as integer)) as first_message_at from orders left join sent on conv_id = o_orderkey""")
def jobs_corrected(spark, d):
    new = first_message_corrections(spark, d).select("id", F.col("new").alias("first_message_at"))
    jobs = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("first_message_at"))
    return upsert.corrected(jobs, new, "id", ["first_message_at"])


@query("select cast(conv_id as varchar) conversation_id, turn message_id, text body, case when role = 'user' then 'incoming' else 'outgoing' end direction from conversations")
def raw_messages_exploded(spark, d):
    """Conversations written as raw files, sixteen turns a file's row, and read again."""
    c = A.table(spark, d, "conversations")
    message = F.struct(F.col("turn").cast("string").alias("id"), F.col("text"), F.when(F.col("role") == "user", "incoming").otherwise("outgoing").alias("direction"), F.lit("2026-01-02T03:04:05Z").alias("createdAt"))
    rows = c.groupBy(F.col("conv_id").cast("string").alias("conversation_id"), F.floor(F.col("turn") / 16)).agg(F.collect_list(message).alias("messages"))
    path = f"{shared_folder(spark)}/raw-{uuid.uuid4().hex}"
    rows.select("conversation_id", "messages").write.json(path)
    return files.exploded_messages(spark, path, lines=True).select("conversation_id", F.col("message_id").cast("long").alias("message_id"), "body", "direction")
