"""Named queries over the driver's tables, each with the SQL that gives the same rows.

All run over whole tables; limits are those that the operators have as a feature (pages, top-k, drill-downs).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import contact, extraction, signals, text, values
from tessera.operators import joins, lifecycle, messages, monitors, perkey, rows, upsert
from tessera.operators.search import TextIndex
from tessera.plans import adapters as A
from tessera.plans import backfill, reports, rollups
from tessera.plans.registry import QUERIES, SQL, query
from tessera.plans.store import shared_folder
from tessera.streaming.report import ReportStore
from tessera.streaming.store import RunStore

DAY = "cast(timezone('America/Chicago', timezone('UTC', {})) - interval 5 hour as date)"
START = "timezone('UTC', timezone('America/Chicago', timestamp '{} 05:00:00'))"
JOBS = """(select o_orderkey id, o_custkey company_id, o_orderdate first_message_at,
 case when o_orderstatus = 'F' then case when o_orderkey % 7 = 0 then 'canceled' else 'closed' end
      when o_orderstatus = 'P' then 'appt_set' else case when o_orderkey % 11 = 0 then 'rejected' else 'pending' end end lifecycle_status,
 case when o_orderstatus = 'P' then o_orderdate + to_days(cast(o_orderkey % 4 as integer)) + interval 12 hour end appt_at,
 case when o_orderstatus = 'F' then o_orderdate + to_days(cast(o_orderkey % 3 as integer)) + interval 20 hour end closed_at, o_totalprice from orders)"""
BUCKETED = f"""(select *, case when lifecycle_status = 'rejected' then 'rejected' when lifecycle_status = 'closed' then 'closed_completed'
 when lifecycle_status = 'appt_set' and {DAY.format("appt_at")} <> {DAY.format("first_message_at")} then 'scheduled_another_day'
 when lifecycle_status = 'canceled' then 'canceled' else 'still_open' end bucket from {JOBS} j)"""
EVENTS = """(select event_id id, user_id job_id, ts created_at, value,
 case event_type when 'click' then 'operator_whatsapp' when 'purchase' then 'closing_chat' else 'tech_whatsapp' end source,
 case event_type when 'click' then 'dispatched' when 'view' then 'appt_set' when 'purchase' then 'completed' when 'signup' then 'pending'
  when 'error' then 'canceled' else 'in_progress' end to_status, user_id % 20 technician_id, user_id % 30 chat_jid from events)"""
FIRST, LAST = "1995-01-01", "1996-12-31"
ARRIVED = f"first_message_at >= {START.format(FIRST)} and first_message_at < {START.format('1997-01-01')}"
APPOINTED = f"appt_at >= {START.format(FIRST)} and appt_at < {START.format('1997-01-01')} and {DAY.format('appt_at')} <> {DAY.format('first_message_at')}"
COUNTS = ", ".join(f"count(*) filter (where bucket = '{b}') {b}" for b in reports.BUCKETS) + ", count(*) total"


def _report(where: str) -> str:
    return f"select company_id, c_name company_name, {COUNTS} from {BUCKETED} b join customer on c_custkey = company_id where {where} group by company_id, c_name"


@query(_report(ARRIVED))
def company_status_breakdown(spark, d):
    return reports.status_report(A.jobs(spark, d), A.companies(spark, d), *values.business_range(FIRST, LAST))


@query(_report(f"({ARRIVED}) or ({APPOINTED})"))
def company_status_with_appointments(spark, d):
    return reports.status_report(A.jobs(spark, d), A.companies(spark, d), *values.business_range(FIRST, LAST), appointments=True)


@query(_report(f"({ARRIVED}) or ({APPOINTED})").replace("select company_id,", "select cast(company_id as varchar) company_id,"))
def report_of_changes(spark, d):
    """Half of the jobs come as they are; the others come as pending ones without an appointment and change later."""
    jobs = A.jobs(spark, d).withColumn("changed_at", F.col("first_message_at"))
    first = jobs.where("id % 2 = 1").withColumns({"lifecycle_status": F.lit("pending"), "appt_at": F.lit(None).cast("timestamp")})
    later = jobs.where("id % 2 = 1").withColumn("changed_at", F.col("first_message_at") + F.expr("interval 1 day"))
    store = ReportStore(spark, f"{shared_folder(spark)}/report-{uuid.uuid4().hex}")
    for number, changes in enumerate((jobs.where("id % 2 = 0"), first, later)):
        store.apply(changes, number)
    return store.report(A.companies(spark, d), FIRST, LAST, appointments=True)


@query(f"select {COUNTS} from {BUCKETED} b where {ARRIVED}")
def company_status_total(spark, d):
    return reports.grand_total(company_status_breakdown(spark, d))


@query(f"""select id, company_id, c_name company_name, bucket, case when {ARRIVED} then 'arrival' else 'appointment' end matched_by, message_preview from
 (select * from {BUCKETED} b where bucket = 'scheduled_another_day' and (({ARRIVED}) or ({APPOINTED})) order by first_message_at, id limit 500) t
 join customer on c_custkey = company_id left join (select l_orderkey, arg_min(concat_ws(' ', l_returnflag, l_linestatus, l_linenumber), (l_shipdate, l_linenumber)) message_preview
 from lineitem group by 1) m on l_orderkey = id""")
def company_status_drilldown(spark, d):
    got = reports.status_jobs(A.jobs(spark, d), A.origins(spark, d), A.companies(spark, d), *values.business_range(FIRST, LAST), wanted="scheduled_another_day", appointments=True)
    return got.select("id", "company_id", "company_name", "bucket", "matched_by", "message_preview")


@query(f"select {DAY.format('ts')} business_day, event_type, count(*) n from events group by all")
def business_day_counts(spark, d):
    return A.table(spark, d, "events").groupBy(values.business_day(F.col("ts")).alias("business_day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""select 'c' || conv_id counterparty, arg_max(text, turn) content, arg_max(case when role = 'user' then 'incoming' else 'outgoing' end, turn) direction, count(*) message_count
 from conversations group by conv_id""")
def thread_heads(spark, d):
    return messages.thread_heads(A.thread_messages(spark, d)).select("counterparty", "content", "direction", "message_count")


@query("""select 'c' || conv_id counterparty, count(*) message_count from conversations group by conv_id
 order by max(1704067200 + conv_id % 100 * 86400 + turn * 60) desc, counterparty limit 20 offset 10""")
def thread_page(spark, d):
    return messages.list_threads(A.thread_messages(spark, d), skip=10, limit=20).select("counterparty", "message_count")


@query("select count(distinct conv_id) n_threads from conversations")
def thread_count(spark, d):
    return messages.count_threads(A.thread_messages(spark, d))


@query("select turn, role, text from conversations where conv_id = (select min(conv_id) from conversations)")
def thread_of_counterparty(spark, d):
    m = A.thread_messages(spark, d)
    first = A.table(spark, d, "conversations").agg(F.min("conv_id")).first()[0]
    got = messages.thread_messages(m, f"c{first}")
    return got.join(A.table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"]).select("turn", "role", F.col("content").alias("text"))


@query("select user_id, event_id, event_type, round(value, 6) v from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1")
def latest_event_per_user(spark, d):
    return perkey.latest(A.table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", F.round("value", 6).alias("v"))


@query("select distinct on (l_orderkey) l_orderkey, l_linenumber, l_partkey from lineitem order by l_orderkey, l_shipdate, l_linenumber, l_partkey, l_suppkey")
def first_child_per_job(spark, d):
    return perkey.earliest(A.table(spark, d, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("select user_id, event_id, r from (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) r from events) where r <= 3")
def top3_events_per_user(spark, d):
    return perkey.top_per_key(A.table(spark, d, "events"), ["user_id"], [F.desc("value"), F.col("event_id")], 3, "r").select("user_id", "event_id", "r")


@query("""select a.event_id, round(min(date_diff('microsecond', a.ts, b.ts)) / 6e7, 6) as minutes from events a left join events b
 on a.user_id = b.user_id and b.event_type = 'purchase' and b.ts > a.ts and b.ts < a.ts + interval 7 day where a.event_type = 'click' group by a.event_id""")
def reply_within_week(spark, d):
    got = joins.next_within(A.table(spark, d, "events"), ["user_id"], "ts", F.col("event_type") == "purchase", 7 * 24 * 3600, "reply")
    return got.where("event_type = 'click'").select("event_id", F.round(values.minutes_between(F.col("reply"), F.col("ts")), 6).alias("minutes"))


@query("""select a.event_id, max(b.event_id) filter (where b.ts = m) signup_id from (select a.*, (select max(ts) from events b where b.user_id = a.user_id and b.event_type = 'signup' and b.ts < a.ts) m
 from events a where event_type = 'purchase') a left join events b on b.user_id = a.user_id and b.event_type = 'signup' and b.ts = a.m group by a.event_id""")
def asof_previous_signup(spark, d):
    e = A.table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    got = joins.as_of(e.where("event_type = 'purchase'"), e.where("event_type = 'signup'"), "user_id", "ts", "ts", ["event_id"], ["event_id"])
    return got.select("event_id", F.col("matched_event_id").alias("signup_id"))


@query("""select a.event_id, count(b.event_id) clicks_next_day from events a left join events b on a.user_id = b.user_id and b.event_type = 'click'
 and b.ts > a.ts and b.ts <= a.ts + interval 1 day where a.event_type = 'purchase' group by a.event_id""")
def interval_message_count(spark, d):
    e = A.table(spark, d, "events")
    probes = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", (F.col("ts") + F.expr("interval 1 day")).alias("until"))
    return joins.count_between(probes, e.where("event_type = 'click'").select("user_id", "ts"), "user_id", "ts", "until", "ts", "clicks_next_day").select("event_id", "clicks_next_day")


@query("""select l.c_custkey, min(r.c_custkey) first_key from customer l join customer r on r.c_custkey < l.c_custkey and
 ((l.c_mktsegment = r.c_mktsegment and l.c_nationkey = r.c_nationkey) or floor(l.c_acctbal / 10) = floor(r.c_acctbal / 10)) group by l.c_custkey""")
def dedup_first_match(spark, d):
    c = A.table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", F.floor(F.col("c_acctbal") / 10).alias("balance"))
    keys = [[("c_mktsegment", "c_mktsegment"), ("c_nationkey", "c_nationkey")], [("balance", "balance")]]
    key = F.col("c_custkey")
    got = joins.oldest_since(c, c, "c_custkey", keys, F.lit(0).cast("long"), key - 1, key, ["c_custkey"], [])
    return got.select("c_custkey", F.col("match.c_custkey").alias("first_key"))


ROLLUP_DAY = "1995-06-17"
IN_DAY = f"{{0}} >= {START.format(ROLLUP_DAY)} and {{0}} < {START.format('1995-06-18')}"


@query(f"""select company_id, count(*) jobs_received, count(*) filter (where {IN_DAY.format('closed_at')}) jobs_completed,
 round(avg(date_diff('microsecond', first_message_at, closed_at) / 6e7) filter (where {IN_DAY.format('closed_at')}), 4) avg_total_min,
 round(coalesce(sum(o_totalprice) filter (where {IN_DAY.format('closed_at')}), 0), 2) total_revenue
 from {JOBS} j where ({IN_DAY.format('first_message_at')}) or ({IN_DAY.format('closed_at')}) group by company_id""")
def rollup_per_company(spark, d):
    got = rollups.per_company(A.jobs(spark, d), *values.business_range(ROLLUP_DAY, ROLLUP_DAY))
    return got.withColumns({"avg_total_min": F.round("avg_total_min", 4), "total_revenue": F.round("total_revenue", 2)})


EVENT_DAY = "2024-01-10"
IN_EVENT_DAY = f"created_at >= {START.format(EVENT_DAY)} and created_at < {START.format('2024-01-11')}"


@query(f"""select job_id, string_agg(to_status, '>' order by created_at, id) path, count(*) n,
 round(date_diff('microsecond', min(created_at), min(created_at) filter (where to_status = 'dispatched')) / 6e7, 6) time_to_dispatch_min,
 round(date_diff('microsecond', min(created_at), min(created_at) filter (where to_status = 'completed')) / 6e7, 6) time_to_complete_min,
 cast(arg_max(cast(value as decimal(18,2)), (created_at, id)) filter (where source = 'closing_chat') as varchar) closed_total
 from {EVENTS} e where {IN_EVENT_DAY} group by job_id""")
def rollup_per_job(spark, d):
    events = A.lifecycle_events(spark, d)
    jobs = events.select(F.col("job_id").alias("id"), F.lit("x").alias("company_id")).distinct()
    got = rollups.per_job(events, jobs, *values.business_range(EVENT_DAY, EVENT_DAY))
    return got.select(
        "job_id", F.array_join(F.transform("from_to_sequence", lambda s: s["to"]), ">").alias("path"), F.size("from_to_sequence").cast("long").alias("n"),
        F.round("time_to_dispatch_min", 6).alias("time_to_dispatch_min"), F.round("time_to_complete_min", 6).alias("time_to_complete_min"), "closed_total",
    )


@query(f"""with e as (select * from {EVENTS} e), x as (select a.id, a.technician_id, a.created_at, min(b.created_at) reply from e a left join e b on a.chat_jid = b.chat_jid
 and b.source <> 'operator_whatsapp' and b.created_at > a.created_at and b.created_at < a.created_at + interval 7 day where a.source = 'operator_whatsapp' and a.{IN_EVENT_DAY.replace(' and created_at', ' and a.created_at')} group by all),
 y as (select a.id, min(b.created_at) ended from e a join e b on a.job_id = b.job_id and b.to_status in ('completed', 'closed', 'canceled') and b.created_at > a.created_at
 where a.source = 'operator_whatsapp' group by a.id)
 select cast(technician_id as varchar) technician_id, count(*) jobs_dispatched, count(ended) jobs_completed, round(avg(date_diff('microsecond', created_at, reply) / 6e7), 4) avg_response_min,
 round(avg(date_diff('microsecond', created_at, ended) / 6e7), 4) avg_completion_min from x left join y using (id) group by technician_id""")
def rollup_per_tech(spark, d):
    got = rollups.per_tech(A.lifecycle_events(spark, d), *values.business_range(EVENT_DAY, EVENT_DAY))
    return got.withColumns({c: F.round(c, 4) for c in ("avg_response_min", "avg_completion_min")})


@query(f"select cast(id as varchar) job_id, 'undispatched' kind, 5 threshold_minutes from {JOBS} j where lifecycle_status = 'pending' and first_message_at < timestamp '1997-01-01' - interval 5 minute")
def monitor_undispatched(spark, d):
    return monitors.undispatched(A.jobs(spark, d), F.lit("1997-01-01").cast("timestamp")).select("job_id", "kind", "threshold_minutes")


@query(f"""select cast(job_id as varchar) job_id from (select job_id, max(created_at) last_at, max(created_at) filter (where to_status = 'appt_set' and created_at >= timestamp '2024-01-20' - interval 7 day) set_at
 from {EVENTS} e where created_at < timestamp '2024-01-20' group by job_id) where set_at = last_at and date_trunc('second', set_at) + interval 3 hour <= timestamp '2024-01-20' - interval 1 hour""")
def monitor_appointment_passed(spark, d):
    events = A.lifecycle_events(spark, d).where("created_at < timestamp '2024-01-20'")
    return monitors.appt_time_passed(events, F.lit("2024-01-20").cast("timestamp")).select("job_id")


@query(f"select cast(id as varchar) job_id from {JOBS} j where lifecycle_status in ('pending', 'appt_set') and closed_at is null and first_message_at < timestamp '1997-01-01' - interval 1 day and id not in (select job_id from {EVENTS} e where source = 'closing_chat')")
def monitor_closing_missing(spark, d):
    return monitors.closing_missing(A.jobs(spark, d), A.lifecycle_events(spark, d).withColumn("job_id", F.col("job_id")), F.lit("1997-01-01").cast("timestamp")).select("job_id")


@query("select max(ts) < timestamp '2024-02-01' - interval 30 minute stalled from events")
def monitor_freshness(spark, d):
    chats = spark.range(1).select(F.lit(True).alias("is_active"))
    stalled = monitors.ingestion_stalled(A.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("timestamp")), chats, F.lit("2024-02-01").cast("timestamp"))
    return stalled.agg((F.count(F.lit(1)) > 0).alias("stalled"))


@query(f"select job_id, arg_max(to_status, (created_at, id)) lifecycle_status, count(*) n_events from {EVENTS} e group by job_id")
def lifecycle_current_state(spark, d):
    return lifecycle.current_state(A.lifecycle_events(spark, d)).select("job_id", "lifecycle_status", "n_events")


@query("""with old as (select * from events where event_id % 3 <> 0), new as (select user_id, event_type, arg_max(event_id, (ts, -event_id)) event_id, max(ts) ts from events where event_id % 3 = 0 group by all),
 t as (select user_id, event_type, arg_max(event_id, (ts, event_id)) event_id, max(ts) ts from old group by all)
 select coalesce(t.user_id, new.user_id) user_id, coalesce(t.event_type, new.event_type) event_type, case when new.ts is not null and (t.ts is null or new.ts >= t.ts) then new.event_id else t.event_id end event_id,
 case when new.ts is null then 'kept' when t.ts is null then 'inserted' when new.ts >= t.ts then 'updated' else 'skipped' end outcome from t full join new on t.user_id = new.user_id and t.event_type = new.event_type""")
def upsert_latest_wins(spark, d):
    return _merged(spark, d)[1].select("user_id", "event_type", "event_id", F.col("_outcome").alias("outcome"))


@query("""select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id % 3 desc, event_id) r from events) where r = 1""")
def stored_rows(spark, d):
    e = A.table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    store = RunStore(spark, f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}", "user_id long, event_type string, event_id long, value double, ts timestamp", ["user_id", "event_type"], "ts")
    for number in range(3):
        store.apply(e.where(f"event_id % 3 = {number}"), number, "event_id")
    return store.read().drop("ts")


def _merged(spark, d):
    e = A.table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    target = perkey.latest(e.where("event_id % 3 <> 0"), ["user_id", "event_type"], ["ts", "event_id"])
    batch = e.where("event_id % 3 = 0")
    return batch, upsert.merge_latest(target, upsert.in_batch(batch, ["user_id", "event_type"], "ts", "event_id"), ["user_id", "event_type"], "ts")


@query("""with new as (select user_id, event_type, max(ts) ts from events where event_id % 3 = 0 group by all), t as (select user_id, event_type, max(ts) ts from events where event_id % 3 <> 0 group by all)
 select count(*) filter (where t.ts is null) inserted, count(*) filter (where new.ts >= t.ts) updated, count(*) filter (where new.ts < t.ts) skipped,
 (select count(*) from events where event_id % 3 = 0) - count(*) deduplicated from new left join t on t.user_id = new.user_id and t.event_type = new.event_type""")
def upsert_counts(spark, d):
    return upsert.outcome_counts(*_merged(spark, d))


@query("select o_custkey, count(*) n from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING') group by o_custkey having count(*) > 5")
def suggestions_not_bound(spark, d):
    bound = A.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return A.table(spark, d, "orders").join(bound, "o_custkey", "left_anti").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 5")


@query("select doc_id from documents where contains(lower(text), '% license')  union all select doc_id from documents where contains(lower(text), 'mit license')")
def text_search_literal(spark, d):
    docs = A.table(spark, d, "documents")
    hits = [docs.where(text.contains_any_case(F.col("text"), s)).select("doc_id") for s in ("% License", "MIT License")]
    return hits[0].unionByName(hits[1])


@query("select conv_id, turn from conversations where text ilike '%th_n%a%'")
def text_search_wildcards(spark, d):
    m = A.thread_messages(spark, d).withColumnRenamed("content", "body")
    return messages.chat_messages(m, contains="th_n%a", wildcards=True).select("conv_id", "turn")


@query("select doc_id, length(d) n_digits, case when length(d) = 11 and d[1] = '1' then d[2:] when length(d) = 10 then d end phone from (select doc_id, regexp_replace(regexp_extract(text, '" + contact.PHONE + "'), '[^0-9]', '', 'g') d from documents) where d <> ''")
def phone_extract_normalise(spark, d):
    found = A.table(spark, d, "documents").select("doc_id", F.regexp_extract("text", contact.PHONE, 0).alias("p"))
    return found.where("p <> ''").select("doc_id", F.length(contact.digits(F.col("p"))).cast("long").alias("n_digits"), contact.normalize_phone(F.col("p")).alias("phone"))


@query("select c_custkey, substring(sha1(lower(c_name) || '||' || c_nationkey), 1, 12) gid from customer")
def dedup_group_ids(spark, d):
    c = A.table(spark, d, "customer")
    gid = extraction.dedup_group_id(F.concat(F.lit(" "), F.col("c_name")), F.lit(None).cast("string"), F.col("c_nationkey").cast("string"))
    return c.select("c_custkey", gid.alias("gid"))


@query("""select doc_id, case when rn = 1 then 'canonical' else 'superseded' end dedup_status, case when rn = 1 then '' else cast(best as varchar) end superseded_by, case when rn = 1 then n - 1 else 0 end supersedes_count from
 (select doc_id, row_number() over w rn, first_value(doc_id) over w best, count(*) over (partition by lang, source) n from documents window w as (partition by lang, source order by n_chars desc, doc_id desc))""")
def canonical_superseded(spark, d):
    docs = A.table(spark, d, "documents").withColumn("key", F.concat_ws("|", "lang", "source"))
    got = perkey.ranked_versions(docs.select("doc_id", "key", "n_chars"), "key", ["n_chars", "doc_id"], "doc_id")
    return got.select("doc_id", "dedup_status", "superseded_by", "supersedes_count")


@query("""select conv_id, count(*) n, count(*) filter (where role = 'user') incoming, min(turn) first_turn, max(turn) last_turn, round(100.0 * count(*) filter (where role = 'user') / count(*), 1) pct,
 string_agg(distinct role, ',' order by role) roles from conversations group by conv_id""")
def conversation_rollup(spark, d):
    c = A.table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "user").alias("incoming"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
        F.round(100 * F.count_if(F.col("role") == "user") / F.count(F.lit(1)), 1).alias("pct"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"),
    )


@query("select count(*) n, round(avg(n_chars), 4) mean, min(n_chars) least, max(n_chars) most, median(n_chars) median, count(*) filter (where n_chars < 200) low from documents")
def summary_stats(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"),
        F.median("n_chars").alias("median"), F.count_if(F.col("n_chars") < 200).alias("low"),
    )


@query("select source dedup_group_id, count(*) n from documents group by source having count(*) > 1 order by n desc, source limit 5")
def largest_groups(spark, d):
    return backfill.largest_groups(A.table(spark, d, "documents").withColumnRenamed("source", "dedup_group_id"))


@query("select event_type, count(*) n from events group by event_type")
def status_histogram(spark, d):
    return backfill.histogram(A.table(spark, d, "events"), "event_type")


@query("select 'union' op, k from (select c_nationkey k from customer union select s_nationkey from supplier) union all select 'intersect', k from (select c_nationkey k from customer intersect select s_nationkey from supplier) union all select 'except', k from (select n_nationkey k from nation except select s_nationkey from supplier)")
def key_sets(spark, d):
    c, s, n = (A.table(spark, d, t).select(F.col(k).alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))
    named = lambda op, df: df.select(F.lit(op).alias("op"), "k")
    return named("union", perkey.united(c, s)).union(named("intersect", perkey.common(c, s))).union(named("except", perkey.without(n, s)))


@query(" union all ".join(f"select '{x}' literal, doc_id from documents where contains(lower(text), lower('{x}'))" for x in ("Apache License", "you are a", "qz", "THE the", "no such text at all")))
def indexed_search(spark, d):
    """Documents indexed in two batches, and searched for five literals."""
    docs, index = A.table(spark, d, "documents"), TextIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    for half in (0, 1):
        index.add(docs.where(f"doc_id % 2 = {half}"), "doc_id", "text")
    found = [index.search(docs, "doc_id", "text", x).select(F.lit(x).alias("literal"), "doc_id") for x in ("Apache License", "you are a", "qz", "THE the", "no such text at all")]
    return reduce(DataFrame.unionByName, found)


@query("select * from (select event_id, ts, user_id from events where ts < timestamp '2024-01-20' or (ts = timestamp '2024-01-20' and event_id < 900) order by ts desc, event_id desc limit 250)")
def page_after_cursor(spark, d):
    """The page after a cursor over events that were clustered by time."""
    path = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    perkey.clustered(A.table(spark, d, "events").select("event_id", "ts", "user_id"), path, ["ts", "event_id"])
    cursor = (F.lit("2024-01-20").cast("timestamp_ntz"), 900)
    return perkey.seek(spark.read.parquet(path), [("ts", True), ("event_id", True)], cursor, 250)


@query("select c_custkey, c_custkey in (select cast(json_extract_string(props, '$.k') as bigint) from events) as found from customer")
def exists_by_json_field(spark, d):
    return rows.exists_by_json(A.table(spark, d, "customer").select("c_custkey"), "c_custkey", A.table(spark, d, "events"), "props", "$.k")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events where cast(json_extract_string(props, '$.k') as bigint) >= 50")
def json_field_filter(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return A.table(spark, d, "events").select("event_id", k.alias("k")).where("k >= 50")


@query("select o_orderkey, round(cast(cast(o_totalprice as decimal(18,2)) as double), 2) money from orders")
def money_parse(spark, d):
    return A.jobs(spark, d).select(F.col("id").alias("o_orderkey"), F.round(values.parse_money(F.col("closed_total")), 2).alias("money"))


@query("select conv_id, turn, regexp_matches(text, '(?i)" + signals.SETTLEMENT.removeprefix("(?iUd)").replace("'", "''") + "') pays, regexp_matches(text, '" + contact.PHONE + "') has_phone from conversations")
def message_gates(spark, d):
    c = A.table(spark, d, "conversations")
    return c.select("conv_id", "turn", signals.payment_tokens(F.col("text")).isNotNull().alias("pays"), contact.has_phone(F.col("text")).alias("has_phone"))


@query("""select doc_id, case when regexp_matches(text, '(?i)apache license') and regexp_matches(text, '(?i)version') then 'a' when regexp_matches(text, '(?i)mit license') then 'b'
 when regexp_matches(text, '(?im)^this work') then 'c' end company_name from documents where company_name is not null""")
def first_company_by_pattern(spark, d):
    rows = [("1", "a", 0, [["apache license", "version"]]), ("2", "b", 1, [["mit license"], []]), ("3", "c", 2, [["^this work"]])]
    made = [F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"), F.lit(p).alias("priority"), F.lit(True).alias("is_active"), F.array(*[F.struct(F.array(*map(F.lit, g)).cast("array<string>").alias("patterns")) for g in gs]).alias("identification_patterns")) for i, n, p, gs in rows]
    companies = spark.range(1).select(F.explode(F.array(*made)).alias("c")).select("c.*")
    return joins.first_company_by_pattern(A.table(spark, d, "documents"), companies, "doc_id", "text").select("doc_id", "company_name")


@query("select o_orderkey, cast(timezone('UTC', timezone('America/Chicago', o_orderdate + interval 9 hour)) as varchar) at_utc from orders where o_orderstatus = 'P'")
def iso_times(spark, d):
    o = A.table(spark, d, "orders").where("o_orderstatus = 'P'")
    iso = F.date_format(F.col("o_orderdate").cast("timestamp") + F.expr("interval 9 hours"), "yyyy-MM-dd'T'HH:mm:ss")
    return o.select("o_orderkey", F.date_format(values.parse_iso(iso), "yyyy-MM-dd HH:mm:ss").alias("at_utc"))


@query("select o_orderkey, o_custkey, o_orderstatus from orders where o_orderstatus <> 'F' and o_orderdate >= timestamp '1996-01-01' and o_orderdate <= timestamp '1996-06-30' order by o_orderdate desc, o_orderkey limit 50 offset 100")
def filtered_page(spark, d):
    o = perkey.where_all(A.table(spark, d, "orders"), ~F.col("o_orderstatus").isin(["F"]), perkey.within(F.col("o_orderdate"), "1996-01-01", "1996-06-30"), None)
    return perkey.page(o, [F.desc("o_orderdate"), F.col("o_orderkey")], 100, 50).select("o_orderkey", "o_custkey", "o_orderstatus")


@query(r"""with t as (select conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[.,!?;:¡¿*_"`''-]+', ' ', 'g'), '\s+', ' ', 'g')) t from conversations)
 select conv_id, turn, t, t in ('ok', 'okay', 'k', 'yes', 'sure', 'got it', 'will do', 'copy that') accepts from t""")
def normalised_messages(spark, d):
    c = A.table(spark, d, "conversations")
    return c.select("conv_id", "turn", text.normalized(F.col("text")).alias("t"), signals.is_tech_accept(F.col("text")).alias("accepts"))


@query("select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;') h, lower(trim(source)) s from documents")
def sanitised_text(spark, d):
    return A.table(spark, d, "documents").select("doc_id", text.html_escaped(F.col("text")).alias("h"), text.plain_email(F.col("source")).alias("s"))


from tessera.plans import catalog_fields, catalog_jobs, catalog_rows  # noqa: E402, F401  they register queries of their own


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
