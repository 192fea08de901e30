"""Queries of the catalog that read and write rows by key, and those of offline tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import extraction as X
from tessera.functions import text, values
from tessera.operators import classify, messages, perkey, rows
from tessera.plans import adapters as A
from tessera.plans import backfill, rollups
from tessera.plans.registry import query
from tessera.schemas import record_id
from tessera.sources import files


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey = 77 union all select o_orderkey, o_custkey, o_totalprice from orders where o_custkey = 5 and o_orderstatus = 'F'")
def point_lookups(spark, d):
    o = A.table(spark, d, "orders")
    got = rows.lookup(o, o_orderkey=77).unionByName(rows.lookup(o, o_custkey=5, o_orderstatus="F"))
    return got.select("o_orderkey", "o_custkey", "o_totalprice")


@query("select event_id, user_id from events where user_id in (select o_custkey from orders where o_orderpriority = '1-URGENT') and event_type = 'click'")
def lookup_many(spark, d):
    asked = A.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("user_id"))
    return rows.lookup_all(A.table(spark, d, "events").where("event_type = 'click'"), asked, ["user_id"]).select("event_id", "user_id")


def _events_table(spark, d):
    e = A.table(spark, d, "events")
    return e.select(record_id(F.col("user_id"), F.col("ts")).alias("id"), "user_id", "ts", "event_type", "value")


@query("select user_id, ts, coalesce(event_type, 'new') event_type from (select user_id, ts, event_type from events where event_id % 2 = 0 union select user_id, ts, null from events where event_id % 6 = 1)")
def rows_inserted(spark, d):
    table = _events_table(spark, d.rstrip("/")).join(A.table(spark, d, "events").where("event_id % 2 = 0").select("user_id", "ts"), ["user_id", "ts"], "left_semi").select("id", "user_id", "ts", "event_type", "value")
    e = A.table(spark, d, "events")
    new = e.where("event_id % 6 in (0, 1)").select("user_id", "ts", F.lit(None).cast("string").alias("event_type"), F.lit(0.0).alias("value"))
    # rows of the table are offered again and change nothing; new ones get the default
    got = rows.inserted(table, new.unionByName(new), "-", ["user_id", "ts"], {"event_type": F.lit("new")})
    return got.select("user_id", "ts", "event_type")


@query("select o_orderkey, case when o_orderstatus = 'P' and o_custkey % 3 = 0 then 'seen' else o_orderpriority end o_orderpriority, case when o_orderstatus = 'P' and o_custkey % 3 = 0 then o_totalprice + 1 else o_totalprice end o_totalprice from orders where o_orderkey % 4 > 0 and o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def rows_updated_and_deleted(spark, d):
    o = A.table(spark, d, "orders")
    got = rows.updated(o, (F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 3 == 0), o_orderpriority="seen", o_totalprice=F.col("o_totalprice") + 1)
    got = rows.deleted(got, F.col("o_orderkey") % 4 == 0)
    gone = A.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return rows.deleted_by_key(got, gone, ["o_custkey"]).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("select c_custkey id, greatest(timestamp '1996-06-01', max(o_orderdate)) updated_at from customer left join orders on o_custkey = c_custkey group by c_custkey")
def parents_touched(spark, d):
    parents = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("1996-06-01").cast("timestamp_ntz").alias("updated_at"))
    children = A.table(spark, d, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))
    return rows.touched(parents, children, "parent")


@query("select event_id, (event_id % 5) * 1500 duration_ms, case when event_id % 4 + event_id % 3 = 0 then 100.0 else round(100.0 * (event_id % 4) / (event_id % 4 + event_id % 3), 6) end rate from events")
def durations_and_rates(spark, d):
    e = A.table(spark, d, "events").withColumn("started_at", F.col("ts").cast("timestamp"))
    e = e.withColumn("completed_at", F.col("started_at") + F.make_dt_interval(secs=((F.col("event_id") % 5) * 1.5).cast("decimal(18,6)")))
    return rows.durations(e).select("event_id", "duration_ms", F.round(rows.success_rate(F.col("event_id") % 4, F.col("event_id") % 3), 6).alias("rate"))


@query("""select o_orderkey id, case when o_orderkey % 6 = 0 then null else 'l' || o_orderkey end label, case when o_orderkey % 6 = 0 and o_orderkey % 4 = 0 then 'company or label needed' when o_orderkey % 4 > 0 and o_custkey % 50 * 40 not in (select c_custkey from customer) then 'unknown company' end refusal from orders""")
def thread_labels_checked(spark, d):
    o = A.table(spark, d, "orders")
    labels = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey") % 50 * 40).alias("company_id"), F.when(F.col("o_orderkey") % 6 == 0, "  ").otherwise(F.concat(F.lit(" l"), F.col("o_orderkey").cast("string"))).alias("label"))
    return rows.checked_labels(labels, A.phoned_companies(spark, d)).select("id", "label", "refusal")


@query("""with t as (select o_orderkey id, o_custkey % 50 * 40 company, o_custkey % 10000 k, o_orderkey % 10 = 0 bad from orders), f as (select k, min(id) first from t where not bad group by k)
 select t.id, case when bad then 'no phone of ten digits' when company not in (select c_custkey from customer) then 'unknown company' when t.k in (select c_custkey from customer where c_custkey % 7 = 0) or t.id <> f.first then 'bound already' end refusal from t left join f on f.k = t.k""")
def phone_bindings_checked(spark, d):
    o = A.table(spark, d, "orders")
    asked = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50 * 40).alias("company_id"), F.when(F.col("o_orderkey") % 10 == 0, "12").otherwise(A.phone_of("o_custkey")).alias("phone"))
    bound = A.table(spark, d, "customer").where("c_custkey % 7 = 0").select(A.own_phone_of("c_custkey").alias("phone_e164"))
    return rows.checked_bindings(asked, A.phoned_companies(spark, d), bound).select("id", "refusal")


def _manifest(spark, d):
    """Conversations as a manifest: user turns are incoming, those with 'th' are likely jobs of some company."""
    c = A.table(spark, d, "conversations")
    likely = F.contains(F.lower("text"), F.lit("th"))
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("message_id"), F.col("conv_id").alias("conversation_id"), F.lit("p").alias("phone_number_id"), F.lit("1").alias("phone_number_e164"),
        F.lpad(F.col("turn").cast("string"), 6, "0").alias("sent_at"), F.when(F.col("role") == "user", "incoming").otherwise("outgoing").alias("direction"), F.when(likely, "True").otherwise("False").alias("is_job_likely"),
        F.when(likely, F.concat(F.lit("c"), (F.col("conv_id") % 7).cast("string"))).otherwise("").alias("matched_company"), F.when(F.col("turn") == 3, "x").otherwise("").alias("binding_conflict"),
    )


MANIFEST = """(select conv_id || '-' || lpad(cast(turn as varchar), 6, '0') message_id, conv_id, lpad(cast(turn as varchar), 6, '0') sent_at, role = 'user' incoming, contains(lower(text), 'th') likely, turn, 'c' || conv_id % 7 company from conversations)"""


@query(f"""select conv_id conversation_id, count(*) message_count, count(*) filter (where likely) job_count, count(*) filter (where incoming) incoming_count, count(*) filter (where not incoming) outgoing_count,
 round(100.0 * count(*) filter (where likely) / count(*), 1) job_pct, min(sent_at) first_message_at, max(sent_at) last_message_at, coalesce(max(company) filter (where likely), '') companies from {MANIFEST} m group by conv_id""")
def manifest_conversations(spark, d):
    got = backfill.conversation_rollup(_manifest(spark, d))
    return got.drop("phone_number_id", "phone_number_e164")


@query(f"select count(*) n, count(*) filter (where likely) likely, count(*) filter (where not likely) unlikely, count(*) filter (where likely) matched, count(*) filter (where turn = 3) conflicts, count(distinct conv_id) conversations from {MANIFEST} m")
def manifest_summary(spark, d):
    return backfill.manifest_summary(_manifest(spark, d))


@query(f"select company matched_company, message_id from (select *, row_number() over (partition by company order by message_id) r from {MANIFEST} m where likely) where r <= 3")
def manifest_samples(spark, d):
    return backfill.samples(_manifest(spark, d)).select("matched_company", "message_id")


@query(f"select message_id from {MANIFEST} m where likely and conv_id % 3 > 0")
def left_to_extract(spark, d):
    m = _manifest(spark, d)
    return backfill.to_extract(m, m.where("conversation_id % 3 = 0").select("message_id")).select("message_id")


@query("""select conv_id || '-' || lpad(cast(turn as varchar), 6, '0') message_id, length(text) body_length, substring(text, 1, 200) body_preview, 'a,b' to_numbers, case when turn % 2 = 0 then 'True' else 'False' end gate_passed from conversations""")
def message_manifest(spark, d):
    m = A.thread_messages(spark, d).select(F.col("id").alias("message_id"), F.col("conv_id").alias("conversation_id"), "phone_number_id", F.lit("1").alias("phone_number_e164"), "from_number", F.array(F.lit("a"), F.lit("b")).alias("to_numbers"), F.col("created_at").alias("sent_at"), "direction", "content", "turn")
    previews = m.select(F.col("message_id").alias("id"), F.lit(True).alias("is_job_likely"), F.lit("c").alias("matched_company"), F.lit("regex").alias("match_method"), (F.col("turn") % 2 == 0).alias("gate_passed"), F.lit(None).cast("string").alias("binding_conflict"))
    return backfill.manifest(m, previews).select("message_id", "body_length", "body_preview", "to_numbers", "gate_passed")


def _extracted(spark, d):
    """Parts as extracted fields."""
    p = A.table(spark, d, "part")
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ["Lockbox", " Car Key made ", "odd", "Panic Bar"])), (k % 4 + 1).cast("int"))
    pay = F.element_at(F.array(*map(F.lit, ["Cash", "VISA (debit)", "cash app", "barter", "cheque"])), (k % 5 + 1).cast("int"))
    return p.select(
        F.concat(F.lit("m"), F.lpad(k.cast("string"), 8, "0")).alias("message_id"), F.col("p_brand").alias("matched_company"), F.lit(None).cast("string").alias("address"), A.phone_of("p_size").alias("customer_phone"), kind.alias("job_type"),
        F.when(k % 3 > 0, F.concat(F.lit("$"), k.cast("string"))).otherwise("about 5").alias("total"), F.when(k % 2 == 0, "5").alias("parts"), pay.alias("payment_method"), F.when(k % 4 == 1, "Ford").alias("car_make"), F.when(k % 8 == 1, "T").alias("car_model"),
        F.when(k % 16 == 1, "1920").alias("car_year"), F.lpad((k % 100).cast("string"), 3, "0").alias("sent_at"), F.when(k % 6 == 0, "bad").alias("extraction_error"),
    )


PARTS = """(select p_partkey k, p_brand, p_size, 0.25 * ((k % 4 <> 2)::int + (case when k % 4 = 1 then k % 16 = 1 else true end)::int + 1 + (k % 3 > 0)::int) score,
 case k % 5 when 0 then 'cash' when 1 then 'cc' when 2 then 'cash_app' when 3 then 'no_apply' else 'check' end pay, case when k % 4 <> 1 then 'NO_APPLY' when k % 8 = 1 then 'T' else 'NOT_FOUND' end model, k % 2 = 0 and k % 6 > 0 closing from part)"""


@query(f"select 'm' || lpad(cast(k as varchar), 8, '0') message_id, score consistency_score, pay payment_method, model car_model, closing closing_likely, substring(sha1(lower(p_brand) || '||312555' || lpad(cast(p_size as varchar), 4, '0')), 1, 12) dedup_group_id from {PARTS} p")
def normalised_extractions(spark, d):
    return backfill.normalise_extractions(_extracted(spark, d)).select("message_id", "consistency_score", "payment_method", "car_model", "closing_likely", "dedup_group_id")


@query(f"""with v as (select *, row_number() over (partition by p_brand, p_size order by k % 100 desc, k desc) = 1 canonical from {PARTS} p)
 select count(*) n, round(avg(score), 6) mean, min(score) least, max(score) most, median(score) median, count(*) filter (where score < 0.5) low, count(*) filter (where canonical) canonical, count(*) filter (where not canonical) superseded, count(*) filter (where canonical and closing) closing_canonical from v""")
def extraction_summary(spark, d):
    got = backfill.extraction_summary(backfill.versions(backfill.normalise_extractions(_extracted(spark, d))))
    return got.withColumn("mean", F.round("mean", 6))


@query("select event_id id, timezone('UTC', timezone('America/Chicago', ts)) new_timestamp, round(date_diff('microsecond', ts, timezone('UTC', timezone('America/Chicago', ts))) / 3.6e9, 2) drift_hours from events where ts < timestamp '2024-01-20'")
def times_relabelled(spark, d):
    e = A.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"))
    return backfill.relabelled(e, F.lit("2024-01-20").cast("timestamp")).select("id", F.col("new_timestamp").cast("timestamp_ntz").alias("new_timestamp"), "drift_hours")


@query("select '312555' || lpad(cast(c_custkey % 500 as varchar), 4, '0') phone, max('PN' || lpad(cast(c_custkey as varchar), 6, '0')) id from customer where c_custkey % 9 > 0 group by 1")
def numbers_by_phone(spark, d):
    c = A.table(spark, d, "customer").withColumn("k", F.col("c_custkey") % 500)
    numbers = c.select(F.when(F.col("c_custkey") % 9 > 0, F.concat(F.lit("PN"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))).otherwise("").alias("id"), F.concat(F.lit("+1"), A.phone_of("k")).alias("number"))
    return backfill.numbers_by_phone(numbers)


@query("""with c as (select conv_id, list_sort(list(distinct role)) || ['p' || conv_id % 3] parts from conversations group by conv_id) select conv_id id, case when len(parts) > 2 then 'large' else 'matched' end kind from c where conv_id % 3 = 1 union all select conv_id, 'rest' from c where conv_id % 3 <> 1""")
def conversations_of_interest(spark, d):
    c = A.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    c = c.select(F.col("conv_id").alias("id"), F.concat("roles", F.array(F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")))).alias("participants"))
    parts = backfill.split_conversations(c, ["p1", "nobody"], most=2)
    named = [df.select("id", F.lit(k).alias("kind")) for df, k in zip(parts, ("matched", "large", "rest"), strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("select p_partkey, p_name, case when p_partkey % 2 = 0 then 'first' else 'again' end note from part where p_partkey % 2 = 0 union all select p_partkey, p_name, 'again' from part where p_partkey % 3 = 0 and p_partkey % 2 = 1")
def csv_appended(spark, d):
    from tessera.plans.store import shared_folder

    p = A.table(spark, d, "part")
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    row = lambda df, note: df.select(F.col("p_partkey").cast("string").alias("p_partkey"), "p_name", F.lit(note).alias("note"))
    files.write_csv(row(p.where("p_partkey % 2 = 0"), "first"), path)
    files.append_csv(row(p.where("p_partkey % 3 = 0"), "again"), path, "p_partkey")
    return files.read_csv(spark, path).select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name", "note")


@query("""select 'per_company' scope, cast(o_custkey as varchar) scope_id, cast(count(*) as varchar) jobs_received from orders where o_orderdate >= timezone('UTC', timezone('America/Chicago', timestamp '1995-06-17 05:00:00')) and o_orderdate < timezone('UTC', timezone('America/Chicago', timestamp '1995-06-18 05:00:00')) group by o_custkey""")
def stored_snapshot(spark, d):
    from tessera.plans.store import shared_folder

    path = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    jobs = A.jobs(spark, d).withColumn("closed_at", F.lit(None).cast("timestamp"))
    for _ in range(2):  # a rerun replaces the day
        rollups.store(rollups.snapshot("1995-06-17", A.lifecycle_events(spark, d), jobs, ("per_company",)), path)
    got = rollups.listed(rollups.read(spark, path), "1995-06-17", "1995-06-17", "per_company")
    return got.select("scope", "scope_id", F.get_json_object("payload", "$.jobs_received").alias("jobs_received"))


@query("""select 'c' || conv_id counterparty, case when conv_id % 2 = 0 then 'l' || conv_id end as label, case when conv_id % 2 = 0 then case when (conv_id % 40) % 2 = 0 then upper(c_name) else c_name end end label_company_name from
 (select conv_id from conversations group by conv_id order by max(1704067200 + conv_id % 100 * 86400 + turn * 60) desc, 'c' || conv_id limit 30) t left join customer on c_custkey = conv_id % 40""")
def labelled_threads(spark, d):
    c = A.table(spark, d, "conversations").where("conv_id % 2 = 0").select("conv_id").distinct()
    labels = c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("counterparty"), F.concat(F.lit("l"), F.col("conv_id").cast("string")).alias("label"), (F.col("conv_id") % 40).alias("company_id"))
    got = messages.list_threads(A.thread_messages(spark, d), labels, A.phoned_companies(spark, d), limit=30)
    return got.select("counterparty", "label", "label_company_name")


@query("select c_custkey, row_number() over (order by c_acctbal > 0 desc, case when c_custkey % 3 > 0 then c_nationkey end desc nulls last, lower(c_name), c_custkey) place from customer qualify place <= 200")
def chats_in_order(spark, d):
    c = A.table(spark, d, "customer").withColumns({"is_active": F.col("c_acctbal") > 0, "last": F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey"))})
    got = perkey.page(c, [F.desc("is_active"), F.desc_nulls_last("last"), F.lower("c_name"), F.col("c_custkey")], 0, 200)
    # places are read off the page, which is one row a place
    return got.select("c_custkey", "is_active", "last", "c_name").transform(perkey.placed, [F.desc("is_active"), F.desc_nulls_last("last"), F.lower("c_name"), F.col("c_custkey")]).select("c_custkey", "place")


@query("select 'union' op, k from (select c_nationkey k from customer union select s_nationkey from supplier) union all select 'all', k from (select c_nationkey k from customer union all select s_nationkey from supplier) union all select 'intersect', k from (select c_nationkey k from customer intersect select s_nationkey from supplier) union all select 'except', k from (select n_nationkey k from nation except select s_nationkey from supplier)")
def set_operations(spark, d):
    c, s, n = (A.table(spark, d, t).select(F.col(k).alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))
    parts = [("union", perkey.united(c, s)), ("all", perkey.united(c, s, distinct=False)), ("intersect", perkey.common(c, s)), ("except", perkey.without(n, s))]
    out = None
    for op, df in parts:
        one = df.select(F.lit(op).alias("op"), "k")
        out = one if out is None else out.unionByName(one)
    return out


@query("""select conv_id, b, 'MESSAGES:' || chr(10) || string_agg('--- Message ' || r || ' ---' || chr(10) || 'Company: ' || case when turn % 2 = 0 then 'c' else '(unknown)' end || chr(10) || 'Direction: ' || role || chr(10) || repeat(chr(34), 3) || chr(10) || substring(text, 1, 2500) || chr(10) || repeat(chr(34), 3) || chr(10), chr(10) order by turn)
 || chr(10) || 'Return a JSON ARRAY of N objects in the same order, one per message. No markdown. No explanations.' prompt from (select *, turn // 8 b, row_number() over (partition by conv_id, turn // 8 order by turn) r from conversations) group by conv_id, b""")
def batch_prompts(spark, d):
    c = A.table(spark, d, "conversations")
    item = F.struct("turn", F.when(F.col("turn") % 2 == 0, "c").alias("company"), F.upper("role").alias("direction"), F.col("text").alias("body"))
    eight = c.groupBy("conv_id", F.floor(F.col("turn") / 8).alias("b")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return eight.select("conv_id", "b", X.batch_prompt(F.col("items")).alias("prompt"))


@query("select o_orderkey, case when m < 60 then cast(m as integer) || 'm' when m % 60 = 0 then (m // 60) || 'h' else round(m / 60.0, 1) || 'h' end words, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') stamp from (select *, (o_orderkey % 50) * 6 + 6 m from orders)")
def duration_words(spark, d):
    o = A.table(spark, d, "orders").withColumn("m", (F.col("o_orderkey") % 50) * 6 + 6)
    return o.select("o_orderkey", values.duration_words(F.col("m")).alias("words"), text.clock(F.col("o_orderdate")).alias("stamp"))


@query("""select conv_id || '-' || lpad(cast(turn as varchar), 6, '0') id, 'addr ' || length(text) address, case when turn % 2 = 0 then 'Lockbox' end job_type from conversations""")
def extracted_fields(spark, d):
    def extractor(texts):  # stands for a model: what it says depends on the text alone
        return [{"address": f"addr {len(t)}", "job_type": "Lockbox" if t.startswith("0") else None} for t in texts]

    m = A.thread_messages(spark, d).withColumn("content", F.concat((F.col("turn") % 2).cast("string"), "content"))
    got = classify.extract(m, extractor, "address string, job_type string")
    return got.select("id", F.concat(F.lit("addr "), (F.substring("address", 6, 9).cast("int") - 1).cast("string")).alias("address"), "job_type")


@query("""select o_orderkey id, case when o_orderkey % 3 = 0 then 'pending' when o_orderkey % 2 = 0 then 'NEW' else 'old' end status, case when o_orderkey % 3 > 0 and o_orderkey % 2 = 0 then 'a' || o_orderkey when o_orderkey % 3 > 0 then 'before' end address,
 case when o_orderkey % 3 > 0 and o_orderkey % 2 = 0 then 'a' || o_orderkey end raw, case when o_orderkey % 3 > 0 then o_custkey end company_id from orders""")
def extractions_saved(spark, d):
    o = A.table(spark, d, "orders")
    none = lambda c: F.lit(None).cast("string").alias(c)
    dispatch = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("incoming_message_id"), F.col("o_custkey").alias("company_id"), F.lit(7).cast("bigint").alias("job_id"), F.lit("old").alias("classification_status"), none("classification_method"),
        none("classification_error"), F.lit("before").alias("address"), none("total"), none("extraction_raw"), F.col("o_orderdate").alias("created_at"),
    )
    done = o.where("o_orderkey % 2 = 0")
    extracted = done.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("address"), F.lit("5").alias("total"))
    outcome = done.select(F.col("o_orderkey").alias("id"), F.lit("NEW").alias("status"), F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("job_id"), F.lit("regex").alias("method"), none("error"))
    got = classify.reset(classify.saved(dispatch, extracted, outcome, ["address", "total"]), F.col("id") % 3 == 0)
    return got.select("id", F.col("classification_status").alias("status"), "address", F.get_json_object("extraction_raw", "$.address").alias("raw"), "company_id")


@query("select c_custkey chat, c_custkey % 4 = 0 or c_custkey % 3 = 0 or c_custkey % 2 = 1 is_active, case when c_custkey % 2 = 0 then 'kept' else 'new' end origin from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0")
def chats_created(spark, d):
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("chat"), "c_custkey")
    table = c.where("c_custkey % 2 = 0").select("chat", (F.col("c_custkey") % 4 == 0).alias("is_active"), F.lit("kept").alias("origin"))
    new = c.where("c_custkey % 3 = 0").select("chat", F.lit("new").alias("origin"))
    return rows.reactivated(table, new.union(new), "chat")


@query("""select 'company' page, cast(k as varchar) k from (select c_custkey k, row_number() over (order by lower(case when c_custkey % 2 = 0 then upper(c_name) else c_name end), c_custkey) r from customer) where r between 6 and 15
 union all select 'event', cast(event_id as varchar) from (select event_id, row_number() over (order by ts desc, event_id desc) r from events where user_id = 5) where r between 3 and 7
 union all select 'alert', cast(event_id as varchar) from (select event_id, row_number() over (order by ts desc, event_id) r from events where event_id % 3 <> 0 and event_type = 'click') where r <= 10
 union all select 'unseen', cast(event_id as varchar) from (select event_id, row_number() over (order by ts desc, event_id) r from events where event_id % 3 <> 0 and event_id % 5 <> 0) where r <= 10
 union all select 'message', conv_id || '-' || turn from (select conv_id, turn, row_number() over (order by turn) r from conversations where conv_id = (select min(conv_id) from conversations)) where r between 2 and 4""")
def list_pages(spark, d):
    from tessera.operators import monitors

    named = lambda name, df, key: df.select(F.lit(name).alias("page"), key.cast("string").alias("k"))
    companies = perkey.page(perkey.where_all(A.phoned_companies(spark, d), F.col("is_active")), [F.lower(F.coalesce("display_name", "name")), F.col("id")], 5, 10)
    events = perkey.page(rows.lookup(A.table(spark, d, "events"), user_id=5), [F.desc("ts"), F.desc("event_id")], 2, 5)
    a = A.alerts(spark, d)
    alerts = perkey.page(monitors.open_alerts(a, ["undispatched"]), [F.desc("detected_at"), F.col("id")], 0, 10)
    unseen = perkey.page(monitors.open_alerts(a, unseen=True), [F.desc("detected_at"), F.col("id")], 0, 10)
    c = A.table(spark, d, "conversations")
    first = c.agg(F.min("conv_id")).first()[0]
    turns = perkey.page(rows.lookup(c, conv_id=first), [F.col("turn")], 1, 3)
    parts = [named("company", companies, F.col("id")), named("event", events, F.col("event_id")), named("alert", alerts, F.col("id")), named("unseen", unseen, F.col("id")), named("message", turns, F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""with m as (select event_id, ts, unnest([user_id, user_id + 1]) other from events where event_type = 'error') select a.event_id id, count(m.event_id) n from events a left join m on m.other = a.user_id and m.ts > a.ts and m.ts <= a.ts + interval 1 day where a.event_type = 'signup' group by a.event_id""")
def messages_sent_after(spark, d):
    from tessera.operators.joins import count_between

    m = A.messages_of_events(spark, d)
    sent = m.where("event_type = 'error'").select(F.explode(F.array("chat", F.col("chat") + 1)).alias("other"), F.col("timestamp").alias("sent"))
    probes = m.where("event_type = 'signup'").select("id", F.col("chat").alias("other"), "timestamp", (F.col("timestamp") + F.expr("interval 1 day")).alias("until"))
    return count_between(probes, sent, "other", "timestamp", "until", "sent", "n").select("id", "n")


@query("select user_id, count(*) filter (where event_id % 2 = 0) total, count(*) filter (where event_type = 'click' and event_id % 2 = 0) created_click, count(*) filter (where event_type = 'view') open_view from events group by user_id")
def scan_log_fields(spark, d):
    from tessera.operators import monitors

    e = A.table(spark, d, "events")
    kinds = ["click", "view"]
    made = lambda cond: F.create_map(*[x for k in kinds for x in (F.lit(k), F.count_if(cond & (F.col("event_type") == k)))])
    even = F.col("event_id") % 2 == 0
    got = e.groupBy("user_id").agg(made(even).alias("created"), made(F.lit(True)).alias("open"), F.count_if(even & ~F.col("event_type").isin(kinds)).alias("rest"))
    log = monitors.log_fields(F.col("created"), F.col("open"))
    return got.select("user_id", (monitors.total_created(F.col("created")) + F.col("rest")).alias("total"), F.element_at(log, "created_click").alias("created_click"), F.element_at(log, "open_view").alias("open_view"))


@query("""select event_id id, case when user_id % 10 = 9 then 'rejected_chat' when event_id % 6 = 5 then 'closing_signal' when user_id % 2 = 0 and event_type = 'click' then 'dispatch' when user_id % 2 = 0 then 'tech_reply' when event_type = 'click' and event_id % 6 < 2 then 'operator_reject' else 'classify' end route from events""")
def message_routes(spark, d):
    from tessera.streaming.ingest import route

    m = A.messages_of_events(spark, d)
    body = F.when(F.col("id") % 6 == 5, "Paid $600").otherwise(F.col("body"))
    asked = m.select("id", F.col("chat").alias("chat_jid"), body.alias("body"), (F.col("event_type") == "click").alias("is_from_me"))
    chats = m.select(F.col("chat").alias("chat_jid")).distinct().select("chat_jid", (F.col("chat_jid") % 10 < 9).alias("is_active"), F.when(F.col("chat_jid") % 2 == 0, "tech_dispatch").otherwise("company").alias("chat_role"))
    return route(asked, chats).select("id", "route")
