"""Operators of the domain on small frames: scenarios, properties against brute force."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import classify, joins, lifecycle, messages, monitors, perkey, search, upsert
from tessera.plans import backfill, reports, rollups
from tessera.schemas import TABLES, conform, require
from tessera.sources import files
from tessera.functions.values import business_range

T0 = datetime(2026, 7, 15, 12)


def ago(minutes):
    return T0 - timedelta(minutes=minutes)


def frame(spark, table, *rows):
    """Rows (dicts) of a domain table; what isn't given is null."""
    names = sorted({k for r in rows for k in r})
    from pyspark.sql.types import StructType

    kinds = {f.name: f for f in StructType.fromDDL(TABLES[table]).fields}
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], StructType([kinds[n] for n in names])) if rows else spark.createDataFrame([], TABLES[table])
    return conform(df, table)


@pytest.fixture(scope="module")
def now():
    return F.lit(T0).cast("timestamp")


def test_threads(spark):
    m = lambda i, d, frm, to, at, **k: {"id": i, "source": "openphone", "direction": d, "from_number": frm, "to_numbers": [to], "content": f"m{i}", "created_at": ago(at)} | k
    df = frame(
        spark, "incoming_messages", m("1", "incoming", "A", "us", 10), m("2", "outgoing", "us", "A", 5, content="on our way"), m("3", "incoming", "B", "us", 20),
        m("4", "incoming", "C", "us", 0, source="whatsapp"),
    )
    got = messages.list_threads(df).collect()
    assert [(r["counterparty"], r["message_count"], r["content"], r["direction"]) for r in got] == [("A", 2, "on our way", "outgoing"), ("B", 1, "m3", "incoming")]
    assert messages.count_threads(df).first()[0] == 2
    assert {r["id"] for r in messages.thread_messages(df, "A").collect()} == {"1", "2"}
    assert {r["id"] for r in messages.thread_messages(df, "A", since=ago(6)).collect()} == {"2"}


def test_batch_upsert(spark):
    row = lambda k, minutes, body: {"chat_jid": "c", "wa_message_id": k, "timestamp": ago(minutes), "body": body}
    target = frame(spark, "whatsapp_messages", row("a", 10, "old"), row("b", 10, "old"), row("c", 10, "old"))
    batch = frame(spark, "whatsapp_messages", row("a", 11, "stale"), row("b", 10, "same"), row("c", 9, "new"), row("d", 9, "first"), row("d", 8, "last")).withColumn("pos", F.monotonically_increasing_id())
    one = upsert.in_batch(batch, ["chat_jid", "wa_message_id"], "timestamp", "pos")
    merged = upsert.merge_latest(target, one, ["chat_jid", "wa_message_id"], "timestamp").cache()
    assert {r["wa_message_id"]: (r["body"], r["_outcome"]) for r in merged.collect()} == {"a": ("old", "skipped"), "b": ("same", "updated"), "c": ("new", "updated"), "d": ("last", "inserted")}
    assert tuple(upsert.outcome_counts(batch, merged).first()) == (1, 2, 1, 1)
    ties = spark.createDataFrame([("k", 5, "x", 0), ("k", 5, "y", 1)], "k string, ts int, v string, pos long")
    assert upsert.in_batch(ties, ["k"], "ts", "pos").first()["v"] == "x"


def test_insert_missing_and_corrections(spark):
    df = spark.createDataFrame([("k", "1", None, 1), ("k", "1", None, 2), ("k", None, "c", 1), ("j", "1", None, 1)], "kind string, job_id string, chat_jid string, n int")
    there = spark.createDataFrame([("k", None, "c")], "kind string, job_id string, chat_jid string")
    got = upsert.insert_missing(df, there, ["kind", "job_id", "chat_jid"], [F.col("n")]).collect()
    assert {(r["kind"], r["job_id"], r["n"]) for r in got} == {("k", "1", 1), ("j", "1", 1)}
    new = spark.createDataFrame([("1", 9)], "job_id string, n int")
    assert {r["n"] for r in upsert.corrected(df, new, "job_id", ["n"]).where("job_id = '1'").collect()} == {9}


@pytest.mark.parametrize("seed", [1, 2])
def test_joins_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    left = [(i, rng.choice(["a", "b", "c", None]), rng.choice([0, 1, 2, 3, None]), ago(rng.randrange(500))) for i in range(60)]
    right = [(i, rng.choice(["a", "b", "c", None]), rng.choice([0, 1, 2, 3, None]), ago(rng.randrange(500))) for i in range(60)]
    same = lambda x, y: x is not None and x == y
    schema = "id int, k string, x int, at timestamp"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    keys, at = [[("k", "k"), ("x", "x")], [("x", "x")]], F.unix_micros("at")
    for found in (
        joins.first_match_any_key(a, b, "id", keys, ["at", "id"], (F.col("r_at") <= F.col("l_at")) & (F.col("r_at") >= F.col("l_at") - F.expr("interval 200 minutes"))),
        joins.oldest_since(a, b, "id", keys, at - 200 * 60_000_000, at, at, ["id"], ["id"]),
    ):
        want = {i: min(((t2, j) for j, k2, x2, t2 in right if t - timedelta(minutes=200) <= t2 <= t and x2 is not None and x2 == x), default=None) for i, k, x, t in left}
        assert {r["id"]: r["match"]["id"] for r in found.collect()} == {i: v[1] for i, v in want.items() if v}
    got = {r["id"]: r["matched_id"] for r in joins.nearest(a, b, [("k", "k")], at, at, ["id"], ["id"], width=3_600_000_000).collect()}
    want = {i: max(((t2, j) for j, k2, _, t2 in right if same(k2, k) and t2 < t), default=(None, None))[1] for i, k, _, t in left}
    assert got == want
    assert {r["id"]: r["matched_id"] for r in joins.as_of(a, b, "k", "at", "at", ["id"], ["id"]).collect()} == want
    probes = a.withColumn("until", F.col("at") + F.expr("interval 90 minutes"))
    got = {r["id"]: r["n"] for r in joins.count_between(probes, b, "k", "at", "until", "at", "n", bucket=3600).collect()}
    assert got == {i: sum(same(k2, k) and t < t2 <= t + timedelta(minutes=90) for _, k2, _, t2 in right) for i, k, _, t in left}
    e = joins.next_within(b, ["k"], "at", F.col("x") == 1, 3600, "reply", bucket=1800)
    got = {r["id"]: r["reply"] for r in e.collect()}
    assert got == {i: min((t2 for _, k2, x2, t2 in right if same(k2, k) and x2 == 1 and t < t2 < t + timedelta(hours=1)), default=None) for i, k, _, t in right}


def test_picks(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), (None, 5, "n")], "k string, t int, v string")
    assert {(r["k"], r["v"]) for r in perkey.latest(df, ["k"], ["t", "v"]).collect()} == {("a", "y"), ("b", "z"), (None, "n")}
    assert {(r["k"], r["v"]) for r in perkey.earliest(df, ["k"], ["t", "v"]).collect()} == {("a", "x"), ("b", "z"), (None, "n")}
    assert perkey.top_per_key(df, ["k"], [F.desc("t")], 1).count() == 3
    assert perkey.page(df, [F.asc("v")], 1, 2).count() == 2


JOB = {"first_message_at": ago(60 * 30), "company_id": "c1"}


def test_monitors(spark, now):
    jobs = frame(
        spark, "jobs", {"id": "p8", "lifecycle_status": "pending", "first_message_at": ago(8)}, {"id": "p4", "lifecycle_status": "pending", "first_message_at": ago(4)},
        {"id": "bounced", "lifecycle_status": "pending", "first_message_at": ago(90), "lifecycle_status_changed_at": ago(3)},
        {"id": "d241", "lifecycle_status": "dispatched", "lifecycle_status_changed_at": ago(241), "first_message_at": ago(300)}, {"id": "d240", "lifecycle_status": "dispatched", "lifecycle_status_changed_at": ago(240), "first_message_at": ago(300)},
        {"id": "w481", "lifecycle_status": "in_progress", "lifecycle_status_changed_at": ago(481), "first_message_at": ago(500)}, {"id": "done", "lifecycle_status": "completed", "lifecycle_status_changed_at": ago(8), "first_message_at": ago(60)},
        {"id": "late", "lifecycle_status": "accepted", **JOB}, {"id": "flying", "lifecycle_status": "accepted", **JOB}, {"id": "closed", "lifecycle_status": "closed", **JOB},
    )
    ev = lambda i, job, status, at, payload="{}", source="tech_whatsapp": {"id": i, "job_id": job, "to_status": status, "created_at": ago(at), "payload": payload, "source": source}
    iso = lambda minutes: ago(minutes).isoformat() + "Z"
    events = frame(
        spark, "job_lifecycle_events", ev("1", "a1", "appt_set", 600, f'{{"appt_iso": "{iso(60)}"}}'), ev("2", "a2", "appt_set", 600, f'{{"appt_iso": "{iso(59)}"}}'),
        ev("3", "a3", "appt_set", 600, f'{{"appt_iso": "{iso(90)}"}}'), ev("4", "a3", "in_progress", 500), ev("5", "a4", "appt_set", 600, '{"appt_iso": "tomorrow 3pm"}'),
        ev("6", "f1", "needs_follow_up", 100, f'{{"follow_up_at": "{iso(0)}"}}'), ev("7", "f2", "needs_follow_up", 100, f'{{"follow_up_at": "{iso(-1)}"}}'),
        ev("8", "flying", "closed", 30, source="closing_chat"), ev("9", "a5", "appt_set", 60 * 24 * 8, f'{{"appt_iso": "{iso(600)}"}}'),
    )
    up = lambda i, job, at, **k: {"id": i, "job_id": job, "channel": "whatsapp", "company_chat_jid": f"chat{job}", "update_kind": "appt_set", "created_at": ago(at)} | k
    updates = frame(spark, "company_updates", up("u1", "1", 20), up("u2", "2", 20), up("u3", "3", 7), up("u4", "4", 20, sent_at=ago(1)), up("u5", "5", 20, channel="openphone", company_phone="555"), up("u6", "2", 30))
    chat = frame(spark, "whatsapp_messages", {"chat_jid": "chat1", "wa_message_id": "m", "is_from_me": True, "timestamp": ago(19)}, {"chat_jid": "chat2", "wa_message_id": "n", "is_from_me": True, "timestamp": ago(45)})
    phone = frame(spark, "incoming_messages", {"id": "1", "direction": "outgoing", "to_numbers": ["555"], "created_at": ago(2)})
    chats = frame(spark, "whatsapp_tracked_chats", {"chat_jid": "chat1", "is_active": True})
    quiet = frame(spark, "alerts", {"id": "x", "kind": "undispatched", "job_id": "p9"})
    tables = {"jobs": jobs, "job_lifecycle_events": events, "company_updates": updates, "whatsapp_messages": chat, "incoming_messages": phone, "whatsapp_tracked_chats": chats, "alerts": quiet}
    found = monitors.scan(tables, now).cache()
    assert {(r["kind"], r["job_id"]) for r in found.collect()} == {
        ("undispatched", "p8"), ("stuck_dispatched", "d241"), ("stuck_in_progress", "w481"), ("closing_unfiled", "done"), ("closing_missing", "late"),
        ("appt_time_passed", "a1"), ("follow_up_due", "f1"), ("company_update_unsent", "2"),
    }
    again = tables | {"alerts": conform(found.withColumn("id", F.lit("y")), "alerts").unionByName(quiet)}
    assert monitors.scan(again, now).count() == 0
    assert {r["kind"]: (r["created"], r["already_open"]) for r in monitors.counts(found, quiet).collect()}["undispatched"] == (1, 1)
    stalled = monitors.ingestion_stalled(chat.where("timestamp < timestamp '2026-07-15 11:30:00'"), chats, now).collect()
    assert [r["chat_jid"] for r in stalled] == [monitors.WATCHDOG] and monitors.ingestion_stalled(chat, chats, now).count() == 0
    assert monitors.ingestion_stalled(chat.limit(0), chats.limit(0), now).count() == 0


def test_state_machine(spark):
    ev = lambda i, status, source, payload=None, at=0: {"id": i, "job_id": "j", "to_status": status, "source": source, "payload": payload, "created_at": T0 + timedelta(minutes=at)}
    events = frame(
        spark, "job_lifecycle_events", ev("1", "pending", "classification", at=0), ev("2", "closed", "manual", at=1), ev("3", "canceled", "manual", '{"note": " "}', 2), ev("4", "flying", "manual", at=3),
        ev("5", "appt_set", "tech_whatsapp", '{"appt_iso": "2026-07-16T09:00:00", "reason": "will_cb"}', 4), ev("6", "appt_set", "tech_whatsapp", '{"appt_iso": "later"}', 5), ev("7", "closed", "closing_chat", at=6),
    )
    valid, refused = lifecycle.split_events(events)
    assert {r["id"] for r in refused.collect()} == {"2", "3", "4"}
    state = lifecycle.current_state(events).first()
    assert (state["lifecycle_status"], state["appt_at"], state["last_tech_reason"], state["n_events"]) == ("closed", datetime(2026, 7, 16, 14), "will_cb", 4)
    alerts = frame(spark, "alerts", {"id": "a", "job_id": "j", "kind": "undispatched", "detected_at": T0}, {"id": "b", "job_id": "j", "kind": "closing_missing", "detected_at": T0}, {"id": "c", "job_id": "k", "kind": "closing_missing", "detected_at": T0}, {"id": "d", "job_id": "j", "kind": "dispatch_no_match", "detected_at": T0})
    got = {r["id"]: r["resolved_at"] for r in lifecycle.resolve_alerts(alerts, valid).collect()}
    assert got == {"a": T0 + timedelta(minutes=4), "b": T0 + timedelta(minutes=6), "c": None, "d": None}


def test_reply_attribution(spark):
    replies = spark.createDataFrame([("q", "c", ago(0), "m1"), ("near", "d", ago(0), None), ("many", "c", ago(0), None), ("none", "e", ago(0), None), ("late", "d", T0 + timedelta(minutes=400), None)], "id string, chat_jid string, timestamp timestamp, quoted_wa_message_id string")
    own = spark.createDataFrame([("c", "m1", ago(30)), ("c", "m2", ago(20)), ("d", "m3", ago(200))], "chat_jid string, wa_message_id string, timestamp timestamp")
    sent = spark.createDataFrame([("e1", "j1", "c", "m1"), ("e2", "j2", "c", "m2"), ("e3", "j3", "d", "m3")], "event_id string, job_id string, chat_jid string, wa_message_id string")
    got = {r["id"]: (r["outcome"], r["job_id"]) for r in lifecycle.attribute_replies(replies, own, sent).collect()}
    assert got == {"q": ("target", "j1"), "near": ("target", "j3"), "many": ("ambiguous", None), "none": ("none", None), "late": ("none", None)}


COMPANIES = [
    {"id": "1", "name": "ACME", "identification_patterns": [(["acme", r"job\sid:\s\d+"],), (["acme works"],)], "phone_numbers": ["(773) 555-0100"], "is_active": True, "priority": 0},
    {"id": "2", "name": "BEST", "identification_patterns": [(["^best keys"],)], "phone_numbers": [], "is_active": True, "priority": 1},
    {"id": "3", "name": "OFF", "identification_patterns": [([".*"],)], "phone_numbers": ["7735550199"], "is_active": False, "priority": 2},
]


def test_preview(spark):
    job = "call 773-555-0123 at 123 Main St, Chicago, IL 60601"
    m = lambda i, text, frm=None, source="openphone": {"id": i, "source": source, "content": text, "from_number": frm}
    df = frame(
        spark, "incoming_messages", m("phone", job, "+17735550100"), m("nogate", "hello", "+17735550100"), m("and", f"Acme job id: 12 {job}"), m("half", f"acme {job}"), m("line", f"x\nBest keys\n{job}"),
        m("bound", job, "(312) 555-0111"), m("wa", job, "(312) 555-0111", "whatsapp"), m("clash", f"acme works {job}", "3125550111"), m("blank", " "), m("null", None),
    )
    bindings = frame(spark, "company_phone_bindings", {"id": "b", "phone_e164": "3125550111", "company_id": "2"})
    got = {r["id"]: (r["match_method"], r["matched_company"]) for r in classify.preview(df, frame(spark, "companies", *COMPANIES), bindings).collect()}
    assert got == {
        "phone": ("phone", "ACME"), "nogate": ("not_a_job", None), "and": ("regex", "ACME"), "half": ("none", None), "line": ("regex", "BEST"), "bound": ("phone_binding", "BEST"),
        "wa": ("none", None), "clash": ("regex", "ACME"), "blank": ("not_a_job", None), "null": ("not_a_job", None),
    }
    conflict = classify.preview(df, frame(spark, "companies", *COMPANIES), bindings).where("id = 'clash'").first()["binding_conflict"]
    assert conflict == "regex=ACME binding=BEST"


def test_a_phone_bound_twice_gives_one_row(spark):
    df = frame(spark, "incoming_messages", {"id": "m", "source": "openphone", "content": "call 773-555-0123 at 123 Main St, Chicago, IL 60601", "from_number": "(312) 555-0111"})
    bindings = frame(spark, "company_phone_bindings", {"id": "a", "phone_e164": "3125550111", "company_id": "2"}, {"id": "b", "phone_e164": "+1 312 555 0111", "company_id": "1"})
    assert [(r["id"], r["matched_company"]) for r in classify.preview(df, frame(spark, "companies", *COMPANIES), bindings).collect()] == [("m", "ACME")]


def test_resolution(spark):
    schema = "id string, at timestamp, company_id string, street string, phone string"
    rows = [("a", ago(100), "c1", "s1", "p1"), ("b", ago(90), "c1", "s1", None), ("c", ago(80), "c2", None, "p1"), ("d", ago(70), "c1", "s2", "p2"), ("e", ago(60), "c1", "s2", "p1"), ("f", T0 + timedelta(days=20), "c1", "s1", None)]
    df = spark.createDataFrame(rows, schema)
    found = classify.resolve(df).collect()
    got = {r["id"]: (r["job_id"], r["outcome"]) for r in found}
    assert {r["id"]: r["round"] for r in found} == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1, "f": 0}
    assert got == {"a": ("a", "new"), "b": ("a", "linked"), "c": ("c", "duplicate"), "d": ("d", "new"), "e": ("a", "linked"), "f": ("f", "new")}
    jobs = frame(spark, "jobs", {"id": "j1", "company_id": "c1", "first_message_at": ago(500), "address_street_number": "1", "address_street_name": "oak"}, {"id": "j2", "company_id": "c2", "first_message_at": ago(600), "customer_phone_e164": "p1"})
    asked = spark.createDataFrame([("m", "c1", "1", "oak", "p1", ago(0)), ("n", "c1", "2", "oak", None, ago(0))], "id string, company_id string, street_number string, street_name string, phone string, l string").withColumn("at", F.col("l").cast("timestamp")).drop("l")
    assert [tuple(r) for r in classify.dedup_candidates(asked, jobs).collect()] == [("m", "j2", True)]
    assert [tuple(r) for r in classify.rematch_closings(asked, jobs).collect()] == [("m", "j1")]


def test_long_chains_and_batches(spark):
    """Chains through changing phones and streets, and random messages, give what one message at a time gives."""
    rng = random.Random(3)
    schema = "id string, at timestamp, company_id string, street string, phone string"
    chain = [(f"c{i:02}", ago(1000 - i), "c1", f"s{i // 2}", f"p{(i + 1) // 2}") for i in range(9)]
    assert {r["id"]: (r["job_id"], r["outcome"], r["round"]) for r in classify.resolve(spark.createDataFrame(chain, schema)).collect()} == {
        f"c{i:02}": ((f"c{i:02}", "new") if i % 2 == 0 else (f"c{i - 1:02}", "linked")) + (i,) for i in range(9)
    }
    rows = sorted(((f"m{i:03}", ago(rng.randrange(60 * 24 * 50)), rng.choice(["c1", "c2", None]), rng.choice(["s1", "s2", "s3", None, ""]), rng.choice(["p1", "p2", "p3", "p4", None])) for i in range(80)), key=lambda r: (r[1], r[0]))
    df = spark.createDataFrame(rows, schema)
    got = {r["id"]: (r["job_id"], r["outcome"]) for r in classify.resolve(df).collect()}
    jobs, want = [], {}
    for i, at, company, street, phone in rows:
        near = [j for j in jobs if at - timedelta(days=14) <= j[0] and ((street and j[3] == street) or (phone and j[4] == phone))]
        old = min(near, default=None, key=lambda j: j[:2])
        crossed = old is not None and old[2] and company and old[2] != company
        if old is not None and not crossed:
            want[i] = (old[1], "linked")
        else:
            jobs.append((at, i, company, street, phone))
            want[i] = (i, "duplicate" if crossed else "new")
    assert got == want


def test_report_buckets(spark):
    day = datetime(2026, 7, 15, 15)
    job = lambda i, status, **k: {"id": i, "company_id": "c", "first_message_at": day, "lifecycle_status": status} | k
    jobs = frame(
        spark, "jobs", job("1", "rejected"), job("2", "closed"), job("3", "completed"), job("4", "appt_set", appt_at=day + timedelta(hours=3)), job("5", "appt_set", appt_at=day + timedelta(days=1)),
        job("6", "appt_set"), job("7", "canceled"), job("8", "pending", company_id=None), job("9", "appt_set", first_message_at=day - timedelta(days=3), appt_at=day), job("10", "dispatched", company_id="zz"),
    )
    companies = frame(spark, "companies", {"id": "c", "name": "ACME", "display_name": "Acme Inc"})
    start, end = business_range("2026-07-15", "2026-07-15")
    got = [tuple(r) for r in reports.status_report(jobs, companies, start, end).collect()]
    assert got == [("c", "Acme Inc", 2, 2, 1, 1, 1, 7), ("zz", "Unknown", 0, 1, 0, 0, 0, 1)]
    wide = reports.status_report(jobs, companies, start, end, appointments=True).first()
    assert wide["total"] == 8 and wide["scheduled_another_day"] == 2
    origins = spark.createDataFrame([("9", "hello", None, day)], "job_id string, content string, from_number string, created_at timestamp")
    cell = {r["id"]: (r["matched_by"], r["message_preview"]) for r in reports.status_jobs(jobs, origins, companies, start, end, "c", "scheduled_another_day", True).collect()}
    assert cell == {"5": ("arrival", None), "9": ("appointment", "hello")}


def test_rollups(spark, tmp_path):
    day = datetime(2026, 7, 15, 15)
    jobs = frame(
        spark, "jobs", {"id": "j1", "company_id": "c", "first_message_at": day - timedelta(days=2), "closed_at": day, "closed_total": "$200.00"}, {"id": "j2", "company_id": "d", "first_message_at": day, "closed_total": "$9"},
        {"id": "j3", "company_id": None, "first_message_at": day},
    )
    ev = lambda i, job, status, source, minutes, payload="{}": {"id": i, "job_id": job, "to_status": status, "source": source, "created_at": day + timedelta(minutes=minutes), "payload": payload}
    events = frame(
        spark, "job_lifecycle_events", ev("1", "j1", "dispatched", "operator_whatsapp", 0, '{"technician_id": "t1", "chat_jid": "x"}'), ev("2", "j2", "accepted", "tech_whatsapp", 10, '{"chat_jid": "x"}'),
        ev("3", "j1", "completed", "closing_signal", 60), ev("4", "j1", "closed", "closing_chat", 90, '{"closed_total": "$200.00", "closed_payment_method": "cash"}'),
        ev("5", "j2", "dispatched", "operator_whatsapp", 20, '{"technician_id": "t1"}'),
    )
    start, end = business_range("2026-07-15", "2026-07-15")
    got = {r["company_id"]: (r["jobs_received"], r["jobs_completed"], r["avg_total_min"], r["total_revenue"]) for r in rollups.per_company(jobs, start, end).collect()}
    assert got == {"c": (1, 1, 2880.0, 200.0), "d": (1, 0, None, 0.0)}
    assert [tuple(r) for r in rollups.per_tech(events, start, end).collect()] == [("t1", 2, 1, 10.0, 60.0)]
    job = {r["job_id"]: r for r in rollups.per_job(events, jobs, start, end).collect()}
    assert (job["j1"]["time_to_dispatch_min"], job["j1"]["time_to_complete_min"], job["j1"]["closed_total"], job["j1"]["technician_id"]) == (0.0, 60.0, "$200.00", "t1")
    assert [s["to"] for s in job["j2"]["from_to_sequence"]] == ["accepted", "dispatched"] and job["j2"]["time_to_dispatch_min"] == 10.0
    path = str(tmp_path / "snapshots")
    for _ in range(2):
        rollups.store(rollups.snapshot("2026-07-15", events, jobs), path)
    rollups.store(rollups.snapshot("2026-07-16", events, jobs, ("per_company",)), path)
    stored = spark.read.parquet(path)
    assert stored.groupBy("scope").count().orderBy("scope").collect() == [("per_company", 2), ("per_job", 2), ("per_tech", 1)]
    assert rollups.listed(stored, "2026-07-15", "2026-07-15", "per_tech").count() == 1
    rollups.export(stored, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').count() == 5


def test_backfill(spark, tmp_path):
    raw = spark.createDataFrame(
        [("m1", "acme", "123 N Main St, Chicago", "7735551212", "Lockbox", "100", "20", "Cash", None, "2026-01-01", None), ("m2", "ACME", "123 North Main Street", "(773) 555-1212", "odd", "", None, "visa", None, "2026-01-02", "bad"), ("m3", "b", None, None, "Car Key made", None, None, None, "Ford", None, None)],
        "message_id string, matched_company string, address string, customer_phone string, job_type string, total string, parts string, payment_method string, car_make string, sent_at string, extraction_error string",
    ).withColumns({"car_model": F.lit(None).cast("string"), "car_year": F.lit(None).cast("string")})
    got = backfill.versions(backfill.normalise_extractions(raw)).cache()
    rows = {r["message_id"]: r for r in got.collect()}
    assert rows["m1"]["dedup_group_id"] == rows["m2"]["dedup_group_id"] and rows["m1"]["superseded_by"] == "m2" and rows["m2"]["supersedes_count"] == 1
    assert rows["m1"]["closing_likely"] and not rows["m2"]["closing_likely"] and rows["m3"]["car_model"] == "NOT_FOUND" and rows["m1"]["car_make"] == "NO_APPLY"
    assert backfill.extraction_summary(got).first()["canonical"] == 2
    path = str(tmp_path / "out")
    plain = got.select("message_id", "matched_company")
    files.write_csv(plain.where("message_id = 'm1'"), path)
    files.append_csv(plain, path, "message_id")
    assert sorted(r["message_id"] for r in files.read_csv(spark, path).collect()) == ["m1", "m2", "m3"]
    with pytest.raises(ValueError):
        files.append_csv(plain.withColumnRenamed("matched_company", "x"), path, "message_id")
    with pytest.raises(ValueError):
        require(plain, ["nothing"])
    convs = spark.createDataFrame([("1", ["a", "z"]), ("2", ["a"] + [str(i) for i in range(12)]), ("3", ["q"])], "id string, participants array<string>")
    assert [[r["id"] for r in df.collect()] for df in backfill.split_conversations(convs, ["z", "a"])] == [["1"], ["2"], ["3"]]


def test_companies_file(spark, tmp_path):
    p = tmp_path / "companies.json"
    p.write_text('[{"name": "B", "display_name": "b", "identification_patterns": [{"patterns": ["x", "y"]}], "phone_numbers": ["1"]}, {"name": "A", "identification_patterns": [], "phone_numbers": []}]')
    got = files.read_companies(spark, str(p))
    assert [(r["name"], r["priority"]) for r in got.orderBy("priority").collect()] == [("B", 0), ("A", 1)]
    assert {r["name"]: r["n_patterns"] for r in files.pattern_counts(got).collect()} == {"B": 2, "A": 0}


def test_pages_by_cursor_are_the_whole_order(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, T0 + timedelta(minutes=rng.randrange(30)), rng.choice("ab")) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, at timestamp, kind string")
    perkey.clustered(df, str(tmp_path / "t"), ["at", "id"], 6)
    stored, order = spark.read.parquet(str(tmp_path / "t")), [("kind", False), ("at", True), ("id", False)]
    got, cursor = [], None
    while page := perkey.seek(stored, order, cursor, 23).collect():
        got += [r["id"] for r in page]
        cursor = (page[-1]["kind"], page[-1]["at"], page[-1]["id"])
    assert got == [r[0] for r in sorted(rows, key=lambda r: (r[2], -r[1].timestamp(), r[0]))]
    deep = perkey.seek(stored, [("at", True), ("id", True)], (T0 + timedelta(minutes=3), 5), 10)
    plan = deep._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [Or(LessThan(at" in plan
    spans = stored.groupBy(F.input_file_name().alias("f")).agg(F.min("at").alias("low")).where(F.col("low") <= T0 + timedelta(minutes=3)).count()
    assert spans < 6  # most files hold nothing after the cursor


def test_indexed_search_equals_contains(spark, tmp_path):
    texts = [(1, "Wir äßen Öl in 5% der Fälle_n"), (2, "the quick brown fox"), (3, None), (4, ""), (5, "ab"), (6, "THE QUICK BROWN FIX, quickly"), (7, "quick brow"), (8, "aaa\naaaa"), (9, "äöü ÄÖÜ")]
    df = spark.createDataFrame(texts, "id long, body string").withColumnRenamed("id", "key")
    index = search.TextIndex(spark, str(tmp_path / "i"), rarest=2)
    index.add(df.where("key < 6"), "key", "body")
    index.add(df.where("key >= 6"), "key", "body")
    index.add(df.where("key > 99"), "key", "body")  # an empty batch
    for literal in ("quick brown", "QUICK", "quickl", "ab", "", "äÖ", "aaaa", "5% der", "öl in", "nowhere at all", "fälle_n", "a\na", "ÄÖÜ"):
        want = sorted(k for k, t in texts if t is not None and literal.lower() in t.lower())
        assert sorted(r["key"] for r in index.search(df, "key", "body", literal).collect()) == want, literal
    first, *_ = index.plan("the quick brown")
    assert first[1] == min(n for _, n, _ in index.plan("the quick brown")) and index.plan("xyzzy")[0][1] == 0 and index.plan("ab") == []
    batches = {b for _, _, own in index.plan("quickly") for b in own}
    assert len(batches) == 1  # only the batch that has all of it is read


def test_long_chains_take_no_more_jobs_and_slices_change_nothing(spark):
    schema = "id string, at timestamp, company_id string, street string, phone string"

    def took(n):
        """Spark jobs and answers for messages of one street, nine days apart: each second one opens a job."""
        rows = [(f"{i:03}", T0 + timedelta(days=9 * i), "c1", "s", "p") for i in range(n)]
        spark.sparkContext.setJobGroup(group := f"chain-{n}-{uuid.uuid4().hex}", "")
        got = {r["id"]: r["outcome"] for r in classify.resolve(spark.createDataFrame(rows, schema)).collect()}
        assert got == {f"{i:03}": "linked" if i % 2 else "new" for i in range(n)}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert took(30) <= took(6) + 2
    rng = random.Random(8)
    pick = lambda *of: rng.choice([*of, None])
    rows = [(f"m{i:03}", ago(60 * rng.randrange(24 * 60)), pick("c1", "c2"), pick("s1", "s2", "s3", "s4", ""), pick("p1", "p2", "p3", "p4", "p5")) for i in range(120)]
    rows += [("x", None, "c1", "s1", "p1"), rows[0]]
    jobs = spark.createDataFrame([(f"j{i}", ago(60 * rng.randrange(24 * 70)), pick("c1", "c2"), pick("s1", "s2", "s5"), pick("p1", "p2", "p3")) for i in range(12)], schema)
    df = spark.createDataFrame(rows, schema)
    answers = lambda **k: sorted((r["id"], r["job_id"], r["outcome"]) for r in classify.resolve(df, jobs, **k).collect())
    assert len(whole := answers()) == 122 and answers(at_once=30) == whole
