"""Streams give what batches give; the REST source follows its pages."""

import itertools
import json
import random
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tessera.functions.values import business_range
from tessera.operators import classify, monitors, perkey
from tessera.plans import reports
from tessera.sources.rest import PagedRest
from tessera.streaming import alerts, ingest, lifecycle, report, resolution, store

SCHEMA = "chat_jid string, wa_message_id string, timestamp timestamp, body string"
T0 = datetime(2026, 7, 15, 12)


def test_store_keeps_the_newest(spark, tmp_path):
    rows = [("c", f"m{i % 7}", T0 + timedelta(minutes=(i * 37) % 50), f"b{i}") for i in range(60)]
    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[k::3], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    table = store.RunStore(spark, str(tmp_path / "table"), SCHEMA, ["chat_jid", "wa_message_id"])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    table.follow(stream, str(tmp_path / "check")).awaitTermination()
    want = {r["wa_message_id"]: r["timestamp"] for r in perkey.latest(spark.createDataFrame(rows, SCHEMA), ["chat_jid", "wa_message_id"], ["timestamp", "body"]).collect()}
    assert {r["wa_message_id"]: r["timestamp"] for r in table.read().collect()} == want
    done = table.version()
    table.apply(spark.createDataFrame([("c", "m0", T0 + timedelta(days=9), "replayed")], SCHEMA), done)
    assert table.version() == done and table.read().where("body = 'replayed'").isEmpty()


def test_store_equals_merges_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [("c" if i % 9 else None, f"m{rng.randrange(12)}", T0 + timedelta(minutes=rng.randrange(30)), f"b{i}") for i in range(90)]
    batches = [rows[k * 15 : k * 15 + 15] for k in range(6)]
    for turn in range(2):
        rng.shuffle(batches)
        table = store.RunStore(spark, str(tmp_path / f"t{turn}"), SCHEMA, ["chat_jid", "wa_message_id"])
        want: dict = {}
        for n, batch in enumerate(batches):
            df = spark.createDataFrame(batch, SCHEMA).coalesce(1)
            table.apply(df, n)
            table.apply(df, n)  # a replay
            newest: dict = {}
            for r in batch:
                newest[r[:2]] = r if r[:2] not in newest or r[2] > newest[r[:2]][2] else newest[r[:2]]
            want |= {k: r for k, r in newest.items() if k not in want or r[2] >= want[k][2]}
            assert {tuple(r)[:2]: tuple(r) for r in table.read().collect()} == want
        assert len(table.manifest().runs) < store.FAN
    found = table.look_up(spark.createDataFrame([("c", "m1"), ("c", "zz")], "chat_jid string, wa_message_id string"))
    assert [tuple(r) for r in found.collect()] == [want["c", "m1"]]
    table.tidy()
    assert {tuple(r) for r in table.read().collect()} == set(want.values())
    assert len([p for p in (tmp_path / "t1").iterdir() if p.name.startswith("run-")]) <= store.FAN + 1


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "SMALLEST", 1 << 10)
    table = store.RunStore(spark, str(tmp_path / "t"), "id long, timestamp timestamp, body string", ["id"])
    big = spark.range(60_000).select("id", F.lit(T0).alias("timestamp"), F.sha2(F.col("id").cast("string"), 256).alias("body"))
    table.apply(big, 0)
    size = table.manifest().runs[0].bytes
    for n in range(1, 7):
        table.apply(big.where(f"id % 2000 = {n}"), n)
        assert table.manifest().runs[0].bytes == size  # the large run stays
        assert sum(r.bytes for r in table.manifest().runs[1:]) < size / 10
    assert table.read().count() == 60_000 and table.manifest().batch == 6


def test_a_batch_that_dies_before_its_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = store.RunStore(spark, str(tmp_path / "t"), SCHEMA, ["chat_jid", "wa_message_id"])
    row = lambda body, n: spark.createDataFrame([("c", "m", T0 + timedelta(minutes=n), body)], SCHEMA)
    table.apply(row("old", 0), 0)
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(store.RunStore, "_commit", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        table.apply(row("new", 1), 1)
    assert [r["body"] for r in table.read().collect()] == ["old"] and table.version() == 0
    table.apply(row("new", 1), 1)
    assert [r["body"] for r in table.read().collect()] == ["new"]
    assert [r["body"] for r in table.read(1).collect()] == ["old"]
    with pytest.raises(RuntimeError, match="somebody else"):
        table._commit(store.Manifest(2, 5, ()))
    with pytest.raises(Exception, match="a row without timestamp"):
        table.apply(spark.createDataFrame([("c", "x", None, "b")], SCHEMA), 9)


def test_resolution_as_a_stream_equals_one_batch(spark, tmp_path):
    rng = random.Random(8)
    schema = "id string, at timestamp, company_id string, street string, phone string"
    rows = sorted(((f"m{i:02}", T0 + timedelta(hours=rng.randrange(24 * 60)), rng.choice(["c1", "c2", None]), rng.choice(["s1", "s2", None]), rng.choice(["p1", "p2", None])) for i in range(30)), key=lambda r: (r[1], r[0]))
    want = {tuple(r)[0]: tuple(r)[1:] for r in classify.resolve(spark.createDataFrame(rows, schema)).select("id", "job_id", "outcome").collect()}
    cuts = [0, 4, 17, 30]
    table = resolution.Resolution(spark, str(tmp_path / "t"))
    for n, (a, b) in enumerate(itertools.pairwise(cuts)):
        for _ in range(2):
            table.apply(spark.createDataFrame(rows[max(0, a - 2) : b], schema), n)  # the last two come again
    assert {r["id"]: (r["job_id"], r["outcome"]) for r in table.read().collect()} == want
    jobs = {r["id"] for r in table.open_jobs(rows[20][1]).collect()}
    assert jobs == {r[0] for r in rows if r[1] >= rows[20][1] and want[r[0]][1] != "linked"}


def test_states_equal_batch(spark, tmp_path):
    status = ["pending", "dispatched", "accepted", "completed", "closed"]
    rows = [(f"{i:03}", f"j{i % 5}", status[(i * 3) % 5], "closing_chat" if i % 2 else "manual", None, T0 + timedelta(minutes=(i * 13) % 90)) for i in range(80)]
    schema = "id string, job_id string, to_status string, source string, payload string, created_at timestamp"
    source = str(tmp_path / "events")
    for k in range(2):
        spark.createDataFrame(rows[k::2], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = lifecycle.job_states(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["job_id"]: (r["lifecycle_status"], r["n_events"]) for r in perkey.latest(spark.table("states"), ["job_id"], ["n_events"]).collect()}
    from tessera.operators.lifecycle import current_state

    want = current_state(spark.createDataFrame(rows, schema)).collect()
    assert got == {r["job_id"]: (r["lifecycle_status"], r["n_events"]) for r in want}


def test_timers_raise_what_scans_find(spark, tmp_path):
    rng = random.Random(12)
    status = ["pending", "dispatched", "accepted", "in_progress", "appt_set", "needs_follow_up", "completed", "canceled"]
    rows = []
    for i in range(120):
        at, to = T0 + timedelta(minutes=i * 20 + rng.randrange(15)), rng.choice(status)
        when = (at + timedelta(minutes=rng.randrange(600))).strftime("%Y-%m-%dT%H:%M:%SZ")
        rows.append((f"{i:03}", f"j{rng.randrange(25)}", to, "operator", json.dumps({"appt_iso": when, "follow_up_at": when, "note": "n"}), at))
    schema = "id string, job_id string, to_status string, source string, payload string, created_at timestamp"
    source, out = str(tmp_path / "events"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        alerts.timed_alerts(stream, late="0 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(alerts.OUT).parquet(out)

    for a, b in ((0, 40), (40, 41), (41, 120)):  # each a run of its own: a restart in between
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(source)
        told = run()
        seen = spark.createDataFrame(rows[:b], schema)
        now = F.lit(max(r[5] for r in rows[:b]))
        jobs = perkey.latest(seen, ["job_id"], ["created_at", "id"]).select(F.col("job_id").alias("id"), F.col("to_status").alias("lifecycle_status"), F.col("created_at").alias("lifecycle_status_changed_at"), F.col("created_at").alias("first_message_at"))
        scans = [
            monitors.undispatched(jobs, now), monitors.stuck(jobs, "dispatched", 240, now), monitors.stuck(jobs, "in_progress", 480, now), monitors.closing_unfiled(jobs, now),
            monitors.appt_time_passed(seen, now), monitors.follow_up_due(seen, now),
        ]
        want = {(r["job_id"], r["kind"]) for df in scans for r in df.collect()}
        got = {(r["job_id"], r["kind"]) for r in alerts.open_now(told).collect()}
        assert got == want and want
    keys = [(r["job_id"], r["kind"], r["action"], r["since"]) for r in told.collect()]
    assert len(keys) == len(set(keys)) > len(want)


def test_report_of_changes_equals_the_report(spark, tmp_path, monkeypatch):
    rng = random.Random(21)
    status = ["pending", "rejected", "closed", "completed", "canceled", "appt_set", "appt_set"]
    rows = []
    for i in range(90):
        came = T0 + timedelta(hours=7 * (i % 20))
        appt = came + timedelta(hours=rng.randrange(60)) if rng.random() < 0.6 else None
        rows.append((f"j{i % 20}", rng.choice(["c1", "c2", None]), came, appt, rng.choice(status), T0 + timedelta(minutes=rng.randrange(500))))
    companies = spark.createDataFrame([("c1", "One", None), ("c2", "Two", "2nd")], "id string, name string, display_name string")
    store_ = report.ReportStore(spark, str(tmp_path / "r"))
    seen: dict = {}
    for n, (a, b) in enumerate(((0, 40), (40, 41), (41, 41), (41, 90))):
        batch = spark.createDataFrame(rows[a:b], report.JOBS).coalesce(1)
        if n == 3:  # dies between the two commits
            with monkeypatch.context() as m, pytest.raises(OSError):
                m.setattr(store_.jobs, "apply", lambda *_: (_ for _ in ()).throw(OSError("killed")))
                store_.apply(batch, n)
        store_.apply(batch, n)
        newest: dict = {}
        for r in rows[a:b]:
            newest[r[0]] = r if r[0] not in newest or r[5] > newest[r[0]][5] else newest[r[0]]
        seen |= {k: r for k, r in newest.items() if k not in seen or r[5] >= seen[k][5]}
    jobs = spark.createDataFrame(list(seen.values()), report.JOBS)
    for first, last in (("2026-07-14", "2026-07-16"), ("2026-07-17", "2026-07-30")):
        for appointments in (False, True):
            want = reports.status_report(jobs, companies, *business_range(first, last), appointments)
            assert [tuple(r) for r in store_.report(companies, first, last, appointments).collect()] == [tuple(r) for r in want.collect()]


def test_routes(spark):
    chats = spark.createDataFrame([("t", True, "tech_dispatch"), ("g", True, None), ("off", False, None)], "chat_jid string, is_active boolean, chat_role string")
    rows = [("t", True, "5 Oak St"), ("t", False, "ok"), ("g", True, "pass"), ("g", False, "pass"), ("g", True, "Paid $600"), ("off", True, "x"), ("new", True, "x")]
    df = spark.createDataFrame(rows, "chat_jid string, is_from_me boolean, body string")
    got = sorted((r["chat_jid"], r["body"], r["route"]) for r in ingest.route(df, chats).collect())
    assert got == sorted([("t", "5 Oak St", "dispatch"), ("t", "ok", "tech_reply"), ("g", "pass", "operator_reject"), ("g", "pass", "classify"), ("g", "Paid $600", "closing_signal"), ("off", "x", "rejected_chat"), ("new", "x", "rejected_chat")])


def test_paged_rest(spark):
    asked = []

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            second = "pageToken=p2" in self.path
            key = self.path.split("/")[2].split("?")[0]
            asked.append(self.path)
            body = {"data": [{"id": f"{key}-{2 if second else 1}", "to": ["x"], "createdAt": "2026-01-02"}], "nextPageToken": None if second else "p2"}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PagedRest)
    url = f"http://127.0.0.1:{server.server_port}/list/{{key}}"
    got = spark.read.format("paged_rest").schema("id string, to string").options(url=url, keys="a,b").load().orderBy("id").collect()
    assert [tuple(r) for r in got] == [("a-1", '["x"]'), ("a-2", '["x"]'), ("b-1", '["x"]'), ("b-2", '["x"]')]
    asked.clear()
    late = spark.read.format("paged_rest").schema("id string, createdAt string").options(url=url, keys="a").load().where("createdAt > '2026-01-01' and createdAt < '2026-02-01'")
    assert late.count() == 2 and asked and all("createdAfter=2026-01-01" in p and "createdBefore=2026-02-01" in p for p in asked)
    server.shutdown()


def test_repeats_are_dropped(spark, tmp_path):
    source = str(tmp_path / "in")
    for _ in range(2):
        spark.createDataFrame([("a", T0), ("b", T0)], "id string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    q = ingest.distinct_events(stream, "id", "ts").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.table("once").collect()) == ["a", "b"]


def test_daily_counts(spark, tmp_path):
    rows = [("a", datetime(2026, 7, 15, 9, 30)), ("a", datetime(2026, 7, 15, 10, 30)), ("a", datetime(2026, 7, 15, 20)), ("a", datetime(2026, 7, 16, 9, 59)), ("b", datetime(2026, 7, 15, 11))]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "k string, ts timestamp").write.parquet(source)
    stream = spark.readStream.schema("k string, ts timestamp").parquet(source)
    q = ingest.daily_counts(stream, "ts", "k").writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((str(r["business_day"]), r["k"], r["n"]) for r in spark.table("daily").collect())
    assert got == [("2026-07-14", "a", 1), ("2026-07-15", "a", 3), ("2026-07-15", "b", 1)]
