"""Queries of the catalog on the column functions: contacts, gates, signals, wording, extraction rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import contact, extraction, signals, text, values
from tessera.plans import adapters as A
from tessera.plans.registry import query


def pick(key: str, *options):
    """One of the options, by the key's remainder."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.col(key) % len(options) + 1).cast("int"))


def chosen(key: str, *options) -> str:
    """The same as SQL."""
    return "[" + ", ".join("null" if o is None else "'" + o.replace("'", "''") + "'" for o in options) + f"][cast({key} % {len(options)} as integer) + 1]"


WAYS = (("", ""), ("N ", "north "), ("South ", "south "), ("nw ", "northwest "))
ENDS = ((" St", " street"), (" Ave.", " avenue"), (" blvd", " boulevard"), (" Way", " way"), (" Pkwy", " parkway"), (" Plaza", " plaza"), ("", ""))


@query(f"""select c_custkey, cast(c_custkey % 900 + 1 as varchar) || case when c_custkey % 3 = 0 then 'b' else '' end street_number, {chosen('c_custkey', *[b for _, b in WAYS])} || 'oak hill' || {chosen('c_custkey', *[b for _, b in ENDS])} street_name,
 case when c_custkey % 5 > 0 then 'chicago' end city, case when c_custkey % 5 > 0 then 'IL' end state, case when c_custkey % 5 > 1 then cast(60600 + c_custkey % 100 as varchar) end zip from customer""")
def addresses_normalised(spark, d):
    k = F.col("c_custkey")
    line = F.concat((k % 900 + 1).cast("string"), F.when(k % 3 == 0, "b").otherwise(""), F.lit(" "), pick("c_custkey", *[a for a, _ in WAYS]), F.lit("Oak  Hill"), pick("c_custkey", *[a for a, _ in ENDS]))
    tail = F.when(k % 5 == 0, "").when(k % 5 == 1, ", Chicago, IL").otherwise(F.concat(F.lit(", Chicago, IL "), (60600 + k % 100).cast("string")))
    a = contact.normalize_address(F.concat(line, tail))
    return A.table(spark, d, "customer").select("c_custkey", *[a[c].alias(c) for c in ("street_number", "street_name", "city", "state", "zip")])


@query(f"select c_custkey, case when c_custkey % 4 < 3 then '+1' || '312555' || lpad(cast(c_custkey % 10000 as varchar), 4, '0') end e164, case when c_custkey % 4 = 3 then '5' || lpad(cast(c_custkey % 10000 as varchar), 7, '0') else '312555' || lpad(cast(c_custkey % 10000 as varchar), 4, '0') end match_key from customer")
def phones_normalised(spark, d):
    tail = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("(312) 555-"), tail)).when(k == 1, F.concat(F.lit("+1 312.555."), tail)).when(k == 2, F.concat(F.lit("312555"), tail)).otherwise(F.concat(F.lit("5"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 7, "0")))
    return A.table(spark, d, "customer").select("c_custkey", contact.to_e164(raw).alias("e164"), contact.phone_match_key(raw).alias("match_key"))


BODIES = (
    ("call 312-555-0100 at 12 Main St, Chicago, IL 60601", True, True), ("call 312-555-0100", False, True), ("12 Main St", False, True), ("Addr: somewhere 3125550100", True, True), ("hello there", False, False), ("  ", False, False),
    ("Chicago, IL 60601 or 555-0100", True, True), ("ref 12", False, False),
)


@query(f"select event_id, {chosen('event_id', *[str(a).lower() for _, a, _ in BODIES])} = 'true' is_job, {chosen('event_id', *[str(b).lower() for _, _, b in BODIES])} = 'true' has_key from events")
def job_gates(spark, d):
    body = pick("event_id", *[t for t, _, _ in BODIES])
    return A.table(spark, d, "events").select("event_id", contact.is_job_message(body).alias("is_job"), contact.has_matching_key(body).alias("has_key"))


REPLIES = (
    ("I have it, thanks", True, False, False), ("Pass 60601", True, False, False), ("pass", True, False, True), ("can't take it", True, False, False), ("sorry no techs today", True, False, False), ("got it!", False, True, False),
    ("OK.", False, True, False), ("on my way", False, False, False), ("nope", False, False, True), ("", False, False, False), ("nobody available tonight", True, False, False), ("can you pass the word along please", False, False, False),
)


@query("select event_id, " + ", ".join(f"{chosen('event_id', *[str(r[i]).lower() for r in REPLIES])} = 'true' {name}" for i, name in ((1, "rejects"), (2, "tech_accepts"), (3, "tech_rejects"))) + " from events")
def reply_signals(spark, d):
    body = pick("event_id", *[r[0] for r in REPLIES])
    return A.table(spark, d, "events").select("event_id", signals.is_reject_phrase(body).alias("rejects"), signals.is_tech_accept(body).alias("tech_accepts"), signals.is_tech_reject(body).alias("tech_rejects"))


NOTES = ((" customer moved away", True), ("", False), (" is the number wrong?", False), (" appointment tomorrow", False), (" paid $60 cash", False), (" " + "x" * 210, False), (" no", True))


@query(f"select p_partkey, {chosen('p_partkey', *[str(b).lower() for _, b in NOTES])} = 'true' repaste, {chosen('p_partkey', *[str(b).lower() for _, b in NOTES])} = 'true' rejects from part")
def repasted_jobs(spark, d):
    p = A.table(spark, d, "part")
    job = F.concat(F.lit("Lock change for "), "p_name", F.lit(" at building number "), F.col("p_partkey").cast("string"))
    reply = F.concat(job, pick("p_partkey", *[n for n, _ in NOTES]))
    return p.select("p_partkey", signals.is_repaste_with_note(reply, job).alias("repaste"), signals.is_reject_signal(reply, job).alias("rejects"))


UPDATES = ("in_progress", "appt_set", "needs_follow_up", "canceled", "other")


@query(f"""select event_id, case event_id % 5 when 0 then 'Update: technician is on the way.' when 1 then 'Update: appointment set for noon.' when 2 then 'Update: needs follow-up' || case when event_id % 3 = 0 then ' (customer will call back)' else '' end || '. Will follow up around 5pm.'
 when 3 then 'Update: job canceled' || case when event_id % 3 = 0 then ' — customer will call back' else '' end || '.' else 'Update: other.' end || case when event_id % 2 = 0 then ' Note: n' || event_id else '' end line,
 case when event_id % 4 = 0 then 'job' || chr(10) || chr(10) || 'L' else 'L' end relay, {chosen('event_id', 'in_progress', 'appt_set', 'needs_follow_up', 'canceled', None)} status from events""")
def update_lines(spark, d):
    e = A.table(spark, d, "events")
    why, note = F.when(F.col("event_id") % 3 == 0, "will_cb"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("n"), F.col("event_id").cast("string")))
    line = signals.update_line(pick("event_id", *UPDATES), F.lit("noon"), F.lit("5pm"), why, note)
    intent = pick("event_id", "in_progress", "appt_set", "needs_follow_up", "canceled", "thanks")
    return e.select("event_id", line.alias("line"), signals.relay_text(F.when(F.col("event_id") % 4 == 0, " job "), F.lit("L")).alias("relay"), signals.status_of_intent(intent).alias("status"))


@query("""select p_partkey, case p_partkey % 4 when 3 then null else p_name end as name, case p_partkey % 4 when 0 then p_partkey || '' when 1 then 'true' when 2 then 'a, 2' end v from part""")
def json_found_in_text(spark, d):
    p = A.table(spark, d, "part")
    inner = F.when(F.col("p_partkey") % 4 == 0, F.col("p_partkey").cast("string")).when(F.col("p_partkey") % 4 == 1, "true").otherwise('["a", null, 2]')
    obj = F.concat(F.lit('{"name": "'), "p_name", F.lit('", "v": '), inner, F.lit("}"))
    body = F.when(F.col("p_partkey") % 4 == 3, "no {json here").when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Sure {x}: "), obj, F.lit(" done"))).otherwise(text.without_fence(F.concat(F.lit("```json\n"), obj, F.lit("\n```"))))
    got = p.select("p_partkey", extraction.first_json_object(body).alias("m"))
    return got.select("p_partkey", F.try_element_at("m", F.lit("name")).alias("name"), F.try_element_at("m", F.lit("v")).alias("v"))


@query("""select conv_id, turn, 'Company: ' || case when turn % 2 = 0 then 'c' || conv_id else '(unknown)' end || chr(10) || 'Direction: ' || role || chr(10) || chr(10) || 'Message:' || chr(10) || repeat(chr(34), 3) || chr(10) || substring(text, 1, 2500) || chr(10) || repeat(chr(34), 3) || chr(10) prompt from conversations""")
def prompts(spark, d):
    c = A.table(spark, d, "conversations")
    company = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    return c.select("conv_id", "turn", extraction.prompt(company, F.upper("role"), F.col("text")).alias("prompt"))


@query("""select event_id, case when m < 1 then 'just now' when m < 60 then m || 'm ago' when m < 1440 then (m // 60) || 'h ago' else (m // 1440) || 'd ago' end ago from (select event_id, date_diff('microsecond', ts, timestamp '2024-02-01') // 60000000 m from events where ts < timestamp '2024-02-01')""")
def times_ago(spark, d):
    e = A.table(spark, d, "events").where("ts < timestamp '2024-02-01'")
    return e.select("event_id", values.ago_words(F.col("ts").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")).alias("ago"))


FILES = (("../a/b c.txt", "b_c.txt"), ("Résumé?.pdf", "Resume_.pdf"), ("...", "unnamed"), ("", ""), ("x\\y:z", "x_y_z"), ("dir/", "unnamed"))
NUMBERS = (("12.5", 12.5), ("x", 1.0), ("-4", 0.0), ("900", 100.0), (None, 1.0))


@query(f"select event_id, {chosen('event_id', *[b for _, b in FILES])} as file, " + "[" + ", ".join(str(b) for _, b in NUMBERS) + "][cast(event_id % 5 as integer) + 1]::double as number, 'gpt_4o_mini' slug, 'ab' || chr(10) || 'c' clean, case when event_id % 2 = 0 then 'abcdefg...' else 'abc' end short from events")
def sanitised_fields(spark, d):
    e = A.table(spark, d, "events")
    return e.select(
        "event_id", text.safe_filename(pick("event_id", *[a for a, _ in FILES])).alias("file"), text.clamped(pick("event_id", *[a for a, _ in NUMBERS]), least=0.0, most=100.0, default=1.0).alias("number"),
        text.slug(F.lit("GPT-4o (mini)")).alias("slug"), text.without_controls(F.lit(" ab\n\x07c ")).alias("clean"), text.shortened(F.when(F.col("event_id") % 2 == 0, "abcdefghijk").otherwise("abc"), 10).alias("short"),
    )


@query("select event_id, case when event_id % 4 = 0 then null else '1908' end number, case event_id % 4 when 0 then null when 1 then 'north oak court' when 2 then 'oak court' else 'north oak court' end street, case when event_id % 4 = 3 then '3125550100' end phone from events")
def contacts_of_texts(spark, d):
    from tessera.operators import outcomes

    body = pick("event_id", "Paid $600 thanks", "Co: ACME\nAddr: 1908 N Oak Ct, Palatine, IL, 60074\nPaid", "1908 Oak Ct, Palatine", "x\nAddress: 1908 N Oak Ct\n(312) 555-0100")
    c = outcomes.contact_of(body, whole=False)
    return A.table(spark, d, "events").select("event_id", c["street_number"].alias("number"), c["street_name"].alias("street"), c["phone"].alias("phone"))
