"""The driver's star-schema tables seen as tables of the message and job domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: their status gives the life cycle, the key spreads appointments and closings over days."""
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    day = lambda n, h: at + F.make_dt_interval(days=(F.col("o_orderkey") % n).cast("int"), hours=F.lit(h))
    status = (
        F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 7 == 0, "canceled").otherwise("closed"))
        .when(F.col("o_orderstatus") == "P", "appt_set").otherwise(F.when(F.col("o_orderkey") % 11 == 0, "rejected").otherwise("pending"))
    )
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), at.alias("first_message_at"), status.alias("lifecycle_status"),
        F.when(F.col("o_orderstatus") == "P", day(4, 12)).alias("appt_at"), F.when(F.col("o_orderstatus") == "F", day(3, 20)).alias("closed_at"),
        F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" + tip")).alias("closed_total"),
        F.lit(None).cast("timestamp").alias("lifecycle_status_changed_at"), F.lit(None).cast("string").alias("customer_phone_e164"),
        *[F.lit(None).cast("string").alias(f"address_{c}") for c in ("street_number", "street_name", "city", "state", "zip")],
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("display_name"))


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the messages that opened a job."""
    text = F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    stamp = F.struct(F.col("l_shipdate").cast("timestamp").alias("at"), F.col("l_linenumber").alias("n"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), text.alias("content"), F.lit(None).cast("string").alias("from_number"), stamp.alias("created_at"))


STATUS_OF = {"click": "dispatched", "view": "appt_set", "purchase": "completed", "signup": "pending", "error": "canceled"}


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as life cycle events of their users; clicks are dispatches whose payload names technician and chat."""
    e = table(spark, sf_dir, "events")
    status = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_OF.items() for x in kv]), F.col("event_type")), F.lit("in_progress"))
    source = F.when(F.col("event_type") == "click", "operator_whatsapp").when(F.col("event_type") == "purchase", "closing_chat").otherwise("tech_whatsapp")
    at = F.col("ts").cast("timestamp")
    payload = F.to_json(F.struct(
        (F.col("user_id") % 20).cast("string").alias("technician_id"), (F.col("user_id") % 30).cast("string").alias("chat_jid"),
        F.date_format(at + F.expr("interval 3 hours"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("appt_iso"), F.col("value").cast("decimal(18,2)").cast("string").alias("closed_total"),
    ))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), source.alias("source"), F.lit(None).cast("string").alias("from_status"), status.alias("to_status"), payload.alias("payload"), at.alias("created_at"))


def thread_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as phone messages, a turn a minute."""
    c = table(spark, sf_dir, "conversations")
    other = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") % 100 * 86400 + F.col("turn") * 60)
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("id"), F.lit("openphone").alias("source"),
        F.when(F.col("role") == "user", "incoming").otherwise("outgoing").alias("direction"), other.alias("from_number"), F.array(other).alias("to_numbers"),
        F.col("text").alias("content"), at.alias("created_at"), "conv_id", "turn", F.lit("p1").alias("phone_number_id"),
    )


STREETS = {"1-URGENT": ("Oak St", "oak street"), "2-HIGH": ("N Main St", "north main street"), "3-MEDIUM": ("Pine Rd", "pine road")}


def placed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs with an address and a phone; every third has no phone."""
    o = table(spark, sf_dir, "orders")
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, (_, v) in STREETS.items() for x in (k, v)]), F.col("o_orderpriority")), F.lit("elm avenue"))
    status = F.element_at(F.array(*map(F.lit, ["pending", "pending", "dispatched", "closed", "completed"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("company_id"), F.col("o_orderdate").cast("timestamp").alias("first_message_at"), status.alias("lifecycle_status"),
        (F.col("o_custkey") % 60 + 1).cast("string").alias("address_street_number"), name.alias("address_street_name"), (F.col("o_custkey") % 7 + 60600).cast("string").alias("address_zip"),
        F.when(F.col("o_orderkey") % 3 > 0, phone_of("o_custkey")).alias("customer_phone_e164"),
        *[F.lit(None).cast("string").alias(c) for c in ("closed_total", "closed_parts", "closed_tip", "closed_payment_method", "closed_notes")],
        F.lit(None).cast("timestamp").alias("closed_at"), F.lit(None).cast("bigint").alias("closed_from_dispatch_job_id"),
    )


def phone_of(key: str):
    return F.concat(F.lit("312555"), F.lpad((F.col(key) % 10000).cast("string"), 4, "0"))


def own_phone_of(key: str):
    """A number of its own for each key; `phone_of` gives the keys beyond 9999 those of the first ten thousand again."""
    return (F.lit(3125550000) + F.col(key)).cast("string")


def contact_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a message, up to twenty days after it, that names a street, a zip code or a phone in plain text."""
    o = table(spark, sf_dir, "orders")
    short = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, (v, _) in STREETS.items() for x in (k, v)]), F.col("o_orderpriority")), F.lit("Elm Ave"))
    street = F.concat((F.col("o_custkey") % 60 + 1).cast("string"), F.lit(" "), short, F.lit(", Chicago, IL"))
    zip_ = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), (F.col("o_custkey") % 7 + 60600).cast("string"))).otherwise("")
    number = F.concat(F.lit("(312) 555-"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"))
    body = F.when(F.col("o_orderkey") % 5 == 0, number).when(F.col("o_orderkey") % 7 == 0, F.concat(street, zip_, F.lit("\n"), number)).when(F.col("o_orderkey") % 11 == 0, "hello").otherwise(F.concat(street, zip_))
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(days=(F.col("o_orderkey") % 20).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("chat"), (F.col("o_custkey") % 30).cast("string")).alias("chat_jid"), F.concat(F.lit("w"), F.col("o_orderkey").cast("string")).alias("wa_message_id"), body.alias("body"), at.alias("timestamp"), (F.col("o_custkey") % 40).alias("company_id"))


def technicians(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("chat"), F.col("s_suppkey").cast("string")).alias("whatsapp_chat_jid"), phone_of("s_suppkey").alias("phone_e164"),
        (F.col("s_suppkey") % 5 > 0).alias("is_active"),
    )


def phoned_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as companies with two numbers each."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).alias("display_name"), (F.col("c_custkey") % 4).cast("int").alias("priority"),
        F.lit(True).alias("is_active"), F.array(phone_of("c_custkey"), F.concat(F.lit("+1 "), F.lit("312555"), F.lpad(((F.col("c_custkey") * 7 + 40) % 10000).cast("string"), 4, "0"))).alias("phone_numbers"),
    )


KINDS = {"click": "undispatched", "view": "stuck_dispatched", "purchase": "closing_missing", "signup": "follow_up_due", "error": "dispatch_no_match"}


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as alerts of their users' jobs: every third is resolved an hour later, every fifth was seen."""
    e = table(spark, sf_dir, "events")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("event_type")), F.lit("closing_unfiled"))
    at = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.lit(None).cast("string").alias("chat_jid"), kind.alias("kind"), F.lit(90).alias("threshold_minutes"), at.alias("detected_at"),
        F.when(F.col("event_id") % 3 == 0, at + F.expr("interval 1 hour")).alias("resolved_at"), F.when(F.col("event_id") % 5 == 0, at).alias("seen_at"),
        F.to_json(F.struct(F.date_format(at - F.expr("interval 3 hours"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("since"), F.lit("pending").alias("lifecycle_status"))).alias("payload"),
    )


def messages_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of their users' chats with a plain body."""
    body = F.element_at(F.array(*map(F.lit, ["pass", "sorry cant help", "ok", "got it", "nope", "see you"])), (F.col("event_id") % 6 + 1).cast("int"))
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("chat"), "event_type", body.alias("body"), F.col("ts").cast("timestamp").alias("timestamp"))
