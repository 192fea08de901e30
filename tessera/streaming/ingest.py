"""Streams of messages and events.

Messages come at least once and out of order; `streaming.store.RunStore` keeps the newest version per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import ZONE

KEYS = ["chat_jid", "wa_message_id"]


def distinct_events(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def daily_counts(events: DataFrame, ts: str, *keys: str, late: str = "2 days") -> DataFrame:
    """Counts per business day, a row a day and keys.

    A business day isn't of fixed length, but on the clock of its zone, moved by its start, every one is a calendar day;
    the watermark runs on that clock.
    """
    local = events.withColumn("_local", (F.from_utc_timestamp(F.col(ts).cast("timestamp"), ZONE) - F.expr("interval 5 hours")))
    counted = local.withWatermark("_local", late).groupBy(F.window("_local", "1 day"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.to_date("window.start").alias("business_day"), *keys, "n")


def route(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """What each message is for, in order: unknown chat, payment signal, technician's chat, operator's decline, mirror."""
    from tessera.functions.signals import is_reject_phrase, payment_tokens

    known = chats.where("is_active").select("chat_jid", "chat_role")
    got = messages.join(known.withColumn("_known", F.lit(True)), "chat_jid", "left")
    tech = F.col("chat_role") == "tech_dispatch"
    route_ = (
        F.when(F.col("_known").isNull(), "rejected_chat").when(payment_tokens(F.col("body")).isNotNull(), "closing_signal")
        .when(tech & F.col("is_from_me"), "dispatch").when(tech, "tech_reply")
        .when(F.col("is_from_me") & is_reject_phrase(F.col("body")), "operator_reject").otherwise("classify")
    )
    return got.withColumn("route", route_).drop("_known")
