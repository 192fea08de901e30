"""Searches over messages and threads, and lookups of the dimensions beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.contact import normalize_phone, phone_match_key
from tessera.functions.text import contains_any_case, like_escaped
from tessera.operators.perkey import page, where_all, within


def counterparty() -> Column:
    """The other side of a message: the sender of incoming ones, else the first recipient."""
    return F.when(F.col("direction") == "incoming", F.col("from_number")).otherwise(F.get("to_numbers", F.lit(0)))


def thread_heads(messages: DataFrame, phone_number_id: str | None = None) -> DataFrame:
    """One row a counterparty: its latest message and message_count, phone messages only."""
    own = where_all(messages, F.col("source") == "openphone", None if phone_number_id is None else F.col("phone_number_id") == phone_number_id)
    named = own.withColumn("counterparty", counterparty()).where("counterparty is not null")
    rest = [c for c in named.columns if c != "counterparty"]
    got = named.groupBy("counterparty").agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("_head"), F.count(F.lit(1)).alias("message_count"))
    return got.select("counterparty", "_head.*", "message_count")


def list_threads(messages: DataFrame, labels: DataFrame | None = None, companies: DataFrame | None = None, phone_number_id: str | None = None, skip: int = 0, limit: int = 50) -> DataFrame:
    """A page of threads, the most recently active first, with their labels and companies."""
    top = page(thread_heads(messages, phone_number_id), [F.desc("created_at"), F.col("counterparty")], skip, limit)
    if labels is not None:
        top = top.join(labels.select("counterparty", "label", F.col("company_id").alias("label_company_id")), "counterparty", "left")
        if companies is not None:
            names = companies.select(F.col("id").alias("label_company_id"), F.coalesce("display_name", "name").alias("label_company_name"))
            top = top.join(names, "label_company_id", "left")
    return top.orderBy(F.desc("created_at"), "counterparty")


def count_threads(messages: DataFrame, phone_number_id: str | None = None) -> DataFrame:
    own = where_all(messages, F.col("source") == "openphone", None if phone_number_id is None else F.col("phone_number_id") == phone_number_id)
    return own.agg(F.countDistinct(counterparty()).alias("n_threads"))


def thread_messages(messages: DataFrame, other: str, phone_number_id: str | None = None, since=None, until=None) -> DataFrame:
    """Messages from a counterparty or to it as any recipient."""
    either = (F.col("from_number") == other) | F.array_contains("to_numbers", other)
    return where_all(
        messages, F.col("source") == "openphone", either, within(F.col("created_at"), since, until),
        None if phone_number_id is None else F.col("phone_number_id") == phone_number_id,
    )


def chat_messages(messages: DataFrame, chat_jid: str | None = None, since=None, until=None, sender: str | None = None, contains: str | None = None, wildcards: bool = False) -> DataFrame:
    """Filtered chat messages; `contains` is taken literally unless wildcards are asked for."""
    text = F.col("body").ilike(f"%{contains}%") if wildcards else contains_any_case(F.col("body"), contains or "")
    return where_all(
        messages, None if chat_jid is None else F.col("chat_jid") == chat_jid, within(F.col("timestamp"), since, until),
        None if sender is None else (F.col("sender_jid") == sender) | (F.col("sender_name") == sender), None if contains is None else text,
    )


def dispatch_jobs(jobs: DataFrame, messages: DataFrame | None = None, status: str | None = None, company_id: str | None = None, since=None, until=None, exclude_statuses: list[str] = (), search: str | None = None) -> DataFrame:
    """Filtered dispatch jobs; messages are joined only if a text is searched."""
    out = where_all(
        jobs, None if status is None else F.col("classification_status") == status, None if company_id is None else F.col("company_id") == company_id,
        within(F.col("created_at"), since, until), ~F.col("classification_status").isin(list(exclude_statuses)) if exclude_statuses else None,
    )
    if search is not None:
        hits = messages.where(contains_any_case(F.col("content"), search)).select(F.col("id").alias("incoming_message_id"))
        out = out.join(hits, "incoming_message_id", "left_semi")
    return out


def job_ids_by_message(jobs: DataFrame, messages: DataFrame, search: str) -> DataFrame:
    """Distinct job ids with a message that holds the text; % and _ stand for themselves."""
    pattern = f"%{like_escaped(search, '!')}%"
    hits = messages.where(F.expr("content ilike :p escape '!'".replace(":p", "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"))).select(F.col("id").alias("incoming_message_id"))
    return jobs.where("job_id is not null").join(hits, "incoming_message_id", "left_semi").select("job_id").distinct()


def job_view(dispatch: DataFrame, companies: DataFrame, messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Dispatch jobs with company, message and job columns, and the tip and notes of their extraction."""
    c = companies.select(F.col("id").alias("company_id"), F.coalesce("display_name", "name").alias("company_name"))
    m = messages.select(F.col("id").alias("incoming_message_id"), "content", "from_number", F.col("source").alias("message_source"))
    j = jobs.select(F.col("id").alias("job_id"), "lifecycle_status", "appt_at", "follow_up_at", "is_duplicate")
    out = dispatch.join(c, "company_id", "left").join(m, "incoming_message_id", "left").join(j, "job_id", "left")
    return out.withColumns({"tip": F.get_json_object("extraction_raw", "$.tip"), "notes": F.get_json_object("extraction_raw", "$.notes")})


def technician_of(messages: DataFrame, technicians: DataFrame) -> DataFrame:
    """(id, technician_id): the technician who sent an incoming message or first stands among the recipients."""
    sides = F.when(F.col("direction") == "incoming", F.array("from_number")).otherwise(F.col("to_numbers"))
    each = messages.select("id", F.posexplode(sides).alias("pos", "number")).withColumn("key", normalize_phone(F.col("number")))
    known = technicians.where("is_active").select(normalize_phone(F.col("phone_e164")).alias("key"), F.col("id").alias("technician_id"))
    return each.join(known, "key").groupBy("id").agg(F.min_by("technician_id", F.struct("pos", "technician_id")).alias("technician_id"))


def companies_by_phone(numbers: DataFrame, companies: DataFrame, id_column: str, number: str) -> DataFrame:
    """(id, company_id, company_name): the company of lowest priority that lists a number; ten last digits decide."""
    each = companies.where("is_active").select("id", "name", "priority", F.explode("phone_numbers").alias("p"))
    known = each.select(phone_match_key(F.col("p")).alias("key"), F.struct("priority", "name", "id").alias("c")).where("key is not null")
    known = known.groupBy("key").agg(F.min("c").alias("c"))
    asked = numbers.select(id_column, phone_match_key(F.col(number)).alias("key")).where("key is not null")
    return asked.join(known, "key").select(id_column, F.col("c.id").alias("company_id"), F.col("c.name").alias("company_name"))


def binding_suggestions(messages: DataFrame, dispatch: DataFrame, companies: DataFrame, bindings: DataFrame, least: int = 1) -> DataFrame:
    """Senders that a company was found for and that no binding names, with the number of such messages."""
    key = F.right(F.regexp_replace("from_number", "[^0-9]", ""), F.lit(10))
    sent = messages.where("source = 'openphone'").select(F.col("id").alias("incoming_message_id"), key.alias("phone")).where("length(phone) = 10")
    found = dispatch.where("company_id is not null").select("incoming_message_id", "company_id").join(sent, "incoming_message_id")
    bound = bindings.select(F.right(F.regexp_replace("phone_e164", "[^0-9]", ""), F.lit(10)).alias("phone"))
    counted = found.join(bound, "phone", "left_anti").groupBy("phone", "company_id").agg(F.count(F.lit(1)).alias("n_messages")).where(F.col("n_messages") >= least)
    names = companies.select(F.col("id").alias("company_id"), F.coalesce("display_name", "name").alias("company_name"))
    return counted.join(names, "company_id").orderBy(F.desc("n_messages"), "phone", "company_id")
