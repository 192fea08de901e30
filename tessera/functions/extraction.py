"""Rules over extracted job fields: whitelists, conditional fields, scores, group ids, closing signals."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

from tessera.functions.contact import normalize_address, normalize_phone
from tessera.functions.text import ANY_CASE, blank, strip

#: Valid job types, payment methods and their aliases.
JOB_TYPES = [
    "House Lockout", "Car Lockout", "Safe Lockout", "Storage Lockout", "Bussiness Lockout", "Bike Lockout", "Steering wheel Lockout",
    "Mailbox Lockchange", "House Lockchange", "Bussiness Lockchange", "Sliding Door", "French Door", "Panic Bar", "Lockbox",
    "Car Key made", "Ignition replacement", "Chimney", "Airduct Service", "Garage Door Service",
]
PAYMENTS = ["cash", "cash_app", "zelle", "cc", "check", "no_apply"]
PAYMENT_ALIASES = {
    "cash app": "cash_app", "cashapp": "cash_app", "credit card": "cc", "credit": "cc", "debit": "cc", "card": "cc", "visa": "cc",
    "mastercard": "cc", "amex": "cc", "discover": "cc", "venmo": "zelle", "cheque": "check",
}
CAR = ("car_make", "car_model", "car_year")


def job_type(x: Column) -> Column:
    t = strip(x)
    return F.when(t.isin(JOB_TYPES), t)


def payment_method(x: Column) -> Column:
    t = strip(F.regexp_replace(F.lower(strip(F.coalesce(x, F.lit("")))), r"\([^)]*\)", ""))
    table = F.create_map(*[F.lit(v) for kv in PAYMENT_ALIASES.items() for v in kv])
    return F.coalesce(F.when(t.isin(PAYMENTS), t), F.try_element_at(table, t), F.lit("no_apply"))


def car_field(kind: Column, value: Column) -> Column:
    """NO_APPLY unless the job is a car key; then NOT_FOUND where blank."""
    is_car = F.coalesce(kind == "Car Key made", F.lit(False))
    return F.when(~is_car, "NO_APPLY").when(blank(value), "NOT_FOUND").otherwise(value)


def consistency_score(kind: Column, cars: list[Column], phone: Column, total: Column) -> Column:
    """A quarter for each of: a valid type, car fields that fit it, a phone of ten digits or none, a plain total or none."""
    text = lambda c: F.coalesce(c, F.lit(""))
    is_car = text(kind) == "Car Key made"
    filled, clear = F.lit(True), F.lit(True)
    for c in cars:
        filled = filled & ~text(c).isin("", "NOT_FOUND")
        clear = clear & text(c).isin("", "NO_APPLY")
    rules = [
        text(kind).isin(JOB_TYPES), F.when(is_car, filled).otherwise(clear),
        (text(phone) == "") | normalize_phone(phone).isNotNull(), (text(total) == "") | strip(text(total)).rlike(r"^\$?\d+(\.\d{1,2})?$"),
    ]
    out = F.lit(0.0)
    for r in rules:
        out = out + F.when(r, 0.25).otherwise(0.0)
    return F.round(out, 2)


def dedup_group_id(company: Column, address: Column, phone: Column) -> Column:
    """Twelve digits of a hash over company, street and phone; raw values where these can't be parsed."""
    a = normalize_address(address)
    street = F.nullif(F.concat_ws("|", F.nullif(a["street_number"], F.lit("")), F.nullif(a["street_name"], F.lit(""))), F.lit(""))
    where = F.coalesce(F.lower(street), F.lower(strip(address)), F.lit(""))
    who = F.coalesce(normalize_phone(phone), strip(phone), F.lit(""))
    key = F.concat_ws("|", F.lower(strip(F.coalesce(company, F.lit("")))), where, who)
    return F.substring(F.sha1(key.cast("binary")), 1, 12)


def has_estimate_words(body: Column) -> Column:
    return F.coalesce(body, F.lit("")).rlike(ANY_CASE + r"\b(estimate|estimated|quote|quoted|quoting)\b")


def closing_signals(total: Column, parts: Column, no_estimate: Column) -> Column:
    t, p = ~blank(total), ~blank(parts)
    return F.struct(t.alias("has_total"), p.alias("has_parts"), no_estimate.alias("no_estimate_language"), (t & p & no_estimate).alias("closing_likely"))


def _as_text(v):
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, list):
        return ", ".join(str(x) for x in v if x is not None and str(x).strip()) or None
    if isinstance(v, dict):
        return ", ".join(f"{k}={x}" for k, x in v.items() if x is not None)
    return str(v)


@F.pandas_udf(MapType(StringType(), StringType()))
def first_json_object(text: pd.Series) -> pd.Series:
    """Fields, as text, of the first JSON object in a text; null if none parses.  Nesting is beyond regular patterns."""
    decoder = json.JSONDecoder()

    def one(t):
        at = -1
        while t and (at := t.find("{", at + 1)) >= 0:
            try:
                return {k: _as_text(v) for k, v in decoder.raw_decode(t, at)[0].items()}
            except ValueError:
                continue
        return None

    return text.map(one)


@F.pandas_udf(ArrayType(MapType(StringType(), StringType())))
def json_objects(text: pd.Series) -> pd.Series:
    """Fields, as text, of all objects of a JSON answer: of an array, in order, if that is the whole text (null for other
    values in it), else of the first object that parses, else of the first array that does; null without any.
    """
    decoder = json.JSONDecoder()

    def found(t: str):
        try:
            return json.loads(t)
        except (ValueError, RecursionError):
            pass
        for sign in "{[":
            at = -1
            while (at := t.find(sign, at + 1)) >= 0:
                try:
                    return decoder.raw_decode(t, at)[0]
                except (ValueError, RecursionError):
                    continue
        return None

    def one(t):
        value = found(t.strip()) if t else None
        if isinstance(value, dict):
            value = [value]
        return [{k: _as_text(v) for k, v in x.items()} if isinstance(x, dict) else None for x in value] if isinstance(value, list) else None

    return text.map(one)


#: Wording of what an extractor is asked.
COMPANY, NO_COMPANY, DIRECTION, NO_DIRECTION, MESSAGE = "Company: ", "(unknown)", "\nDirection: ", "unknown", "\n\nMessage:\n"
MESSAGES, ONE_OF, END_ONE = "MESSAGES:\n", "--- Message ", " ---\n"
ANSWER = "\nReturn a JSON ARRAY of N objects in the same order, one per message. No markdown. No explanations."


def prompt(company: Column, direction: Column, body: Column, most: int = 2500) -> Column:
    """What an extractor is asked about one message."""
    quote = '"""'
    return F.concat(
        F.lit(COMPANY), F.coalesce(F.nullif(company, F.lit("")), F.lit(NO_COMPANY)), F.lit(DIRECTION),
        F.lower(F.coalesce(F.nullif(direction, F.lit("")), F.lit(NO_DIRECTION))), F.lit(f"{MESSAGE}{quote}\n"),
        F.substring(F.coalesce(body, F.lit("")), 1, most), F.lit(f"\n{quote}\n"),
    )


def batch_prompt(items: Column, most: int = 2500) -> Column:
    """What an extractor is asked about several messages; items: array of (company, direction, body)."""
    quote = '"""'
    one = lambda x, i: F.concat(
        F.lit(ONE_OF), (i + 1).cast("string"), F.lit(END_ONE + COMPANY), F.coalesce(F.nullif(x["company"], F.lit("")), F.lit(NO_COMPANY)), F.lit(DIRECTION),
        F.lower(F.coalesce(F.nullif(x["direction"], F.lit("")), F.lit(NO_DIRECTION))), F.lit(f"\n{quote}\n"), F.substring(F.coalesce(x["body"], F.lit("")), 1, most), F.lit(f"\n{quote}\n"),
    )
    return F.concat(F.lit(MESSAGES), F.array_join(F.transform(items, one), "\n"), F.lit(ANSWER))
