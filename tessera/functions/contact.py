"""Phones and US postal addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import once, strip

#: Street suffixes and directions with their long forms.
SUFFIXES = {
    "st": "street", "street": "street", "ave": "avenue", "avenue": "avenue", "blvd": "boulevard", "boulevard": "boulevard", "dr": "drive",
    "drive": "drive", "ln": "lane", "lane": "lane", "rd": "road", "road": "road", "way": "way", "ct": "court", "court": "court", "pl": "place",
    "place": "place", "pkwy": "parkway", "parkway": "parkway", "ter": "terrace", "terrace": "terrace", "cir": "circle",
    "circle": "circle", "hwy": "highway", "highway": "highway",
}
DIRECTIONS = {
    "n": "north", "north": "north", "s": "south", "south": "south", "e": "east", "east": "east", "w": "west", "west": "west",
    "ne": "northeast", "northeast": "northeast", "nw": "northwest", "northwest": "northwest", "se": "southeast", "southeast": "southeast",
    "sw": "southwest", "southwest": "southwest",
}
#: Patterns of phones and of addresses in messages.
PHONE = r"(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}"
ADDRESSES = [
    r"(?:Address|Addr)\s*[:.]\s*.+",
    r"[A-Za-z\s]+,\s*[A-Z]{2}\s*,?\s*\d{5}",
    r"\d+\s+[A-Za-z\s]+(?:St|Street|Ave|Avenue|Blvd|Boulevard|Dr|Drive|Ln|Lane|Rd|Road|Way|Ct|Court|Pl|Place)",
    r"\d{2,}\s+[A-Za-z\s]+,\s*[A-Z]{2}\s*\d{5}",
]
#: Patterns of a street line, of what stands before the first comma behind any text, of a state and of a zip code.
STREET_LINE = r"(?s)^(\d+[A-Za-z]?)\s+(.+)$"
FIRST_CHUNK = r"(?U)^[\s,]*([^,]*)"
STATE = r"\b([A-Z]{2})\b"
ZIP = r"\b(\d{5})(?:-\d{4})?\b"


def digits(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", "")


def normalize_phone(x: Column) -> Column:
    """Ten digits, a leading 1 of eleven dropped; null for anything else."""
    ten = once(digits(x), lambda d: F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d))
    return once(ten, lambda d: F.when(F.length(d) == 10, d))


def to_e164(x: Column) -> Column:
    return F.concat(F.lit("+1"), normalize_phone(x))


def phone_match_key(x: Column) -> Column:
    """Equal keys mean the same phone: the last ten digits, or all of them if fewer; null below seven digits."""
    d = digits(x)
    return F.when(F.length(d) >= 10, F.right(d, F.lit(10))).when(F.length(d) >= 7, d)


def _long_form(token: Column, known: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), token)


def normalize_street_name(x: Column) -> Column:
    """Letters only, lower case, with a leading direction and a trailing suffix written out."""
    words = F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("([A-Za-z]+)"), 1), F.lower)

    def ended(front: Column, rest: Column, back: Column) -> Column:
        stem = F.when(back.isNotNull(), F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
        return F.concat_ws(" ", front, F.nullif(F.array_join(stem, " "), F.lit("")), back)

    def begun(words: Column, front: Column) -> Column:
        rest = F.when(front.isNotNull(), F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))).otherwise(words)
        return once(rest, lambda r: once(F.when(F.size(r) > 0, _long_form(F.get(r, F.size(r) - 1), SUFFIXES)), lambda back: ended(front, r, back)))

    return once(words, lambda w: once(F.when(F.size(w) > 0, _long_form(F.get(w, F.lit(0)), DIRECTIONS)), lambda front: begun(w, front)))


def given(x: Column) -> Column:
    """x, null if it is empty."""
    return once(x, lambda v: F.when(v != "", v))


def normalize_street(text: Column) -> Column:
    """Struct of street_number, street_name and zip, without the rest of an address."""
    first = strip(F.regexp_extract(text, FIRST_CHUNK, 1))
    name = lambda street, n: F.when(n.isNotNull(), normalize_street_name(F.regexp_extract(street, STREET_LINE, 2)))
    line = lambda street: once(given(F.regexp_extract(street, STREET_LINE, 1)), lambda n: F.struct(n.alias("street_number"), name(street, n).alias("street_name")))
    return once(once(first, line), lambda s: F.struct(s["street_number"].alias("street_number"), s["street_name"].alias("street_name"), given(F.regexp_extract(text, ZIP, 1)).alias("zip")))


def normalize_address(x: Column) -> Column:
    """Struct of street_number, street_name, city, state and zip; what isn't found is null."""

    def parts(chunks: Column, street: Column, states: Column) -> Column:
        # place of the first chunk behind the street that holds a state
        at = F.coalesce(F.array_position(F.transform(states, lambda s: s.isNotNull()), True), F.lit(0)).cast("int")
        return once(at, lambda n: F.struct(
            street["street_number"].alias("street_number"), street["street_name"].alias("street_name"),
            F.when(n >= 2, F.lower(F.get(chunks, n - 1))).alias("city"), F.when(n >= 1, F.get(states, n - 1)).alias("state"), street["zip"].alias("zip"),
        ))

    def placed(text: Column, chunks: Column) -> Column:
        behind = F.when(F.size(chunks) > 1, F.slice(chunks, 2, F.greatest(F.size(chunks), F.lit(1))))
        states = F.transform(behind, lambda c: given(F.regexp_extract(c, STATE, 1)))
        return once(normalize_street(text), lambda s: once(states, lambda found: parts(chunks, s, found)))

    chunked = lambda text: F.filter(F.transform(F.split(text, ","), strip), lambda c: c != "")
    return once(strip(F.coalesce(x, F.lit(""))), lambda text: once(chunked(text), lambda chunks: placed(text, chunks)))


def has_phone(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).rlike(PHONE)


def has_address(x: Column) -> Column:
    t = F.coalesce(x, F.lit(""))
    out = F.lit(False)
    for p in ADDRESSES:
        out = out | t.rlike(f"(?id){p}")
    return out


def is_job_message(x: Column) -> Column:
    """The gate of jobs: a phone and an address."""
    return has_phone(x) & has_address(x)


def has_matching_key(x: Column) -> Column:
    """The gate of closings: a phone or an address."""
    return has_phone(x) | has_address(x)


#: Patterns of what a chat page leaves in a message: the time, a prompt, the sender with their number.
CHAT_TIME = r"(?iU)\s*\d{1,2}:\d{2}\s*[ap]\.?\s*m\.?\s*$"
CHAT_PROMPT = r"(?id)Update\?\s*@[^\n]*$"
CHAT_SENDER = r"(?Ud)^\s*\S.*?\+\d[\d\s().\-]{6,}\d"


def without_chat_marks(x: Column) -> Column:
    """A message without the time and the prompt that a chat page leaves behind it and the sender before it."""
    out = F.coalesce(x, F.lit(""))
    for mark in (CHAT_TIME, CHAT_PROMPT, CHAT_SENDER):
        out = F.regexp_replace(out, mark, "")
    return strip(out)
